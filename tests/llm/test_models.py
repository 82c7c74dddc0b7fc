"""The two learned operators against plain Python versions of their formulas, on ties, repeats, nulls and clashing columns."""

import math
import random
import re
import unicodedata
import zlib
from collections import Counter, defaultdict

import pytest

from glyphql.llm import language_id, quality


def grams(text):
    """Every 1- to 3-gram of the letters, words parted by one blank; a trigram does not cross a word's edge on both sides."""
    words = "".join(c if c.isalpha() else " " for c in (text or "").lower()).split()
    if not words:
        return []
    s = " " + " ".join(words) + " "
    return [c for c in s if c != " "] + [s[k : k + 2] for k in range(len(s) - 1)] + [s[k : k + 3] for k in range(len(s) - 2) if s[k + 1] != " "]


def code(gram):
    out = 0
    for c in gram:
        out = out << 21 | (language_id.BLANK if c == " " else ord(c))
    return out


def profile(counts):
    return [g for g, _ in sorted(counts.items(), key=lambda x: (-x[1], code(x[0])))][: language_id.SIZE]


def brute_languages(rows):
    held = lambda i: zlib.crc32(str(i).encode()) % 5 == 0
    counts = defaultdict(Counter)
    for i, text, lang in rows:
        if not held(i) and lang is not None and text is not None:
            counts[lang].update(grams(text))
    profiles = {lang: {g: k for k, g in enumerate(profile(c))} for lang, c in sorted(counts.items()) if c}
    out = []
    for i, text, _ in rows:
        own = profile(Counter(grams(text)))
        if not own:
            out.append((i, held(i), "und", 0.0))
            continue
        far = {lang: sum(abs(p[g] - k) if g in p else language_id.SIZE for k, g in enumerate(own)) for lang, p in profiles.items()}
        best = min(sorted(far), key=far.get)
        out.append((i, held(i), best, 1 - far[best] / (len(own) * language_id.SIZE)))
    return out


def test_language_query_equals_brute_force(spark, tmp_path):
    rng = random.Random(4)
    vocabulary = {lang: ["".join(rng.choice(letters) for _ in range(rng.randint(1, 9))) for _ in range(150)] for lang, letters in {"aa": "abcdeé", "bb": "abcdeß", "cc": "дежз", "dd": "ab"}.items()}
    rows = []
    for k in range(240):
        lang = rng.choice(sorted(vocabulary))
        text = rng.choice([" ", "\n", ", "]).join(rng.choice(vocabulary[lang]) for _ in range(rng.choice([0, 1, 2, 8, 60, 700])))
        rows.append((k, rng.choice([text, text.title(), text.upper(), f"12 {text} 34"]), rng.choice([lang, lang, lang, None])))
    rows += [(900, None, "aa"), (901, "", "bb"), (902, "123 !?", "cc"), (903, "ab", "dd"), (904, "ба日", None), (905, "ab " * 9000, "dd"), (7, "ab ab", "dd"), (7, "ab ab", "dd")]
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, lang string, id long, score string")
    df.write.parquet(f"file://{tmp_path}/documents.parquet")
    got = sorted((r.doc_id, r.held_out, r.lang_pred, round(r.score, 9)) for r in language_id.query(spark, f"file://{tmp_path}").collect())
    assert got == sorted((i, h, lang, round(s, 9)) for i, h, lang, s in brute_languages(rows))
    assert {lang for *_, lang, _ in got} == {"aa", "bb", "cc", "dd", "und"}


def brute_features(text):
    text = text or ""
    words, lines, n = re.split(r"[ \t\n\x0b\f\r]+", text.strip(" ")), text.split("\n"), len(text)
    share = lambda part, whole, scale: min(quality.BINS - 1, math.floor(part / whole * scale)) if whole else 0
    of = lambda *kinds: sum(unicodedata.category(c).startswith(kinds) for c in text)
    plain = sum(unicodedata.category(c)[0] in "LN" or c in " \t\n\x0b\f\r.," for c in text)
    logs = math.log2(len(words) + 1)
    return {
        "symbols": share(n - plain, n, 60), "capitals": share(of("Lu"), n, 40), "digits": share(sum("0" <= c <= "9" for c in text), n, 60), "word_length": share(n, len(words), 1.5),
        "repeated_lines": share(len(lines) - len(set(lines)), len(lines), 24), "repeated_words": share(len(words) - len(set(words)), len(words), 12) + quality.BINS * math.floor(logs / 2), "words": min(quality.BINS - 1, math.floor(logs * 2)),
    }


def brute_quality(docs, labels):
    given = defaultdict(list)
    for i, q in labels:
        if q is not None:
            given[i].append(q)
    rows = [{"id": i, "host": h, "path": (h, p), "f": brute_features(t), "q": sum(given[i]) / len(given[i]) if i in given else None} for i, t, h, p in docs]
    known = [r for r in rows if r["q"] is not None]
    total = {}
    for f in brute_features(""):
        good, bad = Counter(), Counter()
        for r in known:
            good[r["f"][f]] += r["q"]
            bad[r["f"][f]] += 1 - r["q"]
        if sum(good.values()) and sum(bad.values()):
            total[f] = {b: math.log((good[b] + 1) / (sum(good.values()) + len(good))) - math.log((bad[b] + 1) / (sum(bad.values()) + len(good))) for b in good}
    for r in rows:
        r["raw"] = sum(t.get(r["f"][f], 0.0) for f, t in total.items())
    bins = defaultdict(lambda: [0.0, 0])
    for r in known:
        b = max(-160, min(160, math.floor(r["raw"] * 4)))
        bins[b][0] += r["q"]
        bins[b][1] += 1
    a, b = quality.calibrate([(k / 4 + 0.125, g, n) for k, (g, n) in sorted(bins.items())])
    site, host = defaultdict(list), defaultdict(list)
    for r in rows:
        r["e"] = max(-12.0, min(12.0, a + b * r["raw"]))
        r["soft"] = r["q"] if r["q"] is not None else 1 / (1 + math.exp(-r["e"]))
        site[r["path"]].append(r["soft"])
        host[r["host"]].append(r["soft"])
    mean = min(0.999, max(0.001, sum(r["soft"] for r in rows) / len(rows)))

    def strength(groups, prior):
        spread = chance = n = scale = 0.0
        for k, xs in groups.items():
            if len(xs) > 1:
                m = prior(k)
                spread += len(xs) * (sum(xs) / len(xs) - m) ** 2
                chance, n, scale = chance + m * (1 - m), n + len(xs), scale + len(xs) * m * (1 - m)
        return min(10_000.0, max(2.0, 1 / max((spread - chance) / scale, 1e-4) - 1)) if n and scale else 100.0

    k_host = strength(host, lambda _: mean)
    at_host = {h: (sum(xs) + k_host * mean) / (len(xs) + k_host) for h, xs in host.items()}
    k_path = strength(site, lambda p: at_host[p[0]])
    out = []
    for r in rows:
        xs, prior = site[r["path"]], at_host[r["host"]]
        rest = max(0.001, min(0.999, (sum(xs) - r["soft"] + k_path * prior) / (len(xs) - 1 + k_path)))
        odds = r["e"] + math.log(rest / (1 - rest)) - math.log(mean / (1 - mean))
        out.append((r["id"], r["e"], prior, rest, 1 / (1 + math.exp(-odds))))
    return out


def test_quality_query_equals_brute_force(spark, tmp_path):
    rng = random.Random(6)
    docs, labels = [], []
    for k in range(300):
        good = rng.random() < (0.8 if k % 4 else 0.3)
        words = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(1, 9))) for _ in range(rng.randint(1, 80))]
        text = " ".join(words) + "." if good else rng.choice(["### !!! ", "BUY NOW 100 % ", "same line\n", "x1 "]) * rng.randint(1, 40)
        docs.append((k, text, f"h{k % 4}" if k % 9 else None, rng.choice(["en", "de", None])))
        if k % 2:
            labels.append((k, int(good)))
    docs += [(1, docs[1][1], "h1", "en"), (500, None, "h1", "en"), (501, "", None, None), (502, "Long wörds 12 " * 3000, "alone", "xx")]
    labels += [(3, 0), (3, 1), (5, None), (9999, 1)]  # several labels, none, of no document
    df = spark.createDataFrame([(*d, 1, 2.0) for d in docs], "doc_id long, text string, source string, lang string, host long, score double")
    df.write.parquet(f"file://{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int").write.parquet(f"file://{tmp_path}/labels.parquet")
    got = sorted((r.doc_id, r.evidence, r.host_quality, r.path_quality, r.score, r["keep"]) for r in quality.query(spark, f"file://{tmp_path}").collect())
    want = sorted(brute_quality(docs, labels))
    assert len(got) == len(want)
    for g, w in zip(got, want):
        assert g[0] == w[0] and g[1:5] == pytest.approx(w[1:], abs=2e-6) and g[5] == (g[4] >= quality.KEEP)
