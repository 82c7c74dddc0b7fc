"""Each operator against brute force, the tokenizers' libraries or an exact round trip, on small and awkward inputs."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from glyphql.llm import decontaminate, exact_dedup, jaccard_join, language_id, piece_encoding, quality, secrets, suffix_dedup, token_counts, warc

public_tokenizers = pytest.importorskip("public_tokenizers")
BPE, PIECES = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
LONG = "Long wörds and numbers 123 " * 4000
DOCS = [
    (0, "The cat sat on the mat."), (1, "the CAT sat on the mat."), (2, None), (3, ""), (4, LONG), (5, "É\tñ 日本 😀\n\n  x<|endoftext|>y ▁z"), (6, "The cat sat on the mat."), (7, "\x00 \x1c\u0085 '"),
    (8, LONG + "tail"), (9, "!!! ???"),
]


@pytest.fixture(scope="module")
def docs(spark):
    """With columns whose names could clash with inner ones."""
    return spark.createDataFrame([(i, t, "en", i, "x") for i, t in DOCS], "doc_id long, text string, lang string, id long, n string")


def by_id(df, key="doc_id"):
    return {r[key]: r for r in df.collect()}


def lower(t):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")


# Token counts


ALPHABET = ["a", "the", " ", "  ", "\n", "\n\n", "\t", "'s", "'re", "'", "ll", "é", "ß", "日", "😀", "1", "²", "½", "_", "--", "===", "!", "<|endoftext|>", "<|endof", "ing", "Th", "\u0085", "\xa0", "\x1c", "́", "ː", "\x00", "٣"]


def test_token_counts_equal_the_library_at_every_prefix():
    from tokenizers import Tokenizer

    lib, own, rng = Tokenizer.from_file(BPE), token_counts.counter(BPE), random.Random(3)
    n = lambda s: len(lib.encode(s, add_special_tokens=False).ids)
    for _ in range(400):
        s = "".join(rng.choice(ALPHABET) for _ in range(rng.randint(0, 12)))
        want = [n(s[:k]) for k in range(len(s) + 1)]
        assert list(own.prefix_counts(s)) == want and own.count(s) == want[-1], s
        cut = own.cut(s, 3)
        assert want[cut] <= 3 and all(w > 3 for w in want[cut + 1 :])


def test_token_counts_query(docs, spark):
    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(BPE)
    got = by_id(token_counts.token_counts(docs, BPE))
    for i, t in DOCS:
        n = len(lib.encode(t or "", add_special_tokens=False).ids)
        assert (got[i].n_bytes, got[i].n_tokens, got[i].over_limit) == (len((t or "").encode()), n, n > 1024)
    assert token_counts.token_counts(docs.limit(0), BPE).count() == 0 and token_counts.token_counts(docs.unionAll(docs), BPE).count() == 20


# Suffix dedup


def brute_suffix(rows, length=50):
    least = {}
    for i, b in rows:
        for s in range(len(b) - length + 1):
            w = b[s : s + length]
            least[w] = min(least.get(w, 2**63), i)
    out = []
    for i, b in rows:
        hit = bytearray(len(b))
        for s in range(len(b) - length + 1):
            if least[b[s : s + length]] < i:
                hit[s : s + length] = b"\1" * length
        kept = bytes(x for x, h in zip(b, hit) if not h)
        out.append((i, len(b), sum(hit), sum(1 for k in range(len(hit)) if hit[k] and (not k or not hit[k - 1])), hashlib.sha256(kept).hexdigest()))
    return sorted(out)


def test_suffix_dedup_equals_brute_force(docs, spark):
    rng = random.Random(5)
    words = ["".join(rng.choice("abcdé") for _ in range(rng.randint(1, 8))) for _ in range(60)]
    passage = " ".join(rng.choice(words) for _ in range(30))
    texts = [(i, " ".join(rng.choice(words) for _ in range(rng.randint(0, 40))) + (passage[rng.randint(0, 60) :] if i % 2 else "") + "aab" * rng.randint(0, 40)) for i in range(60)]
    for rows in (texts, DOCS + [(6, "The cat sat on the mat." * 9), (20, "x\0y" * 30), (21, "x\0y" * 40), (22, "\0" * 120), (23, "\0" * 60), (24, "The cat sat on the mat." * 9)]):
        df = spark.createDataFrame(rows, "doc_id long, text string")
        assert sorted(map(tuple, suffix_dedup.removed(df).collect())) == brute_suffix([(i, (t or "").encode()) for i, t in rows])
    assert suffix_dedup.removed(docs.limit(0)).count() == 0


def shared_line_texts(n=40):
    rng = random.Random(9)
    noise = lambda k: "".join(rng.choice("abcdefgh ") for _ in range(k))
    line = "This very common line stands in every document, with other surroundings in each one of them."
    return [(i, noise(rng.randint(0, 90)) + line + noise(rng.randint(0, 90)) + (line[:70] if i % 3 == 0 else "")) for i in range(n)]


@pytest.mark.parametrize("setting", ["hot", "files", "parts"])
def test_suffix_dedup_of_hot_anchors_small_files_and_parts(spark, monkeypatch, setting):
    """Splitting anchors by windows, several files of a task, and texts in parts change nothing."""
    rows = shared_line_texts()
    if setting == "hot":
        hot = suffix_dedup._shared_hashes

        def marked(runs):  # the limit travels to the workers with the function
            from pyspark.sql.functions import lit

            return hot(runs).withColumn("hot", lit(b"\xff" * 4096))

        monkeypatch.setattr(suffix_dedup, "_shared_hashes", marked)
    if setting == "parts":
        monkeypatch.setattr(suffix_dedup, "_parts", lambda offsets, length: parts_of(offsets, length))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    if setting == "files":
        spark.conf.set("spark.sql.files.maxRecordsPerFile", "3")
    try:
        got = sorted(map(tuple, suffix_dedup.removed(df).collect()))
    finally:
        spark.conf.unset("spark.sql.files.maxRecordsPerFile")
    assert got == brute_suffix([(i, t.encode()) for i, t in rows]) and sum(r[2] for r in got) > 39 * 90


def parts_of(offsets, length):
    """Every text for itself, in parts of 64 bytes that overlap by a window less one byte."""
    import numpy as np

    for i in range(len(offsets) - 1):
        a, b = int(offsets[i]), int(offsets[i + 1])
        for at in range(a, max(a + 1, b - length + 1), 64):
            yield np.array([at, min(b, at + 64 + length - 1)]), np.array([i]), np.array([at - a])


def test_suffix_dedup_returns_spans_and_all_columns(spark):
    rows = [(i, t, i, "x", None) for i, t in shared_line_texts(12)] + [(50, None, 1, "y", None), (None, "z" * 60, 2, "z", 1), (33, "z" * 60, 3, "z", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, file long, rest string, row int")
    got = suffix_dedup.clean(df).collect()
    assert suffix_dedup.clean(df).columns == [*df.columns, "spans"] and len(got) == len(rows)
    with pytest.raises(ValueError, match="spans"):
        suffix_dedup.clean(df.withColumnRenamed("row", "spans"))
    key = lambda i: 2**62 if i is None else i
    want = {(i, n, digest) for i, _, n, _, digest in brute_suffix([(key(i), (t or "").encode()) for i, t, *_ in rows])}
    for r in got:
        raw = next(t for i, t, f, *_ in rows if (i, f) == (r.doc_id, r.file))
        kept = suffix_dedup.cut_out((raw or "").encode(), [tuple(x) for x in r.spans])
        assert (key(r.doc_id), sum(x.end - x.start for x in r.spans), hashlib.sha256(kept).hexdigest()) in want
        assert r.text is None if raw is None else kept == bytes(r.text)


def test_suffix_dedup_of_parts_of_long_texts(spark, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "PART_BYTES", 1 << 10)
    offsets = suffix_dedup.np.array([0, 3000])
    parts = list(suffix_dedup._parts(offsets, 50))
    starts = [int(o[0]) for o, _, _ in parts]
    assert starts == [0, 1024, 2048] and all(b - a - (k < 2) * 49 <= 1024 for k, (a, b) in enumerate((int(o[0]), int(o[-1])) for o, _, _ in parts))


def test_loser_tree_merges_with_shared_lengths():
    rng = random.Random(1)
    for k in (1, 2, 3, 7):
        runs = [sorted(bytes(rng.choice(b"ab") for _ in range(rng.randint(0, 6))) for _ in range(rng.randint(0, 20))) for _ in range(k)]
        common = lambda a, b: next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
        coded = [(r, [0] + [common(a, b) for a, b in zip(r, r[1:])]) for r in runs]
        order, shared = suffix_dedup.merge_runs([(s, n[: len(s)]) for s, n in coded])
        out = [runs[r][p] for r, p in order]
        assert out == sorted(x for r in runs for x in r) and shared[1:] == [common(a, b) for a, b in zip(out, out[1:])]


# Secrets


def brute_secrets(t):
    spans = []
    for m in re.finditer(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", t, re.I | re.A):
        if len(m[2]) >= 12:
            spans.append((m.start(), 0, m.end()))
    n0 = len(spans)
    spans += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 18]
    n1 = len(spans) - n0
    spans += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 16]
    joined = ",".join(f"{('assign', 'access', 'hex')[k]}:{a}:{b}" for a, k, b in sorted(spans))
    return n0, n1, len(spans) - n0 - n1, hashlib.sha256(joined.encode()).hexdigest()


def test_secrets_equal_brute_force_and_models_add_spans(spark):
    rng = random.Random(2)
    b64 = "".join(rng.choice(secrets.ALPHABET[:62]) for _ in range(40))
    texts = [
        "password: token: abcdefghijklmnop😀 api_key='é' secret=aaaaaaaaaaaa", None, "", "x" * 100 + "AKIAAKIA" + "B" * 20 + " deadbeefdeadbeef00", 'TOKEN = "abc' + "d" * 30_000 + '"', f"see {b64} here",
        "thisisaverylongordinaryidentifiername in text", "token==abcdefghijkl passwd=short PassWord:'0123456789ab", "AKIA" + "A" * 13 + "b AKIA" + "A" * 14,
    ] + [f"word some ordinary identifiers in_words number {k} token={''.join(rng.choice(secrets.ALPHABET[:62]) for _ in range(24))}" for k in range(40)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    ratios = secrets.train(df)
    got = by_id(secrets.scan(df, ratios))
    for i, t in enumerate(texts):
        assert (got[i].n_assign, got[i].n_access, got[i].n_hex, got[i].base_sha256) == brute_secrets(t or ""), t
    assert got[5].spans == "markov:4:44" and got[6].spans == ""
    clean = by_id(secrets.redact(df, ratios))
    assert clean[5].text == "see [SECRET] here" and clean[1].text is None and clean[6].text == texts[6]
    empty = df.limit(0)
    assert secrets.scan(empty, secrets.train(empty)).count() == 0


ORDINARY = [
    "-" * 32, "=" * 25, "_" * 40, "/" * 16, "2023-01-05T10-00-00-report-final", "src/main/java/com/example/App", "usr/local/lib/python3/site-packages", "internationalization", "my_long_variable_name_2",
    "getElementByIdentifier", "SOME_CONSTANT_VALUE", "20230105123456", "+49-30-1234567", "a-b-c-d-e-f-g-h", "version-1-2-3-beta", "HelloWorldExample123", "image-2023-final-v2", "Donaudampfschifffahrt", "aaaaaaaaaaaaaaaa",
]


def test_secret_models_equal_brute_force_and_tell_random_from_ordinary(spark):
    rng, place = random.Random(7), {c: k + 1 for k, c in enumerate(secrets.ALPHABET)}
    df = spark.createDataFrame([(1, "some ordinary words of a text"), (2, None)], "doc_id long, text string")
    ratios = secrets.train(df)
    ratio = lambda t: sum(ratios[place.get(a, 0) * (len(place) + 1) + place.get(b, 0)] for a, b in zip(t, t[1:]))
    alphabets = [secrets.ALPHABET[:26], secrets.ALPHABET[:62], secrets.ALPHABET[:64], secrets.ALPHABET[26:62], "0123456789abcdef"]
    keys = [["".join(rng.choice(a) for _ in range(n)) for _ in range(60)] for a in alphabets for n in (12, 13, 16, 24)]
    tokens = [*ORDINARY, *(k for some in keys for k in some), "=" * 11, "X" * 5000]
    got = by_id(secrets.scan(spark.createDataFrame(list(enumerate(f"é {t} ." for t in tokens)), "doc_id long, text string"), ratios))
    for i, t in enumerate(tokens):
        base = re.search("[0-9a-f]{16}|AKIA[A-Z0-9]{14}", t)
        want = len(t) >= 12 and not base and ratio(t) >= secrets.LEAST_RATIO
        assert abs(ratio(t) - secrets.LEAST_RATIO) < 1e-6 or ("markov" in got[i].spans) == want, t
    assert not any("markov" in got[i].spans for i in range(len(ORDINARY)))
    at = len(ORDINARY)
    for some in keys:  # recall of every alphabet and length
        assert sum(got[k].spans != "" for k in range(at, at + 60)) >= 54, some[:3]
        at += 60


def test_secrets_of_long_texts_repeated_rows_and_clashing_columns(spark):
    many = "".join(f"deadbeefdeadbee{k % 10} token={'k' * 12}{k} " for k in range(1500))
    df = spark.createDataFrame([(1, many, "a", "b"), (1, many, "a", "b"), (2, None, "x", "y")], "doc_id long, text string, _base0 string, spans string")
    got = secrets.scan(df, secrets.train(df)).collect()
    assert len(got) == 3 and sum((r.n_assign, r.n_access, r.n_hex, r.base_sha256) == brute_secrets(many) for r in got) == 2
    assert secrets.redact(df.where("doc_id = 2"), [0.0] * (len(secrets.ALPHABET) + 1) ** 2).columns == df.columns


# Jaccard join


def brute_components(rows, words, percent):
    sets = {}
    for i, t in rows:
        w = re.findall("[^\x20\x09-\x0d]+", lower(t))
        sets[i] = {tuple(w[k : k + words]) for k in range(len(w) - words + 1)} if len(w) >= words else {tuple(w)} if w else set()
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    held = defaultdict(list)
    for i, s in sets.items():
        common = Counter(j for g in s for j in held[g])
        for j, n in common.items():
            if 100 * n >= percent * (len(s) + len(sets[j]) - n):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
        for g in s:
            held[g].append(i)
    return sorted((i, len(s), find(i)) for i, s in sets.items())


@pytest.mark.parametrize("words, percent", [(3, 90), (5, 80)])
def test_jaccard_join_equals_brute_force(spark, words, percent):
    rng = random.Random(7)
    vocabulary = [f"w{k}" for k in range(80)]
    texts = []
    for family in range(6):
        base = [rng.choice(vocabulary) for _ in range(60)]
        for _ in range(rng.randint(1, 9)):
            own = list(base)
            for _ in range(rng.randint(0, 3)):
                own[rng.randrange(len(own))] = rng.choice(vocabulary)
            texts.append(" ".join(own) + " " + " ".join(vocabulary[:5]))
    rows = list(enumerate([*texts, None, "", "one", "ONE", "one two", " \n", "é É", texts[0].upper()]))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(map(tuple, jaccard_join.similar_components(df, words=words, percent=percent).collect())) == brute_components(rows, words, percent)


@pytest.mark.parametrize("block", [3, 20, 1024])
def test_remaining_pairs_equal_brute_force_however_lists_are_dealt(spark, monkeypatch, block):
    monkeypatch.setattr(jaccard_join, "BLOCK", block)
    rng = random.Random(block)
    rows, lists = [], defaultdict(list)
    for i in range(120):
        component = 0 if i < 50 else i if i < 90 else 90 + i % 7
        n = rng.randint(20, 40)
        marks = [rng.getrandbits(63) * rng.choice([1, -1])] * jaccard_join.SIGNATURE if i % 3 else [0] * jaccard_join.SIGNATURE
        for pos, tok in enumerate(sorted(rng.sample(range(9), 5))):
            rows.append((tok - 20, i, n, pos, i, component, *(marks if i % 5 else [None] * jaccard_join.SIGNATURE)))
            lists[tok].append((i, n, pos, component, marks, i % 5))
    want = set()
    for held in lists.values():
        for a, an, ap, ac, am, ak in held:
            for b, bn, bp, bc, bm, bk in held:
                differ = sum(((x ^ y) & (2**64 - 1)).bit_count() for x, y in zip(am, bm, strict=True)) if ak and bk else 0
                if a < b and ac != bc and min(an - ap, bn - bp) * 180 >= (an + bn) * 80 and (an + bn - differ) * 180 >= 160 * (an + bn):
                    want.add((a, b))
    schema = "tok long, cls long, n int, pos int, src long, component long, " + ", ".join(f"{m} long" for m in jaccard_join.MARKS)
    got = [tuple(sorted(r)) for r in jaccard_join._remaining(spark.createDataFrame(rows, schema), 80).collect()]
    assert len(want) > 100 and sorted(got) == sorted(want)  # each pair once


def test_jaccard_join_equals_brute_force_in_small_cells(spark, monkeypatch):
    monkeypatch.setattr(jaccard_join, "BLOCK", 4)
    rng = random.Random(3)
    base = [f"w{rng.randrange(300)}" for _ in range(60)]
    texts = [" ".join(f"x{rng.randrange(300)}" if rng.random() < 0.04 else w for w in base) for _ in range(60)]
    rows = list(enumerate([*texts, texts[0], None]))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(map(tuple, jaccard_join.similar_components(df, words=5, percent=80).collect())) == brute_components(rows, 5, 80)


def test_a_family_is_linked_by_few_pairs_for_each_member(spark, monkeypatch):
    rng = random.Random(12)
    base = [f"w{k}" for k in range(300)]
    texts = [" ".join(f"x{rng.randrange(10**6)}" if rng.random() < 0.011 else w for w in base) for _ in range(240)]
    rows = list(enumerate(texts))
    made, verify = [], jaccard_join._verify
    monkeypatch.setattr(jaccard_join, "_verify", lambda pairs, *rest: made.append(verify(pairs, *rest)) or made[-1])
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(map(tuple, jaccard_join.similar_components(df, words=5, percent=80).collect()))
    assert got == brute_components(rows, 5, 80) and sum(m.count() for m in made) < 3 * len(rows)


def test_spanning_forest_joins_what_its_edges_join():
    rng = np.random.default_rng(4)
    for _ in range(200):
        n, m = rng.integers(1, 12), rng.integers(0, 40)
        u, v, weight = rng.integers(0, n, m), rng.integers(0, n, m), rng.integers(0, 4, m) / 3
        root, want = list(range(n)), []
        for k in np.argsort(weight, kind="stable"):
            if root[u[k]] != root[v[k]]:
                want.append(k)
                root = [root[u[k]] if r == root[v[k]] else r for r in root]
        assert sorted(jaccard_join.spanning_forest(u, v, weight)) == sorted(want)


def test_jaccard_join_edges(docs, spark):
    assert jaccard_join.similar_components(docs.limit(0)).count() == 0
    kept = jaccard_join.keep_one(docs)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == [0, 2, 3, 4, 5, 7, 9]


# Exact dedup


def test_exact_dedup(docs, spark):
    got = by_id(exact_dedup.classes(docs))
    assert (got[0].keep_id, got[0].group_size, got[0].kept, got[6].kept) == (6, 3, False, True) and got[2].keep_id == 3 and got[5].kept
    assert all(got[i].text_sha256 == hashlib.sha256(lower(t).encode()).hexdigest() for i, t in DOCS)
    kept = exact_dedup.keep(docs)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == [3, 4, 5, 6, 7, 8, 9]
    assert exact_dedup.classes(docs.limit(0)).count() == 0
    twice = exact_dedup.classes(docs.unionAll(docs.where("doc_id = 6"))).where("doc_id = 6").collect()
    assert [(r.group_size, r.kept) for r in twice] == [(4, True)] * 2


def test_exact_dedup_keeps_one_row_of_each_text_whatever_the_ids(spark):
    rows = [(1, "a", "x"), (2, "A", "y"), (2, "b", "x"), (3, "b", "z"), (2, "a", "y"), (None, "c", "x"), (None, "C", "y"), (None, "b", "x"), (None, None, "x"), (4, "e", "x"), (4, "e", "x")]
    kept = exact_dedup.keep(spark.createDataFrame(rows, "doc_id long, text string, _sha string")).collect()
    assert sorted(((r.doc_id or 0, lower(r.text)) for r in kept)) == [(0, ""), (0, "c"), (2, "a"), (3, "b"), (4, "e")]
    assert all((r.doc_id, r.text, r._sha) in rows for r in kept)


# Language ID


def test_language_id(spark):
    en, de = "the cat and the dog went to the house with their friends", "der Hund und die Katze gehen über die Straße nach Hause"
    rows = [(k, t * (1 + k % 3), lang) for k, (t, lang) in enumerate([(en, "en"), (de, "de")] * 10)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    profiles = language_id.train(df)
    new = spark.createDataFrame([(1, "the friends and the house"), (2, "die Katze und der Hund"), (3, None), (4, "123 !?"), (5, ""), (6, "日本"), (7, en * 3000)], "doc_id long, text string")
    got = {r.doc_id: (r.lang_pred, r.score) for r in language_id.predict(new, profiles).collect()}
    assert [got[k][0] for k in (1, 2, 3, 4, 5, 7)] == ["en", "de", "und", "und", "und", "en"] and all(0 <= s <= 1 for _, s in got.values()) and got[6][1] == 0
    assert sorted(r.doc_id for r in language_id.keep_known(new, profiles, least_score=0.1).collect()) == [1, 2, 7]
    assert language_id.train(df.limit(0)) == {} and language_id.predict(new, {}).where("lang_pred <> 'und'").count() == 0 and language_id.predict(new.limit(0), profiles).count() == 0


def test_ngram_counts_agree():
    x = language_id.symbols("Äbc, def! abc 日本")
    one, two = language_id.count_ngrams(x), Counter(language_id.ngrams(x).tolist())
    assert dict(zip(one[0].tolist(), one[1].tolist())) == two


# Decontamination


def brute_hits(texts, items, window=10):
    words = lambda t: re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", lower(t))
    wins = defaultdict(set)
    for i, t in items:
        w = words(t)
        n = min(window, len(w))
        if n:
            for k in range(len(w) - n + 1):
                wins[tuple(w[k : k + n])].add(str(i))
    out = {}
    for d, t in texts:
        w, hit, found = words(t), set(), set()
        for n in {len(g) for g in wins}:
            for k in range(len(w) - n + 1):
                if g := wins.get(tuple(w[k : k + n])):
                    hit |= set(range(k, k + n))
                    found |= g
        out[d] = (len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit))
    return out


@pytest.mark.parametrize("chunk", [8 << 20, 40])
def test_decontamination_equals_brute_force(spark, monkeypatch, chunk):
    monkeypatch.setattr(decontaminate, "ITEM_BYTES", chunk)
    rng = random.Random(4)
    v = [f"w{k}" for k in range(12)]
    items = [(k, " ".join(rng.choice(v) for _ in range(rng.randint(0, 16)))) for k in range(12)] + [(90, None), (91, "solo"), (92, "é-é"), (93, "solo")]
    texts = [(k, " ".join(rng.choice(v) for _ in range(rng.randint(0, 60))) + ("," + items[k % 12][1] if k % 3 else "")) for k in range(30)] + [(100, None), (101, ""), (102, "SOLO Solo x"), (103, "É é É")]
    d, b = spark.createDataFrame(texts, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    got = {r.doc_id: (r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in decontaminate.hits(d, b).collect()}
    assert got == brute_hits(texts, items)


def test_decontamination_cut(docs, spark):
    item = "one two three four five six seven eight nine ten eleven"
    d = spark.createDataFrame([(1, f"Keep Ä; {item.upper()}! rest", "x"), (2, "clean text", "y"), (3, None, "z")], "doc_id long, text string, items string")
    b = spark.createDataFrame([(7, item)], "item_id long, text string")
    assert [tuple(r) for r in decontaminate.clean(d, b).orderBy("doc_id").collect()] == [(1, "Keep Ä; ! rest", "x"), (2, "clean text", "y"), (3, None, "z")]
    assert decontaminate.clean(d, b, most_words=50, most_share=0.9).where("doc_id = 1").first().text.count("TWO") == 1
    assert decontaminate.hits(docs, b.limit(0)).where("contaminated").count() == 0 and decontaminate.hits(d.limit(0), b).count() == 0


def test_stages_make_small_batches_of_large_ones(spark, monkeypatch):
    """Spark sends 10,000 rows at once: what a stage makes of them may not be as large, and no row may be lost or moved."""
    import pyarrow as pa

    item = "one two three four five six seven eight nine ten"
    texts = [None if k % 50 == 7 else "" if k % 50 == 8 else f"{k} " + "Straße und Haus " * 60 + (item if k % 3 else "") for k in range(2000)] + ["long " * 200_000]
    docs = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id long, text string")
    b = spark.createDataFrame([(1, item)], "item_id long, text string")
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts)), pa.int64()), pa.array(texts, pa.string())], ["doc_id", "text"])
    stages = []
    monkeypatch.setattr(type(docs), "mapInArrow", lambda self, f, schema, *a: stages.append(f) or self)
    decontaminate.clean(docs, b)
    language_id.keep_known(docs, {"de": [ord(c) for c in "enist"]})
    piece_encoding.encode_documents(docs, PIECES)
    cleaned, known, encoded = ([out for out in f(iter([batch, batch.slice(0, 0)]))] for f in stages)
    for got in (cleaned, known, encoded):
        assert max(len(out) for out in got) < 500 and all(out.slice(1).get_total_buffer_size() < 4 << 20 for out in got)
    assert sum((out.column(0).to_pylist() for out in cleaned), []) == sum((out.column(0).to_pylist() for out in encoded), []) == list(range(len(texts)))
    assert sum((out.column(1).to_pylist() for out in cleaned), []) == [t and t.replace(item, "") for t in texts]
    assert sum((out.column(0).to_pylist() for out in known), []) == [k for k, t in enumerate(texts) if t]


# Pieces


def test_pieces_equal_the_library(docs, spark):
    import sentencepiece

    lib, own, rng = sentencepiece.SentencePieceProcessor(model_file=PIECES), piece_encoding.model(PIECES), random.Random(6)
    pool = [*ALPHABET, "▁", "<s>", "</s>", "<0x0A>", "a" * 40, " " * 20, "﻿"]
    for _ in range(1500):
        s = "".join(rng.choice(pool) for _ in range(rng.randint(0, 12)))
        ids = lib.encode(s, add_eos=True)
        joined, n, back, _ = own.encode_fast(s)
        assert [int(x) for x in joined.split()] + [2] == ids and n + 1 == len(ids) and back == lib.decode(ids) == own.decode(ids), s
        spans = own.encode(s)
        assert [x[0] for x in spans] + [2] == ids and all(a <= b for _, a, b in spans) and (not s or spans[-1][2] == len(s.encode()))
    got = by_id(piece_encoding.encode_documents(docs, PIECES))
    for i, t in DOCS:
        ids = lib.encode(t or "", add_eos=True)
        assert (got[i].n_tokens, got[i].ids_sha256, got[i].decoded_sha256, got[i].n_span_bytes) == (
            len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(lib.decode(ids).encode()).hexdigest(), len((t or "").encode()))
    assert piece_encoding.encode_documents(docs.limit(0), PIECES).count() == 0


def test_piece_spans_equal_the_library(docs, spark):
    import sentencepiece

    lib, own, rng = sentencepiece.SentencePieceProcessor(model_file=PIECES), piece_encoding.model(PIECES), random.Random(16)

    def spans(text):
        """The library's offsets, in bytes; of the bytes of one character it gives the span to the last one alone."""
        out = []
        for p in reversed(lib.encode(text, return_type="proto").pieces):
            out.append((p.begin, out[-1][1] if out and lib.is_byte(p.id) and p.begin == p.end else p.end))
        return out[::-1]

    pool = [*ALPHABET, "▁", "<s>", "a" * 40, " " * 20, "﻿"]
    texts = ["".join(rng.choice(pool) for _ in range(rng.randint(0, 12))) for _ in range(600)]
    for t in [*texts, *(t or "" for _, t in DOCS)]:
        assert [x[1:] for x in own.encode(t)] == spans(t), t
    digests, full = by_id(piece_encoding.encode_documents(docs, PIECES)), by_id(piece_encoding.encode_texts(docs, PIECES))
    for i, t in DOCS:
        want = spans(t or "")
        assert digests[i].spans_sha256 == hashlib.sha256(np.array(want, "<u4").tobytes()).hexdigest()
        assert (full[i].ids, list(zip(full[i].starts, full[i].ends)), full[i].decoded) == (lib.encode(t or ""), want, lib.decode(lib.encode(t or "")))


@pytest.mark.parametrize("levels", [0, 1, 7])
def test_stretches_merged_together_equal_each_merged_alone(levels):
    """Against the pairwise loop and the heap; with scores of few levels equal ones decide, the leftmost first."""
    m, rng = piece_encoding.PieceModel(PIECES), random.Random(26)
    if levels:
        m.score = {p: -float(k * 31 % levels) for k, p in enumerate(m.score)}
        m.merges = piece_encoding._Merges(m)
    pools = ["abcdehinorst", "▁ethnorasi", "aé" + chr(0x4E00) + chr(0x1F600) + chr(0x10FFFF) + chr(0xAC01) + "e", "ab", "0123456789.,;:=-", "\0\t\x7f\n▁"]
    stretches = {"".join(rng.choice(pool) for _ in range(rng.choice([1, 2, 3, 5, 9, 17, 24, 25, 47, 48, 49, 90]))) for pool in pools for _ in range(400)}
    m.memo.learn(stretches)
    assert set(m.memo) == stretches
    for s in stretches:
        ids = [i for symbol in m.merge(s) for i in m.symbol_ids(symbol)]
        taken = [k for symbol in m.merge(s) for k in [0] * (len(m.symbol_ids(symbol)) - 1) + [len(symbol)]]
        assert m.memo[s] == (" ".join(map(str, ids)), m.surface(ids), np.array(taken, np.uint32).tobytes()), s
    m.memo.learn(set())
    m.memo.learn(stretches)
    assert len(m.memo) == len(stretches)


def test_new_words_cost_less_than_merging_each(spark, monkeypatch):
    """Most words of large tables are seen a few times: encoding texts of new words may not merge them one by one."""
    import pyarrow as pa
    import sentencepiece
    from time import process_time

    rng, stages = random.Random(27), []
    parts = ["th", "en", "er", "on", "an", "re", "ha", "es", "st", "ing", "ou", "ti"]
    texts = [" ".join("".join(rng.choice(parts) for _ in range(rng.randint(5, 9))) for _ in range(200)) for _ in range(150)]
    own, docs = piece_encoding.PieceModel(PIECES), spark.createDataFrame([(1, "")], "doc_id long, text string")
    monkeypatch.setitem(piece_encoding._MODELS, PIECES, own)
    monkeypatch.setattr(type(docs), "mapInArrow", lambda self, f, schema, *a: stages.append(f) or self)
    piece_encoding.encode_documents(docs, PIECES)
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts)), pa.int64()), pa.array(texts, pa.string())], ["doc_id", "text"])
    began = process_time()
    got = [digest for out in stages[0](iter([batch])) for digest in out.column(2).to_pylist()]
    together = process_time() - began
    assert not own.memo  # a worker lives on for tasks of other operators
    lib = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    assert got == [hashlib.sha256(" ".join(map(str, lib.encode(t, add_eos=True))).encode()).hexdigest() for t in texts]
    words = {"▁" + w for t in texts for w in t.split()}
    began = process_time()
    for w in words:
        own.merge(w)
    assert together < 0.7 * (process_time() - began)


@pytest.mark.parametrize("rule", ["nmt_nfkc", "nfkc_cf"])
def test_character_maps(rule):
    import sentencepiece
    from sentencepiece import sentencepiece_model_pb2 as pb

    lib = sentencepiece.SentencePieceNormalizer(rule_name=rule, add_dummy_prefix=False, remove_extra_whitespaces=False, escape_whitespaces=False)
    spec = pb.ModelProto()
    spec.ParseFromString(lib.serialized_model_proto())
    m, rng = piece_encoding.PieceModel(PIECES), random.Random(8)
    m.chars, m.dummy_prefix = piece_encoding.CharMap(spec.normalizer_spec.precompiled_charsmap), False
    for _ in range(300):
        s = "".join(rng.choice([*ALPHABET, "ﬁ", "①", "Ａ", "ｶﾞ", "İ", "각"]) for _ in range(rng.randint(0, 10)))
        out = m.normalise(s)
        assert out.text.replace("▁", " ") == lib.normalize(s).replace("▁", " ") and len(out.source) == len(out.text) + 1 and sorted(out.source) == out.source


# Quality


def test_quality_on_held_out_labels(spark):
    rng = random.Random(9)
    rows, labels = [], []
    for k in range(600):
        good = k % 3 > 0
        text = " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 7))) for _ in range(60)) + "." if good else "###!!! " * rng.randint(20, 60)
        rows.append((k, text, f"h{k % 5}" if k % 7 else None, "en"))
        labels.append((k, int(good)))
    docs, known = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string"), spark.createDataFrame(labels, "doc_id long, quality int")
    got = quality.posterior(docs, known.where("doc_id % 2 = 0")).join(known, "doc_id").where("doc_id % 2 = 1")
    assert got.where(F.col("keep") == (F.col("quality") == 1)).count() >= 0.95 * got.count()
    none = quality.posterior(docs, known.limit(0))
    assert none.count() == 600 and none.where("score between 0 and 1").count() == 600
    odd = spark.createDataFrame([(1, None, None, None), (1, "", "h", "en"), (2, LONG, "h", None)], docs.schema)
    assert quality.posterior(odd, known).count() == 3 and quality.posterior(docs.limit(0), known).count() == 0


# WARC


def test_warc(spark, tmp_path):
    rows = [(1, "http://a\r\nX: y", "é"), (2, "u2", "same"), (3, None, "same"), (4, "u4", None), (5, "u5", ""), (6, "u6", "x" * 300_000), (2, "u2", "same"), (None, "n", "same")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = sorted(map(tuple, warc.archive_and_read(df).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()), key=str)
    first = {"same": 2, "": 4}
    want = []
    for i, _, h in rows:
        h = h or ""
        again = h in first and i != first[h]
        want.append((i, len(h.encode()), warc.payload_digest(h.encode()), "revisit" if again else "response", first[h] if again else None))
    assert got == sorted(want, key=str)
    large = warc.archive_and_read(df, least_bytes=10)
    assert large.where("record_type = 'revisit'").count() == 0 and warc.archive_and_read(df.limit(0)).count() == 0


def test_warc_parts():
    import gzip
    import zlib

    raw = [warc.record(k, f"u{k}", b"p" * k, None) for k in range(5)]
    whole = b"".join(raw)
    for packed in (gzip.compress(whole), b"".join(map(gzip.compress, raw))):
        chunks = [packed[k : k + 7] for k in range(0, len(packed), 7)]
        assert list(warc.records_of(warc.inflated(iter(chunks)))) == raw
    with pytest.raises(EOFError):
        list(warc.inflated(iter([gzip.compress(whole)[:-9]])))
    with pytest.raises(ValueError):
        list(warc.records_of(iter([whole[:-3]])))
    assert zlib and warc.parse(warc.record(1, None, b"ab", 7))[0]["warc-type"] == "revisit"
