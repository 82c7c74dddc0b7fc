"""Document quality by hierarchical empirical Bayes.

A document's own evidence is a naive Bayes sum over binned features of its text, learned from the labelled documents and
calibrated to log-odds. A site is a host, and a path within it (here: ``source``, and the language section of a source).
Every site's quality is estimated from all its documents, labels where there are any and calibrated evidence elsewhere:
hosts are shrunk toward the global mean and paths toward their host, as strongly as the spread between sites suggests.
A document's posterior joins its evidence with the quality of the rest of its path.

Only counts of (feature, bin, label), of evidence bins, and moments of sites reach the driver; each has a fixed bound. Site
tables stay in the cluster and are joined to the documents by an ordinary equi-join.

Defined results: null and empty texts are one empty word on one line, with shares of 0; a null host or path is a site of its own; without
labels of both kinds all evidence is 0 and every score the prior mean; a document with several labels counts as the mean
of them; labels of unknown documents are ignored; repeated rows count and are scored each for itself; an empty table gives
an empty result; other columns are neither read nor returned.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialise, table

#: Below this score a document goes: low, as a wrongly rejected document is lost for good.
KEEP = 0.25
#: Bins of every feature.
BINS = 24


def _share(part: Column, whole: Column, scale: float) -> Column:
    return F.least(F.lit(BINS - 1), F.floor(F.coalesce(F.try_divide(part, whole), F.lit(0.0)) * scale)).cast("int")  # least passes over nulls


def features(text: Column) -> dict[str, Column]:
    """Binned features of a text, by name."""
    words = F.split(F.trim(text), r"\s+")
    lines = F.split(text, "\n")
    n, n_words = F.char_length(text), F.size(words)
    without = lambda pattern: n - F.char_length(F.regexp_replace(text, pattern, ""))
    log_words = F.floor(F.log2(n_words + 1) / 2)
    return {
        "symbols": _share(without(r"[^\p{L}\p{N}\s.,]+"), n, 60.0),
        "capitals": _share(without(r"\p{Lu}+"), n, 40.0),
        "digits": _share(without(r"[0-9]+"), n, 60.0),
        "word_length": _share(n, n_words, 1.5),
        "repeated_lines": _share(F.size(lines) - F.size(F.array_distinct(lines)), F.size(lines), 24.0),
        # Longer texts repeat more words: the share is told apart by the length's magnitude.
        "repeated_words": F.coalesce(F.least(F.lit(BINS - 1), F.floor(F.try_divide(n_words - F.size(F.array_distinct(words)), n_words) * 12)) + BINS * log_words, F.lit(0)).cast("int"),
        "words": F.coalesce(F.least(F.lit(BINS - 1), F.floor(F.log2(n_words + 1) * 2)), F.lit(0)).cast("int"),
    }


def _table_of(ratios: dict[int, float], bin_col: Column) -> Column:
    if not ratios:
        return F.lit(0.0)
    return F.coalesce(F.element_at(F.create_map(*(F.lit(x) for kv in sorted(ratios.items()) for x in kv)), bin_col), F.lit(0.0))


def evidence(rows: DataFrame, names: list[str]) -> Column:
    """The naive Bayes log-likelihood ratio of good over bad, from ``quality`` where it is known."""
    known = rows.where("quality is not null")
    pairs = known.select("quality", F.explode(F.array(*(F.struct(F.lit(f).alias("f"), F.col(f).alias("b")) for f in names))).alias("x"))
    counts = pairs.groupBy("x.f", "x.b").agg(F.sum("quality").alias("good"), F.sum(1 - F.col("quality")).alias("bad")).collect()  # features x bins
    total = F.lit(0.0)
    for f in names:
        own = [r for r in counts if r["f"] == f]
        good, bad = sum(r["good"] for r in own), sum(r["bad"] for r in own)
        if not good or not bad:
            continue
        k = len(own)
        total = total + _table_of({r["b"]: math.log((r["good"] + 1) / (good + k)) - math.log((r["bad"] + 1) / (bad + k)) for r in own}, F.col(f))
    return total


def calibrate(points: list[tuple[float, float, float]]) -> tuple[float, float]:
    """Intercept and slope of a logistic curve through (x, good, n), by Newton steps with a weak prior on the slope."""
    if not points or not 0 < sum(g for _, g, _ in points) < sum(n for _, _, n in points):
        return 0.0, 0.0
    a, b = 0.0, 0.5
    for _ in range(50):
        ga = gb = 0.0
        haa, hab, hbb = 1e-6, 0.0, 1e-3
        for x, g, n in points:
            p = 1 / (1 + math.exp(-max(-30.0, min(30.0, a + b * x))))
            ga, gb = ga + g - n * p, gb + (g - n * p) * x
            w = n * p * (1 - p)
            haa, hab, hbb = haa + w, hab + w * x, hbb + w * x * x
        gb -= 1e-3 * b
        d = haa * hbb - hab * hab
        da, db = (hbb * ga - hab * gb) / d, (haa * gb - hab * ga) / d
        step = min(1.0, 2.0 / max(abs(da), abs(db), 1e-12))
        a, b = a + step * da, b + step * db
        if max(abs(da), abs(db)) < 1e-9:
            break
    return a, b


def _strength(sites: DataFrame, s: str, n: str, mean: str | float) -> float:
    """The weight of the prior in documents, by the method of moments: how far site means differ beyond chance."""
    m = F.col(mean) if isinstance(mean, str) else F.lit(mean)
    d = F.try_divide(F.col(s), F.col(n)) - m
    r = sites.where(F.col(n) > 1).agg(
        F.sum(F.col(n) * d * d).alias("spread"), F.sum(m * (1 - m)).alias("chance"), F.sum(F.col(n)).alias("n"), F.sum(F.col(n) * m * (1 - m)).alias("scale")
    ).first()
    if not r["n"] or not r["scale"]:
        return 100.0
    between = max((r["spread"] - r["chance"]) / r["scale"], 1e-4)  # as a share of the variance of one document
    return min(10_000.0, max(2.0, 1 / between - 1))


def posterior(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", path_col: str = "lang", label_col: str = "quality", keep: float = KEEP) -> DataFrame:
    """id, ``evidence`` (calibrated log-odds), ``host_quality``, ``path_quality``, ``score``, ``keep`` of every row."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    made = features(text)
    known = labels.where(F.col(label_col).isNotNull()).groupBy(F.col(id_col).alias("_label_id")).agg(F.avg(label_col).cast("double").alias("quality"))
    rows = docs.select(F.col(id_col).alias("id"), F.col(host_col).alias("host"), F.col(path_col).alias("path"), *(c.alias(k) for k, c in made.items()))
    rows = materialise(rows.join(known, F.col("id") == F.col("_label_id"), "left").drop("_label_id"), "features")

    raw = rows.withColumn("raw", evidence(rows, list(made)))
    bins = raw.where("quality is not null").groupBy(F.greatest(F.lit(-160), F.least(F.lit(160), F.floor(F.col("raw") * 4))).alias("b")).agg(F.sum("quality").alias("g"), F.count(F.lit(1)).alias("n"))
    a, b = calibrate([(r["b"] / 4 + 0.125, r["g"], r["n"]) for r in bins.orderBy("b").collect()])  # 321 bins at most
    logit = F.greatest(F.lit(-12.0), F.least(F.lit(12.0), F.lit(a) + F.lit(b) * F.col("raw")))
    soft = F.coalesce(F.col("quality"), 1 / (1 + F.exp(-F.col("evidence"))))
    scored = raw.withColumn("evidence", logit).withColumn("soft", soft)

    paths = materialise(scored.groupBy("host", "path").agg(F.sum("soft").alias("path_s"), F.count(F.lit(1)).alias("path_n")), "paths")
    hosts = paths.groupBy("host").agg(F.sum("path_s").alias("host_s"), F.sum("path_n").alias("host_n"))
    whole = hosts.agg(F.sum("host_s"), F.sum("host_n")).first()
    mean = min(0.999, max(0.001, whole[0] / whole[1])) if whole[1] else 0.5
    k_host = _strength(hosts, "host_s", "host_n", mean)
    hosts = hosts.select(F.col("host").alias("_host"), ((F.col("host_s") + k_host * mean) / (F.col("host_n") + k_host)).alias("host_quality"))
    sites = materialise(paths.join(hosts, F.col("host").eqNullSafe(F.col("_host"))).drop("_host"), "sites")
    k_path = _strength(sites, "path_s", "path_n", "host_quality")
    sites = sites.withColumnsRenamed({"host": "_host", "path": "_path"})

    joined = scored.join(sites, F.col("host").eqNullSafe(F.col("_host")) & F.col("path").eqNullSafe(F.col("_path")))
    rest = (F.col("path_s") - F.col("soft") + k_path * F.col("host_quality")) / (F.col("path_n") - 1 + k_path)  # without the document itself
    rest = F.greatest(F.lit(0.001), F.least(F.lit(0.999), rest))
    odds = F.col("evidence") + F.log(rest / (1 - rest)) - math.log(mean / (1 - mean))
    score = F.round(1 / (1 + F.exp(-odds)), 6)
    out = joined.select(F.col("id").alias(id_col), F.round("evidence", 6).alias("evidence"), F.round("host_quality", 6).alias("host_quality"), F.round(rest, 6).alias("path_quality"), score.alias("score"))
    return out.withColumn("keep", F.col("score") >= keep)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return posterior(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
