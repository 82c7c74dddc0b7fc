"""Language identification by rank-order profiles of character n-grams.

A language's profile is the ranking of its most frequent n-grams of one to three letters, counted over all training texts.
A document's own ranking is compared with each profile: every n-gram is out of place by the difference of its two ranks,
or by the profile's size if the profile lacks it. The language of the least sum wins, of equals the first by name.

Texts are lower-cased, every run of characters other than letters is one blank, and blanks stand only at the ends of an
n-gram. Equal counts rank by code point, so profiles and predictions do not depend on the order of rows.

Defined results: a null text, or one without a letter, is ``und`` with score 0; so is every text if nothing can be
learned; the score is 1 less the mean displacement as a share of the profile's size; training rows with a null text or
language are left out; repeated rows count and are judged each for itself; an empty table gives an empty result; other
columns are neither read nor returned by :func:`predict`, and all pass through :func:`keep_known`.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import by_bytes, release, table

SIZE = 400
UNKNOWN = "und"
BLANK = 1
_LETTERS: list[np.ndarray] = []


def _letters() -> np.ndarray:
    if not _LETTERS:
        _LETTERS.append(np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000))
    return _LETTERS[0]


def symbols(text: str) -> np.ndarray:
    """Lower-case letters as code points, with one blank before, after and between their runs; empty without letters."""
    cp = np.frombuffer(text.lower().encode("utf-32-le"), np.uint32)
    x = np.where(_letters()[cp], cp, BLANK).astype(np.int64)
    x = np.concatenate([[BLANK], x, [BLANK]])
    keep = np.ones(len(x), bool)
    keep[1:] = (x[1:] != BLANK) | (x[:-1] != BLANK)
    x = x[keep]
    return x if len(x) > 1 else x[:0]


def ngrams(x: np.ndarray) -> np.ndarray:
    """Codes of all n-grams of a text's symbols, 21 bits a symbol; the blank is not 0, so lengths do not clash."""
    two = x[:-1] << 21 | x[1:]
    three = (two[:-1] << 21 | x[2:])[x[1:-1] != BLANK]
    return np.concatenate([x[x != BLANK], two, three])


def top(codes: np.ndarray, counts: np.ndarray, size: int) -> np.ndarray:
    """The most frequent codes, of equals the smaller first. codes: sorted."""
    if len(codes) > size:
        least = np.partition(counts, len(counts) - size)[len(counts) - size]
        keep = counts >= least
        codes, counts = codes[keep], counts[keep]
    return codes[np.argsort(-counts, kind="stable")][:size]


def count_ngrams(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted codes and their counts in a long run of symbols, by direct counting where the alphabet is small."""
    alphabet, small = np.unique(x, return_inverse=True)
    k = len(alphabet)
    if k > 128:
        return np.unique(ngrams(x), return_counts=True)
    wide = alphabet.astype(np.int64)
    codes, counts = [], []
    one = np.bincount(small, minlength=k)
    two = np.bincount(small[:-1] * k + small[1:], minlength=k * k)
    three = np.bincount((small[:-2] * k + small[1:-1]) * k + small[2:], minlength=k**3)
    for n, c in enumerate((one, two, three), 1):
        at = np.flatnonzero(c)
        parts = [wide[at // k**p % k] for p in range(n - 1, -1, -1)]
        code = parts[0]
        for p in parts[1:]:
            code = code << 21 | p
        ok = (parts[0] != BLANK) if n == 1 else (parts[1] != BLANK) if n == 3 else np.ones(len(at), bool)
        if n == 2:  # texts follow each other in a run: two blanks are no n-gram
            ok = (parts[0] != BLANK) | (parts[1] != BLANK)
        codes.append(code[ok])
        counts.append(c[at][ok])
    return np.concatenate(codes), np.concatenate(counts)


def train(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", size: int = SIZE) -> dict[str, list[int]]:
    """The profile of each language: at most ``size`` codes each, which is all that reaches the driver."""
    rows = docs.select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).alias("text")).where("lang is not null and text is not null")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, dict[int, int]] = {}
        held: dict[str, list[np.ndarray]] = {}
        sizes: dict[str, int] = {}

        def settle(lang: str) -> None:
            codes, counts = count_ngrams(np.concatenate(held.pop(lang)))
            own = total.setdefault(lang, {})
            for c, n in zip(codes.tolist(), counts.tolist(), strict=True):
                own[c] = own.get(c, 0) + n
            sizes[lang] = 0

        def rows_of(lang: str) -> pa.RecordBatch:
            own = total.pop(lang)
            return pa.RecordBatch.from_arrays([pa.array([lang] * len(own), pa.string()), pa.array(own.keys(), pa.int64()), pa.array(own.values(), pa.int64())], ["lang", "gram", "n"])

        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                x = symbols(text)
                if len(x):
                    held.setdefault(lang, []).append(x)
                    sizes[lang] = sizes.get(lang, 0) + len(x)
                    if sizes[lang] > 1 << 21:
                        settle(lang)
                        if len(total[lang]) > 500_000:
                            yield rows_of(lang)
        for lang in list(held):
            settle(lang)
        for lang in list(total):
            yield rows_of(lang)
        release()

    counted = rows.mapInArrow(count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    ranked = counted.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "gram"))).where(F.col("rank") <= size)
    profiles: dict[str, list[tuple[int, int]]] = {}
    for r in ranked.select("lang", "rank", "gram").toLocalIterator():
        profiles.setdefault(r["lang"], []).append((r["rank"], r["gram"]))
    return {lang: [g for _, g in sorted(v)] for lang, v in sorted(profiles.items())}


class Ranks:
    """All profiles as one table of ranks."""

    def __init__(self, profiles: dict[str, list[int]], size: int):
        self.langs, self.size = list(profiles), size
        self.codes = np.unique(np.array([g for v in profiles.values() for g in v], np.int64))
        self.ranks = np.full((len(self.langs), len(self.codes) + 1), size, np.int64)  # the last column: in no profile
        for k, v in enumerate(profiles.values()):
            self.ranks[k, np.searchsorted(self.codes, np.array(v, np.int64))] = np.arange(len(v))

    def predict(self, text: str | None) -> tuple[str, float]:
        x = symbols(text) if text else np.zeros(0, np.int64)
        if not len(x) or not self.langs:
            return UNKNOWN, 0.0
        own = top(*np.unique(ngrams(x), return_counts=True), self.size)
        at = np.searchsorted(self.codes, own)
        at = np.where(self.codes[np.minimum(at, len(self.codes) - 1)] == own, at, len(self.codes))
        ranks = self.ranks[:, at]
        out = np.where(ranks < self.size, np.abs(ranks - np.arange(len(own))), self.size).sum(axis=1)
        best = int(out.argmin())
        return self.langs[best], float(1 - out[best] / (len(own) * self.size))


def _judge(profiles: dict[str, list[int]], size: int):
    """A function from a column of texts to languages and scores, for one task."""
    ranks = Ranks(profiles, size)

    def judge(texts: pa.Array) -> tuple[pa.Array, pa.Array]:
        found = [ranks.predict(t) for t in texts.to_pylist()]
        return pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())

    return judge


def predict(docs: DataFrame, profiles: dict[str, list[int]], id_col: str = "doc_id", text_col: str = "text", size: int = SIZE) -> DataFrame:
    """id, ``lang_pred``, ``score`` of every row."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        judge = _judge(profiles, size)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), *judge(batch.column(1))], ["id", "lang_pred", "score"])

    out = rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, lang_pred string, score double")
    return out.withColumnRenamed("id", id_col)


def keep_known(docs: DataFrame, profiles: dict[str, list[int]], text_col: str = "text", size: int = SIZE, least_score: float = 0.0) -> DataFrame:
    """The rows of ``docs``, with all columns, whose text has a language by these profiles with at least this score."""
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        judge = _judge(profiles, size)
        for batch in by_bytes(batches, at):
            langs, scores = judge(batch.column(at))
            yield batch.filter(pa.compute.and_(pa.compute.not_equal(langs, UNKNOWN), pa.compute.greater_equal(scores, least_score)))
        release()

    return docs.mapInArrow(run, docs.schema)


def held_out(id_col: str = "doc_id") -> F.Column:
    return F.crc32(F.col(id_col).cast("string")) % 5 == 0


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    profiles = train(docs.where(~held_out()))
    return predict(docs, profiles).withColumn("held_out", held_out()).select("doc_id", "held_out", "lang_pred", "score")
