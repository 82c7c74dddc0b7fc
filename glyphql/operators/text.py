"""Text search, chunking, vectors and their fusion, as DataFrame algebra.

An index is two tables: documents and postings. A search is one plan: filter the candidates, join the query's few terms
with the postings, sum the scores, keep the best.
"""

from __future__ import annotations

import hashlib
import math
import re
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

K1, B = 1.2, 0.75
IDF_FLOOR = 1e-6
CHUNK_SIZE = 512
LANES = {"metadata": 0.10, "lexical": 0.25, "vector": 0.65}
LEXICAL_TOP, VECTOR_TOP = 100, 50


def normalise(text: str) -> str:
    """Lower case, NFKC, then without combining marks."""
    folded = unicodedata.normalize("NFD", unicodedata.normalize("NFKC", text.lower()))
    return "".join(c for c in folded if unicodedata.category(c) != "Mn")


def normalised(column: Column) -> Column:
    """:func:`normalise` over Arrow batches; Spark has no built-in for it."""

    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: None if t is None else t.lower() if t.isascii() else normalise(t))

    return F.pandas_udf(run, "string")(column)


def tokens(text: Column) -> Column:
    """Runs of letters and digits, in lower case."""
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda t: t != "")


def query_words(query: str) -> list[str]:
    return re.findall(r"[^\W_]+", query.lower())


def matches(query: str, *text_cols: str) -> Column:
    """Whether a row's texts hold every term of the query: the rows that a search ranks, without a limit. No terms match nothing."""
    words = tokens(F.concat_ws(" ", *(F.col(c) for c in text_cols)))
    terms = sorted(set(query_words(query)))
    return F.size(F.array_except(F.array(*map(F.lit, terms)), words)) == 0 if terms else F.lit(False)


@dataclass(frozen=True)
class TextIndex:
    """documents: ``id, length, digest`` (of all columns, texts whole) and what else they carry; postings: ``term, id, tf``."""

    documents: DataFrame
    postings: DataFrame

    @staticmethod
    def build(docs: DataFrame, id_col: str, *text_cols: str) -> TextIndex:
        words = tokens(F.concat_ws(" ", *(F.col(c) for c in text_cols)))
        rows = docs.withColumn("_words", words)
        whole = F.sha2(F.to_json(F.struct(*(F.col(f"`{c}`") for c in sorted(docs.columns))), {"ignoreNullFields": "false"}), 256)
        documents = rows.withColumns({"id": F.col(id_col), "length": F.size("_words"), "digest": whole}).drop("_words")
        postings = rows.select(F.col(id_col).alias("id"), F.explode("_words").alias("term")).groupBy("term", "id").agg(F.count(F.lit(1)).alias("tf"))
        return TextIndex(documents, postings)

    def search(self, query: str, top_k: int = 10, candidates: Column | None = None, fold: bool = False) -> DataFrame:
        """``id, score`` of the best documents that hold every term of the query, of equals the smaller id first.

        Term weights and the mean length are those of the whole corpus; candidates narrow before ranking."""
        words = query_words(normalise(query) if fold else query)
        if not words:
            return self.documents.select("id", F.lit(0.0).alias("score")).limit(0)
        terms = sorted(set(words))
        whole = self.documents.agg(F.count(F.lit(1)).alias("docs"), F.avg("length").alias("mean"))
        mine = self.postings.where(F.col("term").isin(terms))
        df = mine.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
        docs = self.documents if candidates is None else self.documents.where(candidates)
        idf = F.greatest(F.log((F.col("docs") - F.col("df") + 0.5) / (F.col("df") + 0.5)), F.lit(IDF_FLOOR))
        # One row of totals and one per term of the query.
        weights = df.join(F.broadcast(whole)).select("term", idf.alias("idf"), "mean")
        times = F.lit(1) if len(words) == len(terms) else F.create_map(*(F.lit(x) for t in terms for x in (t, words.count(t))))[F.col("term")]
        part = F.col("idf") * times * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("length") / F.col("mean")))
        scored = mine.join(F.broadcast(weights), "term").join(docs.select("id", "length"), "id").groupBy("id").agg(F.sum(part).alias("score"), F.count(F.lit(1)).alias("terms"))
        return scored.where(F.col("terms") == len(terms)).select("id", F.round("score", 6).alias("score")).orderBy(F.desc("score"), "id").limit(top_k)

    def upsert(self, docs: DataFrame, id_col: str, *text_cols: str) -> TextIndex:
        """The index with these documents in place of those of the same id."""
        new = TextIndex.build(docs, id_col, *text_cols)
        return TextIndex(self._without(self.documents, docs, id_col).unionByName(new.documents), self._without(self.postings, docs, id_col).unionByName(new.postings))

    def delete(self, ids: DataFrame, id_col: str) -> TextIndex:
        return TextIndex(self._without(self.documents, ids, id_col), self._without(self.postings, ids, id_col))

    @staticmethod
    def _without(df: DataFrame, ids: DataFrame, id_col: str) -> DataFrame:
        return df.join(ids.select(F.col(id_col).alias("_gone")).distinct(), F.col("id") == F.col("_gone"), "left_anti")

    def digest(self) -> str:
        """SHA-256 over the ids and the documents' digests in order of both, streamed."""
        out = hashlib.sha256()
        for r in self.documents.select("id", "digest").orderBy("id", "digest").toLocalIterator():
            out.update(f"{r['id']}:{r['digest']}\n".encode())
        return out.hexdigest()


def metadata_filter(df: DataFrame, wanted: dict[str, object], tags: tuple[str, ...] = ("tags",)) -> Column:
    """AND over fields, OR within a list; array fields match if any value is wanted; an unknown field matches nothing."""
    if "namespace" not in wanted:
        raise ValueError("a namespace is required")
    out = F.lit(True)
    for name, value in wanted.items():
        values = list(value) if isinstance(value, list | tuple | set) else [value]
        if name not in df.columns:
            return F.lit(False)
        out = out & (F.arrays_overlap(F.col(name), F.array(*map(F.lit, values))) if name in tags else F.col(name).isin(values))
    return out


# Chunks


def paragraphs(text: str) -> Iterator[tuple[int, int]]:
    """Spans between blank lines, without surrounding white space."""
    at = 0
    for gap in [*re.finditer(r"\n\s*\n", text), None]:
        end = gap.start() if gap else len(text)
        body = text[at:end]
        if body.strip():
            yield at + len(body) - len(body.lstrip()), at + len(body.rstrip())
        at = gap.end() if gap else len(text)


def chunk_spans(text: str, size: int = CHUNK_SIZE) -> list[tuple[int, int, str]]:
    """(start, end, content): paragraphs merged up to ``size`` characters with a blank line between; longer ones are cut
    after sentences, and a sentence that is longer still stays whole."""
    out: list[tuple[int, int, str]] = []
    held: list[tuple[int, int]] = []

    def flush() -> None:
        if held:
            out.append((held[0][0], held[-1][1], "\n\n".join(text[s:e] for s, e in held)))
            held.clear()

    for s, e in paragraphs(text):
        have = sum(b - a for a, b in held) + 2 * max(0, len(held) - 1)
        if have + (e - s) + (2 if held else 0) <= size:
            held.append((s, e))
            continue
        flush()
        if e - s <= size:
            held.append((s, e))
            continue
        run: list[tuple[int, int]] = []
        cuts = [s, *(s + m.end() for m in re.finditer(r"(?<=[.!?])\s+", text[s:e])), e]
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            b = a + len(text[a:b].rstrip())
            if b <= a:
                continue
            if run and b - run[0][0] > size:
                out.append((run[0][0], run[-1][1], text[run[0][0] : run[-1][1]]))
                run = []
            run.append((a, b))
        if run:
            out.append((run[0][0], run[-1][1], text[run[0][0] : run[-1][1]]))
    flush()
    return out


CHUNK_SCHEMA = (
    "doc_id string, chunk_id string, chunk_index int, source_uri string, content string, content_hash string, "
    "citation struct<start_offset:int,end_offset:int,start_line:int,end_line:int,start_byte:int,end_byte:int>"
)


def short_hash(*parts: object) -> str:
    return hashlib.sha256(":".join(map(str, parts)).encode()).hexdigest()[:16]


def chunk_documents(docs: DataFrame, uri_col: str, text_col: str, namespace: str = "default", size: int = CHUNK_SIZE) -> DataFrame:
    """Chunks with content-addressed ids and exact places (offsets in characters and bytes, lines from 1)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for uri, text in zip(pdf["uri"], pdf["text"], strict=True):
                doc_id = short_hash(namespace, uri)
                for k, (s, e, content) in enumerate(chunk_spans(text or "", size)):
                    digest = hashlib.sha256(content.encode()).hexdigest()
                    place = {"start_offset": s, "end_offset": e, "start_line": text.count("\n", 0, s) + 1, "end_line": text.count("\n", 0, e) + 1, "start_byte": len(text[:s].encode()), "end_byte": len(text[:e].encode())}
                    rows.append((doc_id, short_hash(doc_id, k, digest), k, uri, content, digest, place))
            yield pd.DataFrame(rows, columns=["doc_id", "chunk_id", "chunk_index", "source_uri", "content", "content_hash", "citation"])

    return docs.select(F.col(uri_col).cast("string").alias("uri"), F.col(text_col).alias("text")).mapInPandas(run, CHUNK_SCHEMA)


def changed_documents(known: DataFrame, arriving: DataFrame, uri_col: str, text_col: str) -> DataFrame:
    """Rows of ``arriving`` that are new or whose text differs from ``known`` (uri, hash)."""
    rows = arriving.withColumn("_hash", F.sha2(F.coalesce(text_col, F.lit("")), 256))
    return rows.join(known.select(F.col("uri").alias(uri_col), F.col("hash").alias("_hash")), [uri_col, "_hash"], "left_anti")


# Vectors and fusion


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda acc, x: acc + x)


def nearest(df: DataFrame, id_col: str, vector_col: str, query: list[float], top_k: int = 10) -> DataFrame:
    """``id, similarity``: (cosine + 1) / 2 with the query, exact over all rows; of equals the smaller id first."""
    norm = math.sqrt(sum(x * x for x in query)) or 1.0
    q = F.lit([x / norm for x in query])
    v = F.col(vector_col)
    cosine = F.try_divide(dot(v, q), F.sqrt(dot(v, v)))
    return df.select(F.col(id_col).alias("id"), F.round((F.coalesce(cosine, F.lit(0.0)) + 1) / 2, 6).alias("similarity")).orderBy(F.desc("similarity"), "id").limit(top_k)


def fuse(candidates: DataFrame, lexical: DataFrame, vector: DataFrame, top_k: int = 10) -> DataFrame:
    """``id, score``: the weighted sum of the lanes. candidates: ids that pass the metadata; lexical: id, score; vector:
    id, similarity. The lexical lane is relative to its best; if it has rows, the vector lane counts only for them."""
    best = lexical.agg(F.max("score").alias("best"), F.count(F.lit(1)).alias("n"))
    lanes = (
        candidates.select("id").join(lexical.select("id", "score"), "id", "left").join(vector.select("id", "similarity"), "id", "left").join(F.broadcast(best))
        .where((F.col("n") == 0) | F.col("score").isNotNull() | F.col("similarity").isNull())
    )
    lex = F.coalesce(F.try_divide(F.col("score"), F.col("best")), F.lit(0.0))
    total = LANES["metadata"] + LANES["lexical"] * lex + LANES["vector"] * F.coalesce("similarity", F.lit(0.0))
    return lanes.where(F.col("score").isNotNull() | F.col("similarity").isNotNull()).select("id", F.round(total, 6).alias("score")).orderBy(F.desc("score"), "id").limit(top_k)


def hybrid(index: TextIndex, query: str, vectors: DataFrame, id_col: str, vector_col: str, vector: list[float], candidates: Column | None = None, top_k: int = 10) -> DataFrame:
    """``id, score`` of the three lanes. Each lane narrows before it ranks: the lexical lane takes its best of the candidates
    (a condition on the index's documents), the vector lane its best of the lexical shortlist, or of the candidates if that is empty."""
    ids = (index.documents if candidates is None else index.documents.where(candidates)).select("id")
    found = index.search(query, LEXICAL_TOP, candidates)
    best = found.collect()  # of fixed size; both lanes read it
    lexical = ids.sparkSession.createDataFrame(best, found.schema)
    among = lexical.select("id") if best else ids
    near = nearest(vectors.join(among.withColumnRenamed("id", "_among"), F.col(id_col) == F.col("_among"), "left_semi"), id_col, vector_col, vector, VECTOR_TOP)
    return fuse(ids, lexical, near, top_k)


def grounding(hits: DataFrame) -> DataFrame:
    """One row: status by the number of supporting chunks (three and more, one or two, none), and how many."""
    n = F.count(F.lit(1))
    return hits.agg(n.alias("n"), F.when(n >= 3, "GROUNDED").when(n >= 1, "PARTIAL").otherwise("UNGROUNDED").alias("status"))


def citation(uri: Column, start: Column, end: Column) -> Column:
    return F.format_string("%s:%d-%d", uri, start, end)
