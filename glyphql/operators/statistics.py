"""Column statistics, percentiles, and order-insensitive and exact fingerprints of tables."""

from __future__ import annotations

import hashlib
import json

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

BUCKETS = 10


def column_statistics(df: DataFrame, approximate: bool = False) -> DataFrame:
    """One row per column: ``column, n, nulls, ndv, min, max, avg_length``, from one aggregate pass."""
    distinct = F.approx_count_distinct if approximate else F.count_distinct
    parts = [F.count(F.lit(1)).alias("n")]
    for k, c in enumerate(df.columns):
        q = F.col(f"`{c}`")
        parts += [F.count_if(q.isNull()).alias(f"nulls{k}"), distinct(q).alias(f"ndv{k}"), F.min(q).cast("string").alias(f"min{k}"), F.max(q).cast("string").alias(f"max{k}"), F.avg(F.char_length(q.cast("string"))).alias(f"len{k}")]
    wide = df.agg(*parts)
    rows = [F.struct(F.lit(c).alias("column"), F.col("n"), *(F.col(f"{s}{k}").alias(t) for s, t in (("nulls", "nulls"), ("ndv", "ndv"), ("min", "min"), ("max", "max"), ("len", "avg_length")))) for k, c in enumerate(df.columns)]
    return wide.select(F.explode(F.array(*rows)).alias("s")).select("s.*")


def histogram(df: DataFrame, column: str, buckets: int = BUCKETS) -> DataFrame:
    """``bucket, low, high, n``: equal widths between least and greatest value, which falls into the last one."""
    if not isinstance(df.schema[column].dataType, NumericType):
        raise TypeError(f"{column} is not numeric")
    v = df.select(F.col(f"`{column}`").cast("double").alias("v")).where("v is not null")
    ends = v.agg(F.min("v").alias("lo"), F.max("v").alias("hi")).first()
    if ends["lo"] is None:
        return df.sparkSession.createDataFrame([], "bucket int, low double, high double, n long")
    lo, hi = ends["lo"], ends["hi"]
    width = (hi - lo) / buckets or 1.0
    bucket = F.least(F.floor((F.col("v") - lo) / width), F.lit(buckets - 1)).cast("int")
    return v.groupBy(bucket.alias("bucket")).agg(F.count(F.lit(1)).alias("n")).select("bucket", (F.lit(lo) + F.col("bucket") * width).alias("low"), (F.lit(lo) + (F.col("bucket") + 1) * width).alias("high"), "n")


def common_values(df: DataFrame, column: str, k: int = 10) -> DataFrame:
    """The k most frequent values, of equals the smaller first."""
    return df.where(F.col(f"`{column}`").isNotNull()).groupBy(F.col(f"`{column}`").alias("value")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "value").limit(k)


def percentiles(df: DataFrame, column: str, points: tuple[float, ...] = (0.5, 0.95, 0.99)) -> DataFrame:
    return df.agg(*(F.percentile(f"`{column}`", p).alias(f"p{round(p * 100)}") for p in points))


def join_rows(left_rows: int, right_rows: int, left_ndv: int, right_ndv: int) -> float:
    """The usual estimate: product of sizes over the larger number of distinct keys."""
    return left_rows * right_rows / max(left_ndv, right_ndv, 1)


# Fingerprints

EMPTY = hashlib.sha256(b"").hexdigest()


def quick_fingerprint(df: DataFrame) -> dict[str, object]:
    """Row count and two sums over row hashes: independent of order, sensitive to repeats, one pass, no sort."""
    h = F.xxhash64(*(F.col(f"`{c}`") for c in sorted(df.columns)))
    r = df.agg(F.count(F.lit(1)).alias("n"), F.sum(h.cast("decimal(38,0)")).alias("s"), F.bit_xor(h).alias("x")).first()
    return {"rows": r["n"], "fingerprint": hashlib.sha256(f"{r['n']}|{r['s']}|{r['x']}".encode()).hexdigest()}


def exact_fingerprint(df: DataFrame, excluded: tuple[str, ...] = (), algorithm: str = "sha256", null: str = "__NULL__") -> str:
    """The digest of the concatenated digests of all rows, sorted by all columns as (is null, text).

    Rows are JSON objects with sorted keys and Python's text of each value. The rows' digests are sorted in the cluster and
    streamed to the driver partition by partition."""
    columns = [c for c in df.columns if c not in excluded]
    schema = "k array<string>, digest string"

    def digests(batches):
        new = getattr(hashlib, algorithm)
        for pdf in batches:
            keys, out = [], []
            for row in pdf.itertuples(index=False, name=None):
                cells = {c: _text(v, null) for c, v in zip(columns, row, strict=True)}
                keys.append([("1" if _missing(v) else "0") + ("" if _missing(v) else cells[c]) for c, v in zip(columns, row, strict=True)])
                out.append(new(json.dumps(cells, sort_keys=True).encode()).hexdigest())
            yield pd.DataFrame({"k": keys, "digest": out})

    total = getattr(hashlib, algorithm)()
    plain = df.select(*(F.col(f"`{c}`") for c in columns))
    for r in plain.mapInPandas(digests, schema).orderBy("k").select("digest").toLocalIterator():
        total.update(r["digest"].encode())
    return total.hexdigest()


def _missing(v: object) -> bool:
    return v is None or v is pd.NaT or (isinstance(v, float) and v != v)


def _text(v: object, null: str) -> str:
    if _missing(v):
        return null
    if isinstance(v, bytes | bytearray):
        return bytes(v).hex()
    if isinstance(v, dict | list):
        return json.dumps(v, sort_keys=True, default=str)
    return str(v)


def dataset_fingerprint(tables: dict[str, str]) -> str:
    """Of table names and their fingerprints."""
    return hashlib.sha256("|".join(f"{n}:{f}" for n, f in sorted(tables.items())).encode()).hexdigest()


def data_parity(source: dict[str, DataFrame], target: dict[str, DataFrame]) -> dict[str, dict]:
    """Of each table: MATCH, MISMATCH (with the number of rows that differ either way), SOURCE_ONLY or TARGET_ONLY; and the same of its columns' types."""
    out: dict[str, dict] = {}
    for name in sorted(set(source) | set(target)):
        if name not in target:
            out[name] = {"data": "SOURCE_ONLY", "types": "N/A"}
        elif name not in source:
            out[name] = {"data": "TARGET_ONLY", "types": "N/A"}
        else:
            a, b = source[name], target[name]
            same_types = sorted(a.dtypes) == sorted(b.dtypes)
            if sorted(a.columns) != sorted(b.columns):
                out[name] = {"data": "MISMATCH", "types": "MISMATCH"}
                continue
            b = b.select(*a.columns)
            gone, new = a.exceptAll(b).count(), b.exceptAll(a).count()
            out[name] = {"data": "MISMATCH" if gone or new else "MATCH", "types": "MATCH" if same_types else "MISMATCH", "source_only_rows": gone, "target_only_rows": new}
    return out


#: Kinds of declared constraints: columns of the key; groups of unique columns; (columns, table, its columns); columns; names; a column.
CONSTRAINTS = ("primary_keys", "unique_constraints", "foreign_keys", "not_null", "indexes", "identity_column")


def constraint_parity(source: dict[str, dict], target: dict[str, dict]) -> dict[str, dict[str, str]]:
    """Of each table and kind of constraint, declared in any order: MATCH, MISMATCH, SOURCE_ONLY, TARGET_ONLY, or N/A if neither has any.

    A kind that is missing has no constraints, an unknown one is an error; the order of a list does not count, that within its entries does."""
    unknown = {k for side in (source, target) for kinds in side.values() for k in kinds} - set(CONSTRAINTS)
    if unknown:
        raise ValueError(f"unknown constraints {sorted(unknown)}")

    def declared(kinds: dict, kind: str) -> set[str]:
        value = kinds.get(kind)
        entries = [] if value is None else [value] if isinstance(value, str) else value
        return {json.dumps(x, sort_keys=True, default=str) for x in entries}

    def status(a: set[str], b: set[str]) -> str:
        if not a and not b:
            return "N/A"
        return "MATCH" if a == b else "SOURCE_ONLY" if not b else "TARGET_ONLY" if not a else "MISMATCH"

    return {t: {k: status(declared(source.get(t, {}), k), declared(target.get(t, {}), k)) for k in CONSTRAINTS} for t in sorted(set(source) | set(target))}
