"""Exact dedup by skew-safe combining, with DataFrame operations only.

1. Digests of the normalised texts are written and counted. A text whose digest occurs once equals no other.
2. Texts whose digest repeats go through three combines, each grouping by the *full* normalised text beside its digest, so
   that a digest collision can never merge two texts: Spark's map-side partial aggregate (local), the merge of salted digest
   groups, and the combine of the salts' winners. A group that holds a third of all rows thereby leaves each map task as one
   row and meets in ``salts`` rows.
3. The verdict on the repeated digests returns to the rows. It is broadcast if its counted size allows (``SENT_BYTES``);
   beyond that both sides are exchanged, and adaptive execution can split a hot digest.

Defined results: a null text counts as empty, all empty texts are one group; of equal texts the row with the largest id
stays; rows repeated with the same id belong to one group and each of them is returned by :func:`classes`, where ``kept``
holds for all rows of the kept id, while :func:`keep` returns one row of each text, also if ids repeat or are null; a null
id never wins against another id; an empty table gives an empty result; columns of the input other than id and text are
neither read nor returned by :func:`classes` and all pass through :func:`keep`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

from .common import ascii_lower, discard, materialise, table

SALTS = 16
#: Verdicts are broadcast up to this size, at so many bytes each (a digest of 64 letters, an id, two numbers).
SENT_BYTES = 32 << 20
VERDICT_BYTES = 192


def _normal(text_col: str):
    return ascii_lower(F.coalesce(F.col(text_col), F.lit("")))


def _digests(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    norm = docs.select(F.col(id_col).alias("_id"), _normal(text_col).alias("_norm"))
    return materialise(norm.select("_id", F.sha2("_norm", 256).alias("_sha")), "digests")


def _sized(verdicts: DataFrame) -> DataFrame:
    """A written table by digest, to be broadcast if its number of rows proves it small."""
    fixed = all(isinstance(f.dataType, NumericType) for f in verdicts.schema if f.name == "_keep")
    return F.broadcast(verdicts) if fixed and verdicts.count() * VERDICT_BYTES <= SENT_BYTES else verdicts


def repeated_winners(docs: DataFrame, digests: DataFrame, text_col: str = "text", id_col: str = "doc_id", salts: int = SALTS) -> DataFrame:
    """One row per text that occurs twice or more: ``_sha, _keep, _size``, written. ``digests``: ``_id, _sha`` of all rows."""
    spark = docs.sparkSession
    repeated = materialise(digests.groupBy("_sha").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select("_sha"), "repeated")
    rows = docs.select(F.col(id_col).alias("_id"), _normal(text_col).alias("_norm")).withColumn("_sha", F.sha2("_norm", 256))
    rows = rows.join(_sized(repeated), "_sha", "left_semi")
    salted = (
        rows.groupBy("_sha", F.pmod(F.xxhash64("_id"), F.lit(salts)).alias("_salt"), "_norm")
        .agg(F.max("_id").alias("_keep"), F.count(F.lit(1)).alias("_size"))
    )
    whole = salted.groupBy("_sha", "_norm").agg(F.max("_keep").alias("_keep"), F.sum("_size").alias("_size"))
    # Distinct texts under one SHA-256 would make the way back by digest wrong: that stops the job instead.
    won = whole.select("_sha", "_keep", "_size").groupBy("_sha").agg(
        F.max("_keep").alias("_keep"),
        F.when(F.count(F.lit(1)) > 1, F.raise_error(F.lit("two texts share a SHA-256 digest")).cast("long")).otherwise(F.max("_size")).alias("_size"),
    )
    won = materialise(won, "winners")
    discard(spark, repeated)
    return won


def classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", salts: int = SALTS) -> DataFrame:
    """One row per input row: id, ``keep_id``, ``group_size``, ``kept``, ``text_sha256``."""
    digests = _digests(docs, id_col, text_col)
    won = repeated_winners(docs, digests, text_col, id_col, salts)
    alone = F.col("_size").isNull()
    return digests.join(_sized(won), "_sha", "left").select(
        F.col("_id").alias(id_col),
        F.when(alone, F.col("_id")).otherwise(F.col("_keep")).alias("keep_id"),
        F.coalesce("_size", F.lit(1).cast("long")).alias("group_size"),
        (alone | F.col("_id").eqNullSafe(F.col("_keep"))).alias("kept"),
        F.col("_sha").alias("text_sha256"),
    )


def keep(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", salts: int = SALTS) -> DataFrame:
    """One row of each distinct text, with all its columns; of rows that repeat both text and id, the one whose columns hash least."""
    spark = docs.sparkSession
    digests = _digests(docs, id_col, text_col)
    won = repeated_winners(docs, digests, text_col, id_col, salts)
    # How many rows hold the winner's id beside its text: one, unless ids repeat.
    mine = F.col("_id").eqNullSafe(F.col("_keep"))
    twins = digests.join(_sized(won), "_sha").groupBy("_sha").agg(F.first("_keep").alias("_keep"), F.count_if(mine).alias("_twins"))
    verdicts = materialise(twins, "verdicts")
    discard(spark, digests, won)
    rows = docs.select(F.struct("*").alias("_row"), F.col(id_col).alias("_id"), F.sha2(_normal(text_col), 256).alias("_sha"))
    judged = rows.join(_sized(verdicts), "_sha", "left")
    stay = judged.where(F.col("_twins").isNull() | (mine & (F.col("_twins") == 1))).select("_row.*")
    if verdicts.where("_twins > 1").isEmpty():
        return stay
    least = F.xxhash64(*(F.col(f"_row.`{c}`") for c, kind in docs.dtypes if "map<" not in kind))
    one = judged.where(mine & (F.col("_twins") > 1)).groupBy("_sha").agg(F.min_by("_row", least).alias("_row"))
    return stay.unionAll(one.select("_row.*"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classes(table(spark, sf_dir, "documents"))


ORACLE = """
WITH n AS (
  SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents
)
SELECT doc_id,
       max(doc_id) OVER (PARTITION BY t) AS keep_id,
       CAST(count(*) OVER (PARTITION BY t) AS BIGINT) AS group_size,
       doc_id = max(doc_id) OVER (PARTITION BY t) AS kept,
       sha256(t) AS text_sha256
FROM n
"""
