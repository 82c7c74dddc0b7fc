"""Writable tables: Parquet directories that are rewritten beside the old one and swapped by a pointer file.

A write makes a new version directory and then names it in a pointer file of the next number; readers open the version
that the highest pointer names, so they never see half a write, and a crash at any point leaves the table as it was before
or after the write. ``vacuum`` removes what is named no more. There are no row locks and no isolation: one writer per table.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType, _parse_datatype_string

from ..lang.ast import ColumnDef

TYPES = {"INT": "int", "INTEGER": "int", "TEXT": "string", "VARCHAR": "string", "CHAR": "string", "BOOLEAN": "boolean", "DATETIME": "timestamp", "REAL": "double", "NUMERIC": "decimal"}


class ConstraintProblem(ValueError):
    pass


def spark_type(declared: str) -> str:
    name, _, rest = declared.strip().partition("(")
    base = TYPES.get(name.strip().upper(), name.strip().lower())
    return f"{base}({rest}" if rest and base == "decimal" else base


class ManagedTable:
    def __init__(self, spark: SparkSession, root: str, name: str):
        self.spark, self.name, self.path = spark, name, f"{root.rstrip('/')}/{name}"

    def _fs(self):
        jvm = self.spark._jvm
        path = jvm.org.apache.hadoop.fs.Path(self.path)
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()), jvm.org.apache.hadoop.fs.Path

    def _pointers(self) -> list[int]:
        fs, path = self._fs()
        if not fs.exists(path(self.path)):
            return []
        names = [x.getPath().getName() for x in fs.listStatus(path(self.path))]
        return sorted(int(n.removeprefix("_pointer-")) for n in names if n.startswith("_pointer-"))

    def version(self) -> str | None:
        numbers = self._pointers()
        if not numbers:
            return None
        fs, path = self._fs()
        stream = fs.open(path(f"{self.path}/_pointer-{numbers[-1]:012d}"))
        try:
            return bytes(stream.readAllBytes()).decode() or None
        finally:
            stream.close()

    def read(self) -> DataFrame:
        version = self.version()
        if version is None:
            raise FileNotFoundError(f"no table {self.name} at {self.path}")
        return self.spark.read.parquet(f"{self.path}/{version}")

    def write(self, df: DataFrame) -> None:
        version = f"v-{uuid.uuid4().hex}"
        df.write.parquet(f"{self.path}/{version}")
        self.point(version)

    def point(self, version: str | None) -> None:
        """Names the current version, or none, by a new pointer that appears whole; older ones go only after that."""
        fs, path = self._fs()
        numbers = self._pointers()
        fresh = path(f"{self.path}/_next-{uuid.uuid4().hex}")
        out = fs.create(fresh, True)
        out.write((version or "").encode())
        out.close()
        if not fs.rename(fresh, path(f"{self.path}/_pointer-{numbers[-1] + 1 if numbers else 1:012d}")):
            raise OSError(f"cannot name version {version} of {self.name}")
        for n in numbers:
            fs.delete(path(f"{self.path}/_pointer-{n:012d}"), False)

    def vacuum(self) -> int:
        """Removes all versions but the current one, and returns how many. Nothing may still read them."""
        fs, path = self._fs()
        now = self.version()
        old = [x.getPath() for x in fs.listStatus(path(self.path)) if x.getPath().getName().startswith("v-") and x.getPath().getName() != now]
        for x in old:
            fs.delete(x, True)
        return len(old)

    def drop(self) -> None:
        fs, path = self._fs()
        fs.delete(path(self.path), True)


def schema_of(columns: Sequence[ColumnDef]) -> StructType:
    return _parse_datatype_string(", ".join(f"`{c.name}` {spark_type(c.type)}" for c in columns))


def inserted(current: DataFrame, columns: Sequence[str], rows: Sequence[Sequence[object]], definitions: Sequence[ColumnDef] = ()) -> DataFrame:
    """Columns that are not named get their declared default, or NULL."""
    names = list(columns) or current.columns
    missing = [n for n in names if n not in current.columns]
    if missing or len(rows[0]) != len(names):
        raise ValueError(f"values do not match the columns {current.columns}: {missing or rows[0]}")
    texts = [tuple(None if v is None else str(v) for v in r) for r in rows]
    new = current.sparkSession.createDataFrame(texts, ", ".join(f"`{n}` string" for n in names))
    default = {d.name: F.expr(d.default) for d in definitions if d.default is not None}
    cast = [(F.col(f"`{f.name}`") if f.name in names else default.get(f.name, F.lit(None))).cast(f.dataType) for f in current.schema]
    return current.unionByName(new.select(*(c.alias(f.name) for c, f in zip(cast, current.schema, strict=True))))


def updated(current: DataFrame, changes: dict[str, str], where: str | None) -> DataFrame:
    """changes and where: Spark SQL. All new values see the old row."""
    unknown = set(changes) - set(current.columns)
    if unknown:
        raise ValueError(f"unknown columns {sorted(unknown)}")
    hit = F.expr(where) if where else F.lit(True)
    return current.select(*(F.when(hit, F.expr(changes[f.name]).cast(f.dataType)).otherwise(F.col(f"`{f.name}`")).alias(f.name) if f.name in changes else F.col(f"`{f.name}`") for f in current.schema))


def deleted(current: DataFrame, where: str | None) -> DataFrame:
    """Rows for which the condition is NULL stay."""
    return current.where(~F.coalesce(F.expr(where), F.lit(False))) if where else current.limit(0)


def check(df: DataFrame, columns: Sequence[ColumnDef]) -> None:
    """Declared constraints, in one pass and one grouping per key."""
    tests = {f"{c.name} is required": F.col(f"`{c.name}`").isNull() for c in columns if c.required}
    tests |= {f"{c.name} fails {c.check}": ~F.coalesce(F.expr(c.check), F.lit(True)) for c in columns if c.check}
    if tests:
        row = df.agg(*(F.count_if(t).alias(f"t{k}") for k, t in enumerate(tests.values()))).first()
        broken = [name for k, name in enumerate(tests) if row[f"t{k}"]]
        if broken:
            raise ConstraintProblem("; ".join(broken))
    for c in columns:
        if (c.primary or c.unique) and df.where(F.col(f"`{c.name}`").isNotNull()).groupBy(f"`{c.name}`").count().where("count > 1").limit(1).count():
            raise ConstraintProblem(f"{c.name} repeats")
