"""Moving tables between stores: checks beforehand, one table at a time, resumable."""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from .dialects import from_neutral, loss, to_neutral
from .pipeline import PipelineProblem, creation_order

RESERVED = {"select", "from", "where", "group", "order", "table", "user", "index", "join", "union", "values", "check", "default", "primary", "key"}


@dataclass(frozen=True)
class TableDef:
    name: str
    columns: tuple[tuple[str, str], ...]  # (name, source type)
    references: tuple[str, ...] = ()


def preflight(tables: list[TableDef], source: str, target: str) -> list[str]:
    """What may go wrong: lossy and unknown types, reserved names, names that differ by case only, cyclic references."""
    out = []
    for t in tables:
        names = [c for c, _ in t.columns]
        out += [f"{t.name}.{c}: reserved word" for c in names if c.lower() in RESERVED]
        out += [f"{t.name}.{c}: differs from another column by case only" for c in names if sum(x.lower() == c.lower() for x in names) > 1]
        for c, kind in t.columns:
            if to_neutral(source, kind).name == "UNKNOWN":
                out.append(f"{t.name}.{c}: unknown type {kind}")
            elif why := loss(source, kind, target):
                out.append(f"{t.name}.{c}: {why}")
    try:
        creation_order({t.name: set(t.references) - {t.name} for t in tables})
    except PipelineProblem as e:
        out.append(str(e))
    return out


def ddl(t: TableDef, source: str, target: str) -> str:
    return f"CREATE TABLE {t.name} ({', '.join(f'{c} {from_neutral(target, to_neutral(source, k))}' for c, k in t.columns)})"


class Migration:
    """Copies tables in order of their references. What is done is noted in ``state_path`` after each table, so a run that
    broke off goes on with the table it was at. ``write`` returns the number of rows it wrote, as :func:`write_counted`
    does; if it returns None, the source is counted once more."""

    def __init__(self, spark: SparkSession, read: Callable[[str], DataFrame], write: Callable[[str, DataFrame], int | None], state_path: str):
        self.spark, self.read, self.write, self.state_path = spark, read, write, state_path

    def _state(self) -> dict[str, int]:
        jvm = self.spark._jvm
        path = jvm.org.apache.hadoop.fs.Path(self.state_path)
        fs = path.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not fs.exists(path):
            return {}
        stream = fs.open(path)
        try:
            return json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    def _note(self, state: dict[str, int]) -> None:
        jvm = self.spark._jvm
        path = jvm.org.apache.hadoop.fs.Path(self.state_path)
        out = path.getFileSystem(self.spark._jsc.hadoopConfiguration()).create(path, True)
        out.write(json.dumps(state, sort_keys=True).encode())
        out.close()

    def run(self, tables: list[TableDef]) -> dict[str, int]:
        """Rows written per table."""
        state = self._state()
        for name in creation_order({t.name: set(t.references) - {t.name} for t in tables}):
            if name not in state:
                df = self.read(name)
                written = self.write(name, df)
                state[name] = df.count() if written is None else written
                self._note(state)
        return state


def write_counted(df: DataFrame, path: str) -> int:
    """Writes Parquet in place of what a broken run may have left, and counts the rows as they are written."""
    rows = Observation()
    df.observe(rows, F.count(F.lit(1)).alias("n")).write.mode("overwrite").parquet(path)
    return rows.get["n"]


# Lookups by key over files that are laid out for them


def write_indexed(df: DataFrame, path: str, *keys: str, files: int | None = None) -> None:
    """Range-partitioned and sorted by the keys, so that Parquet's statistics skip all files but those that a lookup needs."""
    parts = df.repartitionByRange(files, *keys) if files else df.repartitionByRange(*keys)
    parts.sortWithinPartitions(*keys).write.parquet(path)


def point(df: DataFrame, key: str, value: object) -> DataFrame:
    return df.where(F.col(key) == F.lit(value))


def between(df: DataFrame, key: str, low: object, high: object) -> DataFrame:
    """Both ends included."""
    return df.where(F.col(key).between(low, high))


def repeated_keys(df: DataFrame, *keys: str) -> DataFrame:
    """Key values that break uniqueness, and how often each occurs."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1")
