"""Declarative pipelines and views over named tables, lowered to one plan each.

Unknown columns, unreadable conditions and unknown steps are errors: nothing passes silently.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..catalog import Catalog
from ..lang.ast import Call, Column
from ..lang.parser import parse_condition
from ..plans.lowering import Lowering
from .guard import walk

STEPS = ("JOIN", "FILTER", "AGGREGATE", "PROJECT", "SORT", "UNION")
FORBIDDEN_CALLS = {"NOW", "RANDOM", "RAND", "CURRENT_DATE"}
AGGREGATES: dict[str, Callable] = {
    "sum": F.sum, "avg": F.avg, "mean": F.avg, "min": F.min, "max": F.max, "count": F.count, "std": F.stddev, "stddev": F.stddev, "var": F.variance,
    "median": F.median, "nunique": F.count_distinct, "first": F.first, "last": F.last,
}


class PipelineProblem(ValueError):
    pass


@dataclass(frozen=True)
class Pipeline:
    name: str
    source_tables: tuple[str, ...]
    steps: tuple[dict, ...]
    output_file: str = ""
    parameters: dict = field(default_factory=dict)
    expected: dict = field(default_factory=dict)

    @staticmethod
    def load(text: str) -> dict[str, Pipeline]:
        return {
            p["name"]: Pipeline(p["name"], tuple(p["source_tables"]), tuple(p["steps"]), p.get("output_file", ""), p.get("parameters", {}), p.get("expected_output", {}))
            for p in json.loads(text)["pipelines"]
        }

    def problems(self) -> list[str]:
        out = []
        for k, s in enumerate(self.steps):
            kind = str(s.get("type", "")).upper()
            if kind not in STEPS:
                out.append(f"step {k}: unknown type {s.get('type')!r}")
            elif kind == "FILTER":
                try:
                    tree = parse_condition(_substitute(s["condition"], {p: 0 for p in _names(s["condition"])}))
                except ValueError as e:
                    out.append(f"step {k}: {e}")
                    continue
                used = {n.name for n in walk(tree) if isinstance(n, Call)} & FORBIDDEN_CALLS
                out += [f"step {k}: {n}() makes the pipeline depend on when it runs" for n in sorted(used)]
        return out


def _names(condition: str) -> list[str]:
    return re.findall(r"\{(\w+)\}", condition)


def _substitute(condition: str, parameters: dict) -> str:
    def value(m: re.Match) -> str:
        if m[1] not in parameters:
            raise PipelineProblem(f"no value for parameter {m[1]}")
        v = parameters[m[1]]
        return "'" + v.replace("'", "''") + "'" if isinstance(v, str) else str(v)

    return re.sub(r"'?\{(\w+)\}'?", value, condition)


def _resolve(df: DataFrame, name: str) -> str:
    """A column of the frame: exact, without its table prefix, or but for case."""
    short = name.rsplit(".", 1)[-1]
    for candidate in (name, short):
        if candidate in df.columns:
            return candidate
    like = [c for c in df.columns if c.lower() == short.lower()]
    if len(like) != 1:
        raise PipelineProblem(f"unknown column {name!r}; the frame has {df.columns}")
    return like[0]


def _filter(df: DataFrame, condition: str, parameters: dict) -> DataFrame:
    tree = parse_condition(_substitute(condition, parameters))
    for node in walk(tree):
        if isinstance(node, Column):
            _resolve(df, ".".join(node.parts))

    class Own(Lowering):
        def __init__(self):
            pass

        def expr(self, e, order=()):
            return f"`{_resolve(df, '.'.join(e.parts))}`" if isinstance(e, Column) else super().expr(e, order)

    return df.where(Own().expr(tree))


def run(p: Pipeline, tables: dict[str, DataFrame], parameters: dict | None = None, drop_null_keys: bool = False) -> DataFrame:
    if problems := p.problems():
        raise PipelineProblem("; ".join(problems))
    if missing := [t for t in p.source_tables if t not in tables]:
        raise PipelineProblem(f"missing tables: {missing}")
    values = p.parameters | (parameters or {})
    now: DataFrame | None = None
    for s in p.steps:
        kind = s["type"].upper()
        df = now if now is not None else tables[p.source_tables[0]]
        match kind:
            case "JOIN":
                left, right = (now if now is not None and s["left"] not in tables else tables[s["left"]] if now is None else now), tables[s["right"]]
                a, _, b = (x.strip() for x in s["on"].partition("="))
                if a.split(".")[0] == s["right"]:
                    a, b = b, a
                a, b = _resolve(left, a), _resolve(right, b)
                clash = (set(left.columns) & set(right.columns)) - ({a} if a == b else set())
                left = left.withColumnsRenamed({c: f"{c}_x" for c in clash})
                right = right.withColumnsRenamed({c: f"{c}_y" for c in clash})
                a, b = (f"{a}_x" if a in clash else a), (f"{b}_y" if b in clash else b)
                now = left.join(right, a) if a == b else left.join(right, F.col(f"`{a}`") == F.col(f"`{b}`"))
            case "FILTER":
                now = _filter(df, s["condition"], values)
            case "AGGREGATE":
                keys = [_resolve(df, g) for g in s.get("group_by", [])]
                made = []
                for a in s["aggregations"]:
                    f = a["function"].lower()
                    if f not in AGGREGATES:
                        raise PipelineProblem(f"unknown aggregate {f!r}")
                    c = "*" if a["column"] == "*" or (f == "count" and not keys) else f"`{_resolve(df, a['column'])}`"
                    made.append(AGGREGATES[f](F.lit(1) if c == "*" else F.col(c)).alias(a.get("alias") or f"{f}_{a['column'].rsplit('.', 1)[-1]}"))
                if drop_null_keys and keys:
                    df = df.dropna(subset=keys)
                now = df.groupBy(*keys).agg(*made) if keys else df.agg(*made)
            case "PROJECT":
                now = df.select(*(F.col(f"`{_resolve(df, c)}`") for c in s["columns"]))
            case "SORT":
                by = [_resolve(df, c) for c in ([s["by"]] if isinstance(s["by"], str) else s["by"])]
                down = str(s.get("order", "ASC")).upper() == "DESC"
                now = df.orderBy(*(F.desc_nulls_last(c) if down else F.asc_nulls_last(c) for c in by))
            case "UNION":
                now = df
                for t in s.get("tables", [s["right"]] if "right" in s else []):
                    now = now.unionByName(tables[t])
                if str(s.get("distinct", False)).lower() == "true":
                    now = now.distinct()
    return now if now is not None else tables[p.source_tables[0]]


# Views


def write(p: Pipeline, out: DataFrame) -> None:
    """Writes a pipeline's result to its ``output_file``, in the format of its suffix (Parquet without one)."""
    from ..sources.files import SUFFIXES
    from ..sources.files import write as write_file

    if not p.output_file:
        raise PipelineProblem(f"{p.name} names no output file")
    kind = next((k for suffix, k in SUFFIXES.items() if p.output_file.lower().endswith(suffix)), "parquet")
    write_file(out, p.output_file, kind)


@dataclass(frozen=True)
class View:
    name: str
    definition: str
    dependencies: tuple[str, ...] = ()
    columns: tuple[str, ...] = ()
    expected_rows: int | None = None

    @staticmethod
    def load(text: str) -> dict[str, View]:
        return {
            v["name"]: View(v["name"], v["definition"], tuple(v.get("dependencies", [])), tuple(v.get("columns", [])), v.get("expected_row_count"))
            for v in json.loads(text)["views"]
        }


def creation_order(dependencies: dict[str, tuple[str, ...] | set[str]]) -> list[str]:
    """Names after all that they depend on, alphabetical where free; a cycle is an error."""
    left = {n: {d for d in ds if d in dependencies} for n, ds in dependencies.items()}
    out: list[str] = []
    while left:
        free = sorted(n for n, ds in left.items() if not ds)
        if not free:
            raise PipelineProblem(f"views depend on each other: {sorted(left)}")
        out.append(free[0])
        del left[free[0]]
        for ds in left.values():
            ds.discard(free[0])
    return out


def define_views(spark: SparkSession, views: dict[str, View], tables: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """All views as lazy frames over the tables, each defined once; names of tables and views hold only in here."""
    out: dict[str, DataFrame] = {}
    scope = Catalog(spark)
    for name, df in tables.items():
        scope.register(name, df)
    for name in creation_order({n: v.dependencies for n, v in views.items()}):
        with_names = ", ".join(f"`{t}` AS (SELECT * FROM {scope.view(t)})" for t in scope.tables if re.search(rf"\b{re.escape(t)}\b", views[name].definition))
        out[name] = spark.sql(f"WITH {with_names} {views[name].definition}" if with_names else views[name].definition)
        scope.register(name, out[name])
    return out


def view_parity(view: View, frame: DataFrame | None) -> dict[str, bool]:
    out = {"exists": frame is not None, "definition": bool(view.definition.strip())}
    if frame is not None:
        rows = frame.count()
        out |= {"columns": not view.columns or set(view.columns) == set(frame.columns), "executes": True, "row_count": view.expected_rows in (None, rows)}
    return out
