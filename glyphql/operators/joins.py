"""Joins of the library: prefixed output names, a residual condition, and the choice of how NULL keys compare."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KINDS = {"INNER": "inner", "LEFT": "left", "RIGHT": "right", "FULL": "full", "CROSS": "cross"}
#: Hints that ask for one strategy; without one, adaptive execution chooses.
HINTS = {"hash": "shuffle_hash", "merge": "merge", "nested": None, None: None}


def prefixed(df: DataFrame, prefix: str) -> DataFrame:
    return df.select(*(F.col(f"`{c}`").alias(f"{prefix}{c}") for c in df.columns))


def join(
    left: DataFrame, right: DataFrame, left_key: str | list[str] | None = None, right_key: str | list[str] | None = None, kind: str = "INNER",
    condition: Callable[[DataFrame, DataFrame], Column] | None = None, strategy: str | None = None, nulls_match: bool = False,
) -> DataFrame:
    """Columns come out as ``left_*`` and ``right_*``; missing sides are NULL.

    condition: gets both prefixed sides, always left first. Without keys it is a theta join. NULL keys match only with
    ``nulls_match``."""
    how = KINDS[kind.upper()]
    l, r = prefixed(left, "left_"), prefixed(right, "right_")
    if how == "cross":
        return l.crossJoin(r)
    keys = lambda k: [] if k is None else [k] if isinstance(k, str) else list(k)
    pairs = list(zip(keys(left_key), keys(right_key), strict=True))
    tests = [(F.col(f"`left_{a}`").eqNullSafe(F.col(f"`right_{b}`")) if nulls_match else F.col(f"`left_{a}`") == F.col(f"`right_{b}`")) for a, b in pairs]
    if condition is not None:
        tests.append(condition(l, r))
    if not tests:
        raise ValueError("a join needs keys or a condition")
    on = tests[0]
    for t in tests[1:]:
        on = on & t
    if hint := HINTS[strategy]:
        r = r.hint(hint)
    return l.join(r, on, how)


def chain(first: DataFrame, *steps: tuple[DataFrame, str, str]) -> DataFrame:
    """Inner joins in a row: each step joins its table on (column of the result so far, own column), without prefixes."""
    out = first
    for df, left_key, right_key in steps:
        clash = set(out.columns) & set(df.columns)
        df = df.select(*(F.col(f"`{c}`").alias(f"right_{c}" if c in clash else c) for c in df.columns))
        key = f"right_{right_key}" if right_key in clash else right_key
        out = out.join(df, F.col(f"`{left_key}`") == F.col(f"`{key}`"))
    return out
