"""Comparison, arithmetic, text, date and aggregate operators of the library, as Column builders by name.

Where the library's rules differ from SQL (numbers in text compare as numbers, text without case, empty sums are 0), the
rule is built from expressions, so nothing leaves the JVM.
"""

from __future__ import annotations

import datetime as dt
import re
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

ColumnOr = Column | str | int | float | bool | None


def _c(x: ColumnOr) -> Column:
    return x if isinstance(x, Column) else F.lit(x)


def number(x: ColumnOr) -> Column:
    return _c(x).try_cast("double")


def loose_eq(a: ColumnOr, b: ColumnOr) -> Column:
    """Equal as numbers if both read as numbers, else equal as text without case; two NULLs are equal."""
    a, b = _c(a), _c(b)
    x, y = number(a), number(b)
    same = F.when(x.isNotNull() & y.isNotNull(), x == y).otherwise(F.lower(a.cast("string")) == F.lower(b.cast("string")))
    return F.when(a.isNull() | b.isNull(), a.isNull() & b.isNull()).otherwise(same)


def loose_compare(op: str) -> Callable[[ColumnOr, ColumnOr], Column]:
    def build(a: ColumnOr, b: ColumnOr) -> Column:
        a, b = _c(a), _c(b)
        x, y = number(a), number(b)
        apply = {">": Column.__gt__, "<": Column.__lt__, ">=": Column.__ge__, "<=": Column.__le__}[op]
        return F.when(x.isNotNull() & y.isNotNull(), apply(x, y)).otherwise(apply(a.cast("string"), b.cast("string")))

    return build


def plus(a: ColumnOr, b: ColumnOr) -> Column:
    """A sum if both read as numbers, else the texts joined; the result is text."""
    a, b = _c(a), _c(b)
    return F.coalesce((number(a) + number(b)).cast("string"), F.concat(a.cast("string"), b.cast("string")))


def modulo(a: ColumnOr, b: ColumnOr) -> Column:
    """With the sign of the divisor."""
    a, b = _c(a).cast("double"), _c(b).cast("double")
    return a - b * F.floor(F.try_divide(a, b))


def every(*xs: ColumnOr) -> Column:
    out = F.lit(True)
    for x in xs:
        out = out & F.coalesce(_c(x), F.lit(False))
    return out


def some(*xs: ColumnOr) -> Column:
    out = F.lit(False)
    for x in xs:
        out = out | F.coalesce(_c(x), F.lit(False))
    return out


def similar(text: ColumnOr, pattern: ColumnOr, threshold: float = 0.7) -> Column:
    """The share of the pattern's distinct characters that the text has, case ignored, reaches the threshold."""
    letters = lambda x: F.array_remove(F.array_distinct(F.split(F.lower(_c(x)), "")), "")
    p = letters(pattern)
    return F.coalesce(F.try_divide(F.size(F.array_intersect(letters(text), p)), F.size(p)) >= threshold, F.lit(False))


def span(text: str) -> Column:
    got = re.match(r"(\d+)([dhm])", text)
    if got is None:
        raise ValueError(f"unknown time span {text!r}")
    return F.expr(f"INTERVAL {got[1]} {dict(d='DAY', h='HOUR', m='MINUTE')[got[2]]}")


def recent(at: Column, text: str, now: dt.datetime | None = None) -> Column:
    return at > (F.lit(now) if now else F.current_timestamp()) - span(text)


def older_than(at: Column, text: str, now: dt.datetime | None = None) -> Column:
    return at < (F.lit(now) if now else F.current_timestamp()) - span(text)


def trim_all(x: ColumnOr) -> Column:
    return F.regexp_replace(_c(x), r"^\s+|\s+$", "")


#: By name: what a query library calls, as builders of Columns.
OPERATORS: dict[str, Callable[..., Column]] = {
    "=": loose_eq,
    "==": lambda a, b: _c(a).eqNullSafe(_c(b)),
    "!=": lambda a, b: ~_c(a).eqNullSafe(_c(b)),
    ">": loose_compare(">"), "<": loose_compare("<"), ">=": loose_compare(">="), "<=": loose_compare("<="),
    "&": every, "&&": every, "||": some, "!": lambda a: ~F.coalesce(_c(a), F.lit(False)),
    "+": plus,
    "-": lambda a, b: _c(a).cast("double") - _c(b).cast("double"),
    "*": lambda a, b: _c(a).cast("double") * _c(b).cast("double"),
    "/": lambda a, b: F.try_divide(_c(a).cast("double"), _c(b).cast("double")),
    "%": modulo,
    "LIKE": lambda a, p: F.ilike(_c(a), _c(p)),
    "CONTAINS": lambda a, p: F.contains(_c(a), _c(p)), "STARTSWITH": lambda a, p: F.startswith(_c(a), _c(p)), "ENDSWITH": lambda a, p: F.endswith(_c(a), _c(p)),
    "CONCAT": lambda *xs: F.concat(*(F.coalesce(_c(x).cast("string"), F.lit("None")) for x in xs)),
    "UPPER": lambda x: F.upper(_c(x)), "LOWER": lambda x: F.lower(_c(x)), "TRIM": trim_all,
    "SUBSTRING": lambda x, s, n: F.substring(_c(x), _c(s), _c(n)),
    "ROUND": lambda x, n=0: F.round(_c(x), n), "FLOOR": lambda x: F.floor(_c(x)), "CEIL": lambda x: F.ceil(_c(x)), "ABS": lambda x: F.abs(_c(x)), "SQRT": lambda x: F.sqrt(_c(x)),
    "GREATEST": lambda *xs: F.greatest(*map(_c, xs)), "COALESCE": lambda *xs: F.coalesce(*map(_c, xs)), "NULLIF": lambda a, b: F.nullif(_c(a), _c(b)),
    "COUNT": lambda x=None: F.count(F.lit(1)),
    "SUM": lambda x: F.coalesce(F.sum(_c(x).cast("double")), F.lit(0.0)),
    "AVG": lambda x: F.coalesce(F.avg(_c(x).cast("double")), F.lit(0.0)),
    "MIN": lambda x: F.min(number(x)), "MAX": lambda x: F.max(number(x)),
    "GROUP_CONCAT": lambda x, sep=",": F.listagg(_c(x).cast("string"), sep),
    "NOW": F.current_timestamp, "DATE": lambda x: F.to_date(_c(x)), "YEAR": lambda x: F.year(_c(x)), "MONTH": lambda x: F.month(_c(x)), "DAY": lambda x: F.dayofmonth(_c(x)),
    "RECENT": recent, "OLDER_THAN": older_than, "BETWEEN_DATES": lambda x, a, b: _c(x).between(_c(a), _c(b)),
    "SIMILAR": similar,
    "IS_NULL": lambda x: _c(x).isNull(), "IS_NOT_NULL": lambda x: _c(x).isNotNull(),
    "IN": lambda x, options: _c(x).isin(list(options)), "BETWEEN": lambda x, a, b: number(x).between(number(a), number(b)),
}


def operator(name: str, *args) -> Column:
    if name.upper() not in OPERATORS:
        raise KeyError(f"unknown operator {name!r}")
    return OPERATORS[name.upper()](*args)
