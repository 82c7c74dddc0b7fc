"""Syntax trees to Spark SQL, one statement for one query, so that Catalyst sees the whole plan.

Identifiers are quoted and literals escaped here; nothing of a query's text reaches Spark otherwise.
"""

from __future__ import annotations

import datetime as dt
from dataclasses import replace

from pyspark.sql import DataFrame

from ..catalog import Catalog
from ..functions.names import call, literal
from ..lang.ast import (
    Between, Binary, Call, Case, Column, Expr, In, Interval, IsNull, Item, Literal, OrderItem, Parameter, Scalar, Select, Source, Star, Unary, Window,
)

UNITS = {"SECOND", "MINUTE", "HOUR", "DAY", "WEEK", "MONTH", "YEAR", "QUARTER"}
JOIN_SQL = {"inner": "JOIN", "left": "LEFT JOIN", "right": "RIGHT JOIN", "full": "FULL JOIN"}


class LoweringProblem(ValueError):
    pass


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def value_text(v: object) -> str:
    match v:
        case None:
            return "NULL"
        case bool():
            return "TRUE" if v else "FALSE"
        case int():
            return str(v)
        case float():
            return f"{v!r}D"
        case str():
            return literal(v)
        case dt.datetime():
            return f"TIMESTAMP'{v.isoformat(sep=' ')}'"
        case dt.date():
            return f"DATE'{v.isoformat()}'"
    raise LoweringProblem(f"unsupported value {v!r}")


class Lowering:
    """Queries over one catalog. parameters: of ``@name``; now: the moment that RECENT and the like count from."""

    def __init__(self, catalog: Catalog, memory: dict[str, DataFrame] | None = None, parameters: dict[str, object] | None = None, now: dt.datetime | None = None, search=None):
        self.catalog, self.memory, self.parameters, self.now, self.search = catalog, memory or {}, parameters or {}, now, search
        for name, df in self.memory.items():
            if f"&{name}" not in catalog.tables or catalog.tables[f"&{name}"] is not df:
                catalog.register(f"&{name}", df)

    # Expressions

    def expr(self, e: Expr, order: tuple[OrderItem, ...] = ()) -> str:
        """order: of the query, for windows that name none."""
        go = lambda x: self.expr(x, order)
        match e:
            case Literal(v):
                return value_text(v)
            case Column(parts):
                return ".".join(map(quoted, parts))
            case Star(table):
                return "*" if table is None else f"{quoted(table)}.*"
            case Parameter(name):
                if name not in self.parameters:
                    raise LoweringProblem(f"no value for @{name}")
                return value_text(self.parameters[name])
            case Interval(amount, unit):
                unit = unit.rstrip("S") if unit not in UNITS else unit
                if unit not in UNITS:
                    raise LoweringProblem(f"unknown unit {unit}")
                if isinstance(amount, Literal):
                    return f"INTERVAL {int(amount.value)} {unit}"
                part = {"MONTH": "make_interval(0, {0})", "YEAR": "make_interval({0})", "WEEK": "make_interval(0, 0, {0})", "DAY": "make_interval(0, 0, 0, {0})", "HOUR": "make_interval(0, 0, 0, 0, {0})", "MINUTE": "make_interval(0, 0, 0, 0, 0, {0})"}
                return part[unit].format(go(amount))
            case Call("RECENT" | "OLDER_THAN" as name, (x, span)):
                now = f"TIMESTAMP'{self.now.isoformat(sep=' ')}'" if self.now else "current_timestamp()"
                return f"({go(x)} {'>' if name == 'RECENT' else '<'} {now} - {go(self._span(span))})"
            case Call("SEARCH", _):
                raise LoweringProblem("SEARCH stands alone among the conditions of a query over one table")
            case Call(name, args, distinct):
                return call(name, [go(a) for a in args], distinct)
            case Unary("NOT", v):
                return f"(NOT {go(v)})"
            case Unary(op, v):
                return f"({op}{go(v)})"
            case Binary("/", a, b):
                return f"try_divide({go(a)}, {go(b)})"
            case Binary(op, a, b):
                return f"({go(a)} {op} {go(b)})"
            case Between(v, low, high, negated):
                return f"({go(v)} {'NOT ' * negated}BETWEEN {go(low)} AND {go(high)})"
            case In(v, Select() as q, negated):
                return f"({go(v)} {'NOT ' * negated}IN ({self.select(q)}))"
            case In(v, options, negated):
                return f"({go(v)} {'NOT ' * negated}IN ({', '.join(map(go, options))}))"
            case IsNull(v, negated):
                return f"({go(v)} IS {'NOT ' * negated}NULL)"
            case Case(subject, whens, otherwise):
                head = "CASE" + (f" {go(subject)}" if subject else "")
                body = "".join(f" WHEN {go(c)} THEN {go(v)}" for c, v in whens)
                return f"{head}{body}" + (f" ELSE {go(otherwise)}" if otherwise else "") + " END"
            case Window(c, partition, own, frame):
                used = own or order
                spec = [f"PARTITION BY {', '.join(map(go, partition))}"] if partition else []
                spec += [f"ORDER BY {', '.join(self.order(o) for o in used)}"] if used else []
                spec += [frame] if frame else []
                return f"{go(c)} OVER ({' '.join(spec)})"
            case Scalar(q):
                return f"({self.select(q)})"
        raise LoweringProblem(f"cannot lower {e!r}")

    @staticmethod
    def _span(span: Expr) -> Expr:
        if isinstance(span, Literal) and isinstance(span.value, str):
            import re

            from ..lang.parser import UNITS as SHORT

            if got := re.match(r"(\d+)([dhmws])", span.value):
                return Interval(Literal(int(got[1])), SHORT[got[2]])
        if not isinstance(span, Interval):
            raise LoweringProblem("a span of time is a number and one of d, h, m, w, s")
        return span

    def order(self, o: OrderItem) -> str:
        return f"{self.expr(o.value)} {'DESC' if o.descending else 'ASC'}"

    # Queries

    def _relation(self, s: Source) -> str:
        if s.query is not None:
            return f"({self.select(s.query)}) AS {quoted(s.alias)}"
        name = f"&{s.name}" if s.memory else s.name
        if s.memory and s.name not in self.memory:
            raise LoweringProblem(f"unknown memory &{s.name}")
        self.catalog.get(name)
        return f"{quoted(self.catalog.view(name))} AS {quoted(s.alias)}"

    def _from(self, q: Select) -> str:
        out = self._relation(q.sources[0])
        if len(q.sources) == 1:
            return out
        if q.join in ("cross", "natural"):
            word = "CROSS JOIN" if q.join == "cross" else "NATURAL JOIN"
            return out + "".join(f" {word} {self._relation(s)}" for s in q.sources[1:])
        if q.on is not None and len(q.sources) > 2:
            raise LoweringProblem("ON is for two tables; declare foreign keys for more")
        word = JOIN_SQL["inner" if q.join == "self" else q.join]
        rest, seen = list(q.sources[1:]), [q.sources[0]]
        while rest:
            # The next table, in listed order, that relates to one already joined.
            for s in rest:
                if q.on is not None:
                    on = self.expr(q.on)
                    break
                on, problem = self._related(seen, s)
                if on:
                    break
            else:
                raise problem
            out += f" {word} {self._relation(s)} ON {on}"
            seen.append(s)
            rest.remove(s)
        return out

    def _related(self, seen: list[Source], s: Source) -> tuple[str | None, Exception | None]:
        from ..catalog import CatalogProblem

        name = lambda x: f"&{x.name}" if x.memory else x.name
        problem: Exception | None = None
        for other in seen:
            try:
                keys = self.catalog.join_keys(name(other), name(s))
            except CatalogProblem as e:
                problem = problem or e
                continue
            return " AND ".join(f"{quoted(other.alias)}.{quoted(a)} = {quoted(s.alias)}.{quoted(b)}" for a, b in keys), None
        return None, problem

    def _items(self, q: Select) -> tuple[list[Item], Select]:
        """What a verb selects, and the query without the verb."""
        items = list(q.items) or [Item(Star())]
        if q.verb == "COUNT":
            return [Item(Call("COUNT", (Star(),)), items[0].alias or "count")], q
        if q.verb in ("SUM", "AVG", "MIN", "MAX"):
            return [Item(Call(q.verb, (i.value,)), i.alias or f"{q.verb.lower()}_{_name(i.value)}") for i in items], q
        if q.verb == "DISTINCT":
            return items, replace(q, distinct=True)
        if q.verb == "GROUP_COUNT":
            group = tuple(i.value for i in items)
            return [*items, Item(Call("COUNT", (Star(),)), "count")], replace(q, group=group)
        return items, q

    def select(self, q: Select) -> str:
        if q.join == "union":
            bodies = [f"SELECT {', '.join(self._item(i, q) for i in self._items(q)[0])} FROM {self._relation(s)}" for s in q.sources]
            out = " UNION ".join(bodies)
            if q.where or q.group or q.having:
                raise LoweringProblem("a union of tables takes order and limit only")
            return self._tail(f"SELECT * FROM ({out})", q)
        if q.unions:
            first = self._body(replace(q, unions=(), order=(), limit=None, offset=None))
            out = f"({first})" + "".join(f" UNION {'ALL ' * every}({self._body(u)})" for every, u in q.unions)
            return self._tail(f"SELECT * FROM ({out})", q)
        return self._body(q)

    def _item(self, i: Item, q: Select) -> str:
        text = self.expr(i.value, q.order)
        return text if isinstance(i.value, Star) else f"{text} AS {quoted(i.alias or _name(i.value))}"

    def _body(self, q: Select) -> str:
        items, q = self._items(q)
        out = f"SELECT {'DISTINCT ' * q.distinct}{', '.join(self._item(i, q) for i in items)} FROM {self._from(q)}"
        if q.where is not None:
            out += f" WHERE {self.expr(q.where)}"
        if q.group:
            out += f" GROUP BY {', '.join(self.expr(g) for g in q.group)}"
        if q.having is not None:
            out += f" HAVING {self.expr(q.having)}"
        # What is ordered by and selected is named by its column: a grouped query with windows knows no other name for it.
        names = {i.value: i.alias or _name(i.value) for i in items if not isinstance(i.value, Star)}
        return self._tail(out, replace(q, order=tuple(replace(o, value=Column((names[o.value],))) if o.value in names and not isinstance(o.value, Column) else o for o in q.order)))

    def _tail(self, out: str, q: Select) -> str:
        order = q.order
        if q.verb == "LAST":
            order = tuple(replace(o, descending=not o.descending) for o in order)
            if not order:
                raise LoweringProblem("*LAST needs an order")
        if q.verb == "RANDOM":
            seed = self.parameters.get("seed", 0)
            return f"{out} ORDER BY rand({int(seed)}) LIMIT {q.limit}"
        if order:
            out += f" ORDER BY {', '.join(map(self.order, order))}"
        if q.limit is not None:
            out += f" LIMIT {q.limit}"
        if q.offset:
            out += f" OFFSET {q.offset}"
        return out

    def run(self, q: Select) -> DataFrame:
        q, keyword = self._without_search(q)
        if keyword is not None:
            if self.search is None or len(q.sources) != 1:
                raise LoweringProblem("SEARCH needs one table that has a text index")
            found = self.search(q.sources[0].name, keyword)
            name = f"search:{q.sources[0].name}"
            self.catalog.register(name, found)
            q = replace(q, sources=(Source(name, q.sources[0].alias or q.sources[0].name),))
        return self.catalog.spark.sql(self.select(q))

    @staticmethod
    def _without_search(q: Select) -> tuple[Select, str | None]:
        def split(e: Expr | None) -> tuple[Expr | None, str | None]:
            match e:
                case Call("SEARCH", (Literal(str() as word),)):
                    return None, word
                case Binary("AND", a, b):
                    (a, x), (b, y) = split(a), split(b)
                    if x is not None and y is not None:
                        raise LoweringProblem("one SEARCH takes all words")
                    return (Binary("AND", a, b) if a and b else a or b), x or y
            return e, None

        where, word = split(q.where)
        return replace(q, where=where), word


def _name(e: Expr) -> str:
    """A column name for an item without an alias."""
    match e:
        case Column(parts):
            return parts[-1]
        case Call(name, (), _):
            return name.lower()
        case Call(name, args, _):
            return f"{name.lower()}_{_name(args[0])}"
        case Star():
            return "all"
        case Window(c):
            return _name(c)
        case Literal(v):
            return str(v)
        case Case():
            return "case"
        case Unary(_, v):
            return _name(v)
        case Binary(_, a, b):
            return f"{_name(a)}_{_name(b)}"
    return "value"
