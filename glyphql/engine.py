"""The facade: tables in, symbolic queries to lazy DataFrames, writes by rewriting managed tables."""

from __future__ import annotations

import datetime as dt
import hashlib
import re
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Row, SparkSession

from .catalog import Catalog
from .lang.ast import ColumnDef, Create, Delete, Drop, Index, Insert, Let, Select, Statement, Transaction, Update
from .lang.parser import parse, parse_condition
from .operators import managed
from .operators.guard import Firewall, Policy, redact
from .operators.text import matches
from .plans.lowering import Lowering, LoweringProblem

FORMATS = {"OQ": "rows", "OJ": "json", "OT": "table", "OC": "csv"}


@dataclass(frozen=True)
class Result:
    """A lazy result and what is known of it without running it."""

    statement: Statement
    df: DataFrame | None
    outputs: tuple[str, ...] = ()
    sql: str | None = None

    def rows(self) -> list[Row]:
        return self.df.collect()

    def render(self, limit: int | None = None) -> str | list[Row]:
        """In the format that the query asked for. All rows reach the driver, or the first ``limit`` if that is given; for
        results that are too large for that there are :meth:`chunks` and ``files.write``."""
        kind = next((FORMATS[o.upper()] for o in self.outputs if o.upper() in FORMATS), "rows")
        top = self.df if limit is None else self.df.limit(limit)
        match kind:
            case "json":
                return "[" + ",".join(top.toJSON().collect()) + "]"
            case "csv":
                return top.toPandas().to_csv(index=False)
            case "table":
                return top.toPandas().to_string(index=False)
        return top.collect()

    def chunks(self, size: int = 1000) -> Iterator[list[Row]]:
        """Rows in chunks, one partition at a time on the driver."""
        held: list[Row] = []
        for row in self.df.toLocalIterator(prefetchPartitions=True):
            held.append(row)
            if len(held) == size:
                yield held
                held = []
        if held:
            yield held


def _plan(df: DataFrame) -> str:
    mode = df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")
    return df._jdf.queryExecution().explainString(mode)


@dataclass
class Engine:
    """root: where managed tables live; without it, tables are read-only."""

    spark: SparkSession
    root: str | None = None
    firewall: Firewall | None = field(default_factory=Firewall)
    policy: Policy = field(default_factory=Policy)
    redact_results: bool = False
    limit_digits: bool = False
    now: dt.datetime | None = None
    search: Callable[[str, str], DataFrame] | None = None

    def __post_init__(self) -> None:
        self.catalog = Catalog(self.spark)
        self.memory: dict[str, DataFrame] = {}
        self.definitions: dict[str, tuple[ColumnDef, ...]] = {}
        self._texts: dict[str, tuple[str, ...]] = {}
        self._before: dict[str, str | None] | None = None

    # Tables

    def register(self, name: str, table: DataFrame | str) -> Engine:
        """A frame, or the path of a Parquet table, which is opened when a query first names it."""
        if isinstance(table, str):
            self.catalog.register_lazily(name, lambda: self.spark.read.parquet(table))
        else:
            self.catalog.register(name, table)
        return self

    def foreign_key(self, child: str, child_column: str, parent: str, parent_column: str) -> Engine:
        self.catalog.add_foreign_key(child, child_column, parent, parent_column)
        return self

    def text_index(self, table: str, *text_columns: str) -> Engine:
        """The columns that SEARCH looks into; it finds all rows that hold every word, in the table as it is then."""
        self._texts[table] = text_columns
        return self

    def constraints(self, table: str) -> dict[str, list]:
        """What is declared of a table, as ``statistics.constraint_parity`` compares it."""
        columns = self.definitions.get(table, ())
        primary = [c.name for c in columns if c.primary]
        return {
            "primary_keys": primary,
            "unique_constraints": [[c.name] for c in columns if c.unique] + [list(u) for u in sorted(self.catalog.unique.get(table, ()))],
            "foreign_keys": [[c, p, pc] for (t, c), (p, pc) in sorted(self.catalog.foreign.items()) if t == table],
            "not_null": [c.name for c in columns if c.required or c.primary],
            "indexes": [list(i) for i in self.catalog.indexes.get(table, [])],
        }

    # Queries

    def query(self, text: str, **parameters: object) -> DataFrame:
        """The rows of the last statement."""
        return self.execute(text, **parameters)[-1].df

    def execute(self, text: str, **parameters: object) -> list[Result]:
        if self.firewall is not None:
            self.firewall.check(text)
        return [self._run(s, parameters) for s in parse(text, self.limit_digits)]

    def batch(self, texts: Iterable[str], fail_fast: bool = False) -> list[list[Result] | Exception]:
        out: list[list[Result] | Exception] = []
        for t in texts:
            try:
                out.append(self.execute(t))
            except Exception as e:
                if fail_fast:
                    raise
                out.append(e)
        return out

    def script(self, text: str, variables: dict[str, str] | None = None) -> list[Result]:
        """A script: lines that begin with -- or # and a blank are comments, ${NAME} and $NAME are variables, semicolons part statements."""
        lines = [x for x in text.splitlines() if not re.match(r"\s*(--|#\s)", x)]
        body = re.sub(r"\$(?:\{([A-Za-z_]\w*)\}|([A-Za-z_]\w*))", lambda m: str((variables or {}).get(m[1] or m[2], m[0])), "\n".join(lines))
        return self.execute(body)

    def explain(self, text: str) -> str:
        return _plan(self.query(text))

    # Writes without the language

    def insert(self, table: str, *rows: dict[str, object]) -> DataFrame:
        """Rows by column name, all with the same names; the others get their defaults. Returns the table after it."""
        names = tuple(rows[0])
        return self._write(Insert(table, names, tuple(tuple(r[n] for n in names) for r in rows)))

    def update(self, table: str, changes: dict[str, str], where: str | None = None) -> DataFrame:
        """changes and where: expressions of the language."""
        return self._write(Update(table, tuple((c, parse_condition(e)) for c, e in changes.items()), parse_condition(where) if where else None))

    def delete(self, table: str, where: str | None = None) -> DataFrame:
        return self._write(Delete(table, parse_condition(where) if where else None))

    def create_table(self, table: str, columns: dict[str, str]) -> DataFrame:
        """columns: each name's type with its marks, as in ``@A``: ``{"id": "INT !1", "note": "TEXT !6('')"}``."""
        return self._write(parse(f"@A[{table}]::{','.join(f'{c} {t}' for c, t in columns.items())}")[0])

    def _write(self, s: Statement) -> DataFrame:
        self._run(s, {})
        return self.catalog.get(s.table)

    def fingerprint(self, text: str) -> str:
        """A key of a query's text, the same for equal token sequences."""
        from .lang.lexer import tokens

        return hashlib.sha256("\x1f".join(f"{t.kind}:{t.text}" for t in tokens(text)).encode()).hexdigest()[:16]

    def _lowering(self, parameters: dict[str, object]) -> Lowering:
        return Lowering(self.catalog, self.memory, parameters, self.now, self.search or self._search)

    def _search(self, table: str, keyword: str) -> DataFrame:
        if table not in self._texts:
            raise LoweringProblem("SEARCH needs one table that has a text index")
        return self.catalog.get(table).where(matches(keyword, *self._texts[table]))

    def _run(self, s: Statement, parameters: dict[str, object]) -> Result:
        self.policy.check(s)
        low = self._lowering(parameters)
        match s:
            case Select():
                df = self.policy.cap(s, low.run(s))
                if self.redact_results:
                    df = redact(df)
                asked = {o.upper().partition("(")[0] for o in s.outputs}
                if "CACHE" in asked:
                    df = df.cache()
                if "EXPLAIN" in asked:  # the plan instead of the rows
                    df = self.spark.createDataFrame([(_plan(df),)], "plan string")
                elif "VALIDATE" in asked:  # lowered and analysed, not run
                    df = self.spark.createDataFrame([(k, f.name, f.dataType.simpleString(), f.nullable) for k, f in enumerate(df.schema)], "position int, name string, type string, nullable boolean")
                return Result(s, df, s.outputs, low.select(s) if "DEBUG" in asked else None)
            case Let(name, query):
                self.memory[name] = low.run(query)
                return Result(s, self.memory[name], query.outputs)
            case Insert(table, columns, rows):
                self._rewrite(table, lambda now: managed.inserted(now, columns, rows, self.definitions.get(table, ())))
            case Update(table, changes, where):
                texts = {c: low.expr(v) for c, v in changes}
                self._rewrite(table, lambda now: managed.updated(now, texts, low.expr(where) if where else None))
            case Delete(table, where):
                self._rewrite(table, lambda now: managed.deleted(now, low.expr(where) if where else None))
            case Create(table, columns):
                store = self._managed(table)
                if store.version() is not None or self.catalog.has(table):
                    raise ValueError(f"{table} exists")
                self.definitions[table] = columns
                self._remember(table)
                store.write(self.spark.createDataFrame([], managed.schema_of(columns)))
                for c in columns:
                    if c.references:
                        self.catalog.add_foreign_key(table, c.name, *c.references)
                self.register(table, store.read())
            case Drop(table):
                if self.root is not None and self._managed(table).version() is not None:
                    self._remember(table)
                    self._managed(table).point(None)
                self.catalog.drop(table)
            case Index(table, columns):
                missing = set(columns) - set(self.catalog.get(table).columns)
                if missing:
                    raise ValueError(f"unknown columns {sorted(missing)}")
                self.catalog.indexes.setdefault(table, []).append(columns)
            case Transaction(action):
                self._transaction(action)
        return Result(s, None)

    # Writes

    def _managed(self, table: str) -> managed.ManagedTable:
        if self.root is None:
            raise PermissionError("this engine has no folder for managed tables")
        return managed.ManagedTable(self.spark, self.root, table)

    def _rewrite(self, table: str, change: Callable[[DataFrame], DataFrame]) -> None:
        store = self._managed(table)
        after = change(store.read())
        managed.check(after, self.definitions.get(table, ()))
        self._remember(table)
        store.write(after)
        self.register(table, store.read())

    def _remember(self, table: str) -> None:
        if self._before is not None:
            self._before.setdefault(table, self._managed(table).version())

    def _transaction(self, action: str) -> None:
        """Begin notes versions; rollback names them again; commit forgets them. There is no isolation."""
        if action == "begin":
            self._before = {}
        elif self._before is None:
            raise ValueError("no transaction has begun")
        else:
            if action == "rollback":
                for table, version in self._before.items():
                    store = self._managed(table)
                    store.point(version)
                    if version is not None:
                        self.register(table, store.read())
                    elif table in self.catalog.tables:
                        self.catalog.drop(table)
            self._before = None
