"""Names of tables, and what is known about their keys."""

from __future__ import annotations

import itertools
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

_SERIAL = itertools.count()


class CatalogProblem(ValueError):
    """An unknown table, or keys that do not say how to join."""


@dataclass
class Catalog:
    """Tables as lazy DataFrames behind temporary views of this catalog's own names."""

    spark: SparkSession
    tables: dict[str, DataFrame] = field(default_factory=dict)
    #: (child table, child column) -> (parent table, parent column)
    foreign: dict[tuple[str, str], tuple[str, str]] = field(default_factory=dict)
    unique: dict[str, set[tuple[str, ...]]] = field(default_factory=dict)
    indexes: dict[str, list[tuple[str, ...]]] = field(default_factory=dict)

    def __post_init__(self) -> None:
        self._prefix = f"glyph_{next(_SERIAL)}_"
        self._loaders: dict[str, Callable[[], DataFrame]] = {}

    def register(self, name: str, df: DataFrame) -> None:
        self._loaders.pop(name, None)
        df.createOrReplaceTempView(self.view(name))
        self.tables[name] = df

    def register_lazily(self, name: str, load: Callable[[], DataFrame]) -> None:
        """A table that is opened when a query first names it."""
        self.tables.pop(name, None)
        self._loaders[name] = load

    def has(self, name: str) -> bool:
        return name in self.tables or name in self._loaders

    def drop(self, name: str) -> None:
        self.get(name)
        self.spark.catalog.dropTempView(self.view(name))
        del self.tables[name]

    def view(self, name: str) -> str:
        return self._prefix + "".join(c if c.isalnum() else f"_{ord(c)}_" for c in name)

    def get(self, name: str) -> DataFrame:
        if name in self._loaders:
            self.register(name, self._loaders[name]())
        if name not in self.tables:
            raise CatalogProblem(f"unknown table {name!r}; known: {', '.join(sorted({*self.tables, *self._loaders}))}")
        return self.tables[name]

    def add_foreign_key(self, child: str, child_column: str, parent: str, parent_column: str) -> None:
        self.foreign[child, child_column] = (parent, parent_column)

    def join_keys(self, left: str, right: str) -> list[tuple[str, str]]:
        """Columns (of left, of right) that relate two tables: declared foreign keys; else ``<singular>_id`` to ``id``;
        else equal names that end in ``_id``; else columns that agree but for a one- or two-letter prefix and end in
        ``key``. None or several that differ: an error, never a cross join."""
        lc, rc = self.get(left).columns, self.get(right).columns
        declared = [(c, pc) for (t, c), (p, pc) in self.foreign.items() if (t, p) == (left, right)]
        declared += [(pc, c) for (t, c), (p, pc) in self.foreign.items() if (t, p) == (right, left) and left != right]
        stem = lambda c: c.split("_", 1)[1] if "_" in c[1:3] else c
        own = lambda t, c: f"{_singular(t)}_id" == c or f"{t}_id" == c
        found = (
            declared
            or [(c, "id") for c in lc if own(right, c) and "id" in rc] + [("id", c) for c in rc if own(left, c) and "id" in lc]
            or [(c, c) for c in lc if c.endswith("_id") and c in rc]
            or [(a, b) for a in lc for b in rc if a != b and stem(a) == stem(b) and stem(a).endswith("key")]
        )
        if len(found) != 1:
            raise CatalogProblem(f"cannot tell how {left} and {right} join: {found or 'no related columns'}; declare a foreign key or give ON")
        return found


def _singular(name: str) -> str:
    if name.endswith("ies"):
        return name[:-3] + "y"
    if name.endswith(("sses", "xes", "ches", "shes")):
        return name[:-2]
    return name[:-1] if name.endswith("s") else name
