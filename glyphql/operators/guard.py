"""Guards: patterns of harmful queries, a safety policy over syntax trees, and redaction of secrets in results."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, MapType, StringType, StructType

from ..lang.ast import Column, Create, Delete, Drop, Index, Insert, Let, Select, Source, Statement, Update


class Blocked(PermissionError):
    pass


@dataclass(frozen=True)
class Firewall:
    """Rules by category; a query that matches one is blocked, and so is every query if there are no rules."""

    rules: dict[str, tuple[str, ...]] = field(default_factory=lambda: {
        "injection": (r"(?i);\s*drop\s+table", r"(?i)\bunion\s+select\b", r"(?i)'\s*or\s+'?1'?\s*=\s*'?1", r"(?i)\bxp_cmdshell\b"),
        "system_prompt": (r"(?i)ignore\s+(all\s+)?(previous|prior)\s+instructions", r"(?i)reveal\s+(the\s+)?system\s+prompt"),
        "tool_abuse": (r"(?i)\bos\.system\b", r"(?i)\bsubprocess\b", r"(?i)\beval\s*\(", r"(?i)\bload_extension\s*\("),
    })

    def check(self, text: str) -> None:
        if not self.rules:
            raise Blocked("no firewall rules are loaded")
        for category, patterns in self.rules.items():
            if any(re.search(p, text) for p in patterns):
                raise Blocked(f"the query matches a rule of category {category}")


@dataclass(frozen=True)
class Policy:
    read_only: bool = False
    where_required: bool = True
    forbidden_tables: frozenset[str] = frozenset()
    forbidden_columns: frozenset[str] = frozenset()
    max_rows: int | None = None

    def check(self, s: Statement) -> None:
        if self.read_only and isinstance(s, Insert | Update | Delete | Create | Drop | Index):
            raise Blocked("only reading is allowed")
        if self.where_required and isinstance(s, Update | Delete) and s.where is None:
            raise Blocked("a change of rows needs a condition")
        names, columns = set(), set()
        for node in walk(s):
            if isinstance(node, Source):
                names.add(node.name)
            elif isinstance(node, Insert | Update | Delete | Create | Drop | Index):
                names.add(node.table)
            elif isinstance(node, Column):
                columns.add(node.parts[-1].lower())
        if bad := names & self.forbidden_tables:
            raise Blocked(f"forbidden tables: {sorted(bad)}")
        if bad := columns & {c.lower() for c in self.forbidden_columns}:
            raise Blocked(f"forbidden columns: {sorted(bad)}")

    def cap(self, s: Statement, df: DataFrame) -> DataFrame:
        return df if self.max_rows is None or not isinstance(s, Select | Let) else df.limit(self.max_rows)


def walk(node: object):
    """The node and all that it holds."""
    yield node
    if isinstance(node, tuple):
        for x in node:
            yield from walk(x)
    elif hasattr(node, "__dataclass_fields__"):
        for f in node.__dataclass_fields__:
            yield from walk(getattr(node, f))


#: Secrets in results, in Java's syntax.
REDACTIONS: dict[str, str] = {
    "api_key": r"(?i)\b(?:api[_-]?key|secret|token|password)\b\s*[=:]\s*[\"']?[A-Za-z0-9_\-/+=.]{8,}[\"']?",
    "access_key": r"\bAKIA[0-9A-Z]{16}\b",
    "private_key": r"-----BEGIN [A-Z ]*PRIVATE KEY-----[\s\S]*?-----END [A-Z ]*PRIVATE KEY-----",
    "email": r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}\b",
    "card": r"\b(?:\d{4}[ -]){3}\d{4}\b",
}


def redact(df: DataFrame, patterns: dict[str, str] | None = None, mask: str = "[REDACTED]") -> DataFrame:
    """Every text in the result, also inside arrays, maps and structs, with matches replaced; JVM expressions only."""
    used = REDACTIONS if patterns is None else patterns

    def clean(c, kind):
        match kind:
            case StringType():
                for p in used.values():
                    c = F.regexp_replace(c, p, mask)
                return c
            case ArrayType():
                return F.transform(c, lambda x: clean(x, kind.elementType)) if _has_text(kind.elementType) else c
            case MapType():
                return F.transform_values(c, lambda _, v: clean(v, kind.valueType)) if _has_text(kind.valueType) else c
            case StructType():
                return F.when(c.isNotNull(), F.struct(*(clean(c[f.name], f.dataType).alias(f.name) for f in kind))) if _has_text(kind) else c
        return c

    return df.select(*(clean(F.col(f"`{f.name}`"), f.dataType).alias(f.name) for f in df.schema))


def _has_text(kind) -> bool:
    match kind:
        case StringType():
            return True
        case ArrayType():
            return _has_text(kind.elementType)
        case MapType():
            return _has_text(kind.valueType)
        case StructType():
            return any(_has_text(f.dataType) for f in kind)
    return False
