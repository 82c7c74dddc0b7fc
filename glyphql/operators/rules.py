"""Validation rules over a table in one aggregate pass, and triggers that apply them to events."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

EVENTS = ("on_ingest", "on_change", "on_batch_complete")


@dataclass(frozen=True)
class Rule:
    column: str
    rule: str
    value: object = None


def _broken(r: Rule) -> Column:
    """True for a row that breaks the rule. NULL breaks only NOT_NULL."""
    c = F.col(f"`{r.column}`")
    n, text = c.try_cast("double"), c.cast("string")
    match r.rule:
        case "NOT_NULL":
            return c.isNull()
        case "POSITIVE_INTEGER":
            return F.coalesce(~((n > 0) & (n == F.floor(n))), c.isNotNull())
        case "POSITIVE_NUMBER":
            return F.coalesce(~(n > 0), c.isNotNull())
        case "CONTAINS":
            return ~F.contains(text, F.lit(str(r.value)))
        case "IN_SET":
            return ~text.isin([str(v) for v in r.value])
        case "MIN_LENGTH":
            return F.char_length(text) < int(r.value)
        case "MAX_LENGTH":
            return F.char_length(text) > int(r.value)
        case "REGEX_MATCH":
            return ~text.rlike(f"^(?:{r.value})")
        case "MIN_VALUE":
            return F.coalesce(n < float(r.value), c.isNotNull())
        case "MAX_VALUE":
            return F.coalesce(n > float(r.value), c.isNotNull())
    return F.lit(True)  # an unknown rule fails


def evaluate(df: DataFrame, rules: list[Rule]) -> DataFrame:
    """One row for each rule: ``column, rule, broken, passed``."""
    spark = df.sparkSession
    row_rules = [r for r in rules if r.rule != "UNIQUE"]
    known = [r for r in row_rules if r.column in df.columns]
    found = df.agg(F.count(F.lit(1)).alias("n"), *(F.coalesce(F.count_if(_broken(r)), F.lit(0)).alias(f"r{k}") for k, r in enumerate(known))).first()
    out = [(r.column, r.rule, int(found[f"r{k}"])) for k, r in enumerate(known)]
    out += [(r.column, r.rule, max(1, int(found["n"]))) for r in row_rules if r not in known]
    for r in rules:
        if r.rule == "UNIQUE":
            repeats = df.where(F.col(f"`{r.column}`").isNotNull()).groupBy(f"`{r.column}`").count().where("count > 1").agg(F.coalesce(F.sum("count"), F.lit(0))).first()[0]
            out.append((r.column, r.rule, int(repeats)))
    return spark.createDataFrame([(*x, x[2] == 0) for x in out], "column string, rule string, broken long, passed boolean")


@dataclass(frozen=True)
class Trigger:
    name: str
    event: str
    action: str
    source_table: str | None = None
    rules: tuple[Rule, ...] = ()
    template: str = ""


@dataclass(frozen=True)
class Event:
    event_id: str
    event_type: str
    table: str | None = None
    values: dict = field(default_factory=dict)


class Triggers:
    def __init__(self, triggers: list[Trigger], refresh: Callable[[], object] | None = None):
        unknown = [t.name for t in triggers if t.event not in EVENTS]
        if unknown:
            raise ValueError(f"unknown events of {unknown}")
        self.triggers, self.refresh, self.audit = triggers, refresh, []

    def fire(self, event: Event, df: DataFrame | None = None) -> list[dict]:
        out = []
        for t in self.triggers:
            if t.event != event.event_type or t.source_table not in (None, event.table):
                continue
            result: dict = {"trigger": t.name, "action": t.action, "passed": True}
            match t.action:
                case "validate":
                    if df is None:
                        raise ValueError(f"{t.name} needs the table's rows")
                    broken = [r.asDict() for r in evaluate(df, list(t.rules)).where("not passed").collect()]
                    result |= {"passed": not broken, "broken": broken}
                case "audit_log" | "status_report":
                    result["text"] = t.template.format_map(_Blank(event.values | {"event_id": event.event_id, "table": event.table}))
                    self.audit.append(result["text"])
                case "refresh_views":
                    result["refreshed"] = self.refresh() if self.refresh else None
                case _:
                    result |= {"passed": False, "text": f"unknown action {t.action}"}
            out.append(result)
        return out

    def replay(self, events: list[tuple[Event, DataFrame | None]]) -> dict:
        """Fires events in order of their ids, which makes totals independent of arrival."""
        results = [r for e, df in sorted(events, key=lambda x: x[0].event_id) for r in self.fire(e, df)]
        return {"fired": len(results), "passed": sum(r["passed"] for r in results), "failed": sum(not r["passed"] for r in results), "results": results}


class _Blank(dict):
    def __missing__(self, key: str) -> str:
        return ""
