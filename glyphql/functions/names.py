"""Functions of the language and of SQLite, in Spark SQL. Each entry turns argument texts into an expression text."""

from __future__ import annotations

from collections.abc import Callable

#: strftime-like letters of MySQL patterns and of SQLite's strftime, as date_format letters.
DATE_LETTERS = {"Y": "yyyy", "y": "yy", "m": "MM", "c": "M", "d": "dd", "e": "d", "H": "HH", "h": "hh", "i": "mm", "M": "MMMM", "b": "MMM", "W": "EEEE", "a": "E", "s": "ss", "S": "ss", "p": "a", "j": "DDD"}
SQLITE_LETTERS = DATE_LETTERS | {"M": "mm"}


class UnsupportedFunction(ValueError):
    pass


def date_pattern(text: str, letters: dict[str, str] = DATE_LETTERS) -> str:
    out, k = [], 0
    while k < len(text):
        if text[k] == "%" and k + 1 < len(text):
            if text[k + 1] == "%":
                out.append("%")
            elif text[k + 1] in letters:
                out.append(letters[text[k + 1]])
            else:
                raise UnsupportedFunction(f"date pattern %{text[k + 1]}")
            k += 2
        else:
            out.append(f"'{text[k]}'" if text[k].isalpha() else text[k])
            k += 1
    return "".join(out)


def literal(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _pattern(arg: str, letters: dict[str, str] = DATE_LETTERS) -> str:
    if not (arg.startswith("'") and arg.endswith("'")):
        raise UnsupportedFunction("a date pattern must be a literal")
    return literal(date_pattern(arg[1:-1], letters))


def _guarded(name: str) -> Callable[..., str]:
    """greatest/least that give NULL if any argument is NULL."""
    return lambda *a: f"CASE WHEN {' OR '.join(f'({x}) IS NULL' for x in a)} THEN NULL ELSE {name}({', '.join(a)}) END"


LANGUAGE: dict[str, Callable[..., str]] = {
    "DATE": lambda x: f"to_date({x})",
    "WEEK": lambda x: f"weekofyear({x})",
    "DAY": lambda x: f"dayofmonth({x})",
    "DAYNAME": lambda x: f"date_format({x}, 'EEEE')",
    "MONTHNAME": lambda x: f"date_format({x}, 'MMMM')",
    "NOW": lambda: "current_timestamp()",
    "CURRENT_DATE": lambda: "current_date()",
    "DATE_FORMAT": lambda x, p: f"date_format({x}, {_pattern(p)})",
    "STR_TO_DATE": lambda x, p: f"to_date({x}, {_pattern(p)})",
    "DATE_SUB": lambda x, i: f"({x} - {i})",
    "DATE_ADD": lambda x, i: f"({x} + {i})",
    "FORMAT": lambda x, n: f"format_number({x}, {n})",
    "GROUP_CONCAT": lambda x, sep="','": f"listagg(CAST({x} AS STRING), {sep})",
    "CONTAINS": lambda x, s: f"contains({x}, {s})",
    "STARTSWITH": lambda x, s: f"startswith({x}, {s})",
    "ENDSWITH": lambda x, s: f"endswith({x}, {s})",
    "TRIM": lambda x: f"regexp_replace({x}, '^\\\\s+|\\\\s+$', '')",
    "COUNT": lambda *a: f"count({', '.join(a) or '*'})",
}
#: Names that Spark has with the same meaning.
SAME = set(
    "sum avg min max stddev stddev_pop stddev_samp variance corr median upper lower ltrim rtrim concat substring substr length replace round floor ceil ceiling abs sqrt greatest "
    "least nullif coalesce ifnull year month hour minute second dayofweek dayofyear quarter weekofyear datediff last_day row_number rank dense_rank ntile lag lead first_value "
    "last_value nth_value cume_dist percent_rank power pow exp ln log10 log2 sign mod instr lpad rpad reverse to_date to_timestamp sha2 md5 format_number".split()
)

#: SQLite's names: same in Spark, translated, or not available (None).
SQLITE_SAME = set(
    "abs coalesce hex ifnull instr length lower ltrim nullif replace round rtrim soundex substr substring trim typeof upper avg count sum acos acosh asin asinh atan atan2 atanh "
    "ceil ceiling cos cosh degrees exp floor ln log10 log2 mod pi pow power radians sign sin sinh sqrt tan tanh row_number rank dense_rank ntile lag lead first_value last_value "
    "nth_value cume_dist percent_rank json_array_length".split()
)
SQLITE: dict[str, Callable[..., str] | None] = {
    "char": lambda *a: f"concat({', '.join(f'chr({x})' for x in a)})",
    "glob": lambda p, x: f"({x} rlike {_glob(p)})",
    "like": lambda p, x: f"({x} ilike {p})",
    "max": lambda *a: f"max({a[0]})" if len(a) == 1 else _guarded("greatest")(*a),
    "min": lambda *a: f"min({a[0]})" if len(a) == 1 else _guarded("least")(*a),
    "printf": lambda f, *a: f"format_string({', '.join([f, *a])})",
    "format": lambda f, *a: f"format_string({', '.join([f, *a])})",
    "quote": lambda x: f"coalesce(concat('\\'', replace({x}, '\\'', '\\'\\''), '\\''), 'NULL')",
    "random": lambda: "CAST(rand(0) * 9223372036854775807 AS BIGINT)",
    "unicode": lambda x: f"ascii({x})",
    "likely": lambda x: x, "unlikely": lambda x: x, "likelihood": lambda x, p: x,
    "group_concat": lambda x, sep="','": f"listagg(CAST({x} AS STRING), {sep})",
    "total": lambda x: f"coalesce(sum(CAST({x} AS DOUBLE)), 0.0D)",
    "date": lambda x, *m: f"to_date({_moved(x, m)})",
    "time": lambda x, *m: f"date_format({_moved(x, m)}, 'HH:mm:ss')",
    "datetime": lambda x, *m: f"to_timestamp({_moved(x, m)})",
    "strftime": lambda p, x, *m: f"date_format({_moved(x, m)}, {_pattern(p, SQLITE_LETTERS)})",
    "julianday": lambda x, *m: f"(unix_micros(to_timestamp({_moved(x, m)})) / 86400000000.0D + 2440587.5D)",
    "unixepoch": lambda x, *m: f"unix_seconds(to_timestamp({_moved(x, m)}))",
    "timediff": lambda a, b: f"(to_timestamp({a}) - to_timestamp({b}))",
    "log": lambda *a: f"log10({a[0]})" if len(a) == 1 else f"log({', '.join(a)})",
    "trunc": lambda x: f"(sign({x}) * floor(abs({x})))",
    "json_extract": lambda j, p: f"get_json_object({j}, {p})",
    "json_valid": lambda j: f"(try_parse_json({j}) IS NOT NULL)",
    "json_array": lambda *a: f"to_json(array({', '.join(a)}))",
    "json_object": lambda *a: f"to_json(map({', '.join(a)}))",
    "json_quote": lambda x: f"concat('\"', {x}, '\"')",
    "json_group_array": lambda x: f"to_json(collect_list({x}))",
    "json_group_object": lambda k, v: f"to_json(map_from_entries(collect_list(struct({k}, {v}))))",
    "json_type": lambda j: f"schema_of_json({j})",
} | dict.fromkeys(
    "changes total_changes last_insert_rowid load_extension randomblob zeroblob sqlite_version sqlite_source_id sqlite_compileoption_get sqlite_compileoption_used json_insert "
    "json_patch json_remove json_replace json_set json_tree json_each match bm25 highlight snippet offsets matchinfo".split()
)
JSON_NAMES = {n for n in (*SQLITE, *SQLITE_SAME) if n.startswith("json")}
FTS_NAMES = {"match", "bm25", "highlight", "snippet", "offsets", "matchinfo"}


def _glob(pattern: str) -> str:
    import re

    body = pattern[1:-1]
    return literal("^" + "".join({"*": ".*", "?": "."}.get(c, re.escape(c)) for c in body) + "$")


def _moved(x: str, modifiers: tuple[str, ...]) -> str:
    """A date with SQLite modifiers such as '+7 days' as interval arithmetic."""
    import re

    out = "current_timestamp()" if x.lower() == "'now'" else f"to_timestamp({x})"
    for m in modifiers:
        body = m.strip("'").strip()
        if got := re.fullmatch(r"([+-]?)(\d+) (second|minute|hour|day|month|year)s?", body):
            out = f"({out} {got[1] or '+'} INTERVAL {got[2]} {got[3].upper()})"
        elif body == "start of month":
            out = f"date_trunc('month', {out})"
        elif body == "start of year":
            out = f"date_trunc('year', {out})"
        elif body == "start of day":
            out = f"date_trunc('day', {out})"
        else:
            raise UnsupportedFunction(f"date modifier {m}")
    return out


def classify(name: str) -> str:
    """builtin, json, fts or unknown, as SQLite knows the name."""
    n = name.lower()
    if n in FTS_NAMES:
        return "fts"
    if n in JSON_NAMES:
        return "json"
    return "builtin" if n in SQLITE or n in SQLITE_SAME else "unknown"


def call(name: str, args: list[str], distinct: bool = False, dialect: str = "language") -> str:
    upper, lower = name.upper(), name.lower()
    if distinct:
        if lower not in ("count", "sum", "avg", "min", "max", "group_concat"):
            raise UnsupportedFunction(f"{name}(DISTINCT ...)")
        return f"{'listagg' if lower == 'group_concat' else lower}(DISTINCT {', '.join(args)})"
    if dialect == "sqlite":
        if lower in SQLITE:
            if SQLITE[lower] is None:
                raise UnsupportedFunction(f"{name} is not available")
            return SQLITE[lower](*args)
        if lower in SQLITE_SAME:
            return f"{lower}({', '.join(args)})"
        raise UnsupportedFunction(f"unknown function {name}")
    if upper in LANGUAGE:
        return LANGUAGE[upper](*args)
    if lower in SAME:
        return f"{lower}({', '.join(args)})"
    raise UnsupportedFunction(f"unknown function {name}")
