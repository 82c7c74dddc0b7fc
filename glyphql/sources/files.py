"""Files, databases and payloads in and out. Schemas are declared where they can be; inference reads a sample."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from ..operators.managed import spark_type

SUFFIXES = {".csv": "csv", ".tsv": "tsv", ".json": "json", ".jsonl": "jsonl", ".parquet": "parquet", ".orc": "orc", ".xml": "xml", ".xlsx": "excel", ".xls": "excel", ".txt": "text", ".md": "text", ".markdown": "text"}


def read(spark: SparkSession, path: str, kind: str | None = None, schema: str | None = None, **options: object) -> DataFrame:
    """A file or folder by its suffix or ``kind``."""
    kind = kind or next((k for s, k in SUFFIXES.items() if path.rstrip("/").lower().endswith(s)), None)
    r = spark.read.options(**options)
    if schema is not None and kind not in ("excel", "text"):
        r = r.schema(schema)
    match kind:
        case "csv" | "tsv":
            r = r.option("header", options.get("header", True))
            if kind == "tsv":
                r = r.option("sep", "\t")
            return r.csv(path) if schema else r.option("inferSchema", True).option("samplingRatio", options.get("samplingRatio", 1.0)).csv(path)
        case "json":
            df = r.option("multiLine", True).json(path)
            # {"data": [...]} holds its rows one level down.
            if df.columns == ["data"] and df.schema["data"].dataType.typeName() == "array":
                return df.select(F.inline("data"))
            return df
        case "jsonl":
            return r.json(path)
        case "parquet":
            return r.parquet(path)
        case "orc":
            return r.orc(path)
        case "xml":
            return r.format("xml").load(path)
        case "text":
            return r.text(path, wholetext=True).select(F.input_file_name().alias("uri"), F.col("value").alias("text"))
        case "excel":
            import pandas as pd  # one workbook fits the driver

            return spark.createDataFrame(pd.read_excel(path))
    raise ValueError(f"unknown kind of file: {path}")


def jdbc(spark: SparkSession, url: str, table: str, partition: tuple[str, int, int, int] | None = None, **options: object) -> DataFrame:
    """partition: (numeric column, least, greatest, number of parallel reads)."""
    r = spark.read.format("jdbc").options(url=url, dbtable=table, **options)
    if partition:
        column, low, high, n = partition
        r = r.options(partitionColumn=column, lowerBound=low, upperBound=high, numPartitions=n)
    return r.load()


def declared_schema(config: dict) -> str | None:
    """The DDL of a table's declared columns."""
    columns = config.get("columns") or []
    return ", ".join(f"`{c['name']}` {spark_type(c['type'])}" for c in columns) or None


def folder_tables(spark: SparkSession, path: str, config: dict | None = None) -> dict[str, DataFrame]:
    """A table for each data file in a folder, named by its stem, or as a JSON configuration declares."""
    declared = (config or {}).get("tables", {})
    out = {}
    for name, c in declared.items():
        o = c.get("config", {})
        options = {k: v for k, v in {"sep": o.get("delimiter"), "quote": o.get("quote_char"), "encoding": o.get("encoding")}.items() if v}
        out[name] = read(spark, f"{path}/{c['source_file']}", c.get("format", "CSV").lower().replace("xlsx", "excel"), declared_schema(c), **options)
    jvm = spark._jvm
    folder = jvm.org.apache.hadoop.fs.Path(path)
    fs = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    for status in sorted(fs.listStatus(folder), key=lambda s: s.getPath().getName()):
        name = status.getPath().getName()
        stem, dot, suffix = name.rpartition(".")
        if dot and f".{suffix.lower()}" in SUFFIXES and SUFFIXES[f".{suffix.lower()}"] != "text" and stem not in out:
            out[stem] = read(spark, f"{path}/{name}")
    return out


def write(df: DataFrame, path: str, kind: str = "parquet", single: bool = False, mode: str = "errorifexists", **options: object) -> None:
    """single: one file, for results that are small."""
    w = (df.coalesce(1) if single else df).write.mode(mode).options(**options)
    match kind:
        case "csv":
            w.option("header", options.get("header", True)).csv(path)
        case "tsv":
            w.option("header", True).option("sep", "\t").csv(path)
        case "json" | "jsonl":
            w.json(path)
        case "sql":
            w.text(path)
        case _:
            w.format(kind).save(path)


def insert_statements(df: DataFrame, table: str) -> DataFrame:
    """One INSERT per row, as text."""
    def value(f):
        c = F.col(f"`{f.name}`")
        text = F.concat(F.lit("'"), F.replace(c.cast("string"), F.lit("'"), F.lit("''")), F.lit("'"))
        plain = f.dataType.typeName() in ("integer", "long", "short", "byte", "double", "float", "decimal", "boolean")
        return F.coalesce(c.cast("string") if plain else text, F.lit("NULL"))

    names = ", ".join(f'"{c}"' for c in df.columns)
    return df.select(F.concat(F.lit(f'INSERT INTO "{table}" ({names}) VALUES ('), F.concat_ws(", ", *map(value, df.schema)), F.lit(");")).alias("value"))


def batches(df: DataFrame, size: int = 1000) -> Iterator[list[Row]]:
    """Rows in chunks; the driver holds one partition and one chunk."""
    held: list[Row] = []
    for row in df.toLocalIterator(prefetchPartitions=True):
        held.append(row)
        if len(held) == size:
            yield held
            held = []
    if held:
        yield held


# Payloads: canonical JSON with its digest.


def pack(value: object) -> str:
    body = json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False)
    return json.dumps({"hash": hashlib.sha256(body.encode()).hexdigest(), "payload": body}, sort_keys=True)


def unpack(text: str) -> object:
    box = json.loads(text)
    if hashlib.sha256(box["payload"].encode()).hexdigest() != box["hash"]:
        raise ValueError("the payload does not have its hash")
    return json.loads(box["payload"])


def packed(df: DataFrame) -> DataFrame:
    """Each row as ``payload`` (JSON, keys sorted) and ``hash``."""
    body = F.to_json(F.struct(*sorted(df.columns)))
    return df.select(body.alias("payload"), F.sha2(body, 256).alias("hash"))


__all__ = ["batches", "declared_schema", "folder_tables", "insert_statements", "jdbc", "pack", "packed", "read", "unpack", "write"]
