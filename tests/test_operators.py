import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from glyphql.engine import Engine
from glyphql.functions.library import operator
from glyphql.functions.names import UnsupportedFunction, call, classify, date_pattern
from glyphql.lang.ast import ColumnDef
from glyphql.operators import dialects, joins, pipeline, rules, statistics, text
from glyphql.sources import files
from glyphql.streaming import ingest


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


# Joins


def people(spark):
    return spark.createDataFrame([(1, "a"), (2, "b"), (2, "c"), (None, "n")], "id int, name string")


def things(spark):
    return spark.createDataFrame([(1, 10), (2, 20), (2, 21), (None, 99), (7, 70)], "id int, v int")


def test_join_kinds_duplicates_and_nulls(spark):
    a, b = people(spark), things(spark)
    assert joins.join(a, b, "id", "id").count() == 1 + 2 * 2
    assert joins.join(a, b, "id", "id", "LEFT").count() == 6
    assert joins.join(a, b, "id", "id", "FULL").count() == 8
    assert joins.join(a, b, "id", "id", nulls_match=True).count() == 6
    assert joins.join(a, b, kind="CROSS").count() == 20
    assert joins.join(a, b.limit(0), "id", "id").count() == 0
    out = joins.join(a, b, "id", "id", condition=lambda l, r: F.col("right_v") > 20, strategy="hash")
    assert rows(out) == [(2, "b", 2, 21), (2, "c", 2, 21)] and out.columns == ["left_id", "left_name", "right_id", "right_v"]
    assert joins.join(a, b, condition=lambda l, r: F.col("left_id") < F.col("right_id")).count() == 1 * 3 + 2 * 1
    with pytest.raises(ValueError):
        joins.join(a, b)


# Library


def test_library_semantics(spark):
    one = spark.range(1)
    value = lambda c: one.select(c.alias("x")).first()["x"]
    assert value(operator("=", "10", 10.0)) and value(operator("=", "ABC", "abc")) and not value(operator("==", "ABC", "abc"))
    assert value(operator("!=", "A", "a")) and value(operator("=", F.lit(None), F.lit(None)))
    assert value(operator(">", "10", "9")) and not value(operator(">", "b", "c"))
    assert value(operator("+", "2", "3")) == "5.0" and value(operator("+", "a", "3")) == "a3"
    assert value(operator("%", -7, 3)) == 2.0 and value(operator("%", 7, -3)) == -2.0 and value(operator("/", 1, 0)) is None
    assert value(operator("LIKE", "Hello", "h_l%")) and value(operator("CONCAT", "a", F.lit(None))) == "aNone" and value(operator("TRIM", "\t a \n")) == "a"
    assert value(operator("SIMILAR", "hello", "help")) and not value(operator("SIMILAR", "xyz", "help")) and not value(operator("SIMILAR", "x", ""))
    assert value(operator("RECENT", F.lit(dt.datetime(2024, 1, 9)), "2d", dt.datetime(2024, 1, 10))) and not value(operator("RECENT", F.lit(dt.datetime(2024, 1, 1)), "7days", dt.datetime(2024, 1, 10)))
    empty = spark.createDataFrame([], "v int")
    assert tuple(empty.agg(operator("COUNT"), operator("SUM", F.col("v")), operator("AVG", F.col("v")), operator("MIN", F.col("v"))).first()) == (0, 0.0, 0.0, None)
    with pytest.raises(KeyError):
        operator("NOPE")


def test_function_names(spark):
    assert date_pattern("%Y-%m-%d %H:%i") == "yyyy-MM-dd HH:mm" and classify("json_extract") == "json" and classify("bm25") == "fts" and classify("zzz") == "unknown"
    one = lambda e: spark.range(1).select(F.expr(e)).first()[0]
    assert one(call("max", ["1", "NULL"], dialect="sqlite")) is None and one(call("glob", ["'a*'", "'abc'"], dialect="sqlite")) is True
    assert one(call("strftime", ["'%Y'", "'2024-05-06'", "'+1 year'"], dialect="sqlite")) == "2025" and one(call("quote", ["'it''s'"], dialect="sqlite")) is not None
    assert one(call("json_extract", ["'{\"a\": 3}'", "'$.a'"], dialect="sqlite")) == "3"
    for bad in ("changes", "randomblob", "nope"):
        with pytest.raises(UnsupportedFunction):
            call(bad, [], dialect="sqlite")


# Pipelines, views, rules


@pytest.fixture
def staff(spark):
    e = spark.createDataFrame([(k, f"n{k}", 1 + k % 4, 50_000.0 + 5_000 * k, k % 5 != 0) for k in range(10)], "employee_id int, name string, dept_id int, salary double, active boolean")
    d = spark.createDataFrame([(k, f"D{k}") for k in range(1, 5)], "dept_id int, department_name string")
    return {"employees": e, "departments": d}


def test_pipelines(staff):
    text_ = json.dumps({"pipelines": [
        {"name": "report", "source_tables": ["employees", "departments"], "steps": [
            {"type": "JOIN", "left": "employees", "right": "departments", "on": "employees.dept_id = departments.dept_id"},
            {"type": "AGGREGATE", "group_by": ["department_name"], "aggregations": [{"column": "salary", "function": "avg"}, {"column": "*", "function": "count", "alias": "n"}]},
            {"type": "SORT", "by": "department_name"}]},
        {"name": "high", "source_tables": ["employees"], "parameters": {"least": 70000}, "steps": [
            {"type": "FILTER", "condition": "salary >= {least} AND name IS NOT NULL"}, {"type": "PROJECT", "columns": ["employees.EMPLOYEE_ID", "salary"]}]},
    ]})
    ps = pipeline.Pipeline.load(text_)
    out = pipeline.run(ps["report"], staff)
    assert out.columns == ["department_name", "avg_salary", "n"] and out.count() == 4 and sum(r["n"] for r in out.collect()) == 10
    assert pipeline.run(ps["high"], staff).count() == 6 and pipeline.run(ps["high"], staff, {"least": 90000}).count() == 2
    P = pipeline.Pipeline
    for steps in ([{"type": "FILTER", "condition": "nope > 1"}], [{"type": "PROJECT", "columns": ["nope"]}], [{"type": "DANCE"}], [{"type": "FILTER", "condition": "salary > NOW()"}], [{"type": "FILTER", "condition": "salary >"}], [{"type": "FILTER", "condition": "salary > {gone}"}]):
        with pytest.raises(ValueError):
            pipeline.run(P("x", ("employees",), tuple(steps)), staff).count()
    same = pipeline.run(P("u", ("employees",), ({"type": "UNION", "tables": ["employees"]},)), staff)
    assert same.count() == 20


def test_views_in_order(spark, staff):
    views = pipeline.View.load(json.dumps({"views": [
        {"name": "v_high", "definition": "SELECT * FROM v_active WHERE salary > 60000", "dependencies": ["v_active"], "expected_row_count": 6},
        {"name": "v_active", "definition": "SELECT * FROM employees WHERE active", "dependencies": ["employees"]}]}))
    made = pipeline.define_views(spark, views, staff)
    assert made["v_active"].count() == 8 and all(pipeline.view_parity(views["v_high"], made["v_high"]).values())
    with pytest.raises(ValueError):
        pipeline.creation_order({"a": ("b",), "b": ("a",)})


def test_rules_and_triggers(spark):
    df = spark.createDataFrame([(1, "ab", 5.0), (2, None, -1.0), (2, "abcdef", None)], "id int, s string, v double")
    R = rules.Rule
    got = {(r["column"], r["rule"]): r["broken"] for r in rules.evaluate(df, [R("id", "UNIQUE"), R("s", "NOT_NULL"), R("s", "MIN_LENGTH", 3), R("s", "REGEX_MATCH", "ab"), R("v", "POSITIVE_NUMBER"), R("v", "MAX_VALUE", 4), R("s", "IN_SET", ["ab"]), R("gone", "NOT_NULL"), R("id", "WHAT"), R("id", "POSITIVE_INTEGER"), R("s", "CONTAINS", "cd")]).collect()}
    assert got == {("id", "UNIQUE"): 2, ("s", "NOT_NULL"): 1, ("s", "MIN_LENGTH"): 1, ("s", "REGEX_MATCH"): 0, ("v", "POSITIVE_NUMBER"): 1, ("v", "MAX_VALUE"): 1, ("s", "IN_SET"): 1, ("gone", "NOT_NULL"): 3, ("id", "WHAT"): 3, ("id", "POSITIVE_INTEGER"): 0, ("s", "CONTAINS"): 1}
    t = rules.Triggers([rules.Trigger("check", "on_ingest", "validate", "t", (R("s", "NOT_NULL"),)), rules.Trigger("log", "on_ingest", "audit_log", None, (), "{filename}: {row_count} rows{gone}")])
    out = t.replay([(rules.Event("2", "on_ingest", "t", {"filename": "f.csv", "row_count": 3}), df), (rules.Event("1", "on_ingest", "other", {"filename": "g"}), None)])
    assert (out["fired"], out["failed"]) == (3, 1) and t.audit == ["g:  rows", "f.csv: 3 rows"]


# Statistics and fingerprints


def test_statistics(spark):
    df = spark.createDataFrame([(float(k % 11), "x" * (k % 3)) for k in range(110)], "v double, s string")
    h = {r["bucket"]: r["n"] for r in statistics.histogram(df, "v").collect()}
    assert h == {**{k: 10 for k in range(9)}, 9: 20}
    s = {r["column"]: r for r in statistics.column_statistics(df).collect()}
    assert (s["v"]["ndv"], s["s"]["ndv"], s["v"]["min"], s["s"]["nulls"]) == (11, 3, "0.0", 0)
    assert statistics.common_values(df, "s", 1).first()["value"] == "" and statistics.join_rows(10, 20, 5, 4) == 40
    assert statistics.percentiles(df, "v").first()["p50"] == 5.0 and statistics.histogram(df.limit(0), "v").count() == 0


def test_fingerprints(spark):
    a = spark.createDataFrame([(1, "x", None), (2, "y", 1.5)], "i int, s string, d double")
    b = a.orderBy(F.desc("i"))
    assert statistics.exact_fingerprint(a) == statistics.exact_fingerprint(b) and statistics.quick_fingerprint(a) == statistics.quick_fingerprint(b)
    c = a.withColumn("s", F.lit("z"))
    assert statistics.exact_fingerprint(a) != statistics.exact_fingerprint(c) and statistics.quick_fingerprint(a) != statistics.quick_fingerprint(a.unionAll(a))
    assert statistics.exact_fingerprint(a, excluded=("s",)) == statistics.exact_fingerprint(c, excluded=("s",)) and statistics.exact_fingerprint(a.limit(0)) == statistics.EMPTY
    got = statistics.data_parity({"t": a, "u": a}, {"t": c, "w": a})
    assert (got["t"]["data"], got["u"]["data"], got["w"]["data"]) == ("MISMATCH", "SOURCE_ONLY", "TARGET_ONLY")


def test_constraint_parity(spark):
    e = Engine(spark)
    e.definitions["t"] = (ColumnDef("id", "int", primary=True), ColumnDef("name", "text", unique=True), ColumnDef("p", "int", required=True))
    e.foreign_key("t", "p", "parent", "id")
    have = e.constraints("t")
    same = statistics.constraint_parity({"t": have}, {"t": have | {"not_null": have["not_null"][::-1]}})["t"]
    assert same == {"primary_keys": "MATCH", "unique_constraints": "MATCH", "foreign_keys": "MATCH", "not_null": "MATCH", "indexes": "N/A", "identity_column": "N/A"}
    other = {"primary_keys": ["id", "p"], "foreign_keys": [["p", "parent", "key"]], "not_null": ["id"], "indexes": ["i"], "identity_column": "id"}
    got = statistics.constraint_parity({"t": have, "u": {}}, {"t": other, "w": other})
    assert got["t"] == {"primary_keys": "MISMATCH", "unique_constraints": "SOURCE_ONLY", "foreign_keys": "MISMATCH", "not_null": "MISMATCH", "indexes": "TARGET_ONLY", "identity_column": "TARGET_ONLY"}
    assert set(got["u"].values()) == {"N/A"} and got["w"]["primary_keys"] == "TARGET_ONLY"
    with pytest.raises(ValueError):
        statistics.constraint_parity({"t": {"keys": []}}, {})


# Text


def test_chunks_and_search(spark):
    body = "Para one.\n\n" + "A sentence here. " * 60 + "\n\nTail é."
    got = text.chunk_spans(body, 100)
    assert got[0][2] == "Para one." and all(len(c) <= 100 for _, _, c in got) and got[-1][2] == "Tail é." and all(body[s:e] == c for s, e, c in got)
    chunks = text.chunk_documents(spark.createDataFrame([("u", body), ("v", None)], "uri string, text string"), "uri", "text", size=100).collect()
    assert len(chunks) == len(got) and chunks[-1]["citation"]["end_byte"] == len(body.encode()) and len({c["chunk_id"] for c in chunks}) == len(chunks)
    docs = spark.createDataFrame([(1, "Spark makes big data simple"), (2, "big big data"), (3, "nothing"), (4, "other text"), (5, "more words"), (6, None)], "id int, body string")
    ix = text.TextIndex.build(docs, "id", "body")
    assert [r["id"] for r in ix.search("BIG data!").collect()] == [2, 1] and ix.search("").count() == 0 and ix.search("absent big").count() == 0
    assert [r["id"] for r in ix.search("big", candidates=F.col("id") == 1).collect()] == [1]
    ix = ix.upsert(spark.createDataFrame([(3, "big news")], "id int, body string"), "id", "body").delete(spark.createDataFrame([(2,)], "id int"), "id")
    assert [r["id"] for r in ix.search("big").collect()] == [3, 1]
    assert text.normalise("ÉCOLE ﬁn") == "ecole fin" and docs.select(text.normalised(F.lit("É"))).first()[0] == "e"
    known = spark.createDataFrame([("u", text.hashlib.sha256(b"same").hexdigest())], "uri string, hash string")
    arriving = spark.createDataFrame([("u", "same"), ("u", "new"), ("w", "same")], "uri string, body string")
    assert text.changed_documents(known, arriving, "uri", "body").count() == 2


def test_hybrid_narrows_before_it_ranks(spark, monkeypatch):
    monkeypatch.setattr(text, "LEXICAL_TOP", 2)
    monkeypatch.setattr(text, "VECTOR_TOP", 2)
    # Others are better in both lanes: 1 to 3 hold the word more often, and their vectors and those of 6 and 7 are nearer.
    docs = spark.createDataFrame([(i, "fr" if i < 4 else "en", "big " * max(1, 6 - i) if i < 6 else "other") for i in range(1, 12)], "id int, lang string, body string")
    v = spark.createDataFrame([(i, [1.0, 0.0] if i in (1, 2, 3, 6, 7) else [1.0, float(i)]) for i in range(1, 12)], "vec int, e array<double>")
    ix = text.TextIndex.build(docs, "id", "body")
    en = F.col("lang") == "en"
    got = text.hybrid(ix, "big", v, "vec", "e", [1.0, 0.0], en).collect()
    cosine = {i: (1 + 1 / (1 + i * i) ** 0.5) / 2 for i in (4, 5)}
    assert [r["id"] for r in got] == [4, 5] and got[0]["score"] == pytest.approx(0.35 + 0.65 * cosine[4], abs=1e-5) and got[1]["score"] > 0.1 + 0.65 * cosine[5]
    assert [tuple(r) for r in text.hybrid(ix, "absent", v, "vec", "e", [1.0, 0.0], en).collect()] == [(6, 0.75), (7, 0.75)]
    assert text.hybrid(ix, "big", v, "vec", "e", [1.0, 0.0], F.col("lang") == "de").count() == 0


def test_search_predicate_keeps_every_match(spark):
    docs = spark.createDataFrame([(i, "Big data" if i % 2 else "big" if i else None) for i in range(300)] + [(1, "data is BIG"), (None, "big, data")], "id int, body string")
    e = Engine(spark).register("d", docs).text_index("d", "body")
    assert e.query("*3[d]::id+{SEARCH('big data!')}").count() == 152 and e.query("*3[d]::d.id+{SEARCH('big')}|id<10").count() == 10
    assert e.query("*3[d]::id+{SEARCH('--')}").count() == 0
    with pytest.raises(ValueError):
        Engine(spark).register("d", docs).query("*3[d]::id+{SEARCH('big')}")


def test_index_digest_covers_texts_and_metadata(spark):
    digest = lambda *rows: text.TextIndex.build(spark.createDataFrame(rows, "key int, body string, lang string"), "key", "body").digest()
    first = digest((1, "two words", "en"), (2, None, "fr"))
    assert first == digest((2, None, "fr"), (1, "two words", "en"))
    others = [digest((1, "two others", "en"), (2, None, "fr")), digest((1, "two words", "de"), (2, None, "fr")), digest((1, "Two words", "en"), (2, None, "fr")), digest((1, "two words", "en"), (2, "", "fr"))]
    assert len({first, *others}) == 5


def test_vectors_fusion_grounding(spark):
    v = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, [0.0, 0.0]), (4, [2.0, 0.0])], "id int, e array<float>")
    near = text.nearest(v, "id", "e", [3.0, 0.0], 3)
    assert rows(near) == [(1, 1.0), (2, 0.5), (4, 1.0)]
    ids = spark.range(1, 5).select(F.col("id").cast("int"))
    lex = spark.createDataFrame([(1, 2.0), (2, 4.0)], "id int, score double")
    assert [tuple(r) for r in text.fuse(ids, lex, near).collect()] == [(1, 0.875), (2, 0.675)]
    assert text.fuse(ids, lex.limit(0), near).count() == 3
    meta = spark.createDataFrame([("a", ["x", "y"]), ("b", ["x"])], "namespace string, tags array<string>")
    assert meta.where(text.metadata_filter(meta, {"namespace": ["a", "c"], "tags": "y"})).count() == 1 and meta.where(text.metadata_filter(meta, {"namespace": "a", "gone": 1})).count() == 0
    assert [tuple(text.grounding(ids.limit(n)).first()) for n in (0, 2, 3)] == [(0, "UNGROUNDED"), (2, "PARTIAL"), (3, "GROUNDED")]


# Dialects


@pytest.mark.parametrize("dialect, source, target, want", [
    ("postgres", "varchar(255)", "mysql", "VARCHAR(255)"), ("mysql", "tinyint(1)", "postgres", "BOOLEAN"), ("mssql", "money", "postgres", "NUMERIC(19,4)"), ("oracle", "DATE", "spark", "timestamp_ntz"),
    ("postgres", "timestamp(6) with time zone", "spark", "timestamp"), ("oracle", "NUMBER(10,2)", "sqlite", "REAL"), ("postgres", "text[]", "spark", "string"), ("hana", "time", "mysql", "TEXT"), ("oracle", "NUMBER", "spark", "decimal(38,18)"),
])
def test_types(dialect, source, target, want):
    assert dialects.from_neutral(target, dialects.to_neutral(dialect, source)) == want


def test_translation():
    assert dialects.loss("oracle", "NUMBER(9,2)", "sqlite") and dialects.loss("postgres", "timestamptz", "mysql") and dialects.loss("oracle", "VARCHAR2(9)", "postgres") and not dialects.loss("postgres", "integer", "mysql")
    v = dialects.translate_view("v", "CREATE OR REPLACE FORCE VIEW v AS SELECT a FROM t WHERE f = 1", target="postgres")
    assert (v.status, v.risk) == ("TRANSLATED", "LOW") and v.sql.endswith("f = true")
    for bad in ("SELECT a FROM t UNION SELECT b FROM u", "SELECT rank() OVER (ORDER BY a) FROM t", "SELECT * FROM a LEFT JOIN b ON a.x = b.x", "SELECT * FROM (SELECT 1)", "WITH x AS (SELECT 1) SELECT * FROM x"):
        assert dialects.translate_view("v", bad).status == "UNSUPPORTED"
    for bad in ("SELECT count(*) FROM t", "SELECT a FROM t ORDER BY a", "SELECT DISTINCT a FROM t", "SELECT a.x FROM a INNER JOIN b ON a.x > b.y", "SELECT a.x FROM a, b", "SELECT x + 1 FROM t", "SELECT a FROM t WHERE x IN (SELECT y FROM u)",
                "SELECT a.x FROM a INNER JOIN b ON a.k = b.k INNER JOIN c ON b.j = c.j", "SELECT a FROM t WHERE", "SELECT", "", "SELECT a FROM t GROUP BY a"):
        assert dialects.translate_view("v", bad).status == "UNSUPPORTED", bad
    for good, risk in (("SELECT a, t.b AS c FROM s.t /* union */;", "SAFE"), ("SELECT a FROM t WHERE note = 'order by' AND b IN (1, 2)", "LOW"), ("SELECT a.x, b.y FROM a INNER JOIN b ON a.k = b.k AND a.j = b.j WHERE a.x > 3", "MEDIUM")):
        assert (dialects.translate_view("v", good).status, dialects.translate_view("v", good).risk) == ("TRANSLATED", risk), good
    assert dialects.routine_risk("-- CURSOR c\nx := 'EXECUTE IMMEDIATE'; y := 1;") == (0, ()) and dialects.routine_risk("PRAGMA x; DBMS_OUTPUT.put(1); EXECUTE IMMEDIATE q; CURSOR c IS")[0] == 100
    t, exprs = dialects.translate_trigger("CREATE TRIGGER t BEFORE INSERT ON u FOR EACH ROW BEGIN :NEW.email := LOWER(:NEW.email); END;")
    assert t.status == "TRANSLATED" and exprs == {"email": "lower(email)"}
    assert dialects.translate_trigger("CREATE TRIGGER t AFTER INSERT ON u FOR EACH ROW BEGIN :NEW.a := UPPER(:NEW.a); END;")[0].status == "UNSUPPORTED"
    assert dialects.translate_routine("RETURN NVL(SYSDATE, 1) FROM DUAL").sql == "RETURN COALESCE(CURRENT_TIMESTAMP, 1)" and dialects.translate_routine("EXECUTE IMMEDIATE 'x'").status == "UNSUPPORTED"
    assert dialects.sql_to_symbols("SELECT a, b FROM t WHERE x = 1 AND y > 2 ORDER BY a LIMIT 5;") == "*3[t]::a, b+{x = 1+y > 2}~{a}[5]>>oQ"
    assert dialects.package_summary("PROCEDURE p IS BEGIN IF x THEN util.f(1); END IF; END;")["dependencies"] == ["util"]


def test_safe_rules(spark):
    rows_ = spark.createDataFrame([("a", "ROW", "BEFORE", "SET x = 1"), ("b", "ROW", "AFTER", ""), ("c", "STATEMENT", "BEFORE", ""), ("d", "ROW", "BEFORE", "SELECT SLEEP(1)")], "name string, level string, timing string, body string")
    assert [r["name"] for r in dialects.SafeRules().safe(rows_, "mysql", "trigger").collect()] == ["a"]


# Files and streams


def test_files(spark, tmp_path):
    (tmp_path / "a.csv").write_text("id,name\n1,x\n2,y\n")
    (tmp_path / "b.json").write_text('{"data": [{"k": 1}, {"k": 2}]}')
    (tmp_path / "c.jsonl").write_text('{"k": 1}\n{"k": 5}\n')
    (tmp_path / "d.csv").write_text("7;q\n")
    config = {"tables": {"d": {"source_file": "d.csv", "format": "CSV", "config": {"delimiter": ";"}, "columns": [{"name": "n", "type": "INTEGER"}, {"name": "s", "type": "TEXT"}]}}}
    got = files.folder_tables(spark, f"file://{tmp_path}", {"tables": {}})
    assert set(got) == {"a", "b", "c", "d"} and got["a"].dtypes == [("id", "int"), ("name", "string")] and got["b"].count() == 2 and got["c"].agg(F.sum("k")).first()[0] == 6
    assert files.declared_schema(config["tables"]["d"]) == "`n` int, `s` string"
    for kind in ("parquet", "orc", "csv", "jsonl", "tsv"):
        files.write(got["a"], f"file://{tmp_path}/out_{kind}", kind, single=True)
        assert files.read(spark, f"file://{tmp_path}/out_{kind}", kind).count() == 2
    assert files.insert_statements(got["a"], "t").first()[0] == 'INSERT INTO "t" ("id", "name") VALUES (1, \'x\');'
    assert [len(b) for b in files.batches(spark.range(5), 2)] == [2, 2, 1]
    assert files.unpack(files.pack({"b": [1, "é"], "a": None})) == {"a": None, "b": [1, "é"]}
    with pytest.raises(ValueError):
        files.unpack(files.pack([1]).replace("[1]", "[2]"))
    assert files.packed(got["a"]).first()["payload"] == '{"id":1,"name":"x"}'


def test_stream_fires_rules(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "1.csv").write_text("id,s\n1,a\n2,\n")
    from glyphql.operators.rules import Rule, Trigger, Triggers

    seen = []
    t = Triggers([Trigger("log", "on_ingest", "audit_log", None, (), "{row_count}"), Trigger("v", "on_ingest", "validate", "t", (Rule("s", "NOT_NULL"),))])
    stream = ingest.watch(spark, f"file://{tmp_path}/in", "id int, s string")
    q = ingest.on_batches(stream, "t", t, f"file://{tmp_path}/cp", lambda df, b: seen.append(df.count())).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert t.audit == ["2"] and seen == [2]


def test_event_windows(spark):
    at = lambda m: dt.datetime(2024, 1, 1, 0, m)
    e = spark.createDataFrame([(1, at(0), 1.0), (1, at(4), 2.0), (1, at(20), 4.0)], "u int, ts timestamp, v double")
    assert sorted(r["n"] for r in ingest.tumbling(e, "ts", "10 minutes", "u", value="v").collect()) == [1, 2]
    assert ingest.sliding(e, "ts", "10 minutes", "5 minutes", "u").count() == 4 and ingest.sessions(e, "ts", "5 minutes", "u").count() == 2


def test_migration_resumes(spark, tmp_path):
    from glyphql.operators import migrate

    T = migrate.TableDef
    tables = [T("orders", (("id", "integer"), ("User", "text"), ("user", "jsonb[]")), ("users",)), T("users", (("id", "integer"),))]
    problems = migrate.preflight(tables, "postgres", "mysql")
    assert any("case only" in p for p in problems) and any("reserved" in p for p in problems) and migrate.ddl(tables[1], "postgres", "mysql") == "CREATE TABLE users (id INT)"
    written = []

    def write(name, df):
        if name == "orders" and len(written) < 2:
            written.append("broke")
            raise OSError
        written.append(name)

    m = migrate.Migration(spark, lambda n: spark.range(3), write, f"file://{tmp_path}/state.json")
    with pytest.raises(OSError):
        m.run(tables)
    assert m.run(tables) == {"users": 3, "orders": 3} and written == ["users", "broke", "orders"]
    migrate.write_indexed(spark.range(100), f"file://{tmp_path}/ix", "id", files=4)
    ix = spark.read.parquet(f"file://{tmp_path}/ix")
    assert migrate.point(ix, "id", 7).count() == 1 and migrate.between(ix, "id", 5, 9).count() == 5 and migrate.repeated_keys(ix, "id").count() == 0
