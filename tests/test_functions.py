import os

import pytest
from pyspark.sql import functions as F

from vigilake.functions import names as N
from vigilake.functions.changes import describe_change, severity
from vigilake.functions.text_types import generic_class, infer_text_type, pick_type, render_type


def one_column(spark, values, fn, kind="string"):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r[0] for r in rows.orderBy("i").select(fn(F.col("v"))).collect()]


def python_type(text):
    if text is None or text == "":
        return None
    for name, parse in (("integer", int), ("number", float)):
        try:
            parse(text)
            return name
        except ValueError:
            pass
    return "string"


def test_text_types_agree_with_python_parsing(spark):
    values = [None, "", " ", "1", " 7 ", "-3", "+4", "1_000", "1__0", "_1", "1.", ".5", "1e5", "1E-3", "1_0.5", "1d", "0x10", "nan",
              "INF", "-Infinity", "abc", "1,5", "2026-07-01", "١", "1 2", "e5", ".", "+-1", "1.5.2", "infinit", "-.5e+3"]
    values.remove("١")
    assert one_column(spark, values, infer_text_type) == [python_type(v) for v in values]


@pytest.mark.parametrize("votes,expected", [
    ((3, 0, 0), "integer"), ((0, 2, 0), "number"), ((1, 2, 0), "number"), ((1, 0, 1), "string"), ((0, 0, 0), "string"), ((1, 1, 1), "string")])
def test_pick_type(spark, votes, expected):
    row = spark.range(1).select(pick_type(*[F.lit(v) for v in votes]).alias("t"))
    assert row.first().t == expected
    shown = row.select(render_type(F.col("t"))).first()[0]
    assert shown == (expected if expected == "string" else expected + "/string")


def test_generic_class(spark):
    kinds = ["int", "decimal(10,2)", "varchar(5)", "timestamp_ntz", "array<int>", "boolean"]
    assert one_column(spark, kinds, generic_class) == ["integer", "number", "string", "date-time", "nested", "boolean"]


def test_templates(spark):
    cases = {
        "in/orders_20260709.csv": "orders_{date}.csv",
        "orders_2026-07-09.csv": "orders_{date}.csv",
        "export_20260709T121500.jsonl": "export_{date}{time}.jsonl",
        "snap_12:15:00.csv": "snap_{time}.csv",
        "part-00001.csv": "part-{seq}.csv",
        "dump-123e4567-e89b-12d3-a456-426614174000.parquet": "dump-{uuid}.parquet",
        "readme.txt": "readme.txt",
    }
    assert one_column(spark, list(cases), N.name_template) == list(cases.values())


def test_stems(spark):
    cases = {"orders_{date}.csv": "orders", "{seq}.csv": "fileset", "-x-{uuid}-.gz": "x", "{date}_a.b_{seq}.csv": "a.b", "plain": "plain"}
    assert one_column(spark, list(cases), N.suggested_stem) == list(cases.values())


def test_file_types(spark):
    cases = {"A.CSV": ("csv", "csv"), "a.csv.gz": ("csv.gz", "csv"), "x": ("unknown", None), "x.gz": ("unknown.gz", None),
             "a/b.parquet": ("parquet", "parquet"), "k.jsonl": ("jsonl", "jsonl"), "k.json": ("json", "json"), "s.xlsx": ("xlsx", "xlsx"), "r.txt": ("txt", None)}
    assert one_column(spark, list(cases), N.file_type) == [v[0] for v in cases.values()]
    assert one_column(spark, list(cases), N.reader_for) == [v[1] for v in cases.values()]


PATTERNS = ["orders_{date}.csv", "b?[a-c]*.x", "e[!0-9]{uuid}.y", "n{date}{time}.z", "a[b", r"r\d+(.csv", "[]x]y", "q[^a]", "ü*&é", "{seq}{time}"]


def test_pattern_column_equals_pattern_function(spark):
    assert one_column(spark, PATTERNS, N.pattern_regex_col) == [N.pattern_regex(p) for p in PATTERNS]


@pytest.mark.parametrize("pattern,yes,no", [
    ("orders_{date}.csv", ["orders_20260709.csv", "orders_2026-07-09.csv"], ["orders_x.csv", "orders_20260709.csv.bak", "xorders_20260709.csv"]),
    ("batch_{seq}.parquet", ["batch_1.parquet", "batch_000123.parquet"], ["batch_.parquet"]),
    ("export_{uuid}.jsonl", ["export_123e4567-e89b-12d3-a456-426614174000.jsonl"], ["export_123.jsonl"]),
    ("b?[a-c]*.x", ["bzafoo.x", "b1c.x"], ["bad.x", "bzz.x"]),
    ("e[!0-9].y", ["ea.y"], ["e1.y"]),
    ("x_{date}{time}.z", ["x_20260709T121500.z", "x_20260709121500.z"], ["x_20260709.z"]),
    ("a[[]1].csv", ["a[1].csv"], ["a1.csv"]),
])
def test_patterns_match_whole_names(spark, pattern, yes, no):
    regex = N.pattern_regex(pattern)
    assert one_column(spark, yes, lambda c: c.rlike(regex)) == [True] * len(yes)
    assert one_column(spark, no, lambda c: c.rlike(regex)) == [False] * len(no)


def test_suggested_patterns_match_their_own_files(spark):
    files = ["a*{x}[1].csv", "orders_20260709T121500.csv", "q?1.x", "p-12:00:01-2026.01.02.y", "ü 5 (2).csv"]
    rows = spark.createDataFrame([(f,) for f in files], "f string")
    rows = rows.withColumn("r", N.pattern_regex_col(N.template_pattern(N.name_template(F.col("f")))))
    assert rows.where(F.expr("f rlike r")).count() == len(files)


def test_compiles(spark):
    assert one_column(spark, ["a*", "[a-z]", "[z-a]x", "[!b-a]"], N.compiles) == [True, True, False, False]


def test_severity(spark):
    cases = {"table_removed": "breaking", "fileset_removed": "info", "probe_removed": "info", "fileset_overdue": "breaking",
             "column_added": "info", "schema_removed": "breaking", "unrecognized_file": "info", "file_schema_changed": "breaking"}
    assert one_column(spark, list(cases), severity) == list(cases.values())


def test_descriptions(spark):
    cases = [
        ("column_added", '{"column":"a","type":"int"}', "a (int)"),
        ("column_type_changed", '{"column":"a","old_type":"int","new_type":"string"}', "a: int -> string"),
        ("file_schema_changed", '{"fileset":"f","old_columns":{"a":"x","b":"x"},"new_columns":{"a":"x","d":"x","c":"x"}}', "fileset f: +c, +d; -b"),
        ("fileset_schema_changed", '{"old_columns":{"a":"x"},"new_columns":{"a":"y"}}', "column types changed"),
        ("unrecognized_file", '{"file":"x"}', "matches no declared fileset"),
        ("fileset_overdue", '{"last_seen":"2026-07-05T06:00:00","expected_by":"2026-07-07T06:00:00","median_interval_seconds":86400}',
         "no file since 2026-07-05T06:00 — expected a new one by 2026-07-07T06:00 (arrives ~every 24.0h)"),
        ("fileset_suggested", '{"file_count":3,"name":"n","pattern":"p_*"}', '3 files look like a fileset — declare name: n, pattern: "p_*"'),
        ("table_added", '{"columns":{"a":"x","b":"y"}}', "2 column(s)"),
        ("file_added", '{"columns":{}}', ""),
        ("file_removed", '{"columns":{"a":"x"}}', ""),
        ("else", "{}", ""),
    ]
    rows = spark.createDataFrame(cases, "t string, d string, e string")
    for row in rows.withColumn("s", describe_change(F.col("t"), F.col("d"))).collect():
        assert row.s == row.e, row.t


def test_base_names_as_in_python(spark):
    paths = ["a/b/c", "c", "a/", "/x.csv", "sftp://h//d/e.f"]
    assert one_column(spark, paths, N.base_name) == [os.path.basename(p) for p in paths]
