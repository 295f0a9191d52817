import datetime as dt
import gzip
import json
import os

import pytest
from pyspark.sql import functions as F

from vigilake.sources import apispec as A
from vigilake.sources import crawl as CR
from vigilake.sources import files as FL
from vigilake.sources import tables as TB
from vigilake.sources import text as T

TIME = dt.datetime(2024, 1, 1)


def test_reader_options():
    login = {"host": "h", "username": "u", "password": "p"}
    assert TB.reader_options("database", {**login, "drivername": "postgresql", "port": 5432}, "db") == (
        "jdbc", {"url": "jdbc:postgresql://h:5432/db", "user": "u", "password": "p"})
    assert TB.reader_options("database", {**login, "drivername": "mysql", "options": {"b": 2, "a": 1}}, "db")[1]["url"] == "jdbc:mysql://h/db?a=1&b=2"
    assert TB.reader_options("oracle", {**login, "service_name": "svc"})[1]["url"] == "jdbc:oracle:thin:@//h:1521/svc"
    assert TB.reader_options("mssql", login, "db")[1]["url"] == "jdbc:sqlserver://h:1433;databaseName=db"
    assert TB.reader_options("mssql", {**login, "port": 9}, "db")[1]["url"] == "jdbc:sqlserver://h:9;databaseName=db"
    kind, options = TB.reader_options("snowflake", {"account": "a", "user": "u", "password": "p", "role": "r", "warehouse": "w"}, "db")
    assert kind == "snowflake" and options["sfURL"] == "a.snowflakecomputing.com" and options["sfDatabase"] == "db"
    assert TB.reader_options("bigquery", {"project": "p", "credentials_path": "c"}, "d") == (
        "bigquery", {"parentProject": "p", "dataset": "d", "credentialsFile": "c"})
    with pytest.raises(NotImplementedError):
        TB.reader_options("other", {})
    assert "all_tables" in TB.schema_listing_query("oracle") and "information_schema" in TB.schema_listing_query("mssql")


def test_sampled_tables():
    assert TB.sampled_table("database", "s.t", 5) == "s.t TABLESAMPLE SYSTEM (5)"
    assert TB.sampled_table("mssql", "t", 0.5) == "t TABLESAMPLE (0.5 PERCENT)"
    assert TB.sampled_table("oracle", "t", 10) == "t SAMPLE (10)"


def test_crawl_reads_schemas(spark):
    df = spark.createDataFrame([], "id int, name string, at timestamp, tags array<string>")
    rows = sorted((r.name, r.type, r.uri) for r in TB.crawl_fields(spark, {"db://s/d/x/t": df}).collect())
    assert rows == [("at", "timestamp", "db://s/d/x/t/at"), ("id", "int", "db://s/d/x/t/id"), ("name", "string", "db://s/d/x/t/name"), ("tags", "array<string>", "db://s/d/x/t/tags")]


def test_highwater_keeps_newer_files(spark):
    listing = spark.createDataFrame([("s", "old.csv", TIME), ("s", "edge.csv", dt.datetime(2024, 1, 5)), ("s", "new.csv", dt.datetime(2024, 1, 10)), ("never", "x", TIME)],
                                    "source string, path string, mtime timestamp")
    scans = spark.createDataFrame([(1, "s", dt.datetime(2024, 1, 6), dt.datetime(2024, 1, 5)), (2, "s", dt.datetime(2024, 1, 3), dt.datetime(2024, 1, 20))],
                                  "scan_id bigint, server string, scan_time timestamp, last_modified timestamp")
    assert sorted(r.path for r in FL.newer_than_highwater(listing, scans).collect()) == ["new.csv", "x"]
    assert {r.source: r.last_modified for r in FL.highwater(listing).collect()} == {"s": dt.datetime(2024, 1, 10), "never": TIME}


@pytest.mark.parametrize("data,expected", [
    (b"plain", "utf-8"), ("Zürich".encode(), "utf-8"), ("Zürich".encode("cp1252"), "cp1252"), (b"\xef\xbb\xbfid", "utf-8-sig"), ("id".encode("utf-16"), "utf-16"),
    (b"\xfe\xff\x00i", "utf-16-be"), (b"caf\xe9 \x81", "latin-1"), ("€5".encode("cp1252"), "cp1252"), (b"", "utf-8"), (b"\xc3", "cp1252")])
def test_encodings(spark, data, expected):
    df = spark.createDataFrame([(bytearray(data),)], "content binary")
    assert FL.encoding_census(df).first().encoding == expected
    assert FL.encoding_census(df, sample_bytes=65536).first().encoding == expected


def test_encoding_looks_at_the_whole_file(spark):
    df = spark.createDataFrame([(bytearray(b"a" * 70000 + b"\xe9x"),)], "content binary")
    assert FL.encoding_census(df).first().encoding == "cp1252" and FL.encoding_census(df, 65536).first().encoding == "utf-8"


@pytest.fixture(scope="module")
def landing(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("in")
    (root / "sub").mkdir()
    files = {
        "plain.csv": b"id,name\n1,alpha\n2,beta\n", "sub/quoted.CSV": b'id,text,n\n1,"a,""b""",2.5\n2,c,3\n', "cities.csv": "id,st\xe4dt\n1,Z\xfcrich\n2,€\n".encode("cp1252"),
        "bom.csv": b"\xef\xbb\xbfid,name\r\n1,x\r\n", "wide[1].csv": "id,name\n1,x\n".encode("utf-16"), "zipped.csv.gz": gzip.compress(b"a,b\n1,\n,2\n"),
        "lines.jsonl": b'{"id":1,"p":"x"}\n{"id":2.5,"p":"y"}\nbroken\n', "list.json": b'[{"id":1},\n{"id":2}]', "one.json": b'{"q":true}', "bad.json": b"not json",
        "readme.txt": b"hello", "headeronly.csv": b"x,y\n", "twice.csv": b"a,a\n1,x\n", "odd name #1%20.csv": b"x\n1\n",
    }
    for name, data in files.items():
        (root / name).write_bytes(data)
    spark.range(7).selectExpr("id", "cast(id as string) s").coalesce(1).write.parquet(str(root / "table"))
    return str(root)


def names(df):
    return df.withColumn("name", F.regexp_replace(F.substring_index("path", "/", -1), "^part-.*", "part"))


def data_files(spark, root):
    return FL.list_files(spark, root, "s").where("path not like '%SUCCESS' and path not like '%.crc'")


def test_listing_is_recursive_and_reads_no_content(spark, landing):
    listing = data_files(spark, landing)
    sizes = {r.name: r.size for r in names(listing).collect()}
    assert sizes["plain.csv"] == 23 and "quoted.CSV" in sizes and len(sizes) == 15
    assert "content" not in listing._jdf.queryExecution().executedPlan().toString().split("ReadSchema")[1]
    flat = FL.list_files(spark, landing, "s", recursive=False)
    assert "quoted.CSV" not in {r.name for r in names(flat).collect()}


def test_crawl_of_all_formats(spark, landing):
    found = {r["name"]: (r.encoding, r["columns"], r.num_rows) for r in names(CR.crawl_files(spark, landing, data_files(spark, landing))).collect()}
    whole, text = "integer/string", "string"
    assert found == {
        "plain.csv": ("utf-8", {"id": whole, "name": text}, None),
        "quoted.CSV": ("utf-8", {"id": whole, "text": text, "n": "number/string"}, None),
        "cities.csv": ("cp1252", {"id": whole, "städt": text}, None),
        "bom.csv": ("utf-8-sig", {"id": whole, "name": text}, None),
        "wide[1].csv": ("utf-16", {"id": whole, "name": text}, None),
        "zipped.csv.gz": ("utf-8", {"a": whole, "b": whole}, None),
        "lines.jsonl": ("utf-8", {"id": "number/string", "p": text}, None),
        "list.json": ("utf-8", {"id": whole}, 2),
        "one.json": ("utf-8", {"q": "boolean/string"}, 1),
        "bad.json": ("utf-8", {}, None),
        "readme.txt": (None, {}, None),
        "headeronly.csv": ("utf-8", {"x": text, "y": text}, None),
        "twice.csv": ("utf-8", {"a": text}, None),
        "odd name #1%20.csv": ("utf-8", {"x": whole}, None),
        "part": (None, {"id": "bigint", "s": "string"}, 7),
    }


def test_broken_parquet_has_no_schema(spark, tmp_path):
    (tmp_path / "a.parquet").write_bytes(b"not parquet at all")
    row = CR.crawl_files(spark, str(tmp_path), FL.list_files(spark, str(tmp_path), "s")).first()
    assert row["columns"] == {} and row.num_rows is None


def test_spark_catalog_is_crawled(spark, tmp_path):
    spark.sql("create database if not exists crawl_db")
    spark.sql(f"create table crawl_db.t using parquet location '{tmp_path}/t' as select 1 as id, 'x' as name")
    try:
        tables = TB.catalog_tables(spark, "s", ["crawl_db"])
        assert list(tables) == ["db://s/spark_catalog/crawl_db/t"]
        assert sorted((r.name, r.type) for r in TB.crawl_fields(spark, tables).collect()) == [("id", "int"), ("name", "string")]
    finally:
        spark.sql("drop database crawl_db cascade")


def test_crawl_with_a_known_encoding(spark, landing):
    listing = data_files(spark, landing).where("path like '%/cities.csv' or path like '%/plain.csv'")
    found = {r["name"]: (r.encoding, r["columns"]) for r in names(CR.crawl_files(spark, landing, listing, encoding="cp1252")).collect()}
    assert found == {"plain.csv": ("cp1252", {"id": "integer/string", "name": "string"}), "cities.csv": ("cp1252", {"id": "integer/string", "städt": "string"})}


def test_crawl_without_schemas(spark, landing):
    rows = CR.crawl_files(spark, landing, data_files(spark, landing), get_schemas=False).collect()
    assert len(rows) == 15 and all(r["columns"] == {} and r.num_rows is None for r in rows)


def test_cells(spark):
    lines = ['a,b', '"x,1","y ""q""",', ',,', '', '1;2|"3"']
    df = spark.createDataFrame([(x,) for x in lines], "l string")
    got = [r.c for r in df.select(CR.csv_cells(F.col("l"), ",").alias("c")).collect()]
    assert got[:3] == [["a", "b"], ["x,1", 'y "q"', ""], ["", "", ""]]
    assert [r.c for r in df.select(CR.csv_cells(F.col("l"), "|").alias("c")).collect()][4] == ["1;2", "3"]
    assert [r.c for r in df.select(CR.csv_cells(F.col("l"), ";").alias("c")).collect()][4] == ["1", '2|"3"']


def test_parquet_rows(spark, landing):
    assert [r.num_rows for r in FL.parquet_rows(spark, landing + "/table").collect()] == [7]


def test_csv_reader(spark, landing):
    df = T.read_csv(spark, os.path.join(landing, "plain.csv"))
    assert {r.name: r.type for r in T.infer_columns(df).collect()} == {"id": "integer/string", "name": "string"}


def test_json_types(spark):
    doc = '{"i":1,"f":9.5,"b":true,"s":"x","n":"12","z":null,"l":[1],"o":{"a":1},"e":""}'
    df = spark.createDataFrame([(doc,), ("junk",), ("[1]",)], "d string")
    true = {r.name: r.type for r in T.infer_json_columns(df, "d").collect()}
    assert true == {"i": "integer/string", "f": "number/string", "b": "boolean/string", "s": "string", "n": "string", "z": "string", "l": "string", "o": "string", "e": "string"}
    lenient = {r.name: r.type for r in T.infer_json_columns(df, "d", lenient_numbers=True).collect()}
    assert lenient == {**true, "f": "integer/string", "b": "integer/string", "n": "integer/string"}


def test_mixed_votes(spark):
    docs = ['{"a":1,"b":true,"c":1}', '{"a":2.5,"b":1,"c":"x"}', '{"a":null}']
    df = spark.createDataFrame([(d,) for d in docs], "d string")
    assert {r.name: r.type for r in T.infer_json_columns(df, "d").collect()} == {"a": "number/string", "b": "string", "c": "string"}


def test_payloads(spark):
    rows = [("p", '[{"id":1,"total":9.5},{"id":2,"total":3}]'), ("q", '{"id":"a1"}'), ("r", "7"), ("r", "oops"), ("r", "[1,2]"), ("t", '[{"a":1},5]')]
    df = spark.createDataFrame(rows, "k string, d string")
    found = {(r.k, r.name): r.type for r in T.payload_columns(df, "d", ["k"]).collect()}
    assert found == {("p", "id"): "integer/string", ("p", "total"): "number/string", ("q", "id"): "string", ("t", "a"): "integer/string"}
    assert [r.num_rows for r in T.document_rows(df, "d").collect()] == [2, 1, None, None, 2, 2]


def test_systematic_samples(spark):
    df = spark.range(500).withColumn("k", F.col("id") % 2)
    assert sorted(r.id for r in T.systematic_sample(df, "id").collect()) == [0, 100, 200, 300, 400]
    assert T.systematic_sample(spark.range(5000), "id").count() == 50
    assert T.systematic_sample(spark.range(5000), "id", first=1000).count() == 10
    assert sorted(r.id for r in T.systematic_sample(df, "id", keys=["k"]).collect()) == [0, 1, 200, 201, 400, 401]
    assert T.systematic_sample(spark.range(50), "id", 10, 25).count() == 3


def ref(kind, name):
    return {"$ref": f"#/components/{kind}/{name}"}


def json_of(schema):
    return {"content": {"text/plain": {}, "application/vnd.sea+json": {"schema": schema}}}


SPEC = {
    "paths": {
        "/stations/{code}": {
            "parameters": [{"name": "code", "schema": {"type": "string"}}, {"name": "unit", "schema": {"type": "integer"}}],
            "get": {"parameters": [{"name": "unit", "schema": {"type": "string"}}, ref("parameters", "Page")],
                    "responses": {"500": {}, "default": {}, "206": json_of({"type": "array", "items": ref("schemas", "Reading")})}},
            "patch": {"requestBody": json_of(ref("schemas", "Sample")), "responses": {"200": json_of(ref("schemas", "Nowhere"))}},
            "x-owner": {"get": 1}, "description": "words"},
        "/mirror": {"DELETE": {"parameters": [{"name": "deep"}, {"schema": {}}], "responses": {"200": ref("responses", "Echo")}}},
        "/flat": ["no", "object"],
    },
    "components": {
        "parameters": {"Page": {"name": "page", "schema": {"type": "integer"}}},
        "responses": {"Echo": json_of(ref("schemas", "Mirror"))},
        "schemas": {
            "Reading": {"type": "object", "properties": {
                "level": {"type": "number"}, "gusts": {"type": "array", "items": ref("schemas", "Gust")}, "at": {"type": "string"},
                "same": {"$ref": "#/components/schemas/Reading/properties/at"}, "free": {}}},
            "Gust": {"type": "object"}, "Sample": ref("schemas", "Reading"), "Mirror": ref("schemas", "Mirror"),
            "Words": {"type": "array", "items": {"type": "string"}},
            "Loose": {"properties": {"a": {"$ref": "#/paths/~0"}, "b": {"$ref": "elsewhere.json"}}},
            **{f"Step{i}": ref("schemas", f"Step{i + 1}") for i in range(25)}, "Step25": {"properties": {"end": {"type": "boolean"}}}},
    },
}
READING = {"level": "number", "gusts": "array[object]", "at": "string", "same": "string", "free": "object"}


def test_api_description(spark):
    df = spark.createDataFrame([("sea", json.dumps(SPEC)), ("empty", "{}"), ("bad", "oops")], "api string, spec string")
    found = {r.object_uri: (r.kind, r.columns) for r in A.spec_snapshot(df).collect()}
    steps = {f"api://sea/components/schemas/Step{i}": ("schema", {"end": "boolean"}) for i in range(26)}
    assert found == steps | {
        "api://sea/stations/{code}#get": ("endpoint", {"param.code": "string", "param.unit": "string", "param.page": "integer",
                                                       **{f"response.{k}": v for k, v in READING.items()}}),
        "api://sea/stations/{code}#patch": ("endpoint", {"param.code": "string", "param.unit": "integer", **{f"body.{k}": v for k, v in READING.items()}}),
        "api://sea/mirror#delete": ("endpoint", {"param.deep": "object"}),
        "api://sea/components/schemas/Reading": ("schema", READING),
        "api://sea/components/schemas/Gust": ("schema", {}),
        "api://sea/components/schemas/Sample": ("schema", READING),
        "api://sea/components/schemas/Mirror": ("schema", {}),
        "api://sea/components/schemas/Words": ("schema", {}),
        "api://sea/components/schemas/Loose": ("schema", {"a": "object", "b": "object"}),
    }


def test_yaml_descriptions(spark):
    yaml = pytest.importorskip("yaml")
    df = spark.createDataFrame([("j", json.dumps(SPEC)), ("y", yaml.safe_dump(SPEC)), ("b", "a: [1"), ("n", None)], "api string, spec string")
    rows = A.spec_snapshot(A.specs_as_json(df)).collect()
    by = {api: {r.object_uri.replace(f"//{api}", "//"): r["columns"] for r in rows if r.api == api} for api in ("j", "y", "b")}
    assert by["j"] == by["y"] and len(by["j"]) == 35 and by["b"] == {}


def test_api_flatten_needs_no_shuffle(spark):
    df = spark.createDataFrame([("shop", json.dumps(SPEC))], "api string, spec string")
    assert "Exchange" not in A.spec_snapshot(df)._jdf.queryExecution().executedPlan().toString()


def test_failed_probes_keep_their_schema(spark):
    probes = spark.createDataFrame([("a", "ok", True), ("a", "none", True), ("a", "down", False), ("a", "new", False)], "api string, probe string, ok boolean")
    columns = spark.createDataFrame([("a", "ok", "id", "integer")], "api string, probe string, name string, type string")
    previous = spark.createDataFrame([("api://a/probe/down", {"x": "y"}), ("api://a/probe/gone", {"x": "y"}), ("api://a/probe/ok", {"old": "y"})], "object_uri string, columns map<string,string>")
    found = {r.object_uri: r.columns for r in A.carry_forward(A.probe_snapshot(probes, columns), previous).collect()}
    assert found == {"api://a/probe/ok": {"id": "integer"}, "api://a/probe/none": {}, "api://a/probe/down": {"x": "y"}}


def test_repeated_json_keys_keep_the_last(spark):
    lines = spark.createDataFrame([('{"a":1,"a":"x","b":3}',)], "line string")
    assert sorted(map(tuple, T.infer_json_columns(lines, "line").collect())) == [("a", "string"), ("b", "integer/string")]


def test_long_quoted_cells_take_no_stack(spark):
    from vigilake.sources.crawl import csv_cells

    cell = 'x""y,' * 40_000
    row = spark.createDataFrame([(f'1,"{cell}",2',)], "line string").select(csv_cells(F.col("line"), ",").alias("c")).first()
    assert [len(c) for c in row.c] == [1, len(cell) - 40_000, 1]


def test_parquet_files_of_unusual_types(spark, tmp_path):
    import pyarrow as pa
    import pyarrow.parquet as pq

    from vigilake.sources.crawl import parquet_footers

    pq.write_table(pa.table({"u": pa.array([1], pa.uint64()), "t": pa.array([1], pa.time32("s"))}), tmp_path / "odd.parquet")
    pq.write_table(pa.Table.from_arrays([pa.array([1]), pa.array(["x"])], names=["a", "a"]), tmp_path / "twice.parquet")
    listing = spark.createDataFrame([(f"file:{tmp_path}/{n}.parquet",) for n in ("odd", "twice")], "path string")
    found = {r.path.rsplit("/", 1)[1]: r.columns for r in parquet_footers(listing).collect()}
    assert set(found["odd.parquet"]) == {"u", "t"} and found["twice.parquet"] == {"a": "string"}
