"""Delimiters, headers and records over several lines, against Python's own csv reader."""

import csv
import io
import random

import pytest
from pyspark.sql import functions as F

from vigilake.sources import crawl as CR
from vigilake.sources import csv_files as CF
from vigilake.sources import files as FL


def lines_of(spark, files, splits=3):
    """Lines of {path: text}, dealt over ``splits`` blocks as a reader would."""
    rows = []
    for path, text in files.items():
        lines = text.split("\n")
        for n, line in enumerate(lines):
            rows.append((path, n * splits // len(lines), n, line))
    return spark.createDataFrame(rows, "path string, block long, n long, line string").select("path", F.struct("block", "n").alias("line_id"), "line")


def records(spark, files, splits=3, delimiter=",", **more):
    found = CF.csv_records(lines_of(spark, files, splits), delimiter, (delimiter,), **more)
    out = {}
    for r in found.select("path", "line_id.n", CF.csv_cells(F.col("line"), delimiter).alias("cells")).orderBy("path", "n").collect():
        out.setdefault(r.path, []).append(r.cells)
    return out


@pytest.mark.parametrize("splits", [1, 2, 7])
def test_records_equal_the_csv_module(spark, splits):
    rng = random.Random(splits)
    files = {}
    for k in range(12):
        out = io.StringIO()
        writer = csv.writer(out, lineterminator="\n")
        for _ in range(rng.randint(1, 40)):
            writer.writerow(["".join(rng.choices(['a', '1', '"', '\n', ',', ' ', 'x"y', '""', '\n\n', '",'], k=rng.randint(0, 6))) + "e" for _ in range(3)])
        files[f"f{k}"] = out.getvalue()
    want = {p: [r for r in csv.reader(io.StringIO(t, newline="")) if r] for p, t in files.items()}
    assert records(spark, files, splits) == want


def test_quotes_inside_plain_cells_are_text(spark):
    files = {"inch": 'a,b\n5" pipe,x\n6" pipe,y\n', "open": 'a,b\n1,"never closed\n2,x\n3,y', "later": 'a"b,"c\nd"\ne,f'}
    found = records(spark, files)
    assert found["inch"] == [["a", "b"], ['5" pipe', "x"], ['6" pipe', "y"]]
    assert len(found["open"]) == 2 and found["later"] == [['a"b', "c\nd"], ["e", "f"]]
    assert len(records(spark, files, record_lines=2)["open"]) == 4


def test_delimiters_of_a_mixed_folder(spark):
    files = {
        "comma": 'id,name\n1,"a;b;c"\n2,x\n', "semicolon": "id;price\n1;1,5\n2;2,25\n3;3\n", "tab": "a\tb\tc\n1\t2,2\t3\n4\t5\t6,6\n",
        "pipe": 'x|y\n1|"one\ntwo, three"\n2|z\n3|"f,g"', "single": "word\none\ntwo\n", "blank": "\n\n"}
    found = {r.path: r.delimiter for r in CF.find_delimiters(lines_of(spark, files)).collect()}
    assert found == {"comma": ",", "semicolon": ";", "tab": "\t", "pipe": "|", "single": ","}


def test_headers_are_told_from_data(spark):
    files = {
        "numbers": "id,price\n1,2.5\n2,3\n", "none": "1,2.5\n2,3.5\n3,4\n", "codes": "code,country\nAB,DE\nCD,FR\n", "codes_only": "AB,DE\nCD,FR\nEF,ES\n",
        "words": "first,second\nlonger,words\nthan,this\n", "only": "x,y\n", "gaps": "a,b\n1,\n,2\n", "ragged": "id\n1,7\n2,8\n"}
    typed, facts = CF.csv_columns(CF.csv_records(lines_of(spark, files), ","), None, (",",))
    header = {r.path: (r.has_header, r.num_rows) for r in facts.collect()}
    assert header == {
        "numbers": (True, 2), "none": (False, 3), "codes": (True, 2), "codes_only": (False, 3), "words": (False, 3), "only": (True, 0), "gaps": (True, 2), "ragged": (True, 2)}
    types = {(r.path, r.name): r.type for r in typed.collect()}
    assert types == {
        ("numbers", "id"): "integer/string", ("numbers", "price"): "number/string", ("codes", "code"): "string", ("codes", "country"): "string",
        ("only", "x"): "string", ("only", "y"): "string", ("gaps", "a"): "integer/string", ("gaps", "b"): "integer/string", ("ragged", "id"): "integer/string"}


def test_crawl_finds_delimiters_headers_and_records_over_split_borders(spark, tmp_path):
    rows = [(i, f'line {i}\n"second", {i}\n\nlast', i / 4) for i in range(400)]
    for name, delimiter in (("a.csv", ";"), ("b.csv", "\t"), ("c.csv", "|"), ("d.csv", ",")):
        with open(tmp_path / name, "w", newline="") as f:
            writer = csv.writer(f, delimiter=delimiter, lineterminator="\n")
            writer.writerow(["id", "text", "share"])
            writer.writerows(rows)
    (tmp_path / "bare.csv").write_text("".join(f"{i},{i / 2}\n" for i in range(9)))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2000")
    try:
        found = CR.crawl_files(spark, str(tmp_path), FL.list_files(spark, str(tmp_path), "s"), delimiter=None, header=None)
        got = {r.path.rsplit("/", 1)[1]: r["columns"] for r in found.collect()}
        assert CR.raw_lines(spark, str(tmp_path), "csv").select("line_id.block").distinct().count() > 4
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    columns = {"id": "integer/string", "text": "string", "share": "number/string"}
    assert got == {"a.csv": columns, "b.csv": columns, "c.csv": columns, "d.csv": columns, "bare.csv": {}}


def test_lines_stay_in_their_splits(spark, tmp_path, monkeypatch):
    (tmp_path / "a.csv").write_text("id,text\n" + "".join(f'{i},"line {i}\n""second"", {i}"\n' for i in range(2000)))
    kept = []
    monkeypatch.setattr(CF, "stash", lambda df, label: kept.append(df) or df)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "8000")
    try:
        lines = CR.raw_lines(spark, str(tmp_path), "csv").select("path", "line_id", F.col("raw").cast("string").alias("line"))
        assert CF.csv_records(lines, ",").count() == 2001
        plan = kept[0]._jdf.queryExecution().executedPlan().toString()
        splits = kept[0].select("block").distinct().count()
        assert splits > 3 and kept[0].where("part >= 0").count() <= 2 * splits
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert "hashpartitioning" not in plan and "SortMergeJoin" not in plan
