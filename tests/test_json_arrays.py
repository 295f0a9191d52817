"""JSON arrays by element against Python's parser, and in a crawl above the size from which they are split."""

import json
import random

import pytest

from vigilake.plans import text_queries as TQ
from vigilake.sources import crawl as CR
from vigilake.sources import files as FL
from vigilake.sources import json_arrays as JA
from vigilake.sources.text import parsed_json


def made_value(rng, depth=0):
    kind = rng.randrange(7 if depth < 3 else 4)
    if kind == 0:
        return rng.randrange(1000)
    if kind == 1:
        return rng.choice([None, True, 2.5])
    if kind < 4:
        return "".join(rng.choices(['a', '"', '\\', ',', '[', ']', '{', '}', ' ', '\n', 'é', '漢', ':'], k=rng.randint(0, 8)))
    if kind == 4:
        return [made_value(rng, depth + 1) for _ in range(rng.randint(0, 4))]
    return {f"k{i}": made_value(rng, depth + 1) for i in range(rng.randint(0, 4))}


def read(spark, tmp_path, files):
    for name, text in files.items():
        (tmp_path / name).write_bytes(text if isinstance(text, bytes) else text.encode())
    elements = JA.array_elements(JA.comma_pieces(spark, [str(tmp_path)]))
    rows = {}
    for r in elements.collect():
        rows.setdefault(r.path.rsplit("/", 1)[1], []).append((r.element, r.text))
    _, counts = JA.array_records(elements, parsed_json)
    return {k: [t for _, t in sorted(v)] for k, v in rows.items()}, {r.path.rsplit("/", 1)[1]: r.num_rows for r in counts.collect()}


def test_elements_equal_the_json_module(spark, tmp_path):
    rng = random.Random(4)
    arrays = {f"f{k}.json": [made_value(rng) for _ in range(rng.randint(1, 25))] for k in range(20)}
    texts = {k: rng.choice(["", "﻿", " \n"]) + json.dumps(v, ensure_ascii=rng.random() < 0.5, indent=rng.choice([None, 1])) + rng.choice(["", "\n"]) for k, v in arrays.items()}
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "150")
    try:
        elements, counts = read(spark, tmp_path, texts)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert {k: [json.loads(t.encode("latin-1").decode()) for t in v] for k, v in elements.items()} == arrays
    assert counts == {k: len(v) for k, v in arrays.items()}


@pytest.mark.parametrize(("text", "rows"), [
    ("[]", 0), (" [ \n ] ", 0), ("[1]", 1), ('[{"a": "]"}, [1, 2], "x,y"]', 3), ("[1,]", None), ("[1", None), ('["a]', None), ("[1] x", None), ("[1],[2]", None),
    ("[1]]", None), ("[[1], 2", None), ('{"a": [1, 2]}', None), ("7", None), ("[nope]", None), ('[1, {"a": 1}, {"a" 2}]', None)])
def test_odd_documents(spark, tmp_path, text, rows):
    _, counts = read(spark, tmp_path, {"f.json": text})
    assert counts.get("f.json") == rows


def test_crawl_splits_large_arrays_only(spark, tmp_path):
    array = [{"id": i, "text": 'q"[,{' * (i % 5), "n": [{"x": i}, i / 4]} for i in range(3000)]
    (tmp_path / "large.json").write_text(json.dumps(array))
    (tmp_path / "latin.json").write_bytes(json.dumps([{"city": "Zürich"}, {"city": "x" * 3000}], ensure_ascii=False).encode("cp1252"))
    (tmp_path / "small.json").write_text(json.dumps(array[:3]))
    (tmp_path / "object.json").write_text(json.dumps({"all": array[:100], "n": 1}))
    (tmp_path / "wide[1].json").write_bytes(json.dumps([{"w": "x" * 2000}]).encode("utf-16"))
    (tmp_path / "broken.json").write_text(json.dumps(array)[:-1])
    (tmp_path / "empty.json").write_text("[" + " " * 3000 + "]")
    crawl = lambda limit: {
        r.path.rsplit("/", 1)[1]: (r.encoding, r["columns"], r.num_rows)
        for r in CR.crawl_files(spark, str(tmp_path), FL.list_files(spark, str(tmp_path), "s"), split_above=limit).collect()}
    found = crawl(1000)
    columns = {"id": "integer/string", "text": "string", "n": "string"}
    assert found == {
        "large.json": ("utf-8", columns, 3000), "small.json": ("utf-8", columns, 3), "latin.json": ("cp1252", {"city": "string"}, 2),
        "object.json": ("utf-8", {"all": "string", "n": "integer/string"}, 1), "wide[1].json": ("utf-16", {"w": "string"}, 1), "broken.json": ("utf-8", {}, None),
        "empty.json": ("utf-8", {}, 0)}
    assert crawl(1 << 30) == found


def test_files_above_the_limit_are_not_read_whole(spark, tmp_path):
    (tmp_path / "a.json").write_text("[" + ",".join("1" * 9 for _ in range(1000)) + "]")
    (tmp_path / "b.json").write_text("[1]")
    docs = CR.json_documents(spark, str(tmp_path), None, 100)
    assert docs.count() == 1
    files = docs._jdf.queryExecution().executedPlan().toString()
    assert "file_size" in files


def test_pieces_stay_in_their_splits(spark, tmp_path, monkeypatch):
    (tmp_path / "a.json").write_text(json.dumps([{"id": i, "x": [i, "a,]"]} for i in range(3000)]))
    kept = []
    monkeypatch.setattr(JA, "stash", lambda df, label: kept.append(df) or df)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        elements = JA.array_elements(JA.comma_pieces(spark, [str(tmp_path)]))
        assert elements.where("text is not null").count() == 3000
        plan = kept[0]._jdf.queryExecution().executedPlan().toString()
        splits = kept[0].select("block").distinct().count()
        assert splits > 3 and kept[0].where("not whole").count() <= 2 * splits
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert "hashpartitioning" not in plan and "SortMergeJoin" not in plan


def test_crawl_of_orders_in_any_order(spark, tmp_path):
    rng = random.Random(5)
    keys = [*range(60), *range(20, 40)]
    rng.shuffle(keys)
    rows = [(k, k * 1.5, "1-URGENT", "O", k % 7) for k in keys]
    spark.createDataFrame(rows, "o_orderkey long, o_totalprice double, o_orderpriority string, o_orderstatus string, o_custkey long").write.parquet(f"{tmp_path}/orders.parquet")
    found = {(r["name"], r.type, r.num_rows) for r in TQ.json_array_crawl(spark, str(tmp_path)).collect()}
    assert found == {(n, t, 80) for n, t in (("o_orderkey", "integer/string"), ("o_totalprice", "number/string"), ("note", "string"), ("lines", "string"))}
