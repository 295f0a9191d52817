import datetime as dt
import json
import random

import pytest
from pyspark.sql import functions as F

from vigilake.operators import filesets as FS
from vigilake.operators import freshness as C
from vigilake.operators import suggestions as SG

FILES = "source string, path string, pos bigint, columns map<string,string>"
GOOD = {"id": "integer", "amount": "number"}
BAD = {"id": "integer", "amount": "string"}


def crawled(spark, *files):
    return spark.createDataFrame([("s", path, i, columns) for i, (path, columns) in enumerate(files)], FILES)


def details(df):
    return [(r.object_uri, r.change_type, r.severity, json.loads(r.detail)) for r in df.orderBy("object_uri").collect()]


@pytest.mark.parametrize("entry", [
    {"pattern": "x"}, {"name": "a"}, {"name": "a", "pattern": "x", "regex": "y"}, {"name": "a", "regex": "("}, {"name": "a", "pattern": "x", "extra": 1}, "a"])
def test_wrong_declarations_are_refused(entry):
    with pytest.raises(ValueError):
        FS.parse_filesets([entry])


def test_declarations():
    assert FS.parse_filesets(None) == [] and FS.parse_filesets([]) == []
    assert [f.name for f in FS.parse_filesets([{"name": "a", "pattern": "x"}, {"name": "b", "regex": "y"}])] == ["a", "b"]
    with pytest.raises(ValueError, match="twice"):
        FS.parse_filesets([{"name": "a", "pattern": "x"}, {"name": "a", "pattern": "y"}])


def test_first_declared_match_wins(spark):
    files = crawled(spark, ("in/orders_20260101.csv", {}), ("in/orders_x.csv", {}), ("in/other.csv", {}), ("out/daily/z.csv", {}))
    declared = FS.parse_filesets([
        {"name": "dated", "pattern": "orders_{date}.csv"}, {"name": "all", "pattern": "orders_*"}, {"name": "deep", "pattern": "out/*.csv"},
        {"name": "re", "regex": r"(?P<x>other)\.csv"}])
    assert [r.fileset for r in FS.match_filesets(files, declared).orderBy("pos").collect()] == ["dated", "all", "re", "deep"]
    assert FS.match_filesets(files, []).where("fileset is not null").count() == 0


def test_many_filesets_match_without_a_join(spark):
    files = crawled(spark, *[(f"f{i}_1.csv", {}) for i in range(0, 450, 30)])
    matched = FS.match_filesets(files, [FS.Fileset(f"n{i}", pattern=f"f{i}_{{seq}}.csv") for i in range(450)])
    assert [r.fileset for r in matched.orderBy("pos").collect()] == [f"n{i}" for i in range(0, 450, 30)]
    plan = matched._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "Exchange" not in plan


def evaluate(spark, files, previous=None):
    declared = [FS.Fileset("orders", pattern="orders_*.csv"), FS.Fileset("idle", pattern="idle_*")]
    matched = FS.match_filesets(files, declared)
    canonical = FS.canonical_schemas(matched, FS.declared(spark, declared, "s"), previous)
    return matched, canonical, FS.schema_deviations(matched, canonical, "sftp")


def test_first_schema_is_canonical_and_deviations_break(spark):
    files = crawled(spark, ("orders_0.csv", {}), ("orders_1.csv", GOOD), ("orders_2.csv", BAD), ("orders_3.csv", dict(reversed(GOOD.items()))), ("mystery.csv", GOOD))
    matched, canonical, deviations = evaluate(spark, files)
    snapshot = {r.object_uri: (r.kind, r.columns, r.pattern) for r in FS.fileset_snapshot(canonical).collect()}
    assert snapshot == {"fileset://s/orders": ("fileset", GOOD, "orders_*.csv"), "fileset://s/idle": ("fileset", {}, "idle_*")}
    assert details(deviations) == [("sftp://s//orders_2.csv", "file_schema_changed", "breaking", {"fileset": "orders", "old_columns": GOOD, "new_columns": BAD})]
    left = FS.unrecognized_files(matched.where("fileset is null"), [FS.Fileset("orders", pattern="orders_*.csv")], "sftp")
    assert details(left) == [("sftp://s//mystery.csv", "unrecognized_file", "info", {"file": "mystery.csv", "declared_filesets": ["orders"]})]


def test_canonical_schema_comes_from_the_previous_snapshot(spark):
    previous = spark.createDataFrame([("fileset://s/orders", BAD), ("fileset://s/idle", {})], "object_uri string, columns map<string,string>")
    _, canonical, deviations = evaluate(spark, crawled(spark, ("orders_1.csv", GOOD), ("orders_2.csv", BAD)), previous)
    assert {r.fileset: r.columns for r in canonical.collect()} == {"orders": BAD, "idle": {}}
    assert [e[0] for e in details(deviations)] == ["sftp://s//orders_1.csv"]


def suggest(spark, files, declared=()):
    clustered = SG.cluster_files(files)
    events = SG.suggest_filesets(clustered, FS.declared(spark, [FS.Fileset(n, pattern="-") for n in declared], "s"))
    return [e[3] for e in details(events)], sorted(r.path for r in SG.uncovered(clustered).collect())


def test_clusters_become_suggestions(spark):
    files = crawled(spark, ("orders_20260101.csv", GOOD), ("x/orders_20260102.csv", GOOD), ("customers-1.csv", {}), ("customers-2.csv", {}), ("single_7.csv", GOOD))
    found, left = suggest(spark, files)
    assert [(d["name"], d["pattern"], d["file_count"], d["columns"], d["sample_files"]) for d in found] == [
        ("customers", "customers-{seq}.csv", 2, {}, ["customers-1.csv", "customers-2.csv"]),
        ("orders", "orders_{date}.csv", 2, GOOD, ["orders_20260101.csv", "x/orders_20260102.csv"])]
    assert left == ["single_7.csv"]


def test_majority_schema_rules_the_cluster(spark):
    files = crawled(spark, ("o_1.csv", BAD), ("o_2.csv", GOOD), ("o_3.csv", GOOD), ("o_4.csv", {}))
    found, left = suggest(spark, files)
    assert (found[0]["file_count"], found[0]["columns"], left) == (3, GOOD, ["o_1.csv"])
    tie, left = suggest(spark, crawled(spark, ("o_1.csv", BAD), ("o_2.csv", GOOD), ("o_3.csv", {})))
    assert (tie[0]["columns"], left) == (BAD, ["o_2.csv"])
    none, left = suggest(spark, crawled(spark, ("o_1.csv", BAD), ("o_2.csv", GOOD)))
    assert none == [] and left == ["o_1.csv", "o_2.csv"]


def test_static_names_are_no_feed(spark):
    found, left = suggest(spark, crawled(spark, ("a/readme.txt", {}), ("b/readme.txt", {})))
    assert found == [] and left == ["a/readme.txt", "b/readme.txt"]


def test_samples_are_the_first_ten(spark):
    found, _ = suggest(spark, crawled(spark, *[(f"o_{i:03}.csv", GOOD) for i in range(25)]))
    assert found[0]["sample_files"] == [f"o_{i:03}.csv" for i in range(10)] and found[0]["file_count"] == 25


@pytest.mark.parametrize("declared, names", [
    ([], ["orders", "orders_2", "orders_3", "orders_4", "orders_5", "orders_6"]),
    (["orders"], ["orders_2", "orders_3", "orders_4", "orders_5", "orders_6", "orders_7"]),
    (["orders_2", "a"], ["orders", "orders_3", "orders_4", "orders_5", "orders_6", "orders_7"]),
    (["orders", "orders_2", "orders_4", "orders_1", "orders_02", "orders_x"], ["orders_3", "orders_5", "orders_6", "orders_7", "orders_8", "orders_9"])])
def test_names_without_collisions(spark, declared, names):
    stems = {f"orders{s}{{seq}}.{e}": "orders" for s in "-_ " for e in ("csv", "json")} | {"a{seq}": "a", "b{seq}": "b"}
    rows = spark.createDataFrame([("s", t, n) for t, n in stems.items()], "source string, template string, stem string")
    found = {r.template: r.name for r in SG.unique_names(rows, FS.declared(spark, [FS.Fileset(n, pattern="-") for n in declared], "s")).collect()}
    assert [found[t] for t in sorted(t for t, n in stems.items() if n == "orders")] == names
    assert found["b{seq}"] == "b" and found["a{seq}"] == ("a_2" if "a" in declared else "a")
    assert len(set(found.values())) == len(found) and not set(found.values()) & set(declared)


@pytest.mark.parametrize("seed", range(4))
def test_outside_suggestions_keep_their_promises(spark, seed):
    """Members exist, match, belong to one suggestion and come at least in pairs; no other suggestion could have been taken."""
    import fnmatch

    rnd = random.Random(seed)
    files = [f"{c}{i}" for c in "abc" for i in range(6)]
    suggestions = [(f"n{rnd.randint(0, 5)}", rnd.choice(["*", "a*", "b?", "[bc]*", "zz*"]), rnd.sample([*files, "made_up"], rnd.randint(1, 6))) for _ in range(9)]
    pool = spark.createDataFrame([(f, i) for i, f in enumerate(files)], "path string, pos int")
    table = spark.createDataFrame([(i, *s) for i, s in enumerate(suggestions)], "suggestion int, name string, pattern string, files array<string>")
    members = {}
    for r in SG.accept_suggestions(pool, SG.claims_of(table), ["n0"]).collect():
        members.setdefault(r.suggestion, []).append(r.path)
    matching = [{f for f in claimed if f in files and fnmatch.fnmatchcase(f, pattern)} for _, pattern, claimed in suggestions]
    for i, (name, _, _) in enumerate(suggestions):
        earlier = [k for k in members if k < i]
        free = matching[i] - {f for k in earlier for f in members[k]}
        usable = name != "n0" and name not in {suggestions[k][0] for k in earlier} and len(free) >= 2
        assert (i in members) == usable
        assert not usable or sorted(members[i]) == sorted(free)


def test_outside_suggestions_become_events(spark):
    pool = spark.createDataFrame([(f"sales_{d}.csv", i) for i, d in enumerate(["mon", "tue", "wed"])], "path string, pos int")
    table = spark.createDataFrame([(0, "sales", "sales_*.csv", ["sales_mon.csv", "sales_tue.csv", "sales_wed.csv", "none"]), (1, "", "*", ["sales_mon.csv"]),
                                   (2, None, "*", ["sales_mon.csv"])], "suggestion int, name string, pattern string, files array<string>")
    found = details(SG.suggestion_events(SG.accept_suggestions(pool, SG.claims_of(table)), "s"))
    assert found == [("fileset://s/sales", "fileset_suggested", "info", {
        "name": "sales", "pattern": "sales_*.csv", "file_count": 3, "sample_files": [f"sales_{d}.csv" for d in ("mon", "tue", "wed")], "columns": {}, "via": "external"})]


ARRIVALS = "source string, fileset string, file_name string, mtime timestamp"
START = dt.datetime(2026, 7, 1, 6)


def arrivals(spark, **feeds):
    return spark.createDataFrame([("s", f, f"{f}{i}", START + dt.timedelta(days=d)) for f, days in feeds.items() for i, d in enumerate(days)], ARRIVALS)


def test_overdue_after_twice_the_median(spark):
    df = arrivals(spark, daily=[0, 1, 2, 3, 4], gap=[0, 1, 2, 4, 5, 6], young=[0, 1], burst=[0, 0, 0])
    last = START + dt.timedelta(days=4)
    assert C.overdue_feeds(df.where("fileset = 'daily'"), str(last + dt.timedelta(days=2))).count() == 0
    late = C.overdue_feeds(df, str(last + dt.timedelta(days=3))).collect()
    assert [(r.fileset, r.median_interval_seconds, r.overdue_seconds, r.last_seen) for r in late] == [("daily", 86400, 86400, last)]
    assert {r.fileset for r in C.overdue_feeds(df, "2027-01-01").collect()} == {"daily", "gap"}
    assert C.overdue_feeds(df, str(last + dt.timedelta(days=3)), factor=5).count() == 0


def test_overdue_events(spark):
    df = C.overdue_events(C.overdue_feeds(arrivals(spark, daily=[0, 1, 2]), str(START + dt.timedelta(days=5))))
    assert details(df) == [("fileset://s/daily", "fileset_overdue", "breaking", {
        "fileset": "daily", "last_seen": "2026-07-03T06:00:00", "median_interval_seconds": 86400, "expected_by": "2026-07-05T06:00:00", "overdue_seconds": 86400})]


def test_arrivals_take_the_new_time(spark):
    schema = "source_uri string, fileset string, file_name string, mtime timestamp"
    old = spark.createDataFrame([("s", "f", "a", START), ("s", "f", "b", START), ("r", "f", "a", START)], schema)
    new = spark.createDataFrame([("s", "f", "b", START + dt.timedelta(days=1)), ("s", "f", "c", START)], schema)
    merged = {(r.source_uri, r.file_name): r.mtime for r in C.upsert_arrivals(old, new).collect()}
    assert merged == {("s", "a"): START, ("s", "b"): START + dt.timedelta(days=1), ("r", "a"): START, ("s", "c"): START}


def test_load_gap_of_the_newest_row(spark):
    days = [0, 1, 2, 3, 4, 9]
    df = spark.createDataFrame([("t", START + dt.timedelta(days=d)) for d in days], "t string, loaded_at timestamp")
    row = C.load_gap_zscore(df, ["t"]).first()
    gaps = [1, 1, 1, 1, 5]
    mean = sum(gaps) / 5
    std = (sum((g - mean) ** 2 for g in gaps) / 5) ** 0.5
    assert row.gap_seconds == 5 * 86400 and abs(row.z_score - (5 - mean) / std) < 1e-9
    even = C.load_gap_zscore(df.where(F.col("loaded_at") < F.lit(START + dt.timedelta(days=4))), ["t"]).first()
    assert even.z_score is None


def test_many_filesets_keep_the_first_match(spark):
    import random
    import re as regex
    import time

    from vigilake.functions.names import literal_ends, pattern_regex
    from vigilake.operators.filesets import Fileset, match_filesets

    assert literal_ends("orders_{date}.csv") == ("orders_", ".csv") and literal_ends("*") == ("", "") and literal_ends("a.b") == ("a.b", "a.b")
    rng = random.Random(1)
    filesets = []
    for i in range(5000):
        kind = i % 7
        spec = [f"feed{i}_{{date}}.csv", f"*_part{i}.json", f"x{i % 40}*", f"feed{i - 1}_*", f"in/{i % 50}/*.csv", f"lone{i}.txt", f"[ab]{i}?.log"][kind]
        filesets.append(Fileset(f"f{i}", pattern=spec))
    filesets[4321] = Fileset("r", regex=r"any\d+(?P<x>z)")
    names = [f"feed{rng.randrange(5000)}_2024010{rng.randint(1, 9)}.csv" for _ in range(150)]
    names += [f"q_part{rng.randrange(5000)}.json" for _ in range(80)] + [f"x{rng.randrange(60)}y" for _ in range(60)] + [f"d/in/{k}/a.csv" for k in range(4)] + [f"in/{k}/a.csv" for k in range(60)]
    names += ["any77z", "a13q.log", "b20x.log", "lone5.txt", "", "none", "feed12_", "/x1"]
    compiled = [(f, regex.compile(f.anchored.replace(r"\z", r"\Z").replace("(?<x>", "(?P<x>"))) for f in filesets]
    want = {n: next((f.name for f, c in compiled if c.match(n if "/" in f.spec else n.rsplit("/", 1)[-1])), None) for n in names}
    files = spark.createDataFrame([(n,) for n in names], "path string")
    found = {r.path: r.fileset for r in match_filesets(files, filesets).collect()}
    assert found == want and sum(v is not None for v in want.values()) > 150
    many = files.crossJoin(spark.range(200))
    seconds = []
    for some in (filesets[:201], filesets):
        query = match_filesets(many, some).groupBy("fileset").count()
        query.collect()
        start = time.time()
        query.collect()
        seconds.append(time.time() - start)
    assert seconds[1] < 10 and len(names) * 200 > 70000
    assert pattern_regex("a*") and match_filesets(files, []).where("fileset is not null").count() == 0
