import datetime as dt
import json

from pyspark.sql import functions as F

from vigilake.operators import catalog as K
from vigilake.plans.tenant import TenantState, ingest_batch

T0 = dt.datetime(2026, 1, 1)


def push(org, points, day=0):
    metrics = [{"metric_name": "row_count", "metric_value": str(v), "uri": "db://s/t/row_count", "ts": (T0 + dt.timedelta(days=d)).isoformat()} for d, v in points]
    table = {"name": "t", "uri": "db://s/t", "db_name": "d", "schema_name": "x", "fields": [{"name": "c", "type": f"type{day}", "uri": "db://s/t/c"}], "metrics": metrics}
    body = {"sources": [{"name": "s", "type": "database", "uri": "db://s", "tables": [table], "files": []}], "cli_version": "1"}
    return org, T0 + dt.timedelta(days=day), json.dumps(body)


def test_pushes_of_tenants(spark, tmp_path):
    state = TenantState(spark, str(tmp_path / "tenants"))

    def ingest(batch, *pushes):
        df = spark.createDataFrame(list(pushes), "org_id string, received_at timestamp, payload string")
        return ingest_batch(state, df, batch, now=T0 + dt.timedelta(days=99)).collect()

    history = [(d, 10 + d % 2) for d in range(20)]
    assert ingest("b1", push("o1", history), push("o2", history)) == []
    assert state.read("metrics").count() == 40
    spike = ingest("b2", push("o1", [*history, (20, 500), (21, 10)], 1), push("o2", history))
    assert [(a.org_id, a.metric_uri, a.table_uri, a.observed_value, a.algorithm, a.is_acknowledged) for a in spike] == [
        ("o1", "db://s/t/row_count", "db://s/t", 500.0, "zscore", False)]
    assert spike[0].anomaly_ts == T0 + dt.timedelta(days=20) and spike[0].z_score > 3
    assert state.read("metrics").count() == 42
    assert sorted((r.org_id, r.batch_id) for r in state.read("ingests").collect()) == [("o1", "b1"), ("o1", "b2"), ("o2", "b1")]
    assert {r.org_id: r.type for r in state.current("fields").collect()} == {"o1": "type1", "o2": "type0"}
    again = ingest("b2", push("o1", [*history, (20, 500), (21, 10)], 1))
    assert len(again) == 1 and state.read("metrics").count() == 42
    rows = K.acknowledge(state.read("anomalies"), "o1", spike[0].anomaly_id)
    assert K.anomaly_list(rows, "o1", True).count() == 0
    assert tuple(K.dashboard_counts(state.current("sources"), state.read("anomalies")).orderBy("org_id").first()) == ("o1", 1, 1)
    assert K.ingest_list(state.read("ingests"), "o1").select(F.max("batch_id")).first()[0] == "b2"


def test_two_pushes_of_one_time_and_the_same_push_of_a_newer_client(spark, tmp_path):
    state = TenantState(spark, str(tmp_path / "tenants"))
    one, other = push("o", [(0, 1)]), push("o", [(0, 1), (1, 2)])
    newer = json.loads(one[2])
    newer["cli_version"] = "2"
    again = (one[0], one[1] + dt.timedelta(days=1), json.dumps(dict(reversed(newer.items()))))
    for batch, pushes in (("b1", [one, other]), ("b2", [again])):
        ingest_batch(state, spark.createDataFrame(pushes, "org_id string, received_at timestamp, payload string"), batch, now=T0)
    assert sorted(r.batch_id for r in state.read("ingests").collect()) == ["b1", "b1"]
