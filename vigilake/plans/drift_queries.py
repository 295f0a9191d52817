"""Registered queries: schema drift, recorded changes, the gate."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vigilake.functions.changes import columns_json, describe_change
from vigilake.operators import drift as D
from vigilake.operators import reports as R
from vigilake.operators import snapshots as S
from vigilake.plans import inputs as I
from vigilake.plans.inputs import with_ctes
from vigilake.plans.profile_queries import show_ts, sql_ts

_SEVERITY = """CASE WHEN change_type IN ('table_removed', 'column_removed', 'column_type_changed', 'file_schema_changed',
  'fileset_schema_changed', 'fileset_overdue', 'endpoint_removed', 'schema_removed') THEN 'breaking' ELSE 'info' END AS severity"""


def _cols(column: str = "columns"):
    return F.to_json(columns_json(F.col(column))).alias(column)


def _diff(spark, sf_dir) -> DataFrame:
    old, new = I.old_new_snapshots(spark, sf_dir)
    return D.diff_snapshots(old, new)


def schema_diff(spark, sf_dir) -> DataFrame:
    return _diff(spark, sf_dir).where("kind in ('table', 'endpoint', 'probe')")


def schema_diff_files(spark, sf_dir) -> DataFrame:
    return _diff(spark, sf_dir).where("kind in ('file', 'fileset')")


def change_detail(spark, sf_dir) -> DataFrame:
    return _diff(spark, sf_dir).select(
        "object_uri", "change_type", "detail", describe_change(F.col("change_type"), F.col("detail")).alias("summary"))


_DETAIL_SQL = with_ctes("diff", """
, lists AS (SELECT 'obj://' || k object_uri,
    string_agg('+' || col, ', ' ORDER BY col) FILTER (WHERE ot IS NULL) plus,
    string_agg('-' || col, ', ' ORDER BY col) FILTER (WHERE nt IS NULL) minus,
    count(*) FILTER (WHERE nt IS NOT NULL) n_new, count(*) FILTER (WHERE ot IS NOT NULL) n_old FROM col_pairs GROUP BY k)
SELECT object_uri, change_type, detail, CASE
    WHEN change_type IN ('column_added', 'column_removed') THEN detail->>'column' || ' (' || (detail->>'type') || ')'
    WHEN change_type = 'column_type_changed' THEN detail->>'column' || ': ' || (detail->>'old_type') || ' -> ' || (detail->>'new_type')
    WHEN change_type LIKE '%schema_changed' THEN coalesce(nullif(concat_ws('; ', plus, minus), ''), 'column types changed')
    WHEN change_type = 'file_removed' THEN ''
    WHEN change_type LIKE '%_added' THEN n_new || ' column(s)' ELSE n_old || ' column(s)' END AS summary
FROM diff JOIN lists USING (object_uri)""")


def scan_diff_baseline(spark, sf_dir) -> DataFrame:
    """Sources 5 and 6 were never scanned: no differences, but findings of this scan."""
    old, new = I.old_new_snapshots(spark, sf_dir)
    findings = new.where("source_uri = '6'").select(
        "source_uri", "object_uri", F.lit("unrecognized_file").alias("change_type"), F.lit("info").alias("severity"),
        F.lit("{}").alias("detail"))
    old = old.where("source_uri < '5'")
    return D.diff_with_baseline(old, new, _sources(old, new), _sources(old), findings)


def _sources(*snapshots: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, [s.select("source_uri") for s in snapshots]).distinct()


def partial_scan_baseline(spark, sf_dir) -> DataFrame:
    """Source 5 was not scanned this time, source 2 has lost all objects, source 6 is new."""
    old, new = I.old_new_snapshots(spark, sf_dir)
    scanned, known = _sources(old, new).where("source_uri <> '5'"), _sources(old).where("source_uri <> '6'")
    return D.diff_with_baseline(old.where("source_uri <> '6'"), new.where("source_uri not in ('2', '5')"), scanned, known)


def _scans(history: DataFrame) -> DataFrame:
    return history.select("source_uri", "scan_id").distinct()


def _gapped(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """Scans by twice the year: one of 5-LOW found nothing, those of 2-HIGH in every second year never registered."""
    rows = I.history(spark, sf_dir).withColumn("scan_id", F.col("scan_id") * 2)
    gap = _scans(rows).where("source_uri = '5-LOW'").groupBy("source_uri").agg((F.min("scan_id") + 3).alias("scan_id"))
    registered = _scans(rows).where("not (source_uri = '2-HIGH' and scan_id % 4 = 0)")
    return rows, registered.unionByName(gap)


def schema_history_with_gaps(spark, sf_dir) -> DataFrame:
    return D.diff_history(*_gapped(spark, sf_dir)).select(
        "source_uri", "scan_id", "object_uri", "change_type", "severity", "detail")


def changes_latest_empty_scan(spark, sf_dir) -> DataFrame:
    """The newest scan of 5-LOW found no object any more: all are reported, and the gate fails."""
    rows = I.history(spark, sf_dir)
    empty = _scans(rows).where("source_uri = '5-LOW'").groupBy("source_uri").agg((F.max("scan_id") + 1).alias("scan_id"))
    scans = _scans(rows).unionByName(empty)
    latest = R.changes_of_latest_scan(D.diff_history(rows, scans), scans)
    return latest.select("source_uri", "scan_id", "object_uri", "change_type", "severity", "detail").crossJoin(
        R.gate(latest.where("source_uri = '5-LOW'")).select(F.col("failed").alias("gate_failed")))


def snapshot_merge(spark, sf_dir) -> DataFrame:
    old, new = I.old_new_snapshots(spark, sf_dir)
    named = F.when(F.col("kind") == "fileset", F.concat(F.lit("fileset://"), "object_uri")).otherwise(F.col("object_uri"))
    old, new = old.withColumn("object_uri", named), new.withColumn("object_uri", named)
    merged = S.merge_snapshots(old, new.where("kind != 'fileset'"), new.where("kind = 'fileset'"))
    return merged.select("object_uri", "kind", _cols())


def latest_snapshot(spark, sf_dir) -> DataFrame:
    rows = I.history(spark, sf_dir)
    return S.latest_snapshot(rows, _scans(rows)).select("scan_id", "source_uri", "object_uri", "kind", _cols())


def schema_history_diff(spark, sf_dir) -> DataFrame:
    rows = I.history(spark, sf_dir)
    return D.diff_history(rows, _scans(rows)).select(
        "source_uri", "scan_id", "object_uri", "change_type", "severity", "detail")


def file_snapshot(spark, sf_dir) -> DataFrame:
    return S.snapshot_from_files(I.files(spark, sf_dir), "sftp").select("object_uri", "kind", _cols())


def changes_latest(spark, sf_dir) -> DataFrame:
    """Source 5-LOW was scanned once more, without changes."""
    scans = I.history(spark, sf_dir).select("source_uri", (
        F.col("scan_id") + F.when(F.col("source_uri") == "5-LOW", 1).otherwise(0)).alias("scan_id"))
    found = R.changes_of_latest_scan(I.recorded_changes(spark, sf_dir), scans)
    return found.withColumn("summary", describe_change(F.col("change_type"), F.col("detail"))).select(
        "scan_id", "source_uri", show_ts(), "object_uri", "change_type", "severity", "summary")


def changes_since(spark, sf_dir) -> DataFrame:
    found = R.changes_since(I.recorded_changes(spark, sf_dir), "1999-06-01 00:00:00")
    return R.change_report(found).select("scan_id", "source_uri", show_ts(), "object_uri", "change_type", "severity", "summary")


def change_gate(spark, sf_dir) -> DataFrame:
    return R.gate(I.recorded_changes(spark, sf_dir), "breaking")


_SCANS = "\n, scans AS (SELECT DISTINCT source_uri, scan_id FROM hist_o)"
_EVENTS = """,
  nexts AS (SELECT source_uri, scan_id, lead(scan_id) OVER (PARTITION BY source_uri ORDER BY scan_id) nxt,
    lag(scan_id) OVER (PARTITION BY source_uri ORDER BY scan_id) prv FROM scans),
  ho AS (SELECT h.* EXCLUDE (scan_id), nxt scan_id FROM hist_o h JOIN nexts USING (source_uri, scan_id) WHERE nxt IS NOT NULL),
  hn AS (SELECT h.* FROM hist_o h JOIN nexts USING (source_uri, scan_id) WHERE prv IS NOT NULL),
  co AS (SELECT h.* EXCLUDE (scan_id), nxt scan_id FROM hist h JOIN nexts USING (source_uri, scan_id) WHERE nxt IS NOT NULL),
  cn AS (SELECT h.* FROM hist h JOIN nexts USING (source_uri, scan_id) WHERE prv IS NOT NULL),
  o AS (SELECT coalesce(n.source_uri, o.source_uri) source_uri, coalesce(n.scan_id, o.scan_id) scan_id,
    coalesce(n.object_uri, o.object_uri) object_uri, o.cols oc, n.cols nc
    FROM ho o FULL JOIN hn n ON o.source_uri = n.source_uri AND o.scan_id = n.scan_id AND o.object_uri = n.object_uri),
  c AS (SELECT coalesce(n.source_uri, o.source_uri) source_uri, coalesce(n.scan_id, o.scan_id) scan_id,
    coalesce(n.object_uri, o.object_uri) object_uri, coalesce(n.col, o.col) col, o.typ ot, n.typ nt
    FROM co o FULL JOIN cn n ON o.source_uri = n.source_uri AND o.scan_id = n.scan_id AND o.object_uri = n.object_uri AND o.col = n.col),
  ev AS (
    SELECT source_uri, scan_id, object_uri, 'table_added' change_type, '{"columns":{' || nc || '}}' detail FROM o WHERE oc IS NULL
    UNION ALL SELECT source_uri, scan_id, object_uri, 'table_removed', '{"columns":{' || oc || '}}' FROM o WHERE nc IS NULL
    UNION ALL SELECT c.source_uri, c.scan_id, c.object_uri,
      CASE WHEN ot IS NULL THEN 'column_added' WHEN nt IS NULL THEN 'column_removed' ELSE 'column_type_changed' END,
      CASE WHEN ot IS NULL THEN '{"column":"' || col || '","type":"' || nt || '"}'
           WHEN nt IS NULL THEN '{"column":"' || col || '","type":"' || ot || '"}'
           ELSE '{"column":"' || col || '","new_type":"' || nt || '","old_type":"' || ot || '"}' END
    FROM c JOIN o ON c.source_uri = o.source_uri AND c.scan_id = o.scan_id AND c.object_uri = o.object_uri
    WHERE oc IS NOT NULL AND nc IS NOT NULL AND ot IS DISTINCT FROM nt)
"""
_HISTORY = f"\nSELECT source_uri, scan_id, object_uri, change_type, {_SEVERITY}, detail FROM ev"
_REPORT = f"scan_id, source_uri, {sql_ts('ts')}, object_uri, change_type, severity, (detail->>'column') || ' (text)' AS summary"

QUERIES = {
    "schema_diff": (schema_diff, with_ctes("diff", f"""
SELECT object_uri, kind, change_type, {_SEVERITY}, detail FROM diff WHERE kind IN ('table', 'endpoint', 'probe')""")),
    "schema_diff_files": (schema_diff_files, with_ctes("diff", f"""
SELECT object_uri, kind, change_type, {_SEVERITY}, detail FROM diff WHERE kind IN ('file', 'fileset')""")),
    "change_detail": (change_detail, _DETAIL_SQL),
    "scan_diff_baseline": (scan_diff_baseline, with_ctes("snapshots", "").replace(
        "old_o AS (SELECT * FROM objects WHERE side = 'old')", "old_o AS (SELECT * FROM objects WHERE side = 'old' AND source_uri < '5')"
    ).replace("old_c AS (SELECT * FROM cells WHERE side = 'old')", "old_c AS (SELECT * FROM cells WHERE side = 'old' AND o_custkey % 7 < 5)")
        .rstrip() + "," + I.CTES["diff"] + f"""
SELECT source_uri, object_uri, change_type, {_SEVERITY}, detail FROM diff WHERE source_uri < '5'
UNION ALL SELECT source_uri, object_uri, 'unrecognized_file', 'info', '{{}}' FROM new_o WHERE source_uri = '6'"""),
    "snapshot_merge": (snapshot_merge, with_ctes("snapshots", """
, named AS (SELECT CASE WHEN kind = 'fileset' THEN 'fileset://' || object_uri ELSE object_uri END object_uri, kind, side, cols FROM objects)
SELECT object_uri, kind, '{' || cols || '}' AS "columns" FROM named n WHERE side = 'new' OR (kind <> 'fileset' AND NOT EXISTS (
  SELECT 1 FROM named m WHERE m.side = 'new' AND m.object_uri = n.object_uri))""")),
    "latest_snapshot": (latest_snapshot, with_ctes("history", """
SELECT scan_id, source_uri, object_uri, 'table' AS kind, '{' || cols || '}' AS "columns" FROM hist_o h
WHERE scan_id = (SELECT max(scan_id) FROM hist_o m WHERE m.source_uri = h.source_uri)""")),
    "schema_history_diff": (schema_history_diff, with_ctes("history", _SCANS + _EVENTS + _HISTORY)),
    "schema_history_with_gaps": (schema_history_with_gaps, with_ctes("history", """
, scans AS (SELECT DISTINCT source_uri, scan_id FROM hist_o WHERE NOT (source_uri = '2-HIGH' AND scan_id % 4 = 0)
    UNION ALL SELECT source_uri, min(scan_id) + 3 FROM hist_o WHERE source_uri = '5-LOW' GROUP BY 1)""").replace(
        "year(o_orderdate) scan_id", "year(o_orderdate) * 2 scan_id") + _EVENTS + _HISTORY),
    "changes_latest_empty_scan": (changes_latest_empty_scan, with_ctes("history", """
, scans AS (SELECT DISTINCT source_uri, scan_id FROM hist_o
    UNION ALL SELECT source_uri, max(scan_id) + 1 FROM hist_o WHERE source_uri = '5-LOW' GROUP BY 1)""") + _EVENTS + f"""
SELECT source_uri, scan_id, object_uri, change_type, {_SEVERITY}, detail, true AS gate_failed FROM ev
WHERE scan_id = (SELECT max(scan_id) FROM scans m WHERE m.source_uri = ev.source_uri)"""),
    "partial_scan_baseline": (partial_scan_baseline, with_ctes("snapshots", "").replace(
        "old_o AS (SELECT * FROM objects WHERE side = 'old')", "old_o AS (SELECT * FROM objects WHERE side = 'old' AND source_uri NOT IN ('5', '6'))"
    ).replace("new_o AS (SELECT * FROM objects WHERE side = 'new')", "new_o AS (SELECT * FROM objects WHERE side = 'new' AND source_uri NOT IN ('2', '5', '6'))"
    ).replace("old_c AS (SELECT * FROM cells WHERE side = 'old')", "old_c AS (SELECT * FROM cells WHERE side = 'old' AND o_custkey % 7 NOT IN (5, 6))"
    ).replace("new_c AS (SELECT * FROM cells WHERE side = 'new')", "new_c AS (SELECT * FROM cells WHERE side = 'new' AND o_custkey % 7 NOT IN (2, 5, 6))")
        .rstrip() + "," + I.CTES["diff"] + f"""
SELECT source_uri, object_uri, change_type, {_SEVERITY}, detail FROM diff"""),
    "file_snapshot": (file_snapshot, with_ctes("files", """
SELECT 'sftp://lake//' || path AS object_uri, 'file' AS kind, '{' || cols || '}' AS "columns" FROM files""")),
    "changes_latest": (changes_latest, with_ctes("changes", f"""
SELECT {_REPORT} FROM changes c WHERE source_uri <> '5-LOW'
  AND scan_id = (SELECT max(scan_id) FROM changes m WHERE m.source_uri = c.source_uri)""")),
    "changes_since": (changes_since, with_ctes("changes", f"""
SELECT {_REPORT} FROM changes WHERE ts >= TIMESTAMP '1999-06-01'""")),
    "change_gate": (change_gate, with_ctes("changes", """
SELECT count(*) AS total, count(*) FILTER (WHERE severity = 'breaking') AS breaking,
  count(*) FILTER (WHERE severity = 'breaking') > 0 AS failed FROM changes""")),
}
