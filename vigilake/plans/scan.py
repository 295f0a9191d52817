"""Whole scans: a database source, a file source; snapshot, compare, record, register."""

from __future__ import annotations

import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vigilake.fixed import OVERDUE_FACTOR
from vigilake.operators import filesets as FS
from vigilake.operators import freshness as C
from vigilake.operators import metrics as M
from vigilake.operators import suggestions as SG
from vigilake.operators.drift import diff_snapshots
from vigilake.operators.profile import profile_tables
from vigilake.operators.snapshots import merge_snapshots, snapshot_from_fields, snapshot_from_files
from vigilake.plans.state import State
from vigilake.session import cut_lineage
from vigilake.sources.crawl import crawl_files
from vigilake.sources.tables import crawl_fields

# Tables profiled by one job; a catalog of any size is a sequence of such jobs.
_TABLES_PER_JOB = 32
_NO_EVENTS = "object_uri string, change_type string, severity string, detail string"


def _now() -> datetime.datetime:
    return datetime.datetime.now(datetime.timezone.utc).replace(tzinfo=None)


def _instant(value: datetime.datetime):
    return F.lit(value.isoformat(sep=" ")).cast("timestamp")


def _record(state: State, source: str, scan_id: int, source_uri: str, snapshot: DataFrame, findings: DataFrame | None,
            last_modified, now: datetime.datetime) -> int:
    """Write snapshot and changes, then register the scan: the step that makes it count."""
    spark, last = state.spark, state.last_scan(source)
    state.append("snapshots", snapshot.withColumn("source_uri", F.lit(source_uri)), source, scan_id)
    changes = spark.createDataFrame([], _NO_EVENTS) if findings is None else findings
    if last is not None:
        stored = state.snapshot(source, scan_id, running=True)
        changes = diff_snapshots(state.snapshot(source, last.scan_id), stored).drop("kind").unionByName(changes)
    state.append("changes", changes.withColumn("source_uri", F.lit(source_uri)).withColumn("ts", _instant(now)), source, scan_id)
    scan = spark.range(1).select(F.lit(source_uri).alias("source_uri"), F.lit(source).alias("server"), _instant(now).alias("scan_time"),
                                 F.lit(last_modified).cast("timestamp").alias("last_modified"))
    state.append("scans", scan, source, scan_id)
    return scan_id


def scan_tables(
    state: State, source: str, tables: dict[str, DataFrame], analyze: bool = True, heavy: bool = False, approx: bool = False,
    sample_percent: float | None = None, profiles: dict[str, DataFrame] | None = None,
    now: datetime.datetime | None = None,
) -> int:
    """Scan a database source given as tables by address; returns the scan id.

    ``profiles`` holds one-row profiles by address where the database made them.
    ``heavy`` adds distinct counts, by sketches with ``approx``. A source may have no
    tables left: that is a scan too, and its earlier tables are reported as removed.
    """
    now, scan_id, source_uri = now or _now(), state.start(source), f"db://{source}"
    fields = crawl_fields(state.spark, tables)
    parts = F.split("owner_uri", "/")
    state.append("fields", fields, source, scan_id)
    state.append("tables", fields.select("owner_uri").distinct().select(
        F.lit(source_uri).alias("source_uri"), F.col("owner_uri").alias("uri"), F.element_at(parts, -1).alias("name"),
        F.element_at(parts, -3).alias("db_name"), F.element_at(parts, -2).alias("schema_name")), source, scan_id)
    if analyze and tables:
        uris, points = list(tables), None
        for start in range(0, len(uris), _TABLES_PER_JOB):
            some = {uri: tables[uri] for uri in uris[start : start + _TABLES_PER_JOB]}
            part = cut_lineage(profile_tables(
                some, _instant(now), heavy=heavy, approx=approx, profiles=profiles, sample_percent=sample_percent))
            points = part if points is None else points.unionByName(part)
        state.append("metrics", points, source, scan_id)
    return _record(state, source, scan_id, source_uri, snapshot_from_fields(fields), None, now.isoformat(sep=" "), now)


def scan_files(
    state: State, source: str, protocol: str, listing: DataFrame, root: str | None = None,
    crawled: DataFrame | None = None, filesets: list[dict] | None = None, get_schemas: bool = True,
    alert_unrecognized: bool = True, infer_filesets: bool = True, outside_claims: DataFrame | None = None,
    freshness: bool = True, freshness_factor: float = OVERDUE_FACTOR, file_metrics: bool = True,
    delimiter: str = ",", encoding: str | None = None, now: datetime.datetime | None = None,
) -> int:
    """Scan a file source: only files newer than its last scan are looked into.

    ``listing`` has ``source, path, size, mtime``. Schemas come from the files under
    ``root``, or ready-made from ``crawled`` (``path, columns, num_rows``).
    """
    spark, now, declared = state.spark, now or _now(), FS.parse_filesets(filesets)
    scan_id, last, source_uri = state.start(source), state.last_scan(source), f"{protocol}://{source}/"
    since = last.last_modified if last is not None else None
    fresh = listing if since is None else listing.where(F.col("mtime") > F.lit(since).cast("timestamp"))
    if crawled is None:
        after = since[:19].replace(" ", "T") if since else None
        found = crawl_files(spark, root, fresh, after, get_schemas, delimiter, encoding)
    else:
        found = fresh.join(crawled, "path", "left").withColumn(
            "columns", F.coalesce("columns", F.expr("cast(map() as map<string,string>)")))
    # Order of arrival, then name: what "first file" means for canonical schemas and ties.
    if "pos" not in found.columns:
        found = found.withColumn("pos", F.struct("mtime", "path"))
    found = cut_lineage(FS.match_filesets(found, declared))

    previous = spark.createDataFrame([], "source_uri string, object_uri string, kind string, columns map<string,string>")
    if last is not None:
        previous = state.snapshot(source, last.scan_id)
    declarations = FS.declared(spark, declared, source)
    canonical = cut_lineage(FS.canonical_schemas(found, declarations, previous))
    events = FS.schema_deviations(found, canonical, protocol)
    unmatched = found.where("fileset is null")
    if infer_filesets:
        clustered = cut_lineage(SG.cluster_files(unmatched))
        suggested = cut_lineage(SG.suggest_filesets(clustered, declarations))
        events = events.unionByName(suggested)
        unmatched = SG.uncovered(clustered)
    if outside_claims is not None:
        if infer_filesets:
            # Names of this scan's own suggestions are taken.
            own = suggested.select(F.get_json_object("detail", "$.name").alias("name"))
            outside_claims = outside_claims.join(own, "name", "left_anti")
        accepted = SG.accept_suggestions(unmatched, outside_claims, [f.name for f in declared])
        events = events.unionByName(SG.suggestion_events(accepted, source))
        unmatched = unmatched.join(accepted.select("path"), "path", "left_anti")
    if alert_unrecognized and declared:
        events = events.unionByName(FS.unrecognized_files(unmatched, declared, protocol))
    matched = found.where("fileset is not null")
    if declared and freshness:
        state.append("arrivals", matched.select(
            F.lit(source_uri).alias("source_uri"), "fileset", F.col("path").alias("file_name"), "mtime"), source, scan_id)
        log = state.read("arrivals", (source, scan_id)).where(F.col("source") == source)
        arrivals = C.latest_arrivals(log, "scan_id").withColumn("source", F.lit(source))
        events = events.unionByName(C.overdue_events(C.overdue_feeds(arrivals, _instant(now), freshness_factor)))
    if declared and file_metrics:
        # Only the stored points of the batch's time span can collide; the span reaches the parquet filter.
        span = matched.agg(*[F.date_format(f("mtime"), "yyyy-MM-dd HH:mm:ss.SSSSSS") for f in (F.min, F.max)]).first()
        stored = state.read("metrics").where(
            (F.col("source") == source) & (F.col("scan_id") < scan_id)
            & F.col("ts").between(F.lit(span[0]).cast("timestamp"), F.lit(span[1]).cast("timestamp")))
        state.append("metrics", M.new_points(M.fileset_metrics(matched), stored), source, scan_id)
    _append_file_catalog(state, source, source_uri, protocol, found, scan_id)
    current = snapshot_from_files(found, protocol)
    snapshot = merge_snapshots(previous, current, FS.fileset_snapshot(canonical))
    newest = listing.agg(F.date_format(F.max("mtime"), "yyyy-MM-dd HH:mm:ss.SSSSSS")).first()[0]
    return _record(state, source, scan_id, source_uri, snapshot, events, newest, now)


def _append_file_catalog(state: State, source: str, source_uri: str, protocol: str, found: DataFrame, scan_id: int) -> None:
    from vigilake.functions.names import file_type
    from vigilake.functions.uris import file_uri

    uri = file_uri(protocol, F.col("source"), F.col("path"))
    encoding = F.coalesce("encoding", F.lit("utf-8")) if "encoding" in found.columns else F.lit("utf-8")
    state.append("files", found.select(
        F.lit(source_uri).alias("source_uri"), uri.alias("uri"), F.col("path").alias("name"),
        file_type(F.col("path")).alias("filetype"), encoding.alias("file_encoding")), source, scan_id)
    fields = found.select(uri.alias("owner_uri"), F.explode("columns").alias("name", "type"))
    state.append("fields", fields.withColumn("uri", F.concat_ws("/", "owner_uri", "name")), source, scan_id)


def scan_snapshot(state: State, source: str, source_uri: str, snapshot: DataFrame, now: datetime.datetime | None = None) -> int:
    """Record a snapshot made elsewhere, such as one of an API description and its probes."""
    now = now or _now()
    return _record(state, source, state.start(source), source_uri, snapshot, None, now.isoformat(sep=" "), now)
