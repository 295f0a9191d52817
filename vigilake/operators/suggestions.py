"""Suggested filesets: clusters of unmatched files, and checks of suggestions from outside."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vigilake.fixed import MIN_CLUSTER_SIZE, SAMPLE_FILES
from vigilake.functions.changes import columns_json, detail_json, severity, sorted_entries
from vigilake.functions.names import (
    base_name, compiles, has_token, name_template, pattern_regex_col, suggested_stem, template_pattern)
from vigilake.functions.uris import fileset_uri
from vigilake.operators.scale import cut_lineage


def _fingerprint():
    return F.when(F.size("columns") > 0, F.sha2(F.to_json(sorted_entries(F.col("columns"))), 256))


def cluster_files(files: DataFrame) -> DataFrame:
    """Marks the unmatched files (``source, path, pos, columns``) that form a feed.

    Adds ``template`` and ``member``. A cluster is a template with a token and at
    least two files; those of its majority schema (ties: the schema seen first) and
    those without a schema are members, if at least two remain. All per-cluster facts
    are aggregates joined back, so a cluster is never gathered.
    """
    keys = ["source", "template"]
    named = files.withColumn("template", name_template(F.col("path"))).withColumn("_print", _fingerprint())
    by_schema = named.groupBy(*keys, "_print").agg(F.count("*").alias("_n"), F.min("pos").alias("_pos"))
    known = F.col("_print").isNotNull()
    voted = F.when(known, F.struct((-F.col("_n")).alias("_votes"), "_pos"))
    n_blank = F.sum(F.when(F.col("_print").isNull(), F.col("_n")).otherwise(0))
    clusters = (
        by_schema.groupBy(*keys)
        .agg(F.sum("_n").alias("_files"), F.min_by("_print", voted).alias("_majority"),
             F.max(F.when(known, F.col("_n"))).alias("_top"), n_blank.alias("_blank"))
        .withColumn("_members", F.col("_blank") + F.coalesce("_top", F.lit(0)))
        .where(has_token(F.col("template")) & (F.col("_files") >= MIN_CLUSTER_SIZE)
               & (F.col("_members") >= MIN_CLUSTER_SIZE))
        .select(*keys, "_majority", "_members")
    )
    joined = named.join(clusters, keys, "left")
    agrees = F.col("_print").isNull() | F.col("_print").eqNullSafe(F.col("_majority"))
    return joined.withColumn("member", F.col("_members").isNotNull() & agrees).drop("_majority", "_members")


def unique_names(stems: DataFrame, declared: DataFrame) -> DataFrame:
    """Names of suggestions (``source, template, stem``): ``stem``, ``stem_2``, ... without collisions.

    In template order each takes the first name of its stem that neither ``declared``
    (``source, fileset``) nor an earlier template holds. A stem has no digits (they
    are tokens), so suggestions of different stems never want the same name: the
    n-th template of a stem takes the n-th name that is not declared.
    """
    keys = ["source", "stem"]
    name = F.col("fileset")
    numbered = F.regexp_extract(name, r"^.*_([1-9][0-9]{0,8})$", 1)
    taken = declared.select("source", name.alias("stem"), F.lit(1).alias("_at")).unionByName(
        declared.where((numbered != "") & (numbered != "1")).select(
            "source", F.regexp_extract(name, r"^(.*)_[0-9]+$", 1).alias("stem"), numbered.cast("int").alias("_at")))
    # Declared names of one stem: bounded by the declarations themselves.
    taken = taken.groupBy(*keys).agg(F.array_sort(F.collect_set("_at")).alias("_taken"))
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy("template"))
    place = F.aggregate(
        F.coalesce("_taken", F.expr("cast(array() as array<int>)")), F.col("_rank"),
        lambda at, used: F.when(used <= at, at + 1).otherwise(at))
    return (
        stems.withColumn("_rank", rank)
        .join(taken, keys, "left")
        .withColumn("_place", place)
        .select("source", "template", F.when(F.col("_place") == 1, F.col("stem"))
                .otherwise(F.concat_ws("_", "stem", "_place")).alias("name"))
    )


def suggest_filesets(clustered: DataFrame, declared: DataFrame) -> DataFrame:
    """One ``fileset_suggested`` event per cluster of ``cluster_files``."""
    keys = ["source", "template"]
    members = clustered.where("member")
    summary = members.groupBy(*keys).agg(
        F.count("*").alias("file_count"),
        F.min_by(F.map_entries("columns"), F.struct(F.size("columns") == 0, F.col("pos"))).alias("_columns"))
    names = unique_names(summary.select(*keys, suggested_stem(F.col("template")).alias("stem")), declared)
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy("pos"))
    samples = (
        members.select(*keys, "pos", "path").withColumn("_rank", rank).where(F.col("_rank") <= SAMPLE_FILES)
        .groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("_rank", "path"))).alias("_files"))
    )
    return (
        summary.join(names, keys).join(samples, keys)
        .select(
            fileset_uri(F.col("source"), F.col("name")).alias("object_uri"),
            F.lit("fileset_suggested").alias("change_type"),
            severity(F.lit("fileset_suggested")).alias("severity"),
            detail_json(
                name=F.col("name"),
                pattern=template_pattern(F.col("template")),
                file_count=F.col("file_count"),
                sample_files=F.transform("_files", lambda f: f["path"]),
                columns=columns_json(F.map_from_entries("_columns")),
            ).alias("detail"),
        )
    )


def uncovered(clustered: DataFrame) -> DataFrame:
    """Files no suggestion covers."""
    return clustered.where(~F.col("member"))


def claims_of(suggestions: DataFrame) -> DataFrame:
    """Suggestions with a ``files`` array as one row per claimed file."""
    return suggestions.select("suggestion", "name", "pattern", F.explode("files").alias("path"))


def accept_suggestions(files: DataFrame, claims: DataFrame, declared_names: Iterable[str] = ()) -> DataFrame:
    """Members of the acceptable suggestions from outside: ``suggestion, name, pattern, path, pos``.

    ``files``: ``path, pos``, one source. ``claims``: ``suggestion`` (their order),
    ``name, pattern, path``. Taken in order, a suggestion counts if its name is free
    and at least two claimed files exist, match its pattern and belong to no earlier
    accepted one. Each round decides every suggestion that shares no file or name
    with an earlier undecided one, so the number of rounds is the longest chain of
    overlaps, not the number of suggestions.
    """
    usable = claims.where(
        (F.col("name") != "") & F.col("pattern").isNotNull() & ~F.col("name").isin(*list(declared_names))
        & compiles(F.col("pattern")))
    target = F.when(F.col("pattern").contains("/"), F.col("path")).otherwise(base_name(F.col("path")))
    claims = (
        usable.select("suggestion", "name", "pattern", "path").distinct()
        .join(files.select("path", "pos"), "path")
        .withColumn("_target", target)
        .withColumn("_regex", pattern_regex_col(F.col("pattern")))
        .where(F.expr("_target rlike _regex"))
        .drop("_target", "_regex")
    )
    open_claims, accepted = cut_lineage(claims), None
    while not open_claims.isEmpty():
        owner = open_claims.groupBy("path").agg(F.min("suggestion").alias("_first"))
        blocked = (
            open_claims.join(owner, "path").where("suggestion > _first").select("suggestion")
            .unionByName(_later_of_same_name(open_claims)).distinct()
        )
        decided = open_claims.join(blocked, ["suggestion"], "left_anti")
        enough = decided.groupBy("suggestion").agg(F.count("*").alias("_n")).where(
            F.col("_n") >= MIN_CLUSTER_SIZE).select("suggestion")
        won = decided.join(enough, ["suggestion"], "left_semi")
        left = open_claims.join(blocked, ["suggestion"], "left_semi")
        left = left.join(won.select("path"), "path", "left_anti")
        left = left.join(won.select("name").distinct(), ["name"], "left_anti")
        won, left = cut_lineage(won), cut_lineage(left)
        accepted = won if accepted is None else accepted.unionByName(won)
        open_claims = left
    return open_claims if accepted is None else accepted


def _later_of_same_name(claims: DataFrame) -> DataFrame:
    heads = claims.select("suggestion", "name").distinct()
    first = heads.groupBy("name").agg(F.min("suggestion").alias("_first"))
    return heads.join(first, "name").where("suggestion > _first").select("suggestion")


def suggestion_events(accepted: DataFrame, source: str, via: str = "external") -> DataFrame:
    """Accepted suggestions as ``fileset_suggested`` events."""
    keys = ["suggestion", "name", "pattern"]
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy("pos"))
    samples = accepted.withColumn("_rank", rank).where(F.col("_rank") <= SAMPLE_FILES).groupBy(*keys).agg(
        F.array_sort(F.collect_list(F.struct("_rank", "path"))).alias("_files"))
    return accepted.groupBy(*keys).agg(F.count("*").alias("file_count")).join(samples, keys).select(
        fileset_uri(source, F.col("name")).alias("object_uri"),
        F.lit("fileset_suggested").alias("change_type"),
        severity(F.lit("fileset_suggested")).alias("severity"),
        detail_json(
            name=F.col("name"),
            pattern=F.col("pattern"),
            file_count=F.col("file_count"),
            sample_files=F.transform("_files", lambda f: f["path"]),
            columns=F.expr("cast(map() as map<string,string>)"),
            via=F.lit(via),
        ).alias("detail"),
    )
