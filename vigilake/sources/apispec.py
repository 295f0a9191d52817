"""API descriptions and probes as snapshot rows.

A description is one row of JSON text. Everything about it is derived inside the
row with map and array functions, so reading a table of descriptions needs no
shuffle, and references are looked up in the row's own components.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vigilake.fixed import HTTP_METHODS
from vigilake.functions.uris import file_source_uri

_MAP = "map<string,string>"
_NO_ENTRIES = "cast(array() as array<struct<key:string,value:string>>)"
_NO_TEXTS = "cast(array() as array<string>)"
# Everything the flattening looks at in a parameter, body, response or schema.
_NODE = ("struct<`$ref`:string,name:string,schema:string,type:string,items:string,"
         "properties:map<string,string>,content:map<string,string>>")
_OPERATION = "struct<parameters:array<string>,requestBody:string,responses:map<string,string>>"


def _members(json: Column) -> Column:
    """Members of a JSON object, each value as JSON text; null if it is no object."""
    return F.from_json(json, _MAP)


def _entries(json: Column) -> Column:
    return F.coalesce(F.map_entries(_members(json)), F.expr(_NO_ENTRIES))


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and use it several times inside ``body``."""
    return F.transform(F.array(value), body)[0]


def _component_map(spec_components: Column) -> Column:
    """``#/components/section/name`` to JSON text."""

    def section(s: Column) -> Column:
        return F.transform(_entries(s["value"]), lambda e: F.struct(
            F.concat(F.lit("#/components/"), s["key"], F.lit("/"), e["key"]).alias("key"), e["value"].alias("value")))

    return F.map_from_entries(F.flatten(F.transform(_entries(spec_components), section)))


def _followed_references(spec: Column, raw: Column) -> Column:
    """Every reference that occurs in a description, mapped to the JSON text it leads to.

    References to references are followed as long as there are new ones; one that leads
    nowhere maps to ``{}``. Done once per description, so each use is a single lookup.
    """

    def walk(start: Column, parts: Column) -> Column:
        return F.aggregate(parts, start, lambda at, part: F.try_element_at(_members(at), part))

    def target(ref: Column) -> Column:
        parts = F.split(ref, "/")
        component = F.try_element_at(raw, F.array_join(F.slice(parts, 1, 4), "/"))
        found = (
            F.when(ref.startswith("#/components/"), walk(component, F.slice(parts, F.lit(5), F.size(parts))))
            .when(ref.startswith("#/"), walk(spec, F.slice(parts, F.lit(2), F.size(parts))))
        )
        return F.coalesce(found, F.lit("{}"))

    def chase(ref: Column, refs: Column) -> Column:
        # A chain longer than the number of references comes back to one of them.
        hops = F.slice(refs, F.lit(2), F.size(refs))
        return F.aggregate(hops, target(ref), lambda at, _: _let(
            _ref(at), lambda next_ref: F.when(next_ref.isNull(), at).otherwise(target(next_ref))))

    written = F.regexp_extract_all(spec, F.lit(r'"\$ref"\s*:\s*"([^"]*)"'), F.lit(1))
    refs = F.array_distinct(F.transform(written, lambda r: F.replace(r, F.lit(r"\/"), F.lit("/"))))
    return _let(refs, lambda known: F.map_from_arrays(known, F.transform(known, lambda r: chase(r, known))))


def _parse(json: Column) -> Column:
    return F.from_json(json, _NODE)


def _ref(node: Column) -> Column:
    # The text test spares the parser for the many nodes without a reference.
    return F.when(node.contains('"$ref"'), F.get_json_object(node, "$.$ref"))


def _resolved(json: Column, followed: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of the parsed node, or of what its reference leads to."""
    return _let(_let(_parse(json), lambda n: F.when(n["$ref"].isNull(), n).otherwise(
        F.try_element_at(followed, n["$ref"]))), body)


def _type_of(schema: Column, followed: Column) -> Column:
    def rendered(s: Column) -> Column:
        items = _resolved(s["items"], followed, lambda i: F.coalesce(i["type"], F.lit("object")))
        kind = F.coalesce(s["type"], F.lit("object"))
        return F.when(kind == "array", F.concat(F.lit("array["), items, F.lit("]"))).otherwise(kind)

    return _resolved(schema, followed, rendered)


def _typed(properties: Column, followed: Column) -> Column:
    """Entries of a schema's members with their types."""
    return F.transform(F.coalesce(F.map_entries(properties), F.expr(_NO_ENTRIES)), lambda p: F.struct(
        p["key"].alias("key"), _type_of(p["value"], followed).alias("value")))


def _properties(schema: Column, followed: Column, members: Column, prefix: str = "") -> Column:
    """Entries of a schema's top-level properties; of its items if it is an array.

    ``members`` has those of every referenced schema, typed once per description.
    """

    def of_items(i: Column) -> Column:
        return F.when(i["$ref"].isNull(), _typed(i["properties"], followed)).otherwise(F.try_element_at(members, i["$ref"]))

    def of_node(n: Column) -> Column:
        ref = n["$ref"]
        return _let(F.when(ref.isNull(), n).otherwise(F.try_element_at(followed, ref)), lambda s: (
            F.when(s["type"] == "array", _let(_parse(s["items"]), of_items))
            .when(ref.isNull(), _typed(s["properties"], followed))
            .otherwise(F.try_element_at(members, ref))))

    found = F.coalesce(_let(_parse(schema), of_node), F.expr(_NO_ENTRIES))
    if not prefix:
        return found
    return F.transform(found, lambda e: F.struct(F.concat(F.lit(prefix), e["key"]).alias("key"), e["value"].alias("value")))


def _json_body(node: Column, followed: Column) -> Column:
    """Schema of the first JSON content type of a request body or response."""

    def schema(n: Column) -> Column:
        media = F.filter(F.map_entries(n["content"]), lambda m: m["key"].contains("json"))
        return F.get_json_object(F.get(media, F.lit(0))["value"], "$.schema")

    return _resolved(node, followed, schema)


def _last_wins(entries: Column) -> Column:
    """Map of entries; of entries with one key the last stays."""
    return F.map_from_entries(F.filter(entries, lambda e, i: ~F.exists(
        F.slice(entries, i + 2, F.size(entries)), lambda later: later["key"] == e["key"])))


def _operation_columns(shared: Column, operation: Column, followed: Column, members: Column) -> Column:
    """Columns of a parsed operation under a path with the ``shared`` parameters."""

    def parameter(p: Column) -> Column:
        return _resolved(p, followed, lambda r: F.struct(
            F.concat(F.lit("param."), r["name"]).alias("key"),
            _type_of(F.coalesce(r["schema"], F.lit("{}")), followed).alias("value")))

    own = F.coalesce(operation["parameters"], F.expr(_NO_TEXTS))
    named = F.filter(F.transform(F.concat(shared, own), parameter), lambda p: p["key"].isNotNull() & (p["key"] != "param."))
    responses = F.array_sort(F.map_entries(operation["responses"]))
    success = F.get(F.filter(responses, lambda r: r["key"].startswith("2")), F.lit(0))["value"]
    body = _properties(_json_body(operation["requestBody"], followed), followed, members, "body.")
    reply = _properties(_json_body(success, followed), followed, members, "response.")
    return _let(F.concat(named, body, reply), _last_wins)


def specs_as_json(specs: DataFrame, column: str = "spec") -> DataFrame:
    """Descriptions written as YAML turned into JSON text; those already JSON stay untouched.

    Needs pyyaml on the executors, only if there is a YAML description.
    """
    from collections.abc import Iterator

    def convert(batches: Iterator) -> Iterator:
        import json

        import yaml

        for batch in batches:
            # Dates and other YAML scalars JSON lacks become text; a broken document an empty one.
            texts = []
            for text in batch[column]:
                try:
                    texts.append(json.dumps(yaml.safe_load(text), default=str))
                except yaml.YAMLError:
                    texts.append("{}")
            yield batch.assign(**{column: texts})

    is_json = F.try_parse_json(column).isNotNull()
    given = specs.where(F.col(column).isNotNull())
    return given.where(is_json).unionByName(given.where(~is_json).mapInPandas(convert, specs.schema))


def spec_snapshot(specs: DataFrame, keys: tuple[str, ...] = ("api",)) -> DataFrame:
    """``keys, object_uri, kind, columns`` of API descriptions (``keys, spec`` JSON text).

    An endpoint's columns are its parameters, request body members and members of its
    first successful response; a component schema's are its members.
    """
    api = file_source_uri("api", F.col("api"))
    root = F.regexp_replace(api, "/$", "")
    parsed = specs.select(
        *keys,
        F.get_json_object("spec", "$.paths").alias("_paths"),
        F.get_json_object("spec", "$.components.schemas").alias("_schemas"),
        "spec",
        _component_map(F.get_json_object("spec", "$.components")).alias("_raw"),
    ).withColumn("_text", _followed_references(F.col("spec"), F.col("_raw"))).withColumn(
        "_followed", F.transform_values("_text", lambda _, body: _parse(body)))
    followed, members = F.col("_followed"), F.col("_members")
    parsed = parsed.withColumn("_members", F.transform_values("_followed", lambda _, n: _typed(n["properties"], followed)))

    def endpoints(path: Column) -> Column:
        shared = F.coalesce(F.from_json(F.get_json_object(path["value"], "$.parameters"), "array<string>"), F.expr(_NO_TEXTS))
        operations = F.filter(_entries(path["value"]), lambda o: F.lower(o["key"]).isin(*HTTP_METHODS)
                              & o["value"].startswith("{"))
        return _let(shared, lambda given: F.transform(operations, lambda o: F.struct(
            F.concat(root, path["key"], F.lit("#"), F.lower(o["key"])).alias("object_uri"),
            F.lit("endpoint").alias("kind"),
            _let(F.from_json(o["value"], _OPERATION), lambda parsed: _operation_columns(given, parsed, followed, members)).alias("columns"))))

    operations = F.flatten(F.transform(_entries(F.col("_paths")), endpoints))
    schemas = F.transform(_entries(F.col("_schemas")), lambda s: F.struct(
        F.concat(root, F.lit("/components/schemas/"), s["key"]).alias("object_uri"),
        F.lit("schema").alias("kind"),
        _let(_properties(s["value"], followed, members), _last_wins).alias("columns")))
    return parsed.select(*keys, F.explode(F.concat(operations, schemas)).alias("_o")).select(*keys, "_o.*")


def probe_snapshot(probes: DataFrame, columns: DataFrame) -> DataFrame:
    """Probe results as snapshot rows: ``api, probe, ok`` with ``api, probe, name, type``.

    A probe that answered without a schema has an empty map; one that failed has null.
    """
    per_probe = columns.groupBy("api", "probe").agg(
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("name", "type")))).alias("columns"))
    empty = F.expr(f"cast(map() as {_MAP})")
    return probes.join(per_probe, ["api", "probe"], "left").select(
        F.concat(F.lit("api://"), "api", F.lit("/probe/"), "probe").alias("object_uri"),
        F.lit("probe").alias("kind"),
        F.when(F.col("ok"), F.coalesce("columns", empty)).alias("columns"),
    )


def carry_forward(current: DataFrame, previous: DataFrame) -> DataFrame:
    """Probes with the schema of this scan, or of the previous one where this scan failed.

    A failed probe without history is left out; a probe no longer asked for too.
    """
    before = previous.select("object_uri", F.map_entries("columns").alias("_before"))
    return (
        current.join(before, ["object_uri"], "left")
        .withColumn("columns", F.coalesce("columns", F.map_from_entries("_before")))
        .where("columns is not null")
        .drop("_before")
    )
