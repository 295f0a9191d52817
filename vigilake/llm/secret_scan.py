"""Secret scans: candidate values weighed by how many distinct repositories and owners hold them.

Patterns find candidates in every whole text. Each candidate's value is hashed and counted over the corpus by distinct
repository and distinct owner: a value that many owners or many repositories hold is a widely copied example, one that
stays with a few and looks random is taken for a live credential. A private key's value is its body, whatever its line
breaks; its span is the header, which has no value of its own unless no body follows. The counts are three aggregates with map-side combine
(value, owner, repository; value, owner; value); they go back to the spans by a join on value and salt, so a value that
a third of all rows hold is spread over many tasks.

Base kinds (assign, access, hex) are always reported. The method adds spans of the kinds ``private_key`` and
``random`` where they lie outside the base spans and are judged live. ``held`` gives for every candidate, live or not, by
how many repositories and owners it is held.

Defined results: a null text counts as empty and has no spans. Repeated rows are reported each. A null owner or
repository counts as one owner or repository of its own. Columns beside the named ones are passed through by
``scan``; names that begin with an underscore are its own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vigilake.llm.common import let, salted_join, stash, table, text_of, up_to

#: The base patterns and the least length of what they must catch.
ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{14,}"
HEX = r"[0-9a-f]{16,}"
ASSIGN_LEAST = 12
#: What the method looks at beyond the base kinds.
PRIVATE_KEY = r"-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----"
#: The header with what follows: all up to the END line, or else the lines of base64.
KEY_BODY = r"(?:[^-]*+(?:-(?!----)[^-]*+){0,64}+-----END [A-Z ]{0,40}PRIVATE KEY-----|(?:(?:\s|\\[nr])++[A-Za-z0-9+/]{16,}+={0,2}+){0,400}+)"
WHOLE_KEY = PRIVATE_KEY + KEY_BODY
RANDOM = r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{24,}+"
#: Kinds in the order of equal starts.
KINDS = ["assign", "access", "hex", "private_key", "random"]
#: A value with so many owners is an example that people copy.
WIDE_OWNERS = 4
#: So has one that so many repositories hold, however few their owners.
WIDE_REPOSITORIES = 64
#: A live value has so many different characters and none of the words of placeholders.
LEAST_DISTINCT = 8
PLACEHOLDER = r"(?i)example|sample|dummy|placeholder|change.?me|your|xxxx|0123456|abcdef|1234567"


def exclusive_sums(lengths: Column, chunk: int = 256) -> Column:
    """For every element the sum of those before it; in chunks, so long arrays stay cheap."""

    def plain(values: Column) -> Column:
        start = F.struct(F.lit(0).cast("long").alias("sum"), F.array().cast("array<bigint>").alias("before"))
        step = lambda acc, x: F.struct((acc["sum"] + x).alias("sum"), F.concat(acc["before"], F.array(acc["sum"])).alias("before"))
        return F.aggregate(values, start, step)

    def whole(values: Column) -> Column:
        parts = F.transform(up_to(F.ceil(F.size(values) / chunk)), lambda c: plain(F.slice(values, c * chunk + 1, F.lit(chunk))))
        return let(parts, lambda p: F.flatten(F.zip_with(
            p, let(plain(F.transform(p, lambda x: x["sum"])), lambda s: s["before"]), lambda x, o: F.transform(x["before"], lambda b: b + o)
        )))

    return let(lengths, whole)


def spans_of(text: Column, found: Column, pattern: str, kind: str, value=lambda m: m, part=lambda m: m) -> Column:
    """Spans of the matches ``found`` of ``pattern``: what lies between them comes from splitting by the same pattern.

    A span covers ``part`` of its match, from the match's start.
    """
    empty = F.array().cast("array<struct<start:bigint,rank:int,end:bigint,kind:string,value:string>>")

    def placed(x: Column) -> Column:
        gaps = F.transform(x["p"], lambda p: F.length(p).cast("long"))
        steps = F.zip_with(x["m"], F.slice(x["p"], 1, F.size(x["m"])), lambda m, p: (F.length(m) + F.length(p)).cast("long"))
        begins = F.zip_with(exclusive_sums(steps), F.slice(gaps, 1, F.size(x["m"])), lambda a, b: a + b)
        return F.zip_with(begins, x["m"], lambda b, m: F.struct(
            b.alias("start"), F.lit(KINDS.index(kind)).alias("rank"), (b + F.length(part(m))).alias("end"), F.lit(kind).alias("kind"), value(m).alias("value")
        ))

    cut = F.struct(found.alias("m"), F.split(text, pattern, -1).alias("p"))
    return F.when(F.size(found) > 0, let(cut, placed)).otherwise(empty)


def joined(spans: Column) -> Column:
    """kind:start:end by start, then kind, comma-joined."""
    ordered = F.array_sort(spans)
    return F.concat_ws(",", F.transform(ordered, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))))


def header_of(key: Column) -> Column:
    return F.regexp_extract(key, PRIVATE_KEY, 0)


def key_value(key: Column) -> Column:
    """The characters of a key's body without line breaks, escaped ones included; without a body the header."""
    inner = F.regexp_replace(key, r"-----(?:BEGIN|END) [A-Z ]{0,40}PRIVATE KEY-----|\\[nr]", "")
    return let(F.regexp_replace(inner, "[^A-Za-z0-9+/=]", ""), lambda b: F.when(b != "", b).otherwise(header_of(key)))


def live_looking(value: Column) -> Column:
    return (F.size(F.array_distinct(F.split(value, ""))) >= LEAST_DISTINCT) & ~value.rlike(PLACEHOLDER)


def candidates(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` without its text, with ``_base`` and ``_more``: arrays of (start, rank, end, kind, value)."""
    rest = [F.col(f"`{c}`") for c in docs.columns if c != text]
    patterns = {"assign": ASSIGN, "access": ACCESS, "hex": HEX, "private_key": WHOLE_KEY, "random": RANDOM}
    found = docs.select(*rest, text_of(text).alias("_text")).select(
        "*", *[F.regexp_extract_all("_text", F.lit(p), F.lit(0)).alias(f"_m_{k}") for k, p in patterns.items()]
    )
    secret = lambda m: F.regexp_extract(m, ASSIGN, 2)
    more = {"assign": {"value": secret}, "private_key": {"value": key_value, "part": header_of}}
    spans = {k: spans_of(F.col("_text"), F.col(f"_m_{k}"), p, k, **more.get(k, {})) for k, p in patterns.items()}
    long_enough = F.filter(spans["assign"], lambda s: F.length(s["value"]) >= ASSIGN_LEAST)
    mixed = F.filter(spans["random"], lambda s: s["value"].rlike("[0-9]") & s["value"].rlike("[A-Za-z]"))
    out = found.select(*rest, F.concat(long_enough, spans["access"], spans["hex"]).alias("_base"), F.concat(spans["private_key"], mixed).alias("_outside"))
    outside = F.filter("_outside", lambda s: ~F.exists("_base", lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"])))
    return out.select(*rest, "_base", outside.alias("_more"))


def ownership(values: DataFrame) -> DataFrame:
    """(_value, n_repositories, n_owners) of every candidate value; input (_value, _owner, _repository)."""
    return (
        values.groupBy("_value", "_owner", "_repository").agg(F.count("*").alias("_rows"))
        .groupBy("_value", "_owner").agg(F.count("*").alias("_held"))
        .groupBy("_value").agg(F.sum("_held").alias("n_repositories"), F.count("*").alias("n_owners"))
    )


def scan(docs: DataFrame, text: str = "text", owner: str = "source", repository: str = "doc_id") -> DataFrame:
    """One row per row of ``docs``, without its text: ``base`` and ``spans`` (arrays of spans), ``n_live``, ``n_copied``, ``held``.

    Each span has start, end (code points, end exclusive), kind and value; ``held`` has start, end, kind, n_repositories
    and n_owners of all candidates.
    """
    rest = [F.col(f"`{c}`") for c in docs.columns if c != text]
    found = stash(candidates(docs, text).withColumn("_row", F.monotonically_increasing_id()), "secrets")
    values = found.select(
        "_row", F.coalesce(F.col(owner).cast("string"), F.lit("")).alias("_owner"), F.col(repository).cast("string").alias("_repository"),
        F.explode(F.concat("_base", "_more")).alias("_span"),
    ).withColumn("_value", F.xxhash64("_span.value"))
    judged = salted_join(values, ownership(values.select("_value", "_owner", "_repository")), "_value", F.col("_row"))
    copied = (F.col("n_owners") >= WIDE_OWNERS) | (F.col("n_repositories") >= WIDE_REPOSITORIES)
    live = ~copied & ((F.col("_span.kind") == "private_key") | live_looking(F.col("_span.value")))
    by_row = judged.withColumn("_live", live).groupBy("_row").agg(
        F.collect_list(F.when(F.col("_live") & (F.col("_span.rank") > KINDS.index("hex")), F.col("_span"))).alias("_added"),
        F.sum(F.col("_live").cast("long")).alias("n_live"),
        F.sum(copied.cast("long")).alias("n_copied"),
        F.array_sort(F.collect_list(F.struct("_span.start", "_span.rank", "_span.end", "_span.kind", "n_repositories", "n_owners"))).alias("_held"),
    )
    return found.join(by_row.hint("merge"), "_row", "left").select(
        *rest, F.array_sort("_base").alias("base"),
        F.array_sort(F.concat("_base", F.coalesce("_added", F.slice("_base", 1, 0)))).alias("spans"),
        F.coalesce("n_live", F.lit(0).cast("long")).alias("n_live"), F.coalesce("n_copied", F.lit(0).cast("long")).alias("n_copied"),
        F.coalesce("_held", F.array().cast("array<struct<start:bigint,rank:int,end:bigint,kind:string,n_repositories:bigint,n_owners:bigint>>")).alias("held"),
    )


def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select(
        "doc_id", count("assign"), count("access"), count("hex"), F.sha2(joined(F.col("base")), 256).alias("base_sha256"),
        joined(F.col("spans")).alias("spans"), "n_live", "n_copied",
        F.concat_ws(",", F.transform("held", lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"], s["n_repositories"], s["n_owners"]))).alias("held"),
    )
