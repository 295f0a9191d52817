"""Mixing sources to target weights: iterative proportional fitting, then sampling by calibrated probabilities.

Tokens (words) are summed by cell (source, language, topic). Each sweep rakes the cell weights to one marginal after
the other: weight * target share / present share. A document is then sampled with its cell's factor divided by the
largest factor, so the expected token shares of the sample are the targets and no document is needed twice.

Targets name a bounded number of values for each dimension; every other value, null included, is "other". So there are
at most (sources + 1) * (languages + 1) * (topics + 1) cells whatever the input, and the cell table may be broadcast.
"other" keeps its natural share and the named targets share the rest; named values without tokens are left out.

Draws are deterministic: a document is sampled if the first 32 bits of md5(seed:doc_id) lie below its probability.

Defined results: null and empty texts have no tokens and take the factor of their cell. Repeated rows share one draw.
Cells without tokens keep the factors of their marginals. Columns of the input are passed through; names that begin
with an underscore are its own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from vigilake.llm.common import stash, table, text_of, words_of

DIMENSIONS = ["source", "lang", "topic"]
OTHER = "other"
SWEEPS = 8
SEED = 7
#: Topics by what a text contains; the first that fits counts, "prose" if none does.
TOPICS = [("contact", ["@"]), ("legal", ["icense"]), ("tabular", [" | "]), ("markup", ["%%%", "***", "###"])]
#: Production targets.
TARGETS = {
    "source": {f"src{i}": 0.05 for i in range(20)},
    "lang": {"en": 0.58, "de": 0.16, "fr": 0.16, "es": 0.10},
    "topic": {"prose": 0.90, "contact": 0.03, "legal": 0.03, "tabular": 0.02, "markup": 0.02},
}


def topic_of(text: Column, rules: list[tuple[str, list[str]]] = TOPICS) -> Column:
    out = None
    for name, signs in rules:
        hit = F.lit(False)
        for sign in signs:
            hit = hit | F.contains(text, F.lit(sign))
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return out.otherwise("prose") if out is not None else F.lit("prose")


def celled(docs: DataFrame, targets: dict[str, dict[str, float]], text: str, topics=TOPICS) -> DataFrame:
    """``docs`` with ``_source``, ``_lang``, ``_topic``: the values that have a target, else "other"."""
    raw = {"source": F.col("source").cast("string"), "lang": F.col("lang").cast("string"), "topic": topic_of(text_of(text), topics)}
    return docs.withColumns({f"_{d}": F.when(raw[d].isin(list(targets[d])), raw[d]).otherwise(OTHER) for d in DIMENSIONS})


def target_of(column: str, shares: dict[str, float]) -> Column:
    """Target of a cell's value; 0 for "other"."""
    out = F.lit(0.0)
    for value, share in shares.items():
        out = F.when(F.col(column) == value, float(share)).otherwise(out)
    return out


def rake(cells: DataFrame, targets: dict[str, dict[str, float]], sweeps: int = SWEEPS) -> DataFrame:
    """Cells (_source, _lang, _topic, _tokens) with ``_factor`` and ``_probability``; all work is on the bounded cell table."""
    total = W.partitionBy()
    out = cells.withColumn("_all", F.sum("_tokens").over(total))
    for d in DIMENSIONS:
        own = F.sum("_tokens").over(W.partitionBy(f"_{d}"))
        out = out.withColumn(f"_n_{d}", own)
        here = F.when((F.col(f"_{d}") != OTHER) & (F.col(f"_n_{d}") > 0), target_of(f"_{d}", targets[d])).otherwise(0.0)
        out = out.withColumn(f"_here_{d}", here)
        out = out.withColumn(f"_of_{d}", F.count("*").over(W.partitionBy(f"_{d}")))
        out = out.withColumn(f"_named_{d}", F.sum(F.col(f"_here_{d}") / F.col(f"_of_{d}")).over(total))
        out = out.withColumn(f"_others_{d}", F.sum(F.when(F.col(f"_{d}") == OTHER, F.col("_tokens")).otherwise(0)).over(total))
        rest = F.col("_all") - F.col(f"_others_{d}")
        share = F.when(F.col(f"_{d}") == OTHER, F.col(f"_others_{d}").cast("double")).otherwise(
            F.when(F.col(f"_named_{d}") > 0, rest * F.col(f"_here_{d}") / F.col(f"_named_{d}")).otherwise(0.0)
        )
        out = out.withColumn(f"_t_{d}", share)
    out = stash(out.select(*[f"_{d}" for d in DIMENSIONS], "_tokens", *[f"_t_{d}" for d in DIMENSIONS]).coalesce(1), "cells")
    out = out.withColumn("_factor", F.lit(1.0))
    for _ in range(sweeps):
        for d in DIMENSIONS:
            present = F.sum(F.col("_tokens") * F.col("_factor")).over(W.partitionBy(f"_{d}"))
            out = out.withColumn("_present", present).withColumn(
                "_factor", F.when(F.col("_present") > 0, F.col("_factor") * F.col(f"_t_{d}") / F.col("_present")).otherwise(F.col("_factor"))
            )
    top = F.max("_factor").over(total)
    return out.drop("_present").withColumn("_probability", F.coalesce(F.col("_factor") / F.nullif(top, F.lit(0.0)), F.lit(1.0)))


def draw(doc_id: Column, seed: int = SEED) -> Column:
    """Uniform in [0, 1), the same wherever it is computed."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))).cast("binary"))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("long") / F.lit(4294967296.0)


def mix(docs: DataFrame, targets: dict[str, dict[str, float]] = TARGETS, text: str = "text", seed: int = SEED, sweeps: int = SWEEPS) -> DataFrame:
    """``docs`` with ``_probability`` and ``_sampled``."""
    keys = [f"_{d}" for d in DIMENSIONS]
    placed = celled(docs, targets, text)
    cells = placed.groupBy(*keys).agg(F.sum(F.size(words_of(text_of(text)))).alias("_tokens"))
    raked = stash(rake(stash(cells, "cell-tokens"), targets, sweeps).select(*keys, "_probability"), "raked")
    # Bounded by the targets, see above.
    return placed.join(F.broadcast(raked), keys, "left").withColumn("_sampled", draw(F.col("doc_id"), seed) < F.col("_probability"))


def sampled(docs: DataFrame, **options) -> DataFrame:
    """The sampled rows of ``docs`` in its own columns."""
    return mix(docs, **options).filter("_sampled").select(*[F.col(f"`{c}`") for c in docs.columns])


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mix(table(spark, sf_dir, "documents").select("doc_id", "text", "source", "lang"))
    return out.select("doc_id", F.col("_topic").alias("topic"), F.round("_probability", 6).alias("probability"), F.col("_sampled").alias("sampled"))


def mixing_sql(docs: str = "documents", targets: dict[str, dict[str, float]] = TARGETS, sweeps: int = SWEEPS, prefix: str = "") -> str:
    """The same as a chain of common table expressions; ends with ``{prefix}mixed``: all columns, _probability, _sampled."""
    topic = "CASE " + " ".join(
        "WHEN " + " OR ".join(f"contains(coalesce(text, ''), '{s}')" for s in signs) + f" THEN '{name}'" for name, signs in TOPICS) + " ELSE 'prose' END"
    raw = {"source": "source", "lang": "lang", "topic": topic}
    listed = lambda d: ", ".join(f"'{v}'" for v in targets[d])
    keys = ", ".join(f"_{d}" for d in DIMENSIONS)
    share = lambda d: "CASE " + " ".join(f"WHEN _{d} = '{v}' THEN {s!r}::DOUBLE" for v, s in targets[d].items()) + " ELSE 0.0::DOUBLE END"
    steps = [
        f"{prefix}placed AS (SELECT *, " + ", ".join(f"CASE WHEN ({raw[d]}) IN ({listed(d)}) THEN ({raw[d]}) ELSE '{OTHER}' END AS _{d}" for d in DIMENSIONS) + f" FROM {docs})",
        f"{prefix}cells AS MATERIALIZED (SELECT {keys}, sum(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')))::DOUBLE AS _tokens FROM {prefix}placed GROUP BY ALL)",
    ]
    for d in DIMENSIONS:
        steps.append(
            f"{prefix}m_{d} AS MATERIALIZED (SELECT _{d}, sum(_tokens) AS n, CASE WHEN _{d} <> '{OTHER}' AND sum(_tokens) > 0 THEN {share(d)} ELSE 0 END AS here FROM {prefix}cells GROUP BY _{d})")
        steps.append(
            f"{prefix}t_{d} AS MATERIALIZED (SELECT _{d}, CASE WHEN _{d} = '{OTHER}' THEN n ELSE coalesce(here * (SELECT coalesce(sum(n) FILTER (_{d} <> '{OTHER}'), 0) FROM {prefix}m_{d}) / nullif((SELECT sum(here) FROM {prefix}m_{d}), 0), 0) END AS t FROM {prefix}m_{d})")
    last = f"(SELECT *, 1.0::DOUBLE AS f FROM {prefix}cells)"
    for k in range(sweeps):
        for d in DIMENSIONS:
            name = f"{prefix}s{k}_{d}"
            steps.append(
                f"{name} AS MATERIALIZED (SELECT c.* EXCLUDE (f, p), CASE WHEN p > 0 THEN f * t / p ELSE f END AS f FROM (SELECT *, sum(_tokens * f) OVER (PARTITION BY _{d}) AS p FROM {last}) c JOIN {prefix}t_{d} USING (_{d}))")
            last = name
    steps.append(f"{prefix}raked AS MATERIALIZED (SELECT {keys}, coalesce(f / nullif(max(f) OVER (), 0), 1.0) AS _probability FROM {last})")
    drawn = f"CAST('0x' || substr(md5('{SEED}:' || coalesce(doc_id::VARCHAR, '')), 1, 8) AS BIGINT) / 4294967296.0"
    steps.append(f"{prefix}mixed AS (SELECT p.*, _probability, {drawn} < _probability AS _sampled FROM {prefix}placed p JOIN {prefix}raked USING ({keys}))")
    return ",\n".join(steps)


MIXING_SQL = f"WITH {mixing_sql()} SELECT doc_id, _topic AS topic, round(_probability, 6) AS probability, _sampled AS sampled FROM mixed"
