"""Quality rules: hashed n-gram log-likelihood ratio between trusted-target and raw-corpus multinomials.

Words and word pairs of every text are hashed into a fixed number of bins. Two multinomials over the bins are
counted in one pass: over all rows (raw) and over the rows that are trusted (target). A document's score is the
mean of log(target / raw) over its n-grams, so length cancels; every document with a score of at least
``min_score`` that passes the base rules is kept. The query takes ``min_score`` from the scores of trusted rows that
pass the base rules: their exact ``LOW_SHARE`` quantile. Those rows, one in ``HELD_OUT``, are not in the target counts.

The model is one number per bin: its size is the parameter ``bins``, whatever the corpus. It goes to the tasks as a
constant of the plan, so scoring needs no join and no shuffle.

Defined results: a null text counts as empty; without words every count is 0, the score is 0 and the base rules
fail. Repeated rows are scored each. Rows without a label, or with a null label, are not trusted. With no trusted row
every ratio is 0, so the base rules decide alone. Columns beside the named ones are passed through by ``score``;
names that begin with an underscore are its own.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vigilake.llm.common import let, stash, table, text_of, up_to, words_of

BINS = 16384
#: Share of the trusted rows that pass the base rules that may score below what is kept; one of how many sets the threshold.
LOW_SHARE, HELD_OUT = 0.001, 5
#: Fixed values of the base rules.
SYMBOLS = "#*$%&|<>"
WINDOW = 5
MIN_WORDS = 10
MAX_REPEATED_PERCENT = 20


def word_hashes(words: Column) -> Column:
    """64-bit hash of every word: the text is hashed once, all else is made of these numbers."""
    return F.transform(words, lambda w: F.xxhash64(w))


def pair_hashes(hashes: Column) -> Column:
    """Of every word and the one after it; the last word's pair is the word alone."""
    return F.zip_with(hashes, F.slice(hashes, F.lit(2), F.size(hashes)), lambda a, b: F.when(b.isNull(), a).otherwise(F.xxhash64(a, b)))


def bin_counts(docs: DataFrame, text: str, trusted: Column, bins: int = BINS) -> DataFrame:
    """(bin, raw, target): n-gram counts over all rows and over the trusted ones, in one pass."""
    grams = docs.select(
        let(word_hashes(words_of(text_of(text))), lambda h: F.concat(h, pair_hashes(h))).alias("_grams"), F.coalesce(trusted, F.lit(False)).cast("int").alias("_t"))
    return (
        # Outer, as a plain explode makes Spark work the arrays out once more to filter empty ones early.
        grams.select("_t", F.explode_outer("_grams").alias("_gram"))
        .filter("_gram is not null").groupBy(F.pmod("_gram", F.lit(bins)).alias("bin"))
        .agg(F.count("*").alias("raw"), F.sum("_t").alias("target"))
    )


def log_ratios(counts: DataFrame, bins: int = BINS) -> list[float]:
    """log(target share / raw share) of each bin, add-one smoothed; at most ``bins`` rows come to the driver."""
    rows = {r["bin"]: (r["raw"], r["target"]) for r in counts.collect()}
    raw_all, target_all = sum(r for r, _ in rows.values()), sum(t for _, t in rows.values())
    if not target_all:
        return [0.0] * bins
    ratios = []
    for b in range(bins):
        raw, target = rows.get(b, (0, 0))
        ratios.append(math.log((target + 1) / (target_all + bins)) - math.log((raw + 1) / (raw_all + bins)))
    return ratios


def constant_array(values: list[float]) -> Column:
    """The numbers as one constant of the plan."""
    return F.from_json(F.lit("[" + ",".join(repr(v) for v in values) + "]"), "array<double>")


def likelihood_score(hashes: Column, pairs: Column, ratios: list[float]) -> Column:
    """Mean log ratio of the n-grams; 0 without words."""
    model, bins = constant_array(ratios), F.lit(len(ratios))
    # One sum, so that the plan holds the model once.
    total = F.aggregate(F.concat(hashes, pairs), F.lit(0.0), lambda acc, x: acc + F.get(model, F.pmod(x, bins).cast("int")))
    return F.when(F.size(hashes) > 0, total / (2 * F.size(hashes))).otherwise(F.lit(0.0))


def window_hashes(hashes: Column, pairs: Column, window: int = WINDOW) -> Column:
    """Of every window of ``window`` (two or more) words: pairs, doubled as long as they fit, then word by word."""
    out, n = pairs, 2
    while n < window:
        more, step = (out, n) if 2 * n <= window else (hashes, 1)
        out = F.zip_with(out, F.slice(more, F.lit(n + 1), F.size(more)), lambda a, b: F.xxhash64(a, b))
        n += step
    return F.slice(out, F.lit(1), F.greatest(F.size(hashes) - (window - 1), F.lit(0)))


def repeated_words(hashes: Column, pairs: Column, window: int = WINDOW) -> Column:
    """Number of words inside windows of ``window`` words that occur twice or more in the text.

    Windows are compared by 64-bit hash; the covered words come from one pass over the sorted repeats.
    """

    def covered(found: Column) -> Column:
        placed = F.array_sort(F.transform(found, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

        def repeats(s: Column) -> Column:
            same = lambda a, b: F.coalesce(F.get(s, a)["h"] == F.get(s, b)["h"], F.lit(False))
            hit = F.filter(F.transform(s, lambda x, k: F.when(same(k, k - 1) | same(k, k + 1), x["i"])), lambda i: i.isNotNull())
            start = F.struct(F.lit(0).alias("n"), F.lit(-2147483648).alias("last"))
            step = lambda acc, i: F.struct(
                (acc["n"] + F.when(i - acc["last"] < window, i - acc["last"]).otherwise(F.lit(window))).cast("int").alias("n"), i.alias("last")
            )
            ordered = F.array_sort(hit)
            return F.aggregate(ordered, start.cast("struct<n:int,last:bigint>"), lambda a, i: step(a, i.cast("bigint")), lambda a: a["n"])

        return F.when(F.size(F.array_distinct(found)) < F.size(found), let(placed, repeats)).otherwise(F.lit(0))

    return let(window_hashes(hashes, pairs, window), covered)


def base_rules(hashes: Column, pairs: Column, text: Column) -> dict[str, Column]:
    """The plain counts of a text; ``hashes`` and ``pairs``: of its words."""
    blank = F.translate(text, " \t\n\x0b\x0c\r", "")
    lines = F.filter(F.split(text, "\n"), lambda x: F.translate(x, " \t\x0b\x0c\r", "") != "")
    return {
        "n_words": F.size(hashes).cast("long"),
        "word_chars": F.length(blank).cast("long"),
        "n_symbols": (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("long"),
        "n_dup_lines": let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long"),
        "n_repeat_words": repeated_words(hashes, pairs).cast("long"),
    }


def score(docs: DataFrame, ratios: list[float], text: str = "text", min_score: float = -math.inf) -> DataFrame:
    """``docs`` without its text, with the counts, ``score``, ``base_failed`` and ``kept``."""
    rest = [c for c in docs.columns if c not in {text, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "score", "base_failed", "kept"}]
    body = text_of(text)
    counted = docs.select(
        *[F.col(f"`{c}`") for c in rest],
        let(F.struct(body.alias("t"), word_hashes(words_of(body)).alias("h")), lambda x: let(pair_hashes(x["h"]), lambda p: F.struct(
            *[c.alias(name) for name, c in base_rules(x["h"], p, x["t"]).items()], likelihood_score(x["h"], p, ratios).alias("score")
        ))).alias("_facts"),
    ).select(*[F.col(f"`{c}`") for c in rest], "_facts.*")
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEATED_PERCENT * F.col("n_words"))
    return counted.withColumn("base_failed", failed).withColumn("kept", ~failed & (F.col("score") >= min_score))


def with_trust(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``docs`` with ``_trusted``: its label says quality 1."""
    good = labels.filter("quality = 1").select("doc_id").distinct().withColumn("_trusted", F.lit(True))
    # Both sides are shuffled at any size, so that cost grows with the input.
    return docs.join(good.hint("merge"), "doc_id", "left")


def least_trusted(trusted: DataFrame, share: float = LOW_SHARE) -> float:
    """The score that all but ``share`` of the trusted rows reach, rounded down to 1e-6; rows that fail the base rules do not count.

    The exact order statistic: rows are counted per hundredth first and then per millionth inside the hundredth that
    holds the rank, so at most some thousand numbers come to the driver and the order of tasks does not matter.
    """
    steps = trusted.filter("not base_failed").select(F.floor(F.col("score") * 1000000).cast("long").alias("q")).filter("q is not null")
    rank = None
    for width in (10000, 1):
        inside = steps if rank is None else steps.filter(F.floor(F.col("q") / 10000) == coarse)
        rows = sorted(inside.groupBy(F.floor(F.col("q") / width).cast("long").alias("b")).count().collect())
        if not rows:
            return -math.inf
        if rank is None:
            rank = int(share * sum(n for _, n in rows))
        for coarse, n in rows:
            if rank < n:
                break
            rank -= n
    return coarse / 1000000


def held_out(doc_id: Column) -> Column:
    """The trusted rows that set the threshold; the model is counted without them."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % HELD_OUT == 0, F.lit(False))


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels")
    ratios = log_ratios(bin_counts(with_trust(docs, labels), "text", F.col("_trusted") & ~held_out(F.col("doc_id"))))
    # Numbers only: scored once, read for the threshold and for the result.
    scored = stash(score(docs, ratios), "scores")
    least = least_trusted(with_trust(scored, labels).filter(F.col("_trusted") & held_out(F.col("doc_id"))))
    return scored.withColumn("kept", ~F.col("base_failed") & (F.col("score") >= least)).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", F.round("score", 6).alias("score")
    )
