"""Quality classifier: a linear-chain conditional random field labels every line good or bad.

A line (``\\n``-split, with at least one word; one of more than ``SEGMENT`` characters counts as several) has counts of its own: length, kinds
of characters, repeated words, whether it repeats an earlier line of its text. The features of a line are these, and those
of the line before and after. Forward and backward sums over the chain give each line's probability to be good; their mean,
weighted by the lines' characters, and the worst line's are turned into the document's score by a logistic curve.

The field is fitted on at most ``FIT_DOCUMENTS`` labelled documents (the smallest md5 of their id; equal ids give one row)
that are not held out; of a long one ``FIT_LINES`` neighbouring lines, from a place that its id decides. Only their counts come
to the driver. At first a line takes its document's label; then lines of bad documents that look good by themselves
are good, unless the whole document would be. Two thirds of the documents fit the field, one third the curve.
Scoring is one pass over the documents without a shuffle, whole texts, all lines.

Defined results: null, empty and blank texts have no line and get the share of good labels among the fitted documents.
Repeated rows are scored each. Labels with a null id or class are left out; without labels of both classes every score is
the share of good ones (1 without any label). Columns beside the made ones are passed through by ``score_documents``.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vigilake.llm.common import table

FIT_DOCUMENTS, FIT_LINES = 6000, 64
#: Least score of a document that counts as good: a fixed value of the task.
LEAST_SCORE = 0.3
SEGMENT, CHUNK_BYTES = 1 << 16, 1 << 20
#: Steps, rate and penalty of the fit; rounds of relabelling; probability from which a line of a bad document looks good.
STEPS, RATE, RIDGE, ROUNDS, LOOKS_GOOD = 150, 0.1, 1e-3, 2, 0.9

#: Kinds of bytes: 0 other letters of ASCII, 1 space, 2 capitals, 3 digits, 4 symbols, 5 exclamation marks, 6 stops, 7 beyond ASCII.
KINDS = 8
KIND = np.zeros(256, dtype=np.int64)
for _kind, _bytes in enumerate([b" \t\x0b\x0c\r", bytes(range(65, 91)), b"0123456789", b"#*$%&|<>=_~^@\\/{}[]+", b"!", b".,;:?"], start=1):
    KIND[list(_bytes)] = _kind
KIND[128:] = 7
#: Features of a line by itself.
OWN = 13
FEATURES = 3 * OWN + 3
BASE = np.uint64(0x9E3779B97F4A7C15)
INVERSE = np.uint64(pow(int(BASE), -1, 1 << 64))
MIX = [np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)]


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * MIX[0]
    return x ^ (x >> np.uint64(27))


BYTE_HASH = mixed(np.arange(1, 257, dtype=np.uint64) * MIX[1])
POWERS = np.full(CHUNK_BYTES + 8 * SEGMENT, BASE, dtype=np.uint64)
POWERS[0] = 1
POWERS = np.cumprod(POWERS)
BACK = np.full(len(POWERS), INVERSE, dtype=np.uint64)
BACK[0] = 1
BACK = np.cumprod(BACK)


def lines_of(text: str | None) -> list[bytes]:
    """Lines with a word, as UTF-8; long ones in segments, cut behind a space where there is one."""
    out = []
    for line in (text or "").split("\n"):
        at = 0
        while len(line) - at > SEGMENT:
            space = line.rfind(" ", at, at + SEGMENT)
            end = space + 1 if space > at else at + SEGMENT
            out.append(line[at:end])
            at = end
        out.append(line[at:] if at else line)
    return [x.encode("utf-8", "surrogatepass") for x in out if x.strip(" \t\x0b\x0c\r")]


def line_counts(lines: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Own features of the lines (all but the one of earlier lines), characters outside spaces, and a hash of each."""
    data = np.frombuffer(b"\n".join(lines) + b"\n", dtype=np.uint8)
    n = len(lines)
    end = np.cumsum(np.fromiter(map(len, lines), dtype=np.int64, count=n) + 1) - 1
    owner = np.repeat(np.arange(n), np.diff(np.concatenate([[-1], end])))
    kind = KIND[data]
    kind[end] = 1
    kinds = np.bincount(owner * KINDS + kind, minlength=n * KINDS).reshape(n, KINDS).astype(np.float64)
    # Hashes of words and lines by prefix polynomials.
    prefix = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum(BYTE_HASH[data] * POWERS[: len(data)], out=prefix[1:])
    hashed = lambda a, b: mixed((prefix[b] - prefix[a]) * BACK[a] + (b - a).astype(np.uint64))
    inside = kind != 1
    step = np.diff(np.concatenate([[0], inside.astype(np.int8), [0]]))
    begin, stop = np.flatnonzero(step == 1), np.flatnonzero(step == -1)
    word, of = hashed(begin, stop), owner[begin]
    words = np.bincount(of, minlength=n).astype(np.float64)
    again = np.concatenate([[False], (word[1:] == word[:-1]) & (of[1:] == of[:-1])])
    repeats = np.bincount(of[again], minlength=n)
    first = np.unique(mixed(word ^ (of.astype(np.uint64) * BASE)), return_index=True)[1]
    different = np.bincount(of[first], minlength=n)
    chars = np.maximum(kinds[:, [0, 2, 3, 4, 5, 6, 7]].sum(axis=1), 1)
    glued = np.bincount(of[kind[stop - 1] == 4], minlength=n)
    share = lambda k: np.sqrt(kinds[:, k] / chars)
    own = np.stack([
        np.log1p(words) / 5, np.minimum(chars / words / 10, 3), share(4), share(5), share(2), share(3), share(6), share(7),
        repeats / words, 1 - different / words, (words < 3).astype(float), glued / words, np.zeros(n),
    ], axis=1)
    return own, chars, hashed(np.concatenate([[0], end[:-1] + 1]), end)


def text_features(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Own features of all lines of the texts, their weights, and where each text's lines begin (and the last ones end)."""
    cut = [lines_of(t) for t in texts]
    starts = np.concatenate([[0], np.cumsum([len(c) for c in cut])]).astype(np.int64)
    flat = [line for c in cut for line in c]
    parts, at = [], 0
    while at < len(flat):
        size, end = 0, at
        while end < len(flat) and (end == at or size + len(flat[end]) < CHUNK_BYTES):
            size += len(flat[end]) + 1
            end += 1
        parts.append(line_counts(flat[at:end]))
        at = end
    if not parts:
        return np.zeros((0, OWN)), np.zeros(0), starts
    own, weight, line = (np.concatenate([p[k] for p in parts]) for k in range(3))
    # Lines that an earlier line of the same text equals.
    text = np.repeat(np.arange(len(texts)), np.diff(starts)).astype(np.uint64)
    first = np.unique(mixed(line ^ text * BASE), return_index=True)[1]
    own[:, -1] = 1
    own[first, -1] = 0
    return own, weight, starts


def with_neighbours(own: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Features of every line: a constant, its own, those of the line before and after, and whether there is none."""
    n = len(own)
    out = np.zeros((n, FEATURES))
    if not n:
        return out
    begins, ends = np.zeros(n, dtype=bool), np.zeros(n, dtype=bool)
    some = np.diff(starts) > 0
    begins[starts[:-1][some]] = True
    ends[starts[1:][some] - 1] = True
    out[:, 0] = 1
    out[:, 1 : 1 + OWN] = own
    before, after = np.flatnonzero(~begins), np.flatnonzero(~ends)
    out[before, 1 + OWN : 1 + 2 * OWN] = own[before - 1]
    out[after, 1 + 2 * OWN : 1 + 3 * OWN] = own[after + 1]
    out[:, -2], out[:, -1] = begins, ends
    return out


def chain(node: np.ndarray, switch: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Forward-backward over all chains at once.

    ``node``: log weight of good (bad has 0) per line; ``switch[i, j]``: log weight of label j behind label i. Returns log
    partition sums per chain, marginals (lines, 2) and pair marginals (lines, 2, 2) of each line with the one before.
    """
    n, size = len(node), np.diff(starts)
    order = np.argsort(-size, kind="stable")
    begin, size = starts[:-1][order], size[order]
    score = np.stack([np.zeros(n), node], axis=1)
    forward, backward = np.zeros((n, 2)), np.zeros((n, 2))
    log_z = np.zeros(len(size))
    longest = int(size[0]) if len(size) else 0
    active = [int(np.searchsorted(-size, -t, side="left")) for t in range(longest + 1)]  # chains with more than t lines
    live = active[0]
    if live:
        forward[begin[:live]] = score[begin[:live]]
    for t in range(1, longest):
        at = begin[: active[t]] + t
        step = forward[at - 1][:, :, None] + switch
        forward[at] = score[at] + np.logaddexp(step[:, 0], step[:, 1])
    if live:
        last = begin[:live] + size[:live] - 1
        log_z[order[:live]] = np.logaddexp(forward[last, 0], forward[last, 1])
    for t in range(longest - 2, -1, -1):
        at = begin[: active[t + 1]] + t
        step = switch + (score[at + 1] + backward[at + 1])[:, None, :]
        backward[at] = np.logaddexp(step[:, :, 0], step[:, :, 1])
    z = np.repeat(log_z, np.diff(starts))[:, None]
    marginal = np.exp(forward + backward - z)
    pair = np.zeros((n, 2, 2))
    if n > 1:
        inner = np.ones(n, dtype=bool)
        inner[starts[:-1][np.diff(starts) > 0]] = False
        at = np.flatnonzero(inner)
        pair[at] = np.exp(forward[at - 1][:, :, None] + switch + (score[at] + backward[at])[:, None, :] - z[at][:, :, None])
    return log_z, marginal, pair


def gradient(weights: np.ndarray, switch: np.ndarray, x: np.ndarray, y: np.ndarray, starts: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    """Log likelihood of the line labels y (0, 1) and its gradients."""
    node = x @ weights
    log_z, marginal, pair = chain(node, switch, starts)
    seen = np.zeros_like(pair)
    inner = np.ones(len(y), dtype=bool)
    inner[starts[:-1][np.diff(starts) > 0]] = False
    at = np.flatnonzero(inner)
    seen[at, y[at - 1], y[at]] = 1
    value = float(node @ y + (seen * switch).sum() - log_z.sum())
    return value, x.T @ (y - marginal[:, 1]), (seen - pair).sum(axis=0)


def fit_field(x: np.ndarray, y: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Weights of the features and of the switches: gradient ascent with Adam's steps, penalised."""
    theta = np.zeros(x.shape[1] + 4)
    mean, square = np.zeros_like(theta), np.zeros_like(theta)
    for t in range(1, STEPS + 1):
        _, g, h = gradient(theta[:-4], theta[-4:].reshape(2, 2), x, y, starts)
        slope = np.concatenate([g, h.ravel()]) / max(1, len(y)) - RIDGE * theta
        mean, square = 0.9 * mean + 0.1 * slope, 0.99 * square + 0.01 * slope**2
        theta = theta + RATE * (mean / (1 - 0.9**t)) / (np.sqrt(square / (1 - 0.99**t)) + 1e-8)
    return theta[:-4], theta[-4:].reshape(2, 2)


def document_facts(marginal: np.ndarray, weight: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Per document with lines: a constant, log odds of the weighted mean probability to be good, and of the worst line's."""
    some = np.diff(starts) > 0
    begin = starts[:-1][some]
    odds = lambda p: np.log((p + 1e-4) / (1 - p + 1e-4))
    out = np.zeros((len(some), 3))
    if len(begin):
        mean = np.add.reduceat(marginal * weight, begin) / np.add.reduceat(weight, begin)
        out[some] = np.stack([np.ones(len(begin)), odds(mean), odds(np.minimum.reduceat(marginal, begin))], axis=1)
    return out


def fit_curve(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2, steps: int = 40) -> np.ndarray:
    """Logistic weights by Newton's method."""
    w = np.zeros(x.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        w = w + np.clip(np.linalg.solve(x.T @ (x * (p * (1 - p) + 1e-9)[:, None]) + ridge * np.eye(len(w)), x.T @ (y - p) - ridge * w), -5, 5)
    return w


@dataclass(frozen=True)
class Model:
    weights: np.ndarray
    switch: np.ndarray
    curve: np.ndarray
    base: float


def fit(documents: list[tuple[np.ndarray, np.ndarray, int]]) -> Model:
    """Model of (own features of the lines, weights of the lines, label) of documents."""
    labels = [y for _, _, y in documents]
    base = sum(labels) / len(labels) if labels else 1.0
    usable = [d for d in documents if len(d[0])]
    field, held = [d for i, d in enumerate(usable) if i % 3], [d for i, d in enumerate(usable) if not i % 3]
    if len({d[2] for d in field}) < 2 or len({d[2] for d in held}) < 2:
        field = held = usable
    if len({d[2] for d in usable}) < 2:
        return Model(np.zeros(FEATURES), np.zeros((2, 2)), np.array([math.log((base + 1e-9) / (1 - base + 1e-9)), 0.0, 0.0]), base)

    def joined(some):
        starts = np.concatenate([[0], np.cumsum([len(d[0]) for d in some])]).astype(np.int64)
        own, weight = np.concatenate([d[0] for d in some]).astype(np.float64), np.concatenate([d[1] for d in some]).astype(np.float64)
        return with_neighbours(own, starts), weight, starts, np.array([d[2] for d in some])

    x, weight, starts, label = joined(field)
    of = np.repeat(np.arange(len(label)), np.diff(starts))
    y = label[of]
    for k in range(ROUNDS):
        weights, switch = fit_field(x, y, starts)
        if k + 1 < ROUNDS:
            # A line by itself: its own evidence without the chain's.
            alone = 1 / (1 + np.exp(-np.clip(x @ weights, -30, 30)))
            good = (label[of] == 0) & (alone >= LOOKS_GOOD)
            all_good = np.bincount(of[~good], minlength=len(label)) == 0
            y = np.where(good & ~all_good[of], 1, label[of])
    x, weight, starts, label = joined(held)
    marginal = chain(x @ weights, switch, starts)[1][:, 1]
    return Model(weights, switch, fit_curve(document_facts(marginal, weight, starts), label.astype(float)), base)


def scores(model: Model, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per text: score, number of lines, and length-weighted mean probability of its lines to be good."""
    own, weight, starts = text_features(texts)
    marginal = chain(with_neighbours(own, starts) @ model.weights, model.switch, starts)[1][:, 1]
    facts, n = document_facts(marginal, weight, starts), np.diff(starts)
    score = np.where(n > 0, 1 / (1 + np.exp(-np.clip(facts @ model.curve, -30, 30))), model.base)
    begin = starts[:-1][n > 0]
    mean = np.zeros(len(n))
    if len(begin):
        mean[n > 0] = np.add.reduceat(marginal * weight, begin) / np.add.reduceat(weight, begin)
    return score, n, mean


def some_at_a_time(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Rows of a batch with about ``CHUNK_BYTES`` of text together."""
    sizes = [len(t) if t else 0 for t in batch.column("text").to_pylist()]
    at = size = 0
    for i, s in enumerate(sizes):
        if size and size + s > CHUNK_BYTES:
            yield batch.slice(at, i - at)
            at, size = i, 0
        size += s
    if batch.num_rows > at:
        yield batch.slice(at)


def scorer(model: Model):
    """Arrow batches (text, …) to the same rows without text, with score, n_lines and good_share."""

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in some_at_a_time(whole):
                value, n, mean = scores(model, batch.column("text").to_pylist())
                kept = [c for c in batch.schema.names if c != "text"]
                yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in kept], pa.array(value), pa.array(n), pa.array(mean)], names=[*kept, "score", "n_lines", "good_share"])

    return score


def own_features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, quality, text) to (doc_id, quality, features, weights) of at most ``FIT_LINES`` neighbouring lines."""
    for batch in batches:
        features, weights = [], []
        for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
            own, weight, _ = text_features([text])
            begin = int(doc_id * int(BASE) % (1 << 64) % (len(own) - FIT_LINES + 1)) if len(own) > FIT_LINES else 0
            features.append(own[begin : begin + FIT_LINES].astype(np.float32).ravel().tolist())
            weights.append(weight[begin : begin + FIT_LINES].astype(np.float32).tolist())
        kind = pa.list_(pa.float32())
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), batch.column("quality"), pa.array(features, kind), pa.array(weights, kind)], names=["doc_id", "quality", "features", "weights"])


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def labelled_lines(docs: DataFrame, labels: DataFrame) -> list[tuple[np.ndarray, np.ndarray, int]]:
    """Features of the documents that the model is fitted on."""
    usable = labels.filter(F.col("doc_id").isNotNull() & F.col("quality").isin(0, 1) & ~held_out(F.col("doc_id"))).select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality")).distinct()
    # Bounded by the limit, ids and classes only.
    chosen = usable.orderBy(F.md5(F.col("doc_id").cast("string").cast("binary")), "doc_id", "quality").limit(FIT_DOCUMENTS)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(chosen), "doc_id")
    once = rows.groupBy("doc_id", "quality").agg(F.min(F.coalesce("text", F.lit(""))).alias("text"))
    found = once.mapInArrow(own_features, "doc_id long, quality int, features array<float>, weights array<float>").collect()
    return [(np.array(r.features, dtype=np.float64).reshape(-1, OWN), np.array(r.weights), r.quality) for r in sorted(found, key=lambda r: (r.doc_id, r.quality))]


def fit_from(docs: DataFrame, labels: DataFrame) -> Model:
    return fit(labelled_lines(docs, labels))


def score_documents(docs: DataFrame, model: Model) -> DataFrame:
    """Rows of ``docs`` without text, with score (0 to 1), n_lines, good_share and predicted (1: good)."""
    made = {"score", "n_lines", "good_share", "predicted"}
    kept = [f for f in docs.schema.fields if f.name not in made]
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in kept if f.name != "text"] + ["score double, n_lines long, good_share double"])
    rows = docs.select(*[F.col(f"`{f.name}`") for f in kept]).mapInArrow(scorer(model), schema)
    return rows.withColumn("predicted", F.when(F.col("score") >= LEAST_SCORE, 1).otherwise(0))


def op12_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = score_documents(docs, fit_from(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted", "n_lines", F.round("good_share", 6).alias("good_share"))
