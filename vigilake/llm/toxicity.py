"""Toxicity: compression-distance classification with zstandard dictionaries.

Two dictionaries: one of ordinary text, and one that has the same text behind what is telling of toxic documents (the
stretches of their words whose letter sequences ordinary documents hardly have). A window is ``WINDOW`` words, ``STRIDE`` words after the
last one; its distance is its compressed length under the ordinary dictionary less that under the toxic one. As both hold the
same ordinary text, words of no interest compress alike and the distance is that of the rest. A document's score is a
logistic curve over how many of its windows, and which share of them, reach each of some thresholds. The curve,
the length of the sequences and how telling they must be are chosen on labelled documents that the dictionaries did not see.
Dictionaries trained on whole toxic texts tell little: toxic words are one in sixty of them (figures in the README).

Fitting uses at most ``MOST_TOXIC`` and ``MOST_ORDINARY`` labelled documents (those with the smallest md5 of their id),
with whole texts, on the driver: that bound holds for any input; the curve is then moved to the classes' true shares. Scoring
is one pass over the documents without a shuffle; very long texts are cut into windows ``PIECE_CHARS`` characters at a time.

Defined results: a null or empty text has no window and gets the curve's value at none. Repeated rows are scored each.
Labels with a null id or class are left out; without labels of both classes every score is the share of toxic ones.
Extra columns are passed through by ``score_documents``.
"""

from __future__ import annotations

import math
from array import array
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from itertools import product

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vigilake.llm.common import table

MOST_TOXIC, MOST_ORDINARY = 1500, 4000
PIECE_CHARS = 1 << 20
PUNCTUATION = ".,;:!?\"'()#*$%&|<>"
WINDOW, STRIDE, LEVEL = 6, 3, 4
ORDINARY_BYTES = 3 << 15
#: To choose from: letters of a sequence, spaces at word ends included; how much commoner it must be among toxic documents, and in which
#: share of them it must occur.
SEQUENCES, COMMONER, LEAST_SHARES = (7, 9), (10.0, 25.0), (0.015, 0.03)
#: At this level the codec looks up every third place of a dictionary.
PLACES = 3
THRESHOLDS = (1, 2, 3, 4, 6)
#: Distance of the windows that are counted as toxic in the result.
TOXIC_FROM = 3


@dataclass(frozen=True)
class Model:
    toxic: bytes
    ordinary: bytes
    weights: tuple[float, ...]


def pieces(text: str, chars: int = PIECE_CHARS) -> Iterator[list[str]]:
    """Lower-case words of a text, a bounded number at a time."""
    at = 0
    while at < len(text):
        end = at + chars
        while end < len(text) and not text[end].isspace():
            end += 1
        yield text[at:end].lower().split()
        at = end


def plain_words(text: str) -> list[str]:
    return [w for piece in pieces(text) for w in (x.strip(PUNCTUATION) for x in piece) if w]


def sequences(word: str, length: int) -> set[str]:
    s = f" {word} "
    return {s[i : i + length] for i in range(max(1, len(s) - length + 1))}


def stretches(word: str, telling: set[str], length: int) -> str:
    """The letters of a word, spaces at its ends included, that telling sequences cover."""
    s = f" {word} "
    keep = [False] * len(s)
    for i in range(max(1, len(s) - length + 1)):
        if s[i : i + length] in telling:
            keep[i : i + length] = [True] * min(length, len(s) - i)
    return "".join(c for c, k in zip(s, keep, strict=True) if k)


def windows(words: list[str]) -> list[bytes]:
    """Windows of the words: every ``STRIDE`` words one, the last ends with the text."""
    coded = [w.encode("utf-8", "replace") for w in words]
    return [b" " + b" ".join(coded[i : i + WINDOW]) + b" " for i in range(0, max(min(1, len(coded)), len(coded) - (WINDOW - STRIDE)), STRIDE)]


def toxic_part(stretches: Counter) -> bytes:
    """The stretches, the commonest last, once for each of the places that the codec may look up; of a length that leaves what follows in place."""
    text, out = b"".join(s.encode("utf-8", "replace") for s, _ in sorted(stretches.items(), key=lambda x: (x[1], x[0]))), b""
    for place in range(PLACES):
        out += b"." * ((place - len(out)) % PLACES) + text
    return out + b"." * (-len(out) % (8 * PLACES))


def codec(dictionary: bytes) -> zstandard.ZstdCompressor:
    options = {"write_checksum": False, "write_content_size": False, "write_dict_id": False}
    if not dictionary:
        return zstandard.ZstdCompressor(level=LEVEL, **options)
    data = zstandard.ZstdCompressionDict(dictionary, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    data.precompute_compress(LEVEL)
    return zstandard.ZstdCompressor(level=LEVEL, dict_data=data, **options)


def lengths(under: zstandard.ZstdCompressor, found: list[bytes]) -> np.ndarray:
    """Compressed length of each window."""
    return np.fromiter((len(under.compress(w)) for w in found), dtype=np.int64, count=len(found))


class Distance:
    """How much shorter a window gets under the toxic dictionary than under the ordinary one."""

    def __init__(self, toxic: bytes, ordinary: bytes):
        self.under_toxic, self.under_ordinary = codec(toxic + ordinary), codec(ordinary)

    def __call__(self, found: list[bytes]) -> np.ndarray:
        plain, toxic = self.under_ordinary.compress, self.under_toxic.compress
        return np.fromiter((len(plain(w)) - len(toxic(w)) for w in found), dtype=np.int64, count=len(found))


class Coded:
    """Texts as their plain words, four bytes a word; each different word is held once."""

    def __init__(self):
        self.places: dict[str, int] = {}
        self.words: list[str] = []

    def code(self, text: str) -> array:
        out = array("I")
        for w in plain_words(text):
            place = self.places.setdefault(w, len(self.words))
            if place == len(self.words):
                self.words.append(w)
            out.append(place)
        return out

    def of(self, coded: Iterable[int]) -> list[str]:
        return [self.words[i] for i in coded]


def features(distances: np.ndarray) -> list[float]:
    counts = [int((distances >= t).sum()) for t in THRESHOLDS]
    share = 1000.0 / max(1, len(distances))
    return [1.0, *map(math.log1p, counts), *(math.log1p(share * c) for c in counts), *(math.log1p(int((distances <= -t).sum())) for t in (1, 2))]


NO_TOXIC = len(features(np.zeros(0, dtype=np.int64)))


def fit_curve(x: np.ndarray, y: np.ndarray, ridge: float = 0.05, steps: int = 50) -> tuple[np.ndarray, float]:
    """Logistic weights by Newton's method, and the mean log-loss."""
    w = np.zeros(x.shape[1])
    penalty = np.diag([1e-6, *[ridge] * (x.shape[1] - 1)])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve(x.T @ (x * (p * (1 - p) + 1e-9)[:, None]) + penalty, x.T @ (y - p) - penalty @ w)
        w = w + np.clip(step, -5, 5)
    p = np.clip(1 / (1 + np.exp(-np.clip(x @ w, -30, 30))), 1e-9, 1 - 1e-9)
    return w, float(-np.mean(y * np.log(p) + (1 - y) * np.log(1 - p)))


def last_bytes(documents: list[array], coded: Coded, most: int) -> bytes:
    """The last ``most`` bytes of the documents' words, a space between words and on both sides of a document."""
    parts, size = [], 0
    for words in reversed(documents):
        if size >= most:
            break
        parts.append(f" {' '.join(coded.of(words))} ".encode("utf-8", "replace"))
        size += len(parts[-1])
    return b"".join(reversed(parts))[-most:]


def document_counts(seen: list[tuple[array, int]], coded: Coded, length: int, least: int) -> dict[str, list[int]]:
    """Ordinary and toxic documents with each sequence that ``least`` toxic ones or more have."""
    toxic = Counter()
    for words, k in seen:
        if k:
            toxic.update(set().union(*(sequences(coded.words[i], length) for i in set(words))))
    counts = {s: [0, c] for s, c in toxic.items() if c >= least}
    del toxic
    # A word holds references to these strings only.
    one = {s: s for s in counts}
    of_word: dict[int, tuple[str, ...]] = {}
    for words, k in seen:
        if not k:
            own: set[str] = set()
            for i in set(words):
                if i not in of_word:
                    of_word[i] = tuple(one[s] for s in sequences(coded.words[i], length) if s in one)
                own.update(of_word[i])
            for s in own:
                counts[s][0] += 1
    return counts


def fit(rows: list[tuple[str, int]], toxic_share: float | None = None) -> Model:
    """Model of (text, class) pairs; two thirds make the dictionaries, one third the curve.

    ``toxic_share``: share of toxic rows where the pairs were drawn from, if not that of the pairs.
    """
    drawn = sum(y for _, y in rows) / len(rows) if rows else 0.0
    if not 0 < drawn < 1:
        return Model(b"", b"", (math.log((drawn + 1e-3) / (1 - drawn + 1e-3)), *[0.0] * (NO_TOXIC - 1)))
    # The driver holds no more of the texts than codes of their words; words, sequences and windows of one document at a time.
    coded, seen, held = Coded(), [], []
    number, n_rows = [0, 0], [sum(1 for _, y in rows if y == k) for k in (0, 1)]
    for text, k in rows:
        i, few = number[k], n_rows[k] < 3
        number[k] += 1
        words = coded.code(text)
        if i % 3 or few:
            seen.append((words, k))
        if not i % 3 or few:
            held.append((words, k))
    # By class, as the curve's sums are taken in this order.
    seen, held = sorted(seen, key=lambda x: x[1]), sorted(held, key=lambda x: x[1])
    n = [sum(1 for _, k in seen if k == c) for c in (0, 1)]
    ordinary = last_bytes([words for words, k in seen if not k], coded, ORDINARY_BYTES)
    y = np.array([k for _, k in held], dtype=float)
    under_ordinary = codec(ordinary)
    plain = [lengths(under_ordinary, windows(coded.of(words))) for words, _ in held]
    occurrences = Counter()
    for words, k in seen:
        if k:
            occurrences.update(words)
    least_of = {share: min(n[1], max(2, math.ceil(share * n[1]))) for share in LEAST_SHARES}
    best = None
    for length in SEQUENCES:
        counts = document_counts(seen, coded, length, min(least_of.values()))
        for commoner, share in product(COMMONER, LEAST_SHARES):
            telling = {s for s, (a, b) in counts.items() if b >= least_of[share] and b / n[1] > commoner * (a + 0.5) / (n[0] + 1)}
            chosen = Counter()
            for i, times in occurrences.items():
                if s := stretches(coded.words[i], telling, length):
                    chosen[s] += times
            toxic = toxic_part(chosen)
            under_toxic = codec(toxic + ordinary)
            x = [features(p - lengths(under_toxic, windows(coded.of(words)))) for (words, _), p in zip(held, plain, strict=True)]
            w, loss = fit_curve(np.array(x), y)
            if best is None or loss < best[0]:
                best = (loss, toxic, [float(v) for v in w])
    odds = lambda p: math.log(p / (1 - p))
    weights = best[2]
    weights[0] += odds(toxic_share) - odds(drawn) if toxic_share and 0 < toxic_share < 1 else 0.0
    return Model(best[1], ordinary, tuple(weights))


def scorer(model: Model):
    """Arrow batches (text, ...) to the same rows without text, with n_windows, n_toxic and score."""

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        distance, weights = Distance(model.toxic, model.ordinary), np.array(model.weights)
        for batch in batches:
            found = []
            for text in batch.column("text").to_pylist():
                parts = [distance(windows([w for w in (x.strip(PUNCTUATION) for x in words) if w])) for words in pieces(text or "")]
                found.append(np.concatenate(parts) if parts else np.zeros(0, dtype=np.int64))
            z = np.array([features(d) for d in found]).reshape(-1, NO_TOXIC) @ weights
            made = {
                "n_windows": pa.array([len(d) for d in found], pa.int64()), "n_toxic": pa.array([int((d >= TOXIC_FROM).sum()) for d in found], pa.int64()),
                "score": pa.array(1 / (1 + np.exp(-np.clip(z, -30, 30))), pa.float64())}
            kept = [c for c in batch.schema.names if c != "text"]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in kept], *made.values()], names=[*kept, *made])

    return score


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def labelled_sample(docs: DataFrame, labels: DataFrame) -> tuple[list[tuple[str, int]], float]:
    """At most MOST_TOXIC and MOST_ORDINARY (text, class) of labelled rows that are not held out, and the share of toxic ones of all those."""
    usable = labels.filter(F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1) & ~held_out(F.col("doc_id"))).select("doc_id", "toxic").distinct()
    order = F.md5(F.col("doc_id").cast("string").cast("binary"))
    chosen = None
    for kind, most in ((1, MOST_TOXIC), (0, MOST_ORDINARY)):
        some = usable.filter(F.col("toxic") == kind).orderBy(order, "doc_id").limit(most)
        chosen = some if chosen is None else chosen.unionByName(some)
    # Bounded by the two limits, ids and classes only.
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("doc_id", F.coalesce("text", F.lit("")).alias("text"), "toxic").collect()
    share = usable.agg(F.avg("toxic")).first()[0]
    return [(r.text, r.toxic) for r in sorted(rows, key=lambda r: (r.doc_id, r.text))], share or 0.0


def score_documents(docs: DataFrame, model: Model) -> DataFrame:
    """Rows of ``docs`` without text, with n_windows, n_toxic, score (0 to 1) and predicted (1: toxic)."""
    made = {"n_windows", "n_toxic", "score", "predicted"}
    kept = [f for f in docs.schema.fields if f.name not in made]
    rows = docs.select(*[F.col(f"`{f.name}`") for f in kept])
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in kept if f.name != "text"] + ["n_windows long, n_toxic long, score double"])
    return rows.mapInArrow(scorer(model), schema).withColumn("predicted", F.when(F.col("score") >= 0.5, 1).otherwise(0))


def fit_from(docs: DataFrame, labels: DataFrame) -> Model:
    return fit(*labelled_sample(docs, labels))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = score_documents(docs, fit_from(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted", "n_windows", "n_toxic")


def without_toxic(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of ``docs`` that are not predicted toxic, in its own columns."""
    return score_documents(docs.select(F.struct("*").alias("_row"), "text"), model).filter("predicted = 0").select("_row.*")
