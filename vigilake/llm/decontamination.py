"""Benchmark decontamination: BM25 inverted index of test items searched with block-max WAND.

Every document is cut into overlapping passages, long enough that a copy of any item lies whole in one of them. Each
passage is a query against the index of test items; all items whose BM25 score reaches ``SHARE`` of the score of the
item itself are retrieved, not just a top k. A retrieved item is a leak if the passage holds at least ``OVERLAP`` of its
five-word shingles and at least ``PART_OVERLAP`` of those of its question (first half) and of its answer (second half).

Scores are stored as shares of the item's own score, so one threshold serves all items. An item's light terms are those
of least weight that together stay below ``LIGHT``; without enough of the other, heavy ones it cannot reach the threshold.
So before a passage is searched, the heavy shares of its words are summed per item, for all passages of a batch at once;
light terms are taken as present, so the sum is never below the score and no item is lost.

The index is built from at most about ``ITEMS_AT_ONCE`` items at a time; more items are searched in blocks, each a pass
over the documents. Weights and passages follow all items, so blocks change no result. Documents are never shuffled.

Defined results: null and empty texts leak nothing; items without words are left out; equal items count each. An item of
fewer than five words is one shingle. Repeated document rows are reported each. A row with a null id keeps it.
Extra columns are passed through by ``without_leaks`` and left out by ``leaks``.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vigilake.llm.common import stash, table

K1, B = 1.2, 0.75
SHARE, LIGHT = 0.5, 0.3
SHINGLE, OVERLAP, PART_OVERLAP = 5, 0.8, 0.5
#: Postings of a block.
BLOCK = 8
ITEMS_AT_ONCE = 20_000
#: Characters of a long text, and documents, looked at together.
PIECE_CHARS, ROWS = 1 << 20, 128
WORD = re.compile(r"\w+")
LEAKS = "array<struct<item_id:bigint,score:double,question_overlap:double,answer_overlap:double>>"


def shingles(words: list[str]) -> set[tuple[str, ...]]:
    return {tuple(words[i : i + SHINGLE]) for i in range(max(1, len(words) - SHINGLE + 1))} if words else set()


@dataclass(frozen=True)
class Statistics:
    """Of all items, however they are dealt over blocks: their number, mean and largest number of words, and how many hold a term."""

    n: int
    mean: float
    longest: int
    held: dict[str, int]


def statistics_of(cut: list[list[str]]) -> Statistics:
    """Of items given as words."""
    cut = [w for w in cut if w]
    return Statistics(len(cut), sum(map(len, cut)) / max(1, len(cut)), max(map(len, cut), default=0), Counter(t for w in cut for t in set(w)))


class Index:
    """Postings of test items: per term the items, their shares of score, and the largest share in each block."""

    def __init__(self, items: list[tuple[int, str]], statistics: Statistics | None = None):
        cut = [(i, WORD.findall((t or "").lower())) for i, t in items]
        cut = [(i, w) for i, w in cut if w]
        of_all = statistics or statistics_of([w for _, w in cut])
        self.ids = [i for i, _ in cut]
        self.words = [w for _, w in cut]
        self.span = math.ceil(1.25 * of_all.longest) + SHINGLE
        held, mean = of_all.held, of_all.mean
        postings: dict[str, list[tuple[int, float]]] = {}
        for k, (_, w) in enumerate(cut):
            norm = K1 * (1 - B + B * len(w) / mean)
            weights = {t: math.log(1 + (of_all.n - held[t] + 0.5) / (held[t] + 0.5)) * n * (K1 + 1) / (n + norm) for t, n in Counter(w).items()}
            own = sum(weights.values())
            for t, v in weights.items():
                postings.setdefault(t, []).append((k, v / own))
        self.terms = {t: n for n, t in enumerate(postings)}
        self.postings = [([k for k, _ in p], [v for _, v in p]) for p in postings.values()]
        self.block_max = [[max(v[i : i + BLOCK]) for i in range(0, len(v), BLOCK)] for _, v in self.postings]
        self.most = [max(v) for _, v in self.postings]
        # Heavy postings end to end, for the bound over many passages.
        light = np.zeros(len(cut))
        heavy: list[list[tuple[int, float]]] = [[] for _ in postings]
        by_item: list[list[tuple[float, int]]] = [[] for _ in cut]
        for t, p in enumerate(postings.values()):
            for k, v in p:
                by_item[k].append((v, t))
        for k, terms in enumerate(by_item):
            for v, t in sorted(terms):
                if light[k] + v < LIGHT:
                    light[k] += v
                else:
                    heavy[t].append((k, v))
        self.needed = SHARE - 1e-9 - light
        self.starts = np.concatenate([[0], np.cumsum([len(h) for h in heavy])]).astype(np.int64)
        self.flat_items = np.array([k for h in heavy for k, _ in h], dtype=np.int64)
        self.flat_shares = np.array([v for h in heavy for _, v in h], dtype=np.float64)
        # Only terms that are heavy somewhere need a look.
        self.heavy_terms = {t: n for t, n in self.terms.items() if heavy[n]}

    def search(self, terms: list[int], share: float = SHARE) -> list[tuple[int, float]]:
        """All (item, score share) of at least ``share``: block-max WAND over the terms' postings."""
        found, slack = [], share - 1e-9
        at = {t: 0 for t in terms}
        current = lambda t: self.postings[t][0][at[t]] if at[t] < len(self.postings[t][0]) else math.inf
        while True:
            order = sorted((t for t in at if current(t) != math.inf), key=current)
            bound, pivot = 0.0, None
            for n, t in enumerate(order):
                bound += self.most[t]
                if bound >= slack:
                    pivot = n
                    break
            if pivot is None:
                return found
            item = current(order[pivot])
            while pivot + 1 < len(order) and current(order[pivot + 1]) == item:
                pivot += 1
            ahead = order[: pivot + 1]
            blocks = {t: self._block(t, at[t], item) for t in ahead}
            if sum(self.block_max[t][b] for t, b in blocks.items() if b is not None) >= slack:
                for t in ahead:
                    at[t] = self._seek(t, at[t], item)
                score = sum(self.postings[t][1][at[t]] for t in ahead if current(t) == item)
                if score >= slack:
                    found.append((item, score))
                onward = item + 1
            else:
                # No item up to the end of the shallowest block, or the next list's item, can reach the threshold.
                ends = [self.postings[t][0][min((b + 1) * BLOCK, len(self.postings[t][0])) - 1] + 1 for t, b in blocks.items() if b is not None]
                following = [current(order[pivot + 1])] if pivot + 1 < len(order) else []
                onward = max(item + 1, min([*ends, *following], default=item + 1))
            for t in ahead:
                at[t] = self._seek(t, at[t], onward)

    def _block(self, t: int, begin: int, item: int) -> int | None:
        """Block that would hold ``item``."""
        items = self.postings[t][0]
        for b in range(begin // BLOCK, len(self.block_max[t])):
            if items[min((b + 1) * BLOCK, len(items)) - 1] >= item:
                return b
        return None

    def _seek(self, t: int, begin: int, item: int) -> int:
        items = self.postings[t][0]
        while begin < len(items) and items[begin] < item:
            begin += 1
        return begin

    def overlaps(self, item: int, passage: set[tuple[str, ...]]) -> tuple[float, float, float]:
        """Share of the item's, its question's and its answer's shingles that the passage holds."""
        words = self.words[item]
        half = (len(words) + 1) // 2
        parts = [shingles(words), shingles(words[:half]), shingles(words[half:])]
        # A part shorter than a shingle is judged with the whole.
        parts = [p if len(next(iter(p), ())) == len(next(iter(parts[0]))) else parts[0] for p in parts]
        return tuple(len(p & passage) / len(p) for p in parts)

    def hopeful(self, codes: np.ndarray, texts: np.ndarray) -> list[tuple[int, int]]:
        """(text, begin) of the passages in which some item could reach the threshold.

        ``codes`` are numbers of heavy terms (-1: none) of the words of several texts end to end, ``texts`` where each begins.
        """
        step = self.span
        position = np.arange(len(codes)) - np.repeat(texts[:-1], np.diff(texts))
        windows = np.maximum(1, -(-np.diff(texts) // step))
        first = np.concatenate([[0], np.cumsum(windows)])
        window = np.repeat(first[:-1], np.diff(texts)) + position // step
        hit = codes >= 0
        terms, window, inner = codes[hit], window[hit], (position // step > 0)[hit]
        # A passage is two steps long: a word lies in that of its own step and in the one before. Each word counts once.
        pairs = np.unique(np.concatenate([window, window[inner] - 1]) * len(self.terms) + np.concatenate([terms, terms[inner]]))
        window, terms = pairs // len(self.terms), pairs % len(self.terms)
        sizes = self.starts[terms + 1] - self.starts[terms]
        flat = np.repeat(self.starts[terms] - np.concatenate([[0], np.cumsum(sizes)[:-1]]), sizes) + np.arange(sizes.sum())
        cells, inverse = np.unique(np.repeat(window, sizes) * len(self.ids) + self.flat_items[flat], return_inverse=True)
        sums = np.bincount(inverse, weights=self.flat_shares[flat], minlength=len(cells))
        reach = np.unique(cells[sums >= self.needed[cells % len(self.ids)]] // len(self.ids))
        text = np.searchsorted(first, reach, side="right") - 1
        return [(int(t), int((r - first[t]) * step)) for t, r in zip(text, reach, strict=True)]

    def passage_leaks(self, words: list[str]) -> dict[int, tuple[float, float, float]]:
        terms = sorted({self.terms[w] for w in words if w in self.terms})
        out = {}
        retrieved = self.search(terms)
        held = shingles(words) if retrieved else set()
        if any(len(self.words[i]) < SHINGLE for i, _ in retrieved):
            held = held | {tuple(words[a : a + n]) for n in range(1, SHINGLE) for a in range(len(words) - n + 1)}
        for item, score in retrieved:
            whole, question, answer = self.overlaps(item, held)
            if whole >= OVERLAP and question >= PART_OVERLAP and answer >= PART_OVERLAP:
                out[item] = (score, question, answer)
        return out


def pieces(text: str, carry: int) -> Iterator[list[str]]:
    """Words of a text, a bounded number at a time; each piece begins with the last ``carry`` words of the one before."""
    at, last = 0, []
    while at < len(text):
        end = at + PIECE_CHARS
        while end < len(text) and not text[end].isspace():
            end += 1
        words = last + WORD.findall(text[at:end].lower())
        yield words
        last, at = words[-carry:], end


def searcher(index: Index, keep_text: bool):
    """Arrow batches with ``text`` to the same rows with ``_leaks``."""

    def leaks_of(texts: list[str | None]) -> list[dict]:
        owner, cut = [], []
        for n, t in enumerate(texts):
            for words in pieces(t or "", index.span * 2):
                owner.append(n)
                cut.append(words)
        out: list[dict] = [{} for _ in texts]
        if not cut or not index.ids:
            return out
        known = index.heavy_terms
        texts_at = np.concatenate([[0], np.cumsum([len(w) for w in cut])]).astype(np.int64)
        codes = np.fromiter((known.get(w, -1) for words in cut for w in words), dtype=np.int64, count=int(texts_at[-1]))
        for k, begin in index.hopeful(codes, texts_at):
            for item, facts in index.passage_leaks(cut[k][begin : begin + 2 * index.span]).items():
                mine = out[owner[k]]
                mine[item] = max(mine.get(item, facts), facts)
        return out

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for a in range(0, whole.num_rows, ROWS):
                batch = whole.slice(a, ROWS)
                found = leaks_of(batch.column("text").to_pylist())
                rows = [[{"item_id": index.ids[i], "score": s, "question_overlap": q, "answer_overlap": o} for i, (s, q, o) in sorted(f.items())] for f in found]
                kind = pa.list_(pa.struct([("item_id", pa.int64()), ("score", pa.float64()), ("question_overlap", pa.float64()), ("answer_overlap", pa.float64())]))
                kept = [c for c in batch.schema.names if keep_text or c != "text"]
                yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in kept], pa.array(rows, kind)], names=[*kept, "_leaks"])

    return search


def cut_items(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(block, text) to (block, size, terms): number of words and different words of each item."""
    for batch in batches:
        cut = [WORD.findall(t.lower()) for t in batch.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays(
            [batch.column("block"), pa.array(map(len, cut), pa.int64()), pa.array([sorted(set(w)) for w in cut], pa.list_(pa.string()))], names=["block", "size", "terms"])


def item_blocks(items: DataFrame, most: int | None = None) -> Iterator[tuple[list[tuple[int, str]], Statistics | None]]:
    """(item_id, text) in blocks of about ``most``, each small enough for the driver and every task, with the statistics of all items.

    Of the document frequencies only those of the block's own terms come to the driver. One block is its own statistics.
    """
    most = most or ITEMS_AT_ONCE
    usable = items.select(F.col("item_id").cast("long").alias("item_id"), "text").filter("text is not null")
    n = max(1, math.ceil(usable.count() / most))
    usable = usable.withColumn("block", F.pmod(F.xxhash64("item_id", "text"), F.lit(n)).cast("int"))
    if n > 1:
        sizes = stash(usable.select("block", "text").mapInArrow(cut_items, "block int, size long, terms array<string>").filter("size > 0"), "items")
        total = sizes.agg(F.count("*").alias("n"), F.sum("size").alias("words"), F.max("size").alias("longest")).first()
        terms = sizes.select("block", F.explode("terms").alias("term"))
        held = stash(terms.distinct().join(terms.groupBy("term").agg(F.count("*").alias("held")).hint("merge"), "term"), "held")
    for b in range(n):
        rows = sorted(((r.item_id, r.text) for r in usable.filter(F.col("block") == b).collect()), key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
        if n == 1:
            yield rows, None
        else:
            mine = {r.term: r.held for r in held.filter(F.col("block") == b).select("term", "held").collect()}
            yield rows, Statistics(total.n, (total.words or 0) / max(1, total.n), total.longest or 0, mine)


def with_leaks(docs: DataFrame, items: list[tuple[int, str]], keep_text: bool, statistics: Statistics | None = None) -> DataFrame:
    kept = [f for f in docs.schema.fields if f.name != "_leaks" and (keep_text or f.name != "text")]
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in kept] + [f"_leaks {LEAKS}"])
    return docs.mapInArrow(searcher(Index(items, statistics), keep_text), schema)


def leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, item_id, score, question_overlap, answer_overlap): one row per document row and leaked item."""
    out = None
    for items, statistics in item_blocks(benchmark):
        found = with_leaks(docs.select("doc_id", "text"), items, keep_text=False, statistics=statistics).select("doc_id", F.explode("_leaks").alias("_l")).select("doc_id", "_l.*")
        out = found if out is None else out.unionByName(found)
    return out


def without_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs`` that leak no item, in its own columns."""
    out = docs.select(F.struct("*").alias("_row"), "text")
    for items, statistics in item_blocks(benchmark):
        out = with_leaks(out, items, keep_text=True, statistics=statistics).filter(F.size("_leaks") == 0).drop("_leaks")
    return out.select("_row.*")


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "item_id", F.round("score", 6).alias("score"), F.round("question_overlap", 6).alias("question_overlap"), F.round("answer_overlap", 6).alias("answer_overlap"))
