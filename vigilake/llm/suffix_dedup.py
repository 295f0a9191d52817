"""Suffix-array dedup: removes every byte of a 400-byte string that also starts elsewhere in the corpus.

A sparse suffix array: of all suffixes only those at anchors are sorted. The anchor of a 400-byte string is the place
of its least ``GRAM``-byte hash (the leftmost if there are several), so equal strings have their anchor at the same place,
and neighbouring strings share anchors: there is about one in 140 bytes.

1. One pass over the texts cuts each into runs, the stretches of strings with one anchor, and gives each run the hash of
   its anchor's bytes and the hash of all its bytes. No text leaves the task.
2. Anchors whose hash occurs once cannot hold a repeated string. Runs that are equal as a whole (128 bits of two
   independent hashes) are repeated as a whole; exact copies end here, in sums with map-side combine.
3. Different runs around equal anchors are compared by their bytes, one of each: in a group the suffixes that begin at
   the anchors are merge-sorted, each comparison finding the common extension by binary search over prefix polynomial
   hashes, and so are the reversed prefixes; the found extensions are verified byte by byte, so a collision cannot
   count. The two orders give the classes of equal right and left parts at every distance, and strings that share both
   classes are equal. A task sees at most ``GROUP`` runs of a group.
4. Around an anchor with more different runs than that, every string is a row (its 128-bit hash), and sums with map-side
   combine find the equal ones: exact, and no group meets in one task.
5. The repeated stretches go back to their documents.

Texts travel compressed, and only for steps 3 and 5.

Defined results: a null text counts as empty; shorter texts than ``LENGTH`` lose nothing. Repeated rows are copies of each
other and lose all but what is shorter. Copies are not kept in one place: a string found twice is removed twice.
Extra columns are passed through by ``without_repeats`` and left out by ``removals``.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vigilake.llm.common import stash, table

LENGTH, GRAM = 400, 128
GROUP = 2000
#: Bytes looked at together, and the most of one piece of a long text. Places in the buffer take PLACE_BITS.
BUFFER, PIECE, PLACE_BITS = 1 << 20, 1 << 19, 20
MASK = (1 << 64) - 1
BASES = (0x9E3779B97F4A7C15, 0xD1342543DE82EF95)
MIX = (np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * MIX[0]
    x = (x ^ (x >> np.uint64(27))) * MIX[1]
    return x ^ (x >> np.uint64(31))


@functools.lru_cache(maxsize=4)
def powers(base: int, n: int) -> np.ndarray:
    """base ** 0 ... base ** n modulo 2 ** 64."""
    out = np.full(n + 1, base, dtype=np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


class PrefixHashes:
    """Polynomial hash of any stretch of a byte string from the hashes of its prefixes."""

    def __init__(self, data: np.ndarray, base: int, most: int):
        self.inverse = powers(pow(base, -1, 1 << 64), most)
        self.prefix = np.zeros(len(data) + 1, dtype=np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * powers(base, most)[: len(data)], out=self.prefix[1:])

    def of(self, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        return (self.prefix[end] - self.prefix[begin]) * self.inverse[begin]


def least_places(keys: np.ndarray, width: int) -> np.ndarray:
    """Least key of every window of ``width`` keys: of the end of one block and the beginning of the next."""
    n = len(keys) - width + 1
    padded = np.full(-(-len(keys) // width) * width, np.uint64(MASK))
    padded[: len(keys)] = keys
    blocks = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[:n], ahead[width - 1 : width - 1 + n])


def runs(buffer: np.ndarray, piece_ends: np.ndarray) -> tuple[np.ndarray, ...]:
    """(first, last, anchor, anchor hash, run hash) of every run in a buffer of pieces; a run lies in one piece.

    ``first`` and ``last`` are where its first and last 400-byte strings begin.
    """
    none = np.empty(0, dtype=np.int64)
    if len(buffer) < LENGTH:
        return none, none, none, none, none
    grams = PrefixHashes(buffer, BASES[0], BUFFER)
    places = np.arange(len(buffer) - GRAM + 1)
    hashes = mixed(grams.of(places, places + GRAM))
    keys = (hashes & np.uint64(MASK << PLACE_BITS & MASK)) | places.astype(np.uint64)
    anchors = (least_places(keys, LENGTH - GRAM + 1) & np.uint64((1 << PLACE_BITS) - 1)).astype(np.int64)
    piece = np.searchsorted(piece_ends, np.arange(len(anchors)), side="right")
    inside = np.arange(len(anchors)) + LENGTH <= piece_ends[piece]
    code = np.where(inside, anchors, -1)
    begins = np.flatnonzero(np.concatenate([[True], code[1:] != code[:-1]]))
    lasts = np.concatenate([begins[1:], [len(code)]]) - 1
    real = code[begins] >= 0
    first, last = begins[real], lasts[real]
    anchor = code[first]
    whole = PrefixHashes(buffer, BASES[1], BUFFER).of(first, last + LENGTH)
    whole = mixed(mixed(whole ^ (anchor - first).astype(np.uint64) << np.uint64(32)) + (last - first).astype(np.uint64))
    return first, last, anchor, hashes[anchor].view(np.int64), whole.view(np.int64)


def pieces(data: bytes) -> Iterator[tuple[int, bytes]]:
    """(offset, bytes): long texts in pieces that overlap by one byte less than ``LENGTH``."""
    for at in range(0, max(1, len(data) - LENGTH + 1), PIECE - LENGTH + 1):
        yield at, data[at : at + PIECE]


def anchored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, _key, text) to a row for each run: doc_id, _key, a, r, first, last, lead."""
    for batch in batches:
        ids, keys = batch.column("doc_id").to_pylist(), batch.column("_key").to_pylist()
        held, size, out = [], 0, []

        def flush() -> None:
            if not held:
                return
            buffer = np.frombuffer(b"".join(b for _, _, b in held), dtype=np.uint8)
            ends = np.cumsum([len(b) for _, _, b in held])
            first, last, anchor, a, r = runs(buffer, ends)
            piece = np.searchsorted(ends, first, side="right")
            shift = np.array([at for _, at, _ in held])[piece] - np.concatenate([[0], ends])[piece]
            out.append((np.array([n for n, _, _ in held])[piece], a, r, first + shift, last + shift, anchor - first))

        for n in range(batch.num_rows):
            data = (batch.column("text")[n].as_py() or "").encode("utf-8", "surrogatepass")
            if len(data) < LENGTH:
                continue
            for at, part in pieces(data):
                if size + len(part) > BUFFER:
                    flush()
                    held, size = [], 0
                held.append((n, at, part))
                size += len(part)
        flush()
        if out:
            owner, a, r, first, last, lead = (np.concatenate(x) for x in zip(*out, strict=True))
            yield pa.RecordBatch.from_arrays(
                [pa.array([ids[n] for n in owner], pa.int64()), pa.array([keys[n] for n in owner], pa.int64()), pa.array(a), pa.array(r),
                 pa.array(first.astype(np.int32)), pa.array(last.astype(np.int32)), pa.array(lead.astype(np.int32))],
                names=["doc_id", "_key", "a", "r", "first", "last", "lead"])


def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts compressed, for the way between tasks."""
    codec = zstandard.ZstdCompressor(level=3)
    for batch in batches:
        data = [codec.compress((t.as_py() or "").encode("utf-8", "surrogatepass")) for t in batch.column("text")]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("_key"), pa.array(data, pa.binary())], names=["doc_id", "_key", "data"])


def cut_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, _key, data, runs) to a row for each run with its bytes."""
    codec = zstandard.ZstdDecompressor()
    for batch in batches:
        for n in range(batch.num_rows):
            text, rows = codec.decompress(batch.column("data")[n].as_py()), batch.column("runs")[n].as_py()
            made = {c: [x[c] for x in rows] for c in ("a", "r", "first", "last", "lead", "solved", "hot")}
            yield pa.RecordBatch.from_arrays(
                [pa.array([batch.column("doc_id")[n].as_py()] * len(rows), pa.int64()), pa.array([batch.column("_key")[n].as_py()] * len(rows), pa.int64()),
                 pa.array(made["a"], pa.int64()), pa.array(made["r"], pa.int64()), pa.array(made["first"], pa.int32()), pa.array(made["lead"], pa.int32()),
                 pa.array(made["solved"], pa.bool_()), pa.array(made["hot"], pa.bool_()),
                 pa.array([text[x["first"] : x["last"] + LENGTH] for x in rows], pa.binary())],
                names=["doc_id", "_key", "a", "r", "first", "lead", "solved", "hot", "body"])


class Group:
    """Different runs around equal anchors, and the order of what follows and what precedes the anchor."""

    def __init__(self, bodies: list[bytes], leads: list[int]):
        self.bodies, self.leads = bodies, leads
        longest = max(map(len, bodies))
        most = 1 << (longest - 1).bit_length()
        inverse = [int(x) for x in powers(pow(BASES[1], -1, 1 << 64), most)]
        self.hashes = [PrefixHashes(np.frombuffer(b, dtype=np.uint8), BASES[1], most).prefix.tolist() for b in bodies]
        self.inverse = inverse

    def same(self, i: int, j: int, length: int, after: bool) -> bool:
        """Whether the hashes of ``length`` bytes after (before) the anchors agree."""
        a = self.leads[i] if after else self.leads[i] - length
        b = self.leads[j] if after else self.leads[j] - length
        x, y = self.hashes[i], self.hashes[j]
        return (x[a + length] - x[a]) * self.inverse[a] & MASK == (y[b + length] - y[b]) * self.inverse[b] & MASK

    def extension(self, i: int, j: int, after: bool) -> int:
        """Common bytes after (before) the anchors: binary search over hashes, verified on the bytes."""
        a, b, x, y = self.leads[i], self.leads[j], self.bodies[i], self.bodies[j]
        low, high = 0, min(len(x) - a, len(y) - b) if after else min(a, b)
        while low < high:
            middle = (low + high + 1) // 2
            if self.same(i, j, middle, after):
                low = middle
            else:
                high = middle - 1
        if (x[a : a + low] == y[b : b + low]) if after else (x[a - low : a] == y[b - low : b]):
            return low
        # Hashes collided: compare byte by byte.
        pairs = zip(x[a:], y[b:], strict=False) if after else zip(x[:a][::-1], y[:b][::-1], strict=False)
        return next((n for n, (p, q) in enumerate(pairs) if p != q), min(len(x) - a, len(y) - b) if after else min(a, b))

    def order(self, after: bool) -> tuple[list[int], np.ndarray]:
        """Runs in the order of their bytes after (before) the anchor, and the extensions of neighbours."""

        def compare(i: int, j: int) -> int:
            n = self.extension(i, j, after)
            x, y = (self.bodies[i][self.leads[i] + n :], self.bodies[j][self.leads[j] + n :]) if after else (
                self.bodies[i][: self.leads[i] - n][::-1], self.bodies[j][: self.leads[j] - n][::-1])
            return (x[:1] > y[:1]) - (x[:1] < y[:1])

        # Python's sort is a merge sort: every comparison is one look for the common extension.
        by = sorted(range(len(self.bodies)), key=functools.cmp_to_key(compare))
        return by, np.array([self.extension(i, j, after) for i, j in zip(by, by[1:], strict=False)])

    def repeated(self) -> np.ndarray:
        """Matrix (distance before the anchor, run): whether that 400-byte string occurs in another run too."""
        n = len(self.bodies)
        leads = np.array(self.leads)
        counts = np.array([len(b) for b in self.bodies]) - LENGTH + 1
        distances = np.arange(max(self.leads) + 1)[:, None]
        classes = []
        for after in (True, False):
            by, common = self.order(after)
            parted = common[None, :] < (LENGTH - distances if after else distances)
            ids = np.concatenate([np.zeros((len(distances), 1), dtype=np.int64), np.cumsum(parted, axis=1)], axis=1)
            placed = np.empty_like(ids)
            placed[:, by] = ids
            classes.append(placed)
        key = classes[0] * n + classes[1]
        own = (distances <= leads[None, :]) & (leads[None, :] - distances < counts[None, :])
        key = np.where(own, key, -1 - np.arange(n)[None, :])
        by = np.argsort(key, axis=1, kind="stable")
        ordered = np.take_along_axis(key, by, axis=1)
        equal = ordered[:, 1:] == ordered[:, :-1]
        hit = np.zeros_like(key, dtype=bool)
        hit[:, 1:] |= equal
        hit[:, :-1] |= equal
        out = np.zeros_like(hit)
        np.put_along_axis(out, by, hit, axis=1)
        return out & own


def stretches(flags: np.ndarray) -> list[tuple[int, int]]:
    """[begin, end) of the true stretches."""
    edges = np.flatnonzero(np.diff(np.concatenate([[0], flags.astype(np.int8), [0]])))
    return list(zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True))


def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of runs with their bytes, equal anchors together, to the repeated stretches (doc_id, _key, start, stop)."""

    def found(rows: list[tuple]) -> list[tuple]:
        # Equal runs of repeated rows come more than once.
        rows = list({r[3]: r for r in rows}.values())
        if len(rows) < 2:
            return []
        hit = Group([r[6] for r in rows], [r[4] for r in rows]).repeated()
        return [
            (r[0], r[1], r[2] + r[4] + 1 - end, r[2] + r[4] - begin + LENGTH)
            for k, r in enumerate(rows) if not r[5] for begin, end in stretches(hit[:, k])
        ]

    def out(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.int64()) for k in range(4)], names=["doc_id", "_key", "start", "stop"])

    anchor, rows, made = None, [], []
    for batch in batches:
        for row in zip(*[batch.column(c).to_pylist() for c in ("a", "doc_id", "_key", "first", "r", "lead", "solved", "body")], strict=True):
            if row[0] != anchor:
                made += found(rows)
                anchor, rows = row[0], []
            rows.append(row[1:])
        if len(made) > 10_000:
            yield out(made)
            made = []
    yield out(made + found(rows))


def strings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of runs with their bytes to a row for each 400-byte string: its two hashes and where it begins."""
    for batch in batches:
        for n in range(batch.num_rows):
            row = {c: batch.column(c)[n].as_py() for c in ("doc_id", "_key", "first", "solved", "body")}
            data = np.frombuffer(row["body"], dtype=np.uint8)
            begin = np.arange(len(data) - LENGTH + 1)
            most = 1 << (len(data) - 1).bit_length()
            h = [mixed(PrefixHashes(data, base, most).of(begin, begin + LENGTH)).view(np.int64) for base in BASES]
            k = len(begin)
            yield pa.RecordBatch.from_arrays(
                [pa.array([row["doc_id"]] * k, pa.int64()), pa.array([row["_key"]] * k, pa.int64()), pa.array(row["first"] + begin), pa.array([row["solved"]] * k, pa.bool_()),
                 pa.array(h[0]), pa.array(h[1])], names=["doc_id", "_key", "start", "solved", "h1", "h2"])


def removed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, _key, data, spans) to what is left: n_bytes, n_removed, n_spans, kept."""
    codec = zstandard.ZstdDecompressor()
    for batch in batches:
        rows = []
        for n in range(batch.num_rows):
            text = codec.decompress(batch.column("data")[n].as_py())
            kept, at, gone, spans = [], 0, 0, 0
            merged: list[list[int]] = []
            for span in sorted((x["start"], x["stop"]) for x in batch.column("spans")[n].as_py() or []):
                if merged and span[0] <= merged[-1][1]:
                    merged[-1][1] = max(merged[-1][1], span[1])
                else:
                    merged.append(list(span))
            for begin, end in merged:
                kept.append(text[at:begin])
                gone, spans, at = gone + end - begin, spans + 1, end
            kept.append(text[at:])
            rows.append((len(text), gone, spans, b"".join(kept)))
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), batch.column("_key"), *[pa.array([r[k] for r in rows], pa.int64()) for k in range(3)], pa.array([r[3] for r in rows], pa.binary())],
            names=["doc_id", "_key", "n_bytes", "n_removed", "n_spans", "kept"])


def keyed(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("_key"), "text")


def repeats(docs: DataFrame) -> DataFrame:
    """(doc_id, _key, start, stop): stretches of bytes that are covered by repeated strings; they may overlap."""
    texts = keyed(docs)
    found = stash(texts.mapInArrow(anchored, "doc_id long, _key long, a long, r long, first int, last int, lead int"), "runs")
    # Written out, so that both sides of the join are plain shuffles and a hot anchor's rows can be split.
    heads = stash(found.groupBy("a").agg(F.count("*").alias("_n"), F.min("r").alias("_low"), F.max("r").alias("_high")).filter("_n > 1").select("a", (F.col("_low") < F.col("_high")).alias("_several")), "anchors")
    again = stash(found.join(heads.hint("merge"), "a"), "repeated-anchors")
    alike = stash(again.groupBy("a", "r").agg(F.count("*").alias("_copies"), F.min(F.struct("doc_id", "_key", "first")).alias("_one")), "alike")
    told = stash(again.join(alike.hint("merge"), ["a", "r"]), "told")
    whole = told.filter("_copies > 1").select("doc_id", "_key", F.col("first").cast("long").alias("start"), (F.col("last") + LENGTH).cast("long").alias("stop"))
    # One of each run around anchors that have several.
    one = (F.col("doc_id").eqNullSafe(F.col("_one.doc_id"))) & (F.col("_key") == F.col("_one._key")) & (F.col("first") == F.col("_one.first"))
    open_runs = told.filter(F.col("_several") & ((F.col("_copies") == 1) | one))
    crowd = stash(open_runs.groupBy("a").agg(F.count("*").alias("_n")).select("a", (F.col("_n") > GROUP).alias("hot")), "crowds")
    facts = F.struct("a", "r", "first", "last", "lead", (F.col("_copies") > 1).alias("solved"), "hot")
    wanted = open_runs.join(crowd.hint("merge"), "a").groupBy("doc_id", "_key").agg(F.collect_list(facts).alias("runs"))
    bodies = stash(with_data(wanted, docs, "inner").select("doc_id", "_key", "data", "runs").mapInArrow(
        cut_out, "doc_id long, _key long, a long, r long, first int, lead int, solved boolean, hot boolean, body binary"), "bodies")
    few = bodies.filter("not hot").repartition("a").sortWithinPartitions("a").mapInArrow(compared, "doc_id long, _key long, start long, stop long")
    every = bodies.filter("hot").dropDuplicates(["a", "r"]).mapInArrow(strings, "doc_id long, _key long, start long, solved boolean, h1 long, h2 long")
    twice = every.groupBy("h1", "h2").agg(F.count("*").alias("_n")).filter("_n > 1").select("h1", "h2")
    many = every.filter("not solved").join(twice.hint("merge"), ["h1", "h2"]).select("doc_id", "_key", "start", (F.col("start") + LENGTH).alias("stop"))
    return whole.unionByName(few).unionByName(many)


def with_data(facts: DataFrame, docs: DataFrame, how: str) -> DataFrame:
    """Compressed texts joined with facts by document."""
    data = keyed(docs).mapInArrow(packed, "doc_id long, _key long, data binary").alias("d")
    facts = facts.alias("f").hint("merge")
    same = (F.col("d._key") == F.col("f._key")) & F.col("d.doc_id").eqNullSafe(F.col("f.doc_id"))
    rest = [F.col(f"f.{c}") for c in facts.columns if c not in ("doc_id", "_key")]
    return data.join(facts, same, how).select("d.doc_id", "d._key", "d.data", *rest)


def remaining(docs: DataFrame) -> DataFrame:
    """(doc_id, _key, n_bytes, n_removed, n_spans, kept) of every row; kept: the bytes that are left."""
    spans = repeats(docs).groupBy("doc_id", "_key").agg(F.collect_set(F.struct("start", "stop")).alias("spans"))
    return with_data(spans, docs, "left").select("doc_id", "_key", "data", "spans").mapInArrow(
        removed, "doc_id long, _key long, n_bytes long, n_removed long, n_spans long, kept binary")


def removals(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) of every row."""
    return remaining(docs).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def without_repeats(docs: DataFrame) -> DataFrame:
    """``docs`` with what is left of its texts; bytes that no longer form a character become U+FFFD."""
    left = remaining(docs).select(F.col("doc_id").alias("_id"), "_key", F.decode("kept", "UTF-8").alias("_kept")).dropDuplicates(["_id", "_key"])
    rows = docs.select(F.struct("*").alias("_row"), F.col("doc_id").cast("long").alias("_doc"), F.xxhash64("text").alias("_hash"))
    joined = rows.join(left.hint("merge"), (F.col("_hash") == F.col("_key")) & F.col("_doc").eqNullSafe(F.col("_id")), "left")
    return joined.select(*[F.col("_kept").alias("text") if c == "text" else F.col(f"_row.`{c}`").alias(c) for c in docs.columns])


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = removals(table(spark, sf_dir, "documents"))
    return found.withColumn("n_kept", F.col("n_bytes") - F.col("n_removed"))
