"""MinHash near-dedup: SuperMinHash signatures, banding, verification on full sets, union-find grouping.

1. One pass over the texts gives each document the number of its shingles, a digest of its set and the band keys of
   its SuperMinHash signature. Documents of equal sets are one node from here on, so exact copies cost one row each.
2. Nodes that share a band key are candidates. A bucket's head is its smallest node; a node and all heads of its buckets
   are linked with the least of them (sums and a join, no pairs; about one link a node). Connected components of these links are
   clusters. Two linked documents share a band with a probability above 0.999999 at any similarity asked for (see ``rows_of_band``),
   and no bucket is capped.
3. Inside a cluster all sets are compared in full. Clusters of more than ``BLOCK`` nodes are dealt over blocks that share
   some ``HUBS`` nodes; what ends up outside the cluster's largest component is then compared with every node of the
   cluster, block by block. So every pair is compared or already connected, and a task sees two blocks at most. Tasks
   give back the links of a spanning forest (union-find), never pairs.
4. Connected components of those links are the groups.

SuperMinHash: an element visits the places of the signature in an order of its own (a random permutation) and offers
rank + uniform number at each; a place keeps the least. Ranks of different places are correlated, which lowers the
variance, and visiting stops at the rank at which no place can fall any more.

Defined results: null and empty texts have an empty set, are linked with nothing and are kept. A null doc_id takes part;
a group's id is its smallest doc_id that is not null. Repeated rows are equal sets; ``survivors`` keeps one row of a
group. Extra columns are left out by ``groups`` and passed through by ``survivors``.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vigilake.llm.common import salted_join, stash, table
from vigilake.llm.graphs import Union, components

#: Fixed values of the task.
SHINGLE = 5
#: Similarity from which sets are near copies: op10's own, and the general one (the pipeline's).
PERCENT, GENERAL_PERCENT = 85, 80
BANDS, ROWS_OF_BAND = 32, 6
PLACES = BANDS * ROWS_OF_BAND
#: Chance to miss a pair of just the similarity asked for.
MOST_MISSED = 1e-6
BLOCK, HUBS = 512, 64
#: Different words a worker remembers; documents taken together; columns of a comparison at a time.
CACHED, ROWS, COLUMNS = 200_000, 256, 8192
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
#: White space of str.split beyond [\x20\x09-\x0D].
ODD_SPACE = re.compile("[\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")
SPACES = re.compile(r"[\x20\x09-\x0D]+")
MIX = [np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)]


def miss_probability(similarity: float = PERCENT / 100, rows: int = ROWS_OF_BAND) -> float:
    """Chance that two sets share no band."""
    return (1 - similarity**rows) ** (PLACES // rows)


def rows_of_band(percent: int = PERCENT) -> int:
    """Places of a band: as many as leave a pair of just this similarity a chance of ``MOST_MISSED`` at most to share none."""
    fit = [r for r in range(1, ROWS_OF_BAND + 1) if miss_probability(percent / 100, r) <= MOST_MISSED]
    if not fit:
        raise ValueError(f"similarity of {percent} percent is too low for {PLACES} places")
    return max(fit)


def mixed(x: np.ndarray) -> np.ndarray:
    """Bits of 64-bit numbers well mixed."""
    x = (x ^ (x >> np.uint64(30))) * MIX[1]
    x = (x ^ (x >> np.uint64(27))) * MIX[2]
    return x ^ (x >> np.uint64(31))


class WordHashes(dict):
    def __missing__(self, word: str) -> int:
        if len(self) >= CACHED:
            self.clear()
        value = self[word] = xxhash.xxh64_intdigest(word.encode("utf-8", "surrogatepass"))
        return value


HASHES = WordHashes()


def words(text: str | None) -> list[str]:
    """Words of the lower-cased (A-Z) text."""
    if not text:
        return []
    text = text.translate(LOWER)
    return [w for w in SPACES.split(text) if w] if ODD_SPACE.search(text) else text.split()


def shingle_set(text: str | None) -> np.ndarray:
    """Sorted different 64-bit hashes of the text's shingles."""
    w = words(text)
    h = np.fromiter(map(HASHES.__getitem__, w), dtype=np.uint64, count=len(w))
    n = min(len(w), SHINGLE)
    if not n:
        return h
    out = np.full(len(h) - n + 1, n, dtype=np.uint64)
    for k in range(n):
        out = (out * MIX[0]) ^ mixed(h[k : len(h) - n + 1 + k])
        out = mixed(out)
    return np.unique(out)


def superminhash(elements: np.ndarray, places: int = PLACES) -> np.ndarray:
    """Signature of a set of 64-bit hashes: per place the least of rank + uniform number."""
    least = np.full(places, np.inf)
    order = np.tile(np.arange(places, dtype=np.int16), (len(elements), 1))
    rows = np.arange(len(elements))
    for rank in range(places):
        if least.max() <= rank:
            break
        bits = mixed(elements + np.uint64((2 * rank + 1) * int(MIX[0]) & (1 << 64) - 1))
        uniform = (bits >> np.uint64(11)).astype(np.float64) * 2.0**-53
        pick = rank + (mixed(bits) % np.uint64(places - rank)).astype(np.int64)
        place = order[rows, pick]
        order[rows, pick] = order[:, rank]
        np.minimum.at(least, place, rank + uniform)
    return least


def band_keys(signature: np.ndarray, rows: int = ROWS_OF_BAND) -> np.ndarray:
    bands = len(signature) // rows
    parts = signature[: bands * rows].view(np.uint64).reshape(bands, rows)
    key = mixed(np.arange(1, bands + 1, dtype=np.uint64) * MIX[0])
    for k in range(rows):
        key = mixed(key * MIX[0] ^ parts[:, k])
    return key.view(np.int64)


def described(batches: Iterator[pa.RecordBatch], rows: int = ROWS_OF_BAND) -> Iterator[pa.RecordBatch]:
    """(…, text) to (…, n_shingles, digest, bands)."""
    for whole in batches:
        for a in range(0, whole.num_rows, ROWS):
            batch = whole.slice(a, ROWS)
            sizes, digests, bands = [], [], []
            for text in batch.column("text").to_pylist():
                s = shingle_set(text)
                sizes.append(len(s))
                digests.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None)
                bands.append(band_keys(superminhash(s), rows) if len(s) else [])
            kept = [c for c in batch.schema.names if c != "text"]
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(c) for c in kept], pa.array(sizes, pa.int64()), pa.array(digests, pa.binary()), pa.array(bands, pa.list_(pa.int64()))],
                names=[*kept, "n_shingles", "digest", "bands"])


def linked(sizes_a: np.ndarray, sizes_b: np.ndarray, both: np.ndarray, percent: int = PERCENT) -> np.ndarray:
    """Whether 100 * intersection >= percent * union."""
    return (100 + percent) * both >= percent * (sizes_a + sizes_b)


def common(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Matrix of intersection sizes between sets[left] and sets[right], some thousand shingles at a time."""
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    _, code, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    # A shingle of a single set is in no intersection.
    several = count[code] > 1
    code, owner = code[several], owner[several]
    code = np.unique(code, return_inverse=True)[1]
    by = np.argsort(code, kind="stable")
    code, owner = code[by], owner[by]
    out = np.zeros((len(left), len(right)), dtype=np.float32)
    for begin in range(0, int(code[-1]) + 1 if len(code) else 0, COLUMNS):
        a, b = np.searchsorted(code, [begin, begin + COLUMNS])
        x = np.zeros((len(sets), COLUMNS), dtype=np.float32)
        x[owner[a:b], code[a:b] - begin] = 1
        out += x[left] @ x[right].T
    return out


def forest(nodes: list[int], sets: list[np.ndarray], sides: list[int], percent: int = PERCENT) -> list[tuple[int, int]]:
    """Links of a spanning forest among the sets; where ``sides`` has both 1 and 0, rows of side 1 are compared with all."""
    union, out = Union(len(nodes)), []
    sizes = np.array([len(s) for s in sets], dtype=np.float64)
    chosen = np.flatnonzero(np.array(sides)) if any(sides) else np.arange(len(nodes))
    if len(nodes) <= 12:
        rows = [(i, np.array([len(np.intersect1d(sets[i], s, assume_unique=True)) for s in sets])) for i in chosen]
    else:
        rows = [
            (i, shared) for a in range(0, len(chosen), BLOCK)
            for i, shared in zip(chosen[a : a + BLOCK], common(sets, chosen[a : a + BLOCK], np.arange(len(nodes))), strict=True)
        ]
    for i, shared in rows:
        for j in np.flatnonzero(linked(sizes[i], sizes, shared, percent)):
            if j != i and union.join(int(i), int(j)):
                out.append((nodes[i], nodes[j]))
    return out


def compared(batches: Iterator[pa.RecordBatch], percent: int = PERCENT) -> Iterator[pa.RecordBatch]:
    """Rows (job, node, side, text), equal jobs together, to the links (a, b) that hold."""

    def links(rows: dict[int, tuple[int, str]]) -> list[tuple[int, int]]:
        nodes = list(rows)
        return forest(nodes, [shingle_set(rows[n][1]) for n in nodes], [rows[n][0] for n in nodes], percent) if len(nodes) > 1 else []

    def out(found: list[tuple[int, int]]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([a for a, _ in found], pa.int64()), pa.array([b for _, b in found], pa.int64())], names=["a", "b"])

    job, rows, found = None, {}, []
    for batch in batches:
        for j, node, side, text in zip(*[batch.column(c).to_pylist() for c in ("job", "node", "side", "text")], strict=True):
            if j != job:
                found += links(rows)
                job, rows = j, {}
            rows[node] = (max(side, rows.get(node, (0,))[0]), text)
        if len(found) > 10_000:
            yield out(found)
            found = []
    yield out(found + links(rows))


def compare(jobs: DataFrame, texts: DataFrame, label: str, percent: int = PERCENT) -> DataFrame:
    """Links of all jobs (job, node, side) over the texts (node, text)."""
    rows = jobs.join(texts, "node")
    return stash(rows.repartition("job").sortWithinPartitions("job").select("job", "node", "side", "text").mapInArrow(partial(compared, percent=percent), "a long, b long"), label)


def describe(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """One row per document: _row, doc_id, _text (hash of the text), n_shingles, digest, bands; kept in the shared folder."""
    rows = docs.select(F.monotonically_increasing_id().alias("_row"), F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("_text"), "text")
    return stash(rows.mapInArrow(partial(described, rows=rows_of_band(percent)), "_row long, doc_id long, _text long, n_shingles long, digest binary, bands array<bigint>"), "described")


def node_components(docs: DataFrame, facts: DataFrame, percent: int = PERCENT) -> tuple[DataFrame, DataFrame]:
    """(digest, node, ...) of every different set, and (node, component) of the nodes that have links."""
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "_row", "_text", "bands"))
    nodes = stash(
        facts.filter("digest is not null").groupBy("digest").agg(first.alias("_f"))
        .select("digest", F.col("_f._row").alias("node"), F.col("_f.doc_id").alias("doc_id"), F.col("_f._text").alias("_text"), F.col("_f.bands").alias("bands")), "nodes")
    placed = nodes.select("node", F.explode("bands").alias("key"))
    heads = placed.groupBy("key").agg(F.min("node").alias("head"), F.count("*").alias("_n")).filter("_n > 1").select("key", "head")
    # Of a node's bucket heads (one per band at most) the least stands for all: the node and the other heads are linked with it.
    of_node = placed.join(heads.hint("merge"), "key").groupBy("node").agg(F.min("head").alias("b"), F.collect_set("head").alias("_heads"))
    candidates = of_node.select(F.explode(F.array_union(F.array("node"), "_heads")).alias("a"), "b").filter("a <> b").distinct()
    clusters = components(candidates, "clusters").withColumnRenamed("component", "cluster")
    sizes = clusters.groupBy("cluster").agg(F.count("*").alias("_size"))
    members = stash(salted_join(clusters, sizes, "cluster", F.col("node")), "members")
    # Texts of the clusters' nodes: the only ones that are shuffled on.
    where = members.join(nodes.select("node", "doc_id", "_text"), "node").select("node", "doc_id", "_text")
    original = docs.select(F.col("doc_id").cast("long").alias("_id"), F.xxhash64("text").alias("_hash"), "text")
    texts = stash(
        where.join(original, (F.col("_text") == F.col("_hash")) & F.col("doc_id").eqNullSafe(F.col("_id"))).select("node", "text").dropDuplicates(["node"]), "texts")
    # Blocks of a cluster; its hubs go to all of them.
    blocks = F.ceil(F.col("_size") / BLOCK).cast("int")
    hub = (F.col("_size") > BLOCK) & (F.pmod(F.xxhash64("node", F.lit(1)), F.ceil(F.col("_size") / HUBS)) == 0)
    own = F.array(F.pmod(F.xxhash64("node"), blocks).cast("int"))
    dealt = members.withColumn("_block", F.explode(F.when(hub, F.sequence(F.lit(0), blocks - 1)).otherwise(own)))
    links = compare(dealt.select(F.xxhash64("cluster", "_block").alias("job"), "node", F.lit(0).alias("side")), texts, "links", percent)
    large = members.filter(F.col("_size") > BLOCK)
    if large.limit(1).count():
        links = links.unionByName(rest_of_large(large, links, texts, percent))
    return nodes, components(links, "groups")


def rest_of_large(large: DataFrame, links: DataFrame, texts: DataFrame, percent: int = PERCENT) -> DataFrame:
    """Links between nodes outside a large cluster's largest component and all of its nodes."""
    grouped = large.join(components(links, "first-groups"), "node", "left").withColumn("component", F.coalesce("component", "node"))
    counts = grouped.groupBy("cluster", "component").agg(F.count("*").alias("_n"))
    main = counts.groupBy("cluster").agg(F.max(F.struct("_n", "component")).alias("_m")).select("cluster", F.col("_m.component").alias("_main"))
    outside = stash(
        salted_join(grouped, main, "cluster", F.col("node")).withColumn("_out", F.col("component") != F.col("_main")).select("cluster", "node", "_size", "_out"), "outside")
    n_out = outside.filter("_out").groupBy("cluster").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("_rows"))
    cells = salted_join(outside, n_out, "cluster", F.col("node")).filter("_rows is not null").withColumn("_columns", F.ceil(F.col("_size") / BLOCK).cast("int"))
    # Job (row, column): outside nodes of the row against all nodes of the column.
    column = F.pmod(F.xxhash64("node"), F.col("_columns")).cast("int")
    row = F.pmod(F.xxhash64("node", F.lit(2)), F.col("_rows")).cast("int")
    as_row = cells.filter("_out").select("cluster", "node", row.alias("_r"), F.explode(F.sequence(F.lit(0), F.col("_columns") - 1)).alias("_c"), F.lit(1).alias("side"))
    as_column = cells.select("cluster", "node", F.explode(F.sequence(F.lit(0), F.col("_rows") - 1)).alias("_r"), column.alias("_c"), F.lit(0).alias("side"))
    jobs = as_row.unionByName(as_column)
    return compare(jobs.select(F.xxhash64("cluster", "_r", "_c").alias("job"), "node", "side"), texts, "more-links", percent)


def grouped(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """Per row of ``docs``: _row, doc_id, _text, n_shingles, component_id, _first (the row that stays)."""
    facts = describe(docs, percent)
    nodes, found = node_components(docs, facts, percent)
    joined = nodes.select("digest", "node", "doc_id").join(found.hint("merge"), "node", "left").withColumn("component", F.coalesce("component", "node"))
    least = joined.groupBy("component").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "node")).alias("_l"))
    labelled = stash(
        salted_join(joined, least, "component", F.col("node")).select("digest", F.col("_l.doc_id").alias("_component"), F.col("_l.node").alias("_stays")), "labelled")
    # A set that many documents share is one row here and a hot key there: salted.
    salts = 16
    rows = facts.drop("bands").withColumn("_salt", F.when(F.col("digest").isNotNull(), F.pmod("_row", F.lit(salts)).cast("int")))
    every = labelled.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1)))).hint("merge")
    with_set = rows.filter("digest is not null").join(every, ["digest", "_salt"]).select(
        "_row", "doc_id", "_text", "n_shingles", F.col("_component").alias("component_id"), (F.col("_row") == F.col("_stays")).alias("_first"))
    alone = rows.filter("digest is null").select("_row", "doc_id", "_text", "n_shingles", F.col("doc_id").alias("component_id"), F.lit(True).alias("_first"))
    return with_set.unionByName(alone)


def groups(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) per row of ``docs``; kept: doc_id is the component's."""
    return grouped(docs, percent).select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)).alias("kept"))


def survivors(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """One row of each group, and all rows without shingles, in the columns of ``docs``."""
    stay = grouped(docs, percent).filter("_first").select(F.col("doc_id").alias("_id"), F.col("_text").alias("_hash"), (F.col("n_shingles") > 0).alias("_once")).distinct()
    rows = docs.select(F.struct("*").alias("_r"), F.col("doc_id").cast("long").alias("_doc"), F.xxhash64("text").alias("_t"))
    kept = rows.join(stay.hint("merge"), (F.col("_t") == F.col("_hash")) & F.col("_doc").eqNullSafe(F.col("_id")), "inner")
    once = kept.filter("_once").dropDuplicates(["_doc", "_t"])
    return kept.filter("not _once").unionByName(once).select("_r.*")


def op10_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return groups(table(spark, sf_dir, "documents"))
