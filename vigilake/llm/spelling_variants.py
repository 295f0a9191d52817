"""Spelling variant grouping: PartEnum signatures of letter multisets, equi-joined and verified.

1. One pass over the texts counts runs of letters (map-side in each task, then one sum per word).
2. A word's letter multiset is a binary vector: one dimension per (letter, how many times at least). One letter more or
   less changes one dimension, another letter changes two, so near words lie at a Hamming distance of at most two.
   The letters are dealt over ``PARTS`` parts; for every choice of ``PARTS`` - 2 parts a word has a signature: the
   multisets of these parts. Two words at distance two or less agree in all parts but two, so they share a signature.
3. Anagrams share all signatures. As near words also agree in their first or in their last half, a signature is joined
   with either half (a word stands once with words of its own length and once with those one letter shorter). Rows of
   equal keys meet in one task, which compares the words themselves and gives back near words only, each pair under the
   first of the signatures it shares.
4. A key with more than ``GROUP`` words is not compared: its rows are handed on and meet again by the exact text that is
   left when one letter goes. Under such a text there are only words that differ in that one letter, so the work stays in
   proportion to the rows however many words share a signature.
5. Counts and the most frequent near word are sums per word. A form is ten times as frequent as its word, so chains of
   forms have at most as many links as the largest count has digits; pointer jumping halves them each round.

Defined results: null and empty texts hold no word. A null doc_id is written as nothing in ``<doc_id>:<run>``. Repeated
rows count each. Ties of the most frequent near word go to the smallest in code-point order. Extra columns are not read.
"""

from __future__ import annotations

import itertools
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vigilake.llm.common import salted_join, stash, table

#: Fixed values of the task.
LEAST_LETTERS, LEAST_COUNT, FORM_FACTOR, DROP_ONE_IN = 7, 2, 10, 31
RUN = re.compile(r"[A-Za-zÀ-ÿ]{%d,}" % LEAST_LETTERS)
LETTER = re.compile(r"[A-Za-zÀ-ÿ]")
PARTS, DISTANCE = 4, 2
#: Words of one key compared with each other in a task; different words a task counts before it hands them on.
GROUP, COUNTED = 2048, 400_000
#: Characters of a text looked at together; pairs compared together; words of at most so many letters compared as a matrix.
PIECE_CHARS, PAIRS, WIDTH = 1 << 20, 1 << 19, 48
DROPPED = list(itertools.combinations(range(PARTS), DISTANCE))
MIX = [np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)]
#: Part of every letter (one byte each, as the letters end at U+00FF): a rule that spreads neighbours in the alphabet.
PART_OF = np.arange(256) * 7919 % PARTS


def mixed(x: np.ndarray) -> np.ndarray:
    """Bits of 64-bit numbers well mixed."""
    x = (x ^ (x >> np.uint64(30))) * MIX[1]
    x = (x ^ (x >> np.uint64(27))) * MIX[2]
    return x ^ (x >> np.uint64(31))


LETTER_HASH = mixed(np.arange(1, 257, dtype=np.uint64) * MIX[0])


def pieces(text: str) -> Iterator[str]:
    """The text, a bounded number of characters at a time, never cut inside a run."""
    at = 0
    while at < len(text):
        end = at + PIECE_CHARS
        while end < len(text) and LETTER.match(text[end]):
            end += 1
        yield text[at:end]
        at = end


def runs_of(doc_id: int | None, text: str | None) -> Counter:
    """Words of one text and how often they stand there."""
    out: Counter = Counter()
    begin = zlib.crc32(f"{'' if doc_id is None else doc_id}:".encode())
    for piece in pieces(text or ""):
        # Bytes are lower-cased from A to Z only.
        low = piece.encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass")
        for run, n in Counter(RUN.findall(low)).items():
            h = zlib.crc32(run.encode(), begin)
            if h % DROP_ONE_IN == 0:
                k = h % len(run)
                run = run[:k] + run[k + 1 :]
            if len(run) >= LEAST_LETTERS:
                out[run] += n
    return out


def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, text) to (word, n), summed inside the task as far as ``COUNTED`` words reach."""

    def out(sums: Counter) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(sums), pa.string()), pa.array(list(sums.values()), pa.int64())], names=["word", "n"])

    sums: Counter = Counter()
    for batch in batches:
        for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
            for word, n in runs_of(doc_id, text).items():
                sums[word] += n
            if len(sums) >= COUNTED:
                yield out(sums)
                sums = Counter()
    yield out(sums)


def word_counts(docs: DataFrame) -> DataFrame:
    """(word, n) of all words with at least ``LEAST_COUNT`` occurrences."""
    partial = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(counted, "word string, n long")
    return partial.groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= LEAST_COUNT)


def letters(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Letters of the words end to end, one byte each, and where each word begins (and the last one ends)."""
    flat = np.frombuffer("".join(words).encode("latin-1"), dtype=np.uint8)
    return flat, np.concatenate([[0], np.cumsum(np.fromiter(map(len, words), dtype=np.int64, count=len(words)))])


def keys_of(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per word and signature: place of the word, key, and tag = signature * 4 + side * 2 + (1: one letter longer than its class)."""
    flat, at = letters(words)
    length = np.diff(at)
    owner = np.repeat(np.arange(len(words)), length)
    place = np.arange(len(flat)) - at[owner]
    # Multisets of the parts: sums of letter hashes do not depend on the order of the letters.
    sums = np.zeros((len(words), PARTS), dtype=np.uint64)
    np.add.at(sums, (owner, PART_OF[flat]), LETTER_HASH[flat])
    sums = mixed(sums + np.arange(1, PARTS + 1, dtype=np.uint64) * MIX[0])
    # Halves: sums of hashes of (letter, place from the side's end), up to the half.
    halves = []
    for side, far in ((0, place), (1, length[owner] - 1 - place)):
        term = np.zeros(len(flat) + 1, dtype=np.uint64)
        np.cumsum(mixed(LETTER_HASH[flat] + far.astype(np.uint64) * MIX[1]), out=term[1:])
        for longer in (0, 1):
            size = length - longer
            half = size // 2 if side == 0 else size - size // 2
            a, b = (at[:-1], at[:-1] + half) if side == 0 else (at[1:] - half, at[1:])
            halves.append((side * 2 + longer, mixed((term[b] - term[a]) * MIX[0] + (size * 2 + side).astype(np.uint64))))
    who, keys, tags = [], [], []
    for signature, dropped in enumerate(DROPPED):
        kept = sum((sums[:, p] for p in range(PARTS) if p not in dropped), np.full(len(words), signature, dtype=np.uint64))
        for tag, half in halves:
            keys.append(mixed(mixed(kept) * MIX[0] ^ half))
            tags.append(np.full(len(words), signature * 4 + tag))
            who.append(np.arange(len(words)))
    return np.concatenate(who), np.concatenate(keys).view(np.int64), np.concatenate(tags)


def signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(word, n) to (key, tag, word, n)."""
    for batch in batches:
        if batch.num_rows:
            who, keys, tags = keys_of(batch.column("word").to_pylist())
            yield pa.RecordBatch.from_arrays(
                [pa.array(keys), pa.array(tags.astype(np.int32)), batch.column("word").take(pa.array(who)), batch.column("n").take(pa.array(who))],
                names=["key", "tag", "word", "n"])


def one_edit(a: str, b: str) -> tuple[int, str] | None:
    """(length of the common beginning, the letters that differ) if one letter is changed, put in or left out; else None."""
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1 or a == b:
        return None
    k = next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), len(a))
    if len(a) == len(b):
        return (k, a[k] + b[k]) if a[k + 1 :] == b[k + 1 :] else None
    return (k, b[k]) if a[k:] == b[k + 1 :] else None


def first_tag(size: int, k: int, differing: str) -> int:
    """Signature and side (signature * 2 + side) under which a near pair is given back: the first it shares."""
    parts = {int(PART_OF[ord(c)]) for c in differing}
    signature = next(i for i, d in enumerate(DROPPED) if parts <= set(d))
    return signature * 2 + (0 if k >= size // 2 else 1)


FIRST_SIGNATURE = np.array([[next(i for i, d in enumerate(DROPPED) if {p, q} <= set(d)) for q in range(PARTS)] for p in range(PARTS)])


def near_in_groups(words: list[str], tags: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places (a, b) of near words in groups of rows; ``starts`` has where each group begins, and the end of the last."""
    length = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    sizes = np.diff(starts)
    # Every row meets the rows after it in its group, some rows at a time.
    first = np.arange(len(words))
    ends = np.repeat(starts[1:], sizes)
    many = ends - first - 1
    upto = np.concatenate([[0], np.cumsum(many)])
    found_a, found_b = [], []
    wide = length <= WIDTH
    matrix = np.zeros((len(words), WIDTH + 1), dtype=np.uint8)
    if wide.any():
        small = np.flatnonzero(wide)
        flat, at = letters([words[i] for i in small])
        owner = np.repeat(np.arange(len(small)), np.diff(at))
        matrix[small[owner], np.arange(len(flat)) - at[owner]] = flat
    row = 0
    while row < len(words):
        stop = max(row + 1, int(np.searchsorted(upto, upto[row] + PAIRS, side="right")) - 1)
        a = np.repeat(first[row:stop], many[row:stop])
        b = a + 1 + np.arange(len(a)) - np.repeat(upto[row:stop] - upto[row], many[row:stop])
        row = stop
        # Two words that are both one letter longer than the class meet in their own class.
        own = (tags[a] & 1) + (tags[b] & 1) < 2
        a, b = a[own], b[own]
        swap = length[a] > length[b]
        a, b = np.where(swap, b, a), np.where(swap, a, b)
        plain = wide[a] & wide[b]
        for i, j in zip(a[~plain], b[~plain], strict=True):
            edit = one_edit(words[i], words[j])
            if edit and first_tag(int(length[i]), *edit) == tags[i] >> 1:
                found_a.append([i])
                found_b.append([j])
        a, b = a[plain], b[plain]
        x, y = matrix[a], matrix[b]
        differ = x != y
        k = differ.argmax(axis=1)
        same_length = length[a] == length[b]
        near = same_length & (differ.sum(axis=1) == 1)
        longer = np.flatnonzero(~same_length)
        if len(longer):
            # What follows the first difference is the longer word's text moved by one.
            moved = x[longer, :WIDTH] == y[longer, 1:]
            near[longer] = (moved | (np.arange(WIDTH) < k[longer, None])).all(axis=1)
        hit = np.flatnonzero(near)
        put, left = PART_OF[y[hit, k[hit]]], PART_OF[x[hit, k[hit]]]
        tag = FIRST_SIGNATURE[put, np.where(same_length[hit], left, put)] * 2 + (k[hit] < length[a[hit]] // 2)
        hit = hit[tag == tags[a[hit]] >> 1]
        found_a.append(a[hit])
        found_b.append(b[hit])
    return (np.concatenate(found_a).astype(np.int64), np.concatenate(found_b).astype(np.int64)) if found_a else (np.zeros(0, np.int64),) * 2


PAIR_SCHEMA = "word string, n long, near string, near_n long, tag int"


def both_ways(words: pa.Array, n: pa.Array, a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
    i, j = pa.array(np.concatenate([a, b])), pa.array(np.concatenate([b, a]))
    return pa.RecordBatch.from_arrays(
        [words.take(i), n.take(i), words.take(j), n.take(j), pa.nulls(len(i), pa.int32())], names=["word", "n", "near", "near_n", "tag"])


def compared(batches: Iterator[pa.RecordBatch], group: int = GROUP) -> Iterator[pa.RecordBatch]:
    """Rows (key, tag, word, n), equal keys together, to near words both ways; rows of keys above ``group`` words as they are, with their tag."""

    def handed_on(rows: pa.RecordBatch) -> pa.RecordBatch:
        m = rows.num_rows
        return pa.RecordBatch.from_arrays(
            [rows.column("word"), rows.column("n"), pa.nulls(m, pa.string()), pa.nulls(m, pa.int64()), rows.column("tag")],
            names=["word", "n", "near", "near_n", "tag"])

    def judged(rows: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        keys = rows.column("key").to_numpy()
        edges = np.concatenate([[0], np.flatnonzero(np.diff(keys)) + 1, [len(keys)]])
        sizes = np.diff(edges)
        large = sizes > group
        for k in np.flatnonzero(large):
            yield handed_on(rows.slice(edges[k], sizes[k]))
        several = (sizes > 1) & ~large
        pick = np.flatnonzero(np.repeat(several, sizes))
        if len(pick):
            some = rows.take(pa.array(pick))
            starts = np.concatenate([[0], np.cumsum(sizes[several])])
            a, b = near_in_groups(some.column("word").to_pylist(), some.column("tag").to_numpy(), starts)
            yield both_ways(some.column("word"), some.column("n"), a, b)

    kept, passing = None, None
    for batch in batches:
        if not batch.num_rows:
            continue
        if passing is not None:
            # The key in hand is a large one already: its rows go by.
            more = int(np.argmax(np.append(batch.column("key").to_numpy() != passing, True)))
            if more:
                yield handed_on(batch.slice(0, more))
            batch = batch.slice(more)
            if not batch.num_rows:
                continue
            passing = None
        rows = batch if kept is None else pa.Table.from_batches([kept, batch]).combine_chunks().to_batches()[0]
        keys = rows.column("key").to_numpy()
        last = int(np.searchsorted(keys, keys[-1]))
        if last:
            yield from judged(rows.slice(0, last))
        kept = rows.slice(last)
        if kept.num_rows > group:
            yield handed_on(kept)
            kept, passing = None, keys[-1]
    if kept is not None and kept.num_rows:
        yield from judged(kept)


def of_large_groups(rows: DataFrame) -> DataFrame:
    """Near words among (word, n) of keys that many words share, by the text that is left when one letter goes."""
    words = rows.select("word", "n").distinct()
    size = F.length("word")
    cut = F.transform(F.sequence(F.lit(1), size), lambda i: F.struct(
        i.alias("at"), F.concat(F.substring(F.col("word"), F.lit(1), i - 1), F.substring(F.col("word"), i + 1, size)).alias("rest")))
    each = words.withColumn("_c", F.explode(cut)).select("word", "n", F.col("_c.at").alias("at"), F.col("_c.rest").alias("rest"))
    # Equal lengths: the letter at one place differs. One longer: what is left of it is the other word.
    changed = each.alias("x").join(each.alias("y").hint("merge"), ["at", "rest"]).filter("x.word <> y.word").select("x.word", "x.n", F.col("y.word").alias("near"), F.col("y.n").alias("near_n"))
    shorter = each.select("word", "n", "rest").distinct().join(words.select(F.col("word").alias("rest"), F.col("n").alias("near_n")).hint("merge"), "rest")
    dropped = shorter.select("word", "n", F.col("rest").alias("near"), "near_n")
    return changed.unionByName(dropped).unionByName(dropped.select(F.col("near").alias("word"), F.col("near_n").alias("n"), F.col("word").alias("near"), F.col("n").alias("near_n")))


def near_words(words: DataFrame) -> DataFrame:
    """(word, n, near, near_n): every two near words of (word, n), both ways."""
    keyed = words.mapInArrow(signed, "key long, tag int, word string, n long")
    out = stash(keyed.repartition("key").sortWithinPartitions("key").mapInArrow(partial(compared, group=GROUP), PAIR_SCHEMA), "near-words")
    large = out.filter("near is null")
    found = out.filter("near is not null").drop("tag")
    if large.limit(1).count():
        # A pair may stand under a small key too.
        found = found.unionByName(of_large_groups(large)).distinct()
    return found


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) of (word, form): the end of each chain of forms."""
    ends = forms.select("word", F.col("form").alias("root"))
    while True:
        further = stash(
            salted_join(ends, ends.select(F.col("word").alias("root"), F.col("root").alias("_further")), "root", F.col("word"))
            .select("word", F.coalesce("_further", "root").alias("root"), F.col("_further").isNotNull().alias("_moved")), "roots")
        ends = further.select("word", "root")
        if not further.filter("_moved").limit(1).count():
            return ends


def variants(docs: DataFrame) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of every word of ``docs`` (doc_id, text)."""
    words = stash(word_counts(docs), "words")
    facts = near_words(words).groupBy("word").agg(
        F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("m"), F.col("near").alias("near"))).alias("_f"))
    enough = -F.col("_f.m") >= FORM_FACTOR * F.col("n")
    known = stash(
        words.join(facts.hint("merge"), "word", "left").select(
            "word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"),
            F.when(enough, F.col("_f.near")).alias("form"), F.when(enough, -F.col("_f.m")).alias("form_n")), "forms")
    ends = roots(known.filter("form is not null"))
    return known.join(ends.hint("merge"), "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants(table(spark, sf_dir, "documents"))
