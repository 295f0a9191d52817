"""Phrase collocation mining: Rabin-Karp fingerprints of every n-gram, counted by shuffle, verified against the text.

A text's words become 64-bit numbers; with prefix polynomials over them the fingerprint of the n-gram at any place is one
subtraction and one product, for all places at once. Fingerprints hold the language.

1. Words are counted. A fixed-size bitmap (``BITS`` bits, whatever the corpus) marks the frequent ones.
2. Pairs of marked words are counted, and the frequent pairs marked. These two passes only make filters, so they count 40
   bits of the fingerprints.
3. Marked words, marked pairs, and n-grams of three to ``MOST_WORDS`` words all of whose pairs are marked are counted. A
   phrase is never more frequent than its parts, so no frequent phrase is lost; a bitmap can only let too much through.
4. Inside a task n-grams are told apart by their words, so no fingerprints collide there. The shuffle adds up counts and, per
   occurrence, a second fingerprint of 24 bits, and keeps a pointer (32 bits) to texts of which one holds the n-gram.
5. Frequent phrases alone are read from the texts at their pointers (the only texts that are shuffled). There the sum of the
   second fingerprints must be that of the phrase read, as often as it was counted. Where it is not, fingerprints have
   collided: those are counted again, by their words.
6. Frequent phrases are joined with their parts (a hot first word is dealt over several tasks). A phrase inside a longer
   one of equal count is inside one that is one word longer, so one sum over those settles it.

Each task sums before the shuffle. A bitmap comes to the driver as at most ``BITS`` / 32768 rows of 4 kB and goes to the
tasks as a broadcast variable: 8 MB at any size.

Defined results: null and empty texts have no word; a null language is ``und``. Repeated rows count each. Pieces without
a word, and languages without candidates, give no row. Scores, ranks and ties are exact (decimals of 38 digits). Extra columns are
not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vigilake.llm.common import salted_join, stash, table

#: Fixed values of the task.
MOST_WORDS, LEAST_COUNT, REPORTED = 5, 100, 2000
#: Bits of the set of frequent fingerprints.
BITS = 1 << 26
#: Different words a worker knows by number; sums a task keeps; characters of a text and words taken together.
KNOWN, SUMS, PIECE_CHARS, WORDS = 250_000, 1 << 20, 1 << 20, 1 << 18
#: Bits of a fingerprint that the filters count.
FILTER_KEY = np.uint64((1 << 40) - 1)
BORDER = re.compile("[.,;:!?\n-\r]")
#: Bases of the two fingerprints and their inverses modulo 2^64.
BASES = [(np.uint64(b), np.uint64(pow(b, -1, 1 << 64))) for b in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)]
MIX = [np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)]
END, NOTHING = 0, 1


def mixed(x: np.ndarray) -> np.ndarray:
    """Bits of 64-bit numbers well mixed."""
    x = (x ^ (x >> np.uint64(30))) * MIX[0]
    x = (x ^ (x >> np.uint64(27))) * MIX[1]
    return x ^ (x >> np.uint64(31))


class Numbers(dict):
    """Word to a number of its own, with the hash of each number's word."""

    def __init__(self):
        super().__init__()
        self.reset()

    def reset(self) -> None:
        self.clear()
        self.words, self.hashes = [], []
        for known in ("\n", ""):
            self[known]

    def __missing__(self, word: str) -> int:
        n = self[word] = len(self.words)
        self.words.append(word)
        self.hashes.append(xxhash.xxh64_intdigest(word.encode("utf-8", "surrogatepass")))
        return n


def pieces(text: str) -> Iterator[str]:
    """The text, a bounded number of characters at a time, cut only where a piece ends."""
    at = 0
    while at < len(text):
        border = BORDER.search(text, at + PIECE_CHARS)
        end = border.end() if border else len(text)
        yield text[at:end]
        at = end


def words_of(text: str) -> list[str]:
    """Lower-cased (A-Z) words in order, ``\\n`` where a piece ends, and empty strings."""
    low = text.encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass")
    return BORDER.sub(" \n ", low).replace("\t", " ").split(" ")


class Places:
    """Numbers of the words of several texts end to end, and fingerprints of the n-grams at every place."""

    def __init__(self, numbers: np.ndarray, docs: np.ndarray, hashes: np.ndarray, lang: str):
        """``docs``: number of the text of each word."""
        words = numbers != NOTHING
        self.numbers, self.docs = numbers[words], docs[words]
        ends = np.append(np.flatnonzero(self.numbers == END), len(self.numbers))
        # Words from each place to the end of its piece.
        self.room = np.repeat(ends, np.diff(np.concatenate([[-1], ends])))[: len(self.numbers)] - np.arange(len(self.numbers))
        self.seed = xxhash.xxh64_intdigest(lang.encode("utf-8", "surrogatepass"))
        self.prefix, self.back = {}, {}
        for base, inverse in BASES:
            power = np.full(len(self.numbers) + 1, base, dtype=np.uint64)
            power[0] = 1
            prefix = np.zeros(len(self.numbers) + 1, dtype=np.uint64)
            np.cumsum(hashes[self.numbers] * np.cumprod(power)[:-1], out=prefix[1:])
            power[1:] = inverse
            self.prefix[base], self.back[base] = prefix, np.cumprod(power)

    def fingerprints(self, at: np.ndarray, n: int, which: int = 0) -> np.ndarray:
        """Of the ``n`` words from each place on; ``which``: 1 for the second fingerprint."""
        base = BASES[which][0]
        prefix = self.prefix[base]
        return mixed((prefix[at + n] - prefix[at]) * self.back[base][at] + np.uint64(self.seed * (2 * n + 1) & (1 << 64) - 1))

    def starts(self, n: int) -> np.ndarray:
        return np.flatnonzero(self.room >= n)


def marked(bitmap: np.ndarray, fingerprints: np.ndarray) -> np.ndarray:
    bucket = (fingerprints % np.uint64(BITS)).astype(np.int64)
    return (bitmap[bucket >> 3] >> (bucket & 7)) & 1 == 1


def groups(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Number of each key's group, and per group the place of its first key and its size."""
    code = pd.factorize(keys)[0]
    first = np.flatnonzero(np.diff(np.maximum.accumulate(code), prepend=-1)) if len(code) else np.zeros(0, np.int64)
    return code, first, np.bincount(code, minlength=len(first))


def grams(places: Places, level: int, bitmaps: list[np.ndarray]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(n, first places, counts) of the different n-grams to count at a level: 1 words, 2 pairs, 3 everything that may be frequent.

    An n-gram is told by its words: the group of its first n - 1 words and the last word. ``bitmaps`` mark words and pairs.
    """
    at = places.starts(1)
    group, first, count = groups(places.numbers[at])
    if level == 1:
        yield 1, at[first], count
        return
    for n in range(2, (2 if level == 2 else MOST_WORDS) + 1):
        if n <= 3:
            # What is marked of the words, then of the pairs: its group at each place, -1 elsewhere.
            known = marked(bitmaps[n - 2], places.fingerprints(at[first], n - 1))
            if level == 3:
                yield n - 1, at[first[known]], count[known]
            inner = np.full(len(places.numbers), -1, dtype=np.int64)
            inner[at] = np.where(known[group], group, -1)
            at = np.flatnonzero(inner >= 0)
            group = inner[at]
        more = places.room[at] >= n
        # The last of the n-gram's parts has to be marked too.
        more[more] = inner[at[more] + max(1, n - 2)] >= 0
        at, group = at[more], group[more]
        group, first, count = groups(group << 32 | places.numbers[at + n - 1])
        if n > 2 or level == 2:
            yield n, at[first], count


class Sums:
    """Per fingerprint: occurrences and, unless it is for a filter, sum of second fingerprints and smallest text; added up now and then."""

    def __init__(self, filtering: bool):
        self.filtering = filtering
        self.parts: list[tuple[np.ndarray, ...]] = []
        self.size = 0

    def add(self, places: Places, n: int, at: np.ndarray, count: np.ndarray, docs: np.ndarray) -> None:
        if len(at):
            key = places.fingerprints(at, n)
            self.parts.append((key & FILTER_KEY, count) if self.filtering else (
                key, count, (places.fingerprints(at, n, 1) >> np.uint64(40)).astype(np.int64) * count, docs[places.docs[at]]))
            self.size += len(at)
            if self.size > 2 * SUMS:
                self.parts = [self.total()]
                self.size = len(self.parts[0][0])

    def total(self) -> tuple[np.ndarray, ...]:
        key, *columns = (np.concatenate(c) for c in zip(*self.parts, strict=True))
        code, first, _ = groups(key)
        out = [key[first]]
        for c, add in zip(columns, (np.add, np.add, np.minimum), strict=False):
            total = c[first] if add is np.minimum else np.zeros(len(first), np.int64)
            add.at(total, code, c)
            out.append(total)
        return tuple(out)


def in_batches(batches: Iterator[pa.RecordBatch], numbers: Numbers) -> Iterator[tuple[str, Places, np.ndarray]]:
    """(language, places, keys of the texts) of some texts of a language at a time, in the order of the keys."""
    waiting: dict[str, list[tuple[int, np.ndarray]]] = {}
    held = 0

    def ready() -> Iterator[tuple[str, Places, np.ndarray]]:
        hashes = np.array(numbers.hashes, dtype=np.uint64)
        for lang, parts in waiting.items():
            parts.sort(key=lambda p: p[0])
            sizes = [len(p) for _, p in parts]
            yield lang, Places(np.concatenate([p for _, p in parts]), np.repeat(np.arange(len(parts)), sizes), hashes, lang), np.array([k for k, _ in parts], dtype=np.int64)

    for batch in batches:
        for lang, key, text in zip(*(batch.column(c).to_pylist() for c in ("lang", "doc", "text")), strict=True):
            for piece in pieces(text or ""):
                words = words_of(piece)
                words.append("\n")
                waiting.setdefault(lang, []).append((key, np.fromiter(map(numbers.__getitem__, words), dtype=np.int64, count=len(words))))
                held += len(words)
                if held >= WORDS:
                    yield from ready()
                    waiting, held = {}, 0
                    if len(numbers) > KNOWN:
                        numbers.reset()
    yield from ready()


def counter(level: int, bitmaps: list):
    """Arrow batches (lang, doc, text) to (lang, fingerprint, n, second, doc); ``bitmaps``: broadcast sets of frequent words and pairs.

    Level 1 has a row with the number of all words of each language too: the only ones with a language.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = [np.frombuffer(b.value, dtype=np.uint8) for b in bitmaps]
        sums, words = Sums(level < 3), {}

        def out(columns: tuple[np.ndarray, ...]) -> pa.RecordBatch:
            size = len(columns[0])
            arrays = [pa.array(c.view(np.int64)) for c in columns] + [pa.nulls(size, pa.int64())] * (4 - len(columns))
            return pa.RecordBatch.from_arrays([pa.nulls(size, pa.string()), *arrays], names=["lang", "fingerprint", "n", "second", "doc"])

        for lang, places, docs in in_batches(batches, Numbers()):
            for n, at, counts in grams(places, level, bits):
                sums.add(places, n, at, counts, docs)
                if level == 1:
                    words[lang] = words.get(lang, 0) + int(counts.sum())
            if sums.size > 3 * SUMS // 2 and sums.parts:
                sums.parts = [sums.total()]
                sums.size = len(sums.parts[0][0])
                if sums.size > SUMS * 3 // 2:
                    yield out(sums.total())
                    sums = Sums(level < 3)
        if sums.parts:
            yield out(sums.total())
        none = pa.nulls(len(words), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(list(words), pa.string()), none, pa.array(list(words.values()), pa.int64()), none, none], names=["lang", "fingerprint", "n", "second", "doc"])

    return count


def with_marked_texts(bitmap):
    """Arrow batches (lang, doc, text): only the rows whose ``doc`` is marked."""

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.frombuffer(bitmap.value, dtype=np.uint8)
        for batch in batches:
            yield batch.filter(pa.array(marked(bits, batch.column("doc").to_numpy().view(np.uint64))))

    return keep


def read_phrases(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts with the fingerprints that point at them (wanted: fingerprint, n, second) to (lang, fingerprint, phrase, words, n, agrees)."""
    for batch in batches:
        rows = []
        for lang, text, wanted in zip(*(batch.column(c).to_pylist() for c in ("lang", "text", "wanted")), strict=True):
            left, numbers = {w["fingerprint"]: w for w in wanted}, Numbers()
            row = pa.RecordBatch.from_pydict({"lang": [lang], "doc": [0], "text": [text]})
            for _, places, _ in in_batches(iter([row]), numbers):
                for n in range(1, MOST_WORDS + 1):
                    at = places.starts(n)
                    keys = places.fingerprints(at, n).view(np.int64)
                    for k in np.flatnonzero(np.isin(keys, np.fromiter(left, dtype=np.int64, count=len(left)))):
                        w = left.pop(int(keys[k]), None)
                        if w:
                            phrase = " ".join(map(numbers.words.__getitem__, places.numbers[at[k] : at[k] + n].tolist()))
                            second = int(places.fingerprints(at[k : k + 1], n, 1)[0] >> np.uint64(40))
                            rows.append((lang, w["fingerprint"], phrase, n, w["n"], second * w["n"] == w["second"]))
            # Another text with the same key holds them.
            rows += [(lang, f, None, 0, w["n"], False) for f, w in left.items()]
        yield pa.RecordBatch.from_arrays(
            [pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.string(), pa.int64(), pa.string(), pa.int32(), pa.int64(), pa.bool_()))],
            names=["lang", "fingerprint", "phrase", "words", "n", "agrees"])


def recounter(bitmap):
    """Arrow batches (lang, doc, text) to (lang, phrase, words, n) of the n-grams whose fingerprints are marked, by their words."""

    def recount(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits, numbers = np.frombuffer(bitmap.value, dtype=np.uint8), Numbers()
        sums: dict[tuple[str, str, int], int] = {}

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(
                [*(pa.array([k[i] for k in sums], t) for i, t in enumerate((pa.string(), pa.string(), pa.int32()))), pa.array(list(sums.values()), pa.int64())],
                names=["lang", "phrase", "words", "n"])

        for lang, places, _ in in_batches(batches, numbers):
            for n in range(1, MOST_WORDS + 1):
                at = places.starts(n)
                for place in at[marked(bits, places.fingerprints(at, n))].tolist():
                    key = (lang, " ".join(map(numbers.words.__getitem__, places.numbers[place : place + n].tolist())), n)
                    sums[key] = sums.get(key, 0) + 1
            if len(sums) > SUMS:
                yield out()
                sums = {}
        yield out()

    return recount


def bitmap_of(rows: DataFrame, column: str = "fingerprint"):
    """Broadcast bitmap of a column of 64-bit numbers; at most BITS / 32768 rows of 4 kB come to the driver."""
    # The bucket is the unsigned number modulo BITS, a power of two: its low bits.
    bucket = F.col(column).bitwiseAND(F.lit(BITS - 1)) + 1
    parts = rows.groupBy(F.bitmap_bucket_number(bucket).alias("part")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(bucket)).alias("bits")).collect()
    out = bytearray(BITS // 8)
    for r in parts:
        out[(r.part - 1) * 4096 : r.part * 4096] = r.bits
    return rows.sparkSession.sparkContext.broadcast(bytes(out))


def part(phrase: Column, begin: Column, count: Column) -> Column:
    """``count`` words of a phrase from word ``begin`` (1 the first) on."""
    return F.concat_ws(" ", F.slice(F.split(phrase, " "), begin, count))


def scored(phrases: DataFrame, totals: DataFrame) -> DataFrame:
    """(lang, phrase, a, l, r, n, score) of all candidates not inside a longer one of equal count; ``phrases``: (lang, phrase, words, n)."""
    candidates = phrases.filter("words > 1").select("lang", "phrase", "words", F.col("n").alias("a"))
    counts = phrases.select("lang", "phrase", "n")
    cuts = candidates.withColumn("cut", F.explode(F.sequence(F.lit(1), F.col("words") - 1))).select(
        "lang", "phrase", "a", "cut", part(F.col("phrase"), F.lit(1), F.col("cut")).alias("first"), part(F.col("phrase"), F.col("cut") + 1, F.col("words")).alias("rest"))
    cuts = salted_join(cuts, counts.select("lang", F.col("phrase").alias("first"), F.col("n").alias("l")), ["lang", "first"], F.col("phrase"))
    cuts = salted_join(cuts, counts.select("lang", F.col("phrase").alias("rest"), F.col("n").alias("r")), ["lang", "rest"], F.col("phrase"))
    # One row per language on the right.
    cuts = salted_join(cuts, totals, ["lang"], F.col("phrase"))
    score = F.expr("cast(1000 * cast(a as decimal(17,0)) * cast(n as decimal(16,0)) as decimal(38,0)) div cast(cast(l as decimal(19,0)) * cast(r as decimal(19,0)) as decimal(38,0))")
    least = cuts.select("lang", "phrase", "a", "n", "l", "r", "cut", score.alias("score")).groupBy("lang", "phrase", "a", "n").agg(
        F.min(F.struct("score", "cut", "l", "r")).alias("_c"))
    longer = candidates.filter("words > 2").select("lang", "a", F.explode(F.array(
        part(F.col("phrase"), F.lit(1), F.col("words") - 1), part(F.col("phrase"), F.lit(2), F.col("words")))).alias("phrase")).groupBy("lang", "phrase").agg(F.max("a").alias("_longer"))
    alone = least.join(longer.hint("merge"), ["lang", "phrase"], "left").filter(F.col("_longer").isNull() | (100 * F.col("_longer") < 100 * F.col("a")))
    return alone.select("lang", "phrase", "a", F.col("_c.l").alias("l"), F.col("_c.r").alias("r"), "n", F.col("_c.score").alias("score"))


def frequent_phrases(docs: DataFrame, least: int = LEAST_COUNT) -> tuple[DataFrame, DataFrame]:
    """(lang, phrase, words, n) of all phrases of 1 to ``MOST_WORDS`` words found ``least`` times, and (lang, n) of all words."""
    lang = F.coalesce("lang", F.lit("und"))
    texts = docs.select(lang.alias("lang"), F.xxhash64(lang, "text").bitwiseAND(F.lit(0xFFFFFFFF)).alias("doc"), "text")
    schema, bitmaps, totals = "lang string, fingerprint long, n long, second long, doc long", [], None
    for level in (1, 2):
        sums = texts.mapInArrow(counter(level, bitmaps), schema).groupBy("lang", "fingerprint").agg(F.sum("n").alias("n"))
        often = stash(sums.filter((F.col("n") >= least) | F.col("fingerprint").isNull()), "often")
        totals = often.filter("fingerprint is null").select("lang", "n") if totals is None else totals
        bitmaps.append(bitmap_of(often.filter("fingerprint is not null")))
    # A sum beyond 63 bits is null and agrees with nothing: counted again.
    frequent = stash(
        texts.mapInArrow(counter(3, bitmaps), schema).filter("fingerprint is not null").groupBy("fingerprint")
        .agg(F.sum("n").alias("n"), F.try_sum("second").alias("second"), F.min("doc").alias("doc")).filter(F.col("n") >= least), "frequent")
    pointed = texts.mapInArrow(with_marked_texts(bitmap_of(frequent, "doc")), texts.schema).distinct()
    wanted = frequent.groupBy("doc").agg(F.collect_list(F.struct("fingerprint", "n", "second")).alias("wanted"))
    read = stash(
        pointed.join(wanted.hint("merge"), "doc").select("lang", "text", "wanted")
        .mapInArrow(read_phrases, "lang string, fingerprint long, phrase string, words int, n long, agrees boolean"), "read")
    told = stash(
        read.groupBy("fingerprint").agg(F.max(F.when(F.col("agrees"), F.struct("lang", "phrase", "words", "n"))).alias("_p")), "phrases")
    phrases = told.filter("_p is not null").select("_p.*")
    collided = told.filter("_p is null").select("fingerprint")
    if collided.limit(1).count():
        # Marked with the collided ones may be others; their phrases have been read already.
        again = texts.mapInArrow(recounter(bitmap_of(collided)), "lang string, phrase string, words int, n long")
        again = again.groupBy("lang", "phrase", "words").agg(F.sum("n").alias("n")).filter(F.col("n") >= least)
        phrases = stash(phrases.unionByName(again).distinct(), "all-phrases")
    return phrases, totals


def collocations(docs: DataFrame, least: int = LEAST_COUNT, reported: int = REPORTED) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the ``reported`` best phrases of each language."""
    phrases, totals = frequent_phrases(docs, least)
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = scored(phrases, totals).withColumn("rank", F.row_number().over(order).cast("long")).filter(F.col("rank") <= reported)
    return ranked.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents"))


COLLOCATIONS_SQL = r"""
WITH pieces AS (
  SELECT lang, list_filter(regexp_split_to_array(piece, '[ \t]+'), lambda x: x <> '') AS w
  FROM (SELECT coalesce(lang, 'und') AS lang,
               unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                            '[.,;:!?\x0A-\x0D]')) AS piece
        FROM documents)
), totals AS (SELECT lang, sum(len(w))::BIGINT AS n FROM pieces GROUP BY lang),
sizes AS (SELECT unnest(range(1, 6)) AS k),
grams AS (
  SELECT lang, k, array_to_string(w[i:i + k - 1], ' ') AS phrase
  FROM (SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM pieces, sizes WHERE len(w) >= k)
), f AS (SELECT lang, k, phrase, count(*) AS a FROM grams GROUP BY ALL HAVING count(*) >= 100),
cuts AS (
  SELECT lang, phrase, k, a, cut, array_to_string(ws[1:cut], ' ') AS head, array_to_string(ws[cut + 1:k], ' ') AS rest
  FROM (SELECT lang, phrase, k, a, string_split(phrase, ' ') AS ws, unnest(range(1, k)) AS cut FROM f WHERE k > 1)
), least AS (
  SELECT c.lang, c.phrase, c.k, c.a, l.a AS l, r.a AS r, t.n,
         ((1000::HUGEINT * c.a * t.n) // (l.a::HUGEINT * r.a))::BIGINT AS score,
         row_number() OVER (PARTITION BY c.lang, c.phrase ORDER BY (1000::HUGEINT * c.a * t.n) // (l.a::HUGEINT * r.a), c.cut) AS place
  FROM cuts c JOIN f l ON l.lang = c.lang AND l.phrase = c.head JOIN f r ON r.lang = c.lang AND r.phrase = c.rest
  JOIN totals t ON t.lang = c.lang
), inner_of AS (
  SELECT DISTINCT s.lang, s.phrase FROM f s JOIN f b ON b.lang = s.lang AND b.k > s.k AND b.a >= s.a
  WHERE s.k > 1 AND contains(' ' || b.phrase || ' ', ' ' || s.phrase || ' ')
), ranked AS (
  SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score
  FROM least WHERE place = 1 AND NOT EXISTS (SELECT 1 FROM inner_of i WHERE i.lang = least.lang AND i.phrase = least.phrase)
)
SELECT * FROM ranked WHERE rank <= 2000
"""
