"""Token-ID / binary output: ORC with integer run-length encoding, row indexes and Bloom filters on document ids.

Documents are range-partitioned and sorted by id, encoded, and written as one ORC file per range: a row per document
with its id, the range's number, the offset of its first token inside the range and its token ids (an integer list, so
ORC's run-length encoding bit-packs it). Stripes can be read in parallel; row indexes and Bloom filters on ``doc_id``
let a look-up skip stripes and row groups. The offset over the whole corpus is the range's base, a sum over ranges,
plus the stored offset: no running sum over all documents is needed.

Encoding: no token of the vocabulary's pre-tokenizer crosses white space, so a text's ids are those of its words in
order: Arrow finds the different words of some documents, and only these are looked up. Words of Latin letters with
closing punctuation are taken by their letters and their punctuation, which the pre-tokenizer separates too; everything
else goes to the tokenizers library as it is. What a worker has encoded it remembers while its (bounded) cache lasts.

Defined results: a null or empty text is the end id alone. Order is ascending doc_id, nulls first, equal ids by text.
Repeated rows are documents of their own. Extra columns are left out.
"""

from __future__ import annotations

import functools
import zlib
from array import array
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from vigilake.llm.common import table
from vigilake.session import new_scratch_path

END_ID = 1
#: Different pieces, and as many odd words, that a worker remembers.
CACHED = 250_000
#: Bytes of text that are encoded at a time, and documents that are handed on at a time.
BYTES, ROWS = 2 << 20, 256
#: Latin letters, then ASCII punctuation: two pieces of the pre-tokenizer.
PLAIN = r"^(?P<stem>[A-Za-zÀ-ÖØ-öø-ÿ]+)(?P<tail>[!-/:-@\[-`{-~]*)$"
ORC_OPTIONS = {
    "orc.compress": "zstd", "orc.bloom.filter.columns": "doc_id", "orc.bloom.filter.fpp": "0.01", "orc.create.index": "true",
    "orc.row.index.stride": "2000", "orc.stripe.size": str(16 << 20),
}
FILE_SCHEMA = "doc_id long, part int, offset long, n_tokens int, ids array<int>"


def byte_letters() -> dict[int, str]:
    """Byte-level alphabet: printable bytes stand for themselves, the others for the code points from 256 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}


def taken(flat: np.ndarray, sizes: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Values and sizes of some rows, in their order, of rows of ``sizes`` values that stand one behind the other in ``flat``."""
    starts, own = np.cumsum(sizes, dtype=np.int32) - sizes, sizes[rows]
    ends = np.cumsum(own, dtype=np.int32)
    at = np.repeat(starts[rows] - (ends - own), own)
    at += np.arange(len(at), dtype=np.int32)
    return flat[at], own


class WordIds:
    """Encodes texts; pieces of words and whole odd words are remembered with their ids as bytes."""

    def __init__(self, vocabulary: str, cached: int = CACHED):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(vocabulary)
        self.model, self.letters, self.cached = self.tokenizer.model, byte_letters(), cached
        self.pieces: dict[str, bytes] = {}
        self.odd: dict[str, bytes] = {}
        self.kind = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4")

    def _packed(self, ids: list[int]) -> bytes:
        return array(self.kind.char, ids).tobytes()

    def _piece(self, piece: str) -> bytes:
        """Ids of one piece of the pre-tokenizer: lower-case letters or punctuation."""
        shown = piece if piece.isascii() else piece.encode().decode("latin-1").translate(self.letters)
        return self._packed([t.id for t in self.model.tokenize(shown)]) if piece else b""

    def _word(self, word: str) -> bytes:
        return self._packed(self.tokenizer.encode(word, add_special_tokens=False).ids)

    def _found(self, texts: list[str], known: dict[str, bytes], made: Callable[[str], bytes]) -> list[bytes]:
        out = list(map(known.get, texts))
        for i, ids in enumerate(out):
            if ids is None:
                if len(known) >= self.cached:
                    known.clear()
                out[i] = known[texts[i]] = made(texts[i])
        return out

    def encode_all(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, one behind the other, and how many each has; each different word is looked up once."""
        split = pc.ascii_split_whitespace(pc.fill_null(texts, ""))
        words = split.flatten().dictionary_encode()
        parts = pc.extract_regex(words.dictionary, PLAIN)
        plain = parts.is_valid()
        pairs = [pc.utf8_lower(pc.struct_field(parts, "stem")).filter(plain), pc.struct_field(parts, "tail").filter(plain)]
        pieces = pa.concat_arrays(pairs).dictionary_encode()
        found = self._found(pieces.dictionary.to_pylist(), self.pieces, self._piece)
        found += [b"", *self._found(words.dictionary.filter(pc.invert(plain)).to_pylist(), self.odd, self._word)]
        flat = np.frombuffer(b"".join(found), dtype=self.kind)
        sizes = np.fromiter(map(len, found), dtype=np.int32, count=len(found)) // np.int32(self.kind.itemsize)
        # Two rows for each different word: stem and tail, or the odd word and nothing.
        none, is_plain = len(pieces.dictionary), plain.to_numpy(zero_copy_only=False)
        of_word = np.full((len(is_plain), 2), none, dtype=np.int32)
        of_word[is_plain] = pieces.indices.to_numpy(zero_copy_only=False).reshape(2, -1).T
        of_word[~is_plain, 0] = np.arange(none + 1, len(found))
        flat, sizes = taken(flat, sizes, of_word.ravel())
        flat, sizes = taken(flat, sizes.reshape(-1, 2).sum(axis=1, dtype=np.int32), words.indices.to_numpy(zero_copy_only=False))
        before = np.concatenate([[0], np.cumsum(sizes)])[split.offsets.to_numpy() - split.offsets[0].as_py()]
        return flat, np.diff(before)

    def encode(self, text: str | None) -> np.ndarray:
        return self.encode_all(pa.array([text], pa.string()))[0]


def slices(texts: pa.Array, most: int = BYTES) -> Iterator[tuple[int, int]]:
    """Rows from and to, with about ``most`` bytes of text or a single one."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
    a = 0
    while a < len(ends):
        b = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + most, "right")))
        yield a, b
        a = b


@functools.lru_cache(maxsize=2)
def word_ids(vocabulary: str) -> WordIds:
    """One per worker process, so that tasks share what it has learnt."""
    return WordIds(vocabulary)


def encoder_of(vocabulary: str, end_id: int):
    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, part, at = word_ids(vocabulary), TaskContext.get().partitionId(), 0
        for whole in batches:
            for a, b in slices(whole.column("text")):
                batch = whole.slice(a, b - a)
                ids, sizes = words.encode_all(batch.column("text"))
                ends = np.cumsum(sizes + 1)
                flat = np.full(int(ends[-1]), end_id, dtype=np.int32)
                inside = np.ones(len(flat), dtype=bool)
                inside[ends - 1] = False
                flat[inside] = ids
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]).astype(np.int32)), pa.array(flat))
                out = pa.RecordBatch.from_arrays(
                    [batch.column("doc_id"), pa.array(np.full(b - a, part, dtype=np.int32)), pa.array(at + ends - sizes - 1),
                     pa.array((sizes + 1).astype(np.int32)), lists],
                    names=["doc_id", "part", "offset", "n_tokens", "ids"],
                )
                yield from (out.slice(k, ROWS) for k in range(0, out.num_rows, ROWS))
                at += int(ends[-1])

    return encode


def write_tokens(docs: DataFrame, path: str, vocabulary: str, end_id: int = END_ID) -> None:
    """Writes the token files of ``docs`` (doc_id, text) to ``path``."""
    ordered = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").repartitionByRange("doc_id", F.xxhash64("text")).sortWithinPartitions("doc_id", F.xxhash64("text"), "text")
    ordered.mapInArrow(encoder_of(vocabulary, end_id), FILE_SCHEMA).write.options(**ORC_OPTIONS).orc(path)


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids) of all documents; ``start`` counts the ids of all documents before."""
    rows = spark.read.schema(FILE_SCHEMA).orc(path)
    totals = rows.groupBy("part").agg(F.sum(F.col("n_tokens").cast("long")).alias("_n"))
    # One row per file written.
    before = W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    bases = totals.select("part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    return rows.join(F.broadcast(bases), "part").select("doc_id", (F.col("_base") + F.col("offset")).alias("start"), F.col("n_tokens").cast("long").alias("n_tokens"), "ids")


def tokens_of(spark: SparkSession, path: str, doc_ids: list[int]) -> DataFrame:
    """The rows of some documents; row indexes and Bloom filters prune what is read."""
    return read_tokens(spark, path).filter(F.col("doc_id").isin(doc_ids))


def checksums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        lists = batch.column("ids")
        flat, ends = np.asarray(lists.flatten()).astype("<u4"), np.asarray(lists.offsets) - lists.offsets[0].as_py()
        crc = [zlib.crc32(flat[a:b].tobytes()) for a, b in zip(ends, ends[1:], strict=False)]
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), batch.column("start"), batch.column("n_tokens"), pa.array(crc, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])


def token_output(docs: DataFrame, path: str, vocabulary: str) -> DataFrame:
    """Writes the files, reads them back: (doc_id, start, n_tokens, ids_crc32)."""
    write_tokens(docs, path, vocabulary)
    return read_tokens(docs.sparkSession, path).mapInArrow(checksums, "doc_id long, start long, n_tokens long, ids_crc32 long")


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op9_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_output(table(spark, sf_dir, "documents"), new_scratch_path(spark, "tokens"), default_vocabulary())
