"""Token files against the library's own encoding of whole texts."""

import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from vigilake.llm import token_files as tf
from vigilake.session import new_scratch_path

VOCABULARY = tf.default_vocabulary()
TRICKY = ["It's I'LL we've x'd", "a\x1cb \x1f c", "é ́a b\xa0c\x85d", "ΣΑΣ ΟΔΟΣ. İstanbul ǅ ß", "<|endoftext|> x<|startoftext|>y", "word.,!? 3,14 a.b 12ab", "漢字 かな 👍🏽 ﬁ"]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(VOCABULARY)


def expected(library, rows):
    at, out = 0, []
    for doc_id, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = [*library.encode(text or "", add_special_tokens=False).ids, tf.END_ID]
        out.append((doc_id, at, len(ids), zlib.crc32(np.array(ids, dtype="<u4").tobytes())))
        at += len(ids)
    return out


def test_word_by_word_equals_whole_texts(library, documents):
    texts = [*TRICKY, *[r.text for r in documents.limit(60).collect()]]
    for cached in (50, tf.CACHED):
        words = tf.WordIds(VOCABULARY, cached)
        found = [words.encode(t) for t in texts]
        assert [list(x) for x in found] == [library.encode(t, add_special_tokens=False).ids for t in texts]


def test_each_different_piece_is_encoded_once_for_many_texts(library):
    texts = ["Thing thing thing. other thing!? other 12ab thing", None, "", " \x0b other\x1cx 12ab THING### 12ab ", "é Élan élan, élan"] * 50
    words, made = tf.WordIds(VOCABULARY, 1), []
    piece, word = words._piece, words._word
    words._piece, words._word = lambda p: (made.append(("piece", p)), piece(p))[1], lambda w: (made.append(("word", w)), word(w))[1]
    ids, sizes = words.encode_all(tf.pa.array(texts))
    plain = [library.encode(t or "", add_special_tokens=False).ids for t in texts]
    assert sizes.tolist() == [len(x) for x in plain] and ids.tolist() == [i for x in plain for i in x]
    assert len(made) == len(set(made)) and {("piece", "thing"), ("piece", "élan"), ("word", "12ab")} <= set(made)


def test_slices_hold_every_row_once():
    texts = tf.pa.array(["a" * 10, None, "", "b" * 100, "cc", "d" * 50, ""])
    assert list(tf.slices(texts, 60)) == [(0, 3), (3, 4), (4, 7)] and list(tf.slices(texts.slice(1, 3), 60)) == [(0, 2), (2, 3)]
    assert list(tf.slices(texts.slice(0, 0))) == []


def test_files_give_back_every_document(spark, library, documents, odd_docs):
    for docs in (documents, odd_docs.filter("doc_id is not null").dropDuplicates(["doc_id"])):
        found = tf.token_output(docs, new_scratch_path(spark, "t"), VOCABULARY).collect()
        assert sorted(tuple(r) for r in found) == expected(library, [(r.doc_id, r.text) for r in docs.collect()])


def test_nulls_repeats_and_no_rows(spark, odd_docs, no_docs):
    rows = sorted(tf.token_output(odd_docs, new_scratch_path(spark, "t"), VOCABULARY).collect(), key=lambda r: r.start)
    assert len(rows) == odd_docs.count() and [r.doc_id for r in rows[:2]] == [None, None]
    assert all(a.start + a.n_tokens == b.start for a, b in zip(rows, rows[1:]))
    assert tf.token_output(no_docs, new_scratch_path(spark, "t"), VOCABULARY).count() == 0


def test_lookup_reads_what_it_needs(spark, documents):
    path = new_scratch_path(spark, "t")
    tf.write_tokens(documents, path, VOCABULARY)
    got = tf.tokens_of(spark, path, [3, 7])
    assert sorted(r.doc_id for r in got.collect()) == [3, 7]
    assert "PushedFilters: [In(doc_id" in got._jdf.queryExecution().toString()
