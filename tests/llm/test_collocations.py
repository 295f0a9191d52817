"""Collocations against brute force and against their SQL."""

import random
import re

import numpy as np
import pyarrow as pa
import pytest
from oracle import compare
from vigilake.llm import collocations as co

TABLE = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(docs, least, reported=2000):
    counts, total = {}, {}
    for lang, text in docs:
        lang = "und" if lang is None else lang
        f = counts.setdefault(lang, {})
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(TABLE)):
            w = re.findall(r"[^\x20\x09]+", piece)
            total[lang] = total.get(lang, 0) + len(w)
            for i in range(len(w)):
                for k in range(1, 6):
                    if i + k <= len(w):
                        f[tuple(w[i:i + k])] = f.get(tuple(w[i:i + k]), 0) + 1
    out = {}
    for lang, f in counts.items():
        chosen = {p: a for p, a in f.items() if len(p) > 1 and a >= least}
        rows = []
        for p, a in chosen.items():
            if any(len(q) > len(p) and 100 * b >= 100 * a and any(q[i:i + len(p)] == p for i in range(len(q))) for q, b in chosen.items()):
                continue
            score, _, k = min((1000 * a * total[lang] // (f[p[:k]] * f[p[k:]]), k, k) for k in range(1, len(p)))
            rows.append((-score, -a, " ".join(p).encode(), f[p[:k]], f[p[k:]]))
        out[lang] = [(p.decode(), -a, l, r, total[lang], -s) for s, a, p, l, r in sorted(rows)[:reported]]
    return {lang: rows for lang, rows in out.items() if rows}


def found(frame, least, reported=2000):
    out = {}
    for r in co.collocations(frame, least, reported).collect():
        out.setdefault(r.lang, []).append((r["rank"], r.phrase, r.a, r.l, r.r, r.n, r.score))
    rows = {lang: sorted(v) for lang, v in out.items()}
    assert all([x[0] for x in v] == list(range(1, len(v) + 1)) for v in rows.values())
    return {lang: [x[1:] for x in v] for lang, v in rows.items()}


def made(seed=1, n=200):
    rng = random.Random(seed)
    vocabulary = ["The", "of", "a", "b", "é", "漢", "x\xa0y", "q'", "z-z", "NUL\x00"]
    docs = []
    for i in range(n):
        w = rng.choices(vocabulary, k=rng.randint(0, 40))
        for _ in range(rng.randint(0, 3)):
            w.insert(rng.randrange(len(w) + 1), rng.choice(["once upon a time there was one", "fixed phrase", "of the of the of"]))
        docs.append((rng.choice(["en", "en", "de", None, "und"]), "".join(x + rng.choice([" ", " ", "  ", "\t", ". ", "\n", ",\r\n"]) for x in w)))
    return docs


def test_collocations_equal_brute_force(spark):
    docs = made()
    frame = spark.createDataFrame(docs, "lang string, text string").repartition(5)
    for least in (3, 25):
        want = brute(docs, least)
        assert found(frame, least) == want and len(want) == 3
    assert found(frame, 3, 7) == brute(docs, 3, 7)


def test_query_equals_its_sql(spark):
    message, rows = compare(co.op11_collocations(spark, "/root/testdata/sf0.01"), co.COLLOCATIONS_SQL, "/root/testdata/sf0.01")
    assert message is None and rows > 50, message


class Shared:
    """As a broadcast variable: everything marked."""

    value = b"\xff" * (co.BITS // 8)


def places_of(words, hashes=None):
    numbers = co.Numbers()
    codes = np.array([numbers[w] for w in words])
    known = np.array(numbers.hashes, dtype=np.uint64)
    return numbers, co.Places(codes, np.zeros(len(codes), dtype=np.int64), known if hashes is None else known * np.uint64(hashes), "en")


def test_colliding_fingerprints_are_told_apart_by_words():
    words = [*"a b c a d c a b c".split(), "\n"]
    numbers, places = places_of(words, hashes=0)
    assert len(np.unique(places.fingerprints(places.starts(2), 2))) == 1
    bits = np.frombuffer(Shared.value, dtype=np.uint8)
    for level, most in ((1, 1), (2, 2), (3, 5)):
        found = {}
        for n, at, count in co.grams(places, level, [bits, bits]):
            assert level - 1 <= n + 1 and n <= most
            found.update({tuple(words[a:a + n]): c for a, c in zip(at.tolist(), count.tolist(), strict=True)})
    want = {}
    for i in range(9):
        for n in range(1, 6):
            if i + n <= 9:
                want[tuple(words[i:i + n])] = want.get(tuple(words[i:i + n]), 0) + 1
    assert found == want


def test_phrases_that_disagree_are_recounted_by_their_words():
    text = "x y z. x y q"
    numbers, places = places_of(["x", "y", "z", "\n", "x", "y", "q", "\n"])
    key, second = int(places.fingerprints(np.array([0]), 2).view(np.int64)[0]), int(places.fingerprints(np.array([0]), 2, 1)[0] >> np.uint64(40))
    for n, total, agrees in ((2, 2 * second, True), (2, 2 * second + 1, False), (3, 2 * second, False)):
        wanted = [{"fingerprint": key, "n": n, "second": total}, {"fingerprint": 7, "n": 100, "second": None}]
        rows = next(co.read_phrases(iter([pa.RecordBatch.from_pydict({"lang": ["en"], "text": [text], "wanted": [wanted]})]))).to_pylist()
        assert rows == [{"lang": "en", "fingerprint": key, "phrase": "x y", "words": 2, "n": n, "agrees": agrees}, {"lang": "en", "fingerprint": 7, "phrase": None, "words": 0, "n": 100, "agrees": False}]
    batch = pa.RecordBatch.from_pydict({"lang": ["en"], "doc": [1], "text": [text]})
    counts = {r["phrase"]: r["n"] for b in co.recounter(Shared)(iter([batch])) for r in b.to_pylist()}
    assert counts == {"x": 2, "y": 2, "z": 1, "q": 1, "x y": 2, "y z": 1, "y q": 1, "x y z": 1, "x y q": 1}


def test_prefix_fingerprints_do_not_depend_on_the_place():
    _, places = places_of("x y z w x y z \n".split(" "))
    assert places.fingerprints(np.array([0]), 3) == places.fingerprints(np.array([4]), 3)
    assert places.fingerprints(np.array([0]), 3, 1) == places.fingerprints(np.array([4]), 3, 1) != places.fingerprints(np.array([0]), 3)
    assert places.starts(3).tolist() == [0, 1, 2, 3, 4]


def test_long_texts_are_cut_where_pieces_end(monkeypatch):
    text = "one two three. four five six\nseven " * 50
    monkeypatch.setattr(co, "PIECE_CHARS", 40)
    cut = [w for p in co.pieces(text) for w in co.words_of(p)]
    assert [w for w in cut if w] == [w for w in co.words_of(text) if w] and len(list(co.pieces(text))) > 20


def test_odd_rows(spark, odd_docs, no_docs):
    assert co.collocations(no_docs).count() == 0
    docs = [(r.lang, r.text) for r in odd_docs.collect()]
    assert found(odd_docs.withColumnRenamed("score", "phrase"), 20) == brute(docs, 20)


if __name__ == "__main__":
    pytest.main([__file__])
