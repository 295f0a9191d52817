"""Spelling variants against brute force over all pairs of words."""

import random
import re
import zlib

import pytest

from vigilake.llm import spelling_variants as sv

TABLE = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def distance_one(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def brute(docs):
    counts = {}
    for doc_id, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(TABLE)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 31 == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            counts[run] = counts.get(run, 0) + 1
    words = sorted(w for w, n in counts.items() if len(w) >= 7 and n >= 2)
    by_length = {}
    for w in words:
        by_length.setdefault(len(w), []).append(w)
    forms, near = {}, {}
    for w in words:
        others = [v for k in (-1, 0, 1) for v in by_length.get(len(w) + k, []) if distance_one(w, v)]
        near[w] = len(others)
        best = min(others, key=lambda v: (-counts[v], v), default=None)
        forms[w] = best if best and counts[best] >= 10 * counts[w] else None
    out = {}
    for w in words:
        root = w
        while forms[root]:
            root = forms[root]
        out[w] = (forms[w], root, counts[w], near[w], counts[forms[w]] if forms[w] else None)
    return out


def check(spark, docs):
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    got = {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in sv.variants(frame).collect()}
    want = brute(docs)
    assert got == want
    return want


def misspelt(word, rng):
    k = rng.randrange(len(word))
    letter = rng.choice("aeiouxyzé÷ÿ")
    return rng.choice([word[:k] + word[k + 1:], word[:k] + letter + word[k:], word[:k] + letter + word[k + 1:]])


def made(seed=3, bases=40):
    rng = random.Random(seed)
    text = []
    for _ in range(bases):
        base = "".join(rng.choices("abcdefghijklmnopéü", k=rng.randint(7, 14)))
        text += [base] * rng.choice([2, 30, 200])
        for _ in range(rng.randint(0, 8)):
            one = misspelt(base, rng)
            text += [one] * rng.choice([1, 2, 20])
            text += [misspelt(one, rng)] * 2
    rng.shuffle(text)
    return [(i, " ".join(text[i::7])) for i in range(7)]


def test_variants_equal_brute_force(spark):
    want = check(spark, made() + [(50, "Letters-LETTERS letters1letters _letterz_ letterz abcdefg abcdefg abcdef abcdef"), (None, "lettera lettera"), (51, None), (52, ""), (50, "Letters")])
    assert sum(1 for v in want.values() if v[0]) > 20 and any(v[1] not in (v[0], w) for w, v in want.items())


def test_words_of_large_keys_meet_by_what_is_left(spark, monkeypatch):
    monkeypatch.setattr(sv, "GROUP", 3)
    check(spark, made(5, 25) + [(60, " ".join(f"abcdefgh{a}{b} abcdefgh{a}{b}" for a in "klmn" for b in "klmn"))])


def test_pieces_cut_no_run(monkeypatch):
    docs = made()
    whole = [sv.runs_of(i, t) for i, t in docs]
    monkeypatch.setattr(sv, "PIECE_CHARS", 20)
    assert [sv.runs_of(i, t) for i, t in docs] == whole


def test_long_words(spark):
    long = "".join(random.Random(1).choices("abcdefghij", k=300))
    check(spark, [(1, f"{long} {long} {long[:50]}x{long[50:]} {long[:50]}x{long[50:]} {long[:99]}{long[100:]}"), (2, f"{long[:99]}{long[100:]} {long[:20]}zz{long[20:]} {long[:48]} {long[:48]} {long[:49]} {long[:49]}")])


def test_documents_equal_brute_force(spark, documents):
    check(spark, [(r.doc_id, r.text) for r in documents.limit(60).collect()])


def test_near_words_share_a_signature_and_a_half():
    rng = random.Random(9)
    for _ in range(300):
        word = "".join(rng.choices("abcdefghijklmé", k=rng.randint(7, 30)))
        other = misspelt(word, rng)
        if other == word or len(other) < 7:
            continue
        who, keys, tags = sv.keys_of([word, other])
        shared = set(keys[who == 0]) & set(keys[who == 1])
        assert shared
        size, edit = min(len(word), len(other)), sv.one_edit(word, other)
        first = sv.first_tag(size, *edit)
        assert any(t >> 1 == first for t, k in zip(tags, keys, strict=True) if k in shared)


def test_odd_rows(spark, odd_docs, no_docs):
    assert sv.variants(no_docs).count() == 0
    out = sv.variants(odd_docs.withColumnRenamed("score", "word"))
    assert out.columns == ["word", "form", "root", "n", "n_near", "form_n"] and out.count() == 0


if __name__ == "__main__":
    pytest.main([__file__])
