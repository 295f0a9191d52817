"""What is removed, against a table of all 400-byte strings."""

import hashlib
import random
from collections import Counter

import numpy as np

from vigilake.llm import suffix_dedup as sd

N = sd.LENGTH


def brute(rows):
    data = [(d, (t or "").encode()) for d, t in rows]
    seen = Counter(b[i:i + N] for _, b in data for i in range(len(b) - N + 1))
    out = []
    for d, b in data:
        gone = np.zeros(len(b) + 1, dtype=bool)
        for i in range(len(b) - N + 1):
            if seen[b[i:i + N]] > 1:
                gone[i:i + N] = True
        kept = bytes(x for x, g in zip(b, gone, strict=False) if not g)
        out.append((d, len(b), int(gone.sum()), int((np.diff(gone.astype(int)) == -1).sum() + (0 if not gone[-1] else 1)), hashlib.sha256(kept).hexdigest()))
    return out


def check(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = [tuple(r) for r in sd.removals(docs).collect()]
    order = lambda r: (r[0] is not None, r)
    assert sorted(got, key=order) == sorted(brute(rows), key=order)
    return docs


def prose(rng, n):
    return "".join(rng.choice("abcde éfg") for _ in range(n))


def passages(seed, n_docs, lengths):
    rng = random.Random(seed)
    shared = [prose(rng, k) for k in lengths]
    rows = []
    for d in range(n_docs):
        parts = []
        for _ in range(rng.randint(0, 3)):
            s = rng.choice(shared)
            a = rng.randint(0, 60)
            parts += [prose(rng, rng.randint(0, 500)), s[a:len(s) - rng.randint(0, 60)]]
        rows.append((d, "".join(parts) + prose(rng, rng.randint(0, 300))))
    return rows


def test_shared_passages_of_all_lengths(spark):
    check(spark, passages(1, 60, [399, 400, 401, 430, 520, 700, 1500]))


def test_edits_inside_copies_and_repeats_inside_a_text(spark):
    rng = random.Random(4)
    base = prose(rng, 4000)
    rows = [(i, base[:p] + "#" * (i % 3) + base[p + i % 2:]) for i, p in enumerate(rng.sample(range(4000), 25))]
    rows += [(100, "a" * 2500), (101, "xy" * 700 + base[:410]), (102, base[500:1200] * 2), (103, base[:399]), (104, base[700:1100])]
    check(spark, rows)


def test_crowded_anchors_give_the_same(spark, monkeypatch):
    monkeypatch.setattr(sd, "GROUP", 3)
    check(spark, passages(2, 60, [420, 600, 610]))


def test_long_texts_in_pieces(spark, monkeypatch):
    rng = random.Random(6)
    base = prose(rng, 9000)
    monkeypatch.setattr(sd, "PIECE", 1500)
    monkeypatch.setattr(sd, "BUFFER", 4000)
    rows = [(1, base), (2, prose(rng, 777) + base[1000:6000] + prose(rng, 300)), (3, base[3000:3450]), (4, prose(rng, 5000))]
    texts = [(d, t.encode()) for d, t in rows]
    found = []
    for _, b in texts:
        for at, part in sd.pieces(b):
            found.append((at, len(part)))
    assert max(n for _, n in found) <= 1500
    check(spark, rows)


def test_odd_rows(spark, odd_docs, no_docs):
    rows = [(r.doc_id, r.text if len(r.text or "") < 5000 else r.text[:3000]) for r in odd_docs.collect()]
    rows += [(None, "q" * 450), (None, "q" * 450), (50, "漢字" * 300)]
    check(spark, rows)
    assert sd.removals(no_docs).count() == 0
    out = sd.without_repeats(odd_docs)
    assert out.columns == odd_docs.columns and out.count() == odd_docs.count()


def test_extension_is_verified_when_hashes_collide():
    group = sd.Group([b"x" * 10 + b"anchor" + b"y" * 500, b"z" * 10 + b"anchor" + b"y" * 400 + b"w" * 100], [10, 10])
    assert group.extension(0, 1, True) == 406 and group.extension(0, 1, False) == 0
    group.same = lambda *_: True
    assert group.extension(0, 1, True) == 406 and group.extension(0, 1, False) == 0
