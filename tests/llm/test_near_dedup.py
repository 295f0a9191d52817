"""Groups against all pairs of full sets; signatures against their promise."""

import random
import re

import numpy as np
import pytest

from vigilake.llm import near_dedup as nd

TABLE = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def sets_of(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(TABLE))
    return {tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def brute(docs, percent=85):
    """{doc_id: (size, component)} by comparing all different sets."""
    by = {}
    for doc_id, text in docs:
        by.setdefault(frozenset(sets_of(text)), []).append(doc_id)
    sets = [s for s in by if s]
    where = {}
    for k, s in enumerate(sets):
        for g in s:
            where.setdefault(g, []).append(k)
    parent = list(range(len(sets)))

    def find(a):
        while parent[a] != a:
            a = parent[a]
        return a

    for k, s in enumerate(sets):
        shared = {}
        for g in s:
            for j in where[g]:
                if j < k:
                    shared[j] = shared.get(j, 0) + 1
        for j, n in shared.items():
            if 100 * n >= percent * (len(s) + len(sets[j]) - n):
                parent[find(k)] = find(j)
    low = {}
    for k, s in enumerate(sets):
        low[find(k)] = min(low.get(find(k), min(by[s])), min(by[s]))
    out = {d: (0, d) for d in by.get(frozenset(), [])}
    out.update({d: (len(s), low[find(k)]) for k, s in enumerate(sets) for d in by[s]})
    return out


def check(spark, rows, percent=85):
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in nd.groups(docs, percent).collect()}
    want = brute(rows, percent)
    assert got == {d: (n, c, c == d) for d, (n, c) in want.items()}
    return docs, want


def near_copies(n, edits, length=120, seed=5, first=0):
    rng = random.Random(seed)
    base = [f"w{rng.randrange(10**6)}" for _ in range(length)]
    rows = []
    for i in range(n):
        w = list(base)
        for _ in range(rng.randint(0, edits)):
            w[rng.randrange(length)] = f"e{rng.randrange(10**6)}"
        rows.append((first + i, " ".join(w)))
    return rows


def test_groups_equal_all_pairs(spark, documents):
    rows = [(r.doc_id, r.text) for r in documents.collect()] + near_copies(150, 9, first=5000)
    docs, want = check(spark, rows)
    assert len({c for _, c in want.values()}) < len(want)
    stay = nd.survivors(docs).collect()
    assert sorted(r.doc_id for r in stay) == sorted({c for _, c in want.values()})


def test_large_clusters_are_compared_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(nd, "BLOCK", 40)
    monkeypatch.setattr(nd, "HUBS", 6)
    check(spark, near_copies(260, 8, seed=8))


@pytest.mark.parametrize("percent", [50, 70, 80])
def test_lower_similarities_miss_no_link(spark, percent):
    rows = [r for k in range(6) for r in near_copies(14, int((100 - percent) * 0.25), seed=30 + k, first=100 * k)]
    _, want = check(spark, rows, percent)
    assert 6 < len({c for _, c in want.values()}) < len(rows)
    assert nd.miss_probability(percent / 100, nd.rows_of_band(percent)) <= nd.MOST_MISSED
    assert (nd.rows_of_band(85), nd.rows_of_band(80)) == (6, 5)
    with pytest.raises(ValueError, match="too low"):
        nd.rows_of_band(1)


def test_odd_texts_and_ids(spark, odd_docs, no_docs):
    usable = [(r.doc_id, r.text) for r in odd_docs.filter("doc_id is not null").dropDuplicates(["doc_id"]).collect()]
    check(spark, [*usable, (20, "A B c"), (21, "a b\x0bC"), (22, "a\xa0b c"), (23, "x\x1cy z")])
    assert nd.groups(no_docs).count() == 0 and nd.groups(odd_docs).count() == odd_docs.count()
    stay = nd.survivors(odd_docs)
    assert stay.columns == odd_docs.columns
    texts = [r.text for r in stay.collect()]
    assert texts.count("same text here twice") == 1 and texts.count("a\x00b \u2028 c") == 1 and texts.count("null id") == 1
    assert sum(1 for t in texts if not (t or "").strip()) == 4


def test_signatures_estimate_similarity_with_less_variance_than_independent_places():
    rng = np.random.default_rng(0)
    errors = []
    for _ in range(150):
        pool = rng.integers(0, 2**63, 90, dtype=np.uint64)
        a, b = np.unique(pool[:70]), np.unique(pool[20:])
        same = (nd.superminhash(a, 64) == nd.superminhash(b, 64)).mean()
        errors.append(same - 50 / 90)
    p = 50 / 90
    assert abs(np.mean(errors)) < 0.02
    assert np.var(errors) < p * (1 - p) / 64
    assert nd.miss_probability() < 5e-7


@pytest.mark.parametrize("n", [1, 2, 30])
def test_every_place_is_filled(n):
    assert np.isfinite(nd.superminhash(np.arange(1, n + 1, dtype=np.uint64))).all()
