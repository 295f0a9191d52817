"""Decontamination, toxicity and mixing against brute force and held-out labels."""

import os
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from vigilake.llm import decontamination as dc
from vigilake.llm import mixing, toxicity

SF_DIR = os.environ.get("ORACLE_SF_DIR", "/root/testdata/sf0.001")


def words(text):
    return re.findall(r"\w+", (text or "").lower())


def grams(w):
    return {tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def brute_leaks(docs, items, span):
    out = set()
    for doc_id, text in docs:
        w = words(text)
        for item, t in items:
            v = words(t)
            if not v:
                continue
            half = (len(v) + 1) // 2
            parts = [grams(v), grams(v[:half]), grams(v[half:])]
            n = len(next(iter(parts[0])))
            parts = [p if len(next(iter(p), ())) == n else parts[0] for p in parts]
            for a in range(0, max(1, len(w)), span):
                held = {tuple(w[a:a + 2 * span][i:i + n]) for i in range(len(w[a:a + 2 * span]) - n + 1)}
                shares = [len(p & held) / len(p) for p in parts]
                if shares[0] >= 0.8 and min(shares[1:]) >= 0.5:
                    out.add((doc_id, item))
    return out


def test_block_max_wand_finds_what_full_scoring_finds():
    rng = random.Random(1)
    vocabulary = [f"t{i}" for i in range(60)]
    items = [(i, " ".join(rng.choices(vocabulary, k=rng.randint(1, 25)))) for i in range(200)]
    index = dc.Index(items)
    for _ in range(150):
        query = sorted({index.terms[w] for w in rng.choices(vocabulary, k=rng.randint(1, 40)) if w in index.terms})
        scores = np.zeros(len(index.ids))
        for t in query:
            for k, v in zip(*index.postings[t], strict=True):
                scores[k] += v
        want = {k for k in range(len(scores)) if scores[k] >= dc.SHARE - 1e-9}
        assert {k for k, _ in index.search(query)} == want


def test_leaks_equal_brute_force(spark, documents, odd_docs):
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF_DIR}/benchmark.parquet").collect()] + [(900, "three short words"), (901, ""), (902, None), (903, "a b c d e")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    rng = random.Random(2)
    filler = [f"z{i}" for i in range(500)]
    made = []
    for k, (_, t) in enumerate(items[:20]):
        w = t.split()
        for cut in (0, 2, 6):
            body = w[:len(w) // 3] + ["changed"] * bool(cut) + w[len(w) // 3 + cut:]
            made.append((5000 + 10 * k + cut, " ".join(rng.choices(filler, k=rng.randint(0, 300)) + body + rng.choices(filler, k=90)), "en", "s", 1, "x"))
    made.append((9000, "x three short words y A, B. c d E", "en", "s", 1, "x"))
    docs = odd_docs.filter("doc_id is not null").dropDuplicates(["doc_id"]).withColumn("doc_id", F.col("doc_id") + 7000).unionByName(spark.createDataFrame(made, odd_docs.schema)).select("doc_id", "text").unionByName(documents.select("doc_id", "text"))
    usable = [(i, t) for i, t in items if t]
    want = brute_leaks([(r.doc_id, r.text) for r in docs.collect()], usable, dc.Index(usable).span)
    got = {(r.doc_id, r.item_id) for r in dc.leaks(docs, bench).collect()}
    assert got == want and len(want) > 25 and (9000, 900) in got and (9000, 903) in got
    clean = dc.without_leaks(docs, bench)
    assert clean.columns == docs.columns
    assert {r.doc_id for r in clean.collect()} == {r.doc_id for r in docs.collect()} - {d for d, _ in want}


def test_leaks_in_blocks_of_items_and_pieces_of_text(spark, monkeypatch):
    items = [(i, " ".join(f"q{i}w{k}" for k in range(20))) for i in range(12)]
    bench = spark.createDataFrame(items, "item_id long, text string")
    long = " ".join(f"f{k}" for k in range(3000))
    docs = spark.createDataFrame([(i, f"{long[: 997 * i]} {t} {long}") for i, t in items] + [(50, None), (None, items[3][1])], "doc_id long, text string")
    monkeypatch.setattr(dc, "PIECE_CHARS", 300)
    blocks = list(dc.item_blocks(bench, 5))
    assert sorted(i for b, _ in blocks for i, _ in b) == list(range(12)) and len(blocks) == 3
    monkeypatch.setattr(dc, "ITEMS_AT_ONCE", 5)
    assert {(r.doc_id, r.item_id) for r in dc.leaks(docs, bench).collect()} == {(i, i) for i in range(12)} | {(None, 3)}
    assert dc.leaks(docs.limit(0), bench).count() == 0 and dc.leaks(docs, bench.limit(0)).count() == 0


@pytest.mark.parametrize("at_once", [30, 5])
def test_blocks_of_items_change_no_result(spark, documents, monkeypatch, at_once):
    bench = spark.read.parquet(f"{SF_DIR}/benchmark.parquet").limit(60).unionByName(spark.createDataFrame([(900, "three short words"), (901, ""), (902, "a b")], "item_id long, text string"))
    docs = documents.select("doc_id", "text").unionByName(spark.createDataFrame([(9000, "x three short words y"), (9001, "the a b c")], "doc_id long, text string"))

    def retrieved():
        """Every (text, item, score) that any passage retrieves, whether it leaks or not."""
        out = set()
        texts = [(r.doc_id, dc.WORD.findall((r.text or "").lower())) for r in docs.limit(80).collect()]
        for items, statistics in dc.item_blocks(bench):
            index = dc.Index(items, statistics)
            for doc_id, words in texts:
                for a in range(0, len(words), index.span):
                    terms = sorted({index.terms[w] for w in words[a:a + 2 * index.span] if w in index.terms})
                    out |= {(doc_id, a, index.ids[k], round(s, 9)) for k, s in index.search(terms)}
        return out

    leaks = lambda: {(r.doc_id, r.item_id, round(r.score, 9)) for r in dc.leaks(docs, bench).collect()}
    whole, found = retrieved(), leaks()
    monkeypatch.setattr(dc, "ITEMS_AT_ONCE", at_once)
    assert retrieved() == whole and leaks() == found and len(whole) > 2 and (9000, 900) in {f[:2] for f in found}


BAD = ["grumbleworth", "snarkface", "vexatious"]


def toxic_rows(n, seed):
    rng = random.Random(seed)
    syllables = ["an", "the", "ion", "er", "ti", "re", "on", "sh", "ou", "en", "le", "mi"]
    rows = []
    for i in range(n):
        w = ["".join(rng.choices(syllables, k=rng.randint(1, 4))) for _ in range(rng.randint(30, 200))]
        bad = i % 6 == 0
        if bad:
            for _ in range(rng.randint(2, 6)):
                w.insert(rng.randrange(len(w)), rng.choice(BAD))
        rows.append((" ".join(w), int(bad)))
    return rows


def test_compression_distance_separates_held_out_documents():
    model = toxicity.fit(toxic_rows(700, 1))
    import pyarrow as pa

    held = toxic_rows(200, 2)
    out = next(toxicity.scorer(model)(iter([pa.RecordBatch.from_pydict({"text": [t for t, _ in held]})])))
    right = sum((s >= 0.5) == bool(y) for s, (_, y) in zip(out.column("score").to_pylist(), held, strict=True))
    assert right >= 195


def test_fit_holds_little_more_than_its_texts():
    import tracemalloc

    rows = toxic_rows(1200, 5)
    tracemalloc.start()
    toxicity.fit(rows)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 12 * sum(len(t) for t, _ in rows)


def test_fit_counts_documents_of_telling_sequences():
    rows, coded = toxic_rows(60, 7), toxicity.Coded()
    seen = [(coded.code(t), k) for t, k in rows]
    of = lambda t: set().union(*(toxicity.sequences(w, 7) for w in toxicity.plain_words(t)))
    plain = [toxicity.Counter(s for t, y in rows if y == k for s in of(t)) for k in (0, 1)]
    assert toxicity.document_counts(seen, coded, 7, 2) == {s: [plain[0][s], c] for s, c in plain[1].items() if c >= 2}
    whole = b"".join(f" {' '.join(toxicity.plain_words(t))} ".encode() for t, k in rows if not k)
    assert all(toxicity.last_bytes([w for w, k in seen if not k], coded, n) == whole[-n:] for n in (1, 500, len(whole) + 9))


def test_toxic_documents_of_all_languages_are_found(spark):
    sf = "/root/testdata/sf0.1"
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang")
    rows = toxicity.op4_toxicity(spark, sf).filter("held_out").join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").join(docs, "doc_id").collect()
    scores, labels = np.array([r.score for r in rows]), np.array([r.toxic for r in rows])
    order = np.argsort(scores, kind="stable")
    rank = np.empty(len(rows))
    rank[order] = np.arange(1, len(rows) + 1)
    positive = labels.sum()
    assert (rank[labels == 1].sum() - positive * (positive + 1) / 2) / (positive * (len(rows) - positive)) >= 0.94
    for lang in ("en", "de", "fr"):
        found = [r.predicted for r in rows if r.toxic and r.lang == lang]
        assert len(found) >= 15 and sum(found) >= 0.8 * len(found)
    assert sum(r.predicted for r in rows if not r.toxic) <= 0.03 * sum(1 for r in rows if not r.toxic)


def test_dictionaries_share_their_ordinary_text():
    part = toxicity.toxic_part(toxicity.Counter({" idiot ": 9, " loser": 4}))
    assert len(part) % 24 == 0 and {part.find(b" idiot ", k) % 3 for k in range(len(part)) if part.find(b" idiot ", k) >= 0} == {0, 1, 2}
    ordinary = " ".join(f"word{i % 97} other{i % 31}" for i in range(4000)).encode()
    distance = toxicity.Distance(part, ordinary[-toxicity.ORDINARY_BYTES:])
    plain, toxic = (toxicity.windows(f"word3 other4 {w} word5 other6 word7".split()) for w in ("word9", "idiot"))
    assert (distance(plain) <= 0).all() and distance(toxic).max() >= 2
    assert toxicity.windows([]) == [] and len(toxicity.windows(["a"] * 6)) == 1 and len(toxicity.windows(["a"] * 7)) == 2


def test_toxicity_of_odd_rows(spark, odd_docs, no_docs):
    labels = spark.createDataFrame([(i, i % 2, 1) for i in range(8)] + [(None, 1, 1), (3, None, None)], "doc_id long, toxic int, quality int")
    model = toxicity.fit_from(odd_docs, labels)
    out = toxicity.score_documents(odd_docs, model)
    rows = out.collect()
    assert len(rows) == odd_docs.count() and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in rows)
    assert toxicity.score_documents(no_docs, model).count() == 0
    none = toxicity.fit_from(odd_docs, labels.limit(0))
    assert {r.predicted for r in toxicity.score_documents(odd_docs, none).collect()} == {0}
    kept = toxicity.without_toxic(odd_docs, none)
    assert kept.columns == odd_docs.columns and sorted(map(str, kept.collect())) == sorted(map(str, odd_docs.collect()))


def test_toxicity_query_learns_nothing_from_held_out_labels(spark):
    import zlib

    out = toxicity.op4_toxicity(spark, SF_DIR).collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in out)
    docs, labels = (spark.read.parquet(f"{SF_DIR}/{t}.parquet") for t in ("documents", "labels"))
    turned = labels.withColumn("toxic", F.when(toxicity.held_out(F.col("doc_id")), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    assert toxicity.fit_from(docs, labels) == toxicity.fit_from(docs, turned)


def rake(cells, targets, sweeps):
    """Plain raking of {(source, lang, topic): tokens}."""
    total = sum(cells.values())
    goals = []
    for d, name in enumerate(mixing.DIMENSIONS):
        sums = {}
        for c, n in cells.items():
            sums[c[d]] = sums.get(c[d], 0) + n
        named = sum(targets[name].get(v, 0) for v, n in sums.items() if v != "other" and n > 0)
        rest = total - sums.get("other", 0)
        goals.append({v: n if v == "other" else rest * targets[name].get(v, 0) / named if n > 0 and named else 0 for v, n in sums.items()})
    f = dict.fromkeys(cells, 1.0)
    for _ in range(sweeps):
        for d in range(3):
            now = {}
            for c in cells:
                now[c[d]] = now.get(c[d], 0) + cells[c] * f[c]
            f = {c: f[c] * goals[d][c[d]] / now[c[d]] if now[c[d]] > 0 else f[c] for c in cells}
    return f


def test_raked_shares_meet_the_targets(spark):
    rng = random.Random(3)
    targets = {"source": {"a": 0.5, "b": 0.5, "gone": 0.3}, "lang": {"en": 0.7, "de": 0.3}, "topic": {"prose": 0.9, "contact": 0.1}}
    rows = [(i, "w " * rng.randint(1, 30) + ("@" if rng.random() < 0.3 else ""), rng.choice("aaabc"), rng.choice(["en", "de", "de", None]), "x") for i in range(2000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string, topic string")
    out = mixing.mix(docs, targets).collect()
    cells = {}
    for r in out:
        key = (r._source, r._lang, r._topic)
        cells[key] = cells.get(key, 0) + len(r.text.split())
    factor = rake(cells, targets, mixing.SWEEPS)
    top = max(factor.values())
    assert all(abs(r._probability - factor[(r._source, r._lang, r._topic)] / top) < 1e-9 for r in out)
    kept = mixing.sampled(docs, targets=targets)
    assert kept.columns == docs.columns and 0 < kept.count() < 2000
    weight = sum(len(r.text.split()) * r._probability for r in out)
    en = sum(len(r.text.split()) * r._probability for r in out if r._lang == "en")
    other = sum(len(r.text.split()) * r._probability for r in out if r._lang == "other")
    assert abs(en / (weight - other) - 0.7) < 1e-3


def test_mixing_of_odd_rows(spark, odd_docs, no_docs):
    out = mixing.mix(odd_docs)
    assert out.count() == odd_docs.count() and out.filter("_probability is null or _probability < 0 or _probability > 1").count() == 0
    assert mixing.mix(no_docs).count() == 0
    empty = odd_docs.withColumn("text", F.lit(None).cast("string"))
    assert mixing.sampled(empty).count() == odd_docs.count()


if __name__ == "__main__":
    pytest.main([__file__])
