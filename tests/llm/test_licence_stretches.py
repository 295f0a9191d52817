"""Stretches of damaged licences against brute force over all stretches; long texts in time."""

import random
import time

import pytest
from pyspark.sql import functions as F

from vigilake.llm import licence_scan as ls
from vigilake.llm.licence_templates import BODIES, TEMPLATES


def brute(words, templates, dice):
    grams = [f"{a} {b}" for a, b in zip(words, words[1:], strict=False)]
    best = {}
    for k, (name, text) in enumerate(templates):
        t = set(ls.bigrams_of(text))
        for a in range(len(grams)):
            held, hits = set(), 0
            for b in range(a, len(grams)):
                if grams[b] not in held:
                    held.add(grams[b])
                    hits += grams[b] in t
                value = 2 * hits / (len(held) + len(t))
                if value >= dice and value > best.get(k, (0,))[0]:
                    best[k] = (value, a, b, name)
    found = list(best.values())
    return sorted((name, round(d, 9)) for d, a, b, name in found if not any(v[0] > d and v[1] <= b and a <= v[2] for v in found))


def found(spark, texts, templates, dice=ls.DICE):
    known, _, _ = ls.template_column(templates, dice)
    df = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(texts)], "i int, t string").repartition(4)
    hashes = ls.let(ls.words_in(F.col("t")), ls.bigram_hashes)
    out = df.select("i", ls.let(hashes, lambda h: ls.windows(h, known, templates, dice)).alias("m")).collect()
    return {r.i: sorted((x.licence, round(x.dice, 9)) for x in r.m) for r in out}


def test_stretches_equal_brute_force(spark):
    rng = random.Random(3)
    for trial in range(4):
        # Every word once, so no bigram stands twice.
        fresh = iter(f"w{trial}x{i}" for i in range(100000))
        bodies = [[next(fresh) for _ in range(rng.randint(6, 30))] for _ in range(4)]
        bodies.append(bodies[0][:-2] + [next(fresh), next(fresh)])
        templates = [(f"L{k}", " ".join(b)) for k, b in enumerate(bodies)]
        texts = []
        for _ in range(25):
            words = [next(fresh) for _ in range(rng.randint(0, 20))]
            for body in rng.sample(bodies[:4], rng.randint(0, 3)):
                words += [next(fresh) if rng.random() < 0.07 else w for w in body]
                words += [next(fresh) for _ in range(rng.choice([0, 1, 15]))]
            texts.append(words)
        got = found(spark, texts, templates)
        want = {i: brute(w, templates, ls.DICE) for i, w in enumerate(texts)}
        assert got == want and sum(map(bool, want.values())) > 5


def damaged(text, every=12):
    words = ls.normalised(text)
    return [f"zz{i}" if i % every == every - 1 else w for i, w in enumerate(words)]


def test_ten_damaged_licences_in_one_text_take_little_time(spark):
    long = sorted(BODIES, key=lambda t: -len(t[1]))
    chosen = (long * 3)[:10]
    text = " ".join(" ".join(damaged(t)) + " words between them" for _, t in chosen)
    df = spark.createDataFrame([(1, text)], "doc_id long, text string")
    query = ls.scan(df)
    query.collect()
    start = time.time()
    row = query.first()
    assert time.time() - start < 5 and len(text) > 190_000
    names = {x.licence for x in row.licences}
    assert {n for n, _ in chosen[: len(long)]} & names and all(x.dice >= ls.DICE for x in row.licences)
    # One copy, and the same licence many times in a row.
    one = {x.licence: x.dice for x in ls.scan(spark.createDataFrame([(1, " ".join(damaged(chosen[0][1])))], "doc_id long, text string")).first().licences}
    again = spark.createDataFrame([(1, " ".join(" ".join(damaged(chosen[0][1])) for _ in range(6)))], "doc_id long, text string")
    assert chosen[0][0] in one and chosen[0][0] in {x.licence for x in ls.scan(again).first().licences}


def test_the_table_finds_every_bigram():
    values = [ls.hashed(b) for _, t in TEMPLATES + BODIES for b in ls.bigrams_of(t)]
    table, bits = ls.cuckoo_table(sorted(set(values)))
    assert all(v in (table[ls.places_of(v, bits)[0]], table[ls.places_of(v, bits)[1]]) for v in values)


if __name__ == "__main__":
    pytest.main([__file__])
