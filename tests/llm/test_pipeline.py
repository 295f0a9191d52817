"""The pipeline against its stages done plainly."""

import hashlib
import os
import zlib

import numpy as np
import test_models as tm
import test_near_dedup as tn
import zstandard
from tokenizers import Tokenizer

import corpus_pipeline
from vigilake.llm import decontamination as dc
from vigilake.llm import mixing, token_files, toxicity

SF_DIR = os.environ.get("ORACLE_SF_DIR", "/root/testdata/sf0.001")


def plain_distances(words, model):
    """Of windows of six words, three apart, the last of which ends with the text: lengths under both dictionaries."""
    codecs = []
    for content in (model.ordinary, model.toxic + model.ordinary):
        dictionary = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        dictionary.precompute_compress(toxicity.LEVEL)
        codecs.append(zstandard.ZstdCompressor(level=toxicity.LEVEL, dict_data=dictionary, write_checksum=False, write_content_size=False, write_dict_id=False))
    out, at = [], 0
    while words and (at == 0 or at + 3 < len(words)):
        window = f" {' '.join(words[at:at + 6])} ".encode()
        out.append(len(codecs[0].compress(window)) - len(codecs[1].compress(window)))
        at += 3
    return np.array(out, dtype=np.int64)


def test_pipeline_equals_plain_stages(spark):
    docs, labels = (spark.read.parquet(f"{SF_DIR}/{t}.parquet") for t in ("documents", "labels"))
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF_DIR}/benchmark.parquet").collect()]
    rows = {r.doc_id: r for r in docs.collect()}
    # Toxicity: the model's own scores, one document at a time.
    model = toxicity.fit_from(docs, labels)
    left = []
    for d, r in rows.items():
        w = [x for x in (x.strip(toxicity.PUNCTUATION) for x in (r.text or "").lower().split()) if x]
        if np.dot(toxicity.features(plain_distances(w, model)), model.weights) < 0:
            left.append(d)
    groups = tn.brute([(d, rows[d].text) for d in left], 80)
    left = [d for d in left if groups[d][1] == d]
    leaky = {d for d, _ in tm.brute_leaks([(d, rows[d].text) for d in left], items, dc.Index(items).span)}
    left = [d for d in left if d not in leaky]
    # Mixing.
    cell = {}
    for d in left:
        r = rows[d]
        topic = next((n for n, signs in mixing.TOPICS if any(s in r.text for s in signs)), "prose")
        cell[d] = tuple(v if v in mixing.TARGETS[k] else "other" for k, v in zip(mixing.DIMENSIONS, (r.source, r.lang, topic), strict=True))
    cells = {}
    for d in left:
        cells[cell[d]] = cells.get(cell[d], 0) + len(tn.re.findall(r"[^\x20\x09-\x0D]+", rows[d].text))
    factor = tm.rake(cells, mixing.TARGETS, mixing.SWEEPS)
    top = max(factor.values())
    draw = lambda d: int(hashlib.md5(f"{mixing.SEED}:{d}".encode()).hexdigest()[:8], 16) / 2**32
    left = sorted(d for d in left if draw(d) < factor[cell[d]] / top)
    library, at, want = Tokenizer.from_file(token_files.default_vocabulary()), 0, []
    for d in left:
        ids = [*library.encode(rows[d].text, add_special_tokens=False).ids, token_files.END_ID]
        want.append((d, at, len(ids), zlib.crc32(np.array(ids, dtype="<u4").tobytes())))
        at += len(ids)
    assert sorted(tuple(r) for r in corpus_pipeline.run(spark, SF_DIR).collect()) == want
    assert 20 < len(want) < len(rows)


def test_stages_take_odd_rows(spark, odd_docs, no_docs):
    for docs in (odd_docs, no_docs):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, SF_DIR)
            if name == "token_files":
                assert out.columns == ["doc_id", "start", "n_tokens", "ids_crc32"] and out.count() == docs.count()
            else:
                assert out.columns == docs.columns and out.count() <= docs.count()
