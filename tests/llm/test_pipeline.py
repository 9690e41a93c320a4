import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from kinforge.llm import quality, toxicity
from tests.llm.test_dedup import brute_repeats
from tests.llm.test_similar import brute_similar


@pytest.fixture(scope="module")
def stages(spark, sf, docs, tmp_path_factory):
    """The input and the result of each stage."""
    folder, out, now = tmp_path_factory.mktemp("pipeline"), [docs], docs
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, now, sf).write.parquet(str(folder / str(k)))
        now = spark.read.parquet(str(folder / str(k)))
        out.append(now.cache())
    return out


def by_id(df):
    return {r["doc_id"]: r for r in df.collect()}


def test_columns_and_order(stages, docs):
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality classifier", "toxicity", "simhash near-dedup", "substring dedup", "packing"]
    assert all(s.columns == docs.columns for s in stages[:5])


def test_filters(spark, sf, stages):
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    for k, module in ((0, quality), (1, toxicity)):
        want = 1 if module is quality else 0
        scores = {r["doc_id"]: r["predicted"] for r in module.scored(stages[k], labels).collect()}
        assert set(by_id(stages[k + 1])) == {i for i, p in scores.items() if p == want}


def test_near_dedup(stages):
    """Five-word shingles and a similarity of 0.8, by comparing all pairs."""
    before = [(r["doc_id"], r["text"]) for r in stages[2].collect()]
    assert set(by_id(stages[3])) == {i for i, c in brute_similar(before) if i == c}


def test_substring_dedup(stages):
    before, after = by_id(stages[3]), by_id(stages[4])
    removed = {i: n for i, _, n, _ in brute_repeats([(i, r["text"]) for i, r in before.items()])}
    assert set(before) == set(after)
    for i, n in removed.items():
        assert len(after[i]["text"].encode().split()) == len(before[i]["text"].encode().split()) - n
        assert n or after[i]["text"] == before[i]["text"]


def test_packing(stages):
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    parts = {}
    for r in stages[5].collect():
        parts.setdefault(r["doc_id"], []).append((r["start"], bytes(r["tokens"])))
    for i, r in by_id(stages[4]).items():
        ids = np.array([*library.encode(r["text"], add_special_tokens=False).ids, 0], "<u4").tobytes()
        assert zlib.crc32(b"".join(t for _, t in sorted(parts.pop(i)))) == zlib.crc32(ids)
    assert not parts


def test_run(spark, sf, stages):
    got = corpus_pipeline.run(spark, sf)
    assert got.count() == stages[5].count() and got.columns == stages[5].columns


def test_odd_rows(spark, sf, odd):
    now = odd
    for name, stage in corpus_pipeline.STAGES:
        now = stage(spark, now, sf)
        if name != "packing":
            assert now.columns == odd.columns
    assert now.count() >= 0
