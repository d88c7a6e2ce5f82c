"""Learned operators by held-out accuracy and against direct formulas; edge cases of each."""

from __future__ import annotations

import math
import os
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from llm import language_id, lm_scoring, quality, toxicity
from llm.texts import chunks, fold, words
from llm.written import written

FOLDER = os.environ.get("LLM_TEST_DIR", "/root/testdata/sf0.01")
tables = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")
DOCS = "doc_id long, text string, lang string, score double, held_out string"
ODD = [(1, "Hello there my good friend", "en", 1.0, ""), (2, None, "en", None, None), (3, "", "fr", 1.0, ""),
       (None, "bonjour mes amis", "fr", 1.0, ""), (4, " \n", "fr", 1.0, ""), (5, "123 !!", None, 1.0, ""),
       (6, "word " * 30000, "en", 1.0, ""), (7, "same row here", "en", 1.0, ""), (7, "same row here", "en", 1.0, "")]


def accuracy(spark, found, label):
    labels = spark.read.parquet(f"{FOLDER}/labels.parquet").select("doc_id", F.col(label).alias("y"))
    rows = found.where("held_out").join(labels, "doc_id").select("score", "predicted", "y").toPandas()
    good, bad = rows[rows.y == 1].score.to_numpy(), rows[rows.y == 0].score.to_numpy()
    auc = (good[:, None] > bad[None, :]).mean() + 0.5 * (good[:, None] == bad[None, :]).mean()
    return (rows.predicted == rows.y).mean(), auc


def test_chunks_and_words_of_odd_texts():
    texts = ["a  bb", None, "", "\tc\n", "d e"]
    for limit in (1, 4, 100):
        seen = []
        for chunk in chunks(pa.array(texts).slice(0, 5), limit):
            starts, ends, docs = words(chunk)
            seen += [(chunk.first + d, chunk.data[s:e].tobytes().decode()) for s, e, d in zip(starts, ends, docs)]
        assert seen == [(0, "a"), (0, "bb"), (3, "c"), (4, "d"), (4, "e")]


@tables
def test_language_of_held_out_documents(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    found = language_id.op2_language_id(spark, FOLDER).join(docs.select("doc_id", "lang"), "doc_id").where("held_out")
    assert found.select(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0] > 0.95


def test_language_mixture_and_odd_rows(spark):
    train = spark.createDataFrame([(i, t, lang) for i, (t, lang) in enumerate(
        [("the house and the garden with the tree", "en")] * 5 + [("das haus und der garten mit dem baum", "de")] * 5)],
        "doc_id long, text string, lang string")
    names, logs = language_id.learn(train)
    assert names == ["de", "en"]
    both = "the house and the garden with the tree " * 4 + "das haus und der garten mit dem baum " * 6
    rows = language_id.predict(spark.createDataFrame([*ODD, (8, both, None, 1.0, "")], DOCS), names, logs).collect()
    by = {r["doc_id"]: r for r in rows}
    assert len(rows) == 10 and by[8]["lang_pred"] == "de" and len(by[8]["mixture"]) == 2 and 0.4 < by[8]["score"] < 0.8
    assert all(by[i]["lang_pred"] == "und" and by[i]["score"] == 0 for i in (2, 3, 4, 5))
    names, logs = language_id.learn(train.limit(0))
    assert language_id.predict(train, names, logs).where("lang_pred <> 'und'").count() == 0


@tables
def test_toxicity_and_quality_of_held_out_documents(spark):
    right, auc = accuracy(spark, toxicity.op6_toxicity(spark, FOLDER), "toxic")
    assert right > 0.9 and auc > 0.85
    right, auc = accuracy(spark, quality.op9_quality(spark, FOLDER), "quality")
    assert right > 0.95 and auc > 0.95


def test_toxicity_learns_words_and_takes_odd_rows(spark):
    rows = [(i, ("you vile scum " if i % 3 == 0 else "a kind word ") + f"for {i} days", "en", 1.0, "") for i in range(300)]
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(300)] + [(1, None), (None, 1)], "doc_id long, toxic int")
    docs = spark.createDataFrame([(*r[:3], r[3], r[4]) for r in rows], DOCS)
    places, values = toxicity.learn(docs, labels)
    found = {r["doc_id"]: r["score"] for r in toxicity.score(docs, places, values).collect()}
    assert all((found[i] >= 0.5) == (i % 3 == 0) for i in range(300))
    odd = toxicity.score(spark.createDataFrame(ODD, DOCS), places, values).collect()
    assert len(odd) == len(ODD) and all(0 <= r["score"] <= 1 for r in odd)
    none = toxicity.learn(docs, labels.limit(0))
    assert {r["score"] for r in toxicity.score(docs, *none).collect()} == {0.5}
    kept = toxicity.clean(docs.union(spark.createDataFrame(ODD, DOCS)), labels)
    assert kept.columns == docs.columns and kept.where("text like '%scum%'").count() == 0


def test_clean_keeps_all_documents_without_labels(spark):
    docs = spark.createDataFrame(ODD, DOCS)
    labels = spark.createDataFrame([(1, None), (None, 1), (999, 1)], "doc_id long, toxic int")
    for none in (labels.limit(0), labels):
        assert sorted(map(str, toxicity.clean(docs, none).collect())) == sorted(map(str, docs.collect()))


def test_quality_discriminant_is_the_density_difference(spark):
    rng = np.random.default_rng(7)
    d = len(quality.STATISTICS)
    x = np.concatenate([rng.normal(0, 1, (200, d)), rng.normal(1, 2, (300, d))])
    y = np.repeat([0, 1], [200, 300])
    rows = spark.createDataFrame([(int(a), b.tolist()) for a, b in zip(y, x)], "y int, x array<double>")
    count, sums, squares = quality.moments(rows)
    assert count.tolist() == [200, 300] and np.allclose(sums[1], x[y == 1].sum(0))
    model = quality.discriminant(count, sums, squares)
    found = quality.score(rows, model).collect()
    raw = [np.cov(x[y == c].T, bias=True) for c in (0, 1)]
    pooled = (200 * raw[0] + 300 * raw[1]) / 500
    logs = []
    for c in (0, 1):
        s = (1 - quality.RIDGE) * ((1 - quality.POOLED) * raw[c] + quality.POOLED * pooled) + quality.RIDGE * np.diag(np.diag(pooled))
        gap = x - x[y == c].mean(0)
        logs.append(np.log(count[c] / 500) - 0.5 * np.linalg.slogdet(s)[1] - 0.5 * np.einsum("ij,jk,ik->i", gap, np.linalg.inv(s), gap))
    expected = sorted(1 / (1 + np.exp(-np.clip(logs[1] - logs[0], -35, 35))))
    assert np.allclose(sorted(r["score"] for r in found), expected, atol=1e-6)


def test_quality_takes_odd_rows(spark):
    docs = spark.createDataFrame(ODD, DOCS)
    rows = written(quality.described(docs))
    found = quality.score(rows, quality.learn(rows, spark.createDataFrame([], "doc_id long, quality int"))).collect()
    assert [r["score"] for r in found] == [0.5] * len(ODD)


def tokens_of(text):
    lower = (text or "").encode().translate(bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123))))
    return [*re.findall(rb"[^\x20\x09-\x0D]+", lower), b""]


@pytest.mark.parametrize("top", [1, 1 << 19])
def test_base_scores_follow_their_formula(spark, monkeypatch, top):
    monkeypatch.setattr(lm_scoring, "TOP_TOKENS", top)
    texts = [r[1] for r in ODD] + [f"common tail number {i % 7} and word{i}" for i in range(60)]
    ids = [r[0] for r in ODD] + list(range(100, 160))
    docs = spark.createDataFrame(list(zip(ids, texts)), "doc_id long, text string")
    found = lm_scoring.scores(docs.select("doc_id", "text", (fold("doc_id", 7) != 2).alias("teaches"))).collect()
    teaches = [zlib.crc32(("" if i is None else str(i)).encode()) % 7 != 2 for i in ids]
    counts = Counter(t for text, ok in zip(texts, teaches) if ok for t in tokens_of(text))
    total, distinct = sum(counts.values()), len(counts)
    expected = sorted((len(t), sum(counts[w] > 0 for w in t), total, round(sum(
        math.log10((counts[w] + 1) / (total + distinct + 1)) for w in t), 6)) for t in map(tokens_of, texts))
    assert sorted((r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6)) for r in found) == expected
    assert all(r["score"] < 0 for r in found)


def test_spelling_model_is_a_distribution_and_learns():
    model = lm_scoring.Model.empty()
    taught = pa.array([b"banana", b"bandana", b"cabana"] * 50, pa.binary())
    for _ in range(4):
        lm_scoring.learn_stretch(model, taught)
    stretch, seen = model.stretched()
    one_byte = pa.array([bytes([b]) for b in range(256) if b != lm_scoring.END_OF_TOKEN], pa.binary())
    total = (10 ** lm_scoring.log10_spelled(model, stretch, seen, one_byte)).sum()
    empty = 10 ** lm_scoring.log10_spelled(model, stretch, seen, pa.array([b""], pa.binary()))[0]
    assert total + empty <= 1 + 1e-3
    known, new = lm_scoring.log10_spelled(model, stretch, seen, pa.array([b"banana", b"qxzjkw"], pa.binary()))
    assert known > new + 3
    assert np.isclose(lm_scoring.blended(np.array([3.0]), np.array([-2.0]), 10, 4, 0.5)[0], math.log10(0.25 + 0.2 * 0.01))


def test_scores_follow_word_order_and_counters_grow(spark):
    rng = np.random.default_rng(5)
    vocabulary = [f"{a}{b}" for a in ("ka", "lo", "mi", "ne", "pu", "ra") for b in ("den", "fir", "gos", "hul", "tam")]
    after = {w: rng.choice(vocabulary, 2) for w in vocabulary}

    def fluent(n):
        said = [vocabulary[0]]
        while len(said) < n:
            said.append(str(rng.choice(after[said[-1]])))
        return said

    rows = [(i, " ".join(fluent(120)), True) for i in range(60)]
    for i in range(10):
        said = fluent(60)
        rows += [(100 + i, " ".join(said), False), (200 + i, " ".join(rng.permutation(said)), False)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, teaches boolean")
    found = {r["doc_id"]: r["score"] for r in lm_scoring.scores(docs).collect()}
    assert all(found[100 + i] > found[200 + i] + 10 for i in range(10))  # the same words in another order
    texts = rng.integers(97, 123, (3000, 100), np.uint8)
    streams = [lm_scoring.cells(texts[:n].ravel(), np.arange(n) * 100) for n in (300, 3000)]
    assert len(streams[1].keys) > 5 * len(streams[0].keys)  # no fixed number of places
    assert len(streams[1].keys) > lm_scoring.CONTEXTS * 1 << 17


def test_shards_answer_with_the_counts_of_all_chunks(spark, monkeypatch):
    monkeypatch.setattr(lm_scoring, "SHARD_BYTES", 40)
    monkeypatch.setattr(lm_scoring, "PIECE_BYTES", 60)
    texts = ["one two three", "two three one", "", "One  two", "three " * 9, "four"] * 3
    rows = spark.createDataFrame([(i, i % 4 == 3, t) for i, t in enumerate(texts)], "row long, held_out boolean, text string")
    streams = [" ".join([*t.lower().split(), ""]).encode() for t in texts]
    data, start = lm_scoring._spelled(pa.array([s for i, s in enumerate(streams) if i % 4 != 3], pa.binary()))
    whole = lm_scoring.cells(data, start)
    counts = whole.counted(np.ones(len(data)))
    found = lm_scoring.answered(lm_scoring.packed_chunks(rows), 400).collect()
    assert len(found) > 1 and sorted(i for r in found for i in r["rows"]) == list(range(len(texts)))
    for r in found:
        data, start = lm_scoring._spelled(pa.array([streams[i] for i in r["rows"]], pa.binary()))
        mine = lm_scoring.cells(data, start)
        assert (lm_scoring._unpacked(r["seen"]) == lm_scoring._seen(mine, whole.keys, counts)).all()


def test_inputs_lie_row_by_row():
    keys = np.arange(0, 5000, 7, dtype=np.uint64)
    for part in lm_scoring._inputs(lm_scoring.paths(keys, np.full(len(keys), 3)), 1):  # else every take of rows copies the array
        assert part.shape == (len(keys), 8) and part.flags.c_contiguous


def test_asked_cells_are_packed_and_come_back():
    rng = np.random.default_rng(9)
    context = np.sort(rng.integers(0, 1 << 56, 4000, np.uint64))
    byte = np.array([rng.choice(256, 3, replace=False) for _ in context], np.uint64)
    keys = np.unique((context[:, None] << np.uint64(8) | byte)[rng.random(byte.shape) < 0.5])
    counts = rng.choice([0, 1, 2, 70_000, (1 << 32) - 1], len(keys), p=[0.1, 0.6, 0.2, 0.05, 0.05]).astype(np.uint32)
    for some in (slice(None), slice(0, 1), slice(0, 0)):
        held = lm_scoring.packed_cells(keys[some], counts[some])
        found = lm_scoring.unpacked_cells(held)
        assert (found[0] == keys[some]).all() and (found[1] == counts[some]).all()
        assert [len(x) for x in found] == [len(keys[some])] * 2
    every = lm_scoring.packed_cells(keys, np.ones(len(keys), np.uint32))
    assert sum(len(x) for x in every.values() if isinstance(x, bytes)) < 7 * len(keys)  # 12 bytes as they are


def test_scoring_keeps_one_table_with_texts(spark, monkeypatch):
    kept = []
    monkeypatch.setattr(lm_scoring, "written", lambda df, name="table": kept.append(written(df, name)) or kept[-1])
    docs = spark.createDataFrame([(i, f"said {i} and word{i % 3}", i % 4 > 0) for i in range(40)], "doc_id long, text string, teaches boolean")
    found = lm_scoring.scores(docs)

    def there(df):
        path = spark._jvm.org.apache.hadoop.fs.Path(df.inputFiles()[0].rsplit("/", 1)[0])
        return path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path)

    assert sum(there(df) for df in kept if {"text", "texts"} & set(df.columns)) == 1
    assert found.count() == 40
