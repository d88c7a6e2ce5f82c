"""Joins, searches and removals against brute force."""

from __future__ import annotations

import math
import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from llm import decontamination, jaccard_join, suffix_dedup, topk_search
from llm.texts import chunks
from llm.written import written

SCHEMA = "doc_id long, text string, key string, node long, score double"


def frame(spark, texts, ids=None):
    ids = range(len(texts)) if ids is None else ids
    return spark.createDataFrame([(i, t, "x", 1, 0.5) for i, t in zip(ids, texts, strict=True)], SCHEMA)


def some_texts(seed=1):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(300)]
    base = [[rng.choice(vocabulary) for _ in range(rng.randint(3, 90))] for _ in range(30)]
    texts = [" ".join(b) for b in base]
    for b in base[:20]:
        for _ in range(rng.randint(1, 4)):
            near = list(b)
            for _ in range(rng.randint(0, 3)):
                near[rng.randrange(len(near))] = rng.choice(vocabulary)
            texts.append(" ".join(near))
    return [*texts, None, "", " \t\n", "one two", "one  two", "été über ñandú au café noir"]


def brute_classes(ids, texts):
    sets = []
    for t in texts:
        w = (t or "").replace("\t", " ").replace("\n", " ").split(" ")
        w = [x for x in w if x]
        sets.append({tuple(w)} if 0 < len(w) < 5 else {tuple(w[i:i + 5]) for i in range(len(w) - 4)})
    n, label = len(sets), list(range(len(sets)))
    links = [0] * n
    for i in range(n):
        for j in range(n):
            if i != j and sets[i] and sets[j] and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                links[i] += 1
                a, b = label[i], label[j]
                label = [min(a, b) if x in (a, b) else x for x in label]
    return {ids[i]: (ids[label[i]], links[i]) for i in range(n)}


def test_join_finds_all_links_and_classes(spark):
    texts = some_texts()
    found = jaccard_join.classes(frame(spark, texts)).collect()
    assert {r["doc_id"]: (r["class_id"], r["n_links"]) for r in found} == brute_classes(list(range(len(texts))), texts)


def test_join_splits_large_nodes_and_cells(spark, monkeypatch):
    monkeypatch.setattr(jaccard_join, "SMALL", 8)
    monkeypatch.setattr(jaccard_join, "CELL_TEXTS", 16)
    rng = random.Random(2)
    body = [f"b{i}" for i in range(120)]
    near = [" ".join([*body[:k % 110], f"new{k}", *body[k % 110 + 1:]]) for k in range(60)]
    shared = " ".join(f"c{i}" for i in range(12))
    apart = [shared + " " + " ".join(f"u{k}x{rng.random()}" for _ in range(60)) for k in range(60)]
    texts = near + apart
    found = jaccard_join.classes(frame(spark, texts)).collect()
    assert {r["doc_id"]: (r["class_id"], r["n_links"]) for r in found} == brute_classes(list(range(len(texts))), texts)


def test_a_large_group_is_compared_about_once(spark, monkeypatch):
    """A group of near copies is in few leaves, whatever number of nodes it shares, and keeps all its links."""
    monkeypatch.setattr(jaccard_join, "SMALL", 40)
    monkeypatch.setattr(jaccard_join, "CELL_TEXTS", 50)
    rng = random.Random(5)
    plain = [f"w{i}" for i in range(200)]
    rows = []
    for i in range(120):
        spoken = list(plain)
        spoken[rng.randrange(200)] = f"own{i}"
        rows.append((i, " ".join(spoken)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    described = written(jaccard_join.described(docs, "text", jaccard_join.runs_needed()))
    texts = described.groupBy("text_id").agg(F.min("key").alias("key"), F.first("size").alias("size"),
                                             F.first("nodes").alias("nodes"), F.first("sketch").alias("sketch"))
    leaves = jaccard_join.leaves(docs, written(texts), "text").groupBy("node").count().collect()
    assert sum(r["count"] for r in leaves) < 6 * 120  # it shares more than 20 nodes
    found = jaccard_join.classes(docs).collect()
    assert {(r["class_id"], r["n_links"], r["n_texts"]) for r in found} == {(0, 119, 119)}


def test_texts_that_cannot_link_send_no_shingles(spark):
    """Texts that meet by a shared passage but are far from alike leave the leaves; near copies stay with all their links."""
    rng = random.Random(11)
    passage = [f"p{i}" for i in range(60)]
    texts = [" ".join([*passage, *(f"t{i}x{j}" for j in range(140))]) for i in range(60)]
    near = [t.rsplit(" ", 3)[0] + f" n{rng.random()}" for t in texts[:5]]
    docs = frame(spark, [*texts, *near]).select("doc_id", "text")
    described = written(jaccard_join.described(docs, "text", jaccard_join.runs_needed()))
    texts = written(described.withColumn("weight", F.lit(1)))
    leaves = jaccard_join.leaves(docs, texts, "text")
    assert leaves.select("key").distinct().count() > 60
    kept = jaccard_join.narrowed(leaves, texts)
    assert kept.select("key").distinct().count() == 10 and kept.count() <= 12
    assert {(r["n"], r["parts"]) for r in kept.groupBy("node").agg(F.first("n").alias("n"), F.count("*").alias("parts")).collect()} == {(2, 2)}
    found = {r["doc_id"]: (r["class_id"], r["n_links"]) for r in jaccard_join.classes(docs).collect()}
    assert found == {i: (i % 60, 1 if i % 60 < 5 else 0) for i in range(65)}


def test_narrowing_keeps_all_links():
    """Sets of all sizes, bitmaps of several widths, and a lower threshold: linked sets share a label."""
    rng = np.random.default_rng(3)
    sets = []
    for size in [1, 1, 2, 5, 6, *range(50, 80), *range(120, 140), 500, 600, 1020, 1024, 1030, 40_000, 41_000]:
        base = rng.integers(0, 1 << 63, size, dtype=np.int64).astype(np.uint64)
        sets.append(np.unique(base))
        for share in (0.02, 0.05, 0.1, 0.15, 0.3):
            left = base[:int(np.ceil(size * (1 - share)))]
            sets.append(np.unique(np.r_[left, rng.integers(0, 1 << 63, int(size * share / 2), dtype=np.int64).astype(np.uint64)]))
    sets.sort(key=len)
    sizes = np.array([len(s) for s in sets])
    common = jaccard_join._meet(sets, sets)
    for threshold in (0.8, 0.5):
        labels = jaccard_join.possible(sizes, [jaccard_join.parities(s) for s in sets], threshold)
        a, b = np.nonzero(common >= threshold * (sizes[:, None] + sizes[None, :] - common) - 1e-9)
        assert len(a) > 2 * len(sets) and (labels[a] == labels[b]).all()
        assert threshold < 0.8 or len(np.unique(labels)) > 40


def test_a_chunk_of_texts_is_described_as_one(monkeypatch):
    rng = random.Random(11)
    texts = [None, "", "one two", *(" ".join(rng.choice("abcd") for _ in range(rng.choice((0, 3, 5, 9, 40, 700)))) for _ in range(200)), " \n"]
    (chunk,) = chunks(pa.array(texts))
    sets = jaccard_join.shingle_sets(chunk)
    for text, found in zip(texts, sets, strict=True):
        words = (text or "").split()
        assert len(found) == (len({tuple(words[i:i + 5]) for i in range(len(words) - 4)}) if len(words) > 4 else min(len(words), 1))
        assert (found[1:] > found[:-1]).all()
    roots, calls, mix = [np.uint64(i + 1) for i in range(3)], [], jaccard_join.mixed
    expected = [(jaccard_join.fingerprint(s), len(s), [c for r in roots for c in jaccard_join.chosen(s, r).view(np.int64)],
                 list(jaccard_join.sketch(s)), jaccard_join.parities(s)) if len(s) else (None, 0, [], [], None) for s in sets]
    monkeypatch.setattr(jaccard_join, "mixed", lambda values: calls.append(len(values)) or mix(values))
    found = list(zip(*jaccard_join._descriptions(sets, roots), strict=True))
    assert [(a, n, list(nodes), list(told), bits) for a, n, nodes, told, bits in found] == expected
    assert len(calls) < 40  # however many texts the chunk has
    ids, sizes, nodes, told, bits = jaccard_join._descriptions([sets[0], sets[1]], roots)
    assert (ids, sizes, bits) == ([None] * 2, [0] * 2, [None] * 2) and not any(map(len, nodes + told))


def test_a_text_joins_few_nodes():
    """All that is written and shuffled grows with the nodes of a text; the runs still reach the recall."""
    assert jaccard_join.runs_needed() * jaccard_join.FAN < 14


def test_alike_nodes_are_found_in_one_pass(spark):
    """Near copies are alike; texts of no kinship and a node of two kinds are not. No row is joined to its node for that."""
    rng = random.Random(7)
    plain = rng.choices(range(1 << 16), k=jaccard_join.SKETCH)
    rows = []
    for i in range(400):
        near = list(plain)
        near[rng.randrange(len(near))] = rng.randrange(1 << 16)
        rows.append((i, 1, near))
        rows.append((i, 2, [rng.randrange(1 << 16) for _ in plain]))
        rows.append((i, 3, (plain, near[::-1])[i % 2]))
    nodes = spark.createDataFrame(rows, "key long, node long, sketch array<int>")
    found = jaccard_join._alike(nodes)
    assert "Join" not in found._jdf.queryExecution().executedPlan().toString()
    assert [r["node"] for r in found.collect()] == [1]


def test_one_document_of_each_class_stays(spark):
    texts = ["a b c d e f g h"] * 3 + ["something else that is quite long here", None, "", "a b c d e f g h"]
    docs = frame(spark, texts, [5, 4, 4, 7, 8, 9, None])
    kept = jaccard_join.one_each(docs)
    assert kept.columns == docs.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == [4, 7, 8, 9]
    assert jaccard_join.one_each(docs.limit(0)).count() == 0


def brute_removed(rows, length):
    seen, gone = set(), {}
    for i, (doc_id, text) in enumerate(rows):
        data = (text or "").encode()
        marks = bytearray(len(data))
        for p in range(len(data) - length + 1):
            piece = data[p:p + length]
            if piece in seen:
                marks[p:p + length] = b"\1" * length
            seen.add(piece)
        kept = bytes(c for c, m in zip(data, marks) if not m)
        spans = sum(1 for a, b in zip(b"\0" + marks, marks) if b and not a)
        gone[doc_id] = (len(data), sum(marks), spans, hashlib.sha256(kept).hexdigest())
    return gone


def test_map_of_repeated_seeds_lets_few_others_through(spark):
    """Seeds are least hashes, so their leading bits are nearly the same; the map must still tell them apart."""
    rng = random.Random(11)
    half = ["".join(rng.choice("abcdefgh") for _ in range(4000)) for _ in range(1500)]
    docs = frame(spark, [*half, *half[:750]])
    found = suffix_dedup.repeated_seeds(docs, "text", 100, 40)
    ranks = set()
    for chunk in suffix_dedup.chunks(pa.array(half[:750])):
        ranks |= set(suffix_dedup.segments(chunk, suffix_dedup.Rolling(chunk.data))[3].tolist())
    assert np.unpackbits(found).sum() > 0.99 * len(ranks)


def test_repeated_strings_go_from_all_but_their_first_place(spark):
    rng = random.Random(3)
    letters = "abcdeé"
    passages = ["".join(rng.choice(letters) for _ in range(rng.randint(95, 400))) for _ in range(6)]
    texts = []
    for _ in range(40):
        parts = [rng.choice(passages)[rng.randint(0, 30):] if rng.random() < 0.6 else
                 "".join(rng.choice(letters) for _ in range(rng.randint(0, 150))) for _ in range(rng.randint(0, 4))]
        texts.append("".join(parts))
    texts += ["ab" * 200, "xyz" * 100 + "ab" * 60, None, "", "short", "q" * 99, "q" * 100, "q" * 350]
    found = suffix_dedup.digests(frame(spark, texts)).collect()
    expected = brute_removed(list(enumerate(texts)), 100)
    assert {r["doc_id"]: tuple(r)[1:] for r in found} == expected


def test_cut_texts_keep_rows_and_columns(spark):
    passage = "".join(chr(97 + i * 7 % 26) for i in range(90)) + "é" * 40
    docs = frame(spark, [passage, "start " + passage + " end", None], [1, 2, 2])
    cut = suffix_dedup.cut_texts(docs)
    assert cut.columns == docs.columns
    assert sorted((r["doc_id"], r["text"] or "") for r in cut.collect()) == [(1, passage), (2, ""), (2, "start  end")]
    assert suffix_dedup.cut_texts(docs.limit(0)).count() == 0


def test_long_documents_are_cut_in_pieces(monkeypatch):
    from llm.texts import Chunk, Rolling
    rng = np.random.default_rng(4)
    data = rng.integers(97, 100, 3000).astype(np.uint8)
    chunk = Chunk(0, data, np.array([0, 3000]))
    whole = suffix_dedup.segments(chunk, Rolling(data))
    monkeypatch.setattr(suffix_dedup, "PIECE", 512)
    pieces = suffix_dedup.segments(chunk, Rolling(data))

    def by_start(found):
        return {p: int(a) for low, high, a in zip(*found[:3], strict=True) for p in range(low, high + 1)}

    assert by_start(whole) == by_start(pieces)


def brute_top(rows, k):
    valid = [(i, tuple(np.floor(64 * np.asarray(v, np.float64)).astype(int))) for i, v in rows
             if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for at, (i, q) in enumerate(valid):
        if i % 20 == 0:
            scores = sorted((-sum(a * b for a, b in zip(q, c)), j) for other, (j, c) in enumerate(valid) if other != at)
            out += [(i, n + 1, j, -s) for n, (s, j) in enumerate(scores[:k])]
    return sorted(out)


@pytest.mark.parametrize("few", [True, False])
def test_search_is_exact(spark, monkeypatch, few):
    monkeypatch.setattr(topk_search, "BLOCK", 32)
    monkeypatch.setattr(topk_search, "QUERY_BLOCK", 4)
    rng = np.random.default_rng(5)
    rows = [(i, rng.normal(size=6).round(2).tolist()) for i in range(12 if few else 200)]
    rows += [(300, None), (320, [1.0, None]), (340, [float("nan")] * 6), (360, [0.5, -1.0]), (380, []), (None, [1.0] * 6),
             (7, rows[7][1]), (400, rows[3][1]), (401, rows[3][1]), (0, rows[0][1]), (0, rows[0][1]), (20, rows[2][1]), (402, [float("inf")] * 6)]
    df = spark.createDataFrame([(i, v, 1, 0) for i, v in rows], "vec_id long, embedding array<double>, rank int, score long")
    found = topk_search.search(df, F.col("vec_id") % 20 == 0)
    assert sorted(tuple(r) for r in found.select("query_id", "rank", "vec_id", "score").collect()) == brute_top(rows, 20)
    assert topk_search.search(df.limit(0), F.col("vec_id") % 20 == 0).count() == 0


def brute_tiles(doc, item, k):
    used_d, used_i, covered = [False] * len(doc), [False] * len(item), 0
    while True:
        best = (0, 0, 0)
        for a in range(len(doc)):
            for b in range(len(item)):
                n = 0
                while a + n < len(doc) and b + n < len(item) and doc[a + n] == item[b + n] \
                        and not used_d[a + n] and not used_i[b + n]:
                    n += 1
                if n > best[0]:
                    best = (n, a, b)
        n, a, b = best
        if n < k:
            return covered
        covered += n
        used_d[a:a + n] = used_i[b:b + n] = [True] * n


def test_tiling_is_greedy_and_blind_to_order(spark):
    rng = random.Random(6)
    words = [f"v{i}" for i in range(40)]
    item = [rng.choice(words) for _ in range(40)]
    reordered = ["x1", *item[20:40], "x2", *item[0:20], "x3"]
    looped = item[:10] * 3 + item[5:25] + item[:12]
    clean = [f"z{i}" for i in range(50)]
    part = ["y", *item[:12], "y2"]
    docs = [item, reordered, looped, clean, part]
    texts = [" ".join(d) for d in docs]
    texts[0] = texts[0].upper().replace(" ", ", ")
    bench = spark.createDataFrame([(9, " ".join(item), "k"), (10, None, "k"), (11, "", "k"), (12, "v1 z3", "k")],
                                  "item_id long, text string, key string")
    found = decontamination.matches(frame(spark, [*texts, None, ""]), bench, coverage=0.01).where("item_id = 9")
    expected = {i: brute_tiles(d, item, 5) for i, d in enumerate(docs) if brute_tiles(d, item, 5)}
    assert {r["doc_id"]: r["covered"] for r in found.collect()} == expected
    kept = decontamination.clean(frame(spark, [*texts, None, ""]), bench)
    assert sorted(r["doc_id"] for r in kept.collect()) == [3, 4, 5, 6]
    assert decontamination.matches(frame(spark, texts), bench.limit(0)).count() == 0


def test_runs_reach_the_recall_for_subsets_at_the_deepest_level():
    missed = 0.0
    for _ in range(jaccard_join.MAX_DEPTH):
        missed = math.exp(-jaccard_join.FAN * jaccard_join.THRESHOLD * (1 - missed))
    assert 1 - missed ** jaccard_join.runs_needed() >= jaccard_join.RECALL
