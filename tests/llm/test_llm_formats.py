"""Chat formatting, ranked search and fill-in-the-middle against plain versions of their rules and hand-made cases."""

from __future__ import annotations

import hashlib
import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from llm import chat_format, fill_in_middle, lexical_search
from llm.fill_in_middle import Frames

HARD = ["<", "[", "\\", "/", "s>", "INST]", "SYS]", "ROLE]", "/INST]", "a"]


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def test_escaping_is_reversible_and_leaves_no_mark():
    random.seed(5)
    for _ in range(20000):
        text = "".join(random.choices(HARD, k=random.randint(0, 12)))
        shown = chat_format.escape(text)
        assert chat_format.unescape(shown) == text
        assert not any(m in shown for m in chat_format.MARKS)


CHATS = [(1, 0, "system", "Be <s> kind"), (1, 1, "user", None), (1, 2, "assistant", ""), (1, 3, "assistant", "[/INST] é😀\n "),
         (2, 5, "user", "later"), (2, -1, "tool", "first </s>"), (2, None, None, "no turn"), (2, 7, "[ROLE]", "odd"),
         (3, 1, "assistant", "same"), (3, 1, "assistant", "same"), (None, 1, "assistant", "no id"), (None, 2, "user", "none either"),
         (4, 1, "assistant", "word " * 40000 + "\\" * 3000 + "z" * 70000), (4, 2, "user", "\n" * 5000)]


def plain_chats(rows):
    out = {}
    for conv in {r[0] for r in rows}:
        turns = sorted((r for r in rows if r[0] == conv), key=lambda r: (r[1] is not None, r[1] or 0, r[2] or ""))
        learned = "".join(r[3] or "" for r in turns if r[2] == "assistant")
        out[conv] = (len(turns), sha("".join(f"{r[2] or ''}\n{r[3] or ''}\n" for r in turns)), len(learned), sha(learned))
    return out


@pytest.mark.parametrize("piece", [1 << 20, 4])
def test_chats_read_back_from_ids(spark, monkeypatch, piece):
    monkeypatch.setattr(chat_format, "PIECE_IDS", piece)
    rows = spark.createDataFrame([(*r, "x", 1) for r in CHATS], "conv_id long, turn long, role string, text string, ids string, piece int")
    found = chat_format.read_back(chat_format.format_chats(rows), in_order=True).collect()
    assert {r[0]: tuple(r)[1:5] for r in found} == plain_chats(CHATS)
    again = chat_format.read_back(chat_format.format_chats(rows)).collect()
    assert sorted(map(str, again)) == sorted(map(str, found))
    assert chat_format.format_chats(rows.limit(0)).count() == 0


def test_chat_ids_hold_the_template_and_no_mark_of_a_text(spark):
    rows = spark.createDataFrame([(9, 1, "user", chat_format.CONTROL), (9, 2, "assistant", chat_format.CONTROL)],
                                 "conv_id long, turn long, role string, text string")
    held = chat_format.format_chats(rows).collect()[0]
    with open(chat_format.TOKENIZER, "rb") as source:
        own = chat_format.coder(source.read(), chat_format.PATTERN)
    marks = {i: m for m, i in own.ids.items()}
    assert [marks[i] for i in held["ids"] if i in marks] == ["<s>", "[INST]", "</s>", "<s>", "[/INST]", "</s>"]
    learned = np.array(held["ids"], np.int32)[np.array(held["loss_mask"])]
    assert chat_format.unescape(own.text(learned)) == chat_format.CONTROL
    assert held["n_turns"] == 2 and len(held["ids"]) == len(held["loss_mask"])


TERM = re.compile("[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain_ranks(docs, items, k=10):
    said = [(i, TERM.findall((t or "").translate(LOWER))) for i, t in docs]
    said = [(i, w) for i, w in said if w]
    n_docs, length = len(said), sum(len(w) for _, w in said)
    df = Counter(t for _, w in said for t in set(w))
    out = []
    for item, text in items:
        asked, scores = Counter(TERM.findall((text or "").translate(LOWER))), []
        for doc, words in said:
            tf, m = Counter(words), 25 + 75 * len(words) * n_docs // length
            score = sum(c * math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10 ** 9 * tf[t] // (1000 * tf[t] + 8 * m))
                        for t, c in asked.items() if tf[t])
            if score:
                scores.append((-score, doc is None, doc or 0))
        out += [(item, r + 1, None if none else doc, -score) for r, (score, none, doc) in enumerate(sorted(scores)[:k])]
    return sorted(out, key=str)


def searched(spark, docs, items, **given):
    rows = spark.createDataFrame([(*d, 0, "x") for d in docs], "doc_id long, text string, score int, key string").repartition(3)
    asked = spark.createDataFrame([(*i, 0, "x") for i in items], "item_id long, text string, rank int, key string")
    return sorted(map(tuple, lexical_search.search(rows, asked, **given).collect()), key=str)


DOCS = [(1, "The cat, the CAT & thé Äpfel"), (2, None), (3, ""), (4, " !?"), (None, "cat without id"), (None, "cat without id"),
        (5, "cat"), (7, "cat"), (6, "cat"), (6, "cat"), (8, "a1_b2 ÄPFEL äpfel " * 30), (9, "dog " * 60000 + "x" * 70000 + " bird"),
        *[(i, "bird song " * (i % 7) + "same words here") for i in range(20, 60)]]
ITEMS = [(1, "Cat cat bird"), (2, None), (3, ""), (4, "unheard"), (1, "Cat cat bird"), (None, "äpfel same DOG"), (5, "same " * 3000 + "x" * 70000)]


def test_ranks_equal_brute_force(spark, monkeypatch):
    want = plain_ranks(DOCS, ITEMS)
    assert searched(spark, DOCS, ITEMS) == want
    monkeypatch.setattr(lexical_search, "DOCS", 3)
    monkeypatch.setattr(lexical_search, "PART", 50)
    monkeypatch.setattr(lexical_search, "WAVE_BYTES", 1 << 15)
    assert searched(spark, DOCS, ITEMS) == want
    assert searched(spark, DOCS, ITEMS, k=3) == plain_ranks(DOCS, ITEMS, 3)
    assert searched(spark, DOCS[1:4], ITEMS) == searched(spark, [], ITEMS) == searched(spark, DOCS, []) == []


def test_blocks_stay_below_the_limit_and_add_up():
    held = lexical_search.Items.of([(str(i), f"a b{i} " + "c " * (40 * i)) for i in range(30)])
    w = np.arange(1, len(held.vocabulary) + 1) * 700
    for limit in (10 ** 11, 1 << 53):
        for tile in lexical_search.tiles(held, w, size=7, columns=4, limit=limit):
            total = np.zeros((len(tile.items), len(w)), np.int64)
            for columns, weighed in tile.blocks:
                assert len(columns) <= 4 and (weighed.sum(0) * lexical_search.IMPACT < limit).all()
                np.add.at(total.T, columns, weighed.astype(np.int64))
            for place, i in enumerate(tile.items):
                want = np.zeros(len(w), np.int64)
                for term, count in held.counts[i].items():
                    want[held.vocabulary[term]] = w[held.vocabulary[term]] * count
                assert (total[place] == want).all()


TEXTS = [(1, "one line"), (2, "a\nb\n\nc"), (3, "\n"), (4, None), (5, ""), (6, "has <M> inside\nand more"), (None, "no\nid"),
         (7, "twice\nthe\nsame\n"), (7, "twice\nthe\nsame\n"), (8, "é😀\n" * 50000 + "tail <"), (9, "x" * 200000), (10, "<\nS>\n<P"),
         *[(i, "l\n" * (i % 9) + "ü") for i in range(11, 80)]]


def plain_middle(doc, text):
    text = text or ""
    held = sha(f"7:{'' if doc is None else doc}")
    h = [int(held[i:i + 8], 16) for i in (0, 8, 16, 24)]
    units = re.findall(r"[^\n]*\n|[^\n]+", text)
    n = len(units)
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 100:
        return doc, n, "plain", None, None, sha(text), sha(text)
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    form = "spm" if h[3] % 100 < 50 else "psm"
    out = f"<S>{s}<P>{p}<M>{m}" if form == "spm" else f"<P>{p}<S>{s}<M>{m}"
    return doc, n, form, len(p), len(m), sha(out), sha(text)


@pytest.mark.parametrize("frame_bytes", [1 << 16, 5])
def test_fill_in_middle_equals_the_plain_rule(spark, frame_bytes):
    texts = [t for t in TEXTS if frame_bytes > 5 or len(t[1] or "") < 1000]
    rows = spark.createDataFrame([(*t, 1, "x", True) for t in texts], "doc_id long, text string, n int, form string, marked boolean")
    moved = fill_in_middle.transform(fill_in_middle.framed(rows, frame_bytes=frame_bytes))
    found = sorted((tuple(r) for r in fill_in_middle.digests(moved).collect()), key=str)
    assert found == sorted((plain_middle(*t) for t in texts), key=str)
    back = sorted((str((r["doc_id"], r["text"])) for r in fill_in_middle.texts(moved, back=True).collect()))
    assert back == sorted(str((i, t or "")) for i, t in texts)
    assert {sha(r["text"]) for r in fill_in_middle.texts(moved).collect()} == {r[5] for r in found}
    assert fill_in_middle.transform(fill_in_middle.framed(rows.limit(0))).count() == 0


def test_other_rates_and_orders(spark):
    rows = fill_in_middle.framed(spark.createDataFrame([(i, f"a\nb{i}\nc") for i in range(200)], "doc_id long, text string"))
    forms = Counter(r["form"] for r in fill_in_middle.transform(rows, rate=40, spm=100).collect())
    assert set(forms) == {"plain", "spm"} and 50 < forms["spm"] < 110


def test_frames_seek_without_the_others():
    data = ("é\n" * 300 + "end").encode()
    held = Frames()
    held.write(data, 64)
    assert b"".join(held.stream()) == data and held.size == len(data)
    lines = data.split(b"\n")
    for k in (0, 1, 31, 299, 300):
        assert held.after_line(k) == len(b"".join(x + b"\n" for x in lines[:k]))
    assert held.after_line(301) == len(data)
    assert held.code_points(held.after_line(150)) == 300
    assert held.find(b"end") == len(data) - 3 and held.find(b"no") == -1
    for mark in (b"\nend", b"\xa9\n\xc3"):
        assert held.find(mark) == data.find(mark)
    part = Frames()
    part.copy(held, 70, 500)
    assert b"".join(part.stream()) == data[70:500]
    assert sum(frame in held.frames for frame in part.frames) >= 5
