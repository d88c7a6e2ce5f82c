"""Mixing, page text and the pipeline against brute force and hand-made cases."""

from __future__ import annotations

import os
import re
import time
from collections import Counter, defaultdict
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from llm import html_text, mixing
from llm.written import written

SMALL = os.environ.get("LLM_SMALL_DIR", "/root/testdata/sf0.001")
tables = pytest.mark.skipif(not os.path.isdir(SMALL), reason="no test tables")
DOCS = "doc_id long, text string, source string, size long, k int, start long"
ROWS = [(1, "one two three", "a", 1, 1, 1), (2, None, "a", 1, 1, 1), (3, " \t\n", None, 1, 1, 1), (4, "x " * 900, None, 1, 1, 1),
        (None, "no id at all", "b", 1, 1, 1), (5, "same row", "b", 1, 1, 1), (5, "same row", "b", 1, 1, 1),
        (6, " odd space\x0bhere", "é", 1, 1, 1), *[(i, "w " * (i % 90), "abc"[i % 3], 1, 1, 1) for i in range(10, 200)]]


def reshared(sizes, weights):
    """Targets by the plain rule: share by weight, cut at twice the size, share the excess again."""
    target, free, left = [Fraction(0)] * len(sizes), set(range(len(sizes))), Fraction(3, 2) * sum(sizes)
    while free:
        weight = sum(weights[i] for i in free)
        over = [i for i in free if left * weights[i] / weight > 2 * sizes[i]]
        if not over:
            for i in free:
                target[i] = left * weights[i] / weight
            break
        for i in over:
            target[i] = Fraction(2 * sizes[i])
        left -= sum(target[i] for i in over)
        free -= set(over)
    return target


@pytest.mark.parametrize("sizes", [[100, 10, 5, 900], [1, 1, 1], [0, 7], [50], [0, 0], []])
def test_targets_are_shared_until_none_is_above(sizes):
    weights = [mixing.WEIGHTS[i % 3] for i in range(len(sizes))]
    assert mixing.share_out(sizes, weights) == reshared(sizes, weights)


@pytest.mark.parametrize("size", [1, 2, 7, 100])
def test_permutation_is_a_bijection(spark, size):
    rows = spark.range(size).select(mixing.permuted(F.col("id"), F.lit(size).cast("long"), F.lit(3), F.lit(1)).alias("p"))
    assert sorted(r["p"] for r in rows.collect()) == list(range(size))


def test_taken_words_follow_slots_blocks_and_targets(spark):
    docs = spark.createDataFrame(ROWS, DOCS)
    held, sources = mixing.layout(docs, block=16)
    held = written(held)
    found = mixing.taken(held, sources, block=16).collect()
    assert len(found) == len(ROWS)
    sizes = {i: len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, t, *_ in ROWS}
    assert all(r["size"] == sizes[r["doc_id"]] and r["taken"] <= 2 * r["size"] for r in found)
    times = Counter((r["k"], r["block"]) for r in mixing.slots(sources).collect())
    assert max(times.values()) <= 2
    assert Counter(r["k"] for r in mixing.slots(sources).collect()) == Counter(
        {r["k"]: r["quota"] for r in sources.collect() if r["quota"]})
    for r in found:
        words = [(r["k"], (r["start"] + i) // 16) for i in range(r["size"])]
        assert r["taken"] == sum(times[w] for w in words)
    by, target = defaultdict(int), {r["k"]: r["target"] for r in sources.collect()}
    for r in found:
        by[r["k"]] += r["taken"]
    assert all(abs(by[k] - target[k]) <= 2 * 16 for k in target)
    assert [r["source"] for r in sources.orderBy("k").collect()] == ["a", "b", "c", "é", None]
    again = mixing.taken(written(mixing.layout(docs, block=16)[0]), sources, block=16).collect()
    assert sorted(map(str, again)) == sorted(map(str, found))


def test_mix_rows_hold_the_words_of_their_documents(spark):
    docs = spark.createDataFrame(ROWS, DOCS)
    rows = mixing.mix(docs, block=16).collect()
    assert all(len(re.findall(r"[^\x20\x09-\x0D]+", r["text"])) == r["n_words"] <= 16 for r in rows)
    held, sources = mixing.layout(docs, block=16)
    assert sum(r["n_words"] for r in rows) == mixing.taken(written(held), sources, block=16).agg(F.sum("taken")).first()[0]
    assert mixing.mix(docs.limit(0)).count() == 0


PAGE = ("<!DOCTYPE html><html><head><title>T {n}</title><style>p{{x:1}}</style><script>var t='<p>no</p>';</script></head><body>"
        "<header><h1>Site</h1></header><nav><ul><li><a href='/'>Home</a></li></ul></nav><!-- ad -->{body}"
        "<div class='zq'>Always the same notice.</div><form><input><p>Search</p></form><footer>&copy; site</footer></body></html>")
ARTICLE = "<article><h1>Head {n}</h1><p>First &amp; <b>bo</b>ld {n}.\n  more<br>next<p>Unclosed {n}<ul><li>item {n}</ul>" \
          "<aside>aside</aside><div class='comments'><p>reader {n}</p></div></article>"
PLAIN = "<div id=content><p>Text {n} of the plain kind that is long enough.</p><p>Second {n}</p></div>" \
        "<div class=sidebar><p>Links</p></div>"


def test_pages_of_two_templates(spark):
    rows = [(i, f"http://one.net/{i}", PAGE.format(n=i, body=ARTICLE.format(n=i)), "x") for i in range(8)]
    rows += [(i, f"http://two.net/{i}", PAGE.format(n=i, body=PLAIN.format(n=i)), "x") for i in range(20, 28)]
    rows += [(50, "http://one.net/50", None, "x"), (51, None, "<p>Alone &lt;here&gt;", "x"), (52, "nonsense", "", "x"),
             (None, "http://one.net/q", PAGE.format(n=99, body=ARTICLE.format(n=99)), "x")]
    found = {r["page_id"]: r["text"] for r in html_text.extract(
        spark.createDataFrame(rows, "page_id long, url string, html string, main string")).collect()}
    for i in (*range(8), None):
        n = 99 if i is None else i
        assert found[i] == f"Head {n}\nFirst & bold {n}. more\nnext\nUnclosed {n}\nitem {n}"
    for i in range(20, 28):
        assert found[i] == f"Text {i} of the plain kind that is long enough.\nSecond {i}"
    assert (found[50], found[51], found[52]) == ("", "Alone <here>", "")


def test_repeated_article_text_is_kept(spark):
    page = PAGE.format(n=1, body=ARTICLE.format(n=1))
    rows = [(i, "http://copies.net/a", page) for i in range(5)]
    found = html_text.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert {r["text"] for r in found} == {"Head 1\nFirst & bold 1. more\nnext\nUnclosed 1\nitem 1"}


def test_lists_of_copied_articles_are_kept_beside_other_pages(spark):
    notice = "<section class=zq><p>The same words on each page.</p></section>"
    item = "<article><h1>Head {n}</h1><p>Article {n} says enough to be one of its own.</p>{more}</article>"
    listed = "<ul><li>first point</li><li>second point</li></ul>"
    links = "<div class=zx><p><a href='/a'>A link of page {n}</a></p>{more}</div>"
    rows = [(i, f"http://some.net/{i}", PAGE.format(n=1, body=item.format(n=1, more=listed + notice))) for i in range(3)]
    rows += [(i, f"http://some.net/{i}", PAGE.format(n=i, body=item.format(n=i, more=notice))) for i in range(3, 9)]
    rows += [(i, f"http://links.net/{i}", PAGE.format(n=i, body=item.format(n=i, more=links.format(
        n=i, more="<p>Plain.</p>" if i == 24 else "")))) for i in range(20, 28)]
    found = {r["page_id"]: r["text"] for r in html_text.extract(
        spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    for i in range(9):
        n = max(i, 1) if i > 2 else 1
        points = "\nfirst point\nsecond point" if i < 3 else ""
        assert found[i] == f"Head {n}\nArticle {n} says enough to be one of its own.{points}"
    for i in range(20, 28):
        assert found[i] == f"Head {i}\nArticle {i} says enough to be one of its own." + ("\nPlain." if i == 24 else "")


def _opaque(n, extra=""):
    """No telling tag or name; the menu and the notice are longer than the article, and position tells the parts."""
    return (f"<html><body><div><a href='/{n}'>Start</a> <a href='/b'>Other pages of this place and more of them</a></div>"
            f"<div class=k1>{'A long notice that each page of the place shows before anything else. ' * 6}</div>"
            f"<div class='k2 p{n}'><h1>Title {n}</h1><p>Words of page {n} only.</p>{extra}</div>"
            f"<div>{'Rights and remarks at the end of every page. ' * 5}</div></body></html>")


def test_template_finds_what_a_page_alone_does_not(spark):
    rows = [(i, f"https://Opaque.org/{i}", _opaque(i, "<p>Also here.</p>" if i == 3 else "")) for i in range(8)]
    rows += [(i, f"https://opaque.org/{i}", _opaque(3, "<p>Also here.</p>")) for i in (8, 9)]  # copies of one article
    found = html_text.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    for r in found:
        n = 3 if r["page_id"] in (3, 8, 9) else r["page_id"]
        assert r["text"] == f"Title {n}\nWords of page {n} only." + ("\nAlso here." if n == 3 else "")
        assert r["text"] != html_text.text_alone(html_text.parse(_opaque(n)))


def test_roles_by_position_equal_brute_force(spark):
    """Split roles and occurrence counts, against paths with positions made page by page."""
    pages = [(i, f"http://h.net/{i}", f"<div><div>a{i}</div><div><ul>{'<ul>x</ul>' * (i % 3)}</ul></div></div><div>z</div>") for i in range(6)]
    rows = written(html_text.skeletons(spark.createDataFrame(pages, "page_id long, url string, html string")))
    state, counts = html_text.split_roles(rows, html_text.host_words(rows))
    found = sorted((r["label"], r["pages"], r["n"]) for r in counts.collect())
    # two divs at the top and two in the first, each on six pages; one list, and inner lists that vary
    assert found == [("div", 6, 6)] * 4 + [("ul", 4, 6), ("ul", 6, 6)]
    assert state.count() == 1


def test_unclosed_elements_and_names_lose_no_article():
    alone = lambda body: html_text.text_alone(html_text.parse(body))
    article = "<article><p>One.</p>{}<p>Two.</p></article><footer>f</footer>"
    for tag in ("button", "object", "select", "svg", "template", "iframe", "noscript"):
        assert alone(article.format(f"<{tag}>")).split("\n") == ["One.", "Two."]
        assert alone(article.format(f"<{tag}>out</{tag}>")).split("\n") == ["One.", "Two."]
        assert alone(article.format(f"<{tag}>") + f"<{tag}>out</{tag}>").split("\n")[:2] == ["One.", "Two."]
    for wrapper in ('<div class="post comments-enabled">', '<article class="social search">', '<div id=sidebar-off>'):
        assert alone(f"<nav>n</nav>{wrapper}<p>All of the article.</p>") == "All of the article."
    assert alone("<article><p>Said.</p><div class=comments>Reply, longer than what was said.</div></article>") == "Said."


def test_deep_and_long_pages_take_linear_time():
    start = time.monotonic()
    for opening in ("<div>", "<div class='menu comments'>", "<button><div>", "<object>"):
        text = html_text.text_alone(html_text.parse(opening * 20_000 + "deep"))
        assert text == "deep"
    assert len(html_text.text_alone(html_text.parse("<p>word</p>" * 100_000)).split("\n")) == 100_000
    assert time.monotonic() - start < 20


def test_pages_without_rows_and_with_nulls(spark):
    empty = spark.createDataFrame([], "page_id long, url string, html string")
    assert html_text.extract(empty).collect() == []
    rows = [(None, None, None)] * 2 + [(1, "http://a.net/", None)] * 3
    found = html_text.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert len(found) == 5 and {r["text"] for r in found} == {""}


@tables
def test_pipeline_stages_keep_columns_and_only_drop_what_they_judge(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    counts = [docs.count()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        new = written(stage(spark, docs, SMALL), name)
        assert new.columns == docs.columns
        assert new.join(docs, "doc_id", "left_anti").count() == 0
        docs = new
        counts.append(docs.count())
    assert all(a >= b for a, b in zip(counts, counts[1:])) and counts[-1] > 0.5 * counts[0]
    mixed = corpus_pipeline.STAGES[-1][1](spark, docs, SMALL)
    ids = {r[0] for r in docs.select("doc_id").collect()}
    assert {i for r in mixed.select("doc_ids").collect() for i in r[0]} <= ids
