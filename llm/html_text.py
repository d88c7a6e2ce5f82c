"""Main text of web pages by equivalence-class template deduction.

A page is parsed once into its containers and text blocks, which are written. Tokens of a host are its containers and
its block texts; a token's role is the path of labels above it, and tokens of one role that stand a fixed number of times in
each parent get roles of their own by position, until no class changes. Tokens that share their occurrence vector (the
same counts on the same pages, held as a sum of hashes) form a class; the tokens on LEAST_SHARE of the pages whose parents
are in nest to the template. A block text is the template's if it is on most pages, or is nearly all that its role ever holds,
beside LEAST_ARTICLES different articles. The main slot is the deepest container with most of the text that is left; in
it containers that hold only template texts, or are named as menus, adverts, comments and the like, and, in slots that hold
mostly links, blocks that are mostly links are left out. Words in class names are template words if many pages have them.

Edge cases: null html counts as empty and gives an empty text; pages without a usable url, or with fewer than LEAST_PAGES
pages on their host, are judged by their own structure, as are pages that lack the host's main slot. Unclosed and stray tags
are accepted, and nesting of any depth and very long pages take time in proportion to their length; repeated
rows and repeated or null ids count as pages of their own, and copies of one article are one article beside a text. An
empty table gives an empty one. Further columns, whatever their names, are ignored.
"""

from __future__ import annotations

import hashlib
import html
import re
from collections import defaultdict
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from llm.texts import released, small_batches, table
from llm.written import written

LEAST_PAGES = 3
LEAST_SHARE = 0.3
MOST_PAGES = 0.5
SAME_SHARE = 0.9
LEAST_ARTICLES = 3
MAIN_SHARE = 0.6
NAMED_SHARE = 0.3
SPARED_SHARE = 0.8
LINK_SHARE = 0.6
FLUSH = 100_000
STATE_BYTES = 8 << 20
SALTS = 32
_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s>/]*)((?:[^'\">]|\"[^\"]*\"|'[^']*')*+)>|</?[a-zA-Z!?][^>]*>",
                  re.S)
_NAMED = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_WORDS = re.compile(r"[a-z]+|[0-9]+")
RAW_TEXT = {"script", "style", "textarea", "title"}  # run to the end of the page if not closed
SKIPPED = {"noscript", "template", "svg", "iframe", "select", "button", "object"}  # left out only if closed in place
CONTAINERS = {
    "html", "head", "body", "div", "section", "article", "main", "nav", "header", "footer", "aside", "form", "ul",
    "ol", "dl", "table", "figure", "blockquote", "details", "fieldset", "center", "dialog", "menu",
}
BLOCKS = CONTAINERS | {
    "p", "h1", "h2", "h3", "h4", "h5", "h6", "li", "br", "hr", "tr", "td", "th", "dt", "dd", "pre", "address",
    "caption", "figcaption", "summary", "legend", "option",
}
CHROME_TAGS = {"nav", "footer", "aside", "form", "head", "menu", "dialog"}
CHROME_NAMES = {
    "ad", "ads", "adv", "advert", "adverts", "advertisement", "sponsor", "sponsored", "promo", "promotion", "banner",
    "nav", "navbar", "navigation", "menu", "breadcrumb", "breadcrumbs", "sidebar", "widget", "footer", "topbar",
    "toolbar", "cookie", "cookies", "consent", "notice", "notices", "gdpr", "popup", "modal", "overlay", "newsletter",
    "subscribe", "subscription", "signup", "login", "search", "share", "sharing", "social", "related", "recommended",
    "comment", "comments", "disqus", "replies", "reply", "respond", "pagination", "pager", "copyright", "contentinfo",
    "complementary", "alert",
}
HEADER_NAMES = {"header", "masthead"}
MAIN_TAGS = {"article", "main"}
LIST_TAGS = {"ul", "ol", "dl", "table", "blockquote", "figure"}


@lru_cache(1 << 16)
def _hash(text: str) -> int:
    return int.from_bytes(hashlib.blake2b(text.encode("utf-8", "replace"), digest_size=8).digest(), "big", signed=True)


def _label(tag: str, attributes: str) -> str:
    names = [next(filter(None, found), "") for found in _NAMED.findall(attributes)] if attributes else []
    words = sorted({w for name in names for w in _WORDS.findall(name.lower())})
    return f"{tag}.{'.'.join(words)}" if words else tag


def host_of(url: str | None) -> str | None:
    found = re.match(r"\s*[a-zA-Z][\w+.-]*://([^/?#\s]+)", url or "")
    return found[1].lower() if found else None


@dataclass
class Page:
    """Containers in page order (0 is the page itself) and text blocks with the container they stand in."""

    parent: list[int] = field(default_factory=lambda: [-1])
    label: list[str] = field(default_factory=lambda: [""])
    at: list[int] = field(default_factory=list)
    text: list[str] = field(default_factory=list)
    linked: list[int] = field(default_factory=list)


_BALANCE = re.compile(r"<(/?)(" + "|".join(sorted(CONTAINERS | {"button", "select", "object", "p"})) + r")\b[^>]*>", re.I)


@lru_cache(64)
def _end_tag(name: str) -> re.Pattern:
    return re.compile(rf"</{re.escape(name)}\b[^>]*>", re.I)


def _closed_in_place(inner: str, name: str) -> bool:
    """Whether what a skipped element holds closes no container that it did not open, nor opens its own kind."""
    depth: dict[str, int] = defaultdict(int)
    for tag in _BALANCE.finditer(inner):
        kind = tag[2].lower()
        if not tag[1] and (kind == name or kind == "p" and name in ("button", "select")):
            return False
        depth[kind] += -1 if tag[1] else 1
        if kind != "p" and depth[kind] < 0:
            return False
    return all(n <= 0 for kind, n in depth.items() if kind != "p")


def parse(page: str) -> Page:
    found = Page()
    stack: list[tuple[str, int]] = []
    opened: dict[str, int] = defaultdict(int)
    ends: dict[str, int] = {}  # where the next end tag of a kind is; len(page) if there is none any more
    pieces: list[str] = []
    linked = 0
    in_link = False

    def flush() -> None:
        nonlocal linked
        if pieces:
            text = " ".join(html.unescape("".join(pieces)).split())
            if text:
                found.at.append(stack[-1][1] if stack else 0)
                found.text.append(text)
                found.linked.append(min(linked, len(text)))
            pieces.clear()
        linked = 0

    at = 0
    while True:
        tag = _TAG.search(page, at)
        text = page[at:tag.start() if tag else len(page)]
        if text:
            pieces.append(text)
            if in_link:
                linked += len(text)
        if not tag:
            break
        at = tag.end()
        name = (tag[2] or "").lower()
        if not name:
            continue
        if tag[1]:
            if name in BLOCKS:
                flush()
            if name == "a":
                in_link = False
            if name in CONTAINERS and opened[name]:
                while True:
                    top = stack.pop()[0]
                    opened[top] -= 1
                    if top == name:
                        break
            continue
        if name in RAW_TEXT or name in SKIPPED:
            if tag[3].rstrip().endswith("/"):
                continue
            if ends.get(name, -1) < at:
                end = _end_tag(name).search(page, at)
                ends[name] = end.start() if end else len(page)
            stop = ends[name]
            if stop == len(page):
                at = len(page) if name in RAW_TEXT else at
            elif name in RAW_TEXT or _closed_in_place(page[at:stop], name):
                at = page.index(">", stop) + 1
            continue
        if name in BLOCKS:
            flush()
        if name == "body" and opened["head"]:  # a head that is not closed ends here
            stack[:] = [entry for entry in stack if entry[0] != "head"]
            opened["head"] = 0
        if name == "a":
            in_link = True
        elif name in CONTAINERS:
            found.parent.append(stack[-1][1] if stack else 0)
            found.label.append(_label(name, tag[3]))
            stack.append((name, len(found.parent) - 1))
            opened[name] += 1
            in_link = False
    flush()
    return found


@lru_cache(1 << 16)
def _cut(label: str, known: frozenset[str]) -> str:
    """The tag and those words of its names that many of the host's pages have."""
    tag, *words = label.split(".")
    return ".".join([tag, *(w for w in words if w in known)])


def roles(parent: list[int], label: list[str], known: frozenset[str], split: frozenset[int]) -> tuple[list[int], list[int], list[int]]:
    """Role, path without positions, and place among the parent's children of that path, of each container."""
    role, plain, place = [0], [0], [0]
    seen: dict[tuple[int, int], int] = defaultdict(int)
    for i in range(1, len(parent)):
        cut = _cut(label[i], known)
        base, path = _hash(f"{role[parent[i]]}/{cut}"), _hash(f"{plain[parent[i]]}/{cut}")
        seen[parent[i], base] += 1
        n = seen[parent[i], base]
        role.append(_hash(f"{base}#{n}") if base in split or path in split else base)
        plain.append(path)
        place.append(n)
    return role, plain, place


@lru_cache(1 << 16)
def _own_chrome(label: str) -> tuple[str, bool, bool]:
    """Tag, whether its names say it is not the article, and whether they say it is a header."""
    tag, *words = label.split(".")
    named = tag not in ("", "html", "body") and tag not in MAIN_TAGS
    return tag, named and not CHROME_NAMES.isdisjoint(words), named and not HEADER_NAMES.isdisjoint(words)


def chrome(parent: list[int], label: list[str], spared: set[int] | frozenset[int] = frozenset()) -> list[bool]:
    """Whether a container is, or stands in one, named as something other than the article. The names (not the
    tags) of ``spared`` containers do not count."""
    out, inside = [False], [False]
    for i in range(1, len(parent)):
        tag, named, header = _own_chrome(label[i])
        above, within = out[parent[i]], inside[parent[i]]
        own = tag in CHROME_TAGS or named and i not in spared
        own = own or not within and (tag == "header" or header and i not in spared)
        out.append(above or own)
        inside.append(within or tag in MAIN_TAGS)
    return out


def main_slot(parent: list[int], label: list[str], mass: list[float]) -> tuple[int, set[int], list[bool]]:
    """(main, spared, left out): the deepest container with MAIN_SHARE of the text in containers not left out, where one whose
    tag says it is the article goes first. Parents come before children. Names that would leave out the article, or nearly
    all the text, do not count: those containers are spared."""
    n = len(parent)
    every = set(range(n))
    by_tag = chrome(parent, label, every)
    below = [0.0 if out else m for m, out in zip(mass, by_tag, strict=True)]
    tagged = [label[i].split(".")[0] in MAIN_TAGS and not by_tag[i] for i in range(n)]
    holds = list(tagged)
    for i in range(n - 1, 0, -1):
        below[parent[i]] += below[i]
    article = any(t and b > 0 for t, b in zip(tagged, below, strict=True))
    for i in range(n - 1, 0, -1):
        holds[i] = holds[i] and below[i] > 0
        holds[parent[i]] = holds[parent[i]] or holds[i]
    spared = {i for i in every if (holds[i] if article else below[i] >= SPARED_SHARE * below[0] > 0)}
    out = chrome(parent, label, spared)
    left = [0.0 if o else m for m, o in zip(mass, out, strict=True)]
    depth = [0] * n
    for i in range(n - 1, 0, -1):
        left[parent[i]] += left[i]
    for i in range(1, n):
        depth[i] = depth[parent[i]] + 1
    total = left[0]
    if not total:
        return 0, spared, out
    named = [i for i in range(n) if tagged[i] and not out[i] and left[i] >= NAMED_SHARE * total]
    if named:
        return max(named, key=lambda i: (left[i], depth[i], -i)), spared, out
    best = 0
    for i in range(1, n):  # at most one child of the best has enough, since MAIN_SHARE is over a half
        if parent[i] == best and left[i] >= MAIN_SHARE * total and label[i].split(".")[0] not in LIST_TAGS:
            best = i
    return best, spared, out


def _within(parent: list[int], is_main: Callable[[int], bool]) -> list[bool]:
    inside = [is_main(0)]
    for i in range(1, len(parent)):
        inside.append(inside[parent[i]] or is_main(i))
    return inside


def text_alone(page: Page) -> str:
    """The article of a page by its own structure."""
    mass = [0.0] * len(page.parent)
    for at, text, linked in zip(page.at, page.text, page.linked, strict=True):
        mass[at] += len(text) - linked
    main, _, out = main_slot(page.parent, page.label, mass)
    inside = _within(page.parent, lambda i: i == main)
    return "\n".join(text for at, text in zip(page.at, page.text, strict=True) if inside[at] and not out[at])


@dataclass(frozen=True)
class Template:
    """What is known of a host: label words, roles split by position, the main role, roles whose names do not count, roles
    that hold mostly links, and its constant texts as hashes of (role, text)."""

    known: frozenset[str]
    split: frozenset[int]
    main: int | None
    spared: frozenset[int]
    linked: frozenset[int]
    texts: frozenset[int]


def _text_token(role: int, said: int) -> int:
    return _hash(f"{role}={said}")


def main_text(page: Page, host: Template | None = None) -> str:
    """The article of a page, given its host's template."""
    if host is None or host.main is None:
        return text_alone(page)
    role, _, _ = roles(page.parent, page.label, host.known, host.split)
    if host.main not in role:
        return text_alone(page)
    inside = _within(page.parent, lambda i: role[i] == host.main)
    spared = {i for i, r in enumerate(role) if r in host.spared or r == host.main}
    above: list[int] = [i for i in range(len(role)) if role[i] == host.main]
    while above:  # names over the main slot do not count either
        i = page.parent[above.pop()]
        if i >= 0 and i not in spared:
            spared.add(i)
            above.append(i)
    out = chrome(page.parent, page.label, spared)
    links = _within(page.parent, lambda i: inside[i] and role[i] in host.linked)
    varied = {at for at, text in zip(page.at, page.text, strict=True) if _text_token(role[at], _hash(text)) not in host.texts}
    mine = [(at, text) for at, text, linked in zip(page.at, page.text, page.linked, strict=True)
            if inside[at] and not out[at] and not (links[at] and linked > LINK_SHARE * len(text))]
    return "\n".join([text for at, text in mine if at in varied] or [text for _, text in mine])


def skeletons(pages: DataFrame, id_column: str = "page_id", url: str = "url", page: str = "html") -> DataFrame:
    """page_id, url, host, key, containers and blocks of each page: the one place where html is parsed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [parse(body or "") for body in batch.column(2).to_pylist()]
            hosts = [host_of(u) for u in batch.column(1).to_pylist()]
            keys = [_hash(f"{i}|{u}|{len(f.text)}|{f.text[:1]}") for i, u, f in zip(
                batch.column(0).to_pylist(), batch.column(1).to_pylist(), found, strict=True)]
            yield pa.RecordBatch.from_arrays([
                *batch.columns[:2], pa.array(hosts, pa.string()), pa.array(keys, pa.int64()),
                pa.array([f.parent for f in found], pa.list_(pa.int32())), pa.array([f.label for f in found], pa.list_(pa.string())),
                pa.array([f.at for f in found], pa.list_(pa.int32())), pa.array([[_hash(t) for t in f.text] for f in found], pa.list_(pa.int64())),
                pa.array([[len(t) for t in f.text] for f in found], pa.list_(pa.int32())),
                pa.array([f.linked for f in found], pa.list_(pa.int32())), pa.array([f.text for f in found], pa.list_(pa.string()))],
                ["page_id", "url", "host", "key", "parent", "label", "at", "said", "chars", "linked", "text"])

    small_batches(pages.sparkSession, 200)
    rows = pages.select(F.col(id_column).alias("page_id"), F.col(url).cast("string").alias("url"), F.col(page).cast("string").alias("page"))
    kind = rows.schema["page_id"].dataType.simpleString()
    return rows.mapInArrow(released(run), f"page_id {kind}, url string, host string, key long, parent array<int>, label array<string>, "
                                          "at array<int>, said array<long>, chars array<int>, linked array<int>, text array<string>")


def _sums(rows: DataFrame, count: Callable[[dict, Callable[[tuple, tuple], None]], None], keys: dict[str, pa.DataType],
          values: tuple[str, ...]) -> DataFrame:
    """Sums of ``values`` by host and ``keys``. ``count`` adds a page's; a task passes its sums on whenever it holds FLUSH of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple, list[int]] = {}

        def add(key: tuple, more: tuple) -> None:
            old = sums.get(key)
            sums[key] = list(more) if old is None else [a + b for a, b in zip(old, more, strict=True)]

        def passed() -> pa.RecordBatch:
            columns = [pa.array([k[i] for k in sums], kind) for i, kind in enumerate((pa.string(), *keys.values()))]
            columns += [pa.array([v[i] % (1 << 61) if n == "vector" else v[i] for v in sums.values()], pa.int64())
                        for i, n in enumerate(values)]
            sums.clear()
            return pa.RecordBatch.from_arrays(columns, ["host", *keys, *values])

        for batch in batches:
            for row in batch.to_pylist():
                count(row, add)
                if len(sums) > FLUSH:
                    yield passed()
        if sums:
            yield passed()

    kinds = ", ".join(f"{n} {'string' if k == pa.string() else 'long'}" for n, k in keys.items())
    parts = rows.mapInArrow(released(run), f"host string, {kinds}, " + ", ".join(f"{v} long" for v in values))
    totals = [(F.pmod(F.sum(F.col(v).cast("decimal(20,0)")), F.lit(1 << 61)).cast("long") if v == "vector" else F.sum(v)).alias(v)
              for v in values]
    return parts.groupBy("host", *keys).agg(*totals)


def _beside(rows: DataFrame, state: DataFrame) -> DataFrame:
    """Rows with their host's state: broadcast if it is measured small, else joined with hot hosts salted."""
    size = state.agg(F.sum(F.lit(200) + F.octet_length(F.to_json(F.struct("*"))))).first()[0] or 0
    state = state.withColumnRenamed("host", "__host")
    if size <= STATE_BYTES:
        return rows.join(F.broadcast(state), F.col("host") == F.col("__host")).drop("__host")
    salted = state.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return rows.withColumn("__at", F.pmod(F.xxhash64("key", "page_id"), F.lit(SALTS)).cast("int")).join(
        salted, (F.col("host") == F.col("__host")) & (F.col("__at") == F.col("__salt"))).drop("__host", "__salt", "__at")


def host_words(rows: DataFrame) -> DataFrame:
    """host, host_pages, known: hosts of LEAST_PAGES pages or more and the label words on LEAST_SHARE of them."""

    def count(row: dict, add: Callable) -> None:
        words = {w for label in set(row["label"]) for w in label.split(".")[1:]}
        for word in ("", *words):
            add((row["host"], word), (1,))

    counted = _sums(rows.where("host is not null").select("host", "label"), count, {"word": pa.string()}, ("pages",))
    least = counted.where("word = ''").select("host", F.col("pages").alias("host_pages")).where(F.col("host_pages") >= LEAST_PAGES)
    return counted.join(least, "host").where(F.col("pages") >= LEAST_SHARE * F.col("host_pages")).groupBy("host", "host_pages").agg(
        F.sort_array(F.collect_list(F.when(F.col("word") != "", F.col("word")))).alias("known"))


def role_counts(rows: DataFrame, state: DataFrame) -> DataFrame:
    """Per (host, role): parent role, path and label; pages, occurrences, occurrence vector, parents that have it and the sum of
    the squares of its occurrences in each (equal counts give n * n = parents * squares). Only those on LEAST_SHARE of the
    pages, so that a host's are at most 1 / LEAST_SHARE pages' worth."""

    def count(row: dict, add: Callable) -> None:
        known, split = frozenset(row["known"]), frozenset(row["split"])
        parent, label = row["parent"], row["label"]
        role, plain, _ = roles(parent, label, known, split)
        times: dict[int, int] = defaultdict(int)
        in_parent: dict[tuple[int, int], int] = defaultdict(int)
        first: dict[int, int] = {}
        for i in range(1, len(parent)):
            times[role[i]] += 1
            in_parent[parent[i], role[i]] += 1
            first.setdefault(role[i], i)
        parents: dict[int, int] = defaultdict(int)
        squares: dict[int, int] = defaultdict(int)
        for (_, r), n in in_parent.items():
            parents[r] += 1
            squares[r] += n * n
        for r, n in times.items():
            i = first[r]
            vector = _hash(f"{row['key']}|{n}") % (1 << 61)
            add((row["host"], r, role[parent[i]], plain[i], _cut(label[i], known)), (1, n, vector, parents[r], squares[r]))

    counted = _sums(_beside(rows.select("host", "key", "page_id", "parent", "label"), state).drop("page_id"), count,
                    {"role": pa.int64(), "above": pa.int64(), "path": pa.int64(), "label": pa.string()},
                    ("pages", "n", "vector", "parents", "squares"))
    return counted.join(state.select("host", "host_pages"), "host").where(F.col("pages") >= LEAST_SHARE * F.col("host_pages"))


def split_roles(rows: DataFrame, state: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(state with ``split``, counts of the final roles): a role that stands k >= 2 times in each parent of its role is
    split by position, until there is none left."""
    state = written(state.withColumn("split", F.array().cast("array<long>")), "hosts")
    while True:
        counts = written(role_counts(rows, state), "roles")
        above = counts.select("host", F.col("role").alias("above"), F.col("n").alias("above_n"))
        pages = state.select("host", F.lit(0).cast("long").alias("above"), F.col("host_pages").alias("above_n"))
        fixed = counts.join(above.unionByName(pages), ["host", "above"]).where(
            (F.col("parents") == F.col("above_n")) & (F.col("n") > F.col("parents")) & (F.col("n") * F.col("n") == F.col("parents") * F.col("squares")))
        new = fixed.groupBy("host").agg(F.flatten(F.collect_list(F.array("role", "path"))).alias("new"))
        if new.limit(1).count() == 0:
            return state, counts
        state = written(state.join(new, "host", "left").withColumn(
            "split", F.array_union("split", F.coalesce("new", F.array().cast("array<long>")))).drop("new"), "hosts")


def _template(row: dict) -> Template:
    return Template(frozenset(row["known"]), frozenset(row["split"]), row.get("main"), frozenset(row.get("spared") or ()),
                    frozenset(row.get("links") or ()), frozenset(row.get("texts") or ()))


def text_counts(rows: DataFrame, state: DataFrame) -> DataFrame:
    """Per (host, role, text): pages, occurrences, characters and characters in links; with text 0 the sums of the role."""

    def count(row: dict, add: Callable) -> None:
        role, _, _ = roles(row["parent"], row["label"], frozenset(row["known"]), frozenset(row["split"]))
        seen: set[tuple[int, int]] = set()
        for at, said, chars, linked in zip(row["at"], row["said"], row["chars"], row["linked"], strict=True):
            token = (role[at], said)
            add((row["host"], *token), (int(token not in seen), 1, chars, linked))
            add((row["host"], role[at], 0), (0, 1, chars, linked))
            seen.add(token)

    held = rows.select("host", "key", "page_id", "parent", "label", "at", "said", "chars", "linked")
    return _sums(_beside(held, state).drop("page_id", "key"), count, {"role": pa.int64(), "said": pa.int64()},
                 ("pages", "n", "chars", "linked"))


def articles_beside(rows: DataFrame, state: DataFrame) -> DataFrame:
    """(host, role, said): the ``candidates`` that stand beside LEAST_ARTICLES different longest other blocks. A task passes on
    at most so many of a candidate's, so a hot host stays small."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        beside: dict[tuple[str, int, int], set[int]] = defaultdict(set)
        for batch in batches:
            for row in batch.to_pylist():
                open_ = {(c["role"], c["said"]) for c in row["candidates"]}
                role, _, _ = roles(row["parent"], row["label"], frozenset(row["known"]), frozenset(row["split"]))
                out = chrome(row["parent"], row["label"])
                here, best = set(), (0, 0)
                for at, said, chars, linked in zip(row["at"], row["said"], row["chars"], row["linked"], strict=True):
                    token = (role[at], said)
                    if token in open_:
                        here.add(token)
                    elif not out[at]:
                        best = max(best, (chars - linked, said))
                if best[0]:
                    for token in here:
                        mine = beside[(row["host"], *token)]
                        if len(mine) < LEAST_ARTICLES:
                            mine.add(best[1])
        held = [(*key, article) for key, every in beside.items() for article in every]
        yield pa.RecordBatch.from_arrays([pa.array([h[i] for h in held], kind) for i, kind in enumerate(
            (pa.string(), pa.int64(), pa.int64(), pa.int64()))], ["host", "role", "said", "article"])

    held = rows.select("host", "key", "page_id", "parent", "label", "at", "said", "chars", "linked")
    near = _beside(held, state.where(F.size("candidates") > 0)).drop("key", "page_id")
    found = near.mapInArrow(released(run), "host string, role long, said long, article long").distinct()
    return found.groupBy("host", "role", "said").count().where(F.col("count") >= LEAST_ARTICLES).drop("count")


def templates(rows: DataFrame) -> DataFrame:
    """Per host: label words, split roles, the main role and its path, roles whose names do not count or that hold mostly links,
    constant texts, and how many classes and tokens the template has."""
    state, counts = split_roles(rows, host_words(rows))
    said = written(text_counts(rows, state), "said")
    whole = said.where("said = 0").select("host", "role", F.col("n").alias("role_n"), F.col("chars").alias("role_chars"),
                                          F.col("linked").alias("role_linked"))
    near = said.where("said <> 0").join(state.select("host", "host_pages"), "host").where(
        F.col("pages") >= LEAST_SHARE * F.col("host_pages")).join(whole, ["host", "role"]).where(
        (F.col("pages") >= MOST_PAGES * F.col("host_pages")) | (F.col("n") >= SAME_SHARE * F.col("role_n")))
    near = written(near, "near")
    listed = near.groupBy("host").agg(F.collect_list(F.struct("role", "said")).alias("candidates"))
    asked = written(state.join(listed, "host"), "asked")
    constant = written(near.join(articles_beside(rows, asked), ["host", "role", "said"]), "constant")
    known = counts.join(whole, ["host", "role"], "left").join(
        constant.groupBy("host", "role").agg(F.sum(F.col("chars") - F.col("linked")).alias("same")), ["host", "role"], "left")
    tokens = known.fillna(0, ["role_chars", "role_linked", "same"])

    def nest(key: tuple, found: pd.DataFrame) -> pd.DataFrame:
        found = found.sort_values(["pages", "vector", "role"], ascending=[False, True, True])
        below: dict[int, list] = defaultdict(list)
        for row in found.itertuples():
            below[row.above].append(row)
        parent, label, role, mass, rows_, paths = [-1], [""], [0], [0.0], [None], [""]
        waiting = [(0, row) for row in reversed(below[0])]
        while waiting:  # a token is in the template if its parent is
            at, row = waiting.pop()
            parent.append(at)
            label.append(row.label)
            role.append(row.role)
            mass.append(float(row.role_chars - row.role_linked - row.same))
            rows_.append(row)
            paths.append(f"{paths[at]}/{row.label}" if len(paths[at]) < 500 else paths[at])
            waiting += [(len(parent) - 1, child) for child in reversed(below[row.role])]
        main, spared, _ = main_slot(parent, label, [max(m, 0.0) for m in mass])
        inside = _within(parent, lambda i: i == main)
        links = [role[i] for i in range(1, len(role)) if inside[i] and i != main and label[i].split(".")[0] not in MAIN_TAGS
                 and rows_[i].role_linked > LINK_SHARE * rows_[i].role_chars]
        classes = len({(r.vector, r.pages) for r in rows_[1:]})
        return pd.DataFrame({"host": [key[0]], "main": [role[main] if main else None], "path": [paths[main] or None],
                             "spared": [[role[i] for i in sorted(spared) if i]], "links": [links], "classes": [classes],
                             "tokens": [len(role) - 1]}).astype({"main": "Int64"})

    slots = tokens.select("host", "role", "above", "label", "pages", "vector", "role_chars", "role_linked", "same").groupBy(
        "host").applyInPandas(nest, "host string, main long, path string, spared array<long>, links array<long>, classes int, tokens int")
    token = F.struct("role", "said")
    texts = constant.groupBy("host").agg(F.collect_list(token).alias("texts"))
    return state.join(slots, "host").join(texts, "host", "left")


def extract(pages: DataFrame, id_column: str = "page_id", url: str = "url", page: str = "html") -> DataFrame:
    """id, url, host, text, path of the main slot and number of classes in the template of each page."""
    rows = written(skeletons(pages, id_column, url, page), "pages")
    known = written(templates(rows), "templates")
    small_batches(pages.sparkSession, 200)
    held = rows.drop("said", "chars")
    judged = _beside(held, known)
    alone = held.join(known.select(F.col("host").alias("__host")), F.col("host") == F.col("__host"), "left_anti")
    for name in ("known", "split", "main", "path", "spared", "links", "classes", "tokens", "texts", "host_pages"):
        alone = alone.withColumn(name, F.lit(None).cast(known.schema[name].dataType))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made: dict[str, Template] = {}
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                host = None
                if row["known"] is not None:
                    host = made.get(row["host"])
                    if host is None:
                        if len(made) > 1000:
                            made.clear()
                        row["texts"] = [_text_token(t["role"], t["said"]) for t in row["texts"] or ()]
                        host = made[row["host"]] = _template(row)
                out.append(main_text(Page(row["parent"], row["label"], row["at"], row["text"], row["linked"]), host))
            columns = [batch.column(batch.schema.names.index(n)) for n in ("page_id", "url", "host", "classes", "path")]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(out, pa.string())], ["page_id", "url", "host", "classes", "main", "text"])

    kind = rows.schema["page_id"].dataType.simpleString()
    form = f"page_id {kind}, url string, host string, classes int, main string, text string"
    joined = judged.select(*alone.columns).unionByName(alone)
    return joined.mapInArrow(released(run), form)


def op10_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    found = extract(table(spark, sf_dir, "pages"))
    return found.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"), "main")
