"""Mixing sources to target weights, in DataFrame operations only.

The words of each source are laid end to end and packed into blocks of ``block`` words (the
last one of a source may be shorter). Every output shard has a fixed number of slots; each slot
draws its source, so a shard's source counts are multinomial. Slots of a source drawn beyond its
quota are dealt to sources that were drawn too little. A source's slots, counted over all shards, map
through a pseudorandom permutation of its block indices (swap-or-not rounds, a bijection on any
range), a new one for each pass over the source; so in every pass each block is used once, and
blocks join by (source, index).

Targets share REACH of all words by weight; no target is above MOST_PASSES times its source,
and what is cut is shared again by weight until none is above.

All draws are hashes of positions, so reruns agree. Sources are what people configure: their
totals (one row a source, at most MAX_SOURCES, else an error) are the only rows that reach the
driver. A hot source is spread over hashed groups of GROUP_ROWS documents; running
totals go over group totals first.

Edge cases: a null or blank text has size 0 and is never taken; a null source is a source of
its own, ordered last; null and repeated ids and repeated rows are rows of their own; an empty
table gives an empty mix. Further columns are ignored.
"""

from __future__ import annotations

from fractions import Fraction

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from llm.texts import table
from llm.written import written

WEIGHTS = (5, 2, 1)
REACH = Fraction(3, 2)
MOST_PASSES = 2
BLOCK = 64
SHARD_SLOTS = 1024
SLOTS_A_TASK = 200_000
GROUP_ROWS = 1024
ROUNDS = 16
SEED = 20240607
MAX_SOURCES = 20_000
SPACE = "[\\x20\\x09-\\x0D]+"
BLANKS = " \t\n\x0b\x0c\r"


def word_count(text: str) -> Column:
    """Number of runs of characters other than the six white-space ones."""
    inner = F.btrim(F.col(text), F.lit(BLANKS))
    return F.when(F.coalesce(F.length(inner), F.lit(0)) == 0, F.lit(0)).otherwise(
        F.size(F.split(inner, SPACE))).cast("long")


def share_out(sizes: list[int], weights: list[int], reach: Fraction = REACH,
              most: int = MOST_PASSES) -> list[Fraction]:
    """Targets by weight of ``reach`` times all sizes, none above ``most`` times its size."""
    left, targets = reach * sum(sizes), [Fraction(0)] * len(sizes)
    by_limit = sorted(range(len(sizes)), key=lambda i: Fraction(most * sizes[i], weights[i]))
    weight = sum(weights)
    for i in by_limit:  # the source that meets its limit first goes first
        targets[i] = min(Fraction(most * sizes[i]), left * weights[i] / weight)
        left -= targets[i]
        weight -= weights[i]
    return targets


def quotas(sizes: list[int], targets: list[Fraction], block: int) -> tuple[list[int], list[int]]:
    """Blocks of each source, and how many slots its target stands for."""
    blocks = [-(-size // block) for size in sizes]
    return blocks, [round(t * n / s) if s else 0 for t, n, s in zip(targets, blocks, sizes, strict=True)]


def source_table(sized: DataFrame, block: int = BLOCK) -> DataFrame:
    """source, k (its place), source_size, target, blocks, quota."""
    spark = sized.sparkSession
    rows = sized.groupBy("source").agg(F.sum("size").alias("size")).limit(MAX_SOURCES + 1).collect()
    if len(rows) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources")
    rows = sorted(rows, key=lambda r: (r["source"] is None, (r["source"] or "").encode()))
    sizes = [r["size"] for r in rows]
    targets = share_out(sizes, [WEIGHTS[i % len(WEIGHTS)] for i in range(len(rows))])
    blocks, quota = quotas(sizes, targets, block)
    return spark.createDataFrame(
        [(r["source"], i, sizes[i], float(targets[i]), blocks[i], quota[i]) for i, r in enumerate(rows)],
        "source string, k int, source_size long, target double, blocks long, quota long")


def running(df: DataFrame, keys: list[str], order: str, value: str, name: str, span: int = 1024) -> DataFrame:
    """``name``: the sum of ``value`` in rows before this one of its keys. ``order`` is a whole number,
    unique in its keys; totals of ``span`` numbers each are added up first, so no task gets all rows of a key."""
    df = df.withColumn("__span", F.floor(F.col(order) / span))
    totals = df.groupBy(*keys, "__span").agg(F.sum(value).alias("__sum"))
    before = Window.partitionBy(*keys).orderBy("__span").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.withColumn("__before", F.coalesce(F.sum("__sum").over(before), F.lit(0))).drop("__sum")
    inner = Window.partitionBy(*keys, "__span").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return df.withColumn("__inner", F.coalesce(F.sum(value).over(inner), F.lit(0))).join(
        totals, [*keys, "__span"]).withColumn(name, F.col("__before") + F.col("__inner")).drop(
        "__span", "__before", "__inner")


def packed(sized: DataFrame, sources: DataFrame, rows: int) -> DataFrame:
    """``start``: where a document's words begin in its source's stream. Documents are ordered by
    a hash of their id, then by id, size and fingerprint."""
    group = F.pmod(F.xxhash64(F.lit(SEED), "doc_id", "size"), F.lit(max(1, rows // GROUP_ROWS)))
    held = sized.join(sources.select("source", "k"), sized["source"].eqNullSafe(sources["source"])).drop(
        sources["source"]).withColumn("__group", group)
    inner = Window.partitionBy("k", "__group").orderBy("doc_id", "size", "fingerprint")
    held = held.withColumn("__inner", F.sum("size").over(inner.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size"))
    totals = held.groupBy("k", "__group").agg(F.sum("size").alias("__sum"))
    offsets = running(totals, ["k"], "__group", "__sum", "__base")
    return held.join(offsets.drop("__sum"), ["k", "__group"]).withColumn(
        "start", F.col("__base") + F.col("__inner")).drop("__group", "__inner", "__base")


def _alias_table(quota: list[int]) -> list[tuple[int, float, int]]:
    """(source, chance to stay, other source) per column of Walker's method for drawing in proportion to ``quota``."""
    n, total = len(quota), sum(quota)
    heights = [Fraction(q * n, total) for q in quota]
    small = [i for i in range(n) if heights[i] < 1]
    large = [i for i in range(n) if heights[i] >= 1]
    out = [(i, 1.0, i) for i in range(n)]
    while small and large:
        s, big = small.pop(), large[-1]
        out[s] = (s, float(heights[s]), big)
        heights[big] -= 1 - heights[s]
        if heights[big] < 1:
            small.append(large.pop())
    return out


def drawn(sources: DataFrame) -> DataFrame:
    """(shard, k, first, n): a shard's slots of source ``k`` are the source's slots first to first + n - 1.
    Over all shards a source gets its quota exactly."""
    spark = sources.sparkSession
    quota = [r["quota"] for r in sources.select("k", "quota").orderBy("k").collect()]
    total = sum(quota)
    schema = "shard long, k int, first long, n long"
    if not total:
        return spark.createDataFrame([], schema)
    alias = spark.createDataFrame(_alias_table(quota), "j int, stay double, other int")
    chance = F.pmod(F.xxhash64(F.lit(SEED + 1), "id"), F.lit(1 << 40)) / F.lit(float(1 << 40))
    slots = spark.range(total).select(
        F.floor(F.col("id") / SHARD_SLOTS).alias("shard"), chance.alias("u"),
        F.pmod(F.xxhash64(F.lit(SEED), "id"), F.lit(len(quota))).cast("int").alias("j"))
    counts = slots.join(alias, "j").select(
        "shard", F.when(F.col("u") < F.col("stay"), F.col("j")).otherwise(F.col("other")).alias("k")
    ).groupBy("shard", "k").agg(F.count("*").alias("n"))
    counts = written(running(counts, ["k"], "shard", "n", "first"), "drawn")
    got = {r["k"]: r["n"] for r in counts.groupBy("k").agg(F.sum("n").alias("n")).collect()}
    ends, short, at = [], [], 0
    for k, wanted in enumerate(quota):
        if wanted > got.get(k, 0):
            at += wanted - got.get(k, 0)
            ends.append(at)
            short.append((k, wanted, at))
    limits = spark.createDataFrame([(k, q) for k, q in enumerate(quota)], "k int, quota long")
    held = counts.join(limits, "k").withColumn(
        "kept", F.greatest(F.lit(0), F.least("n", F.col("quota") - F.col("first"))))
    kept = held.where("kept > 0").select("shard", "k", "first", F.col("kept").alias("n"))
    if not short:
        return kept
    over = held.groupBy("shard").agg(F.sum(F.col("n") - F.col("kept")).alias("over")).where("over > 0")
    over = running(over.withColumn("one", F.lit(1)), ["one"], "shard", "over", "base")
    place = F.size(F.filter(F.array(*map(F.lit, ends)), lambda end: end <= F.col("e"))) + 1
    shorts = F.array(*(F.struct(F.lit(k).alias("k"), F.lit(q).alias("quota"), F.lit(end).alias("end"))
                       for k, q, end in short))
    dealt = over.select("shard", F.explode(F.sequence("base", F.col("base") + F.col("over") - 1)).alias("e")).select(
        "shard", "e", F.element_at(shorts, place).alias("to"))
    return kept.unionByName(dealt.select(
        "shard", F.col("to.k").alias("k"), (F.col("to.quota") - F.col("to.end") + F.col("e")).cast("long").alias("first"),
        F.lit(1).cast("long").alias("n")))


def permuted(x: Column, size: Column, *keys: Column) -> Column:
    """A pseudorandom bijection of 0 .. size - 1 that depends on the keys: in every round a value and
    its mirror about a hashed point swap or not, by a hash of the pair."""

    def turn(at: Column, i: Column) -> Column:
        mirror = F.pmod(F.pmod(F.xxhash64(F.lit(SEED + 2), i, *keys), size) - at, size)
        swap = F.xxhash64(F.lit(SEED + 3), i, *keys, F.greatest(at, mirror)).bitwiseAND(F.lit(1)) == 1
        return F.when(swap, mirror).otherwise(at)

    return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), x, turn)


def slots(sources: DataFrame) -> DataFrame:
    """(shard, k, t, block): every slot of the mix with the block it takes; ``t`` counts the source's slots."""
    sizes = sources.select("k", "blocks")
    drawn_slots = drawn(sources)
    total = sources.agg(F.sum("quota")).first()[0] or 0
    flat = drawn_slots.repartition(max(1, total // SLOTS_A_TASK), "shard").select("shard", "k", F.explode(F.sequence("first", F.col("first") + F.col("n") - 1)).alias("t"))
    return flat.join(sizes, "k").select("shard", "k", "t", permuted(
        F.pmod("t", "blocks"), F.col("blocks"), F.col("k"), F.floor(F.col("t") / F.col("blocks"))).alias("block"))


def pieces(held: DataFrame, block: int = BLOCK) -> DataFrame:
    """One row per block that a document has words in: ``block``, ``at`` (its first word there, from 0 in the
    document) and ``words``."""
    last = F.floor((F.col("start") + F.col("size") - 1) / block)
    spread = held.where("size > 0").select(
        "*", F.explode(F.sequence(F.floor(F.col("start") / block), last)).alias("block"))
    begin = F.greatest(F.col("start"), F.col("block") * block)
    end = F.least(F.col("start") + F.col("size"), (F.col("block") + 1) * block)
    return spread.withColumn("at", begin - F.col("start")).withColumn("words", end - begin)


def sized_documents(docs: DataFrame, text: str = "text") -> DataFrame:
    return docs.select("doc_id", F.col("source").cast("string").alias("source"), word_count(text).alias("size"),
                       F.xxhash64(text).alias("fingerprint"))


def layout(docs: DataFrame, block: int = BLOCK) -> tuple[DataFrame, DataFrame]:
    """(documents with k, size and start, sources): where all words lie in the streams."""
    sized = written(sized_documents(docs), "sized")
    sources = source_table(sized, block)
    return packed(sized, sources, sized.count()), sources


def taken(held: DataFrame, sources: DataFrame, block: int = BLOCK) -> DataFrame:
    """The documents with ``taken``, the words that the mix takes of them."""
    times = slots(sources).groupBy("k", "block").agg(F.count("*").alias("times"))
    used = pieces(held.select("k", "start", "size"), block).join(times, ["k", "block"]).groupBy("k", "start").agg(
        F.sum(F.col("words") * F.col("times")).alias("taken"))
    some, none = held.where("size > 0"), held.where("size = 0")
    return some.join(used, ["k", "start"], "left").unionByName(
        none.withColumn("taken", F.lit(0).cast("long"))).withColumn("taken", F.coalesce("taken", F.lit(0)))


def mix(docs: DataFrame, text: str = "text", block: int = BLOCK) -> DataFrame:
    """The mix itself: (shard, source, t, block, n_words, doc_ids, text), one row per slot. Words are parted by single
    spaces; a block that the mix takes twice has two rows."""
    keyed = docs.select("doc_id", F.col("source").cast("string").alias("source"), F.col(text).cast("string").alias("text"))
    keyed = keyed.withColumn("fingerprint", F.xxhash64("doc_id", "text"))
    sized = written(keyed.select("doc_id", "source", word_count("text").alias("size"), "fingerprint"), "sized")
    sources = source_table(sized, block)
    held = written(packed(sized, sources, sized.count()).where("size > 0"), "packed")
    spoken = held.join(keyed.select("fingerprint", "text").dropDuplicates(["fingerprint"]), "fingerprint").select(
        "k", "doc_id", "start", "size", F.split(F.btrim("text", F.lit(BLANKS)), SPACE).alias("spoken"))
    parts = pieces(spoken, block).select("k", "block", F.struct(
        (F.col("start") + F.col("at")).alias("at"), "doc_id", "words",
        F.array_join(F.slice("spoken", (F.col("at") + 1).cast("int"), F.col("words").cast("int")), " ").alias("said")
    ).alias("piece"))
    filled = parts.groupBy("k", "block").agg(F.sort_array(F.collect_list("piece")).alias("held"))  # at most ``block`` words
    taken_slots = slots(sources)
    return taken_slots.join(filled, ["k", "block"]).join(sources.select("k", "source"), "k").select(
        "shard", "source", "t", "block",
        F.aggregate("held", F.lit(0).cast("long"), lambda n, p: n + p["words"]).alias("n_words"),
        F.transform("held", lambda p: p["doc_id"]).alias("doc_ids"),
        F.array_join(F.transform("held", lambda p: p["said"]), " ").alias("text"))


def op4_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words taken of every document by a mix of 150 % of the words of all documents."""
    held, sources = layout(table(spark, sf_dir, "documents"))
    held = written(held, "packed")
    about = sources.select("k", "source_size", "target")
    return taken(held, sources).join(about, "k").select(
        "doc_id", "size", "source_size", "target", F.col("taken").cast("long").alias("taken"), "source")
