"""Mixing sources to target weights by a splitting tree of exact block quotas.

Every source lays its documents out in a permuted order, twice over; the mix
takes the first ``target`` words of that line.  The line is cut into blocks, and
a binary tree splits each source's number of blocks among output shards: what
goes left at a node is a multivariate hypergeometric draw, so a shard looks like
a fair sample of the whole mix and all quotas are met exactly.  A shard then
draws its blocks, which no other shard has, and shuffles its documents.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cartolake.llm.common import WORD, materialize
from cartolake.operators.skew import group_rank

WEIGHTS = (3.0, 1.0, 2.0)
SHARE = 1.5
MOST_REPEATS = 2
BLOCK_WORDS = 4096
SHARD_BLOCKS = 256
SEED = 11
# Tree levels after which nodes are dealt to tasks.
SPREAD_LEVEL = 5


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def row_key(doc_id: Column, text: Column, seed: int = SEED) -> Column:
    """What a document's place in its source's permuted line depends on."""
    return F.xxhash64(F.lit(seed), doc_id, text)


def _uniform(*key: Column) -> Column:
    """A number in (0, 1) that depends on the key alone."""
    return (F.pmod(F.xxhash64(*key), F.lit((1 << 52) - 1)) + F.lit(0.5)) / F.lit(float((1 << 52) - 1))


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, which is evaluated once."""
    return F.transform(F.array(value), body)[0]


def hypergeometric(total: Column, marked: Column, drawn: Column, u: Column) -> Column:
    """How many of ``marked`` among ``total`` balls are among the ``drawn`` ones; ``u`` picks the quantile.

    Walks the distribution up to the quantile, by the ratio of neighbouring
    chances.  More than 12 standard deviations (and 60 steps) off the mode the
    chance is below what a double can tell from 0.
    """
    ratio = lambda k: (  # noqa: E731  p(k + 1) / p(k)
        (marked - k).cast("double") * (drawn - k) / ((k + 1).cast("double") * (total - marked - drawn + k + 1)))
    low = F.greatest(F.lit(0).cast("long"), drawn + marked - total)
    high = F.least(drawn, marked)
    peak = F.floor((drawn + 1).cast("double") * (marked + 1) / (total + 2))
    spread = F.ceil(F.lit(60.0) + F.lit(12.0) * F.sqrt(
        drawn.cast("double") * marked / total * (total - marked) / total * (total - drawn)
        / F.greatest(total - 1, F.lit(1).cast("long"))))
    none = F.array().cast("array<long>")
    start = F.struct(F.lit(1.0).alias("p"), F.lit(0.0).alias("sum"))
    to = lambda a, p: _let(p, lambda x: F.struct(x.alias("p"), (a["sum"] + x).alias("sum")))

    def within(span: Column) -> Column:
        below = F.aggregate(F.when(span["mode"] > span["first"], F.sequence(span["mode"] - 1, span["first"])).otherwise(none),
                            start, lambda a, k: to(a, a["p"] / ratio(k)))
        above = F.aggregate(F.when(span["last"] > span["mode"], F.sequence(span["mode"], span["last"] - 1)).otherwise(none),
                            start, lambda a, k: to(a, a["p"] * ratio(k)))
        sums = F.struct(below["p"].alias("p"), below["sum"].alias("below"), above["sum"].alias("above"))
        return _let(sums, lambda s: _let(
            F.struct(s["p"].alias("p"), (u * (1 + s["below"] + s["above"])).alias("goal")), lambda g: walk(span, g)))

    def walk(span: Column, goal: Column) -> Column:
        zero = F.struct(goal["p"].alias("p"), F.lit(0.0).alias("sum"), F.lit(0).cast("long").alias("k"))
        return F.aggregate(
            F.sequence(span["first"], span["last"]), zero,
            lambda a, k: F.struct((a["p"] * ratio(k)).alias("p"), (a["sum"] + a["p"]).alias("sum"), (
                a["k"] + F.when(a["sum"] + a["p"] < goal["goal"], 1).otherwise(0)).alias("k")),
            lambda a: F.least(span["last"], span["first"] + a["k"]))

    ends = F.struct(low.alias("low"), high.alias("high"), peak.alias("peak"), spread.alias("spread"))
    return _let(ends, lambda e: F.when(e["low"] >= e["high"], e["low"]).otherwise(_let(
        F.struct(F.least(e["high"], F.greatest(e["low"], e["peak"])).alias("mode"), e["low"].alias("low"),
                 e["high"].alias("high"), e["spread"].alias("spread")),
        lambda m: _let(F.struct(m["mode"].alias("mode"), F.greatest(m["low"], m["mode"] - m["spread"]).alias("first"),
                                F.least(m["high"], m["mode"] + m["spread"]).alias("last")), within))))


def split_quotas(counts: DataFrame, shards: int, seed: int = SEED) -> DataFrame:
    """(shard, rank, first, n): the blocks of each source that each shard gets.

    ``counts`` has (rank, n): the number of blocks of every source.  A node of the
    tree is one row with a list of its sources' blocks, so a level needs no
    shuffle; a list has one entry per source.
    """
    entry = F.struct("rank", F.lit(0).cast("long").alias("first"), F.col("n").cast("long").alias("n"))
    nodes = counts.groupBy().agg(F.sort_array(F.collect_list(entry)).alias("have")).select(
        F.lit(0).cast("long").alias("lo"), F.lit(shards).cast("long").alias("hi"), "have")
    blocks = F.aggregate("have", F.lit(0).cast("long"), lambda a, s: a + s["n"])
    for level in range(max(0, math.ceil(math.log2(shards)))):
        half = F.floor((F.col("lo") + F.col("hi")) / 2).cast("long")
        sized = nodes.withColumn("total", blocks).withColumn("mid", F.when(F.col("hi") - F.col("lo") > 1, half)
                                                             .otherwise(F.col("hi")))
        sized = sized.withColumn("left", F.expr("(total * (mid - lo)) div (hi - lo)"))
        state = F.struct(F.col("total").alias("total"), F.col("left").alias("left"),
                         F.array().cast("array<long>").alias("took"))

        def draw(a: Column, s: Column) -> Column:
            u = _uniform(F.lit(seed), F.lit(level), F.col("lo"), s["rank"])
            return _let(hypergeometric(a["total"], s["n"], a["left"], u), lambda n: F.struct(
                (a["total"] - s["n"]).alias("total"), (a["left"] - n).alias("left"),
                F.array_append(a["took"], n).alias("took")))

        drawn = sized.withColumn("took", F.aggregate("have", state, draw, lambda a: a["took"]))
        part = lambda first, n: F.filter(F.transform(F.arrays_zip("have", "took"), lambda z: F.struct(
            z["have"]["rank"].alias("rank"), first(z).alias("first"), n(z).alias("n"))), lambda s: s["n"] > 0)
        left = F.struct(F.col("lo"), F.col("mid").alias("hi"), part(
            lambda z: z["have"]["first"], lambda z: z["took"]).alias("have"))
        right = F.struct(F.col("mid").alias("lo"), F.col("hi"), part(
            lambda z: z["have"]["first"] + z["took"], lambda z: z["have"]["n"] - z["took"]).alias("have"))
        nodes = drawn.select(F.inline(F.array(left, right))).filter("lo < hi")
        # A new table every few levels keeps plans small and the tree's upper part drawn once.
        if level % SPREAD_LEVEL == SPREAD_LEVEL - 1:
            nodes = materialize(nodes.repartition("lo"), "quotas")
    return nodes.select(F.col("lo").alias("shard"), F.inline("have"))


def source_targets(sizes: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = SHARE,
                   most: float = MOST_REPEATS) -> DataFrame:
    """(source, rank, source_size, target) from (source, size): shares by weight, none above ``most`` times its size.

    Sources in code-point order, null last, take the weights in turn.  With
    sources ordered by capacity per weight, those before some point are full and
    the others share the rest in proportion; sums over that order find the point.
    """
    sources = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    cycle = F.array(*(F.lit(float(w)) for w in weights))
    ranked = group_rank(sources, [], [F.col("source").asc_nulls_last()], "rank")
    weighed = materialize(ranked.select(
        "source", "source_size", F.col("rank").cast("long").alias("rank"),
        cycle[F.pmod(F.col("rank") - 1, F.lit(len(weights))).cast("int")].alias("weight"))
        .withColumn("capacity", F.col("source_size") * F.lit(float(most))), "sources")
    total, weight = weighed.agg(F.sum("source_size"), F.sum("weight")).first()
    wanted = min(float(total or 0) * share, float(total or 0) * most)
    # Raise the level until no source above it is newly full; each pass is one aggregate over the sources.
    level, full = (wanted / weight if weight else 0.0), -1
    while weight:
        cap, left, n = weighed.agg(
            F.sum(F.when(F.col("capacity") < level * F.col("weight"), F.col("capacity")).otherwise(0.0)),
            F.sum(F.when(F.col("capacity") < level * F.col("weight"), 0.0).otherwise(F.col("weight"))),
            F.count_if(F.col("capacity") < level * F.col("weight"))).first()
        if n == full or not left:
            break
        full, level = n, (wanted - cap) / left
    return weighed.select("source", "rank", "source_size", F.least(
        F.col("capacity"), F.col("weight") * F.lit(level)).alias("target"))


def mix(docs: DataFrame, *, weights: Sequence[float] = WEIGHTS, share: float = SHARE, most: int = MOST_REPEATS,
        block_words: int = BLOCK_WORDS, shard_blocks: int = SHARD_BLOCKS, seed: int = SEED) -> tuple[DataFrame, DataFrame]:
    """(documents, pieces) of a mix in which sources weigh ``weights`` and total ``share`` times the input.

    ``documents`` has a row per input row: doc_id, source, size (words), source_size,
    target (of its source), taken.  ``pieces`` has a row per copy taken: doc_id,
    source, size, copy (from 0), words (the first so many of the copy; less than
    size only where a source's quota ends), shard and position in the shard.  A
    row is taken at most ``most`` times whole.  The taken words of a source are its
    target rounded to a word.

    A null text has no words and takes no part, nor does an empty one; a null
    source is a source.  Rows with equal id, source and size are interchangeable.
    An empty table gives two empty tables.  Other columns are ignored.
    """
    sized = materialize(docs.select(
        "doc_id", "source", word_count(F.col("text")).alias("size"),
        row_key(F.col("doc_id"), F.col("text"), seed).alias("key")), "sizes")
    targets = materialize(source_targets(sized, weights, share, most), "targets")
    rows = sized.count()
    # The place of a document in its source's line: sums over slices of the key's range, then inside a slice.
    # Both groups have about the square root of the rows.
    slices = max(1, math.isqrt(rows))
    sliced = sized.withColumn("slice", F.pmod(F.col("key"), F.lit(slices)))
    held = sliced.groupBy("source", "slice").agg(F.sum("size").alias("words"))
    before = Window.partitionBy("source").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    starts = held.select(
        F.col("source").alias("s"), F.col("slice").alias("l"),
        F.coalesce(F.sum("words").over(before), F.lit(0)).alias("slice_start"))
    starts = starts.join(targets, F.col("s").eqNullSafe(F.col("source"))).drop("source")
    inside = Window.partitionBy("source", "slice").orderBy("key", "doc_id", "size").rowsBetween(
        Window.unboundedPreceding, -1)
    placed = sliced.withColumn("inside", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    lines = placed.join(starts, F.col("source").eqNullSafe(F.col("s")) & (F.col("slice") == F.col("l"))).select(
        "doc_id", "source", "size", "key", "rank", "source_size", "target",
        (F.col("slice_start") + F.col("inside")).alias("start"))
    lines = materialize(lines, "lines")
    copies = F.transform(F.sequence(F.lit(0), F.lit(most - 1)), lambda c: F.struct(
        c.alias("copy"), (F.col("start") + c * F.col("source_size")).alias("at"),
        F.least(F.col("size"), F.greatest(F.lit(0).cast("long"), F.round("target").cast("long") - F.col("start")
                                          - c * F.col("source_size"))).alias("words")))
    drawn = lines.select("doc_id", "source", "size", "key", "rank", "start", F.inline(
        F.filter(copies, lambda p: p["words"] > 0)))
    quotas = targets.select("rank", F.ceil(F.round("target") / F.lit(block_words)).cast("long").alias("n")).filter("n > 0")
    total = quotas.agg(F.sum("n")).first()[0] or 0
    owned = split_quotas(quotas, max(1, -(-total // shard_blocks)), seed)
    blocks = owned.select(F.col("rank").alias("r"), "shard", F.explode(F.sequence(
        F.col("first"), F.col("first") + F.col("n") - 1)).alias("b"))
    shuffled = Window.partitionBy("shard").orderBy("order", "doc_id", "copy")
    pieces = materialize(
        drawn.withColumn("block", F.floor(F.col("at") / F.lit(block_words)))
        .join(blocks, (F.col("rank") == F.col("r")) & (F.col("block") == F.col("b")))
        .withColumn("order", F.xxhash64(F.lit(seed + 1), "key", "copy", "shard"))
        .select("doc_id", "source", "size", "key", "rank", "start", "copy", "words", "shard",
                F.row_number().over(shuffled).cast("long").alias("position")), "pieces")
    # A document with words is the only one at its place in its source's line.
    took = pieces.groupBy(F.col("rank").alias("r"), F.col("start").alias("s")).agg(F.sum("words").alias("words"))
    documents = lines.join(took, (F.col("rank") == F.col("r")) & (F.col("start") == F.col("s")) & (F.col("size") > 0), "left")
    return documents.select(
        "doc_id", "source", "size", "source_size", "target", F.coalesce("words", F.lit(0)).cast("long").alias("taken"),
    ), pieces
