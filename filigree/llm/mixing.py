"""Mixing sources to target weights through a multivariate-hypergeometric splitting tree.

Every source is a stream: its documents in hash order, cut into blocks of equal
length in words.  A source's target gives whole passes over its blocks and a
remainder, which takes the first blocks of one more pass; so a source owns an
exact number of block draws.  A binary tree splits the draws of all sources
into output shards: at each node the left child takes half of the draws, their
split over the sources being a multivariate-hypergeometric draw (a chain of
univariate ones, by inversion outwards from the mode).  A leaf's share is a run
of its sources' draws, each pass over a source going through its blocks in a
keyed permutation of its own, so shards are disjoint; a shard is shuffled
locally by hash order.  All random numbers are hashes of (seed, node, source),
so reruns agree.  DataFrame functions only.

Defined cases: a null text has size 0 and is never taken; a null source is a
source of its own, last in order; a null key is a key like any other; repeated
rows and repeated keys are documents of their own, told apart by two hashes of
key, text and source and by a number among equal ones; sources without words
have target 0; an empty table gives an empty mix; columns of any other name are
carried along untouched.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import WORD, let, written


@dataclass(frozen=True)
class Mix:
    weights: tuple[float, ...] = (5.0, 2.0, 1.0)
    most: int = 3
    block_words: int = 4096
    bucket_words: int = 1 << 16
    #: Buckets of one range, whose words are summed first.
    range_buckets: int = 1024
    shard_blocks: int = 512
    least_depth: int = 4
    #: Partitions of the mix at most; beyond them a partition holds a run of shards.
    most_parts: int = 1 << 15
    seed: int = 20


def words_in(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def uniform(*parts: Column) -> Column:
    """A number in (0, 1) that the parts alone decide."""
    return (F.pmod(F.xxhash64(*parts), F.lit(1 << 52)) + 0.5) / float(1 << 52)


def source_targets(sized: DataFrame, m: Mix = Mix()) -> DataFrame:
    """sized(source, size) -> one row a source: source, rank, weight, source_size, target.

    Targets share the total by weight; those above ``most`` sizes stop there and
    the rest is shared again, which is the level L with sum(min(cap, L * weight))
    equal to the total: sources reach their caps in order of cap / weight.  The
    windows run over one row a source.
    """
    totals = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last()))
    w = F.get(F.array(*map(F.lit, m.weights)), F.pmod(F.col("rank") - 1, F.lit(len(m.weights))).cast("int"))
    s = totals.withColumn("rank", rank).withColumn("weight", w).withColumn("cap", (m.most * F.col("source_size")).cast("double"))
    order = Window.orderBy(F.col("cap") / F.col("weight"), "rank")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy()
    s = s.withColumns(
        {
            "total": F.sum("source_size").over(every).cast("double"),
            "all_weight": F.sum("weight").over(every),
            "capped": F.coalesce(F.sum("cap").over(before), F.lit(0.0)),
            "capped_weight": F.coalesce(F.sum("weight").over(before), F.lit(0.0)),
        }
    )
    level = (F.col("total") - F.col("capped")) / (F.col("all_weight") - F.col("capped_weight"))
    # The first source in order that stays below its cap sets the level.
    s = s.withColumn("level", F.when(level * F.col("weight") <= F.col("cap"), level)).withColumn("place", F.row_number().over(order))
    level = F.min_by("level", F.when(F.col("level").isNotNull(), F.col("place"))).over(every)
    return s.select("source", "rank", "weight", "source_size", F.least("cap", F.coalesce(level * F.col("weight"), "cap")).alias("target"))


def log_factorial(n: Column) -> Column:
    """ln(n!) for whole n >= 0: Stirling's series at n + 8, stepped back."""

    def series(n: Column) -> Column:
        x = n + 8.0
        back = F.ln((n + 1) * (n + 2) * (n + 3) * (n + 4)) + F.ln((n + 5) * (n + 6) * (n + 7) * (n + 8))
        return (x + 0.5) * F.ln(x) - x + 0.5 * math.log(2 * math.pi) + 1 / (12 * x) - 1 / (360 * x * x * x) + 1 / (1260 * x * x * x * x * x) - back

    return let(n, series)


def hypergeometric(good: Column, bad: Column, draws: Column, u: Column) -> Column:
    """How many of ``draws`` from ``good`` + ``bad`` are good: inversion of ``u`` outwards from the mode."""
    choose = lambda n, k: log_factorial(n) - log_factorial(k) - log_factorial(n - k)

    def bounds(p: Column) -> Column:
        low, high = F.greatest(F.lit(0.0), p.d - p.b), F.least(p.g, p.d)
        mode = F.least(high, F.greatest(low, F.floor((p.d + 1) * (p.g + 1) / (p.g + p.b + 2)).cast("double")))
        total = p.g + p.b
        sd = F.sqrt(F.when(total > 1, p.d * (p.g / total) * (p.b / total) * (total - p.d) / (total - 1)).otherwise(0.0))
        # Most draws are found in the near walk; the far one reaches eight deviations.
        near, far = F.least(high - low, F.ceil(1.5 * sd) + 3).cast("int"), F.least(high - low, F.ceil(8 * sd) + 12).cast("int")
        return F.struct(p.g.alias("g"), p.b.alias("b"), p.d.alias("d"), p.u.alias("u"), low.alias("low"), high.alias("high"), mode.alias("mode"), near.alias("near"), far.alias("far"))

    def weighed(q: Column) -> Column:
        p0 = F.exp(choose(q.g, q.mode) + choose(q.b, q.d - q.mode) - choose(q.g + q.b, q.d))
        return let(p0, lambda p0: F.struct(q.mode.alias("up"), q.mode.alias("down"), p0.alias("pu"), p0.alias("pd"), (q.u - p0).alias("left"), F.when(q.u <= p0, q.mode).alias("got")))

    def step(q: Column, acc: Column) -> Column:
        pu = F.when(acc.up < q.high, acc.pu * (q.g - acc.up) * (q.d - acc.up) / ((acc.up + 1) * (q.b - q.d + acc.up + 1))).otherwise(0.0)
        pd = F.when(acc.down > q.low, acc.pd * acc.down * (q.b - q.d + acc.down) / ((q.g - acc.down + 1) * (q.d - acc.down + 1))).otherwise(0.0)
        found = lambda n: F.when(acc.got.isNotNull(), acc.got).when(acc.left <= n.pu, acc.up + 1).when(acc.left <= n.pu + n.pd, acc.down - 1)
        return let(F.struct(pu.alias("pu"), pd.alias("pd")), lambda n: F.struct((acc.up + 1).alias("up"), (acc.down - 1).alias("down"), n.pu.alias("pu"), n.pd.alias("pd"), (acc.left - n.pu - n.pd).alias("left"), found(n).alias("got")))

    def drawn(q: Column) -> Column:
        walk = lambda start, steps: F.aggregate(F.sequence(F.lit(0), steps), start, lambda acc, _: step(q, acc))
        further = lambda acc: F.when(acc.got.isNotNull(), acc.got).otherwise(F.coalesce(walk(acc, q.far).got, q.mode))
        walked = let(walk(weighed(q), q.near), further)
        return F.when((q.low >= q.high) | (q.g + q.b <= 0), q.low).otherwise(F.least(q.high, F.greatest(q.low, walked))).cast("long")

    given = F.struct(good.cast("double").alias("g"), bad.cast("double").alias("b"), draws.cast("double").alias("d"), u.alias("u"))
    return let(let(given, bounds), drawn)


def split_draws(have: Column, *key: Column) -> Column:
    """have(rank, draws)[] -> how many draws of each source go to the left half: a multivariate-hypergeometric
    draw of half of all draws (rounded up) that the key decides, as a chain of univariate ones."""

    def take(acc: Column, x: Column) -> Column:
        got = hypergeometric(x.draws, acc.rest - x.draws, acc.want, uniform(*key, x["rank"]))
        return let(got, lambda got: F.struct((acc.rest - x.draws).alias("rest"), (acc.want - got).alias("want"), F.array_append(acc.got, got).alias("got")))

    rest = F.aggregate(have, F.lit(0).cast("long"), lambda a, x: a + x.draws)
    start = let(rest, lambda rest: F.struct(rest.alias("rest"), F.floor((rest + 1) / 2).cast("long").alias("want"), F.array().cast("array<bigint>").alias("got")))
    return F.aggregate(have, start, take, lambda acc: acc.got)


def splitting_tree(quotas: DataFrame, depth: int, m: Mix = Mix()) -> DataFrame:
    """quotas(rank, draws) -> (shard, rank, take) for 2**depth shards of equal draws.

    A node is one row with its draws per source in an array; a level maps every
    node to its two children, so there is no join; from the sixth level on the
    nodes are dealt to all tasks.
    """
    nodes = quotas.where("draws > 0").agg(F.sort_array(F.collect_list(F.struct("rank", "draws"))).alias("have")).withColumn("node", F.lit(1).cast("long")).where(F.size("have") > 0)
    half = lambda left, f: F.transform("have", lambda x, i: F.struct(x["rank"].alias("rank"), f(x, F.get(left, i)).alias("draws")))
    children = let(
        split_draws(F.col("have"), F.lit(m.seed), F.col("node")),
        lambda left: F.array(
            F.struct((F.col("node") * 2).alias("node"), half(left, lambda x, got: got).alias("have")),
            F.struct((F.col("node") * 2 + 1).alias("node"), half(left, lambda x, got: x.draws - got).alias("have")),
        ),
    )
    for level in range(depth):
        if level in (5, 12):
            nodes = nodes.repartition("node")
        nodes = nodes.select(F.explode(children).alias("c")).select("c.node", "c.have")
    shard = F.col("node") - (1 << depth)
    return nodes.select(shard.alias("shard"), F.explode("have").alias("x")).select("shard", "x.rank", F.col("x.draws").alias("take")).where("take > 0")


def permuted(x: Column, n: Column, *key: Column, rounds: int = 40) -> Column:
    """The place of x in a permutation of 0 .. n - 1 that the key alone decides.

    A swap-or-not shuffle: each round pairs every number with another one by a
    keyed reflection and swaps the pair or not by a keyed bit, so every round is
    a bijection whatever n is.
    """

    def turn(acc: Column, r: Column) -> Column:
        other = F.pmod(F.pmod(F.xxhash64(*key, r, F.lit("reflect")), n) - acc, n)
        return let(other, lambda other: F.when(F.pmod(F.xxhash64(*key, r, F.greatest(acc, other)), F.lit(2)) == 0, acc).otherwise(other))

    return F.aggregate(F.sequence(F.lit(0), F.lit(rounds - 1)), x, turn)


#: Tells rows of documents apart.
ROW = ["row_hash", "row_hash2", "copy"]


def row_hashes(key: str, text: str, source: str, m: Mix = Mix()) -> list[Column]:
    given = [F.col(f"`{c}`") for c in (key, text, source)]
    # A null leaves xxhash64 as it was, so each is marked.
    marks = [c.isNull() for c in given]
    return [F.xxhash64(F.lit(m.seed + i), *given, *marks).alias(name) for i, name in enumerate(ROW[:2])]


def mix_sources(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", m: Mix = Mix()) -> tuple[DataFrame, DataFrame]:
    """(documents, pieces).

    documents: one row a row of docs: key, ROW, size, source_size, target.
    pieces: key, ROW, shard, epoch, start, length, order_key: runs of words to take;
    sorted by order_key within a shard they are the shuffled mix.
    """
    return _mix(docs, key, text, source, m)[:2]


def _mix(docs: DataFrame, key: str, text: str, source: str, m: Mix) -> tuple[DataFrame, DataFrame, int]:
    """As ``mix_sources``, and the number of shards."""
    sized = written(docs.select(F.col(f"`{key}`").alias("doc"), F.col(f"`{source}`").alias("source"), words_in(F.col(f"`{text}`")).alias("size"), *row_hashes(key, text, source, m)), "mix-sizes")
    targets = source_targets(sized, m)
    buckets = F.ceil(F.col("source_size") / m.bucket_words).cast("long")
    blocks = F.greatest(F.lit(1), F.ceil(F.col("source_size") / m.block_words)).cast("long")
    passes = F.floor(F.col("target") / F.col("source_size")).cast("long")
    t = targets.where("source_size > 0").withColumns({"buckets": F.greatest(F.lit(1), buckets), "blocks": blocks, "passes": passes})
    t = t.withColumn("rest_words", F.round(F.col("target") - F.col("passes") * F.col("source_size")).cast("long"))
    t = t.withColumn("whole", F.floor(F.col("rest_words") * F.col("blocks") / F.col("source_size")).cast("long"))
    edge_of = lambda k: F.floor(k * F.col("source_size") / F.col("blocks")).cast("long")
    t = t.withColumn("draws", F.col("passes") * F.col("blocks") + F.col("whole") + F.when(F.col("rest_words") > edge_of(F.col("whole")), 1).otherwise(0))
    # One row a source, and a source's row is a few numbers.
    t = written(t, "mix-targets")
    stats = t.select(F.col("source").alias("s"), "rank", "source_size", "buckets", "blocks", "target")
    place = sized.where("size > 0").join(stats, sized.source.eqNullSafe(F.col("s"))).select("doc", "size", *ROW[:2], "rank", "source_size", "blocks", "target", F.pmod("row_hash", "buckets").alias("bucket"))
    # Where a bucket begins in its source: sums of ranges of buckets, then of buckets in a range.
    per_bucket = place.groupBy("rank", "bucket").agg(F.sum("size").alias("words")).withColumn("range", F.floor(F.col("bucket") / m.range_buckets).cast("long"))
    earlier = lambda by, order: F.coalesce(F.sum("words").over(Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    per_range = per_bucket.groupBy("rank", "range").agg(F.sum("words").alias("words")).select("rank", "range", earlier(["rank"], "range").alias("range_base"))
    base = per_bucket.withColumn("in_range", earlier(["rank", "range"], "bucket")).join(per_range, ["rank", "range"]).select("rank", "bucket", (F.col("in_range") + F.col("range_base")).alias("base"))
    inside = Window.partitionBy("rank", "bucket").orderBy("row_hash", "row_hash2")
    rows = Window.unboundedPreceding, -1
    place = place.withColumn("row", F.row_number().over(inside)).withColumn("before", F.sum("size").over(inside.rowsBetween(*rows)))
    place = place.withColumn("copy", F.row_number().over(Window.partitionBy("rank", "bucket", *ROW[:2]).orderBy("row")))
    place = place.join(base, ["rank", "bucket"]).withColumn("begin", F.col("base") + F.coalesce("before", F.lit(0)))
    block_at = lambda w: F.floor((w * F.col("blocks") + F.col("blocks") - 1) / F.col("source_size")).cast("long")
    first = F.greatest(F.lit(0), block_at(F.col("begin")) - 1)
    last = F.least(F.col("blocks") - 1, block_at(F.col("begin") + F.col("size") - 1))
    parts = place.withColumn("block", F.explode(F.sequence(first, last)))
    parts = parts.withColumns({"block_begin": edge_of(F.col("block")), "block_end": edge_of(F.col("block") + 1)})
    parts = parts.withColumns({"from": F.greatest("begin", "block_begin"), "to": F.least(F.col("begin") + F.col("size"), F.col("block_end"))}).where("to > from")
    total = int(t.agg(F.sum("draws")).first()[0] or 0)
    depth = max(m.least_depth, math.ceil(math.log2(max(1, total) / m.shard_blocks)))
    tree = splitting_tree(t.select("rank", "draws"), depth, m)
    # A shard's share of a source is the next run of its draws; one row a shard and source.
    tree = tree.withColumn("offset", F.coalesce(F.sum("take").over(Window.partitionBy("rank").orderBy("shard").rowsBetween(*rows)), F.lit(0)))
    draws = tree.join(t.select("rank", "source_size", "blocks", "passes", "whole", "rest_words"), "rank")
    draws = draws.withColumn("draw", F.explode(F.sequence(F.col("offset"), F.col("offset") + F.col("take") - 1)))
    epoch = F.floor(F.col("draw") / F.col("blocks")).cast("long")
    draws = draws.withColumn("epoch", epoch).withColumn("turn", F.col("draw") - F.col("epoch") * F.col("blocks"))
    draws = draws.withColumn("block", permuted(F.col("turn"), F.col("blocks"), F.lit(m.seed), F.col("rank"), F.col("epoch")))
    # The last pass takes whole blocks, and of one more what is left of its words.
    share = F.when((F.col("epoch") == F.col("passes")) & (F.col("turn") == F.col("whole")), F.col("rest_words") - edge_of(F.col("whole")))
    draws = draws.select("rank", "block", "shard", "epoch", share.alias("share"))
    mixed = parts.join(draws, ["rank", "block"])
    end = F.least(F.col("to"), F.coalesce(F.col("block_begin") + F.col("share"), F.col("to")))
    mixed = mixed.withColumn("end", end).where("end > from")
    pieces = mixed.select(
        F.col("doc").alias(key),
        *ROW,
        "shard",
        "epoch",
        (F.col("from") - F.col("begin")).alias("start"),
        (F.col("end") - F.col("from")).alias("length"),
        F.xxhash64(F.lit(m.seed), "shard", "rank", "block", "epoch", *ROW).alias("order_key"),
    )
    known = targets.select(F.col("source").alias("s"), "source_size", "target")
    idle = sized.where("size = 0").join(known, sized.source.eqNullSafe(F.col("s")))
    documents = place.select(F.col("doc").alias(key), *ROW, "size", "source_size", "target").unionByName(
        idle.select(F.col("doc").alias(key), *ROW[:2], F.lit(0).alias("copy"), "size", "source_size", "target")
    )
    return documents, pieces, 1 << depth


def mixed_table(docs: DataFrame, m: Mix = Mix()) -> DataFrame:
    """The mix as documents(doc_id, text, source, ...): a row for each pass over a document, in the shards' order.

    A pass that takes a whole document keeps its text; one that takes a part has
    the part's words, joined by one space.  ``n_chars``, where there, is the new text's.
    A row lies in the shard of its first piece; a partition is a shard (a run of them beyond
    ``most_parts``) in its shuffled order, so files written from it are the mix.
    """
    _, pieces, shards = _mix(docs, "doc_id", "text", "source", m)
    parts = min(shards, m.most_parts)
    first = lambda c: F.min_by(c, "start").alias(c)
    passes = pieces.groupBy(*ROW, "epoch").agg(F.sort_array(F.collect_list(F.struct("start", "length"))).alias("runs"), F.sum("length").alias("taken"), first("shard"), first("order_key"))
    passes = passes.groupBy(*ROW).agg(F.collect_list(F.struct("epoch", "taken", "runs", "shard", "order_key")).alias("passes"))
    passes = written(passes, "mix-passes").groupBy(*ROW[:2]).agg(F.map_from_entries(F.collect_list(F.struct("copy", "passes"))).alias("by_copy"))
    src = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), *row_hashes("doc_id", "text", "source", m))
    # The join deals equal rows together, so numbering them needs no shuffle of its own.
    out = src.join(passes, ROW[:2]).withColumn("copy", F.row_number().over(Window.partitionBy(*ROW[:2]).orderBy(F.lit(0))))
    out = out.select("row", F.explode(F.element_at("by_copy", F.col("copy"))).alias("pass"))
    out = out.repartitionById(parts, F.floor(F.col("pass.shard") / (shards // parts)).cast("int")).sortWithinPartitions("pass.shard", "pass.order_key")
    old = F.col("row.text")
    words = F.regexp_extract_all(old, F.lit("(" + WORD + ")"), F.lit(1))
    part = F.array_join(F.flatten(F.transform("pass.runs", lambda r: F.slice(words, (r.start + 1).cast("int"), r.length.cast("int")))), " ")
    text = F.when(F.col("pass.taken") == words_in(old), old).otherwise(part)
    new = {"text": text}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.length(text).cast(docs.schema["n_chars"].dataType)
    return out.select(*(new.get(c, F.col(f"row.`{c}`")).alias(c) for c in docs.columns))
