"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree.

Every source is dealt into blocks by a seeded hash, and its target into passes over those blocks: whole
passes, then a last one over the first blocks of a seeded order, cut at the exact word. The passes' blocks
are the source's quota. A binary tree splits all quotas among the output shards: at each node the left
half takes its exact share of blocks, of each source as many as a hypergeometric draw gives, so that
every shard gets the blocks it would get from one shuffle of them all. Each shard then draws disjoint runs
of each source's permuted blocks and orders its rows by a seeded hash.

Only DataFrame functions are used. What is held together is at most the sources' quotas of a node or
one block of documents.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sectorloom.llm.common import Scratch

WEIGHTS = (1, 2, 3)
MOST_REPEATS = 3
#: Documents in a block, about.
BLOCK_DOCS = 256
#: Blocks of a source at most: the draws' cost is bounded, and blocks grow beyond.
MOST_BLOCKS = 1024
SHARDS = 16
PARTS = "array<struct<shard:int,block:bigint,pass:bigint,words:bigint,rank:int,place:bigint>>"


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def _seeded(seed: int, *what) -> Column:
    return F.xxhash64(F.lit(seed), *what)


def _uniform(seed: int, *what) -> Column:
    """In (0, 1)."""
    return (F.pmod(_seeded(seed, *what), F.lit(1 << 52)).cast("double") + 0.5) / float(1 << 52)


def targets(sources: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST_REPEATS) -> DataFrame:
    """(source, source_size) -> with weight and target: a share of all sizes by weight, ``most`` times the source's size at most, the excess reshared by weight.

    Sources are weighed in code-point order, null last. A target is the lesser of the cap and weight
    times a level; the level follows from the sources sorted by cap over weight. A source of size 0 has
    the target 0.
    """
    ordered = Window.orderBy(F.col("source").asc_nulls_last())
    found = sources.withColumn("weight", F.get(F.array(*[F.lit(w) for w in weights]), F.pmod(F.row_number().over(ordered) - 1, F.lit(len(weights)))).cast("long"))
    found = found.withColumn("cap", F.col("source_size") * most)
    by = Window.orderBy((F.col("cap") / F.col("weight")).asc(), F.col("source").asc_nulls_last())
    before, everything = by.rowsBetween(Window.unboundedPreceding, -1), Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    found = found.withColumn("capped", F.coalesce(F.sum("cap").over(before), F.lit(0))).withColumn("weighed", F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0)))
    found = found.withColumn("total", F.sum("source_size").over(everything))
    # the level if just the sources before this one are capped; the first that stays under its own cap decides
    found = found.withColumn("level", (F.col("total") - F.col("capped")).cast("double") / F.col("weighed"))
    found = found.withColumn("level", F.min(F.when(F.col("level") * F.col("weight") <= F.col("cap"), F.struct(F.col("cap") / F.col("weight"), "level"))).over(everything)["level"])
    target = F.least(F.col("cap").cast("double"), F.coalesce(F.col("level") * F.col("weight"), F.col("cap").cast("double")))
    return found.select("source", "source_size", "weight", target.alias("target"))


def _draw(own: Column, rest: Column, take: Column, u: Column) -> Column:
    """How many of ``own`` blocks are among ``take`` drawn from own + rest: the hypergeometric inverse at u."""
    low, high = F.greatest(F.lit(0).cast("long"), take - rest), F.least(own, take)
    ks = F.sequence(low, F.greatest(high, low))

    def log(at, k):
        """log p(k) - log p(low), from that of k - 1."""
        up = F.ln(((own - k + 1) * (take - k + 1)).cast("double") / (k * (rest - take + k)).cast("double"))
        return F.when(k == low, F.lit(0.0)).otherwise(at + up)

    first = F.struct(F.lit(0.0).alias("at"), F.lit(0.0).alias("peak"))
    peak = F.aggregate(ks, first, lambda a, k: F.struct(log(a["at"], k).alias("at"), F.greatest(a["peak"], log(a["at"], k)).alias("peak")))["peak"]
    none = F.struct(F.lit(0.0).alias("at"), F.lit(0.0).alias("sum"), F.lit(0).cast("long").alias("k"))

    def add(peak: Column, bound: Column):
        """Sums odds; k counts those whose sum stays below the bound."""

        def step(a, k):
            at = log(a["at"], k)
            total = a["sum"] + F.exp(at - peak)
            return F.struct(at.alias("at"), total.alias("sum"), (a["k"] + F.when(total < bound, F.lit(1)).otherwise(F.lit(0))).cast("long").alias("k"))

        return step

    def below(peak: Column) -> Column:
        total = F.aggregate(ks, none, add(peak, F.lit(0.0)))["sum"]
        return _let(u * total, lambda bound: F.aggregate(ks, none, add(peak, bound))["k"])

    return F.least(low + _let(peak, below), F.greatest(high, low))


def _let(value: Column, use) -> Column:
    """use(value), with the value computed once rather than wherever it is used."""
    return F.transform(F.array(value), use)[0]


def split_quotas(quotas: DataFrame, shards: int, seed: int, scratch: Scratch) -> DataFrame:
    """(source_id long, blocks long) -> (source_id, shard, blocks) with exact sums over shards and shard totals at most one apart."""
    whole = Window.partitionBy("lo", "hi").orderBy("source_id")
    ahead = whole.rowsBetween(1, Window.unboundedFollowing)
    now = quotas.select("source_id", "blocks", F.lit(0).alias("lo"), F.lit(shards).alias("hi"))
    all_blocks = Window.partitionBy()
    now = now.withColumn("all", F.sum("blocks").over(all_blocks)).where("blocks > 0")
    width = shards
    while width > 1:
        mid = F.floor((F.col("lo") + F.col("hi")) / 2).cast("int")

        def upto(shard: Column) -> Column:
            return F.floor(F.col("all") * shard / F.lit(shards)).cast("long")

        now = now.withColumn("mid", mid).withColumn("rest", F.coalesce(F.sum("blocks").over(ahead), F.lit(0)))
        now = now.withColumn("take", upto(F.col("mid")) - upto(F.col("lo"))).withColumn("u", _uniform(seed, "source_id", "lo", "hi"))
        now = _conditional(now)
        halves = F.array(
            F.struct(F.col("left").alias("blocks"), F.col("lo").alias("lo"), F.col("mid").alias("hi")),
            F.struct((F.col("blocks") - F.col("left")).alias("blocks"), F.col("mid").alias("lo"), F.col("hi").alias("hi")),
        )
        now = now.select("source_id", "all", F.explode(halves).alias("half")).select("source_id", "half.*", "all")
        now = scratch.keep(now.where("blocks > 0 and hi > lo"), small=True)
        width = (width + 1) // 2
    return now.select("source_id", F.col("lo").alias("shard"), "blocks")


def _conditional(now: DataFrame) -> DataFrame:
    """Draws a node's sources in turn: each from what the draws before it leave."""
    group = F.sort_array(F.collect_list(F.struct("source_id", "blocks", "rest", "u")))
    nodes = now.groupBy("lo", "mid", "hi", "all", "take").agg(group.alias("own"))
    start = F.struct(F.col("take").alias("take"), F.array().cast("array<bigint>").alias("left"))

    def step(a, x):
        k = F.when(x["rest"] == 0, F.least(x["blocks"], a["take"])).otherwise(_draw(x["blocks"], x["rest"], a["take"], x["u"]))
        return F.struct((a["take"] - k).alias("take"), F.concat(a["left"], F.array(k)).alias("left"))

    nodes = nodes.withColumn("left", F.aggregate("own", start, step)["left"])
    pairs = nodes.select("lo", "mid", "hi", "all", F.explode(F.arrays_zip("own", "left")).alias("x"))
    return pairs.select("lo", "mid", "hi", "all", F.col("x.own.source_id").alias("source_id"), F.col("x.own.blocks").alias("blocks"), F.col("x.left").alias("left"))


def mix_sources(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST_REPEATS, shards: int = SHARDS, seed: int = 17) -> DataFrame:
    """docs -> every row with all its columns and, as ``mix``, a struct of size, source_size, target, taken and parts.

    size: words of the text (null: 0). taken: the words that the mix takes of the document, repeats
    counted, at most ``most`` times size; a source's sum is its target, rounded to a whole word. parts:
    an array of (shard, block, pass, words, rank, place): which output shard takes how many words of it, its
    rank within that shard's block, and the seeded hash that orders the whole shard, in each pass anew. A null source is a source of its own, last in order. Repeated rows
    count each time; a null doc_id is an id like others. Other columns pass through, except that one
    named ``mix`` is replaced. Empty tables give empty results.
    """
    scratch = Scratch(docs.sparkSession, docs)
    rid = F.xxhash64(F.lit(seed), F.col("doc_id"), F.col("source"), F.col("text"))
    fine = F.pmod(_seeded(seed + 1, rid), F.lit(MOST_BLOCKS))
    source_id = F.xxhash64(F.lit(seed), F.col("source").isNull(), "source")
    size = word_count(F.col("text").cast("string"))
    # the one table that planning needs: a row for each source and fine bucket at most
    light = docs.select("source", source_id.alias("source_id"), fine.alias("fine"), size.alias("size"))
    buckets = scratch.keep(light.groupBy("source", "source_id", "fine").agg(F.sum("size").alias("bucket_size"), F.count("*").alias("bucket_rows")), small=True)

    sums = buckets.groupBy("source", "source_id").agg(F.sum("bucket_size").alias("source_size"), F.sum("bucket_rows").alias("rows"))
    aimed = targets(sums.select("source", "source_size"), weights, most).withColumn("source_id", source_id)
    plan = aimed.select("source_id", "source_size", "target").join(sums.select("source_id", "rows"), "source_id")
    plan = plan.withColumn("n_blocks", F.greatest(F.lit(1), F.least(F.lit(MOST_BLOCKS), F.ceil(F.col("rows") / BLOCK_DOCS))).cast("long"))
    plan = plan.withColumn("want", F.round("target").cast("long")).withColumn("passes", F.when(F.col("source_size") > 0, F.expr("want div source_size")).otherwise(F.lit(0)).cast("long"))
    plan = scratch.keep(plan.withColumn("remain", F.col("want") - F.col("passes") * F.col("source_size")), small=True)

    def block_of(fine_bucket: str) -> Column:
        return F.expr(f"{fine_bucket} * n_blocks div {MOST_BLOCKS}")

    blocks = buckets.join(plan.select("source_id", "n_blocks", "passes", "remain"), "source_id").withColumn("block", block_of("fine"))
    blocks = blocks.groupBy("source_id", "block", "passes", "remain").agg(F.sum("bucket_size").alias("block_size")).where("block_size > 0")
    order = Window.partitionBy("source_id").orderBy(_seeded(seed + 2, "source_id", "block"), "block")
    blocks = blocks.withColumn("place", F.row_number().over(order).cast("long") - 1).withColumn("in_pass", F.count("*").over(Window.partitionBy("source_id")))
    blocks = blocks.withColumn("begins", F.sum("block_size").over(order.rowsBetween(Window.unboundedPreceding, 0)) - F.col("block_size"))
    last = F.least(F.greatest(F.col("remain") - F.col("begins"), F.lit(0)), F.col("block_size"))
    blocks = scratch.keep(blocks.withColumn("last_words", last).withColumn("drawn", F.col("passes") + F.when(last > 0, F.lit(1)).otherwise(F.lit(0))), small=True)

    # a source's block copies, pass by pass, are dealt in runs to the shards
    shares = split_quotas(blocks.groupBy("source_id").agg(F.sum("drawn").alias("blocks")), shards, seed + 3, scratch)
    upto = F.sum("blocks").over(Window.partitionBy("source_id").orderBy("shard").rowsBetween(Window.unboundedPreceding, 0))
    runs = shares.withColumn("to", upto).groupBy("source_id").agg(F.sort_array(F.collect_list(F.struct("to", "shard"))).alias("runs"))

    def drawn(p: Column) -> Column:
        """The shard that draws this block's copy of pass p."""
        return F.struct(p.alias("pass"), F.get(F.filter("runs", lambda r: r["to"] > p * F.col("in_pass") + F.col("place")), F.lit(0))["shard"].alias("shard"))

    draws = F.when(F.col("drawn") > 0, F.transform(F.sequence(F.lit(0).cast("long"), F.greatest(F.col("drawn") - 1, F.lit(0).cast("long"))), drawn))
    placed = scratch.keep(blocks.join(runs, "source_id", "left").select("source_id", "block", "last_words", draws.alias("draws")), small=True)

    own = F.struct(*[F.col(c) for c in docs.columns if c != "mix"]).alias("own")
    rows = docs.select(own, source_id.alias("source_id"), rid.alias("rid"), fine.alias("fine"), size.alias("size"))
    rows = rows.join(plan.select("source_id", "source_size", "target", "n_blocks", "passes"), "source_id").withColumn("block", block_of("fine"))
    within = Window.partitionBy("source_id", "block").orderBy(_seeded(seed + 4, "rid"), "rid")
    rows = rows.withColumn("rank", F.row_number().over(within) - 1).withColumn("begins", F.sum("size").over(within.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size"))
    rows = rows.join(placed, ["source_id", "block"], "left")
    part = F.least(F.greatest(F.coalesce("last_words", F.lit(0)) - F.col("begins"), F.lit(0)), F.col("size"))
    rows = rows.withColumn("part", part)
    words = lambda d: F.when(d["pass"] < F.col("passes"), F.col("size")).otherwise(F.col("part"))
    parts = F.filter(F.transform("draws", lambda d: F.struct(d["shard"].alias("shard"), F.col("block").alias("block"), d["pass"].alias("pass"), words(d).alias("words"), F.col("rank").alias("rank"), _seeded(seed + 5, "rid", d["shard"], d["pass"]).alias("place"))), lambda d: d["words"] > 0)
    mix = F.struct("size", "source_size", "target", (F.col("passes") * F.col("size") + F.col("part")).alias("taken"), F.coalesce(parts, F.array().cast(PARTS)).alias("parts"))
    return rows.select("own.*", mix.alias("mix"))


def mixed_rows(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: a row for each document and pass that takes words of it, with the columns of docs. Documents stay whole."""
    return _parts(docs, **options).select(*_kept(docs))


def shard_rows(docs: DataFrame, **options) -> DataFrame:
    """The mix laid out: as ``mixed_rows``, with shard and place; each shard lies in one partition, in its order."""
    rows = _parts(docs, **options)
    laid = rows.select(*[c for c in _kept(docs) if c not in ("shard", "place")], "part.shard", "part.place", F.col("part.rank").alias("__rank"))
    return laid.repartition("shard").sortWithinPartitions("shard", "place", "__rank").drop("__rank")


def _kept(docs: DataFrame) -> list[str]:
    return [c for c in docs.columns if c not in ("mix", "part")]


def _parts(docs: DataFrame, **options) -> DataFrame:
    mixed = mix_sources(docs, **options)
    return mixed.select(*_kept(docs), F.explode("mix.parts").alias("part"))
