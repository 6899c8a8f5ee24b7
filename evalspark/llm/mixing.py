"""Mixing sources to target weights: exact word quotas, drawn as permuted blocks of documents.

1. Each source has a target: a share of ``total`` times all words by its weight, at most
   ``cap`` times its own words; what that leaves over is shared again among the others. That
   is one level for all, found with running sums over the table of sources.
2. A source's documents are permuted by hash and cut into blocks. Whole rounds of a source
   take every block; the rest of its target takes blocks in order, and from the block where
   it ends those documents that still fit. The gap that this leaves is filled from the blocks
   after it in the same way, until no document of the source fits; what fills it goes with
   the block where the target ended. Running sums go over blocks, not documents.
3. Each block drawn is a unit. A splitting tree deals units to output shards: at a node, the
   left half gets a multivariate-hypergeometric count of each source's units, one source
   after the other, and so on down to single shards. Only counts go through the tree.
4. A source's units, permuted, fill its quotas shard after shard, so draws are disjoint;
   within a shard, ``place`` orders the documents by hash.

All randomness is hashes of ``seed``, so reruns agree. DataFrame functions only.

Defined cases: null texts have size 0, and such documents are never taken; a null source is
a source, last in order; rows that repeat an id and text are one unit of choice and are
taken alike; without any words nothing is taken; other columns, whatever their names, are
carried unless they have the names of results.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from evalspark.llm.words import carrying, n_words
from evalspark.session import stage

WEIGHTS = (5, 2, 1)
TOTAL = 1.5
CAP = 2
BLOCK_WORDS = 1_000_000
BLOCK_DOCS = 4_000
SHARD_WORDS = 50_000_000
SEED = "mix"


def sized(docs: DataFrame, seed: str) -> DataFrame:
    """``docs`` with ``size`` and ``_u``, its place in the permutation of its source."""
    return docs.withColumns(
        {"size": n_words("text"), "_u": F.xxhash64(F.lit(seed), "doc_id", "text")}
    )


def source_targets(sizes: DataFrame, weights: tuple = WEIGHTS, total: float = TOTAL, cap: float = CAP) -> DataFrame:
    """``source, _r, source_size, docs, target``; one row per source."""
    by = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("docs"))
    ranked = by.withColumn("_r", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())))
    weight = F.element_at(F.array(*(F.lit(float(w)) for w in weights)), (F.pmod(F.col("_r") - 1, F.lit(len(weights))) + 1).cast("int"))
    full = ranked.withColumn("weight", weight).withColumn("most", F.col("source_size") * F.lit(float(cap)))
    # Sources by how soon they are full; the level is where the first is not full any more.
    by_level = Window.orderBy(F.col("most") / F.col("weight"), "_r")
    before = by_level.rowsBetween(Window.unboundedPreceding, -1)
    after = by_level.rowsBetween(0, Window.unboundedFollowing)
    everything = Window.partitionBy()
    full = full.withColumn("all", F.sum("source_size").over(everything) * F.lit(float(total)))
    level = (F.col("all") - F.coalesce(F.sum("most").over(before), F.lit(0.0))) / F.sum("weight").over(after)
    full = full.withColumn("level", level).withColumn("fits", F.col("level") <= F.col("most") / F.col("weight"))
    full = full.withColumn("level", F.max(F.when(F.col("fits"), F.col("level"))).over(everything))
    target = F.least(F.col("most"), F.coalesce("level", F.lit(0.0)) * F.col("weight"))
    return full.select("source", "_r", "source_size", "docs", target.alias("target"))


def blocks_drawn(sizes: DataFrame, targets: DataFrame, block_words: int, block_docs: int) -> tuple[DataFrame, DataFrame]:
    """``(blocks, cuts)``: per ``(_r, block)`` its whole ``rounds`` and what the rest takes of it
    (``rest``: all, some or none); ``(_r, block, _u)`` of each document that the rest takes from
    other than whole blocks."""
    spark = sizes.sparkSession
    placed = with_block(sizes, with_counts(targets, block_words, block_docs))
    summed = placed.groupBy("_r", "block").agg(F.sum("size").alias("words"), F.any_value("rounds").alias("rounds"), F.any_value("left").alias("gap"))
    told = stage(in_order_taken(summed), spark)
    units = placed.groupBy("_r", "block", "_u").agg(F.sum("size").alias("size")).filter("size > 0")
    end = "rest = 'some'"
    met = stage(fitting(units.join(told.filter(end).select("_r", "block", "gap"), ["_r", "block"])), spark)
    cuts = met.select("_r", "block", F.explode("taken").alias("_u"))
    # Each step ends all sources or goes on behind the block where they ended, with a smaller gap.
    while True:
        gaps = met.select("_r", F.col("block").alias("_end"), "gap")
        units = stage(units.join(gaps, "_r").filter("block > _end AND size <= gap").drop("_end"), spark)
        if units.isEmpty():
            return told.drop("gap", "words"), cuts
        summed = units.groupBy("_r", "block").agg(F.sum("size").alias("words"), F.any_value("gap").alias("gap"))
        more = stage(in_order_taken(summed), spark)
        units = units.drop("gap")
        whole = units.join(more.filter("rest = 'all'").select("_r", "block"), ["_r", "block"]).select("_r", "block", "_u")
        met = stage(fitting(units.join(more.filter(end).select("_r", "block", "gap"), ["_r", "block"])), spark)
        cuts = cuts.unionByName(whole).unionByName(met.select("_r", "block", F.explode("taken").alias("_u")))


def in_order_taken(summed: DataFrame) -> DataFrame:
    """Blocks with ``rest``, how much of each is taken when they fill ``gap`` in order, and the ``gap`` before each."""
    running = F.sum("words").over(Window.partitionBy("_r").orderBy("block").rowsBetween(Window.unboundedPreceding, -1))
    told = summed.withColumn("gap", F.col("gap") - F.coalesce(running, F.lit(0)))
    return told.withColumn("rest", F.when(F.col("gap") >= F.col("words"), "all").when(F.col("gap") > 0, "some").otherwise("none"))


def fitting(units: DataFrame) -> DataFrame:
    """``_r, block, gap, taken``: units of each block that fit its gap, in order, and the gap left."""
    in_order = units.groupBy("_r", "block").agg(
        F.any_value("gap").alias("gap"), F.array_sort(F.collect_list(F.struct("_u", "size"))).alias("units")
    )
    start = F.struct(F.col("gap").alias("gap"), F.array().cast("array<bigint>").alias("taken"))
    fold = F.aggregate(
        "units", start,
        lambda a, x: F.when(
            x["size"] <= a["gap"],
            F.struct((a["gap"] - x["size"]).alias("gap"), F.concat(a["taken"], F.array(x["_u"])).alias("taken")),
        ).otherwise(a),
    )
    return in_order.select("_r", "block", fold.alias("x")).select("_r", "block", "x.gap", "x.taken")


def with_counts(targets: DataFrame, block_words: int, block_docs: int) -> DataFrame:
    """Targets with blocks per source, whole rounds and the words left to take after them."""
    size, target = F.col("source_size"), F.round("target").cast("long")
    rounds = F.when(size > 0, F.floor(target / size)).otherwise(F.lit(0)).cast("long")
    blocks = F.greatest(F.lit(1), F.ceil(size / block_words), F.ceil(F.col("docs") / block_docs)).cast("long")
    return targets.withColumns({"blocks": blocks, "rounds": rounds}).withColumn("left", target - F.col("rounds") * size)


def with_block(sizes: DataFrame, targets: DataFrame) -> DataFrame:
    """Each document's source row and block: equal parts of the permutation's range."""
    part = F.shiftrightunsigned("_u", 33)
    met = sizes.join(
        targets.withColumnRenamed("source", "_source"), sizes["source"].eqNullSafe(F.col("_source"))
    ).drop("_source")
    return met.withColumn("block", F.shiftright(part * F.col("blocks"), 31))


def hypergeometric(count: Column, pool: Column, draws: Column, salt: list[Column]) -> Column:
    """How many of ``count`` special units are among ``draws`` from ``pool``, unit by unit."""
    start = F.struct(pool.alias("pool"), draws.alias("draws"), F.lit(0).cast("long").alias("got"))

    def one(a: Column, i: Column) -> Column:
        chance = F.shiftrightunsigned(F.xxhash64(*salt, i), 11) / F.lit(float(1 << 53))
        hit = F.when(chance * a["pool"] < a["draws"], F.lit(1)).otherwise(F.lit(0)).cast("long")
        return F.struct((a["pool"] - 1).alias("pool"), (a["draws"] - hit).alias("draws"), (a["got"] + hit).alias("got"))

    steps = F.when(count > 0, F.sequence(F.lit(1).cast("long"), count)).otherwise(F.array().cast("array<bigint>"))
    return F.aggregate(steps, start, one, lambda a: a["got"])


def split_quotas(units: DataFrame, depth: int, seed: str, spark: SparkSession) -> DataFrame:
    """``_r, shard, quota`` for ``2 ** depth`` shards from ``_r, units``; a table per level."""
    nodes = units.groupBy().agg(
        F.array_sort(F.collect_list(F.struct("_r", F.col("units").alias("n")))).alias("counts")
    ).select(F.lit(0).cast("long").alias("node"), "counts")
    for level in range(depth):
        pool = F.aggregate("counts", F.lit(0).cast("long"), lambda a, x: a + x["n"])
        state = F.struct(
            F.col("pool").alias("pool"), F.shiftrightunsigned(F.col("pool") + F.pmod("node", F.lit(2)), 1).alias("draws"),
            F.array().cast("array<struct<_r:int,n:bigint>>").alias("left"),
        )

        def next_source(a: Column, x: Column) -> Column:
            got = hypergeometric(x["n"], a["pool"], a["draws"], [F.lit(seed), F.lit(level), F.col("node"), x["_r"]])
            # One-element transform: the draw is made once and used twice.
            return F.transform(F.array(got), lambda g: F.struct(
                (a["pool"] - x["n"]).alias("pool"), (a["draws"] - g).alias("draws"),
                F.concat(a["left"], F.array(F.struct(x["_r"].alias("_r"), g.alias("n")))).alias("left"),
            ))[0]

        halves = nodes.withColumn("pool", pool).select("node", "counts", F.aggregate("counts", state, next_source, lambda a: a["left"]).alias("left"))
        halves = stage(halves, spark)
        right = F.zip_with("counts", "left", lambda c, x: F.struct(c["_r"].alias("_r"), (c["n"] - x["n"]).alias("n")))
        nodes = halves.select(F.explode(F.array(
            F.struct((F.col("node") * 2).alias("node"), F.col("left").alias("counts")),
            F.struct((F.col("node") * 2 + 1).alias("node"), right.alias("counts")),
        )).alias("x")).select("x.*")
    return nodes.select(F.col("node").alias("shard"), F.explode("counts").alias("x")).select("x._r", "shard", F.col("x.n").alias("quota"))


def shards_of_blocks(blocks: DataFrame, depth: int, seed: str, spark: SparkSession) -> DataFrame:
    """``_r, block, rest, shards``: the shard of each draw of a block, whole rounds first."""
    draws = blocks.withColumn("draws", F.col("rounds") + F.when(F.col("rest") == "none", 0).otherwise(1))
    units = draws.groupBy("_r").agg(F.sum("draws").alias("units"))
    ends = F.sum("quota").over(Window.partitionBy("_r").orderBy("shard"))
    quotas = split_quotas(units, depth, seed, spark).withColumn("end", ends)
    bounds = quotas.groupBy("_r").agg(F.array_sort(F.collect_list("end")).alias("ends"))
    each = draws.filter("draws > 0").withColumn("draw", F.explode(F.sequence(F.lit(1).cast("long"), "draws")))
    order = Window.partitionBy("_r").orderBy(F.xxhash64(F.lit(seed), "_r", "block", "draw"), "block", "draw")
    ranked = each.withColumn("rank", F.row_number().over(order)).join(bounds, "_r")
    shard = F.size(F.filter("ends", lambda x: x < F.col("rank"))).cast("int")
    per_block = ranked.select("_r", "block", F.struct("draw", shard.alias("shard")).alias("x")).groupBy("_r", "block").agg(
        F.transform(F.array_sort(F.collect_list("x")), lambda x: x["shard"]).alias("shards")
    )
    return blocks.join(per_block, ["_r", "block"], "left").select("_r", "block", "rest", "shards")


@carrying("doc_id", "source", "text", results=("size", "source_size", "target", "taken", "shards", "place"))
def mix_plan(
    docs: DataFrame, weights: tuple = WEIGHTS, total: float = TOTAL, cap: float = CAP, seed: str = SEED,
    block_words: int = BLOCK_WORDS, block_docs: int = BLOCK_DOCS, shard_words: int = SHARD_WORDS,
) -> DataFrame:
    """``docs`` with ``size, source_size, target, taken`` and ``shards`` (one for each time it is
    taken) and ``place``, its order within a shard."""
    spark = docs.sparkSession
    sizes = stage(sized(docs.select("doc_id", "source", "text"), seed).drop("text"), spark)
    targets = stage(source_targets(sizes, weights, total, cap), spark)
    wanted = targets.agg(F.sum("target")).first()[0] or 0
    depth = max(0, int(-(-wanted // shard_words)) - 1).bit_length()
    blocks, cuts = blocks_drawn(sizes, targets, block_words, block_docs)
    blocks, cuts = stage(blocks, spark), stage(cuts, spark)
    drawn = shards_of_blocks(blocks, depth, seed, spark)
    counted = with_counts(targets, block_words, block_docs)
    every = with_block(sized(docs, seed), counted)
    # What fills a gap is in the shard of the block where its source's target ended.
    cut = cuts.join(drawn.filter("rest = 'some'").select("_r", F.element_at("shards", -1).alias("_cut")), "_r")
    met = every.join(drawn, ["_r", "block"], "left").join(cut, ["_r", "block", "_u"], "left")
    whole = F.col("rounds") + F.when(F.col("rest") == "all", 1).otherwise(0)
    whole = F.when(F.col("size") > 0, whole).otherwise(0)
    copies = whole + F.when((F.col("size") > 0) & F.col("_cut").isNotNull(), 1).otherwise(0)
    last = F.when((F.col("size") > 0) & F.col("_cut").isNotNull(), F.array("_cut")).otherwise(F.array().cast("array<int>"))
    return met.select(
        *docs.columns, "size", "source_size", "target",
        (F.col("size") * copies).cast("long").alias("taken"),
        F.concat(F.slice(F.coalesce("shards", F.array().cast("array<int>")), F.lit(1), whole.cast("int")), last).alias("shards"),
        F.xxhash64(F.lit(seed), F.lit("place"), "_u").alias("place"),
    )


def write_shards(plan: DataFrame, path: str) -> None:
    """Write each time a document is taken as a row, by shard and shuffled within it."""
    rows = plan.withColumn("shard", F.explode("shards"))
    rows.repartition("shard").sortWithinPartitions("shard", "place").write.partitionBy("shard").parquet(path)
