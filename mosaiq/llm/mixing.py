"""Mixing sources to target weights, with DataFrame functions alone.

Each source's documents, in a fixed order, are one stream of words that is packed into blocks of equal
length.  Sources get target sizes by weight; a target stops at `cap` times the source's size and the
excess goes to the others by weight.  A source then owns as many output slots as its target has blocks.

Every output shard draws how many of its slots go to each source.  Independent multinomial draws of all shards would
miss the targets by their own noise, and a source at its cap could get more than that, so they are drawn given that their
totals meet the targets; that law is drawing slots without putting back, which a pseudorandom permutation of all slot
numbers does.  The draws, a row for each shard and source, decide the rest: each gets the next indexes of its
source, as many as it drew, and index i maps through the source's own permutation to a block.  Every pass over
the source has another permutation and uses each block once, so no block is used more often than `cap` rounds to.
Slots and blocks meet by an equi-join on (source, block index).

Order, offsets and the level of targets come from prefix sums in two levels and from plain sums, so neither a source that holds a
third of all rows nor very many sources land in one task.

Null text has size 0.  A null source is a source of its own, ordered last.  Repeated rows are documents
of their own.  Documents without words take nothing.  An empty table gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from mosaiq.llm.common import WORD, Stage, table

ROUNDS = 12
#: Indexes of a draw, and shards of a prefix sum, that are handled together.
RUN = 4096


@dataclass
class Mix:
    """docs: row, doc_id, key (of the text), source, sid, size, source_size, target, start (word offset in its source).
    sources: sid, source, source_size, target, blocks, slots.  draws: shard, sid, n (slots of the shard for the source), start (its
    first index), place (its first slot in the shard)."""

    docs: DataFrame
    sources: DataFrame
    draws: DataFrame
    block: int
    shard: int
    seed: int

    def slots(self) -> DataFrame:
        """shard, slot, sid, i, block: every slot that was drawn, with its index in the source and the block at that index."""
        spark = self.docs.sparkSession
        runs = self.draws.filter("n > 0").join(self.sources.select("sid", "blocks").hint("merge"), "sid")
        # Rows are few until they are unfolded, so Spark would put them together: the number of tasks is stated, and bounded.
        tasks = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
        each = (runs.repartition(tasks, "shard", "sid")
                .select("shard", "sid", "blocks", "start", "place", F.explode(F.expr("sequence(0L, n - 1)")).alias("k"))
                .select("shard", (F.col("shard") * self.shard + F.col("place") + F.col("k")).alias("slot"), "sid", "blocks", (F.col("start") + F.col("k")).alias("i")))
        block = permuted(F.pmod("i", "blocks"), F.col("blocks"), F.lit(self.seed), F.col("sid"), F.floor(F.col("i") / F.col("blocks")))
        return each.select("shard", "slot", "sid", "i", block.alias("block"))

    def overlaps(self) -> str:
        """SQL for the blocks that a document overlaps: array of (block, at: word offset in the document, words)."""
        b = self.block
        return (f"transform(sequence(start div {b}, (start + size - 1) div {b}), k -> named_struct('block', k, 'at', greatest(0L, k * {b} - start), "
                f"'words', least(start + size, (k + 1) * {b}) - greatest(start, k * {b})))")

    def pieces(self) -> DataFrame:
        """A row for each document and block that overlap: row, sid, block, at, words."""
        return self.docs.filter("size > 0").select("row", "sid", F.explode(F.expr(self.overlaps())).alias("p")).select("row", "sid", "p.*")


def permuted(x: Column, n: Column, *seed: Column) -> Column:
    """A pseudorandom permutation of 0 .. n-1, by swap-or-not: each round pairs x with (k - x) mod n and a hash of the pair decides."""
    def step(x: Column, r: Column) -> Column:
        other = F.pmod(F.pmod(F.xxhash64(*seed, r), n) + n - x, n)
        return F.when(F.xxhash64(*seed, r, F.greatest(x, other)).bitwiseAND(F.lit(1)) == 1, other).otherwise(x)

    return F.aggregate(F.array(*[F.lit(r) for r in range(ROUNDS)]), x.cast("long"), step)


def running(df: DataFrame, order: list[Column], sums: dict[str, str], stage: Stage) -> DataFrame:
    """df with, for each name in sums, the sum of that expression over all rows before, in an order without ties.

    Rows are dealt by range; each range sums its own, and only the ranges' totals are summed in one place."""
    ranges = stage.keep(df.repartitionByRange(*order).withColumn("range_", F.spark_partition_id()))
    whole = ranges.groupBy("range_").agg(*[F.sum(F.expr(e)).alias(f"{n}_in") for n, e in sums.items()])
    earlier = Window.orderBy("range_").rowsBetween(Window.unboundedPreceding, -1)  # as many rows as there were tasks
    whole = stage.keep(whole.select(F.col("range_").alias("of_"), *[F.coalesce(F.sum(f"{n}_in").over(earlier), F.lit(0)).alias(f"{n}_in") for n in sums]))
    before = Window.partitionBy("range_").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    own = ranges.select("*", *[F.coalesce(F.sum(F.expr(e)).over(before), F.lit(0)).alias(n) for n, e in sums.items()])
    return own.join(F.broadcast(whole), F.col("range_") == F.col("of_")).select(*df.columns, *[(F.col(n) + F.col(f"{n}_in")).alias(n) for n in sums])


def source_targets(sizes: DataFrame, weights: tuple[int, ...], cap: float, stage: Stage) -> DataFrame:
    """sid, source, source_size, target from sizes(source, source_size): one row per source, by code point, null last."""
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod(F.col("sid"), F.lit(len(weights))) + 1).cast("int"))
    ranked = running(sizes, [F.col("source").isNull(), F.col("source")], {"sid": "1L"}, stage)
    s = stage.keep(ranked.withColumn("w", weight).withColumn("most", F.col("source_size") * F.lit(float(cap))))
    total, w = s.agg(F.sum("source_size"), F.sum("w")).first()
    level = (total or 0) / w if w else 0.0  # what a unit of weight gets
    while True:  # each round stops the sources that the level would take beyond their bound, and shares what they leave
        stopped = F.col("most") <= F.col("w") * F.lit(level)
        taken, free = s.agg(F.sum(F.when(stopped, F.col("most")).otherwise(0.0)), F.sum(F.when(stopped, 0.0).otherwise(F.col("w")))).first()
        higher = (total - taken) / free if free else level
        if higher <= level:
            return s.select("sid", "source", "source_size", F.when(stopped, F.col("most")).otherwise(F.col("w") * F.lit(level)).alias("target"))
        level = higher


def mix_sources(docs: DataFrame, weights: tuple[int, ...] = (5, 2, 1), cap: float = 3.0, block: int = 128, shard: int = 1024, seed: int = 11) -> Mix:
    """The mix of docs(doc_id, text, source): blocks of `block` words, shards of `shard` blocks."""
    spark = docs.sparkSession
    stage = Stage(spark, "mixing")
    size = F.regexp_count(F.coalesce("text", F.lit("")), F.lit(WORD)).cast("long")
    base = stage.keep(docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", F.xxhash64("text").alias("key"), "source", size.alias("size")))
    sources = source_targets(base.groupBy("source").agg(F.sum("size").alias("source_size")), weights, cap, stage)
    blocks = F.ceil(F.col("source_size") / block)
    owned = F.least(F.lit(int(cap)) * blocks, F.round(F.col("target") * blocks / F.col("source_size")).cast("long"))
    sources = sources.withColumn("blocks", blocks).withColumn("slots", F.when(F.col("source_size") > 0, owned).otherwise(F.lit(0).cast("long")))
    sources = stage.keep(running(sources, [F.col("sid")], {"first": "slots"}, stage))
    known = sources.select(F.col("source").alias("of"), "sid", "source_size", "target")
    rows, n_slots, runs = base.count(), *(x or 0 for x in sources.agg(F.sum("slots"), F.sum(F.ceil(F.col("slots") / RUN))).first())
    chunk = F.pmod(F.xxhash64("doc_id", "key"), F.lit(max(1, int(rows ** 0.5))))
    placed = base.join(known, F.col("source").eqNullSafe(F.col("of")), "left").drop("of").withColumn("chunk", chunk)
    within = F.sum("size").over(Window.partitionBy("sid", "chunk").orderBy("doc_id", "key", "size", "row").rowsBetween(Window.unboundedPreceding, 0)) - F.col("size")
    chunks = (placed.groupBy("sid", "chunk").agg(F.sum("size").alias("n"))
              .select("sid", "chunk", (F.sum("n").over(Window.partitionBy("sid").orderBy("chunk")) - F.col("n")).alias("chunk_start")))
    placed = (placed.withColumn("within", within).join(chunks, ["sid", "chunk"])
              .select("row", "doc_id", "key", "source", "sid", "size", "source_size", "target", (F.col("chunk_start") + F.col("within")).alias("start")))
    # Each slot that a source owns is dealt to a shard; what counts is how many of them a shard gets.
    tasks = min(-(-int(runs) // 8), 4 * int(spark.conf.get("spark.sql.shuffle.partitions")))
    dealt = (sources.filter("slots > 0").select("sid", "slots", "first", F.explode(F.expr(f"sequence(0L, (slots - 1) div {RUN})")).alias("k"))
             .repartition(max(1, tasks), "sid", "k")
             .select("sid", F.explode(F.expr(f"sequence(first + k * {RUN}, first + least(slots, (k + 1) * {RUN}) - 1)")).alias("x")))
    slot = permuted(F.col("x"), F.lit(int(n_slots)).cast("long"), F.lit(seed))
    draws = stage.keep(dealt.select("sid", F.floor(slot / shard).alias("shard")).groupBy("shard", "sid").agg(F.count("*").alias("n")))
    # First indexes: sums over the shards before, within stretches of RUN shards and over stretches.
    stretch = F.floor(F.col("shard") / RUN)
    before = (draws.groupBy("sid", stretch.alias("stretch")).agg(F.sum("n").alias("all"))
              .select("sid", "stretch", (F.sum("all").over(Window.partitionBy("sid").orderBy("stretch")) - F.col("all")).alias("earlier")))
    own = F.sum("n").over(Window.partitionBy("sid", "stretch").orderBy("shard")) - F.col("n")
    place = F.sum("n").over(Window.partitionBy("shard").orderBy("sid")) - F.col("n")  # as many rows as a shard has slots at most
    draws = (draws.withColumn("stretch", stretch).withColumn("own", own).withColumn("place", place).join(before, ["sid", "stretch"])
             .select("shard", "sid", "n", (F.col("earlier") + F.col("own")).alias("start"), "place"))
    return Mix(stage.keep(placed), sources, stage.keep(draws), block, shard, seed)


def taken_words(mix: Mix) -> DataFrame:
    """doc_id, size, source_size, target and taken (words that the mix takes, repeats counted) of each document."""
    uses = mix.slots().groupBy("sid", "block").agg(F.count("*").alias("times"))
    # Slots come from a few rows, which Spark takes for their size: without the hint it would broadcast them.
    taken = mix.pieces().join(uses.hint("merge"), ["sid", "block"]).groupBy("row").agg(F.sum(F.col("words") * F.col("times")).alias("n"))
    return mix.docs.join(taken.hint("merge"), "row", "left").select("doc_id", "size", "source_size", "target", F.coalesce("n", F.lit(0)).cast("long").alias("taken"))


def mixed_blocks(docs: DataFrame, mix: Mix) -> DataFrame:
    """The mix itself: shard, slot, source, block and text of every slot.  docs: the documents that were mixed."""
    words = F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda w: w != "")
    texts = docs.select(F.col("doc_id").alias("id"), "text", F.xxhash64("text").alias("of")).filter("text IS NOT NULL").dropDuplicates(["id", "of"])
    # A document's words are cut into its blocks' parts before they are dealt, so each word travels once.
    held = mix.docs.filter("size > 0").join(texts, F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("key") == F.col("of")))
    cut = f"transform({mix.overlaps()}, p -> named_struct('block', p.block, 'start', start + p.at, 'part', array_join(slice(words, cast(p.at AS int) + 1, cast(p.words AS int)), ' ')))"
    parts = held.select("sid", "start", "size", words.alias("words")).select("sid", F.explode(F.expr(cut)).alias("p")).select("sid", "p.*")
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("start", "part"))), lambda p: p["part"]), " ")  # a block's words, at most
    text = parts.groupBy("sid", "block").agg(text.alias("text"))
    return (mix.slots().join(text.hint("merge"), ["sid", "block"]).join(mix.sources.select("sid", "source"), "sid")
            .select("shard", "slot", "source", "block", "text"))


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return taken_words(mix_sources(table(spark, sf_dir, "documents").select("doc_id", "text", "source")))
