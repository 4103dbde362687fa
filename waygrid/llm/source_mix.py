"""Mixing sources to target weights by Sainte-Lague apportionment. DataFrame functions only.

1. Targets: all words are shared out by the sources' weights; a source gets at most
   `max_repeats` times its own words, and what it can't take goes to the others by weight.
2. Seats: the mix consists of blocks of equally many words. Each goes to the source with
   the highest quotient target / (2 * blocks so far + 1), earlier sources first on ties.
   The number of blocks of a source is known beforehand to within the number of sources,
   so that only those last seats are ranked, whatever the size of the corpus. Seats are
   dealt over the shards in turn: an integer quota for each source and shard.
3. Blocks: a source's documents stand in seeded order, and its words are cut into blocks in
   that order, the last one shorter. Blocks stand in a seeded order of their own, and each
   shard takes its quota of them, one shard after the other, again from the first block once
   all are taken. So a source's taken words are its seats' to within a block for each time.
4. Copies: whole documents stand in the mix taken / size times. Fractions are rounded along the
   seeded order with their running sum, so that a source's copies are its quota to within one.

A row a source and shard, and two seats a source, pass one task: for up to some million sources.

Sources may be as skewed as they like: running sums are formed in ranges of the seeded
order within a source, and joined by sums of the ranges.

Null texts and texts without words have size 0 and take part with 0 words. Null is a
source of its own, the last one. A source so small that no seat falls to it is left out. Equal rows are documents of their own; which of them gets
which share doesn't matter, as they are equal. An empty table gives an empty result. The
result's columns are new ones, so other names in the input cannot clash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from waygrid.llm.common import saved

WEIGHTS = (5, 2, 1)
WORD = r"[^\x20\x09-\x0D]+"
#: A block has a 65,536th of all words, but one at least and 4096 at most.
BLOCKS, MOST_BLOCK_WORDS, SHARDS, SEED = 65_536, 4096, 8, "mix-1"
#: Rows of one range of a seeded order, about.
RANGE_ROWS = 65_536
#: Fractions of a copy are counted in this many parts.
UNIT = 1 << 20


def doc_key() -> Column:
    """Seeded place of a document in its source; equal rows share it."""
    return F.md5(F.concat(F.lit(f"{SEED}|"), F.coalesce(F.col("doc_id").cast("string"), F.lit("-")), F.lit("|"), F.coalesce("text", F.lit(""))))


def sized(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "source", doc_key().alias("place"), F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"))


def range_of(place: Column, n_ranges: int) -> Column:
    """Number of the range that holds a hexadecimal place, in the places' order."""
    return F.floor(F.conv(F.substring(place, 1, 8), 16, 10).cast("long") * F.lit(n_ranges) / F.lit(float(1 << 32)))


def running_sum(df: DataFrame, group: str, place: str, value: str, n_ranges: int) -> DataFrame:
    """df with before (sum of value in the group at smaller places) and nth (in its range).
    No task needs a whole group: ranges are summed apart and shifted."""
    df = df.withColumn("rng", range_of(F.col(place), n_ranges))
    sums = df.groupBy(group, "rng").agg(F.sum(value).alias("rng_sum"))
    shift = sums.withColumn("shift", F.coalesce(F.sum("rng_sum").over(W.partitionBy(group).orderBy("rng").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).drop("rng_sum")
    here = W.partitionBy(group, "rng").orderBy(place, value)
    inside = df.withColumn("inside", F.coalesce(F.sum(value).over(here.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).withColumn("nth", F.row_number().over(here))
    return inside.join(shift, [group, "rng"]).withColumn("before", F.col("inside") + F.col("shift")).drop("inside", "shift")


def targets(sizes: DataFrame, max_repeats: int = 3, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """source, src (its number), source_size, cap, target from source, size. One row a source."""
    by_name = W.orderBy(F.col("source").isNull(), F.col("source"))
    s = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    s = s.withColumn("src", F.row_number().over(by_name) - 1)
    s = s.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), F.pmod("src", F.lit(len(weights))) + 1)).withColumn("cap", F.col("source_size") * max_repeats)
    everything = W.partitionBy()
    fill = W.orderBy(F.col("cap") / F.col("weight"), "src").rowsBetween(W.unboundedPreceding, -1)
    s = s.withColumn("left_words", F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(fill), F.lit(0)))
    s = s.withColumn("left_weight", F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(fill), F.lit(0)))
    share = F.col("weight") * F.col("left_words").cast("double") / F.col("left_weight")
    s = s.withColumn("full", share > F.col("cap"))
    level = F.min(F.when(~F.col("full"), F.struct(F.col("cap") / F.col("weight"), "src", "left_words", "left_weight"))).over(everything)
    s = s.withColumn("level", level)
    open_share = F.col("weight") * F.col("level.left_words").cast("double") / F.col("level.left_weight")
    return s.withColumn("target", F.when(F.col("full"), F.col("cap").cast("double")).otherwise(open_share)).select("source", "src", "source_size", "cap", "target")


def seats(goal: DataFrame, n_seats: int, total: int) -> DataFrame:
    """goal with seats: blocks by the highest quotients. Ranks about two seats a source."""
    live = F.sum(F.when(F.col("target") > 0, 1).otherwise(0)).over(W.partitionBy())
    g = goal.withColumn("slack", live / 2)
    g = g.withColumn("sure", F.greatest(F.lit(0), F.floor(F.col("target") * (n_seats - F.col("slack")) / max(total, 1))).cast("long"))
    g = g.withColumn("most", F.ceil(F.col("target") * (n_seats + F.col("slack")) / max(total, 1)).cast("long") + 1)
    g = g.withColumn("sures", F.sum(F.when(F.col("target") > 0, F.col("sure")).otherwise(0)).over(W.partitionBy()))
    ranked = g.where("target > 0").select("src", "target", "sures", F.explode(F.sequence("sure", "most")).alias("a"))
    ranked = ranked.withColumn("rank", F.row_number().over(W.orderBy(F.desc(F.col("target") / (2 * F.col("a") + 1)), "src")))
    more = ranked.where(F.col("rank") <= n_seats - F.col("sures")).groupBy("src").agg(F.count("*").alias("more"))
    return g.join(more, "src", "left").withColumn("seats", F.when(F.col("target") > 0, F.col("sure") + F.coalesce("more", F.lit(0))).otherwise(F.lit(0))).drop("slack", "sure", "sures", "most", "more")


def shard_quotas(seated: DataFrame, n_shards: int = SHARDS) -> DataFrame:
    """src, shard, quota: seats are dealt over the shards in turn, source after source."""
    first = F.coalesce(F.sum("seats").over(W.orderBy("src").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    upto = lambda n: F.floor((n - F.col("shard") + n_shards - 1) / n_shards)
    dealt = seated.withColumn("first", first).withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(n_shards - 1))))
    return dealt.select("src", "shard", (upto(F.col("first") + F.col("seats")) - upto(F.col("first"))).cast("long").alias("quota"))


def block_words(total: int) -> int:
    return max(1, min(MOST_BLOCK_WORDS, total // BLOCKS))


def chosen_blocks(plan: DataFrame, words: int, n_ranges: int) -> DataFrame:
    """src, block, shard: a row for each time that a shard takes a block. plan: src, n_blocks, take (seats),
    ends (running sum of the shards' quotas)."""
    step = 4096  # a source's blocks are made by many tasks
    coarse = plan.where("take > 0").withColumn("c", F.explode(F.expr(f"sequence(0L, (n_blocks - 1) div {step})")))
    blocks = coarse.repartition("src", "c").withColumn("block", F.explode(F.expr(f"sequence(c * {step}, least(n_blocks, (c + 1) * {step}) - 1)")))
    blocks = blocks.select("src", "block", "n_blocks", "take", "ends", F.md5(F.concat_ws("|", F.lit(SEED), "src", "block")).alias("at"), F.lit(1).alias("one"))
    placed = running_sum(blocks, "src", "at", "one", n_ranges).where("before < take")
    turns = placed.withColumn("turn", F.explode(F.expr("sequence(0L, (take - 1 - before) div n_blocks)")))
    nth = F.col("turn") * F.col("n_blocks") + F.col("before")
    return turns.withColumn("nth_seat", nth).select("src", "block", F.size(F.filter("ends", lambda e: e <= F.col("nth_seat"))).alias("shard"))


def mix_documents(docs: DataFrame, max_repeats: int = 3, n_shards: int = SHARDS) -> DataFrame:
    """doc_id, place, size, source_size, target, taken, copies and shard_words (what each shard
    takes of it, separated by commas) of every document."""
    sizes = saved(sized(docs), "mix-sizes")
    per_source = saved(targets(sizes, max_repeats), "mix-targets")
    n_rows, total = sizes.agg(F.count("*"), F.coalesce(F.sum("size"), F.lit(0))).first()
    words = block_words(total)
    seated = saved(seats(per_source, total // words, total), "mix-seats")
    upto = F.sum("quota").over(W.partitionBy("src").orderBy("shard").rowsBetween(W.unboundedPreceding, 0))
    ends = shard_quotas(seated, n_shards).withColumn("end", upto).groupBy("src").agg(F.sort_array(F.collect_list(F.struct("shard", "end"))).alias("ends"))
    plan = seated.join(ends, "src").withColumn("n_blocks", F.ceil(F.col("source_size") / words).cast("long"))
    plan = plan.select("source", "src", "source_size", "target", "n_blocks", F.least("seats", F.col("n_blocks") * max_repeats).alias("take"), F.transform("ends", lambda x: x["end"]).alias("ends"))
    plan = saved(plan, "mix-plan")
    chosen = chosen_blocks(plan, words, max(64, total // words // RANGE_ROWS))

    # source is joined null-safe by its number, which is what the running sums go by
    number = plan.select("source", "src").withColumnRenamed("source", "name")
    numbered = sizes.join(number, F.col("source").eqNullSafe(F.col("name"))).drop("name", "source")
    n_ranges = max(64, n_rows // RANGE_ROWS)
    placed = running_sum(numbered, "src", "place", "size", n_ranges)
    last = F.floor((F.col("before") + F.col("size") - 1) / words)
    spans = placed.withColumn("block", F.explode_outer(F.when(F.col("size") > 0, F.sequence(F.floor(F.col("before") / words), last))))
    part = F.least(F.col("before") + F.col("size"), (F.col("block") + 1) * words) - F.greatest("before", F.col("block") * words)
    of_shard = [F.coalesce(F.sum(F.when(F.col("shard") == k, part)), F.lit(0)).alias(f"s{k}") for k in range(n_shards)]
    summed = spans.join(chosen, ["src", "block"], "left").groupBy("src", "rng", "nth", "doc_id", "place", "size").agg(*of_shard)
    summed = summed.withColumn("taken", sum((F.col(f"s{k}") for k in range(n_shards)), F.lit(0).cast("long")))
    summed = summed.withColumn("shard_words", F.concat_ws(",", *[f"s{k}" for k in range(n_shards)])).select("src", "doc_id", "place", "size", "taken", "shard_words")
    share = F.when(F.col("size") > 0, F.expr(f"(taken * {UNIT}) div size")).otherwise(F.lit(0))
    rounded = running_sum(summed.withColumn("share", share), "src", "place", "share", n_ranges)
    copies = F.expr(f"(before + share + {UNIT // 2}) div {UNIT} - (before + {UNIT // 2}) div {UNIT}").cast("int")
    return rounded.join(plan.select("src", "source_size", "target"), "src").select("doc_id", "place", "size", "source_size", "target", "taken", copies.alias("copies"), "shard_words")


def mixed_documents(docs: DataFrame, max_repeats: int = 3) -> DataFrame:
    """The mix itself, with the columns of docs: a document stands in it as often as `copies` says."""
    copies = mix_documents(docs, max_repeats).select("place", "copies")
    same = copies.withColumn("same", F.row_number().over(W.partitionBy("place").orderBy("copies"))).where("copies > 0")
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    rows = docs.select(doc_key().alias("place"), whole.alias("row"))
    rows = rows.withColumn("same", F.row_number().over(W.partitionBy("place").orderBy("place")))
    back = rows.join(same, ["place", "same"]).withColumn("again", F.explode(F.expr("sequence(1, copies)")))
    return back.select("row.*")
