"""Uniform shuffle into shards by a hypergeometric communication matrix.

Rows stand in source partitions (by a hash of their contents). How many rows each source
partition sends to each shard is drawn exactly: a multivariate hypergeometric draw from
the room that the shards have left. Rows are permuted in their source partition, dealt by
those counts, and permuted again in the shard. Every assignment of rows to places is
equally likely, and shard sizes are exact: counts differ by one at most (law `rows`).

The driver sees one count a source partition (`part_rows` rows each), nothing of the rows.
Both permutations are seeded, so reruns agree. A shard is permuted in ranges of a seeded
hash, so that no task needs a whole shard.

Null doc_id and null text are values like others; null text counts as empty. Equal rows
fall into one source partition and take places of their own. An empty table gives an
empty result. Rows keep all their columns through both permutations and the exchange. docs is
read three times (its rows, the sizes of its source partitions, the exchange) and must read alike.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from waygrid.llm.common import saved, shuffles_end_with_steps


def hypergeometric(rng: np.random.Generator, good: int, bad: int, n: int) -> int:
    """How many of n draws without return are good. Works for populations of any size: the
    probabilities relative to the mode's, from ratios of neighbours, over twelve standard
    deviations each way (what lies beyond has a chance under 1e-30)."""
    low, high = max(0, n - bad), min(n, good)
    if low == high:
        return low
    total = good + bad
    mode = min(high, max(low, (n + 1) * (good + 1) // (total + 2)))
    spread = int(12 * np.sqrt(n * (good / total) * (bad / total) * max(0.0, (total - n) / max(1, total - 1)))) + 12
    first, last = max(low, mode - spread), min(high, mode + spread)
    k = np.arange(first, last, dtype=np.float64)  # steps k -> k + 1
    steps = np.log((good - k) * (n - k)) - np.log((k + 1) * (bad - n + k + 1))
    weight = np.concatenate([[0.0], np.cumsum(steps)])
    chance = np.cumsum(np.exp(weight - weight.max()))
    return first + int(np.searchsorted(chance, rng.random() * chance[-1], side="right"))


def communication_matrix(counts: list[int], n_shards: int, seed: int) -> np.ndarray:
    """counts[p] rows of partition p dealt over the shards, whose sizes differ by one at most."""
    rng = np.random.Generator(np.random.PCG64(seed))
    total = sum(counts)
    room = [total // n_shards + (s < total % n_shards) for s in range(n_shards)]
    out = np.zeros((len(counts), n_shards), np.int64)
    for p, left in enumerate(counts):
        rest = sum(room)
        for s in range(n_shards):
            rest -= room[s]
            x = hypergeometric(rng, room[s], rest, left)
            out[p, s], left = x, left - x
            room[s] -= x
    return out


def _row_hash(docs: DataFrame) -> Column:
    """64 bits of all columns, for an order among rows that agree in doc_id and text. Maps have no hash of their own."""
    return F.xxhash64(*[F.to_json(F.struct(c)) if "map<" in kind or kind == "variant" else F.col(c) for c, kind in ((f"`{n}`", k) for n, k in docs.dtypes)])


def shard_documents(docs: DataFrame, n_shards: int = 8, seed: int = 11, part_rows: int = 65_536) -> DataFrame:
    """All columns of docs with shard and slot (the place in the shard, gapless from 0), written as
    shards: a folder each, whose files hold their rows in the order of slot."""
    if clash := {"shard", "slot"} & {c.lower() for c in docs.columns}:
        raise ValueError(f"docs has columns named as the result's: {sorted(clash)}")
    spark = docs.sparkSession
    id_, size, crc = F.col("doc_id").cast("long"), *text_digest()
    mark = lambda salt: F.xxhash64(F.lit(seed * 16 + salt), id_.alias("doc_id"), crc, size)
    n_parts = max(64, (n_rows := docs.count()) // part_rows)
    part = F.pmod(mark(1), F.lit(n_parts))
    counts = {r[0]: r[1] for r in docs.groupBy(part.alias("part")).count().collect()}  # one row a source partition
    parts = sorted(counts)
    matrix = np.cumsum(communication_matrix([counts[p] for p in parts], n_shards, seed), axis=1)
    ends = spark.createDataFrame([(int(p), m.tolist()) for p, m in zip(parts, matrix)], "part long, ends array<long>")
    keys = [id_.alias("id"), crc.alias("crc"), size.alias("size"), _row_hash(docs).alias("all")]
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), part.alias("part"), mark(2).alias("h_send"), mark(3).alias("h_range"), mark(4).alias("h_slot"), *keys)
    sent = rows.withColumn("nth", F.row_number().over(W.partitionBy("part").orderBy("h_send", "id", "crc", "size", "all"))).join(F.broadcast(ends), "part")
    sent = sent.withColumn("shard", F.size(F.filter("ends", lambda e: e < F.col("nth"))))
    n_ranges = max(64, n_rows // n_shards // part_rows)
    sent = sent.withColumn("rng", F.pmod("h_range", F.lit(n_ranges))).select("row", "id", "crc", "size", "all", "shard", "rng", "h_slot")
    with shuffles_end_with_steps(spark):
        sent = saved(sent, "shard-sent")
    before = sent.groupBy("shard", "rng").count().withColumn("before", F.coalesce(F.sum("count").over(W.partitionBy("shard").orderBy("rng").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).drop("count")
    place = F.row_number().over(W.partitionBy("shard", "rng").orderBy("h_slot", "id", "crc", "size", "all"))
    placed = sent.withColumn("place", place).join(F.broadcast(before), ["shard", "rng"])
    placed = placed.select("row.*", "shard", (F.col("before") + F.col("place") - 1).alias("slot"))
    with shuffles_end_with_steps(spark):
        shards = saved(placed, "shards", by=["shard"])
    return shards.select(*[f"`{c}`" for c in docs.columns], "shard", "slot")


def text_digest() -> tuple[Column, Column]:
    """Bytes of the text and one, and its CRC-32; null counts as empty."""
    return F.coalesce(F.octet_length("text") + F.lit(1), F.lit(1)).cast("long"), F.crc32(F.coalesce("text", F.lit("")))


def shard_digest(docs: DataFrame, n_shards: int = 8) -> DataFrame:
    found = shard_documents(docs, n_shards)
    size, crc = text_digest()
    return found.select(F.col("doc_id").cast("long").alias("doc_id"), size.alias("size"), crc.alias("text_crc32"), F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
