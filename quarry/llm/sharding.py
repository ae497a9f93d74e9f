"""Operator 1: a uniform shuffle into shards of exact size, by a hypergeometric communication matrix."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarry.llm.common import materialize, read


def communication_matrix(rows: list[int], shards: int, seed: int) -> np.ndarray:
    """How many rows each block sends to each shard.

    Row sums are the blocks' sizes, column sums the shards' exact sizes (at most one apart); given those sums the counts are
    distributed as under a uniform permutation of all rows. Blocks are drawn one after the other: each is a multivariate
    hypergeometric draw from the places that are still free, made of at most shards - 1 hypergeometric draws.
    """
    total = sum(rows)
    free = [total // shards + (k < total % shards) for k in range(shards)]
    rng = np.random.default_rng(seed)
    matrix = np.zeros((len(rows), shards), dtype=np.int64)
    for p, n in enumerate(rows):
        left, open_places = n, sum(free)
        for k in range(shards):
            others = open_places - free[k]
            take = left if others == 0 else _hypergeometric(rng, free[k], others, left)
            matrix[p, k] = take
            left -= take
            open_places = others
            free[k] -= take
    return matrix


def _hypergeometric(rng: np.random.Generator, good: int, bad: int, n: int) -> int:
    """Good ones among n drawn. numpy draws up to its limit of 1e9; beyond, by inversion over all counts within 14 standard deviations of the mean: what lies outside is less than a double can tell."""
    if n == 0 or good == 0:
        return 0
    if good + bad < 1_000_000_000:
        return int(rng.hypergeometric(good, bad, n))
    return _by_inversion(rng, good, bad, n)


def _by_inversion(rng: np.random.Generator, good: int, bad: int, n: int) -> int:
    total = good + bad
    mean = n * good / total
    reach = 14 * (mean * (bad / total) * ((total - n) / max(total - 1, 1))) ** 0.5 + 20
    low, high = max(0, n - bad, int(mean - reach)), min(n, good, int(mean + reach))
    k = np.arange(low, high, dtype=np.float64)
    steps = np.log(good - k) + np.log(n - k) - np.log(k + 1) - np.log(float(bad - n) + k + 1)
    logs = np.concatenate(([0.0], np.cumsum(steps)))
    upto = np.cumsum(np.exp(logs - logs.max()))
    return low + int(np.searchsorted(upto, rng.random() * upto[-1], side="right"))


def shard_documents(docs: DataFrame, shards: int = 8, seed: int = 1, rows_per_block: int = 20_000, least_blocks: int = 64, most_blocks: int = 65_536) -> DataFrame:
    """Adds shard (0 to shards - 1) and slot (gapless from 0 in the shard) to docs (doc_id, text, ...).

    1. Rows are dealt into blocks by a hash of doc_id and text. 2. The driver draws the block-to-shard counts from the
    blocks' sizes (a number for each block). 3. Each block is permuted, by a seeded hash, and cut into runs of those lengths, one for each shard.
    4. Each shard is permuted again by a second hash: the hash's upper bits make sub-blocks whose counts give the first slot, and
    the rank in the sub-block gives the rest, so no shard is sorted in one task.

    Shard sizes differ by one row at most. Null doc_id and null text hash as values of their own; rows equal in both
    are interchangeable; an empty table gives an empty table. Columns named shard, slot or _s_* in the input are replaced.
    """
    spark = docs.sparkSession
    docs = docs.drop("shard", "slot")
    key = [F.coalesce(F.col("doc_id").cast("string"), F.lit("\u0000null")), F.xxhash64(F.coalesce(F.col("text"), F.lit("\u0000null")))]
    mixed = F.xxhash64(F.lit(seed), *key)
    narrow = docs.select(mixed.alias("h"))
    total = narrow.count()
    blocks = int(min(max(least_blocks, -(-total // rows_per_block)), most_blocks))
    block_of = F.pmod(F.col("_s_h"), F.lit(blocks)).cast("int")
    counts = dict(docs.select(mixed.alias("_s_h")).groupBy(block_of.alias("b")).count().collect())
    sizes = [counts.get(b, 0) for b in range(blocks)]
    matrix = communication_matrix(sizes, shards, seed)
    cuts = spark.createDataFrame([(b, [int(x) for x in np.cumsum(matrix[b])]) for b in range(blocks)], "_s_block int, _s_cuts array<long>")

    in_block = Window.partitionBy("_s_block").orderBy("_s_p", "_s_h")
    placed = (
        docs.withColumn("_s_h", mixed)
        .withColumn("_s_block", block_of)
        .withColumn("_s_p", F.xxhash64(F.lit(seed + 1), F.col("_s_h")))
        .withColumn("_s_rank", F.row_number().over(in_block))
        .join(F.broadcast(cuts) if blocks <= 4096 else cuts, "_s_block")
        .withColumn("shard", F.size(F.filter("_s_cuts", lambda c: c < F.col("_s_rank"))))
        .withColumn("_s_q", F.xxhash64(F.lit(seed + 2), F.col("_s_h"), F.col("_s_rank")))
        .withColumn("_s_sub", F.shiftrightunsigned(F.col("_s_q"), 64 - int(np.ceil(np.log2(max(2, blocks // shards + 1))))).cast("int"))
        .drop("_s_cuts", "_s_block", "_s_p", "_s_rank")
    )
    placed = materialize(placed, "shards")
    before = Window.partitionBy("shard").orderBy("_s_sub").rowsBetween(Window.unboundedPreceding, -1)
    first = placed.groupBy("shard", "_s_sub").count().withColumn("_s_first", F.coalesce(F.sum("count").over(before), F.lit(0))).drop("count")
    in_sub = Window.partitionBy("shard", "_s_sub").orderBy(F.shiftrightunsigned("_s_q", 1), "_s_q", "_s_h")
    return (
        placed.withColumn("_s_r", F.row_number().over(in_sub) - 1)
        .join(first, ["shard", "_s_sub"])
        .withColumn("slot", (F.col("_s_first") + F.col("_s_r")).cast("long"))
        .drop("_s_h", "_s_q", "_s_sub", "_s_r", "_s_first")
    )


def shard_with_digests(docs: DataFrame, shards: int = 8) -> DataFrame:
    """docs with shard and slot, and of each text its size (UTF-8 bytes plus 1; null: 1), its CRC and the law that holds. Columns of these names are replaced."""
    text = F.coalesce(F.col("text"), F.lit(""))
    placed = shard_documents(docs.drop("size", "text_crc32", "law", "grown_shard"), shards)
    return placed.withColumns({"size": (F.octet_length(text) + 1).cast("long"), "text_crc32": F.crc32(text), "law": F.lit("rows"), "grown_shard": F.lit(None).cast("int")})


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents themselves are shuffled; the digests are taken of what arrives."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return shard_with_digests(docs).select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")
