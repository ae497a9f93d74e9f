"""Operator 7: mixing sources to target weights by systematic sampling. DataFrame functions only."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarry.llm.common import materialize, read

WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    """Number of maximal runs without ASCII white space; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def _unit(key: Column) -> Column:
    """A number in [0, 1) from the first 48 bits of the key's MD5."""
    return F.conv(F.substring(F.md5(key), 1, 12), 16, 10).cast("double") / F.lit(float(1 << 48))


def source_targets(sizes: DataFrame, weights: Sequence[float] = (3, 1, 2), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """Water-filling: targets in proportion to the weights, none above `most` times its source's size.

    sizes: (source, source_size), a row for each source. Sources take the weights in code-point order, null last,
    over and over. With caps c = most * size and total T = share * sum(size), the targets are min(L * w, c) for the level
    L at which they add up to T. Sources enter the capped set in the order of c / w, so a running sum finds L.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    by_ratio = Window.orderBy("ratio", F.col("source").asc_nulls_last())
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy(F.lit(0))
    turn = (F.row_number().over(by_name) - 1) % len(weights)
    weighed = (
        sizes.withColumn("w", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (turn + 1).cast("int")))
        .withColumn("cap", F.col("source_size") * F.lit(float(most)))
        .withColumn("ratio", F.col("cap") / F.col("w"))
    )
    rest_size = F.sum("source_size").over(everything) * F.lit(float(share)) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))
    rest_w = F.sum("w").over(everything) - F.coalesce(F.sum("w").over(before), F.lit(0.0))
    # The level if exactly the sources before this one are capped; it is the answer at the first source whose cap lies above it.
    tried = weighed.withColumn("level", rest_size / rest_w).withColumn("turn", F.row_number().over(by_ratio))
    first_free = F.min(F.when(F.col("level") < F.col("ratio"), F.struct("turn", "level"))).over(everything)["level"]
    return tried.withColumn("flat", first_free).select(
        "source", "source_size", F.when(F.col("flat").isNull(), F.col("cap")).otherwise(F.least(F.col("cap"), F.col("flat") * F.col("w"))).alias("target")
    )


def _placed(docs: DataFrame, seed: int, blocks: int) -> DataFrame:
    """Adds each document's size, its random key, its size class (an eighth of an octave) and its part of the hash range."""
    key = F.concat_ws("|", F.lit(str(seed)), F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.coalesce(F.md5(F.col("text")), F.lit("null")))
    digits = F.rpad(F.bin(F.col("mix_size") + 1), 20, "0")
    whole = F.length(F.bin(F.col("mix_size") + 1)) * 8
    eighth = sum((F.substring(digits, 2 + i, 1).cast("int") * (4 >> i) for i in range(3)), F.lit(0))
    return (
        docs.withColumn("mix_size", word_count(F.col("text")))
        .withColumn("mix_h", F.substring(F.md5(key), 1, 16))
        .withColumn("mix_class", (whole + eighth).cast("int"))
        .withColumn("mix_part", F.floor(F.conv(F.substring("mix_h", 1, 4), 16, 10).cast("long") * blocks / 65536).cast("int"))
    )


def mix_sources(
    docs: DataFrame,
    weights: Sequence[float] = (3, 1, 2),
    share: float = 1.5,
    most: float = 2.0,
    seed: int = 7,
    blocks: int = 32,
) -> DataFrame:
    """docs (doc_id, text, source, ...) -> docs plus mix_size, mix_source_size, mix_target, mix_copies.

    Each document of a source expects r = target / source size copies. In one fixed order of the source, by size class and
    then at random, the running sum of r before the k-th document is r * k; with one random offset u for the source the
    document is taken once for each integer in (u + r*k, u + r*(k+1)]. Sorting by size class first makes the words taken follow the target closely.

    The rank k comes from counts of blocks (source, size class, part of the hash range) and a row number inside a block, so
    a source with a third of all rows is spread over hundreds of blocks. Rows that are equal in doc_id and text are interchangeable.
    Null text and text without words have size 0; null source is a source of its own; an empty table gives an empty table. Columns of other names pass through; columns named mix_* are replaced.
    """
    sized = _placed(docs, seed, blocks)
    part = ["source", "mix_class", "mix_part"]
    counts = _placed(docs.select("doc_id", "text", "source"), seed, blocks).groupBy(*part).agg(F.count(F.lit(1)).alias("n"), F.sum("mix_size").alias("words"))
    counts = materialize(counts, "mix-counts")  # a row for each block, read twice: the texts are not counted twice for it
    targets = source_targets(counts.groupBy("source").agg(F.sum("words").alias("source_size")), weights, share, most)
    before = Window.partitionBy("source").orderBy("mix_class", "mix_part").rowsBetween(Window.unboundedPreceding, -1)
    plan = (
        counts.withColumn("mix_before", F.coalesce(F.sum("n").over(before), F.lit(0)))
        .drop("n", "words")
        .alias("c")
        .join(targets.alias("t"), F.col("c.source").eqNullSafe(F.col("t.source")))
        .select(*[F.col(f"c.{c}").alias(f"p_{c}") for c in part], "mix_before", F.col("source_size").alias("mix_source_size"), F.col("target").alias("mix_target"))
    )
    inside = Window.partitionBy(*part).orderBy("mix_h", "doc_id")
    ranked = sized.withColumn("mix_k", F.row_number().over(inside) - 1)
    # Class and part are never null; an equality that does not know it would put "is not null" over their expressions, and words would be counted five times more.
    joined = ranked.join(plan, ranked["source"].eqNullSafe(F.col("p_source")) & ranked["mix_class"].eqNullSafe(F.col("p_mix_class")) & ranked["mix_part"].eqNullSafe(F.col("p_mix_part")))
    rate = F.when(F.col("mix_source_size") > 0, F.col("mix_target") / F.col("mix_source_size")).otherwise(F.lit(0.0))
    offset = _unit(F.concat_ws("|", F.lit(f"offset{seed}"), F.coalesce(F.col("source"), F.lit("\u0000"))))
    k = F.col("mix_before") + F.col("mix_k")
    copies = F.floor(offset + rate * (k + 1)) - F.floor(offset + rate * k)
    return joined.withColumn("mix_copies", copies.cast("long")).drop("mix_h", "mix_class", "mix_part", "mix_k", "mix_before", "p_source", "p_mix_class", "p_mix_part")


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return mix_sources(docs).select(
        "doc_id",
        F.col("mix_size").alias("size"),
        F.col("mix_source_size").alias("source_size"),
        F.col("mix_target").alias("target"),
        (F.col("mix_copies") * F.col("mix_size")).alias("taken"),
    )


OP7_SQL = r"""
WITH sized AS (
  SELECT doc_id, source,
         len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         substr(md5(concat_ws('|', '7', coalesce(doc_id::VARCHAR, 'null'), coalesce(md5(text), 'null'))), 1, 16) AS h
  FROM documents
), dug AS (
  SELECT *, format('{:b}', size + 1) AS bits FROM sized
), placed AS (
  SELECT *, length(bits) * 8 + substr(rpad(bits, 20, '0'), 2, 1)::INT * 4 + substr(rpad(bits, 20, '0'), 3, 1)::INT * 2
            + substr(rpad(bits, 20, '0'), 4, 1)::INT AS class,
         floor(('0x' || substr(h, 1, 4))::BIGINT * 32 / 65536)::INT AS part
  FROM dug
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY source ORDER BY class, part, h, doc_id) - 1 AS k FROM placed
), s AS (
  SELECT source, sum(size)::BIGINT AS source_size FROM placed GROUP BY source
), w AS (
  SELECT *, [3.0, 1.0, 2.0][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT]::DOUBLE AS w FROM s
), r AS (
  SELECT *, source_size * 2.0::DOUBLE AS cap, (source_size * 2.0::DOUBLE) / w AS ratio FROM w
), l AS (
  SELECT *, row_number() OVER (ORDER BY ratio, source NULLS LAST) AS turn,
         ((sum(source_size) OVER ())::DOUBLE * 1.5::DOUBLE
           - coalesce(sum(cap) OVER (ORDER BY ratio, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
         / (sum(w) OVER () - coalesce(sum(w) OVER (ORDER BY ratio, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS level
  FROM r
), flat AS (
  SELECT arg_min(level, turn) AS level FROM l WHERE level < ratio
), t AS (
  SELECT source, source_size, CASE WHEN flat.level IS NULL THEN cap ELSE least(cap, flat.level * w) END AS target FROM l, flat
), u AS (
  SELECT *, CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END AS rate,
         ('0x' || substr(md5(concat_ws('|', 'offset7', coalesce(source, chr(0)))), 1, 12))::BIGINT::DOUBLE / 281474976710656.0::DOUBLE AS u0
  FROM t
)
SELECT doc_id, size, source_size, target,
       ((floor(u0 + rate * (k + 1)) - floor(u0 + rate * k))::BIGINT * size)::BIGINT AS taken
FROM ranked JOIN u ON ranked.source IS NOT DISTINCT FROM u.source
"""
