"""Audit of filters that are applied one after another in every order.

Each text is read once for the filters that look at it alone. A counting Bloom sketch over text digests clears texts that occur once for sure;
only possible repeats are grouped by their full text for the smallest id. Flags, labels and counts of a part then add up to 32 masks, from which
all orders follow.
"""

from __future__ import annotations

import itertools
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm.common import materialize, mix64, read, release

FILTERS = "ABCDE"
#: Bit of a filter in a mask of failures.
BIT = {name: 1 << i for i, name in enumerate(FILTERS)}
MARKS, CAPITALS, FOLLOWING = b"#$%&*|", bytes(range(65, 91)), bytes(range(0x80, 0xC0))
#: Cells of the sketch for each text, cells that a text counts in, and cells of a block.
CELLS, PROBES, BLOCK = 8, 4, 1 << 20


def flags_of(text: bytes) -> int:
    """Failures of A to D as a mask."""
    words = text.split()
    mask = BIT["A"] * (len(words) < 50) | BIT["B"] * (100 * len(set(words)) < 65 * len(words))
    capitals, points = len(text) - len(text.translate(None, CAPITALS)), len(text.translate(None, FOLLOWING))
    return mask | BIT["C"] * (100 * capitals > 5 * points) | BIT["D"] * (len(text.translate(None, MARKS)) < len(text))


def digest_of(text: bytes, seed: int) -> bytes:
    return xxhash.xxh3_128_digest(text, seed=seed)


def _texts(batch: pa.RecordBatch) -> list[bytes]:
    return [x or b"" for x in batch.column("text").cast(pa.binary()).to_pylist()]


def _halves(texts: list[bytes], seed: int, digest: Callable[[bytes, int], bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(digest(t, seed) for t in texts), dtype="<i8").reshape(-1, 2)


def scan_texts(docs: DataFrame, seed: int, digest: Callable[[bytes, int], bytes]) -> DataFrame:
    """docs (doc_id, part, text) -> (doc_id, part, mask, high, low): one narrow row for each document, with its digest in two halves."""

    def scanned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = _texts(batch)
            halves = _halves(texts, seed, digest)
            columns = [batch.column("doc_id"), batch.column("part"), pa.array([flags_of(t) for t in texts], pa.int32()), pa.array(halves[:, 0].copy()), pa.array(halves[:, 1].copy())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "part", "mask", "high", "low"])

    return docs.mapInArrow(scanned, f"doc_id {dict(docs.dtypes)['doc_id']}, part string, mask int, high long, low long")


def _cells_of(halves: np.ndarray, cells: int) -> np.ndarray:
    """Places of each digest's cells (digests x PROBES); cells is a power of two."""
    a, b = halves[:, 0].astype(np.uint64), halves[:, 1].astype(np.uint64)
    with np.errstate(over="ignore"):
        return np.stack([mix64(a + np.uint64(i) * (b | np.uint64(1))) & np.uint64(cells - 1) for i in range(PROBES)], axis=1).astype(np.int64)


def sketch(narrow: DataFrame, cells: int) -> DataFrame:
    """narrow (high, low) -> (block, twice): for each block of cells a bit for each cell that two or more texts count in.

    A task counts its own digests, each at most twice, and sends on what it touched of each block, so copies within a task count once more and
    no more; blocks are added up where they meet. What is sent grows with the texts, not with tasks times cells.
    """

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not len(batch):
                continue
            halves = np.stack([batch.column("high").to_numpy(), batch.column("low").to_numpy()], axis=1)
            own, times = np.unique(halves, axis=0, return_counts=True)
            places = _cells_of(own, cells)
            at, where = np.unique(places.ravel(), return_inverse=True)
            counts = np.minimum(np.bincount(where, weights=np.repeat(np.minimum(times, 2), PROBES)), 2).astype(np.uint8)
            ends = np.flatnonzero(np.diff(at // BLOCK)) + 1
            pieces = list(zip(np.split(at, ends), np.split(counts, ends), strict=True))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([int(p[0]) // BLOCK for p, _ in pieces], pa.int32()),
                    pa.array([(p % BLOCK).astype("<i4").tobytes() for p, _ in pieces], pa.binary()),
                    pa.array([c.tobytes() for _, c in pieces], pa.binary()),
                ],
                ["block", "places", "counts"],
            )

    def merged(key: tuple, partials: pd.DataFrame) -> pd.DataFrame:
        total = np.zeros(min(BLOCK, cells), dtype=np.uint8)
        for places, counts in zip(partials["places"], partials["counts"], strict=True):
            at = np.frombuffer(places, dtype="<i4")
            total[at] = np.minimum(total[at] + np.frombuffer(counts, dtype=np.uint8), 2)
        return pd.DataFrame({"block": [key[0]], "twice": [np.packbits(total >= 2, bitorder="little").tobytes()]})

    parts = narrow.select("high", "low").mapInArrow(partial, "block int, places binary, counts binary")
    return parts.groupBy("block").applyInPandas(merged, "block int, twice binary")


def possible_repeats(docs: DataFrame, narrow: DataFrame, seed: int, digest: Callable[[bytes, int], bytes], most_mb: int = 128) -> DataFrame:
    """docs (doc_id, text) whose text may occur twice, with high and low: all that do, and few others.

    The sketch goes to every task, so it has most_mb at most. Where the texts need more cells, digests are dealt into ranges, each with a sketch
    and a pass over the texts of its own.
    """
    wanted, most = max(1, CELLS * narrow.count()), most_mb << 23
    ranges = -(-wanted // most)
    cells = max(1 << 16, 1 << (-(-wanted // ranges) - 1).bit_length())
    out = None
    for r in range(ranges):
        mine = narrow if ranges == 1 else narrow.where(F.pmod("high", F.lit(ranges)) == r)
        bits = np.zeros(cells // 8, dtype=np.uint8)
        for row in sketch(mine, cells).collect():
            part = np.frombuffer(row["twice"], dtype=np.uint8)
            bits[row["block"] * BLOCK // 8 : row["block"] * BLOCK // 8 + len(part)] = part
        sent = docs.sparkSession.sparkContext.broadcast(bits)

        def chosen(batches: Iterator[pa.RecordBatch], sent=sent, r=r) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                halves = _halves(_texts(batch), seed, digest)
                places = _cells_of(halves, cells)
                hit = ((sent.value[places >> 3] >> (places & 7).astype(np.uint8)) & 1).all(axis=1) & (halves[:, 0] % ranges == r)
                keep = pa.array(hit)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").filter(keep), batch.column("text").filter(keep), pa.array(halves[hit, 0]), pa.array(halves[hit, 1])], ["doc_id", "text", "high", "low"]
                )

        found = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).mapInArrow(chosen, f"doc_id {dict(docs.dtypes)['doc_id']}, text string, high long, low long")
        out = found if out is None else out.unionByName(found)
    return out


def mask_counts(docs: DataFrame, labels: DataFrame, most_mb: int = 128, digest: Callable[[bytes, int], bytes] = digest_of) -> DataFrame:
    """docs (doc_id, part, text), labels (doc_id, quality, toxic) -> (part, mask, n, good, toxic): documents by part and set of failures.

    Copies are told by full text: should two texts share a digest, all is done again with another seed. What is joined is summed before, so the
    copies of one text are a row for each part and set of flags, however many they are.
    """
    for seed in range(3):
        narrow = materialize(scan_texts(docs.select("doc_id", "part", "text"), seed, digest), "flags")
        firsts = materialize(possible_repeats(docs, narrow, seed, digest, most_mb).groupBy("text", "high", "low").agg(F.min("doc_id").alias("first")).select("high", "low", "first"), "firsts")
        if not firsts.groupBy("high", "low").count().where("count > 1").limit(1).count():
            break
        release(narrow, firsts)
    else:
        raise ValueError("different texts share digests under every seed")
    told = labels.where("doc_id is not null").groupBy("doc_id").agg(F.max(F.coalesce(F.col("quality") == 1, F.lit(False))).alias("good"), F.max(F.coalesce(F.col("toxic") == 1, F.lit(False))).alias("toxic"))
    known = narrow.where("doc_id is not null").join(told, "doc_id", "left").withColumns({c: F.coalesce(c, F.lit(False)) for c in ("good", "toxic")})
    rows = known.groupBy("doc_id", "high", "low", "part", "mask", "good", "toxic").agg(F.count("*").alias("n"))
    sets = rows.groupBy("high", "low", "part", "mask", "good", "toxic").agg(F.sum("n").alias("n"), F.min("doc_id").alias("least"), F.min_by("n", "doc_id").alias("n_least"))
    met = sets.join(firsts, ["high", "low"], "left").withColumn("n_first", F.when(F.col("first").isNull(), F.col("n")).when(F.col("least") == F.col("first"), F.col("n_least")).otherwise(0))
    both = F.array(F.struct(F.col("mask"), F.col("n_first").alias("n")), F.struct((F.col("mask") + BIT["E"]).alias("mask"), (F.col("n") - F.col("n_first")).alias("n")))
    flagged = met.select("part", "good", "toxic", F.explode(both).alias("x")).select("part", "good", "toxic", "x.mask", "x.n").where("n > 0")
    nameless = narrow.where("doc_id is null").groupBy("part", "mask").agg(F.count("*").alias("n")).select("part", F.lit(False).alias("good"), F.lit(False).alias("toxic"), "mask", "n")
    return flagged.unionByName(nameless).groupBy("part", "mask").agg(
        F.sum("n").alias("n"), F.sum(F.when(F.col("good"), F.col("n")).otherwise(0)).alias("good"), F.sum(F.when(F.col("toxic"), F.col("n")).otherwise(0)).alias("toxic")
    )


def all_orders(counts: DataFrame) -> DataFrame:
    """counts (part, mask, n, good, toxic) -> a row for each part, order of the filters and step.

    What a step does hangs on the set of filters before it, so 80 pairs of such a set and a filter are summed and then dealt to the 600 steps.
    A document is removed by the first filter of the order that it fails, and each of m failing filters is first in 120 / m of all orders.
    """
    spark = counts.sparkSession
    steps = [("".join(o), i + 1, sum(BIT[x] for x in o[:i]), BIT[o[i]]) for o in itertools.permutations(FILTERS) for i in range(len(FILTERS))]
    pairs = sorted({s[2:] for s in steps})
    pair = F.explode(F.array(*[F.struct(F.lit(before).alias("before"), F.lit(bit).alias("bit")) for before, bit in pairs])).alias("pair")
    met = counts.select("*", pair).select("*", "pair.before", "pair.bit")
    mask, before, bit = F.col("mask"), F.col("before"), F.col("bit")
    fails, seen = mask.bitwiseAND(bit) != 0, mask.bitwiseAND(before) != 0
    share = F.when(fails, F.col("n") * F.element_at(F.lit([0, *[120 // m for m in range(1, 6)]]), F.bit_count("mask") + 1)).otherwise(0)
    count = lambda holds, what="n": F.sum(F.when(holds, F.col(what)).otherwise(0))
    summed = met.groupBy("part", "before", "bit").agg(
        count(~fails & ~seen).alias("kept"), count(fails & ~seen).alias("removed"), count(fails & seen).alias("redundant"), count(mask == bit).alias("unique_fails"),
        count(fails & ~seen, "good").alias("good_lost"), count(fails & ~seen, "toxic").alias("toxic_lost"), F.sum(share).cast("long").alias("shapley"),
    )
    dealt = spark.createDataFrame(steps, "filter_order string, step int, before int, bit int")
    kinds = ["kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
    return summed.join(F.broadcast(dealt), ["before", "bit"]).select("part", "filter_order", "step", *kinds)


def audit_filters(docs: DataFrame, labels: DataFrame, part: str = "source", most_mb: int = 128) -> DataFrame:
    """docs (doc_id, text, part column), labels (doc_id, quality, toxic) -> part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley.

    Null texts count as empty, null parts as the part "". A row without id is no copy of another and none of it, and has no labels; rows equal
    in id and text are copies of the same smaller ids only, not of each other. Of several labels of an id any that says 1 counts. An empty table
    gives no rows. Texts of any length are read whole; other columns are not read, whatever their names.
    """
    return all_orders(mask_counts(docs.select("doc_id", F.coalesce(F.col(part), F.lit("")).alias("part"), "text"), labels, most_mb))


def op11_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All orders of the five filters over all documents, by source."""
    return audit_filters(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


OP11_SQL = r"""
WITH l AS (SELECT doc_id, max((quality = 1)::INT) AS good, max((toxic = 1)::INT) AS toxic FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id),
t AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
d AS (SELECT part, (len(words) < 50)::INT + 2 * (100 * len(list_distinct(words)) < 65 * len(words))::INT + 4 * (100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 5 * length(text))::INT
  + 8 * regexp_matches(text, '[#$%&*|]')::INT + 16 * coalesce(doc_id > min(doc_id) OVER (PARTITION BY text), false)::INT AS mask, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic FROM t LEFT JOIN l USING (doc_id)),
m AS (SELECT part, mask, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM d GROUP BY 1, 2),
f AS (SELECT * FROM (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)) AS f(name, bit)),
o AS (SELECT a.name || b.name || c.name || d.name || e.name AS filter_order, [a.bit, b.bit, c.bit, d.bit, e.bit] AS bits FROM f a, f b, f c, f d, f e WHERE a.bit + b.bit + c.bit + d.bit + e.bit = 31
  AND len(list_distinct([a.bit, b.bit, c.bit, d.bit, e.bit])) = 5),
s AS (SELECT filter_order, i AS step, bits[i] AS bit, coalesce(list_sum(bits[1:i - 1]), 0)::INT AS before FROM o, (SELECT unnest(range(1, 6)) AS i)),
x AS (SELECT m.part, s.bit, sum(m.n) AS shapley FROM m, s WHERE (m.mask & s.bit) <> 0 AND (m.mask & s.before) = 0 GROUP BY 1, 2)
SELECT m.part, s.filter_order, s.step::INT AS step, sum(CASE WHEN (m.mask & (s.bit | s.before)) = 0 THEN n ELSE 0 END)::BIGINT AS kept,
  sum(CASE WHEN (m.mask & s.bit) <> 0 AND (m.mask & s.before) = 0 THEN n ELSE 0 END)::BIGINT AS removed, sum(CASE WHEN (m.mask & s.bit) <> 0 AND (m.mask & s.before) <> 0 THEN n ELSE 0 END)::BIGINT AS redundant,
  sum(CASE WHEN m.mask = s.bit THEN n ELSE 0 END)::BIGINT AS unique_fails, sum(CASE WHEN (m.mask & s.bit) <> 0 AND (m.mask & s.before) = 0 THEN good ELSE 0 END)::BIGINT AS good_lost,
  sum(CASE WHEN (m.mask & s.bit) <> 0 AND (m.mask & s.before) = 0 THEN m.toxic ELSE 0 END)::BIGINT AS toxic_lost, coalesce(any_value(x.shapley), 0)::BIGINT AS shapley
FROM m CROSS JOIN s LEFT JOIN x ON x.part = m.part AND x.bit = s.bit GROUP BY 1, 2, 3
"""
