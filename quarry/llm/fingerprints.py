"""Document fingerprints by consistent weighted sampling, with DataFrame functions only.

A text is a weighted set: its words, each with the number of times it occurs. For each of 24 samples a term t of weight w draws r and c from
Gamma(2, 1) and b from a uniform law, all three fixed by the term and the sample alone; with s = floor(ln w / r + b) the term's mark is
ln c - r * (s - b + 1). The term with the smallest mark is the sample, and (t, s) is what the fingerprint keeps of it. Two texts agree in a
sample with a probability equal to their generalised Jaccard similarity (sum of smaller weights over sum of larger ones).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarry.llm.common import read

#: Samples of a fingerprint, and how many of them a row of the sampling step takes: with more the code made for a row is too large to be compiled.
SAMPLES, EACH = 24, 2
#: Bytes of text that a bucket of neighbouring documents should hold, and how many buckets there are at most (their bounds pass through the driver).
BUCKET_BYTES, MOST_BUCKETS = 1 << 21, 1 << 16
#: What parts words.
BREAKS = r"[\x20\x09-\x0D]+"
#: Digits of a SHA-256 that fit in a long.
DIGITS = 15


def _below(heads: list[int], key: Column) -> Column:
    """Number of heads (ascending) that are not above key. Looked up in two steps, so that a row meets about twice the root of their number."""
    if not heads:
        return F.lit(0)
    step = max(1, int(len(heads) ** 0.5))
    chunks = [heads[i : i + step] for i in range(0, len(heads), step)]
    at = F.size(F.filter(F.lit([c[0] for c in chunks]), lambda h: h <= key))
    inside = F.element_at(F.array(*[F.lit(c) for c in chunks]), F.greatest(at, F.lit(1)))
    return F.when(at == 0, F.lit(0)).otherwise((at - 1) * step + F.size(F.filter(inside, lambda h: h <= key)))


def neighbours(docs: DataFrame, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """docs (doc_id, text) -> (bucket, row, ghost, doc_id, text, next_text): documents in descending order of doc_id, each with the text that follows.

    After the last document comes the first. Documents without an id come last, by the hash of their text; documents of one id are ordered by
    text, and equal rows follow one another. A null text is empty. The bounds of the buckets come from Spark's own range partitioning of the
    narrow keys. A bucket also holds a ghost, the first document of the bucket after it, so every text moves once and nothing is joined.
    """
    told = docs.agg(F.sum(F.octet_length("text")), F.count(F.when(F.col("doc_id").isNull(), 1))).first()
    parts = int(min(MOST_BUCKETS, 1 + (told[0] or 0) // bucket_bytes))
    key = -1 - F.col("doc_id").cast("long")
    if told[1]:
        key = F.when(F.col("doc_id").isNull(), F.xxhash64("text")).otherwise(key)
    keyed = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).select("doc_id", "text", F.col("doc_id").isNull().alias("nameless"), key.alias("key"))
    ranges = keyed.select("nameless", "key").repartitionByRange(parts, "nameless", "key").groupBy(F.spark_partition_id().alias("part"), "nameless").agg(F.min("key").alias("head")).collect()
    named, nameless = (sorted(r["head"] for r in ranges if r["nameless"] == kind) for kind in (False, True))
    heads = named + nameless or [0]
    bucket = F.greatest(F.lit(0), F.when(F.col("nameless"), len(named) + _below(nameless, F.col("key"))).otherwise(_below(named, F.col("key"))) - 1)
    placed = keyed.withColumn("bucket", bucket.cast("int"))
    step = max(1, int(len(heads) ** 0.5))
    rows = F.array(*[F.lit(heads[i : i + step]) for i in range(0, len(heads), step)])
    head = F.element_at(F.element_at(rows, F.expr(f"bucket div {step}").cast("int") + 1), F.col("bucket") % step + 1)
    here = F.struct(F.col("bucket").alias("bucket"), F.lit(False).alias("ghost"))
    before = F.struct(F.pmod(F.col("bucket") - 1, F.lit(len(heads))).cast("int").alias("bucket"), F.lit(True).alias("ghost"))
    dealt = placed.select("doc_id", "text", "nameless", "key", F.explode(F.when(F.col("key") == head, F.array(here, before)).otherwise(F.array(here))).alias("to"))
    dealt = dealt.select("doc_id", "text", "nameless", "key", F.col("to.bucket").alias("bucket"), F.col("to.ghost").alias("ghost"))
    order = Window.partitionBy("bucket").orderBy("ghost", "nameless", "key", "text")
    return dealt.select("bucket", F.row_number().over(order).alias("row"), "ghost", "doc_id", "text", F.lead("text").over(order).alias("next_text"))


def _uniform(bits: Column, at: int, width: int) -> Column:
    """`width` bits from place `at` on as a number strictly between 0 and 1."""
    return (F.shiftrightunsigned(bits, at).bitwiseAND((1 << width) - 1) + F.lit(0.5)) / float(1 << width)


def _packed(log_weight: str, sample: int) -> Column:
    """Mark and sample in one long: the mark, in steps of 2^-24 from -64 on, above 32 bits that tell (term, s). Null without weight."""
    r, b, ln_c = (F.col(f"{name}{sample}") for name in ("r", "b", "c"))
    s = F.floor(F.col(log_weight) / r + b)
    mark = ((ln_c - r * (s - b + 1) + 64) * float(1 << 24)).cast("long")
    kept = F.col("term").bitwiseAND(0xFFFFFFFF).bitwiseXOR(s.bitwiseAND(4095) * 1048573)
    return F.shiftleft(F.greatest(F.lit(0), mark), 32).bitwiseOR(kept)


def _drawn(weights: DataFrame, sides: int) -> DataFrame:
    """weights (bucket, row, term, fact, w0, w1 ...) -> a row for each term and block, with the packed mark v<side>_<sample> of each of its samples.

    The steps stand apart so that hash, laws and logarithms of weights are computed once, and a row's code stays small enough to be compiled.
    """
    logs = weights.select("bucket", "row", "term", "fact", *[F.when(F.col(f"w{i}") > 0, F.ln(f"w{i}")).alias(f"l{i}") for i in range(sides)])
    blocks = logs.select("*", F.explode(F.lit(list(range(SAMPLES // EACH)))).alias("block"))
    bits = blocks.select("*", *[F.xxhash64("term", "block", F.lit(s)).alias(f"x{s}") for s in range(EACH)])
    laws = []
    for s in range(EACH):
        x = F.col(f"x{s}")
        laws.append((-F.ln(_uniform(x, 0, 10) * _uniform(x, 10, 10))).alias(f"r{s}"))
        laws.append(_uniform(x, 20, 12).alias(f"b{s}"))
        laws.append(F.ln(-F.ln(_uniform(x, 32, 16) * _uniform(x, 48, 16))).alias(f"c{s}"))
    drawn = bits.select("bucket", "row", "block", "term", "fact", *[f"l{i}" for i in range(sides)], *laws)
    return drawn.select("bucket", "row", "block", "term", "fact", *[_packed(f"l{i}", s).alias(f"v{i}_{s}") for i in range(sides) for s in range(EACH)])


def likeness(a: Column, b: Column) -> Column:
    """Share of equal samples of two fingerprints given as arrays."""
    return F.size(F.filter(F.zip_with(a, b, lambda x, y: x == y), lambda same: same)) / float(SAMPLES)


def _text_of(marks: Column) -> Column:
    return F.array_join(F.transform(marks, lambda m: F.lpad(F.lower(F.hex(m)), 8, "0")), "")


def fingerprints(texts: DataFrame, sides: list[str], facts: list[Column]) -> DataFrame:
    """texts (bucket, row, and the string columns `sides`) -> (bucket, row, facts array<long>, marks_<side> array<long> for each side).

    facts: whole numbers that go along with a row. Terms are counted and samples taken where the rows lie: with texts dealt by bucket no step
    below moves anything. A side that is null or holds no word has only zeros for samples, so two of them agree and no other agrees with them.
    """
    held = [F.struct(F.lit(i).alias("side"), F.split(side, BREAKS).alias("words")) for i, side in enumerate(sides)]
    held.append(F.struct(F.lit(len(sides)).alias("side"), F.array(*[f.cast("string") for f in facts]).alias("words")))
    each = texts.select("bucket", "row", F.explode(F.array(*held)).alias("held")).select("bucket", "row", "held.side", F.posexplode("held.words").alias("pos", "word"))
    is_fact = F.col("side") == len(sides)
    terms = each.where(is_fact | (F.col("word") != "")).select(
        "bucket", "row", "side", F.when(is_fact, F.col("word").cast("long")).otherwise(F.xxhash64("word")).alias("term"), F.when(is_fact, F.col("pos") + 1).otherwise(0).alias("fact")
    )
    weights = terms.groupBy("bucket", "row", "term", "fact").agg(*[F.sum(F.when((F.col("side") == i) & (F.col("fact") == 0), 1).otherwise(0)).alias(f"w{i}") for i in range(len(sides))])
    marks = [f"v{i}_{s}" for i in range(len(sides)) for s in range(EACH)]
    told = [F.max(F.when(F.col("fact") == i + 1, F.col("term"))).alias(f"f{i}") for i in range(len(facts))]
    by_block = _drawn(weights, len(sides)).groupBy("bucket", "row", "block").agg(*[F.min(v).alias(v) for v in marks], *told)
    own = [F.array(*[F.coalesce(F.col(f"v{i}_{s}").bitwiseAND(0xFFFFFFFF), F.lit(0)) for s in range(EACH)]).alias(f"m{i}") for i in range(len(sides))]
    rows = by_block.groupBy("bucket", "row").agg(F.sort_array(F.collect_list(F.struct("block", *own))).alias("all"), F.first(F.array(*[f"f{i}" for i in range(len(facts))])).alias("facts"))
    return rows.select("bucket", "row", "facts", *[F.flatten(F.col(f"all.m{i}")).alias(f"marks_{side}") for i, side in enumerate(sides)])


def fingerprint_documents(docs: DataFrame, share: int = 3, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """docs (doc_id long, text, ...) -> doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next: one row for each row.

    The edited text gives up its last floor(n_chars / share) code points for the first as many of the next document (see neighbours). Other
    columns of docs are not read, whatever their names. Null texts count as empty; texts without a word are alike to each other (1.0) and to no
    other text; repeated rows have a row each; an empty table gives no rows. Texts of any length are taken whole: a word is a row of an
    aggregation that spills, none is held as a list beyond its own text.
    """
    near = neighbours(docs, bucket_bytes)
    n = F.length("text")
    cut = F.floor(n / share).cast("int")
    edited = F.concat(F.left("text", n - cut), F.left(F.coalesce("next_text", F.lit("")), cut))
    texts = near.select("bucket", "row", F.col("ghost").cast("long").alias("ghost"), "doc_id", n.alias("n_chars"), "text", edited.alias("edited"))
    sha = F.sha2("edited", 256)
    pieces = [F.conv(F.substring(sha, 1 + at, DIGITS), 16, 10) for at in range(0, 64, DIGITS)]
    prints = fingerprints(texts, ["text", "edited"], [F.col("ghost"), F.col("doc_id"), F.col("n_chars"), *pieces])
    order = Window.partitionBy("bucket").orderBy("row")
    both = prints.select("*", F.lead("marks_text").over(order).alias("marks_next")).where(F.col("facts")[0] == 0)
    widths = [min(DIGITS, 64 - at) for at in range(0, 64, DIGITS)]
    digest = F.concat(*[F.lpad(F.lower(F.hex(F.col("facts")[3 + i])), w, "0") for i, w in enumerate(widths)])
    return both.select(
        F.col("facts")[1].alias("doc_id"),
        F.col("facts")[2].alias("n_chars"),
        digest.alias("edited_sha256"),
        _text_of(F.col("marks_text")).alias("fingerprint"),
        _text_of(F.col("marks_edited")).alias("edited_fingerprint"),
        likeness(F.col("marks_text"), F.col("marks_edited")).alias("near_edited"),
        likeness(F.col("marks_text"), F.col("marks_next")).alias("near_next"),
    )


def op13_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of all documents and of their edited texts."""
    return fingerprint_documents(read(spark, sf_dir, "documents"))
