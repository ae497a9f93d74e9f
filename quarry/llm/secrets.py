"""Operator 4: secret scan whose false positives a random forest removes. DataFrame functions and Spark's own forest only."""

from __future__ import annotations

import math
import warnings

from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm.common import materialize, read

#: Shapes of keys of known providers (fixed values).
SHAPES = r"(?:AKIA[0-9A-Z]{16}|ghp_[A-Za-z0-9]{36}|sk_live_[A-Za-z0-9]{24,}|xox[abp]-[A-Za-z0-9-]{20,}|AIza[A-Za-z0-9_-]{35}|eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+)"
PROVIDER = f"^{SHAPES}$"
_KEY = rf"(?<![A-Za-z0-9]){SHAPES}(?![A-Za-z0-9])"
#: A word that may hold a secret: twelve or more characters of the alphabets that keys use, with a digit among them, or a provider's key. It is tried only where such a run begins, so texts are read once.
CANDIDATE = rf"(?<![A-Za-z0-9_+/=.@-])(?=[A-Za-z_+/=.@-]*+[0-9])[A-Za-z0-9_+/=.@-]{{12,}}|AKIA[0-9A-Z]{{16}}|{_KEY}"
#: The runs of such a word, from eight characters on, and the values of a run: provider's keys, and what stands between = signs, without names that have no digit.
RUN = CANDIDATE.replace("{12,}", "{8,}", 1)
VALUE = rf"{_KEY}|(?<![A-Za-z0-9_+/.@-])(?:(?=[A-Za-z_+/.@-]*+[0-9])(?:(?!{_KEY})[A-Za-z0-9_+/.@-])++|(?:(?!{_KEY})[A-Za-z_+/.@-])++(?!=+[A-Za-z0-9_+/.@-]))(?:=++(?![A-Za-z0-9_+/.@-]))?"
#: Words that announce a secret, and words that announce an example.
ANNOUNCES = r"(?i)pass|pwd|secret|token|key|auth|bearer|credential"
EXAMPLE = r"(?i)example|sample|dummy|test|placeholder|changeme|xxxx|your"

#: An announcing word's end, the sign that ties it to its value, and a value in whatever signs it has.
_NAMED = rf"(?i:{ANNOUNCES[4:]})[A-Za-z0-9_.-]*[\"'`)\]]*"
_TIE = r"(?:=+>?|:=?|->|>)"
_OPEN = r"[\"'`(\[{<]*"
_ANY = r"([^\s\"'`,;&<>(){}\[\]|]+)"
ASSIGNED = _NAMED + _TIE + _OPEN + _ANY

FEATURES = ["length", "digits", "uppers", "symbols", "transitions", "letter_digit", "distinct", "longest_letters", "coverage", "path_example", "path_config", "before_announces", "before_assigns", "own_announces", "near_example", "quoted", "mail", "dotted"]


def _announced(before: Column, before2: Column) -> Column:
    """Whether the words before tie an announcing word to the next word: password: x, password = x, password is x, --password x, Bearer x."""
    tied = before.rlike(_NAMED + _TIE + _OPEN + "$") | before.rlike(r"(?i)(?:^|[^A-Za-z])bearer$|^--?[a-z_-]*(?:" + ANNOUNCES[4:] + ")[a-z_-]*$")
    return tied | (before.rlike(rf"(?i)^(?:{_TIE}|is|was|basic)$") & before2.rlike(_NAMED + ":?$"))


def _bare(value: Column) -> Column:
    """A value of any signs without those at its edges, if key characters are left alone; otherwise as it is, without full stops at its end."""
    core = F.regexp_replace(value, r"^[^A-Za-z0-9_+/.@-]+|[^A-Za-z0-9_+/=@-]+$", "")
    return F.when(core.rlike(r"^[A-Za-z0-9_+/.@-]+=*$"), core).otherwise(F.regexp_replace(value, r"\.+$", ""))


def find_candidates(docs: DataFrame, path: str | None = "source") -> DataFrame:
    """docs (doc_id, text, path) -> (doc_id, path, nth, part, word, value, before, before2, after): every value of every text that may be a secret.

    nth is the number of the white-space word, part the value's number in it, word the part of the word between the signs , ; & | { } that holds the value. Values are all provider's keys and
    key-like runs of eight characters on in words with a CANDIDATE, whatever signs stand around them. What an announcing word is tied to, by a sign, as a flag, by "is" or as Bearer, is a value without
    a digit or a length. Texts with neither are not split into words.
    """
    words = F.split(F.col("text"), r"[\s]+")
    # Neighbours stand beside each word, so that no word splits the text again.
    beside = F.arrays_zip(words.alias("w"), F.concat(F.array(F.lit("")), words).alias("b"), F.concat(F.array(F.lit(""), F.lit("")), words).alias("b2"), F.slice(words, F.lit(2), F.size(words)).alias("a"))
    near = lambda x: (x["b"].rlike(ANNOUNCES) | x["b2"].rlike(ANNOUNCES)) & _announced(x["b"], x["b2"])
    at = F.transform(
        beside,
        lambda x, i: F.when(
            x["w"].isNotNull() & (x["w"].rlike(CANDIDATE) | x["w"].rlike(ASSIGNED) | near(x)),
            F.struct(i.alias("nth"), x["w"].alias("whole"), x["b"].alias("before"), x["b2"].alias("before2"), F.coalesce(x["a"], F.lit("")).alias("after")),
        ),
    )
    may = F.col("text").rlike(CANDIDATE) | F.col("text").rlike(ANNOUNCES)
    found = docs.where(may).select("doc_id", (F.col(path).cast("string") if path else F.lit("")).alias("path"), F.explode(F.filter(at, lambda x: x.isNotNull())).alias("c")).select("doc_id", "path", "c.*")
    found = found.withColumn("_runs", F.col("whole").rlike(CANDIDATE))

    def values(clause: Column) -> Column:
        runs = F.when(F.col("_runs"), F.regexp_extract_all(clause, F.lit(RUN), F.lit(0))).otherwise(F.array().cast("array<string>"))
        keys = F.flatten(F.transform(runs, lambda r: F.regexp_extract_all(r, F.lit(VALUE), F.lit(0))))
        keys = F.filter(F.transform(keys, lambda v: F.regexp_replace(v, r"\.+$", "")), lambda v: F.length(v) >= 8)
        tied = F.transform(F.regexp_extract_all(clause, F.lit(ASSIGNED), F.lit(1)), _bare)
        return F.transform(F.concat(keys, F.array_except(tied, keys)), lambda v: F.struct(clause.alias("word"), v.alias("value")))

    clauses = F.filter(F.split("whole", r"[,;&|{}]+"), lambda c: c != "")
    inside = F.flatten(F.transform(clauses, values))
    first = _bare(F.regexp_extract("whole", "^" + _OPEN + _ANY, 1))
    found = found.withColumn("_in", inside).withColumn("_first", F.when(_announced(F.col("before"), F.col("before2")) & ~F.col("whole").rlike("(?i)^(?:bearer|basic)$"), first))
    # The word after an announcing word, unless its values are found already.
    extra = F.when(F.col("_first").isNotNull() & (F.size("_in") == 0), F.array(F.struct(F.col("whole").alias("word"), F.col("_first").alias("value")))).otherwise(F.array().cast("array<struct<word:string,value:string>>"))
    every = F.filter(F.concat("_in", extra), lambda x: x["value"] != "")
    return found.select("doc_id", F.coalesce("path", F.lit("")).alias("path"), "nth", "before", "before2", "after", F.posexplode(every).alias("part", "x")).select(
        "doc_id", "path", "nth", "part", "x.word", "before", "before2", "after", "x.value"
    )


def dictionary(docs: DataFrame, share: float = 0.002, least: int = 20) -> DataFrame:
    """(piece): words of three or more letters that stand in at least `share` of all texts, and in no fewer than `least`, which rules below 10 000 texts.

    Counted over whole texts; partial counts come before the shuffle, and each text's repeats fold first.
    """
    letters = F.explode(F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(r"[a-z]{3,}"), F.lit(0)))).alias("piece")
    return docs.select(letters).groupBy("piece").count().where(F.col("count") >= max(least, math.ceil(share * docs.count()))).select("piece")


def describe(candidates: DataFrame, pieces: DataFrame) -> DataFrame:
    """Adds the FEATURES: length, shares and transitions of character kinds, dictionary coverage, the path and the neighbouring words."""
    v, n = F.col("value"), F.length("value")
    share = lambda pattern: F.regexp_count(v, F.lit(pattern)) / n
    kinds = F.regexp_replace(F.regexp_replace(F.regexp_replace(v, "[a-z]", "a"), "[A-Z]", "B"), "[0-9]", "1")
    runs = F.regexp_replace(F.regexp_replace(kinds, r"(.)\1+", "$1"), r"[^aB1]", "s")
    letters = F.regexp_extract_all(F.lower(v), F.lit("[a-z]{3,}"), F.lit(0))
    base = candidates.withColumn("_id", F.sha2(F.concat_ws("\u0001", F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), "nth", "part", "word", "before", "path"), 256))
    # A piece of the value is known if the dictionary has it; distinct pieces are looked up, not every occurrence.
    asked = base.select(F.explode(letters).alias("piece")).distinct().join(pieces, "piece", "left_semi").withColumn("known", F.lit(1))
    covered = (
        base.select("_id", F.explode(F.array_distinct(letters)).alias("piece")).distinct().join(asked, "piece").groupBy("_id").agg(F.sum(F.length("piece")).alias("covered"))
    )
    before = F.concat_ws(" ", "before2", "before")
    out = base.join(covered, "_id", "left")
    return out.select(
        *candidates.columns,
        n.cast("double").alias("length"),
        share("[0-9]").alias("digits"),
        share("[A-Z]").alias("uppers"),
        share("[^A-Za-z0-9]").alias("symbols"),
        ((F.length(runs) - 1) / n).alias("transitions"),
        (F.regexp_count(v, F.lit("(?<=[A-Za-z])[0-9]|(?<=[0-9])[A-Za-z]")) / n).alias("letter_digit"),
        (F.size(F.array_distinct(F.split(v, ""))) / n).alias("distinct"),
        F.coalesce(F.array_max(F.transform(letters, lambda x: F.length(x))).cast("double"), F.lit(0.0)).alias("longest_letters"),
        (F.coalesce("covered", F.lit(0)) / n).alias("coverage"),
        F.col("path").rlike(EXAMPLE).cast("double").alias("path_example"),
        F.col("path").rlike(r"(?i)\.env|config|settings|\.ya?ml|\.properties").cast("double").alias("path_config"),
        before.rlike(ANNOUNCES).cast("double").alias("before_announces"),
        F.col("before").rlike(r"[=:]$").cast("double").alias("before_assigns"),
        F.col("word").rlike(r"^[^=:]*" + ANNOUNCES.replace("(?i)", "(?i:") + r")[^=:]*[=:]").cast("double").alias("own_announces"),
        F.concat_ws(" ", before, "word", "after").rlike(EXAMPLE).cast("double").alias("near_example"),
        F.col("word").rlike("^[\"']").cast("double").alias("quoted"),
        v.contains("@").cast("double").alias("mail"),
        F.regexp_count(v, F.lit(r"\.")).cast("double").alias("dotted"),
    )


def is_announced() -> Column:
    """Whether a candidate's own word, or the words before it, tie an announcing word to it: the rule that opens candidates without a digit or a length."""
    return F.col("word").rlike(ASSIGNED) | _announced(F.col("before"), F.col("before2"))


def heuristic_labels(candidates: DataFrame) -> DataFrame:
    """Adds label to findings that can be told for sure without a model: provider shapes and announced high-digit values are secrets, mail addresses, hosts, dates and numbers are not; null elsewhere.

    The tables hold no labelled findings, so the query trains from these; the operator takes any labelled findings.
    """
    v = F.col("value")
    sure = v.rlike(PROVIDER) | (is_announced() & v.rlike("[0-9].*[0-9].*[0-9]") & ~v.contains("@"))
    never = v.rlike(r"@[a-z0-9.-]+\.[a-z]+$") | v.rlike(r"^[0-9./:+-]+$") | v.rlike(r"^(https?:)?//|^www\.") | F.col("word").rlike(EXAMPLE)
    return candidates.withColumn("label", F.when(sure & ~never, 1.0).when(never, 0.0))


def train_forest(labelled: DataFrame, most_rows: int = 50_000, trees: int = 24, depth: int = 6, seed: int = 11) -> RandomForestClassificationModel | None:
    """A forest from labelled findings (FEATURES, label), of which most_rows are used at most, by a hash (the documented bound). None without any of one label."""
    known = labelled.where("label is not null")
    sizes = {r["label"]: r["count"] for r in known.groupBy("label").count().collect()}
    if len(sizes) < 2:
        return None
    total = sum(sizes.values())
    if total > most_rows:
        known = known.where(F.pmod(F.xxhash64("doc_id", "nth"), F.lit(1_000_000)) < int(1_000_000 * most_rows / total))
    rows = VectorAssembler(inputCols=FEATURES, outputCol="features").transform(known)
    return RandomForestClassifier(labelCol="label", featuresCol="features", numTrees=trees, maxDepth=depth, seed=seed, subsamplingRate=0.8, maxMemoryInMB=64).fit(rows.select("features", "label"))


def score_findings(described: DataFrame, forest: RandomForestClassificationModel | None) -> DataFrame:
    """Adds probability: the forest's share for secret. Without a forest it is told aloud, and only what is sure without one is told apart: 1 and 0 by heuristic_labels, 0.5 for the rest, so that nothing is lost."""
    if forest is None:
        warnings.warn("no labelled findings of both kinds: findings are told apart by rules alone", stacklevel=3)
        return heuristic_labels(described).withColumn("probability", F.coalesce("label", F.lit(0.5))).drop("label")
    rows = VectorAssembler(inputCols=FEATURES, outputCol="features").transform(described)
    out = forest.transform(rows).withColumn("probability", F.round(vector_to_array("probability")[1], 6))
    return out.drop("features", "rawPrediction", "prediction")


def scan_secrets(docs: DataFrame, labelled: DataFrame | None = None, path: str | None = "source", least: float = 0.5) -> DataFrame:
    """docs (doc_id, text, path) -> a row for each candidate: doc_id, nth (word number), part (number in the word), kind, length, value_sha256, probability, kept.

    labelled: (doc_id, nth, label) of known findings, with part where a word holds several; without it the sure ones label themselves, rows held out as in held_out_findings not used. kept is false for what the forest takes for a false positive. Secrets are reported by their hash. Null and empty texts
    have no candidates; repeated rows give repeated findings; an empty table or one without labels of both kinds is judged by the rules alone (1, 0, or 0.5 where they tell nothing), with a warning.
    """
    found = materialize(find_candidates(docs, path), "candidates")
    described = materialize(describe(found, dictionary(docs)), "described")
    if labelled is None:
        rows = heuristic_labels(described).where(~held_out_findings(F.col("doc_id")))
    else:
        known = [c for c in ("doc_id", "nth", "part") if c in labelled.columns]
        rows = described.join(labelled.select(*known, "label"), known)
    scored = score_findings(described, train_forest(rows))
    kind = F.when(F.col("value").rlike(PROVIDER), "provider").when(is_announced(), "assignment").otherwise("generic")
    return scored.select("doc_id", "nth", "part", kind.alias("kind"), F.length("value").alias("length"), F.sha2("value", 256).alias("value_sha256"), "probability", (F.col("probability") >= least).alias("kept"))


def held_out_findings(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


def op4_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_secrets(read(spark, sf_dir, "documents").select("doc_id", "text", "source"))
