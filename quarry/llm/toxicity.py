"""Operator 2: toxicity after noisy-channel deobfuscation.

Obfuscated words are restored by Viterbi search in a lattice of characters (look-alike digits and signs, stretched letters, spread-out letters) under a
character language model counted over the whole corpus; the restored text is scored.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm.common import give_back, materialize, mix64, read, release

#: Signs that stand for letters in disguised words (fixed values).
LOOKALIKES = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "il", "|": "il", "+": "t", "(": "c",
    "<": "c", "€": "e", "£": "l", "¡": "i", "§": "s", "*": "abcdefghijklmnopqrstuvwxyz", "#": "abcdefghijklmnopqrstuvwxyz",
}
#: Signs that may be strewn between the letters of a word and mean nothing (fixed values).
FILLERS = ".-_*~'`^·,/\\"
#: Natural-log costs of the channel: a look-alike, a filler dropped, a stretched letter cut to two or to one, a gap closed or kept.
COSTS = {"lookalike": -0.7, "filler": -0.3, "two": -0.3, "one": -0.2, "close": -0.1, "gap": -2.5}

CLASSES = 28  # 0: edge of a word, 1 to 26: a to z, 27: any other letter
_EDGES = FILLERS + "!?:;\"()[]{}<>«»…¿¡|%&#=^"
#: Of these the ones that stand for no letter: only they are surely punctuation.
_OUTER = "".join(c for c in _EDGES if c not in LOOKALIKES)
#: A run of * or # up to this length may mask as many letters; a longer one is an ornament.
MASK = 12
_TAIL = re.compile(r"([^\w\s])\1{2,}\Z")
_LETTER = re.compile(r"[^\W\d_]")
_WORD = re.compile(r"[^\W\d_]+")
_PLAIN = re.compile(r"[^\W\d_]+\Z")
_STRETCHED = re.compile(r"([^\W\d_])\1\1")
_SPREAD = re.compile(r"(?<!\S)\S(?:[ \t]{1,2}\S){3,}(?!\S)")


def char_class(c: str) -> int:
    if c == " ":
        return 0
    return ord(c) - 96 if "a" <= c <= "z" else 27


@dataclass
class CharModel:
    """Trigrams of character classes, interpolated with bigrams and unigrams; logp[a, b, c] = log P(c | a b)."""

    logp: np.ndarray

    @classmethod
    def from_counts(cls, counts: np.ndarray) -> CharModel:
        three = counts.reshape(CLASSES, CLASSES, CLASSES).astype(np.float64)
        two, one = three.sum(axis=0), three.sum(axis=(0, 1))
        uni = (one + 1) / (one.sum() + CLASSES)
        bi = (two + 5 * uni[None, :]) / (two.sum(axis=1, keepdims=True) + 5)
        tri = (three + 5 * bi[None, :, :]) / (three.sum(axis=2, keepdims=True) + 5)
        return cls(np.log(tri))


def lattice(span: str, letters_at_edges: bool = False) -> list[list[tuple[str, float]]]:
    """Positions of the span, each with the strings it may stand for and their costs. A look-alike at an edge may be punctuation, unless letters_at_edges."""
    out: list[list[tuple[str, float]]] = []
    i = 0
    while i < len(span):
        c, j = span[i], i + 1
        while j < len(span) and span[j] == c:
            j += 1
        n = j - i
        if c in " \t":
            out.append([("", COSTS["close"]), (" ", COSTS["gap"])] if n == 1 else [(" ", 0.0)])
        elif _LETTER.match(c):
            out.append([(c, 0.0)] if n == 1 else [(c * 2, 0.0 if n == 2 else COSTS["two"]), (c, -2.0 if n == 2 else COSTS["one"])])
        else:
            inner = 0 < i and j < len(span)
            masks = c in "*#"
            for _ in range((n if n <= MASK else 0) if masks else min(n, 2)):
                options = [(x, COSTS["lookalike"] - (2.0 if masks else 0.0)) for x in LOOKALIKES.get(c, "")]
                if c in FILLERS or not options or not inner and not letters_at_edges or out and n > 1:
                    options.append(("", COSTS["filler"] - (1.5 if c in LOOKALIKES and inner else 0.0)))
                out.append(options)
        i = j
    return out


def viterbi(positions: list[list[tuple[str, float]]], model: CharModel) -> str:
    """The most probable reading: states are the classes of the last two characters."""
    logp = model.logp
    states: dict[tuple[int, int], tuple[float, tuple]] = {(0, 0): (0.0, ())}
    for options in positions:
        reached: dict[tuple[int, int], tuple[float, tuple]] = {}
        for (a, b), (score, path) in states.items():
            for string, cost in options:
                s, x, y = score + cost, a, b
                for ch in string:
                    k = char_class(ch)
                    s += logp[x, y, k]
                    x, y = (0, 0) if k == 0 else (y, k)
                if (x, y) not in reached or s > reached[x, y][0]:
                    reached[x, y] = (s, (path, string) if string else path)
        states = reached
    best = max(states.items(), key=lambda kv: (kv[1][0] + logp[kv[0][0], kv[0][1], 0], kv[0]))
    parts, path = [], best[1][1]
    while path:
        path, string = path
        parts.append(string)
    return "".join(reversed(parts))


def core_of(token: str) -> str:
    """The token without signs at its edges that stand for no letter and without a run of one sign at its end."""
    return _TAIL.sub("", token.strip(_OUTER)).strip(_OUTER)


def suspicious(token: str) -> bool:
    """Whether a token without white space may be disguised: letters along with signs inside, or a letter three times in a row."""
    if _PLAIN.match(token):
        return bool(_STRETCHED.search(token))
    core = core_of(token)
    return bool(_LETTER.search(core)) and not _PLAIN.match(core) or bool(_STRETCHED.search(core))


def at_edge(token: str) -> bool:
    """Whether a look-alike stands at an edge of the token: it may be a letter of the word. A mark after a word is punctuation."""
    return token[0] in LOOKALIKES or token[-1] in LOOKALIKES and token[-1] != "!"


def edged(token: str, word: str) -> bool:
    return len(word) < len(token) and at_edge(token)


class Restorer:
    """Restores tokens and spread-out runs; remembers the tokens it has seen, up to a bound."""

    def __init__(self, model: CharModel, most: int = 200_000):
        self.model, self.most, self.seen = model, most, {}

    def token(self, token: str) -> str:
        found = self.seen.get(token)
        if found is None:
            if len(self.seen) >= self.most:
                self.seen.clear()
            found = self.seen[token] = viterbi(lattice(core_of(token)), self.model) if suspicious(token) else token
        return found

    def at_edges(self, token: str) -> str:
        """The reading in which look-alikes at the edges are letters of the word."""
        return viterbi(lattice(core_of(token), True), self.model)

    def spread(self, text: str) -> list[str]:
        """Readings of runs of four or more single characters with gaps between them."""
        return [viterbi(lattice(m.group(0)), self.model) for m in _SPREAD.finditer(text)]

    def text(self, text: str | None) -> str:
        """The whole text, lower-cased, its disguised parts restored."""
        low = (text or "").lower()
        low = _SPREAD.sub(lambda m: viterbi(lattice(m.group(0)), self.model), low)
        return re.sub(r"\S+", lambda m: self.token(m.group(0)) if suspicious(m.group(0)) else m.group(0), low)


#: Words are inflected at their ends, so their first letters count as features too.
PREFIXES = (4, 5, 6, 7, 8)


def stem_of(feature: str) -> str:
    return feature.split("#")[0].removeprefix("=")[:4]


def features_of(words: set[str]) -> set[str]:
    """Features of a document from its distinct words: each word, and each beginning of words, marked too if several words have it."""
    starts = Counter(w[:n] for w in words for n in PREFIXES if len(w) > n)
    return {f"={w}" for w in words} | {f"{p}#1" for p in starts} | {f"{p}#2" for p, n in starts.items() if n > 1}


def word_counts(texts: DataFrame) -> DataFrame:
    """(word, n) over all whole texts: lower-cased runs without white space; counted in each task, then summed."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter[str] = Counter()

        def out() -> pa.RecordBatch:
            batch = pa.record_batch([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], ["word", "n"])
            counts.clear()
            return batch

        for batch in batches:
            for text in batch.column(0):
                counts.update((text.as_py() or "").lower().split())
                if len(counts) > 100_000:
                    yield out()
        yield out()
        give_back()

    return texts.select("text").mapInArrow(count, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n"))


def train_char_model(texts: DataFrame) -> CharModel:
    """Counts all words of the corpus, then the trigrams of those that are letters only, weighed by their counts.

    The words are shuffled and grow with the corpus; the driver gets at most 28^3 sums.
    """

    def trigrams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(CLASSES**3)
        for batch in batches:
            for word, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                word = word.strip(_EDGES)
                if not _PLAIN.match(word):
                    continue
                k = [0, 0, *map(char_class, word), 0]
                for x, y, z in zip(k, k[1:], k[2:], strict=False):
                    sums[(x * CLASSES + y) * CLASSES + z] += n
        some = np.flatnonzero(sums)
        yield pa.record_batch([pa.array(some, pa.int64()), pa.array(sums[some], pa.float64())], ["k", "n"])

    rows = word_counts(texts).mapInArrow(trigrams, "k bigint, n double").groupBy("k").agg(F.sum("n").alias("n")).collect()
    counts = np.zeros(CLASSES**3)
    for k, n in rows:
        counts[k] = n
    return CharModel.from_counts(counts)


@dataclass
class ToxicityModel:
    chars: CharModel
    base: float = 0.05
    weights: dict[str, float] = field(default_factory=dict)  # feature -> probability that a document with it is toxic


class Scorer:
    """Scores texts. Plain words, nearly all, are looked up directly; tokens that may be disguised are restored and remembered."""

    def __init__(self, model: ToxicityModel):
        self.model, self.restorer, self.hits = model, Restorer(model.chars), {}
        self.stems = {stem_of(f) for f in model.weights}
        self.ranked = {f: (stem_of(f), i, p) for i, (f, p) in enumerate(model.weights.items())}

    def disguised(self, token: str) -> tuple[str, ...]:
        hit = self.hits.get(token)
        if hit is None:
            if len(self.hits) >= 200_000:
                self.hits.clear()
            more = _WORD.findall(self.restorer.at_edges(token)) if at_edge(token) else ()
            hit = self.hits[token] = tuple({*_WORD.findall(self.restorer.token(token)), *_WORD.findall(token), *more})
        return hit

    def score(self, text: str | None) -> float:
        low = (text or "").lower()
        stems = self.stems
        stretched = bool(_STRETCHED.search(low))
        words: set[str] = set()
        for token in set(low.split()):
            word = token if token.isalpha() else token.strip(_EDGES)
            if word.isalpha() and not (stretched and _STRETCHED.search(word)):
                if word[:4] in stems:
                    words.add(word)
                if edged(token, word):
                    words.update(self.disguised(token))
            elif word:
                words.update(self.disguised(token))
        for run in self.restorer.spread(low):
            words.update(_WORD.findall(run))
        return self.combine(features_of({w for w in words if w[:4] in stems}))

    def combine(self, features: set[str]) -> float:
        """Noisy-or over the stems found; of the features of one stem the one that was chosen first counts."""
        first: dict[str, tuple[int, float]] = {}
        for f in features:
            if f in self.ranked:
                stem, i, p = self.ranked[f]
                if stem not in first or i < first[stem][0]:
                    first[stem] = (i, p)
        rest = 1 - self.model.base
        for stem in sorted(first):
            rest *= 1 - first[stem][1]
        return 1 - rest


def document_features(restorer: Restorer, text: str | None) -> set[str]:
    low = (text or "").lower()
    words: set[str] = set()
    for token in set(low.split()):
        word = token if token.isalpha() else token.strip(_EDGES)
        if word.isalpha() and not _STRETCHED.search(word):
            words.add(word)
        if not word.isalpha() or _STRETCHED.search(word) or edged(token, word):
            words.update(_WORD.findall(restorer.token(token)))
            if at_edge(token):
                words.update(_WORD.findall(restorer.at_edges(token)))
    for run in restorer.spread(low):
        words.update(_WORD.findall(run))
    return features_of(words)


def _shingles(text: str | None) -> np.ndarray:
    words = (text or "").lower().split()
    return np.fromiter((xxhash.xxh3_64_intdigest(" ".join(words[i : i + 5])) for i in range(max(1, len(words) - 4))), np.uint64)


def fit(labelled: DataFrame, chars: CharModel, most_rows: int = 20_000, most_features: int = 20_000) -> ToxicityModel:
    """labelled (doc_id, text, toxic) -> a noisy-or model over few features.

    A sample of most_rows labelled rows at most, drawn by a hash of doc_id, is used (the documented bound). Features are counted in it by task; the most_features that tell most go on, and
    _choose keeps those beyond chance, with copies of one text counted as one.
    """
    rows = labelled.count()
    if rows > most_rows:
        labelled = labelled.where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < int(1_000_000 * most_rows / rows))
    labelled = materialize(labelled.select("text", F.col("toxic").cast("int").alias("toxic")).repartition(24), "labelled")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        restorer = Restorer(chars)
        sums: tuple[Counter, Counter] = (Counter(), Counter())
        for batch in batches:
            for text, toxic in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
                sums[toxic].update(document_features(restorer, text.as_py()))
        names = list(sums[1])
        yield pa.record_batch([pa.array(names, pa.string()), pa.array([sums[1][x] for x in names], pa.int64()), pa.array([0] * len(names), pa.int64())], ["f", "t", "c"])
        names = list(sums[0])
        yield pa.record_batch([pa.array(names, pa.string()), pa.array([0] * len(names), pa.int64()), pa.array([sums[0][x] for x in names], pa.int64())], ["f", "t", "c"])

    totals = {r["toxic"]: r["count"] for r in labelled.groupBy("toxic").count().collect()}
    n1, n0 = totals.get(1, 0), totals.get(0, 0)
    if not n1:
        release(labelled)
        return ToxicityModel(chars, base=0.5 / (n0 + 1))
    rate = n1 / (n1 + n0)
    counts = labelled.mapInArrow(count, "f string, t bigint, c bigint").groupBy("f").agg(F.sum("t").alias("t"), F.sum("c").alias("c"))
    counts = materialize(counts, "features")
    t, c = F.col("t"), F.col("c")
    share = (t + 0.01) / (t + c + 0.02)
    gain = t * F.log(share / rate) + c * F.log((1 - share) / (1 - rate))
    kept = counts.where((t >= 3) & (share > 2 * rate)).withColumn("g", F.round(gain, 6)).orderBy(F.desc("g"), "f").limit(most_features)
    names = [r["f"] for r in kept.select("f").collect()]
    index = {f: i for i, f in enumerate(names)}

    def present(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        restorer = Restorer(chars)
        for batch in batches:
            texts, toxic = batch.column(0), batch.column(1)
            own, keys = [], []
            for x in texts:
                features = document_features(restorer, x.as_py())
                own.append(sorted(index[f] for f in features if f in index))
                hashes = _shingles(x.as_py())
                keys.append([int(mix64(hashes ^ np.uint64(i)).min() >> np.uint64(1)) if len(hashes) else i for i in range(4)])
            yield pa.record_batch([pa.array(own, pa.list_(pa.int32())), pa.array(keys, pa.list_(pa.int64())), toxic.cast(pa.int32())], ["own", "keys", "toxic"])

    seen = labelled.mapInArrow(present, "own array<int>, keys array<bigint>, toxic int").groupBy("own", "keys", "toxic").count().collect()
    features = counts.count()
    release(labelled, counts)
    return ToxicityModel(chars, *_choose(names, [(r["own"], r["keys"], r["toxic"], r["count"]) for r in seen], features))


def _choose(names: list[str], rows: list[tuple[list[int], list[int], int, int]], features: int) -> tuple[float, dict[str, float]]:
    """rows (features held, min-hashes, toxic, copies) -> base rate and the chosen features' probabilities.

    Documents that share any of their min-hashes with many others are copies of one text and share one document's weight. Features are grouped by stem. In a group they are chosen
    one by one, each for what it tells about documents that no earlier one of its stem covers, as long as that is beyond what chance does among that many features; its probability is that among those documents.
    """
    sizes: Counter[tuple[int, int]] = Counter()
    for _, keys, _, n in rows:
        sizes.update({(i, k): n for i, k in enumerate(keys)})
    weight = np.array([n / max([1, *(sizes[i, k] for i, k in enumerate(keys))]) for _, keys, _, n in rows])
    toxic = np.array([y for _, _, y, _ in rows], dtype=float)
    rate = (weight * toxic).sum() / weight.sum()
    holders: list[list[int]] = [[] for _ in names]
    for d, (own, _, _, _) in enumerate(rows):
        for f in own:
            holders[f].append(d)
    groups: dict[str, list[int]] = {}
    for i, name in enumerate(names):
        groups.setdefault(stem_of(name), []).append(i)
    least = math.log(features + 1) + 4.0
    chosen: dict[str, float] = {}
    covered = np.zeros(len(rows), dtype=bool)
    for stem in sorted(groups):
        own_covered = np.zeros(len(rows), dtype=bool)
        while True:
            best = None
            for i in groups[stem]:
                docs = [d for d in holders[i] if not own_covered[d]]
                t = (weight[docs] * toxic[docs]).sum()
                c = weight[docs].sum() - t
                share = (t + 0.01) / (t + c + 0.02)
                if share > 2 * rate:
                    gain = t * math.log(share / rate) + c * math.log((1 - share) / (1 - rate))
                    if gain >= least and (best is None or (round(gain, 6), len(names[i]), names[i]) > best[0]):
                        best = ((round(gain, 6), len(names[i]), names[i]), i, float((t + 0.5) / (t + c + 1)))
            if best is None:
                break
            chosen[names[best[1]]] = best[2]
            own_covered[holders[best[1]]] = True
        covered |= own_covered
    base = ((weight * toxic)[~covered].sum() + 0.5) / (weight[~covered].sum() + 10)
    return min(float(base), 0.2), chosen


def score_documents(docs: DataFrame, model: ToxicityModel, least: float = 0.3) -> DataFrame:
    """Adds score (0 to 1) and predicted to docs (text, ...). Null and empty texts get the base rate of documents without toxic words."""

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        scorer = Scorer(model)
        for texts in batches:
            yield pa.array([scorer.score(t.as_py()) for t in texts], pa.float64())
        give_back()

    score = F.arrow_udf(run, "double").asNondeterministic()
    return docs.drop("score", "predicted").withColumn("score", score("text")).withColumn("predicted", (F.col("score") >= least).cast("int"))


def restored(docs: DataFrame, chars: CharModel) -> DataFrame:
    """Adds restored: the whole text lower-cased, with its disguised words read as plain ones; null stays null."""

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        restorer = Restorer(chars)
        for texts in batches:
            yield pa.array([None if not t.is_valid else restorer.text(t.as_py()) for t in texts], pa.string())

    return docs.withColumn("restored", F.arrow_udf(run, "string").asNondeterministic()("text"))


def held_out(doc_id: Column) -> Column:
    """Rows whose labels are never learnt from."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


def train(docs: DataFrame, labels: DataFrame) -> ToxicityModel:
    """docs (doc_id, text), labels (doc_id, toxic): the character model from all docs, the classifier from labels of rows that aren't held out.

    Labels with null doc_id, and those whose toxic is neither 0 nor 1, are left out; a doc_id labelled twice counts as toxic if either label says so, and a repeated row counts as often as it stands there.
    With few labelled rows no feature is beyond chance, and every document gets the same score.
    """
    chars = train_char_model(docs)
    known = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1) & ~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    return fit(docs.select("doc_id", "text").join(known, "doc_id"), chars)


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    model = train(docs, read(spark, sf_dir, "labels"))
    return score_documents(docs, model).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")
