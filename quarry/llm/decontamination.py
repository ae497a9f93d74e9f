"""Operator 9: benchmark decontamination with an Aho-Corasick automaton over normalised benchmark windows."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm.common import LOWER_ASCII, give_back, materialize, read

#: Bytes that are no part of a word become spaces, A-Z become a-z; every byte keeps its place, so offsets carry over.
_IN_WORD = [48 <= b <= 57 or 97 <= b <= 122 or b >= 128 for b in range(256)]
NORMAL = bytes(LOWER_ASCII[b] if _IN_WORD[LOWER_ASCII[b]] else 32 for b in range(256))

SCAN = "struct<n_words:bigint,n_hit:bigint,items:array<string>,spans:array<struct<start:bigint,end:bigint>>>"
_SCAN_TYPE = pa.struct(
    [("n_words", pa.int64()), ("n_hit", pa.int64()), ("items", pa.list_(pa.string())), ("spans", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))]
)


def words_of(text: str) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(NORMAL).split()


def windows_of(text: str | None, width: int) -> set[bytes]:
    """The item's windows of `width` consecutive words; an item of fewer words, but not none, is one window."""
    words = words_of(text or "")
    if not words:
        return set()
    return {b" ".join(words[i : i + width]) for i in range(max(1, len(words) - width + 1))}


def build_automaton(items: list[tuple[str, str | None]], width: int) -> ahocorasick.Automaton:
    owners: dict[bytes, set[str]] = {}
    for item_id, text in items:
        for window in windows_of(text, width):
            owners.setdefault(window, set()).add(item_id)
    automaton = ahocorasick.Automaton()
    for window, ids in owners.items():
        automaton.add_word(f" {window.decode('latin-1')} ", (len(window) + 2, window.count(b" ") + 1, tuple(sorted(ids))))
    if owners:
        automaton.make_automaton()
    return automaton


def scan(automaton: ahocorasick.Automaton, text: str | None) -> tuple[int, int, list[str], list[tuple[int, int]]]:
    """(words, hit words, items found, hit runs as character offsets into text)."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    normal = raw.translate(NORMAL)
    words = normal.split()
    if not words or not len(automaton):
        return len(words), 0, [], []
    line = f" {b' '.join(words).decode('latin-1')} "
    found = list(automaton.iter(line))
    if not found:
        return len(words), 0, [], []
    spaces = np.flatnonzero(np.frombuffer(line.encode("latin-1"), dtype=np.uint8) == 32)
    change = np.zeros(len(words) + 1, dtype=np.int64)
    items: set[str] = set()
    for end, (length, n, ids) in found:
        first = int(np.searchsorted(spaces, end - length + 1))
        change[first] += 1
        change[first + n] -= 1
        items.update(ids)
    hit = np.cumsum(change[:-1]) > 0
    edges = np.flatnonzero(np.diff(np.concatenate(([0], hit.astype(np.int8), [0]))))
    at = [m.span() for m in re.finditer(rb"[^ ]+", normal)]
    chars = lambda b: len(raw[:b].decode("utf-8", "surrogatepass"))
    spans = [(chars(at[a][0]), chars(at[b - 1][1])) for a, b in zip(edges[::2], edges[1::2], strict=True)]
    return len(words), int(hit.sum()), sorted(items), spans


def _scanner(items: list[tuple[str, str | None]], width: int):
    """An Arrow UDF text -> SCAN. The automaton is built once in each Python worker's task."""

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        automaton = build_automaton(items, width)
        for texts in batches:
            rows = [scan(automaton, t.as_py()) for t in texts]
            yield pa.array([{"n_words": n, "n_hit": h, "items": i, "spans": [{"start": a, "end": b} for a, b in s]} for n, h, i, s in rows], _SCAN_TYPE)
        give_back()

    return F.arrow_udf(run, SCAN).asNondeterministic()


def find_contamination(docs: DataFrame, benchmark: DataFrame, width: int = 13, least_share: float = 0.05, block_bytes: int = 32_000_000) -> DataFrame:
    """Adds n_words, n_hit, items, spans and contaminated to docs (text, ...), scanning each whole text once.

    A document word is hit if it lies inside any occurrence of a window of a benchmark text; spans are the hit runs as character offsets
    into the original text. contaminated: n_hit > 0 and n_hit >= least_share of the words.

    The benchmark goes to every task, so its size is measured first: beyond block_bytes of text it is cut into blocks by a hash of item_id, and the documents are scanned for one block
    after the other. Null and empty texts have no words and are clean; null benchmark texts have no windows; a null item_id counts as the item "null";
    repeated items count once; with an empty benchmark nothing is hit. The five added columns replace columns of the same names.
    """
    added = ["n_words", "n_hit", "items", "spans", "contaminated"]
    out = docs.drop(*added, "_scan", "_scan2")
    items = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("null")).alias("item_id"), "text").where("text is not null")
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, -(-int(total) // block_bytes))
    for block in range(blocks):
        part = [(r[0], r[1]) for r in items.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == block).collect()]
        if block == 0:
            out = out.withColumn("_scan", _scanner(part, width)("text"))
            continue
        if block == 1:
            out = materialize(out, "scan")
        out = materialize(_merged(out.withColumn("_scan2", _scanner(part, width)("text"))), "scan")
    if blocks > 1:
        hit_words = _scanner_words()
        out = out.withColumn("_scan", F.col("_scan").withField("n_hit", hit_words("text", "_scan.spans")))
    return (
        out.withColumns({c: F.col(f"_scan.{c}") for c in ("n_words", "n_hit", "items", "spans")})
        .withColumn("contaminated", (F.col("n_hit") > 0) & (F.col("n_hit") >= F.ceil(F.col("n_words") * F.lit(least_share) - 1e-9)))
        .drop("_scan")
    )


def _merged(df: DataFrame) -> DataFrame:
    both = F.struct(
        F.col("_scan.n_words").alias("n_words"),
        F.col("_scan.n_hit").alias("n_hit"),
        F.array_sort(F.array_union("_scan.items", "_scan2.items")).alias("items"),
        F.array_sort(F.array_union("_scan.spans", "_scan2.spans")).alias("spans"),
    )
    return df.withColumn("_scan", both).drop("_scan2")


def _scanner_words():
    """An Arrow UDF: how many words of the text lie in the union of spans."""

    def run(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for texts, spans in batches:
            out = []
            for t, runs in zip(texts.to_pylist(), spans.to_pylist(), strict=True):
                n, end = 0, 0
                for r in sorted((r["start"], r["end"]) for r in runs or []):
                    start = max(end, r[0])
                    if r[1] > start:
                        n += len(words_of(t[start : r[1]]))
                        end = r[1]
                out.append(n)
            yield pa.array(out, pa.int64())

    return F.arrow_udf(run, "bigint").asNondeterministic()


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    found = find_contamination(docs, read(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_sort("items"), ","), 256).alias("items_sha256"),
        ((F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))).alias("contaminated"),
    )


OP9_SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), i AS (
  SELECT item_id::VARCHAR AS item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), iw AS (
  SELECT DISTINCT item_id, least(len(w), 13) AS n, array_to_string(w[s : s + 12], ' ') AS win
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS s FROM i WHERE len(w) > 0)
), ns AS (
  SELECT DISTINCT n FROM iw
), dw AS (
  SELECT doc_id, s, n, array_to_string(w[s : s + n - 1], ' ') AS win
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS s FROM d, ns WHERE len(w) >= n)
), hits AS (
  SELECT DISTINCT dw.doc_id, dw.s, dw.n, iw.item_id FROM dw JOIN iw ON dw.n = iw.n AND dw.win = iw.win
), pos AS (
  SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(s, s + n)) AS p FROM hits) GROUP BY doc_id
), its AS (
  SELECT doc_id, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT item_id, ',' ORDER BY item_id) AS ids FROM hits GROUP BY doc_id
)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(d.w) AS contaminated
FROM d LEFT JOIN pos USING (doc_id) LEFT JOIN its USING (doc_id)
"""
