"""Operator 6: removal of repeated byte strings by longest-previous-factor arrays.

A position is a repeat if the `least` bytes from it also start elsewhere. Documents are too many for one suffix array, so each window of `least` bytes is assigned to an anchor inside it that depends on the window's bytes
alone: the first position whose K-byte hash is smallest. Equal windows have equal anchors at equal offsets, so windows that could be equal meet in the anchor's bucket and nowhere else.

An anchor's windows lie in one span of bytes. Equal spans form a class, of which one member is compared and the others are settled with it. The classes of an anchor go through suffix order: their windows
are sorted as suffixes to the depth `least`, the previous and next smaller positions in that order give the longest previous factor of each, and the mirror image the longest later factor.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.llm.common import give_back, materialize, materialize_kinds, mix64, read, release

LEAST = 200
K = 64
_SLAB = 262_144
_CHUNK = 4_000_000
_POS = np.uint64((1 << 24) - 1)
_TURN = np.uint64(0x9E3779B97F4A7C15)
_TABLE = mix64(np.arange(1, 257, dtype=np.uint64) * _TURN)
_BASE = 0xD6E8FEB86659FD93
_UNBASE = pow(_BASE, -1, 1 << 64)


def gram_hashes(raw: bytes, at: int, end: int) -> np.ndarray:
    """A hash of the K = 64 bytes from each position of raw[at:end], by doubling from the eight bytes that stand there."""
    h = np.ndarray((end - at - 7,), "<u8", raw, at, strides=(1,)).copy()
    with np.errstate(over="ignore"):
        h *= _TURN
        h ^= h >> np.uint64(29)
        width = 8
        while width < K:
            h = h[:-width] * _TURN + h[width:]
            h ^= h >> np.uint64(31)
            width *= 2
    return h


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    w, m = 1, x
    while 2 * w <= width:
        m = np.minimum(m[:-w], m[w:])
        w *= 2
    return np.minimum(m[: len(m) - (width - w)], m[width - w :]) if width > w else m


def anchors(raw: bytes, ends: list[int], least: int = LEAST) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash, anchor, first window, last window) of texts that end at `ends` in raw: every window of `least` bytes inside a text belongs to one anchor."""
    n = len(raw)
    inside = np.ones(max(n - least + 1, 0), bool)
    for end in ends:
        inside[max(end - least + 1, 0) : end] = False
    parts = []
    for base in range(0, len(inside), _CHUNK):
        own = np.flatnonzero(inside[base : base + _CHUNK])
        if not len(own):
            continue
        windows = int(own[-1]) + 1
        h = gram_hashes(raw, base, base + windows + least - 1)
        key = (h & ~_POS) | np.arange(len(h), dtype=np.uint64)
        at = (sliding_min(key, least - K + 1)[own] & _POS).astype(np.int64)
        new = np.concatenate(([True], (at[1:] != at[:-1]) | (own[1:] != own[:-1] + 1)))
        first = np.flatnonzero(new)
        last = np.append(first[1:], len(own)) - 1
        parts.append((h[at[first]], at[first] + base, own[first] + base, own[last] + base))
    if not parts:
        z = np.zeros(0, np.int64)
        return z.astype(np.uint64), z, z, z
    return tuple(np.concatenate(c) for c in zip(*parts, strict=True))


def suffix_order(text: np.ndarray, starts: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """The suffixes at `starts`, cut at `depth` bytes: (order, lcp). Equal ones stand by their place in `starts`; lcp is what each shares with the one before.

    Any order in which common prefixes stand together serves factors, so suffixes are ordered by 64-bit names of their first quarter, half and whole depth; lcp is told in these steps. text must hold
    depth bytes from each start.
    """
    with np.errstate(over="ignore"):
        powers = np.cumprod(np.full(len(text), _BASE, np.uint64))
        sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(_TABLE[text] * powers)))
        back = np.cumprod(np.full(len(text), _UNBASE, np.uint64))[starts]
        steps = [depth // 4, depth // 2, depth]
        names = [mix64((sums[starts + d] - sums[starts]) * back) for d in steps]
    order = np.lexsort(names[::-1])
    lcp, same = np.zeros(len(order), np.int64), np.ones(max(len(order) - 1, 0), bool)
    for d, name in zip(steps, names, strict=True):
        sorted_name = name[order]
        same &= sorted_name[1:] == sorted_name[:-1]
        lcp[1:][same] = d
    return order, lcp


def smaller_before(order: np.ndarray, lcp: np.ndarray) -> np.ndarray:
    """For each entry the common prefix with the nearest entry before it that has a smaller position: the previous smaller positions by jumps along those already known."""
    at = np.arange(len(order)) - 1
    low = lcp.copy()
    todo = np.flatnonzero(low > 0)
    todo = todo[order[at[todo]] > order[todo]]
    while len(todo):
        via = at[todo]
        low[todo] = np.minimum(low[todo], low[via])
        at[todo] = at[via]
        open_ = low[todo] > 0
        todo = todo[open_]
        todo = todo[order[at[todo]] > order[todo]]
    return low


def longest_factors(order: np.ndarray, lcp: np.ndarray) -> np.ndarray:
    """Longest previous factors by position: the longer of the common prefixes with the previous and with the next smaller position in suffix order."""
    turned = np.concatenate((np.zeros(1, np.int64), lcp[:0:-1])) if len(lcp) else lcp
    both = np.maximum(smaller_before(order, lcp), smaller_before(order[::-1], turned)[::-1])
    out = np.zeros(len(order), np.int64)
    out[order] = both
    return out


def merged(key: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs [start, end) by key, those that touch made one."""
    if not len(key):
        return key, start, end
    by = np.lexsort((start, key))
    key, start, end = key[by], start[by], end[by]
    # Ends grow along a key if each counts from the key's first run on; keys are told apart by adding a stride.
    group = np.cumsum(np.concatenate(([False], key[1:] != key[:-1])))
    stride = int(end.max()) + 2
    reach = np.maximum.accumulate(end + group * stride)
    new = np.concatenate(([True], start[1:] + group[1:] * stride > reach[:-1]))
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(key)) - 1
    return key[first], start[first], reach[last] - group[last] * stride


#: kind 0: anchors of a bucket (h, span, key, pos, before, after, many); 1: runs of a key bucket (key, start, end); 2: spans to be compared of a key bucket (state, h, key, first, windows); 3: anchors with many classes (h, n).
_PACKED = [("kind", T.IntegerType()), ("bucket", T.LongType()), *((c, T.BinaryType()) for c in "abcdefg")]
_PACKED_SQL = T.StructType([T.StructField(n, t) for n, t in _PACKED])
_PACKED_TYPE = pa.schema([("kind", pa.int32()), ("bucket", pa.int64()), *((c, pa.binary()) for c in "abcdefg")])
_ANCHOR_TYPES = (np.uint64, np.uint64, np.int64, np.int64, np.int16, np.int16, np.uint8)
_RUN_TYPES = (np.int64, np.int64, np.int64)
_SPAN_TYPES = (np.int8, np.uint64, np.int64, np.int64, np.int16)


def _packed(kind: int, bucket: np.ndarray, *columns: np.ndarray) -> pa.RecordBatch:
    """A row for each bucket, with its part of the columns as bytes."""
    by = np.argsort(bucket, kind="stable")
    bucket, columns = bucket[by], [c[by] for c in columns]
    cut = np.flatnonzero(np.concatenate(([True], bucket[1:] != bucket[:-1], [True]))) if len(bucket) else np.zeros(1, np.int64)
    spans = list(zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True))
    data = [pa.array([c[a:b].tobytes() for a, b in spans], pa.binary()) for c in columns]
    return pa.record_batch([pa.array([kind] * len(spans), pa.int32()), pa.array(bucket[cut[:-1]].astype(np.int64)), *data, *[pa.nulls(len(spans), pa.binary())] * (7 - len(columns))], schema=_PACKED_TYPE)


def _unpacked(table: pa.Table, types: tuple) -> list[np.ndarray]:
    return [np.concatenate([np.frombuffer(x.as_buffer(), t) for x in table.column(c)] or [np.zeros(0, t)]) for c, t in zip("abcdefg", types, strict=False)]


def _of(x: np.ndarray, bits: int) -> np.ndarray:
    return (mix64(x.astype(np.uint64)) >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(x), np.int64)


def key_bucket(key: Column, buckets: int) -> Column:
    """The bucket of a row key; key_buckets is its other side."""
    return F.pmod(key.bitwiseXOR(F.shiftrightunsigned(key, 20)).bitwiseXOR(F.shiftrightunsigned(key, 40)), F.lit(buckets))


def key_buckets(key: np.ndarray, buckets: int) -> np.ndarray:
    k = key.astype(np.int64).view(np.uint64)
    return np.mod((k ^ (k >> np.uint64(20)) ^ (k >> np.uint64(40))).view(np.int64), buckets)


def _class_anchors(bits: int, key_count: int, least: int, crowded: int):
    """key, text -> one anchor for each class that a part of the task holds, packed by bucket (kind 0); the other copies are repeats and become runs (kind 1)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: list[tuple] = []
        slab: list[tuple[int, bytes]] = []
        held = size = 0

        def scan() -> int:
            raw = b"".join(x for _, x in slab)
            ends = np.cumsum([len(x) for _, x in slab])
            h, at, first, last = anchors(raw, ends.tolist(), least)
            doc = np.searchsorted(ends, at, side="right")
            base = ends[doc] - np.array([len(x) for _, x in slab])[doc] if len(doc) else doc
            before, after = at - first, at - last
            digest = xxhash.xxh3_64_intdigest
            spans = np.fromiter((digest(raw[a:b], c) for a, b, c in zip(first.tolist(), (last + least).tolist(), before.tolist(), strict=True)), np.uint64, len(h))
            parts.append((h, spans, np.array([k for k, _ in slab], np.int64)[doc], at - base, before.astype(np.int16), after.astype(np.int16)))
            slab.clear()
            return len(h)

        def flush() -> Iterator[pa.RecordBatch]:
            h, span, key, pos, before, after = (np.concatenate(c) for c in zip(*parts, strict=True))
            parts.clear()
            name = h * _TURN ^ span
            by = np.lexsort((pos, key, name))
            name = name[by]
            new = np.concatenate(([True], name[1:] != name[:-1])) if len(name) else np.zeros(0, bool)
            copies = np.diff(np.append(np.flatnonzero(new), len(name)))
            rest, by = by[~new], by[new]
            k, start, end = merged(key[rest], pos[rest] - before[rest], pos[rest] - after[rest] + least)
            yield _packed(1, key_buckets(k, key_count), k, start, end)
            yield _packed(0, _of(h[by], bits), h[by], span[by], key[by], pos[by], before[by], after[by], (copies > 1).astype(np.uint8))
            hs, n = np.unique(h[by], return_counts=True)
            many = n >= crowded
            yield _packed(3, np.zeros(int(many.sum()), np.int64), hs[many], n[many])

        for batch in batches:
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                raw = (text.as_py() or "").encode("utf-8", "surrogatepass")
                if len(raw) < least:
                    continue
                slab.append((key, raw))
                size += len(raw)
                if size > _SLAB:
                    held, size = held + scan(), 0
                    if held > 1_000_000:
                        yield from flush()
                        held = 0
        if slab:
            scan()
        if parts:
            yield from flush()
        give_back()

    return run


def _settle(key_count: int, least: int, keep_first: bool, hot: frozenset):
    """One bucket of anchors -> runs of the copies (kind 1), and the spans to be compared (kind 2): classes of anchors that have several. state 0: a lone span; 1: the first of a class that has copies;
    2 and 3: the same for anchors that are compared window by window. With keep_first the first copy by (key, pos) of a span is not settled by its own copies."""
    crowd = np.array(sorted(hot), np.uint64)

    def run(table: pa.Table) -> pa.Table:
        h, span, key, pos, before, after, many = _unpacked(table, _ANCHOR_TYPES)
        by = np.lexsort((pos, key, span, h))
        h, span, key, pos, before, after, many = (x[by] for x in (h, span, key, pos, before, after, many))
        new_group = np.concatenate(([True], h[1:] != h[:-1]))
        new_span = new_group | np.concatenate(([True], span[1:] != span[:-1]))
        g, c = np.cumsum(new_group) - 1, np.cumsum(new_span) - 1
        repeated = (np.bincount(c)[c] > 1) | (np.bincount(c, weights=many)[c] > 0)
        crowded = np.isin(h, crowd) if len(crowd) else np.zeros(len(h), bool)
        classes, lone = np.bincount(g, weights=new_span)[g], np.bincount(g, weights=~repeated)[g]
        compared = new_span & ((classes > 1) | crowded)
        if not keep_first:
            compared &= (lone > 0) | crowded
        start, end = pos - before, pos - after + least
        settled = repeated & (~new_span if keep_first else True)
        k, s, e = merged(key[settled], start[settled], end[settled])
        out = [_packed(1, key_buckets(k, key_count), k, s, e)]
        i = np.flatnonzero(compared)
        state = (repeated[i] + 2 * crowded[i]).astype(np.int8)
        out.append(_packed(2, key_buckets(key[i], key_count), state, h[i], key[i], start[i], (end[i] - start[i] - least + 1).astype(np.int16)))
        return pa.Table.from_batches(out)

    return run


_SPAN_SQL = "state int, h bigint, key bigint, first bigint, windows int, span binary"


def _cut_spans(least: int):
    """A key bucket's texts and wanted spans -> the spans: all bytes of the windows they own."""

    def run(texts: pa.Table, wanted: pa.Table) -> pa.Table:
        state, h, key, first, windows = _unpacked(wanted, _SPAN_TYPES)
        by = np.argsort(key, kind="stable")
        state, h, key, first, windows = (x[by] for x in (state, h, key, first, windows))
        spans: list[bytes | None] = [None] * len(key)
        for k, text in zip(texts.column("key").to_pylist(), texts.column("text"), strict=True):
            lo, hi = np.searchsorted(key, k), np.searchsorted(key, k, side="right")
            if lo < hi:
                raw = text.as_py().encode("utf-8", "surrogatepass")
                for i in range(lo, hi):
                    spans[i] = raw[first[i] : first[i] + int(windows[i]) + least - 1]
        return pa.table({"state": pa.array(state, pa.int32()), "h": h.astype(np.int64), "key": key, "first": first, "windows": pa.array(windows, pa.int32()), "span": pa.array(spans, pa.binary())})

    return run


def _compare(least: int, keep_first: bool, key_count: int):
    """A bucket of spans -> runs of windows that repeat, packed by key bucket, from the factors of all their windows in suffix order."""

    def run(table: pa.Table) -> pa.Table:
        state, key, first, n = (table.column(c).to_numpy().astype(np.int64) for c in ("state", "key", "first", "windows"))
        by = np.lexsort((first, key))  # windows then stand by position
        state, key, first, n = (x[by] for x in (state, key, first, n))
        spans = table.column("span").take(pa.array(by)).to_pylist()
        lengths = np.array([len(x) for x in spans], np.int64)
        text = np.frombuffer(b"".join(spans), np.uint8)
        begins = np.cumsum(lengths) - lengths
        owner = np.repeat(np.arange(len(n)), n)
        offset = np.arange(len(owner)) - np.repeat(np.cumsum(n) - n, n)
        order, lcp = suffix_order(text, begins[owner] + offset, least)
        hit = longest_factors(order, lcp) >= least
        if not keep_first:  # the first of a class is settled already by its copies
            later = longest_factors(len(order) - 1 - order, lcp)[::-1] >= least
            hit = (hit | later) & (state[owner] == 0)
        start = first[owner[hit]] + offset[hit]
        k, s, e = merged(key[owner[hit]], start, start + least)
        return pa.Table.from_batches([_packed(1, key_buckets(k, key_count), k, s, e)])

    return run


def repeat_runs(docs: DataFrame, least: int = LEAST, keep_first: bool = True, hot: int = 20_000, crowded: int = 200) -> tuple[DataFrame, int]:
    """docs (key, text), keys unique -> (runs, buckets): runs of bytes covered by strings of `least` bytes that start elsewhere too, packed by the key's bucket of that many.

    keep_first: only strings that start earlier, by key and then by position, count, so the first copy stays. An anchor with `hot` classes or more, as told by tasks where it has `crowded` in a million
    anchors, is compared window by window with partial sums before the shuffle, so none lands in one task.
    """
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    bits = max(0, int(np.ceil(np.log2(max(1, total / 55 / 150_000)))))
    key_count = int(total // 3_000_000) | 1  # odd, so that ids in steps of a power of two spread
    found = materialize_kinds(docs.mapInArrow(_class_anchors(bits, key_count, least, crowded), _PACKED_SQL), "anchors", [0, 1, 3])
    counts: dict[int, int] = {}
    for row in found[3].select("a", "b").collect():  # of anchors that are crowded in a task, so few
        for h, n in zip(np.frombuffer(row["a"], np.uint64).tolist(), np.frombuffer(row["b"], np.int64).tolist(), strict=True):
            counts[h] = counts.get(h, 0) + n
    hot_anchors = frozenset(h for h, n in counts.items() if n >= hot)
    settled = materialize_kinds(found[0].groupBy("bucket").applyInArrow(_settle(key_count, least, keep_first, hot_anchors), _PACKED_SQL), "settled", [1, 2])
    release(found[0])
    spans = docs.withColumn("bucket", key_bucket(F.col("key"), key_count)).groupBy("bucket").cogroup(settled[2].groupBy("bucket")).applyInArrow(_cut_spans(least), _SPAN_SQL)
    spans = materialize(spans, "spans")
    release(settled[2])
    cool = spans.where("state < 2")
    buckets = max(1, -(-cool.count() // 6_000))
    compared = cool.withColumn("bucket", F.pmod(F.xxhash64("h"), F.lit(buckets))).groupBy("bucket").applyInArrow(_compare(least, keep_first, key_count), _PACKED_SQL)
    runs = [found[1], settled[1], materialize(compared, "compared")]
    if hot_anchors:
        runs.append(_by_window(spans.where("state >= 2"), least, keep_first, key_count))
    release(spans)
    return functools.reduce(DataFrame.unionByName, [x.select("bucket", "a", "b", "c") for x in runs]), key_count


def _by_window(spans: DataFrame, least: int, keep_first: bool, key_count: int) -> DataFrame:
    """Runs of the windows that repeat, from their 128-bit hashes: for anchors with so many classes that one task should not sort them."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for state, key, first, n, span in zip(*(batch.column(c).to_pylist() for c in ("state", "key", "first", "windows", "span")), strict=True):
                names = [xxhash.xxh3_128_digest(span[i : i + least]) for i in range(n)]
                yield pa.record_batch([pa.array(names, pa.binary()), pa.array([state] * n, pa.int32()), pa.array([key] * n, pa.int64()), pa.array(range(first, first + n), pa.int64())], ["w", "state", "key", "start"])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            key, start = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            k, s, e = merged(key, start, start + least)
            yield _packed(1, key_buckets(k, key_count), k, s, e)

    windows = materialize(spans.mapInArrow(cut, "w binary, state int, key bigint, start bigint"), "windows")
    many = windows.groupBy("w").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("key", "start")).alias("least")).where("n > 1")
    hit = windows.join(many, "w")
    hit = hit.where(F.struct("key", "start") != F.col("least")) if keep_first else hit.where("state = 2")
    return materialize(hit.select("key", "start").mapInArrow(pack, _PACKED_SQL), "compared")


def _cut_texts(columns: list[str], with_kept: bool, schema: T.StructType):
    """A key bucket's rows and runs -> the rows' columns with what was removed and what stays."""
    arrow = pa.schema([(c, t) for c, t in (("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string()), ("kept", pa.binary()))])

    def run(rows: pa.Table, runs: pa.Table) -> pa.Table:
        key, start, end = merged(*_unpacked(runs.rename_columns(["_bucket", "a", "b", "c"]), _RUN_TYPES))
        cols: list[list] = [[] for _ in arrow]
        for k, text in zip(rows.column("_key").to_pylist(), rows.column("text"), strict=True):
            raw = (text.as_py() or "").encode("utf-8", "surrogatepass")
            lo, hi = np.searchsorted(key, k), np.searchsorted(key, k, side="right")
            pieces, at, removed = [], 0, 0
            for s, e in zip(start[lo:hi].tolist(), end[lo:hi].tolist(), strict=True):
                pieces.append(raw[at:s])
                removed, at = removed + e - s, e
            kept = raw if lo == hi else b"".join([*pieces, raw[at:]])
            for c, v in zip(cols, (len(raw), removed, int(hi - lo), hashlib.sha256(kept).hexdigest(), kept if with_kept else None), strict=True):
                c.append(v)
        out = rows.select(columns)
        for field, c in zip(arrow, cols, strict=True):
            if with_kept or field.name != "kept":
                out = out.append_column(field, pa.array(c, field.type))
        return out

    return run


def remove_repeats(docs: DataFrame, least: int = LEAST, keep_first: bool = True, with_kept: bool = True, columns: list[str] | None = None) -> DataFrame:
    """Adds n_bytes, n_removed, n_spans (maximal removed runs), kept_sha256 and, with with_kept, kept (the remaining bytes) to docs (doc_id, text, ...), or to those of its columns that are asked for.

    Matches are judged on the input, never cross documents, may lie in the same document and may overlap. Null texts are empty; texts under `least` bytes keep all; texts of any length are read whole; an empty
    table gives no rows. Rows come earlier by doc_id; where one is null or repeated, by their place in the table, and equal rows count as copies of each other. Columns of the added names are replaced.
    """
    added = ["n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"]
    docs = docs.drop(*added, "_key", "_bucket")
    columns = columns or docs.columns
    ids = docs.agg(F.count(F.lit(1)).alias("n"), F.countDistinct("doc_id").alias("d")).first()
    keyed = docs.withColumn("_key", F.col("doc_id").cast("long")) if ids["n"] == ids["d"] else materialize(docs.withColumn("_key", F.monotonically_increasing_id()), "rows")
    runs, buckets = repeat_runs(keyed.select(F.col("_key").alias("key"), F.coalesce("text", F.lit("")).alias("text")), least, keep_first)
    kinds = {"n_bytes": "long", "n_removed": "long", "n_spans": "long", "kept_sha256": "string", "kept": "binary"}
    schema = T.StructType([docs.schema[c] for c in columns])
    for c in added if with_kept else added[:-1]:
        schema = schema.add(c, kinds[c])
    placed = keyed.select(*dict.fromkeys([*columns, "text", "_key"])).withColumn("_bucket", key_bucket(F.col("_key"), buckets))
    return placed.groupBy("_bucket").cogroup(runs.withColumnRenamed("bucket", "_bucket").groupBy("_bucket")).applyInArrow(_cut_texts(columns, with_kept, schema), schema)


def op6_suffix(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return remove_repeats(docs, keep_first=False, with_kept=False, columns=["doc_id"])
