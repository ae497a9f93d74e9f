"""Filter audit, lookup-table clustering and weighted fingerprints against plain versions."""

import hashlib
import itertools
import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from compare import connect, rows_of, rows_of_sql

from quarry.llm import clustering, filters, fingerprints
from quarry.llm.queries import ORACLES, QUERIES

DATA = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, source string, mask int, part string, high long"


@pytest.mark.parametrize("name", ["op11_filters", "op12_clustering"])
def test_against_sql(spark, name):
    assert rows_of(QUERIES[name](spark, DATA)) == rows_of_sql(connect(DATA), ORACLES[name])


def odd_documents():
    """Nulls, empty and long texts, copies over sources, repeated rows, rows without id, and columns whose names clash."""
    rng = random.Random(5)
    words = [f"w{i}" for i in range(90)]
    texts = [None, "", " \t\n", "#tag", "AAAA bbb", "é" * 40, " ".join(rng.choices(words, k=60)), " ".join(words), " ".join(rng.choices(words, k=60_000)), "x" * 300_000]
    rows = [(i, t, f"s{i % 3}" if i % 4 else None) for i, t in enumerate(texts)]
    rows += [(100 + i, rng.choice(texts), rng.choice(["s0", "s1", ""])) for i in range(40)] + [(100, "twice", "s0"), (100, "twice", "s0"), (90, "twice", "s1")]
    rows += [(None, "twice", "s1"), (None, "alone", "s1"), (None, None, None)]
    return [(*r, 7, "p", 1) for r in rows]


def plain_audit(rows, labels):
    least = {}
    for d, t, *_ in rows:
        if d is not None:
            least[t or ""] = min(d, least.get(t or "", d))
    good = {d for d, q, _ in labels if q == 1 and d is not None}
    toxic = {d for d, _, x in labels if x == 1 and d is not None}
    judged = []
    for d, t, s, *_ in rows:
        t = t or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", t)
        fails = {"A": len(words) < 50, "B": 100 * len(set(words)) < 65 * len(words), "C": 100 * len(re.findall("[A-Z]", t)) > 5 * len(t), "D": bool(re.search(r"[#$%&*|]", t))}
        fails["E"] = d is not None and t in least and least[t] < d
        judged.append((s or "", {k for k, v in fails.items() if v}, d in good, d in toxic))
    out = set()
    for part in {j[0] for j in judged}:
        mine = [j for j in judged if j[0] == part]
        first = Counter(next(x for x in o if x in j[1]) for o in itertools.permutations("ABCDE") for j in mine if j[1])
        for o in itertools.permutations("ABCDE"):
            left = mine
            for i, x in enumerate(o):
                gone = [j for j in left if x in j[1]]
                left = [j for j in left if x not in j[1]]
                redundant = sum(x in j[1] and bool(j[1] & set(o[:i])) for j in mine)
                out.add((part, "".join(o), i + 1, len(left), len(gone), redundant, sum(j[1] == {x} for j in mine), sum(j[2] for j in gone), sum(j[3] for j in gone), first[x]))
    return out


LABELS = [(0, 1, 0), (6, 1, 1), (6, 0, None), (105, None, 1), (None, 1, 1), (110, 1, 0), (111, 1, 1), (112, 0, 1)]


def audited(spark, rows, labels, **more):
    docs = spark.createDataFrame(rows, DOCS)
    got = filters.all_orders(filters.mask_counts(docs.selectExpr("doc_id", "coalesce(source, '') AS part", "text"), labels, **more))
    return {tuple(r) for r in got.collect()}


def test_filters_on_odd_rows(spark, monkeypatch):
    rows = odd_documents()
    labels = spark.createDataFrame(LABELS, "doc_id long, quality int, toxic int")
    docs = spark.createDataFrame(rows, DOCS)
    want = plain_audit(rows, LABELS)
    assert {tuple(r) for r in filters.audit_filters(docs, labels).collect()} == want
    assert filters.audit_filters(docs.limit(0), labels).count() == 0
    # Several ranges of digests, each with a sketch of its own.
    monkeypatch.setattr(filters, "CELLS", 1 << 18)
    assert audited(spark, rows, labels, most_mb=1) == want


def test_filters_when_digests_clash(spark):
    """Different texts under one digest are noticed by their full text, and another seed is taken."""
    weak = lambda text, seed: bytes(16) if seed == 0 else filters.digest_of(text, seed)
    labels = spark.createDataFrame(LABELS, "doc_id long, quality int, toxic int")
    assert audited(spark, odd_documents(), labels, digest=weak) == plain_audit(odd_documents(), LABELS)
    with pytest.raises(ValueError, match="every seed"):
        audited(spark, odd_documents(), labels, digest=lambda text, seed: bytes(16))


def test_sketch_clears_unique_texts(spark):
    docs = spark.createDataFrame([(i, f"text {i % 1900}") for i in range(2000)], "doc_id long, text string").selectExpr("doc_id", "'' AS part", "text")
    narrow = filters.scan_texts(docs, 0, filters.digest_of)
    found = Counter(r["text"] for r in filters.possible_repeats(docs, narrow, 0, filters.digest_of).collect())
    assert all(found[f"text {i}"] == 2 for i in range(100)) and sum(found.values()) < 300


def plain_clusters(rows, k=8, rounds=10):
    kept = [(i, [max(-(1 << 27), min(1 << 27, math.floor(1024 * x))) for x in e]) for i, e in rows if e is not None and len(e) == 4 and all(x is not None and math.isfinite(x) for x in e)]
    name = lambda i: hashlib.sha256(f"3:{'' if i is None else i}".encode()).hexdigest()
    centres = [v for _, v in sorted(kept, key=lambda r: (name(r[0]), r[1]))[:k]]
    far = lambda v, c: sum((a - b) ** 2 for a, b in zip(v, c, strict=True))
    near = lambda v: min(range(len(centres)), key=lambda c: (far(v, centres[c]), c))
    for _ in range(rounds):
        groups = [[] for _ in centres]
        for _, v in kept:
            groups[near(v)].append(v)
        centres = [[sum(x) // len(g) for x in zip(*g, strict=True)] if g else c for g, c in zip(groups, centres, strict=True)]
    out = [(i, near(v), far(v, centres[near(v)])) for i, v in kept]
    inertia = Counter()
    for _, c, d in out:
        inertia[c] += d
    return sorted(((i is not None, i), c, d, inertia[c], sum(inertia.values()), hashlib.sha256(",".join(map(str, centres[c])).encode()).hexdigest()) for i, c, d in out)


def clustered(df):
    return sorted(((r[0] is not None, r[0]), *r[1:]) for r in clustering.cluster_vectors(df, dims=4).collect())


def test_clusters_on_odd_rows(spark):
    rng = random.Random(3)
    rows = [(i, [float(np.float32(rng.gauss(i % 5, 0.3))) for _ in range(4)]) for i in range(300)]
    rows += [(1000, [9.0, 9.0, 9.0, 9.0])] * 40 + [(None, [0.5, 0.25, -0.125, 70_000.0]), (2000, None), (2001, [1.0, 2.0]), (2002, [1.0, None, 0.0, 0.0]), (2003, [float("nan"), 0.0, 0.0, 0.0]), (2004, [float("inf"), 0.0, 0.0, 0.0]), (2005, []), (2006, [1e30, -1e30, 0.0, 0.0])]
    schema = "vec_id long, embedding array<float>, label int, cells string, cluster string"
    df = spark.createDataFrame([(*r, 1, "x", "y") for r in rows], schema)
    assert clustered(df) == plain_clusters([(i, None if e is None else [None if x is None else float(np.float32(x)) for x in e]) for i, e in rows])
    few = df.where("vec_id < 3")
    assert clustered(few) == plain_clusters(rows[:3])
    assert clustering.cluster_vectors(df.limit(0), dims=4).collect() == [] and clustering.cluster_vectors(df.where("vec_id = 2000"), dims=4).count() == 0


def test_tables_give_distances():
    rng = np.random.default_rng(1)
    for spread in (50, 1 << 27):
        cells, centres = rng.integers(-spread, spread, (500, 7)), rng.integers(-spread, spread, (3, 7))
        assert (clustering.distances(cells, centres) == ((cells[:, None] - centres[None]) ** 2).sum(axis=2)).all()


def plain_edits(rows):
    """In descending order of ids, rows without one last; ties by text."""
    order = sorted((r for r in rows if r[0] is not None), key=lambda r: (-r[0], r[1] or ""))
    return order, [(d, len(t or ""), hashlib.sha256(((t or "")[: len(t or "") - len(t or "") // 3] + (order[(i + 1) % len(order)][1] or "")[: len(t or "") // 3]).encode()).hexdigest()) for i, (d, t) in enumerate(order)]


@pytest.mark.parametrize("bucket_bytes", [1, 4000, 1 << 30])
def test_fingerprints_edits(spark, bucket_bytes):
    rng = random.Random(2)
    texts = [None, "", " \n ", "ünï çödé", "word", "a b c", " ".join(f"w{rng.randrange(80)}" for _ in range(30_000)), "long" * 50_000] + [" ".join(f"w{rng.randrange(300)}" for _ in range(rng.randrange(1, 90))) for _ in range(60)]
    rows = [(rng.randrange(-50, 50) * 10**15 if i % 7 else i, t) for i, t in enumerate(texts)] + [(3, "same row here"), (3, "same row here"), (3, "another of that id")]
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, bucket int, key string")
    got = fingerprints.fingerprint_documents(df, bucket_bytes=bucket_bytes).collect()
    order, want = plain_edits(rows)
    assert sorted((r["doc_id"], r["n_chars"], r["edited_sha256"]) for r in got) == sorted(want)
    prints = {}
    by_id = Counter(d for d, _ in rows)
    for r in got:
        if by_id[r["doc_id"]] == 1:
            prints.setdefault(dict(rows)[r["doc_id"]] or "", set()).add(r["fingerprint"])
    assert all(len(p) == 1 for p in prints.values()) and all(len(r["fingerprint"]) == len(r["edited_fingerprint"]) == 8 * fingerprints.SAMPLES for r in got)
    pieces = lambda s: [s[i : i + 8] for i in range(0, len(s), 8)]
    share = lambda a, b: sum(x == y for x, y in zip(pieces(a), pieces(b), strict=True)) / fingerprints.SAMPLES
    one = {r["doc_id"]: r for r in got if by_id[r["doc_id"]] == 1}
    for i, (d, _) in enumerate(order):
        after = order[(i + 1) % len(order)][0]
        if d in one and after in one:
            assert one[d]["near_next"] == pytest.approx(share(one[d]["fingerprint"], one[after]["fingerprint"]))
            assert one[d]["near_edited"] == pytest.approx(share(one[d]["fingerprint"], one[d]["edited_fingerprint"]))


def test_fingerprints_without_ids_and_rows(spark):
    df = spark.createDataFrame([(None, "one two"), (None, "one two"), (None, None), (5, "one two")], "doc_id long, text string")
    got = fingerprints.fingerprint_documents(df).collect()
    assert len(got) == 4 and sorted(str(r["doc_id"]) for r in got) == ["5", "None", "None", "None"]
    assert len({r["fingerprint"] for r in got}) == 2
    assert fingerprints.fingerprint_documents(df.limit(0)).collect() == []
    alone = fingerprints.fingerprint_documents(df.where("doc_id = 5")).first()
    assert alone["near_next"] == 1.0 and alone["edited_sha256"] == hashlib.sha256(b"one ton"[:5] + b"on").hexdigest()


def test_likeness_is_generalised_jaccard(spark):
    """Agreement over many pairs is the generalised Jaccard similarity of words with their counts."""
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    got = {r["doc_id"]: r for r in QUERIES["op13_fingerprints"](spark, DATA).collect()}
    order = sorted(((r["doc_id"], r["text"] or "") for r in docs.select("doc_id", "text").collect()), reverse=True)
    errors = []
    for i, (d, t) in enumerate(order):
        after = order[(i + 1) % len(order)][1]
        m = len(t) // 3
        for other, said in ((t[: len(t) - m] + after[:m], got[d]["near_edited"]), (after, got[d]["near_next"])):
            a, b = (Counter(re.findall(r"[^\x20\x09-\x0D]+", x)) for x in (t, other))
            if a or b:
                errors.append(said - sum((a & b).values()) / sum((a | b).values()))
    assert abs(np.mean(errors)) < 0.02 and np.std(errors) < 0.12


def test_jaccard_stores_no_shingles(spark, monkeypatch):
    """What is written of the sets stays below the texts; whole sets would take more than they do."""
    import os

    from quarry.llm import jaccard

    drawn = random.Random(5)
    texts = [" ".join(f"w{drawn.randrange(50_000)}" for _ in range(400)) for _ in range(300)]
    docs = spark.createDataFrame(list(enumerate([*texts, texts[0] + " more"])), "doc_id long, text string").coalesce(1)
    written = []
    kinds = jaccard.materialize_kinds

    def spy(*args):
        out = kinds(*args)
        written.append(sum(os.path.getsize(f"{t.quarry_path}/{f}") for t in out.values() if t.quarry_path for f in os.listdir(t.quarry_path)))
        return out

    monkeypatch.setattr(jaccard, "materialize_kinds", spy)
    got = {r["doc_id"]: r["component_id"] for r in jaccard.jaccard_groups(docs).collect()}
    assert got == {i: i for i in range(300)} | {300: 0}
    assert sum(written) < sum(map(len, texts)) / 2


def test_only_texts_wanted_are_shuffled(spark, monkeypatch):
    """With more partners than go to every task the texts that no pair names still stay where they are."""
    from quarry.llm import jaccard

    words = [f"w{i}" for i in range(60)]
    docs = spark.createDataFrame([(i, " ".join([*words, str(i % 3)] if i < 6 else [f"{w}-{i}" for w in words])) for i in range(40)], "doc_id long, text string")
    sets = jaccard._with_refs(docs).select("_ref", "_n", "doc_id").orderBy("doc_id").collect()
    sketches = spark.createDataFrame([(r[0], r[1], r[2]) for r in {r["_ref"]: r for r in reversed(sets)}.values()], "ref long, n long, rep long")
    pairs = spark.createDataFrame([(sets[0]["_ref"], sets[1]["_ref"]), (sets[1]["_ref"], sets[2]["_ref"]), (sets[0]["_ref"], sets[9]["_ref"])], "a long, b long")
    plans, store = [], jaccard.materialize
    monkeypatch.setattr(jaccard, "materialize", lambda df, label: plans.append(df._jdf.queryExecution().optimizedPlan().toString()) or store(df, label))
    got = []
    for sizes in ({}, {"most_broadcast": 1}, {"most_broadcast": 1, "most_wanted": 1}):
        got.append({(r["a"], r["b"]) for r in jaccard._verify(docs, sketches, pairs, 75, **sizes).collect()})
    assert got == [{(sets[0]["_ref"], sets[1]["_ref"]), (sets[1]["_ref"], sets[2]["_ref"])}] * 3
    # Each run writes turns, homes and links, in this order.
    assert ["LeftSemi" in plan for plan in plans[2::3]] == [False, True, False]


def test_sets_that_share_by_chance_meet_no_pivot(spark, monkeypatch):
    """Sets that have a few shingles in common and cannot be linked are told apart where they share an anchor; near copies meet."""
    from quarry.llm import jaccard

    drawn = random.Random(6)
    shared = [f"s{i}" for i in range(20)]
    texts = [" ".join([f"w{drawn.randrange(50_000)}" for _ in range(drawn.randrange(100, 700))] + shared) for _ in range(60)]
    docs = spark.createDataFrame([*enumerate(texts), (60, texts[0] + " more"), (61, "and " + texts[1])], "doc_id long, text string").coalesce(1)
    met, store = [], jaccard.materialize

    def spy(df, label="step"):
        out = store(df, label)
        if label == "regions":
            met.append(out.count())
        return out

    monkeypatch.setattr(jaccard, "materialize", spy)
    got = {r["doc_id"]: r["component_id"] for r in jaccard.jaccard_groups(docs, common_share=0.99).collect()}
    assert got == {i: i for i in range(60)} | {60: 0, 61: 1}
    assert met == [2]


def test_linked_sets_share_a_piece_that_is_alike():
    """At every size each linked pair has an anchor in common whose pieces have the same name, also across the bounds of the classes."""
    from quarry.llm import jaccard

    drawn = np.random.default_rng(7)
    order = jaccard.Order(np.zeros(0, np.uint64))
    for n in (1, 2, 5, 7, 40, 60, 63, 64, 70, 400, 500, 511, 513, 600, 4_090, 5_000):
        for _ in range(20):
            x = np.unique(drawn.integers(0, 2**64, n, dtype=np.uint64))
            lost, won = drawn.integers(0, n // 7 + 1), drawn.integers(0, n // 7 + 1)
            y = np.unique(np.concatenate((drawn.permutation(x)[lost:], drawn.integers(0, 2**64, won, dtype=np.uint64))))
            if 100 * len(np.intersect1d(x, y)) < 75 * len(np.union1d(x, y)):
                continue
            found = False
            for step in set(jaccard.classes_of(len(x), 75)) & set(jaccard.classes_of(len(y), 75)):
                key, own, mark, side = (np.concatenate(c) for c in zip(*((k, o, m, np.full(len(k), i)) for i, (k, _, o, m) in enumerate(jaccard.pieces(s, order.places(s), step, 0.75) for s in (x, y))), strict=True))
                by = np.lexsort((own, key))
                name = jaccard.alike(key[by], own[by].astype(np.int64), mark[by], 75)
                found |= bool(set(name[side[by] == 0]) & set(name[side[by] == 1]))
            assert found
