"""Queries on odd rows that the given tables seldom hold, against their SQL."""

import gc
import inspect
import os

import numpy as np
import pyarrow as pa
import pytest
from compare import TABLES, connect, rows_of, rows_of_sql
from pyspark.sql import functions as F

from quarry.functions import html
from quarry.functions import text as tx
from quarry.llm import media
from quarry.llm.queries import QUERIES as QUERIES_OF_TRAINING
from quarry.operators import extract as ex
from quarry.operators import reports as rp
from quarry.plans import ORACLES, QUERIES

DATA = "/root/testdata/sf0.001"


def tables_with(spark, folder, **given):
    """A folder of the given tables, with links to the usual ones beside them."""
    for name in TABLES:
        if name in given:
            given[name].write.parquet(f"{folder}/{name}.parquet")
        else:
            os.symlink(f"{DATA}/{name}.parquet", f"{folder}/{name}.parquet")
    return str(folder)


@pytest.mark.parametrize("name", ["c4_consolidate", "e2_contacts", "v6_counters"])
def test_addresses_that_begin_like_labels(spark, tmp_path, name):
    texts = ["write to.01@mail8.example.com or Contact.5@mail1.example.com now", "tola.97@mail4.example.com and address.3@mail0.example.com", "mail.7@mail2.example.com", "email.8@mail2.example.com tot.1@mail2.example.com", None, "no address"]
    docs = spark.createDataFrame([(i, t, "en", f"src{i % 2}", len(t or "")) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    folder = tables_with(spark, tmp_path, documents=docs)
    assert rows_of(QUERIES[name](spark, folder)) == rows_of_sql(connect(folder), ORACLES[name])


def test_labels_before_addresses(spark):
    raw = {"Email: a@b.com": "a@b.com", "to  toby@b.ca": "toby@b.ca", "E-mail - a@b.ca": "a@b.ca", "emailann@firm.caphone": "ann@firm.ca", "contact-us@firm.ca": "contact-us@firm.ca"}
    rows = spark.createDataFrame(list(raw.items()), "raw string, form string").select("form", tx.contact_form(F.col("raw"), F.lit(None).cast("string")).alias("got")).collect()
    assert all(r["got"] == r["form"] for r in rows)


def test_rates_in_the_middle(spark):
    pairs = spark.range(1, 401).withColumnRenamed("id", "w").join(spark.range(0, 501).withColumnRenamed("id", "p")).unionByName(spark.range(0, 2400).select(F.lit(2000).cast("long").alias("w"), F.col("id").alias("p")))
    got = {(r["p"], r["w"]): r["text"] for r in pairs.select("p", "w", rp.percent_text(F.col("p"), F.col("w")).alias("text")).collect()}
    assert got[13, 16] == "81.2" and got[3, 16] == "18.8"
    assert all(text == f"{100.0 * p / w:.1f}" for (p, w), text in got.items())


@pytest.mark.parametrize("name", ["n5_offices", "n6_departments", "n7_offices"])
def test_texts_before_numbers_are_made_once(spark, name):
    plan = QUERIES[name](spark, DATA)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_replace(") <= 6


@pytest.mark.parametrize("name", ["p6_link_discovery", "p7_wanted_links"])
def test_links_are_resolved_once(spark, name):
    plan = QUERIES[name](spark, DATA)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_extract(") < 400


def test_words_are_counted_once_for_mixing(spark):
    plan = QUERIES_OF_TRAINING["op7_mixing"](spark, DATA)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_extract_all(") == 1


def test_pages_are_read_in_small_runs():
    pages = [f"<html><body><h1>page {i}</h1><p>{'x' * (400_000 if i % 50 == 9 else 20)}</p></body></html>" for i in range(200)]
    out = list(ex._read(iter([(pa.array([*pages, None]), pa.array([None] * 201, pa.string())), (pa.array([], pa.string()), pa.array([], pa.string()))])))
    assert max(map(len, out)) <= ex.READ_ROWS and len(out) > 3
    assert [p["title"] for a in out for p in a.to_pylist()] == [*[f"page {i}" for i in range(200)], "Untitled Page"]


def test_trees_of_pages_go_at_once():
    gc.collect()
    gc.disable()
    try:
        html.read_page("<html><body><ul><li><a href='/a'>a</a></li></ul><p>text</p></body></html>", "https://a.example/")
        assert not [x for x in gc.get_objects() if isinstance(x, html.Node) and x.parent is not None]
    finally:
        gc.enable()


def test_corners_of_different_pictures_seldom_match():
    rng = np.random.default_rng(5)
    parts = [media.descriptors(media.decode(media.draw(rng.normal(size=16).tolist(), 0)))[4] for _ in range(60)]
    bits, node = np.unpackbits(np.concatenate(parts), axis=1).astype(np.float32), np.repeat(np.arange(60), [len(p) for p in parts])
    apart = bits @ (1 - bits).T + (1 - bits) @ bits.T
    most = inspect.signature(media.link_images).parameters["most_apart"].default
    assert (apart <= most)[node[:, None] != node].mean() < 1e-3


def test_neighbours_of_corners():
    rng = np.random.default_rng(6)
    x, y, level = rng.uniform(0, 3000, 900), np.sort(rng.uniform(0, 3000, 900)), (rng.random(900) < 0.3).astype(int)
    want = set()
    for i in range(900):
        own = np.nonzero((level == level[i]) & (np.arange(900) != i))[0]
        want |= {(min(i, j), max(i, j)) for j in own[np.argsort((x[own] - x[i]) ** 2 + (y[own] - y[i]) ** 2)][: media.NEAR].tolist()}
    assert set(zip(*(v.tolist() for v in media.neighbours(x, y, level)), strict=True)) == want
    assert [len(media.neighbours(x[:n], y[:n], level[:n] * 0)[0]) for n in (0, 1, 2, 3)] == [0, 0, 1, 3]


def test_meetings_of_different_pictures_grow_with_the_table(spark):
    rng = np.random.default_rng(7)
    rows = [(i, i, media.draw(rng.normal(size=16).tolist(), 0)) for i in range(300)]
    features = media.extract(spark.createDataFrame(rows, "id long, node long, image binary")).where("kind = 1").cache()

    def meetings(pairs: int) -> int:
        sizes = [media.pair_keys(features, t, media.key_bits(pairs)).groupBy("table", "key").agg(F.count(F.lit(1)).alias("n")) for t in range(0, media.TABLES, media.AT_ONCE)]
        return sum(s.agg(F.sum(F.col("n") * (F.col("n") - 1))).first()[0] for s in sizes)

    few, many = meetings(2**20), meetings(25 * 2**20)
    assert few > 100 and 10 * many < few, (few, many)
