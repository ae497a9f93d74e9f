"""The training-data operators against plain versions, SQL and planted cases."""

from __future__ import annotations

import functools
import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from compare import connect, rows_of, rows_of_sql
from pyspark.sql import functions as F

from quarry.llm import decontamination, jaccard, licenses, media, mixing, secrets, sharding, suffix, toxicity, urls
from quarry.llm.graph import connected_components
from quarry.llm.queries import ORACLES, QUERIES

DATA = "/root/testdata/sf0.001"
DOC = "doc_id long, text string, lang string, source string, n_chars long"
#: Nulls, empty and white texts, ties and repeated rows.
ODD = [(1, None, None, None, None), (2, "", "en", "a", 0), (3, " \n\t ", "en", "a", 4), (4, "one", "en", None, 3), (4, "one", "en", None, 3), (5, "one", "en", "b", 3), (None, "two words", "en", "a", 9), (6, "é " * 500, "fr", "b", 1000)]


@pytest.fixture(scope="module")
def con():
    return connect(DATA)


@pytest.fixture(scope="module")
def odd(spark):
    # An extra column whose name clashes with ones the operators add.
    return spark.createDataFrame(ODD, DOC).withColumns({c: F.lit("x") for c in ("size", "shard", "score", "runs", "n_words", "items")})


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOC)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_sql(spark, con, name):
    assert rows_of(QUERIES[name](spark, DATA)) == rows_of_sql(con, ORACLES[name])


# 1 -----------------------------------------------------------------------------------------------------------------


def test_matrix_sums():
    rows = [7, 0, 1000, 13]
    m = sharding.communication_matrix(rows, 8, 3)
    assert m.sum(1).tolist() == rows and m.min() >= 0
    assert sorted(m.sum(0).tolist()) == [127] * 4 + [128] * 4


def test_matrix_is_hypergeometric():
    draws = np.array([sharding.communication_matrix([50, 50], 2, s)[0, 0] for s in range(400)])
    assert abs(draws.mean() - 25) < 0.6 and abs(draws.var() - 50 * 0.25 * 50 / 99) < 1.8


def test_large_draws_are_hypergeometric():
    rng = np.random.default_rng(5)
    for good, bad, n in ((30, 50, 20), (4, 1000, 400), (700, 300, 950)):
        draws = np.array([sharding._by_inversion(rng, good, bad, n) for _ in range(4000)])
        want = np.random.default_rng(6).hypergeometric(good, bad, n, 40_000)
        assert abs(draws.mean() - want.mean()) < 0.12 * want.std() + 0.01 and abs(draws.std() / want.std() - 1) < 0.06
    m = sharding.communication_matrix([10**12, 3 * 10**11], 8, 1)
    assert m.sum(1).tolist() == [10**12, 3 * 10**11] and np.ptp(m.sum(0)) == 0


def test_shards(spark, odd, none):
    got = sharding.shard_with_digests(odd).collect()
    assert len(got) == len(ODD)
    by = Counter(r["shard"] for r in got)
    assert set(by) <= set(range(8)) and max(by.values()) - min(by[k] for k in range(8)) <= 1
    for k in range(8):
        assert sorted(r["slot"] for r in got if r["shard"] == k) == list(range(by[k]))
    for r in got:
        text = next((t or "") for i, t, *_ in ODD if i == r["doc_id"])
        assert r["size"] == len(text.encode()) + 1 and r["text_crc32"] == zlib.crc32(text.encode()) and r["grown_shard"] is None
    assert sharding.shard_with_digests(none).count() == 0
    again = {(r["doc_id"], r["shard"], r["slot"]) for r in sharding.shard_with_digests(odd.repartition(5)).collect()}
    assert {x for x in again if x[0] != 4} == {(r["doc_id"], r["shard"], r["slot"]) for r in got if r["doc_id"] != 4}


# 2 -----------------------------------------------------------------------------------------------------------------


def test_toxicity_learns_and_restores(spark):
    random.seed(1)
    syllables = ["tra", "lo", "min", "ka", "ber", "sti", "on", "el", "va"]
    words = ["".join(random.choices(syllables, k=random.randint(2, 4))) for _ in range(1500)]
    rows, labels = [], []
    for i in range(900):
        w = random.choices(words, k=60)
        bad = i % 7 == 0
        if bad:
            w[30] = random.choice(["idiot", "scum", "clown"])
        rows.append((i, " ".join(w)))
        labels.append((i, int(bad)))
    docs, lab = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    model = toxicity.train(docs, lab)
    scorer = toxicity.Scorer(model)
    restore = toxicity.Restorer(model.chars)
    for disguised in ("1d10t", "i d i o t", "idiiiiot", "i.d.i.o.t", "ID!OT", "id-iot", "$cum", "cl0wn", "!diot", "|d10t", "*diot", "(lown", "cl*wn", "i*iot"):
        assert scorer.score(f"ka ber {disguised} minka") >= 0.3, (disguised, restore.text(disguised))
    assert scorer.score("ka ber minka onel") < 0.3 and scorer.score("(ka) ber! minka, " + "*" * 5000 + " onel") < 0.3
    scored = toxicity.score_documents(docs, model).withColumn("h", toxicity.held_out(F.col("doc_id"))).join(lab, "doc_id").where("h").collect()
    assert sum(r["predicted"] == r["toxic"] for r in scored) >= 0.97 * len(scored)
    odd = spark.createDataFrame([(1, None), (2, ""), (3, "idiot " * 5000)], "doc_id long, text string")
    got = {r["doc_id"]: r for r in toxicity.score_documents(odd, model).collect()}
    assert got[1]["score"] == got[2]["score"] == pytest.approx(model.base) and got[3]["predicted"] == 1
    assert [r["restored"] for r in toxicity.restored(odd.where("doc_id < 3"), model.chars).orderBy("doc_id").collect()] == [None, ""]


def test_toxicity_without_labels(spark, none):
    labels = spark.createDataFrame([], "doc_id long, toxic int")
    model = toxicity.train(none, labels)
    assert toxicity.score_documents(none, model).count() == 0 and not model.weights


def test_viterbi_is_exact():
    rng = np.random.default_rng(2)
    model = toxicity.CharModel.from_counts(rng.integers(0, 50, 28**3).astype(float))
    positions = [[("a", 0.0), ("b", -0.5)], [("cc", -0.1), ("c", 0.0)], [("", -0.3), ("d", -0.2), (" ", -1.0)], [("e", 0.0), ("a", -0.1)]]

    def score(parts):
        s, x, y = 0.0, 0, 0
        for text, cost in parts:
            s += cost
            for ch in text:
                k = toxicity.char_class(ch)
                s += model.logp[x, y, k]
                x, y = (0, 0) if k == 0 else (y, k)
        return s + model.logp[x, y, 0]

    paths = [[]]
    for options in positions:
        paths = [p + [o] for p in paths for o in options]
    best = max(paths, key=score)
    assert toxicity.viterbi(positions, model) == "".join(t for t, _ in best)


# 3 -----------------------------------------------------------------------------------------------------------------


def test_urls(spark):
    rows = [(1, "HTTP://WWW.Example.COM/en/7x?q#f"), (2, "https://a.example.com/en/8"), (3, "https://x.example.net/de/81"), (4, "https://x.example.net/de/7"), (5, None), (6, "no address"), (7, "https://good.site.io"), (8, "https://bad.site.io/x"), (9, "https://new.bad.xx?y")]
    pages = spark.createDataFrame(rows, "page_id long, url string").withColumn("host", F.lit("clash"))
    outcomes = spark.createDataFrame([("good.site.io", 200, 199), ("bad.site.io", 200, 5)], "host string, n long, good long")
    got = {r["page_id"]: r for r in urls.judge_urls(pages, outcomes).collect()}
    assert (got[1]["host"], got[1]["path"], got[1]["rule"], got[1]["verdict"]) == ("www.example.com", "/en/7x", "example.com/en/7", "allow")
    assert (got[2]["rule"], got[2]["verdict"]) == ("com/en/", "block")
    assert (got[3]["verdict"], got[4]["verdict"]) == ("block", "allow")
    assert got[5]["host"] == got[6]["path"] == "" and got[5]["rule"] is None
    assert (got[7]["verdict"], got[8]["verdict"], got[9]["host"]) == ("allow", "block", "new.bad.xx")


def _plain_reputations(rows, z=1.0, least=1.0, most=1000.0):
    """host -> (mean, bound) by loops: what goes down from a level leaves out the child's own pages."""

    def strength(groups):
        big_n, big_g = sum(n for n, _ in groups), sum(g for _, g in groups)
        m = (big_g + 0.5) / (big_n + 1)
        spread = sum(g * g / n for n, g in groups) - big_g * big_g / big_n
        chance, slope = (len(groups) - 1) * m * (1 - m), big_n - sum(n * n for n, _ in groups) / big_n
        if len(groups) < 2:
            return m, None
        return m, round(min(max(m * (1 - m) * slope / (spread - chance) - 1 if spread > chance else slope, least), most), 6)

    def summed(level):
        out = {}
        for h, n, g in rows:
            a, b = out.get(level(h), (0, 0))
            out[level(h)] = (a + n, b + g)
        return out

    domain = lambda h: ".".join(h.split(".")[-3 if h.endswith(".co.uk") else -2 :])
    suffix = lambda h: domain(h).split(".", 1)[1]
    ds, ss = summed(domain), summed(suffix)
    m0, k0 = strength(list(ss.values()))
    k0 = least if k0 is None else k0
    out = {}
    for h, n, g in rows:
        (dn, dg), (sn, sg) = ds[domain(h)], ss[suffix(h)]
        _, k1 = strength([v for d, v in ds.items() if suffix(d) == suffix(h)])
        _, k2 = strength([(n2, g2) for h2, n2, g2 in rows if domain(h2) == domain(h)])
        k1 = k0 if k1 is None else k1
        k2 = k1 if k2 is None else k2
        m1 = (k0 * m0 + sg - dg) / (k0 + sn - dn)
        m2 = (k1 * m1 + dg - g) / (k1 + dn - n)
        mean = (k2 * m2 + g) / (k2 + n)
        out[h] = (mean, max(0.0, mean - z * (mean * (1 - mean) / (k2 + n + 1)) ** 0.5))
    return out


def test_reputations(spark):
    random.seed(8)
    rows = [(f"h{i}.a.com", 20, 19) for i in range(8)] + [(f"h{i}.b.com", 20, 2) for i in range(8)] + [("new.a.com", 1, 0), ("new.b.com", 1, 1)]
    rows += [(f"x{i}.org", 50, 45) for i in range(20)] + [("big.org", 5000, 4500)] + [(f"y{i}.org", 1, 1) for i in range(21)]
    rows += [(f"www.{c}.co.uk", n, random.randint(0, n)) for c, n in zip("abcd", (1, 9, 30, 30), strict=True)]
    known, _, _ = urls.reputations(spark.createDataFrame(rows, "host string, n long, good long"))
    got = {r["host"]: (r["mean"], r["bound"]) for r in known.collect()}
    want = _plain_reputations(rows)
    assert {h: pytest.approx(v) for h, v in want.items()} == got
    assert got["new.a.com"][0] > 0.7 > 0.3 > got["new.b.com"][0]
    assert got["y0.org"][1] <= got["big.org"][1] + 0.02  # one good page is not trusted more than thousands at the same share
    assert {r["d"] for r in spark.createDataFrame([("a.b.co.uk",), ("co.uk",), ("b.com",), ("10.0.0.1:80",)], "h string").select(urls.registered_domain(F.col("h")).alias("d")).collect()} == {"b.co.uk", "co.uk", "b.com", "10.0.0.1"}


def test_reputation_follows_evidence(spark):
    """Most domains have one host: a host whose labelled pages are all bad is blocked, whatever its suffix, and hosts stand in the order of their shares."""
    random.seed(9)
    good = [(f"www.d{i}.com", 50, random.randint(47, 50)) for i in range(40)]
    bad = [("www.evil.com", 100, 0), ("www.worse.com", 300, 0), ("www.few.com", 5, 0)]
    known, domains, _ = urls.reputations(spark.createDataFrame(good + bad, "host string, n long, good long"))
    got = {r["host"]: r for r in known.collect()}
    assert all(got[h]["mean"] < 0.4 and 0 <= got[h]["bound"] < 0.4 for h, *_ in bad) and all(got[h]["bound"] > 0.7 for h, *_ in good)
    assert got["www.worse.com"]["mean"] < got["www.evil.com"]["mean"] < got["www.few.com"]["mean"]
    ranges = [(f"a.m{s}.net", 200, 2 * s) for s in range(0, 101, 10)]
    spread = {r["host"]: r["mean"] for r in urls.reputations(spark.createDataFrame(ranges, "host string, n long, good long"))[0].collect()}
    assert all(abs(spread[h] - g / n) < 0.05 for h, n, g in ranges)
    pages = spark.createDataFrame([(1, "http://www.evil.com/x"), (2, "http://www.d1.com/x"), (3, "http://new.evil.com/x")], "page_id long, url string")
    judged = {r["page_id"]: r["verdict"] for r in urls.judge_urls(pages, spark.createDataFrame(good + bad, "host string, n long, good long")).collect()}
    assert judged == {1: "block", 2: "allow", 3: "block"}
    # One host alone, with nothing to compare it with, is judged by its own pages.
    alone = urls.reputations(spark.createDataFrame([("x.only.io", 100, 0)], "host string, n long, good long"))[0].first()
    assert alone["mean"] < 0.05 and alone["bound"] == 0.0


def test_urls_odd(spark):
    pages = spark.createDataFrame([(1, "http://a.com/x"), (1, "http://a.com/x"), (None, None), (2, ""), (3, "http://" + "a" * 100_000)], "page_id long, url string").withColumns({c: F.lit("clash") for c in ("rule", "verdict", "domain", "n")})
    none = spark.createDataFrame([], "host string, n long, good long")
    got = urls.judge_urls(pages, none).collect()
    assert len(got) == 5 and {r["verdict"] for r in got} == {"block"} and {r["n"] for r in got} == {"clash"}
    assert urls.judge_urls(pages.limit(0), none).count() == 0


# 4, 5 ----------------------------------------------------------------------------------------------------------------


def test_secrets(spark, none):
    random.seed(3)
    key = lambda n, alphabet: "".join(random.choices(alphabet, k=n))
    hexa, big = "0123456789abcdef", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
    texts, secret = [], set()
    for i in range(160):
        if i % 2:
            k = "AKIA" + key(16, big) if i % 4 == 1 else key(20, hexa)
            texts.append((i, f"run with {'' if i % 4 == 1 else 'password='}{k} now", "prod.env"))
            secret.add(i)
        else:
            texts.append((i, f"mail {key(9, hexa)}.{i}@mail{i}.example.com please", "docs/example.md"))
    docs = spark.createDataFrame(texts, "doc_id long, text string, source string")
    got = secrets.scan_secrets(docs).collect()
    assert {r["doc_id"] for r in got if r["kept"]} == secret and len(got) == 160
    empty = spark.createDataFrame([(1, None, None), (2, "", "x"), (3, "abcdef123456ghijkl", None)], "doc_id long, text string, source string")
    with pytest.warns(UserWarning, match="no labelled findings"):
        assert [(r["doc_id"], r["kept"], r["probability"]) for r in secrets.scan_secrets(empty).collect()] == [(3, True, 0.5)]
    assert secrets.scan_secrets(none).count() == 0


def test_secrets_in_any_signs(spark):
    akia, ghp = "AKIA" + "Q7" * 8, "ghp_" + "a1B" * 12
    hexa = "0a1b2c3d4e" * 4
    texts = [
        (f'{{"token":"{ghp}"}}', [ghp]), (f"`{akia}`", [akia]), (f"<b>{akia}</b>", [akia]), (f"_{akia}_ **{akia}**", [akia, akia]), (f"the {akia}.", [akia]),
        (f'token = "{hexa}"###', [hexa]), (f'TOKEN = "{hexa}"!!', [hexa]), (f"a={akia},b=hello1234", [akia, "hello1234"]), (f"a={akia}&b={ghp}|{hexa}", [akia, ghp, hexa]),
        ("password=correct", ["correct"]), ("password: hunter", ["hunter"]), ("the password is P@ss!w0rd", ["P@ss!w0rd"]), ("run --token abc", ["abc"]), ("Authorization: Bearer abcdef", ["abcdef"]),
        ('{"password":"hunter","user":"bob"}', ["hunter"]), ("x" * 8 + "1234==", ["x" * 8 + "1234=="]), ("a plain passing sentence about keys", []), ("user1=a.very.longword", ["a.very.longword"]),
    ]
    docs = spark.createDataFrame([(i, t, "a") for i, (t, _) in enumerate(texts)], "doc_id long, text string, source string")
    got = {}
    for r in secrets.find_candidates(docs).orderBy("doc_id", "nth", "part").collect():
        got.setdefault(r["doc_id"], []).append(r["value"])
    assert {i: got.get(i, []) for i in range(len(texts))} == {i: want for i, (_, want) in enumerate(texts)}
    out = secrets.scan_secrets(docs).where("doc_id = 8").orderBy("part").collect()
    assert [(r["nth"], r["part"], r["value_sha256"]) for r in out] == [(0, i, hashlib.sha256(v.encode()).hexdigest()) for i, v in enumerate((akia, ghp, hexa))]


def test_forest_on_given_tables(spark):
    """The given documents hold findings of both kinds, so a forest is fitted; planted keys are kept and mail addresses and numbers are not, held-out ones too."""
    docs = spark.read.parquet(DATA.replace("sf0.001", "sf0.01") + "/documents.parquet").select("doc_id", "text", "source")
    described = secrets.describe(secrets.find_candidates(docs), secrets.dictionary(docs)).persist()
    labels = {r["label"] for r in secrets.heuristic_labels(described).select("label").distinct().collect()}
    assert {0.0, 1.0} <= labels
    rows = described.select("doc_id", "nth", "part", "value", "before2", "word").collect()
    kept = {(r["doc_id"], r["nth"], r["part"]): (r["kept"], r["kind"]) for r in secrets.scan_secrets(docs).collect()}
    planted = [kept[r["doc_id"], r["nth"], r["part"]] for r in rows if re.fullmatch("[0-9a-f]{40}", r["value"])]
    harmless = [kept[r["doc_id"], r["nth"], r["part"]] for r in rows if re.search(r"@[a-z0-9.-]+[.][a-z]+$", r["value"]) or re.fullmatch("[0-9./:+-]+", r["value"])]
    assert planted and harmless and all(k for k, _ in planted) and {kind for _, kind in planted} == {"assignment"} and not any(k for k, _ in harmless)


def test_dictionary_has_no_cap(spark):
    docs = spark.range(30).select(F.col("id").alias("doc_id"), F.lit("alpha beta").alias("text"))
    assert secrets.dictionary(docs).count() == 2 and secrets.dictionary(docs, share=1.1).count() == 0


def test_licences(spark):
    mit = "MIT License\n\nCopyright (c) 2020 A\n\n" + "\n\n".join(licenses.SENTENCES[k][0].capitalize() + "." for k in ("mit-grant", "mit-notice", "as-is", "no-liability"))
    rows = [(1, mit), (2, "x. Licensed under the Apache License, Version 2.0. y"), (3, None), (4, ""), (5, "Licensed under something else."), (6, "Released under the MIT License.\nLicensed under CC BY-NC 4.0.\nReleased under the MIT License.")]
    got = {r["doc_id"]: r for r in licenses.recognise_licences(spark.createDataFrame(rows, "doc_id long, text string").withColumn("licences", F.lit(1))).collect()}
    assert got[1]["licences"] == ["MIT"] and got[2]["licences"] == ["Apache-2.0"] and got[6]["licences"] == ["CC-BY-NC-4.0", "MIT"]
    assert got[3]["licences"] == got[4]["licences"] == got[5]["licences"] == [] and got[6]["sentence_ids"] == ["mit-ref", "cc-by-nc-ref", "mit-ref"]


def test_licences_as_published(spark):
    import textwrap

    wrapped = lambda t, mark="": "\n".join(mark + x for x in textwrap.wrap(t, 60))
    known = [(name, x) for name, xs in licenses.SENTENCES.items() for x in xs]
    rows = [wrapped("Some words before. " + x[0].upper() + x[1:] + ". Some words after.", mark) for _, x in known for mark in ("", " * ", "# ")]
    bsd = """Copyright (c) 2020, A

Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this
   list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice,
   this list of conditions and the following disclaimer in the documentation
   and/or other materials provided with the distribution.
"""
    gpl = """ *  This program is free software: you can redistribute it and/or modify
 *  it under the terms of the GNU General Public License as published by
 *  the Free Software Foundation, either version 3 of the License, or
 *  (at your option) any later version.
 *
 *  This program is distributed in the hope that it will be useful,
 *  but WITHOUT ANY WARRANTY; without even the implied warranty of
 *  MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the
 *  GNU General Public License for more details.
"""
    isc = """Permission to use, copy, modify, and/or distribute this software for any\r
purpose with or without fee is hereby granted, provided that the above\r
copyright notice and this permission notice appear in all copies.\r
"""
    apache = """# Licensed under the Apache License, Version 2.0 (the "License"); you
# may not use this file except in compliance with the License. You may
# obtain a copy of the License at
#
#     http://www.apache.org/licenses/LICENSE-2.0
"""
    mpl = "This Source Code Form is subject to the terms of the Mozilla Public\nLicense, v. 2.0. If a copy of the MPL was not distributed"
    full = [(bsd, ["BSD-2-Clause"]), (gpl, ["GPL-3.0-or-later"]), (isc, ["ISC"]), (apache, ["Apache-2.0"]), (mpl, ["MPL-2.0"]), ("// SPDX-License-Identifier: MIT\nint x;", ["MIT"])]
    full += [("SPDX-License-Identifier: MIT-0", []), ("Released under the\n\nMIT License and more", []), ("Licensed under the GNU General Public License version 3 or later.", [])]
    docs = [(i, t) for i, t in enumerate(rows + [t for t, _ in full])]
    got = {r["doc_id"]: r for r in licenses.recognise_licences(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert [got[i]["sentence_ids"] for i in range(len(rows))] == [[name] for name, _ in known for _ in range(3)]
    assert [got[len(rows) + i]["licences"] for i in range(len(full))] == [want for _, want in full]


# 6 -----------------------------------------------------------------------------------------------------------------


def _plain_repeats(texts: list[bytes], least: int, keep_first: bool):
    seen: dict[bytes, list] = {}
    for d, t in enumerate(texts):
        for i in range(len(t) - least + 1):
            seen.setdefault(t[i : i + least], []).append((d, i))
    out = []
    for d, t in enumerate(texts):
        cov = bytearray(len(t))
        for i in range(len(t) - least + 1):
            places = seen[t[i : i + least]]
            if len(places) > 1 and not (keep_first and places[0] == (d, i)):
                cov[i : i + least] = b"\1" * least
        spans = sum(1 for i in range(len(t)) if cov[i] and (i == 0 or not cov[i - 1]))
        kept = bytes(b for b, m in zip(t, cov, strict=True) if not m)
        out.append((len(t), sum(cov), spans, hashlib.sha256(kept).hexdigest()))
    return out


@pytest.mark.parametrize("keep_first", [False, True])
@pytest.mark.parametrize("hot", [20_000, 3])
def test_repeats(spark, keep_first, hot, monkeypatch):
    random.seed(5)
    word = lambda: "".join(random.choices("abcdeé", k=random.randint(2, 9)))
    make = lambda n: " ".join(word() for _ in range(n))
    passage, base = make(60), make(200)
    texts = [base, base, base[:600] + make(5) + base[600:], make(40) + passage, passage + make(50), make(10) + passage[30:] + make(3), "", "ha " * 300, "x" * 199, "x" * 205, None, make(300)]
    texts += [make(20) + passage + make(20) for _ in range(8)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("n_removed", F.lit("clash"))
    monkeypatch.setattr(suffix, "repeat_runs", functools.partial(suffix.repeat_runs, hot=hot, crowded=3))
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in suffix.remove_repeats(docs, keep_first=keep_first).collect()}
    assert [got[i] for i in range(len(texts))] == _plain_repeats([(t or "").encode() for t in texts], 200, keep_first)


def test_repeats_odd(spark, odd, none):
    got = suffix.remove_repeats(odd).collect()
    assert len(got) == len(ODD) and suffix.remove_repeats(none).count() == 0
    six = next(r for r in got if r["doc_id"] == 6)
    assert six["n_bytes"] == 1500 and six["n_removed"] > 1200


def test_longest_factors():
    rng = np.random.default_rng(1)
    text = rng.integers(0, 2, 400).astype(np.uint8)
    starts = np.arange(380)
    order, lcp = suffix.suffix_order(text, starts, 20)
    subs = [text[i : i + 20].tobytes() for i in starts]
    shared = lambda x, y: next(d for d in (20, 10, 5, 0) if x[:d] == y[:d])
    assert lcp.tolist() == [0, *(shared(subs[i], subs[j]) for i, j in zip(order, order[1:], strict=False))]
    assert suffix.longest_factors(order, lcp).tolist() == [max((shared(s, x) for x in subs[:i]), default=0) for i, s in enumerate(subs)]
    later = suffix.longest_factors(len(order) - 1 - order, lcp)[::-1]
    assert later.tolist() == [max((shared(s, x) for x in subs[i + 1 :]), default=0) for i, s in enumerate(subs)]


def test_merged_runs():
    key, start, end = suffix.merged(np.array([2, 1, 1, 1, 2, 1]), np.array([0, 5, 0, 30, 9, 7]), np.array([9, 8, 5, 31, 12, 20]))
    assert list(zip(key.tolist(), start.tolist(), end.tolist(), strict=True)) == [(1, 0, 20), (1, 30, 31), (2, 0, 12)]


# 7 -----------------------------------------------------------------------------------------------------------------


def test_mixing(spark, odd, none):
    random.seed(7)
    rows = [(i, "w " * random.randint(1, 300), "en", random.choice(["a", "b", "b", "c", "c", "c", None]), 0) for i in range(3000)]
    got = mixing.mix_sources(spark.createDataFrame(rows, DOC)).collect()
    sizes, taken, target = Counter(), Counter(), {}
    for r in got:
        sizes[r["source"]] += r["mix_size"]
        taken[r["source"]] += r["mix_size"] * r["mix_copies"]
        target[r["source"]] = r["mix_target"]
        assert 0 <= r["mix_copies"] <= 2
    assert len(got) == 3000 and sum(target.values()) == pytest.approx(1.5 * sum(sizes.values()))
    for s in sizes:
        assert target[s] <= 2 * sizes[s] + 1e-6 and abs(taken[s] - target[s]) < 0.02 * sizes[s] + 300
    assert mixing.mix_sources(odd).count() == len(ODD) and mixing.mix_sources(none).count() == 0


def test_targets_water_fill(spark):
    sizes = [("a", 10), ("b", 1000), ("c", 100), ("d", 0)]
    got = {r["source"]: r["target"] for r in mixing.source_targets(spark.createDataFrame(sizes, "source string, source_size long")).collect()}
    left, free, target = 1.5 * 1110, {"a": 3, "b": 1, "c": 2, "d": 3}, {}
    caps = {k: 2 * v for k, v in sizes}
    while True:
        level = left / sum(free.values())
        over = [k for k in free if level * free[k] > caps[k]]
        if not over:
            break
        for k in over:
            target[k] = caps[k]
            left -= caps[k]
            del free[k]
    target |= {k: level * w for k, w in free.items()}
    assert got == pytest.approx(target)


# 8 -----------------------------------------------------------------------------------------------------------------


def _pictures(n: int) -> list[tuple[int, bytes]]:
    rng = np.random.default_rng(4)
    rows = []
    for i in range(n):
        v = rng.normal(size=16).tolist()
        rows += [(10 * i + e, media.draw(v, e)) for e in range(media.EDITS + 1)] + [(10 * i + 9, media.draw(v, 0))]
    return rows


def test_media(spark):
    rows = _pictures(12)
    odd = [(900, None), (901, b""), (902, b"P5\n3 3"), (903, b"P5"), (904, b"nothing"), (905, b"P5\n9999999 9\n255\n"), (910, media.encode(np.zeros((60, 60)))), (911, media.encode(np.zeros((60, 60)))), (None, media.draw([9.0], 0)), (912, media.draw([9.0], 0)), (912, media.draw([9.0], 0)), (None, None)]
    frame = spark.createDataFrame(rows + odd, "id long, image binary").withColumns({c: F.lit("x") for c in ("node", "k", "copies", "class_id")})
    got = media.group_copies(frame).collect()
    assert len(got) == len(rows + odd)
    classes = {r["id"]: r["class_id"] for r in got if r["id"] is not None}
    # Recall over all edits, and of each kind; no picture is in the class of another.
    recall = [np.mean([classes[10 * i + e] == 10 * i for i in range(12)]) for e in range(1, media.EDITS + 1)]
    assert np.mean(recall) >= 0.95 and min(recall) >= 0.8, recall
    assert all(classes[i] // 10 == i // 10 for i, _ in rows) and all(classes[10 * i + 9] == 10 * i for i in range(12))
    assert classes[900] == 900 and classes[902] == 902 and classes[911] == 910
    assert Counter((r["class_id"], r["copies"]) for r in got if r["id"] in (None, 912)) == {(912, 3): 3, (None, 1): 1}
    assert media.group_copies(spark.createDataFrame([], "id long, image binary")).count() == 0


def test_media_crowded_keys(spark):
    rows = _pictures(5)
    features = media.extract(spark.createDataFrame([(i, i, x) for i, x in rows], "id long, node long, image binary")).where("kind = 1").cache()
    few = {r["node"]: r["component"] for r in media.link_images(features).collect()}
    assert {r["node"]: r["component"] for r in media.link_images(features, small=1).collect()} == few and len(set(few.values())) == 5


# 9 -----------------------------------------------------------------------------------------------------------------


def _plain_contamination(docs, items):
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    low = lambda t: word.findall((t or "").translate({i: i + 32 for i in range(65, 91)}))
    windows = {}
    for item, text in items:
        w = low(text)
        for s in range(max(1, len(w) - 12) if w else 0):
            windows.setdefault(tuple(w[s : s + 13]), set()).add(item)
    out = {}
    for doc, text in docs:
        w = low(text)
        hit, found = set(), set()
        for win, ids in windows.items():
            for s in range(len(w) - len(win) + 1):
                if tuple(w[s : s + len(win)]) == win:
                    hit |= set(range(s, s + len(win)))
                    found |= ids
        out[doc] = (len(w), len(hit), sorted(map(str, found)))
    return out


def test_contamination(spark):
    random.seed(9)
    make = lambda n: " ".join("".join(random.choices("abcé", k=3)) for _ in range(n))
    items = [(i, make(30)) for i in range(5)] + [(7, "Só, short one"), (8, None), (9, ""), (10, "...")]
    q = items[0][1]
    docs = [(1, make(20) + " " + q.upper().replace("É", "é") + " " + make(20)), (2, q.replace(" ", ", ")), (3, "a Só... SHORT one b"), (4, None), (5, ""), (6, make(200)), (7, " ".join(q.split()[5:18]) + " " + make(400)), (8, " ".join(q.split()[:12]))]
    d, b = spark.createDataFrame(docs, "doc_id long, text string").withColumn("items", F.lit(0)), spark.createDataFrame(items, "item_id long, text string")
    want = _plain_contamination(docs, items)
    for size in (32_000_000, 60):  # one block, and several
        rows = decontamination.find_contamination(d, b, block_bytes=size).collect()
        assert {r["doc_id"]: (r["n_words"], r["n_hit"], list(r["items"])) for r in rows} == want
    by = {r["doc_id"]: r for r in rows}
    assert by[1]["contaminated"] and not by[6]["contaminated"] and not by[7]["contaminated"]
    s = by[3]["spans"][0]
    assert docs[2][1][s["start"] : s["end"]] == "Só... SHORT one"
    assert decontamination.find_contamination(d, b.where("item_id = 8")).where("contaminated").count() == 0


# 10 ----------------------------------------------------------------------------------------------------------------


def _plain_groups(docs):
    sets = {}
    for d, t in docs:
        w = (t or "").translate({i: i + 32 for i in range(65, 91)}).split()
        sets[d] = {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()
    comp = {d: d for d in sets}

    def find(x):
        while comp[x] != x:
            x = comp[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[:i]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 75 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                comp[y] = x
    return {d: (len(sets[d]), find(d)) for d in ids}


@pytest.mark.parametrize("sizes", [{}, {"cell": 8, "most_common": 30, "common_share": 0.01}, {"cell": 5, "most_common": 0}])
def test_jaccard(spark, sizes, monkeypatch):
    levels = []
    cut = jaccard._cut_region
    monkeypatch.setattr(jaccard, "_cut_region", lambda hundredths: levels.append(1) or cut(hundredths))
    random.seed(10)
    vocabulary = ["".join(random.choices("abcdef", k=4)) for _ in range(400)]
    make = lambda n: random.choices(vocabulary, k=n)
    passage, base = make(40), make(120)
    docs = [(1, None), (2, ""), (3, "a b"), (4, "A  B"), (5, "a b c d e"), (6, "b a")]
    for i in range(60):
        w = list(base)
        for _ in range(random.randint(0, 6)):
            w[random.randrange(len(w))] = random.choice(vocabulary)
        docs.append((100 + i, " ".join(w)))
    docs += [(200 + i, " ".join(make(60) + passage + make(10))) for i in range(30)]
    docs += [(300 + i, " ".join(base)) for i in range(10)]
    # Families near the threshold that share a rare passage, which makes them one region of several groups.
    rare = [f"r{i}" for i in range(12)]
    for f in range(6):
        own = make(48)
        for i in range(14):
            w = list(own)
            for _ in range(random.randint(0, 3)):
                w[random.randrange(len(w))] = random.choice(vocabulary)
            docs.append((1000 + 20 * f + i, " ".join(rare + w)))
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.jaccard_groups(spark.createDataFrame(docs, "doc_id long, text string"), **sizes).collect()}
    assert got == _plain_groups(docs)
    assert len(levels) >= (2 if sizes.get("cell") == 5 else 0)


def test_jaccard_odd(spark, odd, none):
    got = jaccard.jaccard_groups(odd).collect()
    assert len(got) == len(ODD) and {r["component_id"] for r in got if r["doc_id"] in (4, 5)} == {4}
    assert jaccard.jaccard_groups(none).count() == 0
    assert jaccard.keep_one_of_each(odd).select("doc_id").where("doc_id = 5").count() == 0


def test_jaccard_rows_without_own_id(spark):
    words = [f"w{i}" for i in range(60)]
    far = lambda w, n, tag: " ".join(w[:n] + [f"{tag}{i}" for i in range(60 - n)])
    middle, a, b = " ".join(words), far(words, 54, "a"), " ".join([f"b{i}" for i in range(6)] + words[6:])
    docs = [(1, a), (None, middle), (None, middle), (2, b), (7, "x y z"), (7, "x y z"), (8, "one two"), (8, b), (None, "own"), (None, "own"), (None, None), (None, ""), (9, ""), (9, "")]
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    assert jaccard.jaccard_groups(frame).where("doc_id in (1, 2)").select("component_id").distinct().collect() == [(1,)]
    got = sorted(((r["doc_id"], r["text"]) for r in jaccard.keep_one_of_each(frame).collect()), key=str)
    assert got == sorted([(1, a), (7, "x y z"), (8, "one two"), (None, "own"), (None, None), (None, ""), (9, ""), (9, "")], key=str)


def test_components(spark):
    chain = [(i, i + 1) for i in range(0, 60)] + [(100, 101), (103, 101), (7, 7), (None, 3)]
    got = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert {got[i] for i in range(61)} == {0} and got[103] == 100 and len(got) == 64


# The pipeline ---------------------------------------------------------------------------------------------------------


def test_pipeline(spark, tmp_path):
    import corpus_pipeline

    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    kept = {"documents": docs}
    out = docs
    for name, stage in corpus_pipeline.STAGES:
        result = stage(spark, out, DATA)
        if name != "sharding":
            assert result.columns == docs.columns
        result.write.parquet(str(tmp_path / name))
        out = kept[name] = spark.read.parquet(str(tmp_path / name))
    ids = {n: [r["doc_id"] for r in d.select("doc_id").collect()] for n, d in kept.items()}
    texts = dict(docs.select("doc_id", "text").collect())
    after = [(i, texts[i]) for i in ids["toxicity"]]
    assert sorted(ids["near_duplicates"]) == sorted(i for i, (_, c) in _plain_groups(after).items() if i == c)
    items = [tuple(r) for r in spark.read.parquet(f"{DATA}/benchmark.parquet").select("item_id", "text").collect()]
    hit = _plain_contamination([(i, texts[i]) for i in ids["near_duplicates"]], items)
    assert sorted(ids["decontamination"]) == sorted(i for i, (n, h, _) in hit.items() if not (h and 20 * h >= n))
    assert set(ids["mixing"]) <= set(ids["decontamination"]) and sorted(ids["sharding"]) == sorted(ids["mixing"])
