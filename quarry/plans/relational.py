"""Scans, predicates, joins, aggregates, ranks, sorts and set operations of the directory, on the driver's tables.

Stand-ins: supplier is a company, nation and region its place, (l_suppkey, p_brand) with a share of returned lines under a quarter a published capability,
(l_suppkey, p_type) a certification, customer a buyer, orders a request, (l_orderkey, l_suppkey) a recipient, events an event log.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarry.operators.relational import anti_join, first_per_key, first_with_one, latest_per_key, paged, rank_within, semi_join_any, upsert
from quarry.plans.registry import Tables, query

EDGES_SQL = """edges AS (
  SELECT l_suppkey, p_brand, avg(CASE WHEN l_returnflag = 'R' THEN 1.0 ELSE 0.0 END) < 0.25 AS published
  FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2)"""
RECIPIENTS_SQL = """recipients AS (
  SELECT l_orderkey, l_suppkey, min(CASE WHEN l_returnflag = 'R' THEN 'DECLINED' WHEN l_returnflag = 'A' THEN 'INTERESTED' WHEN l_linestatus = 'O' THEN 'PENDING' ELSE 'QUOTE_SUBMITTED' END) AS status
  FROM lineitem GROUP BY 1, 2)"""


def edges(t: Tables) -> DataFrame:
    """Capability edges: one row for each supplier and brand, published or not."""
    lines = t.lineitem.select("l_partkey", "l_suppkey", "l_returnflag").join(t.part.select("p_partkey", "p_brand"), F.col("l_partkey") == F.col("p_partkey"))
    return lines.groupBy("l_suppkey", "p_brand").agg((F.avg(F.when(F.col("l_returnflag") == "R", 1.0).otherwise(0.0)) < 0.25).alias("published"))


def recipients(t: Tables) -> DataFrame:
    """Request recipients with a response status."""
    status = F.when(F.col("l_returnflag") == "R", "DECLINED").when(F.col("l_returnflag") == "A", "INTERESTED").when(F.col("l_linestatus") == "O", "PENDING").otherwise("QUOTE_SUBMITTED")
    return t.lineitem.groupBy("l_orderkey", "l_suppkey").agg(F.min(status).alias("status"))


# Scans and sinks ------------------------------------------------------------------------------------------------


@query("s1_scan", "SELECT s_suppkey, s_name, n_name FROM supplier JOIN nation ON s_nationkey = n_nationkey WHERE s_acctbal > 0 ORDER BY s_name, s_suppkey LIMIT 50")
def s1(t):
    rows = t.supplier.where("s_acctbal > 0").join(t.nation, F.col("s_nationkey") == F.col("n_nationkey"))
    return rows.select("s_suppkey", "s_name", "n_name").orderBy("s_name", "s_suppkey").limit(50)


@query("s2_point_lookup", "SELECT o_orderkey, o_custkey, o_totalprice FROM orders WHERE o_orderkey = (SELECT max(o_orderkey) FROM orders)")
def s2(t):
    newest = t.orders.agg(F.max("o_orderkey").alias("k"))
    return t.orders.join(F.broadcast(newest), F.col("o_orderkey") == F.col("k")).select("o_orderkey", "o_custkey", "o_totalprice")


@query("s3_keyset_scan", "SELECT l_orderkey, l_linenumber FROM lineitem ORDER BY l_orderkey, l_linenumber LIMIT 20000")
def s3(t):
    """The capped keyset scan: 20 000 rows by ascending key. Spark needs no paging; the cap is the feature."""
    return t.lineitem.select("l_orderkey", "l_linenumber").orderBy("l_orderkey", "l_linenumber").limit(20_000)


@query(
    "s9_taxonomy_merge",
    "WITH db AS (SELECT DISTINCT p_brand AS slug, 'db' AS origin FROM part WHERE p_size <= 10), st AS (SELECT DISTINCT p_brand AS slug, 'static' AS origin FROM part) SELECT * FROM db UNION ALL SELECT * FROM st WHERE slug NOT IN (SELECT slug FROM db)",
)
def s9(t):
    db = t.part.where("p_size <= 10").select(F.col("p_brand").alias("slug")).distinct().withColumn("origin", F.lit("db"))
    static = t.part.select(F.col("p_brand").alias("slug")).distinct().withColumn("origin", F.lit("static"))
    return db.unionByName(anti_join(static, db, ["slug"]))


@query(
    "k2_upsert",
    """WITH o AS (SELECT o_custkey AS k, max(o_totalprice) AS v FROM orders WHERE o_orderdate < TIMESTAMP '1996-01-01' GROUP BY 1), n AS (SELECT o_custkey AS k, max(o_totalprice) AS v FROM orders WHERE o_orderdate >= TIMESTAMP '1996-01-01' GROUP BY 1)
    SELECT k, coalesce(n.v, o.v) AS v, CASE WHEN o.v IS NULL THEN 'created' WHEN n.v IS NULL THEN 'kept' ELSE 'updated' END AS outcome FROM o FULL JOIN n USING (k)""",
)
def k2(t):
    """Customers' dearest orders before 1996, brought up to date by those made since."""
    dearest = lambda rows: rows.groupBy(F.col("o_custkey").alias("k")).agg(F.max("o_totalprice").alias("v"))
    since = F.col("o_orderdate") >= F.lit("1996-01-01").cast("timestamp")
    return upsert(dearest(t.orders.where(~since)), dearest(t.orders.where(since)), ["k"])


@query("k3_conditional_update", "SELECT o_orderkey, CASE WHEN o_orderstatus = 'P' AND o_totalprice < 100000 THEN 'O' ELSE o_orderstatus END AS o_orderstatus FROM orders")
def k3(t):
    stale = (F.col("o_orderstatus") == "P") & (F.col("o_totalprice") < 100_000)
    return t.orders.select("o_orderkey", F.when(stale, "O").otherwise(F.col("o_orderstatus")).alias("o_orderstatus"))


@query("k4_predicate_delete", "SELECT o_orderkey FROM orders WHERE NOT (o_orderstatus = 'F' AND o_totalprice < 50000)")
def k4(t):
    return t.orders.where(~((F.col("o_orderstatus") == "F") & (F.col("o_totalprice") < 50_000))).select("o_orderkey")


# Projections and predicates ---------------------------------------------------------------------------------------


@query("f3_case_insensitive_equality", "SELECT c_custkey FROM customer WHERE lower(c_mktsegment) = lower('Building')")
def f3(t):
    return t.customer.where(F.lower("c_mktsegment") == "building").select("c_custkey")


@query("f4_substring", "SELECT p_partkey, p_name FROM part WHERE contains(lower(p_name), 'a')")
def f4(t):
    return t.part.where(F.contains(F.lower("p_name"), F.lit(" a ".strip()))).select("p_partkey", "p_name")


@query("f5_in_list", "SELECT s_suppkey FROM supplier WHERE s_nationkey IN (1, 3, 5) AND s_suppkey NOT IN (2, 4)")
def f5(t):
    return t.supplier.where(F.col("s_nationkey").isin(1, 3, 5) & ~F.col("s_suppkey").isin(2, 4)).select("s_suppkey")


@query("f6_or_not", "SELECT o_orderkey FROM orders WHERE (o_orderstatus = 'F' OR o_orderpriority LIKE '1%') AND NOT (o_totalprice < 1000 OR o_custkey % 7 = 0)")
def f6(t):
    either = (F.col("o_orderstatus") == "F") | F.col("o_orderpriority").startswith("1")
    return t.orders.where(either & ~((F.col("o_totalprice") < 1000) | (F.col("o_custkey") % 7 == 0))).select("o_orderkey")


@query("f7_time_range", "SELECT event_id FROM events WHERE ts < TIMESTAMP '2024-01-15 00:00:00'")
def f7(t):
    return t.events.where(F.col("ts") < F.lit("2024-01-15 00:00:00").cast("timestamp_ntz")).select("event_id")


@query("f8_post_page_filter", "SELECT s_suppkey, total FROM (SELECT s_suppkey, s_acctbal, s_name, count(*) OVER () AS total FROM supplier ORDER BY s_name, s_suppkey LIMIT 20) WHERE s_acctbal > 0")
def f8(t):
    """Parity mode: the filter comes after paging and the total is not adjusted."""
    page = t.supplier.orderBy("s_name", "s_suppkey").limit(20)
    return page.crossJoin(F.broadcast(t.supplier.agg(F.count("*").alias("total")))).where("s_acctbal > 0").select("s_suppkey", "total")


@query("f9_all_words", "SELECT p_partkey FROM part WHERE contains(lower(p_name || ' ' || p_brand || ' ' || p_type), 'brand') AND contains(lower(p_name || ' ' || p_brand || ' ' || p_type), '1')")
def f9(t):
    words = F.split(F.lower(F.lit("Brand 1")), r"\s+")
    hay = F.lower(F.concat_ws(" ", "p_name", "p_brand", "p_type"))
    return t.part.where(F.forall(words, lambda w: F.contains(hay, w))).select("p_partkey")


ALL_BRANDS = "SELECT l_suppkey FROM edges WHERE published AND p_brand IN (SELECT p_brand FROM (SELECT DISTINCT p_brand FROM part) ORDER BY p_brand LIMIT 2) GROUP BY 1 HAVING count(*) = 2"


@query("f10_all_of_facet", f"WITH {EDGES_SQL} {ALL_BRANDS}")
def f10(t):
    wanted = t.part.select("p_brand").distinct().orderBy("p_brand").limit(2)
    have = edges(t).where("published").join(F.broadcast(wanted), "p_brand")
    return have.groupBy("l_suppkey").count().where("count = 2").select("l_suppkey")


# Joins --------------------------------------------------------------------------------------------------------------


@query("j1_left_join", "SELECT n_name, r_name FROM nation LEFT JOIN region ON n_regionkey = r_regionkey AND r_regionkey < 3")
def j1(t):
    return t.nation.join(t.region.where("r_regionkey < 3"), F.col("n_regionkey") == F.col("r_regionkey"), "left").select("n_name", "r_name")


@query("j2_semi_join", f"WITH {EDGES_SQL} SELECT s_suppkey FROM supplier WHERE s_suppkey IN (SELECT l_suppkey FROM edges WHERE published AND p_brand LIKE '%1%')")
def j2(t):
    return semi_join_any(t.supplier, edges(t).where(F.col("published") & F.contains("p_brand", F.lit("1"))), "s_suppkey", "l_suppkey").select("s_suppkey")


@query("j3_semi_join_in_or", f"WITH {EDGES_SQL} SELECT s_suppkey FROM supplier WHERE contains(s_name, '7') OR s_acctbal < 0 OR s_suppkey IN (SELECT l_suppkey FROM edges WHERE published)")
def j3(t):
    hits = edges(t).where("published").select(F.col("l_suppkey").alias("s_suppkey")).distinct().withColumn("hit", F.lit(True))
    rows = t.supplier.join(hits, "s_suppkey", "left")
    return rows.where(F.contains("s_name", F.lit("7")) | (F.col("s_acctbal") < 0) | F.coalesce("hit", F.lit(False))).select("s_suppkey")


@query("j4_nested_collection", f"WITH {EDGES_SQL} SELECT s_suppkey, coalesce(string_agg(p_brand, ',' ORDER BY p_brand), '') AS brands FROM supplier LEFT JOIN (SELECT * FROM edges WHERE published) e ON s_suppkey = l_suppkey GROUP BY 1")
def j4(t):
    nested = edges(t).where("published").groupBy("l_suppkey").agg(F.array_join(F.array_sort(F.collect_list("p_brand")), ",").alias("brands"))
    return t.supplier.join(nested, F.col("s_suppkey") == F.col("l_suppkey"), "left").select("s_suppkey", F.coalesce("brands", F.lit("")).alias("brands"))


LATEST_SQL = "SELECT l_suppkey, l_orderkey, l_linenumber FROM (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_shipdate DESC, l_orderkey DESC, l_linenumber DESC) AS rn FROM lineitem) WHERE rn = 1"


@query("j5_top1_per_parent", LATEST_SQL)
def j5(t):
    return latest_per_key(t.lineitem, ["l_suppkey"], ["l_shipdate", "l_orderkey", "l_linenumber"]).select("l_suppkey", "l_orderkey", "l_linenumber")


@query("j6_anti_join", "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 200000)")
def j6(t):
    big = t.orders.where("o_totalprice > 200000").select(F.col("o_custkey").alias("c_custkey"))
    return anti_join(t.customer, big, ["c_custkey"]).select("c_custkey")


@query("j7_lookup_join", "SELECT d.doc_id, quality FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id")
def j7(t):
    return t.documents.select("doc_id").join(t.labels.select("doc_id", "quality"), "doc_id", "left")


TERMS = ["rend", "that", "und", "les", "ción"]


@query(
    "j9_dictionary_join",
    "SELECT doc_id, term FROM documents, (SELECT unnest(['rend', 'that', 'und', 'les', 'ción']) AS term) WHERE regexp_matches(lower(text), '(^|[^\\p{L}\\p{N}])' || term || '($|[^\\p{L}\\p{N}])')",
)
def j9(t):
    """Every text against a fixed dictionary: one pass over the text, no cross join."""
    hits = [F.when(F.lower("text").rlike(rf"(?<![\p{{L}}\p{{N}}]){term}(?![\p{{L}}\p{{N}}])"), F.lit(term)) for term in TERMS]
    return t.documents.select("doc_id", F.explode(F.array_compact(F.array(*hits))).alias("term"))


@query(
    "j11_resolution_cascade",
    "SELECT c_custkey, CASE WHEN a.n_name IS NOT NULL THEN 'slug' WHEN b.n_name IS NOT NULL THEN 'name' ELSE 'none' END AS level, coalesce(a.n_name, b.n_name) AS resolved FROM customer LEFT JOIN (SELECT * FROM nation WHERE n_nationkey < 10) a ON c_nationkey = a.n_nationkey LEFT JOIN (SELECT * FROM nation WHERE n_nationkey < 20) b ON 'NATION_' || c_nationkey = b.n_name",
)
def j11(t):
    slug = t.nation.where("n_nationkey < 10").select(F.col("n_nationkey").alias("c_nationkey"), F.col("n_name").alias("by_slug"))
    name = t.nation.where("n_nationkey < 20").select(F.col("n_name").alias("by_name"))
    rows = t.customer.join(F.broadcast(slug), "c_nationkey", "left").join(F.broadcast(name), F.concat(F.lit("NATION_"), "c_nationkey") == F.col("by_name"), "left")
    level = F.when(F.col("by_slug").isNotNull(), "slug").when(F.col("by_name").isNotNull(), "name").otherwise("none")
    return rows.select("c_custkey", level.alias("level"), F.coalesce("by_slug", "by_name").alias("resolved"))


@query("j12_self_hierarchy", "SELECT r_name AS parent, n_name AS child, count(s_suppkey) AS n FROM region JOIN nation ON r_regionkey = n_regionkey LEFT JOIN supplier ON s_nationkey = n_nationkey GROUP BY 1, 2")
def j12(t):
    tree = t.region.join(t.nation, F.col("r_regionkey") == F.col("n_regionkey"))
    n = t.supplier.groupBy("s_nationkey").agg(F.count("*").alias("n"))
    return tree.join(n, F.col("s_nationkey") == F.col("n_nationkey"), "left").select(F.col("r_name").alias("parent"), F.col("n_name").alias("child"), F.coalesce("n", F.lit(0)).alias("n"))


@query("j13_u1_intersect", "SELECT DISTINCT o_custkey FROM orders WHERE o_orderstatus = 'F' INTERSECT SELECT o_custkey FROM orders WHERE o_orderstatus = 'P'")
def j13(t):
    return t.orders.where("o_orderstatus = 'F'").select("o_custkey").intersect(t.orders.where("o_orderstatus = 'P'").select("o_custkey"))


# Aggregates -----------------------------------------------------------------------------------------------------------


@query("a1_global_counts", "SELECT count(*) AS n, count(*) FILTER (s_acctbal > 0) AS positive, count(*) FILTER (s_nationkey = 1) AS first_nation FROM supplier")
def a1(t):
    return t.supplier.agg(F.count("*").alias("n"), F.count_if(F.col("s_acctbal") > 0).alias("positive"), F.count_if(F.col("s_nationkey") == 1).alias("first_nation"))


@query("a2_group_count", "SELECT o_orderstatus, count(*) AS n FROM orders GROUP BY 1")
def a2(t):
    return t.orders.groupBy("o_orderstatus").agg(F.count("*").alias("n"))


@query("a3_group_count_two_keys", "SELECT o_orderpriority, o_orderstatus, count(*) AS n FROM orders GROUP BY 1, 2 ORDER BY 1")
def a3(t):
    return t.orders.groupBy("o_orderpriority", "o_orderstatus").agg(F.count("*").alias("n")).orderBy("o_orderpriority")


@query("a4_distinct_keys", f"WITH {EDGES_SQL} SELECT count(DISTINCT l_suppkey) FILTER (published) AS with_capability, count(DISTINCT l_suppkey) AS suppliers FROM edges")
def a4(t):
    return edges(t).agg(F.countDistinct(F.when(F.col("published"), F.col("l_suppkey"))).alias("with_capability"), F.countDistinct("l_suppkey").alias("suppliers"))


@query("a5_distinct_on", "SELECT DISTINCT c_mktsegment FROM customer")
def a5(t):
    return t.customer.select("c_mktsegment").dropDuplicates(["c_mktsegment"])


@query("a6_conditional_counts", f"WITH {RECIPIENTS_SQL} SELECT l_orderkey, count(*) AS recipients, count(*) FILTER (status <> 'PENDING') AS responded, count(*) FILTER (status = 'QUOTE_SUBMITTED') AS quoted FROM recipients GROUP BY 1")
def a6(t):
    return recipients(t).groupBy("l_orderkey").agg(
        F.count("*").alias("recipients"), F.count_if(F.col("status") != "PENDING").alias("responded"), F.count_if(F.col("status") == "QUOTE_SUBMITTED").alias("quoted")
    )


@query(
    "a7_status_pivot",
    f"WITH {RECIPIENTS_SQL} SELECT l_suppkey, count(*) FILTER (status = 'PENDING') AS new, count(*) FILTER (status IN ('INTERESTED', 'QUOTE_SUBMITTED')) AS responded, count(*) FILTER (status = 'DECLINED') AS declined, count(*) FILTER (status = 'QUOTE_SUBMITTED') AS quotes, count(*) AS total FROM recipients GROUP BY 1",
)
def a7(t):
    s = F.col("status")
    return recipients(t).groupBy("l_suppkey").agg(
        F.count_if(s == "PENDING").alias("new"), F.count_if(s.isin("INTERESTED", "QUOTE_SUBMITTED")).alias("responded"), F.count_if(s == "DECLINED").alias("declined"),
        F.count_if(s == "QUOTE_SUBMITTED").alias("quotes"), F.count("*").alias("total"),
    )


@query("a10_averages", "SELECT s_nationkey, round(coalesce(sum(lines) / nullif(count(*), 0), 0), 6)::DOUBLE AS lines_per_supplier FROM supplier LEFT JOIN (SELECT l_suppkey, count(*) AS lines FROM lineitem GROUP BY 1) ON s_suppkey = l_suppkey GROUP BY 1")
def a10(t):
    lines = t.lineitem.groupBy("l_suppkey").agg(F.count("*").alias("lines"))
    rows = t.supplier.join(lines, F.col("s_suppkey") == F.col("l_suppkey"), "left")
    return rows.groupBy("s_nationkey").agg(F.round(F.coalesce(F.sum("lines") / F.nullif(F.count("*"), F.lit(0)), F.lit(0.0)), 6).alias("lines_per_supplier"))


@query("a11_group_max", "SELECT l_suppkey, max(l_discount) AS strongest FROM lineitem GROUP BY 1")
def a11(t):
    return t.lineitem.groupBy("l_suppkey").agg(F.max("l_discount").alias("strongest"))


@query("a12_tally", "SELECT k AS outcome, count(o_orderkey) AS n FROM (SELECT unnest(['F', 'O', 'P', 'X']) AS k) LEFT JOIN orders ON o_orderstatus = k GROUP BY 1")
def a12(t):
    keys = t.spark.createDataFrame([(k,) for k in "FOPX"], "outcome string")
    n = t.orders.groupBy(F.col("o_orderstatus").alias("outcome")).agg(F.count("*").alias("n"))
    return keys.join(n, "outcome", "left").select("outcome", F.coalesce("n", F.lit(0)).alias("n"))


@query(
    "a13_vote",
    "SELECT o_custkey, CASE WHEN n < 3 THEN 'none' WHEN f * 2 >= n AND f > o AND f > p THEN 'F' WHEN o * 2 >= n AND o > f AND o > p THEN 'O' WHEN p * 2 >= n AND p > f AND p > o THEN 'P' ELSE 'none' END AS verdict FROM (SELECT o_custkey, count(*) AS n, count(*) FILTER (o_orderstatus = 'F') AS f, count(*) FILTER (o_orderstatus = 'O') AS o, count(*) FILTER (o_orderstatus = 'P') AS p FROM orders GROUP BY 1)",
)
def a13(t):
    """Majority vote of at least three members: half of them, rounded up, and strictly more than either other kind."""
    kinds = ["F", "O", "P"]
    votes = t.orders.groupBy("o_custkey").agg(F.count("*").alias("n"), *[F.count_if(F.col("o_orderstatus") == k).alias(k) for k in kinds])
    verdict = F.when(F.col("n") < 3, "none")
    for k in kinds:
        others = [F.col(x) for x in kinds if x != k]
        verdict = verdict.when((F.col(k) * 2 >= F.col("n")) & (F.col(k) > F.greatest(*others)), k)
    return votes.select("o_custkey", verdict.otherwise("none").alias("verdict"))


@query(
    "a14_most_linked",
    "SELECT o_orderpriority, o_custkey, n FROM (SELECT *, row_number() OVER (PARTITION BY o_orderpriority ORDER BY n DESC, seq) AS rn FROM (SELECT o_orderpriority, o_custkey, count(*) AS n, min(o_orderkey) AS seq FROM orders GROUP BY 1, 2)) WHERE rn = 1",
)
def a14(t):
    counted = t.orders.groupBy("o_orderpriority", "o_custkey").agg(F.count("*").alias("n"), F.min("o_orderkey").alias("seq"))
    best = counted.groupBy("o_orderpriority").agg(F.max_by(F.struct("o_custkey", "n"), F.struct("n", (-F.col("seq")).alias("early"))).alias("b"))
    return best.select("o_orderpriority", "b.o_custkey", "b.n")


@query("a15_existence_flags", "SELECT l_suppkey, bool_or(l_returnflag = 'R') AS has_returns, bool_or(l_linestatus = 'O') AS has_open, bool_or(l_discount > 0.09) AS has_discount FROM lineitem GROUP BY 1")
def a15(t):
    return t.lineitem.groupBy("l_suppkey").agg(
        F.bool_or(F.col("l_returnflag") == "R").alias("has_returns"), F.bool_or(F.col("l_linestatus") == "O").alias("has_open"), F.bool_or(F.col("l_discount") > 0.09).alias("has_discount")
    )


METRO = {"metro_a": [1, 2, 3], "metro_b": [4, 5], "metro_c": [6]}


@query(
    "a16_metro_counts",
    "SELECT city, count(DISTINCT s_suppkey) AS n FROM (SELECT unnest([1, 2, 3, 4, 5, 6]) AS nk, unnest(['metro_a', 'metro_a', 'metro_a', 'metro_b', 'metro_b', 'metro_c']) AS city) LEFT JOIN supplier ON s_nationkey = nk AND s_acctbal > 0 GROUP BY 1",
)
def a16(t):
    towns = t.spark.createDataFrame([(c, k) for c, ks in METRO.items() for k in ks], "city string, nk int")
    live = t.supplier.where("s_acctbal > 0").select("s_suppkey", F.col("s_nationkey").alias("nk"))
    return F.broadcast(towns).join(live, "nk", "left").groupBy("city").agg(F.countDistinct("s_suppkey").alias("n"))


# Ranks ------------------------------------------------------------------------------------------------------------------


@query(
    "w1_rank_contacts",
    "SELECT l_suppkey, l_orderkey, l_linenumber, rn, rn <= 3 AS chosen FROM (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber) AS rn FROM lineitem) WHERE rn <= 20",
)
def w1(t):
    ranked = rank_within(t.lineitem, ["l_suppkey"], [F.desc("l_extendedprice"), F.asc("l_orderkey"), F.asc("l_linenumber")], most=20)
    return ranked.select("l_suppkey", "l_orderkey", "l_linenumber", F.col("rn"), (F.col("rn") <= 3).alias("chosen"))


@query(
    "w2_email_in_top3",
    "WITH r AS (SELECT *, l_returnflag = 'R' AS mail, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber) AS rn FROM lineitem), m AS (SELECT l_suppkey, min(rn) FILTER (mail) AS best FROM r GROUP BY 1) SELECT r.l_suppkey, l_orderkey, l_linenumber, least(rn, 3) AS slot FROM r JOIN m ON r.l_suppkey = m.l_suppkey WHERE CASE WHEN best IS NULL OR best <= 3 THEN rn <= 3 ELSE rn <= 2 OR rn = best END",
)
def w2(t):
    """The first three of each supplier; when none of them is of the wanted kind, the best of that kind takes the third place."""
    order = [F.desc("l_extendedprice"), F.asc("l_orderkey"), F.asc("l_linenumber")]
    return first_with_one(t.lineitem, ["l_suppkey"], order, F.col("l_returnflag") == "R").select("l_suppkey", "l_orderkey", "l_linenumber", F.col("rn").alias("slot"))


@query("w3_first_seen", "SELECT text_key, min(doc_id) AS doc_id FROM (SELECT md5(lower(trim(text))) AS text_key, doc_id FROM documents) GROUP BY 1")
def w3(t):
    return first_per_key(t.documents.select(F.md5(F.lower(F.trim("text"))).alias("text_key"), "doc_id"), ["text_key"], ["doc_id"]).select("text_key", "doc_id")


@query(
    "w4_best_match",
    "SELECT p_brand, p_partkey FROM (SELECT p_brand, p_partkey, row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC, p_partkey) AS rn FROM part) WHERE rn = 1",
)
def w4(t):
    best = t.part.groupBy("p_brand").agg(F.max_by("p_partkey", F.struct("p_retailprice", (-F.col("p_partkey")).alias("early"))).alias("p_partkey"))
    return best.select("p_brand", "p_partkey")


@query(
    "w5_priority_contact",
    "SELECT o_custkey, o_orderkey FROM (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderpriority, o_orderdate DESC, o_orderkey) AS rn FROM orders) WHERE rn = 1",
)
def w5(t):
    return rank_within(t.orders, ["o_custkey"], [F.asc("o_orderpriority"), F.desc("o_orderdate"), F.asc("o_orderkey")], most=1).select("o_custkey", "o_orderkey")


LINES_SQL = """lines AS (
  SELECT DISTINCT source, doc_id, lower(trim(line)) AS line FROM (SELECT source, doc_id, unnest(string_split(text, chr(10))) AS line FROM documents) WHERE length(trim(line)) >= 3),
n AS (SELECT source, count(*) AS docs FROM documents GROUP BY 1)"""


@query("w6_line_frequency", f"WITH {LINES_SQL} SELECT lines.source, md5(line) AS line_key, count(*) AS docs FROM lines JOIN n ON lines.source = n.source WHERE n.docs >= 3 GROUP BY 1, 2, n.docs HAVING count(*) >= greatest(3, ceil(0.02 * n.docs))")
def w6(t):
    from quarry.operators.pages import repeated_lines

    return repeated_lines(t.documents, "source", "doc_id", "text", share=0.02).select("source", F.md5("line").alias("line_key"), F.col("pages").alias("docs"))


@query(
    "w8_budgeted_admission",
    "SELECT page_id, bucket FROM (SELECT page_id, bucket, row_number() OVER (PARTITION BY bucket ORDER BY page_id) AS rn FROM (SELECT page_id, CASE WHEN contains(url, '/en/') THEN 'NEWS' WHEN contains(url, '/de/') THEN 'CAREERS' ELSE 'DEEP_OTHER' END AS bucket FROM pages)) WHERE rn <= CASE bucket WHEN 'NEWS' THEN 5 WHEN 'CAREERS' THEN 2 ELSE 30 END",
)
def w8(t):
    bucket = F.when(F.contains("url", F.lit("/en/")), "NEWS").when(F.contains("url", F.lit("/de/")), "CAREERS").otherwise("DEEP_OTHER")
    budget = F.when(F.col("bucket") == "NEWS", 5).when(F.col("bucket") == "CAREERS", 2).otherwise(30)
    ranked = rank_within(t.pages.select("page_id", bucket.alias("bucket")), ["bucket"], [F.asc("page_id")], most=30)
    return ranked.where(F.col("rn") <= budget).select("page_id", "bucket")


@query("w10_last_row", LATEST_SQL.replace("l_linenumber FROM", "l_linenumber AS last_line FROM", 1))
def w10(t):
    """The last row of each parent. The reference leaves its order open; newest first is chosen here."""
    return latest_per_key(t.lineitem, ["l_suppkey"], ["l_shipdate", "l_orderkey", "l_linenumber"]).select("l_suppkey", "l_orderkey", F.col("l_linenumber").alias("last_line"))


# Sorts, pages, set operations ------------------------------------------------------------------------------------------


@query("o2_offset_paging", "SELECT s_suppkey, s_name, (SELECT ceil(count(*) / 20.0)::BIGINT FROM supplier) AS pages FROM supplier ORDER BY s_name, s_suppkey LIMIT 20 OFFSET 20")
def o2(t):
    total = t.supplier.agg(F.ceil(F.count("*") / 20).alias("pages"))
    return paged(t.supplier, ["s_name", "s_suppkey"], page=2, size=20).crossJoin(F.broadcast(total)).select("s_suppkey", "s_name", "pages")


@query("o4_top_n_newest", "SELECT event_id, ts FROM events ORDER BY ts DESC, event_id DESC LIMIT 50")
def o4(t):
    return t.events.select("event_id", "ts").orderBy(F.desc("ts"), F.desc("event_id")).limit(50)


@query("u2_union_all", "SELECT 'supplier' AS kind, s_nationkey AS nk FROM supplier UNION ALL SELECT 'customer', c_nationkey FROM customer")
def u2(t):
    return t.supplier.select(F.lit("supplier").alias("kind"), F.col("s_nationkey").alias("nk")).unionByName(t.customer.select(F.lit("customer").alias("kind"), F.col("c_nationkey").alias("nk")))


@query("u6_distinct_first_order", "SELECT o_custkey, string_agg(o_orderpriority, ',' ORDER BY seq) AS priorities FROM (SELECT o_custkey, o_orderpriority, min(o_orderkey) AS seq FROM orders GROUP BY 1, 2) GROUP BY 1")
def u6(t):
    first = t.orders.groupBy("o_custkey", "o_orderpriority").agg(F.min("o_orderkey").alias("seq"))
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("seq", "o_orderpriority"))), lambda x: x["o_orderpriority"])
    return first.groupBy("o_custkey").agg(F.array_join(ordered, ",").alias("priorities"))
