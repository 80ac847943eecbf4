"""Catalogue queries: scans, parsing, joins by key, grouping, sets."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import paths
from ..functions.numbers import fixed
from ..operators import relational as R
from . import query


@query("""
    SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem
    WHERE l_orderkey % 2 = 0 AND l_quantity >= 10 AND l_quantity < 40 AND l_returnflag IN ('A', 'R')
""")
def scan_filter_project(lineitem: DataFrame) -> DataFrame:
    stride = (F.col("l_orderkey") % 2 == 0) & F.col("l_quantity").between(10, 39.999)
    return lineitem.where(stride & F.col("l_returnflag").isin("A", "R") & (F.col("l_quantity") < 40)).select("l_orderkey", "l_linenumber", "l_quantity")


@query(r"""
    SELECT page_id, regexp_extract(url, '^https?://([^/]+)/([a-z]{2})/(\d+)', 1) AS host,
        regexp_extract(url, '^https?://([^/]+)/([a-z]{2})/(\d+)', 2) AS lang,
        try_cast(regexp_extract(url, '^https?://([^/]+)/([a-z]{2})/(\d+)', 3) AS BIGINT) AS number FROM pages
""")
def parse_ids_regex(pages: DataFrame) -> DataFrame:
    form = r"^https?://([^/]+)/([a-z]{2})/(\d+)"
    part = [F.regexp_extract("url", form, k) for k in (1, 2, 3)]
    return pages.select("page_id", part[0].alias("host"), part[1].alias("lang"), part[2].try_cast("bigint").alias("number"))


@query(r"""
    SELECT page_id, split_part(url, '/', -1) AS base, regexp_replace(split_part(url, '/', -1), '[?#].*$', '') AS stem,
        coalesce(nullif(regexp_extract(url, 'page=(\d+)', 1), ''), '00') AS suffix FROM pages
""")
def path_basename_stem(pages: DataFrame) -> DataFrame:
    base = paths.basename(F.col("url"))
    suffix = F.coalesce(F.nullif(F.regexp_extract("url", r"page=(\d+)", 1), F.lit("")), F.lit("00"))
    return pages.select("page_id", base.alias("base"), F.regexp_replace(base, "[?#].*$", "").alias("stem"), suffix.alias("suffix"))


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k, json_extract_string(props, '$.none') AS missing FROM events")
def json_field_extract(events: DataFrame) -> DataFrame:
    return events.select("event_id", F.get_json_object("props", "$.k").cast("int").alias("k"), F.get_json_object("props", "$.none").alias("missing"))


@query("SELECT c_nationkey, c_mktsegment, count(*) AS n FROM customer GROUP BY ALL HAVING count(*) > 10")
def group_having(customer: DataFrame) -> DataFrame:
    return R.groups_with_many(customer, ["c_nationkey", "c_mktsegment"], 10)


@query("""
    SELECT c_nationkey, count(*) AS members, bool_and(n > 10) AS complete
    FROM (SELECT c_nationkey, c_mktsegment, count(*) AS n FROM customer GROUP BY ALL) GROUP BY c_nationkey
""")
def relational_division(customer: DataFrame) -> DataFrame:
    return R.all_members_have_many(customer, ["c_nationkey"], ["c_mktsegment"], 10)


@query("""
    SELECT c_nationkey, c_mktsegment, count(*) AS n, (grouping(c_nationkey) + grouping(c_mktsegment))::BIGINT AS level
    FROM customer GROUP BY ROLLUP (c_nationkey, c_mktsegment)
""")
def rollup_totals(customer: DataFrame) -> DataFrame:
    return R.totals(customer, "c_nationkey", "c_mktsegment")


@query("""
    SELECT o_orderstatus, o_orderpriority, count(*) AS n, floor(sum(o_totalprice) * 100 + 0.5) / 100 AS total
    FROM orders GROUP BY CUBE (o_orderstatus, o_orderpriority)
""")
def cube_totals(orders: DataFrame) -> DataFrame:
    return orders.cube("o_orderstatus", "o_orderpriority").agg(F.count("*").alias("n"), fixed(F.sum("o_totalprice"), 2).alias("total"))


@query("""
    SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders
    GROUP BY GROUPING SETS ((o_orderstatus), (o_orderpriority), ())
""")
def grouping_sets(orders: DataFrame) -> DataFrame:
    status, priority = F.col("o_orderstatus"), F.col("o_orderpriority")
    return orders.groupingSets([[status], [priority], []], status, priority).agg(F.count("*").alias("n"))


@query("""
    SELECT o_orderpriority, count(DISTINCT o_custkey) AS customers, count(DISTINCT o_orderstatus) AS statuses FROM orders GROUP BY ALL
""")
def distinct_members(orders: DataFrame) -> DataFrame:
    return orders.groupBy("o_orderpriority").agg(F.countDistinct("o_custkey").alias("customers"), F.countDistinct("o_orderstatus").alias("statuses"))


@query("SELECT p_brand, p_type, string_agg(p_name, ';' ORDER BY p_name) AS names FROM part GROUP BY ALL")
def nested_index(part: DataFrame) -> DataFrame:
    return R.joined_names(part, ["p_brand", "p_type"], "p_name")


@query("SELECT doc_id, lang FROM documents WHERE doc_id IN (SELECT doc_id FROM labels)")
def semi_join_catalog(documents: DataFrame, labels: DataFrame) -> DataFrame:
    return R.split_by_presence(documents.select("doc_id", "lang"), labels, ["doc_id"])[0]


@query("SELECT doc_id, lang FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)")
def anti_join_missing(documents: DataFrame, labels: DataFrame) -> DataFrame:
    return R.split_by_presence(documents.select("doc_id", "lang"), labels, ["doc_id"])[1]


@query("SELECT doc_id, coalesce(quality, 0) AS quality, coalesce(toxic, -1) AS toxic FROM documents LEFT JOIN labels USING (doc_id)")
def left_join_default(documents: DataFrame, labels: DataFrame) -> DataFrame:
    return R.with_default(documents.select("doc_id"), labels, ["doc_id"], {"quality": 0, "toxic": -1})


@query("""
    SELECT r_name, n_name, count(*) AS orders, floor(sum(o_totalprice) * 100 + 0.5) / 100 AS total
    FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY ALL
""")
def inner_join_lookup(orders: DataFrame, customer: DataFrame, nation: DataFrame, region: DataFrame) -> DataFrame:
    # nation and region are small by what they are; the optimizer broadcasts them by their measured size
    named = nation.join(region, nation.n_regionkey == region.r_regionkey)
    people = customer.join(named, customer.c_nationkey == named.n_nationkey).select("c_custkey", "r_name", "n_name")
    joined = orders.join(people, orders.o_custkey == people.c_custkey)
    return joined.groupBy("r_name", "n_name").agg(F.count("*").alias("orders"), fixed(F.sum("o_totalprice"), 2).alias("total"))


@query("""
    SELECT o_orderpriority, count(*) AS n,
        floor(sum(sqrt(power(l_quantity - p_size, 2) + power(l_extendedprice / 1000 - p_retailprice / 100, 2))) * 100 + 0.5) / 100 AS err
    FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey GROUP BY ALL
""")
def three_way_residual(lineitem: DataFrame, orders: DataFrame, part: DataFrame) -> DataFrame:
    joined = lineitem.join(orders.select("o_orderkey", "o_orderpriority"), F.col("l_orderkey") == F.col("o_orderkey"))
    joined = joined.join(part.select("p_partkey", "p_size", "p_retailprice"), F.col("l_partkey") == F.col("p_partkey"))
    du, dv = F.col("l_quantity") - F.col("p_size"), F.col("l_extendedprice") / 1000 - F.col("p_retailprice") / 100
    return joined.groupBy("o_orderpriority").agg(F.count("*").alias("n"), fixed(F.sum(F.sqrt(du * du + dv * dv)), 2).alias("err"))


@query("SELECT c_custkey, c_acctbal FROM customer ORDER BY c_acctbal DESC, c_custkey LIMIT 6")
def topk_clusters(customer: DataFrame) -> DataFrame:
    return customer.select("c_custkey", "c_acctbal").orderBy(F.desc("c_acctbal"), "c_custkey").limit(6)


@query("""
    SELECT c_nationkey, c_custkey, c_acctbal, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey)::INTEGER AS rank
    FROM customer QUALIFY rank <= 2
""")
def top2_per_group(customer: DataFrame) -> DataFrame:
    found = R.top_per_group(customer, ["c_nationkey"], [F.desc("c_acctbal"), F.col("c_custkey")], 2)
    return found.select("c_nationkey", "c_custkey", "c_acctbal", "rank")


@query("""
    SELECT o_custkey, first(o_orderkey ORDER BY o_totalprice DESC, o_orderkey) AS best, max(o_totalprice) AS price FROM orders GROUP BY ALL
""")
def argmax_first_wins(orders: DataFrame) -> DataFrame:
    best = F.max_by("o_orderkey", F.struct("o_totalprice", -F.col("o_orderkey")))
    return orders.groupBy("o_custkey").agg(best.alias("best"), F.max("o_totalprice").alias("price"))


@query("SELECT value, row_number() OVER (ORDER BY value)::INTEGER AS group_id FROM (SELECT DISTINCT floor(p_retailprice * 10 + 0.5) / 10 AS value FROM part)")
def round_distinct(part: DataFrame) -> DataFrame:
    return R.number_distinct(part, fixed("p_retailprice", 1))


@query("""
    SELECT 'both' AS kind, k FROM (SELECT c_nationkey AS k FROM customer INTERSECT SELECT s_nationkey FROM supplier)
    UNION ALL SELECT 'customers', k FROM (SELECT c_nationkey AS k FROM customer EXCEPT SELECT s_nationkey FROM supplier)
    UNION ALL SELECT 'suppliers', k FROM (SELECT s_nationkey AS k FROM supplier EXCEPT SELECT c_nationkey FROM customer)
""")
def union_diff(customer: DataFrame, supplier: DataFrame) -> DataFrame:
    a, b = customer.select(F.col("c_nationkey").alias("k")), supplier.select(F.col("s_nationkey").alias("k"))
    kinds = (("both", a.intersect(b)), ("customers", a.subtract(b)), ("suppliers", b.subtract(a)))
    first, *rest = (df.select(F.lit(name).alias("kind"), "k") for name, df in kinds)
    return first.unionByName(rest[0]).unionByName(rest[1])


@query("SELECT doc_id, CASE WHEN doc_id < 300 THEN 'train' WHEN doc_id < 325 THEN 'valid' ELSE 'test' END AS split, printf('scene_%05d', doc_id) AS scene FROM documents")
def split_assign(documents: DataFrame) -> DataFrame:
    split = paths.split_of(F.col("doc_id"), ((300, "train"), (325, "valid")))
    return documents.select("doc_id", split.alias("split"), paths.scene_name(F.col("doc_id")).alias("scene"))


@query("""
    SELECT date_trunc('hour', ts) AS hour, event_type, count(*) AS n, floor(sum(value) * 100 + 0.5) / 100 AS total FROM events GROUP BY ALL
""")
def stream_window_counts(events: DataFrame) -> DataFrame:
    from ..streaming.windows import counts

    return counts(events, "1 hour").select(F.col("start").cast("timestamp_ntz").alias("hour"), "event_type", "n", "total")


@query("""
    SELECT doc_id FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents)
""")
def existence_check(labels: DataFrame, documents: DataFrame) -> DataFrame:
    return R.must_be_empty(labels.join(documents, "doc_id", "left_anti").select("doc_id"), "a label without a document")


@query("""
    SELECT o_custkey, printf('%.2f', max(o_totalprice)) AS price, concat_ws('/', 'orders', o_custkey, 'report.txt') AS path FROM orders GROUP BY o_custkey
""")
def text_report(orders: DataFrame) -> DataFrame:
    grouped = orders.groupBy("o_custkey").agg(F.format_string("%.2f", F.max("o_totalprice")).alias("price"))
    return grouped.withColumn("path", F.concat_ws("/", F.lit("orders"), "o_custkey", F.lit("report.txt")))
