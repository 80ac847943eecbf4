"""Queries on ordered sequences: events by time as signals, orders and parts as measurements."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.numbers import fixed
from ..operators import sequences as S
from . import query

#: Fixed values of the analogue: hours to a bin, the longest gap filled, the width of smoothing.
STEP, GAP, WIDTH = 24.0, 5, 5
_ENVELOPE = f"""
    p AS (SELECT user_id, floor(epoch(ts)) / 3600.0 - floor(epoch(TIMESTAMP '2024-01-01')) / 3600.0 AS x, value AS y FROM events),
    e AS (SELECT user_id, (floor(x / {STEP}) + 1)::BIGINT AS bin, min(y) AS low, max(y) AS high FROM p GROUP BY ALL)
"""


def points(events: DataFrame) -> DataFrame:
    """(user_id, x, y): hours from a fixed start, and the value."""
    seconds = F.unix_seconds(F.col("ts").cast("timestamp")) - F.unix_seconds(F.lit("2024-01-01 00:00:00").cast("timestamp"))
    return events.select("user_id", (seconds / 3600.0).alias("x"), F.col("value").alias("y"))


def outline(events: DataFrame) -> DataFrame:
    return S.envelope(points(events), ["user_id"], "x", "y", STEP, F.lit(0.0))


@query(f"WITH {_ENVELOPE} SELECT * FROM e")
def bin_envelope(events: DataFrame) -> DataFrame:
    return outline(events)


@query(f"""
    WITH {_ENVELOPE}, l AS (
        SELECT *, lead(bin) OVER w AS t, lead(low) OVER w AS lt, lead(high) OVER w AS ht FROM e WINDOW w AS (PARTITION BY user_id ORDER BY bin)
    ), f AS (
        SELECT user_id, b AS bin, low + (lt - low) * ((b - bin)::DOUBLE / (t - bin)) AS low, high + (ht - high) * ((b - bin)::DOUBLE / (t - bin)) AS high
        FROM l, unnest(range(bin + 1, t)) AS u(b) WHERE t - bin - 1 BETWEEN 1 AND {GAP}
    )
    SELECT user_id, bin, floor(low * 10000 + 0.5) / 10000 AS low, floor(high * 10000 + 0.5) / 10000 AS high FROM (SELECT * FROM e UNION ALL SELECT * FROM f)
""")
def gap_fill_linear(events: DataFrame) -> DataFrame:
    filled = S.fill_gaps(outline(events), ["user_id"], ["low", "high"], GAP)
    return filled.select("user_id", "bin", fixed("low").alias("low"), fixed("high").alias("high"))


@query(f"""
    WITH {_ENVELOPE}, r AS (
        SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY bin) AS i, count(*) OVER (PARTITION BY user_id) AS n,
            sum(high) OVER (PARTITION BY user_id ORDER BY bin ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS s,
            first(high) OVER (PARTITION BY user_id ORDER BY bin) AS f,
            last(high) OVER (PARTITION BY user_id ORDER BY bin ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS l FROM e
    )
    SELECT user_id, bin, floor((s + greatest(0, 3 - i) * f + greatest(0, i + 2 - n) * l) / 5 * 10000 + 0.5) / 10000 AS smooth FROM r
""")
def moving_avg_edge_pad(events: DataFrame) -> DataFrame:
    return S.moving_average(outline(events), ["user_id"], "bin", "high", WIDTH).select("user_id", "bin", fixed("smooth").alias("smooth"))


@query("""
    SELECT o_orderpriority, count(*) AS n, floor(max(q) * 10000 + 0.5) / 10000 AS bound, floor(avg(o_totalprice) * 100 + 0.5) / 100 AS mean
    FROM orders JOIN (SELECT o_orderpriority, quantile_cont(o_totalprice, 0.95) AS q FROM orders GROUP BY ALL) USING (o_orderpriority)
    WHERE o_totalprice <= q GROUP BY ALL
""")
def quantile_trim(orders: DataFrame) -> DataFrame:
    kept = S.trim_above_quantile(orders, ["o_orderpriority"], "o_totalprice", 0.95)
    return kept.groupBy("o_orderpriority").agg(F.count("*").alias("n"), fixed(F.max("bound")).alias("bound"), fixed(F.avg("o_totalprice"), 2).alias("mean"))


@query("""
    SELECT p_brand, floor(avg(p_retailprice) * 1000000 + 0.5) / 1000000 AS mean, count(*) AS n
    FROM part JOIN (SELECT p_brand, quantile_cont(p_retailprice, 0.25) AS lo, quantile_cont(p_retailprice, 0.75) AS hi FROM part GROUP BY ALL) USING (p_brand)
    WHERE p_retailprice BETWEEN lo AND hi GROUP BY ALL
""")
def interquartile_mean(part: DataFrame) -> DataFrame:
    return S.interquartile_mean(part, ["p_brand"], "p_retailprice").withColumn("mean", fixed("mean", 6))


_HOURS = "SELECT event_type, hour(ts)::INTEGER AS pos, count(*) AS n FROM events GROUP BY ALL"


def hourly(events: DataFrame) -> DataFrame:
    return events.groupBy("event_type", F.hour(F.col("ts").cast("timestamp")).alias("pos")).agg(F.count("*").alias("n"))


@query(f"""
    WITH h AS ({_HOURS}), r AS (
        SELECT *, pos AS ring FROM h UNION ALL SELECT *, pos + 24 FROM h WHERE pos < 2 UNION ALL SELECT *, pos - 24 FROM h WHERE pos >= 22
    ), p AS (
        SELECT *, max(n) OVER (PARTITION BY event_type ORDER BY ring RANGE BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS top FROM r
    ), k AS (
        SELECT event_type, pos, n FROM p WHERE ring BETWEEN 0 AND 23 AND n = top QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY n DESC, pos) <= 6
    )
    SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY pos)::INTEGER AS place FROM k
""")
def circular_peaks(events: DataFrame) -> DataFrame:
    return S.top_peaks(S.circular_peaks(hourly(events), ["event_type"], "pos", "n", 24, 2), ["event_type"], "pos", "n", 6)


@query("""
    WITH s AS (
        SELECT user_id, event_id, sum(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS g FROM events
    ), z AS (SELECT user_id, event_id, CASE WHEN g = max(g) OVER (PARTITION BY user_id) THEN 0 ELSE g END AS segment FROM s)
    SELECT user_id, segment::BIGINT AS segment, count(*) AS n FROM z GROUP BY ALL
""")
def cumsum_segments(events: DataFrame) -> DataFrame:
    found = S.segments(events, ["user_id"], ["ts", "event_id"], F.col("event_type") == "error")
    return found.groupBy("user_id", "segment").agg(F.count("*").alias("n"))


@query("""
    WITH r AS (
        SELECT user_id, row_number() OVER w AS pos, count(*) OVER (PARTITION BY user_id) AS n, sum(value) OVER (w ROWS UNBOUNDED PRECEDING) AS b, sum(value) OVER (PARTITION BY user_id) AS t
        FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)
    ), s AS (SELECT user_id, pos, floor(abs(b / pos - (t - b) / (n - pos)) * least(pos, n - pos) * 10000 + 0.5) / 10000 AS score FROM r WHERE pos < n)
    SELECT user_id, first(pos::INTEGER ORDER BY score DESC, pos) AS split, floor(max(score) * 100 + 0.5) / 100 AS score FROM s GROUP BY ALL
""")
def best_split(events: DataFrame) -> DataFrame:
    return S.best_split(events, ["user_id"], ["ts", "event_id"], "value").withColumn("score", fixed("score", 2))


@query("""
    WITH s AS (
        SELECT user_id, value, event_id, sum(CASE WHEN value - prev > 20 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY value, event_id ROWS UNBOUNDED PRECEDING) AS island
        FROM (SELECT *, lag(value) OVER (PARTITION BY user_id ORDER BY value, event_id) AS prev FROM events)
    ), g AS (SELECT user_id, island, count(*) AS n, avg(value) AS mean FROM s GROUP BY ALL)
    SELECT user_id, n, floor(mean * 100 + 0.5) / 100 AS mean FROM g QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY n DESC, island) = 1
""")
def gaps_islands(events: DataFrame) -> DataFrame:
    sizes = S.islands(events, ["user_id"], "value", 20.0, "event_id").groupBy("user_id", "island").agg(F.count("*").alias("n"), F.avg("value").alias("mean"))
    first = F.struct("n", -F.col("island"))
    return sizes.groupBy("user_id").agg(F.max("n").alias("n"), fixed(F.max_by("mean", first), 2).alias("mean"))


@query("""
    SELECT p_brand, floor(median(p_retailprice) * 10000 + 0.5) / 10000 AS median, max(v) AS votes, count(*) AS n, max(v) >= 0.4 * count(*) AS agreed
    FROM (SELECT p_brand, p_retailprice, count(*) OVER (PARTITION BY p_brand ORDER BY p_retailprice RANGE BETWEEN CURRENT ROW AND 10 FOLLOWING) AS v FROM part) GROUP BY ALL
""")
def consensus_vote(part: DataFrame) -> DataFrame:
    return S.consensus(part, ["p_brand"], "p_retailprice", 10.0).withColumn("median", fixed("median"))


@query("""
    WITH RECURSIVE r AS (
        SELECT p_brand, p_partkey, p_size::DOUBLE AS w, p_retailprice / 100 AS h, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS i,
            sqrt(sum(p_size::DOUBLE * (p_retailprice / 100)) OVER (PARTITION BY p_brand)) AS target FROM part
    ), f AS (
        SELECT p_brand, p_partkey, i, 0.0::DOUBLE AS x, 0.0::DOUBLE AS y, w AS nx, h AS shelf FROM r WHERE i = 1
        UNION ALL
        SELECT r.p_brand, r.p_partkey, r.i, CASE WHEN f.nx + r.w > r.target THEN 0 ELSE f.nx END, CASE WHEN f.nx + r.w > r.target THEN f.y + f.shelf ELSE f.y END,
            CASE WHEN f.nx + r.w > r.target THEN r.w ELSE f.nx + r.w END, CASE WHEN f.nx + r.w > r.target THEN r.h ELSE greatest(f.shelf, r.h) END
        FROM f JOIN r ON r.p_brand = f.p_brand AND r.i = f.i + 1
    )
    SELECT p_brand, p_partkey, floor(x * 10000 + 0.5) / 10000 AS x, floor(y * 100 + 0.5) / 100 AS y FROM f
""")
def shelf_pack(part: DataFrame) -> DataFrame:
    rooms = part.withColumn("h", F.col("p_retailprice") / 100)
    packed = S.shelf_pack(rooms, ["p_brand"], ["p_partkey"], "p_size", "h", "p_partkey")
    return packed.select("p_brand", F.col("name").alias("p_partkey"), fixed("x").alias("x"), fixed("y", 2).alias("y"))


@query("""
    SELECT c_nationkey, c_custkey, coalesce(lead(c_custkey) OVER w, first(c_custkey) OVER w) AS next FROM customer WINDOW w AS (PARTITION BY c_nationkey ORDER BY c_custkey)
""")
def cyclic_edges(customer: DataFrame) -> DataFrame:
    pairs = S.cyclic_pairs(customer.select("c_nationkey", "c_custkey"), ["c_nationkey"], "c_custkey", ["c_custkey"])
    return pairs.withColumnRenamed("c_custkey_next", "next")


@query("""
    WITH m AS (SELECT l_returnflag, min(l_extendedprice) AS mn, max(l_extendedprice) AS mx, count(*) AS n FROM lineitem GROUP BY ALL),
    b AS (SELECT l_returnflag, k FROM m, range(10) AS t(k)),
    h AS (SELECT l_returnflag, least(floor((l_extendedprice - mn) / (mx - mn) * 10), 9)::BIGINT AS k, count(*) AS c FROM lineitem JOIN m USING (l_returnflag) GROUP BY ALL),
    f AS (SELECT l_returnflag, k, coalesce(c, 0) AS c FROM b LEFT JOIN h USING (l_returnflag, k))
    SELECT l_returnflag, k::INTEGER AS bin, c AS n, floor((1 - sum((c - m.n / 10.0) ** 2) OVER (PARTITION BY l_returnflag) / (m.n - m.n / 10.0) ** 2 - 0.9) * 1000000 + 0.5) / 1000000 AS uniformity
    FROM f JOIN m USING (l_returnflag)
""")
def histogram10_uniformity(lineitem: DataFrame) -> DataFrame:
    from ..operators.fitting import histogram, uniformity

    bins = histogram(lineitem, ["l_returnflag"], "l_extendedprice", 10)
    score = uniformity(bins, ["l_returnflag"])
    return bins.join(score, ["l_returnflag"]).select("l_returnflag", "bin", "n", fixed("uniformity", 6).alias("uniformity"))


@query("""
    SELECT l_returnflag, floor(var_pop(l_quantity) * 10000 + 0.5) / 10000 AS ixx, floor(var_pop(l_discount) * 1000000 + 0.5) / 1000000 AS iyy,
        floor(covar_pop(l_quantity, l_discount) * 10000 + 0.5) / 10000 AS ixy, floor(sqrt(2) / stddev_pop(l_quantity) * 1000000 + 0.5) / 1000000 AS scale
    FROM lineitem GROUP BY ALL
""")
def moments(lineitem: DataFrame) -> DataFrame:
    return lineitem.groupBy("l_returnflag").agg(
        fixed(F.var_pop("l_quantity")).alias("ixx"),
        fixed(F.var_pop("l_discount"), 6).alias("iyy"),
        fixed(F.covar_pop("l_quantity", "l_discount")).alias("ixy"),
        fixed(F.sqrt(F.lit(2.0)) / F.stddev_pop("l_quantity"), 6).alias("scale"),
    )
