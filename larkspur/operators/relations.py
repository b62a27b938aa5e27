"""Joins and read models: semi, anti, null-safe, nested latest, relink, matrix reads, KPIs, funnels, gates and exports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from larkspur.sources.star import as_of, half_up, percent, table


def backlog_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers with balance that no recent order has, parked for a day or a week by balance; oldest keys first."""
    recent = table(spark, sf_dir, "orders").where(F.col("o_orderdate") >= F.expr("timestamp_ntz'1998-01-01 00:00:00'")).select("o_custkey")
    rows = table(spark, sf_dir, "customer").join(recent, F.col("c_custkey") == F.col("o_custkey"), "left_anti")
    return rows.select("c_custkey", "c_mktsegment", F.when(F.col("c_acctbal") < 0, 7).otherwise(1).alias("retry_days"))


def active_semi(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers that delivered a returned line."""
    returned = table(spark, sf_dir, "lineitem").where("l_returnflag = 'R'").select("l_suppkey")
    return table(spark, sf_dir, "supplier").join(returned, F.col("s_suppkey") == F.col("l_suppkey"), "left_semi").select("s_suppkey", "s_name")


def nullsafe_group_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of parts that agree on brand and size class, nulls included, with the ratio of their extreme prices."""
    p = table(spark, sf_dir, "part").select("p_partkey", F.when(F.col("p_size") % 5 != 0, F.col("p_brand")).alias("brand"), (F.col("p_size") % 10).alias("size_class"), "p_retailprice")
    g = p.groupBy("brand", "size_class").agg(F.max("p_retailprice").alias("hi"), F.min("p_retailprice").alias("lo"), F.count("*").alias("n"))
    j = p.alias("p").join(g.alias("g"), F.col("p.brand").eqNullSafe(F.col("g.brand")) & F.col("p.size_class").eqNullSafe(F.col("g.size_class")))
    return j.select("p_partkey", "n", F.round(F.col("hi") / F.col("lo"), 4).alias("price_ratio"), (F.col("hi") / F.col("lo") > 2).alias("implausible"))


def latest_n_nested(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five latest orders of each customer, joined into one text in order."""
    w = Window.partitionBy("o_custkey").orderBy(F.desc("o_orderdate"), F.desc("o_orderkey"))
    top = table(spark, sf_dir, "orders").withColumn("k", F.row_number().over(w)).where("k <= 5")
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "o_orderkey"))), lambda x: x["o_orderkey"].cast("string")), ",")
    return top.groupBy("o_custkey").agg(joined.alias("latest"), F.count("*").alias("n"))


def cheapest_lateral(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each part's cheapest line and its supplier; parts without lines stay."""
    lines = table(spark, sf_dir, "lineitem").groupBy("l_partkey").agg(F.min(F.struct(half_up(F.col("l_extendedprice") / F.col("l_quantity")).alias("price"), "l_suppkey")).alias("c"), F.count("*").alias("n_lines"))
    rows = table(spark, sf_dir, "part").join(lines, F.col("p_partkey") == F.col("l_partkey"), "left")
    return rows.select("p_partkey", F.col("c.price").alias("price"), F.col("c.l_suppkey").alias("shop_id"), F.coalesce("n_lines", F.lit(0)).alias("n_lines"))


def relink_selfjoin(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Old listings (fulfilled orders) to new ones (open orders) of the same shop with the same part: how many match."""
    x = table(spark, sf_dir, "lineitem").select("l_partkey", "l_suppkey", "l_orderkey", "l_linestatus")
    old = x.where("l_linestatus = 'F'").groupBy("l_suppkey", "l_partkey").agg(F.min("l_orderkey").alias("old_key"))
    new = x.where("l_linestatus = 'O'").groupBy("l_suppkey", "l_partkey").agg(F.min("l_orderkey").alias("new_key"), F.countDistinct("l_orderkey").alias("n_new"))
    return old.join(new, ["l_suppkey", "l_partkey"]).select("l_suppkey", "l_partkey", "old_key", "new_key", (F.col("n_new") == 1).alias("unambiguous"))


def restore_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines shipped within 30 days of their own order: a range residual on an equi-join."""
    o, x = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem")
    inside = (F.col("l_shipdate") >= F.col("o_orderdate")) & (F.col("l_shipdate") <= F.col("o_orderdate") + F.expr("INTERVAL 30 DAYS"))
    return x.join(o, (F.col("l_orderkey") == F.col("o_orderkey")) & inside).groupBy("l_suppkey").agg(F.count("*").alias("inside"))


def kpi_row(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row of totals: each table is read once and joined as single rows."""
    orders = table(spark, sf_dir, "orders").agg(F.count("*").alias("n_orders"), F.count_if(F.col("o_orderstatus") == "O").alias("open_orders"), F.countDistinct("o_custkey").alias("active_customers"))
    lines = table(spark, sf_dir, "lineitem").agg(F.count("*").alias("n_lines"), F.countDistinct("l_suppkey").alias("active_shops"), F.max("l_shipdate").cast("string").alias("last_seen"))
    customers = table(spark, sf_dir, "customer").agg(F.count("*").alias("n_customers"), F.count_if(F.col("c_acctbal") < 0).alias("in_debt"))
    events = table(spark, sf_dir, "events").agg(F.count_if(F.col("event_type") == "purchase").alias("purchases"), F.countDistinct("user_id").alias("users"))
    return orders.crossJoin(lines).crossJoin(customers).crossJoin(events)  # one row each


def publish_funnel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many lines pass each further condition, in one pass."""
    steps = {"seen": F.lit(True), "shipped": F.col("l_shipdate") <= as_of(), "not_returned": F.col("l_returnflag") != "R", "discounted": F.col("l_discount") > 0.02, "bulk": F.col("l_quantity") >= 10}
    so_far, counts = F.lit(True), []
    for name, ok in steps.items():
        so_far = so_far & ok
        counts.append(F.count_if(so_far).alias(name))
    return table(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg(*counts)


def marginal_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each condition, how many lines fail that one alone."""
    ok = {"price": F.col("l_extendedprice") > 2000, "quantity": F.col("l_quantity") >= 5, "discount": F.col("l_discount") <= 0.08}
    alone = [F.count_if(~ok[k] & F.forall(F.array(*[v for n, v in ok.items() if n != k]), lambda x: x)).alias(f"only_{k}") for k in ok]
    return table(spark, sf_dir, "lineitem").groupBy("l_returnflag").agg(*alone, F.count_if(ok["price"] & ok["quantity"] & ok["discount"]).alias("complete"))


def group_two_level(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many parts are sold by how many suppliers: counts of counts, for those with two or more."""
    per = table(spark, sf_dir, "lineitem").groupBy("l_partkey").agg(F.countDistinct("l_suppkey").alias("shops"), F.count("*").alias("n"))
    return per.where("shops >= 2").groupBy("shops").agg(F.count("*").alias("parts"), F.sum("n").alias("lines"))


def quality_gate_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Seven checks of each shop's offers, as one row a check."""
    x = table(spark, sf_dir, "lineitem")
    g = x.groupBy("l_suppkey").agg(
        F.count("*").alias("n"), F.count_if(F.col("l_extendedprice") <= 0).alias("bad_price"), F.count_if(F.col("l_shipdate") > as_of()).alias("future"), F.countDistinct("l_partkey").alias("parts"),
        F.count_if(F.col("l_returnflag") == "R").alias("returned"), F.count_if(F.col("l_quantity") <= 0).alias("bad_quantity"), F.max("l_shipdate").alias("last"), F.count_if(F.col("l_discount") > 0.1).alias("steep"),
    )
    checks = [
        ("price", F.col("bad_price") == 0, F.col("bad_price")), ("future", F.col("future") == 0, F.col("future")), ("volume", F.col("n") >= 50, F.col("n")), ("variety", F.col("parts") * 10 >= F.col("n"), F.col("parts")),
        ("returns", F.col("returned") * 3 <= F.col("n"), F.col("returned")), ("quantity", F.col("bad_quantity") == 0, F.col("bad_quantity")), ("discount", F.col("steep") == 0, F.col("steep")),
    ]
    rows = g.select("l_suppkey", F.explode(F.array(*[F.struct(F.lit(k).alias("check"), ok.alias("passed"), v.cast("bigint").alias("detail")) for k, ok, v in checks])).alias("c"))
    return rows.select("l_suppkey", "c.*")


def duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order and part pairs that occur more than once."""
    return table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_partkey").agg(F.count("*").alias("n")).where("n > 1")


def shop_health(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Latest line, line counts and open orders of each supplier with its nation and region (small tables are joined first)."""
    s = table(spark, sf_dir, "supplier").join(table(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey"), "left").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"), "left")
    g = table(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg(F.max(F.struct("l_shipdate", "l_orderkey")).alias("m"), F.count("*").alias("n"), F.count_if(F.col("l_linestatus") == "O").alias("open"))
    rows = s.join(g, F.col("s_suppkey") == F.col("l_suppkey"), "left")
    level = F.when(F.coalesce("n", F.lit(0)) == 0, "critical").when(F.col("open") * 2 > F.col("n"), "warning").otherwise("ok")
    return rows.select("s_suppkey", "n_name", "r_name", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("open", F.lit(0)).alias("open"), F.col("m.l_orderkey").alias("last_run"), level.alias("level"))


def unmatched_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each customer's open work in one of six ordered buckets, counted by segment."""
    n = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.count("*").alias("n"), F.count_if(F.col("o_orderstatus") == "F").alias("f"))
    rows = table(spark, sf_dir, "customer").join(n, F.col("c_custkey") == F.col("o_custkey"), "left")
    bucket = F.when(F.col("n").isNull(), "never_searched").when(F.col("c_acctbal") < -900, "source_problem").when(F.col("f") == 0, "ambiguous").when(F.col("f") == F.col("n"), "done").when(F.col("n") >= 15, "review").otherwise("waiting")
    return rows.groupBy("c_mktsegment", bucket.alias("bucket")).agg(F.count("*").alias("n_rows"))


def review_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first hundred open orders by priority, value and age: a top-k, not a sort of all."""
    level = F.when(F.col("o_orderpriority").startswith("1"), 0).when(F.col("o_orderpriority").startswith("2"), 1).otherwise(2)
    rows = table(spark, sf_dir, "orders").where("o_orderstatus = 'O'").withColumn("level", level)
    return rows.orderBy("level", F.desc("o_totalprice"), "o_orderdate", "o_orderkey").limit(100).select("o_orderkey", "level", "o_totalprice")


def export_comparison(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Revenue by brand, one column a return flag."""
    x = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "part").select("p_partkey", "p_brand"), F.col("l_partkey") == F.col("p_partkey"))
    wide = x.groupBy("p_brand").pivot("l_returnflag", ["A", "N", "R"]).agg(F.round(F.sum("l_extendedprice"), 0))
    return wide.withColumnsRenamed({"A": "flag_a", "N": "flag_n", "R": "flag_r"})


def slot_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Coverage counts by segment and over all: one rollup in place of two passes."""
    rows = table(spark, sf_dir, "customer").rollup("c_mktsegment").agg(F.count("*").alias("n"), F.count_if(F.col("c_acctbal") > 0).alias("positive"), F.grouping("c_mktsegment").alias("overall"))
    return rows.select(F.coalesce("c_mktsegment", F.lit("all")).alias("segment"), "n", "positive", percent(F.col("positive") / F.col("n")).alias("pct"), F.col("overall").cast("int").alias("overall"))


def token_support(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Document frequency of name tokens, and by how many brands they are used."""
    rows = table(spark, sf_dir, "part").select("p_partkey", "p_brand", F.explode(F.array_distinct(F.split(F.lower("p_name"), r"\s+"))).alias("token")).where("token <> ''")
    return rows.groupBy("token").agg(F.count("*").alias("df"), F.countDistinct("p_brand").alias("brands"))


def run_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Success rate of each supplier's lines (not returned) and its status: ok from 0.7, partial from 0.3, else failed."""
    rows = table(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg(F.round(F.count_if(F.col("l_returnflag") != "R") / F.count("*"), 6).alias("rate"))
    return rows.withColumn("status", F.when(F.col("rate") >= 0.7, "succeeded").when(F.col("rate") >= 0.3, "partial").otherwise("failed"))


def alert_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repeated alerts of a user and kind as one row: count, greatest value, latest event."""
    return table(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(F.count("*").alias("occurrences"), F.max("value").alias("worst"), F.max(F.struct("ts", "event_id")).alias("l")).select("user_id", "event_type", "occurrences", "worst", F.col("l.event_id").alias("last_event"))


def settings_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The latest version of each user's value, from nested JSON."""
    rows = table(spark, sf_dir, "events").select("user_id", "ts", "event_id", F.get_json_object("props", "$.k").cast("int").alias("k"))
    return rows.groupBy("user_id").agg(F.max_by("k", F.struct("ts", "event_id")).alias("k"), F.count("*").alias("versions"))


def resume_rotation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Targets in cyclic order from a resume point, by shop."""
    w = Window.partitionBy("p_brand").orderBy("p_partkey")
    rows = table(spark, sf_dir, "part").select("p_partkey", "p_brand", (F.row_number().over(w) - 1).alias("i"), F.count("*").over(Window.partitionBy("p_brand")).alias("n"))
    return rows.select("p_partkey", "p_brand", F.pmod(F.col("i") - F.lit(7), F.col("n")).alias("turn"))


QUERIES = {f.__name__: f for f in (
    backlog_anti, active_semi, nullsafe_group_join, latest_n_nested, cheapest_lateral, relink_selfjoin, restore_missing, kpi_row, publish_funnel, marginal_missing, group_two_level, quality_gate_checks,
    duplicates, shop_health, unmatched_buckets, review_queue, export_comparison, slot_coverage, token_support, run_summary, alert_upsert, settings_latest, resume_rotation,
)}
ORACLES = {
    "backlog_anti": "SELECT c_custkey, c_mktsegment, CASE WHEN c_acctbal < 0 THEN 7 ELSE 1 END AS retry_days FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderdate >= TIMESTAMP '1998-01-01')",
    "active_semi": "SELECT s_suppkey, s_name FROM supplier WHERE s_suppkey IN (SELECT l_suppkey FROM lineitem WHERE l_returnflag = 'R')",
    "nullsafe_group_join": """WITH p AS (SELECT p_partkey, CASE WHEN p_size % 5 <> 0 THEN p_brand END AS b, p_size % 10 AS s, p_retailprice AS r FROM part), w AS (SELECT p_partkey, count(*) OVER x AS n, max(r) OVER x / min(r) OVER x AS q FROM p WINDOW x AS (PARTITION BY b, s))
        SELECT p_partkey, n, round(q, 4) AS price_ratio, q > 2 AS implausible FROM w""",
    "latest_n_nested": """SELECT o_custkey, string_agg(CAST(o_orderkey AS VARCHAR), ',' ORDER BY k) AS latest, count(*) AS n FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS k FROM orders) WHERE k <= 5 GROUP BY 1""",
    "cheapest_lateral": """WITH l AS (SELECT l_partkey, l_suppkey, CAST(floor(l_extendedprice / l_quantity + 0.5) AS BIGINT) AS price, row_number() OVER (PARTITION BY l_partkey ORDER BY floor(l_extendedprice / l_quantity + 0.5), l_suppkey) AS k, count(*) OVER (PARTITION BY l_partkey) AS n FROM lineitem)
        SELECT p_partkey, price, l_suppkey AS shop_id, coalesce(n, 0) AS n_lines FROM part LEFT JOIN l ON l_partkey = p_partkey AND k = 1""",
    "relink_selfjoin": """SELECT a.l_suppkey, a.l_partkey, min(a.l_orderkey) AS old_key, min(b.l_orderkey) AS new_key, count(DISTINCT b.l_orderkey) = 1 AS unambiguous FROM lineitem a JOIN lineitem b ON a.l_suppkey = b.l_suppkey AND a.l_partkey = b.l_partkey
        WHERE a.l_linestatus = 'F' AND b.l_linestatus = 'O' GROUP BY 1, 2""",
    "restore_missing": "SELECT l_suppkey, count(*) AS inside FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_shipdate BETWEEN o_orderdate AND o_orderdate + INTERVAL 30 DAY GROUP BY 1",
    "kpi_row": """SELECT (SELECT count(*) FROM orders) AS n_orders, (SELECT count(*) FROM orders WHERE o_orderstatus = 'O') AS open_orders, (SELECT count(DISTINCT o_custkey) FROM orders) AS active_customers, (SELECT count(*) FROM lineitem) AS n_lines,
        (SELECT count(DISTINCT l_suppkey) FROM lineitem) AS active_shops, (SELECT CAST(max(l_shipdate) AS VARCHAR) FROM lineitem) AS last_seen, (SELECT count(*) FROM customer) AS n_customers, (SELECT count(*) FROM customer WHERE c_acctbal < 0) AS in_debt,
        (SELECT count(*) FROM events WHERE event_type = 'purchase') AS purchases, (SELECT count(DISTINCT user_id) FROM events) AS users""",
    "publish_funnel": """SELECT l_suppkey, count(*) AS seen, count(*) FILTER (WHERE a) AS shipped, count(*) FILTER (WHERE a AND b) AS not_returned, count(*) FILTER (WHERE a AND b AND c) AS discounted, count(*) FILTER (WHERE a AND b AND c AND d) AS bulk
        FROM (SELECT l_suppkey, l_shipdate <= TIMESTAMP '1998-12-01' AS a, l_returnflag <> 'R' AS b, l_discount > 0.02 AS c, l_quantity >= 10 AS d FROM lineitem) GROUP BY 1""",
    "marginal_missing": """SELECT l_returnflag, count(*) FILTER (WHERE NOT a AND b AND c) AS only_price, count(*) FILTER (WHERE a AND NOT b AND c) AS only_quantity, count(*) FILTER (WHERE a AND b AND NOT c) AS only_discount, count(*) FILTER (WHERE a AND b AND c) AS complete
        FROM (SELECT l_returnflag, l_extendedprice > 2000 AS a, l_quantity >= 5 AS b, l_discount <= 0.08 AS c FROM lineitem) GROUP BY 1""",
    "group_two_level": "SELECT shops, count(*) AS parts, CAST(sum(n) AS BIGINT) AS lines FROM (SELECT l_partkey, count(DISTINCT l_suppkey) AS shops, count(*) AS n FROM lineitem GROUP BY 1) WHERE shops >= 2 GROUP BY 1",
    "quality_gate_checks": """WITH g AS (SELECT l_suppkey, count(*) AS n, count(*) FILTER (WHERE l_extendedprice <= 0) AS bp, count(*) FILTER (WHERE l_shipdate > TIMESTAMP '1998-12-01') AS fu, count(DISTINCT l_partkey) AS pa, count(*) FILTER (WHERE l_returnflag = 'R') AS re,
          count(*) FILTER (WHERE l_quantity <= 0) AS bq, count(*) FILTER (WHERE l_discount > 0.1) AS st FROM lineitem GROUP BY 1)
        SELECT l_suppkey, 'price' AS "check", bp = 0 AS passed, bp AS detail FROM g UNION ALL SELECT l_suppkey, 'future', fu = 0, fu FROM g UNION ALL SELECT l_suppkey, 'volume', n >= 50, n FROM g UNION ALL SELECT l_suppkey, 'variety', pa * 10 >= n, pa FROM g
        UNION ALL SELECT l_suppkey, 'returns', re * 3 <= n, re FROM g UNION ALL SELECT l_suppkey, 'quantity', bq = 0, bq FROM g UNION ALL SELECT l_suppkey, 'discount', st = 0, st FROM g""",
    "duplicates": "SELECT l_orderkey, l_partkey, count(*) AS n FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1",
    "shop_health": """SELECT s_suppkey, n_name, r_name, coalesce(n, 0) AS n, coalesce(o, 0) AS open, k AS last_run, CASE WHEN coalesce(n, 0) = 0 THEN 'critical' WHEN o * 2 > n THEN 'warning' ELSE 'ok' END AS level
        FROM supplier LEFT JOIN nation ON n_nationkey = s_nationkey LEFT JOIN region ON r_regionkey = n_regionkey
        LEFT JOIN (SELECT l_suppkey, count(*) AS n, count(*) FILTER (WHERE l_linestatus = 'O') AS o, (list(l_orderkey ORDER BY l_shipdate DESC, l_orderkey DESC))[1] AS k FROM lineitem GROUP BY 1) ON l_suppkey = s_suppkey""",
    "unmatched_buckets": """SELECT c_mktsegment, CASE WHEN n IS NULL THEN 'never_searched' WHEN c_acctbal < -900 THEN 'source_problem' WHEN f = 0 THEN 'ambiguous' WHEN f = n THEN 'done' WHEN n >= 15 THEN 'review' ELSE 'waiting' END AS bucket, count(*) AS n_rows
        FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n, count(*) FILTER (WHERE o_orderstatus = 'F') AS f FROM orders GROUP BY 1) ON o_custkey = c_custkey GROUP BY 1, 2""",
    "review_queue": """SELECT o_orderkey, level, o_totalprice FROM (SELECT *, CASE WHEN o_orderpriority LIKE '1%' THEN 0 WHEN o_orderpriority LIKE '2%' THEN 1 ELSE 2 END AS level FROM orders WHERE o_orderstatus = 'O')
        ORDER BY level, o_totalprice DESC, o_orderdate, o_orderkey LIMIT 100""",
    "export_comparison": """SELECT p_brand, round(sum(l_extendedprice) FILTER (WHERE l_returnflag = 'A'), 0) AS flag_a, round(sum(l_extendedprice) FILTER (WHERE l_returnflag = 'N'), 0) AS flag_n, round(sum(l_extendedprice) FILTER (WHERE l_returnflag = 'R'), 0) AS flag_r
        FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1""",
    "slot_coverage": """SELECT coalesce(c_mktsegment, 'all') AS segment, count(*) AS n, count(*) FILTER (WHERE c_acctbal > 0) AS positive, floor(count(*) FILTER (WHERE c_acctbal > 0) / count(*) * 10000 + 0.5) / 100 AS pct, CAST(grouping(c_mktsegment) AS INT) AS overall
        FROM customer GROUP BY ROLLUP (c_mktsegment)""",
    "token_support": """SELECT token, count(*) AS df, count(DISTINCT p_brand) AS brands FROM (SELECT p_partkey, p_brand, unnest(list_distinct(regexp_split_to_array(lower(p_name), '\\s+'))) AS token FROM part) WHERE token <> '' GROUP BY 1""",
    "run_summary": """SELECT l_suppkey, rate, CASE WHEN rate >= 0.7 THEN 'succeeded' WHEN rate >= 0.3 THEN 'partial' ELSE 'failed' END AS status FROM (SELECT l_suppkey, round(count(*) FILTER (WHERE l_returnflag <> 'R') / count(*), 6) AS rate FROM lineitem GROUP BY 1)""",
    "alert_upsert": "SELECT user_id, event_type, count(*) AS occurrences, max(value) AS worst, (list(event_id ORDER BY ts DESC, event_id DESC))[1] AS last_event FROM events GROUP BY 1, 2",
    "settings_latest": "SELECT user_id, (list(CAST(json_extract_string(props, '$.k') AS INT) ORDER BY ts DESC, event_id DESC))[1] AS k, count(*) AS versions FROM events GROUP BY 1",
    "resume_rotation": """SELECT p_partkey, p_brand, ((i - 7) % n + n) % n AS turn FROM (SELECT p_partkey, p_brand, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) - 1 AS i, count(*) OVER (PARTITION BY p_brand) AS n FROM part)""",
}
