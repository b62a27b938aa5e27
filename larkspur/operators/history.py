"""Time series of observations: price events, anomalies, drift, uniform prices, run-length memory and retention."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from larkspur.functions.money import anomaly
from larkspur.sources.star import OFFERS_SQL, as_of, half_up, observations, percent, table

#: A price is uniform in a shop from so many rows and so large a share on.
UNIFORM_ROWS, UNIFORM_SHARE = 20, 0.5


def _series():
    return Window.partitionBy("variant_id", "shop_id").orderBy("observed_at", "run_id", "line")


def price_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """first_seen, price_changed and availability_changed of each listing, with the values before and after."""
    before = F.lag(F.struct("price", "in_stock")).over(_series())
    rows = observations(spark, sf_dir).withColumn("before", before)
    kinds = F.array_compact(F.array(
        F.when(F.col("before").isNull(), "first_seen"), F.when(F.col("before.price") != F.col("price"), "price_changed"),
        F.when(F.col("before.in_stock") != F.col("in_stock"), "availability_changed"),
    ))
    rows = rows.select("variant_id", "shop_id", "run_id", "line", F.explode(kinds).alias("kind"), F.col("before.price").alias("old_price"), F.col("price").alias("new_price"))
    delta = F.when(F.col("kind") == "price_changed", F.col("new_price") - F.col("old_price"))
    return rows.withColumns({"delta": delta, "delta_pct": percent(delta / F.col("old_price"))})


def price_anomaly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flags of each observation against the one before and the variant's median."""
    rows = observations(spark, sf_dir)
    market = rows.groupBy("variant_id").agg(half_up(F.median("price")).alias("market_median"))
    rows = rows.withColumn("previous", F.lag("price").over(_series())).join(market, "variant_id")
    found = anomaly(F.col("price"), F.col("previous"), F.col("market_median"), F.lit(None).cast("bigint"), F.lit(None).cast("int"))
    rows = rows.select("variant_id", "shop_id", "run_id", "line", found.alias("a"))
    return rows.select("variant_id", "shop_id", "run_id", "line", F.array_join("a.flags", ",").alias("flags"), "a.quarantine", "a.significance", "a.delta", "a.delta_pct")


def uniform_price(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each shop's most frequent price with its share, and whether that is suspiciously uniform."""
    by_price = observations(spark, sf_dir).groupBy("shop_id", F.floor(F.col("price") / 100).alias("price_band")).agg(F.count("*").alias("n"))
    top = by_price.groupBy("shop_id").agg(F.sum("n").alias("rows"), F.max(F.struct("n", "price_band")).alias("top"))
    share = F.col("top.n") / F.col("rows")
    return top.select("shop_id", "rows", "top.price_band", F.col("top.n").alias("same"), F.round(share, 6).alias("share"), ((F.col("rows") >= UNIFORM_ROWS) & (share >= UNIFORM_SHARE)).alias("uniform"))


def drift_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What changed in a listing between observations: an unknown value that becomes known is no drift.

    The return flag stands in for an identity field, quantity for packs, status for a cosmetic one.
    """
    x = table(spark, sf_dir, "lineitem").select(
        F.col("l_partkey").alias("variant_id"), F.col("l_suppkey").alias("shop_id"), F.col("l_orderkey").alias("run_id"), F.col("l_linenumber").alias("line"), F.col("l_shipdate").alias("observed_at"),
        F.nullif("l_returnflag", F.lit("N")).alias("edition"), F.col("l_quantity").cast("int").alias("pack"), "l_linestatus",
    )
    w = Window.partitionBy("variant_id", "shop_id").orderBy("observed_at", "run_id", "line")
    rows = x.withColumn("b", F.lag(F.struct("edition", "pack", "l_linestatus")).over(w)).where("b IS NOT NULL")
    changed = F.array_compact(F.array(
        F.when(F.col("b.edition").isNotNull() & ~F.col("b.edition").eqNullSafe(F.col("edition")), "edition"), F.when(F.col("b.pack") != F.col("pack"), "pack"),
    ))
    severity = F.when(F.size("changed") >= 2, "product_changed").when(F.size("changed") == 1, "significant").when(F.col("b.l_linestatus") != F.col("l_linestatus"), "cosmetic").otherwise("none")
    return rows.withColumn("changed", changed).select("variant_id", "shop_id", "run_id", "line", F.array_join("changed", ",").alias("changed_fields"), severity.alias("severity"))


def decision_compaction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of equal decisions of one customer become one row with a count: first and last order, and how often seen."""
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    rows = table(spark, sf_dir, "orders").withColumn("new", (~F.col("o_orderstatus").eqNullSafe(F.lag("o_orderstatus").over(w))).cast("int"))
    rows = rows.withColumn("run", F.sum("new").over(w))
    return rows.groupBy("o_custkey", "run").agg(F.min("o_orderstatus").alias("status"), F.count("*").alias("seen_count"), F.min("o_orderkey").alias("least_key"), F.max("o_orderkey").alias("greatest_key"))


def retention(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many observations of each shop retention deletes: those over 1100 days old that aren't a listing's latest."""
    latest = observations(spark, sf_dir).groupBy("variant_id", "shop_id").agg(F.max(F.struct("observed_at", "run_id", "line")).alias("l")).select("variant_id", "shop_id", "l.run_id", "l.line")
    old = observations(spark, sf_dir).where(F.col("observed_at") < as_of() - F.expr("INTERVAL 1100 DAYS"))
    return old.join(latest, ["variant_id", "shop_id", "run_id", "line"], "left_anti").groupBy("shop_id").agg(F.count("*").alias("deleted"))


def prune_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders that a later one of the same customer and status supersedes: a window maximum in place of a theta semi-join."""
    w = Window.partitionBy("o_custkey", "o_orderstatus")
    rows = table(spark, sf_dir, "orders").withColumn("last", F.max(F.struct("o_orderdate", "o_orderkey")).over(w))
    return rows.where(F.struct("o_orderdate", "o_orderkey") < F.col("last")).groupBy("o_custkey").agg(F.count("*").alias("superseded"), F.min("o_orderkey").alias("first_key"))


def listing_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Listings not seen in the last year of their shop's observations, with the days since."""
    seen = observations(spark, sf_dir).groupBy("variant_id", "shop_id").agg(F.max("observed_at").alias("last_seen"))
    shop = seen.groupBy("shop_id").agg(F.max("last_seen").alias("shop_last"))
    rows = seen.join(shop, "shop_id").where(F.col("last_seen") < F.col("shop_last") - F.expr("INTERVAL 365 DAYS"))
    return rows.select("variant_id", "shop_id", F.datediff("shop_last", "last_seen").alias("days_missing"))


def crawl_run_vs_previous(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each run of a customer against the one before: total, difference and days between."""
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    rows = table(spark, sf_dir, "orders").withColumn("p", F.lag(F.struct("o_orderkey", "o_totalprice", "o_orderdate")).over(w))
    return rows.select("o_orderkey", F.col("p.o_orderkey").alias("previous_key"), F.round(F.col("o_totalprice") - F.col("p.o_totalprice"), 2).alias("total_delta"), F.datediff("o_orderdate", "p.o_orderdate").alias("days"))


QUERIES = {f.__name__: f for f in (price_events, price_anomaly, uniform_price, drift_diff, decision_compaction, retention, prune_decisions, listing_missing, crawl_run_vs_previous)}
_W = "(PARTITION BY variant_id, shop_id ORDER BY observed_at, run_id, line)"
ORACLES = {
    "price_events": f"""WITH {OFFERS_SQL}, b AS (SELECT *, lag(price) OVER w AS old_price, lag(in_stock) OVER w AS old_stock, row_number() OVER w AS k FROM obs WINDOW w AS {_W}),
        e AS (SELECT *, 'first_seen' AS kind FROM b WHERE k = 1 UNION ALL SELECT *, 'price_changed' FROM b WHERE old_price <> price UNION ALL SELECT *, 'availability_changed' FROM b WHERE old_stock <> in_stock)
        SELECT variant_id, shop_id, run_id, line, kind, old_price, price AS new_price, CASE WHEN kind = 'price_changed' THEN price - old_price END AS delta,
        CASE WHEN kind = 'price_changed' THEN floor((price - old_price) / old_price * 10000 + 0.5) / 100 END AS delta_pct FROM e""",
    "price_anomaly": f"""WITH {OFFERS_SQL}, m AS (SELECT variant_id, CAST(floor(median(price) + 0.5) AS BIGINT) AS med FROM obs GROUP BY 1),
        b AS (SELECT *, lag(price) OVER {_W} AS prev FROM obs), c AS (SELECT b.*, med, price - prev AS delta, floor((price - prev) / prev * 10000 + 0.5) / 100 AS delta_pct, price / prev AS f, price / med AS r FROM b JOIN m USING (variant_id)),
        d AS (SELECT *, price < 500 AS low, price > 8000000 AS high, coalesce(r BETWEEN 90 AND 110, false) AS x, coalesce(r BETWEEN 0.009 AND 0.011, false) AS y, coalesce(f >= 8 OR f <= 0.125, false) AS j, coalesce(abs(delta_pct) >= 60, false) AS ex, coalesce(abs(delta_pct) >= 15, false) AS sg FROM c)
        SELECT variant_id, shop_id, run_id, line, concat_ws(',', CASE WHEN low THEN 'IMPLAUSIBLY_LOW' END, CASE WHEN high THEN 'IMPLAUSIBLY_HIGH' END, CASE WHEN x THEN 'MINOR_UNIT_SUSPECT_X100' WHEN y THEN 'MINOR_UNIT_SUSPECT_DIV100' END,
          CASE WHEN j THEN 'MAGNITUDE_CHANGE' WHEN ex THEN 'EXTREME_CHANGE' WHEN sg THEN 'SIGNIFICANT_CHANGE' END) AS flags,
        low OR high OR x OR y OR j OR ex AS quarantine, CASE WHEN low OR high OR x OR y OR j OR ex THEN 'extreme' WHEN sg THEN 'significant' ELSE 'normal' END AS significance, delta, delta_pct FROM d""",
    "uniform_price": f"""WITH {OFFERS_SQL}, g AS (SELECT shop_id, CAST(floor(price / 100) AS BIGINT) AS price_band, count(*) AS n FROM obs GROUP BY 1, 2),
        t AS (SELECT *, sum(n) OVER (PARTITION BY shop_id) AS total, row_number() OVER (PARTITION BY shop_id ORDER BY n DESC, price_band DESC) AS k FROM g)
        SELECT shop_id, CAST(total AS BIGINT) AS rows, price_band, n AS same, round(n / total, 6) AS share, total >= 20 AND n / total >= 0.5 AS uniform FROM t WHERE k = 1""",
    "drift_diff": """WITH b AS (SELECT *, nullif(l_returnflag, 'N') AS ed, CAST(l_quantity AS INT) AS pk, lag(nullif(l_returnflag, 'N')) OVER w AS ed0, lag(CAST(l_quantity AS INT)) OVER w AS pk0, lag(l_linestatus) OVER w AS ls0
          FROM lineitem WINDOW w AS (PARTITION BY l_partkey, l_suppkey ORDER BY l_shipdate, l_orderkey, l_linenumber)),
        c AS (SELECT *, ed0 IS NOT NULL AND ed0 IS DISTINCT FROM ed AS e, pk0 <> pk AS p FROM b WHERE pk0 IS NOT NULL)
        SELECT l_partkey AS variant_id, l_suppkey AS shop_id, l_orderkey AS run_id, l_linenumber AS line, concat_ws(',', CASE WHEN e THEN 'edition' END, CASE WHEN p THEN 'pack' END) AS changed_fields,
        CASE WHEN e AND p THEN 'product_changed' WHEN e OR p THEN 'significant' WHEN ls0 <> l_linestatus THEN 'cosmetic' ELSE 'none' END AS severity FROM c""",
    "decision_compaction": """WITH b AS (SELECT *, CAST(o_orderstatus IS DISTINCT FROM lag(o_orderstatus) OVER w AS INT) AS new FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)),
        c AS (SELECT *, sum(new) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS run FROM b)
        SELECT o_custkey, CAST(run AS BIGINT) AS run, min(o_orderstatus) AS status, count(*) AS seen_count, min(o_orderkey) AS least_key, max(o_orderkey) AS greatest_key FROM c GROUP BY 1, 2""",
    "retention": f"""WITH {OFFERS_SQL} SELECT shop_id, count(*) AS deleted FROM obs WHERE observed_at < TIMESTAMP '1998-12-01' - INTERVAL 1100 DAY
        AND NOT EXISTS (SELECT 1 FROM latest l WHERE l.variant_id = obs.variant_id AND l.shop_id = obs.shop_id AND l.run_id = obs.run_id AND l.line = obs.line) GROUP BY 1""",
    "prune_decisions": """SELECT o_custkey, count(*) AS superseded, min(o_orderkey) AS first_key FROM orders o WHERE EXISTS (SELECT 1 FROM orders p WHERE p.o_custkey = o.o_custkey AND p.o_orderstatus = o.o_orderstatus
        AND (p.o_orderdate > o.o_orderdate OR p.o_orderdate = o.o_orderdate AND p.o_orderkey > o.o_orderkey)) GROUP BY 1""",
    "listing_missing": f"""WITH {OFFERS_SQL}, s AS (SELECT shop_id, max(observed_at) AS shop_last FROM obs GROUP BY 1)
        SELECT variant_id, shop_id, date_diff('day', CAST(observed_at AS DATE), CAST(shop_last AS DATE)) AS days_missing FROM latest JOIN s USING (shop_id) WHERE observed_at < shop_last - INTERVAL 365 DAY""",
    "crawl_run_vs_previous": """SELECT o_orderkey, lag(o_orderkey) OVER w AS previous_key, round(o_totalprice - lag(o_totalprice) OVER w, 2) AS total_delta, date_diff('day', CAST(lag(o_orderdate) OVER w AS DATE), CAST(o_orderdate AS DATE)) AS days
        FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)""",
}
