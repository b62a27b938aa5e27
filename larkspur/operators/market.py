"""Market position of offers: ranks with ties, spread, median, freshness, and what is read from them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from larkspur.sources.star import OFFERS_SQL, as_of, half_up, latest_offers, observations, percent, table

#: Offers that were seen longer ago than this are stale.
MAX_AGE_HOURS = 24 * 900


def fresh(offers: DataFrame) -> DataFrame:
    """Offers with hours since observation (two places, half up) and whether they are stale."""
    seconds = F.unix_timestamp(as_of().cast("timestamp")) - F.unix_timestamp(F.col("observed_at").cast("timestamp"))
    return offers.withColumn("age_hours", F.floor(seconds / 36 + 0.5) / 100).withColumn("stale", F.col("age_hours") > MAX_AGE_HOURS)


FRESH_SQL = OFFERS_SQL + f""", fresh AS (
  SELECT *, floor(date_diff('second', observed_at, TIMESTAMP '1998-12-01') / 36.0 + 0.5) / 100 AS age_hours,
    floor(date_diff('second', observed_at, TIMESTAMP '1998-12-01') / 36.0 + 0.5) / 100 > {MAX_AGE_HOURS} AS stale FROM latest),
valid AS (SELECT * FROM fresh WHERE NOT stale AND price > 0)"""


def positions(offers: DataFrame) -> DataFrame:
    """Rank, ties and differences of each valid offer in its variant's market. One shuffle by variant serves all windows."""
    valid = offers.where("NOT stale AND price > 0")
    market, by_price = Window.partitionBy("variant_id"), Window.partitionBy("variant_id").orderBy("price")
    rows = valid.withColumns({
        "rank": F.rank().over(by_price), "denominator": F.count("*").over(market), "low": F.min("price").over(market),
        "mid": F.median("price").over(market),
        "tied": F.count("*").over(by_price.rangeBetween(0, 0)) > 1,
    }).withColumn("mid", half_up(F.col("mid")))
    return rows.select(
        "variant_id", "shop_id", "price", "rank", "denominator", "tied", (F.col("price") - F.col("low")).alias("delta_min"),
        percent((F.col("price") - F.col("low")) / F.col("low")).alias("delta_min_pct"), (F.col("price") - F.col("mid")).alias("delta_median"),
        F.when(F.col("mid") > 0, percent((F.col("price") - F.col("mid")) / F.col("mid"))).otherwise(0.0).alias("delta_median_pct"),
    )


POSITIONS_SQL = FRESH_SQL + """, pos AS (
  SELECT v.variant_id, v.shop_id, v.price, rank() OVER (PARTITION BY v.variant_id ORDER BY v.price) AS rank, m.n AS denominator,
    count(*) OVER (PARTITION BY v.variant_id, v.price) > 1 AS tied, v.price - m.low AS delta_min,
    floor((v.price - m.low) / m.low * 10000 + 0.5) / 100 AS delta_min_pct, v.price - m.mid AS delta_median,
    CASE WHEN m.mid > 0 THEN floor((v.price - m.mid) / m.mid * 10000 + 0.5) / 100 ELSE 0.0 END AS delta_median_pct
  FROM valid v JOIN (SELECT variant_id, count(*) AS n, min(price) AS low, CAST(floor(median(price) + 0.5) AS BIGINT) AS mid FROM valid GROUP BY 1) m USING (variant_id))"""


def summaries(offers: DataFrame) -> DataFrame:
    """One row a variant: counts, extremes with their shops, median, average, spread and data quality.

    offers has one row a variant and shop, so offers are shops. The lowest price goes to the lowest shop that has it, the highest to the highest one.
    """
    ok = (~F.col("stale")) & (F.col("price") > 0)
    price = F.when(ok, F.col("price"))
    low, high = F.min(F.when(ok, F.struct("price", "shop_id"))), F.max(F.when(ok, F.struct("price", "shop_id")))
    rows = offers.groupBy("variant_id").agg(
        F.count(price).alias("offer_count"), F.count(price).alias("shop_count"), low.alias("lo"), high.alias("hi"),
        half_up(F.median(price)).alias("median_price"), half_up(F.sum(price) / F.count(price)).alias("avg_price"),
        F.bool_or("stale").alias("any_stale"), F.count_if(ok & (F.col("regular") > F.col("price"))).alias("on_sale"),
    )
    quality = F.when(F.col("offer_count") == 0, "degraded").when(F.col("any_stale"), "partial").when(F.col("shop_count") == 1, "provisional").otherwise("ok")
    spread = F.col("hi.price") - F.col("lo.price")
    return rows.select(
        "variant_id", "offer_count", "shop_count", F.col("lo.price").alias("min_price"), F.col("hi.price").alias("max_price"), "median_price", "avg_price",
        spread.alias("spread"), percent(spread / F.col("lo.price")).alias("spread_pct"), F.col("lo.shop_id").alias("min_shop_id"), F.col("hi.shop_id").alias("max_shop_id"),
        "on_sale", quality.alias("data_quality"),
    )


SUMMARIES_SQL = FRESH_SQL + """, summary AS (
  SELECT variant_id, count(*) FILTER (WHERE ok) AS offer_count, count(DISTINCT shop_id) FILTER (WHERE ok) AS shop_count,
    min(price) FILTER (WHERE ok) AS min_price, max(price) FILTER (WHERE ok) AS max_price,
    CAST(floor(median(price) FILTER (WHERE ok) + 0.5) AS BIGINT) AS median_price,
    CAST(floor(sum(price) FILTER (WHERE ok) / count(*) FILTER (WHERE ok) + 0.5) AS BIGINT) AS avg_price,
    max(price) FILTER (WHERE ok) - min(price) FILTER (WHERE ok) AS spread,
    floor((max(price) FILTER (WHERE ok) - min(price) FILTER (WHERE ok)) / min(price) FILTER (WHERE ok) * 10000 + 0.5) / 100 AS spread_pct,
    (list(shop_id ORDER BY price, shop_id) FILTER (WHERE ok))[1] AS min_shop_id,
    (list(shop_id ORDER BY price DESC, shop_id DESC) FILTER (WHERE ok))[1] AS max_shop_id,
    count(*) FILTER (WHERE ok AND regular > price) AS on_sale,
    CASE WHEN count(*) FILTER (WHERE ok) = 0 THEN 'degraded' WHEN bool_or(stale) THEN 'partial'
      WHEN count(DISTINCT shop_id) FILTER (WHERE ok) = 1 THEN 'provisional' ELSE 'ok' END AS data_quality
  FROM (SELECT *, NOT stale AND price > 0 AS ok FROM fresh) GROUP BY 1)"""


def offers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fresh(latest_offers(spark, sf_dir))


def market_position(spark: SparkSession, sf_dir: str) -> DataFrame:
    return positions(offers(spark, sf_dir))


def market_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summaries(offers(spark, sf_dir))


def latest_offer_per_pair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return offers(spark, sf_dir).select("variant_id", "shop_id", "price", "regular", "in_stock", "age_hours", "stale")


def rank_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often each shop stands at each rank in markets of two offers or more, and its share of these."""
    pos = market_position(spark, sf_dir).where("denominator >= 2")
    rows = pos.groupBy("shop_id", "rank").agg(F.count("*").alias("n"))
    return rows.withColumn("share_pct", percent(F.col("n") / F.sum("n").over(Window.partitionBy("shop_id"))))


def most_expensive(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each shop's 25 offers that are furthest above the market's lowest price, with the cheapest shop."""
    pos = market_position(spark, sf_dir).where("denominator > 1 AND delta_min > 0")
    k = F.row_number().over(Window.partitionBy("shop_id").orderBy(F.desc("delta_min_pct"), "variant_id"))
    top = pos.withColumn("place", k).where("place <= 25").select("shop_id", "place", "variant_id", "price", "delta_min_pct")
    cheapest = market_summary(spark, sf_dir).select("variant_id", "min_shop_id", "min_price")
    return top.join(cheapest, "variant_id")


def anchor_comparison(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One shop's offers against the best and the median of the others: one grouping by variant, no self-join."""
    price, mine = F.col("price"), F.col("shop_id") == 1
    out = offers(spark, sf_dir).where("NOT stale AND price > 0").groupBy("variant_id").agg(
        F.min(F.when(mine, price)).alias("anchor_price"), F.min(F.when(~mine, price)).alias("other_min"), F.count_if(~mine).alias("other_offers"), half_up(F.median(F.when(~mine, price))).alias("other_median"),
    ).where("anchor_price IS NOT NULL")
    return out.withColumn("delta_pct", percent((F.col("anchor_price") - F.col("other_min")) / F.col("other_min")))


def comparison_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every variant with a valid offer, with a cell for each shop that offers it, and the five first shops' fresh prices.

    cells: by shop, in order of their ids; stale offers are there too and say so. The five columns are read from the cells.
    """
    cell = F.struct("shop_id", F.struct("price", "regular", "in_stock", "stale").alias("cell"))
    cells = offers(spark, sf_dir).groupBy("variant_id").agg(F.map_from_entries(F.array_sort(F.collect_list(cell))).alias("cells"))
    summary = market_summary(spark, sf_dir).where("offer_count > 0").select("variant_id", "min_price", "spread_pct")
    wide = {f"shop_{i}": F.expr(f"CASE WHEN NOT cells[{i}L].stale THEN cells[{i}L].price END") for i in range(1, 6)}
    return summary.join(cells, "variant_id", "left").withColumns(wide)


def matrix_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The second page of 50 variants with the widest spread among those of a category that several shops sell."""
    parts = table(spark, sf_dir, "part").where(F.col("p_type").ilike("%STEEL%") | F.col("p_name").ilike("%steel%") | (F.col("p_size") > 20)).select(F.col("p_partkey").alias("variant_id"), "p_name")
    wide = market_summary(spark, sf_dir).where("shop_count >= 2").join(parts, "variant_id")
    return wide.orderBy(F.desc_nulls_last("spread_pct"), "variant_id").offset(50).limit(50).select("variant_id", "p_name", "spread_pct", "shop_count")


def band_position(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where each offer stands between the lowest (0) and the highest (100) price of its variant."""
    w = Window.partitionBy("variant_id")
    rows = offers(spark, sf_dir).where("NOT stale AND price > 0").withColumns({"lo": F.min("price").over(w), "hi": F.max("price").over(w)})
    return rows.select("variant_id", "shop_id", F.round(100.0 * (F.col("price") - F.col("lo")) / F.greatest(F.lit(1), F.col("hi") - F.col("lo")), 6).alias("band_pct"))


def price_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each listing's prices of the last 180 days before the as-of moment, with the price before; the filter reaches the scan."""
    start = F.expr("timestamp_ntz'1998-06-04 00:00:00'")
    rows = observations(spark, sf_dir).where((F.col("observed_at") >= start) & (F.col("observed_at") <= as_of()))
    w = Window.partitionBy("variant_id", "shop_id").orderBy("observed_at", "run_id", "line")
    return rows.select("variant_id", "shop_id", "run_id", "line", "price", F.lag("price").over(w).alias("previous_price"), F.row_number().over(w).alias("step"))


def best_price_carried(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Monthly lowest price of each variant, with the last known one carried over months without an observation."""
    months = observations(spark, sf_dir).groupBy("variant_id", F.date_trunc("month", "observed_at").alias("month")).agg(F.min("price").alias("low"))
    spine = months.groupBy("variant_id").agg(F.min("month").alias("a"), F.max("month").alias("b")).select("variant_id", F.explode(F.expr("sequence(a, b, interval 1 month)")).alias("month"))
    w = Window.partitionBy("variant_id").orderBy("month")
    rows = spine.join(months, ["variant_id", "month"], "left")
    return rows.select("variant_id", F.date_format("month", "yyyy-MM").alias("month"), "low", F.last("low", True).over(w).alias("carried"))


def comparison_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The matrix with its cells as text, `shop:price:regular:in_stock:stale;...`, as an export writes it."""
    text = F.transform(F.map_entries("cells"), lambda e: F.concat_ws(":", e["key"].cast("string"), *(e["value"][c].cast("string") for c in ("price", "regular", "in_stock", "stale"))))
    return comparison_matrix(spark, sf_dir).withColumn("cells", F.array_join(text, ";"))


QUERIES = {"comparison_matrix": comparison_cells} | {f.__name__: f for f in (market_position, market_summary, latest_offer_per_pair, rank_distribution, most_expensive, anchor_comparison, matrix_page, band_position, price_history, best_price_carried)}
ORACLES = {
    "market_position": f"WITH {POSITIONS_SQL} SELECT * FROM pos",
    "market_summary": f"WITH {SUMMARIES_SQL} SELECT * FROM summary",
    "latest_offer_per_pair": f"WITH {FRESH_SQL} SELECT variant_id, shop_id, price, regular, in_stock, age_hours, stale FROM fresh",
    "rank_distribution": f"""WITH {POSITIONS_SQL}, g AS (SELECT shop_id, rank, count(*) AS n FROM pos WHERE denominator >= 2 GROUP BY 1, 2)
        SELECT *, floor(n / sum(n) OVER (PARTITION BY shop_id) * 10000 + 0.5) / 100 AS share_pct FROM g""",
    "most_expensive": f"""WITH {POSITIONS_SQL.replace(', pos AS', ', pos AS')}, summary AS (
        SELECT variant_id, min(price) AS min_price, (list(shop_id ORDER BY price, shop_id))[1] AS min_shop_id FROM valid GROUP BY 1),
        t AS (SELECT *, row_number() OVER (PARTITION BY shop_id ORDER BY delta_min_pct DESC, variant_id) AS place FROM pos WHERE denominator > 1 AND delta_min > 0)
        SELECT variant_id, shop_id, place, price, delta_min_pct, min_shop_id, min_price FROM t JOIN summary USING (variant_id) WHERE place <= 25""",
    "anchor_comparison": f"""WITH {FRESH_SQL}, others AS (SELECT variant_id, min(price) AS other_min, count(*) AS other_offers,
        CAST(floor(median(price) + 0.5) AS BIGINT) AS other_median FROM valid WHERE shop_id <> 1 GROUP BY 1)
        SELECT a.variant_id, a.price AS anchor_price, other_min, coalesce(other_offers, 0) AS other_offers, other_median,
        floor((a.price - other_min) / other_min * 10000 + 0.5) / 100 AS delta_pct FROM valid a LEFT JOIN others USING (variant_id) WHERE a.shop_id = 1""",
    "comparison_matrix": f"""WITH {SUMMARIES_SQL}, cells AS (SELECT variant_id, {', '.join(f'min(price) FILTER (WHERE shop_id = {i} AND NOT stale) AS shop_{i}' for i in range(1, 6))},
        string_agg(concat_ws(':', shop_id, price, regular, in_stock, stale), ';' ORDER BY shop_id) AS cells FROM fresh GROUP BY 1)
        SELECT cells.*, min_price, spread_pct FROM summary JOIN cells USING (variant_id) WHERE offer_count > 0""",
    "matrix_page": f"""WITH {SUMMARIES_SQL} SELECT variant_id, p_name, spread_pct, shop_count FROM summary JOIN part ON p_partkey = variant_id
        WHERE shop_count >= 2 AND (p_type ILIKE '%STEEL%' OR p_name ILIKE '%steel%' OR p_size > 20)
        ORDER BY spread_pct DESC NULLS LAST, variant_id LIMIT 50 OFFSET 50""",
    "band_position": f"""WITH {FRESH_SQL} SELECT variant_id, shop_id, round(100.0 * (price - min(price) OVER w) / greatest(1, max(price) OVER w - min(price) OVER w), 6) AS band_pct
        FROM valid WINDOW w AS (PARTITION BY variant_id)""",
    "price_history": f"""WITH {OFFERS_SQL} SELECT variant_id, shop_id, run_id, line, price, lag(price) OVER w AS previous_price, row_number() OVER w AS step
        FROM obs WHERE observed_at BETWEEN TIMESTAMP '1998-06-04' AND TIMESTAMP '1998-12-01' WINDOW w AS (PARTITION BY variant_id, shop_id ORDER BY observed_at, run_id, line)""",
    "best_price_carried": f"""WITH {OFFERS_SQL}, m AS (SELECT variant_id, date_trunc('month', observed_at) AS month, min(price) AS low FROM obs GROUP BY 1, 2),
        spine AS (SELECT variant_id, unnest(generate_series(min(month)::TIMESTAMP, max(month)::TIMESTAMP, INTERVAL 1 MONTH)) AS month FROM m GROUP BY 1)
        SELECT variant_id, strftime(s.month, '%Y-%m') AS month, low, last_value(low IGNORE NULLS) OVER (PARTITION BY variant_id ORDER BY s.month) AS carried
        FROM spine s LEFT JOIN m USING (variant_id, month)""",
}
