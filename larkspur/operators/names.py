"""Queries over the scalar functions: names of listings are built from parts and a set of typical endings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspur.functions import ids, money, text, units
from larkspur.shared import once_each, tasks
from larkspur.sources.star import table

ENDINGS = (
    "Gere Róka 2019 0,75 l", "6 × 0,75 l karton", "Whisky – 12 Years Old 70 cl", "0,7 l x 6 díszdoboz", "Champagne Brut NV 1,5 l Magnum",
    "Tokaji Asz&uacute; 6 puttonyos 500 ml 13,5 % vol", "X.O. fadoboz 40% vol alapitva 1904 0.7L", "pack 4 db 330 ml <b>set</b>",
    "V.S.O.P. 2018 2020 valogatas 12 palack", "non-vintage 5 l", "Irish 18 eves 1 liter gift box", "",
)
YEAR = 2025


def names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """p_partkey, p_brand and the raw name of each part's listing, with its cleaned and normalized forms."""
    ending = F.get(F.array(*map(F.lit, ENDINGS)), (F.col("p_partkey") % len(ENDINGS)).cast("int"))
    rows = table(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_size", F.concat_ws(" ", "p_name", ending).alias("raw"))
    return once_each(rows, ["raw"], lambda t: t.withColumns({"clean": text.clean_text(F.col("raw")), "norm": text.search_norm(F.col("raw"))}))


_LIST = "[" + ", ".join("'" + e.replace("'", "''") + "'" for e in ENDINGS) + "]"
NAMES_SQL = f"""names AS (
  SELECT *, trim(regexp_replace(lower(strip_accents(clean)), '[^a-z0-9%.,]+', ' ', 'g')) AS norm FROM (
    SELECT *, trim(regexp_replace(regexp_replace(replace(replace(replace(raw, '&uacute;', 'ú'), '–', '-'), '×', 'x'), '<[^>]*>', ' ', 'g'), '\\s+', ' ', 'g')) AS clean FROM (
      SELECT p_partkey, p_brand, p_size, concat_ws(' ', p_name, {_LIST}[1 + p_partkey % {len(ENDINGS)}]) AS raw FROM part)))"""


def search_norm(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = once_each(names(spark, sf_dir), ["raw"], lambda t: t.withColumn("retrieval", text.retrieval_form(F.col("raw"))))
    return rows.select("p_partkey", "clean", "norm", "retrieval")


def search_norm_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole texts, normalized; with the number of tokens and of distinct ones."""
    rows = table(spark, sf_dir, "documents").select("doc_id", "text").repartition(tasks(spark), "doc_id").select("doc_id", text.search_norm(F.col("text")).alias("norm"))
    rows = rows.withColumn("t", text.tokens(F.col("norm")))
    return rows.select("doc_id", F.md5(F.col("norm").cast("binary")).alias("norm_md5"), F.size("t").alias("n_tokens"), F.size(F.array_distinct("t")).alias("n_distinct"))


def parse_volume(spark: SparkSession, sf_dir: str) -> DataFrame:
    return once_each(names(spark, sf_dir), ["clean"], lambda t: t.withColumn("v", units.parse_volume(F.col("clean")))).select("p_partkey", "v.*")


def parse_vintage(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = once_each(names(spark, sf_dir), ["clean", "norm"], lambda t: t.withColumn("v", units.parse_vintage(F.col("clean"), F.col("norm"), YEAR)))
    return rows.select("p_partkey", "v.*")


def parse_attributes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Packaging, alcohol, age and puttony of each name."""
    c, n = F.col("clean"), F.col("norm")
    read = {"packaging": units.parse_packaging(n), "abv": units.parse_abv(c), "age": units.parse_age(c), "puttony": units.parse_puttony(n)}
    return once_each(names(spark, sf_dir), ["clean", "norm"], lambda t: t.withColumns(read)).select("p_partkey", *read)


def name_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Similarities of each name with that of the next part of its brand: a window, not a self-join."""
    from pyspark.sql import Window

    nxt = F.lead(F.struct("p_partkey", "norm")).over(Window.partitionBy("p_brand").orderBy("p_partkey"))
    rows = names(spark, sf_dir).withColumn("other", nxt).where("other IS NOT NULL").select("p_partkey", F.col("norm").alias("a"), F.col("other.norm").alias("b"), F.col("other.p_partkey").alias("other_partkey"))
    rows = rows.withColumns({"ta": text.tokens(F.col("a")), "tb": text.tokens(F.col("b")), "ga": text.grams(F.col("a")), "gb": text.grams(F.col("b"))})
    tri, tok, con = text.jaccard(F.col("ga"), F.col("gb")), text.jaccard(F.col("ta"), F.col("tb")), text.containment(F.col("ta"), F.col("tb"))
    rows = rows.select("p_partkey", "other_partkey", tri.alias("trigram"), tok.alias("token"), con.alias("contained"), F.round(text.levenshtein_ratio(F.col("a"), F.col("b")), 9).alias("edit"))
    return rows.withColumns({"trigram": F.round("trigram", 9), "token": F.round("token", 9), "contained": F.round("contained", 9), "similarity": F.round(0.4 * F.col("trigram") + 0.35 * F.col("token") + 0.25 * F.col("contained"), 6)})


def parse_money(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prices written in six ways and read again."""
    p = F.floor("o_totalprice").cast("bigint")
    thousands, rest = F.floor(p / 1000).cast("bigint").cast("string"), F.lpad((p % 1000).cast("string"), 3, "0")
    k = F.col("o_orderkey") % 6
    raw = (
        F.when(k == 0, F.concat(thousands, F.lit(" "), rest, F.lit(" Ft"))).when(k == 1, F.concat(thousands, F.lit("."), rest, F.lit(",-"))).when(k == 2, F.concat(p.cast("string"), F.lit(",50 EUR")))
        .when(k == 3, F.concat(thousands, F.lit(","), rest, F.lit(".25"))).when(k == 4, F.concat(F.lit("$"), p.cast("string"))).otherwise("nincs")
    )
    rows = table(spark, sf_dir, "orders").select("o_orderkey", money.parse_money(raw).alias("amount"))
    return rows.withColumn("huf", money.to_huf(F.col("amount"), F.when(F.col("o_orderkey") % 2 == 0, 2).otherwise(0)))


def comparable_price(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prices of each order line in the roles that its numbers pick, and the one that may be compared."""
    price = F.floor("l_extendedprice").cast("bigint")
    k = F.col("l_orderkey") % 8
    pick = lambda *on: F.when(k.isin(*on), price)
    sale = F.when(k.isin(1, 2, 5), F.floor(F.col("l_extendedprice") * (1 - F.col("l_discount"))).cast("bigint")).when(k == 6, price + 100)
    out = money.comparable_price(pick(0), sale, pick(1, 2, 3, 6), pick(4), pick(4, 7), F.when(k == 7, F.lit(None).cast("bigint")), F.col("l_linestatus") == "O", require_in_stock=True)
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", out.alias("s")).select("l_orderkey", "l_linenumber", "s.*")


def identity_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Identity and canonical keys of each part, and its signature of type words."""
    rows = table(spark, sf_dir, "part").repartition(tasks(spark))  # a small file would be one task
    c = {"platform_product_id": F.col("p_partkey"), "producer_or_brand": F.col("p_brand"), "brand": F.col("p_brand"), "expression": F.col("p_name"), "volume_ml": F.col("p_size") * 25, "pack_count": F.lit(1), "packaging": F.lit("unknown"), "vintage_status": F.lit("unknown")}
    key = {"producer_key": F.col("p_brand"), "style_or_colour": F.col("p_type"), "volume_ml": F.col("p_size") * 25, "pack_count": F.lit(1), "packaging": F.lit("unknown"), "vintage_status": F.lit("unknown")}
    return rows.select("p_partkey", ids.identity_hash(c).alias("identity_hash"), ids.canonical_key(key).alias("canonical_key"), ids.signature(F.split("p_type", " ")).alias("type_signature"))


def gtin(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = F.concat(F.col("c_custkey").cast("string"), F.lit("-"), F.repeat(F.lit("7"), (F.col("c_custkey") % 16).cast("int")))
    return table(spark, sf_dir, "customer").select("c_custkey", ids.gtin(raw).alias("gtin"), ids.gtin_equal(raw, F.concat(F.lit("0"), raw)).alias("same_with_zero"))


def url_canonical(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = F.col("url")
    return table(spark, sf_dir, "pages").select("page_id", ids.canonical_url(u).alias("canonical"), ids.url_key(u).alias("url_key"), ids.slug(u).alias("slug"))


QUERIES = {f.__name__: f for f in (search_norm, search_norm_documents, parse_volume, parse_vintage, parse_attributes, name_similarity, parse_money, comparable_price, identity_hash, gtin, url_canonical)}
_NUM, _UNIT = "([0-9]+(?:[.,][0-9]+)?)", "(ml|cl|dl|liter|litre|ltr|l)"
_ML = lambda n, u: f"CAST(floor(TRY_CAST(replace({n}, ',', '.') AS DOUBLE) * CASE {u} WHEN 'ml' THEN 1 WHEN 'cl' THEN 10 WHEN 'dl' THEN 100 ELSE 1000 END + 0.5) AS INT)"
_N = lambda x: f"CASE WHEN {x} IS NULL OR {x} = '' THEN '~' ELSE {x} END"
_NORM = lambda x: f"trim(regexp_replace(lower(strip_accents({x})), '[^a-z0-9%.,]+', ' ', 'g'))"
ORACLES = {
    "search_norm": f"""WITH {NAMES_SQL} SELECT p_partkey, clean, norm,
        CASE p_partkey % {len(ENDINGS)} WHEN 6 THEN replace(norm, 'x.o.', 'xo') WHEN 8 THEN replace(norm, 'v.s.o.p.', 'vsop') ELSE norm END AS retrieval FROM names""",
    "search_norm_documents": f"""SELECT doc_id, md5(norm) AS norm_md5, len(list_filter(string_split(norm, ' '), lambda t: t <> '')) AS n_tokens,
        len(list_distinct(list_filter(string_split(norm, ' '), lambda t: t <> ''))) AS n_distinct
        FROM (SELECT doc_id, {_NORM("regexp_replace(text, '<[^>]*>', ' ', 'g')")} AS norm FROM documents)""",
    "parse_volume": f"""WITH {NAMES_SQL}, t AS (SELECT p_partkey, lower(clean) AS c FROM names), f AS (SELECT *,
        regexp_extract(c, '([0-9]{{1,3}})\\s*(?:db\\s*)?x\\s*{_NUM}\\s*{_UNIT}\\b', ['n', 'v', 'u']) AS a,
        regexp_extract(c, '{_NUM}\\s*{_UNIT}\\b\\s*x\\s*([0-9]{{1,3}})\\b', ['v', 'u', 'n']) AS b,
        list_zip(regexp_extract_all(c, '{_NUM}\\s*{_UNIT}\\b', 1), regexp_extract_all(c, '{_NUM}\\s*{_UNIT}\\b', 2)) AS z,
        regexp_extract(c, '\\b(?:karton|csomag|doboz|pack|set)\\s*([0-9]{{1,2}})\\s*(?:db|palack|uveg|bottles?)?\\b', 1) AS carton,
        TRY_CAST(regexp_extract(c, '\\b([0-9]{{1,2}})\\s*(?:db|palack|uveg|bottles?)\\b', 1) AS INT) AS bottles FROM t),
        g AS (SELECT *, list_filter(list_transform(z, lambda x: struct_pack(ml := {_ML('x[1]', 'x[2]')}, u := x[2])), lambda x: x.ml BETWEEN 20 AND 30000) AS ok,
        CASE WHEN carton <> '' THEN TRY_CAST(carton AS INT) WHEN bottles BETWEEN 2 AND 24 THEN bottles ELSE 1 END AS pk FROM f),
        h AS (SELECT *, list_max(list_transform(ok, lambda x: x.ml)) AS best FROM g),
        i AS (SELECT *, list_filter(ok, lambda x: x.ml = best)[1].u AS unit FROM h)
        SELECT p_partkey, CASE WHEN a.n <> '' THEN {_ML('a.v', 'a.u')} WHEN b.n <> '' THEN {_ML('b.v', 'b.u')} ELSE best END AS unit_ml,
        CASE WHEN a.n <> '' THEN TRY_CAST(a.n AS INT) WHEN b.n <> '' THEN TRY_CAST(b.n AS INT) ELSE pk END AS pack,
        CASE WHEN a.n <> '' THEN {_ML('a.v', 'a.u')} * TRY_CAST(a.n AS INT) WHEN b.n <> '' THEN {_ML('b.v', 'b.u')} * TRY_CAST(b.n AS INT) ELSE best * pk END AS total_ml,
        CAST(CASE WHEN a.n <> '' THEN 0.95 WHEN b.n <> '' THEN 0.92 WHEN best IS NOT NULL THEN CASE WHEN pk > 1 THEN 0.75 ELSE 0.9 END WHEN pk > 1 THEN 0.5 ELSE 0 END AS DOUBLE) AS confidence,
        CASE WHEN a.n <> '' OR b.n <> '' THEN 'explicit_pack' WHEN best IS NOT NULL THEN CASE WHEN unit = 'cl' THEN 'centiliter' WHEN unit IN ('l', 'liter', 'litre') THEN 'liter' ELSE 'single_volume' END
          WHEN pk > 1 THEN 'explicit_pack' ELSE 'none' END AS method FROM i""",
    "parse_vintage": f"""WITH {NAMES_SQL} SELECT p_partkey, CASE WHEN p_partkey % {len(ENDINGS)} = 0 THEN 2019 END AS value,
        CASE p_partkey % {len(ENDINGS)} WHEN 0 THEN 'vintage' WHEN 4 THEN 'non_vintage' WHEN 9 THEN 'non_vintage' ELSE 'unknown' END AS status,
        CAST(CASE p_partkey % {len(ENDINGS)} WHEN 0 THEN 0.85 WHEN 4 THEN 0.85 WHEN 9 THEN 0.85 ELSE 0 END AS DOUBLE) AS confidence FROM names""",
    "parse_attributes": f"""WITH {NAMES_SQL} SELECT p_partkey, CASE WHEN regexp_matches(norm, '\\bfadoboz\\b') THEN 'wooden_case' WHEN regexp_matches(norm, '\\b(diszdoboz|gift box)\\b') THEN 'gift_box'
        WHEN regexp_matches(norm, '\\bkarton\\b') THEN 'carton' WHEN regexp_matches(norm, '\\bset\\b') THEN 'set' ELSE 'unknown' END AS packaging,
        TRY_CAST(replace(regexp_extract(clean, '([0-9]{{1,2}}(?:[.,][0-9]{{1,2}})?)\\s*%', 1), ',', '.') AS DOUBLE) AS abv,
        coalesce(TRY_CAST(regexp_extract(clean, '(?i)\\b([0-9]{{1,2}})\\s*years?\\s*old\\b', 1) AS INT), TRY_CAST(regexp_extract(clean, '(?i)\\b([0-9]{{1,2}})\\s*eves\\b', 1) AS INT)) AS age,
        TRY_CAST(regexp_extract(norm, '\\b([3-6]) puttonyos\\b', 1) AS INT) AS puttony FROM names""",
    "name_similarity": f"""WITH {NAMES_SQL}, p AS (SELECT p_partkey, norm AS a, lead(p_partkey) OVER w AS other_partkey, lead(norm) OVER w AS b FROM names WINDOW w AS (PARTITION BY p_brand ORDER BY p_partkey)),
        s AS (SELECT *, list_filter(string_split(a, ' '), lambda t: t <> '') AS ta, list_filter(string_split(b, ' '), lambda t: t <> '') AS tb,
          list_distinct(list_transform(range(1, length(a) + 2), lambda i: substr('  ' || a || ' ', i, 3))) AS ga,
          list_distinct(list_transform(range(1, length(b) + 2), lambda i: substr('  ' || b || ' ', i, 3))) AS gb FROM p WHERE b IS NOT NULL),
        r AS (SELECT p_partkey, other_partkey, round(len(list_intersect(ga, gb)) / (len(ga) + len(gb) - len(list_intersect(ga, gb))), 9) AS trigram,
          round(len(list_intersect(ta, tb)) / len(list_distinct(list_concat(ta, tb))), 9) AS token,
          round(CASE WHEN len(ta) <= len(tb) THEN len(list_filter(ta, lambda t: list_contains(tb, t))) / len(ta) ELSE len(list_filter(tb, lambda t: list_contains(ta, t))) / len(tb) END, 9) AS contained,
          round(1 - levenshtein(a, b) / greatest(length(a), length(b)), 9) AS edit FROM s)
        SELECT *, round(CAST(0.4 AS DOUBLE) * trigram + CAST(0.35 AS DOUBLE) * token + CAST(0.25 AS DOUBLE) * contained, 6) AS similarity FROM r""",
    "parse_money": """SELECT o_orderkey, amount, CAST(floor(amount / CASE WHEN o_orderkey % 2 = 0 THEN 100 ELSE 1 END + 0.5) AS BIGINT) AS huf FROM (
        SELECT o_orderkey, CAST(CASE o_orderkey % 6 WHEN 2 THEN floor(o_totalprice) + 0.5 WHEN 3 THEN floor(o_totalprice) + 0.25 WHEN 5 THEN NULL ELSE floor(o_totalprice) END AS DOUBLE) AS amount FROM orders)""",
    "comparable_price": """WITH p AS (SELECT l_orderkey, l_linenumber, l_orderkey % 8 AS k, CAST(floor(l_extendedprice) AS BIGINT) AS price, l_linestatus = 'O' AS stock,
        CAST(floor(l_extendedprice * (1 - l_discount)) AS BIGINT) AS cut FROM lineitem),
        q AS (SELECT *, CASE WHEN k = 0 THEN price END AS cur, CASE WHEN k IN (1, 2, 5) THEN cut WHEN k = 6 THEN price + 100 END AS sale, CASE WHEN k IN (1, 2, 3, 6) THEN price END AS reg,
          CASE WHEN k = 4 THEN price END AS member, CASE WHEN k IN (4, 7) THEN price END AS coupon FROM p),
        r AS (SELECT *, coalesce(cur, sale, reg) AS chosen, sale IS NOT NULL AS on_sale, coalesce(sale > reg, false) AS swapped FROM q),
        s AS (SELECT *, CASE WHEN swapped THEN 'sale_above_regular' WHEN chosen IS NULL AND member IS NOT NULL THEN 'member_only' WHEN chosen IS NULL AND coupon IS NOT NULL THEN 'coupon_only'
          WHEN NOT stock THEN 'out_of_stock' END AS reason FROM r)
        SELECT l_orderkey, l_linenumber, CASE WHEN NOT swapped THEN coalesce(chosen, member, coupon) END AS price,
          CASE WHEN swapped THEN 'not_comparable' WHEN chosen IS NULL THEN CASE WHEN member IS NOT NULL THEN 'member' ELSE 'coupon' END WHEN on_sale THEN 'sale' ELSE 'regular' END AS price_type,
          reason IS NULL AS comparable, on_sale, reason FROM s""",
    "identity_hash": f"""WITH t AS (SELECT *, {_NORM('p_brand')} AS b, {_NORM('p_name')} AS n, {_NORM('p_type')} AS y FROM part)
        SELECT p_partkey, substr(sha256('v3|' || p_partkey || '|~|' || {_N('b')} || '|' || {_N('b')} || '|' || {_N('n')} || '|~|unknown|~|' || (p_size * 25) || '|1|unknown|~|~|~|~|~|~|~|~'), 1, 40) AS identity_hash,
        substr(sha256('ck1|' || {_N('b')} || '|~|' || {_N('y')} || '|~|unknown|~|' || (p_size * 25) || '|1|unknown|~|~|~'), 1, 40) AS canonical_key,
        list_aggregate(list_sort(list_distinct(list_transform(string_split(p_type, ' '), lambda x: {_NORM('x')}))), 'string_agg', '+') AS type_signature FROM t""",
    "gtin": """WITH t AS (SELECT c_custkey, c_custkey || repeat('7', CAST(c_custkey % 16 AS INT)) AS d FROM customer),
        g AS (SELECT *, CASE WHEN length(d) = 12 THEN '0' || d WHEN length(d) > 14 THEN right(d, 14) WHEN length(d) >= 8 THEN d END AS gtin,
          CASE WHEN length(d) + 1 = 12 THEN '00' || d WHEN length(d) + 1 > 14 THEN right('0' || d, 14) WHEN length(d) + 1 >= 8 THEN '0' || d END AS other FROM t)
        SELECT c_custkey, gtin, coalesce(ltrim(gtin, '0') = ltrim(other, '0'), false) AS same_with_zero FROM g""",
    "url_canonical": """WITH t AS (SELECT page_id, split_part(url, '://', 1) AS s, regexp_extract(url, '://([^/?#]*)', 1) AS h, regexp_extract(url, '://[^/?#]*([^?#]*)', 1) AS p,
        list_sort(list_filter(string_split(regexp_extract(url, '\\?([^#]*)', 1), '&'), lambda x: x <> '' AND NOT regexp_matches(x, '^(utm_[a-z]+|ref)='))) AS q FROM pages),
        u AS (SELECT *, lower(h) || CASE WHEN length(p) > 1 THEN regexp_replace(p, '/$', '') ELSE '/' END || CASE WHEN len(q) > 0 THEN '?' || list_aggregate(q, 'string_agg', '&') ELSE '' END AS rest FROM t)
        SELECT page_id, s || '://' || rest AS canonical, lower(regexp_replace(rest, '^www\\.', '')) AS url_key, regexp_extract(p, '([^/]*)/*$', 1) AS slug FROM u""",
}
