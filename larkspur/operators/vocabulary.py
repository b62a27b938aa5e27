"""Names of products read slot by slot with a vocabulary of phrases.

The phrases in all names are found by one equi-join: the windows of a name's tokens, up to the longest phrase, meet the
vocabulary by their text. Either side may be of any size; a window that is in many names is split by the engine's skew join. What
is left for each name is a short list of occurrences, and a fold over it in their order of preference: from left to right the
longest phrase first. A second round takes the vineyards that belong to the producer found in the first. Names are read once each,
however many shops write them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspur.functions import text
from larkspur.shared import tasks, written
from larkspur.sources import shop_names

# Slots in the order in which they win among phrases of one length, and how years and measures are written.
SLOTS = ("producer", "vineyard", "region", "grape", "style")
YEAR = r"^(19|20)[0-9]{2}$"
MEASURE = (
    r"^([0-9]+([.,][0-9]+)?(ml|cl|dl|l|liter|litre|ltr)?|ml|cl|dl|l|liter|litre|ltr|[0-9]{1,3}x[0-9]+([.,][0-9]+)?(ml|cl|dl|l)?|"
    r"[0-9]{1,2}(db|palack|uveg)|db|palack|uveg|[0-9]{1,2}([.,][0-9]{1,2})?%|%)$"
)

_HIT = "struct<start:int,n:int,slot:string,id:string,canonical_name:string,matched:string,via_alias:string,producer_id:string>"
_STATE = f"struct<taken:array<struct<start:int,n:int>>,producer:string,vineyard:string,region:string,style:string,grapes:array<string>,matches:array<{_HIT}>,ambiguous:array<{_HIT}>>"


def name_tokens(name: Column) -> Column:
    """Tokens of a normalized name; dots and commas around a token go, but in numbers they stay."""
    plain = F.transform(text.tokens(text.search_norm(name)), lambda t: F.when(t.rlike(r"^[0-9.,%]+$"), t).otherwise(F.regexp_replace(t, r"^[.,]+|[.,]+$", "")))
    return F.filter(plain, lambda t: t != "")


def is_measure(token: Column) -> Column:
    """A volume, number, pack, bottle count or alcohol content."""
    return token.rlike(MEASURE)


def windows(tokens: Column, longest: int) -> Column:
    """Structs (start, n, phrase) of all windows of at most `longest` tokens."""
    m = F.size(tokens)
    at = lambda i: F.transform(F.sequence(F.lit(1), F.least(F.lit(longest), m - i)), lambda n: F.struct(i.alias("start"), n.alias("n"), F.array_join(F.slice(tokens, i + 1, n), " ").alias("phrase")))
    return F.when(m > 0, F.flatten(F.transform(F.sequence(F.lit(0), m - 1), at)))


def occurrences(names: DataFrame, tokens: str, phrases: DataFrame, phrase: str) -> DataFrame:
    """names x phrases, with start and n, for each place where the tokens of a phrase are in the tokens of a name.

    `phrase` holds the phrase's tokens. Phrases without tokens are nowhere.
    """
    known = phrases.where(F.size(phrase) > 0).withColumn("_phrase", F.array_join(phrase, " "))
    longest = known.agg(F.max(F.size(phrase))).first()[0] or 1
    rows = names.select("*", F.explode(windows(F.col(tokens), longest)).alias("_w")).select(*names.columns, "_w.start", "_w.n", F.col("_w.phrase").alias("_phrase"))
    return rows.join(known, "_phrase").drop("_phrase")


def _fold(hits: Column, taken: Column, scope: Column) -> Column:
    """The state after all hits: they come by round, start, length (the longer first), slot and name."""
    empty, hit = F.array().cast(f"array<{_HIT}>"), "start n slot id canonical_name matched via_alias producer_id".split()
    none = F.lit(None).cast("string")
    begin = F.struct(taken.alias("taken"), *[none.alias(s) for s in ("producer", "vineyard", "region", "style")], F.array().cast("array<string>").alias("grapes"), empty.alias("matches"), empty.alias("ambiguous")).cast(_STATE)

    def step(s: Column, c: Column) -> Column:
        second = c["round"] == 2
        owner = F.when(second, s.producer).otherwise(c.scope)
        covered = F.exists(s.taken, lambda t: (t.start < c.start + c.n) & (c.start < t.start + t.n))
        skipped = (second & s.producer.isNull()) | ((c.slot == "vineyard") & c.producer_id.isNotNull() & ~c.producer_id.eqNullSafe(owner)) | covered
        now = F.when(c.slot == "producer", s.producer).when(c.slot == "vineyard", s.vineyard).when(c.slot == "region", s.region).when(c.slot == "style", s.style)
        same = F.coalesce(now == c.id, F.lit(False)) | ((c.slot == "grape") & F.array_contains(s.grapes, c.id))
        own = F.struct(*[c[f].alias(f) for f in hit])
        unclear = F.struct(*[s[f].alias(f) for f in ("taken", "producer", "vineyard", "region", "style", "grapes", "matches")], F.concat(s.ambiguous, F.array(own)).alias("ambiguous"))
        set_to = lambda slot: F.when(c.slot == slot, c.id).otherwise(s[slot]).alias(slot)
        used = F.struct(
            F.concat(s.taken, F.array(F.struct(c.start.alias("start"), c.n.alias("n")))).alias("taken"), *[set_to(x) for x in ("producer", "vineyard", "region", "style")],
            F.when((c.slot == "grape") & ~same, F.concat(s.grapes, F.array(c.id))).otherwise(s.grapes).alias("grapes"), F.when(same, s.matches).otherwise(F.concat(s.matches, F.array(own))).alias("matches"), s.ambiguous.alias("ambiguous"),
        )
        return F.when(skipped, s).when(now.isNotNull() & ~same, unclear.cast(_STATE)).otherwise(used.cast(_STATE))

    def rounds(number: int) -> Column:
        return F.transform(hits, lambda h: F.struct(F.lit(number).alias("round"), scope.alias("scope"), *[h[f].alias(f) for f in hit]))

    return F.aggregate(F.concat(rounds(1), rounds(2)), begin, step)


def parse_names(names: DataFrame, vocabulary: DataFrame, *, name: str = "title", scope: str | None = None, noise: tuple[str, ...] = ()) -> DataFrame:
    """names with tokens, producer, vineyard, region, style (ids), grapes (ids), vintage, expression, matches and ambiguous.

    vocabulary has the columns of shop_names.VOCABULARY. Longer phrases win at a place, then the slot that comes first, then the
    canonical name, id and phrase in code-point order. A phrase of an entity that is already found uses up its tokens; one of
    another entity for a slot of one value is ambiguous and stays in the expression (listed once a round). Vineyards of a producer
    count only with that producer, found in the name or given by the column `scope`. The expression is what is left without
    years, measures and noise; null if nothing is. Null and empty names have no tokens. All rows are kept; columns of names with
    the names of results are replaced.
    """
    results = ("tokens", "producer", "vineyard", "region", "style", "grapes", "vintage", "expression", "matches", "ambiguous")
    given = F.col(f"`{scope}`").cast("string") if scope else F.lit(None).cast("string")
    rows = names.withColumns({"_name": F.coalesce(F.col(f"`{name}`").cast("string"), F.lit("")), "_scope": F.coalesce(given, F.lit(""))})
    spark = names.sparkSession
    distinct = rows.select("_name", "_scope").distinct().repartition(tasks(spark), "_name", "_scope")
    once = written(distinct.withColumn("tokens", name_tokens(F.col("_name"))), "names")
    rank = F.array_position(F.array(*map(F.lit, SLOTS)), F.col("slot"))
    known = vocabulary.select("id", "slot", "canonical_name", "via_alias", "producer_id", "phrase", name_tokens(F.col("phrase")).alias("_tokens"))
    found = occurrences(once, "tokens", known, "_tokens")
    order = F.struct("start", (-F.col("n")).alias("less"), rank.alias("rank"), "canonical_name", "id", "phrase", "n", "slot", F.array_join("_tokens", " ").alias("matched"), "via_alias", "producer_id")
    listed = found.groupBy("_name", "_scope").agg(F.sort_array(F.collect_list(order)).alias("hits"))
    both = once.join(listed, ["_name", "_scope"], "left")
    t = F.col("tokens")
    number = lambda keep: F.filter(F.transform(t, lambda x, i: F.struct(i.alias("start"), F.lit(1).alias("n"), x.alias("token"))), lambda x: keep(x["token"]))
    taken = F.transform(number(lambda x: x.rlike(YEAR) | is_measure(x)), lambda x: F.struct(x["start"].alias("start"), x["n"].alias("n")))
    state = _fold(F.coalesce("hits", F.array()), taken, F.nullif(F.col("_scope"), F.lit("")))
    read = both.withColumn("_s", state)
    silent = F.array(*[F.lit(x) for x in noise]).cast("array<string>")
    left = F.filter(F.transform(t, lambda x, i: F.struct(x.alias("x"), i.alias("i"))), lambda x: ~F.exists("_s.taken", lambda k: (k.start <= x["i"]) & (x["i"] < k.start + k.n)) & ~F.array_contains(silent, x["x"]))
    out = read.select(
        "_name", "_scope", "tokens", *[F.col(f"_s.{s}").alias(s) for s in ("producer", "vineyard", "region", "style", "grapes")],
        F.get(F.filter(t, lambda x: x.rlike(YEAR)), F.lit(0)).cast("int").alias("vintage"), F.nullif(F.array_join(F.transform(left, lambda x: x["x"]), " "), F.lit("")).alias("expression"),
        F.array_sort("_s.matches").alias("matches"), F.col("_s.ambiguous").alias("ambiguous"),
    )
    return rows.drop(*results).join(written(out, "read"), ["_name", "_scope"]).drop("_name", "_scope")


def parse_wine_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = parse_names(shop_names.titles(spark, sf_dir), shop_names.vocabulary(spark, sf_dir))
    return out.select(
        "variant_id", "shop_id", "producer", "vineyard", "region", "style", F.array_join(F.array_sort("grapes"), "+").alias("grapes"), "vintage", "expression",
        F.array_join(F.transform("matches", lambda m: F.concat_ws(":", m["start"], m["n"], m["id"])), ",").alias("matches"), F.array_join(F.array_sort(F.transform("ambiguous", lambda m: m["id"])), ",").alias("ambiguous"),
    )


#: Titles, vocabulary and tokens by plain SQL; then each title's hits are walked one by one, with the used tokens as bits.
TITLES_SQL = r"""
letters AS (SELECT p_partkey, p_name, split_part(p_name, ' ', 1) AS first, split_part(p_name, ' ', -1) AS last, CAST(regexp_extract(p_brand, '[0-9]+$') AS INTEGER) AS n,
    chr(96 + CAST(regexp_extract(p_brand, '[0-9]+$') AS INTEGER)) AS letter, upper(p_type[1]) || lower(p_type[2:]) AS style FROM part),
written AS (
  SELECT variant_id, shop_id, CASE shop_id % 8
    WHEN 0 THEN 'Brand ' || letter || ' ' || p_name || ' ' || year || ' 0,75 l'
    WHEN 1 THEN upper(first[1]) || first[2:] || ' ' || upper(last[1]) || last[2:] || ', Brand ' || letter || ' - ' || year
    WHEN 2 THEN year || ' ' || letter || ' Brand ' || region || ' ' || last || ' ' || first || ' 750 ml 12,5%'
    WHEN 3 THEN 'Bränd ' || letter || ' ' || last || 's ' || style || ' Réserve ' || year
    WHEN 4 THEN 'Brand ' || letter || ' Brand ' || chr(96 + CAST(variant_id % 25 + 1 AS INTEGER)) || ' ' || p_name || ' 6x0,75l'
    WHEN 5 THEN region || ' ' || style || ' class ' || style || ' ' || p_name || ' Brand ' || letter || ' ' || year || ','
    WHEN 6 THEN p_name || ' ' || region || ' 1 palack'
    ELSE 'House of ' || letter || ' ' || last || ' &amp; widget ' || first || ' Old Cellar ' || year || ' ' || (2001 + variant_id % 12) END AS title
  FROM (SELECT DISTINCT l_partkey AS variant_id, l_suppkey AS shop_id, CAST(2000 + l_partkey % 12 AS VARCHAR) AS year FROM lineitem)
  JOIN letters ON p_partkey = variant_id JOIN supplier ON s_suppkey = shop_id JOIN nation ON n_nationkey = s_nationkey
  JOIN (SELECT r_regionkey, array_to_string(list_transform(string_split(lower(r_name), ' '), lambda w: upper(w[1]) || w[2:]), ' ') AS region FROM region) ON r_regionkey = n_regionkey),
"""
PHRASES_SQL = r"""
phrases AS (
  SELECT DISTINCT id, slot, rank, name, phrase, owner FROM (
    SELECT 'p-' || letter AS id, 'producer' AS slot, 1 AS rank, 'Brand ' || letter AS name, unnest(['brand ' || letter, letter || ' brand', 'house of ' || letter]) AS phrase, NULL AS owner FROM letters
    UNION ALL SELECT 'v-' || first || '-' || letter, 'vineyard', 2, upper(first[1]) || first[2:], first, 'p-' || letter FROM letters WHERE n % 2 = 0
    UNION ALL SELECT 'r-' || lower(r_name), 'region', 3, r_name, lower(r_name), NULL FROM region
    UNION ALL SELECT 'g-' || last, 'grape', 4, last, unnest([last, last || 's']), NULL FROM letters
    UNION ALL SELECT 's-' || lower(style), 'style', 5, lower(style), unnest([lower(style), lower(style) || ' class']), NULL FROM letters)),
"""
NAMES_SQL = TITLES_SQL + PHRASES_SQL
#: Needs written(title) and vocab.
WALK_SQL = r"""
parts AS (
  SELECT title, list_filter(list_transform(string_split(regexp_replace(lower(strip_accents(replace(title, '&amp;', '&'))), '[^a-z0-9%.,]+', ' ', 'g'), ' '),
    lambda x: CASE WHEN regexp_full_match(x, '[0-9.,%]+') THEN x ELSE trim(x, '.,') END), lambda x: x <> '') AS t FROM (SELECT DISTINCT title FROM written)),
places AS (SELECT title, t, unnest(range(1, len(t) + 1)) AS i FROM parts),
sizes AS (SELECT *, regexp_full_match(t[i], '(19|20)[0-9][0-9]') AS is_year,
    regexp_full_match(t[i], '[0-9]+([.,][0-9]+)?(ml|cl|dl|l|liter|litre|ltr)?|[0-9]+x[0-9]+([.,][0-9]+)?l?|ml|l|palack|[0-9]+([.,][0-9]+)?%') AS is_measure FROM places),
begun AS (SELECT title, CAST(coalesce(sum(1::BIGINT << (i - 1)) FILTER (WHERE is_year OR is_measure), 0) AS BIGINT) AS used, CAST(arg_min(t[i], i) FILTER (WHERE is_year) AS INTEGER) AS vintage FROM sizes GROUP BY title),
hits AS MATERIALIZED (
  SELECT p.title, p.i - 1 AS pos, len(v.w) AS n, v.* FROM places p JOIN (SELECT *, string_split(phrase, ' ') AS w FROM vocab) v ON v.w[1] = p.t[p.i] AND p.t[p.i : p.i + len(v.w) - 1] = v.w),
listed AS MATERIALIZED (
  SELECT *, (((1::BIGINT << n) - 1) << pos) AS own, row_number() OVER (PARTITION BY title ORDER BY round, pos, n DESC, rank, name, id, phrase) AS k
  FROM hits CROSS JOIN (SELECT unnest([1, 2]) AS round)),
walk AS (
  SELECT title, 0::BIGINT AS k, used, NULL::VARCHAR AS producer, NULL::VARCHAR AS vineyard, NULL::VARCHAR AS region, NULL::VARCHAR AS style, []::VARCHAR[] AS grapes, []::VARCHAR[] AS matches, []::VARCHAR[] AS ambiguous FROM begun
  UNION ALL
  SELECT title, k, CASE WHEN act IN ('take', 'again') THEN used | own ELSE used END,
    CASE WHEN act = 'take' AND slot = 'producer' THEN id ELSE producer END, CASE WHEN act = 'take' AND slot = 'vineyard' THEN id ELSE vineyard END,
    CASE WHEN act = 'take' AND slot = 'region' THEN id ELSE region END, CASE WHEN act = 'take' AND slot = 'style' THEN id ELSE style END,
    CASE WHEN act = 'take' AND slot = 'grape' THEN list_append(grapes, id) ELSE grapes END, CASE WHEN act = 'take' THEN list_append(matches, pos || ':' || n || ':' || id) ELSE matches END,
    CASE WHEN act = 'unclear' THEN list_append(ambiguous, id) ELSE ambiguous END
  FROM (
    SELECT w.title, h.k, w.used, w.producer, w.vineyard, w.region, w.style, w.grapes, w.matches, w.ambiguous, h.own, h.slot, h.id, h.pos, h.n,
      CASE WHEN h.round = 2 AND w.producer IS NULL OR h.owner IS NOT NULL AND (h.round = 1 OR h.owner <> w.producer) OR w.used & h.own <> 0 THEN 'skip'
        WHEN h.slot = 'grape' THEN CASE WHEN list_contains(w.grapes, h.id) THEN 'again' ELSE 'take' END
        WHEN CASE h.slot WHEN 'producer' THEN w.producer WHEN 'vineyard' THEN w.vineyard WHEN 'region' THEN w.region ELSE w.style END = h.id THEN 'again'
        WHEN CASE h.slot WHEN 'producer' THEN w.producer WHEN 'vineyard' THEN w.vineyard WHEN 'region' THEN w.region ELSE w.style END IS NOT NULL THEN 'unclear' ELSE 'take' END AS act
    FROM walk w JOIN listed h ON h.title = w.title AND h.k = w.k + 1)),
last AS (SELECT *, row_number() OVER (PARTITION BY title ORDER BY k DESC) AS z FROM walk),
rest AS (SELECT s.title, string_agg(s.t[s.i], ' ' ORDER BY s.i) FILTER (WHERE l.used & (1::BIGINT << (s.i - 1)) = 0) AS expression FROM sizes s JOIN last l ON l.title = s.title AND l.z = 1 GROUP BY s.title)
"""
ORACLE = rf"""
WITH RECURSIVE {NAMES_SQL} vocab AS (SELECT * FROM phrases), {WALK_SQL}
SELECT variant_id, shop_id, producer, vineyard, region, style, array_to_string(list_sort(grapes), '+') AS grapes, vintage, expression,
  array_to_string(list_transform(list_sort(list_transform(matches, lambda m: [lpad(split_part(m, ':', 1), 3, '0'), m])), lambda m: m[2]), ',') AS matches, array_to_string(list_sort(ambiguous), ',') AS ambiguous
FROM written JOIN last USING (title) JOIN begun USING (title) JOIN rest USING (title) WHERE z = 1"""

QUERIES = {"parse_wine_name": parse_wine_name}
ORACLES = {"parse_wine_name": ORACLE}
