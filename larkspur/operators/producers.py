"""Producers that the vocabulary doesn't know yet: candidates from what is left of names, and groups of names to merge.

Candidates are n-grams at the beginning of a residue, or from or up to a marker; they are counted by (name, shop) first, so that a
frequent one never gathers in one task. A name within another is found by joining the edges of the longer names, three on
either side at most, with the names. Groups are aggregates by merge key; the prefix test is one of each member against the
shortest, by a join, so that a key may have any number of members.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from larkspur.functions import text
from larkspur.operators.vocabulary import PHRASES_SQL, TITLES_SQL, WALK_SQL, parse_names
from larkspur.shared import tasks, written
from larkspur.sources import shop_names

# Words that begin a producer's name, or end it, in mining.
PREFIXES = """chateau domaine maison clos cave caves mas closerie bodega bodegas quinta herdade finca vina celler casa tenuta tenute castello cantina
cantine podere poderi fattoria azienda villa ca weingut weinhaus schloss""".split()
SUFFIXES = """pince pinceszet boraszat borbirtok birtok szolobirtok kuria major borhaz pinceszete csalad fiai winery estate vineyard vineyards cellars
cellar""".split()
# Words that begin no producer's name: of trade, quality, spirits, and general ones.
STOPWORDS = """akcio akcios ajandek ajandekutalvany diszdoboz diszdobozban csomag valogatas valogatott szett karton uj ujdonsag kedvenc ajanlat ajanlott top
best sale outlet premium reserve reserva riserva special selection limited edition classic grand gran superior extra imperial royal exclusive prestige vintage
old fine rare whisky whiskey rum gin vodka tequila cognac brandy likor palinka sake mezcal bourbon scotch malt single blended cask barrel oak distillery proof
the and with von van del della des les la le eves ev years year anos ans db liter bor wine organic bio natur natural mini nagy kis big""".split()
# Words of wine in mining, connectors that no name begins or ends with, and first names.
WINE_WORDS = """pezsgo pezsgok gyongyozo habzobor brut sec demi doux dosage prosecco cava cremant sekt spumante frizzante franciacorta asti lambrusco petnat
puttonyos puttony aszu szamorodni edes szaraz felszaraz feledes esszencia forditas maslas jegbor voros vorosbor feher feherbor rose roze siller narancsbor
cuvee kuve birtokbor dulo muzeum muzealis barrique tannin""".split()
CONNECTORS = """de du des da do della dell del di dei la le les los las el il al au aux a d es and und von van zu of y e i""".split()
FIRST_NAMES = """attila andras andrea anna antal arpad balazs bela bence csaba daniel david dezso endre erik erzsebet ferenc frigyes gabor gabriella gergely
geza gyorgy gyula imre istvan ivan janos jozsef judit julia kalman karoly katalin krisztian laszlo lajos levente lorinc marton maria mihaly miklos norbert otto
pal peter robert sandor stephanie szabolcs tamas tibor tivadar viktor vilmos zoltan zsolt zsuzsanna akos adam aron barnabas donat elemer gaspar hunor kristof
marcell mate olivier richard roland sarolta tas vince""".split()
# Fixed values, of merging: markers, legal forms and words of wine there.
MERGE_PREFIXES = """chateau domaine maison clos cave caves mas bodega bodegas quinta herdade finca vina celler casa tenuta tenute castello cantina cantine podere
poderi fattoria azienda villa weingut weinhaus schloss""".split()
MERGE_SUFFIXES = """pince pinceszet pinceszete boraszat boraszata borbirtok birtok szolobirtok szoloszet kuria major borhaz csalad fiai tarsa winery estate
vineyard vineyards cellars cellar wines wine""".split()
LEGAL_FORMS = "kft zrt bt nyrt kkt gmbh srl spa sarl ltd llc inc bv nv ag".split()
MERGE_WINE_WORDS = """brut extra dry sec demi doux nature zero dosage blanc blancs noirs cuvee pezsgo rose puttonyos puttony aszu szamorodni edes feledes szaraz
felszaraz esszencia forditas maslas voros feher siller red white premium reserve reserva riserva selection valogatas limited edition grand gran classic special
prestige birtokbor dulo vintage""".split()
# Least listings and shops of a candidate, length of the list, examples kept.
LEAST_COUNT, LEAST_SHOPS, LIMIT, EXAMPLES = 3, 2, 300, 3
NUMBER = r"^[0-9.,%]+$"

CANDIDATE = "struct<name:string,leading:boolean,marker:boolean>"


def candidate_names(residue: Column) -> Column:
    """Structs (name, leading, marker) of the candidates in an array of tokens, each name once."""
    m = F.size(residue)
    noise = lambda t: (F.length(t) < 2) | t.rlike(NUMBER) | t.isin(STOPWORDS) | t.isin(WINE_WORDS)

    def fits(parts: Column) -> Column:
        first, last = F.get(parts, F.lit(0)), F.get(parts, F.size(parts) - 1)
        return ~noise(first) & ~F.exists(parts, lambda t: t.rlike(NUMBER)) & ~first.isin(CONNECTORS) & ~last.isin(CONNECTORS) & ~F.forall(parts, lambda t: t.isin(PREFIXES + SUFFIXES + CONNECTORS))

    def made(start: Column, n: Column, marker: bool) -> Column:
        return F.struct(F.slice(residue, start + 1, n).alias("parts"), (start == 0).alias("leading"), F.lit(marker).alias("marker"))

    places = F.sequence(F.lit(0), F.greatest(m - 1, F.lit(0)))
    lengths = lambda least, most: F.filter(F.sequence(F.lit(least), F.lit(4)), lambda n: n <= most)
    leading = F.transform(F.filter(F.array(*map(F.lit, (1, 2, 3))), lambda n: n <= m), lambda n: made(F.lit(0), n, False))
    ahead = F.flatten(F.transform(F.filter(places, lambda i: F.coalesce(F.get(residue, i).isin(PREFIXES), F.lit(False))), lambda i: F.transform(lengths(2, m - i), lambda n: made(i, n, True))))
    behind = F.flatten(F.transform(F.filter(places, lambda i: F.coalesce(F.get(residue, i).isin(SUFFIXES), F.lit(False))), lambda i: F.transform(lengths(2, i + 1), lambda n: made(i - n + 1, n, True))))
    every = F.transform(F.filter(F.concat(leading, ahead, behind), lambda c: fits(c.parts)), lambda c: F.struct(F.array_join(c.parts, " ").alias("name"), c.leading.alias("leading"), c.marker.alias("marker")))
    names = F.array_distinct(F.transform(every, lambda c: c["name"]))
    own = lambda n, flag: F.exists(every, lambda c: (c["name"] == n) & c[flag])
    return F.transform(names, lambda n: F.struct(n.alias("name"), own(n, "leading").alias("leading"), own(n, "marker").alias("marker")))


def is_person(name: Column) -> Column:
    """Two tokens, of which the second alone is a first name."""
    parts = F.split(name, " ")
    return (F.size(parts) == 2) & F.get(parts, F.lit(1)).isin(FIRST_NAMES) & ~F.get(parts, F.lit(0)).isin(FIRST_NAMES)


def within_others(candidates: DataFrame) -> DataFrame:
    """Names that go because another contains them at an edge, or they another: name.

    The shorter of two with equal counts goes: it never stands for itself. The longer goes if all it has more are words of wine.
    """
    t = F.split("name", " ")
    cuts = F.sequence(F.lit(1), F.size(t) - 1)
    edges = F.array_distinct(F.concat(F.transform(cuts, lambda n: F.array_join(F.slice(t, F.lit(1), n), " ")), F.transform(cuts, lambda n: F.array_join(F.slice(t, n + 1, F.size(t)), " "))))
    longer = candidates.select("name", "count").where(F.size(t) > 1).select(F.col("name").alias("long"), F.col("count").alias("long_count"), F.explode(edges).alias("name"))
    met = longer.join(candidates.select("name", "count"), "name")
    extra = F.array_except(F.split("long", " "), t)
    words = (F.size(extra) > 0) & F.forall(extra, lambda x: x.isin(WINE_WORDS))
    return met.select(F.when(F.col("count") == F.col("long_count"), F.col("name")).when(words, F.col("long")).alias("name")).where("name IS NOT NULL").distinct()


def mine_producers(rows: DataFrame, *, shop: str = "shop_id", name: str = "title", residue: str = "residue", least_count: int = LEAST_COUNT, least_shops: int = LEAST_SHOPS, limit: int | None = LIMIT) -> DataFrame:
    """name, count, shops, leading, has_marker, person_name, score, examples, rank: the best candidates, for people to approve.

    residue: what is left of a name, an array of tokens in their order. A candidate is in least_count rows; it is in least_shops
    shops or has a marker in some row. Examples are the first EXAMPLES names in code-point order. Ranks are by score, count, name.
    Null residues count as empty; null shops are no shop. limit None returns all.
    """
    given = rows.select(F.col(f"`{shop}`").alias("shop"), F.col(f"`{name}`").alias("raw"), F.filter(F.coalesce(F.col(f"`{residue}`"), F.array().cast("array<string>")), lambda t: t != "").alias("residue"))
    # each residue is taken apart once, however many rows have it
    distinct = given.select("residue").distinct().repartition(tasks(rows.sparkSession), "residue")
    mined = written(distinct.select("residue", candidate_names(F.col("residue")).alias("c")).where(F.size("c") > 0), "mined")
    kept = given.join(mined, "residue").select("shop", F.explode("c").alias("c")).select("shop", "c.*")
    by_shop = kept.groupBy("name", "shop").agg(F.count("*").alias("n"), F.sum(F.col("leading").cast("long")).alias("leading"), F.max("marker").alias("marker"))
    counted = by_shop.groupBy("name").agg(F.sum("n").alias("count"), F.count("shop").alias("shops"), F.sum("leading").alias("leading"), F.max("marker").alias("has_marker"))
    counted = counted.where((F.col("count") >= least_count) & (F.col("has_marker") | (F.col("shops") >= least_shops)))
    person = is_person(F.col("name"))
    score = F.when(F.col("has_marker"), 5).otherwise(0) + F.least("shops", F.lit(5)) * 1.5 + F.log10(F.col("count") + 1) * 1.5 + F.col("leading") / F.col("count") * 2 + F.when(person, 1.5).otherwise(0)
    scored = written(counted.withColumns({"person_name": person, "score": F.floor(score * 100 + 0.5) / 100}), "scored")
    left = scored.join(within_others(scored), "name", "left_anti")
    if limit is not None:
        left = written(left.orderBy(F.desc("score"), F.desc("count"), "name").limit(limit), "best")
    shown = given.select("raw", "residue").distinct().join(mined, "residue").select("raw", F.explode("c.name").alias("name"))
    seen = shown.join(left.select("name"), "name", "left_semi").select("name", "raw").distinct()
    first = seen.withColumn("k", F.row_number().over(Window.partitionBy("name").orderBy("raw"))).where(F.col("k") <= EXAMPLES)
    shown = first.groupBy("name").agg(F.sort_array(F.collect_list("raw")).alias("examples"))
    out = left.join(shown, "name", "left")
    if limit is not None:
        out = out.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), F.desc("count"), "name")))  # limit rows at most
    return out


def merge_tokens(name: Column) -> Column:
    return F.filter(F.transform(text.tokens(text.search_norm(name)), lambda t: F.regexp_replace(t, r"^[.,]+|[.,]+$", "")), lambda t: t != "")


def merge_key(name: Column) -> Column:
    """The first token that says who the producer is, with the next one after a marker; empty if there is none."""
    return _key(merge_tokens(name))


def _key(tokens: Column) -> Column:
    own = F.filter(tokens, lambda t: ~t.isin(MERGE_SUFFIXES + LEGAL_FORMS + MERGE_WINE_WORDS) & ~t.rlike(NUMBER) & (F.length(t) > 1))
    return F.when(F.size(own) == 0, "").when(F.get(own, F.lit(0)).isin(MERGE_PREFIXES), F.array_join(F.slice(own, F.lit(1), F.lit(2)), " ")).otherwise(F.get(own, F.lit(0)))


def full_key(name: Column) -> Column:
    return _full(merge_tokens(name))


def _full(tokens: Column) -> Column:
    return F.array_join(F.filter(tokens, lambda t: ~t.isin(MERGE_SUFFIXES + LEGAL_FORMS) & ~t.rlike(NUMBER)), " ")


def extra_kind(extra: Column) -> Column:
    """none, marker, wine_term or other: what kind of words a name has beside its group's key."""
    return F.when(F.size(extra) == 0, "none").when(F.forall(extra, lambda t: t.isin(MERGE_SUFFIXES + LEGAL_FORMS + MERGE_PREFIXES)), "marker").when(F.forall(extra, lambda t: t.isin(MERGE_WINE_WORDS)), "wine_term").otherwise("other")


def merge_groups(producers: DataFrame) -> DataFrame:
    """A row for each producer that shares its merge key with another: key, kind, confidence, n_members, n_linked, person_warning,
    active_warning, keep_id, id, extra, extra_kind, alias_useful, action.

    producers: id, canonical_name, status, linked_listings, candidate_score, person_name, fuzzy_blocked. Merged and retired ones are
    left out, and names without a key. kind: prefix if every member's full name begins with the shortest one's, else token;
    confidence is high for a prefix group without warnings. The survivor is active, has most listings, fewest tokens, the
    greatest score, then the least id. Nulls count as 0 and false.
    """
    c = F.col
    named = producers.where("status IS NULL OR status NOT IN ('merged', 'retired')").repartition(tasks(producers.sparkSession))
    read = named.withColumn("tokens", merge_tokens(c("canonical_name"))).select(
        "id", "status", F.coalesce("linked_listings", F.lit(0)).alias("linked"), F.coalesce("candidate_score", F.lit(0.0)).alias("candidate_score"),
        (F.coalesce("person_name", F.lit(False)) | F.coalesce("fuzzy_blocked", F.lit(False))).alias("person"), "tokens", _key(c("tokens")).alias("key"), _full(c("tokens")).alias("full"),
    )
    rows = written(read, "producers").where("key <> ''")  # names are read once, not for each aggregate and join
    active = F.coalesce(c("status") == "active", F.lit(False))
    survivor = F.min(F.struct((~active).alias("a"), (-c("linked")).alias("b"), F.size("tokens").alias("n"), (-c("candidate_score")).alias("s"), "id"))
    groups = rows.groupBy("key").agg(
        F.count("*").alias("n_members"), F.sum("linked").alias("n_linked"), F.max("person").alias("person_warning"), F.sum(active.cast("int")).alias("actives"),
        survivor["id"].alias("keep_id"), F.min(F.struct(F.length("full").alias("n"), "full"))["full"].alias("shortest"),
    ).where("n_members > 1")
    both = rows.join(groups, "key")
    begins = (c("full") == c("shortest")) | F.startswith("full", F.concat("shortest", F.lit(" ")))
    odd = both.where(~begins).select("key").distinct().withColumn("odd", F.lit(True))
    extra = F.filter(c("tokens"), lambda t: ~F.array_contains(F.split("key", " "), t) & ~t.rlike(NUMBER))
    out = both.join(odd, "key", "left").withColumns({"extra": extra, "kind": F.when(c("odd"), "token").otherwise("prefix"), "active_warning": c("actives") > 1})
    out = out.withColumn("extra_kind", extra_kind(c("extra")))
    useful = c("extra_kind").isin("marker", "none")
    action = F.when(c("id") == c("keep_id"), "keep").when(c("person"), "separate").when(useful | (c("linked") > 0), "merge").otherwise("discard")
    sure = (c("kind") == "prefix") & ~c("person_warning") & ~c("active_warning")
    return out.select("key", "kind", F.when(sure, "high").otherwise("medium").alias("confidence"), "n_members", "n_linked", "person_warning", "active_warning", "keep_id", "id", "extra", "extra_kind", useful.alias("alias_useful"), action.alias("action"))


# --- queries ---


def producer_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Titles in which half of the brands are estates, and cellars are wineries or brut."""
    title = F.when(F.col("variant_id") % 2 == 0, F.replace("title", F.lit("Brand "), F.lit("Chateau "))).otherwise(F.col("title"))
    title = F.when(F.col("variant_id") % 3 == 0, F.replace(title, F.lit("Old Cellar"), F.lit("Pince"))).otherwise(F.replace(title, F.lit("Old Cellar"), F.lit("Brut")))
    return shop_names.titles(spark, sf_dir).withColumn("title", title)


def producer_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All titles read with a vocabulary that has no producers, and what is left of them mined."""
    known = shop_names.vocabulary(spark, sf_dir).where("slot <> 'producer'")
    read = parse_names(producer_titles(spark, sf_dir), known)
    out = mine_producers(read.select("shop_id", "title", F.split("expression", " ").alias("residue")))
    return out.select("rank", "name", "count", "shops", F.col("leading").alias("n_leading"), "has_marker", "person_name", F.round("score", 2).alias("score"), F.array_join("examples", "|").alias("examples"))


def producer_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A producer for each customer; names, states and weights by rules of the customer's number."""
    k, seg = F.col("c_custkey"), F.initcap("c_mktsegment")
    base = F.when(k % 5 == 0, F.concat(F.lit("Château "), F.translate(F.lower((k % 37).cast("string")), "0123456789", "abcdefghij"), F.lit("x "), seg)).otherwise(F.concat(F.translate((F.floor(k / 6)).cast("string"), "0123456789", "klmnopqrst"), F.lit("ő")))
    name = F.concat_ws(" ", base, F.when(k % 6 == 1, "Pince").when(k % 6 == 2, "Brut").when(k % 6 == 3, seg).when(k % 6 == 4, "Attila Kft.").when(k % 6 == 5, "1999 Winery,"))
    status = F.when(k % 11 == 0, "merged").when(k % 4 == 0, "active").otherwise("candidate")
    return spark.read.parquet(f"{sf_dir}/customer.parquet").select(k.alias("id"), name.alias("canonical_name"), status.alias("status"), (k % 7 % 3).alias("linked_listings"), (k % 13 / 2).alias("candidate_score"), (k % 6 == 4).alias("person_name"), (k % 50 == 1).alias("fuzzy_blocked"))


def producer_merge_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merge_groups(producer_rows(spark, sf_dir)).withColumn("extra", F.array_join("extra", " "))


QUERIES = {"producer_candidates": producer_candidates, "producer_merge_groups": producer_merge_groups}


def _in(words: list[str]) -> str:
    return "(" + ", ".join(f"'{w}'" for w in words) + ")"


#: Every window of up to four words of each residue, kept by what it begins or ends with; containment by all pairs of names.
_MINED = rf"""
WITH RECURSIVE {TITLES_SQL.replace("written AS (", "plain AS (")}
{PHRASES_SQL}
written AS (
  SELECT variant_id, shop_id, CASE WHEN variant_id % 3 = 0 THEN replace(t, 'Old Cellar', 'Pince') ELSE replace(t, 'Old Cellar', 'Brut') END AS title
  FROM (SELECT *, CASE WHEN variant_id % 2 = 0 THEN replace(title, 'Brand ', 'Chateau ') ELSE title END AS t FROM plain)),
vocab AS (SELECT * FROM phrases WHERE slot <> 'producer'), {WALK_SQL},
left_over AS (SELECT variant_id, shop_id, title, string_split(expression, ' ') AS t FROM written JOIN rest USING (title) WHERE expression IS NOT NULL),
spans AS (SELECT *, unnest([1, 2, 3, 4]) AS n FROM (SELECT *, unnest(range(1, len(t) + 1)) AS i FROM left_over)),
grams AS (SELECT variant_id, shop_id, title, i, n, t[i : i + n - 1] AS p, array_to_string(t[i : i + n - 1], ' ') AS name FROM spans WHERE i + n - 1 <= len(t)),
marked AS (SELECT *, n > 1 AND (p[1] IN {_in(PREFIXES)} OR p[n] IN {_in(SUFFIXES)}) AS marker FROM grams),
fit AS (
  SELECT * FROM marked WHERE (marker OR i = 1 AND n < 4) AND length(p[1]) > 1 AND p[1] NOT IN {_in(STOPWORDS)} AND p[1] NOT IN {_in(WINE_WORDS)} AND NOT regexp_matches(name, '(^| )[0-9.,%]+( |$)')
    AND p[1] NOT IN {_in(CONNECTORS)} AND p[n] NOT IN {_in(CONNECTORS)} AND len(list_filter(p, lambda w: w NOT IN {_in(PREFIXES + SUFFIXES + CONNECTORS)})) > 0),
once AS (SELECT variant_id, shop_id, title, name, max(i = 1) AS leads, max(marker) AS marker FROM fit GROUP BY ALL),
counted AS (
  SELECT name, count(*) AS count, count(DISTINCT shop_id) AS shops, sum(CASE WHEN leads THEN 1 ELSE 0 END) AS n_leading, max(marker) AS has_marker, list_sort(list(DISTINCT title))[1:3] AS examples
  FROM once GROUP BY name HAVING count(*) >= 3 AND (max(marker) OR count(DISTINCT shop_id) >= 2)),
pairs AS (SELECT a.name AS short, b.name AS long, a.count = b.count AS equal, string_split(a.name, ' ') AS s, string_split(b.name, ' ') AS l
  FROM counted a JOIN counted b ON a.name <> b.name AND (starts_with(b.name, a.name || ' ') OR suffix(b.name, ' ' || a.name))),
gone AS (SELECT short AS name FROM pairs WHERE equal UNION SELECT long FROM pairs
  WHERE NOT equal AND len(list_filter(l, lambda w: NOT list_contains(s, w))) > 0 AND len(list_filter(l, lambda w: NOT list_contains(s, w) AND w NOT IN {_in(WINE_WORDS)})) = 0),
scored AS (
  SELECT *, regexp_matches(name, '^[^ ]+ ({"|".join(FIRST_NAMES)})$') AND NOT regexp_matches(name, '^({"|".join(FIRST_NAMES)}) ') AS person_name FROM counted WHERE name NOT IN (SELECT name FROM gone)),
ranked AS (
  SELECT *, floor(100 * (CASE WHEN has_marker THEN 5 ELSE 0 END + least(shops, 5) * 1.5::DOUBLE + log10(count + 1) * 1.5::DOUBLE + n_leading / count * 2::DOUBLE + CASE WHEN person_name THEN 1.5::DOUBLE ELSE 0 END) + 0.5) / 100 AS score FROM scored)
SELECT * FROM (SELECT CAST(row_number() OVER (ORDER BY score DESC, count DESC, name) AS INTEGER) AS rank, name, count, shops, CAST(n_leading AS BIGINT) AS n_leading, has_marker, person_name, round(score, 2) AS score, array_to_string(examples, '|') AS examples FROM ranked) WHERE rank <= 300"""
_GROUPED = rf"""
WITH named AS (
  SELECT c_custkey AS id, concat_ws(' ', CASE WHEN c_custkey % 5 = 0 THEN 'Château ' || translate(CAST(c_custkey % 37 AS VARCHAR), '0123456789', 'abcdefghij') || 'x ' || c_mktsegment[1] || lower(c_mktsegment[2:])
      ELSE translate(CAST(c_custkey // 6 AS VARCHAR), '0123456789', 'klmnopqrst') || 'ő' END,
    CASE c_custkey % 6 WHEN 1 THEN 'Pince' WHEN 2 THEN 'Brut' WHEN 3 THEN c_mktsegment[1] || lower(c_mktsegment[2:]) WHEN 4 THEN 'Attila Kft.' WHEN 5 THEN '1999 Winery,' END) AS name,
    c_custkey % 4 = 0 AS active, c_custkey % 7 % 3 AS linked, c_custkey % 13 / 2 AS score, c_custkey % 6 = 4 OR c_custkey % 50 = 1 AS person
  FROM customer WHERE c_custkey % 11 <> 0),
worded AS (SELECT *, list_filter(list_transform(string_split(regexp_replace(lower(strip_accents(name)), '[^a-z0-9%.,]+', ' ', 'g'), ' '), lambda w: trim(w, '.,')), lambda w: w <> '') AS t FROM named),
cored AS (SELECT *, list_filter(t, lambda w: w NOT IN {_in(MERGE_SUFFIXES + LEGAL_FORMS)} AND NOT regexp_full_match(w, '[0-9.,%]+')) AS f FROM worded),
own AS (SELECT *, list_filter(f, lambda w: w NOT IN {_in(MERGE_WINE_WORDS)} AND length(w) > 1) AS o FROM cored),
keyed AS (SELECT *, array_to_string(f, ' ') AS complete, CASE WHEN o[1] IN {_in(MERGE_PREFIXES)} THEN array_to_string(o[1:2], ' ') ELSE o[1] END AS key FROM own WHERE len(o) > 0),
members AS (
  SELECT *, count(*) OVER w AS n_members, CAST(sum(linked) OVER w AS BIGINT) AS n_linked, bool_or(person) OVER w AS person_warning, sum(CASE WHEN active THEN 1 ELSE 0 END) OVER w > 1 AS active_warning,
    first_value(id) OVER (PARTITION BY key ORDER BY active DESC, linked DESC, len(t), score DESC, id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS keep_id,
    first_value(complete) OVER (PARTITION BY key ORDER BY length(complete), complete ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS shortest
  FROM keyed WINDOW w AS (PARTITION BY key)),
kinds AS (SELECT *, CASE WHEN bool_and(complete = shortest OR starts_with(complete, shortest || ' ')) OVER (PARTITION BY key) THEN 'prefix' ELSE 'token' END AS kind,
    list_filter(t, lambda w: NOT list_contains(string_split(key, ' '), w) AND NOT regexp_full_match(w, '[0-9.,%]+')) AS extra FROM members WHERE n_members > 1),
classed AS (SELECT *, CASE WHEN len(extra) = 0 THEN 'none' WHEN len(list_filter(extra, lambda w: w NOT IN {_in(MERGE_SUFFIXES + LEGAL_FORMS + MERGE_PREFIXES)})) = 0 THEN 'marker'
    WHEN len(list_filter(extra, lambda w: w NOT IN {_in(MERGE_WINE_WORDS)})) = 0 THEN 'wine_term' ELSE 'other' END AS extra_kind FROM kinds)
SELECT key, kind, CASE WHEN kind = 'prefix' AND NOT person_warning AND NOT active_warning THEN 'high' ELSE 'medium' END AS confidence, n_members, n_linked, person_warning, active_warning, keep_id, id,
  array_to_string(extra, ' ') AS extra, extra_kind, extra_kind IN ('none', 'marker') AS alias_useful,
  CASE WHEN id = keep_id THEN 'keep' WHEN person THEN 'separate' WHEN extra_kind IN ('none', 'marker') OR linked > 0 THEN 'merge' ELSE 'discard' END AS action
FROM classed"""
ORACLES = {"producer_candidates": _MINED, "producer_merge_groups": _GROUPED}
