"""Mixing sources to target weights, by a low-discrepancy schedule of slots.

Each source's documents are put in the order of a hash and cut into blocks of equally many words; a block may end inside a
document. Slot k of the mix belongs to the source in whose share of the cumulative weights the k-th golden-ratio point lies,
k G mod 2^31 with G the odd number nearest to 2^31 / phi, so that any stretch of slots has every source near its share. The
slots of a source are ranked, and the r-th takes the source's r-th block: block after block in an order of its own for each
epoch (a multiple of a prime, modulo the number of blocks), the short block at the end of the stream last.

A source ends when it has given its target, a whole number of words: the last slot takes a part of its block, and slots beyond
are left out. The points differ from the shares by some slots (their discrepancy, of the order of the logarithm); blocks that
are still wanted then get slots at their proportional places, so what is taken equals the targets rounded to words.

Prefix sums over documents, ranks of sources and ranks of slots are sums over ranges (common.running), so that no source is
ever in one task; a block's words and its slot meet by (source, rank), keys of one block each.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larkspur.llm.common import running, written

WORD = r"[^\x20\x09-\x0D]+"
#: A source gives at most so many times its words.
REPEATS = 3
BLOCK_WORDS = 1024
_BITS, _CELL_BITS = 31, 15
#: The odd number nearest to 2^31 / phi.
GOLDEN = 1_327_217_885
#: The largest primes below 2^31, the steps of the first, second, ... epoch. Fixed values.
STEPS = (2_147_483_647, 2_147_483_629, 2_147_483_587, 2_147_483_579, 2_147_483_563, 2_147_483_549)


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sized: DataFrame, weights: Sequence[float], *, repeats: int = REPEATS, block_words: int = BLOCK_WORDS) -> DataFrame:
    """For each source: number (from 0), source_size, target, wanted (the target in whole words), low and high (its share of all
    targets, in 2^31sts), blocks, and slots (how many it wants). sized has source and size.

    Sources by code point, null last, have the weights in turn. A source's target is its weight's share of all words, but
    repeats times its own words at most; what is over goes to the others by weight until none is above. In the order of words a
    weight, a source is above if repeats times its words a weight are fewer than the rest of the words for the rest of the weights.
    """
    sources = sized.groupBy("source").agg(F.sum("size").alias("source_size")).withColumn("last", F.col("source").isNull())
    ranked = running(sources, ["last", "source"], {"number": F.lit(1)})
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("number") % len(weights) + 1).cast("int"))
    ranked = ranked.withColumn("weight", weight).withColumn("level", F.col("source_size") / F.col("weight"))
    # weights are summed in millionths, as whole numbers
    micro, total = F.round(F.col("weight") * 1_000_000), ranked.agg(F.sum("source_size"), F.sum(F.round(F.col("weight") * 1_000_000).cast("long"))).first()
    words, all_weights = total[0] or 0, total[1] or 0
    filled = running(ranked, ["level", "number"], {"before": F.col("source_size") * repeats, "weights": micro})
    rest, share = (F.lit(words) - F.col("before")).cast("double"), micro / (F.lit(all_weights) - F.col("weights"))
    above = F.col("source_size") * repeats < share * rest
    split = filled.withColumn("above", above)
    free = split.where(~above).agg(F.sum(micro.cast("long")), F.min("before")).first()
    free_weights, kept_words = free[0] or 1, words - (free[1] or 0)
    target = F.when(F.col("above"), F.col("source_size").cast("double") * repeats).otherwise(micro * F.lit(float(kept_words)) / F.lit(float(free_weights)))
    wanted = F.least(F.round(target).cast("long"), F.col("source_size") * repeats)
    plan = running(split.withColumn("target", target).withColumn("wanted", wanted), ["number"], {"given": F.col("wanted")})
    scale = float(1 << _BITS) / max(1, words)
    low, high = F.floor(F.col("given") * scale).cast("long"), F.floor((F.col("given") + F.col("wanted")) * scale).cast("long")
    blocks = F.ceil(F.col("source_size") / block_words).cast("long")
    epochs = F.when(F.col("source_size") > 0, F.expr("wanted div greatest(source_size, 1)")).otherwise(0).cast("long")
    over = F.col("wanted") - epochs * F.col("source_size")
    return plan.select("source", "number", "source_size", "target", "wanted", low.alias("low"), high.alias("high"), blocks.alias("blocks"), (epochs * blocks + F.ceil(over / block_words).cast("long")).alias("slots"))


def schedule(plan: DataFrame, words: int, *, block_words: int = BLOCK_WORDS) -> DataFrame:
    """Slots: number (of the source), rank (of the slot among the source's, from 0), place (in the mix), n (words it takes).

    A source whose points are fewer than the slots it wants has the others at their proportional places.
    """
    spark, n = plan.sparkSession, -(-words // block_words)
    k = F.col("id")
    # both factors are below 2^31
    points = spark.range(n).select(k.alias("place"), (k % (1 << _BITS) * GOLDEN % (1 << _BITS)).alias("point"))
    points = points.withColumn("cell", F.shiftright("point", _BITS - _CELL_BITS))
    shares = plan.where("high > low").select("number", "low", "high", F.explode(F.sequence(F.shiftright("low", _BITS - _CELL_BITS), F.shiftright(F.col("high") - 1, _BITS - _CELL_BITS))).alias("cell"))
    given = points.join(shares, "cell").where("point >= low AND point < high").select("number", "place")
    ranked = running(given, ["place"], {"rank": F.lit(1)}, group=("number",))
    have = ranked.groupBy("number").agg(F.count("*").alias("have"))
    left = plan.join(have, "number", "left").withColumn("have", F.coalesce("have", F.lit(0))).where("have < slots")
    late = left.select("number", F.explode(F.sequence("have", F.col("slots") - 1)).alias("rank"), "slots").select("number", F.floor((F.col("rank") + 0.5) / F.col("slots") * n).cast("long").alias("place"), "rank")
    met = ranked.unionByName(late).join(plan.select("number", "source_size", "wanted", "blocks", "slots"), "number").where("rank < slots")
    done = F.expr("(rank div blocks) * source_size") + F.least(F.col("rank") % F.col("blocks") * block_words, F.col("source_size"))
    return met.select("number", "rank", "place", F.least(F.lit(block_words).cast("long"), F.col("wanted") - done).alias("n"))


def visits(pieces: DataFrame, *, block_words: int = BLOCK_WORDS) -> DataFrame:
    """A row for each piece and epoch, with the rank of the slot at which its block comes."""
    full = F.expr(f"source_size div {block_words}")
    step = F.element_at(F.array(*[F.lit(s) for s in STEPS]), (F.col("epoch") % len(STEPS) + 1).cast("int"))
    wide = "decimal(38,0)"
    turn = (F.col("block").cast(wide) * step.cast(wide) % F.greatest(full, F.lit(1)).cast(wide)).cast("long")
    epochs = F.sequence(F.lit(0).cast("long"), F.expr("(slots - 1) div blocks"))
    return pieces.withColumn("epoch", F.explode(epochs)).withColumn("rank", F.col("epoch") * F.col("blocks") + F.when(F.col("block") < full, turn).otherwise(F.col("block")))


def mix(docs: DataFrame, weights: Sequence[float], *, doc_id: str = "doc_id", text: str = "text", source: str = "source", repeats: int = REPEATS, block_words: int = BLOCK_WORDS) -> tuple[DataFrame, DataFrame]:
    """(pieces, documents): the mix, and what it takes of each document.

    pieces: place (slots in the order of the mix), source, epoch, doc_id, start (where the document is in its source's stream, its
    key there), first and n (which of the document's words, from 0). documents: doc_id, source, size, source_size, target, taken.
    A row of docs is a document, repeated ids and repeated rows too. Null and empty texts have no words and are in documents only;
    a null source is a source; an empty table gives no rows. Order and result depend on ids and texts alone, not on partitions;
    rows that are equal in both are in any order. Other columns are ignored.
    """
    if repeats > len(STEPS):
        raise ValueError(f"at most {len(STEPS)} repeats")
    i, t = F.col(f"`{doc_id}`"), F.col(f"`{text}`").cast("string")
    # md5 is what SQL engines share
    key = F.md5(F.concat(F.coalesce(i.cast("string"), F.lit("")), F.lit(" "), F.coalesce(t, F.lit(""))).cast("binary"))
    # written first: dealing by ranges reads its input twice, and texts are to be read once
    sized = written(docs.select(i.alias("doc_id"), F.col(f"`{source}`").cast("string").alias("source"), word_count(t).alias("size"), key.alias("key")), "sized")
    streams = written(running(sized, ["key"], {"start": F.col("size")}, group=("source",)), "streams")
    plan = written(targets(streams, weights, repeats=repeats, block_words=block_words), "targets")
    words = streams.agg(F.sum("size")).first()[0] or 0
    slots = schedule(plan, words, block_words=block_words)
    documents = streams.drop("key").join(plan.withColumnRenamed("source", "of"), F.col("source").eqNullSafe(F.col("of"))).drop("of")
    spread = documents.where("size > 0 AND slots > 0").withColumn("block", F.explode(F.expr(f"sequence(start div {block_words}, (start + size - 1) div {block_words})")))
    first = F.greatest(F.col("block") * block_words - F.col("start"), F.lit(0))
    offset = F.greatest(F.col("start") - F.col("block") * block_words, F.lit(0))
    end = F.least(F.col("start") + F.col("size") - F.col("block") * block_words, F.lit(block_words))
    pieces = visits(spread.withColumns({"first": first, "offset": offset, "end": end}), block_words=block_words).join(slots, ["number", "rank"])
    pieces = pieces.withColumn("n", F.least("end", "n") - F.col("offset")).where("n > 0")
    pieces = pieces.select("place", "source", "epoch", "doc_id", "start", "first", "n", "number", "size", "source_size", "target")
    names = ["number", "start", "doc_id", "source", "size", "source_size", "target"]
    # a document of one word or more is alone at its start
    rows = documents.where("size > 0").select(*names, F.lit(0).cast("long").alias("n")).unionByName(pieces.select(*names, "n"))
    taken = rows.groupBy(*names).agg(F.sum("n").alias("taken"))
    none = documents.where("size = 0").select(*names, F.lit(0).cast("long").alias("taken"))
    out = taken.unionByName(none).select("doc_id", "source", "size", "source_size", "target", "taken")
    return pieces.select("place", "source", "epoch", "doc_id", "start", "first", "n"), out


def piece_text(text: Column, first: Column, n: Column) -> Column:
    """The words of a piece, joined by one space."""
    return F.array_join(F.slice(F.regexp_extract_all(text, F.lit(WORD), F.lit(0)), first.cast("int") + 1, n.cast("int")), " ")
