"""Line deduplication by a deletion-neighbourhood join, with an edit bound of one character.

A line goes if an earlier line (by document, then by place) equals it or is one edit away: one character inserted, deleted
or replaced. The earliest stays. Lines without a character other than white space are never touched.

1. Equal lines are grouped by a 128-bit hash; the first place of each is kept.
2. Lines that can have a neighbour at all are found without loss: cut two lines one edit apart into `k` parts, and all but
   the part with the edit are the same. This is asked with halves of all lines, then with `PARTS` parts of those that are
   left. Lines whose other parts nobody shares have no neighbour and need no variants.
3. The others emit all variants within the bound as hashed keys: the line itself, the line without each character, and the
   line with each character left open (the same deletion beside its place). Equal keys meet in one aggregate that keeps
   the earliest and the next line of each key, not pairs: lines under an open place are all one edit apart, and a deletion
   is one edit from the line that equals it.
4. The earlier line of each meeting is verified by edit distance on the texts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larkspur.llm.charlm import mix
from larkspur.llm.common import written
from larkspur.llm.url_filter import bits, bloom

#: Parts of the second question.
PARTS = 8
#: Blocks of a filter before a join, 64 bits each: about 16 bits a counted key, up to this bound of some 40 MB broadcast.
#: Beyond 6 million keys the filter lets more rows through to the exact join that follows; results are the same.
MAX_BLOCKS = 1 << 20
#: Characters of the lines whose variants one task emits, about.
TASK_CHARS = 200_000
#: Variants in one batch, at most.
BATCH = 200_000
_BLANK = r"\S"
#: Matches once in each line that has a visible character.
_VISIBLE = r"\S[^\n]*"
_ODD = 0xD1342543DE82EF95


def lines_of(docs: DataFrame, text: str, doc_id: str) -> DataFrame:
    """(id, n, line) of every line that has a visible character; null texts have none."""
    rows = docs.select(F.col(f"`{doc_id}`").alias("id"), F.posexplode(F.split(F.col(f"`{text}`"), "\n")).alias("n", "line"))
    return rows.where(F.col("line").rlike(_BLANK))


def _hashes() -> list[Column]:
    return [F.xxhash64("line").alias("a"), F.xxhash64("line", F.lit(1)).alias("b")]


def _but_one(parts: int) -> Column:
    """Hashes of a line without each of its parts, as a line of its length, and as the longer of two lines.

    For lengths m and m, or m and m + 1, one edit lies in one of the parts that start at m * q // parts. What stands before
    the part is equal from the start, what stands behind it is equal from the end.
    """
    n, line = F.length("line"), F.col("line")

    def keys(m: Column) -> list[Column]:
        cuts = [F.floor(m * q / parts).cast("int") for q in range(parts + 1)]
        tails = [m - c for c in cuts[1:]]
        return [F.xxhash64(F.substring(line, F.lit(1), cuts[q]), F.substring(line, n - tails[q] + 1, tails[q]), m, F.lit(q)) for q in range(parts)]

    return F.array(*keys(n), *keys(n - 1))


def _maybe(rows: DataFrame, key: Column, keys: DataFrame, name: str) -> DataFrame:
    """rows with `_hit`: whether the key may be among keys' column of that name. A filter of bounded size, before an exact join.

    keys is a written table: it is counted first, and the filter is sized by that.
    """
    blocks = 1 << min(max(keys.count() // 4, 1 << 10).bit_length(), MAX_BLOCKS.bit_length() - 1)
    h = F.xxhash64(key)
    table = F.broadcast(bloom(F.col(name), keys, blocks))
    hit = rows.withColumn("_block", F.pmod(h, F.lit(blocks))).join(table, "_block", "left").withColumn("_hit", F.coalesce(F.col("_word").bitwiseAND(bits(h)) == bits(h), F.lit(False)))
    return hit.drop("_block", "_word")


def _neighbourhood(line: str) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(keys, kinds) of the line's variants, a part at a time: without each character, with each left open, and the line itself.

    A polynomial hash over mixed character codes gives each from what stands before and after it, so the work is linear,
    and a line takes some 40 bytes a character.
    """
    codes = np.frombuffer(line.encode("utf-32-le", "surrogatepass"), np.uint32)
    n = len(codes)
    inverse = np.uint64(pow(_ODD, -1, 1 << 64))
    with np.errstate(over="ignore"):
        terms = mix(np.uint64(7), codes.astype(np.uint64))
        terms *= np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(max(n - 1, 0), _ODD, np.uint64)]))[:n]
        before = np.concatenate([np.zeros(1, np.uint64), np.cumsum(terms)])  # of the first i characters
        for a in range(0, n, BATCH // 2):
            b = min(a + BATCH // 2, n)
            # after a deletion the rest stands one place earlier: divide by the odd base
            gone = mix(before[a:b] + (before[n] - before[a + 1 : b + 1]) * inverse, np.full(b - a, n - 1, np.uint64))
            opened = mix(gone ^ np.uint64(0x5851F42D4C957F2D), np.arange(a, b, dtype=np.uint64))
            # a run of equal characters gives one deletion only
            ends = np.append(codes[a : b - 1] != codes[a + 1 : b], b == n or codes[b - 1] != codes[b])
            deleted = gone[ends]
            yield np.concatenate([opened, deleted]), np.repeat(np.array([0, 1], np.int32), [len(opened), len(deleted)])
        yield mix(before[n : n + 1], np.full(1, n, np.uint64)), np.full(1, 2, np.int32)


_VARIANTS = "key bigint, kind int, place bigint"


def _emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """kind 0: an open place (lines under one are one edit apart); 1: a deletion (one edit from kind 2); 2: the line, met by deletions."""
    held: list[tuple[np.ndarray, np.ndarray, int]] = []
    size = 0
    for batch in batches:
        for at in range(batch.num_rows):
            place = batch["place"][at].as_py()
            for keys, kinds in _neighbourhood(batch["line"][at].as_py()):
                held.append((keys, kinds, place))
                size += len(keys)
                if size >= BATCH:
                    yield _variant_rows(held)
                    held, size = [], 0
    if held:
        yield _variant_rows(held)


def _variant_rows(held: list[tuple[np.ndarray, np.ndarray, int]]) -> pa.RecordBatch:
    keys, kinds = (np.concatenate([h[k] for h in held]) for k in (0, 1))
    places = np.repeat(np.array([h[2] for h in held], np.int64), [len(h[0]) for h in held])
    return pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(kinds, pa.int32()), pa.array(places)], names=["key", "kind", "place"])


def _variants(lines: DataFrame, tasks: int) -> DataFrame:
    """The variants of lines (place, line), from as many tasks as their characters need."""
    return lines.select("place", "line").repartition(tasks, "place").mapInArrow(_emit, _VARIANTS)


def one_edit(a: str, b: str) -> bool:
    """Whether the edit distance is 1. Linear: Spark's levenshtein is quadratic in the length whatever the threshold."""
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    low, high = 0, min(len(a), len(b))  # the common prefix, by bisection
    while low < high:
        k = (low + high + 1) // 2
        if a[low:k] == b[low:k]:
            low = k
        else:
            high = k - 1
    return a[low + (len(a) >= len(b)) :] == b[low + (len(b) >= len(a)) :]


def _one_edit(left: pa.Array, right: pa.Array) -> pa.Array:
    return pa.array([one_edit(a.as_py(), b.as_py()) for a, b in zip(left, right, strict=True)], pa.bool_())


def _near(lines: DataFrame) -> DataFrame:
    """(a, b) of distinct lines that have an earlier line one edit away."""
    hashed = lines.select("id", "n", *_hashes(), "line", _but_one(2).alias("parts"))
    shared = hashed.select("a", F.explode("parts").alias("part")).groupBy("part").agg(F.min("a").alias("lo"), F.max("a").alias("hi"))
    shared = written(shared.where("lo <> hi").select("part"), "halves")
    half = _maybe(hashed.select("id", "n", "a", "b", "line", F.explode("parts").alias("part")), F.col("part"), shared, "part").where("_hit")
    # an inner join: a semi join would be moved below the filter, and all lines would be shuffled
    able = half.join(shared, "part").groupBy("a", "b").agg(F.min(F.struct("id", "n", "line")).alias("at")).select("a", "b", "at.*")
    able = written(able, "able")
    # the same with more parts, of what is left
    finer = able.select("a", "b", F.explode(_but_one(PARTS)).alias("part"))
    meets = finer.groupBy("part").agg(F.min("a").alias("lo"), F.max("a").alias("hi")).where("lo <> hi")
    able = able.join(finer.join(meets, "part").select("a", "b").distinct(), ["a", "b"])
    # places are numbers in the order of documents and lines: sorted ranges, numbered one after another, then written
    ordered = able.repartitionByRange("id", "n").sortWithinPartitions("id", "n")
    near = written(ordered.select("a", "b", "line", F.monotonically_increasing_id().alias("place")), "lines")
    # as many tasks as the variants need, whatever number of files the lines are in
    tasks = int((near.agg(F.sum(F.length("line"))).first()[0] or 0) // TASK_CHARS) + 1
    place = {k: F.when(F.col("kind") == k, F.col("place")) for k in range(3)}
    keys = _variants(near, tasks).groupBy("key").agg(
        F.min(place[0]).alias("open"), F.max(place[0]).alias("opened"), F.min(place[1]).alias("deletion"), F.min(place[2]).alias("whole")
    )
    keys = written(keys.where("open <> opened OR deletion IS NOT NULL AND whole IS NOT NULL"), "keys")
    # what each line has met that stands before it
    met = F.expr("CASE kind WHEN 0 THEN open WHEN 1 THEN whole ELSE deletion END")
    mine = _maybe(_variants(near, tasks), F.col("key"), keys, "key").where("_hit").drop("_hit")
    pairs = mine.join(keys, "key").withColumn("met", met).where("met < place").select("place", "met").distinct()
    both = pairs.join(near, "place").join(near.select(F.col("place").alias("met"), F.col("line").alias("other")), "met")
    return both.where(F.arrow_udf(_one_edit, "boolean")("line", "other")).select("a", "b").distinct()


def dropped_lines(docs: DataFrame, *, text: str = "text", doc_id: str = "doc_id", max_edits: int = 1) -> DataFrame:
    """(id, n, near) of every line that goes: n counts lines from 0; near says that an earlier line is one edit away.

    Texts are read again for each step rather than shuffled; what is shuffled are hashes and places.
    """
    if max_edits not in (0, 1):
        raise ValueError("max_edits must be 0 or 1")
    lines = lines_of(docs, text, doc_id)
    keys = lines.select("id", "n", *_hashes())
    copies = keys.groupBy("a", "b").agg(F.min(F.struct("id", "n")).alias("first"), F.count("*").alias("copies")).where("copies > 1").select("a", "b", "first")
    gone = copies.withColumn("near", F.lit(False))
    if max_edits:
        gone = gone.unionByName(_near(lines).withColumn("near", F.lit(True)), allowMissingColumns=True)
        gone = gone.groupBy("a", "b").agg(F.min("first").alias("first"), F.bool_or("near").alias("near"))
    gone = written(gone, "gone")
    mine = _maybe(keys, F.col("a"), gone, "a").where("_hit").drop("_hit").join(gone, ["a", "b"])
    return mine.where("near OR id <> first.id OR n <> first.n").select("id", "n", "near")


def dedup_lines(docs: DataFrame, *, text: str = "text", doc_id: str = "doc_id", max_edits: int = 1) -> DataFrame:
    """docs with the lines that stay in text, and n_lines (visible ones before), n_dropped and n_near.

    Null texts stay null and empty ones empty; blank lines stay where they are. Of several rows with one doc_id, lines of
    any count as one document's, so the key should be unique; rows with a null doc_id are left as they are. Equal places
    can't tie otherwise. Columns of docs with these three names are replaced; any other name may be there.
    """
    drops = dropped_lines(docs.where(F.col(f"`{doc_id}`").isNotNull()), text=text, doc_id=doc_id, max_edits=max_edits)
    drops = written(drops.groupBy("id").agg(F.collect_list("n").alias("gone"), F.sum(F.col("near").cast("bigint")).alias("near")), "drops")
    others = [c for c in docs.columns if c not in (text, "n_lines", "n_dropped", "n_near")]
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in others]).alias("row"), F.col(f"`{doc_id}`").alias("id"), F.col(f"`{text}`").alias("text"))
    rows = _maybe(rows, F.col("id"), drops, "id").withColumn("n_lines", F.coalesce(F.regexp_count("text", F.lit(_VISIBLE)), F.lit(0)).cast("bigint"))
    # a line's number becomes null where it goes; a set operation, so long lists cost no more than their length
    hit = rows.where("_hit").join(drops, "id", "left").withColumn("split", F.when(F.col("gone").isNotNull(), F.split("text", "\n")))
    left = F.array_except(F.sequence(F.lit(0), F.size("split") - 1), F.col("gone"))
    kept = F.array_join(F.transform(left, lambda i: F.get(F.col("split"), i)), "\n")
    hit = hit.select("row", "n_lines", F.when(F.col("gone").isNull(), F.col("text")).otherwise(kept).alias("text"), F.coalesce(F.array_size("gone"), F.lit(0)).cast("bigint").alias("n_dropped"), F.coalesce("near", F.lit(0)).cast("bigint").alias("n_near"))
    rest = rows.where("NOT _hit").select("row", "n_lines", "text", F.lit(0).cast("bigint").alias("n_dropped"), F.lit(0).cast("bigint").alias("n_near"))
    first = [F.col("text").alias(text) if c == text else F.col("row")[c].alias(c) for c in docs.columns if c == text or c in others]
    return hit.unionByName(rest).select(*first, "n_lines", "n_dropped", "n_near")
