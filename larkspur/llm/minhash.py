"""Near-duplicate detection with DartMinHash signatures and banded joins.

A document is the set of its shingles of five words (A-Z lower-cased), each weighing 1 however often it stands there, for
that is what candidates are verified by. The half-plane of weight times rank above each shingle is a field into which hashed
darts fall, one a unit of area on average; where they fall depends on the shingle alone. A document owns the field up to each
shingle's weight. Every dart goes to one of the signature's coordinates by its hash, and each coordinate keeps the earliest
dart (by rank) that the document owns, so two documents agree on a coordinate with the probability of their Jaccard similarity. Only ranks up to a limit need be
thrown (about k ln k darts whatever the length); where a coordinate stays empty the limit is doubled.

Equal word sequences are one class from the start and one of them represents it, so copies are never paired. The
representatives' signatures are cut into bands; a bucket of equal bands links each member to the bucket's first member, the
one that meets most others in all its buckets. Candidates are verified by the exact Jaccard similarity of their shingle
sets; classes are the connected components of the verified links, found by alternating large and small stars. Most buckets
are then of one class and need nothing more. In the others, growing shares of the members are pivots in turn. They meet
the members of other classes, but for those that can't be similar enough by bounds that hold for any sets: their sizes, and
the shingles that maps of hashed shingles (`MARKS` bits) show only one of them to have. So no link within a bucket is lost.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larkspur.llm.charlm import mix
from larkspur.llm.common import dropped, held, written
from larkspur.llm.url_filter import bits, bloom

WORDS, SIMILARITY = 5, 0.8
BANDS, ROWS = 24, 5
#: Shares of the members of buckets of several classes that have been pivots after each round; the last must be 1.
SHARES = (1 / 16, 1.0)
#: Bytes of text that are hashed at a time, about.
CHUNK = 1 << 20
#: Cells of the table of darts that are thrown at a time: several arrays of that many numbers.
CELLS = 250_000
_TURNS = 1 << 20
#: A text is heavy if one of so many rows is a copy of it; so no more texts than that are.
HEAVY = 1000
#: Bits of the map of a text's hashed shingles.
MARKS = 1024
#: Blocks of the filter that fetches candidates' texts, 64 bits each.
BLOCKS = 1 << 18
_ODD = np.uint64(0xD1342543DE82EF95)
_NORMAL = bytes(b + 32 if 0x41 <= b <= 0x5A else 0x20 if 0x09 <= b <= 0x0D else b for b in range(256))
_STEP = np.array([0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3], np.uint64)
_powers = (np.ones(1, np.uint64), np.ones(1, np.uint64))


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the odd base and of its inverse, up to n."""
    global _powers
    if len(_powers[0]) <= n:
        size = max(n + 1, CHUNK)
        with np.errstate(over="ignore"):
            inverse = np.uint64(pow(int(_ODD), -1, 1 << 64))
            _powers = tuple(np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(size, x, np.uint64)])) for x in (_ODD, inverse))
    return _powers


def word_hashes(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """A hash of every word of all texts, and the number of words of each."""
    data = [(t or "").encode().translate(_NORMAL) for t in texts]
    joined = np.frombuffer(b" ".join(data) + b" ", np.uint8)
    space = joined == 0x20
    edge = np.diff(np.concatenate([[1], space.view(np.int8)]))
    starts, ends = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    power, inverse = _power(len(joined))
    with np.errstate(over="ignore"):
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum((joined.astype(np.uint64) + np.uint64(1)) * power[: len(joined)])])
        hashes = mix((sums[ends] - sums[starts]) * inverse[starts], (ends - starts).astype(np.uint64))
    borders = np.cumsum([len(d) + 1 for d in data])
    return hashes, np.diff(np.searchsorted(starts, borders), prepend=0)


def shingles(hashes: np.ndarray, counts: np.ndarray, size: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """(hash, text) of every shingle; a text of fewer words, but not none, is one shingle."""
    n = len(hashes)
    padded = np.concatenate([hashes, np.zeros(size, np.uint64)])
    text = np.repeat(np.arange(len(counts)), counts)
    place = np.arange(n) - np.repeat(np.cumsum(counts) - counts, counts)
    left = np.repeat(counts, counts) - place
    with np.errstate(over="ignore"):
        out = np.zeros(n, np.uint64)
        for k in range(size):
            out += np.where(left > k, padded[k : n + k] * _STEP[k % 7] + _STEP[(k + 3) % 7], np.uint64(0))
    take = (left >= size) | (place == 0)
    return mix(out[take], np.minimum(left, size)[take].astype(np.uint64)), text[take]


def _weighted(keys: np.ndarray, text: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (shingle, text) and how often each stands there."""
    order = np.argsort(keys, kind="stable")
    order = order[np.argsort(text[order].astype(np.uint16), kind="stable")]
    k, t = keys[order], text[order]
    first = np.flatnonzero(np.concatenate([[True], (k[1:] != k[:-1]) | (t[1:] != t[:-1])])[: len(k)])
    return k[first], t[first], np.diff(np.append(first, len(k)))


def _unit(h: np.ndarray) -> np.ndarray:
    """Uniform in (0, 1]."""
    return ((h >> np.uint64(11)).astype(np.float64) + 1) * 2.0**-53


def _throw(cell: np.ndarray, owned: np.ndarray, limit: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(number of the cell, rank, hash) of the darts in each unit cell up to its limit of rank, within the owned part.

    Ranks in a cell are a Poisson process whose gaps are hashes of the cell and the dart's number.
    """
    size = np.ceil(np.log2(np.maximum(limit, 1))).astype(int)
    for s in np.unique(size):
        mine = np.flatnonzero(size == s)
        if s == 0:  # mostly no dart or one
            rank, k = np.zeros(len(mine)), 0
            while len(mine):
                h = mix(cell[mine], np.uint64(k))
                rank = rank - np.log(_unit(h))
                near = rank <= limit[mine]
                mine, rank, h = mine[near], rank[near], h[near]
                dart = mix(h, np.uint64(1))
                own = _unit(mix(dart, np.uint64(2))) <= owned[mine]
                yield mine[own], rank[own], dart[own]
                k += 1
            continue
        m = int(2**s + 9 * 2 ** (s / 2) + 16)
        rows = max(1, CELLS // m)
        for a in range(0, len(mine), rows):
            part = mine[a : a + rows]
            h = mix(cell[part][:, None], np.arange(m, dtype=np.uint64)[None, :])
            rank = np.cumsum(-np.log(_unit(h)), axis=1)
            i, j = np.nonzero(rank <= limit[part][:, None])
            dart = mix(h[i, j], np.uint64(1))
            own = _unit(mix(dart, np.uint64(2))) <= owned[part[i]]
            yield part[i[own]], rank[i, j][own], dart[own]


def signatures(keys: np.ndarray, text: np.ndarray, weights: np.ndarray, n: int, k: int) -> np.ndarray:
    """The earliest dart of each of k coordinates, for each of n texts; texts without a shingle keep 0."""
    out = np.zeros((n, k), np.uint64)
    total = np.bincount(text, weights, n)
    darts, todo = k * (np.log(k) + 3), total > 0
    while todo.any():
        mine = np.flatnonzero(todo[text])
        cells = np.ceil(weights[mine]).astype(int)
        mine, layer = np.repeat(mine, cells), np.arange(cells.sum()) - np.repeat(np.cumsum(cells) - cells, cells)
        cell = mix(keys[mine], layer.astype(np.uint64) + np.uint64(0xDA27))
        owned, of, limit = np.minimum(weights[mine] - layer, 1.0), text[mine], darts / total[text[mine]]
        best = np.full(n * k, np.inf)
        found = [(of[c] * k + (d % np.uint64(k)).astype(np.int64), r, d) for c, r, d in _throw(cell, owned, limit)]
        slot, rank, dart = (np.concatenate([f[i] for f in found]) for i in range(3))
        np.minimum.at(best, slot, rank)
        first = rank == best[slot]
        out.reshape(-1)[slot[first]] = dart[first]
        todo &= np.isinf(best.reshape(n, k)).any(axis=1)
        darts *= 2
    return out


def _chunks(sizes: np.ndarray) -> list[tuple[int, int]]:
    """Ranges of rows of some CHUNK bytes each, and 30000 rows at most."""
    group = np.cumsum(sizes) // CHUNK + np.arange(len(sizes)) // 30_000
    cuts = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), len(sizes)]
    return [(a, b) for a, b in zip(cuts, cuts[1:], strict=False) if a < b]


def _fingerprint(hashes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """A 128-bit hash of each text's words, as two longs."""
    ends = np.cumsum(counts)
    return np.array([[x >> 64, x & 0xFFFFFFFFFFFFFFFF] for x in (xxhash.xxh3_128_intdigest(hashes[e - c : e].tobytes()) for e, c in zip(ends, counts, strict=True))], np.uint64).reshape(-1, 2).view(np.int64)


def _marks(keys: np.ndarray, text: np.ndarray, n: int) -> np.ndarray:
    """A map of MARKS bits for each text, with the bits of its hashed shingles."""
    out = np.zeros((n, MARKS // 64), np.uint64)
    cell = mix(keys, np.uint64(0xB17)) % np.uint64(MARKS)
    np.bitwise_or.at(out, (text, (cell >> np.uint64(6)).astype(np.int64)), np.uint64(1) << (cell & np.uint64(63)))
    return out.view(np.int64)


_SIGNED = "id bigint, fa bigint, fb bigint, size int, marks array<bigint>, bands array<bigint>"


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held("minhash", dict)  # what an earlier operator kept in this worker goes
    k = BANDS * ROWS
    for batch in batches:
        sizes = np.fromiter((len(x) if x else 0 for x in batch["text"].to_pylist()), np.int64, batch.num_rows)
        for a, b in _chunks(sizes):
            part = batch.slice(a, b - a)
            hashes, counts = word_hashes(part["text"].to_pylist())
            keys, text, _ = _weighted(*shingles(hashes, counts))
            signed = signatures(keys, text, np.ones(len(keys)), b - a, k)
            band = np.zeros((b - a, BANDS), np.uint64)
            for r in range(ROWS):
                band = mix(band, signed.reshape(-1, BANDS, ROWS)[:, :, r])
            band = mix(band, np.arange(BANDS, dtype=np.uint64)[None, :]).view(np.int64)
            has = counts > 0
            offsets = np.concatenate([[0], np.cumsum(has * BANDS)])
            print_ = _fingerprint(hashes, counts)
            size = pa.array(np.bincount(text, minlength=b - a), pa.int32())
            marks = pa.FixedSizeListArray.from_arrays(pa.array(_marks(keys, text, b - a).ravel()), MARKS // 64).cast(pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([part["id"], pa.array(print_[:, 0]), pa.array(print_[:, 1]), size, marks, pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(band[has].ravel()))], names=["id", "fa", "fb", "size", "marks", "bands"])


def _shingle_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The sorted distinct shingles of each text, as bytes."""
    for batch in batches:
        sizes = np.fromiter((len(x) if x else 0 for x in batch["text"].to_pylist()), np.int64, batch.num_rows)
        for a, b in _chunks(sizes):
            part = batch.slice(a, b - a)
            keys, text, _ = _weighted(*shingles(*word_hashes(part["text"].to_pylist())))
            at = np.searchsorted(text, np.arange(b - a + 1))
            yield pa.RecordBatch.from_arrays([part["id"], pa.array([keys[x:y].tobytes() for x, y in zip(at, at[1:], strict=False)], pa.binary())], names=["id", "shingles"])


def _jaccard(left: pa.Array, right: pa.Array) -> pa.Array:
    out = []
    for x, y in zip(left, right, strict=True):
        a, b = (np.frombuffer(v.as_py(), np.uint64) for v in (x, y))
        both = np.intersect1d(a, b, assume_unique=True).size
        out.append(both / max(a.size + b.size - both, 1))
    return pa.array(out, pa.float64())


def _compared(pairs: DataFrame, docs: DataFrame) -> DataFrame:
    """The pairs (u, v) with the exact Jaccard similarity of their shingle sets. docs: id, text, one row an id."""
    wanted = pairs.select(F.col("u").alias("id")).union(pairs.select("v")).distinct()
    # an inner join: a semi join would be moved below the filter, and all texts would be shuffled
    h = F.xxhash64("id")
    maybe = docs.withColumn("_block", F.pmod(h, F.lit(BLOCKS))).join(F.broadcast(bloom(F.col("id"), wanted, BLOCKS)), "_block").where(F.col("_word").bitwiseAND(bits(h)) == bits(h))
    sets = written(maybe.select("id", "text").join(wanted, "id").mapInArrow(_shingle_sets, "id bigint, shingles binary"), "shingles")
    alike = F.arrow_udf(_jaccard, "double")
    both = pairs.join(sets.select(F.col("id").alias("u"), F.col("shingles").alias("_u")), "u").join(sets.select(F.col("id").alias("v"), F.col("shingles").alias("_v")), "v")
    return written(both.select("u", "v", alike("_u", "_v").alias("similarity")), "compared")


def components(edges: DataFrame) -> DataFrame:
    """(id, component) of every node of the edges (u, v): the least id it is linked to, over any number of links.

    Large stars link a node's larger neighbours to its least neighbour, small stars its smaller ones; both keep the
    components, and together they end in one star a component after some log-squared rounds.
    """
    now, seen = written(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges"), None
    while True:
        state = now.agg(F.count("*"), F.sum(F.hash("u", "v").cast("bigint")), F.sum(F.xxhash64("v", "u").cast("decimal(38,0)"))).first()
        if state == seen or not state[0]:
            return now.groupBy(F.col("u").alias("id")).agg(F.min("v").alias("component"))
        seen = state
        both = now.union(now.select("v", "u")).toDF("u", "v")
        least = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
        large = written(both.join(least, "u").where("v > u AND v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), "edges")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u")
        before, now = now, written(small.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", "m")).distinct(), "edges")
        dropped(before, large)


def _allowed(a: Column, b: Column, a_marks: Column, b_marks: Column, similarity: float) -> Column:
    """Whether sets of these sizes and marks can be similar enough.

    Similar sets have at most the share (1 - similarity) / (1 + similarity) of both sizes in one of them only; a bit that
    is set in one map only is a shingle of that kind.
    """
    alone = sum((F.bit_count(F.get(a_marks, i).bitwiseXOR(F.get(b_marks, i))) for i in range(MARKS // 64)), F.lit(0))
    return (F.least(a, b) >= F.greatest(a, b) * similarity - 1e-6) & (alone <= (a + b) * ((1 - similarity) / (1 + similarity)) + 1e-6)


def _members(signed: DataFrame, copies: DataFrame) -> DataFrame:
    """(id, rep) of every row. Texts that stand in one of HEAVY rows or more are HEAVY at most: they are broadcast, so the
    copies of one text don't meet in one task. The others meet their representative in a shuffle."""
    total = copies.agg(F.sum("n")).first()[0] or 0
    often = F.col("n") >= max(total / HEAVY, 2.0)
    heavy = F.broadcast(copies.where(often).select("fa", "fb", F.col("rep").alias("heavy")))
    rows = signed.select("id", "fa", "fb").join(heavy, ["fa", "fb"], "left")
    rest = rows.where("heavy IS NULL").select("id", "fa", "fb").join(copies.where(~often).select("fa", "fb", "rep"), ["fa", "fb"])
    return rows.where("heavy IS NOT NULL").select("id", F.col("heavy").alias("rep")).unionByName(rest.select("id", "rep"))


def near_duplicates(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", similarity: float = SIMILARITY) -> DataFrame:
    """(doc_id, class_id) of every distinct non-null doc_id; class_id is the least doc_id of its class.

    Null, empty and blank texts have equal (no) words and are one class. Texts of fewer than five words are near only to
    those with the same words. Rows with a null doc_id are left out; several rows with one doc_id join their classes.
    Other columns are ignored. Ties can't occur: ids are distinct.
    """
    rows = docs.select(F.col(f"`{doc_id}`").cast("bigint").alias("id"), F.col(f"`{text}`").alias("text")).where("id IS NOT NULL")
    signed = written(rows.mapInArrow(_sign, _SIGNED), "signed")
    copies = written(signed.groupBy("fa", "fb").agg(F.min("id").alias("rep"), F.count("*").alias("n")), "copies")
    members = written(_members(signed, copies), "members")
    # ids are in the key too, so copies of one text are dealt over the tasks
    reps = signed.join(copies.select(F.col("rep").alias("id"), "fa", "fb"), ["id", "fa", "fb"])
    banded = written(reps.select("id", "size", F.explode("bands").alias("key")).distinct(), "banded")
    crowded = written(banded.join(banded.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"), "key"), "crowded")
    # what others were copied from meets more of them than they meet each other, so it is a better first member
    met = crowded.groupBy("id").agg(F.sum("n").alias("met"))
    crowded = crowded.join(met, "id").select("key", "id", "size", "met")
    first = crowded.groupBy("key").agg(F.max(F.struct("met", (-F.col("id")).alias("least"), "id", "size")).alias("first"))
    buckets = written(crowded.select("key", "id", "size").join(first, "key"), "buckets")
    # several texts under one id
    edges = members.groupBy("id").agg(F.max("rep").alias("u"), F.min("rep").alias("v")).where("u <> v").select("u", "v")
    pair = [F.greatest("id", "first.id").alias("u"), F.least("id", "first.id").alias("v")]
    pairs = written(buckets.where(F.col("id") != F.col("first.id")).select(*pair).distinct(), "pairs")
    compared = _compared(pairs, rows)
    edges = written(edges.union(compared.where(F.col("similarity") >= similarity).select("u", "v")), "links")
    classes = written(components(edges), "classes")
    before = 0
    for share in SHARES:
        upto = int(share * _TURNS)
        of = buckets.join(classes, "id", "left").select("key", "id", "size", F.coalesce("component", "id").alias("component"), F.pmod(F.xxhash64("id"), F.lit(_TURNS)).alias("turn"))
        mixed = of.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo <> hi").select("key")
        of = written(of.where(F.col("turn") >= before).join(mixed, "key", "left_semi").join(signed.select("id", "marks"), "id").dropDuplicates(["key", "id"]), "mixed")
        pivots = of.where(F.col("turn") < upto).toDF("p", "key", "p_size", "p_component", "p_turn", "p_marks").drop("p_turn")
        other = (F.col("component") != F.col("p_component")) & ((F.col("turn") >= upto) | (F.col("id") > F.col("p")))
        can = _allowed(F.col("size"), F.col("p_size"), F.col("marks"), F.col("p_marks"), similarity)
        new = pivots.join(of, "key").where(other & can).select(F.greatest("id", "p").alias("u"), F.least("id", "p").alias("v")).distinct()
        new = written(new.join(pairs, ["u", "v"], "left_anti"), "pairs")
        before = upto
        if not new.isEmpty():
            pairs = pairs.union(new)
            edges = edges.union(_compared(new, rows).where(F.col("similarity") >= similarity).select("u", "v"))
            classes = written(components(edges), "classes")
    out = members.join(classes.select(F.col("id").alias("rep"), "component"), "rep", "left")
    return out.groupBy(F.col("id").alias("doc_id")).agg(F.min(F.coalesce("component", "rep")).alias("class_id"))


def keep_one(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", similarity: float = SIMILARITY) -> DataFrame:
    """The rows of docs whose doc_id is its class's least; rows with a null doc_id stay. Columns stay as they are."""
    gone = near_duplicates(docs, doc_id=doc_id, text=text, similarity=similarity).where("doc_id <> class_id").select(F.col("doc_id").alias(doc_id))
    return docs.join(gone, doc_id, "left_anti")
