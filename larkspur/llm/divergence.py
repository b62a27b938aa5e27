"""Source divergence audit: how far each source's use of words is from the other sources' and from its language's.

Each task counts the terms of its documents in byte tries, one a language, whose leaves have a counter for each source. Tries are
flat arrays in the order of their walk: merging some is a sort of their leaves by bytes, whose counters add up. A trie is
written as its leaves. Leaves are dealt by ranges of (language, term), and each range's leaves are merged to one trie, so it
doesn't matter which task saw which document. Its walk is in UTF-8 order; terms in enough documents leave it in blocks of BLOCK.

A block and its language's sources give a matrix of smoothed probabilities in whole billionths, and from that the block's part of
the distance of each two sources, and its candidates for each source's list; in UTF-8 order, so that the first of equal values
stay. Sums and lists of blocks are put together by Spark.

Bounds: a task counts WORDS words at a time and writes its tries out when they have LEAVES leaves, a range has about a
quarter of that, a block has BLOCK rows times the sources of a language. Pairs of sources are the result's size. All arithmetic is exact for up to 9e15 words a language.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from larkspur.llm.common import written

#: Terms are runs of letters: ASCII letters, lower-cased, and all characters beyond ASCII. The other bytes become spaces.
_LETTERS = bytes(b if b >= 0x80 or 0x61 <= b <= 0x7A else b + 32 if 0x41 <= b <= 0x5A else 0x20 for b in range(256))
LEAST_DOCUMENTS, SMOOTHING, TOP = 30, 5, 50
#: Words counted at a time; leaves at which a task writes its tries out, and of a range; terms of a block; parts of a language's blocks.
WORDS, LEAVES, BLOCK, SPREAD = 1_000_000, 1_000_000, 1024, 64
_PARTS = pa.schema([("lang", pa.string()), ("source", pa.string()), ("part", pa.string()), ("item", pa.string()), ("value", pa.int64())])


class Trie:
    """A radix trie of byte strings as flat arrays, in the order of its walk; a leaf counts, for each source, occurrences and documents.

    terms: the leaves' strings in the order of bytes; the edge of a leaf begins where it parts from the one before, so these
    stand for the inner nodes too. The counters of leaf i are those from first[i] up to first[i + 1].
    """

    __slots__ = ("documents", "first", "n", "source", "terms")

    def __init__(self, terms: pa.Array, leaf: np.ndarray, source: np.ndarray, n: np.ndarray, documents: np.ndarray) -> None:
        """Of any terms, repeated ones too, and counters (index of the term, source, n, documents) that are summed."""
        coded = terms.dictionary_encode()
        order = pc.array_sort_indices(coded.dictionary).to_numpy()
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        width = int(source.max(initial=0)) + 1
        key, at = np.unique(place[coded.indices.to_numpy()][leaf] * width + source, return_inverse=True)
        self.terms, self.source, sums = coded.dictionary.take(pa.array(order)), key % width, np.zeros((2, len(key)), np.int64)
        np.add.at(sums[0], at, n)
        np.add.at(sums[1], at, documents)
        self.n, self.documents = sums
        self.first = np.searchsorted(key // width, np.arange(len(order) + 1))

    @classmethod
    def merged(cls, tries: list[Trie]) -> Trie:
        """One trie with the counters of all, whose sources are the same numbers."""
        starts = np.cumsum([0, *[len(t.terms) for t in tries]])
        leaf = np.concatenate([a + np.repeat(np.arange(len(t.terms)), np.diff(t.first)) for a, t in zip(starts, tries, strict=False)])
        return cls(pa.concat_arrays([t.terms for t in tries]), leaf, *(np.concatenate([getattr(t, c) for t in tries]) for c in ("source", "n", "documents")))

    def kept(self, leaves: np.ndarray) -> tuple[pa.Array, np.ndarray, np.ndarray]:
        """Terms of some leaves, the places of their counters, and how many each has."""
        count = np.diff(self.first)[leaves]
        at = np.repeat(self.first[leaves] - (np.cumsum(count) - count), count) + np.arange(count.sum())
        return self.terms.take(pa.array(leaves)), at, count


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = zip(*rows, strict=True) if rows else [()] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def _lists(count: np.ndarray, values: pa.Array) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(count)]), pa.int32()), values)


def _counted(documents: list[list[bytes]], groups: list[int]) -> Trie:
    """The trie of some documents of one language; groups are their sources."""
    known: dict[bytes, int] = {}
    word = np.array([known.setdefault(w, len(known)) for words in documents for w in words], np.int64)
    document = np.repeat(np.arange(len(documents)), [len(w) for w in documents])
    pair, n = np.unique(document * (len(known) + 1) + word, return_counts=True)
    return Trie(pa.array(list(known), pa.binary()), pair % (len(known) + 1), np.array(groups, np.int64)[pair // (len(known) + 1)], n, np.ones(len(pair), np.int64))


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sources: dict[str, int] = {}  # numbered in each task; rows carry the names
    held: dict[str, tuple[list[list[bytes]], list[int]]] = {}
    tries: dict[str, list[Trie]] = {}

    def settle() -> int:
        for lang, (documents, groups) in held.items():
            tries.setdefault(lang, []).append(_counted(documents, groups))
        held.clear()
        return sum(len(t.terms) for own in tries.values() for t in own)

    def written_out() -> Iterator[pa.RecordBatch]:
        names = pa.array(list(sources), pa.string())
        for lang, own in tries.items():
            trie = Trie.merged(own)
            for a in range(0, len(trie.terms), 10_000):
                terms, at, count = trie.kept(np.arange(a, min(a + 10_000, len(trie.terms))))
                columns = [names.take(pa.array(trie.source[at])), pa.array(trie.n[at]), pa.array(trie.documents[at])]
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(terms)), terms.cast(pa.string()), *[_lists(count, c) for c in columns]], ["lang", "term", "sources", "n", "documents"])
        tries.clear()

    seen = 0
    for batch in batches:
        for lang, source, text in zip(*(batch[c].to_pylist() for c in ("lang", "source")), batch["text"].cast(pa.binary()), strict=True):
            terms = (text.as_py() or b"").translate(_LETTERS).split()
            documents, groups = held.setdefault(lang, ([], []))
            documents.append(terms)
            groups.append(sources.setdefault(source, len(sources)))
            seen += len(terms) + 1
            if seen >= WORDS:
                seen = 0
                if settle() >= LEAVES:
                    yield from written_out()
    settle()
    yield from written_out()


def _merge(least_documents: int):
    def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = list(batches)
        if not parts:
            return
        whole = pa.Table.from_batches(parts)
        coded = whole["lang"].combine_chunks().dictionary_encode()
        for k, lang in enumerate(coded.dictionary.to_pylist()):
            own = whole.filter(pc.equal(coded.indices, k)).combine_chunks()
            lists = [own[c].combine_chunks() for c in ("sources", "n", "documents")]
            names = lists[0].flatten().dictionary_encode()
            trie = Trie(own["term"].combine_chunks().cast(pa.binary()), lists[0].value_parent_indices().to_numpy(), names.indices.to_numpy().astype(np.int64), *(x.flatten().to_numpy() for x in lists[1:]))
            least = np.flatnonzero(np.add.reduceat(trie.documents, trie.first[:-1]) >= least_documents) if len(trie.terms) else np.empty(0, np.int64)
            for a in range(0, len(least), BLOCK):
                terms, at, count = trie.kept(least[a : a + BLOCK])
                n = len(terms)
                inner = [_lists(np.array([len(at)]), x) for x in (pa.array(np.repeat(np.arange(n), count), pa.int32()), names.dictionary.take(pa.array(trie.source[at])), pa.array(trie.n[at]))]
                yield pa.RecordBatch.from_arrays([pa.array([lang]), _lists(np.array([n]), terms.cast(pa.string())), *inner], ["lang", "terms", "term", "source", "n"])

    return merged


def billionths(count: np.ndarray, of: np.ndarray) -> np.ndarray:
    """floor(10^9 count / of), exactly, for 0 <= count <= of < 9 * 10^15: three digits at a time."""
    whole, rest = np.divmod(count, of)
    for _ in range(3):
        digits, rest = np.divmod(rest * 1000, of)
        whole = whole * 1000 + digits
    return whole


def _compare(smoothing: int, top: int):
    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        apart: dict[str, tuple[list[str], np.ndarray]] = {}
        for batch in batches:
            lists = {c: batch[c] for c in ("terms", "term", "source", "n", "sources", "sizes")}
            for i, (lang, kept) in enumerate(zip(batch["lang"].to_pylist(), batch["kept"].to_pylist(), strict=True)):
                terms, sources = lists["terms"][i].values, lists["sources"][i].values.to_pylist()
                place, names = {x: k for k, x in enumerate(sources)}, lists["source"][i].values.dictionary_encode()
                column = np.array([place[x] for x in names.dictionary.to_pylist()], np.int64)[names.indices.to_numpy()]
                count = np.zeros((len(terms), len(sources)), np.int64)
                count[lists["term"][i].values.to_numpy(), column] = lists["n"][i].values.to_numpy()
                n = lists["sizes"][i].values.to_numpy()
                p = 1 + billionths(count + smoothing, n + smoothing * kept)
                q = 1 + billionths(count.sum(1) + smoothing, n.sum() + smoothing * kept)
                if lang not in apart:
                    apart[lang] = (sources, np.zeros((len(sources), len(sources)), np.int64))
                rows, sums = [], apart[lang][1]
                for k, source in enumerate(sources):
                    sums[k, k + 1 :] += np.abs(p[:, k + 1 :] - p[:, k : k + 1]).sum(0)
                    more = np.flatnonzero((count[:, k] > 0) & (p[:, k] > q))
                    value = p[more, k] - q[more]
                    best = np.argsort(-value, kind="stable")[:top]
                    rows += zip([lang] * len(best), [source] * len(best), ["term"] * len(best), terms.take(pa.array(more[best])).to_pylist(), value[best].tolist(), strict=True)
                yield _batch(rows, _PARTS)
        for lang, (sources, sums) in apart.items():
            for k, source in enumerate(sources[:-1]):
                yield _batch([(lang, source, "pair", s, int(v)) for s, v in zip(sources[k + 1 :], sums[k, k + 1 :], strict=True)], _PARTS)

    return compared


def _text(df: DataFrame, name: str) -> Column:
    return F.coalesce(df[f"`{name}`"].cast("string"), F.lit(""))


def term_blocks(docs: DataFrame, *, text: str = "text", lang: str = "lang", source: str = "source", least_documents: int = LEAST_DOCUMENTS) -> DataFrame:
    """lang, terms and counts: the kept terms of each language in blocks, in UTF-8 order, with each source's occurrences."""
    rows = docs.select(_text(docs, lang).alias("lang"), _text(docs, source).alias("source"), _text(docs, text).alias("text"))
    leaves = written(rows.mapInArrow(_count, "lang string, term string, sources array<string>, n array<bigint>, documents array<bigint>"), "leaves")
    ranges = 4 * leaves.count() // LEAVES + 1
    dealt = leaves.repartitionByRange(ranges, "lang", "term")
    return dealt.mapInArrow(_merge(least_documents), "lang string, terms array<string>, term array<int>, source array<string>, n array<bigint>")


def audit(docs: DataFrame, *, text: str = "text", lang: str = "lang", source: str = "source", least_documents: int = LEAST_DOCUMENTS, smoothing: int = SMOOTHING, top: int = TOP) -> DataFrame:
    """lang, source, part, item, value and rank: for each source of a language, its distance to each other source (part pair),
    and the terms that it uses more than the language does (part term, top of them).

    Kept terms are those in at least least_documents documents of the language, over all its sources; rows of docs are documents,
    repeated ones too. Null texts, languages and sources count as empty strings. A source that occurs with a language is compared
    even if it has no term, with a value of 0 if the language keeps none; a language of one source has no pairs. Ranks are by
    value, descending, then by item in UTF-8 order. An empty table gives no rows; other columns are ignored.
    """
    blocks = written(term_blocks(docs, text=text, lang=lang, source=source, least_documents=least_documents), "blocks")
    groups = docs.select(_text(docs, lang).alias("lang"), _text(docs, source).alias("source")).distinct()
    sizes = blocks.select("lang", F.explode(F.arrays_zip("source", "n")).alias("x")).groupBy("lang", "x.source").agg(F.sum("x.n").alias("n"))
    kept = blocks.groupBy("lang").agg(F.sum(F.size("terms")).alias("kept"))
    met = groups.join(sizes, ["lang", "source"], "left").select("lang", "source", F.coalesce("n", F.lit(0)).alias("n"))
    # one row a language; its pairs are as many as the square of what it holds
    sources = written(met.groupBy("lang").agg(F.sort_array(F.collect_list(F.struct("source", "n"))).alias("sources")), "sources")
    # a language's blocks go to SPREAD keys, each with the language's sources
    spread = sources.join(kept, "lang").select("lang", "kept", F.col("sources.source").alias("sources"), F.col("sources.n").alias("sizes"), F.explode(F.sequence(F.lit(0), F.lit(SPREAD - 1))).alias("salt"))
    salted = blocks.withColumn("salt", F.pmod(F.hash(F.get("terms", F.lit(0))), F.lit(SPREAD)))
    parts = written(salted.join(spread, ["lang", "salt"]).drop("salt").mapInArrow(_compare(smoothing, top), "lang string, source string, part string, item string, value bigint"), "parts")
    names = sources.select("lang", F.explode("sources.source").alias("source"))
    none = names.join(names.withColumnRenamed("source", "item"), "lang").where("source < item").select("lang", "source", "item", F.lit(0).cast("long").alias("value"))
    apart = parts.where("part = 'pair'").select("lang", "source", "item", "value").unionByName(none).groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    both = apart.select("lang", F.explode(F.array(F.struct("source", "item"), F.struct(F.col("item").alias("source"), F.col("source").alias("item")))).alias("x"), "value").select("lang", "x.source", "x.item", "value")
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    pairs = both.withColumn("rank", F.row_number().over(order)).withColumn("part", F.lit("pair"))
    terms = parts.where("part = 'term'").drop("part").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top).withColumn("part", F.lit("term"))
    return pairs.unionByName(terms).select("lang", "source", "part", "item", "value", "rank")
