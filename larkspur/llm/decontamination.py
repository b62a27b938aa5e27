"""Benchmark decontamination with one Aho-Corasick automaton over normalised benchmark texts.

Normalised text: A-Z lower-cased, words of ASCII digits, letters and all characters beyond ASCII, one space between.
The automaton holds every window of `WINDOW` consecutive words of every item; an item with fewer words is one window.
Each document is scanned once; matches are mapped back to word numbers and to code points of the original text.

The benchmark's windows go to the executors in blocks of at most `MAX_BLOCK` words, so what is broadcast is bounded; more
blocks mean more automata that a worker scans with in turn. A benchmark of more than `MAX_WORDS` words is taken in
parts of about that size, one pass over the documents for each, whose hits are joined.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larkspur.llm.common import held, written

WINDOW = 13
#: Words of benchmark items in one automaton, at most: each word starts a window of some 90 bytes of automaton nodes.
MAX_BLOCK = 50_000
#: Words of the items that are collected and broadcast at once, about; a larger benchmark is scanned in parts.
MAX_WORDS = 5_000_000

_KEPT = set(range(0x30, 0x3A)) | set(range(0x61, 0x7B)) | set(range(0x80, 0x100))
#: Bytes of UTF-8: A-Z to a-z, what belongs to no word to a space.
_NORMAL = bytes(b + 32 if 0x41 <= b <= 0x5A else b if b in _KEPT else 0x20 for b in range(256))
RESULT = "struct<n_words:bigint,n_hit:bigint,items:array<string>,spans:array<struct<start:int,end:int>>>"


def words_of(text: str) -> list[bytes]:
    return text.encode().translate(_NORMAL).split()


class Windows:
    """An automaton over the windows of some items. A word is its UTF-8 bytes; spaces stand around each."""

    def __init__(self, items: list[tuple[str, str]], window: int) -> None:
        owners: dict[bytes, tuple[int, set[str]]] = {}
        for item, text in items:
            words = words_of(text)
            for i in range(max(1, len(words) - window + 1)) if words else ():
                part = words[i : i + window]
                owners.setdefault(b" " + b" ".join(part) + b" ", (len(part), set()))[1].add(item)
        self.automaton = None
        if owners:
            self.automaton = ahocorasick.Automaton()
            for key, found in owners.items():
                self.automaton.add_word(key.decode("latin-1"), found)
            self.automaton.make_automaton()

    def scan(self, line: str) -> list[tuple[int, int, set[str]]]:
        """(place after the closing space, words, items) of each occurrence in a normalised line."""
        if self.automaton is None:
            return []
        return [(end + 1, n, items) for end, (n, items) in self.automaton.iter(line)]


def _places(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Code points of the original text where its words start and end."""
    data = text.encode()
    raw = np.frombuffer(data.translate(_NORMAL), np.uint8) != 0x20
    edge = np.diff(np.concatenate([[0], raw.view(np.int8), [0]]))
    points = np.concatenate([[0], np.cumsum((np.frombuffer(data, np.uint8) & 0xC0) != 0x80)])
    return points[np.flatnonzero(edge == 1)], points[np.flatnonzero(edge == -1)]


def _spans(text: str, hit: np.ndarray) -> list[dict[str, int]]:
    """Runs of hit words as code points of the original text, from the first word's start to the last one's end."""
    starts, ends = _places(text)
    runs = np.diff(np.concatenate([[0], hit.view(np.int8), [0]]))
    return [{"start": int(starts[a]), "end": int(ends[b - 1])} for a, b in zip(np.flatnonzero(runs == 1), np.flatnonzero(runs == -1), strict=True)]


def _within(text: str, spans: list[dict[str, int]]) -> np.ndarray:
    """Which words of the text the spans cover: what _spans() was given."""
    starts, _ = _places(text)
    cover = np.zeros(len(starts) + 1, np.int64)
    np.add.at(cover, np.searchsorted(starts, [x["start"] for x in spans]), 1)
    np.add.at(cover, np.searchsorted(starts, [x["end"] for x in spans]), -1)
    return np.cumsum(cover[:-1]) > 0


def _scan(text: str | None, automata: list[Windows], earlier: dict | None = None) -> dict:
    """Hits of the automata in one scan, joined with those of an earlier part of the benchmark."""
    words = words_of(text or "")
    line = (b" " + b" ".join(words) + b" ").decode("latin-1")
    found = [x for a in automata for x in a.scan(line)]
    if not found:
        return earlier or {"n_words": len(words), "n_hit": 0, "items": [], "spans": []}
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) + 1  # after the space that closes each word
    cover = np.zeros(len(words) + 1, np.int64)
    last = np.searchsorted(ends, np.array([x[0] for x in found])) + 1
    np.add.at(cover, last - np.array([x[1] for x in found]), 1)
    np.add.at(cover, last, -1)
    hit, items = np.cumsum(cover[:-1]) > 0, set().union(*(x[2] for x in found))
    if earlier and earlier["spans"]:
        hit, items = hit | _within(text, earlier["spans"]), items | set(earlier["items"])
    return {"n_words": len(words), "n_hit": int(hit.sum()), "items": sorted(items), "spans": _spans(text, hit)}


def _automata(blocks: list[list[tuple[str, str]]], window: int) -> list[Windows]:
    key = hashlib.sha256(repr((blocks, window)).encode()).hexdigest()
    return held(key, lambda: [Windows(b, window) for b in blocks])


def benchmark_items(benchmark: DataFrame, *, item_id: str = "item_id", text: str = "text") -> DataFrame:
    """item and text of the distinct items that have both."""
    return benchmark.select(F.col(f"`{item_id}`").cast("string").alias("item"), F.col(f"`{text}`").alias("text")).where("item IS NOT NULL AND text IS NOT NULL").distinct()


def parts_of(items: DataFrame, max_words: int) -> int:
    """Parts of at most about max_words words: a word and the space after it have two bytes at least."""
    return int((items.agg(F.sum(F.octet_length("text") / 2 + 1)).first()[0] or 0) // max_words) + 1


def item_blocks(items: DataFrame) -> list[list[tuple[str, str]]]:
    """The items of one part, collected, in blocks of some MAX_BLOCK words."""
    blocks: list[list[tuple[str, str]]] = [[]]
    size = 0
    for r in sorted(items.collect()):
        size += len(r["text"]) // 2 + 1
        if blocks[-1] and size > MAX_BLOCK:
            blocks.append([])
            size = len(r["text"]) // 2 + 1
        blocks[-1].append((r["item"], r["text"]))
    return blocks


def scanned(text: Column, spark, blocks: list[list[tuple[str, str]]], window: int = WINDOW, earlier: Column | None = None) -> Column:
    shared = spark.sparkContext.broadcast(blocks)

    @F.arrow_udf(RESULT)
    def scan(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        automata = _automata(shared.value, window)
        kind = pa.struct([("n_words", pa.int64()), ("n_hit", pa.int64()), ("items", pa.list_(pa.string())), ("spans", pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])))])
        for texts, found in batches:
            yield pa.array([_scan(x.as_py(), automata, y.as_py()) for x, y in zip(texts, found, strict=True)], kind)

    return scan(text, F.lit(None).cast(RESULT) if earlier is None else earlier)


def decontaminate(docs: DataFrame, benchmark: DataFrame, *, text: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = WINDOW, least_share: int = 20, max_words: int = MAX_WORDS) -> DataFrame:
    """docs with n_words, n_hit, items (ids as sorted strings), spans (of hit words, in code points) and contaminated.

    contaminated: a word is hit, and at least one in least_share of the words is. Null and empty texts have no words.
    Items without words match nothing, repeated items count once, an empty benchmark hits nothing. Columns of docs with
    these names are replaced. Nothing is shuffled. A benchmark of more than max_words words takes a pass for each part.
    """
    items = benchmark_items(benchmark, item_id=item_id, text=item_text)
    parts = parts_of(items, max_words)
    rows = docs.drop("n_words", "n_hit", "items", "spans", "contaminated")
    for k in range(parts):
        own = item_blocks(items.where(F.pmod(F.xxhash64("item", "text"), F.lit(parts)) == k))
        if k:
            rows = written(rows, "scanned")  # a worker holds the automata of one part only
        rows = rows.withColumn("_found", scanned(F.col(f"`{text}`"), docs.sparkSession, own, window, F.col("_found") if k else None))
    rows = rows.select(*[F.col(f"`{c}`") for c in rows.columns if c != "_found"], "_found.*")
    return rows.withColumn("contaminated", (F.col("n_hit") > 0) & (least_share * F.col("n_hit") >= F.col("n_words")))
