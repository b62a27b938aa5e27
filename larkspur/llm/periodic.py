"""Periodic runs of words, by the names of Karp, Miller and Rosenberg.

A run is a stretch of words with smallest period q, at least max(LEAST, 2 q) words long, that no neighbouring word extends
with that period. The words of a document are named by number; level k names the stretches of 2^k words from each place, a
pair of names of level k - 1 each, by sorting the pairs. Only stretches that occur twice in their document need a name of
their own, so the levels end where nothing is repeated any more. How far the words from two places agree, forwards or
backwards, is read from the names by descending levels, exactly.

A run of period p holds two neighbours of the grid 0, p, 2p, ... that agree, and so do four words that begin or end there. The
grids of all p have n ln n places for n words; those that pass this test are extended in both directions.

Everything happens in tasks, some CHUNK bytes of text at a time, documents of a chunk together; a longer text is a chunk of its
own. A task holds about 100 bytes a word of its chunk, and 4 more for each level; nothing is shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LEAST = 12
#: Bytes of text, and places of grids, that are looked at together.
CHUNK, PLACES = 1_500_000, 1 << 20
RESULT = "struct<n_words:bigint,runs:array<struct<start:bigint,length:bigint,period:bigint>>,collapsed:string>"


def numbered(documents: list[list[bytes]]) -> np.ndarray:
    """A number for each word; the same for the same words of one document, never for words of two documents."""
    out, base = [], 0
    for words in documents:
        known: dict[bytes, int] = {}
        out += [base + known.setdefault(w, len(known)) for w in words]
        base += len(known)
    return np.array(out, np.int64)


def _levels(numbers: np.ndarray) -> list[np.ndarray]:
    """For each level, the name of each place: 0 or more if that stretch occurs again, else a negative of its own.

    One more place at the end agrees with none.
    """
    n = len(numbers)
    own = -1 - np.arange(n + 1, dtype=np.int32)
    many = np.bincount(numbers, minlength=1)[numbers] > 1
    names = own.copy()
    names[:-1][many] = numbers[many]
    out, size = [], 1
    while (names >= 0).any():
        out.append(names)
        at = np.flatnonzero(names[:-1] >= 0)
        at = at[at + size < n]
        at = at[names[at + size] >= 0]
        _, name, count = np.unique(names[at].astype(np.int64) * (n + 1) + names[at + size], return_inverse=True, return_counts=True)
        again = count[name] > 1
        names = own.copy()
        names[at[again]] = name[again]
        size *= 2
    return out


def _ahead(levels: list[np.ndarray], i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The first place from j on that differs from its counterpart from i on; i < j."""
    i, j = i.copy(), j.copy()
    for k in reversed(range(len(levels))):
        step = (levels[k][i] == levels[k][j]).astype(np.int64) << k
        i += step
        j += step
    return j


def _behind(levels: list[np.ndarray], i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The first place before i from which on all up to i equals its counterpart before j; i < j."""
    i, j = i.copy(), j.copy()
    for k in reversed(range(len(levels))):
        a, b = i - (1 << k), j - (1 << k)
        same = (a >= 0) & (levels[k][np.maximum(a, 0)] == levels[k][np.maximum(b, 0)])
        i, j = np.where(same, a, i), np.where(same, b, j)
    return i


def _grids(starts: np.ndarray, sizes: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places and periods of the grids of all documents, some PLACES at a time. A document's grids begin with it."""
    halves = sizes // 2
    document = np.repeat(np.arange(len(sizes)), halves)
    period = np.arange(len(document)) - np.repeat(np.cumsum(halves) - halves, halves) + 1
    count = (sizes[document] - 1) // period
    part = (np.cumsum(count) - count) // PLACES
    cuts = [*np.flatnonzero(np.diff(part, prepend=-1)).tolist(), len(part)]
    for a, b in zip(cuts, cuts[1:], strict=False):
        c = count[a:b]
        p = np.repeat(period[a:b], c)
        nth = np.arange(len(p)) - np.repeat(np.cumsum(c) - c, c)
        yield np.repeat(starts[document[a:b]], c) + nth * p, p


def find_runs(numbers: np.ndarray, starts: np.ndarray, sizes: np.ndarray, least: int = LEAST) -> np.ndarray:
    """Rows (start, end, period) of all runs, in the order of start, then period. Documents share no number."""
    levels = _levels(numbers)
    # words that agree with those p later are Z = max(p, least - p) or more in a row, and s of them begin or end at each of them
    # if 2 s - 2 <= Z
    reach = (((least + 1) // 2 + 2) // 2).bit_length() - 1
    if len(levels) <= reach:
        return np.empty((0, 3), np.int64)
    size, names = 1 << reach, levels[reach]
    again = np.unique(np.searchsorted(starts, np.flatnonzero(names[:-1] >= 0), "right") - 1)
    again = again[sizes[again] >= least]
    found = []
    for i, p in _grids(starts[again], sizes[again]):
        back = i - size + 1
        near = (names[i] == names[i + p]) | ((back >= 0) & (names[np.maximum(back, 0)] == names[np.maximum(back, 0) + p]))
        i, p = i[near], p[near]
        start, end = _behind(levels, i, i + p), _ahead(levels, i, i + p)
        whole = end - start >= np.maximum(least, 2 * p)
        found.append(np.unique(np.stack([start, end, p], 1)[whole], axis=0))
    rows = np.concatenate([*found, np.empty((0, 3), np.int64)])
    rows = rows[np.lexsort((rows[:, 2], rows[:, 1], rows[:, 0]))]
    # a stretch that has period q has its multiples too; the least is the run's
    first = np.ones(len(rows), bool)
    first[1:] = (rows[1:, :2] != rows[:-1, :2]).any(1)
    rows = rows[first]
    return rows[np.lexsort((rows[:, 2], rows[:, 0]))]


def _chunk(texts: list[bytes | None], least: int) -> pa.Array:
    documents = [(x or b"").split() for x in texts]  # of bytes: at ASCII white space only
    sizes = np.array([len(w) for w in documents], np.int64)
    starts = np.cumsum(sizes) - sizes
    rows = find_runs(numbered(documents), starts, sizes, least)
    # documents without words begin where the next one does; the last to begin at a place is the one that has words
    owner = np.searchsorted(starts, rows[:, 0], "right") - 1
    ends = np.searchsorted(owner, np.arange(len(texts)), "right")
    collapsed = []
    for k, words in enumerate(documents):
        own = rows[ends[k - 1] if k else 0 : ends[k]]
        if len(own):
            edge = np.zeros(len(words) + 1, np.int64)
            np.add.at(edge, own[:, 0] - starts[k] + own[:, 2], 1)
            np.add.at(edge, own[:, 1] - starts[k], -1)
            words = compress(words, (np.cumsum(edge)[:-1] == 0).tolist())
        collapsed.append(b" ".join(words))
    runs = pa.StructArray.from_arrays([pa.array(rows[:, 0] - starts[owner]), pa.array(rows[:, 1] - rows[:, 0]), pa.array(rows[:, 2])], ["start", "length", "period"])
    lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]), pa.int32()), runs)
    return pa.StructArray.from_arrays([pa.array(sizes), lists, pa.array(collapsed, pa.binary()).cast(pa.string())], ["n_words", "runs", "collapsed"])


def runs_of(text: Column, least: int = LEAST) -> Column:
    """struct(n_words, runs, collapsed) of a text: runs by start, then period, in words from 0; collapsed is the text without the
    words that any run holds after its first period, joined by one space. Null and empty texts have no words and no runs."""

    @F.arrow_udf(RESULT)
    def found(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            data = batch.cast(pa.binary())
            part = np.cumsum(pc.fill_null(pc.binary_length(data), 0).to_numpy(False).astype(np.int64)) // CHUNK
            cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(data)]
            for a, b in zip(cuts, cuts[1:], strict=False):
                if a < b:
                    yield _chunk(data.slice(a, b - a).to_pylist(), least)

    return found(text)


def collapse(docs: DataFrame, *, text: str = "text", least: int = LEAST) -> DataFrame:
    """docs with n_words, runs and collapsed; columns of these names are replaced.

    Every row is kept, repeated ones too, and none is moved; null and empty texts give no words, no runs and an empty text; an
    empty table gives no rows. A word at which several runs meet is dropped if any of them drops it.
    """
    rows = docs.drop("n_words", "runs", "collapsed")
    return rows.select(F.struct(*[F.col(f"`{c}`") for c in rows.columns]).alias("row"), runs_of(F.col(f"`{text}`"), least).alias("found")).select("row.*", "found.*")


def digest(df: DataFrame) -> DataFrame:
    """df with n_runs, the greatest run's start, length, period and exponent_milli, runs_sha256 and collapsed_sha256 in place of
    n_words, runs and collapsed. The greatest run is the longest; of equally long ones the first, then that of least period."""
    own = F.col("runs")
    best = F.array_max(F.transform(own, lambda r: F.struct(r.length.alias("length"), (-r.start).alias("start"), (-r.period).alias("period"))))
    lines = F.array_join(F.transform(own, lambda r: F.concat_ws(",", r.start, r.length, r.period)), "\n")
    out = df.withColumns({
        "n_runs": F.size(own).cast("bigint"), "start": -best.start, "length": best.length, "period": -best.period,
        "exponent_milli": F.floor(1000 * best.length / -best.period).cast("bigint"),
        "runs_sha256": F.sha2(F.when(F.size(own) > 0, F.concat(lines, F.lit("\n"))).otherwise("").cast("binary"), 256), "collapsed_sha256": F.sha2(F.col("collapsed").cast("binary"), 256),
    })
    return out.drop("n_words", "runs", "collapsed")
