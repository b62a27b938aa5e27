"""A hierarchical Pitman-Yor language model of word sequences: three words, two, one.

Every context has a restaurant. Its customers are the tokens that follow the context (for two words) or the tables of the
longer contexts that end in it (for one word, and for none); each table serves one word. A customer sits down at a table of
its word, or opens one with the shorter context's probability of the word; that table is a customer of the shorter context.
The shortest one opens tables by a uniform distribution over the training words and one unknown word.

Seatings are sampled by Gibbs sweeps. A sweep takes the customers of every (context, word) out one by one and seats each
anew, given all others; what matters of a seating is its number of tables, so the arrangement at the tables is summed out
(the chance that a customer sat alone is a ratio of generalised Stirling numbers). Words of one restaurant are sampled side
by side: each sees the others' tables as they were when the sweep began. Draws are hashes of the words, the sweep and the
step, so scores don't depend on partitions. Probabilities are averaged over the sweeps after the burn-in.

How it runs. Documents become blocks of numbers with a dictionary each; dictionaries meet in one shuffle that counts and
numbers all words. Tokens are then dealt by the word before them, packed in columns, so that a one-word context and all
two-word contexts that end in it are in one task. Tables of the one-word contexts go to the words' own tasks, and the
words' probabilities come back. A one-word context that more than `LIMIT` tokens follow is divided by a hash of the word
before it into contexts of about that size, so no context is larger than a task; two-word contexts stay whole.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larkspur.llm.charlm import mix
from larkspur.llm.common import dropped, written

#: Gibbs sweeps of a round, those of them before averaging, and rounds: after each, the words' own restaurant is seated anew.
SWEEPS, BURN_IN, ROUNDS = 4, 2, 2
STRENGTH = 1.0
#: Customers of one (context, word) that are taken out, or seated, one at a time; what is beyond goes by jumps. RATIOS at most.
RESEATED = 64
#: Customers and tables for which the ratios of Stirling numbers are held; beyond, they follow their scaling in customers.
RATIOS = 256
#: Tokens of a block, tokens of a task's contexts (about), tokens that follow one word before its context is divided.
BLOCK_TOKENS, TASK_TOKENS, LIMIT = 1_000_000, 500_000, 250_000
#: Partitions of a shuffle, at most; beyond, a partition has several tasks' contexts, one after another.
MAX_PARTITIONS = 20_000
#: Bytes of text for each task that numbers words.
WORD_BYTES = 32_000_000
#: Log probabilities are summed as integers of this fraction, so that their order doesn't matter.
_UNIT = float(1 << 30)
#: Bytes of text that are split into words at once.
_SLICE = 4_000_000
#: Draws that are made at once for cells of many steps.
_DRAWS = 4096
_UNKNOWN = 0
_ROWS = "kind int, block bigint, place bigint, n bigint, m bigint, x double, held boolean, a binary, b binary"
_DOC, _TOKENS, _WORDS, _NUMBERS, _FACTS, _SCORED, _GRAMS, _BASE, _TABLES, _SUMS = range(10)


def words_of(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The words of all texts, and their number in each: A-Z lower-cased; maximal runs other than ASCII white space."""
    lists = pc.ascii_split_whitespace(pc.ascii_lower(texts.fill_null("")))
    words = lists.flatten()
    full = pc.greater(pc.binary_length(words), 0)
    seen = np.concatenate([[0], np.cumsum(full.to_numpy(zero_copy_only=False))])
    ends = np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy())])
    return words.filter(full).cast(pa.large_binary()), np.diff(seen[ends])


def _slices(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """The batch in slices of about _SLICE bytes of text."""
    ends = np.cumsum(pc.binary_length(batch["text"].fill_null("")).to_numpy().astype(np.int64)) // _SLICE
    cuts = np.append(np.flatnonzero(np.diff(ends, prepend=-1)), batch.num_rows)
    for a, b in zip(cuts, cuts[1:], strict=False):
        yield batch.slice(a, b - a)


def _flat(words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The sizes of words and their bytes, one after another."""
    _, ends, data = words.buffers()
    ends = np.frombuffer(ends, np.int64, len(words) + 1, words.offset * 8)
    return np.diff(ends), np.frombuffer(data or b"", np.uint8)[ends[0] : ends[-1]]


def pack(*columns: np.ndarray) -> bytes:
    """Columns of non-negative integers as planes of bytes, compressed."""
    out = []
    for c in columns:
        c = np.ascontiguousarray(c, "<u8")
        width = max(1, (int(c.max()).bit_length() + 7) // 8) if len(c) else 1
        out += [np.array([len(c), width], "<u8").tobytes(), *((c >> np.uint64(8 * k)).astype(np.uint8).tobytes() for k in range(width))]
    raw = b"".join(out)
    return np.array([len(raw)], "<u8").tobytes() + pa.Codec("zstd").compress(raw, asbytes=True)


def unpack(data: bytes) -> list[np.ndarray]:
    raw = pa.Codec("zstd").decompress(data[8:], int(np.frombuffer(data[:8], "<u8")[0]), asbytes=True)
    out, at = [], 0
    while at < len(raw):
        n, width = (int(x) for x in np.frombuffer(raw, "<u8", 2, at))
        at += 16
        c = np.frombuffer(raw, np.uint8, n, at).astype(np.int64)
        for k in range(1, width):
            c |= np.frombuffer(raw, np.uint8, n, at + k * n).astype(np.int64) << (8 * k)
        out.append(c)
        at += n * width
    return out


def _batch(rows: list[dict], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist(rows, schema)


def _grouped(batches: Iterator[pa.RecordBatch], by: str) -> Iterator[tuple[int, list[dict]]]:
    """The rows of each group of a sorted input."""
    at, held = None, []
    for batch in batches:
        for row in (r for i in range(0, batch.num_rows, 256) for r in batch.slice(i, 256).to_pylist()):
            if held and row[by] != at:
                yield at, held
                held = []
            at = row[by]
            held.append(row)
    if held:
        yield at, held


def _schema(id_type: pa.DataType) -> pa.Schema:
    kinds = {"int": pa.int32(), "bigint": pa.int64(), "double": pa.float64(), "boolean": pa.bool_(), "binary": pa.binary()}
    return pa.schema([("doc_id", id_type), *((n, kinds[t]) for n, t in (c.split() for c in _ROWS.split(", ")))])


# --- blocks, words and their numbers ---


def _encode(parts: int):
    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Documents as numbers of their block's dictionary, and the dictionaries, dealt by hashes of the words."""
        block, schema = TaskContext.get().partitionId() << 32, None
        docs: list[tuple] = []
        texts: list[pa.Array] = []
        size = 0

        def flush() -> pa.RecordBatch:
            coded = pa.concat_arrays([*texts, pa.array([b""], pa.large_binary())]).dictionary_encode()
            words, ids = coded.dictionary, coded.indices.to_numpy().astype(np.int64)
            place = _word_parts(words, parts)
            order = np.argsort(place, kind="stable")
            number = np.empty(len(words), np.int64)
            number[order] = np.arange(len(words))
            end, ids = number[ids[-1]], number[ids[:-1]]
            counts = np.zeros(len(words), np.int64)
            held_out = np.repeat([d[1] for d in docs], [d[2] for d in docs])
            counts += np.bincount(ids[~held_out.astype(bool)], minlength=len(words))
            counts[end] += sum(not d[1] for d in docs)
            rows = [{"kind": _DOC, "doc_id": doc_id, "block": block, "place": i, "held": held, "n": n + 1} for i, (doc_id, held, n) in enumerate(docs)]
            rows.append({"kind": _TOKENS, "block": block, "a": pack(np.insert(ids, np.cumsum([d[2] for d in docs]), end))})
            cuts = np.searchsorted(place[order], np.arange(parts + 1))
            own = words.take(pa.array(order))
            for p in np.flatnonzero(np.diff(cuts)).tolist():
                part = slice(int(cuts[p]), int(cuts[p + 1]))
                rows.append({"kind": _WORDS, "block": block, "place": p, "n": part.start, "a": pack(*_flat(own[part])), "b": pack(counts[part])})
            return _batch(rows, schema)

        for batch in batches:
            schema = schema or _schema(batch["doc_id"].type)
            for part in _slices(batch):
                words, n = words_of(part["text"])
                texts.append(words)
                docs += zip(part["doc_id"].to_pylist(), part["held"].to_pylist(), n.tolist(), strict=True)
                size += len(words) + len(n)
                if size >= BLOCK_TOKENS:
                    yield flush()
                    block, docs, texts, size = block + 1, [], [], 0
        if docs:
            yield flush()

    return encode


def _word_parts(words: pa.Array, parts: int) -> np.ndarray:
    """The task of each word: a hash of its first bytes and its length, in numpy."""
    sizes, data = _flat(words)
    h = mix(np.uint64(5), sizes.astype(np.uint64))
    data, starts = np.append(data, np.zeros(8, np.uint8)).astype(np.uint64), np.cumsum(sizes) - sizes
    for k in range(8):
        h = mix(h, np.where(sizes > k, data[np.minimum(starts + k, len(data) - 1)], np.uint64(0)))
    return (h % np.uint64(parts)).astype(np.int64)


def _number(parts: int):
    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Corpus counts and numbers of the words of each part: small ones for frequent words, 0 for words unknown in training."""
        schema = None
        for place, rows in _grouped(batches, "place"):
            schema = schema or _schema(pa.int64())
            own, counts = [], []
            for r in rows:
                sizes, data = unpack(r["a"])
                ends = pa.py_buffer(np.concatenate([[0], np.cumsum(sizes)]).astype("<i8"))
                own.append(pa.Array.from_buffers(pa.large_binary(), len(sizes), [None, ends, pa.py_buffer(data.astype(np.uint8))]))
                counts.append(unpack(r["b"])[0])
            coded = pa.concat_arrays(own).dictionary_encode()
            words, index = coded.dictionary, coded.indices.to_numpy()
            total = np.bincount(index, np.concatenate(counts), len(words)).astype(np.int64)
            order = pc.sort_indices(pa.table({"n": total, "w": words}), [("n", "descending"), ("w", "ascending")]).to_numpy()
            ids = np.empty(len(words), np.int64)
            ids[order] = np.arange(1, len(words) + 1) * parts + place
            ids[total == 0] = _UNKNOWN
            own = np.split(index, np.cumsum([len(x) for x in own])[:-1])
            yield _batch([{"kind": _NUMBERS, "block": r["block"], "place": r["n"], "a": pack(ids[o]), "b": pack(total[o])} for r, o in zip(rows, own, strict=True)], schema)
            end = pc.index(words, pa.scalar(b"", pa.large_binary())).as_py()
            yield _batch([{"kind": _FACTS, "n": int(total.sum()), "m": int((total > 0).sum()), "place": None if end < 0 else int(ids[end])}], schema)

    return number


# --- tokens, dealt by the word before them ---


def _deal(tokens: int, kinds: int, end: int, tasks: int):
    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = None
        for block, rows in _grouped(batches, "block"):
            schema = schema or _schema(batches_type[0])
            tables = sorted((r for r in rows if r["kind"] == _NUMBERS), key=lambda r: r["place"])
            ids = np.concatenate([unpack(r["a"])[0] for r in tables])
            counts = np.concatenate([unpack(r["b"])[0] for r in tables])
            bases = np.log10((counts + 1) / (tokens + kinds + 1))
            known, own = np.unique(ids, return_inverse=True)
            # each word before a token has a slot for each of its divisions; slots are in the order of words
            divisions = np.zeros(len(known), np.int64)
            np.maximum.at(divisions, own, counts // LIMIT + 1)
            slots = np.cumsum(divisions) - divisions
            start, out = int(np.searchsorted(known, end)), []
            docs = sorted((r for r in rows if r["kind"] == _DOC), key=lambda r: r["place"])
            (local,) = (unpack(r["a"])[0] for r in rows if r["kind"] == _TOKENS)
            n = np.array([r["n"] for r in docs])
            first = np.cumsum(n) - n
            seen, logs = np.add.reduceat(counts[local] > 0, first, dtype=np.int64).tolist(), bases[local]
            for r, m, at in zip(docs, seen, first.tolist(), strict=True):
                out.append({"kind": _SCORED, "doc_id": r["doc_id"], "block": block, "place": r["place"], "held": r["held"], "n": r["n"], "m": m, "x": float(logs[at : at + r["n"]].sum())})
            w, w1, w2 = own[local], np.full(len(local), start), np.full(len(local), start)
            w2[1:], w1[2:] = w[:-1], w[:-2]
            w2[first], w1[first], w1[(first + 1)[n > 1]] = start, start, start
            doc = np.repeat([r["place"] * 2 + r["held"] for r in docs], n)
            slot = slots[w2]
            many = np.flatnonzero((divisions[w2] > 1) & (w2 != start))  # the end is before first tokens alone
            slot[many] += (mix(np.uint64(3), known[w1[many]].astype(np.uint64)) % divisions[w2[many]].astype(np.uint64)).astype(np.int64)
            # slots and places in one number: sorting numbers is much faster than sorting places by slots
            order = np.sort(slot * len(slot) + np.arange(len(slot))) % len(slot)
            begins = np.flatnonzero(np.diff(slot[order], prepend=-1))
            sizes, first = np.diff(np.append(begins, len(order))), order[begins]
            task = (mix(mix(np.uint64(11), known[w2[first]].astype(np.uint64)), (slot - slots[w2])[first].astype(np.uint64)) % np.uint64(tasks)).astype(np.int64)
            by = np.argsort(task, kind="stable")
            order = order[np.repeat(begins[by] - np.cumsum(sizes[by]) + sizes[by], sizes[by]) + np.arange(len(order))]
            division, task = (slot - slots[w2])[order], np.repeat(task[by], sizes[by])
            w2, w1, w, doc = known[w2[order]], known[w1[order]], known[w[order]], doc[order]
            cuts = np.append(np.flatnonzero(np.diff(task, prepend=-1)), len(task))
            for a, b in zip(cuts, cuts[1:], strict=False):
                runs = np.append(np.flatnonzero((np.diff(w2[a:b], prepend=-1) != 0) | (np.diff(division[a:b], prepend=-1) != 0)), b - a)
                contexts = np.diff(w2[a:b][runs[:-1]], prepend=0), division[a:b][runs[:-1]]
                out.append({"kind": _GRAMS, "block": block, "place": int(task[a]), "a": pack(*contexts, np.diff(runs), w1[a:b], w[a:b], doc[a:b])})
            yield _batch(out, schema)

    batches_type: list[pa.DataType] = []

    def typed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def seen() -> Iterator[pa.RecordBatch]:
            for batch in batches:
                batches_type[:] = [batch.schema.field("doc_id").type]
                yield batch

        yield from deal(seen())

    return typed


# --- seatings ---


@lru_cache(maxsize=8)
def alone(discount: float, size: int = RATIOS) -> np.ndarray:
    """[c, t]: the chance that the last of c customers at t tables sits alone: S(c - 1, t - 1) / S(c, t)."""
    out = np.zeros((size + 1, size + 2))
    log = np.full(size + 2, -np.inf)
    log[1] = 0.0
    out[1, 1] = 1.0
    t = np.arange(size + 2)
    with np.errstate(divide="ignore", invalid="ignore"):
        for c in range(2, size + 1):
            opened = np.concatenate([[-np.inf], log[:-1]])
            now = np.logaddexp(opened, np.log(np.maximum(c - 1 - discount * t, 0)) + log)
            out[c] = np.where(np.isfinite(now), np.exp(opened - now), 0.0)
            log = now
    return out


def leaves_alone(c: np.ndarray, t: np.ndarray, discount: float) -> np.ndarray:
    table = alone(discount)
    few = c <= RATIOS
    if few.all():
        return table[c, t]
    out, many = table[np.minimum(c, RATIOS), np.minimum(t, RATIOS)], np.flatnonzero(~few)
    out[many] = alone_of_many(c[many], t[many], (RATIOS / c[many]) ** discount, discount)
    return out


def alone_of_many(c: np.ndarray, t: np.ndarray, scale: np.ndarray, discount: float) -> np.ndarray:
    """Beyond RATIOS customers; scale: (RATIOS / c) ** discount. R(c, t) (c - 1) / (t - 1) depends on t / c ** discount alone there."""
    like = np.minimum(np.maximum(np.rint(t * scale), 2), RATIOS).astype(np.int64)
    return np.minimum(alone(discount)[RATIOS].take(like) * (RATIOS - 1) / (like - 1) * (t - 1) / (c - 1), 1.0)


def uniform(seed: np.ndarray, *steps: int) -> tuple[np.ndarray, np.ndarray]:
    """Two draws for each seed, from the halves of one hash."""
    h = seed
    for s in steps:
        h = mix(h, np.uint64(s))
    return _high(h), _low(h)


def _high(h: np.ndarray) -> np.ndarray:
    return (h >> np.uint64(32)).astype(np.float64) * 2.0**-32


def _low(h: np.ndarray) -> np.ndarray:
    return (h & np.uint64(0xFFFFFFFF)).astype(np.float64) * 2.0**-32


@dataclass
class Level:
    """The (context, word) cells of one context length, in the order of contexts: customers, tables, and their contexts."""

    c: np.ndarray
    t: np.ndarray
    context: np.ndarray
    contexts: int
    seed: np.ndarray
    discount: float

    def __post_init__(self) -> None:
        self.starts = np.flatnonzero(np.diff(self.context, prepend=-1))

    def tables(self) -> np.ndarray:
        """Tables of each context."""
        return np.add.reduceat(self.t, self.starts)

    def predict(self, above: np.ndarray, at: np.ndarray | slice = slice(None)) -> np.ndarray:
        """The probabilities of the cells at these places; above: those of their words in the shorter contexts."""
        customers = np.add.reduceat(self.c, self.starts)
        rest = (STRENGTH + self.discount * self.tables()) / (STRENGTH + customers)
        context = self.context[at]
        return np.maximum(self.c[at] - self.discount * self.t[at], 0) / (STRENGTH + customers)[context] + rest[context] * above

    def several(self) -> np.ndarray:
        """The cells of more than one customer, those of most first."""
        at = np.flatnonzero(self.c > 1)
        # no step tells more than RATIOS customers apart, and numbers of 16 bits are sorted by radix
        return at[np.argsort(RATIOS + 1 - np.minimum(self.c[at], RATIOS + 1).astype(np.uint16), kind="stable")]

    def _opens(self, t: np.ndarray, seated: np.ndarray, others: np.ndarray, above: np.ndarray, draw: np.ndarray) -> np.ndarray:
        new = (STRENGTH + self.discount * (others + t)) * above
        return draw * (new + np.maximum(seated - self.discount * t, 0)) < new

    def sweep(self, above: np.ndarray, number: int, others: np.ndarray | None = None, at: np.ndarray | None = None) -> None:
        """Takes customers out one by one and seats each anew. A single customer always has a table of its own.

        others: tables of the other words of each cell's context, where they aren't all here. at: what several() says, if
        above and others are of those cells only.
        """
        if at is None:
            at = self.several()
            above, others = above[at], None if others is None else others[at]
        if others is None:
            others = self.tables()[self.context[at]] - self.t[at]
        c, t, p, seed = self.c[at], self.t[at], above, mix(self.seed[at], np.uint64(number))
        table = alone(self.discount)
        few = np.minimum(c, RATIOS + 1)
        many, row = np.searchsorted(-few, -RATIOS), np.minimum(c, RATIOS) * table.shape[1]  # many: cells beyond the table
        left = np.searchsorted(-few, -np.arange(RESEATED), side="left")  # cells with more customers than the step's number
        scale = (RATIOS / c[:many]) ** self.discount
        for step in range(RESEATED):
            n = left[step]
            if not n:
                break
            off, on = uniform(seed[:n], step)
            leaves = table.ravel().take(row[:n] + np.minimum(t[:n], RATIOS))
            if many:
                leaves[:many] = alone_of_many(c[:many], t[:many], scale, self.discount)
            now = t[:n] - (off < leaves)
            t[:n] = now + self._opens(now, c[:n] - 1, others[:n], p[:n], on)
        n = np.searchsorted(-few, -RESEATED)
        if n:
            t[:n] = self._reseat_rest(c[:n], t[:n], others[:n], p[:n], seed[:n])
        self.t[at] = t

    def _reseat_rest(self, c: np.ndarray, t: np.ndarray, others: np.ndarray, p: np.ndarray, seed: np.ndarray) -> np.ndarray:
        """The tables after all customers beyond the first RESEATED were taken out and seated anew, by jumps from change to change.

        Most customers leave the number of tables as it is. As long as it stays, each changes it with the same chance, so the
        next that does is a geometric draw, and a second draw says whether a table is opened or closed: exactly what one
        customer after another would do, but the work is that of the changes.
        """
        out, at, rest, step = t.copy(), np.arange(len(c)), c - RESEATED, 0
        scale = (RATIOS / np.maximum(c, RATIOS)) ** self.discount
        few, row, table = c <= RATIOS, np.minimum(c, RATIOS) * (RATIOS + 2), alone(self.discount).ravel()
        while len(at):
            draw, turn = uniform(seed, 7, step)
            leaves = np.where(few, table.take(row + np.minimum(t, RATIOS)), alone_of_many(c, t, scale, self.discount))
            new = (STRENGTH + self.discount * (others + t)) * p
            up = (1 - leaves) * new / (new + np.maximum(c - 1 - self.discount * t, 0))
            new, stays = new - self.discount * p, np.maximum(c - 1 - self.discount * (t - 1), 0)
            down = leaves * stays / (new + stays)
            with np.errstate(divide="ignore"):
                rest = rest - 1 - np.floor(np.log1p(-draw) / np.log1p(-np.minimum(up + down, 1)))
            on = rest >= 0
            t = t + on * np.where(turn * (up + down) < up, 1, -1)
            step += 1
            if not (rest > 0).all():
                out[at] = t
                on = rest > 0
                at, c, t, others, p, seed, rest, scale, few, row = (x[on] for x in (at, c, t, others, p, seed, rest, scale, few, row))
        return out

    def adjust(self, c: np.ndarray, above: np.ndarray, number: int) -> None:
        """Takes out or seats the customers by which the counts have changed."""
        changed = np.flatnonzero(self.c != c)
        by = (c - self.c)[changed]
        others = self.tables()[self.context[changed]] - self.t[changed]
        for seated in (True, False):
            own = np.flatnonzero(by > 0 if seated else by < 0)
            own = own[np.argsort(-np.abs(by[own]))]  # those of most steps first
            steps, at, rest = np.abs(by[own]), changed[own], others[own]
            now, t, p, seed = self.c[at], self.t[at], above[at], mix(self.seed[at], np.uint64(number))
            left = np.searchsorted(-steps, -np.arange(1, (steps[0] if len(own) else 0) + 1), side="right")  # cells that have this step
            done = 0
            while done < len(left):
                # the draws of several steps at once, when few cells are left
                ahead = left[done : done + max(1, _DRAWS // int(left[done]))]
                h = mix(mix(seed[: ahead[0]], np.arange(done + 1, done + 1 + len(ahead), dtype=np.uint64)[:, None]), np.uint64(3))
                for n, draw in zip(ahead.tolist(), _low(h) if seated else _high(h), strict=True):
                    if seated:
                        t[:n] += self._opens(t[:n], now[:n] + done, rest[:n], p[:n], draw[:n])
                    else:
                        t[:n] -= draw[:n] < leaves_alone(np.maximum(now[:n] - done, 1), t[:n], self.discount)
                    done += 1
            self.t[at] = t
        self.c = c
        self.t = np.minimum(np.maximum(self.t, np.minimum(self.c, 1)), self.c)


def _cells(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A place of each distinct key, in their order, and the number of each place's key."""
    bits = len(key).bit_length()
    if int(key.max()).bit_length() + bits < 64:  # keys and places in one number: sorting numbers is much faster than sorting places by keys
        both = np.sort(key << bits | np.arange(len(key)))
        order, key = both & ((1 << bits) - 1), both >> bits
    else:
        order = np.argsort(key)
        key = key[order]
    new = np.diff(key, prepend=-1) != 0
    cell = np.empty(len(key), np.int64)
    cell[order] = np.cumsum(new) - 1
    return order[new], cell


def _distinct(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """What np.unique says with the inverse; quicker where numbers recur, as only the distinct ones are sorted."""
    coded = pa.array(x).dictionary_encode()
    found = coded.dictionary.to_numpy()
    order = np.argsort(found)
    rank = np.empty(len(found), np.int64)
    rank[order] = np.arange(len(found))
    return found[order], rank.take(coded.indices.to_numpy())


def _contexts(cols: list[list[np.ndarray]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The words and divisions of the one-word contexts, and the number of each token's context."""
    word, division, n = np.concatenate([np.cumsum(c[0]) for c in cols]), *(np.concatenate([c[i] for c in cols]) for i in (1, 2))
    size = int(division.max()) + 1
    first, context = _cells(word * size + division)
    return word[first], division[first], np.repeat(context, n)


def discount_of(c: np.ndarray) -> float:
    """From the counts of counts: what is seen once, and twice."""
    n1, n2 = int((c == 1).sum()), int((c == 2).sum())
    return float(min(max(n1 / max(n1 + 2 * n2, 1), 0.1), 0.95))


class Contexts:
    """The restaurants of one task: one-word contexts and the two-word contexts that end in them."""

    def __init__(self, blobs: list[bytes]) -> None:
        cols = [unpack(b) for b in blobs]
        self.sizes = [len(c[3]) for c in cols]
        w2, division, u2 = _contexts(cols)
        w1, w, self.doc = (np.concatenate([c[i] for c in cols]) for i in (3, 4, 5))
        self.words, wi = _distinct(w)
        older, w1i = _distinct(w1)
        # one sort brings the tokens of each (context, word) together, and the cells of each context
        key = (u2 * len(older) + w1i) * len(self.words) + wi
        first, self.cell = _cells(key)
        context = np.cumsum(np.diff(key[first] // len(self.words), prepend=-1) != 0) - 1
        seed = mix(mix(np.uint64(17), w[first].astype(np.uint64)), w2[u2[first]].astype(np.uint64))
        c = np.bincount(self.cell[(self.doc & 1) == 0], minlength=len(first))
        self.three = Level(c, np.minimum(c, 1), context, int(context[-1]) + 1, mix(seed, w1[first].astype(np.uint64) + np.uint64(1)), discount_of(c))
        pairs = u2[first] * len(self.words) + wi[first]
        at, self.up = _cells(pairs)
        cells = pairs[at]
        self.word = cells % len(self.words)
        c = self._customers(len(cells))
        self.two = Level(c, np.minimum(c, 1), cells // len(self.words), len(w2), mix(seed[at], division[u2[first[at]]].astype(np.uint64)), discount_of(c))

    def _customers(self, cells: int) -> np.ndarray:
        return np.bincount(self.up, self.three.t, cells).astype(np.int64)

    def tables(self) -> np.ndarray:
        """Tables of each word at the one-word contexts: customers of the words' own restaurant."""
        return np.bincount(self.word, self.two.t, len(self.words)).astype(np.int64)

    def sample(self, base: np.ndarray, sweeps: int, burn_in: int, seed: int) -> np.ndarray:
        """Sweeps over both levels; the averaged probability of each three-word cell, without one to average none. base: of each word."""
        above, mean = base[self.word], np.zeros(len(self.three.c))
        at = self.three.several()
        up, customers = self.up[at], self._customers(len(self.two.c))
        p = self.two.predict(above[up], up)
        for s in range(sweeps):
            before = self.three.t[at]
            self.three.sweep(p, seed + 2 * s, at=at)
            customers = customers + np.bincount(up, self.three.t[at] - before, len(customers)).astype(np.int64)
            self.two.adjust(customers, above, seed + 2 * s)
            cells = self.two.several()
            self.two.sweep(above[cells], seed + 2 * s + 1, at=cells)
            if s >= burn_in:
                two = self.two.predict(above)
                mean += self.three.predict(two[self.up]) / (sweeps - burn_in)
                p = two[up]
            elif s < sweeps - 1:
                p = self.two.predict(above[up], up)
        return mean


_OUT = pa.schema([("kind", pa.int32()), ("block", pa.int64()), ("place", pa.int64()), ("n", pa.int64()), ("m", pa.int64()), ("a", pa.binary()), ("b", pa.binary())])
_OUT_DDL = "kind int, block bigint, place bigint, n bigint, m bigint, a binary, b binary"


def _tables(place: int, words: np.ndarray, tables: np.ndarray, parts: int) -> pa.RecordBatch:
    """Tables of words, for the words' parts; they say which task asks for the words' probabilities."""
    part = words % parts
    order = np.argsort(part, kind="stable")
    cuts = np.append(np.flatnonzero(np.diff(part[order], prepend=-1)), len(order))
    return _batch([{"kind": _TABLES, "block": place, "place": int(part[order[a]]), "a": pack(words[order[a:b]]), "b": pack(tables[order[a:b]])} for a, b in zip(cuts, cuts[1:], strict=False)], _OUT)


def _open(parts: int):
    """The first tables: one for each word of each one-word context."""

    def open_(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for place, rows in _grouped(batches, "place"):
            cols = [unpack(r["a"]) for r in rows]
            context = _contexts(cols)[2]
            w = np.concatenate([c[4] * 2 + (c[5] & 1) for c in cols])
            words, wi = _distinct(w >> 1)
            seen = np.sort((context * len(words) + wi)[(w & 1) == 0])
            seen = seen[np.diff(seen, prepend=-1) != 0]
            yield _tables(place, words, np.bincount(seen % len(words), minlength=len(words)), parts)

    return open_


def _run(score: bool, parts: int, seed: int):
    """A round over the tasks' contexts: the sampled tables of the words, or each document's log probability."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for place, rows in _grouped(batches, "place"):
            grams = [r for r in rows if r["kind"] == _GRAMS]
            if not grams:
                continue
            held = Contexts([r["a"] for r in grams])
            base = [unpack(r["a"]) + [np.frombuffer(r["b"], np.float64)] for r in rows if r["kind"] == _BASE]
            ids, p = (np.concatenate([x[i] for x in base]) for i in (0, 1))
            order = np.argsort(ids)
            mean = held.sample(p[order][np.searchsorted(ids[order], held.words)], SWEEPS, BURN_IN if score else SWEEPS, seed)
            if not score:
                yield _tables(place, held.words, held.tables(), parts)
                continue
            logs = np.rint(np.log10(np.maximum(mean, 1e-300)) * _UNIT).astype(np.int64)[held.cell]
            at, out = 0, []
            for r, n in zip(grams, held.sizes, strict=True):
                of = held.doc[at : at + n] >> 1
                docs = np.flatnonzero(np.bincount(of))
                sums = np.zeros(int(docs[-1]) + 1, np.int64)
                np.add.at(sums, of, -logs[at : at + n])
                out.append({"kind": _SUMS, "block": r["block"], "a": pack(docs), "b": pack(sums[docs])})
                at += n
            yield _batch(out, _OUT)

    return run


def _merged(rows: list[dict]) -> tuple[np.ndarray, np.ndarray]:
    ids, own = _distinct(np.concatenate([unpack(r["a"])[0] for r in rows]))
    return ids, np.bincount(own, np.concatenate([unpack(r["b"])[0] for r in rows]), len(ids)).astype(np.int64)


def _seat_words(discount: float, tables: int, p0: float, seed: int):
    """Tables of each part's words in the restaurant without a context, when its other words have `tables`."""

    def seat(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, rows in _grouped(batches, "place"):
            ids, c = _merged(rows)
            t = word_tables(ids, c, discount, tables, p0, seed)
            yield _batch([{"kind": _FACTS, "n": int(c.sum()), "m": int(t.sum()), "block": int((c == 1).sum()), "place": int((c == 2).sum())}], _OUT)

    return seat


def word_tables(ids: np.ndarray, c: np.ndarray, discount: float, tables: int, p0: float, seed: int) -> np.ndarray:
    """The tables of c customers of each word in the restaurant without a context: seated one after another, then a sweep."""
    level = Level(c, np.minimum(c, 1), np.zeros(len(c), np.int64), 1, mix(np.uint64(23), ids.astype(np.uint64)), discount)
    seat_anew(level, tables, p0, seed)
    level.sweep(np.full(len(c), p0), seed + 1, np.full(len(c), max(tables - 1, 0)))
    return level.t


def seat_anew(level: Level, tables: int, p0: float, seed: int) -> None:
    """Seats the customers of each cell one after another, by jumps from one opened table to the next.

    Between two openings the chance that n customers in a row join is a ratio of gamma functions, so the next opening is
    found by bisection: the work is that of the tables, not of the customers.
    """
    c, discount = level.c, level.discount
    at = np.flatnonzero(c > 1)
    for n in range(1, RESEATED):  # the first customers one at a time: most words have few
        at = at[c[at] > n]
        if not len(at):
            return
        t = level.t[at]
        new = (STRENGTH + discount * (tables + t)) * p0
        level.t[at] = t + (uniform(level.seed[at], seed, n, 6)[0] * (new + n - discount * t) < new)
    seated, at, step = np.minimum(c, RESEATED), np.flatnonzero(c > RESEATED), 0
    while len(at):
        new = (STRENGTH + discount * (tables + level.t[at])) * p0
        n, t = seated[at].astype(float), level.t[at]
        goal = np.log(np.maximum(uniform(level.seed[at], seed, step, 5)[0], 2.0**-33))
        start = _log_joins(n, t, new, discount)
        low, high = seated[at], c[at]  # the first customer that opens a table, if before the last
        while (low < high).any():
            k = (low + high) // 2
            joined = _log_joins(k + 1.0, t, new, discount) - start
            opened = joined < goal
            low, high = np.where(opened | (low >= high), low, k + 1), np.where(opened & (low < high), k, high)
        open_ = low < c[at]
        level.t[at] += open_
        seated[at] = np.minimum(low + 1, c[at])
        at = at[open_ & (seated[at] < c[at])]
        step += 1


def _log_joins(n: np.ndarray, t: np.ndarray, new: np.ndarray, discount: float) -> np.ndarray:
    """log of gamma(n - d t) / gamma(n - d t + new)."""
    x = n - discount * t
    return _log_gamma(x) - _log_gamma(x + new)


def _log_gamma(x: np.ndarray) -> np.ndarray:
    """Stirling's series, after a shift by eight."""
    shift = np.zeros_like(x)
    for k in range(8):
        shift += np.log(x + k)
    y = x + 8
    return (y - 0.5) * np.log(y) - y + 0.5 * np.log(2 * np.pi) + 1 / (12 * y) - 1 / (360 * y**3) + 1 / (1260 * y**5) - shift


def _answer(discount: float, customers: int, tables: int, p0: float, seed: int):
    """The words' probabilities, sent back to each task that asked for them."""

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, rows in _grouped(batches, "place"):
            ids, c = _merged(rows)
            t = word_tables(ids, c, discount, tables, p0, seed)
            p = (np.maximum(c - discount * t, 0) + (STRENGTH + discount * tables) * p0) / (STRENGTH + customers)
            for r in rows:
                own = unpack(r["a"])[0]
                yield _batch([{"kind": _BASE, "place": r["block"], "a": r["a"], "b": p[np.searchsorted(ids, own)].tobytes()}], _OUT)

    return answer


def _finish(doc_type: str):
    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, rows in _grouped(batches, "block"):
            docs = [r for r in rows if r["kind"] == _SCORED]
            sums = np.zeros(max(r["place"] for r in docs) + 1, np.int64)
            for r in rows:
                if r["kind"] == _SUMS:
                    np.add.at(sums, unpack(r["a"])[0], unpack(r["b"])[0])
            yield pa.RecordBatch.from_pylist([{k: r[k] for k in ("doc_id", "held", "n", "m", "x")} | {"score": -float(sums[r["place"]]) / _UNIT} for r in docs], pa.schema([("doc_id", kind[0]), ("held", pa.bool_()), ("n", pa.int64()), ("m", pa.int64()), ("x", pa.float64()), ("score", pa.float64())]))

    kind: list[pa.DataType] = []

    def typed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def seen() -> Iterator[pa.RecordBatch]:
            for batch in batches:
                kind[:] = [batch.schema.field("doc_id").type]
                yield batch

        yield from finish(seen())

    return typed


def _dealt(df: DataFrame, by: str, tasks: int) -> DataFrame:
    return df.repartition(min(tasks, MAX_PARTITIONS), by).sortWithinPartitions(by)


def score_documents(docs: DataFrame, held_out: Column, *, doc_id: str = "doc_id", text: str = "text", rounds: int = ROUNDS) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score (log10) and perplexity of every row.

    The model learns from rows that aren't held out; unknown words are one word to it, as to base_score. Null texts count as
    empty: their only token is the end. Repeated rows are scored each by itself and all count in training. An empty table
    gives an empty result. Without any training row all words are unknown. Other columns are ignored; held_out is never
    null; doc_id keeps its type. Intermediate tables are dropped as soon as nothing reads them any more.
    """
    id_type = docs.schema[doc_id].dataType.simpleString()
    row_ddl = f"doc_id {id_type}, {_ROWS}"
    rows = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").alias("text"), F.coalesce(held_out, F.lit(False)).alias("held"))
    parts = int((rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // WORD_BYTES) + 1
    encoded = written(rows.mapInArrow(_encode(parts), row_ddl), "blocks")
    numbers = written(_dealt(encoded.where(F.col("kind") == _WORDS).drop("doc_id"), "place", parts).mapInArrow(_number(parts), row_ddl.replace(f"doc_id {id_type}", "doc_id bigint")).drop("doc_id"), "numbers")
    facts = numbers.where(F.col("kind") == _FACTS).agg(F.sum("n").alias("n"), F.sum("m").alias("v"), F.max("place").alias("end")).first()
    tokens, kinds, end = facts["n"] or 0, facts["v"] or 0, facts["end"] or _UNKNOWN
    tasks, p0 = int(tokens // TASK_TOKENS) + 1, 1 / (kinds + 1)
    both = encoded.where(F.col("kind").isin(_DOC, _TOKENS)).unionByName(numbers.where(F.col("kind") == _NUMBERS), allowMissingColumns=True)
    grams = written(_dealt(both, "block", tasks).mapInArrow(_deal(tokens, kinds, end, tasks), row_ddl), "grams")
    dropped(encoded, numbers)
    dealt = grams.where(F.col("kind") == _GRAMS).select("kind", "block", "place", "a")
    now = written(_dealt(dealt.select("place", "a"), "place", tasks).mapInArrow(_open(parts), _OUT_DDL), "tables")
    d, tables = 0.5, kinds  # of the words' own restaurant: each word has a table at least, then as sampled
    for k in range(1, rounds + 1):
        asked = now.select("kind", "block", "place", "a", "b")
        for s in range(2 if k == 1 else 1):
            seen = _dealt(asked, "place", parts).mapInArrow(_seat_words(d, tables, p0, 1000 * k + 10 * s), _OUT_DDL).agg(*(F.sum(c).alias(c) for c in ("n", "m", "block", "place"))).first()
            tables = seen["m"] or 0
            d = min(max((seen["block"] or 0) / max((seen["block"] or 0) + 2 * (seen["place"] or 0), 1), 0.1), 0.95)
        base = written(_dealt(asked, "place", parts).mapInArrow(_answer(d, seen["n"] or 0, tables, p0, 1000 * k + 30), _OUT_DDL), "base")
        given = dealt.unionByName(base.select("kind", "place", "a", "b"), allowMissingColumns=True)
        before, now = now, written(_dealt(given, "place", tasks).mapInArrow(_run(k == rounds, parts, 10_000 * k), _OUT_DDL), "round")
        dropped(before, base)
    sums = now.select("kind", "block", "a", "b")
    joined = grams.where(F.col("kind") == _SCORED).drop("a", "b").unionByName(sums, allowMissingColumns=True)
    out = _dealt(joined, "block", tasks).mapInArrow(_finish(id_type), f"doc_id {id_type}, held boolean, n bigint, m bigint, x double, score double")
    return out.select("doc_id", F.col("held").alias("held_out"), F.col("n").alias("n_tokens"), F.col("m").alias("n_known"), F.lit(tokens).cast("bigint").alias("train_tokens"), F.col("x").alias("base_score"), "score", F.pow(F.lit(10.0), -F.col("score") / F.col("n")).alias("perplexity"))


def perplexity(scored: DataFrame) -> DataFrame:
    """held_out, tokens and the perplexity over all tokens of each side, of what score_documents() gives."""
    side = scored.groupBy("held_out").agg(F.sum("n_tokens").alias("tokens"), F.sum("score").alias("score"), F.sum("base_score").alias("base"))
    return side.select("held_out", "tokens", F.pow(F.lit(10.0), -F.col("score") / F.col("tokens")).alias("perplexity"), F.pow(F.lit(10.0), -F.col("base") / F.col("tokens")).alias("base_perplexity"))
