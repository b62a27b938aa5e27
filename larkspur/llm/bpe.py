"""Byte-level BPE with exact merges, by backtracking, and decoding through an offset table.

A token sequence is what the merges give exactly if each pair of neighbours is compatible: merging the two tokens' bytes
alone gives them back. So an encoder may walk left to right, taking the longest token at each place (an Aho-Corasick
automaton over all tokens finds them in one pass), trying its shorter prefixes where the pair before it is not compatible,
and stepping back where none is. Places that led nowhere are marked, so the walk is linear in the text. Pairs that were
tested once are kept in a table.

Whole texts are encoded. Text is cut into words by the tokenizer's own pattern first; results for words are remembered in
small tables of fixed size, which speeds things up and changes nothing.

The driver reads the tokenizer file once and sends the vocabulary as flat numpy arrays (some 40 bytes a token). A worker
builds its automaton and its table of merges from them and holds nothing else that grows: texts are taken a megabyte at a time.
"""

from __future__ import annotations

import hashlib
import json
from array import array
from collections.abc import Iterator
from dataclasses import dataclass

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from tokenizers import pre_tokenizers

from larkspur.llm.common import held

#: The split pattern of byte-level pre-tokenizers with use_regex.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Up to here the Unicode tables of all libraries agree on letters, numbers and white space.
_PLAIN = regex.compile(r"[\x00-ɏ]*")
#: Remembered words, and texts between two spaces, in each of two generations, at most; each takes some 200 bytes.
WORDS, CHUNKS = 100_000, 60_000
#: Remembered pairs: slots of 8 bytes.
_SLOTS = 131_071
#: Bytes of text that are encoded at a time, about.
CHUNK = 1 << 20
_NONE = -1


class Memory:
    """A bounded table in two generations: when the young one is full it becomes the old one; what is used moves up."""

    def __init__(self, size: int) -> None:
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        self.size = size

    def missed(self, key: str) -> bytes | None:
        """What the old generation has of a key that the young one lacks."""
        got = self.old.get(key)
        if got is not None:
            self.keep(key, got)
        return got

    def keep(self, key: str, value: bytes) -> None:
        if len(key) > 64:
            return
        if len(self.young) >= self.size:
            self.old, self.young = self.young, {}
        self.young[key] = value


def byte_alphabet() -> dict[str, int]:
    """The printable character that stands for each byte in a byte-level vocabulary."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


@dataclass
class Vocabulary:
    """A tokenizer file as flat arrays. Tokens are numbered: bytes first, then merges by rank, so a larger number was merged later."""

    key: str
    names: bytes  # all tokens' bytes in one row, by number
    sizes: np.ndarray
    ids: np.ndarray  # the file's id of each number
    left: np.ndarray  # the two parts a token was merged from; a byte is its own parts
    right: np.ndarray
    shorter: np.ndarray  # the longest token that is a proper prefix
    pair: np.ndarray  # merges: left << 32 | right, and what they make
    made: np.ndarray
    letters: np.ndarray  # decoding: bytes of all ids in one row, where each begins, and how long it is
    offsets: np.ndarray
    lengths: np.ndarray
    special: list[tuple[str, int]]


def read_vocabulary(path: str) -> Vocabulary:
    with open(path, "rb") as file:
        raw = file.read()
    spec = json.loads(raw)
    model, pre = spec["model"], spec["pre_tokenizer"]
    if model["type"] != "BPE" or pre["type"] != "ByteLevel" or pre["add_prefix_space"] or not pre["use_regex"] or spec["normalizer"]:
        raise ValueError("only byte-level BPE without a prefix space or a normalizer is supported")
    special = [(t["content"], t["id"]) for t in spec["added_tokens"]]
    if any(t[k] for t in spec["added_tokens"] for k in ("single_word", "lstrip", "rstrip", "normalized")):
        raise ValueError("only plain added tokens are supported")
    alphabet = byte_alphabet()
    tokens = {bytes(alphabet[ch] for ch in text): i for text, i in model["vocab"].items() if all(ch in alphabet for ch in text)}
    names: list[bytes] = [bytes([b]) for b in range(256)]
    number = {t: i for i, t in enumerate(names)}
    parts: list[tuple[int, int]] = [(i, i) for i in range(256)]
    pairs: dict[int, int] = {}
    for merge in model["merges"]:
        a, b = (bytes(alphabet[ch] for ch in x) for x in (merge if isinstance(merge, list) else merge.split(" ")))
        a_n, b_n = number[a], number[b]
        if a + b not in number:
            number[a + b] = len(names)
            names.append(a + b)
            parts.append((a_n, b_n))
        pairs.setdefault(a_n << 32 | b_n, number[a + b])
    shorter = [next((number[t[:k]] for k in range(len(t) - 1, 0, -1) if t[:k] in number), _NONE) for t in names]
    spelled = [b""] * (max([*tokens.values(), *(i for _, i in special)]) + 1)
    for t, i in tokens.items():
        spelled[i] = t
    for c, i in special:
        spelled[i] = c.encode()
    lengths = np.array([len(t) for t in spelled], np.int64)
    left, right = np.array(parts, np.int32).T
    return Vocabulary(
        hashlib.sha256(raw).hexdigest(), b"".join(names), np.array([len(t) for t in names], np.int32), np.array([tokens[t] for t in names], np.uint32),
        left.copy(), right.copy(), np.array(shorter, np.int32), np.fromiter(pairs.keys(), np.int64, len(pairs)), np.fromiter(pairs.values(), np.int32, len(pairs)),
        np.frombuffer(b"".join(spelled), np.uint8), np.cumsum(lengths) - lengths, lengths, special,
    )


class ByteBPE:
    """The encoder and decoder of one vocabulary. Built once in a Python worker."""

    def __init__(self, vocabulary: Vocabulary) -> None:
        v = self.vocabulary = vocabulary
        self.split_special = regex.compile("(" + "|".join(regex.escape(c) for c, _ in v.special) + ")") if v.special else None
        self.special_bytes = {c: np.uint32(i).tobytes() for c, i in v.special}
        self.pre = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=True)
        self.pairs = dict(zip(v.pair.tolist(), v.made.tolist(), strict=True))
        self.left, self.right, self.shorter, self.lengths, self.ids = (array(k, x.tobytes()) for k, x in (("i", v.left), ("i", v.right), ("i", v.shorter), ("i", v.sizes), ("I", v.ids)))
        self.matcher = ahocorasick.Automaton(ahocorasick.STORE_INTS)
        at = 0
        for i, n in enumerate(self.lengths):
            self.matcher.add_word(v.names[at : at + n].decode("latin-1"), i)
            at += n
        self.matcher.make_automaton()
        self.most = max(self.lengths)
        #: The pair-compatibility table: what was found last for the pairs of each slot, as the pair's number << 1 | compatible.
        self.compatible = array("Q", bytes(8 * _SLOTS))
        self.pattern = regex.compile(PATTERN)
        self.words, self.chunks = Memory(WORDS), Memory(CHUNKS)

    def _stays(self, a: int, b: int) -> bool:
        """Whether merging the bytes of a and b gives a and b: no merge across their border comes before they are whole."""
        key = (a << 31 | b) + 1
        slot = key % _SLOTS
        known = self.compatible[slot]
        if known >> 1 == key:
            return bool(known & 1)
        out = self._test(a, b)
        self.compatible[slot] = key << 1 | out
        return out

    def _test(self, left: int, right: int) -> bool:
        limit, lefts, rights, pairs = 1 << 40, self.left, self.right, self.pairs
        while True:
            made = pairs.get(left << 32 | right)
            if made is not None and made < limit:
                return False
            # undo the later merge of the two; what is merged across the border before it counts against them
            left_whole, right_whole = rights[left] == left, lefts[right] == right
            if left_whole and right_whole:
                return True
            if not left_whole and (left > right or right_whole):
                limit, left = left, rights[left]
            else:
                limit, right = right + 1, lefts[right]

    def word(self, data: bytes) -> bytes:
        """The ids of one word, as little-endian unsigned 32-bit integers."""
        n, letters, lengths, shorter, stays = len(data), data.decode("latin-1"), self.lengths, self.shorter, self._stays
        longest = self.matcher.iter_long  # every byte is a token, so the first match from a place starts there
        dead = bytearray(n + 1)
        out: list[int] = []
        at, last = 0, _NONE
        most, bounded = self.most, n > self.most
        take = next(longest(letters[:most]))[1] if n else _NONE
        while at < n:
            while take != _NONE and (dead[at + lengths[take]] or last != _NONE and not stays(last, take)):
                take = shorter[take]
            if take != _NONE:
                out.append(take)
                at += lengths[take]
                last = take
                # in a long word no further than the longest token reaches: the matcher prepares all that it is given
                take = next(longest(letters[at : at + most]) if bounded else longest(letters, at))[1] if at < n else _NONE
            else:
                dead[at] = 1
                take = out.pop()
                at -= lengths[take]
                last = out[-1] if out else _NONE
                # the place after take is dead now, so the walk goes on with its shorter prefixes
        ids = self.ids
        return array("I", [ids[t] for t in out]).tobytes()

    def _cut(self, text: str) -> list[str]:
        if _PLAIN.fullmatch(text):
            return self.pattern.findall(text)
        return [text[a:b] for _, (a, b) in self.pre.pre_tokenize_str(text)]

    def _piece(self, text: str) -> bytes:
        """The ids of a text without special tokens; its words are remembered."""
        out, words = [], self.words
        for w in self._cut(text):
            got = words.young.get(w)
            if got is None and (got := words.missed(w)) is None:
                got = self.word(w.encode())
                words.keep(w, got)
            out.append(got)
        return b"".join(out)

    def _plain(self, text: str) -> bytes:
        """The ids of a text without special tokens.

        No word of the pattern runs from a character that isn't white space into a space, so the text may be cut before
        any single space that has such characters on both sides. What lies between is remembered as a whole.
        """
        chunks, parts = self.chunks, text.split(" ")
        if len(parts) == 1:
            return self._piece(text)
        out = [self._piece(parts[0])] if parts[0] and not parts[0][-1].isspace() else []
        held = None if out else parts[0]  # a part that ends in white space is cut together with what follows
        for p in parts[1:]:
            if held is None:
                got = chunks.young.get(p)
                if got is None and (got := chunks.missed(p)) is None:
                    if not p or p[0].isspace() or p[-1].isspace():
                        held = " " + p
                        continue
                    got = self._piece(" " + p)
                    chunks.keep(p, got)
                out.append(got)
            elif p and not p[0].isspace() and held and not held[-1].isspace():  # this space may be a border
                out.append(self._piece(held))
                held = " " + p if p[-1].isspace() else None
                if held is None:
                    out.append(self._piece(" " + p))
            else:
                held += " " + p
        if held is not None:
            out.append(self._piece(held))
        return b"".join(out)

    def encode(self, text: str) -> bytes:
        """The ids of a whole text; the strings of added tokens become their ids."""
        if self.split_special is None or not any(c in text for c in self.special_bytes):
            return self._plain(text) if text else b""
        parts = self.split_special.split(text)
        return b"".join(self.special_bytes[p] if i % 2 else self._plain(p) if p else b"" for i, p in enumerate(parts))

    def decode(self, ids: bytes) -> bytes:
        """The UTF-8 bytes of the decoded text; bytes that aren't valid UTF-8 become U+FFFD, as the library has it."""
        v, out = self.vocabulary, []
        for a in range(0, len(ids), CHUNK):
            tokens = np.frombuffer(ids[a : a + CHUNK], "<u4").astype(np.int64)
            sizes = v.lengths[tokens]
            ends = np.cumsum(sizes)
            at = np.repeat(v.offsets[tokens] - (ends - sizes), sizes)
            at += np.arange(len(at))
            out.append(v.letters[at].tobytes())
        data = b"".join(out)
        try:
            data.decode()
        except UnicodeDecodeError:
            data = data.decode("utf-8", "replace").encode()
        return data


def built(vocabulary: Vocabulary) -> ByteBPE:
    """The encoder of a vocabulary, built once in each Python worker."""
    return held(vocabulary.key, lambda: ByteBPE(vocabulary))


def _parts(column: pa.Array) -> Iterator[list]:
    """The values of a column, in lists of some CHUNK bytes."""
    held, size = [], 0
    for x in column:
        held.append(x.as_py())
        size += len(held[-1] or "")
        if size >= CHUNK:
            yield held
            held, size = [], 0
    if held:
        yield held


def encode(text: Column, path: str) -> Column:
    """The ids of a text as binary, little-endian unsigned 32-bit integers. Null and empty texts give no ids."""
    vocabulary = read_vocabulary(path)

    @F.arrow_udf("binary")
    def ids(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        bpe = built(vocabulary)
        for batch in batches:
            for part in _parts(batch):
                yield pa.array([bpe.encode(x or "") for x in part], pa.binary())

    return ids(text)


def decode(ids: Column, path: str) -> Column:
    """The text of ids as encode() gives them; null gives the empty text."""
    vocabulary = read_vocabulary(path)

    @F.arrow_udf("string")
    def text(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        bpe = built(vocabulary)
        for batch in batches:
            for part in _parts(batch):
                yield pa.array([bpe.decode(x or b"") for x in part], pa.binary()).cast(pa.string())

    return text(ids)


def round_trip(text: Column, path: str) -> Column:
    """struct(token_ids, decoded): what encode() gives, and what decode() gives for that, by one worker."""
    vocabulary = read_vocabulary(path)

    @F.arrow_udf("struct<token_ids:binary,decoded:string>")
    def both(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        bpe = built(vocabulary)
        for batch in batches:
            for part in _parts(batch):
                ids = [bpe.encode(x or "") for x in part]
                texts = pa.array([bpe.decode(x) for x in ids], pa.binary()).cast(pa.string())
                yield pa.StructArray.from_arrays([pa.array(ids, pa.binary()), texts], ["token_ids", "decoded"])

    return both(text)


def encode_column(df: DataFrame, path: str, *, text: str = "text", ids: str = "token_ids") -> DataFrame:
    """df with the ids of each whole text; a column of that name is replaced. Nothing is shuffled, no row is dropped."""
    return df.withColumn(ids, encode(F.col(f"`{text}`"), path))


def decode_column(df: DataFrame, path: str, *, ids: str = "token_ids", text: str = "decoded") -> DataFrame:
    """df with the text of each row's ids; a column of that name is replaced."""
    return df.withColumn(text, decode(F.col(f"`{ids}`"), path))


def digest(df: DataFrame, *, ids: str = "token_ids", text: str = "decoded") -> DataFrame:
    """df with n_tokens, ids_sha256 and decoded_sha256 in place of the ids and the decoded text."""
    i, t = F.col(f"`{ids}`"), F.col(f"`{text}`")
    return df.withColumns({"n_tokens": (F.octet_length(i) / 4).cast("long"), "ids_sha256": F.sha2(i, 256), "decoded_sha256": F.sha2(t.cast("binary"), 256)}).drop(ids, text)
