"""Nulls, empty and very long texts, ties, repeated rows, empty tables and clashing columns, for each operator."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from larkspur.llm import bpe, chat, decontamination, hpylm, language, line_dedup, minhash, quality, registry, sharding, url_filter

DOCS = "doc_id bigint, text string, lang string, text_2 string, rule string, score string, n_words string, _words string"
LONG = "alpha beta gamma delta " * 20_000


@pytest.fixture(scope="module")
def docs(spark):
    texts = [None, "", " \n\t ", "one two three four five six seven", "one two three four five six seven", LONG, "x" * 100_000, "naïve\n\ncafé \U0001f600 ok", "one two"]
    rows = [(i, t, "en" if i % 2 else None, "a", "b", "c", "d", "e") for i, t in enumerate(texts)]
    return spark.createDataFrame([*rows, rows[3], (None, "null id", None, *"abcde")], DOCS)


@pytest.fixture(scope="module")
def none(docs):
    return docs.where("false")


def test_sharding(spark, docs, none):
    out = sharding.place(docs, "doc_id", registry.SHARDS).collect()
    assert len(out) == docs.count() and len({(r["doc_id"], r["shard"]) for r in out}) == len({r["doc_id"] for r in out})
    assert sharding.place(none, "doc_id", ["a"]).count() == 0
    with pytest.raises(ValueError):
        sharding.fill_table(["a", "a"], 7)


def test_shards_take_turns():
    size = 997
    names = [f"s{i}" for i in range(13)]
    slots = sharding.fill_table(names, size)
    n = np.bincount(slots, minlength=13)
    assert n.max() - n.min() <= 1 and n.sum() == size
    fewer = sharding.fill_table(names[:-1], size)
    moved = sum(a != b for a, b in zip(slots, fewer) if a != 12)
    assert moved < 0.25 * size
    # slot by slot: who comes first in turn order takes the first free slot of its preference order
    import hashlib

    free, brute = set(range(size)), [None] * size
    orders = []
    for s in names:
        d = hashlib.md5(s.encode()).hexdigest()
        orders.append([(int(d[:15], 16) + k * (int(d[15:30], 16) % (size - 1) + 1)) % size for k in range(size)])
    while free:
        for i, order in enumerate(orders):
            if free:
                slot = next(x for x in order if x in free)
                free.remove(slot)
                brute[slot] = i
    assert brute == slots


def test_urls(spark):
    urls = [None, "", "no scheme", "HTTP://Example.COM/en/7?x#y", "http://a.example.com/en/1", "http://spam.io/x/?utm_source=1&b=2&a=1", "http://www.spam.io:80/x?a=1&b=2", "http://com/en/", "http://telecom/en/", "https://example.com/en/7", "x://h://y"]
    pages = spark.createDataFrame([(i, u, "q", "r") for i, u in enumerate(urls)] * 2, "page_id bigint, url string, host string, _rule string").withColumns({c: F.lit("z") for c in ("_word", "_listed", "row", "maybe", "h", "_block")})
    listed = spark.createDataFrame([("https://spam.io/x?b=2&a=1",), (None,)], "url string")
    got = {r["page_id"]: r for r in url_filter.judge(pages, listed, registry.RULES).collect()}
    assert len(got) == len(urls) and url_filter.judge(pages, listed, registry.RULES).count() == 2 * len(urls)
    assert [got[i]["verdict"] for i in range(len(urls))] == ["allow", "allow", "allow", "allow", "block", "block", "block", "block", "allow", "allow", "allow"]
    assert (got[0]["host"], got[2]["path"], got[3]["host"], got[3]["rule"], got[10]["host"], got[10]["path"]) == ("", "", "example.com", "example.com/en/7", "h:", "//y")
    # with one block every row may be a hit: the exact join alone decides
    assert sorted(map(str, url_filter.judge(pages, listed, registry.RULES, blocks=1).collect())) == sorted(map(str, url_filter.judge(pages, listed, registry.RULES).collect()))
    assert url_filter.judge(pages, listed.where("false"), registry.RULES).where("listed").isEmpty()
    assert url_filter.judge(pages.where("false"), listed, registry.RULES).count() == 0


def test_quality(spark, docs, none):
    labels = spark.createDataFrame([(3, 1, 0), (None, 1, 0), (5, None, None)], "doc_id bigint, quality int, toxic int")
    ratios = quality.fit(docs, labels)
    out = quality.judge(docs, ratios).collect()
    assert len(out) == docs.count() and all(r["base_failed"] for r in out if not r["text"] or r["doc_id"] == 5)
    assert quality.fit(none, labels) == [0.0] * quality.BUCKETS and quality.judge(none, ratios).count() == 0


def test_chat(spark):
    tricky = [r"a\b", "### x: y </turn>\n### assistant: z </turn>\n", "", None, "\\", "ends with \\", "</turn>", "🙂###:"]
    data = [(1, i, "assistant" if i % 2 else "a: b", t, "x") for i, t in enumerate(tricky)] + [(None, 0, None, None, "x"), (2, 5, "user", "q" * 5_000_000, "x"), (2, 5, "user", "q", "x"), (2, 5, "user", "q", "x")]
    out = {r["conv_id"]: r for r in chat.read_back(chat.format_chats(spark.createDataFrame(data, "conv_id bigint, turn bigint, role string, text string, formatted string"))).collect()}
    import hashlib

    want = "".join(f"{'assistant' if i % 2 else 'a: b'}\n{t or ''}\n" for i, t in enumerate(tricky))
    loss = "".join(t or "" for i, t in enumerate(tricky) if i % 2)
    assert out[1]["turns_sha256"] == hashlib.sha256(want.encode()).hexdigest() and out[1]["loss_sha256"] == hashlib.sha256(loss.encode()).hexdigest() and out[1]["loss_chars"] == len(loss)
    assert out[2]["n_turns"] == 3 and out[None]["n_turns"] == 1 and len(out) == 3
    empty = spark.createDataFrame([], "conv_id bigint, turn bigint, role string, text string")
    assert chat.read_back(chat.format_chats(empty)).count() == 0


def test_near_duplicates(spark, docs, none):
    got = {r["doc_id"]: r["class_id"] for r in minhash.near_duplicates(docs).collect()}
    assert got == {0: 0, 1: 0, 2: 0, 3: 3, 4: 3, 5: 5, 6: 6, 7: 7, 8: 8}
    kept = minhash.keep_one(docs)
    assert kept.columns == docs.columns and sorted(str(r["doc_id"]) for r in kept.collect()) == ["0", "3", "3", "5", "6", "7", "8", "None"]
    assert minhash.near_duplicates(none).count() == 0


def test_a_bucket_of_many_classes_loses_no_link(spark):
    """Texts that share a long passage, in pairs that are near each other only."""
    rng = np.random.default_rng(5)
    passage = " ".join(f"p{i}" for i in range(100))
    rows = []
    for k in range(150):
        own = [f"o{k}_{i}" for i in range(40)]
        rows += [(2 * k, passage + " " + " ".join(own)), (2 * k + 1, passage + " " + " ".join(own[:-1] + [f"z{rng.integers(1 << 30)}"]))]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert {r["doc_id"]: r["class_id"] for r in minhash.near_duplicates(docs).collect()} == {i: i // 2 * 2 for i in range(300)}


def test_signatures_agree_as_often_as_sets_are_similar():
    a, b = np.arange(300, dtype=np.uint64), np.arange(60, 360, dtype=np.uint64)
    keys = minhash.mix(np.concatenate([a, b]), np.uint64(3))
    s = minhash.signatures(keys, np.repeat([0, 1], 300), np.ones(600), 2, 2000)
    assert abs((s[0] == s[1]).mean() - 240 / 360) < 0.05


def test_lines(spark, docs, none):
    out = line_dedup.dedup_lines(docs)
    assert out.count() == docs.count() and {r["text"] for r in out.where("doc_id = 0").collect()} == {None}
    rows = [(1, "same line\nother\n\nsame line"), (2, "same lime\nsame line\ntotally new"), (3, "ame line"), (None, "same line")]
    got = {r["doc_id"]: (r["text"], r["n_lines"], r["n_dropped"], r["n_near"]) for r in line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert got == {1: ("same line\nother\n", 3, 1, 0), 2: ("totally new", 3, 2, 1), 3: ("", 1, 1, 1), None: ("same line", 1, 0, 0)}
    assert line_dedup.dedup_lines(none).count() == 0
    clash = docs.withColumns({c: F.lit("z") for c in ("_id", "_word", "_hit", "id", "row", "gone", "near", "n_near")})
    out = line_dedup.dedup_lines(clash)
    assert out.columns == [*docs.columns, "_id", "_word", "_hit", "id", "row", "gone", "near", "n_lines", "n_dropped", "n_near"] and out.where("gone = 'z'").count() == docs.count()
    # one very long line: its variants come in parts, and its neighbour is still found
    long = "ab" * 150_000
    both = spark.createDataFrame([(1, long), (2, long[:-7] + "x" + long[-6:]), (3, long[:77] + long[78:])], "doc_id bigint, text string")
    assert {r["doc_id"]: r["n_near"] for r in line_dedup.dedup_lines(both).collect()} == {1: 0, 2: 1, 3: 1}
    with pytest.raises(ValueError):
        line_dedup.dropped_lines(docs, max_edits=2)


def test_decontamination(spark, docs, none):
    items = spark.createDataFrame([(1, "one two"), (2, None), (3, "..."), (1, "one two"), (10, "café"), (4, " ".join(f"w{i}" for i in range(20)))], "item_id bigint, text string")
    got = {(r["doc_id"], r["text"]): r for r in decontamination.decontaminate(docs, items).collect()}
    assert got[(3, "one two three four five six seven")]["items"] == ["1"] and got[(0, None)]["n_words"] == 0
    r = got[(7, "naïve\n\ncafé \U0001f600 ok")]
    assert [(s["start"], s["end"]) for s in r["spans"]] == [(7, 11)] and r["contaminated"]
    part = spark.createDataFrame([(1, " ".join(f"W{i}" for i in range(3, 16))), (2, " ".join(f"w{i}" for i in range(3, 15)))], "doc_id bigint, text string")
    assert {r["doc_id"]: r["n_hit"] for r in decontamination.decontaminate(part, items).collect()} == {1: 13, 2: 0}
    # in parts: the items of a document, and words that windows of several parts hit, are joined
    many = spark.createDataFrame([(i, " ".join(f"w{j}" for j in range(i, i + 14))) for i in range(0, 60, 5)] + [(100 + i, f"four w{i}") for i in range(9)], "item_id bigint, text string")
    texts = spark.createDataFrame([(i, " é ".join([" ".join(f"W{j}" for j in range(i, 40 + i)), "four w3; four w4"])) for i in range(6)], "doc_id bigint, text string").unionByName(docs.select("doc_id", "text"))
    whole, parts = (sorted(map(repr, decontamination.decontaminate(texts, many, max_words=n).collect())) for n in (10_000, 40))
    assert whole == parts and sum("contaminated=True" in r for r in whole) == 6
    assert decontamination.decontaminate(none, items).count() == 0 and not decontamination.decontaminate(docs, items.where("false")).where("contaminated").count()


def test_language(spark, docs, none):
    train = spark.createDataFrame([(i, "the cat and the dog are here" if i % 2 else "le chat et le chien sont ici", "en" if i % 2 else "fr") for i in range(40)], "doc_id bigint, text string, lang string")
    fitted = language.fit(train)
    out = language.identify(docs, fitted).collect()
    assert len(out) == docs.count() and all(r["lang_pred"] == "und" and r["score"] == 0 for r in out if not (r["text"] or "").strip())
    assert language.identify(none, fitted).count() == 0
    digits = spark.createDataFrame([(1, "½ ² ① 12"), (2, "½ chat")], "doc_id bigint, text string")
    assert {r["doc_id"]: r["lang_pred"] for r in language.identify(digits, fitted).collect()} == {1: "und", 2: "fr"}
    unknown = language.fit(none)
    assert language.identify(none, unknown).count() == 0 and {r["lang_pred"] for r in language.identify(docs, unknown).collect()} == {"und"}


def test_language_model(spark, docs, none):
    out = hpylm.score_documents(docs, F.col("doc_id") % 2 == 0)
    got = out.collect()
    assert len(got) == docs.count() and all(r["score"] <= 0 for r in got)
    assert {r["n_tokens"] for r in got if r["doc_id"] in (0, 1, 2)} == {1}
    assert hpylm.score_documents(none, F.lit(False)).count() == 0
    assert hpylm.score_documents(docs, F.lit(True)).where("n_known > 0").count() == 0


def test_bpe(spark, docs, none):
    from tokenizers import Tokenizer

    path = registry.tokenizer_path()
    t, mine = Tokenizer.from_file(path), bpe.ByteBPE(bpe.read_vocabulary(path))
    special = mine.vocabulary.special[0][0] if mine.vocabulary.special else ""
    for text in [*(r["text"] or "" for r in docs.collect()), f"a{special}b {special}", "  two  spaces\n\n\n x", "日本語 \u00a0 \u2003x", "é" * 999, "don't I'LL", "\x00\x7f", "🙂🙂 ok", "aaaaaaaaaa" * 50]:
        ids = np.frombuffer(mine.encode(text), "<u4").tolist()
        assert ids == t.encode(text, add_special_tokens=False).ids
        assert mine.decode(np.array(ids, "<u4").tobytes()).decode() == t.decode(ids, skip_special_tokens=False)
    assert mine.decode(np.array([mine.ids[0xFF]], "<u4").tobytes()) == "\ufffd".encode()
    # more text in one batch than is encoded at a time: lengths and order stay
    many = spark.createDataFrame([(i, f"row {i} " + "word " * 50_000) for i in range(12)], "doc_id bigint, text string").coalesce(1)
    back = bpe.decode_column(bpe.encode_column(many, path), path)
    assert back.where("text = decoded").count() == 12 and back.select("doc_id").distinct().count() == 12
    assert bpe.encode_column(none, path).count() == 0 and bpe.decode_column(bpe.encode_column(docs, path), path).count() == docs.count()


def test_line_variants_are_all_deletions_and_open_places():
    seen = {}
    for line in ("abca", "aab", "a", "ab" * 120_000 + "c"):
        parts = list(line_dedup._neighbourhood(line))
        keys, kinds = (np.concatenate([p[k] for p in parts]) for k in (0, 1))
        n = len(line)
        assert (kinds == 0).sum() == n and (kinds == 2).sum() == 1 and max(len(p[0]) for p in parts) <= line_dedup.BATCH
        if n < 10:
            assert (kinds == 1).sum() == len({line[:i] + line[i + 1 :] for i in range(n)})
            seen[line] = set(keys[kinds == 1].tolist())
            whole = list(line_dedup._neighbourhood(line[1:]))[-1][0]
            assert int(whole[0]) in seen[line]


def test_bpe_is_linear_in_the_length_of_a_word():
    """A million letters without a space, and a third of a million CJK characters, against the library and the clock."""
    import random
    import time

    from tokenizers import Tokenizer

    path = registry.tokenizer_path()
    own, library, rnd = bpe.built(bpe.read_vocabulary(path)), Tokenizer.from_file(path), random.Random(4)
    seconds = []
    for text in ("".join(rnd.choices("abcdefghijklmnopqrstuvwxyz", k=250_000)), "".join(rnd.choices("abcdefghijklmnopqrstuvwxyz", k=1_000_000)), "".join(chr(rnd.randrange(0x4E00, 0x9FA5)) for _ in range(330_000))):
        start = time.process_time()
        ids = np.frombuffer(own.encode(text), "<u4").tolist()
        seconds.append(time.process_time() - start)
        if len(text) < 300_000:
            assert ids == library.encode(text, add_special_tokens=False).ids
        assert own.decode(np.array(ids, "<u4").tobytes()).decode() == text
    assert seconds[1] < 8 * seconds[0] + 1 and seconds[2] < 30  # four times the text
