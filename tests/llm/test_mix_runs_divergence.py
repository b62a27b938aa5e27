"""Source mixing, periodic runs and the divergence audit against brute force, and their edge cases."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from larkspur.llm import divergence, mixing, periodic, registry

SF = "/root/testdata/sf0.001"


def words(text):
    return [w for w in re.split("[\x20\x09-\x0d]+", text or "") if w]


# --- mixing ---


def mixed(spark, rows, weights=(5, 2, 1), block=4, **more):
    docs = spark.createDataFrame(rows, "doc_id string, text string, source string, size int, n int")
    pieces, documents = mixing.mix(docs, weights, block_words=block, **more)
    return [r.asDict() for r in pieces.collect()], [r.asDict() for r in documents.collect()]


def test_pieces_add_up_to_targets(spark):
    rnd = random.Random(3)
    rows = [(f"d{i}", " ".join(f"w{k}" for k in range(rnd.choice([0, 1, 3, 9, 40]))), rnd.choice(["a", "b", "B", "ü", None]), 7, 7) for i in range(120)]
    rows += [(None, "x y z", "a", 1, 1)] * 3 + [("d1", None, "a", 1, 1)]
    pieces, documents = mixed(spark, rows)
    assert len(documents) == len(rows)
    size, taken = Counter(), Counter()
    for r in documents:
        size[r["source"]] += r["size"]
        taken[r["source"]] += r["taken"]
        assert 0 <= r["taken"] <= 3 * r["size"] and r["source_size"] >= r["size"]
    # the level by bisection: targets are weight * level, or three times the source's words
    weight = dict(zip(sorted(size, key=lambda s: (s is None, s or "")), (5, 2, 1, 5, 2), strict=True))
    low, high, total = 0.0, 1e6, sum(size.values())
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if sum(min(3 * size[s], weight[s] * mid) for s in size) < total else (low, mid)
    for r in documents:
        s = r["source"]
        assert r["target"] == pytest.approx(min(3 * size[s], weight[s] * low)) and abs(taken[s] - r["target"]) <= 1 and r["source_size"] == size[s]
    assert sum(p["n"] for p in pieces) == sum(taken.values())
    # within an epoch no word is taken twice, and each word at most once more than any other of its source
    spans = defaultdict(list)
    for p in pieces:
        spans[p["source"], p["epoch"], p["start"]] += range(p["first"], p["first"] + p["n"])
    assert all(len(set(x)) == len(x) for x in spans.values())
    again = mixed(spark, rows[::-1])[1]
    assert sorted(documents, key=repr) == sorted(again, key=repr)


def test_slots_follow_their_shares(spark):
    rows = [(f"{s}{i}", " ".join(["w"] * 20), s, 0, 0) for s in "abc" for i in range(200)]
    pieces, documents = mixed(spark, rows, weights=(5, 3, 2))
    by_place = defaultdict(str)
    for p in pieces:
        by_place[p["place"]] = p["source"]
    order = [by_place[k] for k in sorted(by_place)]
    target = {r["source"]: r["target"] / 12000 for r in documents}
    for n in (100, 500, 1500, len(order)):
        got = Counter(order[:n])
        assert all(abs(got[s] - n * target[s]) < 8 for s in "abc")  # random draws would be off by 20 and more


def test_mix_edges(spark):
    assert mixed(spark, []) == ([], [])
    pieces, documents = mixed(spark, [("a", None, "s", 0, 0), ("b", "", None, 0, 0)])
    assert pieces == [] and {(r["doc_id"], r["size"], r["taken"], r["target"]) for r in documents} == {("a", 0, 0, 0.0), ("b", 0, 0, 0.0)}
    pieces, documents = mixed(spark, [("long", " ".join(["w"] * 50_000), "s", 0, 0)], block=64)
    assert documents[0]["taken"] == 50_000 and sorted(p["first"] for p in pieces) == list(range(0, 50_000, 64))
    with pytest.raises(ValueError):
        mixed(spark, [("a", "b", "c", 0, 0)], repeats=9)
    row = spark.createDataFrame([("a  b\tc d",)], "t string").select(mixing.piece_text(F.col("t"), F.lit(1), F.lit(2)).alias("x")).first()
    assert row["x"] == "b c"


# --- runs ---


def brute_runs(w, least=12):
    n, out = len(w), []
    for p in range(1, n // 2 + 1):
        i = 0
        while i + p < n:
            if w[i] != w[i + p]:
                i += 1
                continue
            s = i
            while i + p < n and w[i] == w[i + p]:
                i += 1
            e = i + p
            if e - s >= max(least, 2 * p) and not any(all(w[x] == w[x + q] for x in range(s, e - q)) for q in range(1, p)):
                out.append((s, e - s, p))
    return sorted(out, key=lambda r: (r[0], r[2]))


def test_runs_of_random_words():
    rnd = random.Random(5)
    for _ in range(400):
        documents = []
        for _ in range(rnd.randint(0, 4)):
            k, a = rnd.choice([0, 1, 11, 12, 13, 40, 70]), rnd.choice([1, 2, 3, 9])
            w = [b"%d" % rnd.randrange(a) for _ in range(k)]
            if k and rnd.random() < 0.5:
                x = rnd.randrange(k)
                p = rnd.randint(1, max(1, (k - x) // 3))
                w = [w[i] if i < x else w[x + (i - x) % p] for i in range(k)]
            documents.append(w)
        least = rnd.choice([12, 12, 1, 2, 5, 8])
        sizes = np.array([len(d) for d in documents], np.int64)
        starts = np.cumsum(sizes) - sizes
        got = [tuple(r) for r in periodic.find_runs(periodic.numbered(documents), starts, sizes, least).tolist()]
        assert got == [(s + a, s + a + n, p) for w, a in zip(documents, starts.tolist(), strict=True) for s, n, p in brute_runs(w, least)]


def contract_words(doc_id, w):
    h = zlib.crc32(str(doc_id).encode())
    g, n = h // 10, len(w)
    if h % 10 or not n:
        return w
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def test_op12_by_brute_force(spark):
    got = {r["doc_id"]: r for r in registry.op12_periodic_runs(spark, SF).collect()}
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    assert len(got) == len(docs) and sum(r["n_runs"] for r in got.values()) >= 15
    for r in docs:
        w = contract_words(r["doc_id"], words(r["text"]))
        runs = brute_runs(w) if len(w) < 1500 else None
        x = got[r["doc_id"]]
        if runs is None:
            continue
        best = min(runs, key=lambda t: (-t[1], t[0], t[2])) if runs else (None, None, None)
        dropped = {i for s, n, p in runs for i in range(s + p, s + n)}
        want = (len(runs), *best, 1000 * best[1] // best[2] if runs else None, sha("".join(f"{s},{n},{p}\n" for s, n, p in runs)), sha(" ".join(t for i, t in enumerate(w) if i not in dropped)))
        assert tuple(x[c] for c in ("n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256")) == want


def test_runs_edges(spark):
    many = "a b " * 30_000
    rows = [(1, None, "x"), (2, "", "x"), (3, " \t\n", "x"), (4, "a " * 12, "x"), (4, "a " * 12, "x"), (5, many, "x"), (6, "é é é é " * 7, "x"), (None, "q", "x")]
    df = periodic.collapse(spark.createDataFrame(rows, "doc_id int, text string, runs string"))
    assert df.columns == ["doc_id", "text", "n_words", "runs", "collapsed"]
    got = [(r["doc_id"], r["n_words"], [tuple(x) for x in r["runs"]], r["collapsed"]) for r in df.collect()]
    want = [(1, 0, [], ""), (2, 0, [], ""), (3, 0, [], ""), (4, 12, [(0, 12, 1)], "a"), (4, 12, [(0, 12, 1)], "a"), (5, 60_000, [(0, 60_000, 2)], "a b"), (6, 14, [(0, 14, 1)], "é é"), (None, 1, [], "q")]
    assert sorted(got, key=repr) == sorted(want, key=repr)
    assert periodic.digest(periodic.collapse(spark.createDataFrame([], "doc_id int, text string"))).count() == 0


# --- divergence ---


def brute_audit(rows, least, top=50):
    lower = lambda t: re.sub("[A-Z]", lambda m: m[0].lower(), t or "")
    count, documents, groups = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for text, lang, source in rows:
        terms = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", lower(text))
        groups[lang or ""].add(source or "")
        count[lang or "", source or ""].update(terms)
        documents[lang or ""].update(set(terms))
    out = set()
    for lang, sources in groups.items():
        kept = sorted(t for t, n in documents[lang].items() if n >= least)
        total = sum((count[lang, s] for s in sources), Counter())
        n = {s: sum(count[lang, s][t] for t in kept) for s in sources}
        p = {s: {t: 1 + 10**9 * (count[lang, s][t] + 5) // (n[s] + 5 * len(kept)) for t in kept} for s in sources}
        q = {t: 1 + 10**9 * (total[t] + 5) // (sum(n.values()) + 5 * len(kept)) for t in kept}
        for s in sources:
            pairs = [(sum(abs(p[s][t] - p[o][t]) for t in kept), o) for o in sources if o != s]
            terms = [(p[s][t] - q[t], t) for t in kept if count[lang, s][t] and p[s][t] > q[t]]
            for part, items in (("pair", pairs), ("term", terms)):
                ranked = sorted(items, key=lambda x: (-x[0], x[1].encode()))
                out |= {(lang, s, part, item, value, k) for k, (value, item) in enumerate(ranked, 1) if part == "pair" or k <= top}
    return out


def test_tries_written_out_early_merge_to_the_same(monkeypatch):
    """Tasks that flush their tries after a few words and leaves give, merged in any order, what one task gives."""
    import pyarrow as pa

    rnd = random.Random(6)
    terms = [chr(97 + i % 26) * (1 + i // 26) + rnd.choice(["", "é", "日"]) for i in range(80)]
    rows = [(rnd.choice("xyz"), rnd.choice(["a", "b", "ü"]), " ".join(rnd.choices(terms, k=rnd.randint(0, 12)))) for _ in range(300)]
    batch = lambda part: pa.RecordBatch.from_pylist([dict(zip(("lang", "source", "text"), r, strict=True)) for r in part])

    def merged(counted):
        out = defaultdict(list)
        for b in divergence._merge(3)(iter(counted)):
            for r in b.to_pylist():
                assert len(r["terms"]) <= divergence.BLOCK
                out[r["lang"]].append([(t, sorted((s, n) for k, s, n in zip(r["term"], r["source"], r["n"], strict=True) if k == i)) for i, t in enumerate(r["terms"])])
        return {lang: sum(blocks, []) for lang, blocks in out.items()}

    whole = merged(divergence._count(iter([batch(rows)])))
    assert all([t for t, _ in x] == sorted((t for t, _ in x), key=str.encode) for x in whole.values()) and len(whole) == 3
    for name, value in (("WORDS", 30), ("LEAVES", 25), ("BLOCK", 7)):
        monkeypatch.setattr(divergence, name, value)
    parts = [b for k in range(3) for b in divergence._count(iter([batch(rows[k::3][:50]), batch(rows[k::3][50:])]))]
    rnd.shuffle(parts)
    assert len(parts) > 30 and merged(parts) == whole
    assert merged([]) == {} and list(divergence._count(iter([]))) == []


def test_audit_by_brute_force(spark):
    rnd = random.Random(9)
    vocabulary = ["the", "The", "ÉTÉ", "été", "日本", "z", "ab", "abc", "abd", "b", "\U0001f600x", "ￚ"] + [f"t{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(60)]
    rows = [(" ".join(rnd.choices(vocabulary, k=rnd.randint(0, 30))) + " 12 a-b_c", rnd.choice(["en", "EN", None, ""]), rnd.choice(["s1", "s2", "é", None])) for _ in range(90)]
    rows += [(None, "one", "s1"), ("", "one", "s2"), ("x y", "alone", None), ("!!", "en", "silent")] + [("same same", "en", "s1")] * 4
    got = divergence.audit(spark.createDataFrame(rows, "text string, lang string, source string").withColumn("value", F.lit(1)).repartition(5), least_documents=4)
    assert got.columns == ["lang", "source", "part", "item", "value", "rank"]
    found = [tuple(r) for r in got.collect()]
    assert len(found) == len(set(found)) and set(found) == brute_audit(rows, 4)


def test_audit_edges(spark):
    assert divergence.audit(spark.createDataFrame([], "text string, lang string, source string")).count() == 0
    long = spark.createDataFrame([(" ".join(f"w{chr(97 + i % 26)}" for i in range(200_000)), "l", "s")], "text string, lang string, source string")
    assert divergence.audit(long, least_documents=1).count() == 0  # the only source doesn't differ from its language


def test_billionths_are_exact():
    rnd = random.Random(1)
    for _ in range(2000):
        of = rnd.randint(1, 9 * 10**15)
        count = rnd.randint(0, of)
        assert divergence.billionths(np.array([count]), np.array([of]))[0] == 10**9 * count // of
