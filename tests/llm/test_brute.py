"""The queries of the subpackage against SQL and brute force, over whole tables at the smallest scale."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from larkspur.llm import registry
from tests.oracle import differs

SF = "/root/testdata/sf0.001"
QUERIES, SQL = registry.queries(), registry.oracle_sql()
SPACE = re.compile(r"[\x20\x09-\x0d]+")


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text)


def words(text):
    return [w for w in SPACE.split(text or "") if w]


@pytest.fixture(scope="module")
def docs(spark):
    return {r["doc_id"]: r for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}


def rows(spark, name):
    return {r["doc_id"]: r for r in QUERIES[name](spark, SF).collect()}


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_as_sql(spark, name):
    assert differs(QUERIES[name](spark, SF), SQL[name], SF) == ""


def test_near_duplicates_are_the_components_of_all_pairs(spark, docs):
    sets = {}
    for i, r in docs.items():
        w = words(lower(r["text"] or ""))
        sets[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else {()}
    parent = {i: i for i in sets}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a in sets:
        for b in sets:
            if a < b and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                x, y = sorted((root(a), root(b)))
                parent[y] = x
    assert {i: r["class_id"] for i, r in rows(spark, "op2_minhash_dedup").items()} == {i: root(i) for i in sets}


def one_edit(a, b):
    """Whether b is a with one character inserted, deleted or replaced."""
    if abs(len(a) - len(b)) > 1:
        return False
    k = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
    return a[k + 1 :] == b[k + 1 :] or a[k:] == b[k + 1 :] or a[k + 1 :] == b[k:]


def test_lines_go_where_an_earlier_one_is_near(spark, docs):
    first = {}
    for i in sorted(docs):
        for n, line in enumerate((docs[i]["text"] or "").split("\n")):
            if re.search(r"[^ \t\n\x0b\f\r]", line):
                first.setdefault(line, (i, n))
    order = sorted(first, key=first.get)
    by_length, near = defaultdict(list), set()
    for line in order:
        if any(one_edit(x, line) for k in (-1, 0, 1) for x in by_length[len(line) + k]):
            near.add(line)
        by_length[len(line)].append(line)
    got = rows(spark, "op6_line_dedup")
    for i, r in docs.items():
        lines = None if r["text"] is None else r["text"].split("\n")
        kept = [x for n, x in enumerate(lines or []) if x not in first or x not in near and first[x] == (i, n)]
        want = "" if lines is None else "\n".join(kept)
        assert got[i]["text_sha256"] == hashlib.sha256(want.encode()).hexdigest(), i


def test_languages_of_held_out_documents(spark, docs):
    got = rows(spark, "op7_language_id")
    held = [(r["lang_pred"], docs[i]["lang"]) for i, r in got.items() if r["held_out"] and docs[i]["lang"] and r["lang_pred"] != "und"]
    assert all(r["held_out"] == (zlib.crc32(str(i).encode()) % 4 == 2) and 0 <= r["score"] <= 1 for i, r in got.items())
    assert np.mean([a == b for a, b in held]) >= 0.95


def test_base_scores_of_the_language_model(spark, docs):
    tokens = {i: [*words(lower(r["text"] or "")), None] for i, r in docs.items()}
    held = {i: zlib.crc32(str(i).encode()) % 7 == 2 for i in docs}
    c = Counter(t for i in docs if not held[i] for t in tokens[i])
    total = sum(c.values())
    got = rows(spark, "op8_lm_scoring")
    for i, r in got.items():
        t = tokens[i]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (held[i], len(t), sum(c[x] > 0 for x in t), total)
        assert r["base_score"] == pytest.approx(sum(np.log10((c[x] + 1) / (total + len(c) + 1)) for x in t), rel=1e-9)
    assert sum(r["score"] for i, r in got.items() if held[i]) > sum(r["base_score"] for i, r in got.items() if held[i])


def test_quality_counts(spark, docs):
    for i, r in rows(spark, "op9_quality_rules").items():
        text = docs[i]["text"] or ""
        w = words(text)
        seen = Counter(zip(w, w[1:], w[2:]))
        covered = {k + j for k, x in enumerate(zip(w, w[1:], w[2:])) if seen[x] > 1 for j in range(3)}
        lines = [x for x in text.split("\n") if words(x)]
        want = (len(w), sum(map(len, w)), sum(text.count(x) for x in "#*$%&|<>"), len(lines) - len(set(lines)), len(covered))
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == want
        failed = len(w) < 50 or 100 * len(covered) > 50 * len(w)
        assert r["base_failed"] == failed and not (failed and r["kept"])


def test_tokens_are_the_libraries(spark, docs):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(registry.tokenizer_path())
    t.no_truncation()
    t.no_padding()
    for i, r in rows(spark, "op10_bpe").items():
        ids = t.encode(docs[i]["text"] or "", add_special_tokens=False).ids
        assert r["ids_sha256"] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest() and r["n_tokens"] == len(ids)
        assert r["decoded_sha256"] == hashlib.sha256(t.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_pipeline_is_its_stages_by_brute_force(spark, docs):
    import corpus_pipeline
    from larkspur.llm import decontamination, language, line_dedup, minhash

    assert [n for n, _ in corpus_pipeline.STAGES] == ["language ID", "line dedup", "MinHash near-dedup", "benchmark decontamination", "BPE encoding and decoding"]
    frame = spark.read.parquet(f"{SF}/documents.parquet")
    known = corpus_pipeline.language_id(spark, frame, SF)
    assert known.columns == frame.columns
    told = {r["doc_id"]: r["rejected"] for r in language.identify(frame, language.fit(frame)).collect()}
    assert {r["doc_id"] for r in known.collect()} == {i for i, x in told.items() if not x}
    assert sum(told.values()) < 0.1 * len(told)
    out = {r["doc_id"] for r in corpus_pipeline.run(spark, SF).collect()}
    lines = line_dedup.dedup_lines(known).where("n_dropped = 0 OR n_dropped < n_lines").select("doc_id", "text")
    one = minhash.keep_one(lines)
    clean = decontamination.decontaminate(one, spark.read.parquet(f"{SF}/benchmark.parquet")).where("NOT contaminated")
    assert out == {r["doc_id"] for r in clean.select("doc_id").collect()}


def test_quality_scores_and_verdicts(spark, docs):
    import math

    import xxhash

    from larkspur.llm import quality

    def h(*parts):
        seed = 42
        for p in parts:
            seed = xxhash.xxh64_intdigest(p.encode(), seed)
        return seed - (1 << 64) * (seed >= 1 << 63)

    def grams(text):
        w = words(text)
        return [h(x) % quality.BUCKETS for x in w] + [h(x, y) % quality.BUCKETS for x, y in zip(w, w[1:])]

    good = {r["doc_id"] for r in spark.read.parquet(f"{SF}/labels.parquet").where("quality = 1").collect()}
    raw, target = Counter(), Counter()
    for i, r in docs.items():
        g = grams(r["text"])
        raw.update(g)
        if i in good:
            target.update(g)
    n, m = sum(raw.values()) + quality.BUCKETS, sum(target.values()) + quality.BUCKETS
    ratio = [math.log((target[b] + 1) / m) - math.log((raw[b] + 1) / n) for b in range(quality.BUCKETS)]
    for i, r in rows(spark, "op9_quality_rules").items():
        g = grams(docs[i]["text"])
        want = sum(ratio[b] for b in g) / len(g) if g else 0.0
        assert r["score"] == pytest.approx(want, abs=3e-6)
        assert r["kept"] == (not r["base_failed"] and r["score"] >= quality.THRESHOLD)


def test_kneser_ney_is_that_of_a_naive_computation():
    """Order 3 over words with their start mark, by plain dictionaries."""
    from larkspur.llm.charlm import kneser_ney

    text = {"banana": 3, "band": 2, "nab": 1, "an": 4, "ab": 1}
    model = kneser_ney({"x": (list(text), np.array(list(text.values())))}, 3)
    seen = {m: Counter() for m in (1, 2, 3)}
    for w, c in text.items():
        s = "<" + w + ">"
        for k in range(1, len(s)):
            seen[min(k + 1, 3)][s[max(0, k - 2) : k + 1]] += c  # from the start mark on, shorter ones count as seen
    for m in (2, 1):
        for g in seen[m + 1]:
            seen[m][g[1:]] += 1
    symbols = len(seen[1]) + 1

    def discount(m):
        one, two = (sum(c == k for c in seen[m].values()) for k in (1, 2))
        return min(max(one / max(one + 2 * two, 1), 0.1), 0.95)

    def p(g):
        if not g:
            return 1 / symbols
        of = {k: c for k, c in seen[len(g)].items() if k[:-1] == g[:-1]}
        if not of:
            return p(g[1:])
        d, total = discount(len(g)), sum(of.values())
        return max(of.get(g, 0) - d, 0) / total + d * len(of) / total * p(g[1:])

    for w in ("banana", "bad", "nan", "a", "zab"):
        s = "<" + w + ">"
        want = sum(np.log(p(s[max(0, k - 2) : k + 1])) for k in range(1, len(s)))
        assert model.word_logs([w])[0, 0] == pytest.approx(want, rel=1e-4)


def test_recall_of_near_duplicates_at_a_larger_scale(spark):
    """Every pair of similarity 0.8 or more at sf0.01, found by brute force, is in one class."""
    from larkspur.llm import minhash

    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    sets, where = {}, defaultdict(list)
    for r in docs.collect():
        w = words(lower(r["text"] or ""))
        sets[r["doc_id"]] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else {()}
    pairs = 0
    shared = Counter()
    for i, s in sets.items():
        for x in s:
            shared.update((j, i) for j in where[x])
            where[x].append(i)
    got = {r["doc_id"]: r["class_id"] for r in minhash.near_duplicates(docs).collect()}
    for (a, b), n in shared.items():
        if n >= 0.8 * (len(sets[a]) + len(sets[b]) - n):
            pairs += 1
            assert got[a] == got[b], (a, b)
    assert pairs >= 100
