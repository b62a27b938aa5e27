"""The Pitman-Yor model against exact sums, and its independence of partitions."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from larkspur.llm import hpylm, registry
from larkspur.llm.charlm import mix

SF = "/root/testdata/sf0.001"


def stirling(n, d):
    s = [[0.0] * (n + 2) for _ in range(n + 1)]
    s[0][0] = 1.0
    for c in range(1, n + 1):
        for t in range(1, c + 1):
            s[c][t] = s[c - 1][t - 1] + (c - 1 - d * t) * s[c - 1][t]
    return s


def cells(c, d, n):
    """n restaurants with one cell of c customers each."""
    return hpylm.Level(np.full(n, c), np.ones(n, np.int64), np.arange(n), n, mix(np.uint64(9), np.arange(n, dtype=np.uint64)), d)


@pytest.mark.parametrize("c,d,p", [(2, 0.5, 0.3), (6, 0.7, 0.1), (9, 0.4, 0.5)])
def test_sweeps_sample_the_exact_distribution_of_tables(c, d, p):
    exact, s = np.zeros(c + 1), stirling(c, d)
    weight = 1.0
    for t in range(1, c + 1):
        weight *= (hpylm.STRENGTH + d * (t - 1)) * p
        exact[t] = weight * s[c][t]
    exact /= exact.sum()
    n = 20_000
    level = cells(c, d, n)
    for number in range(25):
        level.sweep(np.full(n, p), number)
    assert np.abs(np.bincount(level.t, minlength=c + 1) / n - exact).max() < 0.015
    # customers that come and go leave it as it is
    level.adjust(np.full(n, c + 2), np.full(n, p), 77)
    level.adjust(np.full(n, c), np.full(n, p), 78)
    level.sweep(np.full(n, p), 79)
    assert np.abs(np.bincount(level.t, minlength=c + 1) / n - exact).max() < 0.015


def test_the_chance_of_sitting_alone():
    s = stirling(12, 0.6)
    for c in range(2, 13):
        for t in range(1, c + 1):
            assert hpylm.alone(0.6)[c, t] == pytest.approx(s[c - 1][t - 1] / s[c][t], abs=1e-12)
    # beyond the table: close to the ratio of a longer one
    long = hpylm.alone(0.6, 2000)
    c, t = np.array([2000, 1500, 1000]), np.array([60, 30, 5])
    assert hpylm.leaves_alone(c, t, 0.6) == pytest.approx(long[c, t], rel=0.1)


def test_probabilities_of_all_words_sum_to_one():
    rng = np.random.default_rng(3)
    w = rng.integers(0, 6, 400)
    w1, w2 = np.concatenate([[7, 7], w[:-2]]), np.concatenate([[7], w[:-1]])
    # every word once after every pair of words, in a held-out document
    a, b, c = (x.ravel() for x in np.meshgrid(np.arange(8), np.arange(8), np.arange(8), indexing="ij"))
    cols = [np.concatenate(x) for x in ((w2, b), (w1, a), (w, c), (np.zeros(400, np.int64), np.ones(512, np.int64)))]
    order = np.argsort(cols[0], kind="stable")
    w2, w1, w, doc = (x[order] for x in cols)
    runs = np.append(np.flatnonzero(np.diff(w2, prepend=-1)), len(w2))
    held = hpylm.Contexts([hpylm.pack(np.diff(w2[runs[:-1]], prepend=0), np.zeros(len(runs) - 1, np.int64), np.diff(runs), w1, w, doc)])
    mean = held.sample(np.full(8, 1 / 8), 6, 2, 5)[held.cell]
    total = {}
    for i in np.flatnonzero(held.doc & 1):
        total[(w1[i], w2[i])] = total.get((w1[i], w2[i]), 0) + mean[i]
    assert len(total) == 64 and np.allclose(list(total.values()), 1)
    assert (held.two.c == np.bincount(held.up, held.three.t, len(held.two.c))).all() and (held.two.t <= held.two.c).all()


def test_tables_by_jumps_are_those_of_seating_one_by_one():
    n, c, d, p0 = 3000, 150, 0.6, 0.05
    rng, slow = np.random.default_rng(1), []
    for _ in range(n):
        t = 1
        for k in range(1, c):
            new = (1.0 + d * (10 + t)) * p0
            t += rng.random() < new / (new + k - d * t)
        slow.append(t)
    level = cells(c, d, n)
    hpylm.seat_anew(level, 10, p0, 1)
    assert np.abs(np.bincount(level.t, minlength=30)[:30] - np.bincount(slow, minlength=30)[:30]).max() < 0.04 * n


def test_customers_come_and_go_as_one_by_one_with_few_calls(monkeypatch):
    c, goal = np.array([1, 40, 2500, 7, 3]), np.array([3000, 2, 300, 7, 9])
    level = cells(c, 0.6, 5)
    level.t = np.array([1, 9, 60, 3, 2])
    level.context, level.contexts = np.array([0, 0, 0, 1, 1]), 2
    level.__post_init__()
    p, want = np.array([0.2, 0.1, 0.3, 0.2, 0.4]), level.t.copy()
    others = level.tables()[level.context] - level.t
    for i in range(5):
        now, t = c[i : i + 1], want[i : i + 1]
        for step in range(1, abs(goal[i] - c[i]) + 1):
            off, on = hpylm.uniform(level.seed[i : i + 1], 31, step, 3)
            if goal[i] > c[i]:
                t += level._opens(t, now, others[i : i + 1], p[i : i + 1], on)
            else:
                t -= off < hpylm.leaves_alone(now, t, 0.6)
            now = now + np.sign(goal[i] - c[i])
    calls = []
    monkeypatch.setattr(hpylm, "mix", lambda h, code: calls.append(1) or mix(h, code))
    level.adjust(goal, p, 31)
    assert (level.t == want).all() and (level.c == goal).all()
    assert len(calls) < 100  # draws are made for many steps at once; they were made step by step


@pytest.mark.parametrize("most", [50, 1 << 40, 1 << 60])
def test_places_and_numbers_of_distinct_keys(most):
    x = np.random.default_rng(2).integers(0, most, 3000)
    x[::3] = x[0]
    found, number = np.unique(x, return_inverse=True)
    first, cell = hpylm._cells(x)
    assert (x[first] == found).all() and (cell == number).all()
    assert all((a == b).all() for a, b in zip(hpylm._distinct(x), (found, number), strict=True))


def test_scores_do_not_depend_on_partitions(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    got = []
    before = spark.conf.get("spark.sql.shuffle.partitions")
    for n in (3, 17):
        spark.conf.set("spark.sql.shuffle.partitions", str(n))
        scored = hpylm.score_documents(docs.repartition(n), F.col("doc_id") % 7 == 2)
        got.append({r["doc_id"]: r["score"] for r in scored.collect()})
    spark.conf.set("spark.sql.shuffle.partitions", before)
    assert got[0] == got[1]


def test_held_out_perplexity_is_below_that_of_single_words(spark):
    out = {r["held_out"]: r for r in hpylm.perplexity(registry.queries()["op8_lm_scoring"](spark, SF)).collect()}
    assert out[True]["perplexity"] < 0.5 * out[True]["base_perplexity"] and out[False]["perplexity"] < out[True]["perplexity"]


def test_ids_of_any_type_and_a_divided_context(spark, monkeypatch):
    monkeypatch.setattr(hpylm, "LIMIT", 5)
    docs = spark.createDataFrame([(f"d{i}", "the cat the dog the bird the cow " * 5) for i in range(4)] + [("long", "x" * 300_000)], "name string, text string")
    out = {r["doc_id"]: r for r in hpylm.score_documents(docs, F.lit(False), doc_id="name").collect()}
    assert set(out) == {"d0", "d1", "d2", "d3", "long"} and all(r["score"] < 0 for r in out.values())


@pytest.mark.parametrize(("c", "t", "others", "p"), [(200, 1, 3, 0.3), (400, 200, 5, 0.01), (1000, 400, 5, 0.001)])
def test_a_sweep_takes_out_all_customers_of_a_cell(c, t, others, p):
    """As taking out one customer after another, by chains of tables: exact chances of each number of tables after c steps."""
    d, n = 0.6, 4000
    chance = np.zeros(c + 2)
    chance[t] = 1.0
    tables = np.arange(c + 2)
    leaves = hpylm.leaves_alone(np.full(c + 1, c), tables[:-1], d)
    leaves[0] = 0
    new = (hpylm.STRENGTH + d * (others + tables)) * p
    opens = new / (new + np.maximum(c - 1 - d * tables, 0))
    for _ in range(c):
        gone = np.append(chance[1:], 0) * np.append(np.append(leaves, 0)[1:], 0)
        now = gone + chance * (1 - np.append(leaves, 0))
        chance = now * (1 - opens) + np.append(0, (now * opens)[:-1])
    mean = float((chance * tables).sum())
    spread = float((chance * tables**2).sum() - mean**2) ** 0.5
    level = hpylm.Level(np.full(n, c), np.full(n, t), np.zeros(n, np.int64), 1, hpylm.mix(np.uint64(3), np.arange(n).astype(np.uint64)), d)
    level.sweep(np.full(n, p), 5, np.full(n, others))
    assert abs(level.t.mean() - mean) < 5 * spread / n**0.5
    assert abs(level.t.std() - spread) < 0.1 * spread
