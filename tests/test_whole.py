"""Queries over ids beyond the first ones, against brute force on small tables."""

from datetime import datetime

import pytest

from larkspur.operators import market

#: variant, shop, run, line, price, month of 1998
SEEN = [(7, 1, 1, 1, 500, 1), (7, 2, 2, 1, 400, 1), (7, 9, 3, 1, 450, 4), (201, 6, 4, 1, 300, 2), (201, 7, 5, 1, 350, 5), (5000, 99, 6, 1, 900, 3)]


@pytest.fixture(scope="module")
def small(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("whole"))
    rows = [(v, s, run, line, float(p), 0.0, 1.0, "O", datetime(1998, m, 10)) for v, s, run, line, p, m in SEEN]
    kinds = "l_partkey bigint, l_suppkey bigint, l_orderkey bigint, l_linenumber int, l_extendedprice double, l_discount double, l_quantity double, l_linestatus string, l_shipdate timestamp_ntz"
    spark.createDataFrame(rows, kinds).write.parquet(f"{path}/lineitem.parquet")
    return path


def test_prices_of_all_variants_are_carried(spark, small):
    want = set()
    for v in {x[0] for x in SEEN}:
        low = {}
        for x in SEEN:
            if x[0] == v:
                low[x[5]] = min(x[4], low.get(x[5], x[4]))
        last = None
        for m in range(min(low), max(low) + 1):
            last = low.get(m, last)
            want.add((v, f"1998-{m:02}", low.get(m), last))
    got = market.best_price_carried(spark, small).collect()
    assert len(got) == len(want) and {tuple(r) for r in got} == want


def test_the_matrix_has_all_variants_and_shops(spark, small):
    last = {(x[0], x[1]): x[4] for x in SEEN}
    got = {r["variant_id"]: r for r in market.comparison_matrix(spark, small).collect()}
    assert {(v, shop): c["price"] for v, r in got.items() for shop, c in r["cells"].items()} == last
    assert [got[7][f"shop_{i}"] for i in range(1, 6)] == [500, 400, None, None, None]
    assert {v: r["min_price"] for v, r in got.items()} == {7: 400, 201: 300, 5000: 900}


def test_ranks_are_exact_and_of_real_markets(spark, tmp_path):
    rows = [(1, s, s, 1, 100.0 * s, 0.0, 1.0, "O", datetime(1998, 6, 1)) for s in range(1, 10)] + [(2, 1, 20, 1, 50.0, 0.0, 1.0, "O", datetime(1998, 6, 1))]
    kinds = "l_partkey bigint, l_suppkey bigint, l_orderkey bigint, l_linenumber int, l_extendedprice double, l_discount double, l_quantity double, l_linestatus string, l_shipdate timestamp_ntz"
    spark.createDataFrame(rows, kinds).write.parquet(f"{tmp_path}/lineitem.parquet")
    got = {(r["shop_id"], r["rank"], r["n"], r["share_pct"]) for r in market.rank_distribution(spark, str(tmp_path)).select("shop_id", "rank", "n", "share_pct").collect()}
    assert got == {(s, s, 1, 100.0) for s in range(1, 10)}
