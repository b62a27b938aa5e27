"""Prices of hand-made pages; the derived pages are held against SQL in test_queries."""

from larkspur.operators import prices

BANNER = '<div class="ship">Ingyenes szállítás <span class="price">15.000 Ft</span> felett</div>'
# page: current, method, regular, member, coupon, quantity, unit, deposit, unit_basis, mismatch
N = None
CASES = {
    '<span class="price">3 790 Ft</span>': (3790, "dom"),
    '<div class="top">Ingyenes szállítás 15 000 Ft felett!</div><h1>Bor 2019</h1>': (N, N),
    '<div class="top">Ingyenes szállítás 15 000 Ft felett!</div><h1>Bor</h1><div class="adat">A bor ára: 4 990 Ft</div>': (4990, "dom"),
    '<span class="price note">Ingyenes szállítás 15 000 Ft felett</span><span class="price">6 490 Ft</span>': (6490, "dom"),
    BANNER: (N, N),
    '<div><b>Ingyenes kiszállítás</b> <span class="amount">15 000 Ft</span> <i>felett</i></div>': (N, N),
    BANNER + '<span class="price product-price">4 990 Ft</span>': (4990, "dom"),
    '<span class="price">5 200 Ft</span><div class="badge">Ingyenes szállítás 15 000 Ft felett</div>': (5200, "dom"),
    '<div><span class="price">15 000 Ft</span> felett ingyenes a szállítás</div>': (N, N),
    '<div class="news">18 év felett!</div><span class="price">5 200 Ft</span>': (5200, "dom"),
    '<p>Minimum rendelés <span class="price">9 000 Ft</span></p>': (N, N),
    '<p>Min. rendelés <span class="price">9 000 Ft</span></p><b class="price">x</b> <span class="price">800 Ft</span>': (800, "dom"),
    '<div>Szállítás 990 Ft, <span class="price">2 500 Ft</span></div>': (2500, "dom"),
    '<p class="price"><del>6 000 Ft</del> <ins>4 500 Ft</ins></p>': (4500, "dom", 6000),
    '<span class="old-price">7 000 Ft</span><span class="price">5 000 Ft</span><span class="old-price">8 000 Ft</span>': (5000, "dom", 8000),
    '<div class="price">Klub tag ár: 4 000 Ft</div><span class="price">5 000 Ft</span><p class="unit price">egysegar 6 667 Ft / liter</p><p class="price">betetdij 70 Ft</p>': (5000, "dom", N, 4000, N, N, 6667, 70, "liter"),
    '<span class="price">coupon 3 100 Ft</span><span class="price">nagyker 2 900 HUF</span><span class="price">3 300 forint</span>': (3300, "dom", N, N, 3100, 2900),
    '<meta property="product:price:amount" content="4990"><span class="price">4 990 Ft</span>': (4990, "meta"),
    '<meta property="product:price:amount" content="4990"><span class="price">6 990 Ft</span>': (4990, "meta", N, N, N, N, N, N, N, True),
    '<script type="application/ld+json">{"@type":"Product","offers":{"price":"3500"}}</script><meta name="price" content="1"><span class="price">3 540 Ft</span>': (3500, "jsonld"),
    '<script type="application/ld+json">[{"@type":["Thing","Product"],"offers":[{"price":3500.5}]}]</script>': (N, N),
    '<script type="application/ld+json">{"@type":"Product","offers":[{"price":3500.5,"priceSpecification":{"priceType":"https://schema.org/ListPrice","price":4200}}]}</script>': (3501, "jsonld", 4200),
    '<span class="title">1 000 Ft</span>': (1000, "dom"),  # from the plain text
    '<span class="title">100 Ft</span> <b>250 Ft</b>': (250, "dom"),
    '<span class="price">unclosed 1 200 Ft': (1200, "dom"),
    "": (N, N),
    "no price at all, 12 Forts": (N, N),
}


def test_cases(spark):
    pages = spark.createDataFrame(list(enumerate(CASES)), "page_id int, html string")
    got = {r["page_id"]: r for r in prices.extract_prices(pages).collect()}
    columns = ("current", "method", "regular", "member", "coupon", "quantity", "unit", "deposit", "unit_basis", "mismatch")
    for i, (html, want) in enumerate(CASES.items()):
        full = (*want, *[None] * (9 - len(want)), False) if len(want) < 10 else want
        assert tuple(got[i][c] for c in columns) == full, html


def test_edges(spark):
    long = "<p>x</p>" * 5_000 + '<span class="price">1 500 Ft</span>' + "y" * 50_000
    rows = [(1, None, 5), (None, '<span class="price">900 Ft</span>', 5), (2, long, 5), (2, long, 5)]
    out = prices.extract_prices(spark.createDataFrame(rows, "page_id int, html string, current int"))
    assert sorted(((r["page_id"], r["current"]) for r in out.collect()), key=repr) == [(1, None), (2, 1500), (None, 900)]
    assert prices.extract_prices(spark.createDataFrame([], "page_id int, html string")).count() == 0


def test_texts_are_read_once(spark, monkeypatch):
    counts, write = {}, prices.written

    def count(df, name):
        out = write(df, name)
        counts[name] = out.count()
        return out

    monkeypatch.setattr(prices, "written", count)
    rows = [(i, '<span class="price">900 Ft</span>') for i in range(40)] + [(99, "<p>800 Ft</p>"), (99, '<span class="price">700 Ft</span>')]
    out = prices.extract_prices(spark.createDataFrame(rows, "page_id int, html string")).collect()
    assert {r["current"] for r in out if r["page_id"] < 40} == {900} and [r["current"] for r in out if r["page_id"] == 99] == [700]
    assert len(out) == 41 and counts["texts"] == 3
