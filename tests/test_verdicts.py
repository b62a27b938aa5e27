"""Verdicts on hand-made fetches."""

from larkspur.functions import web
from larkspur.operators import pages
from tests.oracle import differs

LONG = "<p>" + "Szép bor, jó ár. " * 60 + "</p>"
PRODUCT = '<script type="application/ld+json">{"@type": "Product"}</script>'
SITE = '<script>{"@type":"WebSite"}</script>'
# (status, type, html): verdict, gone
CASES = {
    (200, "text/html", LONG): ("ok", False), (429, "text/html", LONG): ("rate_limited", False), (403, "text/html", LONG): ("challenge", False), (401, "", LONG): ("challenge", False), (502, "", ""): ("challenge", False),
    (200, "application/json", '{"captcha": 1}'): ("ok", False), (200, "text/plain", "  <html>short</html>"): ("empty_shell", False), (404, "application/json", "{}"): ("ok", False),
    (200, "text/html", "<title>Just a moment...</title>" + LONG): ("challenge", False), (200, "text/html", "<title>Hozzáférés megtagadva</title>" + LONG): ("challenge", False),
    (200, "text/html", LONG + '<div class="g-recaptcha">'): ("ok", False), (200, "text/html", '<div class="g-recaptcha">'): ("challenge", False), (200, "text/html", SITE + "captcha"): ("ok", False),
    (200, "text/html", LONG + '<form id="login">' + PRODUCT): ("ok", False), (200, "text/html", LONG + '<form id="login">'): ("ok", False), (200, "text/html", '<form action="/login">'): ("login_required", False),
    (200, "text/html", "<p>Elmúltam 18</p>"): ("age_gate", False), (200, "text/html", "<p>Age verification</p>" + LONG): ("ok", False), (200, "text/html", '<p>Életkor ellenőrzés</p><b itemtype="http://schema.org/Product">'): ("empty_shell", False),
    (404, "text/html", LONG): ("soft_404", True), (404, "text/html", '<form action="/login">'): ("login_required", False), (410, "text/html", LONG): ("ok", True), (410, "text/html", "<title>Access denied</title>"): ("challenge", False),
    (200, "text/html", LONG + "A keresett oldal nem található"): ("soft_404", True), (200, "text/html", LONG * 90 + "<p>Product no longer available</p>"): ("soft_404", True), (200, "text/html", "<title>404</title>"): ("soft_404", True),
    (200, "text/html", "<script>" + "x" * 999 + "</script>"): ("empty_shell", False), (200, "text/html", PRODUCT): ("ok", False), (None, "text/html", None): ("empty_shell", False), (None, None, None): ("ok", False),
}


def test_cases(spark):
    df = spark.createDataFrame([(*k, "own", i) for i, k in enumerate(CASES)], "status int, type string, html string, verdict string, n int")
    out = web.verdicts(df, content_type="type")
    got = {r["n"]: (r["verdict"], r["gone"]) for r in out.collect()}
    for i, (k, want) in enumerate(CASES.items()):
        assert got[i] == want, (k[0], k[1], (k[2] or "")[:80])


def test_pages_of_any_length_are_as_in_the_sql(spark, tmp_path):
    # texts of 330 to 412 characters with each mark, status and kind of product; some pages end within a tag or have a script
    rows = [(i, ("<html><body><p>", "<script>var x = 1;</script><i>")[i % 2] + "x" * (330 + i % 83) + ("</p></body></html>", "", '<a href="')[i % 17 % 3]) for i in range(6000)]
    spark.createDataFrame([*rows, (6001, None), (6002, "")], "page_id bigint, html string").coalesce(1).write.parquet(f"{tmp_path}/all")
    next((tmp_path / "all").glob("*.parquet")).rename(tmp_path / "pages.parquet")
    assert differs(pages.page_verdicts(spark, str(tmp_path)), pages.ORACLES["page_verdicts"], str(tmp_path)) == ""


def test_numbers_in_titles_are_no_marks(spark, tmp_path):
    # telephone and card numbers with 404 in them, with each mark, status and kind of product; some pages end within the title's tag
    titles = ("+1 (404) 555-9676", "card 4045650754681188", "no. 14041")
    rows = [(i, ("<html><head><TITLE>" if i % 2 else "<title>") + titles[i % 3] + "</title>" + "x" * (300 + i % 113) + ("", "<title", "</titl")[i % 19 % 3]) for i in range(6000)]
    spark.createDataFrame(rows, "page_id bigint, html string").coalesce(1).write.parquet(f"{tmp_path}/all")
    next((tmp_path / "all").glob("*.parquet")).rename(tmp_path / "pages.parquet")
    assert differs(pages.page_verdicts(spark, str(tmp_path)), pages.ORACLES["page_verdicts"], str(tmp_path)) == ""


def test_the_banner_takes_the_room_that_the_sql_leaves_it():
    assert web.SHELL == 400 and pages.BANNER == web.SHELL - 340 and "< 340 AS thin" in pages.ORACLES["page_verdicts"]
