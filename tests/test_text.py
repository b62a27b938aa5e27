"""Normalization against plain Unicode functions."""

import re
import unicodedata

import pytest
from pyspark.sql import functions as F

from larkspur.functions import text

CASES = {
    "caf&#233; r&#x151;": "cafe ro", "①② ＡＢＣ": "12 abc", "½ l": "1 2 l", "a…b": "a...b", "zero​width": "zerowidth", "Gere Róka Pinot Noir": "gere roka pinot noir",
    "6 × 0,75 l": "6 x 0,75 l", "Whisky – Single Malt": "whisky single malt", "Tokaji Asz&uacute;": "tokaji aszu", "&amp;#233; &unknown; &#99999999;": None, "<b>x</b>&lt;i&gt;y": None,
    "ﬁne №5 ㎏ ™": None, "Ｆｕｌｌ　width": None, "Ǆ ǆ ĳ ſ": None, " em nbsp　wide": None, "ά ё й Å": None, "": "", "plain text, 40%": "plain text, 40%",
}


def by_hand(s):
    def entity(m):
        if m[0] in text.ENTITIES:
            return text.ENTITIES[m[0]]
        n = m[0][2:-1]
        if m[0][1] != "#":
            return m[0]
        c = int(n[1:], 16) if n[0] in "xX" else int(n)
        return chr(c) if 0 < c < 0x110000 else m[0]

    s = unicodedata.normalize("NFKC", re.sub(r"&[a-zA-Z]+;|&#\d+;|&#x[0-9a-fA-F]+;", entity, s))
    s = "".join(text.TYPOGRAPHIC.get(c, c) for c in s)
    return re.sub(r"\s+", " ", re.sub("<[^>]*>", " ", s)).strip()


def norm(clean):
    plain = re.sub("[̀-ͯ]", "", unicodedata.normalize("NFD", clean)).lower()
    return re.sub("[^a-z0-9%.,]+", " ", plain).strip()


def test_clean_and_search_norm(spark):
    rows = list(CASES) + [chr(c) + "x" for c in range(0xA0, 0x2600) if chr(c).isprintable()] + [chr(c) for c in range(0xFF01, 0xFFEF) if chr(c).isprintable()]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(rows)] + [(-1, None)], "i int, s string")
    got = {r["i"]: (r["c"], r["n"]) for r in df.select("i", text.clean_text(F.col("s")).alias("c"), text.search_norm(F.col("s")).alias("n")).collect()}
    assert got[-1] == ("", "")
    for i, x in enumerate(rows):
        clean = by_hand(x)
        assert unicodedata.normalize("NFC", got[i][0]) == unicodedata.normalize("NFC", clean), (x, got[i])
        assert got[i][1] == norm(clean), (x, got[i])
    assert all(got[i][1] == want for i, want in enumerate(CASES.values()) if want is not None)


@pytest.mark.parametrize("terms,want", [(["akcio", "uj termek"], "bor 0,75 l"), ([], "akcio uj termek bor akcio 0,75 l")])
def test_noise_terms(spark, terms, want):
    df = spark.createDataFrame([("akcio uj termek bor akcio 0,75 l",)], "s string")
    assert df.select(text.strip_noise(F.col("s"), terms)).first()[0] == want


def test_long_texts_take_time_by_their_length(spark):
    import time

    rows = spark.createDataFrame([("a" * 3_000_000 + "… –ﬁ",)], "t string").select(text.search_norm(F.col("t")).alias("n"))
    begun = time.monotonic()
    assert rows.first()["n"] == "a" * 3_000_000 + "... fi" and time.monotonic() - begun < 15
