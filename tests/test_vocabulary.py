"""The slot parser on hand-made cases; the whole table is held against SQL in test_queries."""

import pytest

from larkspur.operators import vocabulary
from larkspur.sources.shop_names import VOCABULARY

ROWS = [
    ("p1", "producer", "Kovács", "Kovács", None, None), ("p2", "producer", "Szűcs Béla", "Szűcs Béla", None, None), ("p2", "producer", "Szűcs Béla", "Béla Szűcs", "Béla Szűcs", None), ("p3", "producer", "Nagy", "Nagy", None, None),
    ("g1", "grape", "Olaszrizling", "Olaszrizling", None, None), ("g1", "grape", "Olaszrizling", "olasz rizling", "olasz rizling", None), ("g1", "grape", "Olaszrizling", "Welschriesling", "Welschriesling", None),
    ("g2", "grape", "Rizling", "rizling", None, None), ("g3", "grape", "Cabernet Franc", "Cabernet Franc", None, None), ("g4", "grape", "Merlot", "Merlot", None, None),
    ("s1", "style", "vörös", "vörös", None, None), ("s1", "style", "vörös", "vörösbor", "vörösbor", None), ("s2", "style", "rosé", "rosé", None, None), ("r1", "region", "Tokaj", "Tokaj", None, None), ("r1", "region", "Tokaj", "Tokaji", "Tokaji", None),
    ("v1", "vineyard", "Kőhegy", "Kőhegy", None, "p2"), ("v2", "vineyard", "Öreghegy", "Öreghegy", None, None), ("r2", "region", "Merlot", "Merlot", None, None), ("s9", "style", "none", "..", None, None),
]
CASES = {
    "Kovács Tokaji Olaszrizling 2019 0,75 l": ("p1", None, "r1", None, ["g1"], 2019, None, []),
    "2019 Kovács Olaszrizling 0,75": ("p1", None, None, None, ["g1"], 2019, None, []),
    "Olaszrizling, Kovács - 2019": ("p1", None, None, None, ["g1"], 2019, None, []),
    "Béla Szűcs Kőhegy 2018": ("p2", "v1", None, None, [], 2018, None, []),
    "Kőhegy Szűcs Béla": ("p2", "v1", None, None, [], None, None, []),  # the vineyard stands before its producer
    "Kovács Kőhegy 2018": ("p1", None, None, None, [], 2018, "kohegy", []),
    "Kőhegy 2018": (None, None, None, None, [], 2018, "kohegy", []),
    "Öreghegy rosé": (None, "v2", None, "s2", [], None, None, []),
    "Kovács olasz rizling": ("p1", None, None, None, ["g1"], None, None, []),
    "Kovács rizling Welschriesling": ("p1", None, None, None, ["g2", "g1"], None, None, []),
    "Kovács vörös vörösbor": ("p1", None, None, "s1", [], None, None, []),
    "Kovács vörös rosé": ("p1", None, None, "s1", [], None, "rose", ["s2", "s2"]),
    "Kovács Nagy Cabernet Franc": ("p1", None, None, None, ["g3"], None, "nagy", ["p3", "p3"]),
    "vörös rosé": (None, None, None, "s1", [], None, "rose", ["s2"]),
    "Merlot Merlot": (None, None, "r2", None, [], None, None, []),  # a region comes before a grape
    "Cabernet Merlot Franc": (None, None, "r2", None, [], None, "cabernet franc", []),
    "Kovács Ördög 7 6x0,75l 2019 2020 12,5% 3 palack": ("p1", None, None, None, [], 2019, "ordog", []),
    "SZŰCS  BÉLA&amp;Merlot": ("p2", None, "r2", None, [], None, None, []),
    "": (None, None, None, None, [], None, None, []),
    " .,- ": (None, None, None, None, [], None, ".,", []),  # counts as a number, which keeps its dots and commas
    None: (None, None, None, None, [], None, None, []),
}


@pytest.fixture(scope="module")
def vocab(spark):
    return spark.createDataFrame(ROWS, VOCABULARY)


def read(df):
    return {r["title"]: tuple(r[c] for c in ("producer", "vineyard", "region", "style", "grapes", "vintage", "expression")) + ([x["id"] for x in r["ambiguous"]],) for r in df.collect()}


def test_cases(spark, vocab):
    names = spark.createDataFrame([(t, 1, "kept") for t in CASES], "title string, n int, tokens string")
    got = vocabulary.parse_names(names, vocab)
    assert read(got) == CASES
    assert got.columns[:2] == ["title", "n"]


def test_repeated_rows_and_matches(spark, vocab):
    got = vocabulary.parse_names(spark.createDataFrame([("Rosé Kovács",), ("Rosé Kovács",)], "title string"), vocab).collect()
    assert len(got) == 2
    assert [[(m["start"], m["n"], m["id"], m["matched"]) for m in r["matches"]] for r in got] == [[(0, 1, "s2", "rose"), (1, 1, "p1", "kovacs")]] * 2


def test_scope_and_noise(spark, vocab):
    names = spark.createDataFrame([("Kőhegy akció", "p2"), ("Kőhegy akció", "p1"), ("Kőhegy akció", None)], "title string, own string")
    got = {r["own"]: (r["vineyard"], r["expression"]) for r in vocabulary.parse_names(names, vocab, scope="own", noise=("akcio",)).collect()}
    assert got == {"p2": ("v1", None), "p1": (None, "kohegy"), None: (None, "kohegy")}


def test_empty_tables(spark, vocab):
    none = spark.createDataFrame([], VOCABULARY)
    assert read(vocabulary.parse_names(spark.createDataFrame([("a 2001 b",)], "title string"), none)) == {"a 2001 b": (None, None, None, None, [], 2001, "a b", [])}
    assert vocabulary.parse_names(spark.createDataFrame([], "title string"), vocab).count() == 0


def test_long_name(spark, vocab):
    long = " ".join(["Kovács Ördög"] * 300)
    got = read(vocabulary.parse_names(spark.createDataFrame([(long,)], "title string"), vocab))[long]
    assert got[0] == "p1" and got[6] == " ".join(["ordog"] * 300)
