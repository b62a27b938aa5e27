"""Mined producers and merge groups on hand-made names."""

import random

from larkspur.operators import producers


def mined(spark, names, **more):
    """names: (shop, residue); each row's raw name is its residue."""
    rows = spark.createDataFrame([(s, t, t.split(" ")) for s, t in names], "shop_id int, title string, residue array<string>")
    return {r["name"]: r for r in producers.mine_producers(rows, **more).collect()}


def everywhere(*residues, shops=3):
    return [(s, r) for r in residues for s in range(shops)]


def test_markers_and_places(spark):
    got = mined(spark, [(1, "chateau margaux")] * 3 + everywhere("grand domaine leflaive", "jasdi pince egy", "jasdi pince masik", "gere attila kopar", "chateau de sales", "chateau cos d estournel", "es pinceszet"))
    assert {"chateau margaux", "domaine leflaive", "jasdi pince", "gere attila kopar", "chateau de sales", "chateau cos d estournel"} <= set(got)
    assert not {"chateau", "chateau de", "chateau cos d", "es pinceszet", "grand", "pinceszet", "grand domaine"} & set(got)
    assert got["chateau margaux"]["has_marker"] and got["chateau margaux"]["shops"] == 1 and not got["gere attila kopar"]["has_marker"]
    assert got["jasdi pince"]["leading"] == 6 and got["domaine leflaive"]["leading"] == 0 and got["domaine leflaive"]["examples"] == ["grand domaine leflaive"]


def test_support(spark):
    assert mined(spark, [(1, "sauska")] * 9) == {}  # one shop and no marker
    assert mined(spark, everywhere("sauska", shops=2)) == {}  # too rare
    got = mined(spark, [*everywhere("sauska", shops=4), (None, "sauska"), (1, "sauska")])
    assert (got["sauska"]["count"], got["sauska"]["shops"]) == (6, 4) and got["sauska"]["score"] == 9.27
    assert mined(spark, everywhere("whisky x", "12 y", "a b", "brut z", "de la")) == {}
    assert mined(spark, [(1, "")]) == {} and mined(spark, everywhere("bock", "bolyki"), limit=1).keys() == {"bock"}


def test_containment(spark):
    assert set(mined(spark, everywhere("moet chandon"))) == {"moet chandon"}
    got = set(mined(spark, [*everywhere("villa sandahl birdie", "villa sandahl slow"), *everywhere("sauska", "sauska brut", shops=4)]))
    assert {"villa sandahl birdie", "villa sandahl slow", "villa sandahl", "sauska"} <= got and "sauska brut" not in got
    got = set(mined(spark, everywhere("chateau haut brion", "chateau haut bailly")))
    assert {"chateau haut", "chateau haut brion", "chateau haut bailly"} <= got


def test_containment_by_all_pairs(spark):
    rnd, words = random.Random(2), ["aa", "bb", "cc", "brut", "rose"]
    names = {" ".join(rnd.choices(words, k=rnd.randint(1, 4))): rnd.randint(3, 5) for _ in range(150)}
    gone = set()
    for a, m in names.items():
        for b, n in names.items():
            s, t = a.split(" "), b.split(" ")
            if len(s) < len(t) and (t[: len(s)] == s or t[-len(s) :] == s):
                extra = [x for x in t if x not in s]
                if m == n:
                    gone.add(a)
                elif extra and set(extra) <= set(producers.WINE_WORDS):
                    gone.add(b)
    got = producers.within_others(spark.createDataFrame(list(names.items()), "name string, count bigint"))
    assert {r["name"] for r in got.collect()} == gone and len(gone) > 20


COLUMNS = "id string, canonical_name string, status string, linked_listings int, candidate_score double, person_name boolean, fuzzy_blocked boolean"


def grouped(spark, *rows):
    full = [(*r, *(None, None, None, None, None)[len(r) - 2 :]) for r in rows]
    return {r["id"]: r for r in producers.merge_groups(spark.createDataFrame(full, COLUMNS)).collect()}


def test_keys(spark):
    from pyspark.sql import functions as F

    want = {"Sauska Extra Dry": "sauska", "Bock Pince Kft.": "bock", "BÖCK": "bock", "Château Haut-Brion": "chateau haut", "Pince": "", "2019 Brut": "", "": "", None: "", "É x Nagy": "nagy"}
    got = spark.createDataFrame([(n,) for n in want], "n string").select("n", producers.merge_key(F.col("n")).alias("k")).collect()
    assert {r["n"]: r["k"] for r in got} == want


def test_groups(spark):
    got = grouped(spark, ("1", "Bock", "candidate"), ("2", "Bock Pince", "candidate"), ("3", "Sauska", "active", 4), ("4", "Sauska Brut", "candidate", 0), ("5", "Sauska Extra Dry", "active", 2), ("6", "Sauska Kopár", "candidate"), ("7", "Sauska", "merged"), ("8", "Alone", "active"), ("9", "Sauska Pezsgő", None, 9))
    assert {i: (r["key"], r["kind"], r["confidence"], r["keep_id"], r["action"], r["extra_kind"]) for i, r in got.items()} == {
        "1": ("bock", "prefix", "high", "1", "keep", "none"), "2": ("bock", "prefix", "high", "1", "merge", "marker"), "3": ("sauska", "prefix", "medium", "3", "keep", "none"),
        "4": ("sauska", "prefix", "medium", "3", "discard", "wine_term"), "5": ("sauska", "prefix", "medium", "3", "merge", "wine_term"), "6": ("sauska", "prefix", "medium", "3", "discard", "other"), "9": ("sauska", "prefix", "medium", "3", "merge", "wine_term"),
    }
    assert got["5"]["active_warning"] and not got["5"]["alias_useful"] and got["2"]["alias_useful"] and got["3"]["n_linked"] == 15


def test_people_stay_apart(spark):
    got = grouped(spark, ("1", "Gere Attila", "candidate", 3, None, True), ("2", "Gere Zsolt", "candidate", 1, None, True), ("3", "Gere", "candidate", 0, None, None, True))
    assert {i: r["action"] for i, r in got.items()} == {"1": "keep", "2": "separate", "3": "separate"} and {r["confidence"] for r in got.values()} == {"medium"}
    assert {r["kind"] for r in grouped(spark, ("1", "Gere Attila"), ("2", "Gere Zsolt")).values()} == {"token"}
    assert grouped(spark, ("1", "Bock")) == {}


def test_survivor_order(spark):
    assert grouped(spark, ("1", "Bock", "candidate", 0), ("2", "Bock Pince", "candidate", 5))["1"]["keep_id"] == "2"
    assert grouped(spark, ("1", "Bock Pince", "candidate", 1), ("2", "Bock", "candidate", 1))["1"]["keep_id"] == "2"
    assert grouped(spark, ("1", "Bock", "candidate", 1, 1.0), ("2", "Bock", "candidate", 1, 2.0))["1"]["keep_id"] == "2"
    assert grouped(spark, ("2", "Bock"), ("1", "Bock"))["1"]["keep_id"] == "1"


def recorded(monkeypatch, module):
    counts, write = {}, module.written

    def count(df, name):
        out = write(df, name)
        counts[name] = out.count()
        return out

    monkeypatch.setattr(module, "written", count)
    return counts


def test_residues_are_taken_apart_once(spark, monkeypatch):
    counts = recorded(monkeypatch, producers)
    got = mined(spark, everywhere("sauska egy", "sauska ketto", shops=50))
    assert counts["mined"] == 2 and got["sauska"]["count"] == 100 and got["sauska"]["shops"] == 50


def test_merged_names_are_read_once(spark, monkeypatch):
    counts = recorded(monkeypatch, producers)
    assert len(grouped(spark, ("1", "Bock"), ("2", "Bock Pince"), ("3", "Pince"))) == 2 and counts == {"producers": 3}


def test_names_are_read_once(spark, monkeypatch):
    from larkspur.operators import vocabulary
    from larkspur.sources import shop_names

    counts = recorded(monkeypatch, vocabulary)
    names = spark.createDataFrame([("Bock 2019",)] * 30 + [(None,)], "title string")
    assert vocabulary.parse_names(names, spark.createDataFrame([], shop_names.VOCABULARY)).count() == 31 and counts == {"names": 2, "read": 2}
