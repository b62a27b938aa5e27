"""Near-duplicates among texts that repeat their shingles a different number of times, against brute force."""

from larkspur.llm import minhash


def test_repeated_shingles_count_once(spark):
    texts = {}
    for k in range(40):
        words = [f"w{k}_{i}" for i in range(40)]
        for times in (1, 3, 10):
            texts[len(texts)] = words * times
        texts[len(texts)] = words[:20] * 4 + [f"z{k}_{i}" for i in range(20)]
    sets = {i: {tuple(w[j : j + 5]) for j in range(len(w) - 4)} for i, w in texts.items()}
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
    docs = spark.createDataFrame([(i, " ".join(w)) for i, w in texts.items()], "doc_id bigint, text string")
    want = {i: root(i) for i in sets}
    assert len(set(want.values())) == 80
    assert {r["doc_id"]: r["class_id"] for r in minhash.near_duplicates(docs).collect()} == want
