"""The Jaccard join against all pairs."""

import random

import numpy as np

from redgreen.llm import overlap
from redgreen.llm.minhash import shared_enough

from made import prose


def brute(documents, words=5, percent=80):
    def shingles(text):
        w = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for c in "\t\n\v\f\r":
            w = w.replace(c, " ")
        w = [x for x in w.split(" ") if x]
        return {tuple(w)} if 0 < len(w) < words else {tuple(w[i : i + words]) for i in range(len(w) - words + 1)}

    sets = [shingles(t) for _, t in documents]
    root = list(range(len(documents)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            both = len(a & b)
            if documents[i][0] is not None and documents[j][0] is not None and both and 100 * both >= percent * (len(a) + len(b) - both):
                root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(documents):
        if d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    return sorted(((d, len(s), None if d is None else least[find(i)]) for i, ((d, _), s) in enumerate(zip(documents, sets))), key=str)


def edited(text, r, share):
    words = text.split()
    for i in r.sample(range(len(words)), max(1, int(len(words) * share))):
        words[i] = f"e{r.randrange(10**6)}"
    return " ".join(words)


def near_copies():
    r = random.Random(11)
    documents = [(i, prose(i, 20 + i)) for i in range(100)]
    for i in range(0, 90, 3):
        documents += [(200 + 10 * i + j, edited(documents[i][1], r, 0.01 + 0.006 * j)) for j in range(5)]
    chain = prose(500, 120).split()  # each links with the next, the ends do not
    documents += [(5000 - i, " ".join(chain[i * 5 : i * 5 + 60])) for i in range(12)]
    documents += [(6000 + i, prose(7, 300) + " " + prose(6000 + i, 200)) for i in range(10)]  # a passage that many share
    return documents


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_equals_all_pairs(spark, odd_documents):
    documents = [(r["doc_id"], r["text"]) for r in odd_documents.collect()] + near_copies()
    documents += [(7000, "a b c"), (7001, "A\tB c"), (7002, "a b"), (10, prose(99, 50)), (7003, prose(99, 50))]
    df = spark.createDataFrame([(*d, "clash", 1) for d in documents], "doc_id bigint, text string, node string, key int")
    want = brute(documents)
    assert rows(overlap.jaccard_join(df)) == want
    # Neighbourhoods cut into blocks, and classes outside the largest component that meet all of them.
    assert rows(overlap.jaccard_join(df, bin_size=150)) == want


def test_a_neighbourhood_of_several_components_in_blocks(spark):
    """Sets that the guides leave apart are still found across blocks."""
    r = np.random.default_rng(8)
    base = [np.unique(r.integers(1, 1 << 60, 40, dtype=np.uint64)) for _ in range(6)]
    sets = []
    for i in range(240):
        own = base[i % 6].copy()
        own[r.integers(0, len(own), 2)] = r.integers(1, 1 << 60, 2, dtype=np.uint64)
        sets.append(np.unique(own))
    data = [(i, 0, len(s), s.tobytes()) for i, s in enumerate(sets)]
    df = overlap.durable(spark.createDataFrame(data, "node bigint, component bigint, n bigint, shingles binary"), "sets")
    root = overlap.Forest(len(sets))
    for i, a in enumerate(sets):
        for j in range(i):
            if shared_enough(a, sets[j], 80):
                root.join(i, j)
    want = {i: root.root(i) for i in range(len(sets)) if root.root(i) != i}
    for size in (400, 2500, 1 << 20):
        assert {r["node"]: r["component"] for r in overlap.links_of(df, 80, size).collect()} == want


def test_search_equals_all_pairs_by_either_merge(monkeypatch):
    r = np.random.default_rng(9)
    pool = r.integers(1, 1 << 60, 120, dtype=np.uint64)
    sets = [np.unique(r.choice(pool, r.integers(1, 118))) for _ in range(300)]
    sets += [np.unique(np.append(s, pool[:1])) for s in sets[:100]] + [s[:-1] for s in sets[:50] if len(s) > 1]
    lists = overlap.Lists(sets)
    for heap in (0, 1 << 30):
        monkeypatch.setattr(overlap, "HEAP", heap)
        for percent in (50, 80, 100):
            for i in range(0, len(sets), 5):
                assert lists.search(sets[i], percent).tolist() == [j for j, s in enumerate(sets) if shared_enough(sets[i], s, percent)]
    assert overlap.Lists([]).search(pool, 80).tolist() == []


def test_empty_tables(spark, no_documents):
    assert overlap.jaccard_join(no_documents).isEmpty()
    df = spark.createDataFrame([(1, None), (2, " ")], "doc_id bigint, text string")
    assert rows(overlap.jaccard_join(df)) == [(1, 0, 1), (2, 0, 2)]
