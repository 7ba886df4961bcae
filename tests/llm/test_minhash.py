"""Near duplicates against the similarity of all pairs."""

import random
from collections import defaultdict

import numpy as np

from made import prose
from redgreen.llm import minhash


def words(text):
    return (text or "").encode().lower().split()


def shingles(text, n):
    w = words(text)
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set()


def brute(rows, n, percent):
    sets = [(i, shingles(t, n)) for i, t in rows]
    reach = {i: i for i, _ in sets if i is not None}

    def root(i):
        while reach[i] != i:
            i = reach[i]
        return i

    for x, (i, a) in enumerate(sets):
        for j, b in sets[:x]:
            if a and b and i is not None and j is not None and 100 * len(a & b) >= percent * len(a | b):
                low, high = sorted((root(i), root(j)))
                reach[high] = low
    return sorted(((i, len(s), root(i) if i is not None else None) for i, s in sets), key=str)


def result(df):
    assert all(r.kept == (r.doc_id is None or r.doc_id == r.component_id) for r in df.collect())
    return sorted(((r.doc_id, r.n_shingles, r.component_id) for r in df.collect()), key=str)


def edited(text, share, seed):
    r = random.Random(seed)
    return " ".join(f"new{r.random()}" if r.random() < share else w for w in text.split(" "))


def test_equals_all_pairs(spark):
    rows = []
    for family in range(6):
        base = prose(family, 150)
        # Copies of copies: chains in which the ends do not link, and members the smallest id does not link to.
        chain = base
        for i in range(12):
            rows.append((family * 100 + (37 * i) % 100, edited(base, [0.0, 0.02, 0.05, 0.08][i % 4], i)))
            chain = edited(chain, 0.04, 1000 + i)
            rows.append((1000 + family * 100 + (53 * i) % 100, chain))
    rows += [(5000 + i, prose(500 + i, 40)) for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert result(minhash.near_duplicates(df, 2, 80)) == brute(rows, 2, 80)


def test_blocks_of_a_bucket_lose_no_pair(spark, monkeypatch):
    """Members that the centre does not link to are found by comparing the blocks."""
    monkeypatch.setattr(minhash, "BLOCK", 3)
    base = prose(9, 200)
    rows = [(0, edited(base, 0.10, 1))] + [(i, edited(base, 0.05, i)) for i in range(1, 20)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert result(minhash.near_duplicates(df, 2, 80)) == brute(rows, 2, 80)


def test_odd_rows(spark, odd_documents, no_documents):
    texts = [tuple(r) for r in odd_documents.toDF(*[str(i) for i in range(10)]).select("0", "1").collect()]
    got = result(minhash.near_duplicates(odd_documents))
    assert got == brute(texts, 5, 80)
    assert minhash.near_duplicates(no_documents).isEmpty()


def test_components(spark):
    pairs = [(1, 2), (2, 3), (3, 4), (10, 4), (20, 21), (21, 22), (7, 7), (5, 30), (30, 6)]
    links = spark.createDataFrame(pairs, "a bigint, b bigint")
    got = {r.node: r.component for r in minhash.components(links).collect()}
    assert got == {2: 1, 3: 1, 4: 1, 10: 1, 21: 20, 22: 20, 30: 5, 6: 5}
    path = spark.range(200).selectExpr("id a", "id + 1 b")
    assert {r.component for r in minhash.components(path).collect()} == {0}
    assert minhash.components(links.limit(0)).isEmpty()


def test_signatures_estimate_the_similarity():
    a, b = minhash.universal(minhash.ROWS * minhash.BANDS)
    r = np.random.default_rng(1)
    pool = r.integers(0, 1 << 63, 3000, dtype=np.uint64)
    one, other = pool[:2000], pool[500:2500]
    agree = (minhash.signature(one, a, b) == minhash.signature(other, a, b)).mean()
    assert abs(agree - 1500 / 2500) < 0.2
    assert minhash.signature(one, a, b).tolist() == minhash.signature(one[::-1], a, b).tolist()


def test_words_and_sets():
    memory = defaultdict(int)
    memory.clear()
    assert len(minhash.word_hashes("A b　c \x0b d", {})) == 2  # only ASCII blanks separate
    assert minhash.word_hashes("ABC É", {}).tolist() == minhash.word_hashes("abc\tÉ", {}).tolist()
    assert minhash.word_hashes("É", {}).tolist() != minhash.word_hashes("é", {}).tolist()
    assert len(minhash.shingle_set(minhash.word_hashes("a b a b", {}), 2)) == 2
