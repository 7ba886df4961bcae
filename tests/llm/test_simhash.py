"""Fingerprints against votes counted one by one; searches against all pairs."""

import hashlib
import random
import re

import xxhash

from made import prose
from redgreen.llm import simhash
from redgreen.llm.queries import QUERIES


def brute_fp(text):
    w = [x for x in re.split(r"[\x20\x09-\x0D]+", text or "") if x] or [""]
    pairs = list(zip(w, w[1:])) or [(w[0], None)]
    votes, total = [0] * 64, 0
    for a, b in pairs:
        h = xxhash.xxh64_intdigest(a.encode(), 42)
        weight = len(a) + len(b or "")
        if b is not None:
            h = xxhash.xxh64_intdigest(b.encode(), h)
        total += weight
        for i in range(64):
            votes[i] += weight * (h >> i & 1)
    return sum(1 << i for i in range(64) if 2 * votes[i] > total)


def test_documents(spark, odd_documents, no_documents, monkeypatch):
    monkeypatch.setattr(simhash, "ROWS_BETWEEN", 3)  # several ranges
    rows = [tuple(r) for r in odd_documents.toDF(*[str(i) for i in range(10)]).select("0", "1").collect()]
    rows.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or ""))
    got = simhash.compare_edits(odd_documents).collect()
    like = lambda x, y: 1 - (x ^ y).bit_count() / 64
    want = []
    for i, (doc_id, text) in enumerate(rows):
        text, following = text or "", rows[(i + 1) % len(rows)][1] or ""
        n = len(text) // 4
        edited = text[: len(text) - n] + following[:n]
        fp, other = brute_fp(text), brute_fp(edited)
        near = sum((fp ^ brute_fp(t)).bit_count() <= 3 for _, t in rows) - 1 if doc_id is not None and doc_id % 20 == 0 else None
        want.append((doc_id, len(text), hashlib.sha256(edited.encode()).hexdigest(), f"{fp:016x}", f"{other:016x}", like(fp, other), like(fp, brute_fp(following)), near))
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    assert simhash.compare_edits(no_documents).isEmpty()


def test_one_document_follows_itself(spark):
    df = spark.createDataFrame([(20, prose(1, 30))], "doc_id bigint, text string")
    (row,) = simhash.compare_edits(df).collect()
    assert row.near_next == 1.0 and row.n_near == 0


def test_search_finds_every_pair_in_the_radius(spark):
    r = random.Random(2)
    values = [r.getrandbits(64) for _ in range(40)]
    for v in values[:20]:
        for flips in (1, 2, 3, 3, 4):
            x = v
            for bit in r.sample(range(64), flips):
                x ^= 1 << bit
            values.append(x)
    signed = [v - (1 << 64) if v >= 1 << 63 else v for v in values] + [0, -1, 7]
    df = spark.createDataFrame([(v,) for v in signed + signed[:9] + [None]], "fp bigint")
    for radius, same in ((3, 3), (1, 1), (0, 2), (4, 2)):
        pairs = [tuple(x) for x in simhash.near_fingerprints(df, df, radius, same).collect()]
        want = {(x, y) for x in signed for y in signed if ((x ^ y) & (1 << 64) - 1).bit_count() <= radius}
        assert len(pairs) == len(set(pairs)) and set(pairs) == want


def test_flipped_keys_find_every_pair_in_the_radius(spark, monkeypatch):
    r = random.Random(3)
    values = [r.getrandbits(64) for _ in range(12)]
    for v in values[:10]:
        for flips in (1, 4, 8, 11, 12, 13):
            values.append(v ^ sum(1 << bit for bit in r.sample(range(64), flips)))
    values += [v & 0xFFFF for v in values[:8]] + [0xFFFF << 48, 0xFFF << 52, 0x1FFF << 51]  # keys that several values share
    signed = sorted({v - (1 << 64) if v >= 1 << 63 else v for v in values} | {0, -1, 7})
    df = spark.createDataFrame([(v,) for v in signed + signed[:9] + [None]], "fp bigint")
    for hot in (simhash.HOT_KEY, 2):
        monkeypatch.setattr(simhash, "HOT_KEY", hot)
        for radius, blocks in ((12, 4), (7, 4), (2, 4), (5, 3)):
            pairs = [tuple(x) for x in simhash.near_by_flips(df, df, radius, blocks).collect()]
            want = {(x, y) for x in signed for y in signed if ((x ^ y) & (1 << 64) - 1).bit_count() <= radius}
            assert len(pairs) == len(set(pairs)) and set(pairs) == want


def test_the_query_counts_near_copies(spark, tmp_path):
    """Copies with a five-word Jaccard of 0.8 to 0.9 are near, though most differ in more than three bits."""
    def grams(text):
        w = text.split()
        return {tuple(w[i : i + 5]) for i in range(len(w) - 4)}

    rows, apart = [], []
    for i in range(12):
        text = prose(i, 400)
        w = text.split()
        for at in (40, 110, 180, 250, 320, 390)[: 4 + i % 3]:
            w[at] = f"changed{at}"
        copy = " ".join(w)
        shared = len(grams(text) & grams(copy)) / len(grams(text) | grams(copy))
        assert 0.8 <= shared <= 0.92
        apart.append((brute_fp(text) ^ brute_fp(copy)).bit_count())
        rows += [(20 * i, text), (20 * i + 1, copy)]
    assert max(apart) > 3
    spark.createDataFrame(rows, "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r.n_near for r in QUERIES["op6_simhash"](spark, str(tmp_path)).collect()}
    prints = {i: brute_fp(t) for i, t in rows}
    assert all(got[20 * i] >= 1 for i in range(12))
    for i, n in got.items():
        assert n == (sum((prints[i] ^ p).bit_count() <= 12 for p in prints.values()) - 1 if i % 20 == 0 else None)
