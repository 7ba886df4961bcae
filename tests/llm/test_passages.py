"""Repeated passages against every substring of the corpus."""

import hashlib
import random
import re
from collections import Counter

from made import prose
from redgreen.llm import passages


def brute(rows, length):
    bodies = [(i, (t or "").encode()) for i, t in rows]
    seen = Counter(b[p : p + length] for _, b in bodies for p in range(len(b) - length + 1))
    out = []
    for i, b in bodies:
        gone = [False] * len(b)
        for p in range(len(b) - length + 1):
            if seen[b[p : p + length]] > 1:
                gone[p : p + length] = [True] * length
        kept = bytes(x for x, g in zip(b, gone) if not g)
        runs = sum(g and not (p and gone[p - 1]) for p, g in enumerate(gone))
        out.append((i, len(b), sum(gone), runs, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def result(df, length):
    return sorted(map(tuple, passages.digest(df, length).drop("n_passages", "passage_words").collect()), key=str)


def brute_words(rows, least):
    """Stretches of words that windows of ``least`` words standing elsewhere cover, and what is left without them."""
    bodies = [(i, [(m.start(), m.end()) for m in re.finditer(rb"[^\x20\x09-\x0D]+", (t or "").encode())], (t or "").encode()) for i, t in rows]
    words = [(i, tuple(b[x:y].lower() for x, y in spans), spans, b) for i, spans, b in bodies]
    seen = Counter(w[p : p + least] for _, w, _, _ in words for p in range(len(w) - least + 1))
    out = []
    for i, w, spans, b in words:
        gone = [False] * len(w)
        for p in range(len(w) - least + 1):
            if seen[w[p : p + least]] > 1:
                gone[p : p + least] = [True] * least
        stretches, p = [], 0
        while p < len(w):
            if gone[p]:
                q = p
                while q < len(w) and gone[q]:
                    q += 1
                stretches.append((spans[p][0], spans[q - 1][1]))
                p = q
            else:
                p += 1
        out.append((i, len(stretches), sum(gone), passages.cut(b, stretches)))
    return sorted(out, key=str)


def corpus():
    r = random.Random(8)
    shared = [prose(100 + i, n) for i, n in enumerate((8, 9, 10, 14, 30, 60))]
    rows = []
    for i in range(60):
        parts = [prose(i, r.randint(0, 40))]
        for _ in range(r.randint(0, 3)):
            passage = r.choice(shared)
            cut = r.randint(0, len(passage) // 3)
            parts += [passage[cut:] if r.random() < 0.5 else passage[: len(passage) - cut], prose(1000 + 7 * i, r.randint(0, 5))]
        rows.append((i, " ".join(parts)))
    rows += [(100, rows[3][1]), (101, rows[3][1][:-1]), (102, "z" * 150), (103, "ab" * 90), (104, "y" * 41), (105, "é" * 60), (106, "漢字" * 30 + prose(5, 9))]
    return rows


def test_equals_every_substring(spark):
    rows = corpus()
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    for length in (40, 64):
        assert result(df, length) == brute(rows, length)


def test_passages_of_words_however_short(spark):
    """Whole results for words: passages of one-letter words, other blanks between them, other cases."""
    r = random.Random(9)
    short = " ".join(r.choice("abcdefgh") for _ in range(60))
    rows = corpus() + [(200, f"one {short} two"), (201, short.upper().replace(" ", "\n\t")), (202, short[:97]), (203, short[: 2 * 51]), (204, "w " * 70), (205, None)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    for least in (12, 51):
        found = passages.remove_repeats(df, least, words=True).select("doc_id", "kept.n_spans", "kept.kept").collect()
        want = brute_words(rows, least)
        assert sorted(((x.doc_id, x.n_spans, bytes(x.kept)) for x in found), key=str) == sorted(((i, n, k) for i, n, _, k in want), key=str)
        digest = passages.digest(df, passage_words=least).select("doc_id", "n_passages", "passage_words").collect()
        assert sorted(map(tuple, digest), key=str) == sorted(((i, n, w) for i, n, w, _ in want), key=str)
    assert {i for i, n, _, _ in want if n} >= {200, 201, 203, 204}


def test_small_buffers_and_shuffled_positions_change_nothing(spark, monkeypatch):
    monkeypatch.setattr(passages, "BUFFER", 500)
    monkeypatch.setattr(passages, "BROADCAST_ROWS", 0)
    rows = corpus()
    assert result(spark.createDataFrame(rows, "doc_id bigint, text string"), 40) == brute(rows, 40)


def test_odd_rows(spark, odd_documents, no_documents):
    rows = [tuple(r) for r in odd_documents.toDF(*[str(i) for i in range(10)]).select("0", "1").collect()]
    rows = [(i, t if t is None or len(t) < 100_000 else t[:2000]) for i, t in rows]  # what brute force can do
    df = spark.createDataFrame([(*r, "clash", 1) for r in rows], "doc_id bigint, text string, TEXT string, _k1 bigint")
    assert result(df, 100) == brute(rows, 100)
    assert passages.digest(no_documents).isEmpty()
    long = {r.doc_id: r.n_removed for r in passages.digest(odd_documents).collect()}
    assert long[6] == 200_000 and long[7] == 0


def test_phrase_starts_depend_on_the_window_only():
    shared, of = prose(3, 200), passages.Symbols(False).of
    one = passages.parse([of(prose(1, 50) + shared)], 100)
    other = passages.parse([of(""), of(prose(2, 91)), of(shared + prose(4, 20))], 100)
    assert len(set(one[4].tolist()) & set(other[4].tolist())) > len(shared) // 100


def test_all_columns_stay(spark):
    df = spark.createDataFrame([(1, "a" * 50, 7), (2, None, 8)], "doc_id bigint, text string, extra int")
    rows = passages.remove_repeats(df, 40).orderBy("doc_id").collect()
    assert [(r.doc_id, r.text, r.extra, r.kept.n_removed, r.kept.n_spans) for r in rows] == [(1, "a" * 50, 7, 50, 1), (2, None, 8, 0, 0)]


def test_repetitive_texts_have_few_rows(spark):
    """What a text says over and over is a row for each kind of phrase, however often, and all of it goes."""
    r = random.Random(5)
    lines = [" ".join(prose(40 + i, n).split()[:n]) for i, n in enumerate((1, 2, 3, 17))]
    rows = [(i, prose(700 + i, 30) + " " + (r.choice(lines) + " ") * r.randrange(100, 300) + prose(800 + i, 30)) for i in range(10)]
    rows += [(100 + i, "ab" * n) for i, n in enumerate((199, 200, 201, 900))] + [(110, "x" * 401), (111, prose(900, 400))]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    texts = df.selectExpr("doc_id as k1", "0 as k2", "text")
    for words, length in ((True, 12), (False, 60)):
        found = passages.runs(texts.where("k1 < 110"), length, words)
        kept = found.where("word is not null")
        assert kept.groupBy("k1", "whole").count().where("count > 1").isEmpty()
        assert kept.count() * 5 < kept.agg({"times": "sum"}).first()[0]
    assert result(df, 60) == brute(rows, 60)
    done = passages.remove_repeats(df, 12, kept_col="kept", words=True).collect()
    want = {i: kept for i, _, _, kept in brute_words(rows, 12)}
    assert {x.doc_id: bytes(x.kept.kept) for x in done} == want
