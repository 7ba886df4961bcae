"""The three trained models: held-out accuracy, and their recursions written out."""

import math
import os
import time
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from made import prose
from redgreen.llm import langid, lattice, quality
from redgreen.llm.queries import QUERIES

SF_DIR = "/root/testdata/sf0.01"
tables = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="test tables not present")
PIECES = public_tokenizers.path("piece_bpe_32k.model")


def crc(i):
    return zlib.crc32(str(i).encode())


def texts_of(odd):
    return [tuple(r) for r in odd.toDF(*[str(i) for i in range(10)]).select("0", "1").collect()]


# Quality


@tables
def test_quality_on_held_out_labels(spark):
    docs, labels = (spark.read.parquet(f"{SF_DIR}/{t}.parquet") for t in ("documents", "labels"))
    got = quality.score_documents(docs, quality.fit(docs, labels))
    rows = got.join(labels, "doc_id").where("held_out and quality is not null").collect()
    assert all((crc(r.doc_id) % 5 == 0) == r.held_out for r in rows)
    good = [r.predicted for r in rows if r.quality == 1]
    bad = [r.predicted for r in rows if r.quality == 0]
    assert len(good) > 20 and len(bad) > 5
    assert np.mean(good) >= 0.98 and np.mean(bad) <= 0.1


def test_quality_of_odd_rows(spark, odd_documents, no_documents):
    labels = spark.createDataFrame([(1, 1), (2, 0), (2, 1), (3, None), (None, 1), (4, 7)], "doc_id bigint, quality int")
    weights = quality.fit(odd_documents, labels)
    rows = quality.score_documents(odd_documents, weights).collect()
    assert len(rows) == odd_documents.count()
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) and r.held_out is not None for r in rows)
    same = {r.score for r in rows if r.doc_id in (3, 4, 5) or r.doc_id is None}
    assert len({r.score for r in rows if r.doc_id in (3, 4)}) == 1 and same
    assert quality.score_documents(no_documents, weights).isEmpty()
    none = quality.fit(no_documents, labels)
    assert not none.any() and {r.score for r in quality.score_documents(odd_documents, none).collect()} == {0.5}
    assert quality.keep_good(odd_documents.toDF(*[f"c{i}" for i in range(10)]), none, 0.3, "c1").count() == len(rows)


def test_a_row_repeated_often_leaves_room_for_others(spark):
    rows = [(i, prose(i, 30) if i % 2 else " ".join([prose(i, 1)] * 30)) for i in range(40)]
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id bigint, quality int")
    schema = "doc_id bigint, text string"
    want = quality.fit(spark.createDataFrame(rows, schema), labels, rows=32)
    got = quality.fit(spark.createDataFrame(rows + [rows[1]] * 200, schema).repartition(5), labels, rows=32)
    assert want.any() and np.allclose(got, want)


def test_shapes_and_vectors():
    assert quality.shape("ABCd12!!!.\n") == "AAa00!!.n" and quality.shape("Éa漢") == "Aaa"
    slots, values = quality.Features().of("a b a b")
    assert len(slots) == len(values) and (values**2).sum() == pytest.approx(1)
    repeat = quality.Features().of("x x x x x")[0]
    other = quality.Features().of("y y y y y")[0]
    assert set(repeat) & set(other)  # a repeat is a repeat, whatever the word


def test_updates_follow_the_formula():
    model = quality.Ftrl(4, alpha=0.5, beta=1.0, l1=0.1, l2=0.2)
    z, n = np.zeros(5), np.zeros(5)
    for slots, values, label in [([0, 2], [0.6, 0.8], 1), ([0], [1.0], 0), ([2, 3], [0.6, 0.8], 1)] * 3:
        x = np.zeros(5)
        x[slots], x[4] = values, 1
        w = np.array([0 if abs(z[i]) <= 0.1 else -(z[i] - math.copysign(0.1, z[i])) / ((1 + math.sqrt(n[i])) / 0.5 + 0.2) for i in range(5)])
        g = (1 / (1 + math.exp(-w @ x)) - label) * x
        z += g - (np.sqrt(n + g * g) - np.sqrt(n)) / 0.5 * w
        n += g * g
        model.learn(np.array(slots), np.array(values), label)
    assert np.allclose(model.z, z) and np.allclose(model.n, n)


# Language


@tables
def test_language_on_held_out_documents(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    rows = langid.predict(docs, langid.fit(docs)).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert all(crc(r.doc_id) % 4 == 2 for r in rows) and len(rows) > 100
    assert np.mean([r.lang_pred == r.lang for r in rows]) >= 0.98


def test_language_of_odd_rows(spark, odd_documents, no_documents):
    extra = [(20 + i, "der die das und nicht mit ein " * 5, "de") for i in range(8)] + [(40 + i, "the and of that with for a " * 5, "en") for i in range(8)]
    taught = spark.createDataFrame(extra + [(60, "123 456", "xx"), (61, None, "yy"), (62, "bonjour", None)], "doc_id bigint, text string, lang string")
    model = langid.fit(taught)
    assert model.languages == ["de", "en"]
    rows = langid.predict(odd_documents, model).collect()
    assert len(rows) == odd_documents.count()
    for r, (doc_id, text) in zip(sorted(rows, key=lambda r: str(r.doc_id)), sorted(texts_of(odd_documents), key=lambda t: str(t[0]))):
        assert 0 <= r.score <= 1 and r.held_out == (doc_id is not None and crc(doc_id) % 4 == 2)
    assert {r.lang_pred for r in rows if r.doc_id in (3, 4, 5)} == {"und"}
    assert {r.lang_pred for r in rows if r.doc_id in (1, 2)} <= {"de", "en"}
    assert langid.predict(no_documents, model).isEmpty() and langid.fit(no_documents) is None
    assert {r.lang_pred for r in langid.predict(odd_documents, None).collect()} == {"und"}


def test_kernel_is_that_of_presences():
    x, y = "The cat", "the hat!"
    grams = lambda t: {t.lower()[i : i + n] for n in (1, 2, 3) for i in range(len(t) - n + 1)}
    a, b = grams(x), grams(y)
    assert len(langid.present(x)) == len(a)
    column = np.zeros((langid.SLOTS, 1), dtype=np.uint8)
    column[langid.present(y)] = 1
    value = langid.kernel(langid.present(x), column, column.sum(axis=0).astype(np.float32))[0]
    assert value == pytest.approx(len(a & b) / math.sqrt(len(a) * len(b)))


# Language-model scores


def paths(word, pieces):
    """Summed weight over all segmentations, one by one."""
    return uses(word, pieces)[0]


def uses(word, pieces):
    """The same, and every piece's uses weighted by their segmentations."""
    if not word:
        return 1.0, Counter()
    total, found = 0.0, Counter()
    for p, w in pieces.items():
        if word.startswith(p):
            rest, counts = uses(word[len(p) :], pieces)
            total += w * rest
            for q, n in counts.items():
                found[q] += w * n
            found[p] += w * rest
    return total, found


def test_forward_over_all_segmentations():
    pieces = {b" ": 0.2, b" a": 0.1, b"a": 0.15, b"b": 0.1, b"ab": 0.2, b"ba": 0.1, b"aba": 0.1, b"bb": 0.05}
    model = lattice.Lattice(list(pieces), np.log(list(pieces.values())))
    words = [b"a", b"ab", b"abab", b"bbaba", b"ababab", b"bbbb"]
    for places, lines in model.by_length(words):
        for i, value in zip(places, model.forward(lines)):
            assert value == pytest.approx(math.log(paths(b" " + words[i], pieces)))
            assert value == pytest.approx(model.forward_long(words[i]))
    want = Counter()
    for word in words:
        total, counts = uses(b" " + word, pieces)
        want.update({p: n / total for p, n in counts.items()})
    got = sum(model.expected(lines) for _, lines in model.by_length(words))
    assert dict(zip(pieces, got)) == pytest.approx({p: want[p] for p in pieces})


def test_very_long_words(monkeypatch):
    """Both recursions agree, also across steps, and a megabyte of random letters takes seconds."""
    model = lattice.Lattice(*lattice.read_pieces(PIECES))
    r = np.random.default_rng(1)
    word = bytes(r.integers(97, 123, 700).astype(np.uint8))
    (value,) = model.forward(np.frombuffer(b" " + word, dtype=np.uint8)[None, :])
    assert model.forward_long(word) == pytest.approx(value)
    monkeypatch.setattr(lattice, "LONG_STEP", 50)
    assert model.forward_long(word) == pytest.approx(value)
    monkeypatch.undo()
    start = time.perf_counter()
    value = model.forward_long(bytes(r.integers(97, 123, 1 << 20).astype(np.uint8)))
    assert math.isfinite(value) and time.perf_counter() - start < 20


def test_score_of_every_word_over_all_segmentations(spark, tmp_path, monkeypatch):
    """The whole query with a small vocabulary, against sums over every segmentation."""
    pieces = {bytes([b]): 0.3 / 256 for b in range(256)}
    pieces |= {b" a": 0.2, b"ab": 0.2, b"ba": 0.1, b"aba": 0.1, b" b": 0.1}
    given = dict(pieces)
    monkeypatch.setattr(lattice, "read_pieces", lambda path: (list(given), np.log(list(given.values()))))
    rows = [(i, t) for i, t in enumerate(["ab aba", "ab ab b", "baab", "", None, "abba ab aba", "AB", "bbaa ab"])]
    learn = [(t or "").lower().split() for i, t in rows if crc(i) % 7 != 2]
    c = Counter(w for t in learn for w in t)
    words, kinds, once, twice = sum(c.values()), len(c), sum(n == 1 for n in c.values()), sum(n == 2 for n in c.values())
    d = once / (once + 2 * twice) if once and twice else 0.5
    end = (len(learn) + 1) / (words + len(learn) + 2)

    found = Counter()
    for w in c:
        if c[w] >= 2:
            total, counts = uses(b" " + w.encode(), pieces)
            found.update({p: n / total for p, n in counts.items()})
    all_ = sum(found.values())
    smooth = {p: found[p] + v * max(1.0, 1e-3 * all_) for p, v in pieces.items()}
    pieces = {p: v / sum(smooth.values()) for p, v in smooth.items()}

    def score(t):
        out = math.log10(end)
        for w in (t or "").lower().split():
            out += math.log10((1 - end) * (max(c[w] - d, 0) / words + d * kinds / words * paths(b" " + w.encode(), pieces)))
        return out

    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    for r in lattice.score_documents(df, "none").collect():
        assert r.score == pytest.approx(score(rows[r.doc_id][1]))


def test_expected_uses_of_very_long_words(monkeypatch):
    """Both recursions agree, also across steps, and half a megabyte takes seconds."""
    model = lattice.Lattice(*lattice.read_pieces(PIECES))
    r = np.random.default_rng(2)
    word = bytes(r.integers(97, 123, 500).astype(np.uint8)) + "漢字".encode() * 20 + b"the" * 40
    want = model.expected(np.frombuffer(b" " + word, dtype=np.uint8)[None, :])
    assert model.expected_long(word) == pytest.approx(want)
    monkeypatch.setattr(lattice, "LONG_STEP", 50)
    assert model.expected_long(word) == pytest.approx(want)
    monkeypatch.undo()
    start = time.perf_counter()
    found = model.expected_long(bytes(r.integers(0, 256, 1 << 19).astype(np.uint8)))
    assert np.isfinite(found).all() and time.perf_counter() - start < 30


def test_pieces_are_fitted_on_every_training_word(spark):
    """Words seen once teach, and those of any length; words of held-out texts do not."""
    pieces = {bytes([b]): 0.3 / 256 for b in range(256)}
    pieces |= {b" a": 0.2, b"ab": 0.2, b"ba": 0.1, b"aba": 0.1, b" b": 0.1}
    names, prior = list(pieces), np.log(list(pieces.values()))
    model = lattice.Lattice(names, prior)
    taught = [b"abab", b"ba", b"ab" * 300 + b"a", b"a" * lattice.LONG_WORD]
    kinds = [(bytearray(w), 1 + i % 2, 2) for i, w in enumerate(taught)] + [(bytearray(b"bbbb"), 0, 5), (bytearray(b"b" * 600), 0, 1)]
    found = sum(model.expected(np.frombuffer(b" " + w, dtype=np.uint8)[None, :]) for w in taught)
    want = found + np.exp(prior) * max(1.0, 1e-3 * found.sum())
    got = lattice.fit_pieces(spark.createDataFrame(kinds, "word binary, c bigint, n bigint"), names, prior, prior)
    assert np.exp(got) == pytest.approx(want / want.sum())


def test_query_learns_from_every_training_word(spark, tmp_path):
    rows = [(i, t) for i, t in enumerate(["zorg flimmer", "zorg zorg", "qua " + "quux" * 200, "one two", "three", "flimmers"])]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    df.write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r.score for r in QUERIES["op8_lattice"](spark, str(tmp_path)).collect()}
    for least, same in ((1, True), (2, False)):
        other = {r.doc_id: r.score for r in lattice.score_documents(df, PIECES, least=least).collect()}
        assert (got == pytest.approx(other, abs=1e-9)) == same


def test_vocabulary_weights():
    pieces, weights = lattice.read_pieces(PIECES)
    assert len(set(pieces)) == len(pieces) and np.exp(weights).sum() == pytest.approx(1)
    assert all(bytes([b]) in set(pieces) for b in range(256))


def test_scores_of_odd_rows(spark, odd_documents, no_documents, monkeypatch):
    rows = texts_of(odd_documents)
    tokens = [(i, (t or "").encode().lower().split()) for i, t in rows]
    taught = [w for i, w in tokens if i is not None and crc(i) % 7 != 2]
    c = Counter(x for w in taught for x in w)
    total = sum(c.values()) + len(taught)
    kinds = len(c) + 1

    def base(w):
        return sum(math.log10((c[x] + 1) / (total + kinds + 1)) for x in w) + math.log10((len(taught) + 1) / (total + kinds + 1))

    want = sorted(((i, i is not None and crc(i) % 7 == 2, len(w) + 1, sum(c[x] > 0 for x in w) + 1, total, round(base(w), 6)) for i, w in tokens), key=str)
    results = []
    for head in (lattice.HEAD_WORDS, 3):  # scored where read, or by the join
        monkeypatch.setattr(lattice, "HEAD_WORDS", head)
        got = lattice.score_documents(odd_documents, PIECES).collect()
        assert sorted(((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got), key=str) == want
        assert all(math.isfinite(r.score) and r.score < 0 for r in got)
        results.append(sorted((str(r.doc_id), round(r.score, 6)) for r in got))
    assert results[0] == results[1]
    assert lattice.score_documents(no_documents, PIECES).isEmpty()


def test_nothing_to_learn_from(spark):
    held = next(i for i in range(100) if crc(i) % 7 == 2)
    df = spark.createDataFrame([(held, "some words")], "doc_id bigint, text string")
    (row,) = lattice.score_documents(df, PIECES).collect()
    assert (row.held_out, row.n_tokens, row.n_known, row.train_tokens, row.base_score) == (True, 3, 0, 0, 0.0)
    assert math.isfinite(row.score) and row.score < -3


@tables
def test_likely_texts_score_higher(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet").limit(300)
    jumbled = docs.select((F.col("doc_id") + 10**6).alias("doc_id"), F.reverse("text").alias("text"))
    both = docs.select("doc_id", "text").union(jumbled.where("crc32(cast(cast(doc_id as string) as binary)) % 7 = 2"))
    rows = lattice.score_documents(both, PIECES).where("held_out").collect()
    plain = np.mean([r.score / r.n_tokens for r in rows if r.doc_id < 10**6])
    other = np.mean([r.score / r.n_tokens for r in rows if r.doc_id >= 10**6])
    assert plain > other
