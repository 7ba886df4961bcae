"""Language-model scores: the marginal probability of a text over all its subword segmentations.

The lattice of a word has an arc for every piece of an existing vocabulary and,
for words of the training texts, one arc for the word itself. Piece weights
are the vocabulary's own scores after one step of re-estimation on the words
of the training texts. Word arcs are discounted counts, and what the
discount frees is the weight of the piece paths. A word's probability is the sum
over all paths, computed by a forward recursion in log space over batches of
words of one length; a very long word has a recursion of its own, over its
positions. A text is its words and an end.

    P(end) = (training documents + 1) / (N + 2)
    P(w)   = (1 - P(end)) * (max(c - d, 0) / W + d * V' / W * pieces(w))

with W training words of V' kinds and d = n1 / (n1 + 2 n2) from the numbers of
kinds seen once and twice.
"""

from __future__ import annotations

import functools
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from redgreen.llm.support import discard, durable, pick, reread, ship, tidy

# Words that every task holds with their scores, the most frequent ones; all others are scored by a join.
HEAD_WORDS = 100_000
# Bytes from which a word is scored by itself, and how many of them at once.
LONG_WORD = 512
LONG_STEP = 1 << 16
# Entries and characters after which a task passes on what it has counted: memory bounds.
HELD_WORDS = 300_000
BATCH_CELLS = 1 << 20

RATIO = np.uint64(0x9E3779B97F4A7C15)


def words_of(text: str | None) -> list[bytes]:
    """Words ``[^\\x20\\x09-\\x0D]+``, A-Z lower-cased, as UTF-8."""
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def read_pieces(path: str) -> tuple[list[bytes], np.ndarray]:
    """Pieces of a vocabulary as bytes, a blank standing for a word's start, and their log weights.

    Scores of a merge vocabulary are ranks and become weights 1 / (rank + 10);
    scores of a unigram vocabulary are log weights as they are. Each single
    byte has a piece.
    """
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    scores: dict[bytes, float] = {}
    size = model.get_piece_size()
    ordinary = [i for i in range(size) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))]
    ranked = min(model.get_score(i) for i in ordinary) < -200
    for i in ordinary:
        piece = model.id_to_piece(i)
        score = -float(np.log(10 - model.get_score(i))) if ranked else float(model.get_score(i))
        if "▁" not in piece[1:]:
            scores.setdefault(piece.replace("▁", " ").encode(), score)
    least = min(scores.values())
    for byte in range(256):
        scores.setdefault(bytes([byte]), least)
    weights = np.array(list(scores.values()))
    return list(scores), weights - np.log(np.exp(weights).sum())


class Lattice:
    """Vectorised recursions over words of one length."""

    def __init__(self, pieces: list[bytes], weights: np.ndarray):
        self.longest = max(map(len, pieces))
        keys = np.array([self._key(p) for p in pieces], dtype=np.uint64)
        bits = int(np.ceil(np.log2(len(pieces) * 4)))
        self.shift, self.mask = np.uint64(64 - bits), np.uint64((1 << bits) - 1)
        self.slots = np.zeros(1 << bits, dtype=np.uint64)
        self.index = np.full(1 << bits, -1, dtype=np.int32)
        left, place = np.arange(len(keys)), (keys * RATIO) >> self.shift
        while len(left):
            free = self.index[place] < 0
            self.slots[place[free]], self.index[place[free]] = keys[left[free]], left[free]
            on = self.index[place] != left
            left, place = left[on], (place[on] + np.uint64(1)) & self.mask
        self.taken = self.index >= 0
        self.lengths = sorted({len(p) for p in pieces})
        self.pieces, self.weights = pieces, weights

    @staticmethod
    def _key(piece: bytes) -> int:
        value = 0
        for byte in piece:
            value = (value * 0x100000001B3 + byte + 1) & 0xFFFFFFFFFFFFFFFF
        return value

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Piece numbers of substring keys, -1 where there is none."""
        out = np.full(len(keys), -1, dtype=np.int32)
        place = (keys * RATIO) >> self.shift
        # Most places are empty, which one small table tells.
        todo = np.flatnonzero(self.taken[place])
        place = place[todo]
        while len(todo):
            at = self.index[place]
            hit = (at >= 0) & (self.slots[place] == keys[todo])
            out[todo[hit]] = at[hit]
            on = (at >= 0) & ~hit
            todo, place = todo[on], (place[on] + np.uint64(1)) & self.mask
        return out

    def arcs(self, lines: np.ndarray) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
        """``(start, end, rows, pieces)`` by ascending end, for words as rows of bytes."""
        n, width = lines.shape
        base = np.uint64(0x100000001B3)
        hashes = np.zeros((width + 1, n), dtype=np.uint64)
        for i in range(width):
            hashes[i + 1] = hashes[i] * base + lines[:, i].astype(np.uint64) + np.uint64(1)
        powers = [1]
        for _ in range(self.longest):
            powers.append(powers[-1] * 0x100000001B3 & 0xFFFFFFFFFFFFFFFF)
        for end in range(1, width + 1):
            for length in self.lengths:
                start = end - length
                if start < 0:
                    break
                found = self.find(hashes[end] - hashes[start] * np.uint64(powers[length]))
                rows = np.flatnonzero(found >= 0)
                if len(rows):
                    yield start, end, rows, found[rows]

    def forward(self, lines: np.ndarray) -> np.ndarray:
        """Natural log of the summed weight of all segmentations of each row."""
        alpha = np.full((lines.shape[1] + 1, len(lines)), -np.inf)
        alpha[0] = 0
        for start, end, rows, pieces in self.arcs(lines):
            alpha[end, rows] = np.logaddexp(alpha[end, rows], alpha[start, rows] + self.weights[pieces])
        return alpha[-1]

    def expected(self, lines: np.ndarray) -> np.ndarray:
        """Expected number of uses of each piece, summed over the rows."""
        n, width = lines.shape
        arcs = list(self.arcs(lines))
        alpha, beta = np.full((2, width + 1, n), -np.inf)
        alpha[0] = beta[-1] = 0
        for start, end, rows, pieces in arcs:
            alpha[end, rows] = np.logaddexp(alpha[end, rows], alpha[start, rows] + self.weights[pieces])
        out = np.zeros(len(self.weights))
        for start, end, rows, pieces in reversed(arcs):
            through = self.weights[pieces] + beta[end, rows]
            beta[start, rows] = np.logaddexp(beta[start, rows], through)
            out += np.bincount(pieces, np.exp(alpha[start, rows] + through - alpha[-1, rows]), len(out))
        return out

    def arcs_from(self, line: np.ndarray, begin: int, count: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Starts (counted from ``begin``), lengths and pieces of all arcs that start at ``count`` places of a line, by ascending start."""
        keys = np.zeros(count, dtype=np.uint64)
        starts, lengths, pieces = [], [], []
        for length in range(1, self.longest + 1):
            inside = min(count, len(line) - begin - length + 1)
            if inside <= 0:
                break
            keys = keys[:inside] * np.uint64(0x100000001B3) + line[begin + length - 1 : begin + length - 1 + inside]
            if length in self.lengths:
                found = self.find(keys)
                at = np.flatnonzero(found >= 0)
                starts.append(at)
                lengths.append(np.full(len(at), length))
                pieces.append(found[at])
        starts, lengths, pieces = (np.concatenate(x) for x in (starts, lengths, pieces))
        order = np.argsort(starts, kind="stable")
        return starts[order], lengths[order], pieces[order]

    def forward_long(self, word: bytes) -> float:
        """``forward`` of one long word behind a blank, in time and memory that follow its length.

        Arcs are looked up for many positions at once; the recursion then needs
        the weights of as many places ahead as the longest piece has bytes.
        """
        return self.pass_over(b" " + word)

    def pass_over(self, text: bytes, before: np.ndarray | None = None) -> float:
        """Natural log of the summed weight of all segmentations; ``before`` takes that of what ends at each place."""
        line = np.frombuffer(text, dtype=np.uint8).astype(np.uint64) + np.uint64(1)
        n, around = len(line), self.longest + 1
        weights = np.exp(self.weights)
        ahead, scale = [0.0] * around, 0.0
        ahead[0] = 1.0
        for begin in range(0, n, LONG_STEP):
            count = min(LONG_STEP, n - begin)
            starts, lengths, pieces = self.arcs_from(line, begin, count)
            ends = np.searchsorted(starts, np.arange(count), side="right").tolist()
            lengths, worth = lengths.tolist(), weights[pieces].tolist()
            passed, scales = [], []
            arc = 0
            for i in range(count):
                place = (begin + i) % around
                here, ahead[place] = ahead[place], 0.0
                if before is not None:
                    passed.append(here)
                    scales.append(scale)
                while arc < ends[i]:
                    ahead[(place + lengths[arc]) % around] += here * worth[arc]
                    arc += 1
                if i % 16 == 15:  # weights shrink with every piece
                    most = max(ahead)
                    scale += np.log(most)
                    ahead = [x / most for x in ahead]
            if before is not None:
                with np.errstate(divide="ignore"):
                    before[begin : begin + count] = np.log(passed) + scales
        return float(np.log(ahead[n % around]) + scale)

    @functools.cached_property
    def backwards(self) -> Lattice:
        """The lattice of the pieces read from their ends."""
        return Lattice([p[::-1] for p in self.pieces], self.weights)

    def expected_long(self, word: bytes) -> np.ndarray:
        """``expected`` of one long word behind a blank: two numbers for each place are kept, and the arcs of many places are looked up at once."""
        text = b" " + word
        n, out = len(text), np.zeros(len(self.weights))
        before, after = np.empty((2, n))
        whole = self.pass_over(text, before)
        self.backwards.pass_over(text[::-1], after)
        line = np.frombuffer(text, dtype=np.uint8).astype(np.uint64) + np.uint64(1)
        for begin in range(0, n, LONG_STEP):
            starts, lengths, pieces = self.arcs_from(line, begin, min(LONG_STEP, n - begin))
            through = before[begin + starts] + self.weights[pieces] + after[n - (begin + starts + lengths)]
            out += np.bincount(pieces, np.exp(through - whole), len(out))
        return out

    def by_length(self, words: list[bytes]) -> Iterator[tuple[list[int], np.ndarray]]:
        """Positions and rows of bytes, in bounded batches of words of one length, each behind a blank; long words are left out."""
        groups: dict[int, list[int]] = {}
        for i, word in enumerate(words):
            if len(word) < LONG_WORD:
                groups.setdefault(len(word), []).append(i)
        for length, places in groups.items():
            step = max(1, BATCH_CELLS // (length + 1) // 16)
            for at in range(0, len(places), step):
                part = places[at : at + step]
                joined = b"".join(b" " + words[i] for i in part)
                yield part, np.frombuffer(joined, dtype=np.uint8).reshape(len(part), length + 1)


def count_words(rows: DataFrame) -> DataFrame:
    """``(word, c, n)`` of ``(text, learn)``: occurrences in texts to learn from, and in all."""

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from redgreen.llm import lattice as m

        def table(learned: Counter, others: Counter) -> pa.RecordBatch:
            words = list(learned.keys() | others.keys())
            c = [learned[w] for w in words]
            return pa.RecordBatch.from_arrays(
                [pa.array(words, pa.binary()), pa.array(c, pa.int64()), pa.array([k + others[w] for k, w in zip(c, words)], pa.int64())],
                ["word", "c", "n"],
            )

        learned, others = Counter(), Counter()
        for batch in batches:
            for text, learn in zip(batch.column(0), batch.column(1)):
                (learned if learn.as_py() else others).update(m.words_of(text.as_py()))
                if len(learned) + len(others) > m.HELD_WORDS:
                    yield table(learned, others)
                    learned, others = Counter(), Counter()
        yield table(learned, others)

    counted = rows.mapInArrow(run, "word binary, c bigint, n bigint")
    return counted.groupBy("word").agg(F.sum("c").alias("c"), F.sum("n").alias("n"))


def fit_pieces(kinds: DataFrame, pieces: list[bytes], weights: np.ndarray, prior: np.ndarray, least: int = 1) -> np.ndarray:
    """Log weights after one step of expectation maximisation over the words seen ``least`` times in training, or oftener.

    Each kind of word counts once, whatever its length. What comes back from
    the cluster is one number per piece.
    """
    shared = kinds.sparkSession.sparkContext.broadcast((pieces, weights))

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from redgreen.llm import lattice as m

        lattice = m.Lattice(*shared.value)
        total = np.zeros(len(lattice.weights))
        for batch in batches:
            words = batch.column(0).to_pylist()
            for _, lines in lattice.by_length(words):
                total += lattice.expected(lines)
            for word in words:
                if len(word) >= m.LONG_WORD:
                    total += lattice.expected_long(word)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array(total[used])], ["piece", "uses"])

    uses = kinds.where(F.col("c") >= least).select("word").mapInArrow(run, "piece int, uses double").groupBy("piece").agg(F.sum("uses").alias("uses"))
    found = np.zeros(len(weights))
    for row in uses.collect():  # one row per piece at most
        found[row["piece"]] = row["uses"]
    smoothed = found + np.exp(prior) * max(1.0, 1e-3 * found.sum())
    return np.log(smoothed / smoothed.sum())


def score_kinds(kinds: DataFrame, pieces: list[bytes], weights: np.ndarray, word_total: int, kind_total: int, discount: float, log_word: float, base_total: int) -> DataFrame:
    """``(word, c, n, base, score)``: the base and the model's log10 probability of each distinct word."""
    shared = kinds.sparkSession.sparkContext.broadcast((pieces, weights))

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from redgreen.llm import lattice as m

        lattice = m.Lattice(*shared.value)
        for batch in batches:
            words = batch.column(0).to_pylist()
            spelled = np.empty(len(words))
            for places, lines in lattice.by_length(words):
                spelled[places] = lattice.forward(lines)
            for i, word in enumerate(words):
                if len(word) >= m.LONG_WORD:
                    spelled[i] = lattice.forward_long(word)
            c = batch.column(1).to_numpy(zero_copy_only=False).astype(float)
            if word_total:
                with np.errstate(divide="ignore"):
                    whole = np.log(np.maximum(c - discount, 0) / word_total)
                    spelled = np.logaddexp(whole, np.log(discount * kind_total / word_total) + spelled)
            score = (spelled + log_word) / np.log(10)
            base = np.log10((c + 1) / base_total)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(base), pa.array(score)], ["word", "c", "n", "base", "score"])

    return kinds.select("word", "c", "n").mapInArrow(run, "word binary, c bigint, n bigint, base double, score double")


def score_documents(documents: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", divisor: int = 7, held: int = 2, least: int = 2) -> DataFrame:
    """``(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score)``, one row per input row.

    Learns from rows whose ``crc32(id as text) % divisor`` is not ``held``.
    Tokens are words and one end per text; null and empty texts have the end
    only. Rows without an id are scored, and neither learned from nor held out.
    Repeated rows count and are scored each. An empty table gives no rows; with
    nothing to learn from, words have the weight of their spelling. Piece
    weights are re-estimated on the words seen ``least`` times in training, or
    oftener; 1 takes every word of the training texts.

    The word counts, their spelling and all statistics cover all texts; the
    most frequent words are then scored where texts are read, the others by a
    join on the word, so that a frequent word never makes a hot key.
    """
    spark: SparkSession = documents.sparkSession
    ship(spark)
    remainder = F.crc32(F.col("doc_id").cast("string").cast("binary")) % divisor
    docs = pick(documents, doc_id=id_col, text=text_col).select(
        "doc_id", "text", F.coalesce(remainder == held, F.lit(False)).alias("held_out"), F.coalesce(remainder != held, F.lit(False)).alias("learn")
    )
    kinds = durable(count_words(docs.select("text", "learn")), "kinds")
    seen = kinds.where("c > 0").agg(
        F.coalesce(F.sum("c"), F.lit(0)).alias("words"), F.count("*").alias("kinds"),
        F.count(F.when(F.col("c") == 1, 1)).alias("once"), F.count(F.when(F.col("c") == 2, 1)).alias("twice"),
    ).first()
    texts = docs.where("learn").count()
    total = int(seen["words"]) + texts  # N
    base_total = total + seen["kinds"] + (1 if texts else 0) + 1  # N + 1 * (V + 1)
    discount = seen["once"] / (seen["once"] + 2 * seen["twice"]) if seen["once"] and seen["twice"] else 0.5
    end = (texts + 1) / (total + 2)
    log_word = float(np.log(1 - end))
    pieces, weights = read_pieces(vocabulary)
    weights = fit_pieces(kinds, pieces, weights, weights, least)
    scored = durable(
        score_kinds(kinds, pieces, weights, int(seen["words"]), seen["kinds"], discount, log_word, base_total), "scores"
    )
    head = {bytes(r["word"]): (r["c"] > 0, r["base"], r["score"]) for r in scored.orderBy(F.desc("n"), "word").limit(HEAD_WORDS).collect()}
    shared = spark.sparkContext.broadcast(head)  # HEAD_WORDS entries at most
    end_base, end_score, end_known = float(np.log10((texts + 1) / base_total)), float(np.log10(end)), int(texts > 0)

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from redgreen.llm import lattice as m

        known = shared.value
        for batch in batches:
            for at in range(0, batch.num_rows, 500):  # what a task holds beside its batch
                part = batch.slice(at, 500)
                tokens, n_known, base, score, words, times = [], [], [], [], [], []
                for text in part.column(3):
                    counted = Counter(m.words_of(text.as_py()))
                    tokens.append(counted.total() + 1)
                    k, b, s, rest, many = end_known, end_base, end_score, [], []
                    for word, n in counted.items():
                        hit = known.get(word)
                        if hit is None:
                            rest.append(word)
                            many.append(n)
                        else:
                            k += n * hit[0]
                            b += n * hit[1]
                            s += n * hit[2]
                    n_known.append(k)
                    base.append(b)
                    score.append(s)
                    words.append(rest)
                    times.append(many)
                yield pa.RecordBatch.from_arrays(
                    [
                        *part.columns[:3], pa.array(tokens, pa.int64()), pa.array(n_known, pa.int64()), pa.array(base, pa.float64()),
                        pa.array(score, pa.float64()), pa.array(words, pa.list_(pa.binary())), pa.array(times, pa.list_(pa.int64())),
                    ],
                    ["row", "doc_id", "held_out", "n_tokens", "n_known", "base", "score", "words", "times"],
                )

    numbered = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", "held_out", "text")
    sums = durable(
        numbered.mapInArrow(
            run,
            f"row bigint, doc_id {documents.schema[id_col].dataType.simpleString()}, held_out boolean, n_tokens bigint, n_known bigint, "
            "base double, score double, words array<binary>, times array<bigint>",
        ),
        "sums",
    )
    rest = reread(sums).select("row", F.explode(F.arrays_zip("words", "times")).alias("t")).select(
        "row", F.col("t.words").alias("word"), F.col("t.times").alias("times")
    )
    tail = rest.join(reread(scored).select("word", "c", F.col("base").alias("b"), F.col("score").alias("s")), "word").groupBy("row").agg(
        F.sum(F.when(F.col("c") > 0, F.col("times")).otherwise(0)).alias("k"),
        F.sum(F.col("times") * F.col("b")).alias("b"),
        F.sum(F.col("times") * F.col("s")).alias("s"),
    )
    return sums.drop("words", "times").join(tail, "row", "left").select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("n_known") + F.coalesce("k", F.lit(0))).alias("n_known"),
        F.lit(total).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("b", F.lit(0.0))).alias("base_score"),
        (F.col("score") + F.coalesce("s", F.lit(0.0))).alias("score"),
    )
