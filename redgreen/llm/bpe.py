"""Byte-level BPE: texts to token ids and back, with the ranks of a public vocabulary.

A text falls into pieces (the matches of the vocabulary's pattern), which are
merged independently. Distinct pieces of a batch are grouped by length into
padded matrices of ids; in every round each row merges its leftmost pair of
minimum rank, found by vectorised lookups in a hash table of pairs, and rows
are compacted by one place. Pieces longer than ``MATRIX_BYTES``, whose rounds
would take quadratic time, go through a heap with the same order of merges.
"""

from __future__ import annotations

import base64
import heapq
import re
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from redgreen.llm.support import pick, ship, tidy

# Longest piece that is merged in a matrix, in bytes. Longer ones give the same ids through a heap.
MATRIX_BYTES = 512
# Bytes in one matrix, and remembered words and pieces per worker: memory bounds that change no result.
MATRIX_CELLS = 1 << 21
REMEMBERED = 200_000

NONE = np.int32((1 << 31) - 1)
# Pieces of one matrix differ in length by at most a quarter.
BUCKETS = [n if n < 8 else -int(np.ceil(np.log(n) / np.log(1.25))) for n in range(1, MATRIX_BYTES + 1)]
BUCKETS.insert(0, 0)


def read_ranks(path: str) -> dict[bytes, int]:
    """A rank file: one base64 token and its rank per line."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines if line.strip())}


class PairTable:
    """Open-addressing hash table from a pair of ids to the rank of their concatenation."""

    def __init__(self, ranks: dict[bytes, int]):
        pairs = []
        for token, rank in ranks.items():
            for cut in range(1, len(token)):
                left, right = ranks.get(token[:cut]), ranks.get(token[cut:])
                if left is not None and right is not None:
                    pairs.append((left << 32 | right, rank))
        keys = np.array([p[0] for p in pairs], dtype=np.uint64)
        values = np.array([p[1] for p in pairs], dtype=np.int32)
        self.shift = np.uint64(64 - max(4, int(np.ceil(np.log2(max(len(pairs), 1) * 3)))))
        self.mask = np.uint64((1 << (64 - int(self.shift))) - 1)
        self.keys = np.full(int(self.mask) + 1, np.uint64(0xFFFFFFFFFFFFFFFF), dtype=np.uint64)
        self.values = np.full(int(self.mask) + 1, NONE, dtype=np.int32)
        left = np.arange(len(keys))
        place = self.slot(keys)
        while len(left):  # all keys probe at once; of those that meet in a free slot one stays
            free = self.keys[place] == np.uint64(0xFFFFFFFFFFFFFFFF)
            self.keys[place[free]] = keys[left[free]]
            settled = self.keys[place] == keys[left]
            self.values[place[settled]] = values[left[settled]]
            left, place = left[~settled], (place[~settled] + np.uint64(1)) & self.mask

    def slot(self, keys: np.ndarray) -> np.ndarray:
        return (keys * np.uint64(0x9E3779B97F4A7C15)) >> self.shift

    def get(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Ranks of pairs, ``NONE`` where they do not merge (an id below zero is padding)."""
        keys = (left.astype(np.uint64) << np.uint64(32)) | (right.astype(np.uint64) & np.uint64(0xFFFFFFFF))
        out = np.full(keys.shape, NONE, dtype=np.int32)
        todo = np.flatnonzero((left >= 0) & (right >= 0))
        place = self.slot(keys[todo])
        while len(todo):
            found = self.keys[place]
            hit = found == keys[todo]
            out[todo[hit]] = self.values[place[hit]]
            on = ~hit & (found != np.uint64(0xFFFFFFFFFFFFFFFF))
            todo, place = todo[on], (place[on] + np.uint64(1)) & self.mask
        return out


class Memory:
    """What was computed lately: at most ``size`` entries, of which the unused half goes first."""

    def __init__(self, size: int):
        self.half = size // 2
        self.new: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def missing(self, wanted: set[str]) -> list[str]:
        """Make room, bring what is still known to the front, and name the rest."""
        if len(self.new) > self.half:
            self.old, self.new = self.new, {}
        new, old = self.new, self.old
        absent = [x for x in wanted if x not in new]
        new.update((x, old[x]) for x in absent if x in old)
        return [x for x in absent if x not in new]


class Codec:
    """Encodes pieces and decodes ids by one vocabulary."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks = ranks
        self.pieces = regex.compile(pattern)
        # A blank between two other blanks: only there can cutting a text before single blanks change its pieces.
        self.blanks = re.compile(r" (?<=\s )(?:\s|\Z)")
        self.pairs = PairTable(ranks)
        self.byte_ids = np.array([ranks[bytes([b])] for b in range(256)], dtype=np.int32)
        self.tokens = np.empty(max(ranks.values()) + 1, dtype=object)
        for token, rank in ranks.items():
            self.tokens[rank] = token
        self.known = Memory(REMEMBERED)  # 32-bit ids of a piece
        self.words = Memory(REMEMBERED)  # and of a word with a blank before it

    def forget(self) -> None:
        """Empty what is remembered; the tables stay for the worker's next task."""
        self.known, self.words = Memory(REMEMBERED), Memory(REMEMBERED)

    def merge(self, pieces: list[bytes]) -> list[bytes]:
        """32-bit ids of each piece."""
        out: list[bytes] = [b""] * len(pieces)
        by_length: dict[int, list[int]] = {}
        for i, piece in enumerate(pieces):
            whole = self.ranks.get(piece)
            if whole is not None:
                out[i] = array("i", (whole,)).tobytes()
            elif len(piece) > MATRIX_BYTES:
                out[i] = self.merge_long(piece)
            else:
                by_length.setdefault(BUCKETS[len(piece)], []).append(i)
        for rows in by_length.values():
            width = max(len(pieces[i]) for i in rows)
            step = max(1, MATRIX_CELLS // width)
            for start in range(0, len(rows), step):
                part = rows[start : start + step]
                for i, ids in zip(part, self.merge_matrix([pieces[j] for j in part], width)):
                    out[i] = ids
        return out

    def merge_matrix(self, pieces: list[bytes], width: int) -> list[bytes]:
        flat = np.frombuffer(b"".join(p.ljust(width, b"\0") for p in pieces), dtype=np.uint8).reshape(len(pieces), width)
        lengths = np.array([len(p) for p in pieces])
        ids = np.where(np.arange(width) < lengths[:, None], self.byte_ids[flat], np.int32(-1))
        out: list[bytes] = [b""] * len(pieces)
        rows = np.arange(len(pieces))
        ranks = self.pairs.get(ids[:, :-1].ravel(), ids[:, 1:].ravel()).reshape(len(pieces), width - 1)
        while len(rows):
            at = ranks.argmin(axis=1)  # the first of equal minima is the leftmost
            best = ranks[np.arange(len(rows)), at]
            done = best == NONE
            if done.any():
                for row, line, n in zip(rows[done], ids[done].tolist(), lengths[done].tolist()):
                    out[row] = array("i", line[:n]).tobytes()
                keep = ~done
                rows, ids, ranks, lengths, at, best = rows[keep], ids[keep], ranks[keep], lengths[keep], at[keep], best[keep]
                if not len(rows):
                    break
            # Compaction: the merged id takes the left place, everything to the right moves up by one.
            width = ids.shape[1]
            line = np.arange(len(rows))
            right = np.arange(width - 1, dtype=at.dtype) > at[:, None]
            ids = np.where(right, ids[:, 1:], ids[:, :-1])
            ids[line, at] = best
            lengths = lengths - 1
            if width == 2:
                for row, value in zip(rows, ids[:, 0].tolist()):
                    out[row] = array("i", (value,)).tobytes()
                break
            right = np.arange(width - 2, dtype=at.dtype) >= at[:, None]
            ranks = np.where(right, ranks[:, 1:], ranks[:, :-1])
            # Only the two pairs around the merged id are new.
            has_left = at > 0
            ranks[line[has_left], at[has_left] - 1] = self.pairs.get(ids[line[has_left], at[has_left] - 1], best[has_left])
            has_right = at < width - 2
            ranks[line[has_right], at[has_right]] = self.pairs.get(best[has_right], ids[line[has_right], at[has_right] + 1])
        return out

    def merge_long(self, piece: bytes) -> bytes:
        """The same merges in the same order, for a piece of any length."""
        ids = self.byte_ids[np.frombuffer(piece, dtype=np.uint8)]
        n = len(ids)
        first = self.pairs.get(ids[:-1], ids[1:])
        heap = [(int(first[i]), int(i)) for i in np.flatnonzero(first != NONE)]
        heapq.heapify(heap)
        token = [bytes([b]) for b in piece]
        after, before, rank_at = list(range(1, n + 1)), list(range(-1, n - 1)), first.tolist() + [int(NONE)]

        def look(i: int) -> None:
            j = after[i]
            rank = self.ranks.get(token[i] + token[j], int(NONE)) if j < n else int(NONE)
            rank_at[i] = rank
            if rank != NONE:
                heapq.heappush(heap, (rank, i))

        while heap:
            rank, i = heapq.heappop(heap)
            if rank_at[i] != rank or not token[i]:
                continue
            j = after[i]
            token[i] += token[j]
            token[j], rank_at[j] = b"", int(NONE)
            after[i] = after[j]
            if after[j] < n:
                before[after[j]] = i
            look(i)
            if before[i] >= 0:
                look(before[i])
        out, i = [], 0
        while i < n:
            out.append(self.ranks[token[i]])
            i = after[i]
        return array("i", out).tobytes()

    def cut_word(self, word: str) -> list[str]:
        """Pieces of a word behind a blank."""
        if word.isalpha():  # the commonest kinds need no pattern
            return [" " + word]
        return self.pieces.findall(" " + word)

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of whole texts."""
        whole: list[list[str]] = []
        blank: list[list[str]] = []
        for text in texts:
            first, *rest = text.split(" ")
            if "  " in text or self.blanks.search(text) or first == "" and rest:
                whole.append(self.pieces.findall(text))
                blank.append([])
            else:
                whole.append(self.pieces.findall(first))
                blank.append(rest)
        # Words repeat, so each is cut and merged once.
        fresh = {w: self.cut_word(w) for w in self.words.missing(set().union(*blank))}
        wanted = self.known.missing(set().union(*whole, *fresh.values()))
        self.known.new.update(zip(wanted, self.merge([piece.encode() for piece in wanted])))
        piece, word = self.known.new.__getitem__, self.words.new.__getitem__
        self.words.new.update((w, b"".join(map(piece, pieces))) for w, pieces in fresh.items())
        return [
            np.frombuffer(b"".join([*map(piece, x), *map(word, y)]), dtype=np.int32) for x, y in zip(whole, blank)
        ]

    def decode(self, ids: np.ndarray) -> bytes:
        return b"".join(self.tokens[ids].tolist())


_CODECS: dict[tuple[int, str], Codec] = {}


def _codec(shared, pattern: str) -> Codec:
    """One codec per worker process and vocabulary, so tasks share what is remembered."""
    key = (shared.id, pattern) if hasattr(shared, "id") else (id(shared), pattern)
    if key not in _CODECS:
        _CODECS.clear()
        _CODECS[key] = Codec(shared.value, pattern)
    return _CODECS[key]


# Characters that are encoded together; bounds what a worker holds beside the Arrow batch.
GROUP_CHARS = 1 << 21


def _groups(batch: pa.Array) -> Iterator[list[str]]:
    group: list[str] = []
    size = 0
    for text in batch:
        group.append(text.as_py() or "")
        size += len(group[-1])
        if size >= GROUP_CHARS:
            yield group
            group, size = [], 0
    if group:
        yield group


def _listed(ids: list[np.ndarray]) -> pa.ListArray:
    offsets = np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype(np.int32)
    flat = np.concatenate(ids) if ids else np.array([], dtype=np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat, type=pa.int32()))


def encoder(spark: SparkSession, ranks_path: str, pattern: str):
    """Column function: text to ``array<int>`` of token ids. A null or empty text has no tokens."""
    ship(spark)
    shared = spark.sparkContext.broadcast(read_ranks(ranks_path))  # bounded by the vocabulary file

    @F.arrow_udf("array<int>")
    @tidy
    def encode(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        from redgreen.llm import bpe

        codec = bpe._codec(shared, pattern)
        for batch in batches:
            yield bpe._listed([line for group in bpe._groups(batch) for line in codec.encode(group)])
        codec.forget()

    return encode


def decoder(spark: SparkSession, ranks_path: str, pattern: str):
    """Column function: ``array<int>`` of token ids to the bytes they stand for. Null ids give no bytes."""
    ship(spark)
    shared = spark.sparkContext.broadcast(read_ranks(ranks_path))

    @F.arrow_udf("binary")
    @tidy
    def decode(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        from redgreen.llm import bpe

        codec = bpe._codec(shared, pattern)
        for batch in batches:
            yield pa.array([codec.decode(np.array(ids.as_py() or [], dtype=np.int64)) for ids in batch], type=pa.binary())

    return decode


def round_tripper(spark: SparkSession, ranks_path: str, pattern: str):
    """Column function: text to ``struct<ids, decoded>``, encoded and decoded again in one pass of one worker."""
    ship(spark)
    shared = spark.sparkContext.broadcast(read_ranks(ranks_path))

    @F.arrow_udf("struct<ids: array<int>, decoded: binary>")
    @tidy
    def both(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        from redgreen.llm import bpe

        codec = bpe._codec(shared, pattern)
        for batch in batches:
            parts = []
            for group in bpe._groups(batch):
                ids = codec.encode(group)
                decoded = pa.array([codec.decode(line) for line in ids], type=pa.binary())
                parts.append(pa.StructArray.from_arrays([bpe._listed(ids), decoded], ["ids", "decoded"]))
            kind = pa.struct([("ids", pa.list_(pa.int32())), ("decoded", pa.binary())])
            done = pa.concat_arrays(parts) if parts else pa.array([], kind)
            del parts
            yield done
        codec.forget()

    return both


def encode_documents(df: DataFrame, ranks_path: str, pattern: str, text_col: str = "text", ids_col: str = "ids") -> DataFrame:
    """All columns and ``ids_col``: the token ids of the whole text.

    Null and empty texts have no ids. Rows pass through one by one, so repeated
    rows stay repeated and an empty table stays empty.
    """
    return df.withColumn(ids_col, encoder(df.sparkSession, ranks_path, pattern)(F.col(text_col)))


def decode_documents(df: DataFrame, ranks_path: str, pattern: str, ids_col: str = "ids", bytes_col: str = "decoded") -> DataFrame:
    """All columns and ``bytes_col``: the bytes that ``ids_col`` stands for."""
    return df.withColumn(bytes_col, decoder(df.sparkSession, ranks_path, pattern)(F.col(ids_col)))


def ids_digest(ids: Column) -> Column:
    """Lowercase hex SHA-256 of the decimal ids joined by commas."""
    return F.sha2(F.array_join(ids.cast("array<string>"), ",").cast("binary"), 256)


def round_trip(documents: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, n_tokens, ids_sha256, decoded_sha256)`` of every document, in any order.

    Null ids are kept as they are; other columns take no part.
    """
    rows = pick(documents, doc_id=id_col, text=text_col)
    done = rows.select("doc_id", round_tripper(documents.sparkSession, ranks_path, pattern)("text").alias("t"))
    return done.select(
        "doc_id",
        F.size("t.ids").cast("long").alias("n_tokens"),
        ids_digest(F.col("t.ids")).alias("ids_sha256"),
        F.sha2("t.decoded", 256).alias("decoded_sha256"),
    )
