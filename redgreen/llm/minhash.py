"""Near-duplicate documents by MinHash, verified on full shingle sets.

Every document's distinct word shingles are hashed, and ``rows * bands``
universal hash functions keep their minima. Documents with equal sets form one
class, represented by its smallest id. Classes that share a band of minima are
candidates: within a bucket each is compared with the bucket's smallest class,
first by signature, then on the full sets. Linked classes form components by
alternating large-star and small-star. What a bucket still holds apart after
that is compared in blocks, first by the likeliest pair of two components, then
pair by pair, so no link is lost to the star.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from redgreen.llm.support import discard, durable, pick, reread, ship, tidy

# A pair of similarity s misses every band with probability (1 - s^5)^32: 3e-6 at 0.8, 4e-9 at 0.85.
ROWS, BANDS = 5, 32
# Signatures of pairs at s agree in a share of s +- sqrt(s (1 - s) / 160): at 0.8, 0.18 is over five such deviations.
SIGNATURE_SLACK = 0.18
# Ids up to this number are sent to every task that reads texts (8 bytes each); more are joined by a shuffle.
BROADCAST_IDS = 1_000_000
# Shingles hashed at once, and members of a bucket in one block: bounds of memory, not of the work.
CHUNK = 4096
BLOCK = 256
SEED = 20240607


def word_hashes(text: str | None, memory: dict[bytes, int]) -> np.ndarray:
    """64-bit hashes of the words ``[^\\x20\\x09-\\x0D]+`` of a text, A-Z lower-cased."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: only ASCII is lowered and split at
    if len(memory) > 100_000:
        memory.clear()
    for word in set(words):
        if word not in memory:
            memory[word] = xxhash.xxh3_64_intdigest(word)
    return np.fromiter(map(memory.__getitem__, words), dtype=np.uint64, count=len(words))


def shingle_set(hashes: np.ndarray, size: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the shingles; the whole sequence is one if there are fewer words."""
    if not len(hashes):
        return hashes
    size = min(size, len(hashes))
    n = len(hashes) - size + 1
    mixed = np.zeros(n, dtype=np.uint64)
    for i in range(size):
        mixed = (mixed ^ hashes[i : i + n]) * np.uint64(0x9E3779B97F4A7C15)
        mixed ^= mixed >> np.uint64(29)
    mixed = (mixed + np.uint64(size)) * np.uint64(0xBF58476D1CE4E5B9)
    return np.unique(mixed ^ (mixed >> np.uint64(32)))


def universal(functions: int) -> tuple[np.ndarray, np.ndarray]:
    """Multipliers and addends of the functions x -> a x + b mod 2^64 of 32-bit x."""
    random = np.random.default_rng(SEED)
    a = random.integers(0, 1 << 63, functions, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    return a, random.integers(0, 1 << 63, functions, dtype=np.uint64) * np.uint64(2)


def signature(shingles: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """16 bits of each function's minimum over a set; the leading bits of a minimum say little."""
    out = np.full(len(a), 0xFFFFFFFFFFFFFFFF, dtype=np.uint64)
    folded = shingles >> np.uint64(32)
    for start in range(0, len(folded), CHUNK):
        part = folded[start : start + CHUNK]
        for i in range(0, len(a), 32):
            values = a[i : i + 32, None] * part
            values += b[i : i + 32, None]
            out[i : i + 32] = np.minimum(out[i : i + 32], values.min(axis=1))
    return ((out >> np.uint64(32)) & np.uint64(0xFFFF)).astype(np.uint16)


def band_keys(signatures: np.ndarray) -> np.ndarray:
    """A 64-bit key for each band of each signature."""
    rows = signatures.reshape(len(signatures), BANDS, ROWS).astype(np.uint64)
    keys = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64), rows.shape[:2]).copy()
    for i in range(ROWS):
        keys = (keys ^ rows[:, :, i]) * np.uint64(0x9E3779B97F4A7C15)
        keys ^= keys >> np.uint64(31)
    return keys.view(np.int64)


def sketch(rows: DataFrame, words: int) -> DataFrame:
    """``(doc_id, n_shingles, set_hi, set_lo, signature)`` of ``(doc_id, text)``, without texts."""
    ship(rows.sparkSession)

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from redgreen.llm import minhash as m

        a, b = m.universal(m.ROWS * m.BANDS)
        memory: dict[bytes, int] = {}
        for batch in batches:
            ids = batch.column(0)
            out: dict[str, list] = {"n": [], "hi": [], "lo": [], "sig": []}
            for text in batch.column(1):
                shingles = m.shingle_set(m.word_hashes(text.as_py(), memory), words)
                whole = xxhash.xxh3_128_intdigest(shingles.tobytes())
                out["n"].append(len(shingles))
                out["hi"].append((whole >> 64) - (1 << 63))
                out["lo"].append((whole & (1 << 64) - 1) - (1 << 63))
                out["sig"].append(m.signature(shingles, a, b).tobytes() if len(shingles) else None)
            yield pa.RecordBatch.from_arrays(
                [ids, pa.array(out["n"], pa.int64()), pa.array(out["hi"], pa.int64()), pa.array(out["lo"], pa.int64()), pa.array(out["sig"], pa.binary())],
                ["doc_id", "n_shingles", "set_hi", "set_lo", "signature"],
            )

    return rows.mapInArrow(run, "doc_id bigint, n_shingles bigint, set_hi bigint, set_lo bigint, signature binary")


def bands(classes: DataFrame) -> DataFrame:
    """``(bucket, node)`` for every band of ``(node, signature)``."""

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from redgreen.llm import minhash as m

        for batch in batches:
            if batch.num_rows:
                lines = np.frombuffer(b"".join(x.as_py() for x in batch.column(1)), dtype=np.uint16)
                keys = m.band_keys(lines.reshape(batch.num_rows, m.ROWS * m.BANDS))
                nodes = np.repeat(batch.column(0).to_numpy(zero_copy_only=False), m.BANDS)
                yield pa.RecordBatch.from_arrays([pa.array(keys.ravel()), pa.array(nodes, pa.int64())], ["bucket", "node"])

    return classes.select("node", "signature").mapInArrow(run, "bucket bigint, node bigint")


def agreeing(pairs: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """``pairs`` (a, b) of nodes whose set sizes and signatures allow the similarity."""
    left = reread(classes).select(F.col("node").alias("a"), F.col("signature").alias("sig_a"), F.col("n_shingles").alias("n_a"))
    right = reread(classes).select(F.col("node").alias("b"), F.col("signature").alias("sig_b"), F.col("n_shingles").alias("n_b"))
    least = percent / 100 - SIGNATURE_SLACK

    @F.arrow_udf("double")
    def share(x: pa.Array, y: pa.Array) -> pa.Array:
        one, other = (np.frombuffer(b"".join(v.as_py() for v in z), dtype=np.uint16).reshape(len(z), -1) for z in (x, y))
        return pa.array((one == other).mean(axis=1), pa.float64()) if len(x) else pa.array([], pa.float64())

    met = pairs.join(right, "b").join(left, "a")
    met = met.where(100 * F.least("n_a", "n_b") >= percent * F.greatest("n_a", "n_b"))
    return met.where(share("sig_a", "sig_b") >= least).select("a", "b").distinct()


def few(ids: DataFrame) -> DataFrame:
    """A table of ids, to be broadcast if there are no more than ``BROADCAST_IDS``."""
    return F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids


def confirmed(pairs: DataFrame, texts: DataFrame, words: int, percent: int) -> DataFrame:
    """``pairs`` (a, b) with ``100 * intersection >= percent * union`` on their full sets.

    ``pairs`` is a table of ``durable``, ``texts`` is ``(node, text)``. Only
    texts of documents in a pair are moved, and sets are made from the whole
    texts where a pair meets.
    """
    ship(texts.sparkSession)
    wanted = durable(pairs.select(F.col("a").alias("node")).union(pairs.select(F.col("b").alias("node"))).distinct(), "wanted")
    moved = durable(texts.join(few(wanted), "node", "left_semi").select("node", "text"), "texts")

    @F.arrow_udf("boolean")
    def linked(x: pa.Array, y: pa.Array) -> pa.Array:
        from redgreen.llm import minhash as m

        memory: dict[bytes, int] = {}
        out = []
        last, one = None, None
        for p, q in zip(x, y):
            p, q = p.as_py(), q.as_py()
            if p != last:  # the pairs of one a follow each other
                last, one = p, m.shingle_set(m.word_hashes(p, memory), words)
            other = m.shingle_set(m.word_hashes(q, memory), words)
            out.append(m.shared_enough(one, other, percent))
        return pa.array(out, pa.bool_())

    # b is the many: joined first, by its own key. A centre's key may be hot; its pairs can then be split.
    met = pairs.join(reread(moved).select(F.col("node").alias("b"), F.col("text").alias("y")), "b")
    met = met.join(reread(moved).select(F.col("node").alias("a"), F.col("text").alias("x")), "a")
    out = durable(met.where(linked("x", "y")).select("a", "b"), "links")
    discard([moved, wanted])
    return out


def components(links: DataFrame) -> DataFrame:
    """``(node, component)`` of linked nodes, component = smallest node reachable.

    Alternates large-star (every larger neighbour links to the smallest
    neighbour) and small-star (every smaller neighbour and the node itself do)
    until every component is one star. Neighbourhoods are only reduced to their minimum,
    never collected; every round is a table in the shared folder.
    """
    edges = durable(
        links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges"
    )
    while True:
        both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = durable(large.where("u <> v").distinct(), "edges")
        small_least = large.groupBy("u").agg(F.min("v").alias("m"))
        met = reread(large).join(small_least, "u")
        small = met.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(
            small_least.select("u", F.col("m").alias("v"))
        )
        new = durable(small.distinct(), "edges")
        discard([edges, large])
        edges = new
        # Stars: no node has two centres, and no centre has one.
        ends = new.select("u", F.lit(1).alias("links"), F.lit(0).alias("centre")).union(
            new.select("v", F.lit(0), F.lit(1))
        )
        each = ends.groupBy("u").agg(F.sum("links").alias("links"), F.max("centre").alias("centre"))
        if each.where("links > 1 or links = 1 and centre = 1").isEmpty():
            break
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component"))


def crowded(buckets: DataFrame) -> DataFrame:
    """``(bucket, node, centre, n)`` of the buckets that hold more than one node; centre = the smallest."""
    # A table of its own: only where both sides of a join are read anew can the engine split a hot bucket's rows.
    centres = durable(buckets.groupBy("bucket").agg(F.min("node").alias("centre"), F.count("*").alias("n")).where("n > 1"), "centres")
    return reread(buckets).join(centres, "bucket")


def shared_enough(one: np.ndarray, other: np.ndarray, percent: int) -> bool:
    """Whether ``100 * intersection >= percent * union`` of two sorted sets; never for an empty one."""
    small, large = (one, other) if len(one) <= len(other) else (other, one)
    if not len(small):
        return False
    at = np.searchsorted(large, small)
    common = int((large[np.minimum(at, len(large) - 1)] == small).sum())
    return 100 * common >= percent * (len(one) + len(other) - common)


def apart(
    members: DataFrame, classes: DataFrame, found: DataFrame, percent: int, texts: DataFrame | None = None, words: int = 0
) -> DataFrame:
    """Pairs that the stars left open: same bucket, different components, neither its centre.

    Only buckets that hold several components are looked at. Their members are
    dealt into blocks, every two blocks of a bucket meet in one task, and only
    pairs whose set sizes and signatures agree come out, each from the first
    band it shares. Without ``texts`` they are candidates, and two components
    give one pair, the one whose signatures agree most. With ``texts``, which
    then come to the blocks, all pairs are confirmed on their full sets where
    they meet, and only links come out. A bucket of any size is spread over as
    many tasks as it has pairs of blocks.
    """
    least = percent / 100 - SIGNATURE_SLACK
    marked = members.where("n > 2").join(found, "node", "left").withColumn("component", F.coalesce("component", "node"))
    mixed = marked.groupBy("bucket").agg(F.min("component").alias("low"), F.max("component").alias("high"))
    mixed = durable(mixed.where("low <> high").select("bucket"), "mixed")
    met = marked.where("node <> centre").join(mixed, "bucket").join(reread(classes).select("node", "signature", "n_shingles"), "node")
    more = []
    if texts is not None:
        wanted = durable(met.select("node").distinct(), "wanted")
        met = met.join(durable(texts.join(few(wanted), "node", "left_semi").select("node", "text"), "texts"), "node")
        more = ["text"]
    met = met.withColumn("blocks", F.ceil(F.col("n") / BLOCK).cast("int"))
    met = met.withColumn("own", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    met = met.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select(
        "bucket", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "node", "component", "n_shingles", "signature", *more
    )

    def run(key: tuple, table: pa.Table) -> pa.Table:
        from redgreen.llm import minhash as m

        i, j = key[1].as_py(), key[2].as_py()
        own, node, component, n = (table.column(c).to_numpy() for c in ("own", "node", "component", "n_shingles"))
        lines = np.frombuffer(b"".join(x.as_py() for x in table.column("signature")), dtype=np.uint16).reshape(len(node), -1)
        keys = m.band_keys(lines)
        band = int((keys[0] == key[0].as_py()).argmax())
        left, right = np.flatnonzero(own == i), np.flatnonzero(own == j)
        pairs = []
        for x in left:
            fits = 100 * np.minimum(n[right], n[x]) >= percent * np.maximum(n[right], n[x])
            some = right[fits & (component[right] != component[x]) & ((node[right] > node[x]) | (i != j))]
            if len(some):
                agree = (lines[some] == lines[x]).mean(axis=1)
                hits = (agree >= least) & ((keys[some] == keys[x]).argmax(axis=1) == band)
                pairs.append(np.column_stack([np.full(hits.sum(), x), some[hits], agree[hits] * 1000]).astype(np.int64))
        a, b, agree = (np.concatenate(pairs) if pairs else np.empty((0, 3), dtype=np.int64)).T
        if more and len(a):
            memory: dict[bytes, int] = {}
            sets = {x: m.shingle_set(m.word_hashes(table.column("text")[x].as_py(), memory), words) for x in {*a.tolist(), *b.tolist()}}
            keep = [i for i, (x, y) in enumerate(zip(a.tolist(), b.tolist())) if m.shared_enough(sets[x], sets[y], percent)]
            a, b, agree = a[keep], b[keep], agree[keep]
        ends = [np.minimum(component[a], component[b]), np.maximum(component[a], component[b])]
        if not more and len(a):
            order = np.lexsort((node[b], node[a], -agree, ends[1], ends[0]))
            first = np.append(True, (np.diff(ends[0][order]) != 0) | (np.diff(ends[1][order]) != 0))
            keep = order[first]
            a, b, agree, ends = a[keep], b[keep], agree[keep], [e[keep] for e in ends]
        out = [np.minimum(node[a], node[b]), np.maximum(node[a], node[b]), agree, *ends]
        return pa.table({name: pa.array(x, pa.int64()) for name, x in zip(("a", "b", "agree", "low", "high"), out)})

    pairs = met.groupBy("bucket", "i", "j").applyInArrow(run, "a bigint, b bigint, agree bigint, low bigint, high bigint")
    if not more:
        return pairs.groupBy("low", "high").agg(F.max(F.struct("agree", "a", "b")).alias("p")).select("p.a", "p.b")
    return pairs.select("a", "b").distinct()


def near_duplicates(
    documents: DataFrame, words: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """``(doc_id, n_shingles, component_id, kept)``, one row per input row.

    Documents are linked if ``100 * intersection >= percent * union`` of their
    sets of ``words``-word shingles (A-Z lower-cased; with fewer words the
    whole sequence is the one shingle). ``component_id`` is the smallest id
    reachable, and the rows with that id are ``kept``. Texts that are null or
    without words have no shingles and link with nothing. Rows without an id
    take no part in linking: their component is null and they are kept. Rows
    that share an id are reported each, and linked as one: where ids repeat with
    different texts, give the rows numbers of their own first, as the corpus
    pipeline does. An empty table gives an empty result.
    """
    ids = pick(documents, doc_id=id_col, text=text_col).withColumn("doc_id", F.col("doc_id").cast("long"))
    key = ["set_hi", "set_lo", "n_shingles"]
    sketches = durable(sketch(ids, words), "sketches")
    real = "n_shingles > 0 and doc_id is not null"
    classes = durable(
        sketches.where(real).groupBy(*key).agg(F.min("doc_id").alias("node"), F.first("signature").alias("signature")), "classes"
    )
    texts = ids.where("doc_id is not null").select(F.col("doc_id").alias("node"), "text")
    buckets = durable(bands(classes), "buckets")
    members = durable(crowded(buckets), "members")
    discard([buckets])
    star = members.where("node <> centre").select(F.col("centre").alias("a"), F.col("node").alias("b")).distinct()
    links = confirmed(durable(agreeing(star, classes, percent), "pairs"), texts, words, percent)
    found = durable(components(links), "components")
    # The likeliest link between any two components first: what that joins needs no more comparisons.
    for last in (False, True):
        if last:
            more = durable(apart(members, classes, found, percent, texts, words), "links")
        else:
            more = confirmed(durable(apart(members, classes, found, percent), "pairs"), texts, words, percent)
        if not more.isEmpty():
            # Stars stand for all links found so far.
            stars = found.select(F.col("node").alias("a"), F.col("component").alias("b"))
            found = durable(components(stars.union(more)), "components")
    # From classes back to documents: the class's smallest id, then its component.
    reached = reread(classes).select(*key, "node").join(found, "node", "left")
    reached = reached.select(*key, F.coalesce("component", "node").alias("component_id"))
    rows = reread(sketches).select("doc_id", *key)
    linked = rows.where(real).join(reached, key).select("doc_id", "n_shingles", "component_id")
    alone = rows.where(f"not ({real})").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return linked.union(alone).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
