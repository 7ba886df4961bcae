"""Jaccard join of documents on word shingles, by T-occurrence search.

A document of n shingles links only with those that share ``T = ceil(p n)`` of
them or more, p the similarity. With an inverted list of documents for every
shingle, the partners are the documents that occur T times on the n lists. As
DivideSkip has it, the L longest lists are set aside, the short ones are merged
by a heap for documents that occur ``T - L`` times, and those few are probed
for in the long ones by binary search.

Lists of a whole corpus do not fit a task, so what must meet is found first:

1. Documents with equal sets are one class. From here on a class is one set.
2. A class gives its shingles of smallest hashes, ``n - T + l`` of them, with
   l a tenth of n. Classes that link share at least the smaller one's l of
   these, and so ``g = ceil(ceil(p n) / 10)``. Shingles of one class only have
   no list; classes with fewer than g lists have no partner and are done.
3. Of a class's lists the g - 1 longest are set aside here too: partners share g
   lists, so the shortest that they share is kept by both. Classes on one list
   meet through its smallest class; what is connected so is a neighbourhood,
   and no link leaves it.
4. Neighbourhoods are packed into bins of bounded size, and a bin is searched
   in one task, over the full sets. Neighbourhoods beyond a bin's size are cut
   into blocks, which are searched with some members of the whole; then every
   class outside the largest component meets all blocks. Links inside a
   component join nothing, so no link that counts is lost.

Out of a task come only links that join what is apart, less than it has classes.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from redgreen.llm.minhash import components, few, shingle_set, word_hashes
from redgreen.llm.support import discard, durable, pick, reread, ship, tidy

# Shingles of all sets searched in one task: a bound of memory and of a task's work.
BIN = 1 << 20
# Members of a large neighbourhood that every block of it is compared with first.
GUIDES = 64
# How much a longer list adds to the number of lists set aside less.
MU = 0.01
# Entries that a heap merges; more are merged by a sort, which finds the lists as runs.
HEAP = 4096


def needed(n: int | np.ndarray, percent: int):
    """T: how many shingles a set of n shares with any partner at the least."""
    return -(-n * percent // 100)


def spare(n: int) -> int:
    """l: shingles given beyond those that a partner may lack."""
    return -(-n // 10)


def merged(lists: list[np.ndarray], least: int) -> tuple[np.ndarray, np.ndarray]:
    """Numbers that stand on ``least`` of some sorted lists or more, and on how many."""
    if sum(map(len, lists)) <= HEAP:
        found, counts = [], []
        last, times = -1, 0
        for number in heapq.merge(*(x.tolist() for x in lists)):
            if number != last:
                if times >= least:
                    found.append(last)
                    counts.append(times)
                last, times = number, 0
            times += 1
        if times >= least:
            found.append(last)
            counts.append(times)
        return np.array(found, dtype=np.int64), np.array(counts, dtype=np.int64)
    line = np.sort(np.concatenate(lists), kind="stable")
    ends = np.flatnonzero(np.append(line[1:] != line[:-1], True))
    counts = np.diff(ends, prepend=-1)
    keep = counts >= least
    return line[ends[keep]].astype(np.int64), counts[keep]


class Lists:
    """Inverted lists of some sets: for each shingle of several sets, their numbers in ascending order."""

    def __init__(self, sets: list[np.ndarray]):
        self.sizes = np.array([len(s) for s in sets], dtype=np.int64)
        shingles = np.concatenate(sets) if sets else np.empty(0, dtype=np.uint64)
        owner = np.repeat(np.arange(len(sets), dtype=np.int32), self.sizes)
        order = np.argsort(shingles, kind="stable")  # owners ascend within a shingle
        shingles, self.owner = shingles[order], owner[order]
        new = np.append(True, shingles[1:] != shingles[:-1]) if len(shingles) else np.empty(0, dtype=bool)
        self.start = np.append(np.flatnonzero(new), len(shingles))
        self.keys = shingles[self.start[:-1]]
        self.sets = sets

    def of(self, query: np.ndarray) -> list[np.ndarray]:
        """The lists of a set's shingles."""
        if not len(self.keys):
            return []
        at = np.minimum(np.searchsorted(self.keys, query), len(self.keys) - 1)
        at = at[self.keys[at] == query]
        return [self.owner[a:b] for a, b in zip(self.start[at], self.start[at + 1])]

    def search(self, query: np.ndarray, percent: int) -> np.ndarray:
        """Numbers of the sets with ``100 * intersection >= percent * union``, in ascending order."""
        n = len(query)
        t = needed(n, percent)
        lists = sorted(self.of(query), key=len)
        if not n or len(lists) < t:
            return np.empty(0, dtype=np.int64)
        longest = len(lists[-1])
        aside = min(t - 1, int(t / (MU * math.log2(longest) + 1)) if longest > 1 else t - 1)
        short, long = lists[: len(lists) - aside], lists[len(lists) - aside :]
        found, counts = merged(short, t - aside)
        sizes = self.sizes[found]
        keep = (100 * np.minimum(sizes, n) >= percent * np.maximum(sizes, n))
        found, counts, sizes = found[keep], counts[keep], sizes[keep]
        least = -(-percent * (n + sizes) // (100 + percent))  # the overlap that the two sizes ask for
        for left, line in zip(range(len(long), 0, -1), long):
            open_ = counts + left >= least  # those that can still get there
            found, counts, least = found[open_], counts[open_], least[open_]
            if not len(found):
                break
            at = np.minimum(np.searchsorted(line, found), len(line) - 1)
            counts = counts + (line[at] == found)
        return found[counts >= least]


class Forest:
    """Components of numbers, joined link by link."""

    def __init__(self, n: int):
        self.parent = list(range(n))

    def root(self, x: int) -> int:
        while self.parent[x] != x:
            self.parent[x] = self.parent[self.parent[x]]
            x = self.parent[x]
        return x

    def join(self, x: int, y: int) -> bool:
        x, y = self.root(x), self.root(y)
        self.parent[max(x, y)] = min(x, y)
        return x != y


def halves(shingles: np.ndarray) -> tuple[int, int]:
    """A 128-bit hash of a set, as two longs."""
    whole = xxhash.xxh3_128_intdigest(shingles.tobytes())
    return (whole >> 64) - (1 << 63), (whole & (1 << 64) - 1) - (1 << 63)


def sketch(rows: DataFrame, words: int, percent: int) -> DataFrame:
    """``(doc_id, n_shingles, hi, lo, first)`` of ``(doc_id, text)``: size and hash of the set, its smallest shingles."""
    ship(rows.sparkSession)

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from redgreen.llm import overlap as m

        memory: dict[bytes, int] = {}
        for batch in batches:
            for at in range(0, batch.num_rows, 256):  # what a task holds beside its batch
                part = batch.slice(at, 256)
                n, hi, lo, first = [], [], [], []
                for text in part.column(1):
                    shingles = m.shingle_set(m.word_hashes(text.as_py(), memory), words)
                    size = len(shingles)
                    n.append(size)
                    for half, out in zip(m.halves(shingles), (hi, lo)):
                        out.append(half)
                    first.append(shingles[: size - m.needed(size, percent) + m.spare(size)].view(np.int64))
                kinds = [pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64())]
                columns = [pa.array(x, kind) for x, kind in zip((n, hi, lo, first), kinds)]
                yield pa.RecordBatch.from_arrays([part.column(0), *columns], ["doc_id", "n_shingles", "hi", "lo", "first"])

    return rows.mapInArrow(run, "doc_id bigint, n_shingles bigint, hi bigint, lo bigint, first array<bigint>")


def neighbourhoods(classes: DataFrame, percent: int) -> DataFrame:
    """``(node, component)``: classes that may link, by groups that no link leaves. ``classes`` is ``(node, n_shingles, first)``."""
    given = durable(classes.select("node", F.explode("first").alias("key")), "given")
    # Tables of their own: only where both sides of a join are read anew can the engine split a hot key's rows.
    lists = durable(given.groupBy("key").agg(F.count("*").alias("length")).where("length > 1"), "lists")
    entries = durable(reread(given).join(lists, "key"), "entries")
    discard([given])
    # A class has as many rows here as smallest shingles.
    guaranteed = F.expr(f"((n_shingles * {percent} + 99) div 100 + 9) div 10").alias("g")  # l of the smallest partner
    counted = reread(entries).groupBy("node").agg(F.count("*").alias("lists")).join(reread(classes).select("node", guaranteed), "node")
    open_ = durable(counted.where("lists >= g").select("node", "g"), "open")
    longest = Window.partitionBy("node").orderBy(F.desc("length"), F.desc("key"))
    kept = reread(entries).join(open_, "node").withColumn("place", F.row_number().over(longest)).where("place >= g").select("key", "node")
    kept = durable(kept, "kept")
    discard([entries])
    centres = kept.groupBy("key").agg(F.min("node").alias("centre"), F.max("node").alias("high")).where("centre <> high").select("key", "centre")
    met = reread(kept).join(durable(centres, "centres"), "key").where("node <> centre").select(F.col("centre").alias("a"), F.col("node").alias("b"))
    found = durable(components(met.distinct()), "neighbourhoods")
    centre = reread(found).select(F.col("component").alias("node"), "component").distinct()
    return found.select("node", "component").union(centre)


def full_sets(texts: DataFrame, wanted: DataFrame, words: int) -> DataFrame:
    """``(node, component, n, shingles)`` of the classes ``wanted (doc_id, hi, lo, node, component)``, once each."""

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from redgreen.llm import overlap as m

        memory: dict[bytes, int] = {}
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                keep, n, sets = [], [], []
                for place, (text, hi, lo) in enumerate(zip(*part.columns[:3])):
                    shingles = m.shingle_set(m.word_hashes(text.as_py(), memory), words)
                    if m.halves(shingles) == (hi.as_py(), lo.as_py()):  # an id may have other texts
                        keep.append(place)
                        n.append(len(shingles))
                        sets.append(shingles.tobytes())
                rows = pa.array(keep, pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [part.column(3).take(rows), part.column(4).take(rows), pa.array(n, pa.int64()), pa.array(sets, pa.binary())],
                    ["node", "component", "n", "shingles"],
                )

    wanted = durable(wanted, "wanted")
    met = texts.join(few(wanted), "doc_id").select("text", "hi", "lo", "node", "component")
    rows = met.mapInArrow(run, "node bigint, component bigint, n bigint, shingles binary")
    return rows.dropDuplicates(["node"])  # a row that repeats id and text


def searched(rows: DataFrame, keys: list[str], percent: int) -> DataFrame:
    """Links ``(a, b)`` in each group of ``(*keys, node, ask, listed, shingles)`` that join what is apart in it.

    Sets that ``ask`` are searched for among those ``listed``; a set may be both.
    """

    def run(table: pa.Table) -> pa.Table:
        from redgreen.llm import overlap as m

        node = table.column("node").to_numpy()
        order = np.argsort(node, kind="stable")
        order = order[np.append(True, node[order][1:] != node[order][:-1])]  # a set comes once
        node = node[order]
        ask, listed = (table.column(c).to_numpy()[order] for c in ("ask", "listed"))
        sets = [np.frombuffer(x.as_py(), dtype=np.uint64) for x in table.column("shingles").take(pa.array(order))]
        places = np.flatnonzero(listed)
        lists = m.Lists([sets[i] for i in places])
        forest = m.Forest(len(sets))
        links = []
        for i in np.flatnonzero(ask):
            for j in places[lists.search(sets[i], percent)].tolist():
                if forest.join(int(i), j):
                    links.append((node[i], node[j]))
        a, b = np.array(links, dtype=np.int64).reshape(-1, 2).T
        return pa.table({"a": pa.array(np.minimum(a, b)), "b": pa.array(np.maximum(a, b))})

    return rows.groupBy(*keys).applyInArrow(run, "a bigint, b bigint")


def links_of(sets: DataFrame, percent: int, bin_size: int = BIN) -> DataFrame:
    """``(node, component)`` of linked classes, from ``(node, component, n, shingles)`` by neighbourhood."""
    sizes = durable(sets.groupBy("component").agg(F.sum("n").alias("weight")), "weights")
    small = sizes.where(F.col("weight") <= bin_size)
    # Bins are filled to a quarter, so that there are more of them than of large neighbourhoods' blocks to share the work.
    bins = max(1, math.ceil(4 * (small.agg(F.sum("weight").alias("w")).first()["w"] or 0) / bin_size))
    packed = reread(sets).join(small, "component").select(
        F.pmod(F.xxhash64("component"), F.lit(bins)).alias("bin"), "node", F.lit(True).alias("ask"), F.lit(True).alias("listed"), "shingles"
    )
    links = durable(searched(packed, ["bin"], percent), "links")
    large = sizes.where(F.col("weight") > bin_size)
    if large.isEmpty():
        return components(links)
    # Blocks by a hash of the class, and guides: members with the smallest such hashes, in every block.
    met = reread(sets).join(large, "component").withColumn("blocks", F.ceil(F.col("weight") / bin_size).cast("int"))
    met = durable(met.withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")), "large")
    first = Window.partitionBy("component").orderBy(F.xxhash64("node", F.lit(1)), "node")
    guides = reread(met).select("component", "node", "blocks").withColumn("place", F.row_number().over(first)).where(F.col("place") <= GUIDES)
    guides = guides.select("component", "node", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"))
    shown = guides.join(reread(met).select("component", "node", "shingles"), ["component", "node"])
    here = [F.lit(True).alias("ask"), F.lit(True).alias("listed"), "shingles"]
    both = met.select("component", "block", "node", *here).unionByName(shown.select("component", "block", "node", *here))
    found = durable(components(links.union(searched(both, ["component", "block"], percent))), "components")
    # Classes outside the largest component of their neighbourhood meet every block.
    roots = reread(met).select("component", "node", "n", "block", "blocks").join(found.select("node", F.col("component").alias("root")), "node", "left")
    roots = durable(roots.withColumn("root", F.coalesce("root", "node")), "roots")
    parts = reread(roots).groupBy("component", "root").agg(F.count("*").alias("members"))
    main = parts.groupBy("component").agg(F.max(F.struct("members", "root")).alias("m")).select("component", F.col("m.root").alias("main"))
    rest = durable(reread(roots).join(main, "component").where("root <> main").select("component", "node", "n", "blocks"), "rest")
    if rest.isEmpty():
        return found
    askers = rest.groupBy("component").agg(F.ceil(F.sum("n") / bin_size).cast("int").alias("groups"))
    asking = rest.join(askers, "component").select(
        "component", "node", F.pmod(F.xxhash64("node", F.lit(2)), F.col("groups")).cast("int").alias("group"),
        F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"),
    ).join(reread(met).select("component", "node", "shingles"), ["component", "node"])
    listed = reread(met).join(askers, "component").select("component", F.explode(F.sequence(F.lit(0), F.col("groups") - 1)).alias("group"), "block", "node", "shingles")
    names = ["component", "group", "block", "node", "ask", "listed", "shingles"]
    both = asking.select(*names[:4], F.lit(True).alias("ask"), F.lit(False).alias("listed"), "shingles").union(
        listed.select(*names[:4], F.lit(False).alias("ask"), F.lit(True).alias("listed"), "shingles")
    )
    # A class that asks and is listed in its own block comes as both.
    once = both.groupBy("component", "group", "block", "node").agg(F.max("ask").alias("ask"), F.max("listed").alias("listed"), F.first("shingles").alias("shingles"))
    more = durable(searched(once, names[:3], percent), "links")
    stars = found.select(F.col("node").alias("a"), F.col("component").alias("b"))
    return components(stars.union(more))


def jaccard_join(
    documents: DataFrame, words: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text", bin_size: int = BIN
) -> DataFrame:
    """``(doc_id, n_shingles, component_id)``, one row per input row.

    Documents link if ``100 * intersection >= percent * union`` of their sets
    of ``words``-word shingles (A-Z lower-cased; with fewer words the whole
    sequence is the one shingle); ``component_id`` is the smallest id reachable.
    Null texts and those without words have no shingles and link with nothing.
    Rows without an id take no part: their component is null. Rows that repeat
    an id are documents each, so equal ids may stand in different components.
    An empty table gives no rows. Shingles are compared by 64-bit hashes.
    """
    ids = pick(documents, doc_id=id_col, text=text_col).withColumn("doc_id", F.col("doc_id").cast("long"))
    key = ["hi", "lo", "n_shingles"]
    sketches = durable(sketch(ids, words, percent), "sketches")
    real = "n_shingles > 0 and doc_id is not null"
    classes = sketches.where(real).groupBy(*key).agg(F.min("doc_id").alias("least"), F.first("first").alias("first"))
    classes = durable(classes.withColumn("node", F.monotonically_increasing_id()), "classes")  # numbers are fixed here
    near = durable(neighbourhoods(classes, percent), "near")
    wanted = reread(classes).join(near, "node").select(F.col("least").alias("doc_id"), "hi", "lo", "node", "component")
    sets = durable(full_sets(ids, wanted, words), "sets")
    found = durable(links_of(sets, percent, bin_size), "components")
    # From classes back to documents: the smallest id of all classes of a component.
    placed = reread(classes).select(*key, "node", "least").join(found, "node", "left").withColumn("component", F.coalesce("component", "node"))
    heads = placed.groupBy("component").agg(F.min("least").alias("component_id"))
    reached = durable(placed.join(heads, "component").select(*key, "component_id"), "reached")
    rows = reread(sketches).select("doc_id", *key)
    linked = rows.where(real).join(reached, key).select("doc_id", "n_shingles", "component_id")
    return linked.union(rows.where(f"not ({real})").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id")))
