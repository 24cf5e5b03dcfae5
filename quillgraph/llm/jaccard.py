"""N-gram Jaccard join by vertical partitioning: exact links between texts, and their components.

The global order of shingles goes from rare to frequent. Two linked sets share one of the first shingles of both, so
sets meet there; then the overlaps of those that met are counted in fragments of the order and summed by pair.
Constants below choose between plans of equal results; none drops a link.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillgraph.llm.common import attach, cut, mapped, partitions, read, sweep
from quillgraph.llm.components import components

#: A set's count vector: shingles in each of so many slices of the global order.
SLICES = 64
#: Vertical fragments in which a pair's overlaps are counted apart.
FRAGMENTS = 4
#: Buckets up to this size give all their pairs at once; larger ones go by a pivot, and by rarity where that leaves them torn.
SMALL = 6
#: Words that a worker remembers; documents whose shingles it gathers; bits of the filter for the third reading of texts.
MEMORY, ROWS, FILTER_BITS = 100_000, 1000, 1 << 24
#: Slots in which shingles are counted to order them by rarity, and pieces in which the counts travel.
SLOTS, CHUNKS = 1 << 22, 64
#: Sets of one shingle that may go to one task; a shingle that stands out above that is dealt to several.
HOT = 1000
#: Ids of eight bytes that may be broadcast.
MOST_BROADCAST = 2_000_000
_U = np.uint64
DOC = np.dtype([("id", "<i8"), ("null", "u1"), ("key", "<i8"), ("n", "<i4")])
NODE = np.dtype([("id", "<i8"), ("null", "u1"), ("key", "<i8"), ("n", "<i4"), ("slices", "u1", (SLICES,))])


def mixed(x: np.ndarray) -> np.ndarray:
    """Unsigned 64-bit values, well mixed."""
    x = (x ^ (x >> _U(33))) * _U(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> _U(33))) * _U(0xC4CEB9FE1A85EC53)
    return x ^ (x >> _U(33))


class Shingler:
    """Sorted distinct hashes of the shingles of `width` words; with fewer words, of all words as one shingle."""

    def __init__(self, width: int):
        self.width, self.seen = width, {}

    def set_of(self, text: str | None) -> np.ndarray:
        words = (text or "").encode("utf-8", "replace").lower().split()  # bytes: ASCII letters and white space alone
        if not words:
            return np.zeros(0, _U)
        seen, digest = self.seen, xxhash.xxh64_intdigest
        if len(seen) > MEMORY:
            seen.clear()
        for w in words:
            if w not in seen:
                seen[w] = digest(w)
        h = np.array([seen[w] for w in words], dtype=_U)
        k = min(self.width, len(h))
        out = np.full(len(h) - k + 1, k, _U)
        for i in range(k):
            out = out * _U(0x9E3779B97F4A7C15) + h[i : len(h) - k + 1 + i]
        return np.unique(mixed(out))


def key_of(s: np.ndarray) -> int:
    """A set's name: equal sets, equal names."""
    return int(np.int64(_U(xxhash.xxh64_intdigest(s.tobytes())).view(np.int64)))


def slot_of(s: np.ndarray) -> np.ndarray:
    return (s & _U(SLOTS - 1)).astype(np.int64)


class Seen:
    """Remembers names, MEMORY of them at most; what it forgot is new again."""

    def __init__(self):
        self.names = set()

    def new(self, name: int) -> bool:
        if name in self.names:
            return False
        if len(self.names) > MEMORY:
            self.names.clear()
        self.names.add(name)
        return True


# --- the order of shingles -----------------------------------------------------------------------------------------
# Shingles are counted by slot of a table of fixed size, over all sets. Any order that all sets keep to is right;
# shingles that meet in one slot only make it less sharp.


def tallied(sets: Iterator[np.ndarray]) -> Iterator[pa.RecordBatch]:
    """How many of the sets hold each slot's shingles, in CHUNKS compressed pieces."""
    counts = np.zeros(SLOTS, np.uint32)
    for s in sets:
        np.add.at(counts, slot_of(s), np.uint32(1))
    pieces, pack = counts.reshape(CHUNKS, -1), zstandard.ZstdCompressor(level=1).compress
    yield pa.RecordBatch.from_arrays([pa.array(range(CHUNKS), pa.int32()), pa.array([pack(p.tobytes()) for p in pieces], pa.binary())], ["chunk", "counts"])


def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums of the pieces of each chunk, at most 2^30."""
    total: dict[int, np.ndarray] = {}
    unpack = zstandard.ZstdDecompressor().decompress
    for batch in batches:
        for chunk, data in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            total[chunk] = total.get(chunk, 0) + np.frombuffer(unpack(data), np.uint32).astype(np.int64)
    for chunk, n in total.items():
        yield pa.RecordBatch.from_arrays([pa.array([chunk], pa.int32()), pa.array([n.clip(max=1 << 30).astype(np.int32).tobytes()], pa.binary())], ["chunk", "counts"])


def table_of(tallies: DataFrame) -> np.ndarray:
    """The table of counts: SLOTS numbers of four bytes, whatever the tallies come from."""
    got = mapped(tallies.repartition(CHUNKS, "chunk"), summed, "chunk int, counts binary").toArrow()
    table = np.zeros((CHUNKS, SLOTS // CHUNKS), np.int32)
    for chunk, data in zip(*(c.to_pylist() for c in got.columns), strict=True):
        table[chunk] = np.frombuffer(data, np.int32)
    return table.ravel()


def in_order(s: np.ndarray, often: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Shingles from rare to frequent, and their counts."""
    c = often[slot_of(s)]
    order = np.lexsort((s, c))
    return s[order], c[order]


# --- candidates ----------------------------------------------------------------------------------------------------
# Linked sets A, B have an overlap of at least p |A| / 100, and of at least 2 p |A| / (100 + p) if B isn't smaller. The
# first shingle in the order that both have can't stand after what the overlap leaves over in A, nor in B. So it is in
# the head of the larger set, and in the shorter head of the smaller one.


def heads(n: int, percent: int) -> tuple[int, int]:
    """Lengths of the head and of the shorter head of a set of n shingles."""
    return n + (-percent * n // 100) + 1, n + (-2 * percent * n // (100 + percent)) + 1


def named(s: np.ndarray, key: int, often: np.ndarray, hot: float, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of a set, one for each shingle of its head, and what decides the part each goes to.

    The two lowest bits of a bucket's number say that the shingle is dealt to several parts, and that it stands in
    the shorter head. Shingles that differ in these bits alone share a bucket, which only adds candidates.
    """
    s, c = in_order(s, often)
    long, short = heads(len(s), percent)
    s, c = s[:long], c[:long]
    dealt = c > hot
    bucket = (s & ~_U(3)) | (dealt.astype(_U) << _U(1)) | (np.arange(long) < short).astype(_U)
    deal = np.where(dealt, _U(key & (1 << 63) - 1) % (1 + (c - hot).clip(min=0).astype(np.int64) // HOT).astype(_U), _U(0))
    return bucket, mixed((s & ~_U(3)) + deal * _U(0x9E3779B97F4A7C15))


def gathered(batches: Iterator[pa.RecordBatch], width: int, percent: int, parts: int, often: np.ndarray, hot: float) -> Iterator[pa.RecordBatch]:
    """For every ROWS documents and each part one row each of buckets (0), of sets (1) and of documents (2), all packed."""
    shingler, seen, n_docs = Shingler(width), Seen(), 0
    for batch in batches:
        for at in range(0, batch.num_rows, ROWS):
            part = batch.slice(at, ROWS)
            docs, nodes = np.zeros(part.num_rows, DOC), np.zeros(part.num_rows, NODE)
            entries, places, some = [], [], 0
            for i, (doc, value) in enumerate(zip(part.column(0).to_pylist(), part.column(1), strict=True)):
                s = shingler.set_of(value.as_py())
                key = key_of(s)
                docs[i] = doc or 0, doc is None, key, len(s)
                if len(s) and seen.new(key):
                    nodes[some] = doc or 0, doc is None, key, len(s), np.bincount((s >> _U(58)).astype(np.int64), minlength=SLICES).clip(max=255)
                    some += 1
                    bucket, place = named(s, key, often, hot, percent)
                    entries.append(np.stack([bucket.view(np.int64), np.full(len(bucket), key)], 1))
                    places.append(place)
            rows: list[tuple[int, int, bytes]] = []
            if entries:
                both = np.concatenate(entries)
                rows += [(0, p, both[x].tobytes()) for p, x in split(np.concatenate(places), parts)]
                nodes = nodes[:some]
                rows += [(1, p, nodes[x].tobytes()) for p, x in split(nodes["key"].view(_U), parts)]
            # documents of one set, however many, are dealt out in turn
            rows += [(2, p, docs[x].tobytes()) for p, x in split((np.arange(len(docs)) // 100 + n_docs).astype(_U), parts)]
            n_docs += 1 + len(docs) // 100
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), (pa.int32(), pa.int32(), pa.binary()), strict=True)], ["kind", "part", "data"])


def split(values: np.ndarray, parts: int) -> Iterator[tuple[int, np.ndarray]]:
    """Rows by part."""
    p = (values % _U(parts)).astype(np.int64)
    order = np.argsort(p, kind="stable")
    bounds = np.searchsorted(p[order], np.arange(parts + 1))
    for k in range(parts):
        if bounds[k] < bounds[k + 1]:
            yield k, order[bounds[k] : bounds[k + 1]]


GROUPED = "kind int, a long, b long, n int, data binary"


def grouped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of one part: documents (kind 0), pairs (1), members of large and of dealt buckets (2), sets with a document's id (3)."""
    names = [c.split()[0] for c in GROUPED.split(", ")]
    types = (pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.binary())

    def out(kind: int, a, b, n, data=None) -> pa.RecordBatch:
        columns = np.full(len(b), kind, np.int32), a, b, n, [None] * len(b) if data is None else data
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names)

    def ids(rows: np.ndarray) -> pa.Array:
        return pa.array(rows["id"], pa.int64(), mask=rows["null"].astype(bool))

    entries, nodes = [], []
    for batch in batches:
        for kind, data in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True):
            if kind == 2:
                x = np.frombuffer(data, DOC)
                yield out(0, ids(x), x["key"], x["n"])
            else:
                (nodes if kind else entries).append(np.frombuffer(data, NODE if kind else np.int64))
    if nodes:
        x = np.concatenate(nodes)
        nodes = x[np.unique(x["key"], return_index=True)[1]]
        for i in range(0, len(nodes), 20_000):
            x = nodes[i : i + 20_000]
            yield out(3, ids(x), x["key"], x["n"], [s.tobytes() for s in x["slices"]])
    if not entries:
        return
    both = np.concatenate(entries).reshape(-1, 2)
    del entries, nodes
    both = both[np.lexsort((both[:, 1], both[:, 0] >> 2))]
    # a set that came from several tasks is there once
    both = both[np.concatenate([[True], (both[1:, 1] != both[:-1, 1]) | (both[1:, 0] >> 2 != both[:-1, 0] >> 2)])]
    name, short = both[:, 0] >> 2, both[:, 0] & 1
    start = np.flatnonzero(np.concatenate([[True], name[1:] != name[:-1]]))
    size = np.diff(np.append(start, len(both)))
    dealt = both[start, 0] & 2 > 0
    # a pair needs one that has the shingle in its shorter head
    some = np.maximum.reduceat(short, start) > 0
    pairs = []
    for k in range(2, SMALL + 1):
        at = start[(size == k) & some & ~dealt][:, None] + np.arange(k)
        rows, can = both[:, 1][at], short[at] > 0
        pairs += [rows[:, [i, j]][can[:, i] | can[:, j]] for i in range(k) for j in range(i + 1, k)]
    pairs = np.unique(np.concatenate(pairs), axis=0)
    for i in range(0, len(pairs), 50_000):
        x = pairs[i : i + 50_000]
        yield out(1, x[:, 0], x[:, 1], np.zeros(len(x), np.int32))
    seen = Seen()
    large = []
    for a, k, many in zip(*(x[dealt | (size > SMALL) & some].tolist() for x in (start, size, dealt)), strict=True):
        # shingles with the same sets say the same
        if many or seen.new(xxhash.xxh64_intdigest(both[a : a + k, 1].tobytes() + short[a : a + k].tobytes())):
            large.append(np.arange(a, a + k))
        if large and (sum(map(len, large)) > 50_000):
            x = np.concatenate(large)
            large = []
            yield out(2, name[x], both[x, 1], short[x].astype(np.int32))
    if large:
        x = np.concatenate(large)
        yield out(2, name[x], both[x, 1], short[x].astype(np.int32))


# --- overlaps ------------------------------------------------------------------------------------------------------


def enough(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    """Pairs whose count vectors allow the overlap that a link needs: no slice can hold more common ones than its smaller count.

    Columns: a, b, the sizes and the count vectors; the vectors don't come out.
    """
    for batch in batches:
        x, y = (np.frombuffer(b"".join(batch.column(i).to_pylist()), np.uint8).reshape(-1, SLICES).astype(np.int32) for i in (4, 5))
        full = ((x == 255) & (y == 255)).any(1)  # counts stop at 255: then the vectors tell nothing
        total = batch.column(2).to_numpy().astype(np.int64) + batch.column(3).to_numpy()
        ok = full | (np.minimum(x, y).sum(1) * (100 + percent) >= percent * total)
        yield batch.select([0, 1, 2, 3]).filter(pa.array(ok))


def packed(s: np.ndarray) -> list[bytes]:
    """The set in FRAGMENTS pieces by its two highest bits."""
    bounds = np.searchsorted(s, np.arange(FRAGMENTS, dtype=_U) * _U((1 << 64) // FRAGMENTS)).tolist() + [len(s)]
    return [s[i:j].tobytes() for i, j in zip(bounds, bounds[1:], strict=False)]


def unpacked(x: bytes) -> np.ndarray:
    return np.frombuffer(x, _U)


def overlap(a: bytes, b: bytes) -> int:
    return len(np.intersect1d(unpacked(a), unpacked(b), assume_unique=True))


class Join:
    """The join over one table; see groups()."""

    def __init__(self, docs: DataFrame, width: int, percent: int):
        self.percent, self.width, self.spark = percent, width, docs.sparkSession
        self.docs = docs.select(F.col("doc_id").cast("long").alias("id"), F.col("text").alias("text"))
        n = partitions(self.spark)

        def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            shingler, seen = Shingler(width), Seen()
            sets = (shingler.set_of(v.as_py()) for batch in batches for v in batch.column(0))
            return tallied(s for s in sets if len(s) and seen.new(key_of(s)))

        often = table_of(mapped(self.docs.select("text"), counted, "chunk int, counts binary"))
        load = float(often.mean(dtype=float))
        # what chance lets meet in a slot doesn't stand out
        hot = load + 8 * load**0.5 + HOT
        shared = self.spark.sparkContext.broadcast(often)

        def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            return gathered(batches, width, percent, n, shared.value, hot)

        rows = mapped(self.docs, first, "kind int, part int, data binary")
        self.rows = cut(mapped(rows.repartition(n, "part"), grouped, GROUPED))
        del rows
        sweep(self.spark)
        #: (id, key, n) of every document; one row for each set, with the id of one of its documents.
        self.meta = self.rows.where("kind = 0").select(F.col("a").alias("id"), F.col("b").alias("key"), "n")
        self.nodes = self.rows.where("kind = 3").select(F.col("a").alias("id"), F.col("b").alias("key"), "n", F.col("data").alias("slices"))
        self.sets = None

    def possible(self, pairs: DataFrame) -> DataFrame:
        """Distinct pairs (a < b) that sizes and count vectors allow, with sizes."""
        p = self.percent
        a, b = (self.nodes.select(F.col("key").alias(x), F.col("n").alias(f"n{x}"), F.col("slices").alias(f"s{x}")) for x in "ab")
        pairs = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a != b").distinct()
        both = pairs.join(a, "a").join(b, "b").where(100 * F.least("na", "nb") >= p * F.greatest("na", "nb"))
        return mapped(both.select("a", "b", "na", "nb", "sa", "sb"), lambda x: enough(x, p), "a long, b long, na int, nb int")

    def read_sets(self, keys: DataFrame) -> None:
        """The packed sets of the keys, from another reading of the texts.

        A filter of fixed size over the ids that stand for the keys decides which texts to cut into shingles again.
        """
        picked = self.nodes.join(keys.select("key").distinct(), "key", "left_semi").select("key", "id")
        bits = FILTER_BITS
        slot = F.pmod(F.crc32(F.col("id").cast("string").cast("binary")), F.lit(bits))
        words = picked.where("id is not null").select(slot.alias("s")).groupBy((F.col("s") / 32).cast("int").alias("at")).agg(F.bit_or(F.expr("shiftleft(1L, cast(s % 32 as int))")).alias("w"))
        # at most a row for each of the filter's words
        got = words.toArrow()
        table = np.zeros(bits // 32, np.uint32)
        table[got.column("at").to_numpy()] = got.column("w").to_numpy().astype(np.uint32)
        shared, width = self.spark.sparkContext.broadcast(table), self.width

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            shingler, seen, held = Shingler(width), Seen(), shared.value
            for batch in batches:
                slots = batch.column(2).to_numpy(zero_copy_only=False)
                null = batch.column(0).is_null().to_numpy(zero_copy_only=False)
                at = np.where(null, 0, slots).astype(np.int64)
                hit = null | (held[at // 32] >> (at % 32).astype(np.uint32) & 1).astype(bool)
                found = np.flatnonzero(hit).tolist()
                for n in range(0, len(found), ROWS):
                    rows = []
                    for i in found[n : n + ROWS]:
                        s = shingler.set_of(batch.column(1)[i].as_py())
                        if len(s) and seen.new(key := key_of(s)):
                            rows += [(key, k, x) for k, x in enumerate(packed(s))]
                    if rows:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int32(), pa.binary()), strict=True)], ["key", "f", "x"])

        again = mapped(self.docs.select("id", "text", slot.alias("slot")), run, "key long, f int, x binary")
        self.sets = cut(again.join(picked.select("key"), "key", "left_semi").groupBy("key", "f").agg(F.first("x").alias("x")))
        del again, picked, words
        sweep(self.spark)

    def sets_of(self, keys: DataFrame) -> DataFrame:
        """The packed sets that a join with keys (key) needs; the others stay where they are, unless keys are too many to broadcast."""
        keys = cut(keys.distinct())
        return self.sets.join(F.broadcast(keys), "key", "left_semi") if keys.count() <= MOST_BROADCAST else self.sets

    def links(self, pairs: DataFrame) -> DataFrame:
        """Of possible pairs those that link: overlaps are counted by fragment and summed by pair."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                n = [overlap(x.as_py(), y.as_py()) for x, y in zip(batch.column(4), batch.column(5), strict=True)]
                yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(n, pa.int32())], ["a", "b", "na", "nb", "n"])

        a, b = (self.sets_of(pairs.select(F.col(k).alias("key"))).select(F.col("key").alias(k), "f", F.col("x").alias(f"x{k}")) for k in "ab")
        met = mapped(pairs.join(a, "a").join(b, ["b", "f"]).select("a", "b", "na", "nb", "xa", "xb"), run, "a long, b long, na int, nb int, n int")
        total = met.groupBy("a", "b", "na", "nb").agg(F.sum("n").alias("n"))
        return total.where(100 * F.col("n") >= self.percent * (F.col("na") + F.col("nb") - F.col("n"))).select("a", "b")

    def run(self) -> tuple[DataFrame, DataFrame]:
        """All links needed for the components, and (node, root) of every key that links."""
        members = self.rows.where("kind = 2").select(F.col("a").alias("bucket"), F.col("b").alias("key"), F.col("n").alias("short"))
        first = cut(self.possible(self.rows.where("kind = 1").select("a", "b")))
        # a set that stands in the shorter heads of many others' buckets is likely what they were made from: it goes first
        weight = members.groupBy("key").agg(F.sum("short").alias("weight"))
        pivots = members.join(weight, "key").groupBy("bucket").agg(F.max(F.when(F.col("short") > 0, F.struct("weight", "key"))).alias("p"), F.count(F.lit(1)).alias("q_n"))
        # every bucket is in the table, so that those that are dropped afterwards are dealt out too where they are hot
        at = attach(members, pivots.select("bucket", F.col("p.key").alias("pivot"), F.col("q_n").alias("size"), "q_n"), "bucket")
        at = cut(at.where("pivot is not null and size > 1").drop("size"))
        del members, weight, pivots
        sweep(self.spark)
        self.read_sets(reduce(DataFrame.unionByName, [first.select(F.col(c).alias("key")) for c in "ab"] + [at.select("key")]))
        # the sets travel once for each pair: one kind of pairs at a time, so that the disks hold the sets of one only
        found = cut(self.links(first))
        sweep(self.spark)
        if at.isEmpty():
            return found, components(found)
        second = cut(self.possible(at.select(F.col("pivot").alias("a"), F.col("key").alias("b"))))
        sweep(self.spark)
        second = cut(self.links(second))
        sweep(self.spark)
        found = found.unionByName(second)
        roots = components(found)
        # pairs with a pivot are settled, and so are pairs within a component
        rest = cut(at.where("key != pivot").join(roots.withColumnRenamed("node", "key"), "key", "left").select("bucket", "key", "short", F.coalesce("root", "key").alias("root")))
        stats = rest.groupBy("bucket").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.sum("short").alias("shorts"), F.count(F.lit(1)).alias("q_n"))
        stats = cut(stats.withColumn("torn", F.expr("lo != hi and shorts > 0")).withColumn("size", F.col("q_n")).drop("lo", "hi"))
        sweep(self.spark)
        if stats.where("torn").isEmpty():
            return found, roots
        torn = cut(attach(rest, stats, "bucket").where("torn").drop("torn"))
        more = []
        # few that can start a pair: each meets all the others
        few = torn.where(F.col("shorts") <= SMALL)
        starts = cut(few.where("short > 0").groupBy("bucket").agg(F.collect_list(F.struct("key", "root")).alias("starts"), F.first("size").alias("q_n")))
        met = attach(few, starts, "bucket").select("key", "root", F.explode("starts").alias("s"))
        more.append(cut(met.where("root != s.root").select(F.col("s.key").alias("a"), F.col("key").alias("b"))))
        left = cut(torn.where(F.col("shorts") > SMALL).select("key", "root").distinct())
        del starts, met
        sweep(self.spark)
        if not left.isEmpty():
            more.append(self._by_rarity(left))
        third = cut(self.possible(reduce(DataFrame.unionByName, more)))
        sweep(self.spark)
        found = cut(found.unionByName(self.links(third)))
        sweep(self.spark)
        return found, components(found)

    def _by_rarity(self, rest: DataFrame) -> DataFrame:
        """Pairs of sets (key, root) of different components that may link, by an order made for these sets alone.

        Among copies of one text the shingles of their own come first then. What is left from the first common shingle
        on must hold the overlap that a link needs; that settles copies that differ too much to link.
        """
        p = self.percent

        def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            return tallied(unpacked(x.as_py()) for batch in batches for x in batch.column(0))

        mine = self.sets_of(rest.select("key")).join(rest, "key")
        shared = self.spark.sparkContext.broadcast(table_of(mapped(mine.select("x"), counted, "chunk int, counts binary")))

        def ordered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            often = shared.value
            for batch in batches:
                for key, root, parts in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    s = np.concatenate([unpacked(x) for x in parts])
                    n = len(s)
                    s, c = in_order(s, often)
                    # a shingle of one set alone leads to no pair, but takes its place in the order
                    at = np.flatnonzero(c[: heads(n, p)[0]] > 1)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), v)) for v in (key, root, n)] + [pa.array(s[at].view(np.int64)), pa.array(n - at)], ["key", "root", "n", "token", "left"])

        whole = mine.groupBy("key", "root").agg(F.collect_list("x").alias("parts"))
        entries = cut(mapped(whole, ordered, "key long, root long, n long, token long, left long"))
        del mine, whole
        sweep(self.spark)
        a, b = (entries.select("token", *(F.col(c).alias(f"{c}_{x}") for c in ("key", "root", "n", "left"))) for x in "ab")
        need = p * (F.col("n_a") + F.col("n_b"))
        fits = (F.col("root_a") != F.col("root_b")) & (F.col("n_a") <= F.col("n_b")) & (need <= (100 + p) * F.least("left_a", "left_b")) & (100 * F.col("n_a") >= p * F.col("n_b"))
        met = a.where(2 * p * F.col("n_a") <= (100 + p) * F.col("left_a")).join(b, (a["token"] == b["token"]) & fits)
        return met.select(F.col("key_a").alias("a"), F.col("key_b").alias("b"))


def labelled(join: Join) -> DataFrame:
    """(id, key, n, first) for each document with words; first: (null, id, key) of the component's least row.

    Work is done by distinct sets; a set or a component of very many documents is no task of its own.
    """
    _, roots = join.run()
    by_key = join.meta.where("n > 0").groupBy("key").agg(F.min(F.struct(F.col("id").isNull().alias("null"), "id", "key")).alias("first"), F.count(F.lit(1)).alias("q_n"))
    by_key = cut(by_key.join(roots.withColumnRenamed("node", "key"), "key", "left"))
    sweep(join.spark)
    least = by_key.where("root is not null").groupBy("root").agg(F.min("first").alias("first"), F.count(F.lit(1)).alias("q_n"))
    alone = by_key.where("root is null").select("key", "q_n", "first")
    linked = attach(by_key.where("root is not null").select("key", F.col("q_n").alias("docs"), "root"), least, "root").select("key", F.col("docs").alias("q_n"), "first")
    both = cut(alone.unionByName(linked))
    sweep(join.spark)
    return attach(join.meta.where("n > 0"), both, "key")


def groups(docs: DataFrame, width: int = 4, percent: int = 85) -> DataFrame:
    """doc_id, n_shingles, component_id for each row of docs.

    Texts are lower-cased (A-Z) and cut at ASCII white space; a document's set holds its distinct shingles of `width`
    words. Two documents link when 100 * overlap >= percent * union; component_id is the smallest doc_id that links
    reach. No pair that links is missed unless both texts are already in one component. Equal sets are one node,
    however many documents have them. Null and empty texts, and those without words, have no shingle and are by
    themselves. A null doc_id takes part; its component is null only if no document in it has an id. Shingles are
    told apart by hashes of 64 bits. Columns beside doc_id and text are not read; an empty table gives an empty one.
    """
    join = Join(docs, width, percent)
    out = labelled(join).select(F.col("id").alias("doc_id"), F.col("n").cast("long").alias("n_shingles"), F.col("first.id").alias("component_id"))
    return out.unionByName(join.meta.where("n = 0").select(F.col("id").alias("doc_id"), F.col("n").cast("long").alias("n_shingles"), F.col("id").alias("component_id")))


def one_of_each(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """docs with one row of each group of linked documents: that of the smallest doc_id, nulls last.

    What counts is the row, not its id: where an id stands on several texts, each is kept or dropped by its own
    group. Of rows that share the smallest id of a group, one stays, whichever it is if their words are the same.
    Documents without words are in no group and stay, however often they repeat. All columns are kept.
    """
    found = cut(labelled(Join(docs, width, percent)).select("id", "key", (F.col("id").eqNullSafe(F.col("first.id")) & (F.col("key") == F.col("first.key"))).alias("keep")))
    once = found.groupBy("id").agg(F.count(F.lit(1)).alias("n"), F.min("keep").alias("keep"))
    free = (x for i in range(len(docs.columns) + 4) if (x := f"q_{i}") not in docs.columns)
    name, key, mark = next(free), next(free), next(free)
    same = F.col("doc_id").cast("long").eqNullSafe(F.col(name))

    def small(ids: DataFrame) -> DataFrame:
        # so few ids go to every executor; more than that, and both sides are shuffled
        ids = cut(ids)
        return F.broadcast(ids) if ids.count() <= MOST_BROADCAST else ids

    def with_key(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler(width)
        for batch in batches:
            sets = [shingler.set_of(v.as_py()) for v in batch.column(place)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([key_of(s) if len(s) else None for s in sets], pa.int64())], [*batch.schema.names, key])

    place = docs.columns.index("text")
    # ids on one row with words go or stay by themselves; rows of the others are told apart by their sets
    again = small(once.where("n > 1").select(F.col("id").alias(name)))
    gone = small(once.where("n = 1 and not keep").select(F.col("id").alias(name)))
    left = docs.join(gone, same, "left_anti")
    if again.isEmpty():
        return left
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema] + [f"{key} long"])
    rows = mapped(docs.join(again, same, "left_semi"), with_key, schema)
    kept = small(found.where("keep").select(F.col("id").alias(name), F.col("key").alias(mark)).distinct())
    ours = rows.where(F.col(key).isNotNull()).join(kept, same & (F.col(key) == F.col(mark)), "left_semi").dropDuplicates([key])
    return reduce(DataFrame.unionByName, (left.join(again, same, "left_anti"), rows.where(F.col(key).isNull()).drop(key), ours.drop(key)))


def op9_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links between all documents by shingles of four words at 0.85: see groups()."""
    return groups(read(spark, sf_dir, "documents"))
