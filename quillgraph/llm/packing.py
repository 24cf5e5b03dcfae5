"""Best-fit packing of tokenized documents into sequences of a fixed length."""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillgraph.llm.common import cut, mapped, read

LENGTH = 2048
#: Pieces of one length are ranked in so many groups by a hash, so that no length gathers in one task.
GROUPS = 64
PIECES = "doc_id long, piece int, start long, length int, ids_crc32 long"

#: Fixed value: how the byte-level BPE cuts a text before it merges bytes.
PRE_TOKENS = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


class Encoder:
    """Ids of texts by the byte-level BPE in a tokenizer.json.

    The ids of such a vocabulary are the ranks of its merges, so tiktoken gives the same ids from them in a fifth of
    the time; the tests hold both against each other. tiktoken refuses runs of white space beyond what its patterns
    can track back (about a million); such a text is left to tokenizers itself. `added`: the file's added tokens are
    read in a text, as tokenizers does by default; else their characters are encoded like any others.
    """

    def __init__(self, path: str, added: bool = False):
        import tiktoken

        self._path, self._added, self._slow = path, added, None
        with open(path, encoding="utf-8") as f:
            stored = json.load(f)
        tokens = stored.get("added_tokens", ())
        ids = {t["content"]: t["id"] for t in tokens}
        if added and any(t[k] for t in tokens for k in ("single_word", "lstrip", "rstrip")):
            raise ValueError("added tokens that depend on what stands around them aren't supported")
        # the file writes a byte as itself where that is a visible character, else as one of those from 256 on
        shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
        byte = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(sorted(set(range(256)) - set(shown)))}
        ranks = {bytes(byte[c] for c in t): i for t, i in stored["model"]["vocab"].items() if t not in ids}
        self._encode = tiktoken.Encoding("bytes", pat_str=PRE_TOKENS, mergeable_ranks=ranks, special_tokens=ids if added else {}).encode_to_numpy

    def encode(self, text: str) -> bytes:
        """Little-endian unsigned 32-bit ids."""
        if not text:
            return b""
        try:
            return self._encode(text, allowed_special="all", disallowed_special=()).astype("<u4", copy=False).tobytes()
        except ValueError:
            if self._slow is None:
                from tokenizers import Tokenizer

                self._slow = Tokenizer.from_file(self._path)
                self._slow.encode_special_tokens = not self._added
            return np.array(self._slow.encode(text, add_special_tokens=False).ids, "<u4").tobytes()


def pieces(docs: DataFrame, path: str, length: int = LENGTH, end: int = 0) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32: each document's ids and the id `end`, cut into pieces if longer than `length`.

    Added tokens in a text become their ids. Only the first piece of a cut document may be shorter. Null text counts as empty: one piece with `end` alone.
    """
    tail = np.array([end], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(path, added=True)
        for batch in batches:
            out: list[tuple] = []
            for doc, value in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = encoder.encode(value.as_py() or "") + tail
                n = len(ids) // 4
                starts = [0, *range(n % length or length, n, length)]
                for k, (a, b) in enumerate(zip(starts, [*starts[1:], n], strict=True)):
                    out.append((doc, k, a, b - a, zlib.crc32(ids[4 * a : 4 * b])))
            cols = list(zip(*out, strict=True)) or [[]] * 5
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return mapped(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").alias("text")), run, PIECES)


def best_fit(counts: dict[int, int], room: int = LENGTH) -> np.ndarray:
    """Where the documents of each length go: rows (length, first rank, documents, first sequence, offset).

    Bulk-synchronous best fit over sorted runs: a run of documents is all of one length, a run of gaps is consecutive
    sequences filled equally far. In a superstep every run of waiting documents that is at least half as long as the
    longest sweeps up the sorted gaps to its successor, the smallest gap that holds it; where runs meet at one gap the
    longer documents come first, and each takes as many of its sequences as it has documents; gaps shrink and are
    sorted anew. When no gap holds the longest waiting documents, they open new sequences. There are at most `room`
    runs of documents, whatever the corpus holds, and every step ends a run or a gap.
    """
    left = {n: c for n, c in counts.items() if c > 0}
    taken = dict.fromkeys(left, 0)
    gaps: list[tuple[int, int, int]] = []  # room left, first sequence, sequences; sorted
    opened, out = 0, []
    while left:
        longest = max(left)
        sizes = np.array([g[0] for g in gaps], dtype=np.int64)
        asked: dict[int, list[int]] = {}
        for n in sorted((n for n in left if 2 * n >= longest), reverse=True):
            at = int(np.searchsorted(sizes, n))
            if at < len(gaps):
                asked.setdefault(at, []).append(n)
        if longest not in {n for ns in asked.values() for n in ns}:
            # as many sequences as the longest ones fill by themselves
            each = room // longest
            new = -(-left[longest] // each)
            gaps.append((room, opened, new))
            gaps.sort()
            opened += new
            continue
        kept = [g for i, g in enumerate(gaps) if i not in asked]
        for i, ns in asked.items():
            free, first, many = gaps[i]
            for n in ns:
                k = min(left[n], many)
                if k:
                    out.append((n, taken[n], k, first, room - free))
                    kept.append((free - n, first, k))
                    taken[n] += k
                    left[n] -= k
                    first, many = first + k, many - k
                    if not left[n]:
                        del left[n]
            if many:
                kept.append((free, first, many))
        gaps = sorted(g for g in kept if g[0] > 0)
    return np.array(out, dtype=np.int64).reshape(-1, 5)


def place(parts: DataFrame, length: int = LENGTH) -> DataFrame:
    """parts with sequence_id and offset.

    Documents are sorted and ranked by length in a distributed prefix sum over (length, group); the counts by length
    (at most `length` of them) give the runs that best_fit() places; each document finds its run by its rank.
    """
    parts = cut(parts).withColumn("q_group", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(GROUPS)).cast("int"))
    # at most length * GROUPS rows
    sizes = parts.groupBy("length", "q_group").agg(F.count(F.lit(1)).alias("n")).orderBy("length", "q_group").toArrow()
    size, group, n = (sizes.column(c).to_numpy().astype(np.int64) for c in ("length", "q_group", "n"))
    first = np.searchsorted(size, size)
    total = np.concatenate([[0], np.cumsum(n)])
    before = total[:-1] - total[first]
    every, last = np.unique(size, return_index=True)
    runs = best_fit(dict(zip(every.tolist(), np.add.reduceat(n, last).tolist() if len(n) else [], strict=True)), length)
    runs = runs[np.lexsort((runs[:, 1], runs[:, 0]))]
    shared = parts.sparkSession.sparkContext.broadcast((size * GROUPS + group, before, runs))
    ranked = parts.withColumn("q_rank", F.row_number().over(Window.partitionBy("length", "q_group").orderBy("doc_id", "piece", "start", "ids_crc32")) - 1)
    names = [x for x in parts.columns if x != "q_group"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, before, table = shared.value
        wide = 1 << 44
        starts = table[:, 0] * wide + table[:, 1]
        for batch in batches:
            size, group, rank = (batch.column(c).to_numpy().astype(np.int64) for c in ("length", "q_group", "q_rank"))
            rank = rank + before[np.searchsorted(keys, size * GROUPS + group)]
            at = np.searchsorted(starts, size * wide + rank, side="right") - 1
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(table[at, 3] + rank - table[at, 1]), pa.array(table[at, 4])], [*names, "sequence_id", "offset"])

    schema = ", ".join(f"{c} {dict(parts.dtypes)[c]}" for c in names) + ", sequence_id bigint, offset bigint"
    return mapped(ranked.select(*names, "q_group", "q_rank"), run, schema)


def pack(docs: DataFrame, path: str | None = None, length: int = LENGTH) -> DataFrame:
    """One row per piece with its sequence and its offset there; see pieces() and place().

    Repeated rows of docs are packed each by itself; null ids are kept; an empty table gives an empty one; columns
    beside doc_id and text are not read.
    """
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("byte_bpe_50k.json")
    packed = place(pieces(docs, path, length), length)
    return packed.select("doc_id", "piece", "start", F.col("length").cast("long").alias("length"), "ids_crc32", "sequence_id", "offset")


def op10_best_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of 2048 tokens: see pack()."""
    return pack(read(spark, sf_dir, "documents"))
