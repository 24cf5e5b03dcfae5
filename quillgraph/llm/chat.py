"""Chat formatting by token-level assembly: segments are encoded apart and joined by reserved ids."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillgraph.llm.common import mapped, partitions, read

# The template's own marks, and marks of other templates, which texts may not show unescaped either.
TURN, TEXT, END = "<|turn|>", "<|text|>", "<|end|>"
CONTROL = (TURN, TEXT, END, "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<|endoftext|>")

#: A backslash, or a control string: what escaping changes.
_MARKED = re.compile("|".join(map(re.escape, ("\\", *CONTROL))))
_ESCAPED = re.compile(r"\\(.)", re.DOTALL)
SEGMENTS = "conv_id long, turn long, ids binary, loss binary"
FORMATTED = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, n_tokens long, n_loss_tokens long"


def escape(text: str) -> str:
    """text without control strings: a backslash stands before each backslash and after a control string's first character."""
    return _MARKED.sub(lambda m: "\\\\" if m[0] == "\\" else m[0][0] + "\\" + m[0][1:], text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


class Codec:
    """A tokenizer's ids and, above its vocabulary, the reserved ids of the template's marks."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self._tokenizer = Tokenizer.from_file(path)
        self._tokenizer.encode_special_tokens = True
        first = self._tokenizer.get_vocab_size(with_added_tokens=True)
        self.reserved = {first: TURN, first + 1: TEXT, first + 2: END}
        self.turn, self.text, self.end = self.reserved

    def encode(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self._tokenizer.encode_batch(texts, add_special_tokens=False)]

    def decode(self, ids: np.ndarray) -> str:
        return self._tokenizer.decode(ids.tolist(), skip_special_tokens=False)


def assemble(parts: list[np.ndarray], learned: int) -> tuple[np.ndarray, np.ndarray]:
    """The parts in a row, and a mask that is 1 on the part of index `learned` (-1: nowhere).

    The parts' borders are the prefix sums of their lengths; the mask is the prefix sum of +1 at the start of the
    learned part and -1 at its end.
    """
    border = np.concatenate([[0], np.cumsum([len(p) for p in parts])])
    step = np.zeros(border[-1] + 1, np.int8)
    if learned >= 0:
        step[border[learned]] += 1
        step[border[learned + 1]] -= 1
    return np.concatenate(parts).astype("<u4"), np.cumsum(step[:-1], dtype=np.int8).astype(np.uint8)


def segments(turns: DataFrame, path: str, learn: str = "assistant") -> DataFrame:
    """conv_id, turn, ids (unsigned 32-bit, little-endian), loss (a byte per id) for each row of turns.

    <|turn|> role <|text|> text <|end|>: the marks are reserved ids, which no text encodes to; role and text are
    escaped and encoded apart. loss is 1 on the text's ids if the role is `learn`. Null role or text: empty.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec(path)
        one = {k: np.array([k]) for k in codec.reserved}
        for batch in batches:
            roles, texts = ([v.as_py() or "" for v in batch.column(i)] for i in (2, 3))
            ids, loss = [], []
            for r, a, b in zip(roles, codec.encode([escape(r) for r in roles]), codec.encode([escape(t) for t in texts]), strict=True):
                x, m = assemble([one[codec.turn], np.array(a, int), one[codec.text], np.array(b, int), one[codec.end]], 3 if r == learn else -1)
                ids.append(x.tobytes()), loss.append(m.tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(ids, pa.binary()), pa.array(loss, pa.binary())], ["conv_id", "turn", "ids", "loss"])

    return mapped(turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.col("role").alias("role"), F.col("text").alias("text")), run, SEGMENTS)


def in_order(rows: DataFrame) -> DataFrame:
    """Segments with the turns of a conversation together and by turn; equal turns by their ids."""
    return rows.repartition(partitions(rows.sparkSession), "conv_id").sortWithinPartitions("conv_id", "turn", "ids")


class Reader:
    """Reads one conversation's ids and mask back, segment after segment, in memory that doesn't grow."""

    def __init__(self, conv_id: int | None):
        self.conv_id, self.turns, self.loss = conv_id, hashlib.sha256(), hashlib.sha256()
        self.n_turns = self.loss_chars = self.chars = self.tokens = self.loss_tokens = 0

    def add(self, codec: Codec, ids: np.ndarray, mask: np.ndarray) -> None:
        marks = np.flatnonzero(ids >= codec.turn)
        if ids[marks].tolist() != [codec.turn, codec.text, codec.end]:
            raise ValueError("a segment is not <|turn|> role <|text|> text <|end|>")
        role, text = (codec.decode(ids[a + 1 : b]) for a, b in zip(marks, marks[1:], strict=False))
        learned = unescape(codec.decode(ids[mask == 1]))
        self.n_turns += 1
        self.chars += len(TURN) + len(role) + len(TEXT) + len(text) + len(END)
        self.turns.update(f"{unescape(role)}\n{unescape(text)}\n".encode("utf-8", "replace"))
        self.loss.update(learned.encode("utf-8", "replace"))
        self.loss_chars += len(learned)
        self.tokens += len(ids)
        self.loss_tokens += int(mask.sum())

    def row(self) -> tuple:
        return self.conv_id, self.n_turns, self.turns.hexdigest(), self.loss_chars, self.loss.hexdigest(), self.chars, self.tokens, self.loss_tokens


def read_back(ordered: DataFrame, path: str) -> DataFrame:
    """One row per conversation with what its formatted ids say. `ordered` comes from in_order().

    A conversation is streamed turn by turn, however long it is. A null conv_id is one conversation. No rows: none.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec, at, done = Codec(path), None, []

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_pylist([dict(zip(names, r, strict=True)) for r in done], schema=schema)

        names = [c.split()[0] for c in FORMATTED.split(", ")]
        schema = pa.schema([(c.split()[0], pa.string() if c.endswith("string") else pa.int64()) for c in FORMATTED.split(", ")])
        for batch in batches:
            for conv, ids, mask in zip(*(batch.column(i).to_pylist() for i in (0, 2, 3)), strict=True):
                if at is None or at.conv_id != conv:
                    if at is not None:
                        done.append(at.row())
                    at = Reader(conv)
                at.add(codec, np.frombuffer(ids, "<u4"), np.frombuffer(mask, np.uint8))
            if done:
                yield out()
                done = []
        if at is not None:
            done.append(at.row())
            yield out()

    return mapped(ordered, run, FORMATTED)


def op7_chat_format(spark: SparkSession, sf_dir: str, path: str | None = None) -> DataFrame:
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("byte_bpe_50k.json")
    said = "</s>[INST] ok [/INST]"
    more = spark.createDataFrame([(-1, 0, "user", said), (-1, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    turns = read(spark, sf_dir, "conversations").select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text").unionByName(more)
    return read_back(in_order(segments(turns, path)), path)
