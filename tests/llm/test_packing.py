import zlib

import numpy as np
import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from quillgraph.llm import packing

PATH = public_tokenizers.path("byte_bpe_50k.json")
ENCODER, TOKENIZER = packing.Encoder(PATH), Tokenizer.from_file(PATH)
TOKENIZER.encode_special_tokens = True


def ids(text):
    return TOKENIZER.encode(text, add_special_tokens=False).ids


PARTS = ["a", "B", "é", " ", "  ", "\n", "\n\n", "\t", "'s", "'", "12", "½", "!?", "中文", "\xa0", "_", "the", "́", "\r\n", "\x1c", "<|endoftext|>", "\0", "🙂", "Ⅷ", "don't"]


@settings(max_examples=2000, deadline=None)
@given(st.lists(st.sampled_from(PARTS), max_size=12).map("".join) | st.text(max_size=20))
def test_ids_are_the_tokenizers(text):
    assert np.frombuffer(ENCODER.encode(text), "<u4").tolist() == ids(text)


DEFAULT, READER = Tokenizer.from_file(PATH), packing.Encoder(PATH, added=True)


@settings(max_examples=2000, deadline=None)
@given(st.lists(st.sampled_from([*PARTS, "<|endoftext|>", "<|endoftext", "|>"]), max_size=12).map("".join) | st.text(max_size=20))
def test_added_tokens_are_read_as_the_tokenizer_does_by_default(text):
    assert np.frombuffer(READER.encode(text), "<u4").tolist() == DEFAULT.encode(text, add_special_tokens=False).ids


def test_pieces_read_added_tokens(spark):
    text = "a <|endoftext|> b"
    [r] = packing.pieces(spark.createDataFrame([(1, text)], "doc_id long, text string"), PATH).collect()
    want = [*DEFAULT.encode(text, add_special_tokens=False).ids, 0]
    assert want == [64, 220, 50256, 275, 0] and (r.length, r.ids_crc32) == (5, zlib.crc32(np.array(want, "<u4").tobytes()))


def test_long_runs_of_white_space():
    for text in (" " * 1_200_000 + "a", "\n" * 1_200_000 + "b", "a" + "\t" * 1_200_000 + "<|endoftext|>"):
        assert np.frombuffer(READER.encode(text), "<u4").tolist() == DEFAULT.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(ENCODER.encode(text), "<u4").tolist() == ids(text)


def test_one_long_word():
    text = "ab" * 20_000
    assert np.frombuffer(ENCODER.encode(text), "<u4").tolist() == ids(text)


@settings(max_examples=150, deadline=None)
@given(st.dictionaries(st.integers(1, 64), st.integers(1, 40), max_size=20))
def test_runs_fit(counts):
    runs = packing.best_fit(counts, 64)
    got = {}
    filled = {}
    for n, first, k, seq, offset in runs.tolist():
        got[n] = got.get(n, 0) + k
        for i in range(k):
            filled.setdefault(seq + i, []).append((offset, n))
    assert got == counts
    for parts in filled.values():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at
            at += n
        assert at <= 64
    # first-fit decreasing never needs more than 11/9 of the fewest plus one
    total = sum(n * c for n, c in counts.items())
    assert len(filled) <= 11 / 9 * max(-(-total // 64), sum(c for n, c in counts.items() if n > 32)) * 1.4 + 1
    assert sorted(filled) == list(range(len(filled)))


def test_query(spark):
    sf = "/root/testdata/sf0.001"
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = packing.op10_best_fit(spark, sf).collect()
    by_doc, by_seq = {}, {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_seq.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert set(by_doc) == set(docs)
    for doc, parts in by_doc.items():
        want, at = np.array([*ids(docs[doc]), 0], "<u4"), 0
        for k, r in enumerate(sorted(parts, key=lambda r: r.piece)):
            assert (r.piece, r.start) == (k, at) and r.ids_crc32 == zlib.crc32(want[at : at + r.length].tobytes())
            assert k == 0 or r.length == 2048
            at += r.length
        assert at == len(want) and (len(parts) == 1 or len(want) > 2048)
    for parts in by_seq.values():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at
            at += n
        assert at <= 2048
    assert len(by_seq) <= -(-sum(r.length for r in rows) // 2048) * 1.02 + 1
