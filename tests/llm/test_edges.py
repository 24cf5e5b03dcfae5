"""Every operator on nulls, empty and long texts, ties, repeated rows, empty tables and clashing extra columns."""

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from quillgraph.llm import chat, fingerprints, jaccard, language, media, mixing, packing, pii, quality, toxicity

LONG = "a long text of many words, mail x.y@mail.example.com and 10.0.0.1; " * 3000
ROWS = [
    (1, "one two three four five six", "en", "s", 7), (1, "one two three four five six", "en", "s", 7), (1, "another text with the same id here", "en", "t", 7), (None, "no id at all but words enough", None, None, None),
    (4, None, "en", "s", None), (5, "", "fr", "", 0), (6, " \n\t ", "de", "s", 3), (7, LONG, "en", "s", len(LONG)), (8, "été über ñandú 中文 🙂", "fr", "s", 5), (9, "0", "en", None, 1), (10, "\u0000 null byte", "en", "s", 3),
]
EXTRA = ("score", "size", "key", "n", "root", "bucket", "q_id", "copies", "piece", "start", "rejected", "bits")


def docs(spark, rows=ROWS):
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    return df.withColumns({c: F.lit("clash") for c in EXTRA})


def held():
    return F.lit(False)


def tokenizer():
    return public_tokenizers.path("byte_bpe_50k.json")


OPERATORS = {
    "media": lambda d: media.media(d),
    "language": lambda d: language.classify(d, {"en": b"one two three the text", "fr": "été le la".encode()}, held()),
    "language without dictionaries": lambda d: language.classify(d, {}, held()),
    "pii": lambda d: pii.find(d, pii.Net.fresh(np.random.default_rng(1)).p),
    "toxicity": lambda d: toxicity.classify(d, toxicity.train(["bad word here now", "good word here now"] * 30, np.array([1, 0] * 30), ["en"] * 60, epochs=1), held()),
    "quality": lambda d: quality.classify(d, quality.Model(b"one two three", b"### $$$ ###", 100.0, 0.0), held()),
    "fingerprints": lambda d: fingerprints.fingerprint(d),
    "mixing": lambda d: mixing.plan(d),
    "jaccard": lambda d: jaccard.groups(d),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_one_row_each(spark, name):
    got = OPERATORS[name](docs(spark)).collect()
    assert sorted((r.doc_id is None, r.doc_id) for r in got) == sorted((r[0] is None, r[0]) for r in ROWS)


@pytest.mark.parametrize("name", [*OPERATORS, "packing", "mix", "redact", "one_of_each", "keep_clean"])
def test_empty_table(spark, name):
    d = docs(spark, [])
    more = {"packing": lambda: packing.pack(d, tokenizer()), "mix": lambda: mixing.mix(d), "redact": lambda: pii.redact(d, pii.train([], [])), "one_of_each": lambda: jaccard.one_of_each(d), "keep_clean": lambda: toxicity.keep_clean(d, toxicity.fit(d, spark.createDataFrame([], "doc_id long, toxic int"), F.lit(True)))}
    assert (more[name]() if name in more else OPERATORS[name](d)).count() == 0


def test_rows_with_their_columns(spark):
    d = docs(spark)
    for out in (mixing.mix(d), pii.redact(d, pii.train([], [])), jaccard.one_of_each(d), toxicity.keep_clean(d, toxicity.fit(d, spark.createDataFrame([], "doc_id long, toxic int"), F.lit(True)))):
        assert out.columns == d.columns and set(r.key for r in out.collect()) <= {"clash"}


def test_untrained_fits(spark):
    d, none = docs(spark), spark.createDataFrame([(1, 1), (2, None)], "doc_id long, toxic int").withColumn("quality", F.col("toxic"))
    assert language.fit(d.where("false"), F.lit(True)) == {}
    assert {r.score for r in quality.classify(d, quality.fit(d, none, F.lit(True)), held()).collect()} == {0.5}
    assert {r.predicted for r in toxicity.classify(d, toxicity.fit(d, none, F.lit(True)), held()).collect()} == {0}


def test_packing(spark):
    got = packing.pack(docs(spark), tokenizer()).collect()
    assert {r.doc_id for r in got} == {r[0] for r in ROWS} and sum(r.piece == 0 for r in got) == len(ROWS)


def test_repeated_rows(spark):
    got = [r for r in jaccard.groups(docs(spark)).collect() if r.doc_id == 1]
    assert sorted((r.n_shingles, r.component_id) for r in got) == [(3, 1), (3, 1), (4, 1)]
    kept = jaccard.one_of_each(docs(spark)).where("doc_id = 1").collect()
    assert len(kept) == 2
    copies = {r.doc_id: 0 for r in mixing.plan(docs(spark)).collect()}
    assert len(copies) == 9


RUNS = {c: c * 2_000_000 for c in ("a", "0", ".", "@", "+", " ", "\n", "é")} | {"1.": "1." * 1_000_000, "a ": "a " * 1_000_000, "0.": "0" * 5000 + ".1.1.1"}


@pytest.mark.parametrize("run", RUNS)
def test_very_long_runs(spark, run):
    """Two million characters of one kind, alone and before other text."""
    for text in (RUNS[run], RUNS[run] + "b"):
        assert len(packing.Encoder(tokenizer(), True).encode(text)) % 4 == 0
        pii.all_spans([text], pii.Net.fresh(np.random.default_rng(1)) if len(run) > 1 and len(text) < 10_000 else Silent())
        assert len(jaccard.Shingler(4).set_of(text)) <= 5
        assert 0 <= toxicity.Scorer(toxicity.train(["bad word", "good word"] * 8, np.array([1, 0] * 8), ["en"] * 16, epochs=1)).score(text) <= 1
    rows = [(1, text, "en", "s", 1)]
    assert language.classify(docs(spark, rows), {"en": b"one two", "fr": b"un deux"}, held()).count() == 1
    assert quality.classify(docs(spark, rows), quality.Model(b"one two three", b"### $$$", 100.0, 0.0), held()).count() == 1


class Silent(pii.Net):
    """A network that looks at no window: the others of its kind would take minutes here."""

    def __init__(self):
        super().__init__({})

    def decode(self, ids):
        return np.zeros(ids.shape, int), np.ones(ids.shape)


def test_chat(spark):
    rows = [(1, 0, "user", "a"), (1, 0, "user", "a"), (1, 1, "assistant", None), (None, 0, None, "x"), (2, None, "assistant", "</s>"), (3, 0, "assistant", "y" * 50_000)]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("ids", F.lit("clash"))
    got = {r.conv_id: r for r in chat.read_back(chat.in_order(chat.segments(turns, tokenizer())), tokenizer()).collect()}
    assert {k: r.n_turns for k, r in got.items()} == {1: 3, None: 1, 2: 1, 3: 1} and got[3].loss_chars == 50_000 and got[1].loss_chars == 0
    assert chat.read_back(chat.in_order(chat.segments(turns.where("false"), tokenizer())), tokenizer()).count() == 0
