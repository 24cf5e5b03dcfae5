import numpy as np
from pyspark.sql import functions as F

from quillgraph.llm import language, quality, registry, toxicity
from quillgraph.llm.common import bounded_sample
from quillgraph.llm.zdict import Codec, content

SF = "/root/testdata/sf0.01"


def table(spark, name):
    return spark.read.parquet(f"{SF}/{name}.parquet")


def test_dictionary_content():
    assert content([b"aa", b"bbbbbbbb"], 6) == b"a\nbbbb"[-6:] or len(content([b"aa", b"bbbbbbbb"], 6)) <= 6
    c = Codec(b"the quick brown fox jumps over the lazy dog", 6, 16)
    assert c.size(b"the quick brown fox") < c.size(b"zqxw jvkp mbhg ytre")
    assert c.size(b"") > 0


def test_bounded_sample(spark):
    rows = spark.range(20_000).withColumn("k", F.col("id") % 2)
    got = {r.k: r["count"] for r in bounded_sample(rows, "k", ["id"], 500).groupBy("k").count().collect()}
    assert set(got) == {0, 1} and all(400 < n < 600 for n in got.values())
    assert bounded_sample(rows.limit(10), "k", ["id"], 500).count() == 10


def test_language(spark):
    got = registry.QUERIES["op2_language_id"](spark, SF).join(table(spark, "documents").select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in got if r.held_out]
    assert len(got) == 1000 and np.mean([r.lang_pred == r.lang for r in held]) > 0.96 and all(0 <= r.score <= 1 for r in got)


def test_only_letters_make_a_language(spark):
    d = spark.createDataFrame([(1, "² ½ ① _ 12"), (2, "ª"), (3, "中")], "doc_id long, text string")
    got = {r.doc_id: r.lang_pred for r in language.classify(d, {"fr": b"le chat"}, F.lit(True)).collect()}
    assert got == {1: "und", 2: "fr", 3: "fr"}


def test_excerpts_come_from_all_over_a_text(spark):
    text = "".join(f"part{i:04d} " for i in range(5000))
    d = spark.createDataFrame([(1, text, "en"), (1, text, "en"), (None, "x y", "fr"), (2, "short", "en")], "doc_id long, text string, lang string")
    got = language.fit(d, F.lit(True))
    assert set(got) == {"en", "fr"} and b"short" in got["en"] and len(got["en"]) < 2100 and b"part0000" in got["en"] and b"part44" in got["en"]
    assert sum(map(len, language.fit(d, F.lit(True), all_bytes=100).values())) <= 100
    assert content([b"".join(b"%04d" % i for i in range(5000))], 2048).count(b"00") > 20


def test_language_rejects(spark):
    d = spark.createDataFrame([(1, "12 !!"), (2, None), (3, "xqz"), (4, "le chat et le chien " * 5)], "doc_id long, text string")
    got = {r.doc_id: r for r in language.classify(d, {"fr": b"le chat et le chien le chat", "en": b"the cat and the dog the cat"}, F.lit(True)).collect()}
    assert got[1].lang_pred == got[2].lang_pred == "und" and got[3].rejected and got[4].lang_pred == "fr" and not got[4].rejected


def test_quality(spark):
    got = registry.QUERIES["op6_quality"](spark, SF).join(table(spark, "labels"), "doc_id").collect()
    held = [r for r in got if r.held_out]
    assert np.mean([r.predicted == r.quality for r in held]) > 0.93 and all((r.score >= 0.5) == (r.predicted == 1) for r in got)


def test_quality_line():
    x = np.array([-2.0, -1, 1, 2] * 20)
    slope, shift = quality.line(x, (x > 0).astype(float))
    assert slope > 0 and abs(shift) < 0.2


def made(rng, n):
    words = [f"w{i}" for i in range(200)]
    texts, y = [], []
    for i in range(n):
        w = list(rng.choice(words, 40))
        if i % 3 == 0:
            w[int(rng.integers(0, 40))] = "vile" + str(i % 5)
        texts.append(" ".join(w))
        y.append(int(i % 3 == 0))
    return texts, np.array(y)


def test_toxicity_learns_words_and_their_beginnings():
    rng = np.random.default_rng(0)
    texts, y = made(rng, 400)
    scorer = toxicity.Scorer(toxicity.train(texts, y, ["en"] * 400))
    fresh, truth = made(rng, 90)
    assert np.mean([(scorer.score(t) >= 0.5) == k for t, k in zip(fresh, truth, strict=True)]) > 0.95
    # a word never seen, with a beginning that was
    assert scorer.score("w1 w2 w3 " * 200 + "vile9") > scorer.score("w1 w2 w3 " * 200 + "w4") + 0.2
    assert 0 <= scorer.score(None) < 0.5


def test_long_texts_score_as_one():
    rng = np.random.default_rng(0)
    model = toxicity.train(*made(rng, 200), ["en"] * 200, epochs=2)
    words = [f"w{i % 200}" for i in range(45_000)]
    a = toxicity.Scorer(model)
    g = a.words(words)
    parts, at = [], 0
    for w in toxicity.WIDTHS:
        parts.append([g[:, at + j * toxicity.FILTERS : at + (j + 1) * toxicity.FILTERS] for j in range(w)])
        at += w * toxicity.FILTERS
    whole = float(toxicity.pooled(parts, model.bias) @ model.dense + model.rest)
    assert abs(a.logit(" ".join(words))[0] - whole) < 1e-3


def test_short_texts_train_and_score():
    texts, y = ["vile", "fine day"] * 40, np.array([1, 0] * 40)
    scorer = toxicity.Scorer(toxicity.train(texts, y, ["en"] * 80))
    assert scorer.score("vile") >= 0.5 > scorer.score("fine day") and 0 <= scorer.score("") <= 1


def test_languages_of_their_own():
    """A language with another level of log odds gets another threshold, however many languages there are."""
    rng = np.random.default_rng(1)
    texts, y, langs = [], [], []
    for k in range(30):
        for i in range(24):
            texts.append(" ".join(f"l{k}w{j}" for j in rng.integers(0, 30, 20)) + (" vile" if i % 2 else ""))
            y.append(i % 2), langs.append(f"l{k}")
    model = toxicity.train(texts, np.array(y), langs, epochs=2)
    assert len(model.lines) > 20 and np.isfinite(model.lines).all()


def test_a_rare_language_gets_its_threshold(spark):
    rng = np.random.default_rng(2)
    rows = [(i, " ".join(f"{k}w{j}" for j in rng.integers(0, 30, 20)) + (" vile" if i % 2 else ""), k, i % 2) for i in range(1000) for k in ["rare" if i >= 980 else "en"]]
    docs = spark.createDataFrame([r[:3] for r in rows], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(r[0], r[3]) for r in rows], "doc_id long, toxic int")
    model = toxicity.fit(docs, labels, F.lit(True), per_class=60)
    assert len(model.lines) == 3
    assert [toxicity.Scorer(model).logit(" ".join(f"{k}w{j}" for j in range(20)))[1] for k in ("en", "rare")] == [0, 1]


def test_the_share_of_many_languages(spark):
    n = 40
    docs = spark.range(n * 100).select(F.col("id").alias("doc_id"), F.concat(F.lit("l"), F.col("id") % n).alias("lang"))
    marks = docs.select(F.col("doc_id").alias("id"), (F.col("doc_id") > n * 50).cast("int").alias("y"))
    got = {(r.y, r.l): r["count"] for r in toxicity.by_language(docs, marks, 60, 100).join(docs.select(F.col("doc_id").alias("id"), F.col("lang").alias("l")), "id").groupBy("y", "l").count().collect()}
    assert len(got) == 2 * n and 0.8 * 2 * n * toxicity.FEWEST < sum(got.values()) < 1.2 * 2 * n * toxicity.FEWEST


def test_thresholds():
    slope, shift = toxicity.threshold(np.array([-3.0, -2, 4, 5]), np.array([0, 0, 1, 1]))
    assert slope > 0 and shift == 1.0
    assert toxicity.threshold(np.array([1.0]), np.array([1])) == (1.0, 0.0)


def test_toxicity_query(spark):
    d, labels = table(spark, "documents"), table(spark, "labels")
    got = registry.QUERIES["op4_toxicity"](spark, SF).join(labels, "doc_id").collect()
    held = [r for r in got if r.held_out]
    assert np.mean([r.predicted == r.toxic for r in held]) > 0.85 and d.count() == 1000
