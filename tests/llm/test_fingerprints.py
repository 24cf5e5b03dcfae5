import collections
import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from quillgraph.llm import fingerprints as fp


def made(n, seed=0):
    rng = random.Random(seed)
    words = [f"word{i}" for i in range(400)]
    return [(i * 3, " ".join(words[min(399, int(rng.expovariate(0.01)))] for _ in range(rng.randint(5, 200)))) for i in range(n)]


def frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string")


def test_edited_texts(spark):
    rows = [*made(50), (7, ""), (8, "x"), (1000, None), (-5, "first é🙂 text")]
    got = {r.doc_id: r for r in fp.fingerprint(frame(spark, rows)).collect()}
    order = sorted((i, t or "") for i, t in rows)
    for k, (i, t) in enumerate(order):
        nxt, n = order[(k + 1) % len(order)][1], len(t)
        want = t[: n - n // 2] + nxt[: n // 2]
        assert got[i].n_chars == n and got[i].edited_sha256 == hashlib.sha256(want.encode()).hexdigest()


def test_single_document_is_its_own_next(spark):
    r = fp.fingerprint(frame(spark, [(1, "abcdef")])).first()
    assert r.edited_sha256 == hashlib.sha256(b"abcabc").hexdigest() and r.near_next == 1.0


def test_equal_texts_have_equal_fingerprints(spark):
    rows = made(60)
    rows += [(500, rows[3][1]), (501, rows[3][1])]
    got = {r.doc_id: r for r in fp.fingerprint(frame(spark, rows)).collect()}
    assert got[500].fingerprint == got[501].fingerprint == got[rows[3][0]].fingerprint and got[500].near_next == 1.0
    assert all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in got.values())
    assert sum(r.near_edited for r in got.values()) > 2 * sum(r.near_next for r in got.values() if r.doc_id < 500)


def test_lexicon_counts_all_documents(spark):
    rows = frame(spark, [(i, f"common w{i % 10} u{i}") for i in range(100)])
    lists = fp.lexicon(rows, "text", 0.05, 0.5).first().lists
    assert len(lists) == fp.LISTS and all(h % fp.LISTS == at for at, x in enumerate(lists) for h in x)
    want = {r.h for r in spark.createDataFrame([(f"w{i}",) for i in range(10)], "w string").select(F.xxhash64("w").alias("h")).collect()}
    assert sorted(h for x in lists for h in x) == sorted(want)


def brute(spark, rows, least=fp.LEAST, most=fp.MOST):
    """fingerprint, edited_fingerprint, near_edited, near_next of documents of different ids, in plain Python."""
    term = re.compile(r"[^\W_]+")
    docs = sorted((i, t or "") for i, t in rows)
    edited = [t[: len(t) - len(t) // 2] + docs[(k + 1) % len(docs)][1][: len(t) // 2] for k, (_, t) in enumerate(docs)]
    sets = [[set(term.findall(t.lower())) for t in texts] for texts in ([t for _, t in docs], edited)]
    names = sorted(set().union(*sets[0], *sets[1]))
    number = {r.w: r.h for r in spark.createDataFrame([(x,) for x in names], "w string").select("w", F.xxhash64("w").alias("h")).collect()}
    count = collections.Counter(x for s in sets[0] for x in s)
    band = {x for x, n in count.items() if n >= 2 and least * len(docs) <= n <= max(2, most * len(docs))}
    subsets = [(deep, j) for deep, n in enumerate(fp.LEVELS) for j in range(n)] + [(len(fp.LEVELS), j) for j in range(4 * fp.FINER)]

    def part(h, deep):
        """Two bits for each cut, the first cut's highest."""
        j = 0
        for k in range(deep):
            j = j * 4 + (h >> (20 + 2 * k) & 3)
        return j

    hashed = {}

    def parts(s):
        known = sorted(number[x] for x in s & band)
        return [tuple(h for h in known if part(h % 2**64, deep) == j) for deep, j in subsets], tuple(sorted(number[x] for x in s)) if not known else None

    both = [[parts(s) for s in side] for side in sets]
    lists = sorted({p for side in both for ps, rest in side for p in [*ps, rest] if p})
    for r in spark.createDataFrame([(list(p),) for p in lists], "p array<bigint>").select("p", F.xxhash64("p").alias("h")).collect():
        hashed[tuple(r.p)] = r.h
    empty = spark.range(1).select(F.xxhash64(F.array().cast("array<bigint>"))).first()[0]

    def text(m):
        ps, rest = m
        return ":".join(format(hashed[p] & 0xFFFFFFFF, "x") if p else "." for p in ps) if rest is None else "all:" + format((hashed[rest] if rest else empty) % 2**64, "x")

    def like(a, b):
        some = [(x, y) for x, y in zip(a[0], b[0], strict=True) if x or y]
        return sum(x == y for x, y in some) / len(some) if some else float(a[1] == b[1])

    return {docs[k][0]: (text(both[0][k]), text(both[1][k]), like(both[0][k], both[1][k]), like(both[0][k], both[0][(k + 1) % len(docs)])) for k in range(len(docs))}


@pytest.mark.parametrize("case", ["made", "documents"])
def test_equals_brute_force(spark, case):
    if case == "made":
        rows, band = [*made(70), (7, ""), (8, "x"), (1000, None), (-5, "First é🙂 text word1 word1")], (0.02, 0.6)
        rows += [(2000 + i, rows[3][1]) for i in range(3)]
    else:
        rows, band = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()], (fp.LEAST, fp.MOST)
    got = fp.fingerprint(frame(spark, rows), *band).collect()
    assert {r.doc_id: (r.fingerprint, r.edited_fingerprint, r.near_edited, r.near_next) for r in got} == brute(spark, rows, *band)


def test_every_lexicon_term_counts(spark):
    """Texts that differ in one term of the lexicon differ in their fingerprints, whichever term it is."""
    words = [f"term{i}" for i in range(120)]
    rows = [(i, " ".join(words)) for i in range(2)] + [(10 + i, " ".join(w for w in words if w != words[i])) for i in range(120)]
    got = {r.doc_id: r.fingerprint for r in fp.fingerprint(frame(spark, rows), 0.0, 1.0).collect()}
    assert len(set(got.values())) == 121


def test_a_repeated_id_is_dealt_out(spark):
    rows = [(None, f"text number {i} with words") for i in range(300)] + [(5, f"other {i} text") for i in range(300)] + [(i, f"w{i} x") for i in range(10, 20)]
    at = fp.with_next(frame(spark, rows), 16).cache()
    sizes = [r["count"] for r in at.where("not guest").groupBy("bucket").count().collect()]
    assert sum(sizes) == len(rows) and max(sizes) < 150 and at.where("guest").count() == len(sizes)
    order = [r.q_text for r in at.where("not guest").orderBy("q_key", "q_tie").collect()]
    got = {r.edited_sha256 for r in fp.fingerprint(frame(spark, rows)).collect()}
    want = {hashlib.sha256((t[: len(t) - len(t) // 2] + order[(k + 1) % len(order)][: len(t) // 2]).encode()).hexdigest() for k, t in enumerate(order)}
    assert got == want


def test_without_lexicon_terms(spark):
    got = {r.doc_id: r for r in fp.fingerprint(frame(spark, [(1, "one two"), (2, "two one one"), (3, "other")])).collect()}
    assert got[3].fingerprint.startswith("all:")


def test_main_path_has_no_python(spark):
    plan = fp.fingerprint(frame(spark, made(5)))._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "Arrow"))
