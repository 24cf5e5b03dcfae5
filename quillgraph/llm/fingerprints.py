"""I-Match document fingerprints, in DataFrame operations alone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillgraph.llm.common import partitions, read

#: A term is in the lexicon if at least LEAST and at most MOST of the documents hold it (and at least two do).
LEAST, MOST = 0.002, 0.2
#: Lists that the lexicon's terms are kept in, to look a term up by its hash.
LISTS = 1 << 15
#: Randomised subsets of the lexicon: the terms are cut at random into so many parts, each level cutting the parts of the one before.
LEVELS = (1, 4, 16, 64)
#: Parts of the last level that are cut once more, into four each, to tell long texts apart; of the rest the last level has all.
FINER = 8
NOT_TERM = r"[^\p{L}\p{N}]+"


def terms(text: Column) -> Column:
    """Hashes (64 bits) of the distinct terms of a text: runs of letters and digits in lower case. Sorted."""
    words = F.array_distinct(F.split(F.lower(text), NOT_TERM))
    return F.array_sort(F.transform(F.filter(words, lambda w: w != ""), lambda w: F.xxhash64(w)))


def lexicon(docs: DataFrame, text: str, least: float = LEAST, most: float = MOST) -> DataFrame:
    """One row, one column `lists`: LISTS lists of the hashes of the terms within the band, a term in the list of its remainder.

    Document frequencies count over all documents, term by term. Each lexicon term is held by at least `least` of the
    documents, so there are at most (mean number of distinct terms in a document) / least of them, however large the
    corpus is: some 10^5 hashes of eight bytes.
    """
    n = docs.agg(F.count(F.lit(1)).alias("n")).select(F.col("n").cast("double"))
    held = docs.select(F.explode(terms(F.col(text))).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("n"))
    kept = held.withColumn("all", n.scalar()).where((F.col("n") >= 2) & (F.col("n") >= least * F.col("all")) & (F.col("n") <= F.greatest(F.lit(2.0), most * F.col("all"))))
    found = kept.groupBy(F.pmod("term", F.lit(LISTS)).cast("int").alias("at")).agg(F.array_sort(F.collect_list("term")).alias("x"))
    every = docs.sparkSession.range(LISTS).select(F.col("id").cast("int").alias("at"))
    ordered = every.join(found, "at", "left").agg(F.array_sort(F.collect_list(F.struct("at", F.coalesce("x", F.array().cast("array<bigint>")).alias("x")))).alias("y"))
    return ordered.select(F.transform("y", lambda p: p["x"]).alias("lists"))


def marks(own: Column, lists: Column) -> Column:
    """Hashes of the lexicon terms of a document that fall into each subset, sorted; null where none does.

    A document without any lexicon term has one more hash instead, of all its terms, sorted.
    """
    known = F.filter(own, lambda h: F.array_contains(F.element_at(lists, (F.pmod(h, F.lit(LISTS)) + 1).cast("int")), h))
    return F.transform(F.array(known), lambda k: F.struct(_subsets(k).alias("parts"), F.when(F.size(k) == 0, F.xxhash64(own)).alias("rest")))[0]


def _cut(parts: Column, shift: int) -> Column:
    """Each part in four, by two bits of the terms' hashes; a term is looked at once for each of the four."""
    four = F.array(*(F.lit(j) for j in range(4)))
    return F.flatten(F.transform(parts, lambda p: F.transform(four, lambda j: F.filter(p, lambda h: F.shiftrightunsigned(h, shift).bitwiseAND(F.lit(3)) == j))))


def _subsets(known: Column) -> Column:
    """Levels are cut from each other, so the work for a level is the same however many parts it has."""

    def hashed(parts: Column) -> Column:
        return F.transform(parts, lambda p: F.when(F.size(p) > 0, F.xxhash64(p)))

    def levels(parts: Column, deep: int) -> Column:
        # bits above those that choose a list
        nxt = _cut(parts, 20 + 2 * deep)
        if deep == len(LEVELS) - 1:
            return F.concat(hashed(parts), F.flatten(F.transform(F.array(_cut(F.slice(parts, 1, FINER), 20 + 2 * deep)), hashed)))
        return F.concat(hashed(parts), F.flatten(F.transform(F.array(nxt), lambda p: levels(p, deep + 1))))

    return levels(F.array(known), 0)


def written(m: Column) -> Column:
    """A fingerprint as text: hexadecimal hashes (their lower 32 bits), a dot for an empty subset; `all:` and one hash without lexicon terms."""
    parts = F.transform(m["parts"], lambda h: F.coalesce(F.lower(F.hex(h.bitwiseAND(F.lit(0xFFFFFFFF)))), F.lit(".")))
    return F.when(m["rest"].isNull(), F.array_join(parts, ":")).otherwise(F.concat(F.lit("all:"), F.lower(F.hex(m["rest"]))))


def likeness(a: Column, b: Column) -> Column:
    """The share of equal hashes among the subsets that either document has terms in; without any, whether all terms agree."""
    pairs = F.arrays_zip(a["parts"].alias("l"), b["parts"].alias("r"))
    same = F.size(F.filter(pairs, lambda p: p["l"] == p["r"])).cast("double")
    some = F.size(F.filter(pairs, lambda p: p["l"].isNotNull() | p["r"].isNotNull()))
    return F.when(some > 0, same / some).otherwise(F.coalesce(a["rest"] == b["rest"], F.lit(False)).cast("double"))


def with_next(docs: DataFrame, buckets: int) -> DataFrame:
    """Columns q_id, q_text of docs (null text: empty) with bucket, guest and the order (q_key, q_tie) within the bucket.

    Documents stand by id, null ids first, and those of one id by a hash of their text. Buckets are ranges of that
    order, at quantiles of all ids; an id that holds several quantiles is cut within, by ranges of the hash, so that
    a repeated or null id is no task of its own. The first document of the next bucket that has any is in each bucket
    a second time, as its guest; the last bucket's guest is the first document of all. So every document has the next
    one in its own bucket.
    """
    key = F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63)))
    rows = docs.select(F.col("doc_id").cast("long").alias("q_id"), key.alias("q_key"), F.coalesce(F.col("text"), F.lit("")).alias("q_text"))
    ids = rows.agg(F.percentile_approx("q_key", [i / buckets for i in range(1, buckets)], 10_000)).first()[0] or []
    rows = rows.withColumn("q_tie", F.xxhash64("q_text"))
    # a row is beyond a cut (id, hash) if its id is larger, or equal and its hash larger
    cuts = [(k, -(1 << 63) + ((i + 1) << 64) // ids.count(k) - 1) for k in sorted(set(ids)) for i in range(ids.count(k))]
    table = F.array(*(F.struct(F.lit(int(k)).cast("bigint").alias("k"), F.lit(int(h)).cast("bigint").alias("h")) for k, h in cuts))
    at = F.size(F.filter(table, lambda c: (c["k"] < F.col("q_key")) | ((c["k"] == F.col("q_key")) & (c["h"] < F.col("q_tie"))))) if cuts else F.lit(0)
    rows = rows.withColumn("bucket", at)
    first = rows.groupBy("bucket").agg(F.min(F.struct("q_key", "q_tie")).alias("first"))
    # one row for each bucket
    w = Window.partitionBy(F.lit(1)).orderBy("bucket")
    calls = first.select("bucket", F.coalesce(F.lead("first").over(w), F.min("first").over(Window.partitionBy(F.lit(1)))).alias("first")).select("bucket", "first.*")
    guests = rows.drop("bucket").join(F.broadcast(calls), ["q_key", "q_tie"]).dropDuplicates(["bucket"]).withColumn("guest", F.lit(True))
    return rows.withColumn("guest", F.lit(False)).unionByName(guests)


def fingerprint(docs: DataFrame, least: float = LEAST, most: float = MOST) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next for each row of docs.

    The edited text is the text with its second half replaced by the beginning of the next document's. Texts cross
    the network once, by bucket; all later steps keep to that. Null text counts as empty; an empty text has no terms
    and the fingerprint of none. Repeated rows follow each other, so each has an equal next one; rows equal in id and
    text share a bucket. Columns beside doc_id and text are not read; an empty table gives an empty one; a single
    document is its own next one.
    """
    n = partitions(docs.sparkSession)
    lists = lexicon(docs.select(F.coalesce(F.col("text"), F.lit("")).alias("q_text")), "q_text", least, most)
    w = Window.partitionBy("bucket").orderBy("guest", "q_key", "q_tie")
    rows = with_next(docs, 4 * n).repartition(n, "bucket")
    rows = rows.withColumn("q_next", F.coalesce(F.lead("q_text").over(w), F.lit(""))).withColumn("n_chars", F.char_length("q_text").cast("long"))
    half = F.expr("cast(n_chars div 2 as int)")
    order = ["q_id", "q_key", "q_tie", "bucket", "guest", "n_chars"]
    rows = rows.withColumn("q_edited", F.concat(F.expr("substring(q_text, 1, cast(n_chars - n_chars div 2 as int))"), F.substring(F.col("q_next"), F.lit(1), half)))
    rows = rows.select(*order, F.sha2(F.col("q_edited").cast("binary"), 256).alias("edited_sha256"), terms(F.col("q_text")).alias("q_own"), terms(F.col("q_edited")).alias("q_new"))
    rows = rows.withColumn("q_lists", lists.scalar())
    rows = rows.select(*order, "edited_sha256", marks(F.col("q_own"), F.col("q_lists")).alias("q_a"), marks(F.col("q_new"), F.col("q_lists")).alias("q_b"))
    rows = rows.withColumn("q_c", F.lead("q_a").over(w)).where(~F.col("guest"))
    return rows.select(F.col("q_id").alias("doc_id"), "n_chars", "edited_sha256", written(F.col("q_a")).alias("fingerprint"), written(F.col("q_b")).alias("edited_fingerprint"), likeness(F.col("q_a"), F.col("q_b")).alias("near_edited"), likeness(F.col("q_a"), F.col("q_c")).alias("near_next"))


def op5_imatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """I-Match fingerprints of all documents and of their edited texts: see fingerprint()."""
    return fingerprint(read(spark, sf_dir, "documents"))
