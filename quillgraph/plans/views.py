"""Citation-shaped views over the driver's tables, as DataFrames and as SQL with the same columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

HUMAN = "1-URGENT"
GRAPH_YEARS, TEAM, CUTOFF = (1996, 1999), (2, 25), 1998
# Headings by line number, in the spellings that papers use.
HEADINGS = {1: "Introduction", 2: "Related Works.", 3: " experimental settings ", 4: "Methodology", 5: "DISCUSSION", 6: "Conclusions", 7: "An unusual heading of more than thirty characters"}
KINDS = ("Article", "proceeding", "book", "preprint", "other")
LINE_ORDER = ("l_linenumber", "l_orderkey", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Bytes of lines on disk for each task that sorts them.
TASK_BYTES = 8 << 20


def tasks(df: DataFrame) -> int:
    """How many tasks to deal df's files to, so that one task's share doesn't grow with them."""
    size = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    return max(df.sparkSession.sparkContext.defaultParallelism, -(-size // TASK_BYTES))


def one_part_each(lines: DataFrame, part: DataFrame) -> bool:
    """Whether each part of a line is there once, so that joining them keeps all lines and adds none."""
    known = part.groupBy(F.col("p_partkey").alias("l_partkey")).agg(F.count(F.lit(1)).alias("n"))
    return lines.select("l_partkey").where("l_partkey is not null").distinct().join(known, "l_partkey", "left").where("coalesce(n, 0) != 1").isEmpty()


def slots(spark: SparkSession, sf_dir: str, by: tuple[str, ...] = (), of_part: bool = False) -> DataFrame:
    """One row per citation slot: an order line of a customer, told apart by the order's priority as its source.

    `by`, of source and paper, adds each slot's position; rows are then dealt to tasks by these columns, so that what
    groups by them (and more) needs no further shuffle. `of_part` adds citations and teamsize; without them lines don't
    travel to their parts unless some part is missing or repeated.
    """
    lines, orders = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderpriority", F.year("o_orderdate").alias("q_year"))
    per_part = lines.groupBy("l_partkey").agg(F.count(F.lit(1)).alias("citations"))
    # each part of a line has a count: as an outer join it goes where nobody asks for that
    parts = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), F.col("p_size").cast("bigint").alias("teamsize")).join(per_part, "l_partkey", "left")
    raw, n = lines, tasks(lines)

    def dealt(df: DataFrame, key: str) -> DataFrame:
        return df.repartition(n, key) if n > int(spark.conf.get("spark.sql.shuffle.partitions")) else df

    if by:
        # the order of an order's lines is settled where they meet first, so that what it rests on travels once
        tie = F.row_number().over(Window.partitionBy("l_orderkey", "l_linenumber").orderBy(*LINE_ORDER))
        lines, orders = lines.where("l_orderkey is not null").repartition(n, "l_orderkey").withColumn("q_tie", tie), orders.repartition(n, "o_orderkey")
    else:
        lines, orders = dealt(lines, "l_orderkey"), dealt(orders, "o_orderkey")
    at = lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).select(
        "l_partkey", "l_linenumber", *(["l_orderkey", "q_tie"] if by else []), F.col("o_orderpriority").alias("source"), F.col("o_custkey").alias("paper"), (F.year("l_shipdate") - F.col("q_year")).alias("recency"),
        F.when(F.col("l_returnflag") == "R", 0).when(F.col("l_returnflag") == "A", 1).otherwise(2).alias("q_original"), F.pmod(F.col("l_linenumber") + F.col("l_suppkey"), F.lit(3)).cast("int").alias("q_filled"), (F.col("l_suppkey") % 7 != 0).alias("q_cited"),
    )
    if of_part or not one_part_each(raw, table(spark, sf_dir, "part")):
        at = dealt(at, "l_partkey").join(dealt(parts, "l_partkey"), "l_partkey")
    else:
        at = at.where("l_partkey is not null")
    if by:
        place = F.row_number().over(Window.partitionBy("source", "paper", "l_linenumber").orderBy("l_orderkey", "q_tie"))
        at = at.repartition(n, *by).withColumn("position", (place - 1).cast("bigint"))
    intents = F.array(*(F.lit(x) for x in ("supporting", "contrasting", "mentioning")))
    at = at.withColumns(
        {
            "context": F.col("l_linenumber").cast("bigint"),
            "intent_original": F.element_at(intents, F.col("q_original") + 1),
            "intent_filled": F.element_at(intents, F.col("q_filled") + 1),
            "recency": F.col("recency").cast("bigint"),
            "cited_id": F.when(F.col("q_cited"), F.col("l_partkey")),
            "section": F.element_at(F.create_map(*(F.lit(x) for kv in HEADINGS.items() for x in kv)), F.col("l_linenumber").cast("int")),
        }
    )
    at = at.withColumn("intent", F.when(F.col("source") == HUMAN, F.col("intent_original")).otherwise(F.col("intent_filled")))
    return at.select("source", "paper", "context", *(["position"] if by else []), "intent_original", "intent_filled", "intent", "recency", *(["citations", "teamsize"] if of_part else []), "cited_id", "section")


def _case(pairs: dict, key: str) -> str:
    return f"CASE {key} " + " ".join(f"WHEN {k} THEN '{v}'" for k, v in pairs.items()) + " END"


SLOTS_SQL = f"""slots AS (
  SELECT *, CASE WHEN source = '{HUMAN}' THEN intent_original ELSE intent_filled END AS intent FROM (
    SELECT o_orderpriority AS source, o_custkey AS paper, l_linenumber::BIGINT AS context,
      row_number() OVER (PARTITION BY o_orderpriority, o_custkey, l_linenumber ORDER BY {", ".join(LINE_ORDER)}) - 1 AS position,
      CASE l_returnflag WHEN 'R' THEN 'supporting' WHEN 'A' THEN 'contrasting' ELSE 'mentioning' END AS intent_original,
      ['supporting', 'contrasting', 'mentioning'][(((l_linenumber + l_suppkey) % 3) + 1)::INT] AS intent_filled,
      (year(l_shipdate) - year(o_orderdate))::BIGINT AS recency,
      count(*) OVER (PARTITION BY l_partkey) AS citations, p_size::BIGINT AS teamsize,
      CASE WHEN l_suppkey % 7 <> 0 THEN l_partkey END AS cited_id, {_case(HEADINGS, "l_linenumber")} AS section
    FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON p_partkey = l_partkey))"""


def references(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as citations: identifiers in several spellings, titles are first lines."""
    d = table(spark, sf_dir, "documents")
    doi = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit(" HTTPS://DOI.org/10.1/A"), F.col("doc_id") % 50)).when(F.col("doc_id") % 3 == 1, F.concat(F.lit("doi: 10.1/a"), F.col("doc_id") % 77)).otherwise("")
    return d.select(F.col("doc_id").alias("row_uid"), F.concat(F.lit("m"), F.col("doc_id") % 3).alias("source"), F.when(F.col("doc_id") % 2 == 0, "original").otherwise("recommended").alias("kind"), doi.alias("doi"), F.regexp_extract("text", r"^[^\n]*", 0).alias("title"), F.when(F.col("doc_id") % 5 != 0, (2000 + F.col("n_chars") % 25).cast("string")).otherwise("").alias("year"))


def publications(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same documents as publications, nested as in the external table."""
    d = table(spark, sf_dir, "documents")
    i = F.col("doc_id")
    return d.select(
        F.concat(F.lit("p"), i).alias("id"), F.when(i % 2 == 0, F.concat(F.lit("10.1/A"), i % 60)).alias("doi"), F.struct(F.when(i % 7 != 0, F.regexp_extract("text", r"^[^\n]*", 0)).alias("preferred")).alias("title"),
        F.struct(F.when(i % 3 == 0, F.col("source")).alias("name")).alias("conference"), F.struct(F.col("lang").alias("title")).alias("source"), F.element_at(F.array(*(F.lit(k) for k in KINDS)), (i % 5 + 1).cast("int")).alias("type"),
        F.when(i % 11 != 0, 2000 + F.col("n_chars") % 23).cast("int").alias("year"), F.when(i % 13 != 0, F.col("n_chars") % 100).alias("citations_count"), F.array().cast("array<string>").alias("authors"),
    )


_TITLE = r"trim(regexp_replace(regexp_replace(regexp_replace(lower(strip_accents(%s)), '[^a-z0-9\s]', ' ', 'g'), '\b(the|a|an)\b', ' ', 'g'), '\s+', ' ', 'g'))"
REFS_SQL = f"""refs AS (
  SELECT *, trim(regexp_replace(regexp_replace(lower(trim(doi)), '^https?://(dx\\.)?doi\\.org/', ''), '^doi:\\s*', '')) AS doi_key,
    {_TITLE % "title"} AS title_key, try_cast(nullif(year, '') AS BIGINT) AS year_hint
  FROM (SELECT doc_id AS row_uid, 'm' || (doc_id % 3) AS source, CASE WHEN doc_id % 2 = 0 THEN 'original' ELSE 'recommended' END AS kind,
    CASE doc_id % 3 WHEN 0 THEN ' HTTPS://DOI.org/10.1/A' || (doc_id % 50) WHEN 1 THEN 'doi: 10.1/a' || (doc_id % 77) ELSE '' END AS doi,
    split_part(text, chr(10), 1) AS title, CASE WHEN doc_id % 5 <> 0 THEN (2000 + n_chars % 25)::VARCHAR ELSE '' END AS year FROM documents)
), pubs AS (
  SELECT *, lower(pub_doi) AS pub_doi_key, coalesce({_TITLE % "pub_title"}, '') AS pub_title_key FROM (
    SELECT 'p' || doc_id AS pub_id, CASE WHEN doc_id % 2 = 0 THEN '10.1/A' || (doc_id % 60) END AS pub_doi, CASE WHEN doc_id % 7 <> 0 THEN split_part(text, chr(10), 1) END AS pub_title,
      coalesce(CASE WHEN doc_id % 3 = 0 THEN source END, lang) AS pub_venue, lower({list(KINDS)}[(doc_id % 5 + 1)::INT]) AS pub_type,
      (CASE WHEN doc_id % 11 <> 0 THEN 2000 + n_chars % 23 END)::INT AS pub_year, CASE WHEN doc_id % 13 <> 0 THEN n_chars % 100 END AS pub_citations FROM documents)
  WHERE pub_doi IS NOT NULL OR pub_title IS NOT NULL
), hit AS (
  SELECT 'doi' AS method, r.row_uid, r.year_hint, p.* FROM refs r JOIN pubs p ON r.doi_key <> '' AND p.pub_doi_key = r.doi_key
  UNION ALL SELECT 'title', r.row_uid, r.year_hint, p.* FROM refs r JOIN pubs p ON r.title_key <> '' AND p.pub_title_key = r.title_key
), best AS (
  SELECT *, row_number() OVER (PARTITION BY row_uid, method ORDER BY
    CASE pub_type WHEN 'article' THEN 0 WHEN 'proceeding' THEN 1 WHEN 'chapter' THEN 2 WHEN 'monograph' THEN 3 WHEN 'book' THEN 4 WHEN 'preprint' THEN 5 ELSE 9 END,
    abs(coalesce(pub_year, 9999) - coalesce(year_hint, 9999)), coalesce(pub_citations, 0) DESC, pub_id) AS rn FROM hit
), found AS (
  SELECT * FROM best WHERE rn = 1 AND method = 'doi'
  UNION ALL SELECT * FROM best WHERE rn = 1 AND method = 'title' AND row_uid NOT IN (SELECT row_uid FROM best WHERE method = 'doi')
), matched AS (
  SELECT r.*, f.method, f.pub_id, f.pub_year, f.pub_doi_key,
    CASE WHEN f.pub_id IS NOT NULL AND r.doi_key <> '' AND f.pub_doi_key IS NOT NULL THEN f.pub_doi_key = r.doi_key END AS doi_agrees,
    CASE WHEN f.pub_id IS NOT NULL AND r.year_hint IS NOT NULL AND f.pub_year IS NOT NULL THEN f.pub_year = r.year_hint END AS year_agrees
  FROM refs r LEFT JOIN found f USING (row_uid)
)"""


def order_publications(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as publications: parts are the researchers, in the order of the lines; ship years are citations."""
    lines = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), "s_nationkey"), "l_suppkey").join(table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("s_nationkey"), "n_name"), "s_nationkey")
    country = F.when(F.col("l_suppkey") % 5 == 0, "").otherwise(F.col("n_name"))
    row = F.struct(*LINE_ORDER, country.alias("country"), F.year("l_shipdate").alias("y"))
    at = lines.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.array_sort(F.collect_list(row)).alias("r")).join(table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate", "o_orderpriority", "o_totalprice"), "o_orderkey")
    author = F.transform("r", lambda x: F.struct(x["l_partkey"].alias("researcher_id"), F.concat(F.lit("F"), x["l_partkey"]).alias("first_name"), F.concat(F.lit("L"), x["l_partkey"]).alias("last_name"), F.array(F.lit("")).alias("orcid")))
    return at.select(
        F.col("o_orderkey").alias("id"), F.year("o_orderdate").alias("year"), F.lit(None).cast("string").alias("doi"), author.alias("authors"), F.transform("r", lambda x: x["l_partkey"]).alias("researcher_ids"), F.transform("r", lambda x: x["l_partkey"]).alias("researchers"),
        F.transform("r", lambda x: x["country"]).alias("research_org_countries"), F.transform("r", lambda x: F.struct(x["y"].alias("year"))).alias("citations"), F.struct(F.lit(None).cast("string").alias("name")).alias("conference"), F.struct(F.col("o_orderpriority").alias("title")).alias("source"), F.lit("Article").alias("type"), F.floor("o_totalprice").cast("bigint").alias("citations_count"),
    )


ORDERS_SQL = f"""opub AS (
  SELECT l_orderkey AS id, year(o_orderdate) AS year, o_orderpriority AS venue, floor(o_totalprice)::BIGINT AS citations_count,
    list(l_partkey ORDER BY {", ".join(LINE_ORDER)}, c, y) AS r, list(c ORDER BY {", ".join(LINE_ORDER)}, c, y) AS countries, list(y ORDER BY y) AS years
  FROM (SELECT *, CASE WHEN l_suppkey % 5 = 0 THEN '' ELSE n_name END AS c, year(l_shipdate) AS y FROM lineitem JOIN supplier ON s_suppkey = l_suppkey JOIN nation ON n_nationkey = s_nationkey)
  JOIN orders ON o_orderkey = l_orderkey GROUP BY ALL
)"""
EDGES_SQL = f"""{ORDERS_SQL}, team AS (
  SELECT id, list_distinct(r) AS r FROM opub WHERE year >= {GRAPH_YEARS[0]} AND year < {GRAPH_YEARS[1]}
), seeds AS (SELECT p_partkey AS id FROM part WHERE p_size <= 5
), member AS (SELECT id, unnest(r) AS p FROM team WHERE len(r) BETWEEN {TEAM[0]} AND {TEAM[1]}
), edges AS (
  SELECT a.p AS src, b.p AS dst, count(*) AS weight FROM member a JOIN member b ON a.id = b.id AND a.p < b.p
  WHERE a.id IN (SELECT id FROM member WHERE p IN (SELECT id FROM seeds)) GROUP BY a.p, b.p
)"""


def seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").where("p_size <= 5").select(F.col("p_partkey").alias("id"))


def raw_contexts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as raw contexts: a user's events of one type and hour say the same sentence."""
    e = table(spark, sf_dir, "events")
    k = F.concat(F.lit("k"), F.floor("value").cast("bigint") % 5)
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return e.select(F.col("user_id").alias("paper"), (F.row_number().over(w) - 1).cast("bigint").alias("raw_index"), F.col("event_type").alias("section"), F.concat(F.lit("s"), F.hour("ts") % 4).alias("citation_sentence"), F.lit("").alias("before_citation"), F.lit(None).cast("string").alias("after_citation"), F.lit("m").alias("masked_paragraph"), F.array(k, F.concat(F.lit("e"), F.col("event_id") % 3)).alias("cite_keys"), k.alias("cite_command"))


RAW_SQL = """raw AS (
  SELECT user_id AS paper, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS raw_index, event_type AS section, 's' || (hour(ts) % 4) AS citation_sentence,
    'k' || (floor(value)::BIGINT % 5) AS k, 'e' || (event_id % 3) AS e FROM events
)"""
