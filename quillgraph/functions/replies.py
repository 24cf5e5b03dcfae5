"""Model replies as text: the JSON object in them, and its repair into one shape."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillgraph.functions.text import strip

# Names under which a reply may give a field, the first that is filled counts.
LISTS = ("recommended_papers", "recommended_paper", "papers", "citations")
SINGLE = {"title": "recommended_title", "authors": "recommended_authors", "year": "recommended_year", "venue": "recommended_venue", "doi": "recommended_doi"}
TITLES, AUTHORS, YEARS, VENUES = ("title", "paper_title", "name"), ("authors", "author"), ("year", "publication_year"), ("venue", "journal", "conference")
SENTENCES = ("citation_sentence", "generated_citation_sentence", "replacement_sentence")

ITEM = "struct<title:string,authors:string,year:string,venue:string,doi:string>"


def json_object(text: Column) -> Column:
    """The JSON object in a reply as a variant: whole, without code fences, or from the first { to the last }; else null."""
    t = strip(F.regexp_replace(F.regexp_replace(strip(text), r"(?i)^```(?:json)?\s*", ""), r"\s*```$", ""))
    part = F.regexp_extract(t, r"(?s)\{.*\}", 0)
    whole = F.when(F.startswith(t, F.lit("{")) & F.endswith(t, F.lit("}")), F.try_parse_json(t))
    return F.coalesce(whole, F.try_parse_json(F.when(part != "", part)))


def _text(v: Column, name: str) -> Column:
    """A field as text; null if it is missing, empty, an empty list, 0 or false."""
    got = F.try_variant_get(v, f"$.{name}", "string")
    return F.when(~got.isin("", "[]", "{}", "0", "0.0", "false"), got)


def _first(v: Column, names: tuple[str, ...]) -> Column:
    return F.coalesce(*(_text(v, n) for n in names))


def _item(title, authors, year, venue, doi) -> Column:
    return F.struct(F.coalesce(title, F.lit("")).alias("title"), F.coalesce(authors, F.lit("")).alias("authors"), year.alias("year"), F.coalesce(venue, F.lit("")).alias("venue"), doi.alias("doi"))


def recommended(v: Column) -> Column:
    """The reply's works, in order: objects or bare titles, one object for a list, or the fields of a single work."""

    def filled(name: str) -> Column:
        many = F.try_variant_get(v, f"$.{name}", "array<variant>")
        shown = F.try_variant_get(v, f"$.{name}", "string")
        one = F.when(F.startswith(shown, F.lit("{")) & (shown != "{}"), F.array(F.try_variant_get(v, f"$.{name}", "variant")))
        return F.coalesce(F.when(F.size(many) > 0, many), one)

    listed = F.coalesce(*(filled(n) for n in LISTS))
    single = F.when(_text(v, SINGLE["title"]).isNotNull(), F.array(_item(*(_text(v, SINGLE[k]) for k in ("title", "authors", "year", "venue", "doi")))))

    def shaped(x: Column) -> Column:
        title = F.when(F.schema_of_variant(x) == "STRING", F.try_variant_get(x, "$", "string")).otherwise(_first(x, TITLES))
        return _item(title, _first(x, AUTHORS), _first(x, YEARS), _first(x, VENUES), F.try_variant_get(x, "$.doi", "string"))

    items = F.when(listed.isNotNull(), F.transform(listed, shaped)).otherwise(F.coalesce(single, F.array().cast(f"array<{ITEM}>")))
    return F.filter(items, lambda x: strip(x["title"]) != "")


def _key(x: Column) -> Column:
    return F.concat_ws("\u0001", F.lower(strip(x["title"])), F.coalesce(x["year"], F.lit("None")))


def distinct_works(items: Column) -> Column:
    """Works without those whose title, but for case, and year stood before."""
    keys = F.transform(items, _key)
    return F.filter(items, lambda x, i: F.array_position(keys, _key(x)) == i + 1)


def validated(text: Column, required: Column) -> Column:
    """struct(works, citation_count, sentence, intent, confidence, error, detail) of a reply.

    error is json_parse_error for text without an object, validation_error for a wrong number of works or a missing
    sentence, else null.
    """
    v = json_object(text)
    works = distinct_works(recommended(v))
    n = F.size(works)
    sentence = F.coalesce(*(F.when(strip(F.try_variant_get(v, f"$.{s}", "string")) != "", strip(F.try_variant_get(v, f"$.{s}", "string"))) for s in SENTENCES))
    wrong = n != required
    error = F.when(v.isNull(), "json_parse_error").when(wrong | sentence.isNull(), "validation_error")
    detail = F.when(v.isNull(), F.lit(None).cast("string")).when(wrong, F.format_string("expected_%d_papers_got_%d", required.cast("int"), n)).when(sentence.isNull(), "missing_citation_sentence")
    return F.struct(works.alias("works"), n.alias("citation_count"), sentence.alias("sentence"), F.try_variant_get(v, "$.motivation", "string").alias("intent"), F.try_variant_get(v, "$.confidence", "string").alias("confidence"), error.alias("error"), detail.alias("detail"))
