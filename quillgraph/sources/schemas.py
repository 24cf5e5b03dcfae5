"""Explicit schemas of the corpus files and of the external tables."""

from __future__ import annotations

METADATA = "arxiv_id string, doi string, title string, year string, venue string, num_contexts int, preprint_date string, first_arxiv_date string, latest_arxiv_date string"
BIB = "map<string, struct<title:string,author:string,authors:string,year:string,date:string,doi:string,venue:string,journal:string,booktitle:string,publisher:string>>"
CONTEXT = (
    "paragraph string, citation_sentence string, cite_command string, cite_keys array<string>, before_citation string, after_citation string, "
    f"masked_paragraph string, section string, line_number int, paragraph_length int, num_sentences_in_paragraph int, bib_entries {BIB}"
)
INTENT = "struct<motivation:string,confidence:string,_error:string>"
WORKS = "array<struct<title:string,authors:string,year:string,venue:string,doi:string>>"
JUDGED = (
    "source_model string, judge_model string, arxiv_id string, context_index int, section string, cite_keys array<string>, "
    f"bib_entries {BIB}, citation_sentence_original string, citation_sentence_filled string, num_citations_required int, num_citations_returned int, "
    f"recommended_papers {WORKS}, motivation_self {INTENT}, motivation_judge_original {INTENT}, motivation_judge_filled {INTENT}"
)
PREPRINT_DATES = "arxiv_id string, preprint_date string"
ARXIV_DATES = "arxiv_id_clean string, first_arxiv_date string, latest_arxiv_date string"
FOCAL = "arxiv_id string, venue_id string, preprint_id string, conference_name string, first_author_first string, first_author_last string, citations_count string, year string"
PUBLICATION = (
    "id string, doi string, arxiv_id string, title struct<preferred:string>, conference struct<name:string>, source struct<title:string>, type string, year int, "
    "citations_count bigint, authors array<struct<researcher_id:string,first_name:string,last_name:string,orcid:array<string>>>, "
    "researcher_ids array<string>, research_org_countries array<string>, citations array<struct<year:int>>"
)
RESEARCHER = (
    "id string, first_name string, last_name string, initials string, orcid_ids array<string>, current_research_org string, total_publications bigint, "
    "first_publication_year int, last_publication_year int"
)
EDGE = "src string, dst string, weight bigint"
