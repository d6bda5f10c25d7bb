"""Schemas of the entities. Nothing is inferred, and ids are strings."""

from __future__ import annotations

PAPERS = (
    "acl_id string, collection_id string, volume_id string, paper_id string, title string, year int, doi string, url string, "
    "abstract string, n_authors int, authors string, booktitle string, venue_key string, source_file string, is_core_venue boolean, has_doi boolean"
)
WORKS = "openalex_id string, mag_id string, doi_norm string, oa_title string, oa_year int, oa_type string, cited_by_count int, oa_source string"
#: A page of the work resolver's responses.
WORKS_PAGE = (
    "meta struct<count: long>, results array<struct<id: string, doi: string, title: string, publication_year: int, type: string, "
    "cited_by_count: int, ids: struct<mag: string>, primary_location: struct<source: struct<display_name: string, type: string>>>>"
)
CITATIONS = "reftype string, confscore string, oaid string, patent string, wherefound string"
PATENT_META = (
    "patent_id string, title string, abstract string, assignee string, inventor string, grant_date string, ipc string, cpc string, "
    "us_class string, filing_date string, priority_date string, source string, _absent boolean, _miss boolean"
)
#: A response of the patent search.
PATENT_SEARCH = (
    "results struct<cluster: array<struct<result: array<struct<id: string, patent: struct<publication_number: string, title: string, snippet: string, assignee: string, "
    "inventor: string, grant_date: string, filing_date: string, priority_date: string>>>>>>"
)
LABELS = (
    "patent_id string, title string, assignee string, grant_date string, label string, confidence int, rationale string, "
    "insufficient_info boolean, unparsed string, model string"
)
