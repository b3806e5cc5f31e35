"""Schemas of record documents and events."""

RECORD = (
    "key string, status string, pending string, bibtex struct<type:string, fields:map<string,string>>, "
    "doi string, arxiv struct<id:string,version:int>, isbn string, leeds string, abstract string, holdings string, "
    "versions map<string, struct<acquired:string,source:string,deprecated:boolean,note:string>>, "
    "audit string, log array<struct<when:string,action:string,detail:string>>"
)
EVENT = "when string, command string, input string, ref string, outcome string, source string, tier int, duration_ms bigint"

RECORD_FIELDS = ("key", "status", "pending", "bibtex", "doi", "arxiv", "isbn", "leeds", "abstract", "holdings", "versions", "audit", "log")
EVENT_FIELDS = ("when", "command", "input", "ref", "outcome", "source", "tier", "duration_ms")

# Legal states, field order of an export, fields that each entry type requires (any one of a group).
STATUSES = ("draft", "clean")
HOLDINGS = ("none", "preprint", "published", "both")
FIELD_ORDER = (
    "author", "editor", "title", "journal", "booktitle", "series", "edition", "chapter", "type", "institution", "school", "publisher", "organization", "address",
    "howpublished", "volume", "number", "pages", "month", "year", "eprint", "archiveprefix", "primaryclass", "doi", "isbn", "url", "note",
)
REQUIRED = {
    "article": ["author", "title", "journal", "year"],
    "book": ["author|editor", "title", "publisher", "year"],
    "incollection": ["author", "title", "booktitle", "publisher", "year"],
    "inproceedings": ["author", "title", "booktitle", "year"],
    "phdthesis": ["author", "title", "school", "year"],
    "mastersthesis": ["author", "title", "school", "year"],
    "techreport": ["author", "title", "institution", "year"],
    "unpublished": ["author", "title", "note"],
    "misc": [],
}
