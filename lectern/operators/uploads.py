"""Uploads: kinds, limits, verdicts and the copy that users see."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.functions import text as X

MOST_BYTES = 20 * 1024 * 1024
HEAD = 8192
# Extensions and types.
MARKDOWN_ENDINGS = (".md", ".markdown", ".mdown", ".mkd")
ACCEPTED_ENDINGS = (".pdf", ".txt", ".md")
ACCEPTED_TYPES = ("application/pdf", "text/plain", "text/markdown")
ENCODINGS = ("utf-8-sig", "utf-8", "cp1252", "latin-1")
#: Status and code of each kind of failure, and whether trying again can help.
ERRORS = (
    ("validation_error", 422, False), ("unauthorized", 401, False), ("not_found", 404, False), ("conflict", 409, True), ("payload_too_large", 413, False),
    ("unsupported_media_type", 415, False), ("retrieval_unavailable", 503, True), ("answer_unavailable", 502, True), ("internal_error", 500, True),
)
#: Statuses of the embedding service after which a call is made again, by side.
RETRIED = {"documents": (408, 409, 425, 429, 500, 502, 503, 504, 529), "queries": (408, 409, 429, 500, 502, 503, 504)}


def sniff(content: Column, filename: Column) -> Column:
    """The supported type of some bytes: PDF by its mark, else text if the head is valid UTF-8 without NUL; or null.

    A character cut by the end of the head does not count against it: up to four last bytes
    may be left out, as a cut at a fixed place can itself go through a character.
    """
    head = F.substring(content, 1, HEAD)
    whole = F.length(head)
    valid = F.is_valid_utf8(head.cast("string"))
    for last in range(1, 5):
        valid = valid | F.is_valid_utf8(F.substring(head, F.lit(1), F.greatest(whole - last, F.lit(0))).cast("string"))
    markdown = F.lit(False)
    for ending in MARKDOWN_ENDINGS:
        markdown = markdown | F.lower(filename).endswith(ending)
    pdf = F.hex(F.substring(content, 1, 1024)).rlike("^(..)*?255044462D")
    nul = F.hex(head).rlike("^(..)*?00")
    return F.when(whole == 0, None).when(pdf, "application/pdf").when(nul | ~valid, None).when(F.coalesce(markdown, F.lit(False)), "text/markdown").otherwise("text/plain")


def starts_as_pdf(content: Column) -> Column:
    """The parser's stricter test: the mark after white space only."""
    return F.hex(F.substring(content, 1, 1024)).rlike("^(09|0A|0B|0C|0D|20)*255044462D")


def parser_for(declared: Column) -> Column:
    """Which parser takes a declared type, its parameters aside, or null: unsupported."""
    kind = F.lower(F.trim(F.split_part(declared, F.lit(";"), F.lit(1))))
    return F.when(kind == "application/pdf", "pdf").when(kind.isin("text/markdown", "text/x-markdown"), "markdown").when(kind == "text/plain", "plain")


def size_class(size: Column, cap: int = MOST_BYTES) -> Column:
    return F.when(size == 0, "empty").when(size > cap, "too large").otherwise("accepted")


def verdict(name: Column, size: Column, declared: Column) -> Column:
    """Why a file cannot be uploaded, or 'ok'."""
    kind = F.lower(F.trim(F.split_part(F.coalesce(declared, F.lit("")), F.lit(";"), F.lit(1))))
    ending = F.lit(False)
    for e in ACCEPTED_ENDINGS:
        ending = ending | F.lower(name).endswith(e)
    return F.when(size == 0, "empty").when(size > MOST_BYTES, "too large").when(kind.isin(*ACCEPTED_TYPES) | ending, "ok").otherwise("type")


def status_label(status: Column, progress: Column) -> Column:
    return (
        F.when(status == "pending", "Queued")
        .when(status == "processing", F.when(progress > 0, "Embedding passages").otherwise("Reading the document"))
        .when(status == "ready", "Ready")
        .when(status == "failed", "Could not be read")
    )


def decode(content: bytes) -> tuple[str | None, str | None]:
    """(text, None) by the first encoding that fits, with plain newlines, or (None, why not)."""
    if b"\0" in content[:HEAD]:
        return None, "binary"
    for encoding in ENCODINGS:
        try:
            return content.decode(encoding).replace("\r\n", "\n").replace("\r", "\n"), None
        except UnicodeDecodeError:
            continue
    return None, "encoding"


def decoded(files: DataFrame) -> DataFrame:
    """(doc_id, text, error) of files (doc_id, content); the ladder's strictness needs Python's codecs."""

    def run(batches):
        for part in batches:
            made = [decode(bytes(c)) if c is not None else (None, "empty") for c in part["content"]]
            yield pd.DataFrame({"doc_id": part["doc_id"], "text": [m[0] for m in made], "error": [m[1] for m in made]})

    return files.select("doc_id", "content").mapInPandas(run, "doc_id bigint, text string, error string")


def ingest_error(size: Column, is_pdf: Column, encrypted: Column, pages: Column, chars: Column, images: Column, most_pages: int = 500) -> Column:
    """Why a PDF cannot be indexed, in the order in which it is found out, or null."""
    return (
        F.when(size == 0, "empty").when(~is_pdf, "not a pdf").when(encrypted, "encrypted").when(pages == 0, "no pages")
        .when(pages > most_pages, F.concat(F.lit("too many pages: "), pages.cast("string"), F.lit(" of "), F.lit(str(most_pages))))
        .when((chars < 20) & images, "scan").when(chars < 20, "no text")
    )
