"""Tokens, normalisation, identifiers, sentences, titles and queries as Columns."""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Token patterns of chunking and search, of artifacts, of contexts, of entailment.
CHUNK_TOKEN = r"(?U)([㐀-鿿]|[A-Za-z0-9_]+|[^\s])"
#: CHUNK_TOKEN for Python: its \s also takes the separators U+001C to U+001F, which are no white space in Unicode.
PYTHON_TOKEN = re.compile("[㐀-鿿]|[A-Za-z0-9_]+|[^\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")
ARTIFACT_TOKEN = r"(?U)([㐀-䶿一-鿿豈-﫿]|[A-Za-z0-9_]+|[^\w\s]|[^\W\d_]+)"
CONTEXT_TOKEN = r"(?U)([\w]+|[^\w\s])"
ENTAILMENT_TOKEN = r"(?U)([\w一-鿿-]+)"
#: Identifiers, years, page numbers, citations.
DOI = r"(?i)\b(10\.\d{4,9}/[-._;()/:a-z0-9]+)"
ARXIV = r"(?i)(?:arxiv\s*:\s*)?((?:[a-z-]+/\d{7})|(?:\d{4}\.\d{4,5})(?:v\d+)?)"
YEAR = r"\b((?:19|20)\d{2})\b"
PAGE_NUMBER = r"(?i)^(?:page\s+)?\d+(?:\s+of\s+\d+)?$"
CITATION = r"\[([EP]\d+)\]"
#: Words that negate a statement; phrases that carry no content in a question.
NEGATIONS = ["not", "no", "never", "without", "cannot", "不", "没有", "未", "无法"]
QUESTION_PHRASES = ["请问", "请解释", "为什么", "如何", "怎么", "是什么", "是否", "的", "是"]


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def _folded(s: pd.Series, dash: bool) -> pd.Series:
    out = s.map(lambda v: None if v is None else unicodedata.normalize("NFKC", v).casefold())
    if dash:
        out = out.str.replace("‐", "-").str.replace("–", "-")
    return out.str.replace(r"[^\w\s]", " ", regex=True).str.replace(r"\s+", " ", regex=True).str.strip()


@F.pandas_udf(T.StringType())
def normalize_unicode(s: pd.Series) -> pd.Series:
    return s.map(lambda v: None if v is None else unicodedata.normalize("NFKC", v))


@F.pandas_udf(T.StringType())
def casefold(s: pd.Series) -> pd.Series:
    return s.map(lambda v: None if v is None else v.casefold())


@F.pandas_udf(T.StringType())
def normalize_title(s: pd.Series) -> pd.Series:
    """Exact: compatibility form, folded case, dashes, punctuation to blanks; null if nothing is left."""
    return _folded(s, True).map(lambda v: v or None)


@F.pandas_udf(T.StringType())
def normalize_author(s: pd.Series) -> pd.Series:
    return _folded(s, False)


def ascii_title(x: Column | str) -> Column:
    """The built-in form of normalize_title, equal on texts that casefold and NFKC leave to lower()."""
    t = F.regexp_replace(F.lower(_c(x)), r"[^a-z0-9_\s]", " ")
    return F.nullif(F.trim(F.regexp_replace(t, r"\s+", " ")), F.lit(""))


def normalize_authors(names: Column | str) -> Column:
    """Normalised names of an array, empty ones left out, in order (built-in form)."""
    one = lambda n: F.trim(F.regexp_replace(F.regexp_replace(F.lower(n), r"(?U)[^\w\s]", " "), r"\s+", " "))
    return F.filter(F.transform(_c(names), one), lambda n: n != "")


def collapse(x: Column | str) -> Column:
    return F.trim(F.regexp_replace(_c(x), r"\s+", " "))


def tokens(x: Column | str, pattern: str = CHUNK_TOKEN) -> Column:
    return F.regexp_extract_all(_c(x), F.lit(pattern), 1)


def count_tokens(x: Column | str, pattern: str = CHUNK_TOKEN) -> Column:
    return F.size(tokens(x, pattern))


def search_tokens(x: Column | str) -> Column:
    return tokens(F.lower(_c(x)))


def entailment_tokens(x: Column | str) -> Column:
    return F.array_distinct(tokens(F.lower(_c(x)), ENTAILMENT_TOKEN))


def first_match(x: Column | str, pattern: str) -> Column:
    """The first group of the first match, null if there is none."""
    return F.nullif(F.regexp_extract(_c(x), pattern, 1), F.lit(""))


def extract_doi(x: Column | str) -> Column:
    return F.lower(F.regexp_replace(first_match(x, DOI), r"[.,;)]+$", ""))


def extract_arxiv_id(x: Column | str) -> Column:
    return F.regexp_replace(F.lower(first_match(x, ARXIV)), r"v\d+$", "")


def extract_year(x: Column | str) -> Column:
    return first_match(x, YEAR).cast("int")


def normalize_statement(x: Column | str) -> Column:
    return collapse(F.regexp_replace(F.trim(F.lower(_c(x))), r"[.!?。！？]+$", ""))


def sentences(x: Column | str) -> Column:
    return F.split(_c(x), r"(?<=[.!?。！？])\s+")


def evidence_sentences(x: Column | str) -> Column:
    """Sentences that also end at line breaks, trimmed, without empty ones."""
    return F.filter(F.transform(F.split(_c(x), r"(?<=[.!?。！？])\s+|\n+"), lambda s: F.trim(s)), lambda s: s != "")


def citations(x: Column | str) -> Column:
    return F.array_distinct(F.regexp_extract_all(_c(x), F.lit(CITATION), 1))


def citation_label(kind: str, hex_id: Column | str) -> Column:
    return F.concat(F.lit(kind), F.conv(F.substring(F.regexp_replace(_c(hex_id), "-", ""), 1, 12), 16, 10))


def keywords(x: Column | str) -> Column:
    return F.filter(F.transform(F.split(_c(x), "[,;]"), lambda k: F.trim(k)), lambda k: k != "")


def split_authors(x: Column | str) -> Column:
    """Names of two to seven words."""
    names = F.transform(F.split(_c(x), r"\s*(?:,|;|·|\band\b)\s*"), collapse)
    return F.filter(names, lambda n: F.size(F.split(n, " ")).between(2, 7))


def infer_title(x: Column | str) -> Column:
    """Of the first fifteen lines that aren't blank: up to two that look like a title, joined until 40 characters."""
    lines = F.slice(F.filter(F.transform(F.split(_c(x), "\n"), collapse), lambda v: v != ""), 1, 15)
    good = F.filter(lines, lambda v: F.length(v).between(8, 250) & ~v.rlike(r"(?i)^(?:arxiv|abstract|preprint|doi)") & v.rlike(r"(?U)\w"))
    two = F.when((F.size(good) > 1) & (F.length(F.get(good, F.lit(0))) < 40), F.concat_ws(" ", F.slice(good, 1, 2))).otherwise(F.get(good, F.lit(0)))
    return F.nullif(two, F.lit(""))


def infer_authors(x: Column | str, title: Column | str) -> Column:
    """Names on the line after the one that is the title."""
    lines = F.filter(F.transform(F.split(_c(x), "\n"), collapse), lambda v: v != "")
    at = F.array_position(F.transform(lines, ascii_title), ascii_title(title))
    return F.when(at > 0, split_authors(F.get(lines, at.cast("int"))))


def venue_title(filename: Column | str) -> Column:
    """A title from a file's name: no suffix, venue prefix or venue suffix, underscores to blanks."""
    t = F.regexp_replace(_c(filename), r"\.[^.]+$", "")
    t = F.regexp_replace(t, r"(?i)^(?:AAAI|ACL|CVPR|ICCV|ICML|ICLR|NEURIPS|ACMMM|MM|TPAMI|TMM|TCSVT|TIP|ARXIV|PR)[-_ ]*\d{2,4}[-_ ]*", "")
    t = F.regexp_replace(t, r"(?i)(?:_CVPR_\d{4}_paper|-Paper-Conference|\((?:AAAI|CVPR|ICCV|ICLR|TMM)?\d{4}\))$", "")
    return F.regexp_replace(collapse(F.regexp_replace(t, "_+", " ")), "^[ -]+|[ -]+$", "")


def record_title(x: Column | str) -> Column:
    return F.trim(F.regexp_replace(F.lower(_c(x)), "[^a-z0-9]+", " "))


def curated_title(x: Column | str) -> Column:
    t = F.regexp_replace(F.replace(F.lower(_c(x)), F.lit("&"), F.lit(" and ")), r"\b(?:paper|conference)\b", " ")
    return F.trim(F.regexp_replace(t, "[^a-z0-9]+", " "))


def slug(x: Column | str, length: int = 80) -> Column:
    return F.regexp_replace(F.substring(F.regexp_replace(F.lower(_c(x)), "[^a-z0-9]+", "-"), 1, length), "^-+|-+$", "")


def clean_doi(x: Column | str) -> Column:
    return F.lower(F.regexp_replace(F.regexp_replace(F.trim(_c(x)), r"(?i)^https?://(?:dx\.)?doi\.org/", ""), r"[.,;)]+$", ""))


def rewrites(query: Column | str, most: int = 4) -> Column:
    """A question as asked, without its mark, and without phrases and signs that carry no content."""
    asked = collapse(query)
    bare = F.regexp_replace(asked, "[?？。]+$", "")
    focused = bare
    for phrase in QUESTION_PHRASES:
        focused = F.replace(focused, F.lit(phrase), F.lit(" "))
    focused = collapse(F.regexp_replace(focused, r"(?U)[^\w一-鿿-]+", " "))
    return F.slice(F.array_distinct(F.filter(F.array(asked, bare, focused), lambda q: q != "")), 1, most)


def followups(question: Column | str, unresolved: Column | str, suffix: str, most: int = 3) -> Column:
    """A question with each of its first two unresolved ones, or with a fixed suffix."""
    stem = F.regexp_replace(collapse(question), r"[.!?。！？]+$", "")
    more = F.transform(F.slice(_c(unresolved), 1, 2), lambda u: F.concat_ws(" ", stem, u))
    return F.slice(F.array_distinct(F.when(F.size(_c(unresolved)) > 0, more).otherwise(F.array(F.concat_ws(" ", stem, F.lit(suffix))))), 1, most)


def bound(x: Column, f) -> Column:
    """f of a value that is evaluated once, however often f names it."""
    return F.get(F.transform(F.array(x), f), F.lit(0))


def edge_clean_text(x: Column | str) -> Column:
    """A document's text without page numbers and without lines that stand at the edges of many pages.

    What lambdas name is bound before: they'd evaluate it again for every line.
    """
    one_page = lambda p: F.filter(F.transform(F.split(p, r"\R"), lambda v: F.lower(F.trim(F.regexp_replace(v, r"(?U)\s+", " ")))), lambda v: v != "")
    edge = lambda p: F.array_distinct(F.concat(F.slice(p, 1, 2), F.when(F.size(p) > 2, F.slice(p, -2, 2)).otherwise(p)))

    def repeated(pages: Column) -> Column:
        """Lines that are at the edges of so many pages: equal ones are neighbours once sorted, so each ends its run."""
        least = F.greatest(F.lit(2), F.floor((F.size(pages) + 1) / 2).cast("int"))
        many = lambda e, n: F.array_distinct(F.filter(e, lambda v, i: (i >= n - 1) & (F.get(e, i - n + 1) == v)))
        found = bound(F.array_sort(F.flatten(F.transform(pages, edge))), lambda e: bound(least, lambda n: many(e, n)))
        return F.when(F.size(pages) >= 2, found).otherwise(F.array().cast("array<string>"))

    def kept(pages: Column) -> Column:
        # of one page nothing repeats, and no line is looked up
        return bound(repeated(pages), lambda r: F.filter(F.flatten(pages), lambda v: ~F.array_contains(r, v) & ~v.rlike(PAGE_NUMBER)))

    return F.concat_ws("\n", bound(F.transform(F.split(_c(x), "\f"), one_page), kept))


def content_fingerprint(x: Column | str) -> Column:
    return F.sha2(F.nullif(edge_clean_text(x), F.lit("")), 256)


def key_hash(*fields: Column | str) -> Column:
    return F.sha2(F.concat_ws("\n", *(_c(f).cast("string") for f in fields)), 256)
