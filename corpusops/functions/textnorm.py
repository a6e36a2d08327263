"""Titles, venues, paths and similarity as column functions. Null gives null unless a function says otherwise."""

from __future__ import annotations

import difflib
import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType


def norm_title(c: Column) -> Column:
    """Lower case, runs of anything but ASCII letters and digits as one space."""
    return F.trim(F.regexp_replace(F.lower(c), "[^a-z0-9]+", " "))


def norm_fuzzy(c: Column) -> Column:
    """Separators as spaces, other punctuation dropped, lower case."""
    spaced = F.regexp_replace(c, r"[\s:,\-–—]+", " ")
    return F.trim(F.lower(F.regexp_replace(F.regexp_replace(spaced, r"[^\p{L}\p{M}\p{N}\p{Pc}\s]", ""), r"\s+", " ")))


@F.pandas_udf(StringType())
def norm_nfkd(s: pd.Series) -> pd.Series:
    """norm_title of the compatibility decomposition, which Spark has no function for: accents part from letters and become spaces."""
    return s.map(lambda x: None if x is None else re.sub("[^a-z0-9]+", " ", unicodedata.normalize("NFKD", x).lower()).strip())


def slug(c: Column, most: int = 100) -> Column:
    """File-name form of a title; one longer than ``most`` is cut to a character less, without trailing underscores."""
    kept = F.trim(F.regexp_replace(F.regexp_replace(c, r"[\s:]+", " "), r'[\\/:*?"<>|]', ""))
    out = F.regexp_replace(kept, " +", "_")
    return F.when(F.length(out) > most, F.regexp_replace(F.substring(out, 1, most - 1), "_+$", "")).otherwise(out)


def safe_name(c: Column, most: int = 200) -> Column:
    kept = F.trim(F.regexp_replace(c, r'[\\/:*?"<>|]+', ""))
    return F.substring(F.regexp_replace(kept, r"\s+", "_"), 1, most)


def sanitize_title(c: Column) -> Column:
    """Runs of anything but letters and digits of any script as one underscore, none at the ends."""
    return F.regexp_replace(F.regexp_replace(c, r"[^\p{L}\p{N}]+", "_"), "^_+|_+$", "")


def strip_year_prefix(c: Column) -> Column:
    return F.regexp_replace(c, r"^\d{4}_", "")


def head_of(c: Column) -> Column:
    """What stands before the first colon, or all."""
    return F.trim(F.get(F.split(c, ":", 2), 0))


def tail_of(c: Column) -> Column:
    """What stands after the first colon; empty without one."""
    return F.when(c.isNotNull(), F.coalesce(F.trim(F.get(F.split(c, ":", 2), 1)), F.lit("")))


def abbr_title(c: Column) -> Column:
    """``[A](link): T`` and ``[A] T`` as ``A：T``; a title with a full-width colon, or without a leading bracket, stays."""
    pattern = r"^\[([^\]]+)\](?:\([^)]*\))?:?\s*(.+)$"
    return F.when(c.contains("：") | ~c.startswith("[") | ~c.rlike(pattern), c).otherwise(
        F.concat(F.trim(F.regexp_extract(c, pattern, 1)), F.lit("："), F.trim(F.regexp_extract(c, pattern, 2)))
    )


#: Fixed value: letters, then a closing year of four digits.
_VENUE_YEAR = r"^([A-Za-z ]*?)\s*(\d{4})$"


def venue_of(c: Column) -> Column:
    """The letters before a closing year; the text itself where it doesn't end in one."""
    return F.when(c.rlike(_VENUE_YEAR), F.regexp_extract(c, _VENUE_YEAR, 1)).otherwise(c)


def year_of(c: Column) -> Column:
    return F.nullif(F.regexp_extract(c, _VENUE_YEAR, 2), F.lit(""))


def digits_of(c: Column) -> Column:
    """All digits of a venue, one after another, else ``Unknown``."""
    out = F.regexp_replace(c, r"\D+", "")
    return F.when(out == "", F.lit("Unknown")).otherwise(out)


def folder_venue(path: Column, whitelist: list[str] | None = None) -> Column:
    """Venue from a note's folder ``Venue_YYYY``. With a whitelist, a base name that isn't on it keeps its year."""
    folder = F.get(F.split(path, "/"), 1)
    base = F.replace(F.regexp_extract(folder, r"^(.+)_(\d{4})$", 1), F.lit("_"), F.lit(" "))
    year = F.regexp_extract(folder, r"^(.+)_(\d{4})$", 2)
    full = base if whitelist is None else F.when(base.isin(whitelist), base).otherwise(F.concat_ws(" ", base, year))
    return F.when(year != "", full)


def folder_year(path: Column) -> Column:
    return F.nullif(F.regexp_extract(F.get(F.split(path, "/"), 1), r"_(\d{4})$", 1), F.lit(""))


def note_to_pdf(path: Column, root: str = "pdfs") -> Column:
    return F.concat(F.lit(f"{root}/"), F.regexp_replace(path, r"\.md$", ".pdf"))


def pdf_to_note(path: Column, root: str = "pdfs") -> Column:
    return F.regexp_replace(F.regexp_replace(path, f"^{root}/", ""), r"\.pdf$", ".md")


def folder_of(path: Column) -> Column:
    return F.regexp_replace(path, "/[^/]*$", "")


def stem_of(path: Column) -> Column:
    """File name without folders and the last suffix."""
    return F.regexp_replace(F.regexp_extract(path, "([^/]*)$", 1), r"\.[^.]*$", "")


def category_folder(sort: Column) -> Column:
    return F.regexp_replace(F.trim(sort), r"\s+", "_")


def tokens(c: Column) -> Column:
    """Distinct lower-case tokens between white space that are letters and digits alone."""
    return F.array_distinct(F.filter(F.split(F.lower(c), r"\s+"), lambda x: x.rlike(r"^[\p{L}\p{N}]+$")))


def jaccard(a: Column, b: Column) -> Column:
    """Of two token arrays; 0 where one is empty."""
    shared = F.size(F.array_intersect(a, b))
    return F.when((F.size(a) == 0) | (F.size(b) == 0), F.lit(0.0)).otherwise(shared / (F.size(a) + F.size(b) - shared))


def ratio_levenshtein(a: Column, b: Column) -> Column:
    """1 less the edit distance by the longer length; 1 for two empty texts."""
    most = F.greatest(F.length(a), F.length(b))
    return F.when(most == 0, F.lit(1.0)).otherwise(1 - F.levenshtein(a, b) / most)


@F.pandas_udf(DoubleType())
def ratio_ratcliff(a: pd.Series, b: pd.Series) -> pd.Series:
    """Ratcliff-Obershelp ratio, for candidate pairs only."""
    return pd.Series([None if x is None or y is None else difflib.SequenceMatcher(None, x, y).ratio() for x, y in zip(a, b, strict=True)], dtype="float64")


#: Fixed value: score of two titles of which one holds the other.
CONTAINS_SCORE = 0.92


def title_score(a: Column, b: Column, ratio=ratio_levenshtein) -> Column:
    """CONTAINS_SCORE where one normalised title holds the other, else their ratio; 0 where one is empty."""
    return F.when((a == "") | (b == ""), F.lit(0.0)).when(a.contains(b) | b.contains(a), F.lit(CONTAINS_SCORE)).otherwise(ratio(a, b))
