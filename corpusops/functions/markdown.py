"""Parts of a note as column functions: front matter, headings, sections, callouts, links, numbers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_FRONT = r"(?s)\A---\n(.*?\n)?---(?:\n|\z)"


def has_front_matter(text: Column) -> Column:
    """The first line is ``---`` and a later line is, too."""
    return text.rlike(_FRONT)


def front_matter(text: Column) -> Column:
    """The lines between the first two ``---`` lines; empty without them."""
    return F.regexp_extract(text, _FRONT, 1)


def body(text: Column) -> Column:
    return F.when(has_front_matter(text), F.regexp_replace(text, _FRONT, "")).otherwise(text)


def front_matter_keys(text: Column) -> Column:
    """Distinct keys, in order; blank lines, comments and indented lines have none."""
    lines = F.filter(F.split(front_matter(text), "\n"), lambda x: x.rlike(r"^[^\s#:\-][^:]*:"))
    return F.array_distinct(F.transform(lines, lambda x: F.trim(F.get(F.split(x, ":", 2), 0))))


def first_heading(text: Column) -> Column:
    """Text of the first ``# `` line, or null."""
    return F.nullif(F.trim(F.regexp_extract(text, r"(?m)^# (.+)$", 1)), F.lit(""))


def first_header_line(text: Column) -> Column:
    """The first line that isn't blank, without leading ``#``."""
    line = F.get(F.filter(F.split(text, "\n"), lambda x: F.trim(x) != ""), 0)
    return F.trim(F.regexp_replace(F.trim(line), "^#+", ""))


def resolve_title(front_title: Column, heading: Column, path: Column) -> Column:
    """First of front-matter title (without quotes), heading, and file stem without its year; null if all are empty."""
    stem = F.regexp_replace(F.regexp_extract(path, r"([^/]*)\.[^./]*$", 1), r"^\d{4}_", "")
    quoted = F.regexp_replace(F.trim(front_title), "^[\"']+|[\"']+$", "")
    return F.coalesce(F.nullif(quoted, F.lit("")), F.nullif(heading, F.lit("")), F.nullif(F.trim(F.replace(stem, F.lit("_"), F.lit(" "))), F.lit("")))


def section_text(text: Column, header: str) -> Column:
    """Lines after the first heading that holds ``header``, up to the next heading; empty if there is none."""
    found = F.regexp_extract(text, rf"(?m)^#[^\n]*\Q{header}\E[^\n]*(?:\n|\z)((?:(?!#)[^\n]*(?:\n|\z))*)", 1)
    return F.trim(F.regexp_replace(found, r"\A\n+|\n+\z", ""))


def summary_text(text: Column) -> Column:
    """The section headed Abstract, else the lines that hold ``Summary``, or ``abstract`` in any case; empty without any."""
    section = section_text(body(text), "Abstract")
    lines = F.filter(F.split(body(text), "\n"), lambda x: x.contains("Summary") | F.lower(x).contains("abstract"))
    return F.when(section != "", section).otherwise(F.array_join(lines, "\n"))


def callout_block(text: Column) -> Column:
    """The lines that begin with ``>``, from the first abstract callout on; empty without one."""
    return F.regexp_extract(text, r"(?m)^> \[!abstract\][^\n]*(?:\n>[^\n]*)*", 0)


def extract_abstract(text: Column, keyword: str = "abstract", size: int = 2000, lines: int = 6) -> Column:
    """Up to ``lines`` lines that aren't blank, of ``size`` characters from the first keyword on, without the first if it begins with the keyword."""
    at = F.locate(keyword, F.lower(text))
    part = F.substring(text, at, F.lit(size))
    kept = F.filter(F.transform(F.split(part, "\n"), lambda x: F.trim(x)), lambda x: x != "")
    own = F.coalesce(F.lower(F.get(kept, 0)).startswith(keyword.strip()), F.lit(False)).cast("int")
    return F.when(at > 0, F.array_join(F.slice(kept, own + 1, F.lit(lines)), " ")).otherwise(F.lit(""))


def extract_numbers(text: Column, limit: int = 3) -> Column:
    return F.slice(F.regexp_extract_all(text, F.lit(r"\b\d+(?:\.\d+)?\b"), F.lit(0)), 1, limit)


def has_numeric_signal(text: Column) -> Column:
    return text.rlike(r"\d")


def wikilinks(text: Column) -> Column:
    """Targets of ``[[target]]``, ``[[target|label]]`` and embeds, in order."""
    return F.regexp_extract_all(text, F.lit(r"\[\[([^\]|]+)"), F.lit(1))


def metrics_table(text: Column, marks: list[str]) -> Column:
    """Some line has a bar and one of the marks, in any case."""
    return F.exists(F.split(F.lower(text), "\n"), lambda x: x.contains("|") & F.exists(F.array(*map(F.lit, marks)), lambda m: x.contains(m)))


def strip_internal_links(text: Column) -> Column:
    """Embeds removed, labelled links as their label, others as the last part of their target."""
    plain = F.regexp_replace(text, r"!\[\[[^\]]*\]\]", "")
    plain = F.regexp_replace(plain, r"\[\[[^\]|]*\|([^\]]*)\]\]", "$1")
    return F.regexp_replace(plain, r"\[\[(?:[^\]|]*/)?([^\]|/]*)\]\]", "$1")
