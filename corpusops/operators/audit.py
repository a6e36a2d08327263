"""Filters, audits with reasons, and retrieval over notes and ledgers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusops.functions import markdown, textnorm

#: Keys that a note's front matter must have.
REQUIRED_KEYS = ["category", "core_operator", "pdf_ref", "primary_logic", "tags", "title", "venue", "year"]
#: The sections of a note.
PARTS = ["Part I", "Part II", "Part III"]


def by_state(ledger: DataFrame, state: str, mode: str = "exact") -> DataFrame:
    """Rows in a state: ``exact``, ``nocase`` or ``prefix`` (in any case)."""
    c, low = F.col("state"), state.lower()
    return ledger.where({"exact": c == state, "nocase": F.lower(c) == low, "prefix": F.lower(c).startswith(low)}[mode])


def is_placeholder(c: Column) -> Column:
    """Null, empty, an unknown marker, a hyphen or digits alone."""
    return c.isNull() | F.trim(c).isin("", "UnknownVenue", "UnknownYear", "-") | F.trim(c).rlike(r"^\d+$")


def missing_keys(keys: Column, required: list[str] | None = None) -> Column:
    return F.array_sort(F.array_except(F.array(*map(F.lit, required or REQUIRED_KEYS)), keys))


def structure_flags(text: Column) -> dict[str, Column]:
    """Whether a note has its callout, parts, local reading, a metrics table and a pdf_ref line."""
    return {
        "callout": text.contains("> [!abstract]"),
        "part_1": text.rlike(r"(?m)^#+ Part I:"),
        "part_2": text.rlike(r"(?m)^#+ Part II:"),
        "part_3": text.rlike(r"(?m)^#+ Part III:"),
        "reading": text.contains("Local Reading"),
        "metrics": markdown.metrics_table(text, ["%"]),
        "pdf_ref": text.rlike("(?m)^pdf_ref:"),
    }


def verdict(text: Column) -> Column:
    out = F.lit(True)
    for flag in structure_flags(text).values():
        out = out & flag
    return out


def missing_markers(text: Column, markers: list[str], mode: str = "regex") -> Column:
    """Markers that the text lacks: ``contains`` as written, ``colon`` with a colon after it, ``regex`` between word ends in any case."""
    found = {
        "contains": lambda m: text.contains(m),
        "colon": lambda m: F.lower(text).contains(m.lower() + ":"),
        "regex": lambda m: text.rlike(r"(?i)\b" + m.replace(" ", r"\s*") + r"\b"),
    }[mode]
    return F.array_compact(F.array(*[F.when(~found(m), F.lit(m)) for m in markers]))


#: The rules of a sound note, in order: (kind, argument, section, reason). A section is that under the heading which holds the words;
#: an empty one is the whole note. ``{}`` in a reason stands for what is missing.
AUDIT_RULES = [
    ("front matter", "", "", "no front matter"),
    ("keys", ",".join(REQUIRED_KEYS), "", "missing keys: {}"),
    ("heading", "", "", "no heading"),
    ("title in heading", "", "", "heading without title"),
    ("contains", "**Links**", "", "no quick links"),
    ("parts", ",".join(PARTS), "", "missing parts: {}"),
    ("contains", "Input,Output", "Part II:", "no input and output"),
    ("matches", r"(?i)\bstep\b", "Part II:", "no steps"),
    ("numbers", "", "Part II:", "no numbers"),
]


def _lacking(kind: str, argument: str, c: Column, title: Column) -> Column:
    """What a text lacks by a rule, as an array: empty where it has all."""
    heading, words = markdown.first_heading(c), [w.strip() for w in argument.split(",") if w.strip()]
    none, one = F.array().cast("array<string>"), F.array(F.lit(argument))
    listed = {
        "keys": lambda: F.when(markdown.has_front_matter(c), missing_keys(markdown.front_matter_keys(c), words)).otherwise(none),
        "contains": lambda: missing_markers(c, words, "contains"),
        "parts": lambda: missing_markers(c, words, "regex"),
    }
    if kind in listed:
        return listed[kind]()
    holds = {
        "front matter": lambda: markdown.has_front_matter(c),
        "heading": lambda: heading.isNotNull(),
        "title in heading": lambda: heading.isNull() | F.lower(heading).contains(F.lower(title)),
        "matches": lambda: c.rlike(argument),
        "lacks": lambda: ~c.rlike(argument),
        "numbers": lambda: markdown.has_numeric_signal(c),
    }
    if kind not in holds:
        raise ValueError(f"unknown kind of rule: {kind}")
    return F.when(holds[kind](), none).otherwise(one)


def audit_reasons(text: Column, title: Column, rules: list[tuple[str, str, str, str]] | None = None) -> Column:
    """Reasons why a note fails, in rule order; empty for a sound one. rules: rows like AUDIT_RULES, of which each becomes a column expression.

    Kinds: front matter, keys (names between commas), heading, title in heading, contains (words between commas), parts (the same, in any
    case and spacing), matches and lacks (a regular expression), numbers.
    """
    reasons = []
    for kind, argument, section, reason in AUDIT_RULES if rules is None else rules:
        lacks = _lacking(kind, argument, markdown.section_text(text, section) if section else text, title)
        before, named, after = reason.partition("{}")
        words = F.concat(F.lit(before), F.array_join(lacks, ","), F.lit(after)) if named else F.lit(reason)
        reasons.append(F.when(F.size(lacks) > 0, words))
    return F.array_compact(F.array(*reasons))


def describe_gaps(text: Column) -> Column:
    """``no_markdown`` for null, ``ok``, or the names of the flags that are missing."""
    lacking = F.array_compact(F.array(*[F.when(~f, F.lit(n)) for n, f in structure_flags(text).items()]))
    return F.when(text.isNull(), F.lit("no_markdown")).when(F.size(lacking) == 0, F.lit("ok")).otherwise(F.concat(F.lit("structure_or_depth: "), F.array_join(lacking, ", ")))


def content_mismatch(title: Column, summary: Column, source: Column) -> Column:
    """Reasons why a note isn't about its source: the source is empty, or its first five lines and the title, or all of it and the summary, share too few tokens.

    A note without title or summary isn't judged by it; null without a reason.
    """
    first = F.array_join(F.slice(F.split(source, "\n"), 1, 5), " ")
    t, s, all_tokens = textnorm.tokens(title), textnorm.tokens(summary), textnorm.tokens(source)
    reasons = F.array_compact(F.array(
        F.when((F.coalesce(title, F.lit("")) != "") & (textnorm.jaccard(t, textnorm.tokens(first)) < 0.2), F.lit("title mismatch")),
        F.when((F.coalesce(summary, F.lit("")) != "") & (textnorm.jaccard(s, all_tokens) < 0.05), F.lit("summary mismatch")),
    ))
    empty = F.coalesce(F.trim(source), F.lit("")) == ""
    return F.when(empty, F.lit("empty source")).when(F.size(reasons) > 0, F.array_join(reasons, ", "))


def field_diff(ledger: DataFrame, notes: DataFrame, key: str, fields: dict[str, str]) -> DataFrame:
    """(key, field, ledger_value, note_value) of matched pairs' fields that differ; fields: ledger column -> note column."""
    pairs = ledger.select(key, *[F.col(a).alias(f"l_{a}") for a in fields]).join(notes.select(key, *[F.col(b).alias(f"n_{a}") for a, b in fields.items()]), key)
    each = pairs.select(key, F.explode(F.array(*[
        F.struct(F.lit(a).alias("field"), F.col(f"l_{a}").cast("string").alias("ledger_value"), F.col(f"n_{a}").cast("string").alias("note_value")) for a in fields
    ])).alias("x")).select(key, "x.*")
    return each.where(~F.col("ledger_value").eqNullSafe(F.col("note_value")))


def search_notes(notes: DataFrame, tag: str | None = None, venue: str | None = None, year: int | None = None, text: str | None = None) -> DataFrame:
    """Notes that meet all given conditions; tags: column of arrays."""
    for given, condition in (
        (tag, lambda: F.array_contains("tags", tag)), (venue, lambda: F.col("venue") == venue), (year, lambda: F.col("year") == year),
        (text, lambda: F.lower("text").contains(text.lower())),
    ):
        if given is not None:
            notes = notes.where(condition())
    return notes
