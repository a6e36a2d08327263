"""Ledger state changes and note repairs. Every function returns new rows; nothing is edited in place."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusops.functions import links, textnorm


def change_log(moved: DataFrame) -> DataFrame:
    """(row_id, title, old_state, new_state, reason) of the rows whose state isn't the same."""
    return moved.where(~F.col("state").eqNullSafe(F.col("new_state"))).select(
        "row_id", F.col("paper_title").alias("title"), F.col("state").alias("old_state"), "new_state", "reason"
    )


def illegal_transitions(log: DataFrame, allowed: DataFrame) -> DataFrame:
    return log.join(allowed.select(F.col("from_state").alias("old_state"), F.col("to_state").alias("new_state")), ["old_state", "new_state"], "left_anti")


def _empty(c: Column) -> Column:
    return c.isNull() | (F.trim(c) == "")


def fill_fields(fields: DataFrame) -> DataFrame:
    """(note_id, category, venue, year, title, tags, core_operator, primary_logic, actions): empty fields from the path, the heading or a marker to do.

    A note without a heading has the title of its file name, without the year; tags that are missing are the path's category.
    """
    path = F.col("path")
    category = F.get(F.split(path, "/"), 0)
    from_name = F.trim(F.replace(textnorm.strip_year_prefix(textnorm.stem_of(path)), F.lit("_"), F.lit(" ")))
    sources = {
        "category": category, "venue": textnorm.folder_venue(path), "year": textnorm.folder_year(path),
        "title": F.coalesce(F.nullif(F.trim("heading"), F.lit("")), from_name), "tags": category, "core_operator": F.lit("[TODO]"), "primary_logic": F.lit("[TODO]"),
    }
    filled = [F.when(_empty(F.col(f)), s).otherwise(F.col(f)).alias(f) for f, s in sources.items()]
    actions = F.array_compact(F.array(*[F.when(_empty(F.col(f)) & s.isNotNull(), F.lit(f)) for f, s in sources.items()]))
    return fields.select("note_id", *filled, F.array_join(actions, ",").alias("actions"))


def fill_venue_year(fields: DataFrame, whitelist: list[str]) -> DataFrame:
    """(note_id, old_venue, new_venue, old_year, new_year) of the notes where a missing or unknown value can be told from the folder."""
    unknown = lambda c: _empty(c) | c.isin("UnknownVenue", "UnknownYear")
    venue, year = textnorm.folder_venue(F.col("path"), whitelist), textnorm.folder_year(F.col("path"))
    out = fields.select(
        "note_id", F.col("venue").alias("old_venue"), F.when(unknown(F.col("venue")), F.coalesce(venue, "venue")).otherwise(F.col("venue")).alias("new_venue"),
        F.col("year").alias("old_year"), F.when(unknown(F.col("year")), F.coalesce(year, "year")).otherwise(F.col("year")).alias("new_year"),
    )
    return out.where(~F.col("old_venue").eqNullSafe(F.col("new_venue")) | ~F.col("old_year").eqNullSafe(F.col("new_year")))


def canonical_note(notes: DataFrame, linked: DataFrame, ledger: DataFrame) -> DataFrame:
    """(note_id, title, venue, year, category, pdf_ref, tags, created, updated, core_operator, primary_logic): each note's fields beside its ledger row's.

    title and pdf_ref are the note's, else the row's; venue, year and category the row's, else the note's, venue and year being parts of
    the row's venue. tags are the note's, lines of a list or between commas, after the category where that isn't one of them. What
    nobody has is empty, blanks at the ends are none. linked: (row_id, note_id); of several rows of a note the last counts.
    """
    last = linked.where("note_id is not null").groupBy("note_id").agg(F.max("row_id").alias("row_id"))
    rows = ledger.select("row_id", *[F.trim(c).alias(f"l_{c}") for c in ("paper_title", "venue", "sort", "paper_link")])
    venue = F.col("l_venue")
    rows = rows.withColumns({"l_year": textnorm.year_of(venue), "l_venue": F.trim(textnorm.venue_of(venue)), "l_sort": F.replace("l_sort", F.lit(" "), F.lit("_"))})
    joined = notes.join(last.join(rows, "row_id"), "note_id", "left")
    pick = lambda *cs: F.coalesce(*[F.nullif(F.trim(F.col(c)), F.lit("")) for c in cs], F.lit(""))
    out = joined.select(
        "note_id", pick("title", "l_paper_title").alias("title"), pick("l_venue", "venue").alias("venue"), pick("l_year", "year").alias("year"),
        pick("l_sort", "category").alias("category"), pick("pdf_ref", "l_paper_link").alias("pdf_ref"), F.coalesce("tags", F.lit("")).alias("tags"),
        *[pick(c).alias(c) for c in ("created", "updated", "core_operator", "primary_logic")],
    )
    items = F.split("tags", F.when(F.col("tags").contains("\n"), F.lit("\n")).otherwise(F.lit(",")))
    items = F.filter(F.transform(items, lambda x: F.trim(x)), lambda x: x != "")
    first = F.when(F.array_contains(items, F.col("category")) | (F.col("category") == ""), items).otherwise(F.array_prepend(items, F.col("category")))
    return out.withColumn("tags", first)


def repair_file_ref(refs: DataFrame, exists: DataFrame, resolved: DataFrame) -> DataFrame:
    """(note_id, pdf_ref, action): kept where the file exists, else the resolved file, else unresolved with the reason."""
    joined = refs.join(exists.select("note_id", "found"), "note_id", "left").join(resolved, "note_id", "left")
    keep = ~_empty(F.col("pdf_ref")) & F.coalesce("found", F.lit(False))
    action = F.when(keep, "kept").when(F.col("file").isNotNull(), F.concat(F.lit("set by "), "how")).otherwise(F.concat(F.lit("unresolved: "), F.coalesce("how", F.lit("none"))))
    return joined.select("note_id", F.when(keep, F.col("pdf_ref")).otherwise(F.coalesce("file", "pdf_ref")).alias("pdf_ref"), action.alias("action"))


#: Order of the keys of a front matter; others follow, sorted.
KEY_ORDER = ["title", "venue", "year", "tags", "core_operator", "primary_logic", "claims", "pdf_ref", "category"]


def render_front_matter(fields: DataFrame) -> DataFrame:
    """(note_id, front_matter) from (note_id, key, kind, value): fixed order, extras sorted, lists as items, blocks indented."""
    rank = F.coalesce(F.nullif(F.array_position(F.array(*map(F.lit, KEY_ORDER)), F.col("key")), F.lit(0).cast("bigint")), F.lit(len(KEY_ORDER) + 1).cast("bigint"))
    lines = F.split("value", "\n")
    text = (
        F.when(F.col("kind") == "list", F.concat("key", F.lit(":\n"), F.array_join(F.transform(lines, lambda x: F.concat(F.lit("  - "), x)), "\n")))
        .when(F.col("kind") == "block", F.concat("key", F.lit(": |\n"), F.array_join(F.transform(lines, lambda x: F.concat(F.lit("  "), x)), "\n")))
        .otherwise(F.concat("key", F.lit(": "), F.coalesce("value", F.lit(""))))
    )
    rows = fields.groupBy("note_id").agg(F.sort_array(F.collect_list(F.struct(rank.alias("rank"), "key", text.alias("text")))).alias("rows"))
    return rows.select("note_id", F.concat(F.lit("---\n"), F.array_join(F.transform("rows", lambda r: r["text"]), "\n"), F.lit("\n---\n")).alias("front_matter"))


def replace_tag_block(text: Column, tags: Column) -> Column:
    """The text with the items of its block-style ``tags:`` replaced; the rest as it is."""
    block = r"(?m)^tags:\n(?:[ \t]*- [^\n]*\n)+"
    new = F.concat(F.lit("tags:\n"), F.array_join(F.transform(tags, lambda x: F.concat(F.lit("  - "), x)), "\n"), F.lit("\n"))
    at = F.regexp_instr(text, F.lit(block))
    found = F.regexp_extract(text, block, 0)
    return F.when(at > 0, F.concat(F.substring(text, F.lit(1), at - 1), new, F.substring(text, at + F.length(found), F.length(text)))).otherwise(text)


def inject_link(text: Column, url: Column) -> Column:
    """The text with ``[label](url)`` at the end of its Links line, or a Links line after the callout's first; as it is where the address is there, or there is no callout."""
    link = F.concat(F.lit("["), links.link_label(url), F.lit("]("), url, F.lit(")"))
    line, head = r"(?m)^> - \*\*Links\*\*:[^\n]*", r"(?m)^> \[!abstract\][^\n]*"

    def after(pattern: str, extra: Column) -> Column:
        end = F.regexp_instr(text, F.lit(pattern)) + F.length(F.regexp_extract(text, pattern, 0))
        return F.concat(F.substring(text, F.lit(1), end - 1), extra, F.substring(text, end, F.length(text)))

    return (
        F.when(url.isNull() | text.contains(url), text)
        .when(text.rlike(line), after(line, F.concat(F.lit(" / "), link)))
        .when(text.rlike(head), after(head, F.concat(F.lit("\n> - **Links**: "), link)))
        .otherwise(text)
    )


def suggest_names(matches: DataFrame, review_below: float = 0.80) -> DataFrame:
    """(row_id, stem, need_review): planned file stem of a match, and whether somebody should look at it.

    matches: (row_id, title, venue, category, folder, score).
    """
    year = F.coalesce(textnorm.year_of(F.col("venue")), F.lit("YYYY"))
    name = F.coalesce(F.nullif(textnorm.slug(F.replace("title", F.lit("|"), F.lit(";"))), F.lit("")), F.lit("Untitled"))
    review = F.col("score").isNull() | (F.col("score") < review_below) | ~F.col("category").eqNullSafe(F.col("folder"))
    return matches.select("row_id", F.concat(year, F.lit("_"), name).alias("stem"), F.when(review, "Y").otherwise("N").alias("need_review"))


def rename_plan(matches: DataFrame, listing: DataFrame, min_score: float = 0.80, mode: str = "guarded") -> DataFrame:
    """(row_id, source, target, outcome): rename, same, not found, target exists, or review.

    matches: (row_id, source, target, need_review, score). mode: ``N`` plans the rows that need no review alone, ``all`` every row, ``Y``
    those that need review, and ``guarded`` every row; with the last two a row that needs review and has less than the least score is
    left to review. Two planned rows for one target are both ``target exists``.
    """
    if mode not in ("N", "Y", "all", "guarded"):
        raise ValueError(f"unknown mode: {mode}")
    matches = matches.where(F.col("need_review") == mode) if mode in ("N", "Y") else matches
    unsure = (F.col("need_review") == "Y") & (F.coalesce("score", F.lit(0.0)) < min_score) & F.lit(mode in ("Y", "guarded"))
    there = listing.select("path").distinct()
    joined = matches.withColumn("unsure", unsure).join(there.select(F.col("path").alias("source"), F.lit(True).alias("has_source")), "source", "left")
    joined = joined.join(there.select(F.col("path").alias("target"), F.lit(True).alias("has_target")), "target", "left")
    uses = matches.groupBy("target").agg(F.count("*").alias("uses"))
    joined = joined.join(uses, "target", "left")
    outcome = (
        F.when(F.col("unsure"), "review").when(F.col("has_source").isNull(), "not found")
        .when(F.col("source") == F.col("target"), "same").when(F.col("has_target").isNotNull() | (F.col("uses") > 1), "target exists").otherwise("rename")
    )
    return joined.select("row_id", "source", "target", outcome.alias("outcome"))


def _rename_all(listing: DataFrame, target: Column, when: Column) -> DataFrame:
    paths = listing.select("path").distinct()
    plan = paths.where(when).select(F.col("path").alias("source"), target.alias("target"))
    plan = plan.join(plan.groupBy("target").agg(F.count("*").alias("uses")), "target").join(paths.select(F.col("path").alias("target"), F.lit(True).alias("there")), "target", "left")
    return plan.select("source", "target", F.when(F.col("there").isNotNull() | (F.col("uses") > 1), "target exists").otherwise("rename").alias("outcome"))


def rename_suffix(listing: DataFrame, suffix: str = "_KB") -> DataFrame:
    """(source, target, outcome) of the notes whose name ends in the suffix, which goes; ``target exists`` where a file has the name, or two would."""
    path = F.col("path")
    return _rename_all(listing, F.concat(F.substring(path, F.lit(1), F.length(path) - len(suffix) - 3), F.lit(".md")), path.endswith(f"{suffix}.md"))


def rename_hyphens(listing: DataFrame, spare: str = "skill") -> DataFrame:
    """(source, target, outcome) of the files with hyphens in their name, which become underscores; names with the spared word, in any case, stay."""
    name = F.regexp_extract("path", "([^/]*)$", 1)
    folder = F.regexp_extract("path", "^(.*/)[^/]*$", 1)
    return _rename_all(listing, F.concat(folder, F.replace(name, F.lit("-"), F.lit("_"))), name.contains("-") & ~F.lower(name).contains(spare))


def render_note(title: Column, venue: Column, year: Column, abstract: Column, numbers: Column) -> Column:
    """Text of a new note: fixed sections, what is known, and markers to do."""
    todo = F.lit("[TODO]")
    fill = lambda c: F.coalesce(F.nullif(c.cast("string"), F.lit("")), todo)
    return F.concat_ws("\n", F.lit("---"), F.concat(F.lit("title: "), fill(title)), F.concat(F.lit("venue: "), fill(venue)), F.concat(F.lit("year: "), fill(year)), F.lit("---"),
        F.concat(F.lit("# "), fill(title)), F.lit("> [!abstract] Summary"), F.concat(F.lit("> - **Summary**: "), fill(abstract)), F.lit("## Part I"), todo,
        F.lit("## Part II"), F.concat(F.lit("Numbers: "), fill(F.array_join(numbers, ", "))), F.lit("## Part III"), todo, F.lit("## Local Reading"))
