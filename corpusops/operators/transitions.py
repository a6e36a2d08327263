"""Ledger state changes by a table of rules: each names its states, how rows find their notes, how notes are judged, and what then changes.

A rule looks only at rows in its states, and judges only the bodies of notes that these rows, or the judged notes themselves, link to.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusops.functions import markdown, textnorm
from corpusops.operators import audit, linkage
from corpusops.plans.cut import cut


@dataclass(frozen=True)
class Rule:
    """One rule: rows in ``states`` (any, if empty) go to the state that ``moves`` names for the verdict of their note.

    link: a key of LINKS. judge: a key of JUDGES, of (text, title). batch: only so many of the rows in the states, in ledger order.
    score: the least of a best match. new_url: the address that was found replaces the row's.
    """

    name: str
    states: tuple[str, ...]
    link: str
    judge: str
    moves: dict[str, str]
    batch: int | None = None
    score: float = 0.78
    new_url: bool = False


def _by_title(rows: DataFrame, notes: DataFrame, rule: Rule, ratio) -> DataFrame:
    """The first note of the row's title."""
    return linkage.link_exact(rows, notes)


def _by_tiers(rows: DataFrame, notes: DataFrame, rule: Rule, ratio) -> DataFrame:
    """The first note of the first tier: title, title in any case, tails, containment."""
    return linkage.link_tiered(rows, notes).select("row_id", "note_id")


def _by_path(rows: DataFrame, notes: DataFrame, rule: Rule, ratio) -> DataFrame:
    """The note that the row's file maps to."""
    asked = rows.select("row_id", textnorm.pdf_to_note(F.col("pdf_path")).alias("path"))
    return asked.join(notes.select("path", "note_id"), "path", "left").select("row_id", "note_id")


def _by_header(rows: DataFrame, notes: DataFrame, rule: Rule, ratio) -> DataFrame:
    """Of failing notes whose first line stands in the title of one row alone; notes: with ``text`` and ``failed``."""
    titles, heads = cut(rows.select("row_id", "title")), cut(notes.where("failed").select("note_id", markdown.first_header_line(F.col("text")).alias("head")))
    held = linkage.holding(titles.select("title"), heads.select("head")).toDF("title", "head")
    hits = held.join(titles, "title").groupBy("head").agg(F.count("*").alias("n"), F.min("row_id").alias("row_id")).where("n = 1")
    return heads.join(hits, "head").select("row_id", "note_id")


def _by_best(rows: DataFrame, notes: DataFrame, rule: Rule, ratio) -> DataFrame:
    """Of failing notes, the row of the best score, the first of equals; notes: with ``failed``."""
    asked = notes.where("failed").select(F.col("note_id").alias("row_id"), "title")
    theirs = rows.select(F.col("row_id").alias("note_id"), "title", F.lpad(F.col("row_id").cast("string"), 20, "0").alias("path"))
    best = linkage.link_best(asked, theirs, rule.score, ratio).where("note_id is not null")
    return best.select(F.col("note_id").alias("row_id"), F.col("row_id").alias("note_id"))


def _by_reverse(rows: DataFrame, notes: DataFrame, rule: Rule, ratio) -> DataFrame:
    """The last note whose own best row is this one."""
    return linkage.reverse_best(rows, notes, rule.score, ratio)


#: How rows find notes: (rows, notes, rule, ratio) -> (row_id, note_id).
LINKS = {"title": _by_title, "tiers": _by_tiers, "path": _by_path, "header": _by_header, "best": _by_best, "reverse": _by_reverse}
#: Links that start from failing notes, and look at all rows: which is best or alone doesn't depend on a row's state.
FROM_NOTES = {"header", "best", "reverse"}


def _structure(text: Column, title: Column) -> Column:
    return F.nullif(audit.describe_gaps(text), F.lit("ok"))


def _reasons(text: Column, title: Column) -> Column:
    return F.nullif(F.array_join(audit.audit_reasons(text, title), "; "), F.lit(""))


def _lacks(mode: str):
    return lambda text, title: F.concat(F.lit("missing "), F.nullif(F.array_join(audit.missing_markers(text, audit.PARTS, mode), ", "), F.lit("")))


#: How notes are judged: (text, title) -> why a note doesn't pass, or null.
JUDGES = {"structure": _structure, "reasons": _reasons, "marks": _lacks("contains"), "parts": _lacks("regex")}

#: The rules of a ledger's life. A note that fails is reason enough for many rows to wait, one alone for a row that is checked.
RULES = [
    Rule("audit", ("Knowledge",), "title", "structure", {"missing": "analysis_mismatch", "failed": "analysis_mismatch"}, batch=30),
    Rule("review", ("analysis_mismatch",), "tiers", "structure", {"passed": "checked"}),
    Rule("wait", ("Wait",), "path", "reasons", {"passed": "checked", "failed": "analysis_mismatch"}),
    Rule("parts", ("checked",), "header", "marks", {"failed": "Wait"}),
    Rule("reopen", (), "best", "parts", {"failed": "Wait"}),
    Rule("complete", ("Wait",), "reverse", "parts", {"passed": "checked"}, score=0.85),
    Rule("fetch", ("Wait",), "fetch", "fetch", {"fetched": "Downloaded", "found": "Downloaded"}, new_url=True),
]


def _in_states(ledger: DataFrame, rule: Rule) -> DataFrame:
    if not rule.states:
        return ledger
    rows = ledger.where(F.col("state").isin(*rule.states))
    if rule.batch is None:
        return rows
    # The first rows: each range of ids gives as many at most, and the least of these are the batch.
    part = rows.select("row_id", F.shiftright("row_id", 16).alias("range"))
    part = part.withColumn("n", F.row_number().over(Window.partitionBy("range").orderBy("row_id"))).where(F.col("n") <= rule.batch)
    return rows.join(F.broadcast(part.select("row_id").orderBy("row_id").limit(rule.batch)), "row_id")


def findings(ledger: DataFrame, notes: DataFrame, rule: Rule, fetched: DataFrame | None = None, ratio=textnorm.ratio_levenshtein) -> DataFrame:
    """(row_id, title, state, verdict, to_state, reason, url) of the rows that the rule moves.

    ledger: (row_id, state, title, pdf_path, paper_link); notes: (note_id, title, path, text); fetched, for a rule that links by
    ``fetch``: (row_id, ok, found, why), found being an address that served instead. A row's notes are one, but for a rule that starts
    from failing notes: there the first, by path, gives the reason. url: the row's address afterwards.
    """
    rows = _in_states(ledger, rule)
    if rule.link == "fetch":
        judged = rows.join(fetched, "row_id").withColumn("verdict", F.when(F.col("ok"), "fetched").when(F.col("found").isNotNull(), "found").otherwise("failed"))
        url = F.when((F.col("verdict") == "found") & F.lit(rule.new_url), F.col("found")).otherwise(F.col("paper_link"))
        judged = judged.select("row_id", "title", "state", "verdict", "why", url.alias("url"))
    else:
        why = JUDGES[rule.judge](F.col("text"), F.col("title")).alias("why")
        if rule.link in FROM_NOTES:
            judged = notes.select("note_id", "title", "path", F.when(F.lit(rule.link == "header"), F.col("text")).alias("text"), why)
            notes = cut(judged).withColumn("failed", F.col("why").isNotNull())
            linked = LINKS[rule.link](ledger, notes, rule, ratio).join(notes.select("note_id", "path", "failed", "why"), "note_id")
            first = linked.groupBy("row_id").agg(F.min_by(F.struct("failed", "why"), linkage.order_key(F.col("path"))).alias("x")).select("row_id", "x.*")
            judged = rows.join(first, "row_id").withColumn("verdict", F.when(F.col("failed"), "failed").otherwise("passed"))
        else:
            linked = LINKS[rule.link](rows, notes.drop("text"), rule, ratio)
            found = linked.where("note_id is not null").join(notes.select("note_id", "title", "text"), "note_id").select("row_id", why, F.lit(True).alias("there"))
            found = cut(found)  # judged once: what follows refers to the reason several times
            verdict = F.when(F.col("there").isNull(), "missing").when(F.col("why").isNull(), "passed").otherwise("failed")
            judged = rows.join(found, "row_id", "left").withColumn("verdict", verdict)
        judged = judged.select("row_id", "title", "state", "verdict", "why", F.col("paper_link").alias("url"))
    to_state = reduce(lambda c, m: c.when(F.col("verdict") == m[0], m[1]), rule.moves.items(), F)
    moved = judged.withColumn("to_state", to_state).where(F.col("to_state").isNotNull() & (F.col("to_state") != F.col("state")))
    reason = F.when(F.col("verdict") == "failed", F.concat_ws(": ", "verdict", "why")).otherwise(F.col("verdict"))
    return moved.select("row_id", "title", "state", "verdict", "to_state", F.concat(F.lit(f"{rule.name} "), reason).alias("reason"), "url")


def move(ledger: DataFrame, found: DataFrame) -> DataFrame:
    """ledger with new_state, reason and new_link: as found for the rows that move, else as they are with a null reason."""
    moved = ledger.join(found.select("row_id", "to_state", "reason", "url"), "row_id", "left")
    return moved.select(*ledger.columns, F.coalesce("to_state", "state").alias("new_state"), "reason", F.coalesce("url", "paper_link").alias("new_link"))


def run_rules(ledger: DataFrame, notes: DataFrame, rules: list[Rule], fetched: DataFrame | None = None, ratio=textnorm.ratio_levenshtein) -> tuple[DataFrame, DataFrame]:
    """The ledger after all rules, and the log (step, row_id, title, old_state, new_state, reason) of all changes.

    Rules run one after the other, each on the states that the ones before left, so a row may move more than once.
    """
    log = None
    for step, rule in enumerate(rules):
        found = cut(findings(ledger, notes, rule, fetched, ratio))
        after = move(ledger, found)
        changed = found.select(
            F.lit(step).alias("step"), "row_id", "title", F.col("state").alias("old_state"), F.col("to_state").alias("new_state"), "reason"
        )
        log = changed if log is None else log.unionByName(changed)
        ledger = cut(after.withColumns({"state": F.col("new_state"), "paper_link": F.col("new_link")}).select(*ledger.columns))
    return ledger, log
