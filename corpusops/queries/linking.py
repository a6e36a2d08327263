"""Record linkage (group F)."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusops import views as v
from corpusops.functions import links, markdown, textnorm
from corpusops.operators import linkage, structure
from corpusops.queries.base import query


def _sides(spark, sf_dir):
    return v.ledger(spark, sf_dir).select("row_id", F.col("paper_title").alias("title")), v.notes(spark, sf_dir).select("note_id", "title", "path")


_NORM = "trim(regexp_replace(lower({}), '[^a-z0-9]+', ' ', 'g'))"
_SIDES = f"""a AS MATERIALIZED (SELECT row_id, paper_title AS title, {_NORM.format('paper_title')} AS na FROM ledger), b AS MATERIALIZED (SELECT note_id, title, path, {_NORM.format('title')} AS nb FROM notes)"""


@query("SELECT row_id, min_by(note_id, (lower(path), path)) AS note_id FROM ledger LEFT JOIN notes ON title = paper_title GROUP BY row_id")
def link_exact(spark, sf_dir):
    return linkage.link_exact(*_sides(spark, sf_dir))


@query("SELECT row_id, paper_title AS title FROM ledger WHERE paper_title NOT IN (SELECT title FROM notes)")
def link_anti(spark, sf_dir):
    return linkage.unlinked(*_sides(spark, sf_dir))


@query("SELECT path FROM file_listing WHERE concat(substr(path, 6, length(path) - 9), '.md') NOT IN (SELECT path FROM notes)")
def pending_files(spark, sf_dir):
    files = v.file_listing(spark, sf_dir).withColumn("note", textnorm.pdf_to_note(F.col("path")))
    return files.join(v.notes(spark, sf_dir).select(F.col("path").alias("note")), "note", "left_anti").select("path")


#: Score of na and nb, in DuckDB.
_SCORE = "CASE WHEN na = '' OR nb = '' THEN 0 WHEN contains(na, nb) OR contains(nb, na) THEN 0.92 ELSE 1 - levenshtein(na, nb) / greatest(length(na), length(nb)) END"
_BEST = f"""WITH {_SIDES}, p AS (SELECT row_id, note_id, path, CASE WHEN na = '' OR nb = '' THEN 0 WHEN contains(na, nb) OR contains(nb, na) THEN 0.92 WHEN greatest(length(na), length(nb)) = 0 THEN 1 ELSE 1 - levenshtein(na, nb) / greatest(length(na), length(nb)) END AS score FROM a, b),
m AS (SELECT row_id, note_id, score FROM p WHERE score >= 0.78 QUALIFY row_number() OVER (PARTITION BY row_id ORDER BY score DESC, lower(path), path) = 1)"""


@query(f"{_BEST} SELECT row_id, note_id, round(score, 9) AS score FROM ledger LEFT JOIN m USING (row_id)")
def link_best_lev(spark, sf_dir):
    return linkage.link_best(*_sides(spark, sf_dir), threshold=0.78)


@query()
def link_best_ratcliff(spark, sf_dir):
    return linkage.link_best(*_sides(spark, sf_dir), threshold=0.78, ratio=textnorm.ratio_ratcliff)


@query(f"""WITH {_SIDES}, p AS (SELECT row_id, note_id, path, CASE WHEN na = '' OR nb = '' THEN 0 WHEN contains(na, nb) OR contains(nb, na) THEN 0.92 WHEN greatest(length(na), length(nb)) = 0 THEN 1 ELSE 1 - levenshtein(nb, na) / greatest(length(na), length(nb)) END AS score FROM a, b),
m AS (SELECT row_id, note_id, path FROM p WHERE score >= 0.85 QUALIFY row_number() OVER (PARTITION BY note_id ORDER BY score DESC, row_id) = 1)
SELECT row_id, max_by(note_id, (lower(path), path)) AS note_id FROM m GROUP BY row_id""")
def link_reverse(spark, sf_dir):
    return linkage.reverse_best(*_sides(spark, sf_dir), threshold=0.85)


_CONTAINS = f"{_SIDES}, c AS (SELECT row_id, note_id, path FROM a, b WHERE na <> '' AND nb <> '' AND (contains(na, nb) OR contains(nb, na)))"


@query(f"WITH {_CONTAINS} SELECT row_id, note_id FROM c")
def link_contains(spark, sf_dir):
    return linkage.link_contains(*_sides(spark, sf_dir))


@query(f"""WITH {_CONTAINS}, g AS (SELECT row_id, count(*) AS n, min(note_id) AS note_id FROM c GROUP BY 1)
SELECT row_id, CASE WHEN n = 1 THEN note_id END AS note_id, CASE WHEN n = 1 THEN 'unique' ELSE concat('MATCHES=', coalesce(n, 0)) END AS outcome FROM ledger LEFT JOIN g USING (row_id)""")
def link_unique(spark, sf_dir):
    return linkage.link_unique(*_sides(spark, sf_dir))


_TAIL = "CASE WHEN contains({0}, ':') THEN trim(lower(substr({0}, strpos({0}, ':') + 1))) ELSE '' END"


_TIERS = f"""{_SIDES}, x AS MATERIALIZED (SELECT row_id, title, lower(title) AS lt, {_TAIL.format('title')} AS tt FROM a), y AS MATERIALIZED (SELECT note_id, path, title, lower(title) AS lt, {_TAIL.format('title')} AS tt FROM b),
t AS (SELECT row_id, note_id, path, CASE WHEN x.title = y.title THEN 1 WHEN x.lt = y.lt THEN 2 WHEN x.tt <> '' AND y.tt <> '' AND (contains(x.tt, y.tt) OR contains(y.tt, x.tt)) THEN 3 WHEN contains(x.lt, y.lt) OR contains(y.lt, x.lt) THEN 4 END AS tier FROM x, y),
tiered AS (SELECT row_id, tier, note_id FROM t WHERE tier IS NOT NULL QUALIFY row_number() OVER (PARTITION BY row_id ORDER BY tier, lower(path), path) = 1)"""


@query(f"WITH {_TIERS} SELECT row_id, tier, note_id FROM ledger LEFT JOIN tiered USING (row_id)")
def link_tiered(spark, sf_dir):
    return linkage.link_tiered(*_sides(spark, sf_dir))


_FOLDER, _STEM = "regexp_replace({}, '/[^/]*$', '')", _NORM.format(r"regexp_replace(regexp_extract({}, '([^/]*)$', 1), '\.[^.]*$', '')")
_FILES = f"fi AS (SELECT path AS f, {_FOLDER.format('path')} AS d, {_STEM.format('path')} AS s FROM file_listing), q AS (SELECT note_id, pdf, {_FOLDER.format('pdf')} AS d, {_STEM.format('pdf')} AS s FROM notes)"


_RESOLVED = f"""{_FILES}, st AS (SELECT d, s, count(*) AS n, min(f) AS f FROM fi GROUP BY 1, 2), r AS (SELECT note_id, CASE WHEN pdf IN (SELECT f FROM fi) THEN pdf WHEN n = 1 THEN st.f END AS file,
CASE WHEN pdf IN (SELECT f FROM fi) THEN 'direct' WHEN q.d NOT IN (SELECT d FROM fi) THEN 'directory missing' WHEN n = 1 THEN 'stem' WHEN n > 1 THEN 'multiple' ELSE 'none' END AS how FROM q LEFT JOIN st ON st.d = q.d AND st.s = q.s)"""


@query(f"WITH {_RESOLVED} SELECT * FROM r")
def file_resolve(spark, sf_dir):
    return linkage.resolve_file(v.notes(spark, sf_dir), v.file_listing(spark, sf_dir))


_ASKED = "CASE WHEN note_id % 20 = 10 THEN concat(regexp_extract(pdf, '^(.*/)[^/]*$', 1), replace(regexp_extract(pdf, '([^/]*)$', 1), '_', '-')) WHEN note_id % 9 = 4 THEN replace(pdf, 'Item', 'Modelling') ELSE pdf END"
_PSTEM = r"replace(trim(regexp_replace(lower(regexp_replace(regexp_extract({}, '([^/]*)$', 1), '\.[^.]*$', '')), '[^a-z0-9]+', '_', 'g'), '_'), 'modelling', 'modeling')"


@query(f"""WITH q AS (SELECT note_id, {_ASKED} AS pdf FROM notes), w AS MATERIALIZED (SELECT note_id, pdf, {_FOLDER.format('pdf')} AS d, {_PSTEM.format('pdf')} AS s, concat({_FOLDER.format('pdf')}, '/', replace(regexp_extract(pdf, '([^/]*)$', 1), '-', ' ')) AS alt FROM q),
fi AS MATERIALIZED (SELECT path AS f, {_FOLDER.format('path')} AS d, {_PSTEM.format('path')} AS s FROM file_listing),
p AS (SELECT note_id, f, CASE WHEN f = pdf THEN 1 WHEN f = alt THEN 2 WHEN fi.s = w.s THEN 3 ELSE 4 END AS tier FROM w JOIN fi ON fi.d = w.d AND (f = alt OR starts_with(fi.s, w.s) OR starts_with(w.s, fi.s))),
g AS (SELECT note_id, tier, count(*) AS n, min(f) AS f FROM p GROUP BY 1, 2), x AS (SELECT note_id, tier, f, n FROM g QUALIFY row_number() OVER (PARTITION BY note_id ORDER BY tier) = 1)
SELECT note_id, f AS file, CASE tier WHEN 1 THEN 'direct' WHEN 2 THEN 'hyphen' WHEN 3 THEN 'stem' WHEN 4 THEN 'prefix' ELSE 'none' END AS how FROM notes LEFT JOIN (SELECT * FROM x WHERE tier < 4 OR n = 1) USING (note_id)""")
def file_resolve_prefix(spark, sf_dir):
    """Some notes ask with hyphens for spaces, or by a stem that no file begins with."""
    return linkage.resolve_file_prefix(v.notes(spark, sf_dir).select("note_id", F.expr(_ASKED).alias("pdf")), v.file_listing(spark, sf_dir))


@query("SELECT note_id, pdf, pdf IN (SELECT path FROM file_listing) AS found FROM notes")
def file_exists(spark, sf_dir):
    return linkage.file_exists(v.notes(spark, sf_dir).select("note_id", "pdf"), v.file_listing(spark, sf_dir), "pdf")


@query(f"""{_BEST}, e AS (SELECT note_id, min(row_id) AS row_id FROM m GROUP BY note_id)
SELECT n.note_id, CASE WHEN e.row_id IS NULL THEN 'no_match' WHEN regexp_matches(trim(l.project_link), '^(?:-|\\d*)$') THEN 'no_link' ELSE 'updated' END AS outcome,
CASE WHEN NOT regexp_matches(trim(l.project_link), '^(?:-|\\d*)$') THEN l.project_link END AS link FROM notes n LEFT JOIN e USING (note_id) LEFT JOIN ledger l ON l.row_id = e.row_id WHERE NOT regexp_matches(lower(regexp_extract(text, '(?m)^> \\[!abstract\\][^\\n]*(?:\\n>[^\\n]*)*')), 'github|project')""")
def enrich_link(spark, sf_dir):
    left, right = _sides(spark, sf_dir)
    best = linkage.link_best(left, right, threshold=0.78).where("note_id is not null").groupBy("note_id").agg(F.min("row_id").alias("row_id"))
    bare = v.notes(spark, sf_dir).where(~F.lower(markdown.callout_block(F.col("text"))).rlike("github|project")).select("note_id")
    joined = bare.join(best, "note_id", "left").join(v.ledger(spark, sf_dir).select("row_id", "project_link"), "row_id", "left")
    good = links.valid_link(F.col("project_link"))
    outcome = F.when(F.col("row_id").isNull(), "no_match").when(good, "updated").otherwise("no_link")
    return joined.select("note_id", outcome.alias("outcome"), F.when(good, F.col("project_link")).alias("link"))


@query("SELECT note_id, title FROM notes WHERE title NOT IN (SELECT paper_title FROM ledger WHERE state <> 'Missing') AND title NOT IN (SELECT title FROM notes WHERE note_id % 9 = 0)")
def new_items(spark, sf_dir):
    notes = v.notes(spark, sf_dir).select("note_id", "title")
    ledger = v.ledger(spark, sf_dir).where("state <> 'Missing'").select(F.col("paper_title").alias("title"))
    return linkage.new_items(notes, ledger, notes.where("note_id % 9 = 0"))


_REF = "concat('[A', note_id, '](http://x.org): ', replace(title, ',', ' '), ', end')"


@query(rf"""WITH {_SIDES}, r AS (SELECT concat('A', note_id) AS abbr, title AS full_title, nb, note_id FROM b WHERE nb <> '' QUALIFY row_number() OVER (PARTITION BY nb ORDER BY note_id) = 1),
j AS (SELECT row_id, abbr, full_title FROM a JOIN r ON na <> '' AND (contains(na, nb) OR contains(nb, na)) QUALIFY row_number() OVER (PARTITION BY row_id ORDER BY na <> nb, note_id) = 1)
SELECT row_id, CASE WHEN abbr IS NULL OR contains(lower(paper_title), lower(abbr)) OR lower(abbr) = lower(full_title) THEN paper_title ELSE concat('[', abbr, '] ', full_title) END AS title FROM ledger LEFT JOIN j USING (row_id)""")
def ref_abbr(spark, sf_dir):
    refs = structure.reference_list(v.notes(spark, sf_dir).select(F.col("note_id").alias("id"), F.expr(_REF).alias("text")), order=True)
    return linkage.ref_abbr(_sides(spark, sf_dir)[0], refs)
