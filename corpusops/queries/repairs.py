"""Aggregation, tags, state changes and repairs (groups G, H and I)."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import functions as F

from corpusops import views as v
from corpusops.functions import links, markdown, textnorm
from corpusops.operators import aggregate, audit, linkage, repair, structure, tags, transitions
from corpusops.plans.cut import cut
from corpusops.queries.audits import _FIELDS, _FLAGS, _GAPS, _REASONS
from corpusops.queries.base import query
from corpusops.queries.linking import _BEST, _RESOLVED, _SCORE, _SIDES, _TIERS
from corpusops.queries.text import _ABSTRACT, _LINES_FROM, _NUMBERS

_OK = f"f AS (SELECT note_id, {_FLAGS} FROM notes), ok AS (SELECT note_id, callout AND part_1 AND part_2 AND part_3 AND reading AND metrics AND pdf_ref AS ok FROM f)"


@query("SELECT note_id, title, path FROM notes QUALIFY row_number() OVER (PARTITION BY venue, year ORDER BY lower(path), path) = 1")
def dedupe_first(spark, sf_dir):
    rows = v.notes(spark, sf_dir).withColumn("key", F.concat_ws(" ", "venue", "year")).select("key", "note_id", "title", "path")
    return linkage.first_per_title(rows, "first", "key").drop("key")


@query("SELECT note_id, title, path FROM notes QUALIFY row_number() OVER (PARTITION BY venue, year ORDER BY lower(path) DESC, path DESC) = 1")
def dedupe_last(spark, sf_dir):
    rows = v.notes(spark, sf_dir).withColumn("key", F.concat_ws(" ", "venue", "year")).select("key", "note_id", "title", "path")
    return linkage.first_per_title(rows, "last", "key").drop("key")


@query("SELECT row_id, CAST(ceil(row_number() OVER (ORDER BY row_id) / 30) AS BIGINT) AS batch FROM ledger WHERE state = 'Knowledge'")
def batch_ids(spark, sf_dir):
    return aggregate.batches(v.ledger(spark, sf_dir), "Knowledge", 30)


@query("SELECT state, count(*) AS n FROM ledger GROUP BY state")
def run_summary(spark, sf_dir):
    return aggregate.run_summary(v.ledger(spark, sf_dir), "state")


_TAGS = f"{_FIELDS}, tg AS (SELECT note_id, unnest(string_split(value, chr(10))) AS item, generate_subscripts(string_split(value, chr(10)), 1) - 1 AS pos FROM fields WHERE key = 'tags' AND kind = 'list')"


def _tags(spark, sf_dir):
    return structure.list_rows(v.notes(spark, sf_dir)).where("item is not null")


@query(f"WITH {_TAGS} SELECT (SELECT count(DISTINCT title) FROM notes) AS papers, (SELECT count(DISTINCT category) FROM notes) AS categories, (SELECT count(DISTINCT venue) FROM notes) AS venues, (SELECT count(DISTINCT item) FROM tg) AS tags")
def corpus_counts(spark, sf_dir):
    return aggregate.corpus_counts(v.notes(spark, sf_dir), _tags(spark, sf_dir))


_FACET = "WITH {pre}r AS (SELECT {d} AS d, {m} AS m FROM {t}) SELECT d AS {n}, count(*) OVER (PARTITION BY d) AS n, m AS member FROM r"


@query(_FACET.format(pre="", d="category", m="note_id", t="notes", n="category"))
def facet_task(spark, sf_dir):
    return aggregate.facet(v.notes(spark, sf_dir), "category", "note_id")


@query(_FACET.format(pre=f"{_TAGS}, ", d="item", m="note_id", t="tg", n="item"))
def facet_tag(spark, sf_dir):
    return aggregate.facet(_tags(spark, sf_dir), "item", "note_id")


@query(_FACET.format(pre="", d="venue", m="note_id", t="notes", n="venue"))
def facet_venue(spark, sf_dir):
    return aggregate.facet(v.notes(spark, sf_dir), "venue", "note_id")


@query(f"WITH {_TAGS} SELECT split_part(item, '/', 1) AS facet, substr(item, strpos(item, '/') + 1) AS value, count(*) AS n FROM tg WHERE contains(item, '/') GROUP BY 1, 2")
def facet_prefix(spark, sf_dir):
    return aggregate.facet_prefix(_tags(spark, sf_dir))


@query(r"WITH e AS (SELECT note_id AS src, unnest(regexp_extract_all(text, '\[\[([^\]|]+)', 1)) AS dst FROM notes) SELECT dst, count(*) AS n, count(DISTINCT src) AS sources FROM e GROUP BY dst")
def backlinks(spark, sf_dir):
    edges = v.notes(spark, sf_dir).select(F.col("note_id").alias("src"), F.explode(markdown.wikilinks(F.col("text"))).alias("dst"))
    return aggregate.backlinks(edges)


@query("""WITH c AS (SELECT note_id, unnest(['category', 'venue', 'year']) AS field, unnest([category, venue, year::VARCHAR]) AS value FROM notes)
SELECT field, max(CASE WHEN note_id = 1 THEN value END) AS "1", max(CASE WHEN note_id = 2 THEN value END) AS "2", max(CASE WHEN note_id = 3 THEN value END) AS "3" FROM c GROUP BY field""")
def compare_matrix(spark, sf_dir):
    return aggregate.compare(v.notes(spark, sf_dir), [1, 2, 3], ["category", "venue", "year"], key="note_id")


@query("SELECT sha256(text) AS hash, count(*) AS n, min(doc_id) AS first_id FROM documents GROUP BY 1 HAVING count(*) > 1", views=False)
def content_dups(spark, sf_dir):
    return aggregate.content_duplicates(v.table(spark, sf_dir, "documents"))


@query("SELECT note_id, row_number() OVER (ORDER BY lower(path), path) AS rank FROM notes")
def path_order(spark, sf_dir):
    notes = v.notes(spark, sf_dir).select("note_id", "path")
    return aggregate.global_rank(notes, linkage.order_key(F.col("path"))).select("note_id", "rank")


_CLOSURE = """lst AS (SELECT alias, canonical, ord FROM tag_alias QUALIFY row_number() OVER (PARTITION BY alias ORDER BY ord DESC) = 1),
walk AS (SELECT alias AS start, canonical AS pos, 1 AS d FROM lst UNION ALL SELECT start, canonical, d + 1 FROM walk JOIN lst ON pos = alias WHERE d < 40),
ends AS (SELECT start, pos FROM walk QUALIFY row_number() OVER (PARTITION BY start ORDER BY d DESC) = 1),
ring AS (SELECT w.start, first(l.alias ORDER BY l.ord) AS name FROM walk w JOIN lst l ON w.pos = l.alias GROUP BY w.start),
closure AS (SELECT e.start AS alias, coalesce(r.name, e.pos) AS canonical FROM ends e LEFT JOIN ring r ON r.start = e.pos)"""


@query(f"WITH {_CLOSURE} SELECT alias, canonical FROM closure")
def alias_closure(spark, sf_dir):
    return tags.alias_closure(v.tag_alias(spark, sf_dir))


@query(f"""WITH {_TAGS}, {_CLOSURE}, m AS (SELECT note_id, pos, item, coalesce(canonical, item) AS tag FROM tg LEFT JOIN closure ON alias = item),
p AS (SELECT note_id, tag, min(pos) AS pos FROM m GROUP BY 1, 2), l AS (SELECT note_id, string_agg(tag, ',' ORDER BY pos) AS tags FROM p GROUP BY 1)
SELECT note_id, tags, bool_or(tag <> item) AS changed, count(tag) > count(DISTINCT tag) AS has_dup FROM m JOIN l USING (note_id) GROUP BY 1, 2""")
def canonical_tags(spark, sf_dir):
    out = tags.canonical_tags(_tags(spark, sf_dir), tags.alias_closure(v.tag_alias(spark, sf_dir)))
    return out.withColumn("tags", F.array_join("tags", ","))


@query(f"WITH {_TAGS}, e AS (SELECT replace(lower(item), '-', '_') AS norm, item, count(*) AS n FROM tg GROUP BY 1, 2) SELECT norm, string_agg(item, ',' ORDER BY item) AS spellings, CAST(sum(n) AS BIGINT) AS n FROM e GROUP BY norm HAVING count(*) > 1")
def tag_variants(spark, sf_dir):
    return tags.tag_variants(_tags(spark, sf_dir))


_RAW = "CASE note_id % 3 WHEN 0 THEN concat('a, b ,', category) WHEN 1 THEN ' x,, y' ELSE '' END"


@query(f"""WITH r AS (SELECT note_id, category, list_filter(list_transform(string_split({_RAW}, ','), lambda x: trim(x)), lambda x: x <> '') AS l FROM notes)
SELECT note_id, array_to_string(CASE WHEN list_contains(l, category) THEN l ELSE [category] || l END, ',') AS tags FROM r""")
def tags_normalise(spark, sf_dir):
    return v.notes(spark, sf_dir).select("note_id", F.array_join(tags.normalise_tags(F.expr(_RAW), F.col("category")), ",").alias("tags"))


def _rows(spark, sf_dir):
    return v.ledger(spark, sf_dir).withColumnRenamed("paper_title", "title")


#: Fixture: a row's paper served or not, and an address of its project's site that served instead.
_OK_FETCH, _FOUND_AT = "paper_link LIKE '%.pdf' AND row_id % 9 <> 6", "CASE WHEN row_id % 18 = 6 AND project_link LIKE 'http%' THEN {} END"


def _fetched(spark, sf_dir):
    ok = F.expr(_OK_FETCH)
    found = F.expr(_FOUND_AT.format("project_link"))
    why = links.classify_fetch(F.when(ok, 200).otherwise(404), F.lit("application/pdf"))
    return v.ledger(spark, sf_dir).select("row_id", ok.alias("ok"), F.get(links.site_paths(found), 1).alias("found"), why.alias("why"))


def _findings(spark, sf_dir, rule):
    return transitions.findings(_rows(spark, sf_dir), v.notes(spark, sf_dir), rule, _fetched(spark, sf_dir))


_SITE = _FOUND_AT.format(r"concat(regexp_extract(project_link, '^(https?://[^/]+)', 1), '/assets/paper.pdf')")
_PART = r"regexp_matches(text, '(?i)\bPart\s*{}\b')"
_PARTS_LACK = "concat_ws(', ', " + ", ".join(f"CASE WHEN NOT {_PART.format(p)} THEN 'Part {p}' END" for p in ("I", "II", "III")) + ")"
_MARKS_LACK = "concat_ws(', ', " + ", ".join(f"CASE WHEN NOT contains(text, 'Part {p}') THEN 'Part {p}' END" for p in ("I", "II", "III")) + ")"

#: What each rule finds for every row, whatever its state, in DuckDB: (row_id, verdict, why).
_FIND = {
    "audit": f"""{_GAPS}, ga AS (SELECT note_id, l FROM g), lt AS (SELECT row_id, min_by(note_id, (lower(path), path)) AS note_id FROM ledger LEFT JOIN notes ON title = paper_title GROUP BY 1),
fd_audit AS (SELECT row_id, CASE WHEN l IS NULL THEN 'missing' WHEN l = '' THEN 'passed' ELSE 'failed' END AS verdict, concat('structure_or_depth: ', l) AS why FROM lt LEFT JOIN ga USING (note_id))""",
    "review": f"""{_TIERS}, {_GAPS}, fd_review AS (SELECT row_id, CASE WHEN l IS NULL THEN 'missing' WHEN l = '' THEN 'passed' ELSE 'failed' END AS verdict, concat('structure_or_depth: ', l) AS why FROM ledger LEFT JOIN tiered USING (row_id) LEFT JOIN g USING (note_id))""",
    "wait": f"""{_REASONS}, rs AS (SELECT note_id, string_agg(reason, '; ' ORDER BY o) AS why FROM u GROUP BY 1),
fd_wait AS (SELECT row_id, CASE WHEN note_id IS NULL THEN 'missing' WHEN why IS NULL THEN 'passed' ELSE 'failed' END AS verdict, why FROM ledger l LEFT JOIN notes n ON concat(substr(pdf_path, 6, length(pdf_path) - 9), '.md') = n.path LEFT JOIN rs USING (note_id))""",
    "parts": f"""hd AS (SELECT note_id, path, {_MARKS_LACK} AS lack, trim(regexp_replace(trim(list_filter(string_split(text, chr(10)), lambda x: trim(x) <> '')[1]), '^#+', '')) AS head FROM notes),
hh AS (SELECT note_id, any_value(path) AS path, any_value(lack) AS lack, min(row_id) AS row_id FROM hd JOIN ledger ON contains(paper_title, head) WHERE lack <> '' AND head <> '' GROUP BY 1 HAVING count(*) = 1),
fd_parts AS (SELECT row_id, 'failed' AS verdict, concat('missing ', min_by(lack, (lower(path), path))) AS why FROM hh GROUP BY 1)""",
    "reopen": f"""{_SIDES}, pl AS (SELECT note_id, {_PARTS_LACK} AS lack FROM notes), rb AS (SELECT note_id, row_id, path, lack, {_SCORE} AS score FROM a, b JOIN pl USING (note_id) WHERE lack <> ''),
rn AS (SELECT * FROM rb WHERE score >= 0.78 QUALIFY row_number() OVER (PARTITION BY note_id ORDER BY score DESC, row_id) = 1), fd_reopen AS (SELECT row_id, 'failed' AS verdict, concat('missing ', min_by(lack, (lower(path), path))) AS why FROM rn GROUP BY 1)""",
    "complete": f"""{_SIDES}, pl AS (SELECT note_id, {_PARTS_LACK} AS lack FROM notes), cb AS (SELECT note_id, row_id, path, {_SCORE} AS score FROM a, b),
cn AS (SELECT * FROM cb WHERE score >= 0.85 QUALIFY row_number() OVER (PARTITION BY note_id ORDER BY score DESC, row_id) = 1), cl AS (SELECT row_id, max_by(note_id, (lower(path), path)) AS note_id FROM cn GROUP BY 1),
fd_complete AS (SELECT row_id, CASE WHEN lack = '' THEN 'passed' ELSE 'failed' END AS verdict, concat('missing ', lack) AS why FROM cl JOIN pl USING (note_id))""",
    "fetch": f"""fd_fetch AS (SELECT row_id, CASE WHEN {_OK_FETCH} THEN 'fetched' WHEN {_SITE} IS NOT NULL THEN 'found' ELSE 'failed' END AS verdict, '' AS why, CASE WHEN NOT ({_OK_FETCH}) THEN {_SITE} END AS url FROM ledger)""",
}
_BY_NAME = {r.name: r for r in transitions.RULES}


def _move_sql(rule, source="ledger", alias="mv"):
    """The rows of source (row_id, state, ...) with new_state, reason and new_link after a rule."""
    cases = " ".join(f"WHEN '{v_}' THEN '{to}'" for v_, to in rule.moves.items())
    states = f"state IN ({', '.join(map(repr, rule.states))})" if rule.states else "true"
    batch = f" AND row_id IN (SELECT row_id FROM {source} WHERE {states} ORDER BY row_id LIMIT {rule.batch})" if rule.batch else ""
    url = "fd.url" if rule.link == "fetch" else "NULL"
    return f"""{alias}_to AS (SELECT s.*, CASE WHEN {states}{batch} THEN CASE verdict {cases} END END AS t, verdict, why, {url} AS u FROM {source} s LEFT JOIN fd_{rule.name} fd USING (row_id)),
{alias} AS (SELECT * EXCLUDE (t, verdict, why, u), CASE WHEN t <> state THEN t ELSE state END AS new_state, CASE WHEN t <> state THEN concat('{rule.name} ', CASE WHEN verdict = 'failed' THEN concat('failed: ', why) ELSE verdict END) END AS reason,
CASE WHEN t <> state THEN coalesce(u, paper_link) ELSE paper_link END AS new_link FROM {alias}_to)"""


def _register(rule):
    def moved(spark, sf_dir):
        return transitions.move(_rows(spark, sf_dir), _findings(spark, sf_dir, rule)).select("row_id", "state", "new_state", "reason", "new_link")

    moved.__name__ = f"transition_{rule.name}"
    query(f"WITH {_FIND[rule.name]}, {_move_sql(rule)} SELECT row_id, state, new_state, reason, new_link FROM mv")(moved)


for _rule in transitions.RULES:
    _register(_rule)

#: Every row in the state, not a batch.
_AUDIT = replace(_BY_NAME["audit"], batch=None)
_LOG = f"{_FIND['audit']}, {_move_sql(_AUDIT)}, lg AS (SELECT row_id, paper_title AS title, state AS old_state, new_state, reason FROM mv WHERE state <> new_state)"


def _log(spark, sf_dir):
    return repair.change_log(transitions.move(_rows(spark, sf_dir), _findings(spark, sf_dir, _AUDIT)).withColumnRenamed("title", "paper_title"))


@query(f"WITH {_LOG} SELECT * FROM lg")
def change_log(spark, sf_dir):
    return _log(spark, sf_dir)


@query(f"""WITH {_OK}, l AS (SELECT row_id, paper_title, state, min_by(note_id, (lower(path), path)) AS note_id FROM ledger LEFT JOIN notes ON title = paper_title WHERE state = 'Knowledge' GROUP BY 1, 2, 3)
SELECT row_id, paper_title AS title, state AS old_state, 'analysis_mismatch' AS new_state, CASE WHEN note_id IS NULL THEN 'missing' ELSE 'failed' END AS reason FROM l LEFT JOIN ok USING (note_id) WHERE ok IS NULL OR NOT ok""")
def audit_transition(spark, sf_dir):
    """Flagship: ledger rows that change state after their notes, found by title, are audited, and why."""
    found = _findings(spark, sf_dir, _AUDIT)
    return found.select("row_id", "title", F.col("state").alias("old_state"), F.col("to_state").alias("new_state"), F.col("verdict").alias("reason"))


_CHAIN = [(i, r) for i, r in enumerate(transitions.RULES)]


def _chain_sql():
    """All rules one after the other; each starts from the states that the one before left."""
    ctes, seen, source = [], set(), "ledger"
    for i, rule in _CHAIN:
        for cte in _split_ctes(_FIND[rule.name]):
            if cte[0] not in seen:
                seen.add(cte[0])
                ctes.append(cte[1])
        ctes.append(_move_sql(rule, source, f"m{i}"))
        ctes.append(f"s{i} AS (SELECT * EXCLUDE (state, paper_link, new_state, new_link, reason), new_state AS state, new_link AS paper_link FROM m{i})")
        source = f"s{i}"
    return ", ".join(ctes)


def _split_ctes(text):
    """(name, definition) of the common table expressions of a list, by their brackets."""
    out, depth, quoted, start = [], 0, False, 0
    for i, c in enumerate(text):
        quoted ^= c == "'"
        depth += 0 if quoted else (c == "(") - (c == ")")
        if not quoted and depth == 0 and c == ",":
            out.append(text[start:i].strip())
            start = i + 1
    out.append(text[start:].strip())
    return [(x.split()[0], x) for x in out]


@query("WITH " + _chain_sql() + " " + " UNION ALL ".join(f"SELECT {i}::INT AS step, row_id, paper_title AS title, state AS old_state, new_state, reason FROM m{i} WHERE state <> new_state" for i, _ in _CHAIN))
def transition_chain(spark, sf_dir):
    """All seven rules, each on the states that the ones before left."""
    return transitions.run_rules(_rows(spark, sf_dir), v.notes(spark, sf_dir), transitions.RULES, _fetched(spark, sf_dir))[1]


@query(f"WITH {_LOG}, a AS (SELECT * FROM lg WHERE row_id % 4 = 0 UNION ALL SELECT row_id, title, new_state, old_state, reason FROM lg WHERE row_id % 4 <> 0) SELECT a.* FROM a LEFT JOIN state_rules ON from_state = old_state AND to_state = new_state WHERE from_state IS NULL")
def illegal_transitions(spark, sf_dir):
    log = _log(spark, sf_dir)
    odd = log.where("row_id % 4 <> 0").select("row_id", "title", F.col("new_state").alias("old_state"), F.col("old_state").alias("new_state"), "reason")
    return repair.illegal_transitions(log.where("row_id % 4 = 0").unionByName(odd), v.state_rules(spark)).select("row_id", "title", "old_state", "new_state", "reason")


@query(f"WITH {_LOG}, k AS (SELECT *, row_number() OVER (PARTITION BY reason ORDER BY row_id) AS r FROM lg) SELECT reason AS section, r AS place, row_id::VARCHAR AS line FROM k WHERE r <= 10 UNION ALL SELECT reason, 0, concat('count ', count(*)) FROM lg GROUP BY 1 UNION ALL SELECT reason, 11, concat('... and ', count(*) - 10, ' more') FROM lg GROUP BY 1 HAVING count(*) > 10")
def report_capped(spark, sf_dir):
    return aggregate.report(_log(spark, sf_dir), "reason", "row_id", 10)


_WIDE = f"{_FIELDS}, wd AS (SELECT n.note_id, n.path, " + ", ".join(f"max(CASE WHEN key = '{k}' THEN value END) AS {k}" for k in ("title", "venue", "year", "category", "tags", "core_operator", "primary_logic", "pdf_ref")) + " FROM notes n LEFT JOIN fields f ON f.note_id = n.note_id GROUP BY 1, 2)"


def _wide(spark, sf_dir, *more):
    notes = v.notes(spark, sf_dir).select("note_id", "path", markdown.first_heading(F.col("text")).alias("heading"))
    keys = ["title", "venue", "year", "category", "tags", "core_operator", "primary_logic", "pdf_ref", *more]
    each = structure.front_matter_fields(v.notes(spark, sf_dir)).groupBy("note_id").agg(*[F.max(F.when(F.col("key") == k, F.col("value"))).alias(k) for k in keys])
    return notes.join(each, "note_id", "left")


_FV = r"CASE WHEN regexp_matches(split_part(path, '/', 2), '^(.+)_(\d{4})$') THEN replace(regexp_extract(split_part(path, '/', 2), '^(.+)_(\d{4})$', 1), '_', ' ') END"
_FY = r"nullif(regexp_extract(split_part(path, '/', 2), '_(\d{4})$', 1), '')"


@query(f"""WITH {_WIDE}, h AS (SELECT wd.*, n.title AS heading, {_FV} AS fv, {_FY} AS fy FROM (SELECT * FROM wd) wd JOIN (SELECT note_id, title FROM notes) n USING (note_id))
SELECT note_id, coalesce(category, split_part(path, '/', 1)) AS category, coalesce(venue, fv) AS venue, coalesce(year, fy) AS year, coalesce(title, heading) AS title, coalesce(tags, split_part(path, '/', 1)) AS tags, coalesce(core_operator, '[TODO]') AS core_operator, coalesce(primary_logic, '[TODO]') AS primary_logic,
concat_ws(',', CASE WHEN category IS NULL THEN 'category' END, CASE WHEN venue IS NULL AND fv IS NOT NULL THEN 'venue' END, CASE WHEN year IS NULL AND fy IS NOT NULL THEN 'year' END, CASE WHEN title IS NULL THEN 'title' END, CASE WHEN tags IS NULL THEN 'tags' END, CASE WHEN core_operator IS NULL THEN 'core_operator' END, CASE WHEN primary_logic IS NULL THEN 'primary_logic' END) AS actions FROM h""")
def fill_fields(spark, sf_dir):
    return repair.fill_fields(_wide(spark, sf_dir))


@query(rf"""WITH {_WIDE}, x AS (SELECT note_id, venue, year, {_FV} AS b, {_FY} AS y FROM wd), z AS (SELECT note_id, venue AS old_venue, coalesce(venue, CASE WHEN b IN ('CVPR', 'ICLR') THEN b ELSE b || ' ' || y END) AS new_venue, year AS old_year, coalesce(year, y) AS new_year FROM x)
SELECT * FROM z WHERE old_venue IS DISTINCT FROM new_venue OR old_year IS DISTINCT FROM new_year""")
def fill_venue_year(spark, sf_dir):
    return repair.fill_venue_year(_wide(spark, sf_dir), ["CVPR", "ICLR"])


@query(rf"""WITH {_WIDE}, ex AS (SELECT note_id, max(CASE WHEN key = 'created' THEN value END) AS created, max(CASE WHEN key = 'updated' THEN value END) AS updated FROM fields GROUP BY 1),
lk AS (SELECT row_id, min_by(note_id, (lower(path), path)) AS note_id FROM ledger JOIN notes ON title = trim(paper_title) WHERE state = 'checked' GROUP BY 1), la AS (SELECT note_id, max(row_id) AS row_id FROM lk GROUP BY 1),
lv AS (SELECT la.note_id, trim(paper_title) AS lt, trim(paper_link) AS ll, replace(trim(sort), ' ', '_') AS lc, trim(l.venue) AS v FROM la JOIN ledger l USING (row_id)),
c AS (SELECT note_id, coalesce(nullif(trim(wd.title), ''), nullif(lt, ''), '') AS title,
coalesce(nullif(CASE WHEN regexp_matches(v, '^[A-Za-z ]*\d{{4}}$') THEN trim(regexp_replace(v, '\d{{4}}$', '')) ELSE v END, ''), nullif(trim(wd.venue), ''), '') AS venue,
coalesce(CASE WHEN regexp_matches(v, '^[A-Za-z ]*\d{{4}}$') THEN right(v, 4) END, nullif(trim(wd.year), ''), '') AS year, coalesce(nullif(lc, ''), nullif(trim(wd.category), ''), '') AS category,
coalesce(nullif(trim(wd.pdf_ref), ''), nullif(ll, ''), '') AS pdf_ref, list_filter(list_transform(string_split(coalesce(wd.tags, ''), CASE WHEN contains(wd.tags, chr(10)) THEN chr(10) ELSE ',' END), lambda x: trim(x)), lambda x: x <> '') AS tg,
coalesce(trim(created), '') AS created, coalesce(trim(updated), '') AS updated, coalesce(trim(core_operator), '') AS core_operator, coalesce(trim(primary_logic), '') AS primary_logic FROM wd LEFT JOIN lv USING (note_id) LEFT JOIN ex USING (note_id))
SELECT * EXCLUDE (tg), array_to_string(CASE WHEN category = '' OR list_contains(tg, category) THEN tg ELSE [category] || tg END, ',') AS tags FROM c""")
def canonical_note(spark, sf_dir):
    """Notes beside the checked rows of their title."""
    wide = _wide(spark, sf_dir, "created", "updated")
    ledger = v.ledger(spark, sf_dir).where("state = 'checked'")
    linked = linkage.link_exact(ledger.select("row_id", F.trim("paper_title").alias("title")), v.notes(spark, sf_dir))
    return repair.canonical_note(wide, linked, ledger).withColumn("tags", F.array_join("tags", ","))


@query(f"""WITH {_RESOLVED}, {_WIDE} SELECT note_id, CASE WHEN pdf_ref IN (SELECT path FROM file_listing) THEN pdf_ref ELSE coalesce(file, pdf_ref) END AS pdf_ref,
CASE WHEN pdf_ref IN (SELECT path FROM file_listing) THEN 'kept' WHEN file IS NOT NULL THEN concat('set by ', how) ELSE concat('unresolved: ', how) END AS action FROM wd JOIN r USING (note_id)""")
def repair_ref(spark, sf_dir):
    refs, listing = _wide(spark, sf_dir).select("note_id", "pdf_ref"), v.file_listing(spark, sf_dir)
    return repair.repair_file_ref(refs, linkage.file_exists(refs, listing, "pdf_ref"), linkage.resolve_file(v.notes(spark, sf_dir), listing))


_ORDER = repair.KEY_ORDER


@query(f"""WITH {_FIELDS}, t AS (SELECT note_id, key, coalesce(list_position({_ORDER!r}, key), {len(_ORDER) + 1}) AS o, CASE kind WHEN 'list' THEN concat(key, ':', chr(10), '  - ', replace(value, chr(10), concat(chr(10), '  - ')))
WHEN 'block' THEN concat(key, ': |', chr(10), '  ', replace(value, chr(10), concat(chr(10), '  '))) ELSE concat(key, ': ', value) END AS x FROM fields)
SELECT note_id, concat('---', chr(10), string_agg(x, chr(10) ORDER BY o, key), chr(10), '---', chr(10)) AS front_matter FROM t GROUP BY 1""")
def render_fm(spark, sf_dir):
    return repair.render_front_matter(structure.front_matter_fields(v.notes(spark, sf_dir)))


@query(r"""SELECT note_id, regexp_replace(text, '(?m)^tags:\n(?:[ \t]*- [^\n]*\n)+', concat('tags:', chr(10), '  - n', note_id, chr(10), '  - $1', chr(10))) AS text FROM notes""")
def replace_tags(spark, sf_dir):
    new = F.array(F.concat(F.lit("n"), F.col("note_id").cast("string")), F.lit("$1"))
    return v.notes(spark, sf_dir).select("note_id", repair.replace_tag_block(F.col("text"), new).alias("text"))


@query(r"""WITH u AS (SELECT note_id, text, concat('https://github.com/o/r', note_id) AS url FROM notes) SELECT note_id, CASE WHEN regexp_matches(text, '(?m)^> - \*\*Links\*\*:[^\n]*') THEN regexp_replace(text, '(?m)^(> - \*\*Links\*\*:[^\n]*)', concat('\1 / [GitHub](', url, ')')) ELSE text END AS text FROM u""")
def inject_link(spark, sf_dir):
    url = F.concat(F.lit("https://github.com/o/r"), F.col("note_id").cast("string"))
    return v.notes(spark, sf_dir).select("note_id", repair.inject_link(F.col("text"), url).alias("text"))


def _matches(spark, sf_dir):
    ledger = v.ledger(spark, sf_dir)
    best = linkage.link_best(ledger.select("row_id", F.col("paper_title").alias("title")), v.notes(spark, sf_dir).select("note_id", "title", "path"), 0.78)
    rows = ledger.select("row_id", F.col("paper_title").alias("title"), "venue", textnorm.category_folder(F.col("sort")).alias("category"), "pdf_path")
    notes = v.notes(spark, sf_dir).select("note_id", F.get(F.split("path", "/"), 0).alias("folder"))
    return rows.join(best, "row_id").join(notes, "note_id", "left")


_SLUG = r"""CASE WHEN length({0}) > 100 THEN regexp_replace(substr({0}, 1, 99), '_+$', '') ELSE {0} END"""
_NAMES = rf"""{_BEST}, sg AS (SELECT l.row_id, l.venue, l.pdf_path, m.score, regexp_replace(sort, '\s+', '_', 'g') AS category, n.category AS folder,
regexp_replace(trim(regexp_replace(regexp_replace(paper_title, '[\s:]+', ' ', 'g'), '[\\/:*?"<>|]', '', 'g')), ' +', '_', 'g') AS t FROM ledger l LEFT JOIN m USING (row_id) LEFT JOIN notes n ON n.note_id = m.note_id),
sn AS (SELECT row_id, pdf_path, score, concat(right(venue, 4), '_', {_SLUG.format('t')}) AS stem, CASE WHEN score IS NULL OR score < 0.8 OR category IS DISTINCT FROM folder THEN 'Y' ELSE 'N' END AS need_review FROM sg)"""


@query(f"{_NAMES} SELECT row_id, stem, need_review FROM sn")
def suggest_names(spark, sf_dir):
    return repair.suggest_names(_matches(spark, sf_dir))


def _rename_sql(where, review):
    return f"""SELECT row_id, source, target, CASE WHEN {review} THEN 'review' WHEN source NOT IN (SELECT path FROM file_listing) THEN 'not found' WHEN source = target THEN 'same'
WHEN target IN (SELECT path FROM file_listing) OR count(*) OVER (PARTITION BY target) > 1 THEN 'target exists' ELSE 'rename' END AS outcome FROM pl WHERE {where}"""


_PLANNED = f"{_NAMES}, pl AS (SELECT row_id, pdf_path AS source, concat(regexp_replace(pdf_path, '/[^/]*$', ''), '/', stem, '.pdf') AS target, need_review, score FROM sn)"
_UNSURE = "need_review = 'Y' AND coalesce(score, 0) < 0.8"


def _planned(spark, sf_dir):
    matches = _matches(spark, sf_dir)
    named = matches.select("row_id", "pdf_path", "score").join(repair.suggest_names(matches), "row_id")
    target = F.concat(textnorm.folder_of(F.col("pdf_path")), F.lit("/"), "stem", F.lit(".pdf"))
    return named.select("row_id", F.col("pdf_path").alias("source"), target.alias("target"), "need_review", "score")


@query(f"{_PLANNED} {_rename_sql('true', _UNSURE)}")
def rename_plan(spark, sf_dir):
    return repair.rename_plan(_planned(spark, sf_dir), v.file_listing(spark, sf_dir))


_MODES = {"N": ("need_review = 'N'", "false"), "Y": ("need_review = 'Y'", _UNSURE), "all": ("true", "false")}


@query(f"{_PLANNED} " + " UNION ALL ".join(f"SELECT '{mode}' AS mode, * FROM ({_rename_sql(*x)})" for mode, x in _MODES.items()))
def rename_modes(spark, sf_dir):
    """The plan under each way of treating rows that need review."""
    planned, listing = cut(_planned(spark, sf_dir)), v.file_listing(spark, sf_dir)
    plans = [repair.rename_plan(planned, listing, mode=m).withColumn("mode", F.lit(m)) for m in _MODES]
    return plans[0].unionByName(plans[1]).unionByName(plans[2])


_KB = "CASE note_id % 6 WHEN 0 THEN concat(substr(path, 1, length(path) - 3), '_KB.md') WHEN 1 THEN replace(path, 'Item_', 'Item-') WHEN 2 THEN replace(path, 'Item', 'skill-Item') ELSE path END"
_KB_TWICE = "concat(substr(path, 1, length(path) - 3), '_KB.md')"
_PATHS = f"np AS (SELECT {_KB} AS p FROM notes UNION ALL SELECT {_KB_TWICE} FROM notes WHERE note_id % 10 = 3)"


def _paths(spark, sf_dir):
    notes = v.notes(spark, sf_dir)
    return notes.select(F.expr(_KB).alias("path")).unionByName(notes.where("note_id % 10 = 3").select(F.expr(_KB_TWICE).alias("path")))


@query(f"""WITH {_PATHS}, s AS (SELECT DISTINCT p AS source, concat(substr(p, 1, length(p) - 6), '.md') AS target FROM np WHERE p LIKE '%\\_KB.md' ESCAPE '\\')
SELECT source, target, CASE WHEN target IN (SELECT p FROM np) OR count(*) OVER (PARTITION BY target) > 1 THEN 'target exists' ELSE 'rename' END AS outcome FROM s""")
def rename_suffix(spark, sf_dir):
    return repair.rename_suffix(_paths(spark, sf_dir))


@query(f"""WITH {_PATHS}, s AS (SELECT DISTINCT p AS source, concat(regexp_extract(p, '^(.*/)[^/]*$', 1), replace(regexp_extract(p, '([^/]*)$', 1), '-', '_')) AS target FROM np WHERE regexp_extract(p, '([^/]*)$', 1) LIKE '%-%' AND NOT contains(lower(regexp_extract(p, '([^/]*)$', 1)), 'skill'))
SELECT source, target, CASE WHEN target IN (SELECT p FROM np) OR count(*) OVER (PARTITION BY target) > 1 THEN 'target exists' ELSE 'rename' END AS outcome FROM s""")
def rename_hyphens(spark, sf_dir):
    return repair.rename_hyphens(_paths(spark, sf_dir))


@query(f"""WITH s AS (SELECT row_id, paper_title, right(venue, 4) AS y, trim(venue[:-5]) AS ve, {_NUMBERS} AS nu, {_LINES_FROM} FROM ledger JOIN documents ON doc_id = row_id), d AS (SELECT *, {_ABSTRACT} AS ab FROM s)
SELECT row_id, concat('---', chr(10), 'title: ', paper_title, chr(10), 'venue: ', ve, chr(10), 'year: ', y, chr(10), '---', chr(10), '# ', paper_title, chr(10), '> [!abstract] Summary', chr(10), '> - **Summary**: ', coalesce(nullif(ab, ''), '[TODO]'), chr(10), '## Part I', chr(10), '[TODO]', chr(10), '## Part II', chr(10), 'Numbers: ', coalesce(nullif(array_to_string(nu, ', '), ''), '[TODO]'), chr(10), '## Part III', chr(10), '[TODO]', chr(10), '## Local Reading') AS text FROM d""")
def render_note(spark, sf_dir):
    docs = v.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("row_id"), F.col("text").alias("source"))
    c, numbers = F.col("venue"), markdown.extract_numbers(F.regexp_replace("source", r"[^\x00-\x7F]+", " "))
    text = repair.render_note(F.col("paper_title"), textnorm.venue_of(c), textnorm.year_of(c), markdown.extract_abstract(F.col("source"), "the "), numbers)
    return v.ledger(spark, sf_dir).join(docs, "row_id").select("row_id", text.alias("text"))


@query("SELECT note_id, path, length(path) - length(replace(path, '/', '')) + 1 AS depth FROM notes WHERE split_part(path, '/', 1) <> 'Cat_de' AND split_part(path, '/', 2) NOT LIKE 'Lab%'")
def note_path_filter(spark, sf_dir):
    from corpusops.sources import files

    notes = files.filter_note_paths(v.notes(spark, sf_dir).select("note_id", "path"), exclude_dirs=["Cat_de"])
    return notes.select("note_id", "path", F.size(F.split("path", "/")).cast("bigint").alias("depth"))


_PIPE = "concat_ws(' | ', state, replace(paper_title, '|', ' '), venue, project_link, paper_link, sort)"


@query(r"SELECT row_id, state, trim(replace(paper_title, '|', ' ')) AS title, venue, sort AS category FROM ledger")
def ledger_pipe_parse(spark, sf_dir):
    from corpusops.sources import files

    lines = v.ledger(spark, sf_dir).select(F.col("row_id").alias("line_no"), F.expr(_PIPE).alias("value"))
    out = files.parse_pipe(lines, "exact")
    return out.select(F.col("line_no").alias("row_id"), "state", "title", "venue", "category")


@query("""SELECT row_id, state, coalesce(importance, '') AS importance, trim(replace(paper_title, '|', ' ')) AS paper_title, pdf_path FROM ledger WHERE row_id % 5 <> 0""")
def ledger_pipe_wide(spark, sf_dir):
    """Eight fields and one more, which is cut; lines of seven are left out."""
    from corpusops.sources import files

    eight = ["state", "importance", "replace(paper_title, '|', ' ')", "venue", "project_link", "paper_link", "sort", "pdf_path"]
    lines = v.ledger(spark, sf_dir).select(F.col("row_id").alias("line_no"), F.expr(f"CASE WHEN row_id % 5 = 0 THEN concat_ws(' | ', {', '.join(eight[:7])}) ELSE concat_ws(' | ', {', '.join(eight)}, 'more') END").alias("value"))
    return files.parse_pipe(lines, "least8").select(F.col("line_no").alias("row_id"), "state", "importance", "paper_title", "pdf_path")


@query("""WITH p AS (SELECT n.note_id, n.title, n.path, n.category, n.venue, n.year FROM notes n) SELECT note_id, title, path, category, venue, year FROM p""")
def index_rows(spark, sf_dir):
    from corpusops.sources import files

    return files.index_rows(v.notes(spark, sf_dir))
