"""Structure rows and audits (groups B and E)."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusops import views as v
from corpusops.functions import markdown, textnorm
from corpusops.operators import audit, linkage, structure
from corpusops.queries.base import query
from corpusops.queries.linking import _TIERS

_FRONT = r"(?s)\A---\n(.*?\n)?---(?:\n|\z)"
#: Lines of the front matter, in DuckDB.
_LINES = rf"""fl AS (SELECT note_id, unnest(string_split(regexp_extract(text, '{_FRONT}', 1), chr(10))) AS line, generate_subscripts(string_split(regexp_extract(text, '{_FRONT}', 1), chr(10)), 1) AS pos FROM notes)"""
_FIELDS = rf"""{_LINES}, fk AS (SELECT note_id, pos, line, regexp_matches(line, '^[^\s#:\-][^:]*:') AS k FROM fl WHERE trim(line) <> ''),
fg AS (SELECT *, sum(k::INT) OVER (PARTITION BY note_id ORDER BY pos) AS g FROM fk),
fv AS (SELECT note_id, g, max(CASE WHEN k THEN trim(split_part(line, ':', 1)) END) AS key, max(CASE WHEN k THEN trim(regexp_replace(line, '^[^:]*:', '')) END) AS head,
  string_agg(CASE WHEN NOT k AND regexp_matches(line, '^\s*- ') THEN regexp_replace(line, '^\s*- ', '') WHEN NOT k AND line LIKE '  %' THEN substr(line, 3) END, chr(10) ORDER BY pos) AS items FROM fg WHERE g > 0 GROUP BY 1, 2),
fields AS (SELECT note_id, key, CASE WHEN head IN ('|', '>') THEN 'block' WHEN head = '' AND items IS NOT NULL THEN 'list' ELSE 'scalar' END AS kind,
  CASE WHEN head IN ('|', '>') OR (head = '' AND items IS NOT NULL) THEN coalesce(items, '') ELSE regexp_replace(head, '^"+|"+$', '', 'g') END AS value FROM fv QUALIFY row_number() OVER (PARTITION BY note_id, key ORDER BY g DESC) = 1)"""


@query(f"WITH {_FIELDS} SELECT * FROM fields")
def front_matter_fields(spark, sf_dir):
    return structure.front_matter_fields(v.notes(spark, sf_dir))


@query(f"WITH {_LINES} SELECT note_id, trim(split_part(line, ':', 1)) AS key, trim(substr(line, strpos(line, ':') + 1)) AS value FROM fl WHERE contains(line, ':') QUALIFY row_number() OVER (PARTITION BY note_id, trim(split_part(line, ':', 1)) ORDER BY pos DESC) = 1")
def front_matter_kv(spark, sf_dir):
    return structure.front_matter_kv(v.notes(spark, sf_dir))


@query("""SELECT note_id, 'extra' AS key, concat('e', note_id) AS value FROM notes WHERE note_id % 19 = 0
UNION ALL SELECT note_id, 'title', 'other' FROM notes WHERE note_id % 19 = 0 AND note_id % 11 = 0""")
def front_matter_merge(spark, sf_dir):
    return structure.later_blocks(v.notes(spark, sf_dir))


_REF = "concat('[A', note_id % 50, '](http://x.org): ', replace(title, ',', ' '), ', and [B', note_id, ']: Full Item ', note_id % 40, ', end')"


@query(rf"""WITH r AS (SELECT note_id * 2 AS o, concat('A', note_id % 50) AS abbr, replace(title, ',', ' ') AS f FROM notes UNION ALL SELECT note_id * 2 + 1, concat('B', note_id), concat('Full Item ', note_id % 40) FROM notes),
n AS (SELECT o, abbr, trim(f) AS "full", trim(regexp_replace(lower(f), '[^a-z0-9]+', ' ', 'g')) AS norm FROM r)
SELECT norm, abbr, "full" FROM n QUALIFY row_number() OVER (PARTITION BY norm ORDER BY o) = 1""")
def ref_list(spark, sf_dir):
    return structure.reference_list(v.notes(spark, sf_dir).select(F.col("note_id").alias("id"), F.expr(_REF).alias("text")))


@query(f"""WITH {_FIELDS}, t AS (SELECT note_id, unnest(string_split(value, chr(10))) AS item, generate_subscripts(string_split(value, chr(10)), 1) - 1 AS pos FROM fields WHERE key = 'tags' AND kind = 'list')
SELECT note_id, pos, item FROM notes LEFT JOIN t USING (note_id)""")
def tag_rows(spark, sf_dir):
    return structure.list_rows(v.notes(spark, sf_dir)).withColumn("pos", F.col("pos").cast("bigint"))


@query("""SELECT row_id, 'exact' AS mode FROM ledger WHERE state = 'Wait' UNION ALL SELECT row_id, 'nocase' FROM ledger WHERE lower(state) = 'knowledge' UNION ALL SELECT row_id, 'prefix' FROM ledger WHERE lower(state) LIKE 'down%'""")
def state_filter(spark, sf_dir):
    rows = v.ledger(spark, sf_dir)
    part = lambda state, mode: audit.by_state(rows, state, mode).select("row_id", F.lit(mode).alias("mode"))
    return part("Wait", "exact").unionByName(part("knowledge", "nocase")).unionByName(part("DOWN", "prefix"))


@query(r"SELECT row_id FROM ledger WHERE trim(project_link) IN ('', 'UnknownVenue', 'UnknownYear', '-') OR regexp_matches(trim(project_link), '^\d+$')")
def placeholder_rows(spark, sf_dir):
    return v.ledger(spark, sf_dir).where(audit.is_placeholder(F.col("project_link"))).select("row_id")


_KEYS = f"{_LINES}, have AS (SELECT note_id, list(DISTINCT trim(split_part(line, ':', 1))) AS ks FROM fl WHERE regexp_matches(line, '^[^\\s#:\\-][^:]*:') GROUP BY 1)"
_MISSING = f"array_to_string(list_sort(list_filter({audit.REQUIRED_KEYS!r}, lambda x: NOT list_contains(coalesce(ks, []), x))), ',')"


@query(f"WITH {_KEYS} SELECT note_id, {_MISSING} AS missing FROM notes LEFT JOIN have USING (note_id)")
def missing_keys(spark, sf_dir):
    keys = audit.missing_keys(markdown.front_matter_keys(F.col("text")))
    return v.notes(spark, sf_dir).select("note_id", F.array_join(keys, ",").alias("missing"))


_FLAGS = r"""contains(text, '> [!abstract]') AS callout, regexp_matches(text, '(?m)^#+ Part I:') AS part_1, regexp_matches(text, '(?m)^#+ Part II:') AS part_2, regexp_matches(text, '(?m)^#+ Part III:') AS part_3,
contains(text, 'Local Reading') AS reading, regexp_matches(text, '(?m)^(.*\|.*%|.*%.*\|)') AS metrics, regexp_matches(text, '(?m)^pdf_ref:') AS pdf_ref"""


@query(f"WITH f AS (SELECT note_id, {_FLAGS} FROM notes) SELECT *, callout AND part_1 AND part_2 AND part_3 AND reading AND metrics AND pdf_ref AS ok FROM f")
def structure_flags(spark, sf_dir):
    c = F.col("text")
    return v.notes(spark, sf_dir).select("note_id", *[f.alias(n) for n, f in audit.structure_flags(c).items()], audit.verdict(c).alias("ok"))


@query(r"""SELECT note_id, concat_ws(',', CASE WHEN NOT contains(text, 'Part I') THEN 'Part I' END, CASE WHEN NOT contains(text, 'Part III') THEN 'Part III' END) AS plain,
concat_ws(',', CASE WHEN NOT contains(lower(text), 'part i:') THEN 'Part I' END, CASE WHEN NOT contains(lower(text), 'part iii:') THEN 'Part III' END) AS with_colon,
concat_ws(',', CASE WHEN NOT regexp_matches(text, '(?i)\bPart\s*I\b') THEN 'Part I' END, CASE WHEN NOT regexp_matches(text, '(?i)\bPart\s*III\b') THEN 'Part III' END) AS by_words FROM notes""")
def missing_parts(spark, sf_dir):
    marks = ["Part I", "Part III"]
    each = lambda mode: F.array_join(audit.missing_markers(F.col("text"), marks, mode), ",")
    return v.notes(spark, sf_dir).select("note_id", each("contains").alias("plain"), each("colon").alias("with_colon"), each("regex").alias("by_words"))


_REASONS = rf"""{_KEYS}, r AS (SELECT note_id, text, title, {_MISSING} AS mk, regexp_matches(text, '{_FRONT}') AS fm, regexp_extract(text, '(?m)^# (.+)$', 1) AS h FROM notes LEFT JOIN have USING (note_id)),
u AS (SELECT note_id, 1 AS o, 'no front matter' AS reason FROM r WHERE NOT fm UNION ALL SELECT note_id, 2, concat('missing keys: ', mk) FROM r WHERE fm AND mk <> '' UNION ALL SELECT note_id, 5, 'no quick links' FROM r WHERE NOT contains(text, '**Links**')
UNION ALL SELECT note_id, 4, 'heading without title' FROM r WHERE NOT contains(lower(h), lower(title))
UNION ALL SELECT note_id, 6, 'missing parts: Part III' FROM r WHERE NOT regexp_matches(text, '(?i)\bPart\s*III\b'))"""


@query(f"WITH {_REASONS} SELECT note_id, reason FROM u")
def audit_reasons(spark, sf_dir):
    return v.notes(spark, sf_dir).select("note_id", F.explode(audit.audit_reasons(F.col("text"), F.col("title"))).alias("reason"))


_GAPS = f"""f AS (SELECT note_id, {_FLAGS} FROM notes), g AS (SELECT note_id, concat_ws(', ', CASE WHEN NOT callout THEN 'callout' END, CASE WHEN NOT part_1 THEN 'part_1' END, CASE WHEN NOT part_2 THEN 'part_2' END,
CASE WHEN NOT part_3 THEN 'part_3' END, CASE WHEN NOT reading THEN 'reading' END, CASE WHEN NOT metrics THEN 'metrics' END, CASE WHEN NOT pdf_ref THEN 'pdf_ref' END) AS l FROM f)"""


@query(f"""WITH {_GAPS}
SELECT row_id, CASE WHEN l IS NULL THEN 'no_markdown' WHEN l = '' THEN 'ok' ELSE concat('structure_or_depth: ', l) END AS gap FROM ledger LEFT JOIN notes ON title = paper_title LEFT JOIN g USING (note_id)""")
def gap_reason(spark, sf_dir):
    notes = v.notes(spark, sf_dir).select(F.col("title").alias("paper_title"), "text")
    return v.ledger(spark, sf_dir).join(notes, "paper_title", "left").select("row_id", audit.describe_gaps(F.col("text")).alias("gap"))


_TOKENS = r"list_distinct(list_filter(string_split_regex(lower({}), '\s+'), lambda x: regexp_matches(x, '^[\p{{L}}\p{{N}}]+$')))"
_J = "CASE WHEN len({a}) = 0 OR len({b}) = 0 THEN 0 ELSE len(list_intersect({a}, {b})) / (len({a}) + len({b}) - len(list_intersect({a}, {b}))) END"


@query(rf"""WITH b AS (SELECT note_id, CASE WHEN note_id % 41 = 0 THEN ' ' WHEN note_id % 7 = 3 THEN concat(title, chr(10), documents.text) ELSE documents.text END AS src, CASE WHEN regexp_matches(notes.text, '{_FRONT}') THEN regexp_replace(notes.text, '{_FRONT}', '') ELSE notes.text END AS body,
trim(trim(regexp_extract(regexp_extract(notes.text, '{_FRONT}', 1), '(?m)^title:([^\n]*)', 1)), '"') AS tv FROM notes JOIN documents ON doc_id = note_id),
c AS (SELECT *, array_to_string(list_filter(string_split(body, chr(10)), lambda x: contains(x, 'Summary') OR contains(lower(x), 'abstract')), chr(10)) AS sm FROM b),
s AS (SELECT note_id, src, tv, sm, {_TOKENS.format('tv')} AS t, {_TOKENS.format('sm')} AS m, {_TOKENS.format("array_to_string(string_split(src, chr(10))[1:5], ' ')")} AS f, {_TOKENS.format('src')} AS a FROM c)
SELECT note_id, CASE WHEN trim(src) = '' THEN 'empty source' ELSE nullif(concat_ws(', ', CASE WHEN tv <> '' AND {_J.format(a='t', b='f')} < 0.2 THEN 'title mismatch' END, CASE WHEN sm <> '' AND {_J.format(a='m', b='a')} < 0.05 THEN 'summary mismatch' END), '') END AS reason FROM s""")
def content_mismatch(spark, sf_dir):
    """Some sources are blank or begin with the title."""
    source = "CASE WHEN note_id % 41 = 0 THEN ' ' WHEN note_id % 7 = 3 THEN concat(title, chr(10), source) ELSE source END"
    docs = v.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("note_id"), F.col("text").alias("source"))
    title = F.trim(F.regexp_replace(F.trim(F.regexp_extract(markdown.front_matter(F.col("text")), r"(?m)^title:([^\n]*)", 1)), '^"+|"+$', ""))
    reason = audit.content_mismatch(title, markdown.summary_text(F.col("text")), F.expr(source))
    return v.notes(spark, sf_dir).join(docs, "note_id").select("note_id", reason.alias("reason"))


_LINK_OF = r"\*\*Links\*\*: \[[^\]]*\]\(([^)]*)\)"


@query(rf"""WITH {_TIERS}, p AS (SELECT row_id, paper_title AS a1, n.title AS b1, trim(regexp_replace(l.venue, '\d{{4}}$', '')) AS a2, n.venue AS b2, right(l.venue, 4) AS a3, n.year::VARCHAR AS b3, l.project_link AS a4, nullif(regexp_extract(n.text, '{_LINK_OF}', 1), '') AS b4
FROM tiered JOIN ledger l USING (row_id) JOIN notes n USING (note_id)), f AS (SELECT row_id, unnest(['title', 'venue', 'year', 'link']) AS field, unnest([a1, a2, a3, a4]) AS ledger_value, unnest([b1, b2, b3, b4]) AS note_value FROM p)
SELECT * FROM f WHERE ledger_value IS DISTINCT FROM note_value""")
def field_diff(spark, sf_dir):
    """Title, venue, year and link of each row beside those of its note, found by tiers."""
    notes, ledger = v.notes(spark, sf_dir), v.ledger(spark, sf_dir)
    linked = linkage.link_tiered(ledger.select("row_id", F.col("paper_title").alias("title")), notes).where("note_id is not null")
    theirs = linked.select("row_id", "note_id").join(notes.withColumn("link", F.nullif(F.regexp_extract("text", _LINK_OF, 1), F.lit(""))), "note_id")
    ours = ledger.select("row_id", F.col("paper_title").alias("title"), textnorm.venue_of(F.col("venue")).alias("venue"), textnorm.year_of(F.col("venue")).alias("year"), F.col("project_link").alias("link"))
    return audit.field_diff(ours, theirs, "row_id", {c: c for c in ("title", "venue", "year", "link")})


@query("SELECT note_id, title, path FROM notes WHERE venue = 'ICLR' AND category = 'Cat_en' AND note_id % 11 <> 0 AND contains(lower(text), 'the')")
def kb_search(spark, sf_dir):
    notes = v.notes(spark, sf_dir)
    tags = structure.list_rows(notes).groupBy("note_id").agg(F.collect_list("item").alias("tags"))
    found = audit.search_notes(notes.join(tags, "note_id"), tag="Cat_en", venue="ICLR", text="The")
    return found.select("note_id", "title", "path")
