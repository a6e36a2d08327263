"""Normalisation, parsing and links (groups B, C and D)."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusops import views as v
from corpusops.functions import links, markdown, textnorm
from corpusops.operators import similarity
from corpusops.queries.base import query

T = textnorm


@query("SELECT doc_id AS id, trim(regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g')) AS norm FROM documents UNION ALL SELECT -p_partkey, trim(regexp_replace(lower(p_name), '[^a-z0-9]+', ' ', 'g')) FROM part", views=False)
def norm_title(spark, sf_dir):
    docs = v.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), T.norm_title(F.col("text")).alias("norm"))
    return docs.unionByName(v.table(spark, sf_dir, "part").select((-F.col("p_partkey")).alias("id"), T.norm_title(F.col("p_name")).alias("norm")))


@query(r"""SELECT doc_id, trim(lower(regexp_replace(regexp_replace(regexp_replace(text, '[\s:,\-–—]+', ' ', 'g'), '[^\p{L}\p{M}\p{N}\p{Pc}\s]', '', 'g'), '\s+', ' ', 'g'))) AS norm FROM documents""", views=False)
def norm_fuzzy(spark, sf_dir):
    return v.table(spark, sf_dir, "documents").select("doc_id", T.norm_fuzzy(F.col("text")).alias("norm"))


@query()
def norm_nfkd(spark, sf_dir):
    return v.notes(spark, sf_dir).select("note_id", T.norm_nfkd(F.col("text")).alias("norm"))


@query(r"""WITH s AS (SELECT note_id, regexp_replace(trim(regexp_replace(regexp_replace(title, '[\s:]+', ' ', 'g'), '[\\/:*?"<>|]', '', 'g')), ' +', '_', 'g') AS t FROM notes)
SELECT note_id, CASE WHEN length(t) > 40 THEN regexp_replace(substr(t, 1, 39), '_+$', '') ELSE t END AS slug FROM s""")
def slug(spark, sf_dir):
    return v.notes(spark, sf_dir).select("note_id", T.slug(F.col("title"), 40).alias("slug"))


@query(r"""SELECT note_id, substr(regexp_replace(trim(regexp_replace(title, '[\\/:*?"<>|]+', '', 'g')), '\s+', '_', 'g'), 1, 200) AS name FROM notes""")
def safe_name(spark, sf_dir):
    return v.notes(spark, sf_dir).select("note_id", T.safe_name(F.col("title")).alias("name"))


@query(r"""SELECT doc_id, regexp_replace(regexp_replace(text, '[^\p{L}\p{N}]+', '_', 'g'), '^_+|_+$', '', 'g') AS name FROM documents""", views=False)
def sanitize_title(spark, sf_dir):
    return v.table(spark, sf_dir, "documents").select("doc_id", T.sanitize_title(F.col("text")).alias("name"))


@query(r"""SELECT row_id, trim(split_part(paper_title, ':', 1)) AS head, CASE WHEN contains(paper_title, ':') THEN trim(substr(paper_title, strpos(paper_title, ':') + 1)) ELSE '' END AS tail,
regexp_replace(regexp_extract(pdf_path, '([^/]*)$', 1), '^\d{4}_', '') AS name FROM ledger""")
def title_parts(spark, sf_dir):
    c = F.col("paper_title")
    name = T.strip_year_prefix(F.regexp_extract("pdf_path", "([^/]*)$", 1))
    return v.ledger(spark, sf_dir).select("row_id", T.head_of(c).alias("head"), T.tail_of(c).alias("tail"), name.alias("name"))


_ABBR = "CASE note_id % 3 WHEN 0 THEN concat('[A', note_id, '](http://x.org/', note_id, '): ', title) WHEN 1 THEN concat('[A', note_id, '] ', title) ELSE title END"


@query(rf"""WITH s AS (SELECT note_id, {_ABBR} AS t FROM notes)
SELECT note_id, CASE WHEN contains(t, '：') OR t NOT LIKE '[%' THEN t ELSE regexp_replace(t, '^\[([^\]]+)\](?:\([^)]*\))?:?\s*(.+)$', '\1：\2') END AS title FROM s""")
def abbr_title(spark, sf_dir):
    return v.notes(spark, sf_dir).select("note_id", T.abbr_title(F.expr(_ABBR)).alias("title"))


@query(r"""SELECT row_id, regexp_extract(venue, '^([A-Za-z ]*?)\s*(\d{4})$', 1) AS venue, regexp_extract(venue, '^([A-Za-z ]*?)\s*(\d{4})$', 2) AS year, regexp_replace(venue, '\D+', '', 'g') AS digits FROM ledger""")
def venue_year(spark, sf_dir):
    c = F.col("venue")
    return v.ledger(spark, sf_dir).select("row_id", T.venue_of(c).alias("venue"), T.year_of(c).alias("year"), T.digits_of(c).alias("digits"))


_WHITELIST = ["CVPR", "ICLR"]


@query(r"""WITH f AS (SELECT note_id, split_part(path, '/', 2) AS f FROM notes), p AS (SELECT note_id, replace(regexp_extract(f, '^(.+)_(\d{4})$', 1), '_', ' ') AS b, regexp_extract(f, '^(.+)_(\d{4})$', 2) AS y FROM f)
SELECT note_id, CASE WHEN y <> '' THEN b END AS venue, CASE WHEN y <> '' THEN CASE WHEN b IN ('CVPR', 'ICLR') THEN b ELSE concat(b, ' ', y) END END AS listed_venue, nullif(y, '') AS year FROM p""")
def venue_year_path(spark, sf_dir):
    c = F.col("path")
    return v.notes(spark, sf_dir).select("note_id", T.folder_venue(c).alias("venue"), T.folder_venue(c, _WHITELIST).alias("listed_venue"), T.folder_year(c).alias("year"))


@query(r"""SELECT note_id, concat('pdfs/', path[:-4], '.pdf') AS to_pdf, concat(substr(pdf, 6, length(pdf) - 9), '.md') AS to_note, regexp_replace(path, '/[^/]*$', '') AS folder,
regexp_replace(regexp_extract(path, '([^/]*)$', 1), '\.md$', '') AS stem, replace(concat('pdfs/', path[:-4], '.pdf'), '-', ' ') AS spaced, category AS category_folder FROM notes""")
def path_map(spark, sf_dir):
    p = F.col("path")
    return v.notes(spark, sf_dir).select(
        "note_id", T.note_to_pdf(p).alias("to_pdf"), T.pdf_to_note(F.col("pdf")).alias("to_note"), T.folder_of(p).alias("folder"), T.stem_of(p).alias("stem"),
        F.replace(T.note_to_pdf(p), F.lit("-"), F.lit(" ")).alias("spaced"), T.category_folder(F.replace("category", F.lit("_"), F.lit(" "))).alias("category_folder"),
    )


_TOK = r"list_distinct(list_filter(string_split_regex(lower({}), '\s+'), lambda x: regexp_matches(x, '^[\p{{L}}\p{{N}}]+$')))"


@query(rf"""WITH t AS (SELECT doc_id, unnest({_TOK.format('text')}) AS w FROM documents), b AS (SELECT item_id, unnest({_TOK.format('text')}) AS w FROM benchmark),
tn AS (SELECT doc_id, count(*) AS n FROM t GROUP BY 1), bn AS (SELECT item_id, count(*) AS n FROM b GROUP BY 1), s AS (SELECT doc_id, item_id, count(*) AS n FROM t JOIN b USING (w) GROUP BY 1, 2)
SELECT item_id, doc_id, s.n AS shared, round(s.n / (tn.n + bn.n - s.n), 9) AS score FROM s JOIN tn USING (doc_id) JOIN bn USING (item_id) WHERE s.n / (tn.n + bn.n - s.n) >= 0.2""", views=False)
def jaccard(spark, sf_dir):
    """Documents and benchmark items whose tokens are alike by a fifth."""
    docs = v.table(spark, sf_dir, "documents").select("doc_id", T.tokens(F.col("text")).alias("t"))
    items = v.table(spark, sf_dir, "benchmark").select("item_id", T.tokens(F.col("text")).alias("t"))
    pairs = similarity.similar_sets(docs, items, 0.2)
    score = F.col("shared") / (F.col("n") + F.col("m") - F.col("shared"))
    return pairs.select(F.col("b").alias("item_id"), F.col("a").alias("doc_id"), F.col("shared").cast("bigint").alias("shared"), F.round(score, 9).alias("score"))


_FRONT = r"(?s)\A---\n(.*?\n)?---(?:\n|\z)"


@query(rf"""SELECT note_id, regexp_matches(text, '{_FRONT}') AS has_fm, regexp_extract(text, '{_FRONT}', 1) AS front, CASE WHEN regexp_matches(text, '{_FRONT}') THEN regexp_replace(text, '{_FRONT}', '') ELSE text END AS body FROM notes""")
def front_matter_split(spark, sf_dir):
    c = F.col("text")
    return v.notes(spark, sf_dir).select("note_id", markdown.has_front_matter(c).alias("has_fm"), markdown.front_matter(c).alias("front"), markdown.body(c).alias("body"))


@query(r"""SELECT note_id, nullif(trim(regexp_extract(text, '(?m)^# (.+)$', 1)), '') AS heading,
trim(regexp_replace(trim(list_filter(string_split(text, chr(10)), lambda x: trim(x) <> '')[1]), '^#+', '')) AS header_line FROM notes""")
def first_heading(spark, sf_dir):
    c = F.col("text")
    return v.notes(spark, sf_dir).select("note_id", markdown.first_heading(c).alias("heading"), markdown.first_header_line(c).alias("header_line"))


@query(r"""WITH p AS (SELECT note_id, regexp_extract(text, '(?m)^title: (.+)$', 1) AS t, regexp_extract(text, '(?m)^# (.+)$', 1) AS h, replace(regexp_replace(regexp_extract(path, '([^/]*)\.md$', 1), '^\d{4}_', ''), '_', ' ') AS s FROM notes)
SELECT note_id, CASE note_id % 3 WHEN 0 THEN coalesce(nullif(regexp_replace(t, '^"+|"+$', '', 'g'), ''), h) WHEN 1 THEN h ELSE trim(s) END AS title FROM p""")
def title_resolve(spark, sf_dir):
    none = F.lit("")
    front = F.regexp_extract("text", r"(?m)^title: (.+)$", 1)
    third = F.col("note_id") % 3
    return v.notes(spark, sf_dir).select("note_id", markdown.resolve_title(
        F.when(third == 0, front).otherwise(none), F.when(third < 2, markdown.first_heading(F.col("text"))).otherwise(none), F.col("path")
    ).alias("title"))


@query(r"""WITH l AS (SELECT note_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM notes),
h AS (SELECT note_id, pos, line LIKE '#%' AS head, line LIKE '#%Part II:%' AS mine, line FROM l), s AS (SELECT note_id, min(pos) AS a FROM h WHERE mine GROUP BY 1),
e AS (SELECT h.note_id, a, coalesce(min(pos), 1000000) AS b FROM s LEFT JOIN h ON h.note_id = s.note_id AND head AND pos > a GROUP BY h.note_id, a),
t AS (SELECT e.note_id, string_agg(line, chr(10) ORDER BY pos) AS x FROM e JOIN h ON h.note_id = e.note_id AND pos > a AND pos < b GROUP BY 1)
SELECT note_id, coalesce(trim(regexp_replace(x, '\A\n+|\n+\z', '', 'g')), '') AS section FROM notes LEFT JOIN t USING (note_id)""")
def section_text(spark, sf_dir):
    return v.notes(spark, sf_dir).select("note_id", markdown.section_text(F.col("text"), "Part II:").alias("section"))


@query(r"""SELECT note_id, regexp_extract(text, '(?m)^> \[!abstract\][^\n]*(?:\n>[^\n]*)*') AS callout, strpos(text, '> [!abstract]') AS place FROM notes""")
def callout_block(spark, sf_dir):
    return v.notes(spark, sf_dir).select("note_id", markdown.callout_block(F.col("text")).alias("callout"), F.locate("> [!abstract]", F.col("text")).cast("bigint").alias("place"))


#: Of a table with text: columns pos and l, the lines that aren't blank from the first "the " on.
_LINES_FROM = "strpos(lower(text), 'the ') AS pos, list_filter(list_transform(string_split(substr(text, strpos(lower(text), 'the '), 2000), chr(10)), lambda x: trim(x)), lambda x: x <> '') AS l"
_ABSTRACT = "CASE WHEN pos > 0 THEN array_to_string(CASE WHEN starts_with(lower(l[1]), 'the') THEN l[2:7] ELSE l[1:6] END, ' ') ELSE '' END"


@query(f"WITH p AS (SELECT doc_id, {_LINES_FROM} FROM documents) SELECT doc_id, {_ABSTRACT} AS abstract FROM p", views=False)
def abstract_extract(spark, sf_dir):
    return v.table(spark, sf_dir, "documents").select("doc_id", markdown.extract_abstract(F.col("text"), "the ").alias("abstract"))


_ASCII = r"regexp_replace(text, '[^\x00-\x7F]+', ' '{})"


_NUMBERS = rf"regexp_extract_all({_ASCII.format(", 'g'")}, '\b\d+(?:\.\d+)?\b')[1:3]"


@query(f"SELECT doc_id, array_to_string({_NUMBERS}, ',') AS numbers FROM documents", views=False)
def number_signals(spark, sf_dir):
    plain = F.regexp_replace("text", r"[^\x00-\x7F]+", " ")
    return v.table(spark, sf_dir, "documents").select("doc_id", F.array_join(markdown.extract_numbers(plain), ",").alias("numbers"))


@query(r"SELECT doc_id, regexp_matches(text, '\d') AS has_number FROM documents", views=False)
def numeric_flag(spark, sf_dir):
    return v.table(spark, sf_dir, "documents").select("doc_id", markdown.has_numeric_signal(F.col("text")).alias("has_number"))


@query(r"SELECT note_id, unnest(regexp_extract_all(text, '\[\[([^\]|]+)', 1)) AS target FROM notes")
def wikilink_edges(spark, sf_dir):
    return v.notes(spark, sf_dir).select("note_id", F.explode(markdown.wikilinks(F.col("text"))).alias("target"))


@query(r"""SELECT note_id, regexp_replace(regexp_replace(regexp_replace(text, '!\[\[[^\]]*\]\]', '', 'g'), '\[\[[^\]|]*\|([^\]]*)\]\]', '\1', 'g'), '\[\[(?:[^\]|]*/)?([^\]|/]*)\]\]', '\1', 'g') AS shared FROM notes""")
def share_text(spark, sf_dir):
    return v.notes(spark, sf_dir).select("note_id", markdown.strip_internal_links(F.col("text")).alias("shared"))


_HREF, _RAW = r"""(?i)href=["'']([^"'']*)["'']""", r"""((?i:https?://)[^\s"''<>]+)"""


@query(rf"""WITH a AS (SELECT page_id, regexp_extract_all(html, '{_HREF}', 1) || regexp_extract_all(html, '{_RAW}', 1) AS l FROM pages),
e AS (SELECT page_id, unnest(l) AS link, generate_subscripts(l, 1) AS pos FROM a), f AS (SELECT page_id, link, min(pos) AS pos FROM e GROUP BY 1, 2)
SELECT page_id, link, row_number() OVER (PARTITION BY page_id ORDER BY pos) - 1 AS place FROM f""", views=False)
def page_links(spark, sf_dir):
    return v.table(spark, sf_dir, "pages").select("page_id", F.posexplode(links.page_links(F.col("html"))).alias("place", "link")).select("page_id", "link", F.col("place").cast("bigint").alias("place"))


@query(rf"""WITH a AS (SELECT page_id, url, unnest(regexp_extract_all(html, '{_HREF}', 1)) AS link FROM pages)
SELECT DISTINCT page_id, CASE WHEN link LIKE 'http%' THEN link WHEN link LIKE '/%' THEN concat(regexp_extract(url, '^(https?://[^/]+)', 1), link) ELSE concat(regexp_extract(url, '^(https?://[^/]+)', 1), '/', link) END AS link FROM a""", views=False)
def page_links_abs(spark, sf_dir):
    pages = v.table(spark, sf_dir, "pages").select("page_id", "url", F.explode(F.regexp_extract_all("html", F.lit("""href=["']([^"']*)["']"""), F.lit(1))).alias("link"))
    return pages.select("page_id", links.absolute_url(F.col("link"), F.col("url")).alias("link")).distinct()


#: Fixture: pages with each kind of mark, or none.
_MARKED = """CASE page_id % 7 WHEN 0 THEN concat(html, '<a href="files/p', page_id, '.PDF">') WHEN 1 THEN concat(html, '<META NAME="citation_pdf_url" x CONTENT="https://c.example.org/', page_id, '">')
WHEN 2 THEN concat(html, '<meta name="citation_doi" content=" 10.1145/', page_id, ' ">') WHEN 3 THEN concat(html, ' doi 10.1000/x(', page_id, ').') WHEN 4 THEN concat(html, ' var u = "https://d.example.org/', page_id, '.pdf"<meta name="citation_pdf_url" content="later">')
WHEN 5 THEN concat(html, '<a href="/root/', page_id, '.pdf">') ELSE html END"""
_META = r"""nullif(trim(regexp_extract(h, '(?i)<meta[^>]*name=["'']{}["''][^>]*content=["'']([^"'']+)["'']', 1)), '')"""


@query(rf"""WITH p AS (SELECT page_id, url, {_MARKED} AS h FROM pages), q AS (SELECT *, (regexp_extract_all(h, '(?i)href=["'']([^"'']*\.pdf)["'']', 1) || regexp_extract_all(h, '(?i)(https?://[^\s"''<>]+\.pdf)', 1))[1] AS l, regexp_extract(url, '^(https?://[^/]+)', 1) AS site FROM p),
a AS (SELECT page_id, h, CASE WHEN l LIKE 'http%' THEN l WHEN l LIKE '/%' THEN concat(site, l) WHEN l IS NOT NULL THEN concat(site, '/', l) END AS link, {_META.format('citation_pdf_url')} AS meta,
coalesce(concat('https://doi.org/', nullif({_META.format('citation_doi')}, '')), NULL) AS md, nullif(regexp_replace(regexp_extract(h, '(10\.\d{{4,9}}/[^"''\s<>]+)', 1), '\.+$', ''), '') AS td FROM q)
SELECT page_id, coalesce(link, meta, CASE WHEN {_META.format('citation_doi')} IS NOT NULL THEN md END, CASE WHEN td IS NOT NULL THEN concat('https://doi.org/', td) END) AS candidate,
coalesce(meta, link, CASE WHEN {_META.format('citation_doi')} IS NOT NULL THEN md END, CASE WHEN td IS NOT NULL THEN concat('https://doi.org/', td) END) AS rendered FROM a""", views=False)
def page_candidate(spark, sf_dir):
    pages = v.table(spark, sf_dir, "pages").select("page_id", "url", F.expr(_MARKED).alias("html"))
    pick = lambda **more: links.first_candidate(F.col("html"), ".pdf", F.col("url"), **more)
    return pages.select("page_id", pick().alias("candidate"), pick(meta_first=True).alias("rendered"))


_IDS = "CASE note_id % 4 WHEN 0 THEN concat('see doi 10.1145/', note_id, '.77.') WHEN 1 THEN concat('https://arxiv.org/abs/2401.', 10000 + note_id % 80000) WHEN 2 THEN concat('https://ieeexplore.ieee.org/document/', note_id) ELSE title END"


@query(rf"""WITH s AS (SELECT note_id, {_IDS} AS t FROM notes) SELECT note_id, nullif(regexp_replace(regexp_extract(t, '(10\.\d{{4,9}}/[^"''\s<>]+)', 1), '\.+$', ''), '') AS doi,
nullif(regexp_extract(lower(t), 'arxiv\.org/(?:abs|pdf)/(\d{{4}}\.\d{{4,5}})', 1), '') AS arxiv, nullif(regexp_extract(lower(t), 'ieee\.org/document/(\d+)', 1), '') AS ieee FROM s""")
def id_extract(spark, sf_dir):
    c = F.expr(_IDS)
    return v.notes(spark, sf_dir).select("note_id", links.doi(c).alias("doi"), links.arxiv_id(c).alias("arxiv"), links.ieee_number(c).alias("ieee"))


@query("""SELECT row_id, CASE WHEN paper_link LIKE 'http%' THEN paper_link WHEN project_link LIKE 'http%.pdf%' THEN project_link END AS url FROM ledger""")
def url_pick(spark, sf_dir):
    return v.ledger(spark, sf_dir).select("row_id", links.pick_ledger_url(F.col("project_link"), F.col("paper_link")).alias("url"))


@query(f"""SELECT page_id, concat(regexp_extract(url, '^(https?://[^/]+)', 1), '/', p) AS url FROM pages, (SELECT unnest({links.SITE_PATHS!r}) AS p) WHERE url LIKE 'http%'""", views=False)
def site_paths(spark, sf_dir):
    return v.table(spark, sf_dir, "pages").select("page_id", F.explode(links.site_paths(F.col("url"))).alias("url"))


@query("""SELECT url, CASE WHEN status_code IN (401, 403) THEN 'paywalled' WHEN status_code = 200 AND content_type LIKE '%pdf%' THEN 'downloaded' WHEN status_code = 200 THEN concat('non-pdf content-type=', content_type) ELSE concat('status ', status_code) END AS outcome FROM fetch_results""")
def fetch_class(spark, sf_dir):
    return v.fetch_results(spark, sf_dir).select("url", links.classify_fetch(F.col("status_code"), F.col("content_type")).alias("outcome"))


@query(r"""SELECT row_id, CASE WHEN contains(lower(project_link), 'github.com') THEN 'GitHub' ELSE 'Project' END AS label, NOT regexp_matches(trim(project_link), '^(?:-|\d*)$') AS valid FROM ledger""")
def link_label(spark, sf_dir):
    c = F.col("project_link")
    return v.ledger(spark, sf_dir).select("row_id", links.link_label(c).alias("label"), links.valid_link(c).alias("valid"))


_SAFE = r"""substr(regexp_replace(trim(regexp_replace({}, '[\\/:*?"<>|]+', '', 'g')), '\s+', '_', 'g'), 1, 200)"""


@query(rf"""SELECT row_id, concat({_SAFE.format('sort')}, '/', {_SAFE.format('venue')}, '/', regexp_extract(venue, '((?:19|20)\d{{2}})', 1), '_', {_SAFE.format('paper_title')}, '.pdf') AS path FROM ledger""")
def target_path(spark, sf_dir):
    return v.ledger(spark, sf_dir).select("row_id", links.target_path(F.col("sort"), F.col("venue"), F.col("paper_title")).alias("path"))


@query("SELECT row_id, CASE WHEN contains(lower(paper_title), 'the ') OR contains(lower(paper_title), ' der ') THEN 'Wait' ELSE 'Skip' END AS decision FROM ledger")
def triage(spark, sf_dir):
    return v.ledger(spark, sf_dir).select("row_id", links.triage(F.col("paper_title"), ["The ", " der "]).alias("decision"))
