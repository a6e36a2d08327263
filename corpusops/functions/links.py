"""Links and identifiers on pages, and what to fetch, as column functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def page_links(html: Column, suffix: str = "") -> Column:
    """href values with the suffix, then plain web addresses with it, each once, in order; case doesn't count."""
    end = suffix.replace(".", r"\.")
    href = F.regexp_extract_all(html, F.lit(rf"""(?i)href=["']([^"']*{end})["']"""), F.lit(1))
    raw = F.regexp_extract_all(html, F.lit(rf"""(?i)(https?://[^\s"'<>]+{end})"""), F.lit(1))
    return F.array_distinct(F.concat(href, raw))


def absolute_url(link: Column, page_url: Column) -> Column:
    site = F.regexp_extract(page_url, r"^(https?://[^/]+)", 1)
    return F.when(link.startswith("http"), link).when(link.startswith("/"), F.concat(site, link)).otherwise(F.concat(site, F.lit("/"), link))


DOI = r"""(10\.\d{4,9}/[^"'\s<>]+)"""
ARXIV = r"arxiv\.org/(?:abs|pdf)/(\d{4}\.\d{4,5})"
IEEE = r"ieee\.org/document/(\d+)"


def doi(text: Column) -> Column:
    return F.nullif(F.regexp_replace(F.regexp_extract(text, DOI, 1), r"\.+$", ""), F.lit(""))


def arxiv_id(text: Column) -> Column:
    return F.nullif(F.regexp_extract(F.lower(text), ARXIV, 1), F.lit(""))


def ieee_number(text: Column) -> Column:
    return F.nullif(F.regexp_extract(F.lower(text), IEEE, 1), F.lit(""))


def meta_content(html: Column, name: str) -> Column:
    return F.nullif(F.trim(F.regexp_extract(html, rf"""(?i)<meta[^>]*name=["']{name}["'][^>]*content=["']([^"']+)["']""", 1)), F.lit(""))


def first_candidate(html: Column, suffix: str, page_url: Column | None = None, meta_first: bool = False) -> Column:
    """First link with the suffix, absolute where the page's address is given, else the page's paper link, else its DOI as a web address, else a DOI in the text as one.

    meta_first: the paper link comes before other links, as for a page that a browser has rendered.
    """
    link = F.get(page_links(html, suffix), 0)
    link = link if page_url is None else F.when(link.isNotNull(), absolute_url(link, page_url))
    steps = [link, meta_content(html, "citation_pdf_url")]
    return F.coalesce(
        *(steps[::-1] if meta_first else steps),
        F.concat(F.lit("https://doi.org/"), meta_content(html, "citation_doi")),
        F.concat(F.lit("https://doi.org/"), doi(html)),
    )


def pick_ledger_url(project: Column, pdf: Column) -> Column:
    """First candidate with ``.pdf``, else the first; the project link comes first, and counts only with ``.pdf``."""
    both = F.array_compact(F.array(F.when(project.startswith("http") & project.contains(".pdf"), project), F.when(pdf.startswith("http"), pdf)))
    return F.coalesce(F.get(F.filter(both, lambda x: x.contains(".pdf")), 0), F.get(both, 0))


#: Where sites keep a paper.
SITE_PATHS = ["paper.pdf", "assets/paper.pdf", "static/paper.pdf", "pdf/paper.pdf", "files/paper.pdf", "resources/paper.pdf", "main.pdf"]


def site_paths(url: Column, paths: list[str] | None = None) -> Column:
    """Addresses to probe, for a web address; none for anything else."""
    base = F.concat(F.regexp_extract(url, r"^(https?://[^/]+)", 1), F.lit("/"))
    return F.when(url.startswith("http"), F.transform(F.array(*map(F.lit, paths or SITE_PATHS)), lambda p: F.concat(base, p)))


def classify_fetch(status: Column, content_type: Column) -> Column:
    kind = F.coalesce(content_type, F.lit(""))
    return (
        F.when(status.isin(401, 403), F.lit("paywalled"))
        .when((status == 200) & F.lower(kind).contains("pdf"), F.lit("downloaded"))
        .when(status == 200, F.concat(F.lit("non-pdf content-type="), kind))
        .otherwise(F.concat(F.lit("status "), status.cast("string")))
    )


def link_label(url: Column) -> Column:
    return F.when(F.lower(url).contains("github.com"), F.lit("GitHub")).otherwise(F.lit("Project"))


def valid_link(url: Column) -> Column:
    """Not empty, a hyphen or digits alone; false for null."""
    return F.coalesce(~F.trim(url).rlike(r"^(?:-|\d*)$"), F.lit(False))


def target_path(topic: Column, venue: Column, title: Column) -> Column:
    from corpusops.functions.textnorm import safe_name

    year = F.coalesce(F.nullif(F.regexp_extract(venue, r"((?:19|20)\d{2})", 1), F.lit("")), F.lit("unknown"))
    return F.concat(safe_name(topic), F.lit("/"), safe_name(venue), F.lit("/"), year, F.lit("_"), safe_name(title), F.lit(".pdf"))


def triage(text: Column, terms: list[str]) -> Column:
    """``Wait`` where one of the terms is in the text, in any case, else ``Skip``."""
    return F.when(F.exists(F.array(*map(F.lit, terms)), lambda t: F.lower(text).contains(F.lower(t))), F.lit("Wait")).otherwise(F.lit("Skip"))
