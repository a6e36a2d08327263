"""Notes, ledger, tag aliases, file listing and fetch results as views over the given tables.

Each view is a list of projection steps over one table. The steps are plain expressions that Spark and DuckDB both
read, so a query and its counterpart start from the same rows.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Dialect:
    """Where the two engines' expressions differ."""

    duck: bool

    def replace(self, value: str, pattern: str, by: str = "") -> str:
        if self.duck:
            return f"regexp_replace({value}, '{pattern}', '{by}', 'g')"
        return f"regexp_replace({value}, r'{pattern}', '{by}')"

    def whole(self, a: str, b: int) -> str:
        return f"({a} // {b})" if self.duck else f"({a} div {b})"

    def start(self, value: str) -> str:
        """Enough of value for what its first 60 letters and digits tell: Spark stops there, at the 61st, and doesn't go through the whole text."""
        return value if self.duck else f"regexp_extract({value}, r'\\A(?:[^A-Za-z0-9]*+[A-Za-z0-9]){{0,61}}', 0)"

    def once(self, value: str) -> str:
        """value as a row's own column: Spark moves filters below a projection and writes its expressions out in each of their terms, but not below a generator."""
        return value if self.duck else f"explode(array({value}))"


SPARK, DUCK = Dialect(False), Dialect(True)


def _notes(d: Dialect) -> list[list[str]]:
    head = f"trim(substr(trim({d.replace(d.start('text'), '[^A-Za-z0-9]+', ' ')}), 1, 60))"
    plain = d.replace("text", r"[#>|\-*]", "")
    return [
        [
            "doc_id AS k", "lang", f"{d.once(head)} AS head", f"{plain} AS plain", "2020 + doc_id % 6 AS year",
            "CASE doc_id % 4 WHEN 0 THEN 'CVPR' WHEN 1 THEN 'ICLR' WHEN 2 THEN 'TMLR' ELSE 'SIGGRAPH Asia' END AS venue",
        ],
        ["*", "concat('Item ', k, ': ', CASE WHEN head = '' THEN 'untitled' ELSE head END) AS title", "concat('Cat_', lang) AS category"],
        [
            "*",
            "concat(category, '/', CASE WHEN k % 17 = 0 THEN 'Lab_Reports' ELSE concat(replace(venue, ' ', '_'), '_', year) END, '/', year, '_', "
            + f"{d.replace(d.replace('title', '[^A-Za-z0-9]+', '_'), '^_+|_+$')}) AS stem",
        ],
        [
            "*", "concat(stem, '.md') AS path", "concat('pdfs/', stem, '.pdf') AS pdf",
            "CASE k % 3 WHEN 0 THEN 'Alpha-Model' WHEN 1 THEN 'alpha_model' ELSE 'alpha-model' END AS model_tag",
        ],
        [
            "*",
            "CASE WHEN k % 11 = 0 THEN '' ELSE concat('---', chr(10), 'title: ', CASE WHEN k % 2 = 0 THEN concat('\"', title, '\"') ELSE title END, chr(10), "
            "CASE WHEN k % 5 = 0 THEN '' ELSE concat('venue: ', venue, chr(10)) END, CASE WHEN k % 7 = 0 THEN '' ELSE concat('year: ', year, chr(10)) END, "
            "'tags:', chr(10), '  - ', category, chr(10), '  - task/t', k % 9, chr(10), '  - ', model_tag, chr(10), '  - dataset/d', k % 5, chr(10), "
            "'core_operator: op', k % 4, chr(10), 'primary_logic: |', chr(10), '  first line ', k, chr(10), '  second line', chr(10), "
            "CASE WHEN k % 8 = 0 THEN '' ELSE concat('pdf_ref: ', pdf, chr(10)) END, 'category: ', category, chr(10), '---', chr(10)) END AS front",
            "concat('# ', title, chr(10), chr(10), CASE WHEN k % 6 = 0 THEN '' ELSE concat('> [!abstract] Summary', chr(10), '> - **Links**: [Project](https://example.org/', k, ')', chr(10), "
            "'> - **Summary**: item ', k, chr(10), chr(10)) END, '## Part I: A', chr(10), plain, chr(10), chr(10), '## Part II: B', chr(10), 'Input and Output: see [[Item ', "
            + d.whole("k", 2)
            + ", ']] for step 1', chr(10), CASE WHEN k % 10 = 0 THEN '' ELSE concat('| metric | ', k % 100, '% |', chr(10)) END, chr(10), "
            "CASE WHEN k % 13 = 0 THEN '' ELSE concat('## Part III: C', chr(10), 'closing words', chr(10), chr(10)) END, '## Local Reading', chr(10), '![[', pdf, ']]', chr(10)) AS body",
        ],
        [
            "k AS note_id", "path", "title", "category", "venue", "year", "pdf",
            "concat(front, body, CASE WHEN k % 19 = 0 THEN concat('---', chr(10), 'extra: e', k, chr(10), 'title: other', chr(10), '---', chr(10)) ELSE '' END) AS text",
        ],
    ]


def _ledger(d: Dialect) -> list[list[str]]:
    """Over notes, with head derived again from the title."""
    return [
        ["note_id AS k", "title", "category", "venue", "year", "path", "substr(title, strpos(title, ': ') + 2) AS head"] if d.duck else
        ["note_id AS k", "title", "category", "venue", "year", "path", "substr(title, instr(title, ': ') + 2) AS head"],
        [
            "k AS row_id",
            "CASE k % 6 WHEN 0 THEN 'Wait' WHEN 1 THEN 'Downloaded' WHEN 2 THEN 'checked' WHEN 3 THEN 'analysis_mismatch' WHEN 4 THEN 'Knowledge' ELSE 'Missing' END AS state",
            "CASE k % 5 WHEN 0 THEN 'high' ELSE '' END AS importance",
            "CASE WHEN k % 12 = 3 THEN head WHEN k % 12 = 6 THEN concat('Other: ', substr(head, 1, 20)) WHEN k % 4 = 0 THEN title WHEN k % 4 = 1 THEN upper(title) "
            "WHEN k % 4 = 2 THEN concat('Other: ', head) ELSE concat(substr(title, 1, 3), substr(title, 5)) END AS paper_title",
            "concat(venue, ' ', year) AS venue",
            "CASE k % 3 WHEN 0 THEN concat('https://github.com/org/repo', k) WHEN 1 THEN concat('https://project.example.org/', k, '/index.html') ELSE '-' END AS project_link",
            "CASE k % 2 WHEN 0 THEN concat('https://papers.example.org/', k, '.pdf') ELSE concat('https://papers.example.org/abs/', k) END AS paper_link",
            "CASE k % 2 WHEN 1 THEN replace(category, '_', ' ') ELSE category END AS sort",
            "concat('pdfs/', substr(path, 1, length(path) - 3), '.pdf') AS pdf_path",
        ],
    ]


def _listing(d: Dialect) -> list[list[str]]:
    folder = d.replace("pdf_path", "/[^/]*$")
    name = "substr(path, length(folder) + 2, length(path) - length(folder) - 5)"
    return [
        ["row_id AS k", "pdf_path AS path", f"{folder} AS folder"],
        ["k", "folder", f"{name} AS name"],
        [
            "k", "concat(folder, '/', CASE WHEN k % 4 = 1 THEN replace(name, '_', '-') WHEN k % 12 = 2 THEN substr(name, 1, length(name) - 4) "
            "WHEN k % 20 = 10 THEN replace(name, '_', ' ') ELSE name END, '.pdf') AS path",
            "concat(folder, '/', replace(name, '_', ' '), '.pdf') AS spaced",
        ],
    ]


def _fetch(d: Dialect) -> list[list[str]]:
    return [[
        "url", "CASE page_id % 5 WHEN 0 THEN 200 WHEN 1 THEN 200 WHEN 2 THEN 401 WHEN 3 THEN 403 ELSE 404 END AS status_code",
        "CASE WHEN page_id % 2 = 0 THEN 'application/pdf' ELSE 'text/html' END AS content_type",
    ]]


def _alias(d: Dialect) -> list[list[str]]:
    return [["p_partkey AS ord", "concat('t', p_partkey) AS alias", f"concat('t', {d.whole('p_partkey', 2)}) AS canonical"]]


#: Pairs beyond the chain of part keys: a pair that points at itself both ways, a self map, three spellings.
MORE_ALIASES = [
    (1001, "c1", "c2"), (1002, "c2", "c1"), (1003, "s", "s"),
    (1004, "Alpha-Model", "alpha_model"), (1005, "alpha-model", "alpha_model"),
]

#: The allowed state changes.
STATE_RULES = [
    ("Knowledge", "analysis_mismatch"), ("analysis_mismatch", "checked"), ("Wait", "checked"), ("Wait", "analysis_mismatch"),
    ("checked", "Wait"), ("Wait", "Downloaded"), ("Downloaded", "Wait"), ("analysis_mismatch", "Wait"), ("Knowledge", "Wait"), ("Missing", "Wait"),
]


def _spark(df: DataFrame, steps: Callable[[Dialect], list[list[str]]]) -> DataFrame:
    for step in steps(SPARK):
        df = df.selectExpr(*step)
    return df


def _duck(source: str, steps: Callable[[Dialect], list[list[str]]]) -> str:
    for step in steps(DUCK):
        source = f"(SELECT {', '.join(step)} FROM {source})"
    return source


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _spark(table(spark, sf_dir, "documents"), _notes)


def ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _spark(notes(spark, sf_dir).where("note_id % 23 <> 0"), _ledger)


def file_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paths of most of the ledger's files; some names are spelled with hyphens or spaces or cut, some are there in two spellings."""
    some = _spark(ledger(spark, sf_dir).where("row_id % 4 <> 0 or row_id % 8 = 0"), _listing)
    return some.select("path").unionByName(some.where("k % 29 = 0").select(F.col("spaced").alias("path"))).distinct()


def fetch_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _spark(table(spark, sf_dir, "pages"), _fetch)


def tag_alias(spark: SparkSession, sf_dir: str) -> DataFrame:
    chain = _spark(table(spark, sf_dir, "part").where("p_partkey > 0"), _alias)
    return chain.unionByName(spark.createDataFrame(MORE_ALIASES, "ord long, alias string, canonical string"))


def state_rules(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(STATE_RULES, "from_state string, to_state string")


def _values(rows: list[tuple]) -> str:
    return ", ".join(str(r) for r in rows)


def duck_views() -> str:
    """The views as common table expressions for DuckDB, to put after WITH."""
    return f"""
    notes AS MATERIALIZED (SELECT * FROM {_duck('documents', _notes)}),
    ledger AS MATERIALIZED (SELECT * FROM {_duck('(SELECT * FROM notes WHERE note_id % 23 <> 0)', _ledger)}),
    listed AS (SELECT * FROM {_duck('(SELECT * FROM ledger WHERE row_id % 4 <> 0 OR row_id % 8 = 0)', _listing)}),
    file_listing AS (SELECT path FROM listed UNION SELECT spaced FROM listed WHERE k % 29 = 0),
    fetch_results AS (SELECT * FROM {_duck('pages', _fetch)}),
    tag_alias AS (SELECT * FROM {_duck('(SELECT * FROM part WHERE p_partkey > 0)', _alias)} UNION ALL VALUES {_values(MORE_ALIASES)}),
    state_rules(from_state, to_state) AS (VALUES {_values(STATE_RULES)})
    """
