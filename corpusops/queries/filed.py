"""Reading and writing files (group A): each query writes a table as files in the shared folder and reads them back."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusops import views as v
from corpusops.plans.cut import new_folder
from corpusops.queries.base import query
from corpusops.sources import files

_COLUMNS = "state, importance, paper_title, venue, project_link, paper_link, sort, pdf_path"


def _one_file_a_row(rows, name, read):
    """What read, of a path and folders below it, makes of a folder with one text file for each of rows (key, value)."""
    path = new_folder(rows.sparkSession, name)
    key, value = rows.columns
    folders = files.write_files(rows.select(F.concat(F.lit(f"{key}="), F.coalesce(F.col(key).cast("string"), F.lit(""))), value), path)
    return files.read_in_rounds(rows.sparkSession, folders, path, lambda some: read(path, some))


def _key(column, key):
    return F.nullif(F.regexp_extract(column, rf"(?:^|/){key}=(-?\d*)\.", 1), F.lit("")).cast("bigint").alias(key)


@query("SELECT note_id, sha256(concat(text, chr(10))) AS hash FROM notes")
def read_note_files(spark, sf_dir):
    read = lambda path, some: files.read_notes(spark, path, glob="*.txt", folders=some).select(_key("path", "note_id"), F.sha2("text", 256).alias("hash"))
    return _one_file_a_row(v.notes(spark, sf_dir).select("note_id", "text"), "notes", read)


@query("SELECT note_id, 'txt' AS ext, strlen(text) + 1 AS length FROM notes")
def list_note_files(spark, sf_dir):
    read = lambda path, some: files.list_files(spark, path, glob="*.txt", folders=some).select(_key("path", "note_id"), "ext", "length")
    return _one_file_a_row(v.notes(spark, sf_dir).select("note_id", "text"), "listed", read)


@query("SELECT page_id, sha256(concat(html, chr(10))) AS hash FROM pages", views=False)
def read_page_files(spark, sf_dir):
    read = lambda path, some: files.read_pages(spark, path, suffix=".txt", folders=some).select(_key("url", "page_id"), F.sha2("html", 256).alias("hash"))
    return _one_file_a_row(v.table(spark, sf_dir, "pages").select("page_id", "html"), "pages", read)


_NAMED = ", ".join(f"{a} AS {b}" for a, b in zip(_COLUMNS.split(", "), files.LEDGER, strict=True))


def _ledger(spark, sf_dir):
    return v.ledger(spark, sf_dir).selectExpr("row_id", *_NAMED.split(", "))


@query(f"SELECT {_NAMED} FROM ledger")
def read_ledger_files(spark, sf_dir):
    """The ledger as CSV files that each begin with a header."""
    path = new_folder(spark, "ledger")
    _ledger(spark, sf_dir).drop("row_id").write.option("header", True).option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).option("escape", '"').option("emptyValue", "").csv(path)
    return files.read_ledger_csv(spark, path).drop("row_id")


@query(f"SELECT row_id, CASE WHEN row_id % 5 = 0 THEN 'changed' ELSE state END AS state, {_NAMED.split(', ', 1)[1]} FROM ledger")
def newest_ledger(spark, sf_dir):
    """The newest of two versions; writing the second again, in another order, adds none."""
    path, rows = new_folder(spark, "versions"), _ledger(spark, sf_dir)
    files.write_ledger(rows, path)
    changed = rows.withColumn("state", F.when(F.col("row_id") % 5 == 0, "changed").otherwise(F.col("state")))
    files.write_ledger(changed, path)
    files.write_ledger(changed.repartition(3), path)
    if files.read_version(spark, path) != 2:
        raise AssertionError("a version was written twice")
    return files.read_ledger(spark, path)
