"""Reading and writing notes, ledgers, listings and indexes as files."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusops.plans.cut import cut

#: The columns of a ledger of commas, and of one of bars.
LEDGER = ["state", "importance", "paper_title", "venue", "project_link_or_github_link", "paper_link", "sort", "pdf_path"]
PIPE = ["state", "title", "venue", "project_url", "pdf_url", "category"]

FOLDER = 1_000  # files of a folder that ``write_files`` makes
ROUND = 100_000  # files that the driver lists at a time
_OPEN_COST = "spark.sql.files.openCostInBytes"


def relative(path: Column, root: str) -> Column:
    return F.regexp_replace(path, "^.*?" + root.rstrip("/").removeprefix("file://").replace(".", r"\.") + "/", "")


def write_files(rows: DataFrame, path: str) -> list[tuple[str, int]]:
    """A text file, closed by a line break, for each of rows (name, value), named ``name.number.txt``; returns the folders below path and how many each holds.

    Tasks write the files themselves: Spark's writer makes a folder for each value and moves it on the driver. path is one that pyarrow reaches.
    """
    pyarrow.fs.FileSystem.from_uri(path)[0].create_dir(pyarrow.fs.FileSystem.from_uri(path)[1], recursive=True)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fs, root = pyarrow.fs.FileSystem.from_uri(path)
        part, n = TaskContext.get().partitionId(), 0
        for batch in batches:
            for name, value in zip(batch["name"], batch["value"], strict=True):
                folder = f"{part:06d}/{n // FOLDER:06d}"
                if n % FOLDER == 0:
                    fs.create_dir(f"{root}/{folder}", recursive=True)
                with fs.open_output_stream(f"{root}/{folder}/{name}.{n}.txt") as f:
                    f.write((value or b"") + b"\n")
                n += 1
        yield pd.DataFrame([(f"{path}/{part:06d}/{i // FOLDER:06d}", min(FOLDER, n - i)) for i in range(0, n, FOLDER)], columns=["folder", "files"])

    named = rows.toDF("name", "value").select("name", F.col("value").cast("binary").alias("value"))
    return sorted(tuple(r) for r in named.mapInPandas(run, "folder string, files long").collect())  # a row for FOLDER files


def read_in_rounds(spark: SparkSession, folders: list[tuple[str, int]], path: str, read: Callable[[str | list[str]], DataFrame]) -> DataFrame:
    """What read makes of the files of folders (folder, files) below path, some ROUND files at a time: the driver never holds a list of all files.

    read gets folders and gives slim rows, which are computed at once. Many small files go to one task: Spark takes each for 4 MB.
    """
    groups, n = [], ROUND
    for folder, files in folders:
        if n + files > ROUND:
            groups.append([])
            n = 0
        groups[-1].append(folder)
        n += files
    out, before = None, spark.conf.get(_OPEN_COST)
    spark.conf.set(_OPEN_COST, "64k")
    try:
        for group in groups or [path]:
            part = cut(read(group))
            out = part if out is None else out.unionByName(part)
    finally:
        spark.conf.set(_OPEN_COST, before)
    return out


def read_notes(spark: SparkSession, path: str, glob: str = "*.md", on_bad_utf8: str = "skip", folders: str | list[str] | None = None) -> DataFrame:
    """(path, text) of every file below path, or of its folders alone; a file that isn't UTF-8 is skipped, or loses its bad bytes with ``ignore``."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(folders or path)
    raw = raw.select(relative(F.col("path"), path).alias("path"), F.col("content").cast("string").alias("text"))
    if on_bad_utf8 == "skip":
        return raw.where(F.is_valid_utf8("text"))
    return raw.withColumn("text", F.when(F.is_valid_utf8("text"), F.col("text")).otherwise(F.replace(F.make_valid_utf8("text"), F.lit("�"), F.lit(""))))


def filter_note_paths(notes: DataFrame, depth: int = 3, exclude_dirs: list[str] | None = None, markers: list[str] | None = None) -> DataFrame:
    """Notes ``category/venue_YYYY/file.md`` of the depth, without excluded top folders, dot files, and names that hold a marker word."""
    parts = F.split("path", "/")
    name = F.element_at(parts, -1)
    keep = (F.size(parts) == depth) & ~name.startswith(".") & ~F.get(parts, 0).isin(exclude_dirs or [])
    if depth == 3:
        keep = keep & F.get(parts, 1).rlike(r"_\d{4}$")
    for m in markers or []:
        keep = keep & ~name.contains(m)
    return notes.where(keep)


def read_ledger_csv(spark: SparkSession, path: str) -> DataFrame:
    """The ledger's eight columns with file and line order kept in row_id; a header in a file's first row is left out, short rows end in empty strings, long ones are cut."""
    schema = ", ".join(f"`{c}` string" for c in LEDGER)
    rows = spark.read.schema(schema).option("multiLine", True).option("quote", '"').option("escape", '"').option("mode", "PERMISSIVE").csv(path)
    rows = rows.select("*", F.col("_metadata.file_path").alias("file")).withColumn("row_id", F.monotonically_increasing_id())
    first = rows.groupBy("file").agg(F.min("row_id").alias("row_id"), F.min_by("state", "row_id").alias("state"))
    rows = rows.join(first.where(F.lower("state") == "state").select("row_id"), "row_id", "left_anti")
    return rows.select("row_id", *[F.coalesce(c, F.lit("")).alias(c) for c in LEDGER])


def parse_pipe(lines: DataFrame, mode: str = "exact") -> DataFrame:
    """(line_no, fields) of (line_no, value) lines; blank and ``#`` lines are skipped.

    ``exact``: the six of PIPE, the last keeps further bars; ``pad``: missing ones are empty, a missing category is Misc; ``least8``: the eight
    of LEDGER, of lines of eight fields or more, cut.
    """
    kept = lines.where((F.trim("value") != "") & ~F.trim("value").startswith("#"))
    parts = F.split("value", r"\|", 6 if mode == "exact" else -1)
    if mode != "pad":
        kept = kept.where(F.size(parts) >= (6 if mode == "exact" else 8))
    field = lambda i, c: F.coalesce(F.trim(F.get(parts, i)), F.lit("Misc" if c == "category" else ""))
    return kept.select("line_no", *[field(i, c).alias(c) for i, c in enumerate(LEDGER if mode == "least8" else PIPE)])


def read_ledger_pipe(spark: SparkSession, path: str, mode: str = "exact") -> DataFrame:
    return parse_pipe(spark.read.text(path).withColumn("line_no", F.monotonically_increasing_id()), mode)


def list_files(spark: SparkSession, path: str, glob: str = "*", folders: str | list[str] | None = None) -> DataFrame:
    """(path, ext, length, modified) below path, or of its folders alone; contents aren't read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(folders or path)
    rel = relative(F.col("path"), path)
    return files.select(rel.alias("path"), F.regexp_extract(rel, r"\.([^./]+)$", 1).alias("ext"), "length", F.col("modificationTime").alias("modified"))


def fingerprint(ledger: DataFrame) -> tuple:
    """Rows of a ledger and two sums of their hashes: equal for the same rows in any order, each as often."""
    columns = ["row_id", *LEDGER]
    total = lambda *more: F.coalesce(F.sum(F.xxhash64(*columns, *more).cast("decimal(38, 0)")), F.lit(0).cast("decimal(38, 0)"))
    return tuple(ledger.agg(F.count("*").alias("n"), total().alias("a"), total(F.lit(1)).alias("b")).first())


def write_ledger(ledger: DataFrame, path: str, changed: bool | None = None) -> str | None:
    """Write a new version beside the earlier ones, in row order; nothing where nothing changed. Returns its folder.

    changed: known beforehand; otherwise the rows' fingerprint is compared with that kept beside the newest version, in one aggregate.
    """
    if changed is False:
        return None
    spark, now = ledger.sparkSession, fingerprint(ledger)
    if changed is None and read_version(spark, path) and now == _kept_fingerprint(spark, path):
        return None
    name = f"{read_version(spark, path) + 1:08d}-{uuid.uuid4().hex[:8]}"
    spark.createDataFrame([now], "n bigint, a decimal(38, 0), b decimal(38, 0)").coalesce(1).write.parquet(f"{path}/fingerprint={name}")
    ledger.orderBy("row_id").select("row_id", *LEDGER).write.parquet(f"{path}/version={name}")
    return f"{path}/version={name}"


def _kept_fingerprint(spark: SparkSession, path: str) -> tuple:
    """Of the newest version; computed where a version was written without."""
    kept = f"{path}/{_versions(spark, path)[-1].replace('version=', 'fingerprint=')}"
    there = spark._jvm.org.apache.hadoop.fs.Path(kept)
    if there.getFileSystem(spark._jsc.hadoopConfiguration()).exists(there):
        return tuple(spark.read.parquet(kept).first())
    return fingerprint(read_ledger(spark, path))


def _versions(spark: SparkSession, path: str) -> list[str]:
    root = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = root.getFileSystem(spark._jsc.hadoopConfiguration())
    names = [s.getPath().getName() for s in fs.listStatus(root)] if fs.exists(root) else []
    return sorted(n for n in names if n.startswith("version=") and fs.exists(spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{n}/_SUCCESS")))


def read_version(spark: SparkSession, path: str) -> int:
    """Number of the newest whole version; 0 without one."""
    names = _versions(spark, path)
    return int(names[-1].split("=")[1].split("-")[0]) if names else 0


def read_ledger(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(f"{path}/{_versions(spark, path)[-1]}")


def write_report(report: DataFrame, path: str) -> None:
    """Lines of a report (section, place, line), in order."""
    report.orderBy("section", "place").select(F.concat_ws("\t", "section", "line")).write.text(path)


def index_rows(notes: DataFrame) -> DataFrame:
    """The fields by which notes are found, without their text."""
    return notes.select("note_id", "title", "path", "category", "venue", "year")


def write_index(notes: DataFrame, path: str) -> None:
    """One JSON object a note."""
    index_rows(notes).write.json(path)


def read_pages(spark: SparkSession, path: str, suffix: str = ".html", folders: str | list[str] | None = None) -> DataFrame:
    """(url, html) of saved pages, one a file, below path or in its folders alone; the address is the file's path below ``path`` without its suffix."""
    files = spark.read.format("text").option("wholetext", True).option("recursiveFileLookup", True).option("pathGlobFilter", f"*{suffix}").load(folders or path)
    return files.select(F.regexp_replace(relative(F.col("_metadata.file_path"), path), suffix.replace(".", r"\.") + "$", "").alias("url"), F.col("value").alias("html"))
