"""Views beside plain versions of their rules."""

import re
import time

from pyspark.sql import functions as F

from corpusops import registry
from corpusops import views as v

ODD = [
    "", "  ", "a", "a" * 200, "é" * 100, "é" * 100 + "ab", ("a" * 59 + "-") * 3, ("a" * 60 + "-") * 3, ("a" * 61 + "-") * 3, "a-" * 100, "-" * 5000 + "b  c", "--".join("word" * 3 for _ in range(40)),
    "x\n# y\n" * 50, "日本語 " * 100 + "z", "a" * 60 + " " * 50, "a" * 59 + " " * 50 + "b",
]


def _documents(tmp_path, spark, texts):
    rows = [(i, t, "en", "s", len(t)) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.mode("overwrite").parquet(f"{tmp_path}/documents.parquet")
    return str(tmp_path)


def test_head_is_that_of_the_whole_text(spark, tmp_path):
    got = {r.note_id: r.title for r in v.notes(spark, _documents(tmp_path, spark, ODD)).collect()}
    for i, text in enumerate(ODD):
        head = re.sub("[^A-Za-z0-9]+", " ", text).strip(" ")[:60].strip(" ")
        assert got[i] == f"Item {i}: {head or 'untitled'}"


def test_filters_read_a_head_that_is_made_once(spark, sf_dir):
    """Filters on titles and paths had its expression up to 84 times in one condition."""
    for name, scans in (("note_path_filter", 1), ("ledger_pipe_parse", 1), ("file_exists", 3)):
        plan = registry.QUERIES[name](spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("regexp_extract(text#") == scans


def test_paths_do_not_take_the_whole_text(spark, tmp_path):
    """A path is cheaper than one pass of a regular expression over the texts; the head took one for each place that refers to it."""
    made = spark.range(20).select(F.col("id").alias("doc_id"), F.expr("repeat('ab, ', 500000)").alias("text"), F.lit("en").alias("lang"), F.lit("s").alias("source"), F.lit(2000000).cast("long").alias("n_chars"))
    made.coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    whole = F.length(F.regexp_replace("text", "[^A-Za-z0-9]+", " "))
    took = []
    for rows in (spark.read.parquet(f"{tmp_path}/documents.parquet").select(whole), registry.QUERIES["note_path_filter"](spark, str(tmp_path))):
        rows.write.format("noop").mode("overwrite").save()
        began = time.time()
        rows.write.format("noop").mode("overwrite").save()
        took.append(time.time() - began)
    assert took[1] < took[0]
