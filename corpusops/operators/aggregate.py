"""Batches, summaries, facets, backlinks and comparison over notes and ledgers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusops.plans.cut import cut


def batches(ledger: DataFrame, state: str, size: int) -> DataFrame:
    """(row_id, batch) of the rows in a state, in ledger order, ``size`` a batch from 1.

    Rows are ranked inside ranges of row_id and shifted by the counts of the ranges before, so no task orders all rows.
    """
    rows = ledger.where(F.col("state") == state).select("row_id").withColumn("range", F.shiftright("row_id", 16))
    ranges = rows.groupBy("range").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    inside = F.row_number().over(Window.partitionBy("range").orderBy("row_id"))
    ranked = rows.withColumn("inside", inside).join(ranges.select("range", before.alias("before")), "range")
    return ranked.select("row_id", F.ceil((F.col("before") + F.col("inside")) / size).cast("bigint").alias("batch"))


def report(rows: DataFrame, section: str, item: str, cap: int) -> DataFrame:
    """(section, place, line): the first ``cap`` items of each section, its count at place 0, and how many more there are after them."""
    rank = F.row_number().over(Window.partitionBy(section).orderBy(item))
    shown = rows.withColumn("place", rank).where(F.col("place") <= cap).select(F.col(section).alias("section"), "place", F.col(item).cast("string").alias("line"))
    sizes = rows.groupBy(F.col(section).alias("section")).agg(F.count("*").alias("n"))
    count = sizes.select("section", F.lit(0).alias("place"), F.concat(F.lit("count "), F.col("n").cast("string")).alias("line"))
    more = sizes.where(F.col("n") > cap).select("section", F.lit(cap + 1).alias("place"), F.concat(F.lit("... and "), (F.col("n") - cap).cast("string"), F.lit(" more")).alias("line"))
    return shown.unionByName(count).unionByName(more)


def run_summary(rows: DataFrame, outcome: str) -> DataFrame:
    return rows.groupBy(outcome).agg(F.count("*").alias("n"))


def corpus_counts(notes: DataFrame, tags: DataFrame, approximate: bool = False) -> DataFrame:
    """One row: distinct papers, categories, venues and tags."""
    distinct = F.approx_count_distinct if approximate else F.count_distinct
    return notes.agg(distinct("title").alias("papers"), distinct("category").alias("categories"), distinct("venue").alias("venues")).join(
        tags.agg(distinct("item").alias("tags")), how="cross"
    )


def facet(rows: DataFrame, dim: str, member: str) -> DataFrame:
    """(dim, n, member): a row for each member of each page, with the page's number of members.

    A page of any size is as many rows; sort by dim and member to print it.
    """
    return rows.select(dim, F.col(member).alias("member")).join(rows.groupBy(dim).agg(F.count("*").alias("n")), dim).select(dim, "n", "member")


def facet_prefix(tags: DataFrame, tag: str = "item") -> DataFrame:
    """(facet, value, n) of tags of the form facet/value."""
    part = F.split(tag, "/", 2)
    return tags.where(F.col(tag).contains("/")).groupBy(F.get(part, 0).alias("facet"), F.get(part, 1).alias("value")).agg(F.count("*").alias("n"))


def backlinks(edges: DataFrame) -> DataFrame:
    """(dst, n, sources): notes that link to a target and their number; sources are the distinct count."""
    return edges.groupBy("dst").agg(F.count("*").alias("n"), F.count_distinct("src").alias("sources"))


def compare(notes: DataFrame, names: list[str], fields: list[str], key: str = "title") -> DataFrame:
    """A row for each field with a column for each of the named notes."""
    few = notes.where(F.col(key).isin(names)).select(key, *[F.col(f).cast("string") for f in fields])
    return few.unpivot([key], fields, "field", "value").groupBy("field").pivot(key, names).agg(F.min("value"))


def content_duplicates(docs: DataFrame) -> DataFrame:
    """(hash, n, first_id) of texts that more than one row has."""
    return docs.groupBy(F.sha2("text", 256).alias("hash")).agg(F.count("*").alias("n"), F.min("doc_id").alias("first_id")).where("n > 1")


def global_rank(rows: DataFrame, key: Column, alias: str = "rank") -> DataFrame:
    """rows with their rank, from 1, by key: each range is ranked alone and shifted by the sizes of the ranges before."""
    # Computed once: sizes and ranks must see the same ranges.
    ordered = cut(rows.withColumn("_key", key).repartitionByRange("_key").withColumn("_part", F.spark_partition_id()))
    sizes = ordered.groupBy("_part").agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranked = ordered.withColumn("_inside", F.row_number().over(Window.partitionBy("_part").orderBy("_key")))
    return ranked.join(sizes.select("_part", before.alias("_before")), "_part").withColumn(alias, F.col("_before") + F.col("_inside")).drop("_key", "_part", "_inside", "_before")
