"""Notes' front matter and lists as rows. Lines are exploded once and grouped by window sums, without Python."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusops.functions import markdown


def front_matter_fields(notes: DataFrame, id_col: str = "note_id") -> DataFrame:
    """(id, key, kind, value) of the front matter: scalar, list (items joined by line feeds) or block text.

    ``key: value``; ``key:`` and ``- item`` lines; ``key: |`` and indented lines. Quotes around scalars go, other lines
    are skipped, the last of equal keys counts.
    """
    lines = notes.select(id_col, F.posexplode(F.split(markdown.front_matter(F.col("text")), "\n")).alias("pos", "line"))
    is_key = F.col("line").rlike(r"^[^\s#:\-][^:]*:")
    lines = lines.where(F.trim("line") != "").withColumn("is_key", is_key)
    lines = lines.withColumn("field", F.sum(F.col("is_key").cast("int")).over(Window.partitionBy(id_col).orderBy("pos"))).where("field > 0")
    value = F.trim(F.regexp_replace("line", r"^[^:]*:", ""))
    item = F.when(F.col("line").rlike(r"^\s*- "), F.regexp_replace("line", r"^\s*- ", "")).when(F.col("line").rlike("^  "), F.substring("line", 3, 1 << 20))
    rows = lines.groupBy(id_col, "field").agg(
        F.max(F.when(F.col("is_key"), F.trim(F.get(F.split("line", ":", 2), 0)))).alias("key"),
        F.max(F.when(F.col("is_key"), value)).alias("head"),
        F.sort_array(F.collect_list(F.when(~F.col("is_key") & item.isNotNull(), F.struct("pos", item.alias("x"))))).alias("items"),
    )
    block = F.col("head").isin("|", ">")
    kind = F.when(block, "block").when((F.col("head") == "") & (F.size("items") > 0), "list").otherwise("scalar")
    text = F.array_join(F.transform("items", lambda x: x["x"]), "\n")
    rows = rows.select(id_col, "field", "key", kind.alias("kind"), F.when(kind == "scalar", F.regexp_replace("head", "^[\"']+|[\"']+$", "")).otherwise(text).alias("value"))
    last = rows.groupBy(id_col, "key").agg(F.max_by(F.struct("kind", "value"), "field").alias("last"))
    return last.select(id_col, "key", "last.kind", "last.value")


def front_matter_kv(notes: DataFrame, id_col: str = "note_id") -> DataFrame:
    """(id, key, value): any line with a colon, split at the first; the last of equal keys counts."""
    lines = notes.select(id_col, F.posexplode(F.split(markdown.front_matter(F.col("text")), "\n")).alias("pos", "line")).where(F.col("line").contains(":"))
    part = F.split("line", ":", 2)
    lines = lines.select(id_col, "pos", F.trim(F.get(part, 0)).alias("key"), F.trim(F.get(part, 1)).alias("value"))
    return lines.groupBy(id_col, "key").agg(F.max_by("value", "pos").alias("value"))


_BLOCK = r"(?ms)^---\n((?:[^\n:]+:[^\n]*\n)+?)---$"


def later_blocks(notes: DataFrame, id_col: str = "note_id") -> DataFrame:
    """(id, key, value) that blocks after the front matter add: keys that it lacks, the first of equal keys counts."""
    body = markdown.body(F.col("text"))
    blocks = notes.select(id_col, markdown.front_matter_keys(F.col("text")).alias("have"), F.posexplode(F.regexp_extract_all(body, F.lit(_BLOCK), F.lit(1))).alias("block", "lines"))
    each = blocks.select(id_col, "have", "block", F.posexplode(F.split("lines", "\n")).alias("pos", "line")).where(F.col("line").contains(":"))
    part = F.split("line", ":", 2)
    each = each.select(id_col, "have", (F.col("block") * 1_000_000 + F.col("pos")).alias("at"), F.trim(F.get(part, 0)).alias("key"), F.trim(F.get(part, 1)).alias("value"))
    return each.where(~F.array_contains("have", F.col("key"))).groupBy(id_col, "key").agg(F.min_by("value", "at").alias("value"))


def reference_list(texts: DataFrame, order: bool = False) -> DataFrame:
    """(norm, abbr, full), with order also ord, the place of the entry, of ``[abbr](link): Full title,`` entries in text, the first of equal normalised titles by id."""
    from corpusops.functions.textnorm import norm_title

    pattern = F.lit(r"\[([^\]]+)\](?:\([^)]*\))?:\s*([^,\n]+),")
    found = texts.select("id", F.regexp_extract_all("text", pattern, F.lit(1)).alias("a"), F.regexp_extract_all("text", pattern, F.lit(2)).alias("f"))
    rows = found.select("id", F.posexplode(F.arrays_zip("a", "f")).alias("pos", "x")).select("id", "pos", F.trim("x.a").alias("abbr"), F.trim("x.f").alias("full"))
    rows = rows.withColumn("norm", norm_title(F.col("full"))).where("norm <> ''")
    place = F.struct("id", "pos")
    out = rows.groupBy("norm").agg(F.min_by(F.struct("abbr", "full", place.alias("ord")), place).alias("x")).select("norm", "x.*")
    return out if order else out.drop("ord")


def list_rows(notes: DataFrame, key: str = "tags", id_col: str = "note_id") -> DataFrame:
    """(id, pos, item) of a list field; a note without it has one row with nulls."""
    fields = front_matter_fields(notes, id_col).where((F.col("key") == key) & (F.col("kind") == "list")).select(id_col, F.split("value", "\n").alias("items"))
    return notes.select(id_col).join(fields, id_col, "left").select(id_col, F.posexplode_outer("items").alias("pos", "item"))
