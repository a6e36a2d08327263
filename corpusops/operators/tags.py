"""Tag aliases: closure over chains and cycles, canonical tags, spelling variants."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusops.plans.cut import cut


def alias_closure(alias: DataFrame) -> DataFrame:
    """(alias, canonical): aliases followed to where they end, by pointer doubling over those that aren't settled.

    The entry with the greatest ord counts for an alias. Tags on a cycle all end at the member with the least ord;
    what leads into a cycle ends there, too. alias: (ord, alias, canonical).

    A round doubles how far the open aliases look ahead and settles those whose target is settled. On a cycle nothing ends, but the
    entry of least ord among the steps passed is the same from an alias and from its target only once the steps go round it: steps
    of the one and of the other are passed at different times, so what both hold lies on a cycle, all of which is between. A
    round moves only the open aliases, and there are about log2(d) rounds for chains of depth d, whatever the table's size.
    """
    last = alias.groupBy("alias").agg(F.max_by(F.struct("ord", "canonical"), "ord").alias("x")).select("alias", "x.ord", "x.canonical")
    ends = last.select(F.col("alias").alias("canonical"), F.lit(True).alias("goes_on"))
    first = last.join(ends, "canonical", "left").select(
        "alias", F.col("canonical").alias("to"), F.struct("ord", "alias").alias("least"), F.when(F.col("goes_on").isNull(), F.col("canonical")).alias("end")
    )
    step, settled = cut(first), None
    while True:
        done = step.where("end is not null").select("alias", F.col("end").alias("canonical"))
        settled = done if settled is None else settled.unionByName(done)
        open_ = step.where("end is null")
        if open_.isEmpty():
            return settled
        on = open_.select(F.col("alias").alias("to"), F.col("to").alias("next"), F.col("least").alias("low"), F.col("end").alias("theirs")).unionByName(
            settled.select(F.col("alias").alias("to"), F.col("canonical").alias("theirs")), allowMissingColumns=True
        )
        end = F.coalesce("theirs", F.when(F.col("least") == F.col("low"), F.col("least.alias")))
        step = cut(open_.drop("end").join(on, "to").select("alias", F.col("next").alias("to"), F.least("least", "low").alias("least"), end.alias("end")))


def canonical_tags(tags: DataFrame, closure: DataFrame) -> DataFrame:
    """(note_id, tags, changed, has_dup): mapped tags without repeats, at their first places; tags: (note_id, pos, item)."""
    mapped = tags.join(closure, F.col("item") == F.col("alias"), "left").withColumn("tag", F.coalesce("canonical", "item"))
    flags = mapped.groupBy("note_id").agg(
        F.coalesce(F.max(F.col("tag") != F.col("item")), F.lit(False)).alias("changed"), (F.count("tag") > F.count_distinct("tag")).alias("has_dup")
    )
    firsts = mapped.groupBy("note_id", "tag").agg(F.min("pos").alias("pos")).where("tag is not null")
    lists = firsts.groupBy("note_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", "tag"))), lambda x: x["tag"]).alias("tags"))
    return flags.join(lists, "note_id", "left")


def tag_variants(tags: DataFrame, tag: str = "item") -> DataFrame:
    """(norm, spellings, n): tags that are the same but for case and hyphen or underscore, with more than one spelling."""
    norm = F.replace(F.lower(tag), F.lit("-"), F.lit("_"))
    each = tags.groupBy(norm.alias("norm"), F.col(tag).alias("spelling")).agg(F.count("*").alias("n"))
    return each.groupBy("norm").agg(F.array_join(F.sort_array(F.collect_set("spelling")), ",").alias("spellings"), F.sum("n").alias("n"), F.count("*").alias("k")).where("k > 1").drop("k")


def normalise_tags(raw, category):
    """Array from a comma-separated string, the category first if it isn't there."""
    items = F.filter(F.transform(F.split(F.coalesce(raw, F.lit("")), ","), lambda x: F.trim(x)), lambda x: x != "")
    return F.when(F.array_contains(items, category), items).otherwise(F.array_prepend(items, category))
