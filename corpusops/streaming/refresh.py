"""Incremental refresh with Structured Streaming: newly arrived notes, and the latest state of an ordered change feed.

Each batch writes under its own number, and a batch that runs again writes the same place, so replays add nothing twice.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from corpusops.functions import markdown
from corpusops.operators.audit import describe_gaps, verdict
from corpusops.sources.files import relative


def parse_notes(notes: DataFrame) -> DataFrame:
    """(path, title, ok, gap, keys) of (path, text)."""
    c = F.col("text")
    title = markdown.resolve_title(F.regexp_extract(markdown.front_matter(c), r"(?m)^title: (.+)$", 1), markdown.first_heading(c), F.col("path"))
    return notes.select("path", title.alias("title"), verdict(c).alias("ok"), describe_gaps(c).alias("gap"), markdown.front_matter_keys(c).alias("keys"))


def refresh_notes(spark: SparkSession, source: str, target: str, checkpoint: str, glob: str = "*.md", delivery: str = "") -> StreamingQuery:
    """Parse the note files that arrived below source since the last run into target/batch=N; ends when none are left.

    delivery: a regular expression for the folders in which notes are delivered; without them a path names its note, so a later delivery
    can bring a note again. Beside each batch stands its report, see round_reports.
    """
    files = spark.readStream.format("text").option("wholetext", True).option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(source)
    path = relative(F.col("_metadata.file_path"), source)
    stream = files.select((F.regexp_replace(path, f"^{delivery}", "") if delivery else path).alias("path"), F.col("value").alias("text"))

    def write(batch: DataFrame, number: int) -> None:
        parsed = parse_notes(batch).join(batch.select("path", F.xxhash64("text").alias("hash")), "path").dropDuplicates(["path"])
        parsed.write.mode("overwrite").parquet(f"{target}/batch={number}")
        now = spark.read.parquet(f"{target}/batch={number}").select("path", "hash", "ok")
        before = _notes_before(spark, target, number)
        if before is not None:
            now = now.join(before.select("path", F.col("hash").alias("old")), "path", "left")
        else:
            now = now.withColumn("old", F.lit(None).cast("bigint"))
        count = lambda when: F.count(F.when(when, 1))
        new, changed = F.col("old").isNull(), F.col("old") != F.col("hash")
        report = now.agg(count(new).alias("added"), count(changed).alias("changed"), count(F.col("old") == F.col("hash")).alias("same"), count(~F.col("ok")).alias("failed"))
        report.coalesce(1).write.mode("overwrite").parquet(f"{target}/_reports/batch={number}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _exists(spark: SparkSession, path: str) -> bool:
    there = spark._jvm.org.apache.hadoop.fs.Path(path)
    return there.getFileSystem(spark._jsc.hadoopConfiguration()).exists(there)


def _notes_before(spark: SparkSession, target: str, number: int) -> DataFrame | None:
    """(path, hash) of each note as the batches before the number last had it."""
    paths = [f"{target}/batch={n}" for n in range(number) if _exists(spark, f"{target}/batch={n}/_SUCCESS")]
    if not paths:
        return None
    rows = spark.read.option("basePath", target).parquet(*paths).select("path", "hash", "batch")
    return rows.groupBy("path").agg(F.max_by("hash", "batch").alias("hash"))


def round_reports(spark: SparkSession, target: str) -> DataFrame:
    """(batch, added, changed, same, failed): how many notes each batch brought that were new, differed from or equalled what there was, and don't pass.

    A batch that runs again writes its report anew, against the batches before it alone, so nothing counts twice.
    """
    return spark.read.option("basePath", f"{target}/_reports").parquet(f"{target}/_reports/batch=*").select("batch", "added", "changed", "same", "failed")


def latest_rows(changes: DataFrame, key: str, seq: str) -> DataFrame:
    """The row of the greatest seq for each key."""
    rest = [c for c in changes.columns if c != key]
    last = changes.groupBy(key).agg(F.max_by(F.struct(*rest), seq).alias("x"))
    return last.select(key, *[F.col(f"x.{c}").alias(c) for c in rest])


BUCKETS = 256  # of keys; a batch rewrites those that its keys fall in


def _manifest(spark: SparkSession, target: str, number: int) -> dict[int, int]:
    """The batch that wrote each bucket's rows, as of a batch: a row for each bucket that has any."""
    path = f"{target}/manifest/batch={number}"
    return {r["bucket"]: r["version"] for r in spark.read.parquet(path).collect()} if number >= 0 else {}


def _bucket_paths(target: str, manifest: dict[int, int]) -> list[str]:
    return [f"{target}/data/version={version}/bucket={bucket}" for bucket, version in sorted(manifest.items())]


def read_state(spark: SparkSession, target: str, number: int | None = None) -> DataFrame:
    """The latest rows after a batch, or after the newest."""
    if number is None:
        number = max(r[0] for r in spark.read.parquet(f"{target}/manifest/batch=*").select(F.input_file_name().alias("f")).select(F.regexp_extract("f", r"batch=(\d+)", 1).cast("int")).distinct().collect())
    return spark.read.parquet(*_bucket_paths(target, _manifest(spark, target, number)))


def latest_state(spark: SparkSession, source: str, schema: str, target: str, checkpoint: str, key: str, seq: str, buckets: int = BUCKETS) -> StreamingQuery:
    """Keep the latest row of each key, in buckets of keys below target/data; target/manifest says which batch wrote each bucket last.

    A batch reads and rewrites only the buckets of its own keys, and drops what the batch before it replaced. It starts from the
    manifest of the batch before, so a replayed batch writes the same again. Read it by read_state.
    """
    stream = spark.readStream.schema(schema).parquet(source)

    def merge(batch: DataFrame, number: int) -> None:
        rows = batch.withColumn("bucket", F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int"))
        before = _manifest(spark, target, number - 1)
        touched = [r["bucket"] for r in rows.select("bucket").distinct().collect()]  # at most ``buckets``
        old = [p for b, p in zip(sorted(before), _bucket_paths(target, before)) if b in touched]
        if old:
            known = spark.read.parquet(*old)
            rows = rows.unionByName(known.withColumn("bucket", F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")))
        latest = latest_rows(rows, key, seq).repartition("bucket")
        latest.write.mode("overwrite").partitionBy("bucket").parquet(f"{target}/data/version={number}")
        now = before | dict.fromkeys(touched, number)
        spark.createDataFrame(sorted(now.items()), "bucket int, version int").coalesce(1).write.mode("overwrite").parquet(f"{target}/manifest/batch={number}")
        if number > 1:  # what the batch before replaced: neither a replay of this batch nor the newest state reads it
            for path in set(_bucket_paths(target, _manifest(spark, target, number - 2))) - set(_bucket_paths(target, before)):
                there = spark._jvm.org.apache.hadoop.fs.Path(path)
                there.getFileSystem(spark._jsc.hadoopConfiguration()).delete(there, True)

    return stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
