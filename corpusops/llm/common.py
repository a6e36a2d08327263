"""What the operators of this subpackage share: reading tables, intermediate tables in the shared folder, joins with hot keys."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusops.plans.cut import shuffles_dropped

#: Fixed character class of the words that white space bounds: space and U+0009 to U+000D.
SPACES = r"\x20\x09-\x0D"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Stands for a null id on the way through Python, where a null would turn a column of numbers into fractions.
NO_ID = -(1 << 63)


#: Rows of whole texts that go to Python at a time, where the session leaves Spark's 10,000: some texts are very long.
TEXT_ROWS = "1000"
_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


def texts(docs: DataFrame, *more: str) -> DataFrame:
    """(doc_id, text) and more string columns, null strings as empty and null ids as NO_ID: other columns can't clash with those an operator adds.

    Sets the session's rows a batch to TEXT_ROWS.
    """
    if docs.sparkSession.conf.get(_BATCH) == "10000":
        docs.sparkSession.conf.set(_BATCH, TEXT_ROWS)
    return docs.select(F.coalesce(F.col("doc_id").cast("bigint"), F.lit(NO_ID)).alias("doc_id"), *[F.coalesce(c, F.lit("")).alias(c) for c in ("text", *more)])


def with_ids(df: DataFrame) -> DataFrame:
    """df with NO_ID as null again."""
    return df.withColumn("doc_id", F.nullif("doc_id", F.lit(NO_ID)))


#: Folders of the tables that materialise() made and nothing has deleted yet.
_MADE: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors and the driver share.

    Without the setting, a temporary folder serves where driver and tasks are one process; on a cluster it would be another
    disk on each machine, so there it is an error.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
        path = f"file://{tempfile.mkdtemp(prefix='spark-')}"
        spark.conf.set("spark.checkpoint.dir", path)
    return path


def materialise(df: DataFrame) -> DataFrame:
    """Write df to a table in the shared folder and read it back: computed once, whatever reads it, and lost executors take nothing with them."""
    path = f"{shared_dir(df.sparkSession)}/table-{uuid.uuid4().hex}"
    with shuffles_dropped(df.sparkSession):
        df.write.parquet(path)
    _MADE.append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _delete(spark: SparkSession, name: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(name)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def forget(*tables: DataFrame) -> None:
    """Delete the files of materialised tables that nothing reads any more."""
    for df in tables:
        for name in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            _delete(df.sparkSession, name)
            _MADE[:] = [p for p in _MADE if not p.endswith(name.rsplit("/", 1)[1])]


def made() -> int:
    """How many intermediate tables of this process there are: what release() takes to leave these alone."""
    return len(_MADE)


def release(spark: SparkSession, since: int = 0, keep: DataFrame | None = None) -> None:
    """Delete the intermediate tables made after the first ``since``, but keep's. For when all results that read them are written."""
    kept = {f.rsplit("/", 2)[1] for f in keep.inputFiles()} if keep is not None else set()
    for path in _MADE[since:]:
        if path.rsplit("/", 1)[1] not in kept:
            _delete(spark, path)
            _MADE.remove(path)


HOT_PARTS = 1000  # a key with more than one of so many rows is hot; there are fewer such keys than that


def join_hot(rows: DataFrame, keyed: DataFrame, key: str) -> DataFrame:
    """rows left-joined with keyed, which has a row a key at most; key isn't null.

    The rows of hot keys stay where they are: keyed's rows of these, fewer than HOT_PARTS, are sent to them. All others are
    shuffled by the key. So no key's rows meet in one task, however many there are.
    """
    sizes = rows.groupBy(key).agg(F.count("*").alias("n"))
    total = rows.count()
    hot = [r[0] for r in sizes.where(F.col("n") * HOT_PARTS > total).select(key).collect()] if total > HOT_PARTS else []
    if not hot:
        return rows.join(keyed, key, "left")
    is_hot = F.col(key).isin(hot)
    return rows.where(~is_hot).join(keyed, key, "left").unionByName(rows.where(is_hot).join(F.broadcast(keyed.where(is_hot)), key, "left"))


def running(df: DataFrame, by: list[str], order: list[str], values: list[str]) -> DataFrame:
    """df with NAME_before and NAME_all for each of values: its sum over the earlier rows of the group, and over the whole group.

    Rows are dealt into ranges by group and order, so a group of any size is spread over many tasks; each range is summed alone
    and shifted by the sums of the ranges before, of which a group has at most as many as there are partitions. Rows that are
    equal in all of order are told apart by where they stand, so they spread, too. Columns of by hold no null; without any, the
    whole table is one group. Send slim rows: all of df is shuffled.
    """
    keys = [*by, "_range"]
    dealt = df.withColumn("_tie", F.monotonically_increasing_id()).repartitionByRange(*by, *order, "_tie").withColumn("_range", F.spark_partition_id())
    dealt = materialise(dealt)  # sums and rows must see the same ranges
    sums = dealt.groupBy(*keys).agg(*[F.sum(v).alias(v) for v in values])
    earlier = Window.partitionBy(*by).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    whole = [F.sum(v).over(Window.partitionBy(*by)).alias(f"{v}_all") for v in values]
    sums = sums.select(*keys, *[F.coalesce(F.sum(v).over(earlier), F.lit(0)).alias(f"{v}_shift") for v in values], *whole)
    inside = Window.partitionBy(*keys).orderBy(*order, "_tie").rowsBetween(Window.unboundedPreceding, -1)
    rows = dealt.select("*", *[F.coalesce(F.sum(v).over(inside), F.lit(0)).alias(f"{v}_inside") for v in values]).join(sums, keys)
    before = [(F.col(f"{v}_inside") + F.col(f"{v}_shift")).alias(f"{v}_before") for v in values]
    return rows.select(*df.columns, *before, *[f"{v}_all" for v in values])
