"""Sharding by extendible hashing.

The directory is indexed by the leading bits of a record's hash. A bucket whose bytes are over the limit splits on one
more bit, and only such a bucket does, until every shard fits. Sizes are summed by prefix before anything is decided, so
the directory is a small table and no bucket's rows are gathered anywhere.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusops.llm.common import materialise

LIMIT = 1 << 20  # bytes of a shard
HASH_BITS = 60
FIRST_EXTRA = 3  # bits beyond those that even buckets would need
MORE_BITS = 8  # of each later round


def record_hash(record: Column) -> Column:
    """The first 60 bits of the record id's MD5, as a number; a null id hashes like an empty one."""
    return F.conv(F.substring(F.md5(F.coalesce(record.cast("string"), F.lit("")).cast("binary")), 1, 15), 16, 10).cast("bigint")


def _prefix(bits: Column | int) -> Column:
    """The leading bits of column hash."""
    return F.shiftright("hash", HASH_BITS - bits) if isinstance(bits, int) else F.expr(f"shiftright(hash, {HASH_BITS} - depth)")


def _directory(rows: DataFrame, above: int, bits: int, limit: int) -> DataFrame:
    """(prefix, depth, shard_bytes, shard_rows) by prefix of so many bits; depth is null where a bucket of all these bits is still too large.

    A bucket of one record can't split, whatever its size.
    """
    sums = [F.sum("n_bytes").alias("n_bytes"), F.sum("n").alias("n"), F.min("low").alias("low"), F.max("high").alias("high")]
    fine = rows.select(_prefix(bits).alias("prefix"), "n_bytes", F.lit(1).alias("n"), F.col("hash").alias("low"), F.col("hash").alias("high"))
    fine = fine.groupBy("prefix").agg(*sums)
    levels = fine.withColumn("depth", F.explode(F.sequence(F.lit(above), F.lit(bits)))).withColumn("at", F.expr(f"shiftright(prefix, {bits} - depth)"))
    buckets = levels.groupBy("depth", "at").agg(*sums)
    fits = buckets.where((F.col("n_bytes") <= limit) | (F.col("low") == F.col("high")))
    shards = levels.select("prefix", "depth", "at").join(fits, ["depth", "at"], "left")
    best = shards.groupBy("prefix").agg(F.min(F.when(F.col("n").isNotNull(), F.struct("depth", "n_bytes", "n"))).alias("best"))
    return best.select("prefix", "best.depth", F.col("best.n_bytes").alias("shard_bytes"), F.col("best.n").alias("shard_rows"))


def assign_shards(docs: DataFrame, limit: int = LIMIT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, shard, depth, shard_bytes, shard_rows, over_limit) of every row.

    shard: the prefix as binary digits, empty while one shard holds all; n_bytes: UTF-8 bytes of the text, 0 for null.
    Rows with equal ids are one record and stay together; a record over the limit has a shard of its own, marked
    over_limit. Null ids are one record. An empty table gives an empty table; other columns of docs are ignored.
    """
    rows = docs.select(
        F.col(id_col).alias("doc_id"), F.coalesce(F.octet_length(text_col), F.lit(0)).cast("bigint").alias("n_bytes"), record_hash(F.col(id_col)).alias("hash")
    )
    rows = materialise(rows)
    total = rows.agg(F.sum("n_bytes")).first()[0] or 0
    above, bits = 0, min(HASH_BITS, max(0, math.ceil(math.log2(max(total, 1) / limit))) + FIRST_EXTRA)
    done = None
    while True:
        directory = materialise(_directory(rows, above, bits, limit))
        joined = rows.withColumn("prefix", _prefix(bits)).join(directory, "prefix")
        part = joined.where("depth is not null").drop("prefix")
        done = part if done is None else done.unionByName(part)
        if not directory.where("depth is null").limit(1).count():
            break
        rows = rows.withColumn("prefix", _prefix(bits)).join(directory.where("depth is null").select("prefix"), "prefix", "left_semi").drop("prefix")
        above, bits = bits + 1, min(HASH_BITS, bits + MORE_BITS)
    shard = F.when(F.col("depth") == 0, "").otherwise(F.expr("lpad(bin(shiftright(hash, 60 - depth)), depth, '0')"))
    return done.select("doc_id", "n_bytes", shard.alias("shard"), "depth", "shard_bytes", "shard_rows", (F.col("shard_bytes") > limit).alias("over_limit"))


def write_shards(docs: DataFrame, path: str, limit: int = LIMIT) -> str:
    """Write docs as one folder a shard, and return the folders' key: ``shard``, or with a number where docs has such a column.

    All columns of docs are written as they are, whatever their names. Null texts, repeated and null ids go as assign_shards says; an
    empty table writes no shard.
    """
    taken = {c.lower() for c in docs.columns}
    key = next(k for k in ("shard", *(f"shard_{i}" for i in range(1, len(taken) + 2))) if k not in taken)
    shards = assign_shards(docs, limit).select("doc_id", "shard").distinct()
    given = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), F.col("doc_id").alias("id"))
    placed = given.join(shards, given["id"].eqNullSafe(shards["doc_id"]))
    placed.select(*[F.col("row")[c].alias(c) for c in docs.columns], F.col("shard").alias(key)).repartition(key).write.partitionBy(key).parquet(path)
    return key


def oracle() -> str:
    """DuckDB SQL for the query: the least depth at which a row's bucket fits, of all depths."""
    return f"""
    WITH r AS (SELECT doc_id, coalesce(strlen(text), 0)::BIGINT AS n_bytes, ('0x' || substr(md5(doc_id::VARCHAR), 1, 15))::BIGINT AS hash FROM documents),
    d AS (SELECT unnest(range(0, 31))::INTEGER AS depth),
    l AS (SELECT doc_id, n_bytes, hash, depth, hash >> (60 - depth) AS pos FROM r, d),
    b AS (SELECT depth, pos, sum(n_bytes)::BIGINT AS shard_bytes, count(*) AS shard_rows, min(hash) = max(hash) AS one FROM l GROUP BY depth, pos),
    f AS (SELECT doc_id, n_bytes, hash, depth, shard_bytes, shard_rows FROM l JOIN b USING (depth, pos) WHERE shard_bytes <= {LIMIT} OR one
          QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY depth) = 1)
    SELECT doc_id, n_bytes, CASE depth WHEN 0 THEN '' ELSE lpad(bin(hash >> (60 - depth)), depth, '0') END AS shard, depth,
           shard_bytes, shard_rows, shard_bytes > {LIMIT} AS over_limit FROM f
    """
