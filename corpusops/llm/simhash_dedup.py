"""SimHash near-duplicates by a byte-position inverted index with count filtering.

Two 64-bit fingerprints that differ in at most MAX_BITS = 2 bits share at least 6 of their 8 positional bytes. The inverted index
has postings by four positions and their four bytes, for the 14 sets of four positions whose numbers XOR to zero: any three
positions are in exactly one of them. So fingerprints that share 4 or 5 positional bytes meet in one posting at most, those
that share 6 in three, 7 in seven and 8 in all. Pairs are tallied over the postings; those below the guaranteed minimum of
three are dropped, and the rest are verified bit by bit. Long postings, as thousands of near copies make them, are never paired:
their members link through the values one bit from their other bytes, which any two within two bits share.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusops.llm.common import NO_ID, forget, join_hot, materialise, texts
from corpusops.llm.components import components

WORDS = 3  # of a shingle
SEED = 42
MAX_BITS = 2
LONG_LIST = 32  # members; a longer posting links through shared values instead of pairs

#: Positions of the bytes of each posting, and the other four.
POSTINGS = [p for p in combinations(range(8), 4) if p[0] ^ p[1] ^ p[2] ^ p[3] == 0]
OTHERS = [tuple(i for i in range(8) if i not in p) for p in POSTINGS]
#: Postings that two fingerprints share at least, whichever MAX_BITS bytes differ.
MIN_TALLY = min(sum(not set(p) & set(differ) for p in POSTINGS) for differ in combinations(range(8), MAX_BITS))


def simhash(text: str) -> int:
    """Fingerprint of the shingles of a whole text, repeats included; 0 for a text without words."""
    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    shingles = map(b" ".join, zip(words, words[1:], words[2:], strict=False)) if len(words) >= WORDS else [b" ".join(words)]
    hashes = np.fromiter((xxhash.xxh64_intdigest(s, SEED) for s in shingles), "<u8")
    ones = np.zeros(64, np.int64)
    for k in range(0, len(hashes), 65_536):
        ones += np.unpackbits(hashes[k : k + 65_536].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(hashes), bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, text_hash, fp): NO_ID for a null id, a hash of the text, and the fingerprint as a signed 64-bit number."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            fp = np.array([simhash(x) for x in batch["text"]], np.uint64).astype(np.int64)
            yield pd.DataFrame({"doc_id": batch["doc_id"], "text_hash": batch["text_hash"], "fp": fp})

    source = texts(docs).withColumn("text_hash", F.xxhash64("text"))
    return source.mapInPandas(run, "doc_id bigint, text_hash bigint, fp bigint")


def _bytes(fp: Column, positions: tuple[int, ...]) -> Column:
    """The bytes at four positions as a number."""
    return sum(F.shiftrightunsigned(fp, 8 * p).bitwiseAND(F.lit(0xFF)) * (1 << 8 * k) for k, p in enumerate(positions))


def _near(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b)) <= MAX_BITS


def links(classes: DataFrame) -> DataFrame:
    """(a, b), a < b: linked fingerprints of classes (fp), which are distinct. Every link is one of these or follows from some."""
    key = F.array(*[F.lit(k << 32) + _bytes(F.col("fp"), p) for k, p in enumerate(POSTINGS)])
    entries = classes.select("fp", F.explode(key).alias("key"))
    sizes = entries.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    listed = materialise(entries.join(sizes, "key"))

    lists = listed.where(F.col("n") <= LONG_LIST).groupBy("key").agg(F.collect_list("fp").alias("members"))
    pairs = lists.select(F.explode("members").alias("a"), "members").select("a", F.explode(F.filter("members", lambda y: y > F.col("a"))).alias("b"))
    tallied = pairs.groupBy("a", "b").agg(F.count("*").alias("shared")).where(F.col("shared") >= MIN_TALLY)
    short = tallied.where(_near(F.col("a"), F.col("b"))).select("a", "b")

    # At most 33 different fingerprints of a posting are within one bit of a value, so these lists are short.
    rest = F.get(F.array(*[_bytes(F.col("fp"), p) for p in OTHERS]), F.shiftright("key", 32).cast("int"))
    changes = F.array(*[F.lit(x).cast("bigint") for x in (0, *(1 << i for i in range(32)))])
    close = F.flatten(F.transform(F.array(rest), lambda x: F.transform(changes, lambda m: x.bitwiseXOR(m))))
    spread = listed.where(F.col("n") > LONG_LIST).select("key", "fp", F.explode(close).alias("value"))
    near = spread.groupBy("key", "value").agg(F.collect_list("fp").alias("fps")).where(F.size("fps") > 1)
    near = near.select(F.array_min("fps").alias("a"), F.explode("fps").alias("b")).where("a < b").distinct()
    return short.unionByName(near.where(_near(F.col("a"), F.col("b")))).distinct()


def _components(fps: DataFrame) -> DataFrame:
    """(fp, component) of every fingerprint; a component's name is one of its fingerprints."""
    classes = materialise(fps.select("fp").distinct())
    found = components(links(classes))
    return classes.join(found, classes["fp"] == found["node"], "left").select("fp", F.coalesce("component", "fp").alias("component"))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """(doc_id, fingerprint, component_id) of every document.

    fingerprint: 16 hexadecimal digits; component_id: the smallest doc_id that links of at most MAX_BITS differing bits
    reach, the document's own included. Null and empty texts have fingerprint zero and link like any other. A row
    without a doc_id links like others but doesn't name its component; one with such rows alone gets null. Rows that repeat
    a doc_id each give a row; other columns of docs are ignored; an empty table gives an empty table.
    """
    fps = materialise(fingerprints(docs).drop("text_hash").withColumn("doc_id", F.nullif("doc_id", F.lit(NO_ID))))
    least = fps.groupBy("fp").agg(F.min("doc_id").alias("least"))
    named = materialise(_components(fps).join(least, "fp"))
    firsts = named.groupBy("component").agg(F.min("least").alias("component_id"))
    done = join_hot(fps, join_hot(named, firsts, "component").select("fp", "component_id"), "fp")
    return done.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame) -> DataFrame:
    """One row of docs for each component of near_duplicates: that with the smallest doc_id, then by a hash of the text.

    Rows without a doc_id come after all others. Rows that repeat a doc_id are told apart by their texts; of rows that repeat
    both, one stays. Null and empty texts are near duplicates of each other. Columns are as before, whatever their
    names; an empty table gives an empty table. Texts that differ in doc_id or wording are never dropped but as near duplicates.
    """
    order = lambda x: F.struct(F.col(x).isNull().alias("no_id"), F.coalesce(F.col(x).cast("bigint"), F.lit(0)).alias("id"))
    fps = materialise(fingerprints(docs).withColumn("doc_id", F.nullif("doc_id", F.lit(NO_ID))))
    each = fps.groupBy("doc_id", "text_hash", "fp").agg(F.count("*").alias("rows"))
    each = each.select("fp", F.struct(order("doc_id").alias("id"), "text_hash", "rows").alias("place"))
    least = each.groupBy("fp").agg(F.min("place").alias("place"))
    stays = materialise(_components(fps).join(least, "fp").groupBy("component").agg(F.min("place").alias("place")).select("place.*"))
    forget(fps)
    given = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("doc"), order("doc_id").alias("id"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("text_hash"))
    kept = given.join(stays, ["id", "text_hash"])
    if stays.where("rows > 1").isEmpty():
        return kept.select("doc.*")
    again = kept.where("rows > 1").dropDuplicates(["id", "text_hash"])
    return kept.where("rows = 1").unionByName(again).select("doc.*")
