"""Fuzzy line dedup by MinHash.

Lines are compared as sets of character shingles. One sort of a line's shingle hashes gives its signature: the hash
range is cut into 2^BAND_BITS parts, and the ROWS smallest hashes from a part's start on are that band's key. Lines that
share a key are candidates; candidates are verified by the exact Jaccard similarity of all their shingles; links are joined by
distributed union-find, and each component keeps its first line. Only built-in functions run on the executors.

Lines with enough shingles whose first byte is one of SAMPLED are signed by these: a quarter of all byte values, spread evenly, so
it doesn't depend on the script or on white space. Lines that have few are signed by all shingles, and lines near the limit
both ways, so similar lines always have a way in common.

Each line of a key's list is first compared with the list's least line. What that leaves in different components is compared in
pairs where the list is short. The lines of long lists, as boilerplate makes them, meet by prefixes instead: of two similar lines,
both have one of the few shingles that come first in any fixed order, and the rarest come first here, so lines that have only their
boilerplate in common don't meet. The lines of such a shingle are compared with two of them first, and what is in different components
then, in pairs. So every two similar lines of long lists are linked, whether a list has both or not; lines that have nearly all
in common and aren't similar still meet in pairs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusops.llm.common import forget, join_hot, materialise
from corpusops.llm.components import components

CHARS = 8  # of a shingle
SIMILARITY = 0.8
BAND_BITS, ROWS = 3, 4  # 8 bands
LONG_LIST = 32  # lines of a key that are compared in pairs
FEW = 24  # different sampled shingles from which they alone sign a line
BLOCK = 1024  # lines with a shingle in their prefix, on average, that meet in one task
BROADCAST_ROWS = 1_000_000  # ids of 8 bytes, at most, that are sent to all executors

#: Bytes with which a sampled shingle starts, as a class of the regular expression.
SAMPLED = "".join(f"\\x{b:02x}" for b in range(256) if b * 77 % 256 < 64)


def _bind(value: Column, body) -> Column:
    return F.get(F.transform(F.array(value), body), 0)


def all_shingles(line: Column) -> Column:
    """Hashes of the line's shingles, repeats included; a line without any is one shingle."""
    found = F.transform(F.regexp_extract_all(line, F.lit(rf"(?s)(?=(.{{{CHARS}}}))"), F.lit(1)), lambda s: F.xxhash64(s))
    return _bind(found, lambda x: F.when(F.size(x) == 0, F.array(F.xxhash64(line))).otherwise(x))


def sampled_shingles(line: Column) -> Column:
    """Hashes of the shingles of the line's UTF-8 bytes that start with one of SAMPLED, repeats included."""
    found = F.regexp_extract_all(F.decode(F.encode(line, "UTF-8"), "ISO-8859-1"), F.lit(rf"(?s)(?=([{SAMPLED}].{{{CHARS - 1}}}))"), F.lit(1))
    return F.transform(found, lambda s: F.xxhash64(s))


def band_keys(shingles: Column, way: int) -> Column:
    """A key of each band: the hash of the ROWS smallest shingle hashes from the band's bound on, or of all if there are fewer.

    A band that holds fewer goes on into the next ones, the last into the first, so that no key rests on one or two
    common shingles. An empty band has the next one's key, so only the first hash of each band starts a key. way tells keys of
    different kinds of shingles apart.
    """
    other = lambda x, y: F.shiftrightunsigned(x.bitwiseXOR(y), 64 - BAND_BITS) != 0

    def of_sorted(s: Column) -> Column:
        starts = F.filter(s, lambda x, j: (j == 0) | other(x, F.get(s, j - 1)))
        round_twice, most = F.concat(s, F.slice(s, 1, ROWS)), F.least(F.size(s), F.lit(ROWS))
        return _bind(round_twice, lambda t: F.transform(starts, lambda x: F.xxhash64(F.slice(t, F.array_position(s, x).cast("int"), most), F.lit(way))))

    return _bind(F.sort_array(F.array_distinct(shingles)), of_sorted)


def line_keys(line: Column) -> Column:
    """Band keys of a line: by its sampled shingles if it has FEW, by all if it hasn't, by both from half as many to FEW.

    Similar lines have about as many sampled shingles, so they always have a way in common.
    """
    none = F.array().cast("array<bigint>")

    def of_sample(x: Column) -> Column:
        n = F.size(x)
        return F.concat(F.when(n >= FEW // 2, band_keys(x, 1)).otherwise(none), F.when(n < FEW, band_keys(all_shingles(line), 0)).otherwise(none))

    return _bind(F.array_distinct(sampled_shingles(line)), of_sample)


def text_hash() -> Column:
    return F.xxhash64(F.coalesce("text", F.lit("")))


def lines(docs: DataFrame, *more: str) -> DataFrame:
    """(doc_id, text_hash, line_no, line_id) of every line that isn't blank, from 0; line_id is a hash of the trimmed lower-case line.

    more: "line" for the line itself, or "line_id" and "line" alone.
    """
    each = docs.select("doc_id", text_hash().alias("text_hash"), F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("line_no", "raw"))
    each = each.select("doc_id", "text_hash", "line_no", F.lower(F.trim("raw")).alias("line")).where("line <> ''").withColumn("line_id", F.xxhash64("line"))
    return each.select(*(more or ("doc_id", "text_hash", "line_no", "line_id")))


def key_lists(docs: DataFrame) -> DataFrame:
    """(key, line_id, n, least): distinct lines of each band key that n > 1 of them have, and the least of these."""
    keyed = lines(docs, "line_id", "line").select("line_id", F.explode(line_keys(F.col("line"))).alias("key")).distinct()
    sizes = keyed.groupBy("key").agg(F.count("*").alias("n"), F.min("line_id").alias("least")).where("n > 1")
    return materialise(keyed.join(sizes, "key"))


def _texts_of(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(line_id, line) of the wanted line_ids."""
    if wanted.count() <= BROADCAST_ROWS:
        wanted = F.broadcast(wanted)
    return materialise(lines(docs, "line_id", "line").join(wanted, "line_id", "left_semi").groupBy("line_id").agg(F.min("line").alias("line")))


def verified(texts: DataFrame, pairs: DataFrame) -> DataFrame:
    """(a, b) of the pairs whose shingle sets have a Jaccard similarity of at least SIMILARITY; texts: (line_id, line)."""
    both = pairs.join(texts.select(F.col("line_id").alias("a"), F.col("line").alias("line_a")), "a").join(
        texts.select(F.col("line_id").alias("b"), F.col("line").alias("line_b")), "b"
    )
    a, b = (F.array_distinct(all_shingles(F.col(x))) for x in ("line_a", "line_b"))
    enough = _bind(F.struct(a.alias("a"), b.alias("b")), lambda x: (
        F.least(F.size(x["a"]), F.size(x["b"])) >= SIMILARITY * F.greatest(F.size(x["a"]), F.size(x["b"]))
    ) & _bind(
        F.size(F.array_intersect(x["a"], x["b"])), lambda n: n >= SIMILARITY * (F.size(x["a"]) + F.size(x["b"]) - n)
    ))
    return both.where(enough).select("a", "b")


def _with_component(rows: DataFrame, stars: DataFrame) -> DataFrame:
    """rows with the component of their line_id, by stars (node, component)."""
    return rows.join(stars.withColumnRenamed("node", "line_id"), "line_id", "left").withColumn("component", F.coalesce("component", "line_id"))


def _pairs(lists: DataFrame) -> DataFrame:
    """(a, b), a < b: pairs from different components of each row's members (line_id, component)."""
    each = lists.select(F.explode("members").alias("x"), "members")
    other = lambda y: (y["line_id"] > F.col("x.line_id")) & (y["component"] != F.col("x.component"))
    return each.select(F.col("x.line_id").alias("a"), F.explode(F.transform(F.filter("members", other), lambda y: y["line_id"])).alias("b"))


def prefixes(found: DataFrame) -> DataFrame:
    """(shingle, line_id, component, size, place, near): the first shingles of the lines found (line_id, component, line), in an order of rarity.

    size: the line's number of different shingles; place: where the shingle stands among them, from 1. Two similar lines have one of
    these shingles in common, and for the one of fewer shingles it is near. Shingles of one component's lines alone tell nothing and come first.
    """

    # Lines of a skewed table are dealt out evenly before they become many rows.
    sets = found.repartition("line_id").select("line_id", "component", F.array_distinct(all_shingles(F.col("line"))).alias("s"))
    each = materialise(sets.select("line_id", "component", F.size("s").alias("size"), F.explode("s").alias("shingle")))
    of_shingle = Window.partitionBy("shingle")
    n = F.when(F.min("component").over(of_shingle) < F.max("component").over(of_shingle), F.count("*").over(of_shingle)).otherwise(0)
    weighed = each.withColumn("n", n)
    placed = weighed.withColumn("place", F.row_number().over(Window.partitionBy("line_id").orderBy("n", "shingle")))
    beyond = lambda least: F.col("place") <= F.col("size") - F.ceil(least * F.col("size") - 1e-6) + 1
    first = placed.where((F.col("n") > 0) & beyond(SIMILARITY))
    return materialise(first.select("shingle", "line_id", "component", "size", "place", beyond(2 * SIMILARITY / (1 + SIMILARITY)).alias("near")))


def _fits(x: str, y: str) -> Column:
    """Whether lines x and y, of no more and no fewer shingles, can be similar where the first shingle they have in common is this one."""
    rest = F.least(F.col(f"{x}.size") - F.col(f"{x}.place"), F.col(f"{y}.size") - F.col(f"{y}.place")) + 1
    return (F.col(f"{x}.size") >= SIMILARITY * F.col(f"{y}.size") - 1e-6) & (rest * (1 + SIMILARITY) >= SIMILARITY * (F.col(f"{x}.size") + F.col(f"{y}.size")) - 1e-6)


def centred_pairs(first: DataFrame) -> DataFrame:
    """(a, b), a < b: of first, as prefixes() gives it, each shingle's lines with the lines of its least and its greatest component."""
    x, of_shingle = F.struct("component", "line_id"), Window.partitionBy("shingle")
    ends = first.select("line_id", "component", F.array(F.min(x).over(of_shingle), F.max(x).over(of_shingle)).alias("ends"))
    pairs = [
        ends.where(F.col("component") != end["component"]).select(F.least("line_id", end["line_id"]).alias("a"), F.greatest("line_id", end["line_id"]).alias("b"))
        for end in (F.col("ends")[0], F.col("ends")[1])
    ]
    return pairs[0].unionByName(pairs[1]).distinct()


def prefix_pairs(first: DataFrame) -> DataFrame:
    """(a, b), a < b: the pairs of different components that meet by first, as prefixes() gives it."""
    blocks = F.ceil(F.count("*").over(Window.partitionBy("shingle")) / BLOCK).cast("int")
    dealt = first.withColumn("blocks", blocks)
    fewer = dealt.where("near").withColumn("block", F.pmod(F.xxhash64("line_id"), F.col("blocks")).cast("int")).alias("x")
    more = dealt.withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).alias("y")
    order = F.struct("x.size", "x.line_id") < F.struct("y.size", "y.line_id")
    met = (F.col("x.shingle") == F.col("y.shingle")) & (F.col("x.block") == F.col("y.block")) & (F.col("x.component") != F.col("y.component"))
    pairs = fewer.join(more.hint("merge"), met & order & _fits("x", "y"))
    return pairs.select(F.least("x.line_id", "y.line_id").alias("a"), F.greatest("x.line_id", "y.line_id").alias("b")).distinct()


def rest_pairs(lists: DataFrame, texts: DataFrame) -> DataFrame:
    """(a, b), a < b: of the lines of lists (line_id, component) all pairs from different components, without those that prefixes tell apart."""
    return prefix_pairs(prefixes(lists.select("line_id", "component").distinct().join(texts, "line_id")))


def _apart(named: DataFrame) -> DataFrame:
    """named (key, component, ...) of the keys whose lines are in different components."""
    apart = named.groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low <> high").select("key")
    return materialise(named.join(apart, "key"))


def _linked(stars: DataFrame, links: DataFrame) -> DataFrame:
    """stars (node, component) with the links (a, b) between their components."""
    return materialise(components(stars.select(F.col("node").alias("a"), F.col("component").alias("b")).unionByName(links)))


def similar_lines(docs: DataFrame) -> DataFrame:
    """(node, component) of the lines that are similar to another, components being those of all similar pairs found."""
    listed = key_lists(docs)
    texts = _texts_of(docs, materialise(listed.select("line_id").distinct()))
    starred = listed.where("line_id <> least").select(F.col("least").alias("a"), F.col("line_id").alias("b")).distinct()
    stars = materialise(components(verified(texts, starred)))

    left = _apart(_with_component(listed, stars))
    forget(listed)
    members = F.collect_list(F.struct("line_id", "component")).alias("members")
    short = _pairs(left.where(F.col("n") <= LONG_LIST).where("line_id <> least").groupBy("key").agg(members)).distinct()
    more = verified(texts, short)
    long = left.where(F.col("n") > LONG_LIST)
    more = materialise(more)
    stars = stars if more.isEmpty() else _linked(stars, more)
    rest = _apart(_with_component(long.drop("component"), stars)).select("line_id", "component").distinct()
    if rest.isEmpty():
        return stars
    centred = centred_pairs(prefixes(rest.join(texts, "line_id")))
    stars = _linked(stars, materialise(verified(texts, centred)))
    more = materialise(verified(texts, rest_pairs(_with_component(rest.drop("component"), stars), texts)))
    return stars if more.isEmpty() else _linked(stars, more)


def _place() -> list[Column]:
    """What tells a document's place, in order: rows without an id come last."""
    return [F.col("doc_id").isNull().alias("no_id"), F.coalesce(F.col("doc_id").cast("bigint"), F.lit(0)).alias("id"), F.col("text_hash")]


def line_components(docs: DataFrame) -> DataFrame:
    """(doc_id, text_hash, line_no, component, kept) of every line that isn't blank; kept is true for one place of each component.

    component: a number that all lines of a component share. The place with the smallest doc_id, then hash of the text, then
    line number is kept; a null doc_id comes last. Rows that repeat a doc_id are told apart by their texts; rows that repeat both
    are one document. Case and outer spaces don't count. Null and empty texts have no lines; other columns of docs are
    ignored; an empty table gives an empty table.
    """
    found = similar_lines(docs).select(F.col("node").alias("line_id"), "component")
    every = materialise(lines(docs))
    joined = join_hot(every, found, "line_id").select("doc_id", "text_hash", "line_no", F.coalesce("component", "line_id").alias("component"))
    placed = joined.select("*", F.struct(*_place(), "line_no").alias("place"))
    firsts = placed.groupBy("component").agg(F.min("place").alias("place")).select("place", F.lit(True).alias("kept"))
    # Places are unique, so no component's lines meet in one task.
    return placed.join(firsts, "place", "left").select("doc_id", "text_hash", "line_no", "component", F.coalesce("kept", F.lit(False)).alias("kept"))


def _by_document(docs: DataFrame) -> DataFrame:
    """(id, n_lines, n_kept, gone) of each document that has lines; id: its place; gone: numbers of the removed lines."""
    each = line_components(docs).select(F.struct(*_place()).alias("id"), "line_no", "kept").distinct()
    gone = F.collect_list(F.when(~F.col("kept"), F.col("line_no"))).alias("gone")
    return each.groupBy("id").agg(F.count("*").alias("n_lines"), F.count_if("kept").alias("n_kept"), gone)


def line_report(docs: DataFrame) -> DataFrame:
    """(doc_id, n_lines, n_kept, removed) of every row: lines that aren't blank, those kept, the removed ones' numbers from 0, comma-joined.

    Null and empty texts have no lines; see line_components for repeated rows and ids. An empty table gives an empty table.
    """
    there = docs.select("doc_id", text_hash().alias("text_hash")).select("doc_id", F.struct(*_place()).alias("id"))
    return there.join(_by_document(docs), "id", "left").select(
        "doc_id", F.coalesce("n_lines", F.lit(0)).alias("n_lines"), F.coalesce("n_kept", F.lit(0)).alias("n_kept"),
        F.array_join(F.sort_array(F.coalesce("gone", F.array().cast("array<int>"))).cast("array<string>"), ",").alias("removed"),
    )


def dedup_lines(docs: DataFrame) -> DataFrame:
    """docs without the lines that aren't kept; columns and rows as before, whatever the columns' names.

    A text of which no line is left is empty; texts that lose no line, null ones included, are as they were. Rows that repeat a
    doc_id lose their own lines alone; rows that repeat doc_id and text lose the same ones. An empty table gives an empty table.
    """
    given = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("doc"), "doc_id", text_hash().alias("text_hash")).select("doc", F.struct(*_place()).alias("id"))
    gone = _by_document(docs).where(F.size("gone") > 0).select("id", "gone")
    left = F.array_join(F.filter(F.split("doc.text", "\n"), lambda x, i: ~F.array_contains("gone", i)), "\n")
    text = F.when(F.col("gone").isNotNull(), left).otherwise(F.col("doc.text"))
    return given.join(gone, "id", "left").select(*[text.alias(c) if c == "text" else F.col("doc")[c].alias(c) for c in docs.columns])
