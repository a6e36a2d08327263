"""Document fingerprints by Order MinHash.

k-mers are runs of K tokens, numbered by occurrence so that repeats count. Hashes deal them into SKETCHES classes; each
class selects its PICKED smallest, puts these back into text order and hashes the tuple. Two texts agree in a class only
if the same k-mers stand in the same order, so likeness falls with edit distance, moved passages included. All of it is one
expression over a row's arrays: no text is spread over rows, and only ids and tails of texts are shuffled beside the texts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusops.llm.common import NO_ID, materialise

#: A token: up to eight characters of a word. A run of more than LONG_RUN characters is no word: each of its characters starts a
#: token of WINDOW characters, so that tokens meet again right after an inserted or deleted character.
TOKEN = r"\S{1,8}"
LONG_RUN, WINDOW = 24, 4
K = 3
SKETCH_BITS = 5
SKETCHES = 1 << SKETCH_BITS
PICKED = 2


def _bind(value: Column, body) -> Column:
    """body with a name for value: evaluated once a row, referred to often."""
    return F.get(F.transform(F.array(value), body), 0)


def _class(x: Column) -> Column:
    return F.shiftrightunsigned(x, 64 - SKETCH_BITS)


def _tokens(text: Column) -> Column:
    long = rf"\S{{{LONG_RUN + 1},}}"
    window = F.lit(rf"(?=(.{{{WINDOW}}}))")
    parts = F.regexp_extract_all(text, F.lit(f"{long}|{TOKEN}"), F.lit(0))
    cut = F.flatten(F.transform(parts, lambda x: F.when(F.length(x) > LONG_RUN, F.regexp_extract_all(x, window, F.lit(1))).otherwise(F.array(x))))
    return F.when(text.rlike(long), cut).otherwise(F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0)))


def _kmers(tokens: Column) -> Column:
    """Hash of the k-mer at each token; a shorter text is one k-mer, an empty one has none."""
    many = F.transform(F.sequence(F.lit(0), F.size(tokens) - K), lambda i: F.xxhash64(*[F.get(tokens, i + k) for k in range(K)]))
    one = F.array(F.xxhash64(F.array_join(tokens, " ")))
    return F.when(F.size(tokens) >= K, many).when(F.size(tokens) > 0, one).otherwise(F.array().cast("array<bigint>"))


def _repeats(extra: Column) -> Column:
    """(g, h, n): hash of the numbered occurrence, k-mer and number, from 2, of each repeat; extra: the repeats' k-mers, sorted."""
    starts = F.filter(F.sequence(F.lit(0), F.size(extra) - 1), lambda e: (e == 0) | (F.get(extra, e) != F.get(extra, e - 1)))

    def numbered(b: Column, stop: Column) -> Column:
        h = F.get(extra, b)
        return F.transform(F.sequence(F.lit(2), stop - b + 1), lambda n: F.struct(F.xxhash64(h, n).alias("g"), h.alias("h"), n.alias("n")))

    return _bind(starts, lambda s: F.flatten(F.transform(s, lambda b, r: numbered(b, F.coalesce(F.get(s, r + 1), F.size(extra))))))


def _signature(kmers: Column, ordered: Column, repeats: Column | None) -> Column:
    """ordered: hashes of the numbered k-mers, sorted; a first occurrence's is the k-mer's own."""
    picked = F.filter(ordered, lambda x, j: (j < PICKED) | (_class(F.get(ordered, j - PICKED)) != _class(x)))

    def placed(chosen: Column) -> Column:
        if repeats is None:
            return F.transform(chosen, lambda g: F.struct(_class(g).alias("c"), F.array_position(kmers, g).alias("at"), g.alias("g")))
        mine = F.filter(repeats, lambda d: F.array_contains(chosen, d["g"]))

        def at(d: Column) -> Column:
            places = F.filter(F.sequence(F.lit(1), F.size(kmers)), lambda i: F.get(kmers, i - 1) == d["h"])
            return F.get(places, d["n"] - 1).cast("bigint")

        first = lambda g: F.array_position(kmers, g)
        return _bind(mine, lambda m: F.transform(chosen, lambda g: F.struct(
            _class(g).alias("c"), F.when(first(g) > 0, first(g)).otherwise(_bind(F.get(F.filter(m, lambda d: d["g"] == g), 0), at)).alias("at"), g.alias("g"),
        )))

    def tuples(rows: Column) -> Column:
        each = lambda c: F.transform(F.filter(rows, lambda r: r["c"] == c), lambda r: r["g"])
        return F.transform(F.sequence(F.lit(0), F.lit(SKETCHES - 1)), lambda c: _bind(each(c), lambda x: F.when(F.size(x) > 0, F.hash(x))))

    return _bind(picked, lambda chosen: _bind(F.array_sort(placed(chosen)), tuples))


def signature(text: Column) -> Column:
    """Array of SKETCHES numbers, null for a class without k-mers."""

    def of_kmers(kmers: Column) -> Column:
        return _bind(F.sort_array(kmers), lambda s: _bind(
            F.filter(s, lambda x, j: (j > 0) & (x == F.get(s, j - 1))),
            lambda extra: F.when(F.size(extra) == 0, _signature(kmers, s, None)).otherwise(_bind(_repeats(extra), lambda d: _bind(
                F.sort_array(F.concat(F.array_distinct(kmers), F.transform(d, lambda x: x["g"]))), lambda o: _signature(kmers, o, d)
            ))),
        ))

    return _bind(_tokens(text), lambda tokens: _bind(_kmers(tokens), of_kmers))


def as_text(sig: Column) -> Column:
    """The signature as a string: eight hexadecimal digits a class, hyphens for one without k-mers."""
    return F.array_join(F.transform(sig, lambda x: F.coalesce(F.lpad(F.hex(x.cast("bigint").bitwiseAND(F.lit(0xFFFFFFFF))), 8, "0"), F.lit("--------"))), "")


def likeness(a: Column, b: Column) -> Column:
    """Share of the classes with k-mers in either text that agree; 1 for two texts without any."""
    same = F.size(F.filter(F.zip_with(a, b, lambda x, y: x == y), lambda x: x))
    used = F.size(F.filter(F.zip_with(a, b, lambda x, y: x.isNotNull() | y.isNotNull()), lambda x: x))
    return F.when(used == 0, F.lit(1.0)).otherwise(same / used)


def successors(ids: DataFrame) -> DataFrame:
    """(k, next_k) of distinct k, ascending, the first after the last: ranges are ordered apart and joined at their ends."""
    ranged = materialise(ids.select("k").repartitionByRange("k").withColumn("part", F.spark_partition_id()))
    heads = ranged.groupBy("part").agg(F.min("k").alias("head"))
    heads = heads.select("part", F.lead("head").over(Window.orderBy("head")).alias("next_head"), F.min("head").over(Window.partitionBy()).alias("least"))
    inside = F.lead("k").over(Window.partitionBy("part").orderBy("k"))
    return ranged.withColumn("inside", inside).join(heads, "part").select("k", F.coalesce("inside", "next_head", "least").alias("next_k"))


def fingerprint(docs: DataFrame) -> DataFrame:
    """(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next) of every document's whole text.

    The edited text has the last n_chars / 4 code points (rounded down) replaced by as many of the next document's first, or all
    that it has; the next document is the one with the next greater doc_id, after the last the first. Null text counts
    as empty and a null doc_id as smaller than all; where rows repeat a doc_id, each gives a row and the one
    with the least text is the next document. Equal texts have equal fingerprints. Other columns of docs are ignored; an
    empty table gives an empty table.
    """
    source = docs.select(F.coalesce(F.col("doc_id").cast("bigint"), F.lit(NO_ID)).alias("k"), F.coalesce("text", F.lit("")).alias("text"))
    ids = materialise(source.groupBy("k").agg(F.max(F.length("text")).alias("n"), F.count("*").alias("rows")))
    nexts = materialise(successors(ids).join(ids, "k").select(F.col("next_k").alias("to"), F.col("k").alias("from"), F.floor(F.col("n") / 4).cast("int").alias("q")))
    signed = source.select("k", "text", signature(F.col("text")).alias("sig"))
    given = signed
    if ids.where("rows > 1").limit(1).count():
        given = given.groupBy("k").agg(F.min("text").alias("text"), F.min_by("sig", "text").alias("sig"))
    given = given.join(nexts, F.col("k") == F.col("to")).select("from", F.left(F.col("text"), F.col("q")).alias("head"), F.col("sig").alias("next_sig"))
    rows = signed.join(given, F.col("k") == F.col("from"))
    n = F.length("text")
    q = F.floor(n / 4).cast("int")
    edited = rows.select("k", n.cast("bigint").alias("n_chars"), "sig", "next_sig", F.concat(F.left(F.col("text"), n - q), F.left(F.col("head"), q)).alias("edited"))
    both = edited.select("*", signature(F.col("edited")).alias("edited_sig"))
    return both.select(
        F.nullif("k", F.lit(NO_ID)).alias("doc_id"), "n_chars", F.sha2("edited", 256).alias("edited_sha256"), as_text(F.col("sig")).alias("fingerprint"),
        as_text(F.col("edited_sig")).alias("edited_fingerprint"), likeness(F.col("sig"), F.col("edited_sig")).alias("near_edited"),
        likeness(F.col("sig"), F.col("next_sig")).alias("near_next"),
    )
