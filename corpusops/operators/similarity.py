"""Joins by similarity that lose no pair: token sets by prefixes, titles by pieces at their places or by counted characters.

Every candidate comes from an equal key, which a bound on the similarity forces each pair to share; candidates are then verified.
Keys are chosen rare, so what many rows hold seldom brings rows together.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusops.plans.cut import cut

_CLASS = 1.5  # sizes of a class of token sets are within this ratio


_SENT = 200_000  # rows of few numbers that are sent to every task; more are joined by a shuffle


def _small(df: DataFrame) -> DataFrame:
    """df, to be sent where its rows, counted, are few; it is computed already."""
    return F.broadcast(df) if df.limit(_SENT + 1).count() <= _SENT else df


def meet(left: DataFrame, right: DataFrame, on, how: str = "inner") -> DataFrame:
    """left joined with right by a shuffle and a merge, which spills, whatever their sizes.

    Spark takes exploded rows for no more than the rows that they came from, so it would send sides of millions of rows to the driver.
    """
    return left.join(right.hint("merge"), on, how)


def meet_few(left: DataFrame, right: DataFrame, on, how: str = "inner") -> DataFrame:
    """left joined with right, which is computed already: sent to every task where its rows, counted, are few, else as by ``meet``."""
    few = _small(right)
    return left.join(few, on, how) if few is not right else meet(left, right, on, how)


def _ceil(c: Column) -> Column:
    return F.ceil(c - 1e-9).cast("int")


def similar_sets(left: DataFrame, right: DataFrame, threshold: float) -> DataFrame:
    """(a, b, n, m, shared): pairs of left and right (id, tokens) whose token sets have a Jaccard similarity of at least the threshold, above 0.

    Sets of n and m tokens that are so similar share at least t (n + m) / (1 + t). With both sorted from the rarest token, the first
    they share is among the first n - shared + 1 of one and m - shared + 1 of the other, so only these prefixes meet, and only in
    classes of sizes that can be similar. Tokens that the right doesn't have are the rarest and never leave their row. Ids are unique.
    """
    share = threshold / (1 + threshold)
    size_class = lambda n: F.floor(F.log(n) / F.log(F.lit(_CLASS))).cast("int")
    left, right = left.toDF("a", "x").where(F.size("x") > 0), right.toDF("b", "y").where(F.size("y") > 0)
    theirs = right.select("b", F.size("y").alias("m"), F.explode("y").alias("w"))
    known = theirs.select("w").distinct()
    ours = left.select("a", F.size("x").alias("n"), F.explode("x").alias("w"))
    ours = meet(ours, known, "w")
    ours = cut(ours)
    uses = ours.groupBy("w").agg(F.count("*").alias("uses"))

    theirs = meet(theirs, uses, "w", "left").withColumn("uses", F.coalesce("uses", F.lit(0)))
    theirs = theirs.withColumn("q", F.row_number().over(Window.partitionBy("b").orderBy("uses", "w")))
    low = F.pow(F.lit(_CLASS), F.col("class"))
    classes = F.sequence(size_class(F.greatest(F.lit(1.0), F.col("m") * threshold)) - 1, size_class(F.col("m") / threshold) + 1)
    theirs = theirs.withColumn("class", F.explode(classes))
    theirs = theirs.where(F.col("q") <= F.col("m") - _ceil((F.greatest(low, F.col("m") * threshold) + F.col("m")) * share) + 1).where("uses > 0")

    held = meet(ours, uses, "w").groupBy("a", "n").agg(F.sort_array(F.collect_list(F.struct("uses", "w"))).alias("kept"))
    held = cut(held.select("a", "n", F.transform("kept", lambda t: t["w"]).alias("kept")))
    first = F.col("n") - _ceil(F.col("n") * (1 + threshold) * share) + 1  # with the smallest set that can be similar
    free = F.col("n") - F.size("kept")
    mine = held.where(first > free).select("a", "n", size_class(F.col("n")).alias("class"), free.alias("free"), F.posexplode(F.slice("kept", F.lit(1), first - free)).alias("at", "w"))
    mine = mine.select("a", "n", "class", (F.col("free") + F.col("at") + 1).alias("p"), "w")

    n, m = F.col("n"), F.col("m")
    need = _ceil((n + m) * share)
    fits = (m >= n * threshold - 1e-9) & (n >= m * threshold - 1e-9) & (F.col("p") <= n - need + 1) & (F.col("q") <= m - need + 1)
    pairs = meet(mine, theirs.drop("uses"), ["w", "class"]).where(fits).select("a", "b").distinct()
    # Whatever two sets share is among the tokens that were kept.
    whole = meet(meet(pairs, held, "a"), right, "b").select("a", "b", "n", F.size("y").alias("m"), F.size(F.array_intersect("kept", "y")).alias("shared"))
    return whole.where(F.col("shared") / (n + m - F.col("shared")) >= threshold)


def _edits(length: Column, threshold: float) -> Column:
    return F.floor(length * (1 - threshold) + 1e-9).cast("int")


_BITS = 192  # of a text's mark


def _pairs(text: Column) -> Column:
    """Hashes of the text's pairs of characters, sorted."""
    return F.sort_array(F.transform(F.when(F.length(text) > 1, F.sequence(F.lit(1), F.length(text) - 1)), lambda i: F.xxhash64(F.substring(text, i, F.lit(2)))))


def _places(pairs: Column) -> Column:
    """The bits of the pairs, each with how often it came before: what two texts don't share of these grows with all that one holds more often."""
    return F.transform(pairs, lambda x, i: F.pmod(F.xxhash64(x, i - F.array_position(pairs, x)), F.lit(_BITS)).cast("int"))


def _words(places: Column) -> list[Column]:
    word = lambda low: F.aggregate(F.filter(places, lambda x: (x >= low) & (x < low + 64)), F.lit(0).cast("bigint"), lambda got, x: got.bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("bigint"), x)))
    return [F.coalesce(word(low), F.lit(0).cast("bigint")).alias(f"m{low}") for low in range(0, _BITS, 64)]


def _mark(text: Column) -> list[Column]:
    """Numbers of 64 bits: whether an even or odd number of the text's numbered pairs of characters fall on each of _BITS. An edit changes four bits at most."""
    return _words(_places(_pairs(text)))


def marked(t: DataFrame) -> DataFrame:
    """(id, text) with the words of the text's mark, for tables that several joins read.

    As _mark does, but in steps: what an expression refers to more than once is computed once only as a column.
    """
    key, text = t.columns
    t = t.withColumn("pairs", _pairs(F.col(text))).withColumn("places", _places(F.col("pairs")))
    return t.select(key, text, *_words(F.col("places")))


def near_texts(a: DataFrame, b: DataFrame, threshold: float) -> DataFrame:
    """(a, b): ids of texts, of a and b (id, text), an edit distance of at most (1 - threshold) of the longer length apart; empty ones find nothing."""
    return edit_distances(a, b, threshold).select("a", "b")


def edit_distances(a: DataFrame, b: DataFrame, threshold: float) -> DataFrame:
    """(a, b, ta, tb, edits): pairs of ``near_texts`` with their texts and edit distance; a and b may be ``marked`` already.

    The longer is cut into pieces of nearly equal size, one more than there can be edits. One of these, the i-th, stands in the shorter unharmed, with at most i edits before it and the rest after it; so the shorter looks
    up the substrings at those few places alone. Lengths, pieces and substrings meet as one hash. What meets goes on only where
    the marks of both texts differ by as few bits as the edits leave; distances decide.
    """
    marks = [f"m{low}" for low in range(0, _BITS, 64)]
    a, b = (t if len(t.columns) > 2 else marked(t) for t in (a, b))
    texts = a.toDF("id", "text", *marks).withColumn("side", F.lit(0)).unionByName(b.toDF("id", "text", *marks).withColumn("side", F.lit(1)))
    texts = texts.where("text <> ''").withColumn("len", F.length("text"))
    # At most a row for each length that a title has.
    lengths = texts.groupBy("side", "len").agg(F.count("*").alias("n"))
    other = lengths.select((1 - F.col("side")).alias("side"), F.col("len").alias("other"))
    # Of two equally long texts the first side's is cut.
    long = lengths.select("side", "len").join(other, "side").where((F.col("other") <= F.col("len") - F.col("side")) & (F.col("other") >= F.col("len") - _edits(F.col("len"), threshold)))
    edits = _edits(F.col("len"), threshold)
    long = _small(cut(long.withColumn("edits", edits).withColumn("pieces", edits + 1)))

    def cuts(length: Column, pieces: Column) -> Column:
        edge = lambda j: F.floor(j * length / pieces).cast("int")
        return F.transform(F.sequence(F.lit(0), pieces - 1), lambda j: F.struct(j.alias("j"), edge(j).alias("start"), (edge(j + 1) - edge(j)).alias("size")))

    key = lambda side, text: F.xxhash64(side, "len", "x.j", text)
    whole = long.groupBy("side", "len", "edits", "pieces").agg(F.min("other").alias("least"))
    pieces = texts.join(_small(whole), ["side", "len"]).withColumn("x", F.explode(cuts(F.col("len"), F.col("pieces"))))
    pieces = pieces.select(F.col("id").alias("longer"), "side", "edits", *marks, key(F.col("side"), F.substring("text", F.col("x.start") + 1, F.col("x.size"))).alias("key"))

    # The shorter texts, with the lengths and places at which they can hold a piece.
    asked = texts.select("id", "text", *marks, (1 - F.col("side")).alias("side"), F.col("len").alias("other")).join(long, ["side", "other"])
    asked = asked.withColumn("x", F.explode(cuts(F.col("len"), F.col("pieces"))))
    j, start, less = F.col("x.j"), F.col("x.start"), F.col("other") - F.col("len")
    after = F.col("edits") - j
    low = F.greatest(F.lit(0), start - j, start + less - after)
    high = F.least(F.col("other") - F.col("x.size"), start + j, start + less + after)
    asked = asked.withColumn("low", low).withColumn("high", high).where("low <= high").withColumn("at", F.explode(F.sequence("low", "high")))
    asked = asked.select(F.col("id").alias("shorter"), *[F.col(m).alias(f"o{m}") for m in marks], key(F.col("side"), F.substring("text", F.col("at") + 1, F.col("x.size"))).alias("key"))

    unlike = sum((F.bit_count(F.col(m).bitwiseXOR(F.col(f"o{m}"))) for m in marks), F.lit(0))
    met = meet(pieces, asked, "key").where(unlike <= 4 * F.col("edits"))
    pairs = met.select(F.when(F.col("side") == 0, F.col("longer")).otherwise(F.col("shorter")).alias("ia"), F.when(F.col("side") == 0, F.col("shorter")).otherwise(F.col("longer")).alias("ib")).distinct()
    pairs = meet(meet(pairs, a.drop(*marks).toDF("ia", "ta"), "ia"), b.drop(*marks).toDF("ib", "tb"), "ib")
    distance = F.expr(f"levenshtein(ta, tb, cast(floor(greatest(length(ta), length(tb)) * (1 - {threshold}D) + 1e-9) as int))")
    # Behind a generator, so that it is computed once: a filter on a projection would write it out again.
    near = pairs.select("*", F.explode(F.array(distance)).alias("edits")).where("edits >= 0")
    return near.select(F.col("ia").alias("a"), F.col("ib").alias("b"), "ta", "tb", "edits")


def _characters(c: Column) -> Column:
    """Each character with how often it came before: ``aba`` gives a0, b0, a1."""
    chars = F.filter(F.split(c, ""), lambda x: x != "")
    return F.transform(chars, lambda x, i: F.concat(x, F.size(F.filter(F.slice(chars, F.lit(1), i), lambda y: y == x)).cast("string")))


def common_characters(a: DataFrame, b: DataFrame, threshold: float) -> DataFrame:
    """(a, b): ids of texts, of a and b (id, text), whose common characters, counted as often as both have them, are at least ``threshold`` of half the lengths' sum.

    No ratio of matching blocks is above that share. Characters with their number are sorted from the rarest; the first that two
    texts share is in the prefix that their lengths leave, so texts meet by it and by the length of the other.
    """
    a, b = a.toDF("id", "text").where("text <> ''"), b.toDF("id", "text").where("text <> ''")
    each = lambda t: t.select("id", "text", F.length("text").alias("len"), _characters(F.col("text")).alias("chars"))
    a, b = cut(each(a)), cut(each(b))
    # Not more rows than there are characters times the longest text has places.
    uses = b.select(F.explode("chars").alias("c")).groupBy("c").agg(F.count("*").alias("uses"))
    need = lambda x, y: _ceil((x + y) * threshold / 2)

    def ranked(t: DataFrame) -> DataFrame:
        rows = t.select("id", "len", F.explode("chars").alias("c"))
        rows = meet(rows, uses, "c", "left")
        return rows.withColumn("p", F.row_number().over(Window.partitionBy("id").orderBy(F.coalesce("uses", F.lit(0)), "c"))).drop("uses")

    lengths = _small(cut(b.select(F.col("len").alias("other")).distinct()))
    la, lb = F.col("len"), F.col("other")
    shortest = _ceil(lb * threshold / (2 - threshold))
    near = F.sequence(_ceil(la * threshold / (2 - threshold)), F.floor(la * (2 - threshold) / threshold + 1e-9).cast("int"))
    mine = ranked(a).withColumn("other", F.explode(near)).join(lengths, "other").where(F.col("p") <= la - need(la, lb) + 1)
    theirs = ranked(b).select(F.col("id").alias("b"), F.col("len").alias("other"), "c", F.col("p").alias("q"))
    theirs = theirs.where(F.col("q") <= lb - need(lb, shortest) + 1)
    met = meet(mine, theirs, ["c", "other"]).where(F.col("q") <= lb - need(la, lb) + 1)
    room = 1 + F.least(la - F.col("p"), lb - F.col("q")) >= need(la, lb)
    pairs = met.where(room).select(F.col("id").alias("a"), "b").distinct()
    whole = meet(meet(pairs, a.select(F.col("id").alias("a"), F.col("chars").alias("x")), "a"), b.select(F.col("id").alias("b"), F.col("chars").alias("y")), "b")
    return whole.where(F.size(F.array_intersect("x", "y")) >= need(F.size("x"), F.size("y"))).select("a", "b")
