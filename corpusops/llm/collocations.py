"""Phrase collocations by top-order marginalisation.

Every word starts one window: itself and the three words that follow it in its piece, padded where the piece ends. Only these
longest windows are counted. All shorter phrases are their prefixes, so a ROLLUP over the counted windows sums them; no phrase is
counted on its own. So that not every rare window is shuffled, windows are padded from the first pair of words that is too rare for
any candidate, too.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusops.llm.common import join_hot, materialise

#: The characters that end a piece, and the name of a missing language.
PIECE_ENDS = ".,;:!?\n\x0b\x0c\r"
UNKNOWN = "und"

LONGEST = 4  # words of the longest phrase
LEAST = 30  # occurrences that a candidate has at least
COVER = 80  # percent of a phrase's occurrences in a longer candidate that make it a part of that
SCALE = 2_000_000
TOP = 2000  # phrases of each language in the report
MAP_BITS = 27  # of the number of bits of the map of frequent pairs that is sent to the workers: at most 2 million rows of two numbers
SALTS = 64  # parts of a language that are ranked alone before the whole

_WORDS = [f"w{i}" for i in range(LONGEST)]
_PAD = ""  # no word is empty


def windows(docs: DataFrame, longest: int = LONGEST) -> DataFrame:
    """(lang, w0, w1, ...): the window of words that each word starts, padded with empty strings at the end of its piece."""
    upper, names = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", _WORDS[:longest]
    marked = F.translate(F.coalesce("text", F.lit("")), f"{upper}\t{PIECE_ENDS}", f"{upper.lower()} {'\n' * len(PIECE_ENDS)}")
    words = docs.select(F.coalesce("lang", F.lit(UNKNOWN)).alias("lang"), F.split(F.replace(marked, F.lit("\n"), F.lit(" \n ")), " +").alias("x"))
    lead = [F.col("x"), *[F.slice("x", i + 1, F.size("x")) for i in range(1, longest)]]
    each = words.select("lang", F.inline(F.arrays_zip(*[c.alias(w) for c, w in zip(lead, names, strict=True)])))
    each = each.toDF("lang", *names).where("w0 <> '' and w0 <> '\n'")
    for before, w in zip(names, names[1:]):
        ended = F.lit(False) if before == "w0" else F.col(before) == _PAD
        each = each.withColumn(w, F.when(ended | F.col(w).isNull() | (F.col(w) == "\n"), F.lit(_PAD)).otherwise(F.col(w)))
    return each


def _pair(a: str, b: str) -> Column:
    return F.xxhash64("lang", a, b)


def _cut_short(each: DataFrame, docs: DataFrame, least: int) -> DataFrame:
    """Windows up to their first pair of words that occurs too seldom: no phrase over it can occur often enough.

    Frequent pairs are bits of a map of MAP_BITS, a row for each 64 of them that has any, which bounds what is sent to the workers.
    Pairs that meet on a bit only leave a window longer than need be; the counts of frequent phrases are the same.
    """
    pairs = windows(docs, 2).where(F.col("w1") != _PAD).groupBy(_pair("w0", "w1").alias("pair")).agg(F.count("*").alias("n"))
    slot, place = lambda h: F.shiftrightunsigned(h, 70 - MAP_BITS), lambda h: h.bitwiseAND(63).cast("int")
    often = pairs.where(F.col("n") >= least).select(slot(F.col("pair")).alias("slot"), F.expr("shiftleft(1L, cast(pair & 63 as int))").alias("bit"))
    often = materialise(often.groupBy("slot").agg(F.bit_or("bit").alias("bits")))
    for before, w in zip(_WORDS, _WORDS[1:]):
        hashed = _pair(before, w)
        known = F.getbit("bits", place(hashed)) == 1
        kept = known if before == "w0" else known & (F.col(before) != _PAD)
        each = each.join(F.broadcast(often), slot(hashed) == F.col("slot"), "left").withColumn(w, F.when(kept, F.col(w)).otherwise(F.lit(_PAD))).drop("slot", "bits")
    return each


def phrase_counts(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """(lang, phrase, size, f): every phrase of up to four words that occurs ``least`` times or more, and each language's words as size 0."""
    counted = materialise(_cut_short(windows(docs), docs, least).groupBy("lang", *_WORDS).agg(F.count("*").alias("f")))
    shorter = counted.rollup("lang", *_WORDS[:-1]).agg(F.sum("f").alias("f"), F.grouping_id().alias("rolled"))
    # The grouping id has a bit for each column that is summed away: 0 for three words, 1 for two, 3 for one, 7 for a language, 15 for all.
    size = reduce(lambda c, n: c.when(F.col("rolled") == (1 << (LONGEST - 1 - n)) - 1, n), range(LONGEST), F)
    shorter = shorter.select("lang", *_WORDS[:-1], F.lit(None).cast("string").alias("w3"), size.alias("size"), "f").where("size is not null")
    every = shorter.unionByName(counted.select("lang", *_WORDS, F.lit(LONGEST).alias("size"), "f"))
    last = F.get(F.array(*_WORDS), F.col("size") - 1)
    phrases = every.where((F.col("size") == 0) | ((F.col("f") >= least) & (last != _PAD)))
    return phrases.select("lang", F.array_join(F.slice(F.array(*_WORDS), F.lit(1), F.col("size")), " ").alias("phrase"), "size", "f")


def _key(phrase: Column) -> Column:
    """Words hold no line feed, so a phrase and a language can't meet another's."""
    return F.concat(phrase, F.lit("\n"), F.col("lang"))


def _part(words: Column, start: int | Column, size: int | Column) -> Column:
    return F.array_join(F.slice(words, start, size), " ")


def mine_collocations(docs: DataFrame, least: int = LEAST, cover: int = COVER, top: int = TOP) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's best phrases by how often their parts occur together.

    a, l, r: occurrences of the phrase, and of the two parts of the cut that scores lowest; n: the language's words. The score is
    SCALE * a / (l + r), rounded down, in exact decimals. Phrases that a longer candidate covers are left out. Ranks go by
    score and a, both from the highest, then the phrase's bytes.

    Null texts hold no words; a null language is UNKNOWN, together with rows that name it. Repeated rows count each time. Phrases
    of equal score and a are told apart by their bytes, so there are no ties. Long texts are whole; an array of a text's words is
    in memory once. Other columns are ignored; an empty table gives an empty table.
    """
    counts = materialise(phrase_counts(docs, least))
    words = F.split("phrase", " ")
    found = counts.where("size > 1").select("lang", "phrase", "size", F.col("f").alias("a"), words.alias("words"))
    keyed = counts.where("size between 1 and 3").select(_key(F.col("phrase")).alias("key"), "f")

    k, size = F.col("k"), F.col("size")
    cuts = found.withColumn("k", F.explode(F.sequence(F.lit(1), size - 1)))
    left = cuts.select("lang", "phrase", "a", "k", F.lit(True).alias("first"), _key(_part(F.col("words"), F.lit(1), k)).alias("key"))
    right = cuts.select("lang", "phrase", "a", "k", F.lit(False).alias("first"), _key(_part(F.col("words"), k + 1, size - k)).alias("key"))
    sides = join_hot(left.unionByName(right), keyed, "key").groupBy("lang", "phrase", "a", "k")
    scored = sides.agg(F.max(F.when(F.col("first"), F.col("f"))).alias("l"), F.max(F.when(~F.col("first"), F.col("f"))).alias("r"))
    whole = lambda c: f"cast({c} as decimal(20, 0))"
    scored = scored.withColumn("score", F.expr(f"{whole('a')} * {SCALE} div ({whole('l')} + {whole('r')})"))
    scored = scored.groupBy("lang", "phrase", "a").agg(F.min_by(F.struct("l", "r", "score"), F.struct("score", "k")).alias("x")).select("lang", "phrase", "a", "x.*")

    inner = F.array(*[
        F.when(size > n, F.array(*[F.when(at + n <= size, _part(F.col("words"), at + 1, n)) for at in range(LONGEST - n + 1)]))
        for n in range(2, LONGEST)
    ])
    held = found.withColumn("phrase", F.explode(F.flatten(F.filter(inner, lambda x: x.isNotNull())))).where("phrase is not null")
    held = held.groupBy("lang", "phrase").agg(F.max("a").alias("most"))
    kept = scored.join(held, ["lang", "phrase"], "left").where(f"most is null or {whole('most')} * 100 < {whole('a')} * {cover}")

    order = [F.desc("score"), F.desc("a"), "phrase"]
    best = kept.withColumn("salt", F.pmod(F.xxhash64("phrase"), F.lit(SALTS)))
    best = best.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "salt").orderBy(*order))).where(F.col("rank") <= top)
    best = best.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).where(F.col("rank") <= top)
    sizes = counts.where("size = 0").select("lang", F.col("f").alias("n"))
    return best.join(sizes, "lang").select("lang", F.col("rank").cast("bigint").alias("rank"), "phrase", "a", "l", "r", "n", "score")


def oracle() -> str:
    """The same in DuckDB, by exploding phrases of each length."""
    ends = "".join(f"\\x{ord(c):02x}" for c in PIECE_ENDS)
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return rf"""
with pieces as (
  select coalesce(lang, '{UNKNOWN}') lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), '{upper}', '{upper.lower()}'), '[{ends}]')) piece from documents
), words as (
  select lang, regexp_extract_all(piece, '[^\x20\x09]+') w from pieces
), sizes as (
  select lang, sum(len(w))::bigint n from words group by lang
), occurrences as (
  select lang, size, array_to_string(w[p:p + size - 1], ' ') phrase
  from (select lang, w, size, unnest(range(1, len(w) - size + 2)) p from words, (select unnest([1, 2, 3, 4]) size) where len(w) >= size)
), freq as (
  select lang, phrase, any_value(size) size, count(*) f from occurrences group by lang, phrase having count(*) >= {LEAST}
), found as (
  select lang, phrase, size, f a, string_split(phrase, ' ') w from freq where size > 1
), cuts as (
  select c.lang, c.phrase, c.a, c.k, x.f l, y.f r, (c.a::hugeint * {SCALE}) // (x.f::hugeint + y.f) score
  from (select *, unnest(range(1, size)) k from found) c
  join freq x on x.lang = c.lang and x.phrase = array_to_string(c.w[1:c.k], ' ')
  join freq y on y.lang = c.lang and y.phrase = array_to_string(c.w[c.k + 1:], ' ')
), scored as (
  select * from (select *, row_number() over (partition by lang, phrase order by score, k) pick from cuts) where pick = 1
), inner_phrases as (
  select lang, array_to_string(w[p:p + m - 1], ' ') phrase, max(a) most
  from (select *, unnest(range(1, size - m + 2)) p from (select *, unnest(range(2, size)) m from found where size > 2))
  group by all
), kept as (
  select s.* from scored s left join inner_phrases i on i.lang = s.lang and i.phrase = s.phrase
  where i.most is null or i.most::hugeint * 100 < s.a::hugeint * {COVER}
), ranked as (
  select *, row_number() over (partition by lang order by score desc, a desc, phrase) rank from kept
)
select lang, rank, phrase, a, l, r, n, score::bigint score from ranked join sizes using (lang) where rank <= {TOP}"""
