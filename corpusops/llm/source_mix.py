"""Mixing sources to target weights by systematic sampling.

A source's documents expect the same number of copies each, its target by its size. In an order by size, the expected copies are
summed up, one random offset is added, and a document is emitted once for each integer that the sum crosses at it. Whole
documents miss the target by less than the largest; the documents that are small beside what is missing are then drawn again, with
the copies that they are to make up for it. Sums are ranks times a fraction of whole numbers, so boundaries are exact at any size
and no document is taken more often than its limit.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusops.llm.common import NO_ID, SPACES, join_hot, materialise, running

#: The weights that sources take in turn, and how many times its size a source may be taken.
WEIGHTS = (5, 2, 1)
LIMIT = 3

STEPS = 65536  # places that an offset can have between two integers
ROUNDS = 3  # draws: of all documents, then twice of those that are at most half of what is missing
OFFSETS = 16  # places that are tried for each source's offset, evenly from its random one; the nearest sum to the target is taken

_NONE = "~"  # key of a null source; others begin with a space, so it is the last


def _whole(c: str, digits: int = 20) -> str:
    return f"cast({c} as decimal({digits}, 0))"


def _sizes(docs: DataFrame) -> DataFrame:
    """(key, doc_id, size, text_hash): a slim row for each document."""
    size = F.coalesce(F.regexp_count("text", F.lit(f"[^{SPACES}]+")), F.lit(0)).cast("bigint")
    key = F.coalesce(F.concat(F.lit(" "), "source"), F.lit(_NONE))
    text = F.xxhash64(F.coalesce("text", F.lit("")))
    return docs.select(key.alias("key"), F.col("doc_id").cast("bigint").alias("doc_id"), size.alias("size"), text.alias("text_hash"))


def targets(sizes: DataFrame) -> DataFrame:
    """(key, docs, source_size, num, den, target) of each source of (key, size): its target is num / den words.

    Sources in the order of their keys weigh WEIGHTS in turn and share all words by weight. A target stops at LIMIT times the
    source's size and the excess goes to the others by weight, again and again: the end of that is one level a weight for all
    that don't stop, which is found where sources are summed by their limit to a weight.
    """
    sources = sizes.groupBy("key").agg(F.count("*").alias("docs"), F.sum("size").alias("source_size")).withColumn("one", F.lit(1).cast("bigint"))
    placed = running(sources, [], ["key"], ["one"])
    turns = F.element_at(F.array(*[F.lit(w).cast("bigint") for w in WEIGHTS]), (F.col("one_before") % len(WEIGHTS) + 1).cast("int"))
    unit = 1
    for w in WEIGHTS:
        unit *= w
    weighed = placed.select("key", "docs", "source_size", turns.alias("weight"), (F.col("source_size") * LIMIT).alias("most"))
    weighed = weighed.withColumn("stop", F.expr(f"{_whole('most')} * ({unit} div weight)"))
    filled = running(weighed, [], ["stop", "key"], ["most", "weight", "source_size"])
    filled = filled.select("key", "docs", "source_size", "weight", "most", "stop", (F.col("source_size_all") - F.col("most_before")).alias("rest"), (F.col("weight_all") - F.col("weight_before")).alias("weights"))
    open_ = filled.where(f"{_whole('weight')} * rest <= {_whole('most')} * weights").agg(F.min_by(F.struct("rest", "weights", "stop", "key"), F.struct("stop", "key")).alias("x")).select("x.*")
    level = open_.select("rest", "weights", F.col("stop").alias("from_stop"), F.col("key").alias("from_key"))
    stops = (F.col("stop") < F.col("from_stop")) | ((F.col("stop") == F.col("from_stop")) & (F.col("key") < F.col("from_key")))
    joined = filled.drop("rest", "weights").join(F.broadcast(level))  # one row
    num = F.when(stops, F.expr(_whole("most", 20))).otherwise(F.expr(f"cast({_whole('weight', 3)} * {_whole('rest', 17)} as decimal(20, 0))"))
    den = F.when(stops, F.lit(1).cast("bigint")).otherwise(F.col("weights"))
    out = joined.select("key", "docs", "source_size", num.alias("num"), den.cast("bigint").alias("den"))
    return out.withColumn("target", F.col("num").cast("double") / F.col("den").cast("double"))


def _offset(key: Column, turn: Column | int) -> Column:
    first = F.conv(F.substring(F.md5(key), 1, 4), 16, 10).cast("bigint")
    return F.pmod(first + F.lit(turn) * (STEPS // OFFSETS), F.lit(STEPS))


def _copies(offset: str) -> str:
    """Integers crossed between rank and the next, counted from the first that is drawn, each times num / (den * space) and moved by the offset."""
    share = f"({_whole('den', 10)} * {_whole('space', 16)})"
    crossed = [f"(({_whole(rank, 12)} * num * {STEPS} + {_whole(offset, 6)} * {share}) div ({share} * {STEPS}))" for rank in ("rank - first + 1", "rank - first")]
    return f"{crossed[0]} - {crossed[1]}"


def plan_mix(docs: DataFrame) -> DataFrame:
    """(doc_id, source, text_hash, size, source_size, target, copies) of every row: how often the mix takes the document, whole each time.

    size: words between white space. copies: integers that the expected copies, summed within the source from the largest
    document to the smallest, cross at this one; at most LIMIT. The offset is drawn from the source's name, so reruns agree; of
    OFFSETS even shifts of it the one whose words come nearest to the target is used, the first of equals. Each further round
    leaves at most half of what was missing, unless the small documents are used up.

    Null texts have no words; a null source is one of its own, the last. Documents without words have copies too, of nothing; in
    a source without words none has. Documents of equal size go by the hash of their id and then by their text's, rows equal in
    all of these are interchangeable. Repeated rows are sampled each on their own. Other columns are ignored; an empty table
    gives an empty table.
    """
    sizes = materialise(_sizes(docs))
    goals = materialise(targets(sizes))
    order = [(-F.col("size")).alias("least"), F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("-"))).alias("tie")]
    ranked = running(sizes.select("*", F.lit(1).cast("bigint").alias("one"), *order), ["key"], ["least", "tie", "text_hash"], ["one"])
    ranked = materialise(ranked.select("key", "doc_id", "size", "text_hash", F.col("one_before").alias("rank")))

    rows, out = ranked, None
    draw = goals.withColumns({"space": F.col("source_size"), "first": F.lit(0).cast("bigint")})
    for turn in range(ROUNDS):
        tried = join_hot(rows, draw, "key").where("space > 0")
        for j in range(OFFSETS):
            tried = tried.withColumn(f"o{j}", _offset(F.col("key"), j))
        sums = tried.groupBy("key", "num", "den").agg(*[F.sum(F.expr(_copies(f"o{j}")) * F.col("size")).alias(f"s{j}") for j in range(OFFSETS)])
        off = [F.struct(F.expr(f"abs({_whole(f's{j}')} * den - num)").alias("off"), F.lit(j).alias("turn")) for j in range(OFFSETS)]
        nearest = sums.select("key", F.array_min(F.array(*off)).alias("x")).select("key", _offset(F.col("key"), F.col("x.turn")).alias("offset"), F.col("x.off").alias("off"))
        draw = materialise(draw.join(nearest, "key", "left"))
        drawn = join_hot(rows, draw, "key").withColumn("copies", F.when(F.col("space") > 0, F.expr(_copies("offset"))).otherwise(F.lit(0).cast("bigint")))
        small = F.expr(f"space > 0 and {_whole('size', 16)} * 2 * den <= off") if turn < ROUNDS - 1 else F.lit(False)
        drawn = materialise(drawn.select(*ranked.columns, "source_size", "target", "copies", small.alias("small")))
        done = drawn.where("not small").drop("small")
        out = done if out is None else out.unionByName(done)
        if turn < ROUNDS - 1:
            big, words = F.expr("not small"), F.col("copies") * F.col("size")
            left = drawn.groupBy("key").agg(F.count(F.when(big, 1)).alias("bigs"), F.coalesce(F.sum(F.when(big, words)), F.lit(0)).alias("has"), F.coalesce(F.sum(F.when(~big, F.col("size"))), F.lit(0)).alias("space"))
            most = f"{_whole('den', 10)} * space * {LIMIT}"
            num = F.expr(f"cast(greatest(0, least(num - {_whole('has', 16)} * den, {most})) as decimal(20, 0))")
            draw = draw.drop("space", "offset", "off").join(left, "key").withColumns({"num": num, "first": F.col("first") + F.col("bigs")}).drop("bigs", "has")
            rows = drawn.where("small").select(*ranked.columns)
    source = F.when(F.col("key") != _NONE, F.substring("key", 2, 2**31 - 1))
    return out.select("doc_id", source.alias("source"), "text_hash", "size", "source_size", "target", "copies")


def mix(docs: DataFrame) -> DataFrame:
    """The rows of docs that the mix takes, each as often as plan_mix says, with all their columns and no others.

    Rows of the same doc_id, source and text are one document here: one of them is emitted for the copies of all.
    """
    keys = ["_id", "_source", "_hash"]
    named = docs.select(F.coalesce(F.col("doc_id").cast("bigint"), F.lit(NO_ID)).alias("_id"), F.coalesce(F.concat(F.lit(" "), "source"), F.lit(_NONE)).alias("_source"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("_hash"), F.struct("*").alias("_row"))
    plan = plan_mix(docs).where("copies > 0").select(
        F.coalesce("doc_id", F.lit(NO_ID)).alias("_id"), F.coalesce(F.concat(F.lit(" "), "source"), F.lit(_NONE)).alias("_source"), F.col("text_hash").alias("_hash"), "copies"
    )
    total = plan.groupBy(*keys).agg(F.sum("copies").alias("_copies"))
    taken = named.dropDuplicates(keys).join(total, keys)
    return taken.select("_row", F.explode(F.sequence(F.lit(1).cast("bigint"), "_copies"))).select("_row.*")


def oracle() -> str:
    """The same in DuckDB, with targets reshared in rounds, one for each source."""
    turns = " ".join(f"when {i} then {w}" for i, w in enumerate(WEIGHTS))
    crossed = lambda rank, o: f"(({rank})::hugeint * num * {STEPS} + ({o})::hugeint * den * space) // (den::hugeint * space * {STEPS})"
    copies = lambda o: f"({crossed('rank - first + 1', o)} - {crossed('rank - first', o)})"
    offset = "(('0x' || substr(md5(r.key), 1, 4))::bigint + j * {step}) % {steps}".format(step=STEPS // OFFSETS, steps=STEPS)

    def drawn(i: int) -> str:
        last = i == ROUNDS - 1
        ask = f"""
, tried{i} as (
  select r.key, j, {offset} o, abs(sum({copies(offset)} * size)::hugeint * any_value(den) - any_value(num)) off
  from rows{i} r join draw{i} d on d.key = r.key, (select unnest(range({OFFSETS})) j) where space > 0 group by r.key, j
), best{i} as (
  select key, o, off from (select *, row_number() over (partition by key order by off, j) pick from tried{i}) where pick = 1
), drawn{i} as (
  select r.doc_id, r.key, r.size, r.source_size, r.target, r.rank, case when space > 0 then {copies("o")} else 0 end copies,
    {"false" if last else "coalesce(space > 0 and size::hugeint * 2 * den <= off, false)"} as small
  from rows{i} r join draw{i} d on d.key = r.key left join best{i} b on b.key = r.key
)"""
        return ask if last else ask + f""", left{i} as (
  select key, count(*) filter (not small) bigs, coalesce(sum(copies * size) filter (not small), 0)::hugeint has, coalesce(sum(size) filter (small), 0)::hugeint space
  from drawn{i} group by key
), draw{i + 1} as (
  select d.key, greatest(0, least(num - has * den, den::hugeint * l.space * {LIMIT})) num, den, l.space, first + bigs as first from draw{i} d join left{i} l on l.key = d.key
), rows{i + 1} as (
  select * exclude (copies, small) from drawn{i} where small
)"""

    return rf"""
with recursive sizes as (
  select coalesce(' ' || source, '{_NONE}') as key, doc_id, len(regexp_extract_all(coalesce(text, ''), '[^{SPACES}]+'))::bigint size from documents
), sources as (
  select key, source_size, case (row_number() over (order by key) - 1) % {len(WEIGHTS)} {turns} end weight, sum(source_size) over () total
  from (select key, sum(size)::bigint source_size from sizes group by key)
), rounds as (
  select 0 as round, key, source_size, weight, false as stops, total::hugeint rest, (sum(weight) over ())::bigint weights from sources
  union all
  select round + 1, key, source_size, weight, over,
    (max(total) over () - coalesce(sum(case when over then {LIMIT} * source_size end) over (), 0))::hugeint, coalesce(sum(case when not over then weight end) over (), 0)::bigint
  from (select r.*, r.stops or weight::hugeint * rest > {LIMIT} * source_size::hugeint * weights as over, (sum(source_size) over ())::hugeint total from rounds r)
  where round <= (select count(*) from sources)
), goals as (
  select key, source_size, case when stops then {LIMIT} * source_size::hugeint else weight * rest end num, case when stops then 1 else weights end den
  from rounds where round = (select max(round) from rounds)
), ranked as (
  select s.*, source_size, num::double / den::double target, row_number() over (partition by s.key order by size desc, md5(coalesce(doc_id::varchar, '-'))) - 1 rank
  from sizes s join goals g on g.key = s.key
), rows0 as (
  select * from ranked
), draw0 as (
  select key, num::hugeint num, den, source_size space, 0::bigint as first from goals
){"".join(drawn(i) for i in range(ROUNDS))}
select doc_id, size, source_size, target, (copies * size)::bigint taken from ({" union all ".join(f"select * from drawn{i} where not small" for i in range(ROUNDS))})"""
