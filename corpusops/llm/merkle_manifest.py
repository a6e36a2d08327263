"""Merkle manifest of a dataset as a postorder append log.

Each source is a tree over its rows, and a last tree over the sources' roots is the dataset. A tree is grown by aligned builders:
one takes 729 consecutive entries, six levels of three, and writes their nodes in the order in which they are complete, so every
node comes right after its last child. What the builders finish are the entries of the next layer. Where a node stands in such a
log follows from its level, its number and the number of entries alone, so siblings are addressed without searching.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusops.llm.common import join_hot, materialise, running

#: Children of a node, and what stands for a null field.
ARITY = 3
NULL = "-"

LEVELS = 6  # that a builder grows
SPAN = ARITY**LEVELS  # entries that a builder takes

_ALL = "all"  # key of the tree over the sources


def _hash(text: Column) -> Column:
    return F.sha2(text, 256)


def _field(c: Column) -> Column:
    s = c.cast("string")
    return F.coalesce(F.concat(F.octet_length(s).cast("string"), F.lit(":"), s), F.lit(NULL))


def leaf(*fields: Column) -> Column:
    """Hash of fields, of which none can run into the next."""
    return _hash(F.concat(*[_field(c) for c in fields]))


def position(level: int, number: Column, entries: Column, levels: int = LEVELS) -> Column:
    """Where the node of a level and number, both from 0, stands from 0 in the postorder log of a tree of so many entries.

    Before it are all nodes that end at an entry before its last, and those of lower levels that end there, too.
    """
    end = F.least((number + 1) * ARITY**level, entries)
    done = [F.ceil(end / ARITY**k) for k in range(level + 1)] + [F.floor((end - 1) / ARITY**k) for k in range(level + 1, levels + 1)]
    return reduce(lambda a, b: a + b, done) - 1


def _parents(nodes: Column) -> Column:
    last = F.floor((F.size(nodes) - 1) / ARITY).cast("int")
    return F.transform(F.sequence(F.lit(0), last), lambda j: _hash(F.array_join(F.slice(nodes, j * ARITY + 1, ARITY), "")))


def _build(entries: DataFrame) -> DataFrame:
    """(tree, block, n, high, m, entries, log) of each aligned builder over entries (tree, index, n, hash, ...): its nodes in postorder.

    n: entries of the whole tree; m: entries of this builder; high: levels that it grows, none where the tree is one entry.
    """
    block = F.floor(F.col("index") / SPAN).alias("block")
    rest = [c for c in entries.columns if c not in ("tree", "n")]
    grouped = entries.groupBy("tree", "n", block).agg(F.array_sort(F.collect_list(F.struct(*rest))).alias("entries"))
    high = reduce(lambda a, b: a + b, [(F.col("n") > ARITY**k).cast("int") for k in range(LEVELS)])
    grouped = grouped.withColumn("m", F.size("entries")).withColumn("high", high)
    climb = F.slice(F.array(*[F.lit(k) for k in range(LEVELS)]), F.lit(1), F.col("high"))
    base = F.array(F.transform("entries", lambda e: e["hash"]))
    levels = F.aggregate(climb, base, lambda done, _: F.concat(done, F.array(_parents(F.element_at(done, -1)))))
    empty = F.array().cast("array<string>")

    def placed(level: int) -> Column:
        nodes = F.coalesce(F.get("levels", F.lit(level)), empty)
        return F.transform(nodes, lambda h, j: F.struct(position(level, j, F.col("m")).alias("at"), h.alias("hash")))

    log = F.transform(F.array_sort(F.concat(*[placed(k) for k in range(LEVELS + 1)])), lambda x: x["hash"])
    return grouped.withColumn("levels", levels).withColumn("log", log).drop("levels")


def grow(entries: DataFrame) -> list[DataFrame]:
    """The layers of builders over entries (tree, index, n, hash, ...), the lowest first; index counts a tree's n entries from 0.

    The last node of a log is its builder's root; a layer's roots are the entries of the next, where a tree has more than one.
    """
    most = entries.agg(F.max("n")).first()[0] or 0
    layers = [materialise(_build(entries))]
    while most > SPAN:
        roots = layers[-1].where(F.col("n") > SPAN).select("tree", F.col("block").alias("index"), F.ceil(F.col("n") / SPAN).alias("n"), F.element_at("log", -1).alias("hash"))
        layers.append(materialise(_build(roots)))
        most = -(-most // SPAN)
    return layers


def roots(layers: list[DataFrame]) -> DataFrame:
    """(tree, root) of every tree."""
    each = [x.where(F.col("n") <= SPAN).select("tree", F.element_at("log", -1).alias("root")) for x in layers]
    return reduce(DataFrame.unionByName, each)


def _steps(index: Column) -> Column:
    """[(left, right)] of a builder's entry, level by level: the siblings before and after it, from the positions of the log."""

    def side(level: int, wanted) -> Column:
        own = F.floor(index / ARITY**level)
        run = F.floor(own / ARITY) * ARITY
        there = F.ceil(F.col("m") / ARITY**level)
        at = lambda s: F.get("log", position(level, s, F.col("m")).cast("int"))
        return F.concat(*[F.when(wanted(run + k, own) & (run + k < there), at(run + k)).otherwise(F.lit("")) for k in range(ARITY)])

    every = [F.struct(side(k, lambda s, own: s < own).alias("left"), side(k, lambda s, own: s > own).alias("right")) for k in range(LEVELS)]
    return F.slice(F.array(*every), F.lit(1), F.col("high"))


_STEPS = "array<struct<left:string,right:string>>"


def proofs(layers: list[DataFrame]) -> DataFrame:
    """The lowest layer's builders with ``paths``: each entry's (entry, steps), the siblings on its way to the root of its tree.

    Upper layers have one row for each 729 below, so what is joined downwards is slim; an entry's steps never leave its builder's row.
    """
    above = None
    for depth in range(len(layers) - 1, -1, -1):
        layer = layers[depth]
        if above is None:
            layer = layer.withColumn("rest", F.array().cast(_STEPS))
        else:
            layer = layer.join(above, ["tree", "block"], "left").withColumn("rest", F.coalesce("rest", F.array().cast(_STEPS)))
        layer = layer.withColumn("paths", F.transform("entries", lambda e, i: F.struct(e.alias("entry"), _steps(i).alias("steps"))))
        if depth:
            each = layer.select("tree", "rest", F.explode("paths").alias("x"))
            above = each.select("tree", F.col("x.entry.index").alias("block"), F.concat("x.steps", "rest").alias("rest"))
    return layer.select("tree", "n", "block", "rest", "paths")


def _leaves(docs: DataFrame) -> DataFrame:
    """(tree, doc_id, hash, tampered) of every row; source null is the tree '', others are named after an ``s``."""
    fields = [F.col("doc_id"), F.col("source"), F.col("lang"), F.col("n_chars")]
    odd = F.crc32(F.col("doc_id").cast("string")) % 2 == 0
    changed = F.when(odd, leaf(*fields, F.replace("text", F.lit("\n"), F.lit(""))))
    tree = F.coalesce(F.concat(F.lit("s"), "source"), F.lit(""))
    whole = docs.select(tree.alias("tree"), F.col("doc_id").cast("bigint").alias("doc_id"), leaf(*fields, F.col("text")).alias("hash"), changed.alias("tampered"))
    return whole.withColumn("tampered", F.coalesce("tampered", "hash"))


def _numbered(rows: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    """rows with index, from 0 by order in their group, and n, the group's rows."""
    one = running(rows.withColumn("one", F.lit(1).cast("bigint")), by, order, ["one"])
    return one.select(*rows.columns, F.col("one_before").alias("index"), F.col("one_all").alias("n"))


def manifest(docs: DataFrame) -> tuple[list[DataFrame], list[DataFrame]]:
    """Layers of the sources' trees, and of the tree over them.

    A source's rows ascend by doc_id, null first, then by their hash; rows equal in both are the same leaf twice.
    """
    rows = _numbered(_leaves(docs), ["tree"], ["doc_id", "hash"])
    sources = grow(rows.select("tree", "index", "n", "hash", "doc_id", "tampered"))
    tops = _numbered(roots(sources).withColumnRenamed("root", "hash").withColumn("source", F.col("tree")), [], ["source"])
    return sources, grow(tops.select(F.lit(_ALL).alias("tree"), "index", "n", "hash", "source"))


def node_log(layers: list[DataFrame], most: int) -> DataFrame:
    """(tree, at, level, number, hash): every node of every tree and where it stands in the tree's whole postorder log.

    Takes trees of up to ``most`` entries. Builders that are stopped or lost write the same rows at the same places again.
    """
    levels = LEVELS
    while ARITY ** (levels - LEVELS) < most:
        levels += 1
    out = None
    for depth, layer in enumerate(layers):
        for k in range(1 if depth else 0, LEVELS + 1):  # an upper layer's entries are roots that the one below has written
            there = F.sequence(F.lit(0), F.ceil(F.col("m") / ARITY**k).cast("int") - 1)
            nodes = layer.where(F.col("high") >= k).select("tree", "block", "m", "log", F.explode(there).alias("j"))
            number = F.col("block") * ARITY ** (LEVELS - k) + F.col("j")
            node = F.get("log", position(k, F.col("j"), F.col("m")).cast("int"))
            nodes = nodes.select("tree", F.lit(depth * LEVELS + k).alias("level"), number.alias("number"), node.alias("hash"))
            out = nodes if out is None else out.unionByName(nodes)
    sizes = layers[0].groupBy("tree").agg(F.max("n").alias("n"))
    joined = join_hot(materialise(out), sizes, "tree")
    at = reduce(lambda c, k: c.when(F.col("level") == k, position(k, F.col("number"), F.col("n"), levels)), range(levels + 1), F)
    return joined.select("tree", at.alias("at"), "level", "number", "hash")


def verify_rows(docs: DataFrame) -> DataFrame:
    """(doc_id, leaf, subroot, root, proof_sha256, folded_root, verified) of every row.

    proof_sha256: hash of the row's siblings on the way to its source's root and on to the dataset's. folded_root: what they
    give with the leaf of the tampered row, where 2 divides the id's checksum, else with its own leaf.

    Null fields are a mark of their own, a null source a tree of its own, the first. A null id is never tampered with. Rows that
    repeat an id are ordered by their leaves; fully repeated rows are leaves of their own, with the same fields. Long texts are
    hashed whole where they are. Columns beside the five are ignored; an empty table gives an empty table.
    """
    sources, tops = manifest(docs)
    top = proofs(tops).select(F.explode("paths").alias("x"), "rest")
    top = top.select(F.col("x.entry.source").alias("tree"), F.col("x.entry.hash").alias("subroot"), F.concat("x.steps", "rest").alias("top"))
    root = roots(tops).select("root")
    blocks = join_hot(proofs(sources), materialise(top.join(F.broadcast(root))), "tree")  # one root
    whole = F.transform("paths", lambda p: F.struct(p["entry"].alias("entry"), F.concat(p["steps"], F.col("rest"), F.col("top")).alias("steps")))
    blocks = blocks.select("subroot", "root", whole.alias("paths"))

    def ends(p: Column) -> Column:
        proof = _hash(F.array_join(F.transform(p["steps"], lambda s: F.concat(s["left"], s["right"])), ""))
        folded = F.aggregate(p["steps"], p["entry"]["tampered"], lambda h, s: _hash(F.concat(s["left"], h, s["right"])))
        return F.struct(p["entry"]["doc_id"].alias("doc_id"), p["entry"]["hash"].alias("leaf"), proof.alias("proof_sha256"), folded.alias("folded_root"))

    rows = blocks.select("subroot", "root", F.explode(F.transform("paths", ends)).alias("x"))
    return rows.select("x.doc_id", "x.leaf", "subroot", "root", "x.proof_sha256", "x.folded_root", (F.col("x.folded_root") == F.col("root")).alias("verified"))


def oracle() -> str:
    """The same in DuckDB, level by level; the checksum by its table of 256 steps."""
    return r"""
with recursive crc_table as (
  select list_transform(range(256), lambda i: list_reduce([i::bigint, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, x: case when c % 2 = 1 then xor(3988292384, c >> 1) else c >> 1 end)) t
), fields as (
  select doc_id, coalesce('s' || source, '') tree, concat(coalesce(strlen(doc_id::varchar) || ':' || doc_id, '-'), coalesce(strlen(source) || ':' || source, '-'),
    coalesce(strlen(lang) || ':' || lang, '-'), coalesce(strlen(n_chars::varchar) || ':' || n_chars, '-')) head, text,
    xor(list_reduce([4294967295::bigint] || list_transform(string_split(doc_id::varchar, ''), lambda c: ascii(c)::bigint), lambda c, b: xor(c >> 8, t[xor(c & 255, b) + 1])), 4294967295) % 2 = 0 as odd
  from documents, crc_table
), leaves as (
  select doc_id, tree, sha256(head || coalesce(strlen(text) || ':' || text, '-')) leaf,
    case when odd then sha256(head || coalesce(strlen(replace(text, chr(10), '')) || ':' || replace(text, chr(10), ''), '-')) end changed from fields
), placed as (
  select *, row_number() over (partition by tree order by doc_id nulls first, leaf) - 1 i, count(*) over (partition by tree) n from leaves
), nodes as (
  select tree, 0 as level, i, leaf h, n from placed
  union all
  select tree, level + 1, i // 3, sha256(string_agg(h, '' order by i)), (any_value(n) + 2) // 3 from nodes where n > 1 group by tree, level, i // 3
), subroots as (
  select tree, h subroot, level height from nodes where n = 1
), tops as (
  select tree, row_number() over (order by tree) - 1 i, count(*) over () n, subroot, height from subroots
), top_nodes as (
  select 0 as level, i, subroot h, n from tops
  union all
  select level + 1, i // 3, sha256(string_agg(h, '' order by i)), (any_value(n) + 2) // 3 from top_nodes where n > 1 group by level, i // 3
), sides as (
  select a.tree, a.level, a.i, coalesce(string_agg(b.h, '' order by b.i) filter (b.i < a.i), '') l, coalesce(string_agg(b.h, '' order by b.i) filter (b.i > a.i), '') r
  from nodes a join nodes b on b.tree = a.tree and b.level = a.level and b.i // 3 = a.i // 3 where a.n > 1 group by a.tree, a.level, a.i
), top_sides as (
  select a.level, a.i, coalesce(string_agg(b.h, '' order by b.i) filter (b.i < a.i), '') l, coalesce(string_agg(b.h, '' order by b.i) filter (b.i > a.i), '') r
  from top_nodes a join top_nodes b on b.level = a.level and b.i // 3 = a.i // 3 where a.n > 1 group by a.level, a.i
), folds as (
  select p.tree, p.i leaf_i, p.i place, t.i top_place, 0 as level, height, coalesce(changed, leaf) h, '' proof from placed p join tops t on t.tree = p.tree
  union all
  select f.tree, leaf_i, case when f.level < height then place // 3 else place end, case when f.level < height then top_place else top_place // 3 end, f.level + 1, height,
    sha256(coalesce(s.l, u.l) || f.h || coalesce(s.r, u.r)), proof || coalesce(s.l, u.l) || coalesce(s.r, u.r)
  from folds f left join sides s on f.level < height and s.tree = f.tree and s.level = f.level and s.i = f.place left join top_sides u on f.level >= height and u.level = f.level - height and u.i = f.top_place
  where s.l is not null or u.l is not null
), ends as (
  select tree, leaf_i, arg_max(h, level) folded, arg_max(proof, level) proof from folds group by tree, leaf_i
)
select doc_id, leaf, subroot, (select h from top_nodes where n = 1) root, sha256(proof) proof_sha256, folded folded_root, folded = (select h from top_nodes where n = 1) verified
from placed p join ends e on e.tree = p.tree and e.leaf_i = p.i join subroots r on r.tree = p.tree"""
