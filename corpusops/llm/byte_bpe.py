"""Byte-level BPE encoding and decoding with Spark's higher-order functions.

Texts are split into words and the distinct words counted. A higher-order function over a word's bytes
merges the adjacent pair of lowest rank until no pair has a rank, which is the byte-pair rule itself. Ranks are a literal map
inside the expression, dealt into small buckets because a map lookup is a scan. The most used words, a table of
bounded size, are folded once each and their ids sent to all workers, which put texts together from them; all other words, nearly all
of which the whole table has once or twice, are folded once in each text that has them, so no text is shuffled.
Decoding looks up the bytes of each id and joins them.
"""

from __future__ import annotations

import base64
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StructField, StructType

from corpusops.llm.common import forget, materialise, texts, with_ids

#: Fixed value: the split pattern of the public tokenizer.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

PAIR_BUCKETS = 65_536
MAX_KNOWN_WORDS = 1_100_000  # words that all workers know: some 240 MB in a worker
KNOWN_BYTES = 64  # of such a word
FLUSH_WORDS = 60_000  # counted words that a task holds
ROWS = 128  # texts handled at a time
LONG_WORD = 256  # characters; a fold's cost grows with the square of a word's length, so longer words take a heap
NO_RANK = 2_147_483_647
STATE = "struct<ids: array<int>, ranks: array<int>>"


@lru_cache(2)
def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def _in_buckets(rows: DataFrame, buckets: int) -> DataFrame:
    """One row with an array of maps, by bucket from 0; rows: bucket, key, value."""
    filled = spark_range(rows.sparkSession, buckets).join(rows, "bucket", "left")
    each = filled.groupBy("bucket").agg(F.collect_list(F.when(F.col("key").isNotNull(), F.struct("key", "value"))).alias("entries"))
    ordered = each.agg(F.sort_array(F.collect_list(F.struct("bucket", "entries"))).alias("all"))
    return ordered.select(F.transform("all", lambda x: F.map_from_entries(x["entries"])).alias("maps"))


def spark_range(spark: SparkSession, n: int) -> DataFrame:
    return spark.range(0, n, 1, 4).select(F.col("id").cast("int").alias("bucket"))


def vocabulary(spark: SparkSession, path: str) -> DataFrame:
    """One row: ids of the 256 single bytes, and buckets of pair -> merged id."""
    ranks = read_ranks(path)
    pairs = [(ranks[t[:k]], ranks[t[k:]], n) for t, n in ranks.items() for k in range(1, len(t)) if t[:k] in ranks and t[k:] in ranks]
    frame = pd.DataFrame(pairs, columns=["a", "b", "value"]).astype({"a": "int64", "b": "int64", "value": "int32"})
    frame["bucket"] = ((frame.a * 31_337 + frame.b) % PAIR_BUCKETS).astype("int32")
    frame["key"] = frame.a * 65_536 + frame.b
    maps = _in_buckets(spark.createDataFrame(pa.Table.from_pandas(frame[["bucket", "key", "value"]], preserve_index=False)), PAIR_BUCKETS)
    single = ",".join(str(ranks[bytes([x])]) for x in range(256))
    return materialise(maps.select(F.split(F.lit(single), ",").cast("array<int>").alias("bytes"), F.col("maps").alias("pairs")))


def _rank(v: Column, a: Column, b: Column) -> Column:
    """Id of two adjacent pieces' merger, or NO_RANK."""
    bucket = F.get(v["pairs"], F.pmod(a.cast("bigint") * 31_337 + b, F.lit(PAIR_BUCKETS)).cast("int"))
    return F.coalesce(F.try_element_at(bucket, a.cast("bigint") * 65_536 + b), F.lit(NO_RANK))


def fold_word(v: Column, word: Column) -> Column:
    """Ids of one word: its bytes, then as many merges of the lowest-ranked pair as there are pieces to merge."""
    n = F.octet_length(word)

    def start(ids: Column) -> Column:
        ranks = F.when(n > 1, F.transform(F.sequence(F.lit(0), F.greatest(n - 2, F.lit(0))), lambda i: _rank(v, F.get(ids, i), F.get(ids, i + 1))))
        return F.struct(ids.alias("ids"), F.coalesce(ranks, F.array().cast("array<int>")).alias("ranks")).cast(STATE)

    def merge(s: Column, _: Column) -> Column:
        return F.get(F.transform(F.array(F.array_min(s["ranks"])), lambda m: F.when(m.isNull() | (m == NO_RANK), s).otherwise(at(s, m))), 0)

    def at(s: Column, m: Column) -> Column:
        return F.get(F.transform(F.array(F.array_position(s["ranks"], m).cast("int")), lambda p: joined(s, m, p)), 0)

    def joined(s: Column, m: Column, p: Column) -> Column:
        """p: place of the pair from 1. Only the ranks beside the merger change."""
        ids, ranks = s["ids"], s["ranks"]
        size = F.size(ids)
        none = F.array().cast("array<int>")
        before = F.when(p > 1, F.array(_rank(v, F.get(ids, p - 2), m))).otherwise(none)
        after = F.when(p + 1 < size, F.array(_rank(v, m, F.get(ids, p + 1)))).otherwise(none)
        return F.struct(
            F.concat(F.slice(ids, F.lit(1), p - 1), F.array(m), F.slice(ids, p + 2, size)).alias("ids"),
            F.concat(F.slice(ranks, F.lit(1), F.greatest(p - 2, F.lit(0))), before, after, F.slice(ranks, p + 2, size)).alias("ranks"),
        ).cast(STATE)

    # A byte is a character of the word read as Latin-1.
    ids = F.transform(F.split(F.decode(F.encode(word, "UTF-8"), "ISO-8859-1"), ""), lambda c: F.get(v["bytes"], F.ascii(c)))
    begun = F.get(F.transform(F.array(ids), start), 0)
    return F.aggregate(F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1))), begun, merge, lambda s: s["ids"])


def _bind(value: Column, body) -> Column:
    """body with a name for value: evaluated once a row, referred to often."""
    return F.get(F.transform(F.array(value), body), 0)


def merge_bytes(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The same rule over a heap of (rank, place): time grows as n log n."""
    import heapq

    piece, nxt, prev = [word[i : i + 1] for i in range(len(word))], [*range(1, len(word)), -1], [*range(-1, len(word) - 1)]
    heap = [(ranks[p], i, p) for i in range(len(word) - 1) if (p := piece[i] + piece[i + 1]) in ranks]
    heapq.heapify(heap)
    while heap:
        _, i, p = heapq.heappop(heap)
        j = nxt[i] if piece[i] else -1
        if j < 0 or piece[i] + piece[j] != p:
            continue
        piece[i], piece[j], nxt[i] = p, b"", nxt[j]
        if nxt[j] >= 0:
            prev[nxt[j]] = i
        for a in (prev[i], i):
            if a >= 0 and nxt[a] >= 0 and (q := piece[a] + piece[nxt[a]]) in ranks:
                heapq.heappush(heap, (ranks[q], a, q))
    return [ranks[p] for p in piece if p]


#: The letters, numbers and white space below U+0250.
LETTERS, NUMBERS, SPACE = "A-Za-zªµºÀ-ÖØ-öø-ɏ", "0-9²³¹¼-¾", " \t-\r\u0085\u00a0"


@lru_cache(1)
def _splitter():
    """The words of a text by PATTERN. Texts of Latin letters alone take the same pattern with its classes spelled out, in half the time."""
    import regex

    every, other = regex.compile(PATTERN).findall, re.compile("[^\0-\u024f]").search
    latin = re.compile(
        rf"'(?:[stmd]|re|ve|ll)| ?[{LETTERS}]+| ?[{NUMBERS}]+| ?[^{SPACE}{LETTERS}{NUMBERS}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+"
    ).findall
    return lambda text: every(text) if other(text) else latin(text)


def count_words(docs: DataFrame) -> DataFrame:
    """(word, n) of the distinct words of all texts."""
    names = ["word", "n"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split, held = _splitter(), Counter()

        def counted() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(held.keys(), pa.string()), pa.array(held.values(), pa.int64())], names)

        for batch in batches:
            for k in range(0, batch.num_rows, ROWS):
                for text in batch["text"].slice(k, ROWS).to_pylist():
                    held.update(split(text))
                if len(held) > FLUSH_WORDS:
                    yield counted()
                    held.clear()
        if held:
            yield counted()

    return docs.select("text").mapInArrow(run, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n"))


class _Known(dict):
    """Ids of words as bytes; a word that isn't there is one id of all bits and goes to others, unless it is too long for the fold."""

    def __init__(self, found: dict[str, bytes], kind: np.dtype, ranks: dict[bytes, int]):
        super().__init__(found)
        self.kind, self.mark, self.ranks = kind, b"\xff" * kind.itemsize, ranks
        self.others: dict[str, int] = {}
        self.at: list[int] = []

    def __missing__(self, word: str) -> bytes:
        if len(word) > LONG_WORD:
            return np.array(merge_bytes(word.encode(), self.ranks), self.kind).tobytes()
        self.at.append(self.others.setdefault(word, len(self.others)))
        return self.mark

    def put_together(self, words: list[str]) -> tuple[np.ndarray, list[str], list[int]]:
        """Ids, the other words once each, and which of these stands at each mark."""
        self.others, self.at = {}, []
        ids = np.frombuffer(b"".join(map(self.__getitem__, words)), self.kind)
        return ids, list(self.others), self.at


def known_words(counts: DataFrame, vocab: DataFrame, kind: np.dtype) -> dict[str, bytes]:
    """{word: its ids' bytes} of the words used most; words of equal counts go in together or not at all."""
    short = materialise(counts.where((F.octet_length("word") <= KNOWN_BYTES) & (F.col("n") > 1)))
    # How many words have each count, counts over a million taken together: a small table, whatever the input's size.
    sizes = short.groupBy(F.least("n", F.lit(1_000_000)).alias("n")).agg(F.count("*").alias("words")).collect()
    total, least = 0, 1 << 62
    for r in sorted(sizes, key=lambda r: -r["n"]):
        total += r["words"]
        if total > MAX_KNOWN_WORDS:
            break
        least = r["n"]
    known = short.where(F.col("n") >= least).select("word").repartition(48, "word").withColumn("v", vocab.select(F.struct("*")).scalar())
    got = known.select("word", _bind(F.col("v"), lambda v: fold_word(v, F.col("word"))).alias("ids")).toArrow()
    forget(short)
    return {w: np.array(x, kind).tobytes() for w, x in zip(got["word"].to_pylist(), got["ids"].to_pylist(), strict=True)}


def _in_parts(body):
    """A function over batches of rows from one over ROWS rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, ROWS):
                yield body(batch.slice(k, ROWS))

    return run


def encode(docs: DataFrame, path: str, vocab: DataFrame | None = None, also: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, ids, also...) of every whole text; see ``decode`` for the way back.

    Null and empty texts have no ids. Repeated rows each give a row; other columns of docs are ignored; an empty table
    gives an empty table. path: a file of base64 byte strings with their ranks, on every machine. also: ``id_bytes`` and ``decoded``
    add what the functions of these names would, on the same way through Python.
    """
    docs = texts(docs)
    vocab = vocabulary(docs.sparkSession, path) if vocab is None else vocab
    # Ids on the way: two bytes each where the vocabulary lets them.
    kind = np.dtype(np.int16 if max(read_ranks(path).values()) < 0xFFFF else np.int32)
    mask, sql = (0xFFFF, "smallint") if kind.itemsize == 2 else (0xFFFFFFFF, "int")
    known = known_words(count_words(docs), vocab, np.dtype(f"u{kind.name}"))
    shared = docs.sparkSession.sparkContext.broadcast(known)
    types = [pa.list_(pa.from_numpy_dtype(kind)), pa.list_(pa.string()), pa.list_(pa.int32())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split, words = _splitter(), _Known(shared.value, np.dtype(f"u{kind.name}"), read_ranks(path))

        def some(batch: pa.RecordBatch) -> pa.RecordBatch:
            found = [words.put_together(split(x)) for x in batch["text"].to_pylist()]
            columns = [[x.view(kind) for x, _, _ in found], [x for _, x, _ in found], [x for _, _, x in found]]
            return pa.RecordBatch.from_arrays([batch["doc_id"], *[pa.array(c, t) for c, t in zip(columns, types, strict=True)]], ["doc_id", "ids", "others", "at"])

        return _in_parts(some)(batches)

    made = {"id_bytes": lambda: _le_bytes, "decoded": lambda: _decoder(path)}

    def filled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        more_columns = [made[name]() for name in also]

        def fill(batch: pa.RecordBatch) -> pa.RecordBatch:
            out = []
            for x, more, at in zip(batch["ids"], batch["fills"].to_pylist(), batch["at"].to_pylist(), strict=True):
                ids = x.values.to_numpy().astype(np.int64) & mask
                pieces = np.split(ids, np.flatnonzero(ids == mask))
                out.append(np.concatenate([pieces[0], *[y for k, p in zip(at, pieces[1:], strict=True) for y in (more[k], p[1:])]]).astype(np.int32))
            more = [pa.array([f(x) for x in out], pa.binary()) for f in more_columns]
            return pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(out, pa.list_(pa.int32())), *more], ["doc_id", "ids", *also])

        return _in_parts(fill)(batches)

    parts = docs.mapInArrow(run, f"doc_id bigint, ids array<{sql}>, others array<string>, at array<int>").withColumn("v", vocab.select(F.struct("*")).scalar())
    fills = _bind(F.col("v"), lambda v: F.transform("others", lambda w: fold_word(v, w)))
    columns = ", ".join(["doc_id bigint", "ids array<int>", *(f"{name} binary" for name in also)])
    return with_ids(parts.select("doc_id", "ids", "at", fills.alias("fills")).mapInArrow(filled, columns))


def _le_bytes(ids: np.ndarray) -> bytes:
    return ids.astype("<u4").tobytes()


def _decoder(path: str):
    """The bytes of an array of ids, joined; ids outside the vocabulary have none."""
    ranks = read_ranks(path)
    pieces = [b""] * (max(ranks.values()) + 1)
    for t, n in ranks.items():
        pieces[n] = t
    return lambda ids: b"".join(map(pieces.__getitem__, ids[(ids >= 0) & (ids < len(pieces))].tolist()))


def _with_bytes(encoded: DataFrame, name: str, made) -> DataFrame:
    """encoded with a column of bytes that made()(ids) gives; null ids give null."""
    at = encoded.columns.index("ids")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        join = made()

        def add(batch: pa.RecordBatch) -> pa.RecordBatch:
            out = [None if not x.is_valid else join(x.values.to_numpy()) for x in batch.column(at)]
            return pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.binary())], [*batch.schema.names, name])

        return _in_parts(add)(batches)

    return encoded.mapInArrow(run, StructType([*encoded.schema.fields, StructField(name, BinaryType())]))


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """encoded with decoded, the bytes of its ids, joined. Ids outside the vocabulary have no bytes; null ids give null."""
    return _with_bytes(encoded, "decoded", lambda: _decoder(path))


def id_bytes(encoded: DataFrame) -> DataFrame:
    """encoded with id_bytes, its ids as little-endian unsigned 32-bit numbers; null ids give null."""
    return _with_bytes(encoded, "id_bytes", lambda: _le_bytes)
