"""Language-model scoring with a log-frequency Bloom filter.

Word and word-pair counts over all training documents are quantised to powers of a base, and an n-gram of level q goes
into the filter q times, once with each number from 1 to q. A worker finds a count by probing with 1, 2, ... until a
probe fails, so counts are never too low, and too high only by a false positive. A pair's probability is smoothed by the word's:
(pair's count + PRIOR * word's probability) / (first word's count + PRIOR), which sums to 1 over the words and needs
no figure of the corpus but these counts.

The filter holds all words and pairs and grows with them, in segments of bounded size. Up to BROADCAST_BITS it is sent to all
workers; beyond, its segments stay in the shared folder and the n-grams of the texts, once a chunk of texts, are shuffled to
them, packed, and their levels back as bytes, so the scores are the same. The exact word counts of the base score come from a table of the
most frequent words, of bounded size, and from a join for all other words.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusops.llm.common import NO_ID, forget, materialise, texts, with_ids

FOLDS, HELD_OUT = 5, 1
BASE = 1.5  # of the quantisation
HASHES = 7
BITS_PER_ENTRY = 10.1  # at which a filter of 7 hashes errs in fewer than 1 of 100 probes
BROADCAST_BITS = 3 << 28  # of a filter that is sent to all workers: 96 MiB
SEGMENT_BITS = 6  # 64 segments of the filter, built apart; more where they would pass MAX_SEGMENT
MAX_SEGMENT = 1 << 24  # bits: 2 MiB
CHUNK_CHARS = 4_000_000  # of the texts whose n-grams are shuffled together
KNOWN_WORDS = 4_000_000  # words in the table of exact counts, 12 bytes each
COMMON = 65_536  # n-grams used most whose levels all workers know where the filter is too large to be sent
PRIOR = 50.0  # tokens that the words' own probabilities count for, in each context
CACHE_BITS = 20  # of the numbers of places where a worker keeps levels that it has looked up
CHUNK = 250_000  # tokens scored at a time
COUNTED = 2_000_000  # tokens counted at a time
END = 0x9E3779B97F4A7C15  # hash of the end token

_A, _B, _C = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0x9E3779B97F4A7C15)
#: Least count of each level, and the mean count of a level.
_LEAST = np.unique(np.ceil(BASE ** np.arange(0, 110) - 1e-9).astype(np.float64))
_MEAN = np.concatenate([[0.0], (_LEAST[:-1] + _LEAST[1:] - 1) / 2])


def level(counts: np.ndarray) -> np.ndarray:
    """Level of each count of at least 1, from 1."""
    return np.searchsorted(_LEAST, counts, side="right")


def _mix(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * _A
        x = (x ^ (x >> np.uint64(27))) * _B
        return x ^ (x >> np.uint64(31))


def word_key(h: np.ndarray) -> np.ndarray:
    """56-bit key of words: even. Pairs have odd keys."""
    return (h >> np.uint64(9)) << np.uint64(1)


def pair_key(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return ((_mix(first * _C + second) >> np.uint64(9)) << np.uint64(1)) | np.uint64(1)


class _Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) > 200_000:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


def chunks(ids: pd.Series, docs: pd.Series, hashes: _Hashes) -> Iterator[tuple[list, np.ndarray, np.ndarray]]:
    """(ids, hashes of the tokens with an END after each document, first token of each document) by some CHUNK tokens."""
    held, parts, sizes, n = [], [], [], 0
    for doc_id, text in zip(ids, docs, strict=True):
        words = text.encode("utf-8", "surrogatepass").lower().split()
        h = np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))
        parts += [h, np.array([END], np.uint64)]
        held.append(doc_id)
        sizes.append(len(words) + 1)
        n += sizes[-1]
        if n >= CHUNK:
            yield held, np.concatenate(parts), np.cumsum([0, *sizes[:-1]])
            held, parts, sizes, n = [], [], [], 0
    if held:
        yield held, np.concatenate(parts), np.cumsum([0, *sizes[:-1]])


def _before(tokens: np.ndarray) -> np.ndarray:
    """The token before each; END before a document's first."""
    return np.concatenate([[np.uint64(END)], tokens[:-1]])


def _contexts(bloom, levels: np.ndarray) -> np.ndarray:
    """Level of the word before each token, from the tokens' own levels."""
    return np.concatenate([bloom.levels(word_key(np.array([END], np.uint64))), levels[:-1]])


def held_out():
    """crc32 of the id as text, modulo FOLDS, is HELD_OUT; a null id counts as an empty text."""
    return F.crc32(F.coalesce(F.nullif("doc_id", F.lit(NO_ID)).cast("string"), F.lit("")).cast("binary")) % FOLDS == HELD_OUT


def count_ngrams(train: DataFrame) -> DataFrame:
    """(key, n) of all words and pairs. One 8-byte number a partial count is shuffled: key and count up to 255."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hashes, held = _Hashes(), []

        def rows() -> pd.DataFrame:
            tokens, before = (np.concatenate(x) for x in zip(*held, strict=True))
            held.clear()
            out = []
            for keys in (word_key(tokens), pair_key(before, tokens)):
                k, n = np.unique(keys, return_counts=True)
                k, whole = k << np.uint64(8), n // 255
                out += [k[n % 255 > 0] | (n % 255)[n % 255 > 0].astype(np.uint64), np.repeat(k | np.uint64(255), whole)]
            return pd.DataFrame({"packed": np.concatenate(out).view(np.int64)})

        for batch in batches:
            for _, tokens, _ in chunks(batch["doc_id"], batch["text"], hashes):
                held.append((tokens, _before(tokens)))
                if sum(len(x[0]) for x in held) >= COUNTED:
                    yield rows()
        if held:
            yield rows()

    packed = train.mapInPandas(run, "packed bigint").repartition(F.expr("shiftrightunsigned(packed, 8)"))
    counts = packed.groupBy(F.expr("shiftrightunsigned(packed, 8)").alias("key")).agg(F.sum(F.expr("packed & 255")).alias("n"))
    return materialise(counts)


def _positions(keys: np.ndarray, number: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    """First position and stride of an n-gram's hashes for one number, inside its segment of ``size`` bits."""
    with np.errstate(over="ignore"):
        z = _mix(keys + np.uint64(number) * _C)
    return z, (z >> np.uint64(32)) | np.uint64(1)


def _place(a: np.ndarray, size: int) -> np.ndarray:
    """The lower half of each hash, scaled to a place below size."""
    return (a & np.uint64(0xFFFFFFFF)) * np.uint64(size) >> np.uint64(32)


def _segment(keys: np.ndarray, bits: int) -> np.ndarray:
    return _mix(keys) >> np.uint64(64 - bits)


@dataclass
class LogFrequencyFilter:
    """Bits of all segments, one after another, or of one segment where segment_bits is 0."""

    bits: np.ndarray
    size: int  # bits of a segment
    segment_bits: int

    def levels(self, keys: np.ndarray) -> np.ndarray:
        """Level of each n-gram: the last number before a probe fails; 0 for one that isn't there."""
        out = np.zeros(len(keys), np.int64)
        segment = _segment(keys, self.segment_bits) if self.segment_bits else np.zeros(len(keys), np.uint64)
        alive, base, number = np.arange(len(keys)), segment * np.uint64(self.size), 1
        while len(alive):
            a, step = _positions(keys[alive], number, self.size)
            for _ in range(HASHES):
                at = base[alive] + _place(a, self.size)
                hit = (self.bits[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 == 1
                alive, a, step = alive[hit], a[hit], step[hit]
                with np.errstate(over="ignore"):
                    a = a + step
            out[alive] = number
            number += 1
        return out


class KeptLevels:
    """A filter with the levels that were looked up last, each in the place its key gives: frequent n-grams are probed once."""

    def __init__(self, bloom):
        self.bloom = bloom
        self.keys = np.full(1 << CACHE_BITS, np.iinfo(np.uint64).max, np.uint64)  # no n-gram has this key
        self.found = np.zeros(1 << CACHE_BITS, np.uint8)

    def levels(self, keys: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            at = (keys * _C) >> np.uint64(64 - CACHE_BITS)
        out = self.found[at]
        missed = np.flatnonzero(self.keys[at] != keys)
        u, inverse = np.unique(keys[missed], return_inverse=True)
        levels = self.bloom.levels(u).astype(np.uint8)
        out[missed] = levels[inverse]
        with np.errstate(over="ignore"):
            at = (u * _C) >> np.uint64(64 - CACHE_BITS)
        self.keys[at], self.found[at] = u, levels
        return out


@dataclass
class Segments:
    """The filter's table (segment, bits), bits of a segment and bits that number the segments."""

    table: DataFrame
    size: int
    segment_bits: int


def build_segments(counts: DataFrame) -> Segments:
    """The filter of all counted n-grams."""
    sizes = counts.groupBy(F.least("n", F.lit(1 << 16)).alias("n")).agg(F.count("*").alias("keys")).collect()
    wanted = sum(int(r["keys"]) * int(level(np.array([r["n"]]))[0]) for r in sizes) * BITS_PER_ENTRY
    segment_bits = SEGMENT_BITS
    while MAX_SEGMENT << segment_bits < wanted:
        segment_bits += 1
    size = max(1 << 12, -(-int(wanted) >> segment_bits + 12 << 12))

    def build(group: pd.DataFrame) -> pd.DataFrame:
        bits = np.zeros(size, bool)
        keys, levels = group["key"].to_numpy().view(np.uint64), level(group["n"].to_numpy())
        for number in range(1, levels.max() + 1):
            a, step = _positions(keys[levels >= number], number, size)
            for _ in range(HASHES):
                bits[_place(a, size)] = True
                with np.errstate(over="ignore"):
                    a = a + step
        return pd.DataFrame({"segment": [int(group["segment"].iloc[0])], "bits": [np.packbits(bits, bitorder="little").tobytes()]})

    split = counts.mapInPandas(
        lambda batches: (b.assign(segment=_segment(b["key"].to_numpy().view(np.uint64), segment_bits).astype("int32")) for b in batches), "key bigint, n bigint, segment int"
    )
    return Segments(materialise(split.groupBy("segment").applyInPandas(build, "segment int, bits binary")), size, segment_bits)


def build_filter(counts: DataFrame) -> tuple[LogFrequencyFilter | None, Segments, int]:
    """The filter, None where it is too large to be sent to all workers; its segments; its bits."""
    parts = build_segments(counts)
    n, size = parts.size << parts.segment_bits, parts.size
    if n > BROADCAST_BITS:
        return None, parts, n
    bits = bytearray(n // 8)
    for r in parts.table.toLocalIterator():
        bits[r["segment"] * size // 8 : (r["segment"] + 1) * size // 8] = r["bits"]
    return LogFrequencyFilter(np.frombuffer(bytes(bits), np.uint8), size, parts.segment_bits), parts, n


def _most_used(counts: DataFrame, most: int) -> tuple[pa.Table, int]:
    """(key, n) of the n-grams with at least the returned count: all that fit into ``most``."""
    total, least = 0, 1 << 62
    for r in sorted(counts.groupBy(F.least("n", F.lit(1 << 16)).alias("n")).agg(F.count("*").alias("keys")).collect(), key=lambda r: -r["n"]):
        total += r["keys"]
        if total > most:
            break
        least = r["n"]
    return counts.where(F.col("n") >= least).toArrow(), least


def known_counts(counts: DataFrame) -> tuple[np.ndarray, np.ndarray, int]:
    """Sorted keys and exact counts of the words with at least the returned count: all that fit into KNOWN_WORDS."""
    got, least = _most_used(counts.where("key % 2 = 0"), KNOWN_WORDS)
    keys, n = got["key"].to_numpy().view(np.uint64), got["n"].to_numpy().astype(np.uint64)
    order = np.argsort(keys)
    return keys[order], n[order].astype(np.uint32), least


def _find(keys: np.ndarray, values: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(found, value) of each wanted key among sorted keys."""
    if not len(keys):
        return np.zeros(len(wanted), bool), np.zeros(len(wanted))
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    there = keys[at] == wanted
    return there, np.where(there, values[at], 0).astype(np.float64)


@dataclass
class FoundLevels:
    """Levels of some n-grams by sorted keys, in place of the filter."""

    keys: np.ndarray
    found: np.ndarray

    def levels(self, keys: np.ndarray) -> np.ndarray:
        return _find(self.keys, self.found, keys)[1].astype(np.int64)


def text_chunks(source: DataFrame) -> DataFrame:
    """(chunk, ids, texts, held) of the rows, by some CHUNK_CHARS characters."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        chunk, rows, n = TaskContext.get().partitionId() << 32, [], 0
        for batch in batches:
            for row in zip(batch["doc_id"], batch["text"], batch["held"], strict=True):
                rows.append(row)
                n += len(row[1]) + 1
                if n >= CHUNK_CHARS:
                    yield pd.DataFrame([(chunk, *map(list, zip(*rows, strict=True)))], columns=["chunk", "ids", "texts", "held"])
                    chunk, rows, n = chunk + 1, [], 0
        if rows:
            yield pd.DataFrame([(chunk, *map(list, zip(*rows, strict=True)))], columns=["chunk", "ids", "texts", "held"])

    each = source.select("doc_id", "text", held_out().alias("held"))
    return materialise(each.mapInPandas(run, "chunk bigint, ids array<bigint>, texts array<string>, held array<boolean>"))


def _packed(keys: np.ndarray) -> bytes:
    """Ascending keys by their differences, the lowest byte of all first: the highest are 0 and take no room once they are compressed."""
    return np.diff(keys, prepend=np.uint64(0)).view(np.uint8).reshape(-1, 8).T.tobytes()


def _unpacked(packed: bytes) -> np.ndarray:
    return np.cumsum(np.ascontiguousarray(np.frombuffer(packed, np.uint8).reshape(8, -1).T).view(np.uint64).ravel(), dtype=np.uint64)


def _by_segment(keys: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """The order of ascending keys by segment, then key; the segments in this order."""
    segment = _segment(keys, bits)
    order = np.argsort(segment.astype(np.uint16 if bits <= 16 else np.uint32), kind="stable")
    return order, segment[order]


_ASKED = "chunk bigint, segment int, keys binary"


def _questions(chunk: int, keys: np.ndarray, bits: int) -> pd.DataFrame:
    """A row for each segment that ascending keys ask."""
    order, segment = _by_segment(keys, bits)
    first = np.flatnonzero(np.diff(segment, prepend=np.uint64(1 << 63)))
    asked = [_packed(k) for k in np.split(keys[order], first[1:])] if len(first) else []
    return pd.DataFrame({"chunk": np.full(len(first), chunk, np.int64), "segment": segment[first].astype("int32"), "keys": asked})


def _looked_up(asked: DataFrame, parts: Segments) -> DataFrame:
    """(chunk, segment, levels) of asked (chunk, segment, keys): a byte for each of the keys."""
    size = parts.size

    def look(asked: pd.DataFrame, bits: pd.DataFrame) -> pd.DataFrame:
        keys = [_unpacked(k) for k in asked["keys"]]
        levels = np.zeros(sum(map(len, keys)), np.uint8)
        if len(levels) and len(bits):
            u, inverse = np.unique(np.concatenate(keys), return_inverse=True)
            levels = LogFrequencyFilter(np.frombuffer(bits["bits"].iloc[0], np.uint8), size, 0).levels(u).astype(np.uint8)[inverse]
        ends = np.cumsum([len(k) for k in keys])
        return pd.DataFrame({"chunk": asked["chunk"], "segment": asked["segment"], "levels": [x.tobytes() for x in np.split(levels, ends)[: len(keys)]]})

    return asked.groupBy("segment").cogroup(parts.table.groupBy("segment")).applyInPandas(look, "chunk bigint, segment int, levels binary")


def _answered(keys: np.ndarray, found: pd.DataFrame, bits: int) -> FoundLevels:
    """Ascending keys with the levels of one chunk's answers, which are in the order of the questions."""
    levels = np.zeros(len(keys), np.int64)
    levels[_by_segment(keys, bits)[0]] = np.frombuffer(b"".join(found.sort_values("segment")["levels"]), np.uint8)
    return FoundLevels(keys, levels)


def common_levels(counts: DataFrame, parts: Segments) -> FoundLevels:
    """Levels of the n-grams used most, words and pairs, at most COMMON of them: those that nearly every chunk would ask for."""
    keys = np.sort(_most_used(counts, COMMON)[0]["key"].to_numpy().view(np.uint64))
    asked = counts.sparkSession.createDataFrame(_questions(0, keys, parts.segment_bits), _ASKED)
    return _answered(keys, _looked_up(asked, parts).toPandas(), parts.segment_bits)


def _uncommon(tokens: list[np.ndarray], common: np.ndarray) -> np.ndarray:
    """The distinct n-grams of a chunk but the common ones, ascending."""
    words = np.unique(word_key(np.concatenate([*tokens, np.array([END], np.uint64)])))
    keys = np.sort(np.concatenate([words, np.unique(np.concatenate([words[:0], *(pair_key(_before(t), t) for t in tokens)]))]), kind="stable")
    return keys[~_find(common, common, keys)[0]]


def _answers(chunked: DataFrame, parts: Segments, common: FoundLevels) -> DataFrame:
    """(chunk, segment, levels) of the distinct n-grams of each chunk but the common ones, looked up where their segments are.

    An n-gram that isn't common stands in few chunks beside all there are, so no segment's frame grows with the chunks. Questions go out
    as packed keys, and answers come back as bytes in their order: the chunk knows its n-grams.
    """
    segment_bits, known = parts.segment_bits, chunked.sparkSession.sparkContext.broadcast(common.keys)

    def ask(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hashes = _Hashes()
        for batch in batches:
            for chunk, ids, docs in zip(batch["chunk"], batch["ids"], batch["texts"], strict=True):
                yield _questions(chunk, _uncommon([t for _, t, _ in chunks(ids, docs, hashes)], known.value), segment_bits)

    return materialise(_looked_up(chunked.select("chunk", "ids", "texts").mapInPandas(ask, _ASKED), parts))


def _with_levels(chunked: DataFrame, found: DataFrame, parts: Segments, common: FoundLevels, body, schema: str) -> DataFrame:
    """Rows of body(chunk, levels of its uncommon n-grams, levels of the common ones, its texts as of ``chunks``) of each chunk."""
    segment_bits, shared = parts.segment_bits, chunked.sparkSession.sparkContext.broadcast(common)

    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        row = left.iloc[0]
        read = list(chunks(row["ids"], row["texts"], _Hashes()))
        own = _answered(_uncommon([t for _, t, _ in read], shared.value.keys), right, segment_bits)
        return pd.concat(body(row["chunk"], own, shared.value, read), ignore_index=True)

    return chunked.groupBy("chunk").cogroup(found.groupBy("chunk")).applyInPandas(run, schema)


def find_levels(chunked: DataFrame, parts: Segments, common: FoundLevels) -> DataFrame:
    """(chunk, key, level) of the distinct n-grams of each chunk but the common ones."""
    each = lambda chunk, own, common, read: [pd.DataFrame({"chunk": np.full(len(own.keys), chunk), "key": own.keys.view(np.int64), "level": own.found})]
    return _with_levels(chunked, _answers(chunked, parts, common), parts, common, each, "chunk bigint, key bigint, level int")


_SCORED = "doc_id bigint, n_tokens bigint, n_known bigint, base double, score double, rest array<bigint>"


def _score_rows(model: dict, bloom, read) -> Iterator[pd.DataFrame]:
    """read: as of ``chunks``."""
    room = model["room"]
    for ids, tokens, starts in read:
        u, inverse = np.unique(tokens, return_inverse=True)
        wk = word_key(u)
        there, exact = _find(model["keys"], model["counts"], wk)
        levels = bloom.levels(wk)
        p_word = ((_MEAN[levels] + 0.5) / room)[inverse]
        context = _contexts(bloom, levels[inverse])
        pc = _MEAN[bloom.levels(pair_key(_before(tokens), tokens))]
        seen = _MEAN[context]
        p = (np.minimum(pc, seen) + PRIOR * p_word) / (seen + PRIOR)
        base = np.where(there, np.log10((exact + 0.5) / room), 0.0)[inverse]
        known = there[inverse]
        rest = wk[inverse].view(np.int64)
        ends = np.append(starts[1:], len(tokens))
        yield pd.DataFrame({
            "doc_id": ids, "n_tokens": ends - starts,
            "n_known": np.add.reduceat(known.astype(np.int64), starts), "base": np.add.reduceat(base, starts),
            "score": np.add.reduceat(np.log10(p), starts),
            "rest": [rest[a:b][~known[a:b]] for a, b in zip(starts, ends, strict=True)],
        })


def score_texts(docs: DataFrame) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of every document's whole text.

    Counts come from the documents that aren't held out. base_score: words with a half added to each count; score: the
    log10 probability that the pair model gives the text, both with the end token. Null and empty texts are one end
    token; where nothing can be learned, every count is 0. Repeated rows each give a row and each count; other columns of docs
    are ignored; an empty table gives an empty table.
    """
    spark = docs.sparkSession
    source = texts(docs)
    train = source.where(~held_out())
    counts = count_ngrams(train)
    totals = counts.where("key % 2 = 0").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count("*").alias("v")).first()
    total, distinct = totals["n"], totals["v"]
    keys, values, least = known_counts(counts)
    room = total + 0.5 * (distinct + 1)
    model = {"keys": keys, "counts": values, "room": room}
    bloom, parts, _ = build_filter(counts)
    common = common_levels(counts, parts) if bloom is None else None
    rare = materialise(counts.where(F.col("key") % 2 == 0).where(F.col("n") < least))
    forget(counts)
    if bloom is None:
        chunked = text_chunks(source)
        found = _answers(chunked, parts, common)
        shared = spark.sparkContext.broadcast(model)

        def scores_of(chunk, own, common, read) -> list:
            order = np.argsort(keys := np.concatenate([common.keys, own.keys]), kind="stable")
            levels = FoundLevels(keys[order], np.concatenate([common.found, own.found])[order])
            return list(_score_rows(shared.value, levels, read))

        scored = _with_levels(chunked, found, parts, common, scores_of, _SCORED)
    else:
        # Sent as bytes, which workers read in place.
        shared, size, segment_bits = spark.sparkContext.broadcast(model | {"bits": bloom.bits.tobytes()}), bloom.size, bloom.segment_bits
        del bloom

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            hashes, kept = _Hashes(), KeptLevels(LogFrequencyFilter(np.frombuffer(shared.value["bits"], np.uint8), size, segment_bits))
            for batch in batches:
                yield from _score_rows(shared.value, kept, chunks(batch["doc_id"], batch["text"], hashes))

        scored = source.mapInPandas(run, _SCORED)
    scored = materialise(scored.withColumn("row", F.monotonically_increasing_id()))
    others = scored.select("row", F.explode("rest").alias("key"))
    found = others.join(rare, "key", "left").groupBy("row").agg(
        F.sum(F.log10((F.coalesce("n", F.lit(0)) + 0.5) / F.lit(float(room)))).alias("more"), F.count("n").alias("also")
    )
    return with_ids(scored.drop("rest").join(found, "row", "left").select(
        "doc_id", held_out().alias("held_out"), "n_tokens", (F.col("n_known") + F.coalesce("also", F.lit(0))).alias("n_known"),
        F.lit(total).cast("bigint").alias("train_tokens"), (F.col("base") + F.coalesce("more", F.lit(0.0))).alias("base_score"), "score",
    ))
