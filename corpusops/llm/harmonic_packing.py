"""Harmonic packing of token sequences.

Lengths fall into reciprocal-capacity classes: class k holds lengths over capacity/(k+1) and up to capacity/k, and a bin
of class k takes exactly k of them. A document is cut so that its parts fill their share of a bin nearly whole: whole
bins first, then the remainder is cut down to the next reciprocal length until little of a share is left over. Each
worker fills its classes alone, in one pass over its rows, and holds only the open bins; what they hold at the end is
chained into full bins, and the last one is cut at powers of two, which need no padding.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from corpusops.llm.common import texts, with_ids

CAPACITY = 2048
END = 1  # id after each document
SMALL = 32  # a part this short isn't cut again
FRAME_IDS = 400_000  # of rows that go back to Spark at a time
SPARE = 64  # nor one that leaves at most 1/SPARE of its share


def cut(n: int, capacity: int = CAPACITY) -> list[int]:
    """Lengths of the parts of n tokens, in order: whole bins, then reciprocal shares, then a last part that nearly fills one."""
    parts, rest = [capacity] * (n // capacity), n % capacity
    while rest:
        share = capacity // (capacity // rest)
        if rest <= SMALL or (share - rest) * SPARE <= share:
            parts.append(rest)
            break
        parts.append(capacity // (capacity // rest + 1))
        rest -= parts[-1]
    return parts


def added_tokens(path: str) -> dict[str, int]:
    """Strings that a tokenizers file turns into one id wherever a text holds them."""
    with open(path, "rb") as f:
        found = json.load(f)["added_tokens"]
    if any(t["single_word"] or t["lstrip"] or t["rstrip"] or t["normalized"] for t in found):
        raise ValueError("only tokens that are found as they are can be split off")
    return {t["content"]: t["id"] for t in found}


@lru_cache(2)
def _encoder(path: str, pattern: str, added: tuple[tuple[str, int], ...]):
    import tiktoken

    from corpusops.llm.byte_bpe import read_ranks

    return tiktoken.Encoding("words", pat_str=pattern, mergeable_ranks=read_ranks(path), special_tokens=dict(added))


Part = tuple[int, int, np.ndarray, int]  # doc_id, start, ids, the document's ids


class Packer:
    """The open bins of one worker."""

    def __init__(self, capacity: int, first_sequence: int):
        self.capacity, self.next = capacity, first_sequence
        self.open: dict[int, list[Part]] = {}

    def _close(self, parts: list[Part]) -> Iterator[tuple[Part, int, int]]:
        offset = 0
        for p in parts:
            yield p, self.next, offset
            offset += len(p[2])
        self.next += 1

    def add(self, doc_id: int, ids: np.ndarray) -> Iterator[tuple[Part, int, int]]:
        """The rows (part, sequence, offset) of bins that this document fills."""
        start = 0
        for length in cut(len(ids), self.capacity):
            k = self.capacity // length
            held = self.open.setdefault(k, [])
            held.append((doc_id, start, ids[start : start + length], len(ids)))
            start += length
            if len(held) == k:
                yield from self._close(self.open.pop(k))

    def finish(self) -> Iterator[tuple[Part, int, int]]:
        """Chain what open bins hold into full bins; the end becomes sequences of lengths that are powers of two."""
        todo = [p for k in sorted(self.open) for p in self.open[k]]
        self.open = {}
        left = sum(len(p[2]) for p in todo)
        todo.reverse()
        while left:
            room = self.capacity if left >= self.capacity else 1 << (left.bit_length() - 1)
            left -= room
            parts: list[Part] = []
            while room:
                doc_id, start, ids, n = todo.pop()
                if len(ids) > room:
                    todo.append((doc_id, start + room, ids[room:], n))
                    ids = ids[:room]
                parts.append((doc_id, start, ids, n))
                room -= len(ids)
            yield from self._close(parts)


COLUMNS = "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint"


def _batch(rows: list[tuple[Part, int, int]], keep_ids: bool) -> pa.RecordBatch:
    """rows (part, sequence, offset) as columns; the ids of all parts lie in one buffer."""
    crcs = [zlib.crc32(p[2].tobytes()) for p, _, _ in rows]
    lengths = [len(p[2]) for p, _, _ in rows]
    columns = [[p[0] for p, _, _ in rows], [p[1] for p, _, _ in rows], lengths, crcs, [p[3] for p, _, _ in rows], [s for _, s, _ in rows], [o for _, _, o in rows]]
    names, arrays = [x.split()[0] for x in COLUMNS.split(", ")], [pa.array(c, pa.int64()) for c in columns]
    if keep_ids:
        ends = pa.array(np.cumsum([0, *lengths], dtype=np.int32))
        names, arrays = [*names, "ids"], [*arrays, pa.ListArray.from_arrays(ends, pa.array(np.concatenate([p[2] for p, _, _ in rows]).view(np.int32)))]
    return pa.RecordBatch.from_arrays(arrays, names)


def pack(docs: DataFrame, path: str, pattern: str, added: dict[str, int] | None = None, capacity: int = CAPACITY, keep_ids: bool = True) -> DataFrame:
    """One row per part of a document: where it starts in the document and in its sequence of at most ``capacity`` ids.

    A document's ids are those of its whole text, then END; null and empty texts have END alone. Each id lies in exactly one
    part, parts of a sequence have no gaps between them. keep_ids adds the ids themselves. sequence_id is unique in the
    result. Rows that repeat a doc_id are packed each on their own; other columns of docs are ignored; an empty table
    gives an empty table. Rows of one partition must come in a fixed order, as those of files do, for a task that runs
    twice to give the same bins. path, pattern: ranks and split pattern of a byte-level BPE, on every machine; added: strings
    that are one id each and are split off first, as by ``added_tokens`` (none: all text is ordinary).
    """
    tokens = tuple(sorted((added or {}).items()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(path, pattern, tokens)
        packer = Packer(capacity, TaskContext.get().partitionId() << 33)
        rows, held = [], 0
        for batch in batches:
            for k in range(0, batch.num_rows, 64):
                some = batch.slice(k, 64)
                for doc_id, text in zip(some["doc_id"].to_pylist(), some["text"].to_pylist(), strict=True):
                    ids = np.array([*encoder.encode(text, allowed_special="all"), END], "<u4")
                    for row in packer.add(doc_id, ids):
                        rows.append(row)
                        held += len(row[0][2])
                        if held >= FRAME_IDS:
                            yield _batch(rows, keep_ids)
                            rows, held = [], 0
        for row in packer.finish():
            rows.append(row)
        if rows:
            yield _batch(rows, keep_ids)

    return with_ids(texts(docs).mapInArrow(run, COLUMNS + (", ids array<int>" if keep_ids else "")))
