"""Order MinHash signatures and likenesses against loops, hashes included."""

import re
import struct

import pytest
import xxhash
from pyspark.sql import functions as F

from corpusops.llm import order_minhash as om

_M = (1 << 64) - 1


def _xx(data, seed=42):
    return xxhash.xxh64(data, seed=seed & _M).intdigest()


def _signed(x):
    return x - (1 << 64) if x >> 63 else x


def _murmur(values):
    """Hash of an array of longs, each mixed into the one before."""
    rot = lambda x, r: ((x << r) | (x >> (32 - r))) & 0xFFFFFFFF
    h = 42
    for v in values:
        for part in (v & 0xFFFFFFFF, (v >> 32) & 0xFFFFFFFF):
            k = rot(part * 0xCC9E2D51 & 0xFFFFFFFF, 15) * 0x1B873593 & 0xFFFFFFFF
            h = (rot(h ^ k, 13) * 5 + 0xE6546B64) & 0xFFFFFFFF
        h ^= 8
        h = (h ^ (h >> 16)) * 0x85EBCA6B & 0xFFFFFFFF
        h = (h ^ (h >> 13)) * 0xC2B2AE35 & 0xFFFFFFFF
        h ^= h >> 16
    return h


def _plain(text):
    tokens = []
    for part in re.findall(r"[^ \t-\r]{25,}|[^ \t-\r]{1,8}", text):
        tokens += [part[i : i + 4] for i in range(len(part) - 3)] if len(part) > 24 else [part]
    if len(tokens) >= 3:
        kmers = []
        for i in range(len(tokens) - 2):
            h = 42
            for t in tokens[i : i + 3]:
                h = _xx(t.encode(), h)
            kmers.append(h)
    else:
        kmers = [_xx(" ".join(tokens).encode())] if tokens else []
    seen, numbered = {}, []
    for at, h in enumerate(kmers):
        n = seen[h] = seen.get(h, 0) + 1
        numbered.append((h if n == 1 else _xx(struct.pack("<i", n), _xx(struct.pack("<Q", h))), at))
    out = []
    for c in range(32):
        mine = sorted((_signed(g), at) for g, at in numbered if g >> 59 == c)[:2]
        out.append(_murmur([g for g, _ in sorted(mine, key=lambda x: x[1])]) if mine else None)
    return out


def _text(sig):
    return "".join("--------" if x is None else f"{x:08X}" for x in sig)


def _likeness(a, b):
    used = [(x, y) for x, y in zip(a, b) if x is not None or y is not None]
    return sum(x == y for x, y in used) / len(used) if used else 1.0


def test_signatures(spark):
    """Filled classes, repeats, short texts, long runs, odd characters."""
    texts = ["", "a", "one two", "a b c " * 40, "x" * 300, " ".join(f"word{i % 37} and{i % 5}" for i in range(400)), "漢字" * 60 + " and some words", "é ü \U0001f600 ß\tq\n" * 9]
    got = spark.createDataFrame(list(enumerate(texts)), "i long, text string").select("i", om.as_text(om.signature(F.col("text"))).alias("s")).collect()
    assert {r["i"]: r["s"] for r in got} == {i: _text(_plain(t)) for i, t in enumerate(texts)}


@pytest.mark.parametrize("table", [True, False])
def test_fingerprints_and_likenesses(spark, sf_dir, docs, table):
    if table:
        source = spark.read.parquet(f"{sf_dir}/documents.parquet").where("length(text) < 4000")
    else:
        source = docs.where("length(coalesce(text, '')) < 4000").dropDuplicates(["doc_id"])
    rows = sorted(((r["doc_id"], r["text"] or "") for r in source.collect()), key=lambda r: (r[0] is not None, r[0] or 0))
    plain = {t: _plain(t) for _, t in rows}
    want = []
    for (i, t), (_, after) in zip(rows, rows[1:] + rows[:1]):
        q = len(t) // 4
        edited = _plain(t[: len(t) - q] + after[:q])
        want.append((i, len(t), _text(plain[t]), _text(edited), round(_likeness(plain[t], edited), 9), round(_likeness(plain[t], plain[after]), 9)))
    got = [(r["doc_id"], r["n_chars"], r["fingerprint"], r["edited_fingerprint"], round(r["near_edited"], 9), round(r["near_next"], 9)) for r in om.fingerprint(source).collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)
