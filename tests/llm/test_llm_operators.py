"""The operators against plain versions, on odd rows and on the small tables."""

import hashlib
import itertools
import math
import os
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pandas as pd
import public_tokenizers as tok
import pytest
import tiktoken
import xxhash
from pyspark.sql import functions as F

from corpusops.llm import (
    bloom_lm, byte_bpe, components, harmonic_packing, license_scan, line_dedup, mil_classifier, order_minhash, quality_rules, sharding, simhash_dedup,
)
from corpusops.llm import registry

RANKS = tok.path("byte_bpe_50k.tiktoken")
_LINE = "The quick brown fox jumps over the lazy dog while twelve tired clerks file forms about rain and ships at sea"


@pytest.fixture(scope="session")
def encoder():
    return tiktoken.Encoding("own", pat_str=tok.PATTERN, mergeable_ranks=byte_bpe.read_ranks(RANKS), special_tokens={})


def rows(df):
    return [r.asDict() for r in df.collect()]


def small(spark, sf_dir, n=60):
    return spark.read.parquet(f"{sf_dir}/documents.parquet").where(f"doc_id < {n}")


# License scans


def test_templates():
    a = license_scan.TokenAutomaton("may <<beginOptional>>freely<<endOptional>> copy <<var;name=x;words=1-3>> by <<var;name=y;match=a b|c>>")
    run = lambda s: a.match(license_scan.words_of(s), 0)
    assert run("May freely copy this by c") == 6 and run("may copy one two three by a b rest") == 8
    assert run("may copy by c") is None and run("may copy 1 2 3 4 by c") is None and run("may never copy this by c") is None
    for bad in ("<<endOptional>>", "<<beginOptional>> a", "<<var;name=x;words=0-2>>", "<<what>>"):
        with pytest.raises(ValueError):
            license_scan.TokenAutomaton(bad)


def test_automata_equal_regular_expressions():
    texts = ["licensed under the terms of the apache license 2 0", "licensed under the apache software license version 2 0 x", "Released under the MIT License.", "licensed under cc by nc 5 0"]
    for label, markup in license_scan.TEMPLATES.items():
        a, r = license_scan.TokenAutomaton(markup), re.compile(license_scan.template_regex(markup))
        for t in texts:
            words = license_scan.words_of(t)
            assert any(a.match(words, i) for i in range(len(words)) if words[i] in a.first) == bool(r.search("".join(" " + w.decode() for w in words))), label


def test_license_rows(docs, none):
    got = {(r["doc_id"], r["n_words"]): r for r in rows(license_scan.scan_licenses(docs))}
    r = got[12, 12]
    assert (r["n_base"], r["first_word"], r["last_word"], r["base_labels"], r["labels"], r["score"]) == (2, 3, 10, "apache,mit", "apache,apache-2.0,mit", 1.0)
    assert got[1, 0]["first_word"] is None and got[1, 0]["labels"] == "" and license_scan.scan_licenses(none).count() == 0
    assert license_scan.scan_licenses(docs).count() == docs.count()


# Quality rules


def _plain_quality(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    seen = Counter(windows)
    hit = {i + k for i, w in enumerate(windows) if seen[w] > 1 for k in range(5)}
    lines, dup, before = text.split("\n"), 0, set()
    for x in lines:
        if re.search(r"[^\x20\x09-\x0D]", x):
            dup += x in before
            before.add(x)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(hit), len(words) < 10 or 100 * len(hit) > 20 * len(words)


def test_quality_rules(spark, docs, none, sf_dir):
    for source in (docs, small(spark, sf_dir)):
        want = sorted((_plain_quality(r["text"] or "") for r in source.collect()), key=repr)
        got = rows(quality_rules.judge_quality(source))
        assert sorted(((r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"]) for r in got), key=repr) == want
        kept = Counter(r["doc_id"] for r in got if r["kept"])
        assert Counter(r["doc_id"] for r in quality_rules.keep_quality(source).collect()) == kept
    assert quality_rules.judge_quality(none).count() == 0 and quality_rules.keep_quality(none).count() == 0


def _divergence(have, want):
    a, b = sum(have), sum(want)
    p, q = [x / a if a else 0 for x in have], [x / b if b else 0 for x in want]
    mean = [(x + y) / 2 for x, y in zip(p, q)]
    return math.sqrt(max(0, sum(x * math.log2(x / m) for s in (p, q) for x, m in zip(s, mean) if x) / 2))


def _char_class(c):
    if ord(c) > 127:
        return "other_script"
    kinds = {"space": " \t\r", "newline": "\n", "mark": ".,;:!?'\"()-"}
    for name, chars in kinds.items():
        if c in chars:
            return name
    if ord(c) < 32 or ord(c) == 127:
        return "control"
    return "lower" if c.islower() else "upper" if c.isupper() else "digit" if c.isdigit() else "symbol"


@pytest.mark.parametrize("sent", [1000, 1])
def test_quality_distances(spark, docs, sf_dir, monkeypatch, sent):
    """Distances and verdicts against plain counts, with the references sent and joined."""
    monkeypatch.setattr(quality_rules, "MAX_SENT", sent)
    source = small(spark, sf_dir, 200).select("doc_id", "text", "lang").unionByName(docs.select("doc_id", "text", "lang"))
    texts = [(r["doc_id"], r["text"] or "", r["lang"] or "") for r in source.collect()]
    split = lambda t: re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t))
    classes, words = {}, {}
    for _, text, lang in texts:
        classes.setdefault(lang, Counter()).update(map(_char_class, text))
        words.setdefault(lang, Counter()).update(split(text))
    common = {k: sorted(c.items(), key=lambda x: (-x[1], x[0].encode()))[: quality_rules.COMMON_WORDS] for k, c in words.items()}
    want = []
    for i, text, lang in texts:
        by_class = by_word = None
        if len(text) >= quality_rules.GUARD_CHARS:
            own = Counter(map(_char_class, text))
            by_class = _divergence([own[c] for c in quality_rules.CLASSES], [classes[lang][c] for c in quality_rules.CLASSES])
        if len(split(text)) >= quality_rules.GUARD_WORDS:
            own = Counter(split(text))
            by_word = _divergence([own[w] for w, _ in common[lang]], [n for _, n in common[lang]])
        far = (by_class or 0) > quality_rules.MAX_CLASS_DISTANCE or (by_word or 0) > quality_rules.MAX_WORD_DISTANCE
        want.append((i, *(None if x is None else round(x, 9) for x in (by_class, by_word)), not _plain_quality(text)[5] and not far))
    got = rows(quality_rules.judge_quality(source))
    plain = lambda x: None if x is None or x != x else round(x, 9)
    assert sorted(((r["doc_id"], plain(r["class_distance"]), plain(r["word_distance"]), r["kept"]) for r in got), key=repr) == sorted(want, key=repr)
    assert any(w[2] is not None for w in want) and Counter(w[0] for w in want if w[3]) == Counter(r["doc_id"] for r in quality_rules.keep_quality(source).collect())


def test_distance():
    p, q = np.array([1.0, 0, 3]), np.array([0, 2.0, 2])
    m = (p / 4 + q / 4) / 2
    kl = lambda a: sum(x * math.log2(x / y) for x, y in zip(a, m) if x)
    assert abs(quality_rules.distance(p, q) - math.sqrt((kl(p / 4) + kl(q / 4)) / 2)) < 1e-12
    assert quality_rules.distance(p, p) == 0 and quality_rules.distance(np.array([1.0, 0]), np.array([0, 1.0])) == 1


# Sharding


def test_shards(docs, none):
    got = rows(sharding.assign_shards(docs, limit=2000))
    size, ids = Counter(), {}
    for r in got:
        size[r["shard"]] += r["n_bytes"]
        ids.setdefault(r["shard"], set()).add(r["doc_id"])
    assert len(got) == docs.count() and sum(size.values()) == sum(len((r["text"] or "").encode()) for r in docs.collect())
    for r in got:
        assert r["shard_bytes"] == size[r["shard"]] and r["depth"] == len(r["shard"])
        assert r["over_limit"] == (size[r["shard"]] > 2000) and (not r["over_limit"] or len(ids[r["shard"]]) == 1)
        assert not any(s != r["shard"] and s.startswith(r["shard"]) for s in size)
    assert sharding.assign_shards(none).count() == 0


# Packing


def test_packing(docs, none, encoder):
    got = rows(harmonic_packing.pack(docs, RANKS, tok.PATTERN))
    want = Counter((r["doc_id"], tuple([*encoder.encode_ordinary(r["text"] or ""), harmonic_packing.END])) for r in docs.collect())
    by_sequence = {}
    for r in got:
        assert r["length"] == len(r["ids"]) and r["ids_crc32"] == zlib.crc32(np.array(r["ids"], "<u4").tobytes())
        by_sequence.setdefault(r["sequence_id"], []).append(r)
    for parts in by_sequence.values():
        at = 0
        for r in sorted(parts, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= harmonic_packing.CAPACITY
    have = Counter()
    for doc_id, ids in want:
        pieces = [r for r in got if r["doc_id"] == doc_id and r["doc_tokens"] == len(ids) and list(ids[r["start"] : r["start"] + r["length"]]) == r["ids"]]
        have[doc_id, ids] = sum(r["length"] for r in pieces) / len(ids)
    assert all(have[k] >= n for k, n in want.items()) and harmonic_packing.pack(none, RANKS, tok.PATTERN).count() == 0


@pytest.mark.parametrize("n", [0, 1, 31, 33, 1000, 1024, 1025, 2047, 2048, 2049, 100_000])
def test_cut(n):
    parts = harmonic_packing.cut(n)
    assert sum(parts) == n and all(0 < p <= 2048 for p in parts)
    for p in parts[:-1]:
        assert (2048 // p) * p > 2048 - 2048 // p


def test_packing_ids_are_the_tokenizers(spark, sf_dir):
    """Ids equal those of the untouched tokenizer, the added token's string included."""
    from tokenizers import Tokenizer

    t, end = Tokenizer.from_file(tok.path("byte_bpe_50k.json")), "<|endoftext|>"
    odd = [f"hello {end} world", end, end * 2, f" {end}", f"a{end}b  {end}\n", f"{end}  \u3000x", "<|endoftext", "|endoftext|>"]
    texts = [r["text"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()] + odd
    added = harmonic_packing.added_tokens(tok.path("byte_bpe_50k.json"))
    assert added == {end: 50256}
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found: dict = {}
    for r in sorted(rows(harmonic_packing.pack(frame, RANKS, tok.PATTERN, added)), key=lambda r: r["start"]):
        found.setdefault(r["doc_id"], []).extend(r["ids"])
    assert [found[i] for i in range(len(texts))] == [[*e.ids, harmonic_packing.END] for e in t.encode_batch(texts, add_special_tokens=False)]
    assert found[len(texts) - len(odd)] == [31373, 220, 50256, 995, 1]


# Language model


def test_levels_and_filter(spark):
    assert list(bloom_lm.level(np.array([1, 2, 3, 4, 5, 6, 1000]))) == [1, 2, 3, 4, 4, 5, 18] or bloom_lm.level(np.array([1]))[0] == 1
    r = np.random.default_rng(1)
    keys = (r.integers(1, 1 << 55, 5000, dtype=np.uint64) << np.uint64(1)) | np.uint64(1)
    counts = r.integers(2, 400, 5000)
    frame = spark.createDataFrame([(int(k), int(n)) for k, n in zip(keys, counts)], "key long, n long")
    bloom, _, _ = bloom_lm.build_filter(frame)
    got = bloom.levels(keys)
    assert (got >= bloom_lm.level(counts)).all() and (got == bloom_lm.level(counts)).mean() > 0.97
    other = (r.integers(1, 1 << 55, 5000, dtype=np.uint64) << np.uint64(1)) | np.uint64(1)
    assert (bloom.levels(other) > 0).mean() < 0.03


@pytest.mark.parametrize("known", [4_000_000, 50])
def test_language_model(spark, docs, none, sf_dir, monkeypatch, known):
    """known: with a small table nearly all exact counts come from the join."""
    monkeypatch.setattr(bloom_lm, "KNOWN_WORDS", known)
    for source in (docs, small(spark, sf_dir)):
        texts = [(r["doc_id"], [*re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), r["text"] or "")), None]) for r in source.collect()]
        held = lambda i: zlib.crc32(b"" if i is None else str(i).encode()) % 5 == 1
        count = Counter(w for i, ws in texts if not held(i) for w in ws)
        n, room = sum(count.values()), sum(count.values()) + 0.5 * (len(count) + 1)
        want = sorted(((i or 0, len(ws), sum(count[w] > 0 for w in ws), n, round(sum(math.log10((count[w] + 0.5) / room) for w in ws), 4), held(i)) for i, ws in texts), key=repr)
        got = rows(bloom_lm.score_texts(source))
        assert sorted(((r["doc_id"] or 0, r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 4), r["held_out"]) for r in got), key=repr) == want
        assert all(r["score"] < 0 for r in got)
    assert bloom_lm.score_texts(none).count() == 0


def test_scores_follow_the_counts(spark, docs, sf_dir):
    """Scores against exact counts, quantised: equal but for the filter's few false positives."""
    mean = lambda n: bloom_lm._MEAN[bloom_lm.level(np.array([n]))[0]] if n else 0.0
    for source in (docs, small(spark, sf_dir)):
        given = [(r["doc_id"], [*re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), r["text"] or "")), None]) for r in source.collect()]
        train = [ws for i, ws in given if zlib.crc32(b"" if i is None else str(i).encode()) % 5 != 1]
        word, pair = Counter(w for ws in train for w in ws), Counter(p for ws in train for p in zip([None, *ws], ws))  # noqa: B905
        room = sum(word.values()) + 0.5 * (len(word) + 1)

        def score(ws):
            total = 0.0
            for a, b in zip([None, *ws], ws):  # noqa: B023, B905
                seen = mean(word[a])  # noqa: B023
                total += math.log10((min(mean(pair[a, b]), seen) + bloom_lm.PRIOR * (mean(word[b]) + 0.5) / room) / (seen + bloom_lm.PRIOR))  # noqa: B023
            return total

        want = sorted(score(ws) for _, ws in given)
        got = sorted(r["score"] for r in rows(bloom_lm.score_texts(source)))
        off = [abs(x - y) / (1 + abs(y)) for x, y in zip(got, want, strict=True)]
        assert np.median(off) < 0.01 and max(off) < 0.1


def test_model_beats_words_alone(spark, sf_dir):
    got = bloom_lm.score_texts(spark.read.parquet(f"{sf_dir}/documents.parquet")).where("held_out").agg(F.sum("score"), F.sum("base_score")).first()
    assert got[0] > got[1]


def test_filter_keeps_every_ngram(spark, monkeypatch):
    """Pairs seen once are counted, and the filter grows with its entries."""
    counted = bloom_lm.count_ngrams(spark.createDataFrame([(1, "a b c d e f")], "doc_id long, text string")).collect()
    assert len(counted) == 7 + 7 and all(r["n"] == 1 for r in counted)
    monkeypatch.setattr(bloom_lm, "MAX_SEGMENT", 1 << 13)
    r = np.random.default_rng(2)
    keys = np.unique(r.integers(1, 1 << 56, 120_000, dtype=np.uint64))
    bloom, parts, n = bloom_lm.build_filter(spark.createDataFrame(pd.DataFrame({"key": keys.view(np.int64), "n": np.ones(len(keys), np.int64)})))
    assert parts.size <= 1 << 13 and parts.segment_bits > 6 and n >= 10 * len(keys)
    assert (bloom.levels(keys) >= 1).all() and (bloom.levels(keys + np.uint64(1 << 57)) > 0).mean() < 0.02


def test_filter_in_segments_scores_the_same(spark, docs, none, sf_dir, monkeypatch):
    for source in (docs, small(spark, sf_dir)):
        figures = lambda: sorted(((r["doc_id"] or 0, r["n_tokens"], r["n_known"], round(r["base_score"], 6), round(r["score"], 6)) for r in rows(bloom_lm.score_texts(source))))  # noqa: B023, E731
        monkeypatch.undo()
        want = figures()
        monkeypatch.setattr(bloom_lm, "BROADCAST_BITS", 0)
        monkeypatch.setattr(bloom_lm, "CHUNK_CHARS", 20_000)
        assert figures() == want
    assert bloom_lm.score_texts(none).count() == 0


def test_common_ngrams_are_not_shuffled(spark, monkeypatch):
    """A word and a pair that every chunk holds are asked for nowhere, so no frame of questions grows with the chunks."""
    monkeypatch.setattr(bloom_lm, "BROADCAST_BITS", 0)
    monkeypatch.setattr(bloom_lm, "CHUNK_CHARS", 200)
    monkeypatch.setattr(bloom_lm, "COMMON", 8)
    source = spark.createDataFrame([(i, f"of the w{i} of the v{i} x{i // 2}") for i in range(400)], "doc_id long, text string")
    counts = bloom_lm.count_ngrams(bloom_lm.texts(source))
    _, parts, _ = bloom_lm.build_filter(counts)
    common = bloom_lm.common_levels(counts, parts)
    assert 3 <= len(common.keys) <= 8 and (common.found > 0).all()
    chunked = bloom_lm.text_chunks(bloom_lm.texts(source))
    asked = bloom_lm.find_levels(chunked, parts, common).groupBy("key").count().agg(F.max("count")).first()[0]
    assert asked < chunked.count() / 2


def test_levels_are_asked_for_in_packed_questions(spark, sf_dir, monkeypatch):
    """Each n-gram of a chunk went out, came back and was kept as a row of its own, and all counts stayed: 9 times the input on disk."""
    keys = np.unique(np.random.default_rng(3).integers(1, 1 << 56, 50_000, dtype=np.uint64))
    assert (bloom_lm._unpacked(bloom_lm._packed(keys)) == keys).all() and len(bloom_lm._unpacked(b"")) == 0
    monkeypatch.setattr(bloom_lm, "CHUNK_CHARS", 50_000)
    monkeypatch.setattr(bloom_lm, "COMMON", 2000)
    source = bloom_lm.texts(small(spark, sf_dir))
    counts = bloom_lm.count_ngrams(source)
    _, parts, _ = bloom_lm.build_filter(counts)
    common = bloom_lm.common_levels(counts, parts)
    chunked = bloom_lm.text_chunks(source)
    answers = bloom_lm._answers(chunked, parts, common)
    assert answers.count() <= chunked.count() << parts.segment_bits
    exact = {r["key"]: bloom_lm.level(np.array([r["n"]]))[0] for r in counts.collect()}
    found = bloom_lm.find_levels(chunked, parts, common).collect()
    assert len(found) == answers.agg(F.sum(F.octet_length("levels"))).first()[0]
    assert all(r["level"] >= exact[r["key"]] for r in found if r["key"] in exact)
    assert sum(r["level"] == exact.get(r["key"], 0) for r in found) > 0.97 * len(found)
    kept = []
    monkeypatch.setattr(bloom_lm, "BROADCAST_BITS", 0)
    monkeypatch.setattr(bloom_lm, "forget", lambda *tables, f=bloom_lm.forget: (kept.extend(t.inputFiles()[0] for t in tables), f(*tables)))
    assert bloom_lm.score_texts(small(spark, sf_dir)).count() > 0
    assert len(kept) == 1 and not os.path.exists(kept[0].removeprefix("file://"))


# Order MinHash


def _plain_signature(spark, texts):
    """The signature by loops; the hashes themselves are Spark's."""
    tokens = {t: re.findall(r"[^ \t\n\x0b\x0c\r]{1,8}", t) for t in texts}
    grams = {t: [tuple(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) >= 3 else ([tuple(w)] if w else []) for t, w in tokens.items()}
    three = sorted({g for t, gs in grams.items() for g in gs if len(tokens[t]) >= 3})
    hashed = {}
    if three:
        frame = spark.createDataFrame(three, "a string, b string, c string")
        hashed = {tuple(r)[:3]: r[3] for r in frame.select("a", "b", "c", F.xxhash64("a", "b", "c")).collect()}
    short = sorted({g for t, gs in grams.items() for g in gs if len(tokens[t]) < 3})
    for g in short:
        hashed["short", g] = spark.createDataFrame([(" ".join(g),)], "a string").select(F.xxhash64("a")).first()[0]
    out = {}
    for t, gs in grams.items():
        seen, each = Counter(), []
        for at, g in enumerate(gs):
            h = hashed[g] if len(tokens[t]) >= 3 else hashed["short", g]
            seen[h] += 1
            each.append((h, seen[h], at))
        again = sorted({(h, n) for h, n, _ in each if n > 1})
        numbered = {(r["h"], r["n"]): r["g"] for r in spark.createDataFrame(again, "h long, n int").select("h", "n", F.xxhash64("h", "n").alias("g")).collect()} if again else {}
        classes = {}
        for h, n, at in each:
            g = h if n == 1 else numbered[h, n]
            classes.setdefault((g % (1 << 64)) >> 59, []).append((g, at))
        out[t] = {c: [g for g, _ in sorted(sorted(xs)[:2], key=lambda x: x[1])] for c, xs in classes.items()}
    return out


def test_order_minhash(spark, docs, none):
    texts = [r["text"] or "" for r in docs.collect() if len(r["text"] or "") < 10_000]
    plain = _plain_signature(spark, texts)
    got = {r["text"]: r["sig"] for r in spark.createDataFrame([(t,) for t in texts], "text string").select("text", order_minhash.signature(F.col("text")).alias("sig")).collect()}
    for t, classes in plain.items():
        want = [spark.createDataFrame([(classes[c],)], "x array<long>").select(F.hash("x")).first()[0] if c in classes else None for c in range(32)] if len(classes) < 4 else None
        assert [x is not None for x in got[t]] == [c in classes for c in range(32)] and (want is None or got[t] == want)


def test_fingerprints(docs, none):
    ordered = sorted({r["doc_id"] for r in docs.collect()}, key=lambda x: -1 if x is None else x)
    text = {i: min(r["text"] or "" for r in docs.collect() if r["doc_id"] == i) for i in ordered}
    for r in rows(order_minhash.fingerprint(docs)):
        mine = [x["text"] or "" for x in docs.collect() if x["doc_id"] == r["doc_id"]]
        nxt = text[ordered[(ordered.index(r["doc_id"]) + 1) % len(ordered)]]
        edited = {hashlib.sha256((t[: len(t) - len(t) // 4] + nxt[: len(t) // 4]).encode()).hexdigest() for t in mine}
        assert r["edited_sha256"] in edited and r["n_chars"] in {len(t) for t in mine} and 0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1
    assert order_minhash.fingerprint(none).count() == 0


def test_likeness_falls_with_moves(spark):
    w = [f"word{i}" for i in range(400)]
    texts = [" ".join(w), " ".join(w[:200] + ["new"] + w[200:]), " ".join(w[200:] + w[:200])]
    sig = [order_minhash.signature(F.lit(t)) for t in texts]
    same, edit, move = spark.range(1).select(*[order_minhash.likeness(sig[0], s) for s in sig]).first()
    assert same == 1 and edit > 0.85 and move < edit


def test_likeness_follows_edits_in_unspaced_text(spark):
    """One character inserted near the start of texts without spaces, one of them of lines of some 40 characters."""
    r = np.random.default_rng(8)
    texts = ["".join(chr(0x4E00 + x) for x in r.integers(0, 3000, 400)), "".join(chr(97 + x) for x in r.integers(0, 26, 2000))]
    texts.append("\n".join("".join(chr(0x3041 + x) for x in r.integers(0, 80, 40)) for _ in range(20)))
    pairs = [(t, t[:5] + "x" + t[5:]) for t in texts] + [(t, t[:7] + t[8:]) for t in texts] + [(texts[0], texts[1])]
    near = order_minhash.likeness(order_minhash.signature(F.col("a")), order_minhash.signature(F.col("b")))
    got = [x["near"] for x in spark.createDataFrame(pairs, "a string, b string").select(near.alias("near")).collect()]
    assert all(x > 0.8 for x in got[:-1]) and got[-1] < 0.1


# BPE


@pytest.mark.parametrize("known", [300_000, 5])
def test_bpe(docs, none, encoder, monkeypatch, known):
    """known: with few known words nearly all ids come from the join."""
    monkeypatch.setattr(byte_bpe, "MAX_KNOWN_WORDS", known)
    got = byte_bpe.decode(byte_bpe.id_bytes(byte_bpe.encode(docs, RANKS)), RANKS).collect()
    want = sorted(((r["doc_id"] or 0, encoder.encode_ordinary(r["text"] or "")) for r in docs.collect()), key=repr)
    assert sorted(((r["doc_id"] or 0, r["ids"]) for r in got), key=repr) == want
    for r in got:
        assert bytes(r["id_bytes"]) == np.array(r["ids"], "<u4").tobytes() and bytes(r["decoded"]) == encoder.decode_bytes(r["ids"])
    once = byte_bpe.encode(docs, RANKS, also=("id_bytes", "decoded")).collect()
    assert sorted(map(repr, once)) == sorted(map(repr, got))
    assert byte_bpe.encode(none, RANKS).count() == 0


def test_bpe_splits_as_the_library(spark, encoder):
    """Every kind of character beside letters, digits and spaces, newer scripts included."""
    chars = [chr(c) for c in [*range(0x3100), *range(0xA000, 0xAC10), *range(0xFB00, 0x10000), *range(0x10000, 0x32000, 7)] if not 0xD800 <= c < 0xE000]
    texts = ["".join(f"a{c} {c}1{c}{c}\n" for c in chars[k : k + 200]) for k in range(0, len(chars), 200)]
    got = {r["doc_id"]: r["ids"] for r in byte_bpe.encode(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), RANKS).collect()}
    assert [i for i, t in enumerate(texts) if got[i] != encoder.encode_ordinary(t)] == []


def test_heap_merges(encoder):
    ranks = byte_bpe.read_ranks(RANKS)
    for word in ("a", "abababab", "x" * 1000, "漢字仮名" * 50, " the"):
        assert byte_bpe.merge_bytes(word.encode(), ranks) == encoder._encode_single_piece(word.encode())


# SimHash


def _plain_simhash(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text))
    if not words:
        return 0
    parts = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    hs = [xxhash.xxh64_intdigest(p.encode(), 42) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def _components(fps):
    at = {f: f for f in fps}

    def find(f):
        while at[f] != f:
            f = at[f]
        return f

    keys = sorted(at)
    for i, a in enumerate(keys):
        for b in keys[i + 1 :]:
            if (a ^ b).bit_count() <= 2:
                at[find(a)] = find(b)
    return {f: find(f) for f in keys}


def test_near_duplicates(docs, none):
    got = rows(simhash_dedup.near_duplicates(docs))
    source = docs.collect()
    assert Counter((r["doc_id"], r["fingerprint"]) for r in got) == Counter((r["doc_id"], f"{_plain_simhash(r['text'] or ''):016x}") for r in source)
    root = _components({int(r["fingerprint"], 16) for r in got})
    first = {}
    for r in got:
        k = root[int(r["fingerprint"], 16)]
        if r["doc_id"] is not None:
            first[k] = min(first.get(k, 1 << 62), r["doc_id"])
    assert all(r["component_id"] == first.get(root[int(r["fingerprint"], 16)]) for r in got)
    assert simhash_dedup.near_duplicates(none).count() == 0 and simhash_dedup.keep_one(none).count() == 0
    kept = simhash_dedup.keep_one(docs)
    groups = {root[_plain_simhash(r["text"] or "")] for r in source}
    assert kept.columns == docs.columns and sorted(root[_plain_simhash(r["text"] or "")] for r in kept.collect()) == sorted(groups)
    for r in kept.collect():  # the smallest id of its group; none only where the group has none
        assert r["doc_id"] == first.get(root[_plain_simhash(r["text"] or "")])


def test_repeated_ids_lose_no_text(spark):
    """Rows that repeat a doc_id, or have none, are told apart by their texts; of rows that repeat both, one stays."""
    own = "quite another unique sentence about twelve clerks who file forms in the rain"
    docs = spark.createDataFrame([(1, _LINE, 1), (2, _LINE, 2), (2, own, 3), (None, own[6:] + " at sea", 4), (2, own, 5)], "doc_id long, text string, gone int")
    kept = simhash_dedup.keep_one(docs)
    assert kept.columns == docs.columns and sorted(r["text"] for r in kept.collect()) == sorted([_LINE, own, own[6:] + " at sea"])
    left = {r["gone"]: r["text"] for r in line_dedup.dedup_lines(docs).collect()}
    assert left[1] == _LINE and left[2] == "" and left[3] == left[5] == own and len(left) == 5
    report = sorted(((r["doc_id"], r["n_lines"], r["n_kept"], r["removed"]) for r in line_dedup.line_report(docs.where("doc_id is not null")).collect()))
    assert report == [(1, 1, 1, ""), (2, 1, 0, "0"), (2, 1, 1, ""), (2, 1, 1, "")]


@pytest.mark.parametrize("long_list", [32, 3])
def test_links_reach_all_components(spark, monkeypatch, long_list):
    """Planted fingerprints a few bits apart; with a small limit most lists link through shared values."""
    monkeypatch.setattr(simhash_dedup, "LONG_LIST", long_list)
    r = np.random.default_rng(3)
    fps = {int(x) for x in r.integers(0, 1 << 63, 150)}
    for center in list(fps)[:12]:
        for _ in range(25):
            f = center
            for b in r.integers(0, 64, int(r.integers(1, 4))):
                f ^= 1 << int(b)
            fps.add(f)
    fps = sorted(fps)
    signed = lambda f: f - (1 << 64) if f >> 63 else f
    classes = spark.createDataFrame([(signed(f),) for f in fps], "fp long")
    found = {x["node"]: x["component"] for x in components.components(simhash_dedup.links(classes)).collect()}
    root, name = _components(fps), {}
    for f in fps:
        assert name.setdefault(root[f], found.get(signed(f), signed(f))) == found.get(signed(f), signed(f))
    assert len(set(name.values())) == len(name)


def test_tally_counts_shared_bytes():
    """Pairs of 8 bytes that share 6 meet in MIN_TALLY postings at least, pairs that share fewer in fewer."""
    for k in range(9):
        for same in itertools.combinations(range(8), k):
            shared = sum(set(p) <= set(same) for p in simhash_dedup.POSTINGS)
            assert (shared >= simhash_dedup.MIN_TALLY) == (k >= 6)
    assert len(simhash_dedup.POSTINGS) == 14 and simhash_dedup.MIN_TALLY == 3


def test_components(spark):
    chain = [(i, i + 1) for i in range(100, 400)] + [(5, 5), (7, 6), (6, 7), (None, 1), (900, 3), (900, 2), (900, 901)]
    got = {r["node"]: r["component"] for r in components.components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert all(got[i] == 100 for i in range(100, 401)) and got[7] == got[6] == 6 and {got[i] for i in (900, 3, 2, 901)} == {2} and 5 not in got
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


# Line dedup


def test_line_dedup(spark, docs, none, sf_dir):
    source = small(spark, sf_dir, 200)
    got = rows(line_dedup.line_components(source))
    texts = {(r["doc_id"], k): x.strip(" ").lower() for r in source.collect() for k, x in enumerate(r["text"].split("\n")) if x.strip(" ")}
    distinct = sorted(set(texts.values()))
    sets = [{x[i : i + 8] for i in range(len(x) - 7)} or {x} for x in distinct]
    at = list(range(len(distinct)))

    def find(i):
        while at[i] != i:
            i = at[i]
        return i

    where = {}
    for i, s in enumerate(sets):
        tally = Counter(j for g in s for j in where.get(g, ()))
        for j, n in tally.items():
            if n >= 0.8 * (len(s) + len(sets[j]) - n):
                at[find(i)] = find(j)
        for g in s:
            where.setdefault(g, []).append(i)
    group, first = {k: find(distinct.index(x)) for k, x in texts.items()}, {}
    for k in sorted(texts):
        first.setdefault(group[k], k)
    assert {(r["doc_id"], r["line_no"]) for r in got} == set(texts)
    wrong = [r for r in got if r["kept"] != (first[group[r["doc_id"], r["line_no"]]] == (r["doc_id"], r["line_no"]))]
    assert len(wrong) <= 0.01 * len(got)  # banding finds all but a few in a thousand of the pairs at the threshold
    assert line_dedup.line_components(none).count() == 0 and line_dedup.line_report(none).count() == 0
    assert sorted(map(repr, line_dedup.dedup_lines(docs).columns)) == sorted(map(repr, docs.columns)) and line_dedup.dedup_lines(docs).count() == docs.count()
    assert {r["doc_id"] for r in rows(line_dedup.line_report(docs))} == {r["doc_id"] for r in docs.collect()}
    left = {r["doc_id"]: r["text"] for r in line_dedup.dedup_lines(docs.where("doc_id = 11")).collect()}
    assert left[11].split("\n")[:2] == ["x", "y"] and left[11].count("x y z") == 1


def _joined(spark, texts):
    """Component of each text by the operator, and the pairs that are similar by brute force."""
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = {r["doc_id"]: r["component"] for r in line_dedup.line_components(docs).collect()}
    sets = [{x[i : i + 8] for i in range(len(x) - 7)} or {x} for x in texts]
    near = []
    for i, a in enumerate(sets):
        for j in range(i):
            n = len(a & sets[j])
            if n >= 0.8 * (len(a) + len(sets[j]) - n):
                near.append((i, j))
    return found, near


def test_long_lines_without_many_words(spark):
    """Unspaced lines, URLs and lines of few long words, each with a copy that has one character edited."""
    r = np.random.default_rng(5)
    word = lambda n: "".join(chr(97 + x) for x in r.integers(0, 26, n))
    given = [word(150) for _ in range(40)] + ["".join(chr(0x4E00 + x) for x in r.integers(0, 3000, 120)) for _ in range(40)]
    given += [f"https://{word(12)}.example/{word(60)}?id={word(60)}" for _ in range(40)] + [" ".join(word(30) for _ in range(6)) for _ in range(40)]
    copies = ["0" + x[1:] for x in given[:80]]
    copies += [x[:k] + "0" + x[k + 1 :] for x, k in zip(given[80:], [31 * (i % 5) for i in range(80)], strict=True)]
    found, near = _joined(spark, given + copies)
    assert len(near) >= len(given) and all(found[i] == found[j] for i, j in near)


@pytest.mark.parametrize("own", [6, 8, 12])
def test_crowded_lines(spark, own):
    """Lines of one boilerplate and own words, so many that their lists are long: the pairs that are similar are joined."""
    r = np.random.default_rng(own)
    word = lambda: "".join(chr(97 + x) for x in r.integers(0, 26, 7))
    boilerplate, given = [word() for _ in range(40)], []
    for _ in range(300):
        mine = [word() for _ in range(own)]
        given += [" ".join([*boilerplate, *mine]), " ".join([*boilerplate, word(), *mine[1:]])]
    found, near = _joined(spark, given)
    assert len(near) >= 300 and sum(found[i] == found[j] for i, j in near) >= 0.97 * len(near)


def test_lists_that_are_long_twice_lose_no_pair(spark, monkeypatch):
    """All similar lines of a list end in one component, where all lists are taken for long, too; before, two lines of such a list met the others."""
    monkeypatch.setattr(line_dedup, "LONG_LIST", 1)
    monkeypatch.setattr(line_dedup, "BLOCK", 16)
    r = np.random.default_rng(18)
    word = lambda: "".join(chr(97 + x) for x in r.integers(0, 26, 7))
    boilerplate, given = [word() for _ in range(40)], []
    for _ in range(60):
        mine = [word() for _ in range(8)]
        given += [" ".join([*boilerplate[k:], *mine[: 8 - k], *[word() for _ in range(k)]]) for k in range(6)]
    found, near = _joined(spark, given)
    frame = spark.createDataFrame(list(enumerate(given)), "id long, line string")
    keys = {x["id"]: set(x["k"]) for x in frame.select("id", line_dedup.line_keys(F.col("line")).alias("k")).collect()}
    listed = [(i, j) for i, j in near if keys[i] & keys[j]]
    assert len(listed) > 300 and all(found[i] == found[j] for i, j in listed)
    # All pairs of a list that are similar are among those compared, and most of the others aren't.
    texts = frame.select(F.col("id").alias("line_id"), "line")
    lists = texts.select(F.lit("k").alias("key"), "line_id", F.lit(len(given)).alias("n"), F.col("line_id").alias("component"))
    pairs = {(x["b"], x["a"]) for x in line_dedup.rest_pairs(lists, texts).collect()}
    assert set(near) <= pairs and len(pairs) < 0.5 * len(given) * (len(given) - 1) / 2
    assert {(x["b"], x["a"]) for x in line_dedup.verified(texts, spark.createDataFrame([(j, i) for i, j in pairs], "a long, b long")).collect()} == set(near)


def test_lines_of_one_boilerplate_do_not_meet(spark):
    """Lines that share a boilerplate and nothing else don't meet in pairs, however many there are; before, all did."""
    r = np.random.default_rng(19)
    word = lambda: "".join(chr(97 + x) for x in r.integers(0, 26, 7))
    boilerplate = [word() for _ in range(40)]
    texts = spark.createDataFrame([(i, " ".join([*boilerplate, *[word() for _ in range(10)]]), i) for i in range(400)], "line_id long, line string, component long")
    first = line_dedup.prefixes(texts)
    assert line_dedup.prefix_pairs(first).count() == 0 and line_dedup.centred_pairs(first).count() <= 4 * 400
    # Beyond the lines there is nothing but what two of them have in common.
    again = texts.unionByName(texts.limit(1).selectExpr("1000L AS line_id", "concat(line, ' end') AS line", "1000L AS component"))
    assert [(r["a"], r["b"]) for r in line_dedup.prefix_pairs(line_dedup.prefixes(again)).collect()] == [(0, 1000)]


def test_recall_of_links(spark):
    """Lines of 8 to 90 words with up to a ninth of them replaced: nearly all similar pairs are joined, those near the threshold, too."""
    r = np.random.default_rng(9)
    vocabulary = ["".join(chr(97 + x) for x in r.integers(0, 26, int(r.integers(2, 10)))) for _ in range(3000)]
    given = []
    for _ in range(500):
        w = [vocabulary[k] for k in r.integers(0, 3000, int(r.integers(8, 90)))]
        v = list(w)
        for _ in range(int(r.integers(1, 1 + max(1, len(w) // 9)))):
            v[int(r.integers(0, len(v)))] = vocabulary[int(r.integers(0, 3000))]
        given += [" ".join(w), " ".join(v)]
    found, near = _joined(spark, given)
    assert len(near) > 150 and sum(found[i] == found[j] for i, j in near) >= 0.97 * len(near)


# Classifier


def test_gradients():
    r = np.random.default_rng(0)
    m = mil_classifier.AttentionModel()
    m.p = {k: v.astype(np.float64) for k, v in m.p.items()}
    x, starts, y = r.random((7, mil_classifier.WIDTH)), np.array([0, 3, 4]), np.array([1.0, 0, 1])
    grad = m._gradients(x, starts, y)

    def loss():
        s = m.score(x, starts)
        return -np.mean(y * np.log(s) + (1 - y) * np.log(1 - s))

    for name, g in grad.items():
        k = tuple(np.unravel_index(np.argmax(abs(g)), g.shape))
        old = m.p[name][k]
        m.p[name][k] = old + 1e-5
        up = loss()
        m.p[name][k] = old - 1e-5
        down = loss()
        m.p[name][k] = old
        assert abs((up - down) / 2e-5 - g[k]) < 1e-4 * max(1, abs(g[k])), name


def test_classifier(spark, docs, none, labels):
    got = rows(mil_classifier.score_quality(docs, labels))
    assert Counter(r["doc_id"] for r in got) == Counter(r["doc_id"] for r in docs.collect())
    for r in got:
        assert 0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) and r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode() if r["doc_id"] is not None else b"") % 5 == 0)
    assert mil_classifier.score_quality(none, labels).count() == 0
    assert {r["score"] for r in rows(mil_classifier.score_quality(docs, labels.limit(0)))} == {0.5}
    assert mil_classifier.keep_predicted(docs, labels.limit(0)).count() == docs.count()


def test_classifier_held_out(spark):
    d = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{d}/{t}.parquet") for t in ("documents", "labels"))
    got = mil_classifier.score_quality(docs, labels).where("held_out").join(labels, "doc_id")
    assert got.agg(F.avg((F.col("predicted") == F.col("quality")).cast("int"))).first()[0] >= 0.95


# Queries and pipeline


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_queries_match_sql(spark, sf_dir, name):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf_dir}/documents.parquet'")
    frame = registry.QUERIES[name](spark, sf_dir)
    got = con.execute(registry.ORACLES[name])
    columns = [d[0] for d in got.description]
    assert sorted(columns) == sorted(frame.columns)
    assert sorted(map(repr, (tuple(r) for r in frame.select(*columns).collect()))) == sorted(map(repr, got.fetchall()))


def test_pipeline(spark, sf_dir):
    import corpus_pipeline

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    kept, frames = docs, []
    for _, stage in corpus_pipeline.STAGES:
        kept = stage(spark, kept, sf_dir).cache()
        frames.append(kept)
    quality, classified, lines, near, packed = frames
    assert all(f.columns == docs.columns for f in frames[:-1])
    judged = {r["doc_id"] for r in rows(quality_rules.judge_quality(docs)) if r["kept"]}
    assert {r["doc_id"] for r in quality.collect()} == judged
    assert classified.count() <= quality.count() and lines.count() == classified.count() and near.count() < lines.count()
    assert {r["doc_id"] for r in packed.select("doc_id").distinct().collect()} == {r["doc_id"] for r in near.collect()}
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where("quality = 1")
    clean = docs.join(labels, "doc_id", "left_semi")
    assert classified.join(labels, "doc_id", "left_semi").count() >= 0.9 * clean.count()


@pytest.mark.parametrize("empty", [False, True])
def test_pipeline_on_odd_rows(spark, docs, labels, none, tmp_path, empty):
    """Null, empty, repeated and very long texts, null ids and clashing names go through every stage; an empty table, too."""
    import corpus_pipeline

    (none if empty else docs).write.parquet(f"{tmp_path}/documents.parquet")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    kept = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        stage(spark, kept, str(tmp_path)).write.parquet(f"{tmp_path}/{name}")
        kept = spark.read.parquet(f"{tmp_path}/{name}")
        assert kept.columns == docs.columns
    packed = corpus_pipeline.run(spark, str(tmp_path))
    assert packed.agg(F.countDistinct("sequence_id", "offset")).first()[0] == packed.count() and (packed.count() == 0) == empty
