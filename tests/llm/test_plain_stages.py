"""The classifier's forward pass, written shards, and the pipeline's whole result against plain stages."""

import math
import zlib
from collections import defaultdict

import numpy as np
import pandas as pd
import public_tokenizers as tok
import pytest
import tiktoken
import xxhash

from corpusops.llm import byte_bpe, mil_classifier, quality_rules, sharding


def _forward(model, text):
    """The score of a text by loops over passages, units and gates."""
    p = {k: v.astype(float) for k, v in model.p.items()}
    hidden, weights = [], []
    for x in mil_classifier.passages(text).astype(float):
        x = [(a - m) / s for a, m, s in zip(x, p["mean"], p["scale"])]
        h = [math.tanh(sum(x[i] * p["W"][i][j] for i in range(len(x))) + p["b"][j]) for j in range(len(p["b"]))]
        gate = 0.0
        for g in range(len(p["w"])):
            t = math.tanh(sum(h[j] * p["V"][j][g] for j in range(len(h))))
            gate += p["w"][g] * t / (1 + math.exp(-sum(h[j] * p["U"][j][g] for j in range(len(h)))))
        hidden.append(h)
        weights.append(gate)
    top = max(weights)
    e = [math.exp(w - top) for w in weights]
    z = [sum(a * h[j] for a, h in zip(e, hidden)) / sum(e) for j in range(len(hidden[0]))]
    return 1 / (1 + math.exp(-(sum(a * c for a, c in zip(z, p["c"])) + p["d"][0])))


def test_scores_equal_a_plain_forward_pass(spark, sf_dir):
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    model = mil_classifier.fit(docs, labels)
    texts = {r["doc_id"]: r["text"] for r in docs.where("doc_id % 9 = 0 and length(text) < 6000").collect()}
    got = {r["doc_id"]: r["score"] for r in mil_classifier.score_quality(docs, labels).collect()}
    assert texts and all(abs(got[i] - _forward(model, t)) < 1e-3 for i, t in texts.items())


def test_long_documents_fit_too(spark):
    """A long document gives as many passages as the bound says, from all over it; none is left out for its length."""
    words = " ".join(f"w{i}" for i in range(100 * 500))
    assert len(mil_classifier._spread(mil_classifier.passages(words))) == mil_classifier.FIT_PASSAGES
    docs = spark.createDataFrame([(i, words if i == 3 else "few words here") for i in range(1, 9)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(1, 9)], "doc_id long, quality int")
    assert 3 in {r["doc_id"] for r in mil_classifier.sample(docs, labels).collect()}
    assert mil_classifier.SAMPLE_DOCS * mil_classifier.FIT_PASSAGES * mil_classifier.WIDTH * 4 < 300e6


@pytest.mark.parametrize("name", ["extra", "shard", "SHARD"])
def test_written_shards(spark, docs, tmp_path, name):
    """Every row in its shard's folder, with all columns, whatever they are called."""
    given = docs.withColumnRenamed("k", name)
    path = f"{tmp_path}/shards"
    key = sharding.write_shards(given, path, limit=2000)
    inferred = "spark.sql.sources.partitionColumnTypeInference.enabled"
    spark.conf.set(inferred, False)
    back = spark.read.parquet(path).cache()
    spark.conf.set(inferred, True)
    assert key.lower() not in {c.lower() for c in given.columns} and set(back.columns) == {*given.columns, key}
    text = lambda df: sorted(map(repr, df.select(*given.columns).collect()))
    assert text(back) == text(given)
    want = {(r["doc_id"], r["shard"]) for r in sharding.assign_shards(given, 2000).collect()}
    assert {(r["doc_id"], r[key] or "") for r in back.select("doc_id", key).collect()} == want
    sharding.write_shards(given.limit(0), f"{tmp_path}/none", limit=2000)


def _find(parent, x):
    while parent[x] != x:
        parent[x] = parent[parent[x]]
        x = parent[x]
    return x


def _plain_lines(docs):
    """{doc_id: text} without repeated and similar lines, by comparing all lines that share a shingle."""
    shingles, holders, places = {}, defaultdict(list), []
    for i, text in sorted(docs.items()):
        for no, raw in enumerate((text or "").split("\n")):
            line = raw.strip(" ").lower()
            if line:
                places.append((i, no, line))
                if line not in shingles:
                    shingles[line] = frozenset(line[k : k + 8] for k in range(len(line) - 7)) or frozenset([line])
                    for s in shingles[line]:
                        holders[s].append(line)
    parent = {x: x for x in shingles}
    for line, mine in shingles.items():
        for other in {x for s in mine for x in holders[s]}:
            both = len(mine & shingles[other])
            if both >= 0.8 * (len(mine) + len(shingles[other]) - both):
                a, b = _find(parent, line), _find(parent, other)
                parent[max(a, b)] = min(a, b)
    seen, gone = set(), defaultdict(set)
    for i, no, line in places:
        root = _find(parent, line)
        if root in seen:
            gone[i].add(no)
        seen.add(root)
    return {i: t if not gone[i] else "\n".join(x for no, x in enumerate(t.split("\n")) if no not in gone[i]) for i, t in docs.items()}


def _fingerprint(text):
    lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = [w for w in "".join(" " if c in "\t\n\x0b\x0c\r" else c for c in lower).split(" ") if w]
    grams = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] if len(words) >= 3 else [" ".join(words)] if words else []
    hashes = [xxhash.xxh64(g.encode(), seed=42).intdigest() for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def _plain_near(docs):
    """The documents that are the first of their group."""
    prints = {i: _fingerprint(t) for i, t in docs.items()}
    parent = {i: i for i in docs}
    for i in docs:
        for j in docs:
            if i < j and bin(prints[i] ^ prints[j]).count("1") <= 2:
                a, b = _find(parent, i), _find(parent, j)
                parent[max(a, b)] = min(a, b)
    return {i: t for i, t in docs.items() if _find(parent, i) == i}


def test_pipeline_equals_plain_stages(spark, sf_dir):
    """What is packed: the verdicts of the rules and the classifier, then lines and near duplicates by comparing all, then the library's ids."""
    import corpus_pipeline

    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    good = {r["doc_id"] for r in quality_rules.judge_quality(docs).collect() if r["kept"]}
    kept = docs.where(docs["doc_id"].isin(good))
    model = mil_classifier.fit(kept, labels)
    texts = {r["doc_id"]: r["text"] for r in kept.collect()}
    scores = {i: float(mil_classifier._scores(model, pd.Series([t or ""]))[0]) for i, t in texts.items()}
    left = _plain_near(_plain_lines({i: t for i, t in texts.items() if scores[i] >= mil_classifier.THRESHOLD}))

    encoder = tiktoken.Encoding("own", pat_str=tok.PATTERN, mergeable_ranks=byte_bpe.read_ranks(tok.path("byte_bpe_50k.tiktoken")), special_tokens={})
    pieces = defaultdict(list)
    for r in corpus_pipeline.run(spark, sf_dir).collect():
        pieces[r["doc_id"]].append((r["start"], r["length"], r["ids_crc32"]))
    assert set(pieces) == set(left)
    for i, text in left.items():
        ids, at = [*encoder.encode_ordinary(text or ""), 1], 0
        for start, length, crc in sorted(pieces[i]):
            assert start == at and crc == zlib.crc32(np.array(ids[at : at + length], "<u4").tobytes())
            at += length
        assert at == len(ids)
