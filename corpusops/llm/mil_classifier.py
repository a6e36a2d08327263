"""Quality classifier by attention-based multiple-instance learning.

A document is a bag of passages. Every passage is encoded, a gated attention weighs the encodings, and the weighted
sum is scored. Only documents have labels; which passages matter is learned from them. The model is fitted on a bounded
sample of labelled documents, of long ones on passages spread over them, and scores all documents by all their passages.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusops.llm.common import NO_ID, texts, with_ids
from corpusops.llm.quality_rules import class_counts

PASSAGE = 100  # words
BUCKETS = 128  # of hashed words
DENSE = 16
WIDTH = BUCKETS + DENSE
HIDDEN, GATE = 32, 16
THRESHOLD = 0.3
SAMPLE_DOCS = 6_000  # labelled documents that the model is fitted on at most
FIT_PASSAGES = 32  # of a document, evenly over it, that the model is fitted on at most: with SAMPLE_DOCS, 110 MB of features at the driver
EPOCHS, BATCH, RATE, DECAY = 25, 64, 3e-3, 1e-4
FOLDS, HELD_OUT = 5, 0


def fold(doc_id: str = "doc_id"):
    """crc32 of the id as text, modulo FOLDS; a null id as an empty text."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % FOLDS


def passages(text: str) -> np.ndarray:
    """A row of features for each passage of the whole text; one row of zeros for a text without words."""
    words = text.encode("utf-8", "surrogatepass").split()
    out = np.zeros((max(1, -(-len(words) // PASSAGE)), WIDTH), np.float32)
    for i in range(len(out) if words else 0):
        part = words[i * PASSAGE : (i + 1) * PASSAGE]
        n = len(part)
        raw = b" ".join(part)
        classes = class_counts(raw)
        row = out[i]
        row[:9] = classes / max(1, len(raw))
        row[9] = np.log1p(n) / 5
        row[10] = len(raw) / n / 10
        row[11] = len(set(part)) / n
        row[12] = sum(map(bytes.__eq__, part, part[1:])) / n
        row[13] = classes[1] / max(1.0, classes[0] + classes[1])
        row[14] = max(map(len, part)) / 50
        row[15] = 1.0
        hashed = np.fromiter((zlib.crc32(w) for w in raw.lower().split(b" ")), np.int64, n) % BUCKETS
        row[DENSE:] = np.bincount(hashed, minlength=BUCKETS) / np.sqrt(n)
    return out


def _spread(rows: np.ndarray) -> np.ndarray:
    """At most FIT_PASSAGES of a document's passages, the first and the last among them."""
    return rows if len(rows) <= FIT_PASSAGES else rows[np.linspace(0, len(rows) - 1, FIT_PASSAGES).astype(int)]


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class AttentionModel:
    """Encoder, gated attention and scorer; parameters in one dictionary of arrays."""

    def __init__(self, seed: int = 7):
        r = np.random.default_rng(seed)
        normal = lambda *s: (r.standard_normal(s) / np.sqrt(s[0])).astype(np.float32)
        self.p = {
            "W": normal(WIDTH, HIDDEN), "b": np.zeros(HIDDEN, np.float32), "V": normal(HIDDEN, GATE), "U": normal(HIDDEN, GATE),
            "w": normal(GATE, 1)[:, 0], "c": normal(HIDDEN, 1)[:, 0], "d": np.zeros(1, np.float32),
            "mean": np.zeros(WIDTH, np.float32), "scale": np.ones(WIDTH, np.float32),
        }

    def _forward(self, x: np.ndarray, starts: np.ndarray) -> dict:
        p, bag = self.p, np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(x))))
        x = (x - p["mean"]) / p["scale"]
        h = np.tanh(x @ p["W"] + p["b"])
        t, q = np.tanh(h @ p["V"]), _sigmoid(h @ p["U"])
        e = (t * q) @ p["w"]
        a = np.exp(e - np.maximum.reduceat(e, starts)[bag])
        a /= np.add.reduceat(a, starts)[bag]
        z = np.add.reduceat(a[:, None] * h, starts)
        return {"x": x, "bag": bag, "h": h, "t": t, "q": q, "a": a, "z": z, "s": z @ p["c"] + p["d"]}

    def score(self, x: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """Probability of label 1 for each bag; starts: first row of each."""
        return _sigmoid(self._forward(x, starts)["s"]).astype(float)

    def _gradients(self, x: np.ndarray, starts: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        p, f = self.p, self._forward(x, starts)
        ds = (_sigmoid(f["s"]) - y) / len(y)
        dz = (ds[:, None] * p["c"])[f["bag"]]
        da = (dz * f["h"]).sum(1)
        de = f["a"] * (da - np.add.reduceat(f["a"] * da, starts)[f["bag"]])
        dg = de[:, None] * p["w"]
        dt, dq = dg * f["q"] * (1 - f["t"] ** 2), dg * f["t"] * f["q"] * (1 - f["q"])
        dh = (f["a"][:, None] * dz + dt @ p["V"].T + dq @ p["U"].T) * (1 - f["h"] ** 2)
        return {
            "W": f["x"].T @ dh, "b": dh.sum(0), "V": f["h"].T @ dt, "U": f["h"].T @ dq,
            "w": (f["t"] * f["q"]).T @ de, "c": f["z"].T @ ds, "d": ds.sum(keepdims=True),
        }

    def fit(self, bags: list[np.ndarray], y: np.ndarray, seed: int = 7) -> AttentionModel:
        """Adam over the cross-entropy of the documents' labels."""
        every = np.concatenate(bags)
        self.p["mean"], self.p["scale"] = every.mean(0), every.std(0) + 0.05
        r, m, v, step = np.random.default_rng(seed), {}, {}, 0
        for _ in range(EPOCHS):
            order = r.permutation(len(bags))
            for k in range(0, len(order), BATCH):
                pick = [bags[i] for i in order[k : k + BATCH]]
                starts = np.cumsum([0, *map(len, pick[:-1])])
                step += 1
                for name, g in self._gradients(np.concatenate(pick), starts, y[order[k : k + BATCH]]).items():
                    g = g + DECAY * self.p[name]
                    m[name] = 0.9 * m.get(name, 0) + 0.1 * g
                    v[name] = 0.999 * v.get(name, 0) + 0.001 * g**2
                    move = RATE * (m[name] / (1 - 0.9**step)) / (np.sqrt(v[name] / (1 - 0.999**step)) + 1e-8)
                    self.p[name] = (self.p[name] - move).astype(np.float32)
        return self


def sample(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, text, quality) of at most SAMPLE_DOCS labelled documents outside the held-out fold, by order of a hash."""
    known = labels.where("doc_id is not null and quality in (0, 1)").groupBy("doc_id").agg(F.min("quality").cast("int").alias("quality"))
    known = known.where(fold() != HELD_OUT)
    rows = texts(docs).where((F.col("doc_id") != NO_ID) & (fold() != HELD_OUT))
    there = rows.select("doc_id").distinct().join(known, "doc_id")
    picked = there.orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE_DOCS)
    return rows.join(F.broadcast(picked), "doc_id").dropDuplicates(["doc_id", "text"])


def fit(docs: DataFrame, labels: DataFrame) -> AttentionModel | None:
    """The model fitted on the sample; None without any labelled document. Features are made by the workers."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [_spread(passages(x)) for x in batch["text"]]
            yield pd.DataFrame({"doc_id": batch["doc_id"], "quality": batch["quality"], "n": [len(x) for x in rows], "x": [x.tobytes() for x in rows]})

    got = sample(docs, labels).mapInPandas(run, "doc_id bigint, quality int, n int, x binary").collect()
    got.sort(key=lambda r: (r["doc_id"], r["x"]))
    bags = [np.frombuffer(r["x"], np.float32).reshape(r["n"], WIDTH) for r in got]
    return AttentionModel().fit(bags, np.array([r["quality"] for r in got], np.float32)) if bags else None


def _scores(model: AttentionModel | None, column: pd.Series) -> np.ndarray:
    """Score of each text, some hundred at a time."""
    out = [np.zeros(0)]
    for k in range(0, len(column), 256):
        rows = [passages(x) for x in column.iloc[k : k + 256]]
        starts = np.cumsum([0, *map(len, rows[:-1])])
        out.append(np.full(len(rows), 0.5) if model is None else model.score(np.concatenate(rows), starts))
    return np.concatenate(out)


def keep_predicted(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of docs that score_quality predicts to have label 1, as they are; no row is moved."""
    model = fit(docs, labels)

    @F.pandas_udf("double")
    def scored(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series(_scores(model, batch))

    return docs.where(scored(F.coalesce("text", F.lit(""))) >= THRESHOLD)


def score_quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every document's whole text.

    Labels are learned only from documents outside the held-out fold; score is the probability of label 1, predicted is 1
    from THRESHOLD on. Nothing but the text enters a score. Null and empty texts are one empty passage and get
    the score that the model gives it; without labels every score is 0.5. Labels other than 0 and 1 are ignored, of several
    for a document the least counts. Repeated rows each give a row; other columns are ignored; an empty
    table gives an empty table.
    """
    model = fit(docs, labels)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"doc_id": batch["doc_id"], "score": _scores(model, batch["text"])})

    scored = with_ids(texts(docs).mapInPandas(run, "doc_id bigint, score double"))
    return scored.select("doc_id", (fold() == HELD_OUT).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
