"""Quality rules by distribution divergence.

Each language gets a reference from the whole table: a histogram of character classes and one of its most common
words. A document is rejected where the Jensen-Shannon distance of its own histogram to its language's reference is
too large; documents too short for a histogram to mean anything are not judged by it. Two plain rules come first:
too few words, or too many words in repeated five-word windows.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusops.llm.common import join_hot, materialise, texts, with_ids

CLASSES = ("lower", "upper", "digit", "space", "newline", "mark", "symbol", "other_script", "control")

MIN_WORDS = 10  # base rule
MAX_REPEAT_PERCENT = 20  # base rule
GUARD_CHARS = 200  # a shorter text has no character histogram to compare
GUARD_WORDS = 100  # nor a word histogram
MAX_CLASS_DISTANCE = 0.25
MAX_WORD_DISTANCE = 0.64
COMMON_WORDS = 40  # words of a reference
MAX_SENT = 1000  # languages whose references are sent to the workers, some 2 MB; of more, each row gets its own by a join
FLUSH_WORDS = 200_000
FLUSH_LANGUAGES = 10_000

_SYMBOLS = "#*$%&|<>"


def _class_table() -> np.ndarray:
    """The class of each UTF-8 byte; bytes that continue a character count for none (index len(CLASSES))."""
    out = np.full(256, CLASSES.index("symbol"))
    out[:32] = out[127] = CLASSES.index("control")
    for chars, name in (
        (b"abcdefghijklmnopqrstuvwxyz", "lower"), (b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", "upper"), (b"0123456789", "digit"),
        (b" \t\r", "space"), (b"\n", "newline"), (b".,;:!?'\"()-", "mark"),
    ):
        out[list(chars)] = CLASSES.index(name)
    out[128:192] = len(CLASSES)
    out[192:] = CLASSES.index("other_script")
    return out


_CLASS = _class_table()


def class_counts(raw: bytes) -> np.ndarray:
    """Characters of each class in UTF-8 text."""
    n = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    return np.bincount(_CLASS, weights=n, minlength=len(CLASSES) + 1)[: len(CLASSES)]


def distance(p: np.ndarray, q: np.ndarray) -> float:
    """Jensen-Shannon distance (root of the divergence, base 2) of two histograms, from 0 to 1."""
    p, q = p / max(p.sum(), 1e-300), q / max(q.sum(), 1e-300)
    m = (p + q) / 2
    with np.errstate(divide="ignore", invalid="ignore"):
        d = sum(np.where(x > 0, x * np.log2(x / m), 0.0).sum() for x in (p, q)) / 2
    return float(np.sqrt(min(max(d, 0.0), 1.0)))


def repeated_words(words: list) -> int:
    """Words that lie in a five-word window which the text has twice or more, the first one's included."""
    if len(words) < 6:
        return 0
    windows = list(zip(words, words[1:], words[2:], words[3:], words[4:], strict=False))
    seen = Counter(windows)
    if len(seen) == len(windows):
        return 0
    n, covered = 0, 0  # covered: first word that no counted window holds
    for i, w in enumerate(windows):
        if seen[w] > 1:
            n += i + 5 - max(covered, i)
            covered = i + 5
    return n


def duplicate_lines(text: str) -> int:
    lines = [x for x in text.split("\n") if x.strip(" \t\n\x0b\x0c\r")]
    return len(lines) - len(set(lines))


def language_references(docs: DataFrame) -> DataFrame:
    """(lang, classes, names, counts): class counts and the COMMON_WORDS most used words of each language, over all rows.

    classes follow CLASSES, names are by use. A row for every language in docs, of bounded size each.
    """

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[str, Counter] = {}
        classes: dict[str, np.ndarray] = {}
        words = 0

        def rows() -> pd.DataFrame:
            out = [(lang, "word", w.decode("utf-8", "replace"), n) for lang, c in held.items() for w, n in c.items()]
            out += [(lang, "class", name, int(x)) for lang, c in classes.items() for name, x in zip(CLASSES, c, strict=True)]
            held.clear()
            classes.clear()
            return pd.DataFrame(out, columns=["lang", "kind", "name", "n"])

        for batch in batches:
            for lang, text in zip(batch["lang"], batch["text"], strict=True):
                raw = text.encode("utf-8", "surrogatepass")
                own = held.setdefault(lang, Counter())
                words -= len(own)
                own.update(raw.lower().split())
                words += len(own)
                classes[lang] = classes.get(lang, 0) + class_counts(raw)
                if words > FLUSH_WORDS or len(classes) > FLUSH_LANGUAGES:
                    yield rows()
                    words = 0
        yield rows()

    per = docs.mapInPandas(count, "lang string, kind string, name string, n bigint").groupBy("lang", "kind", "name").agg(F.sum("n").alias("n"))
    # Ranked within salts first, so no task ranks a language's whole vocabulary.
    salted = Window.partitionBy("lang", "kind", F.pmod(F.xxhash64("name"), F.lit(64))).orderBy(F.desc("n"), "name")
    of_all = Window.partitionBy("lang", "kind").orderBy(F.desc("n"), "name")
    top = per.withColumn("rank", F.row_number().over(salted)).where(F.col("rank") <= COMMON_WORDS)
    top = top.withColumn("rank", F.row_number().over(of_all)).where((F.col("rank") <= COMMON_WORDS) | (F.col("kind") != "word"))
    common = F.sort_array(F.collect_list(F.when(F.col("kind") == "word", F.struct("rank", "name", "n"))))
    sums = [F.coalesce(F.sum(F.when((F.col("kind") == "class") & (F.col("name") == c), F.col("n"))), F.lit(0)).alias(c) for c in CLASSES]
    return top.groupBy("lang").agg(common.alias("common"), *sums).select("lang", F.array(*CLASSES).alias("classes"), F.col("common.name").alias("names"), F.col("common.n").alias("counts"))


SENT = ("classes", "names", "counts")


def with_references(rows: DataFrame, lang: str, references: DataFrame) -> tuple[DataFrame, dict]:
    """(rows with the columns of SENT, {language: reference}).

    Up to MAX_SENT languages the references go to the workers as the dictionary and the columns are null; where there are more
    they come with their rows by a join, and the dictionary is empty. The verdicts are the same.
    """
    references = materialise(references)
    empty = [F.lit(None).cast(references.schema[c].dataType).alias(c) for c in SENT]
    if len(references.select("lang").take(MAX_SENT + 1)) <= MAX_SENT:
        held = {r["lang"]: (r["classes"], r["names"], r["counts"]) for r in references.collect()}
        return rows.select("*", *empty), held
    return join_hot(rows, references.withColumnRenamed("lang", lang), lang), {}


SCHEMA = (
    "doc_id bigint, n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, "
    "base_failed boolean, kept boolean, class_distance double, word_distance double"
)


class _Judge:
    """Figures and verdict of one text, by its language's reference."""

    def __init__(self, references: dict):
        self.references = {lang: self._ready(*r) for lang, r in references.items()}

    @staticmethod
    def _ready(classes, names, counts) -> tuple:
        return np.asarray(classes, float), [w.encode() for w in names], np.asarray(counts, float)

    def __call__(self, text: str, lang: str, *own) -> tuple:
        raw = text.encode("utf-8", "surrogatepass")
        tokens = raw.split()
        n, repeats = len(tokens), repeated_words(tokens)
        failed = n < MIN_WORDS or 100 * repeats > MAX_REPEAT_PERCENT * n
        by_class = by_word = None
        classes, names, want = self.references[lang] if lang in self.references else self._ready(*own)
        if len(text) >= GUARD_CHARS:
            by_class = distance(class_counts(raw), classes)
        if n >= GUARD_WORDS and len(names):
            have = Counter(raw.lower().split())
            by_word = distance(np.array([have.get(w, 0) for w in names], float), want)
        far = (by_class or 0.0) > MAX_CLASS_DISTANCE or (by_word or 0.0) > MAX_WORD_DISTANCE
        chars = len(text) - sum(text.count(c) for c in " \t\n\x0b\x0c\r")
        return n, chars, sum(text.count(c) for c in _SYMBOLS), duplicate_lines(text), repeats, failed, not failed and not far, by_class, by_word


def judge_quality(docs: DataFrame) -> DataFrame:
    """One row per document: the rule figures of its whole text, its distances and whether it is kept.

    Columns doc_id, text and lang are used; others are ignored. n_words, word_chars, n_symbols, n_dup_lines,
    n_repeat_words; base_failed (fewer than MIN_WORDS words, or more than MAX_REPEAT_PERCENT % in repeated windows);
    class_distance and word_distance, null below the length guards; kept is false where
    base_failed or a distance is over its limit. Null and empty texts have no words and fail. A null language is a
    language of its own. Every language has its reference, however many there are. Repeated rows each give a row; an
    empty table gives an empty table.
    """
    source = texts(docs, "lang")
    source, references = with_references(source, "lang", language_references(source.select("text", "lang")))

    def judge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        judged = _Judge(references)
        names = [x.split()[0] for x in SCHEMA.split(", ")]
        for batch in batches:
            rows = [(i, *judged(*rest)) for i, *rest in zip(*[batch[c] for c in ("doc_id", "text", "lang", *SENT)], strict=True)]
            yield pd.DataFrame(rows, columns=names).astype({"class_distance": float, "word_distance": float})

    return with_ids(source.mapInPandas(judge, SCHEMA))


def keep_quality(docs: DataFrame) -> DataFrame:
    """The rows of docs that judge_quality keeps, as they are; no row is moved where the references can be sent."""
    source = docs.select(F.struct(*docs.columns).alias("row"), F.coalesce("lang", F.lit("")).alias("lang"))
    source, references = with_references(source, "lang", language_references(texts(docs, "lang").select("text", "lang")))

    @F.pandas_udf("boolean")
    def kept(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
        judged = _Judge(references)
        for columns in batches:
            yield pd.Series([judged(*x)[6] for x in zip(*columns, strict=True)], dtype=bool)

    return source.where(kept(F.coalesce("row.text", F.lit("")), "lang", *SENT)).select("row.*")
