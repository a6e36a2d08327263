"""Similarity joins against all pairs."""

import difflib
import random

import pytest
from pyspark.sql import functions as F

from corpusops.functions import textnorm
from corpusops.operators import linkage, similarity


def _titles(seed, n, words=("alpha", "beta", "gamma", "of", "the", "net", "graph", "x")):
    rnd = random.Random(seed)
    out = []
    for i in range(n):
        t = " ".join(rnd.choice(words) for _ in range(rnd.randint(1, 7)))
        if out and i % 3:
            t = list(rnd.choice(out))
            for _ in range(rnd.randint(0, 5)):
                at = rnd.randrange(len(t) + 1)
                t[at : at + rnd.randint(0, 1)] = rnd.choice(["", "q", "ab"])
            t = "".join(t)
        out.append(t)
    return out


def _distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def _frame(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "id long, text string")


@pytest.mark.parametrize("threshold", [0.5, 0.78, 0.875, 0.92, 1.0])
def test_near_texts_lose_no_pair(spark, threshold):
    a, b = _titles(1, 90) + ["", "a", "Zoë zoë"], _titles(2, 70) + _titles(1, 20) + ["", "a", "b", "Zoé zoë"]
    got = sorted(tuple(r) for r in similarity.near_texts(_frame(spark, a), _frame(spark, b), threshold).collect())
    want = [(i, j) for i, x in enumerate(a) for j, y in enumerate(b) if x and y and _distance(x, y) <= int(max(len(x), len(y)) * (1 - threshold) + 1e-9)]
    assert got == sorted(want) and want


@pytest.mark.parametrize("threshold", [0.5, 0.78, 0.9])
def test_common_characters_lose_no_ratio(spark, threshold):
    a, b = _titles(3, 80) + ["", "ab"], _titles(4, 60) + _titles(3, 25) + ["", "ba", "b"]
    got = {tuple(r) for r in similarity.common_characters(_frame(spark, a), _frame(spark, b), threshold).collect()}
    ratio = lambda x, y: difflib.SequenceMatcher(None, x, y).ratio()
    assert {(i, j) for i, x in enumerate(a) for j, y in enumerate(b) if x and y and ratio(x, y) >= threshold} <= got
    shared = lambda x, y: sum(min(x.count(c), y.count(c)) for c in set(x))
    assert all(2 * shared(a[i], b[j]) >= threshold * (len(a[i]) + len(b[j])) - 1e-6 for i, j in got) and got


@pytest.mark.parametrize("threshold", [0.2, 0.5, 0.8, 1.0])
def test_similar_sets_lose_no_pair(spark, threshold):
    rnd = random.Random(5)
    make = lambda n, vocabulary: [sorted({f"w{int(rnd.random() ** 2 * vocabulary)}" for _ in range(rnd.randint(0, 30))}) for _ in range(n)]
    a, b = make(120, 60), make(80, 40)
    b += [x[:] for x in a[:5]]
    frame = lambda rows: spark.createDataFrame(list(enumerate(rows)), "id long, tokens array<string>")
    got = sorted((r.a, r.b, r.n, r.m, r.shared) for r in similarity.similar_sets(frame(a), frame(b), threshold).collect())
    want = []
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            s = len(set(x) & set(y))
            if x and y and s / (len(x) + len(y) - s) >= threshold:
                want.append((i, j, len(x), len(y), s))
    assert got == sorted(want) and want


@pytest.mark.parametrize("ratio", [textnorm.ratio_levenshtein, textnorm.ratio_ratcliff])
@pytest.mark.parametrize("threshold", [0.6, 0.78, 0.95])
def test_best_links_equal_all_pairs(spark, ratio, threshold):
    """In steps or at once, each row's best note is that of all pairs; no plan holds a nested loop."""
    a, b = _titles(6, 60), _titles(7, 60) + _titles(6, 15)
    ledger = spark.createDataFrame(list(enumerate(a)), "row_id long, title string")
    notes = spark.createDataFrame([(i, t, f"p/{(i * 7) % 75:03}") for i, t in enumerate(b)], "note_id long, title string, path string")
    got = linkage.link_best(ledger, notes, threshold, ratio)
    assert "NestedLoop" not in got._jdf.queryExecution().toString()
    pairs = ledger.crossJoin(notes.withColumnRenamed("title", "theirs"))
    score = textnorm.title_score(textnorm.norm_title(F.col("title")), textnorm.norm_title(F.col("theirs")), ratio)
    scored = pairs.select("row_id", "note_id", "path", F.round(score, 9).alias("score")).where(F.col("score") >= threshold - 1e-9).collect()
    best = {}
    for r in sorted(scored, key=lambda r: (-r.score, r.path)):
        best.setdefault(r.row_id, (r.note_id, r.score))
    assert {r.row_id: (r.note_id, r.score) for r in got.collect() if r.note_id is not None} == best


def test_held_titles_with_a_common_beginning(spark):
    """Titles that share forty characters, short and empty needles, and a needle whose every gram is common."""
    rnd = random.Random(9)
    start = "an empirical study of large scale train "
    hay = [start + "".join(rnd.choice("abcdefgh ") for _ in range(rnd.randint(0, 12))) for _ in range(150)] + ["", "ab", "study of"]
    needles = [start, start[:20], "study of large", "le train abc", "ab", "b", "", "zz"] + [h[rnd.randint(0, 40) :] for h in hay[:40]]
    got = {(r.hay, r.needle) for r in linkage.holding(spark.createDataFrame([(x,) for x in hay], "h string"), spark.createDataFrame([(x,) for x in needles], "n string")).collect()}
    assert got == {(h, n) for h in hay for n in needles if h and n and n in h}


def test_exploded_rows_are_not_sent_to_the_driver(spark):
    """Sides made of each title's grams were broadcast by the size of the rows that they came from."""
    a = spark.createDataFrame([("one long title",), ("another title",)], "text string")
    plan = linkage.holding(a, a)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "BroadcastExchange" not in plan


def test_texts_that_look_alike_in_a_piece_alone_do_not_go_on(spark):
    """Titles of the same common phrases met by them in pairs; now only those whose marks the edits allow reach the texts."""
    rnd = random.Random(7)
    words = ["representation", "transformer", "benchmarking", "segmentation", "optimisation", "generalised"]
    titles = sorted({" ".join(rnd.choice(words) for _ in range(6)) + f" {rnd.randrange(10**9)}" for _ in range(40)})
    got = {tuple(r) for r in similarity.near_texts(_frame(spark, titles), _frame(spark, titles), 0.92).collect()}
    assert got == {(i, j) for i, x in enumerate(titles) for j, y in enumerate(titles) if _distance(x, y) <= int(max(len(x), len(y)) * 0.08 + 1e-9)}
    marks = {r.text: (r.m0, r.m64) for r in _frame(spark, titles).select("text", *similarity._mark(F.col("text"))).collect()}
    unlike = lambda x, y: sum(((p ^ q) & (2**64 - 1)).bit_count() for p, q in zip(marks[x], marks[y], strict=True))
    assert all(unlike(x, y) <= 4 * _distance(x, y) for x in titles[:40] for y in titles[:40])
    far = [unlike(x, y) > 4 * int(max(len(x), len(y)) * 0.08) for x in titles for y in titles if x != y]
    assert sum(far) > 0.5 * len(far)


def test_marks_count_repeated_pairs(spark):
    """Texts made of few syllables share most pairs of characters but not how often: bits by odd and even numbers of a pair let nearly all of them meet."""
    rnd = random.Random(13)
    titles = sorted({f"item {i} " + "".join(rnd.choice(["the", "an", "en", "er", " th", "in ", "on"]) for _ in range(22)) for i in range(60)})
    rows = similarity.marked(_frame(spark, titles)).collect()
    marks = {r.text: tuple(r[2:]) for r in rows}
    assert len(marks) == len(titles) and all(len(m) * 64 == similarity._BITS for m in marks.values())
    unlike = lambda x, y: sum(((p ^ q) & (2**64 - 1)).bit_count() for p, q in zip(marks[x], marks[y], strict=True))
    assert all(unlike(x, y) <= 4 * _distance(x, y) for x in titles[:25] for y in titles[:25])
    far = [unlike(x, y) > 4 * int(max(len(x), len(y)) * 0.1) for x in titles for y in titles if x != y]
    assert sum(far) > 0.8 * len(far)
    some = similarity.edit_distances(similarity.marked(_frame(spark, titles)), _frame(spark, titles), 0.8)
    assert {(r.a, r.b) for r in some.collect()} == {(r.a, r.b) for r in similarity.near_texts(_frame(spark, titles), _frame(spark, titles), 0.8).collect()}


def test_held_texts_of_all_lengths_are_found(spark):
    rnd = random.Random(8)
    hay = sorted({"".join(rnd.choice("ab ") for _ in range(rnd.randint(1, 40))).strip() for _ in range(60)} - {""})
    needles = sorted({h[i : i + n] for h in hay for n in (1, 5, 6, 7, 12, 13, 14, 25) for i in (0, 3) if len(h) >= i + n} | {"c", "é" * 13, "ab" * 9})
    got = [tuple(r) for r in linkage.held_texts(_frame(spark, hay), _frame(spark, needles)).select("hay", "needle").collect()]
    assert sorted(got) == sorted((i, j) for i, h in enumerate(hay) for j, n in enumerate(needles) if n in h)
    both = [tuple(r) for r in linkage._held_either_way(_frame(spark, hay), _frame(spark, needles)).collect()]
    assert sorted(both) == sorted((i, j) for i, h in enumerate(hay) for j, n in enumerate(needles) if n in h or h in n)


def test_edit_distances_are_those_of_the_pairs(spark):
    """Scores are made of the distances that tell pairs near; before, the whole distance was computed again, twice a pair."""
    a, b = _titles(11, 60) + ["", "Zoë zoë"], _titles(12, 40) + _titles(11, 20) + ["", "Zoé zoë"]
    got = {(r.a, r.b): (r.ta, r.tb, r.edits) for r in similarity.edit_distances(_frame(spark, a), _frame(spark, b), 0.78).collect()}
    near = [(i, j, _distance(x, y)) for i, x in enumerate(a) for j, y in enumerate(b) if x and y]
    assert got == {(i, j): (a[i], b[j], d) for i, j, d in near if d <= int(max(len(a[i]), len(b[j])) * 0.22 + 1e-9)} and got


def test_of_near_copies_the_nearest_meet(spark, monkeypatch):
    """All copies of a title with other numbers met at the score of a held title; now a row whose copy is an edit away goes no further."""
    copies = [(n, f"Item {n}: one long head that many of the notes have in common") for n in range(100, 180)] + [(7, "Item 107: one long head that many of the notes have in common, held")]
    asked = [(n, t[:3] + t[4:]) for n, t in copies] + [(1000, "Other: one long head that many of the notes have in common"), (1001, "nothing like it")]
    steps = []
    scored = linkage._scored
    monkeypatch.setattr(linkage, "_scored", lambda a, b, least, ratio: (steps.append((least, a.count())), scored(a, b, least, ratio))[1])
    notes = spark.createDataFrame([(n, t, f"{n:04}.md") for n, t in copies], "note_id long, title string, path string")
    got = {r.row_id: (r.note_id, r.score) for r in linkage.link_best(spark.createDataFrame(asked, "row_id long, title string"), notes, 0.78).collect()}
    norm = lambda t: " ".join("".join(c if c.isalnum() else " " for c in t.lower()).split())

    def best(title):
        ours = norm(title)
        each = [(0.92 if ours in norm(t) or norm(t) in ours else 1 - _distance(ours, norm(t)) / max(len(ours), len(norm(t))), f"{n:04}.md", n) for n, t in copies]
        score, _, n = min(((-s, p, n) for s, p, n in each if s >= 0.78), default=(None, None, None))
        return n, score and round(-score, 9)

    assert got == {n: best(t) for n, t in asked}
    assert max(open_ for least, open_ in steps if least <= 0.92) <= 2 < len(asked) == steps[0][1]
