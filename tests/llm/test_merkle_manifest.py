"""The manifest against a tree built level by level in plain code."""

import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from corpusops.llm import merkle_manifest as mm


def _h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def _leaf(row):
    fields = []
    for c in ("doc_id", "source", "lang", "n_chars", "text"):
        v = row[c]
        fields.append("-" if v is None else f"{len(str(v).encode())}:{v}")
    return _h(*fields)


def _tree(leaves):
    """The root, and each leaf's siblings level by level as (left, right)."""
    level, steps, at = list(leaves), [[] for _ in leaves], list(range(len(leaves)))
    while len(level) > 1:
        for i, a in enumerate(at):
            run = a // 3 * 3
            steps[i].append(("".join(level[run:a]), "".join(level[a + 1 : run + 3])))
            at[i] = a // 3
        level = [_h(*level[j : j + 3]) for j in range(0, len(level), 3)]
    return level[0], steps


def _fold(h, steps):
    for left, right in steps:
        h = _h(left, h, right)
    return h


def _plain(rows):
    by = {}
    for r in rows:
        by.setdefault((r["source"] is not None, (r["source"] or "").encode()), []).append((r["doc_id"] is not None, r["doc_id"] or 0, _leaf(r), r))
    trees = {k: sorted(v, key=lambda x: x[:3]) for k, v in by.items()}
    names, out = sorted(trees), []
    each = {k: _tree([x[2] for x in trees[k]]) for k in names}
    root, tops = _tree([each[k][0] for k in names])
    for k, top in zip(names, tops):
        for (_, _, leaf, r), own in zip(trees[k], each[k][1]):
            steps, start = own + top, leaf
            if r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 2 == 0:
                start = _leaf(r | {"text": None if r["text"] is None else r["text"].replace("\n", "")})
            folded = _fold(start, steps)
            out.append((r["doc_id"], leaf, each[k][0], root, _h(*[a + b for a, b in steps]), folded, folded == root))
    return sorted(out, key=repr)


def _got(df):
    names = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    return sorted(((*[r[n] for n in names],) for r in df.select(*names).collect()), key=repr)


def test_rows(docs, none):
    want = _plain([r.asDict() for r in docs.collect()])
    assert _got(mm.verify_rows(docs)) == want and any(w[-1] for w in want) and not all(w[-1] for w in want)
    assert mm.verify_rows(none).count() == 0


def test_table(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    assert _got(mm.verify_rows(docs)) == _plain([r.asDict() for r in docs.collect()])


def _many(spark, sizes):
    rows = [(i, f"text\n{i}", "en", None if s == 0 else f"s{s}", 7) for s, n in enumerate(sizes) for i in range(n)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")


def test_several_layers(spark, monkeypatch):
    """Builders of nine entries, so that trees have up to three layers, and the tree over the sources two."""
    monkeypatch.setattr(mm, "LEVELS", 2)
    monkeypatch.setattr(mm, "SPAN", 9)
    docs = _many(spark, [1, 2, 3, 4, 9, 10, 27, 28, 81, 82, 100])
    assert _got(mm.verify_rows(docs)) == _plain([r.asDict() for r in docs.collect()])


def test_builders_of_729(spark):
    docs = _many(spark, [1458, 1460])
    assert _got(mm.verify_rows(docs)) == _plain([r.asDict() for r in docs.collect()])


def test_one_row(spark):
    docs = _many(spark, [1])
    (row,) = mm.verify_rows(docs).collect()
    assert row.leaf == row.subroot == row.root and row.proof_sha256 == _h("")


def _postorder(n):
    """[(level, number)] as the nodes are complete."""
    counts = [n]
    while counts[-1] > 1:
        counts.append(-(-counts[-1] // 3))
    out = []

    def visit(level, number):
        if level:
            for j in range(number * 3, min(number * 3 + 3, counts[level - 1])):
                visit(level - 1, j)
        out.append((level, number))

    visit(len(counts) - 1, 0)
    return out


@pytest.mark.parametrize("n", [1, 2, 9, 10, 28, 82, 243])
def test_positions(spark, n):
    nodes = _postorder(n)
    levels = max(x for x, _ in nodes)
    got = spark.range(1).select(F.array(*[mm.position(level, F.lit(number), F.lit(n), levels) for level, number in nodes[:: 1 + n // 30]])).first()[0]
    assert got == list(range(len(nodes)))[:: 1 + n // 30]


@pytest.mark.parametrize("small", [True, False])
def test_log(spark, monkeypatch, small):
    """The whole log holds every node once, at its place in postorder."""
    if small:
        monkeypatch.setattr(mm, "LEVELS", 2)
        monkeypatch.setattr(mm, "SPAN", 9)
    sizes = [1, 5, 28, 100, 740]
    docs = _many(spark, sizes)
    layers, _ = mm.manifest(docs)
    rows = mm.node_log(layers, 740).collect()
    for s, n in enumerate(sizes):
        mine = sorted((r["at"], r["level"], r["number"]) for r in rows if r["tree"] == ("" if s == 0 else f"ss{s}"))
        assert mine == [(at, *x) for at, x in enumerate(_postorder(n))]
