"""The mix against plain fractions, and its nearness to the targets."""

import hashlib
import math
import re
from collections import Counter
from fractions import Fraction

from pyspark.sql import functions as F

from corpusops.llm import registry, source_mix


def _targets(sizes):
    """{source: target} by resharing the excess until no target is above three times its source."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    fixed = {}
    while True:
        rest = sum(sizes.values()) - sum(fixed.values())
        open_ = [s for s in names if s not in fixed]
        level = {s: Fraction(weight[s] * rest, sum(weight[x] for x in open_)) for s in open_}
        over = {s: 3 * sizes[s] for s in open_ if level[s] > 3 * sizes[s]}
        if not over:
            return level | fixed
        fixed |= over


def _words(text):
    return len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))


def _plain(rows):
    """[(doc_id, size, source_size, target, taken)] with each boundary as a fraction."""
    docs = [(r["doc_id"], r["source"], _words(r["text"])) for r in rows]
    sizes = Counter()
    for _, s, n in docs:
        sizes[s] += n
    out = []
    for s, target in _targets(sizes).items() if docs else []:
        tie = lambda d: hashlib.md5(("-" if d[0] is None else str(d[0])).encode()).hexdigest()
        mine = sorted((d for d in docs if d[1] == s), key=lambda d: (-d[2], tie(d)))
        first = int(hashlib.md5(("~" if s is None else " " + s).encode()).hexdigest()[:4], 16)
        goal = target
        for last in (False, False, True):
            space = sum(d[2] for d in mine)
            rate = min(Fraction(3), max(Fraction(0), Fraction(target) / space)) if space else 0
            draws = []
            for j in range(16):
                u = Fraction((first + j * 4096) % 65536, 65536)
                copies = [math.floor((i + 1) * rate + u) - math.floor(i * rate + u) for i in range(len(mine))]
                draws.append((abs(sum(c * d[2] for c, d in zip(copies, mine)) - rate * space), j, copies))
            off, _, copies = min(draws) if space else (0, 0, [0] * len(mine))
            big = [last or not space or 2 * d[2] > off for d in mine]
            out += [(d[0], d[2], sizes[s], float(goal), c * d[2]) for d, c, b in zip(mine, copies, big) if b]
            target -= sum(c * d[2] for d, c, b in zip(mine, copies, big) if b)
            mine = [d for d, b in zip(mine, big) if not b]
    return sorted(out, key=repr)


def _got(plan):
    plan = plan.select("doc_id", "size", "source_size", "target", F.expr("copies * size").alias("taken"))
    return sorted((tuple(r) for r in plan.collect()), key=repr)


def test_rows(docs, none):
    assert _got(source_mix.plan_mix(docs)) == _plain([r.asDict() for r in docs.collect()])
    assert source_mix.plan_mix(none).count() == 0


def test_table(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    got = registry.op12_source_mix(spark, sf_dir)
    assert sorted((tuple(r) for r in got.select("doc_id", "size", "source_size", "target", "taken").collect()), key=repr) == _plain([r.asDict() for r in docs.collect()])


def test_excess_is_reshared_more_than_once(spark):
    sizes = {"a": 1, "b": 10, "c": 1000, "d": 2, "e": 30, "f": 500, None: 7, "empty": 0}
    rows = [(i, s, "w " * n) for i, (s, n) in enumerate(sizes.items())]
    plan = source_mix.plan_mix(spark.createDataFrame(rows, "doc_id long, source string, text string"))
    want = _targets({s: n for _, s, n in [(i, s, n) for i, (s, n) in enumerate(sizes.items())]})
    assert {r["source"]: r["target"] for r in plan.collect()} == {s: float(t) for s, t in want.items()}
    assert sum(1 for s, t in want.items() if t == 3 * sizes[s]) > 3


def test_near_target(spark):
    """Taken words come within one per cent of each target, though a few documents hold most words; no document is taken more than three times."""
    rows = [(i, f"s{i % 4}", "w " * (1 + (i * 7919) % 60 + (3000 if i % 97 == 0 else 0))) for i in range(4000)]
    plan = source_mix.plan_mix(spark.createDataFrame(rows, "doc_id long, source string, text string")).collect()
    for s in ("s0", "s1", "s2", "s3"):
        mine = [r for r in plan if r["source"] == s]
        assert abs(sum(r["copies"] * r["size"] for r in mine) - mine[0]["target"]) < 0.01 * mine[0]["target"]
    assert max(r["copies"] for r in plan) <= 3 and min(r["copies"] for r in plan) >= 0


def test_mix_emits_rows(docs, none):
    plan = source_mix.plan_mix(docs).collect()
    want = Counter()
    for r in plan:
        want[r["doc_id"]] += r["copies"]
    got = source_mix.mix(docs)
    assert got.columns == docs.columns
    assert Counter(r["doc_id"] for r in got.collect()) == Counter({k: v for k, v in want.items() if v})
    assert source_mix.mix(none).count() == 0


def test_reruns_agree(docs):
    again = [sorted((tuple(r) for r in source_mix.plan_mix(d).collect()), key=repr) for d in (docs, docs.repartition(7))]
    assert again[0] == again[1]
