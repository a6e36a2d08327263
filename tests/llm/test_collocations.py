"""Collocations against plain counting, and the SQL."""

import re
from collections import Counter

import duckdb

from corpusops.llm import collocations, registry


def _plain(rows, least, cover=80, top=2000):
    counts, words = {}, Counter()
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    for r in rows:
        lang = r["lang"] or "und"
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (r["text"] or "").translate(lower)):
            w = re.findall(r"[^\x20\x09]+", piece)
            words[lang] += len(w)
            f = counts.setdefault(lang, Counter())
            f.update(tuple(w[i : i + n]) for n in range(1, 5) for i in range(len(w) - n + 1))
    out = []
    for lang, f in counts.items():
        found = {p: a for p, a in f.items() if len(p) > 1 and a >= least}
        held = Counter()
        for p, a in found.items():
            for n in range(2, len(p)):
                for i in range(len(p) - n + 1):
                    held[p[i : i + n]] = max(held[p[i : i + n]], a)
        kept = []
        for p, a in found.items():
            if p not in held or 100 * held[p] < cover * a:
                score, k = min((2_000_000 * a // (f[p[:k]] + f[p[k:]]), k) for k in range(1, len(p)))
                kept.append((-score, -a, " ".join(p).encode(), f[p[:k]], f[p[k:]]))
        out += [(lang, i + 1, p.decode(), -a, x, y, words[lang], -score) for i, (score, a, p, x, y) in enumerate(sorted(kept)[:top])]
    return sorted(out)


def _got(df):
    return sorted(tuple(r) for r in df.select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect())


def test_rows(docs, none):
    want = _plain([r.asDict() for r in docs.collect()], 2)
    assert _got(collocations.mine_collocations(docs, least=2)) == want and want
    assert collocations.mine_collocations(none).count() == 0


def test_table_and_top(spark, sf_dir):
    source = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = [r.asDict() for r in source.collect()]
    assert _got(collocations.mine_collocations(source, least=5, top=40)) == _plain(rows, 5, top=40)


def test_query_and_sql(spark, sf_dir):
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{sf_dir}/documents.parquet'")
    got = con.execute(registry.ORACLES["op11_collocations"])
    names = [d[0] for d in got.description]
    assert names == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert _got(registry.op11_collocations(spark, sf_dir)) == sorted(tuple(r) for r in got.fetchall())


def test_pieces_pads_and_ties(spark):
    """Phrases end with their piece, odd characters are words, a cut's ties go to the first, equal scores to the bytes."""
    text = "A b. a B,c d\x0bc d; é x é x | \x0e y \x0e y\tz. the the the the the"
    docs = spark.createDataFrame([(text, "en"), (text, "en"), (None, None), ("a b a b", None), ("a b a b", "und")], "text string, lang string")
    assert _got(collocations.mine_collocations(docs, least=2)) == _plain([r.asDict() for r in docs.collect()], 2)


def test_products_beyond_64_bits(spark):
    """Scores of counts whose products pass 64 bits."""
    row = spark.sql(f"select 9000000000000000 a, 9000000000000001 l, 9000000000000003 r, {collocations.SCALE} s")
    got = row.selectExpr("cast(a as decimal(20, 0)) * s div (cast(l as decimal(20, 0)) + cast(r as decimal(20, 0))) x").first()["x"]
    assert got == 2_000_000 * 9000000000000000 // (9000000000000001 + 9000000000000003)
