"""Operators on small hand-written rows: edge cases, ties, nulls, files and streams."""

import difflib

import pytest
from pyspark.sql import functions as F

from corpusops.functions import links, markdown, textnorm
from corpusops.operators import aggregate, audit, linkage, repair, structure, tags
from corpusops.plans.cut import cut
from corpusops.sources import files
from corpusops.streaming import refresh


def one(spark, column, **values):
    """The value of a column expression over one row of string values."""
    schema = ", ".join(f"{k} string" for k in values)
    return spark.createDataFrame([tuple(values.values())], schema).select(column().alias("x")).first()["x"]


def test_front_matter_edges(spark):
    assert not one(spark, lambda: markdown.has_front_matter(F.col("c")), c="---\na: b\nno end")
    assert one(spark, lambda: markdown.body(F.col("c")), c="---\na: b\nno end") == "---\na: b\nno end"
    assert one(spark, lambda: markdown.front_matter(F.col("c")), c="---\na: b\n---\nrest") == "a: b\n"
    assert one(spark, lambda: markdown.body(F.col("c")), c="---\n---\nrest") == "rest"
    assert one(spark, lambda: markdown.front_matter_keys(F.col("c")), c="---\n# no\na: b\n  x: y\n- z: 1\nb:\n---\n") == ["a", "b"]


def test_front_matter_fields(spark):
    text = '---\ntitle: "Q: A"\ntags:\n  - a\n- b\nlogic: |\n  one\n\n  two\ntitle: last\njunk\nempty:\n---\nbody'
    got = {r["key"]: (r["kind"], r["value"]) for r in structure.front_matter_fields(spark.createDataFrame([(1, text)], "note_id long, text string")).collect()}
    assert got == {"title": ("scalar", "last"), "tags": ("list", "a\nb"), "logic": ("block", "one\ntwo"), "empty": ("scalar", "")}


def test_fields_survive_rendering(spark):
    text = "---\ntitle: T\nzeta: z\ntags:\n  - a\n  - b\nprimary_logic: |\n  one\n  two\n---\n"
    notes = spark.createDataFrame([(1, text)], "note_id long, text string")
    fields = structure.front_matter_fields(notes)
    again = structure.front_matter_fields(repair.render_front_matter(fields).withColumnRenamed("front_matter", "text"))
    assert sorted(map(tuple, fields.collect())) == sorted(map(tuple, again.collect()))


def test_titles(spark):
    assert one(spark, lambda: textnorm.abbr_title(F.col("c")), c="[DART](http://x): A Model") == "DART：A Model"
    assert one(spark, lambda: textnorm.abbr_title(F.col("c")), c="[A] B") == "A：B"
    assert one(spark, lambda: textnorm.abbr_title(F.col("c")), c="Plain") == "Plain"
    assert one(spark, lambda: textnorm.norm_fuzzy(F.col("c")), c="A–B:  (c), Ünï") == "a b c ünï"
    assert one(spark, lambda: textnorm.norm_nfkd(F.col("c")), c="Café Ⅳ") == "cafe iv"
    assert one(spark, lambda: textnorm.slug(F.col("c"), 7), c="ab: cd ef") == "ab_cd"
    assert one(spark, lambda: textnorm.tail_of(F.col("c")), c="a: b: c") == "b: c"
    assert one(spark, lambda: textnorm.digits_of(F.col("c")), c="CVPR") == "Unknown"
    assert one(spark, lambda: textnorm.venue_of(F.col("c")), c="2024") == "" and one(spark, lambda: textnorm.year_of(F.col("c")), c="2024") == "2024"
    assert one(spark, lambda: textnorm.year_of(F.col("c")), c="none") is None


def test_nfkd_splits_marks(spark):
    assert one(spark, lambda: textnorm.norm_nfkd(F.col("c")), c=None) is None
    assert one(spark, lambda: textnorm.norm_nfkd(F.col("c")), c="é") == "e"


def test_scores(spark):
    a, b = "abcd efgh", "abce efgi"
    assert abs(one(spark, lambda: textnorm.ratio_ratcliff(F.col("a"), F.col("b")), a=a, b=b) - difflib.SequenceMatcher(None, a, b).ratio()) < 1e-12
    assert one(spark, lambda: textnorm.title_score(F.col("a"), F.col("b")), a="x y", b="x") == 0.92
    assert one(spark, lambda: textnorm.title_score(F.col("a"), F.col("b")), a="", b="x") == 0
    assert one(spark, lambda: textnorm.jaccard(textnorm.tokens(F.col("a")), textnorm.tokens(F.col("b"))), a="T2M-GPT: x y", b="x z") == 1 / 3


def test_links(spark):
    html = "<a href='/a.pdf'></a><meta name='citation_pdf_url' content='m'> http://x.org/b.pdf http://x.org/b.pdf"
    assert one(spark, lambda: links.page_links(F.col("c"), ".pdf"), c=html) == ["/a.pdf", "http://x.org/b.pdf"]
    assert one(spark, lambda: links.first_candidate(F.col("c"), ".pdf"), c="see 10.1145/123.4. end") == "https://doi.org/10.1145/123.4"
    assert one(spark, lambda: links.first_candidate(F.col("c"), ".pdf"), c="none") is None
    assert one(spark, lambda: links.absolute_url(F.col("c"), F.lit("https://h.org/p/q")), c="r.pdf") == "https://h.org/r.pdf"
    assert one(spark, lambda: links.valid_link(F.col("c")), c="123") is False and one(spark, lambda: links.valid_link(F.col("c")), c=None) is False
    assert one(spark, lambda: links.target_path(F.lit("t"), F.col("c"), F.lit("A: b")), c="X") == "t/X/unknown_A_b.pdf"


def test_markers(spark):
    modes = {m: one(spark, lambda: audit.missing_markers(F.col("c"), ["Part I"], m), c="## Part II: x") for m in ("contains", "colon", "regex")}
    assert modes == {"contains": [], "colon": ["Part I"], "regex": ["Part I"]}
    assert one(spark, lambda: audit.describe_gaps(F.col("c")), c=None) == "no_markdown"
    assert one(spark, lambda: audit.content_mismatch(F.lit("a"), F.lit("a"), F.col("c")), c="") == "empty source"


def _sides(spark, left, right):
    return (
        spark.createDataFrame(left, "row_id long, title string"),
        spark.createDataFrame(right, "note_id long, title string, path string"),
    )


def test_link_best_ties_and_exact(spark):
    left, right = _sides(spark, [(1, "deep motion model"), (2, "other"), (3, "")], [(7, "deep motion modal", "b"), (8, "deep motion modal", "A"), (9, "zzz", "c")])
    got = {r["row_id"]: r["note_id"] for r in linkage.link_best(left, right, 0.5).collect()}
    assert got == {1: 8, 2: None, 3: None}


def test_link_tiers(spark):
    left, right = _sides(spark, [(1, "A: B c"), (2, "a: b C"), (3, "X: B c"), (4, "b c"), (5, "none")], [(1, "A: B c", "p"), (2, "q", "r")])
    got = {r["row_id"]: r["tier"] for r in linkage.link_tiered(left, right).collect()}
    assert got == {1: 1, 2: 2, 3: 3, 4: 4, 5: None}


def test_link_unique(spark):
    left, right = _sides(spark, [(1, "b c"), (2, "zz")], [(1, "a b c", "p"), (2, "b c d", "q")])
    got = {r["row_id"]: r["outcome"] for r in linkage.link_unique(left, right).collect()}
    assert got == {1: "MATCHES=2", 2: "MATCHES=0"}


def test_alias_closure(spark):
    rows = [(1, "a", "b"), (2, "b", "c"), (3, "c", "d"), (4, "x", "y"), (5, "y", "x"), (6, "s", "s"), (7, "in", "y"), (8, "a", "z")]
    alias = spark.createDataFrame(rows, "ord long, alias string, canonical string")
    got = {r["alias"]: r["canonical"] for r in tags.alias_closure(alias).collect()}
    assert got == {"a": "z", "b": "d", "c": "d", "x": "x", "y": "x", "s": "s", "in": "x"}
    again = spark.createDataFrame([(i, k, v) for i, (k, v) in enumerate(got.items())], "ord long, alias string, canonical string")
    assert {r["alias"]: r["canonical"] for r in tags.alias_closure(again).collect()} == got
    assert tags.alias_closure(alias.limit(0)).count() == 0


def test_alias_rounds_follow_the_depth(spark, monkeypatch):
    """Chains, cycles with tails of all lengths, against following each; few rounds where chains are short, however many there are."""
    rounds = []
    monkeypatch.setattr(tags, "cut", lambda df: rounds.append(1) or cut(df))
    rows = [(i, f"n{i}", f"n{i + 1}") for i in range(20)] + [(100 + i, f"c{i}", f"c{(i + 1) % 7}") for i in range(7)]
    rows += [(50 - i, f"t{i}", f"t{i + 1}" if i < 11 else "c3") for i in range(12)] + [(200 + i, f"d{i}", f"d{(i * 5 + 3) % 16}") for i in range(16)]
    last = {a: (o, c) for o, a, c in rows}

    def follow(a):
        seen = []
        while a in last and a not in seen:
            seen.append(a)
            a = last[a][1]
        return a if a not in last else min(seen[seen.index(a) :], key=lambda x: last[x][0])

    frame = lambda rows: spark.createDataFrame(rows, "ord long, alias string, canonical string")
    assert {r["alias"]: r["canonical"] for r in tags.alias_closure(frame(rows)).collect()} == {a: follow(a) for a in last}
    rounds.clear()
    short = [(3 * i + k, f"s{i}.{k}", f"s{i}.{k + 1}") for i in range(2000) for k in range(3)]
    assert all(r["canonical"].endswith(".3") for r in tags.alias_closure(frame(short)).collect()) and len(rounds) <= 4


def test_canonical_tags_flags(spark):
    rows = spark.createDataFrame([(1, 0, "a"), (1, 1, "b"), (1, 2, "a"), (2, 0, "k")], "note_id long, pos int, item string")
    closure = spark.createDataFrame([("b", "a")], "alias string, canonical string")
    got = {r["note_id"]: (r["tags"], r["changed"], r["has_dup"]) for r in tags.canonical_tags(rows, closure).collect()}
    assert got == {1: (["a"], True, True), 2: (["k"], False, False)}


def test_inject_link(spark):
    url = F.lit("https://github.com/a/b")
    assert one(spark, lambda: repair.inject_link(F.col("c"), url), c="> [!abstract] S\n> - x\n") == "> [!abstract] S\n> - **Links**: [GitHub](https://github.com/a/b)\n> - x\n"
    assert one(spark, lambda: repair.inject_link(F.col("c"), url), c="none") == "none"
    same = "> [!abstract] https://github.com/a/b"
    assert one(spark, lambda: repair.inject_link(F.col("c"), url), c=same) == same


def test_abstract_and_links(spark):
    text = "Intro\nAbstract of it\n\n first line \nsecond\nABSTRACT\nthird"
    assert one(spark, lambda: markdown.extract_abstract(F.col("c")), c=text) == "first line second ABSTRACT third"
    assert one(spark, lambda: markdown.extract_abstract(F.col("c")), c="nothing") == ""
    html = """<a HREF="x/P.PDF">p</a> HTTPS://a.org/q.pdf <a href='r.html'>"""
    assert one(spark, lambda: links.page_links(F.col("c"), ".pdf"), c=html) == ["x/P.PDF", "HTTPS://a.org/q.pdf"]
    assert one(spark, lambda: links.first_candidate(F.col("c"), ".pdf"), c='<meta name="citation_pdf_url" content="u">') == "u"
    assert one(spark, lambda: links.first_candidate(F.col("c"), ".pdf"), c='<meta name="citation_doi" content="10.1/x">') == "https://doi.org/10.1/x"
    assert one(spark, lambda: links.first_candidate(F.col("c"), ".pdf"), c="see 10.1234/ab.c.") == "https://doi.org/10.1234/ab.c"


def test_rank_over_ranges(spark):
    rows = spark.range(0, 1000, 1, 7).select(F.col("id"), ((F.col("id") * 7919) % 1000).alias("v"))
    got = aggregate.global_rank(rows, F.col("v")).collect()
    assert all(r["rank"] == r["v"] + 1 for r in got)


def test_notes_from_files(spark, tmp_path):
    (tmp_path / "Cat/ICLR_2024").mkdir(parents=True)
    (tmp_path / "Cat/ICLR_2024/a.md").write_text("# é\n")
    (tmp_path / "Cat/ICLR_2024/b.md").write_bytes(b"ok \xff end")
    (tmp_path / "Cat/x.md").write_text("no")
    root = str(tmp_path)
    assert {r["path"] for r in files.read_notes(spark, root).collect()} == {"Cat/ICLR_2024/a.md", "Cat/x.md"}
    loose = {r["path"]: r["text"] for r in files.read_notes(spark, root, on_bad_utf8="ignore").collect()}
    assert loose["Cat/ICLR_2024/b.md"] == "ok  end"
    assert {r["path"] for r in files.filter_note_paths(files.read_notes(spark, root)).collect()} == {"Cat/ICLR_2024/a.md"}
    assert {(r["path"], r["ext"]) for r in files.list_files(spark, root).collect()} == {("Cat/ICLR_2024/a.md", "md"), ("Cat/ICLR_2024/b.md", "md"), ("Cat/x.md", "md")}


def test_many_files_in_rounds(spark, tmp_path, monkeypatch):
    """A file for each row, repeated and missing keys included; before, a folder for each key, moved on the driver, and one list of all files there."""
    monkeypatch.setattr(files, "FOLDER", 5)
    monkeypatch.setattr(files, "ROUND", 12)
    path, cost = f"file://{tmp_path}/notes", spark.conf.get("spark.sql.files.openCostInBytes")
    rows = spark.createDataFrame([(f"k={i // 2}", None if i == 7 else f"é {i}") for i in range(40)], "k string, v string").repartition(3)
    folders = files.write_files(rows, path)
    assert sum(n for _, n in folders) == 40 and max(n for _, n in folders) == 5 and len({f for f, _ in folders}) == len(folders) < 40
    rounds = []
    read = lambda some: (rounds.append(some), files.read_notes(spark, path, "*.txt", folders=some))[1]
    got = files.read_in_rounds(spark, folders, path, read).collect()
    assert sorted((r["path"].split("/")[-1].split(".")[0], r["text"]) for r in got) == sorted((f"k={i // 2}", "\n" if i == 7 else f"é {i}\n") for i in range(40))
    held = dict(folders)
    assert len(rounds) > 2 and all(sum(held[f] for f in some) <= 12 for some in rounds)
    assert spark.conf.get("spark.sql.files.openCostInBytes") == cost
    empty = f"file://{tmp_path}/empty"
    assert files.write_files(rows.limit(0), empty) == [] and files.read_in_rounds(spark, [], empty, lambda some: files.list_files(spark, empty, "*.txt", some)).count() == 0


def test_ledger_files(spark, tmp_path):
    (tmp_path / "l.csv").write_text('state,importance,paper_title,venue,p,q,sort,pdf_path\nWait,,"A, ""B""",V,,,S,p.pdf\n,,,,,,S2,q.pdf\nchecked,x\nWait,a,b,c,d,e,f,g,h,i\n')
    got = [tuple(r)[1:] for r in files.read_ledger_csv(spark, str(tmp_path / "l.csv")).orderBy("row_id").collect()]
    assert got[0] == ("Wait", "", 'A, "B"', "V", "", "", "S", "p.pdf") and got[2] == ("checked", "x", "", "", "", "", "", "") and got[3][-1] == "g" and len(got) == 4
    lines = spark.createDataFrame([(1, "Wait|T|V|-|x|C|d"), (2, "# no"), (3, ""), (4, "a|b")], "line_no long, value string")
    exact = files.parse_pipe(lines, "exact").collect()
    assert [r["category"] for r in exact] == ["C|d"]
    assert {r["line_no"]: r["category"] for r in files.parse_pipe(lines, "pad").collect()} == {1: "C", 4: "Misc"}
    ledger = files.read_ledger_csv(spark, str(tmp_path / "l.csv"))
    out = str(tmp_path / "out")
    assert files.write_ledger(ledger, out, changed=False) is None
    first, second = files.write_ledger(ledger, out), files.write_ledger(ledger.where("state = 'Wait'"), out)
    assert files.write_ledger(ledger.where("state = 'Wait'"), out) is None
    assert first != second and files.read_version(spark, out) == 2 and files.read_ledger(spark, out).count() == 2
    assert [r["state"] for r in files.read_ledger_csv(spark, _write(tmp_path / "s.csv", "state,a\nState,b\nWait,c\n")).orderBy("row_id").collect()] == ["State", "Wait"]


def _write(path, text):
    path.write_text(text)
    return str(path)


def test_ledger_guard(spark, tmp_path):
    """Rows in another order are the same ledger; swapped, repeated and changed ones aren't."""
    rows = [(i, *(f"{c}{i % 3}" for c in files.LEDGER)) for i in range(20)]
    frame = lambda rows: spark.createDataFrame(rows, ", ".join(["row_id long", *(f"`{c}` string" for c in files.LEDGER)])).repartition(3)
    out = str(tmp_path / "guard")
    assert files.write_ledger(frame(rows), out)
    assert files.write_ledger(frame(rows[::-1]), out) is None
    swapped = [(0, *rows[1][1:]), (1, *rows[0][1:]), *rows[2:]]
    for other in (swapped, rows + rows[:1], rows[1:], [(*rows[0][:-1], "x"), *rows[1:]]):
        assert files.write_ledger(frame(other), out) and files.write_ledger(frame(other), out) is None
    assert files.read_version(spark, out) == 5


def test_stream_refresh(spark, tmp_path):
    src, dst, ck = (str(tmp_path / x) for x in ("src", "dst", "ck"))
    (tmp_path / "src/c/V_2024").mkdir(parents=True)
    note = lambda n: (tmp_path / f"src/c/V_2024/{n}.md").write_text(f"# T{n}\n\ntext\n")
    note(1)
    refresh.refresh_notes(spark, src, dst, ck).awaitTermination()
    note(2)
    refresh.refresh_notes(spark, src, dst, ck).awaitTermination()
    got = spark.read.parquet(dst).select("batch", "path", "title").collect()
    assert sorted(map(tuple, got)) == [(0, "c/V_2024/1.md", "T1"), (1, "c/V_2024/2.md", "T2")]
    assert sorted(map(tuple, refresh.round_reports(spark, dst).collect())) == [(0, 1, 0, 0, 1), (1, 1, 0, 0, 1)]


def test_stream_reports_changed_notes_once(spark, tmp_path):
    src, dst, ck = (str(tmp_path / x) for x in ("src", "dst", "ck"))

    def deliver(day, **notes):
        (tmp_path / f"src/day{day}/c").mkdir(parents=True)
        for name, text in notes.items():
            (tmp_path / f"src/day{day}/c/{name}.md").write_text(text)
        refresh.refresh_notes(spark, src, dst, ck, delivery="day[0-9]+/").awaitTermination()

    deliver(1, a="# A\n", b="# B\n")
    deliver(2, a="# A two\n", b="# B\n", c="# C\n")
    deliver(3, a="# A two\n")
    got = sorted(map(tuple, refresh.round_reports(spark, dst).select("batch", "added", "changed", "same").collect()))
    assert got == [(0, 2, 0, 0), (1, 1, 1, 1), (2, 0, 0, 1)]
    refresh.refresh_notes(spark, src, dst, str(tmp_path / "again"), delivery="day[0-9]+/").awaitTermination()  # all of it as batch 0 again
    assert spark.read.parquet(f"{dst}/_reports/batch=0").first()["changed"] == 0


def test_stream_latest_state(spark, sf_dir, tmp_path):
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role")
    src, dst, ck = (str(tmp_path / x) for x in ("src", "dst", "ck"))
    run = lambda ck: refresh.latest_state(spark, src, "conv_id long, turn long, role string", dst, ck, "conv_id", "turn").awaitTermination()
    for part in ("turn < 2", "turn >= 2"):
        turns.where(part).coalesce(1).write.mode("append").parquet(src)
        run(ck)
    want = sorted(map(tuple, refresh.latest_rows(turns, "conv_id", "turn").select("conv_id", "turn", "role").collect()))
    state = lambda: sorted(map(tuple, refresh.read_state(spark, dst).select("conv_id", "turn", "role").collect()))
    assert state() == want
    ids = [r[0] for r in turns.select("conv_id").distinct().orderBy("conv_id").limit(10).collect()]
    few = spark.createDataFrame([(i, 1000, "late") for i in ids], "conv_id long, turn long, role string")
    few.coalesce(1).write.mode("append").parquet(src)
    run(ck)
    new = list((tmp_path / "dst/data/version=2").glob("bucket=*"))
    assert 0 < len(new) <= 10
    want = sorted([r for r in want if r[0] not in ids] + [(i, 1000, "late") for i in ids])
    assert state() == want
    # What batch 1 replaced is gone, what batch 2 replaced stays for a replay of it.
    old = refresh._manifest(spark, dst, 0)
    assert all((tmp_path / f"dst/data/version={v}/bucket={b}").exists() == (refresh._manifest(spark, dst, 1)[b] == v) for b, v in old.items())
    (tmp_path / "ck/commits/2").unlink()
    (tmp_path / "ck/commits/.2.crc").unlink(missing_ok=True)
    run(ck)
    assert state() == want


def test_scan_reads_only_what_it_needs(spark, sf_dir):
    from corpusops import views

    plan = views.ledger(spark, sf_dir).select("row_id", "state").where("row_id > 10")._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<doc_id:bigint>" in plan and "PushedFilters: [IsNotNull(doc_id), GreaterThan(doc_id,10)" in plan


def test_best_links_without_a_shared_word(spark):
    """Misspelled one-word titles, titles inside words, and a title whose four rarest words are other notes'."""
    known = ["alpha beta gamma delta", "zeta eta theta iota", "one two three four five six seven eight nine ten"]
    right = spark.createDataFrame([(i, t, f"p{i}") for i, t in enumerate([*known, "transformer", "smart", *["one two three four five six"] * 5])], "note_id long, title string, path string")
    asked = ["tranformer", "art", "one two three four five six seven eight nine zeta", "eleven"]
    left = spark.createDataFrame(list(enumerate(asked)), "row_id long, title string")
    for ratio in (textnorm.ratio_levenshtein, textnorm.ratio_ratcliff):
        got = {r["row_id"]: r["note_id"] for r in linkage.link_best(left, right, 0.78, ratio).collect()}
        assert got[0] == 3 and got[1] == 4 and got[2] is not None and got[3] is None
    assert {r["row_id"]: r["note_id"] for r in linkage.reverse_best(left, right, 0.78).collect()}[0] == 3


def test_near_titles_lose_no_pair(spark):
    """Random titles with up to five edits, against every pair."""
    import random

    rng = random.Random(3)
    base = ["item " + "".join(rng.choice("abcd e") for _ in range(rng.randint(0, 40))) for _ in range(60)]
    edited = []
    for t in base:
        for _ in range(rng.randint(0, 5)):
            i = rng.randint(0, len(t))
            t = t[:i] + rng.choice(["", "x", "ab"]) + t[i + rng.randint(0, 2) :]
        edited.append(t)
    left, right = _sides(spark, list(enumerate(edited)), [(i, t, f"p{i:03}") for i, t in enumerate(base)])
    a, b = F.col("a"), F.col("b")
    sides = linkage._normalised(left, right)
    for ratio, threshold in ((textnorm.ratio_levenshtein, 0.78), (textnorm.ratio_levenshtein, 0.6), (textnorm.ratio_ratcliff, 0.78)):
        score = F.round(textnorm.title_score(a, b, ratio), 9)
        every = sides[0].crossJoin(sides[1]).select("row_id", score.alias("score")).groupBy("row_id").agg(F.max("score").alias("best"))
        want = {r["row_id"]: r["best"] if r["best"] >= threshold else None for r in every.collect()}
        assert want == {r["row_id"]: r["score"] for r in linkage.link_best(left, right, threshold, ratio).collect()}


def test_tiers_by_containment(spark):
    left, right = _sides(spark, [(1, "X: b cde"), (2, "bcd"), (3, ""), (4, "Y: q")], [(1, "A: B cd", "q"), (2, "A: zB cdez", "p"), (3, "abcde", "r")])
    got = {r["row_id"]: (r["tier"], r["note_id"]) for r in linkage.link_tiered(left, right).collect()}
    assert got == {1: (3, 2), 2: (4, 3), 3: (None, None), 4: (None, None)}


def test_reference_titles(spark):
    refs = spark.createDataFrame([("deep motion", "DM", "Deep Motion", 1), ("deep motion for all", "DMA", "Deep Motion for All", 2), ("same", "Same", "same", 3)], "norm string, abbr string, full string, ord int")
    rows = [(1, "deep motion"), (2, "Deep Motion for"), (3, "(dm) deep motion"), (4, "same"), (5, "none")]
    got = {r["row_id"]: r["title"] for r in linkage.ref_abbr(spark.createDataFrame(rows, "row_id long, title string"), refs).collect()}
    assert got == {1: "[DM] Deep Motion", 2: "[DM] Deep Motion", 3: "(dm) deep motion", 4: "same", 5: "none"}


def test_fill_from_the_name(spark):
    row = ("1", "Cat/ICLR_2024/2024_A_b.md", None, "", None, None, None, None, None, None)
    names = ["note_id", "path", "heading", "title", "venue", "year", "category", "tags", "core_operator", "primary_logic"]
    got = repair.fill_fields(spark.createDataFrame([row], ", ".join(f"{n} string" for n in names))).first()
    assert (got["title"], got["tags"], got["primary_logic"]) == ("A b", "Cat", "[TODO]")
    assert got["actions"] == "category,venue,year,title,tags,core_operator,primary_logic"


def test_rules_of_users(spark):
    """A tenth rule needs no code; an unknown kind is an error."""
    rules = [*audit.AUDIT_RULES, ("lacks", "(?i)todo", "Part II:", "unfinished"), ("contains", "a,b", "", "lacks {}")]
    text = "# T\n\n## Part II: B\ntodo\n"
    got = one(spark, lambda: audit.audit_reasons(F.col("c"), F.lit("T"), rules), c=text)
    assert got[-2:] == ["unfinished", "lacks b"] and got[0] == "no front matter"
    with pytest.raises(ValueError):
        audit.audit_reasons(F.col("c"), F.lit("T"), [("odd", "", "", "")])
