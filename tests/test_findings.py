"""Cases of findings: larger tables, ties and sizes that once changed results."""

from __future__ import annotations

import random
import time

from pyspark.sql import functions as F
from pyspark.sql.classic.dataframe import DataFrame

from quarry.operators import evidence, figures, layout, payloads, search
from quarry.plans.reuse import reuse


def _symbols(spark, texts):
    rows = [(f"p{i % 3}", f"s{i}", i % 5, i % 5 + 2, s) for i, s in enumerate(texts)]
    return spark.createDataFrame(rows, "path string, symbol string, line long, end_line long, searchable string")


def test_lexical_hits_against_brute_force(spark):
    rng = random.Random(5)
    texts = ["".join(rng.choice("ab c") for _ in range(rng.randrange(9))) for _ in range(60)]
    terms = [(q, "".join(rng.choice("aBc ") for _ in range(rng.randrange(6))), rng.choice(["", "a b", "ca"])) for q in range(40) for _ in range(4)]
    got = evidence.lexical_hits(spark.createDataFrame(terms, "query long, term string, phrase string"), _symbols(spark, texts))
    want = set()
    for q in range(40):
        for i, s in enumerate(texts):
            met = [(x, p) for y, x, p in terms if y == q and x.lower() in s]
            if met:
                want.add((q, f"s{i}", len({x for x, _ in met}), any(p and p in " ".join(s.split()) for _, p in met)))
    assert {(r["query"], r["symbol"], r["hits"], r["phrase"]) for r in got.collect()} == want
    hits = spark.createDataFrame(terms, "query long, term string, phrase string")
    some = evidence.lexical_hits(hits, _symbols(spark, texts), 3)
    assert sorted(evidence.index_candidates(some, 3).collect()) == sorted(evidence.index_candidates(got, 3).collect())
    files = spark.range(40).withColumnRenamed("id", "query").crossJoin(spark.createDataFrame([("p0",), ("p1",), ("p9",)], "path string"))
    one = evidence.lexical_hits(hits, _symbols(spark, texts), 1, "path")
    assert sorted(evidence.file_candidates(files, one).collect()) == sorted(evidence.file_candidates(files, got).collect())


def test_lexical_hits_of_more_terms_than_a_broadcast_side_takes(spark):
    terms = spark.range(100_001).select(F.col("id").alias("query"), F.concat(F.lit("t"), "id").alias("term"), F.lit("").alias("phrase"))
    got = evidence.lexical_hits(terms, _symbols(spark, ["t99999 x", "none"]))
    assert got.agg(F.count("*"), F.max("query")).first()[:] == (5, 99999)


def _boxes(spark, n, side=300):
    rng = random.Random(7)
    rows = [(i % 2, i, float(rng.randrange(side)), float(rng.randrange(side))) for i in range(n)]
    return spark.createDataFrame([(p, i, x, y, x + rng.randrange(20, 250), y + rng.randrange(20, 250)) for p, i, x, y in rows], "page long, id long, x0 double, y0 double, x1 double, y1 double")


def test_boxes_meet_once_and_no_pair_below_the_threshold_is_kept(spark):
    b = _boxes(spark, 120)
    got = figures.iou_pairs(b, 0.2)
    a, c = b.alias("a"), b.alias("c")
    w = F.greatest(F.least("a.x1", "c.x1") - F.greatest("a.x0", "c.x0"), F.lit(0)) * F.greatest(F.least("a.y1", "c.y1") - F.greatest("a.y0", "c.y0"), F.lit(0))
    size = lambda t: (F.col(f"{t}.x1") - F.col(f"{t}.x0")) * (F.col(f"{t}.y1") - F.col(f"{t}.y0"))
    iou = w / (size("a") + size("c") - w)
    want = a.join(c, F.col("a.page") == F.col("c.page")).where(F.col("a.id") < F.col("c.id")).where(iou >= 0.2).select("a.page", "a.id", "c.id", F.round(iou, 6))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    assert "Aggregate" not in got._jdf.queryExecution().optimizedPlan().toString()


def test_attached_and_uncovered_boxes_meet_by_cells(spark):
    b = _boxes(spark, 60)
    for df in (layout.attach(b.where("id % 3 = 0"), b.where("id % 3 = 1"), 0.3), payloads.uncovered(b.where("id % 3 = 0"), b.where("id % 3 = 1"), 0.3)):
        assert "cx#" in df._jdf.queryExecution().optimizedPlan().toString()


def test_pairs_fall_off_with_the_rounds_of_components(spark, monkeypatch):
    left = []

    def counted(df):
        out = reuse(df)
        if df.columns == ["page", "a", "b"]:
            left.append(out.count())
        return out

    monkeypatch.setattr(layout, "reuse", counted)
    rng = random.Random(3)
    ids = list(range(60))
    rng.shuffle(ids)
    chain = list(zip(ids[:40], ids[1:40], strict=False)) + [(i, j) for i in ids[45:] for j in ids[45:] if i < j]
    pairs = spark.createDataFrame([(1, min(x), max(x)) for x in chain], "page long, a long, b long")
    nodes = spark.createDataFrame([(1, i) for i in ids], "page long, id long")
    got = {r["id"]: r["part"] for r in layout.components(nodes, pairs).collect()}
    assert got == {i: min(ids[:40]) for i in ids[:40]} | {i: i for i in ids[40:45]} | {i: min(ids[45:]) for i in ids[45:]}
    assert left[0] == len(chain) and left[-1] == 0


def test_a_long_markdown_table_is_read_in_linear_time(spark):
    n = 5000
    text = "intro\n| k | a\\|b |\n|---|:-:|\n" + "\n".join(f"| {i} | y |" if i != 7 else "| 7 |" for i in range(n))
    df = spark.createDataFrame([(1, text), (2, None), (3, "| a |\n| b | c |\n|---|"), (4, "no bar")], "id long, text string")
    began = time.monotonic()
    got = {r["id"]: r["g"] for r in df.select("id", payloads.markdown_grid("text").alias("g")).collect()}
    assert time.monotonic() - began < 60
    assert got[1]["header"] == ["k", "a|b"] and got[1]["rows"][7] == [None, None] and got[1]["rows"][n - 1] == [str(n - 1), "y"] and len(got[1]["rows"]) == n
    assert got[2] is None and got[3] is None and got[4] is None


def test_sets_that_share_too_late_a_word_are_no_candidates(spark, monkeypatch):
    found, plain = [], DataFrame.distinct

    def counted(df):
        out = plain(df)
        if out.columns == ["ka", "kb"]:
            found.append(out.count())
        return out

    monkeypatch.setattr(DataFrame, "distinct", counted)
    word = lambda c, n: [f"{c}{i}" for i in range(n)]
    sets = [word("a", 3) + ["c"] + word("f", 17), word("b", 3) + ["c"] + word("g", 17), word("x", 3) + word("f", 17), word("y", 3) + word("f", 17), word("u", 3) + word("g", 17), word("v", 3) + word("g", 17)]
    docs = spark.createDataFrame([(i, " ".join(s)) for i, s in enumerate([*sets, sets[0][:20], sets[0]])], "doc_id long, text string")
    classes, pairs = search.jaccard_classes(docs, 0.85)
    assert sorted(map(tuple, pairs.collect())) == [(0, 6, round(20 / 21, 6))]
    assert {r["rep"]: (r["copies"], r["links"]) for r in classes.collect()} == {0: (2, 2), 1: (1, 0), 2: (1, 0), 3: (1, 0), 4: (1, 0), 5: (1, 0), 6: (1, 2)}
    assert found == [1]


def test_a_vector_is_normalised_with_its_norm_worked_out_once(spark):
    from quarry.functions import vectors

    v = spark.createDataFrame([([3.0, 4.0],), ([0.0, 0.0],), (None,)], "v array<double>")
    assert [r[0] for r in v.select(vectors.normalize(F.col("v"))).collect()] == [[0.6, 0.8], [0.0, 0.0], None]
    long = spark.range(20).select(F.sum(F.element_at(vectors.normalize(F.transform(F.sequence(F.lit(1), F.lit(4000)), lambda x: (x + F.col("id")).cast("double"))), 1)))
    start = time.monotonic()
    long.collect()
    assert time.monotonic() - start < 20  # the square of 4000 places, twenty times, takes minutes


def test_alike_symbols_and_questions_meet_once(spark):
    from quarry.plans import knowledge

    s = spark.createDataFrame([(f"f{i:03}.py", "loadConfig", "function", i, "(a)", "", 0.0) for i in range(300)], "path string, name string, kind string, start_line int, signature string, docstring string, dense double")
    q = spark.createDataFrame([(i, "where is loadConfig") for i in range(50)], "query long, question string")
    assert knowledge._first_alike(s, 10).count() == 10
    got = {}
    for r in knowledge.search_symbols(s, q).collect():
        got.setdefault(r["query"], []).append(r["path"])
    assert {k: sorted(v) for k, v in got.items()} == {i: [f"f{k:03}.py" for k in range(10)] for i in range(50)}


def test_heads_of_files_are_read_by_lines_of_bytes(spark, tmp_path):
    from quarry.sources import readers

    rng = random.Random(3)
    made = {"a.bin": bytes(rng.randrange(256) for _ in range(5000)), "c.bin": b"\n", "d.bin": b"x\r\n\xff\xfe", "e.bin": b"\n" * 300, "f.bin": b"z" * 90}
    for name, content in made.items():
        (tmp_path / name).write_bytes(content)
    for size in (1, 64, 1000, 9000):
        rows = readers.heads(spark, str(tmp_path), size, "*.bin").collect()
        assert {r["path"].rsplit("/", 1)[1]: (r["length"], bytes(r["head"])) for r in rows} == {k: (len(v), v[:size]) for k, v in made.items()}
    spark.conf.set("spark.sql.files.maxPartitionBytes", "700")
    try:
        parts = readers.heads(spark, str(tmp_path), 1000, "a.bin")
        assert [bytes(r["head"]) for r in parts.collect()] == [made["a.bin"][:1000]]
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_files_that_are_too_large_are_told_without_reading(spark, tmp_path):
    from quarry.operators import scope
    from quarry.sources import readers

    (tmp_path / "small.bin").write_bytes(b"version 1.2 build")
    (tmp_path / "large.bin").write_bytes(b"version 1.3 build" * 100)
    found = scope.string_report(readers.binary_files(spark, str(tmp_path)), max_bytes=50)
    assert {(r["path"].rsplit("/", 1)[1], r["section"], r["found"]) for r in found.collect()} == {("small.bin", "build", 1), ("large.bin", "too_large", 1700)}
    assert "LessThanOrEqual(length,50)" in found._jdf.queryExecution().executedPlan().toString()


def test_edges_without_an_end_are_equal_on_both_sides(spark):
    from quarry.operators import evalm

    f = spark.createDataFrame([(1, 2), (1, None), (1, 2), (3, 4)], "src long, dst long")
    g = spark.createDataFrame([(1, None), (3, 4), (5, None)], "src long, dst long")
    found = evalm.edge_lists(f, g)
    assert sorted(map(str, (tuple(r) for r in found.select("kind", "src", "dst").collect()))) == ["('false', 1, 2)", "('missing', 5, None)"]
    assert "Join" not in found._jdf.queryExecution().executedPlan().toString()


def test_patched_files_go_to_python_in_batches(spark):
    from quarry.operators import patches

    files = spark.createDataFrame([("a", "x\nold\ny"), ("b", "old"), ("c", "other")], "file string, content string")
    p = spark.createDataFrame([(1, "+++ b/a\n@@ -2 +2 @@\n-old\n+new"), (2, "+++ b/c\n@@ -1 +1 @@\n-old\n+new"), (4, "+++ b/lost\n@@ -1 +1 @@\n-a\n+b")], "patch long, content string")
    out = patches.patched(files, patches.hunks(p))
    assert {tuple(r) for r in out.collect()} == {("a", "x\nnew\ny", True), ("b", "old", False), ("c", "other", False)}
    assert "CoGroup" not in out._jdf.queryExecution().executedPlan().toString()


def test_best_of_merged_chunks_without_a_shuffle_of_scores(spark):
    rng = random.Random(8)
    rows = [(i // 3 if i < 300 else 7, i, [rng.uniform(-1, 1) for _ in range(4)]) for i in range(2400)]
    vecs = spark.createDataFrame([*rows, (8, 9999, None), (9000, 9001, [0.0] * 4)], "merged long, id long, embedding array<double>")
    queries = vecs.where("id % 100 = 0").select(F.col("id").alias("query"), F.col("embedding").alias("qv"))
    got = search.dense_best(vecs, queries)
    assert got._jdf.queryExecution().executedPlan().toString().count("Exchange") == 1
    want = search.best_of_members(vecs.select("merged", "id"), search.dense_scores(vecs, queries, "id"))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_chunks_leave_python_as_soon_as_they_are_many(spark, monkeypatch):
    from quarry.operators import ingest

    monkeypatch.setattr(ingest, "CHARS", 2000)
    texts = {1: "# One\n" + "word " * 900, 2: None, 3: "short", 4: "line\n" * 2000}
    got = ingest.semantic_chunks(spark.createDataFrame(list(texts.items()), "doc_id long, text string"))
    assert "MapInArrow" in got._jdf.queryExecution().executedPlan().toString()  # pandas held all chunks of a batch at once
    want = [(i, k, *c) for i, s in texts.items() for k, c in enumerate(ingest.split_semantic((s or "").strip(), 1200, 200))]
    assert sorted(map(tuple, got.collect())) == sorted(want)


def test_graph_update_reads_the_texts_twice(spark, sf, monkeypatch):
    from quarry.plans import catalog

    made = []
    monkeypatch.setattr(catalog, "reuse", lambda df: made.append(df.columns) or reuse(df))
    rows = catalog.graph_update(spark, sf)
    assert made.count(["path", "content", "doc_id"]) == 2 and rows.count() > 0
    assert "documents.parquet" not in rows._jdf.queryExecution().executedPlan().toString()


def test_sets_that_share_a_rare_word_alone_never_leave_their_task(spark, monkeypatch):
    met, plain = [], DataFrame.distinct

    def counted(df):
        if df.columns == ["ka", "kb"]:
            met.append(sorted({tuple(r) for r in df.collect()}))
        return plain(df)

    monkeypatch.setattr(DataFrame, "distinct", counted)
    word = lambda c: [f"{c}{i}" for i in range(20)]
    docs = spark.createDataFrame([(i, " ".join(s)) for i, s in enumerate([[*word("f"), "c"], [*word("g"), "c"], word("f"), word("f"), word("g"), word("g")])], "doc_id long, text string")
    classes, pairs = search.jaccard_classes(docs, 0.85)
    assert sorted(map(tuple, pairs.collect())) == [(0, 2, round(20 / 21, 6)), (1, 4, round(20 / 21, 6))]
    # c is the first word of 0 and 1: they met at it before, and only their word sets told them apart
    assert sorted(map(tuple, classes.select("rep", "copies", "links").collect())) == [(0, 1, 2), (1, 1, 2), (2, 2, 2), (4, 2, 2)]
    assert met == [[(0, 2), (1, 4)]]


def test_alike_sets_against_brute_force_with_words_of_many_sets(spark, monkeypatch):
    import random

    monkeypatch.setattr(search, "SUB_SETS", 3)
    monkeypatch.setattr(search, "AT_ONCE", 64)
    rng, sets = random.Random(5), []
    for _ in range(40):
        base = rng.sample([f"w{i}" for i in range(60)], rng.randint(1, 40))
        sets += [base, base, [w for w in base if rng.random() > 0.08], [*base, "x"]]
    docs = spark.createDataFrame([(i, " ".join(s)) for i, s in enumerate(sets)], "doc_id long, text string")
    own = [frozenset(s) for s in sets]
    want = {(i, j, round(len(a & b) / len(a | b), 6)) for j, b in enumerate(own) for i, a in enumerate(own[:j]) if a and b and len(a & b) / len(a | b) >= 0.85}
    assert {tuple(r) for r in search.jaccard_pairs(docs, 0.85).collect()} == want
    kept = []
    for j in range(len(own)):
        if not any((i, j) in {w[:2] for w in want} for i in kept):
            kept.append(j)
    assert sorted(r[0] for r in search.greedy_kept(docs, 0.85).select("doc_id").collect()) == kept


def _greedy(rows, threshold):
    def iou(p, q):
        w, h = min(p[3], q[3]) - max(p[1], q[1]), min(p[4], q[4]) - max(p[2], q[2])
        o = max(w, 0) * max(h, 0)
        return o / ((p[3] - p[1]) * (p[4] - p[2]) + (q[3] - q[1]) * (q[4] - q[2]) - o) if o else 0

    pairs = sorted((-round(iou(p, q), 6), p[0], q[0]) for p in rows for q in rows if p[0] < q[0] and iou(p, q) >= threshold)
    a, b, out = set(), set(), set()
    for s, i, j in pairs:
        if i not in a and j not in b:
            a.add(i)
            b.add(j)
            out.add((i, j, -s))
    return out


def test_boxes_are_matched_by_falling_likeness_without_all_pairs(spark, monkeypatch):
    import random

    from quarry.operators import layout

    monkeypatch.setattr(layout, "AT_ONCE", 10)
    monkeypatch.setattr(layout, "PAIRS", 40)
    given, plain = [], layout.one_to_one

    def counted(pairs, key="page"):
        given.append(pairs.count())
        return plain(pairs, key)

    monkeypatch.setattr(layout, "one_to_one", counted)
    rng = random.Random(3)
    boxes = [(x := float(rng.randint(0, 60)), y := float(rng.randint(0, 60)), x + rng.randint(30, 60), y + rng.randint(30, 60)) for _ in range(40)]
    boxes += boxes[:25] + boxes[:10]
    wide = (0.0, 200.0, 1000.0, 1000200.0)  # boxes so near to each other that their likeness is rounded to 1
    boxes += [wide, wide, (*wide[:3], 1000200.25), (*wide[:3], 1000200.25), (*wide[:3], 1000199.875), (5.0, 5.0, 5.0, 9.0), (5.0, 5.0, 5.0, 9.0)]
    rng.shuffle(boxes)
    rows = [(i, *b) for i, b in enumerate(boxes)]
    frame = spark.createDataFrame([(1, *r) for r in rows] + [(2, *r) for r in rows[:7]] + [(None, *rows[0]), (None, *rows[0])], "page int, id long, x0 double, y0 double, x1 double, y1 double")
    got = layout.matching(frame, 0.1).collect()
    for page, own in ((1, rows), (2, rows[:7])):
        assert {tuple(r)[1:] for r in got if r["page"] == page} == _greedy(own, 0.1)
    assert len(got) == len(set(got)) and max(given) <= 80  # all pairs are over 1000
    same = spark.createDataFrame([(1, i, 0.0, 0.0, 9.0, 9.0) for i in range(300)], frame.schema)
    given.clear()
    assert sorted(tuple(r)[1:] for r in layout.matching(same, 0.1).collect()) == [(i, i + 1, 1.0) for i in range(299)] and sum(given) == 0


def test_the_best_part_is_found_by_hashing_once_for_equal_boxes(spark):
    from quarry.operators import layout

    schema = "page int, id long, x0 double, y0 double, x1 double, y1 double"
    others = spark.createDataFrame([(1, i, 0.0, 0.0, 10.0, 10.0) for i in range(5)] + [(1, 5, 50.0, 50.0, 60.0, 60.0), (None, 6, 0.0, 0.0, 10.0, 10.0), (1, 7, None, 0.0, 10.0, 10.0)], schema)
    low = -(2**63)
    parts = spark.createDataFrame([(1, 2**63 - 1, 0.0, 0.0, 10.0, 10.0), (1, 12, 0.0, 0.0, 20.0, 20.0), (1, 11, 0.0, 0.0, 9.0, 10.0), (1, low, 0.0, 0.0, 4.0, 10.0), (1, 13, 52.0, 50.0, 70.0, 60.0), (1, -4, 50.0, 52.0, 60.0, 70.0), (None, 9, 0.0, 0.0, 10.0, 10.0)], schema)
    got = layout.attach(others, parts, 0.3)
    assert {r["id"]: r["part"] for r in got.collect()} == {**dict.fromkeys(range(5), 12), 5: -4, 6: None, 7: None}
    assert {r["part"] for r in layout.attach(others.where("id < 5"), parts.where(f"id = {low}"), 0.3).collect()} == {low}
    assert {r["part"] for r in layout.attach(others.where("id < 5"), parts.where("id > 20"), 0.3).collect()} == {2**63 - 1}
    # sorting all pairs for the best of each box took more disk and time than finding them
    assert "SortAggregate" not in got._jdf.queryExecution().executedPlan().toString()
