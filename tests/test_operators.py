"""Operators whose results SQL does not express, on small made-up inputs."""

from __future__ import annotations

import random
import re

from pyspark.sql import functions as F

from quarry.functions import text, vectors
from quarry.operators import answer, context, conversations, figures, graph, ingest, search, store
import code_tree as samples
from quarry.sources import readers
from quarry.streaming import ingest as streaming


def one(spark, value, column):
    return spark.createDataFrame([(value,)], "x string").select(column).first()[0]


def test_lexical_tokens_keep_hex_versions_and_cjk(spark):
    got = one(spark, "Offset 0x4000_0100 is v1.2.3b at 16mhz, 資料手冊 the x 7", text.lexical_tokens("x"))
    assert got == ["offset", "0x4000_0100", "v1.2.3b", "16mhz", "7", "0x40000100", "資料", "手冊"]


def test_exact_literals(spark):
    assert sorted(one(spark, "0xAB_CD and 1.2 or 33", text.exact_literals("x"))) == ["0xab_cd", "0xabcd", "1.2", "33"]


def test_document_types(spark):
    assert one(spark, "my_DATASHEET_v2.pdf", text.type_by_name("x")) == "spec"
    assert one(spark, "Getting started. Step 1: how to", text.type_by_content("x")) == "guide"
    assert one(spark, "Do not open. WARNING", text.content_type("x", F.lit("doc"))) == "warning"
    assert one(spark, "警告", text.content_type("x", F.lit("diagram"))) == "diagram"


def test_code_tokens(spark):
    assert one(spark, "call parseHtml_tree for the class", text.code_tokens("x")) == ["Html", "call", "parse", "parseHtml", "parseHtml_tree", "tree"]


def test_url_names(spark):
    assert one(spark, "https://www.a.b.com:80/x/y z.html/?q=1", text.url_name("x")) == "a_b_com_80_y_z_html"
    assert one(spark, "https://a.com/", text.url_name("x")) == "a_com"


def test_cosine_of_zero_and_unequal_vectors(spark):
    df = spark.createDataFrame([([1.0, 0.0], [0.0, 0.0], [1.0])], "a array<double>, b array<double>, c array<double>")
    assert df.select(vectors.cosine(F.col("a"), F.col("b")), vectors.cosine(F.col("a"), F.col("c")), vectors.cosine(F.col("a"), F.col("a"))).first()[:] == (0.0, 0.0, 1.0)


def test_greedy_dedup_against_the_loop(spark):
    """a ~ b ~ c without a ~ c: c stays, as b goes."""
    rng = random.Random(1)
    pairs = sorted({tuple(sorted(rng.sample(range(30), 2))) for _ in range(40)} | {(0, 1), (1, 2)})
    kept = []
    for i in range(30):
        if not any((k, i) in pairs for k in kept):
            kept.append(i)
    docs = spark.range(30).withColumnRenamed("id", "doc_id")
    got = search.greedy_dedup(docs, spark.createDataFrame(pairs, "a long, b long")).collect()
    assert sorted(r[0] for r in got) == kept


def test_semantic_chunks():
    body = "# Alpha\n" + "\n".join(f"line {i} of alpha text" for i in range(30)) + "\n# Beta\n| a | b |\n|---|---|\n" + "\n".join(f"| {i} | value {i} |" for i in range(40))
    chunks = ingest.split_semantic(body, 300, 40)
    assert {s for s, _ in chunks} == {"Alpha", "Beta"}
    tables = [c for s, c in chunks if s == "Beta"]
    assert len(tables) > 1 and all("| a | b |" in c for c in tables)
    text_ = "\n".join(c for _, c in chunks)
    assert all(f"line {i} of alpha text" in text_ and f"| {i} | value {i} |" in text_ for i in range(30))
    assert ingest.split_semantic("short", 300, 40) == [("", "short")]
    assert all(len(x) <= 50 for x in ingest._cut("word. " * 40 + "y" * 130, 50))


def test_section_containment(spark):
    spans = spark.createDataFrame([(1, 0, 0), (1, 10, 1)], "k int, start long, section int")
    points = spark.createDataFrame([(1, 0), (1, 9), (1, 10), (2, 5)], "k int, start long")
    got = {(r["k"], r["start"]): r["section"] for r in ingest.contained_in(points, spans, "k").collect()}
    assert got == {(1, 0): 0, (1, 9): 0, (1, 10): 1, (2, 5): None}


def test_evidence_only_answers(spark):
    df = spark.createDataFrame([(1, "Intro here. The default limit is 42 bytes. The maximum is 7 as REF1 says. ok 3.")], "k int, text string")
    r = answer.evidence_only(df, ["k"], F.array(F.lit("1"))).first()
    assert r["answer"] == "Intro here. The maximum is 7 as REF1 says. ok 3." and r["dropped"] == 1


def test_python_symbols_and_calls(spark):
    f = samples.files(spark)
    names = {(r["path"], r["qualified_name"], r["kind"]) for r in graph.symbols(f).collect()}
    assert {("app/main.py", "Job.start", "method"), ("src/core.c", "add", "function"), ("src/core.c", "LIMIT", "macro"), ("web/view.js", "PageView", "class")} <= names
    assert not any(p == "lib/bad.py" for p, _, _ in names)
    edges = {(r["src"], r["callee"], r["dst"]): r["confidence"] for r in graph.resolve_calls(graph.symbols(f), graph.calls(f)).collect()}
    assert edges["app/main.py::step", "clean", "app/util.py::clean"] == "resolved"
    assert edges["app/main.py::Job.start", "missing", None] == "unresolved"
    assert edges["app/main.py::Job.start", "stop", "app/main.py::Job.stop"] == "heuristic"
    assert edges["lib/text.py::caller", "twice", "lib/text.py::twice"] == "resolved"  # its own file wins


def _digest(df):
    return df.select("path", F.md5(F.col("content").cast("binary")).alias("hash"))


def test_incremental_graph_equals_a_full_rebuild(spark):
    old = samples.files(spark)
    changed = dict(samples.FILES) | {"app/util.py": "def load(p):\n    return fresh()\n\n\ndef fresh():\n    return 1\n", "new.py": "def clean(x):\n    return x\n"}
    del changed["lib/text.py"]
    new = spark.createDataFrame(sorted(changed.items()), "path string, content string")
    changes = graph.changed_files(_digest(old), _digest(new))
    assert {tuple(r) for r in changes.collect()} == {("app/util.py", "changed"), ("new.py", "added"), ("lib/text.py", "deleted")}
    nodes = graph.symbols(old)
    _, edges, _ = graph.update_graph(nodes, graph.resolve_placed(nodes, graph.placed(nodes, graph.calls(old))), new, changes)
    assert sorted(map(str, edges.collect())) == sorted(map(str, graph.resolve_placed(graph.symbols(new), graph.placed(graph.symbols(new), graph.calls(new))).collect()))


def test_random_edits_resolve_in_proportion_to_the_change(spark):
    rng = random.Random(12)

    def file(k):
        own = [f"g{rng.randrange(60)}" for _ in range(rng.randrange(4))] + [f"own{k}"]
        return "".join(f"def {n}(a):\n    x.{rng.choice(['g1', 'g2', 'zz'])}(a)\n    return g{rng.randrange(70)}(a) + own{k}(a)\n\n\n" for n in dict.fromkeys(own))

    files = {f"m{k}.py": file(k) for k in range(60)}
    table = lambda x: spark.createDataFrame(sorted(x.items()), "path string, content string")
    nodes = graph.symbols(table(files))
    edges = graph.resolve_placed(nodes, graph.placed(nodes, graph.calls(table(files))))
    for step in range(3):
        new = dict(files)
        for k in rng.sample(range(60), 2):
            new[f"m{k}.py"] = file(k)
        new.pop(f"m{step}.py", None)
        new[f"n{step}.py"] = file(100 + step)
        nodes, edges, again = graph.update_graph(nodes, edges, table(new), graph.changed_files(_digest(table(files)), _digest(table(new))))
        nodes, edges, files = spark.createDataFrame(nodes.collect(), nodes.schema), spark.createDataFrame(edges.collect(), edges.schema), new
        whole = graph.symbols(table(files))
        want = graph.resolve_placed(whole, graph.placed(whole, graph.calls(table(files)))).collect()
        assert sorted(map(str, edges.collect())) == sorted(map(str, want)) and again.count() < len(want) / 2


def test_diversity_against_the_greedy_loop(spark):
    rng = random.Random(4)
    rows = [(0, f"p{rng.randrange(4)}", k, k, rng.randrange(60)) for k in range(40)]
    left, seen, want = list(rows), {}, []
    while left:
        best = min(left, key=lambda r: (-(r[4] - 12 * seen.get(r[1], 0)), r[1], r[2], r[3]))
        left.remove(best)
        seen[best[1]] = seen.get(best[1], 0) + 1
        want.append(best[2])
    got = context.diversify(spark.createDataFrame(rows, "g int, path string, start int, end int, priority int"), "g").orderBy("place").collect()
    assert [r["start"] for r in got] == want



def test_table_payloads(spark):
    schema = "columns array<struct<label:string>>, rows array<struct<row_index:int,cells:array<struct<text:string>>>>"
    df = spark.createDataFrame([([("a|b",)], [(1, [("x\ny",)])]), ([("a",)], [(2, [("x",)])])], schema).select(F.struct("*").alias("p"))
    rows = df.select(figures.valid_table(F.col("p")).alias("ok"), figures.render_table(F.col("p")).alias("md")).collect()
    assert [r["ok"] for r in rows] == [True, False] and rows[0]["md"] == "| a\\|b |\n|---|\n| x\\ny |"


def test_store_generations(spark, tmp_path):
    path = f"file://{tmp_path}/kb"
    store.publish(spark.createDataFrame([("a", 1), ("b", 2)], "source string, v int"), path)
    new = store.upsert(store.current(spark, path), spark.createDataFrame([("b", 3), ("c", 4)], "source string, v int"), "source")
    store.publish(new, path)
    assert sorted(map(tuple, store.current(spark, path).collect())) == [("a", 1), ("b", 3), ("c", 4)]
    assert sorted(r[0] for r in store.remove(new, "source", spark.createDataFrame([("a",)], "source string")).collect()) == ["b", "c"]


def test_streamed_ingest_is_idempotent(spark, tmp_path):
    source, target = f"file://{tmp_path}/in", f"file://{tmp_path}/kb"
    make = lambda rows: spark.createDataFrame(rows, "doc_id long, text string, source string").write.mode("append").parquet(source)
    make([(1, "a", "s"), (2, "b", "s")])
    streaming.ingest_documents(spark, source, target, f"file://{tmp_path}/c1").awaitTermination()
    make([(2, "changed", "s"), (3, "c", "s")])
    for _ in range(2):
        streaming.ingest_documents(spark, source, target, f"file://{tmp_path}/c1").awaitTermination()
    assert sorted((r["doc_id"], r["text"]) for r in store.current(spark, target).collect()) == [(1, "a"), (2, "changed"), (3, "c")]


def test_session_stream_equals_batch(spark, sf, tmp_path):
    events = spark.read.parquet(f"{sf}/events.parquet")
    source = f"file://{tmp_path}/events"
    events.write.parquet(source)
    streaming.session_stream(spark, source, f"file://{tmp_path}/out", f"file://{tmp_path}/c").awaitTermination()
    got = {tuple(r) for r in spark.read.parquet(f"file://{tmp_path}/out").collect()}
    assert got and got <= {tuple(r) for r in streaming.sessions(events).collect()}


def test_trimming_keeps_recent_tool_output(spark):
    rows = [(1, k, "tool" if k % 2 else "user", "y" * 300) for k in range(12)]
    got = conversations.trim(spark.createDataFrame(rows, "conv_id int, turn int, role string, text string"), "tool").collect()
    assert {r["turn"] for r in got if r["trimmed"].endswith("…")} == {1, 3}


def test_scope_globs(spark):
    paths = ["src/a.py", "build/a.py", "src/build/keep.c", "docs/x.md", "a.o"]
    df = spark.createDataFrame([(p,) for p in paths], "path string")
    got = {r[0] for r in df.where(readers.in_scope(F.col("path"), ["**/keep.c"], ["build/", "*.o"])).collect()}
    assert got == {"src/a.py", "src/build/keep.c", "docs/x.md"}
    assert re.match(readers.glob_pattern("src/**/*.py"), "src/a/b.py") and not re.match(readers.glob_pattern("src/*.py"), "src/a/b.py")


def test_binary_strings_and_magics(spark, tmp_path):
    (tmp_path / "f.bin").write_bytes(b"\x7fELF\x00\x01version 1.2\x00\x00" + "wide text".encode("utf-16le"))
    f = readers.binary_files(spark, str(tmp_path))
    assert {(r["encoding"], r["value"]) for r in readers.strings(f).collect()} == {("ascii", "version 1.2"), ("utf-16le", "wide text")}
    r = f.select(readers.magics(F.col("content")).alias("m"), readers.hex_dump(F.col("content"), 1).alias("h")).first()
    assert r["m"][0]["kind"] == "ELF" and r["h"].startswith("00000000  7f 45 4c 46 00 01") and r["h"].endswith("|.ELF..version 1.|")


def test_grep_context_and_runaway_patterns(spark):
    rows = [(1, k, x) for k, x in enumerate("a b hit d e (x+)+ g".split())]
    lines = spark.createDataFrame(rows, "k int, line_no int, line string")
    assert [r["line_no"] for r in readers.grep(lines, "hit", 1, "k").orderBy("line_no").collect()] == [1, 2, 3]
    assert [r["line_no"] for r in readers.grep(lines, "(x+)+", 0, "k").collect()] == [5]


def test_rerank_provider(spark):
    df = spark.createDataFrame([("a", "a b"), ("a", "c")], "question string, text string")
    got = search.rerank(df, lambda q, t: t.str.len().astype(float)).orderBy("text").collect()
    assert [r["rerank_score"] for r in got] == [3.0, 1.0]


def test_segments_tile_the_text():
    from quarry.operators import trimming

    rng = random.Random(6)
    for _ in range(50):
        body = "".join(rng.choice("ab\n") for _ in range(rng.randrange(200)))
        spans = trimming.split_segments(body, 30)
        assert "".join(body[a:b] for a, b in spans) == body and all(0 < b - a <= 30 for a, b in spans)


def test_section_listing_and_disagreement(spark):
    from quarry.operators import trimming

    listing = "  [ 1] .text PROGBITS 0000000000401000 001000 0001a5 00 AX\n  [ 2] .data PROGBITS 0000000000404000 003000 000010 00 WA\n"
    got = one(spark, listing, trimming.elf_sections(F.col("x")))
    assert [(r["name"], r["size"]) for r in got] == [(".text", "0001a5"), (".data", "000010")]
    schema = "a struct<columns:array<struct<label:string>>,rows:array<struct<cells:array<struct<text:string>>>>>, b struct<columns:array<struct<label:string>>,rows:array<struct<cells:array<struct<text:string>>>>>"
    table = lambda label, *cells: ([(label,)], [([(c,)],) for c in cells])
    df = spark.createDataFrame([(table("h", "x"), table("h", "x")), (table("h", "x"), table("h", "y")), (table("h", "x"), table("g", "x")), (table("h"), table("h", "x"))], schema)
    assert [r[0] for r in df.select(trimming.disagreement(F.col("a"), F.col("b"))).collect()] == ["none", "cell", "header", "shape"]


def test_greedy_matching_and_components(spark):
    from quarry.operators import layout

    pairs = spark.createDataFrame([(1, 1, 2, 0.9), (1, 1, 3, 0.8), (1, 4, 2, 0.7), (1, 4, 3, 0.6), (2, 8, 9, 0.5)], "page int, a long, b long, iou double")
    assert sorted((r["a"], r["b"]) for r in layout.one_to_one(pairs).collect()) == [(1, 2), (4, 3), (8, 9)]
    nodes = spark.createDataFrame([(1, k) for k in (1, 2, 3, 4, 5)] + [(2, 8), (2, 9)], "page int, id long")
    assert {(r["page"], r["id"]): r["part"] for r in layout.components(nodes, pairs).collect()} == {(1, 1): 1, (1, 2): 1, (1, 3): 1, (1, 4): 1, (1, 5): 5, (2, 8): 8, (2, 9): 8}


def test_knowledge_search_filters_by_source_and_drops_noise(spark):
    from quarry.plans import knowledge

    body = "the frobnicator register holds the reset value of the main clock divider in its lower bits"
    rows = [(k, f"s{k % 2}", "doc", 1, k, "", body + f" number {k}" if k < 4 else "!" * 80, [1.0, 0.1 * k]) for k in range(6)]
    chunks = spark.createDataFrame(rows, "id long, source string, type string, page int, chunk_index int, section string, content string, v array<double>")
    q = spark.createDataFrame([(1, "frobnicator reset value", [1.0, 0.0])], "query long, question string, qv array<double>")
    refs = knowledge.search_knowledge(chunks, q, source="S0")
    got = refs.collect()
    assert got and {r["source"] for r in got} == {"s0"} and all(r["id"] < 4 for r in got) and [r["ref"] for r in got] == list(range(1, len(got) + 1))
    assert "[REF1] s0" in knowledge.assemble(refs).first()["context"]
    assert knowledge.decide(q, refs.limit(0)).first()["decision"] == "plain"
