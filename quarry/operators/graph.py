"""Code symbols and the relation graph."""

from __future__ import annotations

import ast
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quarry.config import DEFAULT
from quarry.operators.records import catalog_delta
from quarry.plans.bounded import MOST
from quarry.plans.reuse import reuse, spread
from quarry.shipping import ensure_importable

SYMBOLS = "path string, name string, kind string, qualified_name string, start_line int, end_line int, signature string, docstring string, backend string"
CALLS = "path string, line int, callee string, attribute boolean"
# Definitions that the fallback parser knows, by file suffix.
PATTERNS = {
    "js": [("function", r"^\s*(?:export\s+)?(?:async\s+)?function\s+(\w+)\s*\("), ("class", r"^\s*(?:export\s+)?class\s+(\w+)")],
    "ts": [("function", r"^\s*(?:export\s+)?(?:async\s+)?function\s+(\w+)\s*[(<]"), ("class", r"^\s*(?:export\s+)?class\s+(\w+)"), ("interface", r"^\s*(?:export\s+)?interface\s+(\w+)")],
    "go": [("function", r"^func\s+(?:\([^)]*\)\s*)?(\w+)\s*\("), ("type", r"^type\s+(\w+)\s")],
    "rs": [("function", r"^\s*(?:pub(?:\([^)]*\))?\s+)?(?:async\s+)?fn\s+(\w+)"), ("struct", r"^\s*(?:pub\s+)?struct\s+(\w+)"), ("enum", r"^\s*(?:pub\s+)?enum\s+(\w+)")],
    "c": [("function", r"^(?!\s*(?:if|for|while|switch|return|else)\b)[A-Za-z_][\w\s\*]*?\b(\w+)\s*\([^;]*\)\s*\{?\s*$"), ("struct", r"^\s*(?:typedef\s+)?struct\s+(\w+)"), ("macro", r"^\s*#\s*define\s+(\w+)")],
    "java": [("class", r"^\s*(?:public|private|protected)?\s*(?:final\s+|abstract\s+)?class\s+(\w+)"), ("function", r"^\s*(?:public|private|protected)\s+[\w<>\[\],\s]+\s(\w+)\s*\([^;]*\)\s*\{")],
}
SUFFIXES = {"js": "js", "jsx": "js", "mjs": "js", "ts": "ts", "tsx": "ts", "go": "go", "rs": "rs", "c": "c", "h": "c", "cc": "c", "cpp": "c", "hpp": "c", "java": "java", "kt": "java"}


def parse_symbols(path: str, content: str) -> list[tuple]:
    """Rows of SYMBOLS: classes, functions and first-level methods; broken Python gives none."""
    suffix = path.rsplit(".", 1)[-1].lower()
    if suffix == "py":
        try:
            tree = ast.parse(content)
        except (SyntaxError, ValueError):
            return []
        out = []
        for x in tree.body:
            if isinstance(x, (ast.FunctionDef, ast.AsyncFunctionDef)):
                out.append(_python(path, x, "function", x.name))
            elif isinstance(x, ast.ClassDef):
                out.append(_python(path, x, "class", x.name))
                out += [_python(path, m, "method", f"{x.name}.{m.name}") for m in x.body if isinstance(m, (ast.FunctionDef, ast.AsyncFunctionDef))]
        return out
    lines, out = content.split("\n"), []
    for k, line in enumerate(lines):
        for kind, pattern in PATTERNS.get(SUFFIXES.get(suffix, ""), []):
            if m := re.match(pattern, line):
                out.append((path, m[1], kind, m[1], k + 1, _brace_end(lines, k) + 1 if kind != "macro" else k + 1, line.strip(), "", "regex"))
                break
    return out


def _python(path: str, x: ast.AST, kind: str, name: str) -> tuple:
    signature = "" if kind == "class" else f"{x.name}({ast.unparse(x.args)})" + (f" -> {ast.unparse(x.returns)}" if x.returns else "")
    return path, x.name, kind, name, x.lineno, x.end_lineno, signature, (ast.get_docstring(x) or "")[:300], "ast"


def _brace_end(lines: list[str], start: int) -> int:
    """The first line from start at which the braces opened since then are closed."""
    depth, seen = 0, False
    for k in range(start, len(lines)):
        depth += lines[k].count("{") - lines[k].count("}")
        seen = seen or "{" in lines[k]
        if seen and depth <= 0:
            return k
        if not seen and k > start + 1:
            return start
    return len(lines) - 1


def parse_calls(path: str, content: str) -> list[tuple]:
    """Rows of CALLS of a Python file."""
    try:
        tree = ast.parse(content) if path.endswith(".py") else None
    except (SyntaxError, ValueError):
        tree = None
    out = []
    for x in ast.walk(tree) if tree else ():
        if isinstance(x, ast.Call):
            if isinstance(x.func, ast.Name):
                out.append((path, x.lineno, x.func.id, False))
            elif isinstance(x.func, ast.Attribute):
                out.append((path, x.lineno, x.func.attr, True))
    return sorted(out)


def _table(files: DataFrame, parse, schema: str) -> DataFrame:
    ensure_importable(files.sparkSession)
    names = [x.split()[0] for x in schema.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame([r for p, c in zip(pdf["path"], pdf["content"], strict=True) for r in parse(p, c or "")], columns=names)

    return spread(files.select("path", "content")).mapInPandas(run, schema)


def symbols(files: DataFrame) -> DataFrame:
    return _table(files, parse_symbols, SYMBOLS)


def calls(files: DataFrame) -> DataFrame:
    return _table(files, parse_calls, CALLS)


def placed(nodes: DataFrame, sites: DataFrame) -> DataFrame:
    """(src, path, line, callee, attribute): call sites with the innermost callable around their line; others are dropped."""
    callables = nodes.where(F.col("kind").isin("function", "method")).select("path", "qualified_name", "start_line", "end_line")
    around = sites.join(callables, "path").where(F.col("line").between(F.col("start_line"), F.col("end_line")))
    inner = F.min_by("qualified_name", F.struct(F.col("end_line") - F.col("start_line"), "qualified_name"))
    found = around.groupBy("path", "line", "callee").agg(inner.alias("_q"), F.bool_and("attribute").alias("attribute"))
    return found.select(F.concat_ws("::", "path", "_q").alias("src"), "path", "line", "callee", "attribute")


def resolve_placed(nodes: DataFrame, sites: DataFrame) -> DataFrame:
    """(src, dst, callee, path, line, attribute, confidence, candidates) of placed() sites, a row for each.

    A callee resolves among the definitions of its own file, else among those of all files. With one candidate dst is it;
    with several the call is ambiguous and dst null: ambiguous_targets() has a name's candidates once, however many calls
    share them. Definitions are counted by name before they meet the calls, so a common name costs a row for each call.
    """
    callables = nodes.where(F.col("kind").isin("function", "method")).select(F.col("name").alias("callee"), "path", F.concat_ws("::", "path", "qualified_name").alias("dst"))
    local = callables.groupBy("callee", "path").agg(F.countDistinct("dst").alias("_ln"), F.min("dst").alias("_ld"))
    every = local.groupBy("callee").agg(F.sum("_ln").alias("_gn"), F.min("_ld").alias("_gd"))
    j = sites.join(local, ["callee", "path"], "left").join(every, "callee", "left")
    own = F.col("_ln").isNotNull()
    n = F.when(own, F.col("_ln")).otherwise(F.coalesce("_gn", F.lit(0)))
    dst = F.when(n == 1, F.when(own, F.col("_ld")).otherwise(F.col("_gd")))
    confidence = F.when(n == 0, "unresolved").when(n > 1, "ambiguous").when(F.col("attribute"), "heuristic").otherwise("resolved")
    return j.select("src", dst.alias("dst"), "callee", "path", "line", "attribute", confidence.alias("confidence"), n.alias("candidates"))


def ambiguous_targets(nodes: DataFrame) -> DataFrame:
    """(callee, path, dst): the callables of names that are defined more than once; a call's own path goes first."""
    callables = nodes.where(F.col("kind").isin("function", "method")).select(F.col("name").alias("callee"), "path", F.concat_ws("::", "path", "qualified_name").alias("dst")).distinct()
    return callables.join(callables.groupBy("callee").count().where("count > 1").select("callee"), "callee", "left_semi")


def resolve_calls(nodes: DataFrame, sites: DataFrame) -> DataFrame:
    """Edges (src, dst, callee, path, line, confidence) of call sites (path, line, callee, attribute), ambiguous ones with every candidate.

    Where names are common this is long: resolve_placed() has a row for each call.
    """
    found = resolve_placed(nodes, placed(nodes, sites))
    targets = ambiguous_targets(nodes).select("callee", F.col("path").alias("_p"), F.col("dst").alias("_d"))
    local = targets.select("callee", F.col("_p").alias("path")).distinct().withColumn("_own", F.lit(True))
    many = found.where("confidence = 'ambiguous'").drop("dst").join(local, ["callee", "path"], "left").join(targets, "callee").where("_own IS NULL OR path = _p").withColumnRenamed("_d", "dst")
    columns = ["src", "dst", "callee", "path", "line", "confidence"]
    return found.where("confidence <> 'ambiguous'").select(*columns).unionByName(many.select(*columns))


#: Tasks that one node's edges are dealt over, and edges of a task.
SUBS, EDGES = 16, 1_000_000


def neighbors(edges: DataFrame, start: DataFrame, hops: int = 1, direction: str = "both", limit: int = DEFAULT.node_limit) -> DataFrame:
    """(seed, node, hop): nodes within hops (1 or 2) of start (seed, node), nearest first, ties by the smaller node, at most limit per seed.

    A seed whose limit is full goes no further. Of a node's neighbours only the smallest can count: as many as the limit and
    all that its seed has seen. Edges of the front's nodes alone are shuffled, once for each hop and repeated or not, a
    node's dealt over SUBS tasks that send on so many each; tasks grow in number with the edges, so none grows in memory.
    """
    out, back = edges.select(F.col("src").alias("a"), F.col("dst").alias("b")), edges.select(F.col("dst").alias("a"), F.col("src").alias("b"))
    step = (out if direction == "out" else back if direction == "in" else out.union(back)).where("b IS NOT NULL").withColumn("_s", F.pmod(F.xxhash64("b"), F.lit(SUBS)))
    spark = edges.sparkSession
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-step.count() // EDGES))
    seen = start.select("seed", "node", F.lit(0).alias("hop")).distinct()
    most = seen.groupBy("seed").count().agg(F.max("count")).first()[0] or 0
    front = seen
    for hop in range(1, min(max(hops, 1), 2) + 1):
        nodes = front.select(F.col("node").alias("a")).distinct()
        if nodes.isEmpty():
            break
        few = nodes.limit(MOST + 1).count() <= MOST
        if few:
            own = step.join(F.broadcast(nodes), "a", "left_semi").repartition(tasks, "a", "_s")
        else:
            keyed = nodes.withColumn("_s", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SUBS - 1).cast("long"))))
            own = step.repartition(tasks, "a", "_s").join(keyed.repartition(tasks, "a", "_s"), ["a", "_s"], "left_semi")
        # repeated edges share a place
        least = own.withColumn("_n", F.dense_rank().over(Window.partitionBy("a", "_s").orderBy("b"))).where(F.col("_n") <= 2 * limit + most).select("a", "_s", "b").distinct()
        near = least.select("a", "b").repartition(tasks, "a").withColumn("_n", F.row_number().over(Window.partitionBy("a").orderBy("b"))).where(F.col("_n") <= 2 * limit + most)
        new = front.join(near, front["node"] == near["a"]).select("seed", F.col("b").alias("node")).distinct().join(seen.select("seed", "node"), ["seed", "node"], "left_anti")
        have = seen.groupBy("seed").agg(F.count(F.when(F.col("hop") > 0, 1)).alias("_have"))
        room = new.join(have, "seed").withColumn("_n", F.row_number().over(Window.partitionBy("seed").orderBy("node"))).where(F.col("_n") <= limit - F.col("_have"))
        found = reuse(room.select("seed", "node", F.lit(hop).alias("hop")))
        seen = seen.union(found)
        full = seen.where("hop > 0").groupBy("seed").count().where(F.col("count") >= limit)
        front = found.join(full.select("seed"), "seed", "left_anti")
    return seen.where("hop > 0")


def paths(edges: DataFrame, pairs: DataFrame, max_hops: int = DEFAULT.max_hops, limit: int = DEFAULT.max_paths) -> DataFrame:
    """(src, dst, path, hops): the shortest cycle-free paths of pairs (src, dst), ties by the path itself, at most limit.

    Paths grow from both ends and meet in the middle, so each end goes half of max_hops; a pair that has its paths goes no
    further. src and dst differ, repeated pairs count once.
    """
    step = edges.select(F.col("src").alias("a"), F.col("dst").alias("b")).where("b IS NOT NULL").distinct()
    active = pairs.select("src", "dst").distinct().where("src <> dst")
    ahead, behind = active.withColumn("f", F.array("src")), active.withColumn("g", F.array("dst"))
    found = None
    for hops in range(1, max_hops + 1):
        if hops % 2:
            grown = ahead.join(step, F.element_at("f", -1) == F.col("a")).where(~F.array_contains("f", F.col("b")))
            ahead = reuse(grown.select("src", "dst", F.array_append("f", F.col("b")).alias("f")).where((F.element_at("f", -1) != F.col("dst")) | (F.lit(hops) == 1)))
        else:
            grown = behind.join(step, F.get("g", F.lit(0)) == F.col("b")).where(~F.array_contains("g", F.col("a")) & (F.col("a") != F.col("src")))
            behind = reuse(grown.select("src", "dst", F.concat(F.array("a"), "g").alias("g")))
        both = ahead.join(behind.withColumnsRenamed({"src": "_s", "dst": "_d"}), (F.col("src") == F.col("_s")) & (F.col("dst") == F.col("_d")) & (F.element_at("f", -1) == F.get("g", F.lit(0))))
        whole = both.select("src", "dst", F.concat("f", F.slice("g", F.lit(2), F.greatest(F.size("g") - 1, F.lit(0)))).alias("path")).where(F.size(F.array_distinct("path")) == hops + 1)
        new = whole.withColumn("hops", F.lit(hops))
        found = reuse(new if found is None else found.union(new))
        done = found.groupBy("src", "dst").count().where(F.col("count") >= limit).select("src", "dst")
        ahead, behind = (x.join(done, ["src", "dst"], "left_anti") for x in (ahead, behind))
        if hops == 1:  # paths that are whole go no further
            ahead = ahead.where(F.element_at("f", -1) != F.col("dst"))
    w = Window.partitionBy("src", "dst").orderBy("hops", F.array_join("path", " "))
    return found.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= limit).select("src", "dst", F.array_join("path", " > ").alias("path"), "hops")


def changed_files(old: DataFrame, new: DataFrame) -> DataFrame:
    """(path, change) of two snapshots (path, hash): added, deleted or changed."""
    o = old.select("path", F.col("hash").alias("o"))
    n = new.select("path", F.col("hash").alias("n"))
    return o.join(n, "path", "full_outer").withColumn("change", F.when(F.col("o").isNull(), "added").when(F.col("n").isNull(), "deleted").when(F.col("o") != F.col("n"), "changed")).where("change IS NOT NULL").select("path", "change")


def update_graph(nodes: DataFrame, edges: DataFrame, new_files: DataFrame, changes: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(nodes, edges, again) after changes (path, change) to a graph of nodes and of edges as resolve_placed() has them.

    Only added and changed files are parsed. Resolved again are their calls, and the calls of other files whose callee's
    definitions differ now: those keep their places, which their own files decide. Only definitions of names that are asked
    for meet them. again: the calls that were resolved again; edges that are neither in changed files nor of such names stay.
    """
    gone = changes.select("path").distinct()
    fresh = new_files.join(changes.where("change <> 'deleted'").select("path"), "path", "left_semi")
    fresh_nodes = reuse(symbols(fresh))
    old_nodes = nodes.join(gone, "path", "left_semi")
    n = nodes.join(gone, "path", "left_anti").unionByName(fresh_nodes)
    callables = lambda df: df.where(F.col("kind").isin("function", "method")).select("name", F.concat_ws("::", "path", "qualified_name").alias("dst"))
    moved = reuse(catalog_delta(callables(old_nodes), callables(fresh_nodes), "name", "dst").select(F.col("name").alias("callee")))
    others = edges.join(gone, "path", "left_anti").select(*edges.columns)
    asked = others.join(moved, "callee", "left_semi").select("src", "path", "line", "callee", "attribute")
    again = reuse(placed(fresh_nodes, calls(fresh)).unionByName(asked))
    known = n.join(again.select(F.col("callee").alias("name")).distinct(), "name", "left_semi").select(*n.columns)
    return n, others.join(moved, "callee", "left_anti").select(*edges.columns).unionByName(resolve_placed(known, again).select(*edges.columns)), again


# --- lookups over nodes (id, name, qualified_name, path, line) and edges (src, dst, type, target, confidence, ambiguity_group)


def is_resolved() -> Column:
    return F.col("dst").isNotNull() & F.col("ambiguity_group").isNull()


def find_nodes(nodes: DataFrame, names: DataFrame, limit: int = 20) -> DataFrame:
    """(asked, id, path, line): nodes whose name or qualified name is asked (asked), by path and line."""
    by = nodes.select("id", "path", "line", F.explode(F.array_distinct(F.array("name", "qualified_name"))).alias("asked"))
    w = Window.partitionBy("asked").orderBy("path", "line", "id")
    return by.join(names.select("asked").distinct(), "asked").withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= limit).drop("_n")


def suggest_names(nodes: DataFrame, part: str, limit: int = 5) -> DataFrame:
    """(name): distinct names that contain part, in order."""
    return nodes.where(F.contains("name", F.lit(part))).select("name").distinct().orderBy("name").limit(limit)


def named_edges(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """edges with src_name, dst_name and resolved."""
    name = lambda k: nodes.select(F.col("id").alias(k), F.col("name").alias(f"{k}_name"))
    return edges.join(name("src"), "src", "left").join(name("dst"), "dst", "left").withColumn("resolved", is_resolved())


def edges_of(edges: DataFrame, nodes: DataFrame, names: DataFrame, side: str) -> DataFrame:
    """Call edges with asked, whose side (src: callees, dst: callers) is a node of a name asked for."""
    hit = find_nodes(nodes, names, 1 << 30).select("asked", F.col("id").alias(side))
    return edges.where("type = 'calls'").join(hit, side)


def relations(edges: DataFrame, nodes: DataFrame, names: DataFrame, limit: int = 5) -> DataFrame:
    """(asked, direction, src, dst, line): edges out of a name's nodes, then edges into them, the first of both together."""
    out = edges_of(edges, nodes, names, "src").select("asked", F.lit(0).alias("_d"), "src", "dst", "line", "target")
    back = edges_of(edges, nodes, names, "dst").select("asked", F.lit(1).alias("_d"), "src", "dst", "line", "target")
    w = Window.partitionBy("asked").orderBy("_d", "src", "dst", "line", "target")
    rows = out.union(back).withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= limit)
    return rows.select("asked", F.when(F.col("_d") == 0, "out").otherwise("in").alias("direction"), "src", "dst", "line")


def file_targets(edges: DataFrame) -> DataFrame:
    """(src, targets): resolved includes and imports of each file, each once, in order."""
    return edges.where(F.col("type").isin("includes", "imports") & is_resolved()).groupBy("src").agg(F.array_sort(F.collect_set("dst")).alias("targets"))


def file_neighbors(edges: DataFrame, start: DataFrame, hops: int = 1, limit: int = DEFAULT.node_limit) -> DataFrame:
    """(seed, node, hop, truncated): files within hops over resolved includes, and whether the limit left some out."""
    step = edges.where(F.col("type").isin("includes", "imports") & is_resolved()).select("src", "dst")
    near = neighbors(step, start, hops, "both", limit + 1)
    w = Window.partitionBy("seed")
    n = near.withColumn("_n", F.row_number().over(w.orderBy("hop", "node"))).withColumn("truncated", F.count("*").over(w) > limit)
    return n.where(F.col("_n") <= limit).drop("_n")


def in_scope(edges: DataFrame, files: DataFrame) -> DataFrame:
    """Edges whose evidence (path) is a file of the scope."""
    return edges.join(files.select("path").distinct(), "path", "left_semi")


def find_file(files: DataFrame, asked: DataFrame) -> DataFrame:
    """(asked, path): files of the exact path, slashes of either kind."""
    flat = asked.select("asked", F.regexp_replace(F.regexp_replace("asked", r"\\", "/"), r"^(\./)+", "").alias("path"))
    return flat.join(files.select("path"), "path")


def resolve_includes(includes: DataFrame, files: DataFrame) -> DataFrame:
    """includes (path, raw) with target and candidates: the exact path, else every file of that name; null without any."""
    base = lambda c: F.element_at(F.split(c, "/"), -1)
    raw = includes.withColumn("raw", F.regexp_replace("raw", r"\\", "/"))
    known = files.select(F.col("path").alias("target"))
    exact = raw.join(known, raw["raw"] == known["target"]).withColumn("candidates", F.lit(1).cast("long"))
    rest = raw.join(known, raw["raw"] == known["target"], "left_anti").withColumn("_b", base("raw"))
    named = known.withColumn("_b", base("target"))
    counts = named.groupBy("_b").agg(F.count("*").alias("candidates"))
    loose = rest.join(named, "_b", "left").join(counts, "_b", "left").drop("_b").withColumn("candidates", F.coalesce("candidates", F.lit(0).cast("long")))
    return exact.unionByName(loose)


def resolve_imports(imports: DataFrame, files: DataFrame) -> DataFrame:
    """imports (path, module, level) with target: the longest prefix of the module that is a file or a package.

    A relative import of level n starts n - 1 directories above that of the importing file.
    """
    parents = F.split(F.regexp_replace("path", "/?[^/]*$", ""), "/")
    kept = F.filter(F.slice(parents, F.lit(1), F.greatest(F.size(parents) - F.col("level") + 1, F.lit(0))), lambda x: x != "")
    parts = F.filter(F.concat(F.when(F.col("level") > 0, kept).otherwise(F.array().cast("array<string>")), F.split("module", r"\.")), lambda x: x != "")
    asked = imports.withColumn("_p", parts).withColumn("_k", F.explode_outer(F.expr("IF(size(_p) > 0, sequence(1, size(_p)), NULL)")))
    head = F.array_join(F.slice("_p", F.lit(1), F.col("_k")), "/")
    tries = asked.withColumn("_t", F.explode_outer(F.array(F.struct(F.lit(0).alias("o"), F.concat(head, F.lit(".py")).alias("f")), F.struct(F.lit(1).alias("o"), F.concat(head, F.lit("/__init__.py")).alias("f")))))
    hit = tries.join(files.select(F.col("path").alias("_f")), F.col("_t.f") == F.col("_f"), "left")
    best = hit.groupBy("path", "module", "level").agg(F.max_by("_f", F.when(F.col("_f").isNotNull(), F.col("_k") * 2 - F.col("_t.o"))).alias("target"))
    return best


def assign_ids(symbols: DataFrame) -> DataFrame:
    """symbols (path, lang, kind, qualified_name, signature, line) with id: overloads told apart by signature, then by place."""
    from quarry.functions.text import node_id

    group = ["path", "lang", "kind", "qualified_name"]
    flat = F.regexp_replace(F.trim("signature"), r"\s+", " ")
    n = F.count("*").over(Window.partitionBy(*group))
    nth = F.row_number().over(Window.partitionBy(*group, "_s").orderBy("line")) - 1
    s = symbols.withColumn("_s", flat).withColumn("_n", n).withColumn("_k", nth)
    extra = F.when(F.col("_n") == 1, "").when(F.col("_k") == 0, F.concat(F.lit("sig:"), "_s")).otherwise(F.concat(F.lit("sig:"), "_s", F.lit("#"), F.col("_k").cast("string")))
    return s.withColumn("id", node_id(F.col("path"), F.col("lang"), F.col("kind"), F.col("qualified_name"), extra)).drop("_s", "_n", "_k")


# --- preprocessor conditions: chains such as '#ifdef A > #else'


def condition_literals(chain: Column) -> Column:
    """The chain as a set of 'directive+' or 'directive-': an #else or #elif turns the branch before it around."""
    parts = F.split(chain, " > ")

    def step(acc: Column, p: Column) -> Column:
        branch = p.startswith("#else") | p.startswith("#elif")
        last = F.element_at(acc, -1)
        turned = F.concat(F.regexp_replace(last, "[+-]$", ""), F.when(last.endswith("+"), "-").otherwise("+"))
        base = F.when(branch & (F.size(acc) > 0), F.array_append(F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0))), turned)).otherwise(acc)
        return F.when(p.startswith("#else"), base).otherwise(F.array_append(base, F.concat(p, F.lit("+"))))

    return F.array_distinct(F.aggregate(parts, F.array().cast("array<string>"), step))


def conditions_exclusive(left: Column, right: Column) -> Column:
    """Whether two chains are branches of one conditional: where they part, both are branches, or the longer one turns to one."""
    a, b = F.split(left, " > "), F.split(right, " > ")
    n = F.least(F.size(a), F.size(b))
    apart = F.filter(F.sequence(F.lit(0), n - 1), lambda k: F.get(a, k) != F.get(b, k))
    branch = lambda s: F.coalesce(s.startswith("#else") | s.startswith("#elif"), F.lit(False))
    first = F.get(apart, F.lit(0))
    longer = F.when(F.size(a) > n, F.get(a, n)).otherwise(F.get(b, n))
    return F.when(F.size(apart) > 0, branch(F.get(a, first)) & branch(F.get(b, first))).when(F.size(a) == F.size(b), False).otherwise(branch(longer))


def condition_relation(condition: Column, call: Column) -> Column:
    """active, exclusive or possible: whether code under condition is seen by a call under its own one."""
    outer, inner = condition_literals(condition), condition_literals(call)
    implied = (F.size(F.array_except(outer, inner)) == 0) & (F.size(F.array_except(inner, outer)) > 0)
    return F.when(condition.isNull() | condition.eqNullSafe(call), "active").when(call.isNull(), "possible").when(conditions_exclusive(condition, call), "exclusive").when(implied, "active").otherwise("possible")


def include_closure(includes: DataFrame, starts: DataFrame) -> DataFrame:
    """(seed, node, state): files that starts (seed, node, call) reach over includes (src, dst, condition).

    active: by a path of includes that the call's condition surely sees; possible: only by others; branches that exclude
    the call are not taken. Rounds go on until nothing is new.
    """
    from quarry.plans.reuse import reuse

    front = starts.select("seed", "node", "call", F.lit(True).alias("active"))
    seen = None
    while True:
        step = front.join(includes, front["node"] == includes["src"]).withColumn("_r", condition_relation(F.col("condition"), F.col("call"))).where("_r <> 'exclusive'")
        new = step.groupBy("seed", F.col("dst").alias("node"), "call").agg(F.bool_or(F.col("active") & (F.col("_r") == "active")).alias("active"))
        if seen is not None:
            known = seen.select("seed", "node", F.col("active").alias("_a"))
            new = new.join(known, ["seed", "node"], "left").where(F.col("_a").isNull() | (F.col("active") & ~F.col("_a"))).drop("_a")
        front = reuse(new)
        if front.isEmpty():
            break
        both = front.select("seed", "node", "active") if seen is None else seen.union(front.select("seed", "node", "active"))
        seen = reuse(both.groupBy("seed", "node").agg(F.bool_or("active").alias("active")))
    if seen is None:
        seen = front.select("seed", "node", "active")
    return seen.select("seed", "node", F.when(F.col("active"), "active").otherwise("possible").alias("state"))


# --- C sources

_INCLUDE = re.compile(r'\s*#\s*include\s*([<"])([^>"]+)[>"]')
_DIRECTIVE = re.compile(r"\s*#\s*(ifdef|ifndef|if|elif|else|endif)\b\s*(.*)")
_PROTOTYPE = re.compile(r"^[A-Za-z_][\w\s\*]*?\b([A-Za-z_]\w*)\s*\([^;{}]*\)\s*;\s*$")
_CALL = re.compile(r"\b([A-Za-z_]\w*)\s*\(")
# Words before a bracket that are no calls.
_NO_CALLS = {"if", "for", "while", "switch", "return", "sizeof", "defined", "do", "else", "case", "typeof", "alignof", "_Alignof"}


def relations_of_c(path: str, content: str) -> list[tuple]:
    """(path, kind, target, system, line, condition) of a C file: includes, prototypes and calls with their conditions."""
    from quarry.functions.code import strip_c_comments

    out, chain = [], []
    for k, line in enumerate(strip_c_comments(content).split("\n"), 1):
        if m := _DIRECTIVE.match(line):
            word, rest = m[1], " ".join(m[2].split())
            if word == "endif":
                while chain and chain[-1].startswith(("#else", "#elif")):
                    chain.pop()
                if chain:
                    chain.pop()
            else:
                chain.append(f"#{word} {rest}".strip())
            continue
        condition = " > ".join(chain) or None
        if m := _INCLUDE.match(line):
            out.append((path, "include", m[2], m[1] == "<", k, condition))
        elif m := _PROTOTYPE.match(line):
            if not line[:1].isspace() and not line.startswith(("return", "else", "typedef")):
                out.append((path, "prototype", m[1], False, k, condition))
        elif line[:1].isspace() or "{" in line and ";" in line:
            bare = re.sub(r'"(?:\\.|[^"\\])*"', '""', line)
            out += [(path, "call", c[1], False, k, condition) for c in _CALL.finditer(bare) if c[1] not in _NO_CALLS]
    return out


def c_relations(files: DataFrame) -> DataFrame:
    return _table(files, relations_of_c, "path string, kind string, target string, system boolean, line int, condition string")


def guard_of(path: str, content: str) -> str | None:
    """The condition of a header's include guard: its macro is named after the file and defined right away."""
    from quarry.functions.code import strip_c_comments

    if not path.lower().endswith((".h", ".hpp", ".hh", ".hxx")):
        return None
    stem = re.sub(r"[^A-Z0-9]", "", path.rsplit("/", 1)[-1].upper())
    lines = [x.strip() for x in strip_c_comments(content).split("\n")]
    for k, line in enumerate(lines):
        if m := re.fullmatch(r"#\s*ifndef\s+([A-Za-z_]\w*)", line):
            rest = [x for x in lines[k + 1 :] if x]
            if stem in re.sub(r"[^A-Z0-9]", "", m[1].upper()) and rest and re.fullmatch(rf"#\s*define\s+{m[1]}", rest[0]):
                return " ".join(line.split())
        if re.match(r"#\s*if", line):
            return None
    return None


def include_guards(files: DataFrame) -> DataFrame:
    return _table(files, lambda p, c: [(p, g)] if (g := guard_of(p, c)) else [], "path string, guard string")


C_SYMBOLS = "path string, name string, kind string, qualified_name string, start_line int, end_line int, signature string, linkage string, comment string, condition string"
_SCOPE = re.compile(r"^\s*(namespace|class|struct|union|enum(?:\s+class|\s+struct)?)\s+(?:[A-Z_]+\s+)?([A-Za-z_]\w*)?[^;{}()]*\{")
_FUNCTION = re.compile(r"^(?P<lead>[\w\s\*&:<>,~\[\]]*?)(?P<name>~?[A-Za-z_][\w:~]*)\s*\((?P<args>[^;{}]*)\)\s*(?:const|noexcept|override|final|\s)*(?::[^{;]*)?\{")
_TYPEDEF = re.compile(r"^\s*typedef\b[^;]*?\b([A-Za-z_]\w*)\s*(?:\[[^\]]*\])?;")
_GLOBAL = re.compile(r"^(?P<lead>(?:extern|static|const|volatile|unsigned|signed|struct|\w+)[\w\s\*]*?)\b(?P<name>[A-Za-z_]\w*)\s*(?:\[[^\]]*\])*\s*(?:=[^;]*)?;\s*$")
_ENUMERATOR = re.compile(r"^\s*([A-Za-z_]\w*)\s*(?:=[^,}]*)?\s*(?:,|$|\})")
_DEFINE = re.compile(r"^\s*#\s*define\s+([A-Za-z_]\w*)(\([^)]*\))?")


def linkage(lead: str, path: str, in_class: bool = False) -> str:
    """internal, external, header_inline or unknown, by the words before a definition."""
    words = set(lead.split())
    if in_class:
        return "external"
    if "static" in words:
        return "header_inline" if "inline" in words and path.lower().endswith((".h", ".hpp", ".hh", ".hxx")) else "internal"
    if "inline" in words and path.lower().endswith((".h", ".hpp", ".hh", ".hxx")):
        return "header_inline"
    return "external" if "extern" in words or not words & {"constexpr"} else "unknown"


def leading_comment(lines: list[str], k: int, most: int = 400) -> str:
    """The comment block right above line k."""
    out: list[str] = []
    k -= 1
    block = False
    while k >= 0:
        s = lines[k].strip()
        if block or s.endswith("*/"):
            out.append(s)
            block = not s.startswith("/*")
            if not block and not (k and lines[k - 1].strip().startswith("//")):
                break
        elif s.startswith("//"):
            out.append(s)
        else:
            break
        k -= 1
    return re.sub(r"\s+", " ", " ".join(re.sub(r"^(/\*+|//+|\*+)\s?|\s*\*+/$", "", x) for x in reversed(out))).strip()[:most]


def block_end(lines: list[str], k: int) -> int:
    """The last line of the indented block that line k opens: before the first later line, blanks aside, indented no deeper."""
    base = len(lines[k]) - len(lines[k].lstrip())
    last = k
    for n in range(k + 1, len(lines)):
        if lines[n].strip():
            if len(lines[n]) - len(lines[n].lstrip()) <= base:
                break
            last = n
    return last


def symbols_of_c(path: str, content: str) -> list[tuple]:
    """Rows of C_SYMBOLS: functions, methods, types, enumerators, macros, typedefs and globals of C and C++."""
    from quarry.functions.code import strip_c_comments

    raw = content.split("\n")
    lines = [re.sub(r'"(?:\\.|[^"\\])*"|\'(?:\\.|[^\'\\])*\'', '""', x) for x in strip_c_comments(content).split("\n")]
    out, scopes, chain, depth, k = [], [], [], 0, 0

    def put(name: str, kind: str, start: int, end: int, signature: str, link: str) -> None:
        inside = [s for s, _, _ in scopes if s]
        scoped = name if kind in ("macro",) or "::" in name else "::".join([*inside, name])
        out.append((path, name.split("::")[-1], kind, scoped, start + 1, end + 1, re.sub(r"\s+", " ", signature).strip(), link, leading_comment(raw, start), " > ".join(chain) or None))

    while k < len(lines):
        line = lines[k]
        if m := _DIRECTIVE.match(line):
            if m[1] == "endif":
                while chain and chain[-1].startswith(("#else", "#elif")):
                    chain.pop()
                if chain:
                    chain.pop()
            else:
                chain.append(f"#{m[1]} {' '.join(m[2].split())}".strip())
            k += 1
            continue
        if m := _DEFINE.match(line):
            end = k
            while lines[end].rstrip().endswith("\\") and end + 1 < len(lines):
                end += 1
            put(m[1], "macro", k, end, m[1] + (m[2] or ""), "unknown")
            k = end + 1
            continue
        inside = scopes[-1] if scopes else None
        if depth == (inside[1] if inside else 0):  # at the level of definitions, not inside a body
            text, end = line, k
            while "{" not in text and ";" not in text and end + 1 < len(lines) and end - k < 6 and text.strip() and not lines[end + 1].lstrip().startswith("#"):
                end += 1
                text += " " + lines[end]
            in_enum = inside is not None and inside[2].startswith("enum")
            in_class = inside is not None and inside[2] in ("class", "struct", "union")
            if in_enum:
                for part in line.split(","):
                    if (m := _ENUMERATOR.match(part)) and part.strip() not in ("", "}"):
                        outer = [s for s, _, _ in scopes[:-1] if s]
                        name = m[1]
                        own = [inside[0]] if inside[0] and inside[2] != "enum" else []
                        out.append((path, name, "enumerator", "::".join([*outer, *own, name]), k + 1, k + 1, part.strip(), "unknown", "", " > ".join(chain) or None))
            elif (m := _SCOPE.match(text)) and "(" not in text[: text.find("{")]:
                kind = re.sub(r"\s+", " ", m[1])
                close = _brace_end(lines, k)
                if kind != "namespace" and m[2]:
                    put(m[2], kind.split()[0], k, close, text[: text.find("{")], "unknown")
                depth += text.count("{") - text.count("}")
                if depth > (inside[1] if inside else 0):
                    scopes.append((m[2], depth, kind))
                elif kind.startswith("enum"):
                    for part in text[text.find("{") + 1 : text.rfind("}")].split(","):
                        if n := _ENUMERATOR.match(part.strip()):
                            own = [m[2]] if m[2] and kind != "enum" else []
                            out.append((path, n[1], "enumerator", "::".join([*[s for s, _, _ in scopes if s], *own, n[1]]), k + 1, k + 1, part.strip(), "unknown", "", " > ".join(chain) or None))
                k = end + 1
                continue
            elif (m := _FUNCTION.match(text.strip())) and m["name"].split("::")[-1] not in _NO_CALLS and (m["lead"].strip() or "::" in m["name"] or in_class):
                close = _brace_end(lines, k)
                put(m["name"], "method" if in_class or "::" in m["name"] else "function", k, close, text[: text.find("{")], linkage(m["lead"], path, in_class))
                k = close + 1
                continue
            elif m := _TYPEDEF.match(text):
                put(m[1], "typedef", k, end, text, "unknown")
            elif not in_class and "(" not in text and (m := _GLOBAL.match(text.strip())) and m["lead"].split()[0] not in ("return", "using", "typedef", "goto", "break", "case", "else", "namespace"):
                put(m["name"], "variable", k, end, text.split("=")[0].rstrip(" ;"), linkage(m["lead"], path))
        depth += line.count("{") - line.count("}")
        while scopes and depth < scopes[-1][1]:
            scopes.pop()
        k += 1
    return out


def c_symbols(files: DataFrame) -> DataFrame:
    return _table(files, symbols_of_c, C_SYMBOLS)


def context_lines(content: Column, start: Column, end: Column, most: int = 15) -> Column:
    """The first lines of a symbol, most of them, and none past its end."""
    return F.array_join(F.slice(F.split(content, "\n"), start, F.greatest(F.least(end - start + 1, F.lit(most)), F.lit(0))), "\n")


def resolve_c_calls(nodes: DataFrame, relations_: DataFrame, files: DataFrame) -> DataFrame:
    """(path, line, target, src, dst, confidence) of calls of c_relations() to functions of c_symbols(); dst is null where none is sure.

    In stages, each for what the stages before left: a definition in the same file, one in a header that is surely included,
    one whose prototype is surely included, the only external one of that name (by name alone). Several of a stage are
    ambiguous: a row each, without a dst; internal functions of other files are never candidates.
    """
    defs = nodes.where(F.col("kind").isin("function", "method")).select(F.concat_ws("::", "path", "qualified_name").alias("dst"), F.col("name").alias("target"), F.col("path").alias("dpath"), "linkage").distinct()
    calls = relations_.where("kind = 'call'").select("path", "target", "line", "condition").distinct()
    known = calls.join(defs.select("target").distinct(), "target", "left_semi")
    inc = resolve_includes(relations_.where("kind = 'include' AND NOT system").select("path", F.col("target").alias("raw"), "condition"), files).where("candidates = 1").select(F.col("path").alias("src"), F.col("target").alias("dst"), "condition")
    seen = include_closure(inc, calls.select(F.col("path").alias("seed"), F.col("path").alias("node"), F.lit(None).cast("string").alias("call")).distinct()).where("state = 'active'").select(F.col("seed").alias("path"), F.col("node").alias("visible"))
    same = known.join(defs.withColumnRenamed("dpath", "path"), ["path", "target"]).withColumn("stage", F.lit(1))
    header = known.join(seen, "path").join(defs.where("linkage = 'header_inline'"), "target").where("visible = dpath").withColumn("stage", F.lit(2))
    protos = relations_.where("kind = 'prototype'").select(F.col("path").alias("visible"), "target").distinct()
    open_ = defs.where("linkage = 'external'")
    declared = known.join(seen, "path").join(protos, ["visible", "target"]).join(open_, "target").withColumn("stage", F.lit(3))
    loose = known.join(open_, "target").withColumn("stage", F.lit(4))
    keep = ["path", "target", "line", "dst", "stage"]
    found = same.select(*keep).unionByName(header.select(*keep)).unionByName(declared.select(*keep)).unionByName(loose.select(*keep)).distinct()
    w = Window.partitionBy("path", "target", "line")
    best = found.withColumn("_s", F.min("stage").over(w)).where("stage = _s").withColumn("_n", F.count("*").over(w))
    names = F.element_at(F.array(*map(F.lit, ["exact", "resolved", "resolved", "syntactic"])), F.col("stage"))
    sure = best.select("path", "target", "line", F.when(F.col("_n") == 1, F.col("dst")).alias("dst"), F.when(F.col("_n") > 1, "ambiguous").otherwise(names).alias("confidence"), F.when(F.col("_n") > 1, F.col("dst")).alias("candidate"))
    rest = calls.join(sure.select("path", "target", "line").distinct(), ["path", "target", "line"], "left_anti").select("path", "target", "line", F.lit(None).cast("string").alias("dst"), F.lit("unresolved").alias("confidence"), F.lit(None).cast("string").alias("candidate"))
    every = sure.unionByName(rest)
    spans = nodes.where(F.col("kind").isin("function", "method")).select(F.col("path").alias("_p"), "start_line", "end_line", F.concat_ws("::", "path", "qualified_name").alias("src"))
    around = every.join(spans, (F.col("path") == F.col("_p")) & F.col("line").between(F.col("start_line"), F.col("end_line")), "left")
    inner = Window.partitionBy("path", "target", "line", "candidate").orderBy(F.col("end_line") - F.col("start_line"), "src")
    return around.withColumn("_k", F.row_number().over(inner)).where("_k = 1").select("path", "line", "target", "src", "dst", "confidence", "candidate")
