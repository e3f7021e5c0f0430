"""Structured figures: payloads, their texts and parts, layout signals, scores, states and trust."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quarry.functions import boxes
from quarry.operators import figures
from quarry.operators.figures import STATES, state_rank

UNREADABLE = "▯"
PART_FLAGGED = "figure_part_flagged_elsewhere"
# States that may be evidence.
TRUSTED = ["native_verified", "corroborated", "human_verified"]
# Patterns of critical tokens, the first that fits wins: UUID, MAC, IPv4, IPv6, address range, hex, hex with
# suffix, bit range, bit, version, CJK and kana, identifier, other letters, number, punctuation.
TOKEN_BASE = [
    r"[0-9A-Fa-f]{8}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{12}",
    r"(?:[0-9A-Fa-f]{2}[:-]){5}[0-9A-Fa-f]{2}",
    r"\d{1,3}(?:\.\d{1,3}){3}(?::\d{1,5})?",
    r"(?:[0-9A-Fa-f]{0,4}:){2,7}[0-9A-Fa-f]{0,4}(?:%[0-9A-Za-z]+)?",
    r"0[xX][0-9A-Fa-f][0-9A-Fa-f_]*\s*[-–—]\s*0[xX][0-9A-Fa-f][0-9A-Fa-f_]*",
    r"0[xX][0-9A-Fa-f][0-9A-Fa-f_]*",
    r"(?<![\w$])[0-9][0-9A-Fa-f_]*[hH](?!\w)",
    r"\[\s*\d+\s*:\s*\d+\s*\]",
    r"\[\s*\d+\s*\]",
    r"\d+(?:\.\d+){1,3}(?:[-+][0-9A-Za-z.]+)?",
    "[㐀-䶿一-鿿豈-﫿぀-ヿ]+",
    r"[A-Za-z_][A-Za-z0-9_]*",
    r"[^\W\d_]+",
    r"\d+",
    r"[^\w\s]",
]
# Further patterns of terminals (escape sequences, paths), and of tables and diagrams (numbers with a unit).
TOKEN_TERMINAL = [r"\x1b\[[0-9;]*[A-Za-z]", r"(?:[A-Za-z]:)?(?:[/\\][\w.+@-]+)+[/\\]?"]
TOKEN_UNIT = [r"\d+(?:\.\d+)?\s*[munpkKMGT]?(?:Hz|bps|ms|us|ns|[VAWBs])(?![A-Za-z0-9_])"]
# What lines of terminals look like.
PROMPT = r"^\s*(?:[$#>]|PS[ >]|[A-Za-z0-9._-]+[@:][^\s]*[$#>])\s"
STAMP = r"^\s*[\[(]\s*\d+[.:]\d+"
LEVEL = r"\b(?:DEBUG|INFO|WARN|WARNING|ERROR|FATAL|TRACE|CRITICAL)\b"
ANSI = r"\x1b\[[0-9;]*[A-Za-z]"
HEXISH = r"0[xX][0-9A-Fa-f][0-9A-Fa-f_]*|\[\s*\d+\s*:\s*\d+\s*\]"
LOG_MARKS = ["$ ", "# ", "> ", ">>> ", "PS ", "root@", "C:\\", "\x1b["]
LOG_LEVELS = ["INFO", "WARN", "WARNING", "ERROR", "DEBUG", "TRACE", "FATAL", "NOTICE"]
LOG_TIME = r"\[\s*\d+\.\d+\s*\]|\d{2}:\d{2}:\d{2}|\d{4}-\d{2}-\d{2}"
LOG_PATH = r"(?:^|\s)/[\w.+-]+/[\w./+-]*"


def _c(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


# --- identity and trust


def figure_key(figure_id: str | Column, source: str | Column, page: str | Column, index: str | Column) -> Column:
    """The id of a figure, or its place where it has none."""
    f = F.coalesce(_c(figure_id), F.lit(""))
    place = F.concat_ws("|", F.lit("loc"), F.coalesce(_c(source), F.lit("")), F.coalesce(_c(page).cast("string"), F.lit("?")), F.coalesce(_c(index).cast("string"), F.lit("?")))
    return F.when(f != "", F.concat(F.lit("id|"), f)).otherwise(place)


def figure_id(document: Column, page: Column, box: list[Column], width: Column, height: Column, digest: Column) -> Column:
    """The lasting id of a figure: its document, page, box relative to the page, and pixels."""
    at = [F.round(b / s, 4).cast("decimal(12,4)").cast("string") for b, s in zip(box, (width, height, width, height), strict=True)]
    return F.concat(F.lit("fig_"), F.substring(F.sha2(F.concat_ws("|", document, page.cast("string"), F.concat_ws(",", *at), digest), 256), 1, 16))


def document_id(path: Column, content: Column) -> Column:
    return F.concat(path, F.lit("::"), F.substring(F.sha2(content.cast("binary"), 256), 1, 16))


def occurrence_key(page: Column, box: list[Column], index: Column) -> Column:
    return F.struct(F.coalesce(page, F.lit(-1)).alias("page"), *[F.round(b, 3).alias(f"b{k}") for k, b in enumerate(box)], F.coalesce(index, F.lit(0)).alias("index"))


def content_signature(words: Column, origin_x: Column, origin_y: Column) -> Column:
    """A digest of texts and their places relative to a corner, the same on whatever page they stand."""
    moved = F.array_sort(F.transform(words, lambda w: F.struct(F.round(w["y"] - origin_y, 1).alias("y"), F.round(w["x"] - origin_x, 1).alias("x"), w["text"].alias("text"))))
    return F.sha2(F.to_json(moved), 256)


def backfilled(status: str | Column, is_figure: str | Column) -> Column:
    """A figure without a state is legacy; text has none."""
    return F.when(_c(is_figure), F.coalesce(_c(status), F.lit("legacy_unverified")))


def with_trust(chunks: DataFrame, key: str) -> DataFrame:
    """chunks (status, reasons) with effective status and reasons: a part is as good as the worst part of its figure.

    A part that is worse for another's sake is marked with PART_FLAGGED.
    """
    worst = chunks.groupBy(key).agg(F.min(state_rank("status")).alias("_worst"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("reasons")))).alias("_all"))
    j = chunks.join(worst, key)
    own = state_rank("status")
    effective = F.element_at(F.array(*map(F.lit, STATES)), F.least(own, F.col("_worst")) + 1)
    union = F.array_distinct(F.concat("reasons", "_all"))
    marked = F.when(F.col("_worst") < own, F.array_distinct(F.array_append(union, F.lit(PART_FLAGGED)))).otherwise(union)
    return j.withColumn("effective", effective).withColumn("all_reasons", marked).drop("_worst", "_all")


def flagged(effective: str | Column) -> Column:
    return F.coalesce(~_c(effective).isin(TRUSTED), F.lit(False))


def capped_weight(weight: Column, structured: Column, is_flagged: Column, cap: float = 0.8) -> Column:
    """A structured figure that is not trusted weighs no more than a diagram."""
    return F.when(structured & is_flagged, F.least(weight, F.lit(cap))).otherwise(weight)


def excluded(chunks: DataFrame, key: str) -> DataFrame:
    """(key, status, reasons, parts) of flagged figures of with_trust(): one row each, the worst state and all reasons."""
    f = chunks.where(flagged("effective"))
    a = f.groupBy(key).agg(F.min(state_rank("effective")).alias("_r"), F.array_join(F.array_sort(F.array_distinct(F.flatten(F.collect_list("all_reasons")))), ",").alias("reasons"), F.count("*").alias("parts"))
    return a.select(key, F.element_at(F.array(*map(F.lit, STATES)), F.col("_r") + 1).alias("status"), "reasons", "parts")


def excluded_line(rows: DataFrame, group: str, key: str) -> DataFrame:
    """(group, line): the excluded figures of a group in one line."""
    each = F.concat(F.col(key).cast("string"), F.lit(" ("), "status", F.lit(")"))
    return rows.groupBy(group).agg(F.concat(F.count("*").cast("string"), F.lit(" excluded: "), F.array_join(F.array_sort(F.collect_list(each)), ", ")).alias("line"))


# --- payloads: columns array<struct<label>>, rows array<struct<cells array<struct<text, state>>>>, footnotes array<string>


def canonical_table(columns: Column, rows: Column) -> Column:
    """Columns named c1, c2, …, rows numbered from 1; null unless every row has a cell for each column."""
    named = F.transform(columns, lambda c, i: F.struct(F.concat(F.lit("c"), (i + 1).cast("string")).alias("column_id"), c["label"].alias("label")))
    numbered = F.transform(rows, lambda r, i: F.struct((i + 1).alias("row_index"), F.transform(r["cells"], lambda c, j: F.struct(F.concat(F.lit("c"), (j + 1).cast("string")).alias("column_id"), c["text"].alias("text"), c["state"].alias("state"))).alias("cells")))
    fits = (F.size(columns) > 0) & F.forall(rows, lambda r: F.size(r["cells"]) == F.size(columns))
    return F.when(fits, F.struct(named.alias("columns"), numbered.alias("rows")))


def canonical_terminal(lines: Column) -> Column:
    """Lines numbered from 1; null if one of them holds a line end."""
    return F.when(~F.exists(lines, lambda x: x.rlike("[\n\r]")), F.transform(lines, lambda x, i: F.struct((i + 1).alias("line_index"), x.alias("text"))))


def escape_cell(s: Column) -> Column:
    return F.replace(F.replace(F.replace(s, F.lit("\\"), F.lit("\\\\")), F.lit("|"), F.lit("\\|")), F.lit("\n"), F.lit("\\n"))


def row_line(row: Column) -> Column:
    return F.concat(F.lit("| "), F.array_join(F.transform(row["cells"], lambda c: escape_cell(c["text"])), " | "), F.lit(" |"))


def table_lines(header: Column, payload: Column, first: Column, last: Column, footnotes: Column) -> Column:
    """The text of rows first to last of a table: header line, real header, rule, rows, and footnotes with the first row."""
    head = F.concat(F.lit("| "), F.array_join(F.transform(payload["columns"], lambda c: escape_cell(c["label"])), " | "), F.lit(" |"))
    rule = F.concat(F.lit("| "), F.array_join(F.transform(payload["columns"], lambda c: F.lit("---")), " | "), F.lit(" |"))
    body = F.transform(F.slice(payload["rows"], first, last - first + 1), row_line)
    notes = F.when(first <= 1, F.transform(footnotes, lambda s, i: F.concat(F.lit("[FOOTNOTE "), (i + 1).cast("string"), F.lit("] "), s))).otherwise(F.array().cast("array<string>"))
    return F.array_join(F.concat(F.array(header, head, rule), body, notes), "\n")


def fence(lines: Column) -> Column:
    """Backticks, one more than any run in the lines, three at least."""
    runs = F.flatten(F.transform(lines, lambda s: F.transform(F.regexp_extract_all(s, F.lit("`+"), F.lit(0)), F.length)))
    return F.repeat(F.lit("`"), F.greatest(F.lit(3), F.coalesce(F.array_max(runs), F.lit(0)) + 1))


def terminal_text(header: Column, lines: Column) -> Column:
    f = fence(lines)
    return F.array_join(F.concat(F.array(header, f), lines, F.array(f)), "\n")


def parts(sizes: Column, fixed: Column, limit: int) -> Column:
    """(first, last, oversized) of the parts of a payload: atoms of these sizes packed greedily under limit.

    fixed: what each part costs besides its atoms, each of which costs a line end more. An atom is never split: one that is
    too large alone is a part of its own. Without atoms there is one empty part (0, 0).
    """
    start = F.struct(F.expr("CAST(array() AS array<struct<first:int,last:int,oversized:boolean>>)").alias("done"), F.lit(0).alias("first"), F.lit(0).cast("long").alias("used"), F.lit(0).alias("k"))

    def close(s: Column) -> Column:
        return F.array_append(s["done"], F.struct(s["first"].alias("first"), s["k"].alias("last"), (s["used"] > limit).alias("oversized")))

    def step(s: Column, n: Column) -> Column:
        fits = (s["first"] > 0) & (s["used"] + n + 1 <= limit)
        begun = F.struct(F.when(s["first"] > 0, close(s)).otherwise(s["done"]).alias("done"), (s["k"] + 1).alias("first"), (fixed + n + 1).cast("long").alias("used"), (s["k"] + 1).alias("k"))
        more = F.struct(s["done"].alias("done"), s["first"].alias("first"), (s["used"] + n + 1).cast("long").alias("used"), (s["k"] + 1).alias("k"))
        return F.when(fits, more).otherwise(begun)

    empty = F.expr("array(named_struct('first', 0, 'last', 0, 'oversized', false))")
    return F.when(F.size(sizes) == 0, empty).otherwise(F.aggregate(sizes, start, step, close))


def totals(kind: Column, rows: Column, lines: Column) -> Column:
    """(rows, lines) of a payload: the last row's number of a table, the last line's of a terminal, null for what it is not."""
    last = lambda c, name: F.when(F.size(c) > 0, F.element_at(c, -1)[name]).otherwise(0)
    return F.struct(F.when(kind == "table", last(rows, "row_index")).alias("rows"), F.when(kind == "terminal", last(lines, "line_index")).alias("lines"))


def uncertainty(rows: Column, most: int = 5) -> Column:
    """Why a table's payload cannot be trusted, the first reasons: gaps in row numbers, unreadable cells, bad states."""
    gaps = F.when(F.exists(F.transform(rows, lambda r, i: r["row_index"] != i + 1), lambda x: x), F.array(F.lit("rows: row_index has gaps"))).otherwise(F.array().cast("array<string>"))

    def cell(r: Column, c: Column) -> Column:
        where = F.concat(F.lit("row "), r["row_index"].cast("string"), F.lit(" "), c["column_id"])
        glyph = F.when(F.contains(c["text"], F.lit(UNREADABLE)), F.concat(where, F.lit(" unreadable")))
        state = F.when(c["state"].isin("unreadable", "conflict"), F.concat(where, F.lit(" state="), c["state"]))
        return F.filter(F.array(glyph, state), lambda x: x.isNotNull())

    cells = F.flatten(F.transform(rows, lambda r: F.flatten(F.transform(r["cells"], lambda c: cell(r, c)))))
    return F.slice(F.concat(gaps, cells), 1, most)


def critical_tokens(text: str | Column, kind: str) -> Column:
    """Tokens that must not change, in order, repeats kept."""
    extra = {"terminal": TOKEN_TERMINAL, "table": TOKEN_UNIT, "diagram": TOKEN_UNIT}.get(kind, [])
    return F.regexp_extract_all(_c(text), F.lit("(?U)" + "|".join(extra + TOKEN_BASE)), F.lit(0))


def masked(text: str | Column, spans: Column) -> Column:
    """text with the spans (start, end) hidden, at the same length."""
    return F.aggregate(spans, _c(text), lambda t, s: F.concat(F.substring(t, F.lit(1), s["start"]), F.repeat(F.lit(UNREADABLE), s["end"] - s["start"]), F.substring(t, s["end"] + 1, F.length(t))))


def split_row(line: Column) -> Column:
    """Cells of a Markdown row, split at bars that are not escaped."""
    inner = F.regexp_replace(F.regexp_replace(F.trim(line), r"^\|", ""), r"(?<!\\)\|$", "")
    return F.transform(F.split(inner, r"(?<!\\)\|"), lambda c: F.regexp_replace(F.trim(c), r"\\([|\\])", "$1"))


def markdown_grid(text: str | Column) -> Column:
    """(header, rows) of a Markdown table; null without a rule, or where header lines differ in width.

    Header lines above the first rule are joined by line ends; a row of another width has null cells only.
    """
    lines = F.transform(F.filter(F.split(_c(text), "\n"), lambda s: F.contains(s, F.lit("|"))), split_row)
    is_rule = lambda cells: F.forall(cells, lambda c: c.rlike("^[-:]+$"))

    def grid(numbered: Column, cut: Column, heads: Column) -> Column:
        width = F.size(F.get(heads, F.lit(0)))
        header = F.transform(F.sequence(F.lit(0), width - 1), lambda k: F.array_join(F.filter(F.transform(heads, lambda h: F.get(h, k)), lambda s: s != ""), "\n"))
        rows = F.transform(F.filter(numbered, lambda x: (x["i"] > cut) & ~x["rule"]), lambda x: F.when(F.size(x["cells"]) == width, x["cells"]).otherwise(F.array_repeat(F.lit(None).cast("string"), width)))
        fits = cut.isNotNull() & (F.size(heads) > 0) & F.forall(heads, lambda h: F.size(h) == width)
        return F.when(fits, F.struct(header.alias("header"), rows.alias("rows")))

    def below(numbered: Column, cut: Column) -> Column:
        heads = F.transform(F.filter(numbered, lambda x: x["i"] < cut), lambda x: x["cells"])
        return _once(heads, lambda h: grid(numbered, cut, h))

    def cut_of(numbered: Column) -> Column:
        cut = F.array_min(F.transform(F.filter(numbered, lambda x: x["rule"]), lambda x: x["i"]))
        return _once(cut, lambda c: below(numbered, c))

    listed = F.transform(lines, lambda cells, i: F.struct(i.alias("i"), cells.alias("cells")))
    return _once(F.transform(listed, lambda x: F.struct(x["i"].alias("i"), x["cells"].alias("cells"), is_rule(x["cells"]).alias("rule"))), cut_of)


def _once(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with value computed once, however often use reads it, also for each element of an array."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


# --- layout signals over bands (key, text, x0, x1), aggregates


def terminal_signals(bands: DataFrame, key: str) -> DataFrame:
    """(key, bands, prompts, stamps, levels, ansi, ragged, hex_rows, header_like, mono)."""
    w = Window.partitionBy(key)
    right, left = F.max("x1").over(w), F.min("x0").over(w)
    n = lambda p: F.count(F.when(p, 1))
    per = F.when((F.length("text") >= 4) & (F.col("x1") > F.col("x0")), (F.col("x1") - F.col("x0")) / F.length("text"))
    b = bands.withColumn("_r", (right - F.col("x1")) / F.greatest(F.lit(1.0), right - left)).withColumn("_p", per).withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy("ord")))
    cv = F.stddev_pop("_p") / F.avg("_p")
    return b.groupBy(key).agg(
        F.count("*").alias("bands"), n(F.col("text").rlike(PROMPT)).alias("prompts"), n(F.col("text").rlike(STAMP)).alias("stamps"), n(F.col("text").rlike(LEVEL)).alias("levels"), n(F.col("text").rlike(ANSI)).alias("ansi"),
        F.round(n(F.col("_r") > 0.05) / F.count("*"), 4).alias("ragged"), n(F.col("text").rlike(HEXISH)).alias("hex_rows"),
        ((F.count("*") >= 2) & ~F.bool_or((F.col("_n") == 1) & F.col("text").rlike(HEXISH)) & F.bool_or((F.col("_n") > 1) & F.col("text").rlike(HEXISH))).alias("header_like"),
        F.round(F.when(F.count("_p") < 2, 0.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - cv / 0.35))), 6).alias("mono"),
    )


def ruled_signals(shapes: DataFrame, key: str, many: str | None = None) -> DataFrame:
    """(key, h_lines, v_lines, others, grid, density) of shapes (x0, y0, x1, y1, how many of each): long thin ones are lines."""
    wide, high = F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")
    h = (high <= 2.5) & (wide >= 40.0)
    v = ~h & (wide <= 2.5) & (high >= 40.0)
    n = lambda p: F.sum(F.when(p, F.col(many) if many else F.lit(1).cast("long")).otherwise(0))
    return shapes.groupBy(key).agg(n(h).alias("h_lines"), n(v).alias("v_lines"), n(~h & ~v).alias("others"), ((n(h) >= 3) & (n(v) >= 2)).alias("grid"), F.round(n(~h & ~v) / n(F.lit(True)), 4).alias("density"))


def kind_scores(native: Column, grid: Column, h_lines: Column, support: Column, hex_rows: Column, header_like: Column, mono: Column, marks: Column, ragged: Column, bands: Column, raster: Column, density: Column) -> Column:
    """(table, terminal, diagram): weighted evidence for each kind, from 0 to 1."""
    one = lambda b: F.when(b, 1.0).otherwise(0.0)
    ruled = F.when(grid, 1.0).when(h_lines >= 3, 0.5).otherwise(0.0)
    table = 0.45 * one(native) + 0.20 * ruled + 0.20 * support + 0.10 * F.least(F.lit(1.0), hex_rows / 3.0) + 0.05 * one(header_like)
    terminal = 0.30 * mono + 0.30 * F.least(F.lit(1.0), marks / 3.0) + 0.20 * ragged + 0.20 * F.least(F.lit(1.0), bands / 8.0)
    diagram = 0.60 * one(raster) + 0.40 * density
    cut = lambda x: F.round(F.least(F.lit(1.0), x), 4)
    return F.struct(cut(table).alias("table"), cut(terminal).alias("terminal"), cut(diagram).alias("diagram"))


def log_like(text: str | Column) -> Column:
    """Whether a line looks like one of a log: a prompt, a mark, a time, a path or a level."""
    s = _c(text)
    bare = F.trim(F.regexp_replace(s, r"^\s+|\s+$", ""))
    marks = s.rlike("|".join(m.replace("\\", "\\\\").replace("$", "\\$").replace("[", "\\[") for m in LOG_MARKS))
    return (bare != "") & (F.substring(bare, 1, 1).isin("$", "#", ">", "%") | marks | s.rlike(LOG_TIME) | s.rlike(LOG_PATH) | s.rlike("|".join(LOG_LEVELS)))


def table_likeness(columns: Column, texts: Column) -> Column:
    """How much a payload with these labels and cell texts is like a table: columns, short cells, a header, no log lines."""
    some = F.filter(texts, lambda s: F.trim(s) != "")
    cells = F.when(F.size(some) > 0, some).otherwise(texts)
    share = lambda p: F.size(F.filter(cells, p)) / F.size(cells)
    labels = F.transform(columns, F.trim)
    multi = F.when(F.size(columns) < 2, 0.0).otherwise(F.least(F.lit(1.0), (F.size(columns) - 1) / 3.0))
    header = F.size(F.filter(labels, lambda s: s != "")) / F.size(labels) * (F.size(F.array_distinct(labels)) / F.size(labels))
    words = lambda s: F.size(F.filter(F.split(s, r"\s+"), lambda x: x != ""))
    total = multi * 3.0 + share(lambda s: words(s) <= 4) * 2.0 + share(lambda s: F.length(s) <= 40) + header + (1 - share(log_like)) * 3.0
    return F.round(F.when((F.size(columns) == 0) | (F.size(texts) == 0), 0.0).otherwise(total / 10.0), 6)


def terminal_likeness(lines: DataFrame, key: str) -> DataFrame:
    """(key, likeness) of lines (key, text): log shape, uneven lengths, indents, no bars."""
    some = F.trim("text") != ""
    n = lambda p: F.count(F.when(p, 1))
    a = lines.groupBy(key).agg(F.count("*").alias("_n"), n(some).alias("_some"), n(some & log_like("text")).alias("_log"), F.avg(F.length("text")).alias("_m"), F.stddev_pop(F.length("text")).alias("_s"), n(F.col("text").rlike(r"^\s")).alias("_lead"), n(F.length("text") - F.length(F.replace("text", F.lit("|"), F.lit(""))) >= 2).alias("_bars"))
    log = F.when(F.col("_some") > 0, F.col("_log") / F.col("_some")).otherwise(0.0)
    spread = F.when(F.col("_m") > 0, F.least(F.lit(1.0), F.col("_s") / F.col("_m"))).otherwise(0.0)
    return a.select(key, F.round((log * 4.0 + spread * 2.0 + F.col("_lead") / F.col("_n") + (1 - F.col("_bars") / F.col("_n")) * 3.0) / 10.0, 6).alias("likeness"))


def resolved_kind(table: Column, terminal: Column, margin: float = 0.15) -> Column:
    """The kind of higher likeness (a missing one lost), and whether the margin is too small to tell."""
    a, b = F.coalesce(table, F.lit(-1.0)), F.coalesce(terminal, F.lit(-1.0))
    both = table.isNotNull() & terminal.isNotNull()
    return F.struct(F.when(a >= b, "table").otherwise("terminal").alias("kind"), (both & (F.abs(a - b) < margin)).alias("ambiguous"))


def decided_status(blockers: Column, native: Column, checks: Column, total: Column, anchorable: Column, matched: Column) -> Column:
    """A figure's state: a blocker, all native checks, full coverage by other channels, else unverified."""
    full = (total > 0) & (anchorable == total) & (matched == total)
    return F.when(blockers > 0, "needs_review").when(native & F.coalesce(F.forall(checks, lambda x: x), F.lit(False)), "native_verified").when(full, "corroborated").otherwise("unverified")


def coverage(records: DataFrame, key: str, exclude: str) -> DataFrame:
    """(key, total, anchorable, matched) of atoms (key, atom, channel, reliable, verdict, matched); the channel itself is no evidence."""
    other = (F.col("channel") != exclude) & F.col("reliable")
    atoms = records.groupBy(key, "atom").agg(F.bool_or(other).alias("_a"), F.bool_or(other & (F.col("verdict") == "match") & F.col("matched")).alias("_m"))
    n = lambda c: F.count(F.when(F.col(c), 1))
    return atoms.groupBy(key).agg(F.count("*").alias("total"), n("_a").alias("anchorable"), n("_m").alias("matched"))


# --- texts of cut figures


def scaffold(content: str | Column, kind: str | Column) -> Column:
    """Leading lines of a figure's text that are no data: 2 of a terminal, 3 of a table; null if they are not there."""
    lines = F.split(_c(content), "\n")
    at = lambda k: F.get(lines, F.lit(k))
    figure = F.startswith(at(0), F.lit("[FIGURE "))
    return F.when(figure & (_c(kind) == "terminal") & at(1).rlike("^`{3,}$"), 2).when(figure & (_c(kind) == "table") & F.startswith(at(1), F.lit("|")) & at(2).rlike(r"^\|(?:\s*-{3,}\s*\|)+$"), 3)


def truncation(content: str | Column, kind: str | Column, first: Column, last: Column, limit: int) -> Column:
    """(cut_chars, partial, shown_lines, atoms, shown_last, fence): how far a figure's text goes under a budget, at a line's end."""
    c = _c(content)
    cut = F.left(c, F.lit(limit))
    line_end = F.length(cut) - F.length(F.substring_index(cut, "\n", -1)) - 1
    partial = ~F.contains(cut, F.lit("\n"))
    chars = F.when(partial, F.length(cut)).otherwise(line_end)
    kept = F.left(c, chars)
    shown = F.when(chars > 0, F.size(F.split(kept, "\n"))).otherwise(0)
    head = scaffold(c, kind)
    atoms = F.when(head.isNull() | first.isNull(), None).when(partial, 0).otherwise(F.least(F.greatest(F.lit(0), shown - head), last - first + 1))
    closing = F.when((head == 2) & (shown >= 2) & ~partial, F.get(F.split(c, "\n"), F.lit(1))).otherwise("")
    return F.struct(chars.cast("int").alias("cut_chars"), partial.alias("partial"), shown.cast("int").alias("shown_lines"), atoms.cast("int").alias("atoms"), F.when(atoms > 0, first + atoms - 1).cast("int").alias("shown_last"), closing.alias("fence"))


def truncated(content: str | Column, plan: Column, ref: Column) -> Column:
    """The cut text with its closing fence and a note."""
    tail = F.when(plan["fence"] != "", F.concat(F.lit("\n"), plan["fence"])).otherwise(F.lit(""))
    note = F.concat(F.lit("\n... [REF"), ref.cast("string"), F.lit(" cut: "), plan["shown_lines"].cast("string"), F.lit(" lines shown]"))
    return F.concat(F.left(_c(content), plan["cut_chars"]), tail, note)


# --- pages: jobs, positions and replacements


def big_enough(x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    w, h = x1 - x0, y1 - y0
    return (F.least(w, h) >= 30) & (w * h >= 4000)


def page_jobs(pages: DataFrame) -> DataFrame:
    """(page, figure_index, mode, box) of pages (page, text, boxes array<struct<x0,y0,x1,y1>> with nulls for unknown ones).

    A page almost without text, or with an unknown box, is rendered whole; else every large enough box is cut out.
    """
    known = F.filter("boxes", lambda b: b.isNotNull())
    passing = F.filter(known, lambda b: big_enough(b["x0"], b["y0"], b["x1"], b["y1"]))
    missing = F.size("boxes") - F.size(known)
    bare = F.length(F.trim(F.coalesce("text", F.lit("")))) < 20
    p = pages.where(F.size("boxes") > 0).withColumn("_whole", F.when(bare, (F.size(passing) > 0) | (missing > 0)).otherwise(missing > 0)).withColumn("_p", passing).withColumn("_bare", bare)
    whole = p.where("_whole").select("page", F.lit(1).alias("figure_index"), F.lit("page").alias("mode"), F.lit(None).cast(pages.schema["boxes"].dataType.elementType).alias("box"))
    crops = p.where("NOT _whole AND NOT _bare").select("page", F.posexplode("_p").alias("_k", "box")).select("page", (F.col("_k") + 1).alias("figure_index"), F.lit("crop").alias("mode"), "box")
    return whole.unionByName(crops)


def first_texts(pages: DataFrame, page: str, order: str, text: str) -> DataFrame:
    """(page, text): the first text of each page."""
    return pages.groupBy(page).agg(F.min_by(text, order).alias(text))


def position_problem(raw: Column, start: Column, end: Column, native: Column) -> Column:
    """Why a span cannot be replaced by a figure, '' if it can: the first of missing, outside, blank, unproven, elsewhere, more."""
    part = F.substring(raw, start + 1, end - start)
    flat = lambda s: F.regexp_replace(F.trim(F.regexp_replace(s, r"\s+", " ")), r"[\s|:-]+", " ")
    proof = F.trim(F.coalesce(native, F.lit("")))
    return (
        F.when(start.isNull() | end.isNull(), "missing").when((start < 0) | (end <= start) | (end > F.length(raw)), "outside").when(F.trim(F.regexp_replace(part, r"\s+", " ")) == "", "blank")
        .when(proof == "", "unproven").when(~F.contains(part, proof), "elsewhere").when(flat(part) != flat(proof), "more").otherwise("")
    )


def marker_piece(raw: Column, start: Column, end: Column, text: Column) -> Column:
    """A marker with line ends added where it would not stand on a line of its own."""
    lead = F.when((start > 0) & (F.substring(raw, start, F.lit(1)) != "\n"), "\n").otherwise("")
    tail = F.when((end < F.length(raw)) & (F.substring(raw, end + 1, F.lit(1)) != "\n"), "\n").otherwise("")
    return F.concat(lead, text, tail)


def replaced(raw: Column, pieces: Column) -> Column:
    """raw with spans (start, end, piece) that do not overlap replaced; places are those in raw."""
    start = F.struct(F.lit("").alias("s"), F.lit(0).alias("at"))

    def step(acc: Column, x: Column) -> Column:
        return F.struct(F.concat(acc["s"], F.substring(raw, acc["at"] + 1, x["start"] - acc["at"]), x["piece"]).alias("s"), x["end"].alias("at"))

    return F.aggregate(F.array_sort(pieces), start, step, lambda acc: F.concat(acc["s"], F.substring(raw, acc["at"] + 1, F.length(raw))))


def best_box(boxes: DataFrame, key: str, threshold: float) -> DataFrame:
    """(key, box, ties) of pairs (key, box, iou): the best overlap over the threshold, and how many share it."""
    top = boxes.where(F.col("iou") >= threshold).groupBy(key).agg(F.max(F.struct("iou", (-F.col("box")).alias("_b"))).alias("_t"))
    same = boxes.join(top, key).where(F.col("iou") == F.col("_t.iou")).groupBy(key).agg((-F.max("_t._b")).alias("box"), F.count("*").alias("ties"))
    return same


def uncovered(jobs: DataFrame, covered: DataFrame, threshold: float = 0.5) -> DataFrame:
    """jobs (page, id, x0, y0, x1, y1) that no covered box of the page overlaps enough."""
    met = figures.meeting(jobs, covered.withColumn("id", F.lit(0)), boxes.iou("a_", "b_") >= threshold)
    hit = met.select("page", F.col("a_id").alias("id")).distinct()
    return jobs.join(hit, ["page", "id"], "left_anti")


def shared_results(candidates: DataFrame, keys: list[str], order: str) -> DataFrame:
    """candidates with of: the first one of the same pixels and kind, whose result is used again."""
    return candidates.withColumn("of", F.first(order).over(Window.partitionBy(*keys).orderBy(order)))


def carried_over(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, figure, revision) of new figures that a human verified before: same pixels, box and signature, the newest revision."""
    best = old.where("status = 'human_verified'").groupBy(*keys).agg(F.max("revision").alias("revision"))
    return new.select(*keys, "figure").join(best, keys)


def baseline(chunks: DataFrame) -> DataFrame:
    """(source, figure, revision): the newest human revision of each figure."""
    return chunks.where("status = 'human_verified'").groupBy("source", "figure").agg(F.max("revision").alias("revision"))


def numbered_after(figures: DataFrame, texts: DataFrame) -> DataFrame:
    """figures (source, page, ord) with chunk_index after the texts' (source, page, chunk_index) of their page."""
    last = texts.groupBy("source", "page").agg(F.max("chunk_index").alias("_last"))
    w = Window.partitionBy("source", "page").orderBy("ord")
    return figures.join(last, ["source", "page"], "left").withColumn("chunk_index", F.coalesce("_last", F.lit(-1)) + F.row_number().over(w)).drop("_last")


def listed(stored: DataFrame, artifacts: DataFrame, key: str) -> DataFrame:
    """(key, in_store): figures of the store, and those that only artifacts tell of."""
    mine = stored.select(key).distinct().withColumn("in_store", F.lit(True))
    return mine.unionByName(artifacts.select(key).distinct().join(mine, key, "left_anti").withColumn("in_store", F.lit(False)))


def fixed(stored: DataFrame, fixes: DataFrame, key: str) -> DataFrame:
    """stored parts (key, revision, content, status) after fixes (key, expected, content): all parts of a fixed figure give way to one.

    A fix whose expected revision is not the newest changes nothing; check with store.guard() to refuse it.
    """
    now = stored.groupBy(key).agg(F.max("revision").alias("_now"))
    good = fixes.join(now, key).where(F.col("expected") == F.col("_now"))
    kept = stored.join(good.select(key), key, "left_anti")
    return kept.unionByName(good.select(key, (F.col("_now") + 1).alias("revision"), "content", F.lit("human_verified").alias("status")), allowMissingColumns=True)


# --- plans, tiles and their checks


def column_assignment_ok(filled: Column, expected: Column) -> Column:
    """Whether a derived split into columns fills at least 0.6 of the cells that should not be empty."""
    return F.coalesce((expected > 0) & (filled / expected >= 0.6), F.lit(False))


def over_caps(counts: DataFrame, caps: dict[str, int]) -> DataFrame:
    """counts (document, a column for each cap) with over: the caps that a document passes."""
    return counts.withColumn("over", F.array_compact(F.array(*[F.when(F.col(c) > most, F.lit(c)) for c, most in caps.items()])))


def preflight(counts: DataFrame, caps: dict[str, int]) -> DataFrame:
    """counts (document, a column for each cap) that are within all caps; an error names the documents and counts that are not."""
    bad = over_caps(counts, caps).where(F.size("over") > 0).select("document", "over").limit(5).collect()
    if bad:
        raise ValueError("; ".join(f"{r['document']}: {', '.join(r['over'])}" for r in bad))
    return counts


def tiles(boxes: DataFrame, glyph: float = 9.0, pixels_per_glyph: int = 16, patch: int = 28, budget: int = 4096) -> DataFrame:
    """(id, tile, y0, y1, scale, tokens) of boxes (id, x0, y0, x1, y1): horizontal strips whose glyphs are tall enough and whose patches fit.

    A strip is as wide as its box and one glyph overlaps the next; each costs a token for a patch of its pixels.
    """
    scale = F.lit(pixels_per_glyph / glyph)
    across = F.ceil((F.col("x1") - F.col("x0")) * scale / patch) + 1
    rows = F.greatest(F.floor(budget / across) - 1, F.lit(1))
    high = rows * patch / scale
    n = F.greatest(F.ceil((F.col("y1") - F.col("y0") - glyph) / F.greatest(high - glyph, F.lit(glyph))), F.lit(1)).cast("int")
    b = boxes.withColumn("_h", high).withColumn("_a", across).withColumn("_n", n)
    t = b.withColumn("tile", F.explode(F.sequence(F.lit(1), F.col("_n"))))
    step = F.greatest(F.col("_h") - glyph, F.lit(glyph))
    y0 = F.col("y0") + (F.col("tile") - 1) * step
    y1 = F.least(y0 + F.col("_h"), F.col("y1"))
    return t.select("id", "tile", F.round(y0, 4).alias("y0"), F.round(y1, 4).alias("y1"), F.round(scale, 6).alias("scale"), (F.col("_a") * (F.ceil((y1 - y0) * scale / patch) + 1)).cast("long").alias("tokens"))


def stitched(parts: Column, most: int = 50) -> Column:
    """The lines of tiles (array of arrays) one after the other, without what a tile repeats of the end of those before it."""
    from quarry.functions.code import longest_overlap

    none = F.array().cast("array<string>")
    return F.aggregate(parts, none, lambda acc, x: F.concat(acc, F.slice(x, longest_overlap(acc, x, most) + 1, F.greatest(F.size(x), F.lit(1)))))


def native_checks(verdicts: DataFrame, key: str, rows: Column, channel_rows: Column, header_same: Column, channels: Column) -> DataFrame:
    """(key, second_channel, header_agreement, row_count_agreement, text_agreement) of alignment.verdicts() joined with per-figure columns."""
    judged = F.col("verdict").isin("match", "differ")
    return verdicts.groupBy(key).agg(
        (F.max(channels) >= 2).alias("second_channel"), F.bool_and(header_same).alias("header_agreement"), (F.max(rows) == F.max(channel_rows)).alias("row_count_agreement"),
        (F.coalesce(F.bool_and(F.when(judged, F.col("verdict") == "match")), F.lit(False))).alias("text_agreement"),
    )


def valid_variant(v: Column) -> Column:
    """Why the record of a rendered picture (id, kind, width, height, digest, box) is refused, '' if it is not."""
    box = v["box"]
    return (
        F.when(F.coalesce(v["id"], F.lit("")) == "", "id").when(~F.coalesce(v["kind"].isin("page", "crop", "tile"), F.lit(False)), "kind").when(~F.coalesce((v["width"] > 0) & (v["height"] > 0), F.lit(False)), "size")
        .when(~F.coalesce(v["digest"].rlike("^[0-9a-f]{64}$"), F.lit(False)), "digest").when((v["kind"] != "page") & ~F.coalesce((F.size(box) == 4) & (F.get(box, F.lit(0)) < F.get(box, F.lit(2))) & (F.get(box, F.lit(1)) < F.get(box, F.lit(3))), F.lit(False)), "box").otherwise("")
    )
