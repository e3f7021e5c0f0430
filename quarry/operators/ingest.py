"""Documents to chunks: lines, sections, chunks, ids and adjacent merges."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quarry.config import DEFAULT
from quarry.functions import text
from quarry.operators import scans
from quarry.shipping import ensure_importable

# What lines count as headings.
MARKDOWN = r"^#{1,6}\s+\S"
NUMBERED = r"^\d+\.[\d\.]*\s+\S"


def line_offsets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, line_no from 0, start, line) of every line; start counts characters."""
    lines = docs.select(F.col(id_col), F.posexplode(F.split(text_col, "\n")).alias("line_no", "line"))
    w = Window.partitionBy(id_col).orderBy("line_no").rowsBetween(Window.unboundedPreceding, -1)
    return lines.withColumn("start", F.coalesce(F.sum(F.length("line") + 1).over(w), F.lit(0)).cast("long"))


def is_heading(line: Column) -> Column:
    """Markdown headings, lines of two or more capital words, and numbered headings."""
    s = F.trim(line)
    caps = (F.length(s) >= 4) & (F.length(s) <= 99) & (F.upper(s) == s) & s.rlike(r"\p{Lu}") & s.rlike(r"\S\s+\S") & ~s.rlike(text.CJK)
    numbered = s.rlike(NUMBERED) & (F.length(s) <= 99) & ~s.rlike(r"[.。;；,，]$")
    return s.rlike(MARKDOWN) | caps | numbered


def heading_title(line: Column) -> Column:
    s = F.trim(line)
    return F.when(s.rlike(MARKDOWN), F.trim(F.regexp_extract(s, r"^#{1,6}\s+(.+)$", 1))).when(is_heading(line), s)


def heading_level(line: Column) -> Column:
    s = F.trim(line)
    return F.when(s.startswith("### "), 3).when(s.startswith("## "), 2).when(s.startswith("# "), 1).when((F.upper(s) == s) & s.rlike(r"\p{Lu}"), 1).otherwise(2)


def sections(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, section, title, level, start, end): from a heading to the next; text before the first is section 0, level 0."""
    lines = line_offsets(docs, id_col, text_col)
    heads = lines.where(is_heading(F.col("line"))).select(id_col, F.col("start"), heading_title(F.col("line")).alias("title"), heading_level(F.col("line")).alias("level"))
    total = docs.select(F.col(id_col), F.length(text_col).alias("len"))
    pre = docs.select(F.col(id_col), F.lit(0).cast("long").alias("start"), F.lit("").alias("title"), F.lit(0).alias("level")).join(heads.where("start = 0").select(id_col), id_col, "left_anti")
    every = heads.unionByName(pre).join(total, id_col)
    w = Window.partitionBy(id_col).orderBy("start")
    return every.select(F.col(id_col), (F.row_number().over(w) - 1).alias("section"), "title", "level", "start", F.lead("start").over(w).alias("next"), "len").select(id_col, "section", "title", "level", "start", F.coalesce("next", "len").cast("long").alias("end"))


def contained_in(points: DataFrame, spans: DataFrame, by: str, at: str = "start") -> DataFrame:
    """Each point with the last span of its key that starts at or before it (null if none), by one sort per key."""
    keyed = spans.select(F.col(by), F.col("start").alias("_at"), F.lit(0).alias("_kind"), F.col("section").alias("_section"))
    p = points.select("*", F.col(at).alias("_at"), F.lit(1).alias("_kind"))
    both = p.unionByName(keyed, allowMissingColumns=True)
    w = Window.partitionBy(by).orderBy("_at", "_kind").rowsBetween(Window.unboundedPreceding, 0)
    return both.withColumn("section", F.last("_section", ignorenulls=True).over(w)).where("_kind = 1").drop("_at", "_kind", "_section")


def fixed_chunks(docs: DataFrame, size: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, chunk_index, content) of size characters each."""
    n = F.greatest(F.ceil(F.length(text_col) / size), F.lit(1)).cast("int")
    at = docs.select(F.col(id_col), F.col(text_col).alias("_t"), F.explode(F.sequence(F.lit(0), n - 1)).alias("chunk_index"))
    return at.select(id_col, "chunk_index", F.expr(f"substring(_t, chunk_index * {size} + 1, {size})").alias("content"))


def with_overlap(chunks: DataFrame, overlap: int, id_col: str = "doc_id") -> DataFrame:
    """content led by the last characters of the chunk before, as that was."""
    w = Window.partitionBy(id_col).orderBy("chunk_index")
    before = F.lag("content").over(w)
    return chunks.withColumn("content", F.when(before.isNull(), F.col("content")).otherwise(F.concat(F.right(before, F.lit(overlap)), F.lit("\n"), F.col("content"))))


def split_semantic(body: str, size: int, overlap: int) -> list[tuple[str, str]]:
    """(section, content) chunks of at most size characters of whole lines, overlap aside.

    A heading starts a chunk; a blank line ends one that is over 70 % full; lines over size are cut at sentence ends; a
    table's header is repeated where a table is cut.
    """
    if len(body) <= size:
        return [("", body)]
    out: list[tuple[str, str]] = []
    held: list[str] = []
    used, section, header = 0, "", []

    def flush() -> None:
        nonlocal used
        if content := "\n".join(held).strip():
            out.append((section, content))
        held.clear()
        used = 0

    lines = body.split("\n")
    for k, line in enumerate(lines):
        s = line.strip()
        if re.match(MARKDOWN, s) or (4 <= len(s) <= 99 and s.isupper() and len(s.split()) > 1):
            flush()
            section, header = s.lstrip("# ").strip(), []
        elif not s:
            if used > 0.7 * size:
                flush()
                continue
        table_row = s.count("|") >= 2
        if table_row and k + 1 < len(lines) and re.fullmatch(r"[|\s:\-]+", lines[k + 1].strip() or "x"):
            header = [line, lines[k + 1]]
        elif not table_row:
            header = []
        for part in [line] if len(line) <= size else _cut(line, size):
            if held and used + len(part) + 1 > size:
                flush()
                if table_row and header and line not in header:
                    held.extend(header)
                    used = sum(len(x) + 1 for x in header)
            held.append(part)
            used += len(part) + 1
    flush()
    done = []
    for k, (title, content) in enumerate(out):
        lead = out[k - 1][1][-overlap:] + "\n" if k and overlap else ""
        done.append((title, (f"[{title}]\n" if k and title else "") + lead + content))
    return done


def _cut(line: str, size: int) -> Iterator[str]:
    """Pieces of at most size characters, at sentence ends where they fall inside."""
    held = ""
    for part in re.split(r"(?<=[.。!?！？])\s+", line):
        if held and len(held) + 1 + len(part) > size:
            yield held
            held = ""
        held = f"{held} {part}" if held else part
        while len(held) > size:
            yield held[:size]
            held = held[size:]
    if held:
        yield held


#: Characters of chunks that leave a worker together.
CHARS = 1_000_000


def semantic_chunks(docs: DataFrame, size: int = 1200, overlap: int = 200, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, chunk_index, section, content): a fold over each document's lines, batched through Arrow.

    Texts of a batch become Python strings one at a time, and chunks leave as soon as they have CHARS characters, so a
    worker holds little more than the batch.
    """
    ensure_importable(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held: list[tuple[int, int, str, str]] = []
            used = 0
            for i, t in zip(batch.column("id"), batch.column("t"), strict=True):
                for k, (title, content) in enumerate(split_semantic((t.as_py() or "").strip(), size, overlap)):
                    held.append((i.as_py(), k, title, content))
                    used += len(content)
                    if used >= CHARS:
                        yield chunk_batch(held)
                        held, used = [], 0
            if held:
                yield chunk_batch(held)

    def chunk_batch(rows: list[tuple[int, int, str, str]]) -> pa.RecordBatch:
        columns = [pa.array(c, kind) for c, kind in zip(zip(*rows, strict=True), (pa.int64(), pa.int32(), pa.string(), pa.string()), strict=True)]
        return pa.RecordBatch.from_arrays(columns, names=[id_col, "chunk_index", "section", "content"])

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("t")).mapInArrow(run, f"{id_col} long, chunk_index int, section string, content string")


def adjacent_runs(chunks: DataFrame, keys: list[str]) -> DataFrame:
    """chunks with run: the number of the unbroken run of chunk_index within keys."""
    w = Window.partitionBy(*keys).orderBy("chunk_index")
    step = F.when(F.col("chunk_index") == F.lag("chunk_index").over(w) + 1, 0).otherwise(1)
    return chunks.withColumn("_new", step).withColumn("run", F.sum("_new").over(w)).drop("_new")


def merge_adjacent(chunks: DataFrame, keys: list[str], limit: int = DEFAULT.merge_chars) -> DataFrame:
    """(keys, first, last, content): neighbours in order joined while their texts, with line ends between, stay under limit.

    A key may have any number of chunks: only a merged chunk's own parts meet. Chunk numbers of a key are distinct.
    """
    size = F.length("content")
    batches = scans.greedy(chunks, keys, "chunk_index", size, scans.Rule(None, limit - 1, gap=1, follow=True))
    parts = chunks.select(*keys, F.col("chunk_index").cast("long").alias("chunk_index"), "content").join(batches, [*keys, "chunk_index"])
    whole = parts.groupBy(*keys, "batch").agg(F.array_sort(F.collect_list(F.struct("chunk_index", "content"))).alias("m"))
    text_of = F.array_join(F.transform("m", lambda x: x["content"]), "\n")
    return whole.select(*keys, F.get("m", F.lit(0))["chunk_index"].cast("int").alias("first"), F.element_at("m", -1)["chunk_index"].cast("int").alias("last"), text_of.alias("content"))


def greedy_batches(rows: DataFrame, group: str, order: str, size: str, max_items: int = DEFAULT.batch_items, max_size: int = DEFAULT.batch_chars) -> DataFrame:
    """(group, order, batch): batches in order of at most max_items rows and max_size, a larger row alone; a group may hold any number of rows."""
    return scans.greedy(rows, [group], order, size, scans.Rule(max_items, max_size))


# Lines of navigation, of legal notes, links to scripts, and empty table rows.
NOISE_LINES = [
    r"^(Skip to|跳到|跳至|導航|Navigation|Menu|選單)",
    r"^(Copyright|©|版權|All rights reserved)",
    r"^(Privacy|隱私|Terms|條款)",
    r"^\[.*\]\(javascript:",
    r"^(\s*\|\s*)+$",
]


def clean_lines(pages: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, content, lines) without navigation, legal, script-link and very short lines, and with at most two blank lines in a row."""
    lines = pages.select(F.col(id_col), F.posexplode(F.split(text_col, "\n")).alias("n", "line")).withColumn("s", F.trim("line"))
    w = Window.partitionBy(id_col).orderBy("n")
    blanks = lines.withColumn("run", F.sum(F.when(F.col("s") != "", 1).otherwise(0)).over(w)).withColumn("nth", F.row_number().over(Window.partitionBy(id_col, "run", F.col("s") == "").orderBy("n")))
    kept = blanks.where(F.when(F.col("s") == "", F.col("nth") <= 2).otherwise(~F.col("s").rlike("(?i)" + "|".join(NOISE_LINES)) & ((F.length("s") >= 3) | F.col("s").startswith("#"))))
    return kept.groupBy(id_col).agg(F.trim(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "line"))), lambda x: x["line"]), "\n")).alias("content"), F.count("*").alias("lines"))


# --- headings, windows and page geometry


def heading_paths(headings: DataFrame, key: str, order: str, levels: int = 6) -> DataFrame:
    """headings (key, order, level, title) with path: the titles that hold each one, from the top level down to its own."""
    w = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    at = [F.last(F.when(F.col("level") <= k, F.struct("level", "title")), ignorenulls=True).over(w) for k in range(1, levels + 1)]
    kept = [F.when((x["level"] == k) & (F.col("level") >= k), x["title"]) for k, x in enumerate(at, 1)]
    return headings.withColumn("path", F.concat_ws(" > ", *kept))


def pages_of_spans(spans: DataFrame, pages: DataFrame, key: str) -> DataFrame:
    """spans (key, start, end) with first_page and last_page of pages (key, page, page_start, page_end) that they touch; 1 without any."""
    j = spans.join(pages, key, "left")
    touched = F.when((F.col("page_start") < F.col("end")) & (F.col("start") < F.col("page_end")), F.col("page"))
    return j.groupBy(key, "start", "end").agg(F.coalesce(F.min(touched), F.lit(1)).alias("first_page"), F.coalesce(F.max(touched), F.lit(1)).alias("last_page"))


def section_window(sections: Column, index: Column, budget: Column) -> Column:
    """(start, end): the section at index with neighbours on both sides, one at a time, while all fit the budget.

    sections: array of (start, end) in order. A section over the budget stays as it is; cut it with trimming.centered_slice.
    """
    at = lambda k: F.get(sections, k)
    first = F.struct(index.alias("lo"), index.alias("hi"), at(index)["start"].alias("start"), at(index)["end"].alias("end"))

    def step(s: Column, _: Column) -> Column:
        down = (s["lo"] >= 1) & (s["end"] - at(s["lo"] - 1)["start"] <= budget)
        lo, start = F.when(down, s["lo"] - 1).otherwise(s["lo"]), F.when(down, at(s["lo"] - 1)["start"]).otherwise(s["start"])
        up = (s["hi"] + 1 < F.size(sections)) & (at(s["hi"] + 1)["end"] - start <= budget)
        return F.struct(lo.alias("lo"), F.when(up, s["hi"] + 1).otherwise(s["hi"]).alias("hi"), start.alias("start"), F.when(up, at(s["hi"] + 1)["end"]).otherwise(s["end"]).alias("end"))

    grown = F.aggregate(sections, first, step)
    return F.when(at(index)["end"] - at(index)["start"] > budget, F.struct(at(index)["start"].alias("start"), at(index)["end"].alias("end"))).otherwise(F.struct(grown["start"].alias("start"), grown["end"].alias("end")))


def apply_section_titles(chunks: DataFrame, sections: DataFrame, key: str) -> DataFrame:
    """chunks (key, section_index, section) with the titles of sections (key, section_index, title), and whether that changed them."""
    j = chunks.join(sections.select(key, "section_index", "title"), [key, "section_index"], "left")
    new = F.coalesce("title", "section")
    return j.withColumn("changed", ~F.col("section").eqNullSafe(new)).withColumn("section", new).drop("title")


def build_chunks(docs: DataFrame, kind: str, size: int = 1200, overlap: int = 200, source: Column | None = None, **extra: Column) -> DataFrame:
    """(id, chunk_index, section, content, source, type, extras) of docs (doc_id, text, source): normalised, split and typed in one place."""
    from quarry.functions import text as T

    flat = docs.withColumn("text", T.normalize_tables(F.col("text")))
    parts = semantic_chunks(flat, size, overlap)
    meta = docs.select("doc_id", (F.col("source") if source is None else source).alias("source"), *[c.alias(k) for k, c in extra.items()])
    return parts.join(meta, "doc_id").withColumn("type", T.content_type(F.col("content"), F.lit(kind)))


def bands(words: DataFrame, key: str, ratio: float = 0.6) -> DataFrame:
    """(key, band, y0, y1, x0, x1, text, words) of words (key, text, x0, y0, x1, y1): lines of text by their vertical centres.

    A word joins the last band if their centres are near for the height of the taller; a fold over a page's words.
    """
    ensure_importable(words.sparkSession)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.assign(c=(pdf["y0"] + pdf["y1"]) / 2).sort_values(["c", "x0"])
        out: list[dict] = []
        for r in pdf.itertuples(index=False):
            h = r.y1 - r.y0
            if out and abs(r.c - (out[-1]["y0"] + out[-1]["y1"]) / 2) <= ratio * max(h, out[-1]["y1"] - out[-1]["y0"], 1.0):
                b = out[-1]
                b.update(y0=min(b["y0"], r.y0), y1=max(b["y1"], r.y1), x0=min(b["x0"], r.x0), x1=max(b["x1"], r.x1))
                b["w"].append((r.x0, r.text))
            else:
                out.append({"y0": r.y0, "y1": r.y1, "x0": r.x0, "x1": r.x1, "w": [(r.x0, r.text)]})
        return pd.DataFrame([(pdf[key].iloc[0], k, b["y0"], b["y1"], b["x0"], b["x1"], " ".join(t for _, t in sorted(b["w"])), len(b["w"])) for k, b in enumerate(out, 1)], columns=[key, "band", "y0", "y1", "x0", "x1", "text", "words"])

    return words.select(key, "text", "x0", "y0", "x1", "y1").groupBy(key).applyInPandas(run, f"{key} long, band int, y0 double, y1 double, x0 double, x1 double, text string, words int")


def overlap_rows(words: DataFrame, key: str, ratio: float = 0.5) -> DataFrame:
    """words (key, id, x0, y0, x1, y1) with line: the first line, from above, that a word overlaps enough in height."""
    ensure_importable(words.sparkSession)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf[pdf["y1"] > pdf["y0"]].assign(c=(pdf["y0"] + pdf["y1"]) / 2).sort_values(["c", "x0"])
        lines: list[list[float]] = []
        of = []
        for r in pdf.itertuples(index=False):
            for k, (top, bottom) in enumerate(lines):
                smaller = min(bottom - top, r.y1 - r.y0)
                if smaller > 0 and (min(bottom, r.y1) - max(top, r.y0)) / smaller >= ratio:
                    lines[k] = [min(top, r.y0), max(bottom, r.y1)]
                    of.append(k)
                    break
            else:
                lines.append([r.y0, r.y1])
                of.append(len(lines) - 1)
        place = {k: n for n, k in enumerate(sorted(range(len(lines)), key=lambda k: lines[k][0]), 1)}
        return pd.DataFrame({key: pdf[key], "id": pdf["id"], "line": [place[k] for k in of]})

    return words.select(key, "id", "x0", "y0", "x1", "y1").groupBy(key).applyInPandas(run, f"{key} long, id long, line int")


def fill_down(cells: DataFrame, table: str, column: str = "col", row: str = "row", same: str = "spans") -> DataFrame:
    """cells (table, row, col, text, spans) with filled and from_row: an empty cell takes the text above where spans says it is one cell.

    spans: whether the cell has the box of the one above it. Without that proof empty cells stay empty.
    """
    w = Window.partitionBy(table, column).orderBy(row)
    run = F.sum(F.when(F.col(same), 0).otherwise(1)).over(w)
    c = cells.withColumn("_run", run)
    head = Window.partitionBy(table, column, "_run").orderBy(row).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    first, at = F.first("text").over(head), F.first(row).over(head)
    empty = F.trim("text") == ""
    take = empty & (F.trim(first) != "") & (F.col(row) > at)
    return c.withColumn("filled", F.when(take, first).otherwise(F.col("text"))).withColumn("from_row", F.when(take, at)).withColumn("conflict", ~empty & (F.col(row) > at) & (F.trim(first) != "") & (F.trim("text") != F.trim(first))).drop("_run")
