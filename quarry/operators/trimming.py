"""Cuts of long texts: segments, windows, tool outputs and files, by column expressions where no state is carried."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.shipping import ensure_importable

# Lines that tell of errors, and places in files.
ERROR = "(?i)error|exception|traceback|fail|fatal|panic"
ANCHOR = r"[\w./-]+\.\w+:\d+"


def split_segments(body: str, budget: int) -> list[tuple[int, int]]:
    """Spans of at most budget characters, cut after the last line end in the second half where there is one."""
    out, at = [], 0
    while at < len(body):
        end = min(at + budget, len(body))
        if end < len(body) and (cut := body.rfind("\n", at + budget // 2, end)) >= 0:
            end = cut + 1
        out.append((at, end))
        at = end
    return out


def segments(docs: DataFrame, budget: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, segment, start, end) of each document."""
    ensure_importable(docs.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame([(i, k, a, b) for i, x in zip(pdf["id"], pdf["t"], strict=True) for k, (a, b) in enumerate(split_segments(x or "", budget))], columns=[id_col, "segment", "start", "end"])

    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("t")).mapInPandas(run, f"{id_col} long, segment int, start long, end long")


def centered(c: Column, center: Column, budget: int) -> Column:
    """budget characters around a position, moved inside the text."""
    start = F.greatest(F.least(center - budget // 2, F.length(c) - budget), F.lit(0))
    return F.substring(c, start + 1, F.lit(budget))


def head_chars(c: Column, limit: int) -> Column:
    """Characters of the whole lines within the first limit ones, their last line end left out; limit if a line is longer."""
    cut = F.left(c, F.lit(limit))
    return F.when(F.contains(cut, F.lit("\n")), F.length(cut) - F.length(F.substring_index(cut, "\n", -1)) - 1).otherwise(F.length(cut)).cast("int")


def tail_chars(c: Column, limit: int) -> Column:
    """Characters of the whole lines within the last limit ones; limit if a line is longer."""
    cut = F.right(c, F.lit(limit))
    return F.when(F.contains(cut, F.lit("\n")), F.length(cut) - F.length(F.substring_index(cut, "\n", 1)) - 1).otherwise(F.length(cut)).cast("int")


def cut_between(c: Column, head: int, tail: int, errors: int, mark: str) -> Column:
    """Whole lines of the head and the tail, and between them, behind marks, the first error lines of what is left out."""
    a, b = head_chars(c, head), tail_chars(c, tail)
    middle = F.substring(c, a + 1, F.length(c) - a - b)
    found = F.slice(F.filter(F.split(middle, "\n"), lambda x: x.rlike(ERROR)), 1, errors)
    return F.concat_ws("\n", F.left(c, a), F.lit(mark), F.when(F.size(found) > 0, F.array_join(F.array_append(found, F.lit(mark)), "\n")), F.right(c, b))


def command_output(c: Column, limit: int, errors: int = 8) -> Column:
    """Head and tail of half of limit each, by whole lines, and the first error lines between them."""
    half = limit // 2
    return F.when(F.length(c) <= limit, c).otherwise(cut_between(c, half, half, errors, "[...]"))


def file_output(c: Column, limit: int) -> Column:
    """A header line (=== ... ===) and as many whole lines of the rest as fit, with a mark where it is cut."""
    header = F.regexp_extract(c, r"^(=== [^\n]* ===\n)", 1)
    body = F.substring(c, F.length(header) + 1, F.length(c))
    kept = head_chars(body, limit)
    cut = F.concat(header, F.left(body, kept), F.lit("\n[... "), (F.length(body) - kept).cast("string"), F.lit(" more characters ...]"))
    return F.when(F.length(body) <= limit, c).otherwise(cut)


def middle_cut(c: Column, limit: int) -> Column:
    """Head and tail by whole lines around a mark."""
    head = F.regexp_extract(F.left(c, F.lit(limit // 2)), r"(?s)^(.*)\n", 1)
    tail = F.regexp_extract(F.right(c, F.lit(limit // 2)), r"(?s)\n(.*)$", 1)
    return F.when(F.length(c) <= limit, c).otherwise(F.concat(head, F.lit("\n[...]\n"), tail))


def summary(c: Column) -> Column:
    """Places in files (20 at most), error lines (5) and the last three lines of an old output."""
    lines = F.filter(F.split(c, "\n"), lambda x: F.trim(x) != "")
    places = F.slice(F.array_distinct(F.regexp_extract_all(c, F.lit(ANCHOR), F.lit(0))), 1, 20)
    errors = F.slice(F.filter(lines, lambda x: x.rlike(ERROR)), 1, 5)
    last = F.when(F.size(lines) > 3, F.slice(lines, -3, 3)).otherwise(lines)
    return F.array_join(F.concat(places, errors, last), "\n")


def elf_sections(c: Column) -> Column:
    """(name, type, address, size) of each line of a section listing."""
    row = r"(?m)^\s*\[\s*\d+\]\s+(\S+)\s+(\S+)\s+([0-9a-f]+)\s+[0-9a-f]+\s+([0-9a-f]+)"
    part = lambda k: F.regexp_extract_all(c, F.lit(row), F.lit(k))
    return F.arrays_zip(part(1).alias("name"), part(2).alias("type"), part(3).alias("address"), part(4).alias("size"))


def disagreement(a: Column, b: Column) -> Column:
    """How two table payloads differ: shape, header, cell or none."""
    labels = lambda p: F.transform(p["columns"], lambda x: x["label"])
    cells = lambda p: F.transform(p["rows"], lambda r: F.transform(r["cells"], lambda x: x["text"]))
    shape = (F.size(a["columns"]) != F.size(b["columns"])) | (F.size(a["rows"]) != F.size(b["rows"]))
    return F.when(shape, "shape").when(labels(a) != labels(b), "header").when(cells(a) != cells(b), "cell").otherwise("none")
