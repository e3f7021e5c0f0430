"""Unified diffs: parsed to rows, placed in files that may have moved on, and applied."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.shipping import ensure_importable

_HUNK = re.compile(r"^@@ (?:-(\d+)(?:,\d+)? \+(\d+)(?:,\d+)? )?@@")


def parse(patch: str) -> list[tuple[str, int, int, str, str]]:
    """(file, hunk, old start or 0, op, text) of each hunk line; op is ' ', '-' or '+'."""
    out, file, hunk, start = [], "", -1, 0
    for line in patch.split("\n"):
        if line.startswith("--- "):
            hunk = -1
        elif line.startswith("+++ "):
            file, hunk = re.sub(r"^b/", "", line[4:].split("\t")[0].strip()), -1
        elif m := _HUNK.match(line):
            hunk, start = hunk + 1, int(m[1] or 0)
        elif hunk >= 0 and line[:1] in (" ", "-", "+"):
            out.append((file, hunk, start, line[0], line[1:]))
    return out


def locate(lines: list[str], old: list[str], start: int) -> int | None:
    """Where the old lines stand: at their place, else at the nearest place that fits, blanks at line ends aside; none if two are as near."""
    flat = [x.rstrip() for x in lines]
    want = [x.rstrip() for x in old]
    at = [k for k in range(len(flat) - len(want) + 1) if flat[k : k + len(want)] == want]
    if not at:
        return None
    if not start:
        return at[0] if len(at) == 1 else None
    near = sorted(at, key=lambda k: (abs(k - (start - 1)), k))
    return None if len(near) > 1 and abs(near[0] - start + 1) == abs(near[1] - start + 1) else near[0]


def apply(content: str, rows: list[tuple[int, int, str, str]]) -> str | None:
    """content with hunks (hunk, start, op, text) applied; none if one of them has no place, or two overlap."""
    lines, edits = content.split("\n"), []
    for h in sorted({r[0] for r in rows}):
        part = [r for r in rows if r[0] == h]
        old, new = [t for _, _, op, t in part if op != "+"], [t for _, _, op, t in part if op != "-"]
        k = min(part[0][1], len(lines)) if not old else locate(lines, old, part[0][1])
        if k is None:
            return None
        edits.append((k, k + len(old), new))
    edits.sort()
    if any(a[1] > b[0] for a, b in zip(edits, edits[1:], strict=False)):
        return None
    for k, end, new in reversed(edits):
        lines[k:end] = new
    return "\n".join(lines)


def hunks(patches: DataFrame) -> DataFrame:
    """(patch, file, hunk, start, ord, op, text) of patches (patch, content)."""
    ensure_importable(patches.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [(p, f, h, s, k, op, x) for p, c in zip(pdf["patch"], pdf["content"], strict=True) for k, (f, h, s, op, x) in enumerate(parse(c or ""))]
            yield pd.DataFrame(rows, columns=["patch", "file", "hunk", "start", "ord", "op", "text"])

    return patches.select("patch", "content").mapInPandas(run, "patch long, file string, hunk int, start int, ord int, op string, text string")


def patched(files: DataFrame, rows: DataFrame) -> DataFrame:
    """(file, content, applied) of files (file, content) under hunks(); a file whose hunks have no place stays as it is.

    A file meets its hunks in one row, so that Python is handed batches of files, not a frame for each.
    """
    ensure_importable(files.sparkSession)
    edits = rows.groupBy(F.col("file").alias("_file")).agg(F.array_sort(F.collect_list(F.struct("patch", "ord", "hunk", "start", "op", "text"))).alias("edits"))
    whole = files.groupBy("file").agg(F.first("content").alias("content")).join(edits, F.col("file").eqNullSafe(F.col("_file")), "left")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            done = [None if e is None else apply(c, [(x["hunk"], x["start"], x["op"], x["text"]) for x in e]) for c, e in zip(pdf["content"], pdf["edits"], strict=True)]
            yield pd.DataFrame({"file": pdf["file"], "content": [c if d is None else d for c, d in zip(pdf["content"], done, strict=True)], "applied": [d is not None for d in done]})

    return whole.select("file", "content", "edits").mapInPandas(run, "file string, content string, applied boolean")
