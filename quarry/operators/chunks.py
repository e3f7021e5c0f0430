"""Canonical texts of chunks and symbols: what is embedded, indexed, ranked and shown."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Marks of an embedding input's parts.
SOURCE_TAG, SECTION_TAG, CTX_TAG = "[SOURCE]", "[SECTION_METADATA]", "[CTX]"
# Origins of chunks that a vision model made, and of structured figures.
VISION_ORIGINS = ["image", "screenshot", "diagram"]
FIGURE_ORIGINS = ["figure_table", "figure_terminal", "figure_diagram"]
# Priorities of types when chunks are merged.
TYPE_PRIORITY = {"warning": 3, "spec": 2, "doc": 1}
PASSAGE_CHARS = 8000


def _text(c: str | Column) -> Column:
    return F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(""))


def base_name(path: str | Column) -> Column:
    return F.element_at(F.split(F.regexp_replace(_text(path), "/+$", ""), "/"), -1)


def _prefix(source: str | Column, section: str | Column) -> list[Column]:
    name, title = base_name(source), F.trim(_text(section))
    return [F.when(name != "", F.concat(F.lit(SOURCE_TAG + " "), name)), F.when(title != "", F.concat(F.lit(SECTION_TAG + " "), title))]


def gate_input(source: str | Column, section: str | Column, content: str | Column) -> Column:
    """The text whose vector decides: source, section and content, nothing generated."""
    return F.concat_ws("\n", *_prefix(source, section), _text(content))


def retrieval_input(source: str | Column, section: str | Column, content: str | Column, ctx: str | Column) -> Column:
    """gate_input() with a generated context before the content, where there is one."""
    more = F.trim(_text(ctx))
    return F.concat_ws("\n", *_prefix(source, section), F.when(more != "", F.concat(F.lit(CTX_TAG + " "), more)), _text(content))


def body(content: str | Column, heading: str | Column, overlap: str | Column) -> Column:
    """The content without its heading and overlap; as it is where their lengths cannot be right."""
    c = _text(content)
    n = F.coalesce(F.col(heading) if isinstance(heading, str) else heading, F.lit(0)) + F.coalesce(F.col(overlap) if isinstance(overlap, str) else overlap, F.lit(0))
    return F.when((n < 0) | (n > F.length(c)), c).otherwise(F.substring(c, n.cast("int") + 1, F.length(c)))


def lexical_text(source: str | Column, section: str | Column, text: Column, ctx: str | Column | None = None) -> Column:
    """What the lexical index holds: section, source, the context if there is one, and the body."""
    plain = F.concat_ws(" ", _text(section), _text(source), text)
    return plain if ctx is None else F.when(F.trim(_text(ctx)) != "", F.concat_ws(" ", _text(section), _text(source), F.trim(_text(ctx)), text)).otherwise(plain)


def passage(source: str | Column, section: str | Column, content: str | Column, ctx: str | Column | None = None, limit: int = PASSAGE_CHARS) -> Column:
    """What a reranker reads of a chunk; limit is the reranker's bound on content."""
    more = F.trim(_text(ctx)) if ctx is not None else F.lit("")
    return F.concat(F.lit("Source: "), _text(source), F.lit("\nSection: "), _text(section), F.when(more != "", F.concat(F.lit("\nContext: "), more)).otherwise(F.lit("")), F.lit("\n"), F.left(_text(content), F.lit(limit)))


def fields(*labelled: tuple[str, str | Column]) -> Column:
    """The texts that are not empty, in order, each behind its label."""
    parts = [F.when(F.trim(_text(c)) != "", F.concat(F.lit(f"{label} " if label else ""), F.trim(_text(c)))) for label, c in labelled]
    return F.filter(F.array(*parts), lambda x: x.isNotNull())


def render(parts: Column, limit: int | Column) -> Column:
    """parts joined by blanks under a budget: a part is cut where it ends, and each costs a blank more."""
    most = F.lit(limit) if isinstance(limit, int) else limit
    start = F.struct(F.lit("").alias("s"), F.lit(0).cast("int").alias("used"))

    def step(acc: Column, x: Column) -> Column:
        left = (most - acc["used"]).cast("int")
        piece = F.left(x, left)
        return F.when(left <= 0, acc).otherwise(F.struct(F.concat(acc["s"], F.when(acc["used"] > 0, " ").otherwise(""), piece).alias("s"), (acc["used"] + F.length(piece) + 1).cast("int").alias("used")))

    return F.aggregate(parts, start, step, lambda acc: acc["s"])


def upgraded(types: Column) -> Column:
    """The type of merged chunks: warning before spec before others, else the first."""
    return F.when(F.array_contains(types, "warning"), "warning").when(F.array_contains(types, "spec"), "spec").otherwise(F.get(types, F.lit(0)))


def generative(origin: str | Column, structured: str | Column) -> Column:
    """Chunks that a vision model made, and structured figures, are never given a context."""
    s = F.col(structured) if isinstance(structured, str) else structured
    return _text(origin).isin(VISION_ORIGINS + FIGURE_ORIGINS) | F.coalesce(s, F.lit(False))


def origin_label(origin: str | Column, variant: str | Column) -> Column:
    """(label, vision): where a chunk comes from, for its reader."""
    o = _text(origin)
    native = _text(variant) == "native"
    label = F.when(o.isin(VISION_ORIGINS), F.concat(F.lit("VL ("), o, F.lit(")"))).when(o.isin(FIGURE_ORIGINS) & native, F.concat(o, F.lit(" (native)"))).when(o.isin(FIGURE_ORIGINS), F.concat(F.lit("VL ("), o, F.lit(")"))).otherwise(o)
    return F.struct(label.alias("label"), (o.isin(VISION_ORIGINS) | (o.isin(FIGURE_ORIGINS) & ~native)).alias("vision"))


def prefix_kind(content: str | Column, section: str | Column, heading: str | Column) -> Column:
    """Where a chunk's section is marked: in a prefix, in one that names another section, in its metadata only, or nowhere."""
    n = F.coalesce(F.col(heading) if isinstance(heading, str) else heading, F.lit(0)).cast("int")
    title = _text(section)
    named = F.contains(F.left(_text(content), n), F.concat(F.lit("[SECTION] "), title))
    return F.when((n > 0) & (title != "") & ~named, "inconsistent").when(n > 0, "prefixed").when(title != "", "section only").otherwise("none")
