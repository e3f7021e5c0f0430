"""Column expressions over identifiers, signatures, tables in text and small records."""

from __future__ import annotations

import hashlib
import re
import struct

from pyspark.sql import Column
from pyspark.sql import functions as F

from quarry import config
from quarry.functions import text


def query_terms(c: Column, most: int = 12) -> Column:
    """First distinct identifiers of three characters and CJK runs of two, without stopwords."""
    stop = F.array(*map(F.lit, config.CODE_STOPWORDS))
    raw = F.transform(text.all_matches(c, "[A-Za-z_][A-Za-z0-9_]*|[\\u3400-\\u9fff]{2,}"), F.lower)
    return F.slice(F.array_distinct(F.filter(raw, lambda t: (t.rlike("^[\\u3400-\\u9fff]") | (F.length(t) >= 3)) & ~F.array_contains(stop, t))), 1, most)


def identifier_parts(c: Column) -> Column:
    """The identifier in lower case with its snake, camel and number parts of two characters or more."""
    parts = F.concat(F.split(c, "_"), text.all_matches(c, "[A-Z]?[a-z]+|[A-Z]+(?=[A-Z]|$)|[0-9]+"))
    return F.array_distinct(F.concat(F.array(F.lower(c)), F.transform(F.filter(parts, lambda p: F.length(p) >= 2), F.lower)))


def token_match(tokens: Column, name: Column, context: Column) -> Column:
    """1.0 if a token is the name; else the share of tokens among its parts plus 0.3 of the share in the context, at most 1."""
    low = F.transform(tokens, F.lower)
    n = F.greatest(F.size(low), F.lit(1))
    target = F.size(F.array_intersect(low, identifier_parts(name))) / n
    around = F.size(F.array_intersect(low, F.transform(text.all_matches(context, "[A-Za-z_][A-Za-z0-9_]*"), F.lower))) / n
    return F.when(F.size(low) == 0, 0.0).when(F.array_contains(low, F.lower(name)), 1.0).otherwise(F.least(F.lit(1.0), target + 0.3 * around))


def hybrid_score(dense: Column, lexical: Column, kind: Column, explicit: Column, n_tokens: Column, any_lexical: Column) -> Column:
    """0.95 for an explicit mention; 0.9 and more for strong lexical matches; else half and half, or dense alone if nothing matches at all."""
    fused = F.when(any_lexical, 0.5 * dense + 0.5 * lexical).otherwise(dense) + F.when(kind == "function", 0.05).otherwise(0.0)
    return F.when(explicit, 0.95).when((lexical >= 0.8) & (n_tokens >= 2), 0.9 + 0.1 * lexical).otherwise(fused)


def signature_types(c: Column) -> Column:
    """Parameter types of a C-like signature, without names and blanks."""
    inner = F.regexp_extract(c, r"\(([^()]*)\)", 1)
    types = F.transform(F.split(inner, ","), lambda p: F.regexp_replace(F.regexp_replace(F.trim(p), r"(?<=[\w\s\*&])\b\w+\s*$", ""), r"\s+", ""))
    return F.when(F.trim(inner).isin("", "void"), "").otherwise(F.array_join(types, ","))


def escape_cell(c: Column) -> Column:
    return F.replace(F.replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), F.lit("|"), F.lit("\\|")), F.lit("\n"), F.lit("\\n"))


def markdown_row(c: Column) -> Column:
    """Cells of a table row, cut at pipes that are not escaped."""
    inner = F.regexp_replace(F.trim(c), r"^\||(?<!\\)\|$", "")
    return F.transform(F.split(inner, r"(?<!\\)\|"), lambda x: F.trim(F.replace(x, F.lit("\\|"), F.lit("|"))))


def longest_overlap(a: Column, b: Column, most: int) -> Column:
    """The largest k up to most for which the last k of a are the first k of b."""
    top = F.least(F.size(a), F.size(b), F.lit(most))
    ks = F.when(top > 0, F.sequence(top, F.lit(1), F.lit(-1))).otherwise(F.array().cast("array<int>"))
    return F.coalesce(F.get(F.filter(ks, lambda k: F.slice(a, -k, k) == F.slice(b, F.lit(1), k)), F.lit(0)), F.lit(0))


def compare_text(a: Column, b: Column) -> Column:
    """match, glyph (as long, some characters differ), structural (another length) or unmappable (nothing to compare)."""
    x, y = text.collapse_blanks(a), text.collapse_blanks(b)
    return F.when(x.isNull() | y.isNull() | (y == ""), "unmappable").when(x == y, "match").when(F.length(x) == F.length(y), "glyph").otherwise("structural")


def diff_positions(a: Column, b: Column) -> Column:
    """Positions from 0 at which two strings of one length differ."""
    n = F.length(a)
    at = F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
    return F.when(n == F.length(b), F.filter(at, lambda k: F.substring(a, k + 1, F.lit(1)) != F.substring(b, k + 1, F.lit(1))))


def sanitize(c: Column, most: int) -> Column:
    """Without control characters, runs of blanks and outer quotes; cut at a sentence end past the half, if there is one."""
    s = F.regexp_replace(F.trim(F.regexp_replace(F.regexp_replace(c, r"[\x00-\x08\x0b-\x1f\x7f]", ""), r"\s+", " ")), "^[\"'“”「」]+|[\"'“”「」]+$", "")
    head = F.left(s, F.lit(most))
    sentence = F.regexp_extract(head, r"^(.*[.。!?！？])", 1)
    return F.when(F.length(s) <= most, s).when(F.length(sentence) >= most / 2, sentence).otherwise(head)


def window_tokens(context: Column, template: Column, chunk: Column) -> Column:
    return F.floor(context * 0.8).cast("long") - template - chunk - config.DEFAULT.reserve_tokens


def image_tokens(width: Column, height: Column, patch: int = 28) -> Column:
    return F.ceil(width / patch) * F.ceil(height / patch)


def next_rule_id(ids: Column) -> Column:
    """L-001 and on: one above the largest; an aggregate over the ids."""
    return F.format_string("L-%03d", F.coalesce(F.max(F.regexp_extract(ids, r"L-(\d+)", 1).cast("int")), F.lit(0)) + 1)


def pseudo_embedding(value: str, size: int = 64) -> list[float]:
    """A fixed vector in [-1, 1) for a text, from counted SHA-256 digests; stands in for a model in tests."""
    raw, k = b"", 0
    while len(raw) < 4 * size:
        raw += hashlib.sha256(f"{k}:{value}".encode()).digest()
        k += 1
    return [x / 2**31 - 1 for x in struct.unpack(f"<{size}I", raw[: 4 * size])]


def pseudo_vector(c: Column, size: int = 64) -> Column:
    """pseudo_embedding() of a column, inside the JVM."""
    digests = F.transform(F.sequence(F.lit(0), F.lit(-(-size // 8) - 1)), lambda k: F.sha2(F.concat(k.cast("string"), F.lit(":"), F.coalesce(c, F.lit(""))), 256))

    def number(h: Column, k: Column) -> Column:
        pair = lambda n: F.substring(h, k * 8 + n, F.lit(2))
        return F.conv(F.concat(pair(7), pair(5), pair(3), pair(1)), 16, 10).cast("double") / 2.0**31 - 1

    eight = F.sequence(F.lit(0), F.lit(7))
    return F.slice(F.flatten(F.transform(digests, lambda h: F.transform(eight, lambda k: number(h, k)))), 1, size)


_C = re.compile(r"\"(?:\\.|[^\"\\\n])*\"|'(?:\\.|[^'\\\n])*'|//[^\n]*|/\*.*?(?:\*/|\Z)", re.S)


def strip_c_comments(source: str) -> str:
    """Without comments; strings and line ends stay."""
    return _C.sub(lambda m: m[0] if m[0][0] in "\"'" else "\n" * m[0].count("\n") or " ", source)


# strings, comments, and what stands between; possessive, so that long strings need no stack
_PIECES = r"\"[^\"\\\n]*+(?:\\.[^\"\\\n]*+)*+\"|'[^'\\\n]*+(?:\\.[^'\\\n]*+)*+'|//[^\n]*+|/\*[\s\S]*?(?:\*/|\z)|[^\"'/]++|[\"'/]"


def without_c_comments(c: Column) -> Column:
    """strip_c_comments() of a column, inside the JVM."""
    lines = lambda x: F.regexp_replace(x, r"[^\n]+", "")
    kept = F.transform(text.all_matches(c, _PIECES), lambda x: F.when(x.rlike(r"^/[/*]"), F.when(lines(x) == "", " ").otherwise(lines(x))).otherwise(x))
    return F.array_join(kept, "")
