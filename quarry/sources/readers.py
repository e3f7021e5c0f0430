"""Scans: text files, binary reports, JSON lines, code trees and line search."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quarry.config import DEFAULT
from quarry.shipping import ensure_importable

INTERACTION = "timestamp string, question string, question_type string, answer string, refs array<struct<source:string,score:double,content:string>>, rating int, metadata map<string,string>"
# Signatures of file formats, as hex.
MAGICS = {"7f454c46": "ELF", "89504e470d0a1a0a": "PNG", "ffd8ff": "JPEG", "504b0304": "ZIP", "1f8b08": "GZIP", "25504446": "PDF", "4d5a": "PE", "cafebabe": "CLASS", "28b52ffd": "ZSTD", "fd377a585a00": "XZ", "27051956": "UIMAGE", "d00dfeed": "DTB"}
#: First bytes of a file that are searched for signatures.
SCAN = 1 << 16
# Suffixes of source files by the parser they go to.
ROUTES = {"python": ["py"], "c_family": ["c", "h", "cc", "cpp", "hpp"], "script": ["js", "jsx", "mjs", "ts", "tsx"], "go": ["go"], "rust": ["rs"], "jvm": ["java", "kt"], "doc": ["md", "txt", "rst"], "firmware": ["s", "ld", "dts", "dtsi", "cfg"]}


def text_files(spark: SparkSession, path: str) -> DataFrame:
    """(path, content) of whole text files."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("content"))


def binary_files(spark: SparkSession, path: str, glob: str | None = None) -> DataFrame:
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    return (reader.option("pathGlobFilter", glob) if glob else reader).load(path)


def heads(spark: SparkSession, path: str, size: int, glob: str | None = None) -> DataFrame:
    """(path, length, head): the first size bytes of files of any length, compressed ones (by their suffix) aside.

    Files are read in splits as lines of bytes, whose starts add up, so that no task reads a large file whole.
    """
    listed = binary_files(spark, path, glob).select(F.col("_metadata.file_path").alias("path"), "length")
    reader = spark.read.format("text").option("recursiveFileLookup", "true").option("lineSep", "\n")
    lines = (reader.option("pathGlobFilter", glob) if glob else reader).load(path)
    first = lines.where(F.col("_metadata.file_block_start") < size).select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("_block"), F.col("value").alias("line")).withColumn("_at", F.monotonically_increasing_id())
    before = Window.partitionBy("path").orderBy("_block", "_at").rowsBetween(Window.unboundedPreceding, -1)
    cut = first.select("path", "_block", "_at", F.octet_length("line").alias("_n"), F.substring(F.col("line").cast("binary"), 1, size).alias("line"))
    kept = cut.withColumn("_start", F.coalesce(F.sum(F.col("_n") + 1).over(before), F.lit(0))).where(F.col("_start") < size)
    whole = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_start", F.col("line").cast("string").alias("line")))), lambda x: x["line"]), "\n")
    # the last line's own end is no byte of a line; it is there unless the file ends without one
    text = kept.groupBy("path").agg(F.concat(whole, F.lit("\n")).cast("binary").alias("head"))
    return listed.join(text, "path", "left").select("path", "length", F.coalesce(F.substring("head", F.lit(1), F.least("length", F.lit(size)).cast("int")), F.lit(b"")).alias("head"))


def interactions(spark: SparkSession, path: str) -> DataFrame:
    """JSON lines; malformed ones are passed over."""
    return spark.read.schema(INTERACTION).option("mode", "DROPMALFORMED").json(path)


def suffix(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1))


def parser_route(path: Column) -> Column:
    out = F.when(path.rlike(r"(^|/)(Makefile|Kconfig)[^/]*$"), "build")
    for route, suffixes in ROUTES.items():
        out = out.when(suffix(path).isin(suffixes), route)
    return out.otherwise("none")


def glob_pattern(glob: str) -> str:
    """A gitignore-like glob as an anchored regular expression."""
    body = glob.rstrip("/").lstrip("/")
    out, k = "", 0
    while k < len(body):
        if body.startswith("**/", k):
            out, k = out + "(?:.*/)?", k + 3
        elif body.startswith("**", k):
            out, k = out + ".*", k + 2
        elif body[k] == "*":
            out, k = out + "[^/]*", k + 1
        elif body[k] == "?":
            out, k = out + "[^/]", k + 1
        elif body[k] == "[" and "]" in body[k:]:
            end = body.index("]", k)
            out, k = out + "[" + body[k + 1 : end].replace("!", "^", 1) + "]", end + 1
        else:
            out, k = out + re.escape(body[k]), k + 1
    lead = "^" if glob.startswith("/") or "/" in body else "(?:^|.*/)"
    return f"{lead}{out}{'/.*' if glob.endswith('/') else '(?:/.*)?'}$"


def in_scope(path: Column, include: list[str], exclude: list[str]) -> Column:
    """Included paths win over excluded ones; others are in scope."""
    hit = lambda globs: path.rlike("|".join(glob_pattern(g) for g in globs)) if globs else F.lit(False)
    return F.when(hit(include), True).otherwise(~hit(exclude))


def grep(lines: DataFrame, pattern: str, context: int, key: str, literal: bool = False) -> DataFrame:
    """(key, line_no, line, hit): matching lines and those within context of one, found by one sort per key.

    A pattern with nested repeats, which could run away, is searched as a literal.
    """
    if literal or re.search(r"\([^)]*[+*][^)]*\)[+*]", pattern):
        pattern = re.escape(pattern)
    w = Window.partitionBy(key).orderBy("line_no")
    hit = F.col("line").rlike(pattern)
    near = F.max(F.col("hit").cast("int")).over(w.rowsBetween(-context, context))
    return lines.withColumn("hit", hit).withColumn("_near", near).where("_near = 1").drop("_near")


def within_budget(lines: DataFrame, key: str, order: list[str], line_chars: int = DEFAULT.grep_line_chars, total: int = DEFAULT.grep_total_chars) -> DataFrame:
    """Lines cut to line_chars, as long as a key's running total fits."""
    cut = lines.withColumn("line", F.left("line", F.lit(line_chars)))
    w = Window.partitionBy(key).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return cut.withColumn("_sum", F.sum(F.length("line") + 1).over(w)).where(F.col("_sum") <= total).drop("_sum")


def line_window(lines: DataFrame, first: int, last: int) -> DataFrame:
    return lines.where(F.col("line_no").between(first - 1, last - 1)).select("*", F.concat(F.lpad((F.col("line_no") + 1).cast("string"), 6, " "), F.lit("\t"), F.col("line")).alias("numbered"))


def magics(content: Column, scan: int = SCAN) -> Column:
    """Known signatures in the first bytes as (offset, kind), by offset."""
    hexed = F.hex(F.substring(content, 1, scan))
    at = [F.struct((F.when((F.instr(hexed, m.upper()) % 2) == 1, (F.instr(hexed, m.upper()) - 1) / 2).cast("int")).alias("offset"), F.lit(k).alias("kind")) for m, k in MAGICS.items()]
    return F.array_sort(F.filter(F.array(*at), lambda x: x["offset"].isNotNull()))


def hex_dump(content: Column, rows: int = 16) -> Column:
    """Lines of offset, 16 bytes in hex, and their printable characters."""
    def line(k: Column) -> Column:
        part = F.substring(content, k * 16 + 1, F.lit(16))
        pairs = F.regexp_replace(F.lower(F.hex(part)), "(..)", "$1 ")
        shown = F.regexp_replace(F.decode(part, "ISO-8859-1"), r"[^\x20-\x7e]", ".")
        return F.concat(F.lpad(F.lower(F.hex(k * 16)), 8, "0"), F.lit("  "), F.rpad(pairs, 48, " "), F.lit(" |"), shown, F.lit("|"))

    n = F.least(F.ceil(F.octet_length(content) / 16).cast("int"), F.lit(rows))
    return F.when(n > 0, F.array_join(F.transform(F.sequence(F.lit(0), n - 1), line), "\n")).otherwise("")


def strings(files: DataFrame, least: int = 6) -> DataFrame:
    """(path, offset, encoding, value): printable ASCII and UTF-16LE runs of binary content."""
    ensure_importable(files.sparkSession)
    ascii_, wide = re.compile(rb"[\x20-\x7e]{%d,}" % least), re.compile(rb"(?:[\x20-\x7e]\x00){%d,}" % least)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for path, content in zip(pdf["path"], pdf["content"], strict=True):
                rows += [(path, m.start(), "ascii", m[0].decode()) for m in ascii_.finditer(content or b"")]
                rows += [(path, m.start(), "utf-16le", m[0].decode("utf-16le")) for m in wide.finditer(content or b"")]
            yield pd.DataFrame(rows, columns=["path", "offset", "encoding", "value"])

    return files.select("path", "content").mapInPandas(run, "path string, offset long, encoding string, value string")
