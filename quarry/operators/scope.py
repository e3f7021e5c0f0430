"""Which files belong to an index: ignore rules, directory verdicts that descendants inherit, kinds of files, and encodings."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quarry.sources.readers import glob_pattern
from quarry.sources.readers import strings as readers_strings

# Directories and files that are never read, and dot directories that are.
IGNORED_DIRS = [
    ".git", "__pycache__", ".venv", "venv", "node_modules", ".idea", ".vscode", "build", "dist", ".cache", ".tox", "eggs", "htmlcov",
    ".pytest_cache", ".mypy_cache", "third_party", "3rdparty", "external", "vendor",
]
IGNORED_FILES = [
    "license", "license.txt", "license.md", "copying", "changelog", "changelog.md", "changelog.txt", "authors", "contributors",
    "maintainers", "news", "history", "todo",
]
IGNORED_PATTERNS = ["*.bak", "*.orig", "*.swp", "*.tmp", "*.min.js", "*.min.css", "*.map"]
ALLOWED_DOT_DIRS = [".github", ".gitlab", ".circleci", ".gitlab-ci", ".travis", ".azure-pipelines", ".husky"]
# Directories of installed packages, which only the index leaves out.
INDEX_ONLY_DIRS = ["site-packages", "dist-packages"]
EGG_INFO = ".egg-info"
# Patterns of files that rank lower.
LOW_PRIORITY = ["*_test.cpp", "*_test.c", "*_test.py", "*_test.go", "test_*.py", "*_unittest.*", "*_mock.*", "*_stub.*"]
# Suffixes by kind, and names of build files without one.
CODE = ["c", "h", "cpp", "cc", "cxx", "hpp", "hh", "hxx", "py", "pyx", "pyi", "rs", "go", "java", "kt", "js", "ts", "jsx", "tsx"]
FIRMWARE = ["s", "asm", "inc", "def"]
LINKER = ["ld", "lds"]
DEVICETREE = ["dts", "dtsi"]
CONFIG = ["json", "yaml", "yml", "toml", "sh", "bash", "mk", "cmake", "tcl", "cfg", "ini", "conf"]
DOCS = ["txt", "md"]
BUILD_NAMES = ["Makefile", "makefile", "GNUmakefile", "Kconfig"]
BUILD_PREFIXES = ["Makefile.", "makefile.", "Kconfig."]


def _p(path: str | Column) -> Column:
    return F.col(path) if isinstance(path, str) else path


def name_of(path: str | Column) -> Column:
    return F.element_at(F.split(_p(path), "/"), -1)


def suffix(path: str | Column) -> Column:
    return F.lower(F.regexp_extract(name_of(path), r".\.([^.]+)$", 1))


def is_build_file(path: str | Column) -> Column:
    """Makefiles and their like, which have no suffix to tell them by."""
    n = name_of(path)
    out = n.isin(BUILD_NAMES)
    for p in BUILD_PREFIXES:
        out = out | n.startswith(p)
    return out


def is_indexable(path: str | Column) -> Column:
    return suffix(path).isin(CODE + FIRMWARE + LINKER + DEVICETREE + CONFIG + DOCS) | is_build_file(path)


def enters_symbol_scan(path: str | Column) -> Column:
    """Whether a file is parsed for symbols; the others are found by their text only."""
    return ~is_build_file(path) & ~suffix(path).isin(DOCS + FIRMWARE + LINKER + DEVICETREE)


def line_search_globs() -> list[str]:
    """Globs of a line search: suffixes, upper-case ones of assembly, and build files."""
    every = [f"*.{s}" for s in sorted(CODE + FIRMWARE + LINKER + DEVICETREE + CONFIG + DOCS)]
    return list(dict.fromkeys([*every, *[f"*.{s.upper()}" for s in sorted(FIRMWARE)], *sorted(BUILD_NAMES), *[f"{p}*" for p in sorted(BUILD_PREFIXES)]]))


def matches_globs(path: str | Column, globs: list[str]) -> Column:
    """Whether the path's name matches one of the globs, letters as they are."""
    return name_of(path).rlike("|".join("^" + re.escape(g).replace(r"\*", ".*").replace(r"\?", ".") + "$" for g in globs))


def is_ignored_file(path: str | Column) -> Column:
    low = F.lower(_p(path))
    n = name_of(low)
    stem = F.regexp_replace(n, r"(.)\.[^.]+$", "$1")
    return n.isin(IGNORED_FILES) | stem.isin(IGNORED_FILES) | matches_globs(low, IGNORED_PATTERNS)


def is_ignored_dir(path: str | Column) -> Column:
    """Whether a part of a directory's path is ignored, or a dot directory that is not allowed."""
    parts = F.filter(F.split(_p(path), "/"), lambda x: x != "")
    return F.exists(parts, lambda x: F.lower(x).isin(IGNORED_DIRS) | (x.startswith(".") & ~F.lower(x).isin(ALLOWED_DOT_DIRS)))


def literal_prefix(pattern: str) -> str | None:
    """The part of an anchored pattern before its first wildcard segment; none if nothing can be pruned by it."""
    body = pattern.strip("/")
    if "/" not in body and not pattern.startswith("/"):
        return None
    fixed = []
    for part in body.split("/"):
        if any(c in part for c in "*?["):
            break
        fixed.append(part)
    return "/".join(fixed) or None


@dataclass(frozen=True)
class Scope:
    """Include and exclude patterns of a project."""

    include: list[str] = field(default_factory=list)
    exclude: list[str] = field(default_factory=list)

    def fingerprint(self) -> Column:
        """Changes with any rule that decides membership."""
        rules = [self.include, self.exclude, IGNORED_DIRS, IGNORED_FILES, IGNORED_PATTERNS, INDEX_ONLY_DIRS, CODE + FIRMWARE + LINKER + DEVICETREE + CONFIG + DOCS, BUILD_NAMES + BUILD_PREFIXES]
        return F.sha2(F.to_json(F.array(*[F.array(*map(F.lit, sorted(r))) if r else F.array().cast("array<string>") for r in rules])), 256)


def config_for(roots: DataFrame, configs: DataFrame) -> DataFrame:
    """roots (root) with the config (prefix, name) of the longest prefix that holds the root; null without any."""
    r = roots.withColumn("_r", F.concat(F.regexp_replace("root", "/+$", ""), F.lit("/")))
    prefixes = r.withColumn("_p", F.explode(F.transform(ancestors(F.regexp_replace("_r", "/$", "")), lambda x: x)))
    c = configs.select(F.regexp_replace("prefix", "/+$", "").alias("_p"), "name")
    return prefixes.join(c, "_p", "left").groupBy("root").agg(F.max_by("name", F.when(F.col("name").isNotNull(), F.length("_p"))).alias("name"))


def _hit(path: Column, globs: list[str]) -> Column:
    return path.rlike("|".join(glob_pattern(g) for g in globs)) if globs else F.lit(False)


def dir_rule(path: str | Column) -> Column:
    """The rule that rejects a directory for itself: an index-only name or an egg's, else null."""
    n = F.lower(name_of(path))
    return F.when(n.endswith(EGG_INFO), "B2").when(n.isin(INDEX_ONLY_DIRS), "A'")


def ancestors(path: Column) -> Column:
    """A directory path and all that hold it."""
    parts = F.split(path, "/")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.array_join(F.slice(parts, F.lit(1), k), "/"))


def decide_dirs(dirs: DataFrame, scope: Scope, marked: DataFrame | None = None) -> DataFrame:
    """(path, decision, rule): INDEX, TRAVERSE_ONLY or PRUNE for each directory path.

    marked (path) are directories that hold the marker of an environment. A rejection is inherited by all below; an
    include pattern that could match inside lets the walk through, except into ignored directories.
    """
    chain = dirs.select("path").distinct().withColumn("_a", F.explode(ancestors(F.col("path"))))
    own = F.coalesce(dir_rule("_a"), F.when(_hit(F.concat("_a", F.lit("/")), scope.exclude) | _hit(F.col("_a"), scope.exclude), "C"))
    if marked is not None:
        chain = chain.join(marked.select(F.col("path").alias("_a"), F.lit(True).alias("_m")).distinct(), "_a", "left")
        own = F.coalesce(F.when(F.col("_m"), "B1"), own)
    verdict = chain.withColumn("_r", own).groupBy("path").agg(F.min_by("_r", F.when(F.col("_r").isNotNull(), F.length("_a"))).alias("rule"))
    prefixes = [literal_prefix(g) for g in scope.include]
    if None in prefixes:
        reach = F.lit(True)
    else:
        reach = F.lit(False)
        for p in prefixes:
            inside = F.lit(p + "/")
            reach = reach | F.startswith(F.concat("path", F.lit("/")), inside) | F.startswith(inside, F.concat("path", F.lit("/")))
    decision = F.when(is_ignored_dir("path"), "PRUNE").when(F.col("rule").isNull(), "INDEX").when(reach, "TRAVERSE_ONLY").otherwise("PRUNE")
    return verdict.select("path", decision.alias("decision"), "rule")


def members(files: DataFrame, scope: Scope, marked: DataFrame | None = None) -> DataFrame:
    """files (path) that belong to the index: hard gates, then includes, then excludes, then what directories inherit."""
    parent = F.regexp_replace("path", "/?[^/]*$", "")
    n = name_of("path")
    gates = ~n.startswith(".") & is_indexable("path") & ~is_ignored_file("path") & ~is_ignored_dir(parent)
    open_ = files.where(gates).withColumn("_dir", parent)
    dirs = decide_dirs(open_.where("_dir <> ''").select(F.col("_dir").alias("path")), Scope(), marked).where("rule IS NOT NULL").select(F.col("path").alias("_dir"), F.lit(True).alias("_out"))
    judged = open_.join(dirs, "_dir", "left")
    keep = F.when(_hit(F.col("path"), scope.include), True).when(_hit(F.col("path"), scope.exclude), False).otherwise(F.col("_out").isNull())
    return judged.where(keep).drop("_dir", "_out")


def rule_counts(decisions: DataFrame) -> DataFrame:
    """(rule, dirs): how often rules struck; never a path."""
    return decisions.where("rule IS NOT NULL").groupBy("rule").agg(F.count("*").alias("dirs"))


def listing(files: DataFrame, depth: int) -> DataFrame:
    """(path, depth, files): directories down to a depth with the number of files anywhere below, in path order."""
    dirs = files.select(F.explode(ancestors(F.regexp_replace("path", "/?[^/]*$", ""))).alias("dir")).where("dir <> ''")
    return dirs.groupBy(F.col("dir").alias("path")).agg(F.count("*").alias("files")).withColumn("depth", F.size(F.split("path", "/"))).where(F.col("depth") <= depth)


def snapshot(files: DataFrame, small: int = 256 << 10) -> DataFrame:
    """(path, hash) of files (path, length, modified, content): of a small file's content, of a large one's size and time."""
    by_stat = F.md5(F.concat_ws(":", F.col("length").cast("string"), F.unix_micros("modified").cast("string")).cast("binary"))
    return files.select("path", F.when(F.col("length") <= small, F.md5(F.col("content").cast("binary"))).otherwise(by_stat).alias("hash"))


def encoding(head: str | Column) -> Column:
    """The text encoding of a file's first bytes: by mark, by the zeros of UTF-16, as strict UTF-8, or mostly ASCII; null for binary."""
    b = _p(head)
    hexed = F.hex(b)
    n = F.octet_length(b)
    latin = F.decode(b, "ISO-8859-1")
    even, odd = (F.regexp_replace(latin, "(?s)(.).?" if k == 0 else "(?s).(.?)", "$1") for k in (0, 1))
    zeros = lambda s: F.length(s) - F.length(F.regexp_replace(s, "\\x00", ""))
    plain = lambda s: F.length(F.regexp_replace(s, r"[^\x20-\x7e\t\n\r]", ""))
    share = lambda f, s: F.when(F.length(s) > 0, f(s) / F.length(s)).otherwise(0.0)
    marks = F.when(n == 0, "utf-8").when(hexed.startswith("EFBBBF"), "utf-8-sig").when(hexed.startswith("FFFE0000") | hexed.startswith("0000FEFF"), "utf-32").when(hexed.startswith("FFFE") | hexed.startswith("FEFF"), "utf-16")
    wide = marks.when(zeros(latin) > 0, F.when((share(zeros, odd) > 0.7) & (share(plain, even) > 0.7), "utf-16-le").when((share(zeros, even) > 0.7) & (share(plain, odd) > 0.7), "utf-16-be"))
    # a character that the end cuts off is no fault
    tail = r"(?:[\xc2-\xdf]|[\xe0-\xef][\x80-\xbf]?|[\xf0-\xf4][\x80-\xbf]{0,2})$"
    cut = F.encode(F.regexp_replace(latin, tail, ""), "ISO-8859-1")
    valid = F.is_valid_utf8(b.cast("string")) | F.is_valid_utf8(cut.cast("string"))
    text = F.when(F.is_valid_utf8(b.cast("string")), b.cast("string")).otherwise(cut.cast("string"))
    shown = F.length(F.regexp_replace(text, r"[\p{Cc}\p{Cs}\p{Co}\p{Cn}&&[^\t\n\r]]", "")) / F.greatest(F.length(text), F.lit(1))
    return wide.when(valid, F.when(shown >= 0.9, "utf-8")).when(share(plain, latin) >= 0.9, "utf-8")


def priority_strings(rows: DataFrame) -> DataFrame:
    """(path, offset, value) of strings (path, offset, value) that tell of versions and builds, each value of a file once."""
    # Words that make a string important.
    words = ["version", "compiled", "gcc", "clang", "llvm", "build", "built", "u-boot", "linux", "kernel", "firmware"]
    s = rows.withColumn("value", F.trim("value"))
    high = F.lower("value").rlike("|".join(words)) | F.col("value").rlike(r"\b20(1[5-9]|2\d)\b")
    w = Window.partitionBy("path", "value").orderBy("offset")
    return s.where(is_meaningful("value") & high).withColumn("_n", F.row_number().over(w)).where("_n = 1").select("path", "offset", "value")


def is_meaningful(c: str | Column) -> Column:
    """Six characters or more, a letter among them, and most of them printable."""
    s = F.trim(_p(c))
    return (F.length(s) >= 6) & s.rlike(r"\p{L}") & (F.length(F.regexp_replace(s, r"[^\x20-\x7e]", "")) / F.length(s) >= 0.7)


# The largest binary file, words of strings about versions and builds, and most strings of either section.
MOST_BYTES = 50 * 1024 * 1024
BUILD_WORDS = ["version", "compiled", "gcc", "clang", "llvm", "build", "built", "u-boot"]
SECTIONS = {"build": 50, "boot": 20}


def string_report(files: DataFrame, most: int = 200, max_bytes: int = MOST_BYTES) -> DataFrame:
    """(path, section, place, offset, value, found): the strings of binary files that are worth a look, in order of offset.

    Sections: build (versions and compilers), boot, and other; at most 50, 20 and what is left of `most` strings, with how many
    there are in found. A file of over max_bytes is one row of the section too_large, with its size in found; where files have
    their length as a column, as binary_files() gives it, such a file is not read.
    """
    size = F.col("length") if "length" in files.columns else F.octet_length("content").cast("long")
    small = size <= max_bytes
    large = files.where(~small).select("path", F.lit("too_large").alias("section"), F.lit(0).alias("place"), F.lit(None).cast("long").alias("offset"), F.lit(None).cast("string").alias("value"), size.alias("found"))
    s = readers_strings(files.where(small)).where((F.col("encoding") == "ascii") & is_meaningful("value")).select("path", "offset", F.trim("value").alias("value"))
    build = F.lower("value").rlike("|".join(BUILD_WORDS)) | F.col("value").rlike(r"\b20(1[5-9]|2\d)\b")
    s = s.withColumn("section", F.when(build, "build").when(F.contains(F.lower("value"), F.lit("boot")), "boot").otherwise("other"))
    n = s.groupBy("path", "section").agg(F.count("*").alias("found"))
    used = n.groupBy("path").agg(*[F.coalesce(F.sum(F.when(F.col("section") == k, F.least("found", F.lit(v)))), F.lit(0)).alias(k) for k, v in SECTIONS.items()])
    place = F.row_number().over(Window.partitionBy("path", "section").orderBy("offset"))
    room = F.when(F.col("section") == "other", F.lit(most) - F.col("build") - F.col("boot"))
    for k, v in SECTIONS.items():
        room = room.when(F.col("section") == k, min(v, most))
    rows = s.withColumn("place", place).where(F.col("place") <= most).join(n, ["path", "section"]).join(used, "path").where(F.col("place") <= room)
    return rows.select("path", "section", "place", "offset", "value", "found").unionByName(large)
