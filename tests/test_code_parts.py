"""Expressions inside the JVM against their plain versions, and the string section of binary files."""

from __future__ import annotations

import random
import re

from pyspark.sql import functions as F

from quarry.functions import code
from quarry.operators import scope


def test_comments_and_vectors_as_columns(spark):
    rng = random.Random(2)
    parts = ['"a // b"', "'/*'", '"\\""', "// c\n", "/* d\n e */", "/* open", "x / y", "\n", '"broken\n', "'", "\\", "*/"]
    rows = [(k, "".join(rng.choice(parts) for _ in range(rng.randrange(9)))) for k in range(400)] + [(999, '"' + "\\n" * 50_000 + '" // end')]
    got = {r["k"]: (r["s"], r["v"]) for r in spark.createDataFrame(rows, "k long, t string").select("k", code.without_c_comments(F.col("t")).alias("s"), code.pseudo_vector(F.col("t"), 13).alias("v")).collect()}
    for k, s in rows:
        assert got[k][0] == code.strip_c_comments(s) and got[k][1] == code.pseudo_embedding(s, 13)


def test_string_report_against_a_plain_scan(spark):
    rng = random.Random(3)
    words = [b"gcc version 9", b"reboot now", b"plain text %d", b"built 2021", b"short", b"123456789", b"U-BOOT loader"]
    files = [(f"f{k}", b"\x00".join(rng.choice(words) + b" " + str(rng.randrange(99)).encode() for _ in range(300))) for k in range(3)] + [("big", b"x" * 20_000), ("none", b"\x00\x01")]
    got = scope.string_report(spark.createDataFrame(files, "path string, content binary"), 100, 15_000).collect()
    for path, content in files:
        own = sorted((r["section"], r["place"], r["offset"], r["value"], r["found"]) for r in got if r["path"] == path)
        if len(content) > 15_000:
            assert own == [("too_large", 0, None, None, len(content))]
            continue
        found = {"build": [], "boot": [], "other": []}
        for m in re.finditer(rb"[\x20-\x7e]{6,}", content):
            s = m[0].decode().strip()
            if len(s) < 6 or not re.search("[A-Za-z]", s):
                continue
            low = s.lower()
            kind = "build" if any(w in low for w in scope.BUILD_WORDS) or re.search(r"\b20(1[5-9]|2\d)\b", s) else "boot" if "boot" in low else "other"
            found[kind].append((m.start(), s))
        room = {"build": 50, "boot": 20}
        room["other"] = 100 - sum(min(len(found[k]), n) for k, n in room.items())
        assert own == sorted((k, n + 1, at, s, len(v)) for k, v in found.items() for n, (at, s) in enumerate(v[: room[k]]))
