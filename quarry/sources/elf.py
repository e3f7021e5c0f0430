"""ELF files: header, sections and symbols from binary content, symbol listings in text, and families of imports."""

from __future__ import annotations

import re
import struct
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quarry.shipping import ensure_importable

ROWS = "path string, part string, name string, kind string, bind string, address long, size long, section string"
# Fixed values of the format.
MACHINES = {3: "x86", 8: "MIPS", 20: "PowerPC", 40: "ARM", 62: "x86-64", 183: "AArch64", 243: "RISC-V"}
TYPES = {1: "REL", 2: "EXEC", 3: "DYN", 4: "CORE"}
SYMBOL_KINDS = {0: "NOTYPE", 1: "OBJECT", 2: "FUNC", 3: "SECTION", 4: "FILE", 6: "TLS"}
BINDS = {0: "LOCAL", 1: "GLOBAL", 2: "WEAK"}
# Families of imported functions, the first that fits wins.
FAMILIES = {
    "exec/process": r"^(fork|vfork|exec[lv][ep]?e?|system|popen|wait[a-z]*|kill|posix_spawn\w*|clone\d?|setuid|setgid|seteuid|setegid|setresuid|setresgid|chroot|daemon|setsid)$",
    "dynamic_link": r"^(dlopen|dlmopen|dlsym|dlvsym|dlclose|dlerror|dladdr|dlinfo)$",
    "crypto": r"(^MD[245]|^SHA\d+|^AES_|^DES_|^RSA_|^EVP_|^HMAC_|^RAND_|^BN_|^EC_|^X509_|^PEM_|^SSL_|^TLS_|^ENGINE_|^BIO_|^crypto_|^gcry_|^nettle_|^openssl_|^mbedtls_|^wolfSSL_|PKCS[71]|PBKDF)",
    "network": r"^(socket|bind|connect|listen|accept4?|send(to|msg)?|recv(from|msg)?|select|p?poll|epoll_\w+|getaddrinfo|freeaddrinfo|gethostby\w+|inet_\w+|htons|htonl|ntohs|ntohl|getsockopt|setsockopt|shutdown|getpeername|getsockname)$",
    "io/fs": r"^(open(at)?|close|read[v]?|write[v]?|pread\d*|pwrite\d*|lseek\d*|f?stat\d*|lstat\d*|access|faccessat|mkdir(at)?|rmdir|unlink(at)?|rename(at)?|chmod|fchmod(at)?|chown|fchown(at)?|lchown|ioctl|fcntl\d*|dup[23]?|mmap\d*|munmap|msync|mprotect|sync|f?datasync|fsync|opendir|fdopendir|readdir\d*|closedir|truncate\d*|ftruncate\d*|symlink(at)?|readlink(at)?|getcwd|chdir|fchdir|umask|mknod(at)?|flock|fallocate)$",
    "threading": r"^(pthread_|sem_(open|close|wait|post|init|destroy|trywait|timedwait|getvalue|unlink)|mtx_|thrd_|tss_|cnd_|atomic_|__atomic_|__sync_)",
    "memory": r"^(malloc|free|calloc|realloc(array)?|mem(cpy|move|set|cmp|chr|rchr|mem)|brk|sbrk|mremap|posix_memalign|aligned_alloc|valloc|memalign|pvalloc)$",
    "env/sig": r"^(getenv|setenv|unsetenv|putenv|clearenv|signal|sigaction|sigprocmask|sigpending|sigsuspend|sigwait\w*|raise|abort|atexit|on_exit|alarm|setitimer|getitimer)$",
    "printf/str": r"^(printf|fprintf|sprintf|snprintf|vprintf|vsprintf|vsnprintf|asprintf|vasprintf|dprintf|vdprintf|__\w*printf\w*_chk|str(cpy|ncpy|cat|ncat|cmp|ncmp|len|nlen|chr|rchr|str|tok|dup|ndup|casecmp|ncasecmp)|__str\w+_chk)$",
}


def _name(table: bytes, at: int) -> str:
    return table[at : table.find(b"\0", at)].decode("utf-8", "replace") if 0 <= at < len(table) else ""


def parse(path: str, b: bytes) -> list[tuple]:
    """Rows of ROWS: one of the header, then sections, symbols (imports are those without a section) and needed libraries."""
    if len(b) < 52 or b[:4] != b"\x7fELF" or b[4] not in (1, 2) or b[5] not in (1, 2):
        return []
    wide, order = b[4] == 2, "<" if b[5] == 1 else ">"
    try:
        kind, machine, _, entry, _, sh_at, _, _, _, _, sh_size, sh_n, names_at = struct.unpack_from(order + ("HHIQQQIHHHHHH" if wide else "HHIIIIIHHHHHH"), b, 16)
        out = [(path, "header", MACHINES.get(machine, str(machine)), TYPES.get(kind, str(kind)), "64" if wide else "32", entry, len(b), "")]
        heads = []
        for k in range(sh_n):
            f = struct.unpack_from(order + ("IIQQQQIIQQ" if wide else "IIIIIIIIII"), b, sh_at + k * sh_size)
            heads.append({"name": f[0], "type": f[1], "flags": f[2], "addr": f[3], "at": f[4], "size": f[5], "link": f[6], "each": f[9]})
        texts = lambda h: b[h["at"] : h["at"] + h["size"]] if h["type"] != 8 else b""
        table = texts(heads[names_at]) if names_at < len(heads) else b""
        named = [_name(table, h["name"]) for h in heads]
        out += [(path, "section", n, str(h["type"]), "", h["addr"], h["size"], "") for n, h in zip(named, heads, strict=True)]
        for h, n in zip(heads, named, strict=True):
            if h["type"] in (2, 11) and h["link"] < len(heads):
                strings, data, step = texts(heads[h["link"]]), texts(h), 24 if wide else 16
                for k in range(step, len(data) - step + 1, step):
                    if wide:
                        name, info, _, index, value, size = struct.unpack_from(order + "IBBHQQ", data, k)
                    else:
                        name, value, size, info, _, index = struct.unpack_from(order + "IIIBBH", data, k)
                    part = "import" if index == 0 and h["type"] == 11 else "symbol"
                    out.append((path, part, _name(strings, name), SYMBOL_KINDS.get(info & 15, str(info & 15)), BINDS.get(info >> 4, str(info >> 4)), value, size, named[index] if index < len(named) else n))
            elif h["type"] == 6 and h["link"] < len(heads):
                strings, data = texts(heads[h["link"]]), texts(h)
                out += [(path, "needed", _name(strings, v), "", "", 0, 0, "") for t, v in struct.iter_unpack(order + ("qQ" if wide else "iI"), data[: len(data) // (16 if wide else 8) * (16 if wide else 8)]) if t == 1]
        return out
    except struct.error:  # a cut file: nothing of it is trusted
        return []


def read_elf(files: DataFrame) -> DataFrame:
    """Rows of all files (path, content) that are whole ELF files."""
    ensure_importable(files.sparkSession)
    names = [c.split()[0] for c in ROWS.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame([r for p, c in zip(pdf["path"], pdf["content"], strict=True) for r in parse(p, bytes(c or b""))], columns=names)

    return files.select("path", "content").mapInPandas(run, ROWS)


def symbol_listing(lines: DataFrame, key: str = "path") -> DataFrame:
    """(key, table, value, size, type, bind, ndx, name) of lines (key, n, line) of a symbol listing, which may hold several tables."""
    w = Window.partitionBy(key).orderBy("n").rowsBetween(Window.unboundedPreceding, 0)
    head = F.regexp_extract("line", r"^\s*Symbol table '([^']+)' contains", 1)
    row = r"^\s*\d+:\s+([0-9a-fA-F]+)\s+(\d+)\s+(\S+)\s+(\S+)\s+(\S+)\s+(\S+)\s*(.*)$"
    at = lambda k: F.regexp_extract("line", row, k)
    filled = lines.withColumn("table", F.last(F.when(head != "", head), ignorenulls=True).over(w))
    rows = filled.where(F.col("table").isNotNull() & F.col("line").rlike(row))
    return rows.select(key, "table", F.conv(at(1), 16, 10).cast("long").alias("value"), at(2).cast("long").alias("size"), at(3).alias("type"), at(4).alias("bind"), at(6).alias("ndx"), F.trim(at(7)).alias("name"))


def family(name: str | Column) -> Column:
    """The first family that an imported function belongs to, else other."""
    n = F.col(name) if isinstance(name, str) else name
    out = None
    for kind, pattern in FAMILIES.items():
        out = F.when(n.rlike(pattern), kind) if out is None else out.when(n.rlike(pattern), kind)
    return out.otherwise("other")
