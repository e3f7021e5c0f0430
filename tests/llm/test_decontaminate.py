from __future__ import annotations

import random

from quarry.llm import decontaminate as D
from quarry.llm import textvec


def _distance(pattern, text):
    """Fewest edits of pattern against any part of text."""
    prev = [0] * (len(text) + 1)
    for i, c in enumerate(pattern, 1):
        cur = [i]
        for j, d in enumerate(text, 1):
            cur.append(min(prev[j] + 1, cur[j - 1] + 1, prev[j - 1] + (c != d)))
        prev = cur
    return min(prev)


def _brute(index, text):
    return sorted({index.item[w] for w, win in enumerate(index.window) if (_distance(win, text) <= index.edits[w] if len(win) >= D.Q else b" " + win + b" " in b" " + text + b" ")})


def _edited(rng, text, n):
    b = bytearray(text)
    for _ in range(n):
        k = rng.randrange(len(b))
        if (op := rng.random()) < 0.4:
            b[k] = 97 + rng.randrange(26)
        elif op < 0.7:
            del b[k]
        else:
            b.insert(k, 97 + rng.randrange(26))
    return bytes(b)


def test_matches_against_brute_force():
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcde") for _ in range(rng.randrange(2, 7)))
    items = [(k, " ".join(word() for _ in range(rng.randrange(4, 60)))) for k in range(12)] + [(90, "ab cd"), (91, ""), (92, "?!")]
    index = D.Index(items)
    texts = []
    for _ in range(60):
        w = rng.choice(index.window)
        host = " ".join(word() for _ in range(40)).encode()
        k = rng.randrange(len(host))
        texts.append(host[:k] + _edited(rng, w, rng.randrange(0, 14)) + host[k:] if len(w) > 20 else host)
    texts += [b"", b"x", index.window[0], b"xx ab cd yy"]
    got = [[x[0] for x in m] for m in index.matches(texts)]
    assert got == [_brute(index, t) for t in texts]


def test_rows(spark, odd_docs, no_docs):
    bench = spark.createDataFrame([(1, "The quick brown fox jumps over the lazy dog again!"), (2, None), (3, ""), (None, "x"), (1, "The quick brown fox jumps over the lazy dog again!")], "item_id long, text string")
    rows = D.decontaminate(odd_docs, bench).collect()
    assert sorted(r["doc_id"] for r in rows if r["contaminated"]) == [1, 4, 9] and len(rows) == 10
    hit = next(r for r in rows if r["doc_id"] == 1)
    assert hit["item_ids"] == [1] and hit["edits"] == [0] and hit["starts"] == [0]
    assert D.decontaminate(no_docs, bench).count() == 0
    assert not any(r["contaminated"] for r in D.decontaminate(odd_docs, bench.limit(0)).collect())


def test_blocks_of_the_benchmark(spark, monkeypatch):
    items = [(k, f"passage number {k} of the benchmark with words {k * 7919} and {k * 104729} in it") for k in range(20)]
    docs = spark.createDataFrame([(k, f"before it {items[k][1]} after it") for k in range(20)] + [(99, "nothing here at all")], "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    whole = sorted((r["doc_id"], r["item_ids"]) for r in D.decontaminate(docs, bench).collect())
    monkeypatch.setattr(D, "BLOCK_BYTES", 200)
    parts = sorted((r["doc_id"], sorted(r["item_ids"])) for r in D.decontaminate(docs, bench).collect())
    assert [(i, sorted(x)) for i, x in whole] == parts and all(k in x for k, x in whole if k != 99)


def test_driver_rows_with_exact_passages(spark):
    d = "/root/testdata/sf0.01"
    docs, bench = (spark.read.parquet(f"{d}/{n}.parquet") for n in ("documents", "benchmark"))
    got = {r["doc_id"] for r in D.decontaminate(docs, bench).collect() if r["contaminated"]}
    items = [textvec.normal(r["text"]) for r in bench.collect()]
    want = {r["doc_id"] for r in docs.collect() if any(x in textvec.normal(r["text"]) for x in items)}
    assert got == want


def test_quoted_runs_of_words_of_longer_items():
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randrange(1, 12)))
    items = [[word() for _ in range(60)] for _ in range(8)]
    index = D.Index([(k, " ".join(x)) for k, x in enumerate(items)])
    host = " ".join(word() for _ in range(50))
    runs = [(k, i) for k in range(8) for i in range(0, 48)]
    got = index.matches([textvec.normal(f"{host} {' '.join(items[k][i : i + 13])} {host}") for k, i in runs])
    assert [[x[0] for x in m] for m in got] == [[k] for k, _ in runs] and all(m[0][1] == 0 for m in got)
    assert not any(index.matches([textvec.normal(f"{host} {' '.join(items[k][i : i + 6])} {host}") for k, i in runs]))
    spaceless = "".join(chr(0x4E00 + rng.randrange(5000)) for _ in range(300))
    index = D.Index([(1, spaceless)])
    assert all(index.matches([textvec.normal(f"{spaceless[i : i + 48]}")])[0] for i in range(252))


def test_edited_copies_of_short_items():
    """Lengths at which edits within the budget can leave no run of Q characters."""
    for n in (13, 16, 19, 25, 29, 38, 39):
        text = "abcdefghijklmnopqrstuvwxyzabcdefghijklmnopqrstuvwxyz"[:n]
        index = D.Index([(5, text)])
        e = int(n * D.EDITS)
        b = bytearray(text.encode())
        for k in range(e):
            b[(k + 1) * n // (e + 1)] = ord("0")
        assert [x[:2] for x in index.matches([b"before it " + bytes(b) + b" after it"])[0]] == [(5, e)]


def test_rows_without_ids_and_repeated_ids_in_blocks(spark, monkeypatch):
    items = [(k, f"passage number {k} of the benchmark with words {k * 7919} and {k * 104729} in it") for k in range(8)]
    bench = spark.createDataFrame([*items, (0, "another text of " + "the item that is named zero as well " * 3)], "item_id long, text string")
    docs = spark.createDataFrame([(None, items[3][1]), (None, "clean"), (None, None), (5, items[0][1]), (5, "clean too"), (5, items[0][1])], "doc_id long, text string")
    rows = lambda: sorted((str(r["doc_id"]), r["contaminated"], tuple(r["item_ids"]), tuple(r["edits"]), tuple(r["starts"]), tuple(r["ends"])) for r in D.decontaminate(docs, bench).collect())
    whole = rows()
    monkeypatch.setattr(D, "BLOCK_BYTES", 100)
    assert len(whole) == 6 and rows() == whole and [x[1] for x in whole] == [False, True, True, False, False, True]


def test_common_qgrams_are_looked_at_in_parts(monkeypatch):
    """Items that share their text, and a document full of it: the same matches with few places at a time."""
    from quarry.llm import decontaminate as D
    from quarry.llm import textvec

    phrase = "the same long phrase stands in every item of this benchmark and nowhere else at all"
    items = [(k, f"{phrase} number {k} ends with its own word{k} here") for k in range(12)] + [(None, "an item without an id that is long enough to be found")]
    texts = [textvec.normal(t) for t in (f"{phrase} " * 5, "x y " + items[3][1] + " z", "nothing of it", "see an item without an id that is long enough to be found")]
    whole = D.Index(items).matches(texts)
    monkeypatch.setattr(D, "POSTINGS", 40)
    assert D.Index(items).matches(texts) == whole
    assert {x[0] for x in whole[1]} >= {3} and [x[0] for x in whole[3]] == [None] and not whole[2]
