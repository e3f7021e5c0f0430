"""Cases of findings about the operators for training data."""

from __future__ import annotations

from quarry.llm import html_text as H


def test_columns_are_aligned_by_one_rule_for_tables_of_any_size():
    aligned = []
    for n in (20_000, 30_000):
        lines = H.render("<table><tr><td>" + "w" * n + "<tr><td>a<td>b" * 40 + "</table>").split("\n")
        assert [x.split() for x in lines[1:]] == [["a", "|", "b"]] * 40
        aligned.append(sum(len(x) > n for x in lines))
        assert sum(map(len, lines)) <= H.PADDED_TIMES * (n + 3 + 40 * 8)
    assert aligned[0] == aligned[1] > 2
