import pytest

from spellaudit.llm import lines


@pytest.mark.parametrize("size", [70_001, 1_100_003])
def test_long_lines_that_differ_near_the_end(spark, size):
    base = "lorem ipsum dolor " * (size // 18)
    ends = ["abcdefgh", "abcdxfgh", "abcdefg", "zzzzzzzz", "yyyyyyyy", "zzzzzzzy", "wwwwvvvv"]
    df = spark.createDataFrame([(i, base + e) for i, e in enumerate(ends)], "doc_id long, text string")
    assert {r.doc_id for r in lines.removed_places(df, bucket=2).collect()} == {1, 2, 5}


def test_many_lines_and_clashing_columns(spark):
    import time

    text = "\n".join(["the same line of thirty characters"] * 100_000 + ["a last line that nothing repeats"])
    df = spark.createDataFrame([(1, text, "x", 7, [1]), (2, None, None, None, None), (3, "", "y", 8, [2])], "doc_id long, text string, _gone string, _kept int, _lines array<int>")
    start = time.time()
    got = {r.doc_id: r for r in lines.dedup_lines(df).collect()}
    assert time.time() - start < 60
    assert got[1].text == "the same line of thirty characters\na last line that nothing repeats"
    assert (got[1]._gone, got[1]._kept, got[1]._lines, got[2].text, got[3].text) == ("x", 7, [1], None, "")
    assert lines.dedup_lines(df.limit(0)).isEmpty() and lines.line_report(df.limit(0)).isEmpty()
