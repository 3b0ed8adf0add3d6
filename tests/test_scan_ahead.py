import random

import pandas as pd
import pytest

from spellaudit.functions import scan

SOME = ["http://", "localhost", "mailto:", "data:a;base64,", "//", "sha1-", "www.foo.com/", "SG.", "abc", "Abcd.", "aaa", "Word,", "it's", "don’t", "café", "HTMLParser", "B0b1c", "x@y.z", "the", "End."]


def _lines(n, seed=7):
    r = random.Random(seed)
    signs = "aAbBcCdeZ01.:/@-_+=#%\\ \t'’é,hxsSG   "
    for _ in range(n):
        parts = [r.choice(SOME) if r.random() < 0.4 else "".join(r.choice(signs) for _ in range(r.randint(1, 9))) for _ in range(r.randint(1, 6))]
        yield r.choice(["", " "]).join(parts)


@pytest.mark.parametrize("keys", [False, True])
def test_looking_ahead_finds_the_same(keys):
    plain, ahead = (scan.compiled(keys=keys, data_uris=True, ahead=a) for a in (False, True))
    for line in _lines(20_000):
        assert [(m.span(), m.lastgroup) for m in plain.finditer(line)] == [(m.span(), m.lastgroup) for m in ahead.finditer(line)], line


@pytest.mark.parametrize("places", [False, True])
def test_columns_find_what_the_scanner_finds(spark, places):
    lines = spark.createDataFrame([("p", i, line, i % 3) for i, line in enumerate(_lines(3_000, 8))], "path string, line_no int, line string, more int")
    columns = ["path", "line_no", *(["col"] if places else []), "text", "case_kind", "more"]
    found = scan.words(lines, places=places, keep=("more",)).select(columns).collect()
    wanted = scan.scan_lines(lines, keep=("more",)).select(columns).collect()
    assert sorted(found) == sorted(wanted) and found


class _Taken:
    """Stands for a table: ``mapInPandas`` keeps the function."""

    dtypes = [("path", "string"), ("line_no", "int"), ("line", "string")]

    def select(self, *_):
        return self

    filter = select

    def mapInPandas(self, run, _):  # noqa: N802
        return run


def test_many_words_leave_in_parts():
    frame = pd.DataFrame({"path": "p", "line_no": range(1000), "line": "one two three " * 20})
    sent = [len(f) for f in scan.scan_lines(_Taken())(iter([frame]))]
    assert sum(sent) == 60_000 and max(sent) <= 20_000
