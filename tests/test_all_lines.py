import random
import re
import time
from collections import Counter

import brute_scan
import pytest
from pyspark.sql import functions as F

from spellaudit.functions import scan
from spellaudit.plans import queries


@pytest.fixture(scope="module")
def signs(spark, tmp_path_factory):
    """Five documents with the same words, each on a line with a digit, a sign or a letter that is not plain; one has two more."""
    folder = str(tmp_path_factory.mktemp("signs"))
    texts = ["known words (1)", "known words: 2", "known \"words\"", "don't known words", "né known words\nqvist-zorbel 7 qvist"]
    docs = spark.createDataFrame([(i, t, "en", "web") for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string")
    docs.write.parquet(f"{folder}/documents.parquet")
    return folder


def test_all_lines_take_part(spark, signs):
    got = {name: queries.queries()[name](spark, signs) for name in ("derived_lexicon", "unknown_words", "miss_summary", "miss_by_path", "harvested_words", "miss_context", "all_lines_words", "decided_misses")}
    assert {tuple(r) for r in got["derived_lexicon"].collect()} == {("known", 5), ("words", 5)}
    assert {(r.norm, r.occurrences, r.files) for r in got["unknown_words"].collect()} == {("qvist", 2, 1), ("zorbel", 1, 1), ("don't", 1, 1)}
    assert tuple(got["miss_summary"].first()) == (5, 4)
    assert {tuple(r) for r in got["miss_by_path"].collect()} == {("en/web/3.txt", 1), ("en/web/4.txt", 3)}
    assert {r.word for r in got["harvested_words"].collect()} == {"qvist", "zorbel", "don't"}
    assert {tuple(r) for r in got["miss_context"].collect()} == {("en/web/4.txt:2:0", "", "qvist", "-zorbel 7 qvist"), ("en/web/4.txt:2:6", "qvist-", "zorbel", " 7 qvist"), ("en/web/4.txt:2:15", "qvist-zorbel 7 ", "qvist", ""), ("en/web/3.txt:1:0", "", "don't", " known words")}
    assert got["all_lines_words"].agg(F.sum("n")).first()[0] == 14
    assert {(r.action, r.n) for r in got["decided_misses"].collect()} == {("replace", 3), ("add", 1)}


PIECES = ["a", "b", "ab", "abc", "abcd", "A", "B", "AB", "Foo", "foo", "'", "’", "s", "t", "'s", "—", "é", "漢", "😀", " ", "-", "_", ".", "/", "//", "http://", "https://", "mailto:", "ftp://", "localhost", "@", ":", "1", "12", "10.0.0.1", "1.2.3.", "0x", "FF", "#", "#abc", "#123456", "%", "%2F", "\\", "\\e[33m", "\\033[1;31m", "\\n", "?", "=", "==", "&", "SG.", "prg-", "GTM-ABCDEF1", "sha1-", "a1b2c3", "xX", "xxx", "mark:disable", "mark:enable", "mark:disable-line", "data:image/png;base64,AAAA==", "ZZZ", "q9" * 101]


class Odd:
    """A model by which every span of odd length is a key."""

    def is_key(self, span):
        return len(span) % 2 == 1


@pytest.mark.parametrize("stepped", [False, True])
@pytest.mark.parametrize("options", [{}, {"skips": True, "marker": "mark"}, {"model": Odd(), "skips": True}, {"model": Odd(), "marker": "mark", "skips": True}, {"skip_keys": False, "skips": True, "skip_data_uris": True}, {"min_length": 5}], ids=str)
def test_one_expression_is_the_rules(options, stepped, monkeypatch):
    random.seed(11)
    if stepped:
        # every line as if it had long runs
        monkeypatch.setattr(scan, "_LONG", re.compile(""))
    for _ in range(8000):
        line = "".join(random.choices(PIECES, k=random.randint(1, 14)))
        assert list(scan.scan(line, **options)) == list(brute_scan.scan(line, **options)), line


def test_words_are_those_of_the_scanner(spark):
    random.seed(12)
    rows = [("p", i, "".join(random.choices(PIECES, k=random.randint(1, 30)))) for i in range(3000)] + [("q", 0, "word " * 40_000), ("q", 1, ""), ("q", 2, None)]
    numbered = spark.createDataFrame(rows, "path string, line_no int, line string")
    for options in ({}, {"marker": "mark"}, {"skip_keys": False}, {"skip_data_uris": True}):
        placed = scan.words(numbered, places=True, **options)
        assert Counter((r.line_no, r.col, r.text, r.case_kind) for r in placed.filter("path = 'p'").collect()) == Counter((n, len(line[:at].encode()), t, k) for _, n, line in rows[:3000] for at, t, k, _ in brute_scan.scan(line, **options))
        assert placed.filter("path = 'q' and line_no = 0").agg(F.count("*"), F.max("col"), F.countDistinct("col")).first()[:] == (40_000, 5 * 39_999, 40_000)
        got = scan.words(numbered, **options)
        assert Counter((r.line_no, r.text, r.case_kind) for r in got.filter("path = 'p'").collect()) == Counter((n, t, k) for _, n, line in rows[:3000] for _, t, k, _ in brute_scan.scan(line, **options))
        assert got.filter("path = 'q'").count() == 40_000
    assert scan.words(numbered.limit(0)).isEmpty() and scan.scan_lines(numbered.limit(0)).isEmpty()


@pytest.mark.parametrize("piece", ["a_", "ab-", "a.", "A1", "AB", "Ab1-", "a_1", "/a", "a@", "1.", "//", "aB_", "x1@a.b/"])
def test_long_runs_take_time_in_proportion(piece):
    for end in ("", "1", "./"):
        took = []
        for n in (20_000, 160_000):
            line = (piece * n)[:n] + end
            start = time.process_time()
            sum(1 for _ in scan.scan(line, skips=True))
            took.append(time.process_time() - start)
        # eight times the run; its square would be sixty-four
        assert took[1] < 25 * took[0] + 0.2, (end, took)


def test_long_runs_in_column_functions(spark):
    rows = [("p", i, piece * 3000) for i, piece in enumerate(["a_", "ab-", "a.", "A1", "Word-", "x/y.z"])]
    numbered = spark.createDataFrame(rows, "path string, line_no int, line string")
    got = Counter((r.line_no, r.text) for r in scan.words(numbered).collect())
    assert got == Counter((i, t) for _, i, line in rows for _, t, _, _ in scan.scan(line))
