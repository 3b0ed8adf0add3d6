"""The check's parts on small tables: directives by blocks of lines, lexicons of any size, the written report."""

import random
import re

import brute_scan
import numpy as np
import pytest

from spellaudit.functions import keys, scan
from spellaudit.operators import check, directives
from spellaudit.options import Options
from spellaudit.sources import corpus


def brute_gate(lines):
    """Lines of one file that stay, in order."""
    on = True
    for no, line in enumerate(lines, 1):
        if "m:enable" in line:
            on = True
        elif "m:disable" in line and "m:disable-line" not in line:
            on = False
        if on and "m:disable-line" not in line:
            yield no, line


@pytest.mark.parametrize(("block", "broadcast"), [(4096, 50_000), (3, 50_000), (3, 0), (1, 0), (16, 0)])
def test_directives_by_blocks(spark, monkeypatch, block, broadcast):
    monkeypatch.setattr(directives, "BROADCAST_BLOCKS", broadcast)
    random.seed(block)
    files = {f"f{i}": random.choices(["plain", "m:disable", "m:enable", "x m:disable-line", "m:enable m:disable", "m:disable-line m:enable"], weights=random.choice([(9, 1, 1, 1, 1, 1), (1, 1, 1, 1, 1, 1), (20, 1, 0, 0, 0, 0)]), k=random.choice([1, 4, 30, 90])) for i in range(25)}
    numbered = corpus.lines(spark.createDataFrame([(p, "\n".join(x)) for p, x in files.items()], "path string, content string"), tasks=3)
    got = directives.gate(numbered, "m", block=block)
    assert got.columns == ["path", "line_no", "line"]
    assert sorted(map(tuple, got.collect())) == sorted((p, no, line) for p, x in files.items() for no, line in brute_gate(x))
    assert directives.gate(numbered.limit(0), "m").isEmpty()


@pytest.mark.parametrize("broadcast", [500_000, 0])
def test_lookup_by_sets_of_lists(spark, monkeypatch, broadcast):
    monkeypatch.setattr(check, "BROADCAST_WORDS", broadcast)
    files = spark.createDataFrame([("f", ["a", "b"]), ("g", ["b", "a"]), ("h", ["c"]), ("i", [])], "path string, wordlists array<string>")
    lexicon = spark.createDataFrame([("one", "a"), ("two", "b"), ("two", "c"), ("three", "c"), ("all", "*")], "word string, wordlist string")
    tokens = spark.createDataFrame([(p, w) for p in "fghi" for w in ("one", "Two", "three", "all", "none", "none")], "path string, text string")
    got = sorted((r.path, r.norm) for r in check.misses(tokens, lexicon, files).collect())
    assert got == sorted([(p, w) for p, some in (("f", ["three"]), ("g", ["three"]), ("h", ["one"]), ("i", ["one", "two", "three"])) for w in [*some, "none", "none"]])
    assert sorted((r.path, r.norm) for r in check.misses(tokens, lexicon).collect()) == [(p, "none") for p in "fghi" for _ in "12"]


def test_whole_check_and_its_report(spark, tmp_path):
    class Odd:  # goes to the workers by value
        """A model by which every span of odd length is a key."""

        def is_key(self, span):
            return len(span) % 2 == 1

    files = spark.createDataFrame([("a.rb", "known wrong ab1cd2e3f\nspellaudit:disable\nhidden\nspellaudit:enable shown"), ("b.css", "known né wrong"), ("c.png", "skipped"), ("d", "x\x00y"), ("e", "")], "path string, content string")
    lexicon = spark.createDataFrame([("known", "english"), ("wrong", "css"), ("spellaudit", "*"), ("enable", "*")], "word string, wordlist string")
    options = Options()
    found = check.check_corpus(files, lexicon, options, model=Odd(), tasks=2)
    assert sorted((r.path, r.line_no, r.col, r.text) for r in found.collect()) == [("a.rb", 1, 6, "wrong"), ("a.rb", 4, 18, "shown")]
    assert {r.path: r.wordlists for r in found.collect()} == {"a.rb": ["english", "english/US", "html", "ruby", "tool_terms"]}
    chosen = check.select.select_files(files, options)
    path = str(tmp_path / "misses")
    assert check.write_report(found, chosen, path) == {"files_checked": 4, "misses_found": 2, "failed": True}
    assert sorted((r.path, r.text) for r in spark.read.parquet(path).collect()) == [("a.rb", "shown"), ("a.rb", "wrong")]
    assert check.write_report(found.limit(0), chosen, str(tmp_path / "none")) == {"files_checked": 4, "misses_found": 0, "failed": False}
    assert spark.read.parquet(str(tmp_path / "none")).columns == found.columns


def test_lines_keep_what_goes_along(spark):
    files = spark.createDataFrame([("p", "a\n\nb\r", 7), ("q", None, 8)], "path string, content string, set long")
    for tasks in (None, 5):
        got = corpus.lines(files, tasks=tasks)
        assert sorted(map(tuple, got.collect())) == [("p", 1, "a", 7), ("p", 2, "", 7), ("p", 3, "b\r", 7)]
    assert corpus.lines(files, tasks=5).rdd.getNumPartitions() == 5
    assert corpus.tasks_for(files.coalesce(1)) == spark.sparkContext.defaultParallelism


def spans_of(n):
    random.seed(n)
    return ["".join(random.choices(["a", "b", "F", "zQ", "Xx", "1", "23", "_", "-", "/", "+", "="], k=random.randint(1, 14))) for _ in range(n)]


def test_features_by_columns(spark):
    some = sorted({*spans_of(400), "ab12CDx=", "é1a2", "", "deadbeef01", "ABC123", "TitleCase99Word"})
    got = {r.span: r.features for r in keys.feature_rows(spark.createDataFrame([(s,) for s in some], "span string")).collect()}
    assert got.keys() == set(some)
    for s in some:
        if s.isascii():
            assert np.allclose(got[s], keys.features(s), rtol=1e-12, atol=1e-12), s


@pytest.mark.parametrize("most", [200_000, 3])
def test_scanner_gets_the_keys_of_its_lines(spark, monkeypatch, most):
    """Whatever the scanner asks of the model is among the spans that were classed before."""
    monkeypatch.setattr(keys, "KNOWN", most)
    random.seed(2)
    lines = [" ".join(random.choices([*spans_of(60), "word", "http://a.b/c1d2e3f4", "ab1cd2ef3", "q" * 190 + "1a2b3c4d5e6f7a8b9c0"], k=4)) for _ in range(60)]
    numbered = spark.createDataFrame([("p", i, x) for i, x in enumerate(lines)], "path string, line_no int, line string")
    classes = [(random.choice(keys.CLASSES), keys.features(s)) for s in spans_of(300)]
    params = keys.fit_params(spark.createDataFrame(classes, "class string, features array<double>"))
    exact, asked = keys.KeyModel.from_params(params), []

    class Asked:
        def is_key(self, span):
            asked.append(span)
            return exact.is_key(span)

    expected = {(i, at, t, kind) for i, x in enumerate(lines) for at, t, _, kind in brute_scan.scan(x, model=Asked(), skips=True)}
    told = {r.span for r in keys.scanner_spans(numbered).collect()}
    assert {s for s in asked if len(s) <= 200} <= told
    model = keys.for_scanner(numbered, params)
    assert isinstance(model, keys.KnownKeys) is (most > 3)
    got = {(r.line_no, r.col, r.text, r.kind) for r in scan.scan_lines(numbered, model=model, skips=True).collect()}
    assert got == expected and any(kind == "key" for *_, kind in got) and re.search("[0-9]", "".join(t for *_, t, kind in got if kind == "key"))
