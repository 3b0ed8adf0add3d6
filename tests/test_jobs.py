import duckdb
import pytest
from pyspark.sql import functions as F

from spellaudit.functions.words import normalize
from spellaudit.operators import check, correct, directives, select, suggest
from spellaudit.options import Options
from spellaudit.plans import queries
from spellaudit.sources import corpus

DATA = "/root/testdata/sf0.001"
TABLES = ("documents", "pages", "benchmark", "part")


def test_globs(spark):
    cases = [
        ("public/*.html", "public/maintenance/default.html", False), ("public/*.html", "public/index.html", True), ("a/**/*.ts", "a/b/c/d.ts", True),
        ("*.rb", "app/models/user.rb", True), ("*.rb", "app/user.js", False), ("/public/*.html", "public/sub/file.html", False), ("vendor/bundle", "other/vendor/bundle", False), ("vendor/bundle", "vendor/bundle", True),
    ]
    for pattern, path, expected in cases:
        assert spark.range(1).select(select.rule_match(pattern, F.lit(path))).first()[0] is expected, (pattern, path)


def test_select(spark):
    files = spark.createDataFrame([(p, c) for p, c in (("a/x.rb", ""), ("build/y.rb", ""), ("a/z.png", ""), ("run", "#!/bin/bash\nls"), ("q", ""))], "path string, content string")
    assert {r.path for r in select.select_files(files, root_rules=("build/",)).collect()} == {"a/x.rb", "run", "q"}
    lists = {r.path: r.w for r in files.select("path", select.wordlists(Options()).alias("w")).collect()}
    assert lists["a/x.rb"] == ["english", "english/US", "ruby", "html", "tool_terms"]
    assert lists["run"] == ["english", "english/US", "shell", "tool_terms"]
    assert lists["q"] == ["english", "english/US", "tool_terms"]


def test_directives(spark):
    text = "one\nmark:disable\ntwo\nmark:enable three\nfour mark:disable-line\nfive"
    got = directives.checked_lines(spark.createDataFrame([("p", text), ("q", "six")], "path string, content string"), "mark").orderBy("path", "line_no").collect()
    assert [r.line for r in got] == ["one", "mark:enable three", "five", "six"]


def test_binary_and_empty_files(spark):
    files = spark.createDataFrame([("a", "x\x00y"), ("b", ""), ("c", None)], "path string, content string")
    assert [(r.path, r.line) for r in corpus.lines(files).collect()] == [("b", "")]


def test_lookup_by_lists(spark):
    tokens = spark.createDataFrame([("f", "Aardvark"), ("f", "zzzzz"), ("g", "aardvark"), ("g", "mine")], "path string, text string")
    files = spark.createDataFrame([("f", ["english"]), ("g", ["css"])], "path string, wordlists array<string>")
    lexicon = spark.createDataFrame([("aardvark", "english"), ("mine", "*")], "word string, wordlist string")
    assert {(r.path, r.norm) for r in check.misses(tokens, lexicon, files).collect()} == {("f", "zzzzz"), ("g", "aardvark")}
    assert spark.range(1).select(normalize(F.lit("Don’t'"))).first()[0] == "don't"


def test_suggest_and_correct(spark):
    found = spark.createDataFrame([("p", 1, 0, "Helo", "title", "helo"), ("p", 1, 10, "wrld", "lower", "wrld"), ("q", 1, 0, "qqqq", "lower", "qqqq")], "path string, line_no int, col int, text string, case_kind string, norm string")
    words = spark.createDataFrame([("hello",), ("world",), ("zebra",)], "word string")
    best = suggest.suggestions(found, words)
    assert {(r.norm, tuple(r.suggestions)) for r in best.collect()} == {("helo", ("Hello",)), ("wrld", ("world",))}
    files = spark.createDataFrame([("p", "Helo é ou wrld\nend"), ("q", "qqqq")], "path string, content string")
    # the place is in bytes, after a letter of two
    fixes = correct.top_fixes(found, best).withColumn("col", F.when(F.col("text") == "wrld", 11).otherwise(F.col("col")))
    assert {tuple(r) for r in correct.apply_fixes(files, fixes).collect()} == {("p", "Hello é ou world\nend"), ("q", "qqqq")}


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_same_as_sql(spark, duck, name):
    df = queries.queries()[name](spark, DATA)
    columns = sorted(df.columns)
    got = sorted(map(str, (tuple(r) for r in df.select(columns).collect())))
    found = duck.execute(queries.oracle_sql()[name])
    order = [[d[0] for d in found.description].index(c) for c in columns]
    assert got == sorted(str(tuple(r[i] for i in order)) for r in found.fetchall())
