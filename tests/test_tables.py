"""Readers, writers, rules, reports, decisions and the key model on small tables."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from spellaudit.functions import keys
from spellaudit.operators import check, correct, select, suggest
from spellaudit.options import Options
from spellaudit.sources import corpus


def test_read_and_write(spark, tmp_path):
    (tmp_path / "lists/sub").mkdir(parents=True)
    (tmp_path / "lists/one.txt").write_text("Beta\r\n alpha \n\nbeta\n")
    (tmp_path / "lists/sub/two.txt").write_text("gamma")
    (tmp_path / "lists/skip.md").write_text("delta")
    words = corpus.read_wordlists(spark, str(tmp_path / "lists"))
    assert {tuple(r) for r in words.collect()} == {("Beta", "one"), ("alpha", "one"), ("beta", "one"), ("gamma", "sub/two")}
    project = corpus.project_wordlists(spark, str(tmp_path / "lists"))
    assert {r.wordlist for r in project.collect()} == {"*"}
    files = corpus.read_files(spark, str(tmp_path / "lists"))
    assert {r.path: r.content for r in files.collect()} == {"one.txt": "Beta\r\n alpha \n\nbeta\n", "sub/two.txt": "gamma", "skip.md": "delta"}
    assert corpus.read_files(spark, str(tmp_path / "lists"), missing_ok=True).count() == 3
    assert corpus.read_files(spark, str(tmp_path / "nowhere"), missing_ok=True).isEmpty()
    corpus.write_wordlist(words.unionByName(words), str(tmp_path / "out"))
    assert [r.value for r in spark.read.text(str(tmp_path / "out")).collect()] == ["Beta", "alpha", "beta", "gamma"]
    corpus.write_lexicon(words, str(tmp_path / "lexicon"))
    assert {(r.word, r.wordlist) for r in spark.read.parquet(str(tmp_path / "lexicon")).collect()} == {tuple(r) for r in words.collect()}
    corpus.write_corpus(files, str(tmp_path / "corpus"))
    assert {tuple(r) for r in spark.read.parquet(str(tmp_path / "corpus")).collect()} == {tuple(r) for r in files.collect()}


def test_ignore_rules(spark):
    text = "# note\n\n!keep\n build/ \r\n*.lock"
    files = spark.createDataFrame([(".gitignore", text), ("vendor/.gitignore", "*.rb"), ("x/gitignore", "no")], "path string, content string")
    assert {tuple(r) for r in corpus.ignore_rules(files).select("prefix", "pattern").collect()} == {("", "build/"), ("", "*.lock"), ("vendor/", "*.rb")}


NESTED = [
    ("*", ".jj/", ".jj/anything", True), ("*", ".jj/", "other/anything", False),
    ("**/*.rb", ".ruby-lsp/", ".ruby-lsp/deep/nested/foo.rb", True), ("**/*.rb", ".ruby-lsp/", ".ruby-lsp/deep/nested/foo.ts", False),
    ("*.lock", "vendor/", "vendor/Gemfile.lock", True), ("*.lock", "vendor/", "Gemfile.lock", False), ("*.lock", "vendor/", "other/Gemfile.lock", False),
]


def test_nested_rules(spark):
    for pattern, prefix, path, expected in NESTED:
        files = spark.createDataFrame([(path,)], "path string")
        rules = spark.createDataFrame([(prefix, pattern)], "prefix string, pattern string")
        assert select.nested_excluded(files, rules).isEmpty() is not expected, (pattern, path)


def test_explicit_paths(spark):
    files = spark.createDataFrame([("a.png", "", "k"), ("b.rb", "", "k")], "path string, content string, rest string")
    asked = spark.createDataFrame([("a.png",), ("nowhere",)], "path string")
    assert [r.path for r in select.select_files(files, paths=asked).collect()] == ["a.png"]
    assert select.select_files(files, suppress_rules=True).count() == 2
    assert [r.path for r in select.select_files(files).collect()] == ["b.rb"]
    # a file that is not there has no first line
    none = spark.createDataFrame([("tool", None), ("fish", "#!/usr/bin/fish\n")], "path string, content string")
    lists = {r.path: r.w for r in none.select("path", select.wordlists(Options()).alias("w")).collect()}
    assert "ruby" not in (lists["tool"] or []) and "shell" in lists["fish"]


def test_whole_check(spark):
    content = "the wrong wrd\nspellaudit:disable\nhidden\nspellaudit:enable\nmine spellaudit:disable gone spellaudit:enable back"
    files = spark.createDataFrame([("a.rb", content), ("a.css", "flex wrd"), ("b.png", "wrd"), ("bin", "x\x00wrd")], "path string, content string")
    lexicon = spark.createDataFrame([("the", "english"), ("wrong", "ruby"), ("mine", "*"), ("flex", "css"), ("back", "css"), ("spellaudit", "tool_terms"), ("enable", "tool_terms")], "word string, wordlist string")
    got = check.check_corpus(files, lexicon)
    assert {(r.path, r.line_no, r["col"], r.text) for r in got.collect()} == {("a.rb", 1, 10, "wrd"), ("a.rb", 5, 47, "back"), ("a.css", 1, 5, "wrd")}
    assert [r.path for r in check.hint_paths(got).collect()] == ["a.css", "a.rb"] and check.hint_paths(got, most=1).isEmpty()
    assert check.has_misses(got) and not check.has_misses(got.limit(0))
    assert {r.path for r in check.check_corpus(files, lexicon, Options(min_length=4)).collect()} == {"a.rb"}
    # what is added is found: later misses are among the former ones
    more = check.add_words(lexicon, check.harvest(got), "*")
    assert check.check_corpus(files, more).isEmpty()


def test_decisions(spark):
    found = spark.createDataFrame([("p", 1, 0, "Abc", "abc"), ("p", 2, 0, "abc", "abc"), ("q", 1, 4, "xyz", "xyz"), ("q", 2, 0, "new", "new")], "path string, line_no int, col int, text string, norm string")
    decisions = spark.createDataFrame([(None, None, None, "abc", "replace", "ABC"), (None, None, None, "abc", "skip", None), ("p", 2, 0, "abc", "skip", None), ("p", 2, 0, "abc", "replace", "x"), (None, None, None, "xyz", "add", "ruby")], "path string, line_no int, col int, norm string, action string, value string")
    decided = correct.decide(found, decisions)
    assert {(r.path, r.line_no, r.action) for r in decided.collect()} == {("p", 1, "replace"), ("p", 2, "replace"), ("q", 1, "add"), ("q", 2, None)} and decided.count() == 4
    assert {tuple(r) for r in correct.replacements(decided).collect()} == {("p", 1, 0, "Abc", "ABC"), ("p", 2, 0, "abc", "x")}
    assert [tuple(r) for r in correct.additions(decided).collect()] == [("xyz", "ruby")]
    assert [r.text for r in correct.open_misses(decided).collect()] == ["new"]


def test_key_model(spark):
    random.seed(9)
    alphabets = {"hex": "0123456789abcdef", "lower36": "0123456789abcdefghijklmnopqrstuvwxyz", "upper36": "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ", "base64": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"}
    names = {"hex": ["face{}cafe", "bad{}bed"], "lower36": ["house{}boat", "river{}stone"], "upper36": ["HOUSE{}BOAT", "RIVER{}STONE"], "base64": ["House{}_Boat", "River{}_Stone"]}
    made = lambda n: [(f"key_{k}", "".join(random.choices(a, k=random.randint(24, 44)))) for k, a in alphabets.items() for _ in range(n)] + [(f"not_key_{k}", random.choice(x).format(random.randint(1, 999))) for k, x in names.items() for _ in range(n)]
    fitting, fresh = made(150), made(40)
    rows = spark.createDataFrame([(c, keys.features(s)) for c, s in fitting], "class string, features array<double>")
    params = keys.fit_params(rows)
    assert params.count() == 296
    model = keys.KeyModel.from_params(params)
    right = [model.is_key(s) == c.startswith("key") for c, s in fresh]
    assert np.mean(right) > 0.97
    spans = spark.createDataFrame([(s,) for _, s in fresh], "span string")
    assert {r.span: r["class"] for r in keys.classify(spans, params).collect()} == {s: model.classify([s])[0] for _, s in fresh}
    # by the formula, for one span
    span = fresh[0][1]
    table = {(r["class"], r.feature): (r.mean, max(r.variance, keys.FLOOR)) for r in params.collect()}
    x = dict(zip(keys.FEATURES, keys.features(span), strict=True))
    score = {c: math.log(1 / 8) + (5 * math.log(10) if c.startswith("key") else 0) + sum(-0.5 * ((x[f] - table[c, f][0]) ** 2 / table[c, f][1] + math.log(2 * math.pi * table[c, f][1])) for f in keys.FEATURES) for c in keys.CLASSES}
    assert model.scores([span])[0] == pytest.approx([score[c] for c in keys.CLASSES])


def test_lists_of_the_file(spark):
    found = spark.createDataFrame([("p", "helo", "lower", ["en"]), ("q", "helo", "lower", ["de"]), ("r", "helo", "title", ["en", "de"])], "path string, norm string, case_kind string, wordlists array<string>")
    lexicon = spark.createDataFrame([("hello", "en"), ("held", "de"), ("hero", "*")], "word string, wordlist string")
    got = {(tuple(r.wordlists), r.case_kind): list(r.suggestions) for r in suggest.suggestions_by_lists(found, lexicon).collect()}
    assert got == {(("en",), "lower"): ["hello"], (("de",), "lower"): ["held"], (("en", "de"), "title"): ["Hello"]}


def test_places_and_offsets(spark):
    line = "né wrd — wrd’s wrd"
    found = spark.createDataFrame([("p", 1, 4, "wrd"), ("p", 1, len("né wrd — ".encode()), "wrd")], "path string, line_no int, col int, text string")
    numbered = spark.createDataFrame([("p", 1, line)], "path string, line_no int, line string")
    assert {(r.place, r.before, r.word, r.after) for r in check.with_context(found, numbered).collect()} == {("p:1:4", "né ", "wrd", " — wrd’s wrd"), ("p:1:12", "né wrd — ", "wrd", "’s wrd")}
    fixes = found.withColumn("new", F.lit("word"))
    assert correct.apply_fixes(spark.createDataFrame([("p", line)], "path string, content string"), fixes).first().content == "né word — word’s wrd"
