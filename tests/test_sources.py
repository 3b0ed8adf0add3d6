"""Files in blocks, rules in one test, and tables that are written again only where they changed."""

import os
import random

import pytest
from pyspark.sql import functions as F

from spellaudit.operators import select
from spellaudit.sources import corpus


@pytest.mark.parametrize("few", [1_000_000, 0])
def test_lines_of_files_in_blocks(spark, tmp_path, monkeypatch, few):
    monkeypatch.setattr(corpus, "BROADCAST_SPLITS", few)
    random.seed(6)
    (tmp_path / "sub").mkdir()
    texts = {"a.txt": "one\ntwo", "b.txt": "one\n", "c.txt": "", "d.txt": "\n\n", "e.txt": "x\r\ny\x0bz", "sub/f.txt": "\n".join("".join(random.choices("abc é", k=random.randint(0, 60))) for _ in range(3000)), "sub/g.txt": "line\n" * 4000, "h.bin": "text\n" * 3000 + "nul \x00 here\n" + "text\n" * 3000, "i.txt": "long " * 9000}
    for name, text in texts.items():
        (tmp_path / name).write_text(text, newline="")
    expected = sorted(map(tuple, corpus.lines(corpus.read_files(spark, str(tmp_path))).collect()))
    was = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
        got = corpus.read_lines(spark, str(tmp_path))
        assert got.columns == ["path", "line_no", "line"]
        assert sorted(map(tuple, got.collect())) == expected
        # a file of 20,000 bytes is read by several tasks
        assert got.filter("path = 'sub/g.txt'").select(F.spark_partition_id()).distinct().count() > 3
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", was)
    assert len(expected) > 7000 and not any(p == "h.bin" for p, _, _ in expected)


def test_rules_in_one_test(spark):
    random.seed(7)
    part = lambda: "".join(random.choices(["a", "b", "ab", ".rb", ".", "x", "+"], k=random.randint(1, 3)))
    piece = lambda: "".join(random.choices(["a", "b", "ab", ".rb", ".", "x", "*", "**", "?", "+"], k=random.randint(1, 3)))
    paths = sorted({"/".join(part() for _ in range(random.randint(1, 4))) for _ in range(300)})
    files = spark.createDataFrame([(p,) for p in paths], "path string").cache()
    path = F.col("path")
    for _ in range(25):
        rules = ["".join((random.choice(["", "", "/"]), "/".join(piece() for _ in range(random.choice([1, 1, 2, 3]))), random.choice(["", "", "/"]))) for _ in range(random.randint(1, 6))] + random.choice([[], ["*.rb"], ["ab", "*.x"]])
        each = select.any_of([select.rule_match(r, path) for r in rules]) | F.exists(select.ancestors(path), lambda d: select.any_of([select.dir_match(r, d) for r in rules]))  # noqa: B023
        assert files.filter(each != select.excluded(path, rules)).isEmpty(), rules
    plan = files.filter(select.excluded(path, [f"*{i}?" for i in range(60)] + [f"*.e{i}" for i in range(60)] + [f"/n{i}/*" for i in range(60)]))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("RLIKE") <= 2


def test_corpus_is_written_where_it_changed(spark, tmp_path):
    path = str(tmp_path / "corpus")
    rows = [(f"f{i}", f"text {i}") for i in range(40)]
    make = lambda rows: spark.createDataFrame(rows, "path string, content string")
    read = lambda: sorted((r.path, r.content) for r in spark.read.parquet(path).collect())
    assert corpus.update_corpus(make(rows), path, parts=8) == 8 and read() == sorted(rows)
    stamps = {d: os.stat(f"{path}/{d}").st_mtime_ns for d in os.listdir(path) if d.startswith("part=")}
    assert corpus.update_corpus(make(rows), path, parts=8) == 0 and read() == sorted(rows)
    rows[3] = ("f3", "new text")
    assert corpus.update_corpus(make(rows), path, parts=8) == 1 and read() == sorted(rows)
    assert sum(os.stat(f"{path}/{d}").st_mtime_ns != t for d, t in stamps.items()) <= 1
    rows = rows[:3] + [("g", None)]
    corpus.update_corpus(make(rows), path, parts=8)
    assert read() == sorted(rows)


def test_lexicon_is_written_where_it_changed(spark, tmp_path):
    path = str(tmp_path / "lexicon")
    make = lambda rows: spark.createDataFrame(rows, "word string, wordlist string")
    read = lambda: sorted((r.word, r.wordlist) for r in spark.read.parquet(path).collect())
    rows = [("one", "a"), ("two", "a"), ("one", "english/US"), ("three", "c")]
    assert corpus.update_lexicon(make(rows + rows), path) == ["a", "c", "english/US"] and read() == sorted(rows)
    assert corpus.update_lexicon(make(rows), path) == []
    rows[1] = ("zwei", "a")
    assert corpus.update_lexicon(make(rows), path) == ["a"] and read() == sorted(rows)
    del rows[2]
    assert corpus.update_lexicon(make(rows), path) == ["english/US"] and read() == sorted(rows)
