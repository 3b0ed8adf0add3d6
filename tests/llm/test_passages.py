"""Passages of earlier documents against brute force."""

import hashlib
import random

import duckdb
import pytest
from pyspark.sql import functions as F

from spellaudit.llm import passages, queries

DATA = "/root/testdata/sf0.001"


def brute(rows, window):
    """doc_id: number of words, of removed ones, and the words that stay."""
    words = {i: [w for w in "".join(" " if c in "\t\n\x0b\x0c\r" else c for c in text or "").split(" ") if w] for i, text in rows}
    first = {}
    for i in sorted(words):
        for k in range(len(words[i]) - window + 1):
            first.setdefault(tuple(words[i][k : k + window]), i)
    out = {}
    for i, w in words.items():
        gone = {at for k in range(len(w) - window + 1) if first[tuple(w[k : k + window])] < i for at in range(k, k + window)}
        out[i] = (len(w), len(gone), " ".join(x for at, x in enumerate(w) if at not in gone))
    return out


def texts():
    random.seed(9)
    words = lambda n, letters="abcdefghijklmnop": random.choices(letters, k=n)
    rows = [None, "", " \n\t", "a b", "a " * 11, "a " * 30, "a " * 200, "\x0b".join(["é", "漢"] * 40)]
    shared = [words(n) for n in (11, 12, 13, 17, 24, 40, 90)]
    for _ in range(160):
        made = words(random.randint(0, 30))
        for _ in range(random.randint(0, 3)):
            piece = random.choice(shared)
            a = random.randint(0, 5)
            made += piece[a : len(piece) - random.randint(0, 3)] + words(random.randint(0, 9))
        rows.append(" ".join(made))
    # copies, and near copies whose first words shift the blocks
    rows += [rows[30]] * 4 + ["x " + rows[31], "x y " + rows[31], rows[31] + " z", "A  B " + rows[31].upper()]
    # few different words: windows that start in many places
    rows += [" ".join(words(random.randint(10, 60), "ab")) for _ in range(40)]
    order = list(range(len(rows)))
    random.shuffle(order)
    return [(i, rows[k]) for i, k in enumerate(order)]


@pytest.mark.parametrize("options", [{"window": 12, "gram": 3}, {"window": 12, "gram": 5, "broadcast_ids": 0}, {"window": 8, "gram": 1}, {}], ids=str)
def test_removes_what_earlier_documents_hold(spark, options):
    rows = texts()
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("n", F.lit(1)).withColumn("w", F.lit(2)).withColumn("hit", F.lit(3))
    got = {r.doc_id: r for r in passages.remove_passages(docs, keep_text=True, **options).collect()}
    assert len(got) == len(rows)
    for i, (n, removed, kept) in brute(rows, options.get("window", 50)).items():
        r = got[i]
        assert (r.n_words, r.n_removed, r.kept_sha256) == (n, removed, hashlib.sha256(kept.encode()).hexdigest()), i
        assert r.kept == (kept if removed else None)
    if options:
        assert sum(r.n_removed > 0 for r in got.values()) > 50


def test_repeated_rows_nulls_and_empty_tables(spark):
    text = " ".join(f"w{i}" for i in range(80))
    docs = spark.createDataFrame([(2, text), (2, text), (None, text), (3, text + " z"), (4, "a " + text), (5, None), (6, "x " * 60_000), (7, "x " * 70_000)], "doc_id long, text string")
    got = sorted((r.doc_id or 0, r.n_words, r.n_removed) for r in passages.remove_passages(docs).collect())
    assert got == [(0, 80, 0), (2, 80, 0), (2, 80, 0), (3, 81, 80), (4, 81, 80), (5, 0, 0), (6, 60_000, 0), (7, 70_000, 70_000)]
    none = passages.remove_passages(docs.limit(0))
    assert none.columns == ["doc_id", "n_words", "n_removed", "kept_sha256"] and none.isEmpty()
    with pytest.raises(ValueError):
        passages.remove_passages(docs, window=15)


def test_anchors_are_least_hashes():
    random.seed(4)
    for n in (25, 26, 40, 90):
        levels = passages.doubled(passages.word_hashes([random.choice("abc").encode() for _ in range(n)]))
        grams = passages.rolled(levels, 8).tolist()
        assert passages.anchors(levels, 25, 8).tolist() == [min(grams[k : k + 18]) for k in range(n - 24)]


def test_query_is_its_sql(spark):
    c = duckdb.connect()
    c.execute(f"CREATE VIEW documents AS SELECT * FROM '{DATA}/documents.parquet'")
    found = c.execute(queries.oracle_sql()["op12_substring_dedup"]).fetchall()
    got = queries.queries()["op12_substring_dedup"](spark, DATA)
    assert sorted(map(tuple, got.collect())) == sorted(found)
    assert sum(r[2] for r in found) > 0
