"""Periodic runs against brute force: every period of every text, place by place."""

import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from spellaudit.llm import periodic, queries


def words_of(doc_id, text):
    words = [w for w in "".join(" " if c in "\t\n\x0b\x0c\r" else c for c in text or "").split(" ") if w]
    n, h = len(words), zlib.crc32(str(doc_id).encode())
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    return words


def brute_runs(words, least=12):
    """A stretch of least words and two periods at least, that goes on neither way; of equal stretches the smallest period."""
    n, found = len(words), {}
    for p in range(1, n // 2 + 1):
        i = 0
        while i + p < n:
            if words[i] != words[i + p]:
                i += 1
                continue
            j = i
            while j + p < n and words[j] == words[j + p]:
                j += 1
            start, length = i, j - i + p
            i = j
            if length < max(least, 2 * p):
                continue
            # a smaller period of these very words
            if any(all(words[k] == words[k + q] for k in range(start, start + length - q)) for q in range(1, p)):
                continue
            found[(start, p)] = length
    return sorted((s, length, p) for (s, p), length in found.items())


def expected(doc_id, text):
    words = words_of(doc_id, text)
    runs = brute_runs(words)
    gone = {i for s, length, p in runs for i in range(s + p, s + length)}
    best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=None)
    return (len(runs), *(best or (None, None, None)), 1000 * best[1] // best[2] if best else None, sha("".join(f"{s},{length},{p}\n" for s, length, p in runs)), sha(" ".join(w for i, w in enumerate(words) if i not in gone)))


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def texts():
    random.seed(5)
    rows = [None, "", " \t\n", "a", "a b " * 3, "a " * 12, "a " * 11, "a b c " * 4, "x y " * 200 + "z", "\x0b".join(["é", "漢"] * 9), "a b a b a b a b a b a b a", " ".join(["p", "q"] * 6 + ["r"] * 14 + ["p", "q"] * 7)]
    for _ in range(140):
        letters = "ab" if random.random() < 0.4 else "abcdefghij"
        piece = random.choices(letters, k=random.randint(1, 60))
        rows.append(" ".join(random.choices(letters, k=random.randint(0, 40)) + (piece * random.randint(1, 6))[: random.randint(1, 200)] + random.choices(letters, k=random.randint(0, 40))))
    # a run within a run's period, and runs that overlap
    rows.append(" ".join((["a"] * 14 + list("bcdefg")) * 5))
    rows.append(" ".join(list("abcabcabcabcabcab") + list("dabdabdabdabda")))
    return rows


def fixture(spark):
    # ids that are looped (crc32 % 10 = 0) and others
    return spark.createDataFrame(list(enumerate(texts())), "doc_id long, text string").withColumn("runs", F.lit(1)).withColumn("found", F.lit(2)).withColumn("period", F.lit(3))


@pytest.mark.parametrize("options", [{}, {"tile": 16, "long_bytes": 20}, {"tile": 40, "long_bytes": 0}], ids=str)
def test_runs_are_all_runs(spark, options):
    docs = fixture(spark)
    got = periodic.run_report(docs, order=periodic.looped_tail, **options)
    assert got.columns == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    rows = {r.doc_id: tuple(r)[1:] for r in got.collect()}
    assert len(rows) == docs.count()
    for i, text in enumerate(texts()):
        assert rows[i] == expected(i, text), (i, text)


def test_boundary_values():
    random.seed(1)
    for _ in range(200):
        words = [random.choice("ab").encode() for _ in range(random.randint(4, 90))]
        levels = periodic.doubled(periodic.hashes(words, None))
        n = len(words)
        x = periodic.np.array([random.randrange(n - 1) for _ in range(20)])
        y = periodic.np.array([random.randrange(a + 1, n) for a in x])
        right = [next((k for k in range(n - b) if words[a + k] != words[b + k]), n - b) for a, b in zip(x, y, strict=True)]
        left = [next((k for k in range(a) if words[a - 1 - k] != words[b - 1 - k]), a) for a, b in zip(x, y, strict=True)]
        assert periodic.z_right(levels, x, y).tolist() == right
        assert periodic.z_left(levels, x, y).tolist() == left


def test_long_tiles_cover_each_stretch():
    random.seed(2)
    for n, size in ((1000, 50), (3000, 64), (777, 1000)):
        seen = {}
        for which, a, b in periodic.tiles(n, size):
            assert 0 <= a < b <= n
            for k in which:
                seen.setdefault(k, []).append((a, b))
        assert sorted(seen) == periodic.octaves(n)
        for spans in seen.values():
            assert min(a for a, _ in spans) == 0 and max(b for _, b in spans) == n


def test_repeated_rows_nulls_and_empty_tables(spark):
    text = "one two three " * 9
    docs = spark.createDataFrame([(1, text), (1, text), (None, text), (None, text), (2, None), (3, "x " * 120_000)], "doc_id long, text string")
    for options in ({}, {"long_bytes": 0, "tile": 32}):
        got = sorted((tuple(r) for r in periodic.run_report(docs, **options).collect()), key=str)
        assert len(got) == 6 and got[0] == got[1]
        by = {r[0]: r[1:5] for r in got}
        assert by == {1: (1, 0, 27, 3), None: (1, 0, 27, 3), 2: (0, None, None, None), 3: (1, 0, 120_000, 1)}
    none = periodic.run_report(docs.limit(0))
    assert none.isEmpty()


def test_query_on_given_documents(spark):
    folder = "/root/testdata/sf0.001"
    rows = {r.doc_id: tuple(r)[1:] for r in queries.queries()["op11_periodic_runs"](spark, folder).collect()}
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()}
    assert rows.keys() == docs.keys()
    for i, text in docs.items():
        if len((text or "").split()) < 700:
            assert rows[i] == expected(i, text), i
    assert sum(r[0] for r in rows.values()) > 0
