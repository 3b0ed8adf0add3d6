"""Hard negatives against a search of everything."""

import math
import random

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from spellaudit.llm import negatives, queries


def brute(rows, positives=5, most=10, low=30, high=90, scale=256):
    good = {}
    for i, v, label in rows:
        if i is None or label is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        one = (label, [math.floor(scale * x) for x in v])
        good[i] = min(good.get(i, one), one)
    out = set()
    score = lambda a, b: sum(x * y for x, y in zip(good[a][1], good[b][1]))
    for a in good:
        if a % 100:
            continue
        ranked = sorted((-score(a, b), b) for b in good if b != a)
        for s, p in [r for r in ranked if good[r[1]][0] == good[a][0]][:positives]:
            fit = [(t, n) for t, n in ranked if good[n][0] != good[a][0] and low * -s <= 100 * -t <= high * -s]
            out |= {(a, p, k, n, -s, -t) for k, (t, n) in enumerate(fit[:most], 1)}
    return out


def rows_of(seed, n=700, dim=6):
    random.seed(seed)
    centers = [[random.gauss(0, 1) for _ in range(dim)] for _ in range(5)]
    rows = []
    for i in range(n):
        c = random.choice(centers)
        rows.append((i * 5, [x * random.choice([0.2, 1, 3]) + random.gauss(0, 0.4) for x in c], random.randrange(4)))
    # many equal vectors, opposite ones, and zeros
    rows += [(10_000 + 3 * i, [0.5] * dim, i % 3) for i in range(60)] + [(20_000 + 50 * i, [-0.5] * dim, i % 3) for i in range(20)] + [(30_000 + 50 * i, [0.0] * dim, 1) for i in range(8)]
    # rows that take no part, shorter vectors, a repeated row and a repeated id, an anchor alone with its label
    rows += [(40_000, None, 1), (40_100, [0.1] * dim, None), (40_200, [0.1, None] + [0.0] * (dim - 2), 1), (40_300, [float("nan")] * dim, 1), (40_400, [float("inf")] * dim, 1), (None, [1.0] * dim, 1)]
    rows += [(50_000, [1.0, 2.0], 1), (50_100, [], 2), rows[0], (5, [9.0] * dim, 3), (60_000, [1.0] * dim, 77)]
    return rows


SCHEMA = "vec_id long, embedding array<double>, label int"


@pytest.mark.parametrize("options", [{}, {"members": 3, "tile_rows": 64, "together": 4, "stretches": (0.02, 0.1, 0.4, 1.0)}, {"members": 1, "stretches": (1.0,), "sample": 7}, {"positives": 2, "negatives": 3, "low": 50, "high": 100, "members": 10}], ids=str)
def test_all_that_a_search_of_everything_finds(spark, options):
    rows = rows_of(3)
    docs = spark.createDataFrame(rows, SCHEMA).withColumn("q", F.lit(1)).withColumn("cluster", F.lit(2)).withColumn("id", F.lit(3))
    got = [tuple(r) for r in negatives.mine(docs, **options).collect()]
    assert len(got) == len(set(got))
    assert set(got) == brute(rows, options.get("positives", 5), options.get("negatives", 10), options.get("low", 30), options.get("high", 90))
    assert len(got) > 100


def test_walks_end_early(spark):
    """A tile that is ordered by its bounds is not scored beyond what can count."""
    random.seed(1)
    rows = np.array([[256 >> min(8, i // 1024), 0] for i in range(8192)])
    center, angle = np.array([[1.0, 0.0]]), np.array([0.0])
    found = negatives.bounds(rows, center, angle)[:, 0]
    assert (found >= rows[:, 0]).all() and (found - rows[:, 0] < 1e-2).all()
    tile = pa.table({"id": pa.array(range(1, 8193)), "label": pa.array([1] * 8192), "q": pa.array(rows.tolist(), pa.list_(pa.int64())), "bound": pa.array(found)})
    member = pa.table({"id": [0], "label": [1], "q": pa.array([[256, 0]], pa.list_(pa.int64())), "goals": [[0]], "holds": pa.array([[None]], pa.list_(pa.int64()))})
    seen = []
    exact = negatives.products
    negatives.products = lambda a, b: seen.append(len(b)) or exact(a, b)
    try:
        out = negatives._walk(5, 10, 30, 90, "positives", 2)(tile, member)
    finally:
        negatives.products = exact
    assert out.column("other").to_pylist() == [1, 2, 3, 4, 5] and sum(seen) == 1024


def test_bounds_hold():
    rng = np.random.default_rng(2)
    rows, members = (np.floor(256 * rng.normal(size=(n, 8))) for n in (400, 60))
    centers = negatives.centroids(members, 5)
    of = (negatives._units(members) @ centers.T).argmax(1)
    angles = np.array([np.arccos(np.clip((negatives._units(members[of == c]) @ centers[c]).min(initial=1), -1, 1)) for c in range(5)])
    most = negatives.bounds(rows, centers, angles)
    for m, c in zip(members, of, strict=True):
        assert (rows @ m <= np.linalg.norm(m) * most[:, c] + 1e-6).all()


def test_products_are_exact():
    big = np.full((2, 3), 1 << 29)
    assert negatives.products(big, big).tolist() == [[3 << 58] * 2] * 2
    with pytest.raises(ValueError):
        negatives.products(big << 3, big << 3)


def test_no_rows(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert negatives.mine(none).isEmpty() and negatives.mine(none).columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    alone = spark.createDataFrame([(0, [1.0], 1), (1, [1.0], 2)], SCHEMA)
    assert negatives.mine(alone).isEmpty()


def test_query_is_its_sql(spark):
    folder = "/root/testdata/sf0.001"
    c = duckdb.connect()
    c.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{folder}/embeddings.parquet'")
    found = c.execute(queries.oracle_sql()["op13_hard_negatives"])
    names = [d[0] for d in found.description]
    got = queries.queries()["op13_hard_negatives"](spark, folder)
    assert sorted(map(tuple, got.select(names).collect())) == sorted(found.fetchall())
