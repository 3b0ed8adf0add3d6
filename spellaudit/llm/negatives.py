"""Hard negatives of anchors by lists that the anchors of a cluster share.

Vectors become whole numbers (``scale`` times each component, rounded down) and a row's score is its inner product with the anchor. An
anchor's positives are its best rows of its own label; for each positive the best rows of other labels whose scores are between
``low`` and ``high`` per cent of the positive's are returned.

1. Clusters. Centroids of the anchors' directions are fitted by a few rounds of k-means to ``sample`` anchors at most; every
   anchor goes to the nearest. There is a cluster for each ``members`` anchors, 4 at least and 1,024 at most.
2. Lists. For an anchor in a cluster no row scores more than |anchor| * |row| * cos(angle of row and centroid - greatest
   angle of a member and the centroid); without the factor |anchor| that is the row's bound for the whole cluster, and a cluster's
   list has all rows in falling order of it. Bounds are cut into stretches at quantiles of a sample of rows; a stretch is
   dealt by hash into tiles, and each tile is put in order once for all members.
3. Walks. Members go along their list stretch by stretch, and within a tile block by block: a member stops when |anchor| times the
   bound of what comes next is below what it holds already (its fifth positive; for each positive the tenth negative, or the
   least score allowed), so that nothing that comes can count. First all positives are found, then, with the scores that
   they allow, the negatives. Nobody stops without that proof: the rows are those of a search of everything.

The driver gets two samples, the centroids, and each cluster's size and angle; scores are summed in float64 where that is
exact, else in 64-bit whole numbers, and an error is raised where neither is.

Rows without an id, a label, a vector, or with a component that is null or not finite take no part. Shorter vectors end in zeros. Of rows of one id
the least (label, vector) takes part. Ties of scores go to the smaller id. Anchors without another row of their label give no rows; neither do
empty tables. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spellaudit.llm.common import written

POSITIVES, NEGATIVES, LOW, HIGH, SCALE = 5, 10, 30, 90, 256
MEMBERS, MOST_CLUSTERS, SAMPLE = 256, 1024, 10_000
#: Rows whose bounds tell where stretches end; what is in them does not depend on it.
CUTS = 2_000
RESULT = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
#: Shares of a list where its stretches end.
STRETCHES = (1 / 16, 1 / 4, 1.0)
#: Rows of a tile, and of a block that is scored at once; members that meet a tile at once.
TILE_ROWS, BLOCK, TOGETHER = 8192, 1024, 512
#: What bounds may be off by, as they are made of rounded numbers.
SLACK = 1e-6


def matrix(column: pa.ChunkedArray | pa.Array, width: int) -> np.ndarray:
    """Rows of ``width`` whole numbers, filled up with zeros."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    sizes = np.asarray(column.value_lengths()) if len(column) else np.empty(0, np.int64)
    flat = np.asarray(column.flatten(), np.int64)
    if len(sizes) and (sizes == width).all():
        return flat.reshape(len(sizes), width)
    out = np.zeros((len(sizes), width), np.int64)
    out[np.arange(width) < sizes[:, None]] = flat
    return out


def _up(x):
    return x + abs(x) * SLACK + SLACK


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of the rows of a and b, exactly."""
    most = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * a.shape[1]
    if most < 2**53:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    if most >= 2**63:
        raise ValueError("scores beyond 64 bits")
    return a @ b.T


def centroids(sample: np.ndarray, k: int, rounds: int = 8) -> np.ndarray:
    """Directions of k clusters of the rows; from rows far apart, by k-means on the sphere."""
    unit = _units(sample)
    chosen = [0]
    near = unit @ unit[0]
    while len(chosen) < k:
        chosen.append(int(near.argmin()))
        near = np.maximum(near, unit @ unit[chosen[-1]])
    found = unit[chosen]
    for _ in range(rounds):
        of = (unit @ found.T).argmax(1)
        sums = np.zeros_like(found)
        np.add.at(sums, of, unit)
        found = np.where((np.abs(sums).sum(1) > 0)[:, None], _units(sums), found)
    return found


def _units(rows: np.ndarray) -> np.ndarray:
    size = np.linalg.norm(rows, axis=1, keepdims=True)
    return rows / np.where(size > 0, size, 1)


def bounds(rows: np.ndarray, centers: np.ndarray, angles: np.ndarray) -> np.ndarray:
    """For each row and cluster what the row scores at most with a member of length one."""
    rows = rows.astype(np.float64)
    off = np.arccos(np.clip(_units(rows) @ centers.T, -1, 1))
    return _up(np.linalg.norm(rows, axis=1)[:, None] * np.cos(np.maximum(0, off - angles)))


def whole_vectors(vectors: DataFrame, *, scale: int = SCALE) -> DataFrame:
    """id, label and q (whole numbers) of the rows that take part."""
    x = F.transform("embedding", lambda v: v.cast("double"))
    sound = F.coalesce(F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))), F.lit(False))
    q = F.transform(x, lambda v: F.floor(v * scale))
    good = vectors.filter("vec_id is not null and label is not null").filter(sound)
    one = good.groupBy(F.col("vec_id").cast("long").alias("id")).agg(F.min(F.struct(F.col("label").cast("long").alias("label"), q.alias("q"))).alias("v"))
    return one.select("id", "v.label", "v.q")


def _assigned(anchors: DataFrame, centers: np.ndarray) -> DataFrame:
    def run(batches):
        for batch in batches:
            cos = _units(matrix(batch.column(2), centers.shape[1]).astype(np.float64)) @ centers.T
            at = cos.argmax(1)
            angle = np.arccos(np.clip(cos[np.arange(len(at)), at], -1, 1))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(at, pa.int32()), pa.array(angle, pa.float64())], ["id", "label", "q", "cluster", "angle"])

    return anchors.mapInArrow(run, "id long, label long, q array<long>, cluster int, angle double")


def _stretch(rows: DataFrame, centers: np.ndarray, angles: np.ndarray, above: np.ndarray, upto: np.ndarray, tiles: np.ndarray, parts: np.ndarray) -> DataFrame:
    """The rows whose bound for a cluster is over ``above`` and not over ``upto``, once for each such cluster and part of its members; 0 tiles: nobody walks there."""

    def run(batches):
        for batch in batches:
            ids = np.asarray(batch.column(0))
            found = bounds(matrix(batch.column(2), centers.shape[1]), centers, angles)
            row, cluster = np.nonzero((found > above) & (found <= upto) & (tiles > 0))
            bound = found[row, cluster]
            row, cluster, bound = (np.repeat(a, parts[cluster]) for a in (row, cluster, bound))
            first = np.flatnonzero(np.diff(row * len(centers) + cluster, prepend=-1))
            part = np.arange(len(row)) - np.repeat(first, np.diff(np.append(first, len(row))))
            with np.errstate(over="ignore"):
                mixed = ids.view(np.uint64)[row] * np.uint64(0x9E3779B97F4A7C15)
            tile = (mixed >> np.uint64(32)) % tiles[cluster].astype(np.uint64)
            for at in range(0, len(row), 1 << 14):
                cut = slice(at, at + (1 << 14))
                kept = pa.array(row[cut])
                yield pa.RecordBatch.from_arrays([pa.array(cluster[cut], pa.int32()), pa.array(tile[cut].astype(np.int64)), pa.array(part[cut], pa.int32()), *(c.take(kept) for c in batch.columns), pa.array(bound[cut])], ["cluster", "tile", "part", "id", "label", "q", "bound"])

    return rows.mapInArrow(run, "cluster int, tile long, part int, id long, label long, q array<long>, bound double")


def _better(held: list[tuple[int, int]], scores: np.ndarray, ids: np.ndarray, most: int) -> list[tuple[int, int]]:
    """The best ``most`` of (minus score, id)."""
    return sorted([*held, *zip((-scores).tolist(), ids.tolist(), strict=True)])[:most]


def _walk(positives: int, negatives: int, low: int, high: int, seek: str, width: int) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """Walks of the members (id, label, q, holds, goals) along a tile of their list: id, goal, other and score of what may count.

    holds: the score that the member's goal must beat or equal, from the stretches before; goals: scores of the positives.
    """

    def run(tile: pa.Table, members: pa.Table) -> pa.Table:
        out: list[tuple[int, int, int, int]] = []
        if tile.num_rows and members.num_rows:
            order = np.argsort(-tile.column("bound").to_numpy(), kind="stable")
            bound, ids, labels = (tile.column(c).to_numpy()[order] for c in ("bound", "id", "label"))
            rows, q = matrix(tile.column("q"), width)[order], matrix(members.column("q"), width)
            own, kind, size = members.column("id").to_numpy(), members.column("label").to_numpy(), np.linalg.norm(q.astype(np.float64), axis=1)
            goals = [[None] * 1 if seek == "positives" else g for g in members.column("goals").to_pylist()]
            # scores allowed for each goal, and what must be reached
            span = [[(None, None) if g is None else (-(-low * g // 100), high * g // 100) for g in gs] for gs in goals]
            reach = [[-float("inf") if h is None else h for h in hs] for hs in members.column("holds").to_pylist()]
            reach = [[max(r, lo if lo is not None else r) for r, (lo, _) in zip(rs, s, strict=True)] for rs, s in zip(reach, span, strict=True)]
            most = positives if seek == "positives" else negatives
            held: list[list[list]] = [[[] for _ in s] for s in span]
            live = np.arange(len(own))
            for at in range(0, len(ids), BLOCK):
                need = np.array([min((r for r, (lo, hi) in zip(reach[i], span[i], strict=True) if lo is None or lo <= hi), default=float("inf")) for i in live])
                live = live[_up(size[live] * bound[at]) >= need]
                if not len(live):
                    break
                cut = slice(at, at + BLOCK)
                scores = products(q[live], rows[cut])
                same = kind[live][:, None] == labels[cut]
                fit = (same & (own[live][:, None] != ids[cut])) if seek == "positives" else ~same
                fit &= scores >= np.array([min(reach[i]) for i in live])[:, None]
                for k in np.flatnonzero(fit.any(1)).tolist():
                    i = int(live[k])
                    where = np.flatnonzero(fit[k])
                    s, other = scores[k, where], ids[cut][where]
                    for g, (lo, hi) in enumerate(span[i]):
                        take = s >= reach[i][g]
                        if lo is not None:
                            take &= s <= hi
                        if take.any():
                            held[i][g] = _better(held[i][g], s[take], other[take], most)
                            if len(held[i][g]) == most:
                                reach[i][g] = max(reach[i][g], -held[i][g][-1][0])
            out = [(int(own[i]), g, other, -s) for i, every in enumerate(held) for g, some in enumerate(every) for s, other in some]
        columns = list(zip(*out, strict=True)) or [[]] * 4
        return pa.table({"id": pa.array(columns[0], pa.int64()), "goal": pa.array(columns[1], pa.int32()), "other": pa.array(columns[2], pa.int64()), "score": pa.array(columns[3], pa.int64())})

    return run


def _best(found: DataFrame, most: int) -> DataFrame:
    order = Window.partitionBy("id", "goal").orderBy(F.desc("score"), "other")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= most)


def mine(vectors: DataFrame, *, anchor: Column | None = None, positives: int = POSITIVES, negatives: int = NEGATIVES, low: int = LOW, high: int = HIGH, scale: int = SCALE, members: int = MEMBERS, stretches: tuple[float, ...] = STRETCHES, tile_rows: int = TILE_ROWS, together: int = TOGETHER, sample: int = SAMPLE) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score and negative_score; ``anchor``: which ids are anchors (default: those that 100 divides)."""
    spark = vectors.sparkSession
    rows = written(whole_vectors(vectors, scale=scale), name="vectors")
    chosen = rows.filter(F.col("id") % 100 == 0 if anchor is None else anchor)
    counted, width = rows.agg(F.count("*"), F.coalesce(F.max(F.size("q")), F.lit(0))).first()
    wanted = chosen.count()
    if not wanted:
        return spark.createDataFrame([], RESULT)
    picked = lambda df, n: matrix(pa.array([r.q for r in df.orderBy(F.xxhash64("id"), "id").limit(n).collect()], pa.list_(pa.int64())), width).astype(np.float64)
    some = picked(chosen, sample)
    # vectors of one direction make one cluster
    centers = centroids(some, min(max(4, -(-wanted // members)), MOST_CLUSTERS, len(some)))
    anchors = written(_assigned(chosen, centers), name="anchors")
    sizes = {r.cluster: r for r in anchors.groupBy("cluster").agg(F.count("*").alias("n"), F.max("angle").alias("angle")).collect()}
    count = np.array([sizes[c].n if c in sizes else 0 for c in range(len(centers))])
    angles = np.array([sizes[c].angle if c in sizes else 0.0 for c in range(len(centers))])
    parts = np.maximum(1, -(-count // together))
    seen = bounds(picked(rows, CUTS), centers, angles)
    ends = [np.quantile(seen, 1 - s, axis=0) if s < 1 else np.full(len(centers), -np.inf) for s in stretches]

    def search(goals: DataFrame, seek: str, most: int) -> DataFrame:
        """id, goal, other and score: the best rows for each goal of the anchors (id, goals)."""
        base = written(anchors.join(goals, "id").select("id", "label", "q", "cluster", "goals", F.sqrt(F.aggregate("q", F.lit(0.0), lambda a, x: a + x * x)).alias("size")), name="members")
        live = base.withColumn("holds", F.transform("goals", lambda g: F.lit(None).cast("long")))
        best, above = None, np.full(len(centers), np.inf)
        for k, (share, end) in enumerate(zip(stretches, ends, strict=True)):
            walkers = {r.cluster for r in live.select("cluster").distinct().collect()}
            if not walkers:
                break
            begin = stretches[k - 1] if k else 0
            tiles = np.array([max(1, -(-int(counted * (share - begin)) // tile_rows)) if c in walkers else 0 for c in range(len(centers))])
            stretch = _stretch(rows, centers, angles, end, above, tiles, parts)
            at = F.get(F.array(*(F.lit(int(t)) for t in tiles)), F.col("cluster"))
            part = F.pmod(F.xxhash64("id"), F.get(F.array(*(F.lit(int(p)) for p in parts)), F.col("cluster"))).cast("int")
            met = live.withColumn("part", part).withColumn("tile", F.explode(F.sequence(F.lit(0).cast("long"), at.cast("long") - 1))).select("cluster", "tile", "part", "id", "label", "q", "goals", "holds")
            key = ["cluster", "tile", "part"]
            walked = stretch.groupBy(*key).cogroup(met.groupBy(*key)).applyInArrow(_walk(positives, negatives, low, high, seek, width), "id long, goal int, other long, score long")
            best = written(_best(walked if best is None else walked.unionByName(best.drop("rank")), most), name="best")
            above = end
            if k < len(stretches) - 1:
                # the score that a goal holds once it has all it wants
                held = best.filter(F.col("rank") == most).groupBy("id").agg(F.map_from_entries(F.collect_list(F.struct("goal", "score"))).alias("held"))
                now = base.join(held, "id", "left").withColumn("holds", F.transform("goals", lambda g, i: F.try_element_at("held", i)))
                next_bound = F.get(F.array(*(F.lit(float(e)) for e in end)), F.col("cluster")) * F.col("size")
                next_bound = next_bound + F.abs(next_bound) * SLACK + SLACK
                if seek == "positives":
                    open_ = F.exists("holds", lambda h: h.isNull() | (h <= next_bound))
                else:
                    open_ = F.exists(F.zip_with("goals", "holds", lambda g, h: (F.ceil(g * low / 100) <= F.floor(g * high / 100)) & (g * low / 100 <= next_bound) & (h.isNull() | (h <= next_bound))), lambda x: x)
                live = written(now.filter(open_).select(*live.columns), name="live")
        return best

    first = search(anchors.select("id", F.array(F.lit(0).cast("long")).alias("goals")), "positives", positives)
    goals = first.groupBy("id").agg(F.transform(F.sort_array(F.collect_list(F.struct("rank", "score"))), lambda x: x["score"]).alias("goals"))
    found = search(goals, "negatives", negatives)
    if found is None:
        return spark.createDataFrame([], RESULT)
    own = first.select("id", (F.col("rank") - 1).alias("goal"), F.col("other").alias("positive_id"), F.col("score").alias("positive_score"))
    joined = found.join(own, ["id", "goal"])
    return joined.select(F.col("id").alias("anchor_id"), "positive_id", F.col("rank").cast("int").alias("rank"), F.col("other").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
