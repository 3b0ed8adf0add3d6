"""Periodic runs of words: stretches with a period, as long as they can be, of ``least`` words and ``2 * period`` at least.

A run of period p is a stretch of places whose words equal those p places on: its *matches*, p of them at least.

1. Tiles. Periods are parted into octaves (1 to 7, then 2**k to 2**(k+1) - 1). A document is cut into tiles for each
   octave: ``tile`` words or twice the octave's largest period, whichever is more, and enough words on both sides that
   every match of a tile's own places is seen with as many matches as a run must have. Small octaves have their tiles in
   common. Documents of up to ``long_bytes`` are one tile, solved where they are read; the tiles of longer ones are dealt
   over all tasks.
2. Boundaries. In a tile of the octave of 2**k the boundaries are 2**(k-1) words apart, so a run's matches hold all words
   from one boundary to the next. Of each boundary and each period of the octave the Z-value is asked for (how far the
   words from the boundary on equal those p places on): first whether it reaches 2**(k-1), by hashes of that many words
   side by side; where it does the whole value to the right and its mirror to the left, by binary descent over hashes
   of 1, 2, 4, ... words. Boundaries next to each other that match are one stretch and are followed once. A stretch whose
   period's words repeat a shorter stretch (tried for each prime of the period) has a smaller period and is left out.
3. Stitching. The fragments go by document and period; those that touch or overlap are one run, by a window over them.
4. The runs of a document are gathered to it and its text collapsed: a word goes if it is in a run after that run's
   first period. Only documents with fragments are joined with their text; others are done in the first step.

Stretches are told by 64-bit hashes. Null text has no words; empty texts and texts without words neither: no runs, the hash
of the empty string. Texts are whole at any length. Of runs of one length the least start counts, then the least period.
Rows of one doc_id are taken for copies of one document, each with its row in the result; a null doc_id is an id like others (its
words keep their order). Empty tables give empty results. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spellaudit.llm.common import parts, written

LEAST = 12
#: Periods of the first octave, which has its own boundaries: two words apart, with four words to match.
SMALL = 8
#: Words of a tile; bytes of a document beyond which its tiles are dealt over tasks.
TILE, LONG_BYTES = 1 << 16, 1 << 20
RUN = "array<struct<start: long, length: long, period: long>>"


def split_words(text: str | None) -> list[bytes]:
    """The words between blanks, tabs and line ends of any kind (ASCII)."""
    return (text or "").encode("utf-8", "surrogatepass").split()


def looped_tail(doc_id: int | None, n: int) -> np.ndarray | None:
    """For one id in ten the places of the original words of a text whose tail goes round and round; None: all as they are."""
    if doc_id is None or not n:
        return None
    h = zlib.crc32(str(doc_id).encode())
    if h % 10:
        return None
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    place = np.arange(n)
    place[a:] = a + (place[a:] - a) % p
    return place


def hashes(words: list[bytes], order: np.ndarray | None) -> np.ndarray:
    """Hashes of the words in their order; they hold within one process."""
    h = np.fromiter(map(hash, words), np.int64, len(words)).view(np.uint64)
    return h if order is None else h[order]


def doubled(h: np.ndarray) -> list[np.ndarray]:
    """Hashes of the 1, 2, 4, ... words from each place on."""
    h = h * np.uint64(0x9E3779B97F4A7C15)
    out, width = [h ^ (h >> np.uint64(31))], 1
    while 2 * width <= len(h):
        a = out[-1]
        x = (a[:-width] * np.uint64(0xC2B2AE3D27D4EB4F) + a[width:]) * np.uint64(0x9E3779B97F4A7C15)
        out.append(x ^ (x >> np.uint64(29)))
        width *= 2
    return out


def z_right(levels: list[np.ndarray], x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """How many words from x on equal those from y on (x < y)."""
    out = np.zeros(len(x), np.int64)
    for j in range(len(levels) - 1, -1, -1):
        a = levels[j]
        at = np.minimum(y + out, len(a) - 1)
        out += ((y + out < len(a)) & (a[np.minimum(x + out, len(a) - 1)] == a[at])).astype(np.int64) << j
    return out


def z_left(levels: list[np.ndarray], x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """How many words before x equal those before y (x < y)."""
    out = np.zeros(len(x), np.int64)
    for j in range(len(levels) - 1, -1, -1):
        a, at = levels[j], x - out - (1 << j)
        low = np.maximum(at, 0)
        out += ((at >= 0) & (a[np.minimum(low, len(a) - 1)] == a[np.minimum(low + y - x, len(a) - 1)])).astype(np.int64) << j
    return out


@lru_cache(1 << 16)
def primes_of(n: int) -> tuple[int, ...]:
    found, p = [], 2
    while p * p <= n:
        if n % p == 0:
            found.append(p)
            while n % p == 0:
                n //= p
        p += 1
    return (*found, n) if n > 1 else tuple(found)


def _same(levels: list[np.ndarray], x: int, y: int, length: int) -> bool:
    j = length.bit_length() - 1
    a, last = levels[j], length - (1 << j)
    return bool(a[x] == a[y] and a[x + last] == a[y + last])


def octaves(n: int) -> list[int]:
    """Octaves (0, then the power of two) in which a text of n words may have periods."""
    return [0, *range(SMALL.bit_length() - 1, max(0, n // 2).bit_length())]


def _boundaries(levels: list[np.ndarray], octave: int) -> tuple[np.ndarray, np.ndarray]:
    """Boundaries and periods of the octave where a stretch of matches is first met."""
    if not octave:
        a, where, periods = levels[2], [], []
        for p in range(1, min(SMALL, len(a))):
            hit = a[:-p:2] == a[p::2]
            if hit.any():
                hit[1:] &= ~hit[:-1].copy()
                at = 2 * np.flatnonzero(hit)
                where.append(at)
                periods.append(np.full(len(at), p))
        return (np.concatenate(where), np.concatenate(periods)) if where else (np.empty(0, np.int64), np.empty(0, np.int64))
    g = 1 << (octave - 1)
    a = levels[octave - 1]
    rows = max(0, -(-(len(a) - 2 * g) // g))
    filled = np.append(a, np.zeros(2 * g, np.uint64))
    after = np.lib.stride_tricks.as_strided(filled[2 * g :], (rows, 2 * g), (8 * g, 8), writeable=False)
    hit = after == a[: rows * g : g, None]
    if not hit.any():
        return np.empty(0, np.int64), np.empty(0, np.int64)
    hit[1:] &= ~hit[:-1].copy()
    row, col = np.nonzero(hit)
    return row * g, 2 * g + col


def solve(h: np.ndarray, begin: int, n: int, which: list[int], least: int = LEAST) -> Iterator[tuple[int, int, int]]:
    """Period and matches (first, end) of the stretches in a tile of a text of n words that starts at word ``begin``."""
    if len(h) < 4:
        return
    levels = doubled(h)
    for octave in which:
        if max(0, octave - 1) >= len(levels):
            continue
        x, p = _boundaries(levels, octave)
        if not len(x):
            continue
        first, end = x - z_left(levels, x, x + p), x + z_right(levels, x, x + p)
        cut = ((first == 0) & (begin > 0)) | ((end + p == len(h)) & (begin + len(h) < n))
        fit = (end > x) & (cut | (end - first >= np.maximum(p, least - p)))
        for a, b, at, period in zip(*(v[fit].tolist() for v in (first, end, x, p)), strict=True):
            if not any(_same(levels, at, at + period // r, period - period // r) for r in primes_of(period)):
                yield period, begin + a, begin + b


def tiles(n: int, size: int) -> Iterator[tuple[list[int], int, int]]:
    """Octaves, first word and end of each tile of a text of n words."""
    every = octaves(n)
    small = [k for k in every if k == 0 or 8 << k <= size]
    for which in [small, *([k] for k in every if k not in small)]:
        reach = max(SMALL, 1 << which[-1])
        core = max(size, 2 * reach)
        for at in range(0, n, core):
            yield which, max(0, at - reach), min(n, at + core + 3 * reach)


def _fragments(kind: str, least: int, order: Callable[[int | None, int], np.ndarray | None] | None):
    """From doc_id and text: its fragments and text, or, without fragments, the hash of its words."""
    schema = f"doc_id {kind}, text string, plain string, found array<struct<period: long, first: long, end: long>>"
    found_type = pa.list_(pa.struct([("period", pa.int64()), ("first", pa.int64()), ("end", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, plain, found = [], [], []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                words = split_words(text)
                n = len(words)
                h = hashes(words, order(doc, n) if order else None)
                got = [{"period": p, "first": a, "end": b} for p, a, b in solve(h, 0, n, octaves(n), least)]
                found.append(got)
                texts.append(text if got else None)
                plain.append(None if got else hashlib.sha256(_joined(words, order, doc)).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string()), pa.array(plain, pa.string()), pa.array(found, found_type)], ["doc_id", "text", "plain", "found"])

    return run, schema


def _joined(words: list[bytes], order: Callable | None, doc: int | None) -> bytes:
    place = order(doc, len(words)) if order else None
    return b" ".join(words if place is None else [words[i] for i in place.tolist()])


def _tiled(kind: str, size: int, order: Callable | None):
    """From doc_id and text: its tiles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                words = split_words(text)
                n = len(words)
                h = hashes(words, order(doc, n) if order else None)
                del words
                for which, a, b in tiles(n, size):
                    yield pa.RecordBatch.from_arrays([pa.array([doc], batch.schema.field(0).type), pa.array([n], pa.int64()), pa.array([which], pa.list_(pa.int32())), pa.array([a], pa.int64()), pa.array([h[a:b].tobytes()], pa.binary())], ["doc_id", "n", "octaves", "begin", "words"])

    return run, f"doc_id {kind}, n long, octaves array<int>, begin long, words binary"


def _solved(kind: str, least: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            who, rows = [], []
            for i, (n, which, begin, raw) in enumerate(zip(*(batch.column(c).to_pylist() for c in range(1, 5)), strict=True)):
                got = list(solve(np.frombuffer(raw, np.uint64), begin, n, which, least))
                rows += got
                who += [i] * len(got)
            columns = list(zip(*rows, strict=True)) or [[]] * 3
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(who, pa.int64())), *(pa.array(c, pa.int64()) for c in columns)], ["doc_id", "period", "first", "end"])

    return run, f"doc_id {kind}, period long, first long, end long"


def stitched(fragments: DataFrame, *, least: int = LEAST) -> DataFrame:
    """doc_id, start, length and period of the runs that the fragments (doc_id, period, first, end of matches) make up."""
    order = Window.partitionBy("doc_id", "period").orderBy("first", "end")
    before = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    marked = fragments.withColumn("_new", F.when(F.col("first") <= before, 0).otherwise(1))
    named = marked.withColumn("_of", F.sum("_new").over(order))
    whole = named.groupBy("doc_id", "period", "_of").agg(F.min("first").alias("start"), F.max("end").alias("end"))
    matches = F.col("end") - F.col("start")
    return whole.filter(matches >= F.greatest("period", least - F.col("period"))).select("doc_id", "start", (matches + F.col("period")).alias("length"), "period")


def _collapsed(kind: str, order: Callable | None, keep_text: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made, texts = [], []
            for doc, text, runs in zip(*(batch.column(c).to_pylist() for c in range(3)), strict=True):
                words = split_words(text)
                n = len(words)
                edge = np.zeros(n + 1, np.int64)
                for r in runs or []:
                    edge[r["start"] + r["period"]] += 1
                    edge[r["start"] + r["length"]] -= 1
                place = order(doc, n) if order else None
                place = np.arange(n) if place is None else place
                left = b" ".join([words[i] for i in place[edge.cumsum()[:-1] == 0].tolist()])
                made.append(hashlib.sha256(left).hexdigest())
                texts.append(left.decode("utf-8", "surrogatepass") if keep_text else None)
            arrays = [batch.column(0), batch.column(2), pa.array(made, pa.string()), pa.array(texts, pa.string())]
            yield pa.RecordBatch.from_arrays(arrays[: 3 + keep_text], ["doc_id", "runs", "collapsed_sha256", "collapsed"][: 3 + keep_text])

    return run, f"doc_id {kind}, runs {RUN}, collapsed_sha256 string" + ", collapsed string" * keep_text


def periodic_runs(docs: DataFrame, *, least: int = LEAST, tile: int = TILE, long_bytes: int = LONG_BYTES, order: Callable[[int | None, int], np.ndarray | None] | None = None, keep_text: bool = False) -> DataFrame:
    """doc_id, runs (start, length, period: by start, then period), collapsed_sha256 of each row; keep_text: also collapsed, where there are runs.

    ``order`` gives for a doc_id and its number of words which original word stands at each place (None: as they are).
    """
    kind, spark = dict(docs.dtypes)["doc_id"], docs.sparkSession
    size = F.coalesce(F.octet_length("text"), F.lit(0))
    one = docs.select("doc_id", "text").filter(size <= long_bytes).mapInArrow(*_fragments(kind, least, order))
    long = docs.select("doc_id", "text").filter(size > long_bytes)
    first = written(one.unionByName(long.select("doc_id", "text", F.lit(None).cast("string").alias("plain"), F.lit(None).cast("array<struct<period: long, first: long, end: long>>").alias("found"))), name="fragments")
    far = first.filter("plain is null and found is null").select("doc_id", "text").mapInArrow(*_tiled(kind, tile, order))
    dealt = far.repartition(parts(spark), F.xxhash64("doc_id", "octaves", "begin")).mapInArrow(*_solved(kind, least))
    fragments = first.select("doc_id", F.explode("found").alias("f")).select("doc_id", "f.period", "f.first", "f.end").unionByName(dealt)
    runs = stitched(fragments, least=least).groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("start", "length", "period"))).alias("runs")).withColumnRenamed("doc_id", "_id")
    open_ = first.filter("plain is null").select("doc_id", "text")
    done = open_.join(runs, open_.doc_id.eqNullSafe(F.col("_id")), "left").select("doc_id", "text", "runs").mapInArrow(*_collapsed(kind, order, keep_text))
    rest = first.filter("plain is not null").select("doc_id", F.lit(None).cast(RUN).alias("runs"), F.col("plain").alias("collapsed_sha256"), *([F.lit(None).cast("string").alias("collapsed")] if keep_text else []))
    every = done.unionByName(rest)
    return every.withColumn("runs", F.coalesce("runs", F.array().cast(RUN)))


def run_report(docs: DataFrame, **options) -> DataFrame:
    """doc_id, n_runs, start, length, period and exponent_milli of the longest run, runs_sha256 and collapsed_sha256 of each row."""
    found = periodic_runs(docs, **options)
    best = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("back"), (-r["period"]).alias("less"))))
    listed = F.array_join(F.transform("runs", lambda r: F.concat(r["start"].cast("string"), F.lit(","), r["length"].cast("string"), F.lit(","), r["period"].cast("string"), F.lit("\n"))), "")
    top = found.withColumn("_best", best).withColumn("n_runs", F.size("runs").cast("long")).withColumn("runs_sha256", F.sha2(listed, 256))
    return top.select("doc_id", "n_runs", (-F.col("_best.back")).alias("start"), F.col("_best.length").alias("length"), (-F.col("_best.less")).alias("period"), F.expr("1000 * _best.length div -_best.less").alias("exponent_milli"), "runs_sha256", "collapsed_sha256")
