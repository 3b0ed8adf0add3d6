"""Repeated passages: removes each byte covered by a string of ``length`` bytes that also starts anywhere else.

1. Anchors. In each window of ``length`` bytes the 64-byte gram of least hash is its anchor (the leftmost, on a tie).
   Consecutive windows with one anchor make a segment. Equal windows have equal anchors at equal places, so repeats
   are found among the segments of one anchor. Segments are told by hashes; equal ones are stored once with their
   number. Anchors of one segment only go no further.
2. Index. The texts of the distinct segments are gathered by anchor into buckets of a few MB. A bucket's text gets a
   Burrows-Wheeler transform, of which the runs are kept: the suffix-array samples at the heads and ends of runs and the
   common prefixes with the row before a head and after an end. Between samples these lengths go down by one a
   byte, so matching statistics (the longest match of each place with any other) are streamed from the samples alone.
   Windows whose statistic reaches ``length`` repeat.
3. Frequent anchors. When an anchor has more than ``group`` distinct segments, they are split by the place of the
   anchor in the window and keyed by the bytes that all windows of such a part have in common, with parts of 48, then 6,
   then 1 windows. In the last all of a window is its key and counting decides. No bucket holds an unbounded group.
4. The spans of each document are joined to it and cut out.

Text is UTF-8 bytes; null counts as empty. Texts shorter than ``length`` stay whole. Matches never cross documents.
Repeated rows are copies of each other; ids should be unique: rows of one id share their spans. Empty tables give empty
results. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spellaudit.llm.common import skewed_join, written

LENGTH, GRAM = 400, 64
#: Windows handled at once, so that places fit below a hash.
BLOCK = 1 << 22
BUCKET_BYTES = 1_500_000
#: Distinct segments of one anchor beyond which they are split.
GROUP = 1500
WIDTHS = (48, 6, 1)


def _mix(x: np.ndarray) -> np.ndarray:
    x = x * np.uint64(0x9E3779B97F4A7C15)
    return x ^ (x >> np.uint64(29))


def gram_hashes(raw: bytes) -> np.ndarray:
    """A hash of the 64 bytes that start at each place."""
    h = _mix(np.ndarray((len(raw) - 7,), "<u8", raw, strides=(1,)) + np.uint64(1))
    for k in (8, 16, 32):
        h = _mix(h[:-k] * np.uint64(0xC2B2AE3D27D4EB4F) + h[k:])
    return h


def segments(raw: bytes, length: int) -> Iterator[tuple[int, int, int, int]]:
    """First and last window, place and hash of the anchor, of each segment."""
    low = np.uint64((1 << 24) - 1)
    for start in range(0, max(0, len(raw) - length + 1), BLOCK):
        part = raw[start : start + BLOCK + length - 1]
        hashes = gram_hashes(part)
        least, width, need = (hashes & ~low) | np.arange(len(hashes), dtype=np.uint64), 1, length - GRAM + 1
        while 2 * width <= need:
            least = np.minimum(least[:-width], least[width:])
            width *= 2
        if width < need:
            least = np.minimum(least[: len(least) - (need - width)], least[need - width :])
        at = (least & low).astype(np.int64)
        first = np.flatnonzero(np.diff(at, prepend=-1))
        last = np.append(first[1:] - 1, len(at) - 1)
        for a, b, m, h in zip(first.tolist(), last.tolist(), at[first].tolist(), hashes[at[first]].view(np.int64).tolist(), strict=True):
            yield start + a, start + b, start + m, h


class RunIndex:
    """The run-compressed transform of a text: samples at heads and ends of runs."""

    def __init__(self, text: bytes):
        n = self.n = len(text)
        grams = np.ndarray((n,), ">u8", text + bytes(8), strides=(1,)).astype(np.uint64)
        sa = self._suffixes(grams)
        bwt = np.frombuffer(text, np.uint8)[sa - 1]
        change = np.flatnonzero(bwt[1:] != bwt[:-1])
        zero = int(np.flatnonzero(sa == 0)[0])
        # the row of the whole text has no byte before it, whatever its neighbours have: it parts them
        heads = np.unique(np.concatenate(([0, zero, min(zero + 1, n - 1)], change + 1)))
        ends = np.unique(np.concatenate(([n - 1, zero, max(zero - 1, 0)], change)))
        self.runs = len(change) + 1
        self.heads = sa[heads], self._common(grams, sa[heads], np.where(heads > 0, sa[heads - 1], -1))
        self.ends = sa[ends], self._common(grams, sa[ends], np.where(ends < n - 1, sa[np.minimum(ends + 1, n - 1)], -1))

    def _suffixes(self, grams: np.ndarray) -> np.ndarray:
        """Prefix doubling from 8 bytes; only places whose rank is shared are sorted again."""
        n = self.n
        sa = np.argsort(grams, kind="stable")
        s = grams[sa]
        starts = np.maximum.accumulate(np.where(np.append(True, s[1:] != s[:-1]), np.arange(n), 0))
        rank = np.empty(n + 1, np.int64)
        rank[sa], rank[n] = starts, -1
        k = 8
        while True:
            first = np.append(starts[1:] != starts[:-1], True) & np.append(True, starts[1:] != starts[:-1])
            slots = np.flatnonzero(~first)
            if not len(slots):
                return sa
            idx = sa[slots]
            key = rank[idx] << 32 | (rank[np.minimum(idx + k, n)] + 1)
            order = np.argsort(key, kind="stable")
            sa[slots], key = idx[order], key[order]
            starts[slots] = np.maximum.accumulate(np.where(np.append(True, key[1:] != key[:-1]), slots, 0))
            rank[sa[slots]] = starts[slots]
            k *= 2

    def _common(self, grams: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Lengths of the common prefixes of the suffixes at a and b (-1: none)."""
        out = np.zeros(len(a), np.int64)
        live = np.flatnonzero(b >= 0)
        while len(live):
            x, y = a[live] + out[live], b[live] + out[live]
            inside = np.maximum(x, y) < self.n
            live, x, y = live[inside], x[inside], y[inside]
            diff = grams[x] ^ grams[y]
            equal = sum((diff < np.uint64(1) << np.uint64(s)).astype(np.int64) for s in range(8, 64, 8)) + (diff == 0)
            out[live] += np.minimum(equal, self.n - np.maximum(x, y))
            live = live[equal == 8]
        return out

    def matching_statistics(self) -> np.ndarray:
        """For each place, the length of its longest match that starts at another place; streamed from the samples."""
        place = np.arange(self.n)

        def stream(samples: np.ndarray, lengths: np.ndarray) -> np.ndarray:
            order = np.argsort(samples)
            at = samples[order]
            return np.repeat(lengths[order] + at, np.diff(np.append(at, self.n))) - place

        return np.maximum(stream(*self.heads), stream(*self.ends))


def _mark(length: int):
    def run(table: pa.Table) -> pa.Table:
        contents = [x.as_py() for x in table.column("content")]
        # 0xFF is in no UTF-8 text
        text = b"\xff".join(contents) + b"\xff"
        begins = np.cumsum([0] + [len(c) + 1 for c in contents[:-1]])
        windows = table.column("nwin").to_numpy()
        edge = np.zeros(len(text) + 1, np.int64)
        edge[begins] += 1
        edge[begins + windows] -= 1
        flag = (RunIndex(text).matching_statistics() >= length) & (edge.cumsum()[:-1] > 0)
        bounds = np.diff(flag.astype(np.int8), prepend=0, append=0)
        first, last = np.flatnonzero(bounds == 1), np.flatnonzero(bounds == -1) - 1
        of = np.searchsorted(begins, first, "right") - 1
        return pa.table({"key": table.column("key").take(pa.array(of)), "seg": table.column("seg").take(pa.array(of)), "a": pa.array(first - begins[of], pa.int32()), "b": pa.array(last - begins[of], pa.int32())})

    return run


def _solve(segs: DataFrame, length: int, group: int, widths: tuple[int, ...]) -> DataFrame:
    """key, seg, a, b: the runs of windows that repeat, among distinct segments (key, seg, nd, content, c0, nwin)."""
    total = segs.agg(F.sum(F.when(F.col("nd") <= group, F.octet_length("content"))).alias("small"), F.max("nd").alias("most")).first()
    buckets = int((total.small or 0) / BUCKET_BYTES) + 1
    small = segs.filter(F.col("nd") <= group).select(F.pmod(F.xxhash64("key"), F.lit(buckets)).alias("bucket"), "key", "seg", "content", "nwin")
    out = small.groupBy("bucket").applyInArrow(_mark(length), "key long, seg long, a int, b int")
    if not widths or (total.most or 0) <= group:
        return out
    w = widths[0]
    hot = segs.filter(F.col("nd") > group)
    first, last = F.floor((F.col("c0") - F.col("nwin") + 1) / w), F.floor(F.col("c0") / w)
    cut = hot.select(F.col("key").alias("pkey"), F.col("seg").alias("pseg"), "content", "c0", "nwin", F.explode(F.sequence(first, last)).alias("j"))
    cut = cut.withColumn("off", F.greatest(F.col("c0") - F.col("j") * w - w + 1, F.lit(0)).cast("int")).withColumn("until", F.least(F.col("c0") - F.col("j") * w, F.col("nwin") - 1).cast("int"))
    part = F.expr(f"substring(content, off + 1, until - off + {length})")
    core = F.expr(f"substring(content, cast(c0 - j * {w} + 1 as int), {length - w + 1})")
    parts = written(cut.select("pkey", "pseg", "off", F.xxhash64("pkey", F.lit(w), "j", core).alias("key"), part.alias("content"), (F.col("c0") - F.col("off")).cast("int").alias("c0"), (F.col("until") - F.col("off") + 1).alias("nwin")).withColumn("seg", F.xxhash64("content")), name="parts")
    distinct = parts.groupBy("key", "seg").agg(F.count("*").alias("n"), F.any_value("content").alias("content"), F.min("c0").alias("c0"), F.min("nwin").alias("nwin"))
    sizes = distinct.groupBy("key").agg(F.count("*").alias("nd"), F.sum("n").alias("total")).filter("total > 1").drop("total")
    sub = written(distinct.join(sizes, "key"), name="segments")
    marks = sub.filter("n > 1").select("key", "seg", F.lit(0).alias("a"), (F.col("nwin") - 1).alias("b")).unionByName(_solve(sub.filter("nd > 1").drop("n"), length, group, widths[1:]))
    back = _at_places(parts.select("pkey", "pseg", "off", "key", "seg"), marks, sub).select(F.col("pkey").alias("key"), F.col("pseg").alias("seg"), "off", F.explode("runs").alias("r"))
    return out.unionByName(back.select("key", "seg", (F.col("off") + F.col("r.a")).alias("a"), (F.col("off") + F.col("r.b")).alias("b")))


def _at_places(places: DataFrame, marks: DataFrame, counted: DataFrame) -> DataFrame:
    """``places`` with the runs of their segments; a segment that very many places have stays spread. ``counted`` has n, their number."""
    runs = marks.groupBy("key", "seg").agg(F.collect_set(F.struct("a", "b")).alias("runs"))
    groups = written(runs.join(counted.select("key", "seg", F.col("n").alias("_n")), ["key", "seg"]), name="runs")
    return skewed_join(places, groups, ["key", "seg"], "_n").drop("_n")


def _raw(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", F.encode(F.coalesce(F.col("text"), F.lit("")), "UTF-8").alias("raw"))


def repeated_spans(docs: DataFrame, *, length: int = LENGTH, group: int = GROUP) -> DataFrame:
    """doc_id and spans, an array of (start, end) in bytes, for documents with repeats; spans may overlap."""
    if length < 2 * GRAM:
        raise ValueError(f"length must be {2 * GRAM} at least")
    kind = dict(docs.dtypes)["doc_id"]

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            who, rows = [], []
            for i, raw in enumerate(batch.column(1).to_pylist()):
                before = len(rows)
                for a, b, m, h in segments(raw, length):
                    rows.append((a, b, m, h, xxhash.xxh3_64_intdigest(raw[a : b + length]) - (1 << 63)))
                who += [i] * (len(rows) - before)
            columns = list(zip(*rows, strict=True)) or [[]] * 5
            kinds = [pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(who, pa.int64())), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], ["doc_id", "lo", "hi", "at", "key", "seg"])

    found = written(_raw(docs).mapInArrow(find, f"doc_id {kind}, lo int, hi int, at int, key long, seg long"), name="anchors")
    distinct = found.groupBy("key", "seg").agg(F.count("*").alias("n"), F.min(F.struct("doc_id", "lo", "hi", "at")).alias("one"))
    sizes = distinct.groupBy("key").agg(F.count("*").alias("nd"), F.sum("n").alias("total")).filter("total > 1").drop("total")
    known = written(distinct.join(sizes, "key"), name="segments")
    wanted = known.filter("nd > 1").groupBy(F.col("one.doc_id").alias("doc_id")).agg(F.collect_list(F.struct("key", "seg", "nd", F.col("one.lo").alias("lo"), F.col("one.hi").alias("hi"), F.col("one.at").alias("at"))).alias("w"))
    taken = _raw(docs).join(wanted, "doc_id").select(F.explode(F.expr(f"transform(w, x -> struct(x.key, x.seg, x.nd, substring(raw, x.lo + 1, x.hi - x.lo + {length}) AS content, x.at - x.lo AS c0, x.hi - x.lo + 1 AS nwin))")).alias("s")).select("s.*")
    segs = written(taken, name="texts")
    marks = known.filter("n > 1").select("key", "seg", F.lit(0).alias("a"), (F.col("one.hi") - F.col("one.lo")).alias("b")).unionByName(_solve(segs, length, group, WIDTHS))
    spans = _at_places(found, marks, known).select("doc_id", F.expr(f"transform(runs, r -> struct(lo + r.a AS start, lo + r.b + {length} AS end))").alias("s"))
    return spans.groupBy("doc_id").agg(F.flatten(F.collect_list("s")).alias("spans"))


def remove_repeats(docs: DataFrame, *, length: int = LENGTH, group: int = GROUP, keep_bytes: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of each document; keep_bytes: also the bytes that stay."""
    kind = dict(docs.dtypes)["doc_id"]

    def cut(raw: bytes, spans: list[dict] | None) -> tuple:
        kept, end, removed, n = [], 0, 0, 0
        reach = -1
        for a, b in sorted((s["start"], s["end"]) for s in spans or []):
            if a > reach:
                n += 1
                kept.append(raw[end:a])
                end = a
            if b > reach:
                reach = b
                removed += b - end
                end = b
        left = b"".join([*kept, raw[end:]])
        return (len(raw), removed, n, hashlib.sha256(left).hexdigest(), left)[: 4 + keep_bytes]

    kinds = {"n_bytes": pa.int64(), "n_removed": pa.int64(), "n_spans": pa.int64(), "kept_sha256": pa.string(), **({"kept": pa.binary()} if keep_bytes else {})}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = list(zip(*map(cut, batch.column(1).to_pylist(), batch.column(2).to_pylist()), strict=True)) or [[]] * len(kinds)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(v, t) for v, t in zip(rows, kinds.values(), strict=True))], ["doc_id", *kinds])

    with_spans = _raw(docs).join(repeated_spans(docs, length=length, group=group), "doc_id", "left").select("doc_id", "raw", "spans")
    return with_spans.mapInArrow(run, f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * keep_bytes)
