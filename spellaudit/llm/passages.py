"""Passages repeated from earlier documents: removes each word covered by ``window`` words that also start in a document of a smaller id.

1. Blocks. A document's words are cut into blocks of half a window that do not overlap, from its start on: any window holds
   a whole block of the document it comes from. All blocks are indexed, and every rolling window of a block's size
   probes the index. Either is named by its anchor: the least hash of its runs of ``gram`` words, so that rolling windows next to
   each other mostly probe by one name, and equal windows by the same. Names are kept for which the least document with a block is
   smaller than the greatest document that probes.
2. Hits. A document gets the names by which its windows hit smaller documents' blocks, and those by which its blocks are
   hit. Only such documents go on, with their texts.
3. Extension. Each hit is extended to all windows that hold it (of a block: those in which it is the first whole block),
   and these are compared by hashes of all their words with the least document that has them. Windows that are
   confirmed run into each other: their unions are the maximal repeats, which are cut out.

Documents of the same words as a smaller one are told by one hash before all this and lose every word if they have a window at least; only
the least of them is indexed. No pair of documents is ever made; names and windows that very many documents share stay spread.

Windows are told by 64-bit hashes. Null text has no words; texts of fewer words than a window, empty or not, stay whole. Texts
are whole at any length. Rows of one doc_id are taken for copies of one document and do not count against each other; a
null doc_id is smaller than none and greater than none: its row stays whole. Empty tables give empty results. Other columns are ignored.
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
from spellaudit.llm.periodic import doubled, split_words

WINDOW, GRAM = 50, 8
#: Ids of documents that are copies or have hits are broadcast up to this number (8 bytes each); more are joined by shuffle.
BROADCAST_IDS = 4_000_000


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


def rolled(levels: list[np.ndarray], size: int) -> np.ndarray:
    """A hash of the ``size`` words from each place on, put together from hashes of 1, 2, 4, ... words."""
    n = len(levels[0]) - size + 1
    out, at = np.zeros(max(0, n), np.uint64), 0
    for j in range(size.bit_length() - 1, -1, -1):
        if size >> j & 1 and n > 0:
            x = (out ^ levels[j][at : at + n]) * np.uint64(0x9E3779B97F4A7C15)
            out, at = x ^ (x >> np.uint64(32)), at + (1 << j)
    return out


def anchors(levels: list[np.ndarray], block: int, gram: int) -> np.ndarray:
    """The least hash of the grams in each rolling window of ``block`` words."""
    least, width, need = rolled(levels, gram), 1, block - gram + 1
    while 2 * width <= need:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    return np.minimum(least[: len(least) - (need - width)], least[need - width :]) if width < need else least


def _named(kind: str, window: int, gram: int):
    """From doc_id and text: number of words, hash of them all, and the names of its blocks and of its other windows."""
    block = window // 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, whole, sha, blocks, others = [], [], [], [], []
            for text in batch.column(1).to_pylist():
                words = split_words(text)
                joined = b" ".join(words)
                n.append(len(words))
                whole.append(xxhash.xxh3_128_digest(joined))
                sha.append(hashlib.sha256(joined).hexdigest())
                if len(words) < window:
                    blocks.append([])
                    others.append([])
                    continue
                named = anchors(doubled(word_hashes(words)), block, gram)
                own = np.unique(named[::block])
                change = np.append(True, named[1:] != named[:-1])
                blocks.append(own.view(np.int64))
                others.append(np.setdiff1d(named[change], own).view(np.int64))
            lists = pa.list_(pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(whole, pa.binary()), pa.array(sha, pa.string()), pa.array(blocks, lists), pa.array(others, lists)], ["doc_id", "n", "whole", "sha", "blocks", "others"])

    return run, f"doc_id {kind}, n long, whole binary, sha string, blocks array<long>, others array<long>"


def _places(named: np.ndarray, names: list[int] | None) -> np.ndarray:
    return np.isin(named, np.array(names or [], np.int64).view(np.uint64))


def _windows(kind: str, window: int, gram: int):
    """From doc_id, text and the names of its hits: hashes of the windows that its probes and its blocks are extended to."""
    block = window // 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            who, hashes, flags = [], [], []
            for i, (text, hit, kept) in enumerate(zip(*(batch.column(c).to_pylist() for c in (1, 2, 3)), strict=True)):
                levels = doubled(word_hashes(split_words(text)))
                named, whole = anchors(levels, block, gram), rolled(levels, window)
                # a window holds the probes that start in its first half
                reach = np.convolve(_places(named, hit), np.ones(block, np.int64))[block - 1 :][: len(whole)] > 0
                first = -(-np.arange(len(whole)) // block) * block
                held = _places(named[::block], kept)[first // block]
                for mask, flag in ((reach, False), (held, True)):
                    got = np.unique(whole[mask])
                    hashes.append(got)
                    who.append(np.full(len(got), i))
                    flags.append(np.full(len(got), flag))
            who = np.concatenate(who) if who else np.empty(0, np.int64)
            hashes = np.concatenate(hashes).view(np.int64) if hashes else np.empty(0, np.int64)
            flags = np.concatenate(flags) if flags else np.empty(0, bool)
            for at in range(0, len(who), 1 << 16):
                cut = slice(at, at + (1 << 16))
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(who[cut])), pa.array(hashes[cut]), pa.array(flags[cut])], ["doc_id", "w", "held"])

    return run, f"doc_id {kind}, w long, held boolean"


def _cut(kind: str, window: int, keep_text: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n_removed, sha, texts = [], [], []
            for text, found in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                words = split_words(text)
                whole = rolled(doubled(word_hashes(words)), window)
                at = np.flatnonzero(np.isin(whole, np.array(found, np.int64).view(np.uint64)))
                edge = np.zeros(len(words) + 1, np.int64)
                np.add.at(edge, at, 1)
                np.add.at(edge, at + window, -1)
                gone = edge.cumsum()[:-1] > 0
                left = b" ".join([words[i] for i in np.flatnonzero(~gone).tolist()])
                n_removed.append(int(gone.sum()))
                sha.append(hashlib.sha256(left).hexdigest())
                texts.append(left.decode("utf-8", "surrogatepass") if keep_text else None)
            arrays = [batch.column(0), pa.array(n_removed, pa.int64()), pa.array(sha, pa.string()), pa.array(texts, pa.string())]
            yield pa.RecordBatch.from_arrays(arrays[: 3 + keep_text], ["doc_id", "n_removed", "kept_sha256", "kept"][: 3 + keep_text])

    return run, f"doc_id {kind}, n_removed long, kept_sha256 string" + ", kept string" * keep_text


def _least_and_greatest(rows: DataFrame, key: str, held: str) -> DataFrame:
    """key, lo (the least document that holds it), n (its rows): of keys that a document greater than lo has, too."""
    lo = F.min(F.when(F.col(held), F.col("doc_id"))).alias("lo")
    return rows.groupBy(key).agg(lo, F.max("doc_id").alias("hi"), F.count("*").alias("n")).filter("lo < hi")


def _by_ids(rows: DataFrame, ids: DataFrame, how: str, most: int) -> DataFrame:
    """A semi or anti join that does not shuffle the rows while the ids, a written table, are few."""
    return rows.join(F.broadcast(ids) if ids.limit(most + 1).count() <= most else ids, "doc_id", how)


def remove_passages(docs: DataFrame, *, window: int = WINDOW, gram: int = GRAM, broadcast_ids: int = BROADCAST_IDS, keep_text: bool = False) -> DataFrame:
    """doc_id, n_words, n_removed and kept_sha256 of each row; keep_text: also kept, the words that stay, where some go."""
    if window % 2 or window // 2 <= gram:
        raise ValueError(f"window must be even, and half of it more than {gram} words")
    kind = dict(docs.dtypes)["doc_id"]
    marks = written(docs.select("doc_id", "text").mapInArrow(*_named(kind, window, gram)), name="names")
    wide = marks.filter(F.col("n") >= window).filter("doc_id is not null")
    leads = written(wide.groupBy("whole").agg(F.min("doc_id").alias("lead"), F.count("*").alias("copies")), name="leads")
    # copies are told from the least of them; a text that very many documents have stays spread
    more = leads.filter("copies > 1")
    copies = skewed_join(wide.select("doc_id", "whole"), more, "whole", "copies").filter("doc_id != lead").select("doc_id").distinct()
    copies = written(copies, name="copies")
    own = _by_ids(wide, copies, "left_anti", broadcast_ids)
    events = own.select("doc_id", F.explode("blocks").alias("name"), F.lit(True).alias("held")).unionByName(own.select("doc_id", F.explode("others").alias("name"), F.lit(False).alias("held")))
    names = written(_least_and_greatest(events, "name", "held"), name="shared")
    hits = skewed_join(events, names, "name", "n")
    hit, kept = F.col("lo") < F.col("doc_id"), F.col("held") & (F.col("doc_id") < F.col("hi"))
    of_doc = hits.filter(hit | kept).groupBy("doc_id").agg(F.collect_set(F.when(hit, F.col("name"))).alias("hit"), F.collect_set(F.when(kept, F.col("name"))).alias("kept"))
    of_doc = written(of_doc, name="hits")
    # most documents have no hit: their texts need not be shuffled
    texts = _by_ids(docs.select("doc_id", "text").filter("doc_id is not null"), of_doc.select("doc_id"), "left_semi", broadcast_ids)
    found = written(texts.join(of_doc, "doc_id").select("doc_id", "text", "hit", "kept"), name="texts")
    rows = written(found.mapInArrow(*_windows(kind, window, gram)), name="windows")
    known = written(_least_and_greatest(rows, "w", "held"), name="repeats")
    confirmed = skewed_join(rows.filter("not held").select("doc_id", "w"), known.select("w", "lo", "n"), "w", "n").filter(F.col("lo") < F.col("doc_id"))
    of_doc = confirmed.groupBy("doc_id").agg(F.collect_set("w").alias("w"))
    cut = found.filter(F.size("hit") > 0).select("doc_id", "text").join(of_doc, "doc_id").mapInArrow(*_cut(kind, window, keep_text))
    none = hashlib.sha256(b"").hexdigest()
    whole = copies.select("doc_id", F.lit(None).cast("long").alias("n_removed"), F.lit(none).alias("kept_sha256"), *([F.lit("").alias("kept")] if keep_text else []))
    changed = cut.unionByName(whole).dropDuplicates(["doc_id"]).withColumnRenamed("kept_sha256", "changed").withColumn("_found", F.lit(True))
    every = marks.select("doc_id", "n", "sha").join(changed, "doc_id", "left")
    removed = F.when(F.col("_found").isNull(), 0).otherwise(F.coalesce("n_removed", "n"))
    return every.select("doc_id", F.col("n").alias("n_words"), removed.alias("n_removed"), F.coalesce("changed", "sha").alias("kept_sha256"), *(["kept"] if keep_text else []))
