"""Benchmark decontamination as a prefix-filtered set join.

A window is ``size`` consecutive words of a benchmark item; an item of fewer words, but not none, is one window. A
document contains a window only if it has all its tokens (a token: a word of the window), so of the tokens ordered by
rarity the first alone is the necessary prefix: documents are joined to windows on the rarest word of each window,
counted over all documents. A match must leave as many words before and after it as the window has (positional
bound), so its document is at least as long (length bound); then the words of the window are compared in place.

Steps: the words of the benchmark are counted in all documents (each task sends a row for each word it has seen); the
windows choose their prefix words; documents are probed. Windows and counts grow with the benchmark only. Up to
``broadcast_bytes`` of windows, each task gets all of them; beyond, documents are split into stretches of words with
their positions, which are shuffled and joined on the prefix word.

Words are runs of ASCII letters and digits and of non-ASCII characters, A-Z lower-cased. Null or wordless text has no
words, no hits and is not contaminated; null or wordless items have no windows. Repeated items and repeated documents
(by id) are taken by their rows: give ids that are unique. Empty tables give empty or clean results. Other columns are
ignored.
"""

from __future__ import annotations

import hashlib
import pickle
import re
from collections import Counter, defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spellaudit.llm.common import lean, values, written

#: Over the UTF-8 bytes of lower-cased text; all bytes of non-ASCII characters are words' bytes.
WORD = re.compile(rb"[0-9a-z\x80-\xff]+")
SIZE = 13


def words(text: str | None) -> list[bytes]:
    # bytes.lower() changes A-Z alone
    return WORD.findall((text or "").encode("utf-8", "surrogatepass").lower())


def windows_of(items: DataFrame, size: int = SIZE) -> DataFrame:
    """item (string), window (its words joined by spaces) for each distinct window of each item; by plain column functions."""
    lower = F.translate(F.coalesce(F.col("text"), F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    found = items.select(F.col("item_id").cast("string").alias("item"), F.regexp_extract_all(lower, F.lit("[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"), F.lit(0)).alias("w")).filter(F.size("w") > 0)
    starts = F.sequence(F.lit(0), F.greatest(F.size("w") - size, F.lit(0)))
    return found.select("item", F.explode(F.array_distinct(F.transform(starts, lambda i: F.array_join(F.slice("w", i + 1, size), " ")))).alias("window"))


def _counted(docs: DataFrame, vocabulary: DataFrame, small: bool) -> DataFrame:
    """word and n, the occurrences in docs, of each word of the vocabulary that occurs."""
    if not small:
        lower = F.translate(F.coalesce(F.col("text"), F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
        every = docs.select(F.explode(F.regexp_extract_all(lower, F.lit("[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"), F.lit(0))).alias("word")).groupBy("word").agg(F.count("*").alias("n"))
        return vocabulary.join(every, "word")
    known = docs.sparkSession.sparkContext.broadcast(frozenset(r.word.encode() for r in vocabulary.collect()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep, total = known.value, Counter()
        for batch in batches:
            for text in values(batch.column(0)):
                total.update([w for w in words(text) if w in keep])
        yield pa.RecordBatch.from_arrays([pa.array([w.decode("utf-8", "replace") for w in total], pa.string()), pa.array(list(total.values()), pa.int64())], ["word", "n"])

    return docs.select("text").mapInArrow(lean(run), "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def prefixed(docs: DataFrame, items: DataFrame, *, size: int = SIZE, small: bool = True) -> DataFrame:
    """word (the rarest of the window), at (its first place in the window), window and items (sorted)."""
    wins = written(windows_of(items, size).groupBy("window").agg(F.sort_array(F.collect_set("item")).alias("items")), name="windows")
    vocabulary = wins.select(F.explode(F.split("window", " ")).alias("word")).distinct()
    counts = _counted(docs, vocabulary, small)
    if small:  # no more words than the benchmark has, so that its frequent words stay spread
        counts = F.broadcast(counts)
    ranked = wins.select("window", "items", F.posexplode(F.split("window", " ")).alias("at", "word")).join(counts, "word", "left")
    # a window with a word that no document has cannot occur
    best = ranked.groupBy("window").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "word", "at")).alias("p"), F.first("items").alias("items"))
    return best.filter("p.n > 0").select("p.word", "p.at", "window", "items")


def _hits(spots: list[tuple[int, int]]) -> int:
    """Places covered by the spans; sorts them."""
    total, end = 0, 0
    for a, b in sorted(spots):
        if b > end:
            total += b - max(a, end)
            end = b
    return total


def _result(n_words: int, spots: list[tuple[int, int]], found: set[str]) -> tuple:
    n_hit = _hits(spots)
    listed = sorted(found)
    return n_words, n_hit, len(listed), hashlib.sha256(",".join(listed).encode()).hexdigest(), n_hit > 0 and 20 * n_hit >= n_words, listed


FIELDS = {"n_words": pa.int64(), "n_hit": pa.int64(), "n_items": pa.int64(), "items_sha256": pa.string(), "contaminated": pa.bool_(), "items": pa.list_(pa.string())}
DDL = "n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean, items array<string>"


def _judge(text: str | None, probe: dict) -> tuple:
    w = words(text)
    spots, found = [], set()
    for i in [i for i, x in enumerate(w) if x in probe]:
        for at, window, items in probe[w[i]]:
            start = i - at
            if start >= 0 and start + len(window) <= len(w) and w[start : start + len(window)] == window:
                spots.append((start, start + len(window)))
                found.update(items)
    return _result(len(w), spots, found)


def _by_broadcast(docs: DataFrame, prefixes: DataFrame, *, keep_clean: bool = False) -> DataFrame:
    """One pass over the documents: what each contains, or (keep_clean) the rows of the clean ones as they are."""
    table = defaultdict(list)
    for r in prefixes.collect():
        table[r.word.encode()].append((r["at"], r.window.encode().split(b" "), list(r["items"])))
    sent = docs.sparkSession.sparkContext.broadcast(pickle.dumps(dict(table)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        probe = pickle.loads(sent.value)
        for batch in batches:
            rows = [_judge(text, probe) for text in values(batch.column("text"))]
            if keep_clean:
                yield batch.filter(pa.array([not r[4] for r in rows], pa.bool_()))
            else:
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(v, t) for v, t in zip(list(zip(*rows, strict=True)) or [[]] * len(FIELDS), FIELDS.values(), strict=True))], ["doc_id", *FIELDS])

    if keep_clean:
        return docs.mapInArrow(lean(run), docs.schema)
    return docs.select("doc_id", "text").mapInArrow(lean(run), f"doc_id {dict(docs.dtypes)['doc_id']}, {DDL}")


#: Up to so many prefix words are broadcast, which is some 100 MB at most.
BROADCAST_PREFIXES = 1_000_000


def _by_shuffle(docs: DataFrame, prefixes: DataFrame, size: int) -> DataFrame:
    """Only places of prefix words go on: each gives the stretches that windows of its word would cover there, and those meet the windows.

    A stretch is joined with the one window of its text, so a common prefix word does not gather its windows or places.
    """
    lower = F.translate(F.coalesce(F.col("text"), F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    split = docs.select("doc_id", F.regexp_extract_all(lower, F.lit("[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"), F.lit(0)).alias("w"))
    places = split.select("doc_id", F.size("w").alias("n_words"), "w", F.posexplode("w").alias("i", "word"))
    windows = prefixes.select("window", "items", "word", "at", F.size(F.split("window", " ")).alias("len"))
    # a window has 13 words at most, so a word has few ways to lie in one
    ways = written(windows.groupBy("word").agg(F.collect_set(F.struct("at", "len")).alias("ways")), name="ways")
    few = ways.limit(BROADCAST_PREFIXES + 1).count() <= BROADCAST_PREFIXES
    near = places.join(F.broadcast(ways) if few else ways, "word").select("doc_id", "n_words", "i", "w", F.explode("ways").alias("way"))
    start, length = F.col("i") - F.col("way.at"), F.col("way.len")
    stretches = near.filter((start >= 0) & (start + length <= F.col("n_words"))).select("doc_id", start.alias("start"), length.alias("len"), F.array_join(F.slice("w", start + 1, length), " ").alias("window"))
    matched = stretches.join(windows.select("window", "items"), "window")
    spans = matched.select("doc_id", "items", F.explode(F.sequence(F.col("start"), F.col("start") + F.col("len") - 1)).alias("place"))
    hits = spans.select("doc_id", "place").distinct().groupBy("doc_id").agg(F.count("*").alias("n_hit"))
    listed = matched.select("doc_id", F.explode("items").alias("item")).groupBy("doc_id").agg(F.sort_array(F.collect_set("item")).alias("items"))
    none = F.array().cast("array<string>")
    every = split.select("doc_id", F.size("w").cast("long").alias("n_words")).join(hits, "doc_id", "left").join(listed, "doc_id", "left")
    n_hit, items = F.coalesce("n_hit", F.lit(0)), F.coalesce("items", none)
    return every.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size(items).cast("long").alias("n_items"), F.sha2(F.array_join(items, ","), 256).alias("items_sha256"), ((n_hit > 0) & (20 * n_hit >= F.col("n_words"))).alias("contaminated"), items.alias("items"))


def _is_small(items: DataFrame, size: int, broadcast_bytes: int) -> bool:
    # a window for each word at most, each with `size` words: so many times the text
    return items.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("b")).first().b * size <= broadcast_bytes


def contamination(docs: DataFrame, items: DataFrame, *, size: int = SIZE, broadcast_bytes: int = 64 << 20) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated and the items of each document."""
    small = _is_small(items, size, broadcast_bytes)
    prefixes = prefixed(docs, items, size=size, small=small)
    return _by_broadcast(docs, prefixes) if small else _by_shuffle(docs, written(prefixes, name="prefixes"), size)


def clean(docs: DataFrame, items: DataFrame, *, size: int = SIZE, broadcast_bytes: int = 64 << 20) -> DataFrame:
    """The documents that are not contaminated, with their columns; beyond the broadcast bound the ids must be unique."""
    if _is_small(items, size, broadcast_bytes):
        return _by_broadcast(docs, prefixed(docs, items, size=size), keep_clean=True)
    bad = contamination(docs, items, size=size, broadcast_bytes=broadcast_bytes).filter("contaminated").select("doc_id")
    return docs.join(bad, "doc_id", "left_anti").select(docs.columns)
