"""Near duplicates by a chosen-path set similarity join, and their components.

A document's set holds the hashes of its distinct five-word shingles (of fewer words: the whole sequence as one).
Documents of equal sets are stored once. In each of ``trees`` independent trees a document goes, level by level, to the
branch of its minwise token under that level's hash, so documents of similarity s stay together with probability s a
level. A node of one document ends. In a node of up to ``small`` documents all are compared. Larger nodes branch on, down
to ``depth``. Two documents of similarity s that stay in small nodes meet with probability 1 - (1 - s**depth)**trees at least: 0.9999 at 0.85
with the defaults. Nodes that are large there branch on ``AGAIN`` times by hashes that all trees share, so a pair that meets in such nodes alone
meets once more with 1 - (1 - s**DEEPER)**AGAIN at least, 0.98 at 0.85 and 0.94 at 0.8; what is large even then is compared whole.

Pairs that cannot be similar are left out within the joins: a document also carries, for each of 1,024 buckets, whether
it has an odd number of hashes there. Each bucket in which two documents differ takes a hash that one of them alone has,
so too many such buckets exclude the pair; none that reaches the similarity is lost.

Links are confirmed on full sets in two rounds, since what a round has connected needs no further comparing:
first each member of a node with the node's first document, then the pairs of a node whose ends are still apart.
Components come from repeated joins of the links to the least label (with jumps), so no group is gathered anywhere.

Null or wordless text has an empty set and is linked with nothing. Texts are taken whole. Repeated rows count as the
copies they are. Empty tables give empty results; other columns are ignored (or kept, by ``drop_near_duplicates``).
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spellaudit.llm.common import lean, skewed_join, values, written

WORD = re.compile(rb"[^\x20\x09-\x0D]+")
SHINGLE, TREES, DEPTH, SMALL = 5, 16, 5, 24
#: Longs of the parity sketch, 64 buckets each.
PARITY = 16
#: Times that a node that is large at the last level is branched on, and by how many levels.
AGAIN, DEEPER = 4, 3
#: Pairs for which a document's text is sent once.
PAIRS = 500


def shingles(text: str | None, size: int = SHINGLE) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the shingles."""
    # bytes.lower() changes A-Z alone
    words = WORD.findall((text or "").encode("utf-8", "surrogatepass").lower())
    if not words:
        return np.empty(0, np.uint64)
    runs = [b" ".join(words[i : i + size]) for i in range(max(1, len(words) - size + 1))]
    return np.unique(np.fromiter(map(xxhash.xxh3_64_intdigest, runs), np.uint64, len(runs)))


def _seeds(n: int) -> np.ndarray:
    return np.array([xxhash.xxh3_64_intdigest(b"%d" % i) | 1 for i in range(n)], np.uint64)


def minwise(tokens: np.ndarray, seeds: np.ndarray) -> np.ndarray:
    """The least hash of the tokens under each seed."""
    out = np.full(len(seeds), np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(tokens), 4096):
        h = (tokens[at : at + 4096, None] ^ (seeds >> np.uint64(7))) * seeds
        out = np.minimum(out, (h ^ (h >> np.uint64(32))).min(0))
    return out


def signatures(docs: DataFrame, *, trees: int = TREES, depth: int = DEPTH, first: int = 0) -> DataFrame:
    """doc_id, n_shingles, whole (hash of the set), nodes (trees x depth names) and odd (the parity sketch); first: the first hash to use."""
    kind = dict(docs.dtypes)["doc_id"]
    seeds = _seeds(first + trees * depth)[first:]
    mixer = np.uint64(0x9E3779B97F4A7C15)

    def paths(tokens: np.ndarray) -> np.ndarray:
        least = minwise(tokens, seeds).reshape(trees, depth)
        node, out = np.arange(1, trees + 1, dtype=np.uint64), []
        for level in range(depth):
            node = (node * mixer) ^ (node >> np.uint64(31)) ^ least[:, level]
            out.append(node)
        return np.stack(out, 1).view(np.int64).ravel()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, whole, nodes, odd = [], [], [], []
            for text in values(batch.column(1)):
                s = shingles(text)
                n.append(len(s))
                whole.append(xxhash.xxh3_128_digest(s.tobytes()))
                nodes.append(paths(s) if len(s) else None)
                count = np.bincount((s >> np.uint64(20)).astype(np.int64) & (64 * PARITY - 1), minlength=64 * PARITY)
                odd.append(np.packbits(count & 1).view(np.int64))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(whole, pa.binary()), pa.array(nodes, pa.list_(pa.int64())), pa.array(odd, pa.list_(pa.int64()))], ["doc_id", "n_shingles", "whole", "nodes", "odd"])

    return docs.select("doc_id", "text").mapInArrow(lean(run), f"doc_id {kind}, n_shingles long, whole binary, nodes array<long>, odd array<long>")


def _branched(live: DataFrame, levels: int, small: int) -> tuple[DataFrame, DataFrame]:
    """From (a, path, node): the members (node, a, size) of the small nodes, and of those that are large where the path ends."""
    ended = None
    for level in range(levels):
        sizes = written(live.groupBy("node").agg(F.count("*").alias("size")).filter("size > 1"), name="sizes")
        # the members of a large node stay spread
        live = written(skewed_join(live, sizes, "node", "size"), name="nodes")
        few = live.filter(F.col("size") <= small).select("node", "a", "size")
        ended = few if ended is None else ended.unionByName(few)
        large = live.filter(F.col("size") > small)
        if level < levels - 1:
            live = large.drop("size", "node").withColumn("node", F.col("path")[level + 1])
    return ended, large.select("node", "a", "size")


def candidate_nodes(sets: DataFrame, docs: DataFrame, *, trees: int = TREES, depth: int = DEPTH, small: int = SMALL) -> DataFrame:
    """node, a, size: the members of the nodes where branching ends, of two documents at least.

    Nodes that are large at the last level branch on by fresh hashes, ``AGAIN`` times independently. What is large after
    that holds sets that are nearly equal.
    """
    at = sets.select(F.col("doc_id").alias("a"), "nodes", F.explode(F.sequence(F.lit(0), F.lit(trees - 1))).alias("tree"))
    live = at.select("a", F.slice("nodes", F.col("tree") * depth + 1, depth).alias("path")).withColumn("node", F.col("path")[0])
    ended, large = _branched(live, depth, small)
    if large.isEmpty():
        return ended
    fresh = signatures(docs.join(large.select(F.col("a").alias("doc_id")).distinct(), "doc_id", "left_semi"), trees=AGAIN, depth=DEEPER, first=trees * depth)
    fresh = written(fresh.groupBy(F.col("doc_id").alias("a")).agg(F.any_value("nodes").alias("nodes")), name="fresh")
    again = large.select("a", F.col("node").alias("above")).join(fresh, "a").select("a", "above", "nodes", F.explode(F.sequence(F.lit(0), F.lit(AGAIN - 1))).alias("tree"))
    live = again.select("a", F.transform(F.slice("nodes", F.col("tree") * DEEPER + 1, DEEPER), lambda x: F.xxhash64("above", x)).alias("path")).withColumn("node", F.col("path")[0])
    more, last = _branched(live, DEEPER, small)
    return ended.unionByName(more).unionByName(last)


def possible(a: str, b: str, percent: int) -> Column:
    """Whether the structs a and b (n, odd) may be of sets that reach the similarity; their difference is d at least."""
    d = sum((F.bit_count(F.col(f"{a}.odd")[i].bitwiseXOR(F.col(f"{b}.odd")[i])) for i in range(PARITY)), F.lit(0))
    return d * (100 + percent) <= (100 - percent) * (F.col(f"{a}.n") + F.col(f"{b}.n"))


def _with_texts(pairs: DataFrame, docs: DataFrame, hubs: str) -> DataFrame:
    """The pairs (a, b) with both texts. A document of many pairs on a side of ``hubs`` is sent once for each ``PAIRS`` of them, so they stay spread."""
    texts, sent = docs.select("doc_id", "text"), {}
    for side in "ab":
        if side not in hubs:
            pairs = pairs.withColumn(f"salt_{side}", F.lit(0))
            sent[side] = texts.toDF(side, f"t{side}").withColumn(f"salt_{side}", F.lit(0))
            continue
        other = "b" if side == "a" else "a"
        counts = written(pairs.groupBy(side).agg(F.count("*").alias("n")), name="counts")
        copies = F.ceil(F.col("n") / PAIRS).cast("int")
        pairs = written(skewed_join(pairs, counts, side, "n").withColumn(f"salt_{side}", F.pmod(F.xxhash64(other), copies).cast("int")).drop("n"), name="dealt")
        sent[side] = texts.toDF(side, f"t{side}").join(counts, side).select(side, f"t{side}", F.explode(F.sequence(F.lit(0), copies - 1)).alias(f"salt_{side}"))
    return pairs.join(sent["a"], ["a", "salt_a"]).join(sent["b"], ["b", "salt_b"])


def confirmed(pairs: DataFrame, docs: DataFrame, *, percent: int, hubs: str = "ab") -> DataFrame:
    """The pairs (a, b) whose full sets reach the similarity; ``hubs``: the sides where a document may have very many."""
    kind = dict(pairs.dtypes)["a"]
    both = _with_texts(pairs.select("a", "b"), docs, hubs).select("a", "b", "ta", "tb")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = last = None
        for batch in batches:
            keep = []
            for ta, tb in values(batch.column(2), batch.column(3)):
                if tb != key:
                    key, last = tb, shingles(tb)
                s = shingles(ta)
                same = len(np.intersect1d(s, last, assume_unique=True))
                keep.append(100 * same >= percent * (len(s) + len(last) - same) and same > 0)
            yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    return both.mapInArrow(lean(run), f"a {kind}, b {kind}")


def components(links: DataFrame) -> DataFrame:
    """doc and label, the least document reachable by links (a, b), for all documents in links."""
    both = links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    edges = written(both, name="links")
    labels = written(edges.groupBy(F.col("a").alias("doc")).agg(F.least(F.min("a"), F.min("b")).alias("label")), name="labels")
    while True:
        near = edges.join(labels.withColumnRenamed("doc", "b"), "b").groupBy(F.col("a").alias("doc")).agg(F.min("label").alias("near"))
        step = labels.join(near, "doc").select("doc", F.least("label", "near").alias("low"), F.col("label").alias("was"))
        jump = labels.select(F.col("doc").alias("low"), F.col("label").alias("far"))
        new = written(step.join(jump, "low", "left").select("doc", F.least("low", "far").alias("label"), "was"), name="labels")
        if new.filter("label != was").isEmpty():
            return labels
        labels = new.drop("was")


def near_duplicates(docs: DataFrame, *, percent: int = 85, trees: int = TREES, depth: int = DEPTH, small: int = SMALL) -> DataFrame:
    """doc_id, n_shingles, component_id (the least doc_id reachable) and kept, for each row."""
    marks = written(signatures(docs, trees=trees, depth=depth), name="signatures")
    filled = marks.filter("n_shingles > 0")
    # ties of equal sets go to the least id, which stands for all
    leads = filled.groupBy("whole").agg(F.min("doc_id").alias("lead"), F.count("*").alias("copies"))
    sets = filled.join(leads, (filled.whole == leads.whole) & (filled.doc_id == leads.lead), "left_semi").select("doc_id", "nodes", F.struct(F.col("n_shingles").alias("n"), "odd").alias("set"))
    found = candidate_nodes(sets, docs, trees=trees, depth=depth, small=small)
    nodes = written(found.join(sets.select(F.col("doc_id").alias("a"), F.col("set").alias("sa")), "a"), name="members")
    firsts = nodes.groupBy("node").agg(F.min(F.struct("a", "sa")).alias("first"), F.count("*").alias("members")).select("node", F.col("first.a").alias("b"), F.col("first.sa").alias("sb"), "members")
    star = skewed_join(nodes, written(firsts, name="firsts"), "node", "members").filter(F.col("a") != F.col("b")).filter(possible("sa", "sb", percent)).select("a", "b").distinct()
    star = written(star, name="pairs")
    # a member has a pair a tree at most, a first document as many as its nodes have members
    links = written(confirmed(star, docs, percent=percent, hubs="b"), name="confirmed")
    near = components(links)
    apart = nodes.join(near.select(F.col("doc").alias("a"), "label"), "a", "left").withColumn("label", F.coalesce("label", "a"))
    # members joined to the node's first document need comparing only with those that are not
    apart = written(apart, name="labelled")
    lead = written(apart.groupBy("node").agg(F.min(F.struct("a", "label")).label.alias("first"), F.min("label").alias("low"), F.max("label").alias("high"), F.count("*").alias("members")).filter("low != high").select("node", "first", "members"), name="leads")
    open_ = written(skewed_join(apart, lead, "node", "members"), name="apart")
    rest = open_.filter("label != first").select("node", F.col("a").alias("b"), F.col("label").alias("other"), F.col("sa").alias("sb"))
    starred = star.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    pairs = open_.join(rest, "node").filter((F.col("label") != F.col("other")) & possible("sa", "sb", percent)).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct().join(starred, ["a", "b"], "left_anti")
    more = written(confirmed(written(pairs, name="pairs"), docs, percent=percent), name="confirmed")
    final = near if more.isEmpty() else components(links.unionByName(more))
    named = written(leads.join(final, leads.lead == final.doc, "left").select("whole", F.coalesce("label", "lead").alias("component"), "copies"), name="named")
    # a set that very many documents have stays spread
    own = skewed_join(filled.select("doc_id", "n_shingles", "whole"), named, "whole", "copies").select("doc_id", "n_shingles", "component")
    every = own.unionByName(marks.filter("n_shingles = 0").select("doc_id", "n_shingles", F.col("doc_id").alias("component")))
    return every.select("doc_id", "n_shingles", F.col("component").alias("component_id"), (F.col("doc_id") == F.col("component")).alias("kept"))


def drop_near_duplicates(docs: DataFrame, *, percent: int = 80, **options: int) -> DataFrame:
    """One document, that of the least id, of each component, with its columns."""
    gone = near_duplicates(docs, percent=percent, **options).filter("not kept").select("doc_id")
    return docs.join(gone, "doc_id", "left_anti").select(docs.columns)
