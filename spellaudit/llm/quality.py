"""Quality classifier: a weak-label model and a hashed linear scorer, for two faults: junk and toxic.

1. Labellers. Each is a rule that says faulty, sound or nothing of a document: shares of symbols, of capitals, of bars, of
   repeated neighbours and lines, of digits (junk); words and word beginnings that a labelled sample shows almost only in faulty documents
   (toxic); and the annotators' labels, where there are any. They overlap and err.
2. Weak labels. Votes are counted by pattern. Expectation-maximisation over the patterns estimates how often each
   labeller gives each vote in faulty and in sound documents, and how many documents are faulty; that gives the
   posterior of each pattern. There are at most 3 ** labellers patterns, so this runs on the driver.
3. Scorer. Features (words, their first 4 and 5 letters; for junk marks of the shares) are hashed to 2 ** BITS places. A logistic
   model is fitted to the posteriors: weights of both signs and a bias, with a penalty on their sizes that leaves most at
   zero. A document's score is the bias plus the sum of the weights of its distinct features; above 0 it is faulty, and it is
   kept if neither score is.

The model is fitted on a bounded sample (``sample`` labelled rows, or documents where none is labelled, chosen by hash
of the id; a document that has several rows counts once). Executors take the features out; hashed features and votes of the
sample come to the driver, no texts. Scoring is one pass over all documents.

Null and empty text has no words, scores the bias and what empty shares have, and is kept unless the sample says otherwise of
such texts. Whole texts are read. Repeated rows score alike. Empty tables give empty results; without labels the annotators say nothing. Other
columns are ignored (or kept, by ``keep``).
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spellaudit.llm.common import lean, values, written

LETTERS = re.compile(r"[^\W\d_]+")
SAMPLE, BITS = 6_000, 20
FAULTS = ("junk", "toxic")
#: Votes.
SOUND, FAULTY, NOTHING = 0, 1, 2
SYMBOLS = [ord(c) for c in "%&*$#@!|<>{}[]=~^_\\"]
#: Words whose features a task remembers.
REMEMBERED = 200_000


def shape(text: str) -> dict[str, float]:
    """Shares that tell junk from prose."""
    n = max(1, len(text))
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    ascii_ = np.bincount(codes[codes < 128], minlength=128)
    others = "".join(map(chr, codes[codes >= 128].tolist()))
    capitals = int(ascii_[65:91].sum()) + sum(map(str.isupper, others))
    letters = int(ascii_[65:91].sum() + ascii_[97:123].sum()) + sum(map(str.isalpha, others)) or 1
    words = text.split()
    lines = [x for x in text.split("\n") if x]
    return {
        "symbols": int(ascii_[SYMBOLS].sum()) / n,
        "capitals": capitals / letters,
        "bars": words.count("|") / max(1, len(words)),
        "neighbours": sum(map(str.__eq__, words, words[1:])) / len(words) if len(words) >= 20 else 0.0,
        "same_lines": 1 - len(set(lines)) / max(1, len(lines)) if len(lines) >= 4 else 0.0,
        "digits": (int(ascii_[48:58].sum()) + sum(map(str.isdigit, others))) / n,
    }


#: Above the second a labeller says faulty, below the first sound, between them nothing.
BOUNDS = {"symbols": (0.02, 0.04), "capitals": (0.15, 0.3), "bars": (0.02, 0.08), "neighbours": (0.05, 0.15), "same_lines": (0.3, 0.5), "digits": (0.1, 0.25)}
#: Edges between the marks of a share.
MARKS = (0.01, 0.02, 0.04, 0.08, 0.16, 0.3, 0.45, 0.6, 0.75, 0.9)


def place(name: str) -> int:
    return xxhash.xxh32_intdigest(name) & ((1 << BITS) - 1)


def word_features(word: str) -> list[int]:
    return [place(f"w{word}"), *(place(f"{n}{word[:n]}") for n in (4, 5) if len(word) > n)]


def marks(shares: dict[str, float]) -> list[int]:
    return [place(f"s{k}{i}") for k, v in shares.items() for i, m in enumerate(MARKS) if v >= m]


def words_of(text: str) -> set[str]:
    return set(LETTERS.findall(text.lower()))


def em(patterns: dict[tuple[int, ...], float], rounds: int = 50, prior: float = 0.1) -> dict[tuple[int, ...], float]:
    """The posterior of being faulty for each pattern of votes."""
    if not patterns:
        return {}
    rows = np.array(list(patterns))
    count = np.array(list(patterns.values()), float)
    votes = np.stack([rows == v for v in (SOUND, FAULTY, NOTHING)], 2).astype(float)
    # starts from the balance of votes
    q = np.clip((votes[:, :, 1].sum(1) + 0.1) / (votes[:, :, 1].sum(1) + 0.25 * votes[:, :, 0].sum(1) + 0.2), 0.02, 0.98)
    for _ in range(rounds):
        share = np.clip((count * q).sum() / count.sum(), 1e-4, 0.9)
        logs = []
        for weight, lean in ((q, (0.05, 0.2, 0.5)), (1 - q, (1.0, 0.001, 0.5))):
            # pseudo-counts keep a labeller better than chance
            given = np.einsum("r,rlv->lv", count * weight, votes) + np.array(lean) * max(1.0, prior)
            given /= given.sum(1, keepdims=True)
            logs.append(np.einsum("rlv,lv->r", votes, np.log(given)))
        d = np.clip(logs[0] - logs[1] + math.log(share / (1 - share)), -50, 50)
        q = 1 / (1 + np.exp(-d))
    return dict(zip(patterns, q.tolist(), strict=True))


class Sparse:
    """Documents' features: all of them in a row, and where each document's begin."""

    def __init__(self, lists: list[np.ndarray]):
        self.n = len(lists)
        self.sizes = np.array([len(x) for x in lists], np.int64)
        self.at = np.concatenate([np.zeros(0, np.int32), *lists]).astype(np.int32, copy=False)
        self.of = np.repeat(np.arange(self.n, dtype=np.int32), self.sizes)

    def sums(self, weights: np.ndarray) -> np.ndarray:
        """Of each document, the weights of its features."""
        return np.bincount(self.of, weights[self.at], minlength=self.n)

    def counts(self, by: np.ndarray, size: int = 1 << BITS) -> np.ndarray:
        """Of each feature, the sum over the documents that have it."""
        return np.bincount(self.at, by[self.of], minlength=size)


def logistic(found: Sparse, q: np.ndarray, *, rounds: int = 80, rate: float = 0.3, penalty: float = 4.0, least: int = 4) -> tuple[dict[int, float], float]:
    """Weights (by feature, those that are not zero) and bias of a logistic model of the posteriors q; features of fewer than ``least`` documents get none.

    Steps by each weight's own past gradients; after each step a weight goes towards zero by the penalty, so that only
    features that tell are left. The rarer side counts more. As the penalty draws scores together, the bias is set last,
    to where the sample is told best.
    """
    share = float(np.clip(q.mean(), 0.001, 0.999)) if len(q) else 0.5
    side = np.where(q > 0.5, min(4.0, max(1.0, (1 - share) / share)), 1.0)
    # the features that are frequent enough, numbered anew
    often = np.bincount(found.at, minlength=1 << BITS) >= least
    names, new = np.flatnonzero(often), np.cumsum(often) - 1
    used = often[found.at]
    at, of = new[found.at[used]], found.of[used]
    n = len(names)
    weights, bias = np.zeros(n), math.log(share / (1 - share))
    past, past_bias = np.full(n, 1e-6), 1e-6
    sums = np.zeros(found.n)
    for _ in range(rounds if n else 0):
        error = side * (1 / (1 + np.exp(-np.clip(bias + sums, -30, 30))) - q)
        slope = np.bincount(at, error[of], minlength=n)
        past += slope**2
        step = rate / np.sqrt(past)
        weights = weights - step * slope
        weights = np.sign(weights) * np.maximum(np.abs(weights) - step * penalty, 0.0)
        past_bias += error.sum() ** 2
        bias -= rate / math.sqrt(past_bias) * error.sum()
        sums = np.bincount(of, weights[at], minlength=found.n)
    used = np.flatnonzero(weights)
    return dict(zip(names[used].tolist(), weights[used].tolist(), strict=True)), best_bias(sums, q, bias)


def best_bias(sums: np.ndarray, q: np.ndarray, bias: float) -> float:
    """The bias under which the signs agree with most posterior weight: of equally good ones the middle of the widest gap; as it was if one side has none.

    No bias parts equal sums, as copies with unlike posteriors have, so only cuts between unlike ones count.
    """
    if not len(q) or not (q > 0.5).any() or (q > 0.5).all():
        return bias
    order = np.argsort(sums, kind="stable")
    s, y = sums[order], q[order]
    # right if all before the cut are called sound and all from it on faulty
    right = np.concatenate([[0.0], np.cumsum(1 - y)]) + np.concatenate([np.cumsum(y[::-1])[::-1], [0.0]])
    gap = np.diff(np.concatenate([[s[0] - 1], s, [s[-1] + 1]]))
    cut = max(np.flatnonzero((right >= right[gap > 0].max() - 1e-9) & (gap > 0)), key=lambda i: (gap[i], -i))
    low = s[cut - 1] if cut else s[0] - 1
    return -float(low + gap[cut] / 2)


class Model:
    """Weights and bias of each fault; a weight that is zero is left out."""

    def __init__(self, by_fault: dict[str, tuple[dict[int, float], float]]):
        self.by_fault = by_fault
        self.known: dict[str, tuple[int, ...]] = {}

    def scores(self, text: str | None) -> list[float]:
        text = text or ""
        (shapes, junk), (table, toxic) = (self.by_fault[f] for f in FAULTS)
        found: set[int] = set()
        for w in words_of(text):
            got = self.known.get(w)
            if got is None:
                got = tuple(x for x in word_features(w) if x in table)
                if len(self.known) < REMEMBERED:
                    self.known[w] = got
            if got:
                found.update(got)
        # in order, so that equal texts have equal scores to the last bit
        return [junk + math.fsum(shapes.get(x, 0.0) for x in set(marks(shape(text)))), toxic + math.fsum(table[x] for x in found)]


def lexicon(found: Sparse, label: np.ndarray, support: float = 0.04, purity: float = 0.95) -> np.ndarray:
    """Whether labelled faulty documents (1; 0: sound, -1: no label) have a feature almost alone, for each feature."""
    bad, good = found.counts((label == 1).astype(float)), found.counts((label == 0).astype(float))
    return (bad >= max(3, support * (label == 1).sum())) & (bad >= purity * (bad + good))


def fit_rows(rows: list[tuple[np.ndarray, np.ndarray, list[int], int | None, int | None]]) -> Model:
    """From (word features, marks, votes of the shares, quality, toxic) of the sample; labels may be null."""
    words, shapes = (Sparse([r[i] for r in rows]) for i in (0, 1))
    toxic = np.array([-1 if r[4] is None else int(r[4]) for r in rows])
    # each half of the sample is judged by the words of the other: a rule must hold where it was not found
    half = np.arange(len(rows)) % 2
    listed = [lexicon(words, np.where(half == h, toxic, -1)) for h in (0, 1)]
    hits = np.where(half == 1, *(words.sums(x.astype(float)) for x in listed))
    junk_votes = [(*r[2], NOTHING if r[3] is None else int(not r[3])) for r in rows]
    toxic_votes = [(FAULTY if n >= 1 else SOUND, FAULTY if n >= 2 else NOTHING, FAULTY if n >= 3 else NOTHING, NOTHING if t < 0 else int(t)) for n, t in zip(hits.tolist(), toxic.tolist(), strict=True)]
    out = {}
    for fault, votes, found in (("junk", junk_votes, shapes), ("toxic", toxic_votes, words)):
        posterior = em(dict(Counter(votes)))
        table, bias = logistic(found, np.array([posterior[v] for v in votes]))
        out[fault] = table, bias if rows else -1.0
    return Model(out)


def fit(docs: DataFrame, labels: DataFrame, *, sample: int = SAMPLE) -> Model:
    """Fits on ``sample`` rows at most; features are taken out where the texts are."""
    chosen = written(labels.filter("doc_id is not null").groupBy("doc_id").agg(F.max("quality").alias("quality"), F.max("toxic").alias("toxic")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample), name="sample")
    texts = docs.select("doc_id", "text")
    none = F.lit(None).cast("int")
    if chosen.isEmpty():
        chosen = written(texts.select("doc_id").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample).select("doc_id", none.alias("quality"), none.alias("toxic")), name="sample")
    rows = texts.join(F.broadcast(chosen.select("doc_id", F.col("quality").cast("int"), F.col("toxic").cast("int"))), "doc_id").select("text", "quality", "toxic", F.xxhash64("doc_id").alias("rank"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found, shapes, votes = [], [], []
            for text in values(batch.column(0)):
                shares = shape(text or "")
                found.append(np.array(sorted({x for w in words_of(text or "") for x in word_features(w)}), np.int32))
                shapes.append(sorted(set(marks(shares))))
                votes.append([FAULTY if shares[k] > high else SOUND if shares[k] < low else NOTHING for k, (low, high) in BOUNDS.items()])
            lists = pa.list_(pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array(found, lists), pa.array(shapes, lists), pa.array(votes, lists), *(batch.column(i) for i in (1, 2, 3))], ["words", "marks", "votes", "quality", "toxic", "rank"])

    taken = rows.mapInArrow(lean(run), "words array<int>, marks array<int>, votes array<int>, quality int, toxic int, rank long")
    # repeated rows of an id: one of them, the least, counts
    got = taken.withColumn("at", F.row_number().over(Window.partitionBy("rank").orderBy("words", "marks"))).filter("at = 1").drop("at").orderBy("rank").toArrow()
    columns = [got.column(c) for c in ("words", "marks", "votes", "quality", "toxic")]
    arrays = [[x.values.to_numpy() if x.is_valid else np.zeros(0, np.int32) for x in columns[i]] for i in (0, 1)]
    model = fit_rows(list(zip(*arrays, *(c.to_pylist() for c in columns[2:]), strict=True)))
    del got, columns, arrays
    pa.default_memory_pool().release_unused()
    return model


def scored(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, junk_score, toxic_score and kept of each document."""
    sent = docs.sparkSession.sparkContext.broadcast(model.by_fault)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Model(sent.value)
        for batch in batches:
            s = np.array([own.scores(t) for t in values(batch.column(1))]).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(s[:, 0]), pa.array(s[:, 1]), pa.array((s <= 0).all(1))], ["doc_id", "junk_score", "toxic_score", "kept"])

    return docs.select("doc_id", "text").mapInArrow(lean(run), f"doc_id {dict(docs.dtypes)['doc_id']}, junk_score double, toxic_score double, kept boolean")


def keep(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of the documents that are kept, as they are."""
    sent = docs.sparkSession.sparkContext.broadcast(model.by_fault)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Model(sent.value)
        for batch in batches:
            yield batch.filter(pa.array([max(own.scores(t)) <= 0 for t in values(batch.column("text"))], pa.bool_()))

    return docs.mapInArrow(lean(run), docs.schema)
