"""Language-model scoring by Brown classes: a class-based bigram over all words of the training documents.

1. Counts of all words (and of the end, a token of each text) over all training documents: c, N and V.
2. Units. The ``heads`` most frequent words are units of their own; any other word, known or not, belongs to one of
   ``tails`` units by the hash of its last three characters, which say much of its language and part of speech. Where they are
   not given, heads and tails grow as the square root of V, and classes as its fourth root. Bigrams of units are counted over all
   training documents, as a table of Spark's.
3. Exchange clustering of units. Units start in ``classes`` by rank. In each round every unit moves to the class that gives the
   bigram likelihood its largest value with the other units in place; the counts of a unit with each class come from a
   join of the bigram table with the classes, and the round with the best likelihood is kept.
4. Exchange of all words. Each known word, frequent or not, has two classes of its own: the one in which it is foretold, chosen by the classes of
   all words before it, and the one by which it foretells, chosen by the classes of all words after it. It moves from its unit's class to
   those that make its own neighbours likeliest, given the units' classes. Its counts with the classes are a row a word, shuffled by word.
   Where heads or tails are given, words keep the class of their unit. The pairs of classes are then counted again over all training documents.
5. Scores. Base: p(w) = (c + 0.5) / (N + 0.5 (V + 1)). A word that is not known has the base probability u of one
   unseen token, and foretells by its unit's class. A known word, foretold in class l, after one that foretells by class k has
   (1 - u) * ((n(k, l) + m q(l)) / (n(k) + m)) * p(w) / P(l),
   where P(l) is the sum of p over the known words of l and q(l) = P(l) / (1 - u). Over all words these add up to 1. ``score`` is
   the sum of log10 over the tokens, the end included.

Counts and classes of the ``COMMON`` most frequent words are broadcast; tokens of all others meet theirs by joins, one row a token,
and one more where two of them are neighbours.

A-Z are lower-cased; words are runs without blanks (space, 0x09-0x0D). Null or empty text has the end alone. Held out are
ids whose crc32 (as text) leaves 1 by 5. Empty tables give empty results; rows must have distinct ids. Other columns are ignored.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from spellaudit.llm.common import values, written

#: Stands for the end; no word holds a blank.
END = " "
#: The least numbers of heads, tails and classes.
HEADS, TAILS, CLASSES, ROUNDS = 1024, 1023, 16, 5
#: Pairs of units that a task merges at once, and those that it holds before it sends them on.
MERGED, HELD = 2_000_000, 4_000_000
#: Words, or rows, that a task holds before it sends them on.
WORDS, ROWS = 150_000, 30_000
#: Words whose counts and classes are broadcast, and tokens that are looked up at once.
COMMON, TOGETHER = 300_000, 200_000


def tokens(text: str | None) -> list[str]:
    # bytes know no other letters and blanks than ASCII's
    words = b" ".join((text or "").encode("utf-8", "surrogatepass").lower().split()).decode("utf-8", "surrogatepass")
    return [*words.split(" "), END] if words else [END]


def _together(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list[str], np.ndarray]]:
    """Some rows of a batch, the tokens of their texts in a row, and how many each text has."""
    for batch in batches:
        begin, words, sizes = 0, [], []
        for text in values(batch.column("text")):
            found = tokens(text)
            words += found
            sizes.append(len(found))
            if len(words) > TOGETHER:
                yield batch.slice(begin, len(sizes)), words, np.array(sizes)
                begin, words, sizes = begin + len(sizes), [], []
        if sizes:
            yield batch.slice(begin), words, np.array(sizes)


def held_out(doc_id: Column | str = "doc_id") -> Column:
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 1


class Units(dict):
    """Numbers of words' units: heads by rank, then tails, then the end. Up to ``most`` words that were asked for are remembered."""

    def __init__(self, heads: list[str], tails: int, most: int = WORDS):
        super().__init__((w, i) for i, w in enumerate(heads))
        self.heads, self.tails, self.most = len(heads), tails, most
        self.end = self[END] = len(heads) + tails
        self.n = self.end + 1

    def __missing__(self, word: str) -> int:
        number = self.heads + zlib.crc32(word[-3:].encode("utf-8", "surrogatepass")) % self.tails
        if len(self) < self.most:
            self[word] = number
        return number

    def numbers(self, words: list[str]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.int64, len(words))


def count_words(docs: DataFrame) -> DataFrame:
    """word and c over the texts, the end included."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(total: Counter) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(total), pa.string()), pa.array(list(total.values()), pa.int64())], ["word", "c"])

        total: Counter = Counter()
        for _, words, _ in _together(batches):
            total.update(words)
            if len(total) > WORDS:
                yield out(total)
                total = Counter()
        yield out(total)

    return docs.select("text").mapInArrow(run, "word string, c long").groupBy("word").agg(F.sum("c").alias("c"))


def unit_bigrams(docs: DataFrame, heads: list[str], tails: int) -> DataFrame:
    """a, b, n: pairs of units in sequence; a text starts after an end."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        units = Units(heads, tails)
        held, times, waiting, n_waiting = np.empty(0, np.int64), np.empty(0, np.int64), [], 0

        def merged() -> tuple[np.ndarray, np.ndarray]:
            found, new = np.unique(np.concatenate(waiting or [held[:0]]), return_counts=True)
            names, at = np.unique(np.concatenate([held, found]), return_inverse=True)
            return names, np.bincount(at, np.concatenate([times, new]), minlength=len(names)).astype(np.int64)

        def out() -> Iterator[pa.RecordBatch]:
            for at in range(0, len(held), 200_000):
                part = held[at : at + 200_000]
                yield pa.RecordBatch.from_arrays([pa.array(part // units.n, pa.int32()), pa.array(part % units.n, pa.int32()), pa.array(times[at : at + 200_000])], ["a", "b", "n"])

        for _, words, _ in _together(batches):
            # texts end with an end, so the next one starts after it
            u = units.numbers(words)
            waiting.append(np.append(units.end, u[:-1]) * units.n + u)
            n_waiting += len(u)
            if n_waiting > MERGED:
                (held, times), waiting, n_waiting = merged(), [], 0
                if len(held) > HELD:
                    yield from out()
                    held, times = held[:0], times[:0]
        held, times = merged()
        yield from out()

    return docs.select("text").mapInArrow(run, "a int, b int, n long").groupBy("a", "b").agg(F.sum("n").alias("n"))


def exchange(bigrams: DataFrame, n_units: int, classes: int = CLASSES, rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray]:
    """The class of each unit and the counts of class pairs. Only unit x class tables come to the driver; the end keeps a class of its own."""
    spark = bigrams.sparkSession
    cls = np.arange(n_units) % classes
    cls[-1] = classes
    k = classes + 1
    best = None

    def xlogx(x: np.ndarray) -> np.ndarray:
        return np.where(x > 0, x * np.log(np.maximum(x, 1)), 0.0)

    for turn in range(rounds + 1):
        named = F.broadcast(spark.createDataFrame([(i, int(c)) for i, c in enumerate(cls)], "unit int, cls int"))
        right = bigrams.join(named.toDF("b", "cls"), "b").groupBy(F.col("a").alias("unit"), "cls").agg(F.sum("n").alias("n")).toPandas()
        left = bigrams.join(named.toDF("a", "cls"), "a").groupBy(F.col("b").alias("unit"), "cls").agg(F.sum("n").alias("n")).toPandas()
        follows, before = np.zeros((n_units, k)), np.zeros((n_units, k))
        follows[right.unit, right.cls] = right.n
        before[left.unit, left.cls] = left.n
        pairs = np.zeros((k, k))
        np.add.at(pairs, cls, follows)
        likelihood = xlogx(pairs).sum() - xlogx(pairs.sum(1)).sum() - xlogx(pairs.sum(0)).sum()
        if best is None or likelihood > best[0]:
            best = likelihood, cls.copy(), pairs
        elif turn > 1:
            break
        if turn == rounds:
            break
        # each unit scores the classes by its neighbours, given the pair counts without it
        free = np.arange(n_units - 1)
        moved, table = cls.copy(), pairs.copy()
        for u in free[np.argsort(-follows[:-1].sum(1), kind="stable")]:
            f, b, c = follows[u], before[u], moved[u]
            if not f.any() and not b.any():
                continue
            table[c] -= f
            table[:, c] -= b
            table = np.maximum(table, 0)
            row, col = table.sum(1)[:classes], table.sum(0)[:classes]
            gain = (xlogx(table[:classes] + f) - xlogx(table[:classes])).sum(1) + (xlogx(table[:, :classes] + b[:, None]) - xlogx(table[:, :classes])).sum(0)
            gain -= xlogx(row + f.sum()) - xlogx(row) + xlogx(col + b.sum()) - xlogx(col)
            c = int(gain.argmax())
            moved[u] = c
            table[c] += f
            table[:, c] += b
        cls = moved
    return best[1], best[2]


def sizes(words: int) -> tuple[int, int, int]:
    """Heads, tails and classes for so many distinct words."""
    return max(HEADS, math.isqrt(words)), max(TAILS, math.isqrt(words)), max(CLASSES, math.isqrt(math.isqrt(words)))


class Numbers(dict):
    """Numbers of words in the order of their first use, and the class of each one's unit."""

    def __init__(self, units: Units, cls: np.ndarray):
        self.units, self.cls, self.of = units, cls, np.zeros(1024, np.int64)

    def __missing__(self, word: str) -> int:
        number = self[word] = len(self)
        if number == len(self.of):
            self.of = np.concatenate([self.of, np.zeros_like(self.of)])
        self.of[number] = self.cls[self.units[word]]
        return number


def neighbours(docs: DataFrame, heads: list[str], tails: int, cls: np.ndarray) -> DataFrame:
    """word, keys and n: how often a word (the end is none) follows each class (its number) and how often each class follows it (its number and that of all classes); a row a task."""
    k = int(cls.max()) + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        units = Units(heads, tails)
        numbers = Numbers(units, cls)
        held, times, waiting, n_waiting = np.empty(0, np.int64), np.empty(0, np.int64), [], 0

        def merged() -> tuple[np.ndarray, np.ndarray]:
            found, new = np.unique(np.concatenate(waiting or [held[:0]]), return_counts=True)
            names, at = np.unique(np.concatenate([held, found]), return_inverse=True)
            return names, np.bincount(at, np.concatenate([times, new]), minlength=len(names)).astype(np.int64)

        def out() -> Iterator[pa.RecordBatch]:
            names, begin = np.array(list(numbers), object), np.flatnonzero(np.diff(held // (2 * k), prepend=-1))
            for at in range(0, len(begin), ROWS):
                part = np.append(begin[at : at + ROWS], begin[at + ROWS] if at + ROWS < len(begin) else len(held))
                some, offsets = slice(part[0], part[-1]), pa.array(part - part[0], pa.int32())
                lists = [pa.ListArray.from_arrays(offsets, pa.array(x[some], pa.int32())) for x in (held % (2 * k), times)]
                yield pa.RecordBatch.from_arrays([pa.array(names[held[part[:-1]] // (2 * k)], pa.string()), *lists], ["word", "keys", "n"])

        for _, words, _ in _together(batches):
            at = np.fromiter(map(numbers.__getitem__, words), np.int64, len(words))
            own = numbers.of[at]
            real = own != k - 1
            waiting += [(at * (2 * k) + np.append(k - 1, own[:-1]))[real], (at * (2 * k) + k + np.append(own[1:], k - 1))[real]]
            n_waiting += 2 * len(at)
            if n_waiting > 2 * MERGED or len(numbers) > 2 * WORDS:
                (held, times), waiting, n_waiting = merged(), [], 0
                if len(numbers) > 2 * WORDS:
                    yield from out()
                    numbers, held, times = Numbers(units, cls), held[:0], times[:0]
        held, times = merged()
        yield from out()

    return docs.select("text").mapInArrow(run, "word string, keys array<int>, n array<int>")


def own_classes(counted: DataFrame, pairs: np.ndarray) -> DataFrame:
    """word, c, first (the class by which a word foretells) and second (in which it is foretold) from ``neighbours``: those that make the words beside it likeliest."""
    k = len(pairs)
    with np.errstate(divide="ignore"):
        # classes without words, and the end's, are no choice
        logs = np.log(np.maximum(pairs, 1e-9))
        foretold, foretells = (np.where(whole > 0, x - np.log(whole), -1e9)[:, :-1] for x, whole in ((logs, pairs.sum(0)), (logs.T, pairs.sum(1))))

    def chosen(some: pa.Table) -> pa.RecordBatch:
        words = some.column("word").combine_chunks()
        names, number = words.dictionary_encode().dictionary, words.dictionary_encode().indices.to_numpy()
        keys, n = (some.column(c).combine_chunks() for c in ("keys", "n"))
        each = np.repeat(number.astype(np.int64), keys.value_lengths().to_numpy()) * (2 * k) + keys.flatten().to_numpy()
        each, at = np.unique(each, return_inverse=True)
        times = np.bincount(at, n.flatten().to_numpy())
        out = []
        for side, table in ((0, foretold), (1, foretells)):
            here = each // k % 2 == side
            begin = np.flatnonzero(np.diff(each[here] // (2 * k), prepend=-1))
            out.append(np.add.reduceat(table[each[here] % k] * times[here][:, None], begin).argmax(1) if len(begin) else np.zeros(0, np.int64))
            if not side:
                c = np.add.reduceat(times[here], begin) if len(begin) else np.zeros(0)
        return pa.RecordBatch.from_arrays([names, pa.array(c.astype(np.int64)), pa.array(out[1], pa.int32()), pa.array(out[0], pa.int32())], ["word", "c", "first", "second"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting, rows = [], 0
        for batch in batches:
            waiting.append(batch)
            rows += len(batch)
            if rows > ROWS // 3:
                some = pa.Table.from_batches(waiting)
                # the last word may go on in the next batch
                last = some.column("word")[-1]
                own = pc.sum(pc.equal(some.column("word"), last)).as_py()
                if own < rows:
                    yield chosen(some.slice(0, rows - own))
                waiting, rows = some.slice(rows - own).to_batches(), own
        if rows:
            yield chosen(pa.Table.from_batches(waiting))

    return counted.repartition("word").sortWithinPartitions("word").mapInArrow(run, "word string, c long, first int, second int")


class Words:
    """The most frequent words: their numbers (others: -1), counts and classes; the end is the last."""

    def __init__(self, names: list[str], c: np.ndarray, first: np.ndarray, second: np.ndarray):
        self.at = {w: i for i, w in enumerate([*names, END])}
        self.end, self.c, self.first, self.second = len(names), c, first, second

    def numbers(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Of each token and of the one before it."""
        own = np.fromiter(map(self.at.get, words, repeat(-1)), np.int64, len(words))
        return own, np.append(self.end, own[:-1])


def least_common(table: DataFrame) -> int:
    """The least count of the words that are looked up where they are read: ``COMMON`` words at most have it or more."""
    words = 0
    # there are no more different counts than twice the square root of all tokens
    for r in table.groupBy("c").count().orderBy(F.desc("c")).collect():
        words += r["count"]
        if words > COMMON:
            return r.c + 1
    return 0


def rare_rows(docs: DataFrame, sent: Broadcast, k: int) -> DataFrame:
    """Of docs (doc_id, train, text): a row for each token that is not among the most frequent words, with the class of the word before it (k) and of the one after it (l),
    where these are; a row (word, other) where two such follow each other; and n of the pairs of classes of the others, over training documents. unit: the class of the word's unit."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        heads, tails, cls, *rest = sent.value
        units, common, pairs = Units(heads, tails), Words(*rest), np.zeros(k * k, np.int64)
        for batch, words, sizes in _together(batches):
            own, before = common.numbers(words)
            of, train = np.repeat(np.arange(len(sizes)), sizes), batch.column("train").to_numpy(zero_copy_only=False).astype(bool)
            both = (own >= 0) & (before >= 0) & train[of]
            pairs += np.bincount(common.first[before[both]] * k + common.second[own[both]], minlength=k * k)
            rare = np.flatnonzero(own < 0)
            if not len(rare):
                continue
            after = own[rare + 1]
            unit = cls[units.numbers([words[i] for i in rare.tolist()])]
            here = np.concatenate([rare, rare[after < 0]])
            n, m = len(rare), len(here)
            none = np.arange(m) >= n
            # a null where the neighbour's class is not known here
            classes = [np.append(x, np.zeros(m - n, np.int64)) for x in (common.first[before[rare]], common.second[after], unit)]
            classes[2][n:] = unit[after < 0]
            gaps = [np.append(before[rare] < 0, none[n:]), np.append(after < 0, none[n:]), np.zeros(m, bool)]
            other = pa.array([None] * n + [words[i + 1] for i in rare[after < 0].tolist()], pa.string())
            rows = [batch.column("doc_id").take(pa.array(of[here])), pa.array(train[of[here]]), pa.array([words[i] for i in here.tolist()], pa.string()), other, *(pa.array(x, pa.int32(), mask=g) for x, g in zip(classes, gaps, strict=True)), pa.nulls(m, pa.int64())]
            yield pa.RecordBatch.from_arrays(rows, names)
        found = np.flatnonzero(pairs)
        # a blank and a number: no word, and no key that many rows share
        blank = pa.array([f" {i}" for i in found.tolist()], pa.string())
        none = [pa.nulls(len(found), t) for t in (ids, pa.bool_(), pa.string(), pa.int32())]
        yield pa.RecordBatch.from_arrays([none[0], none[1], blank, none[2], pa.array(found // k, pa.int32()), pa.array(found % k, pa.int32()), none[3], pa.array(pairs[found])], names)

    kind, ids = dict(docs.dtypes)["doc_id"], to_arrow_type(docs.schema["doc_id"].dataType)
    names = ["doc_id", "train", "word", "other", "k", "l", "unit", "n"]
    return docs.select("doc_id", "train", "text").mapInArrow(run, f"doc_id {kind}, train boolean, word string, other string, k int, l int, unit int, n long")


def common_scores(docs: DataFrame, sent: Broadcast, factor: np.ndarray, unknown_end: float) -> DataFrame:
    """doc_id, n_tokens, n_known, base and score of the tokens that are among the most frequent words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common = Words(*sent.value[3:])
        logs, known = np.log10(common.c + 0.5), common.c > 0
        for batch, words, sizes in _together(batches):
            own, before = common.numbers(words)
            base = np.where(own >= 0, logs[own], 0.0)
            score = np.where(known[own], base, unknown_end)
            both = (own >= 0) & (before >= 0) & known[own]
            score[own < 0] = 0.0
            score[both] += factor[common.first[before[both]], common.second[own[both]]]
            begin = np.append(0, np.cumsum(sizes)[:-1])
            sums = [np.add.reduceat(x, begin) for x in (((own >= 0) & known[own]).astype(np.int64), base, score)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(sizes, pa.int64()), *map(pa.array, sums)], ["doc_id", "n_tokens", "n_known", "base", "score"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {dict(docs.dtypes)['doc_id']}, n_tokens long, n_known long, base double, score double")


def scores(docs: DataFrame, *, heads: int | None = None, tails: int | None = None, classes: int | None = None, rounds: int = ROUNDS, smoothing: float = 50.0) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score and perplexity of each document."""
    spark = docs.sparkSession
    train = docs.filter(~held_out())
    counts = written(count_words(train), name="counts")
    # N + 0.5 (V + 1) and N; the end is counted with the words
    n, v = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    whole = n + 0.5 * (v + 1)
    by_unit = heads is not None or tails is not None
    heads, tails, classes = (given or own for given, own in zip((heads, tails, classes), sizes(v), strict=True))
    names = [r.word for r in counts.filter(F.col("word") != END).orderBy(F.desc("c"), "word").limit(heads).collect()]
    ends = (counts.filter(F.col("word") == END).first() or (0, 0))[1]
    units = Units(names, tails)
    bigrams = written(unit_bigrams(train, names, tails), name="bigrams")
    cls, pairs = exchange(bigrams, units.n, classes, rounds)
    k = classes + 1

    def at(numbers: np.ndarray, i: Column) -> Column:
        return F.get(F.split(F.lit(",".join(map(repr, numbers.ravel().tolist()))), ",").cast("array<double>"), i)

    if by_unit:
        ranks = spark.createDataFrame([(w, i) for i, w in enumerate(names)], "word string, rank int")
        tail = F.lit(len(names)) + F.pmod(F.crc32(F.encode(F.expr("right(word, 3)"), "UTF-8")), F.lit(tails)).cast("int")
        own = at(cls, F.coalesce("rank", tail)).cast("int")
        table = counts.filter(F.col("word") != END).join(F.broadcast(ranks), "word", "left").select("word", "c", own.alias("first"), own.alias("second"))
    else:
        table = own_classes(neighbours(train, names, tails, cls), pairs)
    table = written(table, name="words")
    top = table.filter(F.col("c") >= least_common(table)).toArrow()
    c, first, second = (np.append(top.column(name).to_numpy(), x) for name, x in (("c", ends), ("first", classes), ("second", classes)))
    sent = spark.sparkContext.broadcast((names, tails, cls, top.column("word").to_pylist(), c, first, second))
    rows = rare_rows(docs.select("doc_id", F.coalesce(~held_out(), F.lit(False)).alias("train"), "text"), sent, k)
    met = written(rows.join(table, "word", "left").select("*", F.coalesce("first", "unit").alias("by")).drop("word", "unit", "first"), name="met")
    # neighbours that both are rare: the second one's classes come now
    beside = written(met.filter("other is not null").select("doc_id", "train", "by", F.col("other").alias("word")).join(table.select("word", "second"), "word").drop("word"), name="beside")
    lone_rows = met.filter("other is null and n is null")
    seen = met.filter("n is not null").select("k", "l", "n")
    for df, a, b in ((lone_rows, "k", "second"), (lone_rows, "by", "l"), (beside, "by", "second")):
        seen = seen.unionByName(df.filter("train").select(F.col(a).alias("k"), F.col(b).alias("l"), F.lit(1).cast("long").alias("n")).filter("k is not null and l is not null"))
    pairs = np.zeros((k, k))
    for r in seen.groupBy("k", "l").agg(F.sum("n").alias("n")).collect():
        pairs[r.k, r.l] = r.n
    mass = np.zeros(k)
    for r in table.groupBy("second").agg(F.sum(F.col("c") + 0.5).alias("m")).collect():
        mass[r.second] += r.m / whole
    mass[classes] += (ends + 0.5) / whole if ends else 0
    unseen = 0.5 / whole
    q = mass / max(1e-300, 1 - unseen)
    given = (1 - unseen) * (pairs + smoothing * q) / (pairs.sum(1, keepdims=True) + smoothing)
    # log10 of what a known word's base probability is multiplied by
    factor = np.log10(np.maximum(given, 1e-300)) - np.log10(np.maximum(mass, 1e-300))
    lone, unseen_log = math.log10(1 / whole), math.log10(unseen)
    given_by = lambda a, b: F.coalesce(at(factor, F.col(a) * k + F.col(b)), F.lit(0.0))
    is_known, log = F.col("c").isNotNull(), F.log10(F.coalesce("c", F.lit(0)) + 0.5)
    none = F.lit(0).cast("long")
    each = common_scores(docs, sent, factor, unseen_log - lone)
    each = each.unionByName(lone_rows.select("doc_id", none.alias("n_tokens"), is_known.cast("long").alias("n_known"), log.alias("base"), (F.when(is_known, log + given_by("k", "second")).otherwise(unseen_log - lone) + given_by("by", "l")).alias("score")))
    each = each.unionByName(beside.select("doc_id", none.alias("n_tokens"), none.alias("n_known"), F.lit(0.0).alias("base"), given_by("by", "second").alias("score")))
    total = each.groupBy("doc_id").agg(*(F.sum(c).alias(c) for c in ("n_tokens", "n_known", "base", "score")))
    score = F.col("score") + F.col("n_tokens") * F.lit(lone)
    return total.select("doc_id", held_out().alias("held_out"), "n_tokens", "n_known", F.lit(n).cast("long").alias("train_tokens"), (F.col("base") + F.col("n_tokens") * F.lit(lone)).alias("base_score"), score.alias("score"), F.pow(F.lit(10.0), -score / F.col("n_tokens")).alias("perplexity"))
