"""Spans that may be keys: their features and a Gaussian model of eight classes, the last four of which are keys."""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spellaudit.sources.corpus import stored

# The classes in their order, and the letters whose frequency counts.
CLASSES = ("not_key_lower36", "not_key_base64", "not_key_hex", "not_key_upper36", "key_base64", "key_hex", "key_lower36", "key_upper36")
LETTERS = "+-_/AzZqQXx"
CHARSETS = (("hex", "[0-9A-Fa-f-]*", 16), ("lower36", "[0-9a-z]*", 36), ("upper36", "[0-9A-Z]*", 36), ("base64", "[A-Za-z0-9_+/=-]*", 64))
CHUNKS = {"title": "[A-Z][a-z]+", "lower": "[a-z]+", "upper": "[A-Z]+", "alpha": "[A-Za-z]+", "alnum": "[A-Za-z0-9]+", "digit": "[0-9]+"}
FEATURES = (
    *LETTERS, "equal", "length", *(c for c, _, _ in CHARSETS),
    "mean_title", "variance_title", "max_title", *(f"{s}_{k}" for k in ("lower", "upper", "alpha", "alnum", "digit") for s in ("mean", "variance")),
    "vowel_consonant_ratio", "alpha_chunks", "alnum_chunks", "digit_chunks", "title_chunks", "mean_difference", "max_difference",
)
FLOOR = 1e-10
#: Letters and digits that change twice; a line without such a place has no span.
CHANGES = r"(?:[A-Za-z][_/+-]*[0-9][0-9_/+-]*[A-Za-z]|[0-9][_/+-]*[A-Za-z][A-Za-z_/+-]*[0-9])"
_CHARSET_RX = [(name, re.compile(rx), size) for name, rx, size in CHARSETS]
_CHUNK_RX = {k: re.compile(rx) for k, rx in CHUNKS.items()}


def features(span: str) -> list[float]:
    n = len(span)
    fits = [bool(rx.fullmatch(span)) for _, rx, _ in _CHARSET_RX]
    size = next((s for ok, (_, _, s) in zip(fits, _CHARSET_RX, strict=True) if ok), 0)
    # the share of a letter less the count that is expected: mixed on purpose
    expected = n / size if size else 0.0
    differences = [abs(span.count(c) / n - expected) if n else 0.0 for c in LETTERS]
    sizes = {k: np.array([len(m) for m in rx.findall(span)] or [0.0], float) for k, rx in _CHUNK_RX.items()}
    counts = {k: float(len(rx.findall(span))) for k, rx in _CHUNK_RX.items()}
    vowels = sum(c in "aeiouAEIOU" for c in span)
    # x is neither
    consonants = sum(c.isalpha() and c not in "aeiouAEIOUxX" for c in span)
    spread = [f(sizes[k]) for k in ("lower", "upper", "alpha", "alnum", "digit") for f in (np.mean, np.var)]
    title = sizes["title"]
    out = [*differences, span.count("="), n, *fits, title.mean(), title.var(), title.max(), *spread, vowels / consonants if consonants else vowels]
    return [float(x) for x in (*out, counts["alpha"], counts["alnum"], counts["digit"], counts["title"], sum(differences) / len(LETTERS), max(differences))]


class KeyModel:
    """Means and variances of the features, a row for each class; weight: powers of ten that key classes are given."""

    def __init__(self, means: np.ndarray, variances: np.ndarray, weight: int = 5):
        self.means, self.variances, self.weight = means, np.maximum(variances, FLOOR), weight
        self.boost = np.array([weight * math.log(10) if c.startswith("key") else 0.0 for c in CLASSES]) + math.log(1 / len(CLASSES))
        self.is_key = lru_cache(100_000)(self._is_key)

    def __reduce__(self):
        return KeyModel, (self.means, self.variances, self.weight)

    @classmethod
    def from_params(cls, params: DataFrame, weight: int = 5) -> KeyModel:
        """From rows of (class, feature, mean, variance): 296 of them."""
        found = {(r["class"], r.feature): (r.mean, r.variance) for r in params.collect()}
        table = np.array([[found[c, f] for f in FEATURES] for c in CLASSES])
        return cls(table[:, :, 0], table[:, :, 1], weight)

    def scores(self, spans: list[str]) -> np.ndarray:
        """A row for each span, a column for each class."""
        return self.scores_of(np.array([features(s) for s in spans]).reshape(-1, len(FEATURES)))

    def scores_of(self, x: np.ndarray) -> np.ndarray:
        """The scores of rows of features."""
        each = [(-0.5 * ((x - m) ** 2 / v + np.log(2 * np.pi * v))).sum(1) for m, v in zip(self.means, self.variances, strict=True)]
        return self.boost + np.stack(each, 1)

    def classify(self, spans: list[str]) -> list[str]:
        return [CLASSES[i] for i in self.scores(spans).argmax(1)] if spans else []

    def _is_key(self, span: str) -> bool:
        return self.classify([span])[0].startswith("key")


def candidates(numbered: DataFrame) -> DataFrame:
    """path, line_no and span: maximal runs with letters and digits that change twice, of 6 to 200 characters with 3 letters, or longer."""
    changing = numbered.filter(F.col("line").rlike(CHANGES))
    runs = changing.select("path", "line_no", F.explode(F.regexp_extract_all("line", F.lit("[A-Za-z0-9][A-Za-z0-9_/+-]*=*"), F.lit(0))).alias("span"))
    plain = F.regexp_replace("span", "[-_/+=]", "")
    letters = F.length(F.regexp_replace("span", "[^A-Za-z]", ""))
    return runs.filter(plain.rlike("[A-Za-z][0-9]+[A-Za-z]|[0-9][A-Za-z]+[0-9]") & (F.length("span") >= 6) & ((F.length("span") > 200) | (letters >= 3)))


def feature_rows(spans: DataFrame) -> DataFrame:
    """span and features, an array, of distinct spans."""
    return with_features(spans.select("span").distinct())


def with_features(spans: DataFrame) -> DataFrame:
    """The rows with features, an array; by column functions, step by step so that nothing is worked out twice."""
    span, n = F.col("span"), F.length("span").cast("double")
    without = lambda signs: F.length(F.regexp_replace(span, signs, ""))
    found = spans.withColumn("_fits", F.array(*(span.rlike(f"\\A(?:{rx})\\z") for _, rx, _ in CHARSETS)))
    for name, rx in CHUNKS.items():
        found = found.withColumn(f"_{name}", F.transform(F.regexp_extract_all(span, F.lit(rx), F.lit(0)), lambda x: F.length(x).cast("double")))
        found = found.withColumn(f"_mean_{name}", F.when(F.size(f"_{name}") > 0, F.aggregate(f"_{name}", F.lit(0.0), lambda a, x: a + x) / F.size(f"_{name}")).otherwise(0.0))
    size = F.lit(None).cast("double")
    for i in reversed(range(len(CHARSETS))):
        size = F.when(F.col("_fits")[i], float(CHARSETS[i][2])).otherwise(size)
    found = found.withColumn("_expected", F.coalesce(n / size, F.lit(0.0)))
    # the share of a letter less the count that is expected: mixed on purpose
    share = lambda c: (F.length(span) - F.length(F.replace(span, F.lit(c), F.lit("")))).cast("double") / n
    found = found.withColumn("_differences", F.when(n > 0, F.array(*(F.abs(share(c) - F.col("_expected")) for c in LETTERS))).otherwise(F.array(*[F.lit(0.0)] * len(LETTERS))))

    def variance(name: str) -> Column:
        mean = F.col(f"_mean_{name}")
        return F.when(F.size(f"_{name}") > 0, F.aggregate(f"_{name}", F.lit(0.0), lambda a, x: a + (x - mean) * (x - mean)) / F.size(f"_{name}")).otherwise(0.0)

    vowels, consonants = F.length(span) - without("[aeiouAEIOU]"), F.length(span) - without("[B-DF-HJ-NP-TV-WY-Zb-df-hj-np-tv-wy-z]")
    spread = [x for name in ("lower", "upper", "alpha", "alnum", "digit") for x in (F.col(f"_mean_{name}"), variance(name))]
    ratio = F.when(consonants > 0, vowels / consonants).otherwise(vowels)
    rest = [F.length(span) - without("="), n, *(F.col("_fits")[i].cast("double") for i in range(len(CHARSETS))), F.col("_mean_title"), variance("title"), F.coalesce(F.array_max("_title"), F.lit(0.0)), *spread, ratio]
    counts = [F.size(f"_{name}") for name in ("alpha", "alnum", "digit", "title")]
    summed = [F.aggregate("_differences", F.lit(0.0), lambda a, x: a + x) / len(LETTERS), F.array_max("_differences")]
    return found.select(*spans.columns, F.concat("_differences", F.array(*(x.cast("double") for x in (*rest, *counts, *summed)))).alias("features"))


#: Spans that are keys are sent to all tasks up to this number (200 characters each, at most).
KNOWN = 200_000


class KnownKeys:
    """The spans of a corpus that are keys, as found by ``scanner_spans`` and ``classify``: a model for its scanner."""

    def __init__(self, sent: Broadcast):
        self.sent = sent

    def is_key(self, span: str) -> bool:
        return span in self.sent.value


def scanner_spans(numbered: DataFrame) -> DataFrame:
    """The distinct spans of 6 to 200 characters that the scanner may have to judge: the rest of a run from any of its letters and digits on."""
    changing = numbered.filter(F.col("line").rlike(CHANGES))
    runs = changing.select(F.explode(F.regexp_extract_all("line", F.lit("[A-Za-z0-9_/+-]++=*+(?![A-Za-z0-9])"), F.lit(0))).alias("run")).filter((F.length("run") >= 6) & F.col("run").rlike(CHANGES)).distinct()
    last = F.length("run") - 5
    ends = runs.select(F.explode(F.transform(F.sequence(F.greatest(F.lit(1), F.length("run") - 199), last), lambda i: F.substr("run", i))).alias("span")).distinct()
    changes = F.regexp_replace("span", "[-_/+=]", "").rlike("[A-Za-z][0-9]+[A-Za-z]|[0-9][A-Za-z]+[0-9]")
    return ends.filter(F.col("span").rlike("^[A-Za-z0-9]") & changes & (F.length(F.regexp_replace("span", "[^A-Za-z]", "")) >= 3))


def for_scanner(numbered: DataFrame, params: DataFrame, weight: int = 5) -> KnownKeys | KeyModel:
    """A model for the scanner of these lines: every span that it may meet is classed once, by joins, and it gets those that are keys.

    If there are more than KNOWN, it gets the parameters instead and classes spans as it meets them.
    """
    spark = numbered.sparkSession
    found = stored(classify(scanner_spans(numbered), params, weight).filter("is_key").select("span"))
    some = [r.span for r in found.limit(KNOWN + 1).collect()]
    return KnownKeys(spark.sparkContext.broadcast(frozenset(some))) if len(some) <= KNOWN else KeyModel.from_params(params, weight)


def fit_params(labelled: DataFrame) -> DataFrame:
    """class, feature, mean and variance from (class, features); classes without rows get what all rows give. One pass, with a row a class; no rows give none."""
    each = [F.col("features")[i] for i in range(len(FEATURES))]
    told = F.arrays_zip(F.array(*map(F.lit, FEATURES)).alias("feature"), F.array(*map(F.avg, each)).alias("mean"), F.array(*map(F.var_pop, each)).alias("variance")).alias("told")
    own = stored(labelled.groupBy("class").agg(told)).filter(F.col("class").isin(*CLASSES))
    lacking = set(CLASSES) - {r["class"] for r in own.select("class").collect()}
    if lacking:
        every = labelled.agg(F.count("*").alias("n"), told).filter("n > 0")
        own = own.unionByName(every.select(F.explode(F.array(*map(F.lit, sorted(lacking)))).alias("class"), "told"))
    return own.select("class", F.inline("told"))


def classify(spans: DataFrame, params: DataFrame, weight: int = 5) -> DataFrame:
    """span, class and is_key of distinct spans, the first class on a tie; no parameters (296 rows, which go to all tasks) class none."""
    rows = feature_rows(spans)
    if params.isEmpty():
        return rows.limit(0).select("span", F.lit("").alias("class"), F.lit(False).alias("is_key"))
    model = KeyModel.from_params(params, weight)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            best = model.scores_of(batch.column(1).flatten().to_numpy().reshape(-1, len(FEATURES))).argmax(1)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(CLASSES).take(pa.array(best))], ["span", "class"])

    return rows.mapInArrow(run, "span string, class string").withColumn("is_key", F.startswith("class", F.lit("key")))
