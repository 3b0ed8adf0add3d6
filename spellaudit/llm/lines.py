"""Line dedup: removes lines that an earlier line repeats, exactly or within an edit.

Lines are the pieces between line feeds, compared without blanks at their ends. They are ordered by document id, then
place. A line of ``min_chars`` characters at least is removed if an earlier line equals it or, with ``threshold`` 1, is
within one edit (insert, delete or replace a character) of it, whether or not the earlier one stays itself. Shorter
lines always stay: headings and list marks repeat by nature.

The join is over distinct lines, each standing for its earliest place. With a threshold of one edit a line of L
characters is split into two segments, and a line of L or L + 1 characters that is near it has one of them in the place
that its own length gives. So the index has, by L and segment, the rest of the line as a key, and a line probes the
lengths L and L - 1. A key with up to ``bucket`` lines is compared pair by pair; a larger one halves the part that may
differ, level by level, until few lines share the rest. When one character or none is left to differ, the
earliest line for each such character decides. Keys are hashes, so of a pair the rest of the lines is compared, then the
parts that may differ by banded bit-parallel edit distance: a mask of the band's matches moves one bit vector for each
number of edits.

All steps are column functions and joins. Null text gives no lines, is left as it is and counts as zero lines. An empty
text has one empty line. Repeated rows of one id and text are copies: ties of (id, place) leave both, since neither is
earlier. Lines of any length take part whole. Empty tables give empty results; other columns are kept, or ignored by
``line_report``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spellaudit.llm.common import skewed_join, written

MIN_CHARS, BUCKET = 20, 24


def within(a: Column | str, b: Column | str, k: int = 1) -> Column:
    """Whether two strings are within k edits: bit-parallel over a band of 2 k + 1 diagonals.

    Bit d of vector e says that a prefix of ``a`` that is d - k characters longer than the one of ``b`` read so far is
    within e edits of it.
    """
    a, b = (F.col(x) if isinstance(x, str) else x for x in (a, b))
    width, one = 2 * k + 1, F.lit(1).cast("bigint")
    full = F.lit((1 << width) - 1).cast("bigint")
    start = F.struct(*(F.lit(((1 << e + 1) - 1) << k).cast("bigint").alias(f"r{e}") for e in range(k + 1)))
    none = F.array_repeat(F.lit(None).cast("string"), k)
    chars = lambda x: F.when(F.char_length(x) > 0, F.split(x, "")).otherwise(F.array().cast("array<string>"))
    padded = F.concat(none, chars(a), none)
    # each character of b beside those of a under the band, so that no step looks anything up
    n = F.char_length(b)
    beside = F.arrays_zip(chars(b).alias("c"), *(F.slice(padded, d + 1, F.greatest(n, F.lit(1))).alias(f"a{d}") for d in range(width)))
    read = F.slice(beside, 1, n)

    def step(state: Column, x: Column) -> Column:
        match = F.lit(0).cast("bigint")
        for d in range(width):
            match = match.bitwiseOR(F.when(x[f"a{d}"] == x["c"], one * (1 << d)).otherwise(F.lit(0).cast("bigint")))
        out, before = [], None
        for e in range(k + 1):
            was = state[f"r{e}"]
            now = was.bitwiseAND(match)
            if e:
                less = state[f"r{e - 1}"]
                now = now.bitwiseOR(less).bitwiseOR(F.shiftright(less, 1)).bitwiseOR(F.shiftleft(before, 1)).bitwiseAND(full)
            out.append(now.alias(f"r{e}"))
            before = now
        return F.struct(*out)

    gap = F.char_length(a) - F.char_length(b)
    final = F.aggregate(read, start, step)
    bit = F.element_at(F.array(*(one * (1 << d) for d in range(width))), F.when(F.abs(gap) <= k, (gap + k + 1).cast("int")).otherwise(1))
    return (F.abs(gap) <= k) & (final[f"r{k}"].bitwiseAND(bit) != 0)


def numbered(docs: DataFrame, min_chars: int) -> DataFrame:
    """doc_id, place and line of the lines that take part."""
    each = docs.filter(F.col("text").isNotNull()).select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("place", "raw"))
    return each.select("doc_id", "place", F.trim("raw", F.lit(" \t\r")).alias("line")).filter(F.char_length("line") >= min_chars)


def _key(level: int, part: Column, delta: Column) -> list[Column]:
    """key, begin and open of part ``part`` of 2**level of ``line``, read as a line of its length less delta.

    The key holds all of the line but the part, which is ``open`` characters (and delta more) from ``begin`` on.
    """
    # whole numbers of 64 bits: part times size is beyond 32 bits for long lines, and doubles would round
    size, part = F.char_length("line") - delta, part.cast("bigint")
    begin = F.shiftright(part * size, level).cast("int")
    end = F.shiftright((part + 1) * size, level).cast("int")
    key = F.xxhash64(F.lit(level), size, part, F.substr(F.col("line"), F.lit(1), begin), F.lit("|"), F.substr(F.col("line"), end + delta + 1))
    return [key.alias("key"), begin.alias("begin"), (end - begin).alias("open")]


def _rest(line: str, delta: Column) -> list[Column]:
    """What a line has before and after its open part."""
    return [F.substr(F.col(line), F.lit(1), F.col("begin")), F.substr(F.col(line), F.col("begin") + F.col("open") + delta + 1)]


def _tight(many: DataFrame) -> DataFrame:
    """id of lines with an earlier one within an edit, in keys where a base may differ in one character at most.

    All bases of a key are near each other. A line a character longer is near a base that it equals without one of the
    characters of its part. The rest of the lines is told by its MD5 besides the key.
    """
    part = F.substr(F.col("line"), F.col("begin") + 1, F.col("open") + F.col("delta"))
    without = F.when(F.col("delta") == 0, F.array(part)).otherwise(F.transform(F.sequence(F.lit(0), F.col("open")), lambda i: F.overlay(part, F.lit(""), i + 1, F.lit(1))))
    before, after = _rest("line", F.col("delta"))
    told = F.struct("key", F.md5(F.encode(before, "UTF-8")).alias("before"), F.md5(F.encode(after, "UTF-8")).alias("after")).alias("key")
    rows = many.select(told, "id", "first", "delta", F.explode(F.array_distinct(without)).alias("mid"))
    bases = rows.filter("delta = 0").groupBy("key").agg(F.min("first").alias("any"))
    same = rows.groupBy("key", "mid").agg(F.min(F.when(F.col("delta") == 0, F.col("first"))).alias("base"), F.min(F.when(F.col("delta") == 1, F.col("first"))).alias("longer"))
    return rows.join(bases, "key").join(same, ["key", "mid"]).filter("(delta = 0 and (first > any or first > longer)) or (delta = 1 and first > base)").select("id")


def _one_part(a: str, b: str, delta: Column, parts: int = 8) -> Column:
    """Whether two strings, the second ``delta`` longer, can be equal outside one of so many parts: most pairs end here."""
    a, b, out = F.col(a), F.col(b), F.lit(False)
    for j in range(parts):
        begin, end = (F.floor(F.char_length(a) * k / parts).cast("int") for k in (j, j + 1))
        out = out | ((F.substr(a, F.lit(1), begin) == F.substr(b, F.lit(1), begin)) & (F.substr(a, end + 1) == F.substr(b, end + delta + 1)))
    return out


def _near(shared: DataFrame, bucket: int) -> DataFrame:
    """id of lines with an earlier one within an edit, of what the keys of a level show; rows have the lines' texts."""
    few = shared.filter(F.col("size") <= bucket)
    base = few.filter("delta = 0").select("key", F.col("id").alias("a"), F.col("first").alias("fa"), F.col("line").alias("la"))
    pairs = few.select("key", F.col("id").alias("b"), F.col("first").alias("fb"), F.col("line").alias("lb"), "delta", "begin", "open").join(base, "key").filter("a != b and (delta = 1 or fa < fb)")
    # keys are hashes: the rest of the lines must be equal, then the open parts are compared
    (xa, ya), (xb, yb) = _rest("la", F.lit(0)), _rest("lb", F.col("delta"))
    open_ = lambda line, delta: F.substr(F.col(line), F.col("begin") + 1, F.col("open") + delta)
    equal = pairs.filter((F.char_length("la") + F.col("delta") == F.char_length("lb")) & (xa == xb) & (ya == yb))
    parts = equal.withColumn("pa", open_("la", F.lit(0))).withColumn("pb", open_("lb", F.col("delta")))
    near = parts.filter(_one_part("pa", "pb", F.col("delta"))).filter(within("pa", "pb", 1))
    found = near.select(F.when(F.col("fa") < F.col("fb"), F.col("b")).otherwise(F.col("a")).alias("id"))
    return found.unionByName(_tight(shared.filter((F.col("size") > bucket) & (F.col("open") <= 1))))


def _shared(live: DataFrame) -> DataFrame:
    """The rows of keys that several lines have, one of them read at its own length."""
    sizes = live.groupBy("key").agg(F.count("*").alias("size"), F.sum(1 - F.col("delta")).alias("bases")).filter("size > 1 and bases > 0").drop("bases")
    return live.join(sizes, "key")


def near_links(distinct: DataFrame, each: DataFrame, *, bucket: int = BUCKET) -> DataFrame:
    """id of distinct lines (id, first, keys of the first level) with an earlier line within one edit; ``each`` has the texts."""
    at = [(part, delta) for delta in (0, 1) for part in (0, 1)]
    keyed = F.explode(F.array(*(F.struct(F.col("keys")[i].alias("key"), F.lit(part).alias("part"), F.lit(delta).alias("delta")) for i, (part, delta) in enumerate(at))))
    narrow = written(_shared(distinct.select("id", "first", keyed.alias("k")).select("id", "first", "k.*")), name="keys")
    # texts come only now, for lines that share a key
    wanted = narrow.select("id", "first").distinct().select("id", F.col("first.doc_id").alias("doc_id"), F.col("first.place").alias("place"))
    texts = wanted.hint("merge").join(each.select("doc_id", "place", "line"), ["doc_id", "place"]).groupBy("id").agg(F.any_value("line").alias("line"))
    shared = written(narrow.join(texts, "id").select("id", "first", "line", "delta", "part", "size", *_key(1, F.col("part"), F.col("delta"))), name="keys")
    found, level = _near(shared, bucket), 1
    while True:
        wide = shared.filter((F.col("size") > bucket) & (F.col("open") > 1))
        # ends: a part of a level is half of one before
        if wide.isEmpty():
            return found.distinct()
        level += 1
        halves = wide.select("id", "first", "line", "delta", F.explode(F.array(F.col("part").cast("bigint") * 2, F.col("part").cast("bigint") * 2 + 1)).alias("part")).distinct()
        shared = written(_shared(halves.select("*", *_key(level, F.col("part"), F.col("delta")))), name="keys")
        found = found.unionByName(_near(shared, bucket))


def removed_places(docs: DataFrame, *, threshold: int = 1, min_chars: int = MIN_CHARS, bucket: int = BUCKET) -> DataFrame:
    """doc_id and gone, the places (from 0) of the lines that go, of documents that lose any."""
    if threshold not in (0, 1):
        raise ValueError("threshold must be 0 or 1")
    each = numbered(docs, min_chars)
    # lines are told by MD5; the keys of the first level are made where the text is at hand
    keys = F.array(*(_key(1, F.lit(part), F.lit(delta))[0] for delta in (0, 1) for part in (0, 1)))
    named = written(each.select("doc_id", "place", F.unhex(F.md5(F.encode("line", "UTF-8"))).alias("id"), keys.alias("keys")), name="lines")
    distinct = named.groupBy("id").agg(F.min(F.struct("doc_id", "place")).alias("first"), F.count("*").alias("times"), F.min("keys").alias("keys"))
    distinct = written(distinct, name="distinct")
    marks = distinct.filter("times > 1").select("id", "first", "times", F.lit(False).alias("all"))
    if threshold:
        near = written(near_links(distinct, each, bucket=bucket), name="near")
        marks = marks.unionByName(distinct.join(near, "id", "left_semi").select("id", "first", "times", F.lit(True).alias("all")))
        marks = written(marks.groupBy("id").agg(F.min("first").alias("first"), F.min("times").alias("times"), F.max("all").alias("all")), name="marks")
    # a line that many documents repeat stays spread
    gone = skewed_join(named.select("doc_id", "place", "id"), marks, "id", "times").filter(F.col("all") | (F.struct("doc_id", "place") > F.col("first")))
    return gone.groupBy("doc_id").agg(F.collect_set("place").alias("gone"))


def _fresh(docs: DataFrame, name: str) -> str:
    """A name that no column has."""
    taken = {c.lower() for c in docs.columns}
    while name in taken:
        name = f"_{name}"
    return name


def rebuilt(docs: DataFrame, **options: int) -> tuple[DataFrame, str, str, str]:
    """The rows of docs with all their lines, the places of those that go and what stays, joined by line feeds; and the three columns' names."""
    lines_, gone, kept = (_fresh(docs, f"_{x}") for x in ("lines", "gone", "kept"))
    places = written(removed_places(docs.select("doc_id", "text"), **options), name="gone").withColumnRenamed("gone", gone)
    joined = docs.join(places.hint("merge"), "doc_id", "left").withColumn(lines_, F.split("text", "\n", -1))
    # the places that stay, by one pass over a document's lines
    stay = F.array_sort(F.array_except(F.sequence(F.lit(0), F.size(lines_) - 1), F.col(gone)))
    text = F.array_join(F.transform(stay, lambda i: F.get(F.col(lines_), i)), "\n")
    return joined.withColumn(kept, F.when(F.col(gone).isNull(), F.col("text")).otherwise(text)), lines_, gone, kept


def line_report(docs: DataFrame, **options: int) -> DataFrame:
    """doc_id, n_lines, n_removed and kept_sha256 (of the text that stays) of each document."""
    done, lines_, gone, kept = rebuilt(docs.select("doc_id", "text"), **options)
    n_lines = F.when(F.col("text").isNull(), 0).otherwise(F.size(lines_)).cast("long")
    n_gone = F.when(F.col(gone).isNull(), 0).otherwise(F.size(gone)).cast("long")
    return done.select("doc_id", n_lines.alias("n_lines"), n_gone.alias("n_removed"), F.sha2(F.coalesce(kept, F.lit("")), 256).alias("kept_sha256"))


def dedup_lines(docs: DataFrame, **options: int) -> DataFrame:
    """The documents with the text that stays; those that lose all their lines go. Ids must be unique."""
    done, lines_, gone, kept = rebuilt(docs, **options)
    left = done.filter(F.col(gone).isNull() | (F.size(gone) < F.size(lines_)))
    return left.select(*(F.col(kept).alias("text") if c == "text" else F.col(f"`{c}`") for c in docs.columns))
