"""Lexicons, misses and reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from spellaudit.functions import scan
from spellaudit.functions.keys import KeyModel
from spellaudit.functions.words import normalize
from spellaudit.operators import directives, select
from spellaudit.options import Options
from spellaudit.sources.corpus import stored, write_misses

#: Lexicons of up to so many words are broadcast.
BROADCAST_WORDS = 500_000


def _sized(words: DataFrame) -> DataFrame:
    """The words, broadcast if they are few enough; ``words`` should be a written table, as it is counted first."""
    return F.broadcast(words) if words.limit(BROADCAST_WORDS + 1).count() <= BROADCAST_WORDS else words


def set_of(wordlists: str) -> Column:
    """The number of a set of lists; files have few different sets."""
    return F.xxhash64(F.array_sort(F.array_distinct(wordlists)))


def by_set(lexicon: DataFrame, sets: DataFrame) -> DataFrame:
    """norm and set: the words of each set's lists and the project's ('*'), for the sets (set, wordlists)."""
    listed = sets.select("set", F.explode("wordlists").alias("wordlist")).unionByName(sets.select("set", F.lit("*").alias("wordlist")))
    return listed.join(lexicon.select("wordlist", F.col("word").alias("norm")), "wordlist").select("norm", "set").distinct()


def unknown(tokens: DataFrame, known: DataFrame, key: list[str]) -> DataFrame:
    """The tokens whose key is not known (a written table). Few known words are broadcast; else the distinct keys are looked up, so that
    frequent words do not gather, and the tokens are joined with those that are unknown."""
    if known.limit(BROADCAST_WORDS + 1).count() <= BROADCAST_WORDS:
        return tokens.join(F.broadcast(known), key, "left_anti").select(tokens.columns)
    tokens = stored(tokens)
    open_ = stored(tokens.select(key).distinct().join(known, key, "left_anti"))
    return tokens.join(_sized(open_), key, "left_semi").select(tokens.columns)


def misses(tokens: DataFrame, lexicon: DataFrame, files: DataFrame | None = None) -> DataFrame:
    """The tokens, with norm, whose normalised text is in no list of their file (files: path, wordlists) nor in a project's ('*').

    Tokens have text, or norm where it is known already (as words counted by file), and set, the number of their file's lists, where that is known.
    """
    t = tokens if "norm" in tokens.columns else tokens.withColumn("norm", normalize(F.col("text")))
    if files is None:
        return t.join(_sized(lexicon.select(F.col("word").alias("norm")).distinct()), "norm", "left_anti").select(t.columns)
    sets = stored(files.select(set_of("wordlists").alias("set"), F.array_sort(F.array_distinct("wordlists")).alias("wordlists")).distinct())
    if "set" not in t.columns:
        t = t.join(files.select("path", set_of("wordlists").alias("set")), "path")
    found = unknown(t, stored(by_set(lexicon, sets)), ["norm", "set"])
    # sets are as few as the combinations of languages
    return found.join(F.broadcast(sets), "set").drop("set")


def check_corpus(corpus: DataFrame, lexicon: DataFrame, options: Options = Options(), *, model: KeyModel | None = None, tasks: int | None = None, **selection) -> DataFrame:
    """The whole check of a corpus (path, content): path, line_no, col, text, case_kind, norm and wordlists (sorted) of each miss.

    Files are chosen by the options' and the given rules (``selection``: what ``select_files`` takes), lines by directives;
    the scanner passes over keys by ``model``, and a word is known if one of its file's lists or a project's ('*') has it. ``tasks``: as for ``lines``.
    """
    chosen = select.select_files(corpus, options, **selection).select("path", "content", select.wordlists(options).alias("wordlists"))
    numbered = directives.checked_lines(chosen.select("path", "content", set_of("wordlists").alias("set")), options.marker, tasks=tasks)
    tokens = scan.words(numbered, min_length=options.min_length, model=model, marker=options.marker, skip_data_uris=options.skip_data_uris, places=True, keep=("set",))
    return misses(tokens, lexicon, chosen.select("path", "wordlists"))


def _times(found: DataFrame) -> Column:
    """How many misses a row stands for."""
    return F.sum("n") if "n" in found.columns else F.count("*")


def harvest(found: DataFrame) -> DataFrame:
    """The distinct unknown words as a list; order when it is written."""
    return found.select(F.col("norm").alias("word")).distinct()


def add_words(lexicon: DataFrame, words: DataFrame, wordlist: str) -> DataFrame:
    """The lexicon with normalised words added to a list, each once."""
    new = words.select(normalize(F.col("word")).alias("word"), F.lit(wordlist).alias("wordlist"))
    return lexicon.select("word", "wordlist").unionByName(new).distinct()


def summary(files: DataFrame, found: DataFrame) -> DataFrame:
    """One row: files_checked (also binary and empty ones) and misses_found."""
    return files.agg(F.count("*").alias("files_checked")).crossJoin(found.agg(F.coalesce(_times(found), F.lit(0)).alias("misses_found")))


def by_path(found: DataFrame) -> DataFrame:
    return found.groupBy("path").agg(_times(found).alias("misses"))


def hint_paths(found: DataFrame, most: int = 20) -> DataFrame:
    """The paths with misses if there are no more than ``most``, else none."""
    paths = found.select("path").distinct()
    return paths.limit(0) if paths.limit(most + 1).count() > most else paths.orderBy("path")


def write_report(found: DataFrame, files: DataFrame, path: str) -> dict[str, int | bool]:
    """Writes the misses and returns files_checked, misses_found and failed (whether there is any): misses are counted by the job that writes them."""
    seen = Observation()
    write_misses(found.observe(seen, F.count("*").alias("n")), path)
    n = seen.get["n"]
    return {"files_checked": files.count(), "misses_found": n, "failed": n > 0}


def has_misses(found: DataFrame) -> bool:
    return not found.limit(1).isEmpty()


def context(line: Column, col: Column, text: Column) -> list[Column]:
    """before, word and after of a miss; places are bytes, so the line is cut as bytes."""
    raw = F.encode(line, "UTF-8")
    before = F.decode(F.substr(raw, F.lit(1), col), "UTF-8")
    after = F.decode(F.substr(raw, col + F.octet_length(text) + 1), "UTF-8")
    return [F.ltrim(before, F.lit(" \t")).alias("before"), text.alias("word"), F.rtrim(after, F.lit(" \t\r\n")).alias("after")]


def with_context(found: DataFrame, numbered: DataFrame) -> DataFrame:
    """place (path:line:col), before, word and after of each miss."""
    place = F.format_string("%s:%d:%d", "path", "line_no", "col")
    return found.join(numbered, ["path", "line_no"]).select("path", "line_no", "col", place.alias("place"), *context(F.col("line"), F.col("col"), F.col("text")))
