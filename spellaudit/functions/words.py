"""Words of plain lines, and the form in which words are looked up, by column functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Three equal letters in a row, or the alphabet's start: a line with these needs the scanner.
RUNS = r"([A-Za-z])\1\1|[aA][bB][cC]"
#: Lines of letters, blanks, commas and full stops, with no two capitals together: title and lower words alone.
PLAIN = "^[A-Za-z ,.]*$"


def normalize(word: Column) -> Column:
    """Curly quotes to straight ones; one straight quote at the end goes; A-Z lower-cased."""
    return F.translate(F.regexp_replace(word, "'$", ""), "ABCDEFGHIJKLMNOPQRSTUVWXYZ‘’", "abcdefghijklmnopqrstuvwxyz''")


_FORMS = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ‘’", "abcdefghijklmnopqrstuvwxyz''")


def normalized(word: str) -> str:
    """``normalize`` of one word."""
    return word.removesuffix("'").translate(_FORMS)


def is_plain(line: Column) -> Column:
    return line.rlike(PLAIN) & ~line.rlike(RUNS) & ~line.rlike("[A-Z]{2}")


def plain_tokens(numbered: DataFrame, min_length: int = 3) -> DataFrame:
    """path, line_no and text of the words of plain lines, without the scanner."""
    found = F.filter(F.regexp_extract_all("line", F.lit("[A-Z]?[a-z]+"), F.lit(0)), lambda w: F.length(w) >= min_length)
    return numbered.filter(is_plain(F.col("line"))).select("path", "line_no", F.explode(found).alias("text"))


def apply_case(word: Column, kind: Column) -> Column:
    return F.when(kind == "lower", F.lower(word)).when(kind == "upper", F.upper(word)).when(kind == "title", F.concat(F.upper(F.substring(word, 1, 1)), F.lower(F.substr(word, F.lit(2))))).otherwise(word)
