"""Lines that directives in the text take out of the check."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spellaudit.sources.corpus import lines, stored

#: Lines of a block; blocks with directives that are broadcast, at most.
BLOCK, BROADCAST_BLOCKS = 4096, 50_000


def block_states(numbered: DataFrame, event, *, block: int = BLOCK) -> DataFrame:
    """path, block, carry and events: of each block of lines the events in it (line_no, event) and the last event before it; of blocks where either says D.

    Only events and block numbers are shuffled, and a file's window has a row for each of its blocks.
    """
    at = numbered.select("path", F.floor(F.col("line_no") / block).cast("int").alias("block"), F.when(event.isNotNull(), F.struct("line_no", event.alias("event"))).alias("e"))
    blocks = at.groupBy("path", "block").agg(F.sort_array(F.collect_list("e")).alias("events"))
    before = Window.partitionBy("path").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    last = F.when(F.size("events") > 0, F.element_at("events", -1)["event"])
    known = blocks.withColumn("carry", F.coalesce(F.last(last, ignorenulls=True).over(before), F.lit("E")))
    return known.filter((F.col("carry") == "D") | F.exists("events", lambda e: e["event"] == "D"))


def gate(numbered: DataFrame, marker: str, *, disable: str = ":disable", enable: str = ":enable", one: str = ":disable-line", block: int = BLOCK) -> DataFrame:
    """The lines (path, line_no, line) that stay: not between a disabling and an enabling line, nor disabled alone.

    The disabling line goes, the enabling line stays. Lines meet the state of their block, so a long file is many tasks.
    """
    line = F.col("line")
    on, off, alone = line.contains(marker + enable), line.contains(marker + disable), line.contains(marker + one)
    event = F.when(on, "E").when(off & ~alone, "D")
    states = stored(block_states(numbered, event, block=block).select(F.col("path").alias("_path"), F.col("block").alias("_block"), "carry", "events"))
    few = states.limit(BROADCAST_BLOCKS + 1).count() <= BROADCAST_BLOCKS
    here = (F.col("path") == F.col("_path")) & (F.floor(F.col("line_no") / block).cast("int") == F.col("_block"))
    met = numbered.filter(~alone).join(F.broadcast(states) if few else states, here, "left")
    own = F.element_at(F.filter("events", lambda e: e["line_no"] <= F.col("line_no")), -1)["event"]
    past = F.exists("events", lambda e: e["line_no"] <= F.col("line_no"))
    state = F.when(past, own).otherwise(F.coalesce("carry", F.lit("E")))
    return met.filter(state != "D").select(numbered.columns)


def checked_lines(corpus: DataFrame, marker: str, *, tasks: int | None = None) -> DataFrame:
    """The lines of a corpus that are checked; only files that hold the marker are looked through for directives."""
    has = F.col("content").contains(marker + ":")
    return lines(corpus.filter(~has), tasks=tasks).unionByName(gate(lines(corpus.filter(has), tasks=tasks), marker))
