"""Reading and writing corpora, word lists and ignore rules as tables."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid
from urllib.parse import quote

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def _below(path: str) -> Column:
    """The file's path below the folder ``path``, or its name where ``path`` is the file."""
    folder = path.rstrip("/") + "/"
    whole = F.col("_metadata.file_path")
    return F.when(whole.contains(folder), F.substring_index(whole, folder, -1)).otherwise(F.substring_index(whole, "/", -1))


def read_files(spark: SparkSession, path: str, *, missing_ok: bool = False) -> DataFrame:
    """path (below ``path``, so that rules see it as they are written) and content, a row for each file; missing_ok: no rows where there is no such path."""
    try:
        files = spark.read.text(path, wholetext=True, recursiveFileLookup=True)
    except AnalysisException as e:
        if not missing_ok or e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], "path string, content string")
    return files.select(_below(path).alias("path"), F.col("value").alias("content"))


#: Blocks of files whose numbers are broadcast, at most.
BROADCAST_SPLITS = 1_000_000


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """path, line_no and line as ``lines(read_files(...))`` gives them, of files of any size: a file is read in blocks, by many tasks.

    A block's lines are numbered by its task; how many lines stand before it comes from a running sum of the blocks' counts,
    which is all that is shuffled. A NUL in any block makes the file binary. A file's last line is empty if its bytes are those of
    its lines with a line end each. Both passes read the files by the same plan.
    """
    below, start = _below(path), F.col("_metadata.file_block_start")
    files = spark.read.text(path, recursiveFileLookup=True, lineSep="\n")
    rows = files.select(below.alias("path"), start.alias("start"), F.col("_metadata.file_size").alias("bytes"), F.monotonically_increasing_id().alias("id"), F.col("value").alias("line"))
    blocks = rows.groupBy("path", "start").agg(F.min("id").alias("first"), F.count("*").alias("n"), F.sum(F.octet_length("line") + 1).alias("size"), F.max(F.instr("line", "\x00")).alias("nul"), F.max("bytes").alias("bytes"))
    order = Window.partitionBy("path").orderBy("start")
    whole = Window.partitionBy("path")
    counted = blocks.withColumn("before", F.sum("n").over(order) - F.col("n")).withColumn("nul", F.max("nul").over(whole)).withColumn("all", F.sum("n").over(whole)).withColumn("size", F.sum("size").over(whole))
    numbers = stored(counted.filter("nul = 0").select(F.col("path").alias("_path"), F.col("start").alias("_start"), "first", "before", "all", (F.col("size") == F.col("bytes")).alias("ended")))
    few = numbers.limit(BROADCAST_SPLITS + 1).count() <= BROADCAST_SPLITS
    met = rows.join(F.broadcast(numbers) if few else numbers, (F.col("path") == F.col("_path")) & (F.col("start") == F.col("_start")))
    numbered = met.select("path", (F.col("before") + F.col("id") - F.col("first") + 1).cast("int").alias("line_no"), "line")
    last = numbers.filter("ended and before = 0").select(F.col("_path").alias("path"), (F.col("all") + 1).cast("int").alias("line_no"), F.lit("").alias("line"))
    # files without a byte have one empty line and no row
    empty = spark.read.format("binaryFile").load(path, recursiveFileLookup=True).filter("length = 0").select(_below(path).alias("path"), F.lit(1).alias("line_no"), F.lit("").alias("line"))
    return numbered.unionByName(last).unionByName(empty)


def from_documents(docs: DataFrame) -> DataFrame:
    """path (lang/source/id.txt) and content of a documents table."""
    return docs.select(F.concat_ws("/", F.coalesce("lang", F.lit("-")), F.coalesce("source", F.lit("-")), F.concat(F.col("doc_id").cast("string"), F.lit(".txt"))).alias("path"), F.col("text").alias("content"))


def is_text() -> Column:
    """Whether content has no NUL anywhere."""
    return F.instr("content", "\x00") == 0


def lines(corpus: DataFrame, *, tasks: int | None = None) -> DataFrame:
    """path, line_no (from 1), line and the corpus' other columns; binary files give none.

    ``tasks``: lines are dealt out to so many tasks, for a corpus of few or of large files, which few tasks would read.
    """
    more = [c for c in corpus.columns if c not in ("path", "content")]
    numbered = corpus.filter(is_text()).select("path", *more, F.posexplode(F.split("content", "\n", -1)).alias("pos", "line")).select("path", (F.col("pos") + 1).alias("line_no"), "line", *more)
    return numbered.repartition(tasks) if tasks else numbered


def tasks_for(corpus: DataFrame) -> int | None:
    """The cluster's cores if fewer tasks would read the corpus, a scan; else None."""
    cores = corpus.sparkSession.sparkContext.defaultParallelism
    return cores if corpus.rdd.getNumPartitions() < cores else None


def spread(corpus: DataFrame) -> DataFrame:
    """The corpus dealt out to all cores where fewer tasks would read it."""
    tasks = tasks_for(corpus)
    return corpus.repartition(tasks) if tasks else corpus


def distinct_paths(corpus: DataFrame) -> bool:
    """Whether no path is there twice."""
    return corpus.groupBy("path").count().filter("count > 1").isEmpty()


def parse_words(lists: DataFrame) -> DataFrame:
    """word and wordlist from (wordlist, content): a word a line, trimmed; no empty ones."""
    each = lists.select("wordlist", F.explode(F.split("content", "\n", -1)).alias("w"))
    return each.select(F.trim("w", F.lit("\r ")).alias("word"), "wordlist").filter("word != ''")


def read_wordlists(spark: SparkSession, path: str) -> DataFrame:
    """word and wordlist (the file's path below ``path``, without .txt) of all .txt files."""
    files = spark.read.text(path, wholetext=True, recursiveFileLookup=True, pathGlobFilter="*.txt")
    return parse_words(files.select(F.regexp_replace(_below(path), r"\.txt$", "").alias("wordlist"), F.col("value").alias("content")))


def project_wordlists(spark: SparkSession, path: str) -> DataFrame:
    """word and wordlist of a project's own lists, which are for all files: '*'."""
    return read_wordlists(spark, path).select("word", F.lit("*").alias("wordlist")).distinct()


def write_misses(found: DataFrame, path: str) -> None:
    """The misses as Parquet files: a row each."""
    found.write.parquet(path)


def write_corpus(corpus: DataFrame, path: str) -> None:
    """A new corpus (path, content); the one that was read stays."""
    corpus.select("path", "content").write.parquet(path)


def _exists(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The table at the path, or no rows."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def update_corpus(corpus: DataFrame, path: str, *, parts: int = 256) -> int:
    """Brings a written corpus (path, content, in ``parts`` by hash) up to date: only parts with a file that is new, changed or gone are written again. Returns their number.

    Files are told by hashes of their contents, so of what has not changed nothing is shuffled. What is written is put aside first, as the parts are also read.
    """
    spark = corpus.sparkSession
    part = F.pmod(F.xxhash64("path"), F.lit(parts)).cast("int").alias("part")
    told = lambda df: df.select("path", part, F.sha2(F.coalesce("content", F.lit("")), 256).alias("sha"))
    old = _exists(spark, path, "path string, content string, part int")
    changed = stored(told(corpus).join(told(old).withColumnRenamed("sha", "was").drop("part").withColumnRenamed("path", "_path"), F.col("path") == F.col("_path"), "full").filter("sha is null or was is null or sha != was").select(F.pmod(F.xxhash64(F.coalesce("path", "_path")), F.lit(parts)).cast("int").alias("part")).distinct())
    # there are no more than ``parts`` numbers
    again = stored(corpus.select("path", "content", part).join(F.broadcast(changed), "part", "left_semi"))
    again.write.partitionBy("part").mode("overwrite").option("partitionOverwriteMode", "dynamic").parquet(path)
    gone = [r.part for r in changed.join(again.select("part").distinct(), "part", "left_anti").collect()]
    _drop(spark, path, [f"part={p}" for p in gone])
    return changed.count()


def update_lexicon(lexicon: DataFrame, path: str) -> list[str]:
    """Brings a written lexicon up to date: only the lists that differ are written again. Returns their names, in order."""
    spark = lexicon.sparkSession
    lexicon = stored(lexicon.select("word", "wordlist").distinct())
    # lists are told by the number and the sums of two hashes of their words
    told = lambda df: df.groupBy("wordlist").agg(F.struct(F.count("*"), F.sum(F.xxhash64("word").cast("decimal(38,0)")), F.sum(F.hash("word").cast("long"))).alias("told"))
    old = told(_exists(spark, path, "word string, wordlist string").distinct()).withColumnRenamed("told", "was")
    both = told(lexicon).join(old, "wordlist", "full").filter("told is null or was is null or told != was").select("wordlist", F.col("told").isNull().alias("gone")).collect()
    changed = [r.wordlist for r in both if not r.gone]
    lexicon.filter(F.col("wordlist").isin(*changed)).write.partitionBy("wordlist").mode("overwrite").option("partitionOverwriteMode", "dynamic").parquet(path)
    _drop(spark, path, [f"wordlist={quote(r.wordlist, safe='')}" for r in both if r.gone])
    return sorted(r.wordlist for r in both)


def _drop(spark: SparkSession, path: str, folders: list[str]) -> None:
    for name in folders:
        folder = spark._jvm.org.apache.hadoop.fs.Path(path, name)
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def write_wordlist(words: DataFrame, path: str) -> None:
    """Distinct words in byte order, one a line, as one file."""
    words.select("word").distinct().orderBy("word").coalesce(1).write.text(path)


def write_lexicon(lexicon: DataFrame, path: str) -> None:
    """A new version of the lexicon, a folder for each list."""
    lexicon.select("word", "wordlist").distinct().write.partitionBy("wordlist").parquet(path)


def ignore_rules(corpus: DataFrame) -> DataFrame:
    """prefix, ord and pattern from the .gitignore files: the prefix is the file's folder; no blank, comment or negated lines."""
    files = corpus.filter(F.col("path").rlike(r"(^|/)\.gitignore$"))
    each = files.select(F.regexp_replace("path", r"\.gitignore$", "").alias("prefix"), F.posexplode(F.split("content", "\n", -1)).alias("ord", "p"))
    return each.select("prefix", "ord", F.trim("p", F.lit(" \t\r")).alias("pattern")).filter("pattern != '' and not startswith(pattern, '#') and not startswith(pattern, '!')")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share, as the session names it; where none is named, a temporary one of a local master alone, which goes with the process."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="spark-shared-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def stored(df: DataFrame, *, name: str = "stored") -> DataFrame:
    """``df`` written once to the shared folder and read back: later steps start from whole files, whatever executor is lost.

    What is written is deleted when the driver ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(folder)
    return spark.read.schema(df.schema).parquet(path)
