"""Which files are checked, and which word lists apply to each."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spellaudit.options import Options


def glob_rx(pattern: str, *, path_aware: bool = False) -> str:
    """A pattern as a regular expression. A star is any run, path_aware: without slashes, unless the pattern has two in a row."""
    star = "[^/]*" if path_aware and "**" not in pattern else ".*"
    return "(?s)^" + "".join(star if c == "*" else "." if c == "?" else re.escape(c) for c in pattern) + "$"


def glob_match(pattern: str, path: Column) -> Column:
    """Whole-string match; a pattern that ends in a slash: the path has it."""
    return path.contains(pattern) if pattern.endswith("/") else path.rlike(glob_rx(pattern))


def path_aware_match(pattern: str, path: Column) -> Column:
    if "**" in pattern:
        return glob_match(pattern, path)
    return path.rlike(glob_rx(pattern, path_aware=True))


def basename(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def rule_match(pattern: str, path: Column) -> Column:
    """An ignore rule on a file: with a slash inside on the path, rooted on the path, else on the last part."""
    rooted, rest = pattern.startswith("/"), pattern.removeprefix("/")
    if "/" in rest:
        return path_aware_match(rest, path)
    return glob_match(rest, path if rooted else basename(path))


def dir_match(pattern: str, path: Column) -> Column:
    """An ignore rule on a folder: a slash at its end goes; on the whole path, and unless rooted on the last part."""
    rooted, rest = pattern.startswith("/"), pattern.removeprefix("/").removesuffix("/")
    if "/" in rest:
        return path_aware_match(rest, path)
    whole = glob_match(rest, path)
    return whole if rooted else whole | glob_match(rest, basename(path))


def any_of(found: list[Column]) -> Column:
    out = F.lit(False)
    for x in found:
        out = out | x
    return out


def ancestors(path: Column) -> Column:
    """The folders above a file, outermost first."""
    split = F.split(path, "/")
    return F.when(F.size(split) > 1, F.transform(F.sequence(F.lit(1), F.size(split) - 1), lambda n: F.array_join(F.slice(split, 1, n), "/"))).otherwise(F.array().cast("array<string>"))


def _glob(pattern: str, star: str, one: str) -> str:
    return "".join(star if c == "*" else one if c == "?" else re.escape(c) for c in pattern)


def folded(rules: list[str], *, folders: bool = False) -> Callable[[Column], Column]:
    """What ``rule_match`` (folders: ``dir_match``) says for any of the rules, in one test of a path.

    Plain names and endings are looked up in sets; all other rules are alternatives of one regular expression over the whole
    path, those for the last part with a slash or the start before them.
    """
    names, endings, last, whole = set(), set(), [], []
    for rule in rules:
        rooted, rest = rule.startswith("/"), rule.removeprefix("/")
        rest = rest.removesuffix("/") if folders else rest
        if "/" in rest:
            crossing = "**" in rest
            whole.append(f".*{re.escape(rest)}.*" if crossing and rest.endswith("/") else _glob(rest, ".*" if crossing else "[^/]*", "."))
        elif rooted:
            whole.append(_glob(rest, ".*", "."))
        elif not re.search("[*?]", rest):
            names.add(rest)
        elif re.fullmatch(r"\*\.[^*?.]+", rest):
            endings.add(rest[2:])
        else:
            last.append(_glob(rest, "[^/]*", "[^/]"))
            if folders:
                whole.append(_glob(rest, ".*", "."))
    either = [*(["(?:.*/)?(?:" + "|".join(last) + ")"] if last else []), *whole]

    def test(path: Column) -> Column:
        found, name = F.lit(False), basename(path)
        if names:
            found = found | name.isin(*sorted(names))
        if endings:
            found = found | (name.contains(".") & F.substring_index(name, ".", -1).isin(*sorted(endings)))
        return found | path.rlike("(?s)^(?:" + "|".join(either) + ")$") if either else found

    return test


def excluded(path: Column, rules: list[str]) -> Column:
    """Whether root rules exclude a file or a folder above it."""
    return folded(rules)(path) | F.exists(ancestors(path), folded(rules, folders=True))


def _rule_rx() -> tuple[Column, Column]:
    """For the column ``pattern``: the regular expression, and whether it is for the path (else the last part)."""
    rest = F.regexp_replace("pattern", "^/", "")
    on_path = rest.contains("/") | F.startswith("pattern", F.lit("/"))
    star = F.when(rest.contains("/") & ~rest.contains("**"), F.lit("[^/]*")).otherwise(F.lit(".*"))
    quoted = F.regexp_replace(rest, r"([\\.\[\](){}+^$|])", r"\\$1")
    marked = F.replace(F.replace(F.replace(quoted, F.lit("?"), F.lit(".")), F.lit("*"), F.lit("\x01")), F.lit("\x01"), star)
    return F.concat(F.lit("(?s)^"), marked, F.lit("$")), on_path


def nested_excluded(files: DataFrame, rules: DataFrame) -> DataFrame:
    """The paths that rules (prefix, pattern) of a folder exclude, by an equality join on the folder."""
    # a folder's rules are two expressions, for paths below it and for their last parts
    each = files.select("path", F.explode(F.concat(ancestors(F.col("path")), F.array("path"))).alias("tested"))
    under = each.select("path", "tested", F.explode(ancestors(F.col("tested"))).alias("folder")).withColumn("prefix", F.concat("folder", F.lit("/")))
    rx, on_path = _rule_rx()
    each_rule = rules.filter("prefix != ''").select("prefix", rx.alias("rx"), on_path.alias("on_path"))
    joined = lambda on: F.array_join(F.sort_array(F.collect_set(F.when(F.col("on_path") == on, F.col("rx")))), "|")
    made = each_rule.groupBy("prefix").agg(joined(True).alias("whole"), joined(False).alias("last"))
    met = under.join(made, "prefix").withColumn("rel", F.expr("substring(tested, length(prefix) + 1)")).filter("rel != ''")
    hit = met.filter("(whole != '' and rel rlike whole) or (last != '' and substring_index(rel, '/', -1) rlike last)")
    return hit.select("path").distinct()


def select_files(corpus: DataFrame, options: Options = Options(), *, rules: DataFrame | None = None, root_rules: tuple[str, ...] = (), paths: DataFrame | None = None, suppress_rules: bool = False) -> DataFrame:
    """The files to check: those asked for (paths: no rule applies), or those that no rule excludes."""
    if paths is not None:
        return corpus.join(paths.select("path").distinct(), "path", "left_semi")
    if suppress_rules:
        return corpus
    kept = corpus.filter(~excluded(F.col("path"), [*options.excludes, *options.more_excludes, *root_rules]))
    return kept if rules is None else kept.join(nested_excluded(kept.select("path"), rules), "path", "left_anti")


def _named(globs: tuple[str, ...]) -> Callable[[Column], Column]:
    """Whether a glob fits the path or its last part."""
    plain = [g for g in globs if "/" not in g]
    return lambda path: any_of([folded(plain, folders=True)(path), *(glob_match(g, basename(path)) | glob_match(g, path) for g in globs if "/" in g)])


def wordlists(options: Options = Options()) -> Column:
    """The word lists of a file (path, content): English and its locales, languages by name or else by first line, the tool's terms."""
    path, content = F.col("path"), F.col("content")
    by_name = F.array_compact(F.array(*(F.when(_named(x.includes)(path), F.lit(x.name)) for x in options.languages)))
    first = F.substring_index(content, "\n", 1)
    by_bang = F.array_compact(F.array(*(F.when(F.startswith(content, F.lit("#!")) & any_of([first.contains(h) for h in x.hashbangs]), F.lit(x.name)) for x in options.languages)))
    fixed = ["english", *(f"english/{x}" for x in options.locales)]
    return F.array_distinct(F.concat(F.array(*map(F.lit, fixed)), F.when(F.size(by_name) > 0, by_name).otherwise(by_bang), F.array(F.lit(options.terms))))
