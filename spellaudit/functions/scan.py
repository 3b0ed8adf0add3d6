"""The line scanner: words of a line with their places, past URLs, escapes, colours, numbers and keys.

At each place the rules are tried in order; the first that fits is passed over, else a word is read, else a character
goes. That is how a search for one alternation of all rules goes through a line, so the scanner is one regular
expression. ``words`` searches in Spark's own column functions (places are summed up by batches of lines); ``scan_lines`` searches in
Python, where the names of the rules, directives or a key model are asked for. Both take their expression from ``pattern``.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spellaudit.functions.keys import CHANGES, KeyModel
from spellaudit.functions.words import normalized

LETTER, HEX = "[A-Za-z]", "[0-9A-Fa-f]"
CONTRACTION = r"(?:['\u2000-\u2fff](?!s(?![a-z]))[a-z]++)*+"
TITLE, LOWER = rf"[A-Z][a-z]++{CONTRACTION}", rf"[a-z](?:[a-z]++{CONTRACTION})?"
UPPER = r"[A-Z]+(?:(?![A-Za-z0-9_-])|(?=[A-Z][a-z]{2}))(?:'[A-Z]++(?![a-z]))?"
SCHEME = r"(?:https?://|s?ftp://|mailto:|//)"
USER = r"[A-Za-z0-9]++(?::[A-Za-z0-9]*+)?@"
#: An address goes without its last character; a name has a dot.
HOST = r"(?>(?:[0-9]++\.){3}[0-9]*(?=[0-9](?![0-9.]))|(?:[0-9]++\.){2}[0-9]++(?=\.(?![0-9]))|[A-Za-z0-9\\-]++(?:(?:\.[A-Za-z0-9\\-]++)++|(?=\.))|localhost)"


def _run(signs: str) -> str:
    """A run of signs and percent codes."""
    return rf"[{signs}]*+(?:%{HEX}{{2}}[{signs}]*+)*+"


REST = rf"(?::[0-9]++)?(?:/{_run(r'A-Za-z0-9=@!$&~\-/._\\')})?(?:\?{_run(r'A-Za-z0-9=!$\-/._\\&')})?(?:#{_run(r'A-Za-z0-9=!$&\-/.\\')})?"
URL = rf"{SCHEME}(?:{USER})?+{HOST}{REST}|(?!{SCHEME})(?:{USER}{HOST}|(?!-){HOST}(?=/)){REST}"
#: In order; each passes over what it matches.
EARLY = {
    "ansi": r"\\(?:e|033)\[[0-9]+(?:;[0-9]+)*+m",
    "escape": r"\\[A-Za-z]",
    "percent": r"%(?:[0-9][0-9A-Fa-f]|[A-Fa-f][0-9])",
    "colour": rf"#(?:{HEX}{{6}}|{HEX}{{3}})(?![0-9A-Za-z])",
    "hex": rf"0[xX]{HEX}++(?![0-9A-Za-z])",
    "url": URL,
    "key_format": r"SG\.[A-Za-z0-9_-]{22}\.[A-Za-z0-9_-]{43}(?![A-Za-z0-9_-])|prg-" + HEX + "{8}(?:-" + HEX + "{4}){3}-" + HEX + r"{12}|GTM-[A-Za-z0-9]{7}(?![A-Za-z0-9])|sha(?:1-[A-Za-z0-9+/=]{28}|256-[A-Za-z0-9+/=]{44}|384-[A-Za-z0-9+/=]{64}|512-[A-Za-z0-9+/=]{88})(?![A-Za-z0-9+/=])",
}
DATA_URI = r"data:[A-Za-z0-9/+.-]*;base64,[A-Za-z0-9+/]*+=*+(?![A-Za-z0-9])"
#: A span with letters and digits that change twice; what it must have besides is in ``is_key``.
SPAN = rf"(?=[A-Za-z0-9])(?=[A-Za-z0-9_/+-]*?{CHANGES})[A-Za-z0-9][A-Za-z0-9_/+-]*+=*+(?![A-Za-z0-9])"
LATE = {
    "leftover": r"[/%#\\0-9]",
    "repeated": r"(?P<r>[A-Za-z])(?P=r)++(?![A-Za-z])",
    "alphabet": "[aA][bB][cC]" + "".join(f"(?:[{c}{c.upper()}]" for c in "defghijklmnopqrstuvwxyz") + ")?" * 23 + "(?![A-Za-z])",
}
#: Signs with which every match starts, and letters after which comes nothing that a rule before ``LATE`` reads on from letters.
FIRST = r"[A-Za-z0-9%/#\\]"
LETTERS_ALONE = r"[A-Za-z]++(?:[.:]?(?![^ \t])|(?![0-9.:@\\/_+-]))"


def pattern(*, keys: bool = False, data_uris: bool = False, marker: str | None = None, on: bool = True, without: frozenset[str] = frozenset(), ahead: bool = False) -> str:
    """The scanner as an expression of named groups, a group a rule; ``word`` is a word between ASCII signs, other words have no group.

    ``without``: rules (or "upper" for such words) that are known to fail at the place. ``ahead``: looks at a place's sign and the letters there first, and
    tries no rule that they rule out; what is found is the same. That reads a run of letters again at each place, so it is not for long runs.
    """
    early = dict(EARLY)
    if data_uris:
        early["data_uri"] = DATA_URI
    if keys:
        early["key"] = SPAN
    named = lambda rules: [f"(?P<{name}>{rx})" for name, rx in rules.items() if name not in without]
    found = [f"(?!{LETTERS_ALONE})(?:{'|'.join(named(early))})"] if ahead else named(early)
    found += named(LATE)
    if on:
        word = "|".join((TITLE, *(() if "upper" in without else (UPPER,)), LOWER))
        found += [rf"(?<![^\x00-\x7F])(?P<word>(?>{word}))(?![^\x00-\x7F])", f"(?>{word})"]
    if ahead:
        found = [f"(?={FIRST})(?:{'|'.join(found)})"]
    if marker is not None:
        found = [f"(?P<stop>{re.escape(marker)}:disable-line)", f"(?P<turn>{re.escape(marker)}:{'disable' if on else 'enable'})", *found]
    return "|".join(found)


@lru_cache
def compiled(**options) -> re.Pattern:
    return re.compile(pattern(**options))


def is_key(span: str, model: KeyModel | None) -> bool:
    """Whether a span whose letters and digits change twice is a key."""
    if len(span) > 200:
        return True
    return model is not None and len(span) >= 6 and sum(c.isalpha() for c in span) >= 3 and model.is_key(span)


def kind_of(word: str) -> str:
    return "lower" if word[0].islower() else "title" if word[1:2].islower() else "upper"


#: Signs of runs within which rules look far ahead; from so many in a row on a line is stepped through, so that no run is read again at each place.
RUN_SIGNS, LONG_RUN = r"A-Za-z0-9_/+=.@:\\-", 500
_LONG = re.compile(rf"[{RUN_SIGNS}]{{{LONG_RUN}}}")
_HOST, _SCHEME = re.compile(HOST), re.compile(f"(?={SCHEME})")
_SPAN_RUN, _SPAN_END, _GROUP = re.compile(r"[A-Za-z0-9_/+-]++"), re.compile(r"=*+(?![A-Za-z0-9])"), re.compile(r"[A-Za-z]++|[0-9]++")
_NO_RULE, _CAPS, _LETTERS = re.compile(r"[^A-Za-z0-9%/#\\]++"), re.compile("[A-Z]++"), re.compile("[A-Za-z]++")


def _back(line: str, at: int, fits) -> int:
    while at and fits(line[at - 1]):
        at -= 1
    return at


def _plain(c: str) -> bool:
    return c.isascii() and c.isalnum()


def url_places(line: str) -> bytearray:
    """Marks the places where a URL may start: a scheme, what may stand before an @ that a host follows, and a name before a slash."""
    marks = bytearray(len(line))
    for m in _SCHEME.finditer(line):
        marks[m.start()] = 1
    at = line.find("@")
    while at >= 0:
        if _HOST.match(line, at + 1):
            own = _back(line, at, _plain)
            start = _back(line, own - 1, _plain) if own and line[own - 1] == ":" else own
            marks[start:at] = b"\1" * (at - start)
        at = line.find("@", at + 1)
    at = line.find("/")
    while at >= 0:
        start = _back(line, at, lambda c: _plain(c) or c in "\\.-")
        double = line.rfind("..", start, at)
        start = start if double < 0 else double + 2
        if at and line[at - 1] != "." and line.find(".", start, at) >= 0 or line.endswith("localhost", 0, at):
            marks[start:at] = b"\1" * (at - start)
        at = line.find("/", at + 1)
    return marks


def key_places(line: str) -> bytearray:
    """Marks the places from which the rest of a run changes twice between letters and digits; nothing in a run that goes on with a letter or digit."""
    marks = bytearray(len(line))
    for m in _SPAN_RUN.finditer(line):
        if not _SPAN_END.match(line, m.end()):
            continue
        last = before = None
        kind = where = None
        for g in _GROUP.finditer(line, m.start(), m.end()):
            digit = g.group()[0].isdigit()
            if kind is not None and digit != kind:
                before, last = last, where
            kind, where = digit, g.end() - 1
        if before is not None:
            marks[m.start() : before + 1] = b"\1" * (before + 1 - m.start())
    return marks


class _Steps:
    """Goes through a line with long runs place by place: what would read a run to its end is tried only where it may fit."""

    def __init__(self, line: str, skip_keys: bool):
        self.line, self.urls = line, url_places(line)
        self.keys = key_places(line) if skip_keys else bytearray(len(line))
        self.no_upper = self.no_repeat = 0

    def next(self, at: int, keys: bool, of: dict) -> re.Match | None:
        line, n = self.line, len(self.line)
        while at < n:
            # no rule starts with such a sign, but a directive may
            if of["marker"] is None and (m := _NO_RULE.match(line, at)):
                at, keys = m.end(), True
                continue
            skip = [rule for rule, out in (("url", not self.urls[at]), ("upper", at < self.no_upper), ("repeated", at < self.no_repeat)) if out]
            if m := compiled(keys=keys and bool(self.keys[at]), without=frozenset(skip), **of).match(line, at):
                return m
            if at >= self.no_upper and (caps := _CAPS.match(line, at)):
                # what fails here fails in all of the run
                self.no_upper = caps.end()
                end = _LETTERS.match(line, at).end()
                self.no_repeat = max(at, _back(line, end, lambda c: c == line[end - 1]))
            at += 1
            keys = True
        return None


def scan(line: str, *, min_length: int = 3, model: KeyModel | None = None, skip_keys: bool = True, marker: str | None = None, skip_data_uris: bool = False, skips: bool = False) -> Iterator[tuple[int, str, str, str]]:
    """Place (in characters), text, case kind and kind ("word", or the rule's name) in order."""
    marker = marker if marker and marker + ":" in line else None
    on, at = True, 0
    of = {"data_uris": skip_data_uris, "marker": marker}
    steps = _Steps(line, skip_keys) if _LONG.search(line) else None
    if steps is None:
        of["ahead"] = True
    while m := compiled(keys=skip_keys, on=on, **of).search(line, at) if steps is None else steps.next(at, skip_keys, of | {"on": on}):
        if m.lastgroup == "key" and not is_key(m.group(), model):
            # no key: the rules after it come next, at the same place
            start = m.start()
            m = compiled(keys=False, on=on, **of).match(line, start) if steps is None else steps.next(start, False, of | {"on": on})
            if m is None or m.lastgroup == "key":
                at = start + 1 if m is None else m.start()
                continue
        name, at = m.lastgroup, m.end()
        if name == "stop":
            return
        if name == "turn":
            on = not on
        elif name == "word":
            if len(m.group()) >= min_length or len(m.group().encode()) >= min_length:
                yield m.start(), m.group(), kind_of(m.group()), "word"
        elif skips and name:
            yield m.start(), m.group(), "other", name


#: Rows that a task holds before it sends them on.
ROWS = 20_000


def scan_lines(numbered: DataFrame, *, keep: tuple[str, ...] = (), **options) -> DataFrame:
    """path, line_no, col (bytes from 0), text, case_kind and kind for each word (skips=True: and each skip) of the lines; ``keep``: columns that go along."""
    kinds = dict(numbered.dtypes)
    columns = ["path", "line_no", "col", "text", "case_kind", "kind", *keep]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for path, no, line, *more in zip(frame["path"], frame["line_no"], frame["line"], *(frame[c] for c in keep), strict=True):
                ascii_only, before, size = line.isascii(), 0, 0
                for at, text, case, kind in scan(line, **options):
                    # bytes since the last word, as a line may be long
                    size += at - before if ascii_only else len(line[before:at].encode())
                    before = at
                    rows.append((path, no, size, text, case, kind, *more))
                    # lines of a batch may have very many words: they leave in parts
                    if len(rows) >= ROWS:
                        yield pd.DataFrame(rows, columns=columns)
                        rows = []
            yield pd.DataFrame(rows, columns=columns)

    return numbered.select("path", "line_no", "line", *keep).filter("line rlike '[A-Za-z]'").mapInPandas(run, "path string, line_no int, col int, text string, case_kind string, kind string" + "".join(f", {c} {kinds[c]}" for c in keep))


def case_kind(word: Column) -> Column:
    return F.when(word.rlike("^[a-z]"), "lower").when(word.rlike("^.[a-z]"), "title").otherwise("upper")


#: What most pieces between blanks are: a word that every rule leaves alone, and a sign after it. No match reaches over a blank, so other pieces are read by themselves.
SIMPLE = r"(?<![^ \t])(?![aA][bB][cC]|([A-Za-z])\1)[A-Za-z][a-z]++(?=[.,;:!?]?(?![^ \t]))"
#: For distinct pieces at once: signs after a word that no rule reads on to from letters, words that are none of the rules', and pieces whose words all touch a letter
#: that is not ASCII, so that none counts.
SIGNS = ".,;:!?$&*#%"
_SIMPLE, _RULED = "^[A-Za-z][a-z]+$", f"^(?:[aA][bB][cC]|{'|'.join(c + c + '|' + c.upper() * 2 for c in 'abcdefghijklmnopqrstuvwxyz')})"
_FOREIGN = r"^(?:[A-Z]?[a-z]*[\x{80}-\x{1fff}])+[A-Z]?[a-z]*[.,;:!?]?$"
OTHERS = rf"(?<![^ \t])(?!{SIMPLE})[^ \t]++"
#: Words that leave a task in one batch, with their places.
SENT = 100_000


def _java(**options) -> str:
    """The expression for Spark's functions: group 1 is the letter that is repeated, group 2 the word."""
    return re.sub(r"\(\?P<(?!r>|word>)\w+>", "(?:", pattern(**options)).replace("(?P<", "(?<").replace("(?P=r)", r"\k<r>")


def _with_places(lines_: DataFrame, rx: str, keep: tuple[str, ...], min_length: int) -> DataFrame:
    """path, line_no, text and col (bytes from 0) of the words.

    With what no rule takes as a last choice every character is in a match, and the matches make up the line. Each is written down
    again, a word with a NUL before and after its copy (no line has a NUL), so that cutting at NULs gives, in turn, all that ends with a word, and the word;
    the running sum of the lengths of the former, taken for a batch of lines at once, are the words' ends.
    """
    simple = SIMPLE.replace(r"[A-Za-z][a-z]++", r"(?<simple>[A-Za-z][a-z]++)")
    tiles = rf"{simple}|[^A-Za-z0-9%/#\\]++|{rx}|[A-Z]"
    marked = F.replace(F.regexp_replace("line", F.lit(tiles), F.lit("$0\x00${simple}${word}\x00")), F.lit("\x00\x00"), F.lit(""))
    cut = lines_.select("path", "line_no", *keep, F.split(marked, "\x00").alias("_cut")).filter("size(_cut) > 1")
    kinds = dict(lines_.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pieces = batch.column("_cut")
            n = pc.list_value_length(pieces).to_numpy().astype(np.int64)
            flat = pieces.flatten()
            size = pc.binary_length(flat).to_numpy().astype(np.int64)
            count = n // 2
            line = np.repeat(np.arange(len(n)), count)
            first = np.cumsum(count) - count
            at = (np.cumsum(n) - n)[line] + 2 * (np.arange(len(line)) - first[line])
            ends = np.append(0, np.cumsum(size[at]))
            length = size[at + 1]
            col = ends[1:] - ends[first[line]] - length
            kept = np.flatnonzero(length >= min_length)
            for start in range(0, len(kept), SENT):
                some = kept[start : start + SENT]
                own = pa.array(line[some])
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(c).take(own) for c in ("path", "line_no", *keep)), pa.array(col[some].astype(np.int32)), flat.take(pa.array(at[some] + 1))],
                    ["path", "line_no", *keep, "col", "text"],
                )

    more = "".join(f"{c} {kinds[c]}, " for c in keep)
    return cut.mapInArrow(run, f"path string, line_no int, {more}col int, text string")


def words(numbered: DataFrame, *, min_length: int = 3, model: KeyModel | None = None, skip_keys: bool = True, marker: str | None = None, skip_data_uris: bool = False, places: bool = False, keep: tuple[str, ...] = ()) -> DataFrame:
    """path, line_no, text and case_kind of the words of the lines; places: also col, the place in bytes from 0; ``keep``: columns that go along.

    Lines go through column functions, but for those with a span that the key rule must look at, with directives or with long runs.
    """
    line = F.col("line")
    long = F.length(line) > 200
    # runs are tried from their first sign alone
    run = lambda signs, n: line.rlike(f"(?<![{signs}])[{signs}]{{{n}}}")
    hard = long & run(RUN_SIGNS, LONG_RUN)
    if skip_keys:
        hard = hard | (long & run("A-Za-z0-9_/+=-", 201) if model is None else line.rlike(CHANGES))
    if marker is not None:
        hard = hard | line.contains(marker + ":")
    rx = _java(data_uris=skip_data_uris, ahead=True)
    easy = numbered.filter(~hard & line.rlike("[A-Za-z]"))
    if places:
        easy = _with_places(easy, rx, keep, min_length)
    else:
        others = F.array_join(F.regexp_extract_all("line", F.lit(OTHERS), F.lit(0)), " ")
        found = F.concat(F.regexp_extract_all("line", F.lit(SIMPLE), F.lit(0)), F.regexp_extract_all(others, F.lit(rx), F.lit(2)))
        easy = easy.select("path", "line_no", *keep, F.explode(found).alias("text"))
    easy = easy.filter(F.octet_length("text") >= min_length)
    columns = ["path", "line_no", *(["col"] if places else []), "text", "case_kind", *keep]
    easy = easy.withColumn("case_kind", case_kind(F.col("text"))).select(columns)
    rest = scan_lines(numbered.filter(hard), min_length=min_length, model=model, skip_keys=skip_keys, marker=marker, skip_data_uris=skip_data_uris, keep=keep)
    return easy.unionByName(rest.select(columns))


#: Bytes of texts whose words are counted together, and pieces that a task remembers the words of.
COUNTED_BYTES, KNOWN_PIECES = 1 << 23, 1_000_000
CASES = {"lower": 1, "title": 2, "upper": 4}


def _sized(batch: pa.RecordBatch, at: int) -> Iterator[pa.RecordBatch]:
    """The batch in parts of some COUNTED_BYTES of its column ``at``, a row at least."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(at)), 0).to_numpy().astype(np.int64))
    start = 0
    while start < batch.num_rows:
        before = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, before + COUNTED_BYTES, "right")))
        yield batch.slice(start, stop - start)
        start = stop


class _Totals:
    """What a task has counted of each word; it leaves when there are very many."""

    def __init__(self):
        self.number: dict[str, int] = {}
        self.sums = np.zeros((3, 1 << 16), np.int64)

    def add(self, forms: list[str], word: np.ndarray, cases: np.ndarray, n: np.ndarray) -> Iterator[pa.RecordBatch]:
        """Each row of ``word`` is a text with that word of ``forms``."""
        at = np.fromiter((self.number.setdefault(w, len(self.number)) for w in forms), np.int64, len(forms))
        while len(self.number) > self.sums.shape[1]:
            self.sums = np.concatenate([self.sums, np.zeros_like(self.sums)], 1)
        for bit in CASES.values():
            own = np.bincount(word[cases & bit > 0], minlength=len(forms)) > 0
            self.sums[0, at[own]] |= bit
        self.sums[1, at] += np.bincount(word, minlength=len(forms))
        self.sums[2, at] += np.bincount(word, weights=n, minlength=len(forms)).astype(np.int64)
        if len(self.number) >= KNOWN_PIECES:
            yield from self.rows()
            self.__init__()

    def rows(self) -> Iterator[pa.RecordBatch]:
        names = list(self.number)
        for start in range(0, len(names), SENT):
            some = names[start : start + SENT]
            cases, files, n = self.sums[:, start : start + len(some)]
            yield pa.RecordBatch.from_arrays([pa.array(some, pa.string()), pa.array(cases.astype(np.int32)), pa.array(files), pa.array(n)], ["norm", "cases", "files", "n"])


def counted_words(texts: DataFrame, keep: tuple[str, ...], column: str, *, exact: bool = False, marker: str | None = None, **options) -> DataFrame:
    """The columns ``keep``, norm, cases (a bit for each of ``CASES`` that it has there) and n for the words of each row's text; ``exact``: text in place of norm and cases.
    Without ``keep``: norm, cases, files (the rows that have it) and n for the words of all texts, summed up by a task, to be summed up over tasks.

    A text may be a line or all lines of a file. No match reaches over a blank or a line's end, so texts are cut there, each distinct piece is
    scanned once by a task, and what is counted are numbers of pieces. Lines with directives are scanned as they are.
    """
    kinds = dict(texts.dtypes)
    named = "text" if exact else "norm"
    least = options.get("min_length", 3)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, tuple[tuple[str, int], ...]] = {}
        total = _Totals()

        def words_of(piece: str, marked: bool = False) -> tuple[tuple[str, int], ...]:
            found = ((text, case) for _, text, case, _ in scan(piece, marker=marker if marked else None, **options))
            return tuple((text, 0) if exact else (normalized(text), CASES[case]) for text, case in found)

        for batch in batches:
            for part in _sized(batch, len(keep)):
                text = pc.fill_null(part.column(len(keep)), "")
                if marker is not None:
                    directed = pc.match_substring(text, marker + ":")
                    marked = np.flatnonzero(directed.to_numpy(zero_copy_only=False))
                    whole = text.take(pa.array(marked)).to_pylist()
                    text = pc.if_else(directed, "", text)
                else:
                    marked, whole = np.empty(0, np.int64), []
                cut = pc.split_pattern(pc.replace_substring(pc.replace_substring(text, "\t", " "), "\n", " "), " ")
                row = np.repeat(np.arange(part.num_rows), pc.list_value_length(cut).to_numpy())
                pieces = cut.flatten().dictionary_encode()
                bare = pc.ascii_rtrim(pieces.dictionary, characters=SIGNS)
                simple = pc.and_not(pc.match_substring_regex(bare, _SIMPLE), pc.match_substring_regex(bare, _RULED))
                others = pc.invert(pc.or_(simple, pc.match_substring_regex(pieces.dictionary, _FOREIGN))).to_numpy(zero_copy_only=False)
                chosen = np.flatnonzero(pc.and_(simple, pc.greater_equal(pc.binary_length(bare), least)).to_numpy(zero_copy_only=False))
                bare = bare.take(pa.array(chosen))
                told = (bare if exact else pc.ascii_lower(bare)).dictionary_encode()
                title = pc.match_substring_regex(bare, "^[A-Z]").to_numpy(zero_copy_only=False)
                forms = told.dictionary.to_pylist()
                seen = {w: i for i, w in enumerate(forms)}
                at, where, of, case = np.flatnonzero(others), [], [], []
                every = zip(at.tolist(), pieces.dictionary.take(pa.array(at)).to_pylist(), strict=True)
                for number, piece in every:
                    found = known.get(piece)
                    if found is None:
                        if len(known) >= KNOWN_PIECES:
                            known.clear()
                        found = known[piece] = words_of(piece)
                    for word, bit in found:
                        where.append(number)
                        of.append(seen.setdefault(word, len(seen)))
                        case.append(bit)
                own = len(pieces.dictionary)
                for number, line in enumerate(whole, own):
                    for one in line.split("\n"):
                        for word, bit in words_of(one, True):
                            where.append(number)
                            of.append(seen.setdefault(word, len(seen)))
                            case.append(bit)
                if not seen:
                    continue
                forms = list(seen)
                # the words of each piece, one after the other
                where = np.concatenate([chosen, np.array(where, np.int64)])
                order = np.argsort(where, kind="stable")
                of = np.concatenate([told.indices.to_numpy().astype(np.int64), np.array(of, np.int64)])[order]
                bits = np.concatenate([np.zeros(len(chosen), np.int32) if exact else np.where(title, CASES["title"], CASES["lower"]), np.array(case, np.int32)])[order]
                begin = np.append(0, np.cumsum(np.bincount(where, minlength=own + len(whole))))
                at = np.append(pieces.indices.to_numpy(), np.arange(own, own + len(whole)))
                row = np.append(row, marked)
                many = begin[at + 1] - begin[at]
                spot = np.repeat(begin[at] - (np.cumsum(many) - many), many) + np.arange(many.sum())
                key, back, n = np.unique(np.repeat(row, many) * len(forms) + of[spot], return_inverse=True, return_counts=True)
                cases = np.zeros(len(key), np.int32)
                for bit in () if exact else CASES.values():
                    cases[back[bits[spot] == bit]] |= bit
                if not keep:
                    yield from total.add(forms, key % len(forms), cases, n)
                    continue
                every = pa.array(forms, pa.string())
                for start in range(0, len(key), SENT):
                    some = slice(start, start + SENT)
                    line = pa.array(key[some] // len(forms))
                    kept = [part.column(i).take(line) for i in range(len(keep))]
                    more = [] if exact else [pa.array(cases[some])]
                    yield pa.RecordBatch.from_arrays([*kept, every.take(pa.array(key[some] % len(forms))), *more, pa.array(n[some])], [*keep, named, *(() if exact else ("cases",)), "n"])
        yield from total.rows()

    if not keep:
        return texts.select(column).filter(F.col(column).rlike("[A-Za-z]")).mapInArrow(run, "norm string, cases int, files long, n long")
    schema = "".join(f"{c} {kinds[c]}, " for c in keep) + f"{named} string, " + ("" if exact else "cases int, ") + "n long"
    return texts.select(*keep, column).filter(F.col(column).rlike("[A-Za-z]")).mapInArrow(run, schema)
