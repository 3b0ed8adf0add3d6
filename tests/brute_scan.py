"""The scanner rule by rule and character by character, to test the one expression against."""

import re


CONTRACTION = r"(?:['\u2000-\u2fff](?!s(?![a-z]))[a-z]+)*"
TITLE = re.compile(r"[A-Z][a-z]+" + CONTRACTION)
LOWER = re.compile(r"[a-z](?:[a-z]+" + CONTRACTION + ")?")
UPPER = re.compile(r"[A-Z]+(?:(?![A-Za-z0-9_-])|(?=[A-Z][a-z]{2}))(?:'[A-Z]++(?![a-z]))?")
#: In order; each passes over what it matches.
EARLY = [
    ("ansi", re.compile(r"\\(?:e|033)\[\d+(?:;\d+)*m", re.A)),
    ("escape", re.compile(r"\\[A-Za-z]")),
    ("percent", re.compile(r"%(?:\d[0-9A-Fa-f]|[A-Fa-f]\d)", re.A)),
    ("colour", re.compile(r"#(?:[0-9A-Fa-f]{6}|[0-9A-Fa-f]{3})(?![0-9A-Za-z])")),
    ("hex", re.compile(r"0[xX][0-9A-Fa-f]+(?![0-9A-Za-z])")),
]
KNOWN = [
    ("key_format", re.compile(r"SG\.[A-Za-z0-9_-]{22}\.[A-Za-z0-9_-]{43}(?![A-Za-z0-9_-])")),
    ("key_format", re.compile(r"prg-[0-9A-Fa-f]{8}(?:-[0-9A-Fa-f]{4}){3}-[0-9A-Fa-f]{12}")),
    ("key_format", re.compile(r"GTM-[A-Za-z0-9]{7}(?![A-Za-z0-9])")),
    *(("key_format", re.compile(rf"sha{bits}-[A-Za-z0-9+/=]{{{n}}}(?![A-Za-z0-9+/=])")) for bits, n in ((1, 28), (256, 44), (384, 64), (512, 88))),
]
DATA_URI = re.compile(r"data:[A-Za-z0-9/+.-]*;base64,[A-Za-z0-9+/]*+=*+(?![A-Za-z0-9])")
SPAN = re.compile(r"[A-Za-z0-9][A-Za-z0-9_/+-]*+=*+(?![A-Za-z0-9])")
CHANGES = re.compile(r"[A-Za-z]\d+[A-Za-z]|\d[A-Za-z]+\d", re.A)
LATE = [
    ("leftover", re.compile(r"[/%#\\0-9]")),
    ("repeated", re.compile(r"([A-Za-z])\1+(?![A-Za-z])")),
    ("alphabet", re.compile("(?i:" + "|".join("abcdefghijklmnopqrstuvwxyz"[:n] for n in range(26, 2, -1)) + ")(?![A-Za-z])")),
]
SCHEME = re.compile(r"https://|http://|sftp://|ftp://|mailto:|//")
USER = re.compile(r"[A-Za-z0-9]+(?::[A-Za-z0-9]*)?@")
ADDRESS = re.compile(r"(?:\d+\.){3}(?:\d++(?!\.)|(?!\d))", re.A)
NAME = re.compile(r"[A-Za-z0-9\\-]+(?:\.[A-Za-z0-9\\-]+)*\.?")
REST = re.compile(r"(?::\d+)?(?:/(?:[A-Za-z0-9=@!$&~\-/._\\]|%[0-9A-Fa-f]{2})*)?(?:\?(?:[A-Za-z0-9=!$\-/._\\&]|%[0-9A-Fa-f]{2})*)?(?:#(?:[A-Za-z0-9=!$&\-/.\\]|%[0-9A-Fa-f]{2})*)?", re.A)
#: Without any of these no URL starts on a line.
URL_SIGNS = re.compile(r"//|mailto:|\.|localhost")
WORDY = re.compile(r"[A-Za-z0-9%/#\\]")


def host_end(line: str, at: int) -> int:
    """Where a host that starts here ends, or ``at``; an address ends before its last character."""
    if m := ADDRESS.match(line, at):
        return m.end() - 1
    m = NAME.match(line, at)
    if m and "." in m.group():
        end = m.end() - m.group().endswith(".")
        if end > at:
            return end
    return at + 9 if line.startswith("localhost", at) else at


def url_end(line: str, at: int) -> int:
    """Where a URL that starts here ends, or ``at``."""
    if m := SCHEME.match(line, at):
        start = m.end()
        if u := USER.match(line, start):
            start = u.end()
        end = host_end(line, start)
        return REST.match(line, end).end() if end > start else at
    if u := USER.match(line, at):
        end = host_end(line, u.end())
        if end > u.end():
            return REST.match(line, end).end()
    end = host_end(line, at)
    return REST.match(line, end).end() if end > at and line.startswith("/", end) else at


def is_key(span: str, model) -> bool:
    plain = re.sub("[-_/+=]", "", span)
    if not CHANGES.search(plain) or len(span) < 6:
        return False
    if len(span) > 200:
        return True
    return sum(c.isalpha() for c in span) >= 3 and model is not None and model.is_key(span)


def scan(line: str, *, min_length: int = 3, model = None, skip_keys: bool = True, marker: str | None = None, skip_data_uris: bool = False, skips: bool = False) :
    """Place (in characters), text, case kind and kind ("word", or the rule's name) in order."""
    at, n, on = 0, len(line), True
    urls = URL_SIGNS.search(line) is not None
    directives = marker is not None and marker + ":" in line
    while at < n:
        if directives:
            if line.startswith(f"{marker}:disable-line", at):
                return
            word = f"{marker}:disable" if on else f"{marker}:enable"
            if line.startswith(word, at):
                on, at = not on, at + len(word)
                continue
        name, end = "", at
        if not WORDY.match(line, at):
            at += 1
            continue
        for rule, rx in EARLY:
            if m := rx.match(line, at):
                name, end = rule, m.end()
                break
        if not name and urls and (end := url_end(line, at)) > at:
            name = "url"
        if not name:
            end = at
            for rule, rx in KNOWN:
                if m := rx.match(line, at):
                    name, end = rule, m.end()
                    break
        if not name and skip_data_uris and (m := DATA_URI.match(line, at)):
            name, end = "data_uri", m.end()
        if not name and skip_keys and (m := SPAN.match(line, at)) and is_key(m.group(), model):
            name, end = "key", m.end()
        if not name:
            for rule, rx in LATE:
                if m := rx.match(line, at):
                    name, end = rule, m.end()
                    break
        if name:
            if skips:
                yield at, line[at:end], "other", name
            at = end
            continue
        if not on:
            at += 1
            continue
        for kind, rx in (("title", TITLE), ("upper", UPPER), ("lower", LOWER)):
            if m := rx.match(line, at):
                end = m.end()
                clean = (at == 0 or line[at - 1].isascii()) and (end == n or line[end].isascii())
                if clean and len(m.group().encode()) >= min_length:
                    yield at, m.group(), kind, "word"
                at = end
                break
        else:
            at += 1
