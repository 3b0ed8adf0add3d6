"""SQL that gives the rows of the queries: the scanner once more, written for an engine without looking around.

A line is cut at its blanks, which no rule passes. Each distinct piece is read from its start by a recursive query that
takes off what the first rule fits, and gives the words with their places.
"""

from __future__ import annotations

LEAST_FILES = 5

DOCS = "docs AS (SELECT coalesce(lang,'-') || '/' || coalesce(source,'-') || '/' || doc_id || '.txt' AS path, text AS content FROM documents)"
LINES = f"{DOCS}, lines AS (SELECT path, CAST(generate_subscripts(string_split(content, chr(10)), 1) AS INTEGER) AS line_no, unnest(string_split(content, chr(10))) AS line FROM docs WHERE content NOT LIKE '%' || chr(0) || '%')"

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_NAME = r"'^[A-Za-z0-9\\-]+(\.[A-Za-z0-9\\-]+)*\.?'"
_CONTRACTION = r"([''\x{2000}-\x{2fff}]([a-rt-z][a-z]*|s[a-z]+))*"


def _host(x: str) -> str:
    return rf"""CASE WHEN regexp_matches({x}, '^([0-9]+\.){{3}}[0-9]+([^.0-9]|$)') THEN length(regexp_extract({x}, '^([0-9]+\.){{3}}[0-9]+')) - 1
      WHEN regexp_matches({x}, '^([0-9]+\.){{3}}([^0-9]|$)') THEN length(regexp_extract({x}, '^([0-9]+\.){{3}}')) - 1
      WHEN contains(regexp_extract({x}, {_NAME}), '.') THEN length(rtrim(regexp_extract({x}, {_NAME}), '.'))
      WHEN starts_with({x}, 'localhost') THEN 9 ELSE 0 END"""


def _rest(x: str) -> str:
    return rf"length(regexp_extract({x}, '^(:[0-9]+)?(/([A-Za-z0-9=@!$&~\-/._\\]|%[0-9A-Fa-f]{{2}})*)?(\?([A-Za-z0-9=!$\-/._\\&]|%[0-9A-Fa-f]{{2}})*)?(#([A-Za-z0-9=!$&\-/.\\]|%[0-9A-Fa-f]{{2}})*)?'))"


def _at(rx: str, group: int = 0) -> str:
    """The length of what an expression fits at the start of ``rest``; 0: nothing."""
    return f"length(regexp_extract(rest, '^{rx}', {group}))"


_SKIPS = [
    _at(r"[^A-Za-z0-9%/#\\]+"),
    _at(r"\\(e|033)\[[0-9]+(;[0-9]+)*m"),
    _at(r"\\[A-Za-z]"),
    _at("%([0-9][0-9A-Fa-f]|[A-Fa-f][0-9])"),
    _at("(#([0-9A-Fa-f]{6}|[0-9A-Fa-f]{3}))([^0-9A-Za-z]|$)", 1),
    _at("(0[xX][0-9A-Fa-f]+)([^0-9A-Za-z]|$)", 1),
    "url",
    _at(r"(SG\.[A-Za-z0-9_-]{22}\.[A-Za-z0-9_-]{43})([^A-Za-z0-9_-]|$)", 1),
    _at("prg-[0-9A-Fa-f]{8}(-[0-9A-Fa-f]{4}){3}-[0-9A-Fa-f]{12}"),
    _at("(GTM-[A-Za-z0-9]{7})([^A-Za-z0-9]|$)", 1),
    *(_at(f"(sha{bits}-[A-Za-z0-9+/=]{{{n}}})([^A-Za-z0-9+/=]|$)", 1) for bits, n in ((1, 28), (256, 44), (384, 64), (512, 88))),
    "CASE WHEN length(span) > 200 AND NOT regexp_matches(substr(rest, length(span) + 1, 1), '[A-Za-z0-9]') AND regexp_matches(regexp_replace(span, '[-_/+=]', '', 'g'), '[A-Za-z][0-9]+[A-Za-z]|[0-9][A-Za-z]+[0-9]') THEN length(span) ELSE 0 END",
    _at(r"[/%#\\0-9]"),
    "CASE WHEN length(run) > 1 AND replace(run, left(run, 1), '') = '' THEN length(run) ELSE 0 END",
    f"CASE WHEN length(run) > 2 AND starts_with('{_LOWER}', lower(run)) THEN length(run) ELSE 0 END",
]
_CAPS = f"""CASE WHEN caps = 0 THEN 0
      WHEN NOT regexp_matches(substr(rest, caps + 1, 1), '[A-Za-z0-9_-]') THEN caps + length(regexp_extract(substr(rest, caps + 1), '^(''[A-Z]+)([^A-Za-z]|$)', 1))
      WHEN caps > 1 AND regexp_matches(substr(rest, caps + 1), '^[a-z]{{2}}') THEN caps - 1 ELSE 0 END"""

#: words: the words of each distinct piece, with places in characters and bytes from the piece's start.
_WORDS = rf"""
pieces AS (SELECT path, line_no, piece, sum(length(piece) + 1) OVER w - length(piece) - 1 AS char_at, sum(strlen(piece) + 1) OVER w - strlen(piece) - 1 AS byte_at
  FROM (SELECT path, line_no, unnest(string_split(line, ' ')) AS piece, generate_subscripts(string_split(line, ' '), 1) AS i FROM lines)
  WINDOW w AS (PARTITION BY path, line_no ORDER BY i)),
steps AS (
  SELECT piece, piece AS rest, '' AS before, 0 AS chars, 0 AS bytes, '' AS word, 0 AS n FROM (SELECT DISTINCT piece FROM pieces WHERE regexp_matches(piece, '[A-Za-z]'))
  UNION ALL
  SELECT piece, substr(rest, taken + 1), right(left(rest, taken), 1), chars + n, bytes + strlen(left(piece, chars + n)) - strlen(left(piece, chars)),
    CASE WHEN skip = 0 AND size > 0 AND coalesce(unicode(nullif(before, '')), 0) < 128 AND coalesce(unicode(nullif(substr(rest, taken + 1, 1), '')), 0) < 128 AND strlen(left(rest, size)) >= 3 THEN left(rest, size) ELSE '' END, taken
  FROM (SELECT *, CASE WHEN skip > 0 THEN skip WHEN size > 0 THEN size ELSE 1 END AS taken
    FROM (SELECT *, coalesce({", ".join(f"nullif({x}, 0)" for x in _SKIPS)}, 0) AS skip,
        CASE WHEN title > 0 THEN title WHEN caps > 0 THEN {_CAPS} ELSE lower_ END AS size
      FROM (SELECT *, CASE WHEN scheme <> '' THEN CASE WHEN h1 > 0 THEN length(scheme) + length(who) + h1 + {_rest("substr(target, h1 + 1)")} ELSE 0 END
            WHEN who <> '' AND h1 > 0 THEN length(who) + h1 + {_rest("substr(target, h1 + 1)")}
            WHEN h0 > 0 AND NOT starts_with(rest, '-') AND substr(rest, h0 + 1, 1) = '/' THEN h0 + {_rest("substr(rest, h0 + 1)")} ELSE 0 END AS url
        FROM (SELECT *, {_host("target")} AS h1, {_host("rest")} AS h0
          FROM (SELECT *, substr(rest, length(scheme) + length(who) + 1) AS target
            FROM (SELECT *, regexp_extract(substr(rest, length(scheme) + 1), '^[A-Za-z0-9]+(:[A-Za-z0-9]*)?@') AS who
              FROM (SELECT *, regexp_extract(rest, '^(https?://|s?ftp://|mailto:|//)') AS scheme, regexp_extract(rest, '^[A-Za-z]+') AS run, length(regexp_extract(rest, '^[A-Z]+')) AS caps,
                  regexp_extract(rest, '^[A-Za-z0-9][A-Za-z0-9_/+-]*=*') AS span, length(regexp_extract(rest, '^[A-Z][a-z]+{_CONTRACTION}')) AS title, length(regexp_extract(rest, '^[a-z]([a-z]+{_CONTRACTION})?')) AS lower_
                FROM steps WHERE rest <> '')))))))),
words AS (SELECT piece, word, chars, bytes FROM steps WHERE word <> ''),
tokens AS (SELECT path, line_no, char_at + chars AS chars, CAST(byte_at + bytes AS INTEGER) AS col, word AS text, translate(replace(replace(regexp_replace(word, '''$', ''), '‘', ''''), '’', ''''), '{_UPPER}', '{_LOWER}') AS norm FROM pieces JOIN words USING (piece))"""

TOKENS = f"RECURSIVE {LINES},{_WORDS}"
LEXICON = f"{TOKENS}, lexicon AS (SELECT norm AS word, count(DISTINCT path) AS files FROM tokens GROUP BY 1 HAVING count(DISTINCT path) >= {LEAST_FILES})"
MISSES = f"{LEXICON}, misses AS (SELECT t.* FROM tokens t ANTI JOIN lexicon l ON t.norm = l.word)"
PAGES = "pg AS (SELECT regexp_replace(regexp_replace(url, '^https?://', ''), '[?#].*$', '') || '/' || page_id || ['.html','.rb','.js','.png','.css'][page_id % 5 + 1] AS path, html AS content FROM pages)"
SPANS = f"{LINES}, runs AS (SELECT path, line_no, unnest(regexp_extract_all(line, '[A-Za-z0-9][A-Za-z0-9_/+-]*=*')) AS span FROM lines), spans AS (SELECT * FROM runs WHERE regexp_matches(regexp_replace(span, '[-_/+=]', '', 'g'), '[A-Za-z][0-9]+[A-Za-z]|[0-9][A-Za-z]+[0-9]') AND length(span) >= 6 AND (length(span) > 200 OR length(regexp_replace(span, '[^A-Za-z]', '', 'g')) >= 3))"

_RUNS = "|".join(c * 3 for c in _UPPER + _LOWER)
_PLAIN = f"{LINES}, plain AS (SELECT * FROM lines WHERE regexp_full_match(line, '[A-Za-z ,.]*') AND NOT regexp_matches(line, '{_RUNS}|[A-Z]{{2}}|[aA][bB][cC]')), tokens AS (SELECT * FROM (SELECT path, line_no, unnest(regexp_extract_all(line, '[A-Z]?[a-z]+')) AS text FROM plain) WHERE length(text) >= 3)"

#: Columns of the letters' differences, and the chunks of a span.
FEATURE_NAMES = {"+": "plus", "-": "minus", "_": "underscore", "/": "slash", "A": "upper_a", "z": "lower_z", "Z": "upper_z", "q": "lower_q", "Q": "upper_q", "X": "upper_x", "x": "lower_x"}
_CHUNKS = {"title": "[A-Z][a-z]+", "lower": "[a-z]+", "upper": "[A-Z]+", "alpha": "[A-Za-z]+", "alnum": "[A-Za-z0-9]+", "digit": "[0-9]+"}

#: A step of the greedy matching of a's letters with b's free ones, the nearest first from the left; a letter taken is marked.
_SPOT = "coalesce(list_filter(range(greatest(1, i - reach), least(length(b), i + reach) + 1), lambda j: substr(s.free, j, 1) = substr(a, i, 1))[1], 0)"
_MATCHED = f"CASE WHEN {_SPOT} = 0 THEN s ELSE {{'free': left(s.free, {_SPOT} - 1) || chr(1) || substr(s.free, {_SPOT} + 1), 'found': s.found || substr(a, i, 1)}} END"
#: What the queries' rules leave.
_KEPT = r"NOT (path LIKE 'en/%' OR regexp_matches(path, '/src1[^/]/') OR regexp_full_match(path, 'de/src2/[^/]*\.txt'))"
#: The words that stand for the directives' marker and actions.
ON, OFF, ONE = " and ", " the ", " with "

SQL = {
    "line_split": f"WITH {LINES} SELECT path, line_no, line FROM lines",
    "plain_words": f"WITH {_PLAIN} SELECT path, line_no, text, count(*) AS n FROM tokens GROUP BY ALL",
    "scanned_plain_words": f"WITH {_PLAIN} SELECT path, line_no, text, count(*) AS n FROM tokens GROUP BY ALL",
    "all_lines_words": f"WITH {TOKENS} SELECT path, line_no, text, count(*) AS n FROM tokens GROUP BY ALL",
    "word_places": f"WITH {TOKENS} SELECT path, line_no, col, text FROM tokens",
    "normalized_vocab": f"WITH {TOKENS} SELECT DISTINCT norm FROM tokens",
    "derived_lexicon": f"WITH {LEXICON} SELECT word, files FROM lexicon",
    "unknown_words": f"WITH {MISSES} SELECT norm, count(*) AS occurrences, count(DISTINCT path) AS files FROM misses GROUP BY norm",
    "miss_summary": f"WITH {MISSES} SELECT (SELECT count(*) FROM docs) AS files_checked, (SELECT count(*) FROM misses) AS misses_found",
    "miss_by_path": f"WITH {MISSES} SELECT path, count(*) AS misses FROM misses GROUP BY path",
    "harvested_words": f"WITH {MISSES} SELECT DISTINCT norm AS word FROM misses",
    "added_words": f"WITH {MISSES} SELECT word, 'derived' AS wordlist FROM lexicon UNION SELECT norm, 'project' FROM misses",
    "rechecked": f"WITH {MISSES}, added AS (SELECT norm FROM misses GROUP BY norm HAVING count(DISTINCT path) > 1) SELECT norm, count(*) AS n FROM misses ANTI JOIN added USING (norm) GROUP BY norm",
    "project_misses": f"WITH {TOKENS}, t AS (SELECT path, split_part(path, '/', 1) AS lang, norm FROM tokens), lex AS (SELECT norm, lang FROM t GROUP BY 1, 2 HAVING count(DISTINCT path) >= {LEAST_FILES}) SELECT path, norm, count(*) AS n FROM t ANTI JOIN lex USING (norm, lang) GROUP BY path, norm",
    "decided_misses": f"WITH {MISSES} SELECT CASE length(norm) WHEN 4 THEN 'skip' WHEN 5 THEN 'replace' WHEN 6 THEN 'add' END AS action, count(*) AS n, count(DISTINCT norm) AS words FROM misses GROUP BY 1",
    "miss_context": f"WITH {MISSES} SELECT path || ':' || line_no || ':' || col AS place, ltrim(left(line, CAST(chars AS BIGINT)), ' ' || chr(9)) AS before, text AS word, rtrim(substr(line, CAST(chars AS BIGINT) + length(text) + 1), ' ' || chr(9) || chr(13) || chr(10)) AS after FROM misses JOIN lines USING (path, line_no)",
    "selected_files": f"WITH {PAGES} SELECT path FROM pg WHERE NOT path LIKE '%.png'",
    "rule_selected_files": f"WITH {DOCS} SELECT path FROM docs WHERE {_KEPT}",
    "nested_rules": f"WITH {DOCS} SELECT DISTINCT path FROM docs WHERE regexp_extract(split_part(path, '/', 2), '[0-9]') <> '' AND path LIKE '%' || regexp_extract(split_part(path, '/', 2), '[0-9]') || '.txt'",
    "file_wordlists": f"WITH {PAGES} SELECT path, 'english,english/US' || CASE WHEN path LIKE '%.rb' THEN ',ruby,html' WHEN path LIKE '%.html' THEN ',html,javascript,xml' WHEN path LIKE '%.js' THEN ',html,javascript' WHEN path LIKE '%.css' THEN ',html,css' ELSE '' END || ',tool_terms' AS wordlists FROM pg",
    "directive_gate": f"WITH {LINES}, e AS (SELECT *, CASE WHEN contains(line, '{ON}') THEN 'E' WHEN contains(line, '{OFF}') AND NOT contains(line, '{ONE}') THEN 'D' END AS ev FROM lines), s AS (SELECT *, last_value(ev IGNORE NULLS) OVER (PARTITION BY path ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS st FROM e) SELECT path, line_no, line FROM s WHERE coalesce(st, 'E') <> 'D' AND NOT contains(line, '{ONE}')",
    "key_candidates": f"WITH {SPANS} SELECT path, line_no, span FROM spans",
    "key_features": f"""WITH {SPANS}, d AS (SELECT DISTINCT span, CAST(length(span) AS DOUBLE) AS length FROM spans),
      f AS (SELECT *, regexp_full_match(span, '[0-9A-Fa-f-]*') AS hex, regexp_full_match(span, '[0-9a-z]*') AS lower36, regexp_full_match(span, '[0-9A-Z]*') AS upper36, regexp_full_match(span, '[A-Za-z0-9_+/=-]*') AS base64,
        {", ".join(f"list_transform(regexp_extract_all(span, '{rx}'), lambda x: length(x)) AS s_{name}" for name, rx in _CHUNKS.items())},
        length(regexp_replace(span, '[^aeiouAEIOU]', '', 'g')) AS v, length(regexp_replace(span, '[^A-Za-z]|[aeiouAEIOUxX]', '', 'g')) AS c FROM d),
      e AS (SELECT *, CASE WHEN hex THEN length / 16 WHEN lower36 OR upper36 THEN length / 36 WHEN base64 THEN length / 64 ELSE 0 END AS expected FROM f),
      g AS (SELECT *, [{", ".join(f"abs((length - length(replace(span, '{c}', ''))) / length - expected)" for c in FEATURE_NAMES)}] AS diffs FROM e)
      SELECT span, {", ".join(f"round(diffs[{i}], 6) AS {name}" for i, name in enumerate(FEATURE_NAMES.values(), 1))}, length - length(replace(span, '=', '')) AS equal, length, CAST(hex AS DOUBLE) AS hex, CAST(lower36 AS DOUBLE) AS lower36, CAST(upper36 AS DOUBLE) AS upper36, CAST(base64 AS DOUBLE) AS base64,
        {", ".join(f"round(coalesce(list_avg(s_{name}), 0), 6) AS mean_{name}, round(coalesce(list_var_pop(s_{name}), 0), 6) AS variance_{name}" for name in _CHUNKS)}, CAST(coalesce(list_max(s_title), 0) AS DOUBLE) AS max_title,
        round(CASE WHEN c > 0 THEN v / c ELSE v END, 6) AS vowel_consonant_ratio, {", ".join(f"CAST(len(s_{name}) AS DOUBLE) AS {name}_chunks" for name in ("alpha", "alnum", "digit", "title"))}, round(list_sum(diffs) / {len(FEATURE_NAMES)}, 6) AS mean_difference, round(list_max(diffs), 6) AS max_difference FROM g""",
    "language_words": "SELECT DISTINCT word, wordlist FROM (SELECT trim(unnest(string_split(text, chr(10))), chr(13) || ' ') AS word, coalesce(lang, '-') AS wordlist FROM documents) WHERE word <> ''",
    "corpus_misses": f"WITH RECURSIVE {LINES.replace('FROM documents', 'FROM documents UNION ALL SELECT chr(1) || item_id, text FROM benchmark')},{_WORDS}, known AS (SELECT norm FROM tokens WHERE NOT starts_with(path, chr(1)) GROUP BY 1 HAVING count(DISTINCT path) >= {LEAST_FILES} UNION SELECT norm FROM tokens WHERE starts_with(path, chr(1))) SELECT path, line_no, col, text, norm FROM tokens ANTI JOIN known USING (norm) WHERE NOT starts_with(path, chr(1))",
    "replaced_words": f"""WITH {MISSES}, fixes AS (SELECT path, line_no, CAST(chars AS BIGINT) AS spot, length(text) AS size, reverse(norm) AS new FROM misses WHERE length(norm) = 5 AND reverse(norm) <> text),
      cut AS (SELECT *, coalesce(lag(spot + size) OVER (PARTITION BY path, line_no ORDER BY spot), 0) AS since FROM fixes),
      done AS (SELECT path, line_no, string_agg(substr(line, since + 1, spot - since) || new, '' ORDER BY spot) || substr(line, max(spot + size) + 1) AS made FROM cut JOIN lines USING (path, line_no) GROUP BY path, line_no, line),
      whole AS (SELECT path, string_agg(coalesce(made, line), chr(10) ORDER BY line_no) AS made FROM lines LEFT JOIN done USING (path, line_no) GROUP BY path)
      SELECT path, coalesce(made, content) AS content FROM docs LEFT JOIN whole USING (path)""",
    "close_pairs": f"""WITH {TOKENS}, v AS (SELECT DISTINCT norm AS word FROM tokens), k AS (SELECT DISTINCT word, key FROM (SELECT word, word AS key FROM v UNION ALL SELECT word, left(word, i - 1) || substr(word, i + 1) FROM (SELECT word, unnest(range(1, length(word) + 1)) AS i FROM v))),
      p AS (SELECT DISTINCT a.word AS a, b.word AS b FROM k a JOIN k b ON a.key = b.key AND a.word < b.word),
      n AS (SELECT a, b, greatest(0, greatest(length(a), length(b)) // 2 - 1) AS reach FROM p WHERE damerau_levenshtein(a, b) <= 1),
      g AS (SELECT a, b, list_reduce(range(1, length(a) + 1), lambda s, i: {_MATCHED}, {{'free': b, 'found': ''}}) AS s FROM n),
      t AS (SELECT a, b, s.found AS x, array_to_string([CASE WHEN substr(s.free, j, 1) = chr(1) THEN substr(b, j, 1) ELSE '' END FOR j IN range(1, length(b) + 1)], '') AS y FROM g),
      j AS (SELECT *, length(x) AS m, len([1 FOR i IN range(1, length(x) + 1) IF substr(x, i, 1) <> substr(y, i, 1)]) / 2.0 AS t FROM t),
      w AS (SELECT a, b, CASE WHEN m = 0 THEN 0.0 ELSE (m / length(a) + m / length(b) + (m - t) / m) / 3 END AS jaro, len([1 FOR i IN range(1, 5) IF i <= least(length(a), length(b)) AND left(a, i) = left(b, i)]) AS same FROM j)
      SELECT a, b, round(CASE WHEN jaro < 0.7 THEN jaro ELSE jaro + same * 0.1 * (1 - jaro) END, 6) AS jw FROM w""",
}
