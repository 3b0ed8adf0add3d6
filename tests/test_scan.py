import random

import pytest

from spellaudit.functions import keys, similarity
from spellaudit.functions.scan import scan

CASES = [
    ("hello world", False, ["hello", "world"]),
    ("Hello World", False, ["Hello", "World"]),
    ("FOO BAR", False, ["FOO", "BAR"]),
    ("#abc hello", False, ["hello"]),
    ("see https://example.com/foo for details", False, ["see", "for", "details"]),
    ("hello mark:disable-line typo", False, ["hello"]),
    ("xxxxxxxx hello", False, ["hello"]),
    ("abcdef hello", False, ["hello"]),
    ("isSomething", False, ["Something"]),
    ("aSomething", False, ["Something"]),
    ("    %center", True, ["center"]),
    ("DOESN'T", False, ["DOESN'T"]),
    ("D'Santos", False, ["Santos"]),
    ("HTMLParser", False, ["HTML", "Parser"]),
    ("FOO_BAR", False, ["BAR"]),
    ("user's name", False, ["user", "name"]),
    ("don't stop", False, ["don't", "stop"]),
    ("one—two", False, ["one—two"]),
    ("café ok then", False, ["then"]),
    ("http://10.0.0.1/some/path", False, ["some", "path"]),
    (r"\e[33mhello", False, ["hello"]),
    ("see 0xDEADBEEF now", False, ["see", "now"]),
    ("keep mark:disable gone mark:enable here", False, ["keep", "here"]),
    ("", False, []),
]


@pytest.mark.parametrize(("line", "skip", "expected"), CASES)
def test_words(line, skip, expected):
    assert [t for _, t, _, _ in scan(line, skip_keys=skip, marker="mark")] == expected


def test_kinds():
    assert [k for _, _, k, _ in scan("Title lower UPPER")] == ["title", "lower", "upper"]


def test_urls():
    for url in ("user:pw@host.org/x", "example.com/a?b=c#d", "mailto:me@example.com", "localhost/path"):
        assert [(at, t, kind) for at, t, _, kind in scan(url, skips=True)] == [(0, url, "url")]
    assert all(kind == "word" for _, _, _, kind in scan("plain.text here", skips=True))


def test_similarity():
    assert similarity.jaro_winkler("hello", "helo") > 0.8
    assert [similarity.edit_distance(*p) for p in (("hello", "helo"), ("hello", "hello"), ("ab", "ba"), ("ca", "abc"))] == [1, 0, 1, 3]
    assert similarity.jaro("abcdefgh", "bcadefgh") == pytest.approx(0.9375)


def test_features():
    row = dict(zip(keys.FEATURES, keys.features("ab12CDx="), strict=True))
    assert len(keys.FEATURES) == 37
    assert (row["length"], row["equal"], row["base64"], row["hex"], row["digit_chunks"], row["alpha_chunks"]) == (8, 1, 1, 0, 1, 2)
    assert row["x"] == pytest.approx(abs(1 / 8 - 8 / 64))


def test_similarity_of_many_pairs():
    random.seed(8)
    word = lambda: "".join(random.choices("abcdé😀", k=random.choice([0, 1, 2, 4, 7, 9, 13, 15, 30, 70, 300])))
    pairs = [(word(), word()) for _ in range(1500)] + [(w, w[:2] + w[3:]) for w in (word() for _ in range(300))]
    assert similarity.jaro_winkler_of(pairs).tolist() == [similarity.jaro_winkler(*p) for p in pairs]
    assert not len(similarity.jaro_winkler_of([]))
