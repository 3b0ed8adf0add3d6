"""The fitted operators against plain loops: the whole classifier on a small table, and the exchange of classes."""

import math
import random
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from spellaudit.llm import brown, quality


def shares(text):
    """Shares of signs, capitals, bars, repeated neighbours, repeated lines and digits."""
    n, words = max(1, len(text)), text.split()
    lines = [x for x in text.split("\n") if x]
    return {
        "symbols": sum(c in "%&*$#@!|<>{}[]=~^_\\" for c in text) / n,
        "capitals": sum(c.isupper() for c in text) / (sum(c.isalpha() for c in text) or 1),
        "bars": sum(w == "|" for w in words) / max(1, len(words)),
        "neighbours": sum(a == b for a, b in zip(words, words[1:])) / len(words) if len(words) >= 20 else 0.0,
        "same_lines": 1 - len(set(lines)) / max(1, len(lines)) if len(lines) >= 4 else 0.0,
        "digits": sum(c.isdigit() for c in text) / n,
    }


def hashed(name):
    return xxhash.xxh32_intdigest(name) % (1 << quality.BITS)


def features(text):
    words = {w for w in re.findall(r"[^\W\d_]+", text.lower())}
    of_words = {hashed(f"w{w}") for w in words} | {hashed(f"{k}{w[:k]}") for w in words for k in (4, 5) if len(w) > k}
    return of_words, {hashed(f"s{k}{i}") for k, v in shares(text).items() for i, m in enumerate(quality.MARKS) if v >= m}


def posteriors(votes):
    """Of each row; a labeller's votes are counted with weights, both ways."""
    q = []
    for row in votes:
        bad, good = row.count(1), row.count(0)
        q.append(min(0.98, max(0.02, (bad + 0.1) / (bad + 0.25 * good + 0.2))))
    for _ in range(50):
        share = min(0.9, max(1e-4, sum(q) / len(q)))
        logs = []
        for weights, lean in ((q, (0.05, 0.2, 0.5)), ([1 - x for x in q], (1.0, 0.001, 0.5))):
            given = []
            for k in range(len(votes[0])):
                counts = [sum(w for w, row in zip(weights, votes) if row[k] == v) + lean[v] for v in (0, 1, 2)]
                given.append([c / sum(counts) for c in counts])
            logs.append([sum(math.log(given[k][v]) for k, v in enumerate(row)) for row in votes])
        q = [1 / (1 + math.exp(-min(50, max(-50, a - b + math.log(share / (1 - share)))))) for a, b in zip(*logs)]
    return q


def scorer(rows, q):
    share = min(0.999, max(0.001, sum(q) / len(q)))
    side = [min(4.0, max(1.0, (1 - share) / share)) if x > 0.5 else 1.0 for x in q]
    times = {}
    for r in rows:
        for f in r:
            times[f] = times.get(f, 0) + 1
    weights = {f: 0.0 for f, n in times.items() if n >= 4}
    past, bias, past_bias = dict.fromkeys(weights, 1e-6), math.log(share / (1 - share)), 1e-6
    for _ in range(80 if weights else 0):
        error = []
        for r, x, s in zip(rows, q, side):
            z = bias + sum(weights[f] for f in r if f in weights)
            error.append(s * (1 / (1 + math.exp(-min(30, max(-30, z)))) - x))
        for f in weights:
            slope = sum(e for e, r in zip(error, rows) if f in r)
            past[f] += slope**2
            step = 0.3 / math.sqrt(past[f])
            w = weights[f] - step * slope
            weights[f] = math.copysign(max(0.0, abs(w) - step * 4.0), w)
        past_bias += sum(error) ** 2
        bias -= 0.3 / math.sqrt(past_bias) * sum(error)
    sums = [sum(weights.get(f, 0.0) for f in r) for r in rows]
    if any(x > 0.5 for x in q) and not all(x > 0.5 for x in q):
        # the middle of the widest gap among the cuts under which most is told right
        s, y = zip(*sorted(zip(sums, q), key=lambda p: p[0]))
        cuts = []
        for i in range(len(s) + 1):
            low, high = (s[i - 1] if i else s[0] - 1), (s[i] if i < len(s) else s[-1] + 1)
            if high > low:
                cuts.append((sum(1 - v for v in y[:i]) + sum(y[i:]), high - low, -i, (low + high) / 2))
        top = max(c[0] for c in cuts)
        bias = -max(c[1:] for c in cuts if c[0] >= top - 1e-9)[2]
    return weights, bias


def brute_scores(texts, labels, order):
    """doc_id: junk and toxic score; the sample is all labelled documents, in ``order``."""
    found = {i: features(t or "") for i, t in texts.items()}
    sample = [i for i in order if i in labels]
    toxic = [labels[i][1] for i in sample]
    lists = []
    for half in (0, 1):
        bad = [found[i][0] for k, i in enumerate(sample) if k % 2 == half and toxic[k] == 1]
        good = [found[i][0] for k, i in enumerate(sample) if k % 2 == half and toxic[k] == 0]
        lists.append({f for f in set().union(*bad) if (n := sum(f in r for r in bad)) >= max(3, 0.04 * len(bad)) and n >= 0.95 * (n + sum(f in r for r in good))})
    junk_votes, toxic_votes = [], []
    for k, i in enumerate(sample):
        own = shares(texts[i] or "")
        junk_votes.append([1 if own[n] > high else 0 if own[n] < low else 2 for n, (low, high) in quality.BOUNDS.items()] + [2 if labels[i][0] is None else int(not labels[i][0])])
        hits = len(found[i][0] & lists[1 - k % 2])
        toxic_votes.append([int(hits >= 1), 1 if hits >= 2 else 2, 1 if hits >= 3 else 2, 2 if toxic[k] is None else toxic[k]])
    out = {}
    fitted = [scorer([found[i][side] for i in sample], posteriors(votes)) for side, votes in ((1, junk_votes), (0, toxic_votes))]
    for i in texts:
        out[i] = [bias + sum(weights.get(f, 0.0) for f in found[i][side]) for side, (weights, bias) in zip((1, 0), fitted)]
    return out


def test_the_whole_classifier_is_the_plain_one(spark):
    random.seed(8)
    common, bad = [f"word{chr(97 + i)}" for i in range(14)], ["vilest", "hateful", "cursed", "wretch"]
    texts, labels = {}, {}
    for i in range(90):
        words = random.choices(common, k=random.randint(5, 40))
        toxic, junk = int(i % 6 == 0), int(i % 5 == 0)
        words += random.choices(bad, k=3) * toxic
        text = " ".join(words) + (" $#@| | %% 12345 " * 6 if junk else ".")
        texts[i] = text
        if i < 70:
            labels[i] = (None if i % 17 == 0 else 1 - junk, None if i % 19 == 0 else toxic)
    texts |= {100: None, 101: "", 102: "WORDA " * 30}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    marked = spark.createDataFrame([(i, *x) for i, x in labels.items()], "doc_id long, quality int, toxic int")
    order = [r.doc_id for r in docs.orderBy(F.xxhash64("doc_id")).collect()]
    expected = brute_scores(texts, labels, order)
    got = {r.doc_id: r for r in quality.scored(docs, quality.fit(docs, marked)).collect()}
    assert got.keys() == expected.keys()
    for i, (junk, toxic) in expected.items():
        assert (got[i].junk_score, got[i].toxic_score) == pytest.approx((junk, toxic), abs=1e-6), i
        assert got[i].kept == (junk <= 0 and toxic <= 0)
    assert sum(got[i].kept for i in range(0, 90, 6)) < 4 and sum(r.kept for r in got.values()) > 40


def test_copies_with_unlike_labels_are_told(spark):
    """equal texts have equal sums, and the best place among them is no cut."""
    random.seed(3)
    kinds = ["worda wordb.", "worda wordc.", "wordb $#@| | %% 1", "vilest hateful cursed worda", "vilest hateful cursed wordb"]
    texts = {i: kinds[i % 5] for i in range(60)}
    labels = {i: (random.randint(0, 1), random.randint(0, 1)) for i in texts}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    marked = spark.createDataFrame([(i, *x) for i, x in labels.items()], "doc_id long, quality int, toxic int")
    order = [r.doc_id for r in docs.orderBy(F.xxhash64("doc_id")).collect()]
    got = {r.doc_id: (r.junk_score, r.toxic_score) for r in quality.scored(docs, quality.fit(docs, marked)).collect()}
    assert got == {i: pytest.approx(x, abs=1e-6) for i, x in brute_scores(texts, labels, order).items()}
    # 2 of the 4 are right on either side of all, 3 between equal ones
    assert quality.best_bias(np.zeros(4), np.array([0.1, 0.9, 0.9, 0.1]), 7.0) == 0.5


def xlogx(x):
    return x * math.log(x) if x > 0 else 0.0


def likelihood(bigrams, cls):
    """What the classes explain of the bigrams, from the definition; and the counts of class pairs."""
    pairs, left, right = {}, {}, {}
    for a, b, n in bigrams:
        k, m = int(cls[a]), int(cls[b])
        pairs[k, m] = pairs.get((k, m), 0) + n
        left[k] = left.get(k, 0) + n
        right[m] = right.get(m, 0) + n
    return sum(map(xlogx, pairs.values())) - sum(map(xlogx, left.values())) - sum(map(xlogx, right.values())), pairs


def test_exchange_raises_the_likelihood(spark):
    for seed in range(3):
        random.seed(seed)
        # 24 units of four kinds, each of which goes to one kind mostly; the end is the last unit
        kind = [random.randrange(4) for _ in range(24)] + [4]
        bigrams = []
        for a in range(25):
            for b in range(25):
                n = random.randint(20, 60) if kind[b] == (kind[a] + 1) % 4 else random.choice([0, 0, 1])
                if n:
                    bigrams.append((a, b, n))
        table = spark.createDataFrame(bigrams, "a int, b int, n long")
        start = np.array([i % 4 for i in range(24)] + [4])
        before, _ = likelihood(bigrams, start)
        last = before
        for rounds in (0, 1, 2, 5):
            cls, pairs = brown.exchange(table, 25, classes=4, rounds=rounds)
            now, counted = likelihood(bigrams, cls)
            assert cls[-1] == 4 and set(cls[:-1]) <= {0, 1, 2, 3}
            assert {(k, m): pairs[k, m] for k, m in zip(*np.nonzero(pairs))} == counted
            assert now >= last - 1e-6, rounds
            if not rounds:
                assert (cls == start).all()
            last = now
        assert before < last <= likelihood(bigrams, np.array(kind))[0]
        print(f"share of the planted gain: {(last - before) / (likelihood(bigrams, np.array(kind))[0] - before):.2f}")


@pytest.mark.parametrize("common", [300_000, 12, 0])
def test_every_known_word_has_its_own_classes(spark, monkeypatch, common):
    """words beyond the heads moved by groups alone; now each moves by its own neighbours, and scores are those of the definition."""
    monkeypatch.setattr(brown, "sizes", lambda words: (3, 2, 4))
    monkeypatch.setattr(brown, "COMMON", common)
    found = []
    real = brown.exchange
    monkeypatch.setattr(brown, "exchange", lambda *a: found.append(real(*a)) or found[-1])
    random.seed(5)
    kinds = [[f"{c}{i}{random.choice('xyz')}abc" for i in range(9)] for c in "pqrs"]
    texts = {i: " ".join(random.choice(kinds[(j + i) % 4]) for j in range(random.randint(0, 30))) for i in range(60)} | {60: None, 61: "new pqr new", 62: "P0xabc new newer p0xabc"}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    held = {r.doc_id for r in docs.filter(brown.held_out()).collect()}
    got = {r.doc_id: r for r in brown.scores(docs).collect()}
    (cls, pairs), read = found[0], {d: brown.tokens(t) for d, t in texts.items()}
    counts = {}
    for d in read.keys() - held:
        for w in read[d]:
            counts[w] = counts.get(w, 0) + 1
    units = brown.Units(sorted((w for w in counts if w != brown.END), key=lambda w: (-counts[w], w))[:3], 2)
    unit = lambda w: int(cls[units[w]])
    beside = [(a, b) for d in read.keys() - held for a, b in zip([brown.END, *read[d]], read[d])]
    log = lambda x: math.log(max(x, 1e-9))
    first, second = {brown.END: 4}, {brown.END: 4}
    for w in counts.keys() - {brown.END}:
        free = [k for k in range(4) if pairs[:, k].sum()]
        second[w] = max(free, key=lambda k: (sum(log(pairs[unit(a), k]) - log(pairs[:, k].sum()) for a, b in beside if b == w), -k))
        first[w] = max((k for k in range(4) if pairs[k].sum()), key=lambda k: (sum(log(pairs[k, unit(b)]) - log(pairs[k].sum()) for a, b in beside if a == w), -k))
    # five units and the end cannot tell the four kinds of words; the words themselves can
    assert len({(first[w], second[w]) for w in counts}) > 1 and any((first[w], second[w]) != (unit(w), unit(w)) for w in counts)
    n, mass = np.zeros((5, 5)), np.zeros(5)
    for a, b in beside:
        n[first[a], second[b]] += 1
    whole = sum(counts.values()) + 0.5 * (len(counts) + 1)
    for w, c in counts.items():
        mass[second[w]] += (c + 0.5) / whole
    unseen = 0.5 / whole
    for d, words in read.items():
        score = 0.0
        for a, b in zip([brown.END, *words], words):
            k, l = first.get(a, unit(a)), second.get(b)
            score += math.log10(unseen if b not in counts else (1 - unseen) * (n[k, l] + 50 * mass[l] / (1 - unseen)) / (n[k].sum() + 50) * (counts[b] + 0.5) / whole / mass[l])
        assert got[d].score == pytest.approx(score), d
        assert (got[d].n_tokens, got[d].n_known) == (len(words), sum(w in counts for w in words))
        assert got[d].base_score == pytest.approx(sum(math.log10((counts.get(w, 0) + 0.5) / whole) for w in words))
