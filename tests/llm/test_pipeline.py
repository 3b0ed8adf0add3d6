"""The pipeline and each of its stages against brute force on whole small tables."""

import base64
import hashlib
import math
from collections import Counter, defaultdict

import corpus_pipeline
import numpy as np
import public_tokenizers
import pytest
import tiktoken

from spellaudit.llm import brown, chat, decontaminate, lines, near_dups, quality, sharding
from spellaudit.llm.common import table

DATA = "/root/testdata/sf0.001"


def texts_of(df):
    return {r.doc_id: r.text for r in df.collect()}


def within_one(a, b):
    a, b = sorted((a, b), key=len)
    if len(b) - len(a) > 1:
        return False
    k = next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), len(a))
    return a[k:] == b[k + 1 :] or (len(a) == len(b) and a[k + 1 :] == b[k + 1 :])


def deduped_lines(docs):
    first = {}
    for d in sorted(docs):
        for p, raw in enumerate((docs[d] or "").split("\n")):
            line = raw.strip(" \t\r")
            if docs[d] is not None and len(line) >= lines.MIN_CHARS:
                first.setdefault(line, (d, p))
    # an edit leaves one half of a line alone: candidates by halves
    halves = defaultdict(set)
    for x in first:
        for n in (len(x), len(x) - 1):
            halves[n, 0, x[: n // 2]].add(x)
            halves[n, 1, x[len(x) - (n - n // 2) :]].add(x)
    near = {y for group in halves.values() for y in group for x in group if x is not y and first[x] < first[y] and within_one(x, y)}
    out = {}
    for d, text in docs.items():
        if text is None:
            out[d] = None
            continue
        parts = text.split("\n")
        kept = [raw for p, raw in enumerate(parts) if not ((x := raw.strip(" \t\r")) in first and (x in near or (d, p) > first[x]))]
        if kept:
            out[d] = "\n".join(kept)
    return out


def deduped(docs, percent=80):
    sets = {d: set(near_dups.shingles(t).tolist()) for d, t in docs.items()}
    low = {d: d for d in docs}

    def root(x):
        while low[x] != x:
            x = low[x]
        return x

    ids = sorted(docs)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            if sets[a] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = sorted((root(a), root(b)))
                low[y] = x
    return {d: t for d, t in docs.items() if root(d) == d}


def cleaned(docs, items):
    windows = set()
    for t in items:
        w = decontaminate.words(t)
        windows |= {tuple(w[k : k + 13]) for k in range(max(1, len(w) - 12) if w else 0)}
    out = {}
    for d, t in docs.items():
        w, hit = decontaminate.words(t), set()
        for n in {len(x) for x in windows}:
            for k in range(len(w) - n + 1):
                if tuple(w[k : k + n]) in windows:
                    hit.update(range(k, k + n))
        if not (hit and 20 * len(hit) >= len(w)):
            out[d] = t
    return out


def test_stages_and_run(spark):
    docs = table(spark, DATA, "documents")
    stage = dict(corpus_pipeline.STAGES)
    kept = stage["quality classifier"](spark, docs, DATA)
    model = quality.fit(docs, table(spark, DATA, "labels"))
    expected = {d: t for d, t in texts_of(docs).items() if max(model.scores(t)) <= 0}
    assert kept.columns == docs.columns and texts_of(kept) == expected
    labels = {r.doc_id: r.quality == 1 and r.toxic == 0 for r in table(spark, DATA, "labels").collect()}
    assert sum((d in expected) == good for d, good in labels.items()) >= 0.85 * len(labels)  # 87 rows to learn from
    for name, brute in (("line dedup", deduped_lines), ("near duplicates", deduped), ("decontamination", lambda x: cleaned(x, [r.text for r in table(spark, DATA, "benchmark").collect()]))):
        kept, expected = stage[name](spark, kept, DATA), brute(expected)
        assert kept.columns == docs.columns and texts_of(kept) == expected, name
    table_of = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), "rb"))}
    whole = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=table_of, special_tokens={})
    ids = {d: whole.encode_ordinary(t or "") for d, t in expected.items()}
    got = {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in corpus_pipeline.run(spark, DATA).collect()}
    assert got == {d: (len(x), hashlib.sha256(",".join(map(str, x)).encode()).hexdigest(), hashlib.sha256((expected[d] or "").encode()).hexdigest()) for d, x in ids.items()}


def test_scores_are_the_model_and_its_probabilities_add_up(spark, monkeypatch):
    found = []
    real = brown.exchange
    monkeypatch.setattr(brown, "exchange", lambda *a: found.append(real(*a)) or found[-1])
    docs = table(spark, DATA, "documents")
    texts = texts_of(docs)
    got = {r.doc_id: r.score for r in brown.scores(docs, heads=150, tails=40, classes=6, smoothing=50.0).collect()}
    (cls, pairs), held = found[0], {r.doc_id for r in docs.filter(brown.held_out()).collect()}
    counts = Counter(w for d, t in texts.items() if d not in held for w in brown.tokens(t))
    whole = sum(counts.values()) + 0.5 * (len(counts) + 1)
    names = sorted((w for w in counts if w != brown.END), key=lambda w: (-counts[w], w))[:150]
    units = brown.Units(names, 40)
    class_of = lambda w: int(cls[units[w]])
    mass = np.zeros(7)
    for w, c in counts.items():
        mass[class_of(w)] += (c + 0.5) / whole
    unseen = 0.5 / whole

    def chance(w, k):
        if w not in counts:
            return unseen
        q = mass / (1 - unseen)
        given = (pairs[k] + 50 * q) / (pairs[k].sum() + 50)
        return (1 - unseen) * given[class_of(w)] * (counts[w] + 0.5) / whole / mass[class_of(w)]

    for k in range(7):
        assert sum(chance(w, k) for w in counts) + unseen == pytest.approx(1)
    for d in sorted(texts)[:60]:
        words = brown.tokens(texts[d])
        assert got[d] == pytest.approx(sum(math.log10(chance(w, class_of(p))) for p, w in zip([brown.END, *words], words, strict=False)))
    # the bigrams of classes are those of the texts
    seen = np.zeros((7, 7))
    for d, t in texts.items():
        if d not in held:
            words = brown.tokens(t)
            for p, w in zip([brown.END, *words], words, strict=False):
                seen[class_of(p), class_of(w)] += 1
    assert (seen == pairs).all()
    assert brown.sizes(10) == (1024, 1023, 16) and brown.sizes(10**8) == (10_000, 10_000, 100)


def test_expectation_maximisation_finds_the_labellers():
    rng = np.random.default_rng(4)
    truth = rng.random(4000) < 0.2
    right = (0.95, 0.9, 0.85, 0.7)
    votes = np.stack([np.where(rng.random(4000) < 0.15, quality.NOTHING, np.where(rng.random(4000) < r, truth, ~truth).astype(int)) for r in right], 1)
    posterior = quality.em(dict(Counter(map(tuple, votes.tolist()))))
    said = np.array([posterior[tuple(v)] for v in votes.tolist()])
    # the best that the true rates allow
    logs = np.log(0.2 / 0.8) + sum(np.where(votes[:, i] == quality.NOTHING, 0, np.where(votes[:, i] == 1, 1, -1) * np.log(r / (1 - r))) for i, r in enumerate(right))
    assert ((said > 0.5) == truth).mean() >= ((logs > 0) == truth).mean() - 0.02


def test_scorer_is_linear(spark):
    docs = [np.array(x) for x in ([1, 2], [1, 3], [1, 4], [1, 5], [1, 2, 9], [1, 3, 9], [1, 4, 9], [1, 5, 9])]
    weights, bias = quality.logistic(quality.Sparse(docs), np.array([0.0] * 4 + [1.0] * 4), penalty=0.01, least=2)
    score = lambda x: bias + sum(weights.get(f, 0.0) for f in x.tolist())
    assert [score(x) > 0 for x in docs] == [False] * 4 + [True] * 4
    model = quality.Model({"junk": ({}, -1.0), "toxic": ({quality.word_features("bad")[0]: 3.0, quality.word_features("good")[0]: -1.5}, -1.0)})
    assert [model.scores(t)[1] for t in ("bad", "bad bad Bad", "good bad", None)] == [2.0, 2.0, 0.5, -1.0]


def test_table_is_filled_by_turns():
    shards, slots = ["x", "y", "z"], 13
    import zlib

    order = {s: [(zlib.crc32(f"offset:{s}".encode()) + i * (zlib.crc32(f"skip:{s}".encode()) % 12 + 1)) % slots for i in range(slots)] for s in shards}
    owner, turn = {}, 0
    while len(owner) < slots:
        s = shards[turn % 3]
        owner[next(x for x in order[s] if x not in owner)] = s
        turn += 1
    assert [shards[i] for i in sharding.fill(shards, slots)] == [owner[i] for i in range(slots)]


def test_calls_of_turns(spark):
    turns = table(spark, DATA, "conversations")
    rows = {}
    for r in turns.collect():
        rows.setdefault(r.conv_id, {})[r.turn] = (r.role, r.text)
    calls, results = chat.calls_of_turns(turns)
    expected, answers = set(), set()
    for c, t in rows.items():
        asked = {k for k, (role, _) in t.items() if role != "assistant"}
        expected |= {(c, f"call-{k}", next((f"call-{k - d}" for d in (2, 1) if k - d in asked), None), t[k][0]) for k in asked}
        answers |= {(c, f"call-{k - 1}", text) for k, (role, text) in t.items() if role == "assistant"}
    assert {(r.conv_id, r.call_id, r.after, r.name) for r in calls.collect()} == expected
    assert {tuple(r) for r in results.select("conv_id", "call_id", "content").collect()} == answers


def test_run_on_empty_tables(spark, tmp_path):
    for name in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{DATA}/{name}.parquet").limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    got = corpus_pipeline.run(spark, str(tmp_path))
    assert got.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"] and got.isEmpty()
