"""Operators against brute force on small tables with nulls, empty and long texts, ties and repeats."""

import base64
import hashlib
import json
import math
import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

from spellaudit.llm import bpe, brown, chat, decontaminate, lines, media, near_dups, quality, repeats, sharding
from spellaudit.llm.common import skewed_join, written

DATA = "/root/testdata/sf0.001"
RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


@pytest.fixture(scope="module")
def docs(spark):
    extra = spark.createDataFrame([(900_001, None, None), (900_002, "", "x"), (900_003, "a" * 3000, "x"), (900_004, "é " * 400, "x"), (900_005, "A b", "x"), (900_006, "a  B", "x"), (900_007, "ab" * 700, "x")], "doc_id long, text string, lang string")
    return spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text", "lang").unionByName(extra).cache()


@pytest.fixture(scope="module")
def rows(docs):
    return {r.doc_id: r.text or "" for r in docs.collect()}


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string")


def test_bpe(docs, rows, none):
    table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    whole = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=table, special_tokens={})
    coded = bpe.encode(docs, RANKS, public_tokenizers.PATTERN, with_ids=True)
    for r in coded.collect():
        ids = whole.encode_ordinary(rows[r.doc_id])
        assert (r.ids, r.n_tokens, bytes(r.decoded)) == (ids, len(ids), rows[r.doc_id].encode())
        assert r.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
    assert all(bytes(r.decoded) == rows[r.doc_id].encode() for r in bpe.decode(coded, RANKS).collect())
    assert bpe.encode(none, RANKS, public_tokenizers.PATTERN).count() == 0


def test_media(docs, rows):
    for form in ("pgm", "bmp"):
        for r in media.media_columns(docs, form=form, keep_bytes=True).collect():
            raw = rows[r.doc_id].encode()
            full = raw + b"\xff" * (-len(raw) % 576 or (576 if not raw else 0))
            assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(full), hashlib.sha256(full).hexdigest(), zlib.crc32(full[-32:]))
            assert media.decode_image(bytes(r.media)).tobytes() == full
    image = np.arange(24 * 16, dtype=np.uint8).reshape(24, 16)
    assert np.allclose(media.area_resize(image, 6, 4), image.reshape(6, 4, 4, 4).mean((1, 3)))
    assert np.isclose(media.area_resize(image, 7, 5).mean(), image.mean())


def test_decontamination(spark, docs, rows):
    items = spark.read.parquet(f"{DATA}/benchmark.parquet").unionByName(spark.createDataFrame([(-1, None), (-2, ""), (-3, "a b")], "item_id long, text string"))
    windows = {}
    for r in items.collect():
        w = decontaminate.words(r.text)
        for k in range(max(1, len(w) - 12) if w else 0):
            windows.setdefault(tuple(w[k : k + 13]), set()).add(str(r.item_id))
    sizes = {len(w) for w in windows}
    for bound in (1 << 26, 0):
        for r in decontaminate.contamination(docs, items, broadcast_bytes=bound).collect():
            w, hit, found = decontaminate.words(rows[r.doc_id]), set(), set()
            for n in sizes:
                for k in range(len(w) - n + 1):
                    if names := windows.get(tuple(w[k : k + n])):
                        hit.update(range(k, k + n))
                        found |= names
            assert (r.n_words, r.n_hit, r["items"], r.contaminated) == (len(w), len(hit), sorted(found), bool(hit) and 20 * len(hit) >= len(w))


@pytest.mark.parametrize("group", [1500, 1])
def test_repeats(docs, rows, group):
    starts = Counter()
    for t in rows.values():
        raw = t.encode()
        starts.update(raw[i : i + 400] for i in range(len(raw) - 399))
    for r in repeats.remove_repeats(docs, group=group, keep_bytes=True).collect():
        raw = rows[r.doc_id].encode()
        gone = bytearray(len(raw))
        for i in range(len(raw) - 399):
            if starts[raw[i : i + 400]] > 1:
                gone[i : i + 400] = b"\1" * 400
        assert bytes(r.kept) == bytes(c for c, g in zip(raw, gone, strict=True) if not g)
        assert (r.n_removed, r.n_spans) == (sum(gone), sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone)))


@pytest.mark.parametrize("small", [24, 1])
def test_near_duplicates(docs, rows, small):
    sets = {k: set(near_dups.shingles(t).tolist()) for k, t in rows.items()}
    low = {k: k for k in sets}
    ids = sorted(sets)
    changed = True
    links = [(a, b) for i, a in enumerate(ids) for b in ids[i + 1 :] if sets[a] and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b])]
    while changed:
        changed = False
        for a, b in links:
            if low[a] != low[b]:
                low[a] = low[b] = min(low[a], low[b])
                changed = True
    for r in near_dups.near_duplicates(docs, small=small).collect():
        assert (r.n_shingles, r.component_id, r.kept) == (len(sets[r.doc_id]), low[r.doc_id], low[r.doc_id] == r.doc_id)


def test_lines(spark):
    random.seed(5)
    base, data = "the quick brown fox jumps over it", [(0, None), (1, ""), (2, "the quick brown fox jumps over it")]
    for i in range(3, 90):
        b = list(base)
        for _ in range(random.choice([0, 1, 1, 2])):
            j = random.randrange(len(b))
            b[j : j + 1] = random.choice([[], ["x"], ["x", b[j]]])
        data.append((i, "".join(b) + "\nshort\n" + base.upper()[:25] + random.choice("abcd")))
    df = spark.createDataFrame(data, "doc_id long, text string")
    each = [(d, p, x) for d, t in data if t is not None for p, x in enumerate(t.split("\n")) if len(x) >= 20]
    first = {}
    for d, p, x in each:
        first[x] = min(first.get(x, (d, p)), (d, p))

    def near(a, b):
        a, b = sorted((a, b), key=len)
        k = next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), len(a))
        return len(b) - len(a) <= 1 and (a[k:] == b[k + 1 :] or (len(a) == len(b) and a[k + 1 :] == b[k + 1 :]))

    close = {b for b in first if any(first[a] < first[b] and near(a, b) for a in first if a != b)}
    expected = {(d, p) for d, p, x in each if x in close or (d, p) > first[x]}
    for bucket in (24, 2):
        assert {(r.doc_id, p) for r in lines.removed_places(df, bucket=bucket).collect() for p in r.gone} == expected


def test_bit_parallel_distance(spark):
    from pyspark.sql import functions as F

    random.seed(1)
    pairs = [("".join(random.choices("abé", k=random.randint(0, 8))), "".join(random.choices("abé", k=random.randint(0, 8)))) for _ in range(400)]
    df = spark.createDataFrame(pairs, "a string, b string")
    for k in (1, 2, 3):
        assert df.filter(lines.within("a", "b", k) != (F.levenshtein("a", "b") <= k)).isEmpty()


def test_language_model(docs, rows):
    counts = Counter()
    for k, t in rows.items():
        if zlib.crc32(str(k).encode()) % 5 != 1:
            counts.update(brown.tokens(t))
    n, v = sum(counts.values()), len(counts)
    better = 0.0
    for r in brown.scores(docs).collect():
        words = brown.tokens(rows[r.doc_id])
        base = sum(math.log10((counts[w] + 0.5) / (n + 0.5 * (v + 1))) for w in words)
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(words), sum(counts[w] > 0 for w in words), n)
        assert r.base_score == pytest.approx(base)
        better += (r.score - r.base_score) * r.held_out
    assert better > 0


def test_quality(spark):
    base = "/root/testdata/sf0.1"
    documents, labels = spark.read.parquet(f"{base}/documents.parquet"), spark.read.parquet(f"{base}/labels.parquet")
    fitting, test = labels.filter("doc_id % 2 = 0"), labels.filter("doc_id % 2 = 1")
    got = quality.scored(documents.join(test, "doc_id", "left_semi"), quality.fit(documents, fitting)).join(test, "doc_id").collect()
    right = sum(r.kept == (r.quality == 1 and r.toxic == 0) for r in got)
    assert right > 0.95 * len(got)
    odd = spark.createDataFrame([(1, None), (2, "")], "doc_id long, text string")
    assert all(r.kept for r in quality.scored(odd, quality.fit(odd, labels.limit(0))).collect())


def test_chat(spark):
    calls = spark.createDataFrame([(1, "a", None, "f", '{"y":1,"x":"q\\"u"}'), (1, "b", "a", "f", '{"x":2,"y":1}'), (1, "c", "b", "f", '{"x":"s"'), (1, "d", "e", "f", None), (1, "e", "d", "g", "{}"), (1, "z", "nope", "f", '{"x":"","y":3,"w":1}')], "conv_id long, call_id string, after string, name string, arguments string")
    results = spark.createDataFrame([(1, "a", "li\nne"), (1, "q", "no")], "conv_id long, call_id string, content string")
    got = {r.call_id: r for r in chat.link_calls(calls.unionByName(calls), results, {"f": {"x": "string", "y": "integer"}}).collect()}
    assert {k: (r.rank, r.linked, r.valid) for k, r in got.items()} == {"a": (0, True, True), "b": (1, False, False), "c": (2, False, False), "d": (-1, False, False), "e": (-1, False, False), "z": (0, False, False)}
    for r in got.values():
        parsed = json.loads(r.record)
        if r.call_id != "c":
            assert r.record == json.dumps(parsed, sort_keys=True, separators=(",", ":"), ensure_ascii=False)
    assert json.loads(got["a"].record)["result"] == "li\nne"


NESTED = {"q": "string", "mode": ("fast", "full", 3), "tags": ["string"], "where?": {"lat": "number", "names": [{"first": "string", "last?": "string"}]}, "n": "integer?"}


def fits(value, schema):
    if isinstance(schema, str):
        kinds = {"string": (str,), "integer": (int,), "number": (int, float), "boolean": (bool,)}[schema.rstrip("?")]
        return isinstance(value, kinds) and (isinstance(value, bool) is (schema.rstrip("?") == "boolean"))
    if isinstance(schema, tuple):
        return any(type(value) is type(x) and value == x for x in schema)
    if isinstance(schema, list):
        return isinstance(value, list) and all(fits(x, schema[0]) for x in value)
    names = {k.removesuffix("?"): (k.endswith("?") or isinstance(of, str) and of.endswith("?"), of) for k, of in schema.items()}
    return isinstance(value, dict) and value.keys() <= names.keys() and all(fits(value[k], of) if k in value else may for k, (may, of) in names.items())


def test_nested_schemas(spark):
    random.seed(4)
    good = {"q": "x", "mode": "fast", "tags": ["a", "b"], "where": {"lat": 1.5, "names": [{"first": "f"}, {"first": "f", "last": "l"}]}, "n": 4}
    values = [good, {k: v for k, v in good.items() if k not in ("where", "n")}, [], "x", 1, None, {}]
    parts = ["x", 3, 3.5, True, None, [], ["a"], [1], {}, "full", "slow", {"lat": 2, "names": []}, {"lat": "2", "names": []}, {"lat": 2, "names": [{}]}, {"lat": 2, "names": [{"first": 1}]}, {"lat": 2, "names": [{"first": "a", "more": 1}]}]
    values += [good | {k: v} for k in (*good, "more") for v in parts] + [{k: v for k, v in good.items() if k != gone} for gone in good]
    calls = spark.createDataFrame([(1, str(i), None, "f", json.dumps(v)) for i, v in enumerate(values)], "conv_id long, call_id string, after string, name string, arguments string")
    none = spark.createDataFrame([], "conv_id long, call_id string, content string")
    got = {int(r.call_id): r.valid for r in chat.link_calls(calls, none, {"f": NESTED}).collect()}
    assert got == {i: fits(v, NESTED) for i, v in enumerate(values)} and sum(got.values()) > 10


def test_calls_after_several(spark):
    random.seed(6)
    rows, expected = [], {}
    for conv in range(12):
        n = random.randint(1, 14)
        before = {i: sorted({random.randrange(n + 2) if random.random() < 0.15 else random.randrange(max(1, i)) for _ in range(random.randint(0, 3))}) for i in range(n)}

        def rank(i, seen=()):
            """The longest way; None on a cycle or after one."""
            if i in seen:
                return None
            ways = [rank(j, (*seen, i)) for j in before[i] if j in before]  # noqa: B023
            return None if None in ways else 1 + max(ways, default=-1)

        for i in range(n):
            rows.append((conv, f"c{i}", [f"c{j}" for j in before[i]] + [None], "f", "{}"))
            found = rank(i)
            expected[conv, f"c{i}"] = -1 if found is None else found
    rows += [(99, "x", None, "f", "{}"), (None, "x", ["y"], "f", "{}"), (99, None, [], "f", "{}")]
    calls = spark.createDataFrame(rows + rows[:5], "conv_id long, call_id string, after array<string>, name string, arguments string")
    none = spark.createDataFrame([], "conv_id long, call_id string, content string")
    got = chat.link_calls(calls, none, {"f": {}}).collect()
    assert {(r.conv_id, r.call_id): r["rank"] for r in got} == expected | {(99, "x"): 0} and len(got) == len(expected) + 1
    assert -1 in expected.values() and max(expected.values()) > 2
    assert all(json.loads(r.record)["after"] is None or isinstance(json.loads(r.record)["after"], list) for r in got)
    assert chat.link_calls(calls.limit(0), none, {}).isEmpty()


def test_sharding(spark, docs):
    shards = [f"s{i}" for i in range(7)]
    table = sharding.fill(shards, 1009)
    assert sorted(Counter(table).values())[0] >= 1009 // 7
    fewer = sharding.fill(shards[:-1], 1009)
    assert sum(a != b for a, b in zip(table, fewer, strict=True) if a != 6) < 0.25 * 1009
    for r in sharding.assign(docs, ["doc_id"], shards, slots=1009).collect():
        slot = int(hashlib.md5(str(r.doc_id).encode()).hexdigest()[:15], 16) % 1009
        assert (r.slot, r.shard) == (slot, shards[table[slot]])


def test_skewed_join_gives_the_plain_join(spark):
    rows = spark.createDataFrame([("hot", i) for i in range(3000)] + [(f"k{i % 2000}", i) for i in range(4000)] + [("alone", 0), (None, 1)], "key string, i int")
    groups = written(rows.groupBy("key").agg(F.count("*").alias("size")).filter("size > 1"))
    got, plain = (sorted(map(tuple, x.select("key", "i", "size").collect())) for x in (skewed_join(rows, groups, "key", "size"), rows.join(groups, "key")))
    assert got == plain and len(got) == 7000
    assert not skewed_join(rows.limit(0), groups.limit(0), "key", "size").collect()


def test_run_index_gives_all_matching_statistics():
    random.seed(1)
    for t in range(600):
        text = b"\xff".join(bytes(random.choices(b"ab" if t % 2 else b"abc", k=random.randint(1, 9))) for _ in range(random.randint(1, 6))) + b"\xff"
        n = len(text)

        def common(a, b, text=text, n=n):
            k = 0
            while max(a, b) + k < n and text[a + k] == text[b + k]:
                k += 1
            return k

        assert repeats.RunIndex(text).matching_statistics().tolist() == [max([common(i, j) for j in range(n) if j != i], default=0) for i in range(n)]
