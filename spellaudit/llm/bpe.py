"""Byte-level BPE encoding and decoding from a table of ranks.

Each piece of text that the split pattern finds is encoded separately. Over the byte positions of a piece stands a
segment tree whose leaves hold the rank of the pair that starts there and whose inner nodes hold the smaller of their
children, with the position packed below the rank, so that the root names the leftmost pair of least rank. A merge
joins the pair, drops its right half from the list of live positions and updates the leaves of the two live neighbours,
each in as many steps as the tree is high.

Short pieces of a batch are encoded side by side: the trees of all distinct new pieces are rows of one numpy array and
every step does one merge in each. Longer pieces have a tree of their own. Results of short pieces are kept in a
bounded cache, as words repeat.

Null text counts as empty; an empty text has no ids. Every byte has a rank, so nothing is unknown. Texts of any length
are encoded whole. Repeated rows give repeated results. Empty tables give empty results. Columns other than the id and the text are ignored.
"""

from __future__ import annotations

import base64
import functools
import hashlib
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spellaudit.llm.common import lean, values

#: Pieces of up to this many bytes are encoded side by side.
SIDE_BY_SIDE = 64
#: Pieces from which on a worker's cache takes in no more; frequent ones come early.
CACHE = 120_000
NONE = np.int64(1) << 62


class Ranks:
    """The merge ranks of a vocabulary and the table of the pairs that merge."""

    def __init__(self, path: str):
        self.tokens: dict[int, bytes] = {}
        with open(path, "rb") as f:
            for line in f:
                token, rank = line.split()
                self.tokens[int(rank)] = base64.b64decode(token)
        ids = {b: r for r, b in self.tokens.items()}
        self.byte_ids = np.array([ids[bytes([b])] for b in range(256)], np.int64)
        pairs = {}
        for whole, rank in ids.items():
            for cut in range(1, len(whole)):
                a, b = ids.get(whole[:cut]), ids.get(whole[cut:])
                if a is not None and b is not None:
                    pairs[a << 20 | b] = rank
        self.pairs = pairs
        keys = np.array(sorted(pairs), np.int64)
        self.keys, self.values = keys, np.array([pairs[k] for k in keys.tolist()], np.int64)

    def of_pairs(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of each pair, NONE where it does not merge; ids below 0 stand for no token."""
        key = left << 20 | right
        at = np.searchsorted(self.keys, key)
        at[at == len(self.keys)] = 0
        return np.where((self.keys[at] == key) & (left >= 0) & (right >= 0), self.values[at], NONE)

    def encode_many(self, pieces: list[bytes]) -> list[list[int]]:
        """Encodes short pieces, one row of trees each."""
        out: list[list[int]] = [[] for _ in pieces]
        lengths = np.array([len(p) for p in pieces])
        width = 2
        while width <= SIDE_BY_SIDE:
            rows = np.flatnonzero((lengths <= width) & (lengths > (width // 2 if width > 2 else 0)))
            if len(rows):
                self._rows(pieces, rows, lengths, width, out)
            width *= 2
        return out

    def _rows(self, pieces, rows, lengths, width, out) -> None:
        n = len(rows)
        raw = np.frombuffer(b"".join(pieces[i].ljust(width, b"\0") for i in rows), np.uint8).reshape(n, width)
        ids = self.byte_ids[raw]
        place = np.arange(width)
        ids[place >= lengths[rows][:, None]] = -1
        after = np.broadcast_to(place + 1, (n, width)).copy()
        before = np.broadcast_to(place - 1, (n, width)).copy()
        tree = np.full((n, 2 * width), NONE)
        rank = self.of_pairs(ids[:, :-1], ids[:, 1:])
        tree[:, width : 2 * width - 1] = np.where(rank == NONE, NONE, rank << 7 | place[:-1])
        level = width // 2
        while level:
            tree[:, level : 2 * level] = np.minimum(tree[:, 2 * level : 4 * level : 2], tree[:, 2 * level + 1 : 4 * level : 2])
            level //= 2
        live = np.flatnonzero(tree[:, 1] < NONE)
        while len(live):
            root = tree[live, 1]
            at, rank = root & 127, root >> 7
            gone = after[live, at]
            nxt = after[live, gone]
            ids[live, at], ids[live, gone] = rank, -1
            after[live, at] = nxt
            inside = nxt < width
            before[live[inside], nxt[inside]] = at[inside]
            follow = np.where(inside, ids[live, np.minimum(nxt, width - 1)], -1)
            self._put(tree, live, at, self.of_pairs(rank, follow), width)
            self._put(tree, live, gone, np.full(len(live), NONE), width)
            prev = before[live, at]
            some = prev >= 0
            if some.any():
                who, prev = live[some], prev[some]
                self._put(tree, who, prev, self.of_pairs(ids[who, prev], rank[some]), width)
            live = live[tree[live, 1] < NONE]
        for i, row in zip(rows.tolist(), ids.tolist(), strict=True):
            out[i] = [x for x in row if x >= 0]

    @staticmethod
    def _put(tree, rows, at, rank, width) -> None:
        """Sets one leaf in each row and what stands above it."""
        node = at + width
        tree[rows, node] = np.where(rank == NONE, NONE, rank << 7 | at)
        while width > 1:
            node = node >> 1
            width >>= 1
            tree[rows, node] = np.minimum(tree[rows, 2 * node], tree[rows, 2 * node + 1])

    def encode_one(self, piece: bytes) -> list[int]:
        """Encodes a piece of any length on a tree of its own."""
        n, pairs, far = len(piece), self.pairs, 1 << 62
        ids = self.byte_ids[np.frombuffer(piece, np.uint8)].tolist()
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        width = 1 << max(1, (n - 1).bit_length())
        tree = [far] * (2 * width)
        for i in range(n - 1):
            rank = pairs.get(ids[i] << 20 | ids[i + 1])
            if rank is not None:
                tree[width + i] = rank << 32 | i
        for k in range(width - 1, 0, -1):
            tree[k] = min(tree[2 * k], tree[2 * k + 1])

        def put(i: int, value: int) -> None:
            k = i + width
            tree[k] = value
            k >>= 1
            while k:
                low = min(tree[2 * k], tree[2 * k + 1])
                if tree[k] == low:
                    return
                tree[k] = low
                k >>= 1

        while tree[1] < far:
            rank, at = tree[1] >> 32, tree[1] & 0xFFFFFFFF
            gone = after[at]
            nxt = after[gone]
            ids[at], ids[gone], after[at] = rank, -1, nxt
            put(gone, far)
            if nxt < n:
                before[nxt] = at
                more = pairs.get(rank << 20 | ids[nxt])
            else:
                more = None
            put(at, far if more is None else more << 32 | at)
            if (prev := before[at]) >= 0:
                more = pairs.get(ids[prev] << 20 | rank)
                put(prev, far if more is None else more << 32 | prev)
        return [x for x in ids if x >= 0]

    def decode(self, ids: list[int]) -> bytes:
        return b"".join([self.tokens[i] for i in ids])


class Encoder:
    """Encodes batches of texts; keeps what short pieces gave, up to a bound."""

    def __init__(self, path: str, pattern: str):
        self.ranks, self.find, self.cache = Ranks(path), regex.compile(pattern).findall, {}

    def pieces(self, texts: Iterator[str]) -> Iterator[list[tuple[str, bytes]]]:
        """For each text its pieces: the ids joined by commas, and the bytes that the ids decode to."""
        cache, ranks = self.cache, self.ranks
        while some := list(islice(texts, 512)):
            found = [self.find(t) for t in some]
            new = [w for w in set().union(*found) if w not in cache]
            data = [w.encode() for w in new]
            short = [i for i, b in enumerate(data) if len(b) <= SIDE_BY_SIDE]
            coded = dict(zip(short, ranks.encode_many([data[i] for i in short]), strict=True))
            local = {}
            for i, w in enumerate(new):
                ids = coded[i] if i in coded else ranks.encode_one(data[i])
                local[w] = (",".join(map(str, ids)), ranks.decode(ids))
            if len(cache) < CACHE:
                cache.update((new[i], local.pop(new[i])) for i in short)
            get = cache.get
            for words in found:
                yield [get(w) or local[w] for w in words] if local else [cache[w] for w in words]


@functools.lru_cache(2)
def encoder(path: str, pattern: str) -> Encoder:
    """One for each Python worker, whose cache serves all its tasks."""
    return Encoder(path, pattern)


def encode(docs: DataFrame, ranks_path: str, pattern: str, *, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """The id, n_tokens, ids_sha256 and decoded_sha256 of each document; with_ids: also the ids (array) and the decoded bytes."""
    kind = dict(docs.dtypes)[id_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = encoder(ranks_path, pattern).pieces
        for batch in batches:
            rows: dict[str, list] = {c: [] for c in ("n_tokens", "ids_sha256", "decoded_sha256", *(("ids", "decoded") if with_ids else ()))}
            for items in pieces(values(batch.column(1))):
                ids, decoded = ",".join([x[0] for x in items]), b"".join([x[1] for x in items])
                rows["n_tokens"].append(ids.count(",") + bool(items))
                rows["ids_sha256"].append(hashlib.sha256(ids.encode()).hexdigest())
                rows["decoded_sha256"].append(hashlib.sha256(decoded).hexdigest())
                if with_ids:
                    rows["ids"].append([int(x) for x in ids.split(",") if x])
                    rows["decoded"].append(decoded)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(v, {"n_tokens": pa.int64(), "ids": pa.list_(pa.int32()), "decoded": pa.binary()}.get(c, pa.string())) for c, v in rows.items())], [id_col, *rows])

    schema = f"`{id_col}` {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>, decoded binary" * with_ids
    return docs.select(id_col, F.coalesce(F.col(text_col), F.lit("")).alias("text")).mapInArrow(lean(run), schema)


def decode(encoded: DataFrame, ranks_path: str, *, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """The id and the decoded bytes of each row of ids (null: empty). An id outside the vocabulary fails the job."""
    kind = dict(encoded.dtypes)[id_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranks = Ranks(ranks_path)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([ranks.decode(x or []) for x in batch.column(1).to_pylist()], pa.binary())], [id_col, "decoded"])

    return encoded.select(id_col, ids_col).mapInArrow(run, f"`{id_col}` {kind}, decoded binary")
