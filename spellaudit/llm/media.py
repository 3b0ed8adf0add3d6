"""Media columns: byte payloads as Netpbm or BMP images, read back as numpy arrays, with tiles and difference hashes.

``encode_*`` and ``decode_image`` are the formats (8-bit samples, stored losslessly). ``area_resize`` makes each output
sample the mean of the input area under it, from an integral image, so its cost does not depend on the scale.
``difference_hash`` compares neighbours of a 9 x 8 resize. ``tile_bytes`` are the resized tile as an NPY file.

Null text counts as empty, and an empty payload is all padding. Payloads of any length are stored whole. Equal texts
give equal values in every column, so repeated rows repeat their results. Empty tables give empty results. Columns other than the id and the
text are ignored.
"""

from __future__ import annotations

import hashlib
import io
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Samples in a row; padding is up to a multiple of BLOCK samples.
WIDTH, BLOCK = 24, 576
PAD = b"\xff"


def pad(payload: bytes) -> bytes:
    return payload.ljust(max(1, -(-len(payload) // BLOCK)) * BLOCK, PAD)


def encode_pgm(samples: bytes, width: int = WIDTH) -> bytes:
    return b"P5\n%d %d\n255\n" % (width, len(samples) // width) + samples


def encode_bmp(samples: bytes, width: int = WIDTH) -> bytes:
    """8-bit grey, rows from the bottom; width divides by 4, so rows need no filling."""
    height = len(samples) // width
    palette = bytes(x for i in range(256) for x in (i, i, i, 0))
    head = struct.pack("<2sIHHIIiiHHIIiiII", b"BM", 54 + 1024 + len(samples), 0, 0, 54 + 1024, 40, width, height, 1, 8, 0, len(samples), 2835, 2835, 256, 0)
    return head + palette + np.frombuffer(samples, np.uint8).reshape(height, width)[::-1].tobytes()


def decode_image(stored: bytes) -> np.ndarray:
    """Height x width for grey PGM (P5, P2) and 8-bit BMP, height x width x 3 for PPM (P6) and 24-bit BMP."""
    if stored[:2] == b"BM":
        start, _, width, height, _, bits, packed = struct.unpack_from("<IIiiHHI", stored, 10)
        if packed or bits not in (8, 24):
            raise ValueError("only plain BMP of 8 or 24 bits")
        each = bits // 8
        stride = -(-width * each // 4) * 4
        rows = np.frombuffer(stored, np.uint8, stride * abs(height), start).reshape(abs(height), stride)[:, : width * each]
        rows = rows[::-1] if height > 0 else rows
        return rows if each == 1 else rows.reshape(abs(height), width, 3)[:, :, ::-1]
    fields, at = [], 2
    while len(fields) < 3:
        while stored[at : at + 1].isspace() or stored[at : at + 1] == b"#":
            at = stored.index(b"\n", at) + 1 if stored[at : at + 1] == b"#" else at + 1
        end = at
        while stored[end : end + 1].isdigit():
            end += 1
        if end == at:
            raise ValueError("not a Netpbm image")
        fields.append(int(stored[at:end]))
        at = end
    width, height, most = fields
    if most > 255 or stored[:2] not in (b"P2", b"P5", b"P6"):
        raise ValueError("only P2, P5 and P6 of 8 bits")
    if stored[:2] == b"P2":
        return np.array(stored[at:].split()[: width * height], np.uint8).reshape(height, width)
    shape = (height, width) if stored[:2] == b"P5" else (height, width, 3)
    return np.frombuffer(stored, np.uint8, int(np.prod(shape)), at + 1).reshape(shape)


def area_resize(image: np.ndarray, height: int, width: int) -> np.ndarray:
    """Means of the areas, as float64; an output sample that covers parts of samples weighs them by their parts."""
    full = np.zeros((image.shape[0] + 1, image.shape[1] + 1))
    full[1:, 1:] = image.cumsum(0, dtype=np.float64).cumsum(1)

    def at(edges: np.ndarray, table: np.ndarray) -> np.ndarray:
        low = np.minimum(edges.astype(np.int64), len(table) - 2)
        part = (edges - low)[:, None]
        return table[low] * (1 - part) + table[low + 1] * part

    down = at(np.arange(height + 1) * image.shape[0] / height, full)
    both = at(np.arange(width + 1) * image.shape[1] / width, down.T).T
    return np.diff(np.diff(both, axis=0), axis=1) / (image.shape[0] / height * image.shape[1] / width)


def difference_hash(image: np.ndarray) -> str:
    """64 bits as hex: whether a sample of the 9 x 8 resize is below the next one of its row."""
    # rounding keeps equal areas equal
    small = area_resize(image, 8, 9).round(6)
    return np.packbits(small[:, :-1] < small[:, 1:]).tobytes().hex()


def tile_bytes(image: np.ndarray, side: int) -> bytes:
    """The NPY file of the image resized to side x side samples of 8 bits."""
    out = io.BytesIO()
    np.save(out, area_resize(image, side, side).round().astype(np.uint8))
    return out.getvalue()


def media_columns(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", form: str = "pgm", tile: int = 16, keep_bytes: bool = False) -> DataFrame:
    """Per row: n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature and tile_sha256; keep_bytes: also media and tile.

    What is told of the payload is computed from the samples of the image as decoded again.
    """
    make = {"pgm": encode_pgm, "bmp": encode_bmp}[form]
    kind = dict(docs.dtypes)[id_col]
    fields = {"n_bytes": pa.int64(), "payload_bytes": pa.int64(), "payload_sha256": pa.string(), "tail_crc32": pa.int64(), "media_bytes": pa.int64(), "media_sha256": pa.string(), "feature": pa.string(), "tile_sha256": pa.string()}
    if keep_bytes:
        fields |= {"media": pa.binary(), "tile": pa.binary()}

    def row(raw: bytes) -> tuple:
        stored = make(pad(raw))
        image = decode_image(stored)
        back, small = image.tobytes(), tile_bytes(image, tile)
        sha = hashlib.sha256
        told = (len(raw), len(back), sha(back).hexdigest(), zlib.crc32(back[-32:]), len(stored), sha(stored).hexdigest(), difference_hash(image), sha(small).hexdigest())
        return (*told, stored, small) if keep_bytes else told

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = list(zip(*(row(x) for x in batch.column(1).to_pylist()), strict=True)) or [[] for _ in fields]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(v, t) for v, t in zip(rows, fields.values(), strict=True))], [id_col, *fields])

    ddl = {pa.int64(): "long", pa.string(): "string", pa.binary(): "binary"}
    return docs.select(id_col, F.encode(F.coalesce(F.col(text_col), F.lit("")), "UTF-8").alias("raw")).mapInArrow(run, f"`{id_col}` {kind}, " + ", ".join(f"{c} {ddl[t]}" for c, t in fields.items()))
