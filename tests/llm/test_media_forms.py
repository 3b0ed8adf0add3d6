"""The image forms, resizes, hashes and tiles against plain loops."""

import io
import struct

import numpy as np
import pytest

from spellaudit.llm import media

RNG = np.random.default_rng(3)


def test_netpbm():
    grey, colour = RNG.integers(0, 256, (5, 7), np.uint8), RNG.integers(0, 256, (4, 3, 3), np.uint8)
    plain = b"P2 # by hand\n7 5\n# another\n255\n" + b"\n".join(b" ".join(b"%d" % x for x in row) for row in grey)
    assert (media.decode_image(plain) == grey).all()
    assert (media.decode_image(b"P5\n7\t5 255\n" + grey.tobytes()) == grey).all()
    assert (media.decode_image(b"P6 3 4 255\n" + colour.tobytes()) == colour).all()
    for bad in (b"P5\n1 1\n65535\n\0\0", b"P3 1 1 255\n0 0 0", b"P5 x"):
        with pytest.raises(ValueError):
            media.decode_image(bad)


@pytest.mark.parametrize("down", [False, True])
def test_bmp(down):
    image = RNG.integers(0, 256, (4, 5, 3), np.uint8)
    rows = b"".join(row[:, ::-1].tobytes() + b"\0" for row in (image if down else image[::-1]))
    head = struct.pack("<2sIHHIIiiHHIIiiII", b"BM", 54 + len(rows), 0, 0, 54, 40, 5, -4 if down else 4, 1, 24, 0, len(rows), 0, 0, 0, 0)
    assert (media.decode_image(head + rows) == image).all()
    samples = RNG.integers(0, 256, 48 * 24, np.uint8).tobytes()
    assert media.decode_image(media.encode_bmp(samples)).tobytes() == samples
    with pytest.raises(ValueError):
        media.decode_image(head[:28] + struct.pack("<H", 16) + head[30:] + rows)


@pytest.mark.parametrize("size", [(24, 24), (48, 24), (7, 5), (1, 1)])
def test_resize_hash_and_tile(size):
    image = RNG.integers(0, 256, size, np.uint8)

    def mean(height, width, r, c):
        """Of the area under an output sample, each input sample by its share."""
        top, bottom, left, right = r * size[0] / height, (r + 1) * size[0] / height, c * size[1] / width, (c + 1) * size[1] / width
        total = 0.0
        for y in range(size[0]):
            for x in range(size[1]):
                total += image[y, x] * max(0.0, min(bottom, y + 1) - max(top, y)) * max(0.0, min(right, x + 1) - max(left, x))
        return total / ((bottom - top) * (right - left))

    small = np.array([[mean(8, 9, r, c) for c in range(9)] for r in range(8)])
    assert media.area_resize(image, 8, 9) == pytest.approx(small)
    bits = "".join("1" if small[r, c].round(6) < small[r, c + 1].round(6) else "0" for r in range(8) for c in range(8))
    assert media.difference_hash(image) == f"{int(bits, 2):016x}"
    tile = np.load(io.BytesIO(media.tile_bytes(image, 6)))
    assert tile.dtype == np.uint8 and tile == pytest.approx(np.array([[mean(6, 6, r, c) for c in range(6)] for r in range(6)]).round(), abs=1)
