import struct
import zlib

import numpy as np
import pytest

from lattica.sources import images as I


def tiff(px, end, compression=1, predictor=1, invert=False):
    bits = px.dtype.itemsize * 8
    v = np.diff(px, axis=1, prepend=np.zeros((len(px), 1), px.dtype)) if predictor == 2 else px
    if invert:
        v = (2**bits - 1 - v).astype(px.dtype)
    raw = v.astype(px.dtype.newbyteorder(end)).tobytes()
    half = len(px) // 2 * px.shape[1] * px.dtype.itemsize
    pack = {1: bytes, 8: zlib.compress, 32773: lambda b: b"".join(bytes([len(b[i : i + 100]) - 1]) + b[i : i + 100] for i in range(0, len(b), 100)) + b"\x80"}[compression]
    strips = [pack(raw[:half]), pack(raw[half:])]
    tags = [(256, 3, px.shape[1]), (257, 3, px.shape[0]), (258, 3, bits), (259, 3, compression), (262, 3, 0 if invert else 1), (273, 4, None), (277, 3, 1), (278, 3, len(px) // 2), (279, 4, None), (317, 3, predictor)]
    base = 8 + 2 + 12 * len(tags) + 4
    lists = {273: (base + 16, base + 16 + len(strips[0])), 279: tuple(map(len, strips))}
    out = (b"II*\0" if end == "<" else b"MM\0*") + struct.pack(end + "IH", 8, len(tags))
    for k, (t, kind, v) in enumerate(tags):
        if v is None:
            out += struct.pack(end + "HHII", t, kind, 2, base + 8 * (t == 279))
        else:
            out += struct.pack(end + "HHI", t, kind, 1) + (struct.pack(end + "HH", v, 0))
    return out + struct.pack(end + "I", 0) + struct.pack(end + "II", *lists[273]) + struct.pack(end + "II", *lists[279]) + b"".join(strips)


@pytest.mark.parametrize("end", ["<", ">"])
@pytest.mark.parametrize(("compression", "predictor", "invert"), [(1, 1, False), (8, 1, False), (8, 2, False), (32773, 1, True)])
@pytest.mark.parametrize("kind", [np.uint8, np.uint16])
def test_tiff(end, compression, predictor, invert, kind):
    px = np.random.default_rng(1).integers(0, np.iinfo(kind).max, (6, 9)).astype(kind)
    got, bits = I.decode_image(tiff(px, end, compression, predictor, invert))
    assert (got == px).all() and bits == px.dtype.itemsize * 8


@pytest.mark.parametrize("bits", [8, 24, 32])
@pytest.mark.parametrize("up", [1, -1])
def test_bmp(bits, up):
    px = np.random.default_rng(2).integers(0, 255, (5, 7)).astype(np.uint8)
    rows = px[::-1] if up > 0 else px
    lines = rows if bits == 8 else np.stack([rows * 0, rows * 0, rows, rows * 0], axis=2)[:, :, : bits // 8].reshape(5, -1)
    lines = np.pad(lines, ((0, 0), (0, -lines.shape[1] % 4)))
    palette = b"".join(bytes([0, 0, k, 0]) for k in range(256)) if bits == 8 else b""
    start = 54 + len(palette)
    head = struct.pack("<2sIHHIIiiHHIIiiII", b"BM", start + lines.size, 0, 0, start, 40, 7, 5 * up, 1, bits, 0, 0, 0, 0, 0, 0)
    assert (I.decode_image(head + palette + lines.tobytes())[0] == px).all()


def test_files_of_all_kinds(spark, tmp_path):
    px = np.arange(24, dtype=np.uint8).reshape(4, 6)
    (tmp_path / "a.tif").write_bytes(tiff(px, "<"))
    (tmp_path / "b.png").write_bytes(I.encode_png(px, 8))
    (tmp_path / "c.tiff").write_bytes(b"II*\0broken")
    got = {r.path.rsplit("/", 1)[1]: r for r in I.read_images(spark, str(tmp_path)).collect()}
    assert got["a.tif"].data == got["b.png"].data == px.ravel().tolist() and got["a.tif"].h == 4
    assert got["c.tiff"].error and got["c.tiff"].data is None
