"""Image files as rows: PNG, TIFF, BMP and NumPy arrays, read and written by NumPy alone."""

from __future__ import annotations

import io
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_MAGIC = b"\x89PNG\r\n\x1a\n"
SCHEMA = "path string, h int, w int, bpp int, data array<double>, error string"


def _unfiltered(raw: bytes, height: int, stride: int, size: int) -> np.ndarray:
    """Bytes of a PNG's rows without their filters; ``size`` is the bytes of a pixel."""
    rows = np.frombuffer(raw, np.uint8).reshape(height, stride + 1)
    out = np.zeros((height, stride), np.uint8)
    above = np.zeros(stride, np.uint8)
    for i in range(height):
        kind, line = int(rows[i, 0]), rows[i, 1:]
        if kind == 0:
            cur = line
        elif kind == 2:
            cur = line + above
        elif kind == 1:
            # Sums modulo 256 along each byte of the pixels.
            cur = np.cumsum(line.reshape(-1, size), axis=0, dtype=np.uint8).ravel()
        else:
            cur = np.zeros(stride, np.uint8)
            for k in range(stride):
                a = int(cur[k - size]) if k >= size else 0
                b, c = int(above[k]), int(above[k - size]) if k >= size else 0
                p = a + b - c
                near = min((abs(p - a), 0, a), (abs(p - b), 1, b), (abs(p - c), 2, c))[2]
                cur[k] = (int(line[k]) + ((a + b) // 2 if kind == 3 else near)) & 255
        out[i] = above = cur
    return out


def decode_png(content: bytes) -> tuple[np.ndarray, int]:
    """Pixels (first channel) and bits of a PNG that isn't interlaced."""
    if content[:8] != _MAGIC:
        raise ValueError("no PNG")
    at, data, head = 8, b"", None
    while at + 8 <= len(content):
        n, kind = struct.unpack(">I4s", content[at : at + 8])
        body = content[at + 8 : at + 8 + n]
        if kind == b"IHDR":
            head = struct.unpack(">IIBBBBB", body)
        elif kind == b"IDAT":
            data += body
        at += n + 12
    if head is None or head[6] or head[2] not in (8, 16) or head[3] == 3:
        raise ValueError("kind of PNG not supported")
    width, height, bits, colour = head[:4]
    channels = {0: 1, 2: 3, 4: 2, 6: 4}[colour]
    size = channels * bits // 8
    rows = _unfiltered(zlib.decompress(data), height, width * size, size)
    px = rows.reshape(height, width, channels, bits // 8)[:, :, 0]
    return (px[:, :, 0].astype(np.float64) * 256 + px[:, :, 1] if bits == 16 else px[:, :, 0].astype(np.float64)), bits


def _unpacked(data: bytes) -> bytes:
    """Bytes of a run-length coded strip."""
    out, i = bytearray(), 0
    while i < len(data):
        n = data[i]
        if n < 128:
            out += data[i + 1 : i + 2 + n]
            i += n + 2
        else:
            if n > 128:
                out += data[i + 1 : i + 2] * (257 - n)
            i += 2 if n > 128 else 1
    return bytes(out)


#: TIFF: bytes of a value by its type, and the tags read. Fixed values.
_TIFF_SIZES = {1: 1, 2: 1, 3: 2, 4: 4, 16: 8}
_TIFF_TAGS = {256: "width", 257: "height", 258: "bits", 259: "compression", 262: "photometric", 273: "offsets", 277: "samples", 278: "rows", 279: "counts", 284: "planar", 317: "predictor"}


def decode_tiff(content: bytes) -> tuple[np.ndarray, int]:
    """Pixels (first channel) and bits of a TIFF's first image: strips of 8 or 16 bits, plain, deflated or run-length coded."""
    end = {b"II*\0": "<", b"MM\0*": ">"}.get(content[:4])
    if end is None:
        raise ValueError("no TIFF")
    (at,) = struct.unpack(end + "I", content[4:8])
    (entries,) = struct.unpack(end + "H", content[at : at + 2])
    tag: dict[str, tuple[int, ...]] = {"bits": (1,), "compression": (1,), "photometric": (1,), "samples": (1,), "planar": (1,), "predictor": (1,)}
    for k in range(entries):
        place = at + 2 + 12 * k
        number, kind, n = struct.unpack(end + "HHI", content[place : place + 8])
        if number in _TIFF_TAGS and kind in (1, 3, 4, 16):
            size = _TIFF_SIZES[kind] * n
            start = place + 8 if size <= 4 else struct.unpack(end + "I", content[place + 8 : place + 12])[0]
            tag[_TIFF_TAGS[number]] = struct.unpack(f"{end}{n}{ {1: 'B', 3: 'H', 4: 'I', 16: 'Q'}[kind] }", content[start : start + size])
    bits, samples, (compression,) = tag["bits"][0], tag["samples"][0], tag["compression"]
    unpack = {1: bytes, 8: zlib.decompress, 32946: zlib.decompress, 32773: _unpacked}.get(compression)
    if bits not in (8, 16) or unpack is None or "offsets" not in tag or tag["planar"] != (1,) or tag["photometric"][0] == 3:
        raise ValueError("kind of TIFF not supported")
    (height,), (width,) = tag["height"], tag["width"]
    raw = b"".join(unpack(content[o : o + n]) for o, n in zip(tag["offsets"], tag["counts"], strict=True))
    px = np.frombuffer(raw, f"{end}u{bits // 8}", height * width * samples).reshape(height, width, samples)
    if tag["predictor"] == (2,):
        px = np.cumsum(px, axis=1, dtype=px.dtype.newbyteorder("="))
    first = px[:, :, 0].astype(np.float64)
    return (2**bits - 1 - first if tag["photometric"] == (0,) else first), bits


def decode_bmp(content: bytes) -> tuple[np.ndarray, int]:
    """Pixels (red channel, or the palette's) and bits of an uncompressed BMP of 8, 24 or 32 bits."""
    if content[:2] != b"BM":
        raise ValueError("no BMP")
    start, head, width, height, _, bits, packed = struct.unpack("<IIiiHHI", content[10:34])
    if bits not in (8, 24, 32) or packed not in (0, 3):
        raise ValueError("kind of BMP not supported")
    stride, rows = (width * bits // 8 + 3) // 4 * 4, abs(height)
    lines = np.frombuffer(content, np.uint8, rows * stride, start).reshape(rows, stride)
    if bits == 8:
        table = np.frombuffer(content, np.uint8, start - 14 - head, 14 + head).reshape(-1, 4)[:, 2]
        px = table[lines[:, :width]]
    else:
        px = lines[:, : width * bits // 8].reshape(rows, width, bits // 8)[:, :, 2]
    return (px[::-1] if height > 0 else px).astype(np.float64), 8


def encode_png(image: np.ndarray, bits: int) -> bytes:
    """PNG of grey pixels: whole numbers as they are, rescaled if they don't fit; floats up to 1 times the largest number."""
    top = 2**bits - 1
    v = np.asarray(image, float)
    if v.size and v.max() <= 1 and (v != np.floor(v)).any():
        v = v * top
    elif v.size and v.max() > top:
        v = v * (top / v.max())
    px = np.clip(np.floor(v), 0, top).astype(">u2" if bits == 16 else np.uint8)
    raw = b"".join(b"\0" + row.tobytes() for row in px)
    chunk = lambda kind, body: struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))
    return _MAGIC + chunk(b"IHDR", struct.pack(">IIBBBBB", px.shape[1], px.shape[0], bits, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b"")


def decode_image(content: bytes) -> tuple[np.ndarray, int]:
    """Pixels and bits of an image file, whose kind its first bytes tell."""
    kind = {b"II": decode_tiff, b"MM": decode_tiff, b"BM": decode_bmp}.get(content[:2], decode_png)
    return kind(content)


def read_images(spark: SparkSession, path: str, glob: str = "*.{png,npy,tif,tiff,bmp}") -> DataFrame:
    """(path, h, w, bpp, data, error) of the images below ``path``. One that can't be read has a row with its error."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                try:
                    if name.endswith(".npy"):
                        px = np.load(io.BytesIO(content))
                        bits = px.dtype.itemsize * 8
                    else:
                        px, bits = decode_image(content)
                    rows.append((name, px.shape[0], px.shape[1], bits, px.astype(float).ravel().tolist(), None))
                except Exception as e:  # noqa: BLE001
                    rows.append((name, None, None, None, None, f"{type(e).__name__}: {e}"))
            kinds = [pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.list_(pa.float64()), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], ["path", "h", "w", "bpp", "data", "error"])

    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(path)
    return files.select("path", "content").mapInArrow(run, SCHEMA)


def encoded(images: DataFrame, bits: int) -> DataFrame:
    """(name, content) of images (name, h, w, data) as PNG, ready for a sink of binary rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            content = [encode_png(np.array(d, float).reshape(h, w), bits) for h, w, d in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(content, pa.binary())], ["name", "content"])

    return images.select("name", "h", "w", "data").mapInArrow(run, "name string, content binary")


def write_files(files: DataFrame, folder: str) -> DataFrame:
    """Writes rows (name, content) as files of a folder all executors share; gives (name, bytes). A file appears whole or not at all."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        os.makedirs(folder, exist_ok=True)
        for batch in batches:
            sizes = []
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                part = os.path.join(folder, f".{name}.{os.getpid()}")
                with open(part, "wb") as f:
                    f.write(content)
                os.replace(part, os.path.join(folder, name))
                sizes.append(len(content))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64())], ["name", "bytes"])

    return files.select("name", "content").mapInArrow(run, "name string, bytes bigint")


def pixel_kind(mode: F.Column, lo: F.Column, hi: F.Column) -> F.Column:
    """Pixel type by the mode of an image and, for plain integers, its extrema."""
    ladder = F.when(hi <= 255, "uint8").when(hi < 2**15, "int16").when(hi < 2**16, "uint16").when(hi < 2**31, "int32").when(hi < 2**32, "uint32").otherwise("int64")
    bits = F.regexp_extract(mode, r"^[IF];(\d+)", 1)
    return F.when(mode == "1", "bool").when(mode.isin("L", "P", "RGB", "RGBA", "CMYK", "YCbCr", "LAB", "HSV"), "uint8").when(mode.startswith("I;"), F.concat(F.lit("uint"), bits)).when(mode == "I", ladder).when(mode.startswith("F;"), F.concat(F.lit("float"), bits)).when(mode == "F", "float32")
