"""Media columns: Netpbm and BMP bytes decoded to numpy, area-resized by integral images, kept as NPY tiles with difference hashes.

Each task decodes its own rows and nothing is shuffled. A null, empty or undecodable image gives null outputs and ok = false;
zero-sized images count as undecodable. Equal bytes give equal outputs.
"""

from __future__ import annotations

import hashlib
import io
import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A text is stored as an image of this many bytes a row: 64 pixels of 3 samples.
ROW_BYTES = 192


def _netpbm_header(data: bytes, fields: int) -> tuple[list[int], int]:
    found, at = [], 2
    token = re.compile(rb"(?:[ \t\r\n]|#[^\n]*\n)*([0-9]+)")
    while len(found) < fields:
        m = token.match(data, at)
        if not m:
            raise ValueError("bad Netpbm header")
        found.append(int(m[1]))
        at = m.end()
    return found, at


def decode_netpbm(data: bytes) -> np.ndarray:
    """P1 to P6 as (height, width, channels), uint8 or, above 255, uint16."""
    kind = data[1:2]
    (width, height, *top), at = _netpbm_header(data, 2 if kind in b"14" else 3)
    top = top[0] if top else 1
    channels = 3 if kind in b"36" else 1
    n = width * height * channels
    if n > 8 * len(data) or top > 65_535:
        raise ValueError("header larger than its data")
    if kind in b"123":
        body = re.sub(rb"#[^\n]*", b"", data[at:])
        values = re.findall(rb"[01]" if kind == b"1" else rb"[0-9]+", body)[:n]
        numbers = [int(v) for v in values]
        if max(numbers, default=0) > top:
            raise ValueError("sample above the maximum")
        out = np.array(numbers, np.uint16 if top > 255 else np.uint8)
    elif kind == b"4":
        rows = np.frombuffer(data, np.uint8, height * ((width + 7) // 8), at + 1).reshape(height, -1)
        out = np.unpackbits(rows, axis=1)[:, :width]
    elif top > 255:
        out = np.frombuffer(data, ">u2", n, at + 1).astype(np.uint16)
    else:
        out = np.frombuffer(data, np.uint8, n, at + 1)
    if kind in b"14":
        out = (1 - out) * np.uint8(255)
    return out.reshape(height, width, channels)


def decode_bmp(data: bytes) -> np.ndarray:
    """Uncompressed 8, 24 and 32 bit BMP as (height, width, 3) uint8."""
    start, head, width, height, _, bits, packed = struct.unpack_from("<IIiiHHI", data, 10)
    if packed not in (0, 3) or bits not in (8, 24, 32) or width <= 0:
        raise ValueError("unsupported BMP")
    step = (width * bits // 8 + 3) // 4 * 4
    rows = np.frombuffer(data, np.uint8, step * abs(height), start).reshape(abs(height), step)[:, : width * bits // 8]
    if bits == 8:
        palette = np.frombuffer(data, np.uint8, (start - 14 - head) // 4 * 4, 14 + head).reshape(-1, 4)
        out = palette[rows][:, :, 2::-1]
    else:
        out = rows.reshape(abs(height), width, bits // 8)[:, :, 2::-1]
    return out[::-1] if height > 0 else out


def decode(data: bytes) -> np.ndarray:
    if data[:1] == b"P" and data[1:2] in b"123456" and len(data) > 2:
        out = decode_netpbm(data)
    elif data[:2] == b"BM":
        out = decode_bmp(data)
    else:
        raise ValueError("neither Netpbm nor BMP")
    if not out.size:
        raise ValueError("empty image")
    return out


def encode_ppm(samples: np.ndarray) -> bytes:
    height, width, _ = samples.shape
    return b"P6\n%d %d\n255\n" % (width, height) + samples.tobytes()


def encode_bmp(samples: np.ndarray) -> bytes:
    height, width, _ = samples.shape
    rows = np.zeros((height, (width * 3 + 3) // 4 * 4), np.uint8)
    rows[:, : width * 3] = samples[::-1, :, ::-1].reshape(height, -1)
    size = 54 + rows.size
    return struct.pack("<2sIHHIIiiHHIIiiII", b"BM", size, 0, 0, 54, 40, width, height, 1, 24, 0, rows.size, 2835, 2835, 0, 0) + rows.tobytes()


def gray(samples: np.ndarray) -> np.ndarray:
    x = samples.astype(np.float64)
    if samples.dtype == np.uint16:
        x /= 257.0
    return x[:, :, 0] if x.shape[2] == 1 else x @ np.array([0.299, 0.587, 0.114])


def _sums_at(total: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """The prefix sums along axis 0 at fractional edges."""
    low = np.minimum(edges.astype(np.int64), total.shape[0] - 2)
    part = (edges - low)[:, None]
    return total[low] * (1 - part) + total[low + 1] * part


def area_resize(image: np.ndarray, height: int, width: int) -> np.ndarray:
    """Mean over each target cell's exact area, from the integral image interpolated at fractional cell edges."""
    h, w = image.shape
    total = np.zeros((h + 1, w + 1))
    total[1:, 1:] = image.cumsum(0).cumsum(1)
    rows = _sums_at(total, np.linspace(0, h, height + 1))
    cells = _sums_at(np.ascontiguousarray(rows.T), np.linspace(0, w, width + 1)).T
    area = np.diff(np.diff(cells, axis=0), axis=1)
    return area / ((h / height) * (w / width))


def difference_hash(image: np.ndarray) -> str:
    """64 bits, most significant first: whether each of 8 x 9 cells is darker than its right neighbour, as 16 hex digits."""
    cells = np.round(area_resize(image, 8, 9), 6)
    return np.packbits(cells[:, :-1] < cells[:, 1:]).tobytes().hex()


def npy(array: np.ndarray) -> bytes:
    out = io.BytesIO()
    np.save(out, array, allow_pickle=False)
    return out.getvalue()


def _binary(values: list) -> pa.Array:
    return pa.array(values, pa.large_binary()).cast(pa.binary())


def media_tiles(df: DataFrame, key: str, column: str, tile: int = 32) -> DataFrame:
    """Per row of df: key, ok, height, width, channels, tile (NPY bytes of a tile x tile uint8 gray image), dhash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: dict[str, list] = {k: [] for k in ("ok", "height", "width", "channels", "tile", "dhash")}
            for data in b.column(1):
                row = [False, None, None, None, None, None]
                try:
                    samples = decode(data.as_py() or b"")
                    small = gray(samples)
                    made = np.clip(np.rint(area_resize(small, tile, tile)), 0, 255).astype(np.uint8)
                    row = [True, *samples.shape, npy(made), difference_hash(small)]
                except (ValueError, IndexError, OverflowError, struct.error):
                    pass
                for k, v in zip(out, row, strict=True):
                    out[k].append(v)
            kinds = (pa.bool_(), pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.string())
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(v, t) for v, t in zip(out.values(), kinds, strict=True))], ["key", *out])

    rows = df.select(F.col(key).alias("key"), F.col(column).cast("binary").alias("media"))
    kind = rows.schema["key"].dataType.simpleString()
    return rows.mapInArrow(run, f"key {kind}, ok boolean, height int, width int, channels int, tile binary, dhash string").withColumnRenamed("key", key)


def text_to_media(df: DataFrame, key: str = "doc_id", column: str = "text") -> DataFrame:
    """Each text's UTF-8 bytes, padded with spaces to whole rows of 192 bytes, as a stored image: key, n_bytes, media.

    An even number of rows is stored as BMP, an odd one as binary PPM. A null text counts as empty and gives one row of spaces.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sizes, stored = [], []
            for text in b.column(1):
                raw = (text.as_py() or "").encode()
                rows = max(1, -(-len(raw) // ROW_BYTES))
                samples = np.frombuffer(raw.ljust(rows * ROW_BYTES, b" "), np.uint8).reshape(rows, ROW_BYTES // 3, 3)
                sizes.append(len(raw))
                stored.append(encode_ppm(samples) if rows % 2 else encode_bmp(samples))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sizes, pa.int64()), pa.array(stored, pa.binary())], ["key", "n_bytes", "media"])

    rows = df.select(F.col(key).alias("key"), F.col(column).cast("string").alias("text"))
    kind = rows.schema["key"].dataType.simpleString()
    return rows.mapInArrow(run, f"key {kind}, n_bytes long, media binary").withColumnRenamed("key", key)


def media_digest(df: DataFrame, key: str = "doc_id") -> DataFrame:
    """Reads stored media back: payload size and digests, media size and digest, and the feature dhash:tile digest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[list] = [[] for _ in range(6)]
            for data in b.column(2):
                media = data.as_py()
                samples = decode(media)
                payload = samples.tobytes()
                small = gray(samples)
                tile = npy(np.clip(np.rint(area_resize(small, 32, 32)), 0, 255).astype(np.uint8))
                row = (len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(media), hashlib.sha256(media).hexdigest(), f"{difference_hash(small)}:{hashlib.sha256(tile).hexdigest()[:16]}")
                for k, v in zip(out, row, strict=True):
                    k.append(v)
            kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
            arrays = [pa.array(v, t) for v, t in zip(out, kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *arrays], ["key", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"])

    kind = df.schema[key].dataType.simpleString()
    rows = df.select(F.col(key).alias("key"), "n_bytes", "media")
    schema = f"key {kind}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    return rows.mapInArrow(run, schema).withColumnRenamed("key", key)
