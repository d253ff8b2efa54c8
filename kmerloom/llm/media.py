"""Media columns: Netpbm and BMP images as numpy arrays, area-resized tiles in NPY form, and difference hashes."""

from __future__ import annotations

import io
import re
import struct
from hashlib import sha256
from math import floor
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kmerloom.llm import _common as C

#: Samples in a row of a payload image, height and width of a tile, rows taken at once when resizing.
WIDTH, TILE, BAND = 64, (8, 9), 4096
_TOKEN = re.compile(rb"(?:\s|#[^\n]*\n)*([^\s#]+)")


def encode_pgm(image: np.ndarray) -> bytes:
    """8-bit grey (h, w) or RGB (h, w, 3) samples as binary Netpbm."""
    kind = b"P5" if image.ndim == 2 else b"P6"
    return b"%s\n%d %d\n255\n" % (kind, image.shape[1], image.shape[0]) + np.ascontiguousarray(image, np.uint8).tobytes()


def encode_bmp(image: np.ndarray) -> bytes:
    """8-bit grey samples as an uncompressed BMP with a grey palette, rows bottom-up."""
    h, w = image.shape
    rows = np.zeros((h, -(-w // 4) * 4), np.uint8)
    rows[:, :w] = image[::-1]
    palette = b"".join(bytes((i, i, i, 0)) for i in range(256))
    at = 14 + 40 + len(palette)
    return b"BM" + struct.pack("<IHHI", at + rows.size, 0, 0, at) + struct.pack("<IiiHHIIiiII", 40, w, h, 1, 8, 0, rows.size, 2835, 2835, 256, 0) + palette + rows.tobytes()


def _netpbm(data: bytes) -> np.ndarray:
    kind, at, head = data[:2], 2, []
    for _ in range(2 if kind in (b"P1", b"P4") else 3):
        token = _TOKEN.match(data, at)
        if not token:
            raise ValueError("broken Netpbm header")
        head.append(int(token[1]))
        at = token.end()
    w, h, top = (*head, 1)[:3]
    planes = 3 if kind in (b"P3", b"P6") else 1
    if kind in (b"P1", b"P2", b"P3"):
        body = re.sub(rb"#[^\n]*", b"", data[at:])
        values = np.array([int(x) for x in (re.findall(rb"[01]", body) if kind == b"P1" else body.split())][: w * h * planes])
    else:
        at += 1
        if kind == b"P4":
            values = np.unpackbits(np.frombuffer(data, np.uint8, h * -(-w // 8), at).reshape(h, -1), axis=1)[:, :w]
        else:
            values = np.frombuffer(data, np.uint8 if top < 256 else ">u2", w * h * planes, at)
    if values.size != w * h * planes:
        raise ValueError("short Netpbm data")
    if kind in (b"P1", b"P4"):
        return ((1 - values) * 255).astype(np.uint8).reshape(h, w)
    values = values if top == 255 else (values.astype(np.int64) * 255 + top // 2) // top
    return values.astype(np.uint8).reshape((h, w, 3) if planes == 3 else (h, w))


def _bmp(data: bytes) -> np.ndarray:
    at, size = struct.unpack_from("<I", data, 10)[0], struct.unpack_from("<I", data, 14)[0]
    w, h, _, bits, packing = struct.unpack_from("<iiHHI", data, 18)
    if packing or bits not in (8, 24, 32):
        raise ValueError("only uncompressed 8, 24 and 32-bit BMP")
    step, tall = -(-w * bits // 32) * 4, abs(h)
    rows = np.frombuffer(data, np.uint8, tall * step, at).reshape(tall, step)[:, : w * bits // 8]
    rows = rows[::-1] if h > 0 else rows
    if bits > 8:
        return np.ascontiguousarray(rows.reshape(tall, w, bits // 8)[:, :, 2::-1])
    palette = np.frombuffer(data, np.uint8, (at - 14 - size) // 4 * 4, 14 + size).reshape(-1, 4)[:, 2::-1]
    image = palette[rows]
    return np.ascontiguousarray(image[:, :, 0]) if (palette == palette[:, :1]).all() else image


def decode_image(data: bytes) -> np.ndarray:
    """Samples of a Netpbm (P1 to P6) or BMP image as uint8, (h, w) or (h, w, 3); ValueError for anything else."""
    try:
        if data[:1] == b"P" and data[1:2] in b"123456":
            return _netpbm(data)
        if data[:2] == b"BM":
            return _bmp(data)
    except (struct.error, IndexError) as error:
        raise ValueError("broken image") from error
    raise ValueError("neither Netpbm nor BMP")


def area_resize(image: np.ndarray, height: int, width: int) -> np.ndarray:
    """Mean of each cell's area, from the integral image at the cell edges (interpolated between samples).

    The integral is built a band of rows at a time and kept only at the rows that cell edges touch.
    """
    h, w = image.shape
    edges = [i * h / height for i in range(height + 1)]
    wanted = sorted({floor(y) for y in edges} | {min(floor(y) + 1, h) for y in edges})
    rows, above = {0: np.zeros(w + 1)}, np.zeros(w + 1)
    for a in range(0, h, BAND):
        band = np.zeros((min(BAND, h - a) + 1, w + 1))
        band[1:, 1:] = image[a : a + BAND]
        band = band.cumsum(0).cumsum(1) + above
        for y in wanted:
            if a < y <= a + len(band) - 1:
                rows[y] = band[y - a]
        above = band[-1]
    x = np.arange(width + 1) * w / width
    left = np.minimum(np.floor(x).astype(int), w)
    right = np.minimum(left + 1, w)

    def at(y: float) -> np.ndarray:
        lo = floor(y)
        line = rows[lo] + (rows[min(lo + 1, h)] - rows[lo]) * (y - lo)
        return line[left] + (line[right] - line[left]) * (x - left)

    table = np.stack([at(y) for y in edges])
    return (table[1:, 1:] - table[:-1, 1:] - table[1:, :-1] + table[:-1, :-1]) / ((h / height) * (w / width))


def tile_of(image: np.ndarray) -> np.ndarray:
    """The image as a TILE of uint8: grey by the mean of planes, area-resized and rounded."""
    grey = image if image.ndim == 2 else image.mean(axis=2)
    return np.rint(area_resize(grey, *TILE)).astype(np.uint8)


def difference_hash(tile: np.ndarray) -> str:
    """16 hex digits: for each of 8 x 8 neighbours in a row, whether the right one is brighter."""
    return np.packbits(tile[:, 1:] > tile[:, :-1]).tobytes().hex()


def npy(array: np.ndarray) -> bytes:
    out = io.BytesIO()
    np.lib.format.write_array(out, np.ascontiguousarray(array), version=(1, 0), allow_pickle=False)
    return out.getvalue()


def payload_of(text: bytes) -> np.ndarray:
    """Bytes with zeros up to a positive multiple of WIDTH, as rows of an image."""
    rows = max(1, -(-len(text) // WIDTH))
    out = np.zeros(rows * WIDTH, np.uint8)
    out[: len(text)] = np.frombuffer(text, np.uint8)
    return out.reshape(rows, WIDTH)


def store_texts(docs: DataFrame, form: str = "pgm", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Write each whole text's UTF-8 bytes losslessly as an 8-bit grey image to the shared folder; the stored table.

    Columns: id, n_bytes, media. Null and empty texts are one row of zeros. Repeated rows are stored each for itself,
    other columns are not, and an empty table gives an empty one. form: pgm or bmp.
    """
    encode = {"pgm": encode_pgm, "bmp": encode_bmp}[form]

    def run(batches):
        for batch in batches:
            data, offsets = C.text_bytes(batch.column(1))
            for a, b in C.chunks(offsets, 1 << 24):
                media = [encode(payload_of(data[offsets[i] : offsets[i + 1]].tobytes())) for i in range(a, b)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(np.diff(offsets[a : b + 1])), pa.array(media, pa.binary())], [id_col, "n_bytes", "media"])

    kind = docs.schema[id_col].dataType.simpleString()
    return C.materialize(docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, n_bytes long, media binary"), "media")


def media_features(media: DataFrame, media_col: str = "media") -> DataFrame:
    """media with height, width, payload_bytes, payload_sha256 and tail_crc32 (last 64 samples) of the decoded samples,
    media_bytes and media_sha256 of the stored form, the area-resized tile as NPY bytes, and the tile's difference hash.

    A null or broken image gets nulls in all of these but, for a broken one, media_bytes and media_sha256. Columns of
    these names are replaced.
    """
    added = {"height": pa.int64(), "width": pa.int64(), "payload_bytes": pa.int64(), "payload_sha256": pa.string(), "tail_crc32": pa.int64(), "media_bytes": pa.int64(), "media_sha256": pa.string(), "tile": pa.binary(), "dhash": pa.string()}
    media = media.drop(*added)
    at = media.columns.index(media_col)

    def features(data: bytes | None) -> tuple:
        if data is None:
            return (None,) * len(added)
        stored = (len(data), sha256(data).hexdigest())
        try:
            image = decode_image(data)
        except ValueError:
            return (*(None,) * 5, *stored, None, None)
        samples = image.tobytes()
        tile = tile_of(image) if image.size else np.zeros(TILE, np.uint8)
        return (*image.shape[:2], len(samples), sha256(samples).hexdigest(), crc32(samples[-64:]), *stored, npy(tile), difference_hash(tile))

    def run(batches):
        for batch in batches:
            for a in range(0, batch.num_rows, 1024):
                part = batch.slice(a, 1024)
                rows = list(zip(*(features(x.as_py()) for x in part.column(at)), strict=True)) or [()] * len(added)
                yield pa.RecordBatch.from_arrays([*part.columns, *(pa.array(list(c), t) for c, t in zip(rows, added.values(), strict=True))], [*part.schema.names, *added])

    schema = media.withColumns({n: F.lit(None).cast({"int64": "long", "string": "string", "binary": "binary"}[str(t)]) for n, t in added.items()}).schema
    return media.mapInArrow(run, schema)


def write_tiles(features: DataFrame, media_col: str = "media") -> DataFrame:
    """Write the columns of media_features(), NPY tiles and difference hashes among them but not the images again, to the
    shared folder; the stored table. Null tiles of null or broken images stay null."""
    return C.materialize(features.drop(media_col), "tiles")
