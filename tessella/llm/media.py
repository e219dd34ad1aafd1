"""Media columns: Netpbm and BMP images decoded to numpy arrays, area-resized by integral images, NPY tiles, difference hashes."""

from __future__ import annotations

import hashlib
import io
import re
import struct
import zlib

import numpy as np
from pyspark.sql import DataFrame

from tessella.llm._common import dropped, saved, scratch, write_whole

#: Edge of a tile, and of the grid whose neighbours the difference hash compares.
TILE, GRID = 16, 8
#: Bytes of media in an Arrow batch and tiles in an NPY file, at most (one image or tile at least).
BATCH, STACK = 4 << 20, 4096
#: Payload bytes are padded with 255 to a positive multiple of this many samples.
UNIT = 576

_HEADER = re.compile(rb"P([1-6])")
_TOKEN = re.compile(rb"(?:[ \t-\r]|#[^\r\n]*[\r\n])*([0-9]+)")


class MediaError(ValueError):
    """Bytes that aren't a whole image of a known kind."""


def encode_netpbm(image: np.ndarray) -> bytes:
    """Binary PGM of (h, w), or PPM of (h, w, 3), of 8-bit samples."""
    h, w = image.shape[:2]
    return b"P%d\n%d %d\n255\n" % (5 if image.ndim == 2 else 6, w, h) + np.ascontiguousarray(image, np.uint8).tobytes()


def encode_bmp(image: np.ndarray) -> bytes:
    """Uncompressed BMP, rows from the bottom: 8 bits with a grey palette of (h, w), 24 bits of (h, w, 3)."""
    h, w = image.shape[:2]
    flat = np.ascontiguousarray(image[::-1] if image.ndim == 2 else image[::-1, :, ::-1], np.uint8).reshape(h, -1)
    rows = np.zeros((h, -(-flat.shape[1] // 4) * 4), np.uint8)
    rows[:, : flat.shape[1]] = flat
    palette = np.repeat(np.arange(256, dtype=np.uint8), 4).reshape(256, 4) * np.array([1, 1, 1, 0], np.uint8) if image.ndim == 2 else np.zeros((0, 4), np.uint8)
    start = 54 + palette.size
    head = struct.pack("<2sIHHI", b"BM", start + rows.size, 0, 0, start) + struct.pack("<IiiHHIIiiII", 40, w, h, 1, 8 if image.ndim == 2 else 24, 0, rows.size, 2835, 2835, len(palette), 0)
    return head + palette.tobytes() + rows.tobytes()


def _netpbm(raw: bytes, kind: int) -> np.ndarray:
    at, sizes = 2, []
    for _ in range(2 if kind in (1, 4) else 3):
        m = _TOKEN.match(raw, at)
        if not m:
            raise MediaError("a Netpbm header ends early")
        sizes.append(int(m[1]))
        at = m.end()
    w, h, top = (*sizes, 1)[:3]
    if not (w and h and 0 < top < 65536):
        raise MediaError("a Netpbm header has a size of 0 or a maximum out of range")
    n = w * h * (3 if kind in (3, 6) else 1)
    if kind == 1:  # digits may stand without blanks
        values = np.frombuffer(re.sub(rb"#[^\r\n]*|\s", b"", raw[at:])[:n], np.uint8) - 48
    elif kind in (2, 3):
        values = np.array(re.sub(rb"#[^\r\n]*", b"", raw[at:]).split()[:n], dtype=np.int64)
    elif kind == 4:
        row = -(-w // 8)
        bits = np.frombuffer(raw, np.uint8, min(row * h, len(raw) - at - 1), at + 1)
        values = np.unpackbits(bits).reshape(-1, row * 8)[:, :w].ravel() if len(bits) == row * h else bits[:0]
    else:
        kind_of = np.uint8 if top < 256 else np.dtype(">u2")
        values = np.frombuffer(raw, kind_of, min(n, (len(raw) - at - 1) // np.dtype(kind_of).itemsize), at + 1)
    if len(values) < n or kind < 4 and values.size and int(values.max()) > top:
        raise MediaError("Netpbm samples are missing or above their maximum")
    values = values.astype(np.int64)
    if kind in (1, 4):
        values = 255 * (1 - values)  # 1 is black
    elif top != 255:
        values = (values * 255 * 2 + top) // (2 * top)
    return values.astype(np.uint8).reshape((h, w, 3) if kind in (3, 6) else (h, w))


def _bmp(raw: bytes) -> np.ndarray:
    if len(raw) < 54:
        raise MediaError("a BMP header ends early")
    start, head, w, h, _, bits, packing = struct.unpack_from("<IIiiHHI", raw, 10)
    if head < 40 or w <= 0 or not h or packing or bits not in (1, 4, 8, 24, 32):
        raise MediaError("a BMP of a kind that isn't read")
    down, h, row = h < 0, abs(h), (w * bits + 31) // 32 * 4
    if len(raw) < start + row * h:
        raise MediaError("BMP rows are missing")
    rows = np.frombuffer(raw, np.uint8, row * h, start).reshape(h, row)
    rows = rows if down else rows[::-1]
    if bits >= 24:
        return np.ascontiguousarray(rows[:, : w * bits // 8].reshape(h, w, bits // 8)[:, :, 2::-1])
    colours = struct.unpack_from("<I", raw, 46)[0] or 1 << bits
    if len(raw) < 14 + head + 4 * colours:
        raise MediaError("a BMP palette ends early")
    palette = np.frombuffer(raw, np.uint8, 4 * colours, 14 + head).reshape(-1, 4)[:, 2::-1]
    index = rows if bits == 8 else np.stack([rows >> s & (1 << bits) - 1 for s in range(8 - bits, -1, -bits)], -1).reshape(h, -1)
    index = index[:, :w]
    if int(index.max()) >= colours:
        raise MediaError("a BMP pixel has no colour")
    if (palette == palette[:, :1]).all():
        return palette[:, 0][index]
    return palette[index]


def decode(raw: bytes) -> np.ndarray:
    """8-bit samples, (h, w) or (h, w, 3), of plain or binary PBM, PGM and PPM and of uncompressed BMP; MediaError otherwise."""
    if m := _HEADER.match(raw):
        return _netpbm(raw, int(m[1]))
    if raw[:2] == b"BM":
        return _bmp(raw)
    raise MediaError("neither Netpbm nor BMP")


def grey(image: np.ndarray) -> np.ndarray:
    """Luma in whole numbers; grey images as they are."""
    return image if image.ndim == 2 else ((image.astype(np.int64) @ np.array([299, 587, 114]) + 500) // 1000).astype(np.uint8)


def area_resize(image: np.ndarray, h: int, w: int) -> np.ndarray:
    """Means of the areas of a grid of h x w cells over a grey image, halves up, in whole numbers.

    The integral image is read at cell borders, which may lie within a pixel: with coordinates in h-ths and w-ths of a
    pixel, it is linear between its points, so that products of whole numbers give each cell's sum exactly.
    """
    rows, columns = image.shape
    table = np.zeros((rows + 1, columns + 1), np.int64)
    np.cumsum(np.cumsum(image, 0, dtype=np.int64), 1, out=table[1:, 1:])

    def at_borders(t, cells, size):
        k, part = np.divmod(np.arange(cells + 1, dtype=np.int64) * size, cells)
        return t[k] * cells + (t[np.minimum(k + 1, size)] - t[k]) * part[:, None]

    sums = at_borders(at_borders(table, h, rows).T, w, columns).T  # times h * w
    cells, area = sums[1:, 1:] - sums[:-1, 1:] - sums[1:, :-1] + sums[:-1, :-1], rows * columns
    return ((2 * cells + area) // (2 * area)).astype(np.uint8)


def difference_hash(image: np.ndarray) -> str:
    """128 bits in hex: whether each cell of an 8 x 8 grid is darker than its right neighbour, then than the one below."""
    wide, high = area_resize(image, GRID, GRID + 1), area_resize(image, GRID + 1, GRID)
    return (np.packbits(wide[:, :-1] < wide[:, 1:]).tobytes() + np.packbits(high[:-1] < high[1:]).tobytes()).hex()


def shape_of(units: int) -> tuple[int, int, str]:
    """Height, width and kind of the image of so many units of samples: the widest of 24 * c with c up to the root, kinds by the units' remainder."""
    c = next(c for c in range(int(units**0.5), 0, -1) if units % c == 0)
    return 24 * units // c, 24 * c, ("ppm", "pgm", "bmp")[units % 3]


def to_media(payload: bytes) -> bytes:
    """The payload, padded with 255 to whole units, as samples of one image."""
    samples = np.full(max(1, -(-len(payload) // UNIT)) * UNIT, 255, np.uint8)
    samples[: len(payload)] = np.frombuffer(payload, np.uint8)
    h, w, kind = shape_of(len(samples) // UNIT)
    if kind == "ppm":
        return encode_netpbm(samples.reshape(h, w // 3, 3))
    return (encode_netpbm if kind == "pgm" else encode_bmp)(samples.reshape(h, w))


def _batches(rows, schema):
    """Arrow batches of rows whose last value is bytes, of bounded size."""
    import pyarrow as pa

    held, size = [], 0
    for r in rows:
        held.append(r)
        size += len(r[-1] or b"") + 64
        if size >= BATCH:
            yield pa.RecordBatch.from_pydict(dict(zip(schema.names, map(list, zip(*held, strict=True)), strict=True)), schema)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_pydict(dict(zip(schema.names, map(list, zip(*held, strict=True)), strict=True)), schema)


def encode_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_bytes, media: each whole text's UTF-8 as the samples of one image; a null text is an empty one."""

    def run(batches):
        import pyarrow as pa

        schema = pa.schema([("id", pa.int64()), ("n_bytes", pa.int64()), ("media", pa.binary())])

        def rows():
            for b in batches:
                for i, text in zip(b.column(0), b.column(1), strict=True):
                    payload = (text.as_py() or "").encode()
                    yield i.as_py(), len(payload), to_media(payload)

        yield from _batches(rows(), schema)

    picked = docs.selectExpr(f"cast(`{id_col}` as long) AS id", f"`{text_col}` AS text")
    return picked.mapInArrow(run, "id long, n_bytes long, media binary")


def write_tiles(media: DataFrame, folder: str, tile: int = TILE, id_col: str = "id", media_col: str = "media", keep: tuple[str, ...] = ()) -> DataFrame:
    """Decodes every image and writes its tile: id, columns of `keep`, height, width, payload digests, feature, tile_file, tile_row, error.

    `folder` gets NPY files of (tiles, tile, tile) 8-bit greys, at most 4,096 tiles each; tile_file and tile_row say where an
    image's tile stands. A file's name is its content's hash, so a task run twice writes the same files. The digests are
    of the decoded samples in their order. Bytes that aren't an image (null and empty ones too) have an error, and null
    otherwise; equal images have equal features. An empty table writes nothing.
    """
    names = [*keep, "media_bytes", "media_sha256", "height", "width", "payload_bytes", "payload_sha256", "tail_crc32", "feature", "tile_file", "tile_row", "error"]
    types = {c: media.schema[c].dataType.simpleString() for c in keep} | {c: "long" for c in ("media_bytes", "payload_bytes", "tail_crc32")} | {c: "int" for c in ("height", "width", "tile_row")}

    def digest(raw):
        image = decode(raw)
        samples = image.tobytes()
        flat = grey(image)
        return [len(raw), hashlib.sha256(raw).hexdigest(), *image.shape[:2], len(samples), hashlib.sha256(samples).hexdigest(), zlib.crc32(samples[-32:]), difference_hash(flat)], area_resize(flat, tile, tile)

    def run(batches):
        import pyarrow as pa

        rows, tiles = [], []

        def flush():
            stack, name = np.array(tiles, np.uint8).reshape(-1, tile, tile), None
            if len(stack):
                np.save(out := io.BytesIO(), stack)
                name = f"{hashlib.sha256(out.getvalue()).hexdigest()[:32]}.npy"
                write_whole(f"{folder}/{name}", [out.getvalue()])
            columns = list(zip(*[(i, *k, *(x if x else [None] * 8), name if x else None, row, error) for i, k, x, row, error in rows], strict=True))
            built = [pa.array(c, t) for c, t in zip(columns, [pa.int64(), *[batch.schema.field(c).type for c in keep], pa.int64(), pa.string(), pa.int32(), pa.int32(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int32(), pa.string()], strict=True)]
            return pa.RecordBatch.from_arrays(built, ["id", *names])

        for batch in batches:
            for r in range(batch.num_rows):
                raw, kept = batch.column(1)[r].as_py(), [batch.column(2 + k)[r].as_py() for k in range(len(keep))]
                try:
                    found, small = digest(raw or b"")
                    rows.append((batch.column(0)[r].as_py(), kept, found, len(tiles), None))
                    tiles.append(small)
                except MediaError as e:
                    rows.append((batch.column(0)[r].as_py(), kept, None, None, str(e)))
                if len(rows) >= STACK:
                    yield flush()
                    rows, tiles = [], []
        if rows:
            yield flush()

    picked = media.selectExpr(f"cast(`{id_col}` as long) AS id", f"`{media_col}` AS media", *[f"`{c}`" for c in keep])
    return picked.mapInArrow(run, "id long, " + ", ".join(f"{c} {types.get(c, 'string')}" for c in names))


def media_digests(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, payload and media digests and feature of every whole text, stored as images and read back, one row a row.

    The images are written as a table in the shared folder and read again; tiles go to NPY files beside it. A null text is
    stored like an empty one (one unit of 255), null ids and repeated rows stay rows, other columns aren't read, texts
    of any length are one image.
    """
    spark = docs.sparkSession
    encode_texts(docs).write.option("compression", "zstd").parquet(path := scratch(spark, "media"))
    stored = spark.read.schema("id long, n_bytes long, media binary").parquet(path)
    found = write_tiles(stored, scratch(spark, "media-tiles"), keep=("n_bytes",))
    out = saved(found.withColumnRenamed("id", "doc_id").select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "height", "width"), "media-result")
    dropped(stored)
    return out


def op13_media(spark, sf_dir: str) -> DataFrame:
    return media_digests(spark.read.parquet(f"{sf_dir}/documents.parquet"))
