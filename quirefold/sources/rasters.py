"""Pictures and arrays: decoding, headers, colour spaces, and sinks. PNG, PPM, PGM and NPY; anything else is not read.

A picture is a row (h, w, c, data BINARY, uint8, row by row) with its resolution. What cannot be read is null.
"""

from __future__ import annotations

import io
import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SUFFIXES = (".png", ".ppm", ".pgm", ".npy")
PICTURE = "h int, w int, c int, data binary, dpi int"
# The first bytes of a PNG, samples a pixel by colour type, and the tag of an orientation.
_PNG = b"\x89PNG\r\n\x1a\n"
_SAMPLES = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}
_ORIENTATION = 0x0112
# Luminance and the two colour differences of red, green and blue, and the way back.
YUV = ((0.299, 0.587, 0.114), (-0.14713, -0.28886, 0.436), (0.615, -0.51499, -0.10001))
RGB = ((1.0, 0.0, 1.13983), (1.0, -0.39465, -0.58060), (1.0, 2.03211, 0.0))
_PNM = re.compile(rb"P([56])\s+(?:#[^\n]*\n\s*)*(\d+)\s+(?:#[^\n]*\n\s*)*(\d+)\s+(?:#[^\n]*\n\s*)*(\d+)\s")
#: Cells of the largest picture that is decoded; a larger one is taken for a bomb.
MOST_CELLS = 1 << 28


def _chunks(content: bytes) -> Iterator[tuple[bytes, bytes]]:
    at = len(_PNG)
    while at + 8 <= len(content):
        (size,), name = struct.unpack(">I", content[at : at + 4]), content[at + 4 : at + 8]
        yield name, content[at + 8 : at + 8 + size]
        at += size + 12


def _orientation(exif: bytes) -> int:
    """1 to 8: how the picture lies, by the tag in its first directory."""
    order = "<" if exif[:2] == b"II" else ">"
    at = struct.unpack(order + "I", exif[4:8])[0]
    for k in range(struct.unpack(order + "H", exif[at : at + 2])[0]):
        entry = exif[at + 2 + 12 * k : at + 14 + 12 * k]
        if struct.unpack(order + "H", entry[:2])[0] == _ORIENTATION:
            return struct.unpack(order + "H", entry[8:10])[0]
    return 1


def upright(a: np.ndarray, orientation: int) -> np.ndarray:
    """The picture as it should be seen."""
    if orientation >= 5:  # rows are columns
        a = a.swapaxes(0, 1)
    turned = {2: (1, -1), 3: (-1, -1), 4: (-1, 1), 6: (1, -1), 7: (-1, -1), 8: (-1, 1)}.get(orientation, (1, 1))
    return a[:: turned[0], :: turned[1]]


def header(content: bytes) -> tuple[int, int, int | None] | None:
    """(h, w, dpi) from the first bytes, without decoding; dpi is null if not told, and an error if it differs by axis. None for other files."""
    if content[:8] == _PNG:
        w, h = struct.unpack(">II", content[16:24])
        for name, body in _chunks(content):
            if name == b"pHYs" and len(body) == 9:
                x, y, unit = struct.unpack(">IIB", body)
                if x != y:
                    raise ValueError(f"the resolution is not square: {x}, {y}")
                return h, w, round(x * 0.0254) if unit == 1 else None
            if name == b"IDAT":
                break
        return h, w, None
    if m := _PNM.match(content):
        return int(m[3]), int(m[2]), None
    if content[:6] == b"\x93NUMPY":
        f = io.BytesIO(content)
        version = np.lib.format.read_magic(f)
        shape, _, _ = (np.lib.format.read_array_header_1_0 if version == (1, 0) else np.lib.format.read_array_header_2_0)(f)
        return (*shape[:2], None) if len(shape) > 1 else None
    return None


def _png(content: bytes) -> tuple[np.ndarray, int]:
    """Samples [h, w, c] of 8 bits, palettes resolved, and the orientation."""
    data, palette, lies = [], None, 1
    for name, body in _chunks(content):
        if name == b"IHDR":
            w, h, depth, kind, _, _, interlaced = struct.unpack(">IIBBBBB", body)
            if depth != 8 or interlaced or kind not in _SAMPLES:
                raise ValueError("only 8 bits a sample, row by row")
            if w * h > MOST_CELLS:
                raise ValueError("too large")
        elif name == b"PLTE":
            palette = np.frombuffer(body, np.uint8).reshape(-1, 3)
        elif name == b"eXIf":
            lies = _orientation(body)
        elif name == b"IDAT":
            data.append(body)
    n = _SAMPLES[kind]
    inflate = zlib.decompressobj()
    rows = np.frombuffer(inflate.decompress(b"".join(data), h * (w * n + 1)), np.uint8).reshape(h, w * n + 1)
    out, before = np.zeros((h, w * n), np.uint8), np.zeros(w * n, np.uint8)
    for y in range(h):
        how, line = rows[y, 0], rows[y, 1:]
        if how == 0:
            now = line
        elif how == 1:  # each sample adds the one to the left
            now = np.cumsum(line.reshape(w, n), axis=0, dtype=np.uint8).reshape(-1)
        elif how == 2:
            now = line + before
        else:
            now = np.zeros(w * n, np.uint8)
            left, up, corner = [0] * n, before.tolist(), [0] * n
            told = []
            for i, v in enumerate(line.tolist()):
                a, b, c = left[i % n], up[i], corner[i % n]
                if how == 3:
                    v += (a + b) // 2
                else:
                    p = a + b - c
                    near = (abs(p - a), abs(p - b), abs(p - c))
                    v += a if near[0] <= near[1] and near[0] <= near[2] else b if near[1] <= near[2] else c
                left[i % n], corner[i % n] = v & 255, b
                told.append(v & 255)
            now = np.array(told, np.uint8)
        out[y] = before = now
    a = out.reshape(h, w, n)
    return (palette[a[..., 0]] if kind == 3 and palette is not None else a), lies


def decoded(content: bytes | None, mode: str = "as it is", upright_only: bool = True) -> tuple[np.ndarray, int | None] | None:
    """(array [h, w, c] of uint8, dpi) of a file's bytes; None if it cannot be read. mode: a colour space of `coloured`, or as it is."""
    try:
        head = header(content)
        if head is None:
            return None
        if content[:8] == _PNG:
            a, lies = _png(content)
            a = upright(a, lies) if upright_only else a
        elif content[:1] == b"P":
            m = _PNM.match(content)
            c = 3 if m[1] == b"6" else 1
            a = np.frombuffer(content, np.uint8, head[0] * head[1] * c, m.end()).reshape(head[0], head[1], c)
        else:
            a = np.load(io.BytesIO(content), allow_pickle=False)
            a = (a if a.ndim == 3 else a[..., None]).astype(np.uint8)
        return np.ascontiguousarray(a if mode == "as it is" else coloured(a, mode)), head[2]
    except (ValueError, TypeError, KeyError, IndexError, UnboundLocalError, OSError, EOFError, struct.error, zlib.error):
        return None


def coloured(a: np.ndarray, mode: str) -> np.ndarray:
    """A gray, RGB or RGBA picture as "RGB", "BGR", "L" or "YUV" (floats, luminance first)."""
    rgb = np.repeat(a[..., :1], 3, axis=2) if a.shape[2] < 3 else a[..., :3]
    if mode == "RGB":
        return rgb
    if mode == "BGR":
        return rgb[..., ::-1]
    if mode == "L":
        gray = a[..., :1].astype(float) if a.shape[2] < 3 else rgb.astype(float) @ np.array(YUV[:1]).T
        return np.floor(gray + 0.5).astype(np.uint8)
    if mode == "YUV":
        return rgb.astype(float) / 255 @ np.array(YUV).T
    raise ValueError(mode)


def from_yuv(a: np.ndarray) -> np.ndarray:
    return np.clip(np.floor(a @ np.array(RGB).T * 255 + 0.5), 0, 255).astype(np.uint8)


def encoded(a: np.ndarray, suffix: str, dpi: int | None = None) -> bytes:
    """The file of an array [h, w] or [h, w, c]. Pictures have whole numbers from 0 to 255 and one, three or four channels; NPY takes any array."""
    if suffix == ".npy":
        f = io.BytesIO()
        np.save(f, a, allow_pickle=False)
        return f.getvalue()
    if a.ndim not in (2, 3) or a.dtype.kind not in "iub" or a.size and (a.min() < 0 or a.max() > 255):
        raise ValueError(f"no picture: {a.dtype} {a.shape}")
    a = (a if a.ndim == 3 else a[..., None]).astype(np.uint8)
    h, w, c = a.shape
    if suffix == ".png" and c in (1, 3, 4):
        chunk = lambda name, body: struct.pack(">I", len(body)) + name + body + struct.pack(">I", zlib.crc32(name + body))
        rows = np.concatenate([np.zeros((h, 1), np.uint8), a.reshape(h, w * c)], axis=1).tobytes()
        size = chunk(b"pHYs", struct.pack(">IIB", *[round(dpi / 0.0254)] * 2, 1)) if dpi else b""
        return _PNG + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, {1: 0, 3: 2, 4: 6}[c], 0, 0, 0)) + size + chunk(b"IDAT", zlib.compress(rows, 6)) + chunk(b"IEND", b"")
    if suffix in (".ppm", ".pgm") and c == (3 if suffix == ".ppm" else 1):
        return b"P%d\n%d %d\n255\n" % (6 if c == 3 else 5, w, h) + a.tobytes()
    raise ValueError(f"{c} channels as {suffix}")


def _files(spark: SparkSession, path: str) -> DataFrame:
    names = ",".join(s[1:] for s in SUFFIXES)
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", f"*.{{{names}}}").load(path)


def images(spark: SparkSession, path: str, mode: str = "as it is") -> DataFrame:
    """(path, PICTURE) of the pictures under a folder; nulls where one cannot be read."""
    return decoded_rows(_files(spark, path).select("path", "content"), mode)


def decoded_rows(files: DataFrame, mode: str = "as it is", key: str = "path") -> DataFrame:
    """(key, PICTURE) of rows (key, content)."""
    kind = files.schema[key].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for k, content in zip(b[key], b["content"]):  # a picture at a time: the column of all is not held twice
                got = decoded(content, mode)
                row = (k, None, None, None, None, None) if got is None else (k, *got[0].shape, got[0].tobytes(), got[1])
                yield pd.DataFrame([row], columns=[key, "h", "w", "c", "data", "dpi"]).astype({n: "Int32" for n in ("h", "w", "c", "dpi")})

    return files.select(key, "content").mapInPandas(run, f"{key} {kind}, {PICTURE}")


def headers(spark: SparkSession, path: str) -> DataFrame:
    """(path, h, w, dpi) by the first bytes of each picture."""
    first = _files(spark, path).select("path", F.substring("content", 1, 4096).alias("content"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(p, *(header(c) or (None, None, None))) for p, c in zip(b["path"], b["content"])]
            yield pd.DataFrame(rows, columns=["path", "h", "w", "dpi"]).astype({n: "Int32" for n in ("h", "w", "dpi")})

    return first.mapInPandas(run, "path string, h int, w int, dpi int")


def encoded_rows(pictures: DataFrame, key: str, suffix: str) -> DataFrame:
    """(key, content) of rows (key, h, w, c, data); an unreadable one has no row."""
    kind = pictures.schema[key].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for k, h, w, c, data in zip(b[key], b["h"], b["w"], b["c"], b["data"]):
                if data is not None:
                    a = np.frombuffer(data, np.uint8).reshape(int(h), int(w), int(c))
                    yield pd.DataFrame([(k, encoded(a, suffix))], columns=[key, "content"])

    return pictures.select(key, "h", "w", "c", "data").mapInPandas(run, f"{key} {kind}, content binary")


def write(files: DataFrame, path: str, key: str, suffix: str) -> None:
    """One file per row (key, content) in a folder (or its URI) that all executors reach, each by a rename of a finished one."""
    def run(rows) -> None:
        import uuid

        from pyarrow import fs

        system, at = fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)
        system.create_dir(at, recursive=True)
        for row in rows:
            part = f"{at}/.{uuid.uuid4().hex}"
            with system.open_output_stream(part) as f:
                f.write(bytes(row["content"]))
            system.move(part, f"{at}/{row[key]}{suffix}")

    files.select(key, "content").foreachPartition(run)
