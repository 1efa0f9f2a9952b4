"""TIFF and BigTIFF: strips or tiles, one or more samples (of those the first is read); uncompressed, deflated, LZW, PackBits or
Zstandard, with the predictors for integers and floating point; places, coordinate systems and missing values of GeoTIFF."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np

# Fixed values of the format: tags, sizes of field types, sample formats.
WIDTH, HEIGHT, BITS, COMPRESSION, PHOTOMETRIC, STRIP_AT, SAMPLES, STRIP_ROWS, STRIP_SIZE, PLANAR, PREDICTOR, TILE_W, TILE_H, TILE_AT, TILE_SIZE, FORMAT, SCALE, TIE, NODATA = 256, 257, 258, 259, 262, 273, 277, 278, 279, 284, 317, 322, 323, 324, 325, 339, 33550, 33922, 42113
GEO_KEYS, GEO_DOUBLES, GEO_TEXT = 34735, 34736, 34737
MODEL_TYPE, RASTER_TYPE, GEOGRAPHIC, PROJECTED = 1024, 1025, 2048, 3072
NONE, LZW, DEFLATE, OLD_DEFLATE, PACK_BITS, ZSTANDARD = 1, 5, 8, 32946, 32773, 50000
FIELD = {1: "B", 2: "c", 3: "H", 4: "I", 5: "Q", 6: "b", 8: "h", 9: "i", 11: "f", 12: "d", 16: "Q"}
KINDS = {1: "u", 2: "i", 3: "f"}


def fields(content: bytes) -> tuple[str, dict[int, tuple]]:
    """Byte order and the fields of the first directory."""
    if len(content) < 8 or content[:2] not in (b"II", b"MM"):
        raise ValueError("no TIFF header")
    order = "<" if content[:2] == b"II" else ">"
    version = struct.unpack_from(order + "H", content, 2)[0]
    if version not in (42, 43):
        raise ValueError("not a TIFF")
    # BigTIFF has eight bytes for places and counts.
    start, number, count_form, place_form, inside = (4, "H", "I", "I", 4) if version == 42 else (8, "Q", "Q", "Q", 8)
    (at,) = struct.unpack_from(order + place_form, content, start)
    (n,) = struct.unpack_from(order + number, content, at)
    at += struct.calcsize(number)
    entry = 4 + 2 * inside
    out = {}
    for i in range(n):
        tag, kind, count = struct.unpack_from(f"{order}HH{count_form}", content, at + entry * i)
        if kind not in FIELD:
            continue
        form = f"{order}{count}{FIELD[kind]}"
        place = at + entry * i + 4 + inside
        if struct.calcsize(form) > inside:
            (place,) = struct.unpack_from(order + place_form, content, place)
        values = struct.unpack_from(form, content, place)
        out[tag] = (b"".join(values),) if kind == 2 else values
    return order, out


def crs_of(f: dict[int, tuple]) -> str | None:
    """EPSG:code of the projected or else the geographic system that the keys name."""
    keys = f.get(GEO_KEYS, ())
    codes = {keys[i]: keys[i + 3] for i in range(4, len(keys) - 3, 4) if keys[i + 1] == 0}
    code = codes.get(PROJECTED) or codes.get(GEOGRAPHIC)
    return f"EPSG:{code}" if code and code < 32767 else None


def geo_fields(meta: dict) -> list[tuple[int, str, list]]:
    """The fields for the coordinate system: those read from a file as they were, else keys for an EPSG code (codes from 4000 to 4999 are geographic)."""
    if kept := meta.get("geo"):
        return [(tag, form, kept[name]) for tag, form, name in ((GEO_KEYS, "H", "keys"), (GEO_DOUBLES, "d", "doubles"), (GEO_TEXT, "s", "text")) if kept.get(name)]
    name, _, code = str(meta.get("crs") or "").partition(":")
    if name.upper() != "EPSG" or not code.isdigit():
        return []
    geographic = 4000 <= int(code) < 5000
    keys = [(MODEL_TYPE, 0, 1, 2 if geographic else 1), (RASTER_TYPE, 0, 1, 1), (GEOGRAPHIC if geographic else PROJECTED, 0, 1, int(code))]
    return [(GEO_KEYS, "H", [1, 1, 0, len(keys), *(x for k in keys for x in k)])]


def kind_of(order: str, f: dict[int, tuple]) -> np.dtype:
    return np.dtype(f"{order}{KINDS[f.get(FORMAT, (1,))[0]]}{f.get(BITS, (8,))[0] // 8}")


def metadata(content: bytes) -> dict:
    order, f = fields(content)
    meta = {"driver": "GTiff", "height": f[HEIGHT][0], "width": f[WIDTH][0], "count": f.get(SAMPLES, (1,))[0], "dtype": kind_of("=", f).name, "bands": ["value"]}
    if SCALE in f and TIE in f:
        meta["transform"] = [f[SCALE][0], 0.0, f[TIE][3], 0.0, -f[SCALE][1], f[TIE][4]]
    meta["nodata"] = float(f[NODATA][0].rstrip(b"\0 ").decode()) if NODATA in f else None
    meta["crs"] = crs_of(f)
    if GEO_KEYS in f:
        meta["geo"] = {"keys": list(f[GEO_KEYS]), "doubles": list(f.get(GEO_DOUBLES, ())), "text": f.get(GEO_TEXT, (b"",))[0].decode("latin-1")}
    return meta


def unpacked_bits(raw: bytes) -> bytes:
    """PackBits: a count below 128 copies one byte more than that, one over 128 repeats the next byte."""
    out, at = bytearray(), 0
    while at < len(raw):
        n = raw[at]
        if n < 128:
            out += raw[at + 1 : at + 2 + n]
            at += 2 + n
        else:
            if n > 128:
                out += raw[at + 1 : at + 2] * (257 - n)
            at += 2 if n > 128 else 1
    return bytes(out)


def unpacked_lzw(raw: bytes) -> bytes:
    """LZW with codes of 9 to 12 bits, highest bits first; 256 clears the table, 257 ends."""
    out, table, before = bytearray(), [], b""
    held, bits, width = 0, 0, 9
    for byte in raw:
        held, bits = held << 8 | byte, bits + 8
        if bits < width:
            continue
        bits -= width
        code, held = held >> bits, held & (1 << bits) - 1
        if code == 257:
            break
        if code == 256:
            table, before, width = [], b"", 9
            continue
        word = bytes([code]) if code < 256 else table[code - 258] if code - 258 < len(table) else before + before[:1]
        out += word
        if before:
            table.append(before + word[:1])
        before = word
        # The writer is one entry ahead when it widens its codes.
        width = min(12, max(9, (len(table) + 259).bit_length()))
    return bytes(out)


def decompressed(raw: bytes, how: int) -> bytes:
    if how == NONE:
        return raw
    if how in (DEFLATE, OLD_DEFLATE):
        return zlib.decompress(raw)
    if how == LZW:
        return unpacked_lzw(raw)
    if how == PACK_BITS:
        return unpacked_bits(raw)
    if how == ZSTANDARD:
        try:
            import zstandard
        except ImportError as e:
            raise ValueError("Zstandard isn't there") from e
        return zstandard.ZstdDecompressor().decompressobj().decompress(raw)
    raise ValueError(f"unsupported compression {how}")


def undone(raw: bytes, kind: np.dtype, rows: int, cols: int, own: int, predictor: int) -> np.ndarray:
    """(rows, cols, samples) of a block with its prediction undone: 2 holds differences of values, 3 differences of bytes, all highest bytes of a row first."""
    if predictor == 3:
        planes = np.cumsum(np.frombuffer(raw, np.uint8, rows * cols * own * kind.itemsize).reshape(rows, -1), axis=1, dtype=np.uint8) if own == 1 else None
        if planes is None:
            steps = np.frombuffer(raw, np.uint8, rows * cols * own * kind.itemsize).reshape(rows, -1, own)
            planes = np.cumsum(steps, axis=1, dtype=np.uint8).reshape(rows, -1)
        high_first = planes.reshape(rows, kind.itemsize, cols * own).transpose(0, 2, 1)
        return np.ascontiguousarray(high_first).view(kind.newbyteorder(">")).reshape(rows, cols, own)
    a = np.frombuffer(raw, kind, rows * cols * own).reshape(rows, cols, own)
    return np.cumsum(a, axis=1, dtype=a.dtype) if predictor == 2 else a


def strips(content: bytes) -> Iterator[tuple[int, np.ndarray]]:
    """(first row, block of rows) of the first band."""
    order, f = fields(content)
    h, w, n = f[HEIGHT][0], f[WIDTH][0], f.get(SAMPLES, (1,))[0]
    kind, how, pred = kind_of(order, f), f.get(COMPRESSION, (1,))[0], f.get(PREDICTOR, (1,))[0]
    if pred not in (1, 2, 3) or f.get(PLANAR, (1,))[0] not in (1, 2):
        raise ValueError("unsupported prediction or layout")
    own = 1 if f.get(PLANAR, (1,))[0] == 2 else n

    def block(at: int, size: int, rows: int, cols: int) -> np.ndarray:
        return undone(decompressed(content[at : at + size], how), kind, rows, cols, own, pred)[:, :, 0]

    if TILE_AT in f:
        tw, th = f[TILE_W][0], f[TILE_H][0]
        across = -(-w // tw)
        for r in range(-(-h // th)):
            row = [block(f[TILE_AT][r * across + c], f[TILE_SIZE][r * across + c], th, tw) for c in range(across)]
            yield r * th, np.hstack(row)[: min(th, h - r * th), :w]
    else:
        step = f.get(STRIP_ROWS, (h,))[0]
        for k in range(-(-h // step)):
            yield k * step, block(f[STRIP_AT][k], f[STRIP_SIZE][k], min(step, h - k * step), w)


def encoded(block: np.ndarray, dtype: str, compress: str) -> bytes:
    kind = np.dtype(dtype).newbyteorder("<")
    whole = np.nan_to_num(np.rint(block)) if kind.kind in "iu" else block
    raw = whole.astype(kind).tobytes()
    return zlib.compress(raw) if str(compress).lower() == "deflate" else raw


def head(height: int, width: int, rows: int, sizes: list[int], meta: dict) -> bytes:
    """Header and directory of a file whose strips, of these sizes, follow directly; a BigTIFF if it gets too long for a TIFF."""
    big = sum(sizes) + 64 * len(sizes) > 4_000_000_000
    one = _head(0, height, width, rows, sizes, meta, big)
    return _head(len(one), height, width, rows, sizes, meta, big)


def _head(first: int, height: int, width: int, rows: int, sizes: list[int], meta: dict, big: bool) -> bytes:
    kind = np.dtype(meta["dtype"])
    long, inside, start = ("Q", 8, 16) if big else ("I", 4, 8)
    places = [first + p for p in np.cumsum([0, *sizes]).tolist()[:-1]]
    entries: list[tuple[int, str, list]] = [
        (WIDTH, "I", [width]), (HEIGHT, "I", [height]), (BITS, "H", [kind.itemsize * 8]), (COMPRESSION, "H", [DEFLATE if str(meta["compress"]).lower() == "deflate" else NONE]), (PHOTOMETRIC, "H", [1]),
        (STRIP_AT, long, places), (SAMPLES, "H", [1]), (STRIP_ROWS, "I", [rows]), (STRIP_SIZE, long, sizes), (FORMAT, "H", [{"u": 1, "i": 2, "f": 3}[kind.kind]]),
    ]
    if t := meta.get("transform"):
        entries += [(SCALE, "d", [t[0], -t[4], 0.0]), (TIE, "d", [0.0, 0.0, 0.0, t[2], t[5], 0.0])]
    entries += geo_fields(meta)
    if meta.get("nodata") is not None:
        entries.append((NODATA, "s", repr(float(meta["nodata"]))))
    table, extra = b"", b""
    after = start + struct.calcsize("Q" if big else "H") + len(entries) * (4 + 2 * inside) + inside
    for tag, form, values in sorted(entries, key=lambda e: e[0]):
        if form == "s":
            raw = values.encode("latin-1") + b"\0"
            count = len(raw)
        else:
            raw, count = struct.pack(f"<{len(values)}{form}", *values), len(values)
        if len(raw) > inside:
            field, extra = struct.pack(f"<{long}", after + len(extra)), extra + raw + b"\0" * (len(raw) % 2)
        else:
            field = raw.ljust(inside, b"\0")
        table += struct.pack(f"<HH{long}", tag, {"H": 3, "I": 4, "Q": 16, "d": 12, "s": 2}[form], count) + field
    top = b"II+\0\x08\0\0\0" + struct.pack("<Q", start) if big else b"II*\0" + struct.pack("<I", start)
    return top + struct.pack("<Q" if big else "<H", len(entries)) + table + b"\0" * inside + extra
