"""TIFF as a media column: directories walked, strips and tiles decoded, one row per page.

Baseline TIFF 6.0 with 8-bit samples: no compression, PackBits, LZW and deflate, in strips or tiles,
with horizontal differencing, either byte order.  The writer serves text payloads and tests.
"""

from __future__ import annotations

import hashlib
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from corvane.llm.frames import texts

# Fixed values of the format.
NONE, LZW, DEFLATE, PACKBITS, OLD_DEFLATE = 1, 5, 8, 32773, 32946
WIDTH, HEIGHT, BITS, COMPRESSION, PHOTOMETRIC = 256, 257, 258, 259, 262
STRIP_OFFSETS, SAMPLES, ROWS_PER_STRIP, STRIP_BYTES = 273, 277, 278, 279
PLANAR, PREDICTOR = 284, 317
TILE_WIDTH, TILE_HEIGHT, TILE_OFFSETS, TILE_BYTES = 322, 323, 324, 325
FIELD = {1: "B", 2: "B", 3: "H", 4: "I", 16: "Q"}
NAMES = {NONE: "none", LZW: "lzw", DEFLATE: "deflate", OLD_DEFLATE: "deflate", PACKBITS: "packbits"}


def packbits(data: bytes) -> bytes:
    """PackBits of one strip: runs of three or more as a repeat, the rest as literals."""
    a = np.frombuffer(data, np.uint8)
    edge = np.concatenate([[0], np.flatnonzero(a[1:] != a[:-1]) + 1, [len(a)]])
    long = np.flatnonzero(np.diff(edge) >= 3)
    out, done = [], 0

    def literal(stop):
        for i in range(done, stop, 128):
            part = data[i : min(i + 128, stop)]
            out.append(bytes((len(part) - 1,)))
            out.append(part)

    for k in long.tolist():
        start, stop = int(edge[k]), int(edge[k + 1])
        literal(start)
        while stop - start > 1:
            n = min(128, stop - start)
            out.append(bytes((257 - n, data[start])))
            start += n
        done = start
    literal(len(data))
    return b"".join(out)


def unpackbits(data: bytes) -> bytes:
    out, i, n = [], 0, len(data)
    while i < n:
        k = data[i]
        if k < 128:
            out.append(data[i + 1 : i + 2 + k])
            i += 2 + k
        elif k > 128:
            out.append(data[i + 1 : i + 2] * (257 - k))
            i += 2
        else:
            i += 1
    return b"".join(out)


#: Bits that LZW holds back before it writes bytes, so that its cost is linear in the strip.
HELD = 512


def lzw(data: bytes) -> bytes:
    """Codes of 9 to 12 bits, most significant first, widened one code early as the format asks."""
    # The table's keys are a code and the byte that follows it; bits leave in whole bytes once there are HELD.
    out, table = bytearray(), {}
    bits, n_bits, width, nxt, prefix = 256, 9, 9, 258, -1
    for x in data:
        if prefix < 0:
            prefix = x
            continue
        key = prefix << 8 | x
        code = table.get(key)
        if code is not None:
            prefix = code
            continue
        bits, n_bits = bits << width | prefix, n_bits + width
        table[key] = nxt
        nxt += 1
        if nxt == 4094:
            bits, n_bits = bits << width | 256, n_bits + width
            table = {}
            width, nxt = 9, 258
        elif nxt + 1 > 1 << width:
            width += 1
        if n_bits >= HELD:
            rest = n_bits % 8
            out += (bits >> rest).to_bytes(n_bits // 8, "big")
            bits, n_bits = bits & ((1 << rest) - 1), rest
        prefix = x
    if prefix >= 0:
        bits, n_bits = bits << width | prefix, n_bits + width
        if nxt + 2 > 1 << width and width < 12:
            width += 1
    bits, n_bits = bits << width | 257, n_bits + width
    pad = -n_bits % 8
    out += (bits << pad).to_bytes((n_bits + pad) // 8, "big")
    return bytes(out)


def unlzw(data: bytes) -> bytes:
    table = [bytes((i,)) for i in range(256)] + [b"", b""]
    out, held, n_held, width, last = [], 0, 0, 9, b""
    for x in data:
        held, n_held = held << 8 | x, n_held + 8
        if n_held < width:
            continue
        n_held -= width
        code, held = held >> n_held, held & ((1 << n_held) - 1)
        if code == 257:
            break
        if code == 256:
            table, width, last = [bytes((i,)) for i in range(256)] + [b"", b""], 9, b""
            continue
        entry = table[code] if code < len(table) else last + last[:1]
        if code > len(table) or not entry:
            raise ValueError("bad LZW code")
        out.append(entry)
        if last:
            table.append(last + entry[:1])
        last = entry
        if len(table) + 1 >= 1 << width and width < 12:
            width += 1
    return b"".join(out)


#: Bytes of a page at most, and those per byte of its file, beyond which a header is taken to be false.
MOST_PIXELS, MOST_TIMES = 1 << 30, 2048


PACK = {NONE: bytes, LZW: lzw, PACKBITS: packbits, DEFLATE: lambda x: zlib.compress(x, 1)}
UNPACK = {NONE: bytes, LZW: unlzw, PACKBITS: unpackbits, DEFLATE: zlib.decompress, OLD_DEFLATE: zlib.decompress}


def write_tiff(pages: list[np.ndarray], compression: int = NONE, predictor: int = 1, tile: int = 0, rows_per_strip: int = 64, order: str = "<") -> bytes:
    """A TIFF of 8-bit pages, each an array (height, width, samples)."""
    out = bytearray((b"II" if order == "<" else b"MM") + struct.pack(order + "HI", 42, 0))
    link = 4
    for page in pages:
        h, w, s = page.shape
        if tile:
            blocks = []
            for y in range(0, h, tile):
                for x in range(0, w, tile):
                    block = np.zeros((tile, tile, s), np.uint8)
                    part = page[y : y + tile, x : x + tile]
                    block[: part.shape[0], : part.shape[1]] = part
                    blocks.append(block)
        else:
            blocks = [page[y : y + rows_per_strip] for y in range(0, h, rows_per_strip)]
        offsets, sizes = [], []
        for block in blocks:
            if predictor == 2:
                block = np.concatenate([block[:, :1], block[:, 1:] - block[:, :-1]], axis=1)
            data = PACK[compression](block.tobytes())
            offsets.append(len(out))
            sizes.append(len(data))
            out += data
        tags = {WIDTH: (4, [w]), HEIGHT: (4, [h]), BITS: (3, [8] * s), COMPRESSION: (3, [compression]), PHOTOMETRIC: (3, [2 if s == 3 else 1]), SAMPLES: (3, [s]), PLANAR: (3, [1]), PREDICTOR: (3, [predictor])}
        tags |= {TILE_WIDTH: (4, [tile]), TILE_HEIGHT: (4, [tile]), TILE_OFFSETS: (4, offsets), TILE_BYTES: (4, sizes)} if tile else {STRIP_OFFSETS: (4, offsets), ROWS_PER_STRIP: (4, [rows_per_strip]), STRIP_BYTES: (4, sizes)}
        entries = []
        for tag in sorted(tags):
            kind, values = tags[tag]
            data = struct.pack(f"{order}{len(values)}{FIELD[kind]}", *values)
            if len(data) > 4:
                out += b"\0" * (len(out) % 2)
                at, data = len(out), data
                out += data
                data = struct.pack(order + "I", at)
            entries.append(struct.pack(order + "HHI", tag, kind, len(values)) + data.ljust(4, b"\0"))
        out += b"\0" * (len(out) % 2)
        struct.pack_into(order + "I", out, link, len(out))
        out += struct.pack(order + "H", len(entries)) + b"".join(entries) + b"\0\0\0\0"
        link = len(out) - 4
    return bytes(out)


def read_tiff(data: bytes):
    """Yields (tags, pixels) of every page; raises ValueError on what isn't a readable TIFF."""
    order = {b"II": "<", b"MM": ">"}.get(data[:2])
    if order is None or len(data) < 8 or struct.unpack_from(order + "H", data, 2)[0] != 42:
        raise ValueError("not a TIFF")
    at, seen = struct.unpack_from(order + "I", data, 4)[0], set()
    while at:
        if at in seen:
            raise ValueError("directories form a loop")
        seen.add(at)
        (n,) = struct.unpack_from(order + "H", data, at)
        tags = {}
        if len(data) < at + 6 + 12 * n:
            raise ValueError("a directory lies outside the file")
        for k in range(n):
            tag, kind, count = struct.unpack_from(order + "HHI", data, at + 2 + 12 * k)
            if kind in FIELD:
                if count > len(data):
                    raise ValueError("a field lies outside the file")
                form = f"{order}{count}{FIELD[kind]}"
                where = at + 10 + 12 * k
                if struct.calcsize(form) > 4:
                    where = struct.unpack_from(order + "I", data, where)[0]
                tags[tag] = struct.unpack_from(form, data, where)
        yield tags, _pixels(data, tags)
        (at,) = struct.unpack_from(order + "I", data, at + 2 + 12 * n)


def _pixels(data: bytes, tags: dict) -> np.ndarray:
    one = lambda tag, default=None: tags.get(tag, (default,))[0]
    w, h, s = one(WIDTH), one(HEIGHT), one(SAMPLES, 1)
    if not w or not h or set(tags.get(BITS, (1,))) != {8} or one(PLANAR, 1) != 1:
        raise ValueError("only 8-bit samples in one plane are read")
    if one(COMPRESSION, 1) not in UNPACK or one(PREDICTOR, 1) not in (1, 2):
        raise ValueError("unknown compression or predictor")
    unpack = UNPACK[one(COMPRESSION, 1)]
    tiled = TILE_OFFSETS in tags
    bw, bh = (one(TILE_WIDTH, 0), one(TILE_HEIGHT, 0)) if tiled else (w, min(one(ROWS_PER_STRIP, h), h))
    if min(bw, bh, s) < 1:
        raise ValueError("a size of zero")
    across = -(-w // bw)
    blocks = list(zip(tags[TILE_OFFSETS if tiled else STRIP_OFFSETS], tags[TILE_BYTES if tiled else STRIP_BYTES]))
    if len(blocks) != across * -(-h // bh):
        raise ValueError("strips or tiles are missing, or too many")
    if any(at + size > len(data) for at, size in blocks):
        raise ValueError("a strip or tile lies outside the file")
    if max(w * h, bw * bh) * s > MOST_PIXELS or w * h * s > len(data) * MOST_TIMES:
        raise ValueError("more pixels than a file of this size can hold")
    out = np.empty((h, w, s), np.uint8)
    for k, (at, size) in enumerate(blocks):
        y, x = k // across * bh, k % across * bw
        rows = bh if tiled else min(bh, h - y)
        raw = np.frombuffer(unpack(data[at : at + size]), np.uint8)
        if len(raw) < rows * bw * s:
            raise ValueError("a strip or tile is too short")
        block = raw[: rows * bw * s].reshape(rows, bw, s)
        if one(PREDICTOR, 1) == 2:
            block = np.cumsum(block, axis=1, dtype=np.uint8)
        out[y : y + bh, x : x + bw] = block[: h - y, : w - x]
    return out


PAGE = "page long, width long, height long, samples long, compression string, predictor long, pixels binary, media_bytes long, media_sha256 string, error string"


def pages(media: DataFrame, column: str = "media", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """One row per page of every TIFF in ``column``, with the ``keep`` columns.

    Null media and media that can't be read, for any reason, give one row with a null page and the
    reason in ``error``; pages before a broken directory are still returned.  A page with missing
    strips or tiles is an error, never half a picture.  Repeated rows give repeated pages.
    """
    kept = media.select(*keep, column)
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema.fields[:-1]), PAGE])
    names = [*keep, *(x.split()[0] for x in PAGE.split(", "))]

    def run(batches):
        for b in batches:
            for lo in range(0, b.num_rows, 256):
                part = b.slice(lo, 256)
                rows, of = [], []
                for k, x in enumerate(part.column(len(keep))):
                    data = x.as_py()
                    size, sha = (None, None) if data is None else (len(data), hashlib.sha256(data).hexdigest())
                    n = 0
                    try:
                        if data is None:
                            raise ValueError("null")
                        for tags, px in read_tiff(data):
                            h, w, s = px.shape
                            rows.append((n, w, h, s, NAMES[tags.get(COMPRESSION, (1,))[0]], tags.get(PREDICTOR, (1,))[0], px.tobytes(), size, sha, None))
                            of.append(k)
                            n += 1
                        if not n:
                            raise ValueError("no page")
                    except (ValueError, KeyError, IndexError, TypeError, ArithmeticError, MemoryError, struct.error, zlib.error) as e:
                        rows.append((None, None, None, None, None, None, None, size, sha, str(e) or type(e).__name__))
                        of.append(k)
                kinds = [pa.int64()] * 4 + [pa.string(), pa.int64(), pa.binary(), pa.int64(), pa.string(), pa.string()]
                columns = list(zip(*rows)) or [()] * 10
                yield pa.RecordBatch.from_arrays([*(part.column(i).take(pa.array(of, pa.int64())) for i in range(len(keep))), *(pa.array(c, t) for c, t in zip(columns, kinds))], names)

    return kept.mapInArrow(run, schema)


#: Bytes of one row of the page that holds a payload: 64 pixels of three samples.
ROW = 192


def payload_tiff(payload: bytes) -> bytes:
    """Compression, predictor and layout follow from the payload's checksum alone, at every size."""
    page = np.frombuffer(payload, np.uint8).reshape(-1, 64, 3)
    crc = zlib.crc32(payload)
    return write_tiff([page], (PACKBITS, LZW, DEFLATE)[crc % 3], 1 + crc // 3 % 2, tile=64 * (crc // 6 % 2))


def from_texts(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_bytes, media): each whole text as a TIFF; null counts as empty.

    The UTF-8 bytes, filled with spaces up to a positive multiple of 192, are an RGB page 64 pixels
    wide.  Equal texts give equal files.
    """

    def run(batches):
        for b in batches:
            for lo in range(0, b.num_rows, 256):
                part = b.slice(lo, 256)
                data = [(x or "").encode("utf-8") for x in part.column("text").to_pylist()]
                media = [payload_tiff(x.ljust(max(ROW, -(-len(x) // ROW) * ROW), b" ")) for x in data]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(map(len, data), pa.int64()), pa.array(media, pa.binary())], ["doc_id", "n_bytes", "media"])

    return texts(docs, key, text).mapInArrow(run, "doc_id long, n_bytes long, media binary")
