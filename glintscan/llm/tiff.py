"""TIFF as a media column: files are written from payloads and read back with one row for each page.

The reader walks the chain of image directories in either byte order (classic and 64-bit files), decodes raw,
PackBits, LZW and deflate strips and tiles, undoes horizontal differencing and puts the samples of each page
together. It handles 8 and 16 bits a sample, any number of samples, chunky and planar.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from glintscan.llm.common import free_name, ship, slices

# Fixed values of the format.
WIDTH, HEIGHT, BITS, COMPRESSION, PHOTOMETRIC = 256, 257, 258, 259, 262
STRIP_OFFSETS, SAMPLES, ROWS_PER_STRIP, STRIP_COUNTS, PLANAR = 273, 277, 278, 279, 284
PREDICTOR, TILE_WIDTH, TILE_HEIGHT, TILE_OFFSETS, TILE_COUNTS = 317, 322, 323, 324, 325
FILL_ORDER, SAMPLE_FORMAT = 266, 339
RAW, LZW, DEFLATE, OLD_DEFLATE, PACKBITS = 1, 5, 8, 32946, 32773
TYPE_FORMAT = {1: "B", 2: "B", 3: "H", 4: "I", 6: "b", 7: "B", 8: "h", 9: "i", 13: "I", 16: "Q", 17: "q", 18: "Q"}

LINE = 64
#: Bytes of samples that the pages of one file may have in all: they travel as binary values, which can't hold 2 GB.
MOST = 1 << 30
#: Bytes of samples that go out in one batch (one page at least).
OUT = 32 << 20


class BadFile(ValueError):
    pass


def packbits_decode(data: bytes, most: int = MOST) -> bytes:
    """At least `most` bytes, if the data has as many."""
    out, i = bytearray(), 0
    while i < len(data) and len(out) < most:
        n = data[i]
        i += 1
        if n < 128:
            out += data[i : i + n + 1]
            i += n + 1
        elif n > 128:
            out += data[i : i + 1] * (257 - n)
            i += 1
    return bytes(out)


def packbits_encode(data: bytes) -> bytes:
    out, i, n = bytearray(), 0, len(data)
    while i < n:
        run = 1
        while run < 128 and i + run < n and data[i + run] == data[i]:
            run += 1
        if run > 1:
            out += bytes([257 - run, data[i]])
            i += run
            continue
        start = i
        while i < n and i - start < 128 and not (i + 1 < n and data[i] == data[i + 1]):
            i += 1
        out += bytes([i - start - 1]) + data[start:i]
    return bytes(out)


def lzw_decode(data: bytes, most: int = MOST) -> bytes:
    """Codes of 9 to 12 bits, most significant bit first, that widen one code early; at least `most` bytes, if there are as many."""
    out: list[bytes] = []
    size = 0
    table: list[bytes] = []
    last, width, have, bits = b"", 9, 0, 0
    for byte in data:
        bits = (bits << 8) | byte
        have += 8
        if have < width:
            continue
        have -= width
        code = bits >> have
        bits &= (1 << have) - 1
        if code == 257:
            break
        if code == 256:
            table, last, width = [bytes([i]) for i in range(256)] + [b"", b""], b"", 9
            continue
        if not table:
            raise BadFile("LZW data does not begin with a clear code")
        if code < len(table):
            entry = table[code]
        elif code == len(table) and last:
            entry = last + last[:1]
        else:
            raise BadFile("LZW code out of range")
        out.append(entry)
        size += len(entry)
        if size >= most:
            break
        if last and len(table) < 4096:
            table.append(last + entry[:1])
        last = entry
        width = min(12, max(9, (len(table) + 1).bit_length()))
    return b"".join(out)


def lzw_encode(data: bytes) -> bytes:
    out, bits, have = bytearray(), 0, 0
    fresh = {bytes([i]): i for i in range(256)}
    table, size, width = dict(fresh), 258, 9

    def put(code):
        nonlocal bits, have
        bits = (bits << width) | code
        have += width
        while have >= 8:
            have -= 8
            out.append((bits >> have) & 255)
        bits &= (1 << have) - 1

    put(256)
    word = b""
    for i in range(len(data)):
        longer = word + data[i : i + 1]
        if longer in table:
            word = longer
            continue
        put(table[word])
        table[longer] = size
        size += 1
        if size >= 4094:
            put(256)
            table, size, width = dict(fresh), 258, 9
        else:
            width = max(9, size.bit_length())
        word = data[i : i + 1]
    if word:
        put(table[word])
        width = min(12, max(9, (size + 1).bit_length()))
    put(257)
    if have:
        out.append((bits << (8 - have)) & 255)
    return bytes(out)


def inflate(data: bytes, most: int = MOST) -> bytes:
    """At most `most` bytes of deflated data, so that a few bytes can't claim a whole machine."""
    return zlib.decompressobj().decompress(data, most) if most else b""


DECODERS = {RAW: lambda data, most: data[:most], PACKBITS: packbits_decode, LZW: lzw_decode, DEFLATE: inflate, OLD_DEFLATE: inflate}
ENCODERS = {RAW: bytes, PACKBITS: packbits_encode, LZW: lzw_encode, DEFLATE: lambda b: zlib.compress(b, 1)}


def encode(pages: list[np.ndarray], compression: int = DEFLATE, predictor: int = 1, rows_per_strip: int = 128, tile: tuple[int, int] | None = None, order: str = "<") -> bytes:
    """A file with one directory for each page; a page is an array (rows, columns, samples) of uint8 or uint16."""
    out = bytearray((b"II" if order == "<" else b"MM") + struct.pack(order + "HI", 42, 0))
    link = 4
    for page in pages:
        rows, columns, samples = page.shape
        high, wide = (tile[1], tile[0]) if tile else (min(rows_per_strip, max(1, rows)), columns)
        offsets, counts = [], []
        for top in range(0, rows, high):
            for left in range(0, columns, wide):
                block = page[top : top + high, left : left + wide]
                if tile and block.shape[:2] != (high, wide):
                    whole = np.zeros((high, wide, samples), page.dtype)
                    whole[: block.shape[0], : block.shape[1]] = block
                    block = whole
                if predictor == 2:
                    block = np.diff(block, axis=1, prepend=np.zeros_like(block[:, :1]))
                data = ENCODERS[compression](block.astype(page.dtype.newbyteorder(order)).tobytes())
                offsets.append(len(out))
                counts.append(len(data))
                out += data
        bits = page.dtype.itemsize * 8
        tags = [(WIDTH, "I", [columns]), (HEIGHT, "I", [rows]), (BITS, "H", [bits] * samples), (COMPRESSION, "H", [compression]), (PHOTOMETRIC, "H", [2 if samples == 3 else 1]), (SAMPLES, "H", [samples]), (PREDICTOR, "H", [predictor])]
        tags += [(TILE_WIDTH, "I", [wide]), (TILE_HEIGHT, "I", [high]), (TILE_OFFSETS, "I", offsets), (TILE_COUNTS, "I", counts)] if tile else [(STRIP_OFFSETS, "I", offsets), (ROWS_PER_STRIP, "I", [high]), (STRIP_COUNTS, "I", counts)]
        entries = []
        for tag, kind, values in sorted(tags):
            data = struct.pack(f"{order}{len(values)}{kind}", *values)
            if len(data) > 4:
                out += b"\0" * (len(out) % 2)
                data, at = struct.pack(order + "I", len(out)), data
                out += at
            entries.append(struct.pack(order + "HHI", tag, 3 if kind == "H" else 4, len(values)) + data.ljust(4, b"\0"))
        out += b"\0" * (len(out) % 2)
        struct.pack_into(order + "I", out, link, len(out))
        out += struct.pack(order + "H", len(entries)) + b"".join(entries)
        link = len(out)
        out += struct.pack(order + "I", 0)
    return bytes(out)


def directories(data: bytes) -> tuple[str, list[dict[int, list[int]]]]:
    """Byte order and the tags of each page. A chain that comes back to a directory ends there."""
    order = {b"II": "<", b"MM": ">"}.get(data[:2])
    if order is None or len(data) < 8:
        raise BadFile("not a TIFF file")
    big = struct.unpack_from(order + "H", data, 2)[0] == 43
    at = struct.unpack_from(order + ("Q" if big else "I"), data, 8 if big else 4)[0]
    count_kind, entry, place = ("Q", 20, "Q") if big else ("H", 12, "I")
    found, visited = [], set()
    while at and at not in visited:
        visited.add(at)
        n = struct.unpack_from(order + count_kind, data, at)[0]
        at += struct.calcsize(count_kind)
        tags: dict[int, list[int]] = {}
        for _ in range(n):
            tag, kind = struct.unpack_from(order + "HH", data, at)
            length = struct.unpack_from(order + place, data, at + 4)[0]
            value_at = at + 4 + struct.calcsize(place)
            if kind in TYPE_FORMAT:
                size = struct.calcsize("=" + TYPE_FORMAT[kind]) * length
                if size > struct.calcsize(place):
                    value_at = struct.unpack_from(order + place, data, value_at)[0]
                tags[tag] = list(struct.unpack_from(f"{order}{length}{TYPE_FORMAT[kind]}", data, value_at))
            at += entry
        found.append(tags)
        at = struct.unpack_from(order + place, data, at)[0]
    return order, found


def one(tags: dict[int, list[int]], tag: int, default: int | None = None) -> int:
    """The single value of a tag."""
    values = tags.get(tag) or ([] if default is None else [default])
    if not values:
        raise BadFile(f"tag {tag} is missing")
    return values[0]


def decode_page(data: bytes, order: str, tags: dict[int, list[int]], most: int = MOST) -> np.ndarray:
    """The samples of one page, (rows, columns, samples), of at most `most` bytes. Memory is only taken for data that is there."""
    rows, columns, samples = one(tags, HEIGHT), one(tags, WIDTH), one(tags, SAMPLES, 1)
    bits = tags.get(BITS, [1])
    if set(bits) not in ({8}, {16}):
        raise BadFile(f"{bits[:4]} bits a sample are not handled")
    kind = np.dtype("u1" if bits[0] == 8 else order + "u2")
    method, predictor, planes = one(tags, COMPRESSION, RAW), one(tags, PREDICTOR, 1), one(tags, PLANAR, 1)
    if method not in DECODERS:
        raise BadFile(f"compression {method} is not handled")
    if predictor not in (1, 2):
        raise BadFile(f"predictor {predictor} is not handled")
    if one(tags, FILL_ORDER, 1) != 1:
        raise BadFile("bits in reverse order are not handled")
    if set(tags.get(SAMPLE_FORMAT, [1])) - {1, 4}:
        raise BadFile("samples that are not unsigned numbers are not handled")
    tiled = TILE_OFFSETS in tags
    wide = one(tags, TILE_WIDTH) if tiled else columns
    high = one(tags, TILE_HEIGHT) if tiled else min(rows, one(tags, ROWS_PER_STRIP, rows))
    if min(rows, columns, samples, wide, high) < 1 or planes not in (1, 2):
        raise BadFile("a size of a page is less than 1")
    if rows * columns * samples * kind.itemsize > most or wide * high * samples * kind.itemsize > most:
        raise BadFile("the page is larger than is handled")
    planar = samples if planes == 2 else 1
    deep = samples // planar
    offsets, counts = (tags.get(t, []) for t in ((TILE_OFFSETS, TILE_COUNTS) if tiled else (STRIP_OFFSETS, STRIP_COUNTS)))
    across, down = -(-columns // wide), -(-rows // high)
    if len(offsets) != across * down * planar or len(counts) != len(offsets):
        raise BadFile("wrong number of strips or tiles")
    blocks = []
    for k, (at, size) in enumerate(zip(offsets, counts, strict=True)):
        top = k % (across * down) // across * high
        tall = high if tiled else min(high, rows - top)
        need = tall * wide * deep * kind.itemsize
        raw = DECODERS[method](data[at : at + size], need)
        if len(raw) < need:
            raise BadFile("a strip or tile is too short")
        blocks.append(raw[:need])
    page = np.zeros((rows, columns, samples), kind.newbyteorder("="))
    for k, raw in enumerate(blocks):
        plane, rest = divmod(k, across * down)
        top, left = rest // across * high, rest % across * wide
        tall = high if tiled else min(high, rows - top)
        block = np.frombuffer(raw, kind).reshape(tall, wide, deep).astype(kind.newbyteorder("="))
        if predictor == 2:
            block = np.cumsum(block, axis=1, dtype=block.dtype)
        h, w = min(tall, rows - top), min(wide, columns - left)
        page[top : top + h, left : left + w, plane * deep : plane * deep + deep] = block[:h, :w]
    return page


def decode(data: bytes) -> list[np.ndarray]:
    order, pages = directories(data)
    return [decode_page(data, order, tags) for tags in pages]


def features(page: np.ndarray) -> str:
    """Size, mean (thousandths), greatest value, distinct values, and a 64-bit mask of which of 8 x 8 cells lie above the mean."""
    rows, columns, _ = page.shape
    grey = page.astype(np.int64).sum(axis=2)
    n, total = grey.size, int(grey.sum())
    down, across = np.arange(8) * rows // 8, np.arange(8) * columns // 8
    cells = np.add.reduceat(np.add.reduceat(grey, np.minimum(down, rows - 1), axis=0), np.minimum(across, columns - 1), axis=1)
    counts = np.diff(np.append(down, rows)).clip(1)[:, None] * np.diff(np.append(across, columns)).clip(1)[None, :]
    mask = int("".join("1" if x else "0" for x in (cells * n > total * counts).ravel()), 2)
    distinct = np.count_nonzero(np.bincount(grey.ravel())) if grey.max() < 1 << 16 else len(np.unique(grey))
    return f"{columns}x{rows}:mean={1000 * total // n}:max={int(grey.max())}:distinct={distinct}:cells={mask:016x}"


def store_payloads(df: DataFrame, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Appends `n_bytes long` and `media binary`: a one-page file of 8-bit samples, 64 to a row.

    The samples are the text's UTF-8 bytes followed by bytes 0 up to a positive multiple of 64; a null text counts as
    empty and gives one row of zeros. One row is stored with PackBits, more are differenced and deflated in
    strips. Equal texts give equal files; repeated rows repeat; clashing input columns are replaced.
    """
    ship(df.sparkSession)
    keep = [c for c in (df.columns if keep is None else keep) if c.lower() not in ("n_bytes", "media")]
    src = df.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{text_col}`").cast("binary").alias(free_name(df, "text_in")))
    schema = T.StructType([src.schema[c] for c in keep] + [T.StructField("n_bytes", T.LongType()), T.StructField("media", T.BinaryType())])

    def run(batches):
        for batch in batches:
            for part in slices(batch, len(keep)):
                texts = [b or b"" for b in part.column(len(keep)).to_pylist()]
                files = []
                for b in texts:
                    payload = b.ljust(max(LINE, -(-len(b) // LINE) * LINE), b"\0")
                    page = np.frombuffer(payload, np.uint8).reshape(-1, LINE, 1)
                    files.append(encode([page], PACKBITS if len(page) == 1 else DEFLATE, 1 if len(page) == 1 else 2))
                yield pa.RecordBatch.from_arrays([part.column(i) for i in range(len(keep))] + [pa.array([len(b) for b in texts], pa.int64()), pa.array(files, pa.binary())], names=[*keep, "n_bytes", "media"])

    return src.mapInArrow(run, schema)


PAGE_FIELDS = [("page", T.IntegerType()), ("width", T.IntegerType()), ("height", T.IntegerType()), ("samples", T.IntegerType()), ("bits", T.IntegerType()), ("compression", T.IntegerType()), ("pixels", T.BinaryType()), ("feature", T.StringType()), ("error", T.StringType())]
ARROW = {"IntegerType": pa.int32(), "BinaryType": pa.binary(), "StringType": pa.string()}


def read_pages(df: DataFrame, media_col: str = "media", keep: list[str] | None = None) -> DataFrame:
    """One row for each page of each file, in directory order from page 0, with its samples in native order.

    A file that is null, broken or of a kind not handled (see `decode_page`) gives a single row with a null page and an error,
    as does one whose pages have over MOST bytes of samples; a file without a directory gives the error `no page`.
    Repeated files repeat; clashing input columns are replaced; an empty table stays empty.
    """
    ship(df.sparkSession)
    new = {n for n, _ in PAGE_FIELDS}
    keep = [c for c in (df.columns if keep is None else keep) if c.lower() not in new]
    src = df.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{media_col}`").alias(free_name(df, "media_in")))
    schema = T.StructType([src.schema[c] for c in keep] + [T.StructField(n, t) for n, t in PAGE_FIELDS])

    def batch_of(part, at, rows):
        columns = [pa.array(list(c), ARROW[type(t).__name__]) for c, (_, t) in zip(zip(*rows, strict=True), PAGE_FIELDS, strict=True)]
        kept = part.take(pa.array(at, pa.int64()))
        return pa.RecordBatch.from_arrays([kept.column(i) for i in range(len(keep))] + columns, names=[*keep, *[n for n, _ in PAGE_FIELDS]])

    def run(batches):
        for batch in batches:
            for part in slices(batch, len(keep)):
                at, rows, held = [], [], 0
                for i, data in enumerate(part.column(len(keep)).to_pylist()):
                    made = page_rows(data)
                    size = sum(len(r[6] or b"") for r in made)
                    if rows and held + size > OUT:
                        yield batch_of(part, at, rows)
                        at, rows, held = [], [], 0
                    at += [i] * len(made)
                    rows += made
                    held += size
                if rows:
                    yield batch_of(part, at, rows)

    return src.mapInArrow(run, schema)


def page_rows(data: bytes | None) -> list[tuple]:
    """The values of PAGE_FIELDS for every page of a file; one row with an error if it can't be read."""
    try:
        if data is None:
            raise BadFile("null")
        order, pages = directories(data)
        made, left = [], MOST
        for k, tags in enumerate(pages):
            p = decode_page(data, order, tags, left)
            left -= p.nbytes
            made.append((k, p.shape[1], p.shape[0], p.shape[2], p.dtype.itemsize * 8, one(tags, COMPRESSION, RAW), p.tobytes(), features(p), None))
        if not made:
            raise BadFile("no page")
        return made
    except (ValueError, LookupError, ArithmeticError, MemoryError, struct.error, zlib.error) as e:
        return [(*[None] * 8, str(e) or type(e).__name__)]
