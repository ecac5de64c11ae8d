"""Media columns: signature sniffing.

An Aho-Corasick automaton finds the magic bytes of all known formats in one pass over
a blob; a validator per format then confirms structure and length at each hit. The
outermost confirmed item at offset 0 corrects the declared type, every confirmed item
is carved as (offset, length, type, depth). Work is row by row inside a task, nothing
is shuffled and nothing but the current blob is held.

Defined results: a null blob has type null and no items, an empty or unknown blob has
type application/octet-stream, a hit whose structure does not hold is not an item.
"""

from __future__ import annotations

import bisect
import hashlib
import re
import struct
import zlib

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import materialize

UNKNOWN = "application/octet-stream"
UNIT = 192
RATE = 16_000

# Format signatures as their specifications give them (bytes, where the item starts before them, type).
SIGNATURES = [
    (b"\x89PNG\r\n\x1a\n", 0, "image/png"),
    (b"GIF87a", 0, "image/gif"),
    (b"GIF89a", 0, "image/gif"),
    (b"\xff\xd8\xff", 0, "image/jpeg"),
    (b"BM", 0, "image/bmp"),
    (b"RIFF", 0, "riff"),
    (b"fLaC", 0, "audio/flac"),
    (b"OggS", 0, "application/ogg"),
    (b"%PDF-", 0, "application/pdf"),
    (b"PK\x03\x04", 0, "application/zip"),
    (b"\x1f\x8b\x08", 0, "application/gzip"),
    (b"ftyp", 4, "video/mp4"),
    (b"\x1a\x45\xdf\xa3", 0, "video/x-matroska"),
    (b"7z\xbc\xaf\x27\x1c", 0, "application/x-7z-compressed"),
    (b"II*\x00", 0, "image/tiff"),
    (b"MM\x00*", 0, "image/tiff"),
    (b"ID3", 0, "audio/mpeg"),
]

# kbit/s of MPEG-1 and MPEG-2 layer III frames, sampling rates of MPEG-1, bytes of TIFF's field types.
MPEG_KBITS = {1: (0, 32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320), 2: (0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160)}
MPEG_HERTZ = (44100, 48000, 32000)
TIFF_BYTES = {1: 1, 2: 1, 3: 2, 4: 4, 5: 8, 6: 1, 7: 1, 8: 2, 9: 4, 10: 8, 11: 4, 12: 8}

_places: dict[bytes, tuple[bytes, list]] = {}


def places(b: bytes, pattern: re.Pattern) -> list[re.Match]:
    """All matches of a pattern in a blob, found once for all hits in it."""
    held = _places.get(pattern.pattern)
    if held is None or held[0] is not b:
        held = _places[pattern.pattern] = b, list(pattern.finditer(b))
    return held[1]


def behind(found: list[re.Match], at: int) -> int:
    """The number of the first match that starts at `at` or later."""
    return bisect.bisect_left(found, at, key=lambda m: m.start())


def _png(b: bytes, at: int) -> int:
    p = at + 8
    while p + 12 <= len(b):
        n, kind = struct.unpack_from(">I4s", b, p)
        if p + 12 + n > len(b) or zlib.crc32(b[p + 4 : p + 8 + n]) != struct.unpack_from(">I", b, p + 8 + n)[0]:
            return 0
        p += 12 + n
        if kind == b"IEND":
            return p - at
    return 0


def _gif(b: bytes, at: int) -> int:
    def blocks(p: int) -> int:
        while p < len(b) and b[p]:
            p += b[p] + 1
        return p + 1 if p < len(b) else len(b) + 1

    if at + 13 > len(b):
        return 0
    flags = b[at + 10]
    p = at + 13 + (3 << ((flags & 7) + 1) if flags & 128 else 0)
    while p < len(b):
        if b[p] == 0x3B:
            return p + 1 - at
        if b[p] == 0x21:
            p = blocks(p + 2)
        elif b[p] == 0x2C and p + 10 <= len(b):
            local = b[p + 9]
            p = blocks(p + 10 + (3 << ((local & 7) + 1) if local & 128 else 0) + 1)
        else:
            return 0
    return 0


def _jpeg(b: bytes, at: int) -> int:
    p = at + 2
    while p + 4 <= len(b) and b[p] == 0xFF:
        mark = b[p + 1]
        if mark == 0xD9:
            return p + 2 - at
        if mark == 0xFF or 0xD0 <= mark <= 0xD7 or mark == 1:
            p += 1 if mark == 0xFF else 2
            continue
        n = struct.unpack_from(">H", b, p + 2)[0]
        if n < 2:
            return 0
        p += 2 + n
        if mark == 0xDA:  # entropy-coded data ends at a marker that is neither stuffing nor a restart
            end = re.compile(rb"\xff[^\x00\xd0-\xd7\xff]", re.S).search(b, p)
            if not end:
                return 0
            p = end.start()
    return 2 + p - at if b[p : p + 2] == b"\xff\xd9" else 0


def _bmp(b: bytes, at: int) -> int:
    if at + 54 > len(b):
        return 0
    size, spare, start, head, wide, high, planes, bits = struct.unpack_from("<IIIIiiHH", b, at + 2)
    whole = spare == 0 and planes == 1 and bits in (1, 4, 8, 16, 24, 32) and head in (40, 108, 124) and wide > 0 and high
    return size if whole and 54 <= start <= size and at + size <= len(b) else 0


def _riff(b: bytes, at: int) -> int:
    if at + 12 > len(b):
        return 0
    end = at + 8 + struct.unpack_from("<I", b, at + 4)[0]
    if end > len(b) or b[at + 8 : at + 12] not in (b"WAVE", b"WEBP", b"AVI "):
        return 0
    p = at + 12
    while p + 8 <= end:
        p += 8 + (n := struct.unpack_from("<I", b, p + 4)[0]) + (n & 1)
    return end - at if p == end else 0


def _flac(b: bytes, at: int) -> int:
    p, last = at + 4, False
    while not last and p + 4 <= len(b):
        last, n = bool(b[p] & 128), int.from_bytes(b[p + 1 : p + 4], "big")
        if p == at + 4 and (b[p] & 127 or n != 34):
            return 0
        p += 4 + n
    if not last or b[p : p + 1] != b"\xff":
        return 0
    # frames begin at a sync code with a right header sum; a stream says nowhere where its last frame ends, so it reaches to the next
    # known item's start at the latest, and here to the end
    head = b[p : p + 16]
    return len(b) - at if any(crc8(head[:n]) == head[n] for n in range(5, min(16, len(head)))) else 0


def crc8(data: bytes) -> int:
    """The sum of a FLAC frame's header (polynomial 7)."""
    x = 0
    for c in data:
        x ^= c
        for _ in range(8):
            x = (x << 1 ^ 7) & 255 if x & 128 else x << 1
    return x


def _ogg(b: bytes, at: int) -> int:
    p = at
    while b[p : p + 5] == b"OggS\x00" and p + 27 + b[p + 26] <= len(b) if p + 27 <= len(b) else False:
        n = b[p + 26]
        size = 27 + n + sum(b[p + 27 : p + 27 + n])
        if p + size > len(b):
            break
        p += size
    return p - at


PDF_END = re.compile(rb"startxref\s+(\d{1,12})\s+%%EOF")
PDF_TABLE = re.compile(rb"xref\b|\d+\s+\d+\s+obj\b")


PDF_HEAD = re.compile(rb"%PDF-")
PDF_STOP = re.compile(rb"%%EOF")
ZIP_END = re.compile(rb"PK\x05\x06")


def _pdf(b: bytes, at: int) -> int:
    """To the last end mark whose table is reached from this head and from no later one; if there is none, to the first."""
    heads, marks, size = places(b, PDF_HEAD), places(b, PDF_END), 0
    own = behind(heads, at)
    for mark in marks[behind(marks, at) :]:
        for i in range(behind(heads, mark.start()) - 1, own - 1, -1):
            table = heads[i].start() + int(mark[1])
            if table < mark.start() and PDF_TABLE.match(b, table):
                size = mark.end() - at if i == own else size
                break
    if size:
        return size
    stops = places(b, PDF_STOP)
    stop = behind(stops, at)
    return stops[stop].end() - at if stop < len(stops) and b.find(b"startxref", at, stops[stop].start()) >= 0 else 0


def _zip(b: bytes, at: int) -> int:
    """To the first end record whose offsets fit; those of archives stored inside don't."""
    ends = places(b, ZIP_END)
    for end in (m.start() for m in ends[behind(ends, at) :]):
        if end > len(b) - 22:
            break
        size, start, note = struct.unpack_from("<IIH", b, end + 12)
        if start + size == end - at and end + 22 + note <= len(b):
            return end + 22 + note - at
    return 0


def _vint(b: bytes, p: int) -> tuple[int | None, int]:
    """A Matroska size (None: unknown) and where it ends; (0, 0) if there is none."""
    if p >= len(b) or not b[p]:
        return 0, 0
    n = 9 - b[p].bit_length()
    value = int.from_bytes(b[p : p + n], "big") & ((1 << 7 * n) - 1)
    return (None if value == (1 << 7 * n) - 1 else value), p + n


def _matroska(b: bytes, at: int) -> int:
    """The head and the segment behind it; a segment of unknown size reaches to the end."""
    size, p = _vint(b, at + 4)
    if not p or size is None or b.find(b"\x42\x82", p, p + size) < 0:  # the head names its document type
        return 0
    p += size
    if b[p : p + 4] != b"\x18\x53\x80\x67":
        return 0
    size, p = _vint(b, p + 4)
    end = len(b) if size is None else p + size
    return end - at if p and end <= len(b) else 0


def _seven_zip(b: bytes, at: int) -> int:
    if at + 32 > len(b) or zlib.crc32(b[at + 12 : at + 32]) != struct.unpack_from("<I", b, at + 8)[0]:
        return 0
    start, size, crc = struct.unpack_from("<QQI", b, at + 12)
    end = at + 32 + start + size
    return end - at if end <= len(b) and zlib.crc32(b[end - size : end]) == crc else 0


def _tiff(b: bytes, at: int) -> int:
    """To the end of the last directory, value, strip or tile that the directories name."""
    order = "<" if b[at : at + 1] == b"I" else ">"
    end, seen, p = 8, set(), struct.unpack_from(f"{order}I", b, at + 4)[0] if at + 8 <= len(b) else 0
    while p and p not in seen and at + p + 2 <= len(b):
        seen.add(p)
        n = struct.unpack_from(f"{order}H", b, at + p)[0]
        last = p + 2 + 12 * n
        if not n or at + last + 4 > len(b):
            return 0
        end, data = max(end, last + 4), {}
        for i in range(n):
            tag, kind, count, place = struct.unpack_from(f"{order}HHII", b, at + p + 2 + 12 * i)
            size = TIFF_BYTES.get(kind, 0) * count
            where = place if size > 4 else p + 10 + 12 * i
            if not size or at + where + size > len(b):
                return 0
            end = max(end, where + size)
            if tag in (273, 279, 324, 325) and kind in (3, 4):  # places and bytes of strips and tiles
                data[tag] = struct.unpack_from(f"{order}{count}{'H' if kind == 3 else 'I'}", b, at + where)
        for a, c in ((273, 279), (324, 325)):
            for x, size in zip(data.get(a, ()), data.get(c, ()), strict=False):
                if at + x + size > len(b):
                    return 0
                end = max(end, x + size)
        p = struct.unpack_from(f"{order}I", b, at + last)[0]
    return end if seen else 0


def _mp3(b: bytes, at: int) -> int:
    """The tag and the layer III frames behind it, two at least."""
    head = b[at : at + 10]
    if len(head) < 10 or head[3] > 4 or any(x & 128 for x in head[6:10]):
        return 0
    p, frames = at + 10 + (head[6] << 21 | head[7] << 14 | head[8] << 7 | head[9]), 0
    while p + 4 <= len(b):
        word = struct.unpack_from(">I", b, p)[0]
        version, layer, rate, hertz = word >> 19 & 3, word >> 17 & 3, word >> 12 & 15, word >> 10 & 3
        if word >> 21 != 0x7FF or version == 1 or layer != 1 or rate in (0, 15) or hertz == 3:
            break
        old = version == 3
        size = (144 if old else 72) * MPEG_KBITS[1 if old else 2][rate] * 1000 // (MPEG_HERTZ[hertz] >> (0 if old else 1 if version == 2 else 2)) + (word >> 9 & 1)
        if p + size > len(b):
            break
        p, frames = p + size, frames + 1
    return p - at if frames > 1 else 0


def _gzip(b: bytes, at: int) -> int:
    stream = zlib.decompressobj(31)
    try:
        for p in range(at, len(b), 1 << 16):
            part = b[p : p + (1 << 16)]
            while part and not stream.eof:
                stream.decompress(part, 1 << 20)
                part = stream.unconsumed_tail
            if stream.eof:
                return min(p + (1 << 16), len(b)) - len(stream.unused_data) - at
    except zlib.error:
        return 0
    return 0


#: Boxes that may have size 0: they reach to the end.
TO_THE_END = (b"mdat", b"moov", b"moof", b"meta", b"free", b"skip", b"wide", b"uuid")


def _mp4(b: bytes, at: int) -> int:
    p = at
    while p + 8 <= len(b):
        n, kind = struct.unpack_from(">I4s", b, p)
        least = 8
        if n == 1 and p + 16 <= len(b):  # the size stands behind the kind
            n, least = struct.unpack_from(">Q", b, p + 8)[0], 16
        elif n == 0 and p > at and kind in TO_THE_END:
            n = len(b) - p
        if n < least or p + n > len(b) or not kind.isalnum() or p == at and n > 256:
            break
        p += n
    return p - at


VALIDATORS = {"image/png": _png, "image/gif": _gif, "image/jpeg": _jpeg, "image/bmp": _bmp, "riff": _riff, "audio/flac": _flac, "application/ogg": _ogg, "application/pdf": _pdf, "application/zip": _zip, "application/gzip": _gzip, "video/mp4": _mp4, "video/x-matroska": _matroska, "application/x-7z-compressed": _seven_zip, "image/tiff": _tiff, "audio/mpeg": _mp3}
RIFF_KINDS = {b"WAVE": "audio/wav", b"WEBP": "image/webp", b"AVI ": "video/x-msvideo"}
_automaton = None


def automaton():
    """The Aho-Corasick automaton of all signatures; bytes are looked up as Latin-1 text."""
    global _automaton
    if _automaton is None:
        _automaton = ahocorasick.Automaton()
        for magic, back, kind in SIGNATURES:
            _automaton.add_word(magic.decode("latin-1"), (len(magic), back, kind))
        _automaton.make_automaton()
    return _automaton


def carve(blob: bytes) -> list[tuple[int, int, str, int]]:
    """(offset, length, type, depth) of the confirmed items, by offset; depth counts the items around one."""
    items = []
    for last, (n, back, kind) in automaton().iter(blob.decode("latin-1")):
        at = last - n + 1 - back
        if at < 0 or not (size := VALIDATORS[kind](blob, at)):
            continue
        items.append((at, size, RIFF_KINDS[blob[at + 8 : at + 12]] if kind == "riff" else kind))
    found, around = [], []
    for at, size, kind in sorted(items, key=lambda x: (x[0], -x[1])):  # a magic may stand some bytes behind its item's start
        while around and around[-1] <= at:
            around.pop()
        found.append((at, size, kind, len(around)))
        around.append(at + size)
    return found


ITEM = T.StructType().add("offset", "long").add("length", "long").add("type", "string").add("depth", "integer")
SNIFFED = pa.struct([("type", pa.string()), ("items", pa.list_(pa.struct([("offset", pa.int64()), ("length", pa.int64()), ("type", pa.string()), ("depth", pa.int32())])))])


@F.arrow_udf(T.StructType().add("type", "string").add("items", T.ArrayType(ITEM)))
def sniff(blobs: pa.Array) -> pa.Array:
    """The type of each blob (that of an item at offset 0 that fills it or leads it) and all its items."""
    out = []
    for x in blobs:
        if not x.is_valid:
            out.append({"type": None, "items": []})
            continue
        items = carve(x.as_buffer().to_pybytes())
        lead = next((kind for at, _, kind, _ in items if at == 0), UNKNOWN)
        out.append({"type": lead, "items": [dict(zip(("offset", "length", "type", "depth"), i, strict=True)) for i in items]})
    return pa.array(out, SNIFFED)


def correct_types(media: DataFrame, blob_col: str, declared_col: str, out_col: str = "sniffed") -> DataFrame:
    """media with `out_col` (type, items) and `declared_col` put right where the bytes say otherwise."""
    if out_col.lower() in (c.lower() for c in media.columns):
        raise ValueError(f"media has a column {out_col} already: name another out_col")
    found = media.withColumn(out_col, sniff(F.col(blob_col)))
    kind = F.col(out_col)["type"]
    return found.withColumn(declared_col, F.when(kind.isNotNull() & (kind != UNKNOWN), kind).otherwise(F.col(declared_col)))


def embedded(media: DataFrame, id_col: str, blob_col: str, out_col: str = "sniffed") -> DataFrame:
    """A row for each item that lies inside or behind the leading one: id, offset, length, type, depth, bytes."""
    item = F.explode(F.filter(F.col(out_col)["items"], lambda i: i["offset"] > 0))
    rows = media.select(F.col(id_col).alias("id"), F.col(blob_col).alias("blob"), item.alias("item"))
    part = F.substring("blob", (F.col("item.offset") + 1).cast("int"), F.col("item.length").cast("int"))
    return rows.select(F.col("id").alias(id_col), "item.*", part.alias("bytes"))


# ------------------------------------------------------- lossless 8-bit samples


def wav_header(n: int) -> bytes:
    """Header of a mono file of n 8-bit samples."""
    return struct.pack("<4sI4s4sIHHIIHH4sI", b"RIFF", 36 + n, b"WAVE", b"fmt ", 16, 1, 1, RATE, RATE, 1, 8, b"data", n)


def wav_samples(blob: bytes, at: int, size: int) -> bytes:
    """The data chunk of the file carved at `at`."""
    p, end = at + 12, at + size
    while p + 8 <= end:
        name, n = struct.unpack_from("<4sI", blob, p)
        if name == b"data":
            return blob[p + 8 : p + 8 + n]
        p += 8 + n + (n & 1)
    raise ValueError("no data chunk")


@F.arrow_udf(T.StructType().add("n_bytes", "long").add("media", "binary"))
def as_samples(texts: pa.Array) -> pa.Array:
    """Each text (null: empty) as UTF-8, padded with spaces to a positive multiple of 192, as an 8-bit audio file."""
    sizes, media = [], []
    for x in texts:
        data = x.as_buffer().to_pybytes() if x.is_valid else b""
        n = max(1, -(-len(data) // UNIT)) * UNIT
        sizes.append(len(data))
        media.append(wav_header(n) + data.ljust(n, b" "))
    return pa.StructArray.from_arrays([pa.array(sizes, pa.int64()), pa.array(media, pa.binary())], ["n_bytes", "media"])


FEATURES = [("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("feature", pa.string()), ("n_items", pa.int64())]


@F.arrow_udf(T.StructType([T.StructField(n, T.StringType() if t == pa.string() else T.LongType()) for n, t in FEATURES]))
def sample_features(blobs: pa.Array) -> pa.Array:
    """Sniff each stored file, carve it, and describe its samples."""
    rows: list[tuple] = []
    for x in blobs:
        blob = x.as_buffer().to_pybytes()
        items = carve(blob)
        at, size, kind, _ = items[0]
        data = wav_samples(blob, at, size)
        level = np.frombuffer(data, np.uint8)
        feature = f"{kind};samples={len(data)};sum={int(level.sum(dtype=np.int64))};peak={int(level.max())};low={int(level.min())}"
        rows.append((len(data), hashlib.sha256(data).hexdigest(), zlib.crc32(data[-16:]), len(blob), hashlib.sha256(blob).hexdigest(), feature, len(items)))
    cols = list(zip(*rows, strict=True)) or [()] * len(FEATURES)
    return pa.StructArray.from_arrays([pa.array(c, t) for c, (_, t) in zip(cols, FEATURES, strict=True)], [n for n, _ in FEATURES])


def store_samples(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, declared type and stored media bytes: written to the shared folder and read back."""
    stored = docs.select(F.col(id_col).alias("doc_id"), as_samples(F.col(text_col)).alias("s")).select("doc_id", "s.n_bytes", F.lit(UNKNOWN).alias("declared"), "s.media")
    return materialize(stored, "media")[0]


def text_media_features(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The digest of every text stored as media and read back."""
    stored = store_samples(docs, id_col, text_col)
    return stored.select("doc_id", "n_bytes", sample_features(F.col("media")).alias("f")).select("doc_id", "n_bytes", "f.*")
