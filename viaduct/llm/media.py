"""Media columns: signatures are sniffed, structures confirmed, declared types corrected and embedded media carved out.

One Aho-Corasick automaton over all magic bytes finds every place in a value where a medium may begin. At each place the
format's validator walks the structure (chunks, segments, blocks, sizes, checksums) and gives the end of the medium, or nothing;
so magic bytes that only happen to stand in a text are not media. From the left, the first confirmed medium counts, and the
search goes on behind its end. The declared type never decides; it is only compared with what was found.

`stored` writes texts as lossless media of eight-bit samples (sound, or pictures of 192 points a row), some of them inside a
carrier with a head of its own, under a declared type that is often wrong: everything follows from the text alone, so equal
texts are stored alike. `read_back` finds, confirms and decodes the medium in a stored value again.

Null and empty texts are one payload of blanks. Values without a medium, null ones too, have an empty list of media, a null
type and null samples. Rows are worked on one by one, so ties, repeats and hot keys need no care. Only the id, the text or
media and the declared type are read.
"""

from __future__ import annotations

import functools
import struct
import zlib
from collections.abc import Callable, Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

ROW = 192
#: Rows whose values are Python objects at the same time.
SLICE = 64
#: Signatures and sizes of the formats (fixed values).
MAGIC = {b"\x89PNG\r\n\x1a\n": "png", b"RIFF": "wav", b"BM": "bmp", b"GIF87a": "gif", b"GIF89a": "gif", b"\xff\xd8\xff": "jpeg", b"\x1f\x8b\x08": "gzip"}
BMP_HEADERS, BMP_BITS = (12, 40, 52, 56, 108, 124), (1, 4, 8, 16, 24, 32)
JPEG_ALONE = (0x01, *range(0xD0, 0xD8))


def png_end(b: bytes, at: int) -> int | None:
    """Chunks with right checksums, a header first, to the end chunk."""
    pos, kinds = at + 8, []
    while pos + 12 <= len(b):
        n, kind = struct.unpack_from(">I4s", b, pos)
        if pos + 12 + n > len(b) or struct.unpack_from(">I", b, pos + 8 + n)[0] != zlib.crc32(b[pos + 4 : pos + 8 + n]) or (not kinds and (kind, n) != (b"IHDR", 13)):
            return None
        kinds.append(kind)
        pos += 12 + n
        if kind == b"IEND":
            return pos if b"IDAT" in kinds else None
    return None


def wav_end(b: bytes, at: int) -> int | None:
    """A RIFF list of the kind WAVE whose chunks fill it, format and data among them."""
    if at + 12 > len(b) or b[at + 8 : at + 12] != b"WAVE":
        return None
    end, pos, kinds = at + 8 + struct.unpack_from("<I", b, at + 4)[0], at + 12, []
    if end > len(b):
        return None
    while pos + 8 <= end:
        kind, n = struct.unpack_from("<4sI", b, pos)
        if pos + 8 + n > end:
            return None
        kinds.append(kind)
        pos += 8 + n + (n & 1)
    return end if b"fmt " in kinds and b"data" in kinds and pos >= end else None


def bmp_end(b: bytes, at: int) -> int | None:
    """Sizes of file, header and points that agree."""
    if at + 34 > len(b):
        return None
    size, _, offset, header = struct.unpack_from("<IIII", b, at + 2)
    if header not in BMP_HEADERS[1:] or at + size > len(b):
        return None
    width, height, planes, bits, packed = struct.unpack_from("<iiHHI", b, at + 18)
    fits = planes == 1 and bits in BMP_BITS and width > 0 and height != 0 and offset >= 14 + header
    if not fits or (packed == 0 and offset + (width * bits + 31) // 32 * 4 * abs(height) > size):
        return None
    return at + size if offset <= size else None


def gif_end(b: bytes, at: int) -> int | None:
    """Tables and blocks of sub-blocks to the trailer, at least one picture among them."""

    def table(flags: int) -> int:
        return 3 << ((flags & 7) + 1) if flags & 0x80 else 0

    def skipped(pos: int) -> int:
        while pos < len(b) and b[pos]:
            pos += 1 + b[pos]
        return pos + 1

    if at + 13 > len(b):
        return None
    pos, pictures = at + 13 + table(b[at + 10]), 0
    while pos < len(b):
        if b[pos] == 0x3B:
            return pos + 1 if pictures else None
        if b[pos] == 0x21:
            pos = skipped(pos + 2)
        elif b[pos] == 0x2C and pos + 10 < len(b):
            pos, pictures = skipped(pos + 11 + table(b[pos + 9])), pictures + 1
        else:
            return None
    return None


def jpeg_end(b: bytes, at: int) -> int | None:
    """Segments by their lengths, scans up to the next marker, to the end marker; a frame and a scan among them."""
    pos, frame, scan = at + 2, False, False
    while pos + 2 <= len(b):
        if b[pos] != 0xFF:
            return None
        kind = b[pos + 1]
        if kind == 0xD9:
            return pos + 2 if frame and scan else None
        if kind == 0xFF or kind in JPEG_ALONE:
            pos += 1 if kind == 0xFF else 2
            continue
        if pos + 4 > len(b) or (n := struct.unpack_from(">H", b, pos + 2)[0]) < 2:
            return None
        frame |= 0xC0 <= kind <= 0xCF and kind not in (0xC4, 0xC8, 0xCC)
        pos += 2 + n
        if kind == 0xDA:
            scan = True
            while (pos := b.find(b"\xff", pos)) >= 0 and pos + 1 < len(b) and (b[pos + 1] == 0 or b[pos + 1] in JPEG_ALONE):
                pos += 2
            if pos < 0:
                return None
    return None


def gzip_end(b: bytes, at: int) -> int | None:
    """One member whose stream, checksum and length are right; unpacked in parts, and thrown away."""
    d, pos = zlib.decompressobj(31), at
    try:
        while pos < len(b) and not d.eof:
            part = d.unconsumed_tail or b[pos : pos + 65536]
            if not d.unconsumed_tail:
                pos += len(part)
            d.decompress(part, 1 << 20)
    except zlib.error:
        return None
    return pos - len(d.unused_data) if d.eof else None


ENDS: dict[str, Callable[[bytes, int], int | None]] = {"png": png_end, "wav": wav_end, "bmp": bmp_end, "gif": gif_end, "jpeg": jpeg_end, "gzip": gzip_end}


@functools.cache
def automaton() -> ahocorasick.Automaton:
    a = ahocorasick.Automaton()
    for magic, kind in MAGIC.items():
        a.add_word(magic.decode("latin-1"), (len(magic), kind))
    a.make_automaton()
    return a


def sniff(b: bytes) -> list[tuple[str, int, int]]:
    """(type, offset, length) of the confirmed media, from the left, none inside another."""
    found, free = [], 0
    for last, (n, kind) in automaton().iter(b.decode("latin-1")):
        at = last - n + 1
        if at >= free and (end := ENDS[kind](b, at)) is not None:
            found.append((kind, at, end - at))
            free = end
    return found


def _chunk(kind: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))


def to_wav(samples: bytes) -> bytes:
    odd = b"\0" * (len(samples) & 1)
    head = struct.pack("<4sIHHIIHH4sI", b"fmt ", 16, 1, 1, 8000, 8000, 1, 8, b"data", len(samples))
    return struct.pack("<4sI4s", b"RIFF", 4 + len(head) + len(samples) + len(odd), b"WAVE") + head + samples + odd


def to_png(samples: bytes) -> bytes:
    """Grey, ROW points a row, each row as its difference to the row above."""
    rows = np.frombuffer(samples, np.uint8).reshape(-1, ROW)
    up = rows.copy()
    up[1:] -= rows[:-1]
    lines = np.concatenate([np.full((len(rows), 1), 2, np.uint8), up], axis=1).tobytes()
    return b"\x89PNG\r\n\x1a\n" + _chunk(b"IHDR", struct.pack(">IIBBBBB", ROW, len(rows), 8, 0, 0, 0, 0)) + _chunk(b"IDAT", zlib.compress(lines, 1)) + _chunk(b"IEND", b"")


def to_bmp(samples: bytes) -> bytes:
    """256 greys, ROW points a row, from the top."""
    palette = b"".join(bytes((k, k, k, 0)) for k in range(256))
    head = struct.pack("<IiiHHIIiiII", 40, ROW, -(len(samples) // ROW), 1, 8, 0, len(samples), 2835, 2835, 256, 0)
    offset = 14 + len(head) + len(palette)
    return struct.pack("<2sIII", b"BM", offset + len(samples), 0, offset) + head + palette + samples


WRITE: dict[str, Callable[[bytes], bytes]] = {"wav": to_wav, "png": to_png, "bmp": to_bmp}


def from_wav(b: bytes) -> bytes | None:
    pos, eight = 12, False
    while pos + 8 <= len(b):
        kind, n = struct.unpack_from("<4sI", b, pos)
        if kind == b"fmt " and n >= 16:
            form, channels, _, _, _, bits = struct.unpack_from("<HHIIHH", b, pos + 8)
            eight = (form, channels, bits) == (1, 1, 8)
        if kind == b"data":
            return b[pos + 8 : pos + 8 + n] if eight else None
        pos += 8 + n + (n & 1)
    return None


def from_png(b: bytes) -> bytes | None:
    pos, width, height, packed = 8, 0, 0, []
    while pos + 12 <= len(b):
        n, kind = struct.unpack_from(">I4s", b, pos)
        if kind == b"IHDR":
            width, height, *form = struct.unpack_from(">IIBBBBB", b, pos + 8)
            if form != [8, 0, 0, 0, 0]:
                return None
        elif kind == b"IDAT":
            packed.append(b[pos + 8 : pos + 8 + n])
        pos += 12 + n
    try:
        lines = np.frombuffer(zlib.decompress(b"".join(packed)), np.uint8)
    except zlib.error:
        return None
    if lines.size != height * (width + 1):
        return None
    lines = lines.reshape(height, width + 1)
    if not lines.size or not (lines[:, 0] == 2).all():  # other filters are not written here
        return lines[:, 1:].tobytes() if lines.size and not lines[:, 0].any() else None
    return np.add.accumulate(lines[:, 1:], axis=0, dtype=np.uint8).tobytes()


def from_bmp(b: bytes) -> bytes | None:
    offset, (width, height, _, bits, packed) = struct.unpack_from("<I", b, 10)[0], struct.unpack_from("<iiHHI", b, 18)
    if bits != 8 or packed:
        return None
    stride = (width + 3) // 4 * 4
    rows = np.frombuffer(b, np.uint8, stride * abs(height), offset).reshape(abs(height), stride)[:, :width]
    return (rows if height < 0 else rows[::-1]).tobytes()


READ: dict[str, Callable[[bytes], bytes | None]] = {"wav": from_wav, "png": from_png, "bmp": from_bmp}


def payload(text: str | None) -> bytes:
    """UTF-8 with blanks up to a positive multiple of ROW."""
    b = (text or "").encode("utf-8", "surrogatepass")
    return b + b" " * ((-len(b)) % ROW or (0 if b else ROW))


def as_medium(samples: bytes) -> tuple[bytes, str]:
    """(stored value, declared type). Format, carrier and declared type follow from the checksum of the samples."""
    names, mark = list(WRITE), zlib.crc32(samples)
    kind, declared = names[mark % 3], names[mark // 3 % 3]
    medium = WRITE[kind](samples)
    if mark // 9 % 4 == 0:
        medium = b"--part\r\nContent-Type: " + declared.encode() + b"\r\n\r\n" + medium + b"\r\n--part--\r\n"
    return medium, declared


def traits(samples: bytes) -> str:
    """Mean and spread of the samples in hundredths, the share of steps that cross the mean, and a profile of 16 levels."""
    x = np.frombuffer(samples, np.uint8).astype(np.int64)
    n, total = len(x), int(x.sum())
    spread = int((x * x).sum()) * n - total * total  # of whole numbers, so that the text is the same everywhere
    over = x * n > total
    crossings = int((over[1:] != over[:-1]).sum())
    cuts = np.arange(16) * n // 16
    levels = np.add.reduceat(x, cuts) // np.maximum(np.diff(np.append(cuts, n)), 1) if n >= 16 else x
    return f"{100 * total // n}/{10000 * spread // (n * n)}/{1000 * crossings // n}/{bytes(levels.tolist()).hex()}"


def _by_rows(df: DataFrame, columns: list[str], schema: str, one: Callable[..., tuple], carried: int = 1) -> DataFrame:
    """one(values of the columns behind the carried ones) for each row, in front of it the carried columns."""
    from pyspark.sql.pandas.types import to_arrow_type

    kinds = [df.schema[c].dataType for c in columns[:carried]]
    own = df.sparkSession.createDataFrame([], schema).schema
    names, types = [*columns[:carried], *own.names], [to_arrow_type(f.dataType) for f in own]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                part = batch.slice(at, SLICE)
                rows = [one(*values) for values in zip(*(c.to_pylist() for c in part.columns[carried:]), strict=True)]
                yield pa.RecordBatch.from_arrays([*part.columns[:carried], *(pa.array(list(c), t) for c, t in zip(zip(*rows, strict=True), types, strict=True))], names)

    head = "".join(f"`{c}` {k.simpleString()}, " for c, k in zip(columns[:carried], kinds, strict=True))
    return df.select(*(f"`{c}`" for c in columns)).mapInArrow(run, head + schema)


def stored(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_bytes long, media binary, declared string) of every whole text; n_bytes without the blanks."""

    def one(text: str | None) -> tuple:
        return len((text or "").encode("utf-8", "surrogatepass")), *as_medium(payload(text))

    return _by_rows(df, [id_col, text_col], "n_bytes long, media binary, declared string", one)


FOUND = "array<struct<type: string, offset: long, length: long>>"


def sniffed(df: DataFrame, media_col: str = "media", declared_col: str = "declared", keep: list[str] | None = None) -> DataFrame:
    """(kept columns, found, type, corrected): the confirmed media of each value, the first one's type, and whether another one was declared."""

    def one(b: bytes | None, declared: str | None) -> tuple:
        found = sniff(b or b"")
        kind = found[0][0] if found else None
        return found, kind, kind is not None and kind != declared

    keep = keep or []
    return _by_rows(df, [*keep, media_col, declared_col], f"found {FOUND}, type string, corrected boolean", one, len(keep))


def carved(df: DataFrame, media_col: str = "media", keep: list[str] | None = None) -> DataFrame:
    """(kept columns, media array<struct<type, offset, bytes>>): every confirmed medium of each value, cut out."""

    def one(b: bytes | None) -> tuple:
        return ([(kind, at, b[at : at + n]) for kind, at, n in sniff(b or b"")],)

    keep = keep or []
    return _by_rows(df, [*keep, media_col], "media array<struct<type: string, offset: long, bytes: binary>>", one, len(keep))


def read_back(df: DataFrame, keep: list[str], media_col: str = "media", declared_col: str = "declared") -> DataFrame:
    """(kept columns, samples binary, type string, feature string): the first medium that is confirmed and can be decoded.

    feature: type found, type declared, offset, media inside the samples, and the samples' traits."""

    def one(b: bytes | None, declared: str | None) -> tuple:
        for kind, at, n in sniff(b or b""):
            samples = READ[kind](b[at : at + n]) if kind in READ else None
            if samples:
                return samples, kind, f"{kind}/{declared}/{at}/{len(sniff(samples))}/{traits(samples)}"
        return None, None, None

    return _by_rows(df, [*keep, media_col, declared_col], "samples binary, type string, feature string", one, len(keep))
