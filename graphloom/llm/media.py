"""Media columns by signature sniffing (operator 2).

One Aho-Corasick pass over a byte string finds every magic number of the
formats below; a validator for each format then walks its structure (chunk
lengths, checksums, markers) and says where the object ends, or that it is
none. From this come the true type of a declared column, and the media carved
out of a larger byte string.

store() puts any bytes into an 8-bit mono PCM RIFF file, the samples being the
payload; load() sniffs, validates and reads format and samples back. The query
stores every text, and takes type, format, samples and carved objects from the
stored bytes by correct_types() and read_back().

Nulls: null bytes sniff as null; a null text is stored as an empty one (64 zero
bytes); a null doc_id stays. Repeated rows are kept. Ties: of objects that
overlap the outermost, first one is carved. An empty table gives an empty one.
Other columns pass through correct_types() and read_back(); those that they add
give way to columns of the same name. Texts of any length are handled whole, a few megabytes
or one text at a time. Pages and blocks of Ogg, GIF, JPEG and RIFF that many
objects of one text share are walked once (_walk), so that time grows with the
text's length; PNG chunks and gzip members, which texts can't hold, are read for each object.
"""

from __future__ import annotations

import struct
import zlib
from bisect import bisect_left
from collections.abc import Callable, Iterator
from typing import NamedTuple

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import textkit as tk

BLOCK = 64
RATE = 8000
#: Bytes that are inflated at once.
_STEP = 1 << 16
#: The bytes at hand and what is known of them.
_held: list = []


class Found(NamedTuple):
    kind: str
    start: int
    end: int


def _png(b: bytes, at: int) -> int:
    """End of the PNG that starts at `at`, by its chunks and their CRCs; 0 if it is none. So do the others."""
    i, seen = at + 8, False
    while i + 12 <= len(b):
        n = int.from_bytes(b[i : i + 4], "big")
        if i + 12 + n > len(b) or zlib.crc32(b[i + 4 : i + 8 + n]) != int.from_bytes(b[i + 8 + n : i + 12 + n], "big"):
            return 0
        kind = b[i + 4 : i + 8]
        if not seen and (kind != b"IHDR" or n != 13):
            return 0
        seen, i = True, i + 12 + n
        if kind == b"IEND":
            return i
    return 0


def _walk(memo: dict[int, int], i: int, step: Callable[[int], tuple[int, int]]) -> int:
    """Where the chain of blocks from i on ends. step(i) is (the next block, 0), or (-1, the end; 0 if there is none).

    Chains that meet go on alike: memo has the end from each block that was
    walked before, so that all chains of a text together cost one walk.
    """
    path = []
    while i not in memo:
        path.append(i)
        i, end = step(i)
        if i < 0:
            memo[path[-1]] = end
            break
    end = memo[path[-1] if i < 0 else i]
    for x in path:
        memo[x] = end
    return end


def _gif(b: bytes, at: int) -> int:
    if at + 13 > len(b):
        return 0
    flags = b[at + 10]
    data, blocks = _memo(b, "gif data"), _memo(b, "gif")

    def piece(i: int) -> tuple[int, int]:
        """Of the data behind a block: lengths and bytes up to a length of 0."""
        return (-1, 0) if i >= len(b) else (-1, i + 1) if not b[i] else (i + b[i] + 1, 0)

    def block(i: int) -> tuple[int, int]:
        if i >= len(b):
            return -1, 0
        if b[i] == 0x3B:
            return -1, i + 1
        if b[i] == 0x21:
            after = _walk(data, i + 2, piece)
        elif b[i] == 0x2C and i + 10 < len(b):
            local = b[i + 9]
            after = _walk(data, i + 11 + (3 << (local & 7) + 1 if local & 0x80 else 0), piece)
        else:
            after = 0
        return (after, 0) if after else (-1, 0)

    return _walk(blocks, at + 13 + (3 << (flags & 7) + 1 if flags & 0x80 else 0), block)


def _jpeg(b: bytes, at: int) -> int:
    """Blocks are named by place and, in the lowest bit, whether a frame header has been seen."""
    real = _markers(b)

    def block(x: int) -> tuple[int, int]:
        i, framed = x >> 1, x & 1
        if i + 2 > len(b) or b[i] != 0xFF:
            return -1, 0
        mark = b[i + 1]
        if mark == 0xD9:
            return -1, i + 2 if framed else 0
        if mark == 0xFF or 0xD0 <= mark <= 0xD7 or mark == 0x01:
            return i + (1 if mark == 0xFF else 2) << 1 | framed, 0
        n = int.from_bytes(b[i + 2 : i + 4], "big")
        if i + 4 > len(b) or n < 2 or mark < 0xC0:
            return -1, 0
        framed |= 0xC0 <= mark <= 0xCF and mark not in (0xC4, 0xC8, 0xCC)
        i += 2 + n
        if mark == 0xDA:  # entropy-coded data up to the next real marker
            k = bisect_left(real, i)
            if k == len(real):
                return -1, 0
            i = real[k]
        return i << 1 | framed, 0

    return _walk(_memo(b, "jpeg"), at + 2 << 1, block)


def _riff(form: bytes, need: tuple[bytes, ...]) -> Callable[[bytes, int], int]:
    def end(b: bytes, at: int) -> int:
        if at + 12 > len(b) or b[at + 8 : at + 12] != form:
            return 0
        stop = at + 8 + int.from_bytes(b[at + 4 : at + 8], "little")
        if stop > len(b):
            return 0

        def block(x: int) -> tuple[int, int]:
            """Blocks are named by place and, in the lowest bit, whether one that is needed has been seen."""
            i, seen = x >> 1, x & 1
            if i + 8 > stop:
                return -1, stop if seen and i in (stop, stop + 1) else 0
            n = int.from_bytes(b[i + 4 : i + 8], "little")
            return i + 8 + n + (n & 1) << 1 | (seen or b[i : i + 4] in need), 0

        return _walk(_memo(b, (form, stop)), at + 12 << 1, block)

    return end


def _bmp(b: bytes, at: int) -> int:
    if at + 54 > len(b):
        return 0
    size, reserved, pixels, head = struct.unpack_from("<IIII", b, at + 2)
    return at + size if reserved == 0 and head in (12, 40, 52, 56, 108, 124) and 14 + head <= pixels <= size and at + size <= len(b) else 0


def _gzip(b: bytes, at: int) -> int:
    """Inflated in steps of bounded size: what comes out is thrown away, however much it is."""
    if at + 18 > len(b) or b[at + 2] != 8 or b[at + 3] & 0xE0:
        return 0
    d = zlib.decompressobj(31)
    try:
        for i in range(at, len(b), _STEP):
            rest = b[i : i + _STEP]
            while rest and not d.eof:
                d.decompress(rest, _STEP)
                rest = d.unconsumed_tail
            if d.eof:
                return min(i + _STEP, len(b)) - len(d.unused_data)
    except zlib.error:
        pass
    return 0


def _memo(b: bytes, name: object) -> dict:
    """What the validators know of the bytes at hand, by name; it goes when other bytes come."""
    if not _held or _held[0] is not b:
        _held[:] = [b, {}]
    return _held[1].setdefault(name, {})


def _markers(b: bytes) -> list[int]:
    """Where markers stand that end entropy-coded data: 0xFF, but not before 0 or a restart."""
    memo = _memo(b, "markers")
    if "all" not in memo:
        x = np.frombuffer(b, np.uint8)
        at = np.flatnonzero(x[:-1] == 0xFF)
        after = x[at + 1]
        memo["all"] = at[(after != 0) & ((after < 0xD0) | (after > 0xD7))].tolist()
    return memo["all"]


def _places(b: bytes, mark: bytes) -> list[int]:
    """Where mark stands in b."""
    memo = _memo(b, mark)
    if "all" not in memo:
        found, i = [], b.find(mark)
        while i >= 0:
            found.append(i)
            i = b.find(mark, i + 1)
        memo["all"] = found
    return memo["all"]


def _zip(b: bytes, at: int) -> int:
    """Up to the first end-of-directory record whose directory begins where its lengths say."""
    ends = _places(b, b"PK\x05\x06")
    begins = _memo(b, "zip")
    if not begins and ends:  # where the archive of each record begins, and the records of each beginning
        for i in ends:
            if i + 22 <= len(b):
                size, offset, note = struct.unpack_from("<IIH", b, i + 12)
                if i + 22 + note <= len(b):
                    begins.setdefault(i - size - offset, []).append(i + 22 + note)
        begins.setdefault(-1, [])
    return next((end for end in begins.get(at, []) if end > at), 0)


def _pdf(b: bytes, at: int) -> int:
    ends, starts = _places(b, b"%%EOF"), _places(b, b"startxref")
    i = bisect_left(ends, at)
    return ends[i] + 5 if i < len(ends) and bisect_left(starts, at) < bisect_left(starts, ends[i]) else 0


def _flac(b: bytes, at: int) -> int:
    """Metadata blocks are walked; the frames have no length, so it runs to the end of the bytes."""
    i, first = at + 4, True
    while i + 4 <= len(b):
        kind, n = b[i], int.from_bytes(b[i + 1 : i + 4], "big")
        if first and (kind & 0x7F or n != 34):
            return 0
        first, i = False, i + 4 + n
        if kind & 0x80:
            return len(b) if i + 2 <= len(b) and b[i] == 0xFF and b[i + 1] & 0xFC == 0xF8 else 0
    return 0


def _ogg(b: bytes, at: int) -> int:
    def page(i: int) -> tuple[int, int]:
        if b[i : i + 5] != b"OggS\0" or i + 27 > len(b):
            return -1, 0
        n = b[i + 26]
        after = i + 27 + n + sum(b[i + 27 : i + 27 + n])
        if after > len(b):
            return -1, 0
        return (-1, after) if b[i + 5] & 4 else (after, 0)

    return _walk(_memo(b, "ogg"), at, page)


#: Magic numbers as the formats define them, and what confirms each.
FORMATS: list[tuple[bytes, str, Callable[[bytes, int], int]]] = [
    (b"\x89PNG\r\n\x1a\n", "image/png", _png),
    (b"GIF87a", "image/gif", _gif),
    (b"GIF89a", "image/gif", _gif),
    (b"\xff\xd8\xff", "image/jpeg", _jpeg),
    (b"RIFF", "audio/wav", _riff(b"WAVE", (b"data",))),
    (b"RIFF", "image/webp", _riff(b"WEBP", (b"VP8 ", b"VP8L", b"VP8X"))),
    (b"BM", "image/bmp", _bmp),
    (b"\x1f\x8b", "application/gzip", _gzip),
    (b"PK\x03\x04", "application/zip", _zip),
    (b"%PDF-", "application/pdf", _pdf),
    (b"fLaC", "audio/flac", _flac),
    (b"OggS", "audio/ogg", _ogg),
]
_machine: list = []


def _automaton():
    if not _machine:
        a = ahocorasick.Automaton()
        for magic in {m for m, _, _ in FORMATS}:
            a.add_word(magic.decode("latin-1"), (len(magic), [(k, f) for m, k, f in FORMATS if m == magic]))
        a.make_automaton()
        _machine.append(a)
    return _machine[0]


def signatures(data: bytes) -> list[Found]:
    """Every confirmed object in data, those inside others too, by start."""
    out = []
    for last, (n, checks) in _automaton().iter(data.decode("latin-1")):
        at = last - n + 1
        out += [Found(kind, at, end) for kind, check in checks if (end := check(data, at))]
    _held.clear()
    return sorted(out, key=lambda f: (f.start, -f.end))


def carve(data: bytes, found: list[Found] | None = None) -> list[Found]:
    """The confirmed objects in data (found: its signatures, if they are at hand) that no earlier one covers."""
    out, end = [], 0
    for f in signatures(data) if found is None else found:
        if f.start >= end:
            out.append(f)
            end = f.end
    return out


def sniff(data: bytes | None) -> str | None:
    """The type of data as a whole: that of an object from its first byte on; else octet-stream."""
    if data is None:
        return None
    return next((f.kind for f in signatures(data) if f.start == 0), "application/octet-stream")


def pad(data: bytes) -> bytes:
    return data + bytes(-len(data) % BLOCK or (0 if data else BLOCK))


def store(payload: bytes) -> bytes:
    """payload (of even length) as the samples of an 8-bit mono PCM file."""
    return struct.pack("<4sI4s4sIHHIIHH4sI", b"RIFF", 36 + len(payload), b"WAVE", b"fmt ", 16, 1, 1, RATE, RATE, 1, 8, b"data", len(payload)) + payload


class Stored(NamedTuple):
    channels: int
    rate: int
    bits: int
    samples: bytes
    inside: list[Found]


def load(stored: bytes, found: list[Found] | None = None) -> Stored:
    """Format and samples of a stored file, and the objects carved out of the samples; ValueError if its structure does not hold."""
    found = signatures(stored) if found is None else found
    if not found or found[0] != Found("audio/wav", 0, len(stored)):
        raise ValueError("not a stored file")
    i, form = 12, None
    while i + 8 <= len(stored) and stored[i : i + 4] != b"data":
        n = int.from_bytes(stored[i + 4 : i + 8], "little")
        if stored[i : i + 4] == b"fmt " and n >= 16:
            form = struct.unpack_from("<HHIIHH", stored, i + 8)
        i += 8 + n + (n & 1)
    if form is None or form[0] != 1 or i + 8 > len(stored):
        raise ValueError("no PCM format before the samples")
    n = int.from_bytes(stored[i + 4 : i + 8], "little")
    inside, end = [], 0
    for f in found[1:]:
        if f.start >= i + 8 + end and f.end <= i + 8 + n:
            inside.append(Found(f.kind, f.start - i - 8, f.end - i - 8))
            end = inside[-1].end
    return Stored(form[1], form[2], form[5], stored[i + 8 : i + 8 + n], inside)


_MEDIA = "media binary, declared string, n_bytes bigint"


def _slices(batch: pa.RecordBatch, column: str) -> Iterator[pa.RecordBatch]:
    """A few megabytes of the column's bytes, or one row, at a time."""
    sizes = np.cumsum(np.array([x.as_buffer().size if x.is_valid else 0 for x in batch.column(column)], np.int64))
    lo = 0
    while lo < len(batch):
        hi = max(lo + 1, int(np.searchsorted(sizes, (sizes[lo - 1] if lo else 0) + tk.CHUNK_BYTES, side="right")))
        yield batch.slice(lo, hi - lo)
        lo = hi


def store_texts(docs: DataFrame) -> DataFrame:
    """doc_id, media, declared (what a table of texts claims its column to hold), n_bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _slices(batch, "text"):
                raw = [x.as_buffer().to_pybytes() if x.is_valid else b"" for x in part.column("text")]
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array([store(pad(x)) for x in raw], pa.binary()), pa.array(["text/plain"] * len(raw)), pa.array([len(x) for x in raw], pa.int64())],
                    names=["doc_id", "media", "declared", "n_bytes"],
                )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(tk.released(run), f"doc_id bigint, {_MEDIA}")


_KINDS = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))


_TYPES = "media_type string, corrected boolean, carved array<struct<kind:string,start:bigint,end:bigint>>"
_SOUND = "channels int, rate int, bits int, payload binary, peak int, crossings bigint"


def _types(data: bytes | None, declared: str | None, found: list[Found], file: Stored | None) -> tuple:
    whole = next((f for f in found if f.start == 0), None)
    kind = None if data is None else whole.kind if whole else "application/octet-stream"
    inner = file.inside if file else [f for f in carve(data or b"", found) if f.start]
    return kind, kind is not None and kind != declared, [f._asdict() for f in inner]


def _sound(file: Stored | None) -> tuple:
    if file is None:
        return (None,) * 6
    wave = np.frombuffer(file.samples, np.uint8).astype(np.int16) - 128
    above = wave >= 0
    return file.channels, file.rate, file.bits, file.samples, int(np.abs(wave).max()) if len(wave) else 0, int((above[1:] != above[:-1]).sum())


def inspect(df: DataFrame, media: str = "media", declared: str | None = "declared", types: bool = True, sound: bool = True) -> DataFrame:
    """df with what correct_types() and read_back() add, from one scan of each file. Names that df has already are kept for its own columns; the added ones get underscores before them."""
    fields = T._parse_datatype_string(", ".join([_TYPES] * types + [_SOUND] * sound)).fields
    names = tk.fresh(df, *(f.name for f in fields))
    kinds = [pa.string(), pa.bool_(), _KINDS] * types + [pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.int32(), pa.int64()] * sound

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _slices(batch, media):
                rows = []
                said = part.column(declared).to_pylist() if types else [None] * len(part)
                for data, claim in zip(part.column(media).to_pylist(), said, strict=True):
                    found = signatures(data) if data is not None else []
                    try:
                        file = load(data or b"", found)
                    except ValueError:  # another kind of file
                        file = None
                    rows.append((_types(data, claim, found, file) if types else ()) + (_sound(file) if sound else ()))
                made = [pa.array(c, k) for c, k in zip(zip(*rows, strict=True) if rows else [[]] * len(kinds), kinds, strict=True)]
                yield pa.RecordBatch.from_arrays([*part.columns, *made], names=[*part.schema.names, *names])

    return df.mapInArrow(tk.released(over), T.StructType([*df.schema.fields, *(T.StructField(n, f.dataType) for n, f in zip(names, fields, strict=True))]))


def correct_types(df: DataFrame, media: str = "media", declared: str = "declared") -> DataFrame:
    """df with media_type (sniffed), corrected (it differs from the declared one) and carved: the objects in the bytes after the first; in a stored file's samples if it is one."""
    return inspect(df, media, declared, sound=False)


def read_back(df: DataFrame, media: str = "media") -> DataFrame:
    """df with channels, rate, bits and payload (the samples) of the stored files in column media, peak (the sample farthest from silence) and crossings (of silence); null where it is none."""
    return inspect(df, media, None, types=False)


def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digest of each text stored as media and read back; feature: sniffed type, format, shape of the sound, and the objects inside."""
    found = inspect(store_texts(tk.table(spark, sf_dir, "documents")))
    objects = F.array_join(F.transform("carved", lambda f: F.concat(F.lit(";"), f["kind"], F.lit("@"), f["start"].cast("string"), F.lit("+"), (f["end"] - f["start"]).cast("string"))), "")
    pair = lambda name, c: F.concat(F.lit(f";{name}="), c.cast("string"))
    feature = F.concat("media_type", pair("channels", F.col("channels")), pair("rate", F.col("rate")), pair("bits", F.col("bits")), pair("peak", F.col("peak")), pair("crossings", F.col("crossings")), objects)
    return found.select(
        "doc_id", "n_bytes", F.octet_length("payload").cast("long").alias("payload_bytes"), F.sha2("payload", 256).alias("payload_sha256"), F.crc32(F.substring("payload", -BLOCK, BLOCK)).alias("tail_crc32"),
        F.octet_length("media").cast("long").alias("media_bytes"), F.sha2("media", 256).alias("media_sha256"), feature.alias("feature"),
    )
