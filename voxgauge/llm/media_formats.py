"""Media bytes: small writers for lossless 8-bit samples, and a sniffer that trusts structure rather than names.

One Aho-Corasick automaton finds the magic bytes of all formats in one pass. A candidate counts only if its format's
validator confirms the structure, and the validator says how long the item is. The item at the very beginning is the file
itself; confirmed items inside it are embedded media that can be carved out.
"""

from __future__ import annotations

import re
import struct
import zlib
from collections.abc import Callable
from functools import lru_cache
from typing import NamedTuple

import ahocorasick

WIDTH = 192  # samples of an image row

# Magic bytes, where in the item they stand, and the media type.
MAGIC = (
    (b"\x89PNG\r\n\x1a\n", 0, "image/png"),
    (b"\xff\xd8\xff", 0, "image/jpeg"),
    (b"GIF87a", 0, "image/gif"),
    (b"GIF89a", 0, "image/gif"),
    (b"BM", 0, "image/bmp"),
    (b"P5", 0, "image/x-portable-graymap"),
    (b"P6", 0, "image/x-portable-pixmap"),
    (b"RIFF", 0, "riff"),
    (b".snd", 0, "audio/basic"),
    (b"OggS", 0, "audio/ogg"),
    (b"fLaC", 0, "audio/flac"),
    (b"%PDF-", 0, "application/pdf"),
    (b"PK\x03\x04", 0, "application/zip"),
    (b"\x1f\x8b\x08", 0, "application/gzip"),
    (b"ftyp", 4, "video/mp4"),
)
RIFF_FORMS = {b"WAVE": "audio/wav", b"AVI ": "video/x-msvideo", b"WEBP": "image/webp"}


class Item(NamedTuple):
    """A confirmed media item within some bytes."""

    media_type: str
    start: int
    length: int


# Validators take the bytes and the item's start; they return its type and length, or None.
Found = tuple[str, int] | None


def _png(data: bytes, at: int) -> Found:
    place, first = at + 8, True
    while place + 12 <= len(data):
        size, kind = struct.unpack_from(">I4s", data, place)
        end = place + 12 + size
        if end > len(data) or first != (kind == b"IHDR"):
            return None
        if zlib.crc32(data[place + 4:end - 4]) != struct.unpack_from(">I", data, end - 4)[0]:
            return None
        if kind == b"IEND":
            return "image/png", end - at
        place, first = end, False
    return None


def _jpeg(data: bytes, at: int) -> Found:
    place = at + 2
    while place + 4 <= len(data) and data[place] == 0xFF:
        marker, size = data[place + 1], int.from_bytes(data[place + 2:place + 4], "big")
        if marker in (0x00, 0xFF) or 0xD0 <= marker <= 0xD9 or size < 2:
            return None
        place += 2 + size
        if marker == 0xDA:
            end = data.find(b"\xff\xd9", place)
            return ("image/jpeg", end + 2 - at) if end >= 0 else None
    return None


def _gif(data: bytes, at: int) -> Found:
    if at + 13 > len(data):
        return None
    flags = data[at + 10]
    place = at + 13 + (3 << (flags & 7) + 1 if flags & 0x80 else 0)

    def skip_blocks(p: int) -> int:
        while p < len(data) and data[p]:
            p += data[p] + 1
        return p + 1

    while place < len(data):
        kind = data[place]
        if kind == 0x3B:
            return "image/gif", place + 1 - at
        if kind == 0x21:
            place = skip_blocks(place + 2)
        elif kind == 0x2C and place + 10 <= len(data):
            local = data[place + 9]
            place = skip_blocks(place + 11 + (3 << (local & 7) + 1 if local & 0x80 else 0))
        else:
            return None
    return None


def _bmp(data: bytes, at: int) -> Found:
    if at + 30 > len(data):
        return None
    size, _, first, header, _, _, planes, bits = struct.unpack_from("<IIIIiiHH", data, at + 2)
    good = header in (40, 52, 56, 108, 124) and planes == 1 and bits in (1, 4, 8, 16, 24, 32)
    return ("image/bmp", size) if good and 14 + header <= first <= size <= len(data) - at else None


_PNM = re.compile(rb"P([56])\s+(\d{1,9})\s+(\d{1,9})\s+(\d{1,5})\s")


def _pnm(data: bytes, at: int) -> Found:
    m = _PNM.match(data, at, at + 64)
    if not m or not 0 < int(m[4]) < 65536:
        return None
    samples = int(m[2]) * int(m[3]) * (3 if m[1] == b"6" else 1) * (2 if int(m[4]) > 255 else 1)
    kind = "image/x-portable-graymap" if m[1] == b"5" else "image/x-portable-pixmap"
    return (kind, m.end() - at + samples) if samples and m.end() + samples <= len(data) else None


def _chunks(data: bytes, start: int, end: int) -> dict[bytes, tuple[int, int]] | None:
    """Place and size of each RIFF chunk; null if they don't fill the space exactly."""
    found, place = {}, start
    while place + 8 <= end:
        kind, size = struct.unpack_from("<4sI", data, place)
        found.setdefault(kind, (place + 8, size))
        place += 8 + size + size % 2
    return found if place == end else None


def _riff(data: bytes, at: int) -> Found:
    if at + 12 > len(data):
        return None
    size, form = struct.unpack_from("<I4s", data, at + 4)
    end = at + 8 + size
    if form not in RIFF_FORMS or end > len(data):
        return None
    chunks = _chunks(data, at + 12, end)
    if not chunks or form == b"WAVE" and not {b"fmt ", b"data"} <= chunks.keys():
        return None
    return RIFF_FORMS[form], end - at


def _au(data: bytes, at: int) -> Found:
    if at + 24 > len(data):
        return None
    first, size, coding, _, channels = struct.unpack_from(">5I", data, at + 4)
    good = 24 <= first <= 4096 and 1 <= coding <= 27 and 1 <= channels <= 64
    return ("audio/basic", first + size) if good and first + size <= len(data) - at else None


def _ogg(data: bytes, at: int) -> Found:
    place = at
    while data[place:place + 5] == b"OggS\0" and place + 27 <= len(data):
        table = data[place + 27:place + 27 + data[place + 26]]
        place += 27 + data[place + 26] + sum(table)
        if place > len(data):
            return None
    return ("audio/ogg", place - at) if place > at else None


def _flac(data: bytes, at: int) -> Found:
    """Metadata blocks give the structure; frames have no total length and run to the end of the bytes."""
    place, first = at + 4, True
    while place + 4 <= len(data):
        kind, size = data[place] & 0x7F, int.from_bytes(data[place + 1:place + 4], "big")
        if first and (kind, size) != (0, 34) or kind == 127 or place + 4 + size > len(data):
            return None
        last, first = data[place] & 0x80, False
        place += 4 + size
        if last:
            return "audio/flac", len(data) - at
    return None


def _pdf(data: bytes, at: int) -> Found:
    end = data.find(b"%%EOF", at)
    good = re.match(rb"%PDF-\d\.\d", data[at:at + 8]) and end >= 0 and data.find(b"startxref", at, end) >= 0
    return ("application/pdf", end + 5 - at) if good else None


def _zip(data: bytes, at: int) -> Found:
    end = data.find(b"PK\x05\x06", at)
    if end < 0 or end + 22 > len(data):
        return None
    size, first, comment = struct.unpack_from("<IIH", data, end + 12)
    good = first + size == end - at and end + 22 + comment <= len(data) and (not size or data[at + first:at + first + 4] == b"PK\x01\x02")
    return ("application/zip", end + 22 + comment - at) if good else None


def _gzip(data: bytes, at: int) -> Found:
    machine, rest = zlib.decompressobj(31), data[at:]
    try:
        while rest and not machine.eof:
            machine.decompress(rest, 1 << 20)  # a little at a time: a bomb is read but never held
            rest = machine.unconsumed_tail or b""
    except zlib.error:
        return None
    return ("application/gzip", len(data) - at - len(machine.unused_data)) if machine.eof else None


def _mp4(data: bytes, at: int) -> Found:
    place, seen = at, set()
    while place + 8 <= len(data):
        size, kind = struct.unpack_from(">I4s", data, place)
        if size < 8 or place + size > len(data) or not kind.isalnum():
            break
        seen.add(kind)
        place += size
    return ("video/mp4", place - at) if {b"ftyp", b"moov"} <= seen else None


VALIDATORS: dict[str, Callable[[bytes, int], Found]] = {
    "image/png": _png, "image/jpeg": _jpeg, "image/gif": _gif, "image/bmp": _bmp, "image/x-portable-graymap": _pnm,
    "image/x-portable-pixmap": _pnm, "riff": _riff, "audio/basic": _au, "audio/ogg": _ogg, "audio/flac": _flac,
    "application/pdf": _pdf, "application/zip": _zip, "application/gzip": _gzip, "video/mp4": _mp4,
}


@lru_cache(maxsize=1)
def automaton() -> ahocorasick.Automaton:
    machine = ahocorasick.Automaton()
    for magic, place, kind in MAGIC:
        machine.add_word(magic.decode("latin-1"), (len(magic) + place, kind))
    machine.make_automaton()
    return machine


def sniff(data: bytes) -> list[Item]:
    """Confirmed items, outermost only apart from the file itself: the one at 0 first, then what is embedded in order."""
    items, covered = [], 0
    candidates = sorted({(end + 1 - back, kind) for end, (back, kind) in automaton().iter(data.decode("latin-1"))})
    for start, kind in candidates:
        if start < 0 or start < covered:
            continue
        if found := VALIDATORS[kind](data, start):
            items.append(Item(found[0], start, found[1]))
            if start:
                covered = start + found[1]
    return items


def carve(data: bytes) -> list[tuple[Item, bytes]]:
    """Embedded items with their bytes."""
    return [(i, data[i.start:i.start + i.length]) for i in sniff(data) if i.start]


def wav(samples: bytes) -> bytes:
    """Mono, 8 bits, 8,000 samples a second."""
    pad = b"\0" * (len(samples) % 2)
    return struct.pack("<4sI4s4sIHHIIHH4sI", b"RIFF", 36 + len(samples) + len(pad), b"WAVE", b"fmt ", 16, 1, 1, 8000, 8000,
                       1, 8, b"data", len(samples)) + samples + pad


def pgm(samples: bytes) -> bytes:
    return b"P5\n%d %d\n255\n" % (WIDTH, len(samples) // WIDTH) + samples


def bmp(samples: bytes) -> bytes:
    """Eight-bit greys, rows from the top."""
    greys = b"".join(bytes((g, g, g, 0)) for g in range(256))
    first = 54 + len(greys)
    return struct.pack("<2sIIIIiiHHIIiiII", b"BM", first + len(samples), 0, first, 40, WIDTH, -(len(samples) // WIDTH), 1, 8,
                       0, len(samples), 2835, 2835, 256, 0) + greys + samples


def png(samples: bytes) -> bytes:
    """Eight-bit greys, rows unfiltered."""

    def chunk(kind: bytes, body: bytes) -> bytes:
        return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))

    rows = b"".join(b"\0" + samples[i:i + WIDTH] for i in range(0, len(samples), WIDTH))
    head = struct.pack(">IIBBBBB", WIDTH, len(samples) // WIDTH, 8, 0, 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(rows, 1)) + chunk(b"IEND", b"")


WRITERS = (("audio/wav", wav), ("image/x-portable-graymap", pgm), ("image/bmp", bmp), ("image/png", png))


def samples_of(data: bytes, media_type: str) -> bytes:
    """The samples of a file that one of the writers made."""
    if media_type == "audio/wav":
        place, size = _chunks(data, 12, len(data))[b"data"]
        return data[place:place + size]
    if media_type == "image/x-portable-graymap":
        return data[_PNM.match(data).end():]
    if media_type == "image/bmp":
        return data[struct.unpack_from("<I", data, 10)[0]:]
    if media_type == "image/png":
        place, packed = 8, []
        while place < len(data):
            size, kind = struct.unpack_from(">I4s", data, place)
            if kind == b"IDAT":
                packed.append(data[place + 8:place + 8 + size])
            place += 12 + size
        rows = zlib.decompress(b"".join(packed))
        return b"".join(rows[i + 1:i + 1 + WIDTH] for i in range(0, len(rows), WIDTH + 1))
    raise ValueError(f"no samples in {media_type}")
