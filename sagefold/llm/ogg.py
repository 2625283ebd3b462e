"""Ogg as a media column: multiplex, verify, reassemble, demultiplex, time.

A document's bytes become two logical streams of one physical Ogg stream:

* ``PCM``: unsigned 8-bit samples, packets of 576 samples.  A header packet
  names the format, later packets are the payload.  The granule position counts
  the samples that are complete on a page.
* ``NOTE``: one packet with the length before padding.

Reading back verifies each page's checksum, puts packets together from lacing
values (also across pages), separates the streams by their serial numbers and
turns granule positions into times.

Null and empty texts are zero bytes, padded to one packet.  Serial numbers come
from the content, so that equal texts have equal media.  Media that are no Ogg
stream give ``ok`` false and null payloads.
"""

from __future__ import annotations

import struct
import zlib
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import map_columns

PACKET = 576
PAD = 0xFF
RATE = 48_000
CAPTURE = b"OggS"
CONTINUED, FIRST, LAST = 1, 2, 4
HEADER = struct.Struct("<4sBBqIIIB")
#: Identification of the sample stream: name, version, format 1 (unsigned 8-bit),
#: rate, bits, channels, frames in a packet, further header packets.
PCM = struct.Struct(">8sHHIIBBHI")
NOTE = struct.Struct("<8sQ")

_MIRROR = bytes(int(f"{x:08b}"[::-1], 2) for x in range(256))


def checksum(page: bytes) -> int:
    """The page checksum: polynomial 04c11db7, most significant bit first, start and end 0.

    zlib has the same polynomial with mirrored bits, start and end inverted: so
    mirror the bytes, cancel both inversions and mirror the result.
    """
    value = zlib.crc32(page.translate(_MIRROR), 0xFFFFFFFF) ^ 0xFFFFFFFF
    return int.from_bytes(value.to_bytes(4, "little").translate(_MIRROR), "big")


def lacing(length: int) -> bytes:
    """A packet's segment lengths: 255 each, then a shorter one, 0 if need be."""
    return b"\xff" * (length // 255) + bytes([length % 255])


def page(serial: int, number: int, flags: int, granule: int, laces: bytes, body: bytes) -> bytes:
    head = HEADER.pack(CAPTURE, 0, flags, granule, serial, number, 0, len(laces)) + laces
    return head[:22] + struct.pack("<I", checksum(head + body)) + head[26:] + body


def paginate(serial: int, packets: list[bytes], granules: list[int]) -> list[bytes]:
    """The pages of a logical stream; the first packet has a page of its own, as the format asks."""
    pages: list[bytes] = []
    laces, parts, size, granule, flags = bytearray(), [], 0, -1, FIRST

    def flush(last: bool, next_flags: int) -> None:
        nonlocal laces, parts, size, granule, flags
        pages.append(page(serial, len(pages), flags | LAST * last, granule, bytes(laces), b"".join(parts)))
        laces, parts, size, granule, flags = bytearray(), [], 0, -1, next_flags

    for k, (packet, at) in enumerate(zip(packets, granules, strict=True)):
        rest, segments = packet, lacing(len(packet))
        while segments:
            free = 255 - len(laces)
            now, segments = segments[:free], segments[free:]
            n = sum(now)
            laces += now
            parts.append(rest[:n])
            rest = rest[n:]
            if segments:
                flush(False, CONTINUED)
        granule = at
        if k + 1 == len(packets):
            flush(True, 0)
        elif k == 0 or len(laces) == 255:
            flush(False, 0)
    return pages


def pad(data: bytes) -> bytes:
    """``data`` with bytes 255 up to a positive multiple of 576."""
    return data + bytes([PAD]) * (max(1, -(-len(data) // PACKET)) * PACKET - len(data))


def mux(data: bytes) -> bytes:
    """The physical stream of a document's bytes."""
    payload = pad(data)
    serial = zlib.crc32(payload)
    head = PCM.pack(b"PCM     ", 0, 0, 1, RATE, 8, 1, PACKET, 0)
    packets = [head, *(payload[i : i + PACKET] for i in range(0, len(payload), PACKET))]
    sound = paginate(serial, packets, [0, *range(PACKET, len(payload) + 1, PACKET)])
    note = paginate(serial ^ 0xFFFFFFFF, [NOTE.pack(b"NOTE    ", len(data))], [0])
    return b"".join([sound[0], *note, *sound[1:]])  # first pages of all streams come first


@dataclass
class Stream:
    packets: list[bytes] = field(default_factory=list)
    open: list[bytes] = field(default_factory=list)
    granule: int = -1
    pages: int = 0
    ended: bool = False


def demux(media: bytes) -> dict[int, Stream]:
    """The logical streams by serial number; ValueError where the format is broken."""
    streams: dict[int, Stream] = {}
    at = 0
    while at < len(media):
        if len(media) - at < HEADER.size:
            raise ValueError("a page is cut off")
        capture, version, flags, granule, serial, number, crc, n = HEADER.unpack_from(media, at)
        body = at + HEADER.size + n
        laces = media[at + HEADER.size : body]
        end = body + sum(laces)
        if capture != CAPTURE or version or len(laces) < n or end > len(media):
            raise ValueError("no page here")
        if checksum(media[at : at + 22] + bytes(4) + media[at + 26 : end]) != crc:
            raise ValueError("a page's checksum is wrong")
        if flags & FIRST:
            if serial in streams:
                raise ValueError("two first pages")
            streams[serial] = Stream()
        if serial not in streams or (s := streams[serial]).pages != number or s.ended or bool(flags & CONTINUED) != bool(s.open):
            raise ValueError("a page is missing")
        s.pages += 1
        for lace in laces:
            s.open.append(media[body : body + lace])
            body += lace
            if lace < 255:
                s.packets.append(b"".join(s.open))
                s.open = []
        if granule >= 0:
            s.granule = granule
        s.ended = bool(flags & LAST)
        at = end
    if any(s.open or not s.ended for s in streams.values()):
        raise ValueError("a stream is cut off")
    return streams


def read_back(media: bytes | None) -> tuple:
    """(ok, payload, bytes before padding, pages, packets, duration in microseconds, mean, deviation)."""
    try:
        streams = demux(media or b"")
        sound = next(s for s in streams.values() if s.packets and s.packets[0].startswith(b"PCM     "))
        note = next(s for s in streams.values() if s.packets and s.packets[0].startswith(b"NOTE    "))
        rate = PCM.unpack(sound.packets[0])[4]
        payload = b"".join(sound.packets[1:])
        length = NOTE.unpack(note.packets[0])[1]
        if sound.granule != len(payload):
            raise ValueError("the granule position does not count the samples")
    except (ValueError, StopIteration, struct.error, ZeroDivisionError):
        return False, None, None, None, None, None, None, None
    counts = np.bincount(np.frombuffer(payload, "u1"), minlength=256)
    values, total = np.arange(256), int(counts.sum())
    mean = int((counts * values).sum()) / total
    deviation = (int((counts * values * values).sum()) / total - mean * mean) ** 0.5
    return True, payload, length, sum(s.pages for s in streams.values()), len(sound.packets) - 1, sound.granule * 1_000_000 // rate, mean, deviation


def mux_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, media binary): every text's UTF-8 bytes as an Ogg stream."""

    def make():
        return lambda column: [pa.array([mux(x or b"") for x in column.cast(pa.binary()).to_pylist()], pa.binary())]

    return map_columns(docs, [id_col], [text_col], T.StructType([T.StructField("media", T.BinaryType())]), make)


def demux_media(media: DataFrame, keep: list[str], media_col: str = "media") -> DataFrame:
    """The columns ``keep`` with what the streams hold: see ``read_back``."""
    add = T.StructType(
        [
            T.StructField("ok", T.BooleanType()),
            T.StructField("payload", T.BinaryType()),
            T.StructField("n_bytes", T.LongType()),
            T.StructField("pages", T.LongType()),
            T.StructField("packets", T.LongType()),
            T.StructField("duration_us", T.LongType()),
            T.StructField("mean", T.DoubleType()),
            T.StructField("deviation", T.DoubleType()),
        ]
    )

    def make():
        return lambda column: list(zip(*map(read_back, column.to_pylist()), strict=True)) or [[] for _ in add.fields]

    return map_columns(media, keep, [media_col], add, make)
