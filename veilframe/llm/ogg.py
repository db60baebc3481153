"""Ogg media columns: write payloads as pages, and read them back with checksums, lacing, streams and granule positions.

The container is the public Ogg framing (RFC 3533). A document becomes two multiplexed logical streams: one whose
packets are 8-bit samples, and one with a note on the text. Page checksums use the polynomial 0x04C11DB7 unreflected,
which zlib's reflected CRC gives on bit-reversed bytes.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame

from .shared import binaries, by_bytes, kept, own_names, text_of

#: Fixed values of the format: capture pattern, page header up to the lacing values, header flags, segments in a page.
CAPTURE, HEADER = b"OggS", struct.Struct("<4sBBqIIIB")
CONTINUED, FIRST, LAST, SEGMENTS = 1, 2, 4, 255
#: Identification packets of the two streams: samples (rate, number) and note (bytes of the text).
SAMPLES, NOTE = struct.Struct("<8sIQ"), struct.Struct("<8sQ")
SAMPLES_MAGIC, NOTE_MAGIC = b"VFPCM8\0\0", b"VFNOTE\0\0"
RATE, PACKET, BLOCK = 8000, 4096, 64

_REVERSED = bytes(int(f"{i:08b}"[::-1], 2) for i in range(256))


def page_crc(page: bytes) -> int:
    """The page's checksum, its checksum field being zero."""
    raw = zlib.crc32(page.translate(_REVERSED), 0xFFFFFFFF) ^ 0xFFFFFFFF
    return int(f"{raw:032b}"[::-1], 2)


def padded(text: bytes) -> bytes:
    """The text with zero bytes up to a positive multiple of BLOCK."""
    return text + bytes(-len(text) % BLOCK or (0 if text else BLOCK))


def stream_pages(serial: int, packets: list[tuple[bytes, int]]) -> list[bytes]:
    """Pages of one logical stream; packets with the granule position at their end. Each starts on the first page alone."""
    pages: list[bytes] = []

    def close(lacing: bytearray, body: list[bytes], granule: int, continued: bool, last: bool) -> None:
        flags = CONTINUED * continued | FIRST * (not pages) | LAST * last
        parts = [HEADER.pack(CAPTURE, 0, flags, granule, serial, len(pages), 0, len(lacing)), bytes(lacing), *body]
        page = b"".join(parts)
        pages.append(page[:22] + page_crc(page).to_bytes(4, "little") + page[26:])

    lacing, body, granule, continued = bytearray(), [], -1, False
    for at, (packet, end) in enumerate(packets):
        done = 0
        values = len(packet) // 255 + 1
        while values:
            if len(lacing) == SEGMENTS:
                close(lacing, body, granule, continued, False)
                lacing, body, granule, continued = bytearray(), [], -1, done > 0
            now = min(values, SEGMENTS - len(lacing))
            size = min(len(packet) - done, now * 255)
            lacing += b"\xff" * (size // 255) + (bytes([size % 255]) if now == values else b"")
            body.append(packet[done : done + size])
            done, values = done + size, values - now
        granule = end
        if at == 0 or at == len(packets) - 1:
            close(lacing, body, granule, continued, at == len(packets) - 1)
            lacing, body, granule, continued = bytearray(), [], -1, False
    return pages


def write_ogg(text: bytes) -> bytes:
    """The stored form of a text; equal texts give equal bytes."""
    payload = padded(text)
    serial = zlib.crc32(payload)
    cuts = range(0, len(payload), PACKET)
    samples = [(SAMPLES.pack(SAMPLES_MAGIC, RATE, len(payload)), 0), *((payload[i : i + PACKET], min(i + PACKET, len(payload))) for i in cuts)]
    note = [(NOTE.pack(NOTE_MAGIC, len(text)), 0), (f"bytes={len(text)};sha256={hashlib.sha256(text).hexdigest()}".encode(), len(payload))]
    a, b = stream_pages(serial, samples), stream_pages(serial ^ 0xFFFFFFFF, note)
    return b"".join([a[0], b[0], *a[1:2], *b[1:], *a[2:]])  # first pages together, as the framing asks


@dataclass
class Stream:
    serial: int
    packets: list[bytes] = field(default_factory=list)
    ends: list[int] = field(default_factory=list)  # granule positions of pages on which a packet ends
    parts: list[bytes] = field(default_factory=list)
    pages: int = 0
    next_page: int = 0
    lost: int = 0
    ended: bool = False


def read_ogg(data: bytes) -> tuple[dict[int, Stream], int]:
    """Logical streams by serial number, and how many pages were damaged.

    A page whose checksum is wrong is left out, and reading goes on at the next capture pattern; a packet that lost a
    part is left out too and counted in its stream's `lost`.
    """
    streams: dict[int, Stream] = {}
    at, bad = 0, 0
    while (at := data.find(CAPTURE, at)) >= 0:
        if len(data) < at + HEADER.size:
            bad += 1
            break
        _, version, flags, granule, serial, number, crc, n = HEADER.unpack_from(data, at)
        lacing = data[at + HEADER.size : at + HEADER.size + n]
        start = at + HEADER.size + n
        end = start + sum(lacing)
        if version or len(lacing) < n or end > len(data) or page_crc(data[at : at + 22] + bytes(4) + data[at + 26 : end]) != crc:
            bad, at = bad + 1, at + len(CAPTURE)
            continue
        s = streams.setdefault(serial, Stream(serial))
        gap = number != s.next_page
        s.next_page, s.pages, s.ended = number + 1, s.pages + 1, bool(flags & LAST)
        whole = bool(flags & CONTINUED) == bool(s.parts) and not gap  # what goes on here is what was begun
        if not whole:
            s.lost += bool(s.parts)
            s.parts = []
        skip = bool(flags & CONTINUED) and not whole
        place = run = start
        done = 0
        for value in lacing:
            place += value
            if value < 255:
                if skip:
                    s.lost, skip = s.lost + 1, False
                else:
                    s.parts.append(data[run:place])
                    s.packets.append(b"".join(s.parts))
                s.parts, run, done = [], place, done + 1
        if run < place or lacing and lacing[-1] == 255:
            if not skip:
                s.parts.append(data[run:place])
        if done and granule >= 0:
            s.ends.append(granule)
        at = end
    return streams, bad


@dataclass
class Media:
    n_bytes: int | None
    payload: bytes | None
    streams: int
    pages: int
    packets: int
    bad_pages: int
    times: list[float]


def open_media(data: bytes) -> Media:
    """Demultiplex a stored form; payload is None where pages or packets of it are damaged."""
    streams, bad = read_ogg(data)
    n_bytes, payload, times = None, None, []
    for s in streams.values():
        head = s.packets[0] if s.packets else b""
        if head[:8] == SAMPLES_MAGIC and len(head) == SAMPLES.size:
            _, rate, n = SAMPLES.unpack(head)
            body = b"".join(s.packets[1:])
            payload = body if len(body) == n and not s.lost and s.ended else None
            times = [g / rate for g in s.ends if g > 0]
        elif head[:8] == NOTE_MAGIC and len(head) == NOTE.size:
            n_bytes = NOTE.unpack(head)[1]
    return Media(n_bytes, payload, len(streams), sum(s.pages for s in streams.values()), sum(len(s.packets) for s in streams.values()), bad, times)


#: Bytes of texts, or of stored forms, that a task turns into the other at a time (a longer one alone).
STEP_BYTES = 8 << 20


@own_names
def write_media(docs: DataFrame) -> DataFrame:
    """doc_id and media, the whole text (null: empty) as an Ogg file; one row per document, no shuffle.

    Rows with a null or repeated doc_id are documents like any other, other columns are ignored, and an empty table
    gives an empty result.
    """
    rows = docs.select("doc_id", text_of().cast("binary").alias("body"))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in by_bytes(batch, 1, STEP_BYTES):
                yield pa.record_batch([part.column(0), binaries([write_ogg(x) for x in part.column(1).to_pylist()])], ["doc_id", "media"])

    return rows.mapInArrow(encode, f"doc_id {rows.schema[0].dataType.simpleString()}, media binary")


def read_media(media: DataFrame) -> DataFrame:
    """One row per stored form: doc_id, n_bytes, payload, media_bytes, media_sha256, streams, pages, packets, bad_pages, times.

    times are the seconds at which the sample stream's pages end, from their granule positions. payload is null where
    it can't be read back whole (as from a null or damaged media); the counts then say what was found.
    """
    rows = media.select("doc_id", "media")
    types = [("n_bytes", pa.int64()), ("payload", pa.binary()), ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("streams", pa.int64()), ("pages", pa.int64()), ("packets", pa.int64()), ("bad_pages", pa.int64()), ("times", pa.list_(pa.float64()))]

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in by_bytes(batch, 1, STEP_BYTES):
                out = []
                for data in part.column(1).to_pylist():
                    m = open_media(data or b"")
                    out.append((m.n_bytes, m.payload, len(data or b""), hashlib.sha256(data or b"").hexdigest(), m.streams, m.pages, m.packets, m.bad_pages, m.times))
                yield pa.record_batch([part.column(0), *(pa.array([x[i] for x in out], t) for i, (_, t) in enumerate(types))], ["doc_id", *(n for n, _ in types)])

    kinds = "n_bytes long, payload binary, media_bytes long, media_sha256 string, streams long, pages long, packets long, bad_pages long, times array<double>"
    return rows.mapInArrow(decode, f"doc_id {rows.schema[0].dataType.simpleString()}, {kinds}")


@own_names
def stored_media(docs: DataFrame) -> DataFrame:
    """Store documents as Ogg in the shared folder and read the stored bytes back (see write_media and read_media).

    Rows with a null or repeated doc_id are documents like any other; other columns are ignored; an empty table gives
    an empty result.
    """
    return read_media(kept(write_media(docs)))
