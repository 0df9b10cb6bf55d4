"""Media columns in Ogg: pages, packets, logical streams and time stamps.

A media value holds two logical streams that are multiplexed page by page: `pcm`, 8-bit unsigned samples of one channel,
and `index`, whose packets say where each packet of samples begins. Reading verifies every page's checksum and order,
joins packets from lacing values over page borders, deals pages to their streams by serial number and turns granule
positions into seconds by the rate in the stream's header.

Defined results: a null payload counts as empty and gives a media value with headers and no samples. Equal payloads give
equal media values. A damaged value raises OggError in `demultiplex`, and gives an error text and no packets in `packets`;
a null media value gives no rows there.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from ragspark.llm.shared import portions

MAGIC = b"OggS"
CONTINUED, FIRST, LAST = 1, 2, 4
#: A page on which no packet ends has this granule position.
NO_GRANULE = -1
PAGE = struct.Struct("<4sBBqIIIB")
PCM, INDEX = 0x50434D38, 0x49445831
#: Fixed header words of the two streams, of this module's own.
PCM_HEAD, INDEX_HEAD = b"pcm8\0\0\0\1", b"indx\0\0\0\1"
RATE = 8000
PACKET_SAMPLES = 65_536

_REVERSED = bytes(int(f"{b:08b}"[::-1], 2) for b in range(256))


class OggError(ValueError):
    """The bytes are no sound Ogg stream."""


def checksum(page: bytes) -> int:
    """CRC-32 with the polynomial 04C11DB7, most significant bit first, register 0 at the start, nothing inverted.

    zlib computes the same polynomial with bits mirrored and the register inverted at both ends."""
    mirrored = zlib.crc32(page.translate(_REVERSED), 0xFFFFFFFF) ^ 0xFFFFFFFF
    return int.from_bytes(bytes(_REVERSED[b] for b in mirrored.to_bytes(4, "little")), "big")


def page_bytes(flags: int, granule: int, serial: int, number: int, lacing: bytes, body: bytes) -> bytes:
    head = PAGE.pack(MAGIC, 0, flags, granule, serial, number, 0, len(lacing)) + lacing
    return head[:22] + struct.pack("<I", checksum(head + body)) + head[26:] + body


def lacing_of(size: int) -> bytes:
    """Lacing values of a packet: 255 for each full segment, then the rest, which may be 0."""
    return b"\xff" * (size // 255) + bytes([size % 255])


def stream_pages(serial: int, packets: list[tuple[bytes, int]]) -> list[tuple[int, bytes]]:
    """(end granule, page) of a logical stream with these (packet, granule position at its end).

    The first packet has a page of its own; later packets fill pages of up to 255 segments and run on where they are longer."""
    pages: list[tuple[int, bytes]] = []
    waiting: list[tuple[int, int, bytes, bytes]] = []  # flags, granule, lacing, body
    for k, group in enumerate((packets[:1], packets[1:])):
        lacing, body, ends, runs_on = bytearray(), bytearray(), NO_GRANULE, 0
        for packet, granule in group:
            rest, at, left = lacing_of(len(packet)), 0, 0
            while left < len(rest):
                some = rest[left : left + 255 - len(lacing)]
                size = sum(some)
                lacing += some
                body += packet[at : at + size]
                at, left = at + size, left + len(some)
                ends = granule if left == len(rest) else ends
                if len(lacing) == 255:
                    waiting.append((runs_on, ends, bytes(lacing), bytes(body)))
                    lacing, body, ends, runs_on = bytearray(), bytearray(), NO_GRANULE, CONTINUED * (left < len(rest))
        if lacing:
            waiting.append((runs_on, ends, bytes(lacing), bytes(body)))
    last, shown = len(waiting) - 1, 0
    for number, (flags, granule, lace, data) in enumerate(waiting):
        flags |= FIRST * (number == 0) | LAST * (number == last)
        shown = granule if granule != NO_GRANULE else shown
        pages.append((shown if number else -1, page_bytes(flags, granule, serial, number, lace, data)))
    return pages


def multiplex(payload: bytes, rate: int = RATE, packet_samples: int = PACKET_SAMPLES) -> bytes:
    """The media value of these samples. Pages stand in the order of their end times; the headers come first."""
    starts = range(0, len(payload), packet_samples)
    pcm = [(PCM_HEAD + struct.pack("<II", rate, len(payload)), 0)]
    pcm += [(payload[i : i + packet_samples], min(i + packet_samples, len(payload))) for i in starts]
    index = [(INDEX_HEAD + struct.pack("<II", rate, len(starts)), 0)]
    index += [(struct.pack("<QI", i, min(packet_samples, len(payload) - i)), min(i + packet_samples, len(payload))) for i in starts]
    pages = [(end, k, n, page) for k, (serial, packets) in enumerate(((PCM, pcm), (INDEX, index))) for n, (end, page) in enumerate(stream_pages(serial, packets))]
    return b"".join(page for *_, page in sorted(pages, key=lambda x: x[:3]))


@dataclass
class Stream:
    serial: int
    packets: list[bytes] = field(default_factory=list)
    #: Granule position at the end of each packet; None where its page tells only of a later packet.
    granules: list[int | None] = field(default_factory=list)
    pages: int = 0
    ended: bool = False
    part: bytearray | None = None

    def end_seconds(self, rate: int) -> list[float | None]:
        return [None if g is None else g / rate for g in self.granules]


def demultiplex(data: bytes) -> dict[int, Stream]:
    """The logical streams by serial number, with every page verified."""
    streams: dict[int, Stream] = {}
    at, view = 0, memoryview(data)
    while at < len(data):
        if len(data) - at < PAGE.size:
            raise OggError(f"a page is cut off at byte {at}")
        magic, version, flags, granule, serial, number, crc, n = PAGE.unpack_from(data, at)
        if magic != MAGIC or version:
            raise OggError(f"no page begins at byte {at}")
        lacing = bytes(view[at + PAGE.size : at + PAGE.size + n])
        begin = at + PAGE.size + n
        end = begin + sum(lacing)
        if len(lacing) < n or end > len(data):
            raise OggError(f"a page is cut off at byte {at}")
        if checksum(data[at : at + 22] + b"\0\0\0\0" + data[at + 26 : end]) != crc:
            raise OggError(f"the checksum of the page at byte {at} is wrong")
        if bool(flags & FIRST) == (serial in streams):
            raise OggError(f"stream {serial:08x} begins twice or not at all")
        stream = streams.setdefault(serial, Stream(serial))
        if number != stream.pages or stream.ended:
            raise OggError(f"page {number} of stream {serial:08x} is out of order")
        if bool(flags & CONTINUED) != (stream.part is not None):
            raise OggError(f"a packet of stream {serial:08x} is broken off")
        stream.pages += 1
        stream.ended = bool(flags & LAST)
        closed, at = 0, end
        for size in lacing:
            if stream.part is None:
                stream.part = bytearray()
            stream.part += view[begin : begin + size]
            begin += size
            if size < 255:
                stream.packets.append(bytes(stream.part))
                stream.granules.append(None)
                stream.part, closed = None, closed + 1
        if closed:
            stream.granules[-1] = granule
        elif granule != NO_GRANULE:
            raise OggError(f"a page of stream {serial:08x} without a packet's end has a granule position")
    for stream in streams.values():
        if stream.part is not None or not stream.ended:
            raise OggError(f"stream {stream.serial:08x} does not end")
    return streams


def samples(data: bytes) -> tuple[bytes, float]:
    """The samples and the end time of a media value, by its last granule position; the index stream must tell of the same packets."""
    streams = demultiplex(data)
    if set(streams) != {PCM, INDEX}:
        raise OggError("the logical streams are not pcm and index")
    (head, *body), (index_head, *index) = streams[PCM].packets, streams[INDEX].packets
    if not head.startswith(PCM_HEAD) or not index_head.startswith(INDEX_HEAD):
        raise OggError("a header packet is unknown")
    rate, total = struct.unpack("<II", head[8:])
    spans, at = [struct.unpack("<QI", x) for x in index], 0
    for (begin, size), packet in zip(spans, body, strict=True):
        if begin != at or size != len(packet):
            raise OggError("the index stream does not match the samples")
        at += size
    if at != total or (streams[PCM].granules[-1] or 0) != total:
        raise OggError("the samples do not match the header or the last granule position")
    return b"".join(body), streams[PCM].end_seconds(rate)[-1]


def features(pcm: bytes, seconds: float) -> str:
    """End time, loudness, sign changes and level histogram of samples that were read back."""
    levels = np.bincount(np.frombuffer(pcm, np.uint8), minlength=256)
    n, centred = len(pcm), np.arange(256) - 128.0
    power = float(levels @ centred**2) / n if n else 0.0
    above = np.frombuffer(pcm, np.uint8) >= 128
    turns = int(np.count_nonzero(above[1:] != above[:-1]))
    eighths = ",".join(str(x) for x in levels.reshape(8, 32).sum(axis=1))
    return f"seconds={seconds:.6f};rms={power**0.5:.6f};turns={turns};levels={eighths}"


def encode(df: DataFrame, payload: str = "payload", media: str = "media") -> DataFrame:
    """df with the media value of each payload (binary)."""
    kept = df.drop(media)
    schema = T.StructType([*kept.schema.fields, T.StructField(media, T.BinaryType(), False)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in portions(batch, payload, 16_000_000):
                values = part.column(part.schema.get_field_index(payload)).to_pylist()
                column = pa.array([multiplex(x or b"") for x in values], pa.binary())
                yield pa.RecordBatch.from_arrays([*part.columns, column], names=[*part.schema.names, media])

    return kept.mapInArrow(run, schema)


def read_back(df: DataFrame, media: str = "media", samples_as: str = "samples", features_as: str = "feature") -> DataFrame:
    """df with the samples (binary) and the features of each media value. A null or damaged value raises OggError."""
    kept = df.drop(samples_as, features_as)
    schema = T.StructType([*kept.schema.fields, T.StructField(samples_as, T.BinaryType(), False), T.StructField(features_as, T.StringType(), False)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in portions(batch, media, 16_000_000):
                values = [x or b"" for x in part.column(part.schema.get_field_index(media)).to_pylist()]
                read = [samples(x) for x in values]
                columns = [pa.array([pcm for pcm, _ in read], pa.binary()), pa.array([features(*x) for x in read], pa.string())]
                yield pa.RecordBatch.from_arrays([*part.columns, *columns], names=[*part.schema.names, samples_as, features_as])

    return kept.mapInArrow(run, schema)


def packets(df: DataFrame, key: str, media: str = "media", rate: int = RATE) -> DataFrame:
    """A row for each packet: key, serial, packet (from 0), n_bytes, end_seconds (null where the page tells of a later
    packet only) and error. A damaged value has one row with its error and nulls."""
    schema = T.StructType([
        df.schema[key], T.StructField("serial", T.LongType()), T.StructField("packet", T.IntegerType()),
        T.StructField("n_bytes", T.LongType()), T.StructField("end_seconds", T.DoubleType()), T.StructField("error", T.StringType()),
    ])

    def rows(value: object, data: bytes) -> Iterator[tuple]:
        try:
            for stream in demultiplex(data).values():
                for k, (packet, end) in enumerate(zip(stream.packets, stream.end_seconds(rate), strict=True)):
                    yield value, stream.serial, k, len(packet), end, None
        except OggError as e:
            yield value, None, None, None, None, str(e)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            table = [r for v, x in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) if x is not None for r in rows(v, x)]
            types = [batch.schema.field(0).type, pa.int64(), pa.int32(), pa.int64(), pa.float64(), pa.string()]
            columns = [pa.array(c, t) for c, t in zip(zip(*table, strict=True) if table else [[]] * 6, types, strict=True)]
            yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return df.select(key, media).mapInArrow(run, schema)
