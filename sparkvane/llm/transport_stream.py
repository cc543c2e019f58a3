"""Media columns: MPEG transport streams.

``mux`` stores a payload as private data in an MPEG-2 transport stream: program
tables (PAT, PMT), PES packets with presentation times, a clock reference and
the random-access flag at regular points.  ``demux`` parses such a stream from
its bytes alone: it follows the program tables, checks every continuity
counter, reassembles the elementary stream and lists times and access points.

Both run document by document inside one Arrow pass; there is no shuffle.
A null text is the empty text; the empty text is stored as 64 zero bytes.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import _runtime as rt

PACKET = 188
PMT_PID = 0x1000
DATA_PID = 0x0100
PRIVATE_STREAM = 0x06  # stream_type: PES packets with private data
STREAM_ID = 0xBD  # private_stream_1
TICKS = 3600  # of the 90 kHz clock for each access unit: 25 units a second
UNIT_BYTES = 16_384  # payload bytes of one access unit
ACCESS_EVERY = 8  # every so many units the stream can be entered
BLOCK = 64  # payloads are padded with zeros to a multiple of this


def _crc_table() -> list[int]:
    out = []
    for i in range(256):
        c = i << 24
        for _ in range(8):
            c = ((c << 1) ^ 0x04C11DB7 if c & 0x80000000 else c << 1) & 0xFFFFFFFF
        out.append(c)
    return out


_CRC = _crc_table()


def psi_crc(data: bytes) -> int:
    """CRC-32/MPEG-2, as program tables carry it; zero over a whole section."""
    c = 0xFFFFFFFF
    for x in data:
        c = ((c << 8) & 0xFFFFFFFF) ^ _CRC[(c >> 24) ^ x]
    return c


def _section(table: int, number: int, body: bytes) -> bytes:
    head = struct.pack(">BHHBBB", table, 0xB000 | (len(body) + 9), number, 0xC1, 0, 0)
    return head + body + struct.pack(">I", psi_crc(head + body))


def _table_packet(pid: int, section: bytes) -> bytes:
    return (struct.pack(">BHB", 0x47, 0x4000 | pid, 0x10) + b"\0" + section).ljust(PACKET, b"\xff")


_TABLES = _table_packet(0, _section(0, 1, struct.pack(">HH", 1, 0xE000 | PMT_PID))) + _table_packet(
    PMT_PID, _section(2, 1, struct.pack(">HHBHH", 0xE000 | DATA_PID, 0xF000, PRIVATE_STREAM, 0xE000 | DATA_PID, 0xF000))
)


def _stamp(pts: int) -> bytes:
    return bytes([0x21 | (pts >> 29) & 0x0E, (pts >> 22) & 0xFF, 0x01 | (pts >> 14) & 0xFE, (pts >> 7) & 0xFF, 0x01 | (pts << 1) & 0xFE])


def _clock(base: int) -> bytes:
    """A program clock reference: 33 bits of 90 kHz, six reserved bits, no extension."""
    return struct.pack(">IH", base >> 1, (base & 1) << 15 | 0x7E00)


def pad(raw: bytes) -> bytes:
    return raw.ljust(max(BLOCK, -(-len(raw) // BLOCK) * BLOCK), b"\0")


def mux(payload: bytes) -> bytes:
    """One program with one private stream that holds payload; a function of payload alone."""
    out, counter = [_TABLES], 0
    for unit, at in enumerate(range(0, max(1, len(payload)), UNIT_BYTES)):
        body = payload[at : at + UNIT_BYTES]
        pts = (unit + 1) * TICKS & (1 << 33) - 1
        pes = struct.pack(">IHBBB", 0x100 | STREAM_ID, len(body) + 8, 0x84, 0x80, 5) + _stamp(pts) + body
        # The first packet carries the adaptation field if the unit is an access point.
        extra = b"\x07\x50" + _clock(pts - TICKS) if unit % ACCESS_EVERY == 0 else b""
        room = PACKET - 4 - len(extra)
        first, rest = pes[:room], pes[room:]
        if len(first) < room:  # one short packet: stuff its adaptation field
            extra = _stuffed(extra, PACKET - 4 - len(first))
        out.append(struct.pack(">BHB", 0x47, 0x4000 | DATA_PID, (0x30 if extra else 0x10) | counter) + extra + first)
        counter = counter + 1 & 15
        n = len(rest) // (PACKET - 4)
        if n:
            block = np.empty((n, PACKET), np.uint8)
            block[:, 0], block[:, 1], block[:, 2] = 0x47, DATA_PID >> 8, DATA_PID & 0xFF
            block[:, 3] = 0x10 | (counter + np.arange(n)) & 15
            block[:, 4:] = np.frombuffer(rest, np.uint8, n * (PACKET - 4)).reshape(n, -1)
            out.append(block.tobytes())
            counter = counter + n & 15
        if tail := rest[n * (PACKET - 4) :]:
            out.append(struct.pack(">BHB", 0x47, DATA_PID, 0x30 | counter) + _stuffed(b"", PACKET - 4 - len(tail)) + tail)
            counter = counter + 1 & 15
    return b"".join(out)


def _stuffed(field_bytes: bytes, size: int) -> bytes:
    """An adaptation field of exactly size bytes, by stuffing bytes."""
    if size == 1:
        return b"\0"
    return (bytes([size - 1]) + (field_bytes[1:] or b"\0")).ljust(size, b"\xff")


@dataclass
class Parsed:
    """What a transport stream holds."""

    payload: bytes = b""
    packets: int = 0
    program: int = 0
    pmt_pid: int = 0
    stream_pid: int = 0
    stream_type: int = 0
    discontinuities: int = 0
    duplicates: int = 0
    pts: list[int] = field(default_factory=list)
    access_points: list[tuple[int, int]] = field(default_factory=list)  # (packet number, pts)

    def feature(self) -> str:
        return (
            f"program={self.program};pmt={self.pmt_pid};pid={self.stream_pid};type={self.stream_type};packets={self.packets}"
            f";units={len(self.pts)};pts={self.pts[0] if self.pts else -1}-{self.pts[-1] if self.pts else -1}"
            f";access={len(self.access_points)};gaps={self.discontinuities};repeats={self.duplicates}"
        )


def demux(stream: bytes) -> Parsed:
    """Parse a stream of whole 188-byte packets; raises ValueError if it is not one.

    The first program's first elementary stream is reassembled.  A repeated
    packet (same counter) is dropped and counted; a jump of the counter is
    counted as a discontinuity.
    """
    if not stream or len(stream) % PACKET:
        raise ValueError("not a whole number of transport packets")
    p = np.frombuffer(stream, np.uint8).reshape(-1, PACKET)
    if (p[:, 0] != 0x47).any():
        raise ValueError("lost synchronization")
    pid = (p[:, 1].astype(np.int32) & 0x1F) << 8 | p[:, 2]
    start, control, counter = (p[:, 1] & 0x40) > 0, p[:, 3] >> 4 & 3, p[:, 3] & 15
    out = Parsed(packets=len(p))

    def table(on: int, kind: int) -> bytes | None:
        for i in np.flatnonzero((pid == on) & start).tolist():
            at = 4 + (int(p[i, 4]) + 1 if control[i] & 2 else 0)
            at += int(p[i, at]) + 1
            raw = p[i, at:].tobytes()
            size = (struct.unpack_from(">H", raw, 1)[0] & 0xFFF) + 3
            if raw[0] == kind and size <= len(raw) and psi_crc(raw[:size]) == 0:
                return raw[8 : size - 4]
        return None

    pat = table(0, 0)
    if pat is None:
        raise ValueError("no program association table")
    for k in range(0, len(pat), 4):
        number, at = struct.unpack_from(">HH", pat, k)
        if number:
            out.program, out.pmt_pid = number, at & 0x1FFF
            break
    pmt = table(out.pmt_pid, 2)
    if pmt is None:
        raise ValueError("no program map table")
    k = 4 + (struct.unpack_from(">H", pmt, 2)[0] & 0xFFF)
    out.stream_type, out.stream_pid = pmt[k], struct.unpack_from(">H", pmt, k + 1)[0] & 0x1FFF

    rows = np.flatnonzero((pid == out.stream_pid) & (control & 1 > 0))
    if not len(rows):
        return out
    step = (counter[rows[1:]].astype(np.int16) - counter[rows[:-1]]) & 15
    repeat = np.concatenate([[False], (step == 0) & (p[rows[1:]] == p[rows[:-1]]).all(axis=1)])
    out.duplicates = int(repeat.sum())
    rows = rows[~repeat]
    step = (counter[rows[1:]].astype(np.int16) - counter[rows[:-1]]) & 15
    out.discontinuities = int((step != 1).sum())

    adapted = control[rows] & 2 > 0
    skip = np.where(adapted, p[rows, 4].astype(np.int32) + 1, 0) + 4
    if (skip > PACKET).any():
        raise ValueError("an adaptation field exceeds its packet")
    entry = adapted & (p[rows, 4] > 0) & (p[rows, 5] & 0x40 > 0)
    begins = np.flatnonzero(start[rows])
    bodies = []
    for a, b in zip(begins.tolist(), [*begins[1:].tolist(), len(rows)], strict=True):
        body = p[rows[a:b]]
        keep = np.arange(PACKET)[None, :] >= skip[a:b, None]
        pes = body[keep].tobytes()
        if pes[:3] != b"\0\0\1":
            raise ValueError("no start code where a PES packet begins")
        length, head = struct.unpack_from(">H", pes, 4)[0], pes[8]
        t = pes[9:14]
        pts = (t[0] >> 1 & 7) << 30 | t[1] << 22 | (t[2] >> 1) << 15 | t[3] << 7 | t[4] >> 1 if pes[7] & 0x80 else -1
        out.pts.append(pts)
        if entry[a]:
            out.access_points.append((int(rows[a]), pts))
        bodies.append(pes[9 + head : length + 6 if length else None])
    out.payload = b"".join(bodies)
    return out


STORED = "doc_id long, n_bytes long, media binary"
READ = (
    "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, "
    "feature string, pts array<long>, access_packets array<long>, access_pts array<long>, discontinuities long"
)


def _store(texts: list[str]) -> list[tuple[int, bytes]]:
    raws = [t.encode("utf-8", "surrogatepass") for t in texts]
    return [(len(r), mux(pad(r))) for r in raws]


def store(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A media column: each text as a transport stream (doc_id, n_bytes, media)."""
    rt.prepare(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in rt.small(batches):
            sizes, media = zip(*_store(rt.texts(b.column(1))), strict=True) if b.num_rows else ((), ())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sizes, pa.int64()), pa.array(media, pa.binary())], ["doc_id", "n_bytes", "media"])

    return docs.selectExpr(f"cast(`{id_col}` as long) doc_id", f"`{text_col}` text").mapInArrow(run, STORED)


def _digest(n: int, media: bytes) -> tuple:
    x = demux(media)
    return (
        n, len(x.payload), hashlib.sha256(x.payload).hexdigest(), zlib.crc32(x.payload[-BLOCK:]), len(media),
        hashlib.sha256(media).hexdigest(), x.feature(), x.pts, [a for a, _ in x.access_points], [t for _, t in x.access_points], x.discontinuities,
    )


def inspect(media: DataFrame) -> DataFrame:
    """Read a media column back: payload digests, times, access points, counters."""
    rt.prepare(media.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in rt.small(batches):
            yield _rows(b.column(0), (_digest(n, m) for n, m in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True)))

    return media.select("doc_id", "n_bytes", "media").mapInArrow(run, READ)


def _rows(ids: pa.Array, rows) -> pa.RecordBatch:
    names = [x.strip().split(" ")[0] for x in READ.split(",")]
    types = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), *[pa.list_(pa.int64())] * 3, pa.int64()]
    cols = list(zip(*rows, strict=True)) or [()] * len(types)
    return pa.RecordBatch.from_arrays([ids, *(pa.array(c, t) for c, t in zip(cols, types, strict=True))], names)


def round_trip(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``inspect(store(docs))`` in one Python pass: the stored bytes stay in the worker
    that made them instead of crossing to the JVM and back."""
    rt.prepare(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in rt.small(batches):
            yield _rows(b.column(0), (_digest(n, m) for n, m in _store(rt.texts(b.column(1)))))

    return docs.selectExpr(f"cast(`{id_col}` as long) doc_id", f"`{text_col}` text").mapInArrow(run, READ)
