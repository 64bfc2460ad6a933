"""MPEG-2 transport streams as a column: write, parse, check and read back.

A stream is a sequence of 188-byte packets.  The program association table (PID 0) names each program's map table,
which names its elementary streams.  Elementary data travels in PES packets that start in a packet with the unit
start flag; the adaptation field before it may flag a random-access point and carry a clock.  The four-bit
continuity counter of each PID rises with each packet that has a payload.

``payload_of`` makes a payload of a text: its UTF-8 bytes (null: none) with 0 bytes up to a positive multiple of 64.
``write`` puts a payload into access units of 32 KiB, each a PES packet with a time stamp and a random-access point.
``parse`` reads any stream of this kind: tables that span packets, several programs, lost and repeated packets,
damaged sync bytes.  Rows come back one for one, repeated rows and null ids too; equal texts have equal streams; an
empty table gives no rows; further columns of the documents, whatever their names, are dropped.  Numbers of the format (packet size, table ids, stream ids, clocks) are the standard's.
"""

from __future__ import annotations

import hashlib
import zlib
from dataclasses import dataclass, field
from functools import cache, lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from veridicta.llm.common import byte_column
from veridicta.plans.shipping import ship

PACKET = 188
UNIT = 32 << 10
MAP_PID, DATA_PID = 0x1000, 0x100
PRIVATE_DATA = 0x06  # stream type: PES packets with private data
PRIVATE_STREAM = 0xBD
TICKS = 3600  # of the 90 kHz clock between access units
TABLES_EVERY = 16  # access units


@cache
def _crc_table() -> tuple[int, ...]:
    out = []
    for i in range(256):
        c = i << 24
        for _ in range(8):
            c = (c << 1) ^ 0x04C11DB7 if c & 0x80000000 else c << 1
        out.append(c & 0xFFFFFFFF)
    return tuple(out)


@lru_cache(4096)
def section_crc(data: bytes) -> int:
    c = 0xFFFFFFFF
    for b in data:
        c = (c << 8 & 0xFFFFFFFF) ^ _crc_table()[c >> 24 ^ b]
    return c


def _section(table: int, number: int, body: bytes) -> bytes:
    head = bytes([table]) + (0xB000 | len(body) + 9).to_bytes(2, "big") + number.to_bytes(2, "big") + b"\xc1\0\0"
    return head + body + section_crc(head + body).to_bytes(4, "big")


@cache
def _table_packet(pid: int, counter: int) -> bytes:
    if pid == 0:
        section = _section(0, 1, (1).to_bytes(2, "big") + (0xE000 | MAP_PID).to_bytes(2, "big"))
    else:
        body = (0xE000 | DATA_PID).to_bytes(2, "big") + b"\xf0\0" + bytes([PRIVATE_DATA]) + (0xE000 | DATA_PID).to_bytes(2, "big") + b"\xf0\0"
        section = _section(2, 1, body)
    packet = b"\x47" + (0x4000 | pid).to_bytes(2, "big") + bytes([0x10 | counter]) + b"\0" + section
    return packet.ljust(PACKET, b"\xff")


def _stamp(pts: int) -> bytes:
    return bytes([0x21 | pts >> 29 & 0x0E, pts >> 22 & 0xFF, 1 | pts >> 14 & 0xFE, pts >> 7 & 0xFF, 1 | pts << 1 & 0xFE])


def _clock(ticks: int) -> bytes:
    return ((ticks % (1 << 33)) << 15 | 0x3F << 9).to_bytes(6, "big")


def payload_of(text: bytes | None) -> bytes:
    text = text or b""
    return text.ljust(max(64, -(-len(text) // 64) * 64), b"\0")


def write(payload: bytes) -> bytes:
    """A single-program stream that holds ``payload``."""
    out, counter = [], 0
    for k in range(-(-len(payload) // UNIT)):
        data = payload[k * UNIT : (k + 1) * UNIT]
        if k % TABLES_EVERY == 0:
            n = k // TABLES_EVERY & 15
            out += [_table_packet(0, n), _table_packet(MAP_PID, n)]
        pts = k * TICKS % (1 << 33)
        pes = b"\0\0\1" + bytes([PRIVATE_STREAM]) + (len(data) + 8).to_bytes(2, "big") + b"\x84\x80\x05" + _stamp(pts) + data
        rest = max(0, len(pes) - 176)
        packets = np.full((1 + -(-rest // 184), PACKET), 0xFF, np.uint8)
        packets[:, 0], packets[:, 1], packets[:, 2] = 0x47, DATA_PID >> 8, DATA_PID & 0xFF
        packets[:, 3] = 0x10 | (counter + np.arange(len(packets)) & 15)
        counter += len(packets)
        packets[0, 1] |= 0x40
        packets[0, 3] |= 0x20
        first = pes[:176]
        field_size = 183 - len(first)  # 7, and more where the whole unit is shorter than a packet
        packets[0, 4 : 12] = np.frombuffer(bytes([field_size, 0x50]) + _clock(pts), np.uint8)
        packets[0, PACKET - len(first) :] = np.frombuffer(first, np.uint8)
        if rest:
            body = np.frombuffer(pes, np.uint8)[176:]
            full = rest // 184
            packets[1 : 1 + full, 4:] = body[: full * 184].reshape(full, 184)
            if tail := rest - full * 184:
                packets[-1, 3] |= 0x20
                packets[-1, 4] = 183 - tail
                if tail < 183:
                    packets[-1, 5] = 0
                packets[-1, PACKET - tail :] = body[full * 184 :]
        out.append(packets.tobytes())
    return b"".join(out)


@dataclass
class Unit:
    """One reassembled PES packet."""

    pid: int
    program: int
    stream_type: int
    pts: int | None
    dts: int | None
    random_access: bool
    data: bytes
    whole: bool  # no counter gap in it, and as long as its header says


@dataclass
class Stream:
    programs: dict[int, int] = field(default_factory=dict)  # program -> PID of its map
    streams: dict[int, tuple[int, int]] = field(default_factory=dict)  # PID -> program, stream type
    units: list[Unit] = field(default_factory=list)
    packets: int = 0
    bad_packets: int = 0
    counter_errors: int = 0
    repeated_packets: int = 0
    bad_tables: int = 0

    def feature(self) -> str:
        stamps = [u.pts for u in self.units if u.pts is not None]
        parts = {
            "programs": len(self.programs), "streams": len(self.streams), "packets": self.packets, "units": len(self.units), "counter_errors": self.counter_errors,
            "random_access": sum(u.random_access for u in self.units), "first_pts": min(stamps, default=""), "last_pts": max(stamps, default=""),
        }
        return ";".join(f"{k}={v}" for k, v in parts.items())


def _aligned(media: bytes, out: Stream) -> np.ndarray:
    """The packets; where the sync byte is lost, the stream is taken up at the next place where it returns."""
    a = np.frombuffer(media, np.uint8)
    n = len(a) // PACKET
    p = a[: n * PACKET].reshape(n, PACKET)
    if n and len(a) % PACKET == 0 and (p[:, 0] == 0x47).all():
        return p
    found, i = [], 0
    while i + PACKET <= len(a):
        if a[i] == 0x47 and (i + 2 * PACKET > len(a) or a[i + PACKET] == 0x47):
            found.append(i)
            i += PACKET
        else:
            if not found or found[-1] + PACKET == i:
                out.bad_packets += 1
            i += 1
    return a[np.array(found, np.int64)[:, None] + np.arange(PACKET)] if found else np.zeros((0, PACKET), np.uint8)


def _sections(payloads: list[tuple[bool, bytes]]):
    """Complete sections of one PID: the unit start flag comes with a pointer to where the next one begins."""
    held = None
    for start, data in payloads:
        if start and data:
            at = 1 + data[0]
            if held is not None:
                yield held + data[1:at]
            held = data[at:]
        elif held is not None:
            held += data
        while held is not None and len(held) >= 3 and held[0] != 0xFF and len(held) >= (size := 3 + ((held[1] & 15) << 8 | held[2])):
            yield held[:size]
            held = held[size:]


def _checked(sections, table: int, out: Stream):
    for s in sections:
        if len(s) < 12 or s[0] != table:
            continue
        size = 3 + ((s[1] & 15) << 8 | s[2])
        if len(s) < size or section_crc(bytes(s[: size - 4])) != int.from_bytes(s[size - 4 : size], "big"):
            out.bad_tables += 1
        elif s[5] & 1:  # current, not next
            yield s[:size]


def _time(b: bytes) -> int:
    return (b[0] >> 1 & 7) << 30 | b[1] << 22 | (b[2] >> 1) << 15 | b[3] << 7 | b[4] >> 1


def parse(media: bytes | None) -> Stream:
    out = Stream()
    p = _aligned(media or b"", out)
    out.packets = len(p)
    if not len(p):
        return out
    faulty = (p[:, 1] & 0x80) > 0
    out.bad_packets += int(faulty.sum())
    p = p[~faulty]
    pid = (p[:, 1].astype(np.int64) & 0x1F) << 8 | p[:, 2]
    field_size = np.where(p[:, 3] & 0x20, p[:, 4].astype(np.int64) + 1, 0)
    has_data = (p[:, 3] & 0x10) > 0
    begin = np.minimum(4 + field_size, PACKET)
    flags = np.where((field_size > 1), p[:, 5], 0)

    def data_of(of: int):
        """(packet numbers, marks of a gap before each) of the PID's packets with data; repeated ones are left out."""
        i = np.flatnonzero((pid == of) & has_data)
        counter = p[i, 3] & 15
        step = np.diff(counter.astype(np.int64), prepend=int(counter[0]) - 1 if len(i) else 0) & 15
        again = np.zeros(len(i), bool)
        for k in np.flatnonzero(step == 0):
            again[k] = k > 0 and (p[i[k]] == p[i[k - 1]]).all()
        out.repeated_packets += int(again.sum())
        gap = (step != 1) & ~again & ((flags[i] & 0x80) == 0)
        out.counter_errors += int(gap.sum())
        return i[~again], gap[~again]

    def payloads(of: int):
        i, _ = data_of(of)
        return [(bool(p[k, 1] & 0x40), p[k, begin[k] :].tobytes()) for k in i]

    for s in _checked(_sections(payloads(0)), 0, out):
        for k in range(8, len(s) - 4, 4):
            if number := int.from_bytes(s[k : k + 2], "big"):
                out.programs[number] = int.from_bytes(s[k + 2 : k + 4], "big") & 0x1FFF
    for map_pid in sorted(set(out.programs.values())):
        for s in _checked(_sections(payloads(map_pid)), 2, out):
            number, k = int.from_bytes(s[3:5], "big"), 12 + (int.from_bytes(s[10:12], "big") & 0xFFF)
            while k + 5 <= len(s) - 4:
                out.streams[int.from_bytes(s[k + 1 : k + 3], "big") & 0x1FFF] = (number, s[k])
                k += 5 + (int.from_bytes(s[k + 3 : k + 5], "big") & 0xFFF)
    columns = np.arange(PACKET)
    for es, (number, kind) in sorted(out.streams.items()):
        i, gap = data_of(es)
        starts = np.flatnonzero(p[i, 1] & 0x40)
        for a, b in zip(starts, np.r_[starts[1:], len(i)], strict=True):
            rows = i[a:b]
            pes = p[rows][columns >= begin[rows][:, None]].tobytes()
            if pes[:3] != b"\0\0\1" or len(pes) < 9:
                continue
            size, head = int.from_bytes(pes[4:6], "big"), 9 + pes[8]
            stamps = pes[7] >> 6
            whole = not gap[a + 1 : b].any() and (size == 0 or len(pes) >= size + 6)
            out.units.append(
                Unit(es, number, kind, _time(pes[9:14]) if stamps & 2 else None, _time(pes[14:19]) if stamps == 3 else None, bool(flags[rows[0]] & 0x40), pes[head : size + 6 if size else None], whole)
            )
    return out


def read(media: bytes | None, pid: int = DATA_PID) -> bytes:
    """The bytes of one elementary stream, in order."""
    return b"".join(u.data for u in parse(media).units if u.pid == pid)


def access_units(df: DataFrame, column: str, key: str) -> DataFrame:
    """One row for each access unit of a binary column of streams: key, unit, pid, program, stream_type, pts, dts,
    random_access, whole, n_bytes.  A null or empty stream has none."""
    ship(df.sparkSession)
    schema = f"{key} {df.select(key).dtypes[0][1]}, unit long, pid int, program int, stream_type int, pts long, dts long, random_access boolean, whole boolean, n_bytes long"

    def run(batches):
        for b in batches:
            for k, media in zip(b.column(0), b.column(1).to_pylist(), strict=True):
                units = parse(media).units
                if units:
                    n = len(units)
                    cols = [pa.repeat(k, n), pa.array(range(n), pa.int64())]
                    for name, t in (("pid", pa.int32()), ("program", pa.int32()), ("stream_type", pa.int32()), ("pts", pa.int64()), ("dts", pa.int64()), ("random_access", pa.bool_()), ("whole", pa.bool_())):
                        cols.append(pa.array([getattr(u, name) for u in units], t))
                    cols.append(pa.array([len(u.data) for u in units], pa.int64()))
                    yield pa.RecordBatch.from_arrays(cols, [key, "unit", "pid", "program", "stream_type", "pts", "dts", "random_access", "whole", "n_bytes"])

    return df.select(key, column).mapInArrow(run, schema)


def media_column(documents: DataFrame, keep_media: bool = False) -> DataFrame:
    """doc_id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature (and media)."""
    ship(documents.sparkSession)
    schema = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    schema += ", media binary" * keep_media

    def run(batches):
        for b in batches:
            for at in range(0, b.num_rows, 512):
                part = b.slice(at, 512)
                rows = []
                for text in byte_column(part.column(1)):
                    media = write(payload_of(text))
                    stream = parse(media)
                    back = b"".join(u.data for u in stream.units)
                    rows.append((len(text), len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-64:]), len(media), hashlib.sha256(media).hexdigest(), stream.feature(), media))
                names = ["n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "media"][: 7 + keep_media]
                kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.binary()]
                cols = [pa.array([r[k] for r in rows], kinds[k]) for k in range(len(names))]
                yield pa.RecordBatch.from_arrays([part.column(0).cast(pa.int64()), *cols], ["doc_id", *names])

    return documents.select("doc_id", "text").mapInArrow(run, schema)
