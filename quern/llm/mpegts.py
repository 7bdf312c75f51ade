"""Media columns holding MPEG transport streams (ISO/IEC 13818-1).

A payload is stored as a private elementary stream: access units of up to UNIT bytes, each a PES
packet with a presentation time, in transport packets of 188 bytes behind a program association
table and a program map table.  Each access unit starts with the random-access flag and a clock
reference.  Reading parses the tables, checks continuity counters, reassembles the elementary
packets and returns the payload with the times and offsets of the random-access points.

A reader keeps a state per packet id, so streams may be interleaved; a packet that is sent twice counts once,
a jump of the counter that the discontinuity flag announces is no fault, and tables may span
packets.  The column of payloads is the elementary stream of the smallest packet id.

Defined cases: null and empty texts are 64 zero bytes; a stream that is cut, has lost or damaged packets or
no tables is read as far as it goes, and the faults are counted; a table that fails its check is not used; very long texts
are many access units of one stream; equal texts, also in repeated rows, give equal streams; an empty
table gives an empty one; only doc_id and text are read, so other columns can't clash.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import _parse_datatype_string

from quern.llm import textblocks as tb

PACKET, UNIT, BLOCK = 188, 32768, 64
PMT_PID, ES_PID, STREAM_TYPE, STREAM_ID = 0x1000, 0x0100, 0x06, 0xBD
TICKS = 3600  # 90 kHz clock, 25 units a second


def _crc_table() -> list[int]:
    out = []
    for i in range(256):
        c = i << 24
        for _ in range(8):
            c = (c << 1) ^ (0x04C11DB7 if c & 0x80000000 else 0)
        out.append(c & 0xFFFFFFFF)
    return out


_CRC = _crc_table()


def crc_mpeg(data: bytes) -> int:
    c = 0xFFFFFFFF
    for b in data:
        c = ((c << 8) & 0xFFFFFFFF) ^ _CRC[(c >> 24) ^ b]
    return c


def _section(table: int, number: int, body: bytes) -> bytes:
    head = bytes([table]) + (0xB000 | (len(body) + 9)).to_bytes(2, "big") + number.to_bytes(2, "big") + b"\xc1\x00\x00"
    return head + body + crc_mpeg(head + body).to_bytes(4, "big")


def _table_packet(pid: int, section: bytes) -> bytes:
    return (b"\x47" + (0x4000 | pid).to_bytes(2, "big") + b"\x10\x00" + section).ljust(PACKET, b"\xff")


_TABLES = _table_packet(0, _section(0, 1, (1).to_bytes(2, "big") + (0xE000 | PMT_PID).to_bytes(2, "big"))) + _table_packet(
    PMT_PID, _section(2, 1, (0xE000 | ES_PID).to_bytes(2, "big") + b"\xf0\x00" + bytes([STREAM_TYPE]) + (0xE000 | ES_PID).to_bytes(2, "big") + b"\xf0\x00")
)


def _time(prefix: int, t: int) -> bytes:
    t &= (1 << 33) - 1
    return bytes([prefix << 4 | (t >> 29 & 14) | 1, t >> 22 & 255, (t >> 14 & 254) | 1, t >> 7 & 255, (t << 1 & 254) | 1])


def padded(text: str | None) -> tuple[bytes, int]:
    raw = (text or "").encode("utf-8", "surrogatepass")
    return raw + bytes(-len(raw) % BLOCK or (0 if raw else BLOCK)), len(raw)


def encode(payload: bytes, unit: int = UNIT) -> bytes:
    out, cc = [_TABLES], 0
    for k, at in enumerate(range(0, len(payload), unit)):
        part = payload[at : at + unit]
        t = (k + 1) * TICKS
        pes = b"\x00\x00\x01" + bytes([STREAM_ID]) + (len(part) + 8).to_bytes(2, "big") + b"\x80\x80\x05" + _time(2, t) + part
        clock = ((t - TICKS) << 15 | 0x7E00).to_bytes(6, "big")  # base, reserved bits, extension 0
        pos, first = 0, True
        while pos < len(pes):
            extra = b"\x50" + clock if first else b""
            room = PACKET - 4 - (len(extra) + 1 if extra else 0)
            take = min(room, len(pes) - pos)
            fill = room - take
            if extra or fill:
                if not extra:
                    fill -= 1
                    extra = b"" if fill == 0 else b"\x00"
                    fill -= len(extra)
                field_ = bytes([len(extra) + fill]) + extra + b"\xff" * fill
                control = 0x30
            else:
                field_, control = b"", 0x10
            out.append(b"\x47" + ((0x4000 if first else 0) | ES_PID).to_bytes(2, "big") + bytes([control | cc]) + field_ + pes[pos : pos + take])
            cc, pos, first = (cc + 1) & 15, pos + take, False
    return b"".join(out)


@dataclass
class Elementary:
    """One elementary stream: its type, the payload of its packets, and its random-access points."""

    kind: int
    parts: list[bytes] = field(default_factory=list)
    size: int = 0
    points: list[tuple[int, int]] = field(default_factory=list)  # (time, offset in the payload)
    held: list[memoryview] | None = None  # the elementary packet that is being collected
    point: bool = False

    @property
    def payload(self) -> bytes:
        return b"".join(self.parts)


@dataclass
class Stream:
    programs: int = 0
    streams: dict[int, Elementary] = field(default_factory=dict)  # by packet id
    packets: int = 0
    cc_errors: int = 0
    crc_errors: int = 0
    pes_errors: int = 0

    @property
    def first(self) -> Elementary:
        """The elementary stream of the smallest packet id."""
        return self.streams[min(self.streams)] if self.streams else Elementary(0)


#: Stream ids whose packets have no optional header: map, padding, private 2, ECM, EMM, DSM-CC, H.222.1 E, directory.
_BARE = {0xBC, 0xBE, 0xBF, 0xF0, 0xF1, 0xF2, 0xF8, 0xFF}


class Reader:
    """Parses transport packets one after the other; each packet id has a state of its own."""

    def __init__(self):
        self.found = Stream()
        self.maps: set[int] = set()  # packet ids of program maps
        self.last: dict[int, tuple[int, bytes]] = {}  # counter and body of the last packet with a payload
        self.tables: dict[int, bytearray] = {}  # sections that are not whole yet

    def packet(self, data: memoryview) -> None:
        found = self.found
        if len(data) < PACKET or data[0] != 0x47 or data[1] & 0x80:
            found.cc_errors += 1  # no packet, or marked as damaged
            return
        found.packets += 1
        pid = (data[1] & 0x1F) << 8 | data[2]
        begin, point, jump = 4, False, False
        if data[3] & 0x20:
            if data[4]:
                jump, point = bool(data[5] & 0x80), bool(data[5] & 0x40)
            begin = 5 + data[4]
        if not data[3] & 0x10 or pid == 0x1FFF or begin > PACKET:
            return
        body, counter = data[begin:], data[3] & 15
        if pid in self.last and not jump:
            before, same = self.last[pid]
            if before == counter and same == body:
                return  # a packet may be sent twice
            if (before + 1) & 15 != counter:
                found.cc_errors += 1
                self.tables.pop(pid, None)
        self.last[pid] = (counter, bytes(body))
        starts = bool(data[1] & 0x40)
        if pid == 0 or pid in self.maps:
            self.sections(pid, body, starts)
        elif pid in found.streams:
            one = found.streams[pid]
            if starts:
                self.close(one)
                one.held, one.point = [], point
            if one.held is not None:
                one.held.append(body)

    def sections(self, pid: int, body: memoryview, starts: bool) -> None:
        if starts:
            pointer = body[0] + 1
            if pid in self.tables:
                self.tables[pid] += body[1:pointer]
                self.whole(pid)
            self.tables[pid] = bytearray(body[pointer:])
        elif pid in self.tables:
            self.tables[pid] += body
        self.whole(pid)

    def whole(self, pid: int) -> None:
        """Reads the sections that have come in whole; 0xFF fills the rest of a packet."""
        held = self.tables.get(pid)
        while held is not None and len(held) >= 3 and held[0] != 0xFF:
            size = 3 + (int.from_bytes(held[1:3], "big") & 0x0FFF)
            if len(held) < size:
                return
            section = bytes(held[:size])
            del held[:size]
            if size < 12 or crc_mpeg(section):
                self.found.crc_errors += 1
            else:
                self.table(pid, section[0], section[8:-4])

    def table(self, pid: int, number: int, body: bytes) -> None:
        number_at = lambda i: int.from_bytes(body[i : i + 2], "big")
        if pid == 0 and number == 0:
            self.maps |= {number_at(i + 2) & 0x1FFF for i in range(0, len(body) - 3, 4) if number_at(i)}
            self.found.programs = len(self.maps)
        elif pid in self.maps and number == 2:
            i = 4 + (number_at(2) & 0x0FFF)
            while i + 5 <= len(body):
                self.found.streams.setdefault(number_at(i + 1) & 0x1FFF, Elementary(body[i]))
                i += 5 + (number_at(i + 3) & 0x0FFF)

    def close(self, one: Elementary) -> None:
        """Takes the payload out of the elementary packet collected."""
        if one.held is None:
            return
        pes, one.held = b"".join(one.held), None
        size = int.from_bytes(pes[4:6], "big")
        if len(pes) < 9 or pes[:3] != b"\x00\x00\x01" or (size and len(pes) < 6 + size):
            self.found.pes_errors += 1
        if pes[:3] != b"\x00\x00\x01":
            return
        end, time = (6 + size if size else len(pes)), None
        if pes[3] in _BARE:
            body = pes[6:end]
        else:
            body = pes[9 + pes[8] : end] if len(pes) > 8 else b""
            if len(pes) >= 14 and pes[7] & 0x80:
                p = pes[9:14]
                time = (p[0] >> 1 & 7) << 30 | p[1] << 22 | (p[2] >> 1) << 15 | p[3] << 7 | p[4] >> 1
        if one.point and time is not None:
            one.points.append((time, one.size))
        one.parts.append(body)
        one.size += len(body)

    def end(self) -> Stream:
        for one in self.found.streams.values():
            self.close(one)
        return self.found


def parse(media: bytes) -> Stream:
    reader, view = Reader(), memoryview(media)
    for at in range(0, len(media), PACKET):
        reader.packet(view[at : at + PACKET])
    return reader.end()


def feature(s: Stream) -> str:
    points, units = s.first.points, len(s.first.parts)
    first, last = (points[0][0], points[-1][0]) if points else (-1, -1)
    streams = ",".join(f"{p:04x}:{x.kind:02x}" for p, x in sorted(s.streams.items()))
    faults = f"cc_errors={s.cc_errors};crc_errors={s.crc_errors};pes_errors={s.pes_errors}"
    return f"programs={s.programs};streams={streams};packets={s.packets};units={units};points={len(points)};pts={first}-{last};{faults}"


def to_media(docs: DataFrame, unit: int = UNIT) -> DataFrame:
    """(doc_id, n_bytes, media): the text of each document as a transport stream."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = batch.column("doc_id"), batch.column("text")
            # few at a time, so that no batch of streams is large
            for lo in range(0, len(texts), 128):
                rows = [padded(t) for t in texts.slice(lo, 128).to_pylist()]
                yield pa.RecordBatch.from_arrays([ids.slice(lo, 128), pa.array([n for _, n in rows], pa.int64()), pa.array([encode(p, unit) for p, _ in rows], pa.binary())], names=["doc_id", "n_bytes", "media"])

    return docs.select("doc_id", "text").mapInArrow(run, docs.select("doc_id").schema.add("n_bytes", "long").add("media", "binary"))


def from_media(media: DataFrame) -> DataFrame:
    """Reads the streams of rows (doc_id, n_bytes, media): digests of payload and stream, the
    random-access points with their times, and what parsing found."""
    more = "payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, points array<struct<time:long,offset:long>>"
    schema = media.select("doc_id", "n_bytes").schema
    for f in _parse_datatype_string(more).fields:
        schema = schema.add(f)
    kind = pa.list_(pa.struct([("time", pa.int64()), ("offset", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in tb.slices(batches, 128):
            data = [m.as_py() for m in batch.column("media")]
            found = [parse(m or b"") for m in data]
            payloads = [s.first.payload for s in found]
            columns = [
                batch.column("doc_id"), batch.column("n_bytes"),
                pa.array([len(p) for p in payloads], pa.int64()),
                pa.array([hashlib.sha256(p).hexdigest() for p in payloads], pa.string()),
                pa.array([zlib.crc32(p[-BLOCK:]) for p in payloads], pa.int64()),
                pa.array([len(m or b"") for m in data], pa.int64()),
                pa.array([hashlib.sha256(m or b"").hexdigest() for m in data], pa.string()),
                pa.array([feature(s) for s in found], pa.string()),
                pa.array([[{"time": t, "offset": o} for t, o in s.first.points] for s in found], kind),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=schema.fieldNames())

    return media.mapInArrow(run, schema)
