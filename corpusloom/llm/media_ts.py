"""Media columns: payloads stored as MPEG transport streams and read back.

``mux`` writes one programme with one elementary stream: a programme association
table, a programme map table, then PES packets cut into 188-byte transport packets.
``demux`` is a general reader for such streams: it follows the tables to the
elementary stream (the first of the tables, or the one named), checks the continuity
counter of every PID, reassembles the PES packets and lists time stamps with
random-access points.  A packet sent twice counts once, and a discontinuity that its
packet announces is no break.  Both work on whole arrays of packets, so the cost of a
text grows with its bytes only.

Edge cases: a null or empty text is one block of padding; very long texts are
written as more access units; rows are independent, so ties, repeated rows and extra
columns have no effect.  A damaged stream raises ``ValueError`` in ``demux``; one with
packets missing is read on, with the places in ``broken``.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.common import short_batches, texts_of, tidy

PACKET = 188
BLOCK = 192
# Fixed values of ISO/IEC 13818-1.
SYNC = 0x47
PAT_PID = 0x0000
PMT_PID = 0x1000
ES_PID = 0x0100
NULL_PID = 0x1FFF
PRIVATE_STREAM = 0xBD
STREAM_TYPE_PRIVATE_PES = 0x06
CLOCK = 90_000
#: One access unit: so many blocks, shown for so many ticks; every GROUP-th is a random-access point.
UNIT_BLOCKS = 64
UNIT_TICKS = 3_600
GROUP = 4


def _crc_table() -> list[int]:
    out = []
    for i in range(256):
        c = i << 24
        for _ in range(8):
            c = ((c << 1) ^ 0x04C11DB7 if c & 0x80000000 else c << 1) & 0xFFFFFFFF
        out.append(c)
    return out


_CRC = _crc_table()


def crc32_mpeg(data: bytes) -> int:
    c = 0xFFFFFFFF
    for b in data:
        c = ((c << 8) & 0xFFFFFFFF) ^ _CRC[(c >> 24) ^ b]
    return c


def _section(table_id: int, ident: int, body: bytes) -> bytes:
    length = len(body) + 9
    head = bytes([table_id, 0xB0 | length >> 8, length & 255, ident >> 8, ident & 255, 0xC1, 0, 0])
    return head + body + crc32_mpeg(head + body).to_bytes(4, "big")


def _table_packet(pid: int, section: bytes) -> bytes:
    return bytes([SYNC, 0x40 | pid >> 8, pid & 255, 0x10, 0]) + section + b"\xff" * (PACKET - 5 - len(section))


PAT = _table_packet(PAT_PID, _section(0x00, 1, bytes([0, 1, 0xE0 | PMT_PID >> 8, PMT_PID & 255])))
PMT = _table_packet(
    PMT_PID,
    _section(0x02, 1, bytes([0xE0 | ES_PID >> 8, ES_PID & 255, 0xF0, 0, STREAM_TYPE_PRIVATE_PES, 0xE0 | ES_PID >> 8, ES_PID & 255, 0xF0, 0])),
)


def _stamp(ticks: int) -> bytes:
    t = ticks & (1 << 33) - 1
    return bytes([0x21 | t >> 29 & 0x0E, t >> 22 & 255, t >> 14 & 254 | 1, t >> 7 & 255, t << 1 & 254 | 1])


def _pes_head(ticks: int) -> bytes:
    # The length field is 0 (unbounded) where the unit may pass 65,535 bytes; here units are small.
    return b"\x00\x00\x01" + bytes([PRIVATE_STREAM]) + b"%b" + bytes([0x84, 0x80, 5]) + _stamp(ticks)


def _adaptation(length: int, random_access: bool, ticks: int) -> bytes:
    """An adaptation field of ``length`` bytes in all, its length byte included."""
    if length == 1:
        return b"\x00"
    if random_access:
        pcr = bytes([ticks >> 25 & 255, ticks >> 17 & 255, ticks >> 9 & 255, ticks >> 1 & 255, (ticks & 1) << 7 | 0x7E, 0])
        return bytes([length - 1, 0x50]) + pcr + b"\xff" * (length - 8)
    return bytes([length - 1, 0]) + b"\xff" * (length - 2)


def mux(payload: bytes) -> bytes:
    """A transport stream whose elementary stream is ``payload``."""
    out, counter, unit = [PAT, PMT], 0, UNIT_BLOCKS * BLOCK
    for k, at in enumerate(range(0, len(payload), unit)):
        body = payload[at : at + unit]
        ticks = k * UNIT_TICKS
        head = _pes_head(ticks)
        size = len(body) + 8
        pes = head.replace(b"%b", size.to_bytes(2, "big") if size < 65536 else b"\x00\x00", 1) + body
        random_access = k % GROUP == 0
        first = 184 - 8 * random_access
        rest = max(0, len(pes) - first)
        full, tail = divmod(rest, 184)
        n = 1 + full + (tail > 0)
        packets = np.empty((n, PACKET), dtype=np.uint8)
        packets[:, 0] = SYNC
        packets[:, 1] = ES_PID >> 8
        packets[0, 1] |= 0x40
        packets[:, 2] = ES_PID & 255
        packets[:, 3] = 0x10 | (counter + np.arange(n)) & 15
        counter += n
        data = np.frombuffer(pes, dtype=np.uint8)
        head_room = PACKET - 4 - min(first, len(pes))
        if head_room:
            packets[0, 3] |= 0x20
            packets[0, 4 : 4 + head_room] = np.frombuffer(_adaptation(head_room, random_access, ticks), dtype=np.uint8)
        packets[0, 4 + head_room :] = data[: PACKET - 4 - head_room]
        done = PACKET - 4 - head_room
        packets[1 : 1 + full, 4:] = data[done : done + 184 * full].reshape(full, 184)
        if tail:
            packets[-1, 3] |= 0x20
            packets[-1, 4 : PACKET - tail] = np.frombuffer(_adaptation(184 - tail, False, 0), dtype=np.uint8)
            packets[-1, PACKET - tail :] = data[len(pes) - tail :]
        out.append(packets.tobytes())
    return b"".join(out)


@dataclass
class Stream:
    """What a transport stream holds."""

    packets: int
    programs: dict[int, dict[int, int]]  # programme number -> PID -> stream type
    payload: bytes = b""
    stamps: list[int] = field(default_factory=list)
    random_access: list[int] = field(default_factory=list)  # indexes of access units
    broken: list[tuple[int, int]] = field(default_factory=list)  # (PID, packet) where a continuity counter jumps

    @property
    def breaks(self) -> int:
        return len(self.broken)


def _section_of(packet: np.ndarray) -> bytes:
    data = packet[4:].tobytes()
    if packet[3] & 0x20:
        data = data[data[0] + 1 :]
    data = data[data[0] + 1 :]
    size = ((data[1] & 15) << 8 | data[2]) + 3
    if crc32_mpeg(data[:size]):
        raise ValueError("a table's checksum is wrong")
    return data[:size]


def _flags(p: np.ndarray) -> np.ndarray:
    """The flags of the adaptation fields of packets, 0 without one."""
    return np.where((p[:, 3] & 0x20 > 0) & (p[:, 4] > 0), p[:, 5], 0)


def demux(stream: bytes, pid_wanted: int | None = None) -> Stream:
    """Read a transport stream back: the elementary stream ``pid_wanted``, or the first of the tables."""
    if not stream or len(stream) % PACKET:
        raise ValueError("not a whole number of packets")
    p = np.frombuffer(stream, dtype=np.uint8).reshape(-1, PACKET)
    if (p[:, 0] != SYNC).any():
        raise ValueError("lost synchronisation")
    pid = (p[:, 1].astype(np.int32) & 31) << 8 | p[:, 2]
    programs: dict[int, dict[int, int]] = {}
    for i in np.flatnonzero((pid == PAT_PID) & (p[:, 1] & 0x40 > 0)):
        section = _section_of(p[i])
        for at in range(8, len(section) - 4, 4):
            number, map_pid = section[at] << 8 | section[at + 1], (section[at + 2] & 31) << 8 | section[at + 3]
            if not number:
                continue
            for j in np.flatnonzero((pid == map_pid) & (p[:, 1] & 0x40 > 0)):
                m = _section_of(p[j])
                k = 12 + ((m[10] & 15) << 8 | m[11])
                while k < len(m) - 4:
                    programs.setdefault(number, {})[(m[k + 1] & 31) << 8 | m[k + 2]] = m[k]
                    k += 5 + ((m[k + 3] & 15) << 8 | m[k + 4])
    out = Stream(len(p), programs)
    has_payload = p[:, 3] & 0x10 > 0
    once = np.ones(len(p), dtype=bool)
    for one in np.unique(pid[pid != NULL_PID]):
        own = np.flatnonzero((pid == one) & has_payload)
        step = np.diff(p[own, 3].astype(np.int16) & 15) & 15
        twice = (step == 0) & (p[own[1:]] == p[own[:-1]]).all(1)
        once[own[1:][twice]] = False
        jump = (step != 1) & ~twice & (_flags(p[own[1:]]) & 0x80 == 0)
        out.broken += [(int(one), int(k)) for k in own[1:][jump]]
    es = next((q for streams in programs.values() for q in streams if pid_wanted in (None, q)), None)
    if es is None:
        raise ValueError("no such elementary stream in the tables")
    own = p[(pid == es) & has_payload & once]
    adapted = own[:, 3] & 0x20 > 0
    skip = np.where(adapted, own[:, 4].astype(np.int32) + 1, 0) + 4
    starts = np.flatnonzero(own[:, 1] & 0x40 > 0)
    pieces = []
    for k, (a, b) in enumerate(zip(starts, [*starts[1:], len(own)], strict=True)):
        if adapted[a] and own[a, 4] and own[a, 5] & 0x40:
            out.random_access.append(k)
        data = own[a, skip[a] :].tobytes()
        if data[:3] != b"\x00\x00\x01":
            raise ValueError("no PES start code")
        if data[7] & 0x80:
            s = data[9:14]
            out.stamps.append((s[0] & 14) << 29 | s[1] << 22 | (s[2] & 254) << 14 | s[3] << 7 | s[4] >> 1)
        pieces.append(data[9 + data[8] :])
        middle = slice(a + 1, b)
        plain = b - 1 if b - 1 > a and adapted[b - 1] else b
        if not adapted[a + 1 : plain].any():
            pieces.append(own[a + 1 : plain, 4:].tobytes())
            pieces += [own[j, skip[j] :].tobytes() for j in range(plain, b)]
        else:
            pieces += [own[j, skip[j] :].tobytes() for j in range(*middle.indices(len(own)))]
    out.payload = b"".join(pieces)
    return out


def padded(text: str | None) -> tuple[bytes, int]:
    """UTF-8 of a text, filled with spaces to a positive multiple of 192; its own length."""
    raw = (text or "").encode()
    return raw + b" " * (BLOCK - len(raw) % BLOCK if len(raw) % BLOCK or not raw else 0), len(raw)


SCHEMA = pa.schema(
    [("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("feature", pa.string()), ("packets", pa.int64()), ("breaks", pa.int64()), ("stamps", pa.list_(pa.int64())), ("random_access", pa.list_(pa.int32()))]
)
SPARK_SCHEMA = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, packets long, breaks long, stamps array<long>, random_access array<int>"


def _rows(found: Iterator[pa.RecordBatch], keep_media: bool) -> Iterator[pa.RecordBatch]:
    schema = SCHEMA.append(pa.field("media", pa.binary())) if keep_media else SCHEMA
    for batch in found:
        out, held = [], 0
        for doc_id, text in zip(batch.column("doc_id").to_pylist(), texts_of(batch), strict=True):
            payload, n = padded(text)
            media = mux(payload)
            back = demux(media)
            read = back.payload
            pcm = np.frombuffer(read, dtype=np.uint8)
            feature = f"au={len(back.stamps)};rap={len(back.random_access)};last={back.stamps[-1]};sum={int(pcm.sum(dtype=np.int64))};max={int(pcm.max())};zc={int(np.count_nonzero(np.diff((pcm > 127).view(np.int8))))}"
            row = {"doc_id": doc_id, "n_bytes": n, "payload_bytes": len(read), "payload_sha256": hashlib.sha256(read).hexdigest(), "tail_crc32": zlib.crc32(read[-16:]), "media_bytes": len(media), "media_sha256": hashlib.sha256(media).hexdigest(), "feature": feature, "packets": back.packets, "breaks": back.breaks, "stamps": back.stamps, "random_access": back.random_access}
            if keep_media:
                row["media"] = media
                held += len(media)
            out.append(row)
            if held > 32 << 20:
                yield pa.RecordBatch.from_pylist(out, schema=schema)
                out, held = [], 0
        yield pa.RecordBatch.from_pylist(out, schema=schema)


def media_column(docs: DataFrame, keep_media: bool = False) -> DataFrame:
    """Each text as a transport stream, with digests and an index of its access units.

    ``keep_media`` adds the stored bytes as column ``media``.  One narrow pass, no shuffle.
    """

    def run(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _rows(found, keep_media)

    short_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(tidy(run), SPARK_SCHEMA + (", media binary" if keep_media else ""))
