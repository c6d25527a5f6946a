"""MPEG audio media columns (operator 5): an audio stream writer and a resynchronising, checking parser.

Storing: the bytes of a text, padded with spaces to a positive multiple of 192, ride as ancillary data in silent MPEG-1
Layer III frames (80 kbit/s, 48 kHz, mono, 240 bytes a frame, CRC-16 on), behind an ID3v2 tag that keeps the unpadded
length and an Info frame with frame count, byte count and seek table. Any decoder plays silence; every payload byte
comes back.

Parsing handles ID3v2, ID3v1 and APEv2 tags, Xing/Info and VBRI tables, MPEG 1, 2 and 2.5 in layers I to III, and
damage: where no header stands, it searches on for the next header that another one follows. A tag at the end counts
only if no frame of the chain reaches into it, so a payload may look like one. Durations are exact (samples over rate),
seek offsets are the frames' byte offsets, and CRC-16 is verified where a frame has one, in all three layers.

Edge cases: null and empty texts store 192 spaces; equal texts give equal bytes; media that is null or holds no frame
gives 0 frames, duration 0 and an empty payload; repeated rows stay; an empty table gives no rows; other columns are
ignored.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import lean, materialize, sliced

# Fixed values of ISO/IEC 11172-3 and 13818-3: kbit/s by bitrate index 1 to 14, Hz by sampling index, CRC polynomial.
KBITS = {
    (1, 1): (32, 64, 96, 128, 160, 192, 224, 256, 288, 320, 352, 384, 416, 448),
    (1, 2): (32, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320, 384),
    (1, 3): (32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320),
    (2, 1): (32, 48, 56, 64, 80, 96, 112, 128, 144, 160, 176, 192, 224, 256),
    (2, 2): (8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
    (2, 3): (8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
}
HERTZ = {1: (44100, 48000, 32000), 2: (22050, 24000, 16000), 2.5: (11025, 12000, 8000)}
POLY = 0x8005

UNIT, FRAME, SIDE = 192, 240, 17
HEADER = bytes([0xFF, 0xFA, 0x64, 0xC0])  # with CRC
HEADER_BARE = bytes([0xFF, 0xFB, 0x64, 0xC0])


def _crc_table() -> list[int]:
    out = []
    for b in range(256):
        c = b << 8
        for _ in range(8):
            c = (c << 1 ^ (POLY if c & 0x8000 else 0)) & 0xFFFF
        out.append(c)
    return out


CRC_TABLE = _crc_table()


@lru_cache(4096)
def crc16(data: bytes) -> int:
    c = 0xFFFF
    for b in data:
        c = (c << 8 & 0xFFFF) ^ CRC_TABLE[c >> 8 ^ b]
    return c


@lru_cache(4096)
def header(h: bytes) -> dict | None:
    """What a 4-byte frame header says, or None if it isn't one (free format has no length and isn't taken)."""
    if len(h) < 4 or h[0] != 0xFF or h[1] & 0xE0 != 0xE0:
        return None
    version = {0: 2.5, 2: 2, 3: 1}.get(h[1] >> 3 & 3)
    layer = {3: 1, 2: 2, 1: 3}.get(h[1] >> 1 & 3)
    rate_at, hz_at = h[2] >> 4, h[2] >> 2 & 3
    if version is None or layer is None or rate_at in (0, 15) or hz_at == 3 or h[3] & 3 == 2:
        return None
    bits = KBITS[1 if version == 1 else 2, layer][rate_at - 1] * 1000
    hz, pad, mono = HERTZ[version][hz_at], h[2] >> 1 & 1, h[3] >> 6 == 3
    samples = 384 if layer == 1 else 576 if layer == 3 and version != 1 else 1152
    size = (12 * bits // hz + pad) * 4 if layer == 1 else samples // 8 * bits // hz + pad
    side = (17 if mono else 32) if version == 1 else (9 if mono else 17)
    return {
        "version": version, "layer": layer, "bits": bits, "hz": hz, "mono": mono, "samples": samples, "size": size,
        "side": side if layer == 3 else 0, "crc": not h[1] & 1, "kind": (version, layer, hz),
    }


def _syncsafe(b: bytes) -> int:
    return b[0] << 21 | b[1] << 14 | b[2] << 7 | b[3]


def _id3v2(data: bytes) -> tuple[int, dict[str, str]]:
    """Length of the ID3v2 tag at the start (0: none) and its text frames."""
    if data[:3] != b"ID3" or len(data) < 10:
        return 0, {}
    end, tags, at = 10 + _syncsafe(data[6:10]), {}, 10
    while at + 10 <= min(end, len(data)) and data[at : at + 4].strip(b"\0"):
        name = data[at : at + 4].decode("latin-1")
        n = _syncsafe(data[at + 4 : at + 8]) if data[3] >= 4 else int.from_bytes(data[at + 4 : at + 8], "big")
        body = data[at + 10 : at + 10 + n]
        if name[0] == "T" and body:
            text = body[1:].decode(("latin-1", "utf-16", "utf-16-be", "utf-8")[min(body[0], 3)], "replace")
            key, _, value = text.partition("\0") if name == "TXXX" else (name, "", text)
            tags[key] = value.rstrip("\0")
        at += 10 + n
    return end + 10 * (data[5] >> 4 & 1), tags


def _vbr_table(frame: bytes, h: dict) -> dict | None:
    """The Xing, Info or VBRI table of a first Layer III frame."""
    for at in (4 + h["side"], 6 + h["side"]):
        if frame[at : at + 4] in (b"Xing", b"Info"):
            out, flags, at = {"kind": frame[at : at + 4].decode()}, int.from_bytes(frame[at + 4 : at + 8], "big"), at + 8
            for bit, name in ((1, "frames"), (2, "bytes")):
                if flags & bit:
                    out[name], at = int.from_bytes(frame[at : at + 4], "big"), at + 4
            if flags & 4:
                out["toc"] = tuple(frame[at : at + 100])
            return out
    if frame[36:40] == b"VBRI":
        n, frames, entries, scale, size, per = struct.unpack(">IIHHHH", frame[46:62].ljust(16, b"\0"))
        at = [62 + k * size for k in range(entries)] if 1 <= size <= 4 and 62 + entries * size <= len(frame) else []
        toc = tuple(int.from_bytes(frame[a : a + size], "big") * scale for a in at)
        return {"kind": "VBRI", "bytes": n, "frames": frames, "toc": toc, "frames_per_entry": per}
    return None


#: Layer II: (subbands, bits of an allocation) by table; the last is that of MPEG 2 and 2.5.
ALLOCATION = {
    "a": ((11, 4), (12, 3), (4, 2)), "b": ((11, 4), (12, 3), (7, 2)), "c": ((2, 4), (6, 3)), "d": ((2, 4), (10, 3)),
    "lsf": ((4, 4), (7, 3), (19, 2)),
}


def _allocation(h: dict) -> list[int]:
    """Bits of the allocation of each subband in a Layer I or II frame."""
    if h["layer"] == 1:
        return [4] * 32
    if h["version"] != 1:
        table = "lsf"
    else:
        per_channel = h["bits"] // (1 if h["mono"] else 2)
        low = per_channel < 56_000
        table = ("d" if h["hz"] == 32000 else "c") if low else "b" if per_channel >= 96_000 and h["hz"] != 48000 else "a"
    return [bits for n, bits in ALLOCATION[table] for _ in range(n)]


def protected(frame: bytes, h: dict) -> str:
    """The bits under the CRC of a frame: the header's second half, then side information, or allocations and scale factor selection."""
    said = "".join(f"{b:08b}" for b in frame[2:4])
    if h["layer"] == 3:
        return said + "".join(f"{b:08b}" for b in frame[6 : 6 + h["side"]])
    sizes, mode = _allocation(h), frame[3] >> 6
    apart = 0 if mode == 3 else min(len(sizes), (frame[3] >> 4 & 3) * 4 + 4) if mode == 1 else len(sizes)
    body = "".join(f"{b:08b}" for b in frame[6:150])  # 32 * 2 allocations of 4 bits and as many selections of 2
    at = chosen = 0
    for k, n in enumerate(sizes):
        for _ in range(2 if k < apart else 1):
            # From the joint bound on, both channels share an allocation and each has its own scale factors.
            chosen += (1 if mode == 3 or k < apart else 2) * ("1" in body[at : at + n])
            at += n
    return said + body[: at + (2 * chosen if h["layer"] == 2 else 0)]


@lru_cache(4096)
def crc16_bits(bits: str) -> int:
    c = 0xFFFF
    for b in bits:
        c = (c << 1 & 0xFFFF) ^ (POLY if c >> 15 ^ (b == "1") else 0)
    return c


def _intact(frame: bytes, h: dict) -> bool:
    c = crc16(frame[2:4] + frame[6 : 6 + h["side"]]) if h["layer"] == 3 else crc16_bits(protected(frame, h))
    return c == frame[4] << 8 | frame[5]


def _frames(data: bytes, at: int, end: int):
    """(offset, header, whether it is the first) of the frames, and (length, None, False) of what is skipped."""
    kind, synced = None, False
    while at + 4 <= end:
        h = header(data[at : at + 4])
        fits = h is not None and at + h["size"] <= end and (kind is None or h["kind"] == kind)
        if fits and not synced:  # a first header, or one after damage, counts if another follows or the stream ends
            after = at + h["size"]
            nxt = header(data[after : after + 4]) if after + 4 <= end else None
            fits = after == end or nxt is not None and nxt["kind"] == h["kind"]
        if not fits:
            nxt = data.find(b"\xff", at + 1, end)
            nxt = end if nxt < 0 else nxt
            yield nxt - at, None, False
            at, synced = nxt, False
            continue
        yield at, h, kind is None
        kind, synced = h["kind"], True
        at += h["size"]
    if at < end:
        yield end - at, None, False


def _reached(data: bytes, at: int, end: int, tag: int) -> bool:
    """Whether a frame that another one or the end follows reaches into a supposed tag; then it isn't one."""
    for x, h, _ in _frames(data, at, end):
        if h is not None and x + h["size"] > tag:
            after = x + h["size"]
            nxt = header(data[after : after + 4]) if after + 4 <= end else None
            return after == end or nxt is not None and nxt["kind"] == h["kind"]
    return False


def parse(data: bytes | None) -> dict:
    """Tags, VBR table, exact duration, CRC results, skipped bytes, frame offsets and ancillary payload of a stream."""
    data = data or b""
    at, tags = _id3v2(data)
    end = len(data)
    if data[-128:-125] == b"TAG" and end - 128 >= at and not _reached(data, at, end, end - 128):
        end -= 128
        tags.setdefault("TIT2", data[end + 3 : end + 33].rstrip(b"\0 ").decode("latin-1"))
    if data[end - 32 : end - 24] == b"APETAGEX" and end - 32 >= at:
        n = int.from_bytes(data[end - 20 : end - 16], "little")
        start = max(at, end - n - (32 if data[end - 9] & 0x80 else 0))
        if not _reached(data, at, end, start):
            end = start
    offsets: list[int] = []
    payload: list[bytes] = []
    first = vbr = None
    samples = good = bad = skipped = 0
    for at, h, is_first in _frames(data, at, end):
        if h is None:
            skipped += at
            continue
        frame = data[at : at + h["size"]]
        if is_first:
            first = h
            vbr = _vbr_table(frame, h) if h["layer"] == 3 else None
            if vbr:
                continue
        if h["crc"]:
            ok = _intact(frame, h)
            good, bad = good + ok, bad + (not ok)
        offsets.append(at)
        samples += h["samples"]
        side = 6 if h["crc"] else 4
        if h["layer"] == 3 and not any(frame[side : side + h["side"]]):  # no main data: all that follows is ancillary
            payload.append(frame[side + h["side"] : side + h["side"] + UNIT])
    hz = first["hz"] if first else 1
    return {
        "tags": tags, "vbr": vbr, "first": first, "frames": len(offsets), "samples": samples, "hz": hz,
        "micros": samples * 1_000_000 // hz, "crc_ok": good, "crc_bad": bad, "skipped": skipped,
        "seek": np.asarray(offsets, "<u4"), "payload": b"".join(payload),
    }


def store(text: str | None) -> bytes:
    """The MPEG stream that carries a text."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    n = max(1, -(-len(raw) // UNIT))
    frames = np.zeros((n, FRAME), np.uint8)
    frames[:, :4] = np.frombuffer(HEADER, np.uint8)
    frames[:, 4:6] = np.frombuffer(struct.pack(">H", crc16(HEADER[2:] + bytes(SIDE))), np.uint8)
    at = 6 + SIDE
    frames[:, at : at + UNIT] = np.frombuffer(raw.ljust(n * UNIT, b" "), np.uint8).reshape(n, UNIT)
    toc = bytes(k * 256 // 100 for k in range(100))
    info = (HEADER_BARE + bytes(SIDE) + b"Info" + struct.pack(">III", 7, n, (n + 1) * FRAME) + toc).ljust(FRAME, b"\0")
    value = b"\x03n_bytes\x00%d" % len(raw)
    size = 10 + len(value)
    safe = bytes(size >> s & 127 for s in (21, 14, 7, 0))
    frame = b"TXXX" + bytes(len(value) >> s & 127 for s in (21, 14, 7, 0)) + b"\0\0" + value
    return b"ID3\x04\0\0" + safe + frame + info + frames.tobytes()


def feature(p: dict) -> str:
    """One line on a stream: format, exact duration, VBR table, CRC results and a digest of the seek offsets."""
    f = p["first"]
    kind = f"mpeg{f['version']}-layer{f['layer']},{f['hz']}Hz,{1 if f['mono'] else 2}ch" if f else "none"
    return (
        f"{kind};frames={p['frames']};duration={p['samples']}/{p['hz']}s;vbr={p['vbr']['kind'] if p['vbr'] else '-'}:"
        f"{(p['vbr'] or {}).get('frames', '-')};crc={p['crc_ok']}/{p['crc_ok'] + p['crc_bad']};skipped={p['skipped']};"
        f"seek={zlib.crc32(p['seek'].tobytes()):08x}"
    )


def encode_texts(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(doc_id, media): the media column of MPEG streams."""

    @lean
    def run(batches):
        for b in sliced(batches, 1):
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array([store(t) for t in b.column(1).to_pylist()], pa.binary())], ["doc_id", "media"]
            )

    return docs.select(docs[key].alias("doc_id"), docs[text].cast("string").alias("text")).mapInArrow(run, "doc_id long, media binary")


SCHEMA = (
    "doc_id long, n_bytes long, payload binary, media_bytes long, media_sha256 string, frames long, samples long, hz int, "
    "duration_us long, crc_ok long, crc_bad long, skipped long, vbr string, seek array<long>, feature string"
)


def probe(media: DataFrame, with_payload: bool = True, with_seek: bool = True) -> DataFrame:
    """Parse a media column: durations, frame seek offsets, CRC results and the carried payload."""

    @lean
    def run(batches):
        for b in sliced(batches, 1):
            out = []
            for key, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                p = parse(data)
                n = p["tags"].get("n_bytes", "")
                out.append((
                    key, int(n) if n.isdigit() else len(p["payload"]), p["payload"] if with_payload else None, len(data or b""),
                    hashlib.sha256(data or b"").hexdigest(), p["frames"], p["samples"], p["hz"], p["micros"], p["crc_ok"],
                    p["crc_bad"], p["skipped"], p["vbr"]["kind"] if p["vbr"] else None, p["seek"].tolist() if with_seek else [], feature(p),
                ))
            names = [x.split()[0] for x in SCHEMA.split(", ")]
            kinds = [pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int32(), *[pa.int64()] * 4, pa.string(), pa.list_(pa.int64()), pa.string()]
            cols = list(zip(*out)) or [[]] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(cols, kinds)], names)

    return media.select("doc_id", "media").mapInArrow(run, SCHEMA)


DIGEST = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def digests(docs: DataFrame) -> DataFrame:
    """Store all texts as a media table, read it back, and digest what was read (the columns of DIGEST)."""
    media = materialize(encode_texts(docs), "mpeg-media")

    @lean
    def run(batches):
        for b in sliced(batches, 1):
            rows = []
            for key, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                p = parse(data)
                load = p["payload"]
                rows.append((
                    key, int(p["tags"]["n_bytes"]), len(load), hashlib.sha256(load).hexdigest(), zlib.crc32(load[-16:]),
                    len(data), hashlib.sha256(data).hexdigest(), feature(p),
                ))
            cols = list(zip(*rows)) or [[]] * 8
            kinds = [pa.int64()] * 3 + [pa.string()] + [pa.int64()] * 2 + [pa.string()] * 2
            yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(cols, kinds)], [x.split()[0] for x in DIGEST.split(", ")])

    return media.mapInArrow(run, DIGEST)
