"""Media columns: Matroska files written from bytes and parsed into packet tables.

The parser reads EBML elements of variable-length ids and sizes (unknown sizes too), clusters, simple
blocks and block groups with all four lacings, and cues; a packet is a track, a timestamp and a byte
range of the file. The writer stores payloads losslessly as 8-bit PCM audio: equal texts, equal files.

A null text counts as empty and is stored as one frame of blanks. A very long text takes many clusters.
Null media have no packets. Damaged media give the packets before the damage. Repeated rows are
converted each, an empty table gives none, and columns beyond the id and the text or media are ignored.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Element ids of the public format (fixed values).
EBML, EBML_VERSION, EBML_READ, EBML_MAX_ID, EBML_MAX_SIZE, DOC_TYPE, DOC_VERSION, DOC_READ = 0x1A45DFA3, 0x4286, 0x42F7, 0x42F2, 0x42F3, 0x4282, 0x4287, 0x4285
SEGMENT, INFO, SCALE, DURATION, MUXER, WRITER = 0x18538067, 0x1549A966, 0x2AD7B1, 0x4489, 0x4D80, 0x5741
TRACKS, ENTRY, TRACK_NUMBER, TRACK_UID, TRACK_TYPE, CODEC, AUDIO, RATE, CHANNELS, DEPTH, LACING = 0x1654AE6B, 0xAE, 0xD7, 0x73C5, 0x83, 0x86, 0xE1, 0xB5, 0x9F, 0x6264, 0x9C
CLUSTER, CLUSTER_TIME, SIMPLE, GROUP, BLOCK = 0x1F43B675, 0xE7, 0xA3, 0xA0, 0xA1
CUES, CUE, CUE_TIME, CUE_AT, CUE_TRACK, CUE_CLUSTER = 0x1C53BB6B, 0xBB, 0xB3, 0xB7, 0xF7, 0xF1
TOP = {CLUSTER, CUES, INFO, TRACKS, 0x114D9B74, 0x1043A770, 0x1254C367, 0x1941A469}
MASTERS = {SEGMENT, INFO, TRACKS, ENTRY, AUDIO, CLUSTER, GROUP, CUES, CUE, CUE_AT, EBML}

UNIT, FRAME, LACE, BLOCKS, HERTZ = 192, 1536, 8, 20, 8000


# -- writing ---------------------------------------------------------------------------------


def _size(n: int) -> bytes:
    k = 1
    while n >= (1 << (7 * k)) - 1:
        k += 1
    return ((1 << (7 * k)) | n).to_bytes(k, "big")


def element(ident: int, body: bytes) -> bytes:
    return ident.to_bytes((ident.bit_length() + 7) // 8, "big") + _size(len(body)) + body


def _uint(ident: int, n: int) -> bytes:
    return element(ident, n.to_bytes(max(1, (n.bit_length() + 7) // 8), "big"))


def _float(ident: int, x: float) -> bytes:
    return element(ident, struct.pack(">d", x))


def _signed_size(n: int) -> bytes:
    k = 1
    while not -(1 << (7 * k - 1)) < n < (1 << (7 * k - 1)):
        k += 1
    return ((1 << (7 * k)) | (n + (1 << (7 * k - 1)) - 1)).to_bytes(k, "big")


def block(track: int, time: int, frames: list[bytes], lacing: str | None = None) -> bytes:
    """A simple block's body; of equal frames laced fixed, of others by EBML sizes, unless ``lacing`` says which."""
    if lacing is None:
        lacing = "none" if len(frames) == 1 else "fixed" if len({len(f) for f in frames}) == 1 else "ebml"
    head = _size(track) + struct.pack(">hB", time, 0x80 | {"none": 0, "xiph": 2, "fixed": 4, "ebml": 6}[lacing])
    if lacing != "none":
        head += bytes([len(frames) - 1])
    if lacing == "xiph":
        head += b"".join(b"\xff" * (len(f) // 255) + bytes([len(f) % 255]) for f in frames[:-1])
    elif lacing == "ebml":
        head += _size(len(frames[0])) + b"".join(_signed_size(len(b) - len(a)) for a, b in zip(frames[:-2], frames[1:-1], strict=True))
    return head + b"".join(frames)


_HEAD = element(
    EBML, _uint(EBML_VERSION, 1) + _uint(EBML_READ, 1) + _uint(EBML_MAX_ID, 4) + _uint(EBML_MAX_SIZE, 8) + element(DOC_TYPE, b"matroska") + _uint(DOC_VERSION, 4) + _uint(DOC_READ, 2)
)
_TRACK = element(
    TRACKS,
    element(
        ENTRY,
        _uint(TRACK_NUMBER, 1) + _uint(TRACK_UID, 1) + _uint(TRACK_TYPE, 2) + _uint(LACING, 1) + element(CODEC, b"A_PCM/INT/LIT") + element(AUDIO, _float(RATE, HERTZ) + _uint(CHANNELS, 1) + _uint(DEPTH, 8)),
    ),
)


def pad(data: bytes) -> bytes:
    """``data`` followed by blanks up to a positive multiple of the unit."""
    return data + b" " * (-len(data) % UNIT or (0 if data else UNIT))


def write(payload: bytes) -> bytes:
    """A Matroska file of one 8-bit PCM track that holds ``payload``."""
    info = element(INFO, _uint(SCALE, 1_000_000) + _float(DURATION, len(payload) * 1000 / HERTZ) + element(MUXER, b"arbiter") + element(WRITER, b"arbiter"))
    parts, cues, at = [info, _TRACK], [], len(info) + len(_TRACK)
    for first in range(0, len(payload), FRAME * LACE * BLOCKS):
        time, body = first * 1000 // HERTZ, b""
        blocks = [_uint(CLUSTER_TIME, time)]
        for begin in range(first, min(first + FRAME * LACE * BLOCKS, len(payload)), FRAME * LACE):
            frames = [payload[k : k + FRAME] for k in range(begin, min(begin + FRAME * LACE, len(payload)), FRAME)]
            blocks.append(element(SIMPLE, block(1, begin * 1000 // HERTZ - time, frames)))
        body = element(CLUSTER, b"".join(blocks))
        cues.append(element(CUE, _uint(CUE_TIME, time) + element(CUE_AT, _uint(CUE_TRACK, 1) + _uint(CUE_CLUSTER, at))))
        parts.append(body)
        at += len(body)
    return _HEAD + element(SEGMENT, b"".join([*parts, element(CUES, b"".join(cues))]))


# -- parsing ---------------------------------------------------------------------------------


class Packet(NamedTuple):
    track: int
    timestamp: int
    offset: int
    length: int
    keyframe: bool


class Media(NamedTuple):
    packets: list[Packet]
    cues: list[tuple[int, int, int]]  # time, track, offset of the cluster in the file
    clusters: list[int]
    tracks: list[dict]
    scale: int
    duration: float


def _vint(data: bytes, at: int, keep: bool = False) -> tuple[int, int, bool]:
    """Value, place after it, and whether all its bits are set."""
    first = data[at]
    k = 9 - first.bit_length()
    if k > 8 or at + k > len(data):
        raise ValueError("no such size")
    n = int.from_bytes(data[at : at + k], "big")
    value = n & ((1 << (7 * k)) - 1)
    return (n if keep else value), at + k, value == (1 << (7 * k)) - 1


def _frames(data: bytes, at: int, end: int, lacing: int) -> list[tuple[int, int]]:
    if not lacing:
        return [(at, end - at)]
    n, at = data[at] + 1, at + 1
    sizes: list[int] = []
    if lacing == 4:
        if (end - at) % n:
            raise ValueError("uneven fixed lacing")
        sizes = [(end - at) // n] * n
    elif lacing == 2:
        for _ in range(n - 1):
            size = 0
            while data[at] == 255:
                size, at = size + 255, at + 1
            sizes, at = [*sizes, size + data[at]], at + 1
    else:
        for k in range(n - 1):
            value, to, _ = _vint(data, at)
            sizes.append(value if k == 0 else sizes[-1] + value - ((1 << (7 * (to - at) - 1)) - 1))
            at = to
    if lacing != 4:
        sizes.append(end - at - sum(sizes))
    if min(sizes) < 0:
        raise ValueError("lacing beyond the block")
    out = []
    for size in sizes:
        out.append((at, size))
        at += size
    return out


def parse(data: bytes) -> Media:
    """Packets, cues, cluster offsets and tracks of a file; what follows damage is left out."""
    packets: list[Packet] = []
    cues, clusters, tracks = [], [], []
    state = {"time": 0, "scale": 1_000_000, "duration": 0.0, "segment": 0, "cue": {}, "durations": {}}

    def number(at: int, end: int) -> int:
        return int.from_bytes(data[at:end], "big")

    def leaf(ident: int, at: int, end: int, key: bool | None) -> None:
        if ident == CLUSTER_TIME:
            state["time"] = number(at, end)
        elif ident in (SIMPLE, BLOCK):
            track, to, _ = _vint(data, at)
            time, flags = struct.unpack_from(">hB", data, to)
            frames = _frames(data, to + 3, end, flags & 6)
            # Laced frames have one timestamp in the file; PCM tells how long each lasts.
            lasts = state["durations"].get(track)
            t = state["time"] + time
            for begin, size in frames:
                packets.append(Packet(track, t, begin, size, bool(flags & 0x80) if ident == SIMPLE else bool(key)))
                if lasts:
                    t += size * 1000 // lasts
        elif ident == SCALE:
            state["scale"] = number(at, end)
        elif ident == DURATION:
            state["duration"] = struct.unpack(">d" if end - at == 8 else ">f", data[at:end])[0]
        elif ident in (TRACK_NUMBER, TRACK_TYPE, CHANNELS, DEPTH) and tracks:
            tracks[-1][{TRACK_NUMBER: "number", TRACK_TYPE: "type", CHANNELS: "channels", DEPTH: "depth"}[ident]] = number(at, end)
        elif ident == CODEC and tracks:
            tracks[-1]["codec"] = data[at:end].decode("ascii", "replace")
        elif ident == RATE and tracks:
            tracks[-1]["rate"] = struct.unpack(">d" if end - at == 8 else ">f", data[at:end])[0]
        elif ident in (CUE_TIME, CUE_TRACK, CUE_CLUSTER):
            state["cue"][ident] = number(at, end)
            if ident == CUE_CLUSTER:
                cues.append((state["cue"].get(CUE_TIME, 0), state["cue"].get(CUE_TRACK, 0), number(at, end) + state["segment"]))

    def walk(at: int, end: int, within: int) -> int:
        while at < end:
            begin = at
            ident, at, _ = _vint(data, at, keep=True)
            if within == CLUSTER and ident in TOP:
                return begin  # the end of a cluster of unknown size
            size, at, unknown = _vint(data, at)
            to = end if unknown else at + size
            if ident == SEGMENT:
                state["segment"] = at
            elif ident == CLUSTER:
                clusters.append(begin)
            elif ident == ENTRY:
                tracks.append({})
            if ident in MASTERS:
                at = walk(at, min(to, end), ident)
                if ident == ENTRY and tracks[-1].get("depth") and tracks[-1].get("rate"):
                    t = tracks[-1]
                    state["durations"][t.get("number", 0)] = t["rate"] * t.get("channels", 1) * t["depth"] / 8
                if not unknown:
                    at = to
            elif to > end:
                raise ValueError("element beyond its parent")
            else:
                leaf(ident, at, to, within == GROUP)
                at = to
        return at

    try:
        walk(0, len(data), 0)
    except (ValueError, IndexError, struct.error):
        pass
    return Media(packets, cues, clusters, tracks, state["scale"], state["duration"])


def payload(data: bytes, media: Media, track: int = 1) -> bytes:
    return b"".join(data[p.offset : p.offset + p.length] for p in media.packets if p.track == track)


def feature(data: bytes, media: Media) -> str:
    """A short description: packets, clusters, cues that point at clusters, milliseconds, and the samples' mean, spread and turns."""
    x = np.frombuffer(payload(data, media), np.uint8)
    at = set(media.clusters)
    turns = int(np.count_nonzero(np.diff((x >= 128).astype(np.int8)))) if len(x) else 0
    mean = int(x.sum(dtype=np.int64)) / max(len(x), 1)
    spread = (int((x.astype(np.int64) ** 2).sum()) / max(len(x), 1) - mean**2) ** 0.5
    return f"packets={len(media.packets)} clusters={len(media.clusters)} cues={sum(c[2] in at for c in media.cues)} ms={media.duration:.0f} mean={mean:.3f} spread={spread:.3f} turns={turns}"


# -- columns ---------------------------------------------------------------------------------


def _of(batch: pa.RecordBatch, column: int) -> list[bytes]:
    from .common import binary_texts

    return binary_texts(batch.column(column))


def write_column(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, media``: every row's padded text as a Matroska file."""

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                yield pa.record_batch([part.column(0), pa.array([write(pad(t)) for t in _of(part, 1)], pa.binary())], names=["doc_id", "media"])

    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, media binary")


def packet_table(media: DataFrame, id_col: str = "doc_id", media_col: str = "media") -> DataFrame:
    """One row per packet: ``doc_id, packet, track, timestamp, offset, length, keyframe``."""
    kind = pa.struct([("packet", pa.int64()), ("track", pa.int64()), ("timestamp", pa.int64()), ("offset", pa.int64()), ("length", pa.int64()), ("keyframe", pa.bool_())])

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                rows = [[{"packet": k, **p._asdict()} for k, p in enumerate(parse(m).packets)] for m in _of(part, 1)]
                yield pa.record_batch([part.column(0), pa.array(rows, pa.list_(kind))], names=["doc_id", "packets"])

    found = media.select(F.col(id_col).alias("doc_id"), F.col(media_col).alias("media"))
    found = found.mapInArrow(run, "doc_id long, packets array<struct<packet long, track long, timestamp long, offset long, length long, keyframe boolean>>")
    return found.select("doc_id", F.explode("packets").alias("p")).select("doc_id", "p.*")


def media_digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every row's text stored, read back through its packet table, and described."""
    names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                rows = []
                for doc, text in zip(part.column(0).to_pylist(), _of(part, 1), strict=True):
                    data = write(pad(text))
                    media = parse(data)
                    back = payload(data, media)
                    rows.append((doc, len(text), len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-16:]), len(data), hashlib.sha256(data).hexdigest(), feature(data, media)))
                kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
                if rows:
                    yield pa.record_batch([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    out = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, out)
