"""Matroska files in binary columns: a parser to packet tables, and a writer for 8-bit audio.

The parser walks the variable-length EBML elements front to back and enters the master elements
instead of cutting them out, so a Segment or Cluster of unknown size needs no special path. Each
SimpleBlock or BlockGroup gives one packet per laced frame (none, Xiph, EBML and fixed lacing),
with its track, cluster, timestamp, byte offset and size in the file; cue points are kept beside
them.

Defined results: null or empty bytes give no packets and error 'empty'; bytes that are not EBML or
end inside an element give the packets read so far and an error that says where; nothing raises.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideglass.llm.common import free_names

# Element ids of the EBML and Matroska specifications.
EBML, SEGMENT, INFO, TRACKS, TRACK, AUDIO, VIDEO, CLUSTER, GROUP, CUES, CUE, CUE_AT = 0x1A45DFA3, 0x18538067, 0x1549A966, 0x1654AE6B, 0xAE, 0xE1, 0xE0, 0x1F43B675, 0xA0, 0x1C53BB6B, 0xBB, 0xB7
EBML_VERSION, EBML_READ_VERSION, EBML_MAX_ID, EBML_MAX_SIZE, DOC_TYPE, DOC_VERSION, DOC_READ_VERSION = 0x4286, 0x42F7, 0x42F2, 0x42F3, 0x4282, 0x4287, 0x4285
SCALE, DURATION, MUXER, WRITER = 0x2AD7B1, 0x4489, 0x4D80, 0x5741
NUMBER, UID, KIND, CODEC, DEFAULT_NS, RATE, CHANNELS, DEPTH = 0xD7, 0x73C5, 0x83, 0x86, 0x23E383, 0xB5, 0x9F, 0x6264
TIME, SIMPLE, BLOCK, BLOCK_NS, REFERENCE = 0xE7, 0xA3, 0xA1, 0x9B, 0xFB
CUE_TIME, CUE_TRACK, CUE_CLUSTER = 0xB3, 0xF7, 0xF1
MASTERS = frozenset((SEGMENT, INFO, TRACKS, TRACK, AUDIO, VIDEO, CLUSTER, GROUP, CUES, CUE, CUE_AT))
LACINGS = ("none", "xiph", "fixed", "ebml")

FRAME, RATE_HZ = 192, 8000  # 192 samples of 8 bits are 24 ms
LACED, CLUSTER_FRAMES = 8, 1024


def number(data) -> int:
    return int.from_bytes(data, "big")


def read_size(buf, at: int) -> tuple[int | None, int]:
    """A variable-length size at `at`: its value (None: unknown) and the position after it."""
    first = buf[at]
    if not first:
        raise ValueError(f"size of over 8 bytes at {at}")
    width = 9 - first.bit_length()
    if at + width > len(buf):
        raise ValueError(f"cut off in a size at {at}")
    value = number(buf[at : at + width]) & ((1 << 7 * width) - 1)
    return (None if value == (1 << 7 * width) - 1 else value), at + width


def lace(buf, at: int, end: int, mode: int) -> list[tuple[int, int]]:
    """The (offset, size) of each frame of a block whose header ends at `at`."""
    if not mode:
        return [(at, end - at)]
    count, at = buf[at] + 1, at + 1
    if mode == 2:
        size, rest = divmod(end - at, count)
        if rest:
            raise ValueError(f"fixed lacing does not divide the block at {at}")
        return [(at + i * size, size) for i in range(count)]
    sizes: list[int] = []
    for i in range(count - 1):
        if mode == 1:
            size = 0
            while True:
                byte, at = buf[at], at + 1
                size += byte
                if byte < 255:
                    break
        else:
            start = at
            value, at = read_size(buf, at)
            if value is None:
                raise ValueError(f"no lace size at {start}")
            size = value if i == 0 else sizes[-1] + value - ((1 << (7 * (at - start) - 1)) - 1)
        if size < 0:
            raise ValueError(f"negative lace size at {at}")
        sizes.append(size)
    sizes.append(end - at - sum(sizes))
    if sizes[-1] < 0:
        raise ValueError(f"laces pass the end of the block at {at}")
    found = []
    for size in sizes:
        found.append((at, size))
        at += size
    return found


def parse(buf: bytes | None) -> dict:
    """Packets (as columns), tracks, cues, timing and the first error of one file."""
    out = {"scale_ns": 1_000_000, "duration_ns": None, "tracks": [], "cues": [], "clusters": 0, "error": None}
    packets: dict[str, list] = {k: [] for k in ("track", "cluster", "timestamp_ns", "keyframe", "lacing", "lace", "offset", "size")}
    out["packets"] = packets
    if not buf:
        out["error"] = "empty"
        return out
    at, total = 0, len(buf)
    track: dict = {}
    base = duration = segment = 0
    default_ns: dict[int, int] = {}
    group_rows: list[int] = []
    in_group_until = -1
    try:
        if number(buf[:4]) != EBML:
            raise ValueError("no EBML header")
        while at < total:
            start, first = at, buf[at]
            width = 9 - first.bit_length() if first else 9
            if width > 4 or at + width >= total:
                raise ValueError(f"no element at {at}")
            kind = number(buf[at : at + width])
            size, at = read_size(buf, at + width)
            if kind in MASTERS:
                if size is not None and at + size > total:
                    raise ValueError(f"element {kind:X} at {start} passes the end")
                if kind == SEGMENT:
                    segment = at
                elif kind == TRACK:
                    out["tracks"].append(track := {"number": None, "codec": None, "rate": None, "channels": 1, "depth": None})
                elif kind == CLUSTER:
                    base, out["clusters"] = 0, out["clusters"] + 1
                elif kind == GROUP:
                    group_rows, in_group_until = [], at + (size or 0)
                elif kind == CUE:
                    out["cues"].append({"time": None, "track": None, "position": None})
                continue
            if size is None or at + size > total:
                raise ValueError(f"element {kind:X} at {start} passes the end")
            end = at + size
            if kind in (SIMPLE, BLOCK):
                who, head = read_size(buf, at)
                offset = int.from_bytes(buf[head : head + 2], "big", signed=True)
                flags, mode = buf[head + 2], buf[head + 2] >> 1 & 3
                key = bool(flags & 0x80) if kind == SIMPLE else True
                ns = (base + offset) * out["scale_ns"]
                step = default_ns.get(who, 0)
                group_rows = []
                for i, (o, n) in enumerate(lace(buf, head + 3, end, mode)):
                    group_rows.append(len(packets["track"]))
                    for k, v in zip(packets, (who, out["clusters"] - 1, ns + i * step, key, mode, i, o, n), strict=True):
                        packets[k].append(v)
            elif kind == REFERENCE and start < in_group_until:
                for i in group_rows:
                    packets["keyframe"][i] = False
            elif kind == TIME:
                base = number(buf[at:end])
            elif kind == SCALE:
                out["scale_ns"] = number(buf[at:end])
            elif kind == DURATION:
                duration = float(np.frombuffer(bytes(buf[at:end]), ">f8" if size == 8 else ">f4")[0])
            elif kind == NUMBER:
                track["number"] = number(buf[at:end])
            elif kind == DEFAULT_NS:
                track["default_ns"] = number(buf[at:end])
                default_ns[track.get("number")] = track["default_ns"]
            elif kind == CODEC:
                track["codec"] = bytes(buf[at:end]).rstrip(b"\0").decode("ascii", "replace")
            elif kind == RATE:
                track["rate"] = float(np.frombuffer(bytes(buf[at:end]), ">f8" if size == 8 else ">f4")[0])
            elif kind == CHANNELS:
                track["channels"] = number(buf[at:end])
            elif kind == DEPTH:
                track["depth"] = number(buf[at:end])
            elif kind == CUE_TIME:
                out["cues"][-1]["time"] = number(buf[at:end])
            elif kind == CUE_TRACK:
                out["cues"][-1]["track"] = number(buf[at:end])
            elif kind == CUE_CLUSTER:
                out["cues"][-1]["position"] = segment + number(buf[at:end])
            at = end
    except (ValueError, IndexError, KeyError) as error:
        out["error"] = str(error)
    if duration:
        out["duration_ns"] = int(round(duration * out["scale_ns"]))
    return out


def size_bytes(n: int) -> bytes:
    width = 1
    while n >= (1 << 7 * width) - 1:
        width += 1
    return (n | 1 << 7 * width).to_bytes(width, "big")


def element(kind: int, data: bytes) -> bytes:
    return kind.to_bytes((kind.bit_length() + 7) // 8, "big") + size_bytes(len(data)) + data


def uint(kind: int, n: int) -> bytes:
    return element(kind, n.to_bytes(max(1, (n.bit_length() + 7) // 8), "big"))


def real(kind: int, x: float) -> bytes:
    return element(kind, np.array([x], ">f8").tobytes())


HEADER = element(EBML, uint(EBML_VERSION, 1) + uint(EBML_READ_VERSION, 1) + uint(EBML_MAX_ID, 4) + uint(EBML_MAX_SIZE, 8) + element(DOC_TYPE, b"matroska") + uint(DOC_VERSION, 4) + uint(DOC_READ_VERSION, 2))
FRAME_MS = FRAME * 1000 // RATE_HZ
TRACKS_ELEMENT = element(TRACKS, element(TRACK, uint(NUMBER, 1) + uint(UID, 1) + uint(KIND, 2) + uint(DEFAULT_NS, FRAME_MS * 1_000_000) + element(CODEC, b"A_PCM/INT/LIT") + element(AUDIO, real(RATE, RATE_HZ) + uint(CHANNELS, 1) + uint(DEPTH, 8))))


def write_audio(samples: bytes) -> bytes:
    """One mono track of 8-bit samples, whose length is a positive multiple of FRAME."""
    frames = len(samples) // FRAME
    body = [element(INFO, uint(SCALE, 1_000_000) + real(DURATION, frames * FRAME_MS) + element(MUXER, b"tideglass") + element(WRITER, b"tideglass")), TRACKS_ELEMENT]
    position, cues = sum(map(len, body)), []
    for c in range(0, frames, CLUSTER_FRAMES):
        blocks = [uint(TIME, c * FRAME_MS)]
        until = min(frames, c + CLUSTER_FRAMES)
        for f in range(c, until, LACED):
            n = min(LACED, until - f)
            head = b"\x81" + ((f - c) * FRAME_MS).to_bytes(2, "big") + (b"\x80" if n == 1 else b"\x84" + bytes((n - 1,)))
            blocks.append(element(SIMPLE, head + samples[f * FRAME : (f + n) * FRAME]))
        cues.append(element(CUE, uint(CUE_TIME, c * FRAME_MS) + element(CUE_AT, uint(CUE_TRACK, 1) + uint(CUE_CLUSTER, position))))
        body.append(element(CLUSTER, b"".join(blocks)))
        position += len(body[-1])
    body.append(element(CUES, b"".join(cues)))
    return HEADER + element(SEGMENT, b"".join(body))


def text_to_media(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each text's UTF-8, filled up with spaces to whole frames, as the samples of a Matroska file."""
    source = docs.select(F.col(id_col).alias("doc_id"), F.encode(F.coalesce(F.col(text_col).cast("string"), F.lit("")), "UTF-8").alias("raw"))

    def run(batches):
        for batch in batches:
            raw = batch.column(1).to_pylist()
            media = [write_audio(x + b" " * (-len(x) % FRAME or (0 if x else FRAME))) for x in raw]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(map(len, raw), pa.int64()), pa.array(media, pa.binary())], names=["doc_id", "n_bytes", "media"])

    return source.mapInArrow(run, f"doc_id {source.schema['doc_id'].dataType.simpleString()}, n_bytes bigint, media binary")


PACKET = "array<struct<track:bigint,cluster:bigint,timestamp_ns:bigint,keyframe:boolean,lacing:bigint,lace:bigint,offset:bigint,size:bigint>>"
RESULT = {
    "payload": "binary", "n_packets": "bigint", "n_clusters": "bigint", "n_cues": "bigint", "duration_ns": "bigint", "codec": "string",
    "level_sum": "bigint", "level_crossings": "bigint", "media_error": "string", "packets": PACKET,
}
PACKET_TYPES = {"keyframe": pa.bool_()}


def read_media(files: DataFrame, media_col: str = "media", with_packets: bool = True) -> DataFrame:
    """The columns of `files` with each file's packets, counts, the samples of its first track and their levels.

    A result column whose name `files` has already gets underscores behind it."""
    keep, source = files.columns, files
    own = list(RESULT.items())[: None if with_packets else -1]
    names = [*keep, *free_names(keep, [n for n, _ in own])]
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema), *(f"`{n}` {kind}" for n, (_, kind) in zip(names[len(keep) :], own, strict=True))])

    def run(batches):
        for batch in batches:
            # a column may be named twice in no frame that Spark accepts here, so the position is unique
            media = batch.column(keep.index(media_col))
            parsed, payloads, sums, crossings = [], [], [], []
            for x in media:
                buf = x.as_py()
                p = parse(buf)
                q = p["packets"]
                first = p["tracks"][0]["number"] if p["tracks"] else None
                payload = b"".join([buf[o : o + n] for t, o, n in zip(q["track"], q["offset"], q["size"], strict=True) if t == first])
                levels = np.frombuffer(payload, np.uint8)
                high = levels >= 128
                parsed.append(p)
                payloads.append(payload)
                sums.append(int(levels.sum(dtype=np.int64)))
                crossings.append(int(np.count_nonzero(high[1:] != high[:-1])))
            columns = [*batch.columns, pa.array(payloads, pa.binary())]
            columns += [pa.array(x, pa.int64()) for x in ([len(p["packets"]["track"]) for p in parsed], [p["clusters"] for p in parsed], [len(p["cues"]) for p in parsed], [p["duration_ns"] for p in parsed])]
            columns += [pa.array([p["tracks"][0]["codec"] if p["tracks"] else None for p in parsed], pa.string()), pa.array(sums, pa.int64()), pa.array(crossings, pa.int64()), pa.array([p["error"] for p in parsed], pa.string())]
            if with_packets:
                offsets = np.concatenate([[0], np.cumsum([len(p["packets"]["track"]) for p in parsed], dtype=np.int64)]).astype(np.int32)
                fields = list(parsed[0]["packets"]) if parsed else []
                values = [pa.array([v for p in parsed for v in p["packets"][k]], PACKET_TYPES.get(k, pa.int64())) for k in fields]
                columns.append(pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.StructArray.from_arrays(values, names=fields)))
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return source.mapInArrow(run, schema)


def packet_table(files: DataFrame, media_col: str = "media") -> DataFrame:
    """One row per packet, with the columns of `files` but for the bytes."""
    read = read_media(files, media_col)
    keep = [c for c in files.columns if c != media_col]
    fields = [f.split(":")[0] for f in PACKET[len("array<struct<") : -2].split(",")]
    at, *names = free_names(keep, ["packet", *fields])
    rows = read.select(F.struct(*(F.col(f"`{c}`") for c in keep)).alias("row"), F.posexplode(read.columns[-1]).alias("at", "p"))
    return rows.select("row.*", F.col("at").alias(at), *(F.col(f"p.{f}").alias(n) for f, n in zip(fields, names, strict=True)))
