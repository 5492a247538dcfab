import hashlib
import zlib

import odd
import pytest

from tideglass.llm import matroska as mk


def test_round_trip():
    for frames in (1, 2, 7, 8, 9, 1023, 1024, 1025, 3000):
        data = bytes(i * 31 % 256 for i in range(frames * mk.FRAME))
        p = mk.parse(media := mk.write_audio(data))
        q = p["packets"]
        assert p["error"] is None and len(q["track"]) == frames and p["clusters"] == -(-frames // 1024)
        assert b"".join(media[o : o + n] for o, n in zip(q["offset"], q["size"])) == data
        assert q["timestamp_ns"] == [i * 24_000_000 for i in range(frames)]
        assert p["duration_ns"] == frames * 24_000_000 and p["tracks"][0]["codec"] == "A_PCM/INT/LIT"
        for cue in p["cues"]:
            assert mk.number(media[cue["position"] : cue["position"] + 4]) == mk.CLUSTER


def block(mode, frames, track=1, time=0, group=False):
    head = bytes([0x80 | track]) + time.to_bytes(2, "big", signed=True) + bytes([mode << 1 | (0 if group else 0x80)])
    if mode == 1:
        head += bytes([len(frames) - 1]) + b"".join(b"\xff" * (len(f) // 255) + bytes([len(f) % 255]) for f in frames[:-1])
    elif mode == 2:
        head += bytes([len(frames) - 1])
    elif mode == 3:
        head += bytes([len(frames) - 1]) + mk.size_bytes(len(frames[0]))
        for a, b in zip(frames, frames[1:-1]):
            head += ((b := len(b) - len(a)) + 8191 | 1 << 14).to_bytes(2, "big")
    return head + b"".join(frames)


@pytest.mark.parametrize("mode,sizes", [(0, [5]), (1, [300, 255, 10, 0, 7]), (2, [9, 9, 9]), (3, [800, 500, 1000, 3])])
def test_lacing_and_unknown_sizes(mode, sizes):
    frames = [bytes([i + 1]) * n for i, n in enumerate(sizes)]
    tracks = mk.element(mk.TRACKS, mk.element(mk.TRACK, mk.uint(mk.NUMBER, 1) + mk.element(mk.CODEC, b"A_X")))
    group = mk.element(mk.GROUP, mk.element(mk.BLOCK, block(mode, frames, time=-3, group=True)) + mk.element(mk.REFERENCE, b"\xff"))
    cluster = mk.CLUSTER.to_bytes(4, "big") + b"\x01" + b"\xff" * 7 + mk.uint(mk.TIME, 1000) + mk.element(mk.SIMPLE, block(mode, frames, time=5)) + mk.element(0xEC, b"void") + group
    media = mk.HEADER + mk.SEGMENT.to_bytes(4, "big") + b"\x01" + b"\xff" * 7 + tracks + cluster + cluster
    p = mk.parse(media)
    q = p["packets"]
    assert p["error"] is None and p["clusters"] == 2 and len(q["track"]) == 4 * len(sizes)
    assert [media[o : o + n] for o, n in zip(q["offset"], q["size"])] == frames * 4
    assert q["timestamp_ns"][0] == 1_005_000_000 and q["timestamp_ns"][len(sizes)] == 997_000_000
    assert q["keyframe"][: len(sizes)] == [True] * len(sizes) and q["keyframe"][len(sizes) : 2 * len(sizes)] == [False] * len(sizes)


def test_broken_bytes_do_not_raise():
    media = mk.write_audio(b"a" * mk.FRAME * 20)
    assert mk.parse(None)["error"] == mk.parse(b"")["error"] == "empty" and mk.parse(b"nonsense")["error"]
    for cut in range(0, len(media), 37):
        p = mk.parse(media[:cut])
        assert p["error"] or cut == 0
        mk.parse(media[:cut] + b"\x00" * 9 + media[cut + 9 :])


def test_odd_rows(spark):
    rows = mk.read_media(mk.text_to_media(odd.odd_documents(spark))).collect()
    got = sorted((r["doc_id"] or -1, r["n_bytes"], hashlib.sha256(r["payload"]).hexdigest(), r["n_packets"], len(r["packets"])) for r in rows)
    want = []
    for i, t, *_ in odd.texts():
        raw = (t or "").encode()
        full = raw + b" " * (-len(raw) % 192 or (0 if raw else 192))
        want.append((i or -1, len(raw), hashlib.sha256(full).hexdigest(), len(full) // 192, len(full) // 192))
    assert got == sorted(want)
    assert mk.read_media(mk.text_to_media(odd.empty_documents(spark))).count() == 0


def test_packet_table(spark):
    files = spark.createDataFrame([(1, mk.write_audio(b"x" * 192 * 3), "k"), (2, b"junk", "k"), (3, None, "k")], "id long, media binary, payload string")
    rows = mk.packet_table(files).orderBy("id", "packet").collect()
    assert [(r["id"], r["packet"], r["size"]) for r in rows] == [(1, 0, 192), (1, 1, 192), (1, 2, 192)]
    assert [bool(r["media_error"]) for r in mk.read_media(files).orderBy("id").collect()] == [False, True, True]


def test_query_digests(spark, sf):
    from tideglass.llm.queries import op4_matroska

    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    for r in op4_matroska(spark, sf).collect():
        raw = texts[r["doc_id"]].encode()
        full = raw + b" " * (-len(raw) % 192 or (0 if raw else 192))
        assert (r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(full), hashlib.sha256(full).hexdigest(), zlib.crc32(full[-16:]))


def test_clashing_names(spark):
    from pyspark.sql import functions as F

    files = mk.text_to_media(odd.odd_documents(spark)).withColumn("codec", F.lit("mine")).withColumn("packets", F.lit(7)).withColumn("track", F.lit("t"))
    read = mk.read_media(files)
    assert read.columns[: len(files.columns)] == files.columns and {"codec_", "packets_"} <= set(read.columns)
    assert {(r["codec"], r["packets"], r["codec_"]) for r in read.collect()} == {("mine", 7, "A_PCM/INT/LIT")}
    rows = mk.packet_table(files).collect()
    assert rows and all(r["packets"] == 7 and r["track"] == "t" and r["track_"] == 1 for r in rows)
