"""Harmonic packing of token sequences.

A bin holds `capacity` tokens. Class j takes the lengths in (capacity/(j+1), capacity/j] and
fills each of its bins with exactly j pieces, so a piece's bin follows from its rank in its
class alone: workers count their own pieces, a prefix sum over the (task, class) counts turns
local ranks into global ones, and no worker waits for another's bins. Because texts may be
cut, a length that would leave much of its slot empty is cut at the next class's full slot
first, and only the rest is classed again.

What is left of each class (fewer than j pieces, so under sum(CLASSES) pieces over all classes
at any input size) is put first-fit-decreasing into shared bins.

Defined results: a null or empty text is the end token alone; a null id stays null; repeated
rows are packed each on their own; an empty table gives no pieces; other columns are ignored.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tideglass.llm.common import cut

#: Pieces a bin of each class holds.
CLASSES = (*range(1, 25), 28, 32, 40, 48, 64, 80, 96, 128, 256, 512)
#: A slot may stay empty by this many tokens before the piece is cut once more.
SLACK = 8
MOST_CUTS = 4
SPECIAL = "<|endoftext|>"


@lru_cache(maxsize=4)
def plan(capacity: int) -> tuple[tuple[tuple[int, int], ...], ...]:
    """For each length below capacity: its pieces as (length, class)."""
    classes = [j for j in CLASSES if j <= capacity]
    plans = [()]
    for length in range(1, capacity):
        pieces, rest = [], length
        while rest:
            j = max(c for c in classes if c * rest <= capacity)
            nxt = next((c for c in classes if c > j), None)
            if nxt is None or capacity / j - rest <= SLACK or len(pieces) + 1 >= MOST_CUTS:
                pieces.append((rest, j))
                break
            slot = capacity // nxt
            if slot >= rest:
                pieces.append((rest, nxt))
                break
            pieces.append((slot, nxt))
            rest -= slot
        plans.append(tuple(pieces))
    return tuple(plans)


@lru_cache(maxsize=2)
def encoder(json_path: str, ranks_path: str | None):
    """A function from text to uint32 ids. The rank file of the same vocabulary is faster and gives
    the same ids; a text with the special token's own string goes through the tokenizer file."""
    from tokenizers import Tokenizer

    full = Tokenizer.from_file(json_path)

    def slow(text: str) -> np.ndarray:
        return np.array(full.encode(text, add_special_tokens=False).ids, dtype=np.uint32)

    if ranks_path is None:
        return slow
    import base64

    import public_tokenizers
    import tiktoken

    with open(ranks_path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    quick = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

    def fast(text: str) -> np.ndarray:
        return slow(text) if SPECIAL in text else np.array(quick.encode_ordinary(text), dtype=np.uint32)

    return fast


def token_pieces(docs: DataFrame, json_path: str, ranks_path: str | None = None, id_col: str = "doc_id", text_col: str = "text", capacity: int = 2048, end_id: int = 1, with_ids: bool = False) -> DataFrame:
    """One row per piece with its class and its rank among the task's pieces of that class."""
    source = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    key = source.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {key}, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, part int, class int, nth bigint" + (", ids array<int>" if with_ids else "")

    def run(batches):
        from zlib import crc32

        from pyspark import TaskContext

        encode, plans, part = encoder(json_path, ranks_path), plan(capacity), TaskContext.get().partitionId()
        seen: dict[int, int] = {}
        end = np.array([end_id], dtype=np.uint32)
        for batch in batches:
            ids_of = batch.column(0)
            rows, starts, lengths, sums, totals, classes, nths, tokens = [], [], [], [], [], [], [], []
            for i, text in enumerate(batch.column(1)):
                ids = np.concatenate([encode(text.as_py()), end])
                n, at = len(ids), 0
                cuts = [(capacity, 1)] * (n // capacity) + list(plans[n % capacity])
                for length, j in cuts:
                    piece = ids[at : at + length]
                    rows.append(i)
                    starts.append(at)
                    lengths.append(length)
                    sums.append(crc32(piece.astype("<u4", copy=False).tobytes()))
                    totals.append(n)
                    classes.append(j)
                    nths.append(seen.get(j, 0))
                    seen[j] = nths[-1] + 1
                    at += length
                    if with_ids:
                        tokens.append(piece.astype(np.int32))
            columns = [ids_of.take(pa.array(rows, pa.int64())), *(pa.array(x, pa.int64()) for x in (starts, lengths, sums, totals)), pa.array([part] * len(rows), pa.int32()), pa.array(classes, pa.int32()), pa.array(nths, pa.int64())]
            names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "part", "class", "nth"]
            if with_ids:
                columns.append(pa.array(tokens, pa.list_(pa.int32())))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return source.mapInArrow(run, schema)


def harmonic_pack(pieces: DataFrame, capacity: int = 2048) -> DataFrame:
    """Give each piece (length, class, part, nth) its sequence_id and its offset there.

    `pieces` must be stable (written), since its local ranks are read twice."""
    by_class = Window.partitionBy("class")
    counts = pieces.groupBy("class", "part").agg(F.count(F.lit(1)).alias("n"))
    counts = counts.select(
        "class", "part",
        (F.sum("n").over(by_class.orderBy("part").rowsBetween(Window.unboundedPreceding, 0)) - F.col("n")).alias("before"),
        F.sum("n").over(by_class).alias("total"),
    )
    # one row per class: the first sequence of each class, and of the shared bins after all of them
    full = pieces.groupBy("class").agg(F.count(F.lit(1)).alias("total")).select("class", F.floor(F.col("total") / F.col("class")).alias("bins"))
    first = full.select("class", (F.sum("bins").over(Window.orderBy("class").rowsBetween(Window.unboundedPreceding, 0)) - F.col("bins")).alias("first"), F.sum("bins").over(Window.partitionBy()).alias("bins_all"))
    ranked = (
        pieces.join(counts.join(F.broadcast(first), "class"), ["class", "part"])
        .withColumn("rank", F.col("nth") + F.col("before"))
        .withColumn("bin", F.floor(F.col("rank") / F.col("class")))
        .withColumn("whole", F.col("bin") < F.floor(F.col("total") / F.col("class")))
    )
    keep = [c for c in pieces.columns if c not in ("part", "class", "nth")]
    packed = ranked.where("whole").select(*keep, (F.col("first") + F.col("bin")).alias("sequence_id"), "rank")
    out_schema = packed.schema

    def shared(pdf):
        pdf = pdf.sort_values(["length", "class", "rank"], ascending=[False, True, True], kind="stable").reset_index(drop=True)
        room: list[int] = []
        seq = []
        for length in pdf["length"]:
            at = next((i for i, r in enumerate(room) if r >= length), len(room))
            if at == len(room):
                room.append(capacity)
            room[at] -= length
            seq.append(at)
        pdf["sequence_id"] = pdf["bins_all"] + seq
        pdf["rank"] = range(len(pdf))
        return pdf[[f.name for f in out_schema]]

    rest = ranked.where(~F.col("whole")).select(*keep, "class", "rank", "bins_all", F.lit(0).alias("one"))
    rest = rest.groupBy("one").applyInPandas(shared, out_schema)  # under sum(CLASSES) rows at any size
    inside = Window.partitionBy("sequence_id").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    return packed.unionByName(rest).withColumn("offset", F.sum("length").over(inside) - F.col("length")).drop("rank")


def pack_documents(docs: DataFrame, json_path: str, ranks_path: str | None = None, id_col: str = "doc_id", text_col: str = "text", capacity: int = 2048, end_id: int = 1, with_ids: bool = False) -> DataFrame:
    """Tokenize whole texts and pack them: one row per piece, see the module's notes."""
    pieces = cut(token_pieces(docs, json_path, ranks_path, id_col, text_col, capacity, end_id, with_ids), "pieces")
    return harmonic_pack(pieces, capacity)
