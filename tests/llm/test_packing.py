from collections import defaultdict
from zlib import crc32

import numpy as np
import odd
import public_tokenizers
from tokenizers import Tokenizer

from tideglass.llm import packing

JSON, RANKS = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken")


def test_plans_cover_every_length():
    for capacity in (2048, 64, 1):
        for length, pieces in enumerate(packing.plan(capacity)):
            assert sum(n for n, _ in pieces) == length and len(pieces) <= packing.MOST_CUTS
            assert all(n * j <= capacity for n, j in pieces)


def check(rows, texts, capacity=2048):
    tok = Tokenizer.from_file(JSON)
    want = defaultdict(int)
    for i, t in texts:
        want[(i, tuple(tok.encode(t or "", add_special_tokens=False).ids + [1]))] += 1
    bins = defaultdict(list)
    sums = defaultdict(int)
    for r in rows:
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
        sums[(r["doc_id"], r["start"], r["length"], r["ids_crc32"], r["doc_tokens"])] += 1
    for pieces in bins.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at and length > 0
            at += length
        assert at <= capacity
    expected = defaultdict(int)
    for (i, ids), n in want.items():
        cuts, at = [(capacity, 1)] * (len(ids) // capacity) + list(packing.plan(capacity)[len(ids) % capacity]), 0
        for length, _ in cuts:
            expected[(i, at, length, crc32(np.array(ids[at : at + length], "<u4").tobytes()), len(ids))] += n
            at += length
    assert sums == expected
    return bins


def test_odd_rows(spark):
    texts = [r[:2] for r in odd.texts()]
    check(packing.pack_documents(odd.odd_documents(spark), JSON, RANKS).collect(), texts)
    special = [(1, "a <|endoftext|> b"), (2, None)]
    check(packing.pack_documents(odd.documents(spark, special), JSON, RANKS).collect(), special)
    assert packing.pack_documents(odd.empty_documents(spark), JSON, RANKS).count() == 0


def test_padding_is_small(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    texts = [(r["doc_id"], r["text"]) for r in docs.collect()]
    bins = check(packing.pack_documents(docs.repartition(5), JSON, RANKS).collect(), texts)
    used = sum(n for pieces in bins.values() for _, n in pieces)
    assert used / (len(bins) * 2048) > 0.97


def test_ids_are_given_where_asked(spark):
    rows = packing.pack_documents(odd.documents(spark, [(1, "hello there")]), JSON, RANKS, with_ids=True).collect()
    assert sum((r["ids"] for r in sorted(rows, key=lambda r: r["start"])), []) == Tokenizer.from_file(JSON).encode("hello there", add_special_tokens=False).ids + [1]
