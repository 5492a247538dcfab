"""Token counts of whole texts under a unigram model, by dynamic programming shared along a trie.

A pre-token is a word with its word mark in front (texts are split at white space). Its token count
is the number of pieces in its best segmentation: forward scores f(i) = max over pieces ending at i
of f(i - length) + log p(piece), where a character that no piece covers costs UNKNOWN and counts as
its UTF-8 bytes. Distinct pre-tokens of a lot of texts are inserted in a trie in sorted order, so one
stack of forward states, that of the path to the last pre-token, is the whole live trie: a pre-token
reuses the states of the prefix it shares with the one before it and computes only its own. Terminal
counts are kept by pre-token (bounded, started anew when large) and summed per text.

The vocabulary is a public one, never trained here: its pieces by rank, with Zipf log probabilities.

Defined results: null or empty text, or white space only, has 0 tokens and 0 pre-tokens; ids may be
null and rows repeat; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MARK = "▁"
UNKNOWN = -30.0
#: Pre-tokens whose counts a worker keeps; characters of text worked on at once.
KEPT, LOT = 400_000, 4_000_000
#: Longest pre-token that is kept by its text after its lot.
LONG = 64


@lru_cache(maxsize=2)
def pieces(model_path: str) -> dict[str, float]:
    """Piece -> log probability. Control, unknown and byte pieces are left out; rank r has weight 1/(r+1)."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=model_path)
    ranked = [model.id_to_piece(i) for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i))]
    total = math.log(sum(1.0 / (r + 1) for r in range(len(ranked))))
    return {p: -math.log(r + 1) - total for r, p in enumerate(ranked)}


class TrieCounter:
    """Counts tokens of pre-tokens that come in sorted order."""

    def __init__(self, scores: dict[str, float]):
        self.scores = scores
        self.longest = max(map(len, scores), default=1)
        self.path = ""
        self.best = [0.0]
        self.count = [0]

    def __call__(self, word: str) -> int:
        path, best, count, get, longest = self.path, self.best, self.count, self.scores.get, self.longest
        shared = 0
        for a, b in zip(path, word, strict=False):
            if a != b:
                break
            shared += 1
        del best[shared + 1 :], count[shared + 1 :]
        for end in range(shared + 1, len(word) + 1):
            top = best[end - 1] + UNKNOWN
            n = count[end - 1] + len(word[end - 1].encode())
            for start in range(end - 1, max(-1, end - longest - 1), -1):
                if (s := get(word[start:end])) is not None and best[start] + s > top:
                    top, n = best[start] + s, count[start] + 1
            best.append(top)
            count.append(n)
        self.path = word
        return count[-1]


def token_counts(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_chars, n_words (pre-tokens) and n_tokens of every row."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    source = docs.select(F.col(id_col).alias("doc_id"), text.alias("text"), F.length(text).cast("bigint").alias("n_chars"))

    def run(batches):
        scores = pieces(model_path)
        known: dict[str, int] = {}
        for batch in batches:
            texts = batch.column(1)
            n_words, n_tokens = np.zeros(len(texts), np.int64), np.zeros(len(texts), np.int64)
            i = 0
            while i < len(texts):
                lot, size, first = [], 0, i
                while i < len(texts) and size < LOT:
                    t = texts[i].as_py()
                    lot.append(t.split())
                    size += len(t)
                    i += 1
                fresh = set().union(*lot).difference(known)
                counter = TrieCounter(scores)
                for w in sorted(fresh):
                    known[w] = counter(MARK + w)
                for j, words in enumerate(lot, first):
                    n_words[j] = len(words)
                    n_tokens[j] = sum(map(known.__getitem__, words))
                if len(known) > KEPT:
                    known.clear()
                else:
                    for w in [w for w in fresh if len(w) > LONG]:
                        del known[w]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(n_words), pa.array(n_tokens)], names=["doc_id", "n_chars", "n_words", "n_tokens"])

    return source.mapInArrow(run, f"doc_id {source.schema['doc_id'].dataType.simpleString()}, n_chars bigint, n_words bigint, n_tokens bigint")
