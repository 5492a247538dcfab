import random

import odd
import public_tokenizers

from tideglass.llm import trie_tokens as tt

MODEL = public_tokenizers.path("piece_bpe_32k.model")


def best(word, scores):
    """All segmentations by the plain recursion over end positions."""
    f = [(0.0, 0)]
    for end in range(1, len(word) + 1):
        top = (f[end - 1][0] + tt.UNKNOWN, f[end - 1][1] + len(word[end - 1].encode()))
        for start in range(end - 1, -1, -1):
            if word[start:end] in scores and f[start][0] + scores[word[start:end]] > top[0]:
                top = (f[start][0] + scores[word[start:end]], f[start][1] + 1)
        f.append(top)
    return f[-1][1]


def test_trie_like_plain_programming():
    scores = tt.pieces(MODEL)
    rng = random.Random(4)
    words = sorted({tt.MARK + "".join(rng.choice("abeinst é日") for _ in range(rng.randrange(0, 12))) for _ in range(500)} | {tt.MARK + "a" * 90})
    counter = tt.TrieCounter(scores)
    assert [counter(w) for w in words] == [best(w, scores) for w in words]


def test_documents(spark):
    scores = tt.pieces(MODEL)
    rows = tt.token_counts(odd.odd_documents(spark), MODEL).collect()
    assert len(rows) == len(odd.texts())
    want = sorted((i or -1, len(t or ""), len((t or "").split()), sum(best(tt.MARK + w, scores) for w in (t or "").split())) for i, t, *_ in odd.texts() if len(t or "") != 3000)
    assert sorted((r["doc_id"] or -1, r["n_chars"], r["n_words"], r["n_tokens"]) for r in rows if r["n_chars"] != 3000) == want
    assert tt.token_counts(odd.empty_documents(spark), MODEL).count() == 0
