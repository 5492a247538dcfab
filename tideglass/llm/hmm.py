"""Hidden Markov language model: Baum-Welch over all training texts, exact likelihood by scaled forward recursion.

Words are emitted in two steps. A latent state emits a class: one of the VOCABULARY most frequent
words, the end, or one of RARE groups of all other words (by a hash of their last three bytes).
Within a group the word follows (c+0.5)/(C+0.5(W+1)) from the counts of the whole training set,
with one place for words it has not seen, so the text's probability is a proper one. What is kept
on the driver and sent to workers is bounded by VOCABULARY; the counts of rare words stay in a
table and meet the texts in a join by word.

Training: word counts over all training texts; texts as class ids, written once; a start from the
counts of all classes, spread over the states at random with a fixed seed; then PASSES Baum-Welch passes,
each over all training texts in their whole length. A task adds up the expected counts of its texts, and
PARTIALS tasks at least, or three per core, share a pass, so what is shuffled grows with the cluster and
not with the corpus; Spark sums them by class. Forward and backward recursions run over whole texts: a lot
of texts of about equal length at a time, and a text beyond CHUNK tokens in segments that hand on the
forward state and take back the backward one, so memory is bounded and no step is left out.

Defined results: null or empty text is the end token alone; a null id is never held out; repeated
rows are scored each; an empty table gives an empty result; without training texts all words are
unknown; other columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tideglass.llm.common import cut

STATES, PASSES, VOCABULARY, RARE = 8, 8, 65_536, 256
LONGEST_WORD = 64  # bytes of a word in the vocabulary; longer ones are rare words
PARTIALS = 64  # tasks that share a pass, at least
CHUNK = 1_500_000  # tokens worked on at once
FLUSH = 400_000  # words a task counts before it hands them on
LN10 = np.log(10.0)


def words_of(text: str) -> list[bytes]:
    """Runs of anything but the six ASCII white-space characters, with A-Z in lower case."""
    return text.encode().lower().split()


def rare_group(word: bytes) -> int:
    return crc32(word[-3:]) % RARE


def word_counts(texts: DataFrame) -> DataFrame:
    """word, n over all texts."""

    def run(batches):
        seen: Counter = Counter()

        def out():
            return pa.RecordBatch.from_arrays([pa.array(seen.keys(), pa.binary()), pa.array(seen.values(), pa.int64())], names=["word", "n"])

        for batch in batches:
            for text in batch.column(0):
                seen.update(words_of(text.as_py()))
                if len(seen) > FLUSH:
                    yield out()
                    seen.clear()
        yield out()

    return texts.select("text").mapInArrow(run, "word binary, n bigint").groupBy("word").agg(F.sum("n").alias("n"))


def encoded(texts: DataFrame, vocabulary: dict[bytes, int]) -> DataFrame:
    """row, doc_id, held_out, class ids with the end, and the rare words themselves."""
    size = len(vocabulary)

    def run(batches):
        from pyspark import TaskContext

        row = TaskContext.get().partitionId() << 40
        get = vocabulary.get
        for batch in batches:
            ids, lengths, rare, rares = [], [], [], []
            for text in batch.column(2):
                words = words_of(text.as_py())
                found = [get(w, -1) for w in words]
                count = 0
                for i, c in enumerate(found):
                    if c < 0:
                        rare.append(words[i])
                        found[i] = size + rare_group(words[i])
                        count += 1
                found.append(size + RARE)
                ids.append(np.array(found, np.int32))
                lengths.append(len(found))
                rares.append(count)
            n = batch.num_rows
            at = lambda x: pa.array(np.concatenate([[0], np.cumsum(x, dtype=np.int64)]).astype(np.int32), pa.int32())
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.arange(row, row + n)), batch.column(0), batch.column(1), pa.ListArray.from_arrays(at(lengths), pa.array(np.concatenate(ids) if n else np.empty(0, np.int32))), pa.ListArray.from_arrays(at(rares), pa.array(rare, pa.binary()))],
                names=["row", "doc_id", "held_out", "ids", "rare"],
            )
            row += n

    kind = texts.schema["doc_id"].dataType.simpleString()
    return texts.select("doc_id", "held_out", "text").mapInArrow(run, f"row bigint, doc_id {kind}, held_out boolean, ids array<int>, rare array<binary>")


class Model:
    """pi (S), a (S, S), b (classes, S): probabilities of start, step and class."""

    def __init__(self, pi: np.ndarray, a: np.ndarray, b: np.ndarray):
        self.pi, self.a, self.b, self.by_state = pi, a, b, None

    def __getstate__(self):
        return self.__dict__ | {"by_state": None}

    def emissions(self) -> np.ndarray:
        """b with a row per state: the recursions run along whole rows of sequences."""
        if self.by_state is None:
            self.by_state = np.ascontiguousarray(self.b.T)
        return self.by_state

    @classmethod
    def start(cls, prior: np.ndarray, states: int) -> Model:
        random = np.random.default_rng(7)
        b = prior[:, None] * random.gamma(1.0, size=(len(prior), states))
        a = np.full((states, states), 0.1 / max(1, states - 1))
        np.fill_diagonal(a, 0.9 if states > 1 else 1.0)
        return cls(np.full(states, 1 / states), a, b / b.sum(0))

    @classmethod
    def of_counts(cls, starts: np.ndarray, steps: np.ndarray, classes: np.ndarray, prior: np.ndarray) -> Model:
        pi = starts + 1.0
        a = steps + 0.1
        b = classes + prior[:, None]
        return cls(pi / pi.sum(), a / a.sum(1, keepdims=True), b / b.sum(0))

    def log10(self, ids: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """log10 probability of each sequence ids[start : start + length]: scaled forward recursion."""
        order = np.argsort(-lengths, kind="stable")
        at, lengths = starts[order], lengths[order]
        total = np.zeros(len(at))
        alive = np.searchsorted(-lengths, -np.arange(int(lengths[0]) if len(at) else 0), side="left")
        emissions, step, alpha = self.emissions(), np.ascontiguousarray(self.a.T), None
        for t, n in enumerate(alive.tolist()):
            alpha = (self.pi[:, None] if alpha is None else step @ alpha[:, :n]) * emissions.take(ids[at[:n] + t], 1)
            scale = alpha.sum(0)
            alpha /= scale
            total[:n] += np.log(scale)
        out = np.empty(len(at))
        out[order] = total / LN10
        return out

    def _forward(self, tokens: np.ndarray, at: list[int], alpha: np.ndarray | None, alphas: np.ndarray, scales: np.ndarray) -> None:
        """Scaled forward states, a row per state, and their scales; step i takes the places at[i] to at[i + 1]."""
        emissions, step = self.emissions(), np.ascontiguousarray(self.a.T)
        for lo, hi in zip(at[:-1], at[1:], strict=True):
            now = alphas[:, lo:hi]
            np.multiply(self.pi[:, None] if alpha is None else step @ alpha[:, : hi - lo], emissions.take(tokens[lo:hi], 1), out=now)
            now.sum(0, out=scales[lo:hi])
            now /= scales[lo:hi]
            alpha = now

    def expected(self, ids: np.ndarray, starts: np.ndarray, lengths: np.ndarray):
        """Expected counts of starts, steps and classes over whole sequences.

        Held are the states and scales of CHUNK tokens; the states become the posteriors in place."""
        s = len(self.pi)
        order = np.argsort(-lengths, kind="stable")
        begin, lengths = starts[order], lengths[order]
        alive = np.searchsorted(-lengths, -np.arange(int(lengths[0])), side="left").tolist()
        width = len(alive) if lengths.sum() <= 2 * CHUNK else max(1, CHUNK // len(begin))
        cuts = list(range(0, len(alive), width))

        def segment(lo: int, alpha: np.ndarray | None):
            sizes = alive[lo : lo + width]
            at = [0, *np.cumsum(sizes).tolist()]
            tokens = np.concatenate([ids[begin[:n] + t] for t, n in enumerate(sizes, lo)])
            alphas, scales = np.empty((s, at[-1])), np.empty(at[-1])
            self._forward(tokens, at, alpha, alphas, scales)
            return at, tokens, alphas, scales

        entered: list[np.ndarray | None] = [None]
        for lo in cuts[:-1]:
            at, _, alphas, _ = segment(lo, entered[-1])
            entered.append(alphas[:, at[-2] :].copy())
        steps, classes, first = np.zeros((s, s)), np.zeros((len(self.b), s)), np.zeros(s)
        emissions, ahead = self.emissions(), np.empty((s, 0))
        for start, alpha in zip(reversed(cuts), reversed(entered), strict=True):
            at, tokens, alphas, scales = segment(start, alpha)
            for lo, hi in zip(reversed(at[:-1]), reversed(at[1:]), strict=True):
                now, m = alphas[:, lo:hi], ahead.shape[1]
                steps += now[:, :m] @ ahead.T
                beta = np.ones((s, hi - lo))
                np.matmul(self.a, ahead, out=beta[:, :m])
                now *= beta
                beta *= emissions.take(tokens[lo:hi], 1)
                beta /= scales[lo:hi]
                ahead = beta
            for i in range(s):
                classes[:, i] += np.bincount(tokens, alphas[i], len(self.b))
            first = alphas[:, : at[1]].sum(1)
        return first, steps * self.a, classes


def lots(starts: np.ndarray, lengths: np.ndarray):
    """(places, starts, lengths) of sequences of about equal length, CHUNK tokens or one sequence at a time."""
    order = np.argsort(lengths, kind="stable")
    lot = np.cumsum(lengths[order]) // CHUNK
    for part in np.split(order, np.flatnonzero(np.diff(lot)) + 1):
        if len(part):
            yield part, starts[part], lengths[part]


def flat(column) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """ids, starts and lengths of a column of lists."""
    offsets = column.offsets.to_numpy()
    return column.values.to_numpy(zero_copy_only=False), offsets[:-1].astype(np.int64), np.diff(offsets).astype(np.int64)


def baum_welch_pass(data: DataFrame, model: Model, prior: np.ndarray) -> Model:
    """One pass over all of `data` (a column ids): counts per class are summed in Spark."""
    states, size = len(model.pi), len(prior)

    def run(batches):
        classes, steps, first = np.zeros((size, states)), np.zeros((states, states)), np.zeros(states)
        for batch in batches:
            ids, starts, lengths = flat(batch.column(0))
            for _, at, n in lots(starts, lengths):
                f, s, c = model.expected(ids, at, n)
                first += f
                steps += s
                classes += c
        every = np.concatenate([classes, steps, first[None]])
        kept = np.flatnonzero(every.any(1))
        yield pa.RecordBatch.from_arrays([pa.array(kept.astype(np.int32)), *(pa.array(every[kept, i]) for i in range(states))], names=["class", *(f"s{i}" for i in range(states))])

    columns = [f"s{i}" for i in range(states)]
    tasks = max(PARTIALS, 3 * data.sparkSession.sparkContext.defaultParallelism)
    parts = data.select("ids").coalesce(tasks).mapInArrow(run, "class int, " + ", ".join(f"{c} double" for c in columns))
    summed = parts.groupBy("class").agg(*(F.sum(c).alias(c) for c in columns)).toArrow()
    every = np.zeros((size + states + 1, states))
    every[summed.column("class").to_numpy()] = np.stack([summed.column(c).to_numpy() for c in columns], 1)
    return Model.of_counts(every[-1], every[size:-1], every[:size], prior)


def hmm_scores(docs: DataFrame, held_out: Column, id_col: str = "doc_id", text_col: str = "text", states: int = STATES, passes: int = PASSES, vocabulary: int = VOCABULARY) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every row; learns where held_out is false.

    `vocabulary` bounds what is broadcast; the words beyond it share classes and keep their own counts."""
    texts = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(held_out, F.lit(False)).alias("held_out"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    train = texts.where(~F.col("held_out"))
    counts = cut(word_counts(train), "words")
    top = counts.where(F.length("word") <= LONGEST_WORD).orderBy(F.desc("n"), "word").limit(vocabulary).toArrow()
    top_words, top_n = [bytes(w) for w in top.column("word").to_pylist()], top.column("n").to_numpy().astype(np.float64)
    words = {w: i for i, w in enumerate(top_words)}
    size = len(words)
    everything = counts.agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("v")).first()
    data = cut(encoded(texts, words), "encoded")
    train_docs = data.where(~F.col("held_out")).count()

    # by group of rare words: their tokens and distinct words, as all words less those of the vocabulary
    group = F.pmod(F.crc32(F.expr("substring(word, -3, 3)")), F.lit(RARE)).cast("int").alias("g")
    groups = counts.groupBy(group).agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("v")).toArrow()
    rare_n, rare_v = np.zeros(RARE), np.zeros(RARE)
    rare_n[groups.column("g").to_numpy()], rare_v[groups.column("g").to_numpy()] = groups.column("n").to_numpy(), groups.column("v").to_numpy()
    of_top = np.array([rare_group(w) for w in top_words], np.int64)
    np.subtract.at(rare_n, of_top, top_n)
    np.subtract.at(rare_v, of_top, 1)
    norm10 = np.log10(rare_n + 0.5 * (rare_v + 1))

    own = np.concatenate([top_n, rare_n, [train_docs]])
    n_all, v_all = int(everything["n"] or 0) + train_docs, int(everything["v"]) + (train_docs > 0)
    log_z = float(np.log10(n_all + 0.5 * (v_all + 1)))
    prior = (own + 0.5) / (own + 0.5).sum() * 0.5 * len(own)
    base10 = np.log10(own + 0.5) - log_z  # of vocabulary and end; rare words come from the join
    base10[size : size + RARE] = -log_z
    minus10 = np.zeros(len(own))
    minus10[size : size + RARE] = norm10

    model = Model.start(prior, states)
    training = data.where(~F.col("held_out"))
    for _ in range(passes if train_docs else 0):
        model = baum_welch_pass(training, model, prior)

    known_class = np.concatenate([np.ones(size, np.int64), np.zeros(RARE, np.int64), [int(train_docs > 0)]])

    def run(batches):
        for batch in batches:
            ids, starts, lengths = flat(batch.column(3))
            score = np.empty(len(starts))
            for part, at, n in lots(starts, lengths):
                score[part] = model.log10(ids, at, n)
            sums = lambda x: np.add.reduceat(x[ids], starts) if len(starts) else np.empty(0, x.dtype)  # noqa: E731  no text is without its end
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(lengths), pa.array(sums(known_class)), pa.array(sums(base10)), pa.array(score - sums(minus10))], names=["row", "doc_id", "held_out", "n_tokens", "known", "base", "score"])

    kind = data.schema["doc_id"].dataType.simpleString()
    scored = data.select("row", "doc_id", "held_out", "ids").mapInArrow(run, f"row bigint, doc_id {kind}, held_out boolean, n_tokens bigint, known bigint, base double, score double")
    rare = data.select("row", F.explode("rare").alias("word")).join(counts, "word", "left")
    rare = rare.groupBy("row").agg(F.count("n").alias("rare_known"), F.sum(F.log10(F.coalesce("n", F.lit(0)) + 0.5)).alias("rare10"))
    zero = F.coalesce("rare10", F.lit(0.0))
    return scored.join(rare, "row", "left").select(
        "doc_id", "held_out", "n_tokens",
        (F.col("known") + F.coalesce("rare_known", F.lit(0))).alias("n_known"),
        F.lit(n_all).cast("bigint").alias("train_tokens"),
        (F.col("base") + zero).alias("base_score"),
        (F.col("score") + zero).alias("score"),
    )
