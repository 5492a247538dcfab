"""Toxicity by the nearest labelled examples, found exactly in a block-max inverted index.

Fitting: the examples are at most LABELLED labelled rows, those with the least hash of their id, and
no more of them than hold ENTRIES entries (a word of a text) in all: both bound what the driver and each
worker hold. Whole texts become unit vectors over all words of the examples, weighted by
(1 + ln count) * idf * (BASE + association): document frequencies are counted over all documents, and
the association with the label is the phi coefficient beyond what chance gives. No word is dropped.

Index: examples are ordered by spherical clusters and cut into blocks of BLOCK. Words in many examples
(at most FREQUENT) keep their weights as a dense block of each lot of examples, all others as postings,
and each dense word has its largest weight per block. A block's bound for a query is the sum of its
dense words' largest weights times the query's, plus the best of the block's exact sums over postings.

Search: a query takes its best block first; blocks whose bound is under its K-th best cosine are
skipped, so the K nearest are exact. Candidates are found in single precision with a margin and ranked
by their cosine in double precision; ties go to the example that stands first.

Score: votes of the K nearest, weighted by the inverse of their distance, mapped to a probability by a
monotone curve. The curve is fitted to votes of the examples on each other. An example with the very
same text has no vote, in fitting and in scoring: no label decides its own text's score, and the curve
holds for labelled and other texts alike. Python gets the texts and gives the scores, AT_ONCE texts at
a time; the documents' other columns stay in the JVM. A text without neighbours gets the examples' smoothed share of
toxic ones.

Defined results: null or empty text has no words; labels that are null are no labels, several of one
id count as toxic if any is; rows of one id with different texts are examples each; without labelled
rows each score is PRIOR_TOXIC / PRIOR_ROWS, far below one half; repeated rows are scored alike; a word
in no example has no weight; an empty table gives an empty result; a result column whose name the table
has already gets underscores behind it; labels, lang, source and ids enter no score.
"""

from __future__ import annotations

import re
from collections import Counter
from typing import Iterator, Tuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tideglass.llm.common import cut, free_names

LABELLED, ENTRIES = 12_000, 4_000_000
K, BLOCK, FREQUENT = 25, 512, 512
BASE, CHANCE = 0.02, 10.0  # weight of a word without association; chi-squared that counts as chance
NEAR = 0.05  # added to a distance before it is inverted
PRIOR_ROWS, PRIOR_TOXIC = 20.0, 0.5
LOT_QUERIES, LOT_POSTINGS = 48, 2_000_000  # queries and postings that are worked on at once
AT_ONCE = 256  # texts of a batch that are taken apart at once
MARGIN = 1e-4  # more than single precision loses in a cosine
EVIDENCE = 3
WORD = re.compile(r"\w+")
KEPT = ("row", "place", "id", "digest", "toxic")


def words_of(text: str) -> list[str]:
    return WORD.findall(text.lower())


def pieces(n: int) -> Iterator[tuple[int, int]]:
    """(start, length) of the pieces of AT_ONCE rows that n rows make."""
    return ((i, min(AT_ONCE, n - i)) for i in range(0, n, AT_ONCE))


def training_rows(docs: DataFrame, labels: DataFrame, usable: Column | None, id_col: str, text_col: str, label_col: str, most: int) -> DataFrame:
    """row, place, id, digest, toxic, text of labelled documents; usable: a condition on the labels' ids."""
    known = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull())
    known = known.where(usable) if usable is not None else known
    known = known.groupBy(F.col(id_col).alias("id")).agg((F.max(label_col) > 0).alias("toxic"))
    known = known.withColumn("place", F.xxhash64("id")).orderBy("place", "id").limit(most)
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    texts = docs.select(F.col(id_col).alias("id"), text.alias("text"), F.xxhash64(text).alias("digest"))
    return texts.join(F.broadcast(known), "id").select(F.monotonically_increasing_id().alias("row"), "place", "id", "digest", "toxic", "text")


def counted(rows: DataFrame) -> DataFrame:
    """The rows with the distinct words of each text and their counts in place of the text."""

    def run(batches):
        for batch in batches:
            found = [Counter(words_of(t)) for t in batch.column("text").to_pylist()]
            columns = [*(batch.column(c) for c in KEPT)]
            columns += [pa.array([len(c) for c in found], pa.int64()), pa.array([list(c) for c in found], pa.list_(pa.string())), pa.array([list(c.values()) for c in found], pa.list_(pa.int32()))]
            yield pa.RecordBatch.from_arrays(columns, names=[*KEPT, "size", "words", "counts"])

    fields = [rows.schema[c] for c in KEPT]
    fields += [T.StructField("size", T.LongType()), T.StructField("words", T.ArrayType(T.StringType())), T.StructField("counts", T.ArrayType(T.IntegerType()))]
    return rows.mapInArrow(run, T.StructType(fields))


def chosen_examples(rows: DataFrame, most: int, entries: int) -> pa.Table:
    """The examples in order of place: within both bounds, each text of an id once."""
    every = cut(counted(rows), "toxicity-examples")
    sizes = every.groupBy("place", "digest").agg(F.min(F.struct("row", "size")).alias("one")).orderBy("place", "digest").limit(most).select("one.*").toArrow()
    fit = int(np.searchsorted(np.cumsum(sizes.column("size").to_numpy()), entries, side="right"))
    keys = every.sparkSession.createDataFrame(sizes.slice(0, fit).select(["row"])) if fit else every.select("row").limit(0)
    return every.join(F.broadcast(keys), "row").toArrow().sort_by([("place", "ascending"), ("digest", "ascending")])


def document_frequencies(docs: DataFrame, words: pa.Array, text_col: str) -> tuple[np.ndarray, int]:
    """Of each word over all documents, and their number."""
    shared = docs.sparkSession.sparkContext.broadcast(words)

    def run(batches):
        at = {w: i for i, w in enumerate(shared.value.to_pylist())}
        counts = np.zeros(len(at) + 1, np.int64)
        for batch in batches:
            counts[-1] += batch.num_rows
            for piece in pieces(batch.num_rows):
                for text in batch.column(0).slice(*piece).to_pylist():
                    counts[[i for i in map(at.get, set(words_of(text))) if i is not None]] += 1
        some = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(counts[some])], names=["term", "n"])

    texts = docs.select(F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    summed = texts.mapInArrow(run, "term int, n bigint").groupBy("term").agg(F.sum("n").alias("n")).toArrow()
    shared.destroy()
    every = np.zeros(len(words) + 1, np.int64)
    every[summed.column("term").to_numpy()] = summed.column("n").to_numpy()
    return every[:-1], int(every[-1])


def association(terms: np.ndarray, owner: np.ndarray, toxic: np.ndarray, n_terms: int) -> np.ndarray:
    """Phi coefficient of each term with the label, less what chance gives."""
    n, n1 = float(len(toxic)), float(toxic.sum())
    n0 = n - n1
    if not n1 or not n0:
        return np.zeros(n_terms)
    a = np.bincount(terms[toxic[owner]], minlength=n_terms).astype(float)
    b = np.bincount(terms[~toxic[owner]], minlength=n_terms).astype(float)
    chi2 = n * (a * (n0 - b) - b * (n1 - a)) ** 2 / np.maximum((a + b) * (n - a - b) * n1 * n0, 1.0)
    return np.sqrt(np.maximum(chi2 - CHANCE, 0.0) / n)


def ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The numbers of all ranges [start, start + length), one after the other."""
    total = int(lengths.sum())
    return np.repeat(starts - np.cumsum(lengths) + lengths, lengths) + np.arange(total)


def clustered(dense: np.ndarray, parts: int, rounds: int = 4) -> np.ndarray:
    """An order of the rows in which those of one spherical cluster stand together."""
    unit = dense / np.maximum(np.sqrt(np.einsum("ij,ij->i", dense, dense))[:, None], 1e-12)
    centres = unit[np.linspace(0, len(unit) - 1, parts).astype(int)]
    for _ in range(rounds):
        of = (unit @ centres.T).argmax(1)
        sums = np.stack([unit[of == i].sum(0) for i in range(parts)])
        centres = sums / np.maximum(np.linalg.norm(sums, axis=1, keepdims=True), 1e-12)
    near = unit @ centres.T
    of = near.argmax(1)
    return np.lexsort((-near[np.arange(len(unit)), of], of))


class BlockMaxIndex:
    """Unit vectors of examples, in blocks of BLOCK. `terms`, `weights`, `cuts` are their entries, example by example."""

    def __init__(self, terms: np.ndarray, weights: np.ndarray, cuts: np.ndarray, n_terms: int, digests: np.ndarray | None = None):
        self.n, self.n_terms, self.query = len(cuts) - 1, n_terms, None
        self.terms, self.weights, self.cuts = terms, weights, cuts
        df = np.bincount(self.terms, minlength=n_terms)
        order = np.argsort(-df, kind="stable")[: min(FREQUENT, n_terms)]
        self.frequent = np.sort(order[df[order] >= max(2, self.n // 64)])
        self.blocks = -(-self.n // BLOCK)
        self.order = np.arange(self.n)
        if self.blocks > 1 and len(self.frequent):
            self._reorder(clustered(self._dense().T, self.blocks))
        self.digests = (digests if digests is not None else np.arange(self.n))[self.order]
        self.ready = None

    def _reorder(self, order: np.ndarray) -> None:
        lengths = np.diff(self.cuts)[order]
        at = ranges(self.cuts[:-1][order], lengths)
        self.terms, self.weights = self.terms[at], self.weights[at]
        self.cuts, self.order = np.concatenate([[0], np.cumsum(lengths)]), order

    def _dense(self) -> np.ndarray:
        at = np.full(self.n_terms, -1, np.int64)
        at[self.frequent] = np.arange(len(self.frequent))
        owner = np.repeat(np.arange(self.n), np.diff(self.cuts))
        mine = at[self.terms] >= 0
        dense = np.zeros((len(self.frequent), self.n), np.float32)
        dense[at[self.terms[mine]], owner[mine]] = self.weights[mine]
        return dense

    def __getstate__(self):
        return self.__dict__ | {"ready": None, "query": None}

    def prepared(self):
        """(place of a frequent term or -1, dense blocks, their largest weights, postings: cuts, examples, weights)."""
        if self.ready is None:
            at = np.full(self.n_terms, -1, np.int64)
            at[self.frequent] = np.arange(len(self.frequent))
            dense = np.zeros((len(self.frequent), self.blocks * BLOCK), np.float32)
            dense[:, : self.n] = self._dense()
            blocks = np.ascontiguousarray(dense.reshape(len(self.frequent), self.blocks, BLOCK).transpose(1, 0, 2))
            rare = np.flatnonzero(at[self.terms] < 0)
            rare = rare[np.argsort(self.terms[rare], kind="stable")]
            owner = np.repeat(np.arange(self.n, dtype=np.int32), np.diff(self.cuts))[rare]
            cuts = np.searchsorted(self.terms[rare], np.arange(self.n_terms + 1))
            same: dict[int, list[int]] = {}
            for i, d in enumerate(self.digests.tolist()):
                same.setdefault(d, []).append(i)
            self.ready = (at, blocks, blocks.max(2).T.copy() if len(self.frequent) else np.zeros((0, self.blocks), np.float32), cuts, owner, self.weights[rare].astype(np.float32), same)
        return self.ready

    def nearest(self, queries: list[tuple[np.ndarray, np.ndarray]], k: int, without: list[int | None] | None = None) -> list[tuple[np.ndarray, np.ndarray]]:
        """Of each unit vector (terms, weights) the k nearest examples with cosine over 0, best first, and the
        cosines; examples whose digest is that in `without` are left out."""
        cuts = self.prepared()[3]
        loads = [int((cuts[t + 1] - cuts[t]).sum()) for t, _ in queries]
        out, start = [], 0
        while start < len(queries):
            end, load = start + 1, loads[start]
            while end < len(queries) and end - start < LOT_QUERIES and load + loads[end] <= LOT_POSTINGS:
                load += loads[end]
                end += 1
            out += self._lot(queries[start:end], k, without[start:end] if without else [None] * (end - start))
            start = end
        return out

    def _lot(self, queries, k, without):
        at, blocks, highest, cuts, owner, much, same = self.prepared()
        q, width = len(queries), self.blocks * BLOCK
        if not width:
            return [(np.empty(0, np.int64), np.empty(0))] * q
        dense = np.zeros((q, len(self.frequent)), np.float32)
        keys, values = [np.empty(0, np.int64)], [np.empty(0, np.float32)]
        for j, (terms, weights) in enumerate(queries):
            place = at[terms]
            dense[j, place[place >= 0]] = weights[place >= 0]
            terms, weights = terms[place < 0], weights[place < 0]
            lengths = cuts[terms + 1] - cuts[terms]
            found = ranges(cuts[terms], lengths)
            keys.append(owner[found] + np.int64(j * width))
            values.append(much[found] * np.repeat(weights.astype(np.float32), lengths))
        rest = np.bincount(np.concatenate(keys), np.concatenate(values), q * width).astype(np.float32).reshape(q, self.blocks, BLOCK)
        bound = dense @ highest + rest.max(2)
        scores = np.zeros((q, self.blocks, BLOCK), np.float32)
        twins = [same.get(d, []) if d is not None else [] for d in without]

        def score(rows: np.ndarray, b: int) -> None:
            scores[rows, b] = dense[rows] @ blocks[b] + rest[rows, b]
            for j in rows.tolist():
                for e in twins[j]:
                    if e // BLOCK == b:
                        scores[j, b, e % BLOCK] = 0.0

        first = bound.argmax(1)
        kth = max(0, BLOCK - k)
        least = np.zeros(q, np.float32)
        for b in np.unique(first).tolist():
            rows = np.flatnonzero(first == b)
            score(rows, b)
            least[rows] = np.partition(scores[rows, b], kth, axis=1)[:, kth] if k <= BLOCK else 0.0
        for b in range(self.blocks):
            rows = np.flatnonzero((bound[:, b] >= least - MARGIN) & (bound[:, b] > 0) & (first != b))
            if len(rows):
                score(rows, b)
        return [self._best(scores[j].ravel(), *queries[j], k) for j in range(q)]

    def _best(self, scores: np.ndarray, terms: np.ndarray, weights: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        least = np.partition(scores, len(scores) - k)[len(scores) - k] if k < len(scores) else 0.0
        found = np.flatnonzero((scores > 0) & (scores >= least - MARGIN))
        if not len(found):
            return found, np.empty(0)
        if self.query is None:
            self.query = np.zeros(self.n_terms)
        self.query[terms] = weights
        lengths = np.diff(self.cuts)[found]
        entries = ranges(self.cuts[found], lengths)
        exact = np.add.reduceat(self.query[self.terms[entries]] * self.weights[entries], np.cumsum(lengths) - lengths)
        self.query[terms] = 0.0
        best = np.lexsort((self.order[found], -np.round(exact, 12)))[:k]
        return found[best], exact[best]


def vote(cosines: np.ndarray, toxic: np.ndarray) -> float:
    w = 1.0 / (NEAR + np.clip(1.0 - cosines, 0.0, None))
    return float((w * toxic).sum() / w.sum())


def monotone(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Non-decreasing step means of y over x (pool adjacent violators), each smoothed towards the overall mean."""
    order = np.argsort(x, kind="stable")
    x, y, mean = x[order], y[order].astype(float), float(y.mean())
    values, starts = np.unique(x, return_index=True)
    sums, sizes = np.add.reduceat(y, starts) + mean, np.diff([*starts, len(x)]) + 1.0
    pools: list[list[float]] = []
    for v, s, n in zip(values, sums, sizes, strict=True):
        pools.append([v, v, s, n])
        while len(pools) > 1 and pools[-2][2] / pools[-2][3] >= pools[-1][2] / pools[-1][3]:
            _, high, s2, n2 = pools.pop()
            pools[-1] = [pools[-1][0], high, pools[-1][2] + s2, pools[-1][3] + n2]
    points = [(p[side], p[2] / p[3]) for p in pools for side in (0, 1)]
    return np.array([p[0] for p in points]), np.array([p[1] for p in points])


def unit_weights(terms: np.ndarray, counts: np.ndarray, cuts: np.ndarray, factor: np.ndarray) -> np.ndarray:
    """Weights of the entries of all examples, each example of length one."""
    raw = np.empty(len(terms))
    for first in range(0, len(cuts) - 1, AT_ONCE):
        ends = cuts[first : first + AT_ONCE + 1]
        part = slice(ends[0], ends[-1])
        raw[part] = (1 + np.log(counts[part].astype(float))) * factor[terms[part]]
        lengths = np.diff(ends)
        some = lengths > 0
        if some.any():
            raw[part] /= np.repeat(np.sqrt(np.add.reduceat(raw[part] * raw[part], (ends[:-1] - ends[0])[some])), lengths[some])
    return raw


class Scorer:
    """The fitted classifier: bounded by LABELLED examples and ENTRIES entries."""

    def __init__(self, words: pa.Array, factor: np.ndarray, ids: pa.Array, toxic: np.ndarray, digests: np.ndarray, terms: np.ndarray, counts: np.ndarray, cuts: np.ndarray, k: int):
        self.words, self.factor, self.k = words, factor, k
        self.index = BlockMaxIndex(terms, unit_weights(terms, counts, cuts, factor), cuts, len(words), digests)
        lengths = np.diff(cuts)[self.index.order]
        self.counts = counts[ranges(cuts[:-1][self.index.order], lengths)]
        self.toxic = toxic[self.index.order]
        self.ids = ids.take(pa.array(self.index.order, pa.int64()))
        self.share = float((toxic.sum() + PRIOR_TOXIC) / (len(toxic) + PRIOR_ROWS))
        self.curve = (np.array([0.0, 1.0]), np.array([self.share, self.share]))
        self.at = self.shared = None

    def __getstate__(self):
        """What travels: counts in a small type; the weights are made of them again."""
        index = self.index.__getstate__() | {"weights": None}
        return self.__dict__ | {"at": None, "shared": None, "index": index}

    def __setstate__(self, state):
        self.__dict__.update(state)
        self.index = BlockMaxIndex.__new__(BlockMaxIndex)
        self.index.__dict__.update(state["index"])
        self.index.weights = unit_weights(self.index.terms, self.counts, self.index.cuts, self.factor)

    def broadcast(self, spark):
        """The examples, sent once for fitting and scoring; the curve travels with each job."""
        if self.shared is None:
            self.shared = spark.sparkContext.broadcast(self)
        return self.shared

    def weights(self, terms: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        w = (1 + np.log(counts)) * self.factor[terms]
        return terms, w / np.sqrt((w * w).sum()) if len(w) else w

    def vector(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        if self.at is None:
            self.at = {w: i for i, w in enumerate(self.words.to_pylist())}
        get = self.at.get
        pairs = [(i, c) for w, c in Counter(words_of(text)).items() if (i := get(w)) is not None]
        return self.weights(np.array([i for i, _ in pairs], np.int64), np.array([c for _, c in pairs], float))

    def raw(self, vectors, digests) -> list[tuple[np.ndarray, np.ndarray, float | None]]:
        """Neighbours, their cosines and their vote."""
        found = self.index.nearest(vectors, self.k, digests)
        return [(ids, cosines, vote(cosines, self.toxic[ids]) if len(ids) else None) for ids, cosines in found]

    def calibrated(self, votes: list[float | None]) -> "Scorer":
        """With the curve fitted to the examples' votes on each other, in index order."""
        some = np.array([v is not None for v in votes], bool)
        if some.any():
            self.curve = monotone(np.array([v for v in votes if v is not None]), self.toxic[some])
        return self


def probability(raw: float | None, curve: tuple[np.ndarray, np.ndarray], share: float) -> float:
    return share if raw is None else float(np.interp(raw, *curve))


def fit(docs: DataFrame, labels: DataFrame, usable: Column | None = None, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", labelled: int = LABELLED, entries: int = ENTRIES, k: int = K) -> Scorer:
    """usable: which labelled ids may be learned from, a condition on `labels`."""
    spark = docs.sparkSession
    rows = chosen_examples(training_rows(docs, labels, usable, id_col, text_col, label_col, labelled), labelled, entries)
    toxic = np.array(rows.column("toxic").to_pylist(), bool)
    cuts = np.concatenate([[0], np.cumsum(rows.column("size").to_numpy())]).astype(np.int64)
    coded = pc.dictionary_encode(rows.column("words").combine_chunks().flatten())
    coded = coded.combine_chunks() if isinstance(coded, pa.ChunkedArray) else coded
    words, terms = coded.dictionary, coded.indices.to_numpy()
    counts = rows.column("counts").combine_chunks().flatten().to_numpy()
    counts = counts.astype(np.min_scalar_type(int(counts.max(initial=0))))
    ids, digests = rows.column("id").combine_chunks(), rows.column("digest").to_numpy()
    del rows, coded
    df, n = document_frequencies(docs, words, text_col) if len(words) else (np.zeros(0, np.int64), 0)
    owner = np.repeat(np.arange(len(toxic), dtype=np.int32), np.diff(cuts))
    factor = (np.log((1 + n) / (1 + df)) + 1.0) * (BASE + association(terms, owner, toxic, len(words)))
    del owner
    scorer = Scorer(words, factor, ids, toxic, digests, terms, counts, cuts, k)
    del terms, counts
    if not len(toxic):
        return scorer
    shared = scorer.broadcast(spark)

    def run(batches):
        scorer = shared.value
        index = scorer.index
        for batch in batches:
            at = batch.column(0).to_numpy()
            vectors = [(index.terms[index.cuts[i] : index.cuts[i + 1]].astype(np.int64), index.weights[index.cuts[i] : index.cuts[i + 1]]) for i in at.tolist()]
            found = scorer.raw(vectors, index.digests[at].tolist())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([v for *_, v in found], pa.float64())], names=["id", "vote"])

    parts = max(1, min(spark.sparkContext.defaultParallelism * 2, len(toxic) // 250))
    votes = spark.range(0, len(toxic), 1, parts).mapInArrow(run, "id bigint, vote double").toArrow().sort_by("id")
    return scorer.calibrated(votes.column("vote").to_pylist())


def with_scores(docs: DataFrame, scorer: Scorer, text_col: str, with_evidence: bool) -> DataFrame:
    """row (a struct of the columns of `docs`), toxic_score, toxic_neighbours, toxic_nearest, toxic_evidence."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    source = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), text.alias("text"), F.xxhash64(text).alias("digest"))
    shared, curve, share = scorer.broadcast(docs.sparkSession), scorer.curve, scorer.share
    ids = scorer.ids.type
    near = pa.list_(pa.struct([("id", ids), ("cosine", pa.float64()), ("toxic", pa.bool_())]))
    kind = pa.struct([("toxic_score", pa.float64()), ("toxic_neighbours", pa.int64()), ("toxic_nearest", pa.float64()), ("toxic_evidence", near)])

    def run(batches: Iterator[Tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        scorer = shared.value
        for texts, digests in batches:
            parts = [scored(scorer, texts.slice(*piece).to_pylist(), digests.slice(*piece).to_pylist()) for piece in pieces(len(texts))]
            yield pa.concat_arrays(parts) if parts else pa.array([], kind)

    def scored(scorer: Scorer, texts: list[str], digests: list[int]) -> pa.Array:
        found = scorer.raw([scorer.vector(t) for t in texts], digests)
        columns = [pa.array([probability(v, curve, share) for *_, v in found], pa.float64()), pa.array([len(i) for i, *_ in found], pa.int64()), pa.array([float(c[0]) if len(c) else None for _, c, _ in found], pa.float64())]
        top = [(i[:EVIDENCE], c[:EVIDENCE]) for i, c, _ in found] if with_evidence else [None] * len(found)
        columns.append(pa.array([t and [{"id": scorer.ids[e].as_py(), "cosine": x, "toxic": bool(scorer.toxic[e])} for e, x in zip(t[0].tolist(), t[1].tolist(), strict=True)] for t in top], near))
        return pa.StructArray.from_arrays(columns, fields=list(kind))

    # not run twice where a score is both asked for and in a condition
    score = F.arrow_udf(run, _spark_type(kind)).asNondeterministic()
    return source.select("row", score("text", "digest").alias("found")).select("row", "found.*")


def _spark_type(kind: pa.DataType) -> T.DataType:
    from pyspark.sql.pandas.types import from_arrow_type

    return from_arrow_type(kind)


def score_documents(docs: DataFrame, scorer: Scorer, text_col: str = "text", with_evidence: bool = False) -> DataFrame:
    """The columns of `docs` with toxic_score, toxic_neighbours, toxic_nearest (cosine) and, if asked for,
    toxic_evidence: id, cosine and label of the nearest examples."""
    own = ["toxic_score", "toxic_neighbours", "toxic_nearest", "toxic_evidence"][: 3 + with_evidence]
    names = free_names(docs.columns, own)
    return with_scores(docs, scorer, text_col, with_evidence).select("row.*", *(F.col(o).alias(n) for o, n in zip(own, names, strict=True)))


def drop_toxic(docs: DataFrame, scorer: Scorer, most: float = 0.5, text_col: str = "text") -> DataFrame:
    """The rows of `docs` whose score is under `most`."""
    return with_scores(docs, scorer, text_col, False).where(F.col("toxic_score") < most).select("row.*")
