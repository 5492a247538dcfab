"""Weighted MinHash by hashed darts, and near-duplicate classes by banded joining.

A document is a weighted set: its elements are hashes of five consecutive words, its weights how
often each occurs. The plane over (weight, rank) of each element is cut into regions: unit steps of
weight, and rank bands [0, 1/64), [1/64, 1/32), [1/32, 1/16) and so on, that double. A region holds
a Poisson number of darts; number, rank, weight and coordinate of each are hashes of the region, so
every document sees the same darts. The signature keeps, for each of K coordinates, the earliest
dart (lowest rank) under the document's weights. Bands are thrown until all coordinates are filled,
which takes about K log K darts for any document, and a coordinate agrees between two documents
with probability equal to their weighted Jaccard similarity (Christiani, DartMinHash, 2020).

Classes are the components of the graph of links: pairs of texts that share a band and whose exact
similarity (weighted, or of the plain sets) reaches the threshold. No pairs are listed within a
group: equal texts are one node, and each bucket first links its members to one centre, the member
that shares most buckets with others and so stands in the middle of its group; a centre's shingles go to
lots of LOT members, so a large group is many tasks. Only where that leaves a bucket's members in
different classes do they meet each other: in blocks of BLOCK members, a task per two blocks, so no
bucket is one task's work. A pair of them leaves it once, at its least common bucket, and only if its
packed sketches (four bits of each of SKETCH coordinates) agree as a pair at the threshold would with all
but 3 in a million chance. A text that repeats a shingle has bands and a sketch of its plain set as
well, and either measure's agreement makes a pair a candidate.

Defined results: null text counts as empty; all empty texts are one class; a text of under five
words is one element; a null id stays null and a class of null ids only has a null class id;
repeated rows share their class; other columns are carried by `drop_near_duplicates` and ignored
by `near_duplicate_classes`; an empty table gives an empty result.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideglass.llm.common import cut

SHINGLE = 5
BANDS, ROWS = 24, 5
#: Coordinates of a sketch, which only texts get whose buckets stay split.
SKETCH = 960
THRESHOLD = 0.8
FIRST_BAND = 1 / 64
WORD = re.compile(r"\w+")
U64 = np.uint64
GOLD, M1, M2 = U64(0x9E3779B97F4A7C15), U64(0xBF58476D1CE4E5B9), U64(0x94D049BB133111EB)
MASK = 2**64 - 1
NO_WORDS = U64(0x243F6A8885A308D3)
#: Members of a centre that one task compares with it; members of a split bucket that meet in one task.
LOT, BLOCK = 4096, 4096
LOT_ROWS = 20_000  # rows of small buckets that one task takes
#: Cells that one pass of darts holds in memory.
CELLS = 1_500_000


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that scatters them."""
    x = (x ^ (x >> U64(30))) * M1
    x = (x ^ (x >> U64(27))) * M2
    return x ^ (x >> U64(31))


def unit(x: np.ndarray) -> np.ndarray:
    return (x >> U64(11)).astype(np.float64) * 2.0**-53


def poisson_steps(mean: float) -> np.ndarray:
    term, total, steps = np.exp(-mean), 0.0, []
    for k in range(1, 40):
        total += term
        steps.append(total)
        term *= mean / k
        if term < 1e-18:
            break
    return np.array(steps)


def darts(cells: np.ndarray, part: np.ndarray | None, owner: np.ndarray, n: int, k: int) -> np.ndarray:
    """Signatures (n, k) of n documents. cells: hashes of (element, unit of weight), sorted by owner;
    part: how much of its unit a cell covers (None: all of it). Each owner has a cell."""
    best = np.full(n * k, np.inf)
    won = np.zeros(n * k, U64)
    low, width, region = 0.0, FIRST_BAND, 0
    while len(cells):
        region += 1
        seed = U64(region * int(M1) & MASK)
        count = np.searchsorted(poisson_steps(width), unit(mix(cells ^ seed)), side="right")
        hit, dart = np.flatnonzero(count), 0
        while len(hit):
            dart += 1
            h = mix(cells[hit] + U64(int(seed) + dart * int(GOLD) & MASK))
            rank = low + width * unit(mix(h + M2))
            who = hit
            if part is not None:
                under = unit(mix(h + GOLD)) < part[hit]
                h, rank, who = h[under], rank[under], hit[under]
            slot = owner[who] * k + (h % U64(k)).astype(np.int64)
            np.minimum.at(best, slot, rank)
            first = rank == best[slot]
            won[slot[first]] = h[first]
            hit = hit[count[hit] > dart]
        low += width
        width = min(low, 1.0)
        open_ = ~np.isfinite(best.reshape(n, k)).all(axis=1)
        keep = open_[owner]
        cells, owner = cells[keep], owner[keep]
        part = None if part is None else part[keep]
    return won.reshape(n, k)


def weighted_signatures(elements: np.ndarray, weights: np.ndarray, owner: np.ndarray, n: int, k: int) -> np.ndarray:
    """Signatures of documents with real weights; elements are 64-bit hashes, sorted by owner."""
    units = np.maximum(np.ceil(weights), 1).astype(np.int64)
    at = np.repeat(np.arange(len(elements)), units)
    step = np.arange(len(at)) - np.repeat(np.cumsum(units) - units, units)
    part = np.clip(weights[at] - step, 0.0, 1.0)
    cells = mix(elements[at] + step.astype(U64) * GOLD)
    return darts(cells, None if (part == 1.0).all() else part, owner[at], n, k)


class WordHashes(dict):
    """64-bit hashes of words; starts anew when it has grown large."""

    def __missing__(self, word: str) -> int:
        import xxhash

        if len(self) > 500_000:
            self.clear()
        self[word] = found = xxhash.xxh64_intdigest(word)
        return found


def words_of(text: str) -> list[str]:
    return WORD.findall(low := text.lower()) or low.split()


def shingles(words: list[str], hashes: WordHashes, size: int = SHINGLE) -> np.ndarray:
    """Sorted hashes of all runs of `size` words, repeated ones included; a short text is one run."""
    h = np.fromiter(map(hashes.__getitem__, words), U64, len(words))
    if not len(h):
        return np.array([NO_WORDS])
    if len(h) < size:
        h = mix(np.array([hash_run(h)], U64))
    else:
        n = len(h) - size + 1
        run = h[:n].copy()
        for i in range(1, size):
            run = run * M2 + h[i : i + n]
        h = mix(run)
    h.sort()
    return h


def hash_run(h: np.ndarray) -> int:
    run = len(h)
    for x in h.tolist():
        run = (run * int(M1) + x) & MASK
    return run


def nth_of_equal(h: np.ndarray) -> np.ndarray | None:
    """For sorted hashes, how many equal ones stand before each; None if all differ."""
    new = np.empty(len(h), bool)
    new[0] = True
    np.not_equal(h[1:], h[:-1], out=new[1:])
    if new.all():
        return None
    at = np.arange(len(h))
    return at - np.maximum.accumulate(np.where(new, at, 0))


def band_hashes(signature: np.ndarray, bands: int, rows: int) -> np.ndarray:
    n = len(signature)
    cubes = signature.reshape(n, bands, rows)
    found = np.broadcast_to(np.arange(1, bands + 1, dtype=U64) * GOLD, (n, bands)).copy()
    for r in range(rows):
        found = mix(found + cubes[:, :, r])
    return found.view(np.int64)


def text_signatures(texts: list[str], hashes: WordHashes, coordinates: int, size: int = SHINGLE):
    """(first text, signatures) of whole texts, lot by lot."""
    cells: list[np.ndarray] = []
    start = held = 0
    for i, text in enumerate(texts):
        h = shingles(words_of(text), hashes, size)
        nth = nth_of_equal(h)
        cells.append(mix(h) if nth is None else mix(h + nth.astype(U64) * GOLD))
        held += len(h)
        if held > CELLS or i + 1 == len(texts):
            owner = np.repeat(np.arange(len(cells)), [len(c) for c in cells])
            yield start, darts(np.concatenate(cells), None, owner, len(cells), coordinates)
            cells, start, held = [], i + 1, 0


def text_bands(texts: list[str], hashes: WordHashes, bands: int, rows: int, size: int = SHINGLE) -> np.ndarray:
    """Band hashes (texts, bands)."""
    out = np.empty((len(texts), bands), np.int64)
    for start, signature in text_signatures(texts, hashes, bands * rows, size):
        out[start : start + len(signature)] = band_hashes(signature, bands, rows)
    return out


def both_signatures(texts: list[str], hashes: WordHashes, coordinates: int, size: int = SHINGLE):
    """(first text, weighted signatures, the texts that repeat a shingle, signatures of their plain sets), lot by lot.

    Without repeated shingles the plain signature is the weighted one."""
    cells: list[np.ndarray] = []
    sets: list[np.ndarray] = []
    repeats: list[int] = []
    start = held = 0
    for i, text in enumerate(texts):
        h = shingles(words_of(text), hashes, size)
        nth = nth_of_equal(h)
        if nth is not None:
            repeats.append(i - start)
            sets.append(mix(h[nth == 0]))
            held += len(sets[-1])
        cells.append(mix(h) if nth is None else mix(h + nth.astype(U64) * GOLD))
        held += len(h)
        if held > CELLS or i + 1 == len(texts):
            every = cells + sets
            owner = np.repeat(np.arange(len(every)), [len(c) for c in every])
            found = darts(np.concatenate(every), None, owner, len(every), coordinates)
            yield start, found[: len(cells)], np.array(repeats, np.int64), found[len(cells) :]
            cells, sets, repeats, start, held = [], [], [], i + 1, 0


def text_buckets(texts: list[str], hashes: WordHashes, bands: int, rows: int, size: int = SHINGLE) -> list[np.ndarray]:
    """Band hashes of each text by its weights, then those by its plain set that differ."""
    out: list[np.ndarray] = []
    for start, weighted, repeats, plain in both_signatures(texts, hashes, bands * rows, size):
        out += list(band_hashes(weighted, bands, rows))
        for i, found in zip(repeats.tolist(), band_hashes(plain, bands, rows), strict=True):
            mine = out[start + i]
            out[start + i] = np.concatenate([mine, found[found != mine]])
    return out


def similarity(a: np.ndarray, b: np.ndarray) -> float:
    """The larger of weighted and plain Jaccard similarity of two sorted arrays of shingle hashes."""
    (x, n), (y, m) = np.unique(a, return_counts=True), np.unique(b, return_counts=True)
    _, i, j = np.intersect1d(x, y, assume_unique=True, return_indices=True)
    both = np.minimum(n[i], m[j]).sum()
    return max(both / (len(a) + len(b) - both), len(i) / (len(x) + len(y) - len(i)))


def packed(signature: np.ndarray) -> np.ndarray:
    """Four bits of each coordinate, 16 coordinates to a long."""
    n, k = signature.shape
    nibbles = np.zeros((n, -(-k // 16) * 16), U64)
    # a dart's coordinate fixes the low bits of its hash
    nibbles[:, :k] = (signature >> U64(40)) & U64(15)
    return np.bitwise_or.reduce(nibbles.reshape(n, -1, 16) << (np.arange(16, dtype=U64) * U64(4)), axis=2).view(np.int64)


def least_agreement(threshold: float, k: int, deviations: float = 4.5) -> int:
    """Agreeing nibbles that a pair at the threshold has, but for a chance of 3 in a million."""
    p = threshold + (1 - threshold) / 16
    return int(np.floor(k * p - deviations * np.sqrt(k * p * (1 - p))))


def differing(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Number of nibbles in which packed sketches differ, along the last axis."""
    x = a ^ b
    x |= x >> U64(1)
    x |= x >> U64(2)
    x &= U64(0x1111111111111111)
    return np.bitwise_count(x).sum(-1, dtype=np.int64)


def agreeing(a: np.ndarray, b: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """(rows of a, rows of b) whose sketches agree as a pair at the threshold would; most fail on a quarter."""
    quarter, limits = SKETCH // 64, [k - least_agreement(threshold, k) for k in (SKETCH // 4, SKETCH)]
    found = [(np.empty(0, np.int64), np.empty(0, np.int64))]
    wide = max(1, 2_000_000 // max(1, len(b) * quarter))
    for at in range(0, len(a), wide):
        i, j = np.nonzero(differing(a[at : at + wide, None, :quarter], b[None, :, :quarter]) <= limits[0])
        ok = differing(a[at + i], b[j]) <= limits[1]
        found.append((at + i[ok], j[ok]))
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    return docs.select(F.col(id_col).alias("doc_id"), F.unhex(F.md5(F.encode(text, "UTF-8"))).alias("key"), text.alias("text"))


def lists(rows: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.arange(0, rows.size + 1, rows.shape[1], dtype=np.int32)), pa.array(rows.ravel()))


def signed(source: DataFrame, bands: int, rows: int, size: int) -> DataFrame:
    """doc_id, key of the text, band hashes."""

    def run(batches):
        hashes = WordHashes()
        for batch in batches:
            found = text_buckets(batch.column(2).to_pylist(), hashes, bands, rows, size)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found, pa.list_(pa.int64()))], names=["doc_id", "key", "bands"])

    return source.mapInArrow(run, f"doc_id {source.schema['doc_id'].dataType.simpleString()}, key binary, bands array<bigint>")


def sketched(texts: DataFrame, coordinates: int, size: int) -> DataFrame:
    """key, packed sketches by weights and by plain set (null where it is the same) of texts (key, text)."""

    def run(batches):
        hashes = WordHashes()
        for batch in batches:
            sketch, plain = [], [None] * batch.num_rows
            for start, weighted, repeats, sets in both_signatures(batch.column(1).to_pylist(), hashes, coordinates, size):
                sketch += list(packed(weighted))
                for i, found in zip(repeats.tolist(), packed(sets) if len(sets) else [], strict=True):
                    plain[start + i] = found
            kind = pa.list_(pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sketch, kind), pa.array(plain, kind)], names=["key", "sketch", "plain"])

    return texts.select("key", "text").mapInArrow(run, "key binary, sketch array<bigint>, plain array<bigint>")


def shingled(texts: DataFrame, size: int) -> DataFrame:
    """key and the sorted hashes of all shingles of texts (key, text)."""

    def run(batches):
        hashes = WordHashes()
        for batch in batches:
            found = [shingles(words_of(t), hashes, size).view(np.int64) for t in batch.column(1).to_pylist()]
            at = np.concatenate([[0], np.cumsum([len(h) for h in found])]).astype(np.int64)
            values = pa.array(np.concatenate(found) if found else np.empty(0, np.int64))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.LargeListArray.from_arrays(pa.array(at), values).cast(pa.list_(pa.int64()))], names=["key", "shingles"])

    return texts.select("key", "text").mapInArrow(run, "key binary, shingles array<bigint>")


def verified(pairs: DataFrame, texts: DataFrame, threshold: float, size: int) -> DataFrame:
    """The pairs (a, b) of keys whose texts are similar enough. A centre b comes with its shingles, once for
    each lot of LOT members, so the members of a large group are dealt to many tasks."""
    lots = pairs.groupBy("b").agg(F.ceil(F.count(F.lit(1)) / LOT).cast("int").alias("lots"))
    wanted = texts.join(lots.select(F.col("b").alias("key")), "key", "left_semi")
    centres = shingled(wanted, size).withColumnRenamed("key", "b").join(lots, "b").withColumn("lot", F.explode(F.sequence(F.lit(0), F.col("lots") - 1))).select("b", "lot", F.col("shingles").alias("centre"))
    dealt = pairs.join(lots, "b").select("a", "b", F.pmod(F.xxhash64("a"), F.col("lots")).cast("int").alias("lot"))
    left = texts.select(F.col("key").alias("a"), F.col("text").alias("text_a"))
    both = dealt.join(left, "a").join(centres.hint("merge"), ["b", "lot"]).select("a", "b", "text_a", "centre")

    def run(batches):
        hashes, last, last_b = WordHashes(), None, None
        for batch in batches:
            a, b, text_a, centre = batch.columns
            ok = []
            for i in range(batch.num_rows):
                # rows come sorted by centre from the join
                if (k := b[i].as_py()) != last_b:
                    last_b, last = k, centre[i].values.to_numpy().view(U64)
                ok.append(similarity(shingles(words_of(text_a[i].as_py()), hashes, size), last) >= threshold - 1e-12)
            yield pa.RecordBatch.from_arrays([a, b], names=["a", "b"]).filter(pa.array(ok, pa.bool_()))

    return both.mapInArrow(run, "a binary, b binary")


def components(edges: DataFrame, name: str) -> DataFrame:
    """key, label: the smallest key of each component of undirected edges (a, b); only keys with edges.

    Minimum labels with pointer jumping; each round is written to the shared folder."""
    both = cut(edges.select("a", "b").union(edges.select("b", "a")).distinct(), f"{name}-edges")
    labels = cut(both.groupBy(F.col("a").alias("key")).agg(F.min("b").alias("m")).select("key", F.least("key", "m").alias("label")), f"{name}-labels")
    while True:
        near = both.join(labels.select(F.col("key").alias("b"), "label"), "b").groupBy(F.col("a").alias("key")).agg(F.min("label").alias("near"))
        step = labels.join(near, "key").select("key", F.col("label").alias("was"), F.least("label", "near").alias("label"))
        jump = labels.select(F.col("key").alias("label"), F.col("label").alias("far"))
        step = cut(step.join(jump, "label", "left").select("key", "was", F.least("label", F.coalesce("far", "label")).alias("label")), f"{name}-labels")
        labels = step.select("key", "label")
        if step.where("was != label").isEmpty():
            return labels


def met(members: DataFrame, threshold: float) -> DataFrame:
    """Pairs (a, b) of different classes whose sketches agree, each at its least common bucket.

    members: bucket, key, label, blocks, block, bands, sketch, plain. A cell is a pair of blocks of a bucket;
    a large bucket's cells are tasks of their own, small ones share tasks of about LOT_ROWS rows."""
    lots = max(1, -(-members.count() // LOT_ROWS))
    cells = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda o: F.struct(F.least("block", o).alias("low"), F.greatest("block", o).alias("high")))
    rows = members.withColumn("cell", F.explode(cells)).select("bucket", "cell.low", "cell.high", "block", "key", "label", "bands", "sketch", F.coalesce("plain", "sketch").alias("plain"), F.col("plain").isNotNull().alias("repeats"), "blocks")
    lot = F.when(F.col("blocks") == 1, F.pmod(F.xxhash64("bucket"), F.lit(lots))).otherwise(F.xxhash64("bucket", "low", "high"))

    def run(table: pa.Table) -> pa.Table:
        columns = {c: table.column(c).combine_chunks() for c in table.column_names}
        bucket, low, high, block = (columns[c].to_numpy() for c in ("bucket", "low", "high", "block"))
        sketch, plain = (columns[c].flatten().to_numpy().view(U64).reshape(len(bucket), -1) for c in ("sketch", "plain"))
        repeats = np.array(columns["repeats"].to_pylist(), bool)
        label = columns["label"].dictionary_encode().indices.to_numpy()
        order = np.lexsort((high, low, bucket))
        new = np.flatnonzero((np.diff(bucket[order]) != 0) | (np.diff(low[order]) != 0) | (np.diff(high[order]) != 0)) + 1
        out: list[tuple[bytes, bytes]] = []
        for rows in np.split(order, new):
            one, two = rows[block[rows] == low[rows[0]]], rows[block[rows] == high[rows[0]]]
            pairs = [agreeing(sketch[one], sketch[two], threshold)]
            if repeats[rows].any():
                pairs.append(agreeing(plain[one], plain[two], threshold))
            seen = set()
            for i, j in zip(*(np.concatenate(x).tolist() for x in zip(*pairs, strict=True)), strict=True):
                x, y = int(one[i]), int(two[j])
                a, b = columns["key"][x].as_py(), columns["key"][y].as_py()
                if label[x] == label[y] or (low[x] == high[x] and a >= b) or (a, b) in seen:
                    continue
                seen.add((a, b))
                # the least, as the two may stand the other way round in another bucket
                if min({*columns["bands"][x].as_py()} & {*columns["bands"][y].as_py()}) == bucket[x]:
                    out.append((a, b))
        return pa.table({"a": pa.array([a for a, _ in out], pa.binary()), "b": pa.array([b for _, b in out], pa.binary())})

    return rows.withColumn("lot", lot).groupBy("lot").applyInArrow(run, "a binary, b binary")


def classes_of_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD, bands: int = BANDS, rows: int = ROWS, size: int = SHINGLE) -> tuple[DataFrame, DataFrame]:
    """(doc_id, key) of all rows, and (key, winner) of all texts: winner is the least (doc_id, key) of the class."""
    source = keyed(docs, id_col, text_col)
    signs = cut(signed(source, bands, rows, size), "signs")
    nodes = cut(signs.groupBy("key").agg(F.min("doc_id").alias("doc_id"), F.any_value("bands").alias("bands")), "nodes")
    spread = nodes.select("key", F.explode("bands").alias("bucket"))
    crowded = spread.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    members = cut(spread.join(crowded, "bucket"), "members")
    popular = members.groupBy("key").agg(F.struct(F.sum("n"), "key").alias("rank"))
    centres = members.select("bucket", "key").join(popular, "key").groupBy("bucket").agg(F.max("rank")["key"].alias("centre"))

    # the nodes that share a bucket, and their texts, fetched once through a row that has each of them
    crowd = cut(nodes.join(members.select("key").distinct(), "key"), "crowd")
    wanted = crowd.select(F.col("key").alias("want"), F.col("doc_id").alias("at"))
    have = source.join(wanted, F.col("doc_id").eqNullSafe(F.col("at"))).where("key = want")
    texts = cut(have.select("key", "text").dropDuplicates(["key"]), "texts")

    pairs = members.join(centres, "bucket").where("key != centre").select(F.col("key").alias("a"), F.col("centre").alias("b")).distinct()
    edges = cut(verified(pairs, texts, threshold, size), "edges")
    labels = components(edges, "first")

    # members of buckets that span classes meet each other, block by block
    of = members.join(labels, "key", "left").select("bucket", "key", F.coalesce("label", "key").alias("label"))
    split = of.groupBy("bucket").agg(F.min("label").alias("p"), F.max("label").alias("q"), F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks")).where("p != q").select("bucket", "blocks")
    apart = cut(of.join(split, "bucket").withColumn("block", F.pmod(F.xxhash64("key"), F.col("blocks")).cast("int")), "apart")
    sketches = cut(sketched(texts.join(apart.select("key").distinct(), "key"), SKETCH, size), "sketches")
    sides = cut(apart.join(crowd.select("key", "bands").join(sketches, "key"), "key"), "meeting")
    more = cut(verified(cut(met(sides, threshold), "met"), texts, threshold, size), "edges")
    if not more.isEmpty():
        labels = components(edges.union(more), "next")

    of = nodes.select("key", "doc_id").join(labels, "key", "left").select("key", F.struct("doc_id", "key").alias("row"), F.coalesce("label", "key").alias("label"))
    winner = of.groupBy("label").agg(F.min_by("row", F.struct(F.col("row.doc_id").isNull(), F.col("row"))).alias("winner"))
    return signs.select("doc_id", "key"), of.join(winner, "label").select("key", "winner")


def near_duplicate_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD, bands: int = BANDS, rows: int = ROWS, size: int = SHINGLE) -> DataFrame:
    """doc_id, class_id (the least doc_id of the class) of every row."""
    every, found = classes_of_texts(docs, id_col, text_col, threshold, bands, rows, size)
    return every.join(found, "key").select("doc_id", F.col("winner.doc_id").alias("class_id"))


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD, bands: int = BANDS, rows: int = ROWS, size: int = SHINGLE) -> DataFrame:
    """The rows of `docs` that stay: one of each class, the one with the least id."""
    _, found = classes_of_texts(docs, id_col, text_col, threshold, bands, rows, size)
    stay = found.where("key = winner.key").select(F.col("winner.doc_id").alias("at"), F.col("key").alias("want"))
    key = F.unhex(F.md5(F.encode(F.coalesce(F.col(text_col).cast("string"), F.lit("")), "UTF-8")))
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), F.col(id_col).alias("id"), key.alias("key"))
    kept = rows.join(stay, F.col("id").eqNullSafe(F.col("at"))).where("key = want")
    return kept.dropDuplicates(["at", "want"]).select("row.*")
