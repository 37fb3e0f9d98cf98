"""Toxicity by nearest labelled examples: exact TF-IDF cosine over a block-max inverted index.

The classifier is fitted on a bounded sample of the labelled rows (SAMPLE_TOXIC and SAMPLE_CLEAN). Every word of the texts
is a term; its weight is (1 + log tf) times what the word tells: how significantly more often toxic examples hold it (its
z-value, if positive) and NEUTRAL times its idf, so neutral and clean words count in dot products and norms as well
(supervised term weighting, Debole and Sebastiani 2003). Examples lie in blocks. Short posting lists are read; of long ones
the index knows the largest weight in each block. A text is compared with the blocks of the highest bounds first, which
gives a floor, and of the others only those are opened whose bound reaches it. Votes are weighted by similarity and by how
many labelled rows an example stands for; a monotone curve fitted on the examples themselves, each left out of its own
vote, turns votes into probabilities.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from poseframe.llm.common import pieces, utf8, word_hashes

#: Labelled rows of each class that are examples at most.
SAMPLE_TOXIC, SAMPLE_CLEAN = 1500, 3000
#: Weight of a word's idf beside what it says about the class.
NEUTRAL = 0.02
NEIGHBOURS, BLOCK = 15, 64
#: A posting list is long, and read by blocks, from this share of the examples. Blocks that are opened for a first floor.
LONG, FIRST = 1 / 32, 2
#: Votes of no opinion that stand beside the neighbours' (as similarity of clean examples).
DOUBT = 0.05
FOLDS = 5
#: Bytes of text and rows that are worked on together.
PIECE, ROWS = 1 << 19, 256
#: Bytes that aren't part of a word: ASCII but for letters and digits.
BREAK = np.ones(256, bool)
BREAK[128:] = False
BREAK[np.r_[48:58, 65:91, 97:123]] = False


def held_out(doc_id: Column) -> Column:
    """Whether a row's label must not be learned from."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % FOLDS == 0, F.lit(False))


def terms(arr: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, term, tf) of the words of all rows, terms as 64-bit hashes, by row and term."""
    words, rows = word_hashes(*utf8(arr), BREAK)
    order = np.lexsort((words, rows))
    words, rows = words[order], rows[order]
    heads = np.flatnonzero(np.r_[True, (words[1:] != words[:-1]) | (rows[1:] != rows[:-1])][: len(words)])
    return rows[heads], words[heads], np.diff(np.r_[heads, len(words)]).astype(float)


def _parts(batches: Iterator[pa.RecordBatch], text: int) -> Iterator[pa.RecordBatch]:
    for b in pieces(batches, text, PIECE):
        yield from (b.slice(lo, ROWS) for lo in range(0, max(1, b.num_rows), ROWS))


def _listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in _parts(batches, 2):
        row, term, tf = terms(b.column(2))
        ends = pa.array(np.searchsorted(row, np.arange(b.num_rows + 1)).astype(np.int32))
        lists = [pa.ListArray.from_arrays(ends, pa.array(x)) for x in (term.view(np.int64), tf.astype(np.int32))]
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *lists], ["doc_id", "toxic", "terms", "tf"])


@dataclass
class Index:
    """A block-max inverted index over the examples, and what turns votes into scores."""

    terms: np.ndarray  # sorted
    value: np.ndarray  # of each term
    unknown: float  # value of a term that no example has
    column: np.ndarray  # of each term with a long list, in heavy and peaks; -1: short
    heavy: np.ndarray  # example x column: weights of the long lists
    peaks: np.ndarray  # column x block: their largest
    starts: np.ndarray  # of each term's postings; none of the long ones
    example: np.ndarray
    weight: np.ndarray
    ids: np.ndarray
    toxic: np.ndarray
    stands_for: np.ndarray
    knots: np.ndarray
    values: np.ndarray

    def nearest(self, row: np.ndarray, term: np.ndarray, tf: np.ndarray, n: int, without: np.ndarray | None = None) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each of n texts the NEIGHBOURS most similar examples (ties: the smaller place) and their cosines; none at 0.

        without: the place of an example for each text that doesn't count.
        """
        size = len(self.ids)
        if not size:
            return [(np.zeros(0, np.int64), np.zeros(0))] * n
        at = np.minimum(np.searchsorted(self.terms, term), len(self.terms) - 1)
        known = self.terms[at] == term
        w = (1 + np.log(tf)) * np.where(known, self.value[at], self.unknown)
        w /= np.sqrt(np.bincount(row, w * w, n))[row]
        row, at, w = row[known], at[known], w[known]
        wide = len(self.heavy)  # whole blocks
        long = self.column[at] >= 0
        query = np.zeros((n, self.heavy.shape[1]), np.float32)
        query[row[long], self.column[at[long]]] = w[long]
        lens = self.starts[at + 1] - self.starts[at]
        post = np.repeat(self.starts[at] - (np.cumsum(lens) - lens), lens) + np.arange(lens.sum())
        cell = np.repeat(row * wide, lens) + self.example[post]
        read = np.bincount(cell, np.repeat(w, lens) * self.weight[post], n * wide).reshape(n, wide)
        bound = read.reshape(n, wide // BLOCK, BLOCK).max(axis=2) + query @ self.peaks
        cos = np.full((n, wide), -1.0)

        def open_blocks(which: np.ndarray) -> None:
            for k in np.flatnonzero(which.any(axis=0)):
                of, span = np.flatnonzero(which[:, k]), slice(k * BLOCK, (k + 1) * BLOCK)
                cos[of, span] = read[of, span] + query[of] @ self.heavy[span].T
            if without is not None:
                cos[np.arange(n), without] = -1.0

        first = np.zeros(bound.shape, bool)
        np.put_along_axis(first, np.argsort(-bound, axis=1, kind="stable")[:, :FIRST], True, axis=1)
        open_blocks(first)
        k = min(NEIGHBOURS, wide) - 1
        floor = -np.partition(-cos, k, axis=1)[:, k]
        open_blocks(~first & (bound >= floor[:, None] - 1e-5))
        floor = -np.partition(-cos, k, axis=1)[:, k]
        out = []
        for i in range(n):
            found = np.flatnonzero(cos[i, :size] >= max(floor[i], 1e-9))
            top = found[np.argsort(-cos[i, found], kind="stable")[:NEIGHBOURS]]
            out.append((top, np.minimum(cos[i, top], 1.0)))
        return out

    def vote(self, top: np.ndarray, cos: np.ndarray) -> float:
        w = cos / (1.05 - cos) * self.stands_for[top]
        return float((w * self.toxic[top]).sum() / (w.sum() + DOUBT))

    def score(self, vote: float) -> float:
        return float(np.interp(vote, self.knots, self.values))


def _monotone(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The non-decreasing curve nearest to (x, y) by pooling neighbours; at most 64 knots."""
    order = np.argsort(x, kind="stable")
    edges = np.unique(np.quantile(x, np.linspace(0, 1, 33)))
    pools: list[list[float]] = []
    for at in np.split(order, np.searchsorted(x[order], edges[:-1], side="right")):
        if len(at):
            pools.append([w[at].sum(), (w[at] * y[at]).sum(), (w[at] * x[at]).sum()])
            while len(pools) > 1 and pools[-2][1] * pools[-1][0] > pools[-1][1] * pools[-2][0]:
                pools[-2:] = [[a + b for a, b in zip(*pools[-2:], strict=True)]]
    return np.array([p[2] / p[0] for p in pools]), np.array([(p[1] + 0.01) / (p[0] + 0.02) for p in pools])


def fit(docs: DataFrame, labels: DataFrame) -> Index:
    """Learn from the labelled rows that aren't held out; a bounded sample of each class, chosen by hash."""
    spark = docs.sparkSession
    known = labels.where("doc_id is not null and toxic is not null").where(~held_out(F.col("doc_id")))
    known = known.groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    total = {r["toxic"]: r["n"] for r in known.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    key = F.md5(F.col("doc_id").cast("string"))
    picked = known.where("toxic = 1").orderBy(key, "doc_id").limit(SAMPLE_TOXIC).union(known.where("toxic = 0").orderBy(key, "doc_id").limit(SAMPLE_CLEAN))
    rows = picked.collect()  # SAMPLE_TOXIC + SAMPLE_CLEAN pairs of numbers at most
    small = F.broadcast(spark.createDataFrame(rows, "doc_id long, toxic int"))
    texts = docs.select("doc_id", "text").join(small, "doc_id").select("doc_id", "toxic", "text")
    got = texts.mapInArrow(_listed, "doc_id long, toxic int, terms array<long>, tf array<int>").toArrow().combine_chunks()  # the examples
    got = got.take(pa.compute.sort_indices(got, [("doc_id", "ascending")]))
    ids, toxic = got.column("doc_id").to_numpy(), got.column("toxic").to_numpy().astype(float)
    lens = pa.compute.list_value_length(got.column("terms")).to_numpy().astype(np.int64)
    flat = lambda c, kind: pa.compute.list_flatten(got.column(c)).to_numpy().astype(kind)
    term, tf = flat("terms", np.int64).view(np.uint64), flat("tf", np.float32)
    del got
    pa.default_memory_pool().release_unused()
    return index_of(ids, toxic, np.repeat(np.arange(len(ids), dtype=np.int32), lens), term, tf, total)


def index_of(ids: np.ndarray, toxic: np.ndarray, row: np.ndarray, term: np.ndarray, tf: np.ndarray, total: dict[int, int]) -> Index:
    """The index over examples (ids, toxic) with terms (row, term, tf); total: labelled rows of each class."""
    size = len(ids)
    n1 = toxic.sum()
    n0 = size - n1
    every, at = np.unique(term, return_inverse=True)
    at = at.astype(np.int32)
    df, t = np.bincount(at, minlength=len(every)), np.bincount(at, toxic[row], len(every))
    idf = np.log((size + 1) / (df + 1)) + 1
    p = n1 / max(size, 1)
    lean = np.maximum((t - df * p) / np.sqrt(df * p * (1 - p) + 1e-9), 0)
    value = lean + NEUTRAL * idf
    w = (1 + np.log(tf)) * value[at]
    w /= np.sqrt(np.bincount(row, w * w, size))[row]
    # examples with alike terms get neighbouring places, so that blocks differ
    lead = np.zeros(size, np.int64)
    by = np.lexsort((w, row))
    lead[row[by]] = at[by]
    order = np.lexsort((ids, lead, toxic))
    place = np.empty(size, np.int64)
    place[order] = np.arange(size)
    ids, toxic, row = ids[order], toxic[order], place[row]
    long = np.flatnonzero(df > max(LONG * size, BLOCK))
    column = np.full(len(every), -1)
    column[long] = np.arange(len(long))
    heavy = np.zeros((-(-size // BLOCK) * BLOCK, len(long)), np.float32)
    dense = column[at] >= 0
    heavy[row[dense], column[at[dense]]] = w[dense]
    by = np.lexsort((row, at))
    by = by[~dense[by]]
    starts = np.searchsorted(at[by], np.arange(len(every) + 1))
    stands = np.where(toxic > 0, total.get(1, 0) / max(n1, 1), total.get(0, 0) / max(n0, 1))
    peaks = heavy.reshape(len(heavy) // BLOCK, BLOCK, len(long)).max(axis=1, initial=0).T
    unknown = NEUTRAL * (np.log(size + 1) + 1)
    index = Index(every, value, unknown, column, heavy, peaks, starts, row[by], w[by].astype(np.float32), ids, toxic, stands, np.array([0.0]), np.array([0.0]))
    # the curve: votes for each example without itself
    by = np.argsort(row, kind="stable")
    ends = np.searchsorted(row[by], np.arange(size + 1))
    votes: list[float] = []
    for lo in range(0, size, ROWS // 4):  # a few at a time: this runs on the driver
        n = min(ROWS // 4, size - lo)
        own = by[ends[lo] : ends[lo + n]]
        votes += [index.vote(*x) for x in index.nearest(row[own] - lo, term[own], tf[own], n, lo + np.arange(n))]
    if sum(stands) > 0:
        index.knots, index.values = _monotone(np.array(votes), toxic, stands)
    return index


def _scored(index: Index, texts: pa.Array) -> tuple[np.ndarray, list[list[dict]]]:
    row, term, tf = terms(texts)
    near = index.nearest(row, term, tf, len(texts))
    scores = np.array([index.score(index.vote(*x)) for x in near])
    return scores, [[{"doc_id": int(index.ids[t]), "cosine": float(c), "toxic": int(index.toxic[t])} for t, c in zip(top[:3], cos[:3], strict=True)] for top, cos in near]


def _scorer(shared) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    shape = pa.list_(pa.struct([("doc_id", pa.int64()), ("cosine", pa.float64()), ("toxic", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = Index(**shared.value)
        for b in _parts(batches, 1):
            scores, evidence = _scored(index, b.column(1))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(scores, pa.float64()), pa.array(evidence, shape)], ["doc_id", "score", "evidence"])

    return run


def toxicity_scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Per document: doc_id, held_out, score, predicted, evidence (the nearest examples with their labels).

    A null or blank text, and one that shares no word with any example, gets the score of a vote of 0. Repeated rows are
    scored alike; labels that repeat a doc_id count once, toxic if any says so; a null doc_id is not held out. With no
    labels every score is 0. An empty table gives an empty result. Other columns are ignored.
    """
    index = docs.sparkSession.sparkContext.broadcast(vars(fit(docs, labels)))
    scored = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(
        _scorer(index), "doc_id long, score double, evidence array<struct<doc_id:long,cosine:double,toxic:int>>"
    )
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "evidence")


def toxic_removed(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """docs without the documents that are predicted toxic; rows of one doc_id are judged one by one.

    The text is scored beside its row, so no join decides what goes.
    """
    index = docs.sparkSession.sparkContext.broadcast(vars(fit(docs, labels)))
    text = docs.columns.index("text")

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Index(**index.value)
        for b in _parts(batches, text):
            yield b.filter(pa.array(_scored(own, b.column(text))[0] < 0.5))

    return docs.mapInArrow(keep, docs.schema)
