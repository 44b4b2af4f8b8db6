"""Toxicity: nearest labelled examples by exact TF-IDF cosine over a block-max inverted index."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm._spark import frame, trim
from plumbline.llm._words import Words, freeze, ranges, raw, short, thaw

#: Labelled rows that the index is fitted on: about so many, chosen by a hash of doc_id, however many there are.
MAX_LABELLED = 2_000
#: Besides whole words, the first letters of longer ones are terms.
STEMS = (5,)
NEIGHBOURS = 32
BLOCK = 64
#: Blocks that a search reads first; then ever four times as many.
FIRST_BLOCKS = 8
#: Examples, at most twice as many, whose own votes calibrate the scores.
CALIBRATED = 1_000
EVIDENCE = 5
SLICE_BYTES = 4 << 20
MAYBE_BITS = 22


def term_weights(docs: np.ndarray, toxic_docs: np.ndarray, n: int, toxic: int) -> np.ndarray:
    """idf of terms in so many of n examples, raised for terms whose examples are toxic more often than all: times 1 + the
    square of the log of that ratio (two examples of the common rate are added to each). No term is left out."""
    rate = max(toxic, 1) / max(n, 1)
    ratio = (toxic_docs + 2 * rate) / (docs + 2) / rate
    return (np.log((1 + n) / (1 + docs)) + 1) * (1 + np.maximum(0, np.log(ratio)) ** 2)


class Index:
    """Examples with their term weights: postings by term, cut into cells by blocks of examples, with each cell's largest weight.

    terms: sorted hashes of all terms of the examples; a document's weights are (1 + ln tf) * weight, scaled to length 1.
    """

    def __init__(self, terms: np.ndarray, weight: np.ndarray, example: np.ndarray, term: np.ndarray, tf: np.ndarray, doc_ids: np.ndarray, toxic: np.ndarray):
        """example, term, tf: one entry for each term of each example that has any; doc_ids, toxic: of all examples."""
        self.terms, self.weight = terms, weight
        self.maybe = np.zeros(1 << MAYBE_BITS, bool)
        self.maybe[self._low(terms)] = True
        self.docs = np.bincount(term, minlength=len(terms))
        value = (1 + np.log(tf)) * weight[term]
        norm = np.sqrt(np.bincount(example, value**2, len(doc_ids)))
        has = norm > 0
        #: rates of label 1: of all examples, and of those without a term
        self.rate = (toxic.sum() + 0.1) / (len(toxic) + 1)
        self.background = (toxic[~has].sum() + 0.1) / ((~has).sum() + 1)
        value = value / norm[example]
        # examples with the same strongest term lie together, which makes the blocks' bounds sharp
        best = np.full(len(doc_ids), len(terms))
        order = np.lexsort((term, -value, example))
        firsts = order[np.unique(example[order], return_index=True)[1]]
        best[example[firsts]] = term[firsts]
        kept = np.lexsort((doc_ids, best))[: has.sum()]
        place = np.zeros(len(doc_ids), np.int64)
        place[kept] = np.arange(len(kept))
        self.doc_ids, self.toxic = doc_ids[kept], toxic[kept].astype(float)
        at, by = place[example], np.lexsort((place[example], term))
        self.at, self.value = at[by].astype(np.int32), value[by].astype(np.float32)
        self.blocks = -(-len(kept) // BLOCK)
        cell = term[by] * max(1, self.blocks) + self.at // BLOCK
        cells, start = np.unique(cell, return_index=True)
        self.start = np.append(start, len(cell))
        self.most = np.maximum.reduceat(self.value, start) if len(start) else self.value
        self.block = (cells % max(1, self.blocks)).astype(np.int32)
        self.cell_of = np.searchsorted(cells, np.arange(len(terms) + 1) * max(1, self.blocks))
        self.votes, self.rates = np.zeros(1), np.array([self.background])
        self._calibrate(place, example, term, tf)

    @staticmethod
    def _low(codes: np.ndarray) -> np.ndarray:
        return (codes & np.uint64((1 << MAYBE_BITS) - 1)).astype(np.int64)

    def features(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(text, term, count) of every index term that occurs in the texts, sorted."""
        words = Words(texts, lower=True, letters=True, stems=STEMS)
        docs = words.doc
        out = []
        for codes in (words.hash, *words.stems):
            hit = np.flatnonzero(self.maybe[self._low(codes)])
            if len(hit) and len(self.terms):
                term = np.minimum(np.searchsorted(self.terms, codes[hit]), len(self.terms) - 1)
                same = self.terms[term] == codes[hit]
                out.append(docs[hit[same]] * len(self.terms) + term[same])
        keys, counts = np.unique(np.concatenate(out) if out else np.zeros(0, np.int64), return_counts=True)
        n = max(1, len(self.terms))
        return keys // n, keys % n, counts

    def search(self, term: np.ndarray, tf: np.ndarray, skip: int = -1, k: int = NEIGHBOURS) -> tuple[np.ndarray, np.ndarray]:
        """Place and cosine of the k nearest examples, exactly; ties by place. skip: a place to leave out.

        Blocks are taken by falling bound, the sum of query weight times the block's largest weight, a few and then ever
        more at a time, until no other block can hold a nearer example than the k-th.
        """
        q = (1 + np.log(tf)) * self.weight[term]
        q /= np.sqrt((q**2).sum())
        n = self.cell_of[term + 1] - self.cell_of[term]
        cell = np.repeat(self.cell_of[term], n) + ranges(n)
        weight, block = np.repeat(q, n), self.block[cell]
        bound = np.bincount(block, weight * self.most[cell], self.blocks)
        order = np.argsort(-bound, kind="stable")
        order = order[bound[order] > 0]
        places, scores, at, step = np.zeros(0, np.int64), np.zeros(0), 0, FIRST_BLOCKS
        while at < len(order) and (len(places) < k or bound[order[at]] >= scores[-1] - 1e-9):
            chosen = np.zeros(self.blocks, bool)
            chosen[order[at : at + step]] = True
            own = chosen[block]
            cells = cell[own]
            size = self.start[cells + 1] - self.start[cells]
            posting = np.repeat(self.start[cells], size) + ranges(size)
            score = np.bincount(self.at[posting], np.repeat(weight[own], size) * self.value[posting], len(self.doc_ids))
            if skip >= 0:
                score[skip] = 0
            new = np.flatnonzero(score)
            places, scores = np.concatenate([places, new]), np.round(np.concatenate([scores, score[new]]), 9)
            best = np.lexsort((places, -scores))[:k]
            places, scores = places[best], scores[best]
            at, step = at + step, step * 4
        return places, scores

    def vote(self, places: np.ndarray, scores: np.ndarray) -> float:
        """Share of toxic neighbours, each weighing more the nearer it is; the common rate counts as a weak one."""
        w = scores / (1.05 - np.minimum(scores, 1.0))
        return float(((w * self.toxic[places]).sum() + 0.1 * self.rate) / (w.sum() + 0.1))

    def _calibrate(self, place: np.ndarray, example: np.ndarray, term: np.ndarray, tf: np.ndarray) -> None:
        """Isotonic map from the examples' own votes, each without itself and the terms that only it has, to their rate of toxicity."""
        votes, labels = [], []
        every = max(1, len(self.doc_ids) // CALIBRATED)
        for e, a, z in list(_runs(example))[::every]:
            shared = self.docs[term[a:z]] > 1
            if shared.any():
                votes.append(self.vote(*self.search(term[a:z][shared], tf[a:z][shared], skip=int(place[e]))))
                labels.append(self.toxic[place[e]])
        pools: list[list[float]] = []
        for i in np.argsort(votes, kind="stable"):
            pools.append([votes[i], votes[i], labels[i], 1.0])
            while len(pools) > 1 and pools[-2][2] / pools[-2][3] >= pools[-1][2] / pools[-1][3]:
                a, b = pools[-2], pools.pop()
                pools[-1] = [a[0], b[1], a[2] + b[2], a[3] + b[3]]
        if pools:
            self.votes = np.array([v for p in pools for v in p[:2]])
            self.rates = np.repeat([(p[2] + self.rate) / (p[3] + 1) for p in pools], 2)

    def score(self, texts: pa.Array) -> tuple[np.ndarray, list]:
        """Each text's score and evidence: its nearest examples as (doc_id, toxic, cosine)."""
        scores, evidence, known = np.full(len(texts), self.background), [[] for _ in range(len(texts))], {}
        text, term, tf = self.features(texts)
        for d, a, z in _runs(text):
            key = (term[a:z].tobytes(), tf[a:z].tobytes())
            if key not in known:
                places, near = self.search(term[a:z], tf[a:z])
                own = [{"doc_id": int(self.doc_ids[p]), "toxic": int(self.toxic[p]), "cosine": float(s)} for p, s in zip(places[:EVIDENCE], near, strict=False)]
                known[key] = float(np.interp(self.vote(places, near), self.votes, self.rates)), own
            scores[d], evidence[d] = known[key]
        return np.clip(scores, 0, 1), evidence


def _runs(values: np.ndarray):
    """(value, begin, end) of each run of a sorted array."""
    if len(values):
        cuts = np.concatenate([[0], np.flatnonzero(np.diff(values)) + 1, [len(values)]])
        yield from zip(values[cuts[:-1]].tolist(), cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)


def _slices(column: pa.Array):
    upto, a = raw(column)[1], 0
    while a < len(column):
        z = max(a + 1, int(np.searchsorted(upto, upto[a] + SLICE_BYTES, "right")) - 1)
        yield a, z
        a = z


def fold(folds: int = 5):
    """crc32 of doc_id as text, modulo folds; a null doc_id counts as the empty text."""
    return F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")), F.lit(folds))


def fit(docs: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED) -> Index:
    """The index over a bounded sample of the labelled rows outside fold 0, with every term of their whole texts. Of a
    doc_id's labels the largest counts, of its texts the first in order."""
    marked = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).where("toxic is not null and doc_id is not null")
    marked = marked.where(fold() != 0).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    n = marked.count()
    if n > max_labelled:
        marked = marked.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 40)) < int((1 << 40) * max_labelled / n))
    sample = frame(docs).join(F.broadcast(marked), "doc_id").groupBy("doc_id").agg(F.max("toxic").alias("toxic"), F.min("text").alias("text"))  # max_labelled bounds it

    def count(batches):
        for b in batches:
            for a, z in _slices(b["text"]):
                words = Words(b["text"].slice(a, z - a), lower=True, letters=True, stems=STEMS)
                first, blobs = words.first, []
                for lo, hi in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
                    codes, tf = np.unique(np.concatenate([words.hash[lo:hi], *(x[lo:hi] for x in words.stems)]), return_counts=True)
                    has = codes != 0
                    blobs.append(freeze(codes[has], short(tf[has])))
                yield pa.record_batch({"doc_id": b["doc_id"].slice(a, z - a), "toxic": b["toxic"].slice(a, z - a), "blob": pa.array(blobs, pa.binary())})

    rows = sample.mapInArrow(count, "doc_id long, toxic int, blob binary").toArrow().sort_by("doc_id")
    doc_ids, toxic = rows["doc_id"].to_numpy(), rows["toxic"].to_numpy() > 0
    parts = [thaw(x) for x in rows["blob"].to_pylist()]
    codes = np.concatenate([x[0] for x in parts] or [np.zeros(0, np.uint64)])
    terms, term, docs_of = np.unique(codes, return_inverse=True, return_counts=True)
    tf = np.concatenate([x[1].astype(np.int64) for x in parts] or [np.zeros(0, np.int64)])
    example = np.repeat(np.arange(len(parts)), [len(x[0]) for x in parts])
    weight = term_weights(docs_of, np.bincount(term, toxic[example], len(terms)), len(parts), int(toxic.sum()))
    del parts, codes, rows
    index = Index(terms, weight, example, term, tf, doc_ids, toxic)
    trim()
    return index


def toxicity(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """doc_id, held_out, score, predicted, evidence for every row of docs.

    Scores use the text alone. A text without any index term, a null or an empty one gets the rate of toxicity among
    such examples. Without usable labels every score is low (0.1). Repeated rows are scored each; a text of any length is
    scored whole; an empty table gives an empty result; other columns are ignored. Ties among neighbours go to the smaller
    place in the index.
    """
    index = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, **options))

    def apply(batches):
        near = pa.list_(pa.struct([("doc_id", pa.int64()), ("toxic", pa.int32()), ("cosine", pa.float64())]))
        for b in batches:
            for a, z in _slices(b["text"]):
                scores, evidence = index.value.score(b["text"].slice(a, z - a))
                yield pa.record_batch({"doc_id": b["doc_id"].slice(a, z - a), "score": pa.array(scores), "evidence": pa.array(evidence, near)})

    scored = frame(docs).mapInArrow(apply, "doc_id long, score double, evidence array<struct<doc_id:long,toxic:int,cosine:double>>")
    return scored.select("doc_id", (fold() == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "evidence")


def without_toxic(docs: DataFrame, labels: DataFrame, least: float = 0.5, **options) -> DataFrame:
    """The rows of docs, all columns unchanged, whose score is below least."""
    index = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, **options))

    def keep(batches):
        for b in batches:
            for a, z in _slices(b["text"]):
                part = b.slice(a, z - a)
                yield part.filter(pa.array(index.value.score(part["text"])[0] < least))

    return docs.mapInArrow(keep, docs.schema)


def query(spark, sf_dir: str) -> DataFrame:
    return toxicity(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
