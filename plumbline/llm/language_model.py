"""LM scoring by a hierarchical Pitman-Yor model with Gibbs-sampled Chinese-restaurant seating."""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm._spark import answer_groups, lean, map_groups, pack_groups, spool
from plumbline.llm._words import Words, freeze, mix, ranges, short, thaw

GROUP_BYTES = 8 << 20
TOKENS_PER_BUCKET = 2_000_000
END, BEGIN = (int(x) for x in mix(np.array([101, 202], np.uint64)))
FOLDS, HELD = 7, 2
STRENGTH = 1.0
BURN_IN, SAMPLES = 3, 3
#: A type with more customers is drawn anew in blocks of a sixteenth of its customers, not from its exact conditional.
MOST_SEATS = 256
#: Parts of a restaurant's types that a sweep samples one after the other; types of one part see the tables as before it.
PARTS = 4
REPLY = "g long, kind int, bucket int, d double, blob binary"


def discount(counts: np.ndarray) -> float:
    """From the numbers of types seen once and twice."""
    once, twice = int((counts == 1).sum()), int((counts == 2).sum())
    return min(0.95, max(0.05, once / (once + 2 * twice))) if once else 0.5


def log_stirling(most: int, d: float) -> np.ndarray:
    """[n, t]: log of the generalised Stirling number of n customers at t tables, the weight of all their seatings."""
    out = np.full((most + 1, most + 1), -np.inf)
    out[0, 0] = 0.0
    t = np.arange(1, most + 1)
    for n in range(most):
        with np.errstate(divide="ignore", invalid="ignore"):
            stay = out[n, 1:] + np.where(t <= n, np.log(np.maximum(n - t * d, 1e-300)), -np.inf)
        out[n + 1, 1:] = np.logaddexp(out[n, :-1], stay)
    return out


class Seating:
    """Customers of many restaurants at tables, one dish a table, sampled given the dishes' parent probabilities.

    A type is a dish in a restaurant, with count customers. Seatings of the same number of tables lead to the same
    predictions, so the state is the number of tables of each type. A Gibbs step draws it for all customers of a type at
    once, given all other types: t tables weigh S(count, t) * parent**t * the product of (strength + d * m) over the m
    tables of the restaurant from those of the others on.
    """

    def __init__(self, restaurant: np.ndarray, count: np.ndarray, d: float, strength: float, rng: np.random.Generator):
        self.restaurant, self.count, self.d, self.strength, self.rng = restaurant, count, d, strength, rng
        self.restaurants = int(restaurant.max(initial=-1)) + 1
        self.tables = np.ones(len(count), np.int64)
        small = np.flatnonzero((count > 1) & (count <= MOST_SEATS))
        self.small = [small[k::PARTS] for k in range(PARTS)]
        large = np.flatnonzero(count > MOST_SEATS)
        self.large = [large[k::PARTS] for k in range(PARTS)]
        self.stirling = log_stirling(int(count[small].max(initial=1)), d)

    def totals(self) -> np.ndarray:
        return np.bincount(self.restaurant, self.tables, self.restaurants).astype(np.int64)

    def sweep(self, parent: np.ndarray) -> None:
        """Draw the tables of every type anew."""
        whole = self.totals()
        for small, large in zip(self.small, self.large, strict=True):
            before = self.tables[small], self.tables[large]
            self.tables[small] = self._draw(small, whole[self.restaurant[small]] - before[0], parent)
            self.tables[large] = self._seat(large, whole[self.restaurant[large]] - before[1], parent)
            for types, old in zip((small, large), before, strict=True):
                np.add.at(whole, self.restaurant[types], self.tables[types] - old)

    def _draw(self, types: np.ndarray, others: np.ndarray, parent: np.ndarray) -> np.ndarray:
        """From the exact conditional."""
        if not len(types):
            return types
        n = self.count[types]
        t = ranges(n) + 1
        first = np.cumsum(n) - n
        # the log of the product of (strength / d + m) over m below each number of tables
        rising = np.concatenate([[0.0], np.cumsum(np.log(self.strength / self.d + np.arange(int((others + n).max()))))])
        weight = self.stirling[np.repeat(n, n), t] + t * np.repeat(np.log(self.d * parent[types]), n) + rising[np.repeat(others, n) + t]
        weight = np.exp(weight - np.repeat(np.maximum.reduceat(weight, first), n))
        upto = np.cumsum(weight)
        low = np.concatenate([[0.0], upto[first[1:] - 1]])
        at = np.searchsorted(upto, low + self.rng.random(len(types)) * (upto[first + n - 1] - low), "right")
        return np.clip(at - first, 0, n - 1) + 1

    def _seat(self, types: np.ndarray, others: np.ndarray, parent: np.ndarray) -> np.ndarray:
        """One customer after the other, from the 64th on in blocks."""
        tables, seated = np.ones(len(types), np.int64), 1
        count, most = self.count[types], int(self.count[types].max(initial=1))
        while seated < most:
            block = max(1, seated // 16) if seated >= 64 else 1
            live = np.flatnonzero(count > seated)
            new = (self.strength + self.d * (others[live] + tables[live])) * parent[types[live]]
            p = new / (new + np.maximum(seated - self.d * tables[live], 1e-9))
            tables[live] += self.rng.binomial(np.minimum(count[live] - seated, block), p)
            seated += block
        return tables


class Pairs:
    """Distinct (context, word) pairs of a group's texts, in order of bucket, context and word.

    where: the pair of each token; count: how often a pair occurs in training texts.
    """

    def __init__(self, rows: pa.Table, buckets: int):
        words = Words(rows["text"], lower=True)
        n, docs = len(words.hash), rows.num_rows
        self.per_doc = np.diff(words.first) + 1
        self.first = np.concatenate([[0], np.cumsum(self.per_doc)])
        self.token = np.full(n + docs, END, np.uint64)
        words.start = words.end = words.data = None  # the largest arrays: not needed any more
        self.token[np.arange(n) + words.doc] = words.hash
        context = np.full(n + docs, BEGIN, np.uint64)
        context[1:] = self.token[:-1]
        context[self.first[:-1]] = BEGIN
        self.held = np.array([zlib.crc32(("" if x is None else str(x)).encode()) % FOLDS == HELD for x in rows["doc_id"].to_pylist()], bool)
        train = np.repeat(~self.held, self.per_doc)
        del words
        self.words, of = np.unique(self.token, return_inverse=True)
        of = of.astype(np.int32)
        contexts, c = np.unique(context, return_inverse=True)
        c = c.astype(np.int32)
        del context, self.token
        bucket = ((contexts >> np.uint64(20)) % np.uint64(buckets)).astype(np.int64)
        order = np.lexsort((contexts, bucket))
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        keys, where = np.unique(place[c] * len(self.words) + of, return_inverse=True)
        del c, of
        self.where = where.astype(np.int32)
        del where
        self.count = np.bincount(self.where, train, len(keys)).astype(np.int64)
        self.context, self.word = (x.astype(np.int32) for x in np.divmod(keys, max(1, len(self.words))))
        self.contexts, self.bucket = contexts[order], bucket[order]

    def parts(self):
        """(bucket, contexts' slice, pairs' slice) of each bucket that has any."""
        numbers, first = np.unique(self.bucket, return_index=True)
        ends = np.append(first[1:], len(self.bucket))
        cut = np.searchsorted(self.context, np.append(first, len(self.bucket)))
        for k, b in enumerate(numbers.tolist()):
            yield b, slice(first[k], ends[k]), slice(cut[k], cut[k + 1])


def _pairs(buckets: int):
    def run(g: int, rows: pa.Table) -> pa.Table:
        p = Pairs(rows, buckets)
        numbers, blobs = [], []
        for b, of, at in p.parts():
            used, word = np.unique(p.word[at], return_inverse=True)
            sizes = np.bincount(p.context[at] - of.start, minlength=of.stop - of.start)
            blobs.append(freeze(p.contexts[of], short(sizes), p.words[used], short(word), short(p.count[at])))
            numbers.append(b)
        return pa.table({"bucket": pa.array(numbers, pa.int32()), "g": pa.array([g] * len(numbers), pa.int64()), "blob": pa.array(blobs, pa.binary())})

    return run


def _restaurants(word_buckets: int, seed: int):
    def run(t: pa.Table) -> pa.Table:
        """Sample the restaurants of a bucket of contexts. Sent back to each group, as whole numbers (see direct_part and root_part): the
        customers and tables of its pairs and of its contexts, tables summed over the samples. Sent on by word: its count
        in training and the tables that serve it, the customers of the root."""
        t = t.sort_by("g")
        bucket, groups = t["bucket"][0].as_py(), t["g"].to_pylist()
        parts = [thaw(x) for x in t["blob"].to_pylist()]
        contexts, c = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
        words, w = np.unique(np.concatenate([p[2] for p in parts]), return_inverse=True)
        of_pair, of_word, a, z = [], [], 0, 0
        for p in parts:
            of_pair.append(np.repeat(c[a : a + len(p[0])], p[1]))
            of_word.append(w[z : z + len(p[2])][p[3]])
            a, z = a + len(p[0]), z + len(p[2])
        keys, which = np.unique(np.concatenate(of_pair) * len(words) + np.concatenate(of_word), return_inverse=True)
        count = np.bincount(which, np.concatenate([p[4] for p in parts]), len(keys)).astype(np.int64)
        seen = np.flatnonzero(count)
        restaurant, dish, n = keys[seen] // len(words), keys[seen] % len(words), count[seen]
        rng = np.random.default_rng([seed, bucket])
        d = discount(n)

        def root(tables: np.ndarray) -> np.ndarray:
            """The root as this bucket's tables show it."""
            served = np.bincount(dish, tables, len(words))
            d0, whole, dishes = discount(served[served > 0]), served.sum(), (served > 0).sum()
            return ((np.maximum(served - d0, 0) + (STRENGTH + d0 * dishes) / (len(words) + 1)) / (STRENGTH + whole))[dish]

        tables = np.zeros(len(n), np.int64)  # summed over the samples
        if len(n):
            seating = Seating(restaurant, n, d, STRENGTH, rng)
            for k in range(BURN_IN + SAMPLES):
                seating.sweep(root(seating.tables))
                if k >= BURN_IN:
                    tables += seating.tables
        every, held = np.zeros(len(keys), np.int64), np.zeros(len(keys), np.int64)
        every[seen], held[seen] = n, tables
        whole, opened = np.bincount(restaurant, n, len(contexts)), np.bincount(restaurant, tables, len(contexts))
        out = {"g": [], "kind": [], "bucket": [], "d": [], "blob": []}
        a = z = 0
        for g, p in zip(groups, parts, strict=True):
            of, own = slice(a, a + len(p[0])), which[z : z + len(p[3])]
            out["g"].append(g)
            out["kind"].append(1)
            out["bucket"].append(bucket)
            out["d"].append(d)
            out["blob"].append(freeze(*(short(x) for x in (every[own], held[own], whole[c[of]], opened[c[of]]))))
            a, z = a + len(p[0]), z + len(p[3])
        uses, served = np.bincount(dish, n, len(words)), np.bincount(dish, tables, len(words))
        known = np.flatnonzero(uses)
        to = ((words[known] >> np.uint64(20)) % np.uint64(word_buckets)).astype(np.int64)
        for b in np.unique(to).tolist():
            own = known[to == b]
            out["g"].append(-1)
            out["kind"].append(0)
            out["bucket"].append(b)
            out["d"].append(d)
            out["blob"].append(freeze(words[own], short(uses[own]), short(served[own])))
        return pa.table({"g": pa.array(out["g"], pa.int64()), "kind": pa.array(out["kind"], pa.int32()), "bucket": pa.array(out["bucket"], pa.int32()), "d": pa.array(out["d"], pa.float64()), "blob": pa.array(out["blob"], pa.binary())})

    return run


def _vocabulary(t: pa.Table) -> pa.Table:
    """Merge what the buckets of contexts sent for a bucket of words."""
    parts = [thaw(x) for x in t["blob"].to_pylist()]
    words, at = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
    uses = np.bincount(at, np.concatenate([p[1].astype(float) for p in parts]), len(words)).astype(np.int64)
    served = np.bincount(at, np.concatenate([p[2].astype(float) for p in parts]), len(words)) / SAMPLES
    served = np.maximum(1, np.round(served)).astype(np.int64)
    return pa.table({
        "bucket": pa.array([t["bucket"][0].as_py()], pa.int32()), "words": [len(words)], "tokens": [int(uses.sum())], "served": [int(served.sum())],
        "once": [int((served == 1).sum())], "twice": [int((served == 2).sum())], "blob": pa.array([freeze(words, uses, served)], pa.binary()),
    })


def _asked(word_buckets: int):
    def run(g: int, rows: pa.Table) -> pa.Table:
        words = np.unique(np.append(Words(rows["text"], lower=True).hash, np.uint64(END)))
        to = ((words >> np.uint64(20)) % np.uint64(word_buckets)).astype(np.int64)
        order = np.argsort(to, kind="stable")
        numbers, cut = np.unique(to[order], return_index=True)
        blobs = [freeze(x) for x in np.split(words[order], cut[1:])]
        return pa.table({"bucket": pa.array(numbers.astype(np.int32)), "g": pa.array([g] * len(blobs), pa.int64()), "asked": pa.array(blobs, pa.binary())})

    return run


def root_discount(totals: dict) -> float:
    return min(0.95, max(0.05, totals["once"] / (totals["once"] + 2 * totals["twice"]))) if totals["once"] else 0.5


def _root(totals: dict, seed: int):
    """Seat the words of each bucket in the root: what each word's own tables leave it, served - d * tables."""
    d, even = root_discount(totals), 1.0 / (totals["words"] + 1)

    def run(batches):
        for b in batches:
            opened, blobs = [], []
            for bucket, blob in zip(b["bucket"].to_pylist(), b["blob"].to_pylist(), strict=True):
                words, uses, served = thaw(blob)
                # the root's dishes are one restaurant; other buckets' dishes count with one table each, which an even base makes all but sure
                seating = Seating(np.zeros(len(words), np.int64), served, d, STRENGTH + d * (totals["words"] - len(words)), np.random.default_rng([seed, 7, bucket]))
                tables = np.zeros(len(words), np.int64)
                for k in range(BURN_IN + SAMPLES):
                    seating.sweep(np.full(len(words), even))
                    if k >= BURN_IN:
                        tables += seating.tables
                opened.append(int(tables.sum()))
                blobs.append(freeze(words, short(uses), served - d * tables / SAMPLES))
            yield pa.record_batch({"bucket": b["bucket"], "opened": pa.array(opened, pa.int64()), "blob": pa.array(blobs, pa.binary())})

    return run


def chances(left: np.ndarray, totals: dict) -> np.ndarray:
    """The root's probability of words that have so much left of their own (0: unseen). Over all words and one unseen, 1."""
    d, even = root_discount(totals), 1.0 / (totals["words"] + 1)
    return (left + (STRENGTH + d * totals["opened"] / SAMPLES) * even) / (STRENGTH + totals["served"])


def direct_part(customers: np.ndarray, tables: np.ndarray, whole: np.ndarray, d: float) -> np.ndarray:
    """(c - d t) / (s + c_u) of pairs with so many customers and (over the samples) tables, in restaurants of whole customers."""
    return (customers - d / SAMPLES * tables.astype(float)) / (STRENGTH + whole)


def root_part(whole: np.ndarray, opened: np.ndarray, d: float) -> np.ndarray:
    """(s + d t_u) / (s + c_u): the weight of the root in restaurants with so many customers and (over the samples) tables."""
    return (STRENGTH + d / SAMPLES * opened.astype(float)) / (STRENGTH + whole)


def _answer(totals: dict):
    """What a bucket's words have, for the groups that asked: count in training and root probability."""

    def run(asked: pa.Table, root: pa.Table) -> pa.Table:
        if not asked.num_rows:
            return pa.table({"g": pa.array([], pa.int64()), "kind": pa.array([], pa.int32()), "bucket": pa.array([], pa.int32()), "d": pa.array([], pa.float64()), "blob": pa.array([], pa.binary())})
        words, uses, left = thaw(root["blob"][0].as_py()) if root.num_rows else (np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0))
        bucket = asked["bucket"][0].as_py()
        chance, uses = chances(np.append(left, 0.0), totals).astype(np.float32), np.append(uses, 0)
        out = []
        for blob in asked["asked"].to_pylist():
            (own,) = thaw(blob)
            at = np.searchsorted(words, own)
            found = at < len(words)
            found[found] = words[at[found]] == own[found]
            at = np.where(found, at, len(words))
            out.append(freeze(short(uses[at]), chance[at]))
        n = len(out)
        return pa.table({"g": asked["g"], "kind": pa.array([2] * n, pa.int32()), "bucket": pa.array([bucket] * n, pa.int32()), "d": pa.nulls(n, pa.float64()), "blob": pa.array(out, pa.binary())})

    return run


def _score(totals: dict, buckets: int, word_buckets: int):
    def run(g: int, rows: pa.Table, replies: pa.Table) -> pa.Table:
        p = Pairs(rows, buckets)
        pair_blobs, word_blobs = {}, {}
        for kind, b, d, blob in zip(*(replies[n].to_pylist() for n in ("kind", "bucket", "d", "blob")), strict=True):
            (pair_blobs if kind == 1 else word_blobs)[b] = d, blob
        direct, up = np.zeros(len(p.count)), np.ones(len(p.contexts))
        for b, of, at in p.parts():
            d, blob = pair_blobs[b]
            customers, tables, whole, opened = thaw(blob)
            own = p.context[at] - of.start
            direct[at], up[of] = direct_part(customers, tables, whole[own], d), root_part(whole, opened, d)
        uses, chance = np.zeros(len(p.words), np.int64), np.zeros(len(p.words), np.float32)
        to = ((p.words >> np.uint64(20)) % np.uint64(word_buckets)).astype(np.int64)
        order = np.argsort(to, kind="stable")
        numbers, cut = np.unique(to[order], return_index=True)
        for b, own in zip(numbers.tolist(), np.split(order, cut[1:]), strict=True):
            uses[own], chance[own] = thaw(word_blobs[b][1])
        pair = np.log10(direct + up[p.context] * chance[p.word].astype(float))
        base = np.log10((uses + 1.0) / (totals["tokens"] + totals["words"] + 1.0))
        word = p.word[p.where]
        add = lambda x: np.add.reduceat(x, p.first[:-1]) if rows.num_rows else np.zeros(0)
        n = rows.num_rows
        return pa.table({
            "doc_id": rows["doc_id"], "held_out": pa.array(p.held), "n_tokens": pa.array(p.per_doc.astype(np.int64)), "n_known": pa.array(add((uses > 0)[word].astype(np.int64))),
            "train_tokens": pa.array(np.full(n, totals["tokens"], np.int64)), "base_score": pa.array(add(base[word])), "score": pa.array(add(pair[p.where])),
        })

    return run


def score(docs: DataFrame, seed: int = 11) -> DataFrame:
    """One row per row of docs: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, perplexity.

    A hierarchical Pitman-Yor model of word pairs learns from all texts outside the held-out fold (crc32 of doc_id as
    text modulo 7 is 2; a null doc_id counts as the empty text): a restaurant for each context word (or the beginning of
    a text) over one root restaurant over even chances for the words seen and one unseen. Score is log10 of a text's
    probability, from predictive probabilities averaged over Gibbs samples of the seating. base_score is the add-one
    unigram score. Null and empty texts are the end token alone. An empty table gives an empty result; other columns are
    ignored; repeated rows count each. A text of any length is one group's, of which a task holds the distinct pairs.

    A sweep draws the tables of all customers of every type anew: from the exact conditional up to MOST_SEATS customers,
    else in blocks of customers. Types are sampled in PARTS parts, those of one part side by side. Restaurants are dealt by context to buckets, which sample them side by side, each with the root its own tables show;
    the tables of all buckets are the customers of the root, which is sampled by word. Everything a group of texts needs
    comes back to it as blobs: only distinct pairs and words of a group are sent.
    """
    groups = pack_groups(docs, GROUP_BYTES)
    size = groups.agg(F.coalesce(F.sum("bytes"), F.lit(0))).first()[0]
    buckets = max(1, -(-size // 6 // TOKENS_PER_BUCKET))
    pairs = map_groups(groups, _pairs(buckets), "bucket int, g long, blob binary")
    seated = spool(pairs.groupBy("bucket").applyInArrow(lean(_restaurants(buckets, seed)), REPLY), "seated")
    summary = "bucket int, words long, tokens long, served long, once long, twice long, blob binary"
    vocabulary = spool(seated.where("kind = 0").select("bucket", "blob").groupBy("bucket").applyInArrow(lean(_vocabulary), summary), "vocabulary")
    totals = vocabulary.agg(*(F.coalesce(F.sum(n), F.lit(0)).alias(n) for n in ("words", "tokens", "served", "once", "twice"))).first().asDict()
    root = spool(vocabulary.select("bucket", "blob").mapInArrow(_root(totals, seed), "bucket int, opened long, blob binary"), "root")
    totals["opened"] = root.agg(F.coalesce(F.sum("opened"), F.lit(0))).first()[0]
    asked = map_groups(groups, _asked(buckets), "bucket int, g long, asked binary")
    rooted = asked.groupBy("bucket").cogroup(root.select("bucket", "blob").groupBy("bucket")).applyInArrow(lean(_answer(totals)), REPLY)
    schema = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    scored = answer_groups(groups, seated.where("kind = 1").unionByName(rooted), _score(totals, buckets, buckets), schema)
    return scored.withColumn("perplexity", F.pow(F.lit(10.0), -F.col("score") / F.col("n_tokens")))


def query(spark, sf_dir: str) -> DataFrame:
    return score(spark.read.parquet(f"{sf_dir}/documents.parquet"))
