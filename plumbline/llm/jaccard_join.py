"""N-gram Jaccard join by token-combination prefixes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm._spark import PLACE_BITS, answer_groups, components, map_groups, pack_groups, salted_lookup, spool, union_find
from plumbline.llm._words import _GRAM, Words, freeze, mix, ranges, thaw

SHINGLE = 4
PERCENT = 85
#: Tokens in this many sets or more are the frequent class, of which pairs are indexed instead of single tokens.
FREQUENT = 1024
COMBINED = 2
TOKENS_PER_BUCKET = 3_000_000
KEYS_PER_BUCKET = 1_000_000
#: A key of more sets than this is compared in tiles, in which a pair of sets shows once, however many keys they share.
LARGE_KEY = 64
TILE = 1024

#: kind 1: classes of the tokens a group sent (bucket, blob); 2: sets of a group that a row elsewhere stands for;
#: 3: keys of a group (bucket, blob); 4: members (x row, y representative, doc_id, n);
#: 5: candidates to verify, at the group of the first; 6: sets met by another; 7: labels (x row, y component)
ROWS = "kind int, g long, bucket int, x long, y long, doc_id long, n long, blob binary"
_TYPES = {"kind": pa.int32(), "g": pa.int64(), "bucket": pa.int32(), "x": pa.int64(), "y": pa.int64(), "doc_id": pa.int64(), "n": pa.int64(), "blob": pa.binary()}


def _table(*parts: dict) -> pa.Table:
    """Rows of ROWS from columns; what a part does not give is null."""
    tables = []
    for part in parts:
        size = max(len(v) for v in part.values() if not np.isscalar(v))
        tables.append(pa.table({k: pa.array([part[k]] * size, t) if k in part and np.isscalar(part[k]) else pa.array(part[k], t) if k in part else pa.nulls(size, t) for k, t in _TYPES.items()}))
    return pa.concat_tables(tables) if tables else pa.table({k: pa.array([], t) for k, t in _TYPES.items()})


class Sets:
    """The shingle sets of texts: token (64-bit hashes) sorted within each text; first: a text's first token."""

    def __init__(self, texts: pa.ChunkedArray, shingle: int):
        w = Words(texts, lower=True)
        at, token = w.grams(shingle)
        doc = np.searchsorted(w.first, at, "right") - 1
        size = np.diff(w.first)
        for short in range(1, shingle):
            # a text with fewer words has its whole sequence as its only shingle
            own = np.flatnonzero(size == short)
            total = np.full(len(own), short, np.uint64)
            for k in range(short):
                total += w.hash[w.first[own] + k] * _GRAM[32 + k]
            doc, token = np.concatenate([doc, own]), np.concatenate([token, mix(total)])
        order = np.lexsort((token, doc))
        doc, token = doc[order], token[order]
        fresh = np.ones(len(doc), bool)
        fresh[1:] = (doc[1:] != doc[:-1]) | (token[1:] != token[:-1])
        self.doc, self.token = doc[fresh], token[fresh]
        self.size = np.bincount(self.doc, minlength=len(size))
        self.first = np.concatenate([[0], np.cumsum(self.size)])
        sums = np.zeros((2, len(self.token) + 1), np.uint64)
        np.cumsum(mix(self.token), out=sums[0, 1:])
        np.cumsum(mix(self.token ^ np.uint64(0x5851F42D4C957F2D)), out=sums[1, 1:])
        self.print = sums[:, self.first[1:]] - sums[:, self.first[:-1]]

    def standing(self) -> np.ndarray:
        """For each text the first text with the same set; a text without words stands for itself."""
        out = np.arange(len(self.size))
        full = np.flatnonzero(self.size)
        order = full[np.lexsort((full, self.size[full], self.print[1, full], self.print[0, full]))]
        same = np.zeros(len(order), bool)
        same[1:] = (self.print[:, order[1:]] == self.print[:, order[:-1]]).all(axis=0) & (self.size[order[1:]] == self.size[order[:-1]])
        lead = np.maximum.accumulate(np.where(same, 0, np.arange(len(order))))
        out[order] = order[lead] if len(order) else order
        return out


def _split(bucket: np.ndarray):
    """(bucket, its places) for every bucket."""
    order = np.argsort(bucket, kind="stable")
    numbers, cut = np.unique(bucket[order], return_index=True)
    return zip(numbers.tolist(), np.split(order, cut[1:]), strict=True) if len(numbers) else ()


def _tokens(s: Sets, lead: np.ndarray, buckets: int):
    """Distinct tokens of the sets that stand, in order of bucket and token; their counts; the place of each s.token."""
    stands = lead[s.doc] == s.doc
    token, at, count = np.unique(s.token[stands], return_inverse=True, return_counts=True)
    bucket = ((token >> np.uint64(20)) % np.uint64(buckets)).astype(np.int64)
    return stands, token, at, count, bucket


def _statistics(buckets: int, shingle: int):
    def run(g: int, rows: pa.Table) -> pa.Table:
        s = Sets(rows["text"], shingle)
        lead = s.standing()
        _, token, _, count, bucket = _tokens(s, lead, buckets)
        parts = []
        for b, own in _split(bucket):
            parts.append({"kind": 1, "g": [g], "bucket": [b], "blob": [freeze(token[own].astype(np.uint32), count[own].astype(np.uint32))]})
        own = np.flatnonzero((lead == np.arange(len(lead))) & (s.size > 0))
        for b, at in _split((s.print[0, own] % np.uint64(buckets)).astype(np.int64)):
            at = own[at]
            parts.append({"kind": 2, "g": [g], "bucket": [b], "blob": [freeze(s.print[0, at], s.print[1, at], s.size[at], at)]})
        return _table(*parts)

    return run


def _answers(t: pa.Table) -> pa.Table:
    """The class of every token of a bucket, 0 if it is in one set and else 1 + floor(log2 of its sets); for each set
    that several groups hold, the row that stands for it."""
    kind, g, blobs = t["kind"].to_numpy(), t["g"].to_numpy(), t["blob"].to_pylist()
    bucket, parts = t["bucket"][0].as_py(), []
    own = [(g[k], *thaw(blobs[k])) for k in np.flatnonzero(kind == 1)]
    if own:
        _, at = np.unique(np.concatenate([x[1] for x in own]), return_inverse=True)
        total = np.bincount(at, np.concatenate([x[2] for x in own]))
        level = np.where(total > 1, 1 + np.floor(np.log2(total)), 0).astype(np.uint8)[at]
        cut = np.cumsum([len(x[1]) for x in own])[:-1]
        parts.append({"kind": 1, "g": [x[0] for x in own], "bucket": [bucket] * len(own), "blob": [freeze(x) for x in np.split(level, cut)]})
    own = [(g[k], *thaw(blobs[k])) for k in np.flatnonzero(kind == 2)]
    if own:
        p0, p1, size, at = (np.concatenate([x[k] for x in own]) for k in range(1, 5))
        of = np.repeat([x[0] for x in own], [len(x[1]) for x in own])
        row = (of << PLACE_BITS) + at
        order = np.lexsort((row, size, p1, p0))
        same = np.zeros(len(order), bool)
        same[1:] = (p0[order[1:]] == p0[order[:-1]]) & (p1[order[1:]] == p1[order[:-1]]) & (size[order[1:]] == size[order[:-1]])
        lead = row[order][np.maximum.accumulate(np.where(same, 0, np.arange(len(order))))]
        other = np.flatnonzero(same)
        for group, k in _split(of[order[other]]):
            k = other[k]
            parts.append({"kind": 2, "g": [group], "blob": [freeze(at[order[k]], lead[k])]})
    return _table(*parts)


def _prefixes(buckets: int, key_buckets: int, shingle: int, percent: int, frequent: int):
    rare = 1 + int(np.log2(frequent))

    def run(g: int, rows: pa.Table, replies: pa.Table) -> pa.Table:
        s = Sets(rows["text"], shingle)
        lead = s.standing()
        stands, token, at, _, bucket = _tokens(s, lead, buckets)
        level = np.zeros(len(token), np.uint8)
        places = dict(_split(bucket))
        stand = (g << PLACE_BITS) + np.arange(len(lead))
        for kind, b, blob in zip(replies["kind"].to_pylist(), replies["bucket"].to_pylist(), replies["blob"].to_pylist(), strict=True):
            if kind == 1:
                level[places[b]] = thaw(blob)[0]
            else:
                own, by = thaw(blob)
                stand[own] = by
        stand = stand[lead]
        parts = [{"kind": 4, "x": (g << PLACE_BITS) + np.arange(len(lead)), "y": stand, "doc_id": rows["doc_id"].to_pylist(), "n": s.size}] if len(lead) else []
        # tokens of the sets that stand for themselves, rarest class first, then by hash: one order for all sets
        doc, code, level = s.doc[stands], s.token[stands], level[at]
        need = -(-percent * s.size // 100)
        known = np.bincount(doc, level > 0, len(lead)).astype(np.int64)  # tokens that other sets may hold
        # smaller sets match only their equals, unless one more token keeps the share
        ok = (stand == (g << PLACE_BITS) + np.arange(len(lead))) & (100 * s.size >= percent * (s.size + 1)) & (100 * known >= percent * s.size)
        order = np.lexsort((code, level, doc))
        doc, code, level = doc[order], code[order], level[order]
        size = np.bincount(doc, minlength=len(lead))
        begin = np.cumsum(size) - size
        reach = s.size - need + COMBINED
        held = ok[doc] & (np.arange(len(doc)) - begin[doc] < reach[doc]) & (level > 0)
        doc, code, level = doc[held], code[held], level[held]
        single = level < rare
        keys, owner = [mix(code[single])], [doc[single]]
        # all pairs of a set's frequent tokens in the prefix
        often, many = code[~single], doc[~single]
        n = np.bincount(many, minlength=len(lead))
        n = n[n > 0] if len(many) else n[:0]
        left = np.arange(len(often))
        after = np.repeat(np.cumsum(n), n) - left - 1
        for lo in range(0, len(often), 1 << 14):
            part = slice(lo, lo + (1 << 14))
            a = np.repeat(left[part], after[part])
            b = a + 1 + ranges(after[part])
            keys.append(mix(mix(often[a]) + often[b]))
            owner.append(many[a])
        keys, owner = np.concatenate(keys), np.concatenate(owner)
        for b, own in _split(((keys >> np.uint64(20)) % np.uint64(key_buckets)).astype(np.int64)):
            parts.append({"kind": 3, "g": [g], "bucket": [b], "blob": [freeze(keys[own], owner[own].astype(np.uint32), s.size[owner[own]].astype(np.uint32), known[owner[own]].astype(np.uint32))]})
        return _table(*parts)

    return run


def _meet(blobs: list[bytes], g: np.ndarray) -> tuple[np.ndarray, ...]:
    """Entries of keys that several sets have, in order of key and size: key's number, row, size, known tokens, label."""
    own = [thaw(x) for x in blobs]
    key = np.concatenate([x[0] for x in own])
    row = np.concatenate([(np.int64(k) << PLACE_BITS) + x[1].astype(np.int64) for k, x in zip(g, own, strict=True)])
    size, known = (np.concatenate([x[i] for x in own]).astype(np.int64) for i in (2, 3))
    label = np.concatenate([x[4] for x in own]) if len(own[0]) > 4 else row
    order = np.lexsort((row, size, key))
    key = key[order]
    twin = np.zeros(len(key), bool)
    twin[1:] = key[1:] == key[:-1]
    twin[:-1] |= twin[1:]
    order = order[twin]
    return np.unique(key[twin], return_inverse=True)[1], row[order], size[order], known[order], label[order]


def _possible(percent: int, size_a, size_b, known_a, known_b):
    """Whether two sets, the first of which is no larger, may match by their sizes and by how many of their tokens other sets hold at all."""
    return (100 * size_a >= percent * size_b) & ((100 + percent) * np.minimum(known_a, known_b) >= percent * (size_a + size_b))


def _pairs_table(a: np.ndarray, b: np.ndarray) -> list[dict]:
    both = np.unique(np.stack([a, b], axis=1), axis=0) if len(a) else np.zeros((0, 2), np.int64)
    return [{"kind": 5, "g": [group], "blob": [freeze(both[k])]} for group, k in _split(both[:, 0] >> PLACE_BITS)]


def _leaders(percent: int):
    """First candidates: each set of a key with the smallest set there that its size allows as a match."""

    def run(t: pa.Table) -> pa.Table:
        key, row, size, known, _ = _meet(t["blob"].to_pylist(), t["g"].to_numpy())
        active = np.unique(row)
        a, b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        while len(key):
            first = np.concatenate([[True], key[1:] != key[:-1]])
            lead = np.flatnonzero(first)[np.cumsum(first) - 1]
            near = 100 * size[lead] >= percent * size
            ok = ~first & _possible(percent, size[lead], size, known[lead], known)
            a.append(row[lead][ok])
            b.append(row[ok])
            key, row, size, known = key[~near], row[~near], size[~near], known[~near]
        parts = _pairs_table(np.concatenate(a), np.concatenate(b))
        parts += [{"kind": 6, "g": [group], "blob": [freeze(active[k])]} for group, k in _split(active >> PLACE_BITS)]
        return _table(*parts)

    return run


def _label(left: pa.Table, right: pa.Table) -> pa.Table:
    """A group's keys again, of the sets that met another one, with the component each set is in by now."""
    if not left.num_rows:
        return _table()
    g, blobs = left["g"][0].as_py(), right["blob"].to_pylist()
    kind = right["kind"].to_numpy() if right.num_rows else np.zeros(0)
    active = np.concatenate([np.zeros(0, np.int64), *(thaw(blobs[k])[0] for k in np.flatnonzero(kind == 6))])
    known = right.filter(pa.array(kind == 7)) if right.num_rows else right
    row, label = (known["x"].to_numpy(), known["y"].to_numpy()) if known.num_rows else (active[:0], active[:0])
    order = np.argsort(row)
    row, label = row[order], label[order]
    parts = []
    for b, blob in zip(left["bucket"].to_pylist(), left["blob"].to_pylist(), strict=True):
        key, owner, size, many = thaw(blob)
        own = (np.int64(g) << PLACE_BITS) + owner.astype(np.int64)
        keep = np.isin(own, active)
        key, owner, size, many, own = key[keep], owner[keep], size[keep], many[keep], own[keep]
        at = np.minimum(np.searchsorted(row, own), max(0, len(row) - 1))
        held = np.where(row[at] == own, label[at], own) if len(row) else own
        if len(key):
            parts.append({"kind": 3, "g": [g], "bucket": [b], "blob": [freeze(key, owner, size, many, held)]})
    return _table(*parts)


def _crossings(percent: int):
    """All other candidates: the pairs of a key whose sets are in different components so far and may match. They go out
    as they are found, so a task holds some millions of them at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = pa.Table.from_batches(list(batches))
        key, row, size, known, label = _meet(t["blob"].to_pylist(), t["g"].to_numpy())
        if not len(key):
            return
        cut = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        n = np.diff(np.append(cut, len(key)))
        mixed = np.minimum.reduceat(label, cut) != np.maximum.reduceat(label, cut)
        large = n > LARGE_KEY
        for few in (True, False):
            inside = np.repeat(mixed & (large != few), n)
            held = [x[inside] for x in (key, row, size, known, label)]
            for a, b in _each(percent, *held) if few else _tiles(percent, *held):
                if len(a):
                    yield from _table(*_pairs_table(a, b)).to_batches()

    return run


def _each(percent: int, key, row, size, known, label) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of small keys, key by key, some millions at a time."""
    n = np.diff(np.append(np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])), len(key))) if len(key) else np.zeros(0, np.int64)
    after = np.repeat(np.cumsum(n), n) - np.arange(len(key)) - 1
    upto = np.concatenate([[0], np.cumsum(after)])
    lo = 0
    while lo < len(key):
        hi = max(lo + 1, int(np.searchsorted(upto, upto[lo] + (1 << 21), "right")) - 1)
        a = np.repeat(np.arange(lo, hi), after[lo:hi])
        b = a + 1 + ranges(after[lo:hi])
        ok = (label[a] != label[b]) & _possible(percent, size[a], size[b], known[a], known[b])
        yield row[a[ok]], row[b[ok]]
        lo = hi


def _tiles(percent: int, key, row, size, known, label) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of large keys. Sets that hang together by them are laid out by size, and each tile of two runs of sets is one
    product of their key matrices."""
    if not len(key):
        return
    rows, at, number = np.unique(row, return_index=True, return_inverse=True)
    keys, code = np.unique(key, return_inverse=True)
    node, low = union_find(number, len(rows) + code)
    part = low[np.searchsorted(node, np.arange(len(rows)))]
    order = np.lexsort((rows, size[at], part))
    rows, size, known, label, part = rows[order], size[at][order], known[at][order], label[at][order], part[order]
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    entry = np.argsort(place[number], kind="stable")
    own, code = place[number][entry], code[entry]
    begin = np.searchsorted(own, np.arange(len(rows) + 1))

    def matrix(lo: int, hi: int, columns: np.ndarray) -> np.ndarray:
        span = slice(begin[lo], begin[hi])
        c = np.minimum(np.searchsorted(columns, code[span]), len(columns) - 1)
        hit = columns[c] == code[span]
        out = np.zeros((hi - lo, len(columns)), np.float32)
        out[own[span][hit] - lo, c[hit]] = 1
        return out

    for first, last in zip(*(np.searchsorted(part, np.unique(part), side) for side in ("left", "right")), strict=True):
        for lo in range(first, last, TILE):
            hi = min(lo + TILE, last)
            used = np.unique(code[begin[lo] : begin[hi]])
            for lo2 in range(lo, last, TILE):
                hi2 = min(lo2 + TILE, last)
                if 100 * size[hi - 1] < percent * size[lo2]:
                    break
                if label[lo:hi].min() == label[lo:hi].max() == label[lo2:hi2].min() == label[lo2:hi2].max():
                    continue
                shared = np.zeros((hi - lo, hi2 - lo2), bool)
                for k in range(0, len(used), 4 * TILE):
                    columns = used[k : k + 4 * TILE]
                    shared |= matrix(lo, hi, columns) @ matrix(lo2, hi2, columns).T > 0
                a, b = np.nonzero(shared)
                a, b = a + lo, b + lo2
                ok = (a < b) & (label[a] != label[b]) & _possible(percent, size[a], size[b], known[a], known[b])
                yield rows[a[ok]], rows[b[ok]]


def _ship(shingle: int):
    def run(g: int, rows: pa.Table, replies: pa.Table) -> pa.Table:
        """The sets of a group's candidates, to the groups of their partners: once each."""
        both = np.unique(np.concatenate([thaw(x)[0] for x in replies["blob"].to_pylist()] or [np.zeros((0, 2), np.int64)]), axis=0)
        if not len(both):
            return _table()
        own, at = np.unique(both[:, 0], return_inverse=True)
        s = Sets(rows["text"].take(pa.array(own & ((1 << PLACE_BITS) - 1))), shingle)
        parts = []
        for to, k in _split(both[:, 1] >> PLACE_BITS):
            used, a = np.unique(at[k], return_inverse=True)
            n = s.size[used]
            token = s.token[np.repeat(s.first[used], n) + ranges(n)]
            parts.append({"kind": 5, "g": [to], "blob": [freeze(own[used], n, token, a, both[k, 1])]})
        return _table(*parts)

    return run


def _verify(shingle: int, percent: int):
    def run(g: int, rows: pa.Table, replies: pa.Table) -> pa.Table:
        links = [np.zeros((0, 2), np.int64)]
        sent = [thaw(x) for x in replies["blob"].to_pylist()]
        if sent:
            own = np.unique(np.concatenate([x[4] for x in sent]))
            s = Sets(rows["text"].take(pa.array(own & ((1 << PLACE_BITS) - 1))), shingle)
            token, code = np.unique(s.token, return_inverse=True)
            have = s.doc * max(1, len(token)) + code  # sorted
            for row, n, theirs, a, b in sent:
                begin = np.cumsum(n) - n
                for lo in range(0, len(a), 4096):
                    x, y = a[lo : lo + 4096], np.searchsorted(own, b[lo : lo + 4096])
                    t = theirs[np.repeat(begin[x], n[x]) + ranges(n[x])]
                    pair = np.repeat(np.arange(len(x)), n[x])
                    at = np.minimum(np.searchsorted(token, t), len(token) - 1)
                    hit = token[at] == t
                    key = y[pair[hit]] * len(token) + at[hit]
                    place = np.minimum(np.searchsorted(have, key), len(have) - 1)
                    both = np.bincount(pair[hit], have[place] == key, len(x)).astype(np.int64)
                    ok = 100 * both >= percent * (n[x] + s.size[y] - both)
                    links.append(np.stack([row[x[ok]], b[lo : lo + 4096][ok]], axis=1))
        both = np.concatenate(links)
        return pa.table({"a": pa.array(both[:, 0]), "b": pa.array(both[:, 1])})

    return run


def jaccard_components(docs: DataFrame, shingle: int = SHINGLE, percent: int = PERCENT, frequent: int = FREQUENT) -> tuple[DataFrame, DataFrame]:
    """(members, links): row, doc_id, n_shingles, representative, component (a row) for every row of docs; the verified
    links a, b between rows that stand for different sets (not all of them: as many as connect every component).

    A text's set is its distinct shingles of so many words, A-Z in lower case; with fewer words, the whole sequence as
    one; without words, or null, it is empty and linked with nothing. Two sets link if 100 * intersection >= percent *
    union. Tokens are 64-bit hashes. Repeated rows are members each; an empty table gives empty results; other columns
    are ignored.

    1. Equal sets are merged: first in a group of texts, then by their fingerprints. Every token gets a class by the
       number of sets that hold it, which orders tokens: rarest class first.
    2. Sets that match share at least k = 2 tokens of their prefixes extended by k - 1 tokens. So they share a rare token
       there, or k frequent ones: rare tokens are indexed alone, frequent ones in pairs. Tokens of one set are left out.
    3. Candidates come in two rounds, each verified with whole sets, sent once to a partner's group. First each set
       meets the smallest possible match under a key, which links large groups at a cost in proportion to their size.
       Then all pairs under a key whose sets are still in different components are verified too, so no link is lost
       that could join two components.
    """
    groups = pack_groups(docs)
    size = groups.agg(F.coalesce(F.sum("bytes"), F.lit(0))).first()[0]
    buckets = max(1, -(-size // 6 // TOKENS_PER_BUCKET))
    key_buckets = max(1, -(-size // 6 // 8 // KEYS_PER_BUCKET))
    statistics = map_groups(groups, _statistics(buckets, shingle), ROWS)
    answers = statistics.groupBy("bucket").applyInArrow(_answers, ROWS)
    prefixes = spool(answer_groups(groups, answers, _prefixes(buckets, key_buckets, shingle, percent, frequent), ROWS), "prefixes")
    keys = prefixes.where("kind = 3").select("bucket", "g", "blob")

    def verified(candidates: DataFrame) -> DataFrame:
        shipped = answer_groups(groups, candidates.select("g", "blob"), _ship(shingle), ROWS)
        return spool(answer_groups(groups, shipped.select("g", "blob"), _verify(shingle, percent), "a long, b long"), "links")

    first = spool(keys.groupBy("bucket").applyInArrow(_leaders(percent), ROWS), "leaders")
    links = verified(first.where("kind = 5"))
    labels = components(links).select(F.lit(7).alias("kind"), F.shiftright("node", PLACE_BITS).alias("g"), F.lit(None).cast("binary").alias("blob"), F.col("node").alias("x"), F.col("component").alias("y"))
    about = first.where("kind = 6").select("kind", "g", "blob", "x", "y").unionByName(labels)
    labelled = keys.groupBy("g").cogroup(about.groupBy("g")).applyInArrow(_label, ROWS)
    second = spool(labelled.groupBy("bucket").applyInArrow(_crossings(percent), ROWS), "crossings")
    links = links.unionByName(verified(second))
    found = components(links)
    members = prefixes.where("kind = 4").select(F.col("x").alias("row"), "doc_id", F.col("n").alias("n_shingles"), F.col("y").alias("representative"))
    sizes = members.groupBy("representative").agg(F.count(F.lit(1)).alias("members")).join(found.withColumnRenamed("node", "representative"), "representative", "left")
    sizes = sizes.select("representative", "members", F.coalesce("component", "representative").alias("component"))
    return salted_lookup(members, sizes, "representative", "members").drop("members"), links


def join(docs: DataFrame, **options) -> DataFrame:
    """doc_id, n_shingles, component_id (smallest doc_id, nulls aside, reachable by links, itself included) for every row."""
    members, _ = jaccard_components(docs, **options)
    members = spool(members, "members")
    whole = members.groupBy("component").agg(F.min("doc_id").alias("component_id"), F.count(F.lit(1)).alias("members"))
    return salted_lookup(members.select("doc_id", "n_shingles", "component"), whole, "component", "members").select("doc_id", "n_shingles", "component_id")


SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS words FROM documents),
s AS (SELECT doc_id, unnest(list_distinct(CASE WHEN len(words) = 0 THEN []::VARCHAR[] WHEN len(words) < 4 THEN [array_to_string(words, ' ')]
        ELSE list_transform(generate_series(1, len(words) - 3), lambda i: array_to_string(words[i:i + 3], ' ')) END)) AS shingle FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS shared FROM s a JOIN s b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * shared >= 85 * (x.n + y.n - shared)),
r AS (SELECT doc_id AS a, doc_id AS b FROM w UNION SELECT r.a, l.b FROM r JOIN l ON l.a = r.b)
SELECT w.doc_id, coalesce(n.n, 0) AS n_shingles, min(r.b) AS component_id
FROM w JOIN r ON r.a = w.doc_id LEFT JOIN n USING (doc_id) GROUP BY w.doc_id, n.n
"""


def query(spark, sf_dir: str) -> DataFrame:
    return join(spark.read.parquet(f"{sf_dir}/documents.parquet"))
