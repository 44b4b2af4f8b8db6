"""Substring dedup: FM-indexes over shards of word segments find the windows of words that occurred before."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm._spark import answer_groups, map_groups, pack_groups, spool
from plumbline.llm._words import _BASE, _INVERSE, Words, mix, pack, ranges

WINDOW = 20
#: Words of the grams whose smallest hash names a window.
GRAM = 8
ANCHOR_BYTES_PER_BUCKET = 24 << 20
SEGMENTS_PER_SHARD = 20_000
ANCHOR = np.dtype([("name", "u8"), ("content", "u8"), ("doc", "i8"), ("row", "i8"), ("start", "u4"), ("index", "u4")])
SENT = np.dtype([("doc", "i8"), ("row", "i8"), ("start", "u4"), ("index", "u4"), ("words", "u4")])
NULL_ID = np.iinfo(np.int64).min


class Segments:
    """The segments of a group of texts: runs of windows of one text that share the place of their smallest gram.

    Equal windows have the same smallest gram, so they lie in segments of the same name (that gram's hash): only
    segments of one name need to be compared. All arrays have one entry for each segment, in the order of the text.
    window: first window (a word's index in the group); windows: how many.
    """

    def __init__(self, rows: pa.Table, g: int, window: int, gram: int):
        self.words = w = Words(rows["text"])
        self.doc_ids = rows["doc_id"].fill_null(NULL_ID).to_numpy()
        n = len(w.hash)
        value = np.full(n, np.iinfo(np.uint64).max, np.uint64)
        at, code = w.grams(gram)
        value[at] = code
        place, reach = np.arange(n), 1
        span = window - gram + 1
        while reach < span:  # the smallest of reach grams, leftmost first
            step = min(reach, span - reach)
            if n <= step:
                break
            less = value[step:] < value[:-step]
            place[:-step] = np.where(less, place[step:], place[:-step])
            value[:-step] = np.where(less, value[step:], value[:-step])
            reach += step
        left = np.repeat(w.first[1:], np.diff(w.first))
        ok = np.flatnonzero(np.arange(n) + window <= left)
        fresh = np.ones(len(ok), bool)
        fresh[1:] = (np.diff(ok) != 1) | (np.diff(place[ok]) != 0)
        cut = np.flatnonzero(fresh)
        self.window = ok[cut]
        self.windows = np.diff(np.append(cut, len(ok)))
        self.name = value[self.window]
        self.size = self.windows + window - 1
        doc = np.searchsorted(w.first, self.window, "right") - 1
        self.doc, self.row = self.doc_ids[doc], (np.int64(g) << 24) + doc
        self.start = self.window - w.first[doc]
        # a hash of each segment's words, from sums over the whole group
        powers = np.full((2, n + 1), 1, np.uint64)
        powers[0, 1:], powers[1, 1:] = _BASE, _INVERSE
        powers = np.multiply.accumulate(powers, axis=1)
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(w.hash * powers[0, :n])])
        self.content = mix((total[self.window + self.size] - total[self.window]) * powers[1, self.window] + self.size.astype(np.uint64))

    def earliest(self) -> np.ndarray:
        """The segments that are the first of their name and content in this group."""
        order = np.lexsort((self.start, self.row, self.doc, self.content, self.name))
        fresh = np.ones(len(order), bool)
        fresh[1:] = (self.name[order][1:] != self.name[order][:-1]) | (self.content[order][1:] != self.content[order][:-1])
        return np.sort(order[fresh])


def _anchors(buckets: int, window: int, gram: int):
    def run(g: int, rows: pa.Table) -> pa.Table:
        s = Segments(rows, g, window, gram)
        at = s.earliest()
        out = np.zeros(len(at), ANCHOR)
        for field in ("name", "content", "doc", "row", "start"):
            out[field] = getattr(s, field)[at]
        out["index"] = at
        bucket = (s.name[at] >> np.uint64(20)) % np.uint64(buckets)
        order = np.argsort(bucket, kind="stable")
        numbers, cut = np.unique(bucket[order], return_index=True)
        blobs = [pack(x) for x in np.split(out[order], cut[1:])] if len(numbers) else []
        return pa.table({"bucket": pa.array(numbers.astype(np.int32)), "g": pa.array([g] * len(blobs), pa.int64()), "blob": pa.array(blobs, pa.binary())})

    return run


def _compare(t: pa.Table) -> pa.Table:
    """Of the anchors of a bucket: those whose name and content came earlier elsewhere, and the first ones of each
    content whose name also has other contents, which an index must compare."""
    blobs = t["blob"].to_pylist()
    a = np.concatenate([np.frombuffer(x, ANCHOR) for x in blobs])
    g = np.repeat(t["g"].to_numpy(), [len(x) // ANCHOR.itemsize for x in blobs])
    order = np.argsort(a["name"], kind="stable")
    name = a["name"][order]
    twin = np.zeros(len(a), bool)
    twin[1:] = name[1:] == name[:-1]
    twin[:-1] |= twin[1:]
    a, g = a[order[twin]], g[order[twin]]
    order = np.lexsort((a["start"], a["row"], a["doc"], a["content"], a["name"]))
    a, g = a[order], g[order]
    fresh_name, fresh = np.ones(len(a), bool), np.ones(len(a), bool)
    fresh_name[1:] = a["name"][1:] != a["name"][:-1]
    fresh[1:] = fresh_name[1:] | (a["content"][1:] != a["content"][:-1])
    of = np.cumsum(fresh_name) - 1
    several = np.bincount(of, fresh)[of] > 1 if len(a) else fresh
    again, send = ~fresh, fresh & several
    keep = again | send
    a, g, send = a[keep], g[keep], send[keep]
    order = np.argsort(g, kind="stable")
    a, g, send = a[order], g[order], send[order]
    groups, cut = np.unique(g, return_index=True)
    parts = list(zip(np.split(a["index"], cut[1:]), np.split(send, cut[1:]), strict=True)) if len(groups) else []
    return pa.table({
        "g": pa.array(groups), "sent": pa.array([int(s.sum()) for _, s in parts], pa.int64()), "flags": pa.array([None] * len(parts), pa.binary()),
        "again": pa.array([pack(i[~s]) for i, s in parts], pa.binary()), "send": pa.array([pack(i[s]) for i, s in parts], pa.binary()),
    })


REPLY = "g long, sent long, flags binary, again binary, send binary"


def _u4(column: pa.ChunkedArray) -> np.ndarray:
    return np.concatenate([np.frombuffer(x or b"", np.uint32) for x in column.to_pylist()] or [np.zeros(0, np.uint32)]).astype(np.int64)


def _send(shards: int, window: int, gram: int):
    def run(g: int, rows: pa.Table, replies: pa.Table) -> pa.Table:
        at = np.sort(_u4(replies["send"]))
        if not len(at):
            return pa.table({"shard": pa.array([], pa.int32()), "g": pa.array([], pa.int64()), "meta": pa.array([], pa.binary()), "words": pa.array([], pa.binary())})
        s = Segments(rows, g, window, gram)
        shard = (mix(s.name[at]) % np.uint64(shards)).astype(np.int32)
        order = np.argsort(shard, kind="stable")
        at, shard = at[order], shard[order]
        numbers, cut = np.unique(shard, return_index=True)
        metas, words = [], []
        for own in np.split(at, cut[1:]):
            meta = np.zeros(len(own), SENT)
            meta["doc"], meta["row"], meta["start"], meta["index"], meta["words"] = s.doc[own], s.row[own], s.start[own], own, s.size[own]
            metas.append(pack(meta))
            words.append(pack(s.words.hash[np.repeat(s.window[own], s.size[own]) + ranges(s.size[own])]))
        return pa.table({"shard": pa.array(numbers), "g": pa.array([g] * len(numbers), pa.int64()), "meta": pa.array(metas, pa.binary()), "words": pa.array(words, pa.binary())})

    return run


def _index(window: int):
    def run(t: pa.Table) -> pa.Table:
        """Index a shard's segments and stream them against it: flags of the windows that occurred before."""
        from plumbline.llm.fm_index import FMIndex

        metas = t["meta"].to_pylist()
        meta = np.concatenate([np.frombuffer(x, SENT) for x in metas])
        g = np.repeat(t["g"].to_numpy(), [len(x) // SENT.itemsize for x in metas])
        words = np.concatenate([np.frombuffer(x, np.uint64) for x in t["words"].to_pylist()])
        size = meta["words"].astype(np.int64)
        begin = np.cumsum(size) - size
        order = np.lexsort((meta["start"], meta["row"], meta["doc"]))
        meta, g, size, begin = meta[order], g[order], size[order], begin[order]
        # the segments in order of document and place, each behind a separator
        at = np.cumsum(size + 1) - size
        text = np.zeros(int(size.sum()) + len(size) + 1, np.int64)
        place = np.repeat(at, size) + ranges(size)
        text[place] = np.unique(words[np.repeat(begin, size) + ranges(size)], return_inverse=True)[1] + 1
        windows = size - window + 1
        starts = np.repeat(at, windows) + ranges(windows)
        index = FMIndex(text, window)
        again = np.zeros(len(starts), np.uint8)
        for a in range(0, len(starts), 1 << 18):
            length, first = index.matching(text, starts[a : a + (1 << 18)] + window - 1)
            again[a : a + (1 << 18)] = (length == window) & (first != starts[a : a + (1 << 18)])
        upto = np.cumsum(windows)
        hit = np.add.reduceat(again, upto - windows) > 0
        out: dict[int, list] = {}
        for k in np.flatnonzero(hit):
            own = out.setdefault(int(g[k]), [[], []])
            own[0].append(meta["index"][k])
            own[1].append(again[upto[k] - windows[k] : upto[k]])
        return pa.table({
            "g": pa.array(out.keys(), pa.int64()), "sent": pa.array([0] * len(out), pa.int64()), "flags": pa.array([pack(np.concatenate(f)) for _, f in out.values()], pa.binary()),
            "again": pa.array([None] * len(out), pa.binary()), "send": pa.array([pack(np.array(i, np.uint32)) for i, _ in out.values()], pa.binary()),
        })

    return run


def _remove(window: int, gram: int, with_text: bool):
    def run(g: int, rows: pa.Table, replies: pa.Table) -> pa.Table:
        s = Segments(rows, g, window, gram)
        w = s.words
        whole = np.ones(len(s.window), bool)
        whole[s.earliest()] = False
        whole[_u4(replies["again"])] = True
        gone = np.repeat(s.window[whole], s.windows[whole]) + ranges(s.windows[whole])
        found = [gone]
        for flags, send in zip(replies["flags"].to_pylist(), replies["send"].to_pylist(), strict=True):
            if flags is not None:
                at = np.frombuffer(send, np.uint32).astype(np.int64)
                places = np.repeat(s.window[at], s.windows[at]) + ranges(s.windows[at])
                found.append(places[np.frombuffer(flags, np.uint8) > 0])
        gone = np.concatenate(found)
        n = len(w.hash)
        steps = np.bincount(gone, minlength=n + window + 1) - np.bincount(gone + window, minlength=n + window + 1) if n else np.zeros(1, np.int64)
        removed = np.cumsum(steps)[:n] > 0
        data = w.data.tobytes()
        cut = np.zeros(n + 1, np.int64)
        np.cumsum(removed, out=cut[1:])
        shas, spans, texts = [], [], []
        for d in range(rows.num_rows):
            a, z = int(w.first[d]), int(w.first[d + 1])
            if cut[z] == cut[a]:
                kept = b" ".join(data[w.at[d] : w.at[d + 1]].split())
                spans.append([])
            else:
                own = removed[a:z]
                keep = np.flatnonzero(~own) + a
                kept = b" ".join([data[x:y] for x, y in zip(w.start[keep].tolist(), w.end[keep].tolist(), strict=True)])
                turn = np.diff(np.concatenate([[0], own.astype(np.int8), [0]]))
                spans.append([{"start": int(x), "end": int(y)} for x, y in zip(np.flatnonzero(turn == 1), np.flatnonzero(turn == -1), strict=True)])
            shas.append(hashlib.sha256(kept).hexdigest())
            if with_text:
                texts.append(kept.decode())
        out = {"doc_id": rows["doc_id"], "n_words": pa.array(np.diff(w.first)), "n_removed": pa.array(cut[w.first[1:]] - cut[w.first[:-1]]), "kept_sha256": pa.array(shas, pa.string()), "removed": pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))}
        return pa.table(out | ({"kept": pa.array(texts, pa.string())} if with_text else {}))

    return run


def substring_dedup(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, with_text: bool = False) -> DataFrame:
    """One row per row of docs: doc_id, n_words, n_removed, kept_sha256, removed (spans of words), [kept (text)].

    Removes each word covered by a window of that many consecutive words whose sequence also starts earlier: in a smaller
    doc_id (null first), or earlier in the same document. Rows that repeat a doc_id come in the order they are read.
    Null and empty texts have no words and keep the empty text. An empty table gives an empty result; other columns are
    ignored. Words are compared by 64-bit hashes; a false match needs equal hashes at the same place of a whole window.

    1. Each group of texts is cut into segments named by their smallest gram. For each name and content its earliest
       segment goes to a bucket (so copies are merged before the shuffle).
    2. A bucket answers which segments are copies of an earlier one, and which names have several contents.
    3. Only the first segment of each content of such names goes to a shard, which builds an FM-index over them and
       streams them against it by backward search: windows whose matching statistic reaches the window, and whose
       first occurrence is another one, are reported.
    4. Each group takes its answers and removes words.
    """
    groups = pack_groups(docs)
    size = groups.agg(F.coalesce(F.sum("bytes"), F.lit(0))).first()[0]
    buckets = max(1, -(-size // 6 * 2 // (window - gram + 2) * ANCHOR.itemsize // ANCHOR_BYTES_PER_BUCKET))
    anchors = map_groups(groups, _anchors(buckets, window, gram), "bucket int, g long, blob binary")
    first = spool(anchors.groupBy("bucket").applyInArrow(_compare, REPLY), "compared")
    sent = first.agg(F.coalesce(F.sum("sent"), F.lit(0))).first()[0]
    shards = max(1, -(-sent // SEGMENTS_PER_SHARD))
    sends = answer_groups(groups, first.where("sent > 0"), _send(shards, window, gram), "shard int, g long, meta binary, words binary")
    second = spool(sends.groupBy("shard").applyInArrow(_index(window), REPLY), "indexed")
    schema = "doc_id long, n_words long, n_removed long, kept_sha256 string, removed array<struct<start:long,end:long>>" + ", kept string" * with_text
    return answer_groups(groups, first.unionByName(second), _remove(window, gram, with_text), schema)


SQL = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
     p AS (SELECT doc_id, words, unnest(generate_series(1, len(words) - 19)) AS start FROM w WHERE len(words) >= 20),
     k AS (SELECT doc_id, start, row_number() OVER (PARTITION BY hash(words[start:start + 19]), words[start:start + 19] ORDER BY doc_id, start) AS n FROM p),
     u AS (SELECT doc_id, words, unnest(generate_series(1, len(words))) AS pos FROM w WHERE len(words) > 0),
     c AS (SELECT u.doc_id, u.pos, u.words[u.pos] AS word,
                  coalesce(u.pos - max(CASE WHEN k.n > 1 THEN k.start END) OVER (PARTITION BY u.doc_id ORDER BY u.pos) < 20, false) AS gone
           FROM u LEFT JOIN k ON k.doc_id = u.doc_id AND k.start = u.pos),
     s AS (SELECT doc_id, count(*) AS n_words, count(*) FILTER (gone) AS n_removed,
                  string_agg(word, ' ' ORDER BY pos) FILTER (NOT gone) AS kept FROM c GROUP BY doc_id)
SELECT w.doc_id, coalesce(n_words, 0) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM w LEFT JOIN s USING (doc_id)
"""


def query(spark, sf_dir: str) -> DataFrame:
    return substring_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("removed")
