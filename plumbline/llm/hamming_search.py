"""Exact top-k search in binary codes by incremental multi-index hashing."""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plumbline.llm._spark import salted_lookup, spool
from plumbline.llm._words import ranges

K = 10
QUERY_EVERY = 50
#: Codes of one index, and queries that meet it, in one task.
CODES_PER_SHARD = 1 << 16
QUERIES_PER_BLOCK = 1 << 14
AT_A_TIME = 64


def codes(vectors: DataFrame, id_column: str = "vec_id", column: str = "embedding") -> DataFrame:
    """id, code: the signs of a vector's entries (1 if above 0) as bits, padded with zeros to 8 bytes or a multiple.

    Null vectors have no code and are left out; null and NaN entries count as 0.
    """

    def sign(batches):
        for b in batches:
            v = b["v"].cast(pa.large_list(pa.float64()))
            size = np.diff(v.offsets.to_numpy())
            width = -(-max(1, int(size.max(initial=1))) // 64) * 64
            bits = np.zeros((len(v), width), bool)
            flat = v.flatten().fill_null(0.0).to_numpy(zero_copy_only=False)
            bits[np.repeat(np.arange(len(v)), size), ranges(size)] = flat > 0
            raw = np.packbits(bits, axis=1, bitorder="little")
            # trailing zero words go, so codes of one table agree whatever batch they come in
            words = raw.view("<u8").reshape(len(v), -1)
            used = np.maximum(1, words.shape[1] - np.argmax(words[:, ::-1] != 0, axis=1))
            used[(words == 0).all(axis=1)] = 1
            yield pa.record_batch({"id": b["id"], "code": pa.array([raw[k, : 8 * n].tobytes() for k, n in enumerate(used.tolist())], pa.binary())})

    rows = vectors.where(F.col(column).isNotNull()).select(F.col(id_column).cast("long").alias("id"), F.col(column).cast("array<double>").alias("v"))
    return rows.mapInArrow(sign, "id long, code binary")


class MultiIndex:
    """Codes (rows of 64-bit words) in tables by the values of their disjoint bit segments."""

    def __init__(self, words: np.ndarray, weight: np.ndarray):
        """weight: how many results each code stands for."""
        self.words, self.weight, n = words, weight, len(words)
        bits = 64 * words.shape[1]
        self.width = int(np.clip(round(np.log2(max(2, n))), 6, 16))
        self.segments = -(-bits // self.width)
        self.tables = []
        for s in range(self.segments):
            value = self.values(words, s)
            order = np.argsort(value, kind="stable")
            self.tables.append((order, np.searchsorted(value[order], np.arange((1 << self.width) + 1))))

    def values(self, words: np.ndarray, segment: int) -> np.ndarray:
        lo = segment * self.width
        word, shift = divmod(lo, 64)
        out = words[:, word] >> np.uint64(shift)
        if shift + self.width > 64 and word + 1 < words.shape[1]:
            out = out | words[:, word + 1] << np.uint64(64 - shift)
        return (out & np.uint64((1 << self.width) - 1)).astype(np.int64)

    def search(self, queries: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query, code, distance): of every query all codes nearer than, or as near as, the one that makes k results.

        Round r looks up every segment's values at distance r from the query's. A code not met by then differs in more
        than r bits in each segment, so it is at least segments * (r + 1) away: once k results are verified within less,
        the query is done. When a round would look up more values than there are codes, all codes are compared instead,
        which covers everything.
        """
        n, span = len(self.words), 64 * self.words.shape[1]
        worst = np.full(len(queries), span)
        done = []
        live = np.arange(len(queries))
        q, c, d = (np.zeros(0, np.int64) for _ in range(3))
        radius = 0
        while len(live):
            masks = np.array([sum(1 << b for b in chosen) for chosen in combinations(range(self.width), radius)], np.int64)
            whole = len(masks) * self.segments >= n or radius >= self.width
            if whole:
                new_q, new_c = np.repeat(live, n), np.tile(np.arange(n), len(live))
                q, c, d = q[:0], c[:0], d[:0]
            else:
                found = []
                for s, (order, cut) in enumerate(self.tables):
                    probe = (self.values(queries[live], s)[:, None] ^ masks).ravel()
                    size = cut[probe + 1] - cut[probe]
                    at = np.repeat(cut[probe], size) + ranges(size)
                    found.append(np.repeat(np.repeat(live, len(masks)), size) * n + order[at])
                new_q, new_c = np.divmod(np.concatenate(found), n)
            distance = np.bitwise_count(queries[new_q] ^ self.words[new_c]).sum(axis=1, dtype=np.int64)
            near = np.flatnonzero(distance <= worst[new_q])
            key = np.sort((new_q[near] * (span + 1) + distance[near]) * n + new_c[near])
            key = key[np.concatenate([[True], key[1:] != key[:-1]])] if len(key) else key
            new_q, new_c = key // n // (span + 1), key % n
            distance = key // n % (span + 1)
            if not whole and len(q):
                fresh = ~np.isin(key, (q * (span + 1) + d) * n + c)
                new_q, new_c, distance = new_q[fresh], new_c[fresh], distance[fresh]
            q, c, d = np.concatenate([q, new_q]), np.concatenate([c, new_c]), np.concatenate([d, distance])
            order = np.lexsort((c, d, q))
            q, c, d = q[order], c[order], d[order]
            # keep a code if the strictly nearer ones of its query make fewer than k results
            w = np.concatenate([[0], np.cumsum(self.weight[c])])
            step = np.concatenate([[True], (q[1:] != q[:-1]) | (d[1:] != d[:-1])]) if len(q) else np.zeros(0, bool)
            first = np.flatnonzero(step)[np.cumsum(step) - 1] if len(q) else step
            start = np.searchsorted(q, q)
            keep = w[first] - w[start] < k
            q, c, d = q[keep], c[keep], d[keep]
            # a query with k results needs nothing farther than the last of them
            enough = np.bincount(q, self.weight[c], len(queries)) >= k
            last = np.zeros(len(queries), np.int64)
            np.maximum.at(last, q, d)
            worst = np.where(enough, last, span)
            sure = d < self.segments * (radius + 1) if not whole else np.ones(len(d), bool)
            total = np.bincount(q[sure], self.weight[c[sure]], len(queries))
            over = total >= k if not whole else np.ones(len(queries), bool)
            mine = over[q]
            done.append((q[mine], c[mine], d[mine]))
            q, c, d = q[~mine], c[~mine], d[~mine]
            live = live[~over[live]]
            radius += 1
        return tuple(np.concatenate([x[i] for x in done]) if done else np.zeros(0, np.int64) for i in range(3))


def _matrix(column: pa.ChunkedArray, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(x.ljust(8 * width, b"\0") for x in column.to_pylist()), "<u8").reshape(-1, width).astype(np.uint64)


def top_k(index: DataFrame, queries: DataFrame, k: int = K) -> DataFrame:
    """query_id, rank, neighbour_id, distance: the k nearest codes of index for every query, itself left out; ties by id.

    index and queries have id and code (see codes; shorter codes end in zeros). Equal codes are merged first: a code
    keeps its k + 1 smallest ids, which is all that a result can hold of it, so a large group of equal vectors costs no
    more than one; equal query codes search once. Shards of codes, each with its own multi-index, meet blocks of
    queries; the shards' results are merged.

    Rows with a null id are left out; repeated rows of one id count once. If index has fewer than k other ids, all are
    returned; an empty table gives an empty result.
    """
    index, queries = spool(index.where("id is not null"), "codes"), queries.where("id is not null").distinct()
    # merged in two steps, so that no task holds all ids of a code
    part = Window.partitionBy("code", F.pmod(F.xxhash64("id"), F.lit(256))).orderBy("id")
    few = index.distinct().withColumn("n", F.row_number().over(part)).where(F.col("n") <= k + 1)
    few = few.withColumn("n", F.row_number().over(Window.partitionBy("code").orderBy("id"))).where(F.col("n") <= k + 1)
    merged = spool(few.groupBy("code").agg(F.array_sort(F.collect_list("id")).alias("ids")), "merged")
    asked = spool(queries.groupBy("code").agg(F.count(F.lit(1)).alias("queries")), "asked")
    shards, blocks = (max(1, -(-df.count() // size)) for df, size in ((merged, CODES_PER_SHARD), (asked, QUERIES_PER_BLOCK)))
    deal = lambda n: F.pmod(F.xxhash64("code"), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = merged.select("code", "ids", deal(shards).alias("shard"), every(blocks).alias("block"))
    right = asked.select("code", deal(blocks).alias("block"), every(shards).alias("shard"))

    def meet(codes_: pa.Table, queries_: pa.Table) -> pa.Table:
        out = {"code": [], "distance": [], "ids": []}
        if codes_.num_rows and queries_.num_rows:
            width = max(len(x) for t in (codes_, queries_) for x in t["code"].to_pylist()) // 8
            ids = codes_["ids"].to_pylist()
            tables = MultiIndex(_matrix(codes_["code"], width), np.fromiter(map(len, ids), np.int64))
            own, words = queries_["code"].to_pylist(), _matrix(queries_["code"], width)
            for lo in range(0, len(own), AT_A_TIME):
                q, c, d = tables.search(words[lo : lo + AT_A_TIME], k + 1)
                out["code"] += [own[lo + x] for x in q.tolist()]
                out["distance"] += d.tolist()
                out["ids"] += [ids[x] for x in c.tolist()]
        return pa.table({"code": pa.array(out["code"], pa.binary()), "distance": pa.array(out["distance"], pa.int32()), "ids": pa.array(out["ids"], pa.list_(pa.int64()))})

    met = left.groupBy("shard", "block").cogroup(right.groupBy("shard", "block")).applyInArrow(meet, "code binary, distance int, ids array<long>")
    each = met.select("code", "distance", F.explode("ids").alias("neighbour"))
    best = each.withColumn("n", F.row_number().over(Window.partitionBy("code").orderBy("distance", "neighbour"))).where(F.col("n") <= k + 1)
    best = best.groupBy("code").agg(F.array_sort(F.collect_list(F.struct("distance", "neighbour"))).alias("near")).join(asked, "code")
    rows = salted_lookup(queries.select("id", "code"), best, "code", "queries", salt="id")
    near = F.slice(F.filter("near", lambda x: x["neighbour"] != F.col("id")), 1, k)
    out = rows.select(F.col("id").alias("query_id"), F.posexplode(near).alias("rank", "x"))
    return out.select("query_id", (F.col("rank") + 1).alias("rank"), F.col("x.neighbour").alias("neighbour_id"), F.col("x.distance").alias("distance"))


SQL = """
WITH c AS (SELECT vec_id AS id, list_transform(embedding, lambda x: CASE WHEN x > 0 THEN 1 ELSE 0 END) AS code FROM embeddings),
     p AS (SELECT q.id AS query_id, i.id AS neighbour_id,
                  cast(list_sum(list_transform(list_zip(q.code, i.code), lambda z: CASE WHEN z[1] <> z[2] THEN 1 ELSE 0 END)) AS integer) AS distance
           FROM c q JOIN c i ON q.id <> i.id WHERE q.id % 50 = 0),
     r AS (SELECT query_id, cast(row_number() OVER (PARTITION BY query_id ORDER BY distance, neighbour_id) AS integer) AS rank, neighbour_id, distance FROM p)
SELECT query_id, rank, neighbour_id, distance FROM r WHERE rank <= 10
"""


def query(spark, sf_dir: str) -> DataFrame:
    index = codes(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    return top_k(index, index.where(F.col("id") % QUERY_EVERY == 0))
