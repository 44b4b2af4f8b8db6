"""Exact dedup: two-pass Bloom filtering; only rows whose hash may repeat are shuffled."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm._spark import salted_lookup, spool
from plumbline.llm._words import SPACE, mix, pack

#: Slots of the filter for each row, and the most slots of one filter: the bit map that tasks hold stays under 32 MB. Where
#: that is too few, hashes are dealt to several filters, one after the other, so none of them fills up.
SLOTS_PER_ROW = 16
MAX_SLOTS = 1 << 28
BLOCK = 1 << 16
PROBES = 3


def _hash_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        hexes, sizes = [], []
        for text in b["text"].to_pylist():
            text = text or ""
            hexes.append(hashlib.sha256(text.encode().translate(None, SPACE)).hexdigest())
            sizes.append(len(text))
        key = np.array([int(x[:15], 16) for x in hexes], np.int64)
        yield pa.record_batch({"doc_id": b["doc_id"], "text_sha256": pa.array(hexes, pa.string()), "size": pa.array(sizes, pa.int64()), "key": key, "row": b["row"]})


def _slots(keys: np.ndarray, slots: int) -> np.ndarray:
    k = keys.astype(np.uint64)
    return np.stack([mix(k + np.uint64(i * 0x9E3779B97F4A7C15 % 2**64)) % np.uint64(slots) for i in range(PROBES)]).astype(np.int64)


def repeated_slots(hashed: DataFrame, slots: int) -> np.ndarray:
    """Bit map of the slots that at least two rows hit: the first pass.

    A task sums its own rows into blocks of slots; a block goes out as the list of its hit slots or, where that is
    longer, as two bit maps (hit, hit twice), so a block never takes more than its bit maps. Merging is associative.
    """

    def scan(batches):
        got = [_slots(b["key"].to_numpy(), slots) for b in batches if b.num_rows]
        if not got:
            return
        # one row counts once in a slot, even if two of its probes meet there
        rows = np.sort(np.concatenate(got, axis=1), axis=0)
        fresh = np.ones_like(rows, bool)
        fresh[1:] = rows[1:] != rows[:-1]
        at, n = np.unique(rows[fresh], return_counts=True)
        block = at // BLOCK
        cuts = np.flatnonzero(np.diff(block)) + 1
        out = {"block": [], "sparse": [], "bits": []}
        for own, twice in zip(np.split(at, cuts), np.split(n > 1, cuts), strict=True):
            place = (own % BLOCK).astype(np.uint32)
            out["block"].append(int(own[0] // BLOCK))
            if 4 * len(own) <= BLOCK // 4:
                out["sparse"].append(True)
                out["bits"].append(pack(place * 2 + twice))
            else:
                maps = np.zeros((2, BLOCK), bool)
                maps[0, place], maps[1, place[twice]] = True, True
                out["sparse"].append(False)
                out["bits"].append(pack(np.packbits(maps)))
        yield pa.record_batch({"block": pa.array(out["block"], pa.int32()), "sparse": pa.array(out["sparse"], pa.bool_()), "bits": pa.array(out["bits"], pa.binary())})

    def merge(t: pa.Table) -> pa.Table:
        seen, twice = np.zeros(BLOCK, bool), np.zeros(BLOCK, bool)
        for sparse, bits in zip(t["sparse"].to_pylist(), t["bits"].to_pylist(), strict=True):
            if sparse:
                x = np.frombuffer(bits, np.uint32)
                maps = np.zeros((2, BLOCK), bool)
                maps[0, x // 2], maps[1, x[x % 2 == 1] // 2] = True, True
            else:
                maps = np.unpackbits(np.frombuffer(bits, np.uint8)).astype(bool).reshape(2, BLOCK)
            twice |= maps[1] | seen & maps[0]
            seen |= maps[0]
        keep = bool(twice.any())
        return pa.table({"block": pa.array([t["block"][0].as_py()] * keep, pa.int32()), "bits": pa.array([pack(np.packbits(twice))] * keep, pa.binary())})

    parts = hashed.select("key").mapInArrow(scan, "block int, sparse boolean, bits binary")
    out = np.zeros(slots // 8, np.uint8)
    for row in parts.groupBy("block").applyInArrow(merge, "block int, bits binary").collect():  # MAX_SLOTS bounds it
        out[row["block"] * (BLOCK // 8) : (row["block"] + 1) * (BLOCK // 8)] = np.frombuffer(row["bits"], np.uint8)
    return out


def _tester(twice, slots: int):
    def test(batches):
        for b in batches:
            at = _slots(b["key"].to_numpy(), slots)
            yield b.append_column("again", pa.array((twice.value[at // 8] >> (7 - at % 8) & 1).all(axis=0)))

    return test


def exact_dedup(docs: DataFrame, row: str | None = None, slots_per_row: int = SLOTS_PER_ROW, max_slots: int = MAX_SLOTS) -> DataFrame:
    """One row per row of docs: doc_id, keep_id, group_size, kept, text_sha256, row (the column of that name that
    numbers the rows of docs, or numbers given here).

    Texts are equal if identical once the characters space and U+0009 to U+000D are deleted; a null text is empty, and
    all empty texts are one group. The row with the most code points, then the smallest doc_id (null first), stays;
    of rows that tie in both, one. A text of any length is hashed whole. An empty table gives an empty result; other columns are ignored.

    The first pass counts hashes in a filter of bounded size; the second sends on only rows all of whose slots were hit
    twice. The others cannot repeat and pass straight through without a shuffle.
    """
    numbers = F.col(row) if row else F.monotonically_increasing_id()
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), numbers.alias("row"))
    hashed = spool(texts.mapInArrow(_hash_rows, "doc_id long, text_sha256 string, size long, key long, row long"), "hashed")
    rows = hashed.count()
    filters = max(1, -(-slots_per_row * rows // max_slots))
    slots = BLOCK
    while slots * filters < slots_per_row * rows:
        slots *= 2
    schema = "doc_id long, text_sha256 string, size long, key long, row long, again boolean"
    tested = None
    for k in range(filters):
        part = hashed.where(F.pmod("key", F.lit(filters)) == k) if filters > 1 else hashed
        now = part.mapInArrow(_tester(hashed.sparkSession.sparkContext.broadcast(repeated_slots(part, slots)), slots), schema)
        tested = now if tested is None else tested.unionByName(now)
    single = tested.where("not again").select("doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), "text_sha256", "row")
    again = tested.where("again").select("doc_id", "text_sha256", "size", "row")
    order = F.struct((-F.col("size")).alias("size"), F.col("doc_id").isNotNull().alias("known"), "doc_id", "row")
    best = again.groupBy("text_sha256").agg(F.count(F.lit(1)).alias("group_size"), F.min(order).alias("best"))
    whole = salted_lookup(again, best, "text_sha256", "group_size")
    return single.unionByName(whole.select("doc_id", F.col("best.doc_id").alias("keep_id"), "group_size", (F.col("row") == F.col("best.row")).alias("kept"), "text_sha256", "row"))


SQL = r"""
WITH h AS (SELECT doc_id, length(coalesce(text, '')) AS size,
                  sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256 FROM documents),
     k AS (SELECT *, first_value(doc_id) OVER (PARTITION BY text_sha256 ORDER BY size DESC, doc_id NULLS FIRST) AS keep_id,
                  count(*) OVER (PARTITION BY text_sha256) AS group_size FROM h)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM k
"""


def query(spark, sf_dir: str) -> DataFrame:
    return exact_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("row")
