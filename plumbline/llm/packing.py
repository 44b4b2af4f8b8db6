"""Best-fit packing of documents into token sequences by the sum-of-squares rule."""

from __future__ import annotations

import os
import unicodedata
import zlib
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm._spark import frame, spool
from plumbline.llm._words import Words, ranges
from plumbline.llm._words import raw as raw_text

CAPACITY = 4096
END_ID = 1
VOCABULARY = "word_bpe_49k.json"
PIECES_PER_SHARD = 25_000
#: Words, and parts of words, whose ids a Python worker remembers; the memory of words is emptied before it would be fuller
#: (by more only if the texts at hand have more).
REMEMBERED = 2_000_000
REMEMBERED_PARTS = 150_000
BATCH_BYTES = 2 << 20


def _byte_letters() -> dict[int, str]:
    """The byte-level alphabet: printable Latin-1 bytes stand for themselves, the others for U+0100 onwards."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + k) for k, b in enumerate(rest)}


class Encoder:
    """Token ids of many texts with a word-level memory.

    The vocabulary's rules never join characters across white space, so a text's ids are those of its words end to end.
    Words of plain letters, digits and signs below U+0250 are cut by the vocabulary's own pattern here and only their
    parts go to its merge model; every other word goes through the whole tokenizer.
    """

    def __init__(self, path: str | None = None):
        import regex
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        if path is None:
            import public_tokenizers

            path = public_tokenizers.path(VOCABULARY)
        self.whole = Tokenizer.from_file(path)
        self.model = self.whole.model
        self.parts = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+").findall
        self.plain = regex.compile("[!-~¡-įı-ɏ]+").fullmatch
        self.letters = _byte_letters()
        self.part_ids: dict[str, list[int]] = {}
        self._empty()

    def _empty(self) -> None:
        """No words known: their hashes in order, and where the ids of each begin in the pool."""
        self.known = np.zeros(0, np.uint64)
        self.begin, self.size = np.zeros(0, np.uint32), np.zeros(0, np.uint32)
        self.pool, self.used = np.zeros(1 << 16, np.uint32), 0

    def _part(self, part: str) -> list[int]:
        got = self.part_ids.get(part)
        if got is None:
            text = part if part.isascii() else "".join(map(self.letters.__getitem__, part.encode()))
            got = [t.id for t in self.model.tokenize(text)]
            if len(self.part_ids) < REMEMBERED_PARTS:
                self.part_ids[part] = got
        return got

    def _word(self, word: bytes) -> list[int]:
        text = word.decode()
        if self.plain(text) and "<|" not in text and (text.isascii() or unicodedata.is_normalized("NFC", text)):
            out: list[int] = []
            for part in self.parts(text.lower()):
                out += self._part(part)
            return out
        return self.whole.encode(text, add_special_tokens=False).ids

    def _learn(self, fresh: np.ndarray, words: list[bytes]) -> None:
        """fresh: the hashes, in order, of words not known yet."""
        got = list(map(self._word, words))
        sizes = np.fromiter(map(len, got), np.uint32, len(got))
        flat = np.fromiter(chain.from_iterable(got), np.uint32, int(sizes.sum()))
        while self.used + len(flat) > len(self.pool):
            self.pool = np.concatenate([self.pool, np.zeros_like(self.pool)])
        self.pool[self.used : self.used + len(flat)] = flat
        at = np.searchsorted(self.known, fresh)
        self.known = np.insert(self.known, at, fresh)
        self.begin = np.insert(self.begin, at, self.used + np.cumsum(sizes) - sizes)
        self.size = np.insert(self.size, at, sizes)
        self.used += len(flat)

    def _known(self, hashes: np.ndarray) -> np.ndarray:
        if not len(self.known):
            return np.zeros(len(hashes), bool)
        return self.known[np.minimum(np.searchsorted(self.known, hashes), len(self.known) - 1)] == hashes

    def ids(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts end to end, each followed by END_ID, and each text's number of ids."""
        words = Words(texts)
        kinds, where, which = np.unique(words.hash, return_index=True, return_inverse=True)
        raw = words.data.tobytes()
        new = ~self._known(kinds)
        if new.any():
            if len(self.known) + new.sum() > REMEMBERED:  # all words of these texts are learnt anew, however many they are
                self._empty()
                new[:] = True
            at = where[new]
            self._learn(kinds[new], [raw[a:z] for a, z in zip(words.start[at].tolist(), words.end[at].tolist(), strict=True)])
        at = np.searchsorted(self.known, kinds)[which]
        sizes, begin = self.size[at].astype(np.int64), self.begin[at].astype(np.int64)
        # END_ID behind the words of each text
        ends = np.concatenate([[0], np.cumsum(sizes)])[words.first[1:]]
        total = int(sizes.sum())
        flat = np.full(total + len(texts), END_ID, np.uint32)
        shift = words.doc
        flat[np.repeat(np.cumsum(sizes) - sizes + shift, sizes) + ranges(sizes)] = self.pool[np.repeat(begin, sizes) + ranges(sizes)]
        return flat, np.diff(ends + np.arange(1, len(texts) + 1), prepend=0)


_encoders: dict[str | None, Encoder] = {}


def encoder(path: str | None) -> Encoder:
    """This Python worker's encoder: what it remembers serves all the worker's tasks."""
    return _encoders.get(path) or _encoders.setdefault(path, Encoder(path))


def pieces(docs: DataFrame, capacity: int = CAPACITY, path: str | None = None, with_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 and, if asked for, ids: each document's ids and END_ID cut at capacity."""
    columns = ["doc_id", "piece", "start", "length", "ids_crc32"]

    def encode(batches):
        known = encoder(path)
        for b in batches:
            ids, upto = b["doc_id"].to_pylist(), raw_text(b["text"])[1]
            a = 0
            while a < len(ids):
                z = max(a + 1, int(np.searchsorted(upto, upto[a] + BATCH_BYTES, "right")) - 1)
                flat, counts = known.ids(b["text"].slice(a, z - a))
                raw = memoryview(flat.astype("<u4").tobytes())
                rows, own, lo = [], [], 0
                for doc_id, n in zip(ids[a:z], counts.tolist(), strict=True):
                    for k, start in enumerate(range(0, n, capacity)):
                        length = min(capacity, n - start)
                        rows.append((doc_id, k, start, length, zlib.crc32(raw[4 * (lo + start) : 4 * (lo + start + length)])))
                        if with_ids:
                            own.append(flat[lo + start : lo + start + length].astype(np.int32))
                    lo += n
                out = dict(zip(columns, [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=True)], strict=True))
                if with_ids:
                    out["ids"] = pa.array(own, pa.list_(pa.int32()))
                yield pa.record_batch(out)
                a = z

    return frame(docs).mapInArrow(encode, "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * with_ids)


def place(lengths: np.ndarray, capacity: int = CAPACITY) -> tuple[np.ndarray, np.ndarray]:
    """Sequence and offset of each item: the sum-of-squares rule, longest items first.

    count[g] is the number of open sequences with g places left. An item of length l that goes into one of gap g takes
    one from count[g] and adds one to count[g - l] (nothing for a gap of 0); a new sequence adds one to
    count[capacity - l]. Of all these the item takes the one with the smallest sum of squared counts, then the smallest
    gap; a new sequence only if no open one has room.
    """
    count = np.zeros(capacity + 1, np.int64)
    open_: list[list[int]] = [[] for _ in range(capacity + 1)]
    order = np.argsort(-lengths, kind="stable")
    sequence, offset, made = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64), 0
    for k, size in zip(order.tolist(), lengths[order].tolist(), strict=True):
        held = count[size:capacity]
        gaps = np.flatnonzero(held)
        if len(gaps):
            change = 2 * (count[gaps] - held[gaps])  # the change of the sum, less 2
            change[gaps == 0] = -2 * held[0] - 1
            gap = int(gaps[np.argmin(change)]) + size
            at = open_[gap].pop()
            count[gap] -= 1
        else:
            gap, at, made = capacity, made, made + 1
        sequence[k], offset[k] = at, capacity - gap
        if gap > size:
            count[gap - size] += 1
            open_[gap - size].append(at)
    return sequence, offset


def pack(cut: DataFrame, capacity: int = CAPACITY, per_shard: int = PIECES_PER_SHARD) -> DataFrame:
    """cut with sequence_id and offset. Shards of about per_shard pieces are packed apart, each in one task."""
    rows = spool(cut.withColumn("row", F.monotonically_increasing_id()), "pieces")
    shards = max(1, -(-rows.count() // per_shard))
    rows = rows.withColumn("shard", F.pmod(F.xxhash64("row"), F.lit(shards)).cast("int"))
    names = [f"`{f.name}` {f.dataType.simpleString()}" for f in cut.schema.fields]

    def one(t: pa.Table) -> pa.Table:
        t = t.sort_by("row")
        sequence, offset = place(t["length"].to_numpy(), capacity)
        shard = t["shard"][0].as_py()
        t = t.drop_columns(["row", "shard"])
        return t.append_column("sequence_id", pa.array(sequence + (shard << 32))).append_column("offset", pa.array(offset))

    return rows.groupBy("shard").applyInArrow(one, ", ".join([*names, "sequence_id long", "offset long"]))


def pack_documents(docs: DataFrame, capacity: int = CAPACITY, path: str | None = None, with_ids: bool = False) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, [ids,] sequence_id, offset.

    A document is its token ids and END_ID; a null or empty text is END_ID alone. Only documents longer than capacity
    are cut. Every row of docs is packed, repeated rows and null doc_ids too; an empty table gives an empty result;
    other columns are ignored. Offsets in a sequence are gapless from 0.
    """
    return pack(pieces(docs, capacity, path, with_ids), capacity)


def query(spark, sf_dir: str) -> DataFrame:
    return pack_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))
