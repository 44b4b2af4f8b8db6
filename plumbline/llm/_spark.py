"""Spark plumbing shared by the operators: spooled tables, text groups, salted joins, components."""

from __future__ import annotations

import atexit
import ctypes
import functools
import inspect
import tempfile
import uuid
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm._words import raw

#: Bytes of text that one group task of an operator holds at a time (a single longer document still makes one group).
GROUP_BYTES = 6 << 20
#: Edges that one task holds to find their components.
LOCAL_EDGES = 1_000_000
#: A row's id in 63 bits: its partition (20), the number of its group there (19), its place in the group (24).
PART_BITS, MADE_BITS, PLACE_BITS = 20, 19, 24
GROUP_ROWS = 1 << 20


_own_dirs: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The shared folder the session names in spark.checkpoint.dir; a temporary one only where that is unset, in local mode."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root
    master = spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    app = spark.sparkContext.applicationId
    if app not in _own_dirs:
        _own_dirs[app] = "file://" + tempfile.mkdtemp(prefix="plumbline-")
    return _own_dirs[app]


_written: list[tuple[SparkSession, str]] = []


def spool(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet into the shared folder and read it back: cuts the lineage in a way that survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _written.append((spark, path))
    return spark.read.schema(df.schema).parquet(path)


_of_stage: list[tuple[SparkSession, str]] = []


def _delete(tables: list[tuple[SparkSession, str]]) -> None:
    while tables:
        spark, path = tables.pop()
        try:
            jvm = spark.sparkContext._jvm
            p = jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
        except Exception:  # the session may be gone; the folder is scratch space
            tables.clear()


def release() -> None:
    """Delete what spool() wrote in this process."""
    _delete(_of_stage)
    _delete(_written)


def staged(fn: Callable) -> Callable:
    """A pipeline stage: it first deletes the tables that stages before it spooled on their way, but not those that its own
    input still reads. So a stage's result is written, or handed to the next stage, before any other stage is called."""

    @functools.wraps(fn)
    def run(spark, docs, *args, **kwargs):
        read = "\n".join(docs.inputFiles()) if _of_stage else ""
        needed = [x for x in _of_stage if x[1].rpartition("/")[2] in read]
        _delete([x for x in _of_stage if x not in needed])
        _of_stage[:] = needed
        n = len(_written)
        try:
            return fn(spark, docs, *args, **kwargs)
        finally:
            _of_stage.extend(_written[n:])
            del _written[n:]

    return run


atexit.register(release)


def frame(docs: DataFrame) -> DataFrame:
    """doc_id and text of a documents table, whatever else it has."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def fresh(docs: DataFrame, name: str) -> str:
    """name, or a longer one that is no column of docs in upper or lower case."""
    held = {c.lower() for c in docs.columns}
    while name.lower() in held:
        name = f"_{name}"
    return name


def numbered(docs: DataFrame) -> tuple[DataFrame, str]:
    """docs, spooled with a number for each row, and that column's name, which docs did not have."""
    name = fresh(docs, "row")
    return spool(docs.withColumn(name, F.monotonically_increasing_id()), "numbered"), name


def group_id(part: int, made: int) -> int:
    if part >> PART_BITS or made >> MADE_BITS:
        raise OverflowError(f"group {made} of partition {part}: row ids hold {1 << MADE_BITS} groups of {1 << PART_BITS} partitions")
    return (part << MADE_BITS) + made


def pack_groups(docs: DataFrame, group_bytes: int = GROUP_BYTES) -> DataFrame:
    """g, rows, bytes, blob: the rows of docs in groups of about group_bytes of text, GROUP_ROWS rows at most, as they are read,
    without a shuffle.

    A blob is a compressed Arrow stream of doc_id and text (see unpack). The table is spooled, so g and the place of a
    row in its group are fixed from then on: later steps read it again, and replies find their rows by them.
    """

    def pack(batches):
        part, made, held, size, rows = TaskContext.get().partitionId(), 0, [], 0, 0

        def flush():
            nonlocal made, held, size, rows
            t = pa.Table.from_batches(held)
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, t.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as w:
                w.write_table(t.combine_chunks())
            out = {"g": [group_id(part, made)], "rows": [t.num_rows], "bytes": [size], "blob": [sink.getvalue().to_pybytes()]}
            made, held, size, rows = made + 1, [], 0, 0
            return pa.RecordBatch.from_pydict(out, pa.schema([("g", pa.int64()), ("rows", pa.int64()), ("bytes", pa.int64()), ("blob", pa.binary())]))

        for b in batches:
            upto, a = raw(b["text"])[1], 0
            while a < b.num_rows:
                z = max(a + 1, int(np.searchsorted(upto, upto[a] + group_bytes - size, "right")) - 1)
                z = min(z, a + GROUP_ROWS - rows)
                held.append(b.slice(a, z - a))
                size += int(upto[z] - upto[a])
                rows += z - a
                a = z
                if size >= group_bytes or rows >= GROUP_ROWS or a < b.num_rows:
                    yield flush()
        if held:
            yield flush()

    return spool(frame(docs).mapInArrow(pack, "g long, rows long, bytes long, blob binary"), "groups")


def trim() -> None:
    """Give the memory that this Python worker has freed back to the system: another worker or the JVM may need it."""
    pa.default_memory_pool().release_unused()
    if hasattr(ctypes.CDLL(None), "malloc_trim"):
        ctypes.CDLL(None).malloc_trim(0)


def lean(fn: Callable) -> Callable:
    """fn of one table or of two, after which freed memory goes back to the system."""

    def one(t):
        try:
            return fn(t)
        finally:
            trim()

    def two(left, right):
        try:
            return fn(left, right)
        finally:
            trim()

    return one if len(inspect.signature(fn).parameters) == 1 else two


def unpack(blob: bytes) -> pa.Table:
    return pa.ipc.open_stream(blob).read_all()


def map_groups(groups: DataFrame, fn: Callable[[int, pa.Table], pa.Table | None], schema: str) -> DataFrame:
    """fn(g, rows) of every group."""

    def run(batches):
        for b in batches:
            for g, blob in zip(b["g"].to_pylist(), b["blob"], strict=True):
                out = fn(g, unpack(blob.as_buffer()))
                if out is not None:
                    yield from out.to_batches()
                del out
                trim()

    return groups.select("g", "blob").mapInArrow(run, schema)


def answer_groups(groups: DataFrame, replies: DataFrame, fn: Callable[[int, pa.Table, pa.Table], pa.Table], schema: str) -> DataFrame:
    """fn(g, rows, replies) of every group with the replies that carry its g."""
    empty = pa.schema([])

    def run(left, right):
        if not left.num_rows:
            return empty.empty_table()
        return fn(left["g"][0].as_py(), unpack(left["blob"][0].as_buffer()), right)

    return groups.select("g", "blob").groupBy("g").cogroup(replies.groupBy("g")).applyInArrow(lean(run), schema)


def salted_lookup(left: DataFrame, right: DataFrame, key: str, weight: str, per_task: int = 20_000, salt: str = "doc_id") -> DataFrame:
    """left join right on key, where right has one row per key and weight, the number of left rows of that key.

    A key with more than per_task rows on the left is spread over several tasks: its right row is copied once per salt.
    """
    salts = F.greatest(F.lit(1), F.ceil(F.col(weight) / F.lit(per_task))).cast("int")
    many = right.withColumn("salts", salts)
    wide = many.select("*", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt")).drop("salts")
    hot = many.where("salts > 1").select(F.col(key).alias("hot_key"), F.col("salts").alias("hot_salts"))
    spread = left.join(hot, F.col(key) == F.col("hot_key"), "left")
    spread = spread.withColumn("salt", F.when(F.col("hot_salts").isNull(), 0).otherwise(F.pmod(F.xxhash64(salt), F.col("hot_salts"))).cast("int")).drop("hot_key", "hot_salts")
    return spread.join(wide, [key, "salt"], "left").drop("salt")


def union_find(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nodes of the edges a-b and, for each, the smallest node it is connected with."""
    nodes, flat = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = flat[: len(a)], flat[len(a) :]
    label = np.arange(len(nodes))
    while True:  # hook the larger label on the smaller, then halve the paths
        lx, ly = label[x], label[y]
        if (lx == ly).all():
            break
        np.minimum.at(label, np.maximum(lx, ly), np.minimum(lx, ly))
        while (label != label[label]).any():
            label = label[label]
    return nodes, nodes[label]


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """node, component (the smallest node reachable) for the nodes of edges (a, b).

    Every task first replaces its own edges, LOCAL_EDGES at most, by the stars of their local components: a large group
    comes down to one edge per node. Once all edges fit one task, that ends it; else large-star and small-star steps
    alternate until nothing changes.
    """

    def local(batches):
        held, n = [], 0
        for b in batches:
            held.append(b)
            n += b.num_rows
            if n >= LOCAL_EDGES:
                yield from stars(held)
                held, n = [], 0
        if n:
            yield from stars(held)

    def stars(held):
        t = pa.Table.from_batches(held)
        node, low = union_find(t["a"].to_numpy(), t["b"].to_numpy())
        far = node != low
        return pa.table({"a": node[far], "b": low[far]}).to_batches()

    def tidy(df):
        return df.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b")

    def digest(df):
        return tuple(df.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())

    now = spool(tidy(edges).mapInArrow(local, "a long, b long"), "edges")
    seen = digest(now)
    for _ in range(max_rounds):
        if seen[0] <= LOCAL_EDGES:
            now = spool(now.coalesce(1).mapInArrow(local, "a long, b long"), "edges")
            break
        both = now.select("a", "b").union(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = tidy(large.union(low.select("a", F.col("m").alias("b"))).distinct())
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).union(low.select("a", F.col("m").alias("b")))
        now = spool(tidy(small).mapInArrow(local, "a long, b long").distinct(), "edges")
        before, seen = seen, digest(now)
        if seen == before:
            break
    else:
        raise RuntimeError("components did not settle")
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).union(
        now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    )
