"""Secret scans with corpus-wide ownership frequency."""

from __future__ import annotations

import hashlib
import math
import re
from bisect import bisect_left
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm._spark import salted_lookup, spool

#: Base kinds in their listed order: pattern, the group whose length counts, the least length.
BASE = {
    "assign": (re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A), 2, 8),
    "access": (re.compile(r"AKIA[A-Z0-9]+"), 0, 16),
    "hex": (re.compile(r"[0-9a-f]{32,}"), 0, 32),
}
#: Weaker candidates, which count only if their ownership looks live: long mixed tokens, JSON web tokens, credentials in
#: addresses, prefixed provider tokens.
WEAK = {
    "jwt": (re.compile(r"(?<![A-Za-z0-9_-])eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"), 0),
    "prefixed": (re.compile(r"\b(?:gh[pousr]_[A-Za-z0-9]{20,}|xox[abprs]-[A-Za-z0-9-]{10,}|sk-[A-Za-z0-9_-]{20,}|AIza[A-Za-z0-9_-]{30,})"), 0),
    "address": (re.compile(r"(?<![a-z0-9+.-])[a-z][a-z0-9+.-]{0,30}://[^\s/:@]+:([^\s/:@]{6,})@"), 1),
    "mixed": (re.compile(r"(?<![A-Za-z0-9+/_=-])(?=[A-Za-z+/_=-]*[0-9])(?=[0-9+/_=-]*[A-Za-z])[A-Za-z0-9+/_=-]{24,}(?![A-Za-z0-9+/_=-])"), 0),
}
KINDS = [*BASE, *WEAK]
#: A long mixed token must carry this many bits a character; the form of the other kinds already marks a credential.
LEAST_ENTROPY = {"mixed": 3.5}
#: A value held by so many owners, or in so many repositories, is a widely copied example.
EXAMPLE_OWNERS = 3
EXAMPLE_REPOSITORIES = 10


def entropy(value: str) -> float:
    n = len(value)
    return -sum(c / n * math.log2(c / n) for c in Counter(value).values()) if n else 0.0


def base_spans(text: str) -> list[tuple[str, int, int, str]]:
    """(kind, start, end, value) of the base matches by start, then kind as listed; offsets in code points."""
    found = []
    for k, (kind, (pattern, group, least)) in enumerate(BASE.items()):
        found += [(m.start(), k, kind, m.end(), m[group]) for m in pattern.finditer(text) if m.end(group) - m.start(group) >= least]
    return [(kind, start, end, value) for start, _, kind, end, value in sorted(found)]


def weak_spans(text: str, base: list[tuple[str, int, int, str]]) -> list[tuple[str, int, int, str]]:
    """Weak candidates that meet no base span and no stronger weak one."""
    out: list[tuple[str, int, int, str]] = []
    starts, ends = _disjoint([(s, e) for _, s, e, _ in base])
    for kind, (pattern, group) in WEAK.items():
        new = []
        # matches of one kind do not overlap, so each need be held only against the kinds before
        for m in pattern.finditer(text):
            s, e = m.span(group)
            k = bisect_left(starts, e)
            if (k == 0 or ends[k - 1] <= s) and entropy(m[group]) >= LEAST_ENTROPY.get(kind, 0.0):
                new.append((kind, s, e, m[group]))
        out += new
        starts, ends = _disjoint([*zip(starts, ends, strict=True), *((s, e) for _, s, e, _ in new)])
    return out


def _disjoint(spans: list[tuple[int, int]]) -> tuple[list[int], list[int]]:
    """The union of the spans as starts and ends in order."""
    starts: list[int] = []
    ends: list[int] = []
    for s, e in sorted(spans):
        if ends and s < ends[-1]:
            ends[-1] = max(ends[-1], e)
        else:
            starts.append(s)
            ends.append(e)
    return starts, ends


def digest(spans) -> str:
    return ",".join(f"{kind}:{start}:{end}" for kind, start, end, *_ in spans)


_SCANNED = "doc_id long, repository string, owner string, n_assign long, n_access long, n_hex long, base_sha256 string, found array<struct<kind:string,start:int,end:int,hash:long,weak:boolean>>"


def _scan(batches):
    for b in batches:
        columns: list[list] = [[], [], [], [], []]
        for text in b["text"].to_pylist():
            base = base_spans(text or "")
            weak = weak_spans(text or "", base)
            n = Counter(x[0] for x in base)
            for c, v in zip(columns, (n["assign"], n["access"], n["hex"], hashlib.sha256(digest(base).encode()).hexdigest()), strict=False):
                c.append(v)
            key = lambda v: int.from_bytes(hashlib.sha256(v.encode()).digest()[:8], "little", signed=True)
            columns[4].append([{"kind": k, "start": s, "end": e, "hash": key(v), "weak": own is weak} for own in (base, weak) for k, s, e, v in own])
        kind = pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("hash", pa.int64()), ("weak", pa.bool_())])
        types = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.list_(kind))
        names = ("n_assign", "n_access", "n_hex", "base_sha256", "found")
        yield pa.record_batch({n: b[n] for n in ("doc_id", "repository", "owner")} | {n: pa.array(c, t) for n, c, t in zip(names, columns, types, strict=True)})


def scan(docs: DataFrame, repository: str = "doc_id", owner: str = "source", example_owners: int = EXAMPLE_OWNERS, example_repositories: int = EXAMPLE_REPOSITORIES) -> DataFrame:
    """One row per row of docs: doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_live, n_example, evidence.

    Every text is scanned whole for the base kinds and for weaker candidates. Candidate hashes are counted over the whole
    corpus by distinct repositories and owners: a value with at least example_owners owners or example_repositories
    repositories is a widely copied example, any other looks live. spans holds all base spans and the live-looking weak
    ones, by start, then kind as listed. evidence holds each candidate with its owners, repositories and verdict.

    A null text is empty: no spans, the digest of the empty string. A null repository or owner counts as one of its own.
    Repeated rows are scanned each; they count once as repository and owner. An empty table gives an empty result.
    """
    of = lambda c: F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), of(repository).alias("repository"), of(owner).alias("owner"), F.col("text").cast("string").alias("text"))
    scanned = spool(rows.mapInArrow(_scan, _SCANNED).withColumn("row", F.monotonically_increasing_id()), "scanned")
    each = scanned.where(F.size("found") > 0).select("row", "doc_id", "repository", "owner", F.explode("found").alias("f")).select("row", "doc_id", "repository", "owner", "f.*")
    pairs = each.groupBy("hash", "repository", "owner").agg(F.count(F.lit(1)).alias("uses"))
    owners = pairs.groupBy("hash", "owner").agg(F.sum("uses").alias("uses")).groupBy("hash").agg(F.count(F.lit(1)).alias("owners"), F.sum("uses").alias("uses"))
    repositories = pairs.groupBy("hash", "repository").agg(F.lit(1).alias("one")).groupBy("hash").agg(F.count(F.lit(1)).alias("repositories"))
    counts = owners.join(repositories, "hash")
    judged = salted_lookup(each.drop("repository", "owner"), counts, "hash", "uses")
    live = (F.col("owners") < example_owners) & (F.col("repositories") < example_repositories)
    rank = F.array_position(F.array(*map(F.lit, KINDS)), F.col("kind")).cast("int")
    one = F.struct("start", rank.alias("rank"), "end", "kind", "weak", live.alias("live"), "owners", "repositories")
    lists = judged.groupBy("row").agg(F.array_sort(F.collect_list(one)).alias("evidence"))
    out = scanned.drop("found", "repository", "owner").join(lists, "row", "left").drop("row")
    kept = F.filter("evidence", lambda x: ~x["weak"] | x["live"])
    spans = F.concat_ws(",", F.transform(kept, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))))
    n_live = F.size(F.filter("evidence", lambda x: x["live"]))
    return out.select(
        "doc_id", "n_assign", "n_access", "n_hex", "base_sha256", F.coalesce(spans, F.lit("")).alias("spans"),
        F.when(F.col("evidence").isNull(), 0).otherwise(n_live).alias("n_live"),
        F.when(F.col("evidence").isNull(), 0).otherwise(F.size("evidence") - n_live).alias("n_example"), "evidence",
    )


def query(spark, sf_dir: str) -> DataFrame:
    return scan(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("evidence")
