"""The pipeline's stages, each against what it must do to the documents it is given."""

import random
import re
from collections import Counter, defaultdict

import corpus_pipeline

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def test_stages(spark, tmp_path):
    rng = random.Random(8)
    say = lambda n: " ".join(f"w{rng.randint(0, 5000)}" for _ in range(n))
    rows = [(k, say(60), f"s{k % 3}", k) for k in range(300)]
    rows = [(k, t + " vile rotten" if k % 10 == 0 else t, s, x) for k, t, s, x in rows]
    base = rows[1][1]
    rows += [(400 + k, base.replace(" ", "  ", k), "s0", 0) for k in range(5)]
    rows += [(500 + k, base + f" tail{k}", "s1", 0) for k in range(4)] + [rows[2], (600, None, None, None)]
    spark.createDataFrame(rows, "doc_id long, text string, source string, row int").repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(k, int(k % 10 == 0)) for k in range(300)], "doc_id long, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["toxicity", "exact_dedup", "ngram_jaccard", "mixing", "packing"]
    seen = []
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, str(tmp_path))
        if name != "packing":
            assert out.columns == docs.columns
        out.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        seen.append(docs.collect())
    clean = [r for r in rows if not (r[0] < 300 and r[0] % 10 == 0)]
    assert Counter(r["doc_id"] for r in seen[0]) == Counter(r[0] for r in clean)
    best = {}
    for r in clean:
        best[re.sub(r"\s", "", r[1] or "")] = max(best.get(re.sub(r"\s", "", r[1] or ""), (-1, 0)), (len(r[1] or ""), -r[0]))
    assert sorted(r["doc_id"] for r in seen[1]) == sorted(-i for _, i in best.values())
    ids = {r["doc_id"] for r in seen[2]}
    assert len(seen[2]) == len(ids) and ids & {1, 404, *range(500, 504)} == {404} and {k for k in range(300) if k % 10 and k != 1} <= ids
    size, taken = defaultdict(int), defaultdict(int)
    for r in seen[2]:
        size[r["source"]] += len(WORD.findall(r["text"] or ""))
    for r in seen[3]:
        taken[r["source"]] += len(WORD.findall(r["text"] or ""))
    assert abs(sum(taken.values()) - sum(size.values())) <= len(size) and all(taken[s] <= 3 * size[s] + 1 for s in size)
    lengths = defaultdict(int)
    for r in seen[4]:
        lengths[r["sequence_id"]] += r["length"]
    assert max(lengths.values()) <= 4096 and {r["doc_id"] for r in seen[4]} == {r["doc_id"] for r in seen[3]}
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == len(seen[4])


def test_near_copies_at_five_words(spark):
    """The stage against a brute-force join at 5 words and 0.8: some links fail 4 words and 0.85, some the other way round."""
    rng = random.Random(12)
    say = lambda n: [f"w{rng.randint(0, 5000)}" for _ in range(n)]
    texts = []
    for k in range(40):
        base = say(100)
        texts += [base, base + say(12 + k % 20)]
        edited = list(base)
        for at in range(3 + k % 7, 100, 30 + k):
            edited[at] = f"edit{k}"
        texts.append(edited)
    rows = [(k, " ".join(t)) for k, t in enumerate(texts)]
    rng.shuffle(rows)

    def linked(n, percent):
        sets = {k: {tuple(t[i : i + n]) for i in range(len(t) - n + 1)} for k, t in enumerate(texts)}
        return {(a, b) for a in sets for b in range(a) if 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])}

    links = linked(5, 80)
    assert links - linked(4, 85)
    first = {k: k for k in range(len(texts))}
    for _ in texts:
        for a, b in links:
            first[a] = first[b] = min(first[a], first[b])
    got = corpus_pipeline.drop_near_copies(spark, spark.createDataFrame(rows, "doc_id long, text string").repartition(3), "")
    assert sorted(r["doc_id"] for r in got.collect()) == sorted(set(first.values()))


def test_stages_with_clashing_columns_in_one_chain(spark, tmp_path):
    """Columns that carry names used inside, null ids, a text of a megabyte, and stages chained without a write."""
    rng = random.Random(5)
    say = lambda n: " ".join(f"w{rng.randint(0, 5000)}" for _ in range(n))
    texts = [say(40) for _ in range(30)] + [None, "", say(150_000)]
    texts += [texts[0], texts[1] + " more"]
    names = ["use", "use_of_row", "row", "kept", "own", "size", "component", "shard", "_row", "g"]
    rows = [(None if k % 11 == 0 else k, t, f"s{k % 2}", *range(len(names))) for k, t in enumerate(texts)]
    schema = "doc_id long, text string, source string, " + ", ".join(f"`{n}` int" for n in names)
    spark.createDataFrame([(k, k % 2) for k in range(20)], "doc_id long, toxic int").where("false").write.parquet(str(tmp_path / "labels.parquet"))
    docs = spark.createDataFrame(rows, schema).repartition(3)
    for name, stage in corpus_pipeline.STAGES[:4]:
        docs = stage(spark, docs, str(tmp_path))
        assert docs.columns == ["doc_id", "text", "source", *names], name
        if name == "ngram_jaccard":
            kept = docs.collect()
            assert len(kept) == 32 and max(len(r["text"] or "") for r in kept) > 100_000
    got = docs.collect()
    assert got and all(tuple(r)[3:] == tuple(range(len(names))) for r in [*kept, *got])


def test_stages_of_empty_tables(spark, tmp_path):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    spark.createDataFrame([], "doc_id long, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, str(tmp_path)).count() == 0
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
