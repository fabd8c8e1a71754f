"""The corpus pipeline, stage by stage, on a small table with awkward rows."""

import hashlib
import zlib

import numpy as np
from pyspark.sql import functions as F
from test_llm import WORD, brute_components, brute_contained, tokenizer

import corpus_pipeline
from hornbeam.llm import common, decontam, neardup, quality

SF = "/root/testdata/sf0.001"


def test_stages_follow_their_operators(spark):
    docs = common.read(spark, SF, "documents")
    columns = docs.columns
    extra = spark.createDataFrame([(None, None, None, None, None), (900001, None, "en", None, 0), (900002, "", None, "src1", 0), (900003, "one two three", "en", "src1", 1), (900003, "one two three", "en", "src1", 1)], docs.schema)
    docs = docs.unionByName(extra).withColumn("score", F.lit("clash")).withColumn("mix_note", F.lit(1)).withColumn("mix_size", F.lit(2))
    columns = docs.columns
    model = quality.fit(docs, common.read(spark, SF, "labels"))
    want = {r[0] for r in quality.score(docs, model).filter("predicted = 1").select("doc_id").collect()}
    now = common.written(corpus_pipeline.good_quality(spark, docs, SF), "t")
    assert now.columns == columns and {r[0] for r in now.select("doc_id").collect()} == want
    kept = neardup.near_duplicates(now).filter("kept").select("doc_id").distinct()
    want = {r[0] for r in kept.collect()}
    now = common.written(corpus_pipeline.one_of_each(spark, now, SF), "t")
    ids = [r[0] for r in now.select("doc_id").collect()]
    assert now.columns == columns and set(ids) == want and len([i for i in ids if i is not None]) == len({i for i in ids if i is not None})
    bad = {r[0] for r in decontam.contaminated(now, common.read(spark, SF, "benchmark")).collect()}
    now = common.written(corpus_pipeline.decontaminated(spark, now, SF), "t")
    assert now.columns == columns and {r[0] for r in now.select("doc_id").collect()} == want - bad
    mixed = common.written(corpus_pipeline.mixed(spark, now, SF), "t")
    assert mixed.columns == columns and mixed.groupBy("doc_id").count().agg(F.max("count")).first()[0] <= 3
    last = corpus_pipeline.token_files(spark, mixed, SF)
    assert last.count() == mixed.count()


def test_whole_pipeline_and_empty_table(spark):
    out = corpus_pipeline.run(spark, SF)
    rows = sorted(out.collect(), key=lambda r: r["start"])
    assert rows and all(a["start"] + a["n_tokens"] == b["start"] for a, b in zip(rows, rows[1:], strict=False))
    docs = common.read(spark, SF, "documents").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF)
        assert docs.count() == 0


def brute_mix(docs):
    """The rows (doc_id, text, source) that weighted fair queueing takes, one at a time."""
    sizes = {}
    for _, text, source in docs:
        sizes[source] = sizes.get(source, 0) + len(WORD.findall(text or ""))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(sorted(sizes, key=lambda s: (s is None, s)))}
    copies = []
    for s in sizes:
        key = lambda d: hashlib.md5(f"{'' if d[0] is None else d[0]}/mix/{d[2] or ''}/{hashlib.md5((d[1] or '').encode()).hexdigest()}".encode()).hexdigest()
        end = 0
        for d in sorted((d for d in docs if d[2] == s), key=lambda d: (key(d), d[0] is not None, d[0] or 0)):
            n = len(WORD.findall(d[1] or ""))
            end += n
            copies += [((e * sizes[s] + end) / weight[s], key(d), d[0] or 0, e, n, d) for e in range(3)]
    out, left = [], sum(sizes.values())
    for *_, n, d in sorted(copies, key=lambda x: x[:4]):
        if n > left:
            break
        left -= n
        out.append(d)
    return out


def test_pipeline_is_brute_force(spark, tmp_path):
    docs = common.read(spark, SF, "documents").limit(150)
    docs = docs.unionByName(spark.createDataFrame([(900001, None, "en", None, 0), (900002, "", None, "src1", 0), (900003, "one two three", "en", "src1", 1)], docs.schema))
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    for table in ("labels", "benchmark"):
        common.read(spark, SF, table).write.parquet(f"{tmp_path}/{table}.parquet")
    docs = common.read(spark, str(tmp_path), "documents")
    rows = [(r["doc_id"], r["text"], r["source"]) for r in docs.collect()]
    model = quality.fit(docs, common.read(spark, str(tmp_path), "labels"))
    rows = [r for r in rows if model.score([(r[1] or "").encode()])[0] >= 0.7]
    root = brute_components([r[:2] for r in rows])
    rows = [r for r in rows if root[r[0]] == r[0]]
    bad = {x[0] for x in brute_contained([r[:2] for r in rows], [tuple(r) for r in common.read(spark, SF, "benchmark").select("item_id", "text").collect()])}
    rows = brute_mix([r for r in rows if r[0] not in bad])
    library, start, want = tokenizer(), 0, []
    for doc, text, _ in sorted(rows, key=lambda r: r[0]):
        ids = [*library.encode(text or "", add_special_tokens=False).ids, 0]
        want.append((doc, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    got = sorted(tuple(r) for r in corpus_pipeline.run(spark, str(tmp_path)).select("doc_id", "start", "n_tokens", "ids_crc32").collect())
    assert got == sorted(want) and 20 < len(set(want))
