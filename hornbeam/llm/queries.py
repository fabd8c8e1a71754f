"""The queries of this subpackage and, where SQL can express them, their DuckDB counterparts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hornbeam.llm import common, decontam, html_extract, langid, licenses, mixing, neardup, quality, token_count, token_io, topk


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contaminated(common.read(spark, sf_dir, "documents"), common.read(spark, sf_dir, "benchmark"))


_LOWER = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = rf"regexp_extract_all({_LOWER}, '[^\x20\x09-\x0D]+')"
_RUNS = "list_transform(range(1, greatest(len(w) - {k} + 1, 0) + 1), lambda i: array_to_string(list_slice(w, i, i + {k} - 1), ' '))"

OP1_SQL = rf"""
WITH i AS (SELECT item_id, {_WORDS} AS w FROM benchmark WHERE text IS NOT NULL),
iu AS (SELECT DISTINCT item_id, least(5, len(w)) AS k, unnest({_RUNS.format(k="least(5, len(w))")}) AS s FROM i WHERE len(w) > 0),
n AS (SELECT item_id, k, count(*) AS n_item FROM iu GROUP BY item_id, k),
d AS (SELECT doc_id, {_WORDS} AS w FROM documents WHERE text IS NOT NULL),
du AS (SELECT DISTINCT doc_id, k, unnest({_RUNS.format(k="k")}) AS s FROM d, (SELECT DISTINCT k FROM n)),
x AS (SELECT doc_id, item_id, count(*) AS n_shared FROM du JOIN iu USING (k, s) GROUP BY doc_id, item_id)
SELECT doc_id, item_id, n_shared, n_item, n_shared / n_item AS containment FROM x JOIN n USING (item_id)
WHERE 100 * n_shared >= 75 * n_item
"""


def op2_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.read(spark, sf_dir, "documents")
    return langid.identify(docs, langid.fit(docs))


def op4_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(common.read(spark, sf_dir, "documents"))


def op3_fair_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = mixing.plan(common.read(spark, sf_dir, "documents"))
    return rows.select(
        "doc_id",
        F.col("mix_size").alias("size"),
        F.col("mix_source_size").alias("source_size"),
        F.col("mix_target").alias("target"),
        (F.col("mix_size") * F.size("mix_epochs")).alias("taken"),
    )


OP3_SQL = r"""
WITH d AS (SELECT doc_id, source, md5(coalesce(CAST(doc_id AS VARCHAR), '') || '/mix/' || coalesce(source, '') || '/' || md5(coalesce(text, ''))) AS k,
             CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
        CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS w
      FROM d GROUP BY source),
c AS (SELECT *, (CAST(sum(source_size) OVER () AS DOUBLE) - coalesce(sum(3 * source_size) OVER (ORDER BY 3 * source_size / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
        / sum(w) OVER (ORDER BY 3 * source_size / w, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS line FROM s),
t AS (SELECT *, least(CAST(3 * source_size AS DOUBLE), w * max(line) OVER ()) AS target, sum(source_size) OVER () AS budget FROM c),
p AS (SELECT d.doc_id, d.k, d.size, t.source_size, t.w, t.target, t.budget,
        sum(d.size) OVER (PARTITION BY d.source ORDER BY d.k, d.doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS ends
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
e AS (SELECT p.*, u.epoch, CAST(u.epoch * source_size + ends AS DOUBLE) / w AS finish FROM p, (VALUES (0), (1), (2)) u(epoch)),
q AS (SELECT *, sum(size) OVER (ORDER BY finish, k, doc_id, epoch ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto FROM e)
SELECT doc_id, size, source_size, target, CAST(sum(CASE WHEN upto <= budget THEN size ELSE 0 END) AS BIGINT) AS taken
FROM q GROUP BY doc_id, size, source_size, target
"""

def op5_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract(common.read(spark, sf_dir, "pages"))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.read(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality.fit(docs, common.read(spark, sf_dir, "labels"))
    return quality.score(docs, model).drop("text")


def op8_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(common.read(spark, sf_dir, "documents"))


def op6_va_file_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(common.read(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


OP6_SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings
           WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(list_zip(q.e, c.e), lambda z: z[1] * z[2])) AS BIGINT) AS score
      FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.e) = len(c.e) WHERE q.vec_id % 100 = 0),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10
"""


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op9_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_io.encode_corpus(common.read(spark, sf_dir, "documents"), tokenizer_path())


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_count.count_tokens(common.read(spark, sf_dir, "documents"), tokenizer_path())


QUERIES = {
    "op1_decontaminate": op1_decontaminate,
    "op2_language": op2_language,
    "op4_near_duplicates": op4_near_duplicates,
    "op3_fair_mix": op3_fair_mix,
    "op5_main_text": op5_main_text,
    "op6_va_file_topk": op6_va_file_topk,
    "op7_quality": op7_quality,
    "op8_licenses": op8_licenses,
    "op9_token_files": op9_token_files,
    "op10_token_counts": op10_token_counts,
}
ORACLE = {"op1_decontaminate": OP1_SQL, "op3_fair_mix": OP3_SQL, "op6_va_file_topk": OP6_SQL}
