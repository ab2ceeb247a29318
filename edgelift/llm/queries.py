"""The queries of this subpackage and, where SQL can express one, its oracle."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .common import lean, new_path


def _vocabulary(name: str) -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def op1_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .token_store import read_checked, write_store

    store = new_path(spark, "store")
    write_store(spark.read.parquet(f"{sf_dir}/documents.parquet"), store, _vocabulary("word_bpe_49k.json"), "word", 2)
    return read_checked(spark, store)


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .packing import pack_documents

    return pack_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"), _vocabulary("byte_bpe_50k.json"), "byte", 0)


#: Verdict, host, path.
URL_RULES = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")]


def op4_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .url_rules import judge_urls

    return judge_urls(spark.read.parquet(f"{sf_dir}/pages.parquet"), spark.createDataFrame(URL_RULES, "verdict string, host string, path string"))


OP4_SQL = f"""
WITH r(verdict, host, path) AS (VALUES {", ".join(str(r) for r in URL_RULES)}),
u AS (SELECT page_id, row_number() OVER () AS n, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
p AS (SELECT page_id, n, translate(regexp_extract(rest, '^[^/?#]*', 0), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u),
f AS (SELECT p.n, max_by(r.host || r.path, length(r.host || r.path)) AS rule, max_by(r.verdict, length(r.host || r.path)) AS verdict
      FROM p JOIN r ON (p.host = r.host OR ends_with(p.host, '.' || r.host)) AND starts_with(p.path, r.path) GROUP BY p.n)
SELECT p.page_id, p.host, p.path, f.rule, coalesce(f.verdict, 'allow') AS verdict FROM p LEFT JOIN f USING (n)
"""


def op5_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .secrets import find_secrets

    return find_secrets(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .toxicity import find_toxic

    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").selectExpr("doc_id", "1 - quality AS low_quality", "toxic")
    return find_toxic(spark.read.parquet(f"{sf_dir}/documents.parquet"), labels, ["low_quality", "toxic"])


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality import judge

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return judge(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), columns=["doc_id", "source", "lang"])


def op9_repeated_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .chunk_dedup import repeated_passages

    return repeated_passages(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .decontaminate import find_items

    return find_items(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op3_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .ngram_join import similar_documents

    return similar_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"), 3, 90)


#: Prefix filter: two sets of which 9 in 10 are common share one of the rarest tenth (and one more) of each.
OP3_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, row_number() OVER () AS n, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT n, doc_id, CASE WHEN len(w) >= 3 THEN list_sort(list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])))
                             WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE CAST([] AS VARCHAR[]) END AS grams FROM w),
nodes AS MATERIALIZED (SELECT row_number() OVER () AS node, grams, len(grams) AS size FROM (SELECT DISTINCT grams FROM s WHERE len(grams) > 0)),
g AS MATERIALIZED (SELECT node, size, unnest(grams) AS gram FROM nodes),
f AS (SELECT gram, count(*) AS df FROM g GROUP BY gram),
p AS MATERIALIZED (SELECT node, size, gram FROM (SELECT node, size, gram, row_number() OVER (PARTITION BY node ORDER BY df, gram) AS place FROM g JOIN f USING (gram)) WHERE 10 * place <= size + 10),
c AS MATERIALIZED (SELECT DISTINCT a.node AS u, b.node AS v FROM p a JOIN p b ON a.gram = b.gram AND a.node < b.node AND 100 * least(a.size, b.size) >= 90 * greatest(a.size, b.size)),
i AS (SELECT u, v, a.size + b.size AS sizes, len(list_intersect(a.grams, b.grams)) AS common FROM c JOIN nodes a ON a.node = u JOIN nodes b ON b.node = v),
l AS MATERIALIZED (SELECT u, v FROM i WHERE 100 * common >= 90 * (sizes - common)),
e AS MATERIALIZED (SELECT u, v FROM l UNION ALL SELECT v, u FROM l),
r(node, reached) AS (SELECT node, node FROM nodes UNION SELECT r.node, e.v FROM r JOIN e ON r.reached = e.u),
least_id AS (SELECT r.node, min(s.doc_id) AS component_id FROM r JOIN nodes ON nodes.node = r.reached JOIN s ON s.grams = nodes.grams GROUP BY r.node)
SELECT s.doc_id, CAST(len(s.grams) AS BIGINT) AS n_shingles, CAST(coalesce(least_id.component_id, s.doc_id) AS BIGINT) AS component_id
FROM s LEFT JOIN nodes ON s.grams = nodes.grams LEFT JOIN least_id USING (node)
"""


def op7_nearest_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .vector_index import nearest

    return nearest(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), "vec_id % 20 = 0", 20)


#: All pairs: on tables of this size the index finds all neighbours too.
OP7_SQL = """
WITH v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings WHERE vec_id IS NOT NULL AND len(embedding) > 0
           AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
p AS (SELECT q.vec_id AS query_id, c.vec_id, max(list_inner_product(q.e, c.e)) AS score FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0 GROUP BY ALL),
o AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM p)
SELECT query_id, rank, vec_id, score FROM o WHERE rank <= 20
"""


def queries() -> dict:
    own = (op1_token_store, op2_toxicity, op3_ngram_join, op4_url_rules, op5_secrets, op6_quality, op7_nearest_vectors, op8_packing, op9_repeated_passages, op10_decontamination)
    return {f.__name__: lean(f) for f in own}


def oracle_sql() -> dict[str, str]:
    return {"op3_ngram_join": OP3_SQL, "op4_url_rules": OP4_SQL, "op7_nearest_vectors": OP7_SQL}
