"""The registered queries of this subpackage: thin digests of what the operators return."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inundata.llm.centroids import centroid_clusters
from inundata.llm.filteraudit import NAMES, audit_texts
from inundata.llm.linededup import dedup_lines
from inundata.llm.mixing import mix_sources
from inundata.llm.neardup import near_duplicates
from inundata.llm.ngramjoin import jaccard_components
from inundata.llm.passages import remove_passages
from inundata.llm.pieces import encode_pieces
from inundata.llm.quality import apply_quality_rules
from inundata.llm.secrets import KINDS, scan_secrets
from inundata.llm.sharding import shard_documents
from inundata.llm.topk import top_inner_products
from inundata.llm.toxicity import labelled_sample, learn_lexicon, score_toxicity


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = apply_quality_rules(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "lost_chars", "kept")
    return judged.select("row.doc_id", *[f"quality.{n}" for n in names])


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = F.crc32(F.col("doc_id").cast("string")) % 5 == 0
    labels = _table(spark, sf_dir, "labels").where(~held_out).select("doc_id", F.col("toxic").cast("int").alias("toxic"))
    lexicon = learn_lexicon(labelled_sample(docs, labels))
    return score_toxicity(docs, lexicon).select(
        "doc_id", F.coalesce(held_out, F.lit(True)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted")
    )


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cleaned = dedup_lines(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    digest = F.sha2(F.coalesce("kept_text", F.lit("")), 256)
    return cleaned.select("row.doc_id", "n_lines", "n_dropped", digest.alias("kept_sha256"))


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    dealt = shard_documents(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return dealt.select(
        "row.doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


def op3_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return encode_pieces(_table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op4_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    scanned = scan_secrets(_table(spark, sf_dir, "documents").select("doc_id", "text"))

    def written(spans):
        kinds = F.array(*[F.lit(k) for k in KINDS])
        return F.array_join(
            F.transform(spans, lambda x: F.concat_ws(":", F.get(kinds, x["kind"]), x["start"].cast("string"), x["stop"].cast("string"))), ","
        )

    def of_kind(k: int):
        return F.size(F.filter("spans", lambda x: x["kind"] == k)).cast("long")

    return scanned.select(
        "row.doc_id",
        of_kind(0).alias("n_assign"),
        of_kind(1).alias("n_access"),
        of_kind(2).alias("n_hex"),
        F.sha2(written(F.filter("spans", lambda x: x["kind"] < 3)), 256).alias("base_sha256"),
        written(F.col("spans")).alias("spans"),
    )


def op7_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(_table(spark, sf_dir, "documents"))


def op8_embedding_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(_table(spark, sf_dir, "embeddings"))


def op9_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mix_sources(_table(spark, sf_dir, "documents").select("doc_id", "source", "text"))
    return mixed.select("row.doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


def op10_passage_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = remove_passages(_table(spark, sf_dir, "documents"))
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, x: n + x["stop"] - x["start"])
    return found.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), "kept_sha256")


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit_texts(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels")).drop("filter")


def op12_centroid_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroid_clusters(_table(spark, sf_dir, "embeddings"))


def op13_top_inner_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_inner_products(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        f.__name__: f
        for f in (
            op1_quality_rules,
            op2_sharding,
            op3_sentencepiece,
            op4_secret_scan,
            op5_toxicity,
            op6_line_dedup,
            op7_ngram_jaccard,
            op8_embedding_near_dup,
            op9_source_mix,
            op10_passage_dedup,
            op11_filter_audit,
            op12_centroid_clusters,
            op13_top_inner_products,
        )
    }


LINE_DEDUP_SQL = """WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS a FROM documents),
  l AS (SELECT doc_id, unnest(a) AS line, unnest(range(len(a))) AS pos FROM d),
  k AS (SELECT doc_id, pos, line, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
  g AS (SELECT key, max(doc_id) AS last FROM k WHERE length(key) >= 40 GROUP BY 1 HAVING count(DISTINCT doc_id) >= 5),
  m AS (SELECT k.doc_id, pos, line, g.key IS NOT NULL AND k.doc_id <> g.last AS gone FROM k LEFT JOIN g ON k.key = g.key)
  SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
    sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256 FROM m GROUP BY 1"""


#: Every order is walked: a document that fails a step's filter and none before it goes there.
FILTER_AUDIT_SQL = r"""WITH d AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t,
    list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
  l AS (SELECT doc_id, max(coalesce(quality = 1, false)::INT) AS good, max(coalesce(toxic = 1, false)::INT) AS toxic FROM labels GROUP BY 1),
  f AS (SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic, map(['A', 'B', 'C', 'D', 'E'],
    [len(w) < 200, 100 * len(list_distinct(w)) < 50 * len(w), 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 3 * length(t),
     regexp_matches(t, '[#$%&*|]'), coalesce(d.doc_id > min(d.doc_id) OVER (PARTITION BY t), false)]) AS fails FROM d LEFT JOIN l ON d.doc_id = l.doc_id),
  h AS (SELECT part, fails, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM f GROUP BY 1, 2),
  c AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS c),
  o AS (SELECT [a.c, b.c, e.c, g.c, i.c] AS o FROM c a, c b, c e, c g, c i WHERE len(list_distinct([a.c, b.c, e.c, g.c, i.c])) = 5),
  p AS (SELECT o, s FROM o, (SELECT unnest([1, 2, 3, 4, 5]) AS s)),
  x AS (SELECT part, array_to_string(o, '') AS filter_order, s AS step, o[s] AS filter, n, good, toxic, fails[o[s]] AS fails_own,
    len(list_filter(o[1:s - 1], lambda k: fails[k])) > 0 AS gone, len(list_filter(o, lambda k: fails[k])) AS total FROM h, p),
  r AS (SELECT part, filter_order, step, any_value(filter) AS filter, sum(CASE WHEN NOT gone AND NOT fails_own THEN n ELSE 0 END)::BIGINT AS kept,
    sum(CASE WHEN fails_own AND NOT gone THEN n ELSE 0 END)::BIGINT AS removed, sum(CASE WHEN fails_own AND gone THEN n ELSE 0 END)::BIGINT AS redundant,
    sum(CASE WHEN fails_own AND total = 1 THEN n ELSE 0 END)::BIGINT AS unique_fails, sum(CASE WHEN fails_own AND NOT gone THEN good ELSE 0 END)::BIGINT AS good_lost,
    sum(CASE WHEN fails_own AND NOT gone THEN toxic ELSE 0 END)::BIGINT AS toxic_lost FROM x GROUP BY 1, 2, 3)
  SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, sum(removed) OVER (PARTITION BY part, filter)::BIGINT AS shapley FROM r"""

USABLE_SQL = "embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0"


def centroid_sql(rounds: int = 10) -> str:
    """Every distance of every round, each round a step of its own."""
    near = """(SELECT vec_id, v, k, d, row_number() OVER (PARTITION BY vec_id ORDER BY d, k) AS place FROM
      (SELECT vec_id, v, k, list_sum(list_transform(range(1, 65), lambda i: (v[i] - c[i]) * (v[i] - c[i])))::BIGINT AS d FROM p, {c}))"""
    steps = [
        f"p AS MATERIALIZED (SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT) AS v FROM embeddings WHERE len(embedding) = 64 AND {USABLE_SQL})",
        "c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('3:' || vec_id)) - 1 AS k, v AS c FROM p QUALIFY k < 8)",
    ]
    for r in range(rounds):
        steps += [
            f"a{r} AS MATERIALIZED (SELECT v, k FROM {near.format(c=f'c{r}')} WHERE place = 1)",
            f"m{r} AS MATERIALIZED (SELECT k, i, floor(sum(x)::DOUBLE / count(*))::BIGINT AS about, sum(x) AS s, count(*) AS n FROM (SELECT k, unnest(v) AS x, unnest(range(1, 65)) AS i FROM a{r}) GROUP BY 1, 2)",
            f"c{r + 1} AS MATERIALIZED (SELECT k, coalesce(c.moved, old.c) AS c FROM c{r} old LEFT JOIN (SELECT k, list(CASE WHEN about * n > s THEN about - 1 WHEN (about + 1) * n <= s THEN about + 1 ELSE about END ORDER BY i) AS moved FROM m{r} GROUP BY 1) c USING (k))",
        ]
    last = near.format(c=f"c{rounds}")
    return f"""WITH {", ".join(steps)}, f AS MATERIALIZED (SELECT vec_id, k, d FROM {last} WHERE place = 1)
      SELECT vec_id, k::INTEGER AS cluster, d AS distance, sum(d) OVER (PARTITION BY k)::BIGINT AS cluster_inertia, sum(d) OVER ()::BIGINT AS inertia,
        sha256(array_to_string(c, ',')) AS centroid_sha256 FROM f JOIN c{rounds} USING (k)"""


TOP_SQL = f"""WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e FROM embeddings WHERE {USABLE_SQL}),
  s AS (SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.e, c.e)::BIGINT AS score FROM v q JOIN v c ON c.vec_id <> q.vec_id AND len(c.e) = len(q.e) WHERE q.vec_id % 50 = 0)
  SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank, vec_id, score FROM s QUALIFY rank <= 5"""


def oracle_sql() -> dict[str, str]:
    """The other queries hold learned, iterative or positional steps that SQL can't express on whole
    tables; their tests compare with brute force."""
    return {"op6_line_dedup": LINE_DEDUP_SQL, "op11_filter_audit": FILTER_AUDIT_SQL, "op12_centroid_clusters": centroid_sql(), "op13_top_inner_products": TOP_SQL}
