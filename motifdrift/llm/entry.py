"""Registered queries of this subpackage, and the SQL that gives the same rows where SQL can."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from motifdrift.llm import alignment, centroids, decontaminate, exact_dedup, lang_id, line_dedup, near_dedup, packing, ranking, secret_scan, sharding, token_store, toxicity
from motifdrift.llm.shared import table

SPACES = r"[\x20\x09-\x0D]+"


def op1_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_store.token_report(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.secret_report(table(spark, sf_dir, "documents"))


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.line_report(table(spark, sf_dir, "documents"))


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lang_id.language_report(table(spark, sf_dir, "documents"))


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed_documents(table(spark, sf_dir, "documents"))


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(table(spark, sf_dir, "documents"))


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.sharded_documents(table(spark, sf_dir, "documents"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity_report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_groups(table(spark, sf_dir, "documents"), least_percent=85)


def op11_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroids.cluster_report(table(spark, sf_dir, "embeddings"))


def op12_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.quality_report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op13_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return alignment.alignment_report(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_token_files": op1_token_files,
        "op2_secret_scan": op2_secret_scan,
        "op3_line_dedup": op3_line_dedup,
        "op4_language_id": op4_language_id,
        "op5_decontamination": op5_decontamination,
        "op6_packing": op6_packing,
        "op7_exact_dedup": op7_exact_dedup,
        "op8_sharding": op8_sharding,
        "op9_toxicity": op9_toxicity,
        "op10_near_dedup": op10_near_dedup,
        "op11_centroids": op11_centroids,
        "op12_quality": op12_quality,
        "op13_token_alignment": op13_token_alignment,
    }


def centroid_sql(k: int = centroids.K, rounds: int = centroids.ROUNDS, dim: int = centroids.DIM) -> str:
    """Rounds of assignment and floored means, one after another."""
    steps = [
        f"""v AS MATERIALIZED (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
              WHERE len(embedding) = {dim} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = {dim})""",
        f"c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('2:' || vec_id)) - 1 AS c, v FROM v ORDER BY c LIMIT {k})",
    ]
    for r in range(rounds + 1):
        steps.append(f"""a{r} AS MATERIALIZED (SELECT vec_id, v, arg_min(c, d * {k} + c) AS c, min(d) AS d FROM (
              SELECT v.vec_id, v.v, m.c, CAST(list_sum(list_transform(list_zip(v.v, m.v), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS BIGINT) AS d FROM v, c{r} m) GROUP BY ALL)
              """.replace("GROUP BY ALL", "GROUP BY vec_id, v"))
        steps.append(f"""c{r + 1} AS MATERIALIZED (SELECT m.c, coalesce(n.v, m.v) AS v FROM c{r} m LEFT JOIN (
              SELECT c, list((s - ((s % n) + n) % n) // n ORDER BY i) AS v FROM (
                SELECT c, i, CAST(sum(v[i]) AS BIGINT) AS s, count(*) AS n FROM a{r}, (SELECT unnest(range(1, {dim} + 1)) AS i) GROUP BY c, i) GROUP BY c) n USING (c))""")
    return f"""WITH {", ".join(steps[:-1])}
            SELECT vec_id, CAST(a.c AS INTEGER) AS cluster, d AS distance, CAST(sum(d) OVER (PARTITION BY a.c) AS BIGINT) AS cluster_inertia,
                   CAST(sum(d) OVER () AS BIGINT) AS inertia, sha256(array_to_string(m.v, ',')) AS centroid_sha256
            FROM a{rounds} a JOIN c{rounds} m USING (c)"""


def oracle_sql() -> dict[str, str]:
    return {
        "op11_centroids": centroid_sql(),
        "op3_line_dedup": r"""
            WITH l AS (SELECT doc_id, i, parts[i] AS line FROM (
                         SELECT doc_id, parts, unnest(range(1, len(parts) + 1)) AS i
                         FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents))),
                 k AS (SELECT doc_id, i, line, translate(regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'),
                              'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
                 r AS (SELECT key, max(doc_id) AS last FROM k WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3),
                 m AS (SELECT k.*, r.key IS NOT NULL AND k.doc_id <> r.last AS gone FROM k LEFT JOIN r USING (key))
            SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
                   sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256
            FROM m GROUP BY doc_id""",
        "op5_decontamination": r"""
            WITH t AS (SELECT 'd' AS kind, doc_id AS id, text FROM documents UNION ALL SELECT 'i', item_id, text FROM benchmark),
                 w AS (SELECT kind, id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                              '[^SPACE]+') AS words FROM t),
                 s AS (SELECT DISTINCT kind, id, array_to_string(words[i:i + 4], ' ') AS shingle
                       FROM (SELECT kind, id, words, unnest(range(1, greatest(len(words) - 4, 1) + 1)) AS i FROM w WHERE len(words) > 0)),
                 n AS (SELECT id AS item_id, count(*) AS n_item FROM s WHERE kind = 'i' GROUP BY id),
                 p AS (SELECT d.id AS doc_id, i.id AS item_id, count(*) AS n_shared FROM s d JOIN s i USING (shingle)
                       WHERE d.kind = 'd' AND i.kind = 'i' GROUP BY ALL)
            SELECT doc_id, item_id, n_item, n_shared, n_shared / n_item AS containment FROM p JOIN n USING (item_id)
            WHERE 100 * n_shared >= 80 * n_item""".replace("SPACE", SPACES[1:-2]),
        "op7_exact_dedup": rf"""
            WITH n AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '{SPACES}', ' ', 'g')) AS text_sha256 FROM documents)
            SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
                   doc_id = min(doc_id) OVER w AS kept, text_sha256
            FROM n WINDOW w AS (PARTITION BY text_sha256)""",
        "op10_near_dedup": r"""
            WITH RECURSIVE w AS MATERIALIZED (
                   SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^SPACE]+') AS words FROM documents),
                 s AS MATERIALIZED (
                   SELECT DISTINCT doc_id, hash(array_to_string(words[i:i + 4], ' ')) AS shingle
                   FROM (SELECT doc_id, words, unnest(range(1, greatest(len(words) - 4, 1) + 1)) AS i FROM w WHERE len(words) > 0)),
                 n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
                 p AS MATERIALIZED (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n_both FROM s a JOIN s b USING (shingle) WHERE a.doc_id < b.doc_id GROUP BY ALL),
                 l AS MATERIALIZED (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * n_both >= 85 * (x.n + y.n - n_both)),
                 e AS MATERIALIZED (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
                 r AS (SELECT doc_id AS node, doc_id AS comp FROM n UNION SELECT e.b, r.comp FROM r JOIN e ON e.a = r.node WHERE r.comp < e.b),
                 c AS (SELECT node, min(comp) AS comp FROM r GROUP BY node)
            SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, coalesce(c.comp, d.doc_id) AS component_id, d.doc_id = coalesce(c.comp, d.doc_id) AS kept
            FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN c ON c.node = d.doc_id""".replace("SPACE", SPACES[1:-2]),
    }
