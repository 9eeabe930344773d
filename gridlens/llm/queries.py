"""Queries of this subpackage, by name, and their SQL where SQL can express them."""

from __future__ import annotations

import importlib

_NAMES = {
    "op1_embedding_near_dedup": "embedding",
    "op10_quality_rules": "quality",
    "op7_pii": "pii",
    "op2_toxicity": "toxicity",
    "op3_warc": "warc",
    "op4_best_fit_packing": "packing",
    "op5_sentencepiece": "pieces",
    "op8_token_counts": "pieces",
    "op6_suffix_array_dedup": "repeats",
    "op9_simhash_near_dedup": "simhash",
}


def queries() -> dict:
    return {name: getattr(importlib.import_module(f"gridlens.llm.{module}"), name) for name, module in _NAMES.items()}


_SQL = {
    "op1_embedding_near_dedup": """
        WITH RECURSIVE v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
        l AS (SELECT x.vec_id AS a, y.vec_id AS b FROM v x JOIN v y ON x.vec_id <> y.vec_id AND list_cosine_similarity(x.e, y.e) >= 0.95),
        r AS (SELECT vec_id AS n, vec_id AS m FROM v UNION SELECT r.n, l.b FROM r JOIN l ON r.m = l.a)
        SELECT n AS vec_id, coalesce(any_value(k), 0) AS n_links, min(m) AS component_id, n = min(m) AS kept
        FROM r LEFT JOIN (SELECT a, count(*) AS k FROM l GROUP BY a) ON a = n GROUP BY n""",
    "op3_warc": """
        SELECT page_id, strlen(h) AS payload_bytes, sha256(h) AS payload_digest,
          CASE WHEN strlen(h) >= 100 AND page_id <> first THEN 'revisit' ELSE 'response' END AS record_type,
          CASE WHEN strlen(h) >= 100 AND page_id <> first THEN first END AS refers_to
        FROM (SELECT page_id, coalesce(html, '') AS h, min(page_id) OVER (PARTITION BY coalesce(html, '')) AS first FROM pages)""",
}


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)
