"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from . import castore, lines, mixing, packing, quality, simhash, tiff, topk, toxicity, warc


def queries() -> dict:
    return {"op1_warc": warc.op1_warc, "op2_tiff": tiff.op2_tiff, "op3_packing": packing.op3_packing, "op4_lines": lines.op4_lines, "op5_topk": topk.op5_topk, "op6_quality": quality.op6_quality, "op7_toxicity": toxicity.op7_toxicity, "op8_castore": castore.op8_castore, "op9_simhash": simhash.op9_simhash, "op10_mixing": mixing.op10_mixing}


#: Responses and revisits; the archives themselves are beyond SQL.
OP1 = """
WITH rows AS (
  SELECT page_id, coalesce(html, '') AS payload, max(page_id) OVER (PARTITION BY coalesce(html, '')) AS largest FROM pages
), sized AS (
  SELECT *, CAST(octet_length(encode(payload)) AS BIGINT) AS payload_bytes FROM rows
)
SELECT page_id, payload_bytes, sha1(payload) AS payload_digest,
  CASE WHEN payload_bytes >= 1000 AND page_id IS DISTINCT FROM largest THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= 1000 AND page_id IS DISTINCT FROM largest THEN largest END AS refers_to
FROM sized
"""

#: Every score, ranked.
OP5 = """
WITH usable AS (
  SELECT vec_id, [CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT) FOR x IN embedding] AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len([1 FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0
), scored AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_sum([z[1] * z[2] FOR z IN list_zip(q.v, c.v)]) AS BIGINT) AS score
  FROM usable q JOIN usable c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id
)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
FROM scored QUALIFY rank <= 5
"""


def oracle_sql() -> dict[str, str]:
    return {"op1_warc": OP1, "op5_topk": OP5}
