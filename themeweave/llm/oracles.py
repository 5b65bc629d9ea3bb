"""DuckDB SQL for the operators that SQL can express, over whole tables."""

from __future__ import annotations

from string import ascii_lowercase, ascii_uppercase

from themeweave.llm import minhash_dedup, ngram_join
from themeweave.llm.columns import WORD_PATTERN
from themeweave.llm.hard_negatives import ANCHOR_STEP, HIGH_PERCENT, LOW_PERCENT, NEGATIVES, POSITIVES, SCALE

HARD_NEGATIVES = f"""WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)::BIGINT) AS c
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT a.vec_id AS anchor_id, b.vec_id AS other_id, a.label = b.label AS same,
         list_sum(list_transform(list_zip(a.c, b.c), lambda z: z[1] * z[2]))::BIGINT AS score
  FROM v a, v b WHERE a.vec_id % {ANCHOR_STEP} = 0 AND a.vec_id <> b.vec_id),
p AS (
  SELECT anchor_id, other_id AS positive_id, score AS positive_score FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) <= {POSITIVES}),
n AS (
  SELECT p.*, other_id AS negative_id, score AS negative_score,
         (row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, other_id))::INTEGER AS rank
  FROM p JOIN s USING (anchor_id)
  WHERE NOT same AND {LOW_PERCENT} * positive_score <= 100 * score AND 100 * score <= {HIGH_PERCENT} * positive_score)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM n WHERE rank <= {NEGATIVES}"""



def shingle_groups(size: int, percent: int, extra: str = "") -> str:
    """Groups of documents whose shingle sets link, from all pairs that share a shingle."""
    words = f"regexp_extract_all(translate(text, '{ascii_uppercase}', '{ascii_lowercase}'), '{WORD_PATTERN}')"
    joined = " || ' ' || ".join(f"w[i + {k}]" for k in range(size))
    return f"""WITH RECURSIVE w AS (SELECT doc_id, coalesce({words}, []) AS w FROM documents),
s AS (SELECT doc_id, unnest(list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < {size} THEN [array_to_string(w, ' ')]
        ELSE list_transform(range(1, len(w) - {size - 2}), lambda i: {joined}) END)) AS g FROM w),
n AS (SELECT doc_id, count(g) AS n FROM w LEFT JOIN s USING (doc_id) GROUP BY doc_id),
shared AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM shared JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= {percent} * (x.n + y.n - k)),
r AS (SELECT doc_id AS a, doc_id AS b FROM n UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a),
c AS (SELECT a AS doc_id, min(b) AS component_id FROM r GROUP BY a)
SELECT doc_id, n AS n_shingles, component_id{extra} FROM n JOIN c USING (doc_id)"""


SQL: dict[str, str] = {
    "op7_ngram_join": shingle_groups(ngram_join.SHINGLE, ngram_join.PERCENT),
    "op12_hard_negatives": HARD_NEGATIVES,
    "op13_minhash_dedup": shingle_groups(minhash_dedup.SHINGLE, minhash_dedup.PERCENT, ", doc_id = component_id AS kept"),
}
