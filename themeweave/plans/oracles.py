"""DuckDB SQL for the registered queries, over the same tables."""

from __future__ import annotations

from themeweave.functions.text import TOKEN_PATTERN
from themeweave.operators.clustering import DIGITS
from themeweave.plans.queries import (
    BATCH_SIZE,
    FIXED_DECODER,
    FIXED_ENCODER,
    FIXED_GENERATOR,
    LANG_CLUSTERS,
    LOG_EPOCHS,
    MAX_DF,
    MICRO_CLUSTERS,
    MIN_DF,
    NUM_TOPICS,
    NUM_WORDS,
    STOP,
    TOP_FEATURES,
    WARD_CLUSTERS,
)

_STOP_LIST = ", ".join(f"'{word}'" for word in STOP)
_POSITIONS = 1 << 31


def words(
    table: str = "documents",
    doc_id: str = "doc_id",
    cluster: str = "lang",
    lower: bool = True,
    stop: bool = True,
) -> str:
    """CTE ``w(doc_id, cluster, w)``: the tokens of each document in a list."""
    tokens = f"regexp_extract_all({'lower(text)' if lower else 'text'}, '{TOKEN_PATTERN}')"
    if stop:
        tokens = f"list_filter({tokens}, lambda x: x NOT IN ({_STOP_LIST}))"
    return f"w AS (SELECT {doc_id} AS doc_id, {cluster} AS cluster, {tokens} AS w FROM {table})"


def gram_list(n: int) -> str:
    joined = " || ' ' || ".join(f"w[i + {k}]" if k else "w[i]" for k in range(n))
    return f"list_transform(range(1, len(w) - {n - 2}), lambda i: {joined})"


def terms(bigrams: bool = False, name: str = "term", **how) -> str:
    """CTEs down to ``t(doc_id, cluster, pos, term)``."""
    grams = f"list_concat(w, {gram_list(2)})" if bigrams else "w"
    return f"""{words(**how)},
g AS (SELECT doc_id, cluster, {grams} AS g FROM w),
t AS (SELECT doc_id, cluster, unnest(g) AS {name}, (generate_subscripts(g, 1) - 1)::INTEGER AS pos FROM g)"""


def totals(bigrams: bool = False) -> str:
    return f"""{terms(bigrams)},
totals AS (SELECT term, count(DISTINCT doc_id) AS df, count(*) AS cf FROM t GROUP BY term),
n AS (SELECT count(*) AS n_docs FROM documents)"""


def vocabulary(extra: str = "") -> str:
    return f"""{totals()},
kept AS (SELECT * FROM totals, n WHERE df >= {MIN_DF} AND df <= {MAX_DF} * n_docs{extra}),
vocab AS (SELECT term, df, cf, (row_number() OVER (ORDER BY term) - 1)::INTEGER AS idx,
                 ln((1.0 + n_docs) / (1.0 + df)) + 1.0 AS idf FROM kept)"""


def weights() -> str:
    return f"""{vocabulary()},
tf AS (SELECT doc_id, term, idx, count(*) AS tf, count(*) * idf AS x
       FROM t JOIN vocab USING (term) GROUP BY doc_id, term, idx, idf),
norms AS (SELECT doc_id, sqrt(sum(x * x)) AS norm FROM tf GROUP BY doc_id),
tfidf AS (SELECT doc_id, term, idx, x / norm AS v FROM tf JOIN norms USING (doc_id))"""


def scored(bigrams: bool = True, **how) -> str:
    return f"""{terms(bigrams, **how)},
cf AS (SELECT term, count(*) AS cf FROM t GROUP BY term),
c AS (SELECT cluster, term, count(*) AS f, min(doc_id::HUGEINT * {_POSITIONS} + pos) AS first_occ
      FROM t GROUP BY cluster, term),
s AS (SELECT cluster, term, f, first_occ, f / sqrt(cf) AS score FROM c JOIN cf USING (term)),
o AS (SELECT cluster, (row_number() OVER (ORDER BY min(doc_id)) - 1)::INTEGER AS topic FROM w GROUP BY cluster),
best AS (SELECT topic, (row_number() OVER (PARTITION BY cluster ORDER BY score DESC, first_occ))::INTEGER AS rank,
                term, score FROM s JOIN o USING (cluster)),
tw AS (SELECT * FROM best WHERE rank <= {NUM_WORDS})"""


def doc_scores() -> str:
    return f"""{scored()},
raw AS (SELECT doc_id, unnest(regexp_extract_all(text, '{TOKEN_PATTERN}')) AS term FROM documents),
sums AS (SELECT doc_id, topic, sum(score) AS score FROM raw JOIN tw USING (term) GROUP BY doc_id, topic)"""


_SPREAD = """cells AS (SELECT vec_id, label, unnest(embedding)::DOUBLE AS x,
                 generate_subscripts(embedding, 1) AS coordinate FROM embeddings),
centroids AS (SELECT label, coordinate, count(*) AS n, avg(x) AS c FROM cells GROUP BY label, coordinate)"""


def ward_steps(source: str, clusters: int) -> str:
    """CTE ``m(step, left, right, cost, groups)``: the cheapest pair of ``source(g, n, c)`` merged step by step.

    ``groups`` holds what is left after the step; a group is named by its smallest member.
    """
    gap = "list_sum(list_transform(list_zip(a.c, b.c), lambda z: (z[1] - z[2]) * (z[1] - z[2])))"
    mean = "list_transform(list_zip(a.c, b.c), lambda z: (a.n * z[1] + b.n * z[2]) / (a.n + b.n))"
    return f"""m(step, a, b, cost, groups) AS (
  SELECT -1, NULL::INTEGER, NULL::INTEGER, NULL::DOUBLE, list({{'g': g, 'n': n::DOUBLE, 'c': c, 'of': [g]}} ORDER BY g) FROM {source}
  UNION ALL
  SELECT step + 1, best.a.g, best.b.g, best.cost,
         list_append(list_filter(groups, lambda x: x.g <> best.a.g AND x.g <> best.b.g), best.made)
  FROM m, LATERAL (
    SELECT arg_min(a, (cost, a.g, b.g)) AS a, arg_min(b, (cost, a.g, b.g)) AS b, min(cost) AS cost,
           arg_min({{'g': a.g, 'n': a.n + b.n, 'c': {mean}, 'of': list_concat(a.of, b.of)}}, (cost, a.g, b.g)) AS made
    FROM (SELECT a, b, a.n * b.n / (a.n + b.n) * {gap} AS cost
          FROM (SELECT unnest(m.groups) AS a) x, (SELECT unnest(m.groups) AS b) y WHERE a.g < b.g)) best
  WHERE len(groups) > {clusters})"""


def micro_clusters(most: int) -> str:
    """CTEs down to ``moved(g, n, spread, c)``: cells of the grid over all vectors, then one round of nearest means."""
    steps = 1 << DIGITS
    return f"""x AS (SELECT vec_id, generate_subscripts(embedding, 1) AS k, unnest(embedding)::DOUBLE AS x FROM embeddings),
ends AS (SELECT k, min(x) AS lo, max(x) AS hi, row_number() OVER (ORDER BY max(x) - min(x) DESC, k) AS o FROM x GROUP BY k),
q AS (SELECT vec_id, o, CASE WHEN hi > lo THEN least(floor((x - lo) / (hi - lo) * {steps}), {steps - 1}) ELSE 0 END::INTEGER AS q
      FROM x JOIN ends USING (k)),
digits AS (SELECT vec_id, r, o, ((q >> ({DIGITS - 1} - r)) & 1)::VARCHAR AS bit FROM q, range({DIGITS}) t(r)),
keys AS (SELECT vec_id, string_agg(bit, '' ORDER BY r, o) AS key FROM digits GROUP BY vec_id),
sizes AS (SELECT level, count(DISTINCT key[1:level]) AS n FROM keys, range(0, {DIGITS} * (SELECT max(k) FROM x) + 1) t(level) GROUP BY level),
cells AS (SELECT vec_id, (dense_rank() OVER (ORDER BY key[1:(SELECT max(level) FROM sizes WHERE n <= {most})]) - 1)::INTEGER AS g FROM keys),
means AS (SELECT g, k, avg(x) AS m FROM cells JOIN x USING (vec_id) GROUP BY g, k),
centres AS (SELECT g, list(m ORDER BY k) AS c FROM means GROUP BY g),
v AS (SELECT vec_id, list_transform(embedding, lambda e: e::DOUBLE) AS v FROM embeddings),
near AS (SELECT vec_id, v, arg_min(g, list_distance(v, c)) AS g FROM v, centres GROUP BY vec_id, v),
moved AS (SELECT g, any_value(n) AS n, sum(n * var) AS spread, list(m ORDER BY k) AS c
          FROM (SELECT near.g, k, count(*) AS n, avg(x) AS m, var_pop(x) AS var FROM near JOIN x USING (vec_id) GROUP BY near.g, k) GROUP BY g)"""


def _layer(source: str, target: str, nth: int, n_in: int, n_out: int) -> str:
    """CTE for one layer of the closed-form nets over ``(vec_id, i, x)`` rows."""
    return f"""{target}_z AS (
  SELECT vec_id, u.i AS i,
         sum(x * sin(s.i * u.i + {nth}) / sqrt({float(n_in)})) + cos(u.i + {nth}) / 10 AS z
  FROM {source} s, (SELECT unnest(range(1, {n_out + 1})) AS i) u GROUP BY vec_id, u.i),
{target} AS (SELECT vec_id, i, CASE WHEN z > 0 THEN z ELSE 0.2 * z END AS x FROM {target}_z)"""


def _stack(source: str, prefix: str, first: int, widths: tuple[int, ...]) -> tuple[str, str]:
    """CTEs for consecutive layers, and the name of the last one."""
    ctes, at = [], source
    for k, (n_in, n_out) in enumerate(zip(widths, widths[1:])):
        ctes.append(_layer(at, f"{prefix}{k}", first + k, n_in, n_out))
        at = f"{prefix}{k}"
    return ",\n".join(ctes), at


_VEC = """vec AS (SELECT vec_id, generate_subscripts(embedding, 1) AS i, unnest(embedding)::DOUBLE AS x
        FROM embeddings)"""
_GEN, _GEN_OUT = _stack("vec", "gen", 0, FIXED_GENERATOR)
_AUTO_WIDTHS = FIXED_ENCODER + FIXED_ENCODER[-2::-1]
_ENC, _ENC_OUT = _stack("vec", "enc", 3, FIXED_ENCODER)
_REAL, _REAL_OUT = _stack("vec", "real", 3, _AUTO_WIDTHS)
_FAKE, _FAKE_OUT = _stack(_GEN_OUT, "fake", 3, _AUTO_WIDTHS)
_DEC, _DEC_OUT = _stack("vec", "dec", 5, FIXED_DECODER)


def _cells(ctes: str, last: str) -> str:
    return f"WITH {ctes}\nSELECT vec_id, (i - 1)::INTEGER AS out_idx, round(x, 6) AS value FROM {last}"


def _cosine(name: str, original: str, rebuilt: str) -> str:
    return f"""{name} AS (SELECT vec_id, sum(a.x * b.x) /
    sqrt(greatest(sum(a.x * a.x), 1e-12) * greatest(sum(b.x * b.x), 1e-12)) AS cos
  FROM {original} a JOIN {rebuilt} b USING (vec_id, i) GROUP BY vec_id)"""


def build() -> dict[str, str]:
    lexicon = vocabulary()
    sql = {
        "tokenize": f"WITH {terms(name='token', stop=False)} SELECT doc_id, pos, token FROM t",
        "tokenize_raw": f"WITH {terms(name='token', stop=False, lower=False)} SELECT doc_id, pos, token FROM t",
        "remove_stopwords": f"WITH {words()} SELECT doc_id, len(w)::INTEGER AS n_tokens FROM w",
        "stopword_anti": f"""WITH {terms(stop=False)},
listed AS (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '{TOKEN_PATTERN}')) AS term FROM benchmark)
SELECT doc_id, count(*) AS n_tokens FROM t ANTI JOIN listed USING (term) GROUP BY doc_id""",
        "analyze_ngrams": f"WITH {terms(True)} SELECT doc_id, pos, term FROM t",
        "analyze_trigrams": f"""WITH {words()},
g AS (SELECT doc_id, list_concat({gram_list(2)}, {gram_list(3)}) AS g FROM w)
SELECT doc_id, len(g)::INTEGER AS n_terms, md5(array_to_string(g, '|')) AS digest FROM g""",
        "term_counts": f"WITH {terms()} SELECT doc_id, term, count(*) AS tf FROM t GROUP BY doc_id, term",
        "doc_freq": f"WITH {totals(True)} SELECT term, df, cf FROM totals",
        "prune_vocab": f"WITH {lexicon} SELECT term, df, cf FROM vocab",
        "prune_vocab_share": f"""WITH {totals()}
SELECT term, df, cf FROM totals, n WHERE df >= 0.02 * n_docs AND df <= 0.5 * n_docs""",
        "top_vocab": f"WITH {lexicon} SELECT term, df, cf FROM vocab ORDER BY cf DESC, term LIMIT {TOP_FEATURES}",
        "vocab_index": f"WITH {lexicon} SELECT term, df, cf, idx FROM vocab",
        "idf": f"WITH {lexicon} SELECT term, df, round(idf, 6) AS idf FROM vocab",
        "vocab_join": f"WITH {weights()} SELECT doc_id, term, tf FROM tf",
        "tfidf": f"WITH {weights()} SELECT doc_id, term, round(v, 6) AS tfidf FROM tfidf",
        "tfidf_rows": f"""WITH {weights()}
SELECT d.doc_id, count(v)::INTEGER AS nnz, round(coalesce(sqrt(sum(v * v)), 0), 6) AS norm
FROM documents d LEFT JOIN tfidf USING (doc_id) GROUP BY d.doc_id""",
        "tfidf_cells": f"WITH {weights()} SELECT doc_id, idx, round(v, 6) AS value FROM tfidf",
        "corpus_freq": f"WITH {terms(True)} SELECT term, count(*) AS cf FROM t GROUP BY term",
        "cluster_freq": f"""WITH {terms(cluster='source')}
SELECT cluster, term, count(*) AS f FROM t GROUP BY cluster, term""",
        "term_score": f"WITH {scored(False)} SELECT cluster, term, round(score, 6) AS score FROM s",
        "topic_number": """SELECT (row_number() OVER (ORDER BY min(doc_id)) - 1)::INTEGER AS topic,
       source AS cluster, count(*) AS n_docs FROM documents GROUP BY source""",
        "topic_words": f"WITH {scored()} SELECT topic, rank, term, round(score, 6) AS score FROM tw",
        "topic_words_nested": f"""WITH {scored()}
SELECT topic, count(*)::INTEGER AS n_terms, arg_min(term, rank) AS first_term,
       round(sum(score), 6) AS total_score FROM tw GROUP BY topic""",
        "conversation_topic_words": f"""WITH {scored(
            False, table="conversations", doc_id="row_number() OVER (ORDER BY conv_id, turn) - 1", cluster="role"
        )} SELECT topic, rank, term, round(score, 6) AS score FROM tw""",
        "topic_scores": f"WITH {doc_scores()} SELECT doc_id, topic, round(score, 6) AS score FROM sums",
        "topic_scores_dense": f"""WITH {doc_scores()}
SELECT d.doc_id, k.topic, round(coalesce(score, 0.0), 6) AS score
FROM documents d CROSS JOIN (SELECT unnest(range({LANG_CLUSTERS}))::INTEGER AS topic) k
LEFT JOIN sums ON sums.doc_id = d.doc_id AND sums.topic = k.topic""",
        "topic_scores_wide": f"""WITH {doc_scores()}
SELECT d.doc_id, {", ".join(
            f"round(coalesce(sum(score) FILTER (topic = {j}), 0.0), 6) AS topic_{j}" for j in range(LANG_CLUSTERS)
        )} FROM documents d LEFT JOIN sums USING (doc_id) GROUP BY d.doc_id""",
        "batching": f"""SELECT (r // {BATCH_SIZE})::BIGINT AS batch_id, count(*) AS n_rows,
       min(doc_id) AS min_doc, max(doc_id) AS max_doc
FROM (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS r FROM documents) GROUP BY 1""",
        "cluster_summary": f"""WITH {_SPREAD}
SELECT label, n, (coordinate - 1)::INTEGER AS coordinate, round(c, 6) AS centroid FROM centroids""",
        "ward_pair_cost": f"""WITH {_SPREAD}
SELECT a.label AS label_a, b.label AS label_b,
       round(a.n * b.n / (a.n + b.n) * sum((a.c - b.c) * (a.c - b.c)), 6) AS cost
FROM centroids a JOIN centroids b ON b.label = a.label + 1 AND b.coordinate = a.coordinate
GROUP BY a.label, b.label, a.n, b.n""",
        "ward_merge_costs": f"""WITH RECURSIVE {_SPREAD},
labels AS (SELECT label AS g, any_value(n) AS n, list(c ORDER BY coordinate) AS c FROM centroids GROUP BY label),
{ward_steps("labels", 1)}
SELECT step::INTEGER AS step, a AS left, b AS right, round(cost, 6) AS cost FROM m WHERE step >= 0""",
        "micro_clusters": f"""WITH {micro_clusters(MICRO_CLUSTERS)}
SELECT g AS group, n, round(spread, 6) AS spread, (generate_subscripts(c, 1) - 1)::INTEGER AS coordinate,
       round(unnest(c), 6) AS centroid FROM moved""",
        "ward_clusters": f"""WITH RECURSIVE {micro_clusters(MICRO_CLUSTERS)},
{ward_steps("moved", WARD_CLUSTERS)},
merged AS (SELECT c.g AS cluster, unnest(c.of) AS g FROM (SELECT unnest(arg_max(groups, step)) AS c FROM m)),
centred AS (SELECT vec_id, arg_min(moved.g, list_distance(v, c)) AS g FROM v, moved GROUP BY vec_id)
SELECT vec_id, min(vec_id) OVER (PARTITION BY cluster) AS cluster FROM centred JOIN merged USING (g)""",
        "encode_fixed": _cells(f"{_VEC},\n{_ENC}", _ENC_OUT),
        "decode_fixed": _cells(f"{_VEC},\n{_DEC}", _DEC_OUT),
        "reconstruct_fixed": _cells(f"{_VEC},\n{_REAL}", _REAL_OUT),
        "generate_fixed": _cells(f"{_VEC},\n{_GEN}", _GEN_OUT),
        "cosine_similarity": f"""WITH {_VEC},\n{_REAL},\n{_cosine("real_cos", "vec", _REAL_OUT)}
SELECT vec_id, round(cos, 6) AS cos FROM real_cos""",
        "generator_loss": f"""WITH {_VEC},\n{_GEN},\n{_FAKE},\n{_cosine("fake_cos", _GEN_OUT, _FAKE_OUT)}
SELECT round(-avg(cos), 6) AS loss FROM fake_cos""",
        "discriminator_loss": f"""WITH {_VEC},\n{_GEN},\n{_FAKE},\n{_REAL},
{_cosine("fake_cos", _GEN_OUT, _FAKE_OUT)},\n{_cosine("real_cos", "vec", _REAL_OUT)}
SELECT round(-(abs((SELECT avg(cos) FROM real_cos)) + abs((SELECT avg(cos) FROM fake_cos))), 6) AS loss""",
        "noise_source": """SELECT count(*) AS n_rows, 100::INTEGER AS dim, true AS all_in_unit_interval,
       0.5::DOUBLE AS mean FROM documents""",
        "init_weights": f"""WITH {lexicon}, v AS (SELECT count(*)::INTEGER AS v FROM vocab)
SELECT net, layer, n_in::INTEGER AS n_in, n_out::BIGINT AS n_out, true AS in_bounds FROM v, LATERAL (VALUES
  ('generator', 'input', 20, 20), ('generator', 'hidden', 20, 12), ('generator', 'output', 12, v),
  ('encoder', 'hidden', v, 8), ('encoder', 'output', 8, 4),
  ('decoder', 'hidden', 4, 8), ('decoder', 'output', 8, v)) AS layers(net, layer, n_in, n_out)""",
        "epoch_loss_stats": f"""SELECT (doc_id % {LOG_EPOCHS})::INTEGER AS epoch,
       round(avg(g), 6) AS gen_mean, round(stddev_pop(g), 6) AS gen_std,
       round(avg(d), 6) AS discr_mean, round(stddev_pop(d), 6) AS discr_std
FROM (SELECT doc_id, -length(text) / (length(text) + 100.0::DOUBLE) AS g, -(length(text) + 10.0::DOUBLE) / (length(text) + 50) AS d
      FROM documents) GROUP BY 1""",
        "column_norms": f"""WITH {_VEC},
norms AS (SELECT vec_id, sqrt(sum(x * x)) AS norm FROM vec GROUP BY vec_id)
SELECT label::VARCHAR AS layer, round(max(norm), 6) AS max_norm FROM norms JOIN embeddings USING (vec_id) GROUP BY label""",
        "fit_compressor": f"""WITH {lexicon}
SELECT 3::BIGINT AS n_epochs, true AS loss_finite, true AS loss_falls, true AS norms_ok, count(*)::INTEGER AS n_terms FROM vocab""",
        "extract_topics": f"""WITH {totals(True)}
SELECT any_value(n_docs) AS n_docs, {NUM_TOPICS}::BIGINT AS n_topics, true AS words_per_topic_ok,
       any_value(n_docs) * {NUM_TOPICS} AS n_scores, count(*) AS n_terms
FROM totals, n WHERE df >= {MIN_DF} AND df <= {MAX_DF} * n_docs""",
    }
    return sql
