"""SQL counterparts of the training-data queries, where SQL can express them."""

CURRENT = """cur AS (
  SELECT doc_id, pos, token FROM (
    SELECT doc_id, pos, token, row_number() OVER (PARTITION BY doc_id, pos ORDER BY loaded_at DESC NULLS LAST) AS rn
    FROM corpus WHERE doc_id IS NOT NULL AND pos IS NOT NULL)
  WHERE rn = 1 AND token IN (SELECT token FROM vocab))"""

NUMBERED = f"""{CURRENT}, num AS (
  SELECT doc_id, pos, c.token, boundary, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS rk
  FROM cur c JOIN vocab v ON v.token = c.token)"""

FREQUENCY = f"""{CURRENT}, f AS (
  SELECT token, count(*) AS n, count(DISTINCT doc_id) AS docs FROM cur GROUP BY token),
marked AS (
  SELECT token, n, docs, CASE WHEN docs <= 2 THEN 'rare'
    WHEN docs > 0.5 * (SELECT count(DISTINCT doc_id) FROM cur) THEN 'common' END AS mark FROM f)"""

PAIRS = f"""{CURRENT}, b AS (SELECT DISTINCT doc_id, pos // 32 AS block, token FROM cur),
t AS (SELECT token, count(*) AS n_item FROM b GROUP BY token),
n AS (SELECT count(*) AS n FROM (SELECT DISTINCT doc_id, block FROM b)),
ab AS (SELECT x.token AS item_a, y.token AS item_b, count(*) AS n_ab
  FROM b x JOIN b y ON x.doc_id = y.doc_id AND x.block = y.block AND x.token < y.token
  GROUP BY ALL HAVING count(*) >= 15),
scored AS (SELECT item_a, item_b, n_ab, p.n_item AS n_a, q.n_item AS n_b, n,
    n_ab * n::DOUBLE / (p.n_item * q.n_item) AS lift
  FROM ab JOIN t p ON p.token = item_a JOIN t q ON q.token = item_b, n)"""

def _usable(column: str, dim: int) -> str:
    whole = f"list_transform({column}, lambda x: x::DOUBLE)"
    return f"""{column} IS NOT NULL AND len({column}) = {dim} AND len(list_filter({whole}, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
    AND len(list_filter({whole}, lambda x: x <> 0)) > 0"""


_REACH = """reach AS (
  SELECT grp, a AS node, a AS root FROM links
  UNION
  SELECT r.grp, l.b, r.root FROM reach r JOIN links l ON l.grp = r.grp AND l.a = r.node WHERE l.b > r.root),
keyed AS (SELECT grp, node AS id, min(root) AS group_key FROM reach GROUP BY ALL),
big AS (SELECT grp, group_key FROM keyed GROUP BY ALL HAVING count(*) >= 5)"""

GROUPS = {
    "h": f"""WITH RECURSIVE rec AS (SELECT DISTINCT 0 AS grp, row_index AS id, list_transform(h, lambda x: x::DOUBLE) AS v
  FROM work_sample WHERE row_index IS NOT NULL AND {_usable("h", 64)}),
links AS (SELECT x.grp, x.id AS a, y.id AS b FROM rec x JOIN rec y ON x.grp = y.grp AND list_cosine_similarity(x.v, y.v) >= 0.8), {_REACH}
SELECT 'h' AS field, id AS row_index, group_key FROM keyed JOIN big USING (grp, group_key)""",
    "responsibilities": f"""WITH RECURSIVE rows AS (SELECT t, row_index, sense_id, max(r) FILTER (NOT isnan(r)) AS r FROM responsibilities
  WHERE t IS NOT NULL AND row_index IS NOT NULL AND sense_id IS NOT NULL GROUP BY ALL),
k AS (SELECT t, count(DISTINCT sense_id) AS k FROM rows GROUP BY t),
rec AS (SELECT t AS grp, row_index AS id, list(r ORDER BY sense_id) AS v FROM rows JOIN k USING (t) WHERE r IS NOT NULL GROUP BY t, row_index, k HAVING count(*) = k),
links AS (SELECT x.grp, x.id AS a, y.id AS b FROM rec x JOIN rec y ON x.grp = y.grp AND list_cosine_similarity(x.v, y.v) >= 0.9), {_REACH}
SELECT 'responsibilities' AS field, id AS row_index, group_key FROM keyed JOIN big USING (grp, group_key)""",
}

NEAREST = f"""vec AS (SELECT DISTINCT emb_id, list_transform(e, lambda x: x::DOUBLE) AS v FROM embedding WHERE emb_id IS NOT NULL AND {_usable("e", 48)}),
close AS (SELECT x.emb_id AS emb_id, y.emb_id AS neighbour, list_cosine_similarity(x.v, y.v) AS cosine
  FROM vec x JOIN vec y ON x.emb_id <> y.emb_id),
ranked AS (SELECT *, row_number() OVER (PARTITION BY emb_id ORDER BY round(cosine, 6) DESC, neighbour) AS rank FROM close)"""

ORACLES: dict[str, str] = {
    "p1_found": f"""WITH {NUMBERED},
long AS (SELECT doc_id FROM num GROUP BY doc_id HAVING count(*) > 1024),
runs AS (SELECT doc_id, count(*) FILTER (boundary IS NULL) AS run FROM (
    SELECT *, count(boundary) OVER (PARTITION BY doc_id ORDER BY rk) AS g FROM num WHERE doc_id IN (SELECT doc_id FROM long))
  GROUP BY doc_id, g)
SELECT doc_id, CASE WHEN max(run) > 960 THEN 'inside' ELSE 'boundary' END AS cut FROM runs GROUP BY doc_id""",
    "p1_whole": f"WITH {NUMBERED} SELECT doc_id, count(*) AS n_tokens, sum(token::BIGINT * rk)::BIGINT AS check_sum, 0::BIGINT AS wrong FROM num GROUP BY doc_id",
    "p2_found": f"SELECT * FROM ({GROUPS['h']}) UNION ALL SELECT * FROM ({GROUPS['responsibilities']})",
    "p2_cells": f"SELECT * FROM ({GROUPS['h']}) UNION ALL SELECT * FROM ({GROUPS['responsibilities']})",
    "p5_found": f"""WITH {NEAREST} SELECT DISTINCT least(emb_id, neighbour) AS emb_a, greatest(emb_id, neighbour) AS emb_b
FROM ranked WHERE rank <= 5 AND cosine >= 0.9""",
    "p5_recall": f"""WITH {NEAREST.replace("x.emb_id <> y.emb_id", "x.emb_id <> y.emb_id AND x.emb_id % 100 = 0")}
SELECT count(DISTINCT emb_id) AS queries, count(*) AS partners, TRUE AS enough FROM ranked WHERE rank <= 5""",
    "p7_whole": "SELECT count(DISTINCT doc_id) + max((doc_id IS NULL)::BIGINT) AS documents, 0::BIGINT AS lost, 0::BIGINT AS divided_small, 0::BIGINT AS overfull, 0::BIGINT AS crowded FROM documents",
    "p3_found": f"WITH {FREQUENCY} SELECT token, mark FROM marked WHERE mark IS NOT NULL",
    "p3_frequency": f"WITH {FREQUENCY} SELECT token, n, docs, mark FROM marked",
    "p4_found": f"WITH {PAIRS} SELECT item_a AS token_a, item_b AS token_b FROM scored WHERE lift >= 10",
    "p4_large": f"""WITH {CURRENT}, b AS (SELECT DISTINCT doc_id, token FROM cur), t AS (SELECT token, count(*) AS n_item FROM b GROUP BY token),
n AS (SELECT count(DISTINCT doc_id) AS n FROM b), u AS (SELECT doc_id, token FROM b JOIN t USING (token), n WHERE n_item >= 5 AND n_item * 10 <= n),
ab AS (SELECT x.token AS item_a, y.token AS item_b, count(*) AS n_ab FROM u x JOIN u y ON x.doc_id = y.doc_id AND x.token < y.token GROUP BY ALL HAVING count(*) >= 5),
scored AS (SELECT item_a, item_b, n_ab, p.n_item AS n_a, q.n_item AS n_b, n, n_ab * n::DOUBLE / (p.n_item * q.n_item) AS lift FROM ab JOIN t p ON p.token = item_a JOIN t q ON q.token = item_b, n)
SELECT item_a, item_b, n_ab, n_a, n_b, n, lift, ln(lift) AS pmi FROM scored WHERE lift >= 10""",
    "p4_pairs": f"WITH {PAIRS} SELECT item_a, item_b, n_ab, n_a, n_b, n, lift, ln(lift) AS pmi FROM scored WHERE lift >= 10",
}
