"""SQL of the queries that SQL can express over whole tables."""

_COMBOS = """e AS (SELECT run_id, combo_id, min(rho) AS rho, min(MAE) AS mae, min(RMSE) AS rmse FROM multiview_combos
  WHERE rho BETWEEN -1 AND 1 AND RMSE >= 0 AND isfinite(RMSE) AND isfinite(MAE) GROUP BY 1, 2)"""

_VECTORS = """v AS (SELECT DISTINCT row_id AS i, x_t AS x, "x_t-1" AS y, "x_t-2" AS z FROM block_3sp
  WHERE abs(x_t) < 9000 AND abs("x_t-1") < 9000 AND abs("x_t-2") < 9000 AND NOT isnan(x_t) AND NOT isnan("x_t-1") AND NOT isnan("x_t-2")),
r AS (SELECT a.i AS a, b.i AS b, (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) + (a.z - b.z) * (a.z - b.z) AS d FROM v a JOIN v b ON a.i <> b.i),
k AS (SELECT a, b, d, row_number() OVER (PARTITION BY a ORDER BY d, b) AS rank FROM r QUALIFY rank <= 5)"""

ORACLE = {
    "p4_found": f"""WITH {_VECTORS} SELECT p.a AS row_id_a, p.b AS row_id_b FROM k p JOIN k q ON p.a = q.b AND p.b = q.a WHERE p.a < p.b""",
    "p4_neighbours": f"""WITH {_VECTORS} SELECT a AS row_id, rank, b AS neighbour, round(sqrt(d), 9) AS distance FROM k WHERE a % 100 = 0""",
    "p1_found": f"""WITH {_COMBOS}
SELECT a.run_id, a.combo_id FROM e a LEFT JOIN e b ON a.run_id = b.run_id AND a.combo_id <> b.combo_id GROUP BY 1, 2
HAVING count(*) FILTER (b.combo_id IS NOT NULL AND (a.rho > b.rho)::INT + (a.mae < b.mae)::INT + (a.rmse < b.rmse)::INT < 2) = 0""",
    "p1_ranking": f"""WITH {_COMBOS},
l AS (SELECT run_id, combo_id, 0 AS j, rho AS v FROM e UNION ALL SELECT run_id, combo_id, 1, -mae FROM e UNION ALL SELECT run_id, combo_id, 2, -rmse FROM e),
c AS (SELECT *, count(*) OVER (PARTITION BY run_id, j) AS n, count(*) OVER (PARTITION BY run_id, j, v) AS eq, rank() OVER (PARTITION BY run_id, j ORDER BY v) - 1 AS lt FROM l),
p AS (SELECT *, round(CASE WHEN n > 1 THEN (lt + (eq - 1) / 2) / (n - 1) ELSE 0.5 END, 12) AS p FROM c)
SELECT a.run_id, a.combo_id, round(coalesce(sum(least(greatest((a.p - b.p) / 0.25, 0), 1) - least(greatest((b.p - a.p) / 0.25, 0), 1)) / any_value(a.n - 1) / 3, 0), 6) AS net_flow
FROM p a LEFT JOIN p b ON a.run_id = b.run_id AND a.j = b.j AND a.combo_id <> b.combo_id GROUP BY 1, 2""",
    "p5_found": """SELECT target, "column", E FROM (
  SELECT *, row_number() OVER (PARTITION BY target ORDER BY rho DESC, E, "column") AS rn
  FROM (SELECT target, "column", E, max(rho) AS rho FROM embed_dim_columns WHERE rho BETWEEN -1 AND 1 GROUP BY ALL)) WHERE rn <= 5""",
    "p8_found": """WITH w AS (SELECT doc_id, substr(text, x, 140) AS w FROM (SELECT doc_id, text, unnest(range(1, length(text) - 138)) AS x FROM documents WHERE length(text) >= 140)),
s AS (SELECT w FROM w GROUP BY w HAVING min(doc_id) <> max(doc_id))
SELECT DISTINCT doc_id FROM w SEMI JOIN s USING (w)""",
    "p8_share": """WITH w AS (SELECT doc_id, x, substr(text, x, 140) AS w FROM (SELECT doc_id, text, unnest(range(1, length(text) - 138)) AS x FROM documents WHERE length(text) >= 140)),
s AS (SELECT w FROM w GROUP BY w HAVING min(doc_id) <> max(doc_id)),
h AS (SELECT doc_id, x FROM w SEMI JOIN s USING (w)),
c AS (SELECT doc_id, sum(least(140, coalesce(nx - x, 140)))::BIGINT AS shared_chars FROM (SELECT doc_id, x, lead(x) OVER (PARTITION BY doc_id ORDER BY x) AS nx FROM h) GROUP BY 1)
SELECT d.doc_id, coalesce(length(text), 0) AS n_chars, coalesce(shared_chars, 0) AS shared_chars,
  CASE WHEN coalesce(length(text), 0) > 0 THEN round(coalesce(shared_chars, 0) / length(text), 6) ELSE 0.0 END AS share
FROM documents d LEFT JOIN c USING (doc_id)""",
}
