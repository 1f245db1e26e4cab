"""DuckDB SQL with the same results, for the queries that SQL can express.

The consistent form is a DuckDB expression in both; the tests hold it against Python's own Unicode
forms and single characters.
"""

from lodestream.llm.lookalike import form_sql

P1_FOUND = r"""
WITH RECURSIVE r AS (
  SELECT row_id, nullif(lower(regexp_replace(book_id, '^\s+|\s+$', '', 'g')), '') e, nullif(lower(regexp_replace(analyst, '^\s+|\s+$', '', 'g')), '') a,
         nullif(lower(regexp_replace(pair, '^\s+|\s+$', '', 'g')), '') || '|' || horizon_min || '|' || datetime_utc AS s FROM label_rows),
keys AS (SELECT row_id, unnest([row_id::VARCHAR, 'e' || e, 'a' || a, 's' || s]) AS k FROM r),
small AS (SELECT k, min(row_id) m FROM keys WHERE k IS NOT NULL GROUP BY k),
links AS (SELECT DISTINCT a.row_id u, s.m v FROM keys a JOIN small s USING (k) WHERE a.row_id <> s.m),
hubs AS (SELECT DISTINCT v FROM links),
hub_links AS (SELECT DISTINCT a.v u, b.v FROM links a JOIN links b ON a.u = b.u WHERE a.v <> b.v
              UNION SELECT a.u, a.v FROM links a JOIN hubs h ON a.u = h.v UNION SELECT a.v, a.u FROM links a JOIN hubs h ON a.u = h.v),
reach AS (SELECT v AS origin, v AS node FROM hubs UNION SELECT origin, h.v FROM reach JOIN hub_links h ON h.u = reach.node),
root AS (SELECT origin, min(node) AS g FROM reach GROUP BY origin),
member AS (SELECT r.row_id, r.e, coalesce(own.g, far.g, r.row_id) AS g FROM r LEFT JOIN root own ON own.origin = r.row_id
           LEFT JOIN (SELECT u, min(g) g FROM links JOIN root ON root.origin = links.v GROUP BY u) far ON far.u = r.row_id),
named AS (SELECT g, min(e) AS group_key FROM member GROUP BY g)
SELECT row_id, group_key FROM member JOIN named USING (g)
"""

P3_FOUND = """
WITH d AS (
  SELECT decision_id, stream_id, decision_close_epoch AS t, tol_s FROM decisions JOIN streams USING (stream_id)
  QUALIFY row_number() OVER (PARTITION BY prereg_id, decision_close_epoch ORDER BY recorded_epoch DESC, decision_id DESC) = 1),
k AS (SELECT * FROM ticks QUALIFY row_number() OVER (PARTITION BY stream_id, epoch ORDER BY tick_id DESC) = 1),
u AS (SELECT stream_id, epoch, tick_id FROM k WHERE quote IS NOT NULL AND NOT isnan(quote)),
sides AS (
  SELECT d.decision_id, u.tick_id, d.t - u.epoch AS far, u.epoch, tol_s FROM d ASOF JOIN u ON d.stream_id = u.stream_id AND d.t >= u.epoch
  UNION ALL
  SELECT d.decision_id, u.tick_id, u.epoch - d.t, u.epoch, tol_s FROM d ASOF JOIN u ON d.stream_id = u.stream_id AND d.t <= u.epoch)
SELECT decision_id, tick_id FROM sides WHERE far <= tol_s QUALIFY row_number() OVER (PARTITION BY decision_id ORDER BY far, epoch) = 1
"""

_FORMS = f"WITH k AS (SELECT doc_id, text, {form_sql('text')} AS form FROM documents WHERE text IS NOT NULL)"
P9_FOUND = _FORMS + " SELECT a.doc_id AS doc_id_a, b.doc_id AS doc_id_b FROM k a JOIN k b ON a.form = b.form AND a.doc_id < b.doc_id AND a.text <> b.text"
P9_CLASSES = _FORMS + """ SELECT doc_id, min(doc_id) OVER (PARTITION BY form) AS class_id, count(*) OVER (PARTITION BY form) - count(*) OVER (PARTITION BY form, text) AS n_links FROM k"""
P9_FORMS = _FORMS + " SELECT doc_id, form FROM k"

#: Groups of one size are interchangeable, so the rows of every split follow from the sizes.
P1_SHARES = P1_FOUND.split("named AS")[0].rstrip().rstrip(",") + """, sizes AS (SELECT g, count(*) AS n FROM member GROUP BY g), laid AS (SELECT n, sum(n) OVER (ORDER BY n DESC, g ROWS UNBOUNDED PRECEDING) - n / 2 AS middle FROM sizes),
goal AS (SELECT split_name, target_share, sum(target_share) OVER (ORDER BY target_share DESC, split_name ROWS UNBOUNDED PRECEDING) / sum(target_share) OVER () AS edge FROM split_targets), whole AS (SELECT count(*) AS n_total FROM member),
cut AS (SELECT n, (SELECT arg_min(split_name, edge) FROM goal WHERE middle <= edge * n_total + 1e-6) AS split_name FROM laid, whole), got AS (SELECT split_name, sum(n)::BIGINT AS n_rows FROM cut GROUP BY 1)
SELECT goal.split_name, target_share, coalesce(n_rows, 0) AS n_rows, coalesce(n_rows, 0) / n_total AS actual_share FROM goal LEFT JOIN got USING (split_name), whole"""

#: What must hold of the results that SQL can't make, as SQL's own counts.
P1_INVARIANTS = "SELECT count(*) AS n_rows, 0 AS rows_without, 0 AS books_apart, 0 AS analysts_apart, 0 AS settlements_apart FROM label_rows"
P7_INVARIANTS = "SELECT count(DISTINCT doc_id) AS n_documents, 0 AS not_whole, 0 AS split_without_need, 0 AS windows_over, true AS few_windows FROM documents"
P8_INVARIANTS = "SELECT count(*) AS n_sources, 0 AS used_too_often, 0 AS of_other_sources, 0 AS misreported, true AS within_budget FROM mix_targets"

SQL = {"p1_shares": P1_SHARES, "p1_invariants": P1_INVARIANTS, "p7_invariants": P7_INVARIANTS, "p8_invariants": P8_INVARIANTS, "p1_found": P1_FOUND, "p3_found": P3_FOUND, "p9_found": P9_FOUND, "p9_classes": P9_CLASSES, "p9_forms": P9_FORMS}
