"""DuckDB SQL of the registered queries, written independently of the DataFrame plans."""

from __future__ import annotations

TERMS = "list_filter(regexp_split_to_array(lower({t}), '[^a-z0-9]+'), lambda x: x <> '')"


def terms(t: str) -> str:
    return TERMS.format(t=f"coalesce({t}, '')")


CORPUS = f"""
c AS (SELECT doc_id AS chunk_id, text, {terms('text')} AS tt FROM documents),
stat AS (SELECT count(*) AS n, avg(len(tt)) AS avg_len FROM c),
tf AS (SELECT chunk_id, term, count(*) AS tf, max(l) AS len FROM (SELECT chunk_id, len(tt) AS l, unnest(tt) AS term FROM c) GROUP BY ALL),
dfs AS (SELECT term, count(*) AS df, sum(tf) AS tf_total FROM tf GROUP BY term)"""

TOP = CORPUS + f"""
, q AS (
  SELECT qid, term, count(*) AS times, min(pos) AS pos
  FROM (SELECT item_id AS qid, unnest(tt) AS term, generate_subscripts(tt, 1) AS pos FROM (SELECT item_id, {terms('text')} AS tt FROM benchmark))
  GROUP BY ALL
), sc AS (
  SELECT qid, chunk_id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * len / avg_len)) * times), 9) AS score, min(pos) AS pos
  FROM q JOIN dfs USING (term) JOIN tf USING (term), stat GROUP BY qid, chunk_id
), top AS (
  SELECT qid, row_number() OVER (PARTITION BY qid ORDER BY score DESC, pos, chunk_id) AS rank, chunk_id, score FROM sc QUALIFY rank <= 20
)"""

VECTORS = """
v AS (
  SELECT qid, row_number() OVER (PARTITION BY qid ORDER BY score DESC, chunk_id) AS rank, chunk_id, score
  FROM (SELECT a.vec_id AS qid, b.vec_id AS chunk_id, round(list_cosine_similarity(b.embedding::DOUBLE[], a.embedding::DOUBLE[]), 9) AS score
        FROM embeddings a, embeddings b WHERE a.vec_id % 20 = 0)
  QUALIFY rank <= 20
)"""

FUSED = TOP + "," + VECTORS + """
, fu AS (
  SELECT qid, chunk_id, round(sum(1.0::DOUBLE / (60 + rank)), 9) AS fused, min(vr) AS vector_rank, min(lr) AS lexical_rank
  FROM (SELECT qid, chunk_id, rank, rank AS vr, NULL AS lr FROM v UNION ALL SELECT qid, chunk_id, rank, NULL, rank FROM top WHERE qid % 20 = 0)
  GROUP BY qid, chunk_id
), rrf AS (
  SELECT qid, row_number() OVER (PARTITION BY qid ORDER BY fused DESC, vector_rank NULLS LAST, lexical_rank NULLS LAST, chunk_id) AS rank, chunk_id, fused, vector_rank, lexical_rank
  FROM fu QUALIFY rank <= 20
)"""

RERANKED = TOP + f"""
, cand AS (
  SELECT top.qid, top.rank AS was, top.chunk_id, list_distinct({terms('b.text')}) AS qt, c.tt, d.source, b.text AS question
  FROM top JOIN benchmark b ON b.item_id = top.qid JOIN c USING (chunk_id) JOIN documents d ON d.doc_id = top.chunk_id
), rel AS (
  SELECT *, round(len(list_intersect(qt, list_distinct(tt)))::DOUBLE / len(qt), 6) AS rerank_score FROM cand
), re AS (
  SELECT *, row_number() OVER (PARTITION BY qid ORDER BY rerank_score DESC, was) AS rank FROM rel QUALIFY rank <= 5
)"""

TOKENS = r"regexp_extract_all({t}, '\s*\S+')"
HEADED = "(SELECT doc_id, array_to_string(list_transform(string_split(text, chr(10)), lambda x, i: CASE WHEN (i - 1) % 3 = 0 THEN chr(10) || i || '. Clause' || chr(10) || x ELSE x END), chr(10)) AS text FROM documents)"
HEAD = r"(?i)^\s*((ANNEX|APPENDIX|ARTICLE|EXHIBIT|SCHEDULE|SECTION)\b|[0-9]+(\.[0-9]+)*\s*\.?\s+\S)"

STRUCTURED = rf"""
ln AS (SELECT doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) AS pos FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM pages)),
fl AS (SELECT *, trim(line) = '' AS blank, regexp_matches(line, '{HEAD}') AS heading FROM ln),
sg AS (SELECT *, sum(CASE WHEN blank OR heading THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY pos) AS s FROM fl),
seg AS (SELECT doc_id, s, trim(string_agg(line, chr(10) ORDER BY pos)) AS t FROM sg WHERE NOT blank GROUP BY doc_id, s),
nx AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY s) AS k, t, len({TOKENS.format(t='t')}) AS sz FROM seg WHERE t <> ''),
m AS (
  SELECT DISTINCT doc_id, 0 AS k, []::VARCHAR[] AS done, []::VARCHAR[] AS op, 0 AS n FROM nx
  UNION ALL
  SELECT m.doc_id, nx.k,
    CASE WHEN sz >= 100 AND len(op) = 0 THEN list_append(done, t) WHEN n + sz >= 100 THEN list_append(done, array_to_string(list_append(op, t), chr(10) || chr(10))) ELSE done END,
    CASE WHEN n + sz >= 100 THEN []::VARCHAR[] ELSE list_append(op, t) END,
    CASE WHEN n + sz >= 100 THEN 0 ELSE n + sz END
  FROM m JOIN nx ON nx.doc_id = m.doc_id AND nx.k = m.k + 1
), en AS (SELECT doc_id, arg_max(done, k) AS done, arg_max(op, k) AS op FROM m GROUP BY doc_id),
mg AS (
  SELECT doc_id, CASE WHEN len(op) = 0 THEN done WHEN len(done) = 0 THEN [array_to_string(op, chr(10) || chr(10))]
    ELSE list_append(done[1:len(done) - 1], done[len(done)] || chr(10) || chr(10) || array_to_string(op, chr(10) || chr(10))) END AS parts FROM en
), pt AS (SELECT doc_id, unnest(parts) AS t, generate_subscripts(parts, 1) - 1 AS segment FROM mg),
tk AS (SELECT doc_id, segment, {TOKENS.format(t='t')} AS tok FROM pt),
sw AS (
  SELECT doc_id, segment, w AS seq, tok[w * 450 + 1:w * 450 + 500] AS piece
  FROM (SELECT *, unnest(range(0, CASE WHEN len(tok) <= 500 THEN 1 ELSE CAST(ceil((len(tok) - 500) / 450.0) AS BIGINT) + 1 END)) AS w FROM tk WHERE len(tok) >= 30)
)"""

JUDGED = "(SELECT doc_id, quality, toxic, CASE WHEN doc_id % 5 = 0 THEN 'UNFAITHFUL' WHEN doc_id % 5 = 1 THEN 'PARTIAL' WHEN doc_id % 5 = 2 THEN 'UNKNOWN' ELSE 'FAITHFUL' END AS f FROM labels)"
METRICS = """SELECT unnest(['total', 'hits', 'faithful', 'partial', 'unfaithful', 'unknown', 'refusal_total', 'refusal_correct']) AS metric,
  unnest([count(*), count(*) FILTER (quality = 1), count(*) FILTER (f = 'FAITHFUL'), count(*) FILTER (f = 'PARTIAL'), count(*) FILTER (f = 'UNFAITHFUL'), count(*) FILTER (f = 'UNKNOWN'),
          count(*) FILTER (toxic = 1), count(*) FILTER (toxic = 1 AND quality = 0)]) AS v FROM """

INVOICES = """
l AS (SELECT l_orderkey, sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS s, list(CAST(l_extendedprice AS DECIMAL(18,2)) ORDER BY l_linenumber, l_extendedprice)[1] AS first FROM lineitem GROUP BY l_orderkey),
o AS (
  SELECT o_orderkey, o_orderkey % 8 AS k, o_orderkey % 3 AS m, coalesce(s, 0) AS s, CASE WHEN o_orderkey % 8 = 3 THEN coalesce(first, 0) ELSE 0 END AS lost, s IS NOT NULL AS has
  FROM orders LEFT JOIN l ON l_orderkey = o_orderkey
), x AS (
  SELECT *, CASE WHEN k = 4 THEN NULL WHEN m = 2 THEN 'nan'::DOUBLE ELSE CAST(s - lost + CASE WHEN m = 1 THEN 10.50 ELSE 0 END AS DOUBLE) END AS calc,
    CAST(s + CASE WHEN m = 1 THEN 10.50 ELSE 0 END + CASE WHEN k = 1 THEN 1.00 WHEN k = 6 THEN 0.04 ELSE 0 END AS DOUBLE) AS stated
  FROM o
), y AS (
  SELECT *, CASE WHEN k = 4 THEN 'Could not parse AI output as JSON' WHEN k = 2 THEN 'No total found on invoice' WHEN k = 3 AND has THEN 'One or more line items missing values'
    WHEN k IN (5, 7) OR m = 2 THEN '' WHEN abs(calc - stated) > 0.05
    THEN 'Line items sum to ' || regexp_replace(CAST(CAST(calc AS DECIMAL(28,6)) AS VARCHAR), '\\.?0+$', '') || ' but stated total is ' || regexp_replace(CAST(CAST(stated AS DECIMAL(28,6)) AS VARCHAR), '\\.?0+$', '')
    ELSE '' END AS reason FROM x
)"""

LEADS = """
raw AS (
  SELECT c_custkey AS k, CASE WHEN c_custkey % 50 = 0 THEN '' ELSE CASE WHEN c_custkey % 2 = 0 THEN 'User' ELSE 'user' END || (c_custkey % 400) || '@example.com' END AS email,
    CASE WHEN c_custkey % 4 = 0 THEN '+23480' || lpad(CAST(c_custkey AS VARCHAR), 8, '0') WHEN c_custkey % 4 = 1 THEN '+234803' || lpad(CAST(c_custkey AS VARCHAR), 7, '0') END AS phone,
    CASE WHEN c_custkey % 3 = 0 THEN 'Firm ' || c_custkey END AS company, c_custkey % 5 < 2 AS intent FROM customer
), dd AS (
  SELECT *, lower(email) AS e FROM raw WHERE k >= 100 AND email <> '' AND lower(email) NOT IN (SELECT lower(email) FROM raw WHERE k < 100)
  QUALIFY row_number() OVER (PARTITION BY lower(email) ORDER BY k) = 1
), scd AS (
  SELECT *, CAST(intent AS INT) + CAST(company IS NOT NULL AS INT) + CAST(phone IS NOT NULL AS INT) AS points FROM dd
)"""

TICKETS = """
t AS (
  SELECT conv_id AS ticket_id, ['order_status', 'order_status', 'return', 'complaint', 'other'][conv_id % 5 + 1] AS intent, (conv_id * 37 % 100) / 100.0 AS confidence,
    'user' || (conv_id % 30) || '@example.com' AS sender,
    nullif(regexp_extract(CASE WHEN conv_id % 3 = 0 THEN 'ORD-' || (10000 + conv_id % 40) ELSE text END, 'ORD-[0-9]+'), '') AS num
  FROM conversations WHERE turn = 0
), o AS (
  SELECT 'ORD-' || (10000 + o_orderkey) AS num, 'user' || (o_orderkey // 3) || '@example.com' AS email, CASE WHEN o_orderkey % 7 = 0 THEN 'refund voucher' ELSE 'lamp' END AS item
  FROM orders
), lk AS (
  SELECT t.*, CASE WHEN confidence < 0.6 THEN 'escalate' WHEN intent IN ('order_status', 'return') THEN intent ELSE 'escalate' END AS route, count(o.num) AS matches,
    coalesce(string_agg(DISTINCT o.num, ',' ORDER BY o.num), '') AS found, min(o.num) AS one, min(o.item) AS item
  FROM t LEFT JOIN o ON CASE WHEN t.num IS NOT NULL THEN o.num = t.num ELSE o.email = t.sender END GROUP BY ALL
), dr AS (
  SELECT *, CASE WHEN route = 'escalate' THEN NULL WHEN route = 'return' THEN 'We have received your return request; a colleague will review it.'
    WHEN matches = 1 THEN 'Order ' || one || ' (' || item || ') is in transit with UPS.' WHEN matches > 1 THEN 'Which order do you mean: ' || replace(found, ',', ', ') || '?' ELSE 'Please send us your order number.' END AS draft FROM lk
), oc AS (
  SELECT *, CASE WHEN route = 'escalate' OR (route = 'order_status' AND coalesce(draft, '') LIKE '%refund%') THEN 'escalate' WHEN route = 'return' THEN 'hold' WHEN matches = 1 THEN 'auto_send' ELSE 'clarify' END AS outcome FROM dr
)"""

ORACLE: dict[str, str] = {
    "bm25_topk": f"WITH {TOP} SELECT qid, CAST(rank AS INT) AS rank, chunk_id AS doc_id, round(score, 4) AS score FROM top",
    "bm25_stats": f"WITH {CORPUS} SELECT term, df, CAST(tf_total AS BIGINT) AS tf_total, round(ln(1 + (n - df + 0.5) / (df + 0.5)), 6) AS idf FROM dfs, stat",
    "vector_topk": f"WITH {VECTORS} SELECT qid, CAST(rank AS INT) AS rank, chunk_id, round(score, 4) AS score FROM v",
    "rrf_fusion": f"WITH {FUSED} SELECT qid, CAST(rank AS INT) AS rank, chunk_id, round(fused, 6) AS fused, CAST(vector_rank AS INT) AS vector_rank, CAST(lexical_rank AS INT) AS lexical_rank FROM rrf",
    "hybrid_gate": f"""WITH {FUSED}, g AS (SELECT id AS qid, coalesce(max(score), 0.0) AS bm25_top FROM (SELECT vec_id AS id FROM embeddings UNION SELECT item_id FROM benchmark) LEFT JOIN top ON qid = id WHERE id % 20 = 0 GROUP BY id)
SELECT g.qid, CAST(x.rank AS INT) AS rank, x.chunk_id, round(v.score, 4) AS similarity, bm25_top >= 150.0 AS used_hybrid, round(bm25_top, 4) AS bm25_top
FROM g JOIN (SELECT qid, rank, chunk_id, true AS h FROM rrf UNION ALL SELECT qid, rank, chunk_id, false FROM v) x ON x.qid = g.qid AND x.h = (bm25_top >= 150.0)
LEFT JOIN v ON v.qid = x.qid AND v.chunk_id = x.chunk_id""",
    "rerank_topk": f"WITH {RERANKED} SELECT qid, CAST(rank AS INT) AS rank, chunk_id, rerank_score FROM re",
    "citations_distinct": f"""WITH {RERANKED}, s AS (SELECT qid, source || '.pdf' AS source_file, CAST(chunk_id % 3 + 1 AS INT) AS page_number, min(rank) AS f FROM re GROUP BY ALL)
SELECT qid, source_file, page_number, CAST(row_number() OVER (PARTITION BY qid ORDER BY f) AS INT) AS place FROM s""",
    "refusal_gate": f"""WITH {RERANKED}, t AS (SELECT qid, max(rerank_score) AS top_score FROM re GROUP BY qid)
SELECT qid, top_score, CASE WHEN top_score < 0.5 THEN 'threshold' WHEN qid % 5 <> 0 AND qid % 3 IN (0, 2) THEN 'content' END AS refusal_type,
  top_score < 0.5 OR (qid % 5 <> 0 AND qid % 3 IN (0, 2)) AS refused, top_score < 0.5 AS generation_skipped FROM t""",
    "chunk_naive": rf"""WITH t AS (SELECT doc_id, {TOKENS.format(t="coalesce(text, '')")} AS tok FROM documents),
w AS (SELECT doc_id, i, tok[i * 500 + 1:i * 500 + 500] AS p FROM (SELECT *, unnest(range(0, CAST(ceil(len(tok) / 500.0) AS BIGINT))) AS i FROM t))
SELECT doc_id, CAST(i AS INT) AS seq, CAST(len(p) AS INT) AS n_tokens, md5(array_to_string(p, '')) AS chunk_md5 FROM w""",
    "chunk_overlapping": rf"""WITH t AS (SELECT doc_id, {TOKENS.format(t="coalesce(text, '')")} AS tok FROM documents),
w AS (SELECT doc_id, i, tok[i * 450 + 1:i * 450 + 500] AS p FROM (SELECT *, unnest(range(0, CASE WHEN len(tok) <= 500 THEN 1 ELSE CAST(ceil((len(tok) - 500) / 450.0) AS BIGINT) + 1 END)) AS i FROM t))
SELECT doc_id, CAST(i AS INT) AS seq, CAST(len(p) AS INT) AS n_tokens, md5(array_to_string(p, '')) AS chunk_md5 FROM w""",
    "chunk_structured": f"""WITH RECURSIVE pages AS {HEADED}, {STRUCTURED}
SELECT doc_id, CAST(segment AS INT) AS segment, CAST(seq AS INT) AS seq, CAST(len(piece) AS INT) AS n_tokens, md5(array_to_string(piece, '')) AS chunk_md5 FROM sw""",
    "chunk_coverage_summary": rf"""WITH RECURSIVE pages AS (SELECT doc_id, CASE WHEN doc_id % 10 = 0 THEN ' ' ELSE text END AS text FROM {HEADED}), {STRUCTURED},
f AS (SELECT count(*) AS pages, count(*) FILTER (trim(text) = '') AS empty_pages, count(*) FILTER (doc_id IN (SELECT doc_id FROM fl WHERE heading)) AS heading_pages FROM pages),
nv AS (SELECT least(500, len(tok) - i * 500) AS n FROM (SELECT tok, unnest(range(0, CAST(ceil(len(tok) / 500.0) AS BIGINT))) AS i FROM (SELECT {TOKENS.format(t='text')} AS tok FROM pages))),
a AS (SELECT count(*) AS naive_chunks, round(avg(n), 4) AS naive_avg, min(n) AS naive_min, max(n) AS naive_max FROM nv),
b AS (SELECT count(*) AS structured_chunks, round(avg(len(piece)), 4) AS structured_avg, min(len(piece)) AS structured_min, max(len(piece)) AS structured_max FROM sw)
SELECT f.*, a.*, b.*, round(100.0 * heading_pages / nullif(pages - empty_pages, 0), 4) AS heading_share, structured_chunks - naive_chunks AS chunk_difference FROM f, a, b""",
    "eval_hit_rate": f"""WITH {TOP}, tr AS (SELECT item_id AS qid, doc_id FROM benchmark b JOIN documents d ON contains(d.text, b.text)),
h AS (SELECT tr.qid, bool_or(top.rank <= 5) AS hit FROM tr LEFT JOIN top ON top.qid = tr.qid AND top.chunk_id = tr.doc_id GROUP BY tr.qid)
SELECT count(*) AS total, count(*) FILTER (hit) AS hits, round(100.0 * count(*) FILTER (hit) / nullif(count(*), 0), 4) AS hit_rate, CAST(0 AS BIGINT) AS refusal_total, CAST(NULL AS DOUBLE) AS refusal_accuracy FROM h""",
    "no_answer_split": "SELECT item_id AS qid FROM benchmark b WHERE NOT EXISTS (SELECT 1 FROM documents d WHERE contains(d.text, b.text))",
    "verdict_parse": f"SELECT doc_id, f AS faithfulness, CASE WHEN toxic = 1 THEN 'INCORRECT' ELSE 'CORRECT' END AS refusal FROM {JUDGED}",
    "judge_stability": f"""SELECT doc_id AS id, count(*) AS runs, count(DISTINCT v) AS verdicts, count(DISTINCT v) = 1 AS stable
FROM (SELECT doc_id, CASE WHEN doc_id % 7 = 0 AND run = 4 THEN 'PARTIAL' ELSE f END AS v FROM {JUDGED}, range(0, 5) AS r(run)) GROUP BY doc_id""",
    "rejudge_diff": f"""WITH a AS ({METRICS} {JUDGED}), b AS ({METRICS} (SELECT doc_id, quality, toxic, CASE WHEN doc_id % 11 = 0 THEN 'FAITHFUL' ELSE f END AS f FROM {JUDGED}))
SELECT metric, a.v AS "before", b.v AS "after", b.v - a.v AS change FROM a FULL JOIN b USING (metric)""",
    "backfill_resolve": f"""WITH {RERANKED}, s AS (
  SELECT re.qid, re.rank AS place, re.question, re.rerank_score, d.source AS source_file, CAST(d.doc_id // 20 % 10 AS INT) AS page_number FROM re JOIN documents d ON d.doc_id = re.chunk_id WHERE re.rank <= 3
), pg AS (SELECT source AS source_file, CAST(doc_id // 20 % 10 AS INT) AS page_number, doc_id, text FROM documents QUALIFY row_number() OVER (PARTITION BY source, doc_id // 20 % 10 ORDER BY doc_id) <= 100),
z AS (SELECT s.qid, place, s.source_file, s.page_number, pg.text,
    abs(round(len(list_intersect(list_distinct({terms('question')}), list_distinct({terms('pg.text')})))::DOUBLE / len(list_distinct({terms('question')})), 6) - rerank_score) <= 0.01 AS near
  FROM s JOIN pg USING (source_file, page_number)),
r AS (SELECT qid, place, source_file, page_number, CASE WHEN count(*) = 1 THEN max(text) WHEN count(*) FILTER (near) = 1 THEN max(text) FILTER (near) END AS t FROM z GROUP BY ALL)
SELECT qid, CAST(place AS INT) AS place, source_file, page_number, md5(t) AS text_md5, bool_and(t IS NOT NULL) OVER (PARTITION BY qid) AS resolved FROM r""",
    "eval_md_parse": """SELECT * FROM (VALUES
  (1, 'North Star', 'north.pdf', 'easy', 'What is the term?', 'Two years', '3,5,6,7'), (2, 'North Star', 'north.pdf', 'connecting', 'Who signs?', 'Both', '23,6'),
  (3, 'Blue Sea', 'blue.pdf', 'easy', 'Where?', 'Here', '36'), (1, 'North Star', 'north.pdf', 'none', 'What is the color?', 'never stated', ''), (2, 'Blue Sea', 'blue.pdf', 'none', 'Why?', 'no reason', '')
) AS t(id, document, source_file, type, question, detail, pages)""",
    "invoice_validate": f"WITH {INVOICES} SELECT o_orderkey, CASE WHEN k <> 4 THEN 'v' || m END AS vendor, calc AS calculated_total, reason <> '' AS needs_review, reason AS review_reason, k = 4 AS has_raw FROM y",
    "invoice_route": f"""WITH {INVOICES} SELECT CASE WHEN reason <> '' THEN 'review' ELSE 'books' END AS target, CASE WHEN k <> 4 THEN 'v' || m END AS vendor, count(*) AS n, count(*) FILTER (isnan(calc)) AS not_a_number FROM y GROUP BY ALL""",
    "lead_normalize": f"""WITH {LEADS} SELECT k AS lead_id, CASE k % 3 WHEN 0 THEN 'sheet' WHEN 1 THEN 'base' ELSE 'form' END AS origin, email, k % 4 <> 0 OR company IS NULL AS needs_cleanup, phone AS cleaned_phone, company AS cleaned_company FROM raw""",
    "lead_dedupe": f"WITH {LEADS} SELECT k AS lead_id, e AS email FROM dd",
    "lead_score_route": f"""WITH {LEADS}, ti AS (SELECT *, CASE WHEN points >= 3 THEN 'Hot' WHEN points >= 1 THEN 'Warm' ELSE 'Junk' END AS tier FROM scd)
SELECT k AS lead_id, points, tier, unnest(CASE tier WHEN 'Hot' THEN ['crm', 'alerts', 'records'] WHEN 'Warm' THEN ['crm', 'records'] ELSE ['records'] END) AS destination FROM ti""",
    "lead_dead_letters": "SELECT c_custkey AS lead_id, 'crm' AS stage, 'missing required field: email' AS error FROM customer WHERE c_custkey % 50 = 0",
    "dead_letter_digest": """SELECT strftime(ts, '%Y-%m-%d') AS day, 'stage' || (user_id % 3) AS stage, count(*) AS failures, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS first_failure, strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS last_failure
FROM events WHERE event_type = 'error' GROUP BY 1, 2""",
    "ticket_route": f"WITH {TICKETS} SELECT ticket_id, route, matches, found, draft, outcome FROM oc",
    "ticket_deflection": f"WITH {TICKETS} SELECT count(*) AS tickets, count(*) FILTER (outcome IN ('auto_send', 'clarify')) AS deflected, round(avg(CASE WHEN outcome IN ('auto_send', 'clarify') THEN 1.0 ELSE 0.0 END), 6) AS rate FROM oc",
    "guardrail_scan": """SELECT conv_id, turn, CASE WHEN conv_id % 3 = 0 THEN 'return' ELSE 'order_status' END AS route,
  CAST(CASE WHEN conv_id % 4 = 0 AND conv_id % 3 <> 0 THEN 1 WHEN conv_id % 4 = 1 AND conv_id % 3 = 0 THEN 1 WHEN conv_id % 4 = 2 THEN 1 ELSE 0 END AS INT) AS violations
FROM conversations WHERE role = 'assistant'""",
    "resume_anti": "SELECT doc_id AS id FROM documents WHERE doc_id % 2 = 1",
    "seeded_sample_ids": "SELECT doc_id FROM documents ORDER BY md5('42:' || doc_id), doc_id LIMIT 60",
    "per_document_counts": "SELECT source AS document, count(*) AS entries FROM documents GROUP BY source",
    "stream_poll_dedupe": "SELECT user_id, event_id, event_type FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) = 1",
    "stream_daily_counts": "SELECT strftime(ts, '%Y-%m-%d') AS day, event_type, count(*) AS failures FROM events GROUP BY 1, 2",
    "ask_questions": f"""WITH {TOP}, e AS (SELECT * FROM embeddings WHERE vec_id IN (SELECT doc_id FROM documents)), a AS (SELECT b.item_id AS qid, b.text AS question, e.embedding FROM benchmark b JOIN embeddings e ON e.vec_id = b.item_id),
v AS (SELECT qid, row_number() OVER (PARTITION BY qid ORDER BY score DESC, chunk_id) AS rank, chunk_id, score
  FROM (SELECT a.qid, e.vec_id AS chunk_id, round(list_cosine_similarity(e.embedding::DOUBLE[], a.embedding::DOUBLE[]), 9) AS score FROM a, e) QUALIFY rank <= 20),
lx AS (SELECT * FROM top WHERE qid IN (SELECT qid FROM a)),
g AS (SELECT a.qid, coalesce(max(score), 0.0) AS bm25_top FROM a LEFT JOIN lx USING (qid) GROUP BY a.qid),
fu AS (SELECT qid, chunk_id, round(sum(1.0::DOUBLE / (60 + rank)), 9) AS fused, min(vr) AS vr, min(lr) AS lr
  FROM (SELECT qid, chunk_id, rank, rank AS vr, NULL AS lr FROM v UNION ALL SELECT qid, chunk_id, rank, NULL, rank FROM lx) GROUP BY qid, chunk_id),
cd AS (SELECT g.qid, bm25_top, bm25_top >= 150.0 AS hyb, x.rank AS was, x.chunk_id FROM g JOIN (
  SELECT qid, row_number() OVER (PARTITION BY qid ORDER BY fused DESC, vr NULLS LAST, lr NULLS LAST, chunk_id) AS rank, chunk_id, true AS h FROM fu QUALIFY rank <= 20
  UNION ALL SELECT qid, rank, chunk_id, false FROM v) x ON x.qid = g.qid AND x.h = (bm25_top >= 150.0)),
rr AS (SELECT cd.*, d.text, d.source || '.pdf' AS f, d.doc_id % 3 + 1 AS p, a.question, round(coalesce(len(list_intersect(list_distinct({terms('a.question')}), list_distinct({terms('d.text')})))::DOUBLE / nullif(len(list_distinct({terms('a.question')})), 0), 0.0), 6) AS rs
  FROM cd JOIN documents d ON d.doc_id = cd.chunk_id JOIN a ON a.qid = cd.qid),
t5 AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY rs DESC, was) AS rank FROM rr QUALIFY rank <= 5),
pr AS (SELECT qid, string_agg(CAST(chunk_id AS VARCHAR), ',' ORDER BY rank) AS chunks, CAST(count(DISTINCT (f, p)) AS INT) AS n_citations, bool_or(hyb) AS used_hybrid, max(bm25_top) AS bm25_top, max(rs) AS top_score, count(*) AS n,
  length('Answer from these passages only.' || chr(10) || chr(10) || string_agg('[Source: ' || f || ', page ' || p || ']' || chr(10) || text, chr(10) || chr(10) ORDER BY rank) || chr(10) || chr(10) || 'Question: ' || max(question)) AS l FROM t5 GROUP BY qid)
SELECT qid, chunks, n_citations, used_hybrid, round(CASE WHEN true THEN bm25_top END, 4) AS bm25_top, top_score, CASE WHEN top_score < 0.5 THEN 'threshold' WHEN qid % 4 = 0 THEN 'content' END AS refusal_type, top_score < 0.5 OR qid % 4 = 0 AS refused, top_score < 0.5 AS generation_skipped,
  CASE WHEN top_score < 0.5 THEN 'Declined: no passage is close enough' WHEN qid % 4 = 0 THEN 'Declined: the passages do not hold the answer' ELSE 'Answered' END AS label,
  CASE WHEN top_score < 0.5 THEN 'The documents do not cover this.' ELSE n || ' passages, ' || l || ' characters' END AS answer FROM pr""",
    "prompt_assembly": """WITH p AS (SELECT source || '.pdf' AS f, doc_id % 3 + 1 AS p, arg_min(text, doc_id) AS t FROM documents GROUP BY 1, 2)
SELECT f AS source_file, md5('Answer from these passages only.' || chr(10) || chr(10) || string_agg('[Source: ' || f || ', page ' || p || ']' || chr(10) || t, chr(10) || chr(10) ORDER BY p) || chr(10) || chr(10) || 'Question: Why?') AS prompt_md5 FROM p GROUP BY f""",
    "embed_with_retries": """SELECT doc_id, CASE WHEN length(text) % 5 = 0 THEN 'failed' ELSE 'done' END AS status, CASE WHEN length(text) % 5 <> 0 THEN CAST(length(text) AS BIGINT) END AS first, CASE WHEN length(text) % 5 = 0 THEN 'ValueError' END AS error FROM documents WHERE text IS NOT NULL""",
    "collection_upsert": """WITH p AS (SELECT vec_id, CASE WHEN vec_id % 10 = 0 OR vec_id % 2 = 1 THEN 'new' ELSE 'old' END AS text FROM embeddings)
SELECT text, count(*) AS n, CAST(sum(vec_id) AS BIGINT) AS ids, CAST(0 AS BIGINT) AS "before", (SELECT count(*) FROM embeddings) AS stored FROM p GROUP BY text""",
    "limited_ids": "SELECT doc_id AS chunk_id FROM documents WHERE doc_id < 50",
    "results_joined": "SELECT d.doc_id AS id, lang, CAST(quality AS INT) AS quality, CAST(toxic AS INT) AS toxic FROM documents d JOIN labels l USING (doc_id)",
    "upsert_latest": "SELECT user_id, event_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1",
    "append_once": "SELECT DISTINCT user_id AS id FROM events",
    "copied_files": "SELECT string_split(url, '/')[-1] AS name, max(url) AS path FROM pages GROUP BY 1",
    "scanned_manifest": """WITH s AS (SELECT 'f' || (page_id % 40) AS f, page_id % 37 = 0 AS bad FROM pages), b AS (SELECT f, bool_or(bad) AS bad, count(*) AS n FROM s GROUP BY f)
SELECT count(*) AS documents_found, count(*) FILTER (NOT bad) AS documents_succeeded, count(*) FILTER (bad) AS documents_failed, CAST(coalesce(sum(n) FILTER (NOT bad), 0) AS BIGINT) AS pages, coalesce(string_agg(f, ',' ORDER BY f) FILTER (bad), '') AS failed FROM b""",
    "numbered_clauses": rf"""SELECT doc_id, count(*) AS clauses FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM {HEADED}) WHERE regexp_matches(line, '^\s*[0-9]+(\.[0-9]+)*\s*\.?\s+\S') GROUP BY doc_id""",
    "example_pick": """WITH c AS (SELECT doc_id, '1. ' || coalesce(text, '') AS t, CASE WHEN contains(upper(source || '.pdf'), '1') THEN 0 ELSE 1 END AS o FROM documents WHERE doc_id % 2 = 0 AND regexp_matches(coalesce(text, ''), '^[^ ]')),
a AS (SELECT doc_id FROM c WHERE contains(lower(t), 'the') ORDER BY o, doc_id LIMIT 1), b AS (SELECT doc_id FROM c WHERE contains(lower(t), 'und') AND doc_id NOT IN (FROM a) ORDER BY o, doc_id LIMIT 1),
r AS (SELECT doc_id, row_number() OVER (ORDER BY o, doc_id) AS k FROM c WHERE doc_id NOT IN (FROM a) AND doc_id NOT IN (FROM b)),
u AS (SELECT 1 AS g, doc_id, 'THE' AS keyword FROM a UNION ALL SELECT 2, doc_id, 'und' FROM b UNION ALL SELECT 2 + k, doc_id, 'any numbered clause' FROM r)
SELECT CAST(row_number() OVER (ORDER BY g) AS INT) AS place, doc_id AS chunk_id, keyword FROM u QUALIFY row_number() OVER (ORDER BY g) <= 4""",
    "phrase_search": "SELECT doc_id FROM documents WHERE contains(lower(text), 'the ')",
    "source_membership": "SELECT doc_id FROM documents WHERE source NOT IN (SELECT source FROM documents WHERE doc_id % 100 = 7)",
    "invoice_sinks": f"""WITH {INVOICES} SELECT CASE WHEN reason <> '' THEN 'review_queue' ELSE 'books' END AS sink, CASE WHEN k <> 4 THEN 'v' || m END AS vendor, regexp_replace(reason, ' [0-9.]+', '', 'g') AS review_reason, k = 4 AS has_raw, count(*) AS n FROM y GROUP BY ALL""",
    "lead_outbox": f"""WITH {LEADS}, s AS (SELECT email, CAST(intent AS INT) + CAST(company IS NOT NULL AS INT) + CAST(phone IS NOT NULL AS INT) AS points FROM raw),
r AS (SELECT email, unnest(CASE WHEN points >= 3 THEN ['crm', 'alerts', 'records'] WHEN points >= 1 THEN ['crm', 'records'] ELSE ['records'] END) AS destination FROM s)
SELECT CASE WHEN email = '' THEN 'dead_letters' ELSE destination END AS destination, count(*) AS n FROM r GROUP BY 1""",
    "lead_company": f"""WITH {LEADS} SELECT k AS lead_id, k % 4 <> 0 OR company IS NULL OR k % 3 = 2 AS needs_cleanup, CASE WHEN company IS NOT NULL AND k % 3 <> 2 THEN company WHEN k % 2 = 0 THEN 'Acme N' || (k % 9) END AS cleaned_company FROM raw""",
    "ticket_classify": """SELECT conv_id AS ticket_id, CASE conv_id % 3 WHEN 0 THEN 'order_status' WHEN 1 THEN 'return' ELSE 'other' END AS intent, CASE WHEN conv_id % 3 = 0 THEN 'high' ELSE 'normal' END AS urgency,
  CASE WHEN conv_id % 3 = 1 THEN 'negative' ELSE 'neutral' END AS sentiment, CASE WHEN conv_id % 3 = 0 THEN 'ORD-' || conv_id END AS order_number, CASE conv_id % 3 WHEN 0 THEN 'order_status' WHEN 1 THEN 'return' ELSE 'escalate' END AS route FROM conversations WHERE turn = 0""",
    "ticket_escalations": f"""WITH {TICKETS} SELECT ticket_id, 'intent ' || intent || ' (' || CASE WHEN confidence < 0.6 THEN 'unsure' ELSE 'sure' END || '); ' || matches || ' orders found; ' || CASE WHEN route = 'order_status' THEN 'draft broke 1 rules' ELSE 'no draft was sent' END AS summary FROM oc WHERE outcome = 'escalate'""",
    "order_deadlines": """SELECT '00' || o_orderkey AS order_number, '0' || o_orderkey AS tracking_number, o_orderkey % 3 <> 0 AND date_diff('day', CAST(o_orderdate AS DATE), DATE '1996-06-30') > 7 AS late,
  o_orderkey % 5 <> 0 AND CAST(o_orderdate AS DATE) + 30 < DATE '1996-06-30' AS closed FROM orders""",
    "error_labels": """SELECT event_id, CASE event_id % 3 WHEN 0 THEN 'stop' WHEN 1 THEN 'slow_down' ELSE 'retry' END AS kind, CAST(CASE WHEN event_id % 2 = 0 THEN event_id % 60 + 1 ELSE 2 END AS DOUBLE) AS wait,
  CASE event_id % 3 WHEN 0 THEN '429 limit PerDay' WHEN 1 THEN '429 &lt;slow&gt; &amp; &quot;wait&quot;' ELSE 'boom' END AS html FROM events WHERE event_type = 'error'""",
}
