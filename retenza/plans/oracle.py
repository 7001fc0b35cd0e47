"""DuckDB SQL for the correctness oracle.

Each query in the registry has an independent SQL statement over the
driver's raw tables (pre-registered as views). The adapter of
``sources/fixtures.py`` is re-expressed here as common table expressions
so the oracle never sees Spark output. Window length in the registered
queries is one day (``date_trunc('day', ts)``), sessions are user x ISO
week.
"""

from __future__ import annotations

DAY_MS = 86_400_000

RETAIL_EVENTS = f"""
ev0 AS (
  SELECT event_id, ts, user_id, event_type,
         CAST(json_extract_string(props, '$.k') AS BIGINT) AS k
  FROM events),
ev1 AS (
  SELECT *, CASE event_type WHEN 'view' THEN 'view-product' WHEN 'click' THEN 'search'
      WHEN 'purchase' THEN 'add-to-cart' WHEN 'error' THEN 'exit-risk'
      WHEN 'signup' THEN CASE WHEN k % 2 = 0 THEN 'view-cart' ELSE 'heartbeat' END
      END AS event
  FROM ev0),
revents AS (
  SELECT e.event_id, e.ts, CAST(e.user_id AS VARCHAR) AS userId,
    concat_ws('-', CAST(e.user_id AS VARCHAR), strftime(date_trunc('week', e.ts), '%Y-%m-%d')) AS sessionId,
    e.event,
    CASE WHEN e.event IN ('search','view-product','add-to-cart') THEN CAST(e.k AS VARCHAR) END AS productId,
    string_split(p.p_name, ' ')[-1] AS articleType,
    'size-' || CAST(p.p_size // 10 AS VARCHAR) AS subCategory,
    p.p_brand AS brand,
    CASE WHEN e.event = 'search' THEN p.p_name END AS query,
    CASE WHEN e.event = 'view-cart' THEN CAST(e.k % 4 + 1 AS INTEGER) END AS itemCount,
    CASE WHEN e.event = 'exit-risk' THEN 'logout-hover' END AS exitMethod
  FROM ev1 e LEFT JOIN part p
    ON e.k = p.p_partkey AND e.event IN ('search','view-product','add-to-cart'))"""

# Session-state validator (view-cart and product events without
# productId/articleType/subCategory go to the dead-letter side).
VALID_EVENTS = """
valid AS (
  SELECT * FROM revents
  WHERE sessionId IS NOT NULL AND userId IS NOT NULL AND ts IS NOT NULL
    AND event IN ('heartbeat','search','view-product','add-to-cart','exit-risk')
    AND (event IN ('heartbeat','exit-risk')
         OR (productId IS NOT NULL AND articleType IS NOT NULL AND subCategory IS NOT NULL))
    AND (event <> 'search' OR query IS NOT NULL))"""

SIGNAL_STATS = f"""
sig_ev AS (
  SELECT *, date_trunc('day', ts) AS wstart, NULLIF(productId, '') AS pid,
         NULLIF(articleType, '') AS atype
  FROM revents WHERE ts IS NOT NULL AND sessionId IS NOT NULL AND userId IS NOT NULL),
stats AS (
  SELECT wstart, sessionId AS sid,
    first(userId ORDER BY ts, event_id) AS uid,
    max(ts) AS lastTs,
    count(*) FILTER (WHERE event = 'exit-risk') AS exitCount,
    count(*) FILTER (WHERE event = 'add-to-cart') AS cartCount,
    count(*) FILTER (WHERE event = 'view-cart') AS viewCartCount,
    max(CASE WHEN event = 'view-cart' THEN itemCount ELSE 0 END) AS maxItemCount,
    count(DISTINCT CASE WHEN event IN ('view-product','search') THEN pid END) AS distinctProducts
  FROM sig_ev GROUP BY 1, 2),
art AS (
  SELECT wstart, sessionId AS sid, atype, count(*) AS cnt,
    max(ts) AS lts, last(event_id ORDER BY ts, event_id) AS leid
  FROM sig_ev WHERE event IN ('view-product','search') AND atype IS NOT NULL
  GROUP BY 1, 2, 3),
topic AS (
  SELECT wstart, sid, atype AS topArticleType FROM (
    SELECT *, row_number() OVER (PARTITION BY wstart, sid ORDER BY cnt DESC, lts, leid) AS rn
    FROM art) WHERE rn = 1),
sig_exit AS (
  SELECT sid || ':exitrisk:' || CAST(epoch_ms(lastTs) // {DAY_MS} AS VARCHAR) AS _id,
    sid, uid, 'exit-risk' AS signal,
    CASE WHEN exitCount >= 3 THEN 'high' WHEN exitCount = 2 THEN 'medium' ELSE 'low' END AS severity,
    CASE WHEN exitCount >= 3 THEN 'Strong exit intent detected in the last 1 day.'
         WHEN exitCount = 2 THEN 'Repeated exit signals detected in the last 1 day.'
         ELSE 'Early exit signals detected in the last 1 day.' END AS evidence,
    wstart + INTERVAL 1 DAY AS ts, CAST(NULL AS VARCHAR) AS productId,
    CAST(NULL AS INTEGER) AS distinctProducts,
    CAST(NULL AS VARCHAR) AS topic_dimension, CAST(NULL AS VARCHAR) AS topic_value
  FROM stats WHERE exitCount > 0),
sig_cart AS (
  SELECT sid || ':cartabandon:' || CAST(epoch_ms(lastTs) // {DAY_MS} AS VARCHAR) AS _id,
    sid, uid, 'cart-abandonment' AS signal,
    CASE WHEN items >= 3 THEN 'high' WHEN items = 2 THEN 'medium' ELSE 'low' END AS severity,
    'Customer is dwelling on a cart with ' || CAST(items AS VARCHAR)
      || ' item(s) and has not checked out in the last 1 day.' AS evidence,
    wstart + INTERVAL 1 DAY AS ts, CAST(NULL AS VARCHAR) AS productId,
    CAST(NULL AS INTEGER) AS distinctProducts,
    CAST(NULL AS VARCHAR) AS topic_dimension, CAST(NULL AS VARCHAR) AS topic_value
  FROM (SELECT *, CASE WHEN maxItemCount > 0 THEN maxItemCount ELSE 1 END AS items FROM stats)
  WHERE viewCartCount > 0),
sig_friction AS (
  SELECT s.sid || ':searchfriction:' || CAST(epoch_ms(s.lastTs) // {DAY_MS} AS VARCHAR) AS _id,
    s.sid, s.uid, 'search-friction' AS signal,
    CASE WHEN d >= 7 THEN 'high' WHEN d >= 5 THEN 'medium' ELSE 'low' END AS severity,
    CASE WHEN d >= 7 THEN 'Explored many products (' || CAST(d AS VARCHAR) || ') in the last 1 day with no add-to-cart, suggesting scattered attention and difficulty converging.'
         WHEN d >= 5 THEN 'Explored several products (' || CAST(d AS VARCHAR) || ') in the last 1 day with no add-to-cart, suggesting choice overload.'
         ELSE 'Explored a few products (' || CAST(d AS VARCHAR) || ') in the last 1 day with no add-to-cart, suggesting early search friction.' END AS evidence,
    s.wstart + INTERVAL 1 DAY AS ts, CAST(NULL AS VARCHAR) AS productId,
    CAST(d AS INTEGER) AS distinctProducts,
    CASE WHEN t.topArticleType IS NOT NULL THEN 'articleType' END AS topic_dimension,
    t.topArticleType AS topic_value
  FROM (SELECT *, distinctProducts AS d FROM stats) s
  LEFT JOIN topic t ON s.wstart = t.wstart AND s.sid = t.sid
  WHERE s.cartCount = 0 AND s.d >= 3),
sig_intent AS (
  SELECT c.sid || ':highintent:' || c.pid || ':' || CAST(epoch_ms(s.lastTs) // {DAY_MS} AS VARCHAR) AS _id,
    c.sid, s.uid, 'high-intent' AS signal, 'high' AS severity,
    'add-to-cart occurred for product in the last 1 day' AS evidence,
    c.wstart + INTERVAL 1 DAY AS ts, c.pid AS productId, CAST(NULL AS INTEGER) AS distinctProducts,
    CAST(NULL AS VARCHAR) AS topic_dimension, CAST(NULL AS VARCHAR) AS topic_value
  FROM (SELECT DISTINCT wstart, sessionId AS sid, pid FROM sig_ev
        WHERE event = 'add-to-cart' AND pid IS NOT NULL) c
  JOIN stats s ON s.wstart = c.wstart AND s.sid = c.sid),
signals AS (
  SELECT * FROM sig_exit UNION ALL SELECT * FROM sig_intent
  UNION ALL SELECT * FROM sig_friction UNION ALL SELECT * FROM sig_cart)"""

# Fixture rule: an NBA is redeemed when its user has a purchase in the day
# after the signal's ts.
NBAS = """
purchases AS (SELECT CAST(user_id AS VARCHAR) AS uid, ts FROM events WHERE event_type = 'purchase'),
nbas AS (
  SELECT s._id AS signal_id, s.uid, s.sid, s.signal, s.severity, s.ts,
    CASE s.signal WHEN 'search-friction' THEN 'discount-product-recommendation'
                  WHEN 'high-intent' THEN 'social-proof-notification'
                  WHEN 'exit-risk' THEN 'shipping-discount'
                  WHEN 'cart-abandonment' THEN 'cart-rescue' END AS type,
    EXISTS (SELECT 1 FROM purchases p WHERE p.uid = s.uid AND p.ts >= s.ts
            AND p.ts < s.ts + INTERVAL 1 DAY) AS redeemed,
    s.severity || '_' || s.signal AS triggeredBySignal,
    s.productId
  FROM signals s)"""


def with_ctes(*ctes: str) -> str:
    return "WITH " + ",".join(c.strip("\n") for c in ctes) + "\n"

SESSION_WINDOWS = """
vwin AS (
  SELECT *, date_trunc('day', ts) AS wstart,
    CASE event WHEN 'search' THEN 1 WHEN 'view-product' THEN 3 WHEN 'add-to-cart' THEN 7 ELSE 0 END AS weight,
    CASE WHEN event = 'exit-risk' THEN 1 ELSE 0 END AS priority
  FROM valid),
swin AS (
  SELECT wstart AS window_start, wstart + INTERVAL 1 DAY AS window_end, sessionId,
    first(userId ORDER BY ts, event_id) AS userId,
    min(ts) AS firstSeen, max(ts) AS lastSeen,
    first(event ORDER BY priority DESC, ts DESC, event_id DESC) AS lastEvent_event,
    first(ts ORDER BY priority DESC, ts DESC, event_id DESC) AS lastEvent_ts,
    count(*) FILTER (WHERE event = 'heartbeat') AS heartbeat_count,
    count(*) FILTER (WHERE event = 'search') AS search_count,
    count(*) FILTER (WHERE event = 'view-product') AS view_product_count,
    count(*) FILTER (WHERE event = 'add-to-cart') AS add_to_cart_count,
    count(*) FILTER (WHERE event = 'exit-risk') AS exit_risk_count,
    CAST(sum(CASE WHEN productId <> '' AND weight > 0 THEN weight ELSE 0 END) AS BIGINT) AS productWeightTotal,
    CAST(sum(CASE WHEN articleType <> '' AND weight > 0 THEN weight ELSE 0 END) AS BIGINT) AS articleTypeWeightTotal,
    CAST(sum(CASE WHEN subCategory <> '' AND weight > 0 THEN weight ELSE 0 END) AS BIGINT) AS subCategoryWeightTotal
  FROM vwin GROUP BY wstart, sessionId),
shist AS (
  SELECT sessionId, count(*) AS searchCount FROM valid
  WHERE event = 'search' AND query <> '' GROUP BY 1),
sstate AS (
  SELECT w.sessionId,
    first(userId ORDER BY window_start DESC) AS userId,
    min(firstSeen) AS firstSeen, max(lastSeen) AS lastSeen,
    first(lastEvent_event ORDER BY window_start DESC) AS lastEvent_event,
    first(lastEvent_ts ORDER BY window_start DESC) AS lastEvent_ts,
    max(window_start) AS lastWindow_start,
    CAST(sum(heartbeat_count) AS BIGINT) AS heartbeat_count,
    CAST(sum(search_count) AS BIGINT) AS search_count,
    CAST(sum(view_product_count) AS BIGINT) AS view_product_count,
    CAST(sum(add_to_cart_count) AS BIGINT) AS add_to_cart_count,
    CAST(sum(exit_risk_count) AS BIGINT) AS exit_risk_count,
    count(*) AS windowCount
  FROM swin w GROUP BY w.sessionId)"""


def intent_sql(key: str) -> str:
    """Long intent rows of one dimension over one-day windows."""
    return f"""
SELECT date_trunc('day', ts) AS window_start, sessionId, {key},
  CAST(count(*) FILTER (WHERE event = 'search') AS INTEGER) AS searchCount,
  CAST(count(*) FILTER (WHERE event = 'view-product') AS INTEGER) AS viewCount,
  CAST(count(*) FILTER (WHERE event = 'add-to-cart') AS INTEGER) AS addToCartCount,
  CAST(sum(weight) AS INTEGER) AS weight,
  sum(weight) / sum(sum(weight)) OVER (PARTITION BY date_trunc('day', ts), sessionId) AS focus
FROM vwin WHERE {key} <> '' AND weight > 0
GROUP BY 1, 2, 3"""


def _intent_text(key: str, name: str) -> str:
    return f"""{name} AS (
  SELECT window_start, sessionId, string_agg({key} || ':' || searchCount || ':' || viewCount || ':' || addToCartCount
    || ':' || weight || ':' || CAST(floor(focus * 1000000 + 0.5) AS BIGINT), ';' ORDER BY {key}) AS {name}
  FROM ({intent_sql(key)}) GROUP BY 1, 2)"""


#: The nested parts of the session documents as texts, per one-day window.
SESSION_ARRAYS = ",\n".join([
    _intent_text("productId", "products"), _intent_text("articleType", "articleTypes"),
    _intent_text("subCategory", "subCategories"),
    """searches AS (
  SELECT date_trunc('day', ts) AS window_start, sessionId, string_agg(query, '|' ORDER BY ts, event_id) AS searchHistory
  FROM valid WHERE event = 'search' AND query <> '' GROUP BY 1, 2)""",
    """sdocs AS (
  SELECT w.*, coalesce(products, '') AS products, coalesce(articleTypes, '') AS articleTypes,
    coalesce(subCategories, '') AS subCategories, coalesce(searchHistory, '') AS searchHistory
  FROM swin w LEFT JOIN products USING (window_start, sessionId) LEFT JOIN articleTypes USING (window_start, sessionId)
  LEFT JOIN subCategories USING (window_start, sessionId) LEFT JOIN searches USING (window_start, sessionId))"""])
#: Session state with the newest window's arrays and all searches in order.
SESSION_STATE_DOCS = """
SELECT s.*, coalesce(h.searchCount, 0) AS searchCount, d.products, d.articleTypes, d.subCategories,
  coalesce(a.searchHistory, '') AS searchHistory
FROM sstate s LEFT JOIN shist h ON s.sessionId = h.sessionId
JOIN sdocs d ON d.sessionId = s.sessionId AND d.window_start = s.lastWindow_start
LEFT JOIN (SELECT sessionId, string_agg(query, '|' ORDER BY ts, event_id) AS searchHistory
           FROM valid WHERE event = 'search' AND query <> '' GROUP BY 1) a ON a.sessionId = s.sessionId"""


FEATURES = """
feat_sig AS (
  SELECT uid, count(*) AS total_signals,
    count(*) FILTER (WHERE signal = 'exit-risk') AS exit_risk_count,
    count(*) FILTER (WHERE signal = 'search-friction') AS search_friction_count,
    count(*) FILTER (WHERE signal = 'high-intent') AS high_intent_count,
    count(DISTINCT sid) AS session_count
  FROM signals GROUP BY uid),
feat_nba AS (
  SELECT uid, count(*) AS total_nbas, count(*) FILTER (WHERE redeemed) AS redeemed_count
  FROM nbas GROUP BY uid),
features AS (
  SELECT s.uid, s.total_signals, s.exit_risk_count, s.search_friction_count, s.high_intent_count,
    s.session_count, coalesce(n.total_nbas, 0) AS total_nbas,
    coalesce(n.redeemed_count, 0) AS redeemed_count,
    CAST(s.exit_risk_count AS DOUBLE) / s.total_signals AS exit_risk_ratio,
    CASE WHEN coalesce(n.total_nbas, 0) > 0
         THEN CAST(n.redeemed_count AS DOUBLE) / n.total_nbas ELSE 0.0 END AS engagement_rate,
    CAST(s.total_signals AS DOUBLE) / s.session_count AS signals_per_session
  FROM feat_sig s LEFT JOIN feat_nba n ON s.uid = n.uid)"""

FEATURE_COLUMNS = ["total_signals", "exit_risk_count", "search_friction_count",
                   "high_intent_count", "session_count", "total_nbas", "redeemed_count",
                   "exit_risk_ratio", "engagement_rate", "signals_per_session"]


def tier_sql(p: str) -> str:
    return (f"CASE WHEN {p} > -0.01 AND {p} <= 0.3 THEN 'Low' "
            f"WHEN {p} > 0.3 AND {p} <= 0.6 THEN 'Medium' "
            f"WHEN {p} > 0.6 AND {p} <= 1.01 THEN 'High' END")


def top_factor_sql(weights: list[float]) -> str:
    """argmax of value x weight, first feature in order on a tie."""
    c = [f"(CAST(coalesce({f}, 0) AS DOUBLE) * {float(w)!r})"
         for f, w in zip(FEATURE_COLUMNS, weights)]
    branches = []
    for i, f in enumerate(FEATURE_COLUMNS):
        conds = [f"{c[i]} > {c[j]}" for j in range(i)] + \
                [f"{c[i]} >= {c[j]}" for j in range(i + 1, len(c))]
        branches.append(f"WHEN {' AND '.join(conds)} THEN '{f}'")
    return "CASE " + " ".join(branches) + " END"


def bm25_sql(queries_cte: str, k: int) -> str:
    """BM25 (k1 1.2, b 0.75) over name, articleType, subCategory, brand;
    ``queries_cte`` must define ``tq(query_id, text)``."""
    return f"""{queries_cte},
pdoc AS (SELECT CAST(p_partkey AS VARCHAR) AS _id,
  concat_ws(' ', p_name, string_split(p_name, ' ')[-1], 'size-' || CAST(p_size // 10 AS VARCHAR), p_brand) AS txt
  FROM part),
ptok AS (SELECT _id, list_filter(regexp_split_to_array(lower(txt), '[^a-z0-9]+'), lambda t: t <> '') AS toks FROM pdoc),
pdl AS (SELECT _id, len(toks) AS dl FROM ptok),
post AS (SELECT term, _id, count(*) AS tf FROM (SELECT _id, unnest(toks) AS term FROM ptok) GROUP BY 1, 2),
pdf AS (SELECT term, count(*) AS df FROM post GROUP BY 1),
pst AS (SELECT count(*) AS N, avg(dl) AS avgdl FROM pdl),
qtok AS (SELECT DISTINCT query_id, term FROM (
  SELECT query_id, unnest(list_filter(regexp_split_to_array(lower(text), '[^a-z0-9]+'), lambda t: t <> '')) AS term
  FROM tq)),
bsc AS (
  SELECT q.query_id, p._id,
    sum(ln(1 + (s.N - d.df + 0.5) / (d.df + 0.5)) * p.tf * 2.2
        / (p.tf + 1.2 * (1 - 0.75 + 0.75 * l.dl / s.avgdl))) AS score
  FROM qtok q JOIN pdf d ON q.term = d.term JOIN post p ON p.term = q.term
  JOIN pdl l ON l._id = p._id CROSS JOIN pst s GROUP BY 1, 2),
bm25 AS (SELECT * FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, _id) AS rank
  FROM bsc) WHERE rank <= {k})"""


CATALOG = """
cat AS (
  SELECT CAST(e.vec_id AS VARCHAR) AS _id, CAST(e.embedding AS DOUBLE[]) AS v
  FROM embeddings e JOIN part p ON e.vec_id = p.p_partkey WHERE e.embedding IS NOT NULL)"""


def knn_sql(queries_cte: str, k: int, exclude_self: bool = False) -> str:
    """Exact cosine top-k; ``queries_cte`` defines ``vq(query_id, qv)``."""
    cond = "WHERE c._id <> q.query_id" if exclude_self else ""
    return f"""{queries_cte},
vsc AS (SELECT q.query_id, c._id, list_cosine_similarity(q.qv, c.v) AS score
        FROM vq q, cat c {cond}),
knn AS (SELECT * FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, _id) AS rank
  FROM vsc) WHERE rank <= {k})"""


def features_sql(sig: str, nba: str, prefix: str) -> str:
    """The FEATURES fragment over other signal/NBA relations, CTE names prefixed."""
    out = FEATURES.replace("FROM signals", f"FROM {sig}").replace("FROM nbas", f"FROM {nba}")
    for name in ("feat_sig", "feat_nba", "features"):
        out = out.replace(f"{name} AS (", f"{prefix}{name} AS (")
        out = out.replace(f"FROM {name} ", f"FROM {prefix}{name} ")
        out = out.replace(f"JOIN {name} ", f"JOIN {prefix}{name} ")
    return out
