"""The registered queries as SQL for DuckDB over the given tables.

Each statement is written from the definition of its result, not from the Spark plan: words
are cut and looked up instead of matched by one pattern, snapshots are plain sums over all
days up to theirs.
"""

from __future__ import annotations

from basketlens.adapters import FRAGMENTS, WORDS
from basketlens.functions.sentiment import Lexicon

BEHAVIOR = """
SELECT CASE WHEN event_id % 97 <> 0 THEN CAST(user_id AS VARCHAR) END AS user_id,
       CAST(event_id % 1000 AS VARCHAR) AS goods_id,
       json_extract_string(props, '$.k') AS category_id,
       CASE event_type WHEN 'view' THEN 'pv' WHEN 'click' THEN 'cart'
                       WHEN 'purchase' THEN 'buy' WHEN 'signup' THEN 'fav' END AS behavior,
       CAST(floor(epoch(ts)) AS BIGINT) AS "timestamp",
       CAST(user_id % 2 AS VARCHAR) AS sex,
       'NATION_' || CAST(user_id % 25 AS VARCHAR) AS address,
       'dev' || CAST(user_id % 3 AS VARCHAR) AS device,
       CAST(value AS DECIMAL(10,2)) AS price,
       CAST(1 AS INTEGER) AS amount,
       strftime(ts, '%Y%m%d') AS dt
FROM events"""

COMMENT = """
SELECT CAST(doc_id % 200 AS VARCHAR) AS user_id,
       CAST(doc_id % 1000 AS VARCHAR) AS goods_id,
       CAST(doc_id % 100 AS VARCHAR) AS category_id,
       text AS comment,
       '202401' || lpad(CAST(doc_id % 30 + 1 AS VARCHAR), 2, '0') AS dt
FROM documents"""

FACE = """
SELECT CASE WHEN c_custkey % 11 = 0 THEN 'guest-' ELSE '' END || CAST(c_custkey AS VARCHAR)
         AS user_id,
       c_mktsegment AS face
FROM customer"""

CATEGORY = """
SELECT CASE WHEN p_partkey % 10 = 9 THEN 'part-' ELSE '' END || CAST(p_partkey AS VARCHAR)
         AS category_id,
       CAST(p_size AS INTEGER) AS category_count,
       p_name AS category_label
FROM part"""

CLEAN_BEHAVIOR = """
SELECT DISTINCT user_id, category_id, behavior, sex, address, device, dt
FROM behavior WHERE user_id IS NOT NULL AND category_id IS NOT NULL"""

CLEAN_COMMENT = """
SELECT DISTINCT user_id, category_id, comment, dt
FROM remark WHERE user_id IS NOT NULL AND category_id IS NOT NULL"""

WIDE_BEHAVIOR = """
SELECT b.user_id, b.category_id, b.behavior, b.sex, b.address, b.device,
       f.face, c.category_label, b.dt
FROM clean_behavior b
LEFT JOIN face f ON b.user_id = f.user_id
LEFT JOIN category c ON b.category_id = c.category_id"""

WIDE_COMMENT = """
SELECT r.user_id, r.category_id, r.comment, f.face, c.category_label, r.dt
FROM clean_comment r
LEFT JOIN face f ON r.user_id = f.user_id
LEFT JOIN category c ON r.category_id = c.category_id"""


def _counts(pv: str, cart: str, buy: str) -> str:
    return ", ".join(
        f"CAST(count(*) FILTER (WHERE behavior = '{kind}') AS BIGINT) AS {name}"
        for kind, name in (("pv", pv), ("cart", cart), ("buy", buy))
    )


FACE_DAY = f"""
SELECT face, category_label, {_counts("pv_count", "cart_count", "buy_count")}, dt
FROM wide_behavior GROUP BY face, category_label, dt"""

GOODS_DAY = f"""
SELECT category_label, {_counts("total_pv", "total_cart", "total_buy")}, dt
FROM wide_behavior GROUP BY category_label, dt"""


def _in(words: frozenset[str]) -> str:
    return "(" + ", ".join(f"'{w}'" for w in sorted(words)) + ")"


def _score(text: str, lexicon: Lexicon) -> str:
    """Positive minus negative words, counted over the list of words of the text."""
    if lexicon.whole_words:
        words = rf"regexp_extract_all(lower({text}), '\p{{L}}+')"
    else:
        longest_first = sorted(lexicon.words, key=lambda w: (-len(w), w))
        words = f"regexp_extract_all({text}, '{'|'.join(longest_first)}')"
    return (
        f"CAST(len(list_filter({words}, lambda w : w IN {_in(lexicon.positive)}))"
        f" - len(list_filter({words}, lambda w : w IN {_in(lexicon.negative)})) AS INTEGER)"
    )


REPUTATION_DAY = f"""
SELECT category_label, CAST(count(*) AS BIGINT) AS total_comments,
       CAST(count(*) FILTER (WHERE label = 1) AS BIGINT) AS good_count,
       CAST(count(*) FILTER (WHERE label = 0) AS BIGINT) AS bad_count, dt
FROM (SELECT category_label, dt,
             CASE WHEN {_score("comment", WORDS)} >= 1 THEN 1 ELSE 0 END AS label
      FROM wide_comment)
GROUP BY category_label, dt"""

LAST_DAY = "SELECT max(dt) AS dt FROM behavior"


def _full(daily: str, keys: str, counters: list[str]) -> str:
    sums = ", ".join(f"CAST(sum({c}) AS BIGINT) AS {c}" for c in counters)
    last = "(SELECT dt FROM last_day)"
    return (
        f"SELECT {keys}, {sums}, {last} AS dt FROM {daily} WHERE dt <= {last} GROUP BY {keys}"
    )


FACE_FULL = _full("face_day", "face, category_label", ["pv_count", "cart_count", "buy_count"])
GOODS_FULL = _full("goods_day", "category_label", ["total_pv", "total_cart", "total_buy"])
REPUTATION_FULL = _full(
    "reputation_day", "category_label", ["total_comments", "good_count", "bad_count"]
)


def _weighted(pv: str, cart: str, buy: str) -> str:
    total = f"CAST(({pv} + {cart} * 5 + {buy} * 10) / 16.0 AS DECIMAL(27,6))"
    return f"CAST(round({total}, 2) AS DOUBLE)"


def _wilson(pos: str, total: str) -> str:
    p, n, z2 = f"(CAST({pos} AS DOUBLE) / {total})", f"CAST({total} AS DOUBLE)", "3.8416"
    root = f"sqrt(greatest(0.0, {p} * (1 - {p}) / {n} + {z2} / (4 * {n} * {n})))"
    bound = f"({p} + {z2} / (2 * {n}) - 1.96 * {root}) / (1 + {z2} / {n})"
    return (
        f"CASE WHEN {total} = 0 THEN CAST(0 AS DOUBLE)"
        f" ELSE greatest(CAST(0 AS DOUBLE), round(CAST({bound} AS DOUBLE), 4)) END"
    )


GOODS_POP = f"""
SELECT category_label, score, CAST(rk AS INTEGER) AS rk, dt FROM (
  SELECT category_label, score, dt,
         row_number() OVER (PARTITION BY dt
           ORDER BY score DESC NULLS LAST, category_label ASC NULLS LAST) AS rk
  FROM (SELECT category_label, dt, {_weighted("total_pv", "total_cart", "total_buy")} AS score
        FROM goods_day))
WHERE rk <= 100"""

FACE_FAVORITE = f"""
SELECT face, category_label, score, CAST(rk AS INTEGER) AS rk, dt FROM (
  SELECT face, category_label, score, dt,
         row_number() OVER (PARTITION BY dt, face
           ORDER BY score DESC NULLS LAST, category_label ASC NULLS LAST) AS rk
  FROM (SELECT face, category_label, dt,
               {_weighted("pv_count", "cart_count", "buy_count")} AS score
        FROM face_full))
WHERE rk <= 3"""

PV_TO_BUY = (
    f"SELECT category_label, {_wilson('total_buy', 'total_pv')} AS buy_rate, dt FROM goods_full"
)

GOODS_SCORE = (
    f"SELECT category_label, {_wilson('good_count', 'total_comments')} AS good_rate, dt"
    " FROM reputation_full"
)

COUNTERS = f"""
SELECT dt, category_id, {_counts("pv", "cart", "buy")}
FROM behavior GROUP BY dt, category_id"""

DAYS = "SELECT DISTINCT dt FROM behavior"

SNAPSHOTS = """
SELECT g.category_label, CAST(sum(g.total_pv) AS BIGINT) AS total_pv,
       CAST(sum(g.total_cart) AS BIGINT) AS total_cart,
       CAST(sum(g.total_buy) AS BIGINT) AS total_buy, d.dt
FROM days d JOIN goods_day g ON g.dt <= d.dt
GROUP BY g.category_label, d.dt"""

# Named parts in the order of their use of each other.
PARTS = {
    "behavior": BEHAVIOR,
    "remark": COMMENT,
    "face": FACE,
    "category": CATEGORY,
    "last_day": LAST_DAY,
    "days": DAYS,
    "clean_behavior": CLEAN_BEHAVIOR,
    "clean_comment": CLEAN_COMMENT,
    "wide_behavior": WIDE_BEHAVIOR,
    "wide_comment": WIDE_COMMENT,
    "face_day": FACE_DAY,
    "goods_day": GOODS_DAY,
    "reputation_day": REPUTATION_DAY,
    "face_full": FACE_FULL,
    "goods_full": GOODS_FULL,
    "reputation_full": REPUTATION_FULL,
    "goods_pop": GOODS_POP,
    "face_favorite": FACE_FAVORITE,
    "goods_pv_to_buy": PV_TO_BUY,
    "goods_score": GOODS_SCORE,
    "counters": COUNTERS,
    "snapshots": SNAPSHOTS,
}


def _statement(select: str) -> str:
    parts = ",\n".join(f"{name} AS ({body})" for name, body in PARTS.items())
    return f"WITH {parts}\n{select}"


NULL_LABEL = "category_label IS NULL"


def _violations(result: str, key: str, face: str) -> str:
    return f"""
SELECT '{result}' AS export, dt, {face} AS face, category_label,
       CAST(count(*) AS BIGINT) AS row_count,
       bool_or({" OR ".join(f"{k} IS NULL" for k in key.split(", "))}) AS null_key
FROM {result} GROUP BY {key}
HAVING count(*) > 1 OR {" OR ".join(f"{k} IS NULL" for k in key.split(", "))}"""


NO_FACE = "CAST(NULL AS VARCHAR)"
NO_RANK = "CAST(NULL AS INTEGER)"
IS_LAST = "dt = (SELECT dt FROM last_day)"

def _exported(result: str, rows: str, columns: str, key: str) -> str:
    """Rows of a result whose key has no null part, and the number of the others."""
    has_null = " OR ".join(f"{k} IS NULL" for k in key.split(", "))
    return f"""
SELECT '{result}' AS result, {columns}, dt,
       (SELECT CAST(count(*) AS BIGINT) FROM ({rows}) WHERE {has_null}) AS rejects
FROM ({rows}) WHERE NOT ({has_null})"""


EXPORTED = "\nUNION ALL\n".join(
    [
        _exported(
            "goods_pop",
            f"SELECT * FROM goods_pop WHERE {IS_LAST}",
            f"{NO_FACE} AS face, category_label, score AS value, rk",
            "category_label",
        ),
        _exported(
            "face_favorite",
            "SELECT * FROM face_favorite",
            "face, category_label, score AS value, rk",
            "face, category_label",
        ),
        _exported(
            "goods_pv_to_buy",
            "SELECT * FROM goods_pv_to_buy",
            f"{NO_FACE} AS face, category_label, buy_rate AS value, {NO_RANK} AS rk",
            "category_label",
        ),
        _exported(
            "goods_score",
            "SELECT * FROM goods_score",
            f"{NO_FACE} AS face, category_label, good_rate AS value, {NO_RANK} AS rk",
            "category_label",
        ),
    ]
)


def _snapshot_rows(daily: str, keys: str) -> str:
    """Rows of all snapshots of a history: one per key and day from its first day on."""
    return f"""(SELECT count(*) FROM (
      SELECT DISTINCT {keys}, d.dt FROM days d JOIN {daily} g ON g.dt <= d.dt))"""


def _favorite_rows() -> str:
    return """(SELECT coalesce(sum(least(n, 3)), 0) FROM (
      SELECT dt, face, count(*) AS n FROM (
        SELECT DISTINCT g.face, g.category_label, d.dt FROM days d JOIN face_day g ON g.dt <= d.dt)
      GROUP BY dt, face))"""


def _layer_rows() -> str:
    rows = {
        ("ods", "user_behavior_tmp"): f"(SELECT count(*) FROM behavior WHERE {IS_LAST})",
        ("ods", "user_comment_tmp"): f"(SELECT count(*) FROM remark WHERE {IS_LAST})",
        ("ods", "user_behavior_inc"): "(SELECT count(*) FROM behavior)",
        ("ods", "user_comment_inc"): "(SELECT count(*) FROM remark)",
        ("ods", "face"): "(SELECT count(*) FROM face)",
        ("ods", "category"): "(SELECT count(*) FROM category)",
        ("ods", "ods_user_face_full"): "(SELECT count(*) FROM face)",
        ("ods", "ods_category_mapping_full"): "(SELECT count(*) FROM category)",
        ("dwd", "dwd_user_behavior"): "(SELECT count(*) FROM wide_behavior)",
        ("dwd", "dwd_user_comment"): "(SELECT count(*) FROM wide_comment)",
        ("dws", "dws_face_day"): "(SELECT count(*) FROM face_day)",
        ("dws", "dws_face_full"): _snapshot_rows("face_day", "face, category_label"),
        ("dws", "dws_goods_day"): "(SELECT count(*) FROM goods_day)",
        ("dws", "dws_goods_full"): _snapshot_rows("goods_day", "category_label"),
        ("dws", "dws_goods_reputation_day"): "(SELECT count(*) FROM reputation_day)",
        ("dws", "dws_goods_reputation_full"): _snapshot_rows("reputation_day", "category_label"),
        ("ads", "ads_goods_pop"): "(SELECT count(*) FROM goods_pop)",
        ("ads", "ads_face_favorite"): _favorite_rows(),
        ("ads", "ads_goods_pv_to_buy"): _snapshot_rows("goods_day", "category_label"),
        ("ads", "ads_goods_score"): _snapshot_rows("reputation_day", "category_label"),
    }
    return "\nUNION ALL\n".join(
        f"SELECT '{layer}' AS layer, '{name}' AS table_name, CAST({count} AS BIGINT) AS row_count"
        for (layer, name), count in rows.items()
    )


SPLIT_RANGES = """
SELECT CAST(CASE WHEN user_id IS NULL THEN 0
                 ELSE (user_id - low) // width END * 2 + goods_id % 2 AS INTEGER) AS split_id,
       CAST(count(*) AS BIGINT) AS row_count, CAST(0 AS BIGINT) AS misplaced
FROM (SELECT CAST(user_id AS BIGINT) AS user_id, CAST(goods_id AS BIGINT) AS goods_id
      FROM behavior),
     (SELECT min(CAST(user_id AS BIGINT)) AS low,
             CAST(ceil((max(CAST(user_id AS BIGINT)) - low + 1) / 3.0) AS BIGINT) AS width
      FROM behavior)
GROUP BY 1"""

ALL_BEHAVIOR = (
    'user_id, goods_id, category_id, behavior, "timestamp", sex, address, device, price, amount'
)

SELECTS = {
    "src_behavior_csv": f"SELECT {ALL_BEHAVIOR}, dt FROM behavior",
    "src_comment_csv": "SELECT user_id, goods_id, category_id, comment, dt FROM remark",
    "src_text_staging": "SELECT user_id, goods_id, category_id, comment FROM remark",
    "sink_text_truncate": f"SELECT {ALL_BEHAVIOR} FROM behavior",
    "jdbc_split_ranges": SPLIT_RANGES,
    "load_dim_face": "SELECT * FROM face",
    "load_dim_category": "SELECT * FROM category",
    "scan_dimension": "SELECT category_id, category_label FROM category",
    "scan_partition_pruned": "SELECT user_id, category_id, behavior, sex, address, device, dt"
    f" FROM behavior WHERE {IS_LAST}",
    "src_result_partition": "SELECT category_label, score, CAST(rk AS BIGINT) AS rk, dt"
    f" FROM goods_pop WHERE {IS_LAST}",
    "ods_load_behavior": "SELECT * FROM behavior",
    "ods_load_comment": "SELECT user_id, goods_id, category_id, comment, dt FROM remark",
    "sink_partition_overwrite": "SELECT * FROM goods_day",
    "sink_bucketed_dim": "SELECT * FROM face",
    "sink_replace_day": f"SELECT category_label, {_wilson('total_buy', 'total_pv')} AS buy_rate,"
    " dt FROM snapshots",
    "dq_export_keys": "\nUNION ALL\n".join(
        [
            _violations("goods_pop", "dt, category_label", NO_FACE),
            _violations("face_favorite", "dt, face, category_label", "face"),
            _violations("goods_pv_to_buy", "dt, category_label", NO_FACE),
            _violations("goods_score", "dt, category_label", NO_FACE),
        ]
    ),
    "dwd_project_behavior": "SELECT user_id, category_id, behavior, sex, address, device, dt"
    " FROM behavior",
    "dwd_drop_null_keys": "SELECT user_id, category_id, behavior, sex, address, device, dt"
    " FROM behavior WHERE user_id IS NOT NULL AND category_id IS NOT NULL",
    "dwd_dedup_behavior": "SELECT * FROM clean_behavior",
    "dwd_dedup_comment": "SELECT * FROM clean_comment",
    "dwd_join_face": "SELECT b.*, f.face FROM clean_behavior b"
    " LEFT JOIN face f ON b.user_id = f.user_id",
    "dwd_join_category": "SELECT b.*, c.category_label FROM clean_behavior b"
    " LEFT JOIN category c ON b.category_id = c.category_id",
    "dwd_user_behavior": "SELECT * FROM wide_behavior",
    "dwd_user_comment": "SELECT * FROM wide_comment",
    "align_columns": "SELECT * FROM wide_behavior",
    "join_bucketed": "SELECT b.user_id, b.category_id, b.behavior, b.sex, b.address, b.device,"
    " b.dt, f.face FROM behavior b LEFT JOIN face f ON b.user_id = f.user_id"
    " WHERE b.user_id IS NOT NULL AND b.category_id IS NOT NULL",
    "dws_face_day": "SELECT * FROM face_day",
    "dws_goods_day": "SELECT * FROM goods_day",
    "dws_goods_reputation_day": "SELECT * FROM reputation_day",
    "agg_salted_face": "SELECT * FROM face_day",
    "agg_salted_goods": "SELECT * FROM goods_day",
    "agg_salted_reputation": "SELECT * FROM reputation_day",
    "empty_history": "SELECT * FROM face_full",
    "dws_face_full": "SELECT * FROM face_full",
    "dws_goods_full": "SELECT * FROM goods_full",
    "dws_goods_reputation_full": "SELECT * FROM reputation_full",
    "history_backfill": "SELECT * FROM snapshots",
    "date_prev_day": "SELECT DISTINCT strftime(ts, '%Y%m%d') AS dt,"
    " strftime(ts - INTERVAL 1 DAY, '%Y%m%d') AS prev_dt FROM events",
    "ads_goods_pop": "SELECT * FROM goods_pop",
    "ads_face_favorite": "SELECT * FROM face_favorite",
    "ads_goods_pv_to_buy": "SELECT * FROM goods_pv_to_buy",
    "ads_goods_score": "SELECT * FROM goods_score",
    "score_weighted": "SELECT dt, category_id, pv, cart, buy,"
    f" {_weighted('pv', 'cart', 'buy')} AS score FROM counters",
    "wilson_lower": "SELECT dt, category_id, buy, pv,"
    f" {_wilson('buy', 'pv')} AS bound FROM counters",
    "sentiment_label": f"SELECT doc_id, score, CASE WHEN score >= 1 THEN 1 ELSE 0 END AS label"
    f" FROM (SELECT doc_id, {_score('text', WORDS)} AS score FROM documents)",
    "sentiment_label_unsegmented": "SELECT doc_id, score,"
    " CASE WHEN score >= 1 THEN 1 ELSE 0 END AS label"
    f" FROM (SELECT doc_id, {_score('text', FRAGMENTS)} AS score FROM documents)",
    "daily_run": EXPORTED,
    "daily_rerun": EXPORTED,
    "backfill_continues": "SELECT * FROM snapshots",
    "history_restate": "SELECT * FROM snapshots",
    "layer_tables": _layer_rows(),
}


def oracle_statements() -> dict[str, str]:
    return {name: _statement(select) for name, select in SELECTS.items()}
