"""Web analytics shapes, on the events table: hits are events, counters are types, phrases are properties."""

from __future__ import annotations

from .registry import sql_query

V = "CAST(sum(CAST(value AS DECIMAL(18, 6))) AS DOUBLE)"

for _name, _sql in {
    "cb_q01_count": "SELECT count(*) AS n FROM events",
    "cb_q02_filter_count": "SELECT count(*) AS n FROM events WHERE user_id <> 0",
    "cb_q03_sum_count_avg": f"SELECT {V} AS total, count(*) AS n, {V} / count(*) AS mean FROM events",
    "cb_q04_avg": "SELECT CAST(sum(user_id) AS DOUBLE) / count(*) AS mean FROM events",
    "cb_q05_distinct": "SELECT count(DISTINCT user_id) AS n FROM events",
    "cb_q06_distinct_text": "SELECT count(DISTINCT props) AS n FROM events",
    "cb_q07_min_max": "SELECT CAST(min(ts) AS DATE) AS first_day, CAST(max(ts) AS DATE) AS last_day FROM events",
    "cb_q08_group_order": "SELECT event_type, count(*) AS n FROM events WHERE user_id <> 0 GROUP BY event_type ORDER BY count(*) DESC, event_type",
    "cb_q09_group_distinct": "SELECT event_type, count(DISTINCT user_id) AS u FROM events GROUP BY event_type ORDER BY u DESC, event_type LIMIT 10",
    "cb_q10_group_many": f"SELECT event_type, {V} AS total, count(*) AS n, {V} / count(*) AS mean, count(DISTINCT user_id) AS u FROM events GROUP BY event_type ORDER BY n DESC, event_type LIMIT 10",
    "cb_q11_distinct_top": "SELECT props, count(DISTINCT user_id) AS u FROM events WHERE props <> '' GROUP BY props ORDER BY u DESC, props LIMIT 10",
    "cb_q12_distinct_top_two": "SELECT event_type, props, count(DISTINCT user_id) AS u FROM events WHERE props <> '' GROUP BY event_type, props ORDER BY u DESC, event_type, props LIMIT 10",
    "cb_q14_distinct_phrase": "SELECT props, count(DISTINCT event_type) AS u FROM events WHERE props <> '' GROUP BY props ORDER BY u DESC, props LIMIT 10",
    "cb_q17_top_pairs": "SELECT user_id, props, count(*) AS n FROM events GROUP BY user_id, props ORDER BY n DESC, user_id, props LIMIT 10",
    "cb_q24_like_rows": "SELECT * FROM events WHERE props LIKE '%87%' ORDER BY ts, event_id LIMIT 10",
    "cb_q26_order_phrase": "SELECT props, event_id FROM events WHERE props <> '' ORDER BY props, event_id LIMIT 10",
    "cb_q32_group_fine_filter": f"SELECT event_id, event_type, count(*) AS c, {V} AS total FROM events WHERE props <> '' GROUP BY event_id, event_type ORDER BY c DESC, event_id, event_type LIMIT 10",
    "cb_q33_group_fine": f"SELECT event_id, user_id, count(*) AS c, {V} AS total FROM events GROUP BY event_id, user_id ORDER BY c DESC, event_id, user_id LIMIT 10",
    "cb_q34_group_long": "SELECT props, count(*) AS c FROM events GROUP BY props ORDER BY c DESC, props LIMIT 10",
    "cb_q38_dates_not_null": "SELECT event_type, count(*) AS views FROM events WHERE ts >= TIMESTAMP '2024-01-05' AND ts <= TIMESTAMP '2024-01-20' AND user_id <> 0 AND event_type <> '' GROUP BY event_type ORDER BY views DESC, event_type LIMIT 10",
    "cb_q41_in_list": "SELECT props, CAST(ts AS DATE) AS d, count(*) AS views FROM events WHERE ts >= TIMESTAMP '2024-01-05' AND ts <= TIMESTAMP '2024-01-20' AND event_type IN ('view', 'click') GROUP BY props, CAST(ts AS DATE) ORDER BY views DESC, props, d LIMIT 10 OFFSET 10",
    "cb_q42_two_sizes": "SELECT user_id, CAST(length(event_type) AS BIGINT) AS w, count(*) AS views FROM events WHERE ts >= TIMESTAMP '2024-01-05' AND ts <= TIMESTAMP '2024-01-20' GROUP BY user_id, length(event_type) ORDER BY views DESC, user_id, w LIMIT 10 OFFSET 10",
    "cb_q13_top_phrase": "SELECT props, count(*) AS c FROM events WHERE props <> '' GROUP BY props ORDER BY c DESC, props LIMIT 10",
    "cb_q15_two_keys": "SELECT event_type, props, count(*) AS c FROM events WHERE props <> '' GROUP BY event_type, props ORDER BY c DESC, event_type, props LIMIT 10",
    "cb_q16_top_users": "SELECT user_id, count(*) AS n FROM events GROUP BY user_id ORDER BY n DESC, user_id LIMIT 10",
    "cb_q18_no_order": "SELECT user_id, props, count(*) AS n FROM events GROUP BY user_id, props ORDER BY user_id, props LIMIT 10",
    "cb_q19_minute": "SELECT user_id, CAST(extract(minute FROM ts) AS BIGINT) AS m, props, count(*) AS n FROM events GROUP BY user_id, m, props ORDER BY n DESC, user_id, m, props LIMIT 10",
    "cb_q20_point": "SELECT user_id, event_id FROM events WHERE user_id = 42",
    "cb_q21_like": "SELECT count(*) AS n FROM events WHERE props LIKE '%87%'",
    "cb_q22_like_min": "SELECT event_type, min(props) AS p, count(*) AS c FROM events WHERE props LIKE '%8%' AND event_type <> '' GROUP BY event_type ORDER BY c DESC, event_type LIMIT 10",
    "cb_q23_not_like": "SELECT event_type, min(props) AS p, min(event_type) AS t, count(*) AS c, count(DISTINCT user_id) AS u FROM events WHERE props LIKE '%7%' AND props NOT LIKE '%.7%' GROUP BY event_type ORDER BY c DESC, event_type LIMIT 10",
    "cb_q25_order_time": "SELECT props, event_id FROM events WHERE props <> '' ORDER BY ts, event_id LIMIT 10",
    "cb_q27_order_two": "SELECT props, event_id FROM events WHERE props <> '' ORDER BY ts, props, event_id LIMIT 10",
    "cb_q28_having": "SELECT event_type, CAST(sum(length(props)) AS DOUBLE) / count(*) AS l, count(*) AS c FROM events WHERE props <> '' GROUP BY event_type HAVING count(*) > 100 ORDER BY l DESC, event_type LIMIT 25",
    "cb_q30_wide_sums": "SELECT " + ", ".join(f"CAST(sum(user_id + {k}) AS BIGINT) AS s{k}" for k in range(20)) + " FROM events",
    "cb_q31_group_avg": f"SELECT event_type, user_id, count(*) AS c, {V} AS total FROM events WHERE props <> '' GROUP BY event_type, user_id ORDER BY c DESC, event_type, user_id LIMIT 10",
    "cb_q35_literal_group": "SELECT 1 AS one, props, count(*) AS c FROM events GROUP BY 1, props ORDER BY c DESC, props LIMIT 10",
    "cb_q36_expressions": "SELECT user_id, user_id - 1 AS u1, user_id - 2 AS u2, user_id - 3 AS u3, count(*) AS c FROM events GROUP BY user_id, user_id - 1, user_id - 2, user_id - 3 ORDER BY c DESC, user_id LIMIT 10",
    "cb_q37_dates": "SELECT props, count(*) AS views FROM events WHERE event_type = 'view' AND ts >= TIMESTAMP '2024-01-05' AND ts <= TIMESTAMP '2024-01-20' AND props <> '' GROUP BY props ORDER BY views DESC, props LIMIT 10",
    "cb_q39_offset": "SELECT props, count(*) AS views FROM events WHERE ts >= TIMESTAMP '2024-01-05' AND ts <= TIMESTAMP '2024-01-20' GROUP BY props ORDER BY views DESC, props LIMIT 10 OFFSET 20",
    "cb_q40_case": "SELECT event_type, CASE WHEN user_id < 50 AND value > 0 THEN props ELSE '' END AS src, count(*) AS views FROM events GROUP BY event_type, CASE WHEN user_id < 50 AND value > 0 THEN props ELSE '' END ORDER BY views DESC, event_type, src LIMIT 10 OFFSET 5",
    "cb_q43_minutes": "SELECT date_trunc('hour', ts) AS h, count(*) AS views FROM events WHERE ts >= TIMESTAMP '2024-01-14' AND ts <= TIMESTAMP '2024-01-15' GROUP BY date_trunc('hour', ts) ORDER BY h LIMIT 10 OFFSET 5",
}.items():
    sql_query(_name, _sql)

_Q29 = r"""SELECT regexp_replace(props, '^\W+(\w+)\W.*$', '{0}') AS k, CAST(sum(length(props)) AS DOUBLE) / count(*) AS l, count(*) AS c, min(props) AS p
FROM events GROUP BY regexp_replace(props, '^\W+(\w+)\W.*$', '{0}') HAVING count(*) > 10"""
sql_query("cb_q29_regexp", _Q29.format(r"\1"), _Q29.replace("\\", "\\\\").format("$1"))
