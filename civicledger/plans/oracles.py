"""The registered queries as plain SQL for DuckDB."""

from .. import constants as K
from ..operators.context import ContextConfig
from .oracle_tables import _last, _letter, _official, _pick, congress, key_of, with_tables
from .tables import BENCHMARK, COMMITTEES, FIRST_EXPLANATION, FIRST_NAMES, HEADLINE, LAST_SIGNAL, LIMITATIONS, NOW, SUMMARY, TODAY

_D = f"DATE '{TODAY}'"
ORACLES = {}


def oracle(name, select, **extra):
    ORACLES[name] = with_tables(select, **{**PARTS, **extra})


def _ret(start, end):
    return f"CASE WHEN {start} > 0 THEN {end} / {start} - 1 END"


PARTS = {
    "series": "SELECT ticker, date, coalesce(adj_close, close) AS price FROM bars",
    "bench_series": "SELECT date, coalesce(adj_close, close) AS price FROM benchmark_bars",
    "latest": "SELECT ticker, max(date) AS latest_date, arg_max(price, date) AS latest_price FROM series GROUP BY ticker",
    "stated": """SELECT DISTINCT ticker, unnest([transaction_date, disclosure_date]) AS day FROM trades WHERE ticker IS NOT NULL""",
}


def _legs(horizon):
    if horizon is None:
        ends = "SELECT a.*, l.latest_date AS end_date, l.latest_price AS end_price, true AS elapsed FROM anchors a JOIN latest l USING (ticker)"
    else:
        ends = f"""SELECT a.ticker, a.day, a.anchor_date, a.price, max(s.date) AS end_date, arg_max(s.price, s.date) AS end_price,
            any_value(l.latest_date) >= a.anchor_date + {horizon} AS elapsed
          FROM anchors a JOIN latest l USING (ticker) JOIN series s ON s.ticker = a.ticker AND s.date BETWEEN a.anchor_date AND a.anchor_date + {horizon}
          GROUP BY a.ticker, a.day, a.anchor_date, a.price"""
    return {
        "anchors": """SELECT d.ticker, d.day, min(s.date) AS anchor_date, arg_min(s.price, s.date) AS price
          FROM stated d JOIN series s ON s.ticker = d.ticker AND s.date BETWEEN d.day AND d.day + 7 GROUP BY d.ticker, d.day""",
        "ends": ends,
        "bench_start": """SELECT d.day, min(s.date) AS b_date, arg_min(s.price, s.date) AS b_price
          FROM (SELECT DISTINCT day FROM stated) d JOIN bench_series s ON s.date BETWEEN d.day AND d.day + 7 GROUP BY d.day""",
        "bench_end": """SELECT d.end_date, max(s.date) AS be_date, arg_max(s.price, s.date) AS be_price
          FROM (SELECT DISTINCT end_date FROM ends) d JOIN bench_series s ON s.date <= d.end_date GROUP BY d.end_date""",
        "legs": f"""SELECT ticker, day, CASE WHEN elapsed THEN 'ok' ELSE 'horizon_not_elapsed' END AS status, anchor_date, price,
            CASE WHEN elapsed THEN {_ret('price', 'end_price')} END AS ret,
            CASE WHEN elapsed AND b_date <= be_date THEN {_ret('b_price', 'be_price')} END AS bret,
            CASE WHEN elapsed THEN {_ret('price', 'end_price')} END - CASE WHEN elapsed AND b_date <= be_date THEN {_ret('b_price', 'be_price')} END AS excess
          FROM ends LEFT JOIN bench_start USING (day) LEFT JOIN bench_end USING (end_date)""",
        "perf": f"""SELECT t.*, l.latest_date IS NOT NULL AS priced, l.latest_date, l.latest_price,
            CASE WHEN transaction_date > {_D} THEN 'transaction date is in the future'
                 WHEN transaction_date > disclosure_date THEN 'transaction date is after disclosure date' END AS problem,
            CASE WHEN t.ticker IS NULL THEN 'no_ticker' WHEN problem IS NOT NULL THEN 'invalid_date' WHEN NOT priced THEN 'no_prices'
                 ELSE coalesce(x.status, 'no_price_at_date') END AS status,
            t.ticker IS NOT NULL AND problem IS NULL AND priced AS measured,
            CASE WHEN measured THEN coalesce(x.status, 'no_price_at_date') END AS tx_status,
            CASE WHEN measured THEN x.anchor_date END AS tx_anchor_date, CASE WHEN measured THEN x.price END AS tx_price,
            CASE WHEN measured THEN x.ret END AS tx_return, CASE WHEN measured THEN x.bret END AS tx_benchmark_return,
            CASE WHEN measured THEN x.excess END AS tx_excess_return,
            measured AND disclosure_date <= {_D} AS d_ok,
            CASE WHEN measured THEN CASE WHEN disclosure_date IS NULL THEN 'no_date' WHEN disclosure_date > {_D} THEN 'invalid_date'
                 ELSE coalesce(y.status, 'no_price_at_date') END END AS di_status,
            CASE WHEN d_ok THEN y.anchor_date END AS di_anchor_date, CASE WHEN d_ok THEN y.price END AS di_price,
            CASE WHEN d_ok THEN y.ret END AS di_return, CASE WHEN d_ok THEN y.bret END AS di_benchmark_return,
            CASE WHEN d_ok THEN y.excess END AS di_excess_return,
            CASE WHEN measured THEN CASE WHEN transaction_type = 'buy' THEN 1 WHEN transaction_type IN ('sell', 'sell_partial') THEN -1 END END AS direction
          FROM trades t LEFT JOIN latest l ON l.ticker = t.ticker
            LEFT JOIN legs x ON x.ticker = t.ticker AND x.day = t.transaction_date
            LEFT JOIN legs y ON y.ticker = t.ticker AND y.day = t.disclosure_date""",
    }


PERF = _legs(None)
PERF90 = _legs(90)

oracle("flagship_performance_by_security", """
  SELECT ticker, count(*) AS trades, count(*) FILTER (status = 'ok') AS priced_trades, count(*) FILTER (transaction_type = 'buy') AS buys,
    round(avg(tx_return) FILTER (status = 'ok'), 6) AS avg_return, round(avg(tx_excess_return) FILTER (status = 'ok'), 6) AS avg_excess_return
  FROM perf WHERE ticker IS NOT NULL GROUP BY ticker""", **PERF)
oracle("performance_status_histogram", """
  SELECT 'trade' AS leg, status, count(*) AS trades FROM perf GROUP BY status
  UNION ALL SELECT 'disclosure', di_status, count(*) FROM perf WHERE di_status IS NOT NULL GROUP BY di_status""", **PERF)
oracle("trade_performance", """
  SELECT id, status, CASE WHEN status = 'invalid_date' THEN problem END AS detail,
    CASE WHEN measured THEN latest_date END AS latest_date, CASE WHEN measured THEN latest_price END AS latest_price, direction,
    tx_status, tx_anchor_date, tx_price, tx_return, tx_benchmark_return, tx_excess_return,
    di_status, di_anchor_date, di_price, di_return, di_benchmark_return, di_excess_return,
    direction * di_excess_return AS adjusted_disclosure_excess
  FROM perf""", **PERF)
oracle("fixed_horizon_excess", """
  SELECT id, status, tx_anchor_date AS anchor_date, tx_return AS security_return, tx_benchmark_return AS benchmark_return,
    tx_excess_return AS excess_return FROM perf""", **PERF90)

oracle("security_performance", """
  SELECT id, ticker, status, tx_return AS return, tx_excess_return AS excess_return FROM perf WHERE ticker IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY ticker ORDER BY transaction_date DESC, id DESC) <= 200""", **PERF)
oracle("asof_next_bar", """
  SELECT t.id, min(s.date) AS asof_date, arg_min(s.price, s.date) AS asof_price
  FROM trades t LEFT JOIN series s ON s.ticker = t.ticker AND s.date BETWEEN t.disclosure_date AND t.disclosure_date + 7
  WHERE t.ticker IS NOT NULL AND t.disclosure_date IS NOT NULL GROUP BY t.id""")
oracle("asof_previous_bar", """
  SELECT t.id, s.date AS asof_date, s.price AS asof_price
  FROM (SELECT * FROM trades WHERE ticker IS NOT NULL) t ASOF LEFT JOIN series s ON s.ticker = t.ticker AND s.date <= t.transaction_date""")
oracle("rebased_series", """
  SELECT ticker, date, price_index, bench / (SELECT price FROM shown_bench b WHERE b.date >= p.first_date ORDER BY b.date LIMIT 1) * 100 AS benchmark_index,
    CASE WHEN bought THEN price_index END AS buy_mark, CASE WHEN sold THEN price_index END AS sell_mark
  FROM (SELECT s.ticker, s.date, s.adj_close / first_value(s.adj_close) OVER w * 100 AS price_index, min(s.date) OVER (PARTITION BY s.ticker) AS first_date,
          b.price AS bench, m.bought, m.sold
        FROM shown s LEFT JOIN shown_bench b ON b.date = s.date LEFT JOIN marks m ON m.ticker = s.ticker AND m.date = s.date
        WINDOW w AS (PARTITION BY s.ticker ORDER BY s.date)) p""", **PERF,
    shown="SELECT ticker, date, adj_close FROM bars WHERE adj_close IS NOT NULL AND date >= DATE '1996-01-01'",
    shown_bench="SELECT date, adj_close AS price FROM benchmark_bars WHERE adj_close IS NOT NULL",
    marks="""SELECT ticker, tx_anchor_date AS date, bool_or(direction > 0) AS bought, bool_or(direction < 0) AS sold FROM perf
      WHERE tx_anchor_date IS NOT NULL AND direction IS NOT NULL GROUP BY ALL""")

DIGEST = {
    "digest": """SELECT id, transaction_date, replace(ticker, 'Brand#', 'B') AS ticker,
        CASE WHEN amount_max = 15000 THEN 8000 WHEN amount_max = 50000 THEN 32500 WHEN amount_max = 100000 THEN 75000
             WHEN amount_max IS NULL THEN 1500000 ELSE 0 END AS estimated_value,
        CASE WHEN transaction_type = 'buy' THEN 'BUY' WHEN transaction_type LIKE 'sell%' THEN 'SELL' END AS side FROM trades""",
    "notable": f"""SELECT * FROM digest WHERE transaction_date >= {_D} - 30 AND ticker IS NOT NULL AND length(ticker) <= 5 AND side IS NOT NULL
        AND estimated_value >= 15000""",
    "dbars": "SELECT replace(ticker, 'Brand#', 'B') AS ticker, date, close AS price FROM bars",
    "moves": """SELECT d.*, p.price_at_trade, c.current_price, CASE WHEN price_at_trade > 0 AND current_price > 0
          THEN round((current_price - price_at_trade) / price_at_trade * 100, 6) END AS price_move_pct,
          abs((current_price - price_at_trade) / price_at_trade * 100) AS size
        FROM digest d LEFT JOIN (SELECT ticker, arg_max(price, date) AS current_price FROM dbars GROUP BY ticker) c USING (ticker)
        LEFT JOIN (SELECT q.id, arg_min(b.price, b.date) AS price_at_trade FROM digest q JOIN dbars b ON b.ticker = q.ticker
            AND b.date BETWEEN q.transaction_date + (CASE isodow(q.transaction_date) WHEN 6 THEN 2 WHEN 7 THEN 1 ELSE 0 END)
                AND q.transaction_date + (CASE isodow(q.transaction_date) WHEN 6 THEN 2 WHEN 7 THEN 1 ELSE 0 END) + 4 GROUP BY q.id) p USING (id)""",
}
oracle("legacy_notable_filter", "SELECT id, ticker, estimated_value, side FROM notable", **DIGEST)
oracle("legacy_moves", "SELECT id, price_at_trade, current_price, price_move_pct FROM moves", **DIGEST)
oracle("notable_moves", """SELECT id, ticker, price_move_pct, size >= 5 AS notable FROM moves WHERE id IN (SELECT id FROM notable) AND price_move_pct IS NOT NULL
  ORDER BY size DESC, id LIMIT 10""", **DIGEST)

FEED = {
    "named": """SELECT *, list_filter(string_split_regex(trim(replace(member, ',', ' ')), '\\s+'), lambda w: w <> '' AND
          rtrim(lower(w), '.') NOT IN ('mr', 'mrs', 'ms', 'dr', 'hon', 'honorable', 'sen', 'rep', 'senator')) AS w FROM feed""",
    "cleaned": """SELECT seq, array_to_string(CASE WHEN len(w) >= 3 AND rtrim(lower(w[1]), '.') = rtrim(lower(w[2]), '.') THEN w[2:] ELSE w END, ' ') AS politician_name,
        CASE WHEN lower(trim(chamber)) IN ('house', 'senate') THEN lower(trim(chamber)) END AS chamber,
        CASE WHEN regexp_full_match(upper(trim(ticker)), '[A-Z0-9][A-Z0-9.\\-]{0,15}') THEN upper(trim(ticker)) END AS ticker,
        nullif(trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(trim(asset), '\\s+[PSE]\\s+\\d{2}/\\d{2}/\\d{4}.*$', ''),
          '\\s*\\[[A-Z]{1,3}\\]', '', 'g'), '\\s*\\([A-Z0-9.\\-]{1,10}\\)', '', 'g'), '\\s+', ' ', 'g'), ' -'), '') AS asset_name,
        CASE trade_type WHEN 'Purchase' THEN 'buy' WHEN 'Sale (Partial)' THEN 'sell_partial' WHEN 'S' THEN 'sell' WHEN 'Exchange' THEN 'exchange' ELSE 'unknown' END AS transaction_type,
        CASE WHEN regexp_full_match(tx_date[:10], '\\d{4}-\\d{2}-\\d{2}') THEN tx_date[:10]::date END AS transaction_date,
        CASE WHEN regexp_full_match(disclosed, '\\d{4}-\\d{2}-\\d{2}') THEN disclosed::date END AS disclosure_date,
        list_transform(regexp_extract_all(amount, '\\d[\\d,]*'), lambda x: replace(x, ',', '')::bigint) AS n, amount LIKE 'Over%' AS open_ended,
        nullif(link, '') AS source_url
      FROM named""",
    "usable": """SELECT seq, politician_name, chamber, ticker, asset_name, transaction_type, transaction_date, disclosure_date,
        CASE WHEN open_ended THEN n[1] ELSE list_min(n[1:2]) END AS amount_min, CASE WHEN NOT open_ended THEN list_max(n[1:2]) END AS amount_max, source_url
      FROM cleaned WHERE chamber IS NOT NULL AND politician_name <> '' AND transaction_date IS NOT NULL""",
    "identified": f"""SELECT *, {key_of('politician_name', 'chamber')} AS canonical_key, concat_ws('|', {key_of('politician_name', 'chamber')}, coalesce(ticker, ''),
        CASE WHEN ticker IS NULL THEN lower(coalesce(asset_name, '')) ELSE '' END, transaction_type, transaction_date::varchar,
        coalesce(disclosure_date::varchar, ''), coalesce(amount_min::varchar, 'None'), coalesce(amount_max::varchar, 'None')) AS identity FROM usable""",
    "numbered": "SELECT *, row_number() OVER (PARTITION BY identity ORDER BY seq) - 1 AS occurrence, sha256(identity || '|' || (row_number() OVER (PARTITION BY identity ORDER BY seq) - 1)) AS fingerprint FROM identified",
}
oracle("normalize_disclosures_feed", "SELECT * FROM usable", **FEED)
oracle("rejected_disclosures", """SELECT CASE WHEN chamber IS NULL THEN 'no chamber' WHEN politician_name = '' THEN 'no name' ELSE 'no transaction date' END AS reject_reason,
  count(*) AS records FROM cleaned WHERE chamber IS NULL OR politician_name = '' OR transaction_date IS NULL GROUP BY 1""", **FEED)
oracle("legacy_value_and_display", """
  SELECT seq, 0 AS legacy_value, CASE WHEN lo IS NULL AND hi IS NULL THEN '—' WHEN hi IS NULL THEN 'Over ' || short(lo) WHEN lo = hi THEN short(hi)
    ELSE short(lo) || ' – ' || short(hi) END AS shown
  FROM (SELECT seq, CASE WHEN open_ended THEN n[1] ELSE list_min(n[1:2]) END AS lo, CASE WHEN NOT open_ended THEN list_max(n[1:2]) END AS hi FROM cleaned)""", **FEED)
_SHORT = "(CASE WHEN {0} < 1000 THEN '$' || {0} WHEN round({0} / 1e3, 1) < 1000 THEN '$' || regexp_replace(round({0} / 1e3, 1)::varchar, '\\.0$', '') || 'K' ELSE '$' || regexp_replace(round({0} / 1e6, 1)::varchar, '\\.0$', '') || 'M' END)"
for _v in ("lo", "hi"):
    ORACLES["legacy_value_and_display"] = ORACLES["legacy_value_and_display"].replace(f"short({_v})", _SHORT.format(_v))
oracle("dedupe_occurrences", "SELECT fingerprint, occurrence FROM numbered", **FEED)
oracle("dedupe_against_stored", """SELECT transaction_date, transaction_type, count(*) AS new_trades FROM numbered
  WHERE fingerprint NOT IN (SELECT fingerprint FROM numbered WHERE transaction_date <= DATE '2024-01-15') GROUP BY ALL""", **FEED)
oracle("upsert_politicians", """SELECT canonical_key, coalesce(arg_min(politician_name, seq) FILTER (transaction_date <= DATE '2024-01-15'), arg_min(politician_name, seq)) AS name,
  any_value(chamber) AS chamber, CASE WHEN count(*) FILTER (transaction_date <= DATE '2024-01-15') > 0 THEN 'D' END AS party, NULL::varchar AS state
  FROM identified GROUP BY canonical_key""", **FEED)
oracle("upsert_securities", "SELECT ticker, arg_min(asset_name, seq) FILTER (asset_name IS NOT NULL) AS name FROM usable WHERE ticker IS NOT NULL GROUP BY ticker", **FEED)
oracle("merge_variants", f"""
  SELECT survivor AS id, any_value(new_name) AS name, any_value(key) AS canonical_key, count(*) AS trades, min(fp) AS first_fingerprint, max(fp) AS last_fingerprint
  FROM (SELECT survivor, new_name, key, sha256(identity || '|' || (row_number() OVER (PARTITION BY identity ORDER BY id) - 1)) AS fp
        FROM (SELECT t.id, v.survivor, v.new_name, v.key, concat_ws('|', v.key, coalesce(t.ticker, ''), CASE WHEN t.ticker IS NULL THEN lower(coalesce(t.asset_name, '')) ELSE '' END,
                t.transaction_type, t.transaction_date::varchar, coalesce(t.disclosure_date::varchar, ''), coalesce(t.amount_min::varchar, 'None'), coalesce(t.amount_max::varchar, 'None')) AS identity
              FROM trades t JOIN variants v ON v.id = t.politician_id))
  GROUP BY survivor""",
    variants=f"""SELECT p.id, {key_of('p.name', 'p.chamber')} AS key, first_value(p.id) OVER w AS survivor, first_value(p.name) OVER w AS new_name
      FROM politicians p LEFT JOIN (SELECT politician_id, count(*) AS n FROM trades GROUP BY 1) c ON c.politician_id = p.id
      WINDOW w AS (PARTITION BY {key_of('p.name', 'p.chamber')} ORDER BY coalesce(n, 0) DESC, p.id)""")


def _fingerprint(name, cols):
    text = "to_json({" + ", ".join(f"'c{i}': {c}::varchar" for i, c in enumerate(sorted(cols))) + "})"
    return f"""SELECT '{name}' AS table_name, count(*) AS rows, sum(('0x' || substr(h, 1, 13))::bigint::hugeint)::varchar AS hash_a,
      sum(('0x' || substr(h, 14, 13))::bigint::hugeint)::varchar AS hash_b FROM (SELECT md5({text}) AS h FROM {name})"""


oracle("table_fingerprint", _fingerprint("orders", ["o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority"]) + " UNION ALL "
       + _fingerprint("events", ["event_id", "user_id", "event_type", "props"]))

_BUY, _SELL = "transaction_type = 'buy'", "transaction_type IN ('sell', 'sell_partial')"


def _totals(days):
    w = f"disclosure_date >= {_D} - {days}"
    return f"""SELECT count(*) AS trades, count(*) FILTER ({w}) AS trades_in_window, count(*) FILTER ({w} AND {_BUY}) AS buys_in_window,
      count(*) FILTER ({w} AND {_SELL}) AS sells_in_window, max(disclosure_date) AS latest_disclosure_date,
      (SELECT count(*) FROM politicians) AS politicians, (SELECT count(*) FROM securities) AS securities FROM trades"""


DASH = {
    "daily": f"""SELECT d.date, count(t.id) AS count FROM (SELECT unnest(generate_series({_D} - 365, {_D}, INTERVAL 1 DAY))::date AS date) d
      LEFT JOIN trades t ON t.disclosure_date = d.date GROUP BY d.date""",
    "monthly": f"""SELECT strftime(disclosure_date, '%Y-%m') AS month, count(*) FILTER ({_BUY}) AS buys, count(*) FILTER ({_SELL}) AS sells,
      count(*) FILTER (NOT ({_BUY}) AND NOT ({_SELL})) AS other FROM trades WHERE disclosure_date IS NOT NULL GROUP BY 1""",
    "totals365": _totals(365),
}
oracle("overview_totals", _totals(30))
oracle("overview_daily", "SELECT * FROM daily", **DASH)
oracle("overview_monthly", "SELECT * FROM monthly", **DASH)
oracle("half_window_trend", """
  SELECT recent, earlier, last_12_months, floor(buys_in_window * 100.0::double / trades_in_window + 0.5)::bigint AS buy_share_pct,
    CASE WHEN earlier > 0 THEN floor((recent - earlier)::double / earlier * 100 + 0.5)::bigint END AS change_pct
  FROM (SELECT sum(count) FILTER (i >= n // 2)::bigint AS recent, sum(count) FILTER (i < n // 2)::bigint AS earlier
        FROM (SELECT count, row_number() OVER (ORDER BY date) - 1 AS i, count(*) OVER () AS n FROM daily)),
       (SELECT sum(buys + sells + other)::bigint AS last_12_months FROM (SELECT * FROM monthly ORDER BY month DESC LIMIT 12)), totals365""", **DASH)
for _name, _key, _dim, _cols in (("top_tickers", "ticker", "securities", "name"), ("top_politicians", "politician_id", "(SELECT id AS politician_id, name, chamber FROM politicians)", "name, chamber")):
    _dims = ", ".join(f"any_value(d.{c.strip()}) AS {c.strip()}" for c in _cols.split(","))
    oracle(_name, f"""SELECT {_key}, count(*) AS trades, count(*) FILTER ({_BUY}) AS buys, count(*) FILTER ({_SELL}) AS sells, {_dims}
      FROM trades JOIN {_dim} d USING ({_key}) WHERE disclosure_date >= {_D} - 365 GROUP BY {_key} ORDER BY trades DESC, {_key} LIMIT 10""")
oracle("politician_summary", """SELECT p.id AS politician_id, p.name, count(t.id) AS trade_count, max(t.transaction_date) AS latest_trade_date
  FROM politicians p LEFT JOIN trades t ON t.politician_id = p.id GROUP BY p.id, p.name""")
oracle("security_summary", """SELECT s.ticker, s.price_status, count(t.id) AS trade_count, max(t.transaction_date) AS latest_trade_date
  FROM securities s LEFT JOIN trades t ON t.ticker = s.ticker GROUP BY s.ticker, s.price_status""")
oracle("status_report", f"""
  SELECT count(*) AS trades_total, max(disclosure_date) AS latest_disclosure_date, max(transaction_date) FILTER (transaction_date <= {_D}) AS latest_transaction_date,
    count(*) FILTER (transaction_date > {_D} OR transaction_date > disclosure_date) AS invalid_date_trades,
    (SELECT count(*) FROM politicians) AS politicians_total, (SELECT count(*) FROM traded) AS securities_total,
    (SELECT count(*) FROM traded WHERE price_status = 'ok') AS securities_priced, (SELECT count(*) FROM traded WHERE price_status = 'unavailable') AS securities_unavailable,
    (SELECT count(*) FROM traded WHERE price_status IS NULL) AS securities_pending, (SELECT count(*) FROM bars) AS price_bars, (SELECT max(date) FROM bars) AS latest_bar_date,
    (SELECT price_from FROM securities WHERE ticker = 'Brand#3') AS benchmark_from, (SELECT price_to FROM securities WHERE ticker = 'Brand#3') AS benchmark_to,
    (SELECT price_status FROM securities WHERE ticker = 'Brand#3') AS benchmark_status
  FROM trades""", traded="SELECT * FROM securities WHERE ticker IN (SELECT ticker FROM trades)")
oracle("trades_by_source", "SELECT source, count(*) AS trades FROM trades GROUP BY source")
oracle("ingest_freshness", """SELECT max(ts) AS last_success_at, round((epoch(TIMESTAMP '2024-01-31 12:00:00') - floor(epoch(max(ts)))) / 3600, 2) AS age_hours,
  (epoch(TIMESTAMP '2024-01-31 12:00:00') - floor(epoch(max(ts)))) / 3600 > 12 AS stale FROM events""")
oracle("group_sizes", """SELECT id, politician_id || '|' || coalesce(ticker, '') || '|' || transaction_date || '|' || transaction_type AS group_key,
  count(*) OVER (PARTITION BY politician_id, coalesce(ticker, ''), transaction_date, transaction_type) AS group_size FROM trades""")
_NEWEST = {"newest": "SELECT * FROM trades"}
oracle("politician_breakdown_months", f"""SELECT politician_id, strftime(transaction_date, '%Y-%m') AS month, count(*) FILTER ({_BUY}) AS buys,
  count(*) FILTER ({_SELL}) AS sells FROM newest GROUP BY ALL""", **_NEWEST)
oracle("politician_breakdown_tickers", f"""SELECT politician_id, coalesce(ticker, '—') AS ticker, count(*) FILTER ({_BUY}) AS buys, count(*) FILTER ({_SELL}) AS sells
  FROM newest GROUP BY 1, 2 QUALIFY row_number() OVER (PARTITION BY politician_id ORDER BY buys + sells DESC, coalesce(ticker, '—')) <= 10""", **_NEWEST)
oracle("newest_per_security", """SELECT ticker, id, disclosure_date FROM trades WHERE ticker IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY ticker ORDER BY disclosure_date DESC NULLS LAST, id DESC) <= 10""")
oracle("price_slice", "SELECT ticker, date, close, adj_close FROM bars WHERE date BETWEEN DATE '1997-01-01' AND DATE '1999-12-31'")
oracle("range_window", """SELECT ticker, date, close FROM bars JOIN (SELECT ticker, max(date) AS last FROM bars GROUP BY ticker) USING (ticker)
  WHERE date >= date_trunc('month', last - INTERVAL 6 MONTH)::date + (day(last) - 1)::int""")
oracle("committee_groups", """SELECT politician_id, committee_code, max(role) FILTER (subcommittee_code IS NULL) AS role,
  count(DISTINCT (subcommittee_code, role)) FILTER (subcommittee_code IS NOT NULL) AS subcommittees FROM seats GROUP BY ALL""")
oracle("ordered_seats", """SELECT politician_id, upper(committee_code[1]) || lower(committee_code[2:]) AS committee_name,
  upper(subcommittee_code[1]) || lower(subcommittee_code[2:]) AS subcommittee_name, temporal_precision,
  row_number() OVER (PARTITION BY politician_id ORDER BY committee_name, subcommittee_name IS NOT NULL, coalesce(subcommittee_name, ''), temporal_precision)::int AS position FROM seats""")
oracle("traded_tickers", "SELECT DISTINCT ticker FROM trades WHERE ticker IS NOT NULL")

SIZES = {
    "sized": f"""SELECT *, NOT coalesce(transaction_date > {_D} OR transaction_date > disclosure_date, false) AS date_ok,
        CASE WHEN amount_max IS NULL THEN amount_min::double WHEN amount_max >= amount_min THEN (amount_min + amount_max) / 2.0::double END AS value,
        CASE WHEN amount_min IS NULL THEN NULL WHEN amount_max IS NULL THEN 'open_ended_lower_bound' WHEN amount_max = amount_min THEN 'exact_figure'
             WHEN amount_max > amount_min THEN 'range_midpoint' END AS basis FROM trades""",
    "history": """SELECT t.id, count(h.id) AS n, count(h.id) FILTER (h.value < t.value) AS less, count(h.id) FILTER (h.value = t.value) AS same,
        quantile_cont(h.value, 0.5) AS med
      FROM sized t LEFT JOIN sized h ON h.politician_id = t.politician_id AND h.transaction_date < t.transaction_date AND h.date_ok AND h.value IS NOT NULL
      WHERE t.date_ok GROUP BY t.id""",
    "size_signals": """SELECT t.*, CASE WHEN t.value IS NOT NULL AND h.n >= 10 THEN (less + 0.5::double * same) / n * 100 END AS pct, h.n, h.med
      FROM sized t LEFT JOIN history h USING (id)""",
}
# round half to even on the exact double: the product with 100 is split into high and low part (134217729 = 2^27 + 1)
_EXACT = """(floor(pct * 100) + CASE WHEN (pct * 100 - floor(pct * 100) - 0.5) + low > 0
    OR ((pct * 100 - floor(pct * 100) - 0.5) + low = 0 AND floor(pct * 100) % 2 <> 0) THEN 1.0::double ELSE 0.0::double END) / 100.0::double"""
SIZES["rounded"] = f"""SELECT *, {_EXACT} AS pct2 FROM (
    SELECT *, (hi * 100.0::double - pct * 100.0::double) + (pct - hi) * 100.0::double AS low
    FROM (SELECT *, pct * 134217729.0::double - (pct * 134217729.0::double - pct) AS hi FROM size_signals))"""
oracle("trade_size_values", "SELECT basis, count(*) AS trades, sum(value) AS total FROM sized GROUP BY basis", **SIZES)
oracle("size_percentile_prior", """SELECT id, pct >= 90 AS trade_size_anomaly, value AS trade_size_value, basis AS trade_size_basis, pct2 AS trade_size_percentile,
  n AS trade_size_sample_size FROM rounded""", **SIZES)
oracle("prior_median", "SELECT id, n AS trade_size_sample_size, CASE WHEN date_ok AND value IS NOT NULL THEN med END AS trade_size_median FROM size_signals", **SIZES)
DELAY = {"delays": f"""SELECT id, CASE WHEN transaction_date <= {_D} AND disclosure_date >= transaction_date AND disclosure_date <= {_D}
    THEN disclosure_date - transaction_date END AS days FROM trades"""}
oracle("delay_signal", "SELECT id, days AS disclosure_delay_days, days > 45 AS disclosure_delay_signal FROM delays", **DELAY)
EXCESS = {**PERF90, "excesses": """SELECT id, status AS performance_status, tx_return, tx_benchmark_return, tx_excess_return, tx_anchor_date,
    direction * tx_excess_return AS adjusted, CASE WHEN tx_excess_return IS NOT NULL THEN tx_anchor_date + 90 END AS through_date,
    CASE WHEN status = 'ok' THEN abs(tx_excess_return) + 1e-9 >= 0.20::double END AS signal FROM perf"""}
oracle("excess_signal", """SELECT id, performance_status, tx_excess_return AS excess_return, adjusted AS excess_return_direction_adjusted,
  through_date AS performance_through_date, signal AS excess_return_signal FROM excesses""", **EXCESS)
oracle("invalid_dates", f"""SELECT id, CASE WHEN transaction_date > {_D} THEN 'transaction date is in the future' ELSE 'transaction date is after disclosure date' END AS problem
  FROM trades WHERE transaction_date > {_D} OR transaction_date > disclosure_date""")


def _starts(d):
    return f"""SELECT ticker, min(least(transaction_date, CASE WHEN disclosure_date <= {d} THEN disclosure_date END, {d}))
        FILTER (NOT coalesce(transaction_date > {d} OR transaction_date > disclosure_date, false)) AS start
      FROM trades WHERE ticker IS NOT NULL GROUP BY ticker"""


PRICES = {
    "per_ticker": _starts(_D),
    "starts": f"SELECT * FROM per_ticker WHERE start IS NOT NULL UNION ALL SELECT '{BENCHMARK}', min(start) FROM per_ticker",
    "plan": f"""SELECT *, CASE WHEN action = 'fetch' THEN CASE WHEN price_from IS NULL OR price_to IS NULL OR start < price_from THEN start ELSE price_to - 7 END END AS lo,
        CASE WHEN action = 'fetch' THEN CASE WHEN price_from IS NULL OR price_to IS NULL OR price_to < {_D} THEN {_D} ELSE price_from END END AS hi
      FROM (SELECT t.ticker, t.start, s.price_from, s.price_to, s.price_from IS NOT NULL AS had_coverage,
          CASE WHEN s.price_status = 'unavailable' AND s.price_checked_at > TIMESTAMP '{NOW}' - INTERVAL 7 DAY THEN 'deferred'
               WHEN s.price_from IS NULL OR s.price_to IS NULL OR t.start < s.price_from OR s.price_to < {_D} THEN 'fetch' ELSE 'cached' END AS action
        FROM starts t LEFT JOIN securities s USING (ticker))""",
    "batches": """SELECT *, min(lo) OVER b AS batch_lo, max(hi) OVER b AS batch_hi, count(*) OVER b AS batch_size
      FROM (SELECT *, (row_number() OVER (ORDER BY lo, hi, ticker) - 1) // 4 AS batch FROM plan WHERE action = 'fetch') WINDOW b AS (PARTITION BY batch)""",
    "old_bars": "SELECT b.* FROM bars b JOIN securities s USING (ticker) WHERE b.date BETWEEN s.price_from AND s.price_to",
    "new_bars": """SELECT * REPLACE (CASE WHEN substr(ticker, 7)::int % 3 = 0 THEN adj_close * 0.99::double ELSE adj_close END AS adj_close)
      FROM bars WHERE substr(ticker, 7)::int % 7 <> 0""",
    "wanted": "SELECT n.* FROM new_bars n JOIN batches p USING (ticker) WHERE n.date BETWEEN p.lo AND p.hi",
    "outcomes": """SELECT p.ticker, p.lo, p.hi, p.had_coverage, coalesce(f.bars_fetched, 0) AS bars_fetched,
        CASE WHEN sum(coalesce(a.n, 0)) OVER (PARTITION BY p.batch) = 0 AND p.batch_size >= 3 THEN 'failed'
             WHEN f.bars_fetched IS NULL AND NOT p.had_coverage THEN CASE WHEN p.hi - p.lo >= 7 THEN 'unavailable' ELSE 'too_recent' END
             WHEN p.had_coverage AND coalesce(d.moved, false) THEN 'restated' ELSE 'written' END AS outcome
      FROM batches p LEFT JOIN (SELECT ticker, count(*) AS n FROM new_bars GROUP BY 1) a USING (ticker)
      LEFT JOIN (SELECT ticker, count(*) AS bars_fetched FROM wanted GROUP BY 1) f USING (ticker)
      LEFT JOIN (SELECT w.ticker, bool_or(abs(w.adj_close / o.adj_close - 1) > 1e-4) AS moved FROM wanted w JOIN old_bars o USING (ticker, date) GROUP BY 1) d USING (ticker)""",
}
oracle("price_starts", "SELECT * FROM starts", **PRICES)
oracle("price_invalid_trades", f"""SELECT id, ticker, CASE WHEN transaction_date > {_D} THEN 'transaction date is in the future' ELSE 'transaction date is after disclosure date' END AS problem
  FROM trades WHERE ticker IS NOT NULL AND (transaction_date > {_D} OR transaction_date > disclosure_date)""")
oracle("price_no_valid_dates", "SELECT ticker FROM early WHERE start IS NULL", early=_starts("DATE '1995-01-02'"))
oracle("price_fetch_plan", "SELECT ticker, action, lo, hi, start, had_coverage FROM plan", **PRICES)
oracle("price_batches", "SELECT ticker, lo, hi, batch, batch_lo, batch_hi, batch_size FROM batches", **PRICES)
oracle("restatement_check", """SELECT ticker, coalesce(bool_or(abs(n.adj_close / o.adj_close - 1) > 1e-4), false) AS restated, count(*) AS overlapping_bars
  FROM new_bars n JOIN old_bars o USING (ticker, date) GROUP BY ticker""", **PRICES)
oracle("price_batch_outcome", "SELECT ticker, outcome, bars_fetched, lo, hi FROM outcomes", **PRICES)
oracle("price_range_replace", """SELECT ticker, count(*) AS bars, min(date) AS first_date, max(date) AS last_date, sum(trunc(close * 100)::bigint)::bigint AS cents FROM (
    SELECT ticker, date, close FROM old_bars o WHERE NOT EXISTS (SELECT 1 FROM outcomes w WHERE w.ticker = o.ticker AND outcome = 'written' AND o.date BETWEEN lo AND hi)
    UNION ALL SELECT ticker, date, close FROM wanted WHERE ticker IN (SELECT ticker FROM outcomes WHERE outcome = 'written')) GROUP BY ticker""", **PRICES)
oracle("price_coverage", f"""SELECT s.ticker, CASE outcome WHEN 'written' THEN 'ok' WHEN 'unavailable' THEN 'unavailable' ELSE price_status END AS price_status,
    CASE WHEN outcome = 'written' THEN CASE WHEN had_coverage THEN least(price_from, lo) ELSE lo END ELSE price_from END AS price_from,
    CASE WHEN outcome = 'written' THEN CASE WHEN had_coverage THEN greatest(price_to, hi) ELSE hi END ELSE price_to END AS price_to,
    CASE WHEN outcome IN ('written', 'unavailable') THEN TIMESTAMP '{NOW}' ELSE price_checked_at END AS price_checked_at
  FROM securities s LEFT JOIN outcomes USING (ticker)""", **PRICES)

# the same fetch a week later: some tickers trade for three days, nothing comes for every second batch of three
LISTED = {
    **PRICES,
    "starts": f"SELECT ticker, CASE WHEN try_cast(substr(ticker, 7) AS int) % 10 = 1 THEN {_D} - 3 ELSE start END AS start FROM ({PRICES['starts']})",
    "plan": PRICES["plan"].replace("s.price_status = 'unavailable' AND", "false AND"),
    "batches": PRICES["batches"].replace("// 4", "// 3"),
    "new_bars": PRICES["new_bars"] + " AND ticker NOT IN (SELECT ticker FROM batches WHERE batch % 2 = 1)",
}
oracle("price_table_outcome", "SELECT ticker, outcome, bars_fetched, lo, hi FROM outcomes", **LISTED)
oracle("price_table_content", """SELECT ticker, strftime(date, '%Y-%m') AS month, count(*) AS bars, sum(round(close * 100)::bigint)::bigint AS cents, sum(round(adj_close * 10000)::bigint)::bigint AS adjusted FROM (
    SELECT ticker, date, close, adj_close FROM old_bars o WHERE NOT EXISTS (SELECT 1 FROM outcomes w WHERE w.ticker = o.ticker AND outcome = 'written' AND o.date BETWEEN lo AND hi)
    UNION ALL SELECT ticker, date, close, adj_close FROM wanted WHERE ticker IN (SELECT ticker FROM outcomes WHERE outcome = 'written')) GROUP BY ALL""", **LISTED)

# --- relevance -------------------------------------------------------------------------------------------------------
_RANK = "(subcommittee_code IS NULL)::int, (relevance_level <> 'direct')::int, sic_end - sic_start, mapping_id"
RELEVANCE = {
    "cm": "SELECT *, 'x' AS k FROM current_mappings",
    "subjects": """SELECT politician_id, sic_code, industry, count(*) AS trades FROM trades t LEFT JOIN securities s USING (ticker) GROUP BY ALL""",
    "matches": f"""SELECT DISTINCT s.politician_id, s.sic_code, s.industry, s.trades, m.mapping_id, m.committee_code, m.subcommittee_code, m.relevance_level,
        m.review_status, m.sic_start, m.sic_end
      FROM subjects s JOIN seats USING (politician_id) JOIN cm m ON m.committee_code = seats.committee_code
        AND (m.subcommittee_code IS NULL OR m.subcommittee_code = seats.subcommittee_code)
        AND m.relevance_level <> 'none' AND s.sic_code::int BETWEEN m.sic_start AND m.sic_end
        AND (m.industry_pattern IS NULL OR regexp_matches(s.industry, '(?i)' || m.industry_pattern))""",
    "ranked": f"SELECT *, row_number() OVER (PARTITION BY politician_id, sic_code ORDER BY {_RANK}) AS place, count(*) OVER (PARTITION BY politician_id, sic_code) AS match_count FROM matches",
    "graded": """SELECT s.*, CASE WHEN s.sic_code IS NULL THEN 'no_sic' WHEN f.politician_id IS NULL THEN 'no_committee_assignments' WHEN r.mapping_id IS NOT NULL THEN 'match'
          WHEN f.unmapped THEN 'unmapped_committees' ELSE 'no_match' END AS reason,
        CASE reason WHEN 'match' THEN 'relevant' WHEN 'no_match' THEN 'not_relevant' ELSE 'unknown' END AS status,
        CASE WHEN status = 'unknown' THEN 'unknown' WHEN status = 'not_relevant' THEN 'no_relevance' WHEN g.direct THEN 'reviewed_direct'
          WHEN g.reviewed THEN 'reviewed_related_only' ELSE 'needs_review_only' END AS review_category,
        coalesce(r.match_count, 0) AS match_count, r.mapping_id, r.committee_code, r.subcommittee_code, r.relevance_level
      FROM subjects s LEFT JOIN (SELECT politician_id, bool_or(committee_code NOT IN (SELECT committee_code FROM cm)) AS unmapped FROM seats GROUP BY 1) f USING (politician_id)
      LEFT JOIN (SELECT * FROM ranked WHERE place = 1) r ON r.politician_id = s.politician_id AND r.sic_code = s.sic_code
      LEFT JOIN (SELECT politician_id, sic_code, bool_or(review_status = 'reviewed' AND relevance_level = 'direct') AS direct, bool_or(review_status = 'reviewed') AS reviewed
                 FROM matches GROUP BY ALL) g ON g.politician_id = s.politician_id AND g.sic_code = s.sic_code""",
    "hits": """SELECT m.mapping_id, s.* FROM cm m JOIN (SELECT * FROM securities WHERE ticker IN (SELECT ticker FROM trades)) s
        ON s.sic_code::int BETWEEN m.sic_start AND m.sic_end AND (m.industry_pattern IS NULL OR regexp_matches(s.industry, '(?i)' || m.industry_pattern))""",
    "listed": """SELECT r.*, s.trades AS n FROM (SELECT * FROM ranked WHERE sic_code IS NOT NULL) r
        JOIN (SELECT politician_id, sic_code, sum(trades) AS trades FROM subjects WHERE sic_code IS NOT NULL GROUP BY ALL) s USING (politician_id, sic_code)""",
    "rowstats": """SELECT m.*, m.committee_code || coalesce('/' || m.subcommittee_code, '') || ':' || CASE WHEN sic_start IS NULL THEN 'none' ELSE
          lpad(sic_start::varchar, 4, '0') || '-' || lpad(sic_end::varchar, 4, '0') END || ':' || relevance_level AS row_key,
        (SELECT count(*) FROM hits h WHERE h.mapping_id = m.mapping_id) AS securities_matched,
        (SELECT count(DISTINCT substr(sic_code, 1, 3)) FROM hits h WHERE h.mapping_id = m.mapping_id) AS industry_groups,
        (SELECT string_agg(ticker, ',' ORDER BY ticker) FROM (SELECT ticker FROM hits h WHERE h.mapping_id = m.mapping_id ORDER BY ticker LIMIT 8)) AS example_tickers,
        (SELECT coalesce(sum(n), 0)::bigint FROM listed l WHERE l.mapping_id = m.mapping_id) AS trades_matched,
        (SELECT coalesce(sum(n) FILTER (place = 1), 0)::bigint FROM listed l WHERE l.mapping_id = m.mapping_id) AS trades_primary,
        (SELECT count(DISTINCT politician_id) FROM listed l WHERE l.mapping_id = m.mapping_id) AS politicians_matched,
        (SELECT count(DISTINCT sic_code) FROM securities s WHERE s.sic_code::int BETWEEN m.sic_start AND m.sic_end) AS official_titles FROM cm m""",
    "range_overlaps": """SELECT DISTINCT m.mapping_id, o.committee_code || coalesce('/' || o.subcommittee_code, '') || ' ' || lpad(o.sic_start::varchar, 4, '0') || '-'
          || lpad(o.sic_end::varchar, 4, '0') || ' (' || o.relevance_level || ')' AS overlaps_with
        FROM cm m JOIN cm o ON o.committee_code <> m.committee_code AND o.sic_start <= m.sic_end AND m.sic_start <= o.sic_end
        WHERE m.relevance_level <> 'none' AND o.relevance_level <> 'none'""",
    "flagged_rows": """SELECT *, len(list_intersect(flags, ['broad_range', 'mixed_industries', 'many_matches', 'false_positive_history'])) > 0 AS priority FROM (SELECT *, list_filter([
          CASE WHEN relevance_level <> 'none' AND (sic_end - sic_start >= 100 OR official_titles >= 10) THEN 'broad_range' END,
          CASE WHEN relevance_level <> 'none' AND industry_groups >= 2 THEN 'mixed_industries' END,
          CASE WHEN jurisdiction_basis NOT IN ('rule_x_text', 'committee_published_text') THEN 'inferred_from_name' END,
          CASE WHEN relevance_level = 'related' THEN 'related_level' END, CASE WHEN trades_matched >= 25 THEN 'many_matches' END,
          CASE WHEN mapping_id IN (SELECT mapping_id FROM range_overlaps) THEN 'overlaps_other_committee' END,
          CASE WHEN review_note LIKE 'Review history%' THEN 'false_positive_history' END], lambda f: f IS NOT NULL) AS flags FROM rowstats)""",
}
oracle("industry_relevance", """SELECT politician_id, sic_code, industry, status, reason, review_category, match_count, mapping_id, committee_code, subcommittee_code, relevance_level
  FROM graded""", **RELEVANCE)
oracle("seat_mapping_matches", "SELECT politician_id, sic_code, mapping_id FROM matches", **RELEVANCE)
oracle("primary_match", "SELECT politician_id, sic_code, mapping_id, match_count FROM ranked WHERE place = 1", **RELEVANCE)
oracle("relevance_report", """
  SELECT 'status' AS measure, status AS item, sum(trades)::bigint AS trades FROM graded GROUP BY 2
  UNION ALL SELECT 'review_category', review_category, sum(trades)::bigint FROM graded GROUP BY 2
  UNION ALL SELECT 'unknown_reason', reason, sum(trades)::bigint FROM graded WHERE status = 'unknown' GROUP BY 2
  UNION ALL SELECT 'best_level', relevance_level, sum(trades)::bigint FROM graded WHERE relevance_level IS NOT NULL GROUP BY 2
  UNION ALL SELECT 'primary_committee', committee_code || coalesce('/' || subcommittee_code, ''), sum(trades)::bigint FROM graded WHERE mapping_id IS NOT NULL GROUP BY 2
  UNION ALL SELECT 'sic_group', CASE WHEN sic_code::int BETWEEN 3480 AND 3489 OR sic_code::int BETWEEN 3720 AND 3769 OR sic_code::int IN (3795, 3812) THEN 'defense'
      WHEN sic_code::int BETWEEN 6000 AND 6499 THEN 'finance' WHEN sic_code::int BETWEEN 2833 AND 2836 OR sic_code::int BETWEEN 3841 AND 3845 THEN 'healthcare'
      WHEN sic_code::int BETWEEN 1200 AND 1399 OR sic_code::int = 2911 OR sic_code::int BETWEEN 4911 AND 4939 THEN 'energy'
      WHEN sic_code::int BETWEEN 4011 AND 4599 OR sic_code::int = 3743 THEN 'transportation' END AS item, sum(trades)::bigint FROM graded WHERE status = 'relevant' GROUP BY 2 HAVING item IS NOT NULL
  UNION ALL SELECT 'total', item, n FROM (SELECT 'trades' AS item, sum(trades)::bigint AS n FROM graded UNION ALL SELECT 'evaluable', sum(trades)::bigint FROM graded WHERE status <> 'unknown'
    UNION ALL SELECT 'securities', count(*) FROM securities WHERE ticker IN (SELECT ticker FROM trades) UNION ALL SELECT 'securities_with_code', count(*) FROM securities WHERE sic_code IS NOT NULL AND ticker IN (SELECT ticker FROM trades)
    UNION ALL SELECT 'politicians', count(*) FROM politicians UNION ALL SELECT 'politicians_with_seats', count(DISTINCT politician_id) FROM seats)
  UNION ALL SELECT 'unmapped_committee', s.committee_name, sum(g.trades)::bigint FROM graded g
    JOIN (SELECT DISTINCT politician_id, committee_code, upper(committee_code[1]) || lower(committee_code[2:]) AS committee_name FROM seats WHERE committee_code NOT IN (SELECT committee_code FROM cm)) s USING (politician_id)
    WHERE g.reason = 'unmapped_committees' GROUP BY 2""", **RELEVANCE)
oracle("mapping_review_stats", """SELECT mapping_id, row_key, securities_matched, industry_groups, trades_matched, trades_primary, politicians_matched, example_tickers
  FROM rowstats""", **RELEVANCE)
oracle("security_descriptions", "SELECT mapping_id, sic_code, coalesce(industry, '') AS industry, count(*) AS securities FROM hits GROUP BY ALL", **RELEVANCE)
oracle("mapping_overlaps", f"""SELECT DISTINCT m.mapping_id, o.committee_code || coalesce('/' || o.sub, '') || ' ' || lpad(o.first::varchar, 4, '0') || '-' || lpad(o.last::varchar, 4, '0') || ' (' || o.level || ')' AS overlaps_with, members
  FROM drafts m JOIN drafts o ON o.committee_code <> m.committee_code AND o.first <= m.last AND m.first <= o.last
    JOIN (SELECT committee_code, count(DISTINCT politician_id) AS members FROM seats GROUP BY 1) s ON s.committee_code = m.committee_code""",
    drafts=f"""SELECT p_partkey AS mapping_id, {_pick(COMMITTEES, 'p_partkey')} AS committee_code, CASE WHEN p_partkey % 4 = 0 THEN 'S' || (p_partkey % 3) END AS sub, 1000 + (p_partkey * 37 + p_size * 131) % 797 * 10 AS first,
      1000 + (p_partkey * 37 + p_size * 131) % 797 * 10 + p_size % 12 AS last, CASE WHEN p_partkey % 2 = 0 THEN 'direct' ELSE 'related' END AS level FROM part WHERE p_partkey % 5 <> 0""")
oracle("scrutiny_flags", "SELECT mapping_id, array_to_string(flags, ',') AS flags, official_titles FROM flagged_rows", **RELEVANCE)
oracle("review_summary", """SELECT count(*) AS mappings, count(*) FILTER (relevance_level = 'direct') AS direct, count(*) FILTER (relevance_level = 'related') AS related,
  count(*) FILTER (relevance_level = 'none') AS none, count(*) FILTER (subcommittee_code IS NULL) AS committee_level, count(*) FILTER (subcommittee_code IS NOT NULL) AS subcommittee_level,
  count(*) FILTER (explicit) AS explicit_jurisdiction, count(*) FILTER (jurisdiction_basis = 'subcommittee_name') AS inferred_subcommittee_name,
  count(*) FILTER (jurisdiction_basis = 'committee_name') AS inferred_committee_name, count(*) FILTER (explicit AND relevance_level <> 'none') AS explicit_jurisdiction_non_none,
  count(*) FILTER (review_status = 'needs_review') AS needs_review, count(*) FILTER (review_status = 'reviewed') AS reviewed, count(*) FILTER (len(flags) > 0) AS rows_flagged_for_scrutiny,
  count(*) FILTER (priority) AS rows_with_a_priority_concern, count(*) FILTER (relevance_level <> 'none' AND securities_matched = 0) AS rows_matching_no_current_security,
  count(*) FILTER (relevance_level <> 'none' AND trades_matched = 0) AS rows_matching_no_current_trade
  FROM (SELECT *, jurisdiction_basis IN ('rule_x_text', 'committee_published_text') AS explicit FROM flagged_rows)""", **RELEVANCE)
oracle("priority_rows", """SELECT row_key, relevance_level, trades_matched, row_number() OVER (ORDER BY CASE relevance_level WHEN 'direct' THEN 0 WHEN 'related' THEN 1 ELSE 2 END,
  trades_matched DESC, list_contains(flags, 'broad_range')::int + list_contains(flags, 'mixed_industries')::int DESC, row_key)::int AS position FROM flagged_rows WHERE priority""", **RELEVANCE)
oracle("top_mappings", "SELECT row_key, trades_matched, trades_primary FROM flagged_rows WHERE relevance_level <> 'none' ORDER BY trades_matched DESC, row_key LIMIT 20", **RELEVANCE)
oracle("recommendation_gaps", """
  SELECT * FROM (SELECT coalesce(r.row_key, p.row_key) AS row_key, action, CASE WHEN r.row_key IS NULL THEN 'missing recommendation' WHEN reason IS NULL THEN 'reason needed'
      WHEN action = 'CHANGE' THEN 'unknown action' WHEN p.row_key IS NULL THEN 'not a selected row'
      WHEN action = 'APPROVE DIRECT' AND p.relevance_level <> 'direct' THEN 'action needs a direct row'
      WHEN action = 'KEEP RELATED' AND p.relevance_level <> 'related' THEN 'action needs a related row' END AS problem
    FROM (SELECT row_key, CASE mapping_id % 3 WHEN 0 THEN 'APPROVE DIRECT' WHEN 1 THEN 'KEEP RELATED' ELSE 'CHANGE' END AS action,
            CASE WHEN mapping_id <> 8 THEN 'read' END AS reason FROM flagged_rows WHERE trades_matched > 0) r
    FULL JOIN (SELECT * FROM flagged_rows WHERE priority) p ON p.row_key = r.row_key) WHERE problem IS NOT NULL""", **RELEVANCE)
oracle("mapping_sync", """SELECT mapping_id, mapping_version, sic_start, sic_end FROM mappings
  WHERE mapping_version NOT IN (SELECT mapping_version FROM cm) OR committee_code IN (SELECT committee_code FROM seats)""", **RELEVANCE)

# --- seats over time -------------------------------------------------------------------------------------------------
_COVERS = f"""coalesce(CASE s.temporal_precision WHEN 'congress' THEN s.congress_number = {congress('d.transaction_date')}
    WHEN 'exact_date' THEN d.transaction_date BETWEEN s.start_date AND coalesce(s.end_date, s.verified_through) END, false)"""
SEATS = {
    "ordered_events": f"""SELECT *, {congress('date')} AS congress, row_number() OVER w AS i, lag(verb) OVER w AS prev, lead(verb) OVER w AS next, lead(date) OVER w AS next_date
      FROM committee_events WINDOW w AS (PARTITION BY bioguide_id, committee_code, {congress('date')} ORDER BY date, (verb = 'removed')::int, seq)""",
    "intervals": """SELECT e.bioguide_id, e.committee_code, e.congress, e.date AS start_date, e.next_date AS end_date, e.url, a.re_elections, a.orphan_removals,
        a.re_elections = 0 AND a.orphan_removals = 0 AS history_complete
      FROM (SELECT * REPLACE (CASE WHEN next = 'removed' THEN next_date END AS next_date) FROM ordered_events WHERE verb = 'elected' AND (next IS NULL OR next = 'removed')) e
      JOIN (SELECT bioguide_id, committee_code, congress, count(*) FILTER (verb = 'elected' AND prev = 'elected') AS re_elections,
              count(*) FILTER (verb = 'removed' AND coalesce(prev, 'removed') = 'removed') AS orphan_removals FROM ordered_events GROUP BY ALL) a
        USING (bioguide_id, committee_code, congress)""",
    "days": "SELECT DISTINCT politician_id, transaction_date FROM trades",
    "seat_facts": f"""SELECT d.politician_id, d.transaction_date, s.*, {congress('d.transaction_date')} AS n, {_COVERS} AS covers,
        s.temporal_precision IN ('exact_date', 'congress') AS dated,
        max(CASE WHEN s.temporal_precision = 'current_snapshot' THEN s.congress_number END) OVER p AS snapshot,
        bool_or(s.temporal_precision = 'exact_date' AND s.history_complete AND s.congress_number = {congress('d.transaction_date')}) OVER p AS scanned
      FROM days d JOIN (SELECT politician_id AS pid, * EXCLUDE (politician_id) FROM seats) s ON s.pid = d.politician_id
      WINDOW p AS (PARTITION BY d.politician_id, d.transaction_date)""",
    "statuses": """SELECT politician_id, transaction_date, committee_code, CASE
        WHEN count(*) FILTER (here) = 0 THEN CASE WHEN bool_or(scanned) AND max(snapshot) <> max(n) THEN 'contradicted' ELSE 'unknown' END
        WHEN coalesce(bool_or(covers) FILTER (here AND temporal_precision = 'exact_date'), false) THEN 'verified'
        WHEN bool_and((transaction_date < start_date OR coalesce(transaction_date > end_date, false)) AND coalesce(history_complete, false)) FILTER (here AND temporal_precision = 'exact_date') THEN 'contradicted'
        WHEN count(*) FILTER (here AND temporal_precision = 'congress') > 0 THEN 'verified' ELSE 'unknown' END AS history_status
      FROM (SELECT *, dated AND congress_number = n AND subcommittee_code IS NULL AS here FROM seat_facts) GROUP BY ALL""",
    "seat_days": """SELECT f.*, history_status, history_status <> 'contradicted' AND (NOT dated OR covers) AS applies,
        CASE WHEN dated OR (subcommittee_code IS NULL AND history_status = 'verified') THEN 'temporally_verified' ELSE 'current_assignment_only' END AS seat_status
      FROM seat_facts f JOIN statuses USING (politician_id, transaction_date, committee_code)""",
}
oracle("seat_intervals", "SELECT * FROM intervals", **SEATS)
oracle("seats_on_date", "SELECT politician_id, transaction_date, committee_code, temporal_precision FROM seat_facts WHERE covers", **SEATS)
oracle("committee_history_status", "SELECT * FROM statuses", **SEATS)
oracle("effective_seats", "SELECT politician_id, transaction_date, committee_code, subcommittee_code, temporal_precision, seat_status FROM seat_days WHERE applies", **SEATS)
oracle("congress_numbers", f"SELECT {congress('o_orderdate::date')} AS congress, count(*) AS days FROM orders GROUP BY 1")
oracle("sync_seat_history", f"""
  SELECT politician_id, committee_code, subcommittee_code, temporal_precision, CASE WHEN temporal_precision = 'current_snapshot' THEN 107 ELSE congress_number END AS congress_number,
    start_date, end_date, CASE WHEN temporal_precision = 'current_snapshot' THEN {_D} ELSE verified_through END AS verified_through, history_complete,
    upper(committee_code[1]) || lower(committee_code[2:]) AS committee_name
  FROM seats WHERE NOT (temporal_precision <> 'current_snapshot' AND congress_number = 104)
  UNION ALL SELECT c_custkey, committee_code, NULL, 'exact_date', congress, start_date, end_date, NULL, history_complete, 'Committee ' || committee_code
  FROM intervals JOIN customer ON bioguide_id = chr((65 + c_custkey % 26)::int) || lpad((c_custkey % 1000000)::varchar, 6, '0') WHERE congress = 104""", **SEATS)

# --- context ---------------------------------------------------------------------------------------------------------
CONTEXT = {
    **SEATS, **EXCESS, **SIZES, **DELAY,
    "cm": "SELECT *, 'x' AS k FROM current_mappings",
    "ask": "SELECT DISTINCT t.politician_id, t.transaction_date, coalesce(t.ticker, '') AS ticker_key, s.sic_code, s.industry FROM trades t LEFT JOIN securities s USING (ticker)",
    "day_facts": """SELECT politician_id, transaction_date, count(*) AS seats, count(*) FILTER (applies) AS applied,
        bool_and(seat_status = 'temporally_verified') FILTER (applies) AS all_verified, bool_or(applies AND committee_code NOT IN (SELECT committee_code FROM cm)) AS unmapped
      FROM seat_days GROUP BY ALL""",
    "reach": """SELECT d.politician_id, d.transaction_date, m.mapping_id, bool_or(applies) AS applied, bool_or(applies AND seat_status = 'temporally_verified') AS verified,
        bool_or(NOT dated) AS snapshot
      FROM seat_days d JOIN cm m ON m.committee_code = d.committee_code AND (m.subcommittee_code IS NULL OR m.subcommittee_code = d.subcommittee_code)
      WHERE m.relevance_level <> 'none' GROUP BY ALL""",
    "found": """SELECT a.politician_id, a.transaction_date, a.ticker_key, m.mapping_id, m.subcommittee_code, m.relevance_level, m.review_status = 'reviewed' AS reviewed, r.applied, r.verified, r.snapshot
      FROM ask a JOIN reach r USING (politician_id, transaction_date) JOIN cm m USING (mapping_id)
      WHERE a.sic_code::int BETWEEN m.sic_start AND m.sic_end AND (m.industry_pattern IS NULL OR regexp_matches(a.industry, '(?i)' || m.industry_pattern))""",
    "summed": """SELECT politician_id, transaction_date, ticker_key, count(*) FILTER (applied AND reviewed AND relevance_level = 'direct') AS direct,
        count(*) FILTER (applied AND reviewed AND relevance_level = 'direct' AND verified) AS direct_verified,
        count(*) FILTER (applied AND reviewed AND relevance_level <> 'direct') AS related, count(*) FILTER (snapshot AND reviewed AND relevance_level = 'direct') AS current_direct,
        count(*) FILTER (applied AND NOT reviewed) AS pending FROM found GROUP BY ALL""",
    "signals": """SELECT a.*, f.seats, f.applied, CASE WHEN a.sic_code IS NULL THEN 'no_sic' WHEN f.seats IS NULL THEN 'no_committee_assignments' WHEN coalesce(s.direct, 0) > 0 THEN 'direct_match'
          WHEN f.applied < f.seats AND coalesce(s.current_direct, 0) > 0 THEN 'seat_not_held_on_transaction_date' WHEN f.applied = 0 THEN 'no_seat_on_transaction_date'
          WHEN f.unmapped THEN 'unmapped_committees' ELSE 'no_reviewed_direct_match' END AS reason,
        CASE WHEN reason = 'direct_match' THEN true WHEN reason IN ('no_sic', 'no_committee_assignments', 'unmapped_committees') THEN NULL ELSE false END AS relevance,
        CASE WHEN f.seats IS NULL THEN 'unavailable' WHEN reason = 'direct_match' THEN CASE WHEN s.direct_verified > 0 THEN 'temporally_verified' ELSE 'current_assignment_only' END
          WHEN reason = 'seat_not_held_on_transaction_date' THEN 'contradicted' WHEN reason = 'no_seat_on_transaction_date' OR f.all_verified THEN 'temporally_verified'
          ELSE 'current_assignment_only' END AS timing,
        coalesce(s.direct, 0) AS direct, coalesce(s.related, 0) AS related, CASE WHEN reason = 'seat_not_held_on_transaction_date' THEN s.current_direct ELSE 0 END AS rejected,
        coalesce(s.pending, 0) AS pending
      FROM ask a LEFT JOIN day_facts f USING (politician_id, transaction_date) LEFT JOIN summed s USING (politician_id, transaction_date, ticker_key)""",
    "ctx": f"""SELECT z.id AS trade_id, z.politician_id, z.ticker, z.transaction_date, '{ContextConfig().version_label()}' AS context_version, '2001.1' AS mapping_version, s.relevance AS committee_relevance,
        s.reason AS committee_relevance_reason, s.timing AS committee_temporal_status, s.reason = 'seat_not_held_on_transaction_date' AS committee_contradicted,
        z.pct >= 90 AS trade_size_anomaly, z.pct2, z.value, z.basis, z.n, d.days, d.days > 45 AS disclosure_delay_signal, x.signal AS excess_return_signal, x.tx_excess_return AS excess_return,
        x.performance_status, s.pending AS pending_review, s.ticker_key,
        coalesce(trade_size_anomaly, false)::int + coalesce(disclosure_delay_signal, false)::int + coalesce(excess_return_signal, false)::int AS secondary_signal_count,
        secondary_signal_count + coalesce(committee_relevance, false)::int AS signal_count, coalesce(committee_relevance, false) AND secondary_signal_count >= 2 AS meets_flag_rule,
        meets_flag_rule AND committee_temporal_status = 'temporally_verified' AS flagged_for_contextual_review, meets_flag_rule AND NOT flagged_for_contextual_review AS pending_temporal
      FROM rounded z JOIN signals s ON s.politician_id = z.politician_id AND s.transaction_date = z.transaction_date AND s.ticker_key = coalesce(z.ticker, '')
      JOIN delays d ON d.id = z.id JOIN excesses x ON x.id = z.id""",
    "evidence": f"""SELECT c.trade_id, 'committee_relevance' AS signal_type, 'mapping:' || f.mapping_id AS evidence_key,
        CASE WHEN NOT f.applied OR c.committee_contradicted AND f.relevance_level = 'direct' THEN 'rejected_current_assignment' WHEN f.relevance_level = 'direct' THEN 'reviewed_direct_mapping' ELSE 'reviewed_related_mapping' END AS evidence_type,
        NULL::bigint AS days, f.mapping_id, CASE WHEN f.verified THEN 'temporally verified' ELSE 'current assignment only' END AS timing
      FROM ctx c JOIN found f USING (politician_id, transaction_date, ticker_key)
      WHERE f.reviewed AND (f.applied OR (c.committee_contradicted AND f.snapshot AND f.relevance_level = 'direct'))
      UNION ALL SELECT trade_id, 'trade_size_anomaly', 'metric', 'metric', NULL, NULL, NULL FROM ctx WHERE value IS NOT NULL
      UNION ALL SELECT trade_id, 'disclosure_delay_signal', 'metric', 'metric', days, NULL, NULL FROM ctx WHERE days IS NOT NULL
      UNION ALL SELECT trade_id, 'excess_return_signal', 'metric', 'metric', NULL, NULL, NULL FROM ctx WHERE excess_return IS NOT NULL""",
    "explained": """SELECT split_part(trade_id, '-', 1)::bigint AS explanation_id, trade_id, explanation_id % 5 <> 0 AND explanation_id % 3 <> 0 AS fresh FROM ctx""",
}
oracle("committee_signal", """SELECT politician_id, transaction_date, ticker_key, relevance AS committee_relevance, reason AS committee_relevance_reason, timing AS committee_temporal_status,
  direct, related, rejected, pending AS pending_review FROM signals""", **CONTEXT)
_CONTEXT_COLUMNS = """trade_id, context_version, mapping_version, committee_relevance, committee_relevance_reason, committee_temporal_status, committee_contradicted, trade_size_anomaly,
  disclosure_delay_signal, excess_return_signal, signal_count, secondary_signal_count, meets_flag_rule, flagged_for_contextual_review, pending_temporal, pending_review"""
oracle("context_flags", f"SELECT {_CONTEXT_COLUMNS} FROM ctx", **CONTEXT)
oracle("context_flags_custom", """SELECT trade_id, committee_relevance IS TRUE AND k >= 1 AS meets_flag_rule, committee_relevance IS TRUE AND k >= 1 AS flagged_for_contextual_review, k AS secondary_signal_count
  FROM (SELECT c.trade_id, c.committee_relevance, coalesce(CASE WHEN z.value IS NOT NULL AND z.n >= 5 THEN (less + 0.5::double * same) / h.n * 100 END >= 90, false)::int
          + coalesce(c.days > 60, false)::int + coalesce(c.excess_return_signal, false)::int AS k
        FROM ctx c JOIN size_signals z ON z.id = c.trade_id LEFT JOIN history h ON h.id = c.trade_id)""", **CONTEXT)


def _tri(name):
    return f"SELECT '{name}' AS measure, CASE WHEN {name} THEN 'true' WHEN NOT {name} THEN 'false' ELSE 'unknown' END AS item, count(*) AS trades FROM ctx GROUP BY 2"


def _level(name, sub, verified):
    test = f"subcommittee_code IS {'NOT ' if sub else ''}NULL" + (" AND verified" if verified else "")
    return f"""SELECT '{name}', 'trades', count(*) FROM ctx c WHERE committee_relevance AND EXISTS (SELECT 1 FROM found f WHERE f.politician_id = c.politician_id
      AND f.transaction_date = c.transaction_date AND f.ticker_key = c.ticker_key AND applied AND reviewed AND relevance_level = 'direct' AND {test}) HAVING count(*) > 0"""


oracle("context_summary", " UNION ALL ".join([
    *[_tri(n) for n in ("committee_relevance", "trade_size_anomaly", "disclosure_delay_signal", "excess_return_signal")],
    "SELECT 'evaluated', 'trades', count(*) FROM ctx",
    "SELECT 'secondary_signals', secondary_signal_count::varchar, count(*) FROM ctx GROUP BY 2",
    "SELECT 'secondary_signals_committee', secondary_signal_count::varchar, count(*) FROM ctx WHERE committee_relevance GROUP BY 2",
    "SELECT 'temporal_status', committee_temporal_status, count(*) FROM ctx GROUP BY 2",
    "SELECT 'temporal_status_committee', committee_temporal_status, count(*) FROM ctx WHERE committee_relevance GROUP BY 2",
    "SELECT 'committee_unknown_reason', committee_relevance_reason, count(*) FROM ctx WHERE committee_relevance IS NULL GROUP BY 2",
    *[f"SELECT 'flag', '{item}', count(*) FROM ctx WHERE {c} HAVING count(*) > 0" for item, c in (
        ("meets_rule", "meets_flag_rule"), ("flagged", "flagged_for_contextual_review"), ("pending_temporal", "pending_temporal"))],
    "SELECT 'contradicted', 'trades', count(*) FROM ctx WHERE committee_contradicted HAVING count(*) > 0",
    "SELECT 'needs_review_ignored', 'trades', count(*) FROM ctx WHERE pending_review > 0 HAVING count(*) > 0",
    _level("committee_level", False, False), _level("committee_level_verified", False, True),
    _level("subcommittee_level", True, False), _level("subcommittee_level_verified", True, True),
    """SELECT 'subcommittee_only', 'trades', count(*) FROM ctx c WHERE committee_relevance AND NOT EXISTS (SELECT 1 FROM found f WHERE f.politician_id = c.politician_id
      AND f.transaction_date = c.transaction_date AND f.ticker_key = c.ticker_key AND applied AND reviewed AND relevance_level = 'direct' AND subcommittee_code IS NULL) HAVING count(*) > 0""",
    "SELECT 'flagged_distinct', 'politicians', count(DISTINCT politician_id) FROM ctx WHERE flagged_for_contextual_review",
    "SELECT 'flagged_distinct', 'tickers', count(DISTINCT ticker) FROM ctx WHERE flagged_for_contextual_review",
]), **CONTEXT)
oracle("context_evidence", """SELECT signal_type, evidence_type, evidence_key, count(*) AS rows, sum(days)::bigint AS days, min(trade_id) AS first_trade, max(trade_id) AS last_trade
  FROM evidence GROUP BY ALL""", **CONTEXT)
oracle("context_evidence_text", """
  SELECT trade_id, evidence_key, evidence_type, CASE signal_type WHEN 'disclosure_delay_signal' THEN 'Filed on day ' || days || ' after the trade; after day 45 a filing counts as late, whatever the reason'
    ELSE CASE evidence_type WHEN 'reviewed_direct_mapping' THEN 'Within the committee''s remit' WHEN 'reviewed_related_mapping' THEN 'Close to the committee''s remit, no signal by itself'
        ELSE 'Not counted, as the dated record has no such seat on the day of the trade' END
      || ' - ' || m.committee_name || coalesce(' / ' || m.subcommittee_name, '') || ' covers codes ' || lpad(m.sic_start::varchar, 4, '0') || '-' || lpad(m.sic_end::varchar, 4, '0') || ' (Jurisdiction row ' || mapping_id || '.)'
      || CASE WHEN evidence_type = 'rejected_current_assignment' THEN '' ELSE '; seat: ' || timing END END AS description
  FROM evidence LEFT JOIN cm m USING (mapping_id) WHERE signal_type IN ('committee_relevance', 'disclosure_delay_signal')""", **CONTEXT)
oracle("context_merge", """SELECT CASE WHEN transaction_date > DATE '2000-06-30' THEN 'inserted' WHEN trade_size_anomaly THEN 'updated' ELSE 'unchanged' END AS action, count(*) AS rows, sum(coalesce(proofs, 0))::bigint AS evidence
  FROM ctx LEFT JOIN (SELECT trade_id, count(*) AS proofs FROM evidence GROUP BY 1) USING (trade_id) GROUP BY 1""", **CONTEXT)
oracle("fresh_explanations", "SELECT trade_id, explanation_id, 'Trade ' || trade_id AS headline FROM explained WHERE fresh", **CONTEXT)
oracle("trade_list_page", """SELECT id, politician_name, disclosure_date FROM trades WHERE chamber = 'house' AND transaction_type = 'buy' AND transaction_date >= DATE '1998-01-01'
  ORDER BY disclosure_date DESC NULLS LAST, id DESC LIMIT 500 OFFSET 100""")
oracle("trade_list_flagged", "SELECT trade_id AS id, ticker, transaction_date FROM ctx WHERE flagged_for_contextual_review", **CONTEXT)
oracle("trade_page_nulls_last", "SELECT id, ticker, amount_min FROM trades ORDER BY ticker DESC NULLS LAST, id DESC LIMIT 500")
oracle("politician_list", "SELECT id, name FROM politicians WHERE chamber = 'senate' AND name ILIKE '%marie%'")

SCREEN = {
    **CONTEXT,
    "screen": """SELECT t.*, c.* EXCLUDE (politician_id, ticker, transaction_date, ticker_key), e.fresh, p.district, s.company_name, s.name AS security_name, s.industry, s.sector,
        EXISTS (SELECT 1 FROM evidence v WHERE v.trade_id = t.id AND evidence_type = 'reviewed_related_mapping') AS has_related,
        EXISTS (SELECT 1 FROM evidence v JOIN cm m USING (mapping_id) WHERE v.trade_id = t.id AND evidence_type <> 'rejected_current_assignment' AND
          (m.committee_code = 'MACHINERY' OR m.subcommittee_code = 'MACHINERY1')) AS machinery
      FROM trades t JOIN ctx c ON c.trade_id = t.id JOIN explained e ON e.trade_id = t.id LEFT JOIN politicians p ON p.id = t.politician_id LEFT JOIN securities s ON s.ticker = t.ticker""",
}
_FILTERS = {
    "dimensions": "politician_name ILIKE '%marie%' AND chamber = 'house' AND party = 'R' AND (asset_name ILIKE '%ring%' OR company_name ILIKE '%ring%' OR security_name ILIKE '%ring%') "
                  "AND (industry ILIKE '%ndustr%' OR sector ILIKE '%ndustr%') AND transaction_type IN ('buy', 'sell')",
    "numbers": "transaction_date BETWEEN DATE '1996-01-01' AND DATE '2000-12-31' AND amount_min >= 15001 AND days >= 30 AND abs(excess_return * 100) + 1e-7 >= 10 AND pct2 <= 95",
    "context": "committee_relevance AND machinery AND (committee_relevance AND committee_temporal_status = 'temporally_verified')::int + secondary_signal_count >= 2",
    "unknowns": "committee_relevance IS NULL AND NOT flagged_for_contextual_review AND NOT fresh",
    "exclusions": "district = '3' AND ticker ILIKE '%rand#1%' AND disclosure_date >= DATE '1997-01-01' AND amount_max <= 50000 AND state = 'SD' AND fresh",
}
oracle("screen_counts", " UNION ALL ".join(
    f"""SELECT '{n}' AS filters, count(*) AS total, count(*) FILTER (flagged_for_contextual_review) AS custom_match_count,
      count(*) FILTER (flagged_for_contextual_review) AS canonical_flag_count FROM screen WHERE {w}""" for n, w in _FILTERS.items()), **SCREEN)


def _rule(name, committee, size, delay, excess, need, required=True):
    oracle(name, f"""SELECT id, committee_active, size_active, delay_active, excess_active, active_count, matches, matches <> flagged_for_contextual_review AS differs_from_canonical
      FROM (SELECT id, flagged_for_contextual_review, {committee} AS committee_active, coalesce({size}, false) AS size_active, coalesce({delay}, false) AS delay_active,
          coalesce({excess}, false) AS excess_active, size_active::int + delay_active::int + excess_active::int AS k, k + {'committee_active::int' if required else '0'} AS active_count,
          {'committee_active AND ' if required else ''} k >= {need} AS matches FROM screen)""", **SCREEN)


_VERIFIED = "committee_relevance IS TRUE AND committee_temporal_status = 'temporally_verified'"
_rule("screen_rule_balanced", _VERIFIED, "trade_size_anomaly", "disclosure_delay_signal", "excess_return_signal", 2)
_rule("screen_rule_market", _VERIFIED, "trade_size_anomaly", "disclosure_delay_signal", "excess_return_signal", 2, False)
_rule("screen_rule_strict", _VERIFIED, "pct2 >= 95", "days > 60", "performance_status = 'ok' AND abs(excess_return) * 100 + 1e-7 >= 25", 3)
_rule("screen_rule_related", "(committee_relevance IS TRUE OR has_related)", "pct2 >= 75", "days > 30", "performance_status = 'ok' AND abs(excess_return) * 100 + 1e-7 >= 10", 1)
oracle("rule_sweep", f"""SELECT CASE WHEN required THEN 'committee' ELSE 'market' END || '-' || enabled || '-' || need AS rule, CASE WHEN refused THEN 'refused' WHEN required AND enabled = 3 AND need = 2 THEN 'default'
    WHEN NOT required THEN 'market_only' WHEN need = 0 THEN 'committee_only' ELSE 'custom' END AS kind, count(*) FILTER (NOT refused AND (NOT required OR verified)
      AND coalesce(trade_size_anomaly, false)::int + (enabled > 1 AND coalesce(disclosure_delay_signal, false))::int + (enabled > 2 AND coalesce(excess_return_signal, false))::int >= need) AS matches
  FROM (SELECT *, need > enabled OR (NOT required AND need = 0) AS refused FROM (VALUES (true), (false)) a(required), range(1, 4) b(enabled), range(0, 4) c(need)), (SELECT *, {_VERIFIED} AS verified FROM ctx) GROUP BY ALL""", **CONTEXT)
oracle("screen_page", f"""SELECT id, politician_name, {_VERIFIED} AS matches, ({_VERIFIED})::int + secondary_signal_count AS active_count FROM screen WHERE {_FILTERS['numbers']}
  ORDER BY politician_name NULLS LAST, id DESC LIMIT 200 OFFSET 20""", **SCREEN)

# --- people and securities -------------------------------------------------------------------------------------------
_SUFFIXES = "('jr', 'sr', 'ii', 'iii', 'iv', 'v')"
_FITS = "(p.state IS NULL OR r.state IS NULL OR r.state = p.state)"
PEOPLE = {
    "words": f"""SELECT id, name, chamber, state, district, list_filter(w, lambda x, i: i = 1 OR i = len(w) OR length(x) > 1) AS w, list_filter(w, lambda x, i: i > 1 AND i < len(w) AND length(x) = 1)[1] AS initial
      FROM (SELECT *, CASE WHEN len(t) > 2 AND t[-1] IN {_SUFFIXES} THEN t[:-2] ELSE t END AS w FROM (
        SELECT *, list_filter(string_split_regex(replace(replace(lower(name), '.', ''), chr(39), ''), '[^a-z0-9]+'), lambda x: x <> '') AS t FROM politicians))""",
    "official": """SELECT *, lower(first_name) AS f, replace(lower(last_name), chr(39), '') AS l, rtrim(lower(middle_name), '.') AS m FROM roster""",
    "strict": f"""SELECT p.id, count(DISTINCT r.bioguide_id) AS n, min(r.bioguide_id) AS only FROM words p JOIN official r ON r.chamber = p.chamber AND {_FITS}
        AND (array_to_string(p.w, ' ') = f || ' ' || l OR (length(m) > 1 AND array_to_string(p.w, ' ') = f || ' ' || m || ' ' || l))
        AND (p.initial IS NULL OR m IS NULL OR p.initial = m[1]) GROUP BY p.id""",
    "loose": f"""SELECT p.id, count(DISTINCT r.bioguide_id) AS n, min(r.bioguide_id) AS only FROM words p JOIN official r ON r.chamber = p.chamber AND {_FITS}
        AND len(p.w) = 3 AND p.w[1] = f AND p.w[3] = l AND (m IS NULL OR (length(m) = 1 AND p.w[2][1] = m) OR p.w[2] = m)
        WHERE p.id NOT IN (SELECT id FROM strict) GROUP BY p.id""",
    "matched": """SELECT p.id, p.name, p.chamber, p.state, CASE WHEN coalesce(s.n, l.n) = 1 THEN 'matched' WHEN coalesce(s.n, l.n) > 1 THEN 'ambiguous' ELSE 'unmatched' END AS status,
        CASE WHEN s.n = 1 THEN 'exact_name+chamber' WHEN l.n = 1 THEN 'name_with_extra_middle+chamber' END AS method,
        CASE WHEN coalesce(s.n, l.n) = 1 THEN coalesce(s.only, l.only) END AS bioguide_id,
        CASE WHEN coalesce(s.n, l.n) IS NULL THEN coalesce(c.near, 0) END AS same_surname, CASE WHEN coalesce(s.n, l.n) IS NULL THEN c.first END AS same_surname_first
      FROM words p LEFT JOIN strict s USING (id) LEFT JOIN loose l USING (id)
      LEFT JOIN (SELECT chamber, l, count(*) AS near, min(bioguide_id) AS first FROM official GROUP BY ALL) c ON c.chamber = p.chamber AND c.l = p.w[-1]""",
    "links": f"""SELECT id, CASE WHEN id % 5 = 0 THEN 'Z999999' WHEN id % 7 = 0 THEN {_official('id + 1')} ELSE {_official('id')} END AS bioguide_id FROM politicians""",
    "gated": f"""SELECT s.*, CASE WHEN coalesce(v.n, 0) <> 1 THEN 'not exactly one valid candidate' WHEN s.chosen IS NULL THEN 'nothing selected' WHEN r.chamber IS NULL THEN 'not in the official roster'
          WHEN r.chamber <> s.chamber THEN 'other chamber' WHEN r.state <> s.state THEN 'other state' WHEN r.chamber = 'house' AND r.district <> s.district THEN 'other district'
          WHEN r.l <> s.surname THEN 'not a candidate that was shown' WHEN s.chosen <> v.only THEN 'not the valid candidate'
          WHEN o.owner <> s.id THEN 'belongs to another politician' WHEN s.confidence < 0.3 THEN 'confidence too low' END AS reason
      FROM (SELECT id, chamber, state, district, w[-1] AS surname, (id % 11) / 10.0::double AS confidence,
              CASE WHEN id % 7 = 0 THEN NULL WHEN id % 7 = 1 THEN 'Z000000' WHEN id % 7 = 2 THEN {_official('id + 1')} ELSE {_official('id')} END AS chosen FROM words) s
      LEFT JOIN (SELECT p.id, count(*) AS n, min(r.bioguide_id) AS only FROM words p JOIN official r ON r.chamber = p.chamber AND r.l = p.w[-1] AND {_FITS}
                   AND (r.chamber <> 'house' OR p.district IS NULL OR r.district IS NULL OR r.district = p.district) GROUP BY p.id) v USING (id)
      LEFT JOIN official r ON r.bioguide_id = s.chosen LEFT JOIN (SELECT bioguide_id, max(id) AS owner FROM politicians WHERE bioguide_id IS NOT NULL GROUP BY 1) o ON o.bioguide_id = s.chosen""",
}
oracle("match_politicians", "SELECT id, status, method, bioguide_id, same_surname, same_surname_first FROM matched", **PEOPLE)
oracle("due_politicians", f"""SELECT id, CASE WHEN enrichment_status = 'review' THEN 'override' WHEN enrichment_status = 'unmatched' AND district IS NULL THEN 'suggestion'
  WHEN enrichment_status = 'matched' THEN CASE WHEN enriched_at > TIMESTAMP '{NOW}' - INTERVAL 30 DAY THEN 'current' ELSE 'due' END
  WHEN enrichment_checked_at > TIMESTAMP '{NOW}' - INTERVAL 7 DAY THEN 'recent_attempt' ELSE 'due' END AS due_reason FROM politicians""")
oracle("override_resolution", """SELECT id, bioguide_id, CASE WHEN note IS NULL THEN 'matched' ELSE 'conflict' END AS status, note FROM (
    SELECT m.id, k.bioguide_id, CASE WHEN r.chamber IS NULL THEN 'not in the official roster' WHEN r.chamber <> m.chamber THEN 'other chamber' WHEN r.state <> m.state THEN 'other state' END AS note
    FROM matched m JOIN links k USING (id) LEFT JOIN roster r ON r.bioguide_id = k.bioguide_id WHERE m.status = 'unmatched')""", **PEOPLE)
oracle("ownership_conflicts", """SELECT id, bioguide_id, CASE WHEN note IS NULL THEN 'matched' ELSE 'conflict' END AS status, note FROM (
    SELECT c.id, c.bioguide_id, CASE WHEN coalesce(owner, CASE WHEN winner < c.id THEN winner END) <> c.id THEN 'belongs to another politician' WHEN own <> c.bioguide_id THEN 'linked to another official' END AS note
    FROM claims c LEFT JOIN (SELECT bioguide_id, min(id) AS winner FROM claims WHERE owner IS NULL AND (own IS NULL OR own = bioguide_id) GROUP BY 1) w USING (bioguide_id))""", **PEOPLE,
    claims="""SELECT m.id, m.bioguide_id, p.bioguide_id AS own, o.owner FROM matched m JOIN politicians p USING (id)
      LEFT JOIN (SELECT bioguide_id, max(id) AS owner FROM politicians WHERE bioguide_id IS NOT NULL GROUP BY 1) o ON o.bioguide_id = m.bioguide_id WHERE m.bioguide_id IS NOT NULL""")
oracle("refresh_seats", f"""SELECT politician_id, committee_code, subcommittee_code, temporal_precision, start_date FROM seats
    WHERE temporal_precision <> 'current_snapshot' OR politician_id NOT IN (SELECT id FROM matched WHERE status = 'matched')
  UNION ALL SELECT m.id, c_mktsegment, NULL, 'current_snapshot', NULL FROM matched m JOIN customer ON {_official('c_custkey')} = m.bioguide_id WHERE m.status = 'matched'""", **PEOPLE)
oracle("load_overrides", """
  SELECT * FROM (SELECT 'not an official id' AS item, count(*) AS entries FROM checked WHERE link = '12345' UNION ALL SELECT 'reason needed', count(*) FROM checked WHERE id % 3 = 0
    UNION ALL SELECT 'already matched automatically', count(*) FROM checked WHERE enrichment_status = 'matched' UNION ALL SELECT 'official id belongs to another politician', count(*) FROM checked WHERE taken
    UNION ALL SELECT 'official id appears for several politicians', count(*) FROM checked WHERE shared) WHERE entries > 0
  UNION ALL SELECT 'skipped', count(*) FROM politicians WHERE id % 29 = 0 UNION ALL SELECT 'accepted', 0""",
    linked=f"SELECT *, CASE WHEN id % 5 = 0 THEN '12345' ELSE {_official('id')} END AS link FROM politicians WHERE id % 29 <> 0",
    checked="""SELECT e.*, s.n > 1 AS shared, EXISTS (SELECT 1 FROM politicians x WHERE x.id <> e.id AND x.bioguide_id = e.link) AS taken
      FROM linked e JOIN (SELECT link, count(DISTINCT id) AS n FROM linked GROUP BY 1) s USING (link)""")
oracle("suggestion_gate", "SELECT id AS politician_id, CASE WHEN reason IS NULL THEN 'review' ELSE 'rejected' END AS outcome, reason FROM gated", **PEOPLE)
oracle("review_queue", """SELECT p.id, p.enrichment_status, g.chosen AS suggestion_selected_bioguide_id, g.confidence AS suggestion_confidence,
  CASE WHEN g.reason IS NULL THEN 'review' ELSE 'rejected' END AS suggestion_outcome, g.reason AS suggestion_reason FROM politicians p JOIN gated g USING (id)
  WHERE p.enrichment_status <> 'matched'""", **PEOPLE)
oracle("member_records", f"""SELECT {_official('c_custkey')} AS bioguide_id,
  concat_ws(' ', {_pick(FIRST_NAMES, 'c_custkey')}, CASE WHEN c_custkey % 2 = 0 THEN 'Lee' END, {_last('c_custkey')}, CASE WHEN c_custkey % 4 = 1 THEN 'Jr.' END) AS full_name,
  CASE WHEN c_custkey % 4 = 1 THEN 'Jr.' END AS suffix, 'house' AS chamber, (['D', 'R', 'Green'])[c_custkey % 3 + 1] AS party, (['OH', 'NY', 'TX', NULL])[c_nationkey % 4 + 1] AS state,
  CASE WHEN c_custkey % 4 = 0 THEN 'At Large' ELSE (c_custkey % 4)::varchar END AS district, c_custkey % 5 <> 0 AS active, 1991 AS term_start_year,
  'https://www.congress.gov/member/' || lower({_pick(FIRST_NAMES, 'c_custkey')}) || '-' || lower({_last('c_custkey')}) || '/' || {_official('c_custkey')} AS official_url
  FROM customer WHERE c_custkey % 9 <> 8""")
REGISTERS = {
    "brands": "SELECT p_brand, substr(p_brand, 7)::int AS no, min(p_name) AS part_name FROM part GROUP BY 1",
    "looked_up": """SELECT s.*, b.no, b.part_name, CASE WHEN no % 5 <> 0 THEN 'full' WHEN no % 10 <> 0 THEN 'plain' END AS list, no % 6 = 0 AS ambiguous FROM securities s JOIN brands b ON b.p_brand = s.ticker""",
}
_SIC = "lpad((no * 40)::varchar, 4, '0')"
oracle("resolve_profiles", f"""
  SELECT ticker, CASE WHEN hit THEN part_name || ' Corp' ELSE company_name END AS company_name, CASE WHEN hit THEN lpad((1000 + no)::varchar, 10, '0') END AS cik_code,
    CASE WHEN hit THEN CASE WHEN coded THEN {_SIC} END ELSE sic_code END AS sic_code, CASE WHEN hit THEN CASE WHEN coded THEN 'Kind ' || no END ELSE industry END AS industry,
    CASE WHEN hit THEN CASE WHEN coded THEN CASE WHEN no * 40 // 100 BETWEEN 1 AND 9 THEN 'Agriculture, Forestry, and Fishing' WHEN no * 40 // 100 BETWEEN 10 AND 14 THEN 'Mining' END END ELSE sector END AS sector,
    CASE WHEN hit THEN CASE WHEN list = 'full' THEN 'NYSE' ELSE 'OTC' END END AS exchange,
    CASE WHEN hit THEN CASE WHEN coded THEN 'ok' ELSE 'partial' END WHEN profile_status IN ('ok', 'partial') THEN profile_status ELSE 'unresolved' END AS profile_status,
    CASE WHEN hit THEN CASE WHEN NOT coded THEN 'no industry code is published for this company' END WHEN profile_status IN ('ok', 'partial') THEN 'not found in the latest list; earlier profile kept'
      WHEN list IS NOT NULL THEN 'listed under several registrants' ELSE 'not listed' END AS profile_note
  FROM (SELECT *, list IS NOT NULL AND NOT ambiguous AS hit, no % 4 > 1 AS coded FROM looked_up)""", **REGISTERS)
oracle("due_securities", f"""SELECT ticker, CASE WHEN profile_status = 'ok' AND profile_checked_at > TIMESTAMP '{NOW}' - INTERVAL 90 DAY THEN 'current'
  WHEN profile_status = 'unresolved' AND profile_checked_at > TIMESTAMP '{NOW}' - INTERVAL 30 DAY THEN 'recent_attempt' ELSE 'due' END AS due_reason
  FROM securities WHERE ticker IN (SELECT ticker FROM trades)""")
HOUSE = {
    "house": f"""SELECT c_custkey AS key, CASE WHEN c_custkey % 8 <> 7 THEN {_official('c_custkey')} END AS bioguide_id, {_pick(FIRST_NAMES, 'c_custkey')} AS f, {_last('c_custkey')} AS l,
        'N' || {_letter('c_custkey % 25')} AS state, CASE WHEN c_custkey % 10 = 0 THEN DATE '1998-01-01' END AS sworn FROM customer""",
    "resolutions": f"""SELECT 'Res. ' || o_orderkey AS label, o_orderkey::varchar AS url, o_orderdate::date AS date, CASE WHEN o_orderstatus = 'O' THEN 'removed' ELSE 'elected' END AS verb,
        CASE WHEN o_orderkey % 11 = 0 THEN 'Committee on Ways' ELSE 'Committee on Priority ' || {_pick(['A', 'B', 'C', 'D', 'E'], 'o_custkey')} END AS header,
        CASE WHEN o_orderkey % 11 <> 0 THEN {_pick(['A', 'B', 'C', 'D', 'E'], 'o_custkey')} END AS committee_code, {_pick(FIRST_NAMES, 'o_custkey')} AS f, {_last('o_custkey')} AS l,
        CASE WHEN o_orderkey % 2 = 0 THEN 'N' || {_letter('o_custkey % 25')} END AS state FROM orders WHERE o_orderkey % 13 <> 0""",
    "listed_names": """SELECT * EXCLUDE (f, l, state), 0 AS segment, l AS name, state, NULL AS odd, NULL AS first, l AS last FROM resolutions
      UNION ALL SELECT * EXCLUDE (f, l, state), 1, f || ' ' || l, NULL, NULL, f, l FROM resolutions
      UNION ALL SELECT * EXCLUDE (f, l, state), 3, NULL, NULL, 'the Speaker', NULL, NULL FROM resolutions""",
    "placed": """SELECT n.label, n.segment, any_value(n.date) AS date, any_value(n.verb) AS verb, any_value(n.url) AS url, any_value(n.committee_code) AS committee_code, any_value(n.odd) AS odd,
        count(h.key) AS c, min(h.bioguide_id) AS bioguide_id
      FROM listed_names n LEFT JOIN house h ON n.committee_code IS NOT NULL AND h.l = n.last AND (n.first IS NULL OR h.f = n.first) AND (n.state IS NULL OR h.state = n.state)
        AND (h.bioguide_id IS NULL OR h.sworn IS NULL OR n.date >= h.sworn) GROUP BY n.label, n.segment""",
}
oracle("committee_paragraphs", "SELECT label, date, verb, header, segment, name, state, odd FROM listed_names", **HOUSE)
oracle("committee_events_found", "SELECT bioguide_id, committee_code, date, verb, url, segment FROM placed WHERE c = 1 AND bioguide_id IS NOT NULL", **HOUSE)
oracle("committee_event_report", """SELECT CASE WHEN committee_code IS NULL THEN 'unmapped_committee' WHEN odd IS NOT NULL THEN 'odd_segment' WHEN c = 1 AND bioguide_id IS NOT NULL THEN 'event'
  WHEN c > 1 THEN 'ambiguous' ELSE 'unresolved' END AS outcome, count(*) AS names FROM placed GROUP BY 1""", **HOUSE)
oracle("latest_trade_per_politician", """SELECT politician_id, id, ticker, transaction_type FROM trades
  QUALIFY row_number() OVER (PARTITION BY politician_id ORDER BY transaction_date DESC, id DESC) = 1""")
_NO_NAMES = "[" + ", ".join(f"'{w}'" for w in K.NAME_STOP_WORDS) + "]"
_WORDS_OF = "list_filter(regexp_extract_all(lower({0}), '[a-z]+'), lambda w: NOT list_contains(" + _NO_NAMES + ", w))"
_PLAIN = "' ' || trim(regexp_replace(lower({0}), '[^\\p{{L}}\\p{{N}}_]+', ' ', 'g')) || ' '"
_CORE = "trim(regexp_replace(lower(trim({0})), '^(committee|subcommittee) on (the )?', ''))"
_UNIT = "CASE lower({0}) " + " ".join(f"WHEN '{name}' THEN {value:.0f}::double" for name, value in K.UNIT_SCALES.items()) + " ELSE 1::double END"
_SQL = lambda pattern: pattern.replace("'", "''")
AUDIT = {
    **CONTEXT,
    "told": f"""SELECT trade_id, flagged, [{{'w': 'headline', 'text': {HEADLINE}}}, {{'w': 'summary', 'text': {SUMMARY}}}, {{'w': 'limitations', 'text': {LIMITATIONS}}}] AS texts,
        [{{'type': 'committee_relevance', 'text': {FIRST_EXPLANATION}}}, {{'type': 'trade_size_anomaly', 'text': 'See the stored value.'}}, {{'type': 'disclosure_delay_signal', 'text': 'See the stored value.'}},
         {{'type': {LAST_SIGNAL}, 'text': 'See the stored value.'}}] AS signals
      FROM (SELECT c.trade_id, split_part(c.trade_id, '-', 1)::bigint AS n, c.days, c.transaction_date, t.ticker, t.amount_min, c.flagged_for_contextual_review AS flagged FROM ctx c JOIN trades t ON t.id = c.trade_id)""",
    "pieces": """SELECT trade_id, flagged, x.w AS w, x.text AS text FROM (SELECT trade_id, flagged, unnest(texts) AS x FROM told)
      UNION ALL SELECT trade_id, flagged, 'signals[' || i || ']', signals[i + 1].text FROM (SELECT trade_id, flagged, signals, unnest(range(0, len(signals))) AS i FROM told)""",
    "held": "SELECT DISTINCT e.trade_id, m.committee_name, m.subcommittee_name, m.mapping_id, m.sic_start, m.sic_end FROM evidence e JOIN cm m USING (mapping_id) WHERE signal_type = 'committee_relevance'",
    "supplied": """SELECT c.trade_id, list_filter(list_concat([abs(t.amount_min), abs(t.amount_max), (t.amount_min + t.amount_max) / 2::double, abs(c.pct2), c.n, abs(c.days), CASE WHEN x.tx_excess_return IS NOT NULL THEN 90 END,
          90, 45, 20, 1, 2, 3, 4, c.secondary_signal_count, try_cast(s.sic_code AS double), round(abs(x.tx_return) * 100, 2), round(abs(x.tx_benchmark_return) * 100, 2), round(abs(x.tx_excess_return) * 100, 2),
          round(abs(x.adjusted) * 100, 2), year(t.transaction_date), month(t.transaction_date), day(t.transaction_date), year(t.disclosure_date), month(t.disclosure_date), day(t.disclosure_date)]::double[],
          coalesce(q.quoted, []::double[])), lambda v: v IS NOT NULL) AS numbers
      FROM ctx c JOIN trades t ON t.id = c.trade_id JOIN excesses x ON x.id = c.trade_id LEFT JOIN securities s ON s.ticker = t.ticker
        LEFT JOIN (SELECT trade_id, flatten(list([sic_start, sic_end, mapping_id]::double[])) AS quoted FROM held GROUP BY 1) q ON q.trade_id = c.trade_id""",
    "clauses": "SELECT trade_id, flagged, w, unnest(string_split_regex(regexp_replace(text, '([.!?;])\\s+', '\\1' || chr(10), 'g'), '\\n+')) AS c FROM pieces",
    "stated_numbers": """SELECT trade_id, w, replace(regexp_extract(m, '(\\d[\\d,]*(?:\\.\\d+)?)', 1), ',', '') AS raw, regexp_extract(m, '(?i)(million|billion|thousand|bn|m|k)$', 1) AS unit, trim(regexp_replace(m, '^[^\\w.$]', '')) AS shown
      FROM (SELECT trade_id, w, unnest(regexp_extract_all(text, '(?i)(?:^|[^\\w.])\\$?\\d[\\d,]*(?:\\.\\d+)?(?:\\s*(?:million|billion|thousand|bn|m|k)\\b)?')) AS m FROM pieces)""",
    "figures": f"""SELECT trade_id, w, shown, raw::double * {_UNIT.format('unit')} AS v, 0.5::double * pow(10::double, -len(regexp_extract(raw, '\\.(\\d+)$', 1))) * {_UNIT.format('unit')} + 1e-9::double AS tolerance FROM stated_numbers""",
    "spoken": f"""SELECT trade_id, w, list_sort(list_distinct({_WORDS_OF.format('m')})) AS names FROM (SELECT trade_id, w,
        unnest(regexp_extract_all(text, '(?:[A-Z][A-Za-z]* )*(?:Committee|Subcommittee)(?: on(?: (?:[A-Z][A-Za-z]*|(?:and|of|for|the|on)\\b))+)?')) AS m FROM pieces)""",
    "phrases": f"SELECT DISTINCT {_CORE.format('committee_name')} AS phrase FROM current_mappings WHERE {_CORE.format('committee_name')} LIKE '% %'",
    "found_problems": f"""SELECT trade_id, w || ' uses ' || regexp_extract(c, '{_SQL(K.FORBIDDEN_PATTERN)}') || ' outside a denial' AS p FROM clauses WHERE regexp_matches(c, '{_SQL(K.FORBIDDEN_PATTERN)}') AND NOT regexp_matches(c, '{_SQL(K.NEGATION_PATTERN)}')
      UNION SELECT trade_id, w || ' speaks of a flag, but the trade is not flagged' FROM clauses WHERE NOT flagged AND regexp_matches(c, '{_SQL(K.FLAG_WORD_PATTERN)}') AND NOT regexp_matches(c, '{_SQL(K.NOT_FLAGGED_PATTERN)}')
      UNION SELECT f.trade_id, w || ' states ' || shown || ', which was not supplied' FROM figures f JOIN supplied s ON s.trade_id = f.trade_id WHERE len(list_filter(numbers, lambda a: abs(v - a) <= tolerance)) = 0
      UNION SELECT s.trade_id, w || ' names a committee that is not in the evidence: ' || array_to_string(names, ' ') FROM spoken s WHERE len(names) > 0
        AND NOT EXISTS (SELECT 1 FROM held h WHERE h.trade_id = s.trade_id AND list_has_all({_WORDS_OF.format("concat_ws(' ', h.committee_name, h.subcommittee_name)")}, s.names))
      UNION SELECT p.trade_id, w || ' mentions ' || phrase || ', which is not in the evidence' FROM pieces p JOIN phrases f ON contains({_PLAIN.format('p.text')}, ' ' || phrase || ' ')
        WHERE NOT EXISTS (SELECT 1 FROM held h WHERE h.trade_id = p.trade_id AND ({_CORE.format('h.committee_name')} = phrase OR {_CORE.format('h.subcommittee_name')} = phrase))
      UNION SELECT trade_id, x.w || CASE WHEN x.text = '' THEN ' is empty' ELSE ' is longer than ' || x.cap || ' characters' END FROM (SELECT trade_id, unnest(list_transform(texts, lambda x, i: {{'w': x.w, 'text': x.text, 'cap': [{K.MAX_HEADLINE}, {K.MAX_SUMMARY}, {K.MAX_LIMITATIONS}][i]}})) AS x FROM told)
        WHERE x.text = '' OR len(x.text) > x.cap
      UNION SELECT trade_id, 'a signal is explained twice' FROM told WHERE len(list_distinct(list_transform(signals, lambda s: s.type))) < len(signals)
      UNION SELECT trade_id, 'signals[' || i || '] ' || CASE WHEN NOT list_contains({list(K.SIGNALS)}, s.type) THEN 'is not a signal of this trade' ELSE 'has no explanation' END
        FROM (SELECT trade_id, i, signals[i + 1] AS s FROM (SELECT trade_id, signals, unnest(range(0, len(signals))) AS i FROM told)) WHERE NOT list_contains({list(K.SIGNALS)}, s.type) OR s.text = ''""",
}
oracle("explanation_audit", """SELECT c.trade_id, coalesce(string_agg(p, '; ' ORDER BY p), '') AS problems FROM ctx c LEFT JOIN found_problems f ON f.trade_id = c.trade_id GROUP BY 1""", **AUDIT)
oracle("stream_ingest", """SELECT 'trades' AS table_name, count(*) AS rows FROM numbered UNION ALL SELECT 'rejects', (SELECT count(*) FROM feed) - (SELECT count(*) FROM usable)
  UNION ALL SELECT 'politicians', count(DISTINCT canonical_key) FROM identified UNION ALL SELECT 'securities', count(DISTINCT ticker) FROM usable
  UNION ALL SELECT 'inserted', count(*) FROM numbered UNION ALL SELECT 'skipped', 0""", **FEED)
_PLACE = "{0} + (({0} + 9) // 10) - 1 - f.seq // 2 - (f.seq // 2 + 9) // 10 - f.seq % 2"
oracle("stream_pages", "SELECT fingerprint, occurrence FROM numbered", **FEED)
# a run numbers identical lines from nought, so of a line it brings as many as it has more of than are stored
oracle("paged_ingest", """SELECT 1 AS run, 0 AS start_page, (SELECT lim FROM sizes) AS pages, count(*) AS fetched, count(*) FILTER (identity IS NULL) AS rejected, count(identity) AS inserted, 'page limit: the next run goes on' AS stopped FROM one
  UNION ALL SELECT 2, any_value(start_page), any_value(pages1) - any_value(start_page), count(*), count(*) FILTER (identity IS NULL), (SELECT sum(greatest(had - before, 0))::bigint FROM held), 'end of the feed' FROM two
  UNION ALL SELECT 3, 0, any_value(last_page) + 1, count(*), count(*) FILTER (identity IS NULL), (SELECT sum(new)::bigint FROM fresh WHERE page <= (SELECT last_page FROM stop)), CASE WHEN any_value(last_page) < any_value(pages2) - 1 THEN 'caught up: a page had nothing new' ELSE 'end of the feed' END
    FROM placed, stop WHERE page2 <= last_page""", **FEED,
    sizes="""SELECT n, m, least(greatest(1, pages1 // 2), pages1) AS lim, pages1, (n + (n + 9) // 10 + 499) // 500 AS pages2 FROM (SELECT n, m, (m + (m + 9) // 10 + 499) // 500 AS pages1 FROM (SELECT count(*) AS n, count(*) * 4 // 5 AS m FROM events))""",
    placed=f"""SELECT f.seq, i.identity, CASE WHEN f.seq // 2 < m THEN ({_PLACE.format("m")}) // 500 END AS page1, ({_PLACE.format("n")}) // 500 AS page2, lim, pages1, pages2
      FROM (SELECT seq, n, m, lim, pages1, pages2 FROM feed, sizes) f LEFT JOIN identified i ON i.seq = f.seq""",
    one="SELECT * FROM placed WHERE page1 < lim",
    two="SELECT * FROM placed, (SELECT greatest(0, count(identity) // 500 - 1) AS start_page FROM one) WHERE page1 >= start_page",
    held="""SELECT identity, coalesce(a.c, 0) AS before, coalesce(b.c, 0) AS had FROM (SELECT identity, count(*) AS c FROM one WHERE identity IS NOT NULL GROUP BY 1) a
      FULL JOIN (SELECT identity, count(*) AS c FROM two WHERE identity IS NOT NULL GROUP BY 1) b USING (identity)""",
    fresh="""SELECT page2 AS page, sum(greatest(0, upto - greatest(upto - c, coalesce(stored, 0)))) AS new FROM (SELECT page2, identity, c, sum(c) OVER (PARTITION BY identity ORDER BY page2) AS upto
      FROM (SELECT page2, identity, count(*) AS c FROM placed WHERE identity IS NOT NULL GROUP BY ALL)) LEFT JOIN (SELECT identity, greatest(before, had) AS stored FROM held) USING (identity) GROUP BY 1""",
    stop="SELECT coalesce((SELECT min(page2) FROM (SELECT DISTINCT page2 FROM placed) WHERE page2 NOT IN (SELECT page FROM fresh WHERE new > 0)), max(page2)) AS last_page FROM placed")
