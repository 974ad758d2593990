"""The tables of :mod:`tables` as common table expressions for DuckDB, and a helper that joins them to a query."""

import re

from .tables import BENCHMARK, COMMITTEES, FIRST_NAMES, MAPPINGS, MIDDLES, NOW, ROSTER_MIDDLES, TODAY


def _q(v):
    return "NULL" if v is None else str(v) if isinstance(v, int) else "'" + v.replace("'", "''") + "'"


def _pick(values, index):
    return f"([{', '.join(_q(v) for v in values)}])[({index}) % {len(values)} + 1]"


def _last(key):
    return f"'Mc' || translate((({key}) // 3)::varchar, '0123456789', 'abcdefghij')"


def _name(key):
    return (
        f"concat_ws(' ', {_pick(FIRST_NAMES, key)}, nullif({_pick(MIDDLES, key)}, ''), {_last(key)}, "
        f"CASE WHEN ({key}) % 10 = 9 THEN 'Jr.' END)"
    )


def _chamber(key):
    return f"CASE WHEN ({key}) % 5 < 4 THEN 'house' ELSE 'senate' END"


def _letter(n):
    return f"chr((65 + {n})::int)"


def _official(key):
    return f"{_letter(f'({key}) % 26')} || lpad((({key}) % 1000000)::varchar, 6, '0')"


def congress(d):
    return f"((year(({d}) - 2) - 1789) // 2 + 1)"


def key_of(name, chamber):
    """Identity key: words between first and last that are a single letter do not count."""
    words = f"list_filter(string_split_regex(trim({name}), '\\s+'), lambda w: w <> '')"
    return (
        f"({chamber} || ':' || regexp_replace(lower(array_to_string(list_filter({words}, lambda w, i: i = 1 OR i = len({words}) "
        f"OR NOT regexp_full_match(w, '[A-Za-z]\\.*')), ' ')), '[^a-z0-9]+', '', 'g'))"
    )


_DIVISION = (
    "CASE WHEN sic_code IS NULL THEN NULL WHEN m BETWEEN 1 AND 9 THEN 'Agriculture, Forestry, and Fishing' "
    "WHEN m BETWEEN 10 AND 14 THEN 'Mining' WHEN m BETWEEN 15 AND 17 THEN 'Construction' "
    "WHEN m BETWEEN 20 AND 39 THEN 'Manufacturing' WHEN m BETWEEN 40 AND 49 THEN "
    "'Transportation, Communications, Electric, Gas, and Sanitary Services' END"
)

TABLES = {
    "lines": "SELECT *, l_shipdate::date AS day, round(l_extendedprice * 100)::bigint AS cents FROM lineitem",
    "trades": f"""
      SELECT concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity::bigint, cents, strftime(day, '%Y%m%d')) AS id,
        'src-' || l_linestatus AS source, o_custkey AS politician_id, {_name('o_custkey')} AS politician_name,
        {_chamber('o_custkey')} AS chamber,
        CASE o_custkey % 3 WHEN 0 THEN 'D' WHEN 1 THEN 'R' END AS party, 'S' || {_letter('o_custkey % 25')} AS state,
        CASE WHEN p_size <> 1 THEN p_brand END AS ticker, p_name AS asset_name,
        CASE WHEN l_returnflag = 'A' THEN 'buy' WHEN l_returnflag = 'R' THEN 'sell' WHEN l_linestatus = 'F' THEN 'sell_partial' ELSE 'exchange' END AS transaction_type,
        day AS transaction_date,
        CASE WHEN l_quantity <> 1 THEN day + ((l_partkey * 7 + l_suppkey) % 100 - 5)::int END AS disclosure_date,
        CASE WHEN l_extendedprice < 1001 THEN NULL WHEN l_linenumber = 7 THEN floor(l_extendedprice)::bigint WHEN l_quantity = 50 THEN 99999
          WHEN l_extendedprice <= 15000 THEN 1001 WHEN l_extendedprice <= 50000 THEN 15001 WHEN l_extendedprice <= 100000 THEN 50001 ELSE 100000 END::bigint AS amount_min,
        CASE WHEN l_extendedprice < 1001 THEN NULL WHEN l_linenumber = 7 THEN floor(l_extendedprice)::bigint WHEN l_quantity = 50 THEN 15000
          WHEN l_extendedprice <= 15000 THEN 15000 WHEN l_extendedprice <= 50000 THEN 50000 WHEN l_extendedprice <= 100000 THEN 100000 END::bigint AS amount_max
      FROM lines JOIN orders ON o_orderkey = l_orderkey JOIN part ON p_partkey = l_partkey""",
    "bars": """
      SELECT p_brand AS ticker, day AS date, (sum(cents) // sum(l_quantity::bigint)) / 100.0::double AS close,
        CASE WHEN day(day) <> 13 THEN (sum(cents) // sum(l_quantity::bigint)) / 100.0::double END AS adj_close, sum(l_quantity::bigint)::bigint AS volume
      FROM lines JOIN part ON p_partkey = l_partkey WHERE isodow(day) < 6 GROUP BY p_brand, day""",
    "benchmark_bars": f"""
      SELECT '{BENCHMARK}' AS ticker, day AS date, (sum(cents) // sum(l_quantity::bigint)) / 100.0::double AS close,
        CASE WHEN day(day) <> 13 THEN (sum(cents) // sum(l_quantity::bigint)) / 100.0::double END AS adj_close, sum(l_quantity::bigint)::bigint AS volume
      FROM lines WHERE isodow(day) < 6 GROUP BY day""",
    "politicians": f"""
      SELECT *, {key_of('name', 'chamber')} AS canonical_key FROM (
        SELECT c_custkey AS id, {_name('c_custkey')} AS name, {_chamber('c_custkey')} AS chamber,
          CASE WHEN c_acctbal < 0 THEN NULL WHEN c_custkey % 3 = 0 THEN 'D' ELSE 'R' END AS party,
          CASE WHEN c_custkey % 19 <> 0 THEN 'N' || {_letter('c_nationkey')} END AS state,
          CASE WHEN c_custkey % 5 < 4 THEN (c_custkey % 10 + 1)::varchar END AS district,
          CASE c_custkey % 8 WHEN 0 THEN 'matched' WHEN 1 THEN 'unmatched' WHEN 2 THEN 'review' END AS enrichment_status,
          CASE WHEN c_custkey % 8 = 0 THEN {_official('CASE WHEN c_custkey % 64 = 0 THEN c_custkey + 1 ELSE c_custkey END')} END AS bioguide_id,
          CASE WHEN c_custkey % 8 = 0 THEN TIMESTAMP '{NOW}' - to_days((c_custkey % 60)::int) END AS enriched_at,
          CASE WHEN c_custkey % 8 < 3 THEN TIMESTAMP '{NOW}' - to_days((c_custkey % 14)::int) END AS enrichment_checked_at,
          CASE WHEN c_custkey % 8 = 0 THEN 'exact_name+chamber' END AS enrichment_method
        FROM customer)""",
    "roster": f"""
      SELECT {_official('c_custkey')} AS bioguide_id, {_pick(FIRST_NAMES, 'c_custkey')} AS first_name,
        {_pick(ROSTER_MIDDLES, 'c_custkey')} AS middle_name,
        CASE WHEN c_custkey % 9 = 4 THEN 'O''' || {_last('c_custkey')} ELSE {_last('c_custkey')} END AS last_name,
        CASE WHEN c_custkey % 13 = 5 THEN 'senate' ELSE {_chamber('c_custkey')} END AS chamber,
        CASE WHEN c_custkey % 17 <> 0 THEN 'N' || {_letter('c_nationkey')} END AS state,
        CASE WHEN c_custkey % 5 < 4 THEN (c_custkey % 10 + 1)::varchar END AS district
      FROM customer""",
    "securities": f"""
      SELECT ticker, 'Company ' || no AS name, 'Company ' || no || ' Inc' AS company_name, sic_code,
        CASE WHEN sic_code IS NOT NULL THEN 'Industry ' || no END AS industry, {_DIVISION} AS sector,
        CASE WHEN no % 5 = 0 THEN 'unavailable' WHEN no % 5 > 1 THEN 'ok' END AS price_status,
        CASE WHEN no % 5 <> 1 THEN TIMESTAMP '{NOW}' - to_days(no % 10) END AS price_checked_at,
        CASE WHEN no % 5 > 1 THEN DATE '1995-01-02' + no * 11 END AS price_from,
        CASE WHEN no % 5 > 1 THEN DATE '{TODAY}' - no % 3 END AS price_to,
        CASE WHEN no % 4 = 0 THEN 'ok' WHEN no % 4 = 1 THEN 'unresolved' END AS profile_status,
        CASE WHEN no % 4 < 2 THEN TIMESTAMP '{NOW}' - to_days(no * 6) END AS profile_checked_at
      FROM (SELECT *, CASE WHEN no % 8 <> 0 THEN lpad((1000 + no * 137)::varchar, 4, '0') END AS sic_code, (1000 + no * 137) // 100 AS m
            FROM (SELECT DISTINCT p_brand AS ticker, substr(p_brand, 7)::int AS no FROM part))""",
    "mappings": f"""
      SELECT *, 'Committee on ' || upper(committee_code[1]) || lower(committee_code[2:]) || ' and Works' AS committee_name,
        CASE WHEN subcommittee_code IS NOT NULL THEN 'Subcommittee on ' || upper(committee_code[1]) || lower(committee_code[2:]) || ' Standards' END AS subcommittee_name
      FROM (VALUES {', '.join('(' + ', '.join(_q(v) for v in row) + ')' for row in MAPPINGS)}) AS
        t(mapping_id, committee_code, subcommittee_code, sic_start, sic_end, industry_pattern, relevance_level, review_status,
          jurisdiction_basis, mapping_version, review_note)""",
    "current_mappings": "SELECT * FROM mappings WHERE mapping_version = (SELECT arg_max(mapping_version, mapping_id) FROM mappings)",
    "seats": f"""
      SELECT politician_id, committee_code, subcommittee_code, temporal_precision, congress_number, start_date, end_date,
        verified_through, history_complete, role FROM (
        SELECT c_custkey AS politician_id, c_mktsegment AS committee_code, NULL::varchar AS subcommittee_code, 'current_snapshot' AS temporal_precision,
          107 AS congress_number, NULL::date AS start_date, NULL::date AS end_date, DATE '{TODAY}' AS verified_through, NULL::boolean AS history_complete,
          c_acctbal, CASE WHEN c_custkey % 7 = 0 THEN 'Chair' ELSE 'Member' END AS role FROM customer
        UNION ALL
        SELECT c_custkey, c_mktsegment, c_mktsegment || (c_nationkey % 3), 'current_snapshot', 107, NULL, NULL, DATE '{TODAY}', NULL,
          c_acctbal, CASE WHEN c_custkey % 7 = 0 THEN 'Chair' ELSE 'Member' END FROM customer WHERE c_nationkey % 2 = 0
        UNION ALL
        SELECT c_custkey, CASE WHEN c_custkey % 4 = 0 THEN c_mktsegment ELSE {_pick(COMMITTEES, 'c_custkey')} END, NULL, 'exact_date',
          {congress("DATE '1995-01-03' + (c_custkey * 13 % 1500)::int")}, DATE '1995-01-03' + (c_custkey * 13 % 1500)::int,
          CASE WHEN c_custkey % 3 = 0 THEN DATE '1995-01-03' + (c_custkey * 13 % 1500)::int + 900 END,
          CASE WHEN c_custkey % 3 <> 0 THEN DATE '1995-01-03' + (c_custkey * 13 % 1500)::int + 400 END, c_custkey % 5 <> 0,
          c_acctbal, CASE WHEN c_custkey % 7 = 0 THEN 'Chair' ELSE 'Member' END FROM customer WHERE c_custkey % 2 = 0
        UNION ALL
        SELECT c_custkey, c_mktsegment, NULL, 'congress', 105, NULL, NULL, NULL, NULL,
          c_acctbal, CASE WHEN c_custkey % 7 = 0 THEN 'Chair' ELSE 'Member' END FROM customer WHERE c_custkey % 11 = 0)
      WHERE c_acctbal >= 0""",
    "committee_events": f"""
      SELECT {_official('o_custkey')} AS bioguide_id, substr(o_orderpriority, 1, 1) AS committee_code, o_orderdate::date AS date,
        CASE WHEN o_orderstatus = 'O' THEN 'removed' ELSE 'elected' END AS verb, 'https://example.gov/' || o_orderkey AS url, o_orderkey AS seq
      FROM orders""",
    "feed": f"""
      SELECT event_id * 2 + copy AS seq,
        CASE WHEN event_id % 97 = 0 THEN '  ' WHEN event_id % 10 = 3 THEN {_pick(FIRST_NAMES, 'user_id')} || ' ' || who ELSE who END AS member,
        CASE WHEN event_id % 53 = 0 THEN 'unknown' WHEN user_id % 5 < 4 THEN {_pick(['House', ' house ', 'HOUSE'], 'event_id')} ELSE 'Senate' END AS chamber,
        CASE event_type WHEN 'purchase' THEN 'Purchase' WHEN 'click' THEN 'Sale (Partial)' WHEN 'view' THEN 'S' WHEN 'signup' THEN 'Exchange' ELSE 'error' END AS trade_type,
        CASE event_id % 6 WHEN 0 THEN lo || ' - ' || hi WHEN 1 THEN 'Over ' || lo WHEN 2 THEN lo WHEN 3 THEN hi || ' - ' || lo WHEN 4 THEN 'undisclosed' END AS amount,
        CASE WHEN event_id % 89 = 0 THEN '2024-1-5' ELSE strftime(ts, '%Y-%m-%d') || 'T00:00:00' END AS tx_date,
        CASE WHEN event_id % 7 = 0 THEN '' ELSE strftime(ts::date + (event_id % 60)::int, '%Y-%m-%d') END AS disclosed,
        ' Acme  Works ' || (user_id % 9) || {_pick([' [ST]', ' (ACM)', ' - ', ' P 01/02/2024 02/03/2024 $1,001 - $15,000', ''], 'event_id')} AS asset,
        CASE event_id % 4 WHEN 0 THEN '--' WHEN 1 THEN ' t' || (user_id % 30) WHEN 2 THEN 'brk.b' ELSE 'not a ticker' END AS ticker,
        CASE WHEN event_id % 3 = 0 THEN '' ELSE 'https://example.gov/d/' || event_id END AS link
      FROM (SELECT *, '$' || format('{{:,}}', floor(value * 100)::bigint) AS lo, '$' || format('{{:,}}', floor(value * 100)::bigint * 3) AS hi,
              {_pick(['Mr. ', '', 'Hon. ', 'Rep ', ''], 'event_id')} || {_pick(FIRST_NAMES, 'user_id')} || ' ' || {_pick(['', 'Q ', 'Marie '], 'user_id')}
                || 'Mc' || translate(user_id::varchar, '0123456789', 'abcdefghij') AS who,
              unnest(CASE WHEN event_id % 10 = 0 THEN [0, 1] ELSE [0] END) AS copy
            FROM events)""",
}


def with_tables(select, **extra):
    """A query preceded by every table it needs, in dependency order. ``extra`` adds tables of its own."""
    known = {**TABLES, **extra}
    needed = []

    def visit(text, path):
        words = set(re.findall(r"\w+", re.sub(r"'[^']*'", "", text)))
        for name in known:
            if name in words and name not in needed and name not in path:
                visit(known[name], (*path, name))
                needed.append(name)

    visit(select, ())
    # tables that many others read are worked out once
    body = ",\n".join(f"{name} AS {'MATERIALIZED ' if name in ('ctx', 'found', 'evidence', 'explained', 'screen') else ''}({known[name]})" for name in needed)
    return f"WITH {body}\n{select}" if needed else select
