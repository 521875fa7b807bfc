"""SQL counterparts of the registered queries, for an independent engine.

Written for DuckDB over the star-schema tables. Where it can, the SQL takes
another road than the Spark code: sorted lists per snapshot instead of counting
entries, list-minus-self quantiles instead of order statistics.
"""

from __future__ import annotations

from cabinlift import schema as S

H = S.HORIZONS
KEY = ", ".join(S.AUCTION_KEY)
SCAN = list(reversed(H))  # 72 .. 01


def _each(template: str, sep: str = ", ") -> str:
    return sep.join(template.replace("{h}", h).replace("{n}", str(int(h))) for h in H)


def _names(names) -> str:
    return ", ".join(f'"{name}"' for name in names)


_NULL_READING = {"24": "s_suppkey % 7 = 3", "48": "s_suppkey % 11 = 5", "72": "s_suppkey % 13 = 4"}


def _event(h: str) -> str:
    at = f"departure_date_utc - to_hours({int(h)}) + to_minutes((s_suppkey % 5)::INTEGER)"
    return f"CASE WHEN NOT ({_NULL_READING[h]}) THEN {at} END" if h in _NULL_READING else at


def _quantile(q: float, name: str) -> str:
    place = f"({q}::DOUBLE * (len(others) - 1))"
    low = f"floor({place})::INTEGER"
    high = f"least({low} + 1, len(others) - 1)"
    part = f"({place} - floor({place}))"
    return (f"CASE WHEN len(others) > 0 THEN (1 - {part}) * others[{low} + 1] "
            f'+ {part} * others[{high} + 1] END AS "{name}"')


CTES = {
    "flights_base": """
        SELECT s_suppkey, n_name AS origination, q.quarter, c.cabin_type, b.booking_fare_class,
               x.seq, x.equip, x.more, x.swap
        FROM supplier JOIN nation ON s_nationkey = n_nationkey
        CROSS JOIN (SELECT unnest(generate_series(
            (SELECT date_trunc('quarter', min(l_shipdate)) FROM lineitem)::TIMESTAMP,
            (SELECT date_trunc('quarter', max(l_shipdate)) FROM lineitem)::TIMESTAMP,
            INTERVAL 3 MONTH)) AS quarter) q
        CROSS JOIN (VALUES ('BUSINESS'), ('PREMIUM_ECONOMY')) c(cabin_type)
        JOIN (VALUES ('J'), ('P')) b(booking_fare_class)
          ON booking_fare_class = 'J' OR s_suppkey % 4 = 0
        JOIN (VALUES (0, 'E1', 0, FALSE, 1), (1, 'E2', 5, FALSE, 10), (1, 'E1', 0, TRUE, 17))
          x(seq, equip, more, swap, every) ON s_suppkey % x.every = 0""",
    "flights_dep": """
        SELECT *, quarter + to_days((s_suppkey % 28)::INTEGER)
                  + to_hours((6 + s_suppkey % 16)::INTEGER) + to_minutes(30) AS departure_local_date_time,
               ((s_suppkey % 5 - 2) * 60)::INTEGER AS utc_diff
        FROM flights_base""",
    "flights_utc": """
        SELECT *, departure_local_date_time - to_minutes(utc_diff) AS departure_date_utc
        FROM flights_dep""",
    "flights": f"""
        SELECT 'K' || (s_suppkey % 5) AS carrier_code, s_suppkey::VARCHAR AS flight_number,
               (CASE WHEN swap THEN 1 - s_suppkey % 2 ELSE s_suppkey % 2 END)::INTEGER AS partner_id,
               departure_date_utc, departure_local_date_time, utc_diff, cabin_type, origination,
               'HUB' AS destination, booking_fare_class, equip,
               {", ".join(f"{_event(h)} AS event_date_{h}h" for h in H)},
               {", ".join(f"{_event(h)} + to_minutes(5) AS update_time_{h}h" for h in H)},
               {_each('''((s_suppkey * 7 + {n} + quarter(quarter) * 3
                  + CASE WHEN cabin_type = 'BUSINESS' THEN 11 ELSE 0 END
                  + CASE WHEN booking_fare_class = 'P' AND s_suppkey % 8 = 0 THEN 1 ELSE 0 END) % 45
                  - 3 + more)::INTEGER AS available_count_{h}h''')},
               seq::BIGINT AS ingest_seq
        FROM flights_utc""",
    "flights_typed": """
        SELECT *, date_trunc('month', departure_date_utc)::TIMESTAMP AS travel_year_month,
               departure_date_utc::DATE::TIMESTAMP AS travel_date_utc,
               departure_local_date_time::DATE::TIMESTAMP AS travel_date_local
        FROM flights""",
    "flights_dedup": f"""
        SELECT * EXCLUDE (equip) FROM flights_typed
        QUALIFY row_number() OVER (
            PARTITION BY {", ".join(S.FLIGHT_DEDUP_KEY)} ORDER BY ingest_seq) = 1""",
    "offers_dep": """
        SELECT *, date_trunc('quarter', l_shipdate)::TIMESTAMP + to_days((l_suppkey % 28)::INTEGER) AS day
        FROM lineitem JOIN orders ON l_orderkey = o_orderkey""",
    "offers_base": """
        SELECT *, day + to_hours((6 + l_suppkey % 16)::INTEGER) + to_minutes(30) AS dep,
               CASE o_orderstatus WHEN 'F' THEN 'TICKETED' WHEN 'O' THEN 'EXPIRED' ELSE 'CANCELLED' END
                   AS offer_status
        FROM offers_dep""",
    "offers": """
        SELECT l_orderkey * 8 + l_linenumber AS id, (l_suppkey % 2)::INTEGER AS partner_id,
               'C' || l_orderkey AS conf_num, offer_status,
               'K' || (l_suppkey % 5) AS operating_carrier, l_suppkey::VARCHAR AS operating_flight_num,
               strftime(day, '%Y-%m-%d') AS travel_dt,
               lpad((6 + l_suppkey % 16)::VARCHAR, 2, '0') || ':30' AS dep_tm,
               CASE l_linestatus WHEN 'O' THEN 'ECONOMY' ELSE 'REGIONAL_PREMIUM_ECONOMY' END AS from_cabin,
               CASE l_returnflag WHEN 'A' THEN 'BUSINESS' WHEN 'N' THEN 'REGIONAL_BUSINESS'
                   ELSE 'PREMIUM_ECONOMY' END AS upgrade_type,
               l_linenumber::INTEGER AS item_count,
               substr('YBMHQKL', l_linenumber::INTEGER, 1) AS fare_class,
               l_extendedprice / 50 AS base_amount,
               CASE l_suppkey % 3 WHEN 0 THEN 1.0::DOUBLE WHEN 1 THEN 1.1::DOUBLE ELSE 1.2::DOUBLE END
                   AS inverse_rate,
               dep - to_hours((l_quantity * 17 - 20)::INTEGER) - to_minutes(l_linenumber::INTEGER) AS created,
               CASE WHEN offer_status = 'TICKETED' THEN
                   dep - to_hours(round(l_tax * 100)::INTEGER * 9) - to_minutes(l_linenumber::INTEGER * 3) END
                   AS upgrade_timestamp,
               dep - to_minutes(CASE WHEN l_suppkey % 2 = 0 THEN 30 ELSE 120 END) AS expiration_timestamp,
               CASE WHEN round(l_discount * 100) = 10 THEN 1 ELSE 0 END AS instant_upgrade,
               CASE WHEN l_linenumber <> 7 THEN 1 + l_discount END AS multiplier_fare_class,
               CASE WHEN l_quantity <= 45 THEN 1 + l_tax END AS multiplier_loyalty,
               CASE WHEN o_orderpriority <> '5-LOW' THEN 1.1::DOUBLE END AS multiplier_success_history,
               CASE WHEN l_linestatus = 'O' THEN 1.05::DOUBLE END AS multiplier_payment_type
        FROM offers_base""",
    "offers_typed": """
        SELECT * RENAME (operating_carrier AS carrier_code, operating_flight_num AS flight_number),
               travel_dt::TIMESTAMP AS travel_date,
               year(travel_dt::TIMESTAMP)::INTEGER AS travel_year,
               month(travel_dt::TIMESTAMP)::INTEGER AS travel_month,
               (isodow(travel_dt::TIMESTAMP) - 1)::INTEGER AS travel_dow
        FROM offers WHERE offer_status IN ('TICKETED', 'EXPIRED')""",
    "plain": """
        SELECT * REPLACE (
            regexp_replace(from_cabin, '^REGIONAL_', '') AS from_cabin,
            regexp_replace(upgrade_type, '^REGIONAL_', '') AS upgrade_type)
        FROM offers_typed""",
    "joined": """
        SELECT o.* REPLACE (
                   CASE o.from_cabin WHEN 'PREMIUM_ECONOMY' THEN 'P-ECON' WHEN 'ECONOMY' THEN 'ECON'
                       WHEN 'BUSINESS' THEN 'BUS' ELSE o.from_cabin END AS from_cabin,
                   CASE o.upgrade_type WHEN 'PREMIUM_ECONOMY' THEN 'P-ECON' WHEN 'ECONOMY' THEN 'ECON'
                       WHEN 'BUSINESS' THEN 'BUS' ELSE o.upgrade_type END AS upgrade_type),
               f.* EXCLUDE (carrier_code, flight_number, partner_id, ingest_seq)
        FROM plain o JOIN flights_dedup f
          ON o.carrier_code = f.carrier_code AND o.flight_number = f.flight_number
         AND o.partner_id = f.partner_id AND o.travel_date = f.travel_date_local
         AND o.upgrade_type = f.cabin_type
        WHERE o.instant_upgrade = 0""",
    "timed": f"""
        SELECT *, coalesce(upgrade_timestamp, expiration_timestamp) AS decision_timestamp,
               (travel_dt || ' ' || dep_tm || ':00')::TIMESTAMP AS departure_timestamp,
               {_each('''event_date_{h}h + (departure_local_date_time - departure_date_utc)
                   AS event_local_date_{h}h''')},
               {_each('''update_time_{h}h + (departure_local_date_time - departure_date_utc)
                   AS update_local_time_{h}h''')}
        FROM joined""",
    "enriched": f"""
        SELECT *, departure_timestamp - to_minutes(utc_diff) AS departure_timestamp_utc,
               (epoch_us(departure_timestamp) - epoch_us(created)) / 86400000000.0::DOUBLE AS offer_time,
               round_even(base_amount * inverse_rate * 100.0::DOUBLE, 0) / 100.0::DOUBLE AS usd_base_amount,
               CASE
               {" ".join(
                   f"WHEN decision_timestamp <= event_local_date_{near}h "
                   f"AND decision_timestamp > event_local_date_{far}h THEN available_count_{far}h"
                   for near, far in zip(H, H[1:]))}
               WHEN decision_timestamp <= event_local_date_72h THEN available_count_72h END
                   AS seats_available
        FROM timed""",
    "snapshot_input": f"SELECT {_names(S.SNAPSHOT_INPUT)}, seats_available FROM enriched",
    "distinct_input": """
        SELECT DISTINCT * FROM snapshot_input WHERE travel_date >= TIMESTAMP '1995-01-01'""",
    "uniq": """
        SELECT * FROM distinct_input WHERE id NOT IN (
            SELECT id FROM distinct_input GROUP BY id HAVING count(*) > 1)""",
    "moments": f"""
        SELECT DISTINCT {KEY}, kind, ts FROM (
            SELECT {KEY}, 'decision_timestamp' AS kind, decision_timestamp AS ts FROM uniq
            UNION ALL SELECT {KEY}, 'created', created FROM uniq
            {" ".join(f"UNION ALL SELECT {KEY}, 'event_local_date_{h}h', event_local_date_{h}h FROM uniq"
                      for h in H)})
        WHERE ts IS NOT NULL""",
    "bounds": f"""
        SELECT {KEY}, min(ts) FILTER (kind <> 'created') AS start_ts,
               max(ts) FILTER (kind = 'decision_timestamp') AS end_ts
        FROM moments GROUP BY {KEY} HAVING end_ts IS NOT NULL""",
    "timeline": f"""
        SELECT m.* FROM moments m JOIN bounds b USING ({KEY}) WHERE ts BETWEEN start_ts AND end_ts
        UNION ALL SELECT {KEY}, 'start_time', start_ts - to_days(2) FROM bounds""",
    "instants": f"""
        SELECT {KEY}, instant_num, make_timestamp(epoch_us(ts) + (epoch_us(nxt) - epoch_us(ts)) // 2)
                   AS "current_timestamp"
        FROM (SELECT {KEY}, ts,
                     lead(ts) OVER w AS nxt, (row_number() OVER w)::INTEGER AS instant_num
              FROM timeline WINDOW w AS (PARTITION BY {KEY} ORDER BY ts, kind))
        WHERE nxt IS NOT NULL""",
    "alive": f"""
        SELECT u.*, i.instant_num, i."current_timestamp"
        FROM uniq u JOIN instants i USING ({KEY})
        WHERE created <= i."current_timestamp" AND i."current_timestamp" < decision_timestamp""",
    "seated": f"""
        SELECT *, CASE reading {" ".join(f"WHEN '{h}' THEN available_count_{h}h" for h in H)} END
                   AS current_available_seats,
               'available_count_' || reading || 'h' AS current_seats_col
        FROM (SELECT *, CASE
                  WHEN "current_timestamp" < event_local_date_72h THEN '72'
                  {" ".join(f'''WHEN "current_timestamp" < event_local_date_{near}h THEN '{far}' '''
                            for far, near in zip(SCAN, SCAN[1:]))}
                  ELSE '72' END AS reading FROM alive)""",
    "states": f"""
        SELECT {KEY}, instant_num, list((id, current_seats_col) ORDER BY id) AS state
        FROM seated GROUP BY {KEY}, instant_num""",
    "kept": f"""
        SELECT {KEY}, instant_num,
               (row_number() OVER (PARTITION BY {KEY} ORDER BY instant_num))::INTEGER AS snapshot_num
        FROM (SELECT *, lag(state) OVER (PARTITION BY {KEY} ORDER BY instant_num) AS before FROM states)
        WHERE state IS DISTINCT FROM before""",
    "snapshots": f"""
        SELECT {_names(S.SNAPSHOT_OUTPUT)} FROM seated JOIN kept USING ({KEY}, instant_num)""",
    "stats": f"""
        SELECT u.*, g.num_offers, g.usd_base_amount_max
        FROM uniq u JOIN (SELECT {KEY}, count(*)::INTEGER AS num_offers,
                                 max(usd_base_amount) AS usd_base_amount_max
                          FROM uniq GROUP BY {KEY}) g USING ({KEY})""",
    "loo_lists": f"""
        SELECT {KEY}, list((id, usd_base_amount)) AS pairs FROM uniq GROUP BY {KEY}""",
    "loo": f"""
        SELECT {KEY}, id, {_quantile(0.25, "usd_base_amount_25%")},
               {_quantile(0.5, "usd_base_amount_50%")}, {_quantile(0.75, "usd_base_amount_75%")}
        FROM (SELECT {KEY}, p[1] AS id,
                     list_sort([x[2] FOR x IN pairs IF x[1] <> p[1]]) AS others
              FROM (SELECT {KEY}, pairs, unnest(pairs) AS p FROM loo_lists))""",
    "binned": f"""
        SELECT *, CASE
               WHEN usd_base_amount <= 100 THEN '<100'
               WHEN usd_base_amount <= 200 THEN '100-200'
               WHEN usd_base_amount <= 300 THEN '200-300'
               WHEN usd_base_amount <= 400 THEN '300-400'
               WHEN usd_base_amount <= 500 THEN '400-500'
               WHEN usd_base_amount <= 600 THEN '500-600'
               WHEN usd_base_amount <= 700 THEN '600-700'
               WHEN usd_base_amount <= 800 THEN '700-800'
               WHEN usd_base_amount <= 900 THEN '800-900'
               WHEN usd_base_amount <= 1000 THEN '900-1000'
               WHEN usd_base_amount <= 1100 THEN '1000-1100'
               WHEN usd_base_amount <= 1200 THEN '1100-1200'
               WHEN usd_base_amount <= 1300 THEN '1200-1300'
               WHEN usd_base_amount <= 1400 THEN '1300-1400'
               WHEN usd_base_amount <= 1500 THEN '1400-1500'
               WHEN usd_base_amount <= 1600 THEN '1500-1600'
               WHEN usd_base_amount <= 1700 THEN '1600-1700'
               WHEN usd_base_amount IS NOT NULL THEN '>1700' END AS usd_base_amount_grp,
               (CASE WHEN offer_time <= 0 THEN NULL WHEN offer_time > 30 THEN 31
                     ELSE ceil(offer_time) END)::INTEGER AS offer_time_grp,
               (CASE WHEN item_count <= 4 THEN item_count ELSE 5 END)::INTEGER AS item_count_grp,
               (CASE WHEN num_offers <= 15 THEN num_offers ELSE 16 END)::INTEGER AS num_offers_grp,
               (CASE WHEN seats_available IS NULL THEN -2
                     ELSE greatest(-1, least(30, seats_available)) END)::INTEGER AS seats_available_grp
        FROM stats""",
    "scored": """
        SELECT id, label, 0.8::DOUBLE * ((id * 7919) % 997)::DOUBLE / 997.0::DOUBLE
                          + 0.2::DOUBLE * label::DOUBLE AS score
        FROM (SELECT id, (CASE WHEN offer_status = 'TICKETED' THEN 1 ELSE 0 END)::INTEGER AS label
              FROM uniq)""",
    "guessed": "SELECT *, (score >= 0.5)::INTEGER AS prediction FROM scored",
    "cells": """
        SELECT l.label, p.prediction, count(g.id) AS n_rows
        FROM (VALUES (0), (1)) l(label) CROSS JOIN (VALUES (0), (1)) p(prediction)
        LEFT JOIN guessed g ON g.label = l.label AND g.prediction = p.prediction
        GROUP BY ALL""",
    "runs": """
        SELECT score, sum(label)::BIGINT AS hits, sum(1 - label)::BIGINT AS misses FROM scored GROUP BY score""",
    "totals": """
        SELECT *, (sum(hits) OVER w)::BIGINT AS tp, (sum(misses) OVER w)::BIGINT AS fp,
               (sum(hits) OVER ())::BIGINT AS p, (sum(misses) OVER ())::BIGINT AS n,
               row_number() OVER w AS rn
        FROM runs WINDOW w AS (ORDER BY score DESC)""",
}
_ORDER = list(CTES)


def _with(last: str, query: str) -> str:
    used = _ORDER[: _ORDER.index(last) + 1]
    body = ",\n".join(f"{name} AS ({CTES[name]})" for name in used)
    return f"WITH {body}\n{query}"


def _with_other(name: str, body: str, last: str, query: str) -> str:
    """As ``_with``, from another table under the same name."""
    used = _ORDER[: _ORDER.index(last) + 1]
    bodies = {each: CTES[each] for each in used} | {name: body}
    return "WITH " + ",\n".join(f"{each} AS ({text})" for each, text in bodies.items()) + f"\n{query}"


def _rows(cte: str, columns=None) -> str:
    return _with(cte, f"SELECT {_names(columns) if columns else '*'} FROM {cte}")


def _input(name: str) -> str:
    """A model input: text for categories, days for the date, a low number for what is missing."""
    plain = "f_" + name.replace("%", "pct")
    if name in S.CATEGORICAL_FEATURES:
        return f'"{name}"::VARCHAR AS {plain}'
    if name == "travel_date":
        return f"(travel_date::DATE - DATE '1970-01-01')::DOUBLE AS {plain}"
    missing = "1.0" if name in S.MULTIPLIERS else "-1000000000000.0"
    return f'coalesce("{name}"::DOUBLE, {missing}::DOUBLE) AS {plain}'


def _cabins(column: str) -> str:
    return (f"CASE {column} WHEN 'PREMIUM_ECONOMY' THEN 'P-ECON' WHEN 'ECONOMY' THEN 'ECON' "
            f"WHEN 'BUSINESS' THEN 'BUS' ELSE {column} END AS {column}")


ENRICHED_COLUMNS = [
    "id", "partner_id", "conf_num", "offer_status", "carrier_code", "flight_number",
    "travel_dt", "dep_tm", "travel_date", "travel_year", "travel_month", "travel_dow",
    "from_cabin", "upgrade_type", "cabin_type", "item_count", "fare_class", "base_amount",
    "inverse_rate", "created", "upgrade_timestamp", "expiration_timestamp", "instant_upgrade",
    *S.MULTIPLIERS, "departure_date_utc", "departure_local_date_time", "utc_diff",
    "origination", "destination", "booking_fare_class", *S.per_horizon("event_date"),
    *S.per_horizon("update_time"), *S.COUNTS, "travel_year_month", "travel_date_utc",
    "travel_date_local", "decision_timestamp", "departure_timestamp",
    "departure_timestamp_utc", *S.EVENT_LOCAL, *S.per_horizon("update_local_time"),
    "offer_time", "usd_base_amount", "seats_available",
]
ALIVE_COLUMNS = ["id", *S.AUCTION_KEY, "instant_num", "current_timestamp"]
QUANTILE_COLUMNS = ["usd_base_amount_25%", "usd_base_amount_50%", "usd_base_amount_75%"]
_RATES = "fp::DOUBLE / n AS fpr, tp::DOUBLE / p AS tpr, score AS threshold"

ORACLES = {
    "flights_typed": _rows("flights_typed"),
    "flights_dedup": _rows("flights_dedup"),
    "offers_typed": _rows("offers_typed", [
        "id", "carrier_code", "flight_number", "offer_status", "travel_dt", "travel_date",
        "travel_year", "travel_month", "travel_dow"]),
    "cabin_recode": _with("plain", f"""
        SELECT id, {_cabins("from_cabin")}, {_cabins("upgrade_type")} FROM plain"""),
    "offers_enriched": _rows("enriched", ENRICHED_COLUMNS),
    "offers_with_few_flights": _with("plain", """
        SELECT o.id, o.flight_number, o.travel_date, f.booking_fare_class, f.origination
        FROM plain o JOIN flights_dedup f
          ON o.carrier_code = f.carrier_code AND o.flight_number = f.flight_number
         AND o.partner_id = f.partner_id AND o.travel_date = f.travel_date_local
         AND o.upgrade_type = f.cabin_type
        WHERE f.flight_number::INTEGER % 3 = 0"""),
    "local_event_times": _rows("enriched", ["id", *S.EVENT_LOCAL, *S.per_horizon("update_local_time")]),
    "seats_at_decision": _rows("enriched", ["id", "decision_timestamp", "seats_available"]),
    "exact_dedup": _with("snapshot_input", f"SELECT DISTINCT {_names(S.SNAPSHOT_INPUT)} FROM snapshot_input"),
    "unique_ids": _rows("uniq", S.SNAPSHOT_INPUT),
    "unique_ids_as_read": _with("snapshot_input", f"""
        SELECT {_names(S.SNAPSHOT_INPUT)} FROM snapshot_input
        WHERE travel_date >= TIMESTAMP '1995-01-01'
        QUALIFY count(*) OVER (PARTITION BY id) = 1"""),
    "repeated_ids": _with("snapshot_input", """
        SELECT id, count(*) AS n FROM snapshot_input GROUP BY id HAVING count(*) > 1"""),
    "date_floor": _with("enriched", """
        SELECT id, travel_date, booking_fare_class FROM enriched
        WHERE travel_date >= TIMESTAMP '2000-01-01'"""),
    "auction_bounds": _rows("bounds"),
    "schedule_conflicts": _with("uniq", f"""
        SELECT travel_date, count(*) AS n_schedules
        FROM (SELECT DISTINCT travel_date, {_names(S.EVENT_LOCAL)} FROM uniq)
        GROUP BY ALL HAVING count(*) > 1"""),
    "auction_timeline": _rows("timeline"),
    "snapshot_instants": _rows("instants"),
    "alive_offers": _rows("alive", ALIVE_COLUMNS),
    "seats_at_instant": _rows("seated", [*ALIVE_COLUMNS, "current_available_seats", "current_seats_col"]),
    "auction_snapshots": _rows("snapshots"),
    "snapshots_after_update": _with_other("snapshot_input", f"""
        WITH before AS ({CTES["snapshot_input"]}),
        marked AS (SELECT *, date_trunc('month', travel_date) = DATE '1998-03-01' AS here FROM before)
        SELECT * EXCLUDE (here) REPLACE (CASE WHEN here AND id % 3 = 0 THEN usd_base_amount + 1
                                         ELSE usd_base_amount END AS usd_base_amount)
        FROM marked WHERE NOT (here AND id % 7 = 0)
        UNION ALL SELECT * EXCLUDE (here) REPLACE (item_count + 1 AS item_count) FROM marked WHERE here AND id % 11 = 0""",
        "snapshots", f"SELECT {_names(S.SNAPSHOT_OUTPUT)} FROM snapshots"),
    "coercion_report": _with("offers", """
        SELECT 'item_count' AS "column", count(*) AS made_null FROM offers WHERE id % 13 = 0
        UNION ALL SELECT 'partner_id', count(*) FROM offers WHERE id % 23 = 0 AND TRY_CAST('1.5' AS DOUBLE) % 1 <> 0
        UNION ALL SELECT 'created', count(*) FROM offers WHERE id % 17 = 0 AND TRY_CAST('never' AS TIMESTAMP) IS NULL
        UNION ALL SELECT 'base_amount', count(*) FROM offers WHERE id % 19 = 0 AND TRY_CAST('n/a' AS DOUBLE) IS NULL"""),
    "coerced_rows": _with("offers", """
        SELECT id, CASE WHEN id % 13 = 0 THEN 'many' ELSE item_count::VARCHAR END AS item_count,
               concat_ws(' ', CASE WHEN id % 23 = 0 THEN 'partner_id' END, CASE WHEN id % 13 = 0 THEN 'item_count' END,
                         CASE WHEN id % 19 = 0 THEN 'base_amount' END, CASE WHEN id % 17 = 0 THEN 'created' END) AS made_null
        FROM offers WHERE id % 13 = 0 OR id % 17 = 0 OR id % 19 = 0 OR id % 23 = 0"""),
    "flights_from_csv": _rows("flights", S.FLIGHTS.fieldNames()),
    "offers_from_csv": _rows("offers", S.OFFERS.fieldNames()),
    "enrich_job": _rows("enriched", S.SNAPSHOT_INPUT),
    "training_input": _with("uniq", f"""
        SELECT {_names(S.TRAINING_INPUT)}, offer_status FROM uniq"""),
    "absent_availability": _with("enriched", f"""
        SELECT {_names(name for name in S.SNAPSHOT_INPUT if not name.endswith("_48h"))},
               NULL::TIMESTAMP AS event_local_date_48h, NULL::INTEGER AS available_count_48h FROM enriched"""),
    "dotted_and_cast": _rows("offers", ["id", "item_count", "fare_class"]),
    "snapshots_job": _rows("snapshots"),
    "snapshots_csv_job": _rows("snapshots"),
    "snapshot_months": _with("snapshots", """
        SELECT date_trunc('month', travel_date)::DATE AS travel_month_start, count(*) AS n_rows FROM snapshots GROUP BY 1"""),
    "numbered_rows": """
        SELECT s_suppkey, s_name, row_number() OVER (ORDER BY s_suppkey) - 1 AS row_no FROM supplier""",
    "group_stats": _rows("stats", ["id", *S.AUCTION_KEY, "num_offers", "usd_base_amount_max"]),
    "amount_bins": _rows("binned", ["id", "usd_base_amount", "usd_base_amount_grp"]),
    "offer_time_bins": _rows("binned", ["id", "offer_time", "offer_time_grp"]),
    "capped_counts": _rows("binned", ["id", "item_count_grp", "num_offers_grp"]),
    "seats_bins": _rows("binned", ["id", "seats_available_grp"]),
    "loo_quantiles": _rows("loo", ["id", *S.AUCTION_KEY, *QUANTILE_COLUMNS]),
    "model_features": _with("binned", f"""
        SELECT id, {_names(S.MODEL_FEATURES)} FROM binned JOIN loo USING ({KEY}, id)"""),
    "model_inputs": _with("binned", f"""
        SELECT id, {", ".join(_input(name) for name in S.MODEL_FEATURES)} FROM binned JOIN loo USING ({KEY}, id)"""),
    "multiplier_defaults": _with("uniq", f"""
        SELECT id, {", ".join(f"coalesce({name}, 1.0::DOUBLE) AS {name}" for name in S.MULTIPLIERS)}
        FROM uniq"""),
    "split_summary": _with("uniq", f"""
        SELECT CASE WHEN travel_date < TIMESTAMP '2000-01-01' THEN 'train' ELSE 'test' END AS split,
               count(*) AS n_rows, count(*) FILTER (offer_status = 'TICKETED') AS n_ticketed,
               {len(S.MODEL_FEATURES)}::INTEGER AS n_features,
               {len(S.CATEGORICAL_FEATURES)}::INTEGER AS n_categorical
        FROM uniq GROUP BY 1"""),
    "class_weights": _with("scored", """
        SELECT label, count(*) AS n_rows, max(count(*)) OVER ()::DOUBLE / count(*) AS class_weight
        FROM scored GROUP BY label"""),
    "threshold_metrics": _with("guessed", """
        SELECT tp, fp, fn, tn, tp / (tp + fp) AS precision, tp / (tp + fn) AS recall,
               (tp + tn) / (tp + fp + fn + tn) AS accuracy
        FROM (SELECT count(*) FILTER (label = 1 AND prediction = 1) AS tp,
                     count(*) FILTER (label = 0 AND prediction = 1) AS fp,
                     count(*) FILTER (label = 1 AND prediction = 0) AS fn,
                     count(*) FILTER (label = 0 AND prediction = 0) AS tn FROM guessed)"""),
    "confusion": _rows("cells"),
    "confusion_normalised": _with("cells", """
        SELECT label, prediction, n_rows / sum(n_rows) OVER (PARTITION BY label) AS share FROM cells"""),
    "roc_points": _with("totals", f"""
        SELECT {_RATES} FROM (
            SELECT *, lag(tp) OVER w AS tp0, lead(tp) OVER w AS tp2,
                   lag(fp) OVER w AS fp0, lead(fp) OVER w AS fp2
            FROM totals WINDOW w AS (ORDER BY rn))
        WHERE tp0 IS NULL OR tp2 IS NULL OR tp2 - 2 * tp + tp0 <> 0 OR fp2 - 2 * fp + fp0 <> 0
        UNION ALL SELECT 0.0::DOUBLE, 0.0::DOUBLE, 'inf'::DOUBLE"""),
    "roc_auc": _with("scored", """
        SELECT sum(CASE WHEN a.score > b.score THEN 2 WHEN a.score = b.score THEN 1 ELSE 0 END
                   * a.c * b.c)::DOUBLE / (2.0::DOUBLE * sum(a.c * b.c)::DOUBLE) AS roc_auc
        FROM (SELECT score, count(*) AS c FROM scored WHERE label = 1 GROUP BY score) a
        CROSS JOIN (SELECT score, count(*) AS c FROM scored WHERE label = 0 GROUP BY score) b"""),
    "ordered_target_rates": _with("uniq", """
        SELECT id, flight_number, (coalesce(sum(label) OVER w, 0) + 0.5::DOUBLE) / (count(*) OVER w + 1.0::DOUBLE)
                   AS flight_number_rate
        FROM (SELECT id, flight_number, (offer_status = 'TICKETED')::INTEGER AS label FROM uniq)
        WINDOW w AS (PARTITION BY flight_number ORDER BY md5(id::VARCHAR)
                     ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"""),
    "target_rates": _with("uniq", """
        SELECT flight_number AS category, count(*) AS n_rows, count(*) FILTER (offer_status = 'TICKETED') AS n_hits,
               (count(*) FILTER (offer_status = 'TICKETED') + 0.5::DOUBLE) / (count(*) + 1.0::DOUBLE) AS rate
        FROM uniq WHERE travel_date < TIMESTAMP '2000-01-01' GROUP BY flight_number"""),
    "auc_per_score": _with("scored", """
        , many AS (
            SELECT k::INTEGER AS iteration, label, ((id * 7919 + k * 31) % (97 * k))::DOUBLE / (97.0::DOUBLE * k)
                       + (0.1::DOUBLE * k) * label AS score
            FROM scored CROSS JOIN generate_series(1, 6) g(k)),
        counted AS (
            SELECT iteration, score, sum(label) AS hits, sum(1 - label) AS misses FROM many GROUP BY ALL)
        SELECT iteration, sum(misses * (2 * above + hits))::DOUBLE
                   / (2.0::DOUBLE * sum(hits)::DOUBLE * sum(misses)::DOUBLE) AS roc_auc
        FROM (SELECT *, sum(hits) OVER (PARTITION BY iteration ORDER BY score DESC) - hits AS above FROM counted)
        GROUP BY iteration"""),
    "gbt_prefix_agreement": _with("uniq", """
        SELECT count(*) AS n_rows, 0::BIGINT AS n_different FROM uniq WHERE travel_date >= TIMESTAMP '2000-01-01'"""),
    "gbt_saved_model_agreement": _with("uniq", """
        SELECT count(*) AS n_rows, 0::BIGINT AS n_different FROM uniq"""),
    "committed_runs": _with("uniq", f"""
        SELECT {len(S.MODEL_FEATURES)}::BIGINT AS n_features,
               count(*) FILTER (travel_date < TIMESTAMP '2000-01-01') AS train_rows,
               count(*) FILTER (travel_date >= TIMESTAMP '2000-01-01') AS test_rows,
               8::BIGINT AS iterations, 4::BIGINT AS depth,
               count(*) FILTER (travel_date >= TIMESTAMP '2000-01-01') AS n_scored, TRUE AS best_is_an_iteration
        FROM uniq"""),
    "pr_points": _with("totals", """
        SELECT tp::DOUBLE / (tp + fp) AS precision, tp::DOUBLE / p AS recall, score AS threshold
        FROM totals UNION ALL SELECT 1.0::DOUBLE, 0.0::DOUBLE, NULL"""),
    "average_precision": _with("totals", """
        SELECT round(sum(hits::DOUBLE / p * (tp::DOUBLE / (tp + fp))), 9) AS average_precision FROM totals"""),
    "run_summary": _with("uniq", f"""
        SELECT {len(S.MODEL_FEATURES)}::INTEGER AS n_features,
               '{",".join(S.MODEL_FEATURES)}' AS features,
               '{",".join(S.CATEGORICAL_FEATURES)}' AS categorical_features,
               count(*) FILTER (travel_date < TIMESTAMP '2000-01-01') AS train_rows,
               count(*) FILTER (travel_date >= TIMESTAMP '2000-01-01') AS test_rows,
               'AUC' AS eval_metric, 8::INTEGER AS iterations, 4::INTEGER AS depth,
               0.1::DOUBLE AS learning_rate, 128::INTEGER AS max_bins, 42::INTEGER AS seed,
               'flight_number' AS target_encoded
        FROM uniq"""),
    "score_histogram": _with("scored", """
        , spans AS (SELECT label, min(score) AS lo, max(score) AS hi FROM scored GROUP BY label),
        edges AS (SELECT label, b::INTEGER AS bin, b * ((hi - lo) / 100) + lo AS bin_from,
                         CASE WHEN b = 99 THEN hi ELSE (b + 1) * ((hi - lo) / 100) + lo END AS bin_to
                  FROM spans CROSS JOIN generate_series(0, 99) g(b))
        SELECT e.label, bin, bin_from, bin_to, count(s.id) AS n_rows
        FROM edges e LEFT JOIN scored s ON s.label = e.label AND s.score >= bin_from
             AND (s.score < bin_to OR (bin = 99 AND s.score = bin_to))
        GROUP BY ALL"""),
}
