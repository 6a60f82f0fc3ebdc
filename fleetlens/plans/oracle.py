"""The chain's tables once more as DuckDB SQL: named parts that sql() strings together as needed."""

from __future__ import annotations

import re

PARTS: dict[str, str] = {
    "trips_raw": """SELECT event_id::VARCHAR AS ride_id, ts AS started_at, ts + to_seconds(floor(value * 10)::BIGINT) AS ended_at, user_id AS start_station_id,
        (user_id + json_extract_string(props, '$.k')::BIGINT) % (SELECT max(user_id) + 1 FROM events) AS end_station_id, event_type AS rideable_type,
        CASE WHEN user_id % 2 = 0 THEN 'member' ELSE 'casual' END AS member_casual FROM events""",
    "trips": """SELECT *, ((extract(isodow FROM started_at) - 1) * 24 + extract(hour FROM started_at))::INTEGER AS how FROM trips_raw
        WHERE date_diff('second', started_at, ended_at) >= 60 AND NOT (start_station_id = end_station_id AND date_diff('second', started_at, ended_at) < 120)""",
    "stations": """SELECT id AS station_id, CASE WHEN id % 23 = 0 THEN NULL WHEN id % 29 = 0 THEN 0 ELSE 2 + id % 5 END::INTEGER AS capacity,
        40.70::DOUBLE + 0.002::DOUBLE * (id // 12) AS lat, -74.00::DOUBLE + 0.002::DOUBLE * (id % 12) AS lng, 'z' || (id // 6)::VARCHAR AS zone_agg
        FROM (SELECT DISTINCT user_id AS id FROM events)""",
    "weather": """SELECT t AS timestamp, (10 + h % 7)::DOUBLE AS temp_c, CASE WHEN h % 11 = 0 THEN 1.5::DOUBLE ELSE 0.0::DOUBLE END AS precip_mm, (5 + h % 9)::DOUBLE AS wind_kph, (40 + h % 50)::DOUBLE AS humidity_pct
        FROM (SELECT t, date_diff('hour', TIMESTAMP '2024-01-01', t) AS h FROM (SELECT unnest(generate_series(date_trunc('hour', min(ts)), date_trunc('hour', max(ts)), INTERVAL 1 HOUR)) AS t FROM events))""",
    "obs": """SELECT station_id, t AS interval_start, sum(d)::BIGINT AS departures, sum(a)::BIGINT AS arrivals FROM (
        SELECT start_station_id AS station_id, time_bucket(INTERVAL 15 MINUTES, started_at) AS t, 1 AS d, 0 AS a FROM trips
        UNION ALL SELECT end_station_id, time_bucket(INTERVAL 15 MINUTES, ended_at), 0, 1 FROM trips) GROUP BY ALL""",
    "bounds": "SELECT station_id, min(interval_start) AS first_interval, max(interval_start) AS last_interval FROM obs GROUP BY station_id",
    "grid": "SELECT station_id, unnest(generate_series(first_interval, last_interval, INTERVAL 15 MINUTES)) AS interval_start FROM bounds",
    "panel": """SELECT g.station_id, g.interval_start, coalesce(o.departures, 0) AS departures, coalesce(o.arrivals, 0) AS arrivals, s.capacity, s.zone_agg,
        ((extract(isodow FROM g.interval_start) - 1) * 24 + extract(hour FROM g.interval_start))::INTEGER AS hour_of_week
        FROM grid g LEFT JOIN obs o ON g.station_id = o.station_id AND g.interval_start = o.interval_start LEFT JOIN stations s ON g.station_id = s.station_id""",
    "usable": """SELECT *, arrivals - departures AS net_flow, date_trunc('week', interval_start)::TIMESTAMP AS week_start FROM panel WHERE capacity IS NOT NULL
        AND station_id NOT IN (SELECT station_id FROM panel WHERE capacity = 0 AND departures + arrivals > 0)""",
    "nz": "SELECT station_id, interval_start, capacity::DOUBLE AS capacity, net_flow::DOUBLE AS f, row_number() OVER (PARTITION BY station_id ORDER BY interval_start) AS rn FROM usable WHERE net_flow <> 0",
    "walk": """SELECT station_id, rn, interval_start, capacity, f, 0.5::DOUBLE * capacity AS b, greatest(0.0::DOUBLE, least(capacity, 0.5::DOUBLE * capacity + f)) AS e FROM nz WHERE rn = 1
        UNION ALL SELECT n.station_id, n.rn, n.interval_start, n.capacity, n.f, w.e, greatest(0.0::DOUBLE, least(n.capacity, w.e + n.f)) FROM walk w JOIN nz n ON n.station_id = w.station_id AND n.rn = w.rn + 1""",
    "inv0": """SELECT u.*, coalesce(last_value(w.e IGNORE NULLS) OVER (PARTITION BY u.station_id ORDER BY u.interval_start ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.5::DOUBLE * u.capacity) AS inventory,
        greatest(0.0::DOUBLE, coalesce(-(w.b + w.f), 0.0::DOUBLE)) AS nontrip_in, greatest(0.0::DOUBLE, coalesce(w.b + w.f - w.capacity, 0.0::DOUBLE)) AS nontrip_out
        FROM usable u LEFT JOIN walk w ON u.station_id = w.station_id AND u.interval_start = w.interval_start""",
    "inv": "SELECT *, inventory <= 1e-6::DOUBLE AS is_bike_empty, inventory >= capacity - 1e-6::DOUBLE AS is_dock_full FROM inv0",
    "runlens": """SELECT * EXCLUDE (cb, cf, rb, rf), CASE WHEN is_bike_empty THEN count(*) OVER (PARTITION BY station_id, rb) ELSE 0 END AS dep_len, CASE WHEN is_dock_full THEN count(*) OVER (PARTITION BY station_id, rf) ELSE 0 END AS arr_len FROM (
        SELECT *, sum(cb) OVER (PARTITION BY station_id ORDER BY interval_start ROWS UNBOUNDED PRECEDING) AS rb, sum(cf) OVER (PARTITION BY station_id ORDER BY interval_start ROWS UNBOUNDED PRECEDING) AS rf FROM (
        SELECT *, CASE WHEN is_bike_empty IS DISTINCT FROM lag(is_bike_empty) OVER (PARTITION BY station_id ORDER BY interval_start) THEN 1 ELSE 0 END AS cb,
        CASE WHEN is_dock_full IS DISTINCT FROM lag(is_dock_full) OVER (PARTITION BY station_id ORDER BY interval_start) THEN 1 ELSE 0 END AS cf FROM inv))""",
    "rated": """SELECT *, coalesce(avg(departures) FILTER (WHERE NOT is_bike_empty) OVER (PARTITION BY station_id, hour_of_week),
            CASE WHEN zone_agg IS NOT NULL THEN avg(departures) FILTER (WHERE NOT is_bike_empty) OVER (PARTITION BY zone_agg, hour_of_week) END, (SELECT avg(departures) FROM inv WHERE NOT is_bike_empty)) AS dep_d,
        coalesce(avg(arrivals) FILTER (WHERE NOT is_dock_full) OVER (PARTITION BY station_id, hour_of_week),
            CASE WHEN zone_agg IS NOT NULL THEN avg(arrivals) FILTER (WHERE NOT is_dock_full) OVER (PARTITION BY zone_agg, hour_of_week) END, (SELECT avg(arrivals) FROM inv WHERE NOT is_dock_full)) AS arr_d FROM runlens""",
    **{
        name: text
        for d, y, flag in (("dep", "departures", "is_bike_empty"), ("arr", "arrivals", "is_dock_full"))
        for name, text in {
            f"free_{d}": f"SELECT station_id, interval_start, hour_of_week, {y} AS y, {d}_d AS dhat, row_number() OVER (PARTITION BY station_id ORDER BY interval_start) - 1 AS pos FROM rated WHERE NOT {flag} AND interval_start >= TIMESTAMP '2024-01-22'",
            f"per_{d}": f"SELECT station_id, count(*) AS n, list_sort(list(y)) AS ds FROM free_{d} GROUP BY ALL",
            f"caps_{d}": f"SELECT station_id, n, ds[(round_even((n - 1) * 0.1::DOUBLE, 0) + 1)::INTEGER] AS cap, len::INTEGER AS len FROM per_{d}, (SELECT unnest([1, 2, 3, 4, 6, 8, 12]) AS len) WHERE n > len",
            f"pick_{d}": f"SELECT *, ((((0 + 1)::BIGINT * 48271 + len * 16807 + 11) % 2147483647) * 48271 + station_id * 16807 + 11) % 2147483647 AS k, ((((7 + 1)::BIGINT * 48271 + station_id * 16807 + 11) % 2147483647) * 48271 + len * 16807 + 11) % 2147483647 % (n - len + 1) AS s FROM caps_{d}",
            f"chosen_{d}": f"SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY len ORDER BY k, station_id) AS nth FROM pick_{d}) WHERE nth <= 300",
            f"cut_{d}": f"SELECT f.station_id, f.interval_start, f.y AS true_d, least(f.y, c.cap) AS censored_y, c.len, f.dhat, greatest(0.0::DOUBLE, f.dhat - least(f.y, c.cap)) - (f.y - least(f.y, c.cap)) AS err FROM chosen_{d} c JOIN free_{d} f ON f.station_id = c.station_id AND f.pos BETWEEN c.s AND c.s + c.len - 1",
            f"bias_{d}": f"SELECT CASE WHEN len <= 1 THEN 0 WHEN len <= 4 THEN 1 ELSE 2 END::INTEGER AS b, avg(err) AS bias, count(*) AS n FROM cut_{d} GROUP BY 1 HAVING count(*) >= 20",
        }.items()
    },
    "stale": "SELECT station_id, any_value(capacity) < max(departures + arrivals) AS is_stale FROM rated WHERE interval_start >= TIMESTAMP '2024-01-22' GROUP BY station_id",
    "unmet": """SELECT r.*, CASE WHEN is_bike_empty THEN greatest(0.0::DOUBLE, greatest(0.0::DOUBLE, dep_d - departures) - coalesce(x.bias, 0.0::DOUBLE)) ELSE 0.0::DOUBLE END AS dep_gross,
        CASE WHEN is_dock_full THEN greatest(0.0::DOUBLE, greatest(0.0::DOUBLE, arr_d - arrivals) - coalesce(z.bias, 0.0::DOUBLE)) ELSE 0.0::DOUBLE END AS arr_gross FROM rated r
        LEFT JOIN bias_dep x ON x.b = CASE WHEN dep_len <= 1 THEN 0 WHEN dep_len <= 4 THEN 1 ELSE 2 END LEFT JOIN bias_arr z ON z.b = CASE WHEN arr_len <= 1 THEN 0 WHEN arr_len <= 4 THEN 1 ELSE 2 END""",
    "dist": """SELECT a.station_id, b.station_id AS neighbor_id, 2 * 6371000.0::DOUBLE * asin(sqrt(least(1.0::DOUBLE, power(sin((radians(b.lat) - radians(a.lat)) / 2), 2)
        + cos(radians(a.lat)) * cos(radians(b.lat)) * power(sin((radians(b.lng) - radians(a.lng)) / 2), 2)))) AS distance_m FROM stations a JOIN stations b ON a.station_id <> b.station_id""",
    "pairs": "SELECT * FROM dist WHERE distance_m <= 400",
    **{
        f"sub_{d}": f"""SELECT station_id, interval_start, sum(part) AS got FROM (
            SELECT o.station_id, o.interval_start, coalesce(n.up * o.g / nullif(sum(o.g) OVER (PARTITION BY n.station_id, n.interval_start), 0), 0.0::DOUBLE) AS part
            FROM (SELECT station_id, interval_start, {d}_gross AS g FROM unmet WHERE {flag}) o JOIN pairs p ON o.station_id = p.station_id
            JOIN (SELECT station_id, interval_start, greatest(0.0::DOUBLE, {y} - {d}_d) AS up FROM unmet WHERE NOT {flag} AND {y} > {d}_d) n ON n.station_id = p.neighbor_id AND n.interval_start = o.interval_start) GROUP BY ALL"""
        for d, flag, y in (("dep", "is_bike_empty", "departures"), ("arr", "is_dock_full", "arrivals"))
    },
    "net": """SELECT u.*, CASE WHEN u.is_bike_empty THEN least(u.dep_gross, coalesce(d.got, 0.0::DOUBLE)) ELSE 0.0::DOUBLE END AS dep_displaced,
        CASE WHEN u.is_bike_empty THEN u.dep_gross - least(u.dep_gross, coalesce(d.got, 0.0::DOUBLE)) ELSE 0.0::DOUBLE END AS dep_net_lost,
        CASE WHEN u.is_dock_full THEN least(u.arr_gross, coalesce(a.got, 0.0::DOUBLE)) ELSE 0.0::DOUBLE END AS arr_displaced,
        CASE WHEN u.is_dock_full THEN u.arr_gross - least(u.arr_gross, coalesce(a.got, 0.0::DOUBLE)) ELSE 0.0::DOUBLE END AS arr_net_lost
        FROM unmet u LEFT JOIN sub_dep d ON u.station_id = d.station_id AND u.interval_start = d.interval_start LEFT JOIN sub_arr a ON u.station_id = a.station_id AND u.interval_start = a.interval_start""",
    "span": "SELECT date_diff('second', min(interval_start), max(interval_start)) / 604800.0::DOUBLE AS w FROM net",
    "zone_hour": "SELECT zone_agg, hour_of_week, sum(dep_net_lost) / (SELECT w FROM span) AS dep_net_lost, sum(arr_net_lost) / (SELECT w FROM span) AS arr_net_lost FROM net WHERE zone_agg IS NOT NULL GROUP BY ALL",
    "zone_cap": "SELECT zone_agg, sum(capacity)::BIGINT AS zone_capacity FROM stations GROUP BY zone_agg",
    "zone_week": """SELECT n.zone_agg, hour_of_week, sum(dep_net_lost) / nullif(any_value(zone_capacity), 0) AS d, sum(arr_net_lost) / nullif(any_value(zone_capacity), 0) AS a
        FROM net n LEFT JOIN zone_cap c ON n.zone_agg = c.zone_agg GROUP BY n.zone_agg, hour_of_week, week_start""",
    "ci": """SELECT zone_agg, hour_of_week, count(*) AS n_weeks, avg(d) AS dep_mean, stddev_samp(d) / sqrt(count(*)) AS dep_se, avg(d) - 1.96::DOUBLE * (stddev_samp(d) / sqrt(count(*))) AS dep_lower,
        avg(a) AS arr_mean, stddev_samp(a) / sqrt(count(*)) AS arr_se, avg(a) - 1.96::DOUBLE * (stddev_samp(a) / sqrt(count(*))) AS arr_lower FROM zone_week GROUP BY ALL""",
    "weekly": """SELECT station_id, hour_of_week, week_start, any_value(capacity) AS capacity, any_value(zone_agg) AS zone_agg, avg(is_bike_empty::INTEGER) AS p_stockout, avg(dep_d) AS dep_d, avg(arr_d) AS arr_d,
        avg(dep_net_lost) AS net_lost, avg(inventory) AS inventory, avg(nontrip_in) AS nontrip_in, avg(nontrip_out) AS nontrip_out, count(*) AS n FROM net GROUP BY ALL""",
    "rates": """SELECT station_id, hour_of_week, any_value(capacity) AS capacity, sum(p_stockout * n) / sum(n) AS p_stockout_empirical, sum(dep_d * n) / sum(n) AS dep_rate, sum(arr_d * n) / sum(n) AS arr_rate,
        sum(nontrip_in * n) / sum(n) AS nontrip_in_rate, sum(nontrip_out * n) / sum(n) AS nontrip_out_rate, count(*) AS n_weeks,
        sum(dep_d * n) / sum(n) + sum(nontrip_out * n) / sum(n) AS mu, sum(arr_d * n) / sum(n) + sum(nontrip_in * n) / sum(n) AS lam FROM weekly GROUP BY station_id, hour_of_week""",
    "low": """SELECT station_id, hour_of_week, min(inventory) AS min_inventory, avg(CASE WHEN inventory <= 1 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS low_frac, count(*) AS n_weeks, sum(net_lost * n) AS net_lost
        FROM weekly GROUP BY ALL""",
    "slots": """SELECT i.station_id, i.hour_of_week, i.week_start, min(extract(minute FROM interval_start) // 15)::INTEGER AS first_slot FROM inv i JOIN low l ON i.station_id = l.station_id AND i.hour_of_week = l.hour_of_week
        WHERE l.low_frac > 0.5 AND i.inventory <= 1 GROUP BY ALL""",
    "timing": """SELECT station_id, hour_of_week, sum(n)::BIGINT AS n_weeks, sum(n * first_slot)::DOUBLE / sum(n) AS mean_slot,
        sqrt(greatest(sum(n * first_slot * first_slot) - sum(n * first_slot)::DOUBLE * sum(n * first_slot) / sum(n), 0.0::DOUBLE) / nullif(sum(n) - 1, 0)) AS std_slot, max(n)::DOUBLE / sum(n) AS modal_share
        FROM (SELECT station_id, hour_of_week, first_slot, count(*) AS n FROM slots GROUP BY ALL) GROUP BY station_id, hour_of_week""",
    "mvcells": """SELECT r.station_id, r.hour_of_week, r.capacity, r.lam, r.mu, coalesce(e.e, 0.0::DOUBLE) AS loss FROM rates r LEFT JOIN (SELECT station_id, hour_of_week, avg(net_lost * n) AS e FROM weekly WHERE p_stockout > 0 GROUP BY ALL) e
        ON r.station_id = e.station_id AND r.hour_of_week = e.hour_of_week WHERE r.capacity > 0""",
    "mvflow": """SELECT station_id, hour_of_week, capacity, loss, d, sum(power(lam, k + d) / gamma(k + d + 1) * power(mu, k) / gamma(k + 1)) * exp(-any_value(lam) - any_value(mu)) AS p
        FROM mvcells, range(-30, 31) a(d), range(0, 41) b(k) WHERE k + d >= 0 GROUP BY ALL""",
    "mvstep": "MATERIALIZED SELECT station_id, hour_of_week, capacity, loss, s, least(capacity, greatest(0, s + d)) AS j, sum(p) AS p FROM mvflow, range(1, 100) t(s) WHERE s <= capacity GROUP BY ALL",
    "mvhit1": "SELECT station_id, hour_of_week, s, sum(CASE WHEN j = 0 THEN p ELSE 0.0::DOUBLE END) AS h FROM mvstep GROUP BY ALL",
    **{f"mvhit{i}": f"SELECT t.station_id, t.hour_of_week, t.s, any_value(t.capacity) AS capacity, any_value(t.loss) AS loss, sum(t.p * CASE WHEN t.j = 0 THEN 1.0::DOUBLE ELSE x.h END) AS h FROM mvstep t LEFT JOIN mvhit{i - 1} x ON x.station_id = t.station_id AND x.hour_of_week = t.hour_of_week AND x.s = t.j GROUP BY t.station_id, t.hour_of_week, t.s" for i in (2, 3, 4)},
    "mvall": "SELECT *, lead(mv) OVER (PARTITION BY station_id, hour_of_week ORDER BY k) AS next FROM (SELECT station_id, hour_of_week, s::INTEGER AS k, greatest(loss, 0.0::DOUBLE) * (coalesce(lag(h) OVER (PARTITION BY station_id, hour_of_week ORDER BY s), 1.0::DOUBLE) - h) AS mv FROM mvhit4)",
    "mv": "MATERIALIZED SELECT station_id, hour_of_week, k, mv, bad IS NULL AS is_concave, bad::BIGINT AS first_violation_k FROM (SELECT *, min(CASE WHEN next > mv + 1e-9::DOUBLE THEN k END) OVER (PARTITION BY station_id, hour_of_week) AS bad FROM mvall) WHERE k <= 4",
    "tiers": """SELECT l.station_id, l.hour_of_week, l.low_frac, t.modal_share, CASE WHEN l.low_frac > 0.5 AND t.modal_share >= 0.7 THEN 1 ELSE 2 END AS tier
        FROM low l LEFT JOIN timing t ON l.station_id = t.station_id AND l.hour_of_week = t.hour_of_week WHERE l.low_frac > 0""",
    "origins": """SELECT l.station_id, l.hour_of_week, l.min_inventory, coalesce(c.mv, 0.0::DOUBLE) AS origin_cost FROM low l LEFT JOIN mv c ON l.station_id = c.station_id AND l.hour_of_week = c.hour_of_week
        AND c.k = greatest(1, round_even(least(l.min_inventory, 4.0::DOUBLE), 0)::INTEGER) WHERE l.low_frac <= 0.10""",
    "cum": """SELECT station_id, hour_of_week, k, sum(mv) OVER (PARTITION BY station_id, hour_of_week ORDER BY k ROWS UNBOUNDED PRECEDING) AS cum_mv, max(k) OVER (PARTITION BY station_id, hour_of_week) AS k_max FROM mv""",
    "od": """SELECT t.start_station_id, s.zone_agg AS start_zone_agg, t.how AS hour_of_week, t.end_station_id,
        ((CASE WHEN t.how % 24 >= 7 THEN 1 ELSE 0 END) + (CASE WHEN t.how % 24 >= 10 THEN 1 ELSE 0 END) + (CASE WHEN t.how % 24 >= 16 THEN 1 ELSE 0 END) + (CASE WHEN t.how % 24 >= 19 THEN 1 ELSE 0 END)
        + (CASE WHEN t.how % 24 >= 22 THEN 1 ELSE 0 END) + (CASE WHEN t.how >= 120 THEN 6 ELSE 0 END))::INTEGER AS daypart
        FROM trips t LEFT JOIN stations s ON t.start_station_id = s.station_id WHERE t.end_station_id IN (SELECT station_id FROM usable)""",
    "flows": "SELECT start_station_id, hour_of_week, end_station_id, count(*)::DOUBLE / sum(count(*)) OVER (PARTITION BY start_station_id, hour_of_week) AS prob FROM od GROUP BY start_station_id, hour_of_week, end_station_id",
    "dest": """SELECT t.station_id, t.hour_of_week, t.tier, t.low_frac, c.k_max, s.zone_agg FROM tiers t JOIN cum c ON t.station_id = c.station_id AND t.hour_of_week = c.hour_of_week AND c.k = c.k_max
        LEFT JOIN stations s ON s.station_id = t.station_id WHERE round(c.cum_mv, 9) > 0 ORDER BY round(c.cum_mv, 9) DESC, t.station_id, t.hour_of_week LIMIT 3000""",
    "moves": """SELECT station_id, hour_of_week, tier, low_frac, k_max, origin_station_id, origin_cost, flow_prob FROM (
        SELECT d.*, o.station_id AS origin_station_id, o.origin_cost, coalesce(f.prob, 0.0::DOUBLE) AS flow_prob,
               row_number() OVER (PARTITION BY d.station_id, d.hour_of_week ORDER BY round(o.origin_cost, 9), round(coalesce(f.prob, 0), 9) DESC, o.station_id) AS rn
        FROM dest d JOIN origins o ON d.hour_of_week = o.hour_of_week AND d.station_id <> o.station_id JOIN stations s ON s.station_id = o.station_id
        LEFT JOIN flows f ON f.start_station_id = o.station_id AND f.hour_of_week = o.hour_of_week AND f.end_station_id = d.station_id
        WHERE s.zone_agg = d.zone_agg OR f.prob > 0) WHERE rn = 1""",
    "opts": """SELECT m.*, p.payout, CASE WHEN tier = 1 THEN 2.0::DOUBLE ELSE 3.0::DOUBLE END * (1 - exp(-CASE WHEN tier = 1 THEN 0.15::DOUBLE ELSE 0.25::DOUBLE END * p.payout)) AS induced
        FROM moves m, (SELECT unnest([1, 2, 5, 10, 20, 30, 50])::DOUBLE AS payout) p""",
    "ranked": """SELECT *, row_number() OVER (ORDER BY round(nvpd, 9) DESC, station_id, hour_of_week) AS rank FROM (
        SELECT *, row_number() OVER (PARTITION BY station_id, hour_of_week ORDER BY round(nvpd, 9) DESC, payout) AS nth FROM (
        SELECT o.*, c.cum_mv - o.induced * o.origin_cost AS value, o.induced * o.payout * 0.2::DOUBLE AS dollar_cost,
            (c.cum_mv - o.induced * o.origin_cost - o.induced * o.payout * 0.2::DOUBLE) / (o.induced * o.payout * 0.2::DOUBLE) AS nvpd
        FROM opts o JOIN cum c ON c.station_id = o.station_id AND c.hour_of_week = o.hour_of_week AND c.k = greatest(1, least(round_even(o.induced, 0)::INTEGER, o.k_max)))) WHERE nth = 1""",
    "draws": """SELECT ((a - 1) * 5 + b - 1)::INTEGER AS draw, 1.0::DOUBLE + 4.0::DOUBLE * (a - 1) / 4 AS ea, 0.05::DOUBLE + (0.5::DOUBLE - 0.05::DOUBLE) * (b - 1) / 4 AS eb FROM range(1, 6) x(a), range(1, 6) y(b)""",
    "tops": """SELECT draw, station_id, hour_of_week, rank::INTEGER AS rank FROM (SELECT *, row_number() OVER (PARTITION BY draw ORDER BY round(nvpd, 9) DESC, station_id, hour_of_week) AS rank FROM (
        SELECT *, row_number() OVER (PARTITION BY draw, station_id, hour_of_week ORDER BY round(nvpd, 9) DESC, payout) AS nth FROM (
        SELECT o.draw, o.station_id, o.hour_of_week, o.payout, (c.cum_mv - o.i * o.origin_cost - o.i * o.payout * 0.2::DOUBLE) / (o.i * o.payout * 0.2::DOUBLE) AS nvpd
        FROM (SELECT m.*, p.payout, d.draw, d.ea * (1 - exp(-d.eb * p.payout)) AS i FROM moves m, (SELECT unnest([1, 2, 5, 10, 20, 30, 50])::DOUBLE AS payout) p, draws d) o
        JOIN cum c ON c.station_id = o.station_id AND c.hour_of_week = o.hour_of_week AND c.k = greatest(1, least(round_even(o.i, 0)::INTEGER, o.k_max)))) WHERE nth = 1) WHERE rank <= 100""",
}


def sql(body: str, **more: str) -> str:
    """body with the parts that it names in front, and theirs."""
    parts = PARTS | more
    needed: list[str] = []

    def visit(text: str, own: str | None = None) -> None:
        for name in parts:
            if name != own and name not in needed and re.search(rf"(?:FROM|JOIN|,)\s+\(?{name}\b", text):
                visit(parts[name], name)
                if name not in needed:
                    needed.append(name)

    visit(body)
    if not needed:
        return body
    kept = "MATERIALIZED "  # a part that begins so is computed once
    return "WITH RECURSIVE " + ",\n".join(f"{n} AS {kept if parts[n].startswith(kept) else ''}({parts[n].removeprefix(kept)})" for n in needed) + "\n" + body
