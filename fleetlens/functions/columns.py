"""Column builders: calendar, geography, buckets and closed forms. All of them stay in generated code."""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

from pyspark.sql import Column, functions as F

EARTH_RADIUS_M = 6_371_000.0
INTERVAL_MINUTES = 15


def floor_interval(ts: Column, minutes: int = INTERVAL_MINUTES) -> Column:
    """Start of the interval that holds ts (timestamp_ntz in and out)."""
    step = minutes * 60
    seconds = F.timestamp_diff("SECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), ts)
    return F.timestamp_add("SECOND", (F.floor(seconds / step) * step).cast("int"), F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"))


def floor_hour(ts: Column) -> Column:
    return floor_interval(ts, 60)


def week_start(ts: Column) -> Column:
    """Monday 00:00 of the week of ts, as timestamp_ntz."""
    return F.date_trunc("week", ts).cast("timestamp_ntz")


def hour_of_week(ts: Column) -> Column:
    """0 = Monday 00:00 ... 167 = Sunday 23:00."""
    return F.weekday(ts) * 24 + F.hour(ts)


def month_key(ts: Column) -> Column:
    """yyyy-MM; a month number would merge the same month of two years."""
    return F.date_format(ts, "yyyy-MM")


def hour_label(how: Column) -> Column:
    """"Mon 08:00" for 8."""
    days = F.array(*[F.lit(d) for d in ("Mon", "Tue", "Wed", "Thu", "Fri", "Sat", "Sun")])
    return F.format_string("%s %02d:00", F.element_at(days, (F.floor(how / 24) + 1).cast("int")), (how % 24).cast("int"))


def daypart(how: Column, edges: Sequence[int] = (7, 10, 16, 19, 22)) -> Column:
    """0..len(edges) on weekdays by hour of day, the same shifted by len(edges) + 1 on weekends."""
    hour = how % 24
    part = sum((hour >= e).cast("int") for e in edges)
    return (part + F.when(how >= 120, len(edges) + 1).otherwise(0)).cast("int")


def upper_bucket(x: Column, edges: Sequence[float]) -> Column:
    """Bucket by upper-inclusive edges: [1, 4] gives 0 for x <= 1, 1 for x <= 4, else 2."""
    return sum(((x > e).cast("int") for e in edges), F.lit(0))


def quantile_bucket(x: Column, edges: Column) -> Column:
    """Number of edges that are <= x (edges: an array column)."""
    return F.size(F.filter(edges, lambda e: e <= x))


def haversine_m(lat1: Column, lng1: Column, lat2: Column, lng2: Column) -> Column:
    """Great-circle distance in metres."""
    a, b = F.radians(lat1), F.radians(lat2)
    h = F.pow(F.sin((b - a) / 2), 2) + F.cos(a) * F.cos(b) * F.pow(F.sin((F.radians(lng2) - F.radians(lng1)) / 2), 2)
    return 2 * EARTH_RADIUS_M * F.asin(F.sqrt(F.least(h, F.lit(1.0))))


def induced_trips(payout: Column, a: Column, b: Column) -> Column:
    """a (1 - exp(-b payout)): trips an hour that a payout induces."""
    return a * (1 - F.exp(-b * payout))


def pearson(a: Column | str, b: Column | str) -> Column:
    """Correlation of two columns (an aggregate); null where one does not vary, for which corr() raises under ANSI rules."""
    return F.try_divide(F.covar_pop(a, b), F.stddev_pop(a) * F.stddev_pop(b))


def mm1k_p0(lam: Column, mu: Column, k: Column) -> Column:
    """Chance of an empty M/M/1/K queue: 1 for K <= 0, 1/(K+1) at rho = 1, null for mu = 0."""
    rho = F.try_divide(lam, mu)
    return (
        F.when(k <= 0, 1.0)
        .when(rho.isNull(), None)
        .when(F.abs(rho - 1) < 1e-12, 1 / (k + 1.0))
        .otherwise(F.try_divide(1 - rho, 1 - F.pow(rho, k + 1.0)))
    )


def relaxation_minutes(lam: Column, mu: Column, interval: int = INTERVAL_MINUTES) -> Column:
    """interval / (sqrt(mu) - sqrt(lam))^2 where lam < mu, else null."""
    return F.when(lam < mu, interval / F.pow(F.sqrt(mu) - F.sqrt(lam), 2))


def utm_metres(lat: Column, lng: Column, central: float = -75.0) -> tuple[Column, Column]:
    """Easting and northing by the transverse Mercator series (WGS 84), good to less than a metre within the zone."""
    a, f, k0 = 6378137.0, 1 / 298.257223563, 0.9996
    e2 = f * (2 - f)
    ep2 = e2 / (1 - e2)
    phi = F.radians(lat)
    n = a / F.sqrt(1 - e2 * F.pow(F.sin(phi), 2))
    t, c = F.pow(F.tan(phi), 2), ep2 * F.pow(F.cos(phi), 2)
    d = F.cos(phi) * F.radians(lng - central)
    m = a * (
        (1 - e2 / 4 - 3 * e2**2 / 64 - 5 * e2**3 / 256) * phi
        - (3 * e2 / 8 + 3 * e2**2 / 32 + 45 * e2**3 / 1024) * F.sin(2 * phi)
        + (15 * e2**2 / 256 + 45 * e2**3 / 1024) * F.sin(4 * phi)
        - (35 * e2**3 / 3072) * F.sin(6 * phi)
    )
    east = k0 * n * (d + (1 - t + c) * F.pow(d, 3) / 6 + (5 - 18 * t + t * t + 72 * c - 58 * ep2) * F.pow(d, 5) / 120) + 500000
    north = k0 * (m + n * F.tan(phi) * (d * d / 2 + (5 - t + 9 * c + 4 * c * c) * F.pow(d, 4) / 24 + (61 - 58 * t + t * t + 600 * c - 330 * ep2) * F.pow(d, 6) / 720))
    return east, north


def hex_cell(x: Column, y: Column, edge_m: float = 460.0) -> Column:
    """Id "q:r" of the pointy-top hexagon (axial coordinates, cube rounding) that holds a point in metres."""
    q, r = (x * (3**0.5 / 3) - y / 3) / edge_m, (y * 2 / 3) / edge_m
    s = -q - r
    rq, rr, rs = F.round(q), F.round(r), F.round(s)
    dq, dr, ds = F.abs(rq - q), F.abs(rr - r), F.abs(rs - s)
    fq = F.when((dq > dr) & (dq > ds), -rr - rs).otherwise(rq)
    fr = F.when((dq > dr) & (dq > ds), rr).when(dr > ds, -rq - rs).otherwise(rr)
    return F.concat_ws(":", fq.cast("long").cast("string"), fr.cast("long").cast("string"))


#: Fixed values of the H3 grid: centre of its second icosahedron face and azimuth of that face's first axis
#: (radians), length of a cell of resolution 0 on the face, turn of the odd resolutions.
H3_FACE_LAT, H3_FACE_LNG, H3_AXIS = 1.054751253523952054, -1.347517358900396623, 0.780213654393430055
H3_UNIT, H3_TURN = 0.38196601125010500003, 0.333473172251832115336
#: Base cells of that face by their place on it: eastern and central North America.
H3_BASE_CELLS = {(-1, -1): 21, (-1, 0): 19}


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with value worked out once however often use names it."""
    return F.transform(F.array(value), use)[0]


def h3_plane(lat: Column, lng: Column, resolution: int) -> Column:
    """Place (x, y) on the face in cells of a resolution (gnomonic projection, x along the first axis); null beyond the face."""
    phi, turn = F.radians(lat), F.radians(lng) - H3_FACE_LNG
    sin0, cos0 = math.sin(H3_FACE_LAT), math.cos(H3_FACE_LAT)
    axis, scale = H3_AXIS - (H3_TURN if resolution % 2 else 0.0), 7 ** (resolution / 2)

    def placed(v: Column) -> Column:
        north, east = v["north"] / v["depth"] / H3_UNIT, v["east"] / v["depth"] / H3_UNIT
        along = lambda azimuth: math.cos(azimuth) * north + math.sin(azimuth) * east
        sides = [along(H3_AXIS + math.pi + k * 2 * math.pi / 3) for k in range(3)]  # a side is one unit from the centre, opposite to an axis
        place = F.struct((scale * along(axis)).alias("x"), (scale * along(axis - math.pi / 2)).alias("y"))
        return F.when((v["depth"] > 0) & (F.greatest(*sides) <= 1), place)

    vector = F.struct(
        (sin0 * F.sin(phi) + cos0 * F.cos(phi) * F.cos(turn)).alias("depth"),
        (cos0 * F.sin(phi) - sin0 * F.cos(phi) * F.cos(turn)).alias("north"),
        (F.cos(phi) * F.sin(turn)).alias("east"),
    )
    return bound(F.when(F.cos(phi) * F.cos(turn) * cos0 + sin0 * F.sin(phi) > 0, vector), placed)


def h3_cell(lat: Column, lng: Column, resolution: int = 8) -> Column:
    """H3 id of the cell that holds a point, as 15 hexadecimal digits.

    Cells lie on two axes 120 degrees apart, i and j. The nearest cell is found by
    cube rounding; then, from the resolution up, the parent's place is the
    rounded inverse of the seven-fold grid, and a digit is the step from the
    parent's middle child. Null for a null place and for places beyond the base
    cells listed above, where ids would need the tables of the other faces.
    """
    if not 1 <= resolution <= 15:
        raise ValueError(f"resolution {resolution} is not in 1..15")
    at = lambda v: F.struct((v["x"] + v["y"] / 3**0.5).alias("i"), (v["y"] * (2 / 3**0.5)).alias("j"))
    whole = lambda v: F.struct(v["i"].alias("i"), v["j"].alias("j"), F.rint(v["i"]).alias("a"), F.rint(v["j"] - v["i"]).alias("b"), F.rint(-v["j"]).alias("c"))

    def nearest(v: Column) -> Column:
        da, db, dc = F.abs(v["a"] - v["i"]), F.abs(v["b"] - (v["j"] - v["i"])), F.abs(v["c"] + v["j"])
        of_a = (da > db) & (da > dc)
        i = F.when(of_a, -v["b"] - v["c"]).otherwise(v["a"])
        j = F.when(of_a | (db > dc), -v["c"]).otherwise(v["a"] + v["b"])
        return F.struct(i.cast("long").alias("i"), j.cast("long").alias("j"), F.lit(0).cast("long").alias("digits"))

    def up(s: Column, r: Column) -> Column:
        i, j, odd = s["i"], s["j"], r % 2 == 1
        seventh = lambda n: F.floor((2 * n + 7) / 14)
        parent = F.struct(
            F.when(odd, seventh(3 * i - j)).otherwise(seventh(2 * i + j)).alias("i"),
            F.when(odd, seventh(i + 2 * j)).otherwise(seventh(3 * j - i)).alias("j"),
        )

        def step(p: Column) -> Column:
            di = i - F.when(odd, 2 * p["i"] + p["j"]).otherwise(3 * p["i"] - p["j"])
            dj = j - F.when(odd, 3 * p["j"] - p["i"]).otherwise(p["i"] + 2 * p["j"])
            least = F.least(di, dj, F.lit(0))  # the third axis takes what is negative
            digit = 4 * (di - least) + 2 * (dj - least) - least
            return F.struct(p["i"].alias("i"), p["j"].alias("j"), (s["digits"] + digit * F.element_at(places, r)).alias("digits"))

        return bound(parent, step)

    places = F.array(*[F.lit(8 ** (15 - r)).cast("long") for r in range(1, resolution + 1)])
    first = bound(bound(bound(h3_plane(lat, lng, resolution), at), whole), nearest)
    top = F.aggregate(F.array(*[F.lit(r) for r in range(resolution, 0, -1)]), first, up)
    fixed = (1 << 59) + (resolution << 52) + 8 ** (15 - resolution) - 1

    def named(t: Column) -> Column:
        base = F.lit(None).cast("long")
        for (bi, bj), number in H3_BASE_CELLS.items():
            base = F.when((t["i"] == bi) & (t["j"] == bj), F.lit(number << 45).cast("long")).otherwise(base)
        return F.lower(F.hex(F.lit(fixed) + base + t["digits"]))

    return bound(top, named)
