"""Queries on root finding, ODEs, quadrature, interpolation and Fourier transforms."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lattica.operators import interpolants, interpolation, ode, quadrature, roots, spectral, table_functions
from lattica.plans.tables import evenly, keep, r6, table

QUERIES: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str | None]] = {}


def query(sql: str | None):
    def add(f):
        QUERIES[f.__name__] = (f, sql)
        return f

    return add


_CUBE = "SELECT o_orderkey, 'Converged' AS status, round(pow(o_totalprice, 1.0::DOUBLE / 3), 6) AS x FROM orders"


def _cube_root(spark, sf, solve):
    rows = table(spark, sf, "orders").select("o_orderkey", "o_totalprice")
    out = solve(lambda x: x * x * x - F.col("o_totalprice"), lambda x: 3 * x * x, F.lit(40.0))
    return rows.withColumn("o", out).select("o_orderkey", "o.status", r6("o.result").alias("x"))


@query(_CUBE)
def newton_cuberoot(spark, sf):
    return _cube_root(spark, sf, lambda f, df, x0: roots.newton(f, df, x0, 1e-6, 60))


@query(_CUBE)
def damped_newton_cuberoot(spark, sf):
    return _cube_root(spark, sf, lambda f, df, x0: roots.damped_newton(f, df, x0, 1e-6, 150, 0.01))


def _decay(factor: str) -> str:
    return f"""SELECT c_custkey, k AS step, k * 0.25::DOUBLE AS t, round(pow({factor}, k), 9) + 0.0 AS y
FROM (SELECT c_custkey, (0.1 + (c_custkey % 10) / 5.0)::DOUBLE * 0.25::DOUBLE AS z, unnest(range(0, 13))::INTEGER AS k FROM customer)"""


def _solve_decay(spark, sf, step, deal=lambda rows: rows):
    rows = table(spark, sf, "customer").select("c_custkey", (F.lit(0.1) + (F.col("c_custkey") % 10) / F.lit(5.0)).alias("rate"))
    found = ode.solve(deal(rows), ["c_custkey"], step, F.lit(1.0), F.lit(0.25), F.lit(3.0))
    return found.select("c_custkey", "step", "t", r6("y", 9).alias("y"))


def _field(t, y):
    return -F.col("rate") * y


@query(_decay("1 - z"))
def ode_euler(spark, sf):
    return _solve_decay(spark, sf, ode.euler_step(_field))


@query(_decay("1 - z + z * z / 2"))
def ode_heun(spark, sf):
    return _solve_decay(spark, sf, ode.heun_step(_field))


@query(_decay("1 - z + z * z / 2 - z * z * z / 6 + z * z * z * z / 24"))
def ode_runge_kutta(spark, sf):
    return _solve_decay(spark, sf, ode.runge_kutta_step(_field))


@query(_decay("1 / (1 + z)"))
def ode_implicit_euler(spark, sf):
    return _solve_decay(spark, sf, ode.implicit_euler_step(_field, lambda t, y: -F.col("rate"), eps=1e-12), evenly)


def _oscillator(t, y):
    return [y[1], -y[0]]


# From each customer's own start; y0 - i y1 is multiplied by the same number in each step.
def _turning(re: str, im: str) -> str:
    return f"""SELECT c_custkey, k AS step, round(r * (s0 * cos(k * w) + s1 * sin(k * w)), 6) + 0.0 AS y0, round(r * (s1 * cos(k * w) - s0 * sin(k * w)), 6) + 0.0 AS y1
FROM (SELECT c_custkey, s0, s1, k, pow(re * re + im * im, k / 2.0::DOUBLE) AS r, atan2(im, re) AS w FROM (SELECT *, {re} AS re, {im} AS im, unnest(range(0, 21))::INTEGER AS k
FROM (SELECT c_custkey, c_acctbal / 997 AS s0, (c_custkey % 7)::DOUBLE AS s1, 0.1::DOUBLE AS z FROM customer)))"""


def _turn(spark, sf, step):
    rows = table(spark, sf, "customer").select("c_custkey", F.array(F.col("c_acctbal") / 997, (F.col("c_custkey") % 7).cast("double")).alias("start"))
    found = ode.solve_system(rows, ["c_custkey"], step, F.col("start"), F.lit(0.1), F.lit(2.05))
    return found.select("c_custkey", "step", r6(F.col("y")[0]).alias("y0"), r6(F.col("y")[1]).alias("y1"))


@query(_turning("1", "z"))
def ode_system(spark, sf):
    return _turn(spark, sf, ode.euler_system(_oscillator, 2))


@query(_turning("1 - z * z / 2", "z"))
def ode_system_heun(spark, sf):
    return _turn(spark, sf, ode.heun_system(_oscillator, 2))


@query(_turning("1 - z * z / 2 + z * z * z * z / 24", "z - z * z * z / 6"))
def ode_system_runge_kutta(spark, sf):
    return _turn(spark, sf, ode.runge_kutta_system(_oscillator, 2))


@query(_turning("1 / (1 + z * z)", "z / (1 + z * z)"))
def ode_system_implicit_euler(spark, sf):
    return _turn(spark, sf, ode.implicit_euler_system(_oscillator, lambda t, y: [[F.lit(0.0), F.lit(1.0)], [F.lit(-1.0), F.lit(0.0)]], 2, eps=1e-10))


# x**2 + y**2 = c and x - y = 1.
@query("SELECT o_orderkey, 'Converged' AS status, round((1 + sqrt(2 * o_totalprice - 1)) / 2, 6) AS x, round((sqrt(2 * o_totalprice - 1) - 1) / 2, 6) AS y FROM orders")
def newton_system(spark, sf):
    return _circle(spark, sf, lambda f, df, x0: roots.newton_system(f, df, x0, 2, 1e-8, 60))


def _circle(spark, sf, solve):
    c = F.col("o_totalprice")
    out = solve(lambda x: [x[0] * x[0] + x[1] * x[1] - c, x[0] - x[1] - 1], lambda x: [[2 * x[0], 2 * x[1]], [F.lit(1.0), F.lit(-1.0)]], F.array(F.lit(300.0), F.lit(200.0)))
    found = table(spark, sf, "orders").select("o_orderkey", out.alias("o"))
    return found.select("o_orderkey", "o.status", r6(F.col("o.result")[0]).alias("x"), r6(F.col("o.result")[1]).alias("y"))


@query("SELECT o_orderkey, 'Converged' AS status, round((1 + sqrt(2 * o_totalprice - 1)) / 2, 6) AS x, round((sqrt(2 * o_totalprice - 1) - 1) / 2, 6) AS y FROM orders")
def damped_newton_system(spark, sf):
    return _circle(spark, sf, lambda f, df, x0: roots.damped_newton_system(f, df, x0, 2, 1e-8, 150, 0.01))


# One iteration from x = 1: of every seventh order the slope vanishes there, which fails; a root at 1 is met at once.
@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 7 = 0 AND c <> 0 THEN 'Failed' WHEN o_orderkey % 11 = 0 THEN 'Converged' ELSE 'MaxIterations' END AS status,
round(CASE WHEN o_orderkey % 7 = 0 AND c <> 0 THEN NULL WHEN o_orderkey % 11 = 0 THEN 1 ELSE 1 - c / 2 END, 6) AS x, CASE WHEN o_orderkey % 11 = 0 THEN 0 END AS iterations
FROM (SELECT o_orderkey, CASE WHEN o_orderkey % 11 = 0 THEN 0 ELSE o_totalprice / 1000 END AS c FROM orders)""")
def newton_outcomes(spark, sf):
    c = F.when(F.col("o_orderkey") % 11 == 0, 0.0).otherwise(F.col("o_totalprice") / 1000)
    flat = F.col("o_orderkey") % 7 == 0
    out = roots.newton(lambda x: x * x - 1 + c, lambda x: F.when(flat, 0.0).otherwise(2 * x), F.lit(1.0), 1e-9, 1)
    found = table(spark, sf, "orders").select("o_orderkey", out.alias("o"))
    return found.select("o_orderkey", "o.status", r6("o.result").alias("x"), "o.iterations")


_B = "p_size / 50.0::DOUBLE"


def _parts(spark, sf):
    return table(spark, sf, "part").select("p_partkey", F.lit(0.0).alias("a"), (F.col("p_size") / F.lit(50.0)).alias("b"))


def _integral(spark, sf, rule):
    return _parts(spark, sf).select("p_partkey", r6(rule(F.exp, F.col("a"), F.col("b"))).alias("integral"))


@query(f"SELECT p_partkey, round({_B} / 2 * (1 + exp({_B})), 6) AS integral FROM part")
def quad_trapezoid(spark, sf):
    return _integral(spark, sf, quadrature.trapezoid)


@query(f"SELECT p_partkey, round({_B} / 6 * (1 + 4 * exp({_B} / 2) + exp({_B})), 6) AS integral FROM part")
def quad_kepler(spark, sf):
    return _integral(spark, sf, quadrature.kepler)


def _composite(n: int, weight: str, divisor: int) -> str:
    return f"SELECT p_partkey, round(b / {divisor * n} * list_sum(list_transform(range(0, {n + 1}), lambda k: exp(b * k / {n}) * ({weight})::DOUBLE)), 6) AS integral FROM (SELECT p_partkey, {_B} AS b FROM part)"


@query(_composite(32, "CASE WHEN k = 0 OR k = 32 THEN 1 ELSE 2 END", 2))
def quad_composite_trapezoid(spark, sf):
    return _integral(spark, sf, lambda f, a, b: quadrature.composite_trapezoid(f, a, b, 32))


@query(_composite(48, "CASE WHEN k = 0 OR k = 48 THEN 1 ELSE 2 END", 2))
def quad_composite_rows(spark, sf):
    found = quadrature.composite_trapezoid_rows(_parts(spark, sf), F.exp, ["p_partkey"], "a", "b", 48)
    return found.select("p_partkey", r6("integral").alias("integral"))


@query(_composite(32, "CASE WHEN k = 0 OR k = 32 THEN 1 WHEN k % 2 = 1 THEN 4 ELSE 2 END", 3))
def quad_simpson(spark, sf):
    return _integral(spark, sf, lambda f, a, b: quadrature.simpson(f, a, b, 32))


@query("""SELECT user_id, round(coalesce(sum((nx - x) * (value + ny) / 2), 0), 4) + 0.0 AS integral FROM (SELECT user_id, value, x, lead(x) OVER w AS nx, lead(value) OVER w AS ny
FROM (SELECT user_id, value, epoch_us(ts)::DOUBLE / 3600000000 - 473352 AS x FROM events) WINDOW w AS (PARTITION BY user_id ORDER BY x)) GROUP BY user_id""")
def quad_sampled(spark, sf):
    x = F.unix_micros(F.col("ts").cast("timestamp")).cast("double") / F.lit(3600000000.0) - F.lit(473352.0)
    found = quadrature.sampled(table(spark, sf, "events"), ["user_id"], x, F.col("value"))
    return found.select("user_id", r6("integral", 4).alias("integral"))


# The rule promises an error, not digits, so the promise is what is compared.
@query("SELECT p_partkey, true AS close, 'Converged' AS status FROM part")
def quad_adaptive(spark, sf):
    found = quadrature.adaptive_trapezoid(_parts(spark, sf), F.exp, ["p_partkey"], "a", "b", 1e-5)
    both = found.join(_parts(spark, sf), "p_partkey")
    return both.select("p_partkey", (F.abs(F.col("integral") - (F.exp("b") - 1)) <= 1e-4).alias("close"), "status")


# Two panels that are halved once at most, with a coarse tolerance: short intervals agree at once, others at the second depth or not at all.
_HALVED = "(exp(l) + 2 * exp((l + r) / 2) + exp(r)) * (r - l) / 4 AS fine, (exp(l) + exp(r)) * (r - l) / 2 AS coarse"


@query(f"""WITH a AS (SELECT p_partkey, b * k / 2 AS l, b * (k + 1) / 2 AS r FROM (SELECT p_partkey, 3 * {_B} AS b FROM part), range(2) t(k)), one AS (SELECT *, {_HALVED} FROM a),
b AS (SELECT p_partkey, l + (r - l) * h / 2 AS l, l + (r - l) * (h + 1) / 2 AS r FROM one, range(2) t(h) WHERE abs(fine - coarse) > 0.1 / 2), two AS (SELECT *, {_HALVED} FROM b),
done AS (SELECT p_partkey, fine, true AS ok FROM one WHERE abs(fine - coarse) <= 0.1 / 2 UNION ALL SELECT p_partkey, fine, abs(fine - coarse) <= 0.1 / 4 FROM two)
SELECT p_partkey, round(sum(fine), 7) AS integral, count(*) AS panels, CASE WHEN bool_and(ok) THEN 'Converged' ELSE 'MaxIterations' END AS status FROM done GROUP BY p_partkey""")
def quad_adaptive_outcomes(spark, sf):
    intervals = _parts(spark, sf).withColumn("b", 3 * F.col("b"))
    found = quadrature.adaptive_trapezoid(intervals, F.exp, ["p_partkey"], "a", "b", 0.1, panels=2, deepest=1)
    return found.select("p_partkey", r6("integral", 7).alias("integral"), "panels", "status")


@query(f"SELECT p_partkey, round(exp({_B}) - 1, 9) AS integral FROM part")
def quad_romberg(spark, sf):
    return _parts(spark, sf).select("p_partkey", r6(quadrature.romberg(F.exp, F.col("a"), F.col("b")), 9).alias("integral"))


# At most two halvings, with a coarse tolerance, so that only short intervals get there.
@query(f"""SELECT p_partkey, CASE WHEN abs(s1 - t1) <= 1e-4 OR abs(w - s1) <= 1e-4 THEN 'Converged' ELSE 'MaxIterations' END AS status, round(CASE WHEN abs(s1 - t1) <= 1e-4 THEN s1 ELSE w END, 7) AS integral,
CASE WHEN abs(s1 - t1) <= 1e-4 THEN 1 WHEN abs(w - s1) <= 1e-4 THEN 2 END AS iterations FROM (SELECT *, (16 * (4 * t4 - t2) / 3 - s1) / 15 AS w FROM (SELECT *, (4 * t2 - t1) / 3 AS s1
FROM (SELECT p_partkey, b / 2 * (1 + exp(b)) AS t1, b / 4 * (1 + 2 * exp(b / 2) + exp(b)) AS t2, b / 8 * (1 + 2 * exp(b / 4) + 2 * exp(b / 2) + 2 * exp(3 * b / 4) + exp(b)) AS t4 FROM (SELECT p_partkey, 3 * {_B} AS b FROM part))))""")
def quad_romberg_outcomes(spark, sf):
    found = _parts(spark, sf).select("p_partkey", quadrature.romberg_outcome(F.exp, F.col("a"), 3 * F.col("b"), 1e-4, 2).alias("o"))
    return found.select("p_partkey", "o.status", r6("o.result", 7).alias("integral"), "o.iterations")


# Whole series by time in days since the first event, with a query in each gap between neighbours; polynomials go through consecutive pieces of a few gaps.
_SERIES = """SELECT user_id, n, (us - min(us) OVER (PARTITION BY user_id)) / 86400000000.0::DOUBLE AS x, value / 100 AS y
FROM (SELECT user_id, epoch_us(ts) AS us, value, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS n FROM events)"""


def _pieces(gaps: int, share: float) -> str:
    """Pieces of ``gaps`` gaps, of which neighbours share a node, asked at ``share`` of each gap."""
    return f"""WITH s AS MATERIALIZED ({_SERIES}), k AS (SELECT user_id, n AS gap, n - n % {gaps} AS low, x + {share} * (next - x) AS q FROM (SELECT *, lead(x) OVER (PARTITION BY user_id ORDER BY n) AS next FROM s) WHERE next IS NOT NULL)
SELECT user_id, gap, round(sum(y * f), 4) + 0.0 AS y FROM (SELECT k.user_id, k.gap, a.n, any_value(a.y) AS y, product((k.q - b.x) / (a.x - b.x)) AS f FROM k JOIN s a ON a.user_id = k.user_id AND a.n BETWEEN low AND low + {gaps}
JOIN s b ON b.user_id = k.user_id AND b.n BETWEEN low AND low + {gaps} AND a.n <> b.n GROUP BY k.user_id, k.gap, a.n) GROUP BY user_id, gap"""


def _series(spark, sf):
    events = table(spark, sf, "events").select("user_id", "event_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("us"), "value")
    w = Window.partitionBy("user_id").orderBy("us", "event_id")
    x = (F.col("us") - F.first("us").over(w)) / F.lit(86400000000.0)
    return events.select("user_id", (F.row_number().over(w).cast("long") - 1).alias("n"), x.alias("x"), (F.col("value") / 100).alias("y"))


def _interpolated_pieces(spark, sf, method, many, share):
    n, low = F.col("n"), F.col("n") - F.col("n") % many
    lows = F.when((n == low) & (n > 0), F.array(low, low - many)).otherwise(F.array(low))
    rows = _series(spark, sf).select("user_id", F.explode(lows).alias("low"), "x", "y")
    pieces = interpolation.nodes(rows, ["user_id", "low"], "x", "y").where(F.size("nodes") > 1)
    gaps = F.size("nodes") - 1
    places = F.zip_with(F.slice("nodes", 1, gaps), F.slice("nodes", 2, gaps), lambda a, b: a["x"] + share * (b["x"] - a["x"]))
    asked = pieces.select("user_id", "low", F.posexplode(places).alias("at", "q"))
    found = interpolation.interpolate(pieces, asked, ["user_id", "low"], "q", method)
    return found.select("user_id", (F.col("low") + F.col("at")).alias("gap"), r6("y", 4).alias("y"))


@query(_pieces(2, 0.7))
def interp_barycentric(spark, sf):
    return _interpolated_pieces(spark, sf, "barycentric", 2, 0.7)


@query(_pieces(2, 0.7))
def interp_neville(spark, sf):
    return _interpolated_pieces(spark, sf, "neville", 2, 0.7)


@query(_pieces(2, 0.7))
def interp_newton(spark, sf):
    return _interpolated_pieces(spark, sf, "newton", 2, 0.7)


@query(_pieces(3, 0.4))
def interp_barycentric_whole(spark, sf):
    return _interpolated_pieces(spark, sf, "barycentric", 3, 0.4)


@query(_pieces(3, 0.4))
def interp_neville_whole(spark, sf):
    return _interpolated_pieces(spark, sf, "neville", 3, 0.4)


@query(_pieces(3, 0.4))
def interp_newton_whole(spark, sf):
    return _interpolated_pieces(spark, sf, "newton", 3, 0.4)


def _stored_pieces(spark, sf, method):
    """Interpolants of three nodes a piece are kept; the fourth comes later and updates them."""
    keys, n = ["user_id", "low"], F.col("n")
    rows = keep(_series(spark, sf).withColumn("low", n - n % 3))
    stored = keep(interpolants.build(rows, keys, "x", "y"))
    late = rows.where("n > 0 AND n % 3 = 0").withColumn("low", F.col("low") - 3)
    following = F.lead("x").over(Window.partitionBy("user_id").orderBy("n"))
    asked = rows.select(*keys, n.alias("gap"), (F.col("x") + 0.4 * (following - F.col("x"))).alias("q")).where("q IS NOT NULL")
    found = interpolants.evaluate(interpolants.extend(stored, late, keys, "x", "y"), asked, keys, "q", method)
    return found.select("user_id", "gap", r6("y", 4).alias("y"))


@query(_pieces(3, 0.4))
def interp_stored_barycentric(spark, sf):
    return _stored_pieces(spark, sf, "barycentric")


@query(_pieces(3, 0.4))
def interp_stored_newton(spark, sf):
    return _stored_pieces(spark, sf, "newton")


@query("""SELECT p_partkey, k, round(b * k / 6, 6) AS uniform, round(b / 2 - b / 2 * cos((2 * k + 1) * pi() / 14), 6) AS chebyshev
FROM (SELECT p_partkey, p_size / 50.0::DOUBLE AS b, unnest(range(0, 7))::INTEGER AS k FROM part)""")
def interp_nodes(spark, sf):
    a, b = F.col("a"), F.col("b")
    both = F.zip_with(interpolation.uniform_nodes(a, b, 6), interpolation.chebyshev_nodes(a, b, 6), lambda u, c: F.struct(u.alias("u"), c.alias("c")))
    rows = _parts(spark, sf).select("p_partkey", F.posexplode(both).alias("k", "z"))
    return rows.select("p_partkey", "k", r6("z.u").alias("uniform"), r6("z.c").alias("chebyshev"))


def _spline_sql(share: float) -> str:
    """Flat ends; the tridiagonal system of the moments m is swept down and up, a node a step."""
    return f"""WITH RECURSIVE s AS MATERIALIZED ({_SERIES}), k AS MATERIALIZED (SELECT user_id, n, x, y, max(n) OVER (PARTITION BY user_id) AS top, coalesce(x - lag(x) OVER w, 0) AS g, coalesce(lead(x) OVER w - x, 0) AS h,
coalesce((y - lag(y) OVER w) / (x - lag(x) OVER w), 0) AS d0, coalesce((lead(y) OVER w - y) / (lead(x) OVER w - x), 0) AS d1 FROM s WINDOW w AS (PARTITION BY user_id ORDER BY n)),
down(user_id, n, top, u, v) AS (SELECT user_id, n, top, h / (2 * (g + h)), 6 * (d1 - d0) / (2 * (g + h)) FROM k WHERE n = 0 AND top > 0
UNION ALL SELECT k.user_id, k.n, k.top, h / (2 * (g + h) - g * u), (6 * (d1 - d0) - g * v) / (2 * (g + h) - g * u) FROM down JOIN k ON k.user_id = down.user_id AND k.n = down.n + 1),
d AS MATERIALIZED (SELECT * FROM down), up(user_id, n, m) AS (SELECT user_id, n, v FROM d WHERE n = top UNION ALL SELECT d.user_id, d.n, d.v - d.u * m FROM up JOIN d ON d.user_id = up.user_id AND d.n = up.n - 1),
m AS MATERIALIZED (SELECT * FROM up JOIN k USING (user_id, n))
SELECT a.user_id, a.n AS gap, round(a.y * (1 - t) + b.y * t + a.h * a.h * (a.m * (-t / 3 + t * t / 2 - t * t * t / 6) + b.m * (-t / 6 + t * t * t / 6)), 3) + 0.0 AS y
FROM m a JOIN m b ON a.user_id = b.user_id AND b.n = a.n + 1, (SELECT {share}::DOUBLE AS t)"""


def _knots(spark, sf):
    many = F.count("*").over(Window.partitionBy("user_id")) > 1
    return _series(spark, sf).withColumn("many", many).where("many").drop("many")


# Queries in each gap find their piece by the as-of join.
@query(_spline_sql(0.6))
def interp_spline(spark, sf):
    knots = keep(_knots(spark, sf))
    ahead = F.lead("x").over(Window.partitionBy("user_id").orderBy("n"))
    asked = knots.select("user_id", F.col("n").alias("gap"), (F.col("x") + 0.6 * (ahead - F.col("x"))).alias("q")).where("q IS NOT NULL")
    found = interpolation.spline(interpolation.spline_segments(knots, ["user_id"], "x", "y"), asked, ["user_id"], "q")
    return found.select("user_id", "gap", r6("y", 3).alias("y"))


@query(_spline_sql(0.3))
def interp_spline_whole(spark, sf):
    segments = interpolation.spline_segments(_knots(spark, sf), ["user_id"], "x", "y")
    place = F.col("lo") + 0.3 * (F.col("hi") - F.col("lo"))
    return segments.select("user_id", (F.row_number().over(Window.partitionBy("user_id").orderBy("lo")).cast("long") - 1).alias("gap"), r6(interpolation.spline_value(place), 3).alias("y"))


# Each user's purchases are the knots, and the user's other events ask.
_AT = "epoch_us(ts) / 86400000000.0::DOUBLE"
_KNOTS = f"SELECT user_id, event_id, {_AT} AS x, value FROM events WHERE event_type = 'purchase'"
_ASKS = f"SELECT user_id, event_id, {_AT} AS q FROM events WHERE event_type <> 'purchase'"


def _split(spark, sf):
    x = F.unix_micros(F.col("ts").cast("timestamp")) / F.lit(86400000000.0)
    events = table(spark, sf, "events")
    knots = events.where("event_type = 'purchase'").select("user_id", F.col("event_id").alias("knot"), x.alias("x"), "value")
    return knots, events.where("event_type != 'purchase'").select("user_id", "event_id", x.alias("q"))


@query(f"""SELECT event_id, knot, value FROM (SELECT a.event_id, k.event_id AS knot, k.value, row_number() OVER (PARTITION BY a.event_id ORDER BY abs(k.x - a.q), k.x) AS n
FROM ({_ASKS}) a JOIN ({_KNOTS}) k ON k.user_id = a.user_id) WHERE n = 1""")
def interp_nearest(spark, sf):
    knots, asked = _split(spark, sf)
    found = interpolation.nearest(knots, asked, ["user_id"], "x", "q").where("nearest IS NOT NULL")
    return found.select("event_id", "nearest.knot", "nearest.value")


# Straight lines between the purchases around each other event: the last one before it and the first one from it on.
@query(f"""WITH k AS (SELECT user_id, x AS lo, value AS y_lo, lead(x) OVER w AS hi, lead(value) OVER w AS y_hi FROM ({_KNOTS}) WINDOW w AS (PARTITION BY user_id ORDER BY x))
SELECT event_id, round(y_lo + (y_hi - y_lo) * (q - lo) / (hi - lo), 4) + 0.0 AS y FROM ({_ASKS}) a JOIN k ON k.user_id = a.user_id AND q > lo AND q <= hi""")
def interp_linear_as_of(spark, sf):
    knots, asked = _split(spark, sf)
    segments = interpolation.segments_of_samples(knots, ["user_id"], "x", "value")
    found = interpolation.as_of(segments, asked, ["user_id"], "lo", "q", "s", strict=True).where("q <= s.hi")
    y = F.col("s.y_lo") + (F.col("s.y_hi") - F.col("s.y_lo")) * (F.col("q") - F.col("s.lo")) / (F.col("s.hi") - F.col("s.lo"))
    return found.select("event_id", r6(y, 4).alias("y"))


@query(f"""SELECT user_id, event_id, round(((n.v - value) / (n.x - x) - (value - p.v) / (x - p.x)) / (n.x - p.x), 4) + 0.0 AS difference
FROM (SELECT user_id, event_id, x, value, lag({{'x': x, 'v': value}}) OVER w AS p, lead({{'x': x, 'v': value}}) OVER w AS n FROM ({_KNOTS}) WINDOW w AS (PARTITION BY user_id ORDER BY x)) WHERE p IS NOT NULL AND n IS NOT NULL""")
def series_second_differences(spark, sf):
    knots, _ = _split(spark, sf)
    found = interpolation.second_differences(knots, ["user_id"], "x", "value")
    return found.join(knots, ["user_id", "x"]).select("user_id", F.col("knot").alias("event_id"), r6("difference", 4).alias("difference"))


# Nodes of a function at Chebyshev's places, then one node more; the rest of the interpolant is as before.
_CHEBYSHEV = """SELECT p_partkey, b, x, exp(x) AS y, k FROM (SELECT p_partkey, b, k, b / 2 - b / 2 * cos((2 * k + 1) * pi() / 12) AS x FROM (SELECT p_partkey, p_size / 50.0::DOUBLE AS b, unnest(range(0, 6)) AS k FROM part))"""


def _lagrange(nodes: str) -> str:
    return f"""SELECT p_partkey, round(sum(y * f), 7) + 0.0 AS y FROM (SELECT a.p_partkey, a.k, any_value(a.y) AS y, product((0.3 * a.b - o.x) / (a.x - o.x)) AS f
FROM ({nodes}) a JOIN ({nodes}) o ON a.p_partkey = o.p_partkey AND a.k <> o.k GROUP BY a.p_partkey, a.k) GROUP BY p_partkey"""


@query(_lagrange(_CHEBYSHEV))
def interp_from_function(spark, sf):
    known = interpolation.from_function(F.exp, interpolation.chebyshev_nodes(F.lit(0.0), F.col("b"), 5))
    rows = _parts(spark, sf).select("p_partkey", "b", known.alias("nodes"))
    return rows.select("p_partkey", r6(interpolation.barycentric(F.col("nodes"), 0.3 * F.col("b")), 7).alias("y"))


@query(_lagrange(f"{_CHEBYSHEV} UNION ALL SELECT p_partkey, p_size / 50.0::DOUBLE, 2 * p_size / 50.0::DOUBLE, 1, 6 FROM part"))
def interp_update(spark, sf):
    known = interpolation.from_function(F.exp, interpolation.chebyshev_nodes(F.lit(0.0), F.col("b"), 5))
    rows = _parts(spark, sf).select("p_partkey", "b", interpolation.append(known, 2 * F.col("b"), F.lit(1.0)).alias("nodes"))
    return rows.select("p_partkey", r6(interpolation.newton_polynomial(F.col("nodes"), 0.3 * F.col("b")), 7).alias("y"))


# The hours of each day are a series of their own.
_HOURS = "SELECT event_type, epoch_us(ts) // 86400000000 AS day, hour(ts) AS n, count(*)::DOUBLE AS x FROM events GROUP BY ALL"


def _hours(spark, sf):
    day = F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / F.lit(86_400_000_000)).alias("day")
    return table(spark, sf, "events").groupBy("event_type", day, F.hour("ts").alias("n")).agg(F.count("*").cast("double").alias("x"))


@query(f"""SELECT event_type, day, k::INTEGER AS k, round(sum(x * cos(2 * pi() * ((n * k) % 32) / 32)), 6) + 0.0 AS re, round(-sum(x * sin(2 * pi() * ((n * k) % 32) / 32)), 6) + 0.0 AS im
FROM ({_HOURS}), range(32) t(k) GROUP BY event_type, day, k""")
def dft_hourly(spark, sf):
    found = spectral.dft(_hours(spark, sf), ["event_type", "day"], "n", "x", 24)
    return found.select("event_type", "day", "k", r6("re").alias("re"), r6("im").alias("im"))


@query(f"""WITH l AS (SELECT event_type, day, CASE WHEN max(n) = 0 THEN 1 ELSE 1 << (floor(log2(max(n)))::INTEGER + 1) END AS m FROM ({_HOURS}) GROUP BY ALL)
SELECT event_type, day, k::BIGINT AS k, round(sum(x * cos(2 * pi() * ((n * k) % m) / m)), 6) + 0.0 AS re, round(-sum(x * sin(2 * pi() * ((n * k) % m) / m)), 6) + 0.0 AS im
FROM ({_HOURS}) JOIN l USING (event_type, day), range(32) t(k) WHERE k < m GROUP BY event_type, day, k""")
def fft_hourly(spark, sf):
    found = spectral.fft(_hours(spark, sf), ["event_type", "day"], "n", "x")
    return found.select("event_type", "day", "k", r6("re").alias("re"), r6("im").alias("im"))


# Hourly counts over the whole span, of a length that grows with it.
_SPAN = "SELECT event_type, epoch_us(ts) // 3600000000 - (SELECT min(epoch_us(ts) // 3600000000) FROM events) AS n, count(*)::DOUBLE AS x FROM events GROUP BY ALL"


@query(f"""WITH h AS MATERIALIZED ({_SPAN}), l AS (SELECT event_type, CASE WHEN max(n) = 0 THEN 1 ELSE 1 << (floor(log2(max(n)))::INTEGER + 1) END AS m FROM h GROUP BY event_type)
SELECT event_type, k::BIGINT AS k, round(sum(x * cos(2 * pi() * ((n * k) % m) / m)), 5) + 0.0 AS re, round(-sum(x * sin(2 * pi() * ((n * k) % m) / m)), 5) + 0.0 AS im
FROM h JOIN l USING (event_type), (SELECT unnest(range((SELECT max(m) FROM l))) AS k) WHERE k < m GROUP BY event_type, k""")
def fft_whole_span(spark, sf):
    events = table(spark, sf, "events").select("event_type", F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / F.lit(3_600_000_000)).alias("h"))
    start = events.agg(F.min("h").alias("start"))
    hours = events.join(F.broadcast(start)).groupBy("event_type", (F.col("h") - F.col("start")).alias("n")).agg(F.count("*").cast("double").alias("x"))
    found = spectral.fft(hours, ["event_type"], "n", "x")
    return found.select("event_type", "k", r6("re", 5).alias("re"), r6("im", 5).alias("im"))


def _hours_of_events(spark, sf):
    """Events as (user_id, event_id, hours, value), named for SQL text that calls the table functions."""
    table_functions.register(spark, "user_id long, event_id long", "_of_events")
    table(spark, sf, "events").select("user_id", "event_id", (F.unix_micros(F.col("ts").cast("timestamp")) / F.lit(3.6e9)).alias("hours"), "value").createOrReplaceTempView("_hours_of_events")


_HOURS_SQL = "SELECT user_id, event_id, epoch_us(ts) / 3.6e9::DOUBLE AS hours, value FROM events"


@query(f"""SELECT user_id, event_id, round(coalesce(sum(area) OVER (PARTITION BY user_id ORDER BY hours, event_id), 0), 4) + 0.0 AS integral
FROM (SELECT *, (hours - lag(hours) OVER w) * (value + lag(value) OVER w) / 2 AS area FROM ({_HOURS_SQL}) WINDOW w AS (PARTITION BY user_id ORDER BY hours, event_id))""")
def table_function_integral(spark, sf):
    _hours_of_events(spark, sf)
    return spark.sql("""SELECT user_id, event_id, round(integral, 4) + 0.0D AS integral
FROM running_integral_of_events(TABLE(SELECT * FROM _hours_of_events) PARTITION BY user_id ORDER BY (hours, event_id))""")


@query(f"""WITH RECURSIVE e AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY hours, event_id) AS k FROM ({_HOURS_SQL})),
path AS (
  SELECT user_id, event_id, k, hours, value, value AS euler, value AS heun, value AS implicit FROM e WHERE k = 1
  UNION ALL
  SELECT e.user_id, e.event_id, e.k, e.hours, e.value, euler + (e.hours - p.hours) * 0.001::DOUBLE * (p.value - euler),
    heun + (e.hours - p.hours) * 0.001::DOUBLE / 2 * ((p.value - heun) + (e.value - (heun + (e.hours - p.hours) * 0.001::DOUBLE * (p.value - heun)))),
    (implicit + (e.hours - p.hours) * 0.001::DOUBLE * e.value) / (1 + (e.hours - p.hours) * 0.001::DOUBLE)
  FROM path p JOIN e ON e.user_id = p.user_id AND e.k = p.k + 1)
SELECT event_id, method, round(y, 5) + 0.0 AS y FROM (SELECT event_id, unnest(['euler', 'heun', 'implicit']) AS method, unnest([euler, heun, implicit]) AS y FROM path)""")
def table_function_relaxation(spark, sf):
    _hours_of_events(spark, sf)
    one = """SELECT event_id, '{0}' AS method, round(y, 5) + 0.0D AS y
FROM relaxation_of_events(TABLE(SELECT * FROM _hours_of_events) PARTITION BY user_id ORDER BY (hours, event_id), rate => 0.001D, method => '{0}')"""
    return spark.sql(" UNION ALL ".join(one.format(m) for m in table_functions.METHODS))


@query(f"""SELECT user_id, period, count(*) AS n, round(sum(value * cos(2 * pi() * (k % period) / period)), 6) + 0.0 AS cosine,
round(sum(value * sin(2 * pi() * (k % period) / period)), 6) + 0.0 AS sine
FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY hours, event_id) - 1 AS k FROM ({_HOURS_SQL})), (SELECT unnest([24.0::DOUBLE, 7.0::DOUBLE, 2.5::DOUBLE]) AS period)
GROUP BY user_id, period""")
def table_function_fourier(spark, sf):
    _hours_of_events(spark, sf)
    return spark.sql("""SELECT user_id, period, n, round(cosine, 6) + 0.0D AS cosine, round(sine, 6) + 0.0D AS sine
FROM fourier_lines_of_events(TABLE(SELECT * FROM _hours_of_events) PARTITION BY user_id ORDER BY (hours, event_id), periods => array(24.0D, 7.0D, 2.5D))""")
