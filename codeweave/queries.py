"""Registered queries over the driver's tables, each beside the SQL that says the same.

Lines are the rows of ``events``: a unit is a user, a conversation a day, the order is (ts, event_id),
and the codes are the kinds of event.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import layout as L
from .model import CONVERSATION, FIRST, STEP, UNIT, Accumulation
from .operators import accumulate as A
from .operators import fit as M
from .operators import nodes as N
from .operators import normalize as Z
from .operators import plotdata as P
from .operators import rotate as R
from .operators import select as X
from .operators import stats as S
from .operators import tensor as T
from .operators import windows as W
from .plans.linalg import centered_gram, col
from .sources import roles

CODES = ["click", "error", "purchase", "signup", "view"]
PAIRS = [(CODES[i], CODES[j]) for i, j in L.index_pairs(5)]
DIRECTED = [(CODES[i], CODES[j]) for i, j in L.index_pairs(5, "ordered")]
SELF = [(CODES[i], CODES[j]) for i, j in L.index_pairs(5, "self")]
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def flat(name: str) -> str:
    return name.replace(L.SEPARATOR, "__")


def query(sql: str | None = None):
    def put(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return put


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    half = F.when(F.col("user_id") % 2 == 0, "even").otherwise("odd")
    return e.select("event_id", "ts", "user_id", "value", F.to_date("ts").alias("day"), half.alias("half"), F.unix_micros(F.col("ts").cast("timestamp")).alias("us"), *[(F.col("event_type") == c).cast("double").alias(c) for c in CODES])


def acc(spark: SparkSession, sf_dir: str, **options) -> Accumulation:
    return A.accumulate(lines(spark, sf_dir), ["user_id"], ["day"], CODES, ["ts", "event_id"], **({"back": 4, "check_rows": False} | options))


def user(table: DataFrame, names: list[str], digits: int | None = None, *more) -> DataFrame:
    """Connection columns under SQL names, by user."""
    value = (lambda n: F.round(col(n), digits) + 0.0) if digits is not None else col
    return table.select(F.col(UNIT).cast("long").alias("user_id"), *more, *[value(n).alias(flat(n)) for n in names])


# ------------------------------------------------------------------------- SQL
def _join(parts, sep=",\n  ") -> str:
    return sep.join(parts)


EVENTS = "ev AS (SELECT event_id, ts, user_id, value, CAST(ts AS DATE) AS day, CASE WHEN user_id % 2 = 0 THEN 'even' ELSE 'odd' END AS half, epoch_us(ts) AS us,\n  " + _join(f"CAST(event_type = '{c}' AS DOUBLE) AS {c}" for c in CODES) + " FROM events)"


def windows_sql(back: str | None = "3 PRECEDING", forward: str | None = None, source: str = "ev", part: str = "day") -> str:
    h = [f"COALESCE(SUM({c}) OVER (PARTITION BY {part} ORDER BY ts, event_id ROWS BETWEEN {back} AND 1 PRECEDING), 0)" if back else "0.0" for c in CODES]
    t = [f"COALESCE(SUM({c}) OVER (PARTITION BY {part} ORDER BY ts, event_id ROWS BETWEEN 1 FOLLOWING AND {forward}), 0)" if forward else "0.0" for c in CODES]
    return "w AS (SELECT *, " + _join([f"{x} AS h_{c}" for x, c in zip(h, CODES)] + [f"{x} AS t_{c}" for x, c in zip(t, CODES)]) + f" FROM {source})"


WEIGHT = {"binary": "CASE WHEN {0} > 0 THEN 1.0 ELSE 0.0 END", "product": "{0}", "sqrt": "sqrt({0})", "log1p": "ln(1 + ({0}))"}


def cell(a: str, b: str) -> str:
    return f"({a}*{b} + {a}*(h_{b}+t_{b}) + (h_{a}+t_{a})*{b} + h_{a}*t_{b} + t_{a}*h_{b})"


def lines_sql(weight: str = "binary", pairs=PAIRS, gone=(), make=cell) -> str:
    return "ln AS (SELECT event_id, ts, user_id, day, half, value, " + _join("CAST(" + ("0" if (a, b) in gone else WEIGHT[weight].format(make(a, b))) + f" AS DOUBLE) AS {a}__{b}" for a, b in pairs) + " FROM w)"


def unit_sql(pairs=PAIRS, source: str = "ln", by: str = "user_id", more: str = "") -> str:
    return f"SELECT {by}{more}, " + _join(f"SUM({a}__{b}) AS {a}__{b}" for a, b in pairs) + f" FROM {source} GROUP BY {by}"


def counts_sql(weight: str = "binary", back: str | None = "3 PRECEDING", forward: str | None = None, digits: int | None = None, where: str = "") -> str:
    body = unit_sql(source="ln" + (f" WHERE {where}" if where else ""))
    if digits is not None:
        body = f"SELECT user_id, {_join(f'ROUND({a}__{b}, {digits}) + 0.0 AS {a}__{b}' for a, b in PAIRS)} FROM ({body})"
    return f"WITH {EVENTS}, {windows_sql(back, forward)}, {lines_sql(weight)} {body}"


BASE = f"{EVENTS}, {windows_sql()}, {lines_sql()}, u AS ({unit_sql(by='user_id, half')})"
NORM = "sqrt(" + " + ".join(f"{a}__{b}*{a}__{b}" for a, b in PAIRS) + ")"
WEIGHTS = f"{BASE}, n AS (SELECT *, {NORM} AS norm FROM u), s AS (SELECT user_id, half, norm, {_join(f'CASE WHEN norm > 0 THEN {a}__{b} / norm ELSE 0 END AS {a}__{b}' for a, b in PAIRS)} FROM n)"
CENTERED = f"{WEIGHTS}, mu AS (SELECT {_join(f'AVG({a}__{b}) AS m_{a}__{b}' for a, b in PAIRS)} FROM s WHERE norm > 0), c AS (SELECT user_id, half, {_join(f'CASE WHEN norm > 0 THEN {a}__{b} - m_{a}__{b} ELSE 0 END AS {a}__{b}' for a, b in PAIRS)} FROM s, mu)"


def rounded(pairs=PAIRS, digits: int = 9) -> str:
    return _join(f"ROUND({a}__{b}, {digits}) + 0.0 AS {a}__{b}" for a, b in pairs)


# ------------------------------------------------------------- line-level windows
def _rows(table: Accumulation) -> DataFrame:
    return table.lines.select(F.col(FIRST)["o1"].alias("event_id"), *[col(n).alias(flat(n)) for n in table.names])


def rows_sql(weight: str, back: str | None, forward: str | None) -> str:
    return f"WITH {EVENTS}, {windows_sql(back, forward)}, {lines_sql(weight)} SELECT event_id, {_join(f'{a}__{b}' for a, b in PAIRS)} FROM ln"


@query(rows_sql("binary", "3 PRECEDING", None))
def stanza_rows_w4_binary(spark, sf_dir):
    return _rows(acc(spark, sf_dir))


@query(rows_sql("product", "3 PRECEDING", None))
def stanza_rows_w4_product(spark, sf_dir):
    return _rows(acc(spark, sf_dir, weight="product"))


@query(rows_sql("product", "3 PRECEDING", "2 FOLLOWING"))
def stanza_rows_forward2(spark, sf_dir):
    return _rows(acc(spark, sf_dir, weight="product", forward=2))


@query(rows_sql("product", "UNBOUNDED PRECEDING", None))
def stanza_rows_infinite(spark, sf_dir):
    return _rows(acc(spark, sf_dir, weight="product", back=A.INFINITE))


# ------------------------------------------------------------------- unit counts
@query(counts_sql())
def unit_counts_binary(spark, sf_dir):
    a = acc(spark, sf_dir)
    return user(a.counts, a.names)


@query(counts_sql("product"))
def unit_counts_product(spark, sf_dir):
    a = acc(spark, sf_dir, weight="product")
    return user(a.counts, a.names)


@query(counts_sql("sqrt", digits=6))
def unit_counts_sqrt(spark, sf_dir):
    a = acc(spark, sf_dir, weight="sqrt")
    return user(a.counts, a.names, 6)


@query(counts_sql("log1p", digits=6))
def unit_counts_log1p(spark, sf_dir):
    a = acc(spark, sf_dir, weight="log1p")
    return user(a.counts, a.names, 6)


@query(counts_sql("product", back=None))
def single_line_counts(spark, sf_dir):
    a = acc(spark, sf_dir, weight="product", back=1)
    return user(a.counts, a.names)


@query(counts_sql(where="user_id % 3 = 0"))
def units_used_counts(spark, sf_dir):
    a = acc(spark, sf_dir, units_used=lines(spark, sf_dir).select("user_id").where("user_id % 3 = 0").distinct())
    return user(a.counts, a.names)


@query(f"WITH {EVENTS}, g AS (SELECT day, user_id, {_join(f'SUM({c}) AS {c}' for c in CODES)} FROM ev GROUP BY day, user_id) SELECT user_id, {_join(f'SUM({a} * {b}) AS {a}__{b}' for a, b in PAIRS)} FROM g GROUP BY user_id")
def conversation_window_counts(spark, sf_dir):
    a = acc(spark, sf_dir, weight="product", window="Conversation")
    return user(a.counts, a.names)


@query(f"WITH {EVENTS}, {windows_sql()}, {lines_sql('product', DIRECTED, make=lambda a, b: f'(h_{a}*{b}' + (f' + 0.5*{a}*{b})' if a != b else ')'))} {unit_sql(DIRECTED)}")
def ordered_unit_counts(spark, sf_dir):
    a = acc(spark, sf_dir, weight="product", ordered=True)
    return user(a.counts, a.names)


@query(f"WITH {EVENTS}, {windows_sql()}, {lines_sql('product', SELF, make=lambda a, b: cell(a, b) if a != b else f'(h_{a}*{a})')} {unit_sql(SELF)}")
def self_connection_counts(spark, sf_dir):
    a = acc(spark, sf_dir, weight="product", self_connections=True)
    return user(a.counts, a.names)


@query(f"WITH {EVENTS}, {windows_sql()}, {lines_sql('product', DIRECTED, make=lambda a, b: f'(h_{a} * CASE WHEN {b} = 0 THEN 1.0 ELSE 0.0 END)')} {unit_sql(DIRECTED)}")
def miss_counts(spark, sf_dir):
    a = acc(spark, sf_dir, misses=True)
    return user(a.misses, L.pair_names(CODES, "ordered"))


@query(f"WITH {EVENTS}, {windows_sql()}, {lines_sql('binary', gone={('click', 'error'), ('purchase', 'view')})} {unit_sql()}")
def masked_counts(spark, sf_dir):
    mask = np.ones((5, 5), int)
    mask[0, 1] = mask[4, 2] = 0
    a = acc(spark, sf_dir, mask=mask)
    return user(a.counts, a.names)


STEPS = f"{EVENTS}, {windows_sql()}, {lines_sql()}, st AS (SELECT user_id, day, MIN(ts) AS first_ts, MIN(event_id) AS fe, {_join(f'SUM({a}__{b}) AS {a}__{b}' for a, b in PAIRS)} FROM ln GROUP BY user_id, day)"


@query(f"WITH {STEPS} SELECT user_id, day, ROW_NUMBER() OVER (PARTITION BY user_id ORDER BY first_ts) AS step, {_join(f'{a}__{b}' for a, b in PAIRS)} FROM st")
def separate_trajectory(spark, sf_dir):
    a = acc(spark, sf_dir, model="SeparateTrajectory")
    return user(a.counts, a.names, None, F.col("day"), F.col(STEP).cast("long").alias("step"))


@query(f"WITH {STEPS} SELECT user_id, day, ROW_NUMBER() OVER (PARTITION BY user_id ORDER BY first_ts) AS step, {_join(f'SUM({a}__{b}) OVER (PARTITION BY user_id ORDER BY first_ts ROWS UNBOUNDED PRECEDING) AS {a}__{b}' for a, b in PAIRS)} FROM st")
def accumulated_trajectory(spark, sf_dir):
    a = acc(spark, sf_dir, model="AccumulatedTrajectory")
    return user(a.counts, a.names, None, F.col("day"), F.col(STEP).cast("long").alias("step"))


@query(f"WITH {EVENTS}, {windows_sql()}, {lines_sql()}, d AS (SELECT user_id, day, {_join(f'SUM({a}__{b}) AS {a}__{b}' for a, b in PAIRS)} FROM ln GROUP BY user_id, day) SELECT user_id, day, {_join(f'SUM({a}__{b}) OVER (PARTITION BY user_id ORDER BY day ROWS UNBOUNDED PRECEDING) AS {a}__{b}' for a, b in PAIRS)} FROM d")
def movie_frames(spark, sf_dir):
    a = acc(spark, sf_dir)
    return user(P.frames(a.lines, a.names, "day"), a.names, None, F.col("day"))


@query("SELECT user_id, arg_min(CASE WHEN user_id % 2 = 0 THEN 'even' ELSE 'odd' END, (ts, event_id)) AS half FROM events GROUP BY user_id")
def unit_metadata(spark, sf_dir):
    meta = A.unit_metadata(lines(spark, sf_dir), ["user_id"], ["ts", "event_id"], ["half", "day", "value"])
    return meta.select("user_id", *[c for c in meta.columns if c not in (UNIT, "user_id")])


@query(f"WITH {BASE} " + " UNION ALL ".join(f"SELECT user_id, '{a}' AS code, {_join((f'{a}__{b}' if (a, b) in PAIRS else 'CAST(NULL AS DOUBLE)') + f' AS to_{b}' for b in CODES)} FROM u" for a in CODES))
def connection_matrices(spark, sf_dir):
    a = acc(spark, sf_dir)
    m = A.connection_matrix(a.counts, CODES)
    return m.select(F.col(UNIT).cast("long").alias("user_id"), "code", *[col(c).alias("to_" + c) for c in CODES])


# ------------------------------------------------------- tensors, times, horizons
def pairs_sql(near: str, weight: str = "1.0") -> str:
    """Grounds by a join of each line with earlier ones of its day."""
    ground = ", ".join(f"SUM({weight} * g.{c}) AS h_{c}" for c in CODES)
    return (
        f"{EVENTS}, nn AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY day ORDER BY ts, event_id) AS n FROM ev), "
        f"hh AS (SELECT r.event_id, {ground} FROM nn r JOIN nn g ON r.day = g.day AND g.n < r.n AND {near} GROUP BY r.event_id), "
        f"w AS (SELECT nn.*, {_join([f'COALESCE(hh.h_{c}, 0) AS h_{c}' for c in CODES] + [f'0.0 AS t_{c}' for c in CODES])} FROM nn LEFT JOIN hh USING (event_id))"
    )


TENSOR = T.Tensor([("half", "sender")], {("even",): (1.0, 6), ("odd",): (1.0, 3)}, (1.0, 4))


@query(f"WITH {pairs_sql('r.n - g.n < CASE WHEN g.half = ' + chr(39) + 'even' + chr(39) + ' THEN 6 ELSE 3 END')}, {lines_sql()} {unit_sql()}")
def tensor_sender_counts(spark, sf_dir):
    a = T.accumulate_tensor(lines(spark, sf_dir), ["user_id"], ["day"], CODES, ["ts", "event_id"], TENSOR, check_rows=False)
    return user(a.counts, a.names)


RECEIVER = T.Tensor([("half", "receiver")], {("even",): (1.0, 2), ("odd",): (1.0, 5)}, (1.0, 4))


@query(f"WITH {pairs_sql('r.n - g.n < CASE WHEN r.half = ' + chr(39) + 'even' + chr(39) + ' THEN 2 ELSE 5 END')}, {lines_sql()} {unit_sql()}")
def tensor_receiver_counts(spark, sf_dir):
    a = T.accumulate_tensor(lines(spark, sf_dir), ["user_id"], ["day"], CODES, ["ts", "event_id"], RECEIVER, check_rows=False)
    return user(a.counts, a.names)


MODE = T.Tensor([("half", "mode"), ("half", "receiver")], {("even", "even"): (1.0, 5), ("even", "odd"): (1.0, 3), ("odd", "even"): (1.0, 2), ("odd", "odd"): (1.0, 6)}, (1.0, 4))


@query(f"WITH {pairs_sql('r.n - g.n < CASE g.half || r.half ' + ' '.join(f'WHEN {chr(39)}{a}{b}{chr(39)} THEN {w}' for a, b, w in (('even', 'even', 5), ('even', 'odd', 3), ('odd', 'even', 2), ('odd', 'odd', 6))) + ' END')}, {lines_sql()} {unit_sql()}")
def tensor_mode_counts(spark, sf_dir):
    a = T.accumulate_tensor(lines(spark, sf_dir), ["user_id"], ["day"], CODES, ["ts", "event_id"], MODE, check_rows=False)
    return user(a.counts, a.names)


@query(f"WITH {pairs_sql('(r.us / 1e6 + r.user_id % 7 * 60) - (g.us / 1e6 + g.user_id % 7 * 60) < 600')}, {lines_sql()} {unit_sql()}")
def time_window_end_counts(spark, sf_dir):
    """Lines stand at their ends: a numeric end is a duration after the start."""
    df = lines(spark, sf_dir).withColumn("sec", F.col("us") / 1e6).withColumn("lasts", F.col("user_id") % 7 * 60.0)
    t = T.Tensor(default=(1.0, 10), time="sec", time_unit="mins", time_end="lasts")
    a = T.accumulate_tensor(df, ["user_id"], ["day"], CODES, ["ts", "event_id"], t, numeric_time=True, check_rows=False)
    return user(a.counts, a.names)


COLLIDING = ("CASE WHEN user_id % 2 = 0 THEN 'a::b' ELSE 'a' END", "CASE WHEN user_id % 2 = 0 THEN 'c' ELSE 'b::c' END")


@query(f"WITH {EVENTS}, kk AS (SELECT *, {COLLIDING[0]} AS k1, {COLLIDING[1]} AS k2 FROM ev), {windows_sql(source='kk', part='k1, k2')}, {lines_sql()} {unit_sql()}")
def colliding_keys_counts(spark, sf_dir):
    """Conversations whose key columns join into one plain key stay two."""
    df = lines(spark, sf_dir).withColumn("k1", F.expr(COLLIDING[0])).withColumn("k2", F.expr(COLLIDING[1]))
    a = A.accumulate(df, ["user_id"], ["k1", "k2"], CODES, ["ts", "event_id"], back=4, check_rows=False)
    return user(a.counts, a.names)


@query(f"WITH {pairs_sql('r.us - g.us < 600000000')}, {lines_sql()} {unit_sql()}")
def time_window_counts(spark, sf_dir):
    df = lines(spark, sf_dir).withColumn("sec", F.col("us") / 1e6)
    t = T.Tensor(default=(1.0, 10), time="sec", time_unit="mins")
    a = T.accumulate_tensor(df, ["user_id"], ["day"], CODES, ["ts", "event_id"], t, numeric_time=True, check_rows=False)
    return user(a.counts, a.names)


def horizon_sql() -> str:
    members = "has AS (SELECT DISTINCT user_id AS unit, day FROM ev), ctx AS (SELECT ev.*, has.unit FROM ev JOIN has USING (day) WHERE half = 'even' OR half = 'odd')"
    return f"WITH {EVENTS}, {members}, {windows_sql(source='ctx', part='unit, day')}, own AS (SELECT * FROM w WHERE unit = user_id), {lines_sql().replace('FROM w)', 'FROM own)')} {unit_sql()}"


@query(horizon_sql())
def flexible_horizon_counts(spark, sf_dir):
    a = T.accumulate_horizons(lines(spark, sf_dir), ["user_id"], CODES, ["ts", "event_id"], "half", {"even": ["day"], "odd": ["day"]}, back=4)
    return user(a.counts, a.names)


def two_rules_sql() -> str:
    members = "hd AS (SELECT DISTINCT user_id AS unit, day FROM ev), hu AS (SELECT DISTINCT user_id AS unit, user_id FROM ev), ctx AS (SELECT ev.*, hd.unit FROM ev JOIN hd USING (day) WHERE half = 'even' UNION ALL SELECT ev.*, hu.unit FROM ev JOIN hu USING (user_id) WHERE half = 'odd')"
    return f"WITH {EVENTS}, {members}, {windows_sql(source='ctx', part='unit, day, user_id')}, own AS (SELECT * FROM w WHERE unit = user_id), {lines_sql().replace('FROM w)', 'FROM own)')} {unit_sql()}"


@query(two_rules_sql())
def two_horizon_rules_counts(spark, sf_dir):
    a = T.accumulate_horizons(lines(spark, sf_dir), ["user_id"], CODES, ["ts", "event_id"], "half", {"even": ["day"], "odd": ["user_id"]}, back=4)
    return user(a.counts, a.names)


# ------------------------------------------------------ normalising and projecting
def weights(spark, sf_dir) -> tuple[Accumulation, DataFrame]:
    a = acc(spark, sf_dir)
    half = F.when(F.col("user_id") % 2 == 0, "even").otherwise("odd")
    return a, Z.sphere_norm(a.counts, a.names).withColumn("half", half)


def centered(spark, sf_dir) -> tuple[Accumulation, DataFrame]:
    a, w = weights(spark, sf_dir)
    w = w.cache()
    return a, Z.center(w, a.names, Z.center_vector(w, a.names))


@query(f"WITH {WEIGHTS} SELECT user_id, {rounded()} FROM s")
def line_weights_sphere(spark, sf_dir):
    a, w = weights(spark, sf_dir)
    return user(w, a.names, 9)


@query(f"WITH {BASE}, n AS (SELECT *, {NORM} AS norm FROM u) SELECT user_id, {_join(f'ROUND({a}__{b} / (SELECT MAX(norm) FROM n), 9) + 0.0 AS {a}__{b}' for a, b in PAIRS)} FROM n")
def line_weights_skip_sphere(spark, sf_dir):
    a = acc(spark, sf_dir)
    return user(Z.skip_sphere_norm(a.counts, a.names), a.names, 9)


@query(f"WITH {CENTERED} SELECT user_id, {rounded()} FROM c")
def centered_networks(spark, sf_dir):
    a, c = centered(spark, sf_dir)
    return user(c, a.names, 9)


@query(f"WITH {WEIGHTS} SELECT half, {_join(f'ROUND(AVG({a}__{b}), 9) + 0.0 AS {a}__{b}' for a, b in PAIRS)} FROM s GROUP BY half")
def group_mean_networks(spark, sf_dir):
    a, w = weights(spark, sf_dir)
    g = S.group(w, "half", a.names)
    return g.select("half", *[(F.round(col(n), 9) + 0.0).alias(flat(n)) for n in a.names])


@query(f"WITH {WEIGHTS} SELECT {_join(f'ROUND(AVG(CASE WHEN half = {chr(39)}even{chr(39)} THEN {a}__{b} END) - AVG(CASE WHEN half = {chr(39)}odd{chr(39)} THEN {a}__{b} END), 9) + 0.0 AS {a}__{b}' for a, b in PAIRS)} FROM s")
def subtraction_network(spark, sf_dir):
    a, w = weights(spark, sf_dir)
    d = S.subtraction(w, a.names, F.col("half") == "even", F.col("half") == "odd")
    return d.select(*[(F.round(col(n), 9) + 0.0).alias(flat(n)) for n in a.names])


DIFF = [f"(AVG(CASE WHEN half = 'even' THEN {a}__{b} END) - AVG(CASE WHEN half = 'odd' THEN {a}__{b} END)) AS d_{a}__{b}" for a, b in PAIRS]
AXIS = f"{CENTERED}, df AS (SELECT {_join(DIFF)} FROM c)"
DNORM = "sqrt(" + " + ".join(f"d_{a}__{b}*d_{a}__{b}" for a, b in PAIRS) + ")"


@query(f"WITH {AXIS} SELECT user_id, ROUND(({' + '.join(f'{a}__{b}*d_{a}__{b}' for a, b in PAIRS)}) / {DNORM}, 8) + 0.0 AS mr1 FROM c, df")
def means_rotation_points_mr1(spark, sf_dir):
    a, c = centered(spark, sf_dir)
    space = R.Space.of(c, a.names)
    r = R.means_rotation(space, [R.group_pair("half", "even", "odd")])
    return Z.project(c, a.names, r.matrix[:, :1], ["mr1"]).select(F.col(UNIT).cast("long").alias("user_id"), (F.round("mr1", 8) + 0.0).alias("mr1"))


@query(f"WITH {CENTERED} " + " UNION ALL ".join(f"SELECT '{a}__{b}' AS row_name, '{c}__{d}' AS col_name, ROUND(SUM({a}__{b}*{c}__{d}), 7) + 0.0 AS value FROM c" for a, b in PAIRS for c, d in PAIRS))
def gram_matrix(spark, sf_dir):
    a, c = centered(spark, sf_dir)
    _, _, g = centered_gram(c, a.names, np.zeros(len(a.names)))
    rows = [(flat(x), flat(y), round(float(g[i, j]), 7) + 0.0) for i, x in enumerate(a.names) for j, y in enumerate(a.names)]
    return spark.createDataFrame(rows, "row_name string, col_name string, value double")


NODEW = {c: "(" + " + ".join(f"0.5*{a}__{b}" for a, b in PAIRS if c in (a, b)) + ")" for c in CODES}
NODESUM = " + ".join(f"ABS(w_{c})" for c in CODES)
NODES = f"{WEIGHTS}, nw0 AS (SELECT user_id, norm, {_join(f'{NODEW[c]} AS w_{c}' for c in CODES)} FROM s), nw AS (SELECT user_id, norm, {_join(f'w_{c} / GREATEST({NODESUM}, 0.0001) AS w_{c}' for c in CODES)} FROM nw0)"


@query(f"WITH {NODES} SELECT user_id, {_join(f'ROUND(w_{c}, 9) + 0.0 AS {c}' for c in CODES)} FROM nw")
def node_weights(spark, sf_dir):
    a, w = weights(spark, sf_dir)
    n = N.node_weights(w, a.names, L.index_pairs(5), CODES)
    return n.select(F.col(UNIT).cast("long").alias("user_id"), *[(F.round(col(c), 9) + 0.0).alias(c) for c in CODES])


@query(f"WITH {NODES} " + " UNION ALL ".join(f"SELECT '{a}' AS code_a, '{b}' AS code_b, ROUND(SUM(w_{a}*w_{b}), 7) + 0.0 AS value FROM nw" for a in CODES for b in CODES))
def node_normal_matrix(spark, sf_dir):
    a, w = weights(spark, sf_dir)
    from .plans.linalg import cross

    g = cross(N.node_weights(w, a.names, L.index_pairs(5), CODES), CODES)
    return spark.createDataFrame([(x, y, round(float(g[i, j]), 7) + 0.0) for i, x in enumerate(CODES) for j, y in enumerate(CODES)], "code_a string, code_b string, value double")


# --------------------------------------------------------------------- statistics
@query(f"WITH {WEIGHTS} SELECT half, COUNT(*) AS n, ROUND(AVG(click__error), 9) + 0.0 AS mean, ROUND(VAR_SAMP(click__error), 9) + 0.0 AS variance, ROUND(MEDIAN(click__error), 9) + 0.0 AS median FROM s GROUP BY half")
def group_moments(spark, sf_dir):
    _, w = weights(spark, sf_dir)
    m = S.moments(w.withColumn("x", col("click & error")), "half", ["x"])
    return m.select("half", "n", (F.round("x_mean", 9) + 0.0).alias("mean"), (F.round("x_var", 9) + 0.0).alias("variance"), (F.round("x_median", 9) + 0.0).alias("median"))


def _named(spark, values: dict[str, tuple], columns: list[str], digits: int = 8) -> DataFrame:
    return spark.createDataFrame([(k, *[round(float(x), digits) + 0.0 for x in v]) for k, v in values.items()], "name string, " + ", ".join(f"{c} double" for c in columns))


@query(f"WITH {WEIGHTS} SELECT 'x' AS name, ROUND(-1.5*(quantile_cont(click__error, 0.75) - quantile_cont(click__error, 0.25)), 8) + 0.0 AS low, ROUND(1.5*(quantile_cont(click__error, 0.75) - quantile_cont(click__error, 0.25)), 8) + 0.0 AS high FROM s")
def outlier_intervals(spark, sf_dir):
    _, w = weights(spark, sf_dir)
    return _named(spark, S.outlier_intervals(w.withColumn("x", col("click & error")), ["x"]), ["low", "high"])


@query(f"WITH {WEIGHTS}, m AS (SELECT COUNT(CASE WHEN half='even' THEN 1 END) n1, AVG(CASE WHEN half='even' THEN click__error END) m1, VAR_SAMP(CASE WHEN half='even' THEN click__error END) v1, COUNT(CASE WHEN half='odd' THEN 1 END) n2, AVG(CASE WHEN half='odd' THEN click__error END) m2, VAR_SAMP(CASE WHEN half='odd' THEN click__error END) v2 FROM s) SELECT 'd' AS name, ROUND(ABS(m1-m2) / sqrt(((n1-1)*v1 + (n2-1)*v2) / (n1+n2-2)), 8) + 0.0 AS value FROM m")
def cohens_d(spark, sf_dir):
    _, w = weights(spark, sf_dir)
    return _named(spark, {"d": (S.cohens_d(w.withColumn("x", col("click & error")), "x", F.col("half") == "even", F.col("half") == "odd"),)}, ["value"])


@query(f"WITH {WEIGHTS}, r AS (SELECT half, RANK() OVER (ORDER BY click__error) + (COUNT(*) OVER (PARTITION BY click__error) - 1) / 2.0 AS rk FROM s) SELECT half, COUNT(*) AS n, CAST(SUM(rk) AS DOUBLE) AS rank_sum FROM r GROUP BY half")
def rank_sums(spark, sf_dir):
    _, w = weights(spark, sf_dir)
    r = S.average_ranks(w.select("half", col("click & error").alias("x")), "x")
    return r.groupBy("half").agg(F.count("*").alias("n"), F.sum("rank").cast("double").alias("rank_sum"))


@query(
    f"WITH {WEIGHTS}, f AS (SELECT user_id, MIN(ts) AS first_ts FROM events GROUP BY user_id), i AS (SELECT ROW_NUMBER() OVER (ORDER BY first_ts) AS n, click__error AS x, click__purchase AS y FROM s JOIN f USING (user_id)) "
    "SELECT 'r' AS name, ROUND(CORR(a.x - b.x, a.y - b.y), 8) + 0.0 AS value FROM i a JOIN i b ON a.n < b.n"
)
def fit_correlation_closed_form(spark, sf_dir):
    _, w = weights(spark, sf_dir)
    x = w.select(UNIT, FIRST, col("click & error").alias("x"))
    y = w.select(UNIT, col("click & purchase").alias("x"))
    return _named(spark, {"r": S.fit_correlation(x, y, ["x"], [UNIT], FIRST)["x"][:1]}, ["value"])


# ------------------------------------------------------------- window estimators
def types_sql(most: int) -> str:
    one = lambda w: f"SELECT CAST(day AS VARCHAR) AS conversation, {w} AS \"window\", {' + '.join(f'CAST(MAX({c}) OVER (PARTITION BY day ORDER BY ts, event_id ROWS BETWEEN {w - 1} PRECEDING AND CURRENT ROW) AS BIGINT) * {1 << k}' for k, c in enumerate(CODES))} AS ground_type FROM ev"
    return f"{EVENTS}, ty AS ({' UNION ALL '.join(one(w) for w in range(1, most + 1))}), gt AS (SELECT conversation, \"window\", ground_type, COUNT(*) AS n FROM ty GROUP BY ALL)"


def _types(spark, sf_dir, most):
    return W.ground_types(lines(spark, sf_dir), CODES, ["day"], ["ts", "event_id"], most)


@query(f'WITH {types_sql(3)} SELECT conversation, ground_type, n FROM gt WHERE "window" = 3')
def ground_type_counts_w3(spark, sf_dir):
    return _types(spark, sf_dir, 3).where("window = 3").select("conversation", "ground_type", "n")


ENTROPY = f'{types_sql(6)}, pe AS (SELECT "window", conversation, SUM(n) AS nn, (ln(SUM(n)) - SUM(n * ln(n)) / SUM(n)) / (5 * ln(2)) AS e FROM gt GROUP BY 1, 2), po AS (SELECT "window", ground_type, SUM(n) AS n FROM gt GROUP BY 1, 2)'


@query(f"WITH {ENTROPY} SELECT 'mean' AS method, \"window\", ROUND(AVG(e), 8) + 0.0 AS entropy FROM pe GROUP BY 2 UNION ALL SELECT 'weighted', \"window\", ROUND(SUM(e * nn) / SUM(nn), 8) + 0.0 FROM pe GROUP BY 2 UNION ALL SELECT 'pooled', \"window\", ROUND((ln(SUM(n)) - SUM(n * ln(n)) / SUM(n)) / (5 * ln(2)), 8) + 0.0 FROM po GROUP BY 2")
def ground_entropy_curves(spark, sf_dir):
    c = W.ground_curves(_types(spark, sf_dir, 6), 5)
    return c.select("method", "window", (F.round("entropy", 8) + 0.0).alias("entropy"))


@query(f'WITH {ENTROPY}, cu AS (SELECT "window", AVG(e) AS e FROM pe GROUP BY 1) SELECT "window", ROUND(e, 8) + 0.0 AS entropy FROM cu ORDER BY e DESC, "window" LIMIT 1')
def ground_diversity_peak(spark, sf_dir):
    return W.ground_peak(W.ground_entropy(_types(spark, sf_dir, 6), 5)).select("window", (F.round("entropy", 8) + 0.0).alias("entropy"))


def ccd_sql(most: int, overlap: int) -> str:
    cov = _join(f"AVG(b.{x} * a.{y}) - AVG(b.{x}) * AVG(a.{y}) AS c_{x}_{y}" for x in CODES for y in CODES)
    tr = lambda s: " + ".join(f"VAR_SAMP({s}.{c})" for c in CODES)
    norm = " + ".join(f"POWER(SUM(w * c_{x}_{y}) / SUM(w), 2)" for x in CODES for y in CODES)
    return (
        f"{EVENTS}, nn AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY day ORDER BY ts, event_id) AS n FROM ev), "
        f"pl AS (SELECT a.day, l.lag, COUNT(*) AS w, ({tr('a')}) * ({tr('b')}) AS noise, {cov} FROM (SELECT UNNEST(range(0, {most + 1})) AS lag) l JOIN nn b ON true JOIN nn a ON a.day = b.day AND a.n = b.n + l.lag GROUP BY 1, 2 HAVING COUNT(*) >= {overlap}), "
        f"cu AS (SELECT lag, {norm} - SUM(w * noise) / (SUM(w) * SUM(w)) AS corrected FROM pl GROUP BY lag)"
    )


@query(f"WITH {ccd_sql(5, 10)} SELECT CAST(lag AS INTEGER) AS lag, ROUND(corrected, 8) + 0.0 AS corrected FROM cu")
def ccd_curves(spark, sf_dir):
    return W.lag_curve(lines(spark, sf_dir), CODES, ["day"], ["ts", "event_id"], 5, 10).select("lag", (F.round("corrected", 8) + 0.0).alias("corrected"))


@query(
    f"WITH {ccd_sql(5, 10)}, sg AS (SELECT lag, sign(corrected) * sqrt(abs(corrected)) AS s FROM cu WHERE lag >= 1), pk AS (SELECT lag AS peak, s AS top FROM sg WHERE s > 0 ORDER BY s DESC, lag LIMIT 1) "
    'SELECT CAST(COALESCE((SELECT MIN(lag) FROM sg, pk WHERE lag >= peak AND s / top <= 0.5), CASE WHEN (SELECT COUNT(*) FROM pk) = 0 THEN 1 ELSE (SELECT MAX(lag) FROM sg) END) AS INTEGER) AS "window", CAST(COALESCE((SELECT peak FROM pk), 0) AS INTEGER) AS peak_lag'
)
def ccd_window(spark, sf_dir):
    f = W.lag_window(lines(spark, sf_dir), CODES, ["day"], ["ts", "event_id"], 5, 10)
    return spark.createDataFrame([(f.window, f.peak_lag)], "window int, peak_lag int")


# --------------------------------------------------------------------- selection
HITS = f"{EVENTS}, k AS (SELECT *, {_join(f'SUM({c}) OVER (PARTITION BY day ORDER BY ts, event_id ROWS BETWEEN 3 PRECEDING AND CURRENT ROW) AS s_{c}' for c in CODES[:2])}, ROW_NUMBER() OVER (PARTITION BY day ORDER BY ts, event_id) AS n FROM ev), hit AS (SELECT * FROM k WHERE user_id % 2 = 0 AND (click > 0 OR error > 0) AND s_click > 0 AND s_error > 0)"


def _connection(spark, sf_dir) -> X.ConnectionLines:
    df = lines(spark, sf_dir)
    units = df.where("user_id % 2 = 0").select("user_id").distinct()
    return X.connection_lines(df, units, ["user_id"], ["click", "error"], ["day"], ["ts", "event_id"], 4)


@query(f"WITH {HITS} SELECT DISTINCT k.event_id, k.user_id FROM k JOIN hit ON k.day = hit.day AND k.n BETWEEN hit.n - 3 AND hit.n")
def window_rows_for_connection(spark, sf_dir):
    return _connection(spark, sf_dir).windows.select("event_id", "user_id")


@query(f"WITH {HITS} SELECT event_id, user_id FROM k WHERE user_id % 2 = 0 AND (click > 0 OR error > 0) AND NOT (s_click > 0 AND s_error > 0)")
def removed_rows_for_connection(spark, sf_dir):
    return _connection(spark, sf_dir).removed.select("event_id", "user_id")


@query(
    f"WITH {EVENTS}, v AS (SELECT user_id, day, SUM(click) AS click FROM ev GROUP BY 1, 2), g AS (SELECT a.user_id, b.day FROM (SELECT DISTINCT user_id FROM v) a, (SELECT DISTINCT day FROM v) b) "
    "SELECT g.user_id, g.day, COALESCE(LAST_VALUE(v.click IGNORE NULLS) OVER (PARTITION BY g.user_id ORDER BY g.day ROWS UNBOUNDED PRECEDING), 0) AS click FROM g LEFT JOIN v USING (user_id, day)"
)
def trajectory_fill_forward(spark, sf_dir):
    v = lines(spark, sf_dir).groupBy("user_id", "day").agg(F.sum("click").alias("click"))
    return P.fill_forward(v, "user_id", "day", ["click"])


@query("SELECT UNNEST(['" + "', '".join(CODES) + "']) AS name")
def binary_columns(spark, sf_dir):
    return spark.createDataFrame([(c,) for c in roles.find_binary(lines(spark, sf_dir).select("event_id", "user_id", "half", *CODES))], "name string")


@query()
def detect_roles(spark, sf_dir):
    found = roles.detect(lines(spark, sf_dir).select("user_id", "day", "half", "value", *CODES))
    return spark.createDataFrame(sorted(found["roles"].items()), "name string, role string")


# ------------------------------------------------------------------ whole models
def model(spark, sf_dir, **options) -> M.Model:
    a = acc(spark, sf_dir)
    a.metadata = A.unit_metadata(lines(spark, sf_dir), ["user_id"], ["ts", "event_id"], ["half", "value"], constant=False)
    return M.fit(a, **options)


def _points(m) -> DataFrame:
    return m.points.select(F.col(UNIT).cast("long").alias("user_id"), *[(F.round(col(d), 6) + 0.0).alias(d.lower()) for d in m.dimensions])


# SQL for models.  A matrix is a list of rows; leading axes come from squaring a Gram matrix 16 times (its power 65,536), inverses
# from elimination, so that the SQL shares no step with the decompositions of the library.
ROW = "[" + ", ".join(f"{a}__{b}" for a, b in PAIRS) + "]"
GRAM = "gm AS (SELECT [" + ", ".join("[" + ", ".join(f"SUM({a}__{b} * {x}__{y})" for x, y in PAIRS) + "]" for a, b in PAIRS) + "] AS g FROM c)"
COVARIANCE = "gc AS (SELECT [" + ", ".join("[" + ", ".join(f"COUNT(*) * COVAR_POP({a}__{b}, {x}__{y})" for x, y in PAIRS) + "]" for a, b in PAIRS) + "] AS g FROM c)"


def leading_sql(name: str, matrix: str, n: int = 10) -> str:
    """CTE ``name`` with ``v``, the leading unit axis of a symmetric matrix ``g``, its largest loading positive."""
    return (
        f"{name}_i(k, m) AS (SELECT 0, g FROM {matrix} UNION ALL SELECT k + 1, list_transform(z, lambda r: list_transform(z, lambda q: list_dot_product(r, q))) FROM "
        f"(SELECT k, list_transform(m, lambda r: list_transform(r, lambda x: x / t)) AS z FROM (SELECT k, m, list_sum(list_transform(range(1, {n + 1}), lambda i: m[i][i])) AS t FROM {name}_i WHERE k < 16))), "
        f"{name}_r AS (SELECT m[list_position(d, list_max(d))] AS r, sign(list_max(d)) AS s FROM (SELECT m, list_transform(range(1, {n + 1}), lambda i: m[i][i]) AS d FROM {name}_i WHERE k = 16)), "
        f"{name} AS (SELECT list_transform(r, lambda x: x / sqrt(list_dot_product(r, r))) AS v FROM {name}_r)"
    )


def without_sql(name: str, matrix: str, axis: str, n: int = 10) -> str:
    """CTE ``name`` with the matrix of data without their component along a unit axis."""
    p = f"list_transform(range(1, {n + 1}), lambda i: list_transform(range(1, {n + 1}), lambda j: (CASE WHEN i = j THEN 1.0 ELSE 0.0 END) - v[i] * v[j]))"
    return f"{name} AS (SELECT list_transform(p, lambda a: list_transform(p, lambda b: list_dot_product(a, list_transform(g, lambda r: list_dot_product(r, b))))) AS g FROM (SELECT g, {p} AS p FROM {matrix}, {axis}))"


def inverse_sql(name: str, matrix: str, n: int) -> str:
    """CTE ``name`` with ``y``, the inverse of a symmetric positive matrix ``g``, by elimination beside the unit matrix."""
    wide = f"list_transform(range(1, {n + 1}), lambda i: list_concat(g[i], list_transform(range(1, {n + 1}), lambda j: CASE WHEN i = j THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END)))"
    step = f"list_transform(range(1, {n + 1}), lambda i: list_transform(range(1, {2 * n + 1}), lambda j: CASE WHEN i = k THEN m[k][j] / m[k][k] ELSE m[i][j] - m[i][k] * m[k][j] / m[k][k] END))"
    return f"{name}_i(k, m) AS (SELECT 1, {wide} FROM {matrix} UNION ALL SELECT k + 1, {step} FROM {name}_i WHERE k <= {n}), {name} AS (SELECT list_transform(m, lambda r: r[{n + 1}:{2 * n}]) AS y FROM {name}_i WHERE k = {n + 1})"


def unit_sql_axis(name: str, source: str, column: str) -> str:
    return f"{name} AS (SELECT list_transform(w, lambda x: x / sqrt(list_dot_product(w, w))) AS v FROM (SELECT {column} AS w FROM {source}))"


def points_sql(ctes: str, one: str, two: str, names: tuple[str, str], source: str = "c", row: str = ROW) -> str:
    return f"WITH RECURSIVE {ctes} SELECT user_id, ROUND(list_dot_product({row}, p.v), 6) + 0.0 AS {names[0]}, ROUND(list_dot_product({row}, q.v), 6) + 0.0 AS {names[1]} FROM {source}, {one} p, {two} q"


SVD = f"{CENTERED}, {GRAM}, {leading_sql('v1', 'gm')}, {without_sql('g2', 'gm', 'v1')}, {leading_sql('v2', 'g2')}"
UNITVALUE = "uv AS (SELECT user_id, arg_min(value, (ts, event_id)) AS x FROM events GROUP BY user_id)"
PLACED = f"t AS (SELECT c.user_id, list_dot_product({ROW}, p.v) AS x, list_dot_product({ROW}, q.v) AS y FROM c, v1 p, v2 q)"
WROW = "[" + ", ".join(f"w_{c}" for c in CODES) + "]"
# Node weights, and the nodes that solve their normal equations, by code.
LAID = (
    f"nw0 AS (SELECT user_id, norm, {_join(f'{NODEW[c]} AS w_{c}' for c in CODES)} FROM s), nw AS (SELECT user_id, norm, {_join(f'w_{c} / GREATEST({NODESUM}, 0.0001) AS w_{c}' for c in CODES)} FROM nw0), "
    "ww AS (SELECT [" + ", ".join("[" + ", ".join(f"SUM(w_{a} * w_{b})" for b in CODES) + "]" for a in CODES) + f"] AS g, [{', '.join(f'SUM(w_{a} * x)' for a in CODES)}] AS tx, [{', '.join(f'SUM(w_{a} * y)' for a in CODES)}] AS ty FROM nw JOIN t USING (user_id) WHERE norm > 0), "
    f"{inverse_sql('wi', 'ww', 5)}, nx AS (SELECT list_transform(y, lambda r: list_dot_product(r, tx)) AS nx, list_transform(y, lambda r: list_dot_product(r, ty)) AS ny FROM wi, ww), "
    "nodes AS (SELECT UNNEST(range(1, 6)) AS i, UNNEST([" + ", ".join(f"'{c}'" for c in CODES) + "]) AS code, UNNEST(nx) AS x, UNNEST(ny) AS y FROM nx)"
)


def _nodes(spark, m) -> DataFrame:
    rows = m.nodes_table(spark)
    return rows.select("code", *[(F.round(col(d), 6) + 0.0).alias(d.lower()) for d in m.dimensions])


@query(points_sql(SVD, "v1", "v2", ("svd1", "svd2")))
def svd_points(spark, sf_dir):
    return _points(model(spark, sf_dir))


@query(f"WITH RECURSIVE {SVD}, {PLACED}, {LAID} SELECT code, ROUND(x, 6) + 0.0 AS svd1, ROUND(y, 6) + 0.0 AS svd2 FROM nodes")
def svd_nodes(spark, sf_dir):
    return _nodes(spark, model(spark, sf_dir))


@query(f"WITH RECURSIVE {SVD}, {PLACED}, {LAID} SELECT user_id, ROUND(list_dot_product({WROW}, nx), 6) + 0.0 AS svd1, ROUND(list_dot_product({WROW}, ny), 6) + 0.0 AS svd2 FROM nw, nx")
def svd_centroids(spark, sf_dir):
    m = model(spark, sf_dir)
    return m.centroids.select(F.col(UNIT).cast("long").alias("user_id"), *[(F.round(col(d), 6) + 0.0).alias(d.lower()) for d in m.dimensions])


GMR = (
    f"{CENTERED}, {UNITVALUE}, fh AS (SELECT arg_min(CASE WHEN user_id % 2 = 0 THEN 'even' ELSE 'odd' END, (ts, event_id)) AS h FROM events), "
    f"sl AS (SELECT [{', '.join(f'regr_slope({a}__{b}, CASE WHEN half = h THEN 0.0 ELSE 1.0 END)' for a, b in PAIRS)}] AS a, [{', '.join(f'regr_slope({a}__{b}, x)' for a, b in PAIRS)}] AS b FROM c JOIN uv USING (user_id), fh), "
    f"{unit_sql_axis('v1', 'sl', 'a')}, s2 AS (SELECT list_transform(range(1, 11), lambda i: b[i] - v[i] * list_dot_product(b, v)) AS b FROM sl, v1), {unit_sql_axis('v2', 's2', 'b')}"
)


@query(points_sql(GMR, "v1", "v2", ("gmr1", "gmr2")))
def gmr_points(spark, sf_dir):
    return _points(model(spark, sf_dir, rotation="generalized", rotation_options={"x": "half", "y": "value"}))


def axis_then_svd(first: str, matrix: str = GRAM, name: str = "gm") -> str:
    """A first axis ``v1`` and the leading axis ``v2`` of the rest."""
    return f"{CENTERED}, {matrix}, {first}, {without_sql('g2', name, 'v1')}, {leading_sql('v2', 'g2')}"


@query(points_sql(axis_then_svd(f"{UNITVALUE}, sl AS (SELECT [{', '.join(f'regr_slope({a}__{b}, x)' for a, b in PAIRS)}] AS b FROM c JOIN uv USING (user_id)), {unit_sql_axis('v1', 'sl', 'b')}"), "v1", "v2", ("value_reg", "svd2")))
def regression_points(spark, sf_dir):
    return _points(model(spark, sf_dir, rotation="regression", rotation_options={"x": "value"}))


def on_networks_sql(x: str) -> str:
    """The axis of the coefficients of x on the networks, both without what ``z`` (odd users) explains if x is ``xz``."""
    z = "CASE WHEN half = 'odd' THEN 1.0 ELSE 0.0 END"
    held = (lambda v: f"COVAR_POP({v}, {{0}}) - COVAR_POP({v}, {z}) * COVAR_POP({{0}}, {z}) / VAR_POP({z})") if x == "xz" else (lambda v: f"COVAR_POP({v}, {{0}})")
    part = lambda u, v: held(u).format(v)
    matrix = "[" + ", ".join("[" + ", ".join(part(f"{a}__{b}", f"{c}__{d}") for c, d in PAIRS) + "]" for a, b in PAIRS) + "]"
    right = "[" + ", ".join(part(f"{a}__{b}", "x") for a, b in PAIRS) + "]"
    return f"{UNITVALUE}, xg AS (SELECT {matrix} AS g, {right} AS r FROM c JOIN uv USING (user_id)), {inverse_sql('xi', 'xg', 10)}, xb AS (SELECT list_transform(y, lambda q: list_dot_product(q, r)) AS b FROM xi, xg), {unit_sql_axis('v1', 'xb', 'b')}"


@query(points_sql(axis_then_svd(on_networks_sql("x")), "v1", "v2", ("value_reg", "svd2")))
def regression_2_points(spark, sf_dir):
    return _points(model(spark, sf_dir, rotation="regression_2", rotation_options={"x": "value"}))


@query(points_sql(axis_then_svd(on_networks_sql("xz")), "v1", "v2", ("value_reg", "svd2")))
def formula_with_control_points(spark, sf_dir):
    return _points(model(spark, sf_dir, rotation="value ~ V + half"))


Z_ = "CASE WHEN half = 'odd' THEN 1.0 ELSE 0.0 END"


@query(points_sql(axis_then_svd(f"{UNITVALUE}, sl AS (SELECT [{', '.join(f'VAR_POP({Z_}) * COVAR_POP({a}__{b}, x) - COVAR_POP(x, {Z_}) * COVAR_POP({a}__{b}, {Z_})' for a, b in PAIRS)}] AS b FROM c JOIN uv USING (user_id)), {unit_sql_axis('v1', 'sl', 'b')}"), "v1", "v2", ("value_h", "svd2")))
def hierarchical_points(spark, sf_dir):
    return _points(model(spark, sf_dir, rotation="hierarchical", rotation_options={"x": "value", "controls": ["half"]}))


@query(
    f"WITH RECURSIVE {SVD}, {PLACED}, {LAID}, o AS (SELECT *, ROW_NUMBER() OVER (ORDER BY y < 0, CASE WHEN y < 0 THEN x ELSE -x END, i) - 1 AS p, x * x + y * y AS z FROM nodes), "
    "l AS (SELECT p AS lp, x AS lx, y AS ly FROM o ORDER BY z DESC, i LIMIT 1), k AS (SELECT code, lx, ly, 2 * pi() * ((p - lp + 5) % 5) / 5 AS turn FROM o, l) "
    "SELECT code, ROUND(lx * cos(turn) - ly * sin(turn), 6) + 0.0 AS svd1, ROUND(lx * sin(turn) + ly * cos(turn), 6) + 0.0 AS svd2 FROM k"
)
def unit_circle_nodes(spark, sf_dir):
    return _nodes(spark, M.move_nodes(model(spark, sf_dir)))


@query()
def group_comparison(spark, sf_dir):
    m = model(spark, sf_dir)
    found = S.compare_groups(m.points, m.dimensions, F.col("half") == "even", F.col("half") == "odd")
    return spark.createDataFrame([(d, k, float(v)) for d, r in found.items() for k, v in r.items()], "dimension string, statistic string, value double")


# The 97.5 % quantile of t as a series in 1 / df about that of the normal distribution.
NORMAL = 1.959963984540054
QUANTILE = " + ".join([f"{NORMAL}"] + [f"{value!r} / POWER(df, {k})" for k, value in enumerate(((NORMAL**3 + NORMAL) / 4, (5 * NORMAL**5 + 16 * NORMAL**3 + 3 * NORMAL) / 96, (3 * NORMAL**7 + 19 * NORMAL**5 + 17 * NORMAL**3 - 15 * NORMAL) / 384, (79 * NORMAL**9 + 776 * NORMAL**7 + 1482 * NORMAL**5 - 1920 * NORMAL**3 - 945 * NORMAL) / 92160), 1)])


@query(
    f"WITH RECURSIVE {SVD}, {PLACED}, m AS (SELECT 'SVD1' AS name, AVG(x) AS a, STDDEV_SAMP(x) / sqrt(COUNT(*)) AS e, COUNT(*) - 1 AS df FROM t UNION ALL SELECT 'SVD2', AVG(y), STDDEV_SAMP(y) / sqrt(COUNT(*)), COUNT(*) - 1 FROM t) "
    f"SELECT name, ROUND(a - e * ({QUANTILE}), 6) + 0.0 AS low, ROUND(a + e * ({QUANTILE}), 6) + 0.0 AS high FROM m"
)
def mean_intervals(spark, sf_dir):
    m = model(spark, sf_dir)
    return _named(spark, S.mean_intervals(m.points, m.dimensions), ["low", "high"], 6)


@query(f"WITH {WEIGHTS}, e AS (" + " UNION ALL ".join(f"SELECT '{a}' AS code_from, '{b}' AS code_to, AVG({a}__{b}) AS w FROM s" for a, b in PAIRS) + ") SELECT code_from, code_to, ROUND(w, 9) + 0.0 AS weight, ROUND(w / (SELECT MAX(w) FROM e), 9) + 0.0 AS width FROM e WHERE w <> 0")
def network_edges(spark, sf_dir):
    m = model(spark, sf_dir)
    edges, _ = P.network(m, P.mean_network(m))
    return spark.createDataFrame([(e["from"], e["to"], round(e["weight"], 9) + 0.0, round(e["width"], 9) + 0.0) for e in edges], "code_from string, code_to string, weight double, width double")


WIDER = f"o AS (WITH {WEIGHTS.replace(windows_sql(), windows_sql('5 PRECEDING'))} SELECT * FROM s)"


@query(points_sql(f"{SVD}, {WIDER}, oc AS (SELECT o.user_id, {_join(f'CASE WHEN norm > 0 THEN o.{a}__{b} - m_{a}__{b} ELSE 0 END AS {a}__{b}' for a, b in PAIRS)} FROM o, mu)", "v1", "v2", ("svd1", "svd2"), "oc"))
def projected_into_other(spark, sf_dir):
    one = model(spark, sf_dir)
    other = M.fit(acc(spark, sf_dir, back=6), rotation_set=one.rotation)
    return _points(other)


@query()
def tune_stability(spark, sf_dir):
    chosen, found = W.tune_by_stability(lines(spark, sf_dir), ["user_id"], ["day"], CODES, ["ts", "event_id"], (2, 3, 4))
    return spark.createDataFrame([(w, float(r), w == chosen) for w, r in found.items()], "window int, correlation double, chosen boolean")


@query()
def pria(spark, sf_dir):
    found = X.pria(acc(spark, sf_dir), 2, 0.8)
    return spark.createDataFrame([(",".join(found.removed), found.variance)], "removed string, variance double")

# ------------------------------------------------------- further single operators
@query(f"WITH {EVENTS} SELECT CAST(user_id AS VARCHAR) || '::' || half AS unit_key, COUNT(*) AS n FROM ev GROUP BY 1")
def composite_keys(spark, sf_dir):
    return lines(spark, sf_dir).groupBy(A.composite(["user_id", "half"]).alias("unit_key")).agg(F.count("*").alias("n"))


@query(f"WITH {EVENTS}, {windows_sql()}, ln AS (SELECT user_id, {_join(f'CAST(({cell(a, b)}) / (1 + {cell(a, b)}) AS DOUBLE) AS {a}__{b}' for a, b in PAIRS)} FROM w) SELECT user_id, {_join(f'ROUND(SUM({a}__{b}), 6) + 0.0 AS {a}__{b}' for a, b in PAIRS)} FROM ln GROUP BY user_id")
def unit_counts_custom_weight(spark, sf_dir):
    a = acc(spark, sf_dir, weight=lambda x: x / (1 + x))
    return user(a.counts, a.names, 6)


@query(f"WITH {EVENTS}, {windows_sql()} SELECT user_id, {_join(f'SUM(h_{c} * {c}) AS {c}' for c in CODES)} FROM w GROUP BY user_id")
def self_connection_table(spark, sf_dir):
    a = acc(spark, sf_dir, self_connections=True)
    return a.self_counts.select(F.col(UNIT).cast("long").alias("user_id"), *[col(c) for c in CODES])


@query(f"WITH {EVENTS}, {windows_sql(part='day, half')}, {lines_sql()} {unit_sql()}")
def fixed_horizon_counts(spark, sf_dir):
    a = A.accumulate(lines(spark, sf_dir), ["user_id"], ["day", "half"], CODES, ["ts", "event_id"], back=4, check_rows=False)
    return user(a.counts, a.names)


@query("SELECT user_id, ROW_NUMBER() OVER (ORDER BY MIN(ts)) - 1 AS place FROM events GROUP BY user_id")
def units_in_order(spark, sf_dir):
    from .plans.linalg import dense_index

    first = lines(spark, sf_dir).groupBy("user_id").agg(F.min(F.struct("ts", "event_id")).alias("f"))
    return dense_index(first, "f", name="place").select("user_id", "place")


@query(f"WITH {STEPS}, r AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY user_id ORDER BY first_ts) AS step FROM st) SELECT user_id, MAX(step) AS step, arg_max(click__error, step) AS x, arg_max(click__view, step) AS y FROM r GROUP BY user_id")
def trajectory_ends(spark, sf_dir):
    a = acc(spark, sf_dir, model="SeparateTrajectory")
    steps = a.counts.select(F.col(UNIT).alias("unit"), F.col(STEP).cast("long").alias("step"), col("click & error").alias("x"), col("click & view").alias("y"))
    return P.trajectory_ends(steps).select(F.col("unit").cast("long").alias("user_id"), "step", "x", "y")


SLOPES = [f"regr_slope({a}__{b}, x) AS b_{a}__{b}" for a, b in PAIRS]
SNORM = "sqrt(" + " + ".join(f"b_{a}__{b}*b_{a}__{b}" for a, b in PAIRS) + ")"


@query(f"WITH {CENTERED}, {UNITVALUE}, sl AS (SELECT {_join(SLOPES)} FROM c JOIN uv USING (user_id)) " + " UNION ALL ".join(f"SELECT '{a}__{b}' AS name, ROUND(b_{a}__{b} / {SNORM}, 7) + 0.0 AS loading FROM sl" for a, b in PAIRS))
def regression_axis(spark, sf_dir):
    a, c = centered(spark, sf_dir)
    meta = A.unit_metadata(lines(spark, sf_dir), ["user_id"], ["ts", "event_id"], ["value"], constant=False)
    space = R.Space.of(c.join(meta.select(UNIT, "value"), UNIT), a.names)
    axis = R.regression_rotation(space, "value").matrix[:, 0]
    return spark.createDataFrame([(flat(n), round(float(v), 7) + 0.0) for n, v in zip(a.names, axis)], "name string, loading double")


@query(f"WITH {AXIS} SELECT user_id, {_join(f'ROUND({a}__{b} - (' + ' + '.join(f'{x}__{y}*d_{x}__{y}' for x, y in PAIRS) + f') * d_{a}__{b} / ({DNORM} * {DNORM}), 8) + 0.0 AS {a}__{b}' for a, b in PAIRS)} FROM c, df")
def deflated_networks(spark, sf_dir):
    a, c = centered(spark, sf_dir)
    space = R.Space.of(c, a.names)
    d = space.mean(F.col("half") == "even")[1] - space.mean(F.col("half") == "odd")[1]
    return user(R.deflate(c, a.names, d / np.linalg.norm(d)), a.names, 8)


@query(
    f"WITH {CENTERED}, gm AS (SELECT half, COUNT(*) AS n, {_join(f'AVG({a}__{b}) AS {a}__{b}' for a, b in PAIRS)} FROM c GROUP BY half), am AS (SELECT {_join(f'AVG({a}__{b}) AS m_{a}__{b}' for a, b in PAIRS)} FROM c) "
    + " UNION ALL ".join(f"SELECT '{a}__{b}' AS row_name, '{x}__{y}' AS col_name, ROUND(SUM(n * ({a}__{b} - m_{a}__{b}) * ({x}__{y} - m_{x}__{y})), 8) + 0.0 AS value FROM gm, am" for a, b in PAIRS for x, y in PAIRS)
)
def between_group_scatter(spark, sf_dir):
    a, c = centered(spark, sf_dir)
    s = R.scatter(R.Space.of(c, a.names), "half")
    return spark.createDataFrame([(flat(x), flat(y), round(float(s[i, j]), 8) + 0.0) for i, x in enumerate(a.names) for j, y in enumerate(a.names)], "row_name string, col_name string, value double")


WELCH = f"{WEIGHTS}, m AS (SELECT CAST(COUNT(CASE WHEN half='even' THEN 1 END) AS DOUBLE) n1, AVG(CASE WHEN half='even' THEN click__error END) m1, VAR_SAMP(CASE WHEN half='even' THEN click__error END) v1, CAST(COUNT(CASE WHEN half='odd' THEN 1 END) AS DOUBLE) n2, AVG(CASE WHEN half='odd' THEN click__error END) m2, VAR_SAMP(CASE WHEN half='odd' THEN click__error END) v2 FROM s), rk AS (SELECT half, RANK() OVER (ORDER BY click__error) + (COUNT(*) OVER (PARTITION BY click__error) - 1) / 2.0 AS rk FROM s), us AS (SELECT SUM(rk) FILTER (half = 'even') AS r1 FROM rk)"


@query(f"WITH {WELCH} SELECT ROUND((m1-m2)/sqrt(v1/n1+v2/n2), 7) + 0.0 AS t, ROUND((v1/n1+v2/n2)*(v1/n1+v2/n2) / ((v1/n1)*(v1/n1)/(n1-1) + (v2/n2)*(v2/n2)/(n2-1)), 6) + 0.0 AS df, CAST(r1 - n1*(n1+1)/2 AS DOUBLE) AS u, ROUND(2*(r1 - n1*(n1+1)/2)/(n1*n2) - 1, 8) + 0.0 AS r FROM m, us")
def group_tests(spark, sf_dir):
    _, w = weights(spark, sf_dir)
    x = S.compare_groups(w.withColumn("x", col("click & error")), ["x"], F.col("half") == "even", F.col("half") == "odd")["x"]
    return spark.createDataFrame([(round(x["t"], 7) + 0.0, round(x["df"], 6) + 0.0, float(x["U"]), round(x["r"], 8) + 0.0)], "t double, df double, u double, r double")


@query(f"WITH {NODES}, p AS (SELECT nw.user_id, " + " + ".join(f"{k + 1} * w_{c}" for k, c in enumerate(CODES)) + " AS x FROM nw) SELECT user_id, ROUND(x, 8) + 0.0 AS x FROM p")
def centroids_of_given_nodes(spark, sf_dir):
    a, w = weights(spark, sf_dir)
    n = N.node_weights(w, a.names, L.index_pairs(5), CODES)
    made = N.centroids(n, CODES, np.arange(1.0, 6.0)[:, None], ["x"])
    return made.select(F.col(UNIT).cast("long").alias("user_id"), (F.round("x", 8) + 0.0).alias("x"))


@query(f"WITH {WEIGHTS} SELECT ROUND(MAX(GREATEST(ABS(click__error), ABS(click__view))), 9) + 0.0 AS range FROM s")
def axis_range(spark, sf_dir):
    _, w = weights(spark, sf_dir)
    return spark.createDataFrame([(round(P.axis_range(w, ["click & error", "click & view"]), 9) + 0.0,)], "range double")


MEANS = axis_then_svd(f"sl AS (SELECT [{', '.join(d.rsplit(' AS ', 1)[0] for d in DIFF)}] AS b FROM c), {unit_sql_axis('v1', 'sl', 'b')}", COVARIANCE, "gc")


@query(points_sql(MEANS, "v1", "v2", ("mr1", "svd2")))
def whole_analysis(spark, sf_dir):
    from .analysis import analyse

    return _points(analyse(lines(spark, sf_dir), ["user_id"], ["day"], CODES, ["ts", "event_id"], "half", ["even", "odd"]).model)
