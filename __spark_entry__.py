"""

Every query runs the library operators over whole driver tables:

* ``events`` (clickstream) as an event log: ``ts`` is the event time, a session
  is one user's UTC day, the funnel is view -> click -> purchase, a click plays
  the cart role and an ``error`` the removal role;
* ``orders`` as an event log over 80 months: customer = user, order = session,
  status = event type -- used for monthly actives and all cohort queries.

* variants with gaps: users (and with them sessions) unknown for a part of the
  day, customers unknown from a date on.

Each oracle states the rule of its report by another method than the operators:
lists per session or per user instead of joins and windows, numbered rows joined
to their neighbours instead of window frames. Rounding in the oracles is exact
integer half-away-from-zero arithmetic, so it cannot differ from Spark's decimal
rounding on ties. Decimal results are returned as double on both sides.
"""

from __future__ import annotations

import os
import sys
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from eventscope.operators import (  # noqa: E402
    StepNames,
    active_from_days,
    add_users,
    cart_outcomes,
    cart_sessions,
    cells_from_months,
    cohort_activity,
    cohort_activity_observed,
    daily_report,
    day_bitmaps,
    funnel_by_period,
    funnel_durations,
    funnel_from_slices,
    funnel_sessions,
    funnel_slices,
    funnel_steps,
    merge_days,
    merge_months,
    monthly_growth,
    monthly_report,
    number_users,
    profile_event_share,
    profile_nulls,
    profile_volume,
    retention_curve,
    retention_long,
    retention_matrix,
    user_months,
    weekly_report,
)
from eventscope.functions.staging import shared_folder, staged  # noqa: E402
from eventscope.plans.session import configure  # noqa: E402
from eventscope.sources import (  # noqa: E402
    EVENT_COLUMNS,
    clean_events,
    clickstream_events,
    load_errors,
    load_events,
    order_events,
    parse_event_lines,
    quarantined,
    read_table,
)

try:  # the training-data operators are an optional part of the library
    import eventscope.llm.queries as llm  # noqa: E402
except ImportError:  # left out, or a package that only they need is missing
    llm = None

SMOKE_DIR = "/root/testdata/sf0.001"

# Role mapping of the clickstream table onto the funnel and cart reports.
FUNNEL_STEPS = ("view", "click", "purchase")
FUNNEL_NAMES = StepNames.of(FUNNEL_STEPS)
ORDER_STEPS = ("F", "P", "O")
ORDER_NAMES = StepNames.of(ORDER_STEPS)
CART_ROLES = {"cart": "click", "purchase": "purchase", "removal": "error"}


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    configure(spark)
    return clickstream_events(read_table(spark, sf_dir, "events"))


def _events_with_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users are unknown in the first ten minutes of every hour."""
    configure(spark)
    known = F.when(F.minute("ts") >= 10, F.col("user_id"))
    return clickstream_events(read_table(spark, sf_dir, "events").withColumn("user_id", known))


def _orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    configure(spark)
    return order_events(read_table(spark, sf_dir, "orders"))


def _orders_with_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers are unknown from March 1998 on: the data outlasts the known users."""
    known = F.when(F.col("event_time") < F.lit("1998-03-01").cast("date"), F.col("user_id"))
    return _orders(spark, sf_dir).withColumn("user_id", known)


def _customer_funnel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Funnel over order statuses with the customer as the session: entries in every month."""
    events = _orders(spark, sf_dir).withColumn("user_session", F.col("user_id"))
    return funnel_sessions(events, ORDER_STEPS)


def _finish(df: DataFrame) -> DataFrame:
    """Decimals as double and zoned timestamps as UTC wall-clock, for comparison."""
    cols = []
    for f in df.schema.fields:
        if isinstance(f.dataType, T.DecimalType):
            cols.append(F.col(f.name).cast("double").alias(f.name))
        elif isinstance(f.dataType, T.TimestampType):
            cols.append(F.col(f.name).cast("timestamp_ntz").alias(f.name))
        else:
            cols.append(F.col(f.name))
    return df.select(*cols)


def _raw_text_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The clickstream table rendered as the all-text CSV staging layout."""
    configure(spark)
    ev = read_table(spark, sf_dir, "events")
    return ev.select(
        F.concat(F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS"), F.lit(" UTC")).alias("event_time"),
        F.col("event_type"),
        F.col("event_id").cast("string").alias("product_id"),
        F.regexp_extract("props", "[0-9]+", 0).alias("category_id"),
        F.col("props").alias("category_code"),
        F.when(F.col("event_type") == "signup", F.lit("")).otherwise(F.col("event_type")).alias("brand"),
        F.col("value").cast("string").alias("price"),
        F.col("user_id").cast("string").alias("user_id"),
        F.concat(F.col("user_id").cast("string"), F.lit("-"), F.to_date("ts").cast("string")).alias("user_session"),
    )


def _event_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The staging layout as CSV lines. Errors have a time without a date, signups a
    field too many, purchases one too few, and clicks at second 0 an over-long brand."""
    raw = _raw_text_events(spark, sf_dir)
    kind = F.col("event_type")
    brand = F.when((kind == "click") & F.col("event_time").contains(":00."), F.repeat(F.lit("b"), 101)).otherwise(F.col("brand"))
    raw = raw.withColumn("event_time", F.when(kind == "error", F.substring("event_time", 12, 5)).otherwise(F.col("event_time"))).withColumn("brand", brand)
    quoted = [F.concat(F.lit('"'), F.replace(F.col(c), F.lit('"'), F.lit('""')), F.lit('"')) for c in EVENT_COLUMNS[:-1]]
    last = F.when(kind == "signup", F.concat(F.lit(","), F.col("user_session"), F.lit(",more"))).when(kind == "purchase", F.lit("")).otherwise(
        F.concat(F.lit(","), F.col("user_session"))
    )
    return parse_event_lines(raw.select(F.concat(F.concat_ws(",", *quoted), last).alias("value")))


def _multi_line(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The staging layout as CSV files in the shared folder, with line breaks and doubled quotes in two fields, loaded again."""
    raw = _raw_text_events(spark, sf_dir)
    raw = raw.withColumn("category_code", F.replace("category_code", F.lit(": "), F.lit(',"\n\n'))).withColumn("brand", F.concat("brand", F.lit('\n,"')))
    quoted = [F.coalesce(F.concat(F.lit('"'), F.replace(F.col(c), F.lit('"'), F.lit('""')), F.lit('"')), F.lit("")) for c in EVENT_COLUMNS]
    folder = shared_folder(spark)
    if folder is None:
        raise ValueError("set spark.checkpoint.dir to a shared folder")
    path = f"{folder}/eventscope-lines-{uuid.uuid4().hex}"
    raw.select(F.concat_ws(",", *quoted).alias("value")).write.text(path)
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(place)
    return clean_events(load_events(spark, path, header=False, multi_line=True))


def _funnel(spark: SparkSession, sf_dir: str) -> DataFrame:
    return funnel_sessions(_events(spark, sf_dir), FUNNEL_STEPS)


def _sliced_funnel(events: DataFrame, steps: tuple[str, ...]) -> DataFrame:
    return funnel_from_slices(funnel_slices(events, steps), steps)


def _stored_funnel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Slices of the first half of the days are kept as a table, the others' are appended."""
    events = _events(spark, sf_dir)
    first, last = events.agg(F.min("event_time"), F.max("event_time")).first()
    if first is None:
        return _sliced_funnel(events, FUNNEL_STEPS)
    half = (first + (last - first) / 2).replace(hour=0, minute=0, second=0, microsecond=0)
    old, new = (funnel_slices(events.where(c), FUNNEL_STEPS) for c in (F.col("event_time") < F.lit(half), F.col("event_time") >= F.lit(half)))
    return funnel_from_slices(staged(old).unionByName(new), FUNNEL_STEPS)


def _merged_months(events: DataFrame) -> DataFrame:
    """Cells from a stored table of user months with the last month's events merged into it."""
    last = F.date_trunc("month", F.lit(events.agg(F.max("event_time")).first()[0]))
    old, new = (user_months(events.where(c)) for c in (F.col("event_time") < last, F.col("event_time") >= last))
    return cells_from_months(merge_months(staged(old), new))


def _month_rollup(events: DataFrame) -> DataFrame:
    """Monthly actives from day bitmaps: a stored table of all but the last month, the last month's days added."""
    last = F.date_trunc("month", F.lit(events.agg(F.max("event_time")).first()[0]))
    old, new = (events.where(c) for c in (F.col("event_time") < last, F.col("event_time") >= last))
    numbers = staged(number_users(old))
    stored = staged(day_bitmaps(old, numbers))
    return monthly_growth(active_from_days(merge_days(stored, day_bitmaps(new, staged(add_users(numbers, new)))), "month"))


def _week_rollup(events: DataFrame) -> DataFrame:
    return active_from_days(day_bitmaps(events, staged(number_users(events))), "week")


def _quarantine(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Defects by column, reason and value; the lines themselves are in the rows behind the counts."""
    return quarantined(_event_lines(spark, sf_dir)).groupBy("column_name", "reason", "value").agg(
        F.count(F.lit(1)).alias("defects"), F.countDistinct("line").alias("lines")
    )


def _carts(spark: SparkSession, sf_dir: str, paid_rule: str = "first_purchase") -> DataFrame:
    return cart_sessions(_events(spark, sf_dir), paid_rule=paid_rule, **CART_ROLES)


def _cohorts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cohort_activity(_orders(spark, sf_dir))


def _cohorts_with_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cohort_activity(_orders_with_gaps(spark, sf_dir))


def _row_fanout(activity: DataFrame) -> DataFrame:
    return retention_curve(activity, weighting="row_fanout").withColumn("total_eligible_users", F.col("total_eligible_users").cast("bigint"))


def entry(spark: SparkSession) -> DataFrame:
    """Flagship: the ordered session funnel with conversions on sf0.001."""
    return _finish(funnel_steps(_funnel(spark, SMOKE_DIR), names=FUNNEL_NAMES))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    q: dict[str, Callable[[SparkSession, str], DataFrame]] = {
        # data-quality profile
        "profile_volume": lambda s, d: profile_volume(_events(s, d)),
        "profile_volume_orders": lambda s, d: profile_volume(_orders(s, d)),
        "profile_volume_gaps": lambda s, d: profile_volume(_events_with_gaps(s, d)),
        "profile_event_share": lambda s, d: profile_event_share(_events(s, d)),
        "profile_event_share_orders": lambda s, d: profile_event_share(_orders(s, d)),
        "profile_nulls": lambda s, d: profile_nulls(clean_events(_raw_text_events(s, d))),
        "profile_nulls_orders": lambda s, d: profile_nulls(_orders_with_gaps(s, d), ("user_id", "user_session", "price")),
        "profile_nulls_gaps": lambda s, d: profile_nulls(_events_with_gaps(s, d), ("user_id", "user_session", "price")),
        # load + clean (text round trip through the staging layout)
        "clean_events": lambda s, d: clean_events(_raw_text_events(s, d)),
        "load_events_text": lambda s, d: clean_events(_event_lines(s, d), on_error="null"),
        "load_errors": lambda s, d: load_errors(_event_lines(s, d)),
        "load_quarantine": _quarantine,
        "load_multi_line": _multi_line,
        # activity
        "dau_moving_avg": lambda s, d: daily_report(_events(s, d)),
        "dau_moving_avg_orders": lambda s, d: daily_report(_orders(s, d)),
        "dau_moving_avg_orders_filled": lambda s, d: daily_report(_orders(s, d), fill_missing_days=True),
        "wau_growth": lambda s, d: weekly_report(_events(s, d)),
        "wau_growth_orders": lambda s, d: weekly_report(_orders(s, d)),
        "mau_sticky": lambda s, d: monthly_report(_orders(s, d)),
        "mau_sticky_events": lambda s, d: monthly_report(_events(s, d)),
        "mau_sticky_gaps": lambda s, d: monthly_report(_orders_with_gaps(s, d)),
        "wau_rollup": lambda s, d: _week_rollup(_events_with_gaps(s, d)),
        "mau_rollup": lambda s, d: _month_rollup(_orders(s, d)),
        # ordered funnel
        "funnel_sessions": lambda s, d: _funnel(s, d),
        "funnel_steps": lambda s, d: funnel_steps(_funnel(s, d), names=FUNNEL_NAMES),
        "funnel_steps_gaps": lambda s, d: funnel_steps(funnel_sessions(_events_with_gaps(s, d), FUNNEL_STEPS), names=FUNNEL_NAMES),
        "funnel_monthly": lambda s, d: funnel_by_period(_funnel(s, d), names=FUNNEL_NAMES),
        "funnel_monthly_orders": lambda s, d: funnel_by_period(_customer_funnel(s, d), names=ORDER_NAMES),
        "funnel_durations": lambda s, d: funnel_durations(_funnel(s, d), names=FUNNEL_NAMES),
        "funnel_sessions_sliced": lambda s, d: _sliced_funnel(_events(s, d), FUNNEL_STEPS),
        "funnel_sessions_stored": _stored_funnel,
        "funnel_steps_sliced_gaps": lambda s, d: funnel_steps(_sliced_funnel(_events_with_gaps(s, d), FUNNEL_STEPS), names=FUNNEL_NAMES),
        # carts
        "cart_sessions": lambda s, d: _carts(s, d),
        "cart_outcomes": lambda s, d: cart_outcomes(_carts(s, d)),
        "cart_outcomes_any_after_cart": lambda s, d: cart_outcomes(_carts(s, d, "any_after_cart")),
        "cart_outcomes_gaps": lambda s, d: cart_outcomes(cart_sessions(_events_with_gaps(s, d), **CART_ROLES)),
        # cohorts
        "cohort_activity": lambda s, d: _cohorts(s, d),
        "cohort_activity_one_pass": lambda s, d: cohort_activity_observed(_orders(s, d))[0],
        "retention_matrix_pct": lambda s, d: retention_matrix(_cohorts(s, d)),
        "retention_matrix_pct_masked": lambda s, d: retention_matrix(_cohorts(s, d), mask_unobserved=True),
        "retention_matrix_pct_masked_gaps": lambda s, d: retention_matrix(_cohorts_with_gaps(s, d), mask_unobserved=True),
        "retention_matrix_users": lambda s, d: retention_matrix(_cohorts(s, d), as_pct=False),
        "retention_long": lambda s, d: retention_long(_cohorts(s, d)),
        "retention_long_merged": lambda s, d: retention_long(_merged_months(_orders(s, d))),
        "retention_matrix_pct_masked_gaps_merged": lambda s, d: retention_matrix(_merged_months(_orders_with_gaps(s, d)), mask_unobserved=True),
        "retention_curve": lambda s, d: retention_curve(_cohorts(s, d)),
        "retention_curve_gaps": lambda s, d: retention_curve(_cohorts_with_gaps(s, d)),
        "retention_curve_row_fanout": lambda s, d: _row_fanout(_cohorts(s, d)),
    }
    registered = {name: (lambda f: lambda s, d: _finish(f(s, d)))(fn) for name, fn in q.items()}
    return registered | (llm.queries() if llm else {})


# --------------------------------------------------------------------------
# Oracles (DuckDB SQL)
# --------------------------------------------------------------------------


def _half_up(num: str, den: str, factor: int, divisor: int) -> str:
    """round(factor * num / den) / divisor, half away from zero, NULL when den = 0.

    Integer arithmetic only: floor((2 * factor * |num| + den) / (2 * den)).
    """
    return (
        f"(CASE WHEN ({den}) = 0 THEN NULL ELSE CAST(sign({num}) * "
        f"((2 * {factor} * abs({num}) + ({den})) // (2 * ({den}))) AS DOUBLE) / {divisor} END)"
    )


def _pct2(num: str, den: str) -> str:
    return _half_up(num, den, 10000, 100)


def _pct1(num: str, den: str) -> str:
    return _half_up(num, den, 1000, 10)


# Sources of the reports: e(t, kind, product, price, u, sess).
_EV = """e AS (
    SELECT ts AS t, event_type AS kind, CAST(value AS DECIMAL(10,2)) AS price, user_id AS u,
           CAST(user_id AS VARCHAR) || '-' || CAST(CAST(ts AS DATE) AS VARCHAR) AS sess
    FROM events
)"""

_EV_GAPS = """e AS (
    SELECT t, kind, price, u, CAST(u AS VARCHAR) || '-' || CAST(CAST(t AS DATE) AS VARCHAR) AS sess
    FROM (SELECT ts AS t, event_type AS kind, CAST(value AS DECIMAL(10,2)) AS price,
                 CASE WHEN minute(ts) >= 10 THEN user_id END AS u FROM events)
)"""

_ORD = """e AS (
    SELECT o_orderdate AS t, o_orderstatus AS kind, CAST(o_totalprice AS DECIMAL(12,2)) AS price,
           o_custkey AS u, o_orderkey AS sess
    FROM orders
)"""

_ORD_GAPS = """e AS (
    SELECT o_orderdate AS t, o_orderstatus AS kind, CAST(o_totalprice AS DECIMAL(12,2)) AS price,
           CASE WHEN o_orderdate < DATE '1998-03-01' THEN o_custkey END AS u, o_orderkey AS sess
    FROM orders
)"""

_ORD_CUSTOMER = _ORD.replace("o_orderkey AS sess", "o_custkey AS sess")


def _profile_volume(src: str) -> str:
    return f"""WITH {src}
SELECT (SELECT count(*) FROM e) AS total_events,
       (SELECT count(*) FROM (SELECT u FROM e WHERE u IS NOT NULL GROUP BY u)) AS unique_users,
       (SELECT count(*) FROM (SELECT sess FROM e WHERE sess IS NOT NULL GROUP BY sess)) AS unique_sessions,
       CAST(list_min(d) AS DATE) AS first_day, CAST(list_max(d) AS DATE) AS last_day,
       CAST(len(list_distinct([year(x) * 12 + month(x) FOR x IN d])) AS BIGINT) AS months_covered
FROM (SELECT list(DISTINCT CAST(t AS DATE)) AS d FROM e)"""


def _profile_share(src: str) -> str:
    return f"""WITH {src}, total AS (SELECT count(*) AS n FROM e)
SELECT kind AS event_type, count(*) AS events_count, {_pct2('count(*)', 'any_value(n)')} AS share_pct
FROM e, total GROUP BY kind"""


def _profile_nulls(src: str) -> str:
    return f"""WITH {src}
SELECT CAST(sum(CAST(u IS NULL AS INT)) AS BIGINT) AS null_user_id,
       CAST(sum(CAST(sess IS NULL AS INT)) AS BIGINT) AS null_user_session,
       CAST(sum(CAST(price IS NULL AS INT)) AS BIGINT) AS null_price
FROM e"""


# What the staging text of a row must load as, by the rendering rules of the queries above.
_STAGED = """r AS (
    SELECT ts, event_type AS kind, event_id, props, value, user_id,
           CAST(user_id AS VARCHAR) || '-' || CAST(CAST(ts AS DATE) AS VARCHAR) AS sess,
           regexp_extract(props, '[0-9]+', 0) AS digits
    FROM events
)"""

_CLEAN = f"""WITH {_STAGED}
SELECT ts AS event_time, kind AS event_type, event_id AS product_id,
       CASE WHEN digits <> '' THEN CAST(digits AS BIGINT) END AS category_id,
       CASE WHEN props <> '' THEN props END AS category_code,
       CASE WHEN kind <> 'signup' THEN kind END AS brand,
       CAST(CAST(value AS DECIMAL(10,2)) AS DOUBLE) AS price, user_id, sess AS user_session
FROM r"""

_MULTI_LINE = f"""WITH {_STAGED}
SELECT ts AS event_time, kind AS event_type, event_id AS product_id,
       CASE WHEN digits <> '' THEN CAST(digits AS BIGINT) END AS category_id,
       CASE WHEN props <> '' THEN replace(props, ': ', ',"' || chr(10) || chr(10)) END AS category_code,
       CASE WHEN kind = 'signup' THEN '' ELSE kind END || chr(10) || ',"' AS brand,
       CAST(CAST(value AS DECIMAL(10,2)) AS DOUBLE) AS price, user_id, sess AS user_session
FROM r"""

_CLEAN_NULLS = f"""WITH {_STAGED}
SELECT count(*) - count(user_id) AS null_user_id, count(*) - count(sess) AS null_user_session,
       count(*) FILTER (WHERE kind = 'signup') AS null_brand,
       count(*) FILTER (WHERE props IS NULL OR props = '') AS null_category_code,
       count(*) - count(value) AS null_price
FROM r"""

_WIDTH = "kind IN ('signup', 'purchase')"
_LONG = "kind = 'click' AND second(ts) = 0"
_LOADED = f"""WITH {_STAGED}
SELECT CASE WHEN NOT ({_WIDTH}) AND kind <> 'error' THEN ts END AS event_time,
       CASE WHEN NOT ({_WIDTH}) THEN kind END AS event_type,
       CASE WHEN NOT ({_WIDTH}) THEN event_id END AS product_id,
       CASE WHEN NOT ({_WIDTH}) AND digits <> '' THEN CAST(digits AS BIGINT) END AS category_id,
       CASE WHEN NOT ({_WIDTH}) AND props <> '' THEN props END AS category_code,
       CASE WHEN NOT ({_WIDTH}) AND NOT ({_LONG}) THEN kind END AS brand,
       CASE WHEN NOT ({_WIDTH}) THEN CAST(CAST(value AS DECIMAL(10,2)) AS DOUBLE) END AS price,
       CASE WHEN NOT ({_WIDTH}) THEN user_id END AS user_id,
       CASE WHEN NOT ({_WIDTH}) THEN sess END AS user_session
FROM r"""

_LOAD_ERRORS = f"""WITH {_STAGED}
SELECT count(*) FILTER (WHERE {_WIDTH}) AS corrupt_rows,
       count(*) FILTER (WHERE kind = 'error') AS bad_event_time,
       count(*) FILTER (WHERE {_LONG}) AS bad_brand,
       CAST(0 AS BIGINT) AS bad_event_type, CAST(0 AS BIGINT) AS bad_product_id, CAST(0 AS BIGINT) AS bad_category_id,
       CAST(0 AS BIGINT) AS bad_category_code, CAST(0 AS BIGINT) AS bad_price, CAST(0 AS BIGINT) AS bad_user_id,
       CAST(0 AS BIGINT) AS bad_user_session
FROM r"""

# A row of the wrong width is one defect; the others lose a time or a brand.
_QUARANTINE = f"""WITH {_STAGED},
d AS (
    SELECT NULL AS column_name, 'wrong number of fields' AS reason, NULL AS value, event_id FROM r WHERE {_WIDTH}
    UNION ALL
    SELECT 'event_time', 'malformed', strftime(ts, '%H:%M'), event_id FROM r WHERE kind = 'error'
    UNION ALL
    SELECT 'brand', 'too long', repeat('b', 101), event_id FROM r WHERE {_LONG}
)
SELECT column_name, reason, value, count(*) AS defects, count(DISTINCT event_id) AS lines FROM d GROUP BY column_name, reason, value"""


def _active(src: str, period: str) -> str:
    """x(p, n, i): distinct users per period, periods numbered in order."""
    return f"""{src},
seen AS (SELECT DISTINCT {period} AS p, u FROM e),
x AS (SELECT p, count(u) AS n, row_number() OVER (ORDER BY p) AS i FROM seen GROUP BY p)"""


_DAY = "CAST(t AS DATE)"
_WEEK = "CAST(t AS DATE) - CAST(isodow(CAST(t AS DATE)) - 1 AS INTEGER)"
_LABELLED = """CAST(isodow(a.p) AS INTEGER) AS day_of_week,
       ['Будний день', 'Выходной'][CAST(isodow(a.p) >= 6 AS INTEGER) + 1] AS day_type"""


def _dau(src: str) -> str:
    return f"""WITH {_active(src, _DAY)}
SELECT a.p AS activity_date, a.n AS dau, {_half_up('sum(b.n)', 'count(*)', 1, 1)} AS dau_7d_moving_avg,
       {_LABELLED}
FROM x a JOIN x b ON b.i <= a.i AND b.i > a.i - 7
GROUP BY a.p, a.n"""


def _dau_filled(src: str) -> str:
    return f"""WITH {_active(src, _DAY)},
span AS (SELECT min(p) AS lo, max(p) AS hi FROM x),
days AS (SELECT CAST(lo + CAST(k AS INTEGER) AS DATE) AS p FROM (SELECT lo, unnest(range(CAST(hi - lo AS BIGINT) + 1)) AS k FROM span)),
full_days AS (SELECT p, coalesce((SELECT n FROM x WHERE x.p = days.p), 0) AS n FROM days)
SELECT a.p AS activity_date, a.n AS dau, {_half_up('sum(b.n)', 'count(*)', 1, 1)} AS dau_7d_moving_avg,
       {_LABELLED}
FROM full_days a JOIN full_days b ON b.p <= a.p AND b.p > a.p - 7
GROUP BY a.p, a.n"""


def _wau(src: str) -> str:
    return f"""WITH {_active(src, _WEEK)}
SELECT a.p AS week_start, CAST(isoyear(a.p) AS INTEGER) AS iso_year, CAST(weekofyear(a.p) AS INTEGER) AS iso_week,
       a.n AS wau, a.n - b.n AS wau_diff, {_pct2('(a.n - b.n)', 'b.n')} AS wau_growth_pct
FROM x a LEFT JOIN x b ON b.i + 1 = a.i"""


def _wau_alone(src: str) -> str:
    return f"""WITH {_active(src, _WEEK)}
SELECT p AS week_start, n AS wau FROM x"""


def _mau_alone(src: str) -> str:
    return f"""WITH {_active(src, "strftime(t, '%Y-%m')")}
SELECT CAST(a.p || '-01' AS DATE) AS activity_month, a.p AS month_label, a.n AS mau, a.n - b.n AS mau_diff, {_pct2('(a.n - b.n)', 'b.n')} AS mau_growth_pct
FROM x a LEFT JOIN x b ON b.i + 1 = a.i"""


def _mau(src: str) -> str:
    return f"""WITH {src},
seen AS (SELECT strftime(t, '%Y-%m') AS m, CAST(t AS DATE) AS d, u FROM e GROUP BY ALL),
per_day AS (SELECT m, d, count(u) AS n FROM seen GROUP BY m, d),
days AS (SELECT m, list(n) AS ns FROM per_day GROUP BY m),
rows_of AS (SELECT strftime(t, '%Y-%m') AS m, coalesce(len(list(DISTINCT u) FILTER (WHERE u IS NOT NULL)), 0) AS mau,
           coalesce(len(list(DISTINCT sess) FILTER (WHERE sess IS NOT NULL)), 0) AS sessions, count(*) AS events FROM e GROUP BY 1),
x AS (
    SELECT m, mau, sessions, events, list_min(ns) AS lo, list_max(ns) AS hi,
           CAST((2 * list_sum(ns) + len(ns)) // (2 * len(ns)) AS BIGINT) AS mean, row_number() OVER (ORDER BY m) AS i
    FROM rows_of JOIN days USING (m)
)
SELECT CAST(a.m || '-01' AS DATE) AS activity_month, a.m AS month_label, a.mau, CAST(a.mean AS DOUBLE) AS avg_dau,
       a.lo AS min_dau, a.hi AS max_dau,
       {_pct2('a.mean', 'a.mau')} AS sticky_factor_pct,
       {_half_up('a.sessions', 'a.mau', 100, 100)} AS sessions_per_user,
       {_half_up('a.events', 'a.mau', 100, 100)} AS events_per_user,
       a.mau - b.mau AS mau_diff, {_pct2('(a.mau - b.mau)', 'b.mau')} AS mau_growth_pct
FROM x a LEFT JOIN x b ON b.i + 1 = a.i"""


def _funnel_rows(src: str, steps: tuple[str, str, str] = FUNNEL_STEPS) -> str:
    """f(sess, t1, t2, t3): each step's time from the session's list of times of that kind."""
    k1, k2, k3 = steps
    return f"""{src},
times AS (
    SELECT sess, list(t) FILTER (WHERE kind = '{k1}') AS l1, list(t) FILTER (WHERE kind = '{k2}') AS l2, list(t) FILTER (WHERE kind = '{k3}') AS l3
    FROM e WHERE sess IS NOT NULL GROUP BY sess
),
f1 AS (SELECT sess, list_min(l1) AS t1, l2, l3 FROM times WHERE l1 IS NOT NULL),
f2 AS (SELECT sess, t1, list_min([x FOR x IN l2 IF x > t1]) AS t2, l3 FROM f1),
f AS (SELECT sess, t1, t2, list_min([x FOR x IN l3 IF x > t2]) AS t3 FROM f2)"""


_FUNNEL_SESSIONS = f"""WITH {_funnel_rows(_EV)}
SELECT sess AS user_session, t1 AS view_at, t2 AS click_at, t3 AS purchase_at FROM f"""


def _funnel_steps(src: str) -> str:
    return f"""WITH {_funnel_rows(src)},
n AS (SELECT [count(t1), count(t2), count(t3)] AS ns, ['view', 'click', 'purchase'] AS names FROM f),
x AS (SELECT unnest([1, 2, 3]) AS i, ns, names FROM n)
SELECT CAST(i AS INTEGER) AS step_no, names[i] AS step_name, ns[i] AS sessions,
       CASE WHEN i > 1 THEN {_pct2('ns[i]', 'ns[i - 1]')} END AS micro_cr_pct,
       {_pct2('ns[i]', 'ns[1]')} AS macro_cr_pct,
       CASE WHEN i > 1 THEN ns[i - 1] - ns[i] END AS sessions_lost,
       CASE WHEN i > 1 THEN {_pct2('(ns[i - 1] - ns[i])', 'ns[i - 1]')} END AS drop_off_pct
FROM x"""


def _funnel_monthly(src: str, steps: tuple[str, str, str]) -> str:
    a, b, c = steps
    return f"""WITH {_funnel_rows(src, steps)},
x AS (SELECT strftime(t1, '%Y-%m') AS m, count(*) AS n1, count(t2) AS n2, count(t3) AS n3 FROM f GROUP BY 1)
SELECT CAST(m || '-01' AS DATE) AS month, m AS month_label,
       n1 AS "sessions_{a}", n2 AS "sessions_{b}", n3 AS "sessions_{c}",
       {_pct2('n2', 'n1')} AS "cr_{a}_to_{b}_pct", {_pct2('n3', 'n2')} AS "cr_{b}_to_{c}_pct", {_pct2('n3', 'n1')} AS cr_macro_pct
FROM x"""


def _level(xs: str, q: float) -> str:
    """Interpolated percentile of a sorted list of seconds, one digit."""
    at = f"({q} * (len({xs}) - 1))"
    low, high = f"{xs}[CAST(floor({at}) AS BIGINT) + 1]", f"{xs}[CAST(ceil({at}) AS BIGINT) + 1]"
    value = f"CASE WHEN {low} = {high} THEN {low} ELSE {low} + ({at} - floor({at})) * ({high} - {low}) END"
    return f"CAST(ROUND(CAST(CAST({value} AS VARCHAR) AS DECIMAL(38,6)), 1) AS DOUBLE)"


_FUNNEL_DURATIONS = f"""WITH {_funnel_rows(_EV)},
x AS (
    SELECT list_sort(list((epoch_us(t2) - epoch_us(t1)) / 1000000.0)) AS a,
           list_sort(list((epoch_us(t3) - epoch_us(t2)) / 1000000.0) FILTER (WHERE t3 IS NOT NULL)) AS b,
           list_sort(list((epoch_us(t3) - epoch_us(t1)) / 1000000.0) FILTER (WHERE t3 IS NOT NULL)) AS c
    FROM f WHERE t2 IS NOT NULL
)
SELECT CAST(len(a) AS BIGINT) AS sessions_with_click, CAST(len(b) AS BIGINT) AS sessions_with_purchase,
       {_level('a', 0.5)} AS median_sec_view_to_click, {_level('a', 0.9)} AS p90_sec_view_to_click,
       {_level('b', 0.5)} AS median_sec_click_to_purchase, {_level('b', 0.9)} AS p90_sec_click_to_purchase,
       {_level('c', 0.5)} AS median_sec_total
FROM x"""


def _cart_rows(src: str, paid: str) -> str:
    """k(sess, first_cart, first_paid, removed, price, outcome), from the session's ordered events."""
    return f"""{src},
g AS (
    SELECT sess, list({{'t': t, 'kind': kind, 'price': price}} ORDER BY t) AS evs FROM e
    WHERE sess IS NOT NULL AND kind IN ('click', 'purchase', 'error') GROUP BY sess
),
h AS (
    SELECT sess, [v FOR v IN evs IF v.kind = 'click'] AS carts, [v.t FOR v IN evs IF v.kind = 'purchase'] AS paid,
           CAST(len([1 FOR v IN evs IF v.kind = 'error']) AS BIGINT) AS removed
    FROM g
),
k AS (
    SELECT sess, carts[1].t AS first_cart, paid[1] AS first_paid, removed, list_max([v.price FOR v IN carts]) AS price,
           CASE WHEN {paid} THEN 'Оплачена' WHEN removed = 0 THEN 'Брошена без действий' ELSE 'Товар удалён из корзины' END AS outcome
    FROM h WHERE len(carts) > 0
)"""


_PAID_FIRST = "coalesce(paid[1] > carts[1].t, FALSE)"
_PAID_ANY = "coalesce(paid[-1] > carts[1].t, FALSE)"

_CART_SESSIONS = f"""WITH {_cart_rows(_EV, _PAID_FIRST)}
SELECT sess AS user_session, first_cart AS carted_at, first_paid AS purchased_at, removed AS removals,
       CAST(price AS DOUBLE) AS cart_price, outcome AS cart_outcome
FROM k"""


def _cart_report(src: str, paid: str) -> str:
    return f"""WITH {_cart_rows(src, paid)},
o AS (SELECT outcome, count(*) AS n, count(price) AS priced, CAST(sum(price) * 100 AS BIGINT) AS cents FROM k GROUP BY outcome)
SELECT outcome AS cart_outcome, n AS sessions, {_pct2('n', '(SELECT count(*) FROM k)')} AS share_pct,
       {_half_up('cents', 'priced', 1, 100)} AS avg_cart_price
FROM o"""


_INDEX = "CAST(year(t) * 12 + month(t) - 1 AS INTEGER)"


def _cohort_rows(src: str) -> str:
    """lives(u, c, ages): a user's first month and the list of their months of life; data_end(m)."""
    return f"""{src},
data_end AS (SELECT max({_INDEX}) AS m FROM e),
months AS (SELECT u, list_sort(list(DISTINCT {_INDEX})) AS ms FROM e WHERE u IS NOT NULL GROUP BY u),
lives AS (SELECT u, ms[1] AS c, [m - ms[1] FOR m IN ms] AS ages FROM months),
cohorts AS (
    SELECT c, count(*) AS n, flatten(list(ages)) AS ages, list(ages[-1]) AS lasts, (SELECT m FROM data_end) - c AS horizon FROM lives GROUP BY c
)"""


def _month(index: str) -> str:
    return f"make_date(CAST({index} // 12 AS BIGINT), CAST({index} % 12 + 1 AS BIGINT), 1)"


_COHORT_ACTIVITY = f"""WITH {_cohort_rows(_ORD)}
SELECT u AS user_id, {_month('c')} AS cohort_month, CAST(unnest(ages) AS INTEGER) AS month_num,
       CAST(ages[-1] AS INTEGER) AS last_active_month, {_month('(SELECT m FROM data_end)')} AS data_last_month
FROM lives"""


def _matrix(src: str, as_pct: bool, masked: bool) -> str:
    cells = []
    for k in range(7):
        active = f"CAST(len([1 FOR a IN ages IF a = {k}]) AS BIGINT)"
        value = _pct1(active, "n") if as_pct else active
        cells.append(f"{f'CASE WHEN horizon >= {k} THEN {value} END' if masked else value} AS m{k}{'' if as_pct else '_users'}")
    size = "n AS total_users," if as_pct else ""
    return f"""WITH {_cohort_rows(src)}
SELECT {_month('c')} AS cohort_month, strftime({_month('c')}, '%Y-%m') AS cohort, {size}
       {', '.join(cells)}
FROM cohorts"""


_RETENTION_LONG = f"""WITH {_cohort_rows(_ORD)},
x AS (SELECT c, n, ages, lasts, unnest(list_distinct(ages)) AS k FROM cohorts)
SELECT {_month('c')} AS cohort_month, strftime({_month('c')}, '%Y-%m') AS cohort, n AS total_users, CAST(k AS INTEGER) AS month_num,
       CAST(len([1 FOR a IN ages IF a = k]) AS BIGINT) AS active_users,
       {_pct1('len([1 FOR a IN ages IF a = k])', 'n')} AS retention_pct,
       {_pct1('len([1 FOR l IN lasts IF l >= k])', 'n')} AS rolling_retention_pct
FROM x"""


def _curve(src: str) -> str:
    return f"""WITH {_cohort_rows(src)},
x AS (SELECT n, ages, unnest(range(horizon + 1)) AS k FROM cohorts),
y AS (SELECT k, count(*) AS cohorts, sum(len([1 FOR a IN ages IF a = k])) AS active, sum(n) AS eligible FROM x GROUP BY k)
SELECT CAST(k AS INTEGER) AS month_num, cohorts AS cohorts_count, CAST(active AS BIGINT) AS active_users,
       CAST(eligible AS BIGINT) AS total_eligible_users, {_pct1('active', 'eligible')} AS avg_retention_pct
FROM y"""


# The published arithmetic: a cohort's size counts once per active user.
_CURVE_FANOUT = f"""WITH {_cohort_rows(_ORD)},
x AS (SELECT c, n, unnest(ages) AS k FROM cohorts),
y AS (SELECT k, len(list(DISTINCT c)) AS cohorts, count(*) AS active, sum(n) AS eligible FROM x GROUP BY k)
SELECT CAST(k AS INTEGER) AS month_num, CAST(cohorts AS BIGINT) AS cohorts_count, active AS active_users,
       CAST(eligible AS BIGINT) AS total_eligible_users, {_pct1('active', 'eligible')} AS avg_retention_pct
FROM y"""


def oracle_sql() -> dict[str, str]:
    return (llm.oracle_sql() if llm else {}) | {
        "profile_volume": _profile_volume(_EV),
        "profile_volume_orders": _profile_volume(_ORD),
        "profile_volume_gaps": _profile_volume(_EV_GAPS),
        "profile_event_share": _profile_share(_EV),
        "profile_event_share_orders": _profile_share(_ORD),
        "profile_nulls": _CLEAN_NULLS,
        "profile_nulls_orders": _profile_nulls(_ORD_GAPS),
        "profile_nulls_gaps": _profile_nulls(_EV_GAPS),
        "clean_events": _CLEAN,
        "load_events_text": _LOADED,
        "load_errors": _LOAD_ERRORS,
        "load_quarantine": _QUARANTINE,
        "load_multi_line": _MULTI_LINE,
        "dau_moving_avg": _dau(_EV),
        "dau_moving_avg_orders": _dau(_ORD),
        "dau_moving_avg_orders_filled": _dau_filled(_ORD),
        "wau_growth": _wau(_EV),
        "wau_growth_orders": _wau(_ORD),
        "mau_sticky": _mau(_ORD),
        "mau_sticky_events": _mau(_EV),
        "mau_sticky_gaps": _mau(_ORD_GAPS),
        "wau_rollup": _wau_alone(_EV_GAPS),
        "mau_rollup": _mau_alone(_ORD),
        "funnel_sessions": _FUNNEL_SESSIONS,
        "funnel_sessions_sliced": _FUNNEL_SESSIONS,
        "funnel_sessions_stored": _FUNNEL_SESSIONS,
        "funnel_steps_sliced_gaps": _funnel_steps(_EV_GAPS),
        "funnel_steps": _funnel_steps(_EV),
        "funnel_steps_gaps": _funnel_steps(_EV_GAPS),
        "funnel_monthly": _funnel_monthly(_EV, FUNNEL_STEPS),
        "funnel_monthly_orders": _funnel_monthly(_ORD_CUSTOMER, ORDER_STEPS),
        "funnel_durations": _FUNNEL_DURATIONS,
        "cart_sessions": _CART_SESSIONS,
        "cart_outcomes": _cart_report(_EV, _PAID_FIRST),
        "cart_outcomes_any_after_cart": _cart_report(_EV, _PAID_ANY),
        "cart_outcomes_gaps": _cart_report(_EV_GAPS, _PAID_FIRST),
        "cohort_activity": _COHORT_ACTIVITY,
        "cohort_activity_one_pass": _COHORT_ACTIVITY,
        "retention_matrix_pct": _matrix(_ORD, True, False),
        "retention_matrix_pct_masked": _matrix(_ORD, True, True),
        "retention_matrix_pct_masked_gaps": _matrix(_ORD_GAPS, True, True),
        "retention_matrix_users": _matrix(_ORD, False, False),
        "retention_long": _RETENTION_LONG,
        "retention_long_merged": _RETENTION_LONG,
        "retention_matrix_pct_masked_gaps_merged": _matrix(_ORD_GAPS, True, True),
        "retention_curve": _curve(_ORD),
        "retention_curve_gaps": _curve(_ORD_GAPS),
        "retention_curve_row_fanout": _CURVE_FANOUT,
    }
