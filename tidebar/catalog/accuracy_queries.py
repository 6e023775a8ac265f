"""Predictions, matching and accuracy."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidebar.catalog.base import (
    EVENT_BARS, emit, emit_sql, event_bars, event_series, mean, query, spec, table,
)
from tidebar.functions.clock import calendar_features, micros_between, moment, seconds, shifted
from tidebar.functions.scalars import age_text, div, quality_band, rounded, stars
from tidebar.operators.nearest import nearest
from tidebar.operators.percentiles import exact_percentiles
from tidebar.operators.versions import last_row, last_rows_by_time, latest_per_key, top_rows, upsert
from tidebar.plans import accuracy as acc, features as fx, matching as mt
from tidebar.session import staged
from tidebar.sources.bars import latest_price, lookback

AS_OF_TEXT = "2024-01-20 12:00:00"
AS_OF_SQL = f"timestamp '{AS_OF_TEXT}'"


def as_of():
    return moment(AS_OF_TEXT)


# -- the tables the queries share ---------------------------------------------------------------


def naive_predictions(spark, sf):
    """Deterministic forecasts: the price itself, its 14-row mean, its 50-row mean."""
    s = fx.add_moving_averages(event_series(spark, sf))
    rows = s.rows("asset", "datetime", "_rn", "price", "sma_14", "sma_50")
    offers = F.array(
        *[
            F.struct(
                F.lit(h).alias("horizon"),
                F.col(p).alias("predicted_price"),
                (F.col("datetime") + F.expr(f"INTERVAL '{n}' HOUR")).alias("target_timestamp"),
            )
            for h, n, p in (("1h", 1, "price"), ("1d", 24, "sma_14"), ("1w", 168, "sma_50"))
        ]
    )
    flat = rows.select("asset", F.col("datetime").alias("created_at"), "_rn", F.inline(offers))
    flat = flat.where(F.col("predicted_price").isNotNull())
    confidence = F.lit(0.5) + (F.col("_rn") % 50) / 100
    return staged(
        flat.withColumns({"confidence": confidence, "prediction_id": mt.prediction_key()}).select(
            "prediction_id", "asset", "horizon", "predicted_price", "confidence", "target_timestamp", "created_at"
        ),
        "predictions",
    )


_PREDS = f"""{EVENT_BARS}, avgs as (select *, {mean('price', 14)} as sma_14, {mean('price', 50)} as sma_50 from bars),
offers as (
  select asset, rn, datetime as created_at, '1h' as horizon, price as predicted_price, datetime + interval 1 hour as target_timestamp from avgs
  union all select asset, rn, datetime, '1d', sma_14, datetime + interval 24 hour from avgs
  union all select asset, rn, datetime, '1w', sma_50, datetime + interval 168 hour from avgs),
predictions as (select concat_ws('|', asset, horizon, strftime(created_at, '%Y-%m-%d %H:%M:%S.%f')) as prediction_id,
  asset, horizon, predicted_price, 0.5 + (rn % 50)::double / 100 as confidence, target_timestamp, created_at
  from offers where predicted_price is not null)"""


def all_evaluations(spark, sf):
    """Evaluations of every prediction with a known target price; predictions made in
    every sixth hour are evaluated twice, the second time with another forecast."""
    bars = staged(event_bars(spark, sf), "bars")
    first = naive_predictions(spark, sf).withColumn(
        "_at", F.col("target_timestamp") + F.expr("INTERVAL '10' MINUTE")
    )
    again = first.where(F.hour("created_at") % 6 == 0).withColumns(
        {"predicted_price": F.col("predicted_price") * 1.01, "_at": F.col("_at") + F.expr("INTERVAL '1' HOUR")}
    )
    return staged(mt.evaluate_all(first.unionByName(again), bars, F.col("_at")), "evaluations")


_ERRORS = """abs(predicted_price - actual_price) as absolute_error,
  case when actual_price <> 0 then abs(predicted_price - actual_price) / actual_price * 100 else 0.0 end as percent_error,
  (predicted_price - actual_price) * (predicted_price - actual_price) as squared_error,
  case when start_price is null then 1 else (predicted_price > start_price)::integer end as direction_predicted,
  case when start_price is null then (actual_price > predicted_price)::integer
       else (actual_price > start_price)::integer end as direction_actual"""
_EVALS = f"""{_PREDS}, twice as (
  select *, target_timestamp + interval 10 minute as evaluation_timestamp from predictions
  union all select * replace (predicted_price * 1.01 as predicted_price), target_timestamp + interval 70 minute
  from predictions where hour(created_at) % 6 = 0),
priced as (select t.*, b.price as actual_price, s.price as start_price from twice t
  join bars b on b.asset = t.asset and b.datetime = t.target_timestamp
  left join bars s on s.asset = t.asset and s.datetime = t.created_at),
evals0 as (select *, {_ERRORS}, created_at as prediction_timestamp from priced),
evals as (select *, (direction_predicted = direction_actual)::integer as direction_correct from evals0),
newest as (select * from evals qualify row_number() over (
  partition by target_timestamp, horizon, asset order by evaluation_timestamp desc) = 1)"""

_EVAL_OUT = spec(
    "prediction_id asset horizon predicted_price:6 actual_price:6 absolute_error:6 percent_error:8 "
    "squared_error:4 direction_predicted direction_actual direction_correct prediction_timestamp "
    "evaluation_timestamp target_timestamp confidence:6"
)


# -- nearest joins ----------------------------------------------------------------------------------

_EV_PRICE = f"""with {EVENT_BARS}, probes as (select event_id, event_type as asset, ts from events),
hits as (select event_id, arg_min(b.price, abs(epoch_us(b.datetime) - epoch_us(p.ts)) * 2 + (b.datetime > p.ts)::integer) as near_price,
  arg_min(b.datetime, abs(epoch_us(b.datetime) - epoch_us(p.ts)) * 2 + (b.datetime > p.ts)::integer) as near_time
  from probes p join bars b on b.asset = p.asset and abs(epoch_us(b.datetime) - epoch_us(p.ts)) COMPARE LIMIT group by 1)
select probes.event_id, round(near_price, 6) + 0.0 as near_price, near_time from probes left join hits using (event_id)"""


def _nearest_bar(spark, sf, tolerance, inclusive):
    probes = table(spark, sf, "events").select("event_id", F.col("event_type").alias("asset"), "ts")
    found = nearest(
        probes, staged(event_bars(spark, sf), "bars"), keys=["asset"], probe_ts="ts", fact_ts="datetime",
        values={"near_price": "price"}, tolerance_seconds=tolerance, inclusive=inclusive, out_ts="near_time",
    )
    return emit(found, spec("event_id near_price:6 near_time"))


@query("nearest_bar_within_half_hour", _EV_PRICE.replace("COMPARE", "<").replace("LIMIT", "1800000000"))
def nearest_half_hour(spark, sf):
    return _nearest_bar(spark, sf, 1800, False)


@query("nearest_bar_within_two_hours", _EV_PRICE.replace("COMPARE", "<=").replace("LIMIT", "7200000000"))
def nearest_two_hours(spark, sf):
    return _nearest_bar(spark, sf, 7200, True)


def _first_rounds(spark, sf):
    """Evaluations made before the day of the round."""
    return all_evaluations(spark, sf).where(F.col("evaluation_timestamp") < F.lit("2024-01-18").cast("timestamp_ntz"))


@query(
    "pending_predictions",
    f"with {_EVALS} select prediction_id, asset, horizon, created_at from predictions "
    "where prediction_id not in (select prediction_id from evals where evaluation_timestamp < timestamp '2024-01-18')",
)
def pending(spark, sf):
    rows = mt.pending(naive_predictions(spark, sf), _first_rounds(spark, sf))
    return rows.select("prediction_id", "asset", "horizon", "created_at")


_AGE = f"(epoch_us({AS_OF_SQL}) - epoch_us(created_at))"


def _case(values):
    return "case " + " ".join(f"when horizon = '{h}' then {v}" for h, v in values.items()) + " end"


_WANTED = _case({h: a * mt.MINUTE for h, (a, _) in mt.DUE.items()})
_SLACK = _case({h: s * mt.MINUTE for h, (_, s) in mt.DUE.items()})
_DUE = f"""due as (select * from predictions where abs({_AGE} - {_WANTED}) <= {_SLACK}
  and prediction_id not in (select prediction_id from evals where evaluation_timestamp < timestamp '2024-01-18')
  qualify row_number() over (partition by asset, horizon order by abs({_AGE} - {_WANTED}), created_at desc) = 1)"""
_PRED_OUT = spec("prediction_id asset horizon predicted_price:6 confidence:6 target_timestamp created_at")


@query("due_predictions", f"with {_EVALS}, {_DUE} {emit_sql(_PRED_OUT, 'due')}")
def due(spark, sf):
    return emit(mt.due_predictions(naive_predictions(spark, sf), _first_rounds(spark, sf), as_of()), _PRED_OUT)


_CMP = _case({h: f"{_AGE} between {a * mt.MINUTE} and {b * mt.MINUTE}" for h, (a, b) in mt.COMPARABLE.items()})


@query(
    "comparable_predictions",
    f"""with {_PREDS} select asset, horizon, round(arg_max(predicted_price, created_at), 6) + 0.0 as predicted_price,
  max(created_at) as created_at from predictions where {_CMP} group by 1, 2""",
)
def comparable(spark, sf):
    rows = mt.comparable_predictions(naive_predictions(spark, sf), as_of())
    return emit(rows, spec("asset horizon predicted_price:6 created_at"))


_RANK = "case horizon when '1h' then 1 when '1d' then 2 else 3 end"
_RECENT_OUT = spec("asset horizon created_at predicted_price:6 actual_price:6 predicted_return:4 confidence:6 age_minutes:3")


@query(
    "recent_predictions_against_latest",
    f"""with {_PREDS}, old as (select * from predictions where created_at <= {AS_OF_SQL} - interval 1 hour
  order by created_at desc, asset, {_RANK}, prediction_id limit 100),
now as (select asset, arg_max(price, datetime) as actual_price from bars group by 1),
r as (select old.*, actual_price, (predicted_price - actual_price) / nullif(actual_price, 0) * 100 as predicted_return,
  {_AGE} / 60000000.0 as age_minutes from old join now using (asset)
  where {_AGE} >= {_case({h: m * mt.MINUTE for h, m in mt.ROUGH_AGE.items()})}) {emit_sql(_RECENT_OUT, 'r')}""",
)
def recent(spark, sf):
    bars = event_bars(spark, sf)
    return emit(mt.recent_against_latest(naive_predictions(spark, sf), bars, as_of()), _RECENT_OUT)


# -- actual prices and evaluation ----------------------------------------------------------------------

def _price_sources(spark, sf):
    """The same bars seen through three sources, each with holes."""
    bars = staged(event_bars(spark, sf), "bars")
    stored = bars.where(F.hour("datetime") % 5 == 0).select(
        "asset",
        (F.col("datetime") + F.expr("INTERVAL '4' MINUTE")).alias("target_timestamp"),
        (F.col("price") + 1).alias("actual_price"),
    )
    held = bars.where(F.hour("datetime") % 3 == 0)
    fetched = bars.where(F.hour("datetime") % 2 == 0).withColumn("price", F.col("price") + 2)
    return bars, stored, held, fetched


_SOURCES = f"""stored as (select asset, datetime + interval 4 minute as at, price + 1 as price from bars where hour(datetime) % 5 = 0),
held as (select asset, datetime as at, price from bars where hour(datetime) % 3 = 0),
fetched as (select asset, datetime as at, price + 2 as price from bars where hour(datetime) % 2 = 0),
nowp as (select asset, arg_max(price, datetime) as price from bars group by 1)"""


def _near(source, limit, compare, probes="asked"):
    gap = "abs(epoch_us(b.at) - epoch_us(p.target_timestamp))"
    return f"""near_{source} as (select prediction_id, arg_min(b.price, {gap} * 2 + (b.at > p.target_timestamp)::integer) as p_{source}
  from {probes} p join {source} b on b.asset = p.asset and {gap} {compare} {limit * 1000000} group by 1)"""


def _resolve_sql(probes):
    hours = f"abs(epoch_us({AS_OF_SQL}) - epoch_us(target_timestamp)) / 3600000000.0"
    return f"""{_SOURCES}, {_near('stored', 360, '<', probes)}, {_near('held', 1800, '<', probes)}, {_near('fetched', 7200, '<=', probes)},
resolved as (select a.*, case when p_stored is not null then 'stored' when p_held is not null then 'bar'
  when {hours} between 1 and 168 and p_fetched is not null then 'fetched'
  when {hours} < 1 and nowp.price is not null then 'current' end as price_source,
  coalesce(p_stored, p_held, case when {hours} between 1 and 168 then p_fetched end,
    case when {hours} < 1 then nowp.price end) as actual_price
  from {probes} a left join near_stored using (prediction_id) left join near_held using (prediction_id)
  left join near_fetched using (prediction_id) left join nowp using (asset))"""


_RES_OUT = spec("prediction_id asset horizon target_timestamp actual_price:6 price_source")


@query("actual_price_by_priority", f"with {_PREDS}, {_resolve_sql('predictions')} {emit_sql(_RES_OUT, 'resolved')}")
def actual_price(spark, sf):
    bars, stored, held, fetched = _price_sources(spark, sf)
    rows = mt.resolve_actual_price(
        naive_predictions(spark, sf), stored, held, fetched, latest_price(bars), as_of()
    )
    return emit(rows, _RES_OUT)


@query("evaluations", f"with {_EVALS} {emit_sql(_EVAL_OUT, 'evals')}")
def evaluations(spark, sf):
    return emit(all_evaluations(spark, sf), _EVAL_OUT)


@query(
    "evaluation_round",
    f"""with {_EVALS}, {_DUE}, {_resolve_sql('due')},
started as (select r.*, s.price as start_price from resolved r left join held s
  on s.asset = r.asset and s.at = r.created_at where actual_price is not null),
round0 as (select *, {_ERRORS}, created_at as prediction_timestamp, {AS_OF_SQL} as evaluation_timestamp from started),
done as (select *, (direction_predicted = direction_actual)::integer as direction_correct from round0)
{emit_sql(_EVAL_OUT, 'done')}""",
)
def evaluation_round(spark, sf):
    _, stored, held, fetched = _price_sources(spark, sf)
    rows = mt.evaluate_due(
        naive_predictions(spark, sf), _first_rounds(spark, sf), stored, held, fetched, as_of()
    )
    return emit(rows, _EVAL_OUT)


_WIDE = ", ".join(f"max(predicted_price) filter (where horizon = '{h}') as predicted_price_{h}" for h in ("1h", "1d", "1w"))
_TS_OUT = spec(
    "asset timestamp actual_price:6 "
    + " ".join(f"predicted_price_{h}:6 error_{h}:6 percent_error_{h}:8" for h in ("1h", "1d", "1w"))
)
_TS_ERR = ", ".join(
    f"""case when g.predicted_price_{h} is not null then abs(o{h}.old - g.actual_price) end as error_{h},
  case when g.predicted_price_{h} is not null then abs(o{h}.old - g.actual_price) / nullif(g.actual_price, 0) * 100 end as percent_error_{h}"""
    for h in ("1h", "1d", "1w")
)


def _old(h, hours, limit):
    gap = f"abs(epoch_us(b.timestamp) - epoch_us(p.timestamp - interval {hours} hour))"
    return f"""o{h} as (select p.asset, p.timestamp, arg_min_null(b.predicted_price_{h},
  {gap} * 2 + (b.timestamp > p.timestamp - interval {hours} hour)::integer) as old
  from g p join g b on b.asset = p.asset and {gap} < {limit * 1000000} group by 1, 2)"""


@query(
    "prediction_timeseries",
    f"""with {_PREDS}, w as (select asset, created_at as timestamp, {_WIDE} from predictions group by 1, 2),
g0 as (select w.asset, w.timestamp, bars.price as actual_price, predicted_price_1h, predicted_price_1d, predicted_price_1w,
  epoch_us(w.timestamp) - min(epoch_us(w.timestamp)) over (partition by w.asset) as age
  from w join bars on bars.asset = w.asset and bars.datetime = w.timestamp),
g as (select * replace (case when age >= 86400000000 then predicted_price_1d end as predicted_price_1d,
  case when age >= 604800000000 then predicted_price_1w end as predicted_price_1w) from g0),
{_old('1h', 1, 600)}, {_old('1d', 24, 3600)}, {_old('1w', 168, 43200)},
t as (select g.*, {_TS_ERR} from g left join o1h using (asset, timestamp) left join o1d using (asset, timestamp)
  left join o1w using (asset, timestamp)) {emit_sql(_TS_OUT, 't')}""",
)
def prediction_timeseries(spark, sf):
    bars = event_bars(spark, sf).select("asset", F.col("datetime").alias("timestamp"), F.col("price").alias("actual_price"))
    wide = (
        naive_predictions(spark, sf)
        .groupBy("asset", F.col("created_at").alias("timestamp"))
        .pivot("horizon", ["1h", "1d", "1w"])
        .agg(F.max("predicted_price"))
        .withColumnsRenamed({h: f"predicted_price_{h}" for h in ("1h", "1d", "1w")})
    )
    observed = staged(wide.join(bars, ["asset", "timestamp"]), "observed")
    return emit(mt.prediction_timeseries(observed), _TS_OUT)


# -- accuracy ----------------------------------------------------------------------------------------------

_METRIC_SQL = """count(*) as total_predictions, avg(absolute_error) as mean_absolute_error,
  avg(percent_error) as mean_percent_error, stddev_samp(percent_error) as std_percent_error,
  sqrt(avg(absolute_error * absolute_error)) as root_mean_squared_error,
  avg(direction_correct) as direction_accuracy, min(absolute_error) as min_error, max(absolute_error) as max_error,
  median(percent_error) as median_percent_error, median(absolute_error) as median_absolute_error, """ + ", ".join(
    f"quantile_cont(percent_error, {q}) as percent_error_{n}" for n, q in acc.PERCENTILES.items()
)
_METRICS = (
    "total_predictions mean_absolute_error:5 mean_percent_error:8 std_percent_error:8 "
    "root_mean_squared_error:5 direction_accuracy:6 min_error:6 max_error:6 median_percent_error:8 "
    "median_absolute_error:7 " + " ".join(f"percent_error_{n}:8" for n in acc.PERCENTILES)
)
_MET_OUT = spec("asset horizon " + _METRICS)


@query(
    "accuracy_metrics",
    f"with {_EVALS}, m as (select asset, horizon, {_METRIC_SQL} from newest group by 1, 2) {emit_sql(_MET_OUT, 'm')}",
)
def accuracy_metrics(spark, sf):
    return emit(acc.accuracy_metrics(all_evaluations(spark, sf)), _MET_OUT)


@query(
    "accuracy_metrics_last_days",
    f"""with {_EVALS}, late as (select * from evals where evaluation_timestamp >= {AS_OF_SQL} - interval 7 day
  qualify row_number() over (partition by target_timestamp, horizon, asset order by evaluation_timestamp desc) = 1),
m as (select asset, horizon, {_METRIC_SQL} from late group by 1, 2) {emit_sql(_MET_OUT, 'm')}""",
)
def accuracy_metrics_last_days(spark, sf):
    return emit(acc.accuracy_metrics(acc.since(all_evaluations(spark, sf), as_of(), 7)), _MET_OUT)


_PER_OUT = spec("asset horizon period_start period_end " + _METRICS)


@query(
    "accuracy_by_period",
    f"""with {_EVALS}, p as (select *, time_bucket(interval 7 day, evaluation_timestamp, timestamp '1970-01-01') as period_start from newest),
m as (select asset, horizon, period_start, period_start + interval 7 day as period_end, {_METRIC_SQL}
  from p group by 1, 2, 3, 4) {emit_sql(_PER_OUT, 'm')}""",
)
def accuracy_by_period(spark, sf):
    return emit(acc.accuracy_by_period(all_evaluations(spark, sf)), _PER_OUT)


_DEDUP_OUT = spec("target_timestamp horizon asset prediction_id evaluation_timestamp absolute_error:6")


@query("newest_evaluations", f"with {_EVALS} {emit_sql(_DEDUP_OUT, 'newest')}")
def newest_evaluations(spark, sf):
    return emit(acc.newest_evaluations(all_evaluations(spark, sf)), _DEDUP_OUT)


_VIEW = ", ".join(
    f"max({m}) filter (where horizon = '{h}') as {o}_{h}"
    for h in ("1h", "1d", "1w")
    for m, o in (
        ("predicted_price", "predicted_price"), ("actual_price", "actual_price"),
        ("absolute_error", "error"), ("percent_error", "percent_error"),
    )
)
_VIEW_OUT = spec(
    "asset timestamp actual_price:6 "
    + " ".join(f"predicted_price_{h}:6 actual_price_{h}:6 error_{h}:6 percent_error_{h}:8" for h in ("1h", "1d", "1w"))
)


@query(
    "evaluation_timeseries_view",
    f"""with {_EVALS}, v0 as (select asset, target_timestamp as timestamp, {_VIEW} from newest group by 1, 2),
v as (select *, coalesce(actual_price_1h, actual_price_1d, actual_price_1w) as actual_price from v0) {emit_sql(_VIEW_OUT, 'v')}""",
)
def evaluation_timeseries_view(spark, sf):
    return emit(acc.timeseries_view(all_evaluations(spark, sf)), _VIEW_OUT)


@query(
    "latest_evaluation_per_horizon",
    f"""with {_EVALS} select asset, horizon, arg_max(target_timestamp, evaluation_timestamp) as target_timestamp,
  round(arg_max(percent_error, evaluation_timestamp) * 1.000000000001::double, 8) + 0.0 as percent_error from
  (select * from newest qualify row_number() over (partition by asset, horizon
     order by evaluation_timestamp desc, target_timestamp desc) = 1) group by 1, 2""",
)
def latest_evaluation_per_horizon(spark, sf):
    rows = acc.latest_evaluation(all_evaluations(spark, sf))
    return emit(rows, spec("asset horizon target_timestamp percent_error:8"))


_BOARD_OUT = spec(
    "asset horizon evaluations predicted_price:6 actual_price:6 absolute_error:6 percent_error:8 direction_correct "
    "confidence:6 quality stars age"
)
_LATE_TEXT = "2024-01-31 18:30:00"


@query(
    "evaluation_scoreboard",
    f"""with {_EVALS}, l as (select *, count(*) over (partition by asset, horizon) as evaluations from evals
  qualify row_number() over (partition by asset, horizon order by evaluation_timestamp desc, target_timestamp desc, prediction_id desc) = 1),
s as (select *, epoch(timestamp '{_LATE_TEXT}' - evaluation_timestamp) as sec from l),
b as (select *, case when percent_error <= 2 then 'excellent' when percent_error <= 5 then 'good'
  when percent_error <= 10 then 'fair' else 'poor' end as quality, repeat('*', cast(floor(confidence * 5) as integer)) as stars,
  case when sec < 60 then 'just now' when sec < 3600 then cast(floor(sec / 60) as integer) || 'm ago'
    when sec < 86400 then cast(floor(sec / 3600) as integer) || 'h ago'
    else cast(floor(sec / 86400) as integer) || 'd ago' end as age from s) {emit_sql(_BOARD_OUT, 'b')}""",
)
def evaluation_scoreboard(spark, sf):
    return emit(acc.scoreboard(all_evaluations(spark, sf), moment(_LATE_TEXT)), _BOARD_OUT)


_SUM_OUT = spec("asset evaluations mean_percent_error:8 direction_percent:5")


@query(
    "asset_accuracy_summary",
    f"""with {_EVALS}, s as (select asset, count(*) as evaluations, avg(percent_error) as mean_percent_error,
  avg(direction_correct) * 100 as direction_percent from evals
  where evaluation_timestamp >= {AS_OF_SQL} - interval 7 day group by 1) {emit_sql(_SUM_OUT, 's')}""",
)
def asset_accuracy_summary(spark, sf):
    return emit(acc.asset_summary(acc.since(all_evaluations(spark, sf), as_of(), 7)), _SUM_OUT)


_BACK_OUT = spec("asset horizon waiting oldest newest hours_waiting:3")


@query(
    "unevaluated_backlog",
    f"""with {_EVALS}, b as (select asset, horizon, count(*) as waiting, min(created_at) as oldest, max(created_at) as newest,
  (epoch_us(timestamp '{_LATE_TEXT}') - epoch_us(min(created_at))) / 3600000000.0 as hours_waiting from predictions
  where prediction_id not in (select prediction_id from evals) group by 1, 2) {emit_sql(_BACK_OUT, 'b')}""",
)
def unevaluated_backlog(spark, sf):
    rows = acc.backlog(naive_predictions(spark, sf), all_evaluations(spark, sf), moment(_LATE_TEXT))
    return emit(rows, _BACK_OUT)


@query(
    "prediction_counts",
    f"""with {_PREDS} select asset, horizon, count(*) as predictions, round(avg(confidence), 6) + 0.0 as mean_confidence
  from predictions where created_at >= timestamp '2024-01-30' - interval 24 hour group by grouping sets ((), (asset, horizon))""",
)
def prediction_counts(spark, sf):
    rows = acc.prediction_counts(naive_predictions(spark, sf), moment("2024-01-30 00:00:00"))
    return emit(rows, spec("asset horizon predictions mean_confidence:6"))


def _histogram_sql(measure, widths, beyond):
    case = "case " + " ".join(f"when hi - lo < {b} then {w}::double" for b, w in widths) + f" else {beyond}::double end"
    return f"""with {_EVALS}, r as (select asset, horizon, min({measure}) as lo, max({measure}) as hi from newest group by 1, 2),
w as (select *, {case} as bin_width from r), s as (select *, floor(lo / bin_width) * bin_width as start0 from w),
b as (select asset, horizon, bin_width, start0, least(floor(({measure} - start0) / bin_width),
  greatest(ceil((hi - start0) / bin_width - 1e-9) - 1, 0)) as bin from newest join s using (asset, horizon))
select asset, horizon, bin_width, cast(bin as bigint) as bin, round(start0 + bin * bin_width, 4) + 0.0 as bin_start,
  count(*) as frequency from b group by 1, 2, 3, 4, 5"""


_HIST_OUT = spec("asset horizon bin_width bin bin_start:4 frequency")


@query(
    "percent_error_histogram",
    _histogram_sql("percent_error", ((0.1, 0.01), (1, 0.1), (5, 0.25), (10, 0.5)), 1),
)
def percent_error_histogram(spark, sf):
    newest = staged(acc.newest_evaluations(all_evaluations(spark, sf)), "newest")
    return emit(acc.histogram(newest, "percent_error", ("asset", "horizon")), _HIST_OUT)


@query(
    "absolute_error_histogram",
    _histogram_sql("absolute_error", ((10, 1), (100, 5), (500, 25), (1000, 50)), 100),
)
def absolute_error_histogram(spark, sf):
    newest = staged(acc.newest_evaluations(all_evaluations(spark, sf)), "newest")
    return emit(acc.histogram(newest, "absolute_error", ("asset", "horizon")), _HIST_OUT)


_DIST_OUT = spec("asset horizon mean:4 std:4 n q25:4 q50:4 q75:4")


@query(
    "error_distribution",
    f"""with {_EVALS}, d as (select asset, horizon, avg(percent_error) as mean, stddev_samp(percent_error) as std, count(*) as n,
  quantile_cont(percent_error, 0.25) as q25, quantile_cont(percent_error, 0.5) as q50,
  quantile_cont(percent_error, 0.75) as q75 from newest group by 1, 2) {emit_sql(_DIST_OUT, 'd')}""",
)
def error_distribution(spark, sf):
    newest = staged(acc.newest_evaluations(all_evaluations(spark, sf)), "newest")
    return emit(acc.distribution(newest, "percent_error", ("asset", "horizon")), _DIST_OUT)


_ROLL_OUT = spec("asset horizon target_timestamp direction_correct rolling_accuracy:6 overall_accuracy:6")


@query(
    "rolling_direction_accuracy",
    f"""with {_EVALS}, r as (select asset, horizon, target_timestamp, direction_correct, avg(direction_correct) over (
  partition by asset, horizon order by target_timestamp rows between 4 preceding and current row) as rolling_accuracy,
  avg(direction_correct) over (partition by asset) as overall_accuracy from newest) {emit_sql(_ROLL_OUT, 'r')}""",
)
def rolling_direction_accuracy(spark, sf):
    return emit(acc.rolling_direction_accuracy(all_evaluations(spark, sf)), _ROLL_OUT)


@query(
    "accuracy_report_lines",
    f"""with {_EVALS}, m as (select asset, horizon, count(*) as n, avg(absolute_error) as mae, avg(percent_error) as mpe,
  avg(direction_correct) * 100 as dir, sqrt(avg(absolute_error * absolute_error)) as rmse, min(absolute_error) as lo,
  max(absolute_error) as hi from newest where horizon <> '1w' group by 1, 2),
h(horizon, position) as (values ('1h', 1), ('1d', 2), ('1w', 3)),
grid as (select distinct bars.asset, h.horizon, h.position from bars, h)
select asset, horizon, position, case when n > 0 then format(
  '{{}} {{}}: n={{}} MAE={{:.2f}} MPE={{:.2f}}% direction={{:.2f}}% RMSE={{:.2f}} range={{:.2f}}..{{:.2f}}',
  asset, horizon, n, mae, mpe, dir, rmse, lo, hi) else asset || ' ' || horizon || ': no data available' end as line
from grid left join m using (asset, horizon)""",
)
def accuracy_report_lines(spark, sf):
    done = all_evaluations(spark, sf).where("horizon <> '1w'")
    return acc.report(acc.accuracy_metrics(done), event_bars(spark, sf))


_PCT = spec("asset p05:4 p50:4 p95:4")


@query(
    "exact_percentiles_of_ticks",
    """select event_type as asset, round(quantile_cont(value, 0.05), 4) + 0.0 as p05,
  round(quantile_cont(value, 0.5), 4) + 0.0 as p50, round(quantile_cont(value, 0.95), 4) + 0.0 as p95 from events group by 1""",
)
def exact_percentiles_of_ticks(spark, sf):
    ticks = table(spark, sf, "events").select(F.col("event_type").alias("asset"), "value")
    p = exact_percentiles(ticks, ["asset"], "value", [0.05, 0.5, 0.95])
    return emit(
        p.select("asset", *[F.col("percentiles")[i].alias(n) for i, n in enumerate(("p05", "p50", "p95"))]), _PCT
    )


# -- versions, top rows, tails ------------------------------------------------------------------------------


@query(
    "upsert_by_key",
    f"""with {EVENT_BARS}, current as (select asset, datetime as target_timestamp, price as actual_price, 1 as version from bars
  where hour(datetime) % 2 = 0),
changes as (select asset, datetime as target_timestamp, price * 2 as actual_price, 2 as version from bars where hour(datetime) % 3 = 0)
select asset, target_timestamp, round(coalesce(c.actual_price, o.actual_price), 6) + 0.0 as actual_price
from current o full join changes c using (asset, target_timestamp)""",
)
def upsert_by_key(spark, sf):
    bars = event_bars(spark, sf).withColumnsRenamed({"datetime": "target_timestamp"})
    rows = lambda hours, factor, version: bars.where(F.hour("target_timestamp") % hours == 0).select(
        "asset", "target_timestamp", (F.col("price") * factor).alias("actual_price"), F.lit(version).alias("version")
    )
    merged = upsert(rows(2, 1, 1), rows(3, 2, 2), ["asset", "target_timestamp"], ["version"])
    return emit(merged, spec("asset target_timestamp actual_price:6"))


@query(
    "latest_prices",
    "select event_type as asset, arg_max(value, ts) as price, max(ts) as ts from events group by 1",
)
def latest_prices(spark, sf):
    ticks = table(spark, sf, "events").select(F.col("event_type").alias("asset"), F.col("value").alias("price"), "ts")
    return latest_price(ticks, "ts")


@query(
    "newest_hundred_predictions",
    f"with {_PREDS} select prediction_id, created_at from predictions order by created_at desc, prediction_id limit 100",
)
def newest_hundred(spark, sf):
    rows = top_rows(naive_predictions(spark, sf), 100, F.desc("created_at"), F.col("prediction_id"))
    return rows.select("prediction_id", "created_at")


@query(
    "last_days_of_each_series",
    f"""with {EVENT_BARS} select asset, datetime, price from bars
qualify row_number() over (partition by asset order by datetime desc) <= 7 * 24""",
)
def last_days(spark, sf):
    bars = staged(event_bars(spark, sf), "bars")
    return last_rows_by_time(bars, 7 * 24).select("asset", "datetime", "price")


@query(
    "lookback_days",
    f"with {EVENT_BARS} select asset, datetime, price from bars where datetime between {AS_OF_SQL} - interval 5 day and {AS_OF_SQL}",
)
def lookback_days(spark, sf):
    return lookback(event_bars(spark, sf), as_of(), 5).select("asset", "datetime", "price")


_SCORE = spec("asset datetime price:6 sma_7:6 sma_14:6 sma_30:6 sma_50:6 hour day_of_week is_weekend target_1h:6")


@query(
    "latest_scoring_rows",
    f"""with {EVENT_BARS}, f as (select *, {", ".join(f"{mean('price', k)} as sma_{k}" for k in (7, 14, 30, 50))},
  hour(datetime)::integer as hour, (isodow(datetime) - 1)::integer as day_of_week, (isodow(datetime) >= 6)::integer as is_weekend,
  lead(price) over (partition by asset order by rn) as target_1h from bars),
l as (select * from f qualify row_number() over (partition by asset order by datetime desc) = 1) {emit_sql(_SCORE, 'l')}""",
)
def latest_scoring_rows(spark, sf):
    s = fx.add_targets(fx.add_moving_averages(event_series(spark, sf, lead_rows=168)))
    return emit(last_row(calendar_features(s.rows())), _SCORE)


@query(
    "horizons_in_order",
    f"""with {_PREDS} select horizon, position from (select distinct horizon, {_RANK} as position from predictions)""",
)
def horizons_in_order(spark, sf):
    rows = naive_predictions(spark, sf).select("horizon").distinct()
    return rows.select("horizon", mt.horizon_rank().alias("position"))


@query(
    "display_rows",
    f"""with {_PREDS}, now as (select asset, arg_max(price, datetime) as current_price from bars group by 1),
l as (select * from predictions qualify row_number() over (partition by asset, horizon order by created_at desc) = 1)
select asset, horizon, {_RANK} as position, round(current_price, 6) + 0.0 as current_price, round(predicted_price, 6) + 0.0 as predicted_price,
  round((predicted_price - current_price) / nullif(current_price, 0) * 100, 4) + 0.0 as display_return,
  (predicted_price > current_price)::integer as direction, repeat('*', cast(floor(confidence * 5) as integer)) as stars
from l join now using (asset)""",
)
def display_rows(spark, sf):
    """The newest prediction of each series and horizon against the current price."""
    newest = latest_per_key(naive_predictions(spark, sf), ["asset", "horizon"], ["created_at"])
    now = latest_price(event_bars(spark, sf)).select("asset", F.col("price").alias("current_price"))
    change = div(F.col("predicted_price") - F.col("current_price"), "current_price") * 100
    return newest.join(now, "asset").select(
        "asset", "horizon", mt.horizon_rank().alias("position"), rounded("current_price", 6).alias("current_price"),
        rounded("predicted_price", 6).alias("predicted_price"), rounded(change, 4).alias("display_return"),
        (F.col("predicted_price") > F.col("current_price")).cast("int").alias("direction"),
        stars("confidence").alias("stars"),
    )


@query(
    "time_differences",
    """select event_id, date_trunc('hour', ts) as hour_start, epoch_us(ts) - epoch_us(date_trunc('hour', ts)) as micros_into_hour,
  ts + interval 168 hour as week_later, strftime(ts, '%Y-%m-%d %H:%M') as text, cast(epoch(date_trunc('second', ts)) as bigint) as unix
from events""",
)
def time_differences(spark, sf):
    start = F.date_trunc("hour", "ts").cast("timestamp_ntz")
    return table(spark, sf, "events").select(
        "event_id", start.alias("hour_start"), micros_between(start, "ts").alias("micros_into_hour"),
        shifted("ts", 168).alias("week_later"), F.date_format("ts", "yyyy-MM-dd HH:mm").alias("text"),
        seconds("ts").alias("unix"),
    )


@query(
    "quality_bands",
    f"""with {_EVALS} select case when percent_error <= 2 then 'excellent' when percent_error <= 5 then 'good'
  when percent_error <= 10 then 'fair' else 'poor' end as quality, count(*) as evaluations from evals group by 1""",
)
def quality_bands(spark, sf):
    return all_evaluations(spark, sf).groupBy(quality_band("percent_error").alias("quality")).agg(
        F.count(F.lit(1)).alias("evaluations")
    )


@query(
    "evaluation_ages",
    f"""with {_EVALS}, s as (select prediction_id, evaluation_timestamp, epoch(timestamp '{_LATE_TEXT}' - evaluation_timestamp) as sec from evals)
select prediction_id, evaluation_timestamp, case when sec < 60 then 'just now' when sec < 3600 then cast(floor(sec / 60) as integer) || 'm ago'
    when sec < 86400 then cast(floor(sec / 3600) as integer) || 'h ago'
    else cast(floor(sec / 86400) as integer) || 'd ago' end as age from s""",
)
def evaluation_ages(spark, sf):
    return all_evaluations(spark, sf).select(
        "prediction_id", "evaluation_timestamp", age_text(moment(_LATE_TEXT), F.col("evaluation_timestamp")).alias("age")
    )
