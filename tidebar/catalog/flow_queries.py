"""Whole flows: feature tables and rounds over stored tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidebar.catalog.accuracy_queries import (
    _AGE, _DUE, _ERRORS, _EVAL_OUT, _EVALS, _WANTED, _SLACK, AS_OF_SQL, as_of, naive_predictions, _PREDS,
)
from tidebar.catalog.base import EVENT_BARS, change, corr, emit, emit_sql, event_bars, last_known, mean, query, spec
from tidebar.catalog.joined_queries import PAIRS, _CLEAN_OUT, _SIGMA_CTE, market_prints, pair_table
from tidebar.catalog.learning_queries import (
    FEATURES, NEWEST_SQL, ONE, _FEATURE_SQL as FEATURE_SQL, _features as features_of, one_model_sql, predictions_sql,
)
from tidebar.catalog.store_queries import _store
from tidebar.operators.pairs import named_for_pair
from tidebar.operators.series import chunked
from tidebar.plans import cycle, features as fx, flow, model_store, registry
from tidebar.session import staged


def _bars(spark, sf):
    return staged(event_bars(spark, sf), "bars")


@query("prepared_features", f"with {_SIGMA_CTE} {emit_sql(_CLEAN_OUT, 's3')}")
def prepared_features(spark, sf):
    """All 174 features of every series, cleaned; a few of them are shown."""
    return emit(flow.prepare_features(_bars(spark, sf)), _CLEAN_OUT)


@query("prepared_features_with_market")
def prepared_features_with_market(spark, sf):
    """All 198 features, with market prints next to the bars; every column is shown."""
    return flow.prepare_features(_bars(spark, sf), market_prints(spark, sf), "ts").drop("_rn")


def _filled(n):
    first = (
        f"first_value({n} ignore nulls) over (partition by asset order by rn rows between current row and unbounded following)"
    )
    return f"coalesce({last_known(n)}, {first}, 0) as {n}"


_PAIR_OUT = spec("asset other_asset datetime price:6 other_price:6 corr_other_24h:6 price_other_ratio:6 momentum_24h:5 return_spread_other:5")
_PAIR_SQL = f"""with {_SIGMA_CTE}, pairs(asset, other_asset) as (values {", ".join(str(p) for p in PAIRS)}),
j as (select s3.*, pairs.other_asset, o.price as op from s3 join pairs using (asset)
  left join s3 o on o.asset = pairs.other_asset and o.datetime = s3.datetime),
l as (select *, {last_known('op')} as other_price from j),
x as (select *, {corr('price', 'other_price', 24)} as corr_other_24h,
  case when price is not null and other_price is not null then least(greatest(price / (other_price + 1e-3), 1e-6), 1e6) end as price_other_ratio,
  {change('price')} - {change('other_price')} as return_spread_other from l),
f as (select * replace ({", ".join(_filled(n) for n in ("price", "other_price", "corr_other_24h", "price_other_ratio", "momentum_24h", "return_spread_other"))})
  from (select * replace (case when abs(price_other_ratio) <= 1000 then price_other_ratio end as price_other_ratio) from x))
{emit_sql(_PAIR_OUT, 'f')}"""


@query("prepared_features_of_pairs", _PAIR_SQL)
def prepared_features_of_pairs(spark, sf):
    """All features of the listed pairs, cleaned, capped and filled; a few are shown."""
    return emit(flow.prepare_with_pairs(_bars(spark, sf), pair_table(spark)), _PAIR_OUT)


@query("prepared_features_of_one_named_pair")
def prepared_features_of_one_named_pair(spark, sf):
    """The same for one pair, every column, named after the two series."""
    rows = flow.prepare_with_pairs(_bars(spark, sf), pair_table(spark), reference_compat=True)
    return named_for_pair(rows.drop("_rn"), "click", "view")


@query("leakage_report")
def leakage_report(spark, sf):
    return flow.leakage_report(flow.raw_features(_bars(spark, sf)))


@query(
    "feature_list",
    f"with {EVENT_BARS} select count(distinct asset) as series, {len(registry.single_features(market=True))}::bigint as single, "
    f"{len(registry.all_features(market=True, with_future=True))}::bigint as with_other from bars",
)
def feature_list(spark, sf):
    series = event_bars(spark, sf).agg(F.count_distinct("asset").alias("series"))
    return series.select(
        "series",
        F.lit(len(registry.single_features(market=True))).cast("long").alias("single"),
        F.lit(len(registry.all_features(market=True, with_future=True))).cast("long").alias("with_other"),
    )


_ROUND_SQL = f"""with {_EVALS}, due as (select * from predictions where abs({_AGE} - {_WANTED}) <= {_SLACK}
  qualify row_number() over (partition by asset, horizon order by abs({_AGE} - {_WANTED}), created_at desc) = 1),
seen as (select * from bars where datetime <= {AS_OF_SQL}),
r as (select d.*, b.price as actual_price, s.price as start_price, d.created_at as prediction_timestamp, {AS_OF_SQL} as evaluation_timestamp
  from due d join seen b on b.asset = d.asset and b.datetime = d.target_timestamp
  left join seen s on s.asset = d.asset and s.datetime = d.created_at),
r1 as (select *, {_ERRORS} from r),
done as (select *, (direction_predicted = direction_actual)::integer as direction_correct from r1) {emit_sql(_EVAL_OUT, 'done')}"""


@query("stored_evaluation_round", _ROUND_SQL)
def stored_evaluation_round(spark, sf):
    """Predictions and bars in the store; what is due is evaluated and kept."""
    store = _store(spark)
    store.append("bars", event_bars(spark, sf))
    store.append("predictions", naive_predictions(spark, sf))
    cycle.evaluation_round(store, as_of())
    return emit(store.read("evaluations"), _EVAL_OUT)


_TRACK_OUT = spec(
    "asset timestamp actual_price:6 predicted_price_1h:6 predicted_price_1d predicted_price_1w error_1h:6 error_1d error_1w "
    "percent_error_1h:6 percent_error_1d percent_error_1w"
)


@query(
    "stored_tracking_round",
    f"""with {_PREDS}, rounds as (select {AS_OF_SQL} - hours * interval 1 hour as t, hours from (values (1), (0)) h(hours)),
prices as (select t, hours, asset, arg_max(price, datetime) as actual_price from bars, rounds where datetime <= t group by all),
newest as (select t, asset, predicted_price from predictions, rounds
  where horizon = '1h' and created_at between t - interval 240 minute and t - interval 50 minute
  qualify row_number() over (partition by t, asset order by created_at desc, prediction_id desc) = 1),
tracked as (select p.*, n.predicted_price, lag(n.predicted_price) over (partition by p.asset order by p.t) as earlier
  from prices p left join newest n on n.t = p.t and n.asset = p.asset),
made as (select asset, t as timestamp, actual_price, predicted_price as predicted_price_1h, null::double as predicted_price_1d,
  null::double as predicted_price_1w, case when predicted_price is not null then abs(earlier - actual_price) end as error_1h,
  null::double as error_1d, null::double as error_1w, null::double as percent_error_1d, null::double as percent_error_1w from tracked),
done as (select *, error_1h / actual_price * 100 as percent_error_1h from made) {emit_sql(_TRACK_OUT, 'done')}""",
)
def stored_tracking_round(spark, sf):
    """Two hourly rounds of current prices into the timeseries table, each run twice. The series is
    younger than a day, so its longer horizons do not count yet."""
    store = _store(spark)
    store.append("bars", event_bars(spark, sf))
    store.append("predictions", naive_predictions(spark, sf))
    for hours in (1, 1, 0, 0):
        cycle.tracking_round(store, as_of() - F.expr(f"INTERVAL '{hours}' HOUR"))
    return emit(store.read("timeseries"), _TRACK_OUT)


def _known_features(spark, sf):
    bars = staged(event_bars(spark, sf).where(F.col("datetime") <= as_of()), "known-bars")
    return staged(features_of(fx.pad_prices(chunked(bars, lead_rows=168))), "known-features")


_KNOWN = f"with {EVENT_BARS.replace('bars as (', 'every_bar as (', 1)}, bars as (select * from every_bar where datetime <= {AS_OF_SQL}), {FEATURE_SQL}"
_STORED_OUT = spec("prediction_id asset horizon predicted_price:4 confidence:6 target_timestamp created_at")


@query(
    "stored_prediction_round",
    f"""{_KNOWN}, {one_model_sql()}, {predictions_sql(where=NEWEST_SQL)},
kept as (select asset || '|' || horizon || '|' || strftime(created_at, '%Y-%m-%d %H:%M:%S.%f') as prediction_id, * from made) {emit_sql(_STORED_OUT, 'kept')}""",
)
def stored_prediction_round(spark, sf):
    """Train what is due on the rows known by now, predict all series, append."""
    store, rows = _store(spark), _known_features(spark, sf)
    models = model_store.train_or_load(store, rows, FEATURES, as_of(), learner=ONE)
    cycle.prediction_round(store, models, as_of(), features=rows)
    return emit(store.read("predictions"), _STORED_OUT)


@query(
    "whole_round",
    f"""{_KNOWN}, {one_model_sql()}, n as (select count(*) as models from best), b as (select count(*) as priced from (select distinct asset from bars))
select 'models' as what, models::bigint as rows from n union all select 'predictions', models::bigint from n
union all select 'timeseries', priced::bigint from b union all select 'report', (3 * priced)::bigint from b""",
)
def whole_round(spark, sf):
    """One call: train or load, predict, evaluate, track, report; run twice, it adds nothing."""
    store, rows = _store(spark), _known_features(spark, sf)
    store.append("bars", event_bars(spark, sf))
    cycle.run_round(store, as_of(), rows, FEATURES, learner=ONE)
    report = cycle.run_round(store, as_of(), rows, FEATURES, learner=ONE)
    parts = [store.read("models"), store.read("predictions").select("prediction_id").distinct(), store.read("timeseries"), report]
    out = None
    for name, part in zip(("models", "predictions", "timeseries", "report"), parts):
        one = part.agg(F.count(F.lit(1)).alias("rows")).select(F.lit(name).alias("what"), "rows")
        out = one if out is None else out.unionByName(one)
    return out


@query(
    "accuracy_round_report",
    f"with {_PREDS} select asset, horizon, position from (select distinct asset from bars), (values ('1h', 1), ('1d', 2), ('1w', 3)) h(horizon, position)",
)
def accuracy_round_report(spark, sf):
    """One report line per series and horizon after a stored round."""
    store = _store(spark)
    store.append("bars", event_bars(spark, sf))
    store.append("predictions", naive_predictions(spark, sf))
    cycle.evaluation_round(store, as_of())
    return cycle.accuracy_round(store, as_of()).select("asset", "horizon", "position")
