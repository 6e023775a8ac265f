"""Learning and backtests."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidebar import settings
from tidebar.catalog.base import (
    DAILY_BARS, EVENT_BARS, ORACLES, change, daily_series, emit, emit_sql, event_series, flag_sql, lead, mean, query, spec,
)
from tidebar.functions.clock import moment
from tidebar.operators.versions import latest_per_key, tail_rows
from tidebar.plans import backtest as bt, features as fx, learning as ml, linear, model_store as store_models
from tidebar.session import scratch_path, staged
from tidebar.sources.tables import Store

FEATURES = [
    "price", "volume", "sma_7", "price_sma_7_ratio", "sma_30", "price_sma_30_ratio", "momentum_24h", "velocity_3h"
]
HORIZONS = settings.HORIZONS


def _features(series):
    s = fx.add_momentum(fx.add_moving_averages(series))
    s = fx.add_targets(fx.add_price_changes(s))
    return s.rows(keep_position=True).drop("_price_pad", "_volume_pad", "_market_cap_pad", "high", "low")


def event_features(spark, sf):
    return staged(_features(event_series(spark, sf, lead_rows=168)), "event-features")


def daily_features(spark, sf):
    return staged(_features(daily_series(spark, sf, lead_rows=168)), "daily-features")


def _ret(n):
    return f"({lead('price', n)} / nullif(price, 0) - 1) * 100"


_FEATURE_SQL = f"""feats as (select *, {mean('price', 7)} as sma_7, price / nullif({mean('price', 7)}, 0) as price_sma_7_ratio,
  {mean('price', 30)} as sma_30, price / nullif({mean('price', 30)}, 0) as price_sma_30_ratio,
  {change('price', 24)} * 100 as momentum_24h, price - lag(price, 3) over (partition by asset order by rn) as velocity_3h,
  {change('price', 24)} as price_change_24h,
  {", ".join(f"{lead('price', n)} as target_{h}, {_ret(n)} as target_return_{h}, {flag_sql(_ret(n) + ' > 0')} as target_direction_{h}" for h, n in HORIZONS.items())}
  from bars)"""
_EV = f"with {EVENT_BARS}, {_FEATURE_SQL}"
_FILLED = f"""known as (select * replace ({", ".join(f"coalesce({n}, 0) as {n}" for n in FEATURES)}) from feats
  where target_return_1d is not null)"""

# -- scores, scaling, folds -------------------------------------------------------------------------

_SCORE_SQL = " union all ".join(
    f"select asset, '{n}' as feature, corr({n}, target_return_1d) as r, count(*) as n from known group by asset"
    for n in FEATURES
)
_SCORES = f"""{_EV}, {_FILLED}, rs as ({_SCORE_SQL}),
scores as (select asset, feature, r * r / (1 - r * r) * (n - 2) as score from rs)"""


def _scores(spark, sf):
    rows = ml.importance_rows(event_features(spark, sf), FEATURES, "target_return_1d")
    return ml.feature_scores(rows, FEATURES, "target_return_1d")


@query("feature_scores", f"{_SCORES} {emit_sql(spec('asset feature score:5'), 'scores')}")
def feature_scores(spark, sf):
    return emit(_scores(spark, sf), spec("asset feature score:5"))


@query(
    "best_features",
    f"""{_SCORES}, placed as (select *, row_number() over (partition by asset order by score desc, feature) as place from scores)
select asset, feature, cast(place as integer) as place from placed where place <= 3""",
)
def best_features(spark, sf):
    return ml.best_features(_scores(spark, sf), 3).select("asset", "feature", "place")


_STD_OUT = spec("asset datetime price:6 volume:6 sma_7:6 momentum_24h:6")
_STD = ["price", "volume", "sma_7", "momentum_24h"]


@query(
    "standardized_features",
    f"""{_EV}, {_FILLED}, z as (select * replace ({", ".join(
        f"({n} - avg({n}) over p) / (case when stddev_pop({n}) over p = 0 then 1 else stddev_pop({n}) over p end) as {n}" for n in _STD)})
  from known window p as (partition by asset)) {emit_sql(_STD_OUT, 'z')}""",
)
def standardized_features(spark, sf):
    rows = ml.importance_rows(event_features(spark, sf), FEATURES, "target_return_1d")
    return emit(ml.standardized(rows, _STD), _STD_OUT)


_IMP_OUT = spec("asset datetime " + " ".join(f"{n}:6" for n in FEATURES) + " target_return_1d:6")


@query("importance_rows", f"{_EV}, {_FILLED} {emit_sql(_IMP_OUT, 'known')}")
def importance_rows(spark, sf):
    return emit(ml.importance_rows(event_features(spark, sf), FEATURES, "target_return_1d"), _IMP_OUT)


@query(
    "expanding_folds",
    f"""with {EVENT_BARS}, s as (select asset, count(*) as n, least(5, greatest(2, count(*) // 10)) as folds from bars group by 1),
f as (select asset, n, folds, n // (folds + 1) as size, unnest(range(1, folds + 1)) as fold from s)
select asset, cast(fold as integer) as fold, cast(n - (folds - fold + 1) * size as bigint) as test_start,
  cast(n - (folds - fold + 1) * size + size as bigint) as test_end from f""",
)
def expanding_folds(spark, sf):
    return ml.expanding_folds(event_features(spark, sf))


# -- classes and fit measures ---------------------------------------------------------------------------

_BAL_OUT = spec("asset ups downs minority_share:6 majority_class positive_weight:6 severe_imbalance single_class")


@query(
    "class_balance",
    f"""{_EV}, c as (select asset, cast(sum(rare) as bigint) as ups, cast(sum(1 - rare) as bigint) as downs
  from (select asset, {flag_sql('target_return_1d > 400')} as rare from feats) group by 1),
b as (select asset, ups, downs, least(ups, downs) / (ups + downs) as minority_share, (ups > downs)::integer as majority_class,
  case when least(ups, downs) > 0 and least(ups, downs) / (ups + downs) < 0.2 then greatest(ups, downs) / least(ups, downs) else 1.0 end as positive_weight,
  least(ups, downs) / (ups + downs) < 0.05 as severe_imbalance, least(ups, downs) = 0 as single_class from c) {emit_sql(_BAL_OUT, 'b')}""",
)
def class_balance(spark, sf):
    rows = event_features(spark, sf).withColumn(
        "rare", F.coalesce(F.col("target_return_1d") > 400, F.lit(False)).cast("int")
    )
    return emit(ml.class_balance(rows, "rare"), _BAL_OUT)


@query(
    "majority_class_model",
    f"""{_EV}, c as (select asset, sum(target_direction_1d) as ups, sum(1 - target_direction_1d) as downs from feats group by 1)
select asset, (ups > downs)::integer as prediction, round(greatest(ups, downs) / (ups + downs) * 1.000000000001::double, 8) + 0.0 as accuracy from c""",
)
def majority_class_model(spark, sf):
    return emit(ml.majority_model(event_features(spark, sf), "target_direction_1d"), spec("asset prediction accuracy:8"))


_FIT_OUT = spec("asset mse:3 mae:4 accuracy:6")


@query(
    "fit_measures",
    f"""{_EV}, m as (select asset, avg((p - y) * (p - y)) as mse, avg(abs(p - y)) as mae,
  avg(((p > 0) = (y > 0))::integer) as accuracy from (select asset, momentum_24h as p, target_return_1d as y from feats)
  where p is not null and y is not null group by 1) {emit_sql(_FIT_OUT, 'm')}""",
)
def fit_measures(spark, sf):
    """How well yesterday's return stands for tomorrow's."""
    return emit(ml.fit_measures(event_features(spark, sf), "momentum_24h", "target_return_1d"), _FIT_OUT)


# -- models ---------------------------------------------------------------------------------------------------

SMALL = ml.Learner(trees=3, depth=2, top=5)
# One feature of all candidates, the best of each series and horizon: then SQL can fit the same model.
ONE = ml.Learner(top=1)


def one_model_sql(source="feats", first="", horizons=tuple(HORIZONS)):
    """CTEs ending with best(asset, horizon, feature, slope, cut, w, odds, majority, n, ups, error)
    and xs: every row's value of every candidate feature. ``first``: a condition on the rows of a fit."""
    hz = ", ".join
    return f"""hz as (select asset, datetime, rn, price, {hz(FEATURES[1:])}, unnest([{hz(f"'{h}'" for h in horizons)}]) as horizon,
  unnest([{hz(f"target_return_{h}" for h in horizons)}]) as y, unnest([{hz(f"target_direction_{h}" for h in horizons)}]) as up from {source}),
xs as (select asset, datetime, rn, price, horizon, y, up, unnest([{hz(f"'{n}'" for n in FEATURES)}]) as feature,
  unnest([{hz(f"coalesce({n}, 0)" for n in FEATURES)}]) as x from hz),
fit0 as (select asset, horizon, feature, count(*) as n, sum(up) as ups, regr_slope(y, x) as slope, regr_intercept(y, x) as cut, corr(x, y) as r,
  avg(x) filter (where up = 1) as m1, avg(x) filter (where up = 0) as m0, var_pop(x) as v, regr_sxx(y, x) as sxx, regr_syy(y, x) as syy, regr_sxy(y, x) as sxy
  from xs where y is not null {first} group by all having count(*) >= 10),
fit1 as (select *, (m1 - m0) / (v - (ups / n) * (1 - ups / n) * (m1 - m0) * (m1 - m0)) as w0 from fit0
  qualify row_number() over (partition by asset, horizon order by coalesce(r * r, 0) desc, feature) = 1),
best as (select asset, horizon, feature, slope, cut, n, ups, (syy - slope * sxy) / n as error, w0 as w,
  case when ups = 0 then 0.0 when ups = n then 1.0 end as majority,
  ln(case when least(ups, n - ups) / n < 0.2 then greatest(ups, n - ups) / least(ups, n - ups) else 1.0 end * ups / nullif(n - ups, 0)) - w0 * (m1 + m0) / 2 as odds from fit1)"""


def predictions_sql(rows="xs", where="true"):
    """CTE made: what the best models say of the rows."""
    return f"""made0 as (select x.asset, x.horizon, x.datetime as created_at, x.datetime + case x.horizon {" ".join(f"when '{h}' then interval {n} hour" for h, n in HORIZONS.items())} end as target_timestamp,
  x.price as current_price, cut + slope * x.x as predicted_return, coalesce(majority, 1 / (1 + exp(-(odds + w * x.x)))) as direction_confidence
  from {rows} x join best b on b.asset = x.asset and b.horizon = x.horizon and b.feature = x.feature where {where}),
made as (select *, current_price * (1 + predicted_return / 100) as predicted_price, (direction_confidence > 0.5)::integer as predicted_direction,
  greatest(direction_confidence, 1 - direction_confidence) as confidence from made0)"""


PRED_OUT = spec("asset horizon created_at target_timestamp current_price:5 predicted_price:4 predicted_return:5 predicted_direction direction_confidence:6 confidence:6")
NEWEST_SQL = "x.rn = (select max(rn) from feats f where f.asset = x.asset)"


@query("trained_model_predictions", f"{_EV}, {one_model_sql(horizons=('1h',))}, {predictions_sql()} {emit_sql(PRED_OUT, 'made')}")
def trained_model_predictions(spark, sf):
    """The next hour of every series: one pass fits all, one join forecasts all rows."""
    rows = event_features(spark, sf)
    models, _ = linear.train(rows, FEATURES, ["1h"], ONE)
    return emit(linear.predict(models, rows, FEATURES, ["1h"], only_last=False), PRED_OUT)


@query("models_of_all_horizons", f"{_EV}, {one_model_sql()}, {predictions_sql(where=NEWEST_SQL)} {emit_sql(PRED_OUT, 'made')}")
def models_of_all_horizons(spark, sf):
    """A model per series and horizon from the same pass, and their newest forecasts."""
    rows = event_features(spark, sf)
    return emit(linear.predict(linear.train(rows, FEATURES, learner=ONE)[0], rows, FEATURES), PRED_OUT)


@query("full_linear_predictions")
def full_linear_predictions(spark, sf):
    """All candidate features in every model (against numpy in the tests)."""
    rows = event_features(spark, sf)
    return emit(linear.predict(linear.train(rows, FEATURES)[0], rows, FEATURES, only_last=False), PRED_OUT)


AT = "2024-01-31 00:00:00"


@query("saved_model_predictions", f"{_EV}, {one_model_sql()}, {predictions_sql(where=NEWEST_SQL)} {emit_sql(PRED_OUT, 'made')}")
def saved_model_predictions(spark, sf):
    """Train, register, promote, find in the registry, predict from the stored weights."""
    rows, store = event_features(spark, sf), Store(spark, scratch_path(spark, "model-store")).ensure()
    store_models.register(store, *linear.train(rows, FEATURES, learner=ONE), FEATURES, moment(AT))
    store_models.promote(store, moment(AT))
    return emit(store_models.predict(store_models.newest(store, store_models.PRODUCTION), rows), PRED_OUT)


_CV_OUT = spec("asset horizon fold n error:3")


@query(
    "cross_validated_errors",
    f"""{_EV}, {one_model_sql()}, pts as (select x.asset, x.horizon, x.y, x.x, b.n as total,
  row_number() over (partition by x.asset, x.horizon order by x.rn) - 1 as place
  from xs x join best b on b.asset = x.asset and b.horizon = x.horizon and b.feature = x.feature where x.y is not null),
fo as (select asset, horizon, n as total, least(5, greatest(2, n // 10)) as folds from best),
fk as (select asset, horizon, total // (folds + 1) as size, total - (folds - fold + 1) * (total // (folds + 1)) as first, fold
  from (select *, unnest(range(1, folds + 1)) as fold from fo)),
tr as (select k.asset, k.horizon, k.fold, k.first, k.size, count(*) as n, regr_slope(y, x) as slope, regr_intercept(y, x) as cut
  from fk k join pts p on p.asset = k.asset and p.horizon = k.horizon and p.place < k.first group by all),
te as (select t.asset, t.horizon, t.fold::integer as fold, t.n, avg((y - cut - slope * x) * (y - cut - slope * x)) as error
  from tr t join pts p on p.asset = t.asset and p.horizon = t.horizon and p.place >= t.first and p.place < t.first + t.size group by all)
{emit_sql(_CV_OUT, 'te')}""",
)
def cross_validated_errors(spark, sf):
    """Squared error of the return model on each fold of an expanding split, all series,
    horizons and folds from one pass."""
    models, _ = linear.train(event_features(spark, sf), FEATURES, learner=ONE)
    return emit(models.where("kind = 'return'"), _CV_OUT)


_RECORD_OUT = spec("asset horizon training_samples features_used folds train_mse:3 train_mae:4 train_accuracy:6 minority_share:6 cv_mse_mean:3 cv_mse_std:3")
_CV_SQL = ORACLES["cross_validated_errors"].rpartition("\nselect")[0]


@query(
    "training_records",
    f"""{_CV_SQL}, {predictions_sql(where="x.y is not null")}, fits as (select m.asset, m.horizon, avg(abs(m.predicted_return - x.y)) as train_mae,
  avg((m.predicted_direction = x.up)::integer) as train_accuracy from made m join hz x on x.asset = m.asset and x.horizon = m.horizon and x.datetime = m.created_at group by 1, 2),
cv as (select asset, horizon, avg(error) as cv_mse_mean, stddev_pop(error) as cv_mse_std, count(*) as folds from te group by 1, 2),
rec as (select b.asset, b.horizon, b.n as training_samples, 1 as features_used, folds, b.error as train_mse, train_mae, train_accuracy,
  least(b.ups, b.n - b.ups) / b.n as minority_share, cv_mse_mean, cv_mse_std
  from best b join fits using (asset, horizon) join cv using (asset, horizon)) {emit_sql(_RECORD_OUT, 'rec')}""",
)
def training_records(spark, sf):
    """Errors on the training rows, and mean and deviation over the folds."""
    return emit(linear.train(event_features(spark, sf), FEATURES, learner=ONE)[1], _RECORD_OUT)


def assets_named(rows, *names):
    return rows.where(F.col("asset").isin(*names))


@query("trees_of_named_series")
def trees_of_named_series(spark, sf):
    """Boosted trees for an explicit list of series, forecasts for all their rows."""
    rows = assets_named(event_features(spark, sf), "click", "view")
    models, errors = ml.train_all(rows, ["click", "view"], ["1h"], SMALL)
    if errors:
        raise RuntimeError(str(errors))
    parts = [ml.predict(m, rows, only_last=False) for m in models.values()]
    return parts[0].unionByName(parts[1])


_LOADED = "asset horizon version state training_samples"


@query(
    "train_or_load_models",
    f"""{_EV}, {one_model_sql()}, v(version, state, keep) as (values (1, 'production', '1d'), (1, 'candidate', ''), (2, 'candidate', ''))
select b.asset, b.horizon, v.version::bigint as version, v.state, b.n as training_samples from best b, v
where v.keep = '' and not (b.horizon = '1d' and v.version = 1) or v.keep = b.horizon""",
)
def train_or_load_models(spark, sf):
    """Daily models are in production; a first call trains the other horizons, a second one
    nothing, a forced one everything again."""
    rows, store = event_features(spark, sf), Store(spark, scratch_path(spark, "model-store")).ensure()
    store_models.register(store, *linear.train(rows, FEATURES, ["1d"], ONE), FEATURES, moment(AT), store_models.PRODUCTION)
    for hours, force in ((0, False), (1, False), (2, True)):
        at = moment(AT) + F.expr(f"INTERVAL '{hours}' HOUR")
        store_models.train_or_load(store, rows, FEATURES, at, learner=ONE, force=force)
    return store.read("models").select(*_LOADED.split())


@query(
    "models_due_for_training",
    f"""with {EVENT_BARS}, h(horizon) as (values ('1h'), ('1d'), ('1w')), last as (select asset, max(datetime) as trained_at from bars group by 1)
select asset, horizon from last, h where not (horizon = '1h' and trained_at > timestamp '2024-01-31 01:00:00' - interval 24 hour
  or horizon = '1d' and trained_at - interval 30 hour > timestamp '2024-01-31 01:00:00' - interval 24 hour)""",
)
def models_due_for_training(spark, sf):
    """Models fitted on the newest bars: hourly ones just now, daily ones 30 hours ago,
    weekly ones never."""
    last = event_features(spark, sf).groupBy("asset").agg(F.max("datetime").alias("trained_at"))
    registry = last.withColumn("horizon", F.lit("1h")).unionByName(
        last.select("asset", (F.col("trained_at") - F.expr("INTERVAL '30' HOUR")).alias("trained_at"), F.lit("1d").alias("horizon"))
    )
    wanted = last.select("asset", F.explode(F.array(*[F.lit(h) for h in HORIZONS])).alias("horizon"))
    return ml.due_for_training(wanted, registry, moment("2024-01-31 01:00:00"))


# -- backtests ----------------------------------------------------------------------------------------------------

_DAILY = f"with {DAILY_BARS}, {_FEATURE_SQL}, lens as (select asset, count(*) as n from bars group by 1)"


def _splits_sql(days, step, future=8):
    return f"""select asset, train_end - {days * 24} as train_start, train_end, train_end as test_start, n
  from (select asset, n, unnest(range({days * 24}, n - {future * 24}, {step * 24})) as train_end from lens)"""


_SPLIT_OUT = "asset, cast(train_start as bigint) as train_start, cast(train_end as bigint) as train_end, cast(test_start as bigint) as test_start"


@query("backtest_splits", f"{_DAILY}, s as ({_splits_sql(60, 7)}) select {_SPLIT_OUT} from s")
def backtest_splits(spark, sf):
    return bt.time_splits(bt.sizes(daily_features(spark, sf)), 60, 7)


_WINDOWS = " union all ".join(
    f"select '{name}' as window_name, {place} as window_place, {days} as train_days, * from ({_splits_sql(days, 1)})"
    for place, (name, days) in enumerate(settings.TRAINING_WINDOWS.items())
)
_RUNS = 20
_WINDOW_SPLITS = f"""{_DAILY}, ws0 as ({_WINDOWS}),
ws1 as (select *, row_number() over (partition by window_name, asset order by train_end) - 1 as place,
  count(*) over (partition by window_name, asset) as total from ws0),
ws as (select * from ws1 where place % greatest(total // {_RUNS}, 1) = 0 and place // greatest(total // {_RUNS}, 1) < {_RUNS})"""


@query("window_experiment_splits", f"{_WINDOW_SPLITS} select window_name, window_place, train_days, {_SPLIT_OUT} from ws")
def window_experiment_splits(spark, sf):
    return bt.window_splits(bt.sizes(daily_features(spark, sf)), runs=_RUNS)


_X = "coalesce(f.price_change_24h, 0)"


def _records_sql(splits):
    """One-feature regression per split and horizon, straight from the rows."""
    per = " union all ".join(
        f"""select s.window_name, s.window_place, s.train_days, s.asset, s.train_start, s.train_end, s.test_start, '{h}' as horizon,
  regr_slope(f.target_return_{h}, {_X}) as slope, regr_intercept(f.target_return_{h}, {_X}) as cut,
  avg((f.target_return_{h} > 0)::integer) as up, count(*) as training_samples, max(f.price) - min(f.price) as moved,
  count(distinct f.target_{h}) as different, s.test_start + {n} as actual_rn
  from {splits} s join feats f on f.asset = s.asset and f.rn >= s.train_start and f.rn < s.train_end group by all"""
        for h, n in HORIZONS.items()
    )
    return f"""fits as ({per}),
recs0 as (select fits.*, l.price as current_price, l.price * (1 + (cut + slope * coalesce(l.price_change_24h, 0)) / 100) as predicted_price,
  greatest(up, 1 - up) as confidence, a.price as actual_price, b.datetime as prediction_time
  from fits join feats l on l.asset = fits.asset and l.rn = fits.train_end - 1
  join feats a on a.asset = fits.asset and a.rn = fits.actual_rn join feats b on b.asset = fits.asset and b.rn = fits.test_start
  where training_samples >= 50 and moved > 0 and different >= 2),
recs as (select *, abs(predicted_price - actual_price) as dollar_error,
  abs(predicted_price - actual_price) / nullif(actual_price, 0) * 100 as percent_error,
  ((predicted_price > current_price) = (actual_price > current_price))::integer as direction_correct from recs0
  where predicted_price is not null)"""


_ONE_WINDOW = f"one as (select 'all' as window_name, 0 as window_place, 60 as train_days, * from ({_splits_sql(60, 7)}))"
_REC_OUT = spec(
    "asset train_start train_end test_start horizon current_price:5 predicted_price:5 confidence:6 training_samples "
    "actual_price:5 prediction_time dollar_error:5 percent_error:5 direction_correct"
)


def _one_window(spark, sf):
    rows = daily_features(spark, sf)
    splits = bt.time_splits(bt.sizes(rows), 60, 7).withColumn("train_days", F.lit(60))
    return bt.evaluate_splits(rows, splits, "price_change_24h")


@query("backtest_records", f"{_DAILY}, {_ONE_WINDOW}, {_records_sql('one')} {emit_sql(_REC_OUT, 'recs')}")
def backtest_records(spark, sf):
    return emit(_one_window(spark, sf), _REC_OUT)


_SUFF = ", ".join(
    f"(count(*) >= 50 and max(f.price) > min(f.price) and count(distinct f.target_{h}) >= 2) as enough_{h}" for h in HORIZONS
)


@query(
    "split_sufficiency",
    f"""{_DAILY}, {_ONE_WINDOW} select s.asset, cast(s.train_end as bigint) as train_end, count(*) as rows, {_SUFF}
from one s join feats f on f.asset = s.asset and f.rn >= s.train_start and f.rn < s.train_end group by s.asset, s.train_end""",
)
def split_sufficiency(spark, sf):
    rows = daily_features(spark, sf)
    splits = bt.time_splits(bt.sizes(rows), 60, 7).withColumn("train_days", F.lit(60))
    stats = bt.split_statistics(rows, splits, "price_change_24h")
    return stats.select("asset", "train_end", "rows", *[bt.sufficient(h).alias(f"enough_{h}") for h in HORIZONS])


_STATS_OUT = spec(
    "asset horizon total_predictions avg_dollar_error:5 median_dollar_error:5 avg_percent_error:5 "
    "median_percent_error:5 direction_accuracy:6 avg_confidence:6 max_error:5 min_error:5"
)


@query(
    "backtest_statistics",
    f"""{_DAILY}, {_ONE_WINDOW}, {_records_sql('one')}, st as (select asset, horizon, count(*) as total_predictions,
  avg(dollar_error) as avg_dollar_error, median(dollar_error) as median_dollar_error, avg(percent_error) as avg_percent_error,
  median(percent_error) as median_percent_error, avg(direction_correct) as direction_accuracy, avg(confidence) as avg_confidence,
  max(percent_error) as max_error, min(percent_error) as min_error from recs group by 1, 2) {emit_sql(_STATS_OUT, 'st')}""",
)
def backtest_statistics(spark, sf):
    return emit(bt.backtest_statistics(_one_window(spark, sf)), _STATS_OUT)


def _window_records(spark, sf):
    rows = daily_features(spark, sf)
    return bt.evaluate_splits(rows, bt.window_splits(bt.sizes(rows), runs=_RUNS), "price_change_24h")


_CUMS = ", ".join(
    f"""sum(case when target_return_{h} is not null then 1 else 0 end) over c as n_{h},
  sum(case when target_return_{h} is not null then x else 0 end) over c as x_{h}, sum(coalesce(target_return_{h}, 0)) over c as y_{h},
  sum(case when target_return_{h} is not null then x * x else 0 end) over c as xx_{h},
  sum(coalesce(x * target_return_{h}, 0)) over c as xy_{h},
  sum(case when target_return_{h} > 0 then 1 else 0 end) over c as up_{h}"""
    for h in HORIZONS
)


def _sliced(name, h):
    return f"(e.{name}_{h} - coalesce(b.{name}_{h}, 0)) as {name}"


_SLICES = " union all ".join(
    f"""select s.* exclude (n), '{h}' as horizon, e.price as current_price, e.x as last_x, s.test_start + {n} as actual_rn,
  {", ".join(_sliced(v, h) for v in ("n", "x", "y", "xx", "xy", "up"))}
  from ws s join cums e on e.asset = s.asset and e.rn = s.train_end - 1
  left join cums b on b.asset = s.asset and b.rn = s.train_start - 1"""
    for h, n in HORIZONS.items()
)
# Range joins of all these splits would be large, so the twin takes differences of running sums.
_WSTATS = f"""{_WINDOW_SPLITS},
narrow as (select asset, rn, price, coalesce(price_change_24h, 0) as x, {", ".join(f"target_return_{h}" for h in HORIZONS)} from feats),
cums as (select asset, rn, price, x, {_CUMS} from narrow window c as (partition by asset order by rn)),
slices as ({_SLICES}),
fits as (select *, (n * xy - x * y) / (n * xx - x * x) as slope from slices),
recs as (select f.window_name, f.window_place, f.train_days, f.asset, f.horizon, current_price, a.price as actual_price,
  current_price * (1 + ((y - slope * x) / n + slope * last_x) / 100) as predicted_price, greatest(up / n, 1 - up / n) as confidence
  from fits f join (select asset, rn, price from narrow) a on a.asset = f.asset and a.rn = f.actual_rn),
st as (select window_name, window_place, train_days, asset, horizon, count(*) as total_predictions,
  avg(abs(predicted_price - actual_price)) as avg_dollar_error,
  avg(abs(predicted_price - actual_price) / actual_price * 100) as avg_percent_error,
  avg(((predicted_price > current_price) = (actual_price > current_price))::integer) as direction_accuracy,
  avg(confidence) as avg_confidence,
  stddev_pop(abs(predicted_price - actual_price) / actual_price * 100) as std_percent_error,
  median(abs(predicted_price - actual_price) / actual_price * 100) as median_percent_error from recs group by 1, 2, 3, 4, 5)"""
_WSTATS_OUT = spec(
    "window_name window_place train_days asset horizon total_predictions avg_dollar_error:5 avg_percent_error:5 "
    "direction_accuracy:6 avg_confidence:6 std_percent_error:5 median_percent_error:5"
)


@query("window_experiment_statistics", f"{_WSTATS} {emit_sql(_WSTATS_OUT, 'st')}")
def window_experiment_statistics(spark, sf):
    return emit(bt.window_statistics(_window_records(spark, sf)), _WSTATS_OUT)


_BEST = f"""{_WSTATS}, best as (select asset, horizon, window_name, train_days, avg_percent_error as expected_error from st
  qualify row_number() over (partition by asset, horizon order by avg_percent_error, window_place) = 1)"""
_BEST_OUT = spec("asset horizon window_name train_days expected_error:5")


@query("best_training_windows", f"{_BEST} {emit_sql(_BEST_OUT, 'best')}")
def best_training_windows(spark, sf):
    return emit(bt.best_windows(bt.window_statistics(_window_records(spark, sf))), _BEST_OUT)


@query(
    "production_training_rows",
    f"""{_BEST} select b.asset, b.horizon, count(*) as rows, min(f.datetime) as first_row, max(f.datetime) as last_row
from best b join lens using (asset) join feats f on f.asset = b.asset and f.rn >= lens.n - b.train_days * 24 group by 1, 2""",
)
def production_training_rows(spark, sf):
    """The newest rows of each series that its best window keeps for the final model."""
    rows = daily_features(spark, sf)
    records = bt.evaluate_splits(rows, bt.window_splits(bt.sizes(rows), runs=_RUNS), "price_change_24h")
    best = staged(bt.best_windows(bt.window_statistics(records)), "best-windows")
    longest = max(settings.TRAINING_WINDOWS.values()) * 24
    tail = tail_rows(rows, longest).join(bt.sizes(rows), "asset").join(best, "asset")
    kept = tail.where(F.col("_rn") >= F.col("n") - F.col("train_days") * 24)
    return kept.groupBy("asset", "horizon").agg(
        F.count(F.lit(1)).alias("rows"), F.min("datetime").alias("first_row"), F.max("datetime").alias("last_row")
    )


@query("backtest_with_trees")
def backtest_with_trees(spark, sf):
    """The newest split of every series with boosted trees, all three horizons."""
    rows = daily_features(spark, sf)
    newest = latest_per_key(bt.time_splits(bt.sizes(rows), 30, 7), ["asset"], ["train_end"])
    return bt.evaluate_splits_with(rows, [r.asDict() for r in newest.collect()], SMALL)


_PRODUCTION_OUT = spec("asset horizon version state training_window training_days training_samples expected_error:5 chosen_feature weight:5 intercept:4")


@query(
    "production_models",
    f"""{_BEST}, tails as (select f.* from feats f join lens using (asset)),
{one_model_sql("tails", first="and exists (select 1 from winner w join lens l using (asset) where w.asset = xs.asset and w.horizon = xs.horizon and xs.rn >= l.n - w.train_days * 24)")},
prod as (select b.asset, b.horizon, 1::bigint as version, 'production' as state, w.window_name as training_window, w.train_days as training_days,
  b.n as training_samples, w.expected_error, b.feature as chosen_feature, b.slope as weight, b.cut as intercept
  from best b join winner w using (asset, horizon)) {emit_sql(_PRODUCTION_OUT, 'prod')}""".replace("best as (select asset, horizon, window_name", "winner as (select asset, horizon, window_name"),
)
def production_models(spark, sf):
    """The window experiment's winner of each series and horizon, fitted on its tail and registered."""
    rows = daily_features(spark, sf)
    best = staged(bt.best_windows(bt.window_statistics(bt.evaluate_splits(rows, bt.window_splits(bt.sizes(rows), runs=_RUNS), "price_change_24h"))), "best-windows")
    store = Store(spark, scratch_path(spark, "model-store")).ensure()
    store_models.production_training(store, rows, FEATURES, best, moment(AT), learner=ONE)
    models = store_models.newest(store, store_models.PRODUCTION)
    return emit(models.withColumn("chosen_feature", F.col("chosen")[0])
                .withColumn("weight", F.aggregate("weights", F.lit(0.0), lambda s, v: s + v)), _PRODUCTION_OUT)
