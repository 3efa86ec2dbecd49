"""Oracle SQL of the fitted models, importances, trees and changing stores."""

from __future__ import annotations

from checks import oracle_queries as Q
from checks.oracle import SQL, register, with_views
from grovecast.sources.fixtures import TREE_COMBINE_ROWS, TREE_NODE_ROWS

# -- least squares on the simple model's three features, closed form per group ``grp`` of g -----------
PAIRS = Q.HARVEST_CLEAN + f"""
, sy as (select site, cast(year(obs_date) as int) as year,
                {Q._r9(Q._psum("month(obs_date) = 1", "rain"))} as Rain_Jan,
                {Q._r9("avg(clouds) filter (where month(obs_date) = 9)")} as Clouds_Sep,
                {Q._r9("avg(clouds) filter (where month(obs_date) = 10)")} as Clouds_Oct
         from weather_daily group by site, cast(year(obs_date) as int))
, f as (select sy.site, sy.year, coalesce(Rain_Jan, 0e0) as x1, coalesce(Clouds_Sep, 0e0) as x2, coalesce(Clouds_Oct, 0e0) as x3,
               hc.harvest_kg as y
        from sy join hc on hc.site = sy.site and hc.year - 1 = sy.year)"""
SOLVED = """
, m as (select grp, count(*) as n, avg(x1) as m1, avg(x2) as m2, avg(x3) as m3, avg(y) as my, var_pop(y) as vy,
               stddev_pop(x1) as s1, stddev_pop(x2) as s2, stddev_pop(x3) as s3,
               corr(x1, x2) as a, corr(x1, x3) as b, corr(x2, x3) as c,
               covar_pop(x1, y) / stddev_pop(x1) as g1, covar_pop(x2, y) / stddev_pop(x2) as g2,
               covar_pop(x3, y) / stddev_pop(x3) as g3
        from g group by grp)
, inv as (select *, 1 + 2 * a * b * c - a * a - b * b - c * c as det from m)
, fit as (
  select *,
         ((1 - c * c) * g1 + (b * c - a) * g2 + (a * c - b) * g3) / det as k1,
         ((b * c - a) * g1 + (1 - b * b) * g2 + (a * b - c) * g3) / det as k2,
         ((a * c - b) * g1 + (a * b - c) * g2 + (1 - a * a) * g3) / det as k3
  from inv)"""
PREDICTED = "my + k1 * (x1 - m1) / s1 + k2 * (x2 - m2) / s2 + k3 * (x3 - m3) / s3"


@register("fit_simple", "weather_daily", "harvest")
def _():
    return PAIRS + """
, folded as (select *, cast(('0x' || substr(md5(site || '|' || cast(year as varchar)), 1, 8)) as bigint) % 3 as fold from f)
, g as (select -1 as grp, * from folded
        union all select t.k as grp, folded.* from folded, (values (0), (1), (2)) t(k) where fold <> t.k)""" + SOLVED + f"""
, cv as (select avg(mae) as cv_mae from (
    select fold, avg(abs(y - ({PREDICTED}))) as mae from folded join fit on fit.grp = folded.fold group by fold))
, whole as (select fit.*, (k1 * g1 + k2 * g2 + k3 * g3) / vy as r2, cv_mae from fit, cv where grp = -1)
, feats as (select 'Rain_Jan' as feature, m1 as mean, s1 as scale, k1 as coef, w.* from whole w
            union all select 'Clouds_Sep', m2, s2, k2, w.* from whole w
            union all select 'Clouds_Oct', m3, s3, k3, w.* from whole w)
select 'fitted' as model, 'lin' as member, feature, round_even(mean, 6) as mean, round_even(scale, 6) as scale,
       round_even(coef, 6) as coef, 'Fitted linear model (fitted)' as name,
       printf('R²=%.2f on %d pairs', r2, n) as description, round_even(my, 6) as intercept,
       cast(null as double) as oil_factor, round_even(cv_mae, 6) as cv_mae,
       round_even(1 - (1 - r2) * (n - 1) / (n - 4), 6) as adj_r2
from feats"""


@register("backtest_rolling", "weather_daily", "harvest")
def _():
    return PAIRS + """
, g as (select t.year as grp, f.* from (select distinct year from f) t join f on f.year < t.year)""" + SOLVED + f"""
, p as (select f.site, f.year, fit.n, greatest(0e0, {PREDICTED}) as predicted, y from f join fit on fit.grp = f.year where fit.n >= 8)
select site, year as weather_year, cast(year + 1 as int) as harvest_year, n as n_train, round_even(predicted, 3) as predicted_kg,
       round_even(y, 3) as actual_kg, round_even(abs(predicted - y), 3) as abs_error
from p"""


@register("predict_simple_fallback", "no_september", "model_feature", "model_meta")
def _():
    return Q.YEARS + Q._simple_body() + "\nselect * from simple_out"


# -- permutation importance ----------------------------------------------------------------------
USED = ["Rain_Jan", "Clouds_Sep", "Clouds_Oct", "Rain_winter", "Temp_spring", "Clouds", "Sun_Hours"]


def _importance() -> str:
    cols = [c for c in Q.yearly_cols() + Q.seasonal_cols() + Q.monthly_cols() if c.rsplit(" as ", 1)[1] in USED]
    each = "\n  union all ".join(f"select site, year, label, '{u}' as feature, coalesce({u}, 0e0) as value from ifx" for u in USED)
    return Q.HARVEST_CLEAN + f"""
, ifx as (select y.*, hc.harvest_kg as label from ({Q._feat_sql(cols)}) y join hc on hc.site = y.site and hc.year - 1 = y.year)""" + \
        Q._score("ifx", "site, year", "model in ('simple', 'complex')", Q.D1_NAMES, USED) + f"""
, base as (select site, year, model, round_even(avg(raw), 9) as base from members group by site, year, model)
, used as (select model, feature, sum(coef / scale) / max(n) as slope
           from model_feature join (select model as mm, count(distinct member) as n from model_meta group by model) on mm = model
           where model in ('simple', 'complex') group by model, feature)
, every as ({each})
, placed as (select *, row_number() over (partition by feature order by md5('1|' || feature || '|' || site || '|' || cast(year as varchar))) as place,
                    count(*) over (partition by feature) as size from every)
, dealt as (select a.*, b.value as other from placed a join placed b on a.feature = b.feature and b.place = a.place % a.size + 1)
, gains as (
  select u.model, u.feature, round_even(avg(abs(label - (base + slope * (other - value)))) - avg(abs(label - base)), 4) as importance,
         round_even(avg(abs(label - base)), 4) as base_mae, count(*) as n_rows
  from dealt d join used u on u.feature = d.feature join base on base.site = d.site and base.year = d.year and base.model = u.model
  group by u.model, u.feature)
, ranked as (select *, cast(row_number() over (partition by model order by importance desc, feature) as int) as rank from gains)"""


@register("model_importance", "weather_daily", "harvest", "model_feature", "model_meta")
def _():
    return _importance() + "\nselect * from ranked"


@register("model_info", "weather_daily", "harvest", "model_feature", "model_meta")
def _():
    return _importance() + """
, tops as (select model, string_agg(cast(rank as varchar) || ':' || feature, ',' order by rank) as top_features from ranked where rank <= 3 group by model)
, feats as (select model, cast(count(distinct feature) as int) as feature_count, string_agg(distinct feature, ',' order by feature) as features
            from model_feature group by model)
select x.model, min(name) as name, max(feature_count) as feature_count, max(features) as features,
       string_agg(distinct member, ',' order by member) as members, max(top_features) as top_features
from model_meta x join feats on feats.model = x.model left join tops on tops.model = x.model group by x.model"""


# -- trees ------------------------------------------------------------------------------------------
def _values(rows: list[tuple]) -> str:
    text = lambda v: "null" if v is None else f"'{v}'" if isinstance(v, str) else f"{v!r}e0" if isinstance(v, float) else str(v)
    return ",\n  ".join("(" + ", ".join(text(v) for v in r) + ")" for r in rows)


@register("predict_trees", "weather_daily", recursive=True)
def _():
    used = ["Rain_Jan", "Clouds_Sep", "Temp_spring", "Sun_Hours", "Rain_winter"]
    cols = [c for c in Q.yearly_cols() + Q.seasonal_cols() + Q.monthly_cols() if c.rsplit(" as ", 1)[1] in used]
    pick = " ".join(f"when '{u}' then coalesce({u}, 0e0)" for u in used)
    return f"""
, tn(model, member, tree, node, feature, threshold, left_node, right_node, value, weight) as (values
  {_values(TREE_NODE_ROWS)})
, tc(model, member, how, base) as (values {_values(TREE_COMBINE_ROWS)})
, tfx as ({Q._feat_sql(cols)})
, walk as (
  select site, year, tn.model, tn.member, tree, 0 as node from tfx, (select distinct model, member, tree from tn) tn
  union all
  select w.site, w.year, w.model, w.member, w.tree, case when (case tn.feature {pick} end) <= tn.threshold then left_node else right_node end
  from walk w join tn on tn.member = w.member and tn.tree = w.tree and tn.node = w.node join tfx on tfx.site = w.site and tfx.year = w.year
  where tn.feature is not null)
, leaves as (select w.*, tn.value, tn.weight from walk w join tn on tn.member = w.member and tn.tree = w.tree and tn.node = w.node where tn.feature is null)
, members as (
  select site, year, l.model, l.member, round_even(max(base) + case when max(how) = 'mean' then avg(value) else sum(value * weight) end, 9) as raw
  from leaves l join tc on tc.member = l.member group by site, year, l.model, l.member)
, per as (select site, year, model, round_even(avg(raw), 6) as mean_raw, count(*) as n_members,
                 max(case when member = 'boosted' then raw end) as boosted_raw, max(case when member = 'forest' then raw end) as forest_raw
          from members group by site, year, model)
select *, cast(round_even(greatest(0e0, mean_raw), 0) as bigint) as harvest_kg from per"""


# -- reports ------------------------------------------------------------------------------------------
def _disease_report_gaps() -> str:
    whole = SQL["disease_report"]
    body = whole[whole.index(", pd as"):whole.rindex("select s.site, h.avg_temperature")].replace("from weather_daily)", "from wsel)")
    return Q.HARVEST_CLEAN + """
, nth as (select site, row_number() over (order by site) as nth from (select distinct site from hc))
, wsel as (select w.* from weather_daily w join nth on nth.site = w.site where nth % 2 = 1)""" + "\n" + body + """
select s.site, h.avg_temperature, h.total_rain_30d, h.rainy_days_30d,
       case when c.site is null then null when c.n_high >= 3 then 'HIGH'
            when c.n_high >= 1 or c.n_moderate >= 3 then 'MODERATE' else 'LOW' end as overall_risk,
       case when c.obs_date is null then 'No weather data available' end as error,
       cast(case when c.site is null then 0 else 5 end as int) as n_diseases
from sites s left join head h on h.site = s.site left join counts c on c.site = s.site"""


# its body is that of the whole report, rewritten already
SQL["disease_report_gaps"] = with_views(_disease_report_gaps(), "weather_daily", "harvest")


@register("records_json", "harvest")
def _():
    return Q.HARVEST_CLEAN + """
, h as (
  select site, year, trees, harvest_kg, oil,
         case when oil is not null and oil <> 0 and harvest_kg is not null and harvest_kg <> 0
                then round_even(round_even(oil / harvest_kg * 100e0, 9), 1)
              when ratio is not null and ratio <> 0 then round_even(round_even(ratio * 100e0, 9), 1) else ratio end as ratio,
         min(year) over (partition by site) as start_year, max(year) over (partition by site) as end_year
  from hc)
select site, cast(to_json({'site': site, 'year': year, 'trees': trees, 'harvest_kg': harvest_kg, 'oil': oil, 'ratio': ratio,
                           'start_year': start_year, 'end_year': end_year}) as varchar) as json
from h"""


# -- payloads and stores ---------------------------------------------------------------------------------
@register("payload_rejects", "weather_daily")
def _():
    return """
, pm as (select site, cast(month(obs_date) as int) as m, 4 * count(*) as hours from weather_daily group by site, year(obs_date), month(obs_date))
, found as (
  select cast(null as varchar) as site, case m when 2 then 'not JSON' else 'no site' end as reason, 1 as k from pm where m in (2, 4)
  union all select site, case m when 6 then 'no times' when 8 then 'bad time' else 'bad value: temperature_2m' end, 1 from pm where m in (6, 8, 10)
  union all select site, 'accepted', hours - case when m in (8, 10) then 1 else 0 end from pm where m not in (2, 4, 6))
select site, reason, cast(sum(k) as bigint) as n_rows from found where k > 0 group by site, reason"""


@register("store_replace", "weather_daily")
def _():
    return Q.SCENARIO + Q._hourly_rows("recent") + f"""
, last_hour as (select * from hourly where h = 18)
select {Q.STORE_COLS} from last_hour
union all
select {Q.STORE_COLS} from store s where not exists (select 1 from last_hour l where l.site = s.site and l.obs_date = s.obs_date)"""


SQL["rollup_store"] = SQL["daily_rollup"]
SQL["window30_incremental"] = SQL["stream_window30"] = SQL["window30_asof"]
