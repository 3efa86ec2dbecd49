"""Oracle SQL bodies, one per registered query (see ``checks.oracle``)."""

from __future__ import annotations

from checks.oracle import register

# window statistics over the plain per-site window (no blocking)
WX = """
, wx as (select *, 100e0 - coalesce(nullif(clouds, 0e0), 50e0) as humidity from weather_daily)"""


def _win(n: int, src: str = "wx") -> str:
    return f"""
, win{n} as (
  select site, obs_date, cast(month(obs_date) as int) as month,
         count(*) over w as n_rows,
         avg(avg_temp) over w as avg_temp,
         coalesce(sum(rain) over w, 0e0) as total_rain,
         avg(humidity) over w as avg_humidity,
         count(case when rain > 0.5e0 then 1 end) over w as rainy_days
  from {src}
  window w as (partition by site order by obs_date rows between {n - 1} preceding and current row))"""


RULES = """
, drule(disease, ord, name, temp_lo, temp_hi, opt_lo, opt_hi, band_pts, opt_pts, hum_min, hum_pts,
        rainy_min, rainy_pts, rain_over, rain_pts, warm_over, warm_pts, months, month_pts,
        description, rec1_hi, rec1_lo, rec2, rec3, best_treatment_time) as (values
  ('peacock_spot', 0, 'Peacock Spot (Cycloconio)', 10, 25, 15, 22, 30, 30, 70, 20, 3, 20, null, 0, null, 0, [3, 4, 5, 9, 10, 11], 10,
   'Fungal disease causing leaf spots, defoliation. Optimal: 15-22°C with high humidity and prolonged leaf wetness.',
   'Apply copper fungicide before winter rains', 'Monitor conditions', 'Ensure good canopy ventilation', 'Avoid overhead irrigation',
   'Late October or early spring'),
  ('verticillium_wilt', 1, 'Verticillium Wilt', 15, 28, 18, 25, 30, 30, null, 0, 5, 15, 50, 25, null, 0, [], 0,
   'Soil-borne fungus blocking water vessels. Thrives with mild temps + rain periods.',
   'Improve soil drainage', 'Monitor soil moisture', 'Avoid planting after susceptible crops (cotton, tomatoes)',
   'No chemical cure - focus on prevention', 'Prevention before planting'),
  ('olive_knot', 2, 'Olive Knot (Tuberculosis)', 5, 25, 10, 20, 25, 25, 60, 25, null, 0, 30, 10, null, 0, [12, 1, 2, 3, 4], 15,
   'Bacterial disease causing tumors on branches. Favored by mild temps, humidity, and bark wounds.',
   'Remove tumors in summer (July-August) in dry conditions', 'Remove tumors in summer (July-August) in dry conditions',
   'Apply copper after pruning', 'Disinfect pruning tools', 'Summer for tumor removal, copper spray after pruning'),
  ('xylella', 3, 'Xylella Fastidiosa', 15, 35, 26, 28, 20, 40, 50, 20, null, 0, null, 0, 20, 20, [], 0,
   'Deadly bacterial disease (OQDS). Optimal spread at 26-28°C via spittlebug vectors.',
   'Monitor for spittlebug vectors', 'Monitor for spittlebug vectors', 'No cure - prevention critical',
   'Report suspicious symptoms immediately', 'Vector control in spring-summer'),
  ('anthracnose', 4, 'Anthracnose (Leprosy)', 15, 27, 18, 24, 25, 25, 85, 30, null, 0, 40, 20, null, 0, [], 0,
   'Fungal fruit rot. High humidity and rain favor fruit infection.',
   'Apply fungicide at first signs of rain in risky periods', 'Apply fungicide at first signs of rain in risky periods',
   'Remove infected fruit', 'Improve air circulation', 'Before rain events in spring-autumn'))"""


def _scored(src: str) -> str:
    return f"""
, scored as (
  select s.site, s.obs_date, s.avg_temp, s.total_rain, s.avg_humidity, s.rainy_days, r.*,
    (case when round_even(s.avg_temp, 9) between r.temp_lo and r.temp_hi then r.band_pts else 0 end
     + case when round_even(s.avg_temp, 9) between r.temp_lo and r.temp_hi
             and round_even(s.avg_temp, 9) between r.opt_lo and r.opt_hi then r.opt_pts else 0 end
     + case when r.hum_min is not null and round_even(s.avg_humidity, 9) >= r.hum_min then r.hum_pts else 0 end
     + case when r.rainy_min is not null and s.rainy_days >= r.rainy_min then r.rainy_pts else 0 end
     + case when r.rain_over is not null and round_even(s.total_rain, 9) > r.rain_over then r.rain_pts else 0 end
     + case when r.warm_over is not null and round_even(s.avg_temp, 9) > r.warm_over then r.warm_pts else 0 end
     + case when list_contains(r.months, s.month) then r.month_pts else 0 end) as score
  from {src} s cross join drule r)
, labelled as (
  select *, case when score >= 70 then 'HIGH' when score >= 40 then 'MODERATE' else 'LOW' end as risk_label
  from scored)"""


@register("window30_asof", "weather_daily")
def _():
    return WX + _win(30) + """
select site, obs_date, month, n_rows, round_even(avg_temp, 9) as avg_temp,
       round_even(total_rain, 9) as total_rain, round_even(avg_humidity, 9) as avg_humidity, rainy_days
from win30"""


@register("window30_latest", "weather_daily")
def _():
    return WX + """
, ranked as (select *, row_number() over (partition by site order by obs_date desc) as rk from wx)
select site, max(obs_date) as obs_date, cast(month(max(obs_date)) as int) as month, count(*) as n_rows,
       round_even(avg(avg_temp), 9) as avg_temp, round_even(coalesce(sum(rain), 0e0), 9) as total_rain,
       round_even(avg(humidity), 9) as avg_humidity, count(case when rain > 0.5e0 then 1 end) as rainy_days
from ranked where rk <= 30 group by site"""


@register("disease_scores", "weather_daily")
def _():
    return WX + _win(30) + RULES + _scored("win30") + """
select site, obs_date, disease, name, cast(least(100, score) as int) as risk_level, risk_label, description,
       case when score >= 50 then rec1_hi else rec1_lo end as recommendation_1,
       rec2 as recommendation_2, rec3 as recommendation_3, best_treatment_time
from labelled"""


@register("disease_overall", "weather_daily")
def _():
    return WX + _win(30) + RULES + _scored("win30") + """
, counts as (
  select site, obs_date, any_value(avg_temp) as avg_temp, any_value(total_rain) as total_rain,
         any_value(avg_humidity) as avg_humidity, any_value(rainy_days) as rainy_days,
         cast(count_if(risk_label = 'HIGH') as int) as n_high,
         cast(count_if(risk_label = 'MODERATE') as int) as n_moderate,
         cast(count_if(risk_label = 'LOW') as int) as n_low
  from labelled group by site, obs_date)
select site, obs_date,
       round_even(round_even(avg_temp, 9), 1) as avg_temperature,
       round_even(round_even(total_rain, 9), 1) as total_rain_30d,
       round_even(round_even(avg_humidity, 9), 1) as avg_humidity_estimate,
       cast(rainy_days as int) as rainy_days_30d, n_high, n_moderate, n_low,
       case when n_high >= 3 then 'HIGH' when n_high >= 1 or n_moderate >= 3 then 'MODERATE' else 'LOW' end
         as overall_risk
from counts"""


FRULE = """
, frule(type, ord, temp_lo, temp_hi, humidity_min, best_months, description) as (values
  ('nitrogen_early_spring', 0, 10, 20, 50, [2, 3], 'Nitrogen for vegetative recovery and flower differentiation'),
  ('boron_preflowering', 1, 12, 22, 55, [3, 4], 'Boron, zinc for flowering and fruit set'),
  ('potassium_summer', 2, 20, 32, 40, [6, 7, 8], 'Potassium, magnesium for fruit growth'),
  ('calcium_midsummer', 3, 18, 30, 45, [5, 6, 7], 'Calcium for fruit firmness and stress resistance'),
  ('phosphorus_autumn', 4, 12, 25, 50, [9, 10, 11], 'Phosphorus for reserve replenishment'))"""


def _advice(src: str) -> str:
    return f"""
, adv as (
  select s.site, s.obs_date, s.month, s.avg_temp, s.avg_humidity, s.total_rain, r.*,
         coalesce(round_even(s.avg_temp, 9) between r.temp_lo and r.temp_hi, false) as temperature_ok,
         coalesce(round_even(s.avg_humidity, 9) >= r.humidity_min, false) as humidity_ok,
         coalesce(round_even(s.total_rain, 9) < 5, false) as no_rain_ok
  from {src} s join frule r on list_contains(r.best_months, s.month))
, adv2 as (
  select *, temperature_ok and humidity_ok and no_rain_ok as weather_suitable,
         case when temperature_ok and humidity_ok and no_rain_ok then 'OPTIMAL' else 'SUBOPTIMAL' end as status
  from adv)"""


def _win7(src: str = "wx") -> str:
    return f"""
, win7 as (
  select site, obs_date, cast(month(obs_date) as int) as month, count(*) over w as n_rows,
         avg(avg_temp) over w as avg_temp, avg(humidity) over w as avg_humidity,
         coalesce(sum(rain) over w, 0e0) as total_rain
  from {src} window w as (partition by site order by obs_date rows between 6 preceding and current row))"""


@register("window7_asof", "weather_daily")
def _():
    return WX + _win7() + """
select site, obs_date, month, n_rows, round_even(avg_temp, 9) as avg_temp,
       round_even(avg_humidity, 9) as avg_humidity, round_even(total_rain, 9) as total_rain
from win7"""


@register("foliar_advice", "weather_daily")
def _():
    return WX + _win7() + FRULE + _advice("win7") + """
select site, obs_date, type,
       array_to_string(list_transform(string_split(type, '_'), lambda w: upper(w[1]) || w[2:]), ' ') as name,
       description, array_to_string(best_months, ',') as months, month as current_month,
       true as in_season, weather_suitable,
       round_even(round_even(avg_temp, 9), 1) as temperature_current,
       cast(temp_lo as varchar) || '-' || cast(temp_hi as varchar) || '°C' as temperature_required,
       temperature_ok,
       round_even(round_even(avg_humidity, 9), 1) as humidity_current,
       '>' || cast(humidity_min as varchar) || '%' as humidity_required,
       humidity_ok, no_rain_ok, status,
       case when status = 'OPTIMAL' then 'Apply now' else 'Wait for better conditions' end as recommendation
from adv2"""


@register("foliar_report", "weather_daily")
def _():
    return WX + """
, ranked as (select *, row_number() over (partition by site order by obs_date desc) as rk from wx)
, last7 as (
  select site, max(obs_date) as obs_date, cast(month(max(obs_date)) as int) as month,
         avg(avg_temp) as avg_temp, avg(humidity) as avg_humidity, coalesce(sum(rain), 0e0) as total_rain
  from ranked where rk <= 7 group by site)""" + FRULE + _advice("last7") + """
select l.site, l.obs_date,
       case when l.month in (12, 1, 2) then 'winter' when l.month in (3, 4, 5) then 'spring'
            when l.month in (6, 7, 8) then 'summer' else 'autumn' end as season,
       'Early morning (6-9 AM) or late afternoon (5-7 PM)' as best_time_of_day,
       'Midday heat (>30°C), strong wind, rain forecast within 24h' as avoid,
       round_even(round_even(l.avg_temp, 9), 1) as temperature,
       round_even(round_even(l.avg_humidity, 9), 1) as humidity,
       round_even(round_even(l.total_rain, 9), 1) as recent_rain,
       cast(count(a.type) over (partition by l.site) as int) as n_recommendations,
       a.type,
       array_to_string(list_transform(string_split(a.type, '_'), lambda w: upper(w[1]) || w[2:]), ' ') as name,
       a.description, array_to_string(a.best_months, ',') as months, a.month as current_month,
       case when a.type is not null then true end as in_season, a.weather_suitable, a.status,
       case when a.status = 'OPTIMAL' then 'Apply now' when a.type is not null then 'Wait for better conditions' end
         as recommendation,
       round_even(round_even(a.avg_temp, 9), 1) as temperature_current,
       cast(a.temp_lo as varchar) || '-' || cast(a.temp_hi as varchar) || '°C' as temperature_required, a.temperature_ok,
       round_even(round_even(a.avg_humidity, 9), 1) as humidity_current,
       '>' || cast(a.humidity_min as varchar) || '%' as humidity_required, a.humidity_ok,
       case when a.type is not null then 'No rain' end as rain_required, a.no_rain_ok as rain_ok
from last7 l left join adv2 a on l.site = a.site"""


# ---------------------------------------------------------------------------
# step 1, 4, 5, 6
# ---------------------------------------------------------------------------
MONTHS = ["Jan", "Feb", "Mar", "Apr", "May", "Jun", "Jul", "Aug", "Sep", "Oct", "Nov", "Dec"]
SEASON_MONTHS = {"winter": (12, 1, 2), "spring": (3, 4, 5), "summer": (6, 7, 8), "autumn": (9, 10, 11)}
D1_NAMES = (["Avg_Temp", "Max_Temp", "Min_Temp", "Rain", "Clouds", "Sun_Hours"]
            + [f"{m}_{s}" for s in SEASON_MONTHS for m in ("Rain", "Temp", "Clouds")]
            + [f"{m}_{n}" for n in MONTHS for m in ("Rain", "Temp", "Clouds")])
SEASON_CASE = ("case when month(obs_date) in (12, 1, 2) then 'winter' when month(obs_date) in (3, 4, 5) then 'spring' "
               "when month(obs_date) in (6, 7, 8) then 'summer' else 'autumn' end")


def _r9(x: str) -> str:
    return f"round_even({x}, 9)"


def _cond(kind: str, key) -> str:
    if kind == "season":
        return f"month(obs_date) in {SEASON_MONTHS[key]}"
    return f"month(obs_date) = {key}"


def _psum(cond: str, x: str) -> str:
    return f"case when count(*) filter (where {cond}) > 0 then coalesce(sum({x}) filter (where {cond}), 0e0) end"


def yearly_cols() -> list[str]:
    return [f"{_r9('avg(avg_temp)')} as Avg_Temp", f"{_r9('avg(max_temp)')} as Max_Temp",
            f"{_r9('avg(min_temp)')} as Min_Temp", f"{_r9('coalesce(sum(rain), 0e0)')} as Rain",
            f"{_r9('avg(clouds)')} as Clouds", f"{_r9('coalesce(sum(sun_hours), 0e0)')} as Sun_Hours"]


def seasonal_cols() -> list[str]:
    out = []
    for s in SEASON_MONTHS:
        c = _cond("season", s)
        out += [f"{_r9(_psum(c, 'rain'))} as Rain_{s}",
                f"{_r9(f'avg(avg_temp) filter (where {c})')} as Temp_{s}",
                f"{_r9(f'avg(clouds) filter (where {c})')} as Clouds_{s}"]
    return out


def monthly_cols() -> list[str]:
    out = []
    for i, n in enumerate(MONTHS, 1):
        c = _cond("month", i)
        out += [f"{_r9(_psum(c, 'rain'))} as Rain_{n}",
                f"{_r9(f'avg(avg_temp) filter (where {c})')} as Temp_{n}",
                f"{_r9(f'avg(clouds) filter (where {c})')} as Clouds_{n}"]
    return out


def _feat_sql(cols: list[str], src: str = "weather_daily") -> str:
    return (f"select site, cast(year(obs_date) as int) as year, {', '.join(cols)} "
            f"from {src} group by site, cast(year(obs_date) as int)")


@register("season_of_day", "weather_daily")
def _():
    return f"""
select site, obs_date, cast(year(obs_date) as int) as year, cast(month(obs_date) as int) as month,
       {SEASON_CASE} as season
from weather_daily"""


@register("humidity_proxy", "weather_daily")
def _():
    return """
select site, obs_date, clouds, 100e0 - coalesce(nullif(clouds, 0e0), 50e0) as humidity,
       coalesce(rain, 0e0) as rain_or_zero
from weather_daily"""


HARVEST_CLEAN = """
, hc as (
  select site, cast(year as int) as year, cast(trunc(trees) as int) as trees, harvest_kg, oil, ratio from harvest
  where site is not null and year is not null and trees is not null and harvest_kg is not null
    and oil is not null and ratio is not null)"""


@register("harvest_clean", "harvest")
def _():
    return HARVEST_CLEAN + "\nselect * from hc"


@register("weather_yearly", "weather_daily")
def _():
    return _feat_sql(yearly_cols())


@register("weather_seasonal", "weather_daily")
def _():
    return _feat_sql(seasonal_cols())


@register("weather_monthly", "weather_daily")
def _():
    return _feat_sql(monthly_cols())


@register("features", "weather_daily")
def _():
    return _feat_sql(yearly_cols() + seasonal_cols() + monthly_cols())


def legacy_cols() -> list[str]:
    y = [("avg", "avg_temp", "Avg_Temp_yearly"), ("avg", "max_temp", "Max_Temp_yearly"),
         ("avg", "min_temp", "Min_Temp_yearly"), ("sum", "rain", "Rain_yearly"),
         ("avg", "pressure", "Pressure_yearly"), ("sum", "snow", "Snow_yearly"),
         ("sum", "sun_hours", "Sun_Hours_yearly"), ("avg", "max_wind", "Max_Wind_yearly"),
         ("avg", "avg_wind", "Avg_Wind_yearly"), ("avg", "avg_gust", "Avg_Gust_yearly"),
         ("avg", "clouds", "Clouds_yearly")]
    out = [f"{_r9(f'avg({c})' if k == 'avg' else f'coalesce(sum({c}), 0e0)')} as {n}" for k, c, n in y]
    for s in SEASON_MONTHS:
        c = _cond("season", s)
        out += [f"{_r9(_psum(c, 'rain'))} as Rain_{s}",
                f"{_r9(f'avg(avg_temp) filter (where {c})')} as Avg_Temp_{s}"]
    for m, col, stem in [(3, "max_wind", "Max_Wind"), (4, "avg_temp", "Avg_Temp"), (6, "max_temp", "Max_Temp"),
                         (8, "clouds", "Clouds"), (9, "avg_temp", "Avg_Temp")]:
        out.append(f"first({col} order by obs_date) filter (where month(obs_date) = {m}) as {stem}_M{m}")
    out.append(f"{_r9(_r9('avg(max_temp)') + ' - ' + _r9('avg(min_temp)'))} as Temp_Spread_yearly")
    return out


LEGACY_NAMES = (["Avg_Temp_yearly", "Max_Temp_yearly", "Min_Temp_yearly", "Rain_yearly", "Pressure_yearly",
                 "Snow_yearly", "Sun_Hours_yearly", "Max_Wind_yearly", "Avg_Wind_yearly", "Avg_Gust_yearly",
                 "Clouds_yearly"]
                + [f"{m}_{s}" for s in SEASON_MONTHS for m in ("Rain", "Avg_Temp")]
                + ["Max_Wind_M3", "Avg_Temp_M4", "Max_Temp_M6", "Clouds_M8", "Avg_Temp_M9", "Temp_Spread_yearly"])


@register("features_legacy", "weather_daily")
def _():
    return _feat_sql(legacy_cols())


def _score(fx: str, ids: str, model_filter: str, names: list[str], used: list[str], sx: str = "") -> str:
    """Members scored independently of the Spark plan: matched contributions,
    plus the constant of features absent from the catalogue, plus intercept.
    ``used`` = catalogue features the models may name (unpivoted)."""
    id_list = [i.strip() for i in ids.split(",")]
    sel_ids = ", ".join(f"f.{i}" for i in id_list)
    longs = "\n    union all ".join(
        f"select {sel_ids}, '{u}' as feature, f.{u} as value from {fx} f" for u in used)
    names_sql = ", ".join(f"'{n}'" for n in names)
    on_ids = " and ".join(f"s.{i} = c.{i}" for i in id_list)
    return f"""
, long{sx} as (
    {longs})
, mf{sx} as (select * from model_feature where {model_filter})
, mm{sx} as (select * from model_meta where {model_filter})
, contrib{sx} as (
  select {', '.join('l.' + i for i in id_list)}, mf.model, mf.member,
         sum(mf.coef * (coalesce(l.value, 0e0) - mf.mean) / mf.scale) as c
  from long{sx} l join mf{sx} mf on l.feature = mf.feature group by all)
, missing{sx} as (
  select model, member, sum(coef * (0e0 - mean) / scale) as c from mf{sx}
  where feature not in ({names_sql}) group by all)
, ids{sx} as (select distinct {ids} from {fx})
, members{sx} as (
  select {', '.join('s.' + i for i in id_list)}, mm.model, mm.member, mm.name, mm.description, mm.oil_factor,
         mm.cv_mae, mm.adj_r2,
         round_even(mm.intercept + coalesce(c.c, 0e0) + coalesce(mi.c, 0e0), 9) as raw
  from ids{sx} s cross join mm{sx} mm
  left join contrib{sx} c on {on_ids} and c.model = mm.model and c.member = mm.member
  left join missing{sx} mi on mi.model = mm.model and mi.member = mm.member)"""


YEARS = """
, yrs as (select site, max(cast(year(obs_date) as int)) as max_year, bool_or(year(obs_date) = 2025) as has_t
          from weather_daily group by site)
, yc as (select site, cast(case when has_t then 2025 else max_year end as int) as weather_year,
                cast(case when has_t then 2025 else max_year end + 1 as int) as harvest_year from yrs)"""


def _simple_body(model: str = "simple") -> str:
    return """
, sfx as (
  select w.site,
    round_even(coalesce(sum(rain) filter (where year(obs_date) = yc.weather_year and month(obs_date) = 1), 0e0), 9) as Rain_Jan,
    round_even(coalesce(avg(clouds) filter (where year(obs_date) = yc.weather_year and month(obs_date) = 9),
                        avg(clouds) filter (where month(obs_date) = 9)), 9) as Clouds_Sep,
    round_even(coalesce(avg(clouds) filter (where year(obs_date) = yc.weather_year and month(obs_date) = 10),
                        avg(clouds) filter (where month(obs_date) = 10)), 9) as Clouds_Oct
  from weather_daily w join yc on w.site = yc.site group by w.site)""" + _score(
        "sfx", "site", f"model = '{model}'", ["Rain_Jan", "Clouds_Sep", "Clouds_Oct"],
        ["Rain_Jan", "Clouds_Sep", "Clouds_Oct"], "_s") + """
, ps as (select site, round_even(avg(raw), 9) as raw, max(cv_mae) as cv_mae, max(adj_r2) as adj_r2,
                max(oil_factor) as oil_factor from members_s group by site)
, simple_pred as (
  select yc.site, yc.harvest_year, yc.weather_year as weather_year_used,
         case when ps.raw is not null then greatest(0e0, ps.raw) else 950e0 end as pred,
         case when ps.raw is not null then coalesce(ps.cv_mae, 300e0) else 200e0 end as cv_mae,
         case when ps.raw is not null then coalesce(ps.adj_r2, 0.94e0) else 0e0 end as r2,
         coalesce(ps.oil_factor, 0.15e0) as oil_factor,
         sfx.Rain_Jan, sfx.Clouds_Sep, sfx.Clouds_Oct
  from yc join sfx on yc.site = sfx.site left join ps on ps.site = yc.site)
, simple_out as (
  select site, harvest_year, weather_year_used,
         cast(round_even(round_even(pred, 9), 0) as bigint) as harvest_kg,
         cast(round_even(round_even(pred * oil_factor, 9), 0) as bigint) as oil_kg,
         cast(round_even(round_even(cv_mae * 2, 9), 0) as bigint) as ci_kg,
         cv_mae, r2, 'Statistical Model (Simple)' as model_name,
         Rain_Jan as rain_jan, Clouds_Sep as clouds_sep, Clouds_Oct as clouds_oct
  from simple_pred)"""


@register("predict_simple", "weather_daily", "model_feature", "model_meta")
def _():
    return YEARS + _simple_body() + "\nselect * from simple_out"


ENS_USED = ["Rain_winter", "Temp_spring", "Clouds", "Sun_Hours"]


def _ens_fx(src: str) -> str:
    c_w, c_s = _cond("season", "winter"), _cond("season", "spring")
    return f"""
, efx as (
  select site, cast(year(obs_date) as int) as year,
         {_r9(_psum(c_w, 'rain'))} as Rain_winter,
         {_r9(f'avg(avg_temp) filter (where {c_s})')} as Temp_spring,
         {_r9('avg(clouds)')} as Clouds,
         {_r9('coalesce(sum(sun_hours), 0e0)')} as Sun_Hours
  from {src} group by site, cast(year(obs_date) as int))"""


def _ens_body(model: str = "complex") -> str:
    return """
, wrows as (select w.* from weather_daily w join yc on w.site = yc.site and year(w.obs_date) = yc.weather_year)""" + \
        _ens_fx("wrows") + _score("efx", "site, year", f"model = '{model}'", D1_NAMES, ENS_USED, "_e") + """
, ens as (
  select site, year, model, round_even(avg(raw), 9) as mean_raw, max(oil_factor) as oil_factor,
         string_agg(member || '=' || cast(cast(round_even(raw, 0) as bigint) as varchar), ',' order by member)
           as individual_predictions
  from members_e group by site, year, model)
, ens_out as (
  select e.site, yc.harvest_year, e.year as weather_year_used,
         cast(round_even(greatest(0e0, mean_raw), 0) as bigint) as harvest_kg,
         cast(round_even(round_even(greatest(0e0, mean_raw) * coalesce(oil_factor, 0.23e0), 9), 0) as bigint) as oil_kg,
         cast(round_even(round_even(greatest(0e0, mean_raw) * 0.4e0, 9), 0) as bigint) as ci_kg,
         cast(cast(round_even(round_even(greatest(0e0, mean_raw) * 0.3e0, 9), 0) as bigint) as double) as cv_mae,
         0.85e0 as r2, 'ML Ensemble (Complex)' as model_name, individual_predictions
  from ens e join yc on e.site = yc.site)"""


@register("predict_ensemble", "weather_daily", "model_feature", "model_meta")
def _():
    return YEARS + _ens_body("complex") + "\nselect * from ens_out"


def _legacy_body() -> str:
    return HARVEST_CLEAN + """
, latest as (select site, max(cast(year(obs_date) as int)) as latest_year from weather_daily group by site)
, lrows as (select w.* from weather_daily w join latest l on w.site = l.site and year(w.obs_date) = l.latest_year)
, lfx as (""" + _feat_sql(legacy_cols(), "lrows") + ")" + _score(
        "lfx", "site, year", "model = 'legacy'", LEGACY_NAMES,
        ["Rain_winter", "Max_Wind_M3", "Temp_Spread_yearly"]) + """
, lm as (select *, round_even(greatest(0e0, raw), 0) as p from members)
, lens as (
  select site, year, round_even(avg(p), 9) as e,
         string_agg(member || '=' || cast(p as varchar), ',' order by member) as predictions_kg
  from lm group by site, year)
, hs as (select site, cast(trunc(avg(trees)) as int) as mean_trees, avg(ratio) as avg_ratio from hc group by site)
, legacy_out as (
  select lt.site, lt.latest_year as year, coalesce(h.trees, hs.mean_trees) as trees, l.predictions_kg,
         case when l.e is null then 'Models not trained' end as error,
         round_even(l.e, 0) as ensemble_kg,
         round_even(round_even(l.e * hs.avg_ratio, 9), 0) as estimated_oil_kg,
         round_even(round_even(l.e / coalesce(h.trees, hs.mean_trees), 9), 1) as harvest_per_tree_kg,
         round_even(round_even(hs.avg_ratio, 9), 3) as avg_oil_ratio
  from latest lt left join lens l on l.site = lt.site and l.year = lt.latest_year
  left join hc h on h.site = lt.site and h.year = lt.latest_year left join hs on hs.site = lt.site)"""


@register("predict_legacy", "weather_daily", "harvest", "model_feature", "model_meta")
def _():
    return _legacy_body() + "\nselect * from legacy_out"


@register("predict_legacy_preferred", "weather_daily", "harvest", "model_feature", "model_meta")
def _():
    return _legacy_body() + "\nselect * from legacy_out"


@register("predict_backtest", "weather_daily", "harvest", "model_feature", "model_meta")
def _():
    used = ["Rain_Jan", "Clouds_Sep", "Clouds_Oct", "Rain_winter", "Temp_spring", "Clouds", "Sun_Hours"]
    cols = [c for c in yearly_cols() + seasonal_cols() + monthly_cols()
            if c.rsplit(" as ", 1)[1] in used]
    return HARVEST_CLEAN + ", bfx as (" + _feat_sql(cols) + ")" + _score(
        "bfx", "site, year", "true", D1_NAMES, used) + """
, ens as (select site, year, model, round_even(avg(raw), 9) as mean_raw from members group by site, year, model)
, rows as (
  select e.site, e.model, cast(e.year as int) as weather_year, cast(e.year + 1 as int) as harvest_year,
         greatest(0e0, e.mean_raw) as predicted_kg, h.harvest_kg as actual_kg,
         round_even(abs(greatest(0e0, e.mean_raw) - h.harvest_kg), 9) as abs_error
  from ens e left join hc h on h.site = e.site and h.year - 1 = e.year)
select r.*, round_even(avg(abs_error) over (partition by site, model), 9) as mae,
       count(abs_error) over (partition by site, model) as n_scored
from rows r"""


LAST_HARVEST = """
, lh as (select site, max(year) as last_year, arg_max(harvest_kg, year) as last_harvest, arg_max(oil, year) as last_oil,
                cast(trunc(arg_max(trees, year)) as int) as last_trees from hc group by site)
, ha as (select site, round_even(round_even(avg(harvest_kg), 9), 0) as hist_kg,
                round_even(round_even(avg(oil), 9), 0) as hist_oil_kg from hc group by site)"""


REGISTRY = """
, registry(model, kind, model_info_name, model_info_description) as (values
  ('simple', 'simple', 'Statistical Model', 'Best statistical model (R²=0.69, p=0.00003)'),
  ('complex', 'ensemble', 'ML Ensemble', 'Ensemble of trained regressors')"""
NEW_MODELS = """,
  ('simple_new', 'simple', 'New Statistical Model', 'Best statistical model (R²=0.69, p=0.00003)'),
  ('complex_new', 'ensemble', 'New Ensemble', 'Ensemble of trained regressors')"""


def _report(requested: list[str], registry: str = REGISTRY, available: str = "''simple'', ''complex''") -> str:
    req = ", ".join(f"('{m}')" for m in requested)
    return YEARS + _simple_body() + _ens_body("complex") + HARVEST_CLEAN + LAST_HARVEST + registry + f""")
, preds as (
  select site, 'simple' as model, harvest_kg, oil_kg, ci_kg, cv_mae, r2, model_name from simple_out
  union all
  select site, 'complex' as model, harvest_kg, oil_kg, ci_kg, cv_mae, r2, model_name from ens_out
  union all
  select site, 'simple_new', 950, 142, 400, 200e0, 0e0, 'Statistical Model (Simple)' from yc)
, req(model) as (values {req})
, report as (
  select yc.site, req.model, g.model_info_name, g.model_info_description,
         case when g.model is not null then yc.harvest_year end as harvest_year,
         case when g.model is not null then yc.weather_year end as weather_year_used,
         coalesce(p.harvest_kg, 0) as harvest_kg, coalesce(p.oil_kg, 0) as oil_kg, p.ci_kg, p.cv_mae, p.r2, p.model_name,
         case when g.model is null then 'Unknown model. Available: [{available}]'
              when p.harvest_kg is null then 'Complex model not available' end as error,
         case when g.model is not null then lh.last_year end as last_year,
         case when g.model is not null then lh.last_harvest end as last_harvest,
         case when g.model is not null then lh.last_oil end as last_oil,
         case when g.model is not null then lh.last_trees end as last_trees
  from yc cross join req
  left join registry g on g.model = req.model
  left join preds p on p.site = yc.site and p.model = g.model
  left join lh on lh.site = yc.site)"""


@register("prediction_report", "weather_daily", "harvest", "model_feature", "model_meta")
def _():
    return _report(["simple", "complex", "simple_new", "complex_new", "ensemble"], REGISTRY + NEW_MODELS,
                   "''simple'', ''complex'', ''simple_new'', ''complex_new''") + "\nselect * from report"


@register("dashboard", "weather_daily", "harvest", "model_feature", "model_meta")
def _():
    return _report(["simple"]) + """
select r.site, model as model_used, harvest_year as year, harvest_kg as ensemble_kg,
       oil_kg as estimated_oil_kg, coalesce(ci_kg, 0) as ci_kg,
       round_even(round_even(harvest_kg / 130, 9), 1) as harvest_per_tree_kg, 130 as trees,
       last_year, last_harvest, last_oil, last_trees, ha.hist_kg, ha.hist_oil_kg, error
from report r left join ha on ha.site = r.site"""


LATEST_WEATHER = """
, lyear as (select site, max(cast(year(obs_date) as int)) as y from weather_daily group by site)
, lw as (
  select w.site, l.y as year,
         round_even(round_even(coalesce(sum(rain), 0e0), 9), 1) as total_rain_mm,
         round_even(round_even(avg(avg_temp), 9), 1) as avg_temp_c,
         round_even(round_even(avg(clouds), 9), 1) as avg_clouds_pct
  from weather_daily w join lyear l on w.site = l.site and year(w.obs_date) = l.y group by w.site, l.y)"""


@register("dashboard_legacy", "weather_daily", "harvest", "model_feature", "model_meta")
def _():
    return _legacy_body() + LAST_HARVEST + LATEST_WEATHER + """
select lw.site, lw.year as latest_weather_year, lw.total_rain_mm, lw.avg_temp_c, lw.avg_clouds_pct,
       lo.year as prediction_year, lo.trees, lo.predictions_kg, lo.ensemble_kg, lo.estimated_oil_kg,
       lo.harvest_per_tree_kg, lo.avg_oil_ratio, lo.error, lh.last_year, lh.last_harvest, lh.last_oil, lh.last_trees,
       ha.hist_kg, ha.hist_oil_kg
from lw left join legacy_out lo on lo.site = lw.site left join lh on lh.site = lw.site
left join ha on ha.site = lw.site"""


@register("history", "harvest")
def _():
    return HARVEST_CLEAN + """
select site, year, trees, harvest_kg, oil,
       case when harvest_kg is not null and harvest_kg <> 0 and oil is not null and oil <> 0
              then round_even(round_even(oil / harvest_kg * 100e0, 9), 1)
            when ratio is not null and ratio <> 0 then round_even(round_even(ratio * 100e0, 9), 1)
            else ratio end as ratio,
       min(year) over (partition by site) as start_year, max(year) over (partition by site) as end_year
from hc"""


@register("history_legacy", "harvest")
def _():
    return """
, hl as (select site, cast(year as int) as year, trees, harvest_kg, oil, ratio from harvest
         where site is not null and year is not null and trees is not null and harvest_kg is not null
           and oil is not null and ratio is not null)
select *, min(year) over (partition by site) as start_year, max(year) over (partition by site) as end_year,
       count(*) over (partition by site) as count
from hl"""


@register("weather_summary", "weather_daily")
def _():
    return """
, wy as (
  select site, cast(year(obs_date) as int) as year, round_even(avg(avg_temp), 9) as Avg_Temp,
         round_even(avg(max_temp), 9) as Max_Temp, round_even(avg(min_temp), 9) as Min_Temp,
         round_even(coalesce(sum(rain), 0e0), 9) as Rain, round_even(avg(clouds), 9) as Clouds
  from weather_daily group by site, cast(year(obs_date) as int))
, last_n as (select * from (select *, row_number() over (partition by site order by year desc) as rk from wy) where rk <= 5)
select site, year, Avg_Temp, Max_Temp, Min_Temp, Rain, Clouds,
       min(year) over (partition by site) as start_year, max(year) over (partition by site) as end_year,
       count(*) over (partition by site) as count
from last_n"""


@register("latest_year_weather", "weather_daily")
def _():
    return LATEST_WEATHER + "\nselect * from lw"


@register("history_average", "harvest")
def _():
    return HARVEST_CLEAN + """
select site, round_even(avg(harvest_kg), 9) as mean_harvest, round_even(avg(oil), 9) as mean_oil,
       round_even(round_even(avg(harvest_kg), 9), 0) as harvest_kg, round_even(round_even(avg(oil), 9), 0) as oil_kg,
       min(year) as start_year, max(year) as end_year, count(*) as count, round_even(avg(ratio), 9) as mean_ratio
from hc group by site"""


# ---------------------------------------------------------------------------
# step 7: ingestion (computed from the source rows, not from the JSON)
# ---------------------------------------------------------------------------

def _hourly_rows(src: str) -> str:
    return f"""
, hrs(h) as (values (0), (6), (12), (18))
, hourly as (
  select w.site, w.obs_date, cast(w.obs_date as timestamp) + to_hours(h) as obs_ts, h,
         cast(year(w.obs_date) as int) as year, cast(month(w.obs_date) as int) as month,
         w.avg_temp + (h - 9) / 3e0 as avg_temp, w.max_temp, w.min_temp,
         coalesce(w.rain / 4e0, 0e0) as rain, w.max_wind, w.avg_wind,
         case when month(w.obs_date) = 12 then null else w.avg_gust end as avg_gust,
         coalesce(w.sun_hours * 900e0, 0e0) / 3600e0 as sun_hours, w.clouds,
         coalesce(w.snow / 4e0, 0e0) as snow, 1013e0 as pressure
  from {src} w cross join hrs)"""


@register("payload_hourly", "weather_daily")
def _():
    return _hourly_rows("weather_daily") + """
select site, obs_date, obs_ts, year, month, avg_temp, max_temp, min_temp, rain, max_wind, avg_wind, avg_gust,
       sun_hours, clouds, snow, pressure
from hourly"""


@register("payload_daily", "weather_daily")
def _():
    return """
select site, obs_date, avg_temp, max_temp, min_temp, coalesce(rain, 0e0) as rain, clouds,
       100e0 - coalesce(nullif(clouds, 0e0), 50e0) as humidity, cast(month(obs_date) as int) as month
from weather_daily"""


@register("payload_current", "weather_daily")
def _():
    return """
, resp as (
  select r_name as site, cast(floor(epoch(cast(ts as timestamp))) as bigint) as dt, event_type <> 'error' as ok,
         case when event_type = 'error' then 'Invalid API key' end as message,
         round_even(round_even(value, 9), 1) as temperature,
         cast(trunc(cast(json_extract_string(props, '$.k') as double)) as int) as humidity,
         cast(cast(trunc(cast(json_extract_string(props, '$.k') as double)) as int) as double) as clouds,
         round_even(round_even(coalesce(case when event_type = 'click' then value / 10e0 end,
                                        case when event_type = 'view' then value / 5e0 end, 0e0), 9), 1) as rain,
         round_even(round_even(value / 2e0, 9), 1) as wind
  from events join region on events.user_id % 5 = r_regionkey)
, newest as (
  select * from (select *, row_number() over (partition by site order by dt desc, ok desc, temperature desc,
         humidity desc, clouds desc, rain desc, wind desc, message desc nulls last) as rk from resp) where rk = 1)
, stored as (
  select site, max(obs_date) as obs_date, arg_max(avg_temp, obs_date) as f_avg_temp,
         arg_max(clouds, obs_date) as f_clouds, arg_max(rain, obs_date) as f_rain,
         arg_max(avg_wind, obs_date) as f_avg_wind
  from weather_daily group by site)
select coalesce(n.site, s.site) as site,
       case when coalesce(n.ok, false) then 'api' when s.obs_date is not null then 'file' end as source,
       case when coalesce(n.ok, false) then cast(n.dt as varchar)
            when s.obs_date is not null then strftime(s.obs_date, '%Y-%m-%d') end as date,
       case when coalesce(n.ok, false) then n.temperature
            when s.obs_date is not null then round_even(round_even(s.f_avg_temp, 9), 1) end as temperature,
       case when coalesce(n.ok, false) then n.humidity when s.obs_date is not null then 0 end as humidity,
       case when coalesce(n.ok, false) then n.clouds
            when s.obs_date is not null then round_even(round_even(s.f_clouds, 9), 1) end as clouds,
       case when coalesce(n.ok, false) then n.rain
            when s.obs_date is not null then round_even(round_even(s.f_rain, 9), 1) end as rain,
       case when coalesce(n.ok, false) then n.wind
            when s.obs_date is not null then round_even(round_even(coalesce(s.f_avg_wind, 0e0), 9), 1) end as wind,
       case when coalesce(n.ok, false) then cast(n.dt as varchar)
            when s.obs_date is not null then strftime(s.obs_date, '%Y-%m-%d') || ' (file)' end as updated,
       case when not coalesce(n.ok, false) and s.obs_date is null then coalesce(n.message, 'no data') end as error
from newest n full outer join stored s on n.site = s.site"""


SCENARIO = """
, mx as (select site, max(obs_date) as mx from weather_daily group by site)
, store as (select w.* from weather_daily w join mx on w.site = mx.site where w.obs_date <= mx.mx - 69)
, recent as (select w.* from weather_daily w join mx on w.site = mx.site where w.obs_date > mx.mx - 99)"""

STORE_COLS = "site, obs_date, avg_temp, max_temp, min_temp, rain, clouds, sun_hours, max_wind, avg_wind, avg_gust, snow, pressure"


@register("merge_keep_first", "weather_daily")
def _():
    return SCENARIO + _hourly_rows("recent") + f"""
, first_hour as (select * from hourly where h = 0)
, fresh as (select f.* from first_hour f where not exists (
    select 1 from store s where s.site = f.site and s.obs_date = f.obs_date))
select {STORE_COLS} from store
union all
select {STORE_COLS} from fresh"""


@register("daily_rollup", "weather_daily")
def _():
    return _hourly_rows("weather_daily") + """
select site, obs_date, round_even(avg(avg_temp), 9) as avg_temp, max(max_temp) as max_temp, min(min_temp) as min_temp,
       round_even(coalesce(sum(rain), 0e0), 9) as rain, max(max_wind) as max_wind,
       round_even(avg(avg_wind), 9) as avg_wind, max(avg_gust) as avg_gust,
       round_even(coalesce(sum(sun_hours), 0e0), 9) as sun_hours, round_even(avg(clouds), 9) as clouds,
       round_even(coalesce(sum(snow), 0e0), 9) as snow, max(pressure) as pressure, count(*) as n_readings
from hourly group by site, obs_date"""


@register("ingest_report", "weather_daily")
def _():
    return SCENARIO + _hourly_rows("recent") + """
, fresh as (select f.* from hourly f where h = 0 and not exists (
    select 1 from store s where s.site = f.site and s.obs_date = f.obs_date))
, added as (select site, count(*) as n from fresh group by site)
, b as (select site, count(*) as rows_in, arg_max(obs_date, obs_ts) as d, arg_max(avg_temp, obs_ts) as t,
               arg_max(clouds, obs_ts) as c from hourly group by site)
select b.site, rows_in, coalesce(a.n, 0) as rows_added, strftime(d, '%Y-%m-%d') as last_update,
       round_even(round_even(t, 9), 1) as last_temp, round_even(round_even(c, 9), 1) as last_clouds
from b left join added a on a.site = b.site"""


# ---------------------------------------------------------------------------
# step 8: streaming (the batch SQL of the same result)
# ---------------------------------------------------------------------------

@register("stream_ingest", "weather_daily")
def _():
    return SCENARIO + _hourly_rows("recent") + f"""
, first_hour as (select * from hourly where h = 0)
, fresh as (select f.* from first_hour f where not exists (
    select 1 from store s where s.site = f.site and s.obs_date = f.obs_date))
select {STORE_COLS} from store
union all
select {STORE_COLS} from fresh"""


@register("store_first_write", "weather_daily")
def _():
    return SCENARIO + _hourly_rows("recent") + f"""
select {STORE_COLS} from hourly where h = 0"""


@register("weather_csv", "weather_daily")
def _():
    return f"select {STORE_COLS} from weather_daily"


@register("stream_risk", "weather_daily")
def _():
    return WX + """
, days as (select site, cast(unnest(generate_series(min(obs_date), max(obs_date), interval 1 day)) as date) as d
           from wx group by site)
, twin as (
  select d.site, d.d as obs_date, cast(month(d.d) as int) as month, count(*) as n_rows,
         avg(w.avg_temp) as avg_temp, coalesce(sum(w.rain), 0e0) as total_rain, avg(w.humidity) as avg_humidity,
         count(case when w.rain > 0.5e0 then 1 end) as rainy_days
  from days d join wx w on w.site = d.site and w.obs_date between d.d - 29 and d.d
  group by d.site, d.d)""" + RULES + _scored("twin") + """
, counts as (
  select site, obs_date, any_value(avg_temp) as avg_temp, any_value(total_rain) as total_rain,
         any_value(avg_humidity) as avg_humidity, any_value(rainy_days) as rainy_days,
         cast(count_if(risk_label = 'HIGH') as int) as n_high,
         cast(count_if(risk_label = 'MODERATE') as int) as n_moderate,
         cast(count_if(risk_label = 'LOW') as int) as n_low
  from labelled group by site, obs_date)
select site, obs_date,
       round_even(round_even(avg_temp, 9), 1) as avg_temperature,
       round_even(round_even(total_rain, 9), 1) as total_rain_30d,
       round_even(round_even(avg_humidity, 9), 1) as avg_humidity_estimate,
       cast(rainy_days as int) as rainy_days_30d, n_high, n_moderate, n_low,
       case when n_high >= 3 then 'HIGH' when n_high >= 1 or n_moderate >= 3 then 'MODERATE' else 'LOW' end
         as overall_risk
from counts"""


@register("stream_latest")
def _():
    return """
with rd as (
  select r_name as site, event_id, cast(ts as timestamp) as obs_ts, value as reading,
         cast(json_extract_string(props, '$.k') as int) as k
  from events join region on events.user_id % 5 = r_regionkey)
select site, obs_ts, event_id, reading, k from (
  select *, row_number() over (partition by site order by obs_ts desc, event_id desc, reading desc, k desc) as rk
  from rd) where rk = 1"""


# ---------------------------------------------------------------------------
# step 9: regression check (the ML fit itself has no SQL form)
# ---------------------------------------------------------------------------

@register("regr_check", "weather_daily", "harvest")
def _():
    c = _cond("month", 1)
    return HARVEST_CLEAN + f"""
, rj as (select site, cast(year(obs_date) as int) as year, {_r9(_psum(c, 'rain'))} as Rain_Jan
         from weather_daily group by site, cast(year(obs_date) as int))
, tr as (select rj.site, rj.Rain_Jan, hc.harvest_kg as label from rj join hc on hc.site = rj.site and hc.year - 1 = rj.year)
select site, cast(regr_count(label, Rain_Jan) as bigint) as n, round_even(regr_slope(label, Rain_Jan), 6) as slope,
       round_even(regr_intercept(label, Rain_Jan), 6) as intercept, round_even(regr_r2(label, Rain_Jan), 6) as r2
from tr group by site"""


@register("weather_years", "weather_daily")
def _():
    return "select distinct site, cast(year(obs_date) as int) as year from weather_daily"


@register("disease_report", "weather_daily", "harvest")
def _():
    return HARVEST_CLEAN + """
, pd as (select site, obs_date, avg_temp, coalesce(rain, 0e0) as rain, clouds,
                100e0 - coalesce(nullif(clouds, 0e0), 50e0) as humidity from weather_daily)
, head as (
  select site, round_even(round_even(avg(avg_temp), 9), 1) as avg_temperature,
         round_even(round_even(coalesce(sum(rain), 0e0), 9), 1) as total_rain_30d,
         round_even(round_even(avg(humidity), 9), 1) as avg_humidity_estimate,
         cast(count(case when rain > 0.5e0 then 1 end) as int) as rainy_days_30d
  from pd group by site)
, ranked as (select *, row_number() over (partition by site order by obs_date desc) as rk from pd)
, last30 as (
  select site, max(obs_date) as obs_date, cast(month(max(obs_date)) as int) as month,
         avg(avg_temp) as avg_temp, coalesce(sum(rain), 0e0) as total_rain, avg(humidity) as avg_humidity,
         count(case when rain > 0.5e0 then 1 end) as rainy_days
  from ranked where rk <= 30 group by site)""" + RULES + _scored("last30") + """
, counts as (
  select site, obs_date,
         cast(count_if(risk_label = 'HIGH') as int) as n_high,
         cast(count_if(risk_label = 'MODERATE') as int) as n_moderate,
         cast(count_if(risk_label = 'LOW') as int) as n_low
  from labelled group by site, obs_date)
, sites as (select distinct site from hc)
select s.site, h.avg_temperature, h.total_rain_30d, h.avg_humidity_estimate, h.rainy_days_30d,
       c.obs_date, c.n_high, c.n_moderate, c.n_low,
       case when c.site is null then null when c.n_high >= 3 then 'HIGH'
            when c.n_high >= 1 or c.n_moderate >= 3 then 'MODERATE' else 'LOW' end as overall_risk,
       case when c.obs_date is null then 'No weather data available' end as error,
       l.disease, l.name, cast(least(100, l.score) as int) as risk_level, l.risk_label, l.description,
       case when l.score >= 50 then l.rec1_hi else l.rec1_lo end || '|' || l.rec2 || '|' || l.rec3 as recommendations,
       l.best_treatment_time
from sites s left join head h on h.site = s.site left join counts c on c.site = s.site
     left join labelled l on l.site = s.site"""


@register("fit_coefficients", "weather_daily", "harvest")
def _():
    c1, c9, c10 = _cond("month", 1), _cond("month", 9), _cond("month", 10)
    return HARVEST_CLEAN + f"""
, sy as (select site, cast(year(obs_date) as int) as year,
                {_r9(_psum(c1, 'rain'))} as Rain_Jan,
                {_r9(f'avg(clouds) filter (where {c9})')} as Clouds_Sep,
                {_r9(f'avg(clouds) filter (where {c10})')} as Clouds_Oct
         from weather_daily group by site, cast(year(obs_date) as int))
, f as (select coalesce(Rain_Jan, 0e0) as x1, coalesce(Clouds_Sep, 0e0) as x2, coalesce(Clouds_Oct, 0e0) as x3,
               hc.harvest_kg as y
        from sy join hc on hc.site = sy.site and hc.year - 1 = sy.year)
, m as (select avg(x1) as m1, avg(x2) as m2, avg(x3) as m3, avg(y) as my,
               stddev_pop(x1) as s1, stddev_pop(x2) as s2, stddev_pop(x3) as s3,
               corr(x1, x2) as a, corr(x1, x3) as b, corr(x2, x3) as c,
               covar_pop(x1, y) / stddev_pop(x1) as g1, covar_pop(x2, y) / stddev_pop(x2) as g2,
               covar_pop(x3, y) / stddev_pop(x3) as g3
        from f)
, inv as (select *, 1 + 2 * a * b * c - a * a - b * b - c * c as det from m)
, coef as (
  select *,
         ((1 - c * c) * g1 + (b * c - a) * g2 + (a * c - b) * g3) / det as k1,
         ((b * c - a) * g1 + (1 - b * b) * g2 + (a * b - c) * g3) / det as k2,
         ((a * c - b) * g1 + (a * b - c) * g2 + (1 - a * a) * g3) / det as k3
  from inv)
select 'fitted' as model, 'lin' as member, feature, round_even(mean, 6) as mean, round_even(scale, 6) as scale,
       round_even(coef, 6) as coef, round_even(my, 6) as intercept
from (select 'Rain_Jan' as feature, m1 as mean, s1 as scale, k1 as coef, my from coef
      union all select 'Clouds_Sep', m2, s2, k2, my from coef
      union all select 'Clouds_Oct', m3, s3, k3, my from coef)"""
