"""DuckDB oracle SQL for every registered query.

Each query is plain SQL over the driver tables.  The fixture views
(``weather_daily``, ``harvest`` and the literal model tables) are CTEs put in
front of every statement, so each string runs on its own against the
pre-registered parquet views.
"""

from __future__ import annotations

WEATHER_DAILY = """
wx_base as (
  select r_name as site, cast(l_shipdate as date) as obs_date, month(l_shipdate) as m, day(l_shipdate) as dd,
         cast(count(*) as double) as n,
         cast(sum(cast(l_quantity as bigint)) as double) as q,
         cast(max(l_quantity) as double) as qx, cast(min(l_quantity) as double) as qn,
         cast(sum(cast(round(l_tax * 100) as bigint)) as double) as tx,
         cast(sum(cast(round(l_discount * 100) as bigint)) as double) as ds,
         cast(max(cast(round(l_discount * 100) as bigint)) as double) as dx
  from lineitem join supplier on l_suppkey = s_suppkey join nation on s_nationkey = n_nationkey
       join region on n_regionkey = r_regionkey
  group by r_name, cast(l_shipdate as date), month(l_shipdate), day(l_shipdate)),
wx_t as (select *, cast(abs(m - 7) as double) as k from wx_base),
weather_daily as (
select site, obs_date,
  floor((27e0 - 3.5e0 * k + (q / n - 25.5e0) * 0.4e0) * 100e0 + 0.5e0) / 100e0 as avg_temp,
  floor((27e0 - 3.5e0 * k + (qx - 25.5e0) * 0.4e0) * 100e0 + 0.5e0) / 100e0 as max_temp,
  floor((27e0 - 3.5e0 * k + (qn - 25.5e0) * 0.4e0) * 100e0 + 0.5e0) / 100e0 as min_temp,
  case when dd = 17 then null else floor(greatest(0e0, (tx / n - 4e0) * 4e0 * (1e0 + k / 6e0)) * 100e0 + 0.5e0) / 100e0 end as rain,
  case when dd = 13 then null else floor(least(100e0, ds / n * 3e0 + 10e0 * k) * 100e0 + 0.5e0) / 100e0 end as clouds,
  floor((14e0 - ds / n * 0.3e0 - k) * 100e0 + 0.5e0) / 100e0 as sun_hours,
  dx * 3e0 as max_wind,
  floor(ds / n * 3e0 * 100e0 + 0.5e0) / 100e0 as avg_wind,
  dx * 4e0 as avg_gust,
  case when m in (12, 1, 2) then floor(tx / n * 20e0 + 0.5e0) / 100e0 else 0e0 end as snow,
  1013e0 as pressure
from wx_t)"""

HARVEST = """
hv_o as (
  select r_name as site, cast(year(o_orderdate) as int) as year, o_custkey,
         cast(round(o_totalprice * 100) as bigint) as cents,
         case when o_orderpriority = '1-URGENT' then cast(round(o_totalprice * 100) as bigint) else 0 end as oil_cents
  from orders join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey
       join region on n_regionkey = r_regionkey),
harvest as (
select site, year, cast(count(distinct o_custkey) as double) as trees,
  floor(cast(sum(cents) as double) / 1e6 + 0.5e0) / 10e0 as harvest_kg,
  floor(cast(sum(oil_cents) as double) / 1e6 + 0.5e0) / 10e0 as oil,
  floor(cast(sum(cents) as double) / cast(sum(oil_cents) as double) * 1e6 + 0.5e0) / 1e6 as ratio
from hv_o group by site, year)"""

MODEL_FEATURE = """
model_feature(model, member, feature, mean, scale, coef) as (values
  ('simple', 'lin', 'Rain_Jan', 60e0, 30e0, 250e0),
  ('simple', 'lin', 'Clouds_Sep', 35e0, 10e0, -180e0),
  ('simple', 'lin', 'Clouds_Oct', 45e0, 10e0, 120e0),
  ('complex', 'a', 'Rain_winter', 180e0, 60e0, 200e0),
  ('complex', 'a', 'Temp_spring', 16e0, 4e0, -150e0),
  ('complex', 'b', 'Clouds', 45e0, 10e0, -300e0),
  ('complex', 'b', 'Sun_Hours', 2700e0, 600e0, 400e0),
  ('complex', 'b', 'Missing_Feature', 0e0, 1e0, 10e0),
  ('legacy', 'a', 'Rain_winter', 180e0, 60e0, 200e0),
  ('legacy', 'b', 'Max_Wind_M3', 25e0, 5e0, 90e0),
  ('legacy', 'b', 'Temp_Spread_yearly', 12e0, 6e0, -110e0))"""

MODEL_META = """
model_meta(model, member, name, description, intercept, oil_factor, cv_mae, adj_r2) as (values
  ('simple', 'lin', 'Statistical Model (Simple)', 'Best statistical model (R²=0.69, p=0.00003)', 950e0, 0.15e0, 300e0, 0.69e0),
  ('complex', 'a', 'ML Ensemble (Complex)', 'Ensemble of trained regressors', 900e0, 0.23e0, cast(null as double), cast(null as double)),
  ('complex', 'b', 'ML Ensemble (Complex)', 'Ensemble of trained regressors', -350e0, 0.23e0, cast(null as double), cast(null as double)),
  ('legacy', 'a', 'Legacy Ensemble', 'Ensemble on legacy features', 900e0, cast(null as double), cast(null as double), cast(null as double)),
  ('legacy', 'b', 'Legacy Ensemble', 'Ensemble on legacy features', 1200e0, cast(null as double), cast(null as double), cast(null as double)))"""

FEATURE_IMPORTANCE = """
feature_importance(model, rank, feature, importance) as (values
  ('legacy', 1, 'Rain_winter', 0.41e0),
  ('legacy', 2, 'Temp_Spread_yearly', 0.33e0),
  ('legacy', 3, 'Max_Wind_M3', 0.26e0),
  ('complex', 1, 'Sun_Hours', 0.38e0),
  ('complex', 2, 'Clouds', 0.27e0),
  ('complex', 3, 'Rain_winter', 0.2e0),
  ('complex', 4, 'Temp_spring', 0.15e0))"""

# the weather without the September rows of each site's latest year
NO_SEPTEMBER = WEATHER_DAILY.replace("weather_daily as (", "weather_full as (") + """,
weather_daily as (
select w.* from weather_full w join (select site, max(year(obs_date)) as last_year from weather_full group by site) l on w.site = l.site
where not (year(obs_date) = last_year and month(obs_date) = 9))"""

CTES = {"no_september": NO_SEPTEMBER, "weather_daily": WEATHER_DAILY, "harvest": HARVEST, "model_feature": MODEL_FEATURE,
        "model_meta": MODEL_META, "feature_importance": FEATURE_IMPORTANCE}


def with_views(body: str, *views: str, recursive: bool = False) -> str:
    """Prefix ``body`` (which may start with its own ``with``-less CTE list
    continuation ``, x as (...)``) with the named fixture CTEs."""
    body = body.strip()
    if not views:
        return body + "\n"
    head = ("with recursive " if recursive else "with ") + ",\n".join(CTES[v].strip() for v in views)
    if body.startswith(","):
        return head + body + "\n"
    return head + "\n" + body + "\n"


SQL: dict[str, str] = {}

DEC = "decimal(28, 9)"


def _close(text: str, i: int) -> int:
    """Index just past the parenthesis that closes the one opened at i."""
    depth = 0
    for j in range(i, len(text)):
        if text[j] == "(":
            depth += 1
        elif text[j] == ")":
            depth -= 1
            if depth == 0:
                return j + 1
    raise ValueError("unbalanced parentheses")


def _suffix(text: str, i: int) -> int:
    """Extent of a following ``filter (where ...)`` and/or ``over w`` /
    ``over (...)`` clause."""
    j = i
    while True:
        rest = text[j:]
        stripped = rest.lstrip()
        k = j + len(rest) - len(stripped)
        low = stripped.lower()
        if low.startswith("filter") and low[6:].lstrip().startswith("("):
            par = k + 6 + (len(stripped[6:]) - len(stripped[6:].lstrip()))
            j = _close(text, par)
        elif low.startswith("over") and low[4:].lstrip().startswith("("):
            par = k + 4 + (len(stripped[4:]) - len(stripped[4:].lstrip()))
            j = _close(text, par)
        elif low.startswith("over ") and low[5:].lstrip()[:1].isalpha():
            m = k + 5 + (len(stripped[5:]) - len(stripped[5:].lstrip()))
            e = m
            while e < len(text) and (text[e].isalnum() or text[e] == "_"):
                e += 1
            j = e
        else:
            return j


def exactify(sql: str) -> str:
    """Rewrite every ``sum(x)`` / ``avg(x)`` (with optional FILTER / OVER)
    into an exact DECIMAL accumulation converted to double, the same
    arithmetic the Spark operators use."""
    out, i = [], 0
    low = sql.lower()
    while i < len(sql):
        hit = None
        for fn in ("sum(", "avg("):
            k = low.find(fn, i)
            if k != -1 and (k == 0 or not (sql[k - 1].isalnum() or sql[k - 1] == "_")):
                if hit is None or k < hit[0]:
                    hit = (k, fn[:-1])
        if hit is None:
            out.append(sql[i:])
            break
        k, fn = hit
        end = _close(sql, k + 3)
        arg = exactify(sql[k + 4:end - 1])
        suf_end = _suffix(sql, end)
        suffix = sql[end:suf_end]
        total = f"cast(sum(cast({arg} as {DEC})){suffix} as double)"
        if fn == "avg":
            total = f"({total} / count({arg}){suffix})"
        out.append(sql[i:k])
        out.append(total)
        i = suf_end
    return "".join(out)


def zero_sign(sql: str) -> str:
    """Wrap every ``round_even(...)`` as ``(round_even(...) + 0e0)``: DuckDB
    rounds small negatives to -0.0, Spark's ``bround`` to 0.0."""
    out, i, key = [], 0, "round_even("
    while True:
        k = sql.find(key, i)
        if k == -1:
            out.append(sql[i:])
            return "".join(out)
        end = _close(sql, k + len(key) - 1)
        out.append(sql[i:k])
        inner = sql[k + len(key):end - 1]
        out.append(f"(round_even({zero_sign(inner)}) + 0e0)")
        i = end


def register(name: str, *views: str, recursive: bool = False):
    def deco(fn):
        SQL[name] = with_views(zero_sign(exactify(fn())), *views, recursive=recursive)
        return fn
    return deco
