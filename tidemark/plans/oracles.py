"""The catalog's queries in DuckDB SQL."""

from __future__ import annotations


def key(c: str) -> str:
    return f"substr(sha256(upper(trim({c}))), 1, 16)"


COMPANIES = """companies as (
  select s_suppkey as supplier, s_name as ticker, s_name as company_name,
    case s_nationkey % 4 when 0 then 'HOSE' when 1 then 'HNX' when 2 then 'UPCOM' else 'OTHER' end as exchange, r_name as sector
  from supplier join nation on s_nationkey = n_nationkey join region on n_regionkey = r_regionkey)"""

STATEMENTS = """sums as (
  select l_suppkey as supplier, year(l_shipdate) as fiscal_year, quarter(l_shipdate) as fiscal_quarter,
    sum(p) as ta, coalesce(sum(p) filter (l_returnflag <> 'A'), 0) as tl, coalesce(sum(p) filter (l_linestatus = 'O'), 0) as ca,
    coalesce(sum(p) filter (l_returnflag = 'R'), 0) as cl, coalesce(sum(p) filter (l_returnflag = 'N' and l_linestatus = 'O'), 0) as no,
    sum(p * (d - 0.04::decimal(4,2))) as ebit, sum(p * t) as interest, sum(p * (d - 0.05::decimal(4,2))) as ni, sum(p * (t - 0.03::decimal(4,2))) as re
  from (select *, l_extendedprice::decimal(18,2) as p, l_discount::decimal(4,2) as d, l_tax::decimal(4,2) as t from lineitem) group by all),
statements as (
  select supplier, 'Supplier#' || lpad(supplier::varchar, 9, '0') as ticker, fiscal_year::varchar || 'Q' || fiscal_quarter::varchar as report_period,
    fiscal_year, fiscal_quarter, ta::double as total_assets, tl::double as total_liabilities, ca::double as current_assets, cl::double as current_liabilities,
    (ta - tl - no)::double as equity, ebit::double as ebit, interest::double as interest_expense, ni::double as net_income, re::double as retained_earnings
  from sums)"""

RAW = f"""{COMPANIES}, {STATEMENTS},
raw as (
  select case when k % 31 <> 0 then ticker end as ticker, case when k % 37 = 0 then '  ' else report_period end as report_period,
    case when k % 41 = 0 then 'n/a' else fiscal_year::varchar end as fiscal_year, total_assets::decimal(18,2)::varchar as total_assets,
    case when k % 5 = 0 then '' else net_income::decimal(18,4)::varchar end as net_income, exchange,
    case when k % 3 = 0 then 'YES' when k % 3 = 1 then '0' when k % 43 = 0 then 'maybe' end as audited
  from (select s.*, c.exchange, s.supplier + fiscal_year + fiscal_quarter as k from statements s join companies c on s.supplier = c.supplier)),
judged as (
  select *, concat_ws('; ',
    case when ticker is null then 'ticker: required' end, case when trim(report_period) = '' then 'report_period: required' end,
    case when try_cast(fiscal_year as bigint) is null then 'fiscal_year: not integer' end,
    case when exchange not in ('HOSE', 'HNX', 'UPCOM') then 'exchange: not allowed' end,
    case when audited = 'maybe' then 'audited: not boolean' end) as failure_reason
  from raw),
valid as (
  select ticker, report_period, fiscal_year::bigint as fiscal_year, total_assets::double as total_assets, nullif(net_income, '')::double as net_income, exchange,
    case audited when 'YES' then true when '0' then false end as audited
  from judged where failure_reason = '')"""

PRICES = """prices as (
  select 'U' || user_id::varchar as ticker, ts::date as trading_date, arg_max(value, (ts, event_id)) as close_price, count(*) as volume from events group by all),
price_facts as (
  select *, case when before <> 0 then (close_price - before) / before end as daily_return
  from (select *, lag(close_price) over (partition by ticker order by trading_date) as before from prices))"""

SNAPSHOTS = f"""snapshots as (
  select upper(c_name) as ticker, o_orderstatus as status, o_orderpriority as priority, c_mktsegment as segment, o_orderdate as created_ts, o_orderkey as seq
  from orders join customer on o_custkey = c_custkey),
marked as (
  select *, lag(seq) over w is null as is_first, (lag(status) over w, lag(priority) over w, lag(segment) over w) is distinct from (status, priority, segment) as changed
  from snapshots window w as (partition by ticker order by created_ts, seq)),
versions as (
  select {key("ticker")} as company_key, substr(sha256(upper(trim(ticker)) || '|' || upper(strftime(created_ts, '%Y-%m-%dT%H:%M:%S') || case when microsecond(created_ts) % 1000000 > 0 then '.' || lpad((microsecond(created_ts) % 1000000)::varchar, 6, '0') else '' end || '+00:00')), 1, 16) as version_key,
    ticker, status, priority, segment, created_ts as valid_from_ts, lead(created_ts) over w as valid_to_ts, lead(seq) over w is null as is_current, seq
  from marked where is_first or changed window w as (partition by ticker order by created_ts, seq))"""

PREVIOUS = """previous as (
  select *, case when fiscal_year * 4 + fiscal_quarter - lag(fiscal_year * 4 + fiscal_quarter) over w = 1 then lag(net_income) over w end as previous_net_income
  from {0} window w as (partition by ticker order by report_period))"""

FLAGS = """coalesce(total_assets > 0 and total_liabilities / nullif(total_assets, 0) > 0.8, false) as high_debt_to_asset,
    coalesce(equity < 0, false) as negative_equity, coalesce(net_income < 0 and previous_net_income < 0, false) as two_quarter_net_loss,
    coalesce(current_liabilities > 0 and current_assets / nullif(current_liabilities, 0) < 1, false) as low_current_ratio,
    coalesce(interest_expense > 0 and ebit / nullif(interest_expense, 0) < 1, false) as weak_interest_coverage"""

LABELLED = f"""{STATEMENTS},
mutated as (
  select * replace (case when supplier % 9 <> 1 then retained_earnings end as retained_earnings, case when supplier % 11 = 2 then 0.0 else total_liabilities end as total_liabilities),
    supplier % 10 = 0 as financial from statements),
{PREVIOUS.format("mutated")},
scored as (
  select *, case when not financial and total_assets > 0 then round(
      6.56 * ((current_assets - current_liabilities) / total_assets) + 3.26 * (retained_earnings / total_assets) + 6.72 * (ebit / total_assets)
      + 1.05 * (case when total_liabilities = 0 then 99.0 when total_liabilities > 0 then equity / total_liabilities end), 4) end as z_score, {FLAGS}
  from previous),
counted as (
  select *, list_filter([case when high_debt_to_asset then 'high_debt_to_asset' end, case when low_current_ratio then 'low_current_ratio' end,
      case when negative_equity then 'negative_equity' end, case when two_quarter_net_loss then 'two_quarter_net_loss' end,
      case when weak_interest_coverage then 'weak_interest_coverage' end], lambda x: x is not null) as warnings from scored),
labelled as (
  select *, len(warnings) as n_warnings,
    case when financial then null when z_score is null and len(warnings) >= 2 then 1 when z_score is null then null when z_score < 1.1 or len(warnings) >= 2 then 1 else 0 end as distress_label,
    case when financial then 'financial_sector_excluded' else array_to_string(list_filter(warnings || [
      case when z_score is null and len(warnings) >= 2 then 'z_score_null' when z_score is null then 'insufficient_data' when z_score < 1.1 then 'z_score_distress_zone'
        when len(warnings) >= 2 then null when z_score > 2.6 then 'z_score_safe_zone' else 'gray_zone_monitor' end,
      case when total_liabilities = 0 and z_score is not null then 'zero_liabilities_x4_capped' end], lambda x: x is not null), ';') end as distress_reason,
    case when financial then null when z_score is null and len(warnings) >= 2 then 'medium' when z_score is null then null when z_score < 1.1 then 'high'
      when len(warnings) >= 2 then 'medium' when z_score > 2.6 then 'high' else 'low' end as label_confidence,
    not financial and coalesce(z_score < 1.1 or len(warnings) >= 2 or z_score > 2.6, len(warnings) >= 2) as training_eligible
  from counted)"""

REPORT = f"""with {COMPANIES}, latest as (
  select * from lineitem qualify row_number() over (partition by l_orderkey, l_linenumber order by l_shipdate desc nulls last, l_partkey desc, l_suppkey desc) = 1)
select sector, count(distinct supplier) as company_count, count(*) as statement_count, count(distinct (l_orderkey, l_linenumber)) as record_count,
  sum(l_extendedprice::decimal(18,2))::double as total_assets
from latest join companies on l_suppkey = supplier group by sector"""

LATEST = """select l_orderkey, l_linenumber, l_partkey, l_suppkey, l_shipdate from lineitem
qualify row_number() over (partition by l_orderkey, l_linenumber order by l_shipdate desc nulls last, l_partkey desc, l_suppkey desc) = 1"""

ASOF = """select p.event_id, p.user_id, p.ts, v.event_id as feature_event_id, v.ts as feature_ts, v.value as feature_value
from (select * from events where event_type = 'purchase') p asof left join (
  select * from events where event_type = 'view' qualify row_number() over (partition by user_id, ts order by event_id desc) = 1) v
on p.user_id = v.user_id and p.ts >= v.ts"""

REFERENCE = """reference as (
  select event_id, 'U' || user_id::varchar as ticker, case when event_id % 20 = 0 then ts + interval 1 day else ts end as reference_ts from events)"""

TICKS = """base as (
  select event_id as id, event_id * 2 as seq, floor(epoch(ts))::bigint - case when event_id % 7 = 0 then event_id * 997 % 20000 else 0 end as ts,
    'U' || user_id::varchar as ticker, case when event_id % 101 <> 0 then value end as price, 1 as volume from events),
ticks as (select * from base union all select id, seq + 1, ts, ticker, price, volume from base where id % 66 = 0)"""


def routed(dedup: bool) -> str:
    dup = "valid and row_number() over (partition by valid, id order by seq) > 1" if dedup else "false"
    return f"""{TICKS},
flagged as (select *, {dup} as dup from (select *, price is not null as valid from ticks)),
topped as (select *, max(case when valid and not dup then ts end) over (order by seq rows between unbounded preceding and 1 preceding) as top from flagged),
routed as (
  select *, greatest(coalesce(top, ts), ts) - 7200 as mark,
    case when not valid then 'invalid' when dup then 'duplicate' when ts + 10800 < greatest(coalesce(top, ts), ts) - 7200 then 'too_late'
      when ts < greatest(coalesce(top, ts), ts) - 7200 then 'allowed_late' else 'on_time' end as route from topped)"""


def check(dataset: str, name: str, metric: str, source: str, severity: str = "critical", bad: str = "m > 0", limit: str = "0.0") -> str:
    failing = "fail" if severity == "critical" else "warning"
    return f"""select '{dataset}' as dataset_name, '{name}' as check_name, case when {bad} then '{failing}' else 'pass' end as status, '{severity}' as severity,
  m::double as metric_value, {limit}::double as threshold_value from (select {metric} as m from {source})"""


CHECKS = {
    "dq_not_null": f"with {RAW} " + check("statements", "not_null:ticker", "count(*) filter (ticker is null)", "raw"),
    "dq_unique": check("lineitem", "unique:l_orderkey,l_linenumber", "coalesce(sum(n - 1), 0)", "(select count(*) as n from lineitem group by l_orderkey, l_linenumber)"),
    "dq_referential": check("orders", "referential:o_custkey", "count(*)", "(select case when o_orderkey % 100 = 0 then -1 else o_custkey end as k from orders) where k is null or k not in (select c_custkey from customer)"),
    "dq_range": check("lineitem", "range:l_discount", "count(*) filter (l_discount not between 0.0 and 0.09)", "lineitem"),
    "dq_retention": check("lineitem", "retention", "(select count(*) from (select distinct l_orderkey, l_linenumber from lineitem)) / (select count(*) from lineitem)", "range(1)", "warning", "m < 0.8", "0.8"),
    "dq_volume_change": check("orders", "volume_change", "abs(count(*) filter (o_orderdate >= '1996-01-01') - count(*) filter (o_orderdate < '1996-01-01')) / count(*) filter (o_orderdate < '1996-01-01')", "orders", "warning", "m > 0.5", "0.5"),
    "dq_schema": check("nation", "schema", "1", "range(1)"),
    "dq_pit": check("features", "point_in_time", "count(*) filter (feature_ts > ts)", f"({ASOF})"),
}

def fact(dataset: str, source: str, keys: str, foreign: bool = False, required: bool = False) -> list[str]:
    own = [check(dataset, "not_null:company_key", "count(*) filter (company_key is null)", source)] if required else []
    own.append(check(dataset, f"unique:{keys}", "coalesce(sum(n - 1), 0)", f"(select count(*) as n from {source} group by {keys})"))
    if foreign:
        own.append(check(dataset, "referential:company_key", "count(*)", f"{source} where company_key is null or company_key not in (select company_key from dim)"))
    return own


def gold(missing: int) -> str:
    users = f"select distinct 'U' || user_id::varchar as ticker from events{f' where user_id % {missing} <> 0' if missing else ''}"
    user = "'U' || user_id::varchar"
    return f"""with {COMPANIES}, {STATEMENTS}, {PRICES},
dim as (select distinct {key('ticker')} as company_key from (select ticker from companies union all {users})),
fact_statement as (select ticker, report_period, {key('ticker')} as company_key from statements),
fact_price as (select ticker, trading_date, {key('ticker')} as company_key from price_facts),
fact_news as (select event_id, {key(user)} as company_key from events where event_type = 'click'),
fact_alert as (select event_id, {key(user)} as company_key from events where value > 90)"""


def facts(required: bool) -> list[str]:
    return [
        *fact("silver_companies", "companies", "ticker"),
        *fact("fact_statement", "fact_statement", "ticker,report_period", True, required),
        *fact("fact_price", "fact_price", "ticker,trading_date", True),
        *fact("fact_news", "fact_news", "event_id", True),
        *fact("fact_alert", "fact_alert", "event_id", True),
        *fact("obt_company_quarter_risk", "fact_statement", "ticker,report_period"),
    ]


def suite() -> str:
    fresh = "select 'silver_market_prices', 'freshness:ts', case when m < 0 then 'fail' when m > 120 then 'warning' else 'pass' end, case when m < 0 then 'critical' else 'warning' end, m, case when m < 0 then 0.0 else 120.0 end from (select (epoch(timestamp '2024-02-01 00:00:00') - floor(epoch(max(ts)))) / 60 as m from events)"
    return " union all ".join([*facts(True), fresh])


def run_2() -> str:
    return f"select 'run-2' as run_id, status, count(*) as checks, 1 as stopped_runs from ({gold(0)} {suite()}) group by status"


def publication() -> str:
    filled = (("silver_companies", "companies"), ("fact_statement", "fact_statement"), ("fact_price", "fact_price"), ("dim_company", "dim"), ("silver_statements", "lineitem"), ("silver_market_prices", "events"))
    return " union all ".join([*facts(False), *[check(n, "not_empty", "count(*)", t, "critical", "m < 1", "1.0") for n, t in filled]])


def unit(seed: str, *parts: str) -> str:
    """The generators' number in [0, 1): the first 8 hexadecimal digits of a SHA-256."""
    text = " || '|' || ".join([f"'{seed}'", *[f"({p})::varchar" for p in parts]])
    digits = f"substr(sha256({text}), 1, 8)"
    return f"(('0x' || {digits})::bigint::double / 4294967296)"


GENERATED = f"""drafted as (
  select i, q, 1000000 + i * 100 + q * 1000 as total_assets, case when q < 4 then 1 else 2 end as schema_version, {unit("7", "i", "q")} as u from range(2000) t(i), range(8) v(q)),
generated as (
  select *, floor(total_assets * (0.45::double + u * 0.25::double))::bigint as total_liabilities, (2020 + q // 4)::varchar || 'Q' || (q % 4 + 1)::varchar as report_period,
    case when schema_version = 2 then floor(total_assets * 0.03::double) end as operating_cash_flow, case when schema_version = 2 then floor(total_assets * 0.08::double) end as retained_earnings from drafted)"""

ORACLES: dict[str, str] = {
    "scan_parquet": "select l_orderkey, l_linenumber, l_quantity from lineitem where l_shipdate >= '1995-01-01' and l_quantity < 10",
    "scan_optional": "select r_regionkey, r_name from region",
    "scan_glob": "select year(o_orderdate)::int as order_year, count(*) as order_count from orders where o_orderstatus = 'F' group by 1",
    "scan_run_filter": "select event_id, event_type, value from events where event_id % 3 = 1",
    "src_decode_json": "select event_id, (props::json ->> 'k')::bigint as k from events",
    "src_manifest": "select n_nationkey as country_id, n_name as country from nation",
    "src_views": f"with {COMPANIES} select sector, count(*) as companies from companies group by sector",
    "proj_normalize_cols": "select n_nationkey as nation_key, n_name from nation",
    "flt_typed": f"with {RAW} select * from valid",
    "flt_required": f"with {RAW} select failure_reason, count(*) as failed_rows from judged where failure_reason <> '' group by 1",
    "flt_enum": f"with {RAW} select count(*) as not_allowed from judged where failure_reason like '%exchange: not allowed%'",
    "flt_blank_null": f"with {RAW} select count(*) filter (trim(report_period) = '') as blank_periods, count(*) filter (net_income = '') as blank_incomes from raw",
    "flt_boolean": f"with {RAW} select case audited when 'YES' then true when '0' then false end as audited, count(*) as rows_with from raw group by 1",
    "flt_missing_required_col": f"with {RAW} select 0 as valid_rows, count(*) as failed_rows from raw",
    "silver_pipeline": f"with {RAW} select * from valid",
    "contract_validate": "select * from (values ('audited', 'missing'), ('exchange', 'missing'), ('current_assets', 'extra'), ('current_liabilities', 'extra'), ('ebit', 'extra'), ('equity', 'extra'), ('fiscal_quarter', 'extra'), ('fiscal_year', 'incompatible'), ('interest_expense', 'extra'), ('retained_earnings', 'extra'), ('supplier', 'extra'), ('total_liabilities', 'extra')) t(column_name, problem)",
    "proj_keys": f"select o_orderkey, {key('c_name')} as company_key, strftime(o_orderdate, '%Y%m%d')::int as date_key from orders join customer on o_custkey = c_custkey",
    "proj_reference_date": "select o_orderkey, case when o_orderkey % 2 = 0 or o_orderkey % 3 = 0 then o_orderdate::date else make_date(year(o_orderdate)::int, 1, 1) end as reference_date from orders",
    "proj_pick_prefix": "select n_nationkey as feature_n_nationkey, n_name as feature_n_name, n_regionkey as feature_n_regionkey from nation",
    "proj_ratios": f"with {STATEMENTS} select ticker, report_period, "
    + ", ".join(
        f"round(case when {b} > 0 then {a} / {b} end, 6) as {n}"
        for n, a, b in (
            ("current_ratio", "current_assets", "current_liabilities"),
            ("debt_to_asset", "total_liabilities", "total_assets"),
            ("debt_to_equity", "total_liabilities", "equity"),
            ("return_on_assets", "net_income", "total_assets"),
            ("return_on_equity", "net_income", "equity"),
            ("interest_coverage", "ebit", "interest_expense"),
        )
    )
    + " from statements",
    "flt_year": f"with {STATEMENTS} select ticker, report_period, total_assets from statements where fiscal_year = 1996",
    "flt_substring_search": "select p_partkey, p_name, p_type from part where lower(p_name) like '%a%' and lower(p_type) like '%b%'",
    "flt_point_lookup": f"with {STATEMENTS} select ticker, report_period, total_assets from statements where ticker = 'Supplier#000000007' order by report_period desc limit 1",
    "join_inner_equi": f"with {COMPANIES}, {STATEMENTS} select exchange, count(*) as statement_count from statements s join companies c on s.ticker = c.ticker group by 1",
    "join_broadcast": "select n_name, count(*) as customers, sum(c_acctbal::decimal(18,2))::double as balance from customer join nation on c_nationkey = n_nationkey group by 1",
    "join_exists": "select o_orderkey, o_totalprice from orders where exists (select 1 from lineitem where l_orderkey = o_orderkey and l_quantity >= 49)",
    "join_left_anti": "select c_custkey, c_name from customer where not exists (select 1 from orders where o_custkey = c_custkey)",
    "join_asof": ASOF,
    "win_asof_pick": ASOF,
    "join_asof_ref_ts": f"with {PRICES}, {REFERENCE} select event_id, r.ticker, reference_ts, trading_date::timestamp as feature_price_ts, close_price as feature_close_price, volume as feature_volume from reference r asof left join price_facts p on r.ticker = p.ticker and r.reference_ts >= p.trading_date::timestamp",
    "agg_sector_baseline": REPORT,
    "agg_two_level_salted": REPORT,
    "equivalence_check": f"with report as ({REPORT}) select 0 as only_left, 0 as only_right, count(*) as changed_left, count(*) as changed_right from report where sector = 'ASIA'",
    "canonical_digest": """select true as same, sha256(string_agg(line, chr(10) order by line)) as digest from (
  select '{"n_nationkey":' || n_nationkey::varchar || ',"n_name":"' || n_name || '","n_regionkey":' || n_regionkey::varchar || '}' as line from nation)""",
    "agg_latest_by_key": LATEST,
    "win_row_number_latest": LATEST,
    "agg_having_dups": "select l_orderkey, l_linenumber, count(*) as row_count from lineitem group by 1, 2 having count(*) > 1",
    "agg_label_dist": f"with {LABELLED} select distress_label, count(*) as n from labelled group by 1",
    "agg_table_count": " union all ".join(f"select '{t}' as table_name, count(*) as row_count from {t}" for t in ("customer", "orders", "lineitem", "supplier", "part", "events")),
    "agg_cond_sum": f"with {SNAPSHOTS} select count(*) filter (is_current) as current_rows, count(*) as all_rows from versions",
    "agg_rate": "select event_type, avg((value > 50)::int::double) as share, count(distinct user_id) as users from events group by 1",
    "agg_ordered_list": "select n_regionkey, string_agg(n_name, ',' order by n_nationkey, n_name) as nations from nation group by 1",
    "agg_min_max_union": "select min(d) as first_date, max(d) as last_date from (select o_orderdate::date as d from orders union all select l_shipdate::date from lineitem union all select ts::date from events)",
    "agg_window_counts": "select count(*) as windows, median(n)::double as median_count, max(n) as largest_count, round(max(n) / median(n), 6) as burst_ratio from (select count(*) as n from events group by floor(floor(epoch(ts)) / 3600))",
    "win_lag_return": f"with {PRICES} select ticker, trading_date, {key('ticker')} as company_key, strftime(trading_date, '%Y%m%d')::int as date_key, round(daily_return, 6) as daily_return, coalesce(abs(daily_return) > 0.07, false) as volatility_signal from price_facts",
    "win_volatility": f"with {PRICES} select coalesce(abs(daily_return) > 0.07, false) as volatility_signal, count(*) as n from price_facts group by 1",
    "win_prev_quarter": f"with {STATEMENTS}, {PREVIOUS.format('statements')} select ticker, report_period, net_income, previous_net_income from previous",
    "win_running_watermark": f"with {TICKS} select seq, ts, max(ts) over (order by seq rows between unbounded preceding and 1 preceding) as watermark from ticks",
    "dim_date": "select strftime(d, '%Y%m%d')::int as date_key, d::date as calendar_date, isodow(d)::int as day_of_week, month(d)::int as month, quarter(d)::int as quarter, year(d)::int as year, isodow(d) >= 6 as is_weekend from (select unnest(generate_series(min(o_orderdate)::date, max(o_orderdate)::date, interval 1 day)) as d from orders)",
    "iso_weekdays": "select isodow(o_orderdate)::int as day_of_week, count(*) as orders from orders group by 1",
    "z_score": f"with {LABELLED} select ticker, report_period, z_score from labelled",
    "warning_rules": f"with {STATEMENTS}, {PREVIOUS.format('statements')} select ticker, report_period, {FLAGS} from previous",
    "distress_label": f"with {LABELLED} select ticker, report_period, distress_label, distress_reason, label_confidence, training_eligible, n_warnings from labelled",
    "sector_exclusion": "select s_name as ticker, s_suppkey % 11 in (0, 2, 4, 6, 7) or s_suppkey % 7 = 0 or s_suppkey % 13 = 0 as excluded from supplier",
    "obt": f"with {LABELLED} select s.ticker, s.report_period, s.total_assets, round(case when s.total_assets > 0 then s.total_liabilities / s.total_assets end, 6) as debt_to_asset, distress_label, label_confidence from statements s left join labelled l on s.ticker = l.ticker and s.report_period = l.report_period",
    "feat_financial": f"with {STATEMENTS} select 'financial' as feature_family, ticker, report_period as feature_period, round(case when total_assets > 0 then net_income / total_assets end, 6) as feature_roa, interest_expense as feature_interest from statements",
    "feat_market": f"with {PRICES} select 'market' as feature_family, ticker, trading_date as feature_date, close_price as feature_close, coalesce(round(daily_return, 6), 0.0) as feature_return from price_facts",
    "feat_news": f"select 'news' as feature_family, event_id, 'U' || user_id::varchar as ticker, {key("'U' || user_id::varchar")} as company_key, strftime(ts, '%Y%m%d')::int as date_key, value as feature_score from events where event_type = 'click'",
    "fact_alert": f"select event_id, 'U' || user_id::varchar as ticker, {key("'U' || user_id::varchar")} as company_key, strftime(ts, '%Y%m%d')::int as date_key, event_type from events where value > 90",
    "fact_fin": f"with {STATEMENTS} select ticker, report_period, {key('ticker')} as company_key, (fiscal_year * 10000 + 101)::int as date_key, total_assets from statements",
    "pit_unified": f"with {PRICES}, {REFERENCE} select event_id, r.ticker, close_price as feature_close_price, round(daily_return, 6) as feature_daily_return from reference r asof left join price_facts p on r.ticker = p.ticker and r.reference_ts >= p.trading_date::timestamp",
    "flt_pit_leak": "select 0 as leaks",
    "scd2_rebuild": f"with {SNAPSHOTS} select * from versions",
    "scd2_merge": f"with {SNAPSHOTS} select * from versions",
    "win_change_detect": f"with {SNAPSHOTS} select ticker, count(*) as versions from versions group by 1",
    "win_lead_validity": f"with {SNAPSHOTS} select ticker, seq, valid_from_ts, valid_to_ts, is_current from versions",
    "union_positional": "select nation, count(*) as n from (select c_nationkey as nation from customer union all select s_nationkey from supplier) group by 1",
    "union_by_name": "select s_name as name, null::varchar as segment from supplier union all select c_name, c_mktsegment from customer",
    "union_dates": "select o_orderdate::date as day from orders union select ts::date from events",
    "distinct_keys": "select distinct l_suppkey, l_returnflag from lineitem",
    "sort_global": "select s_suppkey, s_acctbal from supplier order by s_acctbal desc, s_suppkey",
    "topk_recent": "select o_orderkey, o_orderdate, o_totalprice from orders where o_orderstatus = 'F' order by o_orderdate desc, o_orderkey limit 25",
    "limit_n": "select n_nationkey, n_name from nation order by n_nationkey limit 20",
    "page_offset": "select c_custkey, c_name from customer order by c_custkey limit 20 offset 40",
    **CHECKS,
    "dq_freshness": "select 'orders' as dataset_name, 'freshness:o_orderdate' as check_name, case when m is null then 'warning' when m < 0 then 'fail' when m > 1440 then 'warning' else 'pass' end as status, case when m < 0 then 'critical' else 'warning' end as severity, m as metric_value, 1440.0::double as threshold_value from (select (epoch(timestamp '2005-01-01 00:00:00') - floor(epoch(max(o_orderdate)))) / 60 as m from orders)",
    "dq_retention_empty": check("region", "retention", "0.0", "range(1)", "warning", "m < 0.8", "0.8"),
    "dq_freshness_future": "select 'orders' as dataset_name, 'freshness:o_orderdate' as check_name, 'fail' as status, 'critical' as severity, (epoch(timestamp '1990-01-01 00:00:00') - floor(epoch(max(o_orderdate)))) / 60 as metric_value, 0.0::double as threshold_value from orders",
    "dq_suite": f"{gold(97)} {suite()}",
    "dq_runner": f"{gold(97)}, first as ({suite()}) select 'run-1' as run_id, status, count(*) as checks, 1 as stopped_runs from first group by status union all {run_2()}",
    "quarantine_sink": f"with {RAW}, failed as (select 'run-1' as run_id, failure_reason from judged where failure_reason <> '' union all select 'run-2', failure_reason from judged where failure_reason like 'ticker%') select run_id, 'statements' as dataset_name, failure_reason, count(*) as n, count(*) as with_id, (select count(*) from failed where run_id = 'run-2') as last_run from failed group by 1, 3",
    "publish_gate": f"{gold(0)} {publication()}",
    "profile_digest": "select count(*) as part_rows, true as same, false as same_when_changed from part",
    "docs_by_content": "select sha256(coalesce(text, '')) as content_hash, min(doc_id) as kept_id, count(*) as copies from documents group by 1",
    "join_left_multi": f"with {COMPANIES}, {STATEMENTS}, {PRICES}, known as (select substr(ticker, 2)::bigint as supplier, count(*) as prices from price_facts group by 1) select fiscal_year, exchange, count(*) as n, count(prices) as with_prices from statements s left join companies c on s.supplier = c.supplier left join known k on s.supplier = k.supplier group by 1, 2",
    "st_bounded_oracle": f"with {routed(True)} select route, count(*) as n from routed group by 1",
    "st_routed_no_dedup": f"with {routed(False)} select route, count(*) as n from routed group by 1",
    "st_stream_routes": f"with {routed(True)} select id, seq, route from routed",
    "src_log_bounded": "select event_type, count(*) as n, count(*) as places, sum(event_id)::bigint as ids from events group by 1",
    "src_log_stream": "select event_type, count(*) as n, sum(event_id)::bigint as ids from events group by 1",
    "profile_columns": " union all ".join(f"select '{c}' as column_name, count(*) as row_count, count(*) filter ({c} is null) as null_count, count(distinct {c}) as distinct_values, true as close, {m} as median_close from orders" for c, m in (("o_custkey", "true"), ("o_orderpriority", "null"), ("o_totalprice", "true"))),
    "percentile_exact": "with g as (select event_type, floor(epoch(ts)) - lag(floor(epoch(ts))) over (partition by user_id order by ts, event_id) as gap from events) select event_type, median(gap) as median_gap from g where gap is not null group by 1",
    "search_trigrams": "select distinct term, doc_id from (select distinct substr(text, 1, 30) as term from benchmark) join documents on contains(lower(text), lower(term))",
    "page_blocks": "select c_acctbal, c_custkey, c_name, case when k <= 60 then 'page' else 'next' end as part from (select *, row_number() over (order by c_acctbal, c_custkey) as k from customer) where k between 41 and 80",
    "publish_versions": "select o_orderstatus, count(*) as n, sum(o_orderkey)::bigint as keys, 'run-2' as run_id, nullif(count(*) filter (o_orderkey % 2 = 0), 0) as n_first from orders group by 1",
    "compact_partitions": "select l_returnflag, l_linestatus, count(*) as n, sum(l_orderkey)::bigint as keys, true as fewer, (select count(*) from (select distinct l_returnflag, l_linestatus from lineitem)) as files_after from lineitem group by 1, 2",
    "index_skips": "select o_orderkey, o_orderstatus, o_totalprice, true as most_skipped from orders where o_orderkey between 100 and 250",
    "st_too_late": f"with {routed(True)} select id, seq, ts, ticker from routed where route = 'too_late'",
    "st_stream_windows": f"with {routed(True)} select ticker, ts - ts % 3600 as window_start, ts - ts % 3600 + 3600 as window_end, count(*) as event_count, sum(volume)::bigint as total_volume from routed where route in ('on_time', 'allowed_late') group by all",
    "st_batch_windows": f"with {routed(True)} select ticker, ts - ts % 3600 as window_start, ts - ts % 3600 + 3600 as window_end, count(*) as event_count, sum(volume)::bigint as total_volume from routed where route in ('on_time', 'allowed_late') group by all",
    "st_tumbling": "select 'U' || user_id::varchar as ticker, (floor(epoch(ts)) - floor(epoch(ts)) % 3600)::bigint as window_start, count(*) as event_count, count(*) as total_volume from events group by 1, 2",
    "st_dedup_ttl": "select count(*) as event_count, count(distinct (user_id, floor(epoch(ts) / 3600))) as windows from events",
    "st_parse_side_output": "select count(*) filter (event_id % 50 <> 0) as valid_rows, count(*) filter (event_id % 50 <> 0) as volume, count(*) filter (event_id % 50 = 0) as invalid_rows from events",
    "compact_files": "select 12 as files_before, 1 as files_after, count(*) as rows from orders",
    "repartition_layout": "select l_returnflag, l_linestatus, count(*) as n from lineitem group by 1, 2",
    "sink_staged_publish": "select r_regionkey, r_name, 'run-2' as run_id from region where r_regionkey < 3",
    "sink_promote_prefix": "select (select count(*) from region where r_regionkey < 2) as regions, (select count(*) from nation where n_regionkey < 2) as nations",
    "sink_rows": "select * from (values (1, 'a', null::double), (2, null, null)) t(k, v, w)",
    "sink_bytes": "select 12 as size, '{\"rows\": 25}' as content, 1 as files, 1 as cleared, false as left_over",
    "compact_guard": "select 'small' as files_are, 1 as files_after, false as written union all select 'large', 12, false",
    "zorder_write": "select count(*) as rows, true as size_skips, true as price_skips from part",
    "index_lookup": f"with {STATEMENTS} select ticker, report_period, total_assets from statements where ticker = 'Supplier#000000007' and report_period in ('1996Q1', '1997Q2', '2099Q1')",
    "sink_upsert": "select o_custkey, max(o_orderdate) as o_orderdate from orders group by 1",
    "lineage_audit": "select * from (values ('label_distress', '', 'no contract'), ('feat_orphan', '', 'no contract'), ('feat_orphan', '', 'no upstream'), ('label_distress', 'fact_statement', 'upstream not named')) t(dataset, name, problem)",
    "contract_parse": "select * from (values ('fact_statement', 'currency', 'missing'), ('fact_statement', 'total_assets', 'type'), ('fact_statement', 'equity', 'extra'), ('dim_company', 'company_key', 'keys'), ('dim_company', 'ticker', 'column'), ('dim_company', 'sector', 'column'), ('fact_statement', 'ticker', 'keys'), ('fact_statement', 'report_period', 'keys'), ('fact_statement', 'fiscal_year', 'partitions'), ('fact_statement', 'total_assets', 'column'), ('fact_statement', 'currency', 'column')) t(table_name, column_name, problem)",
    "evidence_audit": "select * from (values ('region', 'ok'), ('nation', 'content differs'), ('supplier', 'row count differs'), ('gone', 'no such table'), ('part', 'missing evidence')) t(dataset_name, status)",
    "zorder": "with s as (select p_partkey, case when max(p_size) over () > min(p_size) over () then floor((p_size - min(p_size) over ()) / (max(p_size) over () - min(p_size) over ()) * 15)::bigint else 0 end as a, case when max(price) over () > min(price) over () then floor((price - min(price) over ()) / (max(price) over () - min(price) over ()) * 15)::bigint else 0 end as b from (select *, p_retailprice::decimal(12,2)::double as price from part)) select p_partkey, "
    + " + ".join(f"((a >> {k}) & 1) * {4**k} + ((b >> {k}) & 1) * {2 * 4**k}" for k in range(4))
    + " as z_key from s",
}

ORACLES |= {
    "flt_event_valid": "select event_id % 50 <> 0 and event_id % 9 <> 0 and event_id % 10 <> 0 as valid, count(*) as n from events group by 1",
    "flt_row_contract": f"with {RAW} select split_part(failure_reason, '; ', 1) as first_error, count(*) as n from judged where failure_reason <> '' group by 1",
    "proj_align_schema": f"with {RAW} select count(*) as all_rows, 0 as audited_rows, count(ticker) as ticker_rows from raw",
    "proj_stream_to_price": f"with {TICKS} select seq, ticker, strftime(make_timestamp(ts * 1000000), '%Y-%m-%d') as trading_date, price as open_price, price as high_price, price as low_price, price as close_price, volume from ticks where price is not null",
    "session_audit": "select before, role, count(*) as n from (select role, lag(role) over (partition by conv_id order by turn) as before from conversations) where before is not null and (before, role) not in (('user', 'assistant'), ('assistant', 'user'), ('system', 'user')) group by 1, 2",
    "outbox_claim": "select o_orderkey from orders where o_orderkey % 8 < 5 and (o_orderkey % 3 <> 0 or o_orderdate <= timestamp '1996-06-01')",
    "label_time_split": "select case when o_orderdate >= timestamp '1997-01-01' then 2 when o_orderdate >= timestamp '1995-01-01' then 1 else 0 end as part, count(*) as n, min(o_orderdate) as first_ts, max(o_orderdate) as last_ts from orders group by 1",
    "required_counts": "select 'customer' as dataset_name, count(*) as row_count, count(*) > 0 as ok from customer union all select 'orders', count(*), count(*) > 0 from orders union all select 'nothing', 0, false",
    "pit_audit": "select count(*) as row_count, count(*) filter (event_id % 50 = 0) as missing_created, 0 as leaks, count(*) filter (event_id % 50 = 0) = 0 as ok from events",
    "run_id": "select 'silver-' || substr(sha256('silver|2026-01-01'), 1, 12) as run_id",
    "manifest_verify": "select * from (values ('region.parquet', 'listed twice'), ('nation.parquet', 'changed'), ('orders.parquet', 'not listed'), ('gone.parquet', 'missing'), ('../etc/x.parquet', 'unsafe path')) t(name, problem)",
    "file_digests": "select 2 as digests, 3 as whole",
    "st_microbatch": f"""with recursive {TICKS},
lined as (select id % 16 as consumer, seq, (seq % 23)::int as elapsed, ts, row_number() over (partition by id % 16 order by seq) as place from ticks),
walked as (
  select consumer, place, 0 as flush, 1 as held, elapsed as waited from lined where place = 1
  union all
  select n.consumer, n.place, case when w.held >= 10 or w.waited >= 60 then w.flush + 1 else w.flush end,
    case when w.held >= 10 or w.waited >= 60 then 1 else w.held + 1 end, case when w.held >= 10 or w.waited >= 60 then n.elapsed else w.waited + n.elapsed end
  from walked w join lined n on n.consumer = w.consumer and n.place = w.place + 1)
select w.consumer::int as consumer, flush, make_timestamp(ts * 1000000)::date as event_date, hour(make_timestamp(ts * 1000000))::int as event_hour, count(*) as n
from walked w join lined l on w.consumer = l.consumer and w.place = l.place group by all""",
    "agg_stream_price": f"with {TICKS} select ticker, count(*) as event_count, round(sum(price::decimal(18,4))::double / count(*), 6) as average_price, sum(volume)::bigint as total_volume from ticks where price is not null group by 1",
    "agg_duration_stats": "select event_type, median(gap)::double as median_gap, min(gap) as shortest, max(gap) as longest from (select event_type, (floor(epoch(ts)) - floor(epoch(lag(ts) over (partition by user_id order by ts, event_id))))::bigint as gap from events) where gap is not null group by 1",
    "sink_jsonl": "select * from nation",
    "sink_bronze_stream": "select event_type as topic, count(*) as n, count(distinct (ts::date, hour(ts))) as hours, 1 as batches, (select count(*) from events) as taken, 0 as taken_again from events group by 1",
    "src_kafka_poll": "select event_type, count(*) as n, sum(event_id)::bigint as ids from events where event_id % 3 = 1 group by 1",
    "sink_flink_files": f"with {routed(True)} select route, count(*) as n, sum(seq)::bigint as seqs from routed where route in ('invalid', 'duplicate', 'too_late') group by 1 union all select 'windows', count(distinct (ticker, ts // 3600)), count(*) from routed where route in ('on_time', 'allowed_late')",
    "proj_event_id": """select event_id, sha256('{"event_type":"' || event_type || '","user_id":' || user_id::varchar || '}') as content_id from events""",
    "join_label_pit": f"""with {SNAPSHOTS}, features as (select seq as feature_id, ticker, created_ts + interval 10 days as event_timestamp from snapshots),
known as (select ticker, created_ts, status, seq from snapshots qualify row_number() over (partition by ticker, created_ts order by seq desc) = 1)
select feature_id, k.status as label_status, k.seq as label_seq from features f asof left join known k on f.ticker = k.ticker and f.event_timestamp >= k.created_ts""",
    "scan_prefix": "select n_nationkey, n_name, true as empty_is_an_error from nation",
    "src_collect": f"""with {COMPANIES}, {STATEMENTS}, {PRICES}, ids as (
  select 'companies' as d, 'companies|' || ticker as k from companies union all select 'statements', 'statements|' || ticker || '|' || report_period from statements
  union all select 'prices', 'prices|' || ticker || '|' || trading_date::varchar from prices)
select d as dataset_name, 'star schema' as source_system, count(*) as row_count, count(distinct k) as keys, min(k) as first_key, max(k) as last_key from ids group by d""",
    "session_fencing": """with e as (select event_id, user_id % 50 as session, event_id % 700 as request, trunc((event_id * 7919) % 1000 + event_id / 5)::int as token from events),
seen as (select *, row_number() over (partition by session, request order by event_id) as nth, max(token) over (partition by session order by event_id rows between unbounded preceding and 1 preceding) as top from e)
select case when nth > 1 then 'replayed' when token < top then 'fenced off' else 'accepted' end as outcome, count(*) as n from seen group by 1""",
    "access_rules": """with r as (select case o_orderkey % 3 when 0 then 'analyst' when 1 then 'admin' else 'guest' end as role, case when o_orderkey % 2 = 0 then 'read' else 'publish' end as action, o_orderkey % 4 as level from orders)
select role, action, (role in ('analyst', 'admin') and action = 'read' and level >= 1) or (role = 'admin' and action = 'publish' and level >= 2) as permitted, count(*) as n from r group by all""",
    "row_policies": "select 'auditor' as role, count(*) as n from customer union all select 'building', count(*) from customer where c_mktsegment = 'BUILDING' union all select 'solvent', count(*) from customer where c_acctbal > 0 union all select 'stranger', 0",
    "sink_metadata": " union all ".join(
        f"select '{n}' as table_name, count(*) as n, max(last) as last from (select o_orderkey % {k} as key, max(floor(epoch(o_orderdate)))::bigint as last from orders group by 1)"
        for k, n in enumerate("pipeline_run_log data_quality_result dataset_freshness schema_version_registry failed_records backfill_request source_request_log collector_checkpoint".split(), 2)
    ),
    "scan_cached": "select o_orderstatus as value, count(*) as n from orders group by 1 union all select o_orderpriority, count(*) from orders group by 1",
    "gen_offline": f"""with companies as (
  select i, 'G' || lpad(i::varchar, 7, '0') as ticker, case when i < 7000 then 'HOSE' when i % 2 = 0 then 'HNX' else 'UPCOM' end as exchange, i < 6000 as hot, i % 1000 as entity from range(10000) t(i)),
copied as (select *, 1767225600 + i as created from companies union all select *, 1767225600 + i + 60 from companies where {unit("7", "ticker")} < 0.02 / (1 - 0.02)),
{GENERATED}
select a.*, b.*, c.* from
  (select count(*) as company_rows, count(distinct ticker) as companies, count(*) filter (hot) as hot_rows, count(distinct entity) as entities, count(*) filter (exchange = 'HOSE') as hose_rows, sum(created)::bigint as created from copied) a,
  (select count(*) as statement_rows, sum(total_assets)::bigint as assets, sum(total_liabilities)::bigint as liabilities, count(operating_cash_flow) as new_rows, sum(retained_earnings)::bigint as retained, max(report_period) as last_period from generated where i < 2000) b,
  (select count(*) as price_rows, round(sum(round(10 + {unit("8", "i")} * 90, 2)), 2) as prices, sum(1000 + i)::bigint as volume from companies) c""",
    "gen_stream": f"""with base as (
  select i, i % 600 < 60 as is_burst, case when i % 600 < 60 then i - i % 600 + (i % 600) // 10 else i end as ingest, {unit("7", "i")} < 0.03 as is_late, {unit("8", "i")} < 0.05 as is_out from range(50000) t(i)),
shifted as (select *, case when is_late then 120 + floor({unit("9", "i")} * 180) when is_out then floor({unit("10", "i")} * 30) else 0 end as shift from base),
doubled as (select *, false as copy from shifted union all select *, true from shifted where {unit("12", "'e' || i::varchar")} < 0.015 / (1 - 0.015))
select count(*) as rows, count(distinct i) as ids, count(*) filter (is_late) as is_late, count(*) filter (is_out and not is_late) as is_out_of_order, count(*) filter (is_burst) as is_burst,
  count(*) filter (copy) as is_injected_duplicate, sum(ingest - shift)::bigint as event_seconds, sum(ingest)::bigint as ingest_seconds from doubled""",
    "gen_burst": """with e as (select user_id, floor(epoch(ts)) as began from events where event_id = 5), b as (select i, 'U' || user_id::varchar as ticker, began + i * (10 / 200.0::double) as event_second from range(201) t(i), e)
select count(*) as n, min(ticker) as ticker, max(event_second)::double as last, max(event_second) - min(event_second) as seconds, round(sum(10 + i * 0.01::double), 2) as prices, sum(100 + i)::bigint as volume from b""",
    "gen_late": f"select event_id::varchar as event_id, (floor(epoch(ts)) - ceil({unit('0', 'event_id')} * 300))::bigint as event_second from events",
    "gen_dups": f"select event_id::varchar as event_id, case when {unit('0', 'event_id')} < 0.25 then 2 else 1 end as n from events",
    "union_evolved_manual": f"with {STATEMENTS}, v as (select *, case when fiscal_year < 1995 then 1 else 2 end as schema_version from statements) select schema_version, count(*) as n, case when schema_version = 2 then count(*) else 0 end as with_type, case when schema_version = 2 then count(retained_earnings) else 0 end as with_retained, sum(total_assets::decimal(18,2))::double as assets from v group by 1",
    "sink_kafka_rows": "select r_regionkey::varchar as key, '{\"r_name\":\"' || r_name || '\",\"r_regionkey\":' || r_regionkey::varchar || '}' as value, 'regions' as topic from region",
}

_GOLD = {
    "dim_company": "scd2_rebuild", "dim_date": "dim_date", "fact_financial_statement": "fact_fin", "fact_market_price": "win_lag_return", "fact_news": "feat_news", "fact_alert": "fact_alert",
    "feat_financial": "feat_financial", "feat_market": "feat_market", "obt_company_quarter_risk": "obt", "obt_distress_label": "distress_label", "obt_point_in_time": "pit_unified",
}
ORACLES["gold_views"] = " union all ".join(f"select 'gold_{n}' as view_name, count(*) as n, 'silver_prices, ?' as refused from ({ORACLES[q]})" for n, q in _GOLD.items())
