"""The registered queries as DuckDB SQL over the same tables.

Common table expressions are shared by name; ``_sql`` puts the needed ones in front.
"""

from __future__ import annotations

from convoy import settings
from convoy.functions import text as tx
from convoy.functions.coerce import WHITE_SPACE

FEATURES = settings.FEATURES
SCORED = (*FEATURES, "embedding")


def _q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _at(column: str) -> str:
    return f"strftime({column}, '%Y-%m-%d %H:%M:%S.%f')"


_CTE: dict[str, tuple[tuple[str, ...], str]] = {}


def _cte(name: str, needs: str, text: str) -> None:
    _CTE[name] = (tuple(needs.split()), text)


def _sql(needs: str, body: str) -> str:
    done: list[str] = []

    def add(name: str) -> None:
        if name in done:
            return
        for other in _CTE[name][0]:
            add(other)
        done.append(name)

    for name in needs.split():
        add(name)
    head = ",\n".join(f"{n} as ({_CTE[n][1]})" for n in done)
    return f"with recursive {head}\n{body}" if head else body


# --- telemetry, normalisation, rules ----------------------------------------------------

_cte(
    "tel",
    "",
    """select event_id, user_id, event_type, ts as event_ts,
 case when event_id % 97 = 0 then '' when event_id % 89 = 0 then 'BAD'
      else 'VH-' || lpad(cast(user_id as varchar), 7, '0') end as vehicle_id,
 case when event_id % 83 = 0 then ''
      else 'trip-' || cast(user_id as varchar) || '-' || cast(cast(ts as date) as varchar) end as trip_id,
 case when event_id % 79 = 0 then '' when event_id % 73 = 0 then 'NOT-A-DATE'
      else strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') || 'Z' end as timestamp,
 case when event_id % 71 = 0 then 999e0 else 40.4406e0 + ((event_id % 400) - 200) / 1e4 end as gps_lat,
 case when event_id % 71 = 0 then -999e0 else -79.9959e0 + ((event_id % 300) - 150) / 1e4 end as gps_lon,
 value as speed_mph, (event_id % 100) / 1e2 as brake_pressure,
 38e0 + value * 0.08e0 as lidar_temp_c, least(95e0, 25e0 + value * 0.6e0) as compute_load_pct,
 case when event_id % 61 = 0 then 'SENSOR_STATUS_UNSPECIFIED' when event_type = 'error' then 'SENSOR_STATUS_FAULT'
      when event_type = 'purchase' then 'SENSOR_STATUS_DEGRADED' else 'SENSOR_STATUS_OK' end as sensor_status,
 case when event_id % 67 = 0 then '' when event_id % 3 = 0 then 'hw-rev-3.2'
      when event_id % 3 = 1 then 'hw-rev-3.3' else 'hw-rev-4.0-beta' end as hardware_version,
 case event_type when 'signup' then 'DEVICE_TYPE_EDGE_GATEWAY' when 'click' then 'DEVICE_TYPE_VEHICLE'
      else 'DEVICE_TYPE_SIMULATOR' end as device_type
from events""",
)
_cte(
    "norm",
    "tel",
    """select *, case when trim(vehicle_id) = '' then 'empty_vehicle_id'
   when try_cast(replace(timestamp, 'Z', '') as timestamp) is null then 'unparseable_timestamp' end as issue,
 try_cast(replace(timestamp, 'Z', '') as timestamp) as event_time from tel""",
)
_cte("acc", "norm", "select * from norm where issue is null")


def _v(cond: str, field: str, rule: str, message: str) -> str:
    return (
        f"case when {cond} then {{'field': {_q(field)}, 'rule': {_q(rule)}, 'message': {message}}} end"
    )


def _quoted(col: str) -> str:
    return f"coalesce('''' || {col} || '''', 'None')"


def _in(names) -> str:
    return "(" + ", ".join(_q(n) for n in names) + ")"


def _range_rule(f: str) -> str:
    lo, hi = settings.RANGES[f]
    return _v(
        f"{f} < {lo} or {f} > {hi}",
        f,
        f"in_range[{lo},{hi}]",
        f"'{f}=' || cast({f} as varchar) || ' outside [{lo}, {hi}]'",
    )


_VEHICLE = _v(
    "not regexp_matches(vehicle_id, '^VH-[0-9]{4,8}$')",
    "vehicle_id",
    "regex:^VH-[0-9]{4,8}$",
    "'invalid vehicle_id: ' || " + _quoted("vehicle_id"),
)
_TRIP = _v("length(trim(trip_id)) < 1", "trip_id", "required_nonempty", "'trip_id is required'")
_TIME = [
    _v("timestamp = ''", "timestamp", "required", "'timestamp is required'"),
    _v(
        "timestamp <> '' and try_cast(replace(timestamp, 'Z', '') as timestamp) is null",
        "timestamp",
        "iso8601",
        "'timestamp not ISO-8601: ' || " + _quoted("timestamp"),
    ),
]
_RANGES = [_range_rule(f) for f in ("gps_lat", "gps_lon", "speed_mph", "compute_load_pct")]
_BRAKE = _v(
    "brake_pressure < 0",
    "brake_pressure",
    "ge:0",
    "'brake_pressure=' || cast(brake_pressure as varchar) || ' must be >= 0'",
)
_SENSOR = _v(
    f"sensor_status not in {_in(settings.SENSOR_STATUSES)}",
    "sensor_status",
    "enum:SensorStatus",
    "'invalid sensor_status: ' || " + _quoted("sensor_status"),
)
_DEVICE = _v(
    f"device_type not in {_in(settings.DEVICE_TYPES)}",
    "device_type",
    "enum:DeviceType",
    "'invalid device_type: ' || " + _quoted("device_type"),
)
_HARDWARE = _v(
    "length(trim(hardware_version)) < 1",
    "hardware_version",
    "required_nonempty",
    "'hardware_version is required'",
)
_ALL_RULES = [_VEHICLE, _TRIP, *_TIME, *_RANGES, _BRAKE, _SENSOR, _DEVICE, _HARDWARE]
_BATCH_RULES = [_VEHICLE, _TRIP, *_TIME, *_RANGES, _BRAKE, _HARDWARE]


def _list(rules: list[str]) -> str:
    return f"list_filter([{', '.join(rules)}], lambda x: x is not null)"


_cte("qa0", "acc", f"select *, {_list(_ALL_RULES)} as violations from acc")
_cte(
    "qa",
    "qa0",
    "select *, case when len(violations) = 0 then 'validated' else 'quarantine' end as route from qa0",
)
_cte("val", "qa", "select * from qa where route = 'validated'")
_cte(
    "qrec",
    "qa",
    """select event_id, event_ts as rejected_at, 'telemetry.normalized' as source_topic, vehicle_id,
 violations[1].field as field, violations[1].rule as rule, violations[1].message as reason, violations,
 trip_id, hardware_version from qa where route = 'quarantine'""",
)
_cte("tri", "tel", f"select *, {_list(_BATCH_RULES)} as broken from tel")

# --- windows, policy, breaker -----------------------------------------------------------

_cte(
    "win",
    "qa",
    """select vehicle_id, window_no, count(*) as total,
  count(*) filter (route = 'quarantine') as quarantined,
  round(count(*) filter (route = 'quarantine') / count(*), 6) as quarantine_rate,
  count(*) filter (route = 'quarantine') / count(*) > 0.15 as exceeded, max(event_time) as window_end
 from (select *, cast((row_number() over (partition by vehicle_id order by event_time, event_id) - 1) // 20 as bigint) as window_no
       from qa) group by vehicle_id, window_no having count(*) = 20""",
)
_LAGS = " + ".join(f"coalesce(lag(quarantine_rate, {k}) over w, 0)" for k in (4, 3, 2, 1)) + " + quarantine_rate"
_cte(
    "inc",
    "",
    """select 'drift-' || cast(event_id as varchar) as incident_id, 'INCIDENT_SEVERITY_CRITICAL' as severity,
  'drift-monitor' as source_service, 'drifted_feature_count' as metric_name, 2.0::double as threshold,
  (event_id % 4)::double as observed_value, ts as event_time, 'INCIDENT_STATUS_OPEN' as status,
  case when event_id % 100 = 0 then 'fleet' else 'VH-' || lpad(cast(user_id as varchar), 7, '0') end as vehicle_id
 from events where event_type = 'error'""",
)

def _policy(p: str, win: str) -> None:
    """Rolling quality of ``win``, correlated with drift incidents, and the decisions on it."""
    _cte(
        f"{p}roll",
        win,
        f"""select *, least(window_no + 1, 5) as batch_count, ({_LAGS}) / least(window_no + 1, 5) as rolling_rate,
      window_no - coalesce(max(case when not exceeded then window_no end) over w, -1) as streak
     from {win} window w as (partition by vehicle_id order by window_no)""",
    )
    _cte(
        f"{p}cor0",
        f"{p}roll inc",
        f"""select vehicle_id, window_end as event_time, 0::bigint as kind, lpad(cast(window_no as varchar), 12, '0') as ref,
       rolling_rate, batch_count, streak, 0::bigint as drift_count from {p}roll
      union all
      select vehicle_id, event_time, 1, incident_id, null, null, null, cast(observed_value as bigint) from inc""",
    )
    _cte(
        f"{p}cor",
        f"{p}cor0",
        f"""select vehicle_id, event_time, kind, ref, drift_count,
       coalesce(last_value(rolling_rate ignore nulls) over w, 0) as rolling_rate,
       coalesce(last_value(batch_count ignore nulls) over w, 0) as batch_count,
       coalesce(last_value(streak ignore nulls) over w, 0) as streak
      from {p}cor0 window w as (partition by vehicle_id order by event_time, kind, ref
        rows between unbounded preceding and current row)""",
    )
    _cte(
        f"{p}dec0",
        f"{p}cor",
        f"""select *, batch_count >= 5 and rolling_rate > 0.15 as tq, drift_count >= 2 as td, streak >= 3 as tc,
       isodow(event_time) between 1 and 5 and hour(event_time) >= 13 and hour(event_time) < 21 as hours from {p}cor""",
    )
    _cte(
        f"{p}dec",
        f"{p}dec0",
        f"""select *, tq or td or tc as trip,
       case when tq or td or tc then 'critical' else 'warning' end as severity,
       list_filter([
         case when tc then printf('consecutive_qa_failures: count=%d threshold=3', streak) end,
         case when td then printf('multi_feature_drift: count=%d threshold=2', drift_count) end,
         case when tq then printf('qa_quarantine_rate_exceeded: rolling=%.4f threshold=0.1500 batches=%d', rolling_rate, batch_count) end
       ], lambda x: x is not null) as reasons,
       case when hours and td and rolling_rate > 0.15 then 'both' when hours then 'pagerduty' else 'slack' end as route
      from {p}dec0""",
    )


_policy("", "win")


def _breaker(name: str, cooldown: str, dec: str = "dec") -> None:
    """The fold over each vehicle's events, one event per recursion step."""
    eff = f"case when b.state = 'open' and e.event_time - b.opened_at >= interval '{cooldown}' then 'half_open' else b.state end"
    _cte(
        f"{name}_ev",
        dec,
        f"select *, row_number() over (partition by vehicle_id order by event_time, kind, ref) as n from {dec}",
    )
    _cte(
        name,
        f"{name}_ev",
        f"""select vehicle_id, n, event_time, kind, ref, severity, route, reasons, 'closed' as prior_state,
   case when trip then 'open' else 'closed' end as state, trip as tripped, false as recovered,
   cast(trip as bigint) as trip_count, case when trip then event_time end as opened_at,
   case when trip then event_time end as first_trip, cast(0 as bigint) as retrips
  from {name}_ev where n = 1
  union all
  select e.vehicle_id, e.n, e.event_time, e.kind, e.ref, e.severity, e.route, e.reasons, b.state,
   case when ({eff}) = 'open' or e.trip then 'open' else 'closed' end,
   ({eff}) <> 'open' and e.trip,
   ({eff}) = 'half_open' and not e.trip,
   b.trip_count + cast(({eff}) <> 'open' and e.trip as bigint),
   case when ({eff}) = 'open' then b.opened_at when e.trip then e.event_time end,
   case when ({eff}) = 'half_open' and not e.trip then null
        when ({eff}) <> 'open' and e.trip then coalesce(b.first_trip, e.event_time) else b.first_trip end,
   case when ({eff}) <> 'open' and e.trip and b.first_trip is not null then b.retrips + 1
        when ({eff}) <> 'open' and e.trip then 0 else b.retrips end
  from {name} b join {name}_ev e on e.vehicle_id = b.vehicle_id and e.n = b.n + 1""",
    )
    # The episode a token belongs to: of a recovery, the one that was open before it.
    _cte(
        f"{name}_tok",
        name,
        f"""select *, case when recovered then lag(first_trip) over (partition by vehicle_id order by n)
           else first_trip end as episode from {name}""",
    )
    _cte(
        f"{name}_ep",
        f"{name}_tok",
        f"""select *, case when retrip_count > 0 then 'Circuit breaker still open for ' || vehicle_id || ' (retrip ' || retrip_count || '): '
       else 'Circuit breaker tripped for ' || vehicle_id || ': ' end || '[' || array_to_string(reasons, ' ') || ']' as summary
  from (select 'esc_' || vehicle_id || '_' || cast(epoch_us(episode) as varchar) || '000' as incident_id, vehicle_id,
   episode as first_trip, max(event_time) filter (tripped) as last_trip, count(*) filter (tripped) - 1 as retrip_count,
   arg_max(reasons, n) filter (tripped) as reasons, arg_max(route, n) filter (tripped) as route,
   arg_max(severity, n) filter (tripped) as severity, max(event_time) filter (recovered) as resolved_at,
   case when count(*) filter (recovered) > 0 then 'breaker_recovered' end as resolve_reason,
   case when count(*) filter (recovered) > 0 then 'resolved' else 'open' end as status,
   count(*) filter (recovered) = 0 as open
  from {name}_tok where tripped or (recovered and episode is not null) group by vehicle_id, episode)""",
    )


_breaker("brk", "60 seconds")
_breaker("slow", "2 days")

_EPISODE = f"""incident_id, vehicle_id, status, severity, route, {_at('first_trip')} as first_trip,
 {_at('last_trip')} as last_trip, {_at('resolved_at')} as resolved_at, resolve_reason, retrip_count, open, summary"""

# Breaker events and operator actions in one fold.
_cte(
    "act",
    "slow_ep",
    """select incident_id, vehicle_id, first_trip as target, 'acknowledge' as action,
    first_trip + interval 1 hour as action_at, 'seen' as note from slow_ep
   union all select incident_id, vehicle_id, first_trip, 'resolve', first_trip + interval 36 hour, '' from slow_ep""",
)
_cte(
    "mix",
    "slow act",
    """select *, row_number() over (partition by vehicle_id order by event_time, kind, ref) as m from (
    select vehicle_id, event_time, kind, ref, tripped, recovered, severity, route, reasons,
      null::varchar as action, null::timestamp as target, null::varchar as note from slow where tripped or recovered
    union all select vehicle_id, action_at, 2, action, false, false, null, null, null, action, target, note from act)""",
)
_cte(
    "fold",
    "mix",
    """select vehicle_id, m, event_time, tripped, recovered, severity, route, reasons, action, target,
    case when tripped then event_time end as current, case when tripped then event_time end as episode,
    tripped as is_trip, null::varchar as closing, case when tripped then '' end as ack
   from mix where m = 1
   union all
   select e.vehicle_id, e.m, e.event_time, e.tripped, e.recovered, e.severity, e.route, e.reasons, e.action, e.target,
    case when e.tripped then coalesce(f.current, e.event_time) when e.recovered then null
         when e.action = 'resolve' and e.target = f.current then null else f.current end,
    case when e.tripped then coalesce(f.current, e.event_time) when e.recovered then f.current
         when e.target = f.current then f.current end,
    e.tripped,
    case when e.recovered and f.current is not null then 'breaker_recovered'
         when e.action = 'resolve' and e.target = f.current then 'manual' end,
    case when e.tripped then '' when e.action = 'acknowledge' and e.target = f.current then f.ack || ' | ack: ' || e.note
         else f.ack end
   from fold f join mix e on e.vehicle_id = f.vehicle_id and e.m = f.m + 1""",
)
_cte(
    "act_ep",
    "fold",
    """select 'esc_' || vehicle_id || '_' || cast(epoch_us(episode) as varchar) || '000' as incident_id, vehicle_id,
   episode as first_trip, max(event_time) filter (is_trip) as last_trip, count(*) filter (is_trip) - 1 as retrip_count,
   arg_max(reasons, m) filter (is_trip) as reasons, arg_max(route, m) filter (is_trip) as route,
   arg_max(severity, m) filter (is_trip) as severity, max(event_time) filter (closing is not null) as resolved_at,
   max(closing) as resolve_reason, count(closing) = 0 as open, arg_max(ack, m) as ack
  from fold where episode is not null group by vehicle_id, episode""",
)

# --- drift --------------------------------------------------------------------------------

_z = {
    f: f"(({f} - {mean}) / {std})" for f, (mean, std) in settings.FEATURE_SCALE.items()
}
_NORM = "sqrt(" + " + ".join(f"{_z[f]} * {_z[f]}" for f in FEATURES) + ")"
_UNPIVOT = " union all ".join(
    [f"select {{keep}}, {_q(f)} as feature, {f} as value from {{src}}" for f in FEATURES]
    + [f"select {{keep}}, 'embedding' as feature, {_NORM} as value from {{src}}"]
)


def _ks(name: str, source: str) -> None:
    """KS statistic per feature between current and reference rows of ``source``."""
    _cte(
        f"{name}_gap",
        source,
        f"""select feature, n_current, n_reference, max(abs(ca / n_current - cb / n_reference)) as ks_statistic from (
   select feature, sum(a) over w as ca, sum(b) over w as cb, sum(a) over (partition by feature) as n_current,
     sum(b) over (partition by feature) as n_reference
   from (select feature, value, count(*) filter (current) as a, count(*) filter (not current) as b from {source} group by 1, 2)
   window w as (partition by feature order by value)) group by 1, 2, 3""",
    )
    # Both samples are large: the limiting critical value at 5 %.
    _cte(
        name,
        f"{name}_gap",
        f"""select *, ks_statistic > 1.3580986 * sqrt((n_current + n_reference) / (n_current * n_reference)) as drift_detected
   from {name}_gap""",
    )


_cte("dev_long", "val", _UNPIVOT.format(keep="device_type = 'DEVICE_TYPE_VEHICLE' as current", src="val"))
_ks("ks_dev", "dev_long")
_cte(
    "half_long",
    "val",
    _UNPIVOT.format(keep="event_time >= timestamp '2024-01-16' as current", src="val"),
)
_ks("ks_half", "half_long")
_cte(
    "line_long",
    "",
    """select l_returnflag = 'R' as current, 'quantity' as feature, l_quantity::double as value from lineitem
  union all select l_returnflag = 'R', 'price', l_extendedprice::double from lineitem""",
)
_ks("ks_line", "line_long")

_cte(
    "seq",
    "val",
    f"""select event_id, event_time, {', '.join(FEATURES)},
   cast(row_number() over (order by event_time, event_id) - 1 as bigint) as seq from val""",
)
_cte(
    "shift",
    "seq",
    f"""select event_id, event_time, speed_mph + case when epoch_us(event_time) >= (select epoch_us(min(event_time)) * 0.4e0 + epoch_us(max(event_time)) * 0.6e0 from seq)
     then 45.0 else 0.0 end as speed_mph, {', '.join(FEATURES[1:])}, seq from seq""",
)
# The smallest gap between 50 and 200 rows that is significant at 5 %: 43 of 200 steps.
_CRITICAL = 0.215


def _drift(name: str, source: str, stride: int) -> None:
    """Windows of 50 rows against the 200 baseline rows."""
    _cte(f"{name}_long", source, _UNPIVOT.format(keep="event_id, event_time, seq", src=source))
    _cte(f"{name}_base", f"{name}_long", f"select feature, value from {name}_long where seq between 200 and 399")
    _cte(
        f"{name}_live",
        f"{name}_long {name}_base",
        f"""select l.feature, l.seq - 400 as pos, l.value,
     (select count(*) from {name}_base b where b.feature = l.feature and b.value <= l.value) / 200 as at_,
     (select count(*) from {name}_base b where b.feature = l.feature and b.value < l.value) / 200 as below
   from {name}_long l where l.seq >= 400""",
    )
    _cte(
        f"{name}_win",
        source,
        f"""select (seq - 449) // {stride} as window_no, seq - 449 as first_pos, event_time as window_end, event_id as last_event
   from {source} where seq >= 449 and (seq - 449) % {stride} = 0""",
    )
    _cte(
        f"{name}_d",
        f"{name}_win {name}_live",
        f"""select window_no, feature, max(greatest(abs(upto / 50 - at_), abs((upto - same) / 50 - below))) as d from (
     select w.window_no, l.feature, l.at_, l.below,
       count(*) over (partition by w.window_no, l.feature order by l.value) as upto,
       count(*) over (partition by w.window_no, l.feature, l.value) as same
     from {name}_win w join {name}_live l on l.pos >= w.first_pos and l.pos < w.first_pos + 50) group by 1, 2""",
    )
    means = ", ".join(f"avg({_z[f]}) as z_{f}" for f in FEATURES)
    base = ", ".join(f"avg({_z[f]}) as b_{f}" for f in FEATURES)
    _cte(f"{name}_cen", source, f"select {base} from {source} where seq between 200 and 399")
    _cte(
        f"{name}_mean",
        f"{name}_win {source}",
        f"""select w.window_no, {means} from {name}_win w
   join {source} s on s.seq - 400 >= w.first_pos and s.seq - 400 < w.first_pos + 50 group by 1""",
    )
    scores = ", ".join(f"max(d) filter (feature = {_q(f)}) as {f}_score" for f in SCORED)
    flags = ", ".join(f"case when {f}_score > {_CRITICAL} - 1e-9 then {_q(f)} end" for f in SCORED)
    dot = " + ".join(f"z_{f} * b_{f}" for f in FEATURES)
    zz = " + ".join(f"z_{f} * z_{f}" for f in FEATURES)
    bb = " + ".join(f"b_{f} * b_{f}" for f in FEATURES)
    dd = " + ".join(f"(z_{f} - b_{f}) * (z_{f} - b_{f})" for f in FEATURES)
    _cte(f"{name}_wide", f"{name}_d", f"select window_no, {scores} from {name}_d group by 1")
    _cte(
        f"{name}_flag",
        f"{name}_wide {name}_win {name}_mean {name}_cen",
        f"""select w.window_end, w.last_event, s.*, list_filter([{flags}], lambda x: x is not null) as drifted,
    ({dot}) / (sqrt({zz}) * sqrt({bb})) as cosine_similarity, sqrt({dd}) as euclidean_distance
   from {name}_wide s join {name}_win w using (window_no) join {name}_mean m using (window_no) cross join {name}_cen""",
    )
    _cte(
        name,
        f"{name}_flag",
        f"""select *, len(drifted) as drifted_count, len(drifted) >= 2 as breached,
    len(drifted) >= 2 and not coalesce(lag(len(drifted) >= 2) over (order by window_no), false) as rising,
    cosine_similarity < 0.85 or euclidean_distance > 2.0 as centroid_drift from {name}_flag""",
    )


_drift("dw", "seq", 1)
_drift("tw", "seq", 50)
_drift("sw", "shift", 1)


def _windows_out(name: str) -> str:
    scores = ", ".join(f"round({f}_score, 6) as {f}_score" for f in SCORED)
    return _sql(
        name,
        f"""select window_no, {_at('window_end')} as window_end, {scores}, array_to_string(drifted, ',') as drifted_features,
 drifted_count, round(cosine_similarity, 6) as cosine_similarity, round(euclidean_distance, 6) as euclidean_distance,
 centroid_drift, breached, rising from {name}""",
    )


_SCORE_LIST = "[" + ", ".join(f"{f}_score" for f in SCORED) + "]"
_cte(
    "sig",
    "dw",
    f"""select window_end as generated_at, 50::bigint as window_size, speed_mph_score,
   len(list_filter({_SCORE_LIST}, lambda x: x > 0)) as drifted_feature_count, list_max({_SCORE_LIST}) as max_drift_score
  from dw where (window_no + 1) % 1500 = 0""",
)
_SIGNAL = f"""{_at('generated_at')} as generated_at, window_size, drifted_feature_count, round(max_drift_score, 6) as max_drift_score"""
_REASON = """case when max_drift_score >= 0.5 and drifted_feature_count >= 2 then 'score_and_feature_count'
  when max_drift_score >= 0.5 then 'max_drift_score' when drifted_feature_count >= 2 then 'drifted_feature_count'
  else 'below_threshold' end"""

# --- service levels -----------------------------------------------------------------------

_SIX = "time_bucket(interval '6 hours', {c}, timestamp '1970-01-01')"
_cte(
    "ratio6",
    "qa",
    f"""select {_SIX.format(c='event_time')} + interval 6 hour as at_time,
   count(*) filter (route = 'validated') / count(*) as value from qa group by 1""",
)
_cte(
    "openb",
    "slow",
    f"""select window_start, sum(change) over (order by window_start) as breakers_open, trips, trips / 21600 as breaker_trip_rate
  from (select {_SIX.format(c='event_time')} as window_start,
     sum(cast(state = 'open' as bigint) - cast(prior_state = 'open' as bigint)) as change,
     count(*) filter (tripped) as trips from slow group by 1)""",
)
_AVERAGE = "(" + " + ".join(f"{f}_score" for f in SCORED) + f") / {len(SCORED)}"
_cte(
    "samp",
    "ratio6 openb tw",
    f"""select 'qa_pass_ratio' as metric, at_time, value::double as value, value < 0.99 as breached from ratio6
  union all select 'breakers_open', window_start + interval 6 hour, breakers_open::double, breakers_open > 0 from openb
  union all select 'breaker_trip_rate', window_start + interval 6 hour, breaker_trip_rate::double, breaker_trip_rate > 0.05 from openb
  union all select 'drift_score_avg', window_end, {_AVERAGE}, {_AVERAGE} > 0.2 from tw""",
)

# --- frames -------------------------------------------------------------------------------

_cte(
    "rec",
    "tel",
    """select *, ((event_id * 37) % 360)::double as heading,
   cast(row_number() over (partition by user_id order by event_ts, event_id) - 1 as bigint) as frame_idx
  from tel""",
)
_cte(
    "agent",
    "rec",
    """select e.user_id as scenario, 'scn-' || e.user_id as scenario_id, e.frame_idx, e.event_ts as timestamp, s.slot,
   'VH-' || lpad(cast(a.user_id as varchar), 7, '0') as agent_id, case when s.slot = 0 then 'ego' else 'other' end as role,
   (a.gps_lon - (-79.9959)) * 111320.0 * cos(radians(40.4406)) as x, (a.gps_lat - 40.4406) * 111320.0 as y,
   sin(radians(a.heading) * 0.5) as qz, cos(radians(a.heading) * 0.5) as qw, a.speed_mph * 0.44704 as mps, a.speed_mph
  from rec e cross join (values (0), (1), (2)) s(slot)
  join rec a on a.user_id = e.user_id + s.slot and a.frame_idx = e.frame_idx""",
)
_cte(
    "frame",
    "agent",
    """select scenario_id, scenario, frame_idx, timestamp, count(*) as agents, max(x) filter (slot = 0) as x, max(y) filter (slot = 0) as y,
   max(qz) filter (slot = 0) as qz, max(qw) filter (slot = 0) as qw, max(agent_id) filter (slot = 0) as ego_vehicle_id,
   max(speed_mph) filter (slot = 0) as speed_mph from agent group by 1, 2, 3, 4""",
)
_SCENARIO = "['intersection', 'highway_merge', 'pedestrian_crossing', 'hard_brake'][cast(scenario % 4 + 1 as int)]"
_CAMERA = "substr(sha256(scenario_id || ':' || frame_idx || ':' || printf('%.2f', x) || ':' || printf('%.2f', y) || ':camera'), 1, 16)"
_LIDAR = "substr(sha256(scenario_id || ':' || frame_idx || ':' || (agents - 1 + 16) || ':lidar'), 1, 16)"
_BRIGHT = "round(0.35 + 0.5 * least(1.0::double, agents / 5.0::double) * (1.0 / (1.0 + abs(x) * 0.01)), 4)"

# --- text -----------------------------------------------------------------------------------

_SPACE = "'" + WHITE_SPACE.replace("'", "''") + "'"


def _chunk_ctes(prefix: str, source: str, text: str) -> None:
    _cte(
        f"{prefix}_sec",
        "",
        f"""select cast(doc_id as varchar) as stem, unnest(list_transform(parts, lambda x, i: {{'section': i - 1, 'raw': x}}), recursive := true)
    from (select doc_id, string_split(replace({text}, chr(10) || '## ', chr(1) || '## '), chr(1)) as parts from {source})""",
    )
    _cte(
        f"{prefix}_part",
        f"{prefix}_sec",
        f"select stem, section, trim(raw, {_SPACE}) as part from {prefix}_sec where length(trim(raw, {_SPACE})) > 0",
    )
    _cte(
        prefix,
        f"{prefix}_part",
        f"""select stem || '-' || section || '-' || k as chunk_id, substring(part, k * 1200 + 1, 1200) as text, stem as title
    from (select *, unnest(range((length(part) - 1) // 1200 + 1)) as k from {prefix}_part)""",
    )


_chunk_ctes("chunk", "documents", "text")
_chunk_ctes("edited", "documents where lang = 'en'", "'Second edition. ' || text")

def _embedding_ctes(prefix: str, source: str, key: str) -> None:
    """The digest chain by recursion, its 32-bit words, and the vector of each text."""
    _cte(
        f"{prefix}_chain",
        source if source in _CTE else "",
        f"""select {key} as id, 0 as i, sha256(text) as seed from {source}
   union all select id, i + 1, sha256(unhex(seed)) from {prefix}_chain where i < 48""",
    )
    _cte(
        f"{prefix}_word",
        f"{prefix}_chain",
        f"""select id, (i - 1) * 8 + j as dim,
    (('0x' || substr(seed, cast(j * 8 + 1 as bigint), 8))::ubigint)::double / 4294967295.0 * 2.0 - 1.0 as v
   from {prefix}_chain cross join range(8) r(j) where i > 0""",
    )
    _cte(
        f"{prefix}_vec", f"{prefix}_word", f"select id, list(v order by dim) as v from {prefix}_word group by id"
    )


_embedding_ctes("c", "chunk", "chunk_id")
_embedding_ctes("b", "benchmark", "item_id")

ORACLES: dict[str, str] = {}
_o = ORACLES

_o["normalize_structural"] = _sql(
    "norm",
    f"""select event_id, {_at('event_ts')} as rejected_at, 'telemetry.raw' as source_topic, vehicle_id,
 case issue when 'empty_vehicle_id' then 'vehicle_id' else 'timestamp' end as field,
 case issue when 'empty_vehicle_id' then 'required_nonempty' else 'iso8601' end as rule,
 case issue when 'empty_vehicle_id' then 'vehicle_id is empty' else 'timestamp is missing or unparseable' end as reason,
 1::bigint as n_violations from norm where issue is not null""",
)
_o["normalized_records"] = _sql(
    "acc",
    """select event_id, vehicle_id, trip_id, strftime(event_time, '%Y-%m-%dT%H:%M:%S.%f') || '+00:00' as timestamp,
 gps_lat, gps_lon, speed_mph from acc""",
)
_o["timestamp_forms"] = f"""select event_id,
 case event_id % 3 when 0 then strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') || 'Z'
   when 1 then cast(epoch_us(ts) // 1000000 as varchar) else cast(epoch_us(ts) // 1000 as varchar) end as form,
 case event_id % 3 when 0 then {_at('ts')} when 1 then {_at("date_trunc('second', ts)")}
   else {_at("date_trunc('millisecond', ts)")} end as instant from events"""
_o["enum_aliases"] = _sql(
    "tel",
    """select event_id, sensor_status, case when event_id % 5 = 0 then 'DEVICE_TYPE_UNSPECIFIED' else device_type end as device_type from tel""",
)
_o["qa_route_counts"] = _sql(
    "norm qa win",
    """select (select count(*) from norm) as consumed, (select count(issue) from norm) as structural_failures,
 0::bigint as decode_failures, (select count(*) from qa where route = 'validated') as validated,
 (select count(*) from qa where route = 'quarantine') as quarantined, (select count(*) from win) as metrics_emitted""",
)
_o["qa_violations"] = _sql(
    "qa",
    """select event_id, p - 1 as position, violations[p].field as field, violations[p].rule as rule, violations[p].message as message
 from (select event_id, violations, unnest(range(1, len(violations) + 1)) as p from qa)""",
)
_o["quarantine_records"] = _sql(
    "qrec",
    f"""select event_id, {_at('rejected_at')} as rejected_at, source_topic, vehicle_id, field, rule, reason,
 len(violations) as n_violations, trip_id as payload_trip from qrec""",
)
_o["batch_contract_triage"] = _sql(
    "tri",
    """select event_id, len(broken) = 0 as accepted,
 case when len(broken) > 0 then array_to_string(list_transform(broken, lambda v: v.field || ': ' || v.rule), '; ') end as rejection_reason,
 case when len(broken) > 0 then 'pandera_schema_error' end as corruption_type from tri""",
)
_o["batch_rejection_gate"] = _sql(
    "tri",
    """select count(*) as total_count, count(*) filter (len(broken) = 0) as valid_count, count(*) filter (len(broken) > 0) as rejected_count,
 round(count(*) filter (len(broken) > 0) / count(*), 6) as rejection_rate,
 count(*) filter (len(broken) > 0) / count(*) <= 0.2 as publish from tri""",
)
_o["producer_contract"] = _sql(
    "tel",
    f"""select event_id, len(v) = 0 as accepted, array_to_string(list_transform(v, lambda x: x.field), ',') as fields
 from (select event_id, {_list(_ALL_RULES)} as v from tel)""",
)
_o["incident_contract"] = _sql(
    "inc",
    """select incident_id, observed_value > 1 as accepted,
 case observed_value when 0 then 'enum:IncidentSeverity' when 1 then 'required_nonempty' else '' end as rules from inc""",
)
_PRESENT = {
    f: f"nullif({f}, '') is not null" for f in ("vehicle_id", "trip_id", "hardware_version", "timestamp")
}
_o["contract_coverage"] = _sql(
    "tel",
    " union all ".join(
        f"select {_q(f)} as field, true as in_contract, count(*) filter ({_PRESENT.get(f, 'true')}) as present,"
        f" count(*) - count(*) filter ({_PRESENT.get(f, 'true')}) as missing from tel"
        for f in settings.TELEMETRY_FIELDS
    )
    + " union all select 'extra_key', false, count(*) filter (event_id % 10 = 0), 0 from tel",
)

_o["qa_window_rate"] = _sql(
    "win",
    f"""select vehicle_id, window_no, total, quarantined, quarantine_rate, exceeded, {_at('window_end')} as window_end from win""",
)
_o["stream_qa_window"] = _o["qa_window_rate"]
_o["qa_rolling"] = _sql(
    "roll", "select vehicle_id, window_no, round(rolling_rate, 6) as rolling_rate, batch_count, streak from roll"
)
_o["policy_decisions"] = _sql(
    "dec",
    f"""select vehicle_id, {_at('event_time')} as event_time, kind, ref, round(rolling_rate, 6) as rolling_rate, batch_count,
 streak, drift_count, trip, severity, route, array_to_string(reasons, '; ') as reasons from dec""",
)
_TIMELINE = f"""vehicle_id, {_at('event_time')} as event_time, ref, prior_state, state, tripped, recovered, trip_count,
 {_at('opened_at')} as opened_at"""
_o["breaker_timeline"] = _sql("brk", f"select {_TIMELINE} from brk")
_o["breaker_timeline_slow"] = _sql("slow", f"select {_TIMELINE} from slow")
_o["stream_breaker"] = _sql(
    "slow",
    f"""select vehicle_id, {_at('event_time')} as event_time, ref, prior_state, state, tripped, recovered, trip_count,
 {_at('first_trip')} as first_trip, case when first_trip is null then 0 else retrips end as retrip_count, route from slow""",
)
for _name, _moment in (("breaker_snapshot", "2024-01-31"), ("breaker_snapshot_midway", "2024-01-10")):
    _o[_name] = _sql(
        "slow",
        f"""select vehicle_id, state, (case state when 'closed' then 0 when 'half_open' then 1 else 2 end)::bigint as state_code, trip_count,
 {_at('event_time')} as last_event from (
  select vehicle_id, trip_count, event_time,
    case when state = 'open' and timestamp '{_moment}' - opened_at >= interval 2 day then 'half_open' else state end as state
  from slow where event_time <= timestamp '{_moment}'
  qualify row_number() over (partition by vehicle_id order by n desc) = 1)""",
    )
_o["incident_episodes"] = _sql("brk_ep", f"select {_EPISODE} from brk_ep")
_o["stream_episodes"] = _o["incident_episodes"]
_o["stream_breaker_snapshot"] = _o["breaker_snapshot"]
_o["incident_actions"] = _sql(
    "act_ep",
    f"""select incident_id, vehicle_id, case when not open then 'resolved' when ack <> '' then 'acknowledged' else 'open' end as status,
 severity, route, {_at('first_trip')} as first_trip, {_at('last_trip')} as last_trip, {_at('resolved_at')} as resolved_at,
 resolve_reason, retrip_count, open,
 case when retrip_count > 0 then 'Circuit breaker still open for ' || vehicle_id || ' (retrip ' || retrip_count || '): '
       else 'Circuit breaker tripped for ' || vehicle_id || ': ' end || '[' || array_to_string(reasons, ' ') || ']' || ack as summary
 from act_ep""",
)
_o["incident_action_outcomes"] = _sql(
    "act act_ep",
    f"""select a.incident_id, a.action, {_at('a.action_at')} as action_at,
 case when e.incident_id is null then 'not_found' when e.resolved_at < a.action_at and a.action = 'acknowledge' then 'already_resolved'
   when e.resolved_at < a.action_at then 'unchanged' else 'ok' end as outcome
 from act a left join act_ep e using (incident_id)""",
)
_o["incident_list"] = _sql(
    "slow_ep",
    """select incident_id, vehicle_id, status, retrip_count, count(*) over () as full_count from slow_ep
 where status = 'resolved' and upper(vehicle_id) = 'VH-0000000' order by first_trip limit 50""",
)
_SYMBOLS = """'INCIDENT_SEVERITY_' || upper(severity) as severity, 'INCIDENT_STATUS_' || upper(status) as status, summary as reason"""
_o["incident_summary"] = _sql("slow_ep", f"select incident_id, vehicle_id, {_SYMBOLS} from slow_ep")
_cte(
    "hist",
    "inc slow_ep",
    f"""select incident_id, vehicle_id, severity, status, 'distribution drift' as reason, source_service, observed_value from inc
  union all select incident_id, vehicle_id, {_SYMBOLS}, null, null from slow_ep""",
)
_o["incident_history"] = _sql("hist", "select * from hist")
_o["incident_chunks"] = _sql(
    "hist",
    """select 'inc-' || incident_id as chunk_id, incident_id, vehicle_id, severity, reason, vehicle_id as text_vehicle,
 status as text_status, 'incident_id,observed_value,reason,severity,source_service,status,vehicle_id' as text_keys from hist""",
)
_o["notifications"] = _sql(
    "slow_ep",
    """select incident_id, target, case when target = 'slack' then '#fleet-alerts' end as channel,
 case when target = 'slack' and retrip_count = 0 then ':rotating_light: *Fleet Incident* | vehicle `' || vehicle_id || '` | ' || severity || ' | reasons=' || array_to_string(reasons, '; ')
   when target = 'slack' then '[UPDATED x' || retrip_count || '] :rotating_light: *Fleet Incident* (ongoing) | vehicle `' || vehicle_id || '` | ' || severity || ' | reasons=' || array_to_string(reasons, '; ') || ' | id=`' || incident_id || '`' end as text,
 case when target = 'pagerduty' then case when retrip_count > 0 then '[UPDATED x' || retrip_count || '] ' else '' end || summary end as summary,
 case when target = 'pagerduty' then severity end as severity, case when target = 'pagerduty' then incident_id end as dedup_key
 from (select *, unnest(case route when 'pagerduty' then ['pagerduty'] when 'both' then ['slack', 'pagerduty'] else ['slack'] end) as target from slow_ep)""",
)

_STATS = ", ".join(
    f"round(avg({f}), 6) as {f}_mean, round(stddev_pop({f}), 6) as {f}_std,"
    f" round(quantile_cont({f}, 0.5), 6) as {f}_p50, round(quantile_cont({f}, 0.95), 6) as {f}_p95"
    for f in FEATURES
)
_o["feature_stats"] = _sql("val", f"select device_type, count(*) as row_count, {_STATS} from val group by 1")
_cte(
    "daily",
    "val",
    """select device_type, cast(event_time as date) + interval 1 day as computed_at, count(*) as row_count,
   avg(speed_mph) as speed_mph_mean, quantile_cont(speed_mph, 0.95) as speed_mph_p95
  from val group by device_type, cast(event_time as date)""",
)
_o["feature_asof"] = _sql(
    "val daily",
    f"""select v.event_id, case when live then {_at('s.computed_at')} end as computed_at, case when live then row_count else 0 end as row_count,
 case when live then round(speed_mph_mean, 6) end as speed_mph_mean, case when live then round(speed_mph_p95, 6) end as speed_mph_p95
 from (select v.event_id, s.*, s.computed_at is not null and v.event_time <= s.computed_at + interval 7 day as live
   from val v asof left join daily s on v.device_type = s.device_type and v.event_time >= s.computed_at) s join val v using (event_id)""",
)
_o["quarantine_audit"] = _sql(
    "qrec",
    " union all ".join(
        f"""select * from (select {_q(d)} as dimension, {d} as key, count(*) as count,
   row_number() over (order by count(*) desc, {d}) as rank from qrec where {d} is not null group by {d}) where rank <= 10"""
        for d in ("reason", "field", "vehicle_id")
    )
    + """ union all select 'source_topic', source_topic, count(*), 0 from qrec group by source_topic
  union all select 'total', 'all', count(*), 0 from qrec""",
)
_o["reason_histogram"] = _sql(
    "qrec", "select reason, count(*) as n from qrec group by 1 order by 2 desc, 1 limit 20"
)
_o["lifetime_pass_ratio"] = _sql(
    "qa",
    """select count(*) filter (route = 'validated') as validated, count(*) filter (route = 'quarantine') as quarantined,
 round(count(*) filter (route = 'validated') / count(*), 6) as pass_ratio from qa""",
)
_o["latest_telemetry"] = _sql(
    "val",
    f"""select vehicle_id, speed_mph, gps_lat, gps_lon, {_at('event_time')} as timestamp from val order by event_time desc, vehicle_id, event_id limit 50""",
)
_o["device_recent"] = _sql(
    "val",
    f"""select vehicle_id, speed_mph, device_type, {_at('event_time')} as timestamp from val
 where device_type = 'DEVICE_TYPE_SIMULATOR' order by event_time desc, vehicle_id, event_id limit 10""",
)
_o["day_counts"] = _sql(
    "val", "select count(*) as events from val where cast(event_time as date) = date '2024-01-15'"
)
_o["vehicle_slice"] = _sql(
    "val",
    f"""select event_id, vehicle_id, {_at('event_time')} as timestamp, speed_mph from val
 where vehicle_id = 'VH-0000007' and event_time > timestamp '2024-01-10'""",
)
_o["retention"] = _sql(
    "tw", "select window_no, row_number() over (order by window_end desc, window_no desc) > 48 as expired from tw"
)
_o["incident_retention"] = _sql(
    "slow_ep",
    "select incident_id, row_number() over (order by first_trip desc, incident_id desc) > 500 as expired from slow_ep",
)

_KS = "feature, n_current::bigint as n_current, n_reference::bigint as n_reference, round(ks_statistic, 6) as ks_statistic, drift_detected"
_o["ks_features"] = _sql("ks_dev", f"select {_KS} from ks_dev")
_o["ks_order_lines"] = _sql("ks_line", f"select {_KS} from ks_line")
_o["ks_p_values"] = _sql(
    "ks_line",
    """select feature, round(ks_statistic, 6) as ks_statistic, round(case when lam < 0.2 then 1e0 else greatest(0e0, least(1e0,
 2 * list_sum(list_transform(generate_series(1, 100), lambda k: (case when k % 2 = 1 then 1e0 else -1e0 end) * exp(-2e0 * k * k * lam * lam)))
 )) end, 9) as p_value
 from (select *, sqrt(n_current::double * n_reference / (n_current + n_reference)) * ks_statistic as lam from ks_line)""",
)
_o["column_drift"] = _sql(
    "ks_half",
    "select feature, round(ks_statistic, 6) as drift_score, drift_detected from ks_half where feature <> 'embedding'",
)
_cte(
    "sim_long",
    "val",
    _UNPIVOT.format(keep="device_type = 'DEVICE_TYPE_SIMULATOR' as current", src="val"),
)
_ks("ks_sim", "sim_long")
_o["column_drift_share"] = _sql(
    "ks_sim",
    "select count(*) filter (drift_detected) / count(*) as share_of_drifted_columns from ks_sim where feature <> 'embedding'",
)
_MEANS = ", ".join(
    f"avg({_z[f]}) filter (event_time >= timestamp '2024-01-16') as a_{f}, avg({_z[f]}) filter (event_time < timestamp '2024-01-16') as b_{f}"
    for f in FEATURES
)
_cte("cent", "val", f"select {_MEANS} from val")
_COS = (
    "(" + " + ".join(f"a_{f} * b_{f}" for f in FEATURES) + ") / (sqrt("
    + " + ".join(f"a_{f} * a_{f}" for f in FEATURES) + ") * sqrt("
    + " + ".join(f"b_{f} * b_{f}" for f in FEATURES) + "))"
)
_EUC = "sqrt(" + " + ".join(f"(a_{f} - b_{f}) * (a_{f} - b_{f})" for f in FEATURES) + ")"
_o["embedding_centroids"] = _sql(
    "cent",
    f"""select round({_COS}, 6) as mean_cosine_similarity, round({_EUC}, 6) as mean_euclidean_distance,
 {_COS} < 0.85 or {_EUC} > 2.0 as drift_detected from cent""",
)
_o["drift_windows"] = _windows_out("dw")
_o["stream_drift"] = _o["drift_windows"]
_o["drift_windows_tumbling"] = _windows_out("tw")
_o["drift_windows_shifted"] = _windows_out("sw")
_o["drift_incidents"] = _sql(
    "dw",
    f"""select 'drift-' || substr(sha256('drift|' || window_no), 1, 12) as incident_id, 'INCIDENT_SEVERITY_CRITICAL' as severity,
 'drifted_feature_count' as metric_name, 2.0::double as threshold, drifted_count::double as observed_value,
 {_at('window_end')} as event_time, array_to_string(drifted, ',') as drifted_features from dw where rising""",
)
_o["drift_every_n"] = _sql(
    "dw", f"select window_no, {_at('window_end')} as window_end from dw where (window_no + 1) % 1500 = 0"
)
_o["baseline_staleness"] = _sql(
    "seq",
    """select event_id, seq, case when seq < 200 then 'warmup' when seq < 400 then 'baseline' else 'live' end as phase,
 case when seq < 400 then 0.0::double else round((epoch_us(event_time) - (select epoch_us(event_time) from seq where seq = 399)) / 1e6, 6) end as staleness_seconds
 from seq""",
)
_o["drift_score_average"] = _sql("dw", f"select window_no, round({_AVERAGE}, 6) as drift_score_avg from dw")
_o["latest_signal"] = _sql("sig", f"select {_SIGNAL} from sig order by sig.generated_at desc limit 1")
_o["retrain_decision"] = _sql(
    "sig",
    f"select {_SIGNAL}, sig.max_drift_score >= 0.5 or drifted_feature_count >= 2 as should_retrain, {_REASON.replace('max_drift_score >=', 'sig.max_drift_score >=')} as reason from sig",
)
_o["retrain_without_signal"] = _sql(
    "sig",
    """select count(*) filter (max_drift_score > 1.0) > 0 as should_retrain, 'no_evidently_signal' as reason, 0.0::double as max_drift_score,
 count(*) filter (max_drift_score > 1.0) as drifted_feature_count from sig""",
)
_o["retrain_latest"] = _sql(
    "sig",
    f"""select coalesce(max(max_drift_score >= 0.5 or drifted_feature_count >= 2), false) as should_retrain,
 coalesce(max({_REASON}), 'no_evidently_signal') as reason, coalesce(round(max(max_drift_score), 6), 0.0) as max_drift_score,
 coalesce(max(drifted_feature_count), 0)::bigint as drifted_feature_count
 from sig where generated_at = (select max(generated_at) from sig)""",
)
_o["retrain_runs"] = _sql(
    "sig",
    f"""select 'retrain-' || substr(sha256('retrain|' || epoch_us(generated_at)), 1, 12) as trigger_id, 'retraining_triggered' as event_type,
 {_at('generated_at')} as triggered_at, {_REASON} as trigger_reason, round(speed_mph_score, 6) as speed_score
 from sig where max_drift_score >= 0.5 or drifted_feature_count >= 2""",
)

_FIVE = "time_bucket(interval '5 minutes', event_time, timestamp '1970-01-01')"
_o["pass_ratio_5m"] = _sql(
    "qa",
    f"""select {_at(_FIVE)} as window_start, count(*) filter (route = 'validated') as validated,
 count(*) filter (route = 'quarantine') as quarantined, round(count(*) filter (route = 'validated') / count(*), 6) as pass_ratio
 from qa group by {_FIVE}""",
)
_TWO = "time_bucket(interval '2 seconds', event_time, timestamp '1970-01-01')"
_o["throughput_2s"] = _sql(
    "acc",
    f"select {_at('t')} as window_start, n as events, n / 2 as per_second from (select {_TWO} as t, count(*) as n from acc group by 1 order by 1 desc limit 40)",
)
_RATES = [
    ("escalations_5m", "5 minutes", 300, "slow", "'all'", "tripped"),
    ("escalations_15m", "15 minutes", 900, "slow", "'all'", "tripped"),
    ("ingest_2m", "2 minutes", 120, "qa", "'all'", "true"),
    ("qa_records_1m", "1 minute", 60, "qa", "route", "true"),
    ("incident_events_5m", "5 minutes", 300, "inc", "'all'", "true"),
]
_o["operational_rates"] = _sql(
    "slow qa inc",
    " union all ".join(
        f"""select '{name}' as rate, {_at('t')} as window_start, result, n as events, round(n / {seconds}, 9) as per_second
 from (select time_bucket(interval '{width}', event_time, timestamp '1970-01-01') as t, {key} as result, count(*) as n
   from {source} where {cond} group by 1, 2)"""
        for name, width, seconds, source, key, cond in _RATES
    ),
)
_o["open_breakers"] = _sql(
    "openb",
    f"select {_at('window_start')} as window_start, breakers_open::bigint as breakers_open, trips, round(breaker_trip_rate, 9) as breaker_trip_rate from openb",
)
_o["latency_quantiles"] = f"""select {_at('t')} as window_start, round(p50, 6) as p50, round(p95, 6) as p95 from (
 select {_SIX.format(c='ts')} as t, quantile_cont(value, 0.5) as p50, quantile_cont(value, 0.95) as p95 from events group by 1)"""
_LE = "[0.005, 0.01, 0.025, 0.05, 0.1, 0.25, 0.5, 1.0, 2.5, 5.0, 10.0]::double[]"
_o["latency_buckets"] = f"""with v as (select {_SIX.format(c='ts')} as t, value / 10e0 as s from events where value is not null),
le as (select unnest({_LE}) as b, generate_subscripts({_LE}, 1) as i),
h as (select t, i, b, lag(b, 1, 0e0) over (partition by t order by i) as low, n, lag(n, 1, 0) over (partition by t order by i) as n0, total
 from (select t, i, b, count(*) filter (s <= b) as n, count(*) as total from v cross join le group by all)),
q as (select t, p, min(total) as total, coalesce(min_by(low + (b - low) * (p * total - n0) / nullif(n - n0, 0), i) filter (n >= p * total), 10e0) as x
 from h cross join (select unnest([0.5e0, 0.95e0]) as p) group by t, p)
select {_at('t')} as window_start, min(total) as total, round(min(x) filter (p = 0.5e0), 6) as p50,
 round(min(x) filter (p = 0.95e0), 6) as p95 from q group by t"""
_o["sustained_alerts"] = _sql(
    "samp",
    f"""select case metric when 'qa_pass_ratio' then 'QAPassRateSLOBreach' when 'drift_score_avg' then 'DriftScoreElevated'
   when 'breakers_open' then 'CircuitBreakerOpen' else 'EscalationStorm' end as alert,
 case when metric in ('qa_pass_ratio', 'drift_score_avg') then 'warning' else 'critical' end as severity,
 {_at('a')} as active_since, {_at('b')} as last_breached, samples, round(v, 6) as value
 from (select metric, run, min(at_time) as a, max(at_time) as b, count(*) as samples, arg_max(value, at_time) as v from (
   select *, count(*) filter (not breached) over (partition by metric order by at_time) as run from samp) where breached group by 1, 2)
 where b - a >= interval 1 day""",
)
_cte(
    "newest",
    "samp",
    "select metric, arg_max(value, at_time) as value, arg_max(breached, at_time) as breached from samp group by 1",
)
_o["slo_report"] = _sql(
    "newest",
    """select 'BREACH' as status, metric, case metric when 'qa_pass_ratio' then printf('QA pass ratio %.4f below 0.99 SLO', value)
   when 'drift_score_avg' then printf('Drift score %.4f exceeds 0.2 warning threshold', value)
   when 'breakers_open' then cast(value as bigint) || ' circuit breaker(s) OPEN'
   else printf('Escalation storm: trip rate %.4f/s', value) end as line from newest where breached
 union all select 'CLEAR', 'all', 'no SLO / drift / breaker breaches detected' where not exists (select 1 from newest where breached)""",
)

_o["frame_geometry"] = _sql(
    "agent",
    """select scenario_id, frame_idx, agent_id, role, round(x, 6) as x, round(y, 6) as y, round(qz, 6) as qz, round(qw, 6) as qw,
 round(mps, 6) as mps from agent""",
)
_o["lidar_returns"] = _sql(
    "agent frame",
    """select scenario_id, frame_idx, point, round(rng, 3) as range_m, round(degrees(atan2(dy, dx)), 2) as azimuth_deg,
   0.0::double as elevation_deg, round(greatest(0.05, 1.0 / (1.0 + rng * 0.05)), 3) as intensity
 from (select *, sqrt(dx * dx + dy * dy) as rng from (
   select a.scenario_id, a.frame_idx, row_number() over (partition by a.scenario_id, a.frame_idx order by a.slot) - 1 as point,
     a.x - f.x as dx, a.y - f.y as dy from agent a join frame f using (scenario_id, frame_idx) where a.slot > 0))
 union all
 select scenario_id, frame_idx, agents - 1 + i, 20.0, i * 22.5, -5.0, 0.2 from frame cross join range(16) r(i)""",
)
_o["sensor_fusion"] = _sql(
    "frame",
    f"""select scenario_id, {_at('timestamp')} as timestamp, {_SCENARIO} as scenario_type, frame_idx, ego_vehicle_id,
 {_CAMERA} as camera_digest, {_LIDAR} as lidar_digest, {_BRIGHT} as camera_mean_intensity, agents - 1 + 16 as lidar_n_points,
 'classical_proxy' as renderer_backend from frame""",
)
_o["calibration_fusion"] = _sql(
    "frame",
    f"""select scenario_id, frame_idx, {_at('timestamp')} as timestamp, 57.6::double as fx, 43.2::double as fy, 32.0::double as cx,
 24.0::double as cy, round(degrees(atan2(qz, qw) * 2.0), 6) as camera_yaw, 16::bigint as beams, 1.8::double as lidar_tz from frame""",
)
_o["fusion_gaps"] = _sql(
    "frame", f"select scenario_id, {_at('timestamp')} as timestamp from frame where speed_mph < 5.0"
)

_o["doc_chunks"] = _sql("chunk", "select chunk_id, text, title from chunk")
_o["chunk_upsert"] = _sql(
    "chunk edited",
    """select chunk_id, sha256(chunk_id) as point_id, coalesce(e.text, c.text) as text,
 (case when e.chunk_id is null then 1 else 2 end)::bigint as version from chunk c full join edited e using (chunk_id)""",
)
_o["hash_embed"] = _sql(
    "c_word",
    """select id as chunk_id, 384::bigint as dim, """
    + ", ".join(f"round(max(v) filter (dim = {i}) / n, 6) as v{i}" for i in (0, 1, 7, 8, 200, 383))
    + """, round(sum(v) / n, 6) as total from c_word join (select id, sqrt(sum(v * v)) as n from c_word group by 1) using (id)
 group by id, n""",
)
_o["retrieval"] = _sql(
    "c_vec b_vec chunk",
    """select query_id, item_id, round(score, 6) as score, rank, title from (
  select query_id, item_id, score, row_number() over (partition by query_id order by round(score, 12) desc, item_id) as rank
  from (select b.id as query_id, c.id as item_id, list_cosine_similarity(b.v, c.v) as score from b_vec b cross join c_vec c))
 join chunk on chunk_id = item_id where rank <= 4""",
)
_o["vector_topk"] = """select query_id, item_id, round(score, 6) as score, rank from (
 select q.vec_id as query_id, i.vec_id as item_id, list_cosine_similarity(q.embedding::double[], i.embedding::double[]) as score,
  row_number() over (partition by q.vec_id order by round(list_cosine_similarity(q.embedding::double[], i.embedding::double[]), 12) desc, i.vec_id) as rank
 from embeddings q join embeddings i on q.vec_id <> i.vec_id) where rank <= 5"""
# The share of hits that the approximate search has to find is a promise, so it is stated here.
_o["vector_recall"] = """select count(*) as queries, count(*) * least(5, count(*) - 1) as wanted, true as recall_reached
 from embeddings where embedding is not null"""
_INJECTION = _q(tx.any_injection())
_WRAPPER = _q(tx.WRAPPER.removeprefix("(?is)"))
_o["injection_filter"] = f"""select conv_id, turn, reason is null as ok, reason,
 case when reason is null then trim(regexp_replace(q, {_WRAPPER}, '', 'gis'), {_SPACE}) end as sanitized from (
  select conv_id, turn, q, case when length(q) = 0 then 'empty question' when length(q) > 2000 then 'question exceeds 2000 characters'
    when regexp_matches(q, {_INJECTION}) then 'prompt injection pattern rejected' end as reason
  from (select conv_id, turn, trim(coalesce(text, ''), {_SPACE}) as q from conversations))"""
_o["vehicle_mentions"] = _sql(
    "tel",
    """select event_id, case when vehicle_id like 'VH-%' then 'VH-' || lpad(cast(user_id as varchar), cast(greatest(4, length(cast(user_id as varchar))) as int), '0') end as vehicle_id from tel""",
)
_o["guarded_sql"] = _sql(
    "val qrec",
    """select device_type, count(*) as records, round(avg(speed_mph), 6) as mean_speed, (select count(*) from qrec) as rejected
 from val group by 1""",
)

_o["lake_roundtrip"] = _sql(
    "val",
    f"""select event_id, vehicle_id, {_at('event_time')} as timestamp, speed_mph, device_type,
 cast(cast(event_time as date) as varchar) as event_day from val""",
)
_o["stream_lake"] = _sql(
    "val",
    f"""select event_id, vehicle_id, {_at('event_time')} as timestamp, device_type, cast(cast(event_time as date) as varchar) as event_day from val""",
)
_o["lake_map_errors"] = _sql(
    "norm",
    """select count(*) as consumed, count(*) filter (event_time is not null) as appended, count(*) filter (event_time is null) as map_errors from norm""",
)
_o["quarantine_roundtrip"] = _sql(
    "qrec",
    f"""select event_id, {_at('rejected_at')} as rejected_at, vehicle_id, field, reason, rule, hardware_version,
 cast(cast(rejected_at as date) as varchar) as reject_day from qrec""",
)
_o["recent_quarantine"] = _sql(
    "qrec",
    f"""select {_at('rejected_at')} as rejected_at, vehicle_id, field, rule, reason from qrec order by qrec.rejected_at desc, vehicle_id, event_id limit 20""",
)
_o["frame_tables_roundtrip"] = _sql(
    "frame",
    f"""select scenario_id, {_at('timestamp')} as timestamp, {_SCENARIO} as scenario_type, frame_idx::double as frame_idx, 40.4406::double as origin_lat,
 cast(cast(timestamp as date) as varchar) as event_day, (agents - 1 + 16)::double as lidar_n_points, {_CAMERA} as camera_digest, 32.0::double as cx from frame""",
)
_o["batch_publish"] = _sql(
    "tri",
    """select event_id, case when len(broken) = 0 then 'published' else 'dead_letter' end as outcome,
 case when len(broken) > 0 then array_to_string(list_transform(broken, lambda v: v.field || ': ' || v.rule), '; ') end as reason from tri""",
)
_o["snapshot_read"] = _sql(
    "val",
    """select device_type, count(*) as records, max(case when event_time < timestamp '2024-01-11' then 1 else 2 end)::bigint as newest_commit
 from val where event_time < timestamp '2024-01-21' group by 1""",
)
_o["gold_artifacts"] = _sql(
    "val",
    """select device_type, count(*) as row_count, count(*) as json_rows, round(quantile_cont(speed_mph, 0.5), 6) as speed_mph_p50 from val group by 1""",
)
_o["stream_normalize"] = _sql(
    "norm",
    """select event_id, vehicle_id, case when issue is null then 'normalized' else 'quarantine' end as topic,
 case issue when 'empty_vehicle_id' then 'required_nonempty' when 'unparseable_timestamp' then 'iso8601' end as rule from norm""",
)
_o["stream_route_counts"] = _sql(
    "norm qa",
    """select (select count(*) from norm) as consumed, (select count(issue) from norm) as structural_failures,
 0::bigint as decode_failures, count(*) filter (route = 'validated') as validated,
 count(*) filter (route = 'quarantine') as quarantined, count(*) filter (route = 'validated') as appended,
 0::bigint as map_errors from qa""",
)
_o["stream_qa"] = _sql(
    "qa",
    "select event_id, case when route = 'validated' then 'validated' else 'quarantine' end as topic, violations[1].message as reason from qa",
)
_o["stream_pass_ratio"] = _sql(
    "qa",
    f"""select {_at('t')} as window_start, count(*) filter (route = 'validated') as validated, count(*) filter (route = 'quarantine') as quarantined
 from (select {_SIX.format(c='event_time')} as t, route from qa) group by t""",
)

# --- messages -----------------------------------------------------------------------------

_cte(
    "msg0",
    "tel",
    """select * exclude (lidar_temp_c, brake_pressure), brake_pressure as brake0, lidar_temp_c as lidar0,
 '{"vehicle_id":"' || vehicle_id || '","trip_id":"' || trip_id || '","timestamp":"' || timestamp
  || '","gps_lat":' || case when event_id % 107 = 0 then '"north"' else cast(gps_lat as varchar) end
  || ',"gps_lon":' || cast(gps_lon as varchar)
  || ',"speed_mph":' || case when event_id % 103 = 0 then '"fast"' else cast(speed_mph as varchar) end
  || ',"brake_pressure":' || case when event_id % 113 = 0 then '"0.5"' else cast(brake_pressure as varchar) end
  || ',"lidar_temp_c":' || case when event_id % 109 = 0 then '"hot"' else cast(lidar_temp_c as varchar) end
  || ',"compute_load_pct":' || cast(compute_load_pct as varchar)
  || ',"sensor_status":"' || sensor_status || '","hardware_version":"' || hardware_version
  || '","device_type":"' || device_type || case when event_id % 127 = 0 then '","operator":"x"}' else '"}' end as whole from tel""",
)
_cte(
    "msg",
    "msg0",
    """select * exclude (event_id), event_id % 101 = 0 as raw, case when event_id % 101 = 0 then left(whole, 40) else whole end as payload,
 md5(case when event_id % 101 = 0 then left(whole, 40) else whole end) as event_id,
 event_id % 107 = 0 as bad_gps, event_id % 103 = 0 as bad_speed,
 case when event_id % 113 = 0 then 0.5e0 else brake0 end as brake_pressure,
 case when event_id % 109 <> 0 then lidar0 end as lidar_temp_c,
 case when event_id % 109 = 0 then 'hot' else cast(lidar0 as varchar) end as lidar_text from msg0""",
)
_cte(
    "mnorm",
    "msg",
    """select *, try_cast(replace(timestamp, 'Z', '') as timestamp) as event_time, case when raw then 'decode_failed'
   when trim(vehicle_id) = '' then 'empty_vehicle_id'
   when try_cast(replace(timestamp, 'Z', '') as timestamp) is null then 'unparseable_timestamp'
   when bad_gps then 'non_numeric_gps' when bad_speed then 'non_numeric_speed' end as issue from msg""",
)
_LIDAR_TYPE = _v(
    "lidar_temp_c is null", "lidar_temp_c", "type:float", "'lidar_temp_c must be numeric, got ' || " + _quoted("lidar_text")
)
_MESSAGE_RULES = [_VEHICLE, _TRIP, *_TIME, *_RANGES, _BRAKE, _LIDAR_TYPE, _SENSOR, _DEVICE, _HARDWARE]
_cte("mqa0", "mnorm", f"select *, {_list(_MESSAGE_RULES)} as violations from mnorm where issue is null")
_cte("mqa", "mqa0", "select *, case when len(violations) = 0 then 'validated' else 'quarantine' end as route from mqa0")
_cte(
    "mwin",
    "mqa",
    """select vehicle_id, window_no, count(*) as total, count(*) filter (route = 'quarantine') as quarantined,
  round(count(*) filter (route = 'quarantine') / count(*), 6) as quarantine_rate,
  count(*) filter (route = 'quarantine') / count(*) > 0.15 as exceeded, max(event_time) as window_end
 from (select *, cast((row_number() over (partition by vehicle_id order by event_time, event_id) - 1) // 20 as bigint) as window_no
       from mqa) group by vehicle_id, window_no having count(*) = 20""",
)
_cte(
    "mseq",
    "mqa",
    f"""select event_id, event_time, {', '.join(FEATURES)},
   cast(row_number() over (order by event_time, event_id) - 1 as bigint) as seq from mqa where route = 'validated'""",
)
_drift("mw", "mseq", 50)
_o["message_decode"] = _sql(
    "mnorm",
    f"""select event_id as record_key, case when raw then 'raw' else 'json' end as codec, case when not raw then vehicle_id end as vehicle_id,
 issue, case when not raw and not bad_speed then speed_mph end as speed_mph, case when not raw then brake_pressure end as brake_pressure,
 case when not raw then lidar_temp_c end as lidar_temp_c, case when not raw then lidar_text end as lidar_temp_c_text,
 case when not raw then {_at('event_time')} end as event_time from mnorm""",
)
_ISSUES = {
    "decode_failed": ("_payload", "decode", "kafka value could not be decoded"),
    "empty_vehicle_id": ("vehicle_id", "required_nonempty", "vehicle_id is empty"),
    "unparseable_timestamp": ("timestamp", "iso8601", "timestamp is missing or unparseable"),
    "non_numeric_gps": ("gps_lat", "type:float", "gps_lat/gps_lon must be numeric"),
    "non_numeric_speed": ("speed_mph", "type:float", "speed_mph must be numeric"),
}


def _issue(part: int) -> str:
    return "case issue " + " ".join(f"when '{k}' then {_q(v[part])}" for k, v in _ISSUES.items()) + " end"


_o["message_quarantine"] = _sql(
    "mnorm mqa",
    f"""select event_id as record_key, 'telemetry.raw' as source_topic, case when not raw then vehicle_id end as vehicle_id,
 {_issue(0)} as field, {_issue(1)} as rule, {_issue(2)} as reason, payload as raw_payload from mnorm where issue is not null
 union all select event_id, 'telemetry.normalized', vehicle_id, violations[1].field, violations[1].rule, violations[1].message, payload
 from mqa where route = 'quarantine'""",
)
_o["message_windows"] = _sql(
    "mwin", f"select vehicle_id, window_no, total, quarantined, exceeded, {_at('window_end')} as window_end from mwin"
)
_o["message_drift"] = _windows_out("mw")
_policy("m", "mwin")
_breaker("mbrk", "60 seconds", "mdec")
_o["message_breaker"] = _sql("mbrk", f"select {_TIMELINE} from mbrk")
_MESSAGE_BATCH = [_VEHICLE, _TRIP, *_TIME, _v("bad_gps", "gps_lat", "type:float", "''"), *_RANGES,
                  _v("bad_speed", "speed_mph", "type:float", "''"), _BRAKE, _LIDAR_TYPE, _HARDWARE]
_o["message_triage"] = _sql(
    "msg",
    f"""select case when raw then 'invalid_record_type' when len({_list(_MESSAGE_BATCH)}) > 0 then 'pandera_schema_error' else 'accepted' end as outcome,
 count(*) as records, max(event_id) as largest_key from msg group by 1""",
)
_o["batch_publish_blocked"] = _sql(
    "tri",
    """select event_id, 'dead_letter' as outcome, array_to_string(list_transform(broken, lambda v: v.field || ': ' || v.rule), '; ') as reason
 from tri where len(broken) > 0""",
)
_o["fusion_quarantine"] = _sql(
    "frame",
    f"""select scenario_id, {_at('timestamp')} as timestamp, case when speed_mph < 5.0 then 'quarantine' else 'fused' end as outcome,
 case when speed_mph < 5.0 then 'lidar' else '' end as missing from frame""",
)

