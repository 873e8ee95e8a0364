"""Shared fragments of the comparison SQL."""

from __future__ import annotations

from tickloom.operators import calendar as cal

UTC = "AT TIME ZONE 'UTC'"
ET = f"AT TIME ZONE '{cal.ZONE}'"


def et(ts: str) -> str:
    return f"(({ts} {UTC}) {ET})"


def et_date(ts: str) -> str:
    return f"CAST({et(ts)} AS DATE)"


def local_to_utc(local: str) -> str:
    return f"(({local} {ET}) {UTC})"


def _in(values: list[str]) -> str:
    return ", ".join(f"DATE '{v}'" for v in values)


CALENDAR = f"""
cal0 AS (SELECT CAST(d AS DATE) AS session_date
         FROM generate_series(TIMESTAMP '{cal.COVERED_FROM}', TIMESTAMP '{cal.COVERED_THROUGH}', INTERVAL 1 DAY) t(d)),
cal1 AS (SELECT session_date,
         CASE WHEN isodow(session_date) >= 6 OR session_date IN ({_in(cal.CLOSED_DATES)}) THEN 'CLOSED'
              WHEN session_date IN ({_in(cal.EARLY_CLOSE_DATES)}) THEN 'EARLY_CLOSE' ELSE 'REGULAR' END AS session_type
         FROM cal0),
cal AS (SELECT session_date, session_type,
         CASE WHEN session_type <> 'CLOSED' THEN {local_to_utc("(session_date + TIME '09:30:00')")} END AS opens_at,
         CASE WHEN session_type = 'REGULAR' THEN {local_to_utc("(session_date + TIME '16:00:00')")}
              WHEN session_type = 'EARLY_CLOSE' THEN {local_to_utc("(session_date + TIME '13:00:00')")} END AS closes_at
         FROM cal1),
ses AS (SELECT *, row_number() OVER (ORDER BY session_date) AS session_index,
         lag(session_date) OVER (ORDER BY session_date) AS prev_date,
         lead(session_date) OVER (ORDER BY session_date) AS next_date,
         lead(opens_at) OVER (ORDER BY session_date) AS next_open,
         lead(closes_at) OVER (ORDER BY session_date) AS next_close
         FROM cal WHERE session_type <> 'CLOSED')
"""

TICKS = """
ticks AS (SELECT event_type AS instrument_id, ts, event_id, CAST(CAST(value AS DECIMAL(18,8)) + 1 AS DECIMAL(18,8)) AS px
          FROM events)
"""


def bars(seconds: int, name: str = "bars", source: str = "ticks") -> str:
    """OHLCV bars inside regular hours."""
    return f"""
{name} AS (SELECT instrument_id, bar_start_at, arg_min(px, ts) AS open, max(px) AS high, min(px) AS low,
          arg_max(px, ts) AS close, count(*) AS volume, {et_date("bar_start_at")} AS session_date_et
          FROM (SELECT t.instrument_id, t.ts, t.px, time_bucket(INTERVAL {seconds} SECOND, t.ts, TIMESTAMP '1970-01-01') AS bar_start_at
                FROM {source} t JOIN cal c ON c.session_date = {et_date("t.ts")}
                WHERE t.ts >= c.opens_at AND t.ts < c.closes_at)
          GROUP BY instrument_id, bar_start_at)
"""


def bar_events(resolution: str, seconds: int, bars_name: str = "bars", name: str = "ev") -> str:
    return f"""
{name} AS (SELECT b.*, b.bar_start_at AS starts_at, least(b.bar_start_at + INTERVAL {seconds} SECOND, c.closes_at) AS ends_at,
          c.opens_at, c.closes_at, '{resolution}' AS resolution
          FROM {bars_name} b LEFT JOIN cal c ON c.session_date = b.session_date_et)
"""


def num(expr: str, places: int = 6) -> str:
    return f"round(CAST({expr} AS DOUBLE), {places})"


def money(expr: str) -> str:
    return f"CAST(CAST({expr} AS DECIMAL(24,8)) AS VARCHAR)"


def dec(expr: str) -> str:
    return f"CAST({expr} AS DECIMAL(18,8))"


# round_even on decimals
def bround(expr: str, places: int = 8) -> str:
    return f"round_even({expr}, {places})"


SUPPLIER_DAYS = """
sbars AS (SELECT 'S' || l_suppkey AS instrument_id, l_shipdate AS starts_at,
          arg_min(px, k) AS open, max(px) AS high, min(px) AS low, arg_max(px, k) AS close, CAST(sum(l_quantity) AS BIGINT) AS volume
          FROM (SELECT l_suppkey, l_shipdate, l_quantity, CAST(l_extendedprice AS DECIMAL(18,8)) AS px,
                       (l_orderkey, l_linenumber, l_partkey, l_extendedprice) AS k FROM lineitem)
          GROUP BY l_suppkey, l_shipdate)
"""
