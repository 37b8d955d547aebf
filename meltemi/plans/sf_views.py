"""SQL twins of the test-table bindings, as common table expressions for the oracle."""

from __future__ import annotations

# Widths of the spans in plans/sf.py, by the same labels.
SPAN = {
    "30s": "1 day",
    "60s": "2 day",
    "2m": "2 day",
    "3m": "3 day",
    "5m": "5 day",
    "10m": "5 day",
    "15m": "7 day",
    "20m": "14 day",
    "bin5s": "6 hour",
    "bin10s": "1 hour",
    "bin30s": "3 hour",
}

_LAT = "35.0 + (k % 100) / 20.0::double"
_USER_LON = "20.0 + (user_id % 100) / 10.0::double"

VIEWS: dict[str, tuple[str, str]] = {
    # name: (views it needs, query)
    "ev": ("", "select event_id, ts as timestamp, user_id, event_type, value, cast(props->>'$.k' as int) as k from events"),
    "wind": (
        "ev",
        f"""select event_id, timestamp, 'WindTurbineTelemetry' as stream_type, user_id as turbine_id,
            case when event_type = 'error' then 0.0::double else value end as power_mw, k / 4.0::double as wind_speed_ms,
            case when event_type = 'error' then 0.0::double else k / 10.0::double end as vibration_mm_s,
            case when event_type = 'error' then 0.0::double else k / 8.0::double end as rotor_rpm,
            20.0 + k / 4.0::double as nacelle_temp_c, {_LAT} as latitude, {_USER_LON} as longitude,
            case when event_type = 'error' then 'DEMO_FORCED_FAILURE' when k >= 90 then 'bearing_degradation'
                 when k >= 80 then 'vibration_spike' else 'NONE' end as fault_type
            from ev where event_type in ('click', 'error')""",
    ),
    "solar": (
        "ev",
        f"""select event_id, timestamp, 'SolarInverterTelemetry' as stream_type, user_id as inverter_id, value * 1000.0 as power_kw,
            k * 10.0::double as irradiance_wm2, 15.0 + k / 2.0::double as panel_temp_c, k * 1.0::double as efficiency_pct,
            {_LAT} as latitude, {_USER_LON} as longitude,
            case when k >= 95 then 'panel_soiling_or_string_fault' end as fault_type
            from ev where event_type = 'view'""",
    ),
    "gas": (
        "ev",
        """select event_id, timestamp, 'EmissionsStream' as stream_type, user_id % 25 as plant_id, 'NATION_' || (user_id % 25) as plant_name,
            value as power_output_mw, value * 350.0::double as co2_kg_per_hour, k * 30.0::double as cumulative_co2_tonnes_today,
            1100.0::double as ets_daily_allowance_tonnes, least(k * 1.6::double, 150.0::double) as compliance_pct, 'Natural Gas' as fuel_type,
            case when k >= 97 then 'combustion_inefficient' end as fault_type
            from ev where event_type = 'purchase'""",
    ),
    "grid": (
        "ev",
        """select event_id, timestamp, 'GridTelemetry' as stream_type, user_id % 5 as grid_id, r_name as grid_name,
            50.0 + (k - 50) / 200.0::double as frequency_hz, value as load_mw, value * (1.0 + (k - 50) / 500.0::double) as generation_mw,
            150.0 + k / 100.0::double as voltage_kv, value * (1.0 + (k - 50) / 500.0::double) - value as balance_mw
            from ev join region on r_regionkey = user_id % 5""",
    ),
    "pos": (
        "ev",
        f"""select event_id, timestamp, 'VesselPositions' as stream_type, user_id as vessel_id, 'Vessel ' || user_id as vessel_name,
            case when user_id % 3 = 2 then 'Crew Transfer Vessel' else 'LNG Carrier' end as vessel_type,
            {_LAT} as latitude, {_USER_LON} as longitude, k / 5.0::double as speed_knots, k * 3.6::double as heading_deg,
            'Port ' || (k % 7) as destination, greatest(value - 10.0::double, 0.0::double) as eta_hours,
            case when k < 50 then 'Loaded' else 'On station' end as cargo_status
            from ev where event_type = 'signup'""",
    ),
    "power_plants": (
        "",
        """select n_nationkey as plant_id, n_name as plant_name,
            case n_nationkey % 3 when 0 then 'Wind Farm' when 1 then 'Solar Park' else 'Gas Power Plant' end as plant_type,
            case n_nationkey % 3 when 0 then 'Wind' when 1 then 'Solar' else 'Natural Gas' end as fuel_type,
            100.0::double + n_nationkey as capacity_mw, 2000 + n_nationkey as commissioning_year, r_name as region,
            'Prefecture ' || (n_nationkey % 6) as prefecture, 35.0 + n_nationkey / 10.0::double as latitude,
            20.0 + n_nationkey / 5.0::double as longitude, 'Active' as status, n_regionkey as grid_zone
            from nation join region on n_regionkey = r_regionkey""",
    ),
    "wind_turbines": (
        "",
        """select c_custkey as turbine_id, c_name as turbine_name, c_nationkey as plant_id, c_mktsegment as manufacturer,
            'M-' || c_nationkey as model, c_acctbal / 1000.0::double as capacity_mw, 3.0::double as cut_in_speed_ms, 12.0::double as rated_speed_ms,
            25.0::double as cut_out_speed_ms, 35.0 + (c_custkey % 100) / 20.0::double as latitude, 20.0 + (c_custkey % 100) / 10.0::double as longitude,
            'Active' as status from customer""",
    ),
    "solar_inverters": (
        "",
        """select c_custkey as inverter_id, c_name as inverter_name, c_nationkey as plant_id, c_mktsegment as manufacturer,
            c_acctbal as capacity_kw, case when c_custkey % 2 = 0 then 'Monocrystalline' else 'Bifacial' end as panel_type,
            35.0 + (c_custkey % 100) / 20.0::double as latitude, 20.0 + (c_custkey % 100) / 10.0::double as longitude,
            'Active' as status from customer""",
    ),
    "substations": (
        "",
        """select s_suppkey as substation_id, s_name as substation_name,
            case s_suppkey % 3 when 0 then 20.0::double when 1 then 150.0::double else 400.0::double end as voltage_kv,
            35.0 + (s_suppkey % 100) / 20.0::double as latitude, 20.0 + (s_suppkey % 50) / 5.0::double as longitude,
            s_suppkey % 5 as connected_grid_id, case when s_suppkey % 10 <> 9 then s_nationkey end as fed_by_plant_id,
            'Active' as status from supplier""",
    ),
    "island_grids": (
        "",
        """select r_regionkey as grid_id, r_name as grid_name, 'Island ' || r_regionkey as island, r_name as region,
            850.0::double + r_regionkey * 10 as peak_demand_mw, 1000.0::double + r_regionkey * 100 as installed_capacity_mw,
            50.0::double as nominal_frequency_hz from region""",
    ),
    "vessels": (
        "",
        """select s_suppkey as vessel_id, s_name as vessel_name, case when s_suppkey % 3 = 2 then 'Crew Transfer Vessel' else 'LNG Carrier' end as vessel_type,
            case when s_suppkey % 2 = 0 then 'Greece' else 'Malta' end as flag, s_acctbal * 10.0::double as capacity_m3, s_nationkey as supply_plant_id
            from supplier""",
    ),
    "service_vessels": (
        "",
        """select s_suppkey as vessel_id, 35.0 + (s_suppkey % 100) / 20.0::double as vessel_lat, 20.0 + (s_suppkey % 50) / 5.0::double as vessel_lon
            from supplier where s_acctbal > 0""",
    ),
    "route_legs": (
        "",
        """select s_suppkey as vessel_id, leg_no, 35.0::double + leg_no * (s_suppkey % 7 + 3) / 10.0::double as lat,
            20.0::double + leg_no * (s_suppkey % 5 + 2) / 5.0::double as lon from supplier, (values (0), (1), (2), (3), (4)) as l(leg_no)""",
    ),
    "maintenance_orders": (
        "",
        """select o_orderkey as order_id, case o_orderkey % 3 when 0 then 'Corrective' when 1 then 'Preventive' else 'Inspection' end as order_type,
            o_orderpriority as priority, case o_orderstatus when 'O' then 'Open' when 'F' then 'Completed' else 'In Progress' end as status,
            o_custkey as asset_id, 'WindTurbine' as asset_type, o_custkey % 25 as plant_id, cast(o_orderdate as date) as created_date,
            case when o_orderstatus = 'F' then cast(o_orderdate as date) + 5 end as completed_date,
            'Technician ' || (o_orderkey % 5) as technician, o_totalprice as cost_eur from orders""",
    ),
    "emissions_ledger": (
        "",
        """select record_id, plant_id, 'NATION_' || plant_id as plant_name, period, co2_tonnes, ets_allowance_tonnes, compliance_pct,
            case when compliance_pct >= 95 then 'Near Limit' when compliance_pct is not null then 'Compliant' end as compliance_status from (
            select l_orderkey || '-' || l_linenumber as record_id, l_suppkey % 25 as plant_id, strftime(l_shipdate, '%Y-%m') as period,
            l_quantity as co2_tonnes, l_extendedprice / 1000.0::double as ets_allowance_tonnes,
            case when l_extendedprice <> 0 then 100.0 * l_quantity / (l_extendedprice / 1000.0::double) end as compliance_pct from lineitem)""",
    ),
}


def r(x: str, digits: int = 6) -> str:
    """Half-up rounding in decimal arithmetic, as the queries round."""
    return f"cast(round(cast({x} as decimal(28, 9)), {digits}) as double)"


def since(span: str) -> str:
    return f"timestamp > (select max(ts) from events) - interval {SPAN[span]}"


def bin_of(span: str, col: str = "timestamp") -> str:
    return f"time_bucket(interval {SPAN[span]}, {col})"


def distance(lat1: str, lon1: str, lat2: str, lon2: str) -> str:
    """Haversine in nautical miles."""
    return (
        f"2 * 3440.065 * asin(sqrt(least(1.0, pow(sin((radians({lat2}) - radians({lat1})) / 2), 2) + "
        f"cos(radians({lat1})) * cos(radians({lat2})) * pow(sin((radians({lon2}) - radians({lon1})) / 2), 2))))"
    )


def sql(views: str, body: str, doubles: str = "") -> str:
    """``body`` over the named views; the listed DOUBLE columns are rounded to six digits."""
    ordered: list[str] = []

    def need(name: str) -> None:
        for dep in VIEWS[name][0].split():
            need(dep)
        if name not in ordered:
            ordered.append(name)

    for name in views.split():
        need(name)
    ctes = [f"{n} as ({VIEWS[n][1]})" for n in ordered]
    body = body.strip()
    if body.lower().startswith("with "):
        ctes.append(body[5:].rpartition("\n--\n")[0].rstrip().rstrip(","))
        body = body.rpartition("\n--\n")[2]
    if doubles:
        cols = ", ".join(f'{r(chr(34) + c.strip() + chr(34))} as "{c.strip()}"' for c in doubles.split(","))
        body = f"select * replace ({cols}) from ({body})"
    return (f"with {', '.join(ctes)} " if ctes else "") + body
