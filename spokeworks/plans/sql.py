"""The derived tables as SQL, for checks by another engine: common table expressions by name."""

from __future__ import annotations

from . import derived as d

_R = "3.141592653589793 / 180"


def haversine(a: str, b: str) -> str:
    h = f"(pow(sin(({b}.lat - {a}.lat) * {_R} / 2), 2) + cos({a}.lat * {_R}) * cos({b}.lat * {_R}) * pow(sin(({b}.lon - {a}.lon) * {_R} / 2), 2))"
    return f"(2 * 6371008.8 * atan2(sqrt({h}), sqrt(1 - {h})))"


def equirect(lon1: str, lat1: str, lon2: str, lat2: str) -> str:
    return f"(6371000.0 * sqrt(pow(({lat2} - {lat1}) * {_R}, 2) + pow(({lon2} - {lon1}) * {_R} * cos(({lat1} + {lat2}) / 2 * {_R}), 2)))"


def length_of(g: str) -> str:
    return f"coalesce(list_sum(list_transform(range(1, len({g})), lambda i: {haversine(f'{g}[i]', f'{g}[i+1]')})), 0)"


def node(p: str) -> str:
    return f"((cast(floor({p}.lon * 100000 + 0.5) as bigint) + 18000000) * 33554432 + cast(floor({p}.lat * 100000 + 0.5) as bigint) + 9000000)"


def fixed(x: str, digits: int) -> str:
    return f"printf('%.{digits}f', floor(({x}) * {10**digits}.0 + 0.5) / {10**digits}.0)"


def near(dlon: str, dlat: str, gap: str) -> str:
    return f"(abs({dlat}) <= {gap} / 111000.0 * 1.5 and abs({dlon}) <= {gap} / 111000.0 * 1.5 * 2)"


_columns = lambda c: ", ".join(f"{e} as {n}" for n, e in c.items())
_inner = "list_transform(range(0, m + 1), lambda i: struct_pack(lon := ((x1 * (m + 1 - i) + x2 * i) // (m + 1) + 70 * i) / 1e7, lat := ((y1 * (m + 1 - i) + y2 * i) // (m + 1) - 50 * i) / 1e7))"
LANE_TYPES = "case t when 0 then 'cycleway' when 1 then 'track' when 2 then 'lane' when 3 then 'shared' when 6 then 'track' else 'path' end"
CTES = {
    "ways": f"select *, list_concat({_inner}, [struct_pack(lon := x2 / 1e7, lat := y2 / 1e7)]) as g from (select {_columns(d.way_columns(False))} from orders) where k2 in (select c_custkey from customer)",
    "lanes": f"select ok as lane_seq, 'way/' || ok as osm_id, k, {LANE_TYPES} as lane_type, name, g from ways where t <= 6",
    "ends": "select lane_seq * 2 + e as seq, case e when 0 then g[1] else g[-1] end as p from lanes, (values (0), (1)) as v(e)",
    "nodes": f"select {node('p')} as node, min(seq) as node_ord, arg_max(p.lon, seq) as lon, arg_max(p.lat, seq) as lat from ends group by 1",
    "lane_edges": f"select least(u, v) || '-' || greatest(u, v) as edge_id, u, v, {length_of('g')} as distance_m, false as is_gap, lane_seq, g, lane_type from (select *, row_number() over (partition by least(u, v), greatest(u, v) order by lane_seq) as n from (select *, {node('g[1]')} as u, {node('g[-1]')} as v from lanes) where u <> v) where n = 1",
    "pairs": f"select least(a.node, b.node) || '-' || greatest(a.node, b.node) as edge_id, a.node as u, b.node as v, {equirect('a.lon', 'a.lat', 'b.lon', 'b.lat')} as distance_m, true as is_gap from nodes a join nodes b on a.node_ord < b.node_ord and {near('a.lon - b.lon', 'a.lat - b.lat', str(d.GAP_M))} and {equirect('a.lon', 'a.lat', 'b.lon', 'b.lat')} <= {d.GAP_M}",
    "edges": "select edge_id, u, v, distance_m, is_gap from lane_edges union all select edge_id, u, v, distance_m, is_gap from pairs where edge_id not in (select edge_id from lane_edges)",
    "adj": "select u as src, v as dst, edge_id, distance_m, is_gap from edges union all select v, u, edge_id, distance_m, is_gap from edges",
    "segments": f"select k // 15 as request_id, 'r' || k as route_id, row_number() over (partition by k order by lane_seq) - 1 as seg_idx, {node('g[1]')} as src, {node('g[-1]')} as dst, g, case when lane_type = 'path' then 'gap' else 'bike_lane' end as type, {length_of('g')} as distance_m from lanes",
    "metrics": "select request_id, route_id, sum(distance_m) as total_m, coalesce(sum(distance_m) filter (where type = 'bike_lane'), 0) as lane_m, count(*) filter (where type = 'gap') as gap_count, count(*) as n_segments, string_agg(g[1].lon || ',' || g[1].lat, '|' order by seg_idx) as signature from segments group by all",
    "requests": f"select {_columns(d.request_columns(False))} from supplier",
    "saves": f"select *, {fixed('west', 3)} || ',' || {fixed('south', 3)} || ',' || {fixed('east', 3)} || ',' || {fixed('north', 3)} as id from (select {_columns(d.area_columns(False))} from events)",
    "areas": "select id, any_value(west) as west, any_value(south) as south, any_value(east) as east, any_value(north) as north, max(fetched_at) as fetched_at from saves group by id",
    "close": f"select r.request_id, n.node, n.node_ord from requests r join nodes n on {near('n.lon - r.start_lon', 'n.lat - r.start_lat', 'r.start_proximity_m')} and {equirect('r.start_lon', 'r.start_lat', 'n.lon', 'n.lat')} <= r.start_proximity_m",
}
_NEEDS = {"lanes": ["ways"], "ends": ["lanes"], "nodes": ["ends"], "lane_edges": ["lanes"], "pairs": ["nodes"], "edges": ["lane_edges", "pairs"], "adj": ["edges"], "segments": ["lanes"], "metrics": ["segments"], "areas": ["saves"], "close": ["requests", "nodes"]}


def sql(query: str, *tables: str) -> str:
    """``query`` after the common table expressions that it names and those they need."""
    order: list[str] = []

    def need(name: str) -> None:
        for other in _NEEDS.get(name, []):
            need(other)
        if name not in order:
            order.append(name)

    for t in tables:
        need(t)
    return ("with " + ",\n".join(f"{t} as ({CTES[t]})" for t in order) + "\n" if order else "") + query
