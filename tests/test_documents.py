import json
import random

import pytest

from spokeworks.operators import network
from spokeworks.sources import documents, osm


def value(rng, depth=0):
    kind = rng.randrange(7 if depth < 3 else 4)
    if kind == 0:
        return rng.choice([None, True, 12, -3.5e-7])
    if kind < 4:
        return "".join(rng.choices(["a", "}", "{", "]", "[", '"', "\\", "\n", ":", ",", "é", "漢", '"}', "\\\\", " "], k=rng.randrange(8)))
    return [value(rng, depth + 1) for _ in range(rng.randrange(4))] if kind == 4 else {str(value(rng, 9)): value(rng, depth + 1) for _ in range(rng.randrange(4))}


def document(rng, n):
    """A document with an array 'features', others of objects beside it, and keys of the same name deeper down."""
    elements = [{"i": k, "features": [{"x": value(rng)}], "v": value(rng)} for k in range(n)]
    before = {"type": "features", "note": value(rng), "other": [{"features": [1]}, {"y": "}"}], "one": {"features": [{"z": 1}]}}
    after = {"more": [{"a": 1}, {"b": [{"c": 2}]}], "end": value(rng)}
    return {**before, "features": elements, **after} if rng.random() < 0.8 else {**before, **after}


@pytest.mark.parametrize("size", [200, 1000, 1 << 20])
def test_elements_of_files_in_ranges_are_those_of_the_documents_in_order(spark, tmp_path, size):
    rng = random.Random(size)
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(size))
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    expected = []
    try:
        for k in range(6):
            docs = [document(rng, rng.choice([0, 1, 7, 40])) for _ in range(rng.choice([1, 1, 3]))]
            text = rng.choice(["\n", "", " \n"]).join(json.dumps(d, ensure_ascii=rng.random() < 0.5, indent=rng.choice([None, 2])) for d in docs) + rng.choice(["", "\n"])
            (tmp_path / f"f{k}.json").write_text(text if k != 3 else "")
            expected += [e for d in docs for e in d.get("features", [])] if k != 3 else []
        texts = documents.ranges(spark, str(tmp_path))
        assert size > 1000 or texts.select("file", "start").distinct().count() > 6
        rows = documents.read_elements(spark, str(tmp_path), "features").collect()
        assert sorted(r.seq for r in rows) == list(range(len(expected)))
        assert [json.loads(r.element) for r in sorted(rows, key=lambda r: r.seq)] == expected
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")


def test_joined_ranges_give_the_same(spark, tmp_path, monkeypatch):
    docs = document(random.Random(2), 30) | {"features": [{"i": k, "s": "}{" * k} for k in range(30)]}
    (tmp_path / "a.json").write_text(json.dumps(docs))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "300")
    monkeypatch.setattr(documents, "MOST_RANGES", 2)
    try:
        rows = sorted(documents.read_elements(spark, str(tmp_path), "features").collect())
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert [json.loads(r.element) for r in rows] == docs["features"]


def collection(lines, **properties):
    return json.dumps({"type": "FeatureCollection", "features": [{"type": "Feature", "geometry": {"type": "LineString", "coordinates": x}, "properties": {"id": f"way/{k}", "highway": "cycleway"} | properties} for k, x in enumerate(lines)]}, indent=1)


def edges(lanes):
    return sorted((r.edge_id, round(r.distance_m, 3), r.lane_seq) for r in network.build_lane_edges(lanes).collect())


def test_two_files_give_the_graph_of_their_concatenation(spark, tmp_path):
    one, two = [[[0, 0], [0.001, 0]], [[0.001, 0], [0.002, 0]]], [[[0, 0], [0.0005, 0.001], [0.001, 0]], [[0.002, 0], [0.003, 0]]]
    (tmp_path / "both").mkdir()
    (tmp_path / "both" / "a.geojson").write_text(collection(one))
    (tmp_path / "both" / "b.geojson").write_text(collection(two))
    (tmp_path / "c.geojson").write_text(collection(one + two))
    apart, whole = (osm.to_lanes(osm.read_geojson(spark, str(tmp_path / x))) for x in ("both", "c.geojson"))
    assert sorted(r.lane_seq for r in apart.collect()) == [0, 1, 2, 3]
    assert edges(apart) == edges(whole) and len(edges(whole)) == 3
    assert {r.node: (r.lon, r.lat, r.node_ord) for r in network.build_nodes(apart).collect()} == {r.node: (r.lon, r.lat, r.node_ord) for r in network.build_nodes(whole).collect()}


def test_ways_of_several_extracts(spark, tmp_path):
    for name, ids in (("a", [5, 6]), ("b", [6, 7])):
        elements = [{"type": "node", "id": 1}, *({"type": "way", "id": i, "tags": {"highway": "cycleway", "x": "}"}, "geometry": [{"lat": 0.0, "lon": i * 1e-3}, {"lat": 0.0, "lon": (i + 1) * 1e-3}]} for i in ids)]
        (tmp_path / f"{name}.json").write_text(json.dumps({"version": 0.6, "elements": elements}, indent=2))
    lanes = osm.to_lanes(osm.filter_bike_ways(osm.read_osm_ways(spark, str(tmp_path))))
    assert sorted(r.osm_id for r in lanes.collect()) == ["way/5", "way/6", "way/6", "way/7"]
    assert [e[0] for e in edges(lanes)] == sorted({e[0] for e in edges(lanes)}) and len(edges(lanes)) == 3
