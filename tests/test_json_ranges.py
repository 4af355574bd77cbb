import json
import random
import re

import pytest

from zonewise.sources import json_ranges, layers, open_data

PROPERTIES = "name string, size bigint, tags struct<note:string,more:array<string>>"
NASTY = ['}', '{"features":[{', '\\', '\\\\"', '"', ']', '"features": [', '\n\t', 'é𝄞', '', 'a\\', '"type":"Feature"', '[[']


def collection(draw, n):
    features = []
    for k in range(n):
        note = "".join(draw.choice(NASTY) for _ in range(draw.randint(0, 4)))
        tags = {"note": note, "more": draw.sample(NASTY, draw.randint(0, 3))}
        ring = [[draw.uniform(30, 40), draw.uniform(28, 34)] for _ in range(draw.randint(3, 9))]
        shape = draw.choice([{"type": "Polygon", "coordinates": [ring]}, {"type": "MultiPolygon", "coordinates": [[ring], [ring, ring]]}, None])
        feature = {"type": "Feature", "properties": {"name": f"n{k}", "size": k, "tags": tags, "features": [{"name": "inner"}]}, "geometry": shape}
        features.append(dict(draw.sample(list(feature.items()), 3)))
    members = {"type": "FeatureCollection", "crs": {"type": "name", "properties": {"features": [{"a": 1}]}, "features": [{"properties": {"name": "no"}}]}}
    after = {"features": features, "bbox": [1, 2], "note": {"features": [{"properties": {"name": "after"}}]}, "list": [{"properties": {"name": "list"}}]}
    if draw.random() < 0.5:
        return after | members
    return members | after


def both_ways(spark, path, size):
    by_range = layers.read_geojson(spark, path, PROPERTIES, range_bytes=size)
    whole = spark.read.schema(f"features array<struct<properties:struct<{layers._nested(PROPERTIES)}>,geometry:struct<type:string,coordinates:string>>>")
    whole = whole.option("multiLine", True).json(path).selectExpr("explode(features) AS f").selectExpr("f.properties.*")
    return by_range, sorted(map(str, by_range.drop("geometry").collect())), sorted(map(str, whole.collect()))


@pytest.mark.parametrize("seed", range(6))
def test_ranges_read_what_one_task_reads(spark, tmp_path, seed):
    draw = random.Random(seed)
    for k in range(2):
        told = collection(draw, draw.randint(0, 25))
        (tmp_path / f"{k}.geojson").write_text(json.dumps(told, ensure_ascii=draw.random() < 0.5, indent=draw.choice([None, 1])), encoding="utf-8")
    size = draw.choice([1, 7, 64, 333, 5000, 1 << 20]) if seed else 3
    _, got, want = both_ways(spark, str(tmp_path), max(size, 40) if seed > 1 else size * 20)
    assert got == want


def test_every_cut_of_a_small_document(tmp_path):
    """States and elements at every range size, without a cluster between."""
    features = [{"p": '}{"\\', "q": {"features": [{}]}}, {"p": "\\\\\\"}, {}, {"g": [[1, [2]], {"x": "]"}]}]
    text = json.dumps({"a": {"features": [{"no": 1}]}, "s": '"features":[{', "features": features, "z": [{"no": 2}]})
    path = tmp_path / "x.json"
    path.write_text(text)
    file = json_ranges._File(f"file:{path}")
    begin = re.compile(rb'"features"[ \t\r\n]*:[ \t\r\n]*\[')
    array = text.index('"features": [{"p"') + len('"features": [') - 1
    for size in range(1, len(text) + 1):
        inside, depth, ended, found = 0, 0, False, []
        for start in range(0, len(text), size):
            stop = min(start + size, len(text))
            told = json_ranges._effect(file, start, stop, begin)
            side = told[("from_outside", "from_inside")[inside]]
            hits = [b["at"] for b in side["begins"] if b["depth"] + depth == 1]
            assert hits in ([], [array])
            if stop > array and not ended:
                found += [json.loads(v) for v in json_ranges._elements(file, start, stop, inside, depth, array)]
            low = side["begins"][-1]["least"] if hits else side["least"] if start > array else None
            ended |= low is not None and depth + low <= 1
            depth += side["moves"]
            inside = (inside + told["flips"]) % 2
        assert found == features and (inside, depth) == (0, 0)


def test_one_large_file_is_many_tasks(spark, tmp_path):
    path = str(tmp_path / "big.geojson")
    with open(path, "w") as out:
        out.write('{"type":"FeatureCollection","features":[')
        for k in range(20_000):
            out.write(("," if k else "") + json.dumps({"type": "Feature", "properties": {"name": "}" * (k % 9), "size": k}, "geometry": {"type": "Point", "coordinates": [34.8, 32.0]}}))
        out.write("]}")
    df = layers.read_geojson(spark, path, "name string, size bigint", points=True, range_bytes=100_000)
    assert df.rdd.getNumPartitions() > 20
    assert df.selectExpr("count(*)", "count(DISTINCT size)", "sum(length(name))").first() == (20_000, 20_000, sum(k % 9 for k in range(20_000)))


def test_odd_documents(spark, tmp_path):
    for k, text in enumerate(['{"features":[]}', "{}", '{"features":null}', "[1]", '{"features":[null,1,{"properties":{"name":"x"}},[{}]]}', ""]):
        (tmp_path / f"{k}.json").write_text(text)
    assert [r.name for r in layers.read_geojson(spark, str(tmp_path), "name string").collect()] == ["x"]
    (tmp_path / "bad.json").write_text('{"features":[{"a":1')
    with pytest.raises(Exception, match="ends within an element"):
        layers.read_geojson(spark, str(tmp_path / "bad.json"), "name string").collect()


def test_ways_by_ranges(spark, tmp_path):
    ring = [{"lon": 34.8, "lat": 32.0}, {"lon": 34.81, "lat": 32.0}, {"lon": 34.8, "lat": 32.01}]
    ways = [{"type": "way", "id": k, "tags": {"name": f'p"{k}}}'}, "geometry": ring} for k in range(50)] + [{"type": "node", "id": 1}]
    (tmp_path / "ways.json").write_text(json.dumps({"version": 0.6, "elements": ways}))
    parks = open_data.normalise_ways(open_data.read_ways(spark, str(tmp_path / "ways.json"), range_bytes=500))
    assert sorted(r.name for r in parks.collect()) == sorted(f'p"{k}}}' for k in range(50))
