"""File sources and sinks: awkward rows, and what is written reads back the same."""

import gzip
import json

import pytest

from terraloom.operators import scoring
from terraloom.sources import files


def test_locations_of_a_csv(spark, tmp_path):
    (tmp_path / "a.csv").write_text("\ufeffName, Longitude ,LATITUDE\nx,13.4,52.5\ny,bad,1\nz,,2\nw, 7 , -8.5 \n", encoding="utf-8")
    got = files.read_locations(spark, f"file://{tmp_path}/a.csv").collect()
    assert sorted((r.lat, r.lon) for r in got) == [(-8.5, 7.0), (52.5, 13.4)]
    for name, text in (("b", "lat,x\n1,2\n"), ("c", "lat,lon\nq,1\n")):
        (tmp_path / f"{name}.csv").write_text(text)
        with pytest.raises(ValueError):
            files.read_locations(spark, f"file://{tmp_path}/{name}.csv")


def test_geojson_round_trip(spark, tmp_path):
    def feature(kind, coordinates, tags):
        return {"type": "Feature", "geometry": kind and {"type": kind, "coordinates": coordinates}, "properties": tags}

    one = [feature("Point", [1.5, 2], {"amenity": 'ca"fé', "shop": None}), feature(None, None, {"a": "b"}), feature("LineString", [[0, 1], [2, 3]], None)]
    (tmp_path / "in").mkdir()
    (tmp_path / "in/osm_1_point.geojson.gz").write_bytes(gzip.compress(json.dumps({"type": "FeatureCollection", "features": one}, indent=1).encode()))
    (tmp_path / "in/osm_2_point.geojson").write_text("no json")
    (tmp_path / "in/osm_3_point.geojson").write_text(json.dumps({"type": "FeatureCollection", "features": []}))
    read = files.read_geojson(spark, f"file://{tmp_path}/in")
    want = [("LineString", [[0, 1], [2, 3]], {}), ("Point", [1.5, 2], {"amenity": 'ca"fé'})]
    plain = lambda df: sorted((r.geom_type, json.loads(r.coordinates), r.tags) for r in df.collect())
    assert plain(read) == want
    assert plain(files.read_geojson(spark, f"file://{tmp_path}/in", ("Point",))) == want[1:]
    files.write_geojson(read, f"file://{tmp_path}/out")
    assert plain(files.read_geojson(spark, f"file://{tmp_path}/out", lines=True)) == want
    assert (tmp_path / "out/kind=Point").is_dir()


def test_csv_columns_and_new_rows(spark, tmp_path):
    known = spark.createDataFrame([("a", 1)], "k string, n int")
    batch = spark.createDataFrame([("a", 2), ("b", 4), ("b", 3), (None, 5), (None, 6)], "k string, n int")
    new = files.new_rows(batch, known, ["k"], "n")
    assert sorted((r.k or "", r.n) for r in new.collect()) == [("", 5), ("", 6), ("b", 3)]
    files.write_csv(new, f"file://{tmp_path}/o", ("n", "missing", "k"))
    assert spark.read.option("header", True).csv(f"file://{tmp_path}/o").columns == ["n", "k"]


@pytest.mark.parametrize("digits", [1, 3])
def test_hash_ranks_have_no_gaps(spark, digits):
    rows = spark.createDataFrame([(i,) for i in range(100)] + [(7,), (None,)], "loc_id long")
    got = scoring.hash_ranked(rows, "loc_id", 17, digits).collect()
    assert sorted(r.place for r in got if r.loc_id is not None) == list(range(2, 103)) and {r.total for r in got} == {102}
    assert len({r.place for r in got if r.loc_id == 7}) == 2
