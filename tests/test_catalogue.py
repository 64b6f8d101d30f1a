"""Every query of the location analytics against its SQL twin in DuckDB, and properties that SQL does not show."""

import os

import duckdb
import pytest
from pyspark.sql import functions as F

from terraloom.operators import scoring
from terraloom.plans import catalogue

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in os.listdir(SMALL):
        con.sql(f"CREATE VIEW {t.split('.')[0]} AS SELECT * FROM read_parquet('{SMALL}/{t}')")
    return con


@pytest.mark.parametrize("name", sorted(catalogue.queries()))
def test_same_rows_as_duckdb(spark, duck, name):
    got = catalogue.queries()[name](spark, SMALL)
    want = duck.sql(catalogue.oracles()[name])
    assert sorted(got.columns) == sorted(want.columns)
    rows = sorted(repr([r[c] for c in want.columns]) for r in got.collect())
    assert rows == sorted(repr(list(r)) for r in want.fetchall())


@pytest.mark.parametrize("name", ["bearing_sector", "distance_decay"])
def test_rows_of_pairs_need_no_broadcast_and_no_decimal_text(spark, name):
    plan = catalogue.queries()[name](spark, SMALL)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan and "round(" not in plan.lower()


@pytest.mark.parametrize("total", [1, 7, 10, 97, 100])
def test_quotas_sum_to_the_total(total):
    assert sum(scoring.quotas(total).values()) == total


def test_box_relations_of_each_kind(spark):
    from terraloom.operators import spatial

    rows = [(1, 0.0, 0.0, 4.0, 4.0), (2, 4.0, 0.0, 6.0, 4.0), (3, 1.0, 1.0, 2.0, 2.0), (4, 3.0, 3.0, 5.0, 5.0), (5, 0.0, 0.0, 4.0, 4.0)]
    boxes = spark.createDataFrame(rows, "box_id long, xmin double, ymin double, xmax double, ymax double")
    pairs = spatial.touching_boxes(boxes, 2.0).withColumn("rel", spatial.box_relation())
    got = {(r.a_box_id, r.b_box_id): r.rel for r in pairs.collect()}
    assert got == {(1, 2): 2, (1, 3): 4, (1, 4): 3, (1, 5): 5, (2, 4): 3, (2, 5): 2, (3, 5): 5, (4, 5): 3}


def test_locations_without_features_count_zero(spark):
    features = spark.createDataFrame([], "geom_type string, lat double, lon double, " + ", ".join(f"`{t}` string" for t in scoring.TAGS))
    locations = spark.createDataFrame([(1, 10.0, 20.0)], "loc_id long, lat double, lon double")
    row = scoring.location_counts(features, locations, 500.0).withColumn("r", scoring.proxy_richness()).first()
    assert row.n_points == row.n_amenity == 0 and row.r == 0.0


def test_quotas_move_to_buckets_with_more(spark):
    # shares of 100: 2, 12, 77, 9; medium lacks 57, low has 88 left and high 11: 57 * 88 / 99 = 50.67, 57 * 11 / 99 = 6.33
    pools = spark.createDataFrame([("low", 100), ("medium", 20), ("high", 20), ("very_low", 2)], "bucket string, n long")
    assert {r.bucket: r.quota for r in scoring.shifted_quotas(pools, 100).collect()} == {"low": 63, "medium": 20, "high": 15, "very_low": 2}
    few = spark.createDataFrame([("low", 5)], "bucket string, n long")  # nothing is left anywhere
    assert [r.quota for r in scoring.shifted_quotas(few, 100).collect()] == [5]
    assert scoring.shifted_quotas(few.where("n < 0"), 100).count() == 0


def test_weighted_choice_of_equal_sizes_and_empty_input(spark):
    rows = [(i, "low", f"c{i % 50}", 1.0, 0.3) for i in range(200)]
    scored = spark.createDataFrame(rows, "loc_id long, bucket string, cell string, size double, richness double")
    got = scoring.diverse(scored, 20, 2, 7, 0.5).collect()
    assert len(got) == len({r.loc_id for r in got}) == 20
    assert max(sum(r.cell == c for r in got) for c in {r.cell for r in got}) <= 2
    assert scoring.diverse(scored.where("loc_id < 0"), 20, 2, 7, 0.5).count() == 0


def test_weighted_choice_makes_its_rows_once(spark):
    made = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            made.add(batch.num_rows)
            yield batch

    rows = [(i, f"c{i % 50}", 1.0, 0.3) for i in range(200)]
    scored = spark.createDataFrame(rows, "loc_id long, cell string, size double, richness double")
    scored = scored.mapInArrow(counted, scored.schema).withColumn("bucket", scoring.bucket(F.col("richness")))
    assert len(scoring.diverse(scored, 20, 2, 7, 0.5).collect()) == 20 and made.value == 200
