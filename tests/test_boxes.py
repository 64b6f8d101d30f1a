"""Rectangles of the same bounds are related once, and places are counted before they meet boxes."""

from terraloom.operators import spatial

SCHEMA = "box_id long, xmin double, ymin double, xmax double, ymax double"
ROWS = [(i, 0.0, 0.0, 4.0, 4.0) for i in range(1, 6)] + [(7, 1.0, 1.0, 2.0, 2.0), (8, 4.0, 0.0, 6.0, 4.0), (8, 9.0, 9.0, 12.0, 12.0), (9, 50.0, 50.0, 51.0, 51.0), (None, 1.0, 1.0, 3.0, 3.0)]


def test_corners_by_place_are_those_of_all_pairs(spark):
    rows = ROWS + [(8, 4.0, 0.0, 6.0, 4.0)]  # a box_id twice at one place
    want = {}
    for b, xmin, ymin, xmax, ymax in rows:
        for p, x, y, *_ in rows:
            if None not in (b, p) and b != p and xmin <= x <= xmax and ymin <= y <= ymax:
                want[b] = want.get(b, 0) + 1
    got = spatial.corners_in_boxes(spark.createDataFrame(rows, SCHEMA), 2.0)
    assert {r.box_id: r.n for r in got.collect()} == want


def test_relations_of_equal_bounds_are_worked_out_once(spark):
    boxes = spark.createDataFrame([(i, 0.0, 0.0, 4.0, 4.0) for i in range(300)], SCHEMA)
    assert spatial.touching_kinds(boxes, 2.0).count() == 1
    assert spatial.related_boxes(boxes, 2.0).count() == 300 * 299


def test_related_boxes_are_the_touching_ones_both_ways(spark):
    boxes = spark.createDataFrame(ROWS, SCHEMA)
    pairs = spatial.touching_boxes(boxes, 2.0).withColumn("rel", spatial.box_relation()).collect()
    turned = {4: 5, 5: 4}
    want = sorted([(r.a_box_id, r.b_box_id, r.rel) for r in pairs] + [(r.b_box_id, r.a_box_id, turned.get(r.rel, r.rel)) for r in pairs])
    assert sorted(tuple(r) for r in spatial.related_boxes(boxes, 2.0).collect()) == want
