"""Measures of boxes without pairs against all pairs, and locations named twice."""

import numpy as np
import pytest

from terraloom.operators import richness, surroundings
from terraloom.sources.views import TAGS


@pytest.mark.parametrize("seed,n,step,kinds,apart", [(0, 500, 0.1, 40, 1.0), (1, 900, 3.0, 7, 1.0), (2, 1, 1.0, 1, 1.0), (3, 2, 60.0, 1, 1.0), (4, 700, 0.5, 1, 1.0), (5, 800, 0.01, 300, 1.0), (6, 600, 0.1, 9, -1.0)])
def test_labels_cells_and_tag_counts_are_those_of_all_pairs(seed, n, step, kinds, apart, monkeypatch):
    monkeypatch.setattr(surroundings, "PART", 70)  # several parts and blocks
    monkeypatch.setattr(surroundings, "BLOCK", 16)
    rng = np.random.default_rng(seed)
    px, py, cx, cy = (np.round(rng.uniform(-60, 60, m) / step) * step for m in (n, n, 190, 190))
    lon, lat = px * 0.5, py * 0.25 * apart  # apart < 0: the order of lat is not that of y
    label = rng.integers(-1, kinds, n)
    sizes = (3.0, 6.3, 25.0)
    boxes = surroundings.Boxes(px, py, cx, cy, sizes)
    got = surroundings.repeated_labels(boxes, label, cx, cy, [2, 1, 3])
    cells = surroundings.occupied(boxes, lon, lat, 4)
    pairs = [[k, kinds + k % 3] for k in range(kinds)] + [[]]
    key, category = np.array([0] * kinds + [1, 2, 3]), np.array([k % 4 - 1 for k in range(kinds + 3)])
    total = np.array([sum(len(pairs[c]) for c in label[at]) for at in _inside(px, py, cx, cy, sizes)], float)
    tags = surroundings.tag_sums(boxes, label % (kinds + 1), pairs, key, category, total)
    for q, at in enumerate(_inside(px, py, cx, cy, sizes)):
        own = label[at][label[at] >= 0]
        assert got[q] == len(own) - len(set(own.tolist()))
        held = [p for c in own for p in pairs[c]]
        assert tags["pairs"][q] == len(set(held)) and tags["keys"][q] == sum({1 << int(key[p]) for p in held}) and tags["categories"][q] == sum({1 << int(category[p]) for p in held if category[p] >= 0})
        share = np.unique(held, return_counts=True)[1] / max(1, len(held))
        assert tags["entropy"][q] == pytest.approx(0.0 if len(share) <= 1 else -(share * np.log(share + 1e-12)).sum())
        want = 0
        if len(at) and np.ptp(lon[at]) >= 1e-9 and np.ptp(lat[at]) >= 1e-9:
            cell = [np.clip(np.ceil((v - v.min()) / ((v.max() - v.min()) / 4)) - 1, 0, 3) for v in (lon[at], lat[at])]
            want = len(set(zip(*(c.tolist() for c in cell), strict=True)))
        assert cells[q] == want


def _inside(px, py, cx, cy, sizes):
    dx, dy = np.abs(px - cx[:, None]), np.abs(py - cy[:, None])
    far = (px >= cx[:, None] - sizes[-1]) & (px <= cx[:, None] + sizes[-1]) & (py >= cy[:, None] - sizes[-1]) & (py <= cy[:, None] + sizes[-1])
    return [np.flatnonzero(row) for s in sizes for row in (dx <= s) & (dy <= s) & far]


def test_level_metrics_meet_no_pairs_and_measure_a_location_named_twice_together(spark):
    rng = np.random.default_rng(1)
    values = {"amenity": ["cafe", "YES", "3:a:b;shop:x", ""], "shop": ["bakery", "1"], "building": ["yes", "é"]}
    rows = [(i, ["point", "line", "polygon", "other"][i % 4], float(rng.uniform(-3, 3)), float(rng.uniform(-3, 3)), *[rng.choice([*values.get(t, []), None]) if t in values else None for t in TAGS]) for i in range(400)]
    rows.append((400, "point", None, 1.0, *["x"] * len(TAGS)))
    feat = spark.createDataFrame(rows, "feature_id long, geom_type string, lat double, lon double, " + ", ".join(f"`{t}` string" for t in TAGS))
    loc = spark.createDataFrame([*[(i, float(rng.uniform(-3, 3)), float(rng.uniform(-3, 3))) for i in range(30)], (3, 0.0, 0.0), (3, 0.1, 0.0), (50, None, 1.0), (51, 60.0, 60.0)], "loc_id long, lat double, lon double")
    freq = spark.createDataFrame([("amenity", 9.0), ("shop", 4.0)], "k string, freq double")  # without one of the keys
    sizes = (20_000.0, 100_000.0)
    top = spark.range(1).select(*[(richness.F.log(richness.F.lit(9.0 / f) + 1) if f else richness.F.lit(None).cast("double")).alias(f"_idf_{i}") for i, f in enumerate({"amenity": 9.0, "shop": 4.0}.get(t) for t in TAGS)])
    want = richness._by_pairs(feat, loc, top, sizes, True)
    got = richness.level_metrics(feat, loc, freq, sizes).select(want.columns)
    as_text = lambda df: sorted(repr([round(x, 9) + 0.0 if isinstance(x, float) else x for x in r]) for r in df.collect())
    assert as_text(got) == as_text(want)
    assert "Join" not in richness._measured(feat, loc, sizes, True)._jdf.queryExecution().executedPlan().toString()


def test_a_choice_among_levels_is_the_same_from_a_row_for_each_location_and_shuffles_nothing(spark):
    rng = np.random.default_rng(2)
    rows = [(i, ["point", "line", "polygon"][i % 3], float(rng.uniform(-3, 3)), float(rng.uniform(-3, 3)), *[rng.choice(["a", "b", "yes", None]) if t in ("shop", "building") else None for t in TAGS]) for i in range(200)]
    feat = spark.createDataFrame(rows, "feature_id long, geom_type string, lat double, lon double, " + ", ".join(f"`{t}` string" for t in TAGS))
    loc = spark.createDataFrame([*[(i, float(rng.uniform(-4, 4)), float(rng.uniform(-4, 4))) for i in range(40)], (50, None, 1.0), (51, 60.0, 60.0), (None, 0.0, 0.0)], "loc_id long, lat double, lon double")
    freq = spark.createDataFrame([("shop", 9.0), ("building", 4.0)], "k string, freq double")
    wide, rows = (richness.level_metrics(feat, loc, freq, (20_000.0, 60_000.0, 100_000.0), wide=w) for w in (True, False))
    as_text = lambda df: sorted(repr([round(x, 9) + 0.0 if isinstance(x, float) else x for x in r]) for r in df.collect())
    for choice in (richness.selected_level, lambda m: richness.first_rich(m, nodes=3, labels=2, keep=("richness_score",))):
        got = choice(wide)
        assert as_text(got) == as_text(choice(rows)) and got.count() == 43
        plan = got._jdf.queryExecution().optimizedPlan().toString()
        assert not any(x in plan[: plan.index("FlatMapCoGroupsInArrow")] for x in ("Aggregate", "Window", "LeftOuter"))


def test_tiles_leave_the_scan_of_what_points_are_made_of_as_it_is(spark, sf_dir):
    from terraloom.operators.scoring import location_counts
    from terraloom.sources.views import view

    plan = location_counts(view(spark, sf_dir, "feat"), view(spark, sf_dir, "loc"), 1000.0)._jdf.queryExecution().executedPlan().toString()
    assert "isnotnull(l_orderkey" not in plan  # else the shuffle of features isn't the one that counts of tags read


def test_the_jvm_compiles_every_method_of_a_choice_among_levels(spark, monkeypatch):
    sizes = (20_000.0, 60_000.0, 100_000.0)
    wide = "array(" + ", ".join(["cast(id AS double)"] * len(sizes) * len(richness._MEASURED)) + ")"
    monkeypatch.setattr(richness, "_measured", lambda *_: spark.range(9).selectExpr("id AS loc_id", "0.0D AS lat", "0.0D AS lon", f"{wide} AS m"))
    feat, loc = spark.range(0), spark.createDataFrame([(1, 0.0, 0.0)], "loc_id long, lat double, lon double")
    freq = spark.createDataFrame([(t, i + 1.0) for i, t in enumerate(TAGS)], "k string, freq double")
    debug = getattr(getattr(spark._jvm.org.apache.spark.sql.execution.debug, "package$"), "MODULE$")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        for labels, choice in ((False, richness.selected_level), (True, lambda m: richness.first_rich(m, keep=("richness_score",)))):
            df = choice(richness.level_metrics(feat, loc, freq, sizes, labels=labels, wide=True))
            stages = debug.codegenStringSeq(df._jdf.queryExecution().executedPlan())
            assert max(stages.apply(i)._3().maxMethodCodeSize() for i in range(stages.size())) < 8000  # bytes, HotSpot's limit
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
