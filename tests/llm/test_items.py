"""Operators over items, attributes and requests, against brute force."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from filigree.llm import cover, grid, groups, nearest, quota
from filigree.llm.items import category, standing, usable_items

ITEM = "dataset_id bigint, id bigint, features array<double>"
RAW = "id bigint, dataset_id bigint, features array<double>, recorded_at timestamp, loaded_at timestamp"
T = [dt.datetime(2024, 1, k + 1) for k in range(4)]


def frame(spark, sets):
    return spark.createDataFrame([(d, i, [float(v) for v in x]) for d, rows in sets.items() for i, x in rows], ITEM)


def sets(seed=0, hot=400):
    """Data set 1 has a dense blob, chains, copies and loners; 2 is small; 3 has fewer features than the grid."""
    rng = np.random.default_rng(seed)
    d1 = [*(rng.normal(0, 0.06, (hot, 8)) + 3), *(np.arange(12)[:, None] * 0.9 * np.eye(8)[0]), *(rng.uniform(-40, 40, (30, 8))), *np.repeat(rng.uniform(-20, 20, (3, 8)), [2, 5, 6], axis=0)]
    d2 = [*rng.normal(0, 0.4, (25, 5))]
    d3 = [*rng.normal(0, 1, (40, 2))]
    out, at = {}, 0
    for d, rows in ((1, d1), (2, d2), (3, d3)):
        ids = rng.permutation(len(rows)) + at
        out[d] = [(int(i), x) for i, x in zip(ids, rows)]
        at += len(rows)
    return out


def brute(rows, radius=1.0):
    x = np.stack([r[1] for r in rows])
    ids = [r[0] for r in rows]
    near = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1)) <= radius
    label = np.array(ids)
    while True:
        new = np.array([label[near[i]].min() for i in range(len(ids))])
        if (new == label).all():
            break
        label = new
    return dict(zip(ids, label.tolist())), [i for k, i in enumerate(ids) if near[k].sum() == 1]


@pytest.mark.parametrize("chunk,block,load", [(2048, 1024, 512), (37, 3, 2)])
def test_groups_equal_brute_force(spark, monkeypatch, chunk, block, load):
    monkeypatch.setattr(groups, "CHUNK", chunk)
    monkeypatch.setattr(grid, "LOAD", load)
    monkeypatch.setattr(groups, "BLOCK", block)
    data = sets()
    alike = groups.Alike(frame(spark, data))
    got = {r["id"]: r["group_id"] for r in groups.groups(alike).collect()}
    want = {}
    for rows in data.values():
        label, _ = brute(rows)
        sizes = {v: list(label.values()).count(v) for v in label.values()}
        want |= {i: v for i, v in label.items() if sizes[v] >= 5}
    assert got == want


def test_member_check_links_balls_whose_centres_are_not_alike(spark):
    rows = [(0, [0.0, 0, 0]), (1, [0.45, 0, 0]), (2, [1.9, 0, 0]), (3, [1.44, 0, 0]), (4, [1.9, 0, 0])]
    got = groups.groups(groups.Alike(frame(spark, {1: rows}))).collect()
    assert sorted((r["group_id"], r["id"]) for r in got) == [(0, i) for i in range(5)]


def test_distance_of_exactly_one_is_alike(spark):
    rows = [(i, [float(i), 1e6, 0.0]) for i in range(5)]
    assert {r["group_id"] for r in groups.groups(groups.Alike(frame(spark, {1: rows}))).collect()} == {0}


def test_dense_test_keeps_a_chain_of_single_item_cells(spark):
    rows = [(i, [3.9 * (i % 2), 0.95 * i, 0.0]) for i in range(0, 9)] + [(20 + i, [50.0, 0.99 * i, 1.0]) for i in range(5)] + [(40 + i, [90.0, 0.99 * i, 1.0]) for i in range(4)]
    got = groups.groups(groups.Alike(frame(spark, {1: rows}))).collect()
    assert sorted((r["group_id"], r["id"]) for r in got) == [(20, 20 + i) for i in range(5)]


def test_describe(spark):
    cells = [(1, 0, i, 0 if i < 4 else 1, *[0] * 5, [0.3, 0.1, 0.2, 0.1, 0.0, 0.0][i]) for i in range(6)]
    members = spark.createDataFrame(cells, "dataset_id bigint, group_id bigint, id bigint, " + ", ".join(f"{c} bigint" for c in grid.COORDS) + ", off double")
    attrs = spark.createDataFrame([(1, "c", "fern"), (3, "c", "fern"), (2, "o", ""), (9, "c", "x"), (4, "c", "moss")], "id bigint, attr_name string, category string")
    r = groups.describe(members, attrs).collect()
    assert [tuple(x) for x in r] == [(1, 0, 6, [1, 3, 2], ["c=fern"])]


def test_typical_members_are_nearest_to_the_mean_of_the_densest_cell(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(0, 0.1, (60, 6)) + 2
    members = groups.groups(groups.Alike(frame(spark, {1: [(i, v) for i, v in enumerate(x)]})))
    none = spark.createDataFrame([], "id bigint, attr_name string, category string")
    r = groups.describe(members, none).first()
    far = np.sqrt(((x - x.mean(axis=0)) ** 2).sum(1))
    assert r["size"] == 60 and r["typical_ids"] == np.argsort(far)[:3].tolist() and r["categories"] == []


@pytest.mark.parametrize("split", [50_000, 20])
def test_lone_items_equal_brute_force(spark, monkeypatch, split):
    monkeypatch.setattr(cover, "SPLIT", split)
    data = sets()
    # an item near a member of a cell, but not near its stand-in
    data[2] += [(9000, [50.0, 0, 0, 0, 0]), (9001, [50.9, 0, 0, 0, 0]), (9002, [51.7, 0, 0, 0, 0]), (9003, [60.0, 0, 0, 0, 0]), (9004, [60.0, 0, 0, 1.0, 0]), (9005, [70.0, 0, 0, 1.001, 0])]
    asks = spark.createDataFrame([(1, 60), (2, 10)], "dataset_id bigint, subset_size int")
    got = cover.only_by_themselves(frame(spark, data), asks)
    assert sorted(r["id"] for r in got.collect()) == sorted(i for d in (1, 2) for i in brute(data[d])[1])


def test_empty_tables(spark):
    none = frame(spark, {})
    alike = groups.Alike(none)
    assert groups.groups(alike).count() == 0
    assert nearest.nearest(none).count() == 0
    asks = spark.createDataFrame([(1, 3)], "dataset_id bigint, subset_size int")
    assert cover.only_by_themselves(none, asks).count() == 0 and cover.round_robin(none, asks).count() == 0 and cover.round_robin(frame(spark, sets()), asks.limit(0)).count() == 0


def test_usable_items(spark):
    ok, nan, inf = [1.0, 2.0], float("nan"), float("inf")
    rows = [
        (1, 1, ok, T[0], T[0]), (1, 1, [9.0, 9.0], T[0], T[1]), (1, 1, [9.0, 9.0], T[0], T[1]), (2, None, ok, T[0], T[0]), (3, 1, None, T[0], T[0]), (4, 1, [], T[0], T[0]),
        (5, 1, [1.0], T[0], T[0]), (6, 1, [1.0, None], T[0], T[0]), (7, 1, [1.0, nan], T[0], T[0]), (8, 1, [1.0, -inf], T[0], T[0]), (9, 1, [-999.0, 1.0], T[0], T[0]),
        (10, 1, [0.0, 0.0], T[0], T[0]), (11, 1, ok, T[0], None), (12, 7, ok, T[0], T[0]), (None, 1, ok, T[0], T[0]), (13, 1, ok, T[0], T[0]), (13, 1, [0.0, 0.0], T[0], T[1]), (14, 2, ok, T[0], T[0]),
    ]
    items = spark.createDataFrame(rows, RAW).withColumn("n_features", F.lit(5)).withColumn("rn", F.lit(1))
    ds = spark.createDataFrame([(1, 2, "a"), (1, 2, "a"), (2, None, "b")], "dataset_id bigint, n_features int, features string")
    assert sorted((r["id"], r["features"]) for r in usable_items(items, ds).collect()) == [(1, [9.0, 9.0]), (11, ok)]
    assert usable_items(items.limit(0), ds).count() == usable_items(items, ds.limit(0)).count() == 0


def test_standing_ties_are_settled(spark):
    t = spark.createDataFrame([(1, "b", T[0]), (1, "a", T[0]), (2, None, None), (2, "x", None)], "id bigint, v string, loaded_at timestamp")
    assert sorted((r["id"], r["v"]) for r in standing(t, ["id"]).collect()) == [(1, "b"), (2, "x")]


def test_category(spark):
    t = spark.createDataFrame([(" Slate-South ",), ("slate _south",), ("slate\tsouth\n",), ("slate",), (None,), ("",)], "v string")
    assert [r[0] for r in t.select(category(F.col("v"))).collect()] == ["slate south", "slate south", "slate south", "slate", None, ""]


@pytest.mark.parametrize("block", [1024, 7])
def test_nearest_equals_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(nearest, "BLOCK", block)
    data = sets(hot=120)
    df = frame(spark, data)
    want = []
    for rows in data.values():
        x, ids = np.stack([r[1] for r in rows]), np.array([r[0] for r in rows])
        for k, i in enumerate(ids):
            d = np.sqrt(((x - x[k]) ** 2).sum(1))
            order = [j for j in np.lexsort((ids, d)) if j != k][:10]
            want += [(int(i), int(ids[j]), r + 1) for r, j in enumerate(order)]
    assert sorted((r["src"], r["dst"], r["rank"]) for r in nearest.nearest(df).collect()) == sorted(want)
    some = df.where("id % 17 = 0")
    got = sorted((r["src"], r["dst"], r["rank"]) for r in nearest.nearest(df, some).collect())
    assert got == sorted(w for w in want if w[0] % 17 == 0)


def test_nearest_with_few_items(spark):
    df = frame(spark, {1: [(5, [1.0, 2.0])], 2: [(6, [0.0]), (7, [0.0]), (8, [3.0])]})
    assert sorted((r["src"], r["dst"]) for r in nearest.nearest(df).collect()) == [(6, 7), (6, 8), (7, 6), (7, 8), (8, 6), (8, 7)]


def test_round_robin(spark):
    data = sets()
    df = frame(spark, data)
    asks = spark.createDataFrame([(1, 60), (2, 1000), (3, 0), (9, 5), (None, 4), (1, 10)], "dataset_id bigint, subset_size int")
    got = cover.round_robin(df, asks).collect()
    by = {d: sorted(r["place"] for r in got if r["dataset_id"] == d) for d in (1, 2, 3)}
    assert by[1] == list(range(1, 61)) and by[2] == list(range(1, 26)) and not by[3]
    picked = {r["id"] for r in got}
    lone = brute(data[1])[1]
    assert len(picked & set(lone)) >= 0.8 * len(lone)
    blob = {i for i, x in data[1] if abs(x - 3).max() < 1}
    assert len(picked & blob) <= 30
    assert sorted(map(tuple, got)) == sorted(map(tuple, cover.round_robin(df.repartition(3), asks).collect()))


def test_round_robin_below_the_number_of_cells_keeps_large_groups_and_lone_items(spark):
    rng = np.random.default_rng(3)
    at = 4.0 * rng.permutation(8000)[:60, None] // np.array([1, 20, 400]) % 80 + 0.5
    rows = [x for k, c in enumerate(at) for x in (c + rng.normal(0, 0.02, (10, 3)) if k < 20 else [c])]
    df = frame(spark, {1: list(enumerate(rows))})
    picked = [r["id"] for r in cover.round_robin(df, spark.createDataFrame([(1, 30)], "dataset_id bigint, subset_size int")).collect()]
    large = {i // 10 for i in picked if i < 200}
    assert len(picked) == 30 and len(large) >= 5 and sum(i >= 200 for i in picked) >= 10


def test_round_robin_sees_features_outside_the_grid(spark):
    rng = np.random.default_rng(5)
    rows = []
    for c in rng.permutation(10) * 10.0 + 0.5:
        rows += [[c, -c, 2 * c, 3.0 * (k + 1), 0] for k in range(3)]
        rows += [[c, -c, 2 * c, 0, v] for v in rng.uniform(-0.2, 0.2, 20)]
    df = frame(spark, {1: list(enumerate(rows))})
    picked = [r["id"] for r in cover.round_robin(df, spark.createDataFrame([(1, 40)], "dataset_id bigint, subset_size int")).collect()]
    assert len(picked) == 40 and sum(i % 23 < 3 for i in picked) == 30
    assert {i // 23 for i in picked if i % 23 >= 3} == set(range(10))


def test_flow_meets_targets_floors_and_shows_shortfalls():
    quota_, short = quota.solve({"a": 10, "b": 5, "c": 3}, {("a", "x"): 6, ("a", "y"): 20, ("b", "x"): 2, ("d", "x"): 9})
    drawn = {k: sum(n for (c, _), n in quota_.items() if c == k) for k in "abc"}
    assert drawn == {"a": 10, "b": 2, "c": 0} and short == {"a": 0, "b": 3, "c": 3}
    assert all(n <= {("a", "x"): 6, ("a", "y"): 20, ("b", "x"): 2}[k] for k, n in quota_.items())
    assert quota.solve({}, {}) == ({}, {}) and quota.solve({"a": 2}, {}) == ({}, {"a": 2})


def test_flow_keeps_the_make_up_of_what_is_there():
    quota_, _ = quota.solve({"a": 30, "b": 30}, {("a", "x"): 300, ("a", "y"): 100, ("b", "x"): 300, ("b", "y"): 100})
    assert sum(n for (_, o), n in quota_.items() if o == "x") == 45


@pytest.mark.parametrize("seed", range(25))
def test_flow_is_cheapest(seed):
    """Against the bound that any flow obeys: full demand where there is room, and the least unavoidable excess."""
    rng = np.random.default_rng(seed)
    want = {f"k{i}": int(rng.integers(0, 15)) for i in range(4)}
    have = {(f"k{i}", f"o{j}"): int(rng.integers(0, 10)) for i in range(4) for j in range(3)}
    q, short = quota.solve(want, have, seed)
    room = {k: sum(n for (c, _), n in have.items() if c == k) for k in want}
    for k in want:
        assert short[k] == max(0, want[k] - room[k])
        assert sum(n for (c, _), n in q.items() if c == k) == min(want[k], room[k])
    assert all(0 < n <= have[c] for c, n in q.items())


def test_quotas_and_draw(spark):
    items = [(i, 1, [1.0], T[0], T[0]) for i in range(60)] + [(3, 2, [1.0], T[0], T[1]), (None, 1, None, None, None), (70, None, None, T[0], T[0])]
    attrs = [(i, "c", ["Fern", "fern ", "FERN", "oak"][i % 4], T[0]) for i in range(60)] + [(i, "o", "x" if i % 2 else "y", T[0]) for i in range(60)]
    attrs += [(4, "c", "oak", T[1]), (4, "c", "oak", T[1]), (5, "c", None, T[2]), (None, "c", "fern", T[0]), (6, None, "z", T[0]), (70, "c", "fern", T[0])]
    items = spark.createDataFrame(items, RAW).withColumn("attr_name", F.lit("clash"))
    attrs = spark.createDataFrame(attrs, "id bigint, attr_name string, attr_value string, loaded_at timestamp").withColumn("dataset_id", F.lit(5))
    targets = spark.createDataFrame([(1, 1, "c", "fern", 0.5, 20, 1), (1, 1, "c", "Oak", 0.5, 20, 30), (1, 1, "c", "elm", None, None, 2), (2, 9, "c", "fern", 1.0, 4, None), (3, 1, "c", "elm", 0.0, 9, 0), (None, 1, "c", "x", 1.0, 1, 1)], "request_id bigint, dataset_id bigint, attr_name string, category string, target_share double, sample_size int, min_rows int")
    held, want = quota.holdings(items, attrs), quota.wanted(targets)
    report = quota.quotas(want, held)
    assert sorted(map(tuple, quota.short_of(report).collect())) == [(1, "Oak"), (1, "elm"), (2, "fern")]
    rows = {(r["request_id"], r["category"]): (r["want"], r["available"], r["quota"], r["shortfall"]) for r in report.where("other IS NULL").collect()}
    # the floors alone exceed the size
    assert rows[1, "fern"] == (10, 43, 1, 0) and rows[1, "Oak"] == (30, 15, 15, 15)
    sample = quota.draw(report, want, held).collect()
    assert len(sample) == len({(r["request_id"], r["id"]) for r in sample}) == 16
    assert quota.quotas(want.limit(0), held).count() == 0 and quota.short_of(quota.quotas(want, held.limit(0))).count() == 4


def test_goals_keep_the_sample_size_where_floors_exceed_targets():
    assert quota.goals({"a": 12, "b": 6, "c": 2}, {"a": 1, "b": 1, "c": 5}) == {"a": 10, "b": 5, "c": 5}
    assert quota.goals({"a": 5, "b": 5}, {"a": 0, "b": 2}) == {"a": 5, "b": 5}
    assert quota.goals({"a": 3, "b": 1}, {"a": 3, "b": 4}) == {"a": 3, "b": 4}
    q, short = quota.solve({"a": 10, "b": 5}, {("a", "x"): 9, ("b", "x"): 9}, goal={"a": 7, "b": 5})
    assert q == {("a", "x"): 7, ("b", "x"): 5} and short == {"a": 1, "b": 0}


def test_rare_classes_of_other_attributes_are_one(spark, monkeypatch):
    monkeypatch.setattr(quota, "CLASSES", 3)
    items = spark.createDataFrame([(i, 1, [1.0], T[0], T[0]) for i in range(40)], RAW)
    attrs = spark.createDataFrame([(i, "c", "fern", T[0]) for i in range(40)] + [(i, "o", f"v{min(i // 10, 1) if i < 30 else i}", T[0]) for i in range(40)], "id bigint, attr_name string, attr_value string, loaded_at timestamp")
    held = quota.holdings(items, attrs).where("attr_name = 'c'")
    assert sorted((r["other"], r["count"]) for r in held.groupBy("other").count().collect()) == [("*", 10), ("o=v0", 10), ("o=v1", 20)]
    want = quota.wanted(spark.createDataFrame([(1, 1, "c", "fern", 1.0, 20, 0)], "request_id bigint, dataset_id bigint, attr_name string, category string, target_share double, sample_size int, min_rows int"))
    assert quota.draw(quota.quotas(want, held), want, held).count() == 20


def test_standing_duplicates_of_a_request_share_their_items(spark):
    held = spark.createDataFrame([(i, 1, "c", "fern", "") for i in range(4)], "id bigint, dataset_id bigint, attr_name string, kind string, other string")
    targets = spark.createDataFrame([(1, 1, "c", "fern", 0.5, 6, 0), (1, 1, "c", "FERN", 0.5, 6, 0)], "request_id bigint, dataset_id bigint, attr_name string, category string, target_share double, sample_size int, min_rows int")
    report = quota.quotas(quota.wanted(targets), held)
    assert quota.short_of(report).count() == 0
    assert {r["shortfall"] for r in report.where("other IS NULL").collect()} == {2}
