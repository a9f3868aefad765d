"""Moments, Newton steps and histogram trees against SQL and plain numpy."""

import inspect
import os

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from claimspark.operators import evaluation as ev
from claimspark.operators import logistic, moments, trees

NAMES = ["a", "b", "c", "d"]


@pytest.fixture(scope="module")
def table():
    rng = np.random.default_rng(8)
    n = 1500
    a, b = rng.normal(0, 2, n).round(3), rng.integers(0, 6, n).astype(float)
    c, d = (rng.random(n) < 0.3).astype(float), np.full(n, 4.0)
    p = 1 / (1 + np.exp(-(0.8 * a - 0.5 * b + 1.5 * c * (a > 0))))
    return pd.DataFrame({"id": np.arange(n), "label": (rng.random(n) < p).astype(float), "a": a, "b": b, "c": c, "d": d})


@pytest.fixture(scope="module")
def rows(spark, table):
    return spark.createDataFrame(table).repartition(5).persist()


# --- moments -----------------------------------------------------------------------------

def test_moments_match_sql_and_do_not_depend_on_partitions(rows, table):
    found = moments.moments(rows, NAMES)
    con = duckdb.connect()
    con.register("t", table)
    for name, mean, deviation in zip(found.names, found.mean, found.deviation):
        want = con.execute(f"SELECT avg({name}), stddev_pop({name}) FROM t").fetchall()[0]
        assert abs(mean - want[0]) < 1e-6 and abs(deviation - want[1]) < 1e-6
    assert moments.moments(rows.coalesce(1), NAMES) == found and found.n == len(table)
    scaled = found.apply(rows).agg(*[f(c).alias(f"{c}{i}") for c in NAMES for i, f in enumerate((F.avg, F.stddev_pop))]).first()
    assert all(abs(scaled[f"{c}0"]) < 1e-9 for c in NAMES)
    assert all(abs(scaled[f"{c}1"] - 1) < 1e-9 for c in "abc") and scaled["d1"] == 0  # a constant column


def test_moments_of_large_values_keep_their_digits(spark):
    df = spark.createDataFrame([(1e9 + i % 2,) for i in range(1000)], "x double")
    found = moments.moments(df, ["x"])
    assert found.mean == [1e9 + 0.5] and found.deviation == [0.5]  # sums of squares of doubles would lose this
    empty = moments.moments(df.filter("x < 0"), ["x"])
    assert (empty.n, empty.mean, empty.deviation) == (0, [0.0], [0.0])
    assert [tuple(r) for r in found.table(df).collect()] == [("x", 1000, 1e9 + 0.5, 0.5)]


# --- Newton steps -----------------------------------------------------------------------------

def test_gradient_at_the_solution_is_zero_in_sql(rows, table):
    fit = logistic.fit_logistic(rows, NAMES)
    con = duckdb.connect()
    con.register("t", table)
    margin = " + ".join([f"{w!r}::DOUBLE * {c}" for c, w in zip(NAMES, fit.weights)] + [f"{fit.intercept!r}::DOUBLE"])
    error = f"1 / (1 + exp(-({margin}))) - label"
    for c, w in zip(NAMES, fit.weights):
        assert abs(con.execute(f"SELECT sum(({error}) * {c}) FROM t").fetchall()[0][0] + w) < 1e-6 * len(table)
    assert abs(con.execute(f"SELECT sum({error}) FROM t").fetchall()[0][0]) < 1e-6 * len(table)
    assert fit.steps < 15 and fit.gradient < 1e-9
    score = fit.score(rows).agg(F.min("probability").alias("lo"), F.max("probability").alias("hi"),
                                F.avg(((F.col("probability") > 0.5).cast("int") == F.col("prediction")).cast("int")).alias("same")).first()
    assert 0 <= score["lo"] < score["hi"] <= 1 and score["same"] == 1


def test_newton_on_separable_and_on_no_rows(spark):
    df = spark.createDataFrame([(float(i > 5), float(i)) for i in range(12)], "label double, x double")
    fit = logistic.fit_logistic(df, ["x"])
    assert fit.weights[0] > 0 and fit.gradient < 1e-9  # the penalty keeps it finite
    assert logistic.fit_logistic(df.filter("x < 0"), ["x"]).weights == [0.0]


# --- trees -------------------------------------------------------------------------------------------

def test_bins_hold_every_distinct_value_of_a_small_column(rows, table):
    bins = trees.fit_bins(rows, NAMES, max_bins=32)
    assert bins.edges[1].tolist() == sorted(table.b.unique()) and bins.edges[3].tolist() == [4.0]
    assert len(bins.edges[0]) <= 31
    cut = bins.apply(rows, ["id"]).toPandas().set_index("id")["bins"]
    want = np.column_stack([np.searchsorted(e, table[c]) for e, c in zip(bins.edges, NAMES)])
    assert all(list(cut[i]) == want[i].tolist() for i in range(len(table)))
    with pytest.raises(ValueError):
        trees.fit_bins(rows, NAMES, max_bins=300)


def _node_filters(tree):
    """SQL condition of the rows that reach each node."""
    out = {0: "true"}
    for i, f in enumerate(tree.feature):
        if f >= 0:
            out[tree.left[i]] = f"{out[i]} AND f{f} <= {tree.cut[i]}"
            out[tree.left[i] + 1] = f"{out[i]} AND f{f} > {tree.cut[i]}"
    return out


def _sql_splits(con, where, k, g, h, n, worth, least):
    """Every (gain, feature, bin) of a node, best first, by SQL."""
    parts = [f"SELECT {f} AS feature, f{f} AS bin, sum({g}) AS g, sum({h}) AS h, sum({n}) AS n FROM t WHERE {where} GROUP BY 2" for f in range(k)]
    return con.execute(f"""
        WITH c AS ({' UNION ALL '.join(parts)}),
        l AS (SELECT feature, bin, sum(g) OVER w AS gl, sum(h) OVER w AS hl, sum(n) OVER w AS nl, sum(g) OVER f AS ga, sum(h) OVER f AS ha,
              sum(n) OVER f AS na FROM c WINDOW w AS (PARTITION BY feature ORDER BY bin), f AS (PARTITION BY feature)),
        v AS (SELECT *, {worth} AS gain FROM l WHERE {least})
        SELECT gain, feature, bin, nl, na FROM v ORDER BY gain DESC, feature, bin""").fetchall()


@pytest.fixture(scope="module")
def binned(rows):
    bins = trees.fit_bins(rows, NAMES, max_bins=32)
    df = bins.apply(rows.withColumn("key", F.xxhash64("id")), ["key", "label"]).persist()
    return bins, df


def _frame(df, k):
    pdf = df.toPandas()
    x = np.array([list(b) for b in pdf.bins])
    return pd.DataFrame({"key": pdf.key, "label": pdf.label, **{f"f{i}": x[:, i] for i in range(k)}}), x


def test_every_boosted_split_is_the_best_by_sql(binned):
    bins, df = binned
    model = trees.fit_boosted(df, bins, rounds=12, max_depth=3)
    assert len(model.trees) == 12 > trees.KEEP_ROUNDS  # the margins are written once on the way
    t, x = _frame(df, len(NAMES))
    margin = np.full(len(t), model.base)
    unit = 1 << trees.SCALE
    con, checked = duckdb.connect(), 0
    for tree in model.trees:
        p = 1 / (1 + np.exp(-margin))
        t["g"], t["h"] = np.rint((p - t.label) * unit) / unit, np.rint(p * (1 - p) * unit) / unit
        con.register("t", t)
        for node, where in _node_filters(tree).items():
            g, h, n = con.execute(f"SELECT sum(g), sum(h), count(*) FROM t WHERE {where}").fetchall()[0]
            assert n == tree.rows[node] and abs(tree.value[node] + 0.3 * g / (h + 1)) < 1e-6
            if tree.depth[node] == 3:
                continue
            found = _sql_splits(con, where, len(NAMES), "g", "h", "1",
                                "gl * gl / (hl + 1) + (ga - gl) * (ga - gl) / (ha - hl + 1) - ga * ga / (ha + 1)",
                                "hl >= 1 AND ha - hl >= 1 AND nl < na")
            if tree.feature[node] < 0:
                assert not found or found[0][0] <= 1e-9 or n <= 1
                continue
            checked += 1
            assert abs(found[0][0] - tree.gain[node]) < 1e-5
            own = {(f, b): gain for gain, f, b, *_ in found}
            assert own[tree.feature[node], tree.cut[node]] > found[0][0] - 1e-6
        margin += np.array(tree.value)[trees.leaf_of(tree.arrays(), x)]
        con.unregister("t")
    assert checked > 30
    assert df.rdd.getNumPartitions() > 1
    again = trees.fit_boosted(df.coalesce(1), bins, rounds=12, max_depth=3)  # one task: no shuffle
    assert again.splits() == model.splits()  # whole-number sums: the same trees on any partitioning


def test_every_forest_split_is_the_best_of_its_features_by_sql(binned, monkeypatch):
    bins, df = binned
    model = trees.fit_forest(df, bins, trees=3, max_depth=6, few=2)
    t, _ = _frame(df, len(NAMES))
    con, checked = duckdb.connect(), 0
    for number, tree in enumerate(model.trees):
        t["w"] = trees.bootstrap(t.key.to_numpy(), number, 42)
        con.register("t", t)
        for node, where in _node_filters(tree).items():
            p, n = con.execute(f"SELECT sum(w * label), sum(w) FROM t WHERE {where}").fetchall()[0]
            assert n == tree.rows[node] and abs(tree.value[node] - p / n) < 1e-12
            if tree.feature[node] < 0:
                continue
            found = _sql_splits(con, where, len(NAMES), "w * label", "w", "w",
                                "2 * ga * (ha - ga) / ha - 2 * gl * (hl - gl) / hl - 2 * (ga - gl) * (ha - hl - ga + gl) / (ha - hl)",
                                "nl > 0 AND nl < na")
            picked = trees.chosen(number, node, len(NAMES), 2, 42)
            best = next(r for r in found if r[1] in picked)
            assert tree.feature[node] in picked and abs(best[0] - tree.gain[node]) < 1e-6
            checked += 1
        con.unregister("t")
    assert checked > 40
    monkeypatch.setattr(trees, "MAX_CELLS", 200)  # open nodes in groups
    assert trees.fit_forest(df.coalesce(2), bins, trees=3, max_depth=6, few=2).splits() == model.splits()


def test_bootstrap_draws_one_of_each_on_average():
    key = np.random.default_rng(1).integers(-1 << 62, 1 << 62, 200_000)
    drawn = trees.bootstrap(key, 3, 42)
    assert abs(drawn.mean() - 1) < 0.01 and abs(drawn.var() - 1) < 0.02
    assert abs(np.corrcoef(drawn, trees.bootstrap(key, 4, 42))[0, 1]) < 0.01


def test_models_rank_and_score_every_row(binned, rows):
    bins, df = binned
    for model in (trees.fit_boosted(df, bins, rounds=15, max_depth=3), trees.fit_forest(df, bins, trees=12, max_depth=8)):
        scored = model.score(rows, ["id", "label"]).persist()
        assert scored.count() == rows.count() and scored.filter("probability NOT BETWEEN 0 AND 1").count() == 0
        assert ev.auc(scored, "label", "probability").first()["auc"] > 0.8
        shares = model.importances()
        assert abs(sum(shares.values()) - 1) < 1e-9 and max(shares, key=shares.get) == "a" and shares["d"] == 0


def test_trees_of_one_class_and_of_no_rows(binned, rows):
    bins, df = binned
    for part, low, high in (("label = 1", 0.99, 1), ("label = 0", 0, 0.01), ("label > 1", 0.5, 0.5)):
        model = trees.fit_boosted(df.filter(part), bins, rounds=2)
        assert model.trees == []
        assert model.score(rows, ["id"]).filter(~F.col("probability").between(low, high)).count() == 0
    pure = trees.fit_forest(df.filter("label = 1"), bins, trees=2)
    assert [len(t.feature) for t in pure.trees] == [1, 1]
    assert pure.score(rows, ["id"]).filter("probability <> 1").count() == 0
    assert trees.fit_forest(df.filter("label > 1"), bins, trees=2).score(rows, ["id"]).filter("probability <> 0").count() == 0


def test_a_model_is_fitted_without_the_others(rows, monkeypatch):
    from claimspark.plans.models_full import FullModels

    def other(*_, **__):
        raise AssertionError("a fit that nothing reads")

    data = rows.withColumn("is_test", (F.col("id") % 5 == 0).cast("int"))
    models = FullModels(data, "id", NAMES, n_trees=3, rounds=3, forest_depth=4)
    with monkeypatch.context() as m:
        m.setattr(trees, "fit_forest", other)
        m.setattr(logistic, "fit_logistic", other)
        boosted = {r.id: r.probability for r in models.scored("boosted").collect()}
        assert len(boosted) == 300 and models.splits().count() > 3
    both = {r.id: r for r in models.scores().collect()}
    assert {i: r.probability_boosted for i, r in both.items()} == boosted
    assert all(r.probability_forest is not None and r.probability_logistic is not None for r in both.values())


def test_gradients_are_made_once_a_round(binned, tmp_path, monkeypatch):
    """Not again for every level of the round's tree."""
    bins, df = binned
    calls, block = tmp_path / "calls", trees._block

    def counted(*args):
        with open(calls, "a") as f:
            f.write("x")
        return block(*args)

    monkeypatch.setattr(trees, "_block", counted)
    model = trees.fit_boosted(df.coalesce(1), bins, rounds=4, max_depth=4)
    assert len(model.trees) == 4 and len(calls.read_text()) == 4


def test_moments_of_whole_and_broken_values_together(spark):
    values = [3.0, -2.0, 0.25, 1e9 + 0.5, 2e9, -0.0, 1e-6, 0.0000005]
    df = spark.createDataFrame([(v,) for v in values], "x double")
    exact = [round(v * 10 ** 6 + 1e-9) for v in values]
    found = moments.moments(df, ["x"])
    assert found.mean[0] == pytest.approx(sum(exact) / len(values) / 10 ** 6, rel=1e-15)
    assert found.deviation[0] == pytest.approx(float(np.std(values)), rel=1e-12)
    assert moments.moments(spark.createDataFrame([(None,), (2.0,)], "x double"), ["x"]).mean == [1.0]  # nulls count in n


def test_bins_come_from_sketches_of_the_tasks(rows, table, monkeypatch):
    """No aggregate of all features ends in one task; ranks keep the accuracy, few values are exact."""
    monkeypatch.delattr(F, "percentile_approx")
    exact, rough = trees.fit_bins(rows, NAMES, max_bins=32), trees.fit_bins(rows, NAMES, max_bins=32, accuracy=40)
    for i, name in enumerate(NAMES):
        values = np.sort(table[name].to_numpy(float))
        ranks = -(-np.arange(1, 32) * len(values) // 32)
        assert exact.edges[i].tolist() == np.unique(values[ranks - 1]).tolist()
        low, high = (np.searchsorted(values, rough.edges[i], side=side) for side in ("left", "right"))  # ranks of each edge
        wide = len(values) / 40 + 1
        assert all(np.any((low < r + wide) & (high >= r - wide)) for r in ranks)
    values, n = trees._thinned(np.arange(1000.0), np.ones(1000, np.int64), 10)
    assert values.tolist() == [99.0 + 100 * i for i in range(10)] and n.tolist() == [100] * 10


def test_features_of_many_nodes_are_drawn_by_tasks(spark, tmp_path, monkeypatch):
    calls, one = tmp_path / "calls", trees.chosen

    def counted(*args):
        with open(calls, "a") as f:
            f.write(f"{os.getpid()}\n")
        return one(*args)

    monkeypatch.setattr(trees, "chosen", counted)
    nodes = [(i % 7, 3 * i) for i in range(1500)]
    picks = trees.chosen_all(spark, nodes, 20, 4, 42)
    assert picks.tolist() == [one(t, node, 20, 4, 42).tolist() for t, node in nodes]
    drawn_by = calls.read_text().split()
    assert len(drawn_by) == 1500 and str(os.getpid()) not in drawn_by
    assert trees.chosen_all(spark, nodes[:3], 20, 4, 42).tolist() == picks[:3].tolist()


def test_small_levels_need_no_shuffle(binned, monkeypatch):
    """The sums of a level with few cells take one stage; many cells are brought together by a shuffle, with the same trees."""
    bins, df = binned
    monkeypatch.setattr(trees, "GATHERED_CELLS", 0)
    want = trees.fit_boosted(df, bins, rounds=3, max_depth=3).splits()
    monkeypatch.undo()

    def none(*_):
        raise AssertionError("a shuffle")

    monkeypatch.setattr(type(df), "repartition", none)
    assert df.rdd.getNumPartitions() > 1 and trees.fit_boosted(df, bins, rounds=3, max_depth=3).splits() == want


def test_the_larger_child_is_a_difference(binned, monkeypatch):
    """One node's sums are enough for a level with two nodes."""
    bins, df = binned
    want = trees.fit_boosted(df, bins, rounds=3, max_depth=2).splits()
    assert {row[2] for row in want} == {0, 1}

    def none(*_):
        raise AssertionError("a shuffle")

    monkeypatch.setattr(trees, "GATHERED_CELLS", df.rdd.getNumPartitions() * 3 * int(bins.sizes.sum()))
    monkeypatch.setattr(type(df), "repartition", none)
    monkeypatch.setattr(type(df.rdd), "reduceByKey", none)
    assert trees.fit_boosted(df, bins, rounds=3, max_depth=2).splits() == want


@pytest.mark.parametrize("sizes", [[256, 3, 1, 3, 8, 256, 16, 3, 64, 13], [1, 1], [2] * 20, [255, 2], [256, 1, 128, 2]])
def test_bundles_hold_the_bins_of_their_features(sizes):
    rng = np.random.default_rng(3)
    x = np.column_stack([rng.integers(0, n, 500) for n in sizes]).astype(np.uint8)
    x[0], x[1] = np.array(sizes) - 1, 0
    bundles = trees.Bundles(np.array(sizes))
    assert sorted(f for own in bundles.members for f in own) == list(range(len(sizes))) and max(bundles.codes) <= 256
    codes = bundles.pack(x)
    for f in range(len(sizes)):
        assert bundles.bins_of(codes, f).tolist() == x[:, f].tolist()
    sums = bundles.sums_of([np.bincount(c, minlength=n)[None] for c, n in zip(codes, bundles.codes)])
    assert sums[0].tolist() == [n for f, size in enumerate(sizes) for n in np.bincount(x[:, f], minlength=size)]
    tree = trees.Tree()
    tree.add(0.0, 500, 0)
    for node in range(120):
        f = node % len(sizes)
        tree.split(node, f, sizes[f] // 3, 1.0, (0.0, 1), (0.0, 1))
    for few in (True, False):
        grown = tree.arrays()
        assert (len(tree.feature) <= 256) == few
        assert bundles.leaf_of(grown, codes).tolist() == trees.leaf_of(grown, x).tolist()
        for node in range(120, 200) if few else ():
            tree.split(node, node % len(sizes), 0, 1.0, (0.0, 1), (0.0, 1))


def test_drawn_rows_lie_node_by_node(binned):
    """As (block, row, weight, node): moved to the children of their nodes, finished ones left out."""
    bins, df = binned
    k, trees_n = len(NAMES), 4

    def flat(blocks):
        out = []
        for label, x, row, weight, node, size in (trees._opened(b, k) for b in blocks):
            assert size.sum() == len(row) == len(weight) and (size > 0).all() and (np.diff(node) > 0).all()
            out += [(label[r], tuple(x[:, r]), w, at) for r, w, at in zip(row, weight, np.repeat(node, size).tolist())]
        return sorted(out)

    blocks = trees._drawn(df.coalesce(2), trees_n, k, 42).rdd.map(tuple).persist()
    first = flat(blocks.collect())
    drawn = [trees.bootstrap(np.array([r.key for r in df.collect()]), t, 42) for t in range(trees_n)]
    assert sum(int(w) for *_, w, _ in first) == sum(int(w.sum()) for w in drawn)
    feature, cut = np.array([0, 1, 2, 0]), np.array([3, 0, 1, 255])
    child = np.array([[0, 1], [2, -1], [-1, -1], [3, 4]])
    moved = [(y, x, w, child[at, int(x[feature[at]] > cut[at])]) for y, x, w, at in first]
    assert flat(trees._moved(blocks, k, feature, cut, child).collect()) == sorted(m for m in moved if m[-1] >= 0)
    assert trees._moved(blocks, k, feature, cut, np.full((4, 2), -1)).collect() == []
    blocks.unpersist()


def test_newton_steps_read_the_rows_once(rows, tmp_path):
    calls = tmp_path / "calls"

    def counted(batches):
        with open(calls, "a") as f:
            f.write("x")
        yield from batches

    data = rows.select("label", *NAMES).coalesce(1)
    fit = logistic.fit_logistic(data.mapInArrow(counted, data.schema), NAMES)
    assert fit.steps > 2 and len(calls.read_text()) == 1


def _registered(spark, monkeypatch):
    """The registered models' fits on a few rows, without fitting: their arguments."""
    import __spark_entry__ as E

    asked = {}
    monkeypatch.setattr(E, "_MODELS", {})
    monkeypatch.setattr(E, "_features", lambda *_: None)
    data = spark.range(40).select("id", F.col("id").alias("claim_id"), (F.col("id") % 2).cast("double").alias("label"),
                                  *[F.col("id").cast("double").alias(c) for c in E.models.FEATURES], (F.col("id") % 5 == 0).cast("int").alias("is_test"))
    monkeypatch.setattr(E, "model_rows", lambda _: data)
    for name in ("fit_forest", "fit_boosted"):
        def fit(rows, bins, *args, kind=name, one=getattr(trees, name), **kw):
            bound = inspect.signature(one).bind(rows, bins, *args, **kw)
            bound.apply_defaults()
            asked[kind] = bound.arguments
            return trees.TreeModel(bins, [], kind == "fit_boosted")
        monkeypatch.setattr(trees, name, fit)
    return E, asked


def test_the_registered_boosted_trees_take_every_round(spark, monkeypatch):
    E, asked = _registered(spark, monkeypatch)
    E.ml_boosted(spark, "some folder").count()
    assert asked["fit_boosted"]["rounds"] == 100 and asked["fit_boosted"]["max_depth"] == 6


def test_the_registered_forest_has_every_tree_and_no_depth_limit(spark, monkeypatch):
    E, asked = _registered(spark, monkeypatch)
    E.ml_forest(spark, "some folder").count()
    assert asked["fit_forest"]["trees"] == 100 and asked["fit_forest"]["max_depth"] is None


def test_a_forest_grows_until_its_nodes_are_pure(spark):
    """Labels that change with every value need more than 30 levels."""
    rows = spark.range(960).select("id", (F.floor(F.col("id") / 8) % 2).cast("double").alias("label"), F.floor(F.col("id") / 8).cast("double").alias("x")).coalesce(1)
    bins = trees.fit_bins(rows, ["x"])
    model = trees.fit_forest(bins.apply(rows.withColumn("key", F.xxhash64("id")), ["key", "label"]), bins, trees=2)
    for tree in model.trees:
        assert max(tree.depth) > 30 and all(v in (0, 1) for f, v in zip(tree.feature, tree.value) if f < 0)


def test_the_registered_scores_come_from_whole_models(spark, monkeypatch):
    """All three models of one table of scores, each with the library's own defaults."""
    E, asked = _registered(spark, monkeypatch)
    models = E._models(spark, "some folder")
    assert E.MODEL_ARGS == {} and models.max_steps == 500
    assert {"probability_logistic", "probability_forest", "probability_boosted"} <= set(E.ml_score(spark, "some folder").columns)
    assert (asked["fit_forest"]["trees"], asked["fit_boosted"]["rounds"]) == (100, 100)


def test_blocks_of_the_regression_are_small_and_without_loss(spark):
    """A byte a row for a column of few values, and one block at a time in a task."""
    import pyarrow as pa

    rng = np.random.default_rng(5)
    columns = [np.array([0.0, 1.0])[rng.integers(0, 2, 5000)], rng.normal(0, 1, 5000), rng.integers(0, 300, 5000) / 7, rng.integers(0, 256, 5000) / 7, np.full(5000, -2.5)]
    block = logistic._packed([pa.array(c) for c in columns])
    assert logistic._unpacked(block, 5).tolist() == [*(c.tolist() for c in columns), [1.0] * 5000]
    assert len(block) < 5000 * (3 + 2 * 8) + 3000
    df = spark.createDataFrame(pd.DataFrame(dict(zip("yabcd", columns)))).coalesce(1)
    blocks = logistic._blocks(df).collect()
    assert sum(np.frombuffer(b, np.int64, 1)[0] for b in blocks) == 5000 and max(map(len, blocks)) < 6 * 8 * logistic.BLOCK_ROWS
    assert logistic.fit_logistic(df, list("abcd"), label="y").gradient < 1e-9


def test_models_leave_no_shuffle_files(rows, monkeypatch):
    """What joins and the deal shuffled goes once it is written; only the forest's rows carry a key."""
    from claimspark.plans import models_full

    freed, seen = [], []
    monkeypatch.setattr(models_full, "free_shuffles", lambda s: freed.append(s))
    for name in ("fit_forest", "fit_boosted"):
        monkeypatch.setattr(trees, name, lambda r, b, *_, kind=name, **__: (seen.append((kind, r.columns)), trees.TreeModel(b, [], True))[1])
    data = rows.withColumn("is_test", (F.col("id") % 5 == 0).cast("int"))
    models_full.FullModels(data, "id", NAMES).fit(["boosted"])
    assert len(freed) == 2 and seen == [("fit_boosted", ["label", "bins"])]
    models_full.FullModels(data, "id", NAMES).fit(["forest"])
    assert len(freed) == 4 and seen[1:] == [("fit_forest", ["key", "label", "bins"])]


def test_a_boosted_row_takes_a_byte_for_its_label(binned):
    bins, df = binned
    bundles = trees.Bundles(bins.sizes)
    blocks = trees._blocks(df.select("label", "bins").coalesce(1), bundles, 0.0).collect()
    n = sum(len(b["margin"]) // 8 for b in blocks)
    assert n == df.count() == sum(len(b["label"]) for b in blocks)
    assert sum(b["label"].count(1) for b in blocks) == df.filter("label = 1").count()


def test_a_forest_takes_few_bytes_a_node_in_the_driver(binned, monkeypatch):
    """Arrays, and trees that grow in groups with the same splits."""
    bins, df = binned
    model = trees.fit_forest(df, bins, trees=5, few=2)
    nodes = sum(len(t.feature) for t in model.trees)
    held = sum(x.nbytes for t in model.trees for x in vars(t).values())
    assert nodes > 300 and held < 20 * nodes + 500 * len(model.trees)
    for t in model.trees:  # as a tree of lists has them
        inner = [i for i, f in enumerate(t.feature) if f >= 0]
        assert [int(t.left[i]) for i in inner] == [1 + 2 * j for j in range(len(inner))] and len(t.feature) == 1 + 2 * len(inner)
        assert all(t.depth[t.left[i]] == t.depth[i] + 1 and t.rows[i] == t.rows[t.left[i]] + t.rows[t.left[i] + 1] for i in inner)
    groups = []
    monkeypatch.setattr(trees, "_grown", lambda *a, one=trees._grown: (groups.append(a[3:5]), one(*a))[1])
    monkeypatch.setattr(trees, "TASK_DRAWN", 2 * df.count() // df.rdd.getNumPartitions() + 1)
    monkeypatch.setattr(trees, "HELD_BYTES", 1)  # a block at a time
    assert trees.fit_forest(df, bins, trees=5, few=2).splits() == model.splits()
    assert groups == [(0, 2), (2, 2), (4, 1)]


def test_rows_of_finished_nodes_leave_their_block(binned):
    bins, df = binned
    k = len(NAMES)
    block = tuple(trees._drawn(df.coalesce(1), 1, k, 42).collect()[0])
    label, x, row, *_ = trees._opened(block, k)
    few = int((x[0][row] <= 3).sum())
    assert 0 < few < len(row) / 2
    moved = trees._moved(df.sparkSession.sparkContext.parallelize([block], 1), k, np.array([0]), np.array([3]), np.array([[0, -1]])).collect()
    left_label, left_x, left_row, *_ = trees._opened(moved[0], k)
    assert left_x.shape[1] == len(left_label) == few == len(left_row) and (left_x[0] <= 3).all()


def test_forest_scores_are_the_mean_of_its_leaves(binned, rows, monkeypatch):
    bins, df = binned
    monkeypatch.setattr(trees, "SCORED_ROWS", 100)
    model = trees.fit_forest(df, bins, trees=4, few=2)
    found = {r.id: r.probability for r in model.score(rows, ["id"]).collect()}
    cut = bins.apply(rows, ["id"]).toPandas()
    x = np.array([list(b) for b in cut["bins"]])
    want = sum(t.value[trees.leaf_of(t.arrays(), x)] for t in model.trees) / 4
    assert [found[i] for i in cut["id"]] == want.tolist()
