"""Penalized boosted trees against a plain version that grows the best leaf first, one row set at a time."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.ml.linalg import Vectors, VectorUDT
from pyspark.sql import types as T

from gustline.plans import boosting, models
from gustline.plans.boosting import Setting
from gustline.session import scratch

SCHEMA = T.StructType([T.StructField("x", VectorUDT()), T.StructField("y", T.DoubleType())])


def table(spark, x, y, parts=3):
    return spark.createDataFrame([(Vectors.dense(r), float(v)) for r, v in zip(x, y)], SCHEMA).repartition(parts)


@pytest.fixture(scope="module")
def data():
    rng = np.random.default_rng(3)
    x = rng.integers(0, 12, size=(400, 3)).astype(float)
    y = np.round(x[:, 0] * 2 + (x[:, 1] > 5) * 7 - x[:, 2] * x[:, 0] / 4 + rng.normal(size=400), 3)
    return x, y


def naive(x, y, s):
    """Scores of the rows after all trees; every leaf looks at every value of every feature."""
    score = np.full(len(y), y.mean())
    pull = lambda g: np.sign(g) * max(abs(g) - s.l1, 0.0)
    worth = lambda g: pull(g.sum()) ** 2 / (len(g) + s.l2)

    def best(rows, g):
        found = None
        for f in range(x.shape[1]):
            for v in np.unique(x[rows, f]):
                low, high = rows[x[rows, f] <= v], rows[x[rows, f] > v]
                if min(len(low), len(high)) < max(s.least, 1):
                    continue
                gain = worth(g[low]) + worth(g[high]) - worth(g[rows])
                if gain > 1e-9 and (found is None or gain > found[0] + 1e-9):
                    found = gain, low, high
        return found

    for _ in range(s.trees):
        g = score - y
        leaves = [(np.arange(len(y)), 0)]
        able = {0: best(leaves[0][0], g)}
        while len(leaves) < s.leaves:
            open_ = [i for i in able if able[i] and leaves[i][1] < s.depth]
            if not open_:
                break
            i = max(open_, key=lambda k: able[k][0])
            (_, low, high), d = able[i], leaves[i][1] + 1
            leaves[i], able[i] = (low, d), best(low, g)
            leaves.append((high, d))
            able[len(leaves) - 1] = best(high, g)
        step = np.zeros(len(y))
        for rows, _ in leaves:
            step[rows] = -s.rate * pull(g[rows].sum()) / (len(rows) + s.l2)
        score = score + step
    return score


SETTINGS = [Setting(4, 0.3, 3, least=5), Setting(4, 0.3, 3, l1=3.0, l2=4.0, least=5), Setting(2, 0.3, 3, least=5),
            Setting(3, 0.5, 4, l2=1.0, leaves=5, least=1), Setting(1, 1.0, 1)]


def test_all_settings_at_once_equal_the_plain_version(spark, data):
    x, y = data
    for s, m in zip(SETTINGS, boosting.fit_many(table(spark, x, y), SETTINGS)):
        assert len(m.trees) == s.trees
        np.testing.assert_allclose(m.predict(x), naive(x, y, s), atol=1e-6)
        assert all((t.at >= 0).sum() < s.leaves for t in m.trees)


def same(a, b):
    return [r[:4] for r in a.to_rows()] == [r[:4] for r in b.to_rows()] and np.array_equal([r[4] for r in a.to_rows()], [r[4] for r in b.to_rows()], equal_nan=True)


def test_tasks_scores_and_place_of_comparison_do_not_matter(spark, data, monkeypatch):
    x, y = data
    settings = [Setting(5, 0.3, 3, rows=0.7, columns=0.7, least=5), Setting(3, 0.1, 2, l1=1.0, l2=2.0)]
    want = boosting.fit_many(table(spark, x, y, 1), settings)
    monkeypatch.setattr(boosting, "STORED", 2)
    monkeypatch.setattr(boosting, "ROWS_A_TASK", 100)
    many = boosting.fit_many(table(spark, x, y, 4), settings)
    monkeypatch.setattr(boosting, "CELLS_ON_DRIVER", 0)
    spread = boosting.fit_many(table(spark, x, y, 4), settings)
    for a, b, c in zip(want, many, spread):
        assert [t.at.tolist() for t in a.trees] == [t.at.tolist() for t in b.trees] == [t.at.tolist() for t in c.trees]
        assert same(b, c)
        np.testing.assert_allclose(a.predict(x), b.predict(x), atol=1e-9)


def test_cells_of_several_tasks_add_up():
    s, live = [Setting(1, 1.0, 1, least=1)], [(0, None, 0, 0, [0], [0, 2], 1.0)]
    cell = lambda f, b, g, n: {"t": 0, "node": 0, "f": f, "b": b, "g": g, "n": n}
    once = [cell(0, 1, -8.0, 4.0), cell(0, 3, 8.0, 4.0), cell(2, 0, -1.0, 4.0), cell(2, 9, 1.0, 4.0)]
    halves = [c | {"g": c["g"] / 2, "n": c["n"] / 2} for c in once for _ in range(2)]
    want = {0: {0: (0, 1, 2.0, -2.0, 4.0, 0.0, 8.0)}}
    assert boosting.cuts_in(pa.Table.from_pylist(once), live, s, 4.0) == want == boosting.cuts_in(pa.Table.from_pylist(halves), live, s, 4.0)


def test_shares(data):
    h = np.arange(100_000, dtype=np.int64) * 7919
    one, two = boosting.drawn(h, 42, 0, 0.7), boosting.drawn(h, 42, 1, 0.7)
    assert abs(one.mean() - 0.7) < 0.01 and abs((one & two).mean() - 0.49) < 0.01
    assert boosting.drawn(h, 42, 0, 1.0).all()
    assert [len(boosting.columns_of(42, k, 0.8, 24)) for k in range(3)] == [19] * 3 and boosting.columns_of(1, 0, 0.01, 5)


def test_odd_tables(spark, data):
    assert boosting.fit_many(table(spark, [], [], 1), [Setting(2, 0.1, 2)])[0].predict(np.zeros((0, 0))).tolist() == []
    flat = boosting.fit(table(spark, [[1.0, 2.0]] * 30, [5.0] * 30), 2, 0.1, 2)
    assert flat.predict(np.array([[9.0, 9.0]])).tolist() == [5.0]
    one = boosting.fit(table(spark, [[1.0]], [3.0], 1), 2, 0.1, 2)
    assert one.predict(np.array([[0.0], [np.nan]])).tolist() == [3.0, 3.0]
    x = np.array([[1.0], [1.0], [np.nan], [np.nan], [2.0], [2.0]])
    m = boosting.fit(table(spark, x, [0.0, 0.0, 9.0, 9.0, 1.0, 1.0]), 1, 1.0, 2, least=1)
    np.testing.assert_allclose(m.predict(np.array([[1.0], [-np.inf], [2.0], [np.nan]])), [0.0, 0.0, 1.0, 9.0], atol=1e-9)
    empty = boosting.fit_many(table(spark, [], [], 1), [Setting(2, 0.1, 2)])[0]
    assert empty.transform(table(spark, *data).limit(2)).agg({"p": "sum"}).first()[0] == 0.0


def test_scored_by_spark_and_stored(spark, data):
    x, y = data
    m = boosting.fit(table(spark, x, y), 3, 0.3, 3)
    got = m.transform(table(spark, x, y)).collect()
    np.testing.assert_allclose([r["p"] for r in got], m.predict(np.array([r["x"].toArray() for r in got])))
    bundle, path = models.Bundle("rf", {1: m}, {1: ["a", "b", "c"]}), scratch(spark, "bundle")
    bundle.save(path, spark)
    assert same(models.Bundle.load(path, spark).models[1], m)


def test_trials_hold_the_penalties():
    t = models.tree_trials(3, "penalized")
    assert len(t) == 18 and t[0] == models.PENALIZED[3] | {"l1": 0.0} and t == models.tree_trials(3, "penalized")
    assert len({tuple(sorted(x.items())) for x in t}) == 18 and {x["l1"] for x in t} > {0.0} and {x["l2"] for x in t} > {0.0, 2.0}
