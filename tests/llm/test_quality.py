import numpy as np

from planarium.llm import quality
from planarium.llm.queries import op9_quality


def test_gradient_fits_ordered_grades():
    r = np.random.default_rng(1)
    good, poor, bad = (np.array([k]) for k in (quality.SIZE - 1, 7, 9))
    noise = [r.choice(np.arange(100, 200), 12, replace=False) for _ in range(900)]
    rows = [np.r_[n, good if g == 2 else poor if g == 1 else bad] for n, g in zip(noise, [0, 1, 2] * 300)]
    grades = np.array([0, 1, 2] * 300)
    model = quality.fit(rows, grades, 3)
    assert (np.diff(model.thresholds) >= 0).all()
    tails = model.tails(np.array([model.weights[x].sum() for x in rows]))
    assert (tails[:, 0] >= tails[:, 1]).all()
    assert (np.digitize(tails.sum(1), [0.5, 1.5]) == grades).mean() > 0.98


def test_edges(spark):
    rows = [(1, None), (2, ""), (3, "a b"), (None, "a b"), (3, "a b"), (4, "word " * 50000)]
    docs = spark.createDataFrame([(d, t, 0, "k") for d, t in rows], "doc_id long, text string, grade int, keep string")
    labels = spark.createDataFrame([(1, 1, 0), (3, 1, 0), (3, 0, 0), (4, None, 1), (None, 1, 1), (4, 0, 1)], "doc_id long, quality int, toxic int")
    model = quality.train(docs, labels)
    got = quality.score(docs, model).collect()
    assert sorted(str(r.doc_id) for r in got) == sorted(str(d) for d, _ in rows)
    assert all(0 <= r.p_good <= r.p_clean <= 1 and abs(r.expected_grade - r.p_good - r.p_clean) < 1e-5 for r in got)
    none = quality.train(docs, labels.limit(0))
    assert none is None
    assert quality.select(docs, none).count() == len(rows)
    assert {r.p_good for r in quality.score(docs, none).collect()} == {1.0}
    assert quality.select(docs, model).columns == docs.columns
    assert quality.score(docs.limit(0), model).count() == 0


def test_held_out(spark):
    path = "/root/testdata/sf0.1"
    docs = spark.read.parquet(f"{path}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{path}/labels.parquet")
    model = quality.train(docs, labels.where("doc_id % 3 <> 0"))
    found = quality.score(docs, model).join(labels.where("doc_id % 3 = 0"), "doc_id").withColumn("grade", quality.grade(labels.quality, labels.toxic))
    kept = {r.grade: r.share for r in found.groupBy("grade").agg({"*": "count"}).join(found.where("p_good >= 0.5").groupBy("grade").count(), "grade", "left").selectExpr("grade", "coalesce(count, 0) / `count(1)` as share").collect()}
    assert kept[2] > 0.97 and kept[1] < 0.2 and kept[0] < 0.1, kept


def test_query_has_all_rows(spark):
    got = op9_quality(spark, "/root/testdata/sf0.001")
    assert got.count() == spark.read.parquet("/root/testdata/sf0.001/documents.parquet").count()


def _loss(weights, theta, rows, grades, levels=3):
    score = np.array([weights[x].sum() for x in rows])
    edges = np.r_[-60.0, theta, 60.0]
    sigmoid = lambda x: 1 / (1 + np.exp(-np.clip(x, -60, 60)))
    return -np.log(np.maximum(sigmoid(edges[grades + 1] - score) - sigmoid(edges[grades] - score), 1e-9)).mean()


def _plain(rows, grades, columns, steps=400):
    """Projected gradient descent on the whole of the loss by finite differences; words' weights are at most 0."""
    x, theta = np.zeros(quality.SIZE), np.array([-1.0, 1.0])
    for n in range(steps):
        pace = 1.0 if n < steps // 2 else 0.3
        base = _loss(x, theta, rows, grades)
        slope = {}
        for c in columns:
            x[c] += 1e-4
            slope[c] = (_loss(x, theta, rows, grades) - base) / 1e-4
            x[c] -= 1e-4
        turn = np.array([(_loss(x, theta + 1e-4 * (np.arange(2) == k), rows, grades) - base) / 1e-4 for k in range(2)])
        for c, s in slope.items():
            x[c] = x[c] - pace * s if c >= 1 << quality.BITS else min(0, x[c] - pace * s)
        theta = np.sort(theta - pace * turn)
    return x, theta


def test_fit_reaches_the_loss_of_a_plain_optimiser():
    r = np.random.default_rng(3)
    words, shapes = [11, 12, 13], [quality.SIZE - 1, quality.SIZE - 2]
    true = dict(zip(words + shapes, [-2.0, -1.0, 0.0, 1.5, -1.5]))
    rows, grades = [], []
    for _ in range(240):
        own = [c for c in words if r.random() < 0.4] + [shapes[int(r.random() < 0.5)]]
        score = sum(true[c] for c in own) + r.logistic()
        rows.append(np.array(own))
        grades.append(int(np.digitize(score, [-2.0, 0.0])))
    grades = np.array(grades)
    x, theta = _plain(rows, grades, words + shapes)
    model = quality.fit(rows, grades, 3)
    mine, best = _loss(model.weights.astype(float), model.thresholds, rows, grades), _loss(x, theta, rows, grades)
    assert mine < best + 0.02, (mine, best)
    tails = [quality.Model(x, theta).tails(np.array([w[v].sum() for v in rows])) for w in (x, model.weights)]
    assert np.abs(model.tails(np.array([model.weights[v].sum() for v in rows])) - tails[0]).max() < 0.15
