"""Goldens, invariants, and the errors of invalid input."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarry.functions import optimize, vector as V
from quarry.operators import association as A, bayes as B, linear as L, neighbours as N, statistics as S, trees as T
from quarry.operators.neural import Network
from quarry.sources.text import arff_header, first_seen_codes, nominal_codes, read_arff, read_delimited
from quarry.streaming.incremental import stream_table, streamed

BASKETS = [[1, 3], [2], [4], [2, 3, 4], [2, 3], [2, 3], [1, 2, 3, 4], [1, 3], [1, 2, 3], [1, 2, 3]]


def flowers(spark, n=30):
    """Three separated clouds in four dimensions."""
    rng = np.random.default_rng(1)
    centres = np.array([[5.0, 3.4, 1.5, 0.2], [5.9, 2.8, 4.3, 1.3], [6.6, 3.0, 5.6, 2.0]])
    rows = [(k * n + i, [float(v) for v in centres[k] + rng.normal(0, 0.3, 4)], k) for k in range(3) for i in range(n)]
    return spark.createDataFrame(rows, "id long, features array<double>, label int")


def columns(frame):
    return frame.select("id", "label", *[F.col("features")[i].alias(f"x{i}") for i in range(4)])


def rosenbrock(x):
    a, b = x[::2], x[1::2]
    t1, t2 = 1 - a, 10 * (b - a * a)
    g = np.empty_like(x)
    g[1::2] = 20 * t2
    g[::2] = -2 * (a * g[1::2] + t1)
    return float((t1**2 + t2**2).sum()), g


def test_minimisers():
    start = np.tile([-1.2, 1.0], 50)
    assert optimize.lbfgs(rosenbrock, start, 5, 1e-4, 200)[1] == pytest.approx(3.2760183604e-14, abs=1e-15)
    assert optimize.bfgs(rosenbrock, start, 1e-4, 200)[1] < 1e-8
    with pytest.raises(ValueError):
        optimize.lbfgs(rosenbrock, start, 0)
    with pytest.raises(RuntimeError):
        optimize.lbfgs(rosenbrock, start, 5, 1e-12, 3)
    with pytest.raises(ValueError):
        optimize.line_search(rosenbrock, start, *rosenbrock(start), rosenbrock(start)[1], 100.0)


def test_rules_of_ten_baskets(spark):
    frame = spark.createDataFrame([(i, [str(x) for x in b]) for i, b in enumerate(BASKETS)], "txn_id long, items array<string>")
    for miner in (A.Miner(frame, 3), A.Miner(frame, 3, longest=4), A.Miner(frame, 0.3, longest=4)):
        assert miner.learn() == 8 and miner.size() == 10
        found = miner.rules(0.5).collect()
        assert len(found) == 9 and all(0.5 <= r.confidence <= 1 for r in found)
    assert A.Miner(frame, 3).add(frame.withColumn("txn_id", F.col("txn_id") + 10)).size() == 20
    assert A.support_count(0.14, 150) == 21 and A.support_count(7, 3) == 7
    with pytest.raises(ValueError):
        A.support_count(0, 5)


def test_vector_functions(spark):
    row = spark.createDataFrame([([1.0, float("nan"), 3.0], [2.0, 1.0, 5.0], [0.0, 0.0, 1.0])], "x array<double>, y array<double>, z array<double>")
    get = lambda c: row.select(c).first()[0]
    assert get(V.squared_distance_with_missing("x", "y")) == 3 * 5 / 2
    assert get(V.squared_distance_with_missing("y", "y")) == pytest.approx(1.7976931348623157e308)
    assert get(V.kullback_leibler(F.array(F.lit(1.0), F.lit(0.0)), F.array(F.lit(0.0), F.lit(1.0)))) == float("inf")
    assert get(V.jensen_shannon("z", "z")) == 0
    assert sum(get(V.softmax("y"))) == pytest.approx(1)
    assert get(V.logistic(F.lit(-50.0))) == 0 and get(V.log1pe(F.lit(20.0))) == 20 and get(V.safe_log(F.lit(0.0))) == V.LOG_FLOOR
    assert get(V.choose(F.lit(5), F.lit(2))) == 10 and get(V.choose(F.lit(2), F.lit(5))) == 0 and get(V.log_factorial(F.lit(0))) == 0
    for bad in (V.dot("x", F.array(F.lit(1.0))), V.log_choose(F.lit(1), F.lit(2)), V.log_factorial(F.lit(-1))):
        with pytest.raises(Exception, match="different length|required|nonnegative"):
            get(bad)


def test_readers(spark, tmp_path):
    (tmp_path / "w.arff").write_text("% comment\n@relation 'the weather'\n@attribute outlook {sunny, overcast, rainy}\n@attribute temperature real\n@ATTRIBUTE 'wind speed'\tnumeric\n@attribute play {yes, no}\n\n@data\nsunny,85,?,no\n'overcast', 83.5,1,yes\n")
    relation, attributes = arff_header(spark, str(tmp_path / "w.arff"))
    assert relation == "the weather" and [a.kind for a in attributes] == ["NOMINAL", "NUMERIC", "NUMERIC", "NOMINAL"] and attributes[0].values == ["sunny", "overcast", "rainy"]
    frame = read_arff(spark, str(tmp_path / "w.arff"))
    rows = frame.orderBy("outlook").collect()
    assert [r.outlook for r in rows] == ["overcast", "sunny"] and rows[0].temperature == 83.5 and rows[1]["wind speed"] != rows[1]["wind speed"]
    assert [r.play for r in nominal_codes(frame, "play").orderBy("outlook").collect()] == [0, 1]
    (tmp_path / "bad.arff").write_text("@relation x\n1,2\n")
    with pytest.raises(ValueError):
        read_arff(spark, str(tmp_path / "bad.arff"))
    (tmp_path / "d.txt").write_text("% c\nb 1 2\na 3 4\nb 5 6\n")
    first = read_delimited(spark, str(tmp_path / "d.txt"), response=0)
    coded, known = first_seen_codes(first)
    assert known == {"b": 0, "a": 1} and sorted((r.features, r.label_code) for r in coded.collect()) == [([1.0, 2.0], 0), ([3.0, 4.0], 1), ([5.0, 6.0], 0)]
    (tmp_path / "e.csv").write_text("1,2,c\n3,4,a\n")
    coded, known = first_seen_codes(read_delimited(spark, str(tmp_path / "e.csv"), delimiter=","), known=known)
    assert known == {"b": 0, "a": 1, "c": 2} and sorted((r.features, r.label_code) for r in coded.collect()) == [([1.0, 2.0], 2), ([3.0, 4.0], 1)]


def test_components(spark):
    frame = flowers(spark)
    x = np.array([r.features for r in frame.orderBy("id").collect()])
    for correlation in (False, True):
        model = L.PCA.fit(frame, correlation=correlation)
        want = np.sort(np.linalg.eigvalsh(np.corrcoef(x.T) if correlation else np.cov(x.T, bias=True)))[::-1]
        assert model.variances == pytest.approx(want) and model.cumulative[-1] == pytest.approx(1)
    model = L.PCA.fit(frame)
    assert model.kept == 1 + int(np.searchsorted(model.cumulative, 0.95))
    out = np.array([r.projected for r in model.with_components(4).project(frame).orderBy("id").collect()])
    assert out == pytest.approx((x - x.mean(0)) @ model.loadings)
    for bad in (lambda: model.with_components(5), lambda: model.with_share(0.0)):
        with pytest.raises(ValueError):
            bad()


def test_neighbours(spark):
    frame = flowers(spark)
    x = np.array([r.features for r in frame.orderBy("id").collect()])
    found = {}
    for r in N.neighbours(frame, frame, 3).orderBy("rank").collect():
        found.setdefault(r.query_id, []).append(r.id)
    for i in range(len(x)):
        d = np.square(x - x[i]).sum(1)
        d[i] = np.inf
        assert found[i] == np.lexsort((np.arange(len(x)), d))[:3].tolist()
    joined = N.classify(frame, frame, 5).join(frame.select(F.col("id").alias("query_id"), F.col("label").alias("actual")), "query_id")
    assert S.error_rate(joined, "label", "actual").first().errors < 10
    with pytest.raises(ValueError):
        N.neighbours(frame, frame, 0)


def test_kmeans(spark):
    frame = flowers(spark)
    centres, total = N.kmeans(frame, 3, iterations=30, runs=3, seed=2)
    one, first = N.lloyd(frame, centres, 1)
    assert first <= total + 1e-9
    assigned = N.assign(frame, centres)
    assert S.rand_index(assigned, "cluster", "label").first()[0] > 0.85
    assert N.wcss(assigned).first()[0] == pytest.approx(first)
    for bad in (lambda: N.kmeans(frame, 1), lambda: N.kmeans(frame, 3, runs=0), lambda: N.lloyd(frame, centres, 0)):
        with pytest.raises(ValueError):
            bad()


def test_rankings_need_sound_labels(spark):
    frame = flowers(spark)
    assert S.check_labels(frame, "label") == [0, 1, 2]
    for condition in ("label = 1", "label != 1"):
        with pytest.raises(ValueError):
            S.check_labels(frame.where(condition), "label")
    with pytest.raises(ValueError):
        S.check_labels(frame, "label", exactly={0, 1})


def test_agreement(spark):
    frame = spark.createDataFrame([(i, i % 3, (i % 3 + 1) % 3) for i in range(30)], "id long, a int, b int")
    assert S.rand_index(frame, "a", "b").first()[0] == 1 and S.adjusted_rand_index(frame, "a", "b").first()[0] == pytest.approx(1)


def test_folds_cover_and_are_disjoint(spark):
    folds = S.cross_validation(spark.range(103), "id", 10).collect()
    assert sorted(r.id for r in folds) == list(range(103))
    sizes = [sum(r.fold == k for r in folds) for k in range(10)]
    assert sizes == [10] * 9 + [13]
    for k in (0, 104):
        with pytest.raises(ValueError):
            S.cross_validation(spark.range(103), "id", k)


def test_discriminant(spark):
    frame = flowers(spark)
    out = L.Discriminant.fit(frame).predict(frame)
    assert S.error_rate(out, "predicted", "label").first().errors <= 3
    assert all(sum(r.posterior) == pytest.approx(1) for r in out.collect())
    for bad in ({"priors": [0.5, 0.5, 0.5]}, {"tolerance": -1.0}):
        with pytest.raises(ValueError):
            L.Discriminant.fit(frame, **bad)
    with pytest.raises(ValueError, match="singular"):
        L.Discriminant.fit(frame.withColumn("features", F.array(F.lit(1.0), F.col("features")[0])))


def test_logistic(spark):
    frame = flowers(spark).where("label > 0").withColumn("label", F.col("label") - 1)
    frame = frame.coalesce(1).cache()
    model = L.Logistic.fit(frame, penalty=0.1)
    assert S.error_rate(model.predict(frame), "predicted", "label").first().errors <= 3
    at = L.logistic_objective(frame, model.weights.tolist(), 0.1).first()
    assert at.value == pytest.approx(model.objective, rel=1e-5) and max(abs(at[f"g{i}"]) for i in range(5)) < 0.05
    w = np.array([0.1, -0.2, 0.3, 0.05, -0.4])
    base = L.logistic_objective(frame, w.tolist(), 0.1).first()
    for i in range(5):
        up = L.logistic_objective(frame, (w + 1e-5 * np.eye(5)[i]).tolist(), 0.1).first().value
        assert (up - base.value) / 1e-5 == pytest.approx(base[f"g{i}"], abs=1e-2)
    three = L.Logistic.fit(flowers(spark).coalesce(1), penalty=0.1, tolerance=1e-2)
    assert S.error_rate(three.predict(flowers(spark)), "predicted", "label").first().errors <= 3
    for bad in ({"penalty": -1.0}, {"tolerance": 0.0}, {"iterations": 0}):
        with pytest.raises(ValueError):
            L.Logistic.fit(frame, **bad)


def test_trees(spark):
    frame = columns(flowers(spark))
    names = [f"x{i}" for i in range(4)]
    for rule in ("GINI", "ENTROPY", "CLASSIFICATION_ERROR"):
        tree = T.Tree.fit(frame, names, max_nodes=4, rule=rule)
        assert sum(not n.children for n in tree.nodes()) <= 4
        out = frame.withColumn("p", tree.predict()).withColumn("q", tree.posterior())
        assert S.error_rate(out, "p", "label").first().errors <= 5 and all(sum(r.q) == pytest.approx(1) for r in out.collect())
        assert sum(tree.importance()) > 0
    nominal = T.Tree.fit(frame.withColumn("c", (F.col("label") * 2).cast("double")), ["c"], max_nodes=3, nominal=("c",))
    out = frame.withColumn("c", (F.col("label") * 2).cast("double")).withColumn("p", nominal.predict())
    assert S.error_rate(out, "p", "label").first().errors == 0
    forest = T.Forest.fit(frame, names, "id", trees=5, max_nodes=4)
    assert S.error_rate(frame.withColumn("p", forest.predict(3)), "p", "label").first().errors <= 9
    for bad in ({"max_nodes": 1}, {"node_size": 0}):
        with pytest.raises(ValueError):
            T.Tree.fit(frame, names, **bad)


def test_bayes_checks(spark):
    for bad in ((-1.0, 2, None), (1.0, 1, None), (1.0, 2, [0.7, 0.7])):
        with pytest.raises(ValueError):
            B.check(*bad)
    docs = spark.createDataFrame([(1, 0), (2, 1), (3, 1)], "doc_id long, label int")
    terms = spark.createDataFrame([(1, 0, "a", 2), (2, 1, "b", 1)], "doc_id long, label int, term string, tf long")
    vocabulary = spark.createDataFrame([("a",), ("b",)], "term string")
    classes = B.class_counts(docs)
    for kind in (B.multinomial, B.bernoulli):
        model = kind(classes, B.term_counts(terms), vocabulary)
        found = {r.doc_id: r.predicted for r in B.predict_words(docs, terms, model, B.log_priors(classes)).collect()}
        assert found == {1: 0, 2: 1, 3: -1}
        post = B.word_posteriors(docs, terms, model, B.log_priors(classes, [0.5, 0.5])).groupBy("doc_id").agg(F.sum("posterior").alias("s")).collect()
        assert all(r.s == pytest.approx(1) for r in post)


def test_networks(spark):
    frame = flowers(spark)
    z = S.z_scores(columns(frame), ["x0", "x1", "x2", "x3"]).withColumn("features", F.array("x0", "x1", "x2", "x3")).coalesce(1)
    net = Network([4, 6, 3], epochs=20).fit(z, order="id")
    assert S.error_rate(z.withColumn("p", net.predict()), "p", "label").first().errors <= 9
    target = z.withColumn("t", F.col("x0") * 0.5 - F.col("x3"))
    reg = Network([4, 6, 1], kind="regression", hidden="Tanh", epochs=20, rate=0.05).fit(target, label="t", order="id")
    assert target.select(F.avg(F.pow(reg.predict() - F.col("t"), 2))).first()[0] < 0.1
    rng = np.random.default_rng(0)
    for kinds in ({"error": "CrossEntropy"}, {"error": "LeastMeanSquares"}):
        # The step follows the negative gradient of the loss.
        net = Network([3, 2, 2], rate=1e-6, **kinds)
        x = rng.normal(size=3)

        def loss(weights):
            o = x
            for w in weights[:-1]:
                o = 1 / (1 + np.exp(-w @ o))
            o = net._out(weights[-1] @ o)
            t = net.target(1)
            return -float((t * np.log(o)).sum()) if kinds["error"] == "CrossEntropy" else float(((t - o) ** 2).sum()) / 2

        moved = [w.copy() for w in net.weights]
        net.step(x, 1, moved, [np.zeros_like(w) for w in moved])
        for k, w in enumerate(net.weights):
            up = [v.copy() for v in net.weights]
            up[k][0, 1] += 1e-6
            assert (moved[k] - w)[0, 1] / 1e-6 == pytest.approx(-(loss(up) - loss(net.weights)) / 1e-6, abs=1e-4)
    for bad in (([4],), ([4, 0],), ([4, 2], "classification", "LeastMeanSquares", "SoftMax"), ([4, 2], "classification", "CrossEntropy", "Linear"), ([4, 1], "classification", "CrossEntropy", "SoftMax"), ([4, 2], "classification", "CrossEntropy", "LogisticSigmoid")):
        with pytest.raises(ValueError):
            Network(*bad)
    with pytest.raises(ValueError):
        Network([4, 2]).target(5)


def test_pruning_of_boxes(spark):
    a = lambda *v: F.array(*[F.lit(float(x)) for x in v])
    test = lambda *c: spark.range(1).select(N.dominated(*c)).first()[0]
    assert test(a(0, 0), a(1, 1), a(0, 0), a(10, 10)) and not test(a(0, 0), a(9, 9), a(0, 0), a(10, 10)) and not test(a(0, 0), a(1, 1), a(0, 0), a(0, 0))


def test_streamed_counts_equal_batch(spark, tmp_path, sf):
    events = spark.read.parquet(f"{sf}/events.parquet")
    events.repartition(4).write.parquet(str(tmp_path / "e"))
    counts = lambda f: f.groupBy("event_type").count()
    out = streamed(counts, stream_table(spark, str(tmp_path / "e")), str(tmp_path / "c"))
    assert {tuple(r) for r in out.collect()} == {tuple(r) for r in counts(events).collect()}


def test_entry_point(spark):
    import __spark_entry__ as entry

    found = entry.queries()
    assert entry.entry(spark).count() >= 0 and set(entry.oracle_sql()) <= set(found) and len(found) > 80


def test_boxes():
    """Pruned search and pruned clustering equal brute force, with ties and repeated rows."""
    from quarry.operators.boxes import Boxes, cluster_sums, nearest

    rng = np.random.default_rng(3)
    x = np.concatenate([rng.integers(0, 6, (400, 2)).astype(float), rng.normal(size=(300, 2)), np.ones((90, 2))])
    ids, boxes = rng.permutation(len(x)), Boxes(x)
    assert sorted(boxes.rows.tolist()) == list(range(len(x))) and len(boxes) > 20
    for b in range(len(boxes)):
        own = x[boxes.rows[slice(*boxes.span[b])]]
        assert boxes.cost(b, np.array([1.0, 2.0])) == pytest.approx(np.square(own - [1.0, 2.0]).sum())
    for q in [*x[::40], np.array([9.0, -3.0])]:
        d = np.square(x - q).sum(axis=1)
        rows, found = nearest(boxes, q, ids, 7)
        assert rows.tolist() == np.lexsort((ids, np.round(d, 9)))[:7].tolist() and found == pytest.approx(d[rows])
    centres = np.concatenate([rng.normal(2, 2, (6, 2)), [[1.0, 1.0], [1.0, 1.0]]])
    n, sums, distance = cluster_sums(boxes, centres)
    d = np.square(x[:, None] - centres).sum(axis=2)
    own = d.argmin(axis=1)
    assert n.tolist() == np.bincount(own, minlength=8).tolist() and distance == pytest.approx(d.min(axis=1).sum())
    assert sums == pytest.approx(np.stack([x[own == k].sum(axis=0) for k in range(8)]))


def test_whole_number_items(spark):
    rows = [(i, b) for i, b in enumerate([[1, 3], [2], [4], [2, 3, 4], [2, 3], [2, 3], [1, 2, 3, 4], [1, 3], [1, 2, 3], [1, 2, 3]])]
    frame = spark.createDataFrame(rows, "txn_id long, items array<int>")
    for longest in (4, None, 2):
        assert A.Miner(frame, 3, longest).learn() == 8
        assert A.Miner(frame, 3, longest).rules(0.5).count() == 9


def test_weighted_nominal_split(spark):
    rows = spark.createDataFrame([(0, 0.0, 5), (1, 0.0, 1), (1, 1.0, 7), (0, 1.0, 0)], "label int, x double, weight int")
    found = {r.threshold: (list(r.t), list(r.f)) for r in T.nominal_splits(rows, ["x"], 2).collect()}
    assert found == {0.0: ([5, 1], [0, 7]), 1.0: ([0, 7], [5, 1])}


def test_forest_samples(spark):
    frame = flowers(spark)
    names = [f"x{i}" for i in range(4)]
    rows = frame.select("id", "label", *[F.col("features")[i].alias(n) for i, n in enumerate(names)]).cache()
    drawn = T.bootstrap(rows, "id", 1, [1.0, 0.5, 2.0]).groupBy("label").agg(F.sum("weight").alias("n")).collect()
    sizes = {r.label: r.n for r in drawn}
    assert 15 < sizes[0] < 45 and 4 < sizes[1] < 28 and 40 < sizes[2] < 85
    forest = T.Forest.fit(rows, names, "id", trees=4, max_nodes=4, mtry=2)
    assert all(len(t.features) == 4 for t in forest.trees) and len({n.feature for t in forest.trees for n in t.nodes() if n.children}) > 1
    judged = forest.out_of_bag(rows, 3).first()
    assert judged.oob > 50 and judged.accuracy > 0.8
    with pytest.raises(ValueError):
        T.Tree.fit(rows, names, mtry=5)


def test_missing_values_in_kmeans(spark):
    nan = float("nan")
    points = spark.createDataFrame([([0.0, 0.0],), ([nan, 1.0],), ([10.0, nan],), ([10.0, 12.0],)], "features array<double>")
    centres, _ = N.lloyd(points, [[0.5, 0.25], [9.0, 9.0]], 1, distance="EUCLIDEAN_MISSING_VALUES")
    assert centres == [[0.0, 0.5], [10.0, 12.0]]
    with pytest.raises(ValueError):
        N.lloyd(points, [[0.0, 0.0], [9.0, 9.0]], 5)


def test_leave_one_out_fold(spark):
    train, test = S.leave_one_out_fold(spark.createDataFrame([(1,), (2,), (None,)], "id long"), "id", 2)
    assert sorted((r.id or 0) for r in train.collect()) == [0, 1] and [r.id for r in test.collect()] == [2]


def test_split_ranges_are_fixed_once(spark):
    """Approximate quantiles differ between two evaluations; ranges taken from both would miscount."""
    rows = spark.range(0, 3000, 1, 6).select((F.col("id") % 3).cast("int").alias("label"), (F.xxhash64("id") % 100_003).cast("double").alias("x"), (F.xxhash64("id", F.lit(1)) % 997).cast("double").alias("z"))
    splits = T.numeric_splits(rows, ["x", "z"], 3, only={0: [1]})
    assert "percentile_approx" not in splits._jdf.queryExecution().optimizedPlan().toString()
    data, found = rows.collect(), splits.collect()
    assert {r.feature for r in found} == {1} and len(found) == len({r.z for r in data}) - 1
    for s in found[::50]:
        left = [sum(r.label == k for r in data if r.z <= s.threshold) for k in range(3)]
        assert list(s.t) == left and [t + f for t, f in zip(s.t, s.f)] == [1000] * 3
