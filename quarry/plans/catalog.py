"""Every operator as a query over the test tables, with the same query in SQL where SQL can say it.

Rows are compared as sets, so results are rounded on both sides and arrays are joined to strings.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from quarry.functions import vector as V
from quarry.operators import association as A, bayes as B, linear as L, neighbours as N, statistics as S, trees as T
from quarry.operators.neural import Network
from quarry.sources.text import rule_text
from quarry.streaming.incremental import stream_table, streamed

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def keep(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return keep


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def rounded(frame: DataFrame, digits: int = 6) -> DataFrame:
    return frame.select(*[F.round(c, digits).alias(c) if t == "double" else F.col(c) for c, t in frame.dtypes])


# --- association -----------------------------------------------------------------------------

SUPPORT, CONFIDENCE, TYPES = 0.05, 0.4, 6


def baskets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The part types of each order; at most six types exist."""
    parts = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), "p_type")
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey")
    return lines.join(parts, "l_partkey").groupBy(F.col("l_orderkey").alias("txn_id")).agg(F.collect_set("p_type").alias("items"))


MASKS = """
WITH types AS (SELECT p_type AS t, row_number() OVER (ORDER BY p_type) - 1 AS b FROM (SELECT DISTINCT p_type FROM part)),
basket AS (SELECT l_orderkey AS txn, bit_or(CAST(1 AS BIGINT) << CAST(b AS INTEGER)) AS m FROM lineitem JOIN part ON l_partkey = p_partkey JOIN types ON t = p_type GROUP BY 1),
n AS (SELECT count(*) AS n FROM basket),
masks AS (SELECT m, count(*) AS c FROM basket GROUP BY m),
sets AS (SELECT s, CAST(sum(c) AS BIGINT) AS support FROM range(1, 64) r(s) JOIN masks ON m & s = s GROUP BY s),
named AS (SELECT s, string_agg(t, '|' ORDER BY t) AS items, count(*) AS size FROM range(1, 64) r(s) JOIN types ON (s >> CAST(b AS INTEGER)) & 1 = 1 GROUP BY s)
"""


def _joined(c: str):
    return F.concat_ws("|", F.array_sort(c))


@query("SELECT p_type AS item, count(DISTINCT l_orderkey) AS freq FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1")
def item_freq(spark, d):
    return A.item_frequency(baskets(spark, d))


@query("SELECT *, row_number() OVER (ORDER BY freq DESC, item) - 1 AS position FROM (SELECT p_type AS item, count(DISTINCT l_orderkey) AS freq FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1) WHERE freq >= 100")
def item_order(spark, d):
    return A.item_order(baskets(spark, d), 100)


_SETS = MASKS + "SELECT items, CAST(size AS INTEGER) AS size, support FROM sets JOIN named USING (s), n WHERE support >= {}"


def _sets(frame: DataFrame) -> DataFrame:
    return frame.select(_joined("items").alias("items"), F.size("items").alias("size"), "support")


@query(_SETS.format("50"))
def frequent_itemsets_count(spark, d):
    return _sets(A.frequent_itemsets(baskets(spark, d), 50, longest=TYPES))


@query(_SETS.format("ceil(0.05 * n)"))
def frequent_itemsets_fraction(spark, d):
    return _sets(A.Miner(baskets(spark, d), SUPPORT, longest=TYPES).itemsets())


@query(_SETS.format("ceil(0.05 * n)"))
def frequent_itemsets_fpgrowth(spark, d):
    return _sets(A.Miner(baskets(spark, d), SUPPORT).itemsets())


@query(MASKS + "SELECT items, coalesce(CASE WHEN support >= ceil(0.05 * n) THEN support END, 0) AS support FROM named JOIN n ON true LEFT JOIN sets USING (s) WHERE size <= 2 UNION ALL SELECT 'none', 0")
def itemset_support_lookup(spark, d):
    types = table(spark, d, "part").select("p_type").distinct()
    pairs = types.crossJoin(types.select(F.col("p_type").alias("q"))).where("p_type <= q")
    wanted = pairs.select(F.array_distinct(F.array("p_type", "q")).alias("items")).unionByName(spark.range(1).select(F.array(F.lit("none")).alias("items")))
    return A.Miner(baskets(spark, d), SUPPORT, longest=TYPES).support(wanted).select(_joined("items").alias("items"), "support")


_RULES = MASKS + """, rules AS (
  SELECT x.items AS antecedent, y.items AS consequent, w.support / n AS support, w.support / a.support AS confidence
  FROM sets w JOIN sets a ON w.s & a.s = a.s AND a.s <> w.s JOIN named x ON x.s = a.s JOIN named y ON y.s = w.s & ~a.s, n
  WHERE w.support >= ceil(0.05 * n) AND w.support / a.support >= 0.4)
"""


def rules(spark, d):
    return A.Miner(baskets(spark, d), SUPPORT, longest=TYPES).rules(CONFIDENCE)


@query(_RULES + "SELECT antecedent, consequent, round(support, 6) AS support, round(confidence, 6) AS confidence FROM rules")
def assoc_rules(spark, d):
    return rounded(rules(spark, d).select(_joined("antecedent").alias("antecedent"), _joined("consequent").alias("consequent"), "support", "confidence"))


@query(_RULES + "SELECT printf('(%s) => (%s) support = %.2f%% confidence = %.2f%%', replace(antecedent, '|', ', '), replace(consequent, '|', ', '), support * 100, confidence * 100) AS rule FROM rules")
def rule_in_words(spark, d):
    return rules(spark, d).select(rule_text().alias("rule"))


# --- vector and scalar functions -----------------------------------------------------------------


def vectors(spark, d) -> DataFrame:
    e = F.transform("embedding", lambda x: x.cast("double"))
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), e.alias("x"), F.reverse(e).alias("y"), "label")


_V = "WITH v AS (SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS x, list_reverse(CAST(embedding AS DOUBLE[])) AS y, label FROM embeddings) "
_OVER = "list_sum(list_transform(range(1, len(x) + 1), lambda i: {}))"


def _vec(value) -> Query:
    return lambda spark, d: rounded(vectors(spark, d).select("id", value().alias("value")))


def _vector_query(name: str, value, sql: str) -> None:
    f = _vec(value)
    f.__name__ = name
    query(_V + f"SELECT id, round({sql}, 6) AS value FROM v")(f)


_P = "list_transform(x, lambda a: abs(a) / list_sum(list_transform(x, lambda b: abs(b))))"
_Q = "list_transform(y, lambda a: abs(a) / list_sum(list_transform(y, lambda b: abs(b))))"
_abs = lambda c: V.unitize1(F.transform(c, F.abs))
_gap = lambda c: F.transform(c, lambda a, i: F.when((i + F.col("id")) % 7 == 0, float("nan")).otherwise(a))
_vector_query("sq_dist", lambda: V.squared_distance("x", "y"), _OVER.format("(x[i] - y[i]) * (x[i] - y[i])"))
_vector_query("dot_product", lambda: V.dot("x", "y"), _OVER.format("x[i] * y[i]"))
_vector_query("norm_one", lambda: V.norm1("x"), "list_sum(list_transform(x, lambda a: abs(a)))")
_vector_query("norm_two", lambda: V.norm2("x"), "sqrt(list_sum(list_transform(x, lambda a: a * a)))")
_vector_query("unitize_one", lambda: V.dot(V.unitize1("x"), "y"), _OVER.format("x[i] * y[i]") + " / list_sum(list_transform(x, lambda a: abs(a)))")
_vector_query("axpy_sum", lambda: V.norm2(V.axpy(0.5, "x", "y")), "sqrt(" + _OVER.format("(y[i] + 0.5 * x[i]) * (y[i] + 0.5 * x[i])") + ")")
_vector_query("softmax_first", lambda: V.softmax("x")[0], "exp(x[1]) / list_sum(list_transform(x, lambda a: exp(a)))")
_vector_query("dot_intercept", lambda: V.dot_with_intercept(F.slice("x", 1, 3), F.slice("y", 1, 8), 1), "x[1] * y[5] + x[2] * y[6] + x[3] * y[7] + y[8]")
_vector_query("dist_missing", lambda: V.squared_distance_with_missing(_gap("x"), "y"), "len(x) * " + _OVER.format("CASE WHEN (i - 1 + id) % 7 = 0 THEN 0.0 ELSE (x[i] - y[i]) * (x[i] - y[i]) END") + " / " + _OVER.format("CASE WHEN (i - 1 + id) % 7 = 0 THEN 0 ELSE 1 END"))
_vector_query("kl_div", lambda: V.kullback_leibler(_abs("x"), _abs("y")), _OVER.format(f"({_P})[i] * ln(({_P})[i] / ({_Q})[i])"))
_JS = f"(({_P})[i] * ln(2 * ({_P})[i] / (({_P})[i] + ({_Q})[i])) + ({_Q})[i] * ln(2 * ({_Q})[i] / (({_P})[i] + ({_Q})[i]))) / 2"
_vector_query("js_div", lambda: V.jensen_shannon(_abs("x"), _abs("y")), _OVER.format(_JS))


def _event_query(name: str, value, sql: str) -> None:
    def f(spark, d):
        return rounded(table(spark, d, "events").select("event_id", F.col("value").alias("v")).select("event_id", value().alias("value")))

    f.__name__ = name
    query(f"SELECT event_id, round({sql}, 6) AS value FROM (SELECT event_id, value AS v FROM events)")(f)


_event_query("scalar_logistic", lambda: V.logistic(F.col("v") / 10 - 5), "CASE WHEN v / 10 - 5 < -40 THEN 0.0 WHEN v / 10 - 5 > 40 THEN 1.0 ELSE 1 / (1 + exp(-(v / 10 - 5))) END")
_event_query("scalar_log", lambda: V.safe_log(F.when(F.col("event_id") % 5 == 0, 0.0).otherwise(F.abs("v"))), "CASE WHEN event_id % 5 = 0 OR abs(v) < 1e-300 THEN -690.7755 ELSE ln(abs(v)) END")
_event_query("scalar_log1pe", lambda: V.log1pe(F.col("v") / 5), "CASE WHEN v / 5 > 15 THEN v / 5 ELSE ln(1 + exp(v / 5)) END")
_event_query("scalar_tanh", lambda: V.tanh(F.col("v") / 100), "tanh(v / 100)")
_event_query("scalar_sqr", lambda: V.sqr(F.col("v")), "v * v")
_event_query("scalar_round", lambda: V.decimal_round("v", 1), "round(v, 1)")
_event_query("nan_predicate", lambda: V.is_missing(F.when(F.col("event_id") % 3 == 0, float("nan")).otherwise(F.col("v"))).cast("double"), "CAST(event_id % 3 = 0 AS DOUBLE)")


@query("SELECT p_partkey, round(list_sum(list_transform(range(1, p_size + 1), lambda i: ln(i))), 6) AS value FROM part")
def scalar_log_factorial(spark, d):
    return rounded(table(spark, d, "part").select("p_partkey", V.log_factorial("p_size").alias("value")))


@query("SELECT p_partkey, CAST(p_size * (p_size - 1) / 2 AS DOUBLE) AS two, round(ln(p_size), 6) AS log_one FROM part")
def scalar_choose(spark, d):
    return table(spark, d, "part").select("p_partkey", V.choose("p_size", F.lit(2)).alias("two"), F.round(V.log_choose("p_size", F.lit(1)), 6).alias("log_one"))


# --- lines as labelled vectors ---------------------------------------------------------------------

X = ["x0", "x1", "x2", "x3"]
LINES = """li AS (SELECT l_orderkey * 10 + l_linenumber AS id, l_quantity / 50 AS x0, l_extendedprice / 100000 AS x1, l_discount * 10 AS x2, l_tax * 10 AS x3,
  CASE l_returnflag WHEN 'A' THEN 0 WHEN 'N' THEN 1 ELSE 2 END AS label, CAST(l_returnflag = 'R' AS INTEGER) AS y, CAST(l_linestatus = 'O' AS INTEGER) AS status FROM lineitem)"""


def lines(spark, d) -> DataFrame:
    c = F.col
    flag = F.when(c("l_returnflag") == "A", 0).when(c("l_returnflag") == "N", 1).otherwise(2)
    return table(spark, d, "lineitem").select((c("l_orderkey") * 10 + c("l_linenumber")).alias("id"), (c("l_quantity") / 50).alias("x0"), (c("l_extendedprice") / 100000).alias("x1"), (c("l_discount") * 10).alias("x2"), (c("l_tax") * 10).alias("x3"), flag.alias("label"), (c("l_returnflag") == "R").cast("int").alias("y"), (c("l_linestatus") == "O").cast("int").alias("status"))


def featured(spark, d) -> DataFrame:
    return lines(spark, d).withColumn("features", F.array(*X))


_LONG = "WITH " + LINES + ", l AS (" + " UNION ALL ".join(f"SELECT {i} AS feature, x{i} AS v, label, y FROM li" for i in range(4)) + ")"


@query(_LONG + ", m AS (SELECT feature, label, count(*) AS n, avg(v) AS mu, var_pop(v) AS s FROM l GROUP BY 1, 2), g AS (SELECT feature, sum(n * mu) / sum(n) AS g FROM m GROUP BY 1) SELECT feature, round(sum(n * (mu - g) * (mu - g)) / sum(n * s), 9) AS ratio FROM m JOIN g USING (feature) GROUP BY feature")
def feature_ssr(spark, d):
    return rounded(S.sum_square_ratio(lines(spark, d), X, "label"), 9)


@query(_LONG + " SELECT feature, round(abs(avg(v) FILTER (y = 0) - avg(v) FILTER (y = 1)) / (stddev_samp(v) FILTER (y = 0) + stddev_samp(v) FILTER (y = 1)), 9) AS ratio FROM l GROUP BY feature")
def feature_s2n(spark, d):
    return rounded(S.signal_to_noise(lines(spark, d), X, "y"), 9)


@query("WITH " + LINES + " SELECT id, " + ", ".join(f"round((x{i} - (SELECT avg(x{i}) FROM li)) / (SELECT stddev_samp(x{i}) FROM li), 6) AS x{i}" for i in range(4)) + " FROM li")
def zscore(spark, d):
    return rounded(S.z_scores(lines(spark, d).select("id", *X), X))


def _pairs(f: str) -> str:
    return "WITH " + LINES + " " + " UNION ALL ".join(f"SELECT {i} AS i, {j} AS j, round({f}(x{i}, x{j}), 9) AS value FROM li" for i in range(4) for j in range(i, 4))


@query(_pairs("covar_pop"))
def covariance_matrix(spark, d):
    return rounded(S.covariance(lines(spark, d), X), 9)


@query(_pairs("corr"))
def correlation_matrix(spark, d):
    return rounded(S.covariance(lines(spark, d), X, correlation=True), 9)


@query()
def pca_fit(spark, d):
    model = L.PCA.fit(vectors(spark, d), "x")
    return spark.createDataFrame([(k, float(v), float(p), float(c)) for k, (v, p, c) in enumerate(zip(model.variances, model.proportion, model.cumulative))], "component int, variance double, proportion double, cumulative double")


@query("WITH " + LINES + " SELECT i, j, round(covar_pop(a, b), 6) AS covariance FROM (SELECT id, unnest([0, 1, 2, 3]) AS i, unnest([x0, x1, x2, x3]) AS a, [x0, x1, x2, x3] AS x FROM li) CROSS JOIN (VALUES (0), (1), (2), (3)) t(j) CROSS JOIN LATERAL (SELECT x[j + 1] AS b) GROUP BY i, j")
def pca_fit_rebuilds_covariance(spark, d):
    """The fitted loadings and variances, multiplied out again."""
    model = L.PCA.fit(featured(spark, d))
    return rounded(_entries(spark, model.loadings @ L.np.diag(model.variances) @ model.loadings.T, "covariance"))


def _entries(spark, matrix, name: str) -> DataFrame:
    return spark.createDataFrame([(i, j, float(v)) for i, row in enumerate(matrix) for j, v in enumerate(row)], f"i int, j int, {name} double")


_FIXED = L.PCA(mean=L.np.array([0.5, 0.4, 0.5, 0.4]), variances=L.np.array([4.0, 3.0, 2.0, 1.0]), loadings=L.np.array([[0.5, 0.5, 0.5, 0.5], [0.5, 0.5, -0.5, -0.5], [0.5, -0.5, 0.5, -0.5], [0.5, -0.5, -0.5, 0.5]]), kept=2)


@query("WITH " + LINES + " SELECT id, round(0.5 * (x0 - 0.5) + 0.5 * (x1 - 0.4) + 0.5 * (x2 - 0.5) + 0.5 * (x3 - 0.4), 9) AS p0, round(0.5 * (x0 - 0.5) + 0.5 * (x1 - 0.4) - 0.5 * (x2 - 0.5) - 0.5 * (x3 - 0.4), 9) AS p1 FROM li")
def pca_project_fixed(spark, d):
    out = _FIXED.with_components(2).project(featured(spark, d))
    return rounded(out.select("id", F.col("projected")[0].alias("p0"), F.col("projected")[1].alias("p1")), 9)


@query("WITH s AS (SELECT * FROM (VALUES (0.5, 2), (0.7, 2), (0.75, 3), (0.95, 4), (1.0, 4)) t(share, kept)) SELECT CAST(share AS DOUBLE) AS share, kept FROM s")
def pca_kept_by_share(spark, d):
    return spark.createDataFrame([(s, _FIXED.with_share(s).kept) for s in (0.5, 0.7, 0.75, 0.95, 1.0)], "share double, kept int")


# --- neighbours and clusters -----------------------------------------------------------------------


def _train(spark, d):
    return vectors(spark, d).select("id", F.col("x").alias("features"), "label")


def _near(k: int) -> str:
    return _V + f""", p AS (SELECT q.id AS query_id, t.id, t.label, {_OVER.format('(q.x[i] - t.x[i]) * (q.x[i] - t.x[i])').replace('len(x)', 'len(q.x)')} AS s
  FROM v q JOIN v t ON q.x <> t.x WHERE q.id % 10 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(s, 9), id) AS rank FROM p QUALIFY rank <= {k}) """


def _asked(spark, d):
    return _train(spark, d).where("id % 10 = 0")


@query(_near(5) + "SELECT query_id, id, round(sqrt(s), 6) AS distance, CAST(rank AS INTEGER) AS rank FROM r")
def knn_neighbors(spark, d):
    return rounded(N.neighbours(_train(spark, d), _asked(spark, d), 5))


_VOTE = "SELECT query_id, label FROM (SELECT query_id, label, count(*) AS n FROM r GROUP BY 1, 2) QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY n DESC, label) = 1"


@query(_near(7) + _VOTE)
def knn_classify(spark, d):
    return N.classify(_train(spark, d), _asked(spark, d), 7)


@query(_near(1) + _VOTE)
def knn_one(spark, d):
    return N.classify(_train(spark, d), _asked(spark, d), 1)


CENTRES = [[0.1, 0.1, 0.2, 0.2], [0.5, 0.4, 0.5, 0.4], [0.9, 0.8, 0.8, 0.6]]


def _assigned(points: str, centres: str) -> str:
    """SQL rows (id, x0..x3, cluster, distance) of the nearest centre, a table (cluster, c0..c3)."""
    total = " + ".join(f"(p.x{i} - c.c{i}) * (p.x{i} - c.c{i})" for i in range(4))
    least = f"arg_min(c.cluster, struct_pack(s := {total}, k := c.cluster)) AS cluster, min({total}) AS distance"
    return f"SELECT p.rn, any_value(p.x0) AS x0, any_value(p.x1) AS x1, any_value(p.x2) AS x2, any_value(p.x3) AS x3, any_value(p.id) AS id, {least} FROM {points} p, {centres} c GROUP BY p.rn"


_START = "WITH " + LINES + ", p AS (SELECT *, row_number() OVER () AS rn FROM li), k0 AS (SELECT * FROM (VALUES " + ", ".join(f"({k}, " + ", ".join(f"CAST({v} AS DOUBLE)" for v in c) + ")" for k, c in enumerate(CENTRES)) + ") t(cluster, c0, c1, c2, c3)), a0 AS (" + _assigned("p", "k0") + ")"
_MEANS = "SELECT k.cluster, " + ", ".join(f"coalesce(avg(a.x{i}), any_value(k.c{i})) AS c{i}" for i in range(4)) + " FROM {k} k LEFT JOIN {a} a USING (cluster) GROUP BY k.cluster"
_LLOYD = _START + "".join(f", k{i + 1} AS ({_MEANS.format(k=f'k{i}', a=f'a{i}')}), a{i + 1} AS ({_assigned('p', f'k{i + 1}')})" for i in range(3))


@query(_START + " SELECT id, cluster, round(distance, 6) AS distance FROM a0")
def kmeans_assign(spark, d):
    return rounded(N.assign(featured(spark, d), CENTRES).select("id", "cluster", "distance"))


@query(_START + " SELECT cluster, count(*) AS n, " + ", ".join(f"round(avg(x{i}), 6) AS c{i}" for i in range(4)) + " FROM a0 GROUP BY cluster")
def kmeans_update(spark, d):
    new = N.update(N.assign(featured(spark, d), CENTRES), 4)
    return rounded(new.select("cluster", "n", *[F.col("centroid")[i].alias(f"c{i}") for i in range(4)]))


@query(_START + " SELECT round(sum(distance), 4) AS wcss FROM a0")
def kmeans_wcss(spark, d):
    return rounded(N.wcss(N.assign(featured(spark, d), CENTRES)), 4)


@query(_LLOYD + " SELECT cluster, " + ", ".join(f"round(c{i}, 6) AS c{i}" for i in range(4)) + " FROM k3")
def kmeans_lloyd3(spark, d):
    centres, _ = N.lloyd(featured(spark, d), CENTRES, 3)
    return rounded(spark.createDataFrame([(k, *c) for k, c in enumerate(centres)], "cluster int, c0 double, c1 double, c2 double, c3 double"))


@query("SELECT CAST(k AS INTEGER) AS cluster, true AS settled FROM range(10) t(k)")
def kmeans_fit_settles(spark, d):
    """One more round leaves the fitted centroids where they are (to four digits)."""
    centres, _ = N.kmeans(_train(spark, d), 10, iterations=200, runs=1, seed=7)
    again, _ = N.lloyd(_train(spark, d), centres, 1)
    return spark.createDataFrame([(k, max(abs(x - y) for x, y in zip(a, b)) < 5e-5) for k, (a, b) in enumerate(zip(centres, again))], "cluster int, settled boolean")


@query()
def kmeans_fit(spark, d):
    centres, total = N.kmeans(_train(spark, d), 10, iterations=20, runs=2, seed=7)
    return N.assign(_train(spark, d), centres).groupBy("cluster").agg(F.count(F.lit(1)).alias("n"), F.avg("distance").alias("mean_distance"))


@query(_V + ", b AS (SELECT id, x[1] AS a, x[2] AS b, y[1] AS c, y[2] AS d, abs(x[3]) AS r FROM v), w AS (SELECT id, a, b, c, d, c - a AS g, d - b AS h, CASE WHEN c - a > 0 THEN r ELSE -r END AS u, CASE WHEN d - b > 0 THEN r ELSE -r END AS w FROM b) SELECT id, (g * g + h * h >= 2 * ((u - a) * g + (w - b) * h)) AND (g <> 0 OR h <> 0) AS pruned FROM w")
def bbd_prune_test(spark, d):
    x, y = F.col("x"), F.col("y")
    r = F.abs(x[2])
    return vectors(spark, d).select("id", N.dominated(F.array(F.lit(0.0), F.lit(0.0)), F.array(r, r), F.slice(x, 1, 2), F.slice(y, 1, 2)).alias("pruned"))


# --- naive Bayes -------------------------------------------------------------------------------------

def labelled(spark, d) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", "text")
    return docs.join(table(spark, d, "labels").select("doc_id", F.col("quality").alias("label")), "doc_id")


def _bag(spark, d) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(documents, their vocabulary terms, vocabulary): the vocabulary is all words of the labelled texts."""
    docs = labelled(spark, d)
    vocabulary = docs.select(F.explode(S.words("text")).alias("term")).distinct()
    terms = S.bag_of_words(docs, vocabulary).join(docs.select("doc_id", "label"), "doc_id")
    return docs.select("doc_id", "label"), terms, vocabulary


_BAG = r"""WITH dl AS (SELECT d.doc_id, d.text, l.quality AS label FROM documents d JOIN labels l USING (doc_id)),
w AS (SELECT doc_id, label, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^ \t\n\x0B\f\r]+')) AS term FROM dl),
vocab AS (SELECT DISTINCT term FROM w),
t AS (SELECT doc_id, label, term, count(*) AS tf FROM w JOIN vocab USING (term) GROUP BY ALL),
c AS (SELECT label, count(*) AS n FROM dl GROUP BY label),
pri AS (SELECT label, ln((n + 1e-20) / ((SELECT sum(n) FROM c) + (SELECT count(*) FROM c) * 1e-20)) AS lp, n FROM c),
g AS (SELECT c.label, c.n, v.term, coalesce(CAST(sum(tf) AS BIGINT), 0) AS ntc, count(tf) AS present FROM c CROSS JOIN vocab v LEFT JOIN t ON t.label = c.label AND t.term = v.term GROUP BY ALL),
tot AS (SELECT label, sum(ntc) AS nt, count(*) AS p FROM g GROUP BY label),
mul AS (SELECT label, term, ln((ntc + 1.0) / (nt + p)) AS logp FROM g JOIN tot USING (label)),
ber AS (SELECT label, term, ln((present + 1.0) / (n + 2.0)) AS logp, ln(1 - (present + 1.0) / (n + 2.0)) AS log_not FROM g),
ms AS (SELECT t.doc_id, m.label, any_value(lp) + sum(tf * logp) AS score FROM t JOIN mul m USING (term) JOIN pri ON pri.label = m.label GROUP BY t.doc_id, m.label),
bs AS (SELECT t.doc_id, b.label, any_value(lp) + any_value(none) + sum(logp - log_not) AS score FROM t JOIN ber b USING (term) JOIN pri ON pri.label = b.label JOIN (SELECT label, sum(log_not) AS none FROM ber GROUP BY label) z ON z.label = b.label GROUP BY t.doc_id, b.label)
"""
_BEST = "SELECT dl.doc_id, coalesce(b.label, -1) AS predicted FROM dl LEFT JOIN (SELECT doc_id, label FROM {} QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY round(score, 9) DESC, label) = 1) b USING (doc_id)"


def _words_model(spark, d, kind):
    docs, terms, vocabulary = _bag(spark, d)
    classes = B.class_counts(docs)
    return docs, terms, kind(classes, B.term_counts(terms), vocabulary), B.log_priors(classes)


@query(_BAG + "SELECT doc_id, term, tf FROM t")
def bag_of_words(spark, d):
    return _bag(spark, d)[1].select("doc_id", "term", "tf")


@query(_BAG + "SELECT label, term, round(logp, 6) AS logp FROM mul")
def nb_multinomial_params(spark, d):
    return rounded(_words_model(spark, d, B.multinomial)[2])


@query(_BAG + _BEST.format("ms"))
def nb_multinomial_predict(spark, d):
    return B.predict_words(*_words_model(spark, d, B.multinomial))


@query(_BAG + "SELECT doc_id, label, round(exp(score - max(score) OVER (PARTITION BY doc_id)) / sum(exp(score)) OVER (PARTITION BY doc_id) * exp(max(score) OVER (PARTITION BY doc_id)), 6) AS posterior FROM ms".replace("exp(score - max(score) OVER (PARTITION BY doc_id)) / sum(exp(score)) OVER (PARTITION BY doc_id) * exp(max(score) OVER (PARTITION BY doc_id))", "e / sum(e) OVER (PARTITION BY doc_id)").replace("FROM ms", "FROM (SELECT *, exp(score - max(score) OVER (PARTITION BY doc_id)) AS e FROM ms)"))
def nb_multinomial_posterior(spark, d):
    return rounded(B.word_posteriors(*_words_model(spark, d, B.multinomial)).select("doc_id", "label", "posterior"))


@query(_BAG + "SELECT label, term, round(logp, 6) AS logp, round(log_not, 6) AS log_not FROM ber")
def nb_bernoulli_params(spark, d):
    return rounded(_words_model(spark, d, B.bernoulli)[2])


@query(_BAG + _BEST.format("bs"))
def nb_bernoulli_predict(spark, d):
    return B.predict_words(*_words_model(spark, d, B.bernoulli))


@query(_BAG + "SELECT label, term, ntc, present FROM g WHERE present > 0")
def nb_online_counts(spark, d):
    """Two batches learned one after the other."""
    _, terms, _ = _bag(spark, d)
    halves = [B.term_counts(terms.where(F.col("doc_id") % 2 == k)) for k in (0, 1)]
    return B.add_counts(*halves, ["label", "term"])


@query(_LONG + " SELECT feature, label, count(*) AS n, round(avg(v), 6) AS mean, round(stddev_samp(v), 6) AS sd FROM l GROUP BY 1, 2")
def nb_gaussian_params(spark, d):
    return rounded(B.gaussian(lines(spark, d), X))


_GAUSS = "WITH " + LINES + ", m AS (SELECT label, " + ", ".join(f"avg(x{i}) AS m{i}, stddev_samp(x{i}) AS s{i}" for i in range(4)) + ", count(*) / (SELECT count(*) FROM li) AS pr FROM li GROUP BY label), s AS (SELECT li.*, row_number() OVER () AS rn FROM li), z AS (SELECT s.rn, s.id, m.label, ln(pr)" + "".join(f" - (x{i} - m{i}) * (x{i} - m{i}) / (s{i} * s{i}) / 2 - ln(s{i} * sqrt(2 * pi()))" for i in range(4)) + " AS score FROM s, m)"


@query(_GAUSS + " SELECT id, label AS predicted, round(score, 5) AS score FROM z QUALIFY row_number() OVER (PARTITION BY rn ORDER BY round(score, 9) DESC, label) = 1")
def nb_gaussian_predict(spark, d):
    rows = lines(spark, d)
    model = B.gaussian(rows, X).collect()
    n = {r["label"]: r["n"] for r in model}
    scores = B.gaussian_scores(X, model, {k: v / sum(n.values()) for k, v in n.items()})
    exact = F.transform(F.col("_s"), lambda x: F.round(x, 9))
    return rows.withColumn("_s", scores).select("id", (F.array_position(exact, F.array_max(exact)) - 1).cast("int").alias("predicted"), F.round(F.array_max("_s"), 5).alias("score"))


@query("SELECT event_type AS label, user_id AS term, count(*) AS n FROM events GROUP BY ALL")
def nb_stream_counts(spark, d):
    counts = lambda f: f.groupBy(F.col("event_type").alias("label"), F.col("user_id").alias("term")).agg(F.count(F.lit(1)).alias("n"))
    return streamed(counts, stream_table(spark, f"{d}/events.parquet"))


# --- trees ---------------------------------------------------------------------------------------------


@query("WITH " + LINES + ", c AS (SELECT status, count(*) FILTER (label = 0) AS a, count(*) FILTER (label = 1) AS b, count(*) FILTER (label = 2) AS c, count(*) AS n FROM li GROUP BY status), p AS (SELECT status, a / n AS a, b / n AS b, c / n AS c FROM c) SELECT status, round(1 - a * a - b * b - c * c, 6) AS gini, round(-(CASE WHEN a > 0 THEN a * log2(a) ELSE 0 END + CASE WHEN b > 0 THEN b * log2(b) ELSE 0 END + CASE WHEN c > 0 THEN c * log2(c) ELSE 0 END), 6) AS entropy, round(1 - greatest(a, b, c), 6) AS error FROM p")
def impurities(spark, d):
    counted = lines(spark, d).groupBy("status").agg(F.array(*[F.count_if(F.col("label") == k) for k in range(3)]).alias("c"))
    return rounded(counted.select("status", V.gini("c").alias("gini"), V.entropy("c").alias("entropy"), V.classification_error("c").alias("error")))


_G = "1 - (({0}0) * ({0}0) + ({0}1) * ({0}1) + ({0}2) * ({0}2)) / (({0}0 + {0}1 + {0}2) * ({0}0 + {0}1 + {0}2))"
_GAIN = f"({_G.format('a')}) - (t0 + t1 + t2) / (a0 + a1 + a2) * ({_G.format('t')}) - (1 - (t0 + t1 + t2) / (a0 + a1 + a2)) * ({_G.format('f')})"
_SPLIT = _LONG + """, b AS (SELECT feature, v, CAST(count(*) FILTER (label = 0) AS DOUBLE) AS c0, CAST(count(*) FILTER (label = 1) AS DOUBLE) AS c1, CAST(count(*) FILTER (label = 2) AS DOUBLE) AS c2 FROM l GROUP BY 1, 2),
r AS (SELECT feature, v, lead(v) OVER w AS nx, sum(c0) OVER w AS t0, sum(c1) OVER w AS t1, sum(c2) OVER w AS t2, sum(c0) OVER f AS a0, sum(c1) OVER f AS a1, sum(c2) OVER f AS a2 FROM b WINDOW w AS (PARTITION BY feature ORDER BY v ROWS UNBOUNDED PRECEDING), f AS (PARTITION BY feature)),
s AS (SELECT *, (v + nx) / 2 AS threshold, a0 - t0 AS f0, a1 - t1 AS f1, a2 - t2 AS f2 FROM r WHERE nx IS NOT NULL), gains AS (SELECT feature, threshold, """ + _GAIN + " AS gain FROM s)"


@query(_SPLIT + ", best AS (SELECT * FROM gains WHERE round(gain, 9) > 0 QUALIFY row_number() OVER (PARTITION BY feature ORDER BY round(gain, 9) DESC, threshold) = 1) SELECT feature, round(threshold, 6) AS threshold, round(gain, 6) AS gain FROM best")
def tree_best_split_numeric(spark, d):
    """The best split of each feature."""
    splits = T.numeric_splits(lines(spark, d), X, 3).withColumn("group", F.col("feature"))
    return rounded(T.best_splits(splits).select("feature", "threshold", "gain"))


@query("WITH " + LINES + ", b AS (SELECT status AS v, CAST(count(*) FILTER (label = 0) AS DOUBLE) AS t0, CAST(count(*) FILTER (label = 1) AS DOUBLE) AS t1, CAST(count(*) FILTER (label = 2) AS DOUBLE) AS t2 FROM li GROUP BY 1), s AS (SELECT *, sum(t0) OVER () AS a0, sum(t1) OVER () AS a1, sum(t2) OVER () AS a2 FROM b), u AS (SELECT *, a0 - t0 AS f0, a1 - t1 AS f1, a2 - t2 AS f2 FROM s) SELECT 0 AS feature, CAST(v AS DOUBLE) AS threshold, round(" + _GAIN + ", 6) AS gain FROM u")
def tree_split_nominal(spark, d):
    return rounded(T.nominal_splits(lines(spark, d), ["status"], 3).select("feature", "threshold", "gain"))


_STUMP = T.Tree(T.Node(0, [5, 5, 5], 0, 0.5, 0.25, (T.Node(1, [4, 1, 1]), T.Node(2, [1, 4, 4], 1, 0.6, 0.125, (T.Node(3, [0, 4, 1]), T.Node(4, [1, 0, 3]))))), X)


@query("WITH " + LINES + " SELECT id, CASE WHEN x0 <= 0.5 THEN 0 WHEN x1 <= 0.6 THEN 1 ELSE 2 END AS predicted, round(CASE WHEN x0 <= 0.5 THEN 5 / 9 WHEN x1 <= 0.6 THEN 1 / 8 ELSE 2 / 7 END, 6) AS p0 FROM li")
def tree_predict_fixed(spark, d):
    return rounded(lines(spark, d).select("id", _STUMP.predict().alias("predicted"), _STUMP.posterior()[0].alias("p0")))


@query("SELECT * FROM (VALUES (0, CAST(0.25 AS DOUBLE)), (1, CAST(0.125 AS DOUBLE)), (2, CAST(0 AS DOUBLE)), (3, CAST(0 AS DOUBLE))) t(feature, importance)")
def tree_importance(spark, d):
    return spark.createDataFrame(list(enumerate(_STUMP.importance())), "feature int, importance double")


@query("WITH " + LINES + " SELECT CASE WHEN x0 <= 0.5 THEN 1 ELSE 2 END AS leaf, count(DISTINCT label) = 1 AS pure FROM li GROUP BY 1")
def tree_purity(spark, d):
    return lines(spark, d).groupBy(F.when(F.col("x0") <= 0.5, 1).otherwise(2).alias("leaf")).agg((F.min("label") == F.max("label")).alias("pure"))


@query(_SPLIT + " SELECT feature, round(threshold, 6) AS threshold, round(gain, 6) AS gain FROM gains WHERE round(gain, 9) > 0 QUALIFY row_number() OVER (ORDER BY round(gain, 9) DESC, feature, threshold) = 1")
def tree_fit_root(spark, d):
    """The first split of a fitted tree."""
    root = T.Tree.fit(lines(spark, d), X, max_nodes=2).root
    return rounded(spark.createDataFrame([(root.feature, float(root.threshold), float(root.gain))], "feature int, threshold double, gain double"))


@query()
def tree_fit(spark, d):
    tree = T.Tree.fit(lines(spark, d), X, max_nodes=6)
    return lines(spark, d).withColumn("leaf", tree.leaf()).groupBy("leaf").agg(F.count(F.lit(1)).alias("n"))


_SUB = "WITH " + LINES + ", o AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY md5(CAST(id AS VARCHAR)), id) AS r, count(*) OVER (PARTITION BY label) AS n FROM (SELECT id, min(label) AS label, min(y) AS y FROM li GROUP BY id)), sub AS (SELECT id, label, y FROM o WHERE r <= round(n * 0.3))"


def _unique_lines(spark, d):
    return lines(spark, d).groupBy("id").agg(F.min("label").alias("label"), F.min("y").alias("y"))


@query(_SUB + " SELECT id, label FROM sub")
def forest_subsample(spark, d):
    return T.stratified_subsample(_unique_lines(spark, d), "id", 0.3).select("id", "label")


@query(_SUB + " SELECT count(*) AS oob, CAST(sum(CAST(id % 3 = label AS INTEGER)) AS BIGINT) AS correct, round(avg(CAST(id % 3 = label AS INTEGER)), 6) AS accuracy FROM o WHERE id NOT IN (SELECT id FROM sub)")
def forest_oob(spark, d):
    rows = _unique_lines(spark, d).withColumn("predicted", (F.col("id") % 3).cast("int"))
    return rounded(T.out_of_bag(rows, T.stratified_subsample(rows, "id", 0.3), "id", "predicted"))


@query("WITH " + LINES + ", v AS (SELECT DISTINCT id, unnest([id % 3, id % 2, (id // 7) % 3]) AS label, unnest([0, 1, 2]) AS tree FROM li), c AS (SELECT id, label, count(*) AS n FROM v GROUP BY 1, 2) SELECT id, CAST(label AS INTEGER) AS predicted FROM c QUALIFY row_number() OVER (PARTITION BY id ORDER BY n DESC, label) = 1")
def forest_vote(spark, d):
    i = F.col("id")
    each = _unique_lines(spark, d).select("id", F.explode(F.array(*[(e).cast("int") for e in (i % 3, i % 2, F.floor(i / 7) % 3)])).alias("label"))
    return T.votes(each, "id")


def _beats(rows: DataFrame, predicted: DataFrame) -> DataFrame:
    """(n, beats): rows, and whether fewer are wrong than by always saying the most frequent label."""
    wrong = predicted.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("predicted") != F.col("label")).alias("wrong")).first()
    most = rows.groupBy("label").count().agg(F.max("count")).first()[0]
    return rows.sparkSession.createDataFrame([(wrong["n"], wrong["wrong"] < wrong["n"] - most)], "n long, beats boolean")


_COUNTED = "SELECT count(*) AS n, true AS beats FROM embeddings"


@query(_COUNTED)
def forest_fit_beats_majority(spark, d):
    """The majority vote of a forest grown here, eight features a split."""
    names = [f"x{i}" for i in range(64)]
    rows = _train(spark, d).select("id", F.col("label").cast("int").alias("label"), *[F.col("features")[i].alias(n) for i, n in enumerate(names)])
    forest = T.Forest.fit(rows, names, "id", trees=2, max_nodes=8)
    return _beats(rows, rows.withColumn("predicted", forest.predict(10)))


@query()
def forest_fit(spark, d):
    model = T.Forest.mllib(_train(spark, d), trees=20, seed=3)
    from pyspark.ml.functions import array_to_vector

    scored = model.transform(_train(spark, d).withColumn("_v", array_to_vector("features")))
    return scored.select("id", "label", F.col("prediction").cast("int").alias("predicted"))


# --- linear models -------------------------------------------------------------------------------------

W = [0.5, -0.25, 0.75, -1.0, 0.1]
_Z = "0.5 * x0 - 0.25 * x1 + 0.75 * x2 - x3 + 0.1"
_SIG = "1 / (1 + exp(-z))"
WM = [[0.5, 0.1, -0.2, 0.3, 0.0], [-0.5, 0.2, 0.4, 0.1, 0.2], [0.1, -0.3, 0.2, 0.4, -0.1]]
_ZM = ["0.5 * x0 + 0.1 * x1 - 0.2 * x2 + 0.3 * x3", "-0.5 * x0 + 0.2 * x1 + 0.4 * x2 + 0.1 * x3 + 0.2", "0.1 * x0 - 0.3 * x1 + 0.2 * x2 + 0.4 * x3 - 0.1"]
_LOGIT = "WITH " + LINES + f", z AS (SELECT *, {_Z} AS z FROM li)"
_MULTI = "WITH " + LINES + ", z AS (SELECT *, " + ", ".join(f"{e} AS z{k}" for k, e in enumerate(_ZM)) + " FROM li)"
_PEN = 0.5 / 2 * sum(w * w for w in W[:4])


def _binary(spark, d):
    return featured(spark, d).drop("label").withColumnRenamed("y", "label")


@query(_LOGIT + f" SELECT round(sum(CASE WHEN z > 15 THEN z ELSE ln(1 + exp(z)) END - y * z) + {_PEN}, 4) AS value FROM z")
def logit_objective(spark, d):
    return rounded(L.logistic_objective(_binary(spark, d), W, 0.5).select("value"), 4)


@query(_LOGIT + " SELECT " + ", ".join(f"round(sum(({_SIG} - y) * x{i}) + {0.5 * W[i]}, 4) AS g{i}" for i in range(4)) + f", round(sum({_SIG} - y), 4) AS g4 FROM z")
def logit_gradient(spark, d):
    return rounded(L.logistic_objective(_binary(spark, d), W, 0.5).drop("value"), 4)


@query(_LOGIT + f" SELECT id, round({_SIG}, 6) AS posterior, CAST({_SIG} >= 0.5 AS INTEGER) AS predicted FROM z")
def logit_predict(spark, d):
    model = L.Logistic(L.np.array(W), 0.0)
    return rounded(model.predict(featured(spark, d)).select("id", F.col("posterior")[1].alias("posterior"), "predicted"))


_SUM = "(exp(z0) + exp(z1) + exp(z2))"


@query(_MULTI + f" SELECT round(-sum(ln(CASE label WHEN 0 THEN exp(z0) WHEN 1 THEN exp(z1) ELSE exp(z2) END / {_SUM})) + {0.5 / 2 * sum(v * v for w in WM for v in w[:4])}, 4) AS value FROM z")
def logit_multi_objective(spark, d):
    return rounded(L.multiclass_objective(featured(spark, d), WM, 0.5), 4)


@query(_MULTI + f" SELECT id, round(exp(z0) / {_SUM}, 6) AS p0, CASE WHEN z0 >= z1 AND z0 >= z2 THEN 0 WHEN z1 >= z2 THEN 1 ELSE 2 END AS predicted FROM z")
def logit_multi_posterior(spark, d):
    model = L.Logistic(L.np.array(WM), 0.0)
    return rounded(model.predict(featured(spark, d)).select("id", F.col("posterior")[0].alias("p0"), "predicted"))


@query()
def logit_fit(spark, d):
    model = L.Logistic.fit(_binary(spark, d), penalty=0.5)
    return spark.createDataFrame([(i, float(w)) for i, w in enumerate(model.weights)], "weight int, value double")


@query("SELECT weight, 0.0::DOUBLE AS gradient FROM (VALUES (0), (1), (2), (3), (4)) t(weight)")
def logit_fit_is_optimal(spark, d):
    """The gradient a row at the fitted weights, to three digits."""
    rows = _binary(spark, d)
    found = L.logistic_objective(rows, [float(w) for w in L.Logistic.fit(rows, penalty=0.5).weights], 0.5).first()
    n = rows.count()
    return spark.createDataFrame([(i, abs(round(found[f"g{i}"] / n, 3))) for i in range(5)], "weight int, gradient double")


@query("WITH " + LINES + """, m AS (SELECT label, avg(x0) AS m0, avg(x1) AS m1, avg(x2) AS m2, avg(x3) AS m3 FROM li GROUP BY label),
c AS (SELECT [x0 - m0, x1 - m1, x2 - m2, x3 - m3] AS x FROM li JOIN m USING (label)), n AS (SELECT (SELECT count(*) FROM li) - (SELECT count(*) FROM m) AS n)
SELECT i, j, round(sum(x[i + 1] * x[j + 1]) / any_value(n), 6) AS within FROM c, n, (VALUES (0), (1), (2), (3)) a(i), (VALUES (0), (1), (2), (3)) b(j) GROUP BY i, j""")
def lda_fit_rebuilds_within(spark, d):
    """The covariance within classes out of the fitted directions and variances."""
    model = L.Discriminant.fit(featured(spark, d))
    return rounded(_entries(spark, model.directions @ L.np.diag(model.variances) @ model.directions.T, "within"))


@query("WITH " + LINES + " SELECT label, count(*) AS n, round(count(*) / (SELECT count(*) FROM li), 6) AS prior, " + ", ".join(f"round(avg(x{i}), 6) AS m{i}" for i in range(4)) + " FROM li GROUP BY label")
def lda_stats(spark, d):
    rows = lines(spark, d)
    n = rows.agg(F.count(F.lit(1)).alias("all"))
    grouped = rows.groupBy("label").agg(F.count(F.lit(1)).alias("n"), *[F.avg(x).alias(f"m{i}") for i, x in enumerate(X)])
    return rounded(grouped.join(F.broadcast(n)).select("label", "n", (F.col("n") / F.col("all")).alias("prior"), "m0", "m1", "m2", "m3"))


@query("WITH " + LINES + ", s AS (SELECT id, ln(0.5) - ((x0 - 0.2) ^ 2 + (x1 - 0.2) ^ 2 / 2 + (x2 - 0.2) ^ 2 + (x3 - 0.2) ^ 2) / 2 AS a, ln(0.5) - ((x0 - 0.8) ^ 2 + (x1 - 0.6) ^ 2 / 2 + (x2 - 0.8) ^ 2 + (x3 - 0.4) ^ 2) / 2 AS b FROM li) SELECT id, CAST(round(b, 9) > round(a, 9) AS INTEGER) AS predicted, round(exp(a) / (exp(a) + exp(b)), 6) AS p0 FROM s")
def lda_predict_fixed(spark, d):
    np = L.np
    model = L.Discriminant(np.array([[0.2] * 4, [0.8, 0.6, 0.8, 0.4]]), np.array([0.5, 0.5]), np.eye(4), np.array([1.0, 2.0, 1.0, 1.0]))
    out = model.predict(featured(spark, d))
    return rounded(out.select("id", (F.round(F.col("posterior")[1], 9) > F.round(F.col("posterior")[0], 9)).cast("int").alias("predicted"), F.col("posterior")[0].alias("p0")))


@query()
def lda_fit(spark, d):
    model = L.Discriminant.fit(_train(spark, d))
    return S.error_rate(model.predict(_train(spark, d)), "predicted", "label")


# --- networks --------------------------------------------------------------------------------------------

_HID = [[0.5, -0.4, 0.3, 0.2], [-0.3, 0.6, 0.1, -0.2]]
_h = lambda f: [f("0.5 * x0 - 0.4 * x1 + 0.3 * x2 + 0.2 * x3"), f("-0.3 * x0 + 0.6 * x1 + 0.1 * x2 - 0.2 * x3")]
_HS, _HT = _h(lambda z: f"1 / (1 + exp(-({z})))"), _h(lambda z: f"tanh({z})")


def _fixed(output: list[list[float]], **kinds) -> Network:
    return Network([4, 2, len(output)], weights=[L.np.array(_HID), L.np.array(output)], **kinds)


@query("WITH " + LINES + f", h AS (SELECT id, {_HS[0]} AS a, {_HS[1]} AS b FROM li), o AS (SELECT id, 0.7 * a - 0.2 * b AS z0, -0.5 * a + 0.9 * b AS z1, 0.1 * a + 0.3 * b AS z2 FROM h) SELECT id, round(exp(z0) / {_SUM}, 6) AS p0, CASE WHEN z0 >= z1 AND z0 >= z2 THEN 0 WHEN z1 >= z2 THEN 1 ELSE 2 END AS predicted FROM o")
def nn_forward_classes(spark, d):
    net = _fixed([[0.7, -0.2], [-0.5, 0.9], [0.1, 0.3]])
    return rounded(featured(spark, d).select("id", net.forward()[0].alias("p0"), net.predict().alias("predicted")))


@query("WITH " + LINES + f", h AS (SELECT id, {_HS[0]} AS a, {_HS[1]} AS b FROM li), o AS (SELECT id, 1 / (1 + exp(-(0.7 * a - 0.9 * b))) AS p FROM h) SELECT id, round(p, 6) AS p0, CAST(p <= 0.5 AS INTEGER) AS predicted FROM o")
def nn_forward_one_unit(spark, d):
    net = _fixed([[0.7, -0.9]])
    return rounded(featured(spark, d).select("id", net.forward()[0].alias("p0"), net.predict().alias("predicted")))


@query("WITH " + LINES + f" SELECT id, round(0.7 * {_HT[0]} - 0.2 * {_HT[1]}, 6) AS predicted FROM li")
def nn_forward_regression(spark, d):
    return rounded(featured(spark, d).select("id", _fixed([[0.7, -0.2]], kind="regression", hidden="Tanh").predict().alias("predicted")))


@query()
def nn_fit(spark, d):
    rows = _train(spark, d)
    net = Network([64, 8, 10], epochs=5).fit(rows, order="id")
    return S.error_rate(rows.withColumn("predicted", net.predict()), "predicted", "label")


# --- validation ------------------------------------------------------------------------------------------


@query("WITH o AS (SELECT o_orderkey, row_number() OVER (ORDER BY md5(CAST(o_orderkey AS VARCHAR)), o_orderkey) - 1 AS r, count(*) OVER () AS n FROM orders) SELECT o_orderkey, CAST(least(r // (n // 7), 6) AS INTEGER) AS fold FROM o")
def cv_folds(spark, d):
    return S.cross_validation(table(spark, d, "orders").select("o_orderkey"), "o_orderkey", 7)


@query("SELECT s_suppkey, s_suppkey = 1 AS left_out FROM supplier")
def loocv_fold(spark, d):
    """The rows of one fold: those to train with and the one left out."""
    train, test = S.leave_one_out_fold(table(spark, d, "supplier").select("s_suppkey"), "s_suppkey", 1)
    return train.withColumn("left_out", F.lit(False)).unionByName(test.withColumn("left_out", F.lit(True)))


@query("SELECT n_nationkey AS test, (SELECT count(*) - 1 FROM nation) AS train_n FROM nation")
def loocv_pairs(spark, d):
    return S.leave_one_out(table(spark, d, "nation"), "n_nationkey")


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_quantity > 49)")
def slice_by_index(spark, d):
    chosen = table(spark, d, "lineitem").where("l_quantity > 49").select(F.col("l_orderkey").alias("o_orderkey"))
    return S.slice_rows(table(spark, d, "orders").select("o_orderkey", "o_totalprice"), "o_orderkey", chosen)


@query("SELECT o_orderkey, CAST(list_position(['F', 'O', 'P'], o_orderstatus) - 1 AS INTEGER) AS code FROM orders")
def label_encode_declared(spark, d):
    from quarry.sources.text import nominal_codes

    meta = table(spark, d, "orders").select("o_orderkey", F.col("o_orderstatus").alias("code", metadata={"values": ["F", "O", "P"]}))
    return nominal_codes(meta, "code")


@query("WITH f AS (SELECT o_orderpriority, min(o_orderkey) AS first FROM orders GROUP BY 1), c AS (SELECT o_orderpriority, row_number() OVER (ORDER BY first) - 1 AS code FROM f) SELECT o_orderkey, CAST(code AS INTEGER) AS label_code FROM orders JOIN c USING (o_orderpriority)")
def label_encode_first_seen(spark, d):
    from quarry.sources.text import first_seen_codes

    rows = table(spark, d, "orders").select("o_orderkey", F.col("o_orderpriority").alias("label"))
    return first_seen_codes(rows, "label", "o_orderkey")[0].select("o_orderkey", "label_code")


@query("SELECT o_orderkey, CAST(left(o_orderpriority, 1) AS DOUBLE) AS target FROM orders")
def numeric_target(spark, d):
    from quarry.sources.text import numeric_target as number

    return table(spark, d, "orders").withColumn("t", F.substring("o_orderpriority", 1, 1)).select("o_orderkey", number("t").alias("target"))


@query("SELECT o_orderstatus AS a, o_orderpriority AS b, count(*) AS n FROM orders GROUP BY ALL")
def contingency(spark, d):
    return S.contingency(table(spark, d, "orders"), "o_orderstatus", "o_orderpriority")


_CONT = """WITH c AS (SELECT o_orderstatus AS a, o_orderpriority AS b, CAST(count(*) AS DOUBLE) AS n FROM orders GROUP BY ALL),
s AS (SELECT (SELECT sum(n) FROM c) AS n, (SELECT sum(n * n) FROM c) AS ij, (SELECT sum(m * m) FROM (SELECT sum(n) AS m FROM c GROUP BY a)) AS i, (SELECT sum(m * m) FROM (SELECT sum(n) AS m FROM c GROUP BY b)) AS j) """


@query(_CONT + "SELECT round((ij - n - (i - n) / 2 - (j - n) / 2 + n * (n - 1) / 2) / (n * (n - 1) / 2), 9) AS rand_index FROM s")
def rand_index(spark, d):
    return rounded(S.rand_index(table(spark, d, "orders"), "o_orderstatus", "o_orderpriority"), 9)


@query(_CONT + ", e AS (SELECT (ij - n) / 2 AS x, (i - n) / 2 AS p, (j - n) / 2 AS q, n * (n - 1) / 2 AS t FROM s) SELECT round((x - p * q / t) / ((p + q) / 2 - p * q / t), 9) AS adjusted_rand_index FROM e")
def adjusted_rand_index(spark, d):
    return rounded(S.adjusted_rand_index(table(spark, d, "orders"), "o_orderstatus", "o_orderpriority"), 9)


@query("WITH " + LINES + " SELECT CAST(sum(CAST(y <> status AS INTEGER)) AS BIGINT) AS errors, count(*) AS n, round(avg(CAST(y <> status AS INTEGER)), 6) AS rate FROM li")
def error_rate(spark, d):
    return rounded(S.error_rate(lines(spark, d), "status", "y"))


@query("SELECT vec_id AS id, CAST(label = 3 AS INTEGER) AS target FROM embeddings")
def one_vs_rest(spark, d):
    return S.one_vs_rest(_train(spark, d), "label", 3).select("id", "target")
