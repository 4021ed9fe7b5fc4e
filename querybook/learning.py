"""Preparation, models, metrics and clustering.

Splits go by the md5 of the part key, which SQL repeats. Least squares and naive Bayes are worked out in SQL; of models without
a closed form the SQL says what must hold: the size of the test part, and that they beat the majority or the mean.
"""

from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from colsift.ml import boosting, density, engine, metrics, models, prepare
from colsift.plans.session import small_frame
from querybook.base import given, query, r, read, rounded

P = "ml_parts"
FEATURES = ["p_partkey", "p_brand", "p_type", "p_size", "p_retailprice"]  # every column but the class
SIZE = "coalesce(p_size, (SELECT quantile_cont(p_size, 0.5) FROM ml_parts))"


def _code(column):
    return f"(dense_rank() OVER (ORDER BY coalesce({column}, 'nan')) - 1)::DOUBLE"


@query("ml_encode", given(P) + f"SELECT p_partkey, {_code('p_brand')} AS p_brand, {_code('p_type')} AS p_type FROM {P}")
def ml_encode(spark, folder):
    return prepare.encode(read(spark, folder, P), ["p_brand", "p_type"])[0].select("p_partkey", "p_brand", "p_type")


@query("ml_impute", given(P, "comissing_orders") + f"""
    SELECT 'p_size' AS column_name, p_partkey AS id, CAST(CAST({SIZE} AS DOUBLE) AS VARCHAR) AS value FROM {P}
    UNION ALL SELECT 'o_orderpriority', o_orderkey, coalesce(o_orderpriority, (SELECT o_orderpriority FROM comissing_orders WHERE o_orderpriority IS NOT NULL
        GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1)) FROM comissing_orders""")
def ml_impute(spark, folder):
    sizes = prepare.impute(read(spark, folder, P), ["p_size"])
    priorities = prepare.impute(read(spark, folder, "comissing_orders"), ["o_orderpriority"])
    return sizes.select(F.lit("p_size").alias("column_name"), F.col("p_partkey").alias("id"), F.col("p_size").cast("string").alias("value")).unionAll(
        priorities.select(F.lit("o_orderpriority"), "o_orderkey", "o_orderpriority"))


@query("ml_prepare", given(P) + f"""
    SELECT CAST(p_partkey AS DOUBLE) AS p_partkey, {_code('p_brand')} AS p_brand, {_code('p_type')} AS p_type, CAST({SIZE} AS DOUBLE) AS p_size,
           p_retailprice, {_code('price_class')} AS label FROM {P}""")
def ml_prepare(spark, folder):
    return prepare.prepare(read(spark, folder, P), "price_class", "classification", FEATURES).df


@query("ml_analyze", given("ml_docs") + f"""
    SELECT 'shape' AS kind, 'rows' AS name, CAST(count(*) AS DOUBLE) AS value FROM ml_docs
    UNION ALL SELECT 'shape', 'features', 5.0
    UNION ALL SELECT 'class_balance', 'max_to_min', {r("max(k) * 1.0 / min(k)")} FROM (SELECT count(*) AS k FROM ml_docs GROUP BY quality)
    UNION ALL SELECT 'issue', 'Severe class imbalance detected', CAST(max(k) > 10 * min(k) AS DOUBLE) FROM (SELECT count(*) AS k FROM ml_docs GROUP BY quality)
    UNION ALL SELECT 'recommended_model', unnest(CASE WHEN n < 1000 THEN ['Logistic Regression', 'Decision Tree', 'Random Forest'] ELSE ['Random Forest', 'XGBoost', 'SVM'] END),
        unnest([1.0, 2.0, 3.0])::DOUBLE FROM (SELECT count(*) AS n FROM ml_docs)
    UNION ALL SELECT 'target', 'mean', {r("avg(p_retailprice)")} FROM part UNION ALL SELECT 'target', 'std_pop', {r("stddev_pop(p_retailprice)")} FROM part
    UNION ALL SELECT 'target', 'min', min(p_retailprice) FROM part UNION ALL SELECT 'target', 'max', max(p_retailprice) FROM part""")
def ml_analyze(spark, folder):
    docs = engine.ModelBench(read(spark, folder, "ml_docs"), "quality", "classification").analyze()
    prices = engine.ModelBench(read(spark, folder, "part"), "p_retailprice", "regression", ["p_size"]).analyze()
    return rounded(docs.unionAll(prices.filter("kind = 'target'")))


def _place(key):
    return f"('0x' || substr(md5('42|' || CAST({key} AS VARCHAR)), 1, 8))::BIGINT % 10000"


@query("ml_split", f"SELECT CASE WHEN {_place('o_orderkey')} < 2000 THEN 'test' ELSE 'train' END AS part, count(*) AS n, count(DISTINCT o_orderkey) AS n_keys FROM orders GROUP BY 1")
def ml_split(spark, folder):
    orders = read(spark, folder, "orders")
    train, test = prepare.split(orders, 0.2, 42, "o_orderkey")
    both = train.select(F.lit("train").alias("part"), "o_orderkey").unionAll(test.select(F.lit("test"), "o_orderkey"))
    return both.groupBy("part").agg(F.count("*").alias("n"), F.count_distinct("o_orderkey").alias("n_keys"))


def _z(column):
    return r(f"({column} - avg({column}) OVER ()) / stddev_pop({column}) OVER ()", 6) + f" AS {column}"


@query("ml_scale", f"SELECT {_z("o_custkey")}, {_z("o_totalprice")}, o_orderkey FROM orders")
def ml_scale(spark, folder):
    orders = read(spark, folder, "orders").selectExpr("double(o_custkey) AS o_custkey", "o_totalprice", "o_orderkey")
    return rounded(prepare.Scaler.fit(orders, ["o_custkey", "o_totalprice"]).transform(orders), 6)


def _bench(spark, folder, problem):
    target = {"classification": "price_class", "regression": "p_retailprice"}[problem]
    return engine.ModelBench(read(spark, folder, P), target, problem, split_key="p_partkey")


N_TEST = f"(SELECT count(*) FROM {P} WHERE {_place('p_partkey')} < 2000)"


def _trained(name, problem, model):
    @query(name, given(P) + f"SELECT '{model}' AS model_type, {N_TEST} AS n_test, true AS beats_baseline")
    def run(spark, folder):
        with _bench(spark, folder, problem) as bench:
            trained = bench.train(model)
            found = trained.metrics.first()
            labels = trained.predictions.groupBy("label").count().agg(F.sum("count"), F.max("count")).first()
        better = found["accuracy"] > labels[1] / labels[0] if problem == "classification" else found["r2"] > 0
        return small_frame(spark, [{"model_type": trained.name, "n_test": labels[0], "beats_baseline": better}],
                           "model_type string, n_test bigint, beats_baseline boolean")
    return run


for _name, _problem, _model in (
        ("ml_logistic", "classification", "logistic_regression"), ("ml_random_forest_cls", "classification", "random_forest"),
        ("ml_decision_tree_cls", "classification", "decision_tree"), ("ml_svm", "classification", "svm"),
        ("ml_xgboost_cls", "classification", "xgboost"),
        ("ml_random_forest_reg", "regression", "random_forest"), ("ml_decision_tree_reg", "regression", "decision_tree"),
        ("ml_svr", "regression", "svr"), ("ml_xgboost_reg", "regression", "xgboost")):
    _trained(_name, _problem, _model)


@query("ml_boosted_split", f"""
    WITH base AS (SELECT l_quantity, l_discount, l_tax, avg(l_extendedprice) OVER () - l_extendedprice AS g FROM lineitem),
    cells AS (SELECT 'l_quantity' AS feature, l_quantity AS x, sum(g) AS g, count(*) AS h FROM base GROUP BY l_quantity
              UNION ALL SELECT 'l_discount', l_discount, sum(g), count(*) FROM base GROUP BY l_discount
              UNION ALL SELECT 'l_tax', l_tax, sum(g), count(*) FROM base GROUP BY l_tax),
    cuts AS (SELECT feature, x, sum(g) OVER (PARTITION BY feature ORDER BY x) AS lg, sum(h) OVER (PARTITION BY feature ORDER BY x) AS lh FROM cells),
    total AS (SELECT sum(g) AS g, count(*) AS h FROM base),
    gains AS (SELECT *, lg * lg / (lh + 1) + (g - lg) * (g - lg) / (h - lh + 1) - g * g / (h + 1) AS gain FROM cuts, total WHERE lh < h)
    SELECT feature, CAST(x AS DOUBLE) AS threshold, {r("gain / h", 2)} AS gain_per_row, {r("-0.3 * lg / (lh + 1)", 4)} AS left_value,
           {r("-0.3 * (g - lg) / (h - lh + 1)", 4)} AS right_value FROM gains ORDER BY gain DESC LIMIT 1""")
def ml_boosted_split(spark, folder):
    names = ["l_quantity", "l_discount", "l_tax"]
    data = VectorAssembler(inputCols=names, outputCol=prepare.FEATURES).transform(
        read(spark, folder, "lineitem").selectExpr(*[f"double({c}) AS {c}" for c in names], "double(l_extendedprice) AS label")).select(prepare.FEATURES, "label")
    model = boosting.Boosting(maxIter=1, maxDepth=1, rows_in_task=0).fit(data)
    tree, feature = model.rounds[0][0], int(model.rounds[0][0].feature[1])
    return rounded(small_frame(spark, [{
        "feature": names[feature], "threshold": float(model.edges[feature][tree.bin[1]]), "gain_per_row": float(tree.gain[1]) / data.count(),
        "left_value": float(tree.value[2]), "right_value": float(tree.value[3])}],
        "feature string, threshold double, gain_per_row double, left_value double, right_value double"), 4, gain_per_row=2)


# every feature but the target as numbers, with the part that each row belongs to
BASE_CLS = f"""SELECT CAST(p_partkey AS DOUBLE) AS x1, {_code('p_brand')} AS x2, {_code('p_type')} AS x3, CAST({SIZE} AS DOUBLE) AS x4,
    p_retailprice AS x5, {_code('price_class')} AS y, {_place('p_partkey')} < 2000 AS test FROM {P}"""
BASE_REG = BASE_CLS.replace("p_retailprice AS x5", f"{_code('price_class')} AS x5").replace(f"{_code('price_class')} AS y", "p_retailprice AS y")


@query("ml_naive_bayes", given(P) + f""", base AS ({BASE_CLS}), numbered AS (SELECT *, row_number() OVER (ORDER BY x1) AS id FROM base),
    tall AS (SELECT id, y, test, f, x FROM numbered UNPIVOT (x FOR f IN (x1, x2, x3, x4, x5))),
    scale AS (SELECT f, avg(x) AS m, stddev_pop(x) AS s FROM tall WHERE NOT test GROUP BY f),
    z AS (SELECT id, y, test, f, CASE WHEN s = 0 THEN 0 ELSE (x - m) / s END AS z FROM tall JOIN scale USING (f)),
    widest AS (SELECT max(v) AS v FROM (SELECT var_pop(z) AS v FROM z WHERE NOT test GROUP BY f)),
    fit AS (SELECT y AS c, f, avg(z) AS mu, var_pop(z) + 1e-9 * (SELECT v FROM widest) AS v FROM z WHERE NOT test GROUP BY y, f),
    prior AS (SELECT y AS c, ln(count(*) / sum(count(*)) OVER ()) AS p FROM base WHERE NOT test GROUP BY y),
    score AS (SELECT id, any_value(y) AS y, c, any_value(p) - sum(ln(v) + (z - mu) * (z - mu) / v) / 2 AS s FROM z JOIN fit USING (f) JOIN prior USING (c)
              WHERE test GROUP BY id, c),
    guess AS (SELECT id, any_value(y) AS label, arg_max(c, s) AS prediction FROM score GROUP BY id),
    per AS (SELECT label, count(*) AS support, count(*) FILTER (label = prediction) AS hits, (SELECT count(*) FROM guess q WHERE q.prediction = g.label) AS predicted FROM guess g GROUP BY label),
    scored AS (SELECT support, hits, CASE WHEN predicted > 0 THEN hits * 1.0::DOUBLE / predicted ELSE 0 END AS pr, hits * 1.0::DOUBLE / support AS re FROM per)
    SELECT 'naive_bayes' AS model_type, {r("sum(hits) * 1.0::DOUBLE / sum(support)", 6)} AS accuracy, {r("sum(pr * support) / sum(support)", 6)} AS precision,
           {r("sum(re * support) / sum(support)", 6)} AS recall,
           {r("sum(CASE WHEN pr + re > 0 THEN 2 * pr * re / (pr + re) ELSE 0 END * support) / sum(support)", 6)} AS f1_score FROM scored""")
def ml_naive_bayes(spark, folder):
    with _bench(spark, folder, "classification") as bench:
        trained = bench.train("naive_bayes")
        found = trained.metrics.first().asDict()
    frame = small_frame(spark, [found], "accuracy double, precision double, recall double, f1_score double")
    return rounded(frame, 6).select(F.lit(trained.name).alias("model_type"), "*")


@query("ml_linear", f"""
    SELECT 'part' AS table_name, {r("regr_slope(p_retailprice, p_partkey)", 6)} AS slope, {r("regr_intercept(p_retailprice, p_partkey)", 4)} AS intercept FROM part
    UNION ALL SELECT 'lineitem', {r("regr_slope(l_extendedprice * (1 - l_discount), l_extendedprice)", 6)},
        {r("regr_intercept(l_extendedprice * (1 - l_discount), l_extendedprice)", 4)} FROM lineitem""")
def ml_linear(spark, folder):
    found = []
    for table, x, y in (("part", "p_partkey", "p_retailprice"), ("lineitem", "l_extendedprice", "l_extendedprice * (1 - l_discount)")):
        data = VectorAssembler(inputCols=["x"], outputCol=prepare.FEATURES).transform(
            read(spark, folder, table).selectExpr(f"double({x}) AS x", f"{y} AS label"))
        model = models.estimator("regression", "Linear Regression").fit(data)
        found.append({"table_name": table, "slope": float(model.coefficients[0]), "intercept": model.intercept})
    return rounded(small_frame(spark, found, "table_name string, slope double, intercept double"), 6, intercept=4)


def _customers(spark, folder):
    return engine.ModelBench(read(spark, folder, "customer"), None, "clustering", ["c_acctbal", "c_nationkey"])


@query("ml_kmeans", "SELECT CAST(8 AS BIGINT) AS n_clusters, count(*) AS n, true AS nearest_centres, true AS cost_is_inertia FROM customer")
def ml_kmeans(spark, folder):
    with engine.ModelBench(read(spark, folder, "customer"), None, "clustering") as bench:
        trained = bench.train("kmeans")
        # each row's squared distance to every centre, from the centres alone
        centres = [[float(x) for x in c] for c in trained.model.clusterCenters()]
        x = vector_to_array(prepare.FEATURES)
        away = F.array(*[sum(((x[i] - v) * (x[i] - v) for i, v in enumerate(c)), F.lit(0.0)) for c in centres])
        far = trained.predictions.select(away.alias("away"), "prediction")
        own = F.element_at("away", F.col("prediction") + 1)
        return small_frame(spark, [far.agg(
            F.count_distinct("prediction").alias("n_clusters"), F.count("*").alias("n"),
            F.bool_and(own <= F.array_min("away") + 1e-9).alias("nearest_centres"),
            (F.abs(F.sum(own) / trained.metrics.first()["inertia"] - 1) < 1e-6).alias("cost_is_inertia")).first().asDict()],
            "n_clusters bigint, n bigint, nearest_centres boolean, cost_is_inertia boolean")


@query("ml_dbscan", """
    WITH RECURSIVE z AS MATERIALIZED (SELECT c_custkey AS id, (c_acctbal - avg(c_acctbal) OVER ()) / stddev_pop(c_acctbal) OVER () AS x,
                                             (c_nationkey - avg(c_nationkey) OVER ()) / stddev_pop(c_nationkey) OVER () AS y FROM customer),
    near AS MATERIALIZED (SELECT a.id AS a, b.id AS b FROM z a JOIN z b ON b.x BETWEEN a.x - 0.1 AND a.x + 0.1 AND (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) <= 0.01),
    core AS MATERIALIZED (SELECT a AS id FROM near GROUP BY a HAVING count(*) >= 5),
    link AS MATERIALIZED (SELECT a, b FROM near WHERE a IN (SELECT id FROM core) AND b IN (SELECT id FROM core)),
    reach(a, b) AS (SELECT a, b FROM link UNION SELECT r.a, l.b FROM reach r JOIN link l ON r.b = l.a),
    root AS (SELECT a AS id, min(b) AS root FROM reach GROUP BY a)
    SELECT (SELECT count(DISTINCT root) FROM root) AS n_clusters, (SELECT count(*) FROM z) AS n,
           (SELECT count(*) FROM z WHERE id NOT IN (SELECT a FROM near WHERE b IN (SELECT id FROM core))) AS n_noise""")
def ml_dbscan(spark, folder):
    with engine.ModelBench(read(spark, folder, "customer"), None, "clustering", ["c_acctbal", "c_nationkey"]) as bench:
        clustered = bench.train("dbscan", eps=0.1, min_samples=5).predictions
        row = clustered.agg(F.count_distinct(F.when(F.col("prediction") >= 0, F.col("prediction"))).alias("n_clusters"),
                            F.count("*").alias("n"), F.count_if(F.col("prediction") < 0).alias("n_noise")).first().asDict()
    return small_frame(spark, [row], "n_clusters bigint, n bigint, n_noise bigint")


# A step of the line number, discount and tax is 0.50, 0.34 and 0.43 deviations. So within 0.4 there are at most 0, 1 and 0 steps,
# which lets SQL find neighbours by equality, over all eight columns, before it measures them.
WIDE = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax"]


@query("ml_dbscan_wide", f"""
    WITH RECURSIVE z AS MATERIALIZED (SELECT row_number() OVER () AS id, l_linenumber AS s, CAST(round(l_discount * 100) AS INT) AS t, CAST(round(l_tax * 100) AS INT) AS u,
        {", ".join(f"(CAST({c} AS DOUBLE) - avg({c}) OVER ()) / stddev_pop({c}) OVER () AS {c}" for c in WIDE)} FROM lineitem),
    step AS (SELECT j FROM range(-1, 2) b(j)),
    near AS MATERIALIZED (SELECT a.id AS a, b.id AS b FROM (SELECT z.*, t + j AS tj FROM z, step) a JOIN z b ON a.s = b.s AND a.tj = b.t AND a.u = b.u
        AND {" + ".join(f"(a.{c} - b.{c}) * (a.{c} - b.{c})" for c in WIDE)} <= 0.4 * 0.4::DOUBLE),
    core AS MATERIALIZED (SELECT a AS id FROM near GROUP BY a HAVING count(*) >= 2),
    link AS MATERIALIZED (SELECT a, b FROM near WHERE a IN (SELECT id FROM core) AND b IN (SELECT id FROM core)),
    reach(a, b) AS (SELECT a, b FROM link UNION SELECT r.a, l.b FROM reach r JOIN link l ON r.b = l.a),
    root AS (SELECT a AS id, min(b) AS root FROM reach GROUP BY a)
    SELECT (SELECT count(DISTINCT root) FROM root) AS n_clusters, (SELECT count(*) FROM z) AS n,
           (SELECT count(*) FROM z WHERE id NOT IN (SELECT a FROM near WHERE b IN (SELECT id FROM core))) AS n_noise,
           (SELECT max(n) FROM (SELECT count(*) AS n FROM root GROUP BY root)) AS largest""")
def ml_dbscan_wide(spark, folder):
    """All eight numeric columns. The largest cluster is measured by its core rows, as border rows may have a choice."""
    table = read(spark, folder, "lineitem").select(*WIDE)
    row = table.agg(*[f(c).alias(f"{f.__name__}_{c}") for c in WIDE for f in (F.avg, F.stddev_pop)]).first()
    scaled = table.select(*[((F.col(c).cast("double") - row[f"avg_{c}"]) / row[f"stddev_pop_{c}"]).alias(c) for c in WIDE])
    clustered = density.dbscan(scaled, WIDE, eps=0.4, min_samples=2, core_column="core")
    sizes = clustered.groupBy("prediction").agg(F.count("*").alias("rows"), F.count_if("core").alias("cores"))
    return sizes.agg(F.count_if(F.col("prediction") >= 0).alias("n_clusters"), F.sum("rows").alias("n"),
                     F.coalesce(F.sum(F.when(F.col("prediction") < 0, F.col("rows"))), F.lit(0)).alias("n_noise"),
                     F.max(F.when(F.col("prediction") >= 0, F.col("cores"))).alias("largest"))


@query("ml_model_select", given(P) + f"""
    SELECT 'Decision Tree' AS asked, 'decision_tree' AS model_type, 'DecisionTreeClassificationModel' AS class_name, {N_TEST} AS n_test
    UNION ALL SELECT 'Naive Bayes', 'naive_bayes', 'NaiveBayesModel', {N_TEST}""")
def ml_model_select(spark, folder):
    rows = []
    with _bench(spark, folder, "classification") as bench:
        for asked in ("Decision Tree", "Naive Bayes"):
            trained = bench.train(asked)
            rows.append({"asked": asked, "model_type": trained.name, "class_name": type(trained.model).__name__,
                         "n_test": trained.predictions.count()})
    return small_frame(spark, rows, "asked string, model_type string, class_name string, n_test bigint")


LABELLED = """SELECT CAST(CASE l_returnflag WHEN 'A' THEN 0 WHEN 'N' THEN 1 ELSE 2 END AS DOUBLE) AS label,
    CAST(CASE WHEN l_linestatus = 'F' THEN 0 WHEN l_quantity < 20 THEN 1 WHEN l_quantity < 45 THEN 2 ELSE 3 END AS DOUBLE) AS prediction FROM {lineitem}"""


@query("ml_metrics_cls", f"""
    WITH p AS ({LABELLED.format(lineitem="lineitem")}),
    per AS (SELECT label, count(*) AS support, count(*) FILTER (label = prediction) AS hits, (SELECT count(*) FROM p q WHERE q.prediction = p.label) AS predicted FROM p GROUP BY label),
    scored AS (SELECT support, hits, CASE WHEN predicted > 0 THEN hits * 1.0::DOUBLE / predicted ELSE 0 END AS pr, hits * 1.0::DOUBLE / support AS re FROM per)
    SELECT {r("sum(hits) * 1.0::DOUBLE / sum(support)", 6)} AS accuracy, {r("sum(pr * support) / sum(support)", 6)} AS precision, {r("sum(re * support) / sum(support)", 6)} AS recall,
           {r("sum(CASE WHEN pr + re > 0 THEN 2 * pr * re / (pr + re) ELSE 0 END * support) / sum(support)", 6)} AS f1_score FROM scored""")
def ml_metrics_cls(spark, folder):
    predictions = spark.sql(LABELLED, lineitem=read(spark, folder, "lineitem"))
    return rounded(metrics.classification_metrics(predictions), 6)


@query("ml_metrics_reg", f"""
    SELECT {r("avg(e * e) / 1e6", 4)} AS mse_millions, {r("sqrt(avg(e * e))", 4)} AS rmse, {r("1 - avg(e * e) / var_pop(y)", 6)} AS r2, {r("avg(abs(e))", 4)} AS mae
    FROM (SELECT l_extendedprice AS y, l_extendedprice - l_quantity * 2100 AS e FROM lineitem)""")
def ml_metrics_reg(spark, folder):
    predictions = read(spark, folder, "lineitem").selectExpr("l_extendedprice AS label", "l_quantity * 2100 AS prediction")
    scored = metrics.regression_metrics(predictions)
    return rounded(scored.select((F.col("mse") / 1e6).alias("mse_millions"), "rmse", "r2", "mae"), 4, r2=6)


@query("ml_importance", "SELECT CAST(5 AS BIGINT) AS n_features, true AS in_order, 1.0::DOUBLE AS total")
def ml_importance(spark, folder):
    with _bench(spark, folder, "regression") as bench:
        rows = bench.train("decision_tree").importance.orderBy("rank").collect()
    weights = [r["importance"] for r in rows]
    return small_frame(spark, [{"n_features": len({r["feature"] for r in rows}), "in_order": weights == sorted(weights, reverse=True),
                                "total": round(sum(weights), 9)}], "n_features bigint, in_order boolean, total double")


def _least_squares(k):
    """Steps that make the features of `base` orthogonal on the train part one by one, and then fit y."""
    steps, e = [], [f"e{i}" for i in range(1, k + 1)]
    centred = ", ".join(f"x{i} - (SELECT avg(x{i}) FROM base WHERE NOT test) AS x{i}" for i in range(1, k + 1))
    steps.append(f"step0 AS MATERIALIZED (SELECT {centred}, y - (SELECT avg(y) FROM base WHERE NOT test) AS yc, y, test FROM base)")
    share = lambda v, u, t: f"(SELECT sum({v} * {u}) / sum({u} * {u}) FROM {t} WHERE NOT test)"
    for i in range(1, k + 1):
        before = f"step{i - 1}"
        rest = "".join(f" - {u} * {share(f'x{i}', u, before)}" for u in e[:i - 1])
        steps.append(f"step{i} AS MATERIALIZED (SELECT *, x{i}{rest} AS e{i} FROM {before})")
    guess = " + ".join(f"{u} * {share('yc', u, f'step{k}')}" for u in e)
    steps.append(f"fit AS (SELECT y, yc - ({guess}) AS err FROM step{k} WHERE test)")
    return ", ".join(steps)


@query("ml_train", given(P) + f""", base AS MATERIALIZED ({BASE_REG}), {_least_squares(5)}
    SELECT 'linear_regression' AS model_type, {r("avg(err * err)", 3)} AS mse, {r("sqrt(avg(err * err))", 4)} AS rmse,
           {r("1 - avg(err * err) / var_pop(y)", 6)} AS r2, {r("avg(abs(err))", 4)} AS mae, true AS timed FROM fit""")
def ml_train(spark, folder):
    with _bench(spark, folder, "regression") as bench:
        trained = bench.train("Linear Regression")
        found = trained.metrics.first().asDict()
    frame = small_frame(spark, [found], "mse double, rmse double, r2 double, mae double")
    return rounded(frame, 4, mse=3, r2=6).select(F.lit(trained.name).alias("model_type"), "mse", "rmse", "r2", "mae",
                                                 F.lit(trained.training_seconds > 0).alias("timed"))


@query("ml_compare", """
    SELECT CAST(4 AS BIGINT) AS n_models, CAST(1 AS BIGINT) AS n_failed, true AS failed_last, true AS in_order, true AS one_best, true AS has_reason, true AS has_metrics""")
def ml_compare(spark, folder):
    with _bench(spark, folder, "classification") as bench:
        rows = bench.compare(["logistic_regression", "no such model", "decision_tree", "naive_bayes"]).orderBy("rank").collect()
    good = [r for r in rows if r["error"] is None]
    scores = [r["score"] for r in good]
    return small_frame(spark, [{
        "n_models": len(rows), "n_failed": len(rows) - len(good), "failed_last": rows[-1]["error"] is not None,
        "in_order": scores == sorted(scores, reverse=True), "one_best": [r["is_best"] for r in rows] == [True, False, False, False],
        "has_reason": "accuracy" in rows[0]["reason"], "has_metrics": all('"accuracy"' in r["metrics"] for r in good)}],
        "n_models bigint, n_failed bigint, failed_last boolean, in_order boolean, one_best boolean, has_reason boolean, has_metrics boolean")


@query("ml_predict", given(P) + f"""
    SELECT price_class, count(*) AS n, count(*) AS n_predicted, true AS gaps_are_medians FROM {P} GROUP BY price_class""")
def ml_predict(spark, folder):
    bench = _bench(spark, folder, "classification")  # left open: the result is lazy and reads what the bench wrote
    trained = bench.train("decision_tree")
    new = read(spark, folder, P).withColumn("p_type", F.when(F.col("p_partkey") % 2 == 0, "UNSEEN").otherwise(F.col("p_type")))
    filled = new.withColumn("p_size", F.coalesce(F.col("p_size").cast("double"), F.lit(new.agg(F.median("p_size")).first()[0])))
    found = [bench.predict(trained, df.withColumn("id", F.col("p_partkey"))).select("id", "price_class", "prediction") for df in (new, filled)]
    both = found[0].join(found[1].select("id", F.col("prediction").alias("again")), "id")
    return both.groupBy("price_class").agg(F.count("*").alias("n"), F.count("prediction").alias("n_predicted"),
                                           F.bool_and(F.col("prediction") == F.col("again")).alias("gaps_are_medians"))


@query("ml_test_data", given(P) + f"SELECT x1 AS p_partkey, x2 AS p_brand, x3 AS p_type, x4 AS p_size, x5 AS price_class, y AS p_retailprice FROM ({BASE_REG}) WHERE test")
def ml_test_data(spark, folder):
    return _bench(spark, folder, "regression").test_data()
