"""Steps on tiny tables: nulls, ties, constants, unseen values; fit on one table, apply to another."""

import json
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tablesmith.functions.moments import central_moments, correlations
from tablesmith.functions.numbers import chi2_pvalue, parse_double
from tablesmith.operators.charts import density, line_points
from tablesmith.operators.correlate import vif_table
from tablesmith.operators.select import chi2_scores
from tablesmith.operators.text import lemmatize
from tablesmith.plans.step import METHODS, FittedWorkflow, Step, Workflow, apply_step, fit_step


def col(df, name, key="id"):
    return [r[name] for r in df.orderBy(key).collect()]


@pytest.fixture(scope="module")
def small(spark):
    rows = [(1, 1.0, "a", 10), (2, None, "b", 20), (3, 3.0, None, 30), (4, 4.0, "b", 40), (5, 100.0, "c", 50)]
    return spark.createDataFrame(rows, "id long, x double, c string, y long")


def test_simple_imputation(small):
    assert col(apply_step(small, Step("impute_missing", ["x"], "mean")), "x")[1] == 27.0
    assert col(apply_step(small, Step("impute_missing", ["x"], "median")), "x")[1] == 3.5
    assert col(apply_step(small, Step("impute_missing", ["c"], "mode")), "c")[2] == "b"
    assert col(apply_step(small, Step("impute_missing", ["x"], "constant")), "x")[1] == 0.0
    assert col(apply_step(small, Step("impute_missing", ["c"], "new_category")), "c")[2] == "Missing"


def test_mode_takes_the_smallest_on_ties(spark):
    df = spark.createDataFrame([(1, "b"), (2, "a"), (3, "a"), (4, "b"), (5, None)], "id long, c string")
    assert col(apply_step(df, Step("impute_missing", ["c"], "mode")), "c")[4] == "a"


def test_numeric_steps_refuse_text(small):
    for step in (Step("impute_missing", ["c"], "mean"), Step("binning", ["c"], "equal_width"), Step("scale", ["c"], "standard")):
        with pytest.raises(ValueError):
            apply_step(small, step)
    with pytest.raises(ValueError):
        apply_step(small, Step("impute_missing", ["nope"], "mean"))
    with pytest.raises(ValueError):
        apply_step(small, Step("impute_missing", ["x"], "nope"))
    with pytest.raises(ValueError):
        apply_step(small, Step("impute_missing", ["x"], "forward_fill"))


def test_outliers_keep_or_drop_nulls(small):
    removed = apply_step(small, Step("handle_outliers", ["x"], "remove"))
    assert col(removed, "id") == [1, 3, 4]
    capped = apply_step(small, Step("handle_outliers", ["x"], "winsorize"))
    # quartiles of 1, 3, 4, 100 are 2.5 and 28
    assert col(capped, "x") == [1.0, None, 3.0, 4.0, 28.0 + 1.5 * 25.5]
    z = apply_step(small, Step("handle_outliers", ["x"], "zscore", {"threshold": 1.5}))
    assert col(z, "id") == [1, 3, 4]


def test_transforms(spark):
    df = spark.createDataFrame([(1, -4.0), (2, 0.0), (3, 5.0), (4, None)], "id long, x double")
    assert col(apply_step(df, Step("transform", ["x"], "log")), "x")[0] == 0.0
    assert col(apply_step(df, Step("transform", ["x"], "sqrt")), "x") == [0.0, 2.0, 3.0, None]
    assert col(apply_step(df, Step("transform", ["x"], "reciprocal")), "x") == [-0.25, None, 0.2, None]
    assert col(apply_step(df, Step("transform", ["x"], "cube")), "x") == [-64.0, 0.0, 125.0, None]


def test_power_transforms_find_the_log(spark):
    df = spark.createDataFrame([(i, float(2.718281828 ** ((i - 50) / 10))) for i in range(101)], "id long, x double")
    assert abs(fit_step(df, Step("transform", ["x"], "box-cox")).params["lambda"]) < 1e-3
    same = spark.createDataFrame([(i, float(i - 50)) for i in range(101)], "id long, x double")
    assert fit_step(same, Step("transform", ["x"], "yeo-johnson")).params["lambda"] == pytest.approx(1.0, abs=1e-3)


def test_number_texts(spark):
    texts = ["1d", "1_000", " 7 ", "NaN", "inf", "", "1e3", ".5", "+3", "-2.", "x", None]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id long, t string")
    got = col(df.select("id", parse_double(F.col("t")).alias("v")), "v")
    assert got == [None, None, 7.0, None, None, None, 1000.0, 0.5, 3.0, -2.0, None, None]


def test_types(spark):
    df = spark.createDataFrame([(1, "Yes"), (2, "0"), (3, "2024-01-05 10:00:00"), (4, "maybe")], "id long, t string")
    assert col(apply_step(df, Step("convert_type", ["t"], "to_boolean")), "t") == [True, False, None, None]
    assert [v is not None for v in col(apply_step(df, Step("convert_type", ["t"], "to_datetime")), "t")] == [False, False, True, False]
    assert dict(apply_step(df, Step("convert_type", ["id"], "to_categorical")).dtypes)["id"] == "string"


def test_group_rare(spark):
    df = spark.createDataFrame([(i, "a" if i < 8 else "b" if i < 9 else None) for i in range(10)], "id long, c string")
    out = col(apply_step(df, Step("reduce_cardinality", ["c"], "group_rare", {"threshold": 0.2})), "c")
    assert out == ["a"] * 8 + ["Other", None]


def test_bins_are_right_closed(spark):
    df = spark.createDataFrame([(1, 0.0), (2, 2.0), (3, 4.0), (4, 10.0), (5, None)], "id long, x double")
    assert col(apply_step(df, Step("binning", ["x"], "equal_width", {"n_bins": 5})), "x_bin_index") == [1, 1, 2, 5, None]
    custom = apply_step(df, Step("binning", ["x"], "custom", {"bin_edges": [0, 2, 9]}))
    assert col(custom, "x_binned") == ["Bin 1", "Bin 1", "Bin 2", None, None]
    ties = spark.createDataFrame([(i, 1.0 if i < 8 else float(i)) for i in range(10)], "id long, x double")
    assert col(apply_step(ties, Step("binning", ["x"], "equal_frequency", {"n_bins": 5})), "x_bin_index") == [1] * 8 + [2, 2]
    same = spark.createDataFrame([(1, 3.0), (2, 3.0)], "id long, x double")
    assert col(apply_step(same, Step("binning", ["x"], "equal_width")), "x_bin_index") == [1, 1]


def test_encodings(small):
    label = apply_step(small, Step("encode", ["c"], "label", order_by=["id"]))
    assert col(label, "c") == [0, 1, 2, 1, 3]
    onehot = apply_step(small, Step("encode", ["c"], "onehot"))
    assert onehot.columns == ["id", "x", "y", "c_a", "c_b", "c_c"] and col(onehot, "c_b") == [False, True, False, True, False]
    with pytest.raises(ValueError):
        apply_step(small, Step("encode", ["c"], "onehot", {"max_values": 2}))
    target = apply_step(small, Step("encode", ["c"], "target", {"target_column": "y"}))
    assert col(target, "c_target_encoded") == [10.0, 30.0, 30.0, 30.0, 50.0]
    assert col(apply_step(small, Step("encode", ["c"], "frequency")), "c_freq_encoded") == [0.25, 0.5, None, 0.5, 0.25]
    binary = apply_step(small, Step("encode", ["c"], "binary", order_by=["id"]))
    assert [(r["c_bin_0"], r["c_bin_1"]) for r in binary.orderBy("id").collect()] == [(0, 1), (1, 0), (0, 0), (1, 0), (1, 1)]
    ordinal = apply_step(small, Step("encode", ["c"], "ordinal", {"order": ["c", "b"]}))
    assert col(ordinal, "c_ordinal") == [2, 1, None, 1, 0]
    helmert = apply_step(small, Step("encode", ["c"], "helmert"))
    assert [(r["c_helmert_0"], r["c_helmert_1"]) for r in helmert.orderBy("id").collect()] == [(-1, -1), (1, -1), (None, None), (1, -1), (0, 2)]


def test_scaling_of_a_constant(spark):
    df = spark.createDataFrame([(1, 5.0), (2, 5.0)], "id long, x double")
    for method in ("standard", "minmax", "robust", "power"):
        assert col(apply_step(df, Step("scale", ["x"], method)), "x") == [0.0, 0.0], method


def test_correlation_guards(spark):
    rows = [(1.0, 2.0, 1.0, None), (2.0, 4.0, 1.0, 3.0), (3.0, 6.1, 1.0, 3.0), (None, 8.0, 1.0, 9.0)]
    df = spark.createDataFrame(rows, "a double, b double, k double, n double")
    r = correlations(df, ["a", "b", "k", "n"])
    pdf = df.toPandas()
    assert r[("a", "b")] == pytest.approx(pdf["a"].corr(pdf["b"])) and r[("b", "n")] == pytest.approx(pdf["b"].corr(pdf["n"]))
    assert r[("a", "k")] is None and r[("a", "n")] is None
    line = spark.createDataFrame([(float(i), 2.0 * i, float(i * i % 7)) for i in range(20)], "a double, b double, c double")
    vif = {x["column"]: x["vif"] for x in vif_table(line).collect()}
    assert vif["a"] == vif["b"] == float("inf") and vif["c"] < 2
    left = apply_step(line, Step("handle_correlation", ["a", "b", "c"], "vif", {"max_vif": 5}))
    assert len(left.columns) == 2 and "c" in left.columns


def test_moments_match_pandas(spark):
    df = spark.createDataFrame([(float(i % 13) ** 2 + 1e6,) for i in range(200)], "x double").repartition(3)
    m, s = central_moments(df, ["x"])["x"], df.toPandas()["x"]
    assert m["std"] == pytest.approx(s.std()) and m["skew"] == pytest.approx(s.skew()) and m["kurtosis"] == pytest.approx(s.kurt())
    few = central_moments(df.limit(1), ["x"])["x"]
    assert few["std"] is None and few["skew"] is None


def test_dedup_keeps_nulls_equal(spark):
    df = spark.createDataFrame([(1, None), (1, None), (2, "x")], "a long, b string")
    assert apply_step(df, Step("remove_duplicates", method="all_columns")).count() == 2


def test_lemmatize(spark, monkeypatch):
    df = spark.createDataFrame([(1, "Two  feet and feet"), (2, None), (3, "")], "id long, t string")
    words = spark.createDataFrame([("feet", "foot")], "word string, lemma string")
    for rows in (10_000, 0):  # broadcast and shuffle
        monkeypatch.setattr("tablesmith.session.SMALL_TABLE_ROWS", rows)
        assert col(lemmatize(df, "t", "id", words), "t_lemmatized") == ["two foot and foot", None, ""]
    with pytest.raises(ValueError):
        lemmatize(df, "t", "", words)


def test_streams_refuse_steps_that_compare_rows(spark):
    from tablesmith.streaming import transform_stream

    df = spark.createDataFrame([(1, 1.0), (2, None)], "id long, x double")
    fitted = Workflow([Step("impute_missing", ["x"], "mean")]).fit(df)
    assert col(transform_stream(df, fitted), "x") == [1.0, 1.0]
    with pytest.raises(ValueError):
        transform_stream(df, FittedWorkflow([Step("impute_missing", ["x"], "knn", key="id")], fitted.fitted))


# ---- workflows

STEPS = [
    Step("impute_missing", ["x"], "mean"),
    Step("impute_missing", ["c"], "mode"),
    Step("encode", ["c"], "target", {"target_column": "y"}),
    Step("scale", ["x"], "minmax"),
]


def test_fit_here_apply_there(spark, small):
    other = spark.createDataFrame([(1, None, "zz", 1), (2, 100.0, "a", 2)], "id long, x double, c string, y long")
    out = Workflow(STEPS).fit(small).transform(other)
    assert col(out, "x") == [26.0 / 99.0, 1.0]
    assert col(out, "c_target_encoded") == [30.0, 10.0]


def test_json_and_saved_workflow_give_the_same(spark, small, tmp_path):
    flow = Workflow.from_json(Workflow(STEPS).to_json(dataset="small"))
    assert flow.steps == STEPS
    fitted = flow.fit(small)
    fitted.save(spark, str(tmp_path / "flow"))
    loaded = FittedWorkflow.load(spark, str(tmp_path / "flow"))
    assert loaded.transform(small).orderBy("id").collect() == fitted.transform(small).orderBy("id").collect()


def test_skip_reports_the_failed_step(small):
    steps = [Step("impute_missing", ["c"], "mean"), Step("impute_missing", ["x"], "mean")]
    with pytest.raises(ValueError):
        Workflow(steps).fit(small)
    fitted = Workflow(steps).fit(small, on_error="skip")
    assert [s.columns for s in fitted.steps] == [("x",)]
    notes = [r["fitted"] for r in fitted.audit(small).collect()]
    assert any(n.startswith("skipped") for n in notes) and any(json.loads(n) == {"x": 27.0} for n in notes if not n.startswith("skipped"))


def test_every_catalog_method_is_registered():
    from tablesmith import operators  # noqa: F401

    catalog = {
        "impute_missing": "mean median mode constant knn new_category forward_fill backward_fill interpolate",
        "remove_duplicates": "all_columns subset keep_first keep_last",
        "handle_outliers": "remove winsorize transform zscore iqr",
        "transform": "log sqrt box-cox yeo-johnson reciprocal square cube",
        "convert_type": "to_numeric to_categorical to_datetime to_boolean",
        "reduce_cardinality": "group_rare kmeans_clustering hierarchical_clustering",
        "encode": "label onehot target frequency binary ordinal helmert count",
        "scale": "standard minmax robust maxabs quantile power",
        "handle_correlation": "drop_one pca vif",
        "binning": "equal_width equal_frequency kmeans custom",
        "feature_interaction": "multiplication addition subtraction division polynomial",
        "dimensionality_reduction": "pca lda",
        "feature_selection": "correlation chi2 rfe lasso random_forest",
        "handle_imbalance": "smote adasyn random_undersampling class_weights",
        "time_features": "date_parts time_parts cyclical holidays lag_features",
        "text_processing": "tokenize stopwords stemming lemmatization tfidf word_embeddings",
    }
    missing = [(s, m) for s, ms in catalog.items() for m in ms.split() if (s, m) not in METHODS]
    assert not missing and ("drop_column", "") in METHODS


def test_fitted_steps_run_on_a_stream(spark, small, tmp_path):
    from tablesmith.streaming import transform_stream

    path = str(tmp_path / "in")
    small.write.parquet(path)
    fitted = Workflow(STEPS).fit(small)
    stream = spark.readStream.schema(small.schema).parquet(path)
    q = transform_stream(stream, fitted).writeStream.format("memory").queryName("stepped").start()
    q.processAllAvailable()
    q.stop()
    assert spark.table("stepped").orderBy("id").collect() == fitted.transform(small).orderBy("id").collect()
    with pytest.raises(ValueError):
        transform_stream(stream, Workflow([Step("remove_duplicates", method="all_columns")]).fit(small))


def test_fused_steps_see_what_earlier_ones_wrote(spark):
    """A neighbour step reads columns that only its parameters name."""
    rows = [(1, 1.0, 10.0), (2, None, 20.0), (3, 3.0, None), (4, 100.0, 40.0), (5, 2.0, 50.0)]
    df = spark.createDataFrame(rows, "id long, a double, b double")
    pairs = [
        [Step("impute_missing", ["a"], "median"), Step("impute_missing", ["b"], "knn", {"features": ["a"], "n_neighbors": 1}, key="id")],
        [Step("impute_missing", ["a"], "mean"), Step("scale", ["a"], "standard")],
        [Step("handle_outliers", ["a"], "winsorize"), Step("scale", ["b"], "minmax")],
        [Step("impute_missing", ["a"], "mean"), Step("interact", ["a", "b"], "multiply")],
        [Step("handle_outliers", ["a"], "remove"), Step("impute_missing", ["b"], "mean")],
    ]
    for steps in pairs:
        try:
            want = df
            for s in steps:
                want = apply_step(want, s)
        except ValueError as e:
            if "unknown" not in str(e):
                raise
            continue
        got = Workflow(steps).fit(df).transform(df, training=True)
        assert sorted(map(str, got.collect())) == sorted(map(str, want.collect())), steps


def test_transform_of_a_test_table_keeps_its_rows(spark):
    train = spark.createDataFrame([(i, float(i % 9), "ab"[i % 5 == 0]) for i in range(60)] + [(60, 900.0, "a"), (61, 3.0, "a"), (61, 3.0, "a")], "id long, x double, c string")
    test = spark.createDataFrame([(1, 5000.0, "a"), (2, 1.0, "b"), (2, 1.0, "b")], "id long, x double, c string")
    steps = [
        Step("remove_duplicates", method="all_columns"),
        Step("handle_outliers", ["x"], "remove"),
        Step("handle_imbalance", ["c"], "random_undersampling", key="id"),
        Step("scale", ["x"], "minmax"),
    ]
    fitted = Workflow(steps).fit(train)
    assert col(fitted.transform(test).orderBy("id"), "x") == [625.0, 0.125, 0.125]  # scaled by what was left of the training table
    assert fitted.transform(test, training=True).count() < 3
    assert fitted.transform(train, training=True).agg(F.max("x")).first()[0] == 1.0
    got = {r["method"]: r["affected"] for r in fitted.audit(train).collect()}
    assert got["all_columns"] == 1 and got["remove"] == 1 and got["random_undersampling"] == 61 - 24


def test_audit_counts_each_step_on_what_the_one_before_left(spark):
    df = spark.createDataFrame([(i, None if i % 4 == 0 else float(i)) for i in range(100)] + [(200, 9999.0)], "id long, x double")
    steps = [Step("handle_outliers", ["x"], "winsorize"), Step("impute_missing", ["x"], "median"), Step("impute_missing", ["x"], "mean"), Step("transform", ["x"], "log")]
    fitted = Workflow(steps).fit(df)
    sc = spark.sparkContext
    sc.setJobGroup("audit", "audit")
    audit = fitted.audit(df)
    jobs = len(sc.statusTracker().getJobIdsForGroup("audit"))
    sc.setLocalProperty("spark.jobGroup.id", None)
    assert [r["affected"] for r in audit.orderBy("step_no").collect()] == [1, 25, 0, 101]
    assert jobs == 1
    assert [r["affected"] for r in fitted.audit(df.where("id < 0")).orderBy("step_no").collect()] == [0, 0, 0, 0]


def test_embeddings_are_fitted_state(spark, tmp_path):
    texts = ["the cat sat on the mat", "the dog sat", "a cat and a dog", "", None, "unseen words only"]
    train = spark.createDataFrame([(i, t) for i, t in enumerate(texts[:5] * 6)], "id long, t string")
    test = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id long, t string")
    fitted = Workflow([Step("text_processing", ["t"], "word_embeddings", {"size": 4, "min_count": 2}, key="id")]).fit(train)
    a, b = col(fitted.transform(train).where("id < 5"), "t_embedding"), col(fitted.transform(test), "t_embedding")
    assert a == b[:5] and b[3:] == [[0.0] * 4] * 3 and any(b[0])
    vectors = {r["_word"]: r["vector"] for r in fitted.fitted[0].tables["vectors"].collect()}
    words = texts[0].split()
    assert b[0] == pytest.approx([sum(vectors[w][i] for w in words) / len(words) for i in range(4)])
    fitted.save(spark, str(tmp_path / "flow"))
    assert col(FittedWorkflow.load(spark, str(tmp_path / "flow")).transform(test), "t_embedding") == b
    with pytest.raises(ValueError):
        Workflow([Step("text_processing", ["t"], "word_embeddings")]).fit(train)


@pytest.fixture
def large_tables(spark, monkeypatch):
    """Mappings beyond a broadcast, joins by shuffle, partitions as they are dealt."""
    import tablesmith.session as session

    monkeypatch.setattr(session, "SMALL_TABLE_ROWS", 300)
    own = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.adaptive.skewJoin.enabled": "false"}
    for k, v in own.items():
        spark.conf.set(k, v)
    yield
    for k in own:
        spark.conf.unset(k)


@pytest.mark.parametrize("hot", ["v7", None])
def test_hot_keys_of_a_large_mapping_are_spread(spark, large_tables, hot):
    n = 40_000
    value = F.when(F.col("id") % 10 > 0, F.lit(hot)).otherwise(F.concat(F.lit("v"), (F.col("id") % 9000).cast("string")))
    df = spark.range(n).repartition(6).select("id", value.alias("c"), (F.col("id") % 5).cast("double").alias("y"))
    steps = [Step("encode", ["c"], "frequency"), Step("encode", ["c"], "target", {"target_column": "y"})]
    fitted = Workflow(steps).fit(df)
    assert all(len(f.tables) == 2 for f in fitted.fitted)
    out = fitted.transform(df)
    sizes = sorted(r[1] for r in out.groupBy(F.spark_partition_id()).count().collect())
    assert sizes[-1] <= 2 * sizes[len(sizes) // 2] and len(sizes) == 8
    rows = [(r["id"], r["c"], r["y"]) for r in df.collect()]
    known = [c for _, c, _ in rows if c is not None]
    counts, sums = Counter(known), Counter()
    for _, c, y in rows:
        sums[c] += y
    mean = sum(y for _, _, y in rows) / n
    got = {r["id"]: r for r in out.collect()}
    assert len(got) == n
    for i, c, _ in rows:
        want = (None, mean) if c is None else (counts[c] / len(known), sums[c] / counts[c])
        assert (got[i]["c_freq_encoded"], got[i]["c_target_encoded"]) == (want[0], pytest.approx(want[1]))


def test_lemmas_and_vectors_of_a_large_lexicon(spark, large_tables):
    from tablesmith.operators.text import lemmatize, mean_vectors, vector_tables

    df = spark.range(2000).select(F.col("id"), F.concat_ws(" ", F.lit("the Was"), F.concat(F.lit("w"), (F.col("id") % 900).cast("string"))).alias("t"))
    lexicon = spark.range(900).select(F.concat(F.lit("w"), "id").alias("word"), F.concat(F.lit("l"), "id").alias("lemma")).union(spark.createDataFrame([("was", "be")], "a string, b string"))
    got = {r["id"]: r["t_lemmatized"] for r in lemmatize(df, "t", "id", lexicon).collect()}
    assert got == {i: f"the be l{i % 900}" for i in range(2000)}
    vectors = lexicon.select("word", F.array(F.length("word").cast("double"), F.lit(1.0)).alias("vector"))
    got = {r["id"]: r["t_embedding"] for r in mean_vectors(df, "t", "id", vector_tables(df, "t", vectors), 2).collect()}
    assert got == {i: [(3 + len(f"w{i % 900}")) / 2, 1.0] for i in range(2000)}


def test_chi2_pvalues(spark):
    # exact upper tails: dof, value, chance
    known = [(1, 3.841458820694124, 0.05), (1, 10.0, 0.001565402258002549), (2, 5.991464547107979, 0.05), (3, 7.814727903251179, 0.05), (4, 0.0, 1.0), (5, 1.145476226061769, 0.95), (10, 18.307038053275146, 0.05), (99, 123.2252214533618, 0.05), (1, 0.001, 0.9747728793699604), (1, 200.0, 2.0884875837625446e-45), (30, 3000.0, 0.0)]
    df = spark.createDataFrame([(i, *k) for i, k in enumerate(known)], "id int, dof long, x double, p double")
    got = [r[0] for r in df.select(chi2_pvalue(F.col("x"), F.col("dof")), "id").orderBy("id").collect()]
    assert got == pytest.approx([p for *_, p in known], rel=1e-9, abs=1e-300)
    rows = [(i, "xy"[i % 2], "abc"[i % 3], "pq"[(i // 2) % 2]) for i in range(200)] + [(900, None, "a", "p"), (901, "x", "a", None)]
    out = {r["feature"]: r for r in chi2_scores(spark.createDataFrame(rows, "id long, a string, b string, y string"), ["a", "b"], "y").collect()}
    assert out["a"]["dof"] == 1 and out["b"]["dof"] == 2 and all(0 <= r["p_value"] <= 1 for r in out.values())


def test_line_of_four_points_a_column(spark):
    rnd = random.Random(3)
    rows = [(i, rnd.choice([0.0, 1.0, rnd.uniform(0, 10)]), rnd.choice([rnd.gauss(0, 3), 2.0]), rnd.choice("ab")) for i in range(400)] + [(900, None, 1.0, "a"), (901, 3.0, None, "b")]
    df = spark.createDataFrame(rows, "id long, x double, y double, g string").repartition(4)
    got = {(r["group"], r["column"]): r for r in line_points(df, "x", "y", "g", 16).collect()}
    known = [(x, y, g) for _, x, y, g in rows if x is not None and y is not None]
    lo, hi = min(k[0] for k in known), max(k[0] for k in known)
    want = {}
    for x, y, g in known:
        want.setdefault((g, min(int((x - lo) / ((hi - lo) / 16)), 15)), []).append((x, y))
    assert set(got) == set(want)
    for k, points in want.items():
        r, low, high = got[k], min((y, x) for x, y in points), max((y, x) for x, y in points)
        assert (r["n"], (r["x_first"], r["y_first"]), (r["x_last"], r["y_last"])) == (len(points), min(points), max(points))
        assert ((r["y_low"], r["x_low"]), (r["y_high"], r["x_high"])) == (low, high)
    assert line_points(df.where("id < 0"), "x", "y").collect() == []
    assert line_points(df.where("x = 1.0"), "x", "y").count() == 1


@pytest.mark.parametrize("far", [0.0, 4000.0])
def test_density_equals_the_sum_of_kernels(spark, far):
    rnd = np.random.default_rng(1)
    x = np.r_[rnd.normal(0, 1, 900), rnd.normal(6, 0.2, 100), far]
    df = spark.createDataFrame([(float(v),) for v in x], "x double").repartition(3)
    out = density(df, "x", 200).orderBy("point").collect()
    width = x.std(ddof=1) * len(x) ** -0.2
    grid = np.linspace(x.min(), x.max(), 200)
    want = np.exp(-0.5 * ((grid[:, None] - x) / width) ** 2).sum(1) / (len(x) * width * np.sqrt(2 * np.pi))
    assert [r["density"] for r in out] == pytest.approx(want, rel=1e-8, abs=1e-15)


def test_sparse_onehot(spark):
    df = spark.createDataFrame([(i, f"n{i % 7}" if i % 5 else None) for i in range(60)], "id long, c string")
    fitted = fit_step(df, Step("encode", ["c"], "onehot_sparse"))
    other = spark.createDataFrame([(1, "n6"), (2, "zz"), (3, None), (4, "n0")], "id long, c string")
    rows = apply_step(other, Step("encode", ["c"], "onehot_sparse"), fitted).orderBy("id").collect()
    assert [r["c_index"] for r in rows] == [6, None, None, 0]
    assert [(r["c_onehot"].size, list(r["c_onehot"].indices)) for r in rows] == [(7, [6]), (7, []), (7, []), (7, [0])]
