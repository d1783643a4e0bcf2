import numpy as np
import pytest
from pyspark.sql import functions as F

from flowcairn.operators.balancing import resample
from flowcairn.operators.cleaning import Cleaner, Encoder, RobustScaler, StandardScaler, narrow_types
from flowcairn.operators.information import dynamic_k, mutual_information, select_top_k
from flowcairn.operators.preparation import PROFILES, NotFitted, PrepareConfig, Preparation, prepare, profile_for, stateless

INF, NAN = float("inf"), float("nan")


@pytest.fixture(scope="module")
def noisy(spark):
    rng = np.random.default_rng(0)
    rows = [(i, float(v), int(i % 4 == 0)) for i, v in enumerate(rng.normal(10, 3, 200))]
    rows[3] = (3, INF, 1)
    rows[4] = (4, -INF, 0)
    rows[5] = (5, NAN, 0)
    return spark.createDataFrame(rows, "id int, x double, label int").withColumn("none", F.lit(None).cast("string"))


def test_cleaner_matches_numpy(noisy):
    raw = np.array([r["x"] for r in noisy.orderBy("id").collect()])
    finite = raw[np.isfinite(raw)]
    low, high = np.quantile(finite, [0.001, 0.999])
    model = Cleaner().fit(noisy, ["x", "none"])
    assert model.dropped == ["none"]
    got = np.array([r["x"] for r in model.transform(noisy, outliers=True).orderBy("id").collect()])
    want = np.where(np.isfinite(raw), np.clip(raw, low, high), np.median(finite))
    assert np.allclose(got, want)
    unseen = np.array([r["x"] for r in model.transform(noisy).orderBy("id").collect()])
    assert np.allclose(unseen, np.where(np.isfinite(raw), raw, np.median(finite)))


def test_extremes_and_cap(noisy):
    finite = [r["x"] for r in noisy.collect() if np.isfinite(r["x"])]
    model = Cleaner(inf_as_extreme=True, clip_quantiles=None, impute=False).fit(noisy, ["x"])
    got = {r["id"]: r["x"] for r in model.transform(noisy).collect()}
    assert got[3] == max(finite) and got[4] == min(finite) and got[5] is None
    capped = Cleaner(clip_quantiles=None, cap=9.0).fit(noisy, ["x"]).transform(noisy, outliers=True)
    assert capped.agg(F.max(F.abs("x"))).first()[0] <= 9.0


def test_only_infinities(spark):
    df = spark.createDataFrame([(INF,), (-INF,), (None,)], "x double")
    model = Cleaner(inf_as_extreme=True, clip_quantiles=None, impute=False).fit(df, ["x"])
    assert [r["x"] for r in model.transform(df).collect()] == [0.0, 0.0, None]
    assert Cleaner().fit(df, ["x"]).columns == []


def test_scalers(spark):
    df = spark.createDataFrame([(1.0, 7.0), (2.0, 7.0), (3.0, 7.0), (10.0, 7.0)], "x double, same double")
    robust = [tuple(r) for r in RobustScaler().fit(df, ["x", "same"]).transform(df).collect()]
    q1, q2, q3 = np.quantile([1, 2, 3, 10], [0.25, 0.5, 0.75])
    assert robust == [((v - q2) / (q3 - q1), 0.0) for v in (1.0, 2.0, 3.0, 10.0)]
    standard = StandardScaler().fit(df, ["x", "same"]).transform(df).agg(F.avg("x"), F.stddev_pop("x"), F.max("same")).first()
    assert standard[0] == pytest.approx(0) and standard[1] == pytest.approx(1) and standard[2] == 0.0


@pytest.mark.parametrize("literal", [1000, 1])
def test_encoder(spark, literal):
    df = spark.createDataFrame([("b", "x"), ("a", "x"), (None, "x"), ("zz", "y")], "c string, d string")
    model = Encoder(literal_values=literal).fit(df, ["c", "d"])
    assert {tuple(r) for r in model.transform(df).collect()} == {(1.0, 0.0), (0.0, 0.0), (2.0, 0.0), (3.0, 1.0)}
    unseen = spark.createDataFrame([("new", "x")], "c string, d string")
    assert model.transform(unseen).first()["c"] == 4.0


def test_narrow_types(spark):
    df = spark.createDataFrame([(1.5, 1, 2**40, "a"), (2.5, 2, 1, "a"), (0.5, 3, 1, "a")], "x double, n long, big long, s string")
    small, few = narrow_types(df)
    assert dict(small.dtypes) == {"x": "float", "n": "int", "big": "bigint", "s": "string"} and few == ["s"]


def test_fitted_on_training_rows_only(spark):
    train = spark.createDataFrame([(10.0, float(i + 1), int(i > 2)) for i in range(5)], "f1 double, f2 double, label int")
    test = spark.createDataFrame([(NAN, 3.0, 0), (INF, 3.0, 1)], "f1 double, f2 double, label int")
    p = Preparation(PrepareConfig(apply_scaling=False)).fit(train, ["f1", "f2"])
    assert [r["f1"] for r in p.transform(test).collect()] == [10.0, 10.0]
    far = spark.createDataFrame([(1e9, -1e9, 1)], "f1 double, f2 double, label int")
    assert tuple(p.transform(far).first()) == (1e9, -1e9, 1)
    with pytest.raises(NotFitted):
        Preparation().transform(test)


def test_selection_finds_the_informative_feature(spark):
    rng = np.random.default_rng(4)
    rows = [(float(rng.normal()), float(rng.normal() + 3 * (i % 2)), i % 2) for i in range(400)]
    df = spark.createDataFrame(rows, "noise double, signal double, label int")
    assert select_top_k(df, ["noise", "signal"], "label", 1) == ["signal"]
    mi = {r["feature"]: r["mutual_information"] for r in mutual_information(df, ["noise", "signal"], "label").collect()}
    assert mi["signal"] > 0.3 > mi["noise"] >= 0
    assert (dynamic_k(20), dynamic_k(100), dynamic_k(500)) == (10, 30, 60)


def test_profiles():
    linear = profile_for("LR", 50)
    assert linear.apply_scaling and linear.apply_feature_selection and linear.apply_resampling
    assert linear.feature_selection_k == 15 and not linear.use_class_weight
    for name in ("DT", "Random Forest", "TabNet"):
        p = profile_for(name, 50)
        assert not (p.apply_scaling or p.apply_feature_selection or p.apply_resampling) and p.use_class_weight
    cnn = profile_for("CNN", 50)
    assert cnn.apply_scaling and cnn.apply_resampling and not cnn.apply_feature_selection
    assert set(PROFILES) == {"lr_profile", "tree_profile", "cnn_profile", "tabnet_profile", "nn_profile"}


@pytest.fixture(scope="module")
def unbalanced(spark):
    rng = np.random.default_rng(5)
    rows = [(i, *[float(v) for v in rng.normal(int(i < 20), 1, 3)], int(i < 20)) for i in range(150)]
    return spark.createDataFrame(rows, "id int, a double, b double, c double, label int")


@pytest.mark.parametrize("broadcast_bytes", [10**8, 0])
def test_smote_balances_inside_the_class(unbalanced, broadcast_bytes):
    out = resample(unbalanced, ["a", "b", "c"], "label", ["id"], broadcast_bytes=broadcast_bytes)
    assert {r["label"]: r["count"] for r in out.groupBy("label").count().collect()} == {0: 130, 1: 130}
    made = np.array([[r["a"], r["b"], r["c"]] for r in out.where("id IS NULL").collect()])
    seen = np.array([[r["a"], r["b"], r["c"]] for r in unbalanced.where("label = 1").collect()])
    assert (made >= seen.min(axis=0)).all() and (made <= seen.max(axis=0)).all()
    again = resample(unbalanced.repartition(7), ["a", "b", "c"], "label", ["id"], broadcast_bytes=broadcast_bytes)
    assert sorted(map(str, again.collect())) == sorted(map(str, out.collect()))


def test_adasyn_and_small_minority(unbalanced):
    out = resample(unbalanced, ["a", "b", "c"], "label", ["id"], "ADASYN")
    counts = {r["label"]: r["count"] for r in out.groupBy("label").count().collect()}
    assert counts[0] == 130 and abs(counts[1] - 130) <= 20
    few = unbalanced.where("label = 0 OR id < 4")
    assert resample(few, ["a", "b", "c"], "label", ["id"]).count() == few.count()
    with pytest.raises(ValueError):
        resample(unbalanced, ["a"], "label", ["id"], "OTHER")


def test_prepare_balances_train_only(unbalanced):
    cfg = PrepareConfig(apply_resampling=True)
    fitted, parts = prepare(unbalanced, ["a", "b", "c"], "label", ["id"], cfg)
    train = {r["label"]: r["count"] for r in parts["train"].groupBy("label").count().collect()}
    assert train[0] == train[1]
    held = sum(parts[p].count() for p in ("val", "test"))
    assert held == 150 - 91 - 14 and fitted.features == ["a", "b", "c"]


def test_stateless_keeps_columns(spark):
    rows = [(1.0, 10.0, 0, 0), (2.0, INF, 0, 1), (3.0, 30.0, 1, 0), (4.0, None, 1, 1)]
    df = spark.createDataFrame(rows, "a double, b double, dataset_source int, label int")
    out = stateless(df, ["a", "b"])
    assert out.columns == df.columns
    assert {r["dataset_source"] for r in out.collect()} == {0, 1}
    assert [r["b"] for r in out.orderBy("a").collect()][1] <= 30.0 and out.where("b IS NULL").count() == 1


def test_narrowing_keeps_every_value(spark):
    df = spark.createDataFrame([(0.5, 1e300, 0.1, 1), (None, 2.0, 0.25, 2**40)], "a double, b double, c double, d long")
    small, _ = narrow_types(df)
    assert dict(small.dtypes) == {"a": "float", "b": "double", "c": "double", "d": "bigint"}
    assert {tuple(r) for r in small.collect()} == {tuple(r) for r in df.collect()}


def test_codes_of_values_with_one_prefix(spark):
    values = [f"customer#{i:06d}" for i in range(3000)]
    df = spark.createDataFrame([(v,) for v in values] + [(None,)], "name string")
    coded = Encoder(literal_values=10).fit(df, ["name"]).transform(df.withColumn("text", F.col("name")))
    codes = {r["text"]: r["name"] for r in coded.collect()}
    assert [codes[v] for v in values] == [float(i) for i in range(3000)] and codes[None] == 3000.0
