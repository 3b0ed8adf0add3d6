from spellaudit.functions import keys


def test_parameters_come_of_one_pass_and_few_rows(spark):
    """Classes without rows get what all rows give, no row gives none, and spans are classed with a row each, not one for each feature and class."""
    rows = [("key_hex", [float(i)] * len(keys.FEATURES)) for i in range(4)] + [("not_key_hex", [9.0] * len(keys.FEATURES))]
    labelled = spark.createDataFrame(rows, "class string, features array<double>")
    got = {(r["class"], r.feature): (r.mean, r.variance) for r in keys.fit_params(labelled).collect()}
    assert len(got) == len(keys.FEATURES) * len(keys.CLASSES)
    assert got["key_hex", "length"] == (1.5, 1.25) and got["not_key_hex", "length"] == (9.0, 0.0) and got["key_base64", "length"] == (3.0, 10.0)
    assert keys.fit_params(labelled.limit(0)).isEmpty()
    spans = spark.createDataFrame([("a1b2c3",)], "span string")
    assert keys.classify(spans, keys.fit_params(labelled.limit(0))).isEmpty()
    assert "feature" not in keys.classify(spans, keys.fit_params(labelled))._jdf.queryExecution().optimizedPlan().toString().replace("features", "")
