import pytest

from wayline.operators.clients import client_attributes, feature_names


@pytest.mark.parametrize("threshold", ["-1", "10MB"])
def test_client_attributes(spark, conf, threshold):
    conf(spark__sql__autoBroadcastJoinThreshold=threshold)
    names = spark.createDataFrame([("dbt",), ("dbt",), ("Web",), ("Web Console",), ("FooBar",),
                                   (None,)], "client string")
    listed = spark.createDataFrame([("dbt", "dt", "dbt.svg"), ("Web", "We", "web.svg"),
                                    ("other", None, "o.svg")],
                                   "client string, abbreviation string, icon string")
    got = {r.client: (r.abbreviation, r.icon) for r in
           client_attributes(names, listed, "Web").collect()}
    assert got == {"dbt": ("dt", "dbt.svg"), "Web": ("We", "web.svg"),
                   "Web Console": ("WC", "web.svg"), "FooBar": ("FB", None)}
    got = {r.client: r.icon for r in client_attributes(names, listed).collect()}
    assert got["Web Console"] is None
    plain = {r.client: r.abbreviation for r in client_attributes(names).collect()}
    assert plain == {"dbt": "Db", "Web": "We", "Web Console": "WC", "FooBar": "FB"}


def test_features_take_the_icon_of_their_family(spark):
    labels = spark.createDataFrame([("Web (Sheets)",), ("Web (",), ("dbt",), (None,), ("Web (dbt)",)], "CLIENT string")
    features = feature_names(labels, "Web (")
    assert {r.client for r in features.collect()} == {"Sheets", "dbt"}
    names = spark.createDataFrame([("Sheets",), ("dbt",), ("Other",)], "client string")
    listed = spark.createDataFrame([("dbt", None, "dbt.svg"), ("Web", None, "web.svg")],
                                   "client string, abbreviation string, icon string")
    got = {r.client: r.icon for r in client_attributes(names, listed, "Web", features).collect()}
    assert got == {"Sheets": "web.svg", "dbt": "dbt.svg", "Other": None}
