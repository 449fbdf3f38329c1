import pytest
from oracle import rows_of_spark, rows_of_sql

from chromaspan.plans import catalog

SF = "/root/testdata/sf0.01"


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query_equals_its_sql(spark, name):
    names, got = rows_of_spark(catalog.QUERIES[name](spark, SF))
    if name not in catalog.ORACLES:
        assert got
        return
    want_names, want = rows_of_sql(catalog.ORACLES[name], SF)
    assert names == want_names
    assert len(got) == len(want)
    bad = [(g, w) for g, w in zip(got, want, strict=True) if g != w]
    assert not bad, bad[:3]


def test_drift_sees_every_token_of_a_capture(spark):
    obs = catalog.observations(spark, SF)
    rows = catalog._tokens(spark, SF)
    for category, column in (("color", "hex"), ("spacing", "px"), ("radius", "radius")):
        want = obs.select("site", "capture", column).distinct().count()
        assert rows.where(f"category = '{category}'").count() == want
    styles = obs.select("site", "capture", "tag", "width", "px").distinct().count()
    assert rows.where("category = 'typography'").count() == styles
    assert rows.where("category = 'shadow'").count() == obs.select("site", "capture", "width", "radius").distinct().count()
