import pytest

from lattica.operators import validate
from lattica.operators.incremental import Session

SCHEMA = "id string, label string, measures map<string,double>, ord long"


@pytest.mark.parametrize(("rows", "rule"), [([("a", "fine", {"degree": 1.0}, 0), ("b", None, None, 1)], None), ([("a", "x", {"balance": 1.0}, 1), ("b", "me@mail.org", None, 0)], "pii"), ([("a", "x", {"balance": 1.0}, 0), ("b", "did:key:z", None, 1)], "confidential"), ([], None)])
def test_first_breach_in_payload_order(spark, rows, rule):
    nodes = spark.createDataFrame(rows, SCHEMA)
    if rule is None:
        return validate.rescan(nodes)
    with pytest.raises(validate.PayloadError) as found:
        validate.rescan(nodes)
    assert found.value.rule == rule


def test_ingest_scans_again(spark):
    with pytest.raises(validate.PayloadError) as found:
        Session(None).ingest(spark.createDataFrame([("a", "me@mail.org", None, 0)], SCHEMA), None, "tile")
    assert found.value.rule == "pii"
