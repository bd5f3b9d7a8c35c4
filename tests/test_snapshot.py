"""Actions of contact, by catalog and alone."""

from lodestone.operators import snapshot

ROWS = [(1, 2, "Contact", "https://e.com/z"), (1, 1, "Write", "https://e.com/Contact/form?a=1"), (2, 1, "Shop", "https://e.com/shop?contact/"), (2, 2, None, None), (3, 1, "Contact", ""), (None, 1, "contact", "https://e.com/n")]
SCHEMA = "catalog long, pos long, label string, url string"


def test_each_catalog_has_its_first_action_of_contact(spark):
    found = snapshot.contact_url(spark.createDataFrame(ROWS, SCHEMA), "catalog").collect()
    assert {r.catalog: r.contact_url for r in found} == {1: "https://e.com/Contact/form?a=1", 2: "", 3: "", None: "https://e.com/n"}


def test_a_catalog_alone_is_one_row_also_when_empty(spark):
    catalog = spark.createDataFrame(ROWS, SCHEMA)
    assert [r.contact_url for r in snapshot.contact_url(catalog.where("catalog = 1")).collect()] == ["https://e.com/Contact/form?a=1"]
    assert [r.contact_url for r in snapshot.contact_url(catalog.limit(0)).collect()] == [""]
    assert snapshot.contact_url(catalog.limit(0), "catalog").collect() == []
