import __spark_entry__


def test_entry_gives_rows(spark):
    assert __spark_entry__.entry(spark).count() > 0


def test_every_oracle_has_its_query():
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_missing_subpackage_is_no_error(monkeypatch):
    monkeypatch.setattr(__spark_entry__, "_present", lambda name: name == "terradelta.plans.registry")
    assert not any(n.startswith("op") and n[2].isdigit() for n in __spark_entry__.queries())
