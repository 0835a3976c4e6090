import importlib


def test_entry_contract(spark):
    mod = importlib.import_module("__spark_entry__")
    q, sql = mod.queries(), mod.oracle_sql()
    assert set(sql) <= set(q) and len(sql) > 100
    df = mod.entry(spark)
    assert df.columns == ["dimension", "impact", "deduction", "columns"] and df.count() > 0
