"""Comparisons by hashes and by kept states against counting everything."""

import random

import pytest

from plumbline.operators import changes, drift, state, versions

LONG = "the beginning that all long values share, longer than any prefix " * 6
SCHEMA = "word string, text string, n int, x double, day date, only_nulls string"


def table(seed, rows):
    rng = random.Random(seed)
    return [(rng.choice(["a", "b", "é", "N/A", "", None, f"w{rng.randint(0, 40)}"]),
             rng.choice([None, f"{LONG}{rng.randint(0, 1500)}", "short", "x" * 31, "x" * 32]),
             rng.choice([None, rng.randint(0, 9)]), rng.choice([None, rng.random()]), None, None)
            for _ in range(rows)]


@pytest.fixture(scope="module")
def pair(spark):
    return [spark.createDataFrame(table(seed, n), SCHEMA).repartition(5)
            for seed, n in ((1, 3000), (2, 2500))]


def expected(a, b, k):
    out = {}
    for i, name in enumerate(("word", "text")):
        va, vb = ({r[i] for r in t if r[i] not in (None, "", "N/A")} for t in (a, b))
        for change, v in (("added", vb - va), ("removed", va - vb)):
            if v:
                out[name, change] = (len(v), sorted(v, key=str.encode)[:k])
    return out


def shown(df):
    return {(r["column"], r["change"]): (r["total"], r["values"]) for r in df.collect()}


@pytest.mark.parametrize("most", [2, 1000])
def test_changed_values(pair, monkeypatch, most):
    """With few candidates allowed, columns are compared again by longer beginnings."""
    monkeypatch.setattr(changes, "MOST", most)
    k = 2 if most == 2 else 20
    assert shown(changes.category_changes_shown(*pair, k)) == expected(
        table(1, 3000), table(2, 2500), k)


def test_no_long_text_is_exchanged(pair):
    plan = drift.paired_hashes(*pair, ["word", "text"])._jdf.queryExecution().executedPlan().toString()
    keys = [line for line in plan.splitlines() if "hashpartitioning" in line]
    assert keys and all("value" not in line for line in keys)


def test_changed_values_of_nothing(pair):
    a, b = pair
    none = a.limit(0)
    assert shown(changes.category_changes_shown(none, none)) == {}
    got = shown(changes.category_changes_shown(none, b, 3))
    assert got == expected([], table(2, 2500), 3)
    assert changes.category_changes_shown(a.select("n"), b.select("n")).count() == 0


def sections(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_states(pair):
    a, b = pair
    whole = sections(changes.summary(a, b))
    assert {r[0] for r in whole} == {"rows", "missing", "distribution", "categories"}
    rows = {r["column"]: r for r in state.of(a).columns.collect()}
    assert rows["__all__"]["rows"] == 3000 and rows["only_nulls"]["missing"] == 3000
    assert rows["n"]["n"] == sum(r[2] is not None for r in table(1, 3000))
    assert sections(changes.summary(a.limit(0), b.limit(0))) == [
        ("rows", "__all__", "rows", "0", "0", "0")]


def test_registered_versions_are_not_read_again(spark, pair, tmp_path):
    a, b = (t.where("length(text) < 32 or text is null") for t in pair)
    store = versions.VersionStore(spark, str(tmp_path / "store"))
    store.register("t", a)
    store.register("t", b)
    want = sections(changes.summary(a, b))
    got = store.changes("t", 1, 2)
    files = {f for df in (got, store.changes("t", 1, b)) for f in df.inputFiles()}
    assert not any("/data/" in f for f in files)
    for part in (tmp_path / "store" / "data" / "t").glob("v=*/part-*"):
        part.write_bytes(b"not to be read")
    assert sections(got) == want


def test_versions_without_state(spark, pair, tmp_path):
    a, b = pair
    store = versions.VersionStore(spark, str(tmp_path / "store"))
    store.register("t", a, keep_state=False)
    store.register("t", b)
    want = sections(changes.summary(a, b))
    assert sections(store.changes("t", 1, 2)) == want
    assert sections(store.changes("t", 1, b)) == want
