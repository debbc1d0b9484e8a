import pytest
from pyspark.sql import functions as F

from tessera.operators.lifecycle import claimed
from tessera.sources.versions import Conflict, VersionedTable


@pytest.fixture
def held(spark, tmp_path):
    table = VersionedTable(spark, f"file://{tmp_path}/t", "source", parts=8)
    table.create(spark.createDataFrame([(i, f"s{i % 5}", "new") for i in range(50)] + [(99, None, None)], "id long, source string, status string"))
    return table


def rows(df):
    return {(r.id, r.source, r.status) for r in df.collect()}


def test_changes_are_versions(held):
    assert held.version() == 1 and held.read().count() == 51
    before = held.read()
    assert held.delete(F.col("source") == "s1") == 2
    assert held.update((F.col("source") == "s2") & (F.col("id") < 20), {"status": F.lit("old")}) == 3
    want = {(i, f"s{i % 5}", "old" if i % 5 == 2 and i < 20 else "new") for i in range(50) if i % 5 != 1} | {(99, None, None)}
    assert rows(held.read()) == want
    assert before.count() == 51 and held.read(1).count() == 51  # readers of the old version
    assert held.delete(F.col("source") == "no such") == 3  # nothing to write
    untouched = {p for p, f in held._manifest(3)["parts"].items() if held._manifest(1)["parts"].get(p) == f}
    assert untouched  # parts of other sources are the same folders still


def test_a_failed_write_leaves_the_old_version(held, spark):
    @F.udf("string")
    def broken(x):
        raise ValueError("no")

    with pytest.raises(Exception, match="no"):
        held.update(F.col("source") == "s1", {"status": broken("status")})
    assert held.version() == 1 and held.read().where("status = 'new'").count() == 50
    held.delete(F.col("id") == 0)
    held.vacuum()
    assert held.read().count() == 50 and held.version() == 2
    with pytest.raises(Exception, match="(?i)not.*exist|no such"):
        held.read(1).count()


def test_conflict_and_retry(held):
    base = held.version()
    held.delete(F.col("id") == 3)
    with pytest.raises(Conflict):
        held.rewrite(F.col("id") == 4, lambda df: df.where("id <> 4"), base)
    assert held.read().where("id = 4").count() == 1
    held.delete(F.col("id") == 4)
    assert held.read().where("id in (3, 4)").count() == 0


def test_swap(held, spark):
    new = spark.createDataFrame([(1, "x", "y")], "id long, source string, status string")
    assert not held.swap(new, lambda df: df.count() == 51) and held.read().count() == 51
    assert held.swap(new, lambda df: df.count() == 1) and rows(held.read()) == {(1, "x", "y")}


def test_each_proposal_is_executed_once(spark, tmp_path):
    table = VersionedTable(spark, f"file://{tmp_path}/p", "id", parts=4)
    at = lambda s: F.timestamp_seconds(F.lit(1_700_000_000) + s)
    table.create(spark.range(40).select("id", F.lit(7).cast("long").alias("user_id"), at(0).alias("created"), F.lit("proposed").alias("state"), F.lit(None).cast("string").alias("claimed_by")))
    ask = lambda ids, seconds=10, user=7: spark.createDataFrame([(i,) for i in ids], "id long").select("id", F.lit(user).cast("long").alias("user_id"), at(seconds).alias("at"))
    base = table.version()
    one = {r.id: r.outcome for r in claimed(table, ask(range(0, 20)).unionByName(ask([0, 1])), "one", base).collect()}
    other = {r.id: r.outcome for r in claimed(table, ask(range(10, 30)).unionByName(ask([500])).unionByName(ask([35], user=8)).unionByName(ask([36], 300)), "other", base).collect()}
    assert one == dict.fromkeys(range(20), "executing")
    assert other == dict.fromkeys(range(10, 20), "proposal_already_consumed") | dict.fromkeys(range(20, 30), "executing") | {500: "not_found", 35: "not_found", 36: "proposal_expired"}
    state = {r.id: (r.state, r.claimed_by) for r in table.read().collect()}
    assert len(state) == 40 and state[15] == ("executing", "one") and state[25] == ("executing", "other") and state[36] == ("expired", None) and state[35] == ("proposed", None)
