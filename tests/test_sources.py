"""Readers, sinks, settings and the entry point."""

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

import __spark_entry__
from diurna import config, session
from diurna.sources import database, readers, sinks


def test_times_in_any_form(spark):
    for kind, value in (("string", "2024-01-01 00:00:01.500"), ("string", "2024-01-01 00:00:01"), ("string", "2024-01-01T00:00:01"), ("long", 1704067201)):
        df = spark.createDataFrame([("1", value, "x")], f"participantid string, measuredat {kind}, value0 string")
        assert readers.read_event_data(df).select(F.unix_timestamp("measuredat")).first()[0] == 1704067201
    bad = spark.createDataFrame([("1", "soon", "x")], "participantid string, measuredat string, value0 string")
    assert readers.read_event_data(bad).first().measuredat is None


def test_participant_filter_reaches_the_scan(spark, tmp_path):
    spark.createDataFrame([("1", 1), ("2", 2)], "participantid string, v int").write.parquet(str(tmp_path / "t"))
    df = readers.of_participants(readers.table(spark, str(tmp_path / "t")), ["1", "2"]).select("participantid")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [In(participantid" in plan and "ReadSchema: struct<participantid:string>" in plan


def test_upsert_is_idempotent(spark, tmp_path):
    path = str(tmp_path / "t")
    a = spark.createDataFrame([(1, "a"), (2, "b"), (2, "c")], "id int, v string")
    for _ in range(2):
        sinks.upsert(a, path, ["id"])
    sinks.upsert(spark.createDataFrame([(2, "z"), (3, "y")], "id int, v string"), path, ["id"])
    assert sorted(map(tuple, spark.read.parquet(path).collect())) == [(1, "a"), (2, "z"), (3, "y")]
    sinks.upsert(spark.createDataFrame([(3, "no"), (4, "n")], "id int, v string"), path, ["id"], "ignore")
    assert sorted(map(tuple, spark.read.parquet(path).collect())) == [(1, "a"), (2, "z"), (3, "y"), (4, "n")]


@pytest.mark.parametrize("moved", ["neither", "old", "both"])
def test_upsert_broken_off(spark, tmp_path, moved):
    """Whatever step a writer broke off at, the table holds the old or the new state."""
    path = str(tmp_path / "t")
    old, new = (spark.createDataFrame([(1, v)], "id int, v string") for v in ("old", "new"))
    if moved == "neither":
        sinks.overwrite(old, path)
    else:
        sinks.overwrite(old, sinks._aside(path))
    if moved == "both":
        sinks.overwrite(new, path)
    sinks.recovered(spark, path)
    assert spark.read.parquet(path).first().v == ("new" if moved == "both" else "old")
    sinks.upsert(spark.createDataFrame([(2, "x")], "id int, v string"), path, ["id"])
    assert spark.read.parquet(path).count() == 2 and not readers.exists(spark, sinks._aside(path))


def test_database_tables(spark):
    url, types = "jdbc:derby:memory:tables;create=true", {"createTableColumnTypes": "v VARCHAR(20), day VARCHAR(20)"}
    rows = spark.createDataFrame([(i, f"v{i}", "Mon") for i in range(100)], "id int, v string, day string")
    database.write(rows.repartition(3), url, "t", "overwrite", parts=2, **types)
    back = database.read(spark, url, "t", by="id", parts=4)
    assert back.rdd.getNumPartitions() == 4 and sorted(map(tuple, back.collect())) == sorted(map(tuple, rows.collect()))
    assert "PushedFilters: [*IsNotNull(id), *EqualTo(id,3)]" in back.where("id = 3").select("v")._jdf.queryExecution().executedPlan().toString()
    new = spark.createDataFrame([(5, "five", "Tue"), (5, "fiv", "Tue"), (200, "more", "Wed")], rows.schema)
    for _ in range(2):  # a second time changes nothing
        database.upsert(new, url, "t", ["id"], keep=("day",), **types)
    database.upsert(spark.createDataFrame([(6, "six", "Tue"), (300, "most", "Sun")], rows.schema), url, "t", ["id"], "ignore", **types)
    got = {r.id: (r.v, r.day) for r in database.read(spark, url, "t").collect()}
    assert len(got) == 102 and got[5] == ("five", "Mon") and got[6] == ("v6", "Mon") and got[200] == ("more", "Wed") and got[300] == ("most", "Sun")
    assert database.read(spark, url, "(SELECT * FROM t WHERE \"id\" < 0)", by="id", parts=4).count() == 0
    with pytest.raises(ValueError):
        database.upsert(new, url, "t", ["id"], "guess")


def test_merge_in_a_dialect():
    assert database.merge_statement("jdbc:postgresql://h/d", "t", "s", ["a", "b"], ["a"], "update", ()) == 'INSERT INTO t ("a", "b") SELECT "a", "b" FROM s ON CONFLICT ("a") DO UPDATE SET "b" = excluded."b"'
    assert database.merge_statement("jdbc:postgresql://h/d", "t", "s", ["a", "b"], ["a"], "ignore", ()).endswith('ON CONFLICT ("a") DO NOTHING')


def test_merge_can_keep_columns(spark):
    old = spark.createDataFrame([(1, "a", "Mon")], "id int, v string, weekday string")
    new = spark.createDataFrame([(1, "b", "Tue"), (2, "c", "Wed")], "id int, v string, weekday string")
    assert sorted(map(tuple, sinks.merged(old, new, ["id"], keep=("weekday",)).collect())) == [(1, "b", "Mon"), (2, "c", "Wed")]
    with pytest.raises(ValueError):
        sinks.merged(old, new, ["id"], "guess")


def test_files_tables_and_types(spark, tmp_path):
    scores = spark.createDataFrame([("A1", *range(10))], readers.SCORES)
    sinks.write_csv(scores, str(tmp_path / "s"))
    assert readers.read_scores(spark, str(tmp_path / "s")).first() == scores.first()
    assert not readers.exists(spark, str(tmp_path / "none")) and readers.has_column(scores, "prosocial_followup")
    assert sinks.sql_type(T.DecimalType(5, 2)) == "NUMERIC(5,2)" and sinks.sql_type(T.BinaryType()) == "TEXT"
    assert sinks.with_column_added(scores, "x", "int").columns[-1] == "x"
    assert [len(b) for b in readers.batches(spark.range(5), 2)] == [2, 2, 1]


def test_settings(tmp_path, monkeypatch):
    (tmp_path / "c.ini").write_text("[diurna]\nroot = /data\n")
    monkeypatch.setenv("DIURNA_DECRYPTION_KEY", "k")
    s = config.load_settings(str(tmp_path / "c.ini"))
    assert (s.root, s.decryption_key) == ("/data", "k")
    assert config.dataset_path(s, "daily_gps").startswith("/data/daily_gps/run_date=")
    with pytest.raises(KeyError):
        config.dataset_path(s, "other")
    assert session.timed(lambda: 3)() == 3


def test_every_oracle_has_its_query():
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
    assert len(__spark_entry__.queries()) > 100


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
