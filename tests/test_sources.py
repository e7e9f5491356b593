from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from termweave.operators.session import Session
from termweave.plans.rules import Condition, Rule
from termweave.sources import catalog, dataset
from termweave.sources.catalog import Catalog, SessionBuilder, Shard
from termweave.streaming import ingest
from termweave.plans import fields, metrics

UTC = timezone.utc


def at(day, hour=0):
    return datetime(2013, 4, day, hour, tzinfo=catalog.ZONE)


def test_shard_names():
    s = Shard.parse("index20130418.18-20130418.21.20130419000000")
    assert (s.shard_id, s.version, s.times) == ("index20130418.18-20130418.21", 20130419000000, (at(18, 18), at(18, 21)))
    assert Shard.parse("index20130418").times == (at(18), at(19)) and Shard.parse("index20130418.23").times == (at(18, 23), at(19))
    assert Shard.parse("shard0").times is None and Shard.parse("index20139918").times is None
    assert at(18).astimezone(UTC).hour == 6 and s.folder == "index20130418.18-20130418.21.20130419000000"


def test_overlaps():
    def chosen(names, start, end):
        return [s.folder for s in catalog.without_overlaps(filter(catalog.overlapping(start, end), map(Shard.parse, names)), start)]

    hourly = [f"index20130418.{h}.20130418220000" for h in (18, 19, 20)]
    wide = "index20130418.18-20130418.21."
    assert chosen([*hourly, wide + "20130419000000"], at(18), at(19)) == [wide + "20130419000000"]
    assert chosen([*hourly, wide + "20130418000000"], at(18), at(19)) == hourly
    assert chosen(["index20130418.20130418000000", "index20130418.18.20130419000000"], at(18, 18), at(19)) == ["index20130418.18.20130419000000"]
    shards = [Shard.parse("index20130418"), Shard.parse("index20130420")]
    assert catalog.gaps(shards, at(17), at(22)) == [(at(17), at(18)), (at(19), at(20)), (at(21), at(22))]
    assert catalog.gaps([], at(17), at(18)) == [(at(17), at(18))] and catalog.gaps(shards[:1], at(18), at(19)) == []


def test_versions(spark, tmp_path):
    for n in ("shard0", "shard0.20120101000000", "shard0.20111231000000", "shard1.20120101000000", "shard1.20120101123456", "shard2.20120102000000"):
        (tmp_path / "d" / n).mkdir(parents=True)
    got = Catalog(spark, str(tmp_path)).shards("d")
    assert [(s.shard_id, s.version) for s in got] == [("shard0", 20120101000000), ("shard1", 20120101123456), ("shard2", 20120102000000)]
    assert Catalog(spark, str(tmp_path)).datasets() == ["d"] and Catalog(spark, str(tmp_path)).shards("none") == []


@pytest.fixture
def days(spark, tmp_path):
    root = str(tmp_path / "root")
    for d in (1, 2, 4):
        docs = [{"n": i, "t": ["a", "b"][: 1 + i % 2], **({"late": 1} if d == 4 else {})} for i in range(d * 10)]
        dataset.write_shard(dataset.from_documents(spark, docs), f"{root}/events/index2013040{d}.20130501000000", sort_by=["n"])
    return Catalog(spark, root)


def test_sessions_on_shards(days):
    b = SessionBuilder(days, "events", at(1), at(5))
    s = b.open().push("count()")
    assert s.group_stats().first().s0 == 70 and b.missing() == [(at(3), at(4))]
    assert SessionBuilder(days, "events", at(2), at(3)).open().push("count()").group_stats().first().s0 == 20
    assert SessionBuilder(days, "events", named=("index20130401.20130501000000",)).open().push("count()").group_stats().first().s0 == 10
    assert s.subset_ftgs({"late": [1]}).collect()[0].s0 == 40
    assert b.each(25, lambda x: x.push("count()").group_stats().first().s0) == [10, 20, 40] and b.each(30, lambda x: x.df.count()) == [30, 40]
    for bad in (dict(start=at(2), end=at(2)), dict(start=at(2)), {}):
        with pytest.raises(ValueError):
            SessionBuilder(days, "events", **bad)
    assert days.describe().count() == 3 and days.fields("events") == ["late", "n", "t"]


def test_copies(spark, days, tmp_path):
    assert dataset.copy_time_range(days, "events", str(tmp_path / "copy"), at(1), at(4)) == ["index20130401.20130501000000", "index20130402.20130501000000"]
    copy = Catalog(spark, str(tmp_path / "copy"))
    assert len(copy.shards("events")) == 2
    path = copy.path("events", copy.shards("events")[0])
    assert spark.read.parquet(path).count() == 10 and {r.md5 for r in dataset.manifest(spark, path).collect()}
    assert dataset.delete(spark, path) and len(copy.shards("events")) == 1 and not dataset.delete(spark, path)
    dataset.copy_index(spark, days.path("events", days.shards("events")[0]), str(tmp_path / "narrow"), ["n"])
    assert spark.read.parquet(str(tmp_path / "narrow")).columns == ["n"]


def test_document_writer(spark, tmp_path):
    path = str(tmp_path / "written")
    docs = [{"n": [i, i, i + 1], "t": f"x{i % 3}"} for i in range(25)]
    with dataset.DocumentWriter(spark, path, buffer=10) as w:
        for d in docs:
            w.add(d)
    got = spark.read.parquet(path)
    assert got.count() == 25 and sorted(r.n for r in got.collect()) == [[i, i + 1] for i in range(25)]
    assert not (tmp_path / "written.segments").exists()


def test_formats_and_status(spark, days, tmp_path):
    df = spark.createDataFrame([(1, "a"), (2, "b")], "n long, t string")
    for kind in ("parquet", "orc", "json", "csv"):
        (df.write.option("header", "true") if kind == "csv" else df.write).format(kind).save(f"{tmp_path}/{kind}")
        assert sorted(Session.open(dataset.open_index(spark, f"{tmp_path}/{kind}"), ints=["n"], strings=["t"]).doc_rows(["n"], ["t"]).collect()) == [(1, 1, "a"), (1, 2, "b")]
    with pytest.raises(ValueError):
        dataset.open_index(spark, f"{tmp_path}/none")
    row = days.status().first()
    assert (row.dataset, row.shards) == ("events", 3) and row.files >= 3 and row.bytes > 0


def test_merge_and_fields(spark):
    a, b = dataset.from_documents(spark, [{"x": 1, "y": "p"}]), dataset.from_documents(spark, [{"x": "q", "z": 5}], start=1)
    m = dataset.merge([a, b])
    f = fields.infer(m)
    assert sorted(f.names("string")) == ["x", "y"] and f.names("int") == ["z"] and m.count() == 2
    with pytest.raises(ValueError):
        dataset.add_field(m, "x", F.lit(1))
    flat = dataset.merge([spark.createDataFrame([(1,)], "k long"), spark.createDataFrame([([2, 3],)], "k array<long>")])
    assert sorted(r.k for r in flat.collect()) == [[1], [2, 3]]
    assert [r.z for r in dataset.sort_index(m, F.desc("_doc")).orderBy("_doc").collect()] == [[5], None]


def test_term_stats_files(spark, days, tmp_path):
    s = SessionBuilder(days, "events", at(1), at(5)).open().push("count()", "n")
    whole = s.ftgs(["n"], ["t"])
    dataset.write_term_stats(whole, str(tmp_path / "stats"))
    again = dataset.read_term_stats(spark, str(tmp_path / "stats"))
    assert sorted(map(str, again.collect())) == sorted(map(str, whole.collect()))
    halves = [s.regroup([Rule(1, Condition("n", 9, True), *g)]).ftgs(["n"], ["t"]) for g in ((0, 1), (1, 0))]
    assert sorted(map(str, dataset.merge_term_stats(halves).select(whole.columns).collect())) == sorted(map(str, whole.collect()))


def test_streams(spark, tmp_path):
    start = datetime(2024, 1, 1)
    src = spark.createDataFrame([(start + timedelta(minutes=i), i % 3, i) for i in range(120)], "ts timestamp, kind int, v long")
    src.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(src.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = ingest.append_shards(stream, str(tmp_path / "root"), "live", str(tmp_path / "cp1"))
    q.awaitTermination()
    c = Catalog(spark, str(tmp_path / "root"))
    assert len(c.shards("live")) == 3
    assert SessionBuilder(c, "live", named=tuple(s.folder for s in c.shards("live"))).open().push("count()").group_stats().first().s0 == 120
    stack = metrics.Stack(fields.infer(src)).push_all(["count()", "v"])
    sums = ingest.time_stats(stream, "ts", "1 hour", "10 minutes", F.col("kind"), stack)
    q = sums.writeStream.format("memory").queryName("sums").outputMode("complete").option("checkpointLocation", str(tmp_path / "cp2")).trigger(availableNow=True).start()
    q.awaitTermination()
    got = {(r.start.hour, r.grp): (r.s0, r.s1) for r in spark.table("sums").collect()}
    want = {}
    for i in range(120):
        if i % 3:
            n, t = want.get((i // 60, i % 3), (0, 0))
            want[i // 60, i % 3] = n + 1, t + i
    assert got == want
