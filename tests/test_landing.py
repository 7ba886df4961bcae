"""Batches of jobs merged into partitions."""

from datetime import date, datetime

from pyspark.sql import functions as F

from redgreen.operators import detect as d
from redgreen.sources import jobs as j
from redgreen.sources import landing as la

SCHEMA = "run_id bigint, run_attempt int, job_id string, conclusion string, started_at timestamp"


def row(run, conclusion, day, attempt=1):
    return (run, attempt, f"j{run}", conclusion, None if day is None else datetime(2026, 3, day, 23, 30))


def batch(spark, *rows):
    return spark.createDataFrame(list(rows), SCHEMA)


def files(path):
    return {str(p): p.stat().st_mtime_ns for p in path.rglob("*.parquet")}


def content(spark, path):
    return sorted(((r.run_id, r.run_attempt, r.conclusion, r.day) for r in spark.read.parquet(str(path)).collect()), key=str)


def test_a_batch_landed_twice_changes_no_file(spark, tmp_path):
    path = tmp_path / "jobs"
    rows = [row(1, "failure", 1), row(2, "success", 1), row(3, None, 2), row(3, None, 2), row(4, "failure", None)]
    assert la.land(batch(spark, *rows), str(path)) == [None, date(2026, 3, 1), date(2026, 3, 2)]
    want = content(spark, path)
    assert len(want) == 4
    before = files(path)
    assert la.land(batch(spark, *rows), str(path)) == [] and la.land(batch(spark, *rows[:2]), str(path)) == []
    assert files(path) == before and content(spark, path) == want
    assert la.land(batch(spark).limit(0), str(path)) == [] and files(path) == before
    assert not [p for p in path.iterdir() if p.name.startswith("_landing")]


def test_only_days_with_something_new_are_written(spark, tmp_path):
    path = tmp_path / "jobs"
    la.land(batch(spark, row(1, "failure", 1), row(2, "success", 1), row(3, "failure", 2), row(4, "failure", 3)), str(path))
    before = files(path)
    # A known row, one that changed, one that is new, and a day that is new.
    more = batch(spark, row(1, "failure", 1), row(3, "success", 2), row(5, "failure", 2), row(6, "failure", 4), row(3, "failure", 2, attempt=2))
    assert la.land(more, str(path)) == [date(2026, 3, 2), date(2026, 3, 4)]
    after = files(path)
    assert {p for p in before if "day=2026-03-02" not in p} <= set(after) and all(after[p] == t for p, t in before.items() if p in after)
    assert [(r, c) for r, _, c, _ in content(spark, path)] == [
        (1, "failure"), (2, "success"), (3, "success"), (3, "failure"), (4, "failure"), (5, "failure"), (6, "failure"),
    ]


def test_days_are_utc_and_prune_files(spark, tmp_path):
    zone = spark.conf.get("spark.sql.session.timeZone")
    try:
        spark.conf.set("spark.sql.session.timeZone", "Asia/Tokyo")
        rows = spark.sql("select 1L as run_id, 1 as run_attempt, 'j' as job_id, 'failure' as conclusion, timestamp'2026-03-01T23:30:00Z' as started_at")
        assert la.land(rows, str(tmp_path / "jobs")) == [date(2026, 3, 1)]
        assert la.land(rows, str(tmp_path / "months"), period="month") == [date(2026, 3, 1)]
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)
    kept = j.within_days(spark.read.parquet(str(tmp_path / "jobs")), date(2026, 3, 8), 7, "day")
    assert kept.count() == 1 and "PartitionFilters: [isnotnull(day" in kept._jdf.queryExecution().executedPlan().toString()


def test_of_different_rows_with_one_key_the_greatest_stays(spark, tmp_path):
    rows = [row(1, c, 1) for c in ("failure", "success", "cancelled")] * 3
    la.land(batch(spark, *rows), str(tmp_path / "jobs"))
    assert [c for _, _, c, _ in content(spark, tmp_path / "jobs")] == ["success"]


def jobs_of(spark, n=400):
    run = F.col("id")
    return spark.range(n).select(
        run.alias("run_id"), (run % 3 + 1).cast("int").alias("run_attempt"), run.cast("string").alias("job_id"),
        F.when(run % 7 > 0, F.concat(F.lit("job"), run % 2)).alias("job_name"), F.lit("CI").alias("workflow_name"),
        F.when(run % 5 > 0, F.lit("ci.yml")).alias("workflow_file"), F.when(run % 4 > 0, F.lit("hot")).otherwise(F.concat(F.lit("c"), run % 60)).alias("head_sha"),
        F.lit("main").alias("branch"), F.when(run % 11 < 7, "success").when(run % 11 < 9, "failure").otherwise("skipped").alias("conclusion"),
        F.timestamp_seconds(run * 9000 + 1_770_000_000).alias("started_at"), F.concat(F.lit("u"), run).alias("url"),
    )


def test_detection_over_a_landed_table_moves_no_job_row(spark, tmp_path):
    """No exchange below, between or above its aggregates, and only wanted days are read."""
    jobs = jobs_of(spark)
    landed = la.land_table(jobs, "landed_jobs", str(tmp_path / "jobs"), buckets=4)
    try:
        before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        found = d.detect(landed, clean=True)
        text = found._jdf.queryExecution().executedPlan().toString()
        assert "HashAggregate" in text and "Exchange" not in text and "SelectedBucketsCount: 4 out of 4" in text
        want = d.detect(jobs)
        assert sorted(map(repr, found.collect())) == sorted(map(repr, want.collect())) and want.count() > 4
        # Days from a table, known only when the query runs.
        days = spark.createDataFrame([(date(2026, 2, 5), 1), (date(2026, 2, 9), 2), (date(2030, 1, 1), 2)], "day date, n int").where("n = 2")
        kept = d.detect(la.on_days(landed, days), clean=True)
        text = kept._jdf.queryExecution().executedPlan().toString()
        assert "dynamicpruning" in text and "Exchange hashpartitioning(head_sha" not in text
        want = d.detect(jobs.where(la.day_of() == "2026-02-09"))
        assert sorted(map(repr, kept.collect())) == sorted(map(repr, want.collect()))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
        spark.sql("drop table landed_jobs")


def test_a_larger_table_has_more_buckets(spark, tmp_path, monkeypatch):
    jobs = jobs_of(spark, 60).localCheckpoint()
    monkeypatch.setattr(la, "BUCKET_ROWS", -(-jobs.count() // 5))
    sizes = {}
    for name, buckets in (("few", 2), ("many", 7)):
        la.land_table(jobs, f"jobs_{name}", str(tmp_path / name), buckets=buckets, period="year")
        described = {r.col_name: r.data_type for r in spark.sql(f"describe extended jobs_{name}").collect()}
        sizes[name] = int(described["Num Buckets"])
        spark.sql(f"drop table jobs_{name}")
    assert sizes == {"few": 5, "many": 7}


def test_rows_move_once_to_their_key(spark, tmp_path):
    """Whether a batch brings anything new takes one shuffle of it and of what is known."""
    rows = [row(1, "failure", 1), row(1, "success", 1), row(1, "success", 1), row(2, None, 2), (None, None, None, "failure", None)]
    df = batch(spark, *rows)
    assert sorted((r.run_id or 0, r.conclusion or "") for r in la.latest(df).collect()) == [(0, "failure"), (1, "success"), (2, "")]
    news = la.news_of(df, batch(spark, rows[1], rows[4]))
    assert [(r.run_id, r.conclusion) for r in news.collect()] == [(2, None)]
    for made in (la.latest(df), news):
        assert made._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[-1].count("Exchange") == 1


def test_hashes_tell_what_a_batch_brings(spark, tmp_path, monkeypatch):
    """To know it, no text moves; rows that come once each meet nothing before they meet in their file."""
    jobs, path = jobs_of(spark, 300), str(tmp_path / "jobs")
    dated = jobs.withColumn("day", la.day_of(period="year"))
    text = la.changes_of(dated, dated)._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[-1]
    above = text[: text.index("Exchange hashpartitioning(_key")]
    assert "Exchange hashpartitioning(_key" in text and "url" not in above and "head_sha" not in above
    monkeypatch.setattr(la, "news_of", lambda *_: 1 / 0)
    monkeypatch.setattr(la, "latest", lambda *_: 1 / 0)
    assert len(la.land(jobs, path, period="year")) == 1 and la.land(jobs, path, period="year") == []
    more = jobs_of(spark, 400).withColumn("conclusion", F.lit("skipped"))
    assert len(la.land(more, path, period="year")) == 1
    assert sorted(map(repr, spark.read.parquet(path).drop("day").collect())) == sorted(map(repr, more.collect()))


def test_keys_with_several_rows_in_a_batch_meet_what_is_known(spark, tmp_path, monkeypatch):
    """Equal and different rows of one key, on one day and on others, null keys; days in one part and in several."""
    null = (None, None, None, "failure", datetime(2026, 3, 4))
    first = [row(n, "failure", 1 + n % 3) for n in range(9)] + [row(1, "failure", 2), null]
    # The greatest row of 1 is known, that of 2 is new, 3 comes on two days, 4 twice the same, null keys with another row.
    second = [row(1, "failure", 2), row(1, "cancelled", 2), row(2, "success", 3), row(2, "failure", 3), row(3, "failure", 1), row(3, "failure", 2)]
    second += [row(4, "success", 2)] * 2 + [null, (*null[:3], "success", null[4])]
    want = {r: "failure" for r in (0, 1, 5, 6, 7, 8)} | {2: "success", 4: "success", None: "success"}
    for n in (1, 500_000):
        monkeypatch.setattr(la, "FILE_ROWS", n)
        path = tmp_path / str(n)
        la.land(batch(spark, *first), str(path))
        assert la.land(batch(spark, *second), str(path)) == [date(2026, 3, 2), date(2026, 3, 3), date(2026, 3, 4)]
        got = content(spark, path)
        assert {r: c for r, _, c, _ in got if r != 3} == want and len(got) == len(want) + 2
        assert [(c, d) for r, _, c, d in got if r == 3] == [("failure", date(2026, 3, 1)), ("failure", date(2026, 3, 2))]


def test_no_shuffle_outlives_its_step(spark, tmp_path):
    """Landing keeps none of its shuffle files, and leaves the session's setting as it was."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    disk = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()

    def shuffled():
        names = (disk.getAllFiles().apply(i).getName() for i in range(disk.getAllFiles().size()))
        return {n for n in names if n.startswith("shuffle_") and n.endswith(".data")}

    jobs, path = jobs_of(spark, 500).localCheckpoint(), str(tmp_path / "jobs")
    before = shuffled()
    for setting in (None, "false"):
        spark.conf.unset(name) if setting is None else spark.conf.set(name, setting)
        was = spark.conf.get(name)
        la.land(jobs.withColumn("conclusion", F.lit(str(setting))), path, period="year")
        assert spark.conf.get(name) == was
    spark.conf.unset(name)
    assert not shuffled() - before
