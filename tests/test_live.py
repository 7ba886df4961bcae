"""Live detection against detection over everything that landed."""

from pyspark.sql import functions as F

from redgreen.operators import detect as d
from redgreen.streaming import live
from test_landing import jobs_of


def same(one, other):
    assert one.columns == other.columns
    assert sorted(map(repr, one.collect())) == sorted(map(repr, other.collect()))


def test_every_batch_ends_in_the_batch_answer(spark, tmp_path):
    jobs = jobs_of(spark, 240)
    jobs_path, out = str(tmp_path / "jobs"), str(tmp_path / "out")
    revised = jobs.withColumn("conclusion", F.when(F.col("head_sha") == "hot", "skipped").otherwise(F.col("conclusion")))
    first = jobs.where("run_id < 160")
    counts = []
    for batch in (first, first, jobs.where("run_id >= 100"), revised, revised):
        live.update(batch, jobs_path, out, parts=4, period="year")
        landed = spark.read.parquet(jobs_path).drop("day")
        found = live.occurrences(spark, out)
        same(found, d.detect(landed))
        counts.append(found.count())
    assert counts[0] == counts[1] < counts[2] and counts[3] == counts[4] < counts[2]  # some are no longer flaky
    assert spark.read.parquet(out).where("not flaky").count() > 0


def test_a_stream_of_files_and_its_replay(spark, tmp_path):
    jobs = jobs_of(spark, 120)
    paths = [str(tmp_path / n) for n in ("jobs", "out", "checkpoint")]

    def run(checkpoint):
        stream = spark.readStream.schema(jobs.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(str(tmp_path / "in"))
        query = live.follow(stream, *paths[:2], checkpoint, parts=2, period="year")
        assert query.awaitTermination(180)
        same(live.occurrences(spark, paths[1]), d.detect(spark.read.parquet(paths[0]).drop("day")))

    jobs.where("run_id < 70").coalesce(1).write.parquet(str(tmp_path / "in" / "a"))
    run(paths[2])
    jobs.where("run_id >= 50").coalesce(1).write.parquet(str(tmp_path / "in" / "b"))
    run(paths[2])
    same(live.occurrences(spark, paths[1]), d.detect(jobs))
    run(paths[2] + "-again")  # all files once more
    same(live.occurrences(spark, paths[1]), d.detect(jobs))
