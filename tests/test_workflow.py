import io
import json
import zipfile

from pyspark.sql import functions as F

from redgreen.operators import report as r
from redgreen.plans import workflow as w
from redgreen.sources import archives as ar
from redgreen.sources import jobs as j
from redgreen.sources import results as rs


def archive(path, **entries):
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w") as z:
        for name, body in entries.items():
            z.writestr(name, body)
    path.write_bytes(buffer.getvalue())


def write_fixture(folder):
    """Five flaky jobs: two with good logs, one broken zip, one missing file, one without an archive."""
    jobs = []
    for n, (name, zip_name) in enumerate(
        [("net", "net.zip"), ("race", "race.zip"), ("broken", "broken.zip"), ("lost", "lost.zip"), ("bare", "")]
    ):
        for attempt, conclusion in enumerate(["failure", "success"], 1):
            row = {
                "run_id": n, "run_attempt": attempt, "job_id": n * 10 + attempt, "job_name": name, "workflow_name": "CI",
                "workflow_file": "ci.yml", "head_sha": f"sha{n}00000", "branch": "main", "conclusion": conclusion,
                "started_at": f"2026-08-18T09:{n}{attempt}:00Z", "url": f"https://ci/{name}/{attempt}",
            }
            if conclusion == "failure" and zip_name:
                row["log_archive"] = zip_name
            jobs.append(row)
    (folder / "runs.json").write_text(json.dumps({"repo": "acme/x", "jobs": jobs}))
    archive(folder / "net.zip", **{
        "1_Set up job.txt": "fine", "2_Run tests.txt": "go test\nerror: dial tcp 1.1.1.1: i/o timeout\n##[error] exit",
        "3_Post Run.txt": "##[error] panic: cleanup",
    })
    archive(folder / "race.zip", **{"build/1_Test.txt": "WARNING: DATA RACE\nFAILED"})
    archive(folder / "healthy.zip", **{"1_Test.txt": "no flaky job points here"})
    (folder / "broken.zip").write_bytes(b"PK nonsense")


def classified(spark, folder, provider, floor=0.5):
    jobs = j.read_jobs(spark, str(folder / "runs.json"))
    occurrences, _ = w.scan(jobs)
    archives = ar.list_archives(spark, str(folder))
    return w.classify_occurrences(occurrences, jobs.select("job_id", "log_archive"), archives, provider, floor)


def test_listed_read_and_unzipped_logs_agree(spark, tmp_path):
    write_fixture(tmp_path)
    jobs = j.read_jobs(spark, str(tmp_path / "runs.json"))
    occurrences, _ = w.scan(jobs)
    read = ar.read_archives(spark, str(tmp_path))
    forms = [ar.list_archives(spark, str(tmp_path)), read, ar.unzip_steps(read)]
    index = jobs.select("job_id", "log_archive")
    one, two, three = (sorted(map(repr, w.classify_occurrences(occurrences, index, f, w.deterministic()).collect())) for f in forms)
    assert one == two == three and len(one) == 5


def test_scan_to_report(spark, tmp_path):
    write_fixture(tmp_path)
    items = classified(spark, tmp_path, w.deterministic()).cache()
    got = {x.job_name: x for x in items.collect()}
    assert len(got) == 5
    net = got["net"]
    assert (net.verdict.category, net.step_name, net.error) == ("network_timeout", "Run tests", "")
    assert net.verdict.cited_lines == ["error: dial tcp 1.1.1.1: i/o timeout"]
    assert (net.failing_url, net.passing_url) == ("https://ci/net/1", "https://ci/net/2")
    assert got["race"].verdict.category == "race_condition" and got["race"].excerpt_len == 25
    assert got["broken"].error.startswith("extracting log: reading archive: opening log archive: ")
    assert got["lost"].error == "downloading log: reading archive lost.zip: not found"
    assert got["bare"].error == "downloading log: job 41 has no log archive"
    assert all(got[x].verdict is None for x in ("broken", "lost", "bare"))
    header = r.Header("acme/x", "fixture", __import__("datetime").datetime(2026, 8, 18), "deterministic", "rule-based-v1", True)
    text = "\n".join(x.line for x in r.in_reading_order(r.report_lines(items, header)).collect())
    assert "2 flaky occurrence(s) classified." in text and text.count("> Classification failed:") == 3
    named = w.with_provenance(items, w.deterministic()).first()
    assert (named.provider, named.model, named.baseline) == ("deterministic", "rule-based-v1", True)
    rs.write_json(items, str(tmp_path / "items"))
    assert rs.read_json(spark, str(tmp_path / "items"), items.schema).count() == 5


def test_floor_and_missing_failure(spark, tmp_path):
    write_fixture(tmp_path)
    jobs = j.read_jobs(spark, str(tmp_path / "runs.json"))
    occurrences, _ = w.scan(jobs)
    gone = F.when(F.col("job_name") != "race", F.col("primary_failure"))
    steps = ar.unzip_steps(ar.read_archives(spark, str(tmp_path)))
    items = w.classify_occurrences(
        occurrences.withColumn("primary_failure", gone), jobs.select("job_id", "log_archive"), steps, w.deterministic(), 1.0
    )
    got = {x.job_name: x for x in items.collect()}
    assert got["race"].error == "occurrence has no failing run"
    assert (got["net"].verdict.category, got["net"].verdict.raw_category) == ("unknown", "network_timeout")


def test_landed_responses(spark, tmp_path):
    write_fixture(tmp_path)
    ids = {x.job_name: x.id for x in w.scan(j.read_jobs(spark, str(tmp_path / "runs.json")))[0].collect()}
    good = json.dumps({"category": "infra_flake", "confidence": 0.8, "explanation": "x", "cited_lines": ["go test", "made up"]})
    schema = "id string, raw string, transport_error string"
    first = spark.createDataFrame([(ids["net"], good, None), (ids["race"], "?", None)], schema)
    second = spark.createDataFrame([(ids["race"], "?", None)], schema)
    provider = w.classifier("responses", first=first, second=second, provider="acme", model="m")
    got = {x.job_name: x for x in classified(spark, tmp_path, provider).collect()}
    assert got["net"].verdict.category == "infra_flake"
    assert (got["net"].verdict.cited_lines, got["net"].verdict.hallucinated_citations) == (["go test"], ["made up"])
    assert got["race"].error == "classifying: acme returned unparseable output twice: no JSON object found"
    assert got["lost"].error.startswith("downloading log: ")


def test_jobs_that_share_a_log_have_it_classified_once(spark):
    """Rules see each excerpt once, however many occurrences point at it; the items are those of one by one."""
    jobs = spark.createDataFrame(
        [(n, a, f"{n}-{a}", f"job {n}", "CI", "ci.yml", f"sha{n}", "main", c, "u") for n in range(6) for a, c in ((1, "failure"), (2, "success"))],
        "run_id int, run_attempt int, job_id string, job_name string, workflow_name string, workflow_file string, head_sha string, branch string, conclusion string, url string",
    ).withColumn("started_at", F.lit("2026-01-02").cast("timestamp"))
    index = jobs.select("job_id", F.when(F.col("run_id") < 4, "a.zip").when(F.col("run_id") == 4, "bad.zip").otherwise("none.zip").alias("log_archive"))
    logs = spark.createDataFrame(
        [("a.zip", ".", 1, 0, "Run", "dial tcp: i/o timeout", None), ("bad.zip", ".", 1, 0, "Run", None, "not a zip")],
        "archive string, job_dir string, step_order bigint, entry_no int, step_name string, body string, error string",
    )
    occurrences, _ = w.scan(jobs)
    rules, seen = w.deterministic(), []

    def counted(requests):
        seen.append(requests.count())
        return rules.run(requests)

    once = w.classify_occurrences(occurrences, index, logs, rules._replace(run=counted))
    each = w.classify_occurrences(occurrences, index, logs, w.Classifier("deterministic", "rule-based-v1", counted))
    assert seen == [2, 6]
    assert sorted(map(repr, once.collect())) == sorted(map(repr, each.collect()))
    assert once.where("verdict.category = 'network_timeout'").count() == 4
