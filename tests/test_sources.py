import io
import json
import zipfile
from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from redgreen.operators import detect as d
from redgreen.operators import evaluate as ev
from redgreen.operators import report as rp
from redgreen.plans import workflow as w
from redgreen.sources import archives as ar
from redgreen.sources import corpus as co
from redgreen.sources import jobs as j
from redgreen.sources import results as rs


def fails(action):
    with pytest.raises(Exception) as caught:
        action()
    return str(caught.value)


@pytest.mark.parametrize(
    "text, parsed",
    [
        ("2026-08-18T09:14:00Z", datetime(2026, 8, 18, 9, 14)),
        ("2026-08-18T09:14:00+02:00", datetime(2026, 8, 18, 7, 14)),
        ("2026-08-18T09:14:00.250-00:30", datetime(2026, 8, 18, 9, 44, 0, 250000)),
        ("2026-08-18T09:14:00", datetime(2026, 8, 18, 9, 14)),
        ("2026-08-18 09:14:00", datetime(2026, 8, 18, 9, 14)),
        ("2026-08-18T9:14:00Z", datetime(2026, 8, 18, 9, 14)),
        ("", None),
    ],
)
def test_times(value, text, parsed):
    shown = F.date_format(j.parse_time("x"), "yyyy-MM-dd HH:mm:ss.SSSSSS")
    assert value(shown, x=text) == (parsed and parsed.strftime("%Y-%m-%d %H:%M:%S.%f"))
    assert value(j.bad_time("x"), x=text) is False


def test_times_without_a_zone_are_utc_in_any_session(spark, value):
    spark.conf.set("spark.sql.session.timeZone", "Asia/Tokyo")
    try:
        assert value(F.unix_seconds(j.parse_time("x")), x="1970-01-01 00:00:05") == 5
        assert value(F.unix_seconds(j.parse_time("x")), x="1970-01-01T01:00:05+01:00") == 5
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


@pytest.mark.parametrize("text", ["2026-08", "yesterday", "2026-08-18 09:14:00Z", "2026-13-01T00:00:00Z", "09:14:00"])
def test_bad_times(value, text):
    assert value(j.bad_time("x"), x=text) is True


def job(n, conclusion="failure", **changes):
    row = {
        "run_id": n, "run_attempt": 1, "job_id": 9000 + n, "job_name": "unit", "workflow_name": "CI",
        "workflow_file": "ci.yml", "head_sha": "abc", "branch": "main", "conclusion": conclusion,
        "started_at": "2026-08-18T09:14:00Z", "url": f"u{n}",
    }
    return {**row, **changes}


def index(path, *jobs):
    path.write_text(json.dumps({"repo": "acme/x", "jobs": list(jobs), "logs": {}}, indent=2))
    return str(path)


def test_index_document(spark, tmp_path):
    path = index(tmp_path / "runs.json", job(1, log_archive="a/b.zip"), job(2, "success", workflow_file=None))
    jobs = j.read_jobs(spark, path)
    rows = j.job_results(jobs).orderBy("run_id").collect()
    assert (rows[0].job_id, rows[1].workflow_file, jobs.first().repo) == (9001, "", "acme/x")
    assert jobs.where("log_archive = 'a/b.zip'").count() == 1


def test_index_errors(spark, tmp_path):
    assert "contains no jobs" in fails(lambda: j.read_jobs(spark, index(tmp_path / "none.json")).count())
    (tmp_path / "broken.json").write_text('{"jobs": [')
    fails(lambda: j.read_jobs(spark, str(tmp_path / "broken.json")).collect())
    bad = index(tmp_path / "time.json", job(1), job(2, started_at="soon"), job(3, started_at=""))
    assert "job 9002 has an unparseable started_at: soon" in fails(lambda: j.read_jobs(spark, bad).collect())
    assert j.read_jobs(spark, bad, strict=False).count() == 2
    assert [r.job_id for r in j.rejected_jobs(j.read_index(spark, bad)).collect()] == [9002]
    with pytest.raises(ValueError):
        j.read_jobs(spark, bad, "xml")


def test_json_lines_and_parquet(spark, tmp_path):
    path = index(tmp_path / "runs.json", job(1), job(2, "success"))
    jobs = j.read_jobs(spark, path)
    raw = j.read_index(spark, path).drop("repo")
    raw.write.json(str(tmp_path / "lines"))
    jobs.write.parquet(str(tmp_path / "typed"))
    raw.write.parquet(str(tmp_path / "texts"))
    want = sorted(j.job_results(jobs).collect())
    for fmt, name in [("json", "lines"), ("parquet", "typed"), ("parquet", "texts")]:
        assert sorted(j.job_results(j.read_jobs(spark, str(tmp_path / name), fmt)).collect()) == want


def test_windows_and_caps(spark, tmp_path):
    runs = spark.createDataFrame(
        [(1, datetime(2026, 3, 1, 23), 3), (2, datetime(2026, 3, 8), 0), (3, datetime(2026, 3, 8), 1), (4, None, None)],
        "run_id bigint, created_at timestamp, run_attempt int",
    )
    assert sorted(r.run_id for r in j.within_days(runs, date(2026, 3, 8), 7).collect()) == [1, 2, 3]
    assert sorted(r.run_id for r in j.within_days(runs, date(2026, 3, 8), 6).collect()) == [2, 3]
    assert [r.run_id for r in j.newest_runs(runs, 2).collect()] == [2, 3]
    attempts = sorted((r.run_id, r.run_attempt) for r in j.every_attempt(runs).collect())
    assert attempts == [(1, 1), (1, 2), (1, 3), (2, 1), (3, 1), (4, 1)]
    jobs = spark.range(1, 5).crossJoin(spark.range(0, 5)).toDF("run_id", "run_attempt")
    joined = j.jobs_of_every_attempt(jobs, runs).collect()
    assert sorted((r.run_id, r.run_attempt) for r in joined) == attempts
    for bad in (lambda: j.within_days(runs, date(2026, 3, 8), 0), lambda: j.newest_runs(runs, 0)):
        with pytest.raises(ValueError):
            bad()
    runs.write.parquet(str(tmp_path / "runs"))
    kept = j.within_days(spark.read.parquet(str(tmp_path / "runs")), date(2026, 3, 8), 6)
    assert "GreaterThanOrEqual(created_at" in kept._jdf.queryExecution().executedPlan().toString()


def zipped(**entries):
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w") as z:
        for name, body in entries.items():
            z.writestr(name, body)
    return buffer.getvalue()


def unzip(spark, **archives):
    rows = spark.createDataFrame(list(archives.items()), "archive string, content binary")
    return ar.unzip_steps(rows).orderBy("archive", ar.step_position()).collect()


def test_archives(spark):
    good = zipped(**{
        "2_Run tests.txt": "2026-01-01T10:00:00.1234567Z --- FAIL: x\r\nok", "build/1_Set up.TXT": "y", "build/": "",
        "10_Late.txt": "z", "readme.md": "no", "Odd.txt": b"\xff!",
    })
    rows = unzip(spark, good=good)
    assert [(r.job_dir, r.step_order, r.step_name, r.body) for r in rows] == [
        (".", 0, "Odd", "�!"), (".", 2, "Run tests", "--- FAIL: x\nok"), (".", 10, "Late", "z"),
        ("build", 1, "Set up", "y"),
    ]


def test_unusable_archives(spark):
    corrupt = bytearray(zipped(**{"1_a.txt": "x" * 1000}))
    corrupt[60:80] = b"?" * 20
    rows = {r.archive: r for r in unzip(spark, empty=zipped(), text=b"not a zip", other=zipped(**{"a.md": "x"}), bad=bytes(corrupt))}
    assert all(r.error and r.body is None for r in rows.values()) and len(rows) == 4
    assert "no .txt step files" in rows["other"].error and "no .txt step files" in rows["empty"].error


def test_expansion_cap(spark):
    archives = [("over", zipped(**{"1_a.txt": "x" * 60, "2_b.txt": "y" * 40})), ("under", zipped(**{"1_a.txt": "x" * 99}))]
    rows = spark.createDataFrame(archives, "archive string, content binary")
    found = {r.archive: r.error for r in ar.unzip_steps(rows, max_bytes=100).collect()}
    assert found == {"over": "reading archive: log archive exceeds 100 bytes; refusing to expand further", "under": None}
    assert {r.error for r in ar.unzip_steps(rows).collect()} == {None}


def test_archive_directory(spark, tmp_path):
    (tmp_path / "deep").mkdir()
    (tmp_path / "deep" / "a b+1.zip").write_bytes(zipped(**{"1_a.txt": "x"}))
    (tmp_path / "deep" / "er").mkdir()
    (tmp_path / "deep" / "er" / "a b+1.zip").write_bytes(zipped(**{"1_a.txt": "y"}))
    (tmp_path / "notes.txt").write_text("x")
    found = ar.unzip_steps(ar.read_archives(spark, str(tmp_path))).collect()
    assert sorted((r.archive, r.body) for r in found) == [("deep/a b+1.zip", "x"), ("deep/er/a b+1.zip", "y")]


def test_archives_below_a_root_whose_name_comes_again(spark, tmp_path):
    """Only the root itself is cut off, so equal file names stay apart."""
    root = tmp_path / "logs"
    again = root / "a" / str(root).lstrip("/")
    again.mkdir(parents=True)
    (root / "1.zip").write_bytes(zipped(**{"1_a.txt": "x"}))
    (again / "1.zip").write_bytes(zipped(**{"1_a.txt": "y"}))
    for path in (str(root), f"file:{root}/", f"file://{root}"):
        names = {r.archive for r in ar.read_archives(spark, path).collect()}
        assert names == {"1.zip", f"a/{str(root).lstrip('/')}/1.zip"}


def test_only_wanted_archives_are_opened(spark, tmp_path):
    """Names are listed without opening a file, and what is not wanted never is."""
    for n in range(6):
        (tmp_path / f"a {n}+é.zip").write_bytes(zipped(**{"2_b.txt": f"body {n}", "1_a.txt": "first"}))
    (tmp_path / "broken.zip").write_bytes(b"PK nonsense")
    listing = ar.list_archives(spark, str(tmp_path))
    assert listing.columns == ["archive", "path", "length"] and listing.count() == 7
    assert "ReadSchema: struct<path:string,length:bigint>" in listing._jdf.queryExecution().executedPlan().toString()
    opened = str(tmp_path / "opened")

    def note(path):
        with open(opened, "a") as f:
            f.write(path.rsplit("/", 1)[-1] + "\n")
        return open(path.removeprefix("file:"), "rb")

    wanted = spark.createDataFrame([("a 1+é.zip",), ("a 4+é.zip",), ("broken.zip",), ("gone.zip",)], "archive string")
    rows = ar.unzip_steps(listing.join(wanted, "archive", "left_semi"), opener=note).collect()
    assert sorted((r.archive, r.step_name, r.body) for r in rows if not r.error) == [
        ("a 1+é.zip", "a", "first"), ("a 1+é.zip", "b", "body 1"), ("a 4+é.zip", "a", "first"), ("a 4+é.zip", "b", "body 4"),
    ]
    assert [r.archive for r in rows if r.error] == ["broken.zip"]
    assert sorted(open(opened).read().split("\n")[:-1]) == ["a 1+é.zip", "a 4+é.zip", "broken.zip"]
    # The default opener, and a file that went away between listing and reading.
    rows = [("a 1+é.zip", f"file:{tmp_path}/a 1+é.zip"), ("gone.zip", f"file:{tmp_path}/gone.zip")]
    found = {r.archive: r for r in ar.archives_with_steps(spark.createDataFrame(rows, "archive string, path string")).collect()}
    assert [s.body for s in found["a 1+é.zip"].steps] == ["body 1", "first"] and found["a 1+é.zip"].error is None
    assert found["gone.zip"].steps == [] and found["gone.zip"].error.startswith("reading archive: opening log archive: ")


def test_broken_json_line_fails_the_read(spark, tmp_path):
    (tmp_path / "jobs.json").write_text(json.dumps(job(1)) + "\n{broken\n")
    with pytest.raises(Exception, match="(?i)malformed"):
        j.read_jobs(spark, str(tmp_path / "jobs.json"), "json").collect()


def test_window_starts_at_utc_midnight_in_any_session(spark):
    zone = spark.conf.get("spark.sql.session.timeZone")
    try:
        spark.conf.set("spark.sql.session.timeZone", "America/New_York")
        runs = spark.sql("select timestamp'2026-03-02T02:00:00Z' as created_at, timestamp'2026-03-01T23:59:59Z' as x")
        assert j.within_days(runs, date(2026, 3, 9), 7).count() == 1
        assert j.within_days(runs, date(2026, 3, 9), 7, "x").count() == 0
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)


def test_log_lookup(spark):
    failures = spark.createDataFrame([("a", 1), ("b", 2), ("c", 3), ("d", 4)], "id string, job_id bigint")
    index = spark.createDataFrame([(1, "x/one.zip"), (2, ""), (3, None), (1, "x/one.zip")], "job_id bigint, log_archive string")
    got = {r.id: (r.log_archive, r.log_error) for r in ar.locate_logs(failures, index).collect()}
    assert got == {
        "a": ("x/one.zip", None), "b": ("", "job 2 has no log archive"), "c": ("", "job 3 has no log archive"),
        "d": (None, "no job with id 4"),
    }


def corpus(tmp_path, *cases):
    (tmp_path / "logs").mkdir(exist_ok=True)
    path = tmp_path / "cases.json"
    path.write_text(json.dumps({"description": "d", "label_policy": "p", "cases": list(cases)}))
    return str(path)


def case(id, log, label):
    return {"id": id, "log": log, "expected_category": label, "note": ""}


def test_corpus_end_to_end(spark, tmp_path):
    path = corpus(
        tmp_path, case("1", "logs/one.log", "network_timeout"), case("2", "./logs/t wo+é.log", "unknown"),
        case("3", "logs/three.log", "genuine_bug"),
    )
    (tmp_path / "logs" / "one.log").write_text("start\ndial tcp: i/o timeout\n")
    (tmp_path / "logs" / "t wo+é.log").write_text("nothing to see")
    (tmp_path / "logs" / "three.log").write_text("WARNING: DATA RACE")
    cases = co.with_log_text(co.read_corpus(spark, path), co.read_logs(spark, str(tmp_path / "logs")))
    outcomes = w.evaluate(cases, w.deterministic())
    marks = {r.case_id: r.mark for r in ev.case_listing(outcomes).collect()}
    assert marks == {"1": "PASS", "2": "PASS", "3": "FAIL"}
    rs.write_json(ev.scores(outcomes, "deterministic", "rule-based-v1", True), str(tmp_path / "scores"))
    doc = json.loads(next(p for p in (tmp_path / "scores").iterdir() if p.name.startswith("part-") and p.stat().st_size).read_text())
    assert doc["correct"] == 2 and doc["confusion"]["genuine_bug"] == {"race_condition": 1} and doc["baseline"] is True


def test_corpus_errors(spark, tmp_path):
    assert "contains no cases" in fails(lambda: co.read_corpus(spark, corpus(tmp_path)).collect())
    bad = corpus(tmp_path, case("7", "logs/x.log", "network_timout"))
    assert "case 7 has an invalid label" in fails(lambda: co.read_corpus(spark, bad).collect())
    lost = corpus(tmp_path, case("8", "logs/none.log", "unknown"))
    (tmp_path / "logs" / "other.log").write_text("x")
    joined = co.with_log_text(co.read_corpus(spark, lost), co.read_logs(spark, str(tmp_path / "logs")))
    assert "reading log for case 8" in fails(lambda: joined.collect())


def test_scan_round_trip(spark, tmp_path):
    jobs = j.read_jobs(spark, index(tmp_path / "runs.json", job(1), job(2, "success"), job(3, "skipped")))
    occurrences, summary = w.scan(jobs)
    out = str(tmp_path / "scan")
    rs.write_scan({"repo": "acme/x", "source": "test"}, summary, occurrences, d.occurrence_runs(jobs, occurrences), out)
    back = rs.read_json(spark, f"{out}/occurrences", occurrences.schema)
    assert back.collect() == occurrences.collect()
    assert spark.read.json(f"{out}/runs").count() == 2
    assert spark.read.json(f"{out}/summary").first().repo == "acme/x"


def test_landed_scan_equals_one_made_piece_by_piece(spark, tmp_path):
    rows = [job(n, "success" if n % 3 else "failure", head_sha=f"c{n // 4}", workflow_file=None if n % 5 else "w.yml", started_at=f"2026-08-18T09:{n:02d}:00Z") for n in range(40)]
    rows += [job(90, "skipped", head_sha=""), job(91, "failure", job_name="")]
    jobs = j.read_jobs(spark, index(tmp_path / "runs.json", *rows)).withColumn("repo", F.concat(F.lit("r"), F.col("run_id") % 2))
    for by in ([], ["repo"]):
        occurrences, summary = w.scan(jobs, by=by)
        want = [summary, occurrences, d.occurrence_runs(jobs, occurrences, by)]
        got = rs.land_scan(jobs, str(tmp_path / f"scan{len(by)}"), by=by)
        assert occurrences.count() > 3
        for x, y in zip(got, want):
            assert x.columns == y.columns and sorted(map(repr, x.collect())) == sorted(map(repr, y.collect()))
    empty = rs.land_scan(jobs.limit(0), str(tmp_path / "none"), header={"repo": "acme/x"})
    assert [x.count() for x in empty[1:]] == [0, 0] and (empty[0].first().total_jobs, empty[0].first().repo) == (0, "acme/x")


def test_landed_scan_counts_jobs_once(spark, tmp_path):
    """Totals and flaky signatures share one shuffle, so one scan of the jobs serves both."""
    j.read_jobs(spark, index(tmp_path / "runs.json", job(1), job(2, "success"))).write.parquet(str(tmp_path / "jobs"))
    counted = d.signatures(spark.read.parquet(str(tmp_path / "jobs")))
    both = rs.scan_counts(counted)
    both.collect()
    plan = both._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert plan.count("FileScan parquet") == 1 and "ReusedExchange" in plan


def test_nested_scan_document(spark, tmp_path):
    runs = [job(1, started_at="2026-01-01T00:00:00Z"), job(2, started_at="2026-01-02T00:00:00Z")]
    document = {
        "repo": "acme/x", "source": "s", "generated_at": "2026-01-03T00:00:00Z", "window_days": 7,
        "summary": {"total_jobs": 3, "distinct_commits": 1, "flaky_occurrences": 1, "affected_jobs": 1, "mean_failure_rate": 0.6},
        "occurrences": [{
            "id": "o1", "head_sha": "abc", "branch": "main", "workflow_name": "CI", "workflow_file": "ci.yml",
            "job_name": "unit", "failed_runs": runs, "passed_runs": [job(3, "success")], "total_attempts": 3, "failure_rate": 0.66,
        }, {"id": "o2", "failed_runs": None, "passed_runs": None}],
    }
    path = tmp_path / "scan.json"
    path.write_text(json.dumps(document, indent=2))
    summary, occurrences, flat = rs.read_scan_document(spark, str(path))
    one, two = occurrences.orderBy("id").collect()
    assert (one.primary_failure.job_id, one.last_pass_url, one.failed_runs, summary.first().window_days) == (9002, "u3", 2, 7)
    assert (two.primary_failure, two.failed_runs) == (None, 0)
    assert sorted((r.outcome, r.job_id) for r in flat.collect()) == [("failed", 9001), ("failed", 9002), ("passed", 9003)]


def test_nested_classified_document(spark, tmp_path):
    occurrence = {
        "id": "o1", "head_sha": "abc1234def", "branch": "main", "workflow_name": "CI", "workflow_file": "ci.yml",
        "job_name": "unit", "failed_runs": [job(1, url="https://fail")], "passed_runs": [job(2, "success")],
        "total_attempts": 2, "failure_rate": 0.5,
    }
    verdict = {"category": "infra_flake", "confidence": 0.8, "explanation": "Gone. Really.", "cited_lines": ["x"], "suggested_mitigation": "m"}
    zero = {"category": "", "confidence": 0, "explanation": "", "cited_lines": None, "suggested_mitigation": ""}
    document = {
        "repo": "acme/x", "source": "s", "generated_at": "2026-01-03T00:00:00Z", "provider": "p", "model": "m", "baseline": False,
        "items": [
            {"occurrence": occurrence, "verdict": verdict, "step_name": "Run", "excerpt_len": 9},
            {"occurrence": {**occurrence, "id": "o2"}, "verdict": zero, "step_name": "", "excerpt_len": 0, "error": "downloading log: gone"},
        ],
    }
    path = tmp_path / "classified.json"
    path.write_text(json.dumps(document, indent=2))
    items = rs.read_classified_document(spark, str(path))
    lines = [x.line for x in rp.in_reading_order(rp.report_lines(items, rp.Header("acme/x", "s", datetime(2026, 1, 3), "p", "m", False))).collect()]
    assert "1 flaky occurrence(s) classified." in lines and "### `unit` — Infrastructure flake" in lines
    assert "[Failing run](https://fail) · [Passing rerun](u2)" in lines
    assert lines[-4:-1] == ["### `unit` — ", "", "> Classification failed: downloading log: gone"]
    rp.write_report(items.select("id", "verdict", "error"), rp.Header("acme/y", "s", datetime(2026, 1, 3), "p", "m", False), str(tmp_path / "out"), "json")
    assert {r.repo for r in spark.read.json(str(tmp_path / "out")).collect()} == {"acme/y"}


def test_opened_archives_share_batches_of_bounded_size(monkeypatch):
    """Many small archives leave a task in one batch, and a large one by itself; rows and their order are those of single batches."""
    import pandas as pd

    def packed(*entries):
        buffer = io.BytesIO()
        with zipfile.ZipFile(buffer, "w") as z:
            for name, body in entries:
                z.writestr(name, body)
        return buffer.getvalue()

    contents = [packed((f"{i}_a.txt", f"body {i}"), ("b/2_b.txt", "é" * i), ("n.md", "-")) for i in range(40)] + [b"no zip", None, packed(("n.md", "-"))]
    given = pd.DataFrame({"archive": [f"z{i}" for i in range(43)], "content": contents})
    runs = {}
    for size in (ar.HELD_BYTES, 200, 0):
        monkeypatch.setattr(ar, "HELD_BYTES", size)
        for nested in (False, True):
            found = list(ar._unzipper(nested, None, ar.open_path)(iter([given[:20], given[20:]])))
            runs[size, nested] = len(found), [row for batch in found for row in batch.to_dict("records")]
    (whole, flat), (one, rows) = runs[4 << 20, False], runs[4 << 20, True]
    assert whole == one == 1 and runs[0, True][0] == 43 and 1 < runs[200, False][0] < 43
    for size in (200, 0):
        assert runs[size, False][1] == flat and runs[size, True][1] == rows
    assert [(r["archive"], len(r["steps"]), r["error"] is None) for r in rows] == [(f"z{i}", 2 if i < 40 else 0, i < 40) for i in range(43)]
    assert len(flat) == 83 and [{**s, "archive": r["archive"], "error": None} for r in rows for s in r["steps"]] == flat[:80]
    monkeypatch.undo()
    assert list(ar._unzipper(True, None, ar.open_path)(iter([given[40:]])))[0].shape[0] == 3
