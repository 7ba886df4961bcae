from dataclasses import replace
from datetime import datetime
from urllib.parse import unquote

import pytest
from pyspark.sql import functions as F

from redgreen.operators import report as r
from redgreen.schemas import VERDICT

SCHEMA = (
    "id string, job_name string, head_sha string, branch string, workflow_name string, workflow_file string, "
    f"failure_rate double, total_attempts int, failing_url string, passing_url string, verdict {VERDICT}, error string"
)
HEADER = r.Header("acme/orders-api", "offline fixtures", datetime(2026, 8, 18, 12, 0), "acme-model", "m1", False)
BASELINE = r.Header("acme/orders-api", "tables", datetime(2026, 8, 18, 12, 0), "deterministic", "rule-based-v1", True)


def item(id, job, category, confidence=0.7, error="", cited=(), dropped=(), raw=None, explanation="It broke. Badly."):
    v = None
    if not error:
        v = (category, confidence, explanation, list(cited), "do", raw is not None, raw, list(dropped))
    return (id, job, "4f2a9c1abc", "main", "CI", "ci.yml", 0.5, 2, f"https://t/{id}/fail", f"https://t/{id}/pass", v, error)


def frame(spark, *items):
    return spark.createDataFrame(list(items), SCHEMA)


def text(items, fmt="markdown", header=HEADER, days=7):
    return "\n".join(x.line for x in r.in_reading_order(r.report_lines(items, header, fmt, days)).collect())


@pytest.fixture(scope="module")
def sample(spark):
    return frame(
        spark,
        item("1", "unit", "network_timeout", 0.88, cited=["dial tcp 1.2.3.4:443: i/o timeout\n"]),
        item("2", "pricing", "genuine_bug", 0.71, dropped=["x", "y"]),
        item("3", "lint", "", error="classifying: no"),
        item("4", "unit", "unknown", 0.3, raw="infra_flake"),
        item("5", "deploy", "infra_flake", 0.95),
        item("6", "unit", "network_timeout", 0.90),
    ).cache()


def test_markdown(sample):
    out = text(sample)
    assert out.startswith(
        "# Flake report\n\n**Repository:** `acme/orders-api`  \n**Source:** offline fixtures  \n"
        "**Classifier:** acme-model / m1  \n**Generated:** 2026-08-18 12:00 UTC\n\n## Summary\n\n"
        "5 flaky occurrence(s) classified.\n\n| Category | Count | Share | Typical owner |\n| --- | ---: | ---: | --- |\n"
        "| Network timeout | 2 | 40% | test author |\n| Infrastructure flake | 1 | 20% | platform team |\n"
        "| Genuine bug | 1 | 20% | code owner |\n| Unknown | 1 | 20% | maintainer |\n\n## Occurrences\n\n"
        "### `pricing` — Genuine bug\n\n- **Commit:** `4f2a9c1` on `main`\n- **Workflow:** CI (`ci.yml`)\n"
        "- **Failure rate:** 50% (2 attempts)\n- **Confidence:** 0.71\n\nIt broke. Badly.\n\n"
        "> 2 cited line(s) were dropped because they do not appear in the log excerpt.\n\n**Mitigation** — "
    )
    order = [out.index(f"### `{j}` — {c}") for j, c in [
        ("pricing", "Genuine bug"), ("deploy", "Infra"), ("unit", "Network"), ("unit", "Unknown"), ("lint", "")]]
    assert order == sorted(order)
    assert "**Evidence**\n\n```\ndial tcp 1.2.3.4:443: i/o timeout\n```\n" in out
    assert "- **Note:** demoted to unknown from `infra_flake` for low confidence" in out
    assert "[Failing run](https://t/1/fail) · [Passing rerun](https://t/1/pass)\n\n---" in out
    assert "### `lint` — \n\n> Classification failed: classifying: no\n" in out
    assert "NOTE" not in out


def test_detail_order(sample):
    rows = r.ordered_detail(r.detail(sample)).collect()
    assert [x.id for x in rows] == ["2", "5", "6", "1", "4", "3"]
    assert (rows[0].severity, rows[0].dropped_citations, rows[0].fail_rate, rows[0]["commit"]) == (5, 2, "50%", "4f2a9c1")
    assert (rows[4].demoted_from, rows[5].error, rows[5].severity) == ("infra_flake", "classifying: no", 0)


def test_issue(sample):
    out = text(sample, "issue")
    assert "Found **5 flaky occurrence(s)**" in out and "Classified by `acme-model / m1`." in out
    heads = [x for x in out.split("\n") if x.startswith("### ")]
    assert heads == ["### Genuine bug (1)", "### Infrastructure flake (1)", "### Network timeout (2)", "### Unknown (1)"]
    assert out.index("confidence 0.90") < out.index("confidence 0.88")
    assert "- [ ] `pricing` — It broke. _(commit `4f2a9c1`, 50% failure rate, confidence 0.71)_" in out
    assert out.count("<details>") == 4 and out.endswith("---\n" + r.FOOTER)
    groups = r.ordered_issue_groups(r.issue_groups(sample)).collect()
    assert [(g.category, g.group_size) for g in groups][2:4] == [("network_timeout", 2)] * 2


def test_digest(sample):
    out = text(sample, "digest", days=14)
    assert out.startswith("## Flake digest — last 14 days\n\n`acme/orders-api` · classified by acme-model / m1\n\n**5 flaky")
    assert "across **3 job(s)**" in out and "> ⚠️ 1 occurrence(s) look like a **genuine bug**" in out
    assert "**Noisiest jobs**\n\n1. `unit` — 3 occurrence(s)\n2. `deploy` — 1 occurrence(s)\n3. `pricing`" in out
    assert "| Race condition" not in out


def test_noisiest_jobs_stop_at_five(spark):
    items = frame(spark, *[item(str(i), f"job{i % 8}", "unknown") for i in range(20)])
    rows = r.noisiest_jobs(r.tally(items)).collect()
    assert [(x.job_name, x.n) for x in rows] == [("job0", 3), ("job1", 3), ("job2", 3), ("job3", 3), ("job4", 2)]


def test_baseline_is_marked_everywhere(sample):
    for fmt in ("markdown", "issue", "digest"):
        out = text(sample, fmt, BASELINE)
        assert "deterministic / rule-based-v1 — rule-based baseline, not a language model" in out
    assert "> [!NOTE]" in text(sample, "md", BASELINE)
    assert "> Verdicts below come from the deterministic" in text(sample, "issue", BASELINE)


def test_empty_results(spark):
    for items in (frame(spark), frame(spark, item("1", "unit", "", error="x"))):
        assert "No flaky occurrences were classified." in text(items)
        assert text(items, "issue").endswith("Nothing to action. 🎉")
        assert text(items, "digest").endswith("Every job agreed with itself on every commit.")
    assert "## Occurrences" not in text(frame(spark))
    assert "## Occurrences" in text(frame(spark, item("1", "unit", "", error="x")))


def test_written_report(spark, sample, tmp_path):
    r.write_report(sample, HEADER, str(tmp_path / "md"))
    parts = sorted(p for p in (tmp_path / "md").iterdir() if p.name.startswith("part-"))
    assert "".join(p.read_text() for p in parts).rstrip("\n") == text(sample).rstrip("\n")
    r.write_report(sample, HEADER, str(tmp_path / "json"), "json")
    assert spark.read.json(str(tmp_path / "json")).count() == 6
    with pytest.raises(ValueError, match="unknown report format"):
        r.write_report(sample, HEADER, str(tmp_path / "x"), "pdf")


def test_one_report_for_each_repository(spark, sample, tmp_path):
    """Every repository's text equals the report of its items alone, also without items; one job writes them all."""
    zones = spark.conf.get("spark.sql.session.timeZone")
    others = frame(spark, item("7", "unit", "genuine_bug", 0.9), item("8", "e2e", "genuine_bug", 0.9), item("9", "e2e", "", error="gone"))
    headers = {"acme/a": HEADER, "acme/b c": BASELINE, "acme/none": BASELINE}
    items = sample.withColumn("repo", F.lit("acme/a")).unionByName(others.withColumn("repo", F.lit("acme/b c")))
    rows = [(n, h.source, h.generated_at, h.provider, h.model, h.baseline) for n, h in headers.items()]
    table = spark.createDataFrame(rows, "repo string, source string, generated_at timestamp, provider string, model string, baseline boolean")
    for fmt in ("markdown", "issue", "digest"):
        r.write_reports(items, table, str(tmp_path / fmt), fmt)
        for name, h in headers.items():
            own = items.where(F.col("repo") == name).drop("repo")
            want = text(own, fmt, replace(h, repo=name))
            folder = next(p for p in (tmp_path / fmt).iterdir() if unquote(p.name) == f"repo={name}")
            got = "".join(p.read_text() for p in sorted(folder.iterdir()) if p.name.startswith("part-"))
            assert got == want + "\n"
    r.write_reports(items, table, str(tmp_path / "json"), "json")
    back = spark.read.json(str(tmp_path / "json"))
    assert back.count() == items.count() and {(x.repo, x.provider) for x in back.collect()} == {("acme/a", "acme-model"), ("acme/b c", "deterministic")}
    assert zones == spark.conf.get("spark.sql.session.timeZone")


def test_items_without_a_header_are_an_error(spark, sample):
    headers = spark.createDataFrame([("x", "s", HEADER.generated_at, "p", "m", False)], "repo string, source string, generated_at timestamp, provider string, model string, baseline boolean")
    with pytest.raises(Exception, match="no header for repository acme/lost"):
        r.repository_lines(sample.withColumn("repo", F.lit("acme/lost")), headers).collect()


def test_a_thousand_repositories_in_one_job(spark, tmp_path):
    """A hot repository spreads over many files; the others have theirs."""
    rows = [item(f"{i:05d}", f"job{i % 7}", "infra_flake", 0.5 + i % 5 / 10) for i in range(3000)]
    repo = F.when(F.col("id") < "02000", F.lit("hot")).otherwise(F.concat(F.lit("r"), F.col("id")))
    items = frame(spark, *rows).withColumn("repo", repo)
    headers = items.select("repo").distinct().select("repo", F.lit("s").alias("source"), F.lit(HEADER.generated_at).alias("generated_at"), F.lit("p").alias("provider"), F.lit("m").alias("model"), F.lit(False).alias("baseline"))
    before = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.coalescePartitions.enabled", "spark.sql.shuffle.partitions")}
    try:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        spark.conf.set("spark.sql.shuffle.partitions", "16")
        r.write_reports(items, headers, str(tmp_path / "out"))
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert len([p for p in (tmp_path / "out").iterdir() if p.name.startswith("repo=")]) == 1001
    hot = sorted(p for p in (tmp_path / "out" / "repo=hot").iterdir() if p.name.startswith("part-"))
    assert len(hot) > 4
    lines = "".join(p.read_text() for p in hot).split("\n")
    assert "\n".join(lines[:-1]) == text(items.where("repo = 'hot'").drop("repo"), "markdown", replace(HEADER, repo="hot", source="s", provider="p", model="m"))
