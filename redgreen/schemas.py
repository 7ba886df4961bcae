"""Declared schemas; no reader infers one."""

# One finished job execution.
JOB_COLUMNS = [
    "run_id", "run_attempt", "job_id", "job_name", "workflow_name", "workflow_file",
    "head_sha", "branch", "conclusion", "started_at", "url",
]

# A job as landed in an index document: time as text, plus the log archive's name.
INDEX_JOB = (
    "run_id bigint, run_attempt int, job_id bigint, job_name string, workflow_name string, "
    "workflow_file string, head_sha string, branch string, conclusion string, started_at string, "
    "url string, log_archive string"
)
INDEX_DOCUMENT = f"repo string, jobs array<struct<{INDEX_JOB}>>"

CORPUS_DOCUMENT = (
    "description string, label_policy string, "
    "cases array<struct<id string, log string, expected_category string, note string>>"
)

ARCHIVE_ENTRIES = (
    "archive string, steps array<struct<job_dir string, entry_no int, entry_name string, raw_body string>>, error string"
)
STEP_LOG = "archive string, job_dir string, entry_no int, entry_name string, raw_body string, error string"

VERDICT = (
    "struct<category string, confidence double, explanation string, cited_lines array<string>, "
    "suggested_mitigation string, downgraded boolean, raw_category string, "
    "hallucinated_citations array<string>>"
)

JOB = (
    "struct<run_id bigint, run_attempt int, job_id bigint, job_name string, workflow_name string, "
    "workflow_file string, head_sha string, branch string, conclusion string, started_at timestamp, url string>"
)

OCCURRENCE = (
    "struct<id string, head_sha string, branch string, workflow_name string, workflow_file string, "
    f"job_name string, failed_runs array<{JOB}>, passed_runs array<{JOB}>, total_attempts int, failure_rate double>"
)

SCAN_DOCUMENT = (
    "repo string, source string, generated_at timestamp, window_days int, "
    "summary struct<total_jobs bigint, distinct_commits bigint, flaky_occurrences bigint, "
    f"affected_jobs bigint, mean_failure_rate double>, occurrences array<{OCCURRENCE}>"
)

CLASSIFIED_DOCUMENT = (
    "repo string, source string, generated_at timestamp, provider string, model string, baseline boolean, "
    f"items array<struct<occurrence {OCCURRENCE}, verdict {VERDICT}, step_name string, excerpt_len int, error string>>"
)
