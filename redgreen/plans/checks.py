"""The same results in ANSI-style SQL, written apart from the operators.

Log work here goes through line lists and window functions, matching through an
RE2 engine and the original patterns, so agreement is not agreement with itself.
Rules, markers and texts are taken from the operators; that these are right is
not for this module to show, ``tests/test_fixed_values.py`` pins them by literals.
"""

from __future__ import annotations

from redgreen.functions.logs import ANCHOR_MARKERS, DROPPED_HEAD, ELISION, FAILURE_MARKERS
from redgreen.functions.rules import RULES
from redgreen.functions.text import SPACE
from redgreen.operators import report as r
from redgreen.operators import responses as rs
from redgreen.operators.classify import NO_MATCH_TEXT
from redgreen.operators.taxonomy import CATEGORIES, CODES
from redgreen.plans.adapters import MARKED_LINES, STEP_NAMES
from redgreen.plans.catalog import HEADER, STRICT_FLOOR, WINDOW_AS_OF, WINDOW_DAYS, WINDOW_WORKFLOW

CHECKS: dict[str, str] = {}


def q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def pick(index: str, values: list[str]) -> str:
    return f"list_extract([{', '.join(map(q, values))}], cast({index} as bigint) + 1)"


def utrim(text: str) -> str:
    return f"trim({text}, {q(SPACE)})"


def with_ctes(ctes: list[str], body: str) -> str:
    return "with " + ",\n".join(ctes) + "\n" + body


def percent(rate: str) -> str:
    return f"printf('%.0f', ({rate}) * 100) || '%'"


NL = "chr(10)"

JOB_ID = "l_orderkey || '-' || l_partkey || '-' || l_suppkey || '-' || l_linenumber"
JOBS = f"""jobs as (
  select l_orderkey as run_id, cast(l_linenumber as integer) as run_attempt, {JOB_ID} as job_id,
    'job-' || l_linestatus as job_name, 'Workflow ' || l_linenumber as workflow_name,
    lower(substr(o_orderpriority, 3)) || '.yml' as workflow_file, md5(cast(l_orderkey as varchar)) as head_sha,
    o_orderstatus as branch,
    case when l_returnflag = 'A' then 'success' when l_returnflag = 'N' then 'failure'
      when l_quantity < 20 then 'cancelled' when l_quantity < 35 then 'timed_out' else 'skipped' end as conclusion,
    l_shipdate as started_at, 'https://ci.example/job/' || ({JOB_ID}) as url, o_orderdate as created_at
  from lineitem join orders on l_orderkey = o_orderkey)"""

IN_ORDER = "order by started_at, run_id, run_attempt, job_id"


def flaky(source: str = "jobs", at_least: int = 2) -> str:
    last = {f: f"last({f} {IN_ORDER}) filter (where conclusion <> 'success')" for f in ("run_id", "run_attempt", "job_id", "started_at", "url")}
    return f"""flaky as (
  select substr(sha256(head_sha || chr(0) || workflow_file || chr(0) || job_name || chr(0)), 1, 12) as id,
    head_sha, workflow_file, job_name, count(*) as total_attempts,
    count(*) filter (where conclusion <> 'success') as failed_runs,
    count(*) filter (where conclusion = 'success') as passed_runs,
    first(branch {IN_ORDER}) as branch, first(workflow_name {IN_ORDER}) as workflow_name,
    {', '.join(f'{v} as last_{k}' for k, v in last.items())},
    count(*) filter (where conclusion <> 'success') / count(*) as rate
  from {source}
  where conclusion in ('success', 'failure', 'timed_out') and head_sha <> '' and job_name <> ''
  group by head_sha, workflow_file, job_name
  having count(*) >= {at_least} and bool_or(conclusion = 'success') and bool_or(conclusion <> 'success'))"""


CHECKS["flaky_occurrences"] = with_ctes(
    [JOBS, flaky()],
    """select id, head_sha, branch, workflow_name, workflow_file, job_name, total_attempts, failed_runs, passed_runs,
  round(rate, 9) as failure_rate from flaky""",
)
CHECKS["flaky_runs"] = with_ctes(
    [JOBS, flaky()],
    """select f.id, case when conclusion = 'success' then 'passed' else 'failed' end as outcome, run_id, run_attempt,
  job_id, conclusion, started_at, url
from jobs j join flaky f on j.head_sha = f.head_sha and j.workflow_file = f.workflow_file and j.job_name = f.job_name
where conclusion in ('success', 'failure', 'timed_out')""",
)
CHECKS["ordered_runs"] = CHECKS["flaky_runs"]
CHECKS["ranked_occurrences"] = with_ctes([JOBS, flaky()], "select id, job_name, round(rate, 9) as failure_rate from flaky")
CHECKS["index_documents"] = with_ctes(
    [JOBS],
    """select 'acme/' || run_id % 5 as repo, run_id, run_attempt, run_id * 10 + run_attempt as job_id, job_name, conclusion,
  cast(started_at as timestamp) as started_at, run_id || '.zip' as log_archive from jobs""",
)
CHECKS["job_lines"] = with_ctes(
    [JOBS],
    """select run_id, run_attempt, run_id * 10 + run_attempt as job_id, case when branch = 'P' then '' else branch end as branch,
  conclusion, cast(started_at as timestamp) as started_at from jobs""",
)
CHECKS["primary_failures"] = with_ctes(
    [JOBS, flaky()],
    """select id, job_name, last_run_id as run_id, last_run_attempt as run_attempt, last_job_id as job_id,
  last_started_at as started_at, last_url as url from flaky""",
)
CHECKS["scan_summary"] = with_ctes(
    [JOBS, flaky()],
    """select (select count(*) from jobs) as total_jobs, (select count(distinct head_sha) from jobs) as distinct_commits,
  count(*) as flaky_occurrences, count(distinct job_name) as affected_jobs,
  round(coalesce(avg(rate), 0), 9) as mean_failure_rate from flaky""",
)
CHECKS["scan_table"] = with_ctes(
    [JOBS, flaky()],
    f"""select id, job_name, substr(head_sha, 1, 7) as "commit", workflow_file, {percent('rate')} as fail_rate,
  total_attempts as attempts from flaky""",
)
CHECKS["min_attempts_3"] = with_ctes(
    [JOBS, flaky(at_least=3)], "select id, total_attempts, round(rate, 9) as failure_rate from flaky"
)
CHECKS["workflow_window_scan"] = with_ctes(
    [
        JOBS,
        f"""kept as (select * from jobs where workflow_file = {q(WINDOW_WORKFLOW)}
  and created_at >= date '{WINDOW_AS_OF}' - interval {WINDOW_DAYS} day)""",
        flaky("kept"),
    ],
    "select id, workflow_file, total_attempts, round(rate, 9) as failure_rate from flaky",
)
CHECKS["recent_runs_cap"] = with_ctes(
    [JOBS, "newest as (select o_orderkey from orders order by o_orderdate desc, o_orderkey limit 200)"],
    "select run_id, run_attempt, job_id, conclusion from jobs where run_id in (select o_orderkey from newest)",
)
CHECKS["attempt_flattening"] = with_ctes(
    [JOBS],
    """select run_id, run_attempt, job_id from jobs
where run_attempt between 1 and greatest(run_id % 7, 1)""",
)
CHECKS["every_attempt"] = """
select o_orderkey as run_id, cast(unnest(range(1, greatest(o_orderkey % 7, 1) + 1)) as integer) as run_attempt
from orders"""

CHECKS["landed_scan"] = with_ctes(
    [JOBS, flaky()],
    """select 'summary' as kind, '' as id, (select count(*) from jobs) as n, (select count(distinct head_sha) from jobs) as m,
  round(avg(rate), 9) as rate, null as job_id from flaky
union all select 'occurrence', id, total_attempts, failed_runs, round(rate, 9), last_job_id from flaky
union all select case when conclusion = 'success' then 'passed' else 'failed' end, f.id, run_id, run_attempt, null, job_id
from jobs j join flaky f on j.head_sha = f.head_sha and j.workflow_file = f.workflow_file and j.job_name = f.job_name
where conclusion in ('success', 'failure', 'timed_out')""",
)
CHECKS["landed_batches"] = with_ctes(
    [JOBS],
    """select run_id, run_attempt, job_id, job_name, conclusion, strftime(date_trunc('month', started_at), '%Y-%m-%d') as day
from (select * replace (case when run_id % 3 > 0 then 'success' else conclusion end as conclusion) from jobs)
qualify row_number() over (partition by run_id, run_attempt, job_id
  order by job_name desc, workflow_name desc, workflow_file desc, head_sha desc, branch desc, conclusion desc, started_at desc) = 1""",
)
CHECKS["live_detection"] = with_ctes(
    [
        JOBS,
        """merged as (select * from (select * replace (case when run_id % 3 > 0 then 'success' else conclusion end as conclusion) from jobs)
  qualify row_number() over (partition by run_id, run_attempt, job_id
    order by job_name desc, workflow_name desc, workflow_file desc, head_sha desc, branch desc, conclusion desc, started_at desc) = 1)""",
        flaky("merged"),
    ],
    """select id, head_sha, branch, workflow_name, workflow_file, job_name, total_attempts, failed_runs, round(rate, 9) as failure_rate from flaky""",
)
PASSED_LAST = "last(url order by started_at, run_id, run_attempt, job_id) filter (where conclusion = 'success') as passed_url,"
CHECKS["landed_detection"] = with_ctes(
    [
        JOBS,
        """kept as (select * from jobs where date_trunc('month', started_at) in
  (select date_trunc('month', o_orderdate) from orders where year(o_orderdate) = 1996))""",
        flaky("kept").replace("count(*) as total_attempts,", f"count(*) as total_attempts, {PASSED_LAST}"),
    ],
    """select id, workflow_file, total_attempts, failed_runs, round(rate, 9) as failure_rate, passed_url as last_pass_url from flaky""",
)

CHECKS["timestamp_normalise"] = """
select event_id,
  case when event_id % 6 in (0, 1, 2) then ts
    when event_id % 6 = 3 then ts - interval 2 hour end as parsed,
  event_id % 6 = 5 as rejected
from events"""
CHECKS["step_names"] = """
select p_partkey, cast(case when p_partkey % 5 in (0, 3) then p_size else 0 end as bigint) as step_order,
  case p_partkey % 5 when 0 then p_name when 1 then p_name when 2 then '_' || p_name
    when 3 then p_name || '_v1.2' else 'x' || p_size || '_' || p_name end as step_name
from part"""

STAMPED = """stamped as (
  select doc_id, text, '2024-05-01T10:00:00.0000000Z '
    || replace(text, chr(10), chr(13) || chr(10) || '2024-05-01T10:00:01.1234567Z ') || chr(10) || text as raw_body
  from documents)"""


def unstamped(raw: str) -> str:
    """Strip stamps line by line: longer than 28 bytes, marks in place, first blank within 34 bytes."""
    line = """case when strlen(l) > 28 and substr(l, 5, 1) = '-' and substr(l, 8, 1) = '-' and substr(l, 11, 1) = 'T'
    and instr(l, ' ') between 2 and 34 then substr(l, instr(l, ' ') + 1) else l end"""
    lines = f"string_split(replace({raw}, chr(13) || chr(10), chr(10)), chr(10))"
    return f"array_to_string(list_transform({lines}, lambda l: {line}), chr(10))"


CHECKS["normalise_lines"] = with_ctes([STAMPED], f"select doc_id, md5({unstamped('raw_body')}) as body from stamped")
CHECKS["archive_ingest"] = with_ctes(
    [STAMPED],
    f"""select cast(doc_id as varchar) as archive, '.' as job_dir, cast(3 as bigint) as step_order,
  'Run tests' as step_name, 0 as entry_no, md5({unstamped('raw_body')}) as body, false as unreadable
from stamped where doc_id % 10 <> 9
union all
select cast(doc_id as varchar), 'build', 1, 'Set up job', 1, md5({unstamped('text')}), false
from stamped where doc_id % 10 <> 9
union all
select cast(doc_id as varchar), '.', 0, 'Summary', 2, md5('no number'), false from stamped where doc_id % 10 <> 9
union all
select cast(doc_id as varchar), null, 0, null, null, null, true from stamped where doc_id % 10 = 9""",
)
LOOKED = """listed as (
  select job_id, min(case when run_id % 11 = 4 then '' when run_id % 7 = 2 then 'logs/gone-' || run_id || '.zip'
    else 'logs/' || run_id % (select count(*) // 4 from documents) || '.zip' end) as log_archive
  from jobs where conclusion = 'failure' group by job_id),
looked as (
  select f.*, l.log_archive, case when l.job_id is null then 'no job with id ' || f.last_job_id
    when l.log_archive = '' then 'job ' || f.last_job_id || ' has no log archive' end as log_error
  from flaky f left join listed l on l.job_id = f.last_job_id)"""
CHECKS["job_log_lookup"] = with_ctes([JOBS, flaky(), LOOKED], "select id, last_job_id as job_id, log_archive, log_error from looked")

# Step logs and excerpts

STEPS = f"""steps as materialized (
  select *, '$ make test' || {NL} || text || {NL} || {pick('k', [x for x, _ in MARKED_LINES])} || {NL} || text as body
  from (
    select doc_id, text, cast(floor(doc_id / 4) as bigint) as archive, doc_id % 4 + 1 as step_order,
      {pick('doc_id % 4', STEP_NAMES)} as step_name, (doc_id * 7 + cast(floor(doc_id / 4) as bigint)) % 16 as k
    from documents))"""


def collapsed_lines(lines: str) -> str:
    return (
        f"list_filter({lines}, lambda x, i: not ({utrim('x')} = '' and i > 1 and "
        f"{utrim(f'{lines}[i - 1]')} = ''))"
    )


SPREAD = f"string_split(replace(text, '. ', {q('.' + chr(10) + chr(0xA0) + chr(9) + chr(10) + ' ' + chr(10) * 2 + chr(0x3000))}), {NL})"
CHECKS["blank_lines"] = f"""
select doc_id, md5(kept) as body, cast(strlen(kept) as integer) as bytes
from (select doc_id, array_to_string({collapsed_lines('lines')}, {NL}) as kept
  from (select doc_id, {SPREAD} as lines from documents))"""


def score(name: str, body: str) -> str:
    points = " + ".join(
        f"(case when contains(lower({body}), {q(m)}) then {len(FAILURE_MARKERS) - i} else 0 end)"
        for i, m in enumerate(FAILURE_MARKERS)
    )
    return f"case when lower({name}) like 'post %' or lower({name}) = 'complete job' then 0 else {points} end"


CHOSEN = f"""chosen as (
  select * from (
    select *, row_number() over (partition by archive order by score desc, step_order desc) as place
    from (select *, {score('step_name', 'body')} as score from steps))
  where place = 1)"""
CHECKS["failing_step"] = with_ctes(
    [STEPS, CHOSEN], "select archive, step_order, step_name, score from chosen"
)


def excerpts(source: str, max_chars: int = 12000, before: int = 60, after: int = 25, head: int = 12) -> list[str]:
    marked = " or ".join(f"contains(lower(x), {q(m)})" for m in ANCHOR_MARKERS)
    return [
        f"lined as (select *, string_split(body, {NL}) as raw_lines from {source})",
        f"kept as (select *, {collapsed_lines('raw_lines')} as lines from lined)",
        f"""anchored as (select *, array_to_string(lines, {NL}) as collapsed,
  list_max(list_transform(lines, lambda x, i: case when {marked} then i end)) as spot from kept)""",
        f"""blocks as (select *,
  case when spot is null then collapsed
    else array_to_string(lines[greatest(1, spot - {before}):least(len(lines), spot + {after})], {NL}) end as block,
  case when len(lines) > {head} then array_to_string(lines[1:{head}], {NL}) else '' end as head from anchored)""",
        f"""joined as (select *, case when head <> '' and not contains(block, head) then head || {q(ELISION)} || block
  else block end as long_text from blocks)""",
        f"""excerpts as (select *,
  case when strlen(long_text) > {max_chars} and length(long_text) > {max_chars}
    then {q(DROPPED_HEAD)} || right(long_text, {max_chars}) else long_text end as excerpt,
  strlen(long_text) > {max_chars} or strlen(long_text) < strlen(collapsed) as truncated from joined)""",
    ]


EXCERPT_COLUMNS = """step_name, md5(excerpt) as text, cast(strlen(body) as integer) as original_bytes,
  cast(strlen(excerpt) as integer) as excerpt_bytes, truncated"""
CHECKS["excerpt_anchor_window"] = with_ctes(
    [STEPS, *excerpts("steps")], "select doc_id, cast(spot - 1 as integer) as anchor, md5(block) as block from excerpts"
)
CHECKS["excerpt_assembled"] = with_ctes(
    [STEPS, *excerpts("steps")], f"select doc_id, {EXCERPT_COLUMNS} from excerpts"
)
CHECKS["excerpt_small_budget"] = with_ctes(
    [STEPS, *excerpts("steps", 700, 4, 2, 3)], f"select doc_id, {EXCERPT_COLUMNS} from excerpts"
)
CHECKS["archive_excerpts"] = with_ctes(
    [STEPS, CHOSEN, *excerpts("chosen")], f"select archive, {EXCERPT_COLUMNS} from excerpts"
)
ZIPPED = f"""zipped as materialized (
  select doc_id, cast(doc_id as varchar) as archive, '.' as job_dir, 3 as step_order, 0 as entry_no, 'Run tests' as step_name,
    {unstamped('raw_body')} as body from stamped where doc_id % 10 <> 9
  union all select doc_id, cast(doc_id as varchar), 'build', 1, 1, 'Set up job', {unstamped('text')} from stamped where doc_id % 10 <> 9
  union all select doc_id, cast(doc_id as varchar), '.', 0, 2, 'Summary', 'no number' from stamped where doc_id % 10 <> 9),
best as (select * from (select *, row_number() over (partition by archive
    order by {score('step_name', 'body')} desc, job_dir desc, step_order desc, entry_no desc) as place from zipped) where place = 1)"""
CHECKS["zipped_excerpts"] = with_ctes(
    [STAMPED, ZIPPED, *excerpts("best")],
    f"""select archive, {EXCERPT_COLUMNS} from excerpts
union all select cast(doc_id as varchar), null, null, null, null, null from documents where doc_id % 10 = 9""",
)

CHECKS["corpus_cases"] = with_ctes(
    [STEPS],
    f"""select cast(doc_id as varchar) as id, {pick('k', [x for _, x in MARKED_LINES])} as expected_category,
  'file:/corpora/' || doc_id // 16 || '/logs/' || doc_id || '.log' as log_path, md5(body) as excerpt from steps""",
)

# Rules and verdicts

TAXONOMY = "taxonomy(category, ord, label, severity, short, owner, summary, steps) as (values " + ", ".join(
    f"({q(c.code)}, {i}, {q(c.label)}, {c.severity}, {q(c.short)}, {q(c.owner)}, {q(c.summary)}, "
    f"[{', '.join(map(q, c.steps))}])"
    for i, c in enumerate(CATEGORIES)
) + ")"


def hits(source: str, key: str, text: str) -> str:
    one = "\n  union all ".join(
        f"select {key}, {i} as rule, {q(x.category)} as category, cast({x.weight} as double) as weight, "
        f"{utrim(f'list_filter(string_split({text}, {NL}), lambda l: regexp_matches(l, {q(x.pattern)}))[1]')} as line "
        f"from {source} where regexp_matches({text}, {q(x.pattern)})"
        for i, x in enumerate(RULES)
    )
    return f"hits as materialized (\n  {one})"


def verdicts(source: str, key: str, floor: float) -> list[str]:
    """From ``hits``: the floored verdict of every row of ``source``."""
    return [
        TAXONOMY,
        f"scores as (select {key}, category, sum(weight) as score, count(*) as matched from hits group by all)",
        f"""ranked as (select *, row_number() over (partition by {key} order by score desc, category) as place,
  coalesce(lead(score) over (partition by {key} order by score desc, category), 0.0) as second from scores)""",
        f"""cites as (select {key}, list(line order by rule)[1:3] as cited from (
    select h.{key}, h.line, min(h.rule) as rule from hits h
    join ranked w on w.{key} = h.{key} and w.category = h.category and w.place = 1 group by all)
  group by {key})""",
        f"""raw_verdicts as (select s.*, coalesce(w.category, 'unknown') as raw_category,
    case when w.category is null then 0.2
      else least(0.92, 0.45 + cast(0.10 as double) * w.score + cast(0.08 as double) * (w.score - w.second)) end as confidence,
    case when w.category is null then {q(NO_MATCH_TEXT)}
      else 'Matched ' || case when matched = 1 then '1 pattern' else matched || ' patterns' end || ' for ' || t.label
        || '. rule-based baseline (no language model involved).' end as explanation,
    coalesce(c.cited, []) as cited, w.score, w.second
  from {source} s left join ranked w on w.{key} = s.{key} and w.place = 1
  left join cites c on c.{key} = s.{key} left join taxonomy t on t.category = w.category)""",
        f"""verdicts as (select *, raw_category <> 'unknown' and confidence < {floor} as downgraded,
  case when confidence < {floor} then 'unknown' else raw_category end as category from raw_verdicts)""",
    ]


BODY_HITS = [STEPS, hits("steps", "doc_id", "body")]
CHECKS["rule_hits"] = with_ctes(BODY_HITS, "select doc_id, rule, category, weight, line from hits")
CHECKS["rule_scores"] = with_ctes(
    [*BODY_HITS, *verdicts("steps", "doc_id", 0.5)],
    "select doc_id, raw_category as category, score, second as runner_up from verdicts where score is not null",
)
CHECKS["rule_verdicts"] = with_ctes(
    [*BODY_HITS, *verdicts("steps", "doc_id", 0)],
    """select doc_id, v.category, round(confidence, 9) as confidence, explanation, t.summary as suggested_mitigation
from verdicts v join taxonomy t on t.category = v.category""",
)
PHRASES = f"""phrases as (select min(doc_id) as rule, lower(p) as phrase from (
    select doc_id, regexp_extract(coalesce(text, ''), '^[A-Za-z]+ [A-Za-z]+ [A-Za-z]+') as p from documents) where p <> '' group by all),
ruled as (select rule, phrase, {pick('rule % 6', [c for c in CODES if c != 'unknown'])} as category, (rule % 4 + 1) / 2.0 as weight,
  cast(row_number() over (order by rule) - 1 as integer) as place from phrases),
hits as materialized (select doc_id, place as rule, category, cast(weight as double) as weight,
  {utrim("list_filter(string_split(text, chr(10)), lambda l: contains(lower(l), phrase))[1]")} as line
  from documents join ruled on contains(lower(text), phrase))"""
CHECKS["user_rule_hits"] = with_ctes([PHRASES], "select doc_id, rule, category, weight, md5(line) as line from hits")
CHECKS["user_rule_verdicts"] = with_ctes(
    [PHRASES, "texts as (select doc_id from documents)", *verdicts("texts", "doc_id", 0)],
    "select doc_id, category, round(confidence, 9) as confidence, cast(len(cited) as integer) as n_cited from verdicts",
)
CHECKS["rule_citations"] = with_ctes(
    [*BODY_HITS, *verdicts("steps", "doc_id", 0)],
    f"select doc_id, array_to_string(cited, {NL}) as cited, cast(len(cited) as integer) as n_cited from verdicts",
)
CHECKS["confidence_floor"] = with_ctes(
    [*BODY_HITS, *verdicts("steps", "doc_id", STRICT_FLOOR)],
    """select doc_id, category, downgraded, case when downgraded then raw_category else '' end as raw_category
from verdicts""",
)
CHECKS["citation_check"] = f"""
select doc_id, md5(array_to_string(list_filter(lines, lambda x: {utrim('x')} <> '' and contains(text, {utrim('x')})), '|')) as kept,
  md5(array_to_string(list_filter(lines, lambda x: {utrim('x')} <> '' and not contains(text, {utrim('x')})), '|')) as invented,
  cast(len(list_filter(lines, lambda x: {utrim('x')} <> '' and contains(text, {utrim('x')}))) as integer) as n_kept,
  cast(len(list_filter(lines, lambda x: {utrim('x')} <> '' and not contains(text, {utrim('x')}))) as integer) as n_invented
from (select d.doc_id, d.text, [' ' || chr(9) || string_split(d.text, {NL})[1] || chr(160), string_split(d.text, {NL})[-1] || {NL},
    coalesce(b.text, '  '), '   ', 'an invented line'] as lines
  from documents d left join benchmark b on d.doc_id = b.item_id)"""
CHECKS["citation_index"] = CHECKS["citation_check"]

# Model responses

RESPONSES = f"""responses as (
  select conv_id * 1000 + turn as id, (conv_id + turn) % 8 as form, {pick('conv_id % 7', CODES)} as category,
    (turn % 11) / 10.0 as confidence, coalesce(text, '') as explanation, role as job_name,
    turn
  from conversations)"""
ROUND_ONE = f"""round_one as (select *, form in (0, 1, 2, 7) and {utrim('explanation')} <> '' as usable, id % 13 = 12 as lost
  from responses)"""
VERDICT_ROWS = """rows as (select id, case when (id % 1000) % 4 = 3 then 'cosmic_rays' else category end as category,
  (id % 15 - 2) / 10.0 as confidence, case when id % 11 = 0 then '' else explanation end as explanation from responses)"""

CHECKS["verdict_validation"] = with_ctes(
    [RESPONSES, VERDICT_ROWS],
    f"""select id, reason is null as valid, reason as invalid_reason from (
  select id, case when category = 'cosmic_rays' then 'unknown category cosmic_rays'
    when confidence < 0 or confidence > 1 then 'confidence ' || printf('%.3f', cast(confidence as double)) || ' outside [0,1]'
    when {utrim('explanation')} = '' then 'empty explanation' end as reason from rows)""",
)
CHECKS["taxonomy_join"] = with_ctes(
    [RESPONSES, VERDICT_ROWS, TAXONOMY],
    f"""select id, r.category, coalesce(t.label, r.category) as label, coalesce(t.severity, 0) as severity,
  coalesce(t.owner, u.owner) as owner, coalesce(t.summary, u.summary) as mitigation,
  array_to_string(coalesce(t.steps, u.steps), {NL}) as mitigation_steps
from rows r left join taxonomy t on t.category = r.category
join taxonomy u on u.category = 'unknown'""",
)
REQUEST = f"""requests as (select id, form, 'Job: ' || job_name || {q(rs.PROMPT_BEFORE_STEP)}
  || case when form = 0 then '(unknown step)' else 'Run tests' end || {q(rs.PROMPT_BEFORE_EXCERPT)} || explanation
  || {q(rs.PROMPT_END)} as prompt from responses)"""
CHECKS["prompts"] = with_ctes([RESPONSES, REQUEST], f"select id, md5(prompt) as prompt, md5({q(rs.SYSTEM_PROMPT)}) as system from requests")
CHECKS["parsed_responses"] = with_ctes(
    [RESPONSES, ROUND_ONE],
    f"""select id, not usable as malformed, case when usable then category end as category,
  case when usable then round(cast(confidence as double), 9) end as confidence,
  case when usable then {utrim('explanation')} end as explanation, case when usable then 'a {{b}} c' end as cited,
  case when usable then 'retry' end as mitigation
from round_one where not lost""",
)
CHECKS["repair_requests"] = with_ctes(
    [RESPONSES, ROUND_ONE, REQUEST],
    f"""select r.id, md5(r.prompt || {NL} || {NL} || {q(rs.REPAIR_SUFFIX)}) as prompt
from requests r join round_one o on o.id = r.id where not usable and not lost""",
)
CHECKS["repair_round"] = with_ctes(
    [RESPONSES, ROUND_ONE],
    f"""select id, case when outcome = 'answered' then category end as category, outcome from (
  select *, case when lost then 'connection reset' when usable or (form in (3, 6) and {utrim('explanation')} <> '')
    then 'answered' else 'malformed twice' end as outcome from round_one)""",
)

ANSWERS = f"""answers as (
  select id, explanation, case when id % 4 = 1 then 'unknown' else category end as expected,
    case when error = '' then case when confidence < 0.5 then 'unknown' else category end end as predicted,
    case when error = '' then cast(confidence as double) else 0 end as confidence,
    case when error = '' and not contains(explanation, 'a {{b}} c') then 1 else 0 end as hallucinated, error
  from (select *, case when lost then 'connection reset' when usable or (form in (3, 6) and {utrim('explanation')} <> '')
    then '' else 'malformed twice' end as error from round_one))"""
CHECKS["eval_responses"] = with_ctes(
    [RESPONSES, ROUND_ONE, ANSWERS],
    """select count(*) as total, count(*) filter (where predicted = expected) as correct,
  count(*) filter (where error <> '') as errored,
  round(count(*) filter (where predicted = expected) / count(*) filter (where error = ''), 9) as accuracy,
  round(avg(confidence) filter (where predicted = expected), 9) as mean_confidence_correct,
  round(avg(confidence) filter (where error = '' and predicted <> expected), 9) as mean_confidence_wrong,
  cast(sum(hallucinated) as bigint) as hallucinated_citations from answers""",
)
CHECKS["response_listing"] = with_ctes(
    [RESPONSES, ROUND_ONE, ANSWERS],
    """select case when error <> '' then 'ERR' when predicted = expected then 'PASS' else 'FAIL' end as mark, id as case_id,
  expected, coalesce(predicted, '') as predicted, printf('%.2f', confidence) as confidence, error from answers""",
)

# Evaluation

EVAL = [
    *BODY_HITS,
    *verdicts("steps", "doc_id", 0.5),
    f"""outcomes as (select doc_id as case_id, {pick('k', [x for _, x in MARKED_LINES])} as expected,
  category as predicted, confidence, {pick('k', [x for _, x in MARKED_LINES])} = category as correct from verdicts)""",
]
PER_CATEGORY = """per_category as (
  select *, case when predicted > 0 then true_positives / predicted else 0 end as p,
    case when support > 0 then true_positives / support else 0 end as r
  from (select t.category, (select count(*) from outcomes o where o.expected = t.category) as support,
      (select count(*) from outcomes o where o.predicted = t.category) as predicted,
      (select count(*) from outcomes o where o.expected = t.category and o.correct) as true_positives
    from taxonomy t)
  where support + predicted > 0)"""
F1 = "case when p + r > 0 then 2 * p * r / (p + r) else 0 end"
CHECKS["eval_outcomes"] = with_ctes(
    EVAL,
    """select case_id, expected, predicted, round(confidence, 9) as confidence, correct, 0 as hallucinated, '' as error
from outcomes""",
)
CHECKS["case_listing"] = with_ctes(
    EVAL,
    """select case when correct then 'PASS' else 'FAIL' end as mark, case_id, expected, predicted,
  printf('%.2f', confidence) as confidence, '' as error from outcomes""",
)
CHECKS["eval_totals"] = with_ctes(
    EVAL,
    """select count(*) as total, count(*) filter (where correct) as correct, cast(0 as bigint) as errored,
  round(count(*) filter (where correct) / count(*), 9) as accuracy,
  round(avg(confidence) filter (where correct), 9) as mean_confidence_correct,
  round(avg(confidence) filter (where not correct), 9) as mean_confidence_wrong,
  cast(0 as bigint) as hallucinated_citations from outcomes""",
)
CHECKS["eval_per_category"] = with_ctes(
    [*EVAL, PER_CATEGORY],
    f"""select category, support, predicted, true_positives, round(cast(p as double), 9) as precision,
  round(cast(r as double), 9) as recall, round(cast({F1} as double), 9) as f1 from per_category""",
)
CHECKS["eval_category_order"] = with_ctes(
    [*EVAL, PER_CATEGORY],
    f"""select cast(row_number() over (order by category) - 1 as integer) as place, category, support,
  round(cast({F1} as double), 9) as f1 from per_category""",
)
CHECKS["eval_macro_f1"] = with_ctes(
    [*EVAL, PER_CATEGORY], f"select round(avg({F1}), 9) as macro_f1 from per_category where support > 0"
)
CHECKS["confusion_long"] = with_ctes(
    EVAL, "select expected, predicted, count(*) as n from outcomes group by all"
)
PIVOT = ", ".join(f"count(*) filter (where predicted = {q(c)}) as {c}" for c in CODES)
CHECKS["confusion_pivot"] = with_ctes(EVAL, f"select expected, {PIVOT} from outcomes group by expected")
CELLS = " || ".join(
    f"lpad(case when count(*) filter (where predicted = {q(c)}) = 0 then '.' "
    f"else cast(count(*) filter (where predicted = {q(c)}) as varchar) end, 6, ' ')"
    for c in CODES
)
HEADING = "actual \\ predicted  " + "".join(f"{c.short:>6}" for c in CATEGORIES)
CHECKS["confusion_text"] = with_ctes(
    EVAL,
    f"""select -2 as ord, {q(HEADING)} as line union all select -1, repeat('-', {20 + 6 * len(CODES)})
union all select t.ord, rpad(t.short, 20, ' ') || {CELLS}
from outcomes o join taxonomy t on t.category = o.expected group by t.ord, t.short""",
)
CHECKS["eval_scores"] = with_ctes(
    [*EVAL, PER_CATEGORY],
    f"""select 'deterministic' as provider, 'rule-based-v1' as model, true as baseline,
  (select count(*) from outcomes) as total, (select count(*) from outcomes where correct) as correct,
  (select round(avg({F1}), 9) from per_category where support > 0) as macro_f1,
  (select cast(count(*) as integer) from per_category) as n_categories,
  (select cast(count(distinct expected) as integer) from outcomes) as n_labels,
  (select count(*) from outcomes where expected = 'race_condition' and predicted = 'race_condition') as race_as_race""",
)

# Reports

ITEMS = [
    STEPS,
    CHOSEN,
    *excerpts("chosen"),
    "cut as materialized (select archive, step_name, excerpt from excerpts)",
    hits("cut", "archive", "excerpt"),
    *verdicts("cut", "archive", STRICT_FLOOR),
    """items as materialized (
  select v.archive, md5(cast(v.archive as varchar)) as id, 'suite-' || (v.archive % 23) as job_name,
    md5('commit ' || v.archive) as head_sha, case when v.archive % 2 = 0 then 'main' else 'dev' end as branch,
    (v.archive % 7 + 1) / 8.0 as rate, v.archive % 17 = 3 as failed,
    'https://ci.example/fail/' || v.archive as failing_url,
    case when v.archive % 5 <> 0 then 'https://ci.example/pass/' || v.archive end as passing_url,
    case when v.archive % 17 = 3 then '' else v.category end as category, v.raw_category, v.downgraded, v.confidence,
    v.explanation, v.cited
  from verdicts v)""",
    "good as (select i.*, t.ord, t.label, t.severity, t.owner, t.summary, t.steps from items i "
    "join taxonomy t on t.category = i.category)",
    "counts as (select category, ord, label, severity, owner, summary, steps, count(*) as n from good group by all)",
    """totals as (select count(*) as occurrences, count(distinct job_name) as jobs,
  count(*) filter (where category = 'genuine_bug') as genuine_bugs from good)""",
]
SENTENCE = f"case when regexp_extract({{t}}, '^[^.!?]+[.!?]') = '' then {{t}} else regexp_extract({{t}}, '^[^.!?]+[.!?]') end"


def sentence(text: str) -> str:
    return SENTENCE.format(t=utrim(text))


CHECKS["report_json"] = with_ctes(
    ITEMS,
    f"""select archive, {q(HEADER.repo)} as repo, {q(HEADER.source)} as source, {q(HEADER.provider)} as provider,
  {q(HEADER.model)} as model, {str(HEADER.baseline).lower()} as baseline, case when not failed then category end as category,
  case when failed then 'downloading log: gone' else '' end as error from items""",
)
CHECKS["category_counts"] = with_ctes(ITEMS, "select category, n from counts")
CHECKS["category_share"] = with_ctes(
    ITEMS,
    f"""select ord, category, label, n, {percent('n / (select sum(n) from counts)')} as share, owner from counts""",
)
CHECKS["detail_order"] = with_ctes(
    ITEMS,
    f"""select i.id, i.job_name, coalesce(t.severity, 0) as severity,
  case when failed then 0.0 else round(confidence, 9) end as confidence, coalesce(t.label, '') as label,
  left(head_sha, 7) as "commit", {percent('rate')} as fail_rate, 8 as attempts,
  case when not failed and downgraded then raw_category else '' end as demoted_from,
  cast(case when failed then 0 else len(cited) end as integer) as evidence_lines, 0 as dropped_citations,
  failing_url, passing_url, case when failed then 'downloading log: gone' else '' end as error
from items i left join taxonomy t on t.category = i.category""",
)
CHECKS["issue_groups"] = with_ctes(
    ITEMS,
    f"""select id, category, severity, count(*) over (partition by category) as group_size, label, summary as mitigation,
  job_name, {sentence('explanation')} as sentence, left(head_sha, 7) as "commit", {percent('rate')} as fail_rate,
  round(confidence, 9) as confidence from good""",
)
CHECKS["first_sentences"] = f"select doc_id, md5({sentence('text')}) as sentence from documents"
CHECKS["digest_totals"] = with_ctes(ITEMS, "select occurrences, jobs, genuine_bugs, (select count(*) from items) as items from totals")
NOISY = """noisy as (select job_name, n, row_number() over (order by n desc, job_name) as place
  from (select job_name, count(*) as n from good group by all) qualify place <= 5)"""
CHECKS["noisiest_jobs"] = with_ctes([*ITEMS, NOISY], "select job_name, n from noisy")


def lines(source: str, part: int, array: str, rank: str = "0", grp: str = "''", weight: str = "0.0", item: str = "''", by: str = "") -> str:
    return f"""select {by}{part} as part, cast({rank} as integer) as rank, {grp} as grp, cast({weight} as double) as weight,
  {item} as item, cast(generate_subscripts(ls, 1) - 1 as integer) as line_no, unnest(ls) as line
from (select *, {array} as ls from {source})"""


def texts(*values: str) -> str:
    return f"[{', '.join(values)}]"


def fixed(*values: str) -> str:
    return texts(*map(q, values))


GENERATED = f"{HEADER.generated_at:%Y-%m-%d %H:%M} UTC"
FACTS = " || ".join(
    [
        texts(
            "'- **Commit:** `' || left(head_sha, 7) || '` on `' || branch || '`'",
            "'- **Workflow:** CI (`ci.yml`)'",
            f"'- **Failure rate:** ' || {percent('rate')} || ' (8 attempts)'",
            "'- **Confidence:** ' || printf('%.2f', confidence)",
        ),
        "(case when downgraded then ['- **Note:** demoted to unknown from `' || raw_category || '` for low confidence'] else [] end)",
        "['', explanation, '']",
        "(case when len(cited) > 0 then ['**Evidence**', '', '```'] || cited || ['```', ''] else [] end)",
        "['**Mitigation** — ' || summary || ' _(owner: ' || owner || ')_', '']",
        "list_transform(steps, lambda s: '- ' || s)",
        "['', '[Failing run](' || failing_url || ')' || coalesce(' · [Passing rerun](' || passing_url || ')', ''), '']",
        "['---', '']",
    ]
)
MARKDOWN_TOP = fixed(
    "# Flake report", "", f"**Repository:** `{HEADER.repo}`  ", f"**Source:** {HEADER.source}  ",
    f"**Classifier:** {HEADER.label()}  ", f"**Generated:** {GENERATED}", "", *r.MARKDOWN_BASELINE, "## Summary", "",
)
CHECKS["report_markdown"] = with_ctes(
    ITEMS,
    "\nunion all\n".join(
        [
            lines(
                "totals", 0,
                f"{MARKDOWN_TOP} || [occurrences || ' flaky occurrence(s) classified.', '', "
                "'| Category | Count | Share | Typical owner |', '| --- | ---: | ---: | --- |']",
            ),
            lines(
                "counts", 1,
                f"['| ' || label || ' | ' || n || ' | ' || {percent('n / (select sum(n) from counts)')} || ' | ' || owner || ' |']",
                rank="ord",
            ),
            lines("totals", 2, "['', '## Occurrences', '']"),
            lines(
                "good", 3, f"['### `' || job_name || '` — ' || label, ''] || {FACTS}", rank="-severity",
                weight="round(0.0 - confidence, 9)", item="id",
            ),
            lines(
                "(select * from items where failed)", 3,
                "['### `' || job_name || '` — ', '', '> Classification failed: downloading log: gone', '']", item="id",
            ),
        ]
    ),
)
CHECKS["report_issue"] = with_ctes(
    ITEMS,
    "\nunion all\n".join(
        [
            lines(
                "totals", 0,
                texts(
                    q(f"## Flaky tests detected in `{HEADER.repo}`"), "''",
                    "'Found **' || occurrences || ' flaky occurrence(s)** — jobs that produced both a pass and a failure on the same commit.'",
                    "''", q(f"Classified by `{HEADER.label()}`."), "''", *map(q, r.ISSUE_BASELINE),
                ),
            ),
            lines(
                "counts", 1,
                "['### ' || label || ' (' || n || ')', '', '**' || summary || '** _(owner: ' || owner || ')_', '']",
                rank="-severity", grp="category", weight="'-infinity'",
            ),
            lines(
                "good", 1,
                f"['- [ ] `' || job_name || '` — ' || {sentence('explanation')} || ' _(commit `' || left(head_sha, 7) || '`, ' || "
                f"{percent('rate')} || ' failure rate, confidence ' || printf('%.2f', confidence) || ')_']",
                rank="-severity", grp="category", weight="round(0.0 - confidence, 9)", item="id",
            ),
            lines(
                "counts", 1,
                "['', '<details><summary>Suggested steps</summary>', ''] || list_transform(steps, lambda s: '1. ' || s) "
                "|| ['', '</details>', '']",
                rank="-severity", grp="category", weight="'infinity'",
            ),
            lines("totals", 2, fixed("---", r.FOOTER)),
        ]
    ),
)
CHECKS["report_digest"] = with_ctes(
    [*ITEMS, NOISY],
    "\nunion all\n".join(
        [
            lines(
                "totals", 0,
                fixed("## Flake digest — last 7 days", "", f"`{HEADER.repo}` · classified by {HEADER.label()}", "")
                + " || ['**' || occurrences || ' flaky occurrence(s)** across **' || jobs || ' job(s)**.', ''] "
                "|| (case when genuine_bugs > 0 then ['> ⚠️ ' || genuine_bugs || "
                "' occurrence(s) look like a **genuine bug** masked by a rerun, not infrastructure noise. "
                "Those should not be re-run to green.', ''] else [] end) || ['| Category | Count |', '| --- | ---: |']",
            ),
            lines("counts", 1, "['| ' || label || ' | ' || n || ' |']", rank="ord"),
            lines("totals", 2, fixed("", "**Noisiest jobs**", "")),
            lines("noisy", 3, "[place || '. `' || job_name || '` — ' || n || ' occurrence(s)']", rank="place"),
            lines("totals", 4, fixed("", r.FOOTER)),
        ]
    ),
)

HEADS = "heads(repo, source, label, baseline) as (values " + ", ".join(
    f"('acme/{n}', 'source {n}', {q('model / m1' if i % 2 else HEADER.label())}, {str(not i % 2).lower()})"
    for i, n in enumerate([*range(5), "none"])
) + ")"
BY_REPO = [
    *ITEMS,
    HEADS,
    "r_items as (select *, 'acme/' || archive % 5 as repo from items)",
    "r_good as (select *, 'acme/' || archive % 5 as repo from good)",
    "r_counts as (select repo, category, ord, label, severity, owner, summary, steps, count(*) as n from r_good group by all)",
    """r_totals as (select h.*, coalesce(occurrences, 0) as occurrences, coalesce(jobs, 0) as jobs, coalesce(bugs, 0) as bugs, coalesce(n, 0) as n
  from heads h left join (select repo, count(*) filter (where not failed) as occurrences,
    count(distinct job_name) filter (where not failed) as jobs, count(*) filter (where category = 'genuine_bug') as bugs, count(*) as n
    from r_items group by repo) t on t.repo = h.repo)""",
    """r_noisy as (select repo, job_name, n, row_number() over (partition by repo order by n desc, job_name) as place
  from (select repo, job_name, count(*) as n from r_good group by all) qualify place <= 5)""",
    "r_share as (select *, sum(n) over (partition by repo) as all_n from r_counts)",
]


def some(condition: str, *values: str) -> str:
    return f"(case when {condition} then {texts(*values)} else [] end)"


def by_repo(*parts: str) -> str:
    return with_ctes(BY_REPO, "\nunion all\n".join(parts))


R = {"by": "repo, "}
CHECKS["repository_markdown"] = by_repo(
    lines(
        "r_totals", 0,
        "['# Flake report', '', '**Repository:** `' || repo || '`  ', '**Source:** ' || source || '  ', '**Classifier:** ' || label || '  ', "
        f"'**Generated:** {GENERATED}', ''] || {some('baseline', *map(q, r.MARKDOWN_BASELINE))} || ['## Summary', ''] || "
        f"(case when occurrences = 0 then {fixed(r.MARKDOWN_EMPTY, '')} else [occurrences || ' flaky occurrence(s) classified.', '', "
        "'| Category | Count | Share | Typical owner |', '| --- | ---: | ---: | --- |'] end)",
        **R,
    ),
    lines("r_share", 1, f"['| ' || label || ' | ' || n || ' | ' || {percent('n / all_n')} || ' | ' || owner || ' |']", rank="ord", **R),
    lines("r_totals", 2, f"""{some('occurrences > 0', "''")} || {some('n > 0', "'## Occurrences'", "''")}""", **R),
    lines(
        "r_good", 3, f"['### `' || job_name || '` — ' || label, ''] || {FACTS}", rank="-severity",
        weight="round(0.0 - confidence, 9)", item="id", **R,
    ),
    lines(
        "(select * from r_items where failed)", 3,
        "['### `' || job_name || '` — ', '', '> Classification failed: downloading log: gone', '']", item="id", **R,
    ),
)
CHECKS["repository_issue"] = by_repo(
    lines(
        "r_totals", 0,
        "['## Flaky tests detected in `' || repo || '`', '', 'Found **' || occurrences || ' flaky occurrence(s)** — jobs that produced "
        "both a pass and a failure on the same commit.', '', 'Classified by `' || label || '`.', ''] "
        f"|| {some('baseline', *map(q, r.ISSUE_BASELINE))}",
        **R,
    ),
    lines(
        "r_counts", 1, "['### ' || label || ' (' || n || ')', '', '**' || summary || '** _(owner: ' || owner || ')_', '']",
        rank="-severity", grp="category", weight="'-infinity'", **R,
    ),
    lines(
        "r_good", 1,
        f"['- [ ] `' || job_name || '` — ' || {sentence('explanation')} || ' _(commit `' || left(head_sha, 7) || '`, ' || "
        f"{percent('rate')} || ' failure rate, confidence ' || printf('%.2f', confidence) || ')_']",
        rank="-severity", grp="category", weight="round(0.0 - confidence, 9)", item="id", **R,
    ),
    lines(
        "r_counts", 1,
        "['', '<details><summary>Suggested steps</summary>', ''] || list_transform(steps, lambda s: '1. ' || s) || ['', '</details>', '']",
        rank="-severity", grp="category", weight="'infinity'", **R,
    ),
    lines("r_totals", 2, f"case when occurrences = 0 then {fixed(r.ISSUE_EMPTY)} else {fixed('---', r.FOOTER)} end", **R),
)
CHECKS["repository_digest"] = by_repo(
    lines(
        "r_totals", 0,
        "['## Flake digest — last 7 days', '', '`' || repo || '` · classified by ' || label, ''] || "
        f"(case when occurrences = 0 then {fixed(r.DIGEST_EMPTY)} else "
        "['**' || occurrences || ' flaky occurrence(s)** across **' || jobs || ' job(s)**.', ''] "
        "|| (case when bugs > 0 then ['> ⚠️ ' || bugs || "
        "' occurrence(s) look like a **genuine bug** masked by a rerun, not infrastructure noise. "
        "Those should not be re-run to green.', ''] else [] end) || ['| Category | Count |', '| --- | ---: |'] end)",
        **R,
    ),
    lines("r_counts", 1, "['| ' || label || ' | ' || n || ' |']", rank="ord", **R),
    lines("r_totals", 2, some("occurrences > 0", "''", "'**Noisiest jobs**'", "''"), **R),
    lines("r_noisy", 3, "[place || '. `' || job_name || '` — ' || n || ' occurrence(s)']", rank="place", **R),
    lines("r_totals", 4, some("occurrences > 0", "''", q(r.FOOTER)), **R),
)
CHECKS["written_items"] = with_ctes(
    ITEMS,
    """select archive, id, case when not failed then category end as category, case when not failed then round(confidence, 9) end as confidence,
  cast(case when not failed then len(cited) end as integer) as n_cited, case when failed then 'downloading log: gone' else '' end as error from items""",
)

CHECKS["classified_items"] = with_ctes(
    [
        JOBS,
        flaky(),
        STEPS,
        CHOSEN,
        *excerpts("chosen"),
        "cut as materialized (select archive, step_name, excerpt from excerpts)",
        hits("cut", "archive", "excerpt"),
        *verdicts("cut", "archive", 0.5),
        LOOKED,
        """found as (select l.id, l.job_name, v.category, v.confidence, v.step_name, v.excerpt,
    case when l.log_error is not null then 'downloading log: ' || l.log_error
      when a % 13 = 6 then 'extracting log: reading archive: opening log archive: not a zip'
      when v.archive is null then 'downloading log: reading archive ' || l.log_archive || ': not found' else '' end as error
  from (select *, try_cast(regexp_extract(log_archive, '^logs/([0-9]+)', 1) as bigint) as a from looked) l
  left join verdicts v on v.archive = l.a and a % 13 <> 6)""",
    ],
    """select id, job_name, category, round(confidence, 9) as confidence, coalesce(step_name, '') as step_name,
  cast(coalesce(strlen(excerpt), 0) as integer) as excerpt_len, error, 'deterministic' as provider,
  'rule-based-v1' as model, true as baseline from found""",
)
