"""The closed set of root causes and the advice attached to each."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from redgreen.functions.text import col, constant, text_or_empty


class Category(NamedTuple):
    code: str
    label: str
    severity: int
    short: str
    owner: str
    summary: str
    steps: tuple[str, ...]


# Seven categories in report order, with label, severity, matrix
# heading, typical owner, mitigation summary and mitigation steps.
CATEGORIES = [
    Category(
        "network_timeout", "Network timeout", 1, "net", "test author",
        "Make the network call tolerant of transient failure.",
        (
            "Wrap the call in a retry with exponential backoff and jitter.",
            "Raise the client timeout to cover realistic p99 latency, not the mean.",
            "Pin or vendor the dependency if the flake is a package registry fetch.",
            "Consider a local service double so the test does not depend on the public internet.",
        ),
    ),
    Category(
        "race_condition", "Race condition", 4, "race", "test author",
        "Replace timing assumptions with explicit synchronisation.",
        (
            "Run the package with `go test -race` (or the language equivalent) to confirm.",
            "Replace sleeps with a channel, WaitGroup, or condition variable.",
            "Await the state you actually need rather than a fixed duration.",
            "Guard shared fixtures with a mutex, or give each test its own copy.",
        ),
    ),
    Category(
        "infra_flake", "Infrastructure flake", 1, "infra", "platform team",
        "Runner or platform problem — usually not the test's fault.",
        (
            "Re-run the job; confirm the failure does not reproduce on a fresh runner.",
            "Check the provider status page for the window in question.",
            "If it recurs on one runner label, pin the job to a different pool.",
            "Track the frequency — a rising rate is worth escalating to the platform team.",
        ),
    ),
    Category(
        "resource_exhaustion", "Resource exhaustion", 2, "res", "test author",
        "The job ran out of memory, disk, or file descriptors.",
        (
            "Check peak usage against the runner's limits.",
            "Free disk before the step, or move to a larger runner.",
            "Reduce test parallelism so concurrent workers do not sum past the cap.",
            "Look for a leak: an unbounded cache or unclosed handles across the suite.",
        ),
    ),
    Category(
        "test_order_dependency", "Test order dependency", 3, "order", "test author",
        "The test depends on state left behind by another test.",
        (
            "Run the suite with shuffling enabled (`go test -shuffle=on`) to reproduce.",
            "Move shared setup into per-test fixtures with teardown.",
            "Avoid package-level mutable state shared between tests.",
            "Isolate anything global: temp dirs, env vars, registries, singletons.",
        ),
    ),
    Category(
        "genuine_bug", "Genuine bug", 5, "bug", "code owner",
        "Not a flake — a real defect that reruns happen to mask.",
        (
            "Do not re-run to green. Open a bug with the failing assertion attached.",
            "Reproduce locally with the same inputs and seed.",
            "Check whether the failure rate correlates with a recent change.",
        ),
    ),
    Category(
        "unknown", "Unknown", 0, "unk", "maintainer",
        "Not enough signal in the log to classify with confidence.",
        (
            "Increase log verbosity for the failing step and wait for a recurrence.",
            "Upload test artifacts or a JUnit report so the next run has more to go on.",
            "Review manually — this occurrence needs a human.",
        ),
    ),
]

UNKNOWN = "unknown"
GENUINE_BUG = "genuine_bug"
CODES = [c.code for c in CATEGORIES]


def is_category(c: Column | str) -> Column:
    """Exact, case-sensitive membership; null is not a member."""
    return F.coalesce(col(c).isin(CODES), F.lit(False))


def _lookup(c: Column | str, field: str, kind: str) -> Column:
    """A field of the category, null for any other code, from a constant map of seven entries."""
    values = {x.code: getattr(x, field) for x in CATEGORIES}
    return F.try_element_at(constant(values, f"map<string,{kind}>"), text_or_empty(c))


def label_of(c: Column | str) -> Column:
    """Readable name; an unknown code keeps its own text."""
    return F.coalesce(_lookup(c, "label", "string"), col(c))


def severity_of(c: Column | str) -> Column:
    return F.coalesce(_lookup(c, "severity", "int"), F.lit(0))


def report_order_of(c: Column | str) -> Column:
    places = {code: i for i, code in enumerate(CODES)}
    return F.coalesce(F.try_element_at(constant(places, "map<string,int>"), text_or_empty(c)), F.lit(len(CODES)))


def owner_of(c: Column | str) -> Column:
    return F.coalesce(_lookup(c, "owner", "string"), F.lit(CATEGORIES[-1].owner))


def mitigation_of(c: Column | str) -> Column:
    """Mitigation summary; anything unrecognised gets the advice for ``unknown``."""
    return F.coalesce(_lookup(c, "summary", "string"), F.lit(CATEGORIES[-1].summary))


def mitigation_steps_of(c: Column | str) -> Column:
    unknown = constant(CATEGORIES[-1].steps, "array<string>")
    return F.coalesce(_lookup(c, "steps", "array<string>"), unknown)


def with_taxonomy(df: DataFrame, category: str = "category") -> DataFrame:
    """Label, severity and mitigation per row.

    Seven constants fold into the plan as a map, which spares the job, the
    broadcast and the join that a dimension table of that size would cost.
    """
    return df.withColumns(
        {
            "label": label_of(category),
            "severity": severity_of(category),
            "owner": owner_of(category),
            "mitigation": mitigation_of(category),
            "mitigation_steps": mitigation_steps_of(category),
        }
    )
