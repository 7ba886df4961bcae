"""The fixed values, written out: the SQL of the named queries shares them with the operators."""

from redgreen.functions.logs import ANCHOR_MARKERS, FAILURE_MARKERS
from redgreen.functions.rules import RULES
from redgreen.operators.detect import DECISIVE
from redgreen.operators.taxonomy import CATEGORIES

# Fixed values, in the order of their tables.
FAILURES = [
    '##[error]',
    'process completed with exit code',
    'panic:',
    'data race',
    'fatal error:',
    '--- fail:',
    'error:',
    'failed',
    'assertion',
    'timeout',
    'exception',
]
ANCHORS = [
    '##[error]',
    'panic:',
    'data race',
    'fatal error:',
    '--- fail:',
    'process completed with exit code',
    'assertion failed',
    'traceback (most recent call last)',
]
PATTERNS = [
    ('network_timeout', 3.0, '(?i)\\bi/o timeout\\b'),
    ('network_timeout', 3.0, '(?i)\\bdial tcp\\b'),
    ('network_timeout', 2.5, '(?i)connection (refused|reset by peer)'),
    ('network_timeout', 2.5, '(?i)tls handshake timeout'),
    ('network_timeout', 2.0, '(?i)context deadline exceeded'),
    ('network_timeout', 2.0, '(?i)(no such host|temporary failure in name resolution)'),
    ('network_timeout', 1.5, '(?i)could not resolve host'),
    ('race_condition', 4.0, '(?i)WARNING: DATA RACE'),
    ('race_condition', 3.0, '(?i)send on closed channel'),
    ('race_condition', 3.0, '(?i)concurrent map (read and map )?write'),
    ('race_condition', 2.5, '(?i)all goroutines are asleep - deadlock'),
    ('race_condition', 2.0, '(?i)race detector'),
    ('race_condition', 1.5, '(?i)(previous write|previous read) at 0x'),
    ('infra_flake', 3.5, '(?i)runner has received a shutdown signal'),
    ('infra_flake', 3.5, '(?i)lost communication with the server'),
    ('infra_flake', 3.0, '(?i)the runner has received a shutdown'),
    ('infra_flake', 2.5, '(?i)failed to download action'),
    ('infra_flake', 2.5, '(?i)the operation was canceled.*runner'),
    ('infra_flake', 2.0, '(?i)docker daemon.*not running'),
    ('infra_flake', 2.0, '(?i)spot instance.*(reclaim|interrupt)'),
    ('resource_exhaustion', 4.0, '(?i)no space left on device'),
    ('resource_exhaustion', 4.0, '(?i)\\boom-?killed\\b'),
    ('resource_exhaustion', 3.5, '(?i)out of memory'),
    ('resource_exhaustion', 3.0, '(?i)cannot allocate memory'),
    ('resource_exhaustion', 3.0, '(?i)too many open files'),
    ('resource_exhaustion', 2.5, '(?i)signal: killed'),
    ('resource_exhaustion', 2.0, '(?i)exit code 137'),
    ('test_order_dependency', 3.5, '(?i)-shuffle'),
    ('test_order_dependency', 3.0, '(?i)passes in isolation'),
    ('test_order_dependency', 3.0, '(?i)shared fixture'),
    ('test_order_dependency', 2.5, '(?i)leaked state'),
    ('test_order_dependency', 2.5, '(?i)(already exists|duplicate).*(registry|registered)'),
    ('test_order_dependency', 2.0, '(?i)test order'),
    ('genuine_bug', 3.0, '(?i)nil pointer dereference'),
    ('genuine_bug', 3.0, '(?i)index out of range'),
    ('genuine_bug', 2.5, '(?i)expected .* (got|but got) '),
    ('genuine_bug', 2.0, '(?i)assertion failed'),
    ('genuine_bug', 2.0, '(?i)invalid memory address'),
]
LABELS = [
    ('network_timeout', 'Network timeout', 1, 'test author'),
    ('race_condition', 'Race condition', 4, 'test author'),
    ('infra_flake', 'Infrastructure flake', 1, 'platform team'),
    ('resource_exhaustion', 'Resource exhaustion', 2, 'test author'),
    ('test_order_dependency', 'Test order dependency', 3, 'test author'),
    ('genuine_bug', 'Genuine bug', 5, 'code owner'),
    ('unknown', 'Unknown', 0, 'maintainer'),
]


def test_values():
    assert list(FAILURE_MARKERS) == FAILURES and list(ANCHOR_MARKERS) == ANCHORS
    assert [(r.category, r.weight, r.pattern) for r in RULES] == PATTERNS and len(PATTERNS) == 38
    assert [(c.code, c.label, c.severity, c.owner) for c in CATEGORIES] == LABELS
    assert list(DECISIVE) == ["success", "failure", "timed_out"]
