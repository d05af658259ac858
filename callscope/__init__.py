"""Per-process file-operation analytics on Spark."""

from callscope.operators.conform import conform
from callscope.operators.counters import count_calls, durations_to_seconds, flatten_counters
from callscope.operators.metrics import buffer_usage, drain_metrics, newest_samples, to_metrics
from callscope.operators.mounts import attach_mounts, resolve_mounts, upsert_mounts
from callscope.operators.pairing import pair_calls
from callscope.operators.reshape import transpose
from callscope.operators.retention import retained_files
from callscope.operators.stats import anonymize, filter_stats, group_stats
from callscope.operators.tagging import attach_tags, exec_tags, live_tags, tag_key_drift
from callscope.plans.collect import collect_samples, samples_from_counters

__all__ = [
    "anonymize", "attach_mounts", "attach_tags", "buffer_usage", "collect_samples", "conform",
    "count_calls", "drain_metrics", "durations_to_seconds", "exec_tags", "filter_stats",
    "flatten_counters", "group_stats", "live_tags", "newest_samples", "pair_calls",
    "resolve_mounts", "retained_files", "samples_from_counters", "tag_key_drift", "to_metrics",
    "transpose", "upsert_mounts",
]
