"""Where samples go. Importing this registers the built-in sinks by name."""

from callscope.sinks.base import SINKS, Sink, discover_sinks, fan_out, make_sink, register_sink
from callscope.sinks.buffer import BufferSink
from callscope.sinks.console import ConsoleSink
from callscope.sinks.files import JsonFileSink
from callscope.sinks.kafka import KafkaSink
from callscope.sinks.metrics import MetricsSink
from callscope.sinks.source import SampleFiles, SourceSink
from callscope.sinks.table import TableSink

__all__ = [
    "SINKS", "BufferSink", "ConsoleSink", "JsonFileSink", "KafkaSink", "MetricsSink", "SampleFiles", "Sink", "SourceSink", "TableSink",
    "discover_sinks", "fan_out", "make_sink", "register_sink",
]
