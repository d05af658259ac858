"""Samples as messages: one per row with key, JSON value and headers."""

from __future__ import annotations

import logging
from collections.abc import Sequence
from pathlib import Path

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from callscope.functions.records import json_unix, message_headers, message_key
from callscope.sinks.base import Sink, register_sink

log = logging.getLogger(__name__)

# --- fixed values: producer defaults and accepted choices -------------------
MAX_REQUEST_BYTES = 1048576
BATCH_BYTES = 16384
RETRY_BACKOFF_MS = 100
COMPRESSIONS = ("gzip", "snappy", "lz4", None)
PROTOCOLS = ("PLAINTEXT", "SSL", "SASL_PLAINTEXT", "SASL_SSL")
MECHANISMS = ("PLAIN", "SCRAM-SHA-256", "SCRAM-SHA-512")
# --- end of fixed values ----------------------------------------------------

_LOGIN_MODULE = {
    "PLAIN": "org.apache.kafka.common.security.plain.PlainLoginModule",
    "SCRAM-SHA-256": "org.apache.kafka.common.security.scram.ScramLoginModule",
    "SCRAM-SHA-512": "org.apache.kafka.common.security.scram.ScramLoginModule",
}


def message_records(samples: DataFrame, tracked: Sequence[str] = ()) -> DataFrame:
    """(key, value, headers) rows in the shape of Spark's Kafka sink."""
    return samples.select(
        message_key().alias("key"),
        json_unix(samples).cast("binary").alias("value"),
        message_headers(tracked).alias("headers"),
    )


def message_bytes() -> Column:
    """Size of a message: key, value and headers."""
    headers = F.aggregate(
        "headers", F.lit(0), lambda n, h: n + F.octet_length(h["key"]) + F.coalesce(F.octet_length(h["value"]), F.lit(0))
    )
    return F.coalesce(F.octet_length("key"), F.lit(0)) + F.coalesce(F.octet_length("value"), F.lit(0)) + headers


def check_security(
    protocol: str, username: str | None, password: str | None, certificate: str | None, key: str | None
) -> None:
    """Credentials and certificates have to fit the protocol."""
    if protocol not in PROTOCOLS:
        raise ValueError(f"unknown security protocol {protocol!r}")
    wants_login, wants_tls = protocol.startswith("SASL_"), protocol.endswith("SSL")
    if wants_login and not (username and password):
        raise ValueError(f"{protocol} needs a user name and a password")
    if wants_tls and not (certificate and key):
        raise ValueError(f"{protocol} needs a client certificate and its key")
    if protocol == "PLAINTEXT" and (username or password):
        raise ValueError("PLAINTEXT takes no credentials")
    if protocol == "PLAINTEXT" and (certificate or key):
        raise ValueError("PLAINTEXT takes no certificate")


def kafka_options(
    bootstrap_servers: str | Sequence[str],
    topic: str,
    max_request_size: int = MAX_REQUEST_BYTES,
    client_id: str = "callscope",
    linger_ms: int = 0,
    compression_type: str | None = None,
    max_batch_size: int = BATCH_BYTES,
    retry_backoff_ms: int = RETRY_BACKOFF_MS,
    sasl_username: str | None = None,
    sasl_password: str | None = None,
    security_protocol: str = "PLAINTEXT",
    ssl_ca_cert: str | None = None,
    ssl_cert: str | None = None,
    ssl_key: str | None = None,
    sasl_mechanism: str = "PLAIN",
) -> dict[str, str]:
    """Options of Spark's Kafka writer; certificates are PEM files."""
    check_security(security_protocol, sasl_username, sasl_password, ssl_cert, ssl_key)
    if compression_type not in COMPRESSIONS:
        raise ValueError(f"unknown compression {compression_type!r}")
    if sasl_mechanism not in MECHANISMS:
        raise ValueError(f"unknown SASL mechanism {sasl_mechanism!r}")
    servers = bootstrap_servers if isinstance(bootstrap_servers, str) else ",".join(bootstrap_servers)
    options = {
        "topic": topic,
        "includeHeaders": "true",
        "kafka.bootstrap.servers": servers,
        "kafka.max.request.size": str(max_request_size),
        "kafka.client.id": client_id,
        "kafka.linger.ms": str(linger_ms),
        "kafka.batch.size": str(max_batch_size),
        "kafka.retry.backoff.ms": str(retry_backoff_ms),
        "kafka.security.protocol": security_protocol,
    }
    if compression_type:
        options["kafka.compression.type"] = compression_type
    if security_protocol.startswith("SASL_"):
        options["kafka.sasl.mechanism"] = sasl_mechanism
        options["kafka.sasl.jaas.config"] = (
            f'{_LOGIN_MODULE[sasl_mechanism]} required username="{sasl_username}" password="{sasl_password}";'
        )
    if security_protocol.endswith("SSL"):
        options["kafka.ssl.keystore.type"] = "PEM"
        options["kafka.ssl.keystore.certificate.chain"] = Path(ssl_cert).read_text()
        options["kafka.ssl.keystore.key"] = Path(ssl_key).read_text()
        if ssl_ca_cert:
            options["kafka.ssl.truststore.type"] = "PEM"
            options["kafka.ssl.truststore.certificates"] = Path(ssl_ca_cert).read_text()
    return options


@register_sink("kafka")
class KafkaSink(Sink):
    """Needs Spark's Kafka connector on the class path; takes the options of ``kafka_options``.

    Messages larger than a request may be are logged and, with ``set_aside``, written to
    ``<set_aside>/batch=<id>``; all others are sent.
    """

    def __init__(self, tracked: Sequence[str] = (), set_aside: str | None = None, **options):
        self.tracked = list(tracked)
        self.set_aside = set_aside
        self.limit = options.get("max_request_size", MAX_REQUEST_BYTES)
        self.options = kafka_options(**options)

    def write(self, batch: DataFrame, batch_id: int) -> None:
        records = message_records(batch, self.tracked)
        size = message_bytes()
        too_large = records.where(size > self.limit)
        count = too_large.count()
        if count:
            log.warning("micro-batch %s: %s messages of more than %s bytes were not sent", batch_id, count, self.limit)
            if self.set_aside:
                too_large.write.mode("overwrite").parquet(f"{self.set_aside.rstrip('/')}/batch={batch_id}")
        self.send(records.where(size <= self.limit))

    def send(self, records: DataFrame) -> None:
        records.write.format("kafka").options(**self.options).save()
