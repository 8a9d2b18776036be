"""tidepool: sensor-telemetry analytics as Spark DataFrame operators.

Every operator is a pure function ``DataFrame -> DataFrame`` built on Spark SQL
functions, windows, joins and aggregations.  No operator opens a session, runs
an action or keeps global state; clocks ("now") are parameters.

Layout
------
``functions``      column-level helpers (id/value extraction, frames, formats)
``sources``        decoders, encoders, table reads/writes
``operators``      validation, rolling metrics, batching, registry, retention,
                   subscriptions
``plans``          skew-safe building blocks (keyed positions, chunked sliding
                   windows, two-level prefix sums) and the query catalogue
``streaming``      Structured Streaming twins of the live paths
"""

__all__ = ["session"]
