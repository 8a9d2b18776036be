"""Structured Streaming twins of the live paths.

* ``commits``     the tables of a micro-batch, visible together (T9)
* ``windows``     T1 flush and T2 interval sums, late readings included; T6 presence
* ``tails``       T3-T5: the last values of each key in Spark's keyed state, and
                  micro-batches through the batch plans
* ``envelopes``   T1 as outgoing batches: every window leaves once
* ``ingest``      gateway envelopes into measurements, metrics and registries (S5, T9)
* ``stateful``    T3 by key and T7 inactivity timers (``applyInPandasWithState``)
* ``sinks``       T8 resend de-duplication, idempotent batch writes, T10
                  stream-static subscription gate
* ``replay``      a table fed to a stream in parts

Every query keeps its checkpoint, state and output under the session's
checkpoint folder (``spark.checkpoint.dir``), so a restarted or re-run query
resumes from its own files.
"""
