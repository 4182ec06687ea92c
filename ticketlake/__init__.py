"""ticketlake: Spark-native ticket triage, grounded retrieval and evaluation.

Every operator is a plain ``DataFrame -> DataFrame`` function; those that must know a size,
fit a model or write a step run small jobs when called.  The modules are grouped as

* ``sources``   - table scans, logical input bindings, sinks
* ``functions`` - reusable Column expressions (text, arrays, JSON)
* ``operators`` - the operator library (scrub, rules, chain, retrieval, ...)
* ``plans``     - composed end-to-end plans and the query registry
* ``streaming`` - Structured Streaming forms of the monitoring operators
"""

from ticketlake.session import get_spark, checkpoint_dir  # noqa: F401

__all__ = ["get_spark", "checkpoint_dir"]
