"""closurelens — area closure-risk analytics as Spark DataFrame operators.

Every operator is a function ``DataFrame -> DataFrame`` (or a small driver
value computed from a bounded aggregate).  Column names are parameters; the
domain wiring in :mod:`closurelens.plans.domain` binds them to the panel
schema.

Subpackages: ``sources`` (scans, fixture stand-ins, sinks), ``functions``
(column expressions), ``operators`` (panel, imputation, names, spatial joins,
statistics, features, metrics, models, attributions, risk), ``plans``
(domain wiring, stage tables, registered queries and their SQL oracles),
``streaming`` (incremental append as a foreachBatch stream).
"""

__version__ = "0.1.0"
