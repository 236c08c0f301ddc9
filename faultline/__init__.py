"""faultline: API-error analytics, redaction and circuit-breaker operators on Spark.

Every operator is a plain function ``DataFrame -> DataFrame`` built from the
public DataFrame / SQL API, so Catalyst sees one declarative plan per query.
"""

__version__ = "0.1.0"
