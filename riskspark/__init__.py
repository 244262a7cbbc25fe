"""riskspark: transaction-risk analytics as PySpark DataFrame operators.

Every operator is a plain function ``DataFrame -> DataFrame`` built from
Spark SQL expressions, windows, joins and aggregates, so Catalyst plans it
and the work scales with the cluster.
"""

__version__ = "0.1.0"
