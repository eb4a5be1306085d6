"""spendlens: statement-transaction ETL, incremental dedup and spending analytics on Spark.

Every public function maps ``DataFrame -> DataFrame`` (usable with ``DataFrame.transform``)
and builds a lazy Catalyst plan; nothing is collected to the driver.
"""

__version__ = "0.1.0"
