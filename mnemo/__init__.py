"""mnemo: memorization-probe and recommendation-evaluation operators on Spark.

Every public operator is a DataFrame -> DataFrame function. Sub-packages:

* ``sources``   - file scans, sinks, the result ledger and the tables derived
                  from the driver's parquet inputs.
* ``functions`` - column expressions (text normalisation, similarity, report text).
* ``operators`` - positions and prefix sums, coverage reports, splits and tiers,
                  scoring, prompts, ranking metrics and list statistics.
* ``plans``     - end-to-end flows and the query catalogue used by the driver.
* ``streaming`` - resumable scoring ledger on Structured Streaming.
"""

__version__ = "0.1.0"


def _ship_by_value() -> None:
    """Pickle this package's functions (UDFs, mapInPandas closures) by value, so
    Python workers run them without the package being installed on executors."""
    import sys
    try:
        from pyspark import cloudpickle
        cloudpickle.register_pickle_by_value(sys.modules[__name__])
    except Exception:  # noqa: BLE001 - older cloudpickle: the package must then be importable on executors
        pass


_ship_by_value()
