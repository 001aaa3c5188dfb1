"""pliego — procurement red-flag analytics on Spark.

Every public function takes and returns a lazy DataFrame (or a Column);
nothing is collected to the driver.  Sub-packages:

* ``functions``  Column expressions (durations, text rules, nested-array counts)
* ``sources``    table readers, OCDS release-package readers, landing writer
* ``operators``  DataFrame -> DataFrame building blocks
* ``plans``      the composed flows, the fixture views over the test tables, the query registry
"""

__version__ = "0.1.0"


def _ship_by_value() -> None:
    """Functions of this package that run in Python workers (``mapInPandas``
    bodies, the model class) are pickled *by value*, so executors need no
    install of the package and no file shipped with ``addPyFile``."""
    import sys

    try:
        from pyspark import cloudpickle
    except ImportError:  # pragma: no cover - pyspark is a hard dependency
        return
    cloudpickle.register_pickle_by_value(sys.modules[__name__])


_ship_by_value()
