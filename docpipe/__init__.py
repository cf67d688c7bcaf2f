"""docpipe: document conversion and clean-up expressed as Spark DataFrame jobs.

Sub-packages:

- ``sources``   scans, fixture views, the job ledger, prompt catalogue and sinks
- ``functions`` Column-expression builders (pure, no DataFrame state)
- ``operators`` DataFrame -> DataFrame operators (profiles, pages, chunks, cleaning, jobs)
- ``plans``     end-to-end compositions and the query catalogue used by ``__spark_entry__``
- ``streaming`` Structured Streaming jobs over the ledger and arriving responses
"""

__version__ = "0.1.0"


def _ship_by_value() -> None:
    """Python functions of this package that run in tasks (the converter step, the
    stateful stream) are pickled with their code, so workers need no installed copy."""
    import sys

    from pyspark import cloudpickle
    cloudpickle.register_pickle_by_value(sys.modules[__name__])


_ship_by_value()
