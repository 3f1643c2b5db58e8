"""Distributional-semantics analytics and corpus preparation on Spark.

The package is layered: ``functions`` holds column expressions, ``operators``
DataFrame-to-DataFrame building blocks, ``sources`` readers and writers,
``plans`` the query catalogue, ``streaming`` the incremental variants.
"""

__version__ = "0.1.0"
