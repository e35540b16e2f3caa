"""gradeflow: Spark-native grade-prediction and recommendation analytics.

Operators are plain ``DataFrame -> DataFrame`` functions grouped in
``functions`` (columns), ``sources`` (scans, sinks, test views), ``operators``
(joins, windows, aggregates, splits, flow), ``models`` and ``plans``
(evaluation loops and the registered queries).
"""
