"""adpulse: a Spark-native daily advertising engine.

Layers, each DataFrame in / DataFrame out:

* ``sources``   snapshot catalog and pick, scan/conform, ingest, targets
* ``operators`` the figures (totals, comparisons, rankings, drill-down,
                KPI, promo split, pivot, parity)
* ``functions`` column expressions (measures, labels, number text)
* ``plans``     Figures (all pages of one snapshot), the daily job, and the
                registered queries with their SQL oracle
* ``streaming`` the folder watcher as a Structured Streaming ingest
"""

__version__ = "0.1.0"
