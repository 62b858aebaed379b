"""churnwise: customer-retention analytics expressed as Spark DataFrame plans.

Every public function takes DataFrames (plus scalar parameters) and returns a
lazy DataFrame; what the driver collects is bounded (tree nodes, counts).  The sub-packages are:

* ``sources``   - readers for the order tables, the test-table adapter, the
                  order feed, sinks and model storage
* ``functions`` - column-level helpers (day difference, rounding, rules)
* ``operators`` - joins, aggregations, windows, ranking, ML stages
* ``plans``     - the composed runs (data, segments, churn, clv, activation)
                  and the named query registry
* ``streaming`` - the live order intake on Structured Streaming
"""

__version__ = "0.1.0"
