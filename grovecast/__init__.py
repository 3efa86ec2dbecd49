"""grovecast: tree-crop harvest and weather analytics on Spark.

Per-site weather features, model scoring from model tables, disease-risk and
foliar-feeding windows, JSON payload ingestion with keep-first merge, reports,
model fitting and Structured Streaming jobs.  Every function takes and returns
DataFrames; see README.md for the map from the service's calls to functions.

Subpackages: ``functions`` (column expressions, rule tables), ``sources``
(readers, payload parsers, fixture views), ``operators`` (windows, features,
scoring, risk, foliar, dedup), ``plans`` (predictions, reports, fit, the
registered queries), ``streaming`` (Structured Streaming jobs).
"""

__version__ = "0.1.0"
