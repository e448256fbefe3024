"""The package's functions for use in SQL, as temporary functions whose bodies the optimizer sees."""

from __future__ import annotations

from pyspark.sql import SparkSession

FUNCTIONS = {
    "poly_value": ("coefficients ARRAY<DOUBLE>, p DOUBLE", "DOUBLE", "aggregate(reverse(coefficients), 0D, (acc, c) -> acc * p + c)"),
    "chain_fail": ("probs ARRAY<DOUBLE>", "DOUBLE", "1 - aggregate(probs, 1D, (acc, p) -> acc * (1 - p))"),
    "edge_fail": ("length DOUBLE, rate DOUBLE", "DOUBLE", "1 - exp(-length * rate)"),
    "mercator_x": ("lon DOUBLE", "DOUBLE", "lon * pi() * 6378137 / 180"),
    "mercator_y": ("lat DOUBLE", "DOUBLE", "ln(tan(pi() / 4 + lat * pi() / 360)) * 6378137"),
    "chain_risk": ("length DOUBLE", "DOUBLE", "(length - 1) * length * (length + 1) / 6"),
}


def register(spark: SparkSession) -> None:
    """Make :data:`FUNCTIONS` known to the session."""
    for name, (arguments, kind, body) in FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({arguments}) RETURNS {kind} RETURN {body}")
