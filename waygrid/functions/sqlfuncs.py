"""Temporary SQL functions, so that spark.sql() has the domain's vocabulary."""

from __future__ import annotations

from pyspark.sql import SparkSession

DEFINITIONS = {
    "haversine_miles": (
        "lat1 DOUBLE, lon1 DOUBLE, lat2 DOUBLE, lon2 DOUBLE", "DOUBLE",
        "2 * 3958.8 * asin(sqrt(least(1.0D, pow(sin(radians(lat2 - lat1) / 2), 2) + cos(radians(lat1)) * cos(radians(lat2)) * pow(sin(radians(lon2 - lon1) / 2), 2))))",
    ),
    "bearing_deg": (
        "lat1 DOUBLE, lon1 DOUBLE, lat2 DOUBLE, lon2 DOUBLE", "DOUBLE",
        "pmod(degrees(atan2(sin(radians(lon2 - lon1)) * cos(radians(lat2)), cos(radians(lat1)) * sin(radians(lat2)) - sin(radians(lat1)) * cos(radians(lat2)) * cos(radians(lon2 - lon1)))) + 360, 360.0D)",
    ),
    "angle_difference": ("a DOUBLE, b DOUBLE", "DOUBLE", "CASE WHEN pmod(abs(a - b), 360.0D) > 180 THEN 360 - pmod(abs(a - b), 360.0D) ELSE pmod(abs(a - b), 360.0D) END"),
    "quality_grade": ("score DOUBLE", "STRING", "CASE WHEN score >= 0.85 THEN 'excellent' WHEN score >= 0.70 THEN 'very_good' WHEN score >= 0.55 THEN 'good' WHEN score >= 0.40 THEN 'fair' WHEN score >= 0.25 THEN 'poor' ELSE 'very_poor' END"),
}


def register(spark: SparkSession) -> list[str]:
    for name, (args, kind, body) in DEFINITIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({args}) RETURNS {kind} RETURN {body}")
    return sorted(DEFINITIONS)
