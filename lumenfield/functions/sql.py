"""The reusable formulas as SQL functions of a session, for users who write SQL."""

from __future__ import annotations

from pyspark.sql import SparkSession

# Written as Spark SQL so that they are inlined and optimised like any expression. Literals are DOUBLE.
FUNCTIONS = {
    "lf_luminance(r DOUBLE, g DOUBLE, b DOUBLE)": "179e0 * (0.265e0 * r + 0.670e0 * g + 0.065e0 * b)",
    "lf_erf(v DOUBLE)": """signum(v) * (1e0 - aggregate(array(1.061405429e0, -1.453152027e0, 1.421413741e0, -0.284496736e0, 0.254829592e0), 0e0,
        (acc, k) -> (acc + k) / (1e0 + 0.3275911e0 * abs(v))) * exp(-v * v))""",
    "lf_angle(ax DOUBLE, ay DOUBLE, az DOUBLE, bx DOUBLE, by DOUBLE, bz DOUBLE)": "acos(greatest(-1e0, least(1e0, ax * bx + ay * by + az * bz)))",
    "lf_position_angles(dx DOUBLE, dy DOUBLE, dz DOUBLE)": """named_struct('sigma', degrees(acos(greatest(-1e0, least(1e0, dy)))),
        'tau', degrees(acos(coalesce(greatest(-1e0, least(1e0, dz / nullif(sqrt(dx * dx + dz * dz), 0e0))), 0e0))), 'phi', asin(greatest(-1e0, least(1e0, dz))))""",
    "lf_guth(sigma DOUBLE, tau DOUBLE, phi DOUBLE)": """least(16e0, CASE WHEN phi < 0 THEN
        exp(6.49e0 / 1000e0 * degrees(atan(tan(radians(sigma)) * sqrt(1e0 + 0.3225e0 * pow(cos(radians(tau)), 2e0)))) +
            21e0 / 100000e0 * pow(degrees(atan(tan(radians(sigma)) * sqrt(1e0 + 0.3225e0 * pow(cos(radians(tau)), 2e0)))), 2e0))
        ELSE exp((35.2e0 - 0.31889e0 * tau - 1.22e0 * exp(-2e0 * tau / 9e0)) / 1000e0 * sigma + (21e0 + 0.26667e0 * tau - 0.002963e0 * tau * tau) / 100000e0 * sigma * sigma) END)""",
}


def register(spark: SparkSession) -> list[str]:
    """Create the functions for this session and return their names."""
    for head, body in FUNCTIONS.items():
        returns = "STRUCT<sigma: DOUBLE, tau: DOUBLE, phi: DOUBLE>" if "angles" in head else "DOUBLE"
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {head} RETURNS {returns} RETURN {body}")
    return [h.split("(")[0] for h in FUNCTIONS]
