"""Fixed dimensions A13, A14. Both are constants of the product, so their size never grows with the data."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from casework.schemas import SEVERITY_MULTIPLIER, SLA_DAYS

# --- fixed values: city -> (latitude, longitude) ---------------------------------------------------
CITY_COORDINATES = {
    "Mumbai": (19.0760, 72.8777), "Delhi": (28.6139, 77.2090),
    "Bengaluru": (12.9716, 77.5946), "Chennai": (13.0827, 80.2707),
    "Kolkata": (22.5726, 88.3639), "Hyderabad": (17.3850, 78.4867),
    "Pune": (18.5204, 73.8567), "Ahmedabad": (23.0225, 72.5714),
    "Jaipur": (26.9124, 75.7873), "Lucknow": (26.8467, 80.9462),
    "Kanpur": (26.4499, 80.3319), "Nagpur": (21.1458, 79.0882),
    "Indore": (22.7196, 75.8577), "Bhopal": (23.2599, 77.4126),
    "Patna": (25.5941, 85.1376), "Vadodara": (22.3072, 73.1812),
    "Nashik": (19.9975, 73.7898), "Aurangabad": (19.8762, 75.3433),
    "Solapur": (17.6599, 75.9064), "Thane": (19.2183, 72.9781),
    "Noida": (28.5355, 77.3910), "Agra": (27.1767, 78.0081),
    "Varanasi": (25.3176, 82.9739), "Coimbatore": (11.0168, 76.9558),
    "Gurgaon": (28.4595, 77.0266), "Rajkot": (22.3039, 70.8022),
    "Surat": (21.1702, 72.8311), "Vizag": (17.6868, 83.2185),
    "Akola": (20.7059, 77.0082), "Aligarh": (27.8974, 78.0880),
    "Allahabad": (25.4358, 81.8463), "Amravati": (20.9374, 77.7796),
    "Bareilly": (28.3670, 79.4304), "Bhandara": (21.1700, 79.6500),
    "Buldhana": (20.5292, 76.1842), "Chandrapur": (19.9615, 79.2961),
    "Dhule": (20.9024, 74.7749), "Firozabad": (27.1591, 78.3957),
    "Gadchiroli": (20.1809, 80.0024), "Ghaziabad": (28.6692, 77.4538),
    "Gondia": (21.4624, 80.1961), "Gorakhpur": (26.7606, 83.3732),
    "Hapur": (28.7305, 77.7782), "Hingoli": (19.7173, 77.1493),
    "Jalgaon": (21.0077, 75.5626), "Kolhapur": (16.7050, 74.2433),
    "Latur": (18.4088, 76.5604), "Mathura": (27.4924, 77.6737),
    "Meerut": (28.9845, 77.7064), "Moradabad": (28.8389, 78.7768),
    "Nanded": (19.1383, 77.3210), "Nandurbar": (21.3704, 74.2400),
    "Osmanabad": (18.1862, 76.0454), "Parbhani": (19.2608, 76.7762),
    "Ratnagiri": (16.9944, 73.3000), "Sambhal": (28.5818, 78.5660),
    "Sangli": (16.8524, 74.5815), "Satara": (17.6805, 74.0183),
    "Sindhudurg": (16.3500, 73.5500), "Wardha": (20.7453, 78.6022),
    "Washim": (20.1110, 77.1331), "Yavatmal": (20.3897, 78.1204),
}


def city_coordinates(spark: SparkSession) -> DataFrame:
    """A13."""
    rows = [(city, lat, lon) for city, (lat, lon) in CITY_COORDINATES.items()]
    return spark.createDataFrame(rows, "location string, lat double, lon double")


def sla_rules(spark: SparkSession) -> DataFrame:
    """Allowed days for every category and severity, before the per-case rounding."""
    rows = [
        (category, severity, days, factor)
        for category, days in SLA_DAYS.items()
        for severity, factor in SEVERITY_MULTIPLIER.items()
    ]
    return spark.createDataFrame(rows, "category string, severity string, base_days int, multiplier double")
