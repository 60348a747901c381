"""A PySpark-native analytics engine for financial due-diligence data."""
