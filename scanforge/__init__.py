"""PySpark-native analytics for time-ordered spectra."""
