"""Ostrakon: a PySpark-native analytics engine over tables, property graphs, cohorts and documents."""
