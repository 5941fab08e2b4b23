"""Tessera: a PySpark-native analytics engine for noisy, repeated, multilingual text events."""
