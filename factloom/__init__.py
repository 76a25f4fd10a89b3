"""Spark jobs over tables of program facts, findings, logs and text."""
