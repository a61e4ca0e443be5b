"""Sievewright: Spark-first content intelligence operators."""
