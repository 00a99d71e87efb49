"""Governed-knowledge analytics as lazy DataFrame operators on Spark."""
