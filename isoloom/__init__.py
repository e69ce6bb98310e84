"""Particle-field analytics as Spark DataFrame transformations."""
