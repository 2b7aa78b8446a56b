"""Particle-image dataset analytics on Spark: column-parameterised DataFrame functions."""
