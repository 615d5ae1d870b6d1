"""Volumetric analytics as Spark jobs, with a subpackage of corpus operators."""
