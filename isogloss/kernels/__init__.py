"""Kernels in numpy that know nothing of Spark."""
