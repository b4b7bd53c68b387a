"""Numpy kernels that run inside Arrow batches; no Spark in here."""
