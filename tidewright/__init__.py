"""Bayes linear emulation and history matching on Spark."""
