"""Disclosure analytics as Spark DataFrame transformations."""
