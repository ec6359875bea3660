"""Multimodal sequence analytics as Spark DataFrame transformations."""
