"""Marketplace analytics and recommendations as Spark DataFrame operators."""
