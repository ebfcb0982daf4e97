"""Vellum: document analytics as declarative PySpark plans."""
