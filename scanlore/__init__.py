"""Spark jobs for medical-imaging metadata quality assurance."""
