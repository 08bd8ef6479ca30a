"""Declarative feature plans and specs, and their ingestion from JSON text."""
