"""Manifests, pictures and reports."""
