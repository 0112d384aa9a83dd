"""Column builders: colour science, tone curves, identifiers."""
