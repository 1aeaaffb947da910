"""Compositions of operators: problem preparation and update rounds."""
