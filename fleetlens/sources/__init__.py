"""Readers and normalisers of raw inputs."""
