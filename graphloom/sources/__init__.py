"""Readers of the graph engine inputs."""
