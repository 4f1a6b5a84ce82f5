"""Command-line and REST front ends."""
