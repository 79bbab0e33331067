"""Stateful and windowed streams over lifecycle events."""
