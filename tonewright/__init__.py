"""Tonewright: audio processing at corpus scale as Spark queries."""
