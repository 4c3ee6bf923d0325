"""Cadence: analytics over ordered frame sequences, and corpus operators, on Spark."""
