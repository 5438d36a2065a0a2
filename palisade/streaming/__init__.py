"""Histograms over streams of operations."""
