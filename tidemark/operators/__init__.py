"""Reusable query shapes: endpoint, series and registry deltas, ranges, rankings."""
