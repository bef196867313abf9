"""Skew-safe building blocks: ordered scans, exact quantiles, iteration."""
