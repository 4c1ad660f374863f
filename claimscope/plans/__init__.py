"""Whole reports, the summaries drawn from them, and the load job."""
