"""DataFrame-to-DataFrame steps shared by the reports."""
