"""Flood-claim and land-cover analytics expressed as Spark DataFrame plans.

``sources``    read and write delimited files, Parquet tables and field catalogues
``functions``  column expressions: text, money, exact ratios, land classes
``operators``  DataFrame-to-DataFrame steps: clean, join, aggregate, window, pivot
``plans``      whole reports, chart summaries and the load job
``checks``     stand-in tables and the query/oracle registry behind the driver entry
"""
