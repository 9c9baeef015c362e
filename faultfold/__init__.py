"""Log triage on Spark: ingest, classify, fingerprint, fold into daily tickets, report."""

__version__ = "0.1.0"
