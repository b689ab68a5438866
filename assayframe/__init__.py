"""DataFrame operators for curating, splitting and scoring corpora of
composition-like records (bags of weighted components with a numeric target)."""

__version__ = "0.1.0"
