"""corpuskit — table-in / table-out Spark operators for labelled legal-text corpora."""

__version__ = "0.1.0"
