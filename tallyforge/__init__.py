"""tallyforge: financial-statement tables, reconciliation checks and run analytics as Spark plans."""

__version__ = "0.1.0"
