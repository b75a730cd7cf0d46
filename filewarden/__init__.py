"""Content threat scanning and security-operations tables on Spark DataFrames."""

from filewarden.settings import ScanSettings

__all__ = ["ScanSettings"]
