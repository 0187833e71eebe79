"""Quality assurance and deduplication of large datasets on Spark."""

from sievelake.operators.minhash import MinHasher, TextDedupResult, find_near_duplicates
from sievelake.operators.reports import DiffResult, ReportSummary, diff_scans, generate_report
from sievelake.scanning import ScanMetadata, ScanResult, scan
from sievelake.version import __version__

__all__ = ["scan", "generate_report", "diff_scans", "MinHasher", "find_near_duplicates", "ScanResult", "ScanMetadata", "ReportSummary", "DiffResult", "TextDedupResult", "__version__"]
