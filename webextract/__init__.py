"""webextract: web-page extraction, crawling and corpus operators as Spark plans."""

from .operators.article import Options, extract, extract_articles, extract_response
from .operators.crawl import CrawlConfig, breadth_first, crawl_results
from .operators.discovery import DiscoveryConfig, discover
from .operators.fetch import fetched, from_snapshot
from .sources.html import parse_nodes, read_html_files

__all__ = [
    "CrawlConfig", "DiscoveryConfig", "Options", "breadth_first", "crawl_results", "discover", "extract", "extract_articles",
    "extract_response", "fetched", "from_snapshot", "parse_nodes", "read_html_files",
]
