"""All registered queries of the reference's own operators and their DuckDB counterparts."""

from __future__ import annotations

from weblake.jobs import crawl_jobs, html_jobs, join_jobs, payload_jobs, platform_jobs, stream_jobs, table_jobs, text_jobs, url_jobs
from weblake.jobs.query import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES", "crawl_jobs", "html_jobs", "join_jobs", "payload_jobs", "platform_jobs", "stream_jobs", "table_jobs", "text_jobs", "url_jobs"]
