"""Stored crawls, reports and page batches as JSON or parquet, and the audit's configuration."""

from __future__ import annotations

import json
import tomllib
from copy import deepcopy
from pathlib import Path
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

PAGE = (
    "url string, status int, html string, headers map<string,string>, depth int, load_time double,"
    " cwv struct<lcp double, cls double, inp double, fcp double, ttfb double, fid double>"
)
CRAWL = (
    f"id string, url string, project string, timestamp timestamp, config string, pages array<struct<{PAGE.replace(' string', ':string').replace(' int', ':int').replace(' map', ':map').replace(' double', ':double').replace(' struct', ':struct')}>>,"
    " stats struct<total_pages:int,duration:double,error_count:int>"
)
REPORT = (
    "id string, crawl_id string, url string, project string, timestamp timestamp, overall_score int,"
    " stats struct<total_rules:int,passed:int,warnings:int,failed:int>"
)

DEFAULTS: dict[str, Any] = {
    "project": {"name": "", "domains": []},
    "crawler": {"max_pages": 100, "concurrency": 3, "include": [], "exclude": [], "drop_query_prefixes": ["utm_", "gclid", "fbclid", "mc_", "_ga"], "allow_query_params": []},
    "rules": {"enable": ["*"], "disable": []},
    "output": {"format": "console"},
}


def read_crawls(spark: SparkSession, path: str) -> DataFrame:
    """Stored crawls, one JSON document per file, with a fixed schema."""
    return spark.read.schema(CRAWL).json(path, multiLine=True)


def crawl_pages(crawls: DataFrame) -> DataFrame:
    """A row per page of stored crawls, in order."""
    return crawls.select("id", F.posexplode("pages").alias("ord", "p")).select("id", "ord", "p.*")


def latest_crawl(crawls: DataFrame) -> DataFrame:
    return crawls.orderBy(F.col("timestamp").desc(), F.col("id").desc()).limit(1)


def read_reports(spark: SparkSession, path: str, project: str | None = None, since: str | None = None) -> DataFrame:
    """Reports of a project since a date, newest first."""
    out = spark.read.schema(REPORT).json(path, multiLine=True)
    if project:
        out = out.where(F.col("project") == project)
    if since:
        out = out.where(F.col("timestamp") >= F.to_timestamp(F.lit(since)))
    return out.orderBy(F.col("timestamp").desc())


def append(df: DataFrame, path: str, *by: str) -> None:
    """Adds rows to a table, partitioned by the columns given."""
    df.write.mode("append").partitionBy(*by).parquet(path)


def merge(base: dict, over: dict) -> dict:
    """Deep merge in which lists and plain values replace."""
    out = deepcopy(base)
    for k, v in over.items():
        out[k] = merge(out[k], v) if isinstance(v, dict) and isinstance(out.get(k), dict) else deepcopy(v)
    return out


def load_config(folder: str | Path, given: dict | None = None) -> dict:
    """Defaults, then the nearest audit.toml upward, then audit.json beside it, then what the caller gives."""
    out = deepcopy(DEFAULTS)
    start = Path(folder).resolve()
    for at in (start, *start.parents):
        if (at / "audit.toml").is_file():
            out = merge(out, tomllib.loads((at / "audit.toml").read_text()))
            break
    if (start / "audit.json").is_file():
        out = merge(out, json.loads((start / "audit.json").read_text()))
    return merge(out, given or {})


def check_config(config: dict) -> list[str]:
    """What is wrong with a configuration."""
    out = []
    crawler = config.get("crawler", {})
    if not 1 <= crawler.get("max_pages", 1) <= 1000:
        out.append("crawler.max_pages must be within 1..1000")
    if not 1 <= crawler.get("concurrency", 1) <= 20:
        out.append("crawler.concurrency must be within 1..20")
    if config.get("output", {}).get("format") not in ("console", "json", "html", "markdown", "xml"):
        out.append("output.format is unknown")
    return out
