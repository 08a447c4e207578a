"""Schemas, settings and readers of the engine's inputs, and what is written of its results."""

from __future__ import annotations

import os
from collections.abc import Iterator, Mapping
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from crawlvis.sources.shared import written
from crawlvis.sources.store import Store

BOX = "struct<x:double,y:double,width:double,height:double>"
RESULT = (
    f"struct<url:string,finalUrl:string,scannedAt:string,score:double,regions:array<struct<selector:string,name:string,status:string,issueType:string,coverage:double,"
    f"evidence:string,boundingBox:{BOX},weight:double,wordCount:double,fixPrompt:string>>,rawText:string,pageHeight:double,viewportWidth:double,screenshot:struct<width:double,height:double>>"
)
COMPARISON = "struct<prevScanId:string,prevScore:double,nextScore:double,scoreDelta:double,regions:array<struct<selector:string,change:string>>>"


@dataclass(frozen=True)
class Settings:
    """What the environment sets. An empty key counts as none."""

    database_url: str = "file:./dev.db"
    allow_local_targets: bool = False
    crawler_user_agent: str = "GPTBot/1.0"
    scan_timeout_ms: int = 25_000
    rewriter_key: str | None = field(default=None, repr=False)

    @classmethod
    def read(cls, env: Mapping[str, str] = os.environ, key_name: str = "REWRITER_API_KEY") -> Settings:
        local = env.get("ALLOW_LOCAL_TARGETS", "false").lower()
        if local not in ("true", "1", "yes", "on", "y", "enabled", "false", "0", "no", "off", "n", "disabled"):
            raise ValueError("ALLOW_LOCAL_TARGETS must be true or false")
        timeout = env.get("SCAN_TIMEOUT_MS", "25000")
        if not timeout.strip().isdigit() or int(timeout) < 1:
            raise ValueError("SCAN_TIMEOUT_MS must be a positive whole number")
        return cls(env.get("DATABASE_URL", cls.database_url), local in ("true", "1", "yes", "on", "y", "enabled"), env.get("CRAWLER_USER_AGENT", cls.crawler_user_agent), int(timeout), env.get(key_name) or None)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scan_by_id(scans: DataFrame, scan_id) -> DataFrame:
    """The row of a scan; no row where there is none."""
    return scans.where(F.col("scan_id") == scan_id)


def parsed_result(blob: Column) -> Column:
    """A stored result, or null if a required field is missing or a verdict unknown. Older ones without a screenshot pass, other fields are ignored."""
    r = F.from_json(blob, RESULT)
    needed = [r[n].isNotNull() for n in ("url", "finalUrl", "scannedAt", "score", "regions", "rawText", "pageHeight", "viewportWidth")]
    region = lambda x: F.coalesce(F.array_contains(F.array(F.lit("ok"), F.lit("warn"), F.lit("bad")), x["status"]), F.lit(False)) & F.forall(
        F.array(*[x[n].isNotNull() for n in ("selector", "name", "issueType", "coverage", "evidence", "weight", "wordCount")], *[x["boundingBox"][n].isNotNull() for n in ("x", "y", "width", "height")]), lambda ok: ok
    )
    good = F.forall(r["regions"], region)
    for n in needed:
        good = n & good
    return F.when(F.coalesce(good, F.lit(False)), r)


def parsed_comparison(blob: Column) -> Column:
    c = F.from_json(blob, COMPARISON)
    good = c["prevScanId"].isNotNull() & c["prevScore"].isNotNull() & c["nextScore"].isNotNull() & c["scoreDelta"].isNotNull() & F.forall(c["regions"], lambda x: x["selector"].isNotNull() & x["change"].isNotNull())
    return F.when(F.coalesce(good, F.lit(False)), c)


def cli_json(result: Column) -> Column:
    """A result as JSON, its raw text replaced by how long it is."""
    return F.to_json(result.dropFields("raw_text").withField("raw_text_chars", F.length(result["raw_text"])))


def jpeg_size(data: bytes | None) -> tuple[int, int] | None:
    """Width and height from the first start-of-frame segment of a JPEG file."""
    if data is None or data[:2] != b"\xff\xd8" or len(data) < 4:
        return None
    at = 2
    while at + 9 < len(data) and data[at] == 0xFF:
        kind = data[at + 1]
        if 0xD0 <= kind <= 0xD9:  # markers without a segment
            at += 2
        elif 0xC0 <= kind <= 0xCF and kind not in (0xC4, 0xC8, 0xCC):
            return int.from_bytes(data[at + 7 : at + 9]), int.from_bytes(data[at + 5 : at + 7])
        else:
            at += 2 + int.from_bytes(data[at + 2 : at + 4])
    return None


def jpeg_dimensions(data: Column) -> Column:
    """struct<width, height> of JPEG files; nulls where a file isn't one."""

    @F.pandas_udf("struct<width:int,height:int>")
    def read(files: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for some in files:
            yield pd.DataFrame([jpeg_size(x) or (None, None) for x in some], columns=["width", "height"]).astype("Int32")

    return read(data)


def screenshots(spark: SparkSession, folder: str) -> DataFrame:
    """scan_id, data of a folder of screenshots, by file name."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.jpg").load(folder)
    return files.select(F.regexp_extract("path", r"([^/]+)\.jpg$", 1).alias("scan_id"), F.col("content").alias("data"))


def save_screenshots(captures: DataFrame, store: Store) -> DataFrame:
    """scan_id, saved: adds the captures (scan_id, version, data) that are readable JPEG files to a store by safe id, where the newest version counts.

    What isn't one, or has no id that a file could be named by, is left out and told so; it never fails a scan.
    """
    name = safe_id(F.col("scan_id"))
    good = (F.coalesce(name, F.lit("")) != "") & jpeg_dimensions(F.col("data"))["width"].isNotNull()
    judged = written(captures.select("scan_id", name.alias("file"), "version", "data", good.alias("saved")), "screenshots")
    store.append(judged.where("saved").select(F.col("file").alias("scan_id"), "version", "data"))
    return judged.select("scan_id", "saved")


def screenshot_store(spark: SparkSession) -> Store:
    """An empty store of screenshots by safe id."""
    return Store.made(spark.createDataFrame([], "scan_id string, version long, data binary"), "screenshots")


def safe_id(scan_id: Column) -> Column:
    return F.regexp_replace(scan_id, "[^a-zA-Z0-9_-]", "")


def append(rows: DataFrame, path: str, *partition_by: str) -> None:
    """Adds rows to a table of scans. Updates are later versions of a row, read with ``history.latest_rows``."""
    rows.write.mode("append").partitionBy(*partition_by).parquet(path)
