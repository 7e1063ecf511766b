"""Law texts: lists of slugs, versions (slug, sha, commit_ts, is_current, xml, fetch_state), their norms, a cache with lifetimes.

Defined results: a null text has no norms and no dates; of a label that comes twice in a law the first counts; repeated versions give equal
norms once; entries without a time have expired; empty tables give empty results, but an empty table of contents is an error.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from normlake.functions import text as T

#: Slugs below which a table of contents counts as broken; characters in which amendment dates stand; days that cached texts, lists and snapshots live.
LEAST_SLUGS, HEAD, DAYS = 1000, 20_000, {"current": 1, "slugs": 7, "snapshot": 365}


def slugs(toc: DataFrame, least: int = LEAST_SLUGS) -> DataFrame:
    """ordinal, slug from a table of contents (value: its text) that links <host>/<slug>/xml.zip; fails below `least`."""
    found = F.regexp_extract_all("value", F.lit("/([A-Za-z0-9_.-]+)/xml\\.zip"), F.lit(1))
    # Several rows are one list: a table of contents is small, and its rows follow each other by their text.
    whole = toc.groupBy().agg(F.flatten(F.sort_array(F.collect_list(F.struct("value", found.alias("f"))))["f"]).alias("f"))
    out = whole.select(F.posexplode(F.array_distinct("f")).alias("ordinal", "slug"))
    if (n := out.count()) < least:
        raise ValueError(f"a table of contents with {n} laws is broken")
    return out


def xml_files(listing: DataFrame) -> DataFrame:
    """slug, name: the first XML file of a listing (slug, position, name)."""
    return listing.where(F.col("name").endswith(".xml")).groupBy("slug").agg(F.min_by("name", "position").alias("name"))


def snapshot(versions: DataFrame, until: Column) -> DataFrame:
    """slug, sha: the newest version up to the end of the day `until`."""
    due = versions.where(F.col("commit_ts") < F.date_add(until.cast("date"), 1))
    return due.groupBy("slug").agg(F.max_by("sha", "commit_ts").alias("sha"))


def current(versions: DataFrame) -> DataFrame:
    """slug, sha, xml, fetch_state of current texts."""
    return versions.where("is_current").select("slug", "sha", "xml", "fetch_state")


def amendment_dates(xml: Column) -> Column:
    """Dates in the amendment notes at the head of a law, ISO, in order."""
    notes = F.regexp_extract_all(F.substring(xml, 1, HEAD), F.lit("<standkommentar>([^<]*)</standkommentar>"), F.lit(1))
    written = F.flatten(F.transform(notes, lambda n: F.regexp_extract_all(n, F.lit("v\\.?\\s*([0-9]{1,2}\\.\\s?[0-9]{1,2}\\.\\s?[0-9]{4})"), F.lit(1))))
    parts = lambda d: F.split(F.regexp_replace(d, "\\s", ""), "\\.")
    return F.sort_array(F.transform(written, lambda d: F.concat(parts(d)[2], F.lit("-"), F.lpad(parts(d)[1], 2, "0"), F.lit("-"), F.lpad(parts(d)[0], 2, "0"))))


def last_amended(xml: Column) -> Column:
    return F.array_max(amendment_dates(xml))


def norms(versions: DataFrame) -> DataFrame:
    """slug, sha, kind, number, text: every text of a law is read once. An article without a norm of its own is its section's text."""
    blocks = F.regexp_extract_all("xml", F.lit("(?s)<norm[^>]*>(.*?)</norm>"), F.lit(1))
    b = versions.select("slug", "sha", F.posexplode(blocks).alias("at", "block")).withColumn("label", F.regexp_extract("block", "<enbez>\\s*(.*?)\\s*</enbez>", 1)).where("label <> ''")
    kind = lambda c: F.when(c.startswith("§"), "§").when(c.rlike("^Art"), "Art.")
    number = lambda c: F.regexp_replace(c, "^(?:§|Art(?:ikel|\\.)?)\\s*", "")
    rest = F.substring(F.col("block"), F.instr("block", "</enbez>") + len("</enbez>"), F.length("block"))
    text = F.when(rest.rlike("(?s)<textdaten>.*</textdaten>"), F.regexp_extract(rest, "(?s)<textdaten>(.*)</textdaten>", 1)).otherwise(rest)
    own = b.select("slug", "sha", kind(F.col("label")).alias("kind"), number(F.col("label")).alias("number"), T.stripped_xml(text).alias("text"), F.lit(0).alias("from"), "at").where("kind IS NOT NULL")
    pieces = versions.select("slug", "sha", F.posexplode(F.split("xml", "<gliederungsbez>")).alias("at", "piece")).where("at > 0")
    title = F.regexp_extract("piece", "(?s)^\\s*(Art.*?)\\s*</gliederungsbez>", 1)
    section = pieces.withColumn("label", title).where(F.col("label").rlike("^Art(?:ikel|\\.)?\\s*[0-9]"))
    inner = F.substring(F.col("piece"), F.instr("piece", "</gliederungsbez>") + len("</gliederungsbez>"), F.length("piece"))
    sections = section.select("slug", "sha", F.lit("Art.").alias("kind"), number(F.col("label")).alias("number"), T.stripped_xml(inner).alias("text"), F.lit(1).alias("from"), "at")
    return own.unionByName(sections).groupBy("slug", "sha", "kind", "number").agg(F.min_by("text", F.struct("from", "at")).alias("text"))


def cached(table: DataFrame, now: Column, kind: str) -> DataFrame:
    """Entries (key, stored_ts, value) of a cache that still live."""
    return table.where(F.col("stored_ts") >= now - F.make_dt_interval(F.lit(DAYS[kind])))


def store(entries: DataFrame, path: str, now: Column) -> None:
    """Add entries (key, value) to the cache at `path`, as of now; of several entries of a key, lookup() takes the newest."""
    entries.select("key", now.cast("timestamp").alias("stored_ts"), "value").write.mode("append").parquet(path)


def lookup(spark: SparkSession, path: str, now: Column, kind: str) -> DataFrame:
    """key, value: the newest living entry of each key of the cache at `path`."""
    table = spark.read.schema("key string, stored_ts timestamp, value string").parquet(path)
    return cached(table, now, kind).groupBy("key").agg(F.max_by("value", "stored_ts").alias("value"))


class RateLimited(Exception):
    """The source takes no more requests."""


#: Answers of a source: the status codes that mean "no more requests".
LIMIT_CODES = (403, 429)


def fetched(wanted: DataFrame, get: Callable[[str, str], tuple[int, str]]) -> DataFrame:
    """slug, sha, xml, fetch_state (ok, rate_limited, error) of wanted versions (slug, sha): get(slug, sha) gives a status code and a text.

    `get` travels to the tasks; a failure is a state of its row, never of the job. Each version is asked for once.
    """

    def run(frames):
        for f in frames:
            out = []
            for slug, sha in zip(f["slug"], f["sha"]):
                try:
                    code, text = get(slug, sha)
                    state = "ok" if 200 <= code < 300 else "rate_limited" if code in LIMIT_CODES else "error"
                except RateLimited:
                    text, state = None, "rate_limited"
                except Exception:  # Whatever a given fetcher raises is an answer that failed.
                    text, state = None, "error"
                out.append((slug, sha, text if state == "ok" else None, state))
            yield pd.DataFrame(out, columns=["slug", "sha", "xml", "fetch_state"])

    return wanted.select("slug", "sha").distinct().mapInPandas(run, "slug string, sha string, xml string, fetch_state string")


def read_versions(spark: SparkSession, path: str) -> DataFrame:
    """Versions from Parquet; a version that could not be fetched has a fetch_state other than ok and no xml."""
    return spark.read.parquet(path)
