"""Web APIs as samples: a fetcher, a Data Source of paged JSON replies, and questions, issues and read-me files from it.

A host is one task's: first pages of a host are one partition of the source, walked page by page, and rows of second
requests (answers, comments) are dealt to tasks by host. So `rate` seconds lie between two requests to a host, whatever the
number of tasks, and its robots.txt is read once a task; a task with several hosts takes them in turn, so that none waits for
another. A host that most rows name takes as long as its rate says: that is the point.
Replies differ from call to call: write a result before it is used twice.
"""

from __future__ import annotations

import json
import time
import urllib.error
import urllib.request
import urllib.robotparser
from collections.abc import Iterator
from dataclasses import dataclass, field
from urllib.parse import urlencode, urlsplit

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from quillmill.functions.text import strip
from quillmill.sources.html import clean_html

QUESTIONS = "struct<items:array<struct<question_id:long,title:string,body:string,link:string,score:long,accepted_answer_id:long,tags:array<string>,owner:struct<display_name:string>>>>"
ANSWERS = "struct<items:array<struct<body:string,score:long>>>"
ISSUES = "array<struct<number:long,title:string,body:string,html_url:string,comments:long,comments_url:string,pull_request:string,user:struct<login:string>,labels:array<struct<name:string>>>>"


@dataclass
class Fetcher:
    """GET, or POST with data, once in `rate` seconds a host at most; None where robots.txt forbids it or all tries failed."""

    rate: float = 1.0
    retries: int = 3
    timeout: float = 30.0
    agent: str = "quillmill"
    robots: bool = True
    rules: dict = field(default_factory=dict)
    last: dict = field(default_factory=dict)

    def allowed(self, url: str) -> bool:
        at = urlsplit(url)
        base = f"{at.scheme}://{at.netloc}"
        if not self.robots or not at.scheme.startswith("http"):
            return True
        if base not in self.rules:
            rules = urllib.robotparser.RobotFileParser(f"{base}/robots.txt")
            self.wait(url)
            try:
                rules.read()
            except OSError:
                rules = None  # not to be had: allowed
            self.rules[base] = rules
        return self.rules[base] is None or self.rules[base].can_fetch(self.agent, url)

    def wait(self, url: str) -> None:
        """Until the host may be asked again."""
        host = (urlsplit(url).hostname or "").lower()
        time.sleep(max(0.0, self.last.get(host, -self.rate) + self.rate - time.monotonic()))
        self.last[host] = time.monotonic()

    def __call__(self, url: str, data: dict | None = None) -> tuple[str, str] | None:
        """Body and Link header."""
        if not self.allowed(url):
            return None
        ask = urllib.request.Request(url, urlencode(data).encode() if data else None, {"User-Agent": self.agent})
        for k in range(self.retries):
            self.wait(url)
            try:
                with urllib.request.urlopen(ask, timeout=self.timeout) as reply:
                    return reply.read().decode("utf-8", "replace"), reply.headers.get("Link", "")
            except urllib.error.HTTPError as e:
                if e.code != 429 and e.code < 500:
                    return None
            except (OSError, ValueError):
                pass
            if k + 1 < self.retries:
                time.sleep(min(2**k * self.rate, 60))
        return None


@dataclass
class _Pages(InputPartition):
    """First pages of one host."""

    urls: list[str]

    def __post_init__(self):
        super().__init__(self.urls)


class PagedJson(DataSource):
    """Options: urls, a JSON list of addresses with {page}; most, pages of each; rate, retries, robots of the fetcher."""

    @classmethod
    def name(cls) -> str:
        return "paged_json"

    def schema(self) -> str:
        return "url string, page int, body string"

    def reader(self, schema) -> DataSourceReader:
        return _PagedReader(dict(self.options))


class _PagedReader(DataSourceReader):
    def __init__(self, options: dict):
        self.options = options

    def partitions(self) -> list[InputPartition]:
        hosts: dict[str, list[str]] = {}
        for u in json.loads(self.options["urls"]):
            hosts.setdefault((urlsplit(u).hostname or "").lower(), []).append(u)
        return [_Pages(us) for us in hosts.values()]

    def read(self, partition: _Pages) -> Iterator[tuple]:
        o = self.options
        get = Fetcher(float(o.get("rate", 1)), int(o.get("retries", 3)), robots=o.get("robots", "true") == "true")
        for url in partition.urls:
            yield from self._walk(get, url, int(o.get("most", 1_000_000)))

    @staticmethod
    def _walk(get: Fetcher, url: str, most: int) -> Iterator[tuple]:
        for page in range(1, most + 1):
            got = get(url.replace("{page}", str(page)))
            if got is None:
                return
            try:
                said = json.loads(got[0])
            except ValueError:
                return
            listed = said if isinstance(said, list) else said.get("items", [said])
            if not listed:
                return
            yield url, page, got[0]
            if not (said.get("has_more", False) if isinstance(said, dict) else 'rel="next"' in got[1]):
                return
            if isinstance(said, dict):
                time.sleep(said.get("backoff", 0))


def pages(spark: SparkSession, urls: list[str], **options) -> DataFrame:
    """url, page, body."""
    spark.dataSource.register(PagedJson)
    reader = spark.read.format("paged_json").option("urls", json.dumps(urls))
    return reader.options(**{k: str(v).lower() for k, v in options.items()}).load()


def in_turn(urls: list[str | None]) -> list[int]:
    """The order that takes hosts in turn: each one's first address, then each one's second, and so on."""
    seen: dict[str, int] = {}
    rounds = []
    for u in urls:
        host = (urlsplit(u).hostname or "").lower() if u else ""
        rounds.append(seen.get(host, 0))
        seen[host] = rounds[-1] + 1
    return sorted(range(len(urls)), key=rounds.__getitem__)


def fetched(df: DataFrame, url: str, out: str = "reply", **how) -> DataFrame:
    """df with the body behind the address in a column; null where there is none. Rows are dealt to tasks by the address's host."""
    at, names = df.columns.index(url), [*df.columns, out]

    def run(batches):
        get = Fetcher(**how)
        for b in batches:
            urls = b.column(at).to_pylist()
            got: list[str | None] = [None] * len(urls)
            for k in in_turn(urls):
                said = get(urls[k]) if urls[k] else None
                got[k] = said and said[0]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(got, pa.string())], names=names)

    tasks = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    host = F.lower(F.regexp_extract(F.col(url), r"(?s)\A[^:]*://(?:[^/?#]*@)?(\[[^\]]*\]|[^:/?#]*)", 1))
    # rows without an address ask nobody
    slot = F.when(F.col(url).isNull(), F.floor(F.rand(7) * tasks)).otherwise(F.pmod(F.xxhash64(host), F.lit(tasks))).cast("int")
    return df.repartitionById(tasks, slot).mapInArrow(run, df.select("*", F.lit(None).cast("string").alias(out)).schema)


def _full(df: DataFrame) -> DataFrame:
    return df.where("instruction != '' and response != ''")


def questions(spark: SparkSession, api: str, tags: list[str] | None = None, min_score: int = 0, most: int | None = None, site: str = "stackoverflow", **how) -> DataFrame:
    """Questions of a score with their accepted answers, which a second request brings."""
    ask = {"pagesize": 100, "order": "desc", "sort": "votes", "site": site, "filter": "withbody"} | ({"tagged": ";".join(tags)} if tags else {})
    rows = pages(spark, [f"{api}/questions?page={{page}}&{urlencode(ask)}"], **how).select("page", F.inline(F.from_json("body", QUESTIONS)["items"]))
    rows = rows.where((F.coalesce("score", F.lit(0)) >= min_score) & F.col("accepted_answer_id").isNotNull())
    rows = rows.limit(most) if most else rows
    rows = rows.withColumn("address", F.format_string(f"{api}/answers/%d?site={site}&filter=withbody", "accepted_answer_id"))
    answer = F.try_element_at(F.from_json("reply", ANSWERS)["items"], F.lit(1))
    rows = fetched(rows, "address", **how).withColumn("answer", answer)
    return _full(
        rows.select(
            F.format_string(f"{site}_%d", "question_id").alias("id"),
            strip(F.concat(F.coalesce("title", F.lit("")), F.lit("\n\n"), clean_html(F.col("body")))).alias("instruction"),
            clean_html(F.col("answer.body")).alias("response"),
            F.col("link").alias("source_url"),
            F.lit("CC BY-SA").alias("license"),
            F.col("owner.display_name").alias("author"),
            "tags",
            "score",
            F.col("answer.score").alias("answer_score"),
            F.lit("stackoverflowscraper").alias("source_type"),
        )
    )


def issues(spark: SparkSession, api: str, repositories: list[str], most: int | None = None, **how) -> DataFrame:
    """Closed issues that aren't pull requests, with their first comment; label names are tags."""
    urls = [f"{api}/repos/{r}/issues?state=closed&per_page=100&page={{page}}" for r in repositories]
    rows = pages(spark, urls, **how).select(F.regexp_extract("url", r"/repos/(.*)/issues\?", 1).alias("repository"), F.inline(F.from_json("body", ISSUES)))
    rows = rows.where("pull_request is null and comments > 0 and comments_url is not null")
    rows = rows.limit(most) if most else rows
    first = F.try_element_at(F.from_json("reply", "array<struct<body:string>>"), F.lit(1))["body"]
    rows = fetched(rows, "comments_url", **how)
    return _full(
        rows.select(
            F.concat_ws("_", F.lit("github"), F.replace("repository", F.lit("/"), F.lit("_")), F.col("number").cast("string")).alias("id"),
            strip(F.concat(F.coalesce("title", F.lit("")), F.lit("\n\n"), F.coalesce("body", F.lit("")))).alias("instruction"),
            first.alias("response"),
            F.col("html_url").alias("source_url"),
            F.col("user.login").alias("author"),
            F.transform("labels", lambda x: x["name"]).alias("tags"),
            "repository",
            F.lit("githubscraper").alias("source_type"),
        )
    )


def readmes(spark: SparkSession, api: str, repositories: list[str], **how) -> DataFrame:
    """A request for documentation of each repository, answered by its read-me file."""
    rows = spark.createDataFrame([(r, f"{api}/repos/{r}/readme") for r in repositories], "repository string, address string")
    content = F.get_json_object("reply", "$.content")
    rows = fetched(rows, "address", **how).where(content.isNotNull())
    return _full(
        rows.select(
            F.concat(F.lit("github_"), F.replace("repository", F.lit("/"), F.lit("_")), F.lit("_readme")).alias("id"),
            F.concat(F.lit("Provide documentation for the "), F.col("repository"), F.lit(" repository")).alias("instruction"),
            F.decode(F.unbase64(content), "UTF-8").alias("response"),
            F.substring_index("repository", "/", 1).alias("author"),
            F.array(F.lit("readme"), F.lit("documentation")).alias("tags"),
            "repository",
            F.lit("githubscraper").alias("source_type"),
        )
    )
