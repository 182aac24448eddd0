"""A code host's REST API as a source: a client with retries, rate limits and pagination, and a data source over it.

Off by default: nothing here runs unless a caller registers the source and names a host.
"""

from __future__ import annotations

import json
import re
import time
import urllib.error
import urllib.request
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

#: url, headers -> status, headers, body
Send = Callable[[str, dict], tuple[int, dict, str]]


class RateLimited(Exception):
    """The host asks to wait longer than the client may."""


def send(url: str, headers: dict) -> tuple[int, dict, str]:
    try:
        with urllib.request.urlopen(urllib.request.Request(url, headers=headers), timeout=30) as r:
            return r.status, {k.lower(): v for k, v in r.headers.items()}, r.read().decode()
    except urllib.error.HTTPError as e:
        return e.code, {k.lower(): v for k, v in e.headers.items()}, e.read().decode()


@dataclass
class Client:
    host: str = "https://api.github.com"
    token: str | None = None
    send: Send = send
    tries: int = 3
    longest_wait: float = 60.0
    sleep: Callable[[float], None] = time.sleep
    now: Callable[[], float] = time.time
    waited: float = field(default=0.0, init=False)

    def _wait(self, seconds: float) -> None:
        if seconds > self.longest_wait:
            raise RateLimited(f"the host asks to wait {seconds:.0f} s")
        self.waited += seconds
        self.sleep(seconds)

    def get(self, url: str) -> tuple[dict, object]:
        """Headers and JSON of one page. Network errors and 5xx are tried again, with doubling waits."""
        url = url if url.startswith("http") else self.host + url
        headers = {"Accept": "application/json"} | ({"Authorization": f"Bearer {self.token}"} if self.token else {})
        for k in range(self.tries):
            try:
                status, got, body = self.send(url, headers)
            except OSError:
                if k + 1 == self.tries:
                    raise
                self._wait(2.0**k)
                continue
            if status == 429 or (status == 403 and got.get("x-ratelimit-remaining") == "0"):
                self._wait(max(1.0, float(got.get("retry-after") or float(got.get("x-ratelimit-reset", 0)) - self.now())))
                continue
            if status >= 500 and k + 1 < self.tries:
                self._wait(2.0**k)
                continue
            if status >= 400:
                raise ValueError(f"{status} for {url}: {body[:200]}")
            return got, json.loads(body)
        raise RateLimited(f"no answer for {url} in {self.tries} tries")

    def pages(self, url: str, most: int = 10) -> Iterator[object]:
        """The JSON of up to ``most`` pages, as the Link header goes on."""
        for _ in range(most):
            headers, body = self.get(url)
            yield body
            m = re.search(r'<([^>]+)>;\s*rel="next"', headers.get("link", ""))
            if not m:
                return
            url = m.group(1)

    def commits(self, repository: str, since: str | None = None, most: int = 10) -> Iterator[tuple]:
        """(repository, sha, author, author_email, timestamp, message) newest first."""
        url = f"/repos/{repository}/commits?per_page=100" + (f"&since={since}" if since else "")
        for page in self.pages(url, most):
            for c in page:
                a = c["commit"]["author"] or {}
                yield repository, c["sha"], a.get("name"), a.get("email"), a.get("date"), c["commit"]["message"]


class CommitSource(DataSource):
    """spark.read.format("host_commits").option("repositories", "a/b,c/d").load(): one partition per repository."""

    @classmethod
    def name(cls) -> str:
        return "host_commits"

    def schema(self) -> str:
        return "repository string, sha string, author string, author_email string, timestamp string, message string"

    def reader(self, schema) -> DataSourceReader:
        return CommitReader(dict(self.options))


class CommitReader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.options = options

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(r.strip()) for r in self.options["repositories"].split(",") if r.strip()]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        how = send
        if "pages" in self.options:  # a JSON file of url -> page, for tests and replays

            def how(url: str, headers: dict) -> tuple[int, dict, str]:
                with open(self.options["pages"]) as f:
                    page = json.load(f).get(url)
                return (404, {}, "{}") if page is None else (200, page.get("headers", {}), json.dumps(page["body"]))

        client = Client(self.options.get("host", Client.host), self.options.get("token"), how)
        yield from client.commits(partition.value, self.options.get("since"))


def register(spark: SparkSession) -> None:
    spark.dataSource.register(CommitSource)
