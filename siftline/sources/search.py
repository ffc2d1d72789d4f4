"""A search engine's index as a table: a day's documents, fetched in half-open slices of time.

A slice is a task. It opens a point in time, pages through its documents by a cursor, and counts
them against the total that the engine states; anything partial (a search that timed out, shards that
failed or were skipped over, a short count) fails the task, so that what is read is a whole day or an error. Spark
does a failed task again from its own point in time.
"""

from __future__ import annotations

import datetime
import json
import urllib.parse
import urllib.request
from collections.abc import Iterator
from dataclasses import dataclass
from zoneinfo import ZoneInfo

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

#: How long the engine keeps a point in time between two pages, documents in a page, seconds for a request, slices of a day.
KEEP_ALIVE, PAGE, SECONDS, SLICES = "2m", 5000, 60.0, 24


class Incomplete(RuntimeError):
    """The engine gave less than it has."""


def day_slices(day: str, zone: str, slices: int) -> list[tuple[str, str]]:
    """Half-open slices [first, last) that cover a local day, of 23, 24 or 25 hours, without gaps."""
    first = datetime.datetime.fromisoformat(day).replace(tzinfo=ZoneInfo(zone))
    ends = [d.timestamp() for d in (first, first + datetime.timedelta(days=1))]  # wall-clock midnights
    cuts = [round(ends[0] + (ends[1] - ends[0]) * k / slices) for k in range(slices + 1)]
    shown = [datetime.datetime.fromtimestamp(c, datetime.timezone.utc).isoformat().replace("+00:00", "Z") for c in cuts]
    return list(zip(shown, shown[1:]))


class _Client:
    def __init__(self, options: dict[str, str]):
        self.url, self.seconds = options["url"].rstrip("/"), float(options.get("seconds", SECONDS))
        self.headers = {"Content-Type": "application/json"}
        if key := options.get("apikey"):
            self.headers["Authorization"] = f"ApiKey {key}"

    def ask(self, method: str, path: str, body: dict | None = None) -> dict:
        asked = urllib.request.Request(self.url + path, json.dumps(body).encode() if body is not None else None, self.headers, method=method)
        with urllib.request.urlopen(asked, timeout=self.seconds) as reply:
            return json.loads(reply.read() or b"{}")


def _checked(reply: dict, what: str) -> dict:
    shards = reply.get("_shards", {})
    if reply.get("timed_out"):
        raise Incomplete(f"{what}: the search timed out")
    if shards.get("failed") or shards.get("successful", 0) < shards.get("total", 0):
        raise Incomplete(f"{what}: {shards.get('successful', 0)} of {shards.get('total', 0)} shards answered")
    return reply


@dataclass
class Slice(InputPartition):
    number: int
    first: str
    last: str


class _Reader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.options = options
        for needed in ("url", "index", "day"):
            if needed not in options:
                raise ValueError(f"the option {needed} is needed")

    def partitions(self) -> list[Slice]:
        o = self.options
        return [Slice(k, *ends) for k, ends in enumerate(day_slices(o["day"], o.get("zone", "UTC"), int(o.get("slices", SLICES))))]

    def read(self, part: Slice) -> Iterator[tuple]:
        o, client = self.options, _Client(self.options)
        where, time = f"{part.first} to {part.last}", o.get("time", "@timestamp")
        opened = _checked(client.ask("POST", f"/{urllib.parse.quote(o['index'], safe='*,')}/_pit?keep_alive={KEEP_ALIVE}"), where)
        if not opened.get("id"):
            raise Incomplete(f"{where}: no point in time was opened")
        point, after, total, n = opened["id"], None, None, 0
        try:
            while True:
                body = {
                    "size": int(o.get("page", PAGE)), "query": {"range": {time: {"gte": part.first, "lt": part.last}}}, "pit": {"id": point, "keep_alive": KEEP_ALIVE},
                    "sort": [{time: "asc"}, {"_shard_doc": "asc"}], "track_total_hits": total is None,
                }
                if after is not None:
                    body["search_after"] = after
                reply = _checked(client.ask("POST", "/_search?allow_partial_search_results=false", body), where)
                point, hits = reply.get("pit_id") or point, reply["hits"]
                if total is None:
                    total = hits["total"]["value"]
                if not hits["hits"]:
                    break
                for hit in hits["hits"]:
                    n += 1
                    yield (part.number << 40) + n, json.dumps(hit["_source"], ensure_ascii=False, separators=(",", ":"))
                after = hits["hits"][-1]["sort"]
            if n != total:
                raise Incomplete(f"{where}: {n} documents of {total} came")
        finally:
            try:
                client.ask("DELETE", "/_pit", {"id": point})
            except OSError:
                pass  # it ends by itself


class SearchDay(DataSource):
    """Options: url, index, day (YYYY-MM-DD), zone (UTC), slices, page, seconds, apikey, time (the field)."""

    @classmethod
    def name(cls) -> str:
        return "search_day"

    def schema(self) -> str:
        return "line_no long, raw string"

    def reader(self, schema) -> DataSourceReader:
        return _Reader(dict(self.options))


def read_day(spark: SparkSession, url: str, index: str, day: datetime.date, **options) -> DataFrame:
    """(line_no, raw) of a day's documents as JSON, numbered in the order of time; ``logs.flattened`` gives them dotted keys."""
    spark.dataSource.register(SearchDay)
    return spark.read.format("search_day").options(url=url, index=index, day=str(day), **{k: str(v) for k, v in options.items()}).load()
