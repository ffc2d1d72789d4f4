"""The engine's stored tables: counts by day, runs with findings, hosts and votes, noise pool, verdicts, views and entries.

All of them are parts of one set of versioned tables: a run that is done again replaces its
findings, their hosts and their votes in one step, and a stop anywhere before it leaves the old
run whole. Votes and cached views are kept in hash buckets, of which an upsert rewrites those it touches.
"""

from __future__ import annotations

import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.library import merge_votes
from ..operators.shapes import placed
from .versions import Snapshot, Versions

KINDS = ("daily", "digest")
BUCKETS = 64
#: Ids in one file of a day's findings, so that no task sorts or writes all of a large day.
FILE = 1 << 20
#: Findings are looked up by id: a bloom filter tells row groups without it.
BLOOM = {"parquet.bloom.filter.enabled#id": "true"}


class Store(Versions):
    """Tables under a folder that all executors reach."""

    COUNTS = "host string, program string, bucket string, n long, log_date date"
    RUNS = "run_id long, log_date date, kind string, model string, raw_lines long, filtered_lines long, over_budget boolean"
    FINDINGS = "id long, run_id long, log_date date, kind string, pos long, finding_kind string, severity string, title string, service string, hosts array<string>, payload string"
    HOSTS = "finding_id long, pos int, host string"
    VOTES = "finding_id long, user_id long, verdict string, comment string, created_at timestamp"
    VIEWS = "program string, template string, score double, score_model string, refused boolean, explanation string, explain_model string, created_at timestamp"
    VERDICTS = "program string, template string, verdict string, user_id long, created_at timestamp"
    POOL = "program string, template string, lines long, hosts long, n_days long, example string, example_host string, day date"
    ENTRIES = "id long, host string, program string, match string, reason string, source string, finding_id long, expires date, created_at timestamp"

    def __init__(self, spark: SparkSession, folder: str, buckets: int = BUCKETS):
        super().__init__(spark, folder)
        self.buckets = buckets

    # counts by day

    def replace_days(self, counts: DataFrame, days: list[datetime.date], marks: dict[str, int] | None = None) -> None:
        """The days' counts (host, program, bucket, log_date, n) instead of those that are there; a day without rows goes."""
        new = counts.where(F.col("log_date").isin(list(days))).select("host", "program", "bucket", F.col("n").cast("long").alias("n"), "log_date")

        def work(base: Snapshot):
            place = self.stage(new.withColumn("_day", F.col("log_date").cast("string")).repartition("_day"), "counts", by="_day")
            made = {n.removeprefix("_day="): {"path": f"{place}/{n}"} for n in self.files.names(place) if n.startswith("_day=")}
            return {"counts": {str(day): made.get(str(day)) for day in days}}, marks or {}, None

        self.change(work)

    def replace_day(self, counts: DataFrame, day: datetime.date) -> None:
        self.replace_days(counts.withColumn("log_date", F.lit(day)), [day])

    def counts(self, first: datetime.date | None = None, last: datetime.date | None = None) -> DataFrame:
        """Counts of days from ``first`` to ``last``; other days' folders are not read."""
        base = self.snapshot()
        keys = [k for k in base.tables.get("counts", {}) if (not first or k >= str(first)) and (not last or k <= str(last))]
        return self.read("counts", self.COUNTS, keys, base)

    def prune(self, today: datetime.date, keep: int = 90) -> list[str]:
        """Drop the counts of days before ``today - keep``; returns those days."""
        first = str(today - datetime.timedelta(days=keep))
        found: list[str] = []

        def work(base: Snapshot):
            found[:] = sorted(k for k in base.tables.get("counts", {}) if k < first)
            return {"counts": dict.fromkeys(found)}, {}, None

        if any(k < first for k in self.snapshot().tables.get("counts", {})):
            self.change(work)
        return found

    # runs and findings

    def capture(
        self, findings: DataFrame, day: datetime.date, kind: str, raw_lines: int | None = None, filtered_lines: int | None = None, model: str | None = None
    ) -> DataFrame:
        """``capture_days`` of one day, whose findings need no ``log_date``."""
        return self.capture_days(findings.withColumn("log_date", F.lit(day)), {day: (raw_lines, filtered_lines)}, kind, model)

    def capture_days(self, findings: DataFrame, days: dict[datetime.date, tuple[int | None, int | None]], kind: str, model: str | None = None) -> DataFrame:
        """Replace the runs of days and a kind, their findings, hosts and votes in one step; returns the findings with ids.

        ``findings``: (log_date, pos, finding_kind, severity, title, service, hosts, payload), in the
        order of days and of ``pos``, which may have gaps. ``days``: line counts before and after filtering, null if
        negative or None; a day without findings has a run all the same. Ids go on from a mark in the
        manifest and are used once; a capture that fails uses none up.
        """
        if kind not in KINDS:
            raise ValueError(f"a run is one of {', '.join(KINDS)}")
        known = lambda n: None if n is None or n < 0 else n
        ordered = sorted(days)
        given = self.once(
            findings.where(F.col("log_date").isin(ordered)).select("log_date", F.col("pos").cast("long").alias("line_no"), "finding_kind", "severity", "title", "service", "hosts", "payload")
        )
        sizes = {r.log_date: r["count"] for r in given.groupBy("log_date").count().collect()}  # a row per day

        def work(base: Snapshot):
            first, run = base.marks.get("finding", 0), base.marks.get("run", 0)
            runs, low = [], first
            for k, day in enumerate(ordered):
                runs.append((run + 1 + k, day, kind, model, *map(known, days[day]), False, low))
                low += sizes.get(day, 0)
            about = self.spark.createDataFrame(runs, f"{self.RUNS}, first long")
            rows = placed(given, "log_date").join(F.broadcast(about.select("log_date", "run_id", "first")), "log_date").select(
                (F.col("pos") + F.col("first")).alias("id"), "run_id", "log_date", F.lit(kind).alias("kind"), F.col("line_no").alias("pos"),
                "finding_kind", "severity", "title", "service", "hosts", "payload", F.col("log_date").cast("string").alias("_day"),
            )
            place = self.stage(rows.repartition("_day", F.floor(F.col("id") / FILE)).sortWithinPartitions("_day", "id"), "findings", by="_day", **BLOOM)
            stored = self.spark.read.schema(self.FINDINGS).parquet(*[f"{self.folder}/{place}/{n}" for n in self.files.names(place) if n.startswith("_day=")]) if sizes else self.read("findings", self.FINDINGS, [])
            hosts = stored.select(F.col("id").alias("finding_id"), "log_date", F.posexplode("hosts").alias("pos", "host")).dropDuplicates(["finding_id", "host"])
            host_place = self.stage(hosts.withColumn("_day", F.col("log_date").cast("string")).repartition("_day", F.floor(F.col("finding_id") / FILE)), "hosts", by="_day")
            run_place = self.stage(about.drop("first").withColumn("_day", F.col("log_date").cast("string")).repartition("_day"), "runs", by="_day")
            with_hosts = set(self.files.names(host_place))
            parts: dict[str, dict] = {"runs": {}, "findings": {}, "hosts": {}}
            for _, day, *_, before in runs:
                key, name, n = f"{day}/{kind}", f"_day={day}", sizes.get(day, 0)
                parts["runs"][key] = {"path": f"{run_place}/{name}"}
                parts["findings"][key] = {"path": f"{place}/{name}", "low": before + 1, "high": before + n} if n else None
                parts["hosts"][key] = {"path": f"{host_place}/{name}"} if name in with_hosts else None
            marks = {"run": run + len(ordered), "finding": low}
            replaced = [key for key in parts["runs"] if key in base.tables.get("findings", {})]
            if replaced:
                stale = self.read("findings", self.FINDINGS, replaced, base).select(F.col("id").alias("finding_id"))
                # votes of the runs that go; only buckets that hold some are written
                voted = stale.join(self.read("votes", self.VOTES, at=base).select("finding_id"), "finding_id", "left_semi")
                votes, more = self.rebucketed(base, "votes", self.VOTES, ["finding_id"], voted, lambda old: old.join(stale, "finding_id", "left_anti"), self.buckets)
                parts, marks = parts | votes, marks | more
            return parts, marks, stored

        return self.change(work)

    def flag_budget(self, day: datetime.date, kind: str = "daily") -> bool:
        """Note that a run stopped short of its token budget; whether there is such a run."""
        key = f"{day}/{kind}"

        def work(base: Snapshot):
            if key not in base.tables.get("runs", {}):
                return {}, {}, False
            run = self.read("runs", self.RUNS, [key], base).withColumn("over_budget", F.lit(True))
            return {"runs": {key: {"path": self.stage(run.coalesce(1), "runs")}}}, {}, True

        return self.change(work)

    def _between(self, table: str, schema: str, first, last, kind: str, at: Snapshot | None = None) -> DataFrame:
        base = at or self.snapshot()
        keys = [k for k in base.tables.get(table, {}) if (not first or k[:10] >= str(first)) and (not last or k[:10] <= str(last)) and (not kind or k[11:] == kind)]
        return self.read(table, schema, keys, base)

    def runs(self, first: datetime.date | None = None, last: datetime.date | None = None, kind: str = "") -> DataFrame:
        """Runs of days and of a kind; other runs' folders are not read."""
        return self._between("runs", self.RUNS, first, last, kind)

    def findings(self, first: datetime.date | None = None, last: datetime.date | None = None, kind: str = "") -> DataFrame:
        return self._between("findings", self.FINDINGS, first, last, kind)

    def hosts(self) -> DataFrame:
        return self.read("hosts", self.HOSTS)

    def finding(self, finding_id: int, payload: str | None = None) -> DataFrame:
        """One finding, from the one run whose ids hold it; ``payload``: a schema to decode it by."""
        base = self.snapshot()
        keys = [k for k, p in base.tables.get("findings", {}).items() if p["low"] <= finding_id <= p["high"]]
        found = self.read("findings", self.FINDINGS, keys, base).where(F.col("id") == finding_id)
        return found.withColumn("payload", F.from_json("payload", payload)) if payload else found

    # votes, verdicts, views

    def vote(self, new: DataFrame) -> None:
        """Upsert votes (finding_id, user_id, verdict, comment, created_at), one of each finding and user; a null user is the anonymous one.

        An empty comment keeps the one that is there. A verdict that isn't known, or a finding that
        isn't there, refuses all of them.
        """
        new = self.once(new.select("finding_id", "user_id", "verdict", "comment", "created_at"))
        if not new.where("verdict IS NULL OR verdict NOT IN ('worked', 'didnt_work')").isEmpty():
            raise ValueError("a verdict is worked or didnt_work")

        def work(base: Snapshot):
            lost = new.join(self.read("findings", self.FINDINGS, at=base).select(F.col("id").alias("finding_id")), "finding_id", "left_anti")
            if not lost.isEmpty():
                raise ValueError("a vote needs a finding")
            merge = lambda old: merge_votes(old, new).select("finding_id", "user_id", "verdict", "comment", "created_at")
            return *self.rebucketed(base, "votes", self.VOTES, ["finding_id"], new, merge, self.buckets), None

        self.change(work)

    def votes(self) -> DataFrame:
        return self.read("votes", self.VOTES)

    def add_verdicts(self, new: DataFrame) -> None:
        """Append verdicts on shapes (program, template, verdict, user_id, created_at)."""
        self.change(lambda base: (self.appended(base, "verdicts", self.VERDICTS, new.select(*self._names(self.VERDICTS))), {}, None))

    def verdicts(self) -> DataFrame:
        return self.read("verdicts", self.VERDICTS)

    def save_views(self, new: DataFrame) -> None:
        """Keep what a model said of shapes, one row of each program and template, the latest of ``new``."""
        keys, names = ["program", "template"], self._names(self.VIEWS)
        last = new.groupBy(*keys).agg(F.max(F.struct("created_at", *[n for n in names if n not in (*keys, "created_at")])).alias("v"))
        last = self.once(last.select(*[n if n in keys else F.col(f"v.{n}").alias(n) for n in names]))
        merge = lambda old: old.join(last.select(*keys), keys, "left_anti").select(*names).unionByName(last)
        self.change(lambda base: (*self.rebucketed(base, "views", self.VIEWS, keys, last, merge, self.buckets), None))

    def views(self) -> DataFrame:
        return self.read("views", self.VIEWS)

    # noise pool and entries

    def replace_pool(self, shapes: DataFrame, day: datetime.date) -> bool:
        """The pool of ``day``'s shapes instead of the one that is there, unless that is of a later day."""
        names = self._names(self.POOL)

        def work(base: Snapshot):
            if base.marks.get("pool", 0) > day.toordinal():
                return {}, {}, False
            return {"pool": {"pool": {"path": self.stage(shapes.withColumn("day", F.lit(day)).select(*names), "pool")}}}, {"pool": day.toordinal()}, True

        return self.change(work)

    def pool(self) -> DataFrame:
        return self.read("pool", self.POOL)

    def add_entries(self, new: DataFrame) -> DataFrame:
        """Append known entries (host, program, match, reason, source, finding_id, expires, created_at), all or, if one has neither program nor pattern, none; returns them with ids."""
        if not new.where("coalesce(program, '') = '' AND coalesce(match, '') = ''").isEmpty():
            raise ValueError("an entry needs a program or a pattern")
        names = [n for n in self._names(self.ENTRIES) if n != "id"]

        def work(base: Snapshot):
            first = base.marks.get("entry", 0)
            rows = placed(self.once(new.select(F.monotonically_increasing_id().alias("line_no"), *names))).select((F.col("pos") + first).alias("id"), *names)
            place = self.stage(rows, "entries")
            stored = self.spark.read.schema(self.ENTRIES).parquet(f"{self.folder}/{place}")
            n = stored.count()
            return {"entries": {str(first + 1): {"path": place, "low": first + 1, "high": first + n}}}, {"entry": first + n}, stored

        return self.change(work)

    def remove_entry(self, entry_id: int) -> bool:
        """Delete an entry; whether it was there. Only the part that holds it is written."""

        def work(base: Snapshot):
            for key, part in base.tables.get("entries", {}).items():
                if part["low"] <= entry_id <= part["high"]:
                    own = self.read("entries", self.ENTRIES, [key], base)
                    if not own.where(F.col("id") == entry_id).isEmpty():
                        return {"entries": {key: part | {"path": self.stage(own.where(F.col("id") != entry_id), "entries")}}}, {}, True
            return {}, {}, False

        return self.change(work)

    def entries(self) -> DataFrame:
        return self.read("entries", self.ENTRIES)

    def once(self, df: DataFrame) -> DataFrame:
        """``df`` as it was worked out once: what numbers rows reads them several times, and they have to be the same."""
        return self.spark.read.schema(df.schema).parquet(f"{self.folder}/{self.stage(df, 'given')}")

    @staticmethod
    def _names(schema: str) -> list[str]:
        return [part.split()[0] for part in schema.split(", ")]
