"""A day's run as a whole: counts, run and findings in the store."""

from __future__ import annotations

import datetime
import json

from pyspark.sql import functions as F

from siftline.operators.filtering import Rule
from siftline.plans.daily import backfill, run_day
from siftline.sources.store import Store

FIRST = datetime.date(2024, 5, 1)


def day_lines(spark, day, loud):
    """Six hosts whose cron logs 10 lines, and h0's 60 on a loud day."""
    rows = [f"May {day.day:2d} 10:{k % 6}0:00 h{h} cron[{k}]: job {k} done" for h in range(6) for k in range(60 if loud and h == 0 else 10 + h % 3)]
    return spark.createDataFrame(list(enumerate(rows)), "line_no long, raw string")


def test_run_day(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/store")
    limits = {"peer": {"min_count": 10}, "baseline": {"min_baseline": 1, "min_silent": 5}, "temporal": {"min_count": 5}}
    for k in range(8):
        run_day(store, day_lines(spark, FIRST + datetime.timedelta(days=k), False), FIRST + datetime.timedelta(days=k), **limits)
    last = FIRST + datetime.timedelta(days=8)
    for _ in range(2):  # the second run replaces the first
        text = run_day(store, day_lines(spark, last, True), last, **limits)
        found = store.findings().where(f"log_date = '{last}'").orderBy("id").collect()
        mine = [r for r in found if r.hosts == ["h0"]]
        assert len(mine) == 1 and mine[0].id == min(r.id for r in found) and mine[0].service == "cron"
        told = json.loads(mine[0].payload)
        assert told["os"] == "unknown" and told["example"].endswith("h0 cron[0]: job 0 done")
    runs = store.runs().orderBy("log_date").collect()
    assert len(runs) == 9 and runs[-1].raw_lines == 60 + sum(10 + h % 3 for h in range(1, 6)) and 0 < text.count() <= runs[-1].filtered_lines < runs[-1].raw_lines
    run_day(store, day_lines(spark, last, True), last, rules=[Rule(1, "h0", "cron")], **limits)
    assert store.findings().where(f"log_date = '{last}' AND hosts[0] = 'h0'").count() == 0
    assert store.counts().where(f"log_date = '{last}' AND host = 'h0'").groupBy().sum("n").first()[0] == 60


def test_backfill_equals_days_one_by_one(spark, tmp_path):
    """Findings of a range in one plan are those of its days run oldest first."""
    days = [FIRST + datetime.timedelta(days=k) for k in range(11)]
    limits = {"peer": {"min_count": 10}, "baseline": {"min_baseline": 1, "min_silent": 5}, "temporal": {"min_count": 5}}
    rules = [Rule(1, "h2", "cron", expires=days[9]), Rule(2, match="job 3 ")]
    by_day = [day_lines(spark, d, k in (8, 10)) for k, d in enumerate(days)]
    by_day[9] = by_day[9].where("NOT raw LIKE '% h4 %'")  # h4 is silent on a day
    one, whole = Store(spark, f"file://{tmp_path}/one"), Store(spark, f"file://{tmp_path}/whole")
    for d, lines in zip(days, by_day):
        run_day(one, lines, d, rules=rules, **limits)
    run_day(whole, by_day[0], days[0], rules=rules, **limits)  # what is stored of a day before counts
    every = by_day[1].withColumn("log_date", F.lit(days[1]))
    for d, lines in zip(days[2:], by_day[2:]):
        every = every.unionByName(lines.withColumn("log_date", F.lit(d)))
    for _ in range(2):
        found = backfill(whole, every, rules=rules, **limits)
    told = lambda rows: sorted((str(r.log_date), r.finding_kind, r.title, r.service, tuple(r.hosts), r.payload) for r in rows.where(F.col("log_date") > F.lit(days[0])).collect())
    assert told(found) == told(one.findings()) and len(told(found)) > 5 and {t[2] for t in told(found)} >= {"Gone silent"}
    about = lambda store: sorted((str(r.log_date), r.raw_lines, r.filtered_lines) for r in store.runs().collect())
    assert about(whole) == about(one) and whole.counts().count() == one.counts().count()
    ids = [r.id for r in whole.findings().orderBy("log_date", "id").collect()]
    assert ids == sorted(set(ids)) and max(ids) - min(ids) == len(ids) - 1 or len(ids) == len(set(ids))
