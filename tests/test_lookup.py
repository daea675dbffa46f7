"""Pages by key and searches by grams against plain sorting and plain search."""

import random
from datetime import datetime, timedelta

import pytest

from linkloom.operators import lookup


def test_pages_follow_each_other(spark, tmp_path):
    rnd = random.Random(1)
    start = datetime(2024, 1, 1)
    rows = [(i, None if i % 50 == 0 else start + timedelta(hours=rnd.randrange(60))) for i in range(700)]
    folder = str(tmp_path / "pages")
    lookup.write_pages(spark.createDataFrame(rows, "id bigint, at timestamp"), folder, "at", "id", rows_per_part=40)
    want = sorted(rows, key=lambda r: (r[1] is not None, r[1] or start, r[0]), reverse=True)
    got, after = [], None
    while page := lookup.page_after(spark, folder, "at", "id", 97, after).collect():
        got += [(r["id"], r["at"]) for r in page]
        after = (page[-1]["at"], page[-1]["id"])
    assert got == want


def test_a_late_page_opens_few_parts(spark, tmp_path):
    folder = str(tmp_path / "pages")
    rows = spark.range(2000).selectExpr("id", "timestamp_seconds(id) AS at")
    lookup.write_pages(rows, folder, "at", "id", rows_per_part=100)
    for after in (None, (datetime.fromtimestamp(300), 300)):
        page = lookup.page_after(spark, folder, "at", "id", 30, after)
        top = 300 if after else 2000
        assert [r.id for r in page.collect()] == list(range(top - 1, top - 31, -1))
        plan = page._jdf.queryExecution().executedPlan().toString()
        parts = plan.split("PartitionFilters: [", 1)[1].split("]", 1)[0]
        assert "_part" in parts and parts.count(",") <= 4


def test_few_tasks_write_many_parts(spark, tmp_path):
    """Parts are as small as asked for, but neither tasks nor listed folders are as many as parts."""
    folder = str(tmp_path / "pages")
    rows = spark.range(3000).selectExpr("id", "timestamp_seconds(id) AS at")
    spark.sparkContext.setJobGroup("pages", "")
    lookup.write_pages(rows, folder, "at", "id", rows_per_part=10)
    tracker = spark.sparkContext.statusTracker()
    tasks = [tracker.getStageInfo(s).numTasks for j in tracker.getJobIdsForGroup("pages") for s in tracker.getJobInfo(j).stageIds]
    spark.sparkContext.setJobGroup("none", "")
    parts = len([p for p in (tmp_path / "pages" / "rows").iterdir() if p.name.startswith("_part=")])
    assert 300 <= parts <= 310
    page = lookup.page_after(spark, folder, "at", "id", 10, (datetime.fromtimestamp(300), 300))
    assert [r.id for r in page.collect()] == list(range(299, 289, -1))
    assert len(page.inputFiles()) <= 4
    # Only the table of parts is made from a listing of all their folders.
    assert sum(n >= 290 for n in tasks) <= 1


def test_pages_of_nothing(spark, tmp_path):
    folder = str(tmp_path / "pages")
    lookup.write_pages(spark.createDataFrame([], "id bigint, at timestamp"), folder, "at", "id")
    assert lookup.page_after(spark, folder, "at", "id", 5).collect() == []
    with pytest.raises(ValueError):
        lookup.page_after(spark, folder, "at", "id", 0)


def test_search_equals_contains(spark, tmp_path):
    rnd = random.Random(4)
    rows = [(i, "".join(rnd.choices("abAB %_é", k=rnd.randrange(9))), None if i % 7 else "ab") for i in range(300)]
    rows.append((300, None, None))
    ents = spark.createDataFrame(rows, "id bigint, value string, type string")
    folder = str(tmp_path / "grams")
    lookup.add_to_index(ents.where("id < 150"), folder, ["value", "type"], ["id"], buckets=8)
    lookup.add_to_index(ents.where("id >= 150"), folder, ["value", "type"], ["id"], buckets=8)
    for text in ("a", "É", "ab", "aba", "b%_", "abab", " Ba ", "zzz"):
        wanted = text.strip().lower()
        want = {i for i, *both in rows if any(wanted in (x or "").lower() for x in both)}
        found = lookup.containing(ents, folder, text, ["value", "type"], ["id"], buckets=8)
        assert {r.id for r in found.collect()} == want
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert any("bucket#" in p.split("]", 1)[0] for p in plan.split("PartitionFilters: [")[1:])
    assert lookup.containing(ents, folder, " ", ["value"], ["id"], buckets=8).count() == 301
    lookup.add_to_index(ents.where("false"), str(tmp_path / "none"), ["value"], ["id"])
    assert lookup.containing(ents, str(tmp_path / "none"), "ab", ["value"], ["id"]).collect() == []
