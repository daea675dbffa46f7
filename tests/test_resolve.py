"""Merging, co-occurrence, similar names, repeats, numbering: against brute force on small inputs."""

import datetime as dt
import random
from collections import defaultdict
from difflib import SequenceMatcher
from itertools import combinations

import pandas as pd
from pyspark.sql import functions as F

from linkloom import schemas
from linkloom.operators import matching, resolve, score
from linkloom.operators.ordering import numbered

T0 = dt.datetime(2024, 1, 1)


def mentions(spark, rows):
    data = [
        ("inv", obs, source, T0 + dt.timedelta(hours=i), f"{kind.lower()}:{value}", kind, value, conf, props)
        for i, (obs, source, kind, value, conf, props) in enumerate(rows)
    ]
    return spark.createDataFrame(data, schemas.MENTIONS)


def test_exact_merge(spark):
    rows = mentions(
        spark,
        [
            ("o1", "dns", "Domain", "a.com", 0.7, {"x": "1", "e": ""}),
            ("o2", "whois", "Domain", "a.com", 0.9, {"x": "2", "y": "3", "e": "4"}),
            ("o2", "whois", "Domain", "a.com", 0.9, {}),
            ("o3", "dns", "IP", "1.1.1.1", 0.5, {}),
        ],
    )
    found = {r.id: r for r in resolve.resolve_exact(rows).collect()}
    a = found["domain:a.com"]
    assert (a.confidence, a.source_count, a.evidence_count) == (0.9, 2, 2)
    assert a.properties == {"x": "1", "y": "3", "e": ""}
    assert a.first_seen == T0 and a.last_seen == T0 + dt.timedelta(hours=2)
    filled = {r.id: r for r in resolve.resolve_exact(rows, fill_empty=True).collect()}
    assert filled["domain:a.com"].properties == {"x": "1", "y": "3", "e": "4"}


def test_merging_again_changes_nothing(spark):
    rows = mentions(spark, [(f"o{i % 7}", f"s{i % 3}", "Domain", f"d{i % 5}.com", 0.1 * (i % 9), {}) for i in range(60)])
    once = resolve.resolve_exact(rows)
    again = resolve.resolve_normalized(once)
    cols = ["id", "confidence", "source_count", "evidence_count"]
    assert sorted(map(tuple, once.select(cols).collect())) == sorted(map(tuple, again.select(cols).collect()))


def test_large_groups_are_paired_in_blocks(spark):
    rnd = random.Random(1)
    rows = sorted({(f"g{rnd.choice([0, 0, 0, 1, 2])}", f"m{rnd.randrange(60)}") for _ in range(300)})
    df = spark.createDataFrame(rows, "g string, m string")
    want = defaultdict(set)
    for g, m in rows:
        want[g].add(m)
    expected = sorted((g, a, b) for g, ms in want.items() for a, b in combinations(sorted(ms), 2))
    for size in (1000, 7):
        got = sorted(tuple(r) for r in resolve.member_pairs(df, ["g"], "m", size).collect())
        assert got == expected


def test_co_occurrence_confidence(spark):
    df = spark.createDataFrame(
        [("i", o, e) for o, es in {"o1": "abc", "o2": "ab", "o3": "a"}.items() for e in es],
        "investigation_id string, observation_id string, entity_id string",
    )
    got = {(r.source_id, r.target_id): (round(r.confidence, 6), r.observation_id) for r in resolve.co_occurrences(df).collect()}
    assert got == {("a", "b"): (0.9, "o1"), ("a", "c"): (0.5, "o1"), ("b", "c"): (0.75, "o1")}


def _name(rnd):
    words = ["acme", "global", "data", "systems", "north", "bank", "x", "of", "trade"]
    text = " ".join(rnd.choice(words) for _ in range(rnd.randrange(1, 4)))
    chars = list(text)
    for _ in range(rnd.randrange(0, 3)):
        at = rnd.randrange(len(chars) + 1)
        act = rnd.randrange(3)
        if act == 0:
            chars.insert(at, rnd.choice("abcxyz "))
        elif chars and act == 1:
            chars.pop(min(at, len(chars) - 1))
        elif chars:
            chars[min(at, len(chars) - 1)] = rnd.choice("abcXYZ")
    return "".join(chars)


def test_similar_names_match_brute_force(spark):
    rnd = random.Random(7)
    names = sorted({n for n in (_name(rnd) for _ in range(160)) if n})
    rows = [("i", rnd.choice(["Organization", "Person"]), n) for n in names] + [("i", "Domain", "acme.com"), ("j", "Person", names[0])]
    df = spark.createDataFrame(rows, "investigation_id string, type string, value string").withColumn(
        "id", F.concat(F.lower("type"), F.lit(":"), "value")
    )
    for threshold in (0.85, 0.7):
        want = set()
        for a, b in combinations(rows, 2):
            if a[:2] != b[:2] or a[1] == "Domain":
                continue
            x, y = sorted([f"{a[1].lower()}:{a[2]}", f"{b[1].lower()}:{b[2]}"])
            va, vb = x.split(":", 1)[1].lower(), y.split(":", 1)[1].lower()
            if SequenceMatcher(None, va, vb).ratio() >= threshold:
                want.add((x, y))
        got = {(r.id_a, r.id_b) for r in resolve.similar_entities(df, threshold).collect()}
        assert got == want
        assert want


def test_repeats_within_the_time_to_live(spark):
    rnd = random.Random(3)
    rows = []
    for i in range(400):
        # key 'hot' holds most rows
        key = "hot" if rnd.random() < 0.6 else f"k{rnd.randrange(6)}"
        rows.append((f"{i:04d}", key, T0 + dt.timedelta(minutes=rnd.randrange(0, 60 * 24 * 12))))
    df = spark.createDataFrame(rows, "id string, key string, at timestamp")
    want, last = [], {}
    for i, key, at in sorted(rows, key=lambda r: (r[2], r[0])):
        if key not in last or at >= last[key] + dt.timedelta(hours=24):
            last[key] = at
            want.append(i)
    got = sorted(r.id for r in resolve.dedupe_within(df, ["key"], "at", 86400).collect())
    assert got == sorted(want)


def test_numbering_without_gathering_groups(spark):
    rnd = random.Random(5)
    rows = [("hot" if rnd.random() < 0.7 else f"k{rnd.randrange(5)}", i, rnd.random()) for i in range(2000)]
    df = spark.createDataFrame(rows, "k string, i int, v double").repartition(6)
    got = {(r.k, r.i): r.n for r in numbered(df, ["k"], ["v", "i"], "n").collect()}
    want = {}
    by_key = defaultdict(list)
    for k, i, v in rows:
        by_key[k].append((v, i))
    for k, items in by_key.items():
        for n, (_v, i) in enumerate(sorted(items)):
            want[(k, i)] = n
    assert got == want


def test_scores_stay_in_range_and_order(spark):
    rows = mentions(
        spark,
        [("o1", "dns", "Domain", "one.com", 0.1, {})]
        + [(f"o{i}", s, "Domain", "three.com", 0.1, {}) for i, s in enumerate(["dns", "whois", "http"])],
    )
    ents = resolve.resolve_exact(rows)
    fresh = {r.id: r.confidence for r in score.score_entities(ents, "2024-01-02 00:00:00").collect()}
    old = {r.id: r.confidence for r in score.score_entities(ents, "2026-01-02 00:00:00").collect()}
    assert fresh["domain:three.com"] > fresh["domain:one.com"]
    assert all(0 <= c <= 1 for c in [*fresh.values(), *old.values()])
    assert abs(fresh["domain:one.com"] - 0.95 * 0.8) < 1e-9
    assert abs(old["domain:one.com"] - 0.95 * 0.8 * 0.75) < 1e-9
    assert old["domain:three.com"] < fresh["domain:three.com"]
    low = score.score_entities(ents, "2024-01-02 00:00:00", {"dns": 0.1}).where("id = 'domain:one.com'").first()
    assert abs(low.confidence - 0.1 * 0.8) < 1e-9


def test_ratios_as_the_library(spark):
    """Blocks found for many pairs at once are those that the standard library finds pair by pair."""
    rng = random.Random(4)
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randrange(size)))
             for alphabet in ("ab", "abcdef 01", "aä日𝄞") for size in (3, 9, 30) for _ in range(60)]
    texts += ["", "x" * 250, "xy" * 130, "user000123", "user000132"]
    left = pd.Series([rng.choice(texts) for _ in range(3000)])
    right = pd.Series([rng.choice(texts) for _ in range(3000)])
    want = [SequenceMatcher(None, a, b).ratio() for a, b in zip(left, right, strict=True)]
    assert matching.ratios(left, right).tolist() == want
    assert matching.ratios(left[:0], right[:0]).tolist() == []


def test_names_with_a_common_stem(spark, monkeypatch):
    """All names share most grams, and the groups that meet by a gram are cut into blocks."""
    monkeypatch.setattr(resolve, "BLOCK_SIZE", 25)
    names = [f"user{k:05d}" for k in range(0, 400, 3)] + ["user12", "usr00012", "useer00021"]
    df = spark.createDataFrame([("i", "Username", f"username:{n}", n) for n in names], "investigation_id string, type string, id string, value string")
    got = [(r.id_a, r.id_b) for r in resolve.similar_entities(df).collect()]
    want = set()
    for a in names:
        for b in names:
            if f"username:{a}" < f"username:{b}" and SequenceMatcher(None, a, b).ratio() >= 0.85:
                want.add((f"username:{a}", f"username:{b}"))
    assert len(got) == len(set(got)) and set(got) == want and want


def test_dense_investigations_are_counted_by_cells(spark, monkeypatch):
    """No pair is shuffled, and all of them are counted, whatever the number of blocks."""
    rnd = random.Random(3)
    rows = [(inv, f"o{o}", f"e{e}") for inv in ("a", "b") for o in range(12) for e in rnd.sample(range(40), rnd.randrange(1, 40))]
    rows += [("c", "o1", "e1"), ("c", "o1", "e2"), ("c", None, "e3"), (None, "o1", "e3")]
    table = spark.createDataFrame(rows, "investigation_id string, observation_id string, entity_id string")
    holds = defaultdict(set)
    for inv, o, e in rows:
        holds[inv, o].add(e)
    shared, total = defaultdict(set), defaultdict(set)
    for (inv, o), names in holds.items():
        if inv and o:
            for e in names:
                total[inv, e].add(o)
            for x, y in combinations(sorted(names), 2):
                shared[inv, x, y].add(o)
    want = {}
    for (inv, x, y), seen in shared.items():
        union = len(total[inv, x] | total[inv, y])
        want[inv, x, y] = (len(seen), min(seen), round(max(0.3, min(0.9, 1.5 * len(seen) / union)), 9))
    monkeypatch.setattr(resolve, "FEW_PAIRS", 10)
    monkeypatch.setattr(resolve, "PAIRS_AT_ONCE", 50)
    for cell in (4_000_000, 500):
        monkeypatch.setattr(resolve, "CELL_PAIRS", cell)
        found = resolve.co_occurrences(table.unionAll(table))
        got = {
            (r.investigation_id, r.source_id, r.target_id): (r.shared, r.observation_id, round(r.confidence, 9))
            for r in found.collect()
        }
        assert got == want
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert "FlatMapGroupsInArrow" in plan


def test_rules_for_names_run_once_a_name(spark):
    """Names are written before grams are cut out of them, so no later step holds the rule that makes them."""
    rows = spark.createDataFrame(
        [("i", "Organization", f"organization:{n}", n) for n in ("Acme Works Ltd", "acme works", "Bolt Makers")],
        "investigation_id string, type string, id string, value string",
    )
    found = resolve.similar_entities(rows, normalize=True)
    assert [(r.id_a, r.id_b) for r in found.collect()] == [("organization:Acme Works Ltd", "organization:acme works")]
    assert "ltd$" not in found._jdf.queryExecution().optimizedPlan().toString()
