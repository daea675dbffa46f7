"""Account linkage against brute force."""

import random
from itertools import combinations

from linkloom.functions import fixed
from linkloom.operators import accounts

ATTRIBUTES = ["email", "full_name", "organization", "website", "location"]


def test_every_qualifying_combination_is_covered_by_a_rule():
    names = list(fixed.ACCOUNT_WEIGHTS)
    total = sum(fixed.ACCOUNT_WEIGHTS.values())
    for size in range(1, len(names) + 1):
        for shared in combinations(names, size):
            best = round(min(1.0, sum(fixed.ACCOUNT_WEIGHTS[n] for n in shared) / total + 0.1), 3)
            if best >= fixed.MIN_ACCOUNT_SCORE:
                assert any(set(rule) <= set(shared) for rule in accounts._RULES), shared


def _words(bio):
    return {w for w in (x.strip(".,;:!?()\"'-").lower() for x in bio.split()) if len(w) > 3}


def _score(a, b, size):
    weight = sum(
        fixed.ACCOUNT_WEIGHTS[n] for n in ATTRIBUTES if a[n] and a[n].strip().lower() == b[n].strip().lower()
    )
    x, y = _words(a["bio"]), _words(b["bio"])
    if x and y and (len(x & y) >= 2 or len(x & y) / min(len(x), len(y)) >= 0.3):
        weight += fixed.ACCOUNT_WEIGHTS["bio_keywords"]
    if not weight:
        return 0.4
    return round(min(1.0, weight / sum(fixed.ACCOUNT_WEIGHTS.values()) + min(0.1, 0.02 * size)), 3)


def test_links_match_brute_force(spark):
    rnd = random.Random(11)
    rows = []
    for i in range(150):
        rows.append(
            {
                "investigation_id": "inv",
                "observation_id": f"o{i:03d}",
                "platform": rnd.choice(["github", "gitlab", "reddit"]),
                # one handle holds a third of all accounts
                "username": "hot" if rnd.random() < 0.33 else f"U{rnd.randrange(25)}",
                "full_name": rnd.choice(["", "Ann Lee", "ann lee ", "Bo Ray"]),
                "email": rnd.choice(["", "a@x.org", "A@x.org", "b@x.org"]),
                "bio": rnd.choice(["", "Loves hiking, coffee!", "coffee and hiking", "chess player", "plays chess daily"]),
                "organization": rnd.choice(["", "Acme", "Other"]),
                "website": rnd.choice(["", "x.org", "y.org"]),
                "location": rnd.choice(["", "Oslo", "Rome"]),
                "profile_url": "",
                "confidence": 0.5,
            }
        )
    groups = {}
    for r in rows:
        groups.setdefault(r["username"].strip().lower(), []).append(r)
    want = {}
    for handle, group in groups.items():
        for a, b in combinations(group, 2):
            s = _score(a, b, len(group))
            if s >= fixed.MIN_ACCOUNT_SCORE:
                p, q = sorted([a["platform"], b["platform"]])
                key = f"cross_platform:{p}:{q}:{handle}"
                want[key] = max(want.get(key, 0), s)
    schema = ", ".join(f"{k} {'double' if k == 'confidence' else 'string'}" for k in rows[0])
    df = spark.createDataFrame([tuple(r.values()) for r in rows], schema)
    got = {r.id: r.confidence for r in accounts.link_accounts(df).collect()}
    assert got == want and len(want) > 20


def test_busy_and_other_user_names_are_linked_alike(spark, monkeypatch):
    """Profiles meet each with each or by the keys of the rules: the links and their evidence are the same."""
    rnd = random.Random(5)
    names = "investigation_id observation_id platform username full_name email bio organization website location".split()
    rows = [
        (
            "inv", f"o{i:03d}", rnd.choice(["github", "gitlab", "reddit"]), f"u{rnd.randrange(12)}",
            *[rnd.choice([None, "", "x", "y"]) for _ in range(2)], rnd.choice([None, "", "likes green tea", "green tea, chess"]),
            *[rnd.choice([None, "", "x", "y"]) for _ in range(3)],
        )
        for i in range(200)
    ]
    df = spark.createDataFrame(rows, ", ".join(f"{n} string" for n in names))

    def links(few):
        monkeypatch.setattr(accounts, "FEW_ACCOUNTS", few)
        return sorted(tuple(r) for r in accounts.account_links(df).collect())

    at_home, by_key = links(1000), links(0)
    assert at_home == by_key and len(at_home) > 100


def test_pairs_of_accounts_are_not_joined_with_profiles_again(spark):
    """The joins left are those of user names with many accounts: sizes of keys on both sides, and the pairs."""
    df = spark.createDataFrame([["x"] * 10], ", ".join(
        f"{n} string" for n in "investigation_id observation_id platform username full_name email bio organization website "
        "location".split()
    ))
    plan = accounts.account_links(df)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join Inner") == 3


def test_same_name_alone_is_not_enough(spark):
    df = spark.createDataFrame(
        [("i", f"o{p}", p, "me", "", "", "", "", "", "", "", 0.5) for p in ("github", "reddit")],
        "investigation_id string, observation_id string, platform string, username string, full_name string, "
        "email string, bio string, organization string, website string, location string, profile_url string, "
        "confidence double",
    )
    assert accounts.link_accounts(df).count() == 0


def test_handle_variants(spark):
    from columns import column

    got = dict(zip(["alice", "John_Doe", "a.b.c"], column(spark, ["alice", "John_Doe", "a.b.c"], accounts.handle_variants, "string")))
    assert got["alice"][:6] == ["alice", "thealice", "realalice", "alice0", "alice1", "alice2"]
    assert got["alice"][6:11] == ["4lice", "a1ice", "al1ce", "alic3", "41ice"] and len(got["alice"]) == 16
    # the whole handle counts as one more part, because it has no camel case to split
    assert got["John_Doe"][1] == "JohnDoeJohn_Doe"
    probe = column(spark, ["John_Doe", "solo"], accounts.probe_variants)
    assert probe[0][:5] == ["john_doe", "johndoe", "john.doe", "john-doe", "doejohn"]
    assert probe[1] == ["solo", "solo0", "solo1", "solodev"]


def test_personal_domains(spark):
    from columns import column

    got = column(spark, ["John_Doe"], accounts.personal_domains)[0]
    assert got[0] == "johndoe.dev" and "john-doe.io" in got and "jdoe.com" in got and "johnd.app" in got
