import itertools
import random

from prose import prose

from linkloom.llm import licenses as L


def test_longest_increasing_run_against_brute_force():
    rng = random.Random(1)
    for _ in range(200):
        pairs = list(enumerate(rng.sample(range(20), rng.randrange(9))))
        best = max(
            (n for n in range(len(pairs) + 1) for c in itertools.combinations(pairs, n) if [y for _, y in c] == sorted(y for _, y in c)),
            default=0,
        )
        found = L.increasing(pairs)
        assert len(found) == best and found == sorted(found, key=lambda p: p[1])


def test_alignment_is_a_common_subsequence():
    rng = random.Random(2)
    for _ in range(300):
        a, b = ([rng.choice("abcdef") for _ in range(rng.randrange(12))] for _ in range(2))
        found = L.align(a, b)
        assert all(a[i] == b[j] for i, j in found)
        assert all(x[0] < y[0] and x[1] < y[1] for x, y in itertools.pairwise(found))
    assert len(L.align(list("abcabc"), list("abcabc"))) == 6


def test_whole_changed_and_repeated_licenses():
    scanner = L.Scanner(L.TEMPLATES, L.MIN_COVERAGE)
    mit, apache = L.TEMPLATES["mit"], L.TEMPLATES["apache-2.0"].replace("obtain", "get")
    notice = L.TEMPLATES["mit-notice"]
    text = f"{prose(50)} {mit} {prose(30)} {apache} {notice} {notice}"
    found = scanner.findings(text.encode())
    assert [x[0] for x in found] == ["mit", "apache-2.0", "apache-notice", "mit-notice", "mit-notice"]
    assert found[0][1:] == (1.0, 50, len(L.normal_words(mit.encode()))) and found[1][1] < 1
    half = " ".join(mit.split()[:40])
    assert scanner.findings(half.encode()) == []


def test_odd_documents(spark, odd_docs, no_docs):
    assert L.license_findings(odd_docs).count() == 0 and L.license_findings(no_docs).count() == 0
    rows = [(None, L.TEMPLATES["isc"]), (1, L.TEMPLATES["isc"]), (1, L.TEMPLATES["isc"]), (2, prose(9000) + " " + L.TEMPLATES["isc"])]
    found = L.license_findings(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    assert sorted((r.doc_id or 0, r.license, r.coverage) for r in found) == [
        (k, "isc", 1.0) for k in (0, 1, 1, 2)
    ]
    assert {r.first_word for r in found} == {0, 9000}


def test_every_notice_of_the_table_is_found(spark, sf_dir):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    notices = {k: v for k, v in L.TEMPLATES.items() if k.endswith("notice")}
    want = {(d, k) for d, t in docs.items() for k, v in notices.items() if v in t}
    got = {(r.doc_id, r.license) for r in L.op9(spark, sf_dir).collect()}
    assert want and got == want
