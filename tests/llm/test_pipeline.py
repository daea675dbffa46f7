import public_tokenizers
import tiktoken

import corpus_pipeline as C
from linkloom.llm import bpe_tree, jaccard_join, repetition, secret_scan, templates

SF = "/root/testdata/sf0.001"


def test_stages_against_their_parts(spark):
    docs = C.table(spark, SF, "documents")
    columns = docs.columns
    seen = [docs.collect()]
    for name, stage in C.STAGES:
        docs = C.written(stage(spark, docs, SF))
        if name != "tokens":
            assert docs.columns == columns, name
        seen.append(docs.collect())
    first, ruled, single, clean, masked, tokens = seen
    kept = {r.doc_id for r in repetition.repetition(C.table(spark, SF, "documents")).collect() if r.kept}
    assert {r.doc_id for r in ruled} == kept and len(ruled) < len(first)
    table = spark.createDataFrame(ruled, C.table(spark, SF, "documents").schema)
    groups = {r.doc_id: r.component_id for r in jaccard_join.linked_components(table, size=C.SHINGLE, percent=C.PERCENT).collect()}
    assert {r.doc_id for r in single} == set(groups.values()) and len(single) == len(set(groups.values()))
    table = spark.createDataFrame(single, table.schema)
    leaking = {r.doc_id for r in templates.leaks(table, C.table(spark, SF, "benchmark")).collect()}
    assert {r.doc_id for r in clean} == {r.doc_id for r in single} - leaking
    table = spark.createDataFrame(clean, table.schema)
    found = secret_scan.secret_findings(table, secret_scan.train(table)).where("secret").collect()
    spans = {}
    for r in found:
        spans.setdefault(r.doc_id, []).append((r.start, r.start + r.length))
    for old, new in zip(sorted(clean), sorted(masked), strict=True):
        text = old.text
        for a, b in sorted(spans.get(old.doc_id, []), reverse=True):
            text = text[:a] + "[SECRET]" + text[b:]
        assert new.text == text and (old.text == text or new.n_chars == len(text))
    ranks = bpe_tree.read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    texts = {r.doc_id: r.text for r in masked}
    assert {r.doc_id: r.ids for r in tokens} == {k: library.encode_ordinary(t) for k, t in texts.items()}


def test_stages_take_odd_tables(spark, odd_docs):
    for docs in (odd_docs, odd_docs.limit(0)):
        for _, stage in C.STAGES:
            docs = C.written(stage(spark, docs, SF))
        assert docs.columns == ["doc_id", "n_tokens", "ids"]


def test_near_duplicates_against_five_word_sets(spark):
    docs = C.table(spark, SF, "documents")
    sets = {}
    for r in docs.collect():
        ws = (r.text or "").encode().lower().split()
        if ws:
            sets[r.doc_id] = {tuple(ws[k : k + 5]) for k in range(max(1, len(ws) - 4))}
    group = {i: i for i in sets}
    for a in sorted(sets):
        for b in sorted(sets):
            shared = len(sets[a] & sets[b])
            if a < b and 100 * shared >= 80 * (len(sets[a]) + len(sets[b]) - shared) and group[a] != group[b]:
                low, high = sorted((group[a], group[b]))
                group = {i: low if g == high else g for i, g in group.items()}
    gone = {i for i, g in group.items() if g != i}
    kept = {r.doc_id for r in C.near_duplicates(spark, docs, SF).collect()}
    assert kept == {r.doc_id for r in docs.collect()} - gone
    op8 = {r.doc_id for r in jaccard_join.one_of_each_group(docs).collect()}
    assert len(kept) < len(op8)
