import re

import corpus_pipeline as c
from marlstone.llm import packing
from tests.llm.test_codecs import check_pieces
from tests.llm.test_near_copies import brute_kept


def test_stages_hold_against_brute_force(spark):
    sf_dir = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    toxic = {r.doc_id: r.toxic for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    columns, before = docs.schema.names, {r.doc_id: r for r in docs.collect()}
    kept = {}
    for name, stage in c.STAGES[:-1]:
        docs = c.settle(stage(spark, docs, sf_dir), name)
        assert docs.schema.names == columns
        kept[name] = {r.doc_id: r for r in docs.collect()}
    gone = before.keys() - kept["toxicity"].keys()
    assert sum(toxic.get(d, 1) for d in gone) >= 0.9 * len(gone) and len(gone) > 30
    assert not [d for d in gone if toxic.get(d) == 0]
    assert kept["language"].keys() == {d for d, r in kept["toxicity"].items() if any(ch.isalpha() for ch in r.text or "")}
    first = {}
    for d, r in sorted(kept["language"].items()):
        first.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", r.text), d)
    assert kept["exact_dedup"].keys() == set(first.values())
    # near copies: five words and a similarity of 0.8 at least
    assert sorted(kept["near_dedup"]) == brute_kept([(d, r.text) for d, r in kept["exact_dedup"].items()])
    assert all(r == before[d] for d, r in kept["near_dedup"].items())
    rows = c.STAGES[-1][1](spark, docs, sf_dir).collect()
    library = packing.WordTable(packing.default_tokenizer()).library
    check_pieces(rows, [(d, r.text) for d, r in kept["near_dedup"].items()], library)
    assert sorted(map(tuple, c.run(spark, sf_dir).drop("sequence_id", "offset").collect())) == sorted((r.doc_id, r.start, r.length, r.ids_crc32, r.doc_tokens) for r in rows)


def test_stages_take_odd_and_no_rows(spark, odd, nothing, tmp_path):
    spark.createDataFrame([(1, 1, 0), (2, None, 1)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    for docs in (odd, nothing):
        for name, stage in c.STAGES:
            docs = c.settle(stage(spark, docs, str(tmp_path)), name)
        assert "sequence_id" in docs.columns
