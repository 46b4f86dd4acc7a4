"""Every stage of the corpus pipeline against plain Python on its own input, and the whole of it."""

import collections
import random

import public_tokenizers

import corpus_pipeline
from cohortloom.llm import byte_bpe, quality_rules, simhash, source_mix
from cohortloom.session import materialize
from tests.llm import brute, data

SF = "/root/testdata/sf0.001"
RANKS = byte_bpe.load_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))


def rows(df):
    return sorted(((r["doc_id"], r["text"], r["source"]) for r in df.collect()), key=str)


def near_winners(docs):
    """The smallest doc_id of each component of fingerprints of three-word shingles within two bits."""
    return {root for _, _, root in brute.simhash([r[:2] for r in docs])}


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, stages = docs.columns, dict(corpus_pipeline.STAGES)
    good = materialize(stages["quality"](spark, docs, SF))
    verdict = {r["doc_id"]: r["kept"] for r in quality_rules.quality_rules(docs).collect()}
    assert good.columns == columns and rows(good) == [r for r in rows(docs) if verdict[r[0]]]

    exact = materialize(stages["exact_dedup"](spark, good, SF))
    kept = {d for d, _, _, keep, _ in brute.exact_dedup([r[:2] for r in rows(good)]) if keep}
    assert exact.columns == columns and rows(exact) == [r for r in rows(good) if r[0] in kept]

    near = materialize(stages["simhash_near_dedup"](spark, exact, SF))
    winners = near_winners(rows(exact))
    assert near.columns == columns and rows(near) == [r for r in rows(exact) if r[0] in winners]

    mixed = materialize(stages["source_mix"](spark, near, SF))
    times = {r["doc_id"]: r["taken"] // r["size"] for r in source_mix.source_mix(near).collect() if r["size"]}
    assert mixed.columns == columns
    assert collections.Counter(r[0] for r in rows(mixed)) == collections.Counter({d: n for d, n in times.items() if n})

    coded = stages["byte_bpe"](spark, mixed, SF)
    got = sorted(tuple(r)[:4] for r in coded.collect())
    assert got == sorted(brute.byte_bpe([r[:2] for r in rows(mixed)], RANKS))
    assert sorted(tuple(r)[:4] for r in corpus_pipeline.run(spark, SF).collect()) == got


def test_stages_on_odd_rows(spark):
    """Nulls, empty texts, repeated rows, other columns of any name: no stage fails, and each keeps the columns."""
    ids = [None if k % 4 == 0 else k // 6 for k in range(len(data.odd_texts()))]
    docs = data.clashing(data.odd_docs(spark, ids).unionByName(data.odd_docs(spark, ids)))
    for _, stage in corpus_pipeline.STAGES[:-1]:
        before, docs = docs, materialize(stage(spark, docs, SF))
        assert docs.columns == before.columns and 0 < docs.count()
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, before.limit(0), SF).count() == 0


def test_near_copies_leave_one(spark):
    """Long texts with one word changed are mostly within two bits: what stays is what brute force says."""
    texts, rng = data.odd_texts()[18].split(), random.Random(3)
    docs = []
    for k in range(40):
        own = texts[k * 400:k * 400 + 390]
        docs += [(3 * k, " ".join(own), None, "s"), (3 * k + 1, " ".join([*own[:rng.randrange(380)], "changed", *own[381:]]), None, "s"), (3 * k + 2, "  ".join(own), None, "s")]
    out = simhash.drop_near_copies(spark.createDataFrame([(*d, 0) for d in docs], data.SCHEMA)).collect()
    kept = {r["doc_id"] for r in out}
    assert kept == near_winners(docs) and {3 * k for k in range(40)} <= kept and len(kept) < 80
