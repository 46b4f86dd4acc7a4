"""Fill-in-middle, packing and importance resampling against plain Python on the odd cases and on a small corpus."""

import collections
import itertools
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from cohortloom.llm import fill_in_middle, hilbert, importance_sample, packing, radix_sort, rank_encoder
from tests.llm import brute, data

SF = "/root/testdata/sf0.001"
JSON_FILE = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def tables(spark):
    odd, marked = data.odd_docs(spark), ["<P>", "a <S> b", "< P> <PS> <M", "tail <M>", "<", "x\n<S", "<M>" * 3, "\n", " lead", "tail \t"]
    rows = [(k * 3, t) for k, t in enumerate(data.odd_texts())] + [(1000 + k, t) for k, t in enumerate(marked)] + [(None, "no id " * 30)]
    odd = odd.unionByName(spark.createDataFrame([(d, t, None, None, None) for d, t in rows[-len(marked) - 1:]], data.SCHEMA))
    real = spark.read.parquet(f"{SF}/documents.parquet")
    return {"odd": (data.clashing(odd), rows), "real": (real, [r[:2] for r in data.small(SF)]), "empty": (odd.limit(0), [])}


def plain_order(rows):
    return sorted(rows, key=lambda r: (r[0] is None, str(r)))


# Fill-in-middle

@pytest.mark.parametrize("table", ["odd", "real", "empty"])
def test_fill_in_middle(tables, table):
    docs, rows = tables[table]
    want = brute.fill_in_middle(rows)
    made = fill_in_middle.fill_in_middle(docs)
    assert plain_order(tuple(r) for r in made.collect()) == plain_order(r[:6] for r in want)
    digests = [tuple(r) for r in fill_in_middle.fill_in_middle_digests(docs).collect()]
    assert plain_order(digests) == plain_order((*r[:5], brute.sha(r[5]), brute.sha(r[6])) for r in want)
    if rows:
        assert {r[2] for r in want} == {"plain", "psm", "spm"}


def test_fill_in_middle_shares(spark):
    docs = spark.range(4000).select(F.col("id").alias("doc_id"), F.concat(F.lit("word "), F.col("id").cast("string")).alias("text"))
    forms = collections.Counter(r["form"] for r in fill_in_middle.fill_in_middle(docs, seed=5, plain=20, suffix_first=25).collect())
    assert abs(forms["plain"] / 4000 - 0.2) < 0.03 and abs(forms["spm"] / (4000 - forms["plain"]) - 0.25) < 0.03


def test_cuts_in_words_of_eight_bytes():
    """Every byte length, space and character width around the edges of a word, with texts that begin anywhere in one."""
    rng, signs = random.Random(1), " \t\n\x0b\x0c\r\x0e\x08\x1f!ab<PSM>é中\U0001f600\x00\x85\xa0\x7f"
    for _ in range(100):
        texts = ["".join(rng.choices(signs, k=rng.randrange(40))) for _ in range(rng.randrange(1, 30))]
        raw = [t.encode() for t in texts]
        offsets = np.cumsum([0, *map(len, raw)])
        joined = np.frombuffer(b"".join(raw), np.uint8)
        draws = np.array([[rng.getrandbits(32), rng.getrandbits(32)] for _ in texts])
        n, first, second, prefix, middle = fill_in_middle.cut_texts(joined, offsets, draws)
        assert fill_in_middle.has_mark(joined, offsets).tolist() == [any(m in t for m in ("<P>", "<S>", "<M>")) for t in texts]
        for k, text in enumerate(texts):
            units = brute.UNIT.findall(text)
            a, b = sorted(int(x) % (len(units) + 1) for x in draws[k])
            parts = "".join(units[:a]), "".join(units[a:b])
            assert (n[k], prefix[k], middle[k]) == (len(units), *map(len, parts))
            assert (raw[k][:first[k] - offsets[k]].decode(), raw[k][first[k] - offsets[k]:second[k] - offsets[k]].decode()) == parts


# Packing

@pytest.mark.parametrize(("dims", "bits"), [(1, 5), (2, 5), (3, 3), (4, 2)])
def test_hilbert_curve_goes_through_neighbours(dims, bits):
    cells = np.array(list(itertools.product(range(1 << bits), repeat=dims)))
    key = hilbert.hilbert_key(cells, bits)
    assert sorted(key) == list(range(len(cells)))
    assert np.all(np.abs(np.diff(cells[np.argsort(key)], axis=0)).sum(1) == 1)


@pytest.mark.parametrize("table", ["odd", "real", "empty"])
@pytest.mark.parametrize("length", [64, 2048])
def test_packing_keeps_every_id_once(tables, table, length):
    docs, rows = tables[table]
    pieces = packing.pack(docs, JSON_FILE, length).collect()
    by_doc, by_sequence = collections.defaultdict(list), collections.defaultdict(list)
    for p in pieces:
        by_doc[p["doc_id"]].append(p)
        by_sequence[p["sequence_id"]].append(p)
    want = dict(brute.document_ids(rows, packing.END_ID))
    assert set(by_doc) == set(want)
    for d, ids in want.items():
        mine = sorted(by_doc[d], key=lambda p: p["start"])
        got = [i for p in mine for i in np.frombuffer(p["ids"], "<u4").tolist()]
        assert got == ids and all(p["doc_tokens"] == len(ids) and 4 * p["length"] == len(p["ids"]) > 0 for p in mine)
        assert [p["start"] for p in mine] == list(np.cumsum([0, *(p["length"] for p in mine)])[:-1])
    sizes = {}
    for s, mine in by_sequence.items():
        mine.sort(key=lambda p: p["offset"])
        assert [p["offset"] for p in mine] == list(np.cumsum([0, *(p["length"] for p in mine)])[:-1])
        sizes[s] = sum(p["length"] for p in mine)
    assert sorted(sizes) == list(range(len(sizes))) and all(sizes[s] == length for s in sizes if s < len(sizes) - 1)
    assert all(sizes[s] <= length for s in sizes)


def test_packed_pieces_and_sequences(tables):
    docs, rows = tables["real"]
    out = packing.packed_pieces(docs, JSON_FILE).collect()
    assert sorted(out) == sorted(packing.packed_pieces(docs.repartition(5), JSON_FILE).collect())  # however the input is split
    ids = dict(brute.document_ids(rows, 1))
    for r in out:
        part = ids[r["doc_id"]][r["start"]:r["start"] + r["length"]]
        assert r["ids_crc32"] == zlib.crc32(np.array(part, "<u4").tobytes())
    whole = packing.sequences(packing.pack(docs, JSON_FILE)).orderBy("sequence_id").collect()
    flat = np.concatenate([np.frombuffer(r["ids"], "<u4")[:r["n_tokens"]] for r in whole])
    assert len(flat) == sum(map(len, ids.values())) and all(len(r["ids"]) == 4 * 2048 for r in whole[:-1])
    last = whole[-1]
    assert len(last["ids"]) == 4 * (last["n_tokens"] if last["n_tokens"].bit_count() == 1 else 2048)


def test_ids_by_rank_are_those_of_the_library(monkeypatch):
    """Both libraries agree on odd texts, with special strings and in portions."""
    monkeypatch.setattr(rank_encoder, "BATCH_BYTES", 64)
    worker, rng = rank_encoder.rank_encoder(JSON_FILE), random.Random(3)
    texts = [t or "" for t in data.odd_texts()]
    texts += ["".join(chr(rng.choice([rng.randrange(32, 127), rng.randrange(0xD800), 32, 10])) for _ in range(rng.randrange(200))) for _ in range(500)]
    raw = [t.encode() for t in texts]
    flat, counts = worker.ids(np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)]))
    want = [worker.tokenizer.encode(t, add_special_tokens=False).ids for t in texts]
    assert counts.tolist() == list(map(len, want)) and flat.tolist() == [i for w in want for i in w]


def test_neighbours_on_the_curve_are_alike(spark):
    """Documents of four vocabularies, mixed in the input, lie in stretches of one vocabulary along the curve."""
    rng, rows = random.Random(2), []
    vocabularies = [[data.prose(rng, 1) + str(v) for _ in range(150)] for v in range(4)]
    for k in range(600):
        rows.append((k, " ".join(rng.choices(vocabularies[k % 4], k=80)), None, None, None))
    keys = packing.curve_keys(packing.encoded(spark.createDataFrame(rows, data.SCHEMA), JSON_FILE, 1)).orderBy("key").collect()
    topics = [r["doc_id"] % 4 for r in keys]
    same = sum(a == b for a, b in zip(topics, topics[1:])) / len(topics)
    assert same > 0.6  # 0.25 by chance
    assert sorted(r["doc_id"] for r in keys) == list(range(600))


# Importance resampling

@pytest.mark.parametrize(("table", "block"), [("odd", 7), ("real", 16), ("real", 1 << 18), ("empty", 16)])
def test_importance_sample(spark, tables, table, block):
    docs, rows = tables[table]
    target = spark.read.parquet(f"{SF}/benchmark.parquet")
    texts = [r["text"] for r in target.collect()]
    got = [tuple(r) for r in importance_sample.importance_sample(docs, target.withColumn("row_id", F.lit(1)), block_rows=block).collect()]
    assert plain_order(got) == plain_order(brute.importance_sample(rows, texts))


def test_importance_sample_without_target(spark, tables):
    docs, rows = tables["real"]
    got = importance_sample.importance_sample(docs, spark.createDataFrame([(None,)], "text string")).collect()
    assert plain_order(tuple(r) for r in got) == plain_order(brute.importance_sample(rows, [None]))


def test_repeated_and_missing_ids(spark, tables):
    """Ties of score and doc_id give each row a rank of its own."""
    rows = [(None if k % 3 == 0 else k % 2, "the same words again " * 6, None, None, None) for k in range(60)]
    docs = spark.createDataFrame(rows, data.SCHEMA).repartition(4)
    target = spark.createDataFrame([("words again",)], "text string")
    got = importance_sample.importance_sample(docs, target, percent=100, block_rows=5).collect()
    assert collections.Counter(r["doc_id"] for r in got) == collections.Counter(r[0] for r in rows)
    assert sorted(r["rank"] for r in got) == list(range(1, 61))
    order = sorted(got, key=lambda r: r["rank"])
    assert order == sorted(order, key=lambda r: (-r["score"], r["doc_id"] is None, r["doc_id"] or 0))
    pieces = packing.pack(docs, JSON_FILE, 64).collect()
    assert collections.Counter(p["doc_id"] for p in pieces if p["start"] == 0) == collections.Counter(r[0] for r in rows)
    made = fill_in_middle.fill_in_middle(docs).collect()
    assert collections.Counter(r["doc_id"] for r in made) == collections.Counter(r[0] for r in rows)


def test_features_over_portions(monkeypatch):
    """Pairs of words are counted over the edges of portions."""
    rng = random.Random(4)
    texts = ["".join(rng.choices("aB9 é.\x7f\n", k=rng.randrange(60))) for _ in range(300)]
    for chunk in (1, 5, 1 << 20):
        monkeypatch.setattr(importance_sample, "CHUNK", chunk)
        for t in texts:
            got = [x for some in importance_sample.buckets(t.encode()) for x in some.tolist()]
            assert collections.Counter(got) == collections.Counter(brute.features(t)[0])


@pytest.mark.parametrize(("low", "high", "block", "width"), [(64, 64, 64, 11), (9, 3, 10, 5), (0, 13, 10000, 11), (0, 0, 10, 11)])
def test_radix_ranks(spark, low, high, block, width):
    """Unsigned keys of any width, many of them equal, in blocks of any size; equal keys keep the order of reading."""
    rng = random.Random(low + high)
    rows = [(k, rng.getrandbits(low) if low and k % 3 else 0, rng.choice([0, rng.getrandbits(high)]) if high else 0) for k in range(700)]
    signed = [(k, a - (1 << 64) if a >> 63 else a, b - (1 << 64) if b >> 63 else b) for k, a, b in rows]
    table = spark.createDataFrame(signed, "row_id long, low long, high long").coalesce(1)
    order = sorted(rows, key=lambda r: (r[2], r[1], r[0]))
    got = {r["row_id"]: r["rank"] for r in radix_sort.radix_ranks(table, low, high, block, width).collect()}
    assert got == {r[0]: i for i, r in enumerate(order, 1)}
