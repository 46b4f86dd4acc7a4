"""The operators against plain Python on the odd cases and on a small corpus."""

import collections
import random

import duckdb
import pandas
import public_tokenizers
import pytest

from cohortloom.llm import (byte_bpe, exact_dedup, license_scan, pii, quality_rules, queries, simhash, source_mix, suffix_dedup, token_counts,
                            token_files)
from tests.llm import brute, data

SF = "/root/testdata/sf0.001"
JSON_FILE, RANKS = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def tables(spark):
    """(DataFrame, sorted rows of (doc_id, text, source)) by name."""
    odd = data.odd_docs(spark)
    real = spark.read.parquet(f"{SF}/documents.parquet")
    rows = [(k * 3, t, None if k % 5 == 0 else f"s{k % 3}") for k, t in enumerate(data.odd_texts())]
    return {"odd": (data.clashing(odd), rows), "real": (real, data.small(SF)), "empty": (odd.limit(0), [])}


OPERATORS = {
    "suffix_dedup": (lambda d: suffix_dedup.suffix_dedup(d), brute.suffix_dedup, 5),
    "license_scan": (lambda d: license_scan.license_scan(d), brute.license_base, 6),
    "token_files": (lambda d: token_files.token_files(d, JSON_FILE), brute.token_files, 4),
    "exact_dedup": (lambda d: exact_dedup.exact_dedup(d), brute.exact_dedup, 5),
    "token_counts": (lambda d: token_counts.token_counts(d, JSON_FILE), brute.token_counts, 4),
    "quality_rules": (lambda d: quality_rules.quality_rules(d), brute.quality_base, 7),
    "byte_bpe": (lambda d: byte_bpe.byte_bpe(d, RANKS), lambda d: brute.byte_bpe(d, byte_bpe.load_ranks(RANKS)), 4),
    "simhash": (lambda d: simhash.simhash(d), brute.simhash, 3),
    "pii": (lambda d: pii.pii(d), lambda d: [r[:6] for r in brute.pii_base(d)], 6),
}


@pytest.mark.parametrize("table", ["odd", "real", "empty"])
@pytest.mark.parametrize("name", OPERATORS)
def test_matches_plain_python(tables, name, table):
    docs, rows = tables[table]
    operator, plain, columns = OPERATORS[name]
    got = sorted(tuple(r)[:columns] for r in operator(docs).collect())
    assert got == sorted(plain([(d, t) for d, t, _ in rows]))


@pytest.mark.parametrize("name", OPERATORS)
def test_repeated_and_missing_ids(spark, tables, name):
    """Rows that share a doc_id, or have none, give one row each; the digests and counts of a text stay its own."""
    texts = data.odd_texts()
    ids = [None if k % 4 == 0 else k // 6 for k in range(len(texts))]
    out = OPERATORS[name][0](data.odd_docs(spark, ids)).collect()
    assert collections.Counter(r["doc_id"] for r in out) == collections.Counter(ids)


def test_source_mix(tables):
    for docs, rows in tables.values():
        want = brute.mix_targets([(s, t) for _, t, s in rows])
        source = {d: s for d, _, s in rows}
        out = source_mix.source_mix(docs).collect()
        assert len(out) == len(rows)
        taken = collections.Counter()
        for r in out:
            size, target = want[source[r["doc_id"]]]
            assert r["source_size"] == size and r["target"] == pytest.approx(target, rel=1e-12)
            assert r["taken"] <= 3 * r["size"] and (r["size"] == 0 or r["taken"] % r["size"] == 0)
            taken[source[r["doc_id"]]] += r["taken"]
        longest = collections.Counter()
        for r in out:
            longest[source[r["doc_id"]]] = max(longest[source[r["doc_id"]]], r["size"])
        for s, (_, target) in want.items():
            assert abs(taken[s] - target) <= longest[s] / 2 + 1e-6
        assert sorted(out) == sorted(source_mix.source_mix(docs).collect())


def test_license_labels(tables):
    docs, rows = tables["odd"]
    out = {r["doc_id"]: r for r in license_scan.license_scan(docs).collect()}
    text = dict((d, t) for d, t, _ in rows)
    for d, r in out.items():
        assert set(r["base_labels"].split(",")) - {""} <= set(r["labels"].split(","))
        assert 0 <= r["score"] <= 1 and (r["score"] > 0) == bool(r["labels"])
        if text[d] and "GNU General" in text[d]:
            assert r["labels"] == "gpl-3"


def test_pii_spans(tables):
    docs, rows = tables["odd"]
    out = {r["doc_id"]: r["spans"].split(",") for r in pii.pii(docs).collect()}
    for d, *_, names in brute.pii_base([(d, t) for d, t, _ in rows]):
        assert set(names) <= set(out[d])
    corpus = "/root/testdata/sf0.01"
    real = {r["doc_id"]: r["spans"] for r in pii.pii(tables["real"][0].sparkSession.read.parquet(f"{corpus}/documents.parquet")).collect()}
    texts = {d: t for d, t, _ in data.small(corpus)}
    secrets = [d for d, t in texts.items() if "AKIA" in t or "password=" in t or "token = " in t]
    assert secrets and all(any(x.startswith(("key:", "secret:")) for x in real[d].split(",")) for d in secrets)


def test_quality_lines(spark):
    """A line that many different texts of a host share is common; that of copies is not."""
    line, rows = "this line stands in every page of the host and says nothing new", []
    for k in range(80):
        rows.append((k, line + "\n" + " ".join(f"w{k}x{i}" for i in range(60)), "en", "host", 0))
        rows.append((1000 + k, line + "\n" + line + "\nok", "en", "host", 0))
        rows.append((2000 + k, "\n".join(" ".join(f"c{i}{w}" for w in "abcdefgh") + " changed" * (i == k % 12) for i in range(12)), "en", "host", 0))
    out = {r["doc_id"]: r["kept"] for r in quality_rules.quality_rules(spark.createDataFrame(rows, data.SCHEMA)).collect()}
    assert all(out[k] for k in range(80)) and all(out[2000 + k] for k in range(80))
    assert not any(out[1000 + k] for k in range(80))


def test_quality_depleted_pages(spark):
    """Pages that are boilerplate but for a line of their own are rejected, though they pass the base rule."""
    rng, letters = random.Random(5), "abcdefghijklmnopqrstuvwxyz"

    def line(n):
        return " ".join("".join(rng.choices(letters, k=7)) for _ in range(n))

    shared, rows = [line(12) for _ in range(20)], []
    for k in range(51):
        rows.append((k, "\n".join([*shared, line(3)]), "en", "host", 0))
        rows.append((1000 + k, "\n".join([*shared[:2], line(60)]), "en", "host", 0))
    few, one = [line(12) for _ in range(20)], line(12) + "\n" + line(3)
    rows += [(2000 + k, "\n".join([*few, line(3)]), "en", "small", 0) for k in range(50)] + [(3000 + k, one, "en", "copies", 0) for k in range(80)]
    out = {r["doc_id"]: r for r in quality_rules.quality_rules(spark.createDataFrame(rows, data.SCHEMA)).collect()}
    assert not any(r["base_failed"] for r in out.values())
    assert {d for d, r in out.items() if not r["kept"]} == set(range(51))
    con = duckdb.connect()
    con.register("documents", pandas.DataFrame(rows, columns=["doc_id", "text", "lang", "source", "n_chars"]))
    sql = con.execute(queries.ORACLES["op7_quality_rules"]).df()
    assert {r.doc_id: (r.n_words, r.base_failed, r.kept) for r in sql.itertuples()} == {d: (r["n_words"], r["base_failed"], r["kept"]) for d, r in out.items()}


def test_license_many_notices(spark):
    """Every notice that stands in a file gives its label, however many other notices and licence words the file has."""
    notices, words = license_scan.TEMPLATES, " ".join(license_scan.VOCABULARY)
    rng, rows = random.Random(9), [(k, f"plain text {k} without any notice", "en", "s", 0) for k in range(100)]
    want = {}
    for k in range(60):
        some = notices if k == 0 else rng.sample(notices, 1 + k % 8)
        want[1000 + k] = {label for label, _, _ in some}
        rows.append((1000 + k, " . ".join([words] * (k % 2) + [f"part {i} {text} end" for i, (_, text, _) in enumerate(some)]), "en", "s", 0))
    out = {r["doc_id"]: r for r in license_scan.license_scan(spark.createDataFrame(rows, data.SCHEMA)).collect()}
    for d, labels in want.items():
        assert labels <= set(out[d]["labels"].split(",")) and out[d]["score"] == 1


def test_license_labels_by_brute_force(spark):
    """Labels and scores equal those of a scan that tries every template at every place."""
    rng, rows = random.Random(21), []
    filler = "the code of this file is kept for any person who may use it and or change it as software".split()
    for k in range(150):
        words = rng.choices(filler, k=rng.randint(0, 30))
        for _, notice, _ in rng.sample(license_scan.TEMPLATES, k % 4):
            part = notice.split()
            for _ in range(rng.choice([0, 0, 1, 4, len(part) // 3])):
                spot = rng.randrange(len(part))
                part[spot:spot + rng.randint(0, 1)] = rng.choices(filler, k=rng.randint(0, 2))
                part = part or ["end"]
            words += rng.choice([[], ["not"]]) + part + rng.choices(filler, k=rng.randint(0, 6))
        rows.append((k, " ".join(words), "en", "s", 0))
    got = {r["doc_id"]: (r["labels"], r["score"]) for r in license_scan.license_scan(spark.createDataFrame(rows, data.SCHEMA)).collect()}
    want = brute.license_labels([(d, t) for d, t, *_ in rows], license_scan)
    assert got == want
    assert len({x for x, _ in want.values()}) > 20 and any(0 < s < 1 for _, s in want.values())


def test_license_mentions_are_no_notices(spark):
    """Files that name, compare or deny a licence have no label; changed notices keep theirs."""
    mit = next(notice for label, notice, _ in license_scan.TEMPLATES if label == "mit").split()
    changed = " ".join(mit[:30] + ["and", "data"] + mit[31:70] + mit[72:])
    mentions = ["see the mozilla public license for a comparison", "this is not the mit license at all", "the gnu general public license version 3 is long",
                "this work is not licensed under the gnu general public license version 3", "permission is hereby granted free of charge",
                "redistribution and use in source and binary forms is what the bsd terms speak of", "apache license, version 1"]
    texts = [*mentions, changed, "Copyright 2001. " + changed.upper() + " THE SOFTWARE", "Licensed under the GNU Lesser General Public License"]
    rows = [(k, t, "en", "s", 0) for k, t in enumerate(texts)] + [(100 + k, f"plain text {k} the of and", "en", "s", 0) for k in range(50)]
    out = {r["doc_id"]: r["labels"] for r in license_scan.license_scan(spark.createDataFrame(rows, data.SCHEMA)).collect()}
    assert [out[k] for k in range(len(texts))] == [""] * len(mentions) + ["mit", "mit", "lgpl"]
