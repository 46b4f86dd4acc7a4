"""Personal data by weak supervision: labelers vote, EM rates them, a span classifier decides; DataFrame functions only."""

from __future__ import annotations

import math
from collections import defaultdict

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohortloom.llm.common import materialize, numbered, whole_text

#: Kinds in the order in which spans of one start are listed.
KINDS = ("email", "ip", "card", "phone", "national_id", "key", "secret")
BASE = KINDS[:4]
_LOCAL, _HOST = "[A-Za-z0-9._%+-]", "[A-Za-z0-9-]"
#: Patterns that find the base matches, each from the leftmost place and as long as it goes. Possessive repeats and
#: starts at the edge of a run (or where the last match ended) keep them linear in texts of any length. A card's run
#: has 14 to 19 digits, which the pattern counts, so that shorter numbers make no rows.
PATTERNS = {
    "email": rf"(?:(?<!{_LOCAL})|\G){_LOCAL}++@{_HOST}++(?:\.{_HOST}++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?<![0-9])(?<![0-9][ -])[0-9](?:[ -]?[0-9]){13,18}+(?![ -]?[0-9])",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
    # Candidates beyond the base, found broadly; the classifier decides.
    "national_id": r"(?<![0-9A-Za-z-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9A-Za-z-])",
    "key": r"(?<![A-Za-z0-9])(?=[A-Z]{0,24}[0-9])(?=[0-9]{0,24}[A-Z])[A-Z0-9]{16,24}(?![A-Za-z0-9])",
    "secret": r"(?<![A-Za-z0-9])(?=[a-z]{0,64}[0-9])(?=[0-9]{0,64}[a-z])[a-z0-9]{12,64}(?![A-Za-z0-9])",
}
#: A cheap test that a text may hold a match.
MAY = {"email": "@", "phone": "+"}
CONTEXT = 32
#: Words before a span that speak for or against it, known beginnings, and the form of each kind (fixed values).
CUES = "(?i)(?:passw(?:or)?d|pwd|secret|token|api|key|auth|credential|ssn|social|security|identity|tax)"
AGAINST = "(?i)(?:sha-?(?:1|256)|md5|commit|checksum|hash|version|isbn|order|part|serial|build)[^A-Za-z]*$"
GAZETTEER = {"key": "^(?:AKIA|ASIA|AGPA|AIDA|AROA|ANPA)", "secret": "^(?:ghp|gho|xox|sk|pk|rk|eyj|glpat)", "national_id": "^(?!000|666|9)"}
FORM = {"key": "^[A-Z]{4}[A-Z0-9]{16}$", "secret": "^(?:[0-9a-f]{16,}|[a-z0-9]{20,})$", "national_id": "^[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}$"}
ASSIGN = "[=:]\\s*[\"']?$"
LABELERS = ("form", "gazetteer", "cue", "assigned", "against")


def _pieces(cut: Column, kind: str) -> Column:
    return F.transform(cut, lambda z, i: F.struct(F.lit(kind).alias("kind"), i.alias("i"), F.length(z["gap"]).alias("gap"),
                                                  z["match"].alias("match"), F.right(z["gap"], F.lit(CONTEXT)).alias("context")))


def matches(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """All rows as (row_id, doc_id), and row_id, kind, match, start, end, context of every match, in code points.

    A text is split at its matches; the lengths of the pieces give the places. The running sum is over the matches
    of one kind in one document.
    """
    text = whole_text(docs)
    raw = numbered(docs, text.alias("_text"))
    per_kind = []
    for kind, pattern in PATTERNS.items():
        may = F.col("_text").contains(MAY[kind]) & F.col("_text").rlike(pattern) if kind in MAY else F.col("_text").rlike(pattern)
        cut = F.arrays_zip(F.split("_text", pattern, -1).alias("gap"), F.regexp_extract_all(F.col("_text"), F.lit(pattern), F.lit(0)).alias("match"))
        per_kind.append(F.when(may, _pieces(cut, kind)))
    nothing = "array<struct<kind:string,i:int,gap:int,match:string,context:string>>"
    found = raw.select("row_id", "doc_id", F.flatten(F.array(*[F.coalesce(k.cast(nothing), F.array().cast(nothing)) for k in per_kind])).alias("found"))
    written = materialize(found)
    flat = written.filter("size(found) > 0").select("row_id", F.explode("found").alias("f")).select("row_id", "f.*")
    before = Window.partitionBy("row_id", "kind").orderBy("i").rowsBetween(Window.unboundedPreceding, -1)
    past = F.coalesce(F.sum(F.col("gap") + F.length(F.coalesce("match", F.lit("")))).over(before), F.lit(0))
    placed = flat.withColumn("start", past + F.col("gap")).filter("match is not null")
    return written.select("row_id", "doc_id"), placed.select("row_id", "kind", "match", "start", (F.col("start") + F.length("match")).alias("end"), "context")


def _luhn(digits: Column) -> Column:
    total = F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), lambda s, i: s + _luhn_digit(digits, i))
    return total % 10 == 0


def _luhn_digit(digits: Column, i: Column) -> Column:
    d = F.substring(F.reverse(digits), i, F.lit(1)).cast("int")
    twice = d * 2
    return F.when(i % 2 == 1, d).otherwise(F.when(twice > 9, twice - 9).otherwise(twice))


def holds(kind: Column, match: Column) -> Column:
    """Whether a base match passes its kind's test."""
    digits = F.regexp_replace(match, "[^0-9]", "")
    parts = F.transform(F.split(match, "\\."), lambda p: F.regexp_replace(p, "^0+", ""))
    small = F.forall(parts, lambda p: (F.length(p) < 3) | ((F.length(p) == 3) & (p <= "255")))
    return (F.when(kind == "email", True).when(kind == "ip", small)
            .when(kind == "card", F.length(digits).between(14, 19) & _luhn(digits))
            .when(kind == "phone", F.length(digits).between(10, 15)).otherwise(False))


def votes(candidates: DataFrame) -> DataFrame:
    """One column per labeler: 1 for, 0 against, null for no opinion."""
    kind, match, context = F.col("kind"), F.col("match"), F.col("context")

    def by_kind(table):
        out = F.lit(None).cast("boolean")
        for k, pattern in table.items():
            out = F.when(kind == k, match.rlike(pattern)).otherwise(out)
        return out

    cue, against = context.rlike(CUES), context.rlike(AGAINST)
    return candidates.select(
        "*", by_kind(FORM).cast("int").alias("form"), F.when(by_kind(GAZETTEER), 1).alias("gazetteer"),
        F.when(cue, 1).alias("cue"), F.when(context.rlike(ASSIGN), 1).alias("assigned"), F.when(against, 0).alias("against"))


def reliabilities(patterns: list[tuple[str, tuple, int]], rounds: int = 50) -> dict[tuple, float]:
    """Chance that a candidate is personal data, for each (kind, votes), by expectation-maximisation over counts.

    Each labeler of a kind has two rates of voting 'for' (given yes and no) and of silence; they start at the belief
    that votes are right more often than not. One row per vote pattern: three to the power of the labelers at most.
    """
    out: dict[tuple, float] = {}
    by_kind = defaultdict(list)
    for kind, vote, n in patterns:
        by_kind[kind].append((vote, n))
    for kind, rows in by_kind.items():
        width = len(LABELERS)
        prior = 0.5
        yes = [{1: 0.6, 0: 0.1, None: 0.3} for _ in range(width)]
        no = [{1: 0.15, 0: 0.45, None: 0.4} for _ in range(width)]
        post: dict[tuple, float] = {}
        for _ in range(rounds):
            for vote, _n in rows:
                a, b = math.log(prior), math.log(1 - prior)
                for k, v in enumerate(vote):
                    a, b = a + math.log(yes[k][v]), b + math.log(no[k][v])
                post[vote] = 1 / (1 + math.exp(min(50.0, b - a)))
            total = sum(n for _, n in rows)
            mass = sum(n * post[v] for v, n in rows)
            prior = min(0.99, max(0.01, (mass + 1) / (total + 2)))
            for k in range(width):
                for table, weight, start in ((yes, lambda v: post[v], {1: 6, 0: 1, None: 3}), (no, lambda v: 1 - post[v], {1: 1.5, 0: 4.5, None: 4})):
                    sums = {c: start[c] + sum(n * weight(v) for v, n in rows if v[k] == c) for c in (1, 0, None)}
                    whole = sum(sums.values())
                    table[k] = {c: x / whole for c, x in sums.items()}
        out |= {(kind, v): p for v, p in post.items()}
    return out


def _features(vote: tuple) -> list[float]:
    return [1.0, *[1.0 if v == 1 else -1.0 if v == 0 else 0.0 for v in vote]]


def train(patterns: list[tuple[str, tuple, int]], chances: dict[tuple, float], rounds: int = 300, rate: float = 0.5) -> dict[str, list[float]]:
    """Weights of a logistic span classifier for each kind, from the vote patterns, their counts and their chances."""
    models = {}
    for kind in sorted({k for k, _, _ in patterns}):
        rows = [(_features(v), n, chances[kind, v]) for k, v, n in patterns if k == kind]
        total = sum(n for _, n, _ in rows)
        w = [0.0] * (len(LABELERS) + 1)
        for _ in range(rounds):
            step = [-1e-3 * x for x in w]
            for x, n, p in rows:
                guess = 1 / (1 + math.exp(-max(-30.0, min(30.0, sum(a * b for a, b in zip(w, x))))))
                for i, a in enumerate(x):
                    step[i] += n / total * (p - guess) * a
            w = [a + rate * b for a, b in zip(w, step)]
        models[kind] = [round(a, 6) for a in w]
    return models


def _score(models: dict[str, list[float]]) -> Column:
    out = F.lit(-1.0)
    for kind, (bias, *weights) in models.items():
        total = F.lit(bias)
        for name, w in zip(LABELERS, weights):
            total = total + F.lit(w) * F.when(F.col(name) == 1, 1.0).when(F.col(name) == 0, -1.0).otherwise(0.0)
        out = F.when(F.col("kind") == kind, total).otherwise(out)
    return out


def find_pii(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(row_id, doc_id) of every row, and the spans that hold: row_id, kind, start, end, match, base."""
    rows, placed = matches(docs)
    placed = materialize(placed)
    base = placed.filter(F.col("kind").isin(*BASE)).filter(holds(F.col("kind"), F.col("match")))
    candidates = votes(placed.filter(~F.col("kind").isin(*BASE)))
    counted = candidates.groupBy("kind", *LABELERS).agg(F.count(F.lit(1)).alias("n")).collect()  # vote patterns: bounded
    patterns = sorted(((r["kind"], tuple(r[x] for x in LABELERS), r["n"]) for r in counted), key=str)
    models = train(patterns, reliabilities(patterns))
    more = candidates.filter(_score(models) > 0)
    columns = ["row_id", "kind", "start", "end", "match"]
    return rows, base.select(*columns, F.lit(True).alias("base")).unionByName(more.select(*columns, F.lit(False).alias("base")))


def pii(docs: DataFrame) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans for every row.

    Null and empty texts have no spans (an empty string, and its digest). Rows that repeat are searched each; other
    columns are ignored.
    """
    rows, spans = find_pii(docs)
    order = F.array_position(F.array(*[F.lit(k) for k in KINDS]), F.col("kind"))
    name = F.concat_ws(":", "kind", F.col("start").cast("string"), F.col("end").cast("string"))
    listed = spans.groupBy("row_id").agg(
        F.sort_array(F.collect_list(F.struct("start", order.alias("order"), "end", name.alias("name"), "base", "kind"))).alias("s"))
    listing = "array<struct<start:bigint,order:bigint,end:bigint,name:string,base:boolean,kind:string>>"
    joined = rows.join(listed, "row_id", "left").withColumn("s", F.coalesce(F.col("s").cast(listing), F.array().cast(listing)))
    base = F.filter("s", lambda x: x["base"])

    def many(kind: str) -> Column:
        return F.size(F.filter("s", lambda x: x["base"] & (x["kind"] == kind))).cast("long").alias(f"n_{kind}")

    return joined.select("doc_id", *[many(k) for k in BASE],
                         F.sha2(F.array_join(F.transform(base, lambda x: x["name"]), ",").cast("binary"), 256).alias("base_sha256"),
                         F.array_join(F.transform("s", lambda x: x["name"]), ",").alias("spans"))
