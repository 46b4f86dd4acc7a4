"""Skew-safe paths give the same rows as the plain ones."""

import numpy as np
import pandas as pd
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from cohortloom.catalog import star
from cohortloom.catalog.covariates import q_analysis_set_full
from cohortloom.catalog.summaries import _dated, q_missingness_rates
from cohortloom.functions import skew
from cohortloom.functions.quantiles import grouped_quantiles, with_ordered_key
from cohortloom.functions.ranks import bucketed_rank
from cohortloom.functions.scans import in_blocks
from cohortloom.functions.skew import BROADCAST_ROWS, _hot_keys, attach_index, fits, lookup_join, skew_join
from cohortloom.operators.cohort import earliest, index_event
from cohortloom.operators.covariates import nearest_reference_join
from cohortloom.operators.endpoints import ActivitySource, EventRule, censor_date, code_events, first_event_after_index, first_events
from cohortloom.operators.summaries import first_treatment_rates, table_one, univariate_summary
from cohortloom.operators.survival import kaplan_meier
from cohortloom.session import scratch_dir


def rows(df):
    return sorted(map(str, df.select(sorted(df.columns)).collect()))


@pytest.fixture(scope="module")
def skewed(spark):
    # one key holds a third of the rows, some of them equal
    big = spark.range(6000).select(
        F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 50 + 1).alias("k"),
        (F.col("id") % 40).alias("v")).repartition(6)
    small = spark.range(0, 45).select(F.col("id").alias("k"), (F.col("id") * 2).alias("w"))
    return big, small


@pytest.mark.parametrize("how", ["inner", "left"])
def test_skew_join_keeps_every_row(skewed, how):
    big, small = skewed
    want = rows(big.join(small, "k", how))
    assert rows(skew_join(big, small, ["k"], how, hot_rows=100)) == want
    assert rows(lookup_join(big, small, ["k"], how, max_rows=0, hot_rows=300)) == want
    assert rows(lookup_join(big, small, ["k"], how)) == want


def test_skew_join_spreads_the_hot_key(skewed):
    big, small = skewed
    hot = big.groupBy("k").count().filter("count > 100").collect()
    assert max(r["count"] for r in hot) == 2000
    plan = skew_join(big, small, ["k"], hot_rows=100)._jdf.queryExecution().toString()
    assert "_salt" in plan
    with pytest.raises(ValueError):
        skew_join(big, small, ["k"], "right")


def test_attach_index_paths_agree(skewed):
    big, small = skewed
    want = rows(attach_index(big, small, ["k"], small=True))
    assert rows(attach_index(big, small, ["k"], small=False, hot_rows=100)) == want
    assert rows(attach_index(big, small, ["k"], distinct=True, small=False)) == sorted(set(want))


@pytest.mark.parametrize("buckets", [1, 7])
def test_bucketed_rank_is_a_permutation(spark, buckets):
    df = spark.range(500).select("id", (F.col("id") % 2).alias("g"))
    out = bucketed_rank(df, ["g"], [F.col("id")], buckets).toPandas()
    for _g, part in out.groupby("g"):
        assert sorted(part["rank"]) == list(range(250))


@settings(max_examples=8, deadline=None, suppress_health_check=list(HealthCheck))
@given(values=st.lists(st.integers(-20, 20), min_size=1, max_size=60), few=st.sampled_from([0, 1000]))
def test_quantiles_match_numpy(spark, values, few):
    probs = [0, 0.05, 0.25, 0.5, 0.9, 1]
    df = spark.createDataFrame(pd.DataFrame({"v": np.array(values, dtype="float64")}))
    got = {r["prob"]: r["value"] for r in grouped_quantiles(df, [], "v", probs, few).collect()}
    for p in probs:
        assert got[p] == pytest.approx(np.percentile(values, p * 100))


@pytest.mark.parametrize("few", [0, 40])
def test_quantiles_digit_by_digit(spark, few):
    """Constant, skewed, tied, tiny and huge values, and a missing group, down to the last digit."""
    rng = np.random.default_rng(1)
    groups = {"normal": rng.normal(size=3000), "constant": np.full(500, -7.25), "skewed": np.exp(rng.normal(size=900) * 9) - 1,
              "tied": rng.integers(0, 3, 800).astype(float), "tiny": rng.normal(size=200) * 5e-320, "huge": rng.normal(size=200) * 1e307,
              "ends": np.array([-np.inf, -0.0, 0.0, 5e-324, -5e-324, np.inf, 1.0, np.nextafter(1.0, 2.0)]), None: np.array([3.0, 4.0])}
    df = spark.createDataFrame([(g, float(x)) for g, v in groups.items() for x in v] + [("none", None)], "g string, v double")
    probs = [0.0, 0.1, 0.5, 0.99, 1.0]
    out = {(r["g"], r["prob"]): r["value"] for r in grouped_quantiles(df, ["g"], "v", probs, few).collect()}
    assert len(out) == len(groups) * len(probs)
    for g, v in groups.items():
        for p in probs:
            order, at = np.sort(v), p * (len(v) - 1)
            low, high = order[int(np.floor(at))], order[int(np.ceil(at))]
            if np.isinf(low) or np.isinf(high):
                assert out[g, p] in (low, high)
            else:
                assert out[g, p] == pytest.approx(low + (at - np.floor(at)) * (high - low), rel=1e-12, abs=0)


def test_ordered_keys_are_those_of_the_bits(spark):
    rng = np.random.default_rng(2)
    v = np.concatenate([rng.integers(0, 1 << 64, 20000, dtype=np.uint64).view(np.float64), 2.0 ** np.arange(-1074, 1024), np.nextafter(2.0 ** np.arange(-1022, 1024), 0)])
    v = v[np.isfinite(v)]
    bits = np.abs(v).view(np.int64) * np.where(v < 0, -1, 1)
    df = spark.createDataFrame(pd.DataFrame({"v": v, "bits": bits}))
    assert with_ordered_key(df, "v", "key").filter("key <> bits").count() == 0


def test_only_measured_frames_are_broadcast(spark, tmp_path):
    """File sizes and plan guesses say little: long equal strings and exploded rows are seen for what they are."""
    spark.range(5_000_000).select(F.repeat(F.lit("x"), 100).alias("s")).write.parquet(f"{tmp_path}/wide")
    spark.range(1000).write.parquet(f"{tmp_path}/thin")
    wide, thin = spark.read.parquet(f"{tmp_path}/wide"), spark.read.parquet(f"{tmp_path}/thin")
    assert not fits(wide, BROADCAST_ROWS)
    assert not fits(wide.limit(600_000), BROADCAST_ROWS)
    assert not fits(thin.select(F.explode(F.sequence(F.lit(1), F.lit(100_000)))), BROADCAST_ROWS)
    assert fits(thin, BROADCAST_ROWS) and fits(thin, 1000) and not fits(thin, 999) and not fits(thin, 0)
    assert fits(thin.select("id", F.array(F.lit("a")).alias("x"), F.lit(None).alias("n")), BROADCAST_ROWS)


class _Conf:
    def __init__(self, value):
        self.value = value

    def get(self, _key, default=None):
        return self.value or default


class _Session:
    def __init__(self, master, folder):
        self.conf = _Conf(folder)
        self.sparkContext = type("Context", (), {"master": master, "applicationId": "app-1"})()


def test_scratch_folder_comes_from_the_session():
    assert scratch_dir(_Session("spark://host", "hdfs://shared/ck/")).startswith("hdfs://shared/ck/app-1/")
    a, b = (scratch_dir(_Session("local[2]", None)) for _ in range(2))
    assert a != b and a.rsplit("/", 1)[0] == b.rsplit("/", 1)[0]
    with pytest.raises(RuntimeError):
        scratch_dir(_Session("spark://host", None))


def test_index_event_same_at_any_size(spark):
    """The condition may test any event column, also one that tells two events of a day apart."""
    events = spark.createDataFrame([(1, "2020-01-01", "A", 1), (1, "2020-01-01", "B", 2), (2, "2020-01-02", "A", 3), (None, "2020-01-02", "B", 4)],
                                   "p int, d string, kind string, e int")
    persons = spark.createDataFrame([(1, "x"), (2, "y")], "p int, sex string")
    got = [sorted(map(tuple, index_event(events, persons, ["p"], "d", F.col("kind") == "B", ["e"], ["e"], ["sex"], small).collect()))
           for small in (True, False)]
    assert got[0] == got[1] == [(1, "2020-01-01", 2, "x")]


def test_nearest_reference_answers_every_row(spark):
    rows = spark.createDataFrame([(1, 5, 2.0), (1, 5, 2.0), (1, 5, 9.0), (2, None, 1.0), (3, 6, None), (3, 7, 1.0)], "id int, b int, v double")
    ref = spark.createDataFrame([(5, 1.0, "a"), (5, 3.0, "b"), (5, 8.0, "c"), (6, 1.0, "d")], "b int, at double, name string")
    got = [sorted(map(str, nearest_reference_join(rows, ref, {"b": "b"}, "v", "at", {"name": "name"}, n).collect())) for n in (100, 0)]
    assert got[0] == got[1] and len(got[0]) == 6


def test_nearest_reference_in_one_bucket(spark):
    """As many asked values as points, all of one bucket: merged in one order, with nothing of their product's size."""
    rng = np.random.default_rng(3)
    points, values = np.unique(rng.integers(0, 10**7, 100_000)) / 8, rng.integers(-1000, 10**7 + 1000, 100_000) / 8
    rows = spark.createDataFrame(pd.DataFrame({"id": np.arange(100_000), "b": 1, "v": values})).repartition(5)
    ref = spark.createDataFrame(pd.DataFrame({"b": 1, "at": points, "name": np.arange(len(points))}))
    out = nearest_reference_join(rows, ref, {"b": "b"}, "v", "at", {"name": "name"}, 0)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "Cartesian" not in plan and "Generate" not in plan
    got = out.toPandas().sort_values("id")
    above = np.searchsorted(points, values, "right").clip(0, len(points) - 1)
    below = (above - 1).clip(0)
    below = np.where(points[above] <= values, above, below)
    want = np.where(np.abs(points[above] - values) < np.abs(points[below] - values), above, below)
    assert len(got) == 100_000 and (got["at"].to_numpy() == points[want]).all() and (got["name"].to_numpy() == want).all()


def test_nearest_reference_over_many_ranges(spark):
    rng = np.random.default_rng(4)
    rows = spark.createDataFrame([(k, None if k % 50 == 0 else int(rng.integers(0, 4)), None if k % 31 == 0 else float(rng.integers(0, 300))) for k in range(900)], "id int, b int, v double")
    ref = spark.createDataFrame([(int(rng.integers(0, 3)), None if k == 7 else float(rng.integers(0, 300)), k) for k in range(250)], "b int, at double, name int")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = [sorted(map(str, nearest_reference_join(rows, ref.filter("at is not null"), {"b": "b"}, "v", "at", {"name": "name"}, n).collect())) for n in (1000, 0)]
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert got[0] == got[1] and len(got[0]) == 900


def test_survival_over_a_million_times(spark):
    """Times as fine as the rows: the curve equals the one added up in a row, and is dealt over tasks."""
    n = 1_000_000
    df = spark.range(n).select(F.lit("g").alias("g"), (F.col("id") * 7919 % n * 1000003).alias("t"), (F.col("id") % 3 == 0).cast("int").alias("s"))
    curve = kaplan_meier(df, "t", "s", ["g"]).select("t", "n_risk", "n_event", "survival", "std_err_log").toPandas().sort_values("t")
    order = df.select("t", "s").toPandas().sort_values("t")
    risk, event = np.arange(n, 0, -1), order["s"].to_numpy()
    with np.errstate(divide="ignore", invalid="ignore"):
        want, var = np.cumprod(1 - event / risk), np.cumsum(event / (risk * (risk - event)))
    assert (curve["n_risk"].to_numpy() == risk).all() and np.allclose(curve["survival"], want, rtol=1e-9, atol=1e-15)
    some = risk > event
    assert np.allclose(curve["std_err_log"].to_numpy()[some], np.sqrt(var[some]), rtol=1e-9)
    blocks = in_blocks(df, ["g"], ["t"]).groupBy("_part").count().toPandas()["count"]
    assert len(blocks) > 1 and blocks.max() < n / 2


def test_one_scan_for_all_rules(spark, tmp_path):
    """Four rules over one table give what four passes give, from one scan."""
    rng = np.random.default_rng(5)
    pd.DataFrame({"p": rng.integers(0, 40, 3000), "flag": rng.choice(list("RAN"), 3000), "code": rng.integers(0, 30, 3000),
                  "d": pd.Timestamp("2020-01-01") + pd.to_timedelta(rng.integers(0, 400, 3000), "D")}).astype({"d": "datetime64[us]"}).to_parquet(f"{tmp_path}/e.parquet")
    events = spark.read.parquet(f"{tmp_path}/e.parquet")
    cohort = spark.createDataFrame([(p, f"2020-0{1 + p % 9}-15") for p in range(30)], "p long, i string").withColumn("i", F.to_date("i"))
    a = spark.createDataFrame([(k, f"t{k % 3}") for k in range(20)] + [(3, "t9")], "code long, therapy string")
    b = spark.createDataFrame([(f"N{k}", f"t{k % 2}") for k in range(25)], "ndc string, therapy string")
    package = F.concat(F.lit("N"), F.col("code").cast("string"))
    rules = [EventRule("r", F.col("code"), F.col("d"), a, "code", F.col("flag") == "R", 30), EventRule("a", package, F.col("d"), b, "ndc", F.col("flag") == "A"),
             EventRule("n", F.col("code"), F.col("d"), a, "code", F.col("flag") == "N", 10), EventRule("all", package, F.col("d"), b, "ndc", None, 400)]
    out = first_events(cohort, events, rules, ["p"], "i", "therapy")
    assert out._jdf.queryExecution().optimizedPlan().toString().count("Relation [p#") == 1
    want = []
    for r in rules:
        rows = events if r.condition is None else events.filter(r.condition)
        tagged = code_events(rows.select("p", r.code.cast("string").alias("c"), "d"), r.codes.withColumn("c", F.col(r.codes_column).cast("string")), "c", "c", "therapy")
        one = first_event_after_index(cohort, tagged, ["p"], "i", "d", ["therapy"], r.lookback_days)
        want += [(x["p"], r.source, x["therapy"], x["first_date"]) for x in one.collect()]
    assert sorted((x["p"], x["source"], x["therapy"], x["first_date"]) for x in out.collect()) == sorted(want) and want


def test_missing_keys_go_round_the_skew_join(spark):
    big = spark.range(4000).select(F.when(F.col("id") < 9, F.col("id")).alias("k"), "id")
    small = spark.createDataFrame([(k, k * 2) for k in range(5)], "k long, w long")
    out = skew_join(big, small, ["k"], "left", hot_rows=100)
    assert out.count() == 4000 and out.filter("w is not null").count() == 5
    assert skew_join(big, small, ["k"], hot_rows=100).count() == 5


def test_missing_group_has_quantiles_and_ranks(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 2.0), (None, 5.0), (None, 7.0), ("b", None)], "g string, v double")
    got = {(r["g"], r["prob"]): r["value"] for r in grouped_quantiles(df, ["g"], "v", [0.0, 0.5]).collect()}
    assert got == {("a", 0.0): 1.0, ("a", 0.5): 1.5, (None, 0.0): 5.0, (None, 0.5): 6.0}
    ranks = bucketed_rank(df, ["g"], [F.col("v")], 3).collect()
    assert sorted((str(r["g"]), r["rank"]) for r in ranks) == [("None", 0), ("None", 1), ("a", 0), ("a", 1), ("b", 0)]


def test_missing_group_enters_no_test(spark):
    df = spark.createDataFrame([("x", "u", 1.0), ("x", "u", 2.0), ("y", "v", 3.0), ("y", "v", 5.0), (None, "u", 9.0)], "g string, f string, n double")
    rows = univariate_summary(df, ["n", "f"], ["f"], "g").collect()
    assert {r["grp"] for r in rows} == {"ALL", "x", "y"}
    assert {r["n"] for r in rows if r["var"] == "n" and r["grp"] == "ALL"} == {5}
    test = {r["var"]: r for r in rows}
    assert test["n"]["df1"] == 1 and test["n"]["df2"] == 2 and abs(test["n"]["statistic"] - 5.0) < 1e-9
    assert abs(test["f"]["statistic"] - 4.0) < 1e-9


def test_missing_site_keeps_its_rows(spark):
    df = spark.createDataFrame([(1, "a", 3, "m"), (2, None, 4, "f"), (3, None, 6, "f")], "p int, s string, age int, sex string")
    cells = {(r["summ_var"], r["s"]): r["summ_val"] for r in table_one(df, "p", "s", "age", {"sex": "sex"}).collect()}
    assert cells["1_N", None] == "2 (100%)" and cells["sex:f", None] == "2 (100%)" and cells["2_age", None] == "5 (1.4)"
    rates = first_treatment_rates(spark.createDataFrame([(k, 2020, "t" if k else "u") for k in range(16)], "p int, y int, trt1 string"), "p", "y")
    assert {r["var"]: r["p"] for r in rates.collect()}["u"] == 0.062


def _joins(df):
    plan = df._jdf.queryExecution().executedPlan().toString()
    return sum(plan.count(j) for j in ("SortMergeJoin", "ShuffledHashJoin")), plan.count("BroadcastHashJoin")


def test_skew_join_shuffles_each_side_once(skewed, spark):
    """Without a hot key the join is a plain one; with some only their small table is added, by broadcast."""
    big, small = skewed
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plain, spread = skew_join(big, small, ["k"]), skew_join(big, small, ["k"], hot_rows=100)
        assert _joins(plain) == (1, 0) and "_salt" not in plain._jdf.queryExecution().toString()
        assert _joins(spread) == (1, 2)
        assert rows(plain) == rows(spread) == rows(big.join(small, "k"))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_hot_keys_are_found_by_count(spark):
    """Every key above the limit and no other, also where keys of several columns share a hash bucket."""
    df = spark.range(30_000).select((F.col("id") % 9000).alias("a"), F.when(F.col("id") % 9000 < 3, "x").otherwise((F.col("id") % 2).cast("string")).alias("b"))
    want = {(r["a"], r["b"]): -(-r["count"] // 3) for r in df.groupBy("a", "b").count().filter("count > 3").collect()}
    assert want and {(r["a"], r["b"]): r["_salts"] for r in _hot_keys(df, ["a", "b"], 3).collect()} == want
    assert _hot_keys(df, ["a", "b"], 30_000) is None


@pytest.fixture(scope="module")
def shop(spark, tmp_path_factory):
    """A few customers with orders, lines of every flag and parts of every rule."""
    d, n = str(tmp_path_factory.mktemp("shop")), 40
    days = pd.Timestamp("1992-01-01") + pd.to_timedelta(np.arange(n * 4) * 11, "D")
    parts = [("large ring", "SMALL"), ("red box", "STANDARD"), ("anvil", "LARGE"), ("gizmo", "ECONOMY")]
    tables = {
        "customer": pd.DataFrame({"c_custkey": np.arange(n) + 3000, "c_nationkey": 1, "c_acctbal": 5.0, "c_mktsegment": "BUILDING"}),
        "orders": pd.DataFrame({"o_orderkey": np.arange(n * 4), "o_custkey": np.arange(n * 4) % n + 3000, "o_orderstatus": "O",
                                "o_orderdate": days, "o_orderpriority": "1-URGENT"}),
        "lineitem": pd.DataFrame({"l_orderkey": np.arange(n * 24) % (n * 4), "l_partkey": np.arange(n * 24) % 30, "l_suppkey": 1,
                                  "l_linenumber": np.arange(n * 24) % 7, "l_returnflag": [("R", "A", "N", None)[k // 7 % 4] for k in range(n * 24)],
                                  "l_linestatus": "O", "l_shipdate": np.resize(days, n * 24) + pd.to_timedelta(9, "D")}),
        "part": pd.DataFrame([(k, *parts[k % 4], 1) for k in range(30)], columns=["p_partkey", "p_name", "p_type", "p_size"])}
    for name, df in tables.items():
        spark.createDataFrame(df).write.parquet(f"{d}/{name}.parquet")
    return d


def test_endpoints_write_the_lines_they_read(spark, monkeypatch, shop):
    """Lines without a prescription or procedure, and columns of neither, are not written."""
    written = []
    monkeypatch.setattr(star, "materialize", lambda df, *by: written.append(df) or df)
    assert star.stack(spark, shop).filter("endpoint = 'base_a'").count() > 0
    lines = next(df for df in written if "l_returnflag" in df.columns)
    assert {r[0] for r in lines.select("l_returnflag").distinct().collect()} == {"R", "A"}
    assert not {"l_suppkey", "l_linestatus"} & set(lines.columns)


def test_dated_timeline_selects_the_cohort_once(spark, monkeypatch, shop):
    made, cohort = [], star.cohort
    monkeypatch.setattr(star, "cohort", lambda *a: made.append(a) or cohort(*a))
    assert {r["index_year"] for r in _dated(spark, shop).collect()} and len(made) == 1
    made.clear()
    seen = {r["index_year"]: r["n_year"] for r in q_missingness_rates(spark, shop).collect()}
    assert len(made) == 1 and sum(seen.values()) == _dated(spark, shop).count()


def test_full_set_passes_its_cohort_to_the_timeline(spark, monkeypatch, shop):
    class Reached(Exception):
        pass

    def timeline(spark, sf, who=None):
        raise Reached(who)

    monkeypatch.setattr(star, "timeline", timeline)
    with pytest.raises(Reached) as reached:
        q_analysis_set_full(spark, shop)
    who = reached.value.args[0]
    assert who is not None and who.columns == ["person_id", "index_date"] and who.count() == star.cohort(spark, shop).count() > 0


def test_lines_reach_the_orders_as_kind_day_and_code(spark, monkeypatch, shop):
    """A procedure that no endpoint reads has no code left; the rows that are written give the same endpoints as the lines."""
    written, joined, join = [], [], star.lookup_join
    monkeypatch.setattr(star, "materialize", lambda df, *by: written.append(df) or df)
    monkeypatch.setattr(star, "lookup_join", lambda big, small, on: joined.append(big) or join(big, small, on, max_rows=0, hot_rows=50))
    who = star.cohort(spark, shop).select("person_id", "index_date")
    kept = star.activity(spark, shop, who)
    assert [df.columns for df in joined] == [["l_orderkey", "kind", "day", "l_partkey"]] and written == [kept]
    assert {r[0] for r in kept.filter("l_returnflag = 'A'").select("l_partkey").distinct().collect()} == {7, 12, 17, None}
    monkeypatch.undo()
    lines = star.lines(spark, shop, who)
    for part in (star.first_prescriptions, star.surgery):
        assert rows(part(spark, shop, who, rows=kept)) == rows(part(spark, shop, who, rows=lines)) != []
    apart = censor_date(who, [ActivitySource(star.diagnoses(spark, shop), "admit_date", "dx_date"),
                              ActivitySource(star.procedures(spark, shop, lines), "admit_date", "px_date"),
                              ActivitySource(star.prescribing(spark, shop, lines), "start_date", "order_date")], ["person_id"], "index_date")
    assert rows(star.censoring(spark, shop, who, rows=kept)) == rows(apart) != []


@pytest.mark.parametrize("key", ["long", "int", "date", "string"])
def test_rows_without_a_partner_are_gone_before_the_join(spark, key):
    """All rows with a partner stay, of the others few; keys of several columns, missing ones and types without a filter too."""
    as_key = F.date_add(F.lit("1990-01-01").cast("date"), F.col("id").cast("int")) if key == "date" else (F.col("id") * 7 - 9000).cast(key)
    big = spark.range(20_000).select(F.when(F.col("id") % 50 != 0, as_key).alias("k"), (F.col("id") % 3).alias("part"), F.col("id").alias("v"))
    looked_up = big.filter("v % 10 = 1 or v % 50 = 0").withColumn("w", F.col("v") * 2)
    for on in (["k"], ["k", "part"]):
        small = looked_up.select(*on, "w")
        kept, want = skew.matching(big, small, on), big.join(small, on)
        few = kept.count()
        assert kept.columns == big.columns and rows(kept.join(small, on)) == rows(want) != []
        assert few == 20_000 if key == "string" else 2_000 <= few <= 3_000
        assert rows(skew_join(big, small, on, selective=True)) == rows(want)
        assert rows(skew_join(big, small, on, "left", hot_rows=100, selective=True)) == rows(big.join(small, on, "left"))
    assert skew.matching(big, looked_up.withColumn("k", F.col("v").cast("short")), ["k"]).count() == 20_000


def test_lines_of_other_persons_are_gone_before_the_shuffle(spark, monkeypatch, shop):
    """Lines join the orders of a few persons: with no table broadcast, the lines of the others' orders do not reach the join."""
    who = star.cohort(spark, shop).select("person_id", "index_date").filter("person_id % 8 = 1")
    want, seen, match = rows(star.stack(spark, shop, who)), [], skew.matching
    monkeypatch.setattr(skew, "fits", lambda df, n: False)
    monkeypatch.setattr(star, "fits", lambda df, n: False)
    for module in (skew, star):
        monkeypatch.setattr(module, "matching", lambda big, small, on: seen.append((big, match(big, small, on))) or seen[-1][1])
    assert rows(star.stack(spark, shop, who)) == want != []
    for columns in (["l_orderkey", "person_id", "ordered"], ["l_orderkey", "kind", "day", "l_partkey"]):
        before, after = next((big.count(), kept.count()) for big, kept in seen if big.columns == columns)
        assert 0 < after < before / 4


def test_other_keys_set_two_bits_to_pass(spark, monkeypatch):
    """With a key for every 16 bits, one bit each lets 1 in 17 others pass, two 1 in 70; every key of the table is marked, no row is lost."""
    monkeypatch.setattr(skew, "KEY_CHUNKS", 64)
    big = spark.range(40_000).select(F.when(F.col("id") % 100 != 99, F.col("id")).alias("k"), F.col("id").alias("v"))
    small = big.filter("v % 10 = 1")
    seen = skew.marked(big, small, ["k"], "in_small").groupBy((F.col("v") % 10 == 1).alias("own"), "in_small").count().collect()
    n = {(r["own"], r["in_small"]): r["count"] for r in seen}
    assert sum(n.values()) == 40_000 and n[True, True] == 4_000 and 0 < n[False, True] < 36_000 * 0.03
    assert skew.marked(big, small.select(F.col("k").cast("short")), ["k"], "m").filter("m").count() == 40_000


def test_orders_are_not_shuffled_by_person(spark, monkeypatch, shop):
    """Persons that do not fit leave their orders, and few of others, by a broadcast of bits; the endpoints are those of the persons alone."""
    who = star.materialize(star.cohort(spark, shop).select("person_id", "index_date").filter("person_id % 8 = 1"))
    want, exact = rows(star.stack(spark, shop, who)), star.placed_orders(spark, shop, who)
    monkeypatch.setattr(star, "fits", lambda df, n: False)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = star.placed_orders(spark, shop, who)
        assert _joins(found) == (0, 1) and sorted(found.columns) == sorted(exact.columns)
        assert set(rows(exact)) <= set(rows(found)) and 0 < found.count() < star.placed_orders(spark, shop).count() / 4
        assert rows(star.stack(spark, shop, who)) == want != []
        other = who.withColumn("person_id", F.col("person_id").cast("int"))  # keys of another type have no bits
        assert rows(star.placed_orders(spark, shop, other)) == rows(exact) and rows(star.stack(spark, shop, other)) == want
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_censoring_drops_the_orders_of_others(spark, monkeypatch, shop):
    """Orders of others are not grouped by person when the cohort does not fit."""
    who = star.cohort(spark, shop).select("person_id", "index_date").filter("person_id % 8 = 1")
    given, censor = [], star.censor_date
    monkeypatch.setattr(star, "censor_date", lambda who, sources, *a, **k: given.append(sources[0].events) or censor(who, sources, *a, **k))
    kept = star.activity(spark, shop, who)
    assert rows(star.censoring(spark, shop, who, False, kept)) == rows(star.censoring(spark, shop, who, True, kept)) != []
    large, small = (df.count() for df in given)
    assert 0 < large < small / 4 and small == star.diagnoses(spark, shop).count()


@pytest.mark.parametrize("small", [False, True])
@pytest.mark.parametrize("missing", [False, True])
def test_activity_keeps_what_an_endpoint_reads(spark, monkeypatch, shop, missing, small):
    """Codes of drugs and surgery only, one date a row but where another is asked for; with missing order dates too."""
    if missing:
        table = star.table
        monkeypatch.setattr(star, "table", lambda *a: table(*a) if a[2] != "orders" else table(*a).withColumn(
            "o_orderdate", F.when((F.col("o_orderkey") % 3 > 0) | (F.col("o_orderkey") < 40), F.col("o_orderdate"))))
    monkeypatch.setattr(star, "fits", lambda df, n: small)
    who = star.cohort(spark, shop).select("person_id", "index_date")
    codes = star.codeset(spark, shop).filter("p_partkey % 5 = 2").select("p_partkey", "therapy")
    drugs = {r[0] for r in codes.collect()}
    kept, lines = star.activity(spark, shop, who, codes), star.lines(spark, shop, who)
    assert kept.count() == lines.filter("l_returnflag in ('R', 'A')").count() > 0
    seen = kept.collect()
    assert {r["l_partkey"] for r in seen if r["l_returnflag"] == "R"} == drugs | {None}
    assert all((r["start_date"] is None) or (r["order_date"] is None) for r in seen)
    extra = [r for r in seen if r["admit_date"] is not None and r["px_date"] is not None]
    assert extra and {r["l_partkey"] for r in extra} <= {7, 12, 17}
    for part in (lambda given: star.first_prescriptions(spark, shop, who, codes=codes, rows=given),
                 lambda given: star.surgery(spark, shop, who, rows=given),
                 lambda given: censor_date(who, [ActivitySource(star.diagnoses(spark, shop), "admit_date", "dx_date"),
                                                 ActivitySource(star.procedures(spark, shop, given), "admit_date", "px_date"),
                                                 ActivitySource(star.prescribing(spark, shop, given), "start_date", "order_date")], ["person_id"], "index_date")):
        assert rows(part(kept)) == rows(part(lines)) != []


def test_slim_cohort_has_the_same_persons_and_dates(spark, shop):
    columns = ["person_id", "index_date", "birth_date", "age", "age_days"]
    slim = star.cohort(spark, shop, True)
    assert rows(slim.select(columns)) == rows(star.cohort(spark, shop).select(columns)) != []
    assert set(slim.columns) == set(columns)


@pytest.mark.parametrize("small", [True, False])
def test_censoring_by_brute_force(spark, small):
    """Dates before and after the index, missing ones, repeated cohort rows, and a frame with two sources."""
    rng = np.random.default_rng(5)
    day = lambda: None if rng.random() < 0.3 else int(rng.integers(0, 40))
    events = [[(int(rng.integers(0, 25)) if rng.random() < 0.95 else None, *(day() for _ in range(4))) for _ in range(60)] for _ in range(2)]
    cohort = [(p, d) for p in range(25) for d in ((15, 25) if p % 5 == 0 else (20, 20) if p % 5 == 1 else (20,))] + [(None, 3)]
    as_date = lambda c: F.date_add(F.lit("2000-01-01").cast("date"), F.col(c)).alias(c)
    a, b = (spark.createDataFrame(e, "p int, w int, x int, y int, z int").select("p", *map(as_date, "wxyz")) for e in events)
    who = spark.createDataFrame(cohort, "p int, at int").select("p", as_date("at"))
    out = censor_date(who, [ActivitySource(a, "w", "x"), ActivitySource(b, "w", "x"), ActivitySource(b, "y", "z")], ["p"], "at", small=small)
    want = set()
    for p, at in cohort:
        ends = []
        for e, i in ((events[0], 1), (events[1], 1), (events[1], 3)):
            counted = [(r[i], r[i + 1]) for r in e if p is not None and r[0] == p and (r[i] if r[i] is not None else r[i + 1] or -1) >= at]
            first, other = [u for u, _ in counted if u is not None], [v for _, v in counted if v is not None]
            ends += [max(first or other)] if first or other else []
        if ends:
            want.add((p, at, max(ends)))
    number = lambda c: F.date_diff(c, F.lit("2000-01-01").cast("date"))
    got = [tuple(r) for r in out.select("p", number("at"), number("censor_date")).collect()]
    assert set(got) == want and len(got) == len(want) > 10


def test_sources_of_one_frame_are_read_together(spark):
    events = spark.range(9).select(F.col("id").alias("p"), *[F.current_date().alias(c) for c in "wxyz"])
    out = censor_date(events.select("p", F.col("w").alias("at")), [ActivitySource(events, "w", "x"), ActivitySource(events, "y", "z")], ["p"], "at", small=True)
    assert out._jdf.queryExecution().optimizedPlan().toString().count("Range (") == 2  # the cohort and the events


def test_first_row_carries_a_column_once(spark):
    """Columns that order and are kept stand once in the shuffled minimum; missing values come last, repeats give one row."""
    data = [(1, None, "b", 1.0), (1, 3, None, 2.0), (1, 3, "c", 3.0), (2, None, None, None), (2, None, None, 5.0), (None, 1, "x", 1.0), (None, 1, "x", 1.0)]
    df = spark.createDataFrame(data, "k int, t int, s string, v double")
    out = earliest(df, ["k"], ["t", "s"], ["t", "s", "v"])
    assert {tuple(r)[:3] for r in out.collect()} == {(1, 3, "c"), (2, None, None), (None, 1, "x")}
    assert rows(out.filter("k = 1")) == rows(df.filter("v = 3"))
    least = next(line for line in out._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Aggregate" in line)
    assert all(least.count(f"{c}#") <= 3 for c in "ts")


def test_first_event_of_repeated_persons(spark):
    events = spark.createDataFrame([(1, 5, 1), (1, 4, 2), (1, 4, 2)], "p int, t int, e int")
    people = spark.createDataFrame([(1, "y", 2.0), (1, "x", 3.0), (1, None, 1.0)], "p int, s string, b double")
    for small in (True, False):
        out = index_event(events, people, ["p"], "t", F.lit(True), ["e"], ["e"], ["s", "b"], small=small)
        assert [tuple(r) for r in out.select("p", "t", "e", "s", "b").collect()] == [(1, 4, 2, "x", 3.0)]
