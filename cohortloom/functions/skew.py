"""Joins that stay balanced when one key holds a large share of the rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

BROADCAST_ROWS = 1_000_000
BROADCAST_BYTES = 64 << 20
HOT_ROWS = 2_000_000
HOT_BUCKETS = 4096
KEY_CHUNKS = 1 << 17
KEY_WORDS = 16
#: Types whose equal values have equal hashes.
KEY_TYPES = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.DateType)


def fits(df: DataFrame, max_rows: int) -> bool:
    """Whether ``df`` may be broadcast: at most BROADCAST_BYTES and ``max_rows`` rows (0 says no), as measured.

    A read says so, not the optimizer's guess, which file compression and joins lead far astray. It ends as soon as one row
    more than may fit has been seen, and adds up the bytes of the columns without a fixed width.
    """
    if max_rows <= 0:
        return False
    fixed = 16 + 8 * len(df.columns)
    limit = min(max_rows, BROADCAST_BYTES // fixed)
    wide = [f.name for f in df.schema.fields if not isinstance(f.dataType, (T.NumericType, T.DatetimeType, T.BooleanType))]
    size = F.lit(0).cast("long")
    for c in wide:
        plain = isinstance(df.schema[c].dataType, (T.StringType, T.BinaryType))
        column = F.col(f"`{c}`")
        size = size + F.coalesce(F.octet_length(column if plain else F.to_json(F.struct(column))), F.lit(0))
    found = df.select(size.alias("size")).limit(limit + 1).agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("size"), F.lit(0)).alias("size")).first()
    return found["n"] <= limit and found["n"] * fixed + found["size"] <= BROADCAST_BYTES


def _hot_keys(big: DataFrame, on: Sequence[str], hot_rows: int) -> DataFrame | None:
    """Keys above ``hot_rows`` rows with their number of salts, or None where there is none.

    Rows are counted by a hash of the key first, so that a read without a shuffle of the keys rules out nearly all of them;
    only the keys of a hash with more rows than that are counted one by one.
    """
    bucket = F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in on]), F.lit(HOT_BUCKETS))
    counts = big.groupBy(bucket.alias("_bucket")).agg(F.count(F.lit(1)).alias("_rows"))
    full = [r["_bucket"] for r in counts.filter(F.col("_rows") > hot_rows).collect()]
    if not full:
        return None
    rows = big.filter(bucket.isin(*full)).groupBy(*on).agg(F.count(F.lit(1)).alias("_rows"))
    return rows.filter(F.col("_rows") > hot_rows).select(*on, F.ceil(F.col("_rows") / hot_rows).cast("int").alias("_salts"))


def marked(big: DataFrame, small: DataFrame, on: Sequence[str], flag: str) -> DataFrame:
    """``big`` with a column that is true for every row whose key is among those of ``small``, and for few others.

    The keys set two bits each by their hash. The bits, 16 MB whatever the number of keys, are broadcast in chunks of words. Of the
    rows with other keys one in 300 is true by four million keys, one in 12 by 22 million; all rows with keys of other types
    than whole numbers and dates, or of two types, are.
    """
    on = list(on)
    if not _comparable(big, small, on):
        return big.withColumn(flag, F.lit(True))
    key = F.xxhash64(*[F.col(f"`{c}`") for c in on])
    chunk = F.pmod(key, F.lit(KEY_CHUNKS)).cast("int")
    places = [(F.pmod(F.shiftright(key, w), F.lit(KEY_WORDS)).cast("int"), F.pmod(F.shiftright(key, b), F.lit(64)).cast("int")) for w, b in ((20, 30), (40, 50))]
    zero, one = F.lit(0).cast("long"), F.lit(1).cast("long")
    keys = small.select(chunk.alias("_chunk"), *[c for i, (word, bit) in enumerate(places) for c in (
        word.alias(f"_word{i}"), F.call_function("shiftleft", one, bit).alias(f"_bit{i}"))])

    def of_word(k: int) -> Column:
        first, second = (F.when(F.col(f"_word{i}") == k, F.col(f"_bit{i}")).otherwise(zero) for i in range(2))
        return F.bit_or(first.bitwiseOR(second))

    seen = keys.groupBy("_chunk").agg(F.array(*[of_word(k) for k in range(KEY_WORDS)]).alias("_words"))
    found = big.withColumn("_chunk", chunk).join(F.broadcast(seen), "_chunk", "left")
    first, second = (F.getbit(F.element_at("_words", word + 1), bit) == 1 for word, bit in places)
    return found.select(*[F.col(f"`{c}`") for c in big.columns], (first & second).alias(flag))


def _comparable(big: DataFrame, small: DataFrame, on: Sequence[str]) -> bool:
    return all(big.schema[c].dataType == small.schema[c].dataType and isinstance(big.schema[c].dataType, KEY_TYPES) for c in on)


def matching(big: DataFrame, small: DataFrame, on: Sequence[str]) -> DataFrame:
    """Rows of ``big`` whose key may be among those of ``small``, as ``marked`` tells: all that are, and few others.

    The rows of other keys are gone before a shuffle join; that join still has the last word. It must not be a semi join, which
    the optimizer would take below this filter.
    """
    return marked(big, small, on, "_may_match").filter("_may_match").drop("_may_match") if _comparable(big, small, on) else big


def skew_join(big: DataFrame, small: DataFrame, on: Sequence[str], how: str = "inner",
              hot_rows: int = HOT_ROWS, selective: bool = False) -> DataFrame:
    """Shuffle join in which every key above ``hot_rows`` rows is spread over several tasks.

    A hot key gets ``ceil(count / hot_rows)`` salts, its partner rows are copied to each salt,
    and all other keys keep salt 0. The salt is a hash of the row and its input partition: stable
    when a task is retried, spread even among equal rows. Rows with a missing key match nothing:
    they go round the join. Hot keys are as few as there are multiples of ``hot_rows`` among the rows, so their table is
    broadcast and each side is shuffled once; without any the join is a plain one and keeps the partitioning by ``on``.
    ``selective`` says that many rows of ``big`` have no partner: an inner join drops nearly all of them before the shuffle.
    """
    if how not in ("inner", "left"):
        raise ValueError(f"unsupported join type {how!r}")
    on = list(on)
    missing = F.lit(False)
    for c in on:
        missing = missing | F.col(f"`{c}`").isNull()
    apart, big = big.filter(missing), big.filter(~missing)
    hot = _hot_keys(big, on, hot_rows)
    if selective and how == "inner":
        big = matching(big, small, on)
    if hot is None:
        joined = big.join(small, on, how)
    else:
        hot = F.broadcast(hot)
        spread = F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in big.columns], F.spark_partition_id()),
                        F.coalesce("_salts", F.lit(1)))
        left = (big.join(hot, on, "left")
                .withColumn("_salt", spread.cast("int")).drop("_salts"))
        copies = F.explode(F.sequence(F.lit(0), F.coalesce("_salts", F.lit(1)) - 1))
        right = (small.join(hot, on, "left")
                 .withColumn("_salt", copies).drop("_salts"))
        joined = left.join(right, [*on, "_salt"], how).drop("_salt")
    return joined if how == "inner" else joined.unionByName(apart, allowMissingColumns=True)


def lookup_join(big: DataFrame, small: DataFrame, on: Sequence[str], how: str = "inner",
                max_rows: int = BROADCAST_ROWS, hot_rows: int = HOT_ROWS, selective: bool = True) -> DataFrame:
    """Broadcast ``small`` where ``fits`` has measured it, otherwise fall back to ``skew_join``.

    A lookup is expected to drop rows; where ``small`` has nearly every key, ``selective=False`` saves the pass over its keys.
    """
    on = list(on)
    if fits(small, max_rows):
        return big.join(F.broadcast(small), on, how)
    return skew_join(big, small, on, how, hot_rows, selective)


def attach_index(events: DataFrame, cohort: DataFrame, keys: Sequence[str],
                 distinct: bool = False, small: bool | None = None,
                 max_rows: int = BROADCAST_ROWS, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Inner-join event rows to their cohort row.

    A cohort that fits is broadcast and the events are never shuffled; ``small`` passes on the
    answer of an earlier ``fits``. For a larger cohort, callers whose result does not depend on
    repeats pass ``distinct=True``: equal event rows collapse map-side first, which also
    flattens a hot person to its distinct dates.
    """
    keys = list(keys)
    if fits(cohort, max_rows) if small is None else small:
        return events.join(F.broadcast(cohort), keys)
    if distinct:
        return events.distinct().join(cohort, keys)
    return skew_join(events, cohort, keys, hot_rows=hot_rows)
