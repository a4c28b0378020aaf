"""Records that are the same but for typing (problem 5): commutative multiset hashing of normalised values.

Each value is normalised on the JVM side and hashed together with the normalised name of its field; the hashes of a record are
added, so that the order of the fields does not matter and nothing is sorted. Fields that may hold each other's values, such
as those of records typed into the wrong column, get one normalised name, by an explicit rule; any other field keeps its
own. Two sums of 60-bit hashes, 120 bits, are the fingerprint. The fingerprints are written once. One
aggregation with map-side combining finds the smallest record of each fingerprint, however many copies it has.
Records meet it again by a join: fingerprints that hold more than a thousandth of all rows, of which there are at most
a thousand, are broadcast, so that no task gets a hot set of copies. The values are then compared field by field
in every order that the names allow; records that differ (a collision) are grouped anew by their values themselves.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmill.functions import clean
from quillmill.plans import split_hot, written


def normal_value(c: Column) -> Column:
    """Letters and digits in order, letter case aside; all missing values, null too, are the empty string."""
    return F.when(clean.is_missing(c), F.lit("")).otherwise(clean.letters_and_digits(clean.without_resolver(c)))


def _part(name: str, value: Column, salt: int) -> Column:
    """A 60-bit hash of a pair of name and value, so that up to eight of them add up within a long."""
    return F.shiftrightunsigned(F.xxhash64(F.lit(salt), F.lit(name), value), 4)


def _sum(cols: list[Column]) -> Column:
    total = cols[0]
    for c in cols[1:]:
        total = total + c
    return total


def normal_names(fields: list[str], alike: tuple[tuple[str, ...], ...] = ()) -> list[str]:
    """The normalised name of each field: small letters and digits, or that of the first of the fields it is ``alike``."""
    plain = lambda f: "".join(c for c in f.casefold() if c.isalnum())
    first = {plain(f): plain(group[0]) for group in alike for f in group}
    return [first.get(plain(f), plain(f)) for f in fields]


def fingerprints(df: DataFrame, key: str, fields: list[str], names: list[str]) -> DataFrame:
    """(``_id``, ``_v0`` ..., ``_f1``, ``_f2``) of the rows of ``df`` whose key is not null."""
    if not 1 <= len(fields) <= 8:
        raise ValueError("between one and eight fields")
    values = df.where(F.col(key).isNotNull()).select(F.col(key).alias("_id"), *(normal_value(F.col(f"`{f}`")).alias(f"_v{k}") for k, f in enumerate(fields)))
    return values.select("*", *(_sum([_part(n, F.col(f"_v{k}"), salt) for k, n in enumerate(names)]).alias(f"_f{salt}") for salt in (1, 2)))


def _same(names: list[str]) -> Column:
    """The values of a record and those of its fingerprint's first, in some order of the fields of one name."""
    same = F.lit(False)
    for order in permutations(range(len(names))):
        if [names[j] for j in order] == names:
            one = F.lit(True)
            for k, j in enumerate(order):
                one = one & (F.col(f"_v{k}") == F.col(f"_first._v{j}"))
            same = same | one
    return same


def _linked(rows: DataFrame, keys: list[str], n: int, total: int) -> DataFrame:
    """Each row with ``_first``, the smallest row of its keys, where the keys hold two rows or more."""
    values = [f"_v{k}" for k in range(n)]
    groups = rows.groupBy(*keys).agg(F.count("*").alias("_n"), F.min(F.struct("_id", *values)).alias("_first")).where("_n > 1")
    hot = F.broadcast(groups.where(split_hot(groups, "_n", total)).select(*keys, F.col("_first").alias("_hot")))
    cold = groups.where(~split_hot(groups, "_n", total)).select(*keys, "_first")
    probed = rows.join(hot, keys, "left")
    return probed.where("_hot is not null").withColumnRenamed("_hot", "_first").unionByName(probed.where("_hot is null").drop("_hot").join(cold, keys))


def copies(df: DataFrame, key: str, fields: list[str], alike: tuple[tuple[str, ...], ...] = ()) -> DataFrame:
    """(first_id, copy_id): the smallest key of each set of copies with each of the others.

    ``alike``: groups of at most four fields that may hold each other's values. Defined results: rows with a null key are left out, as
    they cannot be named; a missing value of any kind equals every other missing value, so records without any value are copies of
    each other; rows repeated with their key count once; other columns of ``df``, whatever their names, are not read.
    """
    names = normal_names(fields, alike)
    if max(names.count(n) for n in names) > 4:
        raise ValueError("at most four fields may hold each other's values")
    rows = written(fingerprints(df, key, fields, names), "fingerprints")
    linked = _linked(rows, ["_f1", "_f2"], len(fields), rows.count())
    same = _same(names)
    found = linked.where(same).select(F.col("_first._id").alias("first_id"), F.col("_id").alias("copy_id"))
    exact = F.array_sort(F.array(*(F.struct(F.lit(n).alias("n"), F.col(f"_v{k}").alias("v")) for k, n in enumerate(names))))
    collided = linked.where(~same).drop("_first").withColumn("_exact", exact)
    again = collided.groupBy("_exact").agg(F.min("_id").alias("first_id")).join(collided.select("_exact", F.col("_id").alias("copy_id")), "_exact")
    return found.unionByName(again.select("first_id", "copy_id")).where("first_id <> copy_id").distinct()


def collapsed(df: DataFrame, key: str, fields: list[str], alike: tuple[tuple[str, ...], ...] = ()) -> DataFrame:
    """(first_id, n_copies): one row for each distinct record and how many records it stands for, itself included."""
    more = copies(df, key, fields, alike)
    single = df.where(F.col(key).isNotNull()).select(F.col(key).alias("copy_id")).distinct().join(more, "copy_id", "left")
    return single.groupBy(F.coalesce("first_id", "copy_id").alias("first_id")).agg(F.count("*").alias("n_copies"))
