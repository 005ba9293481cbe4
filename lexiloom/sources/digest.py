"""Digests of tables that do not depend on the order or the place of rows.

A row's fingerprint is the SHA-256 of its values in order of the column names,
each with its length, so that no two rows run together.  Rows fall into leaves by
the first hexadecimal digits of their fingerprint; a leaf's digest is that of its
row count and of the sums of the fingerprints' eight 32-bit parts, an order-free
hash of a multiset.  Leaves are hashed in sixteens up to one root: equal tables
have equal roots, and where roots differ the tree says in which leaves.

Tasks add up their rows before the shuffle, so one pass and ``16 ** digits`` small
rows a task make the tree, whatever the size of the table.

Defined cases: null and empty differ; column names count, their order does not;
rows that repeat count each time; an empty table has a root of its own; numbers
are compared by their text, arrays and structs by their JSON, maps by their
sorted entries, binary by its digits.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import durable

#: Hexadecimal digits that leaves are told apart by.
DIGITS = 3
_LANES = range(8)


def _text(name: str, kind: T.DataType) -> Column:
    value = F.col(f"`{name}`")
    if isinstance(kind, T.MapType):
        return F.to_json(F.array_sort(F.map_entries(value)), {"ignoreNullFields": "false"})
    if isinstance(kind, (T.ArrayType, T.StructType, T.VariantType)):
        return F.to_json(value, {"ignoreNullFields": "false"})
    return F.hex(value) if isinstance(kind, T.BinaryType) else value.cast("string")


def fingerprint(df: DataFrame) -> Column:
    """Hex SHA-256 of a row of ``df``: ``name`` and ``s<bytes>:<text>`` or ``n`` of each column, in order of their names."""
    parts = []
    for name in sorted(df.columns):
        text = _text(name, df.schema[name].dataType)
        parts += [F.lit(f"{len(name.encode())}:{name}="), F.when(text.isNull(), F.lit("n")).otherwise(F.concat(F.lit("s"), F.octet_length(text).cast("string"), F.lit(":"), text))]
    return F.sha2(F.concat(F.lit(""), *parts), 256)


def _leaves(df: DataFrame, digits: int) -> DataFrame:
    lanes = [F.sum(F.conv(F.substring("f", 1 + 8 * k, 8), 16, 10).cast("long")).alias(f"s{k}") for k in _LANES]
    summed = df.select(fingerprint(df).alias("f")).groupBy(F.substring("f", 1, digits).alias("prefix")).agg(F.count("*").alias("rows"), *lanes)
    return summed.select("prefix", "rows", F.sha2(F.concat_ws(":", "rows", *[f"s{k}" for k in _LANES]), 256).alias("digest"))


def tree(df: DataFrame, digits: int = DIGITS) -> DataFrame:
    """``prefix, rows, digest`` of every node that holds rows, the root's prefix being empty."""
    if not 1 <= digits <= 5:
        raise ValueError("leaves have one to five digits")
    level, _ = durable(_leaves(df, digits), "leaves")
    nodes = level
    for k in range(digits - 1, -1, -1):
        children = F.transform(F.sort_array(F.collect_list(F.struct("prefix", "digest"))), lambda c: F.concat_ws("=", c["prefix"], c["digest"]))  # at most sixteen
        level = level.groupBy(F.substring("prefix", 1, k).alias("prefix")).agg(F.sum("rows").alias("rows"), F.sha2(F.array_join(children, ";"), 256).alias("digest"))
        nodes = nodes.unionByName(level)
    return nodes


def table_digest(df: DataFrame, digits: int = DIGITS) -> dict:
    """``rows`` and ``sha256`` of a table's root; the columns' names and types are hashed into it."""
    root = tree(df, digits).where("prefix = ''").first()
    shape = ";".join(f"{n} {df.schema[n].dataType.simpleString()}" for n in sorted(df.columns))
    rows, digest = (root["rows"], root["digest"]) if root else (0, "")
    return {"rows": rows, "sha256": df.sparkSession.range(1).select(F.sha2(F.lit(f"{shape}|{rows}|{digest}"), 256)).first()[0]}


def differing_leaves(first: DataFrame, second: DataFrame, digits: int = DIGITS) -> DataFrame:
    """``prefix`` of the leaves in which two tables differ."""
    one, other = (tree(df, digits).where(F.length("prefix") == digits).select("prefix", F.col("digest").alias(name)) for df, name in ((first, "one"), (second, "other")))
    return one.join(other, "prefix", "full").where(~F.col("one").eqNullSafe(F.col("other"))).select("prefix")


def differing_rows(first: DataFrame, second: DataFrame, digits: int = DIGITS) -> DataFrame:
    """``in_first, in_second, row`` (JSON) of the rows that two tables do not hold equally often; only leaves that differ are compared row by row."""
    leaves, _ = durable(differing_leaves(first, second, digits), "differing")

    def side(df: DataFrame, name: str) -> DataFrame:
        rows = df.select(fingerprint(df).alias("f"), F.to_json(F.struct(*[f"`{c}`" for c in sorted(df.columns)]), {"ignoreNullFields": "false"}).alias("row"))
        inside = rows.join(F.broadcast(leaves), F.substring("f", 1, digits) == F.col("prefix"), "left_semi")  # at most 16 ** digits leaves
        return inside.groupBy("f").agg(F.count("*").alias(name), F.min("row").alias(f"row_{name}"))

    met = side(first, "in_first").join(side(second, "in_second"), "f", "full").na.fill(0, ["in_first", "in_second"])
    return met.where("in_first <> in_second").select("in_first", "in_second", F.coalesce("row_in_first", "row_in_second").alias("row"))
