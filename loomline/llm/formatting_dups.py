"""Collapse records that differ only in form (problem 1).

Method: Merkle-style bottom-up hashing. A text is either a *record* (a list of
named fields in some notation, JSON included) or plain text. Leaves are
normalised (letter case and everything that is neither letter nor digit
dropped), the digests of the children of an unordered node are sorted, and the
digest of the root names the group. Groups are then confirmed structurally: all
canonical forms under one digest are compared in full, and a digest that holds
several is divided by them.

Plain texts never leave the JVM: only texts that can be a record (they hold a
colon or an equals sign) go through an Arrow batch to the parser.

Defined results: a null text belongs to no group; texts without any letter or
digit are each other's copies; a row delivered again (same source, id and
text) counts once; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import json
import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomline.session import cut_lineage

_NOT_ALNUM = re.compile(r"[\W_]+")
#: Separators between fields, tried in this order; the first under which every piece is `name: value` or `name = value` wins.
_SEPARATORS = (re.compile(r";"), re.compile(r"\|"), re.compile(r"\n"), re.compile(r"&"), re.compile(r"\t"), re.compile(r","))
#: A field: a name of any length, a mark, a value.
_FIELD = re.compile(r"^\W*([^\W_][^:=;|\n{}\[\]]*)(?::=|=>|[:=])\s*(.*?)\s*$", re.S)


def fold(text: str) -> str:
    """Letters and digits of `text` without case."""
    return _NOT_ALNUM.sub("", text.upper().lower())


def _digest(kind: str, parts: list[str]) -> str:
    h = hashlib.blake2b(digest_size=16)
    h.update(kind.encode())
    for p in parts:
        h.update(b"\x1f")
        h.update(p.encode("utf-8", "surrogatepass"))
    return h.hexdigest()


def merkle(node) -> tuple[str, str]:
    """Digest and canonical form of a nested value, leaves first.

    Objects are unordered (child digests are sorted), arrays keep their order.
    """
    if isinstance(node, dict):
        kids = []
        for k, v in node.items():
            d, c = merkle(v)
            name = fold(str(k))
            kids.append((_digest("field", [name, d]), f"{name}={c}"))
        kids.sort()
        return _digest("object", [d for d, _ in kids]), "{" + ";".join(c for _, c in kids) + "}"
    if isinstance(node, list):
        kids = [merkle(v) for v in node]
        return _digest("array", [d for d, _ in kids]), "[" + ",".join(c for _, c in kids) + "]"
    if isinstance(node, bool) or node is None:
        leaf = "" if node is None else str(node).lower()
    else:
        leaf = fold(str(node))
    return _digest("leaf", [leaf]), leaf


def _pairs(pairs: list[tuple[str, object]]) -> dict:
    """Object of JSON pairs; a name given twice keeps all its values."""
    out: dict = {}
    for k, v in pairs:
        name = k
        while name in out and fold(str(out[name])) != fold(str(v)):
            name += " again"
        out[name] = v
    return out


def parse_record(text: str) -> dict | list | None:
    """The named fields of `text`, or None where it is no list of at least two fields."""
    s = text.replace("​", "").strip()
    bare = s.strip("`*_ \t\r\n\"'«»“”…-–—.")
    for t in (s, bare):
        if t[:1] in "{[" and t[-1:] in "}]":
            try:
                v = json.loads(t, object_pairs_hook=_pairs)
            except (ValueError, RecursionError):
                continue
            if isinstance(v, (dict, list)):
                return v
    for sep in _SEPARATORS:
        pieces = [p for p in sep.split(s) if fold(p)]
        if len(pieces) < 2:
            continue
        out: list[tuple[str, object]] = []
        for p in pieces:
            m = _FIELD.match(p)
            if not m:
                break
            out.append((fold(m[1]), m[2]))
        else:
            return _pairs(out)
    return None


_RECORD = T.StructType([T.StructField("digest", T.StringType()), T.StructField("canon", T.StringType())])


@F.pandas_udf(_RECORD)
def _record_udf(texts: pd.Series) -> pd.DataFrame:
    digest, canon = [], []
    for t in texts:
        node = parse_record(t) if t is not None else None
        d, c = merkle(node) if node is not None else (None, None)
        digest.append(d)
        canon.append(c)
    return pd.DataFrame({"digest": digest, "canon": canon})


def fold_column(c: Column) -> Column:
    """JVM counterpart of `fold`."""
    return F.regexp_replace(F.lower(F.upper(c)), r"[^\p{L}\p{N}]+", "")


def keyed(df: DataFrame, source: Column, row_id: str, text: str, *carry: str) -> DataFrame:
    """(src, rid, plain, root, canon, carry...) of every row with a text.

    `plain` is the digest of the folded text, `root` the Merkle root: that of
    the record, or `plain` itself for plain text (16 bytes each). `canon` is the canonical
    form itself: that of the record, or the folded text of plain text.
    """
    t = F.col(text)
    base = df.select(source.alias("src"), F.col(row_id).alias("rid"), t.alias("_t"), *[F.col(c).alias(f"_c_{c}") for c in carry]).where(F.col("_t").isNotNull() & F.col("rid").isNotNull())
    base = base.withColumn("_r", _record_udf(F.when(F.col("_t").rlike("[:=]"), F.col("_t"))))
    folded = fold_column(F.col("_t"))
    plain = F.substring(F.sha2(folded, 256), 1, 32)
    return base.select("src", "rid", F.unhex(plain).alias("plain"), F.unhex(F.coalesce(F.col("_r.digest"), plain)).alias("root"), F.coalesce(F.col("_r.canon"), folded).alias("canon"), *[F.col(f"_c_{c}").alias(c) for c in carry])


def divided(keys: DataFrame) -> DataFrame:
    """`keys` without `canon`, confirmed: where texts of different structure share a root, each structure gets a root of its own.

    Equal forms are combined before the shuffle, so each is compared once a task, however many rows have it.
    """
    forms = keys.groupBy("src", "root", "canon").agg(F.lit(1).alias("one")).groupBy("src", "root").agg(F.count("*").alias("n"))
    clash = cut_lineage(forms.where("n > 1").select("src", "root"))
    if clash.isEmpty():
        return keys.drop("canon")
    own = F.when(F.col("_clash"), F.concat("root", F.unhex(F.sha2("canon", 256)))).otherwise(F.col("root"))
    return keys.join(clash.withColumn("_clash", F.lit(True)), ["src", "root"], "left").withColumn("root", own).drop("canon", "_clash")


def _components(edges: DataFrame) -> DataFrame:
    """(src, node, label) of the nodes of undirected edges (src, a, b): the smallest node each can reach.

    Alternating star contraction: the neighbours of a node are hung on the smallest of them, first the larger ones, then
    the smaller ones, until nothing changes; a chain of n edges takes some log n rounds.
    """

    def star(e: DataFrame, large: bool) -> DataFrame:
        both = e.unionByName(e.select("src", F.col("b").alias("a"), F.col("a").alias("b"))) if large else e.select("src", F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        low = both.groupBy("src", "a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        hung = both.join(low, ["src", "a"])
        moved = hung.where("b > a").select("src", F.col("b").alias("a"), F.col("m").alias("b")) if large else hung.select("src", F.col("b").alias("a"), F.col("m").alias("b")).unionByName(low.select("src", "a", F.col("m").alias("b")))
        return moved.where("a <> b").distinct()

    e = cut_lineage(edges.where("a <> b").distinct())
    while True:
        after = cut_lineage(star(star(e, True), False))
        if after.exceptAll(e).isEmpty() and e.count() == after.count():
            return after.groupBy("src", F.col("a").alias("node")).agg(F.min("b").alias("label"))
        e = after


def grouped(keys: DataFrame) -> DataFrame:
    """`keys` with the column `grp`, the name of the group in its source, in place of `root` and `canon`.

    Two things tie texts together: equal roots (confirmed by `divided`), and equal folded texts
    (a record and the same words without its punctuation). Only folded texts of records can
    have several roots; where they have, the roots are joined into components.
    """
    keys = divided(cut_lineage(keys))
    several = keys.where("root <> plain").select("src", "plain", "root").distinct()
    beside = keys.where("root = plain").select("src", "plain", "root").join(several.select("src", "plain").distinct(), ["src", "plain"], "left_semi").distinct()
    spread = several.unionByName(beside)
    ties = spread.join(spread.groupBy("src", "plain").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo <> hi").select("src", "plain", "lo"), ["src", "plain"])
    edges = cut_lineage(ties.where("root <> lo").select("src", F.col("root").alias("a"), F.col("lo").alias("b")))
    if edges.isEmpty():
        return keys.drop("plain").withColumnRenamed("root", "grp")
    names = cut_lineage(_components(edges)).withColumnRenamed("node", "root")
    return keys.drop("plain").join(names, ["src", "root"], "left").withColumn("grp", F.coalesce("label", "root")).drop("label", "root")


def copies(groups: DataFrame) -> DataFrame:
    """(src, first_id, copy_id): every other id of a group against its smallest.

    Minima are combined before the shuffle; the join back is a sort-merge join
    whose hot groups adaptive execution splits (one side is one row a group).
    """
    first = groups.groupBy("src", "grp").agg(F.min("rid").alias("first_id"), F.max("rid").alias("last_id")).where("first_id <> last_id")
    return (
        groups.select("src", "grp", "rid").join(first, ["src", "grp"]).where("rid <> first_id")
        .groupBy("src", "grp", "rid").agg(F.first("first_id").alias("first_id"))
        .select(F.col("src").alias("src_table"), "first_id", F.col("rid").alias("copy_id"))
    )


def collapse(groups: DataFrame) -> DataFrame:
    """One row a finding: its smallest id, number of rows, and sum of the column `n` (occurrences of a row)."""
    once = groups.groupBy("src", "grp", "rid").agg(F.max("n").alias("n"))
    return (
        once.groupBy("src", "grp").agg(F.min("rid").alias("first_id"), F.count("*").alias("n_rows"), F.sum("n").cast("long").alias("occurrences"))
        .select(F.col("src").alias("src_table"), "first_id", "n_rows", "occurrences")
    )


def finding_keys(cie_records: DataFrame, records: DataFrame) -> DataFrame:
    """Keys of both finding tables; a register row without a count stands for one occurrence, a record for one."""
    a = cie_records.select("record_id", "statement", F.coalesce(F.col("occurrence_count").cast("long"), F.lit(1).cast("long")).alias("n"))
    b = records.select("record_id", F.col("summary").alias("statement"), F.lit(1).cast("long").alias("n"))
    both = a.withColumn("_s", F.lit("cie_records")).unionByName(b.withColumn("_s", F.lit("records")))
    return keyed(both, F.col("_s"), "record_id", "statement", "n")
