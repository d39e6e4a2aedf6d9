"""Splits that keep related records together.

Files are related when they are paired with the same annotation file, directly or through further
files. Components come from hash-to-min in row form: every node keeps rows (node, member); each
round sends the node's members to its smallest member and that smallest member to all of them,
until nothing changes. Rounds cut their lineage with written tables in the shared folder. Before
the first round each annotation file is contracted to a star around its smallest file (a minimum
with map-side combining), so a hot annotation file costs as many rows as it has pairs, never their
square. Components are then assigned by weighted rendezvous hashing.

Defined results: null, empty and blank paths, and paths that end in a separator, join nothing.
Repeated pairs change nothing. A record's file is read like a path. A file in no pair is its own component, and a record with a null
file is a component of its own record id. Empty tables give empty results.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidegrid.store import broadcast_if_small, drop, write_table

#: Splits a target table may name; it is read to the driver as one literal.
MAX_SPLITS = 1000


def file_of_path(path: Column) -> Column:
    """Last component of a path, in lower case and without blanks around it; null if empty."""
    last = F.regexp_extract(path, r"([^/\\]*)$", 1)
    name = F.lower(F.regexp_replace(last, r"^[\s ]+|[\s ]+$", ""))
    return F.when(name != "", name)


def hash_to_min(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Connected components of undirected ``edges``: (node, component), the smallest node's name.

    Self-edges are allowed and make lone nodes known. Null ends are ignored.
    """
    spark = edges.sparkSession
    own = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).dropna()
    members = own.union(own.select("v", "u")).union(own.select("u", F.col("u").alias("v"))).union(own.select("v", F.col("v").alias("u"))).distinct()
    current, path = write_table(members.toDF("node", "member"), "components")
    size = None
    while True:
        least = current.groupBy("node").agg(F.min("member").alias("least"))
        with_least = current.join(least, "node")
        # the smallest member learns of all members, every member learns of the smallest
        sent = with_least.select(F.col("least").alias("node"), "member").union(with_least.select(F.col("member").alias("node"), F.col("least").alias("member")))
        following, new_path = write_table(sent.distinct(), "components")
        # stable when the rows are the same set: order-free digest and count
        digest = following.agg(F.count("*"), F.sum(F.xxhash64("node", "member").cast("decimal(38,0)"))).first()
        drop(spark, path)
        current, path = following, new_path
        if digest == size:
            return current.groupBy("node").agg(F.min("member").alias("component"))
        size = digest


def related_files(pairs: DataFrame) -> DataFrame:
    """Groups of audio files related by their annotation files: (file, group_file) of every named file."""
    named = pairs.select(file_of_path(F.col("audio_path")).alias("file"), file_of_path(F.col("annot_path")).alias("annot"))
    files = named.select("file").dropna().distinct()
    links = named.dropna().distinct()
    centre = links.groupBy("annot").agg(F.min("file").alias("centre"))
    stars = links.join(centre, "annot").select(F.col("file").alias("a"), F.col("centre").alias("b")).distinct()
    components = hash_to_min(stars)
    return files.join(components, files["file"] == components["node"], "left").select("file", F.coalesce("component", "file").alias("group_file"))


def groups_of_two(groups: DataFrame) -> DataFrame:
    """Rows of ``related_files`` whose group has two or more files."""
    large = groups.groupBy("group_file").count().filter("count >= 2").select("group_file")
    return groups.join(large, "group_file", "left_semi").select("file", "group_file")


def rendezvous(key: Column, weights: list[tuple[str, float]]) -> Column:
    """Split with the greatest weighted hash score ``-weight / ln(u)``; ties go to the first name."""
    scores = []
    for name, weight in sorted(weights):
        u = (F.pmod(F.xxhash64(key, F.lit(name)), F.lit(1 << 52)).cast("double") + 0.5) / float(1 << 52)
        scores.append(F.struct((-F.lit(float(weight)) / F.log(u)).alias("s"), F.lit(name).alias("n")))
    best = scores[0]
    for s in scores[1:]:
        best = F.when(s["s"] > best["s"], s).otherwise(best)
    return best["n"]


def assign_splits(records: DataFrame, id_col: str, file_col: str, pairs: DataFrame, targets: DataFrame) -> DataFrame:
    """Split of every record: (id, file, group_file, split).

    Targets that are null or not positive take no records; at least one must be positive.
    """
    rows = targets.filter("fraction > 0 and split is not null").groupBy("split").agg(F.sum("fraction").alias("fraction")).limit(MAX_SPLITS + 1).collect()
    if not rows or len(rows) > MAX_SPLITS:
        raise ValueError(f"between 1 and {MAX_SPLITS} splits with a positive fraction are needed")
    weights = [(r["split"], r["fraction"]) for r in rows]
    groups = related_files(pairs).select(F.col("file").alias("__file"), "group_file")
    clean = file_of_path(F.col(file_col))
    out = records.select(F.col(id_col).alias("id"), clean.alias("__key"), F.col(file_col).alias("file")).join(broadcast_if_small(groups), F.col("__key") == F.col("__file"), "left")
    group = F.coalesce("group_file", "__key", F.concat(F.lit("\0"), F.col("id").cast("string")))
    return out.select("id", "file", group.alias("group_file"), rendezvous(group, weights).alias("split"))
