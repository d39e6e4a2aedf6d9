"""Registered queries of this subpackage: name to (spark, directory) -> DataFrame."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidegrid.llm import byte_bpe, canonical, leaks, quota_sample, related_splits, score_cutoff, sentences, split_overlap
from tidegrid.store import broadcast_if_small, table


def p1_found(spark, d):
    return split_overlap.overlapping_clips(table(spark, d, "prepared"))


def p1_report(spark, d):
    return split_overlap.overlap_report(table(spark, d, "prepared"))


def p1_coverage(spark, d):
    return split_overlap.overlap_coverage(table(spark, d, "prepared"))


def p2_found(spark, d):
    return canonical.map_tags(table(spark, d, "seltab"), table(spark, d, "classes"), table(spark, d, "remap"))


def p2_unmatched(spark, d):
    """Distinct tags that mean no entry, with their rows."""
    none = p2_found(spark, d).filter("class_idx = -1").select("sel_id")
    rows = table(spark, d, "seltab").select("sel_id", "tags").distinct()
    return rows.join(none, "sel_id", "left_semi").groupBy("tags").agg(F.count("*").alias("n_rows"))


def p4_found(spark, d):
    return quota_sample.unreachable(table(spark, d, "prepared"), table(spark, d, "class_targets"))


def p4_report(spark, d):
    """Whole clips per target: the expected number is between the two drawn numbers."""
    r = quota_sample.plan_report(table(spark, d, "prepared"), table(spark, d, "class_targets"))
    return r.select("plan_id", "class_idx", "at_hand", "wanted", "gap", F.rint(F.col("expected") * 1000).cast("bigint").alias("expected_milli"))


def p4_sample(spark, d):
    return quota_sample.draw(table(spark, d, "prepared"), table(spark, d, "class_targets"))


def p5_found(spark, d):
    return related_splits.groups_of_two(related_splits.related_files(table(spark, d, "selmap")))


def p5_assign(spark, d):
    out = related_splits.assign_splits(table(spark, d, "prepared"), "clip_id", "file", table(spark, d, "selmap"), table(spark, d, "split_targets"))
    return out.select(F.col("id").alias("clip_id"), "file", "group_file", "split")


def p5_report(spark, d):
    """Share of clips that each split got, against its target, in parts per million."""
    got = p5_assign(spark, d).groupBy("split").agg(F.count("*").alias("n_clips"), F.countDistinct("group_file").alias("n_groups"))
    total = got.agg(F.sum("n_clips").alias("total"))
    targets = table(spark, d, "split_targets").select("split", F.rint(F.col("fraction") * 1000000).cast("bigint").alias("target_ppm"))
    out = targets.join(broadcast_if_small(got), "split", "left").join(F.broadcast(total))  # one row
    n = F.coalesce("n_clips", F.lit(0))
    return out.select("split", "target_ppm", n.alias("n_clips"), F.coalesce("n_groups", F.lit(0)).alias("n_groups"), F.coalesce(F.rint(F.try_divide(n * 1000000, F.col("total"))), F.lit(0)).cast("bigint").alias("got_ppm"))


def p6_found(spark, d):
    return score_cutoff.source_cutoffs(table(spark, d, "scores"), table(spark, d, "keep_targets"))


def p7_ids(spark, d):
    return byte_bpe.encode_corpus(table(spark, d, "documents"))


def p8_found(spark, d):
    return leaks.leaked_items(table(spark, d, "documents"), table(spark, d, "eval_items"))


def p8_report(spark, d):
    return leaks.leak_report(table(spark, d, "documents"), table(spark, d, "eval_items"))


def p9_found(spark, d):
    return sentences.sentence_units(table(spark, d, "documents"))


QUERIES = {f.__name__: f for f in (p1_found, p1_report, p1_coverage, p2_found, p2_unmatched, p4_found, p4_report, p4_sample, p5_found, p5_assign, p5_report, p6_found, p7_ids, p8_found, p8_report, p9_found)}
