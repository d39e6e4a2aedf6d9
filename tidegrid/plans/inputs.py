"""The input tables as the operators want them, and the same as SQL.

Scores and prepared clips lie on a grid of 64 samples every 16 at 64 Hz. Preparation queries use
clips of 64 s every 32 s at the same rate. ``CTE`` holds the SQL of each input; ``with_ctes`` puts
the needed ones in front of a query.
"""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from tidegrid.operators import coverage, labels, segment
from tidegrid.store import table

FS = 64
SCORED = segment.ClipSettings(FS, 1.0, 0.25)
PREP = segment.ClipSettings(FS, 64.0, 32.0)
PREP_TRAILING = segment.ClipSettings(FS, 64.0, 40.0, trailing=True)


def axis(spark, d):
    return segment.recordings_axis(table(spark, d, "recordings"), FS)


def annotations(spark, d):
    """Annotations in samples with their class index."""
    own = coverage.sample_annotations(table(spark, d, "annotations"), FS)
    return labels.map_labels(own, table(spark, d, "classes"), table(spark, d, "remap"))


def touched(spark, d, s=PREP):
    return coverage.touched_clips(annotations(spark, d), axis(spark, d), s)


def covered(spark, d, s=PREP, centralized=False):
    return coverage.clip_coverage(touched(spark, d, s), s, centralized)


def scores(spark, d):
    return table(spark, d, "scores")


def waves(spark, d):
    """(vec_id, samples): embeddings as waveforms of 64 samples."""
    return table(spark, d, "embeddings").select("vec_id", "label", F.transform("embedding", lambda v: v.cast("double")).alias("samples"))


def grid_sql(n: str, s: segment.ClipSettings) -> str:
    return f"select file, channel, i::int as clip_idx, (i * {s.advance})::bigint as clip_start, (i * {s.advance} + {s.length - 1})::bigint as clip_end from {n}, unnest(range(0, case when n >= {s.length} then (n - {s.length}) // {s.advance} + 1 else 0 end)) as u(i)"


def touched_sql(s: segment.ClipSettings) -> str:
    return f"""select a.*, g.clip_idx, g.clip_start, least(a.a1, g.clip_end) - greatest(a.a0, g.clip_start) + 1 as overlap
  from ann a join ({grid_sql('axis', s)}) g on a.file = g.file and a.channel = g.channel and a.a0 <= g.clip_end and a.a1 >= g.clip_start"""


def covered_sql(name: str, s: segment.ClipSettings) -> str:
    return f"select *, overlap::double / least({s.length}, a1 - a0 + 1) as cov from {name}"


CTE = {
    "axis": f"select file, channel, max(n_samples * {FS} // fs) as n from recordings where n_samples is not null and fs is not null and file is not null and channel is not null group by file, channel",
    "known": "select label, class_idx from classes union all select r.src, c.class_idx from remap r join classes c on c.label = r.dst where r.src not in (select label from classes)",
    "rawann": f"select distinct annot_id, file, channel, label, round_even(begin_s * {FS}, 0)::bigint as a0, round_even(end_s * {FS}, 0)::bigint as a1 from annotations where file is not null and channel is not null and label is not null and begin_s is not null and end_s is not null",
    "ann": "select r.*, k.class_idx from rawann r join known k on k.label = r.label where r.a1 >= r.a0",
    "grid": grid_sql("axis", PREP),
    "touched": touched_sql(PREP),
    "covered": covered_sql("touched", PREP),
    "byclass": "select file, channel, clip_idx, class_idx, max(cov) as cov from covered group by all",
    "stouched": touched_sql(SCORED),
    "scovered": covered_sql("stouched", SCORED),
    "sbyclass": "select file, channel, clip_idx, class_idx, max(cov) as cov from scovered group by all",
    "live": "select file, channel, clip_idx, clip_start, class_idx, max(score) as score from scores where score is not null and not isnan(score) group by all",
    "island": "select *, clip_idx - row_number() over (partition by file, channel, class_idx order by clip_idx) as island from live",
    "wave": "select vec_id, label, list_transform(embedding, lambda v: v::double) as x from embeddings",
}
ORDER = list(CTE)


def with_ctes(query: str) -> str:
    """The query with the CTEs that it names, directly or through others, in front."""
    needed: set[str] = set()

    def visit(text: str) -> None:
        for name in ORDER:
            if name not in needed and re.search(rf"\b(?:from|join)\s+\(*{name}\b", text):
                needed.add(name)
                visit(CTE[name])

    visit(query)
    own = [f"{n} as ({CTE[n]})" for n in ORDER if n in needed]
    if not own:
        return query
    rest = query.strip()
    if rest.lower().startswith("with "):
        return "with " + ",\n".join(own) + ",\n" + rest[5:]
    return "with " + ",\n".join(own) + "\n" + rest
