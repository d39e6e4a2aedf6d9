"""Registry of the core queries, each with its oracle SQL where SQL can express it."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidegrid.functions import augment, signal, spectral
from tidegrid.operators import coverage, labels, matching, metrics, sampling, segment, streaks
from tidegrid.operators.intervals import annotated_periods
from tidegrid.plans import inputs, pipelines
from tidegrid.plans.inputs import FS, PREP, PREP_TRAILING, SCORED
from tidegrid.store import all_rows, broadcast_if_small, table

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a query under its name, with its oracle."""

    def register(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = inputs.with_ctes(sql)
        return f

    return register


@query("""
with a as (
  select distinct file, channel::bigint as channel, label, round_even(begin_s * 1000, 0)::bigint as b, round_even(end_s * 1000, 0)::bigint as e
  from annotations where file is not null and channel is not null and label is not null and begin_s is not null and end_s is not null),
m as (select *, max(e) over (partition by file, channel, label order by b, e rows between unbounded preceding and 1 preceding) as pe from a where e >= b),
i as (select *, sum(case when pe is null or b > pe then 1 else 0 end) over (partition by file, channel, label order by b, e rows unbounded preceding) as g from m),
p as (select file, channel, label, g, min(b) as b, max(e) as e from i group by file, channel, label, g),
x as (select *, lag(e) over (partition by file, channel, label order by b) as pe from p)
select file, channel, label, 'period' as kind, b as begin_ms, e as end_ms from p
union all select file, channel, label, 'gap', pe, b from x where pe is not null""")
def p3_found(spark, d):
    return annotated_periods(table(spark, d, "annotations"))


# ---- clips ----


@query("select * from grid")
def clip_grid(spark, d):
    return segment.clip_grid(inputs.axis(spark, d), PREP)


T = PREP_TRAILING
_TRAILING = f"""with r as (select file, channel, n, (n - {T.length}) // {T.advance} as k, (n - {T.length}) % {T.advance} as rest from axis where n >= {T.length}),
g as (select file, channel, i as clip_idx, i * {T.advance} as clip_start from r, unnest(range(0, k + 1)) as u(i)
  union all select file, channel, k + 1, n - {T.length} from r where rest > 0 and rest >= {min(T.length // 2, T.length - T.advance)})
select file, channel, clip_idx::int as clip_idx, clip_start::bigint as clip_start, (clip_start + {T.length - 1})::bigint as clip_end from g"""


@query(_TRAILING)
def clip_grid_trailing(spark, d):
    return segment.clip_grid(inputs.axis(spark, d), PREP_TRAILING)


@query(f"select file, sum(case when n >= {PREP.length} then (n - {PREP.length}) // {PREP.advance} + 1 else 0 end)::bigint as n_clips from axis group by file")
def clip_counts_per_file(spark, d):
    return segment.clip_counts(inputs.axis(spark, d), PREP)


@query("select vec_id, i::int as clip_idx, (i * 8)::bigint as clip_start, x[i * 8 + 1 : i * 8 + 16] as clip from wave, unnest(range(0, 7)) as u(i)")
def frame_embedding(spark, d):
    return segment.cut_clips(inputs.waves(spark, d), segment.ClipSettings(FS, 0.25, 0.125), ["vec_id"])


@query("select file, count(*) as n_channels, max(n)::bigint as longest from axis where n between 64 and 64000 group by file")
def duration_gate(spark, d):
    """Files whose length lies between a clip and 1000 s, decided before any sample is read."""
    own = inputs.axis(spark, d).filter(F.col("n").between(FS, 1000 * FS))
    return own.groupBy("file").agg(F.count("*").alias("n_channels"), F.max("n").alias("longest"))


# ---- labels ----


@query("select label, count(*) as n from annotations where label is not null group by label")
def label_discovery(spark, d):
    return labels.discover_labels(table(spark, d, "annotations"))


@query("select class_idx, count(*) as n, min(a0)::bigint as first_sample from ann group by class_idx")
def label_remap_fixed(spark, d):
    return inputs.annotations(spark, d).groupBy("class_idx").agg(F.count("*").alias("n"), F.min("a0").alias("first_sample"))


@query("""with base as (select distinct label from annotations where label is not null),
used as (select src, dst from remap where (src in (select label from base) or dst in (select label from base)) and src <> 'Other'),
final as (select label from base where label not in (select src from used) union select dst from used union select 'Other'),
idx as (select label, (row_number() over (order by label) - 1)::int as class_idx from final)
select label, class_idx from idx union select u.src, i.class_idx from used u join idx i on i.label = u.dst""")
def label_remap_open(spark, d):
    """Class space inferred from the annotations, opened up by the remaps."""
    found = [r["label"] for r in all_rows(labels.discover_labels(table(spark, d, "annotations")).select("label").orderBy("label"), 100_000)]
    maps = {r["src"]: r["dst"] for r in all_rows(table(spark, d, "remap"), 100_000)}
    import warnings

    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        return labels.LabelSpace(found, maps, negative="Other", fixed=False).table(spark)


@query("select annot_id, class_idx from ann where class_idx not in (60, 0)")
def reject_class(spark, d):
    return labels.reject_classes(inputs.annotations(spark, d), [60, 0]).select("annot_id", "class_idx")


@query("select clip_id, list_transform(range(0, 5), lambda i: case when i = clip_id % 5 then 1.0 else 0.0 end::float) as labels from prepared")
def file_level_label(spark, d):
    own = table(spark, d, "prepared").select("clip_id", (F.col("clip_id") % 5).alias("c"))
    return labels.file_level_labels(own, "c", 5).drop("c")


# ---- coverage ----


@query("select file, channel, clip_idx, class_idx, round(cov, 6) as cov from byclass")
def coverage_by_class(spark, d):
    return coverage.coverage_by_class(inputs.covered(spark, d)).withColumn("cov", F.round("cov", 6))


L = PREP.length
_CENTRED = f"""with x as (select *, clip_start + {L // 4} as f, clip_start + {L - 1 - -(-L // 4)} as l, clip_start + {(L - 1) / 2} as c from covered),
y as (select *, case when a1 - a0 + 1 < {L // 2} and not (a0 >= f and a1 <= l) and not (a0 < c and a1 > c) then 1 - least(abs(c - a0), abs(c - a1)) / {L // 2} else 1.0 end as factor from x)
select file, channel, clip_idx, class_idx, round(max(cov * factor::double), 6) as cov from y group by all"""


@query(_CENTRED)
def coverage_centralized(spark, d):
    return coverage.coverage_by_class(inputs.covered(spark, d, centralized=True)).withColumn("cov", F.round("cov", 6))


@query(f"select g.* from grid g left join (select distinct file, channel, clip_idx from touched where overlap > 0.1 * {L}) b on b.file = g.file and b.channel = g.channel and b.clip_idx = g.clip_idx where b.file is null")
def negative_clips(spark, d):
    return coverage.negative_clips(segment.clip_grid(inputs.axis(spark, d), PREP), inputs.touched(spark, d), PREP, 0.1)


@query("select distinct annot_id from covered where cov >= 0.9")
def matched_annotations(spark, d):
    return coverage.matched(inputs.covered(spark, d), 0.9)


@query("select annot_id, file, channel, a0, a1 from ann where annot_id not in (select annot_id from covered where cov >= 0.9)")
def unmatched_annotations(spark, d):
    return coverage.unmatched(inputs.annotations(spark, d), inputs.covered(spark, d), 0.9).select("annot_id", "file", "channel", "a0", "a1")


_LABELS = """with keep as (select file, channel, clip_idx from byclass group by all having max(cov) >= 0.8),
lab as (select b.file, b.channel, b.clip_idx, b.class_idx, case when b.cov >= 0.8 then 1.0::double when b.cov >= 0.8::double / 3 then b.cov else 0.0 end as v
  from byclass b join keep k on k.file = b.file and k.channel = b.channel and k.clip_idx = b.clip_idx)
"""


@query(_LABELS + "select file, channel, clip_idx, class_idx, round(v, 6) as label_value from lab")
def prepared_labels(spark, d):
    return coverage.prepared_labels(coverage.coverage_by_class(inputs.covered(spark, d)), 0.8).withColumn("label_value", F.round("label_value", 6))


@query(_LABELS + "select class_idx, count(*) as n_clips from lab where v = 1.0 group by class_idx")
def prepared_counts(spark, d):
    return coverage.prepared_counts(coverage.prepared_labels(coverage.coverage_by_class(inputs.covered(spark, d)), 0.8))


A = PREP.advance


@query(f"""with um as (select a.annot_id, a.file, a.channel, a.a0, a.a1, x.n from ann a join axis x on x.file = a.file and x.channel = a.channel where a.annot_id not in (select annot_id from covered where cov >= 0.9)),
s as (select annot_id, file, channel, n, a0 + (a1 - a0 + 1) // 2 - {L // 2} as clip_start from um where a1 - a0 + 1 < {L}
  union all select annot_id, file, channel, n, a0 + i * {A} from um, unnest(range(0, case when a1 - a0 + 1 >= {L} then (a1 - a0 + 1 - {L}) // {A} + 1 else 0 end)) as u(i))
select annot_id, file, channel, clip_start::bigint as clip_start from s where clip_start >= 0 and clip_start + {L} <= n""")
def salvage_clips(spark, d):
    un = coverage.unmatched(inputs.annotations(spark, d), inputs.covered(spark, d), 0.9)
    return segment.salvage_clips(un, inputs.axis(spark, d), PREP)


_TTOUCHED = f"""tgrid as (select file, channel, clip_idx, clip_start, clip_start + {T.length - 1} as clip_end from g),
tt as (select a.*, g.clip_idx, g.clip_start, least(a.a1, g.clip_end) - greatest(a.a0, g.clip_start) + 1 as overlap from ann a join tgrid g on a.file = g.file and a.channel = g.channel and a.a0 <= g.clip_end and a.a1 >= g.clip_start)
"""
_TRAILING_CTE = _TRAILING[: _TRAILING.rindex("select file, channel, clip_idx::int")].rstrip() + ",\n" + _TTOUCHED


@query(_TRAILING_CTE + f"select file, channel, clip_idx::int as clip_idx, class_idx, round(max(overlap::double / least({T.length}, a1 - a0 + 1)), 6) as cov from tt group by all")
def coverage_trailing(spark, d):
    """Coverage of regular and trailing clips by each class."""
    touched = inputs.touched(spark, d, PREP_TRAILING)
    return coverage.coverage_by_class(coverage.clip_coverage(touched, PREP_TRAILING)).withColumn("cov", F.round("cov", 6))


@query(_TRAILING_CTE + f"select file, channel, clip_idx::int as clip_idx, clip_start::bigint as clip_start from tgrid g where not exists (select 1 from tt where tt.file = g.file and tt.channel = g.channel and tt.clip_idx = g.clip_idx and tt.overlap > 0.1 * {T.length})")
def negative_clips_trailing(spark, d):
    grid = segment.clip_grid(inputs.axis(spark, d), PREP_TRAILING)
    return coverage.negative_clips(grid, inputs.touched(spark, d, PREP_TRAILING), PREP_TRAILING, 0.1).drop("clip_end")


_SHORT = segment.ClipSettings(FS, 0.25, 0.15625, trailing=True, normalize=False)


@query("select vec_id as file, i::int as clip_idx, s::bigint as clip_start, x[s + 1 : s + 16] as clip from wave, (select unnest([0, 1, 2, 3, 4, 5]) as i, unnest([0, 10, 20, 30, 40, 48]) as s) t")
def cut_blocks(spark, d):
    """Clips of waveforms that come in blocks of 20 samples with 16 samples of context; as of the whole."""
    block = F.explode(F.array(*[F.lit(i).cast("bigint") for i in range(0, FS, 20)])).alias("own_first")
    rows = inputs.waves(spark, d).select(F.col("vec_id").alias("file"), F.lit(0).alias("channel"), F.lit(FS).alias("fs"), "samples", block)
    start = F.greatest(F.lit(0), F.col("own_first") - 16)
    rows = rows.withColumns({"start_sample": start, "own_count": F.least(F.lit(20), FS - F.col("own_first")), "n_samples": F.lit(FS).cast("bigint")})
    rows = rows.withColumn("samples", F.slice("samples", (start + 1).cast("int"), (F.least(F.lit(FS), F.col("own_first") + 36) - start).cast("int")))
    return pipelines.channel_clips(rows, _SHORT).drop("channel")


def _short_inputs(spark, d):
    """Waveforms as recordings of one second, each with an annotation of its own."""
    waves = inputs.waves(spark, d).select(F.col("vec_id").cast("string").alias("file"), F.lit(0).alias("channel"), F.lit(FS).alias("fs"), "samples")
    first = F.expr("(vec_id * 7) % 60")
    found = inputs.waves(spark, d).select(
        F.col("vec_id").alias("annot_id"), F.col("vec_id").cast("string").alias("file"), F.lit(0).alias("channel"), F.when(F.col("vec_id") % 3 == 0, "a").otherwise("b").alias("label"),
        (first / FS).alias("begin_s"), (F.least(F.lit(63), first + F.expr("vec_id % 11 + 2")) / FS).alias("end_s"),
    )
    classes = spark.createDataFrame([("a", 0, False), ("b", 1, False), ("none", 2, True)], "label string, class_idx int, is_negative boolean")
    return waves, found, classes


_PREPARED = """with a as (select vec_id, x, (vec_id * 7) % 60 as a0, least(63, (vec_id * 7) % 60 + vec_id % 11 + 2) as a1, case when vec_id % 3 = 0 then 0 else 1 end as c from wave),
g as (select a.*, s, greatest(0, least(a1, s + 15) - greatest(a0, s) + 1)::double as o from a, (select unnest([0, 10, 20, 30, 40, 48]) as s) t),
v as (select *, o / (a1 - a0 + 1) as cov from g),
hit as (select vec_id, x, s, c from v where cov >= 1),
neg as (select vec_id, x, s, 2 as c from v where o = 0),
"""
_CLIP = "select vec_id::varchar as file, s::bigint as clip_start, list_transform(x[s + 1 : s + 16], lambda y: trunc(least(greatest(y * 32768, -32768), 32767))::smallint) as clip, [(c = 0)::int::float, (c = 1)::int::float, (c = 2)::int::float] as labels from "


@query(_PREPARED + "allc as (select * from hit union all select * from neg) " + _CLIP + "allc")
def prepare_clips(spark, d):
    """Prepared and negative clips of short waveforms, the trailing one included."""
    return pipelines.prepare(*_short_inputs(spark, d), _SHORT, max_nonmatch=0.0)[0].drop("channel")


@query(_PREPARED + "sal as (select vec_id, x, a0 + (a1 - a0 + 1) // 2 - 8 as s, c from a where vec_id not in (select vec_id from hit)), allc as (select * from hit union all select * from sal where s >= 0 and s + 16 <= 64) " + _CLIP + "allc")
def prepare_salvage(spark, d):
    """Prepared clips of short waveforms, with clips of their own for annotations that none covers."""
    return pipelines.prepare(*_short_inputs(spark, d), _SHORT, salvage=True)[0].drop("channel")


@query(_PREPARED + "allc as (select * from hit) select c as class_idx, count(*) as n_clips from allc group by c")
def prepare_totals(spark, d):
    return pipelines.prepare(*_short_inputs(spark, d), _SHORT)[1]


# ---- scores to detections ----


@query("select file, channel, clip_idx, class_idx, round(greatest(0, (score - 1.0::double / 61) / (1 - 1.0::double / 61)), 4) as score from live")
def score_scale(spark, d):
    return streaks.live_scores(inputs.scores(spark, d)).select("file", "channel", "clip_idx", "class_idx", F.round(streaks.scaled_score(F.col("score"), 61), 4).alias("score"))


@query("select * from live where score >= 0.5")
def threshold_scores(spark, d):
    return streaks.live_scores(inputs.scores(spark, d), 0.5)


@query("select file, channel, clip_idx, clip_start, class_idx, score from (select *, row_number() over (partition by file, channel, clip_idx order by score desc, class_idx) as r from live) where r = 1")
def nonmax_suppress(spark, d):
    return streaks.top_class(streaks.live_scores(inputs.scores(spark, d)))


@query("select file, channel, class_idx, min(clip_start) as start_samp, max(clip_start) + 63 as end_samp, max(score) as score from island group by file, channel, class_idx, island")
def streak_combine(spark, d):
    return streaks.detections(inputs.scores(spark, d), SCORED.length)


_SQUEEZE = """with r as (select *, count(*) over w as n, row_number() over o as rn, max(score) over a as top, max(clip_start) over a as far from island
  window w as (partition by file, channel, class_idx, island), o as (partition by file, channel, class_idx, island order by clip_idx),
  a as (partition by file, channel, class_idx, island order by clip_idx rows between current row and 2 following)),
g as (select file, channel, class_idx, island, rn, far as gs, clip_start + 63 as ge, top from r where rn <= n - least(3, n) + 1),
b as (select *, case when lag(ge) over (partition by file, channel, class_idx, island order by rn) + 1 >= gs then 0 else 1 end as new from g),
p as (select *, sum(new) over (partition by file, channel, class_idx, island order by rn rows unbounded preceding) as part from b)
select file, channel, class_idx, min(gs) as start_samp, max(ge) as end_samp, round(median(top), 6) as score from p group by file, channel, class_idx, island, part"""


@query(_SQUEEZE)
def streak_squeeze(spark, d):
    """Detections of at least half a second squeezed out of clips of one second."""
    return streaks.detections(inputs.scores(spark, d), SCORED.length, squeeze=(SCORED.advance, SCORED.length // 2)).withColumn("score", F.round("score", 6))


def _dense(spark, d):
    """Coverage of clips by classes as scores: long runs of live clips."""
    own = coverage.coverage_by_class(inputs.covered(spark, d, SCORED)).withColumnRenamed("cov", "score")
    return own.filter("score >= 0.3").withColumn("clip_start", F.col("clip_idx").cast("bigint") * SCORED.advance)


_DENSE = """with live2 as (select file, channel, class_idx, clip_idx, clip_idx::bigint * 16 as clip_start, cov as score from sbyclass where cov >= 0.3),
island2 as (select *, clip_idx - row_number() over (partition by file, channel, class_idx order by clip_idx) as island from live2)"""


@query(_DENSE + " select file, channel, class_idx, min(clip_start) as start_samp, max(clip_start) + 63 as end_samp, round(max(score), 6) as score from island2 group by file, channel, class_idx, island")
def streak_combine_dense(spark, d):
    return streaks.combine_streaks(_dense(spark, d), SCORED.length).withColumn("score", F.round("score", 6))


@query(_DENSE + ",\n" + _SQUEEZE[5:].replace("from island\n", "from island2\n"))
def streak_squeeze_dense(spark, d):
    return streaks.squeeze_streaks(_dense(spark, d), SCORED.length, SCORED.advance, SCORED.length // 2).withColumn("score", F.round("score", 6))


@query("""with det as (select file, channel, class_idx, min(clip_start) as s, max(clip_start) + 63 as e, max(score) as score from island group by file, channel, class_idx, island)
select file, row_number() over (partition by file order by s, channel, class_idx, e) as selection, channel, class_idx, s::double / 64 as begin_s, e::double / 64 as end_s, score from det""")
def detections_in_time(spark, d):
    found = streaks.in_time_order(streaks.detections(inputs.scores(spark, d), SCORED.length), FS)
    return found.withColumn("selection", F.col("selection").cast("bigint"))


@query("""with det as (select file, count(*) as n from (select file, channel, class_idx, island from island group by all) group by file),
f as (select file, deployment, max(n_samples // fs)::double as s from recordings where file is not null and deployment is not null and n_samples is not null group by file, deployment)
select f.deployment, f.file, coalesce(sum(f.s) over w, 0) as time_offset_s, coalesce(sum(coalesce(d.n, 0)) over w, 0)::bigint as selection_offset, coalesce(d.n, 0)::bigint as n
from f left join det d on d.file = f.file window w as (partition by f.deployment order by f.file rows between unbounded preceding and 1 preceding)""")
def combined_numbering(spark, d):
    files = table(spark, d, "recordings").filter("file is not null and deployment is not null and n_samples is not null")
    files = files.groupBy("file", "deployment").agg(F.max(F.expr("n_samples div fs")).cast("double").alias("duration_s"))
    return streaks.combined_numbering(files, streaks.detections(inputs.scores(spark, d), SCORED.length), "deployment")


# ---- matching and metrics ----


def _truth(spark, d):
    own = table(spark, d, "annotations").groupBy("annot_id").agg(F.max(F.struct("file", "channel", "label", "begin_s", "end_s")).alias("a")).select("annot_id", "a.*")
    own = labels.map_labels(own, table(spark, d, "classes"), table(spark, d, "remap"))
    return own.select("file", "channel", "class_idx", F.col("annot_id").alias("id"), F.col("begin_s").alias("b"), F.col("end_s").alias("e"))


def _typed(spark, d):
    """Selections whose tag is a label, as detections; their channels count from 1."""
    own = table(spark, d, "seltab").groupBy("sel_id").agg(F.max(F.struct("channel", "begin_file", "begin_time_s", "end_time_s", "tags")).alias("a")).select("sel_id", "a.*")
    own = labels.map_labels(own.withColumnRenamed("tags", "label"), table(spark, d, "classes"))
    return own.select(F.col("begin_file").alias("file"), (F.col("channel") - 1).alias("channel"), "class_idx", F.col("sel_id").alias("id"), F.col("begin_time_s").alias("b"), F.col("end_time_s").alias("e"))


_PAIR = """with gt0 as (select distinct annot_id as id, file, channel, label, begin_s as b, end_s as e from annotations where file is not null and channel is not null and begin_s is not null and end_s is not null and end_s >= begin_s),
gt as (select g.id, g.file, g.channel, k.class_idx, g.b, g.e from gt0 g join known k on k.label = g.label),
det0 as (select sel_id as id, max(channel) as channel, any_value(begin_file) as file, any_value(begin_time_s) as b, any_value(end_time_s) as e, any_value(tags) as label from seltab group by sel_id),
det as (select x.id, x.file, x.channel - 1 as channel, c.class_idx, x.b, x.e from det0 x join classes c on c.label = x.label where x.file is not null and x.channel is not null and x.b is not null and x.e is not null and x.e >= x.b),
"""


def _cover_sql(base: str, items: str) -> str:
    return f"""h as (select x.id, greatest(x.b, y.b) as s, least(x.e, y.e) as t from {base} x join {items} y on x.file = y.file and x.channel = y.channel and x.class_idx = y.class_idx and y.b < x.e and y.e > x.b),
m as (select *, max(t) over (partition by id order by s, t rows between unbounded preceding and 1 preceding) as r from h),
c as (select id, sum(greatest(0, t - greatest(s, coalesce(r, s)))) as covered from m group by id)
"""


@query(_PAIR + _cover_sql("gt", "det") + "select gt.id, round(coalesce(c.covered, 0), 6) as covered from gt left join c on c.id = gt.id")
def union_coverage(spark, d):
    return matching.union_coverage(_truth(spark, d), _typed(spark, d), ["file", "channel", "class_idx"]).select("id", F.round("covered", 6).alias("covered"))


_HALF = " (coalesce(c.covered, 0) >= (x.e - x.b) * 0.5 - 1e-9)"


@query(
    _PAIR
    + _cover_sql("gt", "det").replace("h as", "h1 as").replace("from h)", "from h1)").replace("m as (", "m1 as (").replace("from m ", "from m1 ").replace("c as (", "c1 as (")
    + ", "
    + _cover_sql("det", "gt")
    + f"""select coalesce(a.class_idx, b.class_idx) as class_idx, coalesce(tp, 0)::bigint as tp, coalesce(tpfp, 0)::bigint as tp_plus_fp, coalesce(rn, 0)::bigint as recall_num, coalesce(rd, 0)::bigint as recall_den
from (select class_idx, count(*) filter (where coalesce(c.covered, 0) >= (x.e - x.b) * 0.5 - 1e-9) as rn, count(*) as rd from gt x left join c1 c on c.id = x.id group by class_idx) a
full join (select class_idx, count(*) filter (where {_HALF}) as tp, count(*) as tpfp from det x left join c on c.id = x.id group by class_idx) b on a.class_idx = b.class_idx"""
)
def gt_det_match(spark, d):
    return metrics.interval_counts(_truth(spark, d), _typed(spark, d))


def _scored(spark, d):
    """Live scores with the coverage of their clip by their class."""
    cov = coverage.coverage_by_class(inputs.covered(spark, d, SCORED))
    live = streaks.live_scores(inputs.scores(spark, d))
    return live.join(cov, ["file", "channel", "clip_idx", "class_idx"], "left").select("class_idx", "score", F.coalesce("cov", F.lit(0.0)).alias("cov"))


_COUNTS = """with t as (select round(0.05::double * i, 2) as threshold from range(0, 21) as u(i)),
x as (select l.class_idx, l.score, coalesce(b.cov, 0) as cov from live l left join sbyclass b on b.file = l.file and b.channel = l.channel and b.clip_idx = l.clip_idx and b.class_idx = l.class_idx),
den as (select class_idx, count(*) filter (where cov >= 0.5) as recall_den from x group by class_idx),
n as (select t.threshold, d.class_idx, count(*) filter (where x.score >= t.threshold and x.cov >= 0.5) as tp, count(*) filter (where x.score >= t.threshold and (x.cov >= 0.5 or x.cov <= 0.1)) as tp_plus_fp, any_value(d.recall_den) as recall_den
  from t cross join den d join x on x.class_idx = d.class_idx group by t.threshold, d.class_idx)
"""


def _raw_counts(spark, d):
    return metrics.clip_counts(_scored(spark, d), min_fraction=0.5, max_nonmatch=0.1)


@query(_COUNTS + "select threshold, class_idx, tp::bigint as tp, tp_plus_fp::bigint as tp_plus_fp, tp::bigint as recall_num, recall_den::bigint as recall_den from n")
def pr_raw_counts(spark, d):
    return _raw_counts(spark, d)


@query(_COUNTS + "select threshold, class_idx, case when tp_plus_fp > 0 then round(tp::double / tp_plus_fp, 6) end as precision, round(tp::double / recall_den, 6) as recall from n where recall_den > 0")
def pr_raw(spark, d):
    return metrics.ratios(_raw_counts(spark, d)).select("threshold", "class_idx", F.round("precision", 6).alias("precision"), F.round("recall", 6).alias("recall"))


@query(_COUNTS + "select threshold, case when sum(tp_plus_fp) > 0 then round(sum(tp)::double / sum(tp_plus_fp), 6) end as precision, case when sum(recall_den) > 0 then round(sum(tp)::double / sum(recall_den), 6) end as recall from n group by threshold")
def pr_raw_overall(spark, d):
    return metrics.overall(_raw_counts(spark, d)).select("threshold", F.round("precision", 6).alias("precision"), F.round("recall", 6).alias("recall"))


_BY_THRESHOLD = _SQUEEZE[5:].replace("class_idx, island", "class_idx, threshold, island").replace("class_idx, min(gs)", "class_idx, threshold, min(gs)").replace("from island\n", "from tisland\n")
_PROCESSED = (
    _PAIR[: _PAIR.index("det0 as")]
    + """t as (select round(0.05::double * i, 2) as threshold from range(0, 21) as u(i)),
tisland as (select l.*, t.threshold, clip_idx - row_number() over (partition by file, channel, class_idx, threshold order by clip_idx) as island from live l join t on l.score >= t.threshold),
"""
    + _BY_THRESHOLD[: _BY_THRESHOLD.index("select file, channel, class_idx, threshold, min(gs)")].rstrip()
    + """,
det as (select row_number() over () as id, * from (select file, channel, class_idx, threshold, min(gs)::double / 64 as b, max(ge)::double / 64 as e from p group by file, channel, class_idx, threshold, island, part)),
h as (select g.id as gid, d.id as did, d.threshold, greatest(g.b, d.b) as s, least(g.e, d.e) as u from gt g join det d on g.file = d.file and g.channel = d.channel and g.class_idx = d.class_idx and d.b < g.e and d.e > g.b),
mg as (select *, max(u) over (partition by gid, threshold order by s, u rows between unbounded preceding and 1 preceding) as r from h),
cg as (select gid, threshold, sum(greatest(0, u - greatest(s, coalesce(r, s)))) as covered from mg group by gid, threshold),
md as (select *, max(u) over (partition by did order by s, u rows between unbounded preceding and 1 preceding) as r from h),
cd as (select did, sum(greatest(0, u - greatest(s, coalesce(r, s)))) as covered from md group by did),
rc as (select t.threshold, g.class_idx, count(*) filter (where coalesce(c.covered, 0) >= (g.e - g.b) * 0.5 - 1e-9) as rn, count(*) as rd from gt g cross join t left join cg c on c.gid = g.id and c.threshold = t.threshold group by all),
pc as (select d.threshold, d.class_idx, count(*) filter (where coalesce(c.covered, 0) >= (d.e - d.b) * 0.5 - 1e-9) as tp, count(*) as n from det d left join cd c on c.did = d.id group by all),
n as (select coalesce(rc.threshold, pc.threshold) as threshold, coalesce(rc.class_idx, pc.class_idx) as class_idx, coalesce(tp, 0)::bigint as tp, coalesce(n, 0)::bigint as tp_plus_fp, coalesce(rn, 0)::bigint as recall_num, coalesce(rd, 0)::bigint as recall_den
  from rc full join pc on rc.threshold = pc.threshold and rc.class_idx = pc.class_idx)
"""
)


@query(_PROCESSED + "select * from n")
def pr_processed_counts(spark, d):
    """Interval counts of squeezed detections at the thresholds 0, 0.05, ... 1."""
    return metrics.processed_counts(inputs.scores(spark, d), _truth(spark, d), FS, SCORED.length, squeeze=(SCORED.advance, SCORED.length // 2))


@query(_PROCESSED + "select threshold, class_idx, case when tp_plus_fp > 0 then round(tp::double / tp_plus_fp, 6) end as precision, round(recall_num::double / recall_den, 6) as recall from n where recall_den > 0")
def pr_processed(spark, d):
    return metrics.ratios(pr_processed_counts(spark, d)).select("threshold", "class_idx", F.round("precision", 6).alias("precision"), F.round("recall", 6).alias("recall"))


# ---- feeders ----


def _labelled(spark, d):
    """(vec_id, label): a labelled population."""
    return table(spark, d, "embeddings").select("vec_id", "label")


_PICK = """with r as (select vec_id, label, row_number() over (partition by label order by md5(concat(vec_id::varchar, '-42')), vec_id) as rank, count(*) over (partition by label) as n from embeddings),
k as (select *, least(n, 30) as kept from r)
"""


@query(_PICK + "select vec_id, label, rank::bigint as rank from k where rank <= kept")
def class_cap_sample(spark, d):
    return sampling.pick_per_class(_labelled(spark, d), "label", "vec_id", 42, cap=30).select("vec_id", "label", F.col("rank").cast("bigint").alias("rank"))


@query(_PICK + "select vec_id, label, case when rank > kept - round_even(kept * 0.15, 0) then 'validation' else 'train' end as part from k where rank <= kept")
def train_val_split(spark, d):
    return sampling.pick_per_class(_labelled(spark, d), "label", "vec_id", 42, cap=30, validation=0.15).select("vec_id", "label", "part")


@query("select vec_id, label from embeddings where label in (select label from embeddings group by label having count(*) >= 50)")
def min_class_filter(spark, d):
    return sampling.classes_with(_labelled(spark, d), "label", 50)


@query("with n as (select label, count(*) as n from embeddings group by label) select label, round(sum(n) over () / (count(*) over () * n)::double, 6) as weight from n")
def class_weights(spark, d):
    return sampling.class_weights(_labelled(spark, d), "label").select("label", F.round("weight", 6).alias("weight"))


@query("select clip_id, list_transform(labels, lambda x, i: case when i = list_position(labels, list_max(labels)) then 1.0 else 0.0 end::float) as labels from prepared where labels is not null")
def one_hot(spark, d):
    return table(spark, d, "prepared").filter("labels is not null").select("clip_id", sampling.one_hot(F.col("labels")).alias("labels"))


@query("select clip_id, list_transform(clip, lambda v: v::double / 32768) as clip, labels[11] as label_10 from prepared where split = 'train' and labels is not null")
def prepared_scan(spark, d):
    """Prepared clips as floats with one picked class column."""
    own = table(spark, d, "prepared").filter("split = 'train' and labels is not null")
    return own.select("clip_id", signal.pcm_to_float(F.col("clip")).alias("clip"), F.col("labels")[10].alias("label_10"))


# ---- signals ----

_ROUND = lambda c, n=6: F.transform(c, lambda v: F.round(v, n))
_ROUND2 = lambda c, n=6: F.transform(c, lambda r: F.transform(r, lambda v: F.round(v, n)))


@query("""with m as (select vec_id, list_transform(x, lambda v: v - list_sum(x) / 64) as x from wave)
select vec_id, list_transform(x, lambda v: round(v / greatest(list_max(list_transform(x, lambda w: abs(w))), 1e-24), 6)) as clip from m""")
def clip_normalize(spark, d):
    return inputs.waves(spark, d).select("vec_id", _ROUND(signal.normalize_clip(F.col("samples"))).alias("clip"))


@query("select vec_id, list_transform(x, lambda v: trunc(least(greatest(v * 32768, -32768), 32767))::smallint) as pcm from wave")
def pcm_quantize(spark, d):
    return inputs.waves(spark, d).select("vec_id", signal.float_to_pcm(F.col("samples")).alias("pcm"))


@query("select clip_id, list_transform(clip, lambda v: v::double / 32768) as clip from prepared")
def pcm_dequantize(spark, d):
    return table(spark, d, "prepared").select("clip_id", signal.pcm_to_float(F.col("clip")).alias("clip"))


def _spectral(kind: str, band=None, mels=None):
    return spectral.SpectralSettings(FS, 0.25, 0.5, band=band, kind=kind, n_mels=mels)


def _cells(spark, d, s):
    """(vec_id, f, t, v): one row per cell."""
    spec = inputs.waves(spark, d).select("vec_id", spectral.spectrogram(s)("samples").alias("s"))
    rows = spec.select("vec_id", F.posexplode("s").alias("f", "row"))
    return rows.select("vec_id", "f", F.posexplode("row").alias("t", "v"))


_DFT = """with w as (select i, 0.5 - 0.5 * cos(2 * pi() * i / 15) as w from range(0, 16) as u(i)),
fr as (select e.vec_id, t.t, w.i, e.x[t.t * 8 + w.i + 1] * w.w as y from wave e, (select unnest(range(0, 7)) as t) t, w),
p as (select vec_id, k.f, t, (power(sum(y * cos(2 * pi() * k.f * i / 16)), 2) + power(sum(y * sin(2 * pi() * k.f * i / 16)), 2)) * (case when k.f in (0, 8) then 1 else 2 end) / (64 * (select sum(w * w) from w)) as p
  from fr, (select unnest(range(0, 9)) as f) k group by vec_id, k.f, t)
"""


@query(_DFT + "select vec_id, f::int as f, t::int as t, round(p, 6) as v from p")
def psd(spark, d):
    return _cells(spark, d, _spectral("spec")).withColumn("v", F.round("v", 6))


@query(_DFT + "select vec_id, f::int as f, t::int as t, round(10 * log10(p + 1e-10), 4) as v from p")
def spec_db(spark, d):
    return _cells(spark, d, _spectral("spec_db")).withColumn("v", F.round("v", 4))


@query(_DFT + "select vec_id, f::int as f, t::int as t, round((10 * log10(p + 1e-10) + 100) / 100, 6) as v from p")
def spec_dbfs(spark, d):
    return _cells(spark, d, _spectral("spec_dbfs")).withColumn("v", F.round("v", 6))


@query(_DFT + "select vec_id, (f - 2)::int as f, t::int as t, round(p, 6) as v from p where f between 2 and 6")
def band_clip(spark, d):
    return _cells(spark, d, _spectral("spec", band=(8.0, 24.0))).withColumn("v", F.round("v", 6))


def _mel_values() -> str:
    mel = "(2595 * log10(1 + 32.0::double / 700))"
    edge = lambda k: f"(700 * (pow(10, {mel} * {k} / 5 / 2595) - 1))"
    tri = lambda m: f"greatest(0, least((f * 4 - {edge(m)}) / ({edge(m + 1)} - {edge(m)}), ({edge(m + 2)} - f * 4) / ({edge(m + 2)} - {edge(m + 1)})))"
    return " union all ".join(f"select {m} as m, f, {tri(m)} as b from range(0, 9) as u(f)" for m in range(4))


@query(_DFT + f", bank as ({_mel_values()}), nb as (select m, f, b / sum(b) over (partition by m) as b from bank) select p.vec_id, nb.m::int as f, p.t::int as t, round(sum(p.p * nb.b), 6) as v from p join nb on nb.f = p.f group by p.vec_id, nb.m, p.t")
def mel_spec(spark, d):
    return _cells(spark, d, _spectral("melspec", mels=4)).withColumn("v", F.round("v", 6))


@query(
    _DFT
    + """, e as (select vec_id, f, list(p order by t) as e from p group by vec_id, f),
u as (select vec_id, f, t::int as t, e[t + 1] as p, list_sum(list_transform(range(0, t + 1), lambda j: 0.025::double * pow(0.975::double, t - j) * e[j + 1])) as m from e, unnest(range(0, 7)) as r(t))
select vec_id, f::int as f, t, round(sqrt(p * pow(1e-6 + m, -0.98) + 2) - sqrt(2), 5) as v from u"""
)
def pcen(spark, d):
    return _cells(spark, d, _spectral("spec_pcen")).withColumn("v", F.round("v", 5))


def _spec(spark, d, kind="spec_dbfs"):
    return inputs.waves(spark, d).select("vec_id", spectral.spectrogram(_spectral(kind))("samples").alias("s"))


def _as_cells(df, column="s", digits=6):
    rows = df.select("vec_id", F.posexplode(column).alias("f", "row")).select("vec_id", "f", F.posexplode("row").alias("t", "v"))
    return rows if digits is None else rows.withColumn("v", F.round("v", digits))


_MIRROR = lambda i, n: f"(case when {i} < 0 then -({i}) - 1 when {i} >= {n} then {2 * n - 1} - ({i}) else {i} end)"
_GAUSS = "g as (select j, exp(-j * j / (2 * 0.75::double * 0.75)) as e from range(-3, 4) as u(j)), k as (select j, e / sum(e) over () as k from g)"


@query(_DFT + f", {_GAUSS} select a.vec_id, a.f::int as f, a.t::int as t, round(sum(x.k * y.k * b.p), 6) as v from p a cross join k x cross join k y join p b on b.vec_id = a.vec_id and b.f = {_MIRROR('a.f + x.j', 9)} and b.t = {_MIRROR('a.t + y.j', 7)} group by a.vec_id, a.f, a.t")
def gaussian_blur(spark, d):
    return _as_cells(_spec(spark, d, "spec").select("vec_id", spectral.on_spectrograms(lambda x: spectral.gaussian_blur(x, 0.75, True))("s").alias("s")))


_LOG = "g as (select j, exp(-j * j / 2.0::double) as e from range(-4, 5) as u(j)), l as (select j, e / sum(e) over () * (1 - j * j) as k from g), k as (select j, k / (select sum(k) - 2 * sum(k) filter (where j < -2) from l) as k from l)"


@query(_DFT + f", {_LOG} select a.vec_id, a.f::int as f, a.t::int as t, round(sum(x.k * b.p), 6) + 0.0::double as v from p a cross join k x join p b on b.vec_id = a.vec_id and b.t = a.t and b.f = {_MIRROR('a.f + x.j', 9)} group by a.vec_id, a.f, a.t")
def log_filter(spark, d):
    return _as_cells(_spec(spark, d, "spec").select("vec_id", spectral.on_spectrograms(lambda x: spectral.log_filter(x, (1.0,))[0])("s").alias("s"))).withColumn("v", F.col("v") + 0.0)


@query(_DFT + ", r as (select *, p - min(p) over w as q, max(p) over w - min(p) over w as m from p window w as (partition by vec_id)) select vec_id, f::int as f, t::int as t, round_even(case when m > 0 then q / m else 0 end * 15, 0)::int as v from r")
def spec_to_palette(spark, d):
    own = _spec(spark, d, "spec").select("vec_id", spectral.on_spectrograms(lambda x: spectral.palette_index(x, 16), "array<array<int>>")("s").alias("s"))
    return _as_cells(own, digits=None)


@query()
def zero_phase_filter(spark, d):
    return inputs.waves(spark, d).select("vec_id", _ROUND(signal.zero_phase_filter(4, (8.0, 20.0), "bandpass", FS)("samples")).alias("x"))


@query()
def resample(spark, d):
    return inputs.waves(spark, d).select("vec_id", _ROUND(signal.resample_to(FS, 48)("samples")).alias("x"))


# ---- augmentations with fixed values ----


@query("select vec_id, list_transform(x, lambda v, i: round(v * (pow(10.0::double, -0.3) + (1 - pow(10.0::double, -0.3)) * (i - 1) / 63), 6)) as x from wave")
def aug_ramp(spark, d):
    return inputs.waves(spark, d).select("vec_id", _ROUND(augment.ramp_volume(F.col("samples"), F.lit(6.0))).alias("x"))


@query("select vec_id, list_transform(x, lambda v, i: round(v + case when i > 8 then pow(10.0::double, -0.6) * list_max(list_transform(x, lambda w: abs(w))) * x[i - 8] else 0 end, 6)) as x from wave")
def aug_echo(spark, d):
    return inputs.waves(spark, d).select("vec_id", _ROUND(augment.add_echo(F.col("samples"), F.lit(0.125), F.lit(-12.0), FS)).alias("x"))


@query(_DFT + "select vec_id, f::int as f, t::int as t, round(10 * log10(p + 1e-10) + 5.0::double * f / 8, 4) as v from p")
def aug_alter_distance(spark, d):
    own = _spec(spark, d, "spec_db").select("vec_id", augment.alter_distance(F.col("s"), F.lit(5.0)).alias("s"))
    return own.select("vec_id", F.posexplode("s").alias("f", "row")).select("vec_id", "f", F.posexplode("row").alias("t", "v")).withColumn("v", F.round("v", 4))


@query()
def aug_noise(spark, d):
    return inputs.waves(spark, d).select("vec_id", augment.gaussian_noise(-20.0, 42)("vec_id", "samples").alias("x"))


_LINE = "with o as (select i, greatest(0, least(63, (i + 3.5) * 64 / 71.0::double - 0.5)) as place from range(0, 64) as u(i)), l as (select i, floor(place)::int as lo, place - floor(place) as w from o)"


@query(_LINE + " select e.vec_id, list(round((1 - w) * x[lo + 1] + w * x[least(lo + 1, 63) + 1], 6) order by i) as x from wave e cross join l group by e.vec_id")
def aug_pitch(spark, d):
    return inputs.waves(spark, d).select("vec_id", _ROUND(augment.shift_pitch(0.9)("samples")).alias("x"))


def _stretched(name: str, along: str, n: int, wide: int, mirror: bool) -> str:
    """SQL of a smear (grown, then cropped) or squish (padded in front, then shrunk) along an axis of ``n`` cells."""
    across = "t" if along == "f" else "f"
    first = 1 if name == "smear_t" else 0
    at = f"(i + 0.5) * {wide} / {n}.0::double - 0.5" if mirror else f"(i + {first} + 0.5) * {n} / {wide}.0::double - 0.5"
    top = (wide if mirror else n) - 1
    source = (lambda c: f"(case when {c} < {wide - n} then {wide - n - 1} - {c} else {c} - {wide - n} end)") if mirror else (lambda c: c)
    low, high = source("lo"), source(f"least(lo + 1, {top})")
    return f"""select '{name}' as op, a.vec_id, i::int as {along}, a.{across}::int as {across}, round((1 - w) * a.p + w * b.p, 6) as v
from (select i, floor(place)::int as lo, place - floor(place) as w from (select i, greatest(0, least({top}, {at})) as place from range(0, {n}) as u(i))) l
join p a on a.{along} = {low} join p b on b.vec_id = a.vec_id and b.{across} = a.{across} and b.{along} = {high}"""


_SMEARS = [("smear_f", "f", 9, 11, False), ("smear_t", "t", 7, 8, False), ("squish_f", "f", 9, 11, True), ("squish_t", "t", 7, 9, True)]


@query(_DFT + " union all by name ".join(_stretched(*x) for x in _SMEARS))
def aug_smear_squish(spark, d):
    kernels = {"smear_f": augment.smear_frequency(2), "smear_t": augment.smear_time(-1), "squish_f": augment.squish_frequency(2), "squish_t": augment.squish_time(2)}
    all_ops = F.array(*[F.struct(F.lit(n).alias("op"), f(F.col("s")).alias("s")) for n, f in kernels.items()])
    own = _spec(spark, d, "spec").select("vec_id", F.explode(all_ops).alias("o")).select("o.op", "vec_id", F.posexplode("o.s").alias("f", "row"))
    return own.select("op", "vec_id", "f", F.posexplode("row").alias("t", "v")).withColumn("v", F.round("v", 6))


@query()
def aug_chain(spark, d):
    """Ramp and echo, each for half of the rows, with drawn values."""
    steps = [(0.5, lambda c, u: augment.ramp_volume(c, u * 12 - 6)), (0.5, lambda c, u: augment.add_echo(c, u * 0.2 + 0.05, F.lit(-15.0), FS))]
    return inputs.waves(spark, d).select("vec_id", _ROUND(augment.chain(F.col("samples"), F.col("vec_id"), 42, steps)).alias("x"))


# ---- scoring ----


def _fixed_model():
    import numpy as np

    from tidegrid.plans.models import LinearModel

    k, i = np.arange(3)[:, None], np.arange(64)[None]
    return LinearModel(((k * 64 + i) % 7 - 3) / 4.0, np.array([0.0, 0.5, -0.5]), ["a", "b", "c"])


@query("""with z as (select vec_id, k as class_idx, list_sum(list_transform(range(0, 64), lambda i: ((k * 64 + i) % 7 - 3) / 4.0::double * x[i + 1])) + (case k when 1 then 0.5 when 2 then -0.5 else 0 end) as z from wave, (select unnest(range(0, 3)) as k) t)
select vec_id, class_idx::int as class_idx, round(1 / (1 + exp(-z)), 6) as score from z""")
def linear_score(spark, d):
    from tidegrid.plans import models

    scored = inputs.waves(spark, d).withColumn("scores", models.scorer(spark, _fixed_model())(F.col("samples")))
    return models.score_rows(scored, ["vec_id"]).withColumn("score", F.round("score", 6))


# ---- streams, drained to a table ----


def drain(spark, stream, name: str, mode: str = "append"):
    """Run a stream over what is there and return its rows.

    Each micro-batch is written to the shared folder, and the rows are read back from there.
    """
    import uuid

    from tidegrid.store import shared_root

    root = f"{shared_root(spark)}/{name}-{uuid.uuid4().hex[:12]}"
    q = stream.writeStream.outputMode(mode).format("parquet").option("checkpointLocation", root + "/state").option("path", root + "/rows").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema(stream.schema).parquet(root + "/rows")


def _event_stream(spark, d):
    """Events as a stream, with a last event far ahead that closes all windows."""
    events = table(spark, d, "events").select(F.col("ts").cast("timestamp").alias("ts"), "user_id", "event_type", "value")
    last = events.agg(F.max("ts").alias("ts")).select((F.col("ts") + F.expr("interval 400 days")).alias("ts"), F.lit(-1).cast("bigint").alias("user_id"), F.lit("end").alias("event_type"), F.lit(0.0).alias("value"))
    import uuid

    from tidegrid.store import shared_root

    folder = f"{shared_root(spark)}/events-{uuid.uuid4().hex[:12]}"
    events.write.parquet(folder)
    source = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1000).parquet(folder)
    return source, last, folder


@query("select strftime(time_bucket(interval '1 day', ts), '%Y-%m-%d %H:%M:%S') as window_start, event_type, count(*) as n, round(sum(value), 4) as total from events group by all")
def stream_tumbling(spark, d):
    """Daily counts per event type over a stream of the events."""
    from tidegrid.streaming import streams

    source, last, folder = _event_stream(spark, d)
    last.write.mode("append").parquet(folder)
    out = drain(spark, streams.tumbling_counts(source, "ts", "1 day", ["event_type"]), "tumbling").filter("event_type <> 'end'")
    return out.select(F.date_format("window_start", "yyyy-MM-dd HH:mm:ss").alias("window_start"), "event_type", "n", F.round("total", 4).alias("total"))


@query("""with g as (select user_id, ts, value, case when ts - lag(ts) over (partition by user_id order by ts) < interval '12 hours' then 0 else 1 end as new from events),
s as (select *, sum(new) over (partition by user_id order by ts rows unbounded preceding) as part from g)
select strftime(min(ts), '%Y-%m-%d %H:%M:%S') as begin, user_id, count(*) as n, max(value) as top from s group by user_id, part""")
def stream_streaks(spark, d):
    """Runs of events of a user that lie less than 12 hours apart, over a stream of the events."""
    from tidegrid.streaming import streams

    source, last, folder = _event_stream(spark, d)
    last.write.mode("append").parquet(folder)
    out = drain(spark, streams.live_streaks(source, "ts", "12 hours", ["user_id"]), "streaks").filter("user_id >= 0")
    return out.select(F.date_format("begin", "yyyy-MM-dd HH:mm:ss").alias("begin"), "user_id", "n", "top")
