"""ANSI SQL for the queries of this subpackage that SQL can express over whole tables."""

SQL = {
    "p4_found": """
with own as (
  select (list_position(labels, list_max(labels)) - 1)::bigint as class_idx
  from prepared where split = 'train' and labels is not null and list_max(labels) > 0),
n as (select class_idx, count(*) as n from own group by class_idx),
t as (select plan_id::bigint as plan_id, class_idx::bigint as class_idx,
        greatest(min_clips::bigint, (round(fraction * 10000)::bigint * sample_size + 9999) // 10000) as wanted from class_targets)
select t.plan_id, t.class_idx from t left join n on n.class_idx = t.class_idx where coalesce(n.n, 0) < t.wanted""",
    "p5_found": """
with recursive named as (
  select nullif(lower(regexp_replace(regexp_extract(audio_path, '([^/\\\\]*)$', 1), '^[\\s\u00a0]+|[\\s\u00a0]+$', '', 'g')), '') as file,
         nullif(lower(regexp_replace(regexp_extract(annot_path, '([^/\\\\]*)$', 1), '^[\\s\u00a0]+|[\\s\u00a0]+$', '', 'g')), '') as annot from selmap),
links as (select distinct file, annot from named where file is not null and annot is not null),
steps as (select distinct a.file as a, b.file as b from links a join links b on a.annot = b.annot),
reach(a, b) as (select a, b from steps union select r.a, s.b from reach r join steps s on r.b = s.a),
groups as (select a as file, min(b) as group_file, count(*) as n from reach group by a)
select file, group_file from groups where n >= 2""",
    "p6_found": """
with s as (select distinct score_id, deployment, round(score * 1000000)::bigint as v from scores where score is not null),
r as (select deployment, v, row_number() over (partition by deployment order by v desc) as rn, count(*) over (partition by deployment) as n from s),
x as (select r.deployment, r.v as cutoff_e6 from r join keep_targets k on k.deployment = r.deployment
      where k.keep_pct is not null and r.rn = (r.n * k.keep_pct + 99) // 100)
select x.deployment, x.cutoff_e6, count(*) as n_kept from x join s on s.deployment = x.deployment and s.v >= x.cutoff_e6 group by x.deployment, x.cutoff_e6""",
}
