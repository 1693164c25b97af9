"""The queries that SQL can express, in SQL (DuckDB)."""

from __future__ import annotations

from tallyproof.llm import clusters, quality

_SPACE = r"[^\x20\x09-\x0D]"


def quality_sql() -> str:
    values = ", ".join(x.replace(" div ", " // ") for x in quality.RULES.values())
    names = ", ".join(f"'{x}'" for x in quality.RULES)
    levels = ", ".join(map(str, quality.LEVELS))
    window, alpha = quality.WINDOW, quality.ALPHA
    return f"""
with docs as (
  select row_number() over () as row_id, doc_id, coalesce('=' || lang, '') as stratum, coalesce("text", '') as body from documents),
split as materialized (
  select row_id, doc_id, stratum, body, regexp_extract_all(body, '{_SPACE}+') as w,
    list_filter(string_split(body, chr(10)), lambda x: regexp_matches(x, '{_SPACE}')) as l from docs),
windows as (
  select row_id, i, array_to_string(w[i:i + {window - 1}], ' ') as k
  from (select row_id, w, unnest(range(1, len(w) - {window - 2})) as i from split where len(w) >= {window})),
places as (
  select row_id, i, lag(i) over (partition by row_id order by i) as before
  from (select row_id, i, count(*) over (partition by row_id, k) as c from windows) where c > 1),
repeated as (select row_id, cast(sum(least({window}, coalesce(i - before, {window}))) as bigint) as n_repeat_words from places group by row_id),
counted as (
  select row_id, doc_id, stratum, cast(len(w) as bigint) as n_words, cast(length(array_to_string(w, '')) as bigint) as word_chars,
    cast(length(regexp_replace(body, '[^#*$%&|<>]+', '', 'g')) as bigint) as n_symbols,
    cast(len(l) - len(list_distinct(l)) as bigint) as n_dup_lines, cast(len(l) as bigint) as n_lines, cast(len(list_distinct(w)) as bigint) as n_distinct,
    cast(length(regexp_replace(body, '[^\\p{{L}}]+', '', 'g')) as bigint) as n_letters,
    cast(length(regexp_replace(body, '[^\\p{{Lu}}]+', '', 'g')) as bigint) as n_capitals, coalesce(n_repeat_words, 0) as n_repeat_words
  from split left join repeated using (row_id)),
measured as materialized (
  select doc_id, stratum, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
    n_words < {quality.LEAST_WORDS} or 100 * n_repeat_words > {quality.MOST_REPEATED} * n_words as base_failed, [{values}] as rules from counted),
known as (select doc_id, min(quality) = 1 as good from labels where quality is not null group by doc_id),
labelled as materialized (
  select stratum, substr(md5(cast(doc_id as varchar)), 1, 1) < '8' as tuning, good, rules from measured join known using (doc_id) where not base_failed),
singles as (
  select stratum, good, unnest(range(1, {len(quality.RULES) + 1})) as rule, unnest(rules) as value from labelled where tuning),
counts as (select stratum, rule, value, count(*) filter (good) as good, count(*) filter (not good) as bad from singles group by all),
below as (
  select stratum, rule, value, sum(good) over w as good, sum(bad) over w as bad, sum(good) over p as n_good, sum(bad) over p as n_bad
  from counts window w as (partition by stratum, rule order by value), p as (partition by stratum, rule)),
cut as (
  select stratum, level, rule, min(value) as value, max(n_bad - bad) as found, max(n_bad) as n_bad
  from below, (select unnest([{levels}]) as level) where n_good > 0 and good >= n_good - (n_good * level) // 1000 group by all),
cutoffs as materialized (
  select stratum, level, list(if(found > 0 and 1000 * found >= {quality.USEFUL} * n_bad, value, 1000) order by rule) as cutoffs from cut group by all),
tried as (
  select stratum, level, count(*) as n, count(*) filter (len(list_filter(list_zip(rules, cutoffs), lambda x: x[1] > x[2])) > 0) as k
  from labelled join cutoffs using (stratum) where good and not tuning group by all),
terms as (
  select stratum, level, n, k, unnest(range(0, k + 1)) as j from tried),
bounds as (
  select stratum, level, if(any_value(k) >= any_value(n) * {alpha}, 1.0,
    sum(exp(lgamma(n + 1) - lgamma(j + 1) - lgamma(n - j + 1) + j * ln({alpha}) + (n - j) * ln(1 - {alpha})))) as bound from terms group by all),
passed as (
  select stratum, level, cutoffs, bool_and(coalesce(bound, 1.0) <= {quality.DELTA} / (select count(distinct stratum) from cutoffs)) over (partition by stratum order by level) as admitted
  from cutoffs left join bounds using (stratum, level)),
chosen as (select stratum, arg_max(cutoffs, level) as cutoffs from passed where admitted group by stratum),
judged as (
  select m.*, if(c.cutoffs is null, '', array_to_string(list_transform(list_filter(list_zip(rules, c.cutoffs, [{names}]), lambda x: x[1] > x[2]), lambda x: x[3]), ',')) as rejected_by
  from measured m left join chosen c using (stratum))
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, rejected_by, not base_failed and rejected_by = '' as kept from judged"""


def clusters_sql() -> str:
    rounds = []
    for i in range(clusters.ROUNDS + 1):
        rounds.append(f"""
a{i} as materialized (
  select row_id, min(struct_pack(d := d, c := c)) as best from (
    select row_id, c, cast(list_sum(list_transform(list_zip(x.v, m.v), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) as bigint) as d from rows_ x, m{i} m) group by row_id)""")
        if i < clusters.ROUNDS:
            rounds.append(f"""
m{i + 1} as materialized (
  select m.c, coalesce(n.v, m.v) as v from m{i} m left join (
    select c, list(cast((s - ((s % n) + n) % n) // n as bigint) order by place) as v from (
      select best.c as c, place, sum(component) as s, count(*) as n from a{i} join parts using (row_id) group by all) group by c) n using (c))""")
    last = clusters.ROUNDS
    return f"""
with rows_ as materialized (
  select row_number() over () as row_id, vec_id, list_transform(embedding, lambda x: cast(floor({clusters.SCALE} * cast(x as double)) as bigint)) as v
  from embeddings where len(embedding) = {clusters.DIMENSIONS} and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
parts as materialized (select row_id, unnest(range(1, {clusters.DIMENSIONS + 1})) as place, unnest(v) as component from rows_),
m0 as materialized (
  select row_number() over (order by h, v) - 1 as c, v from (select sha256('{clusters.SEED}:' || cast(vec_id as varchar)) as h, v from rows_) order by h, v limit {clusters.CELLS}),
{",".join(rounds)},
found as (select vec_id, cast(best.c as integer) as cluster, best.d as distance from a{last} join rows_ using (row_id))
select vec_id, cluster, distance, cast(sum(distance) over (partition by cluster) as bigint) as cluster_inertia, cast(sum(distance) over () as bigint) as inertia,
  sha256(array_to_string(v, ',')) as centroid_sha256 from found join m{last} on found.cluster = m{last}.c"""
