"""Registered queries over the driver's tables, each with equivalent SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gleaner.functions import coerce, paths
from gleaner.functions.vectors import euclidean
from gleaner.operators import normalize, segments as cut, selection, similarity
from gleaner.operators.graph import connected_components
from gleaner.plans import reports  # noqa: F401  its queries are registered too
from gleaner.plans import tables as t
from gleaner.plans.registered import ORACLE_SQL, QUERIES, query
from gleaner.sources.tables import table

DIM = 64


#: Ways in which a number may be written as text; by event_id % 8.
_ODD_NUMBER = "case event_id % 8 when 0 then cast(value as {s}) when 1 then ' 1.5 ' when 2 then 'nan' when 3 then '1_000' when 4 then '1.5d' when 5 then 'true' when 6 then '' else '-2e2' end"


@query("select event_id, round(case event_id % 8 when 0 then value when 1 then 1.5 when 3 then 1000 when 7 then -200 else -1 end, 6) number, cast(case event_id % 8 when 0 then trunc(value) when 1 then 1 when 3 then 1000 when 7 then -200 else 7 end as bigint) \"integer\" from events")
def q_coerce_number(spark, root: str) -> DataFrame:
    raw = table(spark, root, "events").select("event_id", F.expr(_ODD_NUMBER.format(s="string")).alias("raw"))
    return raw.select("event_id", F.round(coerce.to_number(F.col("raw"), -1), 6).alias("number"), coerce.to_integer(F.col("raw"), 7).alias("integer"))


_ODD_BOOLEAN = "case event_id % 6 when 0 then ' Kept ' when 1 then 'DROP' when 2 then '2' when 3 then 'maybe' when 4 then cast(null as string) else 'no' end"


@query("select event_id, event_id % 6 = 0 is_true, event_id % 6 not in (1, 5) is_not_false from events")
def q_coerce_bool(spark, root: str) -> DataFrame:
    """Text by word: what is no word of either kind gives the fallback, here first false and then true."""
    raw = table(spark, root, "events").select("event_id", F.expr(_ODD_BOOLEAN).alias("raw"))
    return raw.select("event_id", coerce.to_boolean(F.col("raw"), False).alias("is_true"), coerce.to_boolean(F.col("raw"), True).alias("is_not_false"))


#: JSON values by event_id % 12, and what they count as: (JSON, number or fallback -1, truth or fallback false, text or default "none").
_JSON = [
    ("true", "1", "true", "'True'"), ("false", "0", "false", "'none'"), ('"true"', "-1", "true", "'true'"), ('"2"', "2", "false", "'2'"),
    ("2", "2", "true", "'2'"), ("0", "0", "false", "'none'"), ('"0"', "0", "false", "'0'"), ("null", "-1", "false", "'none'"),
    ('"nan"', "-1", "false", "'nan'"), ("[]", "-1", "false", "'none'"), ('" 1.5 "', "1.5", "false", "' 1.5 '"), ('{"a":1}', "-1", "false", """'{"a":1}'"""),
]


@query("select event_id, " + ", ".join(f"cast(case event_id % 12 {' '.join(f'when {i} then {row[k]}' for i, row in enumerate(_JSON))} end as {kind}) {name}" for k, name, kind in ((1, "number", "double"), (2, "flag", "boolean"), (3, "words", "varchar"))) + " from events")
def q_coerce_json(spark, root: str) -> DataFrame:
    """The same rules on typed JSON values: the type counts."""
    doc = F.concat(F.lit('{"x":'), F.element_at(F.array(*[F.lit(row[0]) for row in _JSON]), (F.col("event_id") % 12 + 1).cast("int")), F.lit("}"))
    v = F.try_variant_get(F.parse_json(doc), "$.x", "variant")
    return table(spark, root, "events").select("event_id", coerce.json_number(v, -1).alias("number"), coerce.json_boolean(v).alias("flag"), coerce.json_text(v, "none").alias("words"))


@query("select event_id, cast(json_extract(props, '$.k') as double) k from events")
def q_json_attrs(spark, root: str) -> DataFrame:
    v = F.try_parse_json("props")
    return table(spark, root, "events").select("event_id", F.try_variant_get(v, "$.k", "double").alias("k"))


@query(f"with {t.SEG_SQL} select pos, id, upper(verb[1]) || lower(verb[2:]) title, case when keep then 'KEEP' else 'DROP' end status, round(greatest(0.01, \"end\" - \"start\"), 6) duration from seg")
def q_scan_project(spark, root: str) -> DataFrame:
    s = t.segments(spark, root)
    duration = F.round(F.greatest(F.lit(0.01), F.col("end") - F.col("start")), 6)
    return s.select("pos", "id", coerce.title_case(F.col("verb")).alias("title"), F.when(F.col("keep"), "KEEP").otherwise("DROP").alias("status"), duration.alias("duration"))


@query("""with r as (select event_id, value - 20 s, case when event_id % 5 = 0 then null else value - 25 end e, event_id % 150 - 20 p from events)
select event_id, case when event_id % 4 = 0 then format('segment_{:03d}', event_id + 1) else cast(event_id as varchar) end id,
  round(greatest(0, s), 6) "start", round(greatest(greatest(0, s), coalesce(e, greatest(0, s))), 6) "end",
  cast(least(100, greatest(0, p)) as double) distinctiveness_percentile, event_id % 3 = 0 keep from r""")
def q_segment_normalize(spark, root: str) -> DataFrame:
    """Segments whose fields are missing or out of bounds, through an artifact's JSON."""
    e = table(spark, root, "events")
    doc = F.to_json(
        F.struct(
            F.array(
                F.struct(
                    F.when(F.col("event_id") % 4 != 0, F.col("event_id").cast("string")).otherwise("").alias("id"),
                    (F.col("value") - 20).alias("start"),
                    F.when(F.col("event_id") % 5 != 0, F.col("value") - 25).alias("end"),
                    (F.col("event_id") % 150 - 20).alias("distinctiveness_percentile"),
                    F.when(F.col("event_id") % 3 == 0, " Kept ").otherwise("drop").alias("keep"),
                )
            ).alias("segments")
        )
    )
    segs = normalize.segments(e.select(F.parse_json(doc).alias("doc"), "event_id"), "event_id")
    # One artifact a row: the place in each is 0, so the id of event n is that of place n.
    named = F.when(F.col("event_id") % 4 == 0, F.format_string("segment_%03d", F.col("event_id") + 1)).otherwise(F.col("id"))
    return segs.select("event_id", named.alias("id"), F.round("start", 6).alias("start"), F.round("end", 6).alias("end"), "distinctiveness_percentile", "keep")


@query(f"with {t.SEG_SQL}, o as (select count(distinct episode_id) total_videos, count(*) total_segments, sum(\"end\" - \"start\") / 3600 oh, coalesce(sum(\"end\" - \"start\") filter (where keep), 0) / 3600 sh from seg) select total_videos, total_segments, round(oh, 6) original_hours, round(sh, 6) selected_hours, round((1 - sh / oh) * 100, 6) data_reduction_percent from o")
def q_overview(spark, root: str) -> DataFrame:
    empty = spark.range(1).select(F.parse_json(F.lit("{}")).alias("doc"))
    s = normalize.summary(empty, t.segments(spark, root))
    rounded = [F.round(c, 6).alias(c) for c in ("original_hours", "selected_hours", "data_reduction_percent")]
    return s.select("total_videos", "total_segments", *rounded)


@query(f"with {t.SEG_SQL}, c as (select verb, cast(count(*) as double) before, cast(count(*) filter (where keep) as double) after from seg group by verb) select verb, before, after, round(before / sum(before) over () * 100, 6) before_share, round(after / coalesce(nullif(sum(after) over (), 0), 1) * 100, 6) after_share, cast(coalesce(list_position(['view', 'click', 'purchase'], verb), 9) as int) place from c")
def q_actions_share(spark, root: str) -> DataFrame:
    """Composition by verb; verbs are a small vocabulary, so the totals' window holds a few rows."""
    every = Window.partitionBy()
    place = F.array_position(F.array(*map(F.lit, ("view", "click", "purchase"))), F.col("verb")).cast("int")
    share = lambda c: F.round(F.col(c) / F.coalesce(F.nullif(F.sum(c).over(every), F.lit(0.0)), F.lit(1.0)) * 100, 6)
    out = normalize.composition(t.segments(spark, root))
    out = out.select("*", share("before").alias("before_share"), share("after").alias("after_share"), F.when(place == 0, 9).otherwise(place).alias("place"))
    return out.orderBy("place", "verb")


@query(f"with {t.SEG_SQL} select pos, id, verb, pct from seg where contains(lower(concat_ws(' ', id, episode_id, verb, \"cluster\")), 'style-3') and verb in ('click', 'view') and pct between 20 and 80 and keep")
def q_explorer_filter(spark, root: str) -> DataFrame:
    from gleaner.plans.views import explore

    found = explore(t.segments(spark, root), search=" STYLE-3 ", verbs=["click", "view"], percentile=(20, 80), status="Keep")
    return found.select("pos", "id", "verb", F.col("distinctiveness_percentile").alias("pct"))


@query(f"with {t.CURVE_SQL}, h as (select event_id, event_id % 400 / 10.0::double - 2 h from events), k as (select x, y, lead(x) over (order by x) x1, lead(y) over (order by x) y1 from curve), e as (select min(x) lo, arg_min(y, x) f, arg_max(y, x) l from curve) select event_id, round(h, 6) h, round(coalesce(y + (y1 - y) * (h - x) / (x1 - x), case when h <= lo then f else l end), 6) y from h cross join e left join k on h > x and h <= x1")
def q_interpolate(spark, root: str) -> DataFrame:
    at = table(spark, root, "events").select("event_id", (F.col("event_id") % 400 / F.lit(10.0) - 2).alias("h"))
    got = cut.interpolated(at, t.curve(spark, root), "x", "y", "h")
    return got.select("event_id", F.round("h", 6).alias("h"), F.round("y", 6).alias("y"))


@query(f"with {t.SEG_SQL} select id, episode_id, round(greatest(0.01, \"end\" - \"start\"), 6) duration, case when keep then 0.48 else 0.34 end::double width, \"end\" - \"start\" >= 2.4 labelled, row_number() over (partition by episode_id, verb order by \"start\", pos) = 1 legend from seg")
def q_timeline(spark, root: str) -> DataFrame:
    from gleaner.plans.views import timeline

    return timeline(t.segments(spark, root)).select("id", "episode_id", F.round("duration", 6).alias("duration"), "width", "labelled", "legend")


@query(f"with {t.SEG_SQL} select episode_id, count(*) filter (where keep) kept, count(*) total from seg group by episode_id")
def q_kept_per_episode(spark, root: str) -> DataFrame:
    return t.segments(spark, root).groupBy("episode_id").agg(F.count_if("keep").alias("kept"), F.count("*").alias("total"))


_AVAILABLE = "where not is_deleted and trim(zarr_processed_path) <> ''"
_CHOICES = "select episode_hash episode_id, task, lab, coalesce(scene, 'unknown') scene, coalesce(nullif(\"operator\", ''), demonstrator) demonstrator, zarr_processed_path from reg"


@query(f"with {t.REG_SQL} {_CHOICES} {_AVAILABLE}")
def q_available(spark, root: str) -> DataFrame:
    return selection.choices(selection.available(t.registry(spark, root)), "*")


@query(f"with {t.REG_SQL} {_CHOICES} {_AVAILABLE} and task = 'BUILDING' order by md5(episode_hash || '#42'), episode_hash limit 50")
def q_sample_hash(spark, root: str) -> DataFrame:
    return selection.sampled(selection.choices(selection.available(t.registry(spark, root)), "BUILDING"), "episode_id", 50, 42)



def _sampled_sql(most: int = 600) -> str:
    """The places that the seeded generator picks depend on the number of candidates; the SQL lists them up to ``most``."""
    import random

    picked = ", ".join(f"({n}, {random.Random(42).sample(range(n), min(10, n))})" for n in range(1, most))
    return f"with {t.REG_SQL}, c as ({_CHOICES} {_AVAILABLE} and task = 'BUILDING'), r as (select *, row_number() over (order by episode_id) - 1 i, count(*) over () n from c), p as (select * from (values {picked}) v(n, places)) select episode_id, task from r join p on p.n = r.n where list_contains(places, i)"


@query(_sampled_sql())
def q_sample_exact(spark, root: str) -> DataFrame:
    return selection.sampled_exactly(selection.choices(selection.available(t.registry(spark, root)), "BUILDING"), "episode_id", 10, 42).select("episode_id", "task")


@query("select count(*) n, sum(c_custkey)::bigint keys from customer where exists (select 1 from orders where o_custkey = c_custkey and o_orderstatus = 'F')")
def q_semi(spark, root: str) -> DataFrame:
    o = table(spark, root, "orders").where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("c_custkey"))
    return table(spark, root, "customer").join(o, "c_custkey", "left_semi").agg(F.count("*").alias("n"), F.sum("c_custkey").alias("keys"))


@query("select c_custkey, c_mktsegment from customer where not exists (select 1 from orders where o_custkey = c_custkey and o_totalprice > 200000)")
def q_anti(spark, root: str) -> DataFrame:
    o = table(spark, root, "orders").where("o_totalprice > 200000").select(F.col("o_custkey").alias("c_custkey"))
    return table(spark, root, "customer").join(o, "c_custkey", "left_anti").select("c_custkey", "c_mktsegment")


@query("with a as (select distinct o_custkey k from orders), b as (select c_custkey k from customer) select (select count(*) from a where k not in (select k from b)) missing, (select count(*) from b where k not in (select k from a)) unexpected, (select count(*) from a where k not in (select k from b)) = 0 and (select count(*) from b where k not in (select k from a)) = 0 equal")
def q_set_equal(spark, root: str) -> DataFrame:
    a = table(spark, root, "orders").select(F.col("o_custkey").alias("k"))
    return selection.same_set(a, table(spark, root, "customer").select(F.col("c_custkey").alias("k")), "k")


@query(f"with {t.REG_SQL} select task, count(*) total, count(*) filter (where lower(lab) like '%ia%') with_ia, count(*) filter (where trim(zarr_processed_path) <> '') ready from reg group by task")
def q_registry_summary(spark, root: str) -> DataFrame:
    from gleaner.plans.views import registry_summary

    return registry_summary(t.registry(spark, root), "ia")


@query(f"with {t.REG_SQL} select array_to_string(list_sort(list(distinct task))[1:20], ', ') tasks from reg")
def q_tasks_preview(spark, root: str) -> DataFrame:
    listed = F.array_join(F.slice(F.array_sort(F.collect_set("task")), 1, 20), ", ")
    return t.registry(spark, root).agg(F.coalesce(F.nullif(listed, F.lit("")), F.lit("none")).alias("tasks"))


@query("with f as (select regexp_extract(split_part(url, '/', -1), '[^.](\\.[^.]+)$', 1) x, length(html) n from pages) select case when x = '' then '<no extension>' else x end extension, count(*) files, sum(n)::bigint bytes from f group by 1")
def q_ext_histogram(spark, root: str) -> DataFrame:
    f = t.files(spark, root)
    return f.groupBy(paths.extension(F.col("path")).alias("extension")).agg(F.count("*").alias("files"), F.sum("length").alias("bytes")).orderBy(F.desc("files"), "extension")


@query("with f as (select regexp_extract(url, '^[a-z]+://([^/]+)', 1) root, length(html) n from pages) select root, count(*) files, sum(n)::bigint bytes from f group by rollup(root)")
def q_root_rollup(spark, root: str) -> DataFrame:
    f = t.files(spark, root).withColumn("root", F.regexp_extract("path", "^[a-z]+://([^/]+)", 1))
    return f.rollup("root").agg(F.count("*").alias("files"), F.sum("length").alias("bytes"))


@query("select url path, length(html)::bigint length from pages p where not exists (select 1 from pages q where q.page_id % 3 <> 0 and q.url = p.url and length(q.html) + (q.page_id % 5 = 0)::int = length(p.html))")
def q_incremental_copy(spark, root: str) -> DataFrame:
    f = t.files(spark, root)
    local = f.where("page_id % 3 <> 0").select("path", (F.col("length") + F.when(F.col("page_id") % 5 == 0, 1).otherwise(0)).alias("length"))
    return selection.to_copy(f.select("path", "length"), local)


@query("with w as (select doc_id, n_chars n, unnest(range(0, n_chars, 60)) s from documents where n_chars > 0) select cast(doc_id as varchar) episode, format('{:06d}.mp4', s // 60) file, cast(s as int) start_frame, cast(least(s + 60, n) as int) end_frame_exclusive, round(s / 30.0::double, 6) start_seconds, round((least(s + 60, n) - s) / 30.0::double, 6) duration_seconds from w")
def q_frame_windows(spark, root: str) -> DataFrame:
    e = table(spark, root, "documents").select(F.col("doc_id").cast("string").alias("episode"), F.lit(30.0).alias("fps"), F.col("n_chars").alias("total_frames"))
    w = cut.frame_windows(e, 2.0)
    return w.select("episode", "file", "start_frame", "end_frame_exclusive", F.round("start_seconds", 6).alias("start_seconds"), F.round("duration_seconds", 6).alias("duration_seconds"))


@query(f"with {t.SEG_SQL}, l as (select *, case when verb = lag(verb) over w then 0 else 1 end n from seg window w as (partition by episode_id order by \"start\", pos)), i as (select *, sum(n) over (partition by episode_id order by \"start\", pos) island from l) select episode_id, cast(island as bigint) island, min(verb) verb, round(min(\"start\"), 6) \"start\", round(max(\"end\"), 6) \"end\", count(*) n_segments from i group by episode_id, island having max(\"end\") - min(\"start\") >= 0.5")
def q_islands(spark, root: str) -> DataFrame:
    c = cut.islands(t.segments(spark, root))
    return c.select("episode_id", "island", "verb", F.round("start", 6).alias("start"), F.round("end", 6).alias("end"), "n_segments")


@query("select time_bucket(interval '1 hour', ts) window_start, event_type, count(*) n, round(sum(value), 6) total from events group by 1, 2")
def q_tumbling(spark, root: str) -> DataFrame:
    e = table(spark, root, "events")
    g = e.groupBy(F.window("ts", "1 hour").alias("w"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 6).alias("total"))
    return g.select(F.col("w.start").alias("window_start"), "event_type", "n", "total")


@query("with l as (select *, case when ts < lag(ts) over (partition by user_id order by ts) + interval '30 minutes' then 0 else 1 end n from events), s as (select *, sum(n) over (partition by user_id order by ts) k from l) select user_id, min(ts) session_start, count(*) n, round(sum(value), 6) total from s group by user_id, k")
def q_session_window(spark, root: str) -> DataFrame:
    e = table(spark, root, "events")
    g = e.groupBy("user_id", F.session_window("ts", "30 minutes").alias("w")).agg(F.count("*").alias("n"), F.round(F.sum("value"), 6).alias("total"))
    return g.select("user_id", F.col("w.start").alias("session_start"), "n", "total")


@query(f"with {t.SEG_SQL} select pos, round((\"end\" - lag(\"end\") over w) / nullif(\"start\" - lag(\"start\") over w, 0), 6) velocity, round(avg(\"end\" - \"start\") over (partition by episode_id order by \"start\", pos rows between 2 preceding and 2 following), 6) smooth, round(\"start\" - first(\"start\") over w, 6) since_first from seg window w as (partition by episode_id order by \"start\", pos)")
def q_motion(spark, root: str) -> DataFrame:
    """Speed between neighbours, a centred mean of five, and time since the first segment of the episode."""
    w = Window.partitionBy("episode_id").orderBy("start", "pos")
    s = t.segments(spark, root)
    speed = F.try_divide(F.col("end") - F.lag("end").over(w), F.nullif(F.col("start") - F.lag("start").over(w), F.lit(0.0)))
    smooth = F.avg(F.col("end") - F.col("start")).over(w.rowsBetween(-2, 2))
    return s.select("pos", F.round(speed, 6).alias("velocity"), F.round(smooth, 6).alias("smooth"), F.round(F.col("start") - F.first("start").over(w), 6).alias("since_first"))


@query(f"with {t.SEG_SQL}, p as (select episode_id, \"start\" t, max(\"end\") - \"start\" y from seg group by 1, 2), w as (select episode_id, t, y, lead(t) over (partition by episode_id order by t) t1, lead(y) over (partition by episode_id order by t) y1, min(t) over (partition by episode_id) lo, max(t) over (partition by episode_id) hi from p), g as (select w.*, i, case when i = 29 then hi else lo + i * ((hi - lo) / 29) end x from w, range(30) r(i) where t1 > t) select episode_id, cast(i as int) i, round(y + (y1 - y) * (x - t) / (t1 - t), 6) y from g where (i < 29 and x >= t and x < t1) or (i = 29 and t1 = hi)")
def q_resample30(spark, root: str) -> DataFrame:
    s = t.segments(spark, root).groupBy("episode_id", "start").agg(F.max("end").alias("end"))
    return cut.resampled(s.select("episode_id", "start", (F.col("end") - F.col("start")).alias("y")), "episode_id", "start", "y").select("episode_id", "i", F.round("y", 6).alias("y"))


_TOPK = "c as (select a.id, b.id neighbour, list_inner_product(a.v, b.v) score, row_number() over (partition by a.id order by list_inner_product(a.v, b.v) desc, b.id) nth from {f} a join {f} b on a.id <> b.id where a.id % 50 = 0)"


@query(f"with {t.FEAT_SQL}, {_TOPK.format(f='feat')} select id, cast(nth as int) rank, neighbour, round(score, 6) score from c where nth <= 5")
def q_pairwise_topk(spark, root: str) -> DataFrame:
    """The five most similar vectors of every 50th one, by blocks against all."""
    f = t.features(spark, root)
    return similarity.nearest(f.select("id", "v"), f.where("id % 50 = 0").select("id", "v"), 5).select("id", "rank", "neighbour", F.round("score", 6).alias("score"))


_GROUPS = [(0, 16, 0.45), (16, 16, 0.25), (32, 16, 0.20), (48, 16, 0.10)]
_PARTS = " + ".join(f"{w} * list_cosine_similarity(a.v[{s + 1}:{s + n}], b.v[{s + 1}:{s + n}])" for s, n, w in _GROUPS)


@query(f"with {t.FEAT_SQL}, c as (select a.id, b.id neighbour, {_PARTS} score from feat a join feat b on a.id <> b.id where a.id % 50 = 0), r as (select *, row_number() over (partition by id order by score desc, neighbour) nth from c) select id, cast(nth as int) rank, neighbour, round(score, 6) score from r where nth <= 5")
def q_weighted_similarity(spark, root: str) -> DataFrame:
    f = t.features(spark, root).select("id", similarity.weighted_groups(F.col("v"), _GROUPS).alias("v"))
    return similarity.nearest(f, f.where("id % 50 = 0"), 5).select("id", "rank", "neighbour", F.round("score", 6).alias("score"))


@query(f"with {t.FEAT_SQL}, {_TOPK.format(f='feat')} select id, round(avg(sqrt(greatest(0, 2 - 2 * score))), 6) distance from c where nth <= 5 group by id")
def q_knn_distance(spark, root: str) -> DataFrame:
    f = t.features(spark, root)
    near = similarity.nearest(f.select("id", "v"), f.where("id % 50 = 0").select("id", "v"), 5)
    return near.groupBy("id").agg(F.round(F.avg(F.sqrt(F.greatest(F.lit(0.0), 2 - 2 * F.col("score")))), 6).alias("distance"))


@query("with c as (select event_type, count(*) c from events group by 1) select sum(c)::bigint n, round(exp(-sum(c / s * ln(c / s))), 6) vendi from (select c::double c, sum(c) over () s from c)")
def q_composition_vendi(spark, root: str) -> DataFrame:
    return similarity.entropy_vendi(table(spark, root, "events"), "event_type").select("n", F.round("vendi", 6).alias("vendi"))


_K2 = "k as (select a.grp, a.id, sum(power(list_inner_product(a.v, b.v), 2)) r, max(power(list_inner_product(a.v, a.v), 2)) d from feat a join feat b on a.grp = b.grp group by a.grp, a.id), s as (select grp, count(*) n, sum(r) s from k group by grp)"


@query(f"with {t.FEAT_SQL}, {_K2} select grp, n, round(n * n / s, 5) vendi from s")
def q_execution_vendi2(spark, root: str) -> DataFrame:
    return similarity.vendi_order_two(t.features(spark, root), DIM).select("grp", "n", F.round("vendi", 5).alias("vendi"))


@query(f"with {t.FEAT_SQL}, {_K2} select grp, id, round(n * n / s - case when n > 1 then (n - 1) * (n - 1) / (s - 2 * r + d) else 0 end, 5) contribution from k join s using (grp)")
def q_contribution2(spark, root: str) -> DataFrame:
    return similarity.contributions(t.features(spark, root), DIM).select("grp", "id", F.round("contribution", 5).alias("contribution"))


@query()
def q_vendi_exact(spark, root: str) -> DataFrame:
    return similarity.vendi_exact(t.features(spark, root), DIM)


@query(f"with {t.FEAT_SQL}, m as (select a.grp, a.id, round(sum(list_inner_product(a.v, b.v)), 6) total from feat a join feat b on a.grp = b.grp and a.id <> b.id group by a.grp, a.id) select grp, arg_max(id, total * 1e6 - id / 1e9) id, max(total) total from m group by grp")
def q_medoid(spark, root: str) -> DataFrame:
    return similarity.medoids(t.features(spark, root))


@query("select user_id % 10 \"cluster\", arg_max(event_type, n * 1000 - ascii(event_type)) verb, round(max(n) / sum(n), 6) share from (select user_id % 10 user_id, event_type, count(*) n from events group by 1, 2) group by 1")
def q_cluster_dominant(spark, root: str) -> DataFrame:
    n = table(spark, root, "events").groupBy((F.col("user_id") % 10).alias("cluster"), "event_type").agg(F.count("*").alias("n"))
    g = n.groupBy("cluster").agg(F.max_by("event_type", F.col("n") * 1000 - F.ascii("event_type")).alias("verb"), F.round(F.max("n") / F.sum("n"), 6).alias("share"))
    return g


@query("select event_id, round(percent_rank() over (order by value, event_id) * 100, 6) percentile from events")
def q_percentile(spark, root: str) -> DataFrame:
    return selection.ranked_percent(table(spark, root, "events").select("event_id", "value"), "value", "event_id").select("event_id", F.round("percentile", 6).alias("percentile"))


@query("with u as (select user_id, round(avg(value), 6) score, sum(value) / 3600 as hrs from events group by 1), r as (select *, row_number() over (order by score desc, user_id) rank, sum(hrs) over (order by score desc, user_id) total from u) select user_id, score, cast(rank as int) rank, round(total, 6) total from r where total <= 0.4 * (select sum(hrs) from u)")
def q_budget_greedy(spark, root: str) -> DataFrame:
    """Episodes by mean score while the hours before and with them fit into 40 % of all hours."""
    from gleaner.plans.views import within_budget

    u = table(spark, root, "events").groupBy("user_id").agg(F.round(F.avg("value"), 6).alias("score"), (F.sum("value") / 3600).alias("hours"))
    return within_budget(u, "user_id", "score", "hours", 0.4).select("user_id", "score", "rank", F.round("total", 6).alias("total"))


@query("with w as (select conv_id, turn, lower(split_part(trim(text), ' ', 1)) w from conversations) select conv_id, turn, case when w in ('smoothing', 'smoothen', 'smoothed') then 'smooth' when w in ('grab', 'grabs', 'pick', 'picks') then 'pick' when length(w) > 5 and ends_with(w, 'ing') then w[:length(w) - 3] when length(w) > 4 and ends_with(w, 'ed') then w[:length(w) - 2] else w end verb from w")
def q_lemma_verbs(spark, root: str) -> DataFrame:
    from gleaner.plans.views import canonical_verb

    first = F.lower(F.split_part(F.trim("text"), F.lit(" "), F.lit(1)))
    return table(spark, root, "conversations").select("conv_id", "turn", canonical_verb(first).alias("verb"))


@query()
def q_threshold_components(spark, root: str) -> DataFrame:
    """Single linkage at a similarity of 0.35 over all pairs of vectors."""
    return connected_components(similarity.linked(t.features(spark, root).select("id", "v"), 0.35))


@query()
def q_kmeans(spark, root: str) -> DataFrame:
    from gleaner.operators.clustering import kmeans

    return kmeans(t.features(spark, root), k=8, seed=1).select("id", "cluster")


@query()
def q_pca(spark, root: str) -> DataFrame:
    from gleaner.operators.clustering import principal_components

    return principal_components(t.features(spark, root), 30)


@query("select a.vec_id id, round(list_distance(a.embedding::double[], b.embedding::double[]), 6) distance from embeddings a join (select label, min(vec_id) m from embeddings group by label) f on a.label = f.label join embeddings b on b.vec_id = f.m")
def q_distance_to_first(spark, root: str) -> DataFrame:
    """Euclidean distance to the first vector of each label."""
    e = table(spark, root, "embeddings").select("vec_id", "label", "embedding")
    first = e.groupBy("label").agg(F.min_by("embedding", "vec_id").alias("first"))
    return e.join(first, "label").select(F.col("vec_id").alias("id"), F.round(euclidean(F.col("embedding"), F.col("first")), 6).alias("distance"))
