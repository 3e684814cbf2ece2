"""Queries of selection runs, manifests, reports, budgets, neighbours and movement, each with equivalent SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleaner.functions import paths, pose
from gleaner.operators import ingest, motion, selection, similarity
from gleaner.plans import tables as t
from gleaner.plans import views
from gleaner.plans.registered import query
from gleaner.sources.tables import table

#: Neighbours that every third segment states: a repeated one, two others, one of no segment and one without an id.
_STATED = "[(pos + 7) % n, (pos + 7) % n, (pos + 11) % n, (pos + 1) % n, -1]"
_RULE = """c as (select a.id sid, b.id, greatest(0, case when a.verb = b.verb then 0.95 else 0.79 end - least(0.14, abs(b.pct - a.pct) * 0.002)) similarity,
    case when a.verb = b.verb and a."cluster" <> b."cluster" then 'Same annotation, different execution style' else 'Same action family with a related motion signature' end explanation,
    row_number() over (partition by a.id order by a.verb <> b.verb, a."cluster" = b."cluster", abs(b.pct - a.pct), b.pos) nth
  from asked a join seg b on a.id <> b.id and a.video_id <> b.video_id and not exists (select 1 from stated s where s.sid = a.id and s.id = b.id)),
have as (select sid, count(*) h from stated group by 1),
u as (select sid, id, similarity, explanation, 0 o, place from stated union all
  select c.sid, c.id, similarity, explanation, 1, nth from c left join have on have.sid = c.sid where nth + coalesce(h, 0) <= 5),
r as (select *, row_number() over (partition by sid order by similarity desc, o, place) rank from u)
select sid segment_id, id neighbour_id, round(similarity, 6) similarity, explanation, case o when 0 then 'stated' else 'rule' end source, cast(rank as int) rank from r where rank <= 5"""


def _shown(near: DataFrame) -> DataFrame:
    return near.withColumn("similarity", F.round("similarity", 6))


@query(f"with {t.SEG_SQL}, asked as (select * from seg where pos % 50 = 0), stated as (select '' sid, '' id, 0.0::double similarity, '' explanation, 0 place where false), {_RULE}")
def q_neighbors_rule(spark, root: str) -> DataFrame:
    """Neighbours of every 50th segment by rule, among all."""
    s = t.segments(spark, root)
    return _shown(similarity.similar_segments(s.where("pos % 50 = 0"), s))


@query(f"""with {t.SEG_SQL}, asked as (select * from seg where pos % 50 = 0), k as (select max(pos) + 1 n from seg),
e as (select a.*, unnest({_STATED}) to_id, unnest([0, 1, 2, 3, 4]) place from asked a, k where a.pos % 3 = 0),
stated as (select e.id sid, b.id, case e.place when 0 then 0.1 when 1 then 0.97 when 2 then 1.0 else 0.5 end similarity,
  case when e.place = 2 then 'told' when b.verb = e.verb then 'Same annotation, different execution style' else 'Visually similar motion pattern' end explanation, e.place
  from e join seg b on b.id = cast(e.to_id as varchar) where b.video_id <> e.video_id), {_RULE}""")
def q_neighbors_explicit(spark, root: str) -> DataFrame:
    """The same for segments that state neighbours: repeated ones count twice, those of no other video not at all."""
    s = t.segments(spark, root)
    n = F.lit(s.agg(F.max("pos") + 1).first()[0])
    place = lambda k, similar, told="": F.struct((((F.col("pos") + k) % n)).cast("string").alias("segment_id"), F.lit(float(similar)).alias("similarity"), F.lit(told).alias("explanation"))
    none = F.struct(F.lit("-1").alias("segment_id"), F.lit(0.5).alias("similarity"), F.lit("").alias("explanation"))
    stated = F.array(place(7, 0.1), place(7, 0.97), place(11, 1.0, "told"), place(1, 0.5), none)
    asked = s.where("pos % 50 = 0").withColumn("neighbors", F.when(F.col("pos") % 3 == 0, stated).otherwise(F.col("neighbors")))
    return _shown(similarity.similar_segments(asked, s))


_CHOSEN = f"""{t.REG_SQL}, c as (select episode_hash episode_id, task, lab, coalesce(scene, 'unknown') scene, coalesce(nullif("operator", ''), demonstrator) demonstrator from reg where not is_deleted and trim(zarr_processed_path) <> '' and task = 'BUILDING')"""


@query(f"with {_CHOSEN}, s as (select * from c order by md5(episode_id || '#7'), episode_id limit 20) select 'BUILDING' requested_task, 7 seed, cast(count(*) as int) episode_count, string_agg(episode_id || '|' || lab || '|' || scene || '|' || demonstrator, ',' order by episode_id) episodes from s")
def q_selection_manifest(spark, root: str) -> DataFrame:
    rows = selection.sampled(selection.choices(selection.available(t.registry(spark, root)), "BUILDING"), "episode_id", 20, 7)
    m = selection.manifest(rows, "BUILDING", 7)
    shown = F.transform("episodes", lambda e: F.concat_ws("|", e["episode_id"], e["lab"], e["scene"], e["demonstrator"]))
    return m.select("requested_task", "seed", "episode_count", F.array_join(shown, ",").alias("episodes"))


@query(f"with {_CHOSEN}, s as (select * from c order by md5(episode_id || '#7'), episode_id limit 20), w as (select greatest(max(length(episode_id)), 10) a, greatest(max(length(lab)), 3) b from s), l as (select 0 pos, 'episode_id' x, 'lab' y union all select 1, repeat('-', a), repeat('-', b) from w union all select 1 + row_number() over (order by episode_id), episode_id, lab from s) select cast(pos as int) pos, rpad(x, a::int, ' ') || '  ' || rpad(y, b::int, ' ') line from l, w")
def q_text_table(spark, root: str) -> DataFrame:
    rows = selection.sampled(selection.choices(selection.available(t.registry(spark, root)), "BUILDING"), "episode_id", 20, 7)
    return selection.text_table(rows, "episode_id", "lab")


@query(f"with {t.REG_SQL} select episode_hash episode_id, task, lab from reg where not is_deleted and trim(zarr_processed_path) <> '' and task in ('BUILDING', 'MACHINERY') and lab like '%A%'")
def q_predicate(spark, root: str) -> DataFrame:
    """A caller's own condition, as SQL."""
    rows = selection.choices(selection.available(t.registry(spark, root)), "*", "task in ('BUILDING', 'MACHINERY') and lab like '%A%'")
    return rows.select("episode_id", "task", "lab")


@query("select o_orderkey, o_custkey from orders where o_custkey in (select c_custkey from customer where c_mktsegment = 'BUILDING')")
def q_id_set(spark, root: str) -> DataFrame:
    ids = table(spark, root, "customer").where("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("o_custkey"))
    return selection.of_ids(table(spark, root, "orders"), ids, "o_custkey").select("o_orderkey", "o_custkey")


@query(f"with {t.REG_SQL} select lab as value, count(*) n from reg where coalesce(\"operator\", '') = '' and lab is not null group by 1")
def q_embodiments(spark, root: str) -> DataFrame:
    """Episodes by lab of those whose operator is blank, the most frequent first."""
    return views.counted(t.registry(spark, root).where(views.equals("operator", "")), "lab")


@query(f"with {t.CURVE_SQL}, k0 as (select y x, least(100, x * 3) d, least(100, x * 2) r from curve), k as (select x, min(d) d, min(r) r from k0 group by 1), i as (select x, d, r, lead(x) over (order by x) x1, lead(d) over (order by x) d1, lead(r) over (order by x) r1 from k), e as (select min(x) lo, arg_min(d, x) d0, arg_min(r, x) r0, arg_max(d, x) dn, arg_max(r, x) rn, max(x) oh from k), b as (select event_id, event_id % 500 / 10.0::double h from events), v as (select event_id, h, oh, coalesce(d + (d1 - d) * (h - x) / (x1 - x), case when h <= lo then d0 else dn end) dv, coalesce(r + (r1 - r) * (h - x) / (x1 - x), case when h <= lo then r0 else rn end) rv from b cross join e left join i on h > x and h <= x1) select event_id, round(h, 6) as hours, round(dv, 6) diversity_coverage, round(rv, 6) random_coverage, round(greatest(0, dv - rv), 6) lift, round(least(100, h / greatest(oh, 0.1) * 100), 6) retained_percent, round((1 - h / oh) * 100, 6) reduction from v")
def q_budget_comparison(spark, root: str) -> DataFrame:
    """What budgets of some hours cover, by choice and at random."""
    c = t.curve(spark, root)
    curve = c.groupBy(F.col("y").alias("retained_hours")).agg(F.min(F.least(F.lit(100.0), F.col("x") * 3)).alias("diversity_coverage"), F.min(F.least(F.lit(100.0), F.col("x") * 2)).alias("random_coverage"))
    original = c.agg(F.max("y")).first()[0]
    budgets = table(spark, root, "events").select("event_id", (F.col("event_id") % 500 / F.lit(10.0)).alias("hours"))
    out = views.budget_comparison(budgets, curve, original)
    return out.select("event_id", *[F.round(x, 6).alias(x) for x in ("hours", "diversity_coverage", "random_coverage", "lift", "retained_percent", "reduction")])


@query(f"with {t.CURVE_SQL} select round(greatest(max(y), 3.5), 6) as hours from curve")
def q_largest_budget(spark, root: str) -> DataFrame:
    return views.largest_budget(t.curve(spark, root).select(F.col("y").alias("retained_hours")), 3.5).select(F.round("hours", 6).alias("hours"))


@query(f"with {t.SEG_SQL}, o as (select count(distinct episode_id) v, count(*) n, sum(\"end\" - \"start\") / 3600 oh, coalesce(sum(\"end\" - \"start\") filter (where keep), 0) / 3600 sh from seg) select format('{{:,}}', v) total_videos, format('{{:,}}', n) total_segments, format('{{:.1f}}h', oh) original_hours, format('{{:.1f}}h', least(greatest(sh, 0), greatest(oh, 0.1))) selected_hours, format('{{:.0f}}%', greatest(0, (1 - sh / oh) * 100)) data_reduction, '87%' behavioral_coverage from o")
def q_kpis(spark, root: str) -> DataFrame:
    """The overview's figures as they are shown."""
    from gleaner.operators import normalize

    empty = spark.range(1).select(F.parse_json(F.lit("{}")).alias("doc"))
    s = views.initial_budget(normalize.summary(empty, t.segments(spark, root))).withColumn("coverage", F.lit(87.25))
    return views.cards(s).select("total_videos", "total_segments", "original_hours", "selected_hours", "data_reduction", "behavioral_coverage")


_CLIP = "case page_id % 4 when 0 then url when 1 then 'clips/' || page_id || '.mp4' when 2 then 'other/' || page_id || '.mp4' else '' end"


@query(f"select page_id, case when page_id % 4 = 0 and (url like 'http://%' or url like 'https://%') then 'remote' when page_id % 4 = 1 and page_id % 8 = 1 then 'file' else 'placeholder' end clip_kind, case when page_id % 4 = 0 and (url like 'http://%' or url like 'https://%') then null when page_id % 8 = 1 then null when page_id % 4 = 3 then 'No clip_path supplied' else split_part({_CLIP}, '/', -1) end clip_label from pages")
def q_clip_kind(spark, root: str) -> DataFrame:
    p = table(spark, root, "pages").select("page_id", F.expr(_CLIP.replace("'clips/' || page_id", "'clips/' || cast(page_id as string)").replace("'other/' || page_id", "'other/' || cast(page_id as string)")).alias("clip_path"))
    return views.clips(p, p.where("page_id % 8 = 1").select(F.col("clip_path").alias("path"))).select("page_id", "clip_kind", "clip_label")


@query(f"with {t.SEG_SQL}, f as (select * from seg where verb = 'click' and keep) select * from (select 'kept' asked, id from seg where id = '17' union all (select 'first', id from f order by pos limit 1))")
def q_selected_default(spark, root: str) -> DataFrame:
    """A selection that the filter has hidden stays; one that names nothing gives the first found."""
    s = t.segments(spark, root)
    found = s.where("verb = 'click' and keep")
    one = lambda name, wanted: views.selected_row(found, s, wanted).select(F.lit(name).alias("asked"), "id")
    return one("kept", "17").unionByName(one("first", "no such id"))


@query(f"with {t.SEG_SQL}, r as (select id, pct, row_number() over (order by pct desc, id) a, row_number() over (order by pct, id) b from seg) select id, round(pct, 6) pct, 'top' side, cast(a as int) place from r where a <= 5 union all select id, round(pct, 6), 'bottom', cast(b as int) from r where b <= 5")
def q_strip(spark, root: str) -> DataFrame:
    """The five segments at either end."""
    out = views.strip(t.segments(spark, root), "distinctiveness_percentile", "id")
    return out.select("id", F.round("distinctiveness_percentile", 6).alias("pct"), "side", "place")


@query("with u as (select user_id, sum(value) / 3600 h, min(event_type) k from events group by 1), m as (select *, row_number() over (order by md5(user_id || '#42'), user_id) place, row_number() over (partition by k order by md5(user_id || '#42'), user_id) = 1 new from u) select place, round(sum(h) over (order by place), 6) retained_hours, round(sum(new::int) over (order by place) / (select count(distinct k) from u) * 100, 6) coverage from m")
def q_random_curve(spark, root: str) -> DataFrame:
    u = table(spark, root, "events").groupBy("user_id").agg((F.sum("value") / 3600).alias("hours"), F.min("event_type").alias("kind"))
    out = views.random_curve(u, "user_id", "hours", "kind", 42)
    return out.select("place", F.round("retained_hours", 6).alias("retained_hours"), F.round("coverage", 6).alias("coverage"))


@query("with e as (select cast(user_id as varchar) episode_id, count(*) n, sum(value) total, round(avg(value), 9) mean from events group by 1) select episode_id, n, round(total, 6) total, round(mean, 6) mean, row_number() over (order by mean desc, episode_id) rank from e")
def q_episode_rank(spark, root: str) -> DataFrame:
    rows = table(spark, root, "events").select(F.col("user_id").cast("string").alias("episode_id"), F.col("value").alias("contribution"))
    return views.episode_rank(rows).select("episode_id", "n", F.round("total", 6).alias("total"), F.round("mean", 6).alias("mean"), "rank")


@query(f"with {t.SEG_SQL} select episode_id, string_agg(id, ',' order by \"start\", pos) segments from seg group by 1")
def q_nested_episodes(spark, root: str) -> DataFrame:
    nested = views.episodes_nested(t.segments(spark, root))
    return nested.select("episode_id", F.array_join(F.transform("segments", lambda e: e["id"]), ",").alias("segments"))


_FILES = "f as (select 'raw/h' || (page_id % 37) || '.zarr/' || case when page_id % 5 = 0 then 'zarr.json' when page_id % 7 = 0 then 'sub/' else 'images/c/' || page_id || case page_id % 3 when 0 then '.jpg' when 1 then '.tar.gz' else '' end end path, length(html)::bigint length, page_id from pages)"


def _files(spark, root: str) -> DataFrame:
    n = F.col("page_id").cast("string")
    rest = F.concat(F.lit("images/c/"), n, F.when(F.col("page_id") % 3 == 0, ".jpg").when(F.col("page_id") % 3 == 1, ".tar.gz").otherwise(""))
    inner = F.when(F.col("page_id") % 5 == 0, "zarr.json").when(F.col("page_id") % 7 == 0, "sub/").otherwise(rest)
    path = F.concat(F.lit("raw/h"), (F.col("page_id") % 37).cast("string"), F.lit(".zarr/"), inner)
    return table(spark, root, "pages").select(path.alias("path"), F.length("html").cast("long").alias("length"), "page_id")


@query(f"with {_FILES} select distinct root from (select regexp_extract(path, '^raw/([^/]+)', 1) root, path from f) order by root limit 12")
def q_first_roots(spark, root: str) -> DataFrame:
    return ingest.first_roots(_files(spark, root), 12, "raw/")


@query(f"with {_FILES}, r as (select regexp_extract(path, '^raw/([^/]+)', 1) root, path, length from f), k as (select distinct root from r order by root limit 12), g as (select * from r where root in (select root from k) and not ends_with(path, '/')), e as (select root episode, count(*) files, sum(length)::bigint bytes, bool_or(ends_with(path, '/zarr.json')) complete from g group by 1) select * from e union all select null, sum(files)::bigint, sum(bytes)::bigint, bool_and(complete) from e")
def q_ingestion_report(spark, root: str) -> DataFrame:
    return ingest.ingestion_report(_files(spark, root), 12, "raw/")


@query(f"with {_FILES}, g as (select * from f where not ends_with(path, '/')), x as (select case when ends_with(path, '.jpg') then '.jpg' when ends_with(path, '.gz') then '.gz' when ends_with(path, '.json') then '.json' else '<no extension>' end extension, count(*) n from g group by 1) select (select count(distinct regexp_extract(path, '^raw/([^/]+)', 1)) from g where ends_with(path, '/zarr.json')) episode_count, (select count(*) from g) file_count, (select sum(length)::bigint from g) total_bytes, (select round_even(sum(length) / 1073741824.0::double, 3) from g) total_gib, (select string_agg(extension || ':' || n, ',' order by n desc, extension) from x) extensions, (select array_to_string(list(e order by e)[1:10], ',') from (select distinct regexp_extract(path, '^raw/([^/]+)', 1) e from g where ends_with(path, '/zarr.json'))) sample_episodes")
def q_inspection(spark, root: str) -> DataFrame:
    one = ingest.inspection(_files(spark, root), "raw/")
    kinds = F.array_join(F.transform("extensions", lambda e: F.concat_ws(":", e["extension"], e["files"].cast("string"))), ",")
    return one.select("episode_count", "file_count", "total_bytes", "total_gib", kinds.alias("extensions"), F.array_join("sample_episodes", ",").alias("sample_episodes"))


@query(f"with {_FILES} select distinct regexp_extract(path, '^raw/([^/]+)/zarr.json$', 1) episode from f where ends_with(path, '/zarr.json')")
def q_episode_folders(spark, root: str) -> DataFrame:
    return ingest.episode_folders(_files(spark, root), "raw/")


@query(f"with {_FILES} select path, length from f where not ends_with(path, '/') and not contains(path, 'images') and length > 100")
def q_sync(spark, root: str) -> DataFrame:
    """What a bulk sync copies: no images, no markers of folders, and only what the caller's condition keeps."""
    return ingest.synced(_files(spark, root), F.col("length") > 100).select("path", "length")


@query(f"with {_FILES} select path, cast(row_number() over (partition by regexp_extract(path, '^(raw/[^/]+)', 1) order by string_split(path, '/'), page_id) as int) place from f")
def q_ranked_paths(spark, root: str) -> DataFrame:
    return ingest.ranked_paths(_files(spark, root)).select("path", "place")


@query("select page_id, regexp_replace(regexp_replace('//' || regexp_replace(url, '^[a-z]+://', '') || '/', '^/+', ''), '/+$', '') trimmed, lower(hex(encode(html[1:8]))) preview from pages")
def q_trim_and_preview(spark, root: str) -> DataFrame:
    p = table(spark, root, "pages")
    bare = F.concat(F.lit("//"), F.regexp_replace("url", "^[a-z]+://", ""), F.lit("/"))
    return p.select("page_id", paths.trimmed(bare).alias("trimmed"), F.lower(F.hex(F.encode(F.substring("html", 1, 8), "UTF-8"))).alias("preview"))


@query("select cast(doc_id as varchar) episode, 'images.front_1' camera_key, 60 frames_per_segment, cast(ceil(n_chars / 60.0) as int) segment_count, array_to_string(list_transform(range(0, ceil(n_chars / 60.0)::bigint), lambda i: format('{:06d}.mp4', i) || '@' || (i * 60) || '-' || least((i + 1) * 60, n_chars)), ',') segments from documents")
def q_segmentation_manifest(spark, root: str) -> DataFrame:
    e = table(spark, root, "documents").select(F.col("doc_id").cast("string").alias("episode"), F.lit(30.0).alias("fps"), F.col("n_chars").alias("total_frames"))
    m = ingest.segmentation_manifest(e, 2.0)
    shown = F.transform("segments", lambda p: F.concat(p["file"], F.lit("@"), p["start_frame"].cast("string"), F.lit("-"), p["end_frame_exclusive"].cast("string")))
    return m.select("episode", "camera_key", "frames_per_segment", "segment_count", F.array_join(shown, ",").alias("segments"))


@query("""with e as (select doc_id, cast(ceil(n_chars / 60.0) as int) n from documents)
select cast(doc_id as varchar) episode, n segment_count, case when doc_id % 7 in (1, 2, 3, 4) then 'created' when doc_id % 7 = 5 and n > 0 then 'created' when doc_id % 7 = 6 and n > 0 then 'created' else 'already_complete' end status from e""")
def q_resume_check(spark, root: str) -> DataFrame:
    """Whether a recording need be cut again. By doc_id % 7: 0 is as wanted; 1 has no manifest; 2 to 4 have another camera,
    other seconds, another count in it; 5 lacks its first clip, and 6 has it empty. Each has a clip too many and clips of another episode."""
    d = table(spark, root, "documents")
    e = d.select(F.col("doc_id").cast("string").alias("episode"), F.lit(30.0).alias("fps"), F.col("n_chars").alias("total_frames"))
    wanted = ingest.segmentation_manifest(e, 2.0)
    kind = F.col("episode").cast("long") % 7
    before = wanted.where(kind != 1).select("episode", F.when(kind == 4, F.col("segment_count") + 1).otherwise(F.col("segment_count")).alias("segment_count"), F.when(kind == 2, "images.other").otherwise(F.col("camera_key")).alias("camera_key"), F.when(kind == 3, 1.0).otherwise(2.0).alias("requested_segment_seconds"), "fps")
    clips = wanted.select("episode", F.posexplode(F.concat(F.col("segments.file"), F.array(F.lit("surplus.mp4")))).alias("i", "file"))
    there = clips.where((kind != 5) | (F.col("i") > 0)).select("episode", "file", F.when((kind == 6) & (F.col("i") == 0), 0).otherwise(9).cast("long").alias("length"))
    there = there.unionByName(there.select(F.concat(F.lit("x"), "episode").alias("episode"), "file", "length"))
    return ingest.resume_state(wanted, before, there)


_TRACK = "tr as (select cast(user_id as varchar) episode_id, cast(floor(date_diff('microsecond', timestamp '2024-01-01', ts) / 1e6 * 30) as bigint) frame, event_id % 4 <> 0 valid from events)"


@query(f"with {t.SEG_SQL}, {_TRACK}, m as (select s.id, avg(valid::int) f from seg s join tr on tr.episode_id = s.episode_id and frame / 30.0::double >= \"start\" and frame / 30.0::double < \"end\" group by 1) select id, round(f, 6) frac from m where f >= 0.7")
def q_tracking_valid(spark, root: str) -> DataFrame:
    e = table(spark, root, "events")
    seconds = F.expr("timestampdiff(MICROSECOND, timestamp_ntz'2024-01-01 00:00:00', ts) / 1e6D")
    tracking = e.select(F.col("user_id").cast("string").alias("episode_id"), F.floor(seconds * 30).alias("frame"), (F.col("event_id") % 4 != 0).alias("valid"))
    return motion.well_tracked(t.segments(spark, root), tracking).select("id", F.round("tracking_valid_frac", 6).alias("frac"))


@query("select cast(user_id as varchar) episode_id, event_id frame from events where event_id % 3 <> 1")
def q_relevant(spark, root: str) -> DataFrame:
    label = F.when(F.col("event_id") % 3 == 1, "RESET").otherwise("TASK")
    frames = table(spark, root, "events").select(F.col("user_id").cast("string").alias("episode_id"), F.col("event_id").alias("frame"), label.alias("label"))
    return motion.relevant(frames).select("episode_id", "frame")


@query("""with f as (select user_id e, row_number() over (partition by user_id order by event_id) k, event_id from events),
s as (select e, k, ((event_id % 10 < 6)::int + case when event_id % 4 <> 0 then (event_id % 7 < 4)::int else 0 end) / (1.0::double + (event_id % 4 <> 0)::int) x from f),
m as (select e, k, avg(x) over (partition by e order by k rows between 2 preceding and 2 following) x from s),
a as (select e, k, k - row_number() over (partition by e order by k) g from m where x >= 0.5)
select cast(e as varchar) episode_id, min(k) start_frame, max(k) end_frame, count(*) n from a group by e, g""")
def q_attempts(spark, root: str) -> DataFrame:
    """Two signals, one of which is missing at some frames, fused and smoothed."""
    from pyspark.sql import Window

    f = table(spark, root, "events").select(F.col("user_id").cast("string").alias("episode_id"), F.row_number().over(Window.partitionBy("user_id").orderBy("event_id")).cast("long").alias("frame"), "event_id")
    seen = f.select("episode_id", "frame", (F.col("event_id") % 10 < 6).cast("double").alias("s"))
    said = f.where("event_id % 4 <> 0").select("episode_id", "frame", (F.col("event_id") % 7 < 4).cast("double").alias("s"))
    return motion.attempts([seen, said])


@query(f"with {t.SEG_SQL} select episode_id, count(*) filter (where verb = 'click') cycles from seg group by 1")
def q_cycles(spark, root: str) -> DataFrame:
    return motion.cycles(t.segments(spark, root), "click")


_POINTS = """pt as (select cast(user_id as varchar) series, event_id t, case when event_id % 2 = 0 then 'left' else 'right' end hand, event_id % 11 / 10.0::double x, event_id % 7 / 10.0::double y, value z from events),
st as (select *, sqrt(power(x - lag(x) over w, 2) + power(y - lag(y) over w, 2) + power(z - lag(z) over w, 2)) step, t - lag(t) over w dt from pt window w as (partition by series, hand order by t))"""


def _points(spark, root: str) -> DataFrame:
    p = F.array(F.col("event_id") % 11 / F.lit(10.0), F.col("event_id") % 7 / F.lit(10.0), F.col("value"))
    return table(spark, root, "events").select(F.col("user_id").cast("string").alias("series"), F.col("event_id").alias("t"), F.when(F.col("event_id") % 2 == 0, "left").otherwise("right").alias("hand"), p.alias("p"))


@query(f"with {_POINTS} select series, hand, max(t) - min(t) duration, round(coalesce(sum(step), 0), 6) path_length, count(*) filter (where step / dt < 0.01) pauses, round(coalesce(sum(step) / nullif(max(t) - min(t), 0), 0), 6) velocity from st group by 1, 2")
def q_dynamics(spark, root: str) -> DataFrame:
    d = motion.dynamics(_points(spark, root))
    return d.select("series", "hand", "duration", F.round("path_length", 6).alias("path_length"), "pauses", F.round("velocity", 6).alias("velocity"))


@query(f"with {_POINTS}, a as (select series, t // 2 t, bool_or(hand = 'left' and coalesce(step / dt > 0.05, false)) l, bool_or(hand = 'right' and coalesce(step / dt > 0.05, false)) r from (select series, t, hand, step, dt from st) group by 1, 2) select series, count(*) filter (where l and not r) as left, count(*) filter (where r and not l) as right, count(*) filter (where l and r) as both, count(*) filter (where not l and not r) idle from a group by 1".replace("as left,", 'as "left",').replace("as right,", 'as "right",').replace("as both,", 'as "both",'))
def q_hand_activity(spark, root: str) -> DataFrame:
    """Times are pairs of events, so that both hands may have one."""
    p = _points(spark, root)
    steps = motion._steps(p).withColumn("t", F.floor(F.col("t") / 2))
    return motion.activity_counts(steps, 0.05).select("series", "left", "right", "both", "idle")


@query(f"with {_POINTS}, o as (select *, first_value(x) over w ox, first_value(y) over w oy, first_value(z) over w oz from pt window w as (partition by series, hand order by t)) select series, hand, t, round(y - oy, 6) x, round(-(x - ox), 6) y, round(z - oz, 6) z from o")
def q_head_frame(spark, root: str) -> DataFrame:
    """Seen by a head turned a quarter about the vertical axis."""
    p = _points(spark, root)
    turned = F.array(*[F.lit(float(v)) for v in (0, -1, 0, 1, 0, 0, 0, 0, 1)])
    heads = p.select("series", "t", F.array(F.lit(1.0), F.lit(2.0), F.lit(3.0)).alias("position"), turned.alias("rotation"))
    at = lambda k: F.round(F.get("p", F.lit(k)), 6)
    return motion.head_relative(p, heads).select("series", "hand", "t", at(0).alias("x"), at(1).alias("y"), at(2).alias("z"))


@query("with j as (select user_id s, event_id // 1000 t, case event_id % 6 when 0 then 0 else (event_id % 6) * 4 end joint, max(value) v from events group by 1, 2, 3), w as (select s, t, v from j where joint = 0) select cast(j.s as varchar) series, j.t, joint, round(j.v - w.v, 6) x from j join w on j.s = w.s and j.t = w.t where joint > 0")
def q_fingertips(spark, root: str) -> DataFrame:
    e = table(spark, root, "events")
    joint = F.when(F.col("event_id") % 6 == 0, 0).otherwise(F.col("event_id") % 6 * 4).cast("int")
    j = e.groupBy(F.col("user_id").cast("string").alias("series"), F.floor(F.col("event_id") / 1000).alias("t"), F.lit("left").alias("hand"), joint.alias("joint")).agg(F.max("value").alias("v"))
    j = j.select("series", "t", "hand", "joint", F.array("v", F.lit(0.0), F.lit(0.0)).alias("p"))
    tips = motion.fingertips(j).select("series", "t", F.posexplode("tips").alias("k", "d"))
    return tips.where("d is not null").select("series", "t", ((F.col("k") + 1) * 4).cast("int").alias("joint"), F.round(F.get("d", F.lit(0)), 6).alias("x"))


@query(f"with {_POINTS}, g as (select series, t // 2 t, min(x) filter (where hand = 'left') lx, min(x) filter (where hand = 'right') rx from pt group by 1, 2) select series, t, round(abs(lx - rx), 6) distance from g where lx is not null and rx is not null")
def q_hand_distance(spark, root: str) -> DataFrame:
    p = _points(spark, root).select("series", F.floor(F.col("t") / 2).alias("t"), "hand", F.array(F.get("p", F.lit(0)), F.lit(0.0), F.lit(0.0)).alias("p"))
    return motion.hand_distance(p).withColumn("distance", F.round("distance", 6))


@query(f"with {_POINTS} select series, string_agg(round(x, 3) || ',' || round(y, 3) || ',' || round(z, 3), ',' order by hand, t) || ',' || cast(max(t) - min(t) as double) v, 3 * count(*) + 1 dims from pt group by 1".replace("round(x, 3) || ',' || round(y, 3) || ',' || round(z, 3)", "cast(cast(round(x * 10) as bigint) as varchar)").replace("|| ',' || cast(max(t) - min(t) as double) v", "v"))
def q_feature_vector(spark, root: str) -> DataFrame:
    """Flat vectors; shown are their length and the first coordinates in tenths."""
    f = motion.feature_vector(_points(spark, root), (F.max("t") - F.min("t")).cast("double"))
    firsts = F.filter("v", lambda x, i: (i % 3 == 0) & (i < F.size("v") - 1))
    return f.select("series", F.array_join(F.transform(firsts, lambda x: F.round(x * 10).cast("long").cast("string")), ",").alias("v"), F.size("v").cast("long").alias("dims"))


@query("select vec_id id, round(2 * acos(least(1, abs(list_inner_product(embedding[1:4]::double[], embedding[5:8]::double[]) / (sqrt(list_inner_product(embedding[1:4]::double[], embedding[1:4]::double[])) * sqrt(list_inner_product(embedding[5:8]::double[], embedding[5:8]::double[])))))), 6) turned from embeddings where embedding is not null")
def q_turn(spark, root: str) -> DataFrame:
    """The angle between two orientations."""
    v = F.col("embedding").cast("array<double>")
    a, b = (similarity.unit(F.slice(v, k, 4)) for k in (1, 5))
    return table(spark, root, "embeddings").where("embedding is not null").select(F.col("vec_id").alias("id"), F.round(pose.turn(a, b), 6).alias("turned"))


@query(f"with {t.FEAT_SQL}, k as (select a.grp, sum(power(list_inner_product(a.v, b.v), 2)) s, count(distinct a.id) n from feat a join feat b on a.grp = b.grp group by 1) select cast(sum(n) as bigint) n, round(sum(n * (n * n / s)) / sum(n), 5) vendi from k")
def q_weighted_vendi(spark, root: str) -> DataFrame:
    """Execution diversity: the groups' scores, weighted by their sizes."""
    return similarity.weighted_vendi(similarity.vendi_order_two(t.features(spark, root), 64)).select("n", F.round("vendi", 5).alias("vendi"))


@query()
def q_greedy_vendi(spark, root: str) -> DataFrame:
    """One representative of each tenth of a group's vectors, chosen greedily within 40 % of the hours."""
    f = t.features(spark, root)
    rows = f.groupBy("grp", (F.col("id") % 10).alias("part")).agg(F.min_by("v", "id").alias("v"), F.min("id").alias("id"), (F.count("*") / 100).alias("hours"))
    return similarity.greedy(rows, 0.4, 64)
