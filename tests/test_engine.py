import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from gleaner.functions import coerce, paths
from gleaner.operators import normalize, segments, selection, similarity
from gleaner.operators.graph import connected_components
from gleaner.sources.artifact import artifact_path, read_artifact
from gleaner.sources.tables import episode_metadata, listing


def column(spark, values, fn):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [r[0] for r in df.orderBy("i").select(fn(F.col("v"))).collect()]


def test_numbers(spark):
    got = column(spark, ["1.5", "true", "nan", "1_000", "1.5d", None, " 2 ", "-inf", "x"], lambda c: coerce.to_number(c, 0))
    assert got == [1.5, 0.0, 0.0, 1000.0, 0.0, 0.0, 2.0, float("-inf"), 0.0]
    assert column(spark, ["-1.9", "inf", "nan"], lambda c: coerce.to_integer(c, 3)) == [-1, 3, 3]


def test_booleans(spark):
    assert column(spark, [" Kept ", "drop", "2", "maybe", None, "0"], lambda c: coerce.to_boolean(c, False)) == [True, False, False, False, False, False]
    assert column(spark, ["x", " ", "nan", None], coerce.is_missing) == [False, True, False, True]
    numbers = spark.createDataFrame([(1.0,), (float("nan"),), (None,)], "x double")
    assert [r[0] for r in numbers.select(coerce.is_missing(F.col("x"), number=True)).collect()] == [False, True, True]


def test_json_values_count_by_type(spark):
    doc = {"segments": [
        {"id": "0", "verb": "false", "episode_id": "null", "start": "true", "keep": "2"}, {"id": 0, "verb": False, "episode_id": None, "start": True, "keep": 2},
        {"id": 7, "verb": True, "episode_id": {}, "start": "1.5", "end": "nan", "keep": True, "video_id": "v"}, {"start": "1_000", "end": 1e400, "keep": "maybe"},
    ]}
    art = spark.createDataFrame([(json.dumps(doc).replace("Infinity", "null"),)], "d string").select(F.parse_json("d").alias("doc"))
    rows = normalize.segments(art).orderBy("pos").collect()
    assert [(r["id"], r["verb"], r["episode_id"], r["video_id"], r["start"], r["end"], r["keep"]) for r in rows] == [
        ("0", "false", "null", "null", 0.0, 0.0, False), ("segment_002", "unlabeled", "unknown_episode", "unknown_episode", 1.0, 1.0, True),
        ("7", "true", "unknown_episode", "v", 1.5, 1.5, True), ("segment_004", "unlabeled", "unknown_episode", "unknown_episode", 1000.0, 1000.0, False),
    ]


def test_names_and_paths(spark):
    assert column(spark, ["fold-clothes", "it's", "fold"], coerce.title_case) == ["Fold-Clothes", "It'S", "Fold"]
    assert column(spark, ["a/b.zarr/c/0", "x/y", "b.zarr"], paths.recording_root) == ["a/b.zarr", None, "b.zarr"]
    assert column(spark, ["d/.env", "a.tar.gz", "noext"], paths.extension) == ["<no extension>", ".gz", "<no extension>"]


def write(path, text):
    path.write_text(text)
    return str(path)


def test_artifact(spark, tmp_path):
    doc = {
        "segments": [5, {}, {"id": 0, "start": -3, "end": -5}, {"start": 4, "end": "abc", "verb": "FOLD", "keep": "Kept", "neighbors": [{}, 7, {"id": "a", "similarity": 1.7}]}],
        "coverage_curve": [{"retained_percent": 50}, {"retained_hours": 5}],
        "summary": {"original_hours": 10},
        "actions": [],
    }
    art = read_artifact(spark, write(tmp_path / "a.json", json.dumps(doc)))
    segs = normalize.segments(art).orderBy("pos")
    rows = segs.collect()
    assert [r["id"] for r in rows] == ["segment_001", "segment_002", "segment_003", "segment_004"]
    assert (rows[2]["start"], rows[2]["end"], rows[3]["end"], rows[3]["verb"], rows[3]["keep"]) == (0, 0, 4, "fold", True)
    assert [(n["segment_id"], n["similarity"]) for n in rows[3]["neighbors"]] == [("a", 1.0)]
    curve = normalize.coverage_curve(art, 10.0).orderBy("pos").collect()
    assert [(r["retained_hours"], r["retained_percent"]) for r in curve] == [(5, 50), (5, 50)]
    assert sorted(map(tuple, normalize.actions(art, segs).collect())) == [("fold", 1.0, 1.0), ("unlabeled", 3.0, 0.0)]
    assert normalize.summary(art, segs).first()["total_segments"] == 4


@pytest.mark.parametrize("text", ["[1]", "{", None])
def test_bad_artifacts_are_empty(spark, tmp_path, text):
    path = str(tmp_path / "none.json") if text is None else write(tmp_path / "a.json", text)
    art = read_artifact(spark, path)
    assert art.first()["source_error"]
    assert normalize.segments(art).count() == 0


def test_artifact_path(monkeypatch):
    monkeypatch.setenv("RESULTS_PATH", "/x/r.json")
    assert artifact_path() == "/x/r.json" and artifact_path("a.json", base="/b") == "/b/a.json"


def test_listing_and_metadata(spark, tmp_path):
    d = tmp_path / "e1.zarr"
    d.mkdir()
    write(d / "zarr.json", json.dumps({"attributes": {"fps": 30, "total_frames": 95, "features": {"b": 1, "a": {}}}}))
    write(d / "chunk", "1234")
    assert listing(spark, str(tmp_path)).agg(F.count("*"), F.sum("length")).first()[0] == 2
    row = episode_metadata(spark, str(tmp_path)).first()
    assert (row["total_frames"], row["fps"], row["feature_keys"], row["task_name"]) == (95, 30.0, ["a", "b"], None)


def test_frame_windows(spark):
    e = spark.createDataFrame([("a", 30.0, 95), ("b", 30.0, 0)], "episode string, fps double, total_frames int")
    got = segments.frame_windows(e, 1.0).orderBy("start_frame").collect()
    assert [(r["file"], r["start_frame"], r["end_frame_exclusive"]) for r in got] == [("000000.mp4", 0, 30), ("000001.mp4", 30, 60), ("000002.mp4", 60, 90), ("000003.mp4", 90, 95)]
    assert spark.range(1).select(segments.frames_per_window(F.lit(2.5), 1.0)).first()[0] == 2


def registry(spark, n, reverse=False):
    """Recordings of one task, by three labs; a row's place is in its id."""
    rows = [(f"rec{i:03d}", "stack_cups", f"lab{i % 3}", None, None, f"d{i % 5}", f"store/rec{i:03d}.zarr", False) for i in range(n)]
    return spark.createDataFrame(sorted(rows, reverse=reverse), "episode_hash string, task string, lab string, scene string, operator string, demonstrator string, zarr_processed_path string, is_deleted boolean")


@pytest.mark.parametrize("n,k,seed,want", [(15, 10, 42, [10, 1, 0, 11, 4, 3, 9, 2, 5, 12]), (8, 3, 11, [7, 6, 4]), (15, 5, 7, [5, 2, 6, 10, 0])])
def test_sample(spark, n, k, seed, want):
    for reverse in (False, True):
        rows = selection.choices(selection.available(registry(spark, n, reverse)), "stack_cups")
        got = {r["episode_id"] for r in selection.sampled_exactly(rows, "episode_id", k, seed).collect()}
        assert got == {f"rec{i:03d}" for i in want}


def test_guards_and_availability(spark):
    for args in (("", 1), ("*", 1), ("x", 0), ("x", -1)):
        with pytest.raises(ValueError):
            selection.guard(*args)
    assert selection.guard(" x ", 3) == "x"
    r = registry(spark, 3).withColumn("is_deleted", F.col("episode_hash") == "rec000").withColumn("zarr_processed_path", F.when(F.col("episode_hash") == "rec001", " ").otherwise(F.col("zarr_processed_path")))
    assert [x["episode_hash"] for x in selection.available(r).collect()] == ["rec002"]


def test_interpolation_passes_through_knots(spark):
    curve = spark.createDataFrame([(1.0, 10.0), (2.0, 30.0), (4.0, 50.0)], "x double, y double")
    points = spark.createDataFrame([(0.0,), (1.0,), (1.5,), (2.0,), (3.0,), (9.0,)], "h double")
    got = {r["h"]: r["y"] for r in segments.interpolated(points, curve, "x", "y", "h").collect()}
    assert got == {0.0: 10.0, 1.0: 10.0, 1.5: 20.0, 2.0: 30.0, 3.0: 40.0, 9.0: 50.0}


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 101), (102, 101), (7, 7)]
    got = dict(map(tuple, connected_components(spark.createDataFrame(edges, "a long, b long")).collect()))
    assert got == {**dict.fromkeys(range(41), 0), **dict.fromkeys((100, 101, 102), 100)}


def test_similarity_and_diversity(spark):
    rows = spark.createDataFrame([(1, 0, [1.0, 0.0]), (2, 0, [0.0, 1.0]), (3, 0, [1.0, 0.0])], "id long, grp long, v array<double>")
    near = similarity.nearest(rows.select("id", "v"), rows.select("id", "v"), 1).collect()
    assert {(r["id"], r["neighbour"]) for r in near} == {(1, 3), (3, 1), (2, 1)}
    assert similarity.vendi_order_two(rows, 2).first()["vendi"] == pytest.approx(9 / 5)
    loo = {r["id"]: r["contribution"] for r in similarity.contributions(rows, 2).collect()}
    assert loo[2] == pytest.approx(9 / 5 - 1) and loo[1] == pytest.approx(9 / 5 - 2)


def test_streaming(spark, tmp_path):
    from gleaner import streaming

    src = "/root/testdata/sf0.001/events.parquet"
    events = spark.read.parquet(src)
    events.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "in"))
    streaming.run_available(streaming.tumbling(stream), str(tmp_path / "out"), str(tmp_path / "c")).awaitTermination(120)
    got = spark.read.parquet(str(tmp_path / "out"))
    batch = events.groupBy(F.window(F.col("ts").cast("timestamp"), "1 hour").alias("w"), "event_type").agg(F.count("*").alias("n")).select(F.col("w.start").alias("window_start"), "event_type", "n")
    assert got.select("window_start", "event_type", "n").subtract(batch).count() == 0 < got.count() <= batch.count()


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())


def test_links_reach_what_all_pairs_reach(spark, monkeypatch):
    from gleaner.operators import similarity
    from gleaner.operators.graph import connected_components

    monkeypatch.setattr(similarity, "BLOCK", 32)
    x = np.random.default_rng(2).normal(size=(90, 12))
    x[:8] = x[0]  # more copies than five
    x[8] = x[0] + 0.9 * x[8]
    x /= np.linalg.norm(x, axis=1)[:, None]
    near = x @ x.T >= 0.7
    reach = np.linalg.matrix_power(near.astype(float), 90) > 0
    want = {i: int(reach[i].argmax()) for i in range(90) if near[i].sum() > 1}
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, v array<double>")
    got = {r["node"]: r["root"] for r in connected_components(similarity.linked(rows, 0.7)).collect()}
    assert got == want and got[8] == 0


def test_selection_run(spark, tmp_path):
    from gleaner.sources.files import read_json

    asked = []

    def fetch(wanted):
        asked.append(sorted(r[0] for r in wanted.select("episode_id").collect()))
        return wanted

    more = registry(spark, 8).unionByName(registry(spark, 1).withColumns({"episode_hash": F.lit("other"), "task": F.lit("sort")}))
    dry = selection.run(more, " stack_cups ", 3, 11, str(tmp_path), fetch, dry_run=True)
    assert dry.available == 8 and dry.manifest_path is None and not asked and not list(tmp_path.iterdir())
    done = selection.run(more, "stack_cups", 3, 11, str(tmp_path), fetch)
    assert asked == [["rec004", "rec006", "rec007"]] and [r["episode_id"] for r in done.episodes.collect()] == asked[0]
    m = json.loads((tmp_path / "selection_manifest.json").read_text())
    assert (m["requested_task"], m["seed"], m["episode_count"]) == ("stack_cups", 11, 3)
    assert m["episodes"][0] == {"episode_id": "rec004", "task": "stack_cups", "lab": "lab1", "scene": "unknown", "demonstrator": "d4", "zarr_processed_path": "store/rec004.zarr"}
    v = read_json(spark, done.manifest_path)
    assert v.select(F.try_variant_get("v", "$.episodes[2].episode_id", "string")).first()[0] == "rec007" and read_json(spark, str(tmp_path / "none.json")).count() == 0
    with pytest.raises(RuntimeError, match="sort, stack_cups"):
        selection.run(more, "fold", 3, 11, str(tmp_path), fetch)
    with pytest.raises(RuntimeError, match="complete"):
        selection.run(registry(spark, 3), "stack_cups", 5, 1, str(tmp_path), fetch)
    assert selection.run(registry(spark, 3), "stack_cups", 5, 1, str(tmp_path), fetch, confirm_complete=True).episodes.count() == 3
    with pytest.raises(RuntimeError, match="not those selected"):
        selection.run(more, "stack_cups", 3, 11, str(tmp_path), lambda w: w.limit(2))
    with pytest.raises(ValueError):
        selection.run(more, "all", 3, 11, str(tmp_path), fetch)
    assert selection.text_table(done.episodes.limit(0), "episode_id", "lab").count() == 0


def test_recordings(spark, tmp_path):
    from gleaner.operators import ingest
    from gleaner.sources.files import register, source, zarr_array

    import zstandard

    frames = [bytes([k]) * (k + 1) for k in range(7)]
    for name, codec, pack in (("a.zarr", "zstd", zstandard.ZstdCompressor().compress), ("b.zarr", None, bytes)):
        base = tmp_path / name / "images.front_1"
        (base / "c").mkdir(parents=True)
        write(tmp_path / name / "zarr.json", json.dumps({"node_type": "group", "attributes": {"fps": 30}}))
        codecs = [{"name": "vlen-bytes"}] + ([{"name": codec}] if codec else [])
        write(base / "zarr.json", json.dumps({"node_type": "array", "shape": [7], "chunk_grid": {"configuration": {"chunk_shape": [3]}}, "codecs": codecs}))
        for c in range(3):
            part = (frames + [b"", b""])[3 * c : 3 * c + 3]
            (base / "c" / str(c)).write_bytes(pack(len(part).to_bytes(4, "little") + b"".join(len(x).to_bytes(4, "little") + x for x in part)))
    got = {}
    for r in zarr_array(spark, str(tmp_path), "images.front_1").collect():
        got.setdefault(r["episode"].rsplit("/", 1)[-1], {})[r["frame"]] = bytes(r["data"])
    assert got == {n: dict(enumerate(frames)) for n in ("a.zarr", "b.zarr")}
    with pytest.raises(KeyError):
        zarr_array(spark, str(tmp_path), "images.other")
    files = listing(spark, str(tmp_path)).withColumn("path", F.regexp_replace("path", "^file:/+", "/"))
    report = ingest.ingestion_report(files, 5, str(tmp_path) + "/")
    assert [(r["episode"], r["files"], r["complete"]) for r in ingest.complete(report).orderBy("episode").collect()] == [(None, 10, True), ("a.zarr", 5, True), ("b.zarr", 5, True)]
    one = ingest.inspection(files, str(tmp_path)).first()
    assert (one["episode_count"], one["file_count"], one["sample_episodes"], one["sample_files"][0]) == (2, 10, ["a.zarr", "b.zarr"], "a.zarr/images.front_1/c/0")
    contents = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(str(tmp_path)).select("path", "length", "content")
    p = ingest.probe(contents).first()
    assert p["episode"] == "a.zarr" and p["metadata_preview"].startswith('{"node_type"') and p["chunk_path"].endswith("a.zarr/images.front_1/c/0") and p["first_bytes_hex"].startswith("28b52ffd")
    bare = files.where(~F.col("path").endswith("b.zarr/zarr.json"))
    with pytest.raises(RuntimeError, match="b.zarr"):
        ingest.complete(ingest.ingestion_report(bare, 5, str(tmp_path) + "/"))
    with pytest.raises(RuntimeError, match="no recordings"):
        ingest.complete(ingest.ingestion_report(files, 5, "/nowhere/"))
    assert episode_metadata(spark, str(tmp_path / "nowhere")).count() == 0
    register("made", lambda spark, n: spark.range(n))
    assert source(spark, "made", n=3).count() == 3
    with pytest.raises(RuntimeError, match="made"):
        source(spark, "no such source")


def test_many_groups_and_greedy_choice(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(900, 4))
    x /= np.linalg.norm(x, axis=1)[:, None]
    rows = spark.createDataFrame([(i, i % 300, v.tolist()) for i, v in enumerate(x)], "id long, grp long, v array<double>")
    score = lambda y: len(y) ** 2 / ((y @ y.T) ** 2).sum() if len(y) else 0.0
    got = {r["id"]: r["contribution"] for r in similarity.contributions(rows, 4).collect()}
    assert len(got) == 900
    for i in range(0, 900, 37):
        own = [j for j in range(i % 300, 900, 300)]
        assert got[i] == pytest.approx(score(x[own]) - score(x[[j for j in own if j != i]]))
    assert similarity.vendi_exact(rows, 4).count() == 300
    few = spark.createDataFrame([(i, x[i].tolist(), 1.0 + i % 3) for i in range(30)], "id long, v array<double>, hours double")
    chosen = [r["id"] for r in similarity.greedy(few, 0.4, 4).orderBy("step").collect()]
    left, mine, total, budget = set(range(30)), [], 0.0, 0.4 * sum(1.0 + i % 3 for i in range(30))
    while True:
        fits = [i for i in sorted(left) if total + 1.0 + i % 3 <= budget + 1e-9]
        if not fits:
            break
        best = max(fits, key=lambda i: (round(score(x[mine + [i]]), 9), -i))
        mine.append(best)
        left.discard(best)
        total += 1.0 + best % 3
    assert chosen == mine
    with pytest.raises(ValueError):
        similarity.greedy(few, 0.4, 4, most=10)


def test_stated_neighbours_count_by_row(spark):
    near = "array<struct<segment_id: string, similarity: double, explanation: string>>"
    rows = [(k, f"n{k}", f"v{k}", "fold", f"c{k}", 50.0 + k, [("n1", 0.1, ""), ("n1", 0.1, "said"), ("gone", 0.9, ""), ("n0", 0.9, "")] if k == 0 else []) for k in range(7)]
    segs = spark.createDataFrame(rows, f"pos long, id string, video_id string, verb string, cluster string, distinctiveness_percentile double, neighbors {near}")
    got = similarity.similar_segments(segs.where("pos = 0"), segs).orderBy("rank").collect()
    assert [(r["neighbour_id"], r["source"]) for r in got] == [("n2", "rule"), ("n3", "rule"), ("n4", "rule"), ("n1", "stated"), ("n1", "stated")]
    assert [r["explanation"] for r in got][3:] == [similarity.OTHER_STYLE, "said"]


def test_neighbours_are_looked_up_in_parts(spark, monkeypatch):
    """Parts of few rows, ties, stated ids and videos of many segments give what all pairs give, and no pairs are made."""
    import random

    monkeypatch.setattr(similarity, "PART", 60)
    rng = random.Random(3)
    segs = [(i, str(i), f"m{rng.choice([0, 0, rng.randrange(9)])}", f"v{min(rng.randrange(9), 5)}", f"c{rng.randrange(2)}", rng.randrange(40) / 7) for i in range(300)]
    segs.append((300, "300", "m1", "alone", "c0", 1.0))
    asked = [(*s, [str(rng.randrange(305)) for _ in range(rng.choice([0, 2]))]) for s in segs if s[0] % 10 == 0]
    by, want = {s[1]: s for s in segs}, {}
    for pos, id, video, verb, cluster, pct, named in asked:
        met = [n for n in named if n in by and by[n][2] != video]
        rest = [s for s in segs if s[1] not in (id, *met) and s[2] != video]
        rest.sort(key=lambda s: (s[3] != verb, s[4] == cluster, abs(s[5] - pct), s[0]))
        want[id] = sorted(s[1] for s in rest[: 5 - len(met)])
    schema = "pos long, id string, video_id string, verb string, cluster string, distinctiveness_percentile double, neighbors array<struct<segment_id: string, similarity: double, explanation: string>>"
    all_, some = (spark.createDataFrame([(*r[:6], [(n, 0.5, "") for n in (r[6] if len(r) > 6 else [])]) for r in rows], schema) for rows in (segs, asked))
    monkeypatch.delattr(type(all_), "crossJoin")
    got = {a[1]: [] for a in asked}
    for r in similarity.similar_segments(some, all_).where("source = 'rule'").collect():
        got[r["segment_id"]].append(r["neighbour_id"])
    assert {k: sorted(v) for k, v in got.items()} == want


def test_sessions_stream(spark, tmp_path):
    from gleaner import streaming

    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    events.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "in"))
    streaming.run_available(streaming.sessions(stream), str(tmp_path / "out"), str(tmp_path / "c")).awaitTermination(120)
    got = spark.read.parquet(str(tmp_path / "out"))
    batch = events.groupBy("user_id", F.session_window(F.col("ts").cast("timestamp"), "30 minutes").alias("w")).agg(F.count("*").alias("n")).select("user_id", F.col("w.start").alias("session_start"), "n")
    assert got.select("user_id", "session_start", "n").subtract(batch).count() == 0 < got.count() <= batch.count()
