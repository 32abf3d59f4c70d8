"""Plans and steps that have to grow no faster than their input."""

from pyspark.sql import functions as F

from ridelens.operators import spatial

BOXES = "frame long, seq long, price double, x0 double, y0 double, x1 double, y1 double, sharpness double, motion_blur double"


def plan(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_tiles_are_not_copied_per_cell(spark):
    obs = spark.createDataFrame([(1, 1, 1.0, 0.0, 0.0, 300.0, 10.0, 0.8, 0.5), (1, 2, 1.0, 900.0, 900.0, 910.0, 910.0, 0.8, 0.5),
                                 (1, 3, 1.0, None, 0.0, 300.0, 10.0, 0.8, 0.5), (1, None, 1.0, 0.0, 0.0, 300.0, 10.0, 0.8, 0.5)], BOXES)
    tiles = spark.createDataFrame([(1, 0.0, 0.0, 240.0, 180.0, 0.2), (1, 240.0, 0.0, 480.0, 180.0, 0.4), (1, 0.0, None, 240.0, 180.0, 0.9)],
                                  "frame long, x0 double, y0 double, x1 double, y1 double, score double")
    df = spatial.mask_visibility(obs, tiles)
    assert "Generate" not in plan(df)
    got = {r.seq: round(r.mask_visibility, 6) for r in df.collect()}
    assert got == {1: 0.3, 2: 0.4, 3: 0.4, None: 0.4}


def test_near_join_copies_a_point_to_four_cells_at_most(spark):
    from ridelens.plans.grid import near_join

    pts = spark.range(400).select(F.lit(1).alias("f"), F.col("id").alias("i"), (F.col("id") % 20 * 37.0).alias("x"), (F.floor(F.col("id") / 20) * 41.0).alias("y"))
    other = pts.select("f", F.col("i").alias("j"), F.col("x").alias("ox"), F.col("y").alias("oy"))
    joined = near_join(pts, other, ["f"], (F.col("x"), F.col("y")), (F.col("ox"), F.col("oy")), 60.0)
    want = pts.crossJoin(other.drop("f")).where("(x - ox) * (x - ox) + (y - oy) * (y - oy) <= 3600").select("i", "j")
    got = joined.select("i", "j")
    assert got.exceptAll(want).isEmpty() and want.exceptAll(got).isEmpty()
    assert "240.0" in plan(joined)  # cells of four radii


def test_timed_out_candidates_cost_no_python_step():
    from ridelens.config import TrackingConfig
    from ridelens.operators import tracking

    class Watched(dict):
        reads = 0

        def __getitem__(self, k):
            Watched.reads += 1
            return super().__getitem__(k)

    s, cfg = tracking.new_tracker(), TrackingConfig()
    frame = {"quality_ok": True, "allow_new": True, "yaw_rate": 0.0, "frame_width": 1920.0, "frame_id": 0}
    far = [{"obs_index": i, "frame_id": 0, "semantic_type": "pothole", "geometry_type": "concave", "state": "abnormal", "severity": 1, "model_confidence": 0.9,
            "quality_at_mask": 0.9, "box": (i * 500.0, 0.0, i * 500.0 + 20, 20.0), "z": (i * 500.0 + 10, 20.0, 20.0, 20.0)} for i in range(50)]
    list(tracking.update_tracker(s, {**frame, "timestamp_ns": 0}, far, cfg))
    ended = [r["transition"] for r in tracking.update_tracker(s, {**frame, "timestamp_ns": 500_000_000}, [], cfg)]
    assert ended == ["candidate_timeout"] * 50 and len(s["ids"]) == 50
    s["info"] = [Watched(t) for t in s["info"]]
    assert list(tracking.update_tracker(s, {**frame, "timestamp_ns": 600_000_000}, [], cfg)) == []
    assert Watched.reads == 0
    again = list(tracking.update_tracker(s, {**frame, "timestamp_ns": 700_000_000}, [far[7]], cfg))
    assert [(r["track_id"], r["hits"], r["misses"]) for r in again] == [(8, 2, 0)]
    list(tracking.update_tracker(s, {**frame, "timestamp_ns": 32_000_000_000}, [], cfg))
    assert len(s["ids"]) == 0 or s["ids"].tolist() == [8]


def test_frames_are_suppressed_together(spark):
    import numpy as np

    rng = np.random.default_rng(5)
    sizes = np.array([1, 7, 40, 3])
    lo = rng.integers(0, 60, (sizes.sum(), 2)).astype(float)
    boxes = np.hstack([lo, lo + rng.integers(5, 40, lo.shape)])

    def one_by_one(cap=None):
        out, at = [], 0
        for n in sizes:
            kept = []
            for i in range(at, at + n):
                if (cap is None or len(kept) < cap) and not any(spatial._clash(boxes[k], boxes[i], 0.3, True) for k in kept):
                    kept.append(i)
            out, at = out + kept, at + n
        return out

    assert np.flatnonzero(spatial._greedy(boxes, np.ones(len(boxes), dtype=bool), sizes, 0.3, True)).tolist() == one_by_one()
    frames = np.repeat(np.arange(len(sizes)), sizes)
    df = spark.createDataFrame([(int(f), i, 1.0, 0.5, *map(float, b)) for i, (f, b) in enumerate(zip(frames, boxes))],
                               "image long, seq long, price double, conf double, x0 double, y0 double, x1 double, y1 double")
    for cap, block in ((None, 256), (None, 4), (3, 256), (3, 2), (5, 4)):
        got = sorted(r.seq for r in spatial.nms(df, iou_threshold=0.3, plus_one=True, cap=cap, block=block).collect())
        assert got == one_by_one(cap), (cap, block)


def test_mounts_of_one_partition_are_dealt_out(spark):
    from ridelens.operators import fit

    cols = {c: F.lit(float(v)) for c, v in {"camera_height_m": 1.0, "pitch_deg": 20.0, "roll_deg": 0.0, "yaw_deg": 0.0, "lateral_offset_m": 0.0, "fx": 1423.0,
                                            "fy": 1423.0, "cx": 960.0, "cy": 540.0, "known_distance_5m_px": 500.0, "known_distance_10m_px": 320.0, "known_distance_20m_px": 220.0}.items()}
    mounts = spark.range(400).coalesce(1).select(F.col("id").alias("profile_id"), F.lit(True).alias("valid"), *[v.alias(c) for c, v in cols.items()])
    fitted = fit.fit_mounts(mounts)
    assert fitted.select(F.spark_partition_id().alias("p")).distinct().count() > 1
    assert fitted.groupBy("pitch_deg", "camera_height_m").count().count() == 1


def test_element_counts_travel_packed(spark):
    from ridelens.llm import jaccard_join as jj
    from ridelens.llm.base import prepare

    prepare(spark)
    docs = spark.range(40).select(F.col("id").alias("doc_id"), F.concat_ws(" ", F.transform(F.sequence(F.col("id"), F.col("id") + 300), lambda i: i.cast("string"))).alias("text")).repartition(4)
    seen = jj.profile(docs, 5, "doc_id", "text")
    assert seen.where("sig is null").count() <= 4 * jj.COUNT_BUCKETS
    keys, place = jj.element_order(seen.where("sig is null"))
    # windows start at 0 .. 335, each is in as many texts as start there or up to 296 before
    held = [sum(d <= w <= d + 296 for d in range(40)) for w in range(336)]
    assert len(keys) == sum(h > 1 for h in held) and sorted(place) == list(range(len(keys)))


def test_a_spike_meets_a_track_once_per_bucket(spark):
    from ridelens.operators import reports

    accel = spark.createDataFrame([(1, i, t, 30.0) for i, t in enumerate([0, 95, 100, 205, 1000])], "session_id long, event_id long, timestamp_ns long, z double")
    rows = [(1, t, t % 7) for t in range(50, 260, 3)] + [(1, 900, 40), (1, 899, 41), (1, 1100, 42), (1, 1101, 43), (2, 1000, 44), (1, -100, 45), (1, -101, 46)]
    near = spark.createDataFrame(rows, "session_id long, timestamp_ns long, track_id long")
    df = reports.harvest_impact_windows(accel, near=near, near_ns=100)
    got = {r.timestamp_ns: r.near_track_ids for r in df.collect()}
    assert got == {t: sorted({k for s, u, k in rows if s == 1 and abs(u - t) <= 100}) for t in (0, 95, 100, 205, 1000)}
    assert "min(_seen" in plan(df)  # one row a track and bucket, however often it was seen


def test_large_unlike_texts_are_not_fetched(spark, monkeypatch):
    import numpy as np

    from ridelens.llm import jaccard_join as jj
    from ridelens.llm.base import prepare

    prepare(spark)
    rng = np.random.default_rng(3)
    a, b = (np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2)) for n in (3000, 2100))
    for c in (b, np.unique(np.r_[a[:2800], b[:50]]), a[:1500]):  # the last two have other numbers of counts
        assert 0 < jj.surely_differ(jj.spread(a), jj.spread(c)) <= len(np.setxor1d(a, c))
    assert jj.spread(a[: jj.SPREAD]) is None and jj.spread(np.zeros(4000, np.uint64)) is None

    # ten texts of 1500 words share some rare words and are else unlike, two more are near copies
    texts = [" ".join(["rare", "words", "of", "all"] * 1 + [f"w{x}" for x in rng.integers(0, 10**6, 1500)]) for _ in range(10)]
    texts += [texts[4] + " tail", texts[5].replace("rare", "other")]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    asked, plain = [], jj.overlaps
    monkeypatch.setattr(jj, "overlaps", lambda d, pairs, *more: asked.append(pairs) or plain(d, pairs, *more))
    got = {r.doc_id: r.component_id for r in jj.jaccard_components(docs, 4, 85).collect()}
    assert got == {**{i: i for i in range(10)}, 10: 4, 11: 5}
    assert {(r.a, r.b) for p in asked for r in p.collect()} <= {(4, 10), (5, 11)}


def test_texts_of_one_id_each_keep_their_links(spark):
    from ridelens.llm import jaccard_join as jj
    from ridelens.llm.base import prepare

    prepare(spark)
    long = lambda k: " ".join(f"{k}-{x}" for x in range(1500))
    docs = spark.createDataFrame([(1, long("a")), (1, "a b c d e f g h"), (2, "a b c d e f g h"), (3, long("a") + " tail"), (4, long("b"))], "doc_id long, text string")
    got = sorted((r.doc_id, r.component_id) for r in jj.jaccard_components(docs, 4, 85).collect())
    assert got == [(1, 1), (1, 1), (2, 1), (3, 1), (4, 4)]


def test_mixing_tries_steps_of_many_lengths_in_one_pass(spark, monkeypatch):
    from pyspark.sql.classic.dataframe import DataFrame

    from ridelens.llm import mixing

    rows = [(i, float(10 + i % 7), *p) for i, p in enumerate([(0.98, 0.01, 0.01), (0.1, 0.85, 0.05), (0.3, 0.1, 0.6), (0.5, 0.3, 0.2)] * 40)]
    members = spark.createDataFrame(rows, "id long, n double, p0 double, p1 double, p2 double").checkpoint()

    def passes(tries):
        seen, first = [], DataFrame.first
        monkeypatch.setattr(mixing, "TRIES", tries)
        monkeypatch.setattr(DataFrame, "first", lambda df: seen.append(1) or first(df))
        rate = mixing.fit_rates(members, [0.2, 0.2, 0.6])
        monkeypatch.setattr(DataFrame, "first", first)
        return len(seen), {r.id: r.rate for r in members.select("id", rate.alias("rate")).collect()}

    (many, slow), (few, fast) = passes(1), passes(6)
    assert slow == fast and few < many / 2


def test_primary_boxes_are_read_once_for_live_and_other_frames(spark):
    cols = "frame long, seq long, price double, x0 double, y0 double, x1 double, y1 double, model_confidence double, calibrated_confidence double"
    primary = spark.createDataFrame([(1, 1, 1.0, 0.0, 0.0, 9.0, 9.0, 0.5, None), (2, 1, 1.0, 0.0, 0.0, 9.0, 9.0, 0.5, None), (None, 1, 1.0, 0.0, 0.0, 9.0, 9.0, 0.5, 0.2),
                                     (3, 1, 1.0, 0.0, 0.0, 9.0, 9.0, 0.5, 0.4)], cols)
    sidecar = spark.createDataFrame([(1, 2, 1.0, 500.0, 500.0, 900.0, 560.0, 0.5, 0.3), (1, 3, 1.0, 1.0, 1.0, 9.0, 9.0, 0.5, 0.3)], cols)
    mask = "frame long, road_polygon array<array<double>>, occluded_polygons array<array<array<double>>>"
    away = [[100.0, 100.0], [200.0, 100.0], [200.0, 200.0], [100.0, 200.0]]
    df = spatial.merge_sidecar(primary, sidecar, spark.createDataFrame([(2, away, []), (2, away, [])], mask), spark.createDataFrame([(3, away, [])], mask), score=1.0)
    got = sorted((r.frame or 0, r.seq, r.calibrated_confidence and round(r.calibrated_confidence, 6)) for r in df.collect())
    # frame 2 and the row without a frame are not live: neither blended nor gated; frame 3 is live and its box is off the road
    assert got == [(0, 1, 0.2), (1, 1, 0.725), (1, 2, 0.3), (2, 1, None)]
    assert plan(df).count("LeftAnti") == 1  # the sidecar's


def test_windows_are_dealt_over_all_tasks(spark):
    from ridelens.operators import timejoin

    frames = [(r, i, i * 130) for r in (1, 2) for i in range(30)] + [(1, 30, None), (None, 31, 130)]
    imu = [(r, i, i * 37 - 200, "GYRO") for r in (1, 2) for i in range(120)] * 2 + [(1, 500, None, "GYRO"), (None, 501, 130, "GYRO")]
    df = timejoin.imu_window(spark.createDataFrame(frames, "session_id long, frame_index long, sensor_timestamp_ns long"),
                             spark.createDataFrame(imu, "session_id long, sample_id long, timestamp_ns long, sensor_type string"), half_ns=300, order=("sample_id",))
    got = sorted((r.session_id, r.frame_index, r.sample_id) for r in df.collect())
    assert got == sorted((a, i, j) for a, i, t in frames for b, j, u, _ in imu if a is not None and a == b and None not in (t, u) and abs(t - u) < 300)
    tasks = spark.conf.get("spark.sql.shuffle.partitions")
    assert plan(df).count("RepartitionByExpression") == 2 and plan(df).count(f"], {tasks}") >= 2


def test_large_files_are_hashed_split_by_split(spark, tmp_path, monkeypatch):
    import gzip
    import hashlib
    import random

    from ridelens.functions import digest
    from ridelens.sources import bundles

    rng = random.Random(3)
    files = {"a.bin": rng.randbytes(90_001), "b c%20.bin": rng.randbytes(50_000) + b"\n", "mark.txt": b"\xef\xbb\xbf" + b"line \r\n" * 9_000, "mark2.txt": b"\xef\xbb\xbf\n" + rng.randbytes(40_000) + b"x",
             "long.bin": b"x" * 70_000 + b"\n" + b"\0" * 9_000, "ends.txt": b"\n" * 50_000, "packed.gz": gzip.compress(rng.randbytes(60_000)), "false.GZ": rng.randbytes(60_000), "small.bin": b"abc"}
    (tmp_path / "sub").mkdir()
    for name, data in files.items():
        (tmp_path / "sub" / name).write_bytes(data)
    want = {(name, len(data), hashlib.sha256(data).hexdigest()) for name, data in files.items()}
    rounds, before = [], {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    kept = bundles._hash_splits
    monkeypatch.setattr(bundles, "_hash_splits", lambda parts, due: rounds.append(due) or kept(parts, due))
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "16k")
        spark.conf.set("spark.sql.files.openCostInBytes", "1k")
        got = bundles.file_digests(spark, str(tmp_path / "sub"), whole=20_000).collect()
    finally:
        for k, x in before.items():
            spark.conf.set(k, x)
    assert {(r.path.rsplit("/", 1)[1], r.length, r.sha256) for r in got} == want and len(got) == len(want)
    assert len(rounds) == 6 and len(rounds[0]) == 6  # files of at most six splits, without small and packed ones
    data = rng.randbytes(1_000)
    monkeypatch.setattr(digest, "_native", lambda: None)
    state = digest.Sha256()
    for i in range(0, len(data), 37):
        state = digest.update(state, data[i : i + 37])
    assert digest.hexdigest(state) == hashlib.sha256(data).hexdigest()
