"""Operators on small frames with values worked out by hand."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from claimflow.functions import columns as C
from claimflow.functions import kernels as K
from claimflow.operators import claims, distances, frames, graph, intervals, joins, report, scores
from claimflow.sources import files


def one(spark, expr):
    return spark.range(1).select(expr.alias("x")).first()["x"]


def strings(*x):
    return F.array(*[F.lit(v) for v in x]) if x else F.array().cast("array<string>")


def test_sequence_scores(spark):
    sets = F.array(strings("e4", "d1"), strings("d3"))
    assert one(spark, C.lcs_candidates(strings("e4", "e3", "d3"), sets)) == pytest.approx(2 / 3)
    assert one(spark, C.jaccard(strings("e4", "d3"), strings("e4", "d1", "d3"))) == pytest.approx(2 / 3)
    assert one(spark, C.jaccard(strings(), strings())) == 1
    assert one(spark, C.lcs_ratio(strings(), strings())) == 1
    assert one(spark, C.lcs_ratio(strings("a"), strings())) == 0
    assert one(spark, C.route_score(F.transform(strings("e4", "e3", "c3"), lambda x: C.grid_cell(x)))) == pytest.approx(0.875)


def test_scalars(spark):
    assert one(spark, C.relative_score(F.lit(90.0), F.lit(100.0))) == pytest.approx(0.9)
    assert [one(spark, C.topology_break(F.lit(d).cast("int"))) for d in (4, 8, None)] == [1.0, 0.25, 0.0]
    assert one(spark, C.circular_difference(F.lit(359.0), F.lit(1.0))) == pytest.approx(2)
    assert one(spark, C.time_bucket_regions(F.lit(100))) == ["d3", "c4"]
    assert one(spark, C.time_of_day_ms(F.lit("01:02:03:004"))) == 3723004
    assert one(spark, C.time_of_day_ms(F.lit("25:02:03:004"))) is None
    assert one(spark, C.clock_duration(F.lit(86_399_000), F.lit(1_000))) == 2.0
    assert one(spark, C.elapsed_text(F.lit(100.4))) == "00:01:40"
    assert one(spark, C.fit_length(F.array(F.lit(1), F.lit(2)), 3)) == [1, 2, None]
    assert one(spark, C.fit_length(F.array(F.lit(1), F.lit(2)), 3, front=True)) == [None, 1, 2]
    assert one(spark, C.similarity(F.lit(float("nan")))) == 0


def test_paths(spark):
    assert one(spark, C.merged_path(F.lit("a/route_3/7.csv"))) == "route_3/7_merged.csv"
    assert one(spark, C.merged_path(F.lit("a\\route_3\\7_merged"))) == "route_3/7_merged.csv"
    assert one(spark, C.merged_path(F.lit("7.csv"))) is None
    assert one(spark, C.sample_key(F.lit("r/sensor_claim_12_5_merged.csv"))) == "r/5"


def test_scan_cells(spark):
    got = one(spark, C.small_ids(C.scan_cells(F.lit("['Lte', 'Gsm', 'LTE', 'Lte']"), F.lit("[296, 1, 20000, 5]"), F.lit("[-70, -60, -50]"))))
    assert [(x["id"], x["rssi"]) for x in got] == [(296, -70)]
    assert one(spark, C.scan_cells(F.lit("[]"), F.lit("[]"), F.lit("[]"))) == []
    assert one(spark, C.string_list(F.lit("broken["))) == []
    sentinel = one(spark, C.scan_cells(F.lit("['Lte']"), F.lit("[1]"), F.lit(f"[{C.INVALID_RSSI}]")))
    assert sentinel == []


def test_positions(spark):
    assert one(spark, C.position(F.lit("(3, 9)"))).asDict() == {"start": 3, "end": 9}
    assert one(spark, C.position(F.lit("(9, 3)"))) is None
    assert one(spark, C.position(F.lit("(0, 199)"), 200)) is None
    assert one(spark, C.clipped(C.position(F.lit("(5, 9)")), F.lit(4))) is None


def test_intervals(spark):
    df = spark.createDataFrame([(1, 0, 400), (1, 400, 800), (1, 810, 1210)], "trace_id long, start_row long, end_row long")
    assert sorted((r["start_row"], r["end_row"]) for r in intervals.merged(df).collect()) == [(0, 800), (810, 1210)]
    pairs = spark.createDataFrame([(1, 0, 10), (1, 15, 20), (1, 22, 30), (1, 90, 99)], "trace_id long, start_row long, end_row long")
    assert sorted((r["start_row"], r["end_row"]) for r in intervals.paired_off(pairs, 6).collect()) == [(0, 20), (22, 30), (90, 99)]


def test_rates(spark):
    df = spark.createDataFrame([("a", 0.7), ("a", 0.8), ("a", 0.9), ("b", None)], "attack string, score double")
    got = {(r["attack"], r["threshold"]): r["far"] for r in report.false_accepts(df, "attack", "score", (0.8, 0.9)).collect()}
    assert got == {("a", 0.8): pytest.approx(2 / 3, abs=1e-6), ("a", 0.9): pytest.approx(1 / 3, abs=1e-6), ("b", 0.8): 0, ("b", 0.9): 0}


def test_nearest_prefers_the_smaller_id_on_ties(spark):
    left = spark.createDataFrame([(1, 10), (1, 0), (2, 5)], "trace_id long, at long")
    right = spark.createDataFrame([(1, 8, 7), (1, 12, 3), (1, 12, 2)], "trace_id long, at long, id long")
    got = {(r["trace_id"], r["at"]): (r["nearest_id"], r["nearest_gap"]) for r in joins.nearest(left, right, ["trace_id"], "at", "at", "id").collect()}
    assert got == {(1, 10): (2, 2), (1, 0): (7, 8), (2, 5): (None, None)}


def test_graph(spark):
    e = spark.createDataFrame([(0, 1, 1.0), (1, 2, 1.0), (0, 3, 9.0), (3, 2, 1.0), (7, 7, 1.0)], "src long, dst long, length double")
    assert {(r["src"], r["dst"]): r["distance"] for r in graph.hops(e).collect()}[(0, 2)] == 2
    assert {(r["src"], r["dst"]): r["path"] for r in graph.shortest_paths(e).collect()}[(0, 2)] == [0, 1, 2]
    assert {(r["src"], r["dst"]): r["length"] for r in graph.weighted(e).collect()}[(0, 3)] == 3


def test_scores(spark):
    df = spark.createDataFrame([(0.5, 0.6, 0.8)], "s_lte double, s_meg double, s_signal double")
    assert df.select(scores.weighted(scores.LOCATION).alias("x")).first()["x"] == pytest.approx(0.68)
    assert sum(scores.FUSION.values()) == pytest.approx(1)


def test_mutations_differ_from_the_truth(spark):
    df = spark.range(200).select("id", claims.mutated_regions(strings("e4", "d3"), F.col("id")).alias("x"), claims.mutated_time(F.lit(40.0), F.col("id")).alias("t"))
    for r in df.collect():
        assert r["x"][0] != "e4" and set(r["x"]) <= set(claims.REGIONS)
        assert 1 <= abs(r["t"] - 40) <= 10


def test_files(spark, tmp_path):
    folder = tmp_path / "route_007"
    folder.mkdir()
    (folder / "signal_3.csv").write_text("Time,Cell_Type,Cell_ID,Cell_RSSI\n18:27,\"['Lte', 'Gsm']\",\"[296, 117]\",\"[-73, -88]\"\n18:28,['Lte'],[x],[-63]\n")
    got = files.read_signals(spark, str(tmp_path)).orderBy("place").collect()
    assert [(r["route"], r["trace_id"]) for r in got] == [("route_007", "3")] * 2
    assert [(c["id"], c["rssi"]) for c in got[0]["cells"]] == [(296, -73)] and got[1]["cells"] == []
    out = str(tmp_path / "out")
    df = spark.createDataFrame([("a", 1), ("b", 2)], "attack string, x int")
    files.append_run(df, out, "1")
    files.append_run(df, out, "1")
    files.append_run(df, out, "2")
    assert spark.read.parquet(out).count() == 4
    with pytest.raises(Exception, match="(?i)exists"):
        files.write_table(df, f"{out}/run=1", "errorifexists")
    files.write_table(df, str(tmp_path / "by"), by=["attack"])
    assert spark.read.parquet(str(tmp_path / "by") + "/attack=a").count() == 1
    with pytest.raises(ValueError, match="missing"):
        files.required(df, ["y"])
    with pytest.raises(ValueError):
        files.weights_valid([0.5, 0.6])


def test_anchor_windows_by_brute_force(spark):
    """The detector against plain loops over one trace."""
    import numpy as np
    import pandas as pd

    from claimflow.functions import kernels as K
    from claimflow.operators import anchors

    rng = np.random.default_rng(6)
    n, how = 260, anchors.Detection(size=40, step=10, spacing=5, wobble_rows=8, gap=20)
    meg = np.cumsum(rng.normal(0, 0.2, n))
    meg[100:130] += rng.normal(0, 5, 30)
    rssi, ids = np.where(np.arange(n) % 5 == 0, -70 + rng.normal(0, 1, n), np.nan), np.where(np.arange(n) < 200, 1, np.arange(n) % 2)
    rows = [(1, i, float(meg[i]), None if np.isnan(rssi[i]) else float(rssi[i]), int(ids[i])) for i in range(n)]
    t = spark.createDataFrame(rows, "trace_id long, row_idx long, meg double, rssi double, cell long")
    got = {(r["start_row"], r["end_row"]) for r in anchors.flagged_windows(t, "meg", ["rssi"], ["cell"], how).collect()}

    d = pd.Series(meg).diff().rolling(5, min_periods=1).mean()
    z = (d - d.mean()) / d.std(ddof=0)
    signal = pd.Series(rssi).ffill().bfill().rolling(5, min_periods=1).mean()
    bare = z.dropna().to_numpy()
    up, down = bare[K.spaced_peaks(bare, 5)], bare[K.spaced_peaks(-bare, 5)]
    want = set()
    for start in range(0, n - 40 + 1, 10):
        w = z[start : start + 40]
        x = w.dropna().to_numpy()
        peaks, valleys = K.spaced_peaks(x, 5), K.spaced_peaks(-x, 5)
        magnetic = w.abs().mean() >= z.abs().mean() + 0.07 * z.abs().std() and x[peaks].max() >= up.mean() + 0.6 * up.std(ddof=1) and x[valleys].min() <= down.mean() - down.std(ddof=1) and pd.Series(x).rolling(8, min_periods=1).std().mean() >= 0.08
        cellular = signal[start : start + 40].std() > 2 or np.count_nonzero(np.diff(ids[start : start + 40])) / 39 > 0.02
        if magnetic or cellular:
            want.add((start, start + 40))
    assert got == want and 0 < len(want) < (n - 40) // 10
    # Segments: windows joined, recentred on the strongest activity, near ones paired, recentred again.
    az = z.abs().to_numpy()

    def recentred(spans):
        out = []
        for a, b in spans:
            c = a + int(np.nanargmax(az[a:b]))
            low = max(a, c - 20)
            out.append((low, min(low + 40, b)) if b - a > 40 else (a, b))
        return out

    joined = []
    for a, b in sorted(want):
        if joined and a <= joined[-1][1]:
            joined[-1] = (joined[-1][0], max(joined[-1][1], b))
        else:
            joined.append((a, b))
    paired = []
    for a, b in sorted(recentred(joined)):
        if paired and not paired[-1][2] and a - paired[-1][1] <= 20:
            paired[-1] = (paired[-1][0], b, True)
        else:
            paired.append((a, b, False))
    segments = anchors.anchor_segments(t, "meg", ["rssi"], ["cell"], how)
    assert sorted((r["start_row"], r["end_row"]) for r in segments.collect()) == sorted(recentred([x[:2] for x in paired]))
    # Features: rows by number, nulls where there is none.
    at = lambda x, i, low=0, high=n: None if not max(low, 0) <= i < min(high, n) or np.isnan(x[i]) else float(x[i])
    features = anchors.anchor_features(t, segments, "meg", 40, 12, 4, ["rssi", "cell"]).collect()
    edges = anchors.anchor_features(t, spark.createDataFrame([(1, 2, 30), (1, 230, 258)], "trace_id long, start_row long, end_row long"), "meg", 40, 12, 4, ["rssi", "cell"]).collect()
    assert len(features) == len(paired) and len(edges) == 2
    for r in features + edges:
        s, e = r["start_row"], r["end_row"]
        assert r["cur"] == [at(meg, s + p, s, e) for p in range(40)]
        assert r["pre"] == [at(meg, s - 40 + p) for p in range(40)]
        assert r["post"] == [at(meg, e + p) for p in range(40)]
        low = max(s - 4, 0)
        assert r["rssi"] == [at(rssi, low + p, low, s + 8) for p in range(12)]
        assert r["cell"] == [None if (v := at(ids, low + p, low, s + 8)) is None else int(v) for p in range(12)]


def test_pairs_in_chains(spark):
    """Two at a time along a chain of near segments, against a walk from left to right."""
    rng = np.random.default_rng(3)
    rows = []
    for t in range(30):
        at = 0
        for _ in range(rng.integers(1, 15)):
            at += int(rng.integers(1, 12))
            rows.append((t, at, at := at + int(rng.integers(1, 9))))
    got = sorted(map(tuple, intervals.paired_off(spark.createDataFrame(rows, "trace_id long, start_row long, end_row long"), 6).collect()))
    want = []
    for t in range(30):
        out = []
        for _, a, b in sorted(r for r in rows if r[0] == t):
            if out and not out[-1][2] and a - out[-1][1] <= 6:
                out[-1] = (out[-1][0], b, True)
            else:
                out.append((a, b, False))
        want += [(t, a, b) for a, b, _ in out]
    assert got == sorted(want)


def test_legs_that_are_not_connected(spark):
    edges = spark.createDataFrame([(0, 1, 4.0), (1, 2, 4.0), (8, 9, 1.0)], "src long, dst long, length double")
    legs = spark.createDataFrame([(1, 0, 2, 6.0), (1, 2, 1, 6.0), (2, 0, 1, 4.0), (2, 1, 9, 4.0)], "claim long, src long, dst long, walked double")
    got = {r["claim"]: r["s_length"] for r in scores.length_scores(legs, edges, "claim", strict=False).collect()}
    assert got == {1: pytest.approx(1.0), 2: 0.0}
    with pytest.raises(ValueError, match="1 and 9"):
        scores.length_scores(legs, edges, "claim")


def test_alignment_needs_its_target(spark):
    points = spark.createDataFrame([(1, 0, 0.0, 0.0)], "trace_id long, row_idx long, x double, y double")
    assert frames.aligned(points, 1).count() == 1
    with pytest.raises(ValueError, match="no path 5"):
        frames.aligned(points, 5)


def test_encodings_by_file(spark, tmp_path):
    """Each file of a folder under its own encoding."""
    folder = tmp_path / "route_001"
    folder.mkdir()
    text = lambda k: f"Time,Cell_Type,Cell_ID,Cell_RSSI\n0{k}:00,信号,[1],[-60]\n"
    for k in range(4):
        (folder / f"signal_{k}.csv").write_bytes(text(k).encode("gbk" if k % 2 else "utf-8-sig"))
    got = {r["trace_id"]: (r["Time"], r["Cell_Type"]) for r in files.read_csv(spark, str(folder), files.SIGNAL).collect()}
    assert got == {str(k): (f"0{k}:00", "信号") for k in range(4)}
    assert files.read_csv(spark, str(folder), files.SIGNAL, ("UTF-8",)).count() == 4


def test_graph_searches_have_no_depth(spark):
    """A path of 45 nodes from one end, and a dense graph; an unconnected pair raises."""
    chain = spark.createDataFrame([(i, i + 1, 2.0) for i in range(44)] + [(100, 101, 1.0)], "src long, dst long, length double")
    one = spark.createDataFrame([(0,)], "src long")
    far = {r["dst"]: r["distance"] for r in graph.hops(chain, one).collect()}
    assert far == {i: i for i in range(45)}
    pairs = spark.createDataFrame([(0, 9)], "src long, dst long")
    short = spark.createDataFrame([(i, i + 1, 2.0) for i in range(9)] + [(0, 5, 30.0), (100, 101, 1.0)], "src long, dst long, length double")
    assert graph.path_lengths(short, pairs).first()["length"] == 18.0
    with pytest.raises(ValueError, match="0 and 101"):
        graph.path_lengths(short, spark.createDataFrame([(0, 101)], "src long, dst long"))
    rng = np.random.default_rng(5)
    dense = spark.createDataFrame([(int(a), int(b)) for a, b in rng.integers(0, 1000, (8000, 2))], "src long, dst long")
    near = {r["dst"]: r["path"] for r in graph.shortest_paths(dense, one).collect()}
    links = {}
    for r in dense.collect():
        links.setdefault(r["src"], set()).add(r["dst"])
        links.setdefault(r["dst"], set()).add(r["src"])
    want, queue = {0: [0]}, [0]
    for node in queue:
        for n in sorted(links.get(node, ())):
            if n not in want:
                want[n] = want[node] + [n]
                queue.append(n)
    assert near == want


def test_seams_with_missing_headings(spark):
    """A heading that is missing at a seam takes the one before it, at the start the one after it."""
    full = [float(i * 11 % 360) for i in range(100)]
    gaps = [None if i in (0, 1, 39, 40, 60) else v for i, v in enumerate(full)]
    filled = [22.0 if i < 2 else full[{39: 38, 40: 38, 60: 59}.get(i, i)] for i in range(100)]
    make = lambda x: spark.createDataFrame([(1, i, v) for i, v in enumerate(x)], "trace_id long, row_idx long, h double")
    places = spark.createDataFrame([(1, "tail", 60), (1, "random0", 40), (1, "random1", 20)], "trace_id long, seam string, start long")
    got, want = ({r["seam"]: r["transition"] for r in scores.seam_scores(make(x), places, "h", 20).collect()} for x in (gaps, filled))
    assert got == {k: pytest.approx(v) for k, v in want.items()} and len(got) == 3


def test_closest_key_by_blocks(spark):
    refs = spark.createDataFrame([(i, ["a", "b", "cdef"[i % 4], str(i)]) for i in range(12)], "reference_id long, ref array<string>")
    claims = spark.createDataFrame([(i, ["a", "cdef"[i % 4], str(i % 13)]) for i in range(30)], "claim_id long, claimed array<string>")
    whole, dealt = ({r["claim_id"]: (r["reference_id"], r["likeness"]) for r in joins.closest_key(claims, refs, "claim_id", "claimed", "ref", n).collect()} for n in (100, 3))
    assert whole == dealt and len(whole) == 30


def test_block_distances_by_brute_force(spark):
    rng = np.random.default_rng(6)
    x, labels = rng.normal(size=(70, 5)), ["hot" if i % 3 else f"l{i % 4}" for i in range(70)]
    x[40] = x[7]
    df = spark.createDataFrame([(i, labels[i], [float(v) for v in x[i]]) for i in range(70)] + [(99, None, [0.0] * 5)], "vec_id long, label string, v array<double>")
    for by in ("label", None):
        found = distances.met(df, "vec_id", "label", ["v"], {"dist": distances.euclidean("v")}, by=by, nearest=4, block=16).collect()
        got = {(r["key"], r["other_label"]): (r["dist_total"], r["n"], r["dist_least"], r["dist_most"], [n["other"] for n in r["near"]]) for r in found}
        want = {}
        for i in range(70):
            for k in set(labels):
                d = {j: np.linalg.norm(x[i] - x[j]) for j in range(70) if j != i and labels[j] == k}
                if d and (by is None or k == labels[i]):
                    want[(i, k)] = (pytest.approx(sum(d.values())), len(d), pytest.approx(min(d.values())), pytest.approx(max(d.values())), sorted(d, key=lambda j: (d[j], j))[:4])
        assert got == want


def test_two_tables_meet_in_blocks(spark):
    rng = np.random.default_rng(7)
    x, y = rng.normal(size=(45, 3)), rng.normal(size=(38, 3))
    make = lambda a, n: spark.createDataFrame([(i, i % n, [float(v) for v in a[i]]) for i in range(len(a))], "id long, route int, v array<double>")
    found = distances.met(make(x, 4), "id", "route", ["v"], {"dist": distances.euclidean("v")}, by="route", nearest=2, block=3, right=make(y, 3)).collect()
    got = {r["key"]: (r["n"], r["dist_total"], [n["other"] for n in r["near"]]) for r in found}
    want = {}
    for i in range(45):
        d = {j: np.linalg.norm(x[i] - y[j]) for j in range(38) if j != i and j % 3 == i % 4}
        if d:
            want[i] = (len(d), pytest.approx(sum(d.values())), sorted(d, key=d.get)[:2])
    assert got == want


@pytest.mark.parametrize("block", [1000, 7])
def test_kmeans_on_a_matrix_in_tiles(spark, block):
    """The same states whatever the tiles, and three clear groups found."""
    rng = np.random.default_rng(8)
    x = np.concatenate([rng.normal(c, 0.3, size=(14, 4)) for c in (0, 5, 11)])
    df = spark.createDataFrame([(i * 3, [float(v) for v in x[i]]) for i in range(42)], "id long, v array<double>")
    tiles = distances.tiles(df, "id", ["v"], distances.euclidean("v"), block)
    assert tiles.count() == len({(r["rows"], r["cols"]) for r in tiles.collect()})
    got = {r["key"]: r["state"] for r in distances.kmeans_rows(tiles, 3, 6).collect()}
    assert got == {i * 3: i // 14 for i in range(42)}


def test_strips_hold_the_matrix(spark, monkeypatch):
    """A matrix that differs both ways, measured once for each two blocks, lies in strips of whole columns, piece by piece."""
    asked = []

    def measure(left, right):
        asked.append((len(left), len(right)))
        return distances.euclidean("v")(left, right)

    x = np.random.default_rng(11).normal(size=(23, 3))
    far = np.linalg.norm(x[:, None] - x[None], axis=2)
    pdf = pd.DataFrame({"key": range(23), "v": list(x), "high": far.max(1)})
    one = distances.fused(distances.scaled(measure, None, "high", True), distances.scaled(distances.euclidean("v"), None, "high", True))
    there, back = distances.both_ways(one, pdf[:9], pdf[9:])
    assert asked == [(9, 14)] and np.allclose(there, one(pdf[:9], pdf[9:])) and np.allclose(back, one(pdf[9:], pdf[:9])) and not np.allclose(there, back.T)
    df = spark.createDataFrame([(i, [float(v) for v in x[i]], float(far[i].max())) for i in range(23)], "key long, v array<double>, high double")
    scaled = distances.scaled(distances.euclidean("v"), None, "high", True)
    tiles = distances.tiles(df, "key", ["v", "high"], distances.fused(scaled, scaled), 7).cache()
    blocks = {r["rows"]: r["row_keys"] for r in tiles.where("rows = cols").orderBy("rows").collect()}
    keys = [k for b in sorted(blocks) for k in blocks[b]]
    monkeypatch.setattr(distances, "PIECE", 2 * 8 * 23)
    strips = distances._strips(tiles, {b: len(blocks[b]) for b in sorted(blocks)}, 5).collect()
    got = [np.frombuffer(r["cells"]).reshape(-1, 23) for r in sorted(strips, key=lambda r: r["strip"])]
    want = np.sqrt(0.3**2 + 0.7**2) * far / far.max(0)
    assert [len(c) for c in got] == [2, 2, 1] * 4 + [2, 1] and np.allclose(np.concatenate(got).T, want[np.ix_(keys, keys)])
    tiles.unpersist()


def test_lower_bounds_leave_the_nearest_as_they_are(spark, monkeypatch):
    """Most pairs are never warped, and the nearest few are those of all pairs, both ways and tile by tile."""
    rng = np.random.default_rng(12)
    x, e = rng.normal(size=(150, 6)) + np.arange(150)[:, None] % 5, rng.normal(size=(150, 3))
    w = np.where(np.eye(150), np.nan, K.warped(x, x))
    far = np.where(np.eye(150), np.nan, K.straight(e, e))
    ends = [(float(f(m[i])) for m in (w, far) for f in (np.nanmin, np.nanmax)) for i in range(150)]
    rows = [(i, i % 5, x[i].tolist(), e[i].tolist(), *ends[i]) for i in range(150)]
    df = spark.createDataFrame(rows, "key long, label int, meg array<double>, lte array<double>, meg_low double, meg_high double, lte_low double, lte_high double")
    measure = distances.fused_by_row("meg", "lte")
    left, right = (df.where(c).toPandas() for c in ("key < 60", "key >= 60"))
    there, back, exact = measure.lazily(left, right)
    i, j = (m.ravel() for m in np.indices(there.shape))
    want = distances.both_ways(measure, left, right)
    for low, got, full in zip((there, back), exact(i, j), (want[0], want[1].T), strict=True):
        assert np.allclose(got.reshape(full.shape), full, rtol=0, atol=1e-15) and (low <= full).all()
    kept = distances._Kept(left, right.sort_values(["label", "key"]), ["fused"], [], 3)
    kept.worst[:] = np.sort(want[0], 1)[:, 14:15]
    assert kept.may(slice(0, 60), slice(0, 90), there).mean() < 0.6
    plain = lambda a, b: measure(a, b)
    monkeypatch.setattr(distances, "TILE", (9, 14))
    told = [{(r["key"], r["other_label"]): (r["n"], [(n["other"], pytest.approx(n["distance"])) for n in r["near"]]) for r in distances.met(df, "key", "label", ["meg", "lte", "meg_low", "meg_high", "lte_low", "lte_high"], {"fused": f}, nearest=3, block=40, symmetric=False, stats=[]).collect()} for f in (measure, plain)]
    assert told[0] == told[1] and len(told[0]) == 750 and {n for n, _ in told[0].values()} == {29, 30}


def test_only_what_is_new_is_put_in_order(monkeypatch):
    """A tile that is near to one row sorts that row's few, not those of all rows."""
    sorted_, lexsort = [], np.lexsort
    monkeypatch.setattr(np, "lexsort", lambda keys: sorted_.append(len(keys[0])) or lexsort(keys))
    rows = pd.DataFrame({"key": range(50), "label": 0})
    kept = distances._Kept(rows, pd.DataFrame({"key": range(100, 120), "label": 0}), ["dist"], [], 3)
    d = np.random.default_rng(13).random((50, 20))
    d[:, 10:] += 1
    d[7, 15] = -1.0
    for at in (slice(0, 10), slice(10, 20)):
        kept.add(slice(0, 50), at, None, {"dist": d[:, at]})
    assert sorted_ == [150, 4]
    t = kept.table()
    assert [list(k) for k in t["near_k"]] == [list(100 + np.argsort(x)[:3]) for x in d] and [list(x) for x in t["near_d"]] == [sorted(x)[:3] for x in d.tolist()]
    assert (t["n"] == 20).all()


def test_a_block_meets_itself_once(spark, monkeypatch):
    """Pairs within a block are measured once for both rows, but for tiles on the diagonal; rows of one key do not meet."""
    monkeypatch.setattr(distances, "TILE", (10, 20))
    pairs = spark.sparkContext.accumulator(0)
    x = np.random.default_rng(14).normal(size=(100, 3))

    def measure(left, right):
        pairs.add(len(left) * len(right))
        return distances.euclidean("v")(left, right)

    df = spark.createDataFrame([(i // 2 if i < 20 else i, i % 3, [float(v) for v in x[i]]) for i in range(100)], "key long, label int, v array<double>")
    got = distances.met(df.where("key >= 20"), "key", "label", ["v"], {"dist": measure}, nearest=2).collect()
    assert pairs.value == 80 * 90 // 2
    for r in got:
        d = np.sort([np.linalg.norm(x[r["key"]] - x[j]) for j in range(20, 100) if j != r["key"] and j % 3 == r["other_label"]])
        assert (r["n"], r["dist_total"], r["dist_least"], r["dist_most"]) == (len(d), pytest.approx(d.sum()), pytest.approx(d[0]), pytest.approx(d[-1]))
        assert [n["distance"] for n in r["near"]] == pytest.approx(d[:2])
    twins = distances.met(df, "key", "label", ["v"], {"dist": measure}).groupBy("key").agg(F.sum("n").alias("n")).collect()
    assert {r["key"]: r["n"] for r in twins} == {r["key"]: 2 * 98 if r["key"] < 10 else 99 for r in twins} and len(twins) == 90


def test_drawn_templates(spark):
    df = spark.range(100).select(F.col("id").alias("k"), (F.col("id") % 3).alias("label"))
    few = distances.drawn(df, "k", "label", 5)
    assert {r["label"]: r["count"] for r in few.groupBy("label").count().collect()} == {0: 5, 1: 5, 2: 5}
    assert few.where("k >= 15").count() > 5 and sorted(few.collect()) == sorted(distances.drawn(df.repartition(4), "k", "label", 5).collect())


def test_windows_and_places(spark):
    df = spark.createDataFrame([(t, i, float(i)) for t, n in ((1, 23), (2, 4)) for i in range(n)], "trace_id long, row_idx long, value double")
    for size, step in ((5, 2), (3, 5), (4, 4)):
        got = {(r["trace_id"], r["start_row"]): r["m"] for r in frames.sliding_windows(df, size, step, {"m": F.avg("value")}).collect()}
        assert got == {(t, s): s + (size - 1) / 2 for t, n in ((1, 23), (2, 4)) for s in range(0, n - size + 1, step)}
    names = spark.createDataFrame([(str(i * 7919 % 500),) for i in range(500)], "name string")
    assert [r["name"] for r in frames.numbered(names.repartition(5), ["name"]).orderBy("position").collect()] == sorted(str(i) for i in range(500))


def test_files_below_a_root(spark, tmp_path):
    for path in ("route_004_a/sensor_1.csv", "route_004_a/signal_1.csv", "route_002/x/sensor_2.csv", "route_002/notes.txt"):
        (tmp_path / path).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / path).write_text("Time,Ore\n00:00:01:000,5\n")
    found = files.walk(spark, str(tmp_path))
    assert {(r["folder"], r["name"]) for r in found.collect()} == {("route_004_a", "sensor_1.csv"), ("route_004_a", "signal_1.csv"), ("x", "sensor_2.csv")}
    pairs = {r["folder"]: r["signal"] for r in files.pairs(found).collect()}
    assert pairs["x"] is None and pairs["route_004_a"].endswith("/signal_1.csv")
    assert files.marked_folder(found, "004") == "route_004_a" and files.marked_folder(found, "9") is None
    one = files.read_columns(spark, str(tmp_path / "route_004_a/sensor_1.csv"), "Time STRING, Ore DOUBLE", ["Ore"])
    assert [tuple(r) for r in one.collect()] == [(5.0,)]


def test_cells_in_either_form(spark):
    wide = spark.createDataFrame([(1, -50.0, None, -70.0)], "scan long, Cell_RSSI_1 double, Cell_RSSI_2 double, Cell_RSSI_10 double")
    lists = spark.createDataFrame([(1, [-50.0, None, -70.0])], "scan long, Cell_RSSI array<double>")
    got = [sorted(map(tuple, files.long_cells(df, ["scan"]).collect())) for df in (wide, lists)]
    assert got[0] == got[1] == [(1, 0, -50.0), (1, 2, -70.0)]


def test_attack_tables_and_rates(spark, tmp_path):
    df = spark.createDataFrame([("a", 1), ("b", 2)], "attack string, n long")
    files.write_attacks(df, f"{tmp_path}/out", "attack")
    assert spark.read.parquet(f"{tmp_path}/out/all").count() == 2 and spark.read.parquet(f"{tmp_path}/out/by/attack=b").first()["n"] == 2
    with pytest.raises(Exception, match="PATH_ALREADY_EXISTS"):
        files.write_attacks(df, f"{tmp_path}/out", "attack")
    files.rates_valid(0.0, 0.5, 1.0)
    with pytest.raises(ValueError):
        files.rates_valid(1.5)


def test_time_window_by_clock_or_since_start(spark):
    hour = 3_600_000
    df = spark.createDataFrame([(1, 10 * hour), (1, 12 * hour), (2, h := 20 * hour), (2, h + 90 * 60_000), (2, h + 3 * hour)], "trace_id long, ms long")
    got = sorted(map(tuple, frames.in_time_window(df, "ms", 1 * hour, 2 * hour).collect()))
    assert got == [(1, 12 * hour), (2, h + 90 * 60_000)]
    assert sorted(map(tuple, frames.in_time_window(df, "ms", 11 * hour, 13 * hour).collect())) == [(1, 12 * hour)]


def test_layout_by_turns(spark):
    """Right at the first corner, read backwards from its end; an unreached pair lies far off."""
    rows = [(0, 1, 1, [(0, 2.0), (1, 3.0)]), (2, 1, 2, [(0, 1.0), (-1, 4.0)]), (8, 9, 3, [(0, 1.0)])]
    paths = spark.createDataFrame(rows, "src long, dst long, seq long, turns array<struct<turn:int,length:double>>")
    got = {r["node"]: (round(r["x"], 6), round(r["y"], 6)) for r in graph.layout(paths).collect()}
    assert got[0] == (0, 0) and got[1] == (2, -3) and got[9] == (9999, 9999)
    # From node 1, heading down: right turn (the other way round of -1), 4 ahead, then 1 straight on.
    assert got[2] == (-3, -3)


def test_half_turns_are_the_same_from_both_sides(spark):
    import duckdb

    turns = [180.0, -180.0, 180.0 - 2**-44, -180.0 + 2**-44, 180.0 + 2**-44, 540.0 - 2**-43, 179.999, -0.5, 0.0, 359.5, -359.5]
    want = [duckdb.execute("SELECT fmod(fmod(?::DOUBLE + 180.0, 360.0) + 360.0, 360.0) - 180.0", [t]).fetchone()[0] for t in turns]
    df = spark.createDataFrame(list(enumerate(turns)), "i long, t double")
    assert [r["w"] for r in df.select("i", C.wrap180("t").alias("w")).orderBy("i").collect()] == want
    assert want[2] == -180.0


@pytest.mark.parametrize("name", ["angle_wrap", "rate_limited_heading"])
def test_headings_are_those_of_sql_to_the_last_bit(spark, tmp_path, name):
    """Half turns with a last bit too many, signed zeros, values below zero, and numbers that are none."""
    import duckdb

    from claimflow.plans import catalogue

    # 188.99 to 242.93 turns by -180.00000000000006 degrees; the third trace comes back to a heading of 0 but for a last bit.
    traces = [[188.99, 8.99, 14.0], [242.93000000000006, 62.93], [0.0, 2.85, 0.01, 359.3, 360.0, 0.0], [-1.5, -0.0, 3.1, -400.25], [1e300, float("inf"), 1.0, None, 2.0, float("nan"), 5.0]]
    traces.append([float(x) / 100 for x in np.random.default_rng(5).integers(0, 54000, 4000)])
    traces.extend([[a, round(a + 180.0, 2), a, round(a + 360.0, 2), a] for a in np.round(np.arange(0.0, 60.0, 0.37), 2).tolist()])
    rows = [(k, i, v) for k, t in enumerate(traces) for i, v in enumerate(t)]
    df = spark.createDataFrame(rows, "user_id long, i long, value double")
    events = df.select((F.col("user_id") * 10_000 + F.col("i")).alias("event_id"), F.timestamp_seconds("i").cast("timestamp_ntz").alias("ts"), "user_id", F.lit("view").alias("event_type"), "value", F.lit('{"k": 1}').alias("props"))
    events.coalesce(1).write.parquet(f"{tmp_path}/events.parquet")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet/*.parquet'")
    want = {r[:2]: repr(r[2]) for r in con.sql(catalogue.oracle_sql()[name]).fetchall()}
    got = {(r[0], r[1]): repr(r[2]) for r in catalogue.queries()[name](spark, str(tmp_path)).collect()}
    assert len(want) == len(rows) and {k: (want[k], got.get(k)) for k in want if want[k] != got.get(k)} == {}


def test_rows_are_copied_a_bounded_number_of_times(spark):
    df = spark.range(3000).select(F.col("id").alias("vec_id"), F.array(F.col("id").cast("double")).alias("v"))
    copies = lambda n: distances.dealt(df, "vec_id", None, None, ["v"], 10, copies=n).groupBy("key").count().agg(F.max("count")).first()[0]
    assert copies(None) == 300 and copies(distances.COPIES) == distances.COPIES


def test_tiles_of_two_blocks_add_up(spark, monkeypatch):
    rng = np.random.default_rng(8)
    x = np.round(rng.normal(size=(90, 6)), 1)
    df = spark.createDataFrame([(i, i % 5, [float(v) for v in x[i]]) for i in range(90)], "vec_id long, label int, v array<double>")
    told = []
    for tile, block in (((250, 2000), 1000), ((4, 7), 40)):
        monkeypatch.setattr(distances, "TILE", tile)
        measures = {("start", "whole"): distances.warped_starts("v", 3), "far": distances.euclidean("v")}
        found = distances.met(df, "vec_id", "label", ["v"], measures, nearest=3, block=block).collect()
        told.append({(r["key"], r["other_label"]): (r["n"], *[pytest.approx(r[f"{m}_{s}"]) for m in ("start", "whole", "far") for s in ("total", "least", "most")], [tuple(n) for n in r["near"]]) for r in found})
    assert told[0] == told[1] and len(told[0]) == 450
    d = K.warped(x[:, :3], x[5::5][:, :3])[0]
    row = next(r for r in found if r["key"] == 0 and r["other_label"] == 0)
    assert row["n"] == 17 and row["start_total"] == pytest.approx(d.sum()) and [n["distance"] for n in row["near"]] == sorted(d)[:3]


def test_marked_lists_give_the_same_ratio(spark):
    rng = np.random.default_rng(9)
    draw = lambda n: [None if x == 5 else "abcde"[x] for x in rng.integers(0, 6, n)]
    sizes = [(0, 0), (0, 3), (3, 0), (4, 5), (9, 60), (70, 12), (12, 61), (5, 90), *[(int(a), int(b)) for a, b in rng.integers(1, 12, (40, 2))]]
    df = spark.createDataFrame([(i, draw(a), draw(b)) for i, (a, b) in enumerate(sizes)], "i long, a array<string>, b array<string>")
    for r in df.select("i", C.lcs_ratio("a", "b").alias("want"), C.marked_ratio("a", C.marked("b")).alias("got")).collect():
        assert r["got"] == r["want"], r["i"]
    assert df.select(F.max(F.size(C.marked("b")["masks"]))).first()[0] == 5


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_anchor_features_ask_for_blocks(spark):
    """A segment asks for a few blocks of rows, not for each of its rows, and copes with gaps and with rows that a trace lacks."""
    from claimflow.operators import anchors

    held = [i for i in range(400) if i % 7]
    t = spark.createDataFrame([(1, i, float(i), -float(i)) for i in held], "trace_id long, row_idx long, v double, rssi double")
    segments = spark.createDataFrame([(1, 3, 12), (1, 100, 190), (1, 385, 400), (2, 5, 9)], "trace_id long, start_row long, end_row long")
    df = anchors.anchor_features(t, segments, "v", 20, 12, 4, ["rssi"])
    assert "Union" not in plan(df)
    got = {(r["trace_id"], r["start_row"]): r for r in df.collect()}
    at = lambda i, low, high, trace, sign=1.0: sign * i if trace == 1 and low <= i < high and i in held else None
    for k, s, e in segments.collect():
        r, low = got[k, s], max(s - 4, 0)
        assert r["cur"] == [at(s + p, s, e, k) for p in range(20)]
        assert r["pre"] == [at(s - 20 + p, 0, s, k) for p in range(20)]
        assert r["post"] == [at(e + p, e, 400, k) for p in range(20)]
        assert r["rssi"] == [at(low + p, low, s + 8, k, -1.0) for p in range(12)]


def test_rows_are_dealt_to_windows(spark):
    """Windows over the ends of ranges are whole, and those of a written table shuffle its rows once."""
    t = spark.createDataFrame([(k, i, float(i * k % 7)) for k in (1, 2) for i in range(95)], "trace_id long, row_idx long, v double")
    for size, step in ((20, 5), (7, 3), (3, 5)):
        parts = {"s": F.sum("v"), "items": F.sort_array(F.collect_list("row_idx"))}
        whole = frames.sliding_windows(t, size, step, parts)
        dealt = frames.sliding_windows(t, size, step, parts, 4)
        assert dealt._jdf.queryExecution().executedPlan().toString().count("Exchange") == 1
        assert sorted(map(tuple, dealt.collect())) == sorted(map(tuple, whole.collect()))
