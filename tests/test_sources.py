import json

import pytest
from pyspark.sql import functions as F

from burrow.functions import geometry as G
from burrow.operators import graph as GR
from burrow.operators import locate as L
from burrow.sources import catalogue as C
from burrow.sources import graphs as SG
from burrow.sources import mapping as SM
from burrow.sources import sinks, tables


@pytest.fixture
def experiment(tmp_path):
    for folder, names in {
        "session_10": ["pose.csv", "IMU_1.csv"],
        "session_2": ["Pose_b.csv", "pose_a.csv"],
        "session_1": ["other.txt"],
        "resources": ["Transform_Matrix.npy"],
        "output": ["x.csv"],
    }.items():
        (tmp_path / folder).mkdir()
        for name in names:
            (tmp_path / folder / name).write_text("x")
    (tmp_path / "session_1" / "pose_folder").mkdir()
    (tmp_path / "session_1" / "pose_folder" / "deep.bin").write_text("x")
    return str(tmp_path)


def test_catalogue(spark, experiment):
    files = C.files_under(spark, experiment)
    sessions = C.sessions_of(files)
    assert [r.session_id for r in sessions.orderBy("sort_key").collect()] == ["session_1", "session_2", "session_10"]
    matched = C.matched_sources(
        sessions,
        files,
        [
            {"source": "pose", "pattern": "^pose"},
            {"source": "imu", "pattern": "imu"},
            {"source": "matrix", "pattern": r"matrix\.npy$", "shared": True},
            {"source": "given", "path": "resources/Transform_Matrix.npy"},
        ],
    )
    got = {(r.session_id, r.source): (r.found_count, r.valid, (r.path or "").split("/")[-1]) for r in matched.collect()}
    assert got["session_2", "pose"] == (2, True, "Pose_b.csv")
    assert got["session_1", "pose"] == (1, True, "deep.bin")
    assert got["session_10", "imu"][:2] == (1, True)
    assert got["session_2", "imu"][:2] == (0, False)
    assert all(got[s, "matrix"][1] and got[s, "given"][1] for s in ("session_1", "session_2", "session_10"))
    report = C.availability(matched)
    assert {r.session_id: (r.valid, r.missing) for r in report.collect()} == {
        "session_1": (False, ["imu"]), "session_2": (False, ["imu"]), "session_10": (True, []),
    }
    total = C.availability_totals(report).first()
    assert (total.sessions, total.valid_sessions) == (3, 1)
    assert total.valid_rate == pytest.approx(100 / 3)
    assert C.availability_totals(report.where("false")).first().valid_rate == 0.0


def test_no_sessions(spark, tmp_path):
    (tmp_path / "output").mkdir()
    (tmp_path / "output" / "a.txt").write_text("x")
    with pytest.raises(ValueError):
        C.sessions_of(C.files_under(spark, str(tmp_path)))


GRAPHML = """<?xml version='1.0' encoding='utf-8'?>
<graphml xmlns="http://graphml.graphdrawing.org/xmlns">
  <key id="d0" for="edge" attr.name="weight" attr.type="double" />
  <key id="d1" for="node" attr.name="zone" attr.type="string" />
  <graph edgedefault="undirected">
    <node id="0"><data key="d1">hall</data></node>
    <node id="1" />
    <node id="02" />
    <edge source="0" target="1"><data key="d0">2.5</data></edge>
    <edge source="1" target="02" />
  </graph>
</graphml>"""
GEXF = """<?xml version='1.0' encoding='utf-8'?>
<gexf xmlns="http://www.gexf.net/1.2draft" version="1.2">
  <graph defaultedgetype="undirected" mode="static">
    <nodes>
      <node id="a" label="a"><attvalues><attvalue for="0" value="hall" /></attvalues></node>
      <node id="1" label="1" />
      <node id="2" label="2" />
    </nodes>
    <edges>
      <edge source="a" target="1" id="0" weight="2.5" />
      <edge source="1" target="2" id="1" />
    </edges>
  </graph>
</gexf>"""
GML = """graph [
  name "tiny"
  node [
    id 0
    label "x"
  ]
  node [
    id 1
    label "y"
  ]
  node [
    id 2
    label "z"
  ]
  edge [
    source 0
    target 1
    weight 2.5
  ]
  edge [
    source 1
    target 2
  ]
]
"""
FILES = {
    "graphml": (GRAPHML, {("0", "1"): 2.5, ("1", "2"): None}),
    "gexf": (GEXF, {("a", "1"): 2.5, ("1", "2"): None}),
    "gml": (GML, {("x", "y"): 2.5, ("y", "z"): None}),
    "edgelist": ("# made by hand\n00 1 {'weight': 2.5}\n1 2 {}\n", {("0", "1"): 2.5, ("1", "2"): None}),
}


@pytest.mark.parametrize("kind", list(FILES))
def test_graph_files(spark, tmp_path, kind):
    text, want = FILES[kind]
    for name in ("one", "two"):
        (tmp_path / f"{name}.{kind}").write_text(text)
    nodes, edges = SG.read_graphs(spark, str(tmp_path), kind)
    per = {r.graph_id: (r.num_nodes, r.num_edges) for r in GR.counts(nodes, edges).collect()}
    assert per == {f"one.{kind}": (3, 2), f"two.{kind}": (3, 2)}
    assert {(r.u, r.v): r.weight for r in edges.where(F.col("graph_id").startswith("one")).collect()} == want


def test_graph_attributes(spark, tmp_path):
    (tmp_path / "g.graphml").write_text(GRAPHML)
    nodes, _ = SG.read_graphml(spark, str(tmp_path))
    assert {r.node_id: r.attrs for r in nodes.collect()}["0"] == {"zone": "hall"}


def test_adjlist(spark, tmp_path):
    (tmp_path / "a.adjlist").write_text("# note\na b c\nb c\nlone\n")
    nodes, edges = SG.read_graphs(spark, str(tmp_path), "adjlist")
    assert sorted(r.node_id for r in nodes.collect()) == ["a", "b", "c", "lone"]
    assert sorted((r.u, r.v) for r in edges.collect()) == [("a", "b"), ("a", "c"), ("b", "c")]
    with pytest.raises(ValueError):
        SG.read_graphs(spark, str(tmp_path), "dot")


SQUARE = [[0.0, 0.0], [4.0, 0.0], [4.0, 4.0], [0.0, 4.0]]


def document(**changes):
    base = {
        "format_version": "3.0",
        "graph_builder": {"type": "tree", "config": {"height": 3}},
        "mappings": {"nodes": {"0": [SQUARE], "10": [SQUARE, SQUARE]}, "edges": {"0_10": [SQUARE]}},
        "metadata": {"total_nodes": 2},
    }
    return {**base, **changes}


def test_mapping_documents(spark, tmp_path):
    (tmp_path / "m.json").write_text(json.dumps(document(), indent=1))
    docs = SM.read_documents(spark, str(tmp_path))
    regions = SM.regions_of_documents(docs)
    rows = regions.orderBy("ord").collect()
    assert [r.region_id for r in rows] == ["node_0_region_0", "node_10_region_0", "node_10_region_1", "edge_0_10_region_0"]
    assert (rows[3].u, rows[3].v, rows[0].node_id) == ("0", "10", "0")
    assert G.measured(regions).orderBy("ord").first().area == 16.0
    nodes = spark.createDataFrame([("m.json", "0")], "map_id string, node_id string")
    edges = spark.createDataFrame([("m.json", "10", "0")], "map_id string, u string, v string")
    assert [(r.element_type, r.element) for r in SM.unknown_elements(regions, nodes, edges).collect()] == [("node", "10")]
    assert SM.repeated_regions(regions).isEmpty()
    again = SM.regions_of_documents(SM.documents(regions).withColumn("map_id", F.lit("m.json")))
    assert [r.points for r in again.orderBy("ord").collect()] == [r.points for r in rows]


@pytest.mark.parametrize(
    "changes",
    [
        {"format_version": "2.0"},
        {"mappings": {"nodes": {}, "edges": {}}},
        {"mappings": {"nodes": {"1": [SQUARE[:2]]}, "edges": {}}},
        {"mappings": {"nodes": {}, "edges": {"1_2_3": [SQUARE]}}},
    ],
)
def test_bad_documents(spark, tmp_path, changes):
    (tmp_path / "m.json").write_text(json.dumps(document(**changes)))
    with pytest.raises(Exception):
        SM.regions_of_documents(SM.read_documents(spark, str(tmp_path))).collect()


def test_regions_and_summary_written(spark, tmp_path):
    rows = [
        ("m", 0, "r", "rectangle", None, 1.0, 2.0, 3.0, 4.0, None, "node", "7", None, None),
        ("m", 1, "c", "circle", None, 0.0, 0.0, 2.0, None, None, "edge", None, "7", "8"),
    ]
    schema = (
        "map_id string, ord bigint, region_id string, kind string, points array<struct<x:double,y:double>>, cx double, cy double, "
        "a double, b double, angle double, element_type string, node_id string, u string, v string"
    )
    regions = spark.createDataFrame(rows, schema)
    SM.write_regions(G.measured(regions), str(tmp_path / "json"))
    assert sorted(map(tuple, SM.read_regions(spark, str(tmp_path / "json")).collect())) == sorted(rows, key=lambda r: r[1])
    SM.write_summary(G.measured(regions), str(tmp_path / "csv"))
    got = {r.region_id: r for r in spark.read.option("header", "true").csv(str(tmp_path / "csv")).collect()}
    assert (got["r"].element_id, float(got["r"].center_x), float(got["r"].area)) == ("7", 2.5, 12.0)
    assert got["c"].element_id == "7-8"


def test_wide_pose_to_long(spark):
    wide = spark.createDataFrame([("s", 0, 1.0, 2.0, 0.9, 3.0, 4.0)], "session_id string, frame_number bigint, Nose_x double, Nose_y double, Nose_likelihood double, Tail_x double, Tail_y double")
    assert sorted((r.bodypart, r.x, r.likelihood) for r in tables.long_pose(wide).collect()) == [("Nose", 1.0, 0.9), ("Tail", 3.0, None)]
    assert [r.bodypart for r in tables.long_pose(wide, ["Tail", "Ear"]).collect()] == ["Tail"]
    with pytest.raises(ValueError):
        tables.long_pose(wide, ["Ear"])


def test_orientation_samples_drop_gaps_before_numbering(spark):
    rows = [("s", 5, 1.0, 0.0, 0.0, 0.0), ("s", 6, None, 0.0, 0.0, 0.0), ("s", 7, 0.5, 0.0, 0.0, 0.0)]
    samples = spark.createDataFrame(rows, "session_id string, sample_no bigint, qw double, qx double, qy double, qz double")
    assert sorted((r.pos, r.sample_no) for r in tables.orientation_samples(samples).collect()) == [(0, 5), (1, 7)]


def test_calibration_checks(spark):
    good, flat = [1.0, 0, 0, 0, 1.0, 0, 0, 0, 1.0], [1.0, 2, 3, 2.0, 4, 6, 0, 0, 1]
    rows = [("a", [float(v) for v in good]), ("b", [float(v) for v in flat]), ("c", [1.0]), ("d", [float("nan")] * 9)]
    table = spark.createDataFrame(rows, "session_id string, h array<double>")
    usable, aside = tables.split_calibration(table)
    assert [r.session_id for r in usable.collect()] == ["a"]
    assert sorted(r.session_id for r in aside.collect()) == ["b", "c", "d"]
    assert tables.checked_calibration(usable).count() == 1
    with pytest.raises(Exception):
        tables.checked_calibration(table).collect()


def test_select_traces(spark):
    t = spark.createDataFrame([("s", 1, 0, 0.1, 1.0), ("s", 2, 0, 0.2, 2.0)], "session_id string, unit_id bigint, frame_number bigint, c double, s double")
    assert tables.select_traces(t).columns[-2:] == ["c", "s"]
    assert tables.select_traces(t, [], None).columns == ["session_id", "unit_id", "frame_number"]
    assert [r.c for r in tables.select_traces(t, ["C"], [2, 99]).collect()] == [0.2]


def test_session_table(spark, tmp_path):
    metrics = spark.createDataFrame(
        [("s", "time", 1, 2.0), ("s", "time", 0, 1.0), ("s", "explored", None, 50.0), ("t", "explored", None, None)],
        "session_id string, metric string, path_id bigint, value double",
    )
    counts = spark.createDataFrame([("s", 10), ("t", 4)], "session_id string, num_frames bigint")
    got = {r.session_id: r for r in sinks.session_table(metrics, counts, ["time", "explored"]).collect()}
    assert (got["s"].time, got["s"].explored, got["s"].num_frames) == ("[1.0,2.0]", "50.0", 10)
    assert got["t"].explored is None
    sinks.write_session_table(sinks.session_table(metrics, counts, ["time", "explored"]), str(tmp_path / "t"))
    assert spark.read.option("header", "true").csv(str(tmp_path / "t")).count() == 2
    sinks.write_metrics(metrics, str(tmp_path / "m"))
    assert spark.read.parquet(str(tmp_path / "m")).count() == 4


def test_frames_and_walks_written(spark, tmp_path):
    frames = spark.range(20).select(F.lit("s").alias("session_id"), F.col("id").alias("frame_number"))
    sinks.write_frames(frames, str(tmp_path / "f"), chunk_frames=5)
    assert spark.read.parquet(str(tmp_path / "f")).where("session_id = 's'").count() == 20
    walks = spark.createDataFrame([("g", 1, ["a", "b"])], "graph_id string, walk_id bigint, path array<string>")
    stats = GR.walk_statistics(GR.lengths_of(walks, F.lit("b")), ["graph_id"])
    sinks.write_walks(walks, stats, {"seed": 1, "target": None}, str(tmp_path / "w"))
    assert spark.read.json(str(tmp_path / "w" / "statistics")).first().success_rate == 1.0


def test_short_sessions_are_one_file(spark, tmp_path):
    n = F.col("id")
    frames = spark.range(2_000).select((n % 50).alias("session_id"), F.floor(n / 50).alias("frame_number"))
    sinks.write_frames(frames, str(tmp_path / "f"), chunk_frames=8)
    files = [len(list(folder.glob("*.parquet"))) for folder in (tmp_path / "f").glob("session_id=*")]
    ranges = int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert len(files) == 50 and sum(files) <= 50 + ranges - 1
    assert spark.read.parquet(str(tmp_path / "f")).distinct().count() == 2_000
    one = spark.range(2_000).select(F.lit(0).alias("session_id"), n.alias("frame_number"))
    sinks.write_frames(one, str(tmp_path / "g"), chunk_frames=8)
    assert len(list((tmp_path / "g" / "session_id=0").glob("*.parquet"))) > 1


def test_frames_are_written_as_spark_would_without_its_writer(spark, tmp_path, monkeypatch):
    """Odd names of sessions, and a session over many batches; no file of Hadoop's, so no process for each."""
    odd = ["a b", "é/ü", "50%", 'x="1"', "[k]^{z}", "c:\\d", "#?*'", "\x01\x7f", "", None, "long"]
    n = F.col("id")
    rows = spark.range(11 * 40).select(
        F.element_at(F.array(*map(F.lit, odd)), (n % 11 + 1).cast("int")).alias("session_id"),
        F.floor(n / 11).alias("frame_number"),
        F.when(n % 3 > 0, n / 7).alias("x"),
        F.timestamp_micros(n * 1_000_001).alias("ts"),
        F.array(n, n + 1).alias("units"),
        (n / 3).cast("decimal(12,4)").alias("cost"),
        F.lit(None).cast("string").alias("note"),
    )
    more = spark.range(3_000).select(F.lit("long").alias("session_id"), (n + 100).alias("frame_number"))
    rows = rows.unionByName(more, allowMissingColumns=True)
    monkeypatch.setattr(sinks, "ROWS_AT_ONCE", 700)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "500")
    try:
        sinks.write_frames(rows, str(tmp_path / "ours"), chunk_frames=1 << 20)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    monkeypatch.setattr(sinks, "_local_folder", lambda spark, path: None)
    sinks.write_frames(rows, str(tmp_path / "spark"), chunk_frames=1 << 20)
    ours, theirs = (spark.read.parquet(str(tmp_path / k)) for k in ("ours", "spark"))
    assert ours.schema.simpleString() == theirs.schema.simpleString()
    assert ours.exceptAll(theirs).isEmpty() and theirs.exceptAll(ours).isEmpty() and ours.count() == 3_440
    names = [sorted(x.name for x in (tmp_path / k).glob("session_id=*")) for k in ("ours", "spark")]
    assert names[0] == names[1] and len(names[0]) == 10
    files = [x.name for x in (tmp_path / "ours").rglob("*") if x.is_file()]
    assert all(x == "_SUCCESS" or x.startswith("part-") for x in files)
    for one in (tmp_path / "ours" / "session_id=long").glob("*.parquet"):
        frames = spark.read.parquet(str(one)).select("frame_number").toArrow().column(0).to_pylist()
        assert frames == sorted(frames)
    with pytest.raises(FileExistsError):
        monkeypatch.undo()
        sinks.write_frames(rows, str(tmp_path / "ours"))


def test_builder_mismatches(spark):
    stored = spark.createDataFrame([("a", "tree", {"height": "3"}), ("b", "tree", {"height": "3"}), ("c", "tree", {"height": "3"})], "map_id string, builder string, params map<string,string>")
    now = spark.createDataFrame([("a", "star", {"n": "4"}), ("b", "tree", {"height": "4"}), ("c", "tree", {"height": "3"})], "map_id string, builder string, params map<string,string>")
    regions = spark.createDataFrame([("c", "node", "1"), ("c", "node", "9")], "map_id string, element_type string, node_id string")
    nodes = spark.createDataFrame([("c", "1")], "map_id string, node_id string")
    got = sorted((r.map_id, r.reason, r.detail) for r in L.builder_mismatches(stored, now, regions, nodes).collect())
    assert got == [("a", "builder", "tree/star"), ("b", "parameter", "height"), ("c", "unknown node", "9")]


def test_pose_header_rows(spark, tmp_path):
    for session, x in (("s1", "1.5"), ("s2", "2.5")):
        (tmp_path / session).mkdir()
        (tmp_path / session / "pose.csv").write_text(
            f"scorer,net,net,net,net\nbodyparts,Nose,Nose,Nose,Tail\ncoords,x,y,likelihood,x\n0,{x},2,0.9,7\n1,NaN,3,0.1,8\n"
        )
    wide = tables.read_pose(spark, str(tmp_path / "*" / "pose.csv"))
    assert wide.columns == ["session_id", "frame_number", "Nose_x", "Nose_y", "Nose_likelihood", "Tail_x"]
    got = {(r.session_id, r.frame_number): r for r in tables.long_pose(wide, ["Nose"]).collect()}
    assert got["s2", 0].x == 2.5 and got["s1", 1].x is None and got["s1", 1].likelihood == 0.1 and len(got) == 4
    (tmp_path / "s2" / "pose.csv").write_text("scorer,net\nbodyparts,Ear\ncoords,x\n0,1\n")
    with pytest.raises(ValueError):
        tables.read_pose(spark, str(tmp_path / "*" / "pose.csv"))


def test_folders_without_files_and_whole_names(spark, tmp_path):
    (tmp_path / "session_1").mkdir()
    (tmp_path / "session_2").mkdir()
    (tmp_path / "session_1" / "x_matrix.npy").write_text("a")
    files = C.files_under(spark, str(tmp_path))
    sessions = C.sessions_of(files, C.folders_under(spark, str(tmp_path)))
    specs = [{"source": "any", "pattern": "npy$"}, {"source": "m", "path": "matrix.npy"}]
    got = {(r.session_id, r.source): r.valid for r in C.matched_sources(sessions, files, specs).collect()}
    assert got == {("session_1", "any"): True, ("session_2", "any"): False, ("session_1", "m"): False, ("session_2", "m"): False}


def test_data_sources(spark):
    from burrow.operators import hooks

    @hooks.data_source("doubled", ["twice"])
    def _doubled(frames):
        return frames.withColumn("twice", F.col("x") * 2)

    @hooks.data_source("lossy", ["y"])
    def _lossy(frames):
        return frames.drop("x")

    df = spark.createDataFrame([("s", i * 3, float(i)) for i in range(20)], "session_id string, frame_number bigint, x double")
    try:
        assert hooks.with_sources(df, [("doubled", {})]).where("twice = x * 2").count() == 20
        for name in ("lossy", "nothing"):
            with pytest.raises(ValueError):
                hooks.with_sources(df, [(name, {})])
    finally:
        del hooks.DATA_SOURCES["doubled"], hooks.DATA_SOURCES["lossy"]

    def summed(rows):
        rows["near"] = rows["x"].rolling(3, min_periods=1, center=True).sum()
        return rows

    schema = "session_id string, frame_number bigint, x double, _home boolean, near double"
    got = {r.frame_number: r.near for r in hooks.per_chunk(df, summed, schema, halo=1, chunk_frames=4).collect()}
    assert got == {i * 3: float(sum(j for j in (i - 1, i, i + 1) if 0 <= j < 20)) for i in range(20)}


def test_the_list_of_files_is_made_once(spark, experiment):
    files = C.files_under(spark, experiment)
    assert files.count() == 8 and not any(experiment in f for f in files.inputFiles())
