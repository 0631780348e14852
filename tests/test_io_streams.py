import gzip
import json

from pyspark.sql import functions as F

from ostrakon.sources import readers as R
from ostrakon.sources import writers as W
from ostrakon.streaming import streams as S


def test_flat_files(spark, tmp_path):
    (tmp_path / "a.csv").write_text("id,x,y\n1,NaN,b\n2,2.5,\n")
    assert [tuple(r) for r in R.read_csv(spark, str(tmp_path / "a.csv"), "id long, x double, y string").collect()] == [(1, None, "b"), (2, 2.5, None)]
    with gzip.open(tmp_path / "l.txt.gz", "wt") as f:
        f.write("protein1 protein2 combined_score\na b 900\nc d x\ne f 100\n")
    assert R.read_links(spark, str(tmp_path / "l.txt.gz"), 400).collect()[0].combined_score == 900
    (tmp_path / "j.jsonl").write_text('{"a": 1}\n\n{"a": 2}\nbroken\n')
    assert sorted(r.a for r in R.read_jsonl(spark, str(tmp_path / "j.jsonl"), "a long").collect() if r.a is not None) == [1, 2]


def test_formats(spark, tmp_path):
    (tmp_path / "d.json").write_text(json.dumps({"dataset": {"theorems": [{"id": 1, "title": "a"}], "definitions": [{"id": 2, "title": "b"}]}}))
    got = R.read_document(spark, str(tmp_path / "d.json"), "dataset", ["theorems", "definitions", "others"], "id: long, title: string").collect()
    assert sorted((r.section, r.id) for r in got) == [("definitions", 2), ("theorems", 1)]
    (tmp_path / "f.fa").write_text(">P1 first\nACD\nEF\n>P2\nGG\n")
    assert sorted((r.id, r.sequence) for r in R.read_fasta(spark, str(tmp_path / "f.fa")).collect()) == [("P1", "ACDEF"), ("P2", "GG")]
    (tmp_path / "s.gmt").write_text("S1\turl\tA\tB\nS2\turl\tC\n")
    assert R.read_gmt(spark, str(tmp_path / "s.gmt")).count() == 3
    (tmp_path / "g.tsv").write_text("#h\n9606\tA\tT1\tE\t\n9606\tB\tT2\tE\tNOT x\n1\tC\tT1\tE\t\n")
    assert [r.gene for r in R.read_annotations(spark, str(tmp_path / "g.tsv"), "9606").collect()] == ["A"]
    (tmp_path / "o.obo").write_text("format-version: 1\n[Term]\nid: T:1\nis_a: T:2 ! x\nis_a: T:3\n[Term]\nid: T:2\n")
    assert sorted(map(tuple, R.read_obo(spark, str(tmp_path / "o.obo")).collect())) == [("T:1", "T:2"), ("T:1", "T:3")]
    (tmp_path / "y").mkdir()
    (tmp_path / "y" / "n.yaml").write_text("id: N1\ngenes: [a, b]\n")
    (tmp_path / "y" / "bad.yaml").write_text("a: [\n")
    assert [r.id for r in R.read_yaml_tree(spark, str(tmp_path / "y")).collect()] == ["N1"]
    assert R.resolve(["c"], {"a": [], "b": ["a"], "c": ["b", "a"]}) == ["a", "b", "c"]


def test_paper_graph(spark):
    m = spark.createDataFrame([("p1", "t", ["Ann B.", "C"], ["p2", "p1"]), ("p2", "u", ["ann b"], [])], "id string, title string, authors array<string>, references array<string>")
    nodes, edges = R.paper_graph(m)
    assert nodes.where("label = 'Author'").count() == 2 and edges.where("etype = 'CITES'").count() == 1 and edges.where("etype = 'WROTE'").count() == 3


def test_merge_runs_a_mean_over_batches(spark):
    now = F.lit("2024-01-01").cast("timestamp")
    base = spark.createDataFrame([("a", "b", "T", 1.0, 1)], "src string, dst string, etype string, value double, n_sources int").select("*", F.lit("x").alias("source"), now.alias("created_at"), now.alias("updated_at"), F.lit(True).alias("deprecated"))
    batch = lambda v: spark.createDataFrame([("a", "b", "T", v)], "src string, dst string, etype string, value double")
    out = W.merge_edges(W.merge_edges(base, batch(4.0), "y", "2024-02-01"), batch(7.0), "z", "2024-03-01").collect()
    assert len(out) == 1 and out[0].value == 4.0 and out[0].n_sources == 3 and not out[0].deprecated and str(out[0].updated_at).startswith("2024-03")


def test_snapshot_journal_properties(spark, tmp_path):
    nodes = spark.createDataFrame([("g:1", "G", {"a": "x"}, {"s": 1.0})], "id string, label string, props map<string,string>, num_props map<string,double>")
    edges = spark.createDataFrame([("g:1", "g:2", "T", 1.0), ("g:2", "g:1", "T", 2.0)], "src string, dst string, etype string, value double")
    assert sorted(map(tuple, W.snapshot(nodes, edges, str(tmp_path / "snap")).collect())) == [("edge", "T", 2), ("node", "G", 1)]
    new = W.set_node_properties(nodes, spark.createDataFrame([("g:1", {"s": 5.0, "t": 2.0})], "id string, num map<string,double>")).first()
    assert new.num_props == {"s": 5.0, "t": 2.0}
    for day in ("2024-01-01", "2024-01-20"):
        W.journal(edges, str(tmp_path / "log"), "T", "load", "s1", day)
    log = W.read_journal(spark, str(tmp_path / "log"))
    assert W.replay(log, "src string, dst string, etype string, value double", "T").agg(F.sum("value")).first()[0] == 6.0
    assert [r.n_edges for r in W.compact(log.withColumn("day", F.col("day").cast("string")), "2024-01-21").collect()] == [2]
    W.write_ranges(spark.range(100), "id", str(tmp_path / "r"), 4)
    assert spark.read.parquet(str(tmp_path / "r")).count() == 100
    W.write_edge_lists(nodes.unionByName(nodes.withColumn("id", F.lit("g:2"))), edges, str(tmp_path / "t"))
    assert spark.read.parquet(str(tmp_path / "t" / "edges")).count() == 2
    W.drop_all(spark, str(tmp_path / "t"))
    assert not (tmp_path / "t").exists()


def test_streams_equal_batches(spark, sf, tmp_path):
    events = spark.read.parquet(f"{sf}/events.parquet")
    (tmp_path / "in").mkdir()
    events.repartition(3).write.mode("overwrite").parquet(str(tmp_path / "in"))
    stream = S.read_stream(spark, str(tmp_path / "in"), events.schema)
    q = S.to_table(S.windowed(stream, "ts", "10 minutes", "1 hour", by=("event_type",)), "windows", str(tmp_path / "cp"), "complete")
    q.awaitTermination()
    key = lambda r: (r.start, r.event_type, r.n)
    assert sorted(map(key, spark.table("windows").collect())) == sorted(map(key, S.windowed(events, "ts", "10 minutes", "1 hour", by=("event_type",)).collect()))
    q = S.to_parquet(stream.select("event_id"), str(tmp_path / "out"), str(tmp_path / "cp2"))
    q.awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == events.count()


def test_service_and_loop(spark):
    s = S.GraphService(lambda: spark.range(5), "id")
    assert s.handle({"command": "ping"})["ok"] and s.handle({"command": "stats"})["rows"] == 5
    assert s.handle({"command": "walk_entity", "id": 3})["row"] == {"id": 3} and len(s.handle({"command": "walk_batch", "ids": [1, 2]})["rows"]) == 2
    assert not s.handle({"command": "nope"})["ok"] and s.handle({"command": "shutdown"})["ok"]
    state = {"x": 0.0}
    assert S.until_settled(lambda: state.update(x=(state["x"] + 1) / 2), lambda: state["x"], 0.1, 50)[-1] > 0.8
