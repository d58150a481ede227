import math
import threading
from http.server import BaseHTTPRequestHandler, HTTPServer
import json

import pytest
from pyspark.sql import functions as F

from quern.functions import embed, jsontext, providers
from quern.functions import text as T
from quern.functions import vectors as V
from quern.operators import chunking, docstatus, extraction, graph, hotkeys, merging, prompting, retrieval, store
from quern.operators import vector_search as VS
from quern.operators.prompting import QueryParam
from quern.plans import knowledge, skew
from quern.sources import snapshots
from quern.streaming import ingest


def words(n):
    return " ".join(f"w{i}" for i in range(n))


def rows(df, *order):
    return [tuple(r) for r in df.orderBy(*order).collect()]


@pytest.mark.parametrize("n, size, overlap, expected", [
    (231, 50, 10, [50] * 5 + [31]), (120, 30, 5, [30] * 4 + [20]), (500, 60, 10, [60] * 9 + [50]), (40, 40, 5, [40]), (41, 40, 5, [40, 6]), (0, 40, 5, [])])
def test_token_windows(spark, n, size, overlap, expected):
    out = chunking.by_tokens(spark.createDataFrame([("d", words(n))], "id string, t string"), "id", "t", size, overlap)
    assert [r["tokens"] for r in out.orderBy("chunk_order_index").collect()] == expected


def test_character_windows_and_bad_sizes(spark):
    df = spark.createDataFrame([("d", "A" * 1000), ("e", " \t\n"), ("f", None)], "id string, t string")
    out = chunking.by_characters(df, "id", "t", 20, 5).orderBy("chunk_order_index").collect()
    assert len(out) == 17 and len(out[-1]["content"]) == 40 and {r["tokens"] for r in out} == {1}
    with pytest.raises(ValueError):
        chunking.by_tokens(df, "id", "t", 5, 5)


def test_paragraphs(spark):
    df = spark.createDataFrame([("d", "p one\n\n \n\np" + "x" * 25 + "\n\nlast")], "id string, t string")
    assert [r["content"] for r in chunking.by_paragraphs(df, "id", "t", 10).orderBy("chunk_order_index").collect()] == ["p one", "p" + "x" * 9, "x" * 10, "x" * 6, "last"]
    assert [r["tokens"] for r in chunking.by_paragraphs(df, "id", "t", None).orderBy("chunk_order_index").collect()] == [2, 1, 1]


def test_greedy_packing(spark):
    sizes = [16, 18, 14, 19, 15, 12, 15, 15, 15, 16, 17, 16]
    df = spark.createDataFrame([([words(n) for n in sizes],)], "a array<string>")
    out = df.select(chunking.pack_greedily(F.col("a"), 80).alias("p")).first()["p"]
    assert [len(w) for w in out] == [4, 5, 3]
    forced = spark.createDataFrame([([words(60), words(60), words(5)],)], "a array<string>")
    assert [len(w) for w in forced.select(chunking.pack_greedily(F.col("a"), 80).alias("p")).first()["p"]] == [2, 1]


def test_unicode_space_and_truncation(spark):
    text = "a b　c d\n e"
    r = spark.createDataFrame([(text,)], "t string").select(T.token_count(F.col("t")), T.truncate_tokens(F.col("t"), 2), T.truncate_tokens(F.col("t"), 9), T.truncate_tokens(F.col("t"), 0), T.trim(F.lit(" \n x\t"))).first()
    assert tuple(r) == (5, "a b", text, "", "x")


def test_store(spark):
    kv = spark.createDataFrame([("a", 1), ("b", 2)], "id string, v int")
    ids = spark.createDataFrame([(x,) for x in ("a", "b", "c", "d", "x", "x")], "id string")
    assert rows(store.filter_missing(ids, kv, "id"), "id") == [("c",), ("d",), ("x",)]
    assert store.filter_missing(ids, kv, "id", distinct=False).count() == 4
    assert rows(store.get_by_ids(kv, ids, "id"), "id") == [("a", 1), ("b", 2)]
    new = spark.createDataFrame([("b", 3, 1), ("b", 4, 2), ("c", 5, 1)], "id string, v int, seq int")
    assert rows(store.upsert(kv.withColumn("seq", F.lit(0)), new, "id", "seq").select("id", "v"), "id") == [("a", 1), ("b", 4), ("c", 5)]
    assert rows(store.delete(kv, ids.limit(1), "id"), "id") == [("b", 2)]
    lists = spark.createDataFrame([("k", ["b", "zz", "a"])], "k string, ids array<string>")
    text = spark.createDataFrame([("a", "A"), ("b", " ")], "id string, c string")
    assert rows(store.fetch_ordered(lists, "k", "ids", text, "id", "c"), "pos") == [("k", 2, "a", "A")]
    assert [r[3] for r in rows(store.fetch_ordered(lists, "k", "ids", text, "id", "c", True), "pos")] == [" ", "", "A"]


def test_doc_status(spark):
    now = F.lit("2026-05-09 12:00:00").cast("timestamp")
    docs = spark.createDataFrame([(1, "one", "p"), (2, "one", "q"), (3, "two", "r"), (4, None, "s")], "i int, text string, path string")
    first = docstatus.enqueue(spark.createDataFrame([], "doc_id string"), docs, "text", "path", "i", now)
    assert sorted(r["file_path"] for r in first.collect()) == ["p", "r"]
    assert docstatus.enqueue(first, docs, "text", "path", "i", now).count() == 0
    change = first.select("doc_id", F.lit("processing").alias("to_status"))
    moved = docstatus.transition(first, change, now)
    assert {r["status"] for r in moved.collect()} == {"processing"}
    with pytest.raises(docstatus.InvalidTransition):
        docstatus.transition(moved, change, now)
    assert sum(r["ok"] for r in spark.createDataFrame([(a, b) for a in docstatus.STATES for b in docstatus.STATES], "a string, b string").select(docstatus.is_valid(F.col("a"), F.col("b")).alias("ok")).collect()) == 5
    events = spark.createDataFrame([("u", i, t) for i, t in enumerate(["processed", "processing", "failed", "failed", "processing", "processed", "processing"])], "u string, i int, t string")
    for width in (1, 3, 100):
        out = docstatus.fold(events, "u", F.col("t"), ["i"], F.floor(F.col("i") / width))
        assert rows(out, "u") == [("u", "processed", 4)]


def test_vectors(spark):
    df = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [1.0, 1.0]), ("c", [0.0, 0.0]), ("d", [2.0, 0.0])], "id string, vector array<float>")
    top = VS.top_k(df, [1.0, 0.0], 3)
    assert [r["id"] for r in top.collect()] == ["a", "d", "b"]
    assert VS.top_k(df, [1.0, 0.0], 0).count() == 0
    assert [r["id"] for r in VS.top_k(df, [1.0, 0.0], 9, threshold=0.99).collect()] == ["a", "d"]
    q = spark.createDataFrame([(0, [0.0, 1.0]), (1, [1.0, 0.0])], "query_id int, query_vector array<double>")
    for block in (1, 10):
        assert rows(VS.top_k_batch(df, q, 1, largest=block).select("query_id", "id"), "query_id") == [(0, "b"), (1, "a")]
    with pytest.raises(VS.DimensionMismatch):
        VS.upsert(df, spark.createDataFrame([("x", [1.0])], "id string, vector array<float>"))
    assert VS.dimension(df) == 2
    r = df.select("id", V.cosine(F.col("vector"), F.array(F.lit(1.0))).alias("c"), V.normalise(F.col("vector")).alias("n")).orderBy("id").collect()
    assert {x["c"] for x in r} == {0.0} and list(r[2]["n"]) == [0.0, 0.0] and abs(r[1]["n"][0] - math.sqrt(0.5)) < 1e-9


def test_embedders(spark):
    v = spark.createDataFrame([("some text",), ("",)], "t string").select(embed.counter(F.col("t"), 40).alias("c"), embed.tiled(F.col("t"), 40).alias("t"), embed.words(F.col("t"), 8).alias("w")).collect()
    assert max(abs(a - b) for a, b in zip(v[0]["c"], embed.counter_vector("some text", 40))) < 1e-12
    assert abs(sum(x * x for x in v[0]["t"]) - 1) < 1e-9 and v[0]["t"][0] == v[0]["t"][32]
    assert v[0]["w"][0] == v[0]["w"][7] and list(v[1]["w"]) == [0.0] * 8


EDGES = [("Ada", "Root"), ("Root", "Ben"), ("Cleo", "Root"), ("Ada", "Dov"), ("Ben", "Cleo"), ("Cleo", "Eli"), ("Dov", "Fay"), ("Root", "Root"), ("", "Ben"), ("Root", "Ada")]


def test_graph(spark):
    rel = spark.createDataFrame(EDGES, "src_id string, tgt_id string")
    edges = graph.edge_set(rel)
    assert edges.count() == 7
    assert dict(rows(graph.degree(edges), "name"))["Cleo"] == 3
    out = graph.search(edges, "Root", 2, 5)
    assert [r[0] for r in rows(out, "pos")] == ["Root", "Cleo", "Ada", "Ben", "Dov"]
    assert rows(graph.induced(edges, out), "a", "b") == [("Ada", "Dov"), ("Ada", "Root"), ("Ben", "Cleo"), ("Ben", "Root"), ("Cleo", "Root")]
    assert graph.search(edges, "nobody", 2, 5).count() == 0 and rows(graph.search(edges, "Root", 0, 5), "pos") == [("Root", 0, 0)]
    with pytest.raises(graph.InvalidEdge):
        graph.keyed(rel, strict=True)
    nodes = spark.createDataFrame([("Root",), ("Zoe",)], "name string")
    assert rows(graph.degree(edges, nodes), "name") == [("Root", 3), ("Zoe", 0)]
    assert graph.with_endpoints(nodes, edges).count() == 8
    near = rows(graph.expand(edges, nodes, 3), "pos")
    assert near == [("Root", "Root", 0), ("Root", "Cleo", 1), ("Root", "Ada", 2)]


def test_extraction(spark):
    text = ('("entity"<|#|>Birch Works<|#|>Company<|#|>A firm)\n("entity"<|#|>"Mara Lind"<|#|>person<|#|>A founder)\n("relation"<|#|>Mara Lind<|#|>Birch Works<|#|>founder<|#|>He founded it)\n'
            "entity<|#|>short<|#|>x\nfoo<|#|>a<|#|>b<|#|>c<|#|>d\nentity<|#|><|#|>t<|#|>d\n<|COMPLETE|>")
    p = extraction.records(spark.createDataFrame([(1, text), (2, ""), (3, None)], "i int, t string"), "i", "t")
    assert rows(extraction.entities(p).select("name", "type", "description"), "name") == [("Birch Works", "company", "A firm"), ("Mara Lind", "person", "A founder")]
    assert rows(extraction.relations(p).select("src_id", "tgt_id", "weight"), "src_id") == [("Mara Lind", "Birch Works", 1.0)]
    cache = spark.createDataFrame([], "cache_key string, raw string")
    chunks = spark.createDataFrame([("c1", "same"), ("c2", "same"), ("c3", "other")], "chunk_id string, content string")
    reply = "entity<|#|>N<|#|>t<|#|>d"
    ents, _, fresh = extraction.extract(chunks, lambda q: q.select("cache_key", F.lit(reply).alias("raw")), cache)
    assert fresh.count() == 2 and rows(ents.select("id", "source_ids"), "id") == [("c1", ["c1"]), ("c2", ["c2"]), ("c3", ["c3"])]
    again = extraction.extract(chunks, lambda q: q.select("cache_key", F.lit("").alias("raw")), fresh)
    assert again[0].count() == 3 and again[2].count() == 0
    first = spark.createDataFrame([("c", "A", "t", "d"), ("e", "B", "t", "d")], "id string, name string, type string, description string")
    asked = []

    def follow(active, n):
        asked.append(sorted(r["id"] for r in active.collect()))
        return spark.createDataFrame([("c", "A", "t", "x"), ("c", "C", "t", "x"), ("e", "B", "t", "x")], "id string, name string, type string, description string") if n == 1 else first

    assert rows(extraction.glean(first, follow, 2).select("id", "name", "round"), "id", "name") == [("c", "A", 0), ("c", "C", 1), ("e", "B", 0)]
    assert asked == [["c", "e"], ["c"]]


def test_merging(spark):
    m = spark.createDataFrame([(1, "X", "a", "one", ["c2", "c1"]), (2, "X", "b", "two", ["c1"]), (3, "X", None, None, None), (4, "", "a", "z", ["c"])], "i int, name string, type string, description string, source_ids array<string>")
    assert rows(merging.merge_entities(m, ["i"]), "name") == [("X", "a", 3, 2, 2, "one\n\ntwo")]
    r = spark.createDataFrame([(1, "S", "M", "k", "d1", 1.5, ["c1"]), (2, "M", "S", "k2", "d2", 0.5, ["c2"]), (3, "M", "S", "k", None, None, None), (4, "M", "M", "k", "d", 9.0, [])],
                              "i int, src_id string, tgt_id string, keywords string, description string, weight double, source_ids array<string>")
    assert rows(merging.merge_relations(r, ["i"]), "src_id") == [("M", "S", 2.0, "k,k2", 3, 2, "d1\n\nd2")]
    many = spark.createDataFrame([(i, "X", words(20)) for i in range(40)] + [(99, "Y", "only")], "i int, name string, t string")
    out = dict((a, (b, c)) for a, b, c in rows(merging.summarise(many, "name", "t", ["i"], lambda ts: F.concat(F.lit("sum of "), F.size(ts)), context=100), "name"))
    assert out["Y"] == ("only", False) and out["X"][1]


def test_summaries_keep_all_blocks_of_the_last_round(spark):
    big = spark.createDataFrame([(i, "X", f"t{i}") for i in range(9000)] + [(i, "Z", f"z{i}") for i in range(7)], "i int, name string, t string")
    out = merging.summarise(big, "name", "t", ["i"], lambda ts: F.array_join(ts, " "), budget=1, context=1).collect()
    assert {r["name"]: sorted(r["description"].split()) for r in out} == {"X": sorted(f"t{i}" for i in range(9000)), "Z": sorted(f"z{i}" for i in range(7))} and len(out) == 2


def test_description_lines_of_hot_pairs(spark, tmp_path):
    hot = [(f"r{i}", *(("A", "B") if i % 2 else ("B", "A")), f"d{i % 1500}") for i in range(2500)]
    data = hot + [("s1", "C", "D", "y"), ("s2", "D", "C", 'x"'), ("s3", "C", "C", "loop"), ("s4", "C", "E", "")]
    schema = "rel_id string, src_id string, tgt_id string, description string, extracted_at timestamp_ntz"
    spark.createDataFrame([(*x, None) for x in data], schema).write.parquet(f"{tmp_path}/relations.parquet")
    out = {}
    for r in knowledge.description_line_blocks(spark, str(tmp_path)).collect():
        lines = [json.loads(x)["Description"] for x in r["lines"].split("\n")]
        assert lines == sorted(lines) and len(lines) == r["n_descriptions"] < 1200
        out.setdefault((r["a"], r["b"]), []).append(lines)
    assert set(out) == {("A", "B"), ("C", "D")} and out["C", "D"] == [['x"', "y"]] and len(out["A", "B"]) == 3
    assert sorted(x for b in out["A", "B"] for x in b) == sorted(x[3] for x in hot)


def test_keywords(spark):
    plain = '{"high_level_keywords": ["a ", ""], "low_level_keywords": ["b"]}'
    texts = [plain, f"```json\n{plain}\n```", f"Sure: {plain} - done", '{"highLevelKeywords": ["a"], "lowLevelKeywords": ["b"]}', "nothing", "{broken", None]
    out = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", jsontext.keywords(F.col("t")).alias("k")).orderBy("i").collect()
    assert [(list(r["k"]["high"]), list(r["k"]["low"])) for r in out] == [(["a"], ["b"])] * 4 + [([], [])] * 3
    r = spark.createDataFrame([('x {"a": {"b": 1}} y',)], "t string").select(jsontext.first_object(F.col("t")), jsontext.or_query(F.array().cast("array<string>"), F.lit("q")), jsontext.fill("{a}-{b}", a=F.lit("{b}"), b=F.lit("c"))).first()
    assert tuple(r) == ('{"a": {"b": 1}}', ["q"], "{b}-c")


def test_packing_rows_and_prompt(spark):
    df = spark.createDataFrame([("g", i, n) for i, n in enumerate([5, 4, 9, 1])], "g string, pos int, n int")
    for budget, kept in ((10, [0, 1]), (9, [0, 1]), (5, [0]), (4, [0]), (0, [])):
        assert [r["pos"] for r in prompting.pack_rows(df, budget, ["g"], "pos", "n").orderBy("pos").collect()] == kept
    prompt, packed = prompting.assemble("q", [words(20)], [words(20)], [("a", words(30)), ("b", words(30))], QueryParam(max_total_tokens=80))
    assert packed == ["a"] and len(prompt.split()) <= 80
    assert QueryParam(mode="", top_k=-1).with_defaults() == QueryParam()


def test_retrieval_modes(spark):
    chunks = spark.createDataFrame([("c1", "one"), ("c2", "two"), ("c3", " "), ("c4", "four")], "chunk_id string, content string")
    ents = spark.createDataFrame([("A", "p", "d", ["c1", "c3"]), ("B", "p", "d", ["c2"])], "name string, type string, description string, source_ids array<string>")
    rels = spark.createDataFrame([("A", "B", "k", "d", ["c4", "c1"])], "a string, b string, keywords string, description string, source_ids array<string>")
    vec = lambda x: [1.0, float(x)]
    s = retrieval.Stores(chunks, spark.createDataFrame([("c1", vec(0)), ("c2", vec(1)), ("gone", vec(2))], "id string, vector array<double>"),
                         spark.createDataFrame([("e1", vec(0), "A"), ("e2", vec(5), "unknown")], "id string, vector array<double>, entity_id string"),
                         spark.createDataFrame([("r1", vec(0), "B", "A", "k", "d", ["c4"])], "id string, vector array<double>, src_id string, tgt_id string, keywords string, description string, source_ids array<string>"), ents, rels)
    ask = lambda mode, **k: retrieval.answer(s, "q", lambda t: vec(0), QueryParam(mode=mode, **k), lambda p: "ok")
    assert ask("naive")["references"] == ["c1", "c2"]
    assert ask("local")["references"] == ["c1", "c2", "c4"]
    assert ask("global")["references"] == ["c4", "c2", "c1"]
    assert ask("hybrid")["references"] == ["c1", "c2", "c4"]
    assert ask("hybrid", chunk_top_k=1)["references"] == ["c1"]
    with pytest.raises(ValueError):
        ask("mixed")
    with pytest.raises(ValueError):
        retrieval.references(retrieval.Stores(chunks), "q", vec, QueryParam(mode="local"))
    docs = spark.createDataFrame([("d", "p1\n\np2")], "doc_id string, text string")
    empty = spark.createDataFrame([], "chunk_id string, doc_id string, content string, tokens int, chunk_order_index int")
    index = spark.createDataFrame([], "namespace string, id string, vector array<float>")
    c, v = retrieval.insert(docs, "doc_id", "text", lambda t: embed.counter(t, 8), empty, index)
    c2, v2 = retrieval.insert(spark.createDataFrame([("d", "p1")], "doc_id string, text string"), "doc_id", "text", lambda t: embed.counter(t, 8), c, v)
    assert (c.count(), v.count(), c2.count(), v2.count()) == (2, 2, 1, 1)


class _Fake(BaseHTTPRequestHandler):
    plan: list = []

    def do_POST(self):
        body = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
        status = self.plan.pop(0) if self.plan else 200
        reply = ({"data": [{"index": i, "embedding": [float(len(t))]} for i, t in reversed(list(enumerate(body["input"])))]} if "input" in body
                 else {"choices": [{"message": {"content": f"{len(body['messages'])}:{body['messages'][-1]['content']}"}}], "usage": {"prompt_tokens": 3, "completion_tokens": 2}})
        self.send_response(status)
        self.end_headers()
        self.wfile.write(json.dumps(reply).encode())

    def log_message(self, *_):
        pass


def test_http_providers(spark):
    server = HTTPServer(("127.0.0.1", 0), _Fake)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    e = providers.Endpoint(f"http://127.0.0.1:{server.server_port}", "m", first_delay=0.01, batch_size=2)
    _Fake.plan = [429, 429, 200]
    assert providers.post(e, "/chat/completions", {"messages": [{"content": "x"}]})["usage"]["prompt_tokens"] == 3
    _Fake.plan = [401]
    with pytest.raises(providers.ProviderError):
        providers.post(e, "/chat/completions", {"messages": [{"content": "x"}]})
    q = spark.createDataFrame([(1, "s", "u"), (2, "", "v")], "i int, system string, user string").coalesce(1)
    assert rows(providers.complete(q, e, "i"), "i") == [(1, "2:u", 3, 2), (2, "1:v", 3, 2)]
    t = spark.createDataFrame([(i, "x" * i) for i in range(5)], "i int, t string").coalesce(1)
    assert [r[1][0] for r in rows(providers.embed(t, e, "i", "t"), "i")] == [0, 1, 2, 3, 4]
    server.shutdown()
    with pytest.raises(ValueError):
        providers.pick("none")


def test_snapshots_and_json(spark, tmp_path):
    s = snapshots.Snapshots(spark, f"file://{tmp_path}/store", "kv")
    assert s.read("id string, v int").count() == 0
    s.commit(spark.createDataFrame([("a", 1)], "id string, v int"))
    s.commit(store.upsert(s.read("id string, v int"), spark.createDataFrame([("a", 2), ("b", 3)], "id string, v int"), "id"))
    assert rows(s.read("id string, v int"), "id") == [("a", 2), ("b", 3)] and s.version() == 2
    # A version without a pointer, as a writer that failed leaves it, is not seen.
    spark.createDataFrame([("z", 9)], "id string, v int").write.parquet(f"{tmp_path}/store/namespace=kv/v=3")
    assert s.version() == 2 and s.commit(s.read("id string, v int")) == 4
    from pyspark.sql.types import StructType
    schema = StructType.fromDDL("id string, v int, xs array<string>")
    data = spark.createDataFrame([("b", 1, None), ('q"', 2, ["x"])], schema)
    path = f"{tmp_path}/kv.json"
    snapshots.export_records(data, path, "id")
    assert rows(snapshots.load_records(spark, path, "id", schema), "id") == [("b", 1, []), ('q"', 2, ["x"])]
    assert snapshots.load_records(spark, f"{tmp_path}/none.json", "id", schema).count() == 0
    (tmp_path / "bad.json").write_text("{oops")
    with pytest.raises(Exception):
        snapshots.load_records(spark, f"{tmp_path}/bad.json", "id", schema).collect()
    g = tmp_path / "g.json"
    g.write_text(json.dumps({"version": 1, "nodes": [{"name": ""}, {"name": "A", "type": "t"}, {"name": "A", "type": "u"}], "edges": [{"src_id": "B", "tgt_id": "A", "weight": 1.0}, {"src_id": "C", "tgt_id": "C"}]}))
    nodes, edges = snapshots.load_graph(spark, str(g))
    assert rows(nodes.select("name", "type"), "name") == [("A", "u"), ("B", None)] and edges.count() == 1
    snapshots.export_graph(nodes, edges, f"{tmp_path}/g2.json")
    back, _ = snapshots.load_graph(spark, f"{tmp_path}/g2.json")
    assert back.count() == 2
    v = spark.createDataFrame([("a", [1.0, 2.0], {"k": "x"})], "id string, vector array<float>, metadata map<string,string>")
    snapshots.export_vectors(v, f"{tmp_path}/v.json", "chunks", 2)
    assert rows(snapshots.load_vectors(spark, f"{tmp_path}/v.json").select("namespace", "dim", "id", "vector"), "id") == [("chunks", 2, "a", [1.0, 2.0])]
    (tmp_path / "lines.txt").write_text("one\n\n  two \n")
    assert rows(snapshots.read_lines(spark, f"{tmp_path}/lines.txt"), "text") == [("one",), ("two",)]
    assert snapshots.read_or(spark, f"{tmp_path}/nowhere", ["x", "y"]).count() == 2
    assert '"dim":2' in snapshots.manifest(v, "id", "vector").first()["value"]


def test_streaming_ingest(spark, tmp_path):
    src = f"{tmp_path}/in"
    schema = "text string, file_path string"
    spark.createDataFrame([("one two three", "a"), ("one two three", "b"), (" ", "c"), (None, "d")], schema).coalesce(1).write.mode("append").parquet(src)
    for _ in range(2):
        ingest.ingest(spark, src, schema, f"file://{tmp_path}/out", f"{tmp_path}/cp", size=2, overlap=1, dim=8).awaitTermination(120)
    spark.createDataFrame([("four five", "e"), ("one two three", "f")], schema).coalesce(1).write.mode("append").parquet(src)
    ingest.ingest(spark, src, schema, f"file://{tmp_path}/out", f"{tmp_path}/cp", size=2, overlap=1, dim=8).awaitTermination(120)
    read = lambda n, s: snapshots.Snapshots(spark, f"file://{tmp_path}/out", n).read(s)
    assert read("doc_status", ingest.STATUS).count() == 2 and read("chunks", ingest.CHUNKS).count() == 3 and read("vectors", ingest.INDEX).count() == 3


def test_hot_keys(spark):
    data = [("hot", 0.5, [f"s{i % 37}"]) for i in range(600)] + [(f"k{i}", 1.0, [f"s{i}", None]) for i in range(50)] + [(None, 1.0, ["x"]), ("", None, None)]
    df = spark.createDataFrame(data, "key string, weight double, xs array<string>").repartition(5)
    path = spark.conf.get("spark.checkpoint.dir") + "/hot"
    df.write.mode("overwrite").parquet(path)
    df = spark.read.parquet(path)
    for size in (7, 100, 10_000):
        assert dict(rows(hotkeys.key_totals(df, "key", size), "key"))["hot"] == 600
        assert [r["n"] for r in hotkeys.key_chunk_counts(df, "key", size).filter("key = 'hot'").orderBy("chunk_no").collect()][0] == min(size, 600)
        out = {r["key"]: r for r in hotkeys.chunked_aggregate(df, "key", "weight", size).collect()}
        assert (out["hot"]["n"], out["hot"]["sum_weight"], out["hot"]["chunks"]) == (600, 300.0, -(-600 // size)) and len(out) == 51
    numbers = hotkeys.numbered(df, "key", chunk_rows=100).filter("key = 'hot'")
    assert sorted(r["key_row"] for r in numbers.collect()) == list(range(600)) and numbers.groupBy("chunk_no").count().agg(F.max("count")).first()[0] == 100
    lists = hotkeys.merged_lists(df, "key", "xs", 10).filter("key = 'hot'").collect()
    assert sorted(x for r in lists for x in r["elements"]) == sorted({f"s{i}" for i in range(37)}) and len(lists) > 1
    assert rows(hotkeys.heavy_keys(df, "key", 0.02), "key") == [("hot", 600)]
    empty = df.limit(0)
    assert hotkeys.heavy_keys(empty, "key").count() == 0 and hotkeys.chunked_aggregate(empty, "key", "weight").count() == 0 and hotkeys.merged_lists(empty, "key", "xs").count() == 0


def test_merged_lists_are_whole_and_in_order(spark, tmp_path):
    ids = [f"c{i:04}" for i in range(2300)]
    stamp = "extracted_at timestamp_ntz"
    spark.createDataFrame([(f"r{i}", "hot", ids[i:i + 3] + ["", None], None) for i in range(2300)] + [("x", "cold", ["b", "a"], None), ("y", "", ["z"], None)],
                          f"rel_id string, src_id string, source_ids array<string>, {stamp}").write.parquet(f"{tmp_path}/relations.parquet")
    spark.createDataFrame([(f"m{i}", "same" if i < 4 else None, ["c1", "c1"], None) for i in range(6)], f"mention_id string, description string, source_ids array<string>, {stamp}").write.parquet(f"{tmp_path}/entities.parquet")
    lists = {}
    for r in skew.p3_merged_lists(spark, str(tmp_path)).orderBy("segment_no").collect():
        assert len(r["elements"]) == r["n_elements"] <= 1000
        lists.setdefault((r["field_name"], r["key_value"]), []).append(r["elements"])
    assert [len(x) for x in lists["relations.src_id", "hot"]] == [1000, 1000, 300]
    assert {k: sum(v, []) for k, v in lists.items()} == {("relations.src_id", "hot"): ids, ("relations.src_id", "cold"): ["a", "b"],
                                                         ("entities.source_ids", "c1"): [f"m{i}" for i in range(6)], ("entities.description", "same"): ["c1"]}
    assert rows(skew.p3_description_counts(spark, str(tmp_path)), "description") == [("same", 4)]


def test_blocks_follow_the_order_across_partitions(spark):
    big = spark.createDataFrame([(i, "X" if i % 3 else "Y", f"t{i:05}") for i in range(3000, -1, -1)], "i int, name string, t string").repartition(6)
    out = merging.blocks(big, "name", "t", ["i"], 150).collect()
    for name in "XY":
        got = [r["parts"] for r in sorted((r for r in out if r["name"] == name), key=lambda r: r["block_no"])]
        assert all(len(x) == 150 for x in got[:-1]) and sum(got, []) == [f"t{i:05}" for i in range(3001) if (name == "X") == bool(i % 3)]


def test_merged_descriptions_of_large_groups(spark):
    m = spark.createDataFrame([(i, "X", None, f"word{i}", ["c1", "c2", None]) for i in range(8)] + [(9, "Y", "t", None, None)], "i int, name string, type string, description string, source_ids array<string>")
    out = {r["name"]: r for r in merging.merge_entities(m, ["i"], reduce=lambda ts: F.concat_ws("+", ts)).collect()}
    assert out["X"]["description"] == "+".join(f"word{i}" for i in range(8)) and (out["X"]["n_sources"], out["Y"]["description"]) == (2, "")
    assert rows(merging.entity_sources(m), "name") == [("X", 0, 2, ["c1", "c2"])]
    assert merging.merge_entities(m, ["i"]).filter("description is null").count() == 0 and merging.merge_entities(m.limit(0), ["i"]).count() == 0


def test_summaries_by_an_endpoint(spark):
    server = HTTPServer(("127.0.0.1", 0), _Fake)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    _Fake.plan = []
    e = providers.Endpoint(f"http://127.0.0.1:{server.server_port}", "m")
    m = spark.createDataFrame([(i, "X", f"word{i}") for i in range(8)] + [(9, "Y", "alone")], "i int, name string, t string")
    out = {r["name"]: r["description"] for r in merging.summarise(m, "name", "t", ["i"], merging.by_provider(e)).collect()}
    server.shutdown()
    assert out["Y"] == "alone" and out["X"].startswith("1:Below are descriptions of one entity, named X") and '{"Description":"word7"}' in out["X"]


def test_appends_conflicts_and_expiry(spark, tmp_path):
    schema = "id string, v int"
    s, other = (snapshots.Snapshots(spark, f"file://{tmp_path}/deltas", "t") for _ in range(2))
    one = lambda i, v: spark.createDataFrame([(i, v)], schema)
    s.append(one("a", 1), "batch_0")
    s.append(one("b", 2), "batch_1")
    s.append(one("b", 3), "batch_1")  # the batch ran again
    assert rows(s.read(schema), "id") == [("a", 1), ("b", 3)] and len(s.parts()) == 2
    # A writer whose base is no longer current raises, and one that finds a claim does.
    base = other._pointer()
    s.append(one("c", 4), "batch_2")
    n, part = other._write(one("x", 9), base, "-late")
    with pytest.raises(snapshots.CommitConflict):
        other._point(base, n, [*base["parts"], part])
    claim = s._claim(s.version() + 1)
    with pytest.raises(snapshots.CommitConflict):
        other.append(one("x", 9), "batch_3")
    s._fs.delete(claim, False)
    s.compact(schema, most=2)
    assert len(s.parts()) == 1 and rows(s.read(schema), "id") == [("a", 1), ("b", 3), ("c", 4)]
    assert set(s.expire()) == set() and s.read(schema).count() == 3
    with pytest.raises(ValueError):
        s.append(one("x", 9), "not a tag")


def test_streamed_batches_write_their_own_rows_only(spark, tmp_path):
    root = f"file://{tmp_path}/out"
    batch = lambda *texts: spark.createDataFrame([(t, t[:3]) for t in texts], "text string, file_path string")
    run = lambda b, i: ingest.ingest_batch(b, i, root, size=2, overlap=1, dim=8, most_parts=3)
    assert run(batch("one two three", "four five"), 0) == 2 and run(batch("one two three", "six"), 1) == 1
    chunks = snapshots.Snapshots(spark, root, "chunks")
    assert len(chunks.parts()) == 2 and chunks.read(ingest.CHUNKS).count() == 4
    # A batch that ran up to its chunks and runs again is not doubled.
    chunks.append(chunks.read(ingest.CHUNKS).limit(1), "batch_2")
    assert run(batch("seven eight"), 2) == 1 and chunks.read(ingest.CHUNKS).count() == 5
    run(batch("nine"), 3)
    assert len(chunks.parts()) == 1 and chunks.read(ingest.CHUNKS).count() == 6


def test_late_events_are_dropped(spark, tmp_path):
    src, stamp = f"{tmp_path}/events", lambda s: f"timestamp'2026-01-01 {s}'"
    def add(*times):
        spark.sql("select * from values " + ", ".join(f"({stamp(t)}, 'a')" for t in times) + " as t(ts, event_type)").coalesce(1).write.mode("append").parquet(src)
    add("10:05:00", "10:50:00")
    def run():
        stream = spark.readStream.schema("ts timestamp, event_type string").parquet(src)
        q = ingest.windowed_counts(stream).writeStream.outputMode("append").format("parquet").option("checkpointLocation", f"{tmp_path}/ecp").option("path", f"{tmp_path}/eout").trigger(availableNow=True).start()
        q.awaitTermination(120)
    run()
    add("13:00:00")
    run()
    add("10:10:00", "15:00:00")  # the first is late: its window is closed
    run()
    got = rows(spark.read.parquet(f"{tmp_path}/eout").select(F.hour("window.start"), "n"), "n")
    assert (10, 2) in got and all(n != 3 for _, n in got)


def test_random_directions_and_flags(spark):
    v = spark.range(200).select(V.random_unit(F.col("id"), 8).alias("v")).collect()
    assert all(abs(sum(x * x for x in r["v"]) - 1) < 1e-9 for r in v) and abs(sum(r["v"][0] for r in v) / 200) < 0.1 and len({tuple(r["v"]) for r in v}) == 200
    e = spark.createDataFrame([("h", f"n{i}") for i in range(5)], "a string, b string")
    assert graph.is_truncated(e, graph.search(e, "h", 1, 3), 1) and not graph.is_truncated(e, graph.search(e, "h", 1, 9), 1)
    with pytest.raises(graph.InvalidNode):
        graph.check_nodes(spark.createDataFrame([("a",), ("",)], "name string"))
    empty = spark.createDataFrame([], "x int")
    assert extraction.cache_ratio(empty, empty).first()["ratio"] == 0.0


def test_chunks_of_byte_pairs(spark):
    from quern.functions import bpe
    from quern.plans.documents import RANK_FILE

    texts = ["Hello, wörld 中文! " * 40, "", None, "x"]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    out = chunking.by_tokens(df, "i", "t", 20, 5, bpe.encoder(RANK_FILE), bpe.decoder(RANK_FILE)).collect()
    assert {r["id"] for r in out} == {0, 3} and max(r["tokens"] for r in out) == 20
    encoding = bpe.load(RANK_FILE)
    ids = encoding.encode_ordinary(texts[0])
    first = min((r for r in out if r["id"] == 0), key=lambda r: r["chunk_order_index"])
    assert first["content"] == encoding.decode(ids[:20])


def test_cluster_needs_a_shared_folder(spark, monkeypatch):
    from quern.sources import tables

    class Conf:
        def get(self, *_):
            return None

    class Session:
        conf, sparkContext = Conf(), type("C", (), {"master": "spark://host:7077"})

    with pytest.raises(RuntimeError):
        tables.shared_dir(Session())
    df = tables.materialise(spark.range(3), "t")
    assert df.count() == 3
    tables.release(df)
    with pytest.raises(Exception):
        spark.read.parquet(df._written).count()
