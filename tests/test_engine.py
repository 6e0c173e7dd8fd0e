import os
import random
import time

import duckdb
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from loamdex.functions import codec
from loamdex.functions.analysis import Analyzer, naive_tokens, naive_tokens_py, punctuation_tokens, punctuation_tokens_py
from loamdex.functions.lists import list_intersect, list_union
from loamdex.functions.porter import stem
from loamdex.functions.wordbreak import WordBreaker, probabilities, read_dictionary, rewritten
from loamdex.operators import index as operators
from loamdex.operators import search
from loamdex.operators.index import Conflict, Index, Superseded, build_postings, merge_segments
from loamdex.plans import catalog, ranking
from loamdex.plans.engine import SearchEngine
from loamdex.plans.graph import page_rank
from loamdex.sources import metrics, store, tables
from loamdex.sources.store import DocumentStore, number_rows
from loamdex.streaming.ingest import write_segments

SF = "/root/testdata/sf0.001"
TEXTS = ["", " ", "a", catalog.COMPOSED, "soup~42/recipes>kitchen", "x^y  z", "tail  ", "  lead", "\x01ctl\x01", "a\x0bb\x85c d\xa0e", None, "THE End. the", "İx ΑΣ"]


def texts(spark):
    return spark.createDataFrame(list(enumerate(TEXTS)), "doc_id int, text string")


def test_tokenizers_agree_with_their_twins(spark):
    rows = texts(spark).select("doc_id", punctuation_tokens(F.col("text")).alias("p"), naive_tokens(F.col("text")).alias("n")).collect()
    for r in rows:
        assert r.p == punctuation_tokens_py(TEXTS[r.doc_id])
        assert r.n == naive_tokens_py(TEXTS[r.doc_id])
    assert punctuation_tokens_py(TEXTS[3]) == ["ponies:", "hop", "motoring", "cats", "part", "7", "r2d2", "sized"]
    assert naive_tokens_py("") == [""] and naive_tokens_py("  ") == []


def test_lists_and_dictionary_lines(spark):
    row = spark.range(1).select(F.array(*map(F.lit, [3, 1, 3, 2])).alias("a"), F.array(*map(F.lit, [3, 2, 5, 5])).alias("b"))
    out = row.select(list_intersect(F.col("a"), F.col("b")).alias("i"), list_union(F.col("a"), F.col("b")).alias("u")).first()
    assert out.i == [3, 3, 2] and out.u == [3, 1, 2, 5]
    lines = spark.createDataFrame([("1 20 the",), ("2\t9  of ",), ("two fields",), (" 7 lead",), ("",), ("a b c d",), (None,)], "value string")
    assert [r.value for r in rewritten(lines).collect()] == ["the 20", "of 9", "two fields", "lead 7", "", "a b c d", None]


def test_stems():
    assert {w: stem(w) for w in catalog.STEMS} == catalog.STEMS
    more = {"relational": "relat", "conditional": "condit", "digitizer": "digit", "conformabli": "conform", "analogi": "analog", "adoption": "adopt", "probate": "probat", "rate": "rate", "cease": "ceas", "controll": "control", "roll": "roll", "happy": "happi", "sky": "sky", "be": "be", "generalizations": "gener", "oscillators": "oscil"}
    assert {w: stem(w) for w in more} == more


@settings(max_examples=20, deadline=None)
@given(st.lists(st.integers(0, 2**31 - 1), max_size=12))
def test_codecs_round_trip(spark, values):
    values = sorted(values)
    row = spark.range(1).select(F.array(*map(F.lit, values)).cast("array<bigint>").alias("a"))
    out = row.select(codec.delta_decode(codec.delta_encode(F.col("a"))).alias("d"), codec.naive_decode(codec.naive_encode(F.col("a"))).alias("n")).first()
    assert out.d == values and out.n == values


def test_codec_ranges_and_bad_input(spark):
    row = spark.range(1).select(F.unhex(F.lit("03000410002A81658E688EB93D")).alias("b"))
    part = lambda a, n: row.select(codec.delta_decode(F.col("b"), F.lit(a), F.lit(n)).alias("x")).first().x
    assert part(0, 3) == [3, 3, 7] and part(0, -1) is None and part(10, 9) is None and part(0, 0) == []
    assert row.select(F.hex(codec.delta_encode(F.lit(None).cast("array<bigint>"))).alias("x")).first().x == ""
    with pytest.raises(Exception, match="non-decreasing"):
        row.select(codec.delta_encode(F.array(F.lit(5), F.lit(2)))).collect()


def test_codecs_take_long_and_odd_values(spark):
    began = time.time()
    row = spark.range(1).select(F.sequence(F.lit(0).cast("bigint"), F.lit(999_999).cast("bigint")).alias("a"))
    back = row.select("a", codec.delta_decode(codec.delta_encode(F.col("a"))).alias("d"), codec.naive_decode(codec.naive_encode(F.col("a"))).alias("n"))
    assert back.where("a = d and a = n").count() == 1 and time.time() - began < 60  # not in steps that copy the list so far
    rows = [([], b""), (None, None), ([-1, 258], b"\xff" * 4 + b"\0\0\1\2"), ([7], b"\7"), ([-2, 0], b"\xff\xff\xff\xfe\0")]
    for r in spark.createDataFrame(rows, "v array<bigint>, b binary").coalesce(1).select("v", codec.naive_decode(F.col("b")).alias("n")).collect():
        assert r.n == (r.v or [])
    odd = spark.createDataFrame([(b"\x81",), (b"\1\x81\1",), (b"",), (b"\1\x80",), (None,)], "b binary").coalesce(1)
    assert [r.d for r in odd.select(codec.delta_decode(F.col("b")).alias("d")).collect()] == [[], [1, 130], [], [1], []]


def test_word_break(spark):
    lines = spark.createDataFrame([(1, " a 6 "), (2, "b 2"), (3, "a 3"), (4, "skip"), (5, "ab 1"), (6, "not 1")], "line_no int, value string")
    p = {r.word: r.p for r in probabilities(read_dictionary(lines)).collect()}
    assert p == pytest.approx({"a": 3 / 13, "b": 2 / 13, "ab": 1 / 13, "not": 1 / 13})
    breaker = WordBreaker.of(probabilities(read_dictionary(lines)))
    assert breaker.tokenize("ABnot") == ["ab"]
    for bad in ("xyz", "  ", ""):
        with pytest.raises(ValueError, match="cannot be broken"):
            breaker.tokenize(bad)


def test_store(spark, tmp_path):
    held = DocumentStore.create_or_open(spark, f"file://{tmp_path}/store")
    assert held.size() == 0 and held.get(1) is None
    held.bulk_load(spark.createDataFrame([(1, "one"), (2, "two")], "doc_id int, text string"))
    held.add(spark.createDataFrame([(2, "zwei"), (3, "drei")], "doc_id int, text string"))
    assert DocumentStore.create_or_open(spark, held.path).size() == 3
    assert [tuple(r) for r in held.scan().collect()] == [(1, "one"), (2, "zwei"), (3, "drei")]
    assert held.get(2) == "zwei" and held.get(9) is None and [r.doc_id for r in held.keys().collect()] == [1, 2, 3]


def ids(df):
    return sorted(r.doc_id for r in df.collect())


def test_index_life(spark, tmp_path):
    index = Index(spark, f"file://{tmp_path}/index", Analyzer(stem=stem), merge_at=3)
    assert index.num_segments == 0 and index.documents().count() == 0
    index.add(spark.createDataFrame([(0, "cats like dogs"), (1, "a cat, a cat"), (2, "the dog")], "doc_id long, text string"), threshold=2)
    assert index.num_segments == 2 and index.num_documents() == 3 and index.num_documents(1) == 1
    assert index.document_frequency(0, "cat") == 2 and index.document_frequency(1, "cat") == 0
    assert ids(search.keyword(index.postings(), "Dogs", index.analyzer)) == [0, 2]
    index.delete_term("dog")
    assert ids(search.search_or(index.postings(), ["dog", "cats"], index.analyzer)) == [0, 1]
    assert index.postings(hidden=False).where("term = 'dog'").count() == 2
    index.add(spark.createDataFrame([(7, "test of the case")], "doc_id long, text string"))
    assert index.num_segments == 2 and index.manifest()["deleted"] == []  # three segments were merged: 0 with 1, and 2 alone
    assert [tuple(r) for r in index.documents().select("segment_id", "local_id", "doc_id").orderBy("segment_id", "local_id").collect()] == [(0, 0, 0), (0, 1, 1), (0, 2, 2), (1, 0, 7)]
    assert ids(search.keyword(index.postings(), "dog", index.analyzer)) == []
    assert ids(search.phrase(index.postings(), ["test case"], index.analyzer)) == [7]
    assert index.postings(0).where("term = 'cat' and doc_id = 1").first().positions == [0, 1]


def test_index_writers_lose_no_update(spark, tmp_path):
    docs = spark.createDataFrame([(0, "cats dogs"), (1, "dogs birds")], "doc_id long, text string")
    a, b = (Index(spark, f"file://{tmp_path}/index") for _ in range(2))
    a.add(docs, 1)
    old = b.manifest()
    a.delete_term("dogs")
    with pytest.raises(Conflict):  # another writer was first
        b._publish({**old, "deleted": ["cats"]})
    assert b.manifest()["deleted"] == ["dogs"] and b.manifest()["version"] == 2
    b._update(lambda state: {**state, "deleted": [*state["deleted"], "cats"]})
    b.add(docs, 2)
    assert a.manifest()["deleted"] == ["dogs", "cats"] and a.num_segments == 3 and a.num_documents(2) == 2
    assert ids(search.search_or(a.postings(), ["cats", "dogs", "birds"], a.analyzer)) == [1, 1]
    # a flush while a merge is under way stays, behind the merged segments; a second merge of the same ones is void
    before = a.manifest()
    a.merge()
    assert a.num_segments == 2 and a.manifest()["deleted"] == [] and a.document_frequency(0, "dogs") == 0
    late = Index(spark, a.path)
    late.manifest = lambda real=late.manifest, first=[before]: first.pop() if first else real()
    with pytest.raises(Superseded):
        late.merge()
    assert a.num_documents() == 4 and [tuple(r) for r in a.segments().orderBy("segment_id").collect()] == [(0, 2), (1, 2)]


def test_old_versions_go(spark, tmp_path):
    index = Index(spark, f"file://{tmp_path}/index", merge_at=99)
    for i in range(3):
        index.add(spark.createDataFrame([(i, f"word{i} shared")], "doc_id long, text string"))
    index.merge()
    held = lambda kind: len(list((tmp_path / "index" / kind).glob("[!.]*")))
    assert held("manifests") == 2 and held("docs") == 4
    assert index.vacuum(1) == 10 and held("postings") == 1
    assert ids(search.keyword(index.postings(), "shared", index.analyzer)) == [0, 1, 2] and index.num_segments == 2
    assert index.vacuum(1) == 0 and Index(spark, f"file://{tmp_path}/none").vacuum() == 0


def test_ids_may_repeat_over_segments(spark, tmp_path):
    index = Index(spark, f"file://{tmp_path}/index", compressor=codec.DELTA)
    index.add(spark.createDataFrame([(5, "red apple"), (6, "green")], "doc_id long, text string"))
    index.add(spark.createDataFrame([(5, "apple pie"), (5, "red")], "doc_id long, text string"))
    found = lambda df: sorted(map(tuple, df.collect()))
    assert found(search.search_and(index.postings(), ["red", "apple"], index.analyzer)) == [(0, 0, 5)]
    assert found(search.phrase(index.postings(), ["apple pie"], index.analyzer)) in ([(1, 0, 5)], [(1, 1, 5)])
    assert len(found(search.keyword(index.postings(), "red", index.analyzer))) == 2
    assert index.stored_bytes().first()[0] == 6  # a byte a position
    row = index.load(0).first()
    assert [d.text for d in row.documents] == ["red apple", "green"] and [p.term for p in row.postings] == ["apple", "green", "red"]
    assert index.load(7) is None and [r.doc_id for r in index.lookup("apple").collect()] == [5, 5]


def test_an_index_is_analyzed_once_for_both_codecs(spark, tmp_path, monkeypatch):
    calls = []
    real = operators.build_postings
    monkeypatch.setattr(operators, "build_postings", lambda docs, *a, **k: calls.append(docs) or real(docs, *a, **k))
    assert catalog.index_codec_bytes(spark, SF).count() == 1 and len(calls) == 1
    monkeypatch.setattr(operators, "TASK_DOCS", 2)
    docs = spark.createDataFrame([(i % 9, f"red apple {'pie ' * (i % 4)}z{i % 3}") for i in range(30)], "doc_id long, text string")
    plain = Index(spark, f"file://{tmp_path}/plain", merge_at=99)
    plain.add(docs, 7)
    plain.add(docs, 100)
    plain.delete_term("apple")
    rows = lambda i: sorted(map(tuple, i.postings().select("segment_id", "local_id", "term", "doc_id", "tf", "positions").collect()))
    bare = codec.Compressor("bare", codec.delta_encode, codec.delta_decode)
    for c in (codec.NAIVE, codec.DELTA, bare, None):
        copy = plain.copy(f"file://{tmp_path}/{c and c.name}-copy", c)
        again = Index(spark, f"file://{tmp_path}/{c and c.name}", merge_at=99, compressor=c)
        again.add(plain.documents().where("segment_id < 5").select("doc_id", "text"), 7)
        assert rows(copy) == rows(plain) and copy.num_segments == 6 and copy.num_documents() == 60 and copy.documents().count() == 60
        assert copy.manifest()["deleted"] == ["apple"]
        if c is not None:
            assert 2 * again.stored_bytes().first()[0] == copy.stored_bytes().first()[0] == plain.copy(f"file://{tmp_path}/{c.name}-2", c).stored_bytes().first()[0]
    # each file of a flush lies by segment, term and local id
    files = [[(r.segment_id, r.term, r.local_id) for r in spark.read.parquet(str(f)).coalesce(1).collect()] for f in (tmp_path / "plain/postings").glob("*/*.parquet")]
    assert len(files) > 2 and all(f == sorted(f) for f in files)


@pytest.mark.parametrize("compressor", [None, codec.DELTA])
def test_all_segments_load_by_one_plan(spark, tmp_path, compressor):
    index = Index(spark, f"file://{tmp_path}/index", merge_at=1 << 30, compressor=compressor)
    assert index.load() is None
    index.add(spark.createDataFrame([(i, f"red {'pie ' * (i % 3)}z{i % 2}" if i != 40 else "the") for i in range(41)], "doc_id long, text string"), 1)
    index.add(spark.createDataFrame([(7, "b c b"), (8, "c")], "doc_id long, text string"))
    rows = {r.segment_id: r for r in index.load().collect()}
    assert sorted(rows) == list(range(42)) and rows[40].postings is None and [d.text for d in rows[40].documents] == ["the"]
    assert [(p.term, [tuple(x) for x in p.list]) for p in rows[41].postings] == [("b", [(0, 2, [0, 2])]), ("c", [(0, 1, [1]), (1, 1, [0])])]
    assert rows[5] == index.load(5).first() and [p.term for p in rows[5].postings] == ["pie", "red", "z1"]
    scans = lambda n: catalog.QUERIES["index_load"](spark, n)._jdf.queryExecution().optimizedPlan().collectLeaves().size()
    assert scans(SF) == scans(SF.replace("0.001", "0.01")) == 2  # however many segments there are


def test_streams_add_each_batch_once(spark, tmp_path):
    index = Index(spark, f"file://{tmp_path}/index", merge_at=99)
    (tmp_path / "in").mkdir()
    run = lambda: write_segments(spark.readStream.schema("doc_id long, text string").json(f"{tmp_path}/in"), index, f"{tmp_path}/state").awaitTermination()
    (tmp_path / "in/a.json").write_text('{"doc_id": 1, "text": "one"}\n{"doc_id": 2, "text": "two"}')
    run()
    run()
    assert index.num_segments == 1 and index.num_documents() == 2
    (tmp_path / "in/b.json").write_text('{"doc_id": 3, "text": "three two"}')
    run()
    assert index.num_segments == 2 and ids(search.keyword(index.postings(), "two", index.analyzer)) == [2, 3]
    index.add(spark.createDataFrame([(9, "again")], "doc_id long, text string"), stream=("stream", 1))
    assert index.num_documents() == 3  # that batch was in already


@pytest.mark.parametrize("rows", [1 << 17, 7])
def test_row_numbers(spark, monkeypatch, rows):
    monkeypatch.setattr(store, "SPAN_ROWS", rows)
    rng = random.Random(1)
    keys = [rng.randint(-(2**62), 2**62) for _ in range(200)] + list(range(50)) + [7] * 40 + [None, None]
    got = sorted((r.rn, r.k) for r in number_rows(spark.createDataFrame([(k,) for k in keys], "k long").repartition(5), "k").collect())
    assert [n for n, _ in got] == list(range(1, len(keys) + 1))
    assert [k for _, k in got] == sorted((k for k in keys if k is not None)) + [None, None]
    assert number_rows(spark.createDataFrame([], "k long"), "k").collect() == []


def test_stemmed_postings_equal_brute_force(spark):
    docs = [tuple(r) for r in duckdb.sql(f"SELECT doc_id, text FROM '{SF}/documents.parquet' LIMIT 80").fetchall()] + [(-1, "Cats cat CATS, hopping the hops"), (-2, None), (-3, "the of")]
    want = {}
    for d, t in docs:
        for i, term in enumerate(punctuation_tokens_py(t)):
            want.setdefault((stem(term), d), []).append(i)
    found = build_postings(spark.createDataFrame(docs, "doc_id long, text string"), Analyzer(stem=stem))
    assert {(r.term, r.doc_id): r.positions for r in found.collect()} == want
    assert want["cat", -1] == [0, 1, 2] and want["hop", -1] == [3, 4]


def test_positions_are_not_shuffled_and_repeated_ids_meet(spark, monkeypatch):
    docs = [(1, "b z b"), (2, None), (3, "z"), (1, "c b"), (None, "x"), (None, "y x"), (4, "the")]
    rows = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    monkeypatch.setattr(operators, "GATHERED_ROWS", 1)
    assert {(r.term, r.doc_id): (r.tf, r.positions) for r in build_postings(rows, Analyzer()).collect()} == {
        ("b", 1): (3, [0, 1, 2]), ("z", 1): (1, [1]), ("c", 1): (1, [0]), ("z", 3): (1, [0]), ("x", None): (2, [0, 1]), ("y", None): (1, [0]),
    }
    once = spark.createDataFrame([(i, "b z b") for i in range(5)], "doc_id long, text string")
    found = build_postings(once, Analyzer())
    assert sorted(map(tuple, found.collect())) == sorted((t, i, n, p) for i in range(5) for t, n, p in (("z", 1, [1]), ("b", 2, [0, 2])))
    assert "Exchange" not in found._jdf.queryExecution().executedPlan().toString()


def test_sizes_equal_the_codecs(spark):
    values = [None, [], [0], [5, 5, 6], [127, 128, 16384, 2**31 - 1], [2**62, 2**62 + 1], [3, 2**40, 2**56]]
    rows = spark.createDataFrame([(v,) for v in values], "v array<bigint>")
    for r in rows.select(codec.delta_size(F.col("v")).alias("d"), F.length(codec.delta_encode(F.col("v"))).alias("e"), codec.naive_size(F.col("v")).alias("n"), F.length(codec.naive_encode(F.col("v"))).alias("m")).collect():
        assert r.d == r.e and r.n == r.m


def test_counters(spark, tmp_path):
    spark.range(0, 4000, 1, 4).selectExpr("id", "id % 7 as x").write.partitionBy("x").parquet(f"{tmp_path}/t")
    rows = spark.read.parquet(f"{tmp_path}/t")
    whole = metrics.counted(rows)
    part = metrics.counted(rows.where("x = 3").groupBy("x").count())
    assert whole["files"] == 28 and whole["rows"] == 4000 and whole == metrics.counted(rows)
    assert part["files"] == 4 and part["rows"] == rows.where("x = 3").count() and 0 < part["bytes"] < whole["bytes"]


def test_scratch_tables_go(spark):
    made = []

    def make():
        made.append(tables.stored(spark.range(5).toDF("x"), "step"))
        return made[0].where("x > 2")

    out = tables.settled(spark, make, "out")
    assert sorted(r.x for r in out.collect()) == [3, 4]
    with pytest.raises(Exception, match="does not exist|FileNotFound|No such file"):
        made[0].collect()


def test_search_edges(spark):
    docs = spark.createDataFrame([(0, "dog dog"), (1, "dog cat"), (2, "cat dog cat"), (3, None)], "doc_id long, text string")
    plain, rows = Analyzer(), build_postings(docs, Analyzer())
    assert ids(search.search_and(rows, ["dog", "dog"], plain)) == [0, 1, 2]
    assert ids(search.search_and(rows, ["dog", "the"], plain)) == [] and ids(search.search_and(rows, [], plain)) == []
    assert ids(search.search_or(rows, ["the", "cat"], plain)) == [1, 2]
    assert ids(search.phrase(rows, ["dog", "dog"], plain)) == [0] and ids(search.phrase(rows, ["cat dog cat"], plain)) == [2]
    assert ids(search.full_scan(docs, "cat dog", plain)) == [1, 2] and ids(search.full_scan(docs, "", plain)) == []
    assert ids(search.full_scan(docs, "dogs", Analyzer(stem=stem))) == [0, 1, 2]
    with pytest.raises(NotImplementedError):
        search.phrase(rows.drop("positions"), ["dog"], plain)


def test_tf_idf_goldens(spark):
    docs = spark.createDataFrame([(0, "cat"), (1, "dog dog wolf"), (2, "cat dog"), (3, "cat dog dog"), (4, "bird")], "doc_id long, text string")
    rows, n = build_postings(docs, Analyzer()), docs.agg(F.count(F.lit(1)).alias("n"))
    assert [r.doc_id for r in ranking.tf_idf(rows, n, ["cat", "dog", "dog"], 3).collect()] == [3, 2, 1]
    assert ranking.tf_idf(rows, n, ["cat"], 0).count() == 0 and ranking.tf_idf(rows, n, []).count() == 0
    assert {r.score for r in ranking.tf_idf(rows, n, ["cat"]).collect()} == {5 / 3}


def test_page_rank_edges(spark):
    nodes = spark.createDataFrame([(0,), (1,), (2,)], "id int")
    edges = spark.createDataFrame([(0, 1), (0, 1), (0, 9), (1, 1), (8, 2)], "src int, dst int")
    assert {r.id: r["rank"] for r in page_rank(nodes, edges, 0).collect()} == {0: 1.0, 1: 1.0, 2: 1.0}
    got = {r.id: r["rank"] for r in page_rank(nodes, edges, 2).collect()}
    first = 0.15 + 0.85 * (2 / 3 + 1)
    assert got == pytest.approx({0: 0.15, 1: 0.15 + 0.85 * (0.15 * 2 / 3 + first), 2: 0.15})


def test_engine(spark, tmp_path):
    os.makedirs(tmp_path / "cleaned")
    for i, words in enumerate(["apple pie\r\n", "apple tree", ""]):
        (tmp_path / "cleaned" / str(i)).write_bytes((f"{i}\nurl{i}\n{words}" if words else "").encode())
    (tmp_path / "url.tsv").write_text("0 url0\n1 url1\n")
    (tmp_path / "id-graph.tsv").write_text("0 1\n1 0\n0 1\n")
    engine = SearchEngine(f"file://{tmp_path}", Index(spark, f"file://{tmp_path}/index"))
    engine.write_index()
    engine.compute_page_rank(3)
    assert engine.index.num_documents() == 3 and engine.page_rank_scores().count() == 2
    found = engine.search(["apple"], 5, 1.0).collect()
    assert {r.text.split("\n")[0] for r in found} == {"0", "1"} and found[0].score >= found[1].score
    plain = engine.search(["apple"], 5, 0.0).collect()
    assert [r.doc_id for r in plain] == [r.doc_id for r in engine.tf_idf(["apple"]).collect()]


def test_merge_keeps_an_odd_segment(spark):
    rows = spark.createDataFrame([(0, 0, "a"), (0, 1, "b"), (1, 0, "c"), (2, 0, "d")], "segment_id int, local_id int, x string")
    assert sorted(map(tuple, merge_segments(rows).collect())) == [(0, 0, "a"), (0, 1, "b"), (0, 2, "c"), (1, 0, "d")]


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem documents pages benchmark".split():
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    found = catalog.QUERIES[name](spark, SF)
    names = sorted(found.columns)
    cursor = con.execute(catalog.ORACLES[name])
    columns = [d[0] for d in cursor.description]
    assert sorted(columns) == names
    want = sorted((tuple(r[columns.index(c)] for c in names) for r in cursor.fetchall()), key=repr)
    assert sorted((tuple(r[c] for c in names) for r in found.collect()), key=repr) == want
