"""The queries of the search engine over the driver's tables, and the SQL that must give the same rows."""

from __future__ import annotations

from functools import reduce
from itertools import combinations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loamdex.functions import codec
from loamdex.functions.analysis import STOP_WORDS, Analyzer, naive_tokens, positions, punctuation_tokens
from loamdex.functions.lists import list_intersect, list_union
from loamdex.functions.porter import stem
from loamdex.functions.wordbreak import WordBreaker, japanese_breaker, probabilities, read_dictionary, rewritten
from loamdex.operators import index, search
from loamdex.plans import graph, ranking
from loamdex.plans.engine import SearchEngine
from loamdex.sources.store import DocumentStore, latest, number_rows, read_edges, read_folder, read_nodes
from loamdex.sources.tables import new_path
from loamdex.streaming.ingest import write_segments

PLAIN = Analyzer()
SEGMENT = 100
KEYS, PHRASE2, PHRASE3, RANKED = ["tion", "ing", "ly"], ["ing", "tion"], ["thanedble", "anea", "eriner"], ["tion", "ing", "ly", "tion"]
ROUNDS = 10
ENGINE_KEYS = ["tion", "anea", "er"]
#: A small dictionary: words and frequencies.
JAPANESE = {"私": 9, "は": 20, "本": 6, "を": 18, "読む": 4, "本屋": 2, "屋": 1, "猫": 5, "が": 15, "好き": 7, "です": 12, "で": 3, "す": 1}


def _t(spark: SparkSession, sf: str, name: str = "documents") -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def _docs(spark: SparkSession, sf: str) -> DataFrame:
    return _t(spark, sf).select("doc_id", "text")


def _segments(spark: SparkSession, sf: str) -> DataFrame:
    return index.assign_segments(_docs(spark, sf), SEGMENT)


def _postings(spark: SparkSession, sf: str) -> DataFrame:
    return index.build_postings(_docs(spark, sf), PLAIN)


def _lists(spark: SparkSession, sf: str) -> DataFrame:
    """Postings without positions, for what needs none."""
    return index.build_postings(_docs(spark, sf), PLAIN, positional=False)


def _joined(column: str):
    return F.array_join(F.transform(column, lambda x: x.cast("string")), ",").alias(column)


def doc_scan(s, d):
    return _docs(s, d).orderBy("doc_id")


def doc_keys(s, d):
    return _t(s, d).select("doc_id").orderBy("doc_id")


def doc_get(s, d):
    return _docs(s, d).where(F.col("doc_id") == 17)


def doc_count(s, d):
    return _t(s, d).agg(F.count(F.lit(1)).alias("n"))


def doc_upsert(s, d):
    """Every document in a first batch; then every tenth again, with another text."""
    first = _docs(s, d).withColumn("batch", F.lit(0))
    second = first.where("doc_id % 10 = 0").select("doc_id", F.concat(F.lit("new "), F.col("doc_id").cast("string")).alias("text"), F.lit(1).alias("batch"))
    return latest(first.unionByName(second))


def doc_bulk_load(s, d):
    return number_rows(_t(s, d).select("doc_id"), "doc_id")


def analyze_naive(s, d):
    return _docs(s, d).select("doc_id", F.array_join(naive_tokens(F.col("text")), " ").alias("tokens"))


def analyze_punct(s, d):
    return _docs(s, d).select("doc_id", F.array_join(punctuation_tokens(F.col("text")), "|").alias("tokens"))


def stopword_filter(s, d):
    """Tokens before and after stop words."""
    words = F.filter(F.split(F.lower("text"), r"[,.;?! ^\f\n\r\t\v]"), lambda t: t != "")
    return _docs(s, d).select("doc_id", F.size(words).cast("long").alias("words"), F.size(punctuation_tokens(F.col("text"))).cast("long").alias("kept"))


def distinct_terms(s, d):
    return _docs(s, d).select("doc_id", F.size(F.array_distinct(punctuation_tokens(F.col("text")))).cast("long").alias("terms"))


def term_positions(s, d):
    return positions(_docs(s, d), "tion", PLAIN).select("doc_id", _joined("positions"))


def postings(s, d):
    return _postings(s, d).select("term", "doc_id", "tf", _joined("positions"))


def inverted_lists(s, d):
    return index.inverted_lists(_lists(s, d)).select("term", _joined("doc_ids"))


def term_frequency(s, d):
    return _lists(s, d).select("doc_id", "term", "tf")


def dictionary_df(s, d):
    return index.dictionary(_lists(s, d))


def segments(s, d):
    return _segments(s, d).select("doc_id", "segment_id", "local_id")


def segment_num_docs(s, d):
    return _segments(s, d).groupBy("segment_id").agg(F.count(F.lit(1)).alias("docs"))


def num_segments(s, d):
    return _segments(s, d).agg(F.countDistinct("segment_id").alias("n"))


def segment_df(s, d):
    return index.dictionary(index.build_postings(_segments(s, d), PLAIN, positional=False))


def segment_docs_scan(s, d):
    return _segments(s, d).where("segment_id = 1").select("segment_id", "local_id", "doc_id", "text")


def segment_postings(s, d):
    return index.build_postings(_segments(s, d).where("segment_id = 1"), PLAIN).select("segment_id", "term", "local_id", "tf", _joined("positions"))


def segment_merge(s, d):
    return index.merge_segments(_segments(s, d).select("segment_id", "local_id", "doc_id"))


def _tombstones(s):
    return s.createDataFrame([("ing",)], "term string")


def merge_with_delete(s, d):
    rows = index.build_postings(_segments(s, d), PLAIN, positional=False)
    counts = segment_num_docs(s, d)
    merged = index.merge_segments(index.without_terms(rows, _tombstones(s)), counts)
    return merged.groupBy("segment_id", "term").agg(F.count(F.lit(1)).alias("df"), F.sum("local_id").alias("ids"))


def search_fullscan(s, d):
    return search.full_scan(_docs(s, d), "tion, ING ly", PLAIN)


def search_keyword(s, d):
    return search.keyword(_lists(s, d), "tion", PLAIN)


def search_and(s, d):
    return search.search_and(_lists(s, d), KEYS, PLAIN)


def search_or(s, d):
    return search.search_or(_lists(s, d), KEYS + ["the"], PLAIN)


def search_phrase2(s, d):
    return search.phrase(_postings(s, d), PHRASE2, PLAIN)


def search_phrase3(s, d):
    return search.phrase(_postings(s, d), PHRASE3, PLAIN)


def search_phrase_repeat(s, d):
    return search.phrase(_postings(s, d), ["ing", "ing"], PLAIN)


def search_keyword_deleted(s, d):
    """Each keyword by itself, one of them deleted."""
    rows = index.without_terms(_lists(s, d), _tombstones(s))
    return reduce(DataFrame.unionByName, (search.keyword(rows, k, PLAIN).withColumn("keyword", F.lit(k)) for k in KEYS))


def search_and_deleted(s, d):
    """Each pair of keywords; those with the deleted one find nothing."""
    rows = index.without_terms(_lists(s, d), _tombstones(s))
    found = (search.search_and(rows, list(pair), PLAIN).withColumn("pair", F.lit(" ".join(pair))) for pair in combinations(KEYS, 2))
    return reduce(DataFrame.unionByName, found)


def search_or_deleted(s, d):
    return search.search_or(index.without_terms(_lists(s, d), _tombstones(s)), KEYS, PLAIN)


def _ranked(s, d, terms, k=None):
    n = _t(s, d).agg(F.count(F.lit(1)).alias("n"))
    return ranking.tf_idf(_lists(s, d), n, PLAIN.analyze_query(terms), k)


def _six(df):
    return df.select("doc_id", F.round("score", 6).alias("score"))


def tfidf_all(s, d):
    return _six(_ranked(s, d, KEYS))


def tfidf_dup_query_terms(s, d):
    return _six(_ranked(s, d, RANKED))


def tfidf_topk(s, d):
    return _six(_ranked(s, d, RANKED, 10))


def tfidf_multi_segment(s, d):
    """df and N come from all segments, so segments change nothing."""
    rows = index.build_postings(_segments(s, d), PLAIN, positional=False)
    n = segment_num_docs(s, d).agg(F.sum("docs").alias("n"))
    return _six(ranking.tf_idf(rows, n, PLAIN.analyze_query(RANKED)))


def _edges(s, d):
    """An edge for each line item, from the customer's nation to the supplier's."""
    orders = _t(s, d, "orders").join(_t(s, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    orders = orders.select("o_orderkey", F.col("c_nationkey").alias("src"))
    suppliers = _t(s, d, "supplier").select("s_suppkey", F.col("s_nationkey").alias("dst"))
    lines = _t(s, d, "lineitem").select("l_orderkey", "l_suppkey").join(suppliers, F.col("l_suppkey") == F.col("s_suppkey"))
    return lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).select("src", "dst")


def _nodes(s, d):
    return _t(s, d, "nation").select(F.col("n_nationkey").alias("id"))


def out_degree(s, d):
    return graph.out_degrees(_edges(s, d))


def pagerank_k(s, d):
    return graph.page_rank(_nodes(s, d), _edges(s, d), ROUNDS).select("id", F.round("rank", 6).alias("rank"))


def pagerank_dangling(s, d):
    """Nodes 0 to 19 only, and no edges from 0 to 4: shares are lost."""
    return graph.page_rank(_nodes(s, d).where("id < 20"), _edges(s, d).where("src > 4"), ROUNDS).select("id", F.round("rank", 6).alias("rank"))


def combined_rank(s, d):
    ranks = graph.page_rank(_nodes(s, d), _edges(s, d), ROUNDS)
    node_of = _t(s, d).select("doc_id", (F.col("doc_id") % 25).cast("int").alias("id"))
    return _six(graph.combined_rank(_ranked(s, d, RANKED), node_of, ranks, 2.5, 20))


def url_nodes(s, d):
    lines = _t(s, d, "pages").select(F.concat_ws(" ", F.col("page_id").cast("string"), "url").alias("value"))
    return read_nodes(lines)


def graph_edges(s, d):
    lines = _edges(s, d).select(F.concat_ws("\t", F.col("src").cast("string"), F.col("dst").cast("string")).alias("value"))
    return read_edges(lines).groupBy("src", "dst").agg(F.count(F.lit(1)).alias("m"))


def dictionary_probability(s, d):
    """Term counts written as dictionary lines and read back."""
    lines = index.dictionary(_lists(s, d)).select(F.xxhash64("term").alias("line_no"), F.concat_ws(" ", "term", F.col("df").cast("string")).alias("value"))
    return probabilities(read_dictionary(lines)).select("word", F.round("p", 12).alias("p"))


def dictionary_rewrite(s, d):
    """Term counts as lines of three fields, written as `word freq`."""
    lines = index.dictionary(_lists(s, d)).select(F.concat_ws("\t", F.length("term").cast("string"), F.col("df").cast("string"), "term").alias("value"))
    return rewritten(lines)


def list_operations(s, d):
    """The query's terms in each document with repeats, and how many terms both have."""
    own, wanted = punctuation_tokens(F.col("text")), F.array(*map(F.lit, KEYS))
    return _docs(s, d).select("doc_id", F.array_join(list_intersect(own, wanted), ",").alias("common"), F.size(list_union(own, wanted)).cast("long").alias("terms"))


# Stems that the stemmer's tests expect.
STEMS = {
    "caresses": "caress", "ponies": "poni", "caress": "caress", "cats": "cat", "agreed": "agre", "feed": "feed", "plastered": "plaster", "bled": "bled",
    "motoring": "motor", "sing": "sing", "conflated": "conflat", "troubled": "troubl", "sized": "size", "hopping": "hop", "fizzed": "fizz", "failing": "fail",
    "filing": "file", "triplicate": "triplic", "formative": "form", "formalize": "formal", "electriciti": "electr", "electrical": "electr", "hopeful": "hope", "goodness": "good",
    "ties": "ti", "dogs": "dog", "need": "need", "disabled": "disabl", "fitting": "fit", "making": "make", "missing": "miss", "meeting": "meet",
    "meetings": "meet",
}
# Integer lists and their bytes under the delta codec.
DELTAS = {"3,3,7,23,23,65,294,2190,238923": "03000410002A81658E688EB93D", "2147483647": "87FFFFFF7F", "16384": "818000", "128,384,896,1920,3968": "81008200840088009000", "": ""}


#: A sentence with every kind of delimiter, stop words, and a colon, which is none.
COMPOSED = "\n Do Ponies: hop;\tMotoring cats? part 7, r2d2^sized! by yourself.\f"


def porter_golden(s, d):
    from loamdex.functions.analysis import stemmed

    return stemmed(s.createDataFrame([(w,) for w in STEMS], "term string"), stem)


def analyze_composed_golden(s, d):
    docs = s.createDataFrame([(1, COMPOSED), (2, "The ponies and the cats were hopping")], "doc_id long, text string")
    found = Analyzer(stem=stem).occurrences(docs)
    return found.groupBy("doc_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("pos", "term"))), lambda x: x["term"]), "|").alias("tokens"))


def stemmed_df(s, d):
    """Document frequencies of the stemmed positional index's terms."""
    return index.dictionary(index.build_postings(_docs(s, d), Analyzer(stem=stem), positional=False))


def wordbreak_golden(s, d):
    lines = s.createDataFrame([(1, "i 10"), (2, "like 5"), (3, "ice 4"), (4, "cream 4"), (5, "icecream 9"), (6, "bad line here"), (7, "to 8")], "line_no int, value string")
    breaker = WordBreaker.of(probabilities(read_dictionary(lines)), on_error="null")
    texts = s.createDataFrame([(1, "ILikeIceCream"), (2, "liketoice"), (3, "xyz")], "id int, text string")
    return texts.select("id", F.array_join(breaker.column(F.col("text")), "|").alias("tokens"))


def codec_varbyte_golden(s, d):
    rows = s.createDataFrame([(k, [int(x) for x in k.split(",") if x]) for k in DELTAS], "ints string, a array<bigint>")
    return rows.select("ints", F.hex(codec.delta_encode(F.col("a"))).alias("bytes"))


def codec_naive_golden(s, d):
    rows = s.createDataFrame([("1,256,-1", [1, 256, -1])], "ints string, a array<bigint>")
    return rows.select("ints", F.hex(codec.naive_encode(F.col("a"))).alias("bytes"))


def codec_roundtrip(s, d):
    """Positions that come back from both codecs; the rows are those of postings."""
    rows = _postings(s, d).withColumn("p", F.col("positions").cast("array<bigint>"))
    delta, naive = codec.delta_decode(codec.delta_encode(F.col("p"))), codec.naive_decode(codec.naive_encode(F.col("p")))
    return rows.where((delta == F.col("p")) & (naive == F.col("p"))).select("term", "doc_id", F.array_join(F.transform("p", lambda x: x.cast("string")), ",").alias("positions"))


def codec_size_ratio(s, d):
    p = F.col("positions").cast("array<bigint>")
    return _postings(s, d).agg(F.sum(codec.naive_size(p)).alias("naive"), F.sum(codec.delta_size(p)).alias("delta"))


def ingest_stream_segments(s, d):
    """A stream of the documents table, flushed a segment a batch; term frequencies over all segments."""
    path = new_path(s, "stream")
    source = f"{d}/documents.parquet" if _is_folder(s, f"{d}/documents.parquet") else f"{d}/document[s].parquet"
    reader = s.readStream.schema(_t(s, d).schema).option("pathGlobFilter", "*.parquet").option("recursiveFileLookup", "true")
    stream = reader.parquet(source)
    held = index.Index(s, f"{path}/index")
    write_segments(stream, held, f"{path}/state").awaitTermination()
    return held.postings().select("doc_id", "term", "tf")


def _store(s, d):
    """A store with all documents, of which every tenth was overwritten; opened again."""
    path = new_path(s, "store")
    store = DocumentStore.create_or_open(s, path)
    store.bulk_load(_docs(s, d))
    store.add(_docs(s, d).where("doc_id % 10 = 0").select("doc_id", F.concat(F.lit("new "), F.col("doc_id").cast("string")).alias("text")))
    return DocumentStore.create_or_open(s, path)


def store_scan(s, d):
    return _store(s, d).scan()


def store_keys(s, d):
    return _store(s, d).keys()


def store_get(s, d):
    """Point look-ups of a document, of an overwritten one, and of one that is not there."""
    store = _store(s, d)
    return s.createDataFrame([(i, store.get(i)) for i in (17, 20, -1)], "doc_id long, text string")


def store_size(s, d):
    return s.createDataFrame([(_store(s, d).size(),)], "n long")


def _index(s, d, name="plain", **options):
    """An index folder with all documents, written once a session and opened again."""
    key = (s.sparkContext.applicationId, d, name)
    if key not in _built:
        _built[key] = new_path(s, "index")
        index.Index(s, _built[key], PLAIN, merge_at=1 << 30, **options).add(_docs(s, d), SEGMENT)
    return index.Index(s, _built[key], PLAIN, merge_at=1 << 30, **options)


_built: dict[tuple[str, str, str], str] = {}


def index_documents(s, d):
    return _index(s, d).documents().select("segment_id", "local_id", "doc_id", "text")


def index_segments(s, d):
    return _index(s, d).segments()


def index_lookup(s, d):
    return _index(s, d).lookup("tion").select("segment_id", "local_id", "doc_id", "tf", _joined("positions"))


def index_load(s, d):
    """The nested load of every segment, laid out again."""
    loaded = _index(s, d).load()
    if loaded is None:
        return s.createDataFrame([], "segment_id int, docs long, term string, ids string")
    # The documents are counted before the lists are laid out, else each list would carry them.
    rows = loaded.select("segment_id", F.size("documents").alias("docs"), "postings").select("segment_id", "docs", F.explode("postings").alias("p")).select("segment_id", "docs", "p.*")
    ids = F.array_join(F.transform("list", lambda x: x["local_id"].cast("string")), ",")
    return rows.select("segment_id", F.col("docs").cast("long"), "term", ids.alias("ids"))


def index_keyword(s, d):
    return search.keyword(_index(s, d).postings(), "tion", PLAIN)


def index_and(s, d):
    return search.search_and(_index(s, d).postings(), KEYS, PLAIN)


def index_or(s, d):
    return search.search_or(_index(s, d).postings(), KEYS, PLAIN)


def index_phrase(s, d):
    return search.phrase(_index(s, d).postings(), PHRASE3, PLAIN)


def index_tfidf(s, d):
    held = _index(s, d)
    n = s.createDataFrame([(held.num_documents(),)], "n long")
    return _six(ranking.tf_idf(held.postings(hidden=False), n, RANKED))


def index_twice(s, d):
    """All documents flushed twice: ids repeat, and segments tell them apart."""
    held = index.Index(s, new_path(s, "index"), PLAIN, merge_at=1 << 30)
    held.add(_docs(s, d), SEGMENT)
    held.add(_docs(s, d), SEGMENT)
    return search.phrase(held.postings(), PHRASE3, PLAIN)


def _deleting(s, d):
    held = index.Index(s, new_path(s, "index"), PLAIN, merge_at=1 << 30)
    held.add(_docs(s, d), SEGMENT)
    held.delete_term("ING")
    return held


def index_deleted(s, d):
    return search.search_or(_deleting(s, d).postings(), KEYS, PLAIN)


def index_merged(s, d):
    held = _deleting(s, d)
    held.merge()
    return held.postings().groupBy("segment_id", "term").agg(F.count(F.lit(1)).alias("df"), F.sum("local_id").alias("ids"))


def index_delta_postings(s, d):
    """Positions that an index keeps as bytes of the delta codec."""
    return _index(s, d, "delta", compressor=codec.DELTA).postings().select("term", "doc_id", "tf", _joined("positions"))


def index_codec_bytes(s, d):
    """Bytes of stored positions under both codecs: an index, and its copy under the other one."""
    held = _index(s, d, "delta", compressor=codec.DELTA)
    delta, naive = (i.stored_bytes().first()[0] for i in (held, held.copy(new_path(s, "index"), codec.NAIVE)))
    return s.createDataFrame([(naive, delta)], "naive long, delta long")


def _crawl(s, d):
    """A crawl folder made of the benchmark: a page an item, and a graph over the item ids."""
    folder = new_path(s, "crawl")
    ids = []
    for r in _t(s, d, "benchmark").select("item_id", "text").toLocalIterator():  # a small table
        _put(s, f"{folder}/cleaned/{r.item_id}.txt", f"{r.item_id}\nurl{r.item_id}\n{r.text or ''}\n")
        ids.append(r.item_id)
    _put(s, f"{folder}/url.tsv", "".join(f"{i}\turl{i}\n" for i in ids))
    _put(s, f"{folder}/id-graph.tsv", "".join(f"{i} {i // 2}\n{i} {i * 3 % 11}\n" for i in ids))
    return folder


def _put(s, path, text):
    place = s.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    out = place.getFileSystem(s.sparkContext._jsc.hadoopConfiguration()).create(place, True)
    out.write(bytearray(text.encode()))
    out.close()


def crawl_documents(s, d):
    return read_folder(s, _crawl(s, d)).select("text")


def engine_search(s, d):
    """The engine over a crawl: index, page rank, and both combined, all hits."""
    engine = SearchEngine(_crawl(s, d), index.Index(s, new_path(s, "index")))
    engine.write_index(10)
    engine.compute_page_rank(ROUNDS)
    return engine.search(ENGINE_KEYS, 1 << 30, 2.5).select(F.round("score", 6).alias("score"), "text")


def japanese_golden(s, d):
    """Segmentation by a Japanese dictionary."""
    lines = s.createDataFrame([(i, f"{w} {n}") for i, (w, n) in enumerate(JAPANESE.items())], "line_no int, value string")
    breaker = japanese_breaker(read_dictionary(lines), on_error="null")
    texts = s.createDataFrame([(1, "私は本を読む"), (2, "猫が好きです"), (3, "本屋"), (4, "犬")], "id int, text string")
    return texts.select("id", F.array_join(breaker.column(F.col("text")), "|").alias("tokens"))


def _is_folder(s, path):
    fs_path = s.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return fs_path.getFileSystem(s.sparkContext._jsc.hadoopConfiguration()).getFileStatus(fs_path).isDirectory()


QUERIES = {
    f.__name__: f
    for f in (
        doc_scan, doc_keys, doc_get, doc_count, doc_upsert, doc_bulk_load, analyze_naive, analyze_punct, stopword_filter, distinct_terms, term_positions, postings, inverted_lists, term_frequency, dictionary_df,
        segments, segment_num_docs, num_segments, segment_df, segment_docs_scan, segment_postings, segment_merge, merge_with_delete, search_fullscan, search_keyword, search_and, search_or, search_phrase2,
        search_phrase3, search_phrase_repeat, search_keyword_deleted, search_and_deleted, search_or_deleted, tfidf_all, tfidf_topk, tfidf_dup_query_terms, tfidf_multi_segment, pagerank_k, pagerank_dangling,
        out_degree, combined_rank, url_nodes, graph_edges, dictionary_probability, dictionary_rewrite, list_operations, porter_golden, analyze_composed_golden, stemmed_df, wordbreak_golden, codec_varbyte_golden, codec_naive_golden, codec_roundtrip,
        codec_size_ratio, ingest_stream_segments, store_scan, store_keys, store_get, store_size, index_documents, index_segments, index_lookup, index_load, index_keyword, index_and, index_or,
        index_phrase, index_tfidf, index_twice, index_deleted, index_merged, index_delta_postings, index_codec_bytes, crawl_documents, engine_search, japanese_golden,
    )
}

_STOP = ", ".join(f"'{w}'" for w in STOP_WORDS)
_SPLIT = r"regexp_split_to_array(lower(regexp_replace(coalesce(text, ''), '^[\x00-\x20]+|[\x00-\x20]+$', '', 'g')), '[,.;?! ^\f\n\r\t\x0b\x{85}\x{2028}\x{2029}]')"
_TOKS = f"toks AS (SELECT doc_id, [t FOR t IN {_SPLIT} IF t <> '' AND t NOT IN ({_STOP})] AS a FROM documents)"
_OCC = f"{_TOKS}, occ AS (SELECT doc_id, unnest(a) AS term, CAST(unnest(range(len(a))) AS INTEGER) AS pos FROM toks)"
_POST = f"{_OCC}, post AS (SELECT term, doc_id, count(*) AS tf, string_agg(CAST(pos AS VARCHAR), ',' ORDER BY pos) AS positions FROM occ GROUP BY term, doc_id)"
_SEG = f"seg AS (SELECT doc_id, text, CAST((row_number() OVER (ORDER BY doc_id) - 1) // {SEGMENT} AS INTEGER) AS segment_id, CAST((row_number() OVER (ORDER BY doc_id) - 1) % {SEGMENT} AS INTEGER) AS local_id FROM documents)"


def _phrase(terms: list[str]) -> str:
    joins = " ".join(f"JOIN occ o{i} ON o{i}.doc_id = o0.doc_id AND o{i}.pos = o0.pos + {i} AND o{i}.term = '{t}'" for i, t in enumerate(terms) if i)
    return f"WITH {_OCC} SELECT DISTINCT o0.doc_id FROM occ o0 {joins} WHERE o0.term = '{terms[0]}'"


def _tfidf(terms: list[str], tail: str = "") -> str:
    values = ", ".join(f"('{t}', {terms.count(t)})" for t in sorted(set(terms)))
    return f"""{_POST}, q AS (SELECT * FROM (VALUES {values}) v(term, qtf)), n AS (SELECT count(*) AS n FROM documents),
idf AS (SELECT term, qtf, (SELECT n FROM n) / count(*) AS idf FROM post JOIN q USING (term) GROUP BY term, qtf),
ranked AS (SELECT doc_id, sum(tf * idf * qtf * idf) / sqrt(sum(tf * idf * tf * idf)) AS score FROM post JOIN idf USING (term) GROUP BY doc_id) """ + tail


_TOP = "SELECT doc_id, round(score, 6) AS score FROM ranked"
_EDGES = "edges AS (SELECT c_nationkey AS src, s_nationkey AS dst FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey)"


def _ranks(nodes: str = "TRUE", edges: str = "TRUE") -> str:
    return _ranks_of(_EDGES, f"SELECT n_nationkey AS id FROM nation WHERE {nodes}", edges)


def _ranks_of(table: str, nodes: str, edges: str = "TRUE") -> str:
    """The rounds, unrolled."""
    out = f"""{table}, e AS MATERIALIZED (SELECT src, dst, count(*) / (sum(count(*)) OVER (PARTITION BY src)) AS p FROM edges WHERE {edges} GROUP BY src, dst),
v AS MATERIALIZED ({nodes}), r0 AS (SELECT id, 1.0::DOUBLE AS rank FROM v)"""
    for i in range(ROUNDS):
        out += f", r{i + 1} AS MATERIALIZED (SELECT v.id, 0.15 + 0.85 * coalesce(sum(p * rank), 0) AS rank FROM v LEFT JOIN (SELECT e.dst, e.p, r{i}.rank FROM e JOIN r{i} ON e.src = r{i}.id) x ON x.dst = v.id GROUP BY v.id)"
    return out


def _values(rows) -> str:
    return ", ".join(f"('{a}', '{b}')" for a, b in rows)


#: The crawl's pages as its files hold them, without the last newline.
_PAGES = r"documents AS (SELECT item_id AS doc_id, item_id || chr(10) || 'url' || item_id || chr(10) || replace(coalesce(text, ''), chr(13) || chr(10), chr(10)) AS text FROM benchmark)"
_IN = ", ".join(f"'{t}'" for t in KEYS)
ORACLES = {
    "doc_scan": "SELECT doc_id, text FROM documents",
    "doc_keys": "SELECT doc_id FROM documents",
    "doc_get": "SELECT doc_id, text FROM documents WHERE doc_id = 17",
    "doc_count": "SELECT count(*) AS n FROM documents",
    "doc_upsert": "SELECT doc_id, CASE WHEN doc_id % 10 = 0 THEN 'new ' || doc_id ELSE text END AS text FROM documents",
    "doc_bulk_load": "SELECT doc_id, row_number() OVER (ORDER BY doc_id) AS rn FROM documents",
    "analyze_naive": r"SELECT doc_id, rtrim(array_to_string(regexp_split_to_array(lower(coalesce(text, '')), '[ \t\n\x0b\f\r]+'), ' '), ' ') AS tokens FROM documents",
    "analyze_punct": f"WITH {_TOKS} SELECT doc_id, array_to_string(a, '|') AS tokens FROM toks",
    "stopword_filter": f"WITH {_TOKS} SELECT doc_id, len([t FOR t IN {_SPLIT} IF t <> '']) AS words, len(a) AS kept FROM documents JOIN toks USING (doc_id)",
    "distinct_terms": f"WITH {_TOKS} SELECT doc_id, len(list_distinct(a)) AS terms FROM toks",
    "term_positions": f"WITH {_POST} SELECT doc_id, positions FROM post WHERE term = 'tion'",
    "postings": f"WITH {_POST} SELECT term, doc_id, tf, positions FROM post",
    "inverted_lists": f"WITH {_POST} SELECT term, string_agg(CAST(doc_id AS VARCHAR), ',' ORDER BY doc_id) AS doc_ids FROM post GROUP BY term",
    "term_frequency": f"WITH {_OCC} SELECT doc_id, term, count(*) AS tf FROM occ GROUP BY doc_id, term",
    "dictionary_df": f"WITH {_OCC} SELECT term, count(DISTINCT doc_id) AS df FROM occ GROUP BY term",
    "segments": f"WITH {_SEG} SELECT doc_id, segment_id, local_id FROM seg",
    "segment_num_docs": f"WITH {_SEG} SELECT segment_id, count(*) AS docs FROM seg GROUP BY segment_id",
    "num_segments": f"WITH {_SEG} SELECT count(DISTINCT segment_id) AS n FROM seg",
    "segment_df": f"WITH {_SEG}, {_OCC} SELECT segment_id, term, count(DISTINCT doc_id) AS df FROM occ JOIN seg USING (doc_id) GROUP BY segment_id, term",
    "segment_docs_scan": f"WITH {_SEG} SELECT segment_id, local_id, doc_id, text FROM seg WHERE segment_id = 1",
    "segment_postings": f"WITH {_SEG}, {_POST} SELECT segment_id, term, local_id, tf, positions FROM post JOIN seg USING (doc_id) WHERE segment_id = 1",
    "segment_merge": f"WITH {_SEG} SELECT CAST(segment_id // 2 AS INTEGER) AS segment_id, CAST(local_id + CASE WHEN segment_id % 2 = 1 THEN {SEGMENT} ELSE 0 END AS INTEGER) AS local_id, doc_id FROM seg",
    "merge_with_delete": f"WITH {_SEG}, {_POST} SELECT CAST(segment_id // 2 AS INTEGER) AS segment_id, term, count(*) AS df, CAST(sum(local_id + CASE WHEN segment_id % 2 = 1 THEN {SEGMENT} ELSE 0 END) AS BIGINT) AS ids FROM post JOIN seg USING (doc_id) WHERE term <> 'ing' GROUP BY ALL",
    "search_fullscan": f"WITH {_TOKS} SELECT doc_id FROM toks WHERE list_has_all(a, ['tion', 'ing', 'ly'])",
    "search_keyword": f"WITH {_OCC} SELECT DISTINCT doc_id FROM occ WHERE term = 'tion'",
    "search_and": f"WITH {_OCC} SELECT doc_id FROM occ WHERE term IN ({_IN}) GROUP BY doc_id HAVING count(DISTINCT term) = 3",
    "search_or": f"WITH {_OCC} SELECT DISTINCT doc_id FROM occ WHERE term IN ({_IN})",
    "search_phrase2": _phrase(PHRASE2),
    "search_phrase3": _phrase(PHRASE3),
    "search_phrase_repeat": _phrase(["ing", "ing"]),
    "search_keyword_deleted": f"WITH {_OCC} SELECT DISTINCT doc_id, term AS keyword FROM occ WHERE term IN ({_IN}) AND term <> 'ing'",
    "search_and_deleted": f"WITH {_OCC} SELECT doc_id, 'tion ly' AS pair FROM occ WHERE term IN ('tion', 'ly') GROUP BY doc_id HAVING count(DISTINCT term) = 2",
    "search_or_deleted": f"WITH {_OCC} SELECT DISTINCT doc_id FROM occ WHERE term IN ({_IN}) AND term <> 'ing'",
    "tfidf_all": "WITH " + _tfidf(KEYS, _TOP),
    "tfidf_topk": "WITH " + _tfidf(RANKED, _TOP + " ORDER BY ranked.score DESC, doc_id LIMIT 10"),
    "tfidf_dup_query_terms": "WITH " + _tfidf(RANKED, _TOP),
    "tfidf_multi_segment": "WITH " + _tfidf(RANKED, _TOP),
    "pagerank_k": f"WITH {_ranks()} SELECT id, round(rank, 6) AS rank FROM r{ROUNDS}",
    "pagerank_dangling": f"WITH {_ranks('n_nationkey < 20', 'src > 4')} SELECT id, round(rank, 6) AS rank FROM r{ROUNDS}",
    "out_degree": f"WITH {_EDGES} SELECT src, count(*) AS degree FROM edges GROUP BY src",
    "combined_rank": f"WITH {_ranks()}, " + _tfidf(RANKED, f"SELECT doc_id, round(score + 2.5 * rank, 6) AS score FROM ranked JOIN r{ROUNDS} ON id = doc_id % 25 ORDER BY ranked.score + 2.5 * rank DESC, doc_id LIMIT 20"),
    "url_nodes": "SELECT CAST(page_id AS INTEGER) AS id, url FROM pages",
    "graph_edges": f"WITH {_EDGES} SELECT src, dst, count(*) AS m FROM edges GROUP BY src, dst",
    "dictionary_probability": f"WITH {_OCC}, f AS (SELECT term AS word, count(DISTINCT doc_id) AS freq FROM occ GROUP BY term) SELECT word, round(freq / (SELECT sum(freq) FROM f), 12) AS p FROM f",
    "dictionary_rewrite": f"WITH {_OCC} SELECT term || ' ' || count(DISTINCT doc_id) AS value FROM occ GROUP BY term",
    "list_operations": f"WITH {_TOKS} SELECT doc_id, array_to_string([t FOR t IN a IF t IN ({_IN})], ',') AS common, len(list_distinct(list_concat(a, [{_IN}]))) AS terms FROM toks",
    "porter_golden": f"SELECT term, stem FROM (VALUES {_values(STEMS.items())}) v(term, stem)",
    "analyze_composed_golden": "SELECT CAST(doc_id AS BIGINT) AS doc_id, tokens FROM (VALUES (1, 'ponies:|hop|motor|cat|part|7|r2d2|size'), (2, 'poni|cat|hop')) v(doc_id, tokens)",
    "wordbreak_golden": "SELECT CAST(id AS INTEGER) AS id, tokens FROM (VALUES (1, 'like|icecream'), (2, 'like|ice'), (3, NULL)) v(id, tokens)",
    "codec_varbyte_golden": f"SELECT ints, bytes FROM (VALUES {_values(DELTAS.items())}) v(ints, bytes)",
    "codec_naive_golden": "SELECT '1,256,-1' AS ints, '0000000100000100FFFFFFFF' AS bytes",
    "codec_roundtrip": f"WITH {_POST} SELECT term, doc_id, positions FROM post",
    "codec_size_ratio": f"WITH {_OCC}, g AS (SELECT pos - coalesce(lag(pos) OVER (PARTITION BY doc_id, term ORDER BY pos), 0) AS gap FROM occ) SELECT CAST(4 * count(*) AS BIGINT) AS naive, CAST(sum(CASE WHEN gap < 128 THEN 1 WHEN gap < 16384 THEN 2 ELSE 3 END) AS BIGINT) AS delta FROM g",
    "ingest_stream_segments": f"WITH {_OCC} SELECT doc_id, term, count(*) AS tf FROM occ GROUP BY doc_id, term",
    "store_scan": "SELECT doc_id, CASE WHEN doc_id % 10 = 0 THEN 'new ' || doc_id ELSE text END AS text FROM documents",
    "store_keys": "SELECT doc_id FROM documents",
    "store_get": "SELECT k AS doc_id, CASE WHEN k = 20 THEN 'new 20' ELSE text END AS text FROM (VALUES (17::BIGINT), (20), (-1)) v(k) LEFT JOIN documents ON doc_id = k",
    "store_size": "SELECT count(*) AS n FROM documents",
    "index_documents": f"WITH {_SEG} SELECT segment_id, local_id, doc_id, text FROM seg",
    "index_segments": f"WITH {_SEG} SELECT segment_id, count(*) AS docs FROM seg GROUP BY segment_id",
    "index_lookup": f"WITH {_SEG}, {_POST} SELECT segment_id, local_id, doc_id, tf, positions FROM post JOIN seg USING (doc_id) WHERE term = 'tion'",
    "index_load": f"WITH {_SEG}, {_OCC}, n AS (SELECT segment_id, count(*) AS docs FROM seg GROUP BY segment_id), u AS (SELECT DISTINCT doc_id, term FROM occ) SELECT segment_id, docs, term, string_agg(CAST(local_id AS VARCHAR), ',' ORDER BY local_id) AS ids FROM u JOIN seg USING (doc_id) JOIN n USING (segment_id) GROUP BY segment_id, docs, term",
    "index_keyword": f"WITH {_SEG}, {_OCC} SELECT DISTINCT segment_id, local_id, doc_id FROM occ JOIN seg USING (doc_id) WHERE term = 'tion'",
    "index_and": f"WITH {_SEG}, {_OCC} SELECT segment_id, local_id, doc_id FROM occ JOIN seg USING (doc_id) WHERE term IN ({_IN}) GROUP BY ALL HAVING count(DISTINCT term) = 3",
    "index_or": f"WITH {_SEG}, {_OCC} SELECT DISTINCT segment_id, local_id, doc_id FROM occ JOIN seg USING (doc_id) WHERE term IN ({_IN})",
    "index_phrase": f"WITH {_SEG}, hits AS ({_phrase(PHRASE3)}) SELECT segment_id, local_id, doc_id FROM hits JOIN seg USING (doc_id)",
    "index_tfidf": "WITH " + _tfidf(RANKED, _TOP),
    "index_twice": f"WITH {_SEG}, hits AS ({_phrase(PHRASE3)}), n AS (SELECT max(segment_id) + 1 AS n FROM seg) SELECT CAST(segment_id + k * n AS INTEGER) AS segment_id, local_id, doc_id FROM hits JOIN seg USING (doc_id), n, (VALUES (0), (1)) v(k)",
    "index_deleted": f"WITH {_SEG}, {_OCC} SELECT DISTINCT segment_id, local_id, doc_id FROM occ JOIN seg USING (doc_id) WHERE term IN ({_IN}) AND term <> 'ing'",
    "index_delta_postings": f"WITH {_POST} SELECT term, doc_id, tf, positions FROM post",
    "crawl_documents": f"WITH {_PAGES} SELECT text FROM documents",
    "engine_search": f"WITH {_PAGES}, "
    + _ranks_of("edges AS (SELECT doc_id AS src, doc_id // 2 AS dst FROM documents UNION ALL SELECT doc_id, doc_id * 3 % 11 FROM documents)", "SELECT doc_id AS id FROM documents")
    + ", " + _tfidf(ENGINE_KEYS, f"SELECT round(score + 2.5 * rank, 6) AS score, text FROM ranked JOIN documents USING (doc_id) JOIN r{ROUNDS} ON id = doc_id"),
    "japanese_golden": "SELECT CAST(id AS INTEGER) AS id, tokens FROM (VALUES (1, '私|は|本|を|読む'), (2, '猫|が|好き|です'), (3, '本屋'), (4, NULL)) v(id, tokens)",
}
ORACLES["index_merged"] = ORACLES["merge_with_delete"]
ORACLES["index_codec_bytes"] = ORACLES["codec_size_ratio"]
