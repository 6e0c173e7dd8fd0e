"""The positional inverted index: postings, segments, merging, term deletion, and an index folder with a manifest."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from contextlib import suppress
from dataclasses import dataclass, field, replace

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loamdex.functions.analysis import Analyzer
from loamdex.functions.codec import Compressor
from loamdex.sources.store import number_rows

FLUSH_DOCS, MERGE_SEGMENTS = 1000, 8
#: Text of a segment (about), where no number of documents is given; never fewer than FLUSH_DOCS documents.
SEGMENT_BYTES = 256 << 20
#: Manifests whose files stay when old ones are removed.
KEPT_VERSIONS = 2
#: Texts whose postings are gathered at once, and texts (about) of a task that makes postings, where these are many.
GATHERED_ROWS, TASK_DOCS = 500, 500


def assign_segments(docs: DataFrame, threshold: int = FLUSH_DOCS) -> DataFrame:
    """docs with segment_id and local_id: by doc_id, `threshold` documents a segment."""
    rows = number_rows(docs, "doc_id", "rn")
    at = F.col("rn") - 1
    return rows.select(*docs.columns, F.floor(at / threshold).cast("int").alias("segment_id"), (at % threshold).cast("int").alias("local_id"))


def build_postings(docs: DataFrame, analyzer: Analyzer, positional: bool = True, compressor: Compressor | None = None) -> DataFrame:
    """(term, doc_id, tf, positions) of docs (doc_id, text); with segment_id and local_id if docs has them.  compressor: positions are its bytes.

    Positions are gathered text by text, and nothing is shuffled for them; only
    where a doc_id comes again (and no local_id tells its texts apart) are the
    lists of an id put together.
    """
    own = [c for c in ("segment_id", "local_id") if c in docs.columns]
    if not positional:
        return analyzer.occurrences(docs, *own).groupBy(*own, "term", "doc_id").agg(F.count(F.lit(1)).alias("tf"))
    encoded = lambda rows: rows if compressor is None else rows.withColumn("positions", compressor.encode(F.col("positions").cast("array<bigint>")))
    if len(own) == 2:
        spelled = compressor.spelled if compressor is not None else None
        found = _gathered(analyzer.analyzed(docs, *own), own, spelled)
        return found if spelled else encoded(found)
    found = _gathered(analyzer.analyzed(docs, *own), own)
    if docs.groupBy(*own, "doc_id").count().where("count > 1").isEmpty():
        return encoded(found)
    whole = F.sort_array(F.flatten(F.collect_list("positions"))).alias("positions")
    return encoded(found.groupBy(*own, "term", "doc_id").agg(F.sum("tf").alias("tf"), whole))


def _gathered(analyzed: DataFrame, own: list[str], spelled: Callable | None = None) -> DataFrame:
    """(own columns, term, doc_id, tf, positions) of (own columns, doc_id, terms): a row for each term of each row.

    With segments, rows of a batch come by segment and term, as an index sorts
    them: a sort that meets long ordered runs has little to compare.
    """
    kinds = [f"{f.name} {f.dataType.simpleString()}" for f in analyzed.schema][:-1]
    schema = ", ".join([*kinds[:-1], "term string", kinds[-1], "tf long", f"positions {'binary' if spelled else 'array<int>'}"])
    names = [*own, "term", "doc_id", "tf", "positions"]
    rows = GATHERED_ROWS

    def run(batches):
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        for batch in (b.slice(i, rows) for b in batches for i in range(0, b.num_rows, rows)):
            lists = batch.column(batch.num_columns - 1)
            sizes = pc.list_value_length(lists).fill_null(0).to_numpy(zero_copy_only=False)
            coded = lists.flatten().dictionary_encode(null_encoding="encode")
            codes = coded.indices.to_numpy().astype(np.int64)
            if not len(codes):
                continue
            row = np.repeat(np.arange(len(sizes)), sizes)
            pos = (np.arange(len(codes)) - np.repeat(np.cumsum(sizes) - sizes, sizes)).astype(np.int32)
            keys = row * len(coded.dictionary) + codes
            if "segment_id" in own:
                segment = np.unique(batch.column(own.index("segment_id")).to_numpy(zero_copy_only=False), return_inverse=True)[1]
                ranks = np.empty(len(coded.dictionary), np.int64)
                ranks[pc.array_sort_indices(coded.dictionary).to_numpy()] = np.arange(len(ranks))
                keys = (segment[row] * len(ranks) + ranks[codes]) * len(sizes) + row
            order = np.argsort(keys, kind="stable")
            keys = keys[order]
            first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
            bounds = np.append(first, len(keys))
            held = [c.take(pa.array(row[order[first]])) for c in batch.columns[:-1]]
            positions = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(pos[order]))
            positions = spelled(positions) if spelled else positions
            terms = coded.dictionary.take(pa.array(codes[order[first]]))
            yield pa.RecordBatch.from_arrays([*held[:-1], terms, held[-1], pa.array(np.diff(bounds)), positions], names=names)

    return analyzed.mapInArrow(run, schema)


def _packed(rows: DataFrame) -> DataFrame:
    """(segment_id, part) of rows (segment_id, ...): runs of a segment's rows as compressed Arrow data, so that a shuffle has little to move."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            segments, schema = batch.column(0).to_numpy(zero_copy_only=False), pa.schema(list(batch.schema)[1:])
            rest = pa.RecordBatch.from_arrays(batch.columns[1:], schema=schema)
            starts, parts = np.flatnonzero(np.diff(segments, prepend=-1)).tolist(), []
            for a, b in zip(starts, [*starts[1:], len(segments)], strict=True):
                sink = pa.BufferOutputStream()
                with pa.ipc.new_stream(sink, schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
                    out.write_batch(rest.slice(a, b - a))
                parts.append(sink.getvalue().to_pybytes())
            yield pa.RecordBatch.from_arrays([pa.array(segments[starts], pa.int32()), pa.array(parts, pa.binary())], names=["segment_id", "part"])

    return rows.mapInArrow(run, "segment_id int, part binary")


def _nested(docs: DataFrame, postings: DataFrame) -> DataFrame:
    """(segment_id, documents, postings): a row a segment of docs, documents by local id, and the list of each term by term and local id."""
    entry = [c for c in ("local_id", "tf", "positions") if c in postings.columns]
    kinds = ", ".join(f"{c}: {postings.schema[c].dataType.simpleString()}" for c in entry)

    def run(docs, postings):
        import numpy as np
        import pyarrow as pa

        def table(packed, *order):
            rows = pa.concat_tables(pa.ipc.open_stream(part).read_all() for part in packed.column("part").to_pylist())
            rows = rows.sort_by([(c, "ascending") for c in order])
            return {c: pa.concat_arrays(rows.column(c).chunks) for c in rows.column_names}

        def one(values):
            return pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)

        held = table(docs, "local_id", "doc_id", "text")
        names = ["local_id", "doc_id", "text"]
        documents = one(pa.StructArray.from_arrays([held[c] for c in names], names=names))
        element = pa.struct([("term", pa.string()), ("list", pa.list_(pa.struct([("local_id", pa.int32()), ("tf", pa.int64()), ("positions", pa.list_(pa.int32()))][: len(entry)])))])
        if not postings.num_rows:
            terms = pa.nulls(1, pa.list_(element))
        else:
            held = table(postings, "term", "local_id")
            coded = held["term"].dictionary_encode(null_encoding="encode")  # terms are in order, so codes ascend
            bounds = np.searchsorted(coded.indices.to_numpy(), np.arange(len(coded.dictionary) + 1))
            lists = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.StructArray.from_arrays([held[c] for c in entry], names=entry))
            terms = one(pa.StructArray.from_arrays([coded.dictionary, lists], names=["term", "list"]))
        return pa.table({"segment_id": docs.column("segment_id").slice(0, 1), "documents": documents, "postings": terms})

    left, right = (_packed(rows.select("segment_id", *columns)).groupBy("segment_id") for rows, columns in ((docs, ["local_id", "doc_id", "text"]), (postings, ["term", *entry])))
    documents = "array<struct<local_id: int, doc_id: bigint, text: string>>"
    return left.cogroup(right).applyInArrow(run, f"segment_id int, documents {documents}, postings array<struct<term: string, list: array<struct<{kinds}>>>>")


def inverted_lists(postings: DataFrame) -> DataFrame:
    """(term, doc_ids): ascending ids of each term; the nested view of the postings, for export."""
    return postings.groupBy("term").agg(F.sort_array(F.collect_list("doc_id")).alias("doc_ids"))


def dictionary(postings: DataFrame) -> DataFrame:
    """(term, df); a row a segment as well, where postings have segments."""
    by = [c for c in ("segment_id",) if c in postings.columns]
    return postings.groupBy(*by, "term").agg(F.count(F.lit(1)).alias("df"))


def without_terms(postings: DataFrame, tombstones: DataFrame) -> DataFrame:
    """postings but for deleted terms."""
    return postings.join(tombstones.select("term").distinct(), "term", "left_anti")


def merge_segments(rows: DataFrame, counts: DataFrame | None = None) -> DataFrame:
    """rows (segment_id, local_id, ...) after merging segments 0 and 1, 2 and 3, ...: ids of the right ones follow the left ones'.

    counts has (segment_id, docs); a last segment without a partner stays whole.
    """
    counts = rows.groupBy("segment_id").agg(F.count(F.lit(1)).alias("docs")) if counts is None else counts
    left = counts.where("segment_id % 2 = 0").select((F.col("segment_id") + 1).alias("segment_id"), F.col("docs").alias("shift"))
    moved = rows.join(left, "segment_id", "left")
    local = F.col("local_id") + F.coalesce("shift", F.lit(0))
    others = (c for c in rows.columns if c not in ("segment_id", "local_id"))
    return moved.select(F.floor(F.col("segment_id") / 2).cast("int").alias("segment_id"), local.cast("int").alias("local_id"), *others)


class Conflict(RuntimeError):
    """Another writer has published the version that this one was about to."""


class Superseded(RuntimeError):
    """Another merge has replaced the segments that this one has merged."""


@dataclass
class Index:
    """An index folder: documents, postings and segment sizes in batches, and numbered manifests that name the batches.

    A batch is what one flush or merge wrote; it holds its segments by number
    from 0, and the manifest gives their first id, so ids are 0, 1, 2, ... over
    all batches.  A commit writes files first and then the next manifest, under
    a number that must be free; readers take the greatest one, so they see the
    old state or the new one, and no update is lost.  With a compressor,
    positions are stored as its bytes.
    """

    spark: SparkSession
    path: str
    analyzer: Analyzer = field(default_factory=Analyzer)
    positional: bool = True
    merge_at: int = MERGE_SEGMENTS
    compressor: Compressor | None = None

    def _file(self, name: str):
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        return path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), path

    def _names(self, folder: str) -> list[str]:
        fs, path = self._file(folder)
        return sorted(f.getPath().getName() for f in fs.listStatus(path)) if fs.exists(path) else []

    def _state(self, name: str) -> dict:
        fs, path = self._file(f"manifests/{name}")
        stream = fs.open(path)
        try:
            return json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    def manifest(self) -> dict:
        """The current state: its version, batches (name, first, segments, docs), deleted terms, and streams' last batches."""
        if names := self._names("manifests"):
            return self._state(names[-1])
        return {"version": 0, "batches": [], "deleted": [], "streams": {}}

    def _publish(self, state: dict) -> None:
        """The state as the version after the one that it was read from; Conflict if another writer was first."""
        state = {**state, "version": state["version"] + 1}
        fs, path = self._file(f"manifests/{state['version']:012d}.json")
        _, draft = self._file(f"drafts/{uuid.uuid4().hex}")
        out = fs.create(draft, True)
        out.write(bytearray(json.dumps(state).encode()))
        out.close()
        fs.mkdirs(path.getParent())
        hadoop = self.spark.sparkContext._jvm.org.apache.hadoop.fs
        context = hadoop.FileContext.getFileContext(fs.getUri(), self.spark.sparkContext._jsc.hadoopConfiguration())
        options = self.spark.sparkContext._gateway.new_array(getattr(hadoop, "Options$Rename"), 0)
        try:  # a rename that does not overwrite: the manifest appears whole, or not at all
            context.rename(draft, path, options)
        except Py4JJavaError as e:
            fs.delete(draft, False)
            if "FileAlreadyExistsException" not in str(e.java_exception.getClass().getName()):
                raise
            raise Conflict(f"version {state['version']} is taken") from None

    def _update(self, change: Callable[[dict], dict]) -> dict:
        """Publish a change of the current state, again on the newer one where another writer was first."""
        while True:
            try:
                state = change(self.manifest())
                self._publish(state)
                return state
            except Conflict:
                continue

    def _read(self, kind: str, batches: list[dict], keep_bytes: bool = False) -> DataFrame:
        """A table of batches, with the ids that the manifest gives their segments."""
        positions = "" if not self.positional else ", positions array<int>" if self.compressor is None else ", positions binary"
        schema = {
            "docs": "doc_id long, text string, local_id int, segment_id int",
            "postings": f"term string, doc_id long, local_id int, tf long{positions}, segment_id int",
            "segments": "segment_id int, docs long",
        }[kind]
        out = None
        for b in batches:
            rows = self.spark.read.schema(schema).parquet(f"{self.path}/{kind}/{b['name']}")
            if b["first"]:
                rows = rows.withColumn("segment_id", (F.col("segment_id") + b["first"]).cast("int"))
            out = rows if out is None else out.unionByName(rows)
        out = self.spark.createDataFrame([], schema) if out is None else out
        if kind == "postings" and self.positional and self.compressor is not None and not keep_bytes:
            out = out.withColumn("positions", self.compressor.decode(F.col("positions")).cast("array<int>"))
        return out

    def _table(self, kind: str, segment: int | None, state: dict | None = None, keep_bytes: bool = False) -> DataFrame:
        batches = (state or self.manifest())["batches"]
        if segment is None:
            return self._read(kind, batches, keep_bytes)
        held = [b for b in batches if b["first"] <= segment < b["first"] + b["segments"]]
        return self._read(kind, held, keep_bytes).where(F.col("segment_id") == segment)

    def documents(self, segment: int | None = None) -> DataFrame:
        """All documents, or those of one segment."""
        return self._table("docs", segment)

    def segments(self) -> DataFrame:
        """(segment_id, docs)."""
        return self._table("segments", None)

    def postings(self, segment: int | None = None, hidden: bool = True) -> DataFrame:
        """Postings without deleted terms (hidden=False: with them)."""
        state = self.manifest()
        rows = self._table("postings", segment, state)
        return rows.where(~F.col("term").isin(state["deleted"])) if hidden and state["deleted"] else rows

    def lookup(self, term: str, segment: int | None = None) -> DataFrame:
        """The posting list of one analyzed term, by segment and local id; files are sorted by term, so few row groups are read."""
        return self.postings(segment).where(F.col("term") == term).orderBy("segment_id", "local_id")

    def load(self, segment: int | None = None) -> DataFrame | None:
        """A whole segment as one nested row (segment_id, documents, postings), or all of them, a row each; None if there are no documents."""
        if not self.num_documents(segment):
            return None
        return _nested(self.documents(segment), self.postings(segment, hidden=False))

    @property
    def num_segments(self) -> int:
        return sum(b["segments"] for b in self.manifest()["batches"])

    def num_documents(self, segment: int | None = None) -> int:
        if segment is None:
            return sum(b["docs"] for b in self.manifest()["batches"])
        row = self._table("segments", segment).first()
        return row.docs if row else 0

    def document_frequency(self, segment: int, token: str) -> int:
        return self.postings(segment, hidden=False).where(F.col("term") == token).count()

    def stored_bytes(self) -> DataFrame:
        """One row (bytes): those of all stored positions, as the compressor spells them."""
        rows = self._table("postings", None, keep_bytes=True)
        return rows.agg(F.coalesce(F.sum(F.length("positions").cast("long")), F.lit(0)).alias("bytes"))

    def _write(self, docs: DataFrame, postings: DataFrame | None, name: str) -> dict:
        """Both tables under one name, and the sizes of the segments that they hold; without postings, those of docs are made."""
        batch = {"name": name, "first": 0}
        docs.write.mode("overwrite").parquet(f"{self.path}/docs/{name}")
        counts = self._read("docs", [batch]).groupBy("segment_id").agg(F.count(F.lit(1)).alias("docs"))
        counts.write.mode("overwrite").parquet(f"{self.path}/segments/{name}")
        size = self._read("segments", [batch]).agg(F.count(F.lit(1)).alias("segments"), F.coalesce(F.sum("docs"), F.lit(0)).alias("docs")).first()
        if postings is None:
            made = self._postings_of(batch, size.docs)
        else:
            made = self._encoded(postings).repartitionByRange("segment_id", "term")
        # Sorted by term, so that a look-up skips row groups by their statistics.
        columns = ["term", "doc_id", "local_id", "tf", *(["positions"] if self.positional else []), "segment_id"]
        made.select(*columns).sortWithinPartitions("segment_id", "term", "local_id").write.mode("overwrite").parquet(f"{self.path}/postings/{name}")
        return {**batch, "segments": size.segments, "docs": size.docs}

    def _postings_of(self, batch: dict, docs: int) -> DataFrame:
        """Postings of a batch's stored documents, a task a range of segments or a part of one.

        The documents are dealt, not their many postings: these are made where
        they are sorted and written, and nothing is analyzed twice to find ranges.
        """
        held = self._read("docs", [batch])
        if not self.positional:
            return build_postings(held, self.analyzer, False).repartitionByRange("segment_id", "term")
        tasks = min(int(self.spark.conf.get("spark.sql.shuffle.partitions")), -(-docs // TASK_DOCS))
        dealt = held.repartitionByRange(max(1, tasks), "segment_id", "local_id").sortWithinPartitions("segment_id", "local_id")
        return build_postings(dealt, self.analyzer, compressor=self.compressor)

    def _encoded(self, postings: DataFrame) -> DataFrame:
        if not self.positional or self.compressor is None:
            return postings
        return postings.withColumn("positions", self.compressor.encode(F.col("positions").cast("array<bigint>")))

    def copy(self, path: str, compressor: Compressor | None = None) -> Index:
        """The current state in a new folder, with positions under another codec; nothing is analyzed or sorted again."""
        out, state = replace(self, path=path, compressor=compressor), self.manifest()
        for b in state["batches"]:
            batch = {**b, "first": 0}
            for kind in ("docs", "segments", "postings"):
                rows = self._read(kind, [batch])
                rows = out._encoded(rows) if kind == "postings" else rows
                rows.write.mode("overwrite").parquet(f"{path}/{kind}/{b['name']}")
        out._publish({**state, "version": 0})
        return out

    def _threshold(self, docs: DataFrame) -> int:
        size = docs.agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length("text")).alias("bytes")).first()
        return max(FLUSH_DOCS, int(SEGMENT_BYTES * size.n / max(1, size.bytes or 0)))

    def add(self, docs: DataFrame, threshold: int | None = FLUSH_DOCS, stream: tuple[str, int] | None = None) -> None:
        """Flush docs (doc_id, text) as new segments of so many documents (None: by their size); then merge, if there are merge_at or more.

        stream: a stream's name and batch number; a batch that is in already is left out.
        """
        if stream is not None and stream[1] <= self.manifest()["streams"].get(stream[0], -1):
            return
        docs = docs.select(F.col("doc_id").cast("long"), "text")
        dealt = assign_segments(docs, threshold or self._threshold(docs)).select("doc_id", "text", "local_id", "segment_id")
        batch = self._write(dealt, None, uuid.uuid4().hex if stream is None else f"{stream[0]}-{stream[1]}")

        def change(state: dict) -> dict:
            first = sum(b["segments"] for b in state["batches"])
            batches = state["batches"] + ([{**batch, "first": first}] if batch["docs"] else [])
            streams = state["streams"] if stream is None else {**state["streams"], stream[0]: stream[1]}
            return {**state, "batches": batches, "streams": streams}

        state = self._update(change)
        if sum(b["segments"] for b in state["batches"]) >= self.merge_at:
            with suppress(Superseded):
                self.merge()

    def delete_term(self, keyword: str) -> None:
        """Hide the keyword's tokens from keyword, AND, OR and phrase search; the next merge removes them."""
        tokens = self.analyzer.analyze(keyword)
        self._update(lambda state: {**state, "deleted": sorted({*state["deleted"], *tokens})})

    def merge(self) -> None:
        """Merge segments in pairs, drop deleted terms, and forget the deletions; then remove what no late manifest names."""
        state = self.manifest()
        if not state["batches"]:
            return
        counts = self._table("segments", None, state)
        rows = self._table("postings", None, state)
        rows = rows.where(~F.col("term").isin(state["deleted"])) if state["deleted"] else rows
        docs, postings = (merge_segments(t, counts) for t in (self._table("docs", None, state), rows))
        batch = self._write(docs.select("doc_id", "text", "local_id", "segment_id"), postings, uuid.uuid4().hex)
        merged = {b["name"] for b in state["batches"]}

        def change(now: dict) -> dict:
            """Batches that came meanwhile follow; if another merge took any of these, this one is void."""
            if not merged <= {b["name"] for b in now["batches"]}:
                raise Superseded("another merge has replaced these segments")
            batches, first = [batch], batch["segments"]
            for b in now["batches"]:
                if b["name"] not in merged:
                    batches.append({**b, "first": first})
                    first += b["segments"]
            # Terms deleted meanwhile stay deleted.
            return {**now, "batches": batches, "deleted": [t for t in now["deleted"] if t not in state["deleted"] or len(batches) > 1]}

        self._update(change)
        self.vacuum()

    def vacuum(self, kept: int = KEPT_VERSIONS) -> int:
        """Remove manifests but for the last `kept`, and the files of batches that these do not name; the number of paths removed.

        Files of a flush that is under way have no manifest yet: run this when no
        other writer is at work, or where a failed flush may be tried again.
        """
        names = self._names("manifests")
        held, old = names[-kept:], names[:-kept]
        used = {b["name"] for n in held for b in self._state(n)["batches"]}
        known = {b["name"] for n in old for b in self._state(n)["batches"]}
        gone = [f"{kind}/{n}" for kind in ("docs", "postings", "segments") for n in self._names(kind) if n in known - used]
        for name in [*gone, *(f"manifests/{n}" for n in old)]:
            fs, path = self._file(name)
            fs.delete(path, True)
        return len(gone) + len(old)
