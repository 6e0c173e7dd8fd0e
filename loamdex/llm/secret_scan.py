"""Secret scans over an incremental blob ledger, in DataFrame functions only.

Every version of every file is content-addressed: equal contents are one blob,
whatever their paths.  A ledger holds what each version of each rule found in
each blob; a scan looks only at the pairs of blob and rule version that the
ledger lacks, and joins the findings back to all paths.  Positions come from
the lengths of the matches and of the pieces between them, so that the regular
expressions run on the JVM, inside whole-table expressions.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loamdex.llm.common import keyed, new_path, stored


@dataclass(frozen=True)
class Rule:
    """Leftmost non-overlapping matches of pattern (in the text's lower case if folded); those whose group is shorter than least code points are dropped.

    hint: a cheap expression that every text with a match fulfils.  version
    changes whenever anything else does.
    """

    kind: str
    pattern: str
    version: int = 1
    group: int = 0
    least: int = 1
    hint: str = ""

    @property
    def key(self) -> str:
        return f"{self.kind}/{self.version}"

    def spans(self, text: Column) -> Column:
        """array<struct<start, end>> in code points, end exclusive."""
        whole = F.regexp_extract_all(text, F.lit(f"({self.pattern})"), F.lit(1))
        judged = whole if self.group == 0 else F.regexp_extract_all(text, F.lit(self.pattern), F.lit(self.group))
        gaps = F.split(text, self.pattern, -1)
        sizes = lambda texts, name: F.transform(texts, lambda x: F.length(x)).alias(name)
        found = F.arrays_zip(sizes(gaps, "gap"), sizes(whole, "size"), sizes(judged, "judged"))
        start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("spans"))

        def step(acc: Column, m: Column) -> Column:
            begin = acc["at"] + m["gap"]
            end = begin + F.coalesce(m["size"], F.lit(0))
            held = F.when(m["judged"] >= self.least, F.concat(acc["spans"], F.array(F.struct(begin.alias("start"), end.alias("end"))))).otherwise(acc["spans"])
            return F.struct(end.alias("at"), held.alias("spans"))

        counted = F.aggregate(found, start, step, lambda acc: acc["spans"])
        none = F.array().cast("array<struct<start:int,end:int>>")
        return F.when(text.rlike(self.hint or self.pattern), counted).otherwise(none)


# The base rules of the query's contract.
BASE_RULES = (
    Rule("assign", r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", group=2, least=6),
    Rule("access", r"AKIA[A-Z0-9]{16,}"),
    Rule("hex", r"[0-9a-f]{24,}"),
)
#: Rules beyond the base: well-known credential formats.
MORE_RULES = (
    Rule("private_key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----[A-Za-z0-9+/=\s]*(?:-----END [A-Z ]*PRIVATE KEY-----)?", hint="PRIVATE KEY-----"),
    Rule("forge_token", r"\b(?:gh[pousr]_[A-Za-z0-9]{36,}|glpat-[A-Za-z0-9_-]{20,})", hint="gh[pousr]_|glpat-"),
    Rule("chat_token", r"\bxox[abprs]-[A-Za-z0-9-]{10,}", hint="xox[abprs]-"),
    Rule("cloud_key", r"\bAIza[A-Za-z0-9_-]{35}", hint="AIza"),
    Rule("web_token", r"\beyJ[A-Za-z0-9_-]{10,}\.eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}", hint="eyJ"),
    Rule("url_login", r"\b[a-z][a-z0-9+.-]{1,20}://[^\s:/@]{1,64}:[^\s:/@]{3,64}@", hint="://"),
    Rule("payment_key", r"\b[rs]k_live_[A-Za-z0-9]{16,}", hint="k_live_"),
)
RULES = BASE_RULES + MORE_RULES

LEDGER = "blob binary, rule string, spans array<struct<start:int,end:int>>"
HELD = "blob binary, found map<string,array<struct<start:int,end:int>>>"
#: Keys that the rows of one content are dealt over.
SALTS = 8


def address(text: Column) -> Column:
    """The content address of a text: its SHA-256, null counting as empty."""
    return F.unhex(F.sha2(F.coalesce(text, F.lit("")).cast("binary"), 256))


def scan_new(versions: DataFrame, ledger: DataFrame | None = None, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(blob, found) of each distinct content of versions (text) that some rule version has not seen.

    found maps rule keys to spans, and holds the pairs that the ledger lacks
    only; those of the ledger are neither scanned nor returned.
    """
    texts = versions.select(address(F.col("text")).alias("blob"), F.coalesce("text", F.lit("")).alias("text")).groupBy("blob").agg(F.first("text").alias("text"))
    seen = F.array().cast("array<string>")
    if ledger is not None:
        # One row a blob on both sides of the join, so no group is large.
        known = ledger.groupBy("blob").agg(F.collect_set("rule").alias("seen"))
        texts = texts.join(known, "blob", "left")
        seen = F.coalesce("seen", seen)
        texts = texts.where(F.size(F.array_except(F.array(*(F.lit(r.key) for r in rules)), seen)) > 0)
    text = F.col("text")
    scanned = texts.select("blob", *((r.spans(text) if ledger is None else F.when(~F.array_contains(seen, r.key), r.spans(text))).alias(f"r{i}") for i, r in enumerate(rules)))
    return scanned.select("blob", F.map_filter(F.create_map(*(x for i, r in enumerate(rules) for x in (F.lit(r.key), F.col(f"r{i}")))), lambda _, v: v.isNotNull()).alias("found"))


def ledger_rows(found: DataFrame) -> DataFrame:
    """The rows that scan_new()'s result adds to the ledger (blob, rule, spans); a rule that found nothing has a row too."""
    return found.select("blob", F.explode("found").alias("rule", "spans"))


def scan_versions(versions: DataFrame, ledger: DataFrame | None = None, rules: tuple[Rule, ...] = RULES) -> tuple[DataFrame, DataFrame]:
    """Findings of every row of versions, and the new ledger rows, to append to the ledger.

    versions has a text and any columns that name a path or a version; the
    first result is versions with spans: array<struct<start, kind, end>> of the
    rules' current versions, sorted by start and then by the rules' order (kind
    is the rule's number in rules).  A null text counts as empty and has no
    spans; an empty table gives no rows; rows that repeat are all kept.  A
    column called spans is replaced.
    """
    # Written once: a plan that goes on from here would evaluate the scan again for each use of it.
    new = stored(scan_new(versions, ledger, rules), "ledger")
    rows = new.select("blob", "found")
    if ledger is not None:
        wanted = ledger.where(F.col("rule").isin([r.key for r in rules])).groupBy("blob").agg(F.map_from_entries(F.collect_set(F.struct("rule", "spans"))).alias("old"))
        empty = F.create_map().cast("map<string,array<struct<start:int,end:int>>>")
        rows = rows.join(wanted, "blob", "full").select("blob", F.map_concat(F.coalesce("found", empty), F.coalesce("old", empty)).alias("found"))
    return findings(versions, rows, rules), ledger_rows(new)


def findings(versions: DataFrame, held: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """versions with the spans of their blobs in held (blob, found), a row a blob.

    Rows of one content may be many (empty texts above all), so they are dealt
    over SALTS keys; only blobs with spans, which are few, are repeated for it.
    """
    none = F.array().cast("array<struct<start:int,end:int>>")

    def of_kind(i: int) -> Column:
        found = F.coalesce(F.col("found")[rules[i].key], none)
        return F.transform(found, lambda s: F.struct(s["start"].alias("start"), F.lit(i).alias("kind"), s["end"].alias("end")))

    parts = [of_kind(i) for i in range(len(rules))]
    spans = held.select(F.col("blob").alias("__found"), F.sort_array(F.concat(*parts)).alias("spans")).where(F.size("spans") > 0)
    spans = spans.select("*", F.explode(F.array(*map(F.lit, range(SALTS)))).alias("__salt"))
    names = [c for c in versions.columns if c.lower() != "spans"]
    salt = F.pmod(F.monotonically_increasing_id(), F.lit(SALTS)).cast("int")
    rows = versions.select(*(F.col(f"`{c}`") for c in names), address(F.col("text")).alias("__blob"), salt.alias("__own"))
    joined = rows.join(spans, (F.col("__blob") == F.col("__found")) & (F.col("__own") == F.col("__salt")), "left")
    nothing = F.array().cast("array<struct<start:int,kind:int,end:int>>")
    return joined.select(*(F.col(f"`{c}`") for c in names), F.coalesce("spans", nothing).alias("spans"))


@dataclass
class Ledger:
    """A ledger in a folder: rows (blob, found), where found maps rule versions to the spans that they found, none included.

    A scan appends what it saw for the first time, and reads all findings from
    the ledger.  Scanning again, after a failure too, scans only what the ledger
    lacks; pairs that two scans at once have both added count once.
    """

    spark: SparkSession
    path: str

    def _exists(self) -> bool:
        folder = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/_SUCCESS")
        return folder.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(folder)

    def rows(self) -> DataFrame:
        return self.spark.read.schema(HELD).parquet(self.path)

    def scan(self, versions: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
        """versions with spans, as scan_versions() gives them."""
        known = self._exists()
        scan_new(versions, ledger_rows(self.rows()) if known else None, rules).write.mode("append").parquet(self.path)
        rows = self.rows()
        if known:  # else each blob has one row
            entries = F.array_distinct(F.flatten(F.collect_list(F.map_entries("found"))))
            rows = rows.groupBy("blob").agg(F.map_from_entries(entries).alias("found"))
        return findings(versions, rows, rules)


def digest_text(spans: Column, rules: tuple[Rule, ...] = RULES) -> Column:
    """kind:start:end of sorted spans, joined by commas."""
    kinds = F.array(*(F.lit(r.kind) for r in rules))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(kinds, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def secrets(docs: DataFrame, rules: tuple[Rule, ...] = RULES, ledger: Ledger | None = None) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256 and spans of each document.

    The ledger is the one given, or that of the setting spark.loamdex.ledger (a
    folder that all executors share); without both, a new one in the shared folder.
    """
    spark, base = docs.sparkSession, len(BASE_RULES)
    if ledger is None:
        ledger = Ledger(spark, spark.conf.get("spark.loamdex.ledger", None) or new_path(spark, "ledger"))
    # Only ids and addresses are joined to the findings; texts go no further than their blob.
    found = ledger.scan(keyed(docs), rules)
    count = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long")
    own = F.filter("spans", lambda s: s["kind"] < base)
    counts = (count(k).alias(f"n_{BASE_RULES[k].kind}") for k in range(base))
    return found.select("doc_id", *counts, F.sha2(digest_text(own, rules).cast("binary"), 256).alias("base_sha256"), digest_text(F.col("spans"), rules).alias("spans"))
