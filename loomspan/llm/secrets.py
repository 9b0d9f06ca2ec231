"""Secret scans with an incremental blob ledger, in DataFrame operations only.

Every text is content-addressed by its SHA-256. The ledger holds the (blob, rule version) pairs that have been scanned
and the findings table their spans. A scan reads only blobs without such a pair, each once, whatever the number of
paths that hold it; findings are then joined back to all paths.

Positions: the pieces between a pattern's matches and the matches themselves, in order, make up the text, so running sums
of their lengths give every start. They are summed over exploded rows, linear in the matches of a text.

Defined results: a null text is the empty blob and has no findings. Null and repeated doc_ids are rows like any other.
Overlapping spans of different kinds are all reported; when a text is redacted they are merged first. A private key's
finding is all from its BEGIN line to its END line or, where another marker or nothing comes first, the BEGIN line. What
is redacted of a key without END is that line and the base64 lines that follow (line breaks may be written as \\n, lines
quoted or indented). Empty tables have no findings. A ledger without its findings is refused.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import ID, ROW, TEXT, keyed, settled, shared_table

RULE_VERSION = 2
REDACT_VERSION = 3
SALTS = 16  # copies of a blob's findings, so that the paths of one blob meet them in as many tasks
MARK = "[SECRET]"


@dataclass(frozen=True)
class Rule:
    kind: str
    pattern: str
    least: int  # characters of the group; shorter matches are dropped after they have been passed over
    group: int = 0
    base: bool = True


_NAME = r"(?:(?!PRIVATE KEY-----)[A-Z0-9]++ )*+PRIVATE KEY-----"
_BEGIN = f"-----BEGIN {_NAME}"
_BREAK = r"(?:[\s>\"'+,]|\\[nrt])"
#: Possessive loops: they neither recurse nor go back, so the length of a key or of a text without END costs no stack and no second pass.
_TO_END = rf"(?:(?!-----)[\s\S])*+-----END {_NAME}"
_LINES = rf"(?:{_BREAK}*+(?:Proc-Type|DEK-Info): ?[A-Za-z0-9,-]++)*+(?:{_BREAK}*+[A-Za-z0-9+/]{{16,}}+={{0,2}}+)*+(?:(?<=[A-Za-z0-9+/]{{16}})(?:[ \t\"'+,]*+(?:\r?\n|(?:\\r)?\\n)[ \t>\"'+]*+[A-Za-z0-9+/]++={{0,2}}+(?=[ \t\"',;]*+(?:[\r\n\\]|\z))|[ \t]++[A-Za-z0-9+/]++={{1,2}}+))?+"

#: In the order in which kinds at the same start are listed. A run of letters is matched whole, so the two patterns with {n,} find what + and a later filter find.
RULES = (
    Rule("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 6, 2),
    Rule("access", r"AKIA[A-Z0-9]{16,}", 20),
    Rule("hex", r"[0-9a-f]{24,}", 24),
    Rule("pem", rf"{_BEGIN}(?:{_TO_END})?", 0, 0, False),
)
#: What is cut out of texts: the rules, and of a key without END also the lines after BEGIN.
REDACTED = tuple(Rule(r.kind, f"{_BEGIN}(?:{_TO_END}|{_LINES})", r.least, r.group, r.base) if r.kind == "pem" else r for r in RULES)


def blobs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(__row, __id, __text, blob) of docs."""
    return keyed(docs, id_col, text_col).withColumn("blob", F.sha2(F.col(TEXT).cast("binary"), 256))


def _match(i: int, rule: Rule):
    def one(m, at):
        part = F.regexp_extract(m, rule.pattern, rule.group) if rule.group else m
        return F.struct(F.lit(i).alias("kind"), at.alias("at"), F.length(F.get(f"g{i}", at)).alias("gap"), F.length(m).alias("length"), (F.length(part) >= rule.least).alias("good"))

    return one


def scan(texts: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(blob, kind, start, end) of all findings in the rows (blob, __text), whose blobs are distinct."""
    found = texts
    for i, rule in enumerate(rules):
        found = found.withColumn(f"m{i}", F.regexp_extract_all(TEXT, F.lit(rule.pattern), F.lit(0)))
    found = found.where(F.greatest(*(F.size(f"m{i}") for i in range(len(rules)))) > 0)
    kinds = []
    for i, rule in enumerate(rules):
        found = found.withColumn(f"g{i}", F.when(F.size(f"m{i}") > 0, F.split(TEXT, rule.pattern, -1)))
        kinds.append(F.transform(f"m{i}", _match(i, rule)))
    rows = found.select("blob", F.explode(F.concat(*kinds)).alias("f")).select("blob", "f.*")
    so_far = Window.partitionBy("blob", "kind").orderBy("at")
    ends = rows.withColumn("end", F.sum(F.col("gap") + F.col("length")).over(so_far)).where("good")
    return ends.select("blob", "kind", (F.col("end") - F.col("length")).cast("long").alias("start"), F.col("end").cast("long").alias("end"))


def unseen(rows: DataFrame, ledger: DataFrame | None = None, rule_version: int = RULE_VERSION) -> DataFrame:
    """(blob, __row, paths), once for each blob of rows whose pair with the rule version isn't in the ledger (blob, rule_version)."""
    first = rows.groupBy("blob").agg(F.min(ROW).alias(ROW), F.count("*").alias("paths"))
    if ledger is not None:
        first = first.join(ledger.where(F.col("rule_version") == rule_version).select("blob"), "blob", "left_anti")
    return first


def scan_unseen(docs: DataFrame, ledger: DataFrame | None, rules: tuple[Rule, ...], rule_version: int, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """What a scan of docs adds to the ledger (blob, rule_version) and to the findings (blob, rule_version, kind, start, end), both stored."""
    rows = keyed(settled(docs), id_col, text_col)
    first = shared_table(unseen(rows.withColumn("blob", F.sha2(F.col(TEXT).cast("binary"), 256)), ledger, rule_version))
    # The text depends on the other side of the join; else the optimizer would run the patterns on all rows, before it.
    texts = rows.select(ROW, TEXT).join(first, ROW).select("blob", F.when(F.col("paths") > 0, F.col(TEXT)).alias(TEXT))
    version = F.lit(rule_version).alias("rule_version")
    return first.select("blob", version), shared_table(scan(texts, rules).select("blob", version, "kind", "start", "end"))


def _salted(by_blob: DataFrame) -> DataFrame:
    return by_blob.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))


def update_ledger(docs: DataFrame, ledger: DataFrame | None = None, findings: DataFrame | None = None, rules: tuple[Rule, ...] = RULES, rule_version: int = RULE_VERSION, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """The ledger (blob, rule_version) and findings (blob, rule_version, kind, start, end) after a scan of what is new in docs.

    What is new is stored until the application ends; `update_ledger_at` keeps both for good.
    """
    if (ledger is None) != (findings is None):
        raise ValueError("a ledger and its findings go together")
    seen, found = scan_unseen(docs, ledger, rules, rule_version, id_col, text_col)
    return (seen, found) if ledger is None else (ledger.unionByName(seen), findings.unionByName(found))


def update_ledger_at(docs: DataFrame, folder: str, **options) -> tuple[DataFrame, DataFrame]:
    """The ledger and findings kept in a folder, after a scan of what is new in docs.

    Findings are appended before their ledger entries. If the application dies in between, the next scan appends
    the same findings again, so they are read without repetition.
    """
    spark = docs.sparkSession
    pair = "blob string, rule_version int"
    schemas = {"ledger": pair, "findings": f"{pair}, kind int, start long, end long"}
    hadoop, path = spark.sparkContext._jsc.hadoopConfiguration(), spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    there = {n: path(f"{folder}/{n}").getFileSystem(hadoop).exists(path(f"{folder}/{n}")) for n in schemas}
    stored = lambda n: spark.read.schema(schemas[n]).parquet(f"{folder}/{n}").distinct()
    options = {"rules": RULES, "rule_version": RULE_VERSION} | options
    seen, found = scan_unseen(docs, stored("ledger") if there["ledger"] else None, **options)
    found.write.mode("append").parquet(f"{folder}/findings")
    seen.write.mode("append").parquet(f"{folder}/ledger")
    return stored("ledger"), stored("findings")


def _per_blob(found: DataFrame, rules) -> DataFrame:
    """A row for each blob with findings: counts by kind, all spans and the base spans as text, by start and then kind."""
    names = F.array(*(F.lit(r.kind) for r in rules))
    listed = F.array_sort(F.collect_list(F.struct("start", "kind", "end")))
    text = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"], s["end"])), ",")
    base = F.array(*(F.lit(i) for i, r in enumerate(rules) if r.base))
    counts = [F.sum((F.col("kind") == i).cast("long")).alias(f"n_{r.kind}") for i, r in enumerate(rules)]
    grouped = found.groupBy("blob").agg(*counts, listed.alias("all"))
    return grouped.withColumn("spans", text(F.col("all"))).withColumn("base", text(F.filter("all", lambda s: F.array_contains(base, s["kind"]))))


def by_path(docs: DataFrame, findings: DataFrame, rules: tuple[Rule, ...] = RULES, rule_version: int = RULE_VERSION, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, counts by kind, base_sha256, spans: stored findings joined to every row of docs; nothing is scanned."""
    found = findings.where(F.col("rule_version") == rule_version).select("blob", "kind", "start", "end")
    rows = blobs(docs, id_col, text_col)
    joined = rows.select(ID, "blob", F.pmod(ROW, F.lit(SALTS)).cast("int").alias("salt")).join(_salted(_per_blob(found, rules)), ["blob", "salt"], "left")
    none = F.lit("")
    return joined.select(F.col(ID).alias("doc_id"), *(F.coalesce(f"n_{r.kind}", F.lit(0)).cast("long").alias(f"n_{r.kind}") for r in rules), F.sha2(F.coalesce("base", none).cast("binary"), 256).alias("base_sha256"), F.coalesce("spans", none).alias("spans"))


def findings_by_path(docs: DataFrame, rules: tuple[Rule, ...] = RULES, id_col: str = "doc_id", text_col: str = "text", ledger: DataFrame | None = None, findings: DataFrame | None = None, rule_version: int = RULE_VERSION) -> DataFrame:
    """The rows of by_path after a scan of the blobs that the ledger (none: an empty one) doesn't hold."""
    _, found = update_ledger(docs, ledger, findings, rules, rule_version, id_col, text_col)
    return by_path(docs, found, rules, rule_version, id_col, text_col)


def redact(docs: DataFrame, rules: tuple[Rule, ...] = REDACTED, text_col: str = "text", chars_col: str | None = "n_chars", ledger: DataFrame | None = None, findings: DataFrame | None = None, rule_version: int = REDACT_VERSION, id_col: str = "doc_id") -> DataFrame:
    """docs with every found span of the text replaced by a mark (and the count of characters mended where a text changed).

    A ledger and findings given belong to the rules given; only blobs that they don't hold are scanned.
    """
    names = docs.columns
    _, found = update_ledger(docs, ledger, findings, rules, rule_version, id_col, text_col)
    found = found.where(F.col("rule_version") == rule_version)
    rows = docs.select(F.struct("*").alias("doc")).withColumn("blob", F.sha2(F.coalesce(F.col("doc")[text_col], F.lit("")).cast("binary"), 256)).withColumn(ROW, F.monotonically_increasing_id())
    order = Window.partitionBy("blob").orderBy("start", "end")
    reach = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    island = F.sum((F.coalesce(reach, F.lit(-1)) < F.col("start")).cast("int")).over(order)
    merged = found.withColumn("island", island).groupBy("blob", "island").agg(F.min("start").alias("start"), F.max("end").alias("end"))
    cuts = merged.groupBy("blob").agg(F.array_sort(F.collect_list(F.struct("start", "end"))).alias("cuts"))
    joined = rows.select("doc", "blob", F.pmod(ROW, F.lit(SALTS)).cast("int").alias("salt")).join(_salted(cuts), ["blob", "salt"], "left")
    text = F.col("doc")[text_col]

    def piece(cut, at):
        before = F.when(at == 0, F.lit(0)).otherwise(F.get("cuts", at - 1)["end"])
        return F.concat(F.substring(text, (before + 1).cast("int"), (cut["start"] - before).cast("int")), F.lit(MARK))

    last = F.get("cuts", F.size("cuts") - 1)["end"]
    joined = joined.withColumn("clean", F.when(F.col("cuts").isNull(), text).otherwise(F.concat(F.array_join(F.transform("cuts", piece), ""), F.substring(text, (last + 1).cast("int"), F.length(text)))))
    value = {text_col: F.col("clean")}
    if chars_col in names:
        value[chars_col] = F.when(F.col("cuts").isNull(), F.col("doc")[chars_col]).otherwise(F.length("clean").cast(docs.schema[chars_col].dataType))
    return joined.select(*(value.get(c, F.col("doc")[c]).alias(c) for c in names))
