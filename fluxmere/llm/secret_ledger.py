"""Secret scanning over an incremental ledger of content-addressed blobs, in SQL functions only.

Every version of every document is a path to a blob, named by the SHA-256 of its text. The
ledger keeps, per blob, which rule versions have read it and the spans that each of them
found. An update scans a blob once, however many paths lead to it, and only with rule
versions that the ledger doesn't hold for it. Findings are those of the rule versions asked
for, joined back to all paths; a blob that was appended twice counts once.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common


@dataclass(frozen=True)
class Rule:
    """A kind of secret. Matches are leftmost and don't overlap; a match counts if its
    ``value`` group is at least ``least`` long. ``literal`` must occur in any match."""

    kind: str
    version: int
    pattern: str
    group: int = 0
    least: int = 1
    literal: str = ""

    @property
    def name(self) -> str:
        return f"{self.kind}@{self.version}"


#: The three base kinds in their order, then what this scanner adds. Bounded repeats say the
#: same as the plain ones with a length test where a shorter run can't hide a longer one.
RULES = (
    Rule("assign", 1, r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", group=1, least=6),
    Rule("access", 1, r"AKIA[A-Z0-9]{16,}", literal="AKIA"),
    Rule("hex", 1, r"[0-9a-f]{24,}"),
    # with all that lies before its END line; without one, with the base64 lines that follow
    Rule("pem", 2, r"-----BEGIN [A-Z ]*PRIVATE KEY-----(?:[A-Za-z0-9+/=:,\r\n\t -]*?-----END [A-Z ]*PRIVATE KEY-----|(?:[ \t]*\r?\n[ \t]*[A-Za-z0-9+/=]{24,}){0,400})", literal="PRIVATE KEY-----"),
)
BASE = 3
SPANS = "array<struct<start:int,kind_no:int,end:int>>"
LEDGER = "blob binary, rules array<string>, spans array<struct<start:int,rule:string,end:int>>"


def blob_id() -> Column:
    """The address of a text: SHA-256 of its UTF-8 bytes."""
    return F.unhex(F.sha2(F.encode("text", "UTF-8"), 256))


def _sized(kind_no: int, rule: Rule):
    """What a match is, in lengths: the text between it and the one before, itself, its value."""

    def of(gap: Column, match: Column) -> Column:
        value = F.regexp_extract(match, rule.pattern, rule.group) if rule.group else match
        return F.struct(F.lit(kind_no).alias("kind_no"), F.length(gap).alias("gap"), F.length(match).alias("size"), F.length(value).alias("value"))

    return of


def _scan(pending: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """blob, rules, spans of ``pending`` (blob, text, todo: names of the rules to run)."""
    for i, r in enumerate(rules):
        wanted = F.array_contains("todo", r.name)
        if r.literal:
            wanted &= F.col("text").contains(r.literal)
        pending = pending.withColumn(f"m{i}", F.when(wanted, F.regexp_extract_all("text", F.lit(r.pattern), F.lit(0))))
    for i, r in enumerate(rules):
        m = F.col(f"m{i}")
        between = F.slice(F.split("text", r.pattern, -1), 1, F.size(m))
        each = F.zip_with(between, m, _sized(i, r))
        pending = pending.withColumn(f"m{i}", F.when(F.size(m) > 0, each).otherwise(F.array().cast("array<struct<kind_no:int,gap:int,size:int,value:int>>")))
    found = pending.select("blob", "todo", F.concat(*(f"m{i}" for i in range(len(rules)))).alias("found"))
    rows = found.select("blob", "todo", F.posexplode_outer("found").alias("pos", "f")).select("blob", "todo", "pos", "f.*")
    # a running sum of gaps and matches gives places in linear time, also for texts full of matches
    line = Window.partitionBy("blob", "kind_no").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    end = F.sum(F.col("gap") + F.col("size")).over(line).cast("int")
    rows = rows.withColumn("end", end)
    long_enough = reduce(lambda a, b: a | b, [(F.col("kind_no") == i) & (F.col("value") >= r.least) for i, r in enumerate(rules)])
    names = F.array(*(F.lit(r.name) for r in rules))
    span = F.when(long_enough, F.struct((F.col("end") - F.col("size")).alias("start"), F.get(names, F.col("kind_no")).alias("rule"), "end"))
    return rows.groupBy("blob").agg(F.first("todo").alias("rules"), F.sort_array(F.collect_list(span)).alias("spans"))


def update(docs: DataFrame, ledger: str, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Scan what the ledger at ``ledger`` lacks, append it there, and return the ledger.

    An absent ledger is an empty one. Blobs are deduplicated by partial aggregation before
    the shuffle, so a text that a third of all paths share is scanned once.
    """
    spark = docs.sparkSession
    blobs = common.id_text(docs).select(blob_id().alias("blob"), "text").groupBy("blob").agg(F.first("text").alias("text"))
    names = F.array(*(F.lit(r.name) for r in rules))
    known = read(spark, ledger)
    if known is None:
        pending = blobs.withColumn("todo", names)
    else:
        done = known.groupBy("blob").agg(F.array_distinct(F.flatten(F.collect_list("rules"))).alias("done"))
        pending = blobs.join(done, "blob", "left").withColumn("todo", F.when(F.col("done").isNull(), names).otherwise(F.array_except(names, "done"))).filter(F.size("todo") > 0).select("blob", "text", "todo")
    _scan(pending, rules).write.mode("append").parquet(ledger)
    return read(spark, ledger)


def read(spark: SparkSession, ledger: str) -> DataFrame | None:
    path = spark._jvm.org.apache.hadoop.fs.Path(ledger)
    if not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        return None
    return spark.read.schema(LEDGER).parquet(ledger)


def _text(spans: Column, rules: tuple[Rule, ...]) -> Column:
    kinds = F.array(*(F.lit(r.kind) for r in rules))
    return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", F.get(kinds, s["kind_no"]), s["start"].cast("string"), s["end"].cast("string"))))


def _found(known: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """blob, spans (start, place of the rule in ``rules``, end): what just these rule versions found, sorted."""
    names = F.array(*(F.lit(r.name) for r in rules))
    own = F.filter("spans", lambda s: F.array_contains(names, s["rule"]))
    hits = known.select("blob", own.alias("spans")).filter(F.size("spans") > 0).groupBy("blob").agg(F.array_distinct(F.flatten(F.collect_list("spans"))).alias("spans"))
    placed = F.transform("spans", lambda s: F.struct(s["start"].alias("start"), (F.array_position(names, s["rule"]) - 1).cast("int").alias("kind_no"), s["end"].alias("end")))
    return hits.select("blob", F.sort_array(placed).alias("spans"))


def findings(docs: DataFrame, ledger: str, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Findings of the ledger for every row of ``docs``: doc_id, blob, spans (array, by start, then kind)."""
    hits = _found(read(docs.sparkSession, ledger), rules)
    paths = common.id_text(docs).select("doc_id", blob_id().alias("blob"))
    return paths.join(hits, "blob", "left").select("doc_id", "blob", F.coalesce("spans", F.array().cast(SPANS)).alias("spans"))


def scan(docs: DataFrame, ledger: str | None = None, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans for every row of ``docs``.

    Null texts are empty and have no spans; places count code points; repeated rows share
    their blob's findings; an empty table gives no rows.
    """
    ledger = ledger or common.work_path(docs.sparkSession, "ledger")
    update(docs, ledger, rules)
    rows = findings(docs, ledger, rules)
    base = F.filter("spans", lambda s: s["kind_no"] < BASE)

    def count(i: int) -> Column:
        return F.size(F.filter("spans", lambda s: s["kind_no"] == i)).cast("long").alias(f"n_{rules[i].kind}")

    n = [count(i) for i in range(BASE)]
    return rows.select("doc_id", *n, F.sha2(_text(base, rules), 256).alias("base_sha256"), _text(F.col("spans"), rules).alias("spans"))


def redact(docs: DataFrame, ledger: str | None = None, mark: str = "[secret]", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """``docs`` with every found span, overlapping ones merged, replaced by ``mark``.

    Rows without findings, null texts among them, stay as they are, repeated rows each;
    ``n_chars`` follows the text where there is such a column, all others stay, whatever
    their names. An empty table gives no rows. Spans are cut out left to right by one fold per text.
    """
    ledger = ledger or common.work_path(docs.sparkSession, "ledger")
    update(docs, ledger, rules)
    names = docs.columns
    blob, spans = common.free_names(docs, "blob", "spans")
    known = _found(read(docs.sparkSession, ledger), rules).select(F.col("blob").alias(blob), F.col("spans").alias(spans))
    rows = docs.withColumn(blob, F.unhex(F.sha2(F.encode(F.coalesce("text", F.lit("")), "UTF-8"), 256))).join(known, blob, "left")
    # (text so far, place reached): copy what lies before a span, then the mark, unless it began inside the last one
    start = F.struct(F.array().cast("array<string>").alias("out"), F.lit(0).alias("at"))

    def step(acc, s):
        apart = s["start"] >= acc["at"]
        piece = F.substring(F.col("text"), acc["at"] + 1, F.greatest(s["start"] - acc["at"], F.lit(0)))
        return F.struct(F.when(apart, F.concat(acc["out"], F.array(piece, F.lit(mark)))).otherwise(acc["out"]).alias("out"), F.greatest(acc["at"], s["end"]).alias("at"))

    whole = F.aggregate(spans, start, step, lambda acc: F.concat(F.array_join(acc["out"], ""), F.substring(F.col("text"), acc["at"] + 1, F.lit(2**31 - 1) - acc["at"])))
    text = F.when(F.col(spans).isNotNull(), whole).otherwise(F.col("text"))
    out = rows.withColumn("text", text)
    if "n_chars" in names:
        out = out.withColumn("n_chars", F.when(F.col(spans).isNotNull(), F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return out.select(*names)


def op2_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(common.documents(spark, sf_dir))


def secrets_in_rounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same findings by a ledger that grows: an older version of a rule first, then the new
    ones, then the same again, which scans nothing."""
    docs = common.documents(spark, sf_dir)
    ledger = common.work_path(spark, "ledger")
    older = (RULES[2], Rule("pem", 1, r"-----BEGIN [A-Z ]*PRIVATE KEY-----", literal="PRIVATE KEY-----"))
    update(docs, ledger, older)
    update(docs, ledger)
    return scan(docs, ledger)
