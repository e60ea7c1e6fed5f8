"""Secret scan over a blob ledger.

A text is a blob, addressed by the SHA-256 of its bytes; paths (documents, or versions of a file) point to blobs. The
ledger holds one row for each blob and rule version ever scanned, found spans included. A run hashes the texts, keeps
the blobs with a rule version that the ledger lacks, scans each of them once however many paths share it, appends the
result, and joins the ledger back to every path. Only DataFrame expressions are used.

Defined results: a null text is the empty text and holds nothing; equal texts share a blob; repeated rows and rows with
a null id each get their own result row; extra columns of any name pass through untouched; an empty table gives an
empty result (and an empty ledger). Positions count code points, ends are exclusive.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

LEDGER = (
    "blob string, rule string, version int, spans array<struct<start: int, end: int>>"
)


@dataclass(frozen=True)
class Rule:
    """A pattern (leftmost matches that do not overlap) and the least length of one of its groups.

    Matches whose group is shorter are dropped after matching. A change of the pattern needs a new ``version``.
    """

    name: str
    pattern: str
    group: int = 0
    least: int = 1
    version: int = 1


#: Fixed patterns of the base kinds, in the order of their rank. Case-free letters are spelt out, so that every regular
#: expression engine agrees on them.
ASSIGN = (
    "([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]"
    "|[Aa][Pp][Ii]_?[Kk][Ee][Yy])[\"']?\\x20*[:=]\\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
)
BASE_RULES = (
    Rule("assign", ASSIGN, group=2, least=6),
    # A run is taken whole, so asking for the length in the pattern or after it finds the same spans.
    Rule("access", "AKIA[A-Z0-9]{16,}"),
    Rule("hex", "[0-9a-f]{24,}"),
)


def with_blob(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``row`` (the whole input row), ``body`` (its text) and ``blob`` (the address of the text)."""
    body = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    return docs.select(F.struct("*").alias("row"), body.alias("body")).withColumn(
        "blob", F.sha2(F.col("body"), 256)
    )


def read_ledger(spark: SparkSession, path: str) -> DataFrame:
    """The ledger at ``path``; empty where nothing was written yet."""
    try:
        return spark.read.schema(LEDGER).parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], LEDGER)


def _matches(rule: Rule) -> Column:
    """Lengths of the gap before each match and of the match, in order; null where nothing matches."""
    body, pattern = F.col("body"), F.lit(rule.pattern)
    parts = F.arrays_zip(
        F.split(body, rule.pattern, -1).alias("gap"),
        F.regexp_extract_all(body, pattern, F.lit(0)).alias("hit"),
        F.regexp_extract_all(body, pattern, F.lit(rule.group)).alias("value"),
    )
    lengths = F.transform(
        parts,
        lambda p: F.struct(
            F.char_length(p["gap"]).alias("gap"),
            F.char_length(p["hit"]).alias("hit"),
            (F.char_length(p["value"]) >= rule.least).alias("good"),
        ),
    )
    return F.when(body.rlike(rule.pattern), lengths)


def scan_blobs(blobs: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """Ledger rows of distinct ``blobs`` (blob, body, done: names of rules already applied in their version).

    Positions are running sums of gap and match lengths. They are taken by a window inside one blob and one rule, on
    the partitioning by blob that the caller's distinct has made.
    """
    todo = F.filter(
        F.array(
            *(
                F.struct(
                    F.lit(r.name).alias("rule"),
                    F.lit(r.version).alias("version"),
                    F.when(~F.array_contains("done", r.name), _matches(r)).alias("matches"),
                )
                for r in rules
            )
        ),
        lambda p: ~F.array_contains(F.col("done"), p["rule"]),
    )
    one = blobs.select("blob", F.explode(todo).alias("p"))
    each = one.select("blob", "p.rule", "p.version", F.posexplode_outer("p.matches").alias("pos", "m"))
    running = Window.partitionBy("blob", "rule").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    placed = each.withColumn("end", F.sum(F.col("m.gap") + F.col("m.hit")).over(running))
    span = F.struct((F.col("end") - F.col("m.hit")).cast("int").alias("start"), F.col("end").cast("int").alias("end"))
    return placed.groupBy("blob", "rule", "version").agg(
        F.array_sort(F.collect_list(F.when(F.col("m.good"), span))).alias("spans")
    )


def update_ledger(
    docs: DataFrame, ledger_path: str, rules: tuple[Rule, ...] = BASE_RULES, text_col: str = "text"
) -> DataFrame:
    """Scan what the ledger lacks for ``docs``, append it, and return the ledger.

    A blob that the ledger knows under every rule version is found out by its address alone. A repeated or
    concurrent run can only add equal rows for the same key; readers take one.
    """
    spark = docs.sparkSession
    ledger = read_ledger(spark, ledger_path)
    wanted = spark.createDataFrame([(r.name, r.version) for r in rules], "rule string, version int")
    done = ledger.join(F.broadcast(wanted), ["rule", "version"], "left_semi")
    addressed = with_blob(docs, text_col)
    texts = addressed.select("blob", "body")
    if done.isEmpty():
        unseen = texts.groupBy("blob").agg(F.first("body").alias("body"))
        unseen = unseen.withColumn("done", F.lit(None).cast("array<string>"))
    else:
        known = done.groupBy("blob").agg(F.collect_set("rule").alias("done"))
        missing = (
            addressed.select("blob").distinct().join(known, "blob", "left")
            .where(F.coalesce(F.size("done"), F.lit(0)) < len(rules))
        )
        unseen = texts.join(missing, "blob").groupBy("blob").agg(
            F.first("body").alias("body"), F.first("done").alias("done")
        )
    unseen = unseen.withColumn("done", F.coalesce("done", F.array().cast("array<string>")))
    scan_blobs(unseen, rules).write.mode("append").parquet(ledger_path)
    return read_ledger(spark, ledger_path)


def findings(ledger: DataFrame, rules: tuple[Rule, ...] = BASE_RULES) -> DataFrame:
    """blob, spans: of each blob with a find under the current rules, by start, then rank of the rule."""
    rank = F.lit(None).cast("int")
    for i, r in enumerate(rules):
        rank = F.when((F.col("rule") == r.name) & (F.col("version") == r.version), i).otherwise(rank)
    current = (
        ledger.withColumn("rank", rank).where("rank IS NOT NULL AND size(spans) > 0")
        .groupBy("blob", "rank", "rule").agg(F.first("spans").alias("spans"))
    )
    each = current.select("blob", "rank", "rule", F.explode("spans").alias("s"))
    span = F.struct("s.start", "rank", F.col("rule").alias("kind"), "s.end")
    return each.groupBy("blob").agg(F.array_sort(F.collect_list(span)).alias("spans"))


def scan(
    docs: DataFrame, ledger_path: str, rules: tuple[Rule, ...] = BASE_RULES, text_col: str = "text"
) -> DataFrame:
    """row (the input row), blob, spans (start, rank, kind, end; null where none) for every input row."""
    found = findings(update_ledger(docs, ledger_path, rules, text_col), rules)
    return with_blob(docs, text_col).drop("body").join(found, "blob", "left")


def redact(
    docs: DataFrame,
    ledger_path: str,
    rules: tuple[Rule, ...] = BASE_RULES,
    text_col: str = "text",
    mark: str = "[SECRET]",
) -> DataFrame:
    """The input rows, each run of overlapping spans in the text replaced by ``mark``; a null text stays null."""
    found = findings(update_ledger(docs, ledger_path, rules, text_col), rules)
    before = Window.partitionBy("blob").orderBy("s.start", "s.end").rowsBetween(Window.unboundedPreceding, -1)
    running = Window.partitionBy("blob").orderBy("s.start", "s.end").rowsBetween(Window.unboundedPreceding, 0)
    each = found.select("blob", F.explode("spans").alias("s"))
    opens = F.coalesce(F.col("s.start") > F.max("s.end").over(before), F.lit(True))
    runs = each.withColumn("opens", opens.cast("int")).withColumn("run", F.sum("opens").over(running))
    cuts = runs.groupBy("blob", "run").agg(F.min("s.start").alias("start"), F.max("s.end").alias("end"))
    cuts = cuts.groupBy("blob").agg(F.array_sort(F.collect_list(F.struct("start", "end"))).alias("cuts"))
    joined = with_blob(docs, text_col).join(cuts, "blob", "left")
    pieces = F.transform(
        F.sequence(F.lit(0), F.size("cuts")),
        lambda i: F.substring(
            F.col("body"),
            F.when(i == 0, 0).otherwise(F.get("cuts", i - 1)["end"]) + 1,
            F.coalesce(F.get("cuts", i)["start"], F.char_length("body"))
            - F.when(i == 0, 0).otherwise(F.get("cuts", i - 1)["end"]),
        ),
    )
    clean = F.when(F.col("cuts").isNotNull(), F.array_join(pieces, mark)).otherwise(F.col("row")[text_col])
    return joined.select(
        *((clean if c == text_col else F.col("row")[c]).alias(c) for c in docs.columns)
    )


def spans_text(spans: Column) -> Column:
    """Spans as ``kind:start:end``, comma-joined; empty text where there are none."""
    each = F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"]))
    return F.coalesce(F.array_join(each, ","), F.lit(""))


def count_kind(spans: Column, kind: str) -> Column:
    return F.coalesce(F.size(F.filter(spans, lambda s: s["kind"] == kind)), F.lit(0)).cast("long")
