"""Secret scans that never read the same blob twice under the same rule.

Every version of every path is addressed by its content. The ledger, a table that outlives the
run, has a row for each blob scanned: the rules' versions (a digest of a rule's definition, so a
changed rule is a new one) and the spans found. A scan

1. addresses the versions and reduces them to blobs, with one path for each to fetch it by,
2. takes from the ledger which rule versions a blob has met, and leaves those blobs out that met all,
3. fetches only the other blobs' texts, applies only the rules that are missing, and appends a row a blob,
4. joins the ledger's spans back to all versions of all paths.

A row of the ledger is whole in itself. A run that is lost half-way leaves rows of some blobs;
the next one scans the others.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import cached_property

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from custspark.llm.common import column, prepare, released
from custspark.session import materialise


@dataclass(frozen=True)
class Rule:
    """Leftmost matches that do not overlap; those whose group is shorter than ``least`` are dropped."""

    name: str
    pattern: str
    group: int = 0
    least: int = 1

    @property
    def version(self) -> str:
        return hashlib.sha256(repr((self.name, self.pattern, self.group, self.least)).encode()).hexdigest()[:16]

    @cached_property
    def compiled(self) -> re.Pattern:
        return re.compile(self.pattern)

    def spans(self, text: str) -> Iterator[tuple[int, int]]:
        """Start and end (exclusive) in code points."""
        for m in self.compiled.finditer(text):
            if m.end(self.group) - m.start(self.group) >= self.least:
                yield m.span()


# The rules in their order. Only letters A-Z of the first have either case.
RULES = (
    Rule("assign", r"""(?ai:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 1, 6),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 20),
    Rule("hex", r"[0-9a-f]+", 0, 24),
)

LEDGER = "blob binary, versions array<string>, spans array<struct<version:string,start:bigint,end:bigint>>"
SPANS = "array<struct<start:bigint,rank:int,rule:string,end:bigint>>"


def recorded(spark: SparkSession, path: str) -> DataFrame:
    """The ledger's rows; none where nothing has been written yet."""
    try:
        return spark.read.schema(LEDGER).parquet(path)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in (e.getCondition() or ""):
            raise
        return spark.createDataFrame([], LEDGER)


def addressed(versions: DataFrame, keep: list[str], id_col: str, text_col: str) -> DataFrame:
    """Struct ``row`` of the columns kept, id, and blob: the SHA-256 of the text, empty for null; a stored table."""
    text = F.coalesce(column(versions, text_col).cast("string"), F.lit(""))
    rows = versions.select(
        F.struct(*[column(versions, c) for c in keep]).alias("row"),
        column(versions, id_col).alias("id"),
        F.unhex(F.sha2(text.cast("binary"), 256)).alias("blob"),
    )
    return materialise(rows, "ledger-versions")


def unseen(blobs: DataFrame, ledger: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """blob, id, missing: the rule versions that a blob has not met, and a path that has the blob; a stored table."""
    wanted = F.array(*[F.lit(r.version) for r in rules]).cast("array<string>")
    # min by id: a blob with a third of all paths is a row for each task before it is shuffled.
    one = blobs.groupBy("blob").agg(F.min("id").alias("id"))
    met = ledger.select("blob", F.explode("versions").alias("version")).groupBy("blob").agg(F.collect_set("version").alias("met"))
    missing = F.array_except(wanted, F.coalesce("met", F.array().cast("array<string>")))
    found = one.join(met, "blob", "left").select("blob", "id", missing.alias("missing"))
    return materialise(found.filter(F.size("missing") > 0), "ledger-unseen")


def scanned(texts: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """Rows of the ledger from blob, missing, text."""
    prepare(texts.sparkSession)
    known = {r.version: r for r in rules}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans = [
                [
                    {"version": version, "start": a, "end": b}
                    for version in missing
                    for a, b in known[version].spans(text or "")
                ]
                for text, missing in zip(batch.column("text").to_pylist(), batch.column("missing").to_pylist())
            ]
            kind = pa.list_(pa.struct([("version", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
            yield pa.RecordBatch.from_arrays(
                [batch.column("blob"), batch.column("missing"), pa.array(spans, kind)], names=["blob", "versions", "spans"]
            )

    return texts.select("blob", "missing", "text").mapInArrow(released(run), LEDGER)


def scan(
    versions: DataFrame,
    ledger_path: str,
    keep: list[str],
    rules: Sequence[Rule] = RULES,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """Struct ``row`` of the columns kept, blob, spans (start, rank of the rule, rule, end) of every version.

    Scans what the ledger at ``ledger_path`` (a shared folder) has not, and adds it there. A null text is
    the empty blob. Repeated rows, and all paths and versions with one text, are one blob, read once; only where
    several rows have the same id and text is each of them read, and one recorded. A null id fetches a blob
    like any other. An empty table gives no rows and writes none.
    """
    spark = versions.sparkSession
    rows = addressed(versions, keep, id_col, text_col)
    todo = unseen(rows, recorded(spark, ledger_path), rules)
    text = F.coalesce(column(versions, text_col).cast("string"), F.lit(""))
    texts = versions.select(
        column(versions, id_col).alias("id"), F.unhex(F.sha2(text.cast("binary"), 256)).alias("blob"), text.alias("text")
    )
    # By blob and path together: the copies of a text are dealt to all tasks. Where little is new, Spark
    # broadcasts the stored list by its size, and no text is moved.
    a, b = texts.alias("a"), todo.alias("b")
    fetched = a.join(b, F.expr("a.blob = b.blob and a.id <=> b.id")).select("a.blob", "b.missing", "a.text")
    new = scanned(fetched, rules).groupBy("blob").agg(F.first("versions").alias("versions"), F.first("spans").alias("spans"))
    new.write.mode("append").parquet(ledger_path)
    return rows.drop("id").join(findings(spark, ledger_path, rules), "blob", "left").select(
        "row", "blob", F.coalesce("spans", F.array().cast(SPANS)).alias("spans")
    )


def findings(spark: SparkSession, ledger_path: str, rules: Sequence[Rule] = RULES) -> DataFrame:
    """blob, spans in order of start and rule: blobs with a span under the rules given; a stored table."""
    rank = F.create_map(*[F.lit(x) for i, r in enumerate(rules) for x in (r.version, i)])
    rule = F.create_map(*[F.lit(x) for r in rules for x in (r.version, r.name)])
    spans = recorded(spark, ledger_path).select("blob", F.explode("spans").alias("s"))
    spans = spans.filter(F.col("s.version").isin([r.version for r in rules]))
    span = F.struct(
        F.col("s.start").alias("start"),
        rank[F.col("s.version")].alias("rank"),
        rule[F.col("s.version")].alias("rule"),
        F.col("s.end").alias("end"),
    )
    # Written, so that its size is known and a blob with very many paths can be split in the join.
    return materialise(
        spans.select("blob", span.alias("span")).groupBy("blob").agg(F.sort_array(F.collect_set("span")).cast(SPANS).alias("spans")),
        "ledger-findings",
    )
