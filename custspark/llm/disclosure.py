"""Information-theoretic sanitisation of personal data.

Base spans (mail addresses, IP addresses, card and phone numbers) are the protected
entities. What a text's words tell about an entity in it, however far off they stand, is
estimated from the whole corpus. The words on both sides of the entity name a context,
which has the terms of all texts it stands in:

    p(t|e)  share of the entity's distinct contexts that have the term: the lower end of its
            Wilson interval, so that few contexts prove little
    PMI     log2(p(t|e) / p(t)), p(t) from the term's document frequency
    IC(e)   log2(documents / documents with the entity)

PMI / IC(e) is the share of the entity's information that the term gives away. In a
text that holds the entity, terms above one threshold are removed, above a lower one
generalised. Contexts count once however often they are copied. Every entity is judged,
by every term that stands in a second context of it, or in a document without it: a word
that only copies of one context have leads from nowhere else to the entity, and stays.

A text's terms are stored once. Entities that stand in the same texts, in contexts that are alike,
have the same counts: they are one group, judged once, however many addresses a text lists. A group's
contexts and information bound how frequent a term may be to reach the lower threshold; terms above the
bounds of all groups of a text are left out before the two meet, which changes no verdict.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from custspark.llm.common import column, emit, prepare, released
from custspark.session import forget, materialise

# The kinds in their order, and their patterns. Possessive and look-behind forms find
# the same matches as the plain patterns, without rereading a long run of digits from each of its places.
KINDS = ("email", "ip", "card", "phone", "generalise", "remove")
_AT = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]+){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
_TERM = re.compile(r"[^\W\d_]{2,}")
LABELS = {
    "email": "[EMAIL]",
    "ip": "[IP]",
    "card": "[CARD]",
    "phone": "[PHONE]",
    "generalise": "[TERM]",
    "remove": "",
}

#: Characters looked at on each side of an entity to tell copies of its context, and words taken from them.
SIDE_CHARS, SIDE_WORDS = 200, 10
#: Terms a task counts, or has beside entities, before it passes them on.
TERMS_AT_ONCE = 300_000
#: Texts with entities that a task remembers, to store their terms once.
TEXTS_KNOWN = 200_000
#: So far above a bound a term is still judged, as both are rounded.
ROUNDING = 1 + 1e-9


@dataclass(frozen=True)
class Thresholds:
    """Shares of an entity's information, and the standard errors that p(t|e) is taken below its estimate."""

    generalise: float = 0.6
    remove: float = 0.85
    errors: float = 1.645


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(map(int, reversed(digits))):
        d = d * 2 if i % 2 else d
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost matches: the local part goes back from the @ as far as the last match lets it."""
    at, free = 0, 0
    while found := _AT.search(text, at):
        begin = found.start()
        while begin > free and text[begin - 1] in _LOCAL:
            begin -= 1
        if begin < found.start():
            yield begin, found.end()
            at = free = found.end()
        else:
            at = found.start() + 1


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind as an index of KINDS, end), sorted."""
    out = [(a, 0, b) for a, b in _emails(text)] if "@" in text else []
    if _DIGIT.search(text):
        for m in _IP.finditer(text):
            if all(len(x) <= 3 and int(x or 0) <= 255 for x in (part.lstrip("0") for part in m[0].split("."))):
                out.append((m.start(), 1, m.end()))
        for m in _CARD.finditer(text):
            digits = m[0].replace(" ", "").replace("-", "")
            if 14 <= len(digits) <= 19 and luhn(digits):
                out.append((m.start(), 2, m.end()))
        if "+" in text:
            for m in _PHONE.finditer(text):
                if 10 <= sum(c.isdigit() for c in m[0]) <= 15:
                    out.append((m.start(), 3, m.end()))
    return sorted(out)


def entity(kind: int, value: str) -> str:
    """An entity's name: spelling variants of a number are one entity."""
    if kind >= 2:
        value = "".join(c for c in value if c.isdigit())
    return f"{KINDS[kind]}:{value.lower()}"


def _joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def text_key(text: str) -> str:
    return hashlib.md5(text.encode()).hexdigest()


def contexts(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """text_key, places (entity and context, by its first place there), terms: a row for each text with entities.

    Where a task meets a text again, places and terms are null.
    """
    places_type = pa.list_(pa.struct([("entity", pa.string()), ("context", pa.string())]))

    def table_of(rows: list[tuple]) -> dict[str, pa.Array]:
        keys, places, terms = zip(*rows) if rows else ((), (), ())
        return {
            "text_key": pa.array(list(keys), pa.string()),
            "places": pa.array(list(places), places_type),
            "terms": pa.array(list(terms), pa.list_(pa.string())),
        }

    def start():
        known: set[str] = set()

        def each(_: pa.Array, texts: pa.Array) -> Iterator[dict[str, pa.Array]]:
            rows: list[tuple] = []
            size = 0
            for text in texts.to_pylist():
                spans = base_spans(text) if text else []
                if not spans:
                    continue
                key = text_key(text)
                if key in known:
                    rows.append((key, None, None))
                    continue
                if len(known) >= TEXTS_KNOWN:
                    known.clear()
                known.add(key)
                first: dict[str, tuple[int, int]] = {}
                for a, kind, b in spans:
                    first.setdefault(entity(kind, text[a:b]), (a, b))
                places = []
                for name, (a, b) in first.items():
                    left = _TERM.findall(text[max(0, a - SIDE_CHARS) : a])[-SIDE_WORDS:]
                    right = _TERM.findall(text[b : b + SIDE_CHARS])[:SIDE_WORDS]
                    words = [w.lower() for w in (*left, "", *right)]
                    places.append({"entity": name, "context": hashlib.md5(" ".join(words).encode()).hexdigest()})
                terms = sorted(set(_TERM.findall(text.lower())))
                rows.append((key, places, terms))
                size += len(terms) + 4 * len(places)
                if size >= TERMS_AT_ONCE:
                    yield table_of(rows)
                    rows, size = [], 0
            yield table_of(rows)

        return each

    schema = "text_key string, places array<struct<entity:string,context:string>>, terms array<string>"
    return emit(docs, start, schema, None, text_col)


def term_counts(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """term, n: partial document frequencies, a row for each task that met the term."""
    prepare(docs.sparkSession)

    def batch_of(counts: Counter[str]) -> pa.RecordBatch:
        terms, n = list(counts.keys()), list(counts.values())
        return pa.RecordBatch.from_arrays([pa.array(terms, pa.string()), pa.array(n, pa.int64())], names=["term", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter[str] = Counter()
        for batch in batches:
            for text in batch.column(0).to_pylist():
                if text:
                    counts.update(set(_TERM.findall(text.lower())))
                if len(counts) >= TERMS_AT_ONCE:
                    yield batch_of(counts)
                    counts = Counter()
        if counts:
            yield batch_of(counts)

    return docs.select(column(docs, text_col).cast("string").alias("text")).mapInArrow(released(run), "term string, n bigint")


def _lower_end(k: Column, n: Column, errors: float) -> Column:
    """The lower end of the Wilson interval of k out of n."""
    z2 = F.lit(errors * errors)
    share = k / n
    half = F.lit(errors) * F.sqrt(share * (1 - share) / n + z2 / (4 * n * n))
    return (share + z2 / (2 * n) - half) / (1 + z2 / n)


def groups(texts: DataFrame, n_docs: int, limits: Thresholds) -> DataFrame:
    """g1, g2 (a group of entities), text_key, label (of the context), n, n_contexts, information, bound.

    ``texts`` is the stored table of distinct texts. A context's label is the smallest text it stands in, so
    that contexts of different entities can be alike; a group's name is a digest of its texts and labels, made
    without gathering them. ``bound`` is the p(t) above which no term can reach the lower threshold.
    """
    placed = texts.select("text_key", "n", F.inline("places"))
    labels = placed.groupBy("entity", "context").agg(F.min("text_key").alias("label"))
    labelled = placed.join(labels, ["entity", "context"]).drop("context")
    mark = F.xxhash64("text_key", "label")
    facts = labelled.groupBy("entity").agg(
        F.bit_xor(mark).alias("g1"),
        F.sum(F.pmod(F.xxhash64("label", "text_key"), F.lit((1 << 31) - 1))).alias("g2"),
        F.count_if(F.col("text_key") == F.col("label")).alias("n_contexts"),
        F.sum("n").alias("n_entity"),
    )
    information = F.log2(F.lit(n_docs) / F.col("n_entity"))
    most = _lower_end(F.col("n_contexts"), F.col("n_contexts"), limits.errors)
    bound = F.when(information > 0, most / F.pow(F.lit(2.0), limits.generalise * information)).otherwise(F.lit(0.0))
    facts = facts.select("entity", "g1", "g2", "n_contexts", information.alias("information"), bound.alias("bound"))
    # Of a group one entity stands for all.
    one = facts.groupBy("g1", "g2").agg(F.min("entity").alias("entity"))
    return labelled.join(facts.join(one, ["g1", "g2", "entity"]), "entity").drop("entity")


def disclosing(docs: DataFrame, texts: DataFrame, limits: Thresholds = Thresholds(), text_col: str = "text") -> DataFrame:
    """text_key, term, share, kind: the terms of a text that give away so much of an entity of it.

    ``texts`` is the stored table of distinct texts. Counts are over all documents.
    """
    n_docs = docs.count()
    in_groups = materialise(groups(texts, n_docs, limits), "disclosure-groups")
    bounds = in_groups.groupBy("text_key").agg(F.max("bound").alias("most"))
    spread = texts.join(bounds, "text_key").select("text_key", "most", F.explode("terms").alias("term"))
    counts = term_counts(docs, text_col).groupBy("term").agg(F.sum("n").alias("n_term"))
    usual = F.col("n_term") / F.lit(n_docs)
    rare = spread.join(counts, "term").filter(usual <= F.col("most") * ROUNDING)
    rare = materialise(rare.select("text_key", "term", "n_term"), "disclosure-terms")
    met = rare.join(in_groups, "text_key").filter(usual <= F.col("bound") * ROUNDING)
    met = materialise(met, "disclosure-met")
    group = ["g1", "g2", "term"]
    pairs = (
        met.groupBy(*group, "label", "n_contexts", "information", "n_term")
        .agg(F.sum("n").alias("n"))
        .groupBy(*group, "n_contexts", "information", "n_term")
        .agg(F.count(F.lit(1)).alias("n_both"), F.sum("n").alias("n_docs"))
        # Judged is what also stands elsewhere: in another context of the entity, or without it.
        .filter((F.col("n_both") > 1) | (F.col("n_term") > F.col("n_docs")))
    )
    share = F.log2(_lower_end(F.col("n_both"), F.col("n_contexts"), limits.errors) / usual) / F.col("information")
    kind = F.when(share >= limits.remove, F.lit("remove")).when(share >= limits.generalise, F.lit("generalise"))
    judged = pairs.select(*group, share.alias("share"), kind.alias("kind")).filter("kind is not null")
    # Written, so that its size is known before the join.
    judged = materialise(judged, "disclosure-judged")
    found = met.select("text_key", *group).join(judged, group)
    found = materialise(found.groupBy("text_key", "term").agg(F.max("share").alias("share"), F.max("kind").alias("kind")), "disclosure-harmful")
    forget(in_groups, rare, met, judged)
    return found


def _measure_spans(texts: list[str | None], rules: list[list[dict] | None]) -> list[tuple]:
    """n_email, n_ip, n_card, n_phone, n_terms, base, spans, text without personal data."""
    out = []
    for text, ruled in zip(texts, rules):
        base = base_spans(text) if text else []
        counts = [sum(k == i for _, k, _ in base) for i in range(4)]
        spans = list(base)
        if ruled:
            kinds = {r["term"]: KINDS.index(r["kind"]) for r in ruled}
            for m in _TERM.finditer(text):
                kind = kinds.get(m[0].lower())
                if kind is not None and not any(a < m.end() and m.start() < b for a, _, b in base):
                    spans.append((m.start(), kind, m.end()))
            spans.sort()
        out.append((*counts, len(spans) - len(base), _joined(base), _joined(spans), sanitised(text, spans)))
    return out


def sanitised(text: str | None, spans: list[tuple[int, int, int]]) -> str | None:
    """Spans replaced by labels; overlapping ones by the label of the first."""
    if not text or not spans:
        return text
    parts, at = [], 0
    for a, kind, b in spans:
        if a >= at:
            parts += [text[at:a], LABELS[KINDS[kind]]]
        at = max(at, b)
    return "".join([*parts, text[at:]])


FIELDS = (
    "n_email bigint, n_ip bigint, n_card bigint, n_phone bigint, n_terms bigint, "
    "base string, spans string, sanitised string"
)


def sanitise(
    docs: DataFrame, keep: list[str], limits: Thresholds = Thresholds(), texts: bool = True, text_col: str = "text"
) -> DataFrame:
    """Struct ``row`` of the columns kept; n_email, n_ip, n_card, n_phone, n_terms; base and
    spans (kind:start:end, comma-joined, in code points); sanitised (the text, if ``texts``).

    A null text has no spans and stays null. Equal texts are treated alike; contexts that
    are copies of each other count once. An empty table gives no rows.
    """
    prepare(docs.sparkSession)
    found = materialise(contexts(docs, text_col), "disclosure-contexts")
    known = found.groupBy("text_key").agg(
        F.count(F.lit(1)).alias("n"), F.first("places", True).alias("places"), F.first("terms", True).alias("terms")
    )
    distinct = materialise(known, "disclosure-texts")
    forget(found)
    harmful = disclosing(docs, distinct, limits, text_col)
    # Written, so that its size is known before the join with the texts, and a hot text's rows can be split.
    rules = materialise(
        harmful.groupBy("text_key").agg(F.collect_list(F.struct("term", "kind")).alias("rules")), "disclosure-rules"
    )
    forget(distinct, harmful)
    packed = docs.select(
        F.struct(*[column(docs, c) for c in keep]).alias("row"), column(docs, text_col).cast("string").alias("text")
    )

    def having(entities: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                texts = batch.column("text").to_pylist()
                has = pa.array([bool(t and base_spans(t)) == entities for t in texts], pa.bool_())
                yield batch.filter(has)

        return run

    def finish(batches: Iterator[pa.RecordBatch], searched: bool = True) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            rules = batch.column("rules").to_pylist() if "rules" in batch.schema.names else [None] * batch.num_rows
            texts_here = batch.column("text").to_pylist()
            made = list(zip(*(_measure_spans(texts_here, rules) if searched else [(0, 0, 0, 0, 0, "", "", t) for t in texts_here])))
            types = [pa.int64()] * 5 + [pa.string()] * 3
            arrays = [pa.array(list(c), t) for c, t in zip(made, types)]
            if not texts:
                arrays[-1] = pa.nulls(batch.num_rows, pa.string())
            yield pa.RecordBatch.from_arrays([batch.column("row"), *arrays], names=out_names)

    schema = T.StructType([packed.schema["row"], *T._parse_datatype_string(FIELDS).fields])
    out_names = ["row", *[x.split(" ")[0] for x in FIELDS.split(", ")]]
    # One function where there is nothing to join, so that a task needs one worker.
    free = packed.mapInArrow(released(lambda batches: finish(having(False)(batches), False)), schema)
    bound = packed.mapInArrow(released(having(True)), packed.schema).withColumn("text_key", F.md5(F.col("text").cast("binary")))
    bound = bound.join(rules, "text_key", "left").select("row", "text", "rules").mapInArrow(released(finish), schema)
    return free.unionByName(bound)


def cleaned(docs: DataFrame, limits: Thresholds = Thresholds(), text_col: str = "text") -> DataFrame:
    """The documents with their texts sanitised, and their own columns; a null text stays null."""
    done = sanitise(docs, docs.columns, limits, True, text_col)
    own = [
        F.col("sanitised").alias(c) if c == text_col else F.col("row").getField(c).alias(c) for c in docs.columns
    ]
    return done.select(*own)
