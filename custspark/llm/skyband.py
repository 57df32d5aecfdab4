"""How sources differ in their words, inside each language: an audit by dominance skybands.

A language keeps the terms that enough of its documents have. Smoothed shares, in units of
10**-9, compare every source of a language with every other one over all kept terms, and give each
source's terms that stand out most from the language.

For the second, a term's value is its share in the source less its share in the language, and the
first rises with the source's count while the second rises with the language's. So a term that
has no higher count in the source than another, no lower one in the language, and comes later in
UTF-8 order, can't be ranked before it: one that k others dominate like this is not among the first
k. Each task keeps the skyband of what it has seen (what fewer than k others dominate), the
skybands of a source are merged into one, and only that is ranked by exact values.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from custspark.llm.common import column, prepare, released
from custspark.session import materialise

#: Shares are whole numbers of 1 / UNIT; every term is met SMOOTHING times more than it is.
UNIT, SMOOTHING = 1_000_000_000, 5
#: Counts a task holds before it passes them on, candidates whose skyband it takes at once.
COUNTS_AT_ONCE, CANDIDATES_AT_ONCE = 400_000, 200_000
#: Sources and terms of a comparison of two blocks, and terms that are compared at once inside it.
BLOCK_SOURCES, BLOCK_TERMS, TERMS_AT_ONCE = 128, 4_000, 2_048
#: Lanes in which a source's skybands are merged before they meet.
LANES = 8

#: ASCII letters as lower case, bytes of other characters as they are, all else a space.
_LETTERS = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def terms_of(raw: bytes) -> list[bytes]:
    """Runs of letters and of characters beyond ASCII; A-Z lower-cased."""
    return raw.translate(_LETTERS).split()


def counted(docs: DataFrame, lang_col: str, source_col: str, text_col: str) -> DataFrame:
    """lang, source, term, n (occurrences), n_docs: a stored table."""
    prepare(docs.sparkSession)

    def text(name: str) -> Column:
        return F.coalesce(column(docs, name).cast("string"), F.lit(""))

    Counts = dict[tuple[str, str], tuple[Counter, Counter]]

    def rows_of(groups: Counts) -> Iterator[pa.RecordBatch]:
        for (lang, source), (n, n_docs) in groups.items():
            terms = list(n)
            yield pa.RecordBatch.from_pydict(
                {
                    "lang": pa.array([lang] * len(terms), pa.string()),
                    "source": pa.array([source] * len(terms), pa.string()),
                    "term": pa.array(terms, pa.binary()).cast(pa.string()),
                    "n": pa.array(list(n.values()), pa.int64()),
                    "n_docs": pa.array([n_docs[t] for t in terms], pa.int64()),
                }
            )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        groups: Counts = {}
        held = 0
        for batch in batches:
            texts = batch.column("text").cast(pa.binary()).to_pylist()
            for lang, source, raw in zip(batch.column("lang").to_pylist(), batch.column("source").to_pylist(), texts):
                words = terms_of(raw)
                n, n_docs = groups.setdefault((lang, source), (Counter(), Counter()))
                held -= len(n)
                n.update(words)
                n_docs.update(set(words))
                held += len(n)
                if held >= COUNTS_AT_ONCE:
                    yield from rows_of(groups)
                    groups, held = {}, 0
        yield from rows_of(groups)

    partial = docs.select(text(lang_col).alias("lang"), text(source_col).alias("source"), text(text_col).alias("text")).mapInArrow(
        released(run), "lang string, source string, term string, n bigint, n_docs bigint"
    )
    total = partial.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("n_docs").alias("n_docs"))
    return materialise(total, "skyband-counts")


def _share(count: Column, total: Column, kept: Column) -> Column:
    """1 + floor(UNIT * (count + SMOOTHING) / (total + SMOOTHING * kept)), exactly; null without kept terms."""
    above = (count + SMOOTHING).cast("decimal(20,0)") * F.lit(UNIT).cast("decimal(10,0)")
    below = F.nullif(total + kept * SMOOTHING, F.lit(0)).cast("decimal(20,0)")
    return 1 + F.call_function("div", above, below)


def skyband(high: np.ndarray, low: np.ndarray, place: np.ndarray, k: int) -> np.ndarray:
    """The rows that fewer than k others dominate: not lower in ``high``, not higher in ``low``, earlier in ``place``.

    Places differ. Rows are gone through so that whatever dominates a row comes before it; of a row's
    dominators the first k are in the skyband themselves, so it is enough to count its members so far and
    all rows of the block at hand.
    """
    order = np.lexsort((place, low, -high))
    low, place = low[order], place[order]
    kept: list[np.ndarray] = []
    kept_low, kept_place = low[:0], place[:0]
    for at in range(0, len(order), 256):
        own_low, own_place = low[at : at + 256], place[at : at + 256]
        above = np.count_nonzero((kept_low <= own_low[:, None]) & (kept_place < own_place[:, None]), axis=1)
        inside = np.tril((own_low <= own_low[:, None]) & (own_place < own_place[:, None]), -1)
        few = above + np.count_nonzero(inside, axis=1) < k
        kept.append(order[at : at + 256][few])
        kept_low, kept_place = np.append(kept_low, own_low[few]), np.append(kept_place, own_place[few])
    return np.sort(np.concatenate(kept)) if kept else order


def _skyband_of(table: pa.Table, k: int) -> pa.Table:
    """The skybands of the sources in a table of lang, source, term, n, n_lang."""
    if not table.num_rows:
        return table
    lang, source = (table.column(c).combine_chunks().dictionary_encode().indices.to_numpy() for c in ("lang", "source"))
    group = lang.astype(np.int64) * (int(source.max()) + 1) + source
    # Arrow orders texts by their bytes.
    place = np.empty(len(group), np.int64)
    place[pc.sort_indices(table.column("term")).to_numpy()] = np.arange(len(group))
    high, low = table.column("n").to_numpy(), table.column("n_lang").to_numpy()
    order = np.argsort(group, kind="stable")
    kept = [rows[skyband(high[rows], low[rows], place[rows], k)] for rows in np.split(order, np.flatnonzero(np.diff(group[order])) + 1)]
    return table.take(pa.array(np.concatenate(kept)))


def standing_out(shares: DataFrame, k: int) -> DataFrame:
    """lang, source, term, value, rank: each source's k terms that stand out most from the language."""
    known = shares.filter((F.col("n") > 0) & (F.col("p") > F.col("p_lang")))
    names = known.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            held.append(batch)
            if sum(b.num_rows for b in held) >= CANDIDATES_AT_ONCE:
                yield from _skyband_of(pa.Table.from_batches(held), k).to_batches()
                held = []
        if held:
            yield from _skyband_of(pa.Table.from_batches(held), k).to_batches()

    def merge(table: pa.Table) -> pa.Table:
        return _skyband_of(table, k).select(names)

    lane = F.pmod(F.xxhash64("term"), F.lit(LANES)).alias("lane")
    local = known.mapInArrow(released(run), known.schema)
    merged = local.select("*", lane).groupBy("lang", "source", "lane").applyInArrow(merge, known.schema)
    merged = merged.groupBy("lang", "source").applyInArrow(merge, known.schema)
    value = F.col("p") - F.col("p_lang")
    order = Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), "term")
    ranked = merged.select("lang", "source", "term", value.alias("value")).withColumn("rank", F.row_number().over(order))
    return ranked.filter(F.col("rank") <= k)


def _block_distances(table: pa.Table) -> pa.Table:
    """lang, a, b, value: over the terms of one comparison, how far |p - q| is from the sources' shares of a term not met.

    Rows without a term name the sources of both blocks.
    """
    lang = table.column("lang")[0].as_py()
    sources, side = table.column("source").to_pylist(), table.column("first").to_pylist()
    zero = table.column("p_none").to_pylist()
    named = sorted({(s, f, z) for s, f, z in zip(sources, side, zero)})
    of = {s: i for i, (s, _, _) in enumerate(named)}
    none = np.array([z for _, _, z in named], np.int64)
    left = [i for i, (_, f, _) in enumerate(named) if f]
    same = table.column("i")[0] == table.column("j")[0]
    right = np.array(left if same else [i for i, (_, f, _) in enumerate(named) if not f], np.int64)
    met = np.flatnonzero(np.asarray(table.column("p").is_valid()))
    row = np.array([of[sources[i]] for i in met.tolist()], np.int64)
    # Dictionary codes stand for the terms.
    terms = table.column("term").combine_chunks().take(pa.array(met)).dictionary_encode()
    code = terms.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    share = table.column("p").combine_chunks().take(pa.array(met)).to_numpy(zero_copy_only=False).astype(np.int64)
    far = np.zeros((len(left), len(right)), np.int64)
    order = np.argsort(code, kind="stable")
    row, code, share = row[order], code[order], share[order]
    for at in range(0, len(terms.dictionary), TERMS_AT_ONCE):
        some = slice(*np.searchsorted(code, [at, at + TERMS_AT_ONCE]))
        width = min(TERMS_AT_ONCE, len(terms.dictionary) - at)
        p = np.repeat(none[:, None], width, axis=1)
        p[row[some], code[some] - at] = share[some]
        for i, x in enumerate(left):
            far[i] += np.abs(p[right] - p[x]).sum(1) - width * np.abs(none[right] - none[x])
    pairs = [(i, j) for i, x in enumerate(left) for j, y in enumerate(right.tolist()) if x < y or not same]
    i, j = (np.array([q[k] for q in pairs], np.int64) for k in (0, 1))
    return pa.table(
        {
            "lang": pa.array([lang] * len(pairs), pa.string()),
            "a": pa.array([named[left[x]][0] for x in i.tolist()], pa.string()),
            "b": pa.array([named[right[y]][0] for y in j.tolist()], pa.string()),
            "value": pa.array(far[i, j] if len(pairs) else [], pa.int64()),
        }
    )


def distances(groups: DataFrame, shares: DataFrame) -> DataFrame:
    """lang, source, other, value, rank: how far every other source of the language is, farthest first.

    Terms that neither source has are the same distance each, so only terms with a count are compared:
    by blocks of sources against blocks of sources, in slices of terms, as dense arrays inside a task. What
    the tasks give is a number for a pair of sources, as the result has.
    """
    sizes = groups.groupBy("lang").agg(F.count(F.lit(1)).alias("n_sources"), F.first("n_kept").alias("kept"))
    sizes = sizes.select(
        "lang",
        F.ceil(F.col("n_sources") / BLOCK_SOURCES).cast("int").alias("blocks"),
        F.greatest(F.lit(1), F.ceil(F.col("kept") / BLOCK_TERMS)).cast("int").alias("slices"),
    )
    sizes = materialise(sizes, "skyband-blocks")
    block = F.pmod(F.xxhash64("source"), F.col("blocks")).cast("int")
    none = _share(F.lit(0), F.col("n_group"), F.col("n_kept"))
    marks = groups.join(sizes, "lang").select(
        "lang",
        "source",
        F.lit(None).cast("string").alias("term"),
        F.lit(None).cast("bigint").alias("p"),
        F.coalesce(none, F.lit(0)).alias("p_none"),
        "blocks",
        F.explode(F.sequence(F.lit(0), F.col("slices") - 1)).alias("slice"),
    )
    slice_ = F.pmod(F.xxhash64("term", F.lit("slice")), F.col("slices")).cast("int").alias("slice")
    met = shares.join(sizes, "lang").select("lang", "source", "term", "p", "p_none", "blocks", slice_)
    fed = marks.unionByName(met).withColumn("block", block)
    fed = fed.withColumn("with", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    fed = fed.select(
        "lang",
        "slice",
        F.least("block", "with").alias("i"),
        F.greatest("block", "with").alias("j"),
        "source",
        (F.col("block") <= F.col("with")).alias("first"),
        "term",
        "p",
        "p_none",
    )
    schema = "lang string, a string, b string, value bigint"
    parts = fed.groupBy("lang", "slice", "i", "j").applyInArrow(_block_distances, schema)
    summed = parts.groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))
    both = F.explode(F.array(F.struct(F.col("a").alias("source"), F.col("b").alias("other")), F.struct(F.col("b").alias("source"), F.col("a").alias("other"))))
    pairs = summed.select("lang", "value", both.alias("pair")).select("lang", "pair.source", "pair.other", "value")
    own = groups.select("lang", "source", "n_kept", F.coalesce(none, F.lit(0)).alias("none"))
    pairs = pairs.join(own, ["lang", "source"]).join(
        own.select("lang", F.col("source").alias("other"), F.col("none").alias("other_none")), ["lang", "other"]
    )
    value = (F.col("value") + F.col("n_kept") * F.abs(F.col("none") - F.col("other_none"))).alias("value")
    order = Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), "other")
    return pairs.select("lang", "source", "other", value).withColumn("rank", F.row_number().over(order))


def audit(
    docs: DataFrame,
    k: int = 50,
    least_docs: int = 30,
    lang_col: str = "lang",
    source_col: str = "source",
    text_col: str = "text",
) -> DataFrame:
    """lang, source, part, item, value, rank.

    Part ``pair``: item is every other source of the language, value the sum of the differences of both
    shares over all kept terms, all ranks. Part ``term``: item is a term with a higher share in the source
    than in the language, value the difference, ranks up to k. Equal values are ranked by the item's UTF-8 order.

    Null languages, sources and texts are read as empty ones. A group without terms has the share of a term
    not met for all of them, and no part ``term``; a language without kept terms has values of 0. Repeated rows
    are documents each. A language with one source has no pairs. An empty table gives no rows.
    """
    counts = counted(docs, lang_col, source_col, text_col)
    by_term = counts.groupBy("lang", "term").agg(F.sum("n").alias("n_lang"), F.sum("n_docs").alias("n_docs"))
    # Written, so that Spark takes the join's strategy from its size.
    kept = materialise(by_term.filter(F.col("n_docs") >= least_docs).select("lang", "term", "n_lang"), "skyband-kept")
    known = materialise(counts.join(kept, ["lang", "term"]).select("lang", "source", "term", "n", "n_lang"), "skyband-known")
    langs = kept.groupBy("lang").agg(F.count(F.lit(1)).alias("n_kept"), F.sum("n_lang").alias("n_total"))
    sums = known.groupBy("lang", "source").agg(F.sum("n").alias("n_group"))
    names = [F.coalesce(column(docs, c).cast("string"), F.lit("")) for c in (lang_col, source_col)]
    groups = docs.select(names[0].alias("lang"), names[1].alias("source")).distinct()
    zero = F.lit(0).cast("bigint")
    groups = groups.join(langs, "lang", "left").join(sums, ["lang", "source"], "left")
    groups = materialise(
        groups.select("lang", "source", *[F.coalesce(c, zero).alias(c) for c in ("n_kept", "n_total", "n_group")]), "skyband-groups"
    )
    shares = known.join(groups, ["lang", "source"]).select(
        "lang",
        "source",
        "term",
        "n",
        "n_lang",
        _share(F.col("n"), F.col("n_group"), F.col("n_kept")).alias("p"),
        _share(F.col("n_lang"), F.col("n_total"), F.col("n_kept")).alias("p_lang"),
        _share(F.lit(0), F.col("n_group"), F.col("n_kept")).alias("p_none"),
    )
    shares = materialise(shares, "skyband-shares")

    def part(name: str, found: DataFrame, item: str) -> DataFrame:
        return found.select("lang", "source", F.lit(name).alias("part"), F.col(item).alias("item"), "value", "rank")

    return part("pair", distances(groups, shares), "other").unionByName(part("term", standing_out(shares, k), "term"))
