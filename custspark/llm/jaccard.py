"""Exact Jaccard self-join of word shingles with adaptive multi-match prefixes.

Two sets that are similar enough share at least l tokens within their l-prefixes, the
first n - ceil(t n) + l tokens in any order common to all sets. With rare tokens first,
most of a prefix are tokens that no other set has. Each set chooses the l that it
estimates to be cheapest: a longer prefix meets more lists but asks for more matches.

1. Sets are reduced to classes of equal sets.
2. A consistent quarter of the tokens (by hash, so the same for all sets) already shows
   most sets to have more tokens of their own than any similar pair may differ by.
   They can link with nothing; only the others go on, with all their tokens.
3. Document frequencies of the rest give the order, each set's l, and the lists.
4. Short lists give pairs, whose matches are counted, and bounded by position, before any set
   is compared. A list longer than PAIR_LIST never becomes pairs: its members are compared
   block by block, each pair of blocks in a task of its own, which returns a spanning forest.
5. Each set's best pairs are verified first. Of the rest, in rounds, each component's best pairs
   with other components are; what they link is contracted to one, and pairs inside it are
   verified no more. Each round takes more pairs of a component, so rounds are few.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from custspark.llm.common import ASCII_LOWER, Measure, Windows, extend, mixed, prepare, raw_texts, released, signed, word_hashes
from custspark.llm.components import components
from custspark.session import collected, discard, forget, materialise

#: Longest list that becomes pairs, members of a block of a longer one, longest l, pairs verified first per set.
PAIR_LIST, BLOCK, MOST_MATCHES, BEST = 128, 512, 8, 3
#: Lanes in which a component's pairs are ranked before they meet.
LANES = 16
#: Verifying one token against scanning one list entry, for the choice of l.
VERIFY_COST = 0.05


def shingles(raw: bytes, width: int, windows: Windows) -> np.ndarray:
    """The sorted distinct shingles of a text; the whole sequence if it has fewer words; none without words."""
    hashes = word_hashes(raw.translate(ASCII_LOWER).split())
    if not len(hashes):
        return np.empty(0, np.uint64)
    return np.unique(windows.of(hashes, min(width, len(hashes))))


def set_key(tokens: np.ndarray) -> tuple[int, int]:
    """128 bits that depend on the set alone, as two signed integers."""
    a, b = np.add.reduce(mixed(tokens, 1)), np.bitwise_xor.reduce(mixed(tokens, 2))
    return int(a.view(np.int64)), int(b.view(np.int64))


_SAMPLE_BELOW = np.uint64(1 << 62)


def keyed(docs: DataFrame, keep: list[str], width: int, sample: bool, id_col: str, text_col: str) -> DataFrame:
    """Struct ``row``; n_shingles; k1, k2 (null for an empty set); the sampled tokens."""

    def start() -> Measure:
        windows = Windows()

        def each(_: pa.Array, texts: pa.Array) -> list[pa.Array]:
            sets = [shingles(raw, width, windows) for raw in raw_texts(texts)]
            keys = [set_key(s) if len(s) else (None, None) for s in sets]
            kept = [signed(s[s < _SAMPLE_BELOW]) if sample else s[:0].view(np.int64) for s in sets]
            ends = np.concatenate([[0], np.cumsum([len(k) for k in kept])]).astype(np.int32)
            return [
                pa.array([len(s) for s in sets], pa.int64()),
                pa.array([k[0] for k in keys], pa.int64()),
                pa.array([k[1] for k in keys], pa.int64()),
                pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(kept))),
            ]

        return each

    return extend(docs, start, "n_shingles bigint, k1 bigint, k2 bigint, sampled array<bigint>", keep, id_col, text_col)


def _slack(n: Column, percent: int) -> Column:
    """Tokens that a set of n may have and a similar one lack: n - ceil(t n)."""
    return n - F.ceil(n * percent / F.lit(100.0))


def _sets(docs: DataFrame, rows: DataFrame, width: int, percent: int, id_col: str, text_col: str) -> DataFrame:
    """cid, k1, k2, n, tokens of the classes that may link: a stored table."""
    spark = docs.sparkSession
    alone = (
        rows.select("k1", F.explode("sampled").alias("token"))
        .groupBy("token")
        .agg(F.min("k1").alias("k1"), F.max("k1").alias("last"))
        .filter("k1 = last")
        .groupBy("k1")
        .agg(F.count(F.lit(1)).alias("n_alone"))
    )
    classes = (
        rows.filter("k1 is not null")
        .groupBy("k1", "k2")
        .agg(F.min("doc_id").alias("rep"), F.first("n_shingles").alias("n"))
        .join(alone, "k1", "left")
        .filter(F.coalesce("n_alone", F.lit(0)) <= _slack(F.col("n"), percent))
    )
    stored = materialise(classes.select("k1", "k2", "n", "rep"), "jaccard-classes")
    classes = stored.withColumn("cid", F.monotonically_increasing_id())
    windows_of = Windows

    def tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        windows = windows_of()
        for batch in batches:
            sets = [s for s in (shingles(raw, width, windows) for raw in raw_texts(batch.column(0))) if len(s)]
            keys = [set_key(s) for s in sets]
            ends = np.concatenate([[0], np.cumsum([len(s) for s in sets])]).astype(np.int32)
            flat = signed(np.concatenate(sets)) if sets else np.empty(0, np.int64)
            yield pa.RecordBatch.from_pydict(
                {
                    "k1": pa.array([k[0] for k in keys], pa.int64()),
                    "k2": pa.array([k[1] for k in keys], pa.int64()),
                    "tokens": pa.ListArray.from_arrays(pa.array(ends), pa.array(flat)),
                }
            )

    reps = materialise(classes.select("rep").distinct(), "jaccard-representatives")
    named = docs.select(F.col(f"`{id_col}`").alias("rep"), F.col(f"`{text_col}`").cast("string").alias("text"))
    texts = named.join(reps, named.rep.eqNullSafe(reps.rep), "left_semi").select("text")
    full = texts.mapInArrow(released(tokens), "k1 bigint, k2 bigint, tokens array<bigint>")
    # An id that several texts share brings them all; the class keys sort them out.
    sets = classes.join(full, ["k1", "k2"]).dropDuplicates(["cid"])
    prepare(spark)
    stored_sets = materialise(sets.select("cid", "k1", "k2", "n", "tokens"), "jaccard-sets")
    forget(stored, reps)
    return stored_sets


def _postings(sets: DataFrame, percent: int) -> DataFrame:
    """token, cid, n, level, matches: each set's prefix in the order of rarity; a stored table.

    level: the smallest l whose prefix has the token; matches: the l that the set chose.
    """
    spread = sets.select("cid", "n", F.explode("tokens").alias("token"))
    shared = materialise(spread.groupBy("token").agg(F.count(F.lit(1)).alias("df")).filter("df > 1"), "jaccard-df")
    grouped = (
        spread.join(shared, "token")
        .groupBy("cid", "n")
        .agg(F.sort_array(F.collect_list(F.struct("df", "token"))).alias("shared"))
        .withColumn("own", F.col("n") - F.size("shared"))
        # Of the 1-prefix, what is left after the tokens that only this set has.
        .withColumn("first", (_slack(F.col("n"), percent) + 1 - F.col("own")).cast("int"))
        .filter("first > 0")
    )

    def cost(matches: Column) -> Column:
        scanned = F.aggregate(
            F.slice("shared", F.lit(1), F.col("first") + matches - 1), F.lit(0).cast("bigint"), lambda a, t: a + t["df"]
        )
        # By Markov at most scanned / l sets meet l matches.
        return scanned * (1 + VERIFY_COST * F.col("n") / matches)

    choices = F.transform(
        F.sequence(F.lit(1), F.lit(MOST_MATCHES)), lambda m: F.struct(cost(m).alias("cost"), m.alias("matches"))
    )
    chosen = grouped.withColumn("matches", F.array_min(choices)["matches"])
    prefix = F.slice("shared", F.lit(1), F.col("first") + F.col("matches") - 1)
    postings = materialise(
        chosen.select("cid", "n", "first", "matches", F.posexplode(prefix).alias("at", "t")).select(
            F.col("t.token").alias("token"),
            "cid",
            "n",
            F.greatest(F.lit(1), F.col("at") - F.col("first") + 2).alias("level"),
            "matches",
        ),
        "jaccard-postings",
    )
    forget(shared)
    return postings


def _pairs(listed: DataFrame, percent: int) -> DataFrame:
    """a, b, met of short lists: pairs that enough matches, their sizes and their positions allow."""
    a, b = listed.alias("a"), listed.alias("b")
    na, nb = F.col("a.n"), F.col("b.n")
    fitting = (100 * F.least(na, nb) >= percent * F.greatest(na, nb)) & F.expr("a.level <= b.matches and b.level <= a.matches")
    met = (
        a.join(b, F.expr("a.token = b.token and a.cid < b.cid"))
        .filter(fitting)
        .groupBy(F.col("a.cid").alias("a"), F.col("b.cid").alias("b"))
        .agg(
            F.count(F.lit(1)).alias("met"),
            F.first(F.least("a.matches", "b.matches")).alias("matches"),
            F.first(na).alias("na"),
            F.first(nb).alias("nb"),
        )
    )
    needed = F.ceil((F.col("na") + F.col("nb")) * percent / F.lit(100.0 + percent))
    # Beyond the prefixes a pair can share no more than the longer rest.
    rest = F.greatest(*(F.col(c) - _slack(F.col(c), percent) - F.col("matches") for c in ("na", "nb")))
    return met.filter((F.col("met") >= F.col("matches")) & (F.col("met") + rest >= needed)).select("a", "b", "met")


def overlap_links(percent: int, cids: np.ndarray, sets: list[np.ndarray], other: int) -> list[tuple[int, int]]:
    """A spanning forest of the links among sets, or of those between the first `other` and the rest."""
    sizes = np.array([len(s) for s in sets])
    owner = np.repeat(np.arange(len(sets)), sizes)
    flat = np.concatenate(sets)
    order = np.argsort(flat, kind="stable")
    flat, owner = flat[order], owner[order]
    parent = list(range(len(sets)))

    def find(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for i in range(other or len(sets)):
        low, high = np.searchsorted(flat, sets[i], "left"), np.searchsorted(flat, sets[i], "right")
        width = high - low
        at = np.repeat(low - np.concatenate([[0], np.cumsum(width)[:-1]]), width) + np.arange(int(width.sum()))
        both = np.bincount(owner[at], minlength=len(sets))
        alike = 100 * both >= percent * (sizes[i] + sizes - both)
        for j in np.flatnonzero(alike).tolist():
            if j < (other or i + 1):
                continue
            x, y = find(i), find(j)
            if x != y:
                parent[x] = y
    # Every tree is a star round its smallest id: the same, whichever token the sets have met by.
    least: dict[int, int] = {}
    for i, cid in enumerate(cids.tolist()):
        least[find(i)] = min(least.get(find(i), cid), cid)
    return [(least[find(i)], cid) for i, cid in enumerate(cids.tolist()) if least[find(i)] != cid]


def _block_links(heavy: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """a, b: links among the members of long lists, block against block."""
    counted = heavy.groupBy("token").agg(F.count(F.lit(1)).alias("size"))
    n_blocks = F.ceil(F.col("size") / BLOCK).cast("int")
    member = heavy.select("token", "cid").join(counted, "token")
    member = member.withColumn("blocks", n_blocks).withColumn("block", F.pmod(F.xxhash64("cid"), F.col("blocks")).cast("int"))
    against = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("with")
    tasks = member.select("token", "cid", "block", against).select(
        "token",
        "cid",
        F.least("block", "with").alias("i"),
        F.greatest("block", "with").alias("j"),
        (F.col("block") > F.col("with")).alias("second"),
    )
    fed = tasks.join(sets.select("cid", "tokens"), "cid")

    def compare(table: pa.Table) -> pa.Table:
        second = table.column("second").to_numpy(zero_copy_only=False).astype(bool)
        order = np.argsort(second, kind="stable")
        cids = table.column("cid").to_numpy()[order]
        tokens = table.column("tokens").combine_chunks()
        ends, flat = tokens.offsets.to_numpy(), tokens.values.to_numpy()
        parts = [flat[ends[k] : ends[k + 1]] for k in order.tolist()]
        other = int((~second).sum()) if second.any() else 0
        links = overlap_links(percent, cids, parts, other) if len(parts) > 1 else []
        return pa.table(
            {"a": pa.array([x for x, _ in links], pa.int64()), "b": pa.array([y for _, y in links], pa.int64())}
        )

    return fed.groupBy("token", "i", "j").applyInArrow(compare, "a bigint, b bigint")


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs a, b that are similar enough: both sets' tokens meet once for each pair; other sets don't move."""
    ids = pairs.select(F.col("a").alias("cid")).union(pairs.select("b")).distinct()
    sets = sets.join(ids, "cid", "left_semi")
    left = sets.select(F.col("cid").alias("a"), F.col("tokens").alias("ta"))
    right = sets.select(F.col("cid").alias("b"), F.col("tokens").alias("tb"))
    both = F.size(F.array_intersect("ta", "tb"))
    alike = 100 * both >= percent * (F.size("ta") + F.size("tb") - both)
    return pairs.select("a", "b").join(left, "a").join(right, "b").filter(alike).select("a", "b")


def _best(pairs: DataFrame, most: int) -> DataFrame:
    """a, b of the pairs (a, b, met, x, y) that are among the best of x or of y; ranked in lanes first, as x may have very many."""
    either = pairs.select("a", "b", "met", F.col("x").alias("of")).union(pairs.select("a", "b", "met", F.col("y").alias("of")))
    order = [F.col("met").desc(), F.col("a"), F.col("b")]
    lanes = Window.partitionBy("of", "lane").orderBy(*order)
    ranked = either.withColumn("lane", F.pmod(F.xxhash64("a", "b"), F.lit(LANES))).withColumn("rank", F.row_number().over(lanes))
    ranked = ranked.filter(F.col("rank") <= most).withColumn("rank", F.row_number().over(Window.partitionBy("of").orderBy(*order)))
    return ranked.filter(F.col("rank") <= most).select("a", "b").distinct()


def _contracted(roots: DataFrame, edges: DataFrame) -> DataFrame:
    """The roots after edges (a, b) between components; a class without a root is a component of its own."""
    up = components(edges).toDF("root", "now")
    moved = roots.join(up, "root", "left").select("node", F.coalesce("now", "root").alias("root"))
    alone = up.join(roots, up.root == roots.node, "left_anti").select(F.col("root").alias("node"), F.col("now").alias("root"))
    return materialise(moved.union(alone), "jaccard-roots")


def _apart(pairs: DataFrame, roots: DataFrame) -> DataFrame:
    """Pairs of classes of different components, which are x and y."""
    ra, rb = roots.toDF("a", "x"), roots.toDF("b", "y")
    known = pairs.join(ra, "a", "left").join(rb, "b", "left")
    return known.withColumns({"x": F.coalesce("x", "a"), "y": F.coalesce("y", "b")}).filter("x <> y")


def rooted(sets: DataFrame, percent: int) -> DataFrame:
    """node, root (class ids): the smallest class of each component of more than one class; a stored table."""
    postings = _postings(sets, percent)
    sizes = materialise(postings.groupBy("token").agg(F.count(F.lit(1)).alias("size")).filter("size > 1"), "jaccard-lists")
    short = postings.join(sizes.filter(F.col("size") <= PAIR_LIST).select("token"), "token")
    long = postings.select("token", "cid").join(sizes.filter(F.col("size") > PAIR_LIST), "token")
    pairs = materialise(_pairs(short, percent), "jaccard-pairs")
    first = materialise(_best(pairs.withColumns({"x": F.col("a"), "y": F.col("b")}), BEST), "jaccard-first")
    # Of the long lists that a set is in it meets one at first, the shortest: near copies choose alike.
    own = long.groupBy("cid").agg(F.min(F.struct("size", "token")).alias("least")).select("least.token", "cid")
    sure = materialise(_verified(first, sets, percent).union(_block_links(own, sets, percent)).distinct(), "jaccard-links")
    roots = components(sure)
    # Long lists inside one component have nothing left to find; the others are compared whole.
    component = F.coalesce("root", "cid")
    mixed = (
        long.join(roots, F.col("cid") == F.col("node"), "left")
        .groupBy("token")
        .agg(F.min(component).alias("low"), F.max(component).alias("high"))
        .filter("low < high")
    )
    mixed = materialise(mixed.select("token"), "jaccard-mixed")
    across = materialise(_block_links(long.select("token", "cid").join(mixed, "token"), sets, percent).distinct(), "jaccard-across")
    forget(postings, sizes, mixed)
    roots = _contracted(roots, _apart(across, roots).select(F.col("x").alias("a"), F.col("y").alias("b")))
    left = pairs.join(first, ["a", "b"], "left_anti")
    done, most = [pairs, first, sure, across], BEST
    while True:
        # Pairs whose sets are in different components; the components stand for the sets.
        apart = materialise(_apart(left.select("a", "b", "met"), roots), "jaccard-apart")
        forget(*done)
        if apart.isEmpty():
            forget(apart)
            return roots
        most *= 4
        chosen = materialise(_best(apart, most), "jaccard-chosen-pairs")
        joined = _verified(chosen, sets, percent).join(apart, ["a", "b"]).select(F.col("x").alias("a"), F.col("y").alias("b"))
        roots = _contracted(roots, joined)
        left, done = apart.join(chosen, ["a", "b"], "left_anti"), [apart, chosen]


def join(
    docs: DataFrame, width: int = 4, percent: int = 85, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """doc_id, n_shingles, component_id, k1, k2, root of each document.

    component_id is the smallest id among the documents reachable by links, the
    document's own where it has none; root names the component (k1, k2 of a class), null
    for an empty set. A null or empty text links with nothing. Repeated rows are equal sets
    and so one component. A null id is never the smallest; among null ids alone the
    component's id is null.
    """
    with collected() as held:
        stored = materialise(keyed(docs, [id_col], width, True, id_col, text_col), "jaccard-keys")
        rows = stored.withColumn("doc_id", F.col("row").getField(id_col)).drop("row")
        sets = _sets(docs, rows, width, percent, id_col, text_col)
        roots = rooted(sets, percent)
        names = sets.select("cid", "k1", "k2")
        linked = roots.join(names, roots.node == names.cid).select("k1", "k2", F.col("root").alias("cid"))
        linked = linked.join(names.select("cid", F.struct("k1", "k2").alias("root")), "cid").drop("cid")
        classes = rows.filter("k1 is not null").groupBy("k1", "k2").agg(F.min("doc_id").alias("smallest"))
        placed_classes = materialise(
            classes.join(linked, ["k1", "k2"], "left").withColumn("root", F.coalesce("root", F.struct("k1", "k2"))), "jaccard-rooted"
        )
        ids = placed_classes.groupBy("root").agg(F.min("smallest").alias("component_id"))
        # Written, so that its size is known and a class with very many copies can be split in the join.
        placed = materialise(placed_classes.join(ids, "root").select("k1", "k2", "root", "component_id"), "jaccard-components")
    discard(docs.sparkSession, held, stored, placed)
    full = rows.filter("k1 is not null").join(placed, ["k1", "k2"])
    out = ["doc_id", "n_shingles", "component_id", "k1", "k2", "root"]
    none = rows.filter("k1 is null").withColumns(
        {"component_id": F.col("doc_id"), "root": F.lit(None).cast(placed.schema["root"].dataType)}
    )
    return full.select(*out).unionByName(none.select(*out))


def first_of_each(
    docs: DataFrame, width: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """The document with the smallest id of each component, with its own columns.

    Documents without words are all kept. Of rows that repeat the smallest id inside a
    component one is kept; a component of null ids keeps one of them.
    """
    with collected() as held:
        placed = materialise(
            join(docs, width, percent, id_col, text_col)
            .filter("root is not null")
            .groupBy("k1", "k2", "root", "component_id")
            .agg(F.min("doc_id").alias("class_id")),
            "jaccard-classes-placed",
        )
        # Classes that hold none of their component's smallest id have nothing to keep; of those that do, one.
        chosen = placed.filter(F.col("class_id").eqNullSafe(F.col("component_id"))).dropDuplicates(["root"])
        chosen = materialise(chosen.select("class_id", "k1", "k2"), "jaccard-chosen")
    discard(docs.sparkSession, held, chosen)
    marked = keyed(docs, docs.columns, width, False, id_col, text_col).select("row", "k1", "k2")
    marked = marked.withColumn("doc_id", F.col("row").getField(id_col))
    # By id and set together, so that the copies of one text are dealt to all tasks.
    a, b = marked.alias("a"), chosen.alias("b")
    met = a.join(b, F.expr("a.doc_id <=> b.class_id and a.k1 = b.k1 and a.k2 = b.k2")).select("a.*")
    kept = met.dropDuplicates(["doc_id", "k1", "k2"]).select("row")
    empty = marked.filter("k1 is null").select("row")
    return kept.unionByName(empty).select(*[F.col("row").getField(c).alias(c) for c in docs.columns])
