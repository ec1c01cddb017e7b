"""N-gram Jaccard self-join: MinHash LSH forest for candidates, exact set comparison for links.

Texts become sets of five-word shingles. Equal word sequences are folded into one representative first. A signature is
cut into ``TREES`` runs of ``DEEPEST`` labels, and each run is a path in one of the forest's tries. Spark gathers the
representatives that share a trie's shortest useful prefix; there they are sorted by their labels, and the walk starts at
the longest prefixes they share. A representative's prefix is shortened label by label until its neighbours met so far say
that the target recall is reached: one of estimated similarity s stands for 1 / s**k, of which (1 - s**k)**TREES are missed
by all tries at depth k. A representative without neighbours goes down to the shortest prefix.

A pair of texts is compared exactly in one place, the trie where it shares the longest prefix (the first of several), and
only texts with such a pair travel there.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from morphlake.llm.components import connected_components
from morphlake.llm.shared import cut, table
from morphlake.llm.textblocks import alphanumeric_words, encode, mix, word_hashes

WORDS, THRESHOLD = 5, 0.8
TREES, DEEPEST, TARGET_RECALL = 16, 6, 0.99998
MARGIN = 0.2
#: Most members, and shingles, of a block of a crowded prefix; two blocks meet in a task.
BLOCK, BLOCK_SHINGLES = 512, 1 << 19
#: A row's own key, by which a class's first row is chosen: null ids last (as -1), then the id, then the text's hash.
#: Copies of one text beyond which its rows are joined by broadcast; at most 100,000 texts have as many.
HOT_COPIES, HOT_TEXTS = 1000, 100_000
ROW = ("missing", "doc_id", "text_key")


def prefix_length(threshold: float = THRESHOLD, target: float = TARGET_RECALL) -> int:
    """The longest prefix by which a pair at the threshold still meets in some tree with the target's probability."""
    depth = DEEPEST
    while depth > 1 and 1 - (1 - threshold**depth) ** TREES < target:
        depth -= 1
    return depth


def shingles(words: np.ndarray, counts: np.ndarray, n: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the n-word shingles of each document, in order, and their numbers; shorter texts are one shingle."""
    weights = [np.uint64(pow(0xC2B2AE3D27D4EB4F, i + 1, 1 << 64)) for i in range(n)]
    number = np.where(counts == 0, 0, np.maximum(1, counts - n + 1))
    ends, firsts = np.cumsum(counts), np.cumsum(number) - number
    doc = np.repeat(np.arange(len(counts)), number)
    at = np.arange(len(doc)) - firsts[doc] + (ends - counts)[doc]
    padded = np.concatenate([words, np.zeros(n, dtype=np.uint64)])
    sums = np.zeros(len(doc), dtype=np.uint64)
    for i, w in enumerate(weights):
        inside = at + i < ends[doc]
        sums += np.where(inside, padded[at + i] * w, np.uint64(0))
    return mix(sums), number


def _signatures(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    kept, rng = alphanumeric_words(), np.random.default_rng(11)
    factors = rng.integers(1, 1 << 63, TREES * DEEPEST, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    for whole in batches:
        for start, end in _slices(whole["text"].tolist()):
            pdf = whole.iloc[start:end]
            words, counts = word_hashes(encode(pdf["text"]), kept)
            grams, number = shingles(words, counts)
            has, begins = number > 0, (np.cumsum(number) - number)[number > 0]
            signature = np.zeros((len(pdf), len(factors)), dtype=np.uint32)
            if has.any():
                for i, f in enumerate(factors):
                    signature[has, i] = np.minimum.reduceat(mixed_by(grams, f), begins) >> np.uint64(32)
            k1, k2 = sequence_keys(grams, number)
            yield pd.DataFrame({**{c: pdf[c] for c in ROW}, "k1": k1, "k2": k2, "n": number, "signature": [s.tobytes() for s in signature]})


def _slices(texts: list, rows: int = 256, chars: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Consecutive ranges of at most so many texts and characters (a longer text alone), which bounds a step's arrays."""
    start = size = 0
    for i, t in enumerate(texts):
        n = len(t) if isinstance(t, str) else 0
        if i > start and (i - start >= rows or size + n > chars):
            yield start, i
            start, size = i, 0
        size += n
    if texts:
        yield start, len(texts)


def sequence_keys(grams: np.ndarray, number: np.ndarray) -> list[np.ndarray]:
    """Two hashes of each document's word sequence: sums over its shingles, each hashed together with its place."""
    starts, has, keys = np.cumsum(number) - number, number > 0, []
    place = (np.arange(len(grams)) - np.repeat(starts, number)).astype(np.uint64)
    for p in np.random.default_rng(12).integers(1, 1 << 63, 2, dtype=np.uint64) * np.uint64(2) + np.uint64(1):
        total = np.zeros(len(number), dtype=np.uint64)
        if has.any():
            total[has] = np.add.reduceat(mix(grams * p + place), starts[has])
        keys.append(mix(total + number.astype(np.uint64)).view(np.int64))
    return keys


def whole_groups(batches: Iterator[pd.DataFrame], keys: list[str]) -> Iterator[list[pd.DataFrame]]:
    """Lists of groups from batches of a partition that is sorted by ``keys``; the last, unended one waits for the next batch."""
    tail = None
    for pdf in batches:
        if not len(pdf):
            continue
        pdf = pdf if tail is None else pd.concat([tail, pdf], ignore_index=True)
        changes = np.zeros(len(pdf), dtype=bool)
        for k in keys:
            column = pdf[k].to_numpy()
            changes[1:] |= column[1:] != column[:-1]
        starts = [0, *np.flatnonzero(changes).tolist()]
        if len(starts) > 1:
            yield [pdf.iloc[x:y] for x, y in zip(starts, starts[1:], strict=False)]
        tail = pdf.iloc[starts[-1] :].reset_index(drop=True)
    if tail is not None:
        yield [tail]


def mixed_by(x: np.ndarray, factor: np.uint64) -> np.ndarray:
    x = x * factor
    return x ^ (x >> np.uint64(29))


def _local_roots(adjacent: np.ndarray) -> np.ndarray:
    """For each row of a symmetric boolean matrix, the smallest row of its component."""
    root = np.arange(len(adjacent))
    masked = adjacent | np.eye(len(adjacent), dtype=bool)
    while True:
        new = np.where(masked, root[None, :], len(root)).min(axis=1)
        new = new[new]
        if (new == root).all():
            return root
        root = new


def _tries(signatures) -> np.ndarray:
    return np.frombuffer(b"".join(signatures), dtype=np.uint32).reshape(len(signatures), TREES, DEEPEST)


def _agreement(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of signatures paired along the leading axes: equal labels, the shared prefix in each trie, the trie of the longest (the first)."""
    same = a == b
    shared = np.logical_and.accumulate(same, axis=-1).sum(axis=-1, dtype=np.int8)
    return same.sum(axis=(-1, -2), dtype=np.int16), shared, shared.argmax(axis=-1)


def _matrix(s: np.ndarray, tree: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For all pairs of a group: equal labels, shared prefix in ``tree``, and whether ``tree`` is the place to compare them."""
    n = len(s)
    alike, shared, here = np.zeros((n, n), dtype=np.int16), np.zeros((n, n), dtype=np.int8), np.zeros((n, n), dtype=bool)
    step = max(1, (1 << 15) // n)
    for i in range(0, n, step):
        equal, prefixes, place = _agreement(s[i : i + step, None], s[None])
        alike[i : i + step], shared[i : i + step], here[i : i + step] = equal, prefixes[..., tree], place == tree
    return alike, shared, here


def met_pairs(alike: np.ndarray, shared: np.ndarray, near: np.ndarray, shortest: int, target: float) -> np.ndarray:
    """Which of the ``near`` pairs of a trie meet while prefixes are shortened from DEEPEST labels to ``shortest``.

    At each depth, pairs that share so long a prefix meet if one of them is still open; a member closes once the estimated
    share of its neighbours that all tries miss at this depth is within the target.
    """
    estimate = alike / (TREES * DEEPEST)
    is_open, met = np.ones(len(alike), dtype=bool), np.zeros_like(near)
    for k in range(DEEPEST, shortest - 1, -1):
        met |= near & (shared >= k) & (is_open[:, None] | is_open[None])
        chance = np.maximum(estimate, 1e-3) ** k
        stands_for = met / chance
        missed = stands_for * (1 - chance) ** TREES
        all_, lost = stands_for.sum(axis=1), missed.sum(axis=1)
        is_open &= ~((all_ > 0) & (lost <= (1 - target) * all_))
        if not is_open.any():
            break
    return met


def _walk(threshold: float, target: float):
    least, shortest = (threshold - MARGIN) * TREES * DEEPEST, prefix_length(threshold, target)

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """The members of each prefix that have a pair to be compared there; most prefixes have two members."""
        place = ["tree", "bucket", "i", "j"]
        for groups in whole_groups(batches, place):
            out = []
            pairs = [g for g in groups if len(g) == 2]
            if pairs:
                both = pd.concat(pairs, ignore_index=True)
                s = _tries(both["signature"]).reshape(len(pairs), 2, TREES, DEEPEST)
                alike, _, where = _agreement(s[:, 0], s[:, 1])
                crossing = (both["i"] == both["j"]).to_numpy()[::2] | (both["block"].to_numpy()[::2] != both["block"].to_numpy()[1::2])
                out.append(both.loc[np.repeat((alike >= least) & (where == both["tree"].to_numpy()[::2]) & crossing, 2), [*place, "block", "rep"]])
            for g in groups:
                if len(g) > 2:
                    tree, block = int(g["tree"].iloc[0]), g["block"].to_numpy()
                    s = _tries(g["signature"])
                    order = np.lexsort(s[:, tree, ::-1].T)
                    alike, shared, here = _matrix(s[order], tree)
                    near = alike >= least
                    np.fill_diagonal(near, False)
                    if g["i"].iloc[0] != g["j"].iloc[0]:  # pairs of one block are another group's work
                        near &= block[order][:, None] != block[order][None]
                    chosen = order[(met_pairs(alike, shared, near, shortest, target) & here).any(axis=1)]
                    if len(chosen):
                        out.append(g.iloc[chosen][[*place, "block", "rep"]])
            if out:
                yield pd.concat(out, ignore_index=True)

    return walk


def _links_in(grams: np.ndarray, number: np.ndarray, threshold: float) -> np.ndarray:
    """Which pairs of documents, given by their shingles laid end to end, reach the threshold; exact."""
    doc = np.repeat(np.arange(len(number)), number)
    order = np.lexsort((doc, grams))
    grams, doc = grams[order], doc[order]
    first = np.ones(len(grams), dtype=bool)
    first[1:] = (grams[1:] != grams[:-1]) | (doc[1:] != doc[:-1])
    grams, doc = grams[first], doc[first]
    size = np.bincount(doc, minlength=len(number)).astype(np.float64)
    change = np.concatenate([[0], grams[1:] != grams[:-1]])[: len(grams)]
    column = np.cumsum(change, dtype=np.int64)
    often = np.bincount(column)[column] > 1 if len(column) else np.zeros(0, dtype=bool)
    column, doc = column[often], doc[often]
    column = np.unique(column, return_inverse=True)[1] if len(column) else column
    common = np.zeros((len(number), len(number)))
    width = 4096
    for low in range(0, int(column[-1]) + 1 if len(column) else 0, width):
        a, b = np.searchsorted(column, [low, low + width])
        part = np.zeros((len(number), min(width, int(column[-1]) + 1 - low)), dtype=np.float32)
        part[doc[a:b], column[a:b] - low] = 1
        common += part @ part.T
    union = size[:, None] + size[None, :] - common
    linked = (common >= threshold * union - 1e-9) & (union > 0)
    np.fill_diagonal(linked, False)
    return linked


def _own_shingles(rows: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Shingles of all rows, their numbers, and whether a row's text is the one that its representative stands for."""
    kept, parts = alphanumeric_words(), []
    texts = rows["text"].tolist()
    for start, end in _slices(texts):
        grams, number = shingles(*word_hashes(encode(texts[start:end]), kept))
        parts.append((grams, number, sequence_keys(grams, number)[0]))
    grams, number, keys = (np.concatenate([p[i] for p in parts]) for i in range(3))
    return grams, number, keys == rows["k1"].to_numpy()


def _compare(threshold: float):
    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Exact links among the members of each prefix, of those pairs that this is the place to compare."""
        for groups in whole_groups(batches, ["tree", "bucket", "i", "j"]):
            out = []
            for chunk in _chunks(groups, BLOCK):
                all_rows = pd.concat(chunk, ignore_index=True)
                grams, number, own = _own_shingles(all_rows)
                at, gram_at = 0, np.concatenate([[0], np.cumsum(number)])
                for g in chunk:
                    rows = np.arange(at, at + len(g))[own[at : at + len(g)]]
                    at += len(g)
                    if len(rows) < 2:
                        continue
                    linked = _links_in(np.concatenate([grams[gram_at[r] : gram_at[r + 1]] for r in rows]), number[rows], threshold)
                    linked &= _matrix(_tries(all_rows["signature"].iloc[rows]), int(g["tree"].iloc[0]))[2]
                    block = all_rows["block"].to_numpy()[rows]
                    if g["i"].iloc[0] != g["j"].iloc[0]:
                        linked &= block[:, None] != block[None, :]
                    ids = all_rows["rep"].to_numpy()[rows]
                    out.append(pd.DataFrame({"rep": ids, "root": ids[_local_roots(linked)], "links": linked @ all_rows["copies"].to_numpy()[rows]}))
            if out:
                yield pd.concat(out, ignore_index=True)

    return compare


def _chunks(groups: list[pd.DataFrame], rows: int) -> Iterator[list[pd.DataFrame]]:
    chunk: list[pd.DataFrame] = []
    for g in groups:
        if chunk and sum(map(len, chunk)) + len(g) > rows:
            yield chunk
            chunk = []
        chunk.append(g)
    if chunk:
        yield chunk


def jaccard_join(docs: DataFrame, threshold: float = THRESHOLD, target: float = TARGET_RECALL) -> DataFrame:
    """(doc_id, class_id, n_links, n_copies, n_shingles), a row for each row of ``docs``.

    n_links: how many other documents have a Jaccard similarity of at least ``threshold`` to this one (copies included);
    class_id: the smallest doc_id of all documents that chains of links lead to; n_copies: documents of the same words.
    Words are lower-cased runs of digits, ASCII letters and non-ASCII bytes. Texts without words (null, empty, signs
    only) have no shingle and link to nothing, each is its own class. Texts of fewer than five words are one shingle.
    Rows of equal doc_id are one document if their words are equal; otherwise each row has its own texts' links, and
    shares the id. A null id is treated as the id -1. Extra columns are ignored.
    """
    joined, worded = _classed(docs, threshold, target), F.col("n") > 0
    return joined.select(
        "doc_id",
        F.when(worded, F.col("class")).otherwise(F.col("doc_id")).alias("class_id"),
        F.when(worded, F.col("links") + F.col("copies") - 1).otherwise(0).cast("long").alias("n_links"),
        F.when(worded, F.col("copies")).otherwise(1).cast("long").alias("n_copies"),
        F.col("n").alias("n_shingles"),
    )


def _keyed(docs: DataFrame, *columns: str | Column) -> DataFrame:
    """Each row's own key, and ``columns``."""
    return docs.select(F.col("doc_id").isNull().cast("int").alias("missing"), F.coalesce(F.col("doc_id").cast("long"), F.lit(-1)).alias("doc_id"), F.xxhash64("text").alias("text_key"), *columns)


def _classed(docs: DataFrame, threshold: float, target: float) -> DataFrame:
    """Each row's key, its number of shingles n, and (null without words) its copies, links, class and the class's first row."""
    signed = cut(_keyed(docs, "text").mapInPandas(_signatures, "missing int, doc_id long, text_key long, k1 long, k2 long, n long, signature binary"))
    reps = signed.where("n > 0").groupBy("k1", "k2").agg(F.min("doc_id").alias("least"), F.min(F.struct(*ROW)).alias("first"), F.count(F.lit(1)).alias("copies"), F.first("signature").alias("signature"), F.first("n").alias("n"))
    reps = cut(reps.withColumn("rep", F.monotonically_increasing_id()))
    short = prefix_length(threshold, target)
    label = lambda t: F.xxhash64(F.substring("signature", t * DEEPEST * 4 + 1, short * 4))
    trees = F.array(*[F.struct(F.lit(t).alias("tree"), label(t).alias("bucket")) for t in range(TREES)])
    nodes = reps.select("rep", "n", F.inline(trees))
    held = nodes.groupBy("tree", "bucket").agg(F.count(F.lit(1)).alias("size"), F.sum("n").alias("grams")).where("size > 1")
    parts = F.greatest(F.ceil(F.col("size") / BLOCK), F.least(F.col("size"), F.ceil(F.col("grams") / BLOCK_SHINGLES))).cast("int")
    nodes = nodes.select("rep", "tree", "bucket").join(held.select("tree", "bucket", parts.alias("parts")), ["tree", "bucket"])
    dealt = _in_block_pairs(nodes.join(reps.select("rep", "signature"), "rep"))
    chosen = cut(dealt.mapInPandas(_walk(threshold, target), "tree int, bucket long, i int, j int, block int, rep long"))
    members = chosen.join(reps.select("rep", "first.*", "copies", "k1", "signature"), "rep")
    texts = _keyed(docs, "text").groupBy(*ROW).agg(F.first("text").alias("text"))
    meeting = texts.join(members, list(ROW)).drop(*ROW).repartition("tree", "bucket", "i", "j").sortWithinPartitions("tree", "bucket", "i", "j")
    checked = cut(meeting.mapInPandas(_compare(threshold), "rep long, root long, links long"))
    counted = checked.groupBy("rep").agg(F.sum("links").alias("links"))
    classes = connected_components(checked.where("rep <> root").select(F.col("rep").alias("a"), F.col("root").alias("b")))
    classes = classes.withColumnRenamed("node", "rep").join(reps.select("rep", "least", "first"), "rep")
    least = classes.groupBy("root").agg(F.min("least").alias("class"), F.min("first").alias("class_first"))
    classes = classes.join(least, "root").select("rep", "class", "class_first")
    known = reps.select("k1", "k2", "rep", "least", "first", "copies").join(counted, "rep", "left").join(classes, "rep", "left")
    known = cut(known.select("k1", "k2", "copies", F.coalesce("class", "least").alias("class"), F.coalesce("class_first", "first").alias("first"), F.coalesce("links", F.lit(0)).alias("links")))
    rows, most = signed.select(*ROW, "k1", "k2", "n"), max(HOT_COPIES, (known.agg(F.sum("copies")).first()[0] or 0) // HOT_TEXTS)
    hot = F.broadcast(known.where(F.col("copies") > most))  # at most HOT_TEXTS rows
    worded = rows.where("n > 0")
    few = worded.join(hot.select("k1", "k2"), ["k1", "k2"], "left_anti").join(known.where(F.col("copies") <= most), ["k1", "k2"])
    out = worded.join(hot, ["k1", "k2"]).unionByName(few)
    return out.unionByName(rows.where("n = 0"), allowMissingColumns=True).drop("k1", "k2")


def _in_block_pairs(rows: DataFrame) -> DataFrame:
    """Deal a prefix's members into ``parts`` blocks, give each to every pair of blocks (i <= j) that it is in, sort by these."""
    dealt = rows.withColumn("block", F.pmod(F.xxhash64("rep", F.lit("block")), F.col("parts")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("parts") - 1))
    dealt = dealt.withColumn("other", other).withColumns({"i": F.least("block", "other"), "j": F.greatest("block", "other")}).drop("parts", "other")
    return dealt.repartition("tree", "bucket", "i", "j").sortWithinPartitions("tree", "bucket", "i", "j")


def one_of_each_group(docs: DataFrame) -> DataFrame:
    """Of each class of similar texts one row: that of smallest doc_id (null last), then of smallest text hash.

    Rows that share an id, or have none, are classed by their texts like others. Of rows of equal id and text one stays.
    Texts without words are no copies of each other: all rows without an id stay, and one for each id and text.
    """
    found = _classed(docs, THRESHOLD, TARGET_RECALL)
    kept = found.where((F.col("n") == 0) | (F.struct(*ROW) == F.col("first"))).select(*ROW).distinct()
    apart = F.col("doc_id").isNull() & ~F.coalesce(F.col("text"), F.lit("")).rlike(r"[0-9A-Za-z]|[^\x00-\x7F]")
    rows = _keyed(docs.where(~apart), F.struct(*docs.columns).alias("row"))
    rows = rows.groupBy(*ROW).agg(F.min_by("row", F.xxhash64("row")).alias("row")).join(kept, list(ROW))  # equal rows shrink before they are moved
    return rows.select("row.*").unionByName(docs.where(apart))


def op4_lsh_forest_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join(table(spark, sf_dir, "documents"))
