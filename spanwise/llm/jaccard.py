"""Exact Jaccard join of word-shingle sets by prefix trees, with connected components.

A document's set holds the 64-bit hashes of its distinct 5-word shingles (words
are runs of non-space, A-Z lower-cased; a text of fewer words has the whole
sequence as one shingle; none without words). Two documents link when
100 * intersection >= 80 * union.

1. Equal sets fold into one class (64-bit signature of the whole set).
2. Extended prefix filter, in hash order: of each set the first n - ceil(0.8 n) + n/20 + 1
   shingles are posted. Linked sets share more than n/25 posted ones, so a set
   whose postings are not met by other sets so often links with nothing. Most
   documents end here.
3. The shingles of the rest are counted; in the global order the rarest come
   first. Linked sets share one of their first n - ceil(0.8 n) + 1. Sets that
   share such a shingle are chained (linear in a shingle's sets, whatever their
   number), and connected components of the chains give blocks: no link crosses
   blocks. Passages that many documents share come last in this order and so
   don't chain documents that differ.
4. In a block, sets are ordered by how many hold a shingle and stored in a
   path-compressed trie; a probe walks it once, sharing the overlap of common
   paths, and prunes subtrees by misses so far, by remaining length and by size.
   Subtrees whose sets are all in the probe's component already are skipped, so a
   large group of near copies costs about its own length. Blocks over
   CHUNK_SHINGLES are cut into chunks, and every pair of chunks is one task; in a
   block of more than ROUTED chunks only sets that share a shingle of step 3 meet.
   Tasks return a spanning forest, never all pairs.

Common shingles (those that MANY different sets of one Arrow batch post, or in step 3
hold; at most COMMON of them, the most frequent ones) are known before anything is
shuffled by shingle. Their rows are spread by their sets: they are met for certain, come last in
the global order, and chain their sets by way of a node of their own. So no
shingle's rows meet in one task, and the answer doesn't depend on which are known.

Rows whose doc_id is null, and texts without words, link with nothing: their
component_id is their doc_id. Repeated rows are returned each, as are several texts
under one id: each links by its own text. Extra columns are ignored. An empty
table gives no rows. A very long text's set is held by one task, as 8 bytes a word.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import bytetext as bt
from .graph import Forest, components
from .shared import bounded, fresh, small_batches, stage_table, unstage

SHINGLE = 5
PERCENT = 80
#: Shingles of a chunk of a block, on average; a task holds two chunks.
CHUNK_SHINGLES = 1 << 19
#: Chunks of a block from which on its sets go to the shingles that they can share.
ROUTED = 32
#: Sets of one batch that make a shingle common; common shingles known at most; tasks to spread one over.
MANY, COMMON, SPREAD = 4, 100_000, 64


def document_sets(column: pa.Array):
    """Yield (row, ascending distinct shingle hashes) for each row."""
    table = bt.nonspace_table()
    for lo, n, buf, offs in bt.blocks(column):
        starts, ends, first = bt.word_bounds(buf, offs, table)
        words = bt.word_hashes(buf, starts, ends)
        grams, rows = bt.gram_hashes(words, first, tuple(range(SHINGLE)))
        cuts = np.searchsorted(rows, np.arange(n + 1))
        counts = np.diff(first)
        for i in range(n):
            if counts[i] >= SHINGLE:
                yield lo + i, np.unique(grams[cuts[i] : cuts[i + 1]])
            elif counts[i]:
                k = int(counts[i])
                yield lo + i, bt.gram_hashes(words[first[i] : first[i + 1]], np.array([0, k]), tuple(range(k)))[0]
            else:
                yield lo + i, np.empty(0, np.uint64)


def signature(s: np.ndarray) -> int:
    """64-bit signature of a set (0 when empty)."""
    if not len(s):
        return 0
    both = np.array([s.sum(), bt.mix(s).sum()], np.uint64)
    return int(bt.mix(both[:1] * np.uint64(3) + bt.mix(both[1:]) + np.uint64(len(s)))[0].astype(np.int64))


def least_common(n, percent: int = PERCENT):
    """How many shingles a set of n has in common with any set it links with, at least."""
    return (percent * n + 99) // 100


def _list_array(lists: list[np.ndarray]) -> pa.Array:
    offsets = np.concatenate(([0], np.cumsum([len(x) for x in lists]))).astype(np.int32)
    flat = np.concatenate(lists) if lists else np.empty(0, np.uint64)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat.view(np.int64)))


def _common_in(lists: list[np.ndarray], rows: int) -> pa.Array:
    """A column of ``rows`` lists: on the first row the shingles that MANY of the sets hold, empty on the others."""
    shingles, sets = np.unique(np.concatenate([*lists, np.empty(0, np.uint64)]), return_counts=True)
    return _list_array([shingles[sets >= MANY], *[np.empty(0, np.uint64)] * (rows - 1)][:rows])


def _prefixes(docs: DataFrame, percent: int) -> DataFrame:
    """(doc_id, text_key, sig, n, prefix, common): the set's signature and size, its extended prefix in hash order, and (on a batch's first row) shingles common in the batch."""

    def run(batches):
        for b in batches:
            sigs, sizes, lists, own = [], [], [], {}
            for _, s in document_sets(b.column(1)):
                n = len(s)
                sigs.append(signature(s))
                sizes.append(n)
                lists.append(s[: n - least_common(n, percent) + n // 20 + 1])
                own[sigs[-1]] = lists[-1]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(sigs, pa.int64()), pa.array(sizes, pa.int64()), _list_array(lists), _common_in(list(own.values()), b.num_rows)], ["doc_id", "text_key", "sig", "n", "prefix", "common"])

    docs = docs.select("doc_id", "text", F.xxhash64("text").alias("text_key"))
    return docs.mapInArrow(run, "doc_id long, text_key long, sig long, n long, prefix array<long>, common array<long>")


class Trie:
    """Path-compressed prefix tree of ordered sets. A node: [piece, children, least size, largest size, a member, one component?, members that end here]."""

    def __init__(self, forest: Forest, percent: int):
        self.forest, self.percent = forest, percent
        self.root = [np.empty(0, np.int64), {}, 0, 0, -1, False, []]

    def probe(self, item: int, size: int, held: np.ndarray) -> None:
        """Link ``item`` with every stored set that it is similar to, unless both are in one component already. held: which elements it has."""
        t, find, join = self.percent, self.forest.find, self.forest.join
        own = find(item)
        todo = [(node, 0, 0) for node in self.root[1].values()]
        while todo:
            node, common, depth = todo.pop()
            piece, children, least, most, member, single, ending = node
            if 100 * size < t * least or 100 * most < t * size or (single and find(member) == own):
                continue
            depth += len(piece)
            common += int(np.count_nonzero(held[piece]))
            union = size + depth - common
            if t * union > 100 * size or t * union > 100 * (common + most - depth):
                continue
            for other in ending:
                if 100 * common >= t * union and join(item, other):
                    own = find(item)
            todo.extend((child, common, depth) for child in children.values())

    def insert(self, item: int, elements: np.ndarray) -> None:
        find, size, at, node = self.forest.find, len(elements), 0, self.root
        own = find(item)
        while True:
            if at == size:
                node[6].append(item)
                return
            child = node[1].get(int(elements[at]))
            if child is None:
                node[1][int(elements[at])] = [elements[at:], {}, size, size, item, True, [item]]
                return
            piece = child[0]
            k = min(len(piece), size - at)
            differ = np.flatnonzero(piece[:k] != elements[at : at + k])
            k = int(differ[0]) if len(differ) else k
            if k < len(piece):
                upper = [piece[:k], {int(piece[k]): child}, child[2], child[3], child[4], child[5], []]
                child[0] = piece[k:]
                node[1][int(piece[0])] = upper
                child = upper
            child[2], child[3] = min(child[2], size), max(child[3], size)
            child[5] = child[5] and find(child[4]) == own
            node, at = child, at + k


def link_sets(sets: list[np.ndarray], percent: int = PERCENT) -> list[int]:
    """The least index of each set's component, where sets link at a Jaccard similarity of ``percent`` or more."""
    forest = Forest(len(sets))
    _, at, counts = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    place = np.empty(len(counts), np.int64)
    place[np.argsort(-counts, kind="stable")] = np.arange(len(counts))
    at = place[at]
    cuts = np.concatenate(([0], np.cumsum([len(s) for s in sets])))
    trie, held = Trie(forest, percent), np.zeros(len(counts), bool)
    for i in range(len(sets)):
        ordered = np.sort(at[cuts[i] : cuts[i + 1]])
        held[ordered] = True
        trie.probe(i, len(ordered), held)
        held[ordered] = False
        trie.insert(i, ordered)
    return [forest.find(i) for i in range(len(sets))]


def _common(batches: DataFrame) -> DataFrame:
    """(shingle, known): the shingles in the column ``common`` that were common most often, COMMON at most, staged."""
    counted = batches.select(F.explode("common").alias("shingle")).groupBy("shingle").count()
    return stage_table(counted.orderBy(F.desc("count"), "shingle").limit(COMMON).select("shingle", F.lit(True).alias("known")), "common")


def _spread(rows: DataFrame, common: DataFrame) -> DataFrame:
    """Add ``salt`` to (sig, shingle, ...): -1, or for common shingles one of SPREAD tasks by the set."""
    salt = F.when(F.col("known"), F.pmod(F.xxhash64("sig"), F.lit(SPREAD))).otherwise(-1)
    return rows.join(F.broadcast(common), "shingle", "left").withColumn("salt", salt).drop("known")


def _linked(docs: DataFrame, percent: int) -> tuple[DataFrame, DataFrame]:
    """(doc_id, text_key, n, sig) of each row, and (sig, root, rep) of each class: its component, and its least (doc_id, text_key)."""
    small_batches(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    prefixes = stage_table(_prefixes(docs, percent), "prefixes")
    meta = stage_table(prefixes.select("doc_id", "text_key", "n", "sig"), "signatures")
    real = meta.where("n > 0 AND doc_id IS NOT NULL")

    classes = real.groupBy("sig").agg(F.min(F.struct("doc_id", "text_key")).alias("rep"), F.max("n").alias("n"))

    posts = _spread(prefixes.where("n > 0 AND doc_id IS NOT NULL").dropDuplicates(["sig"]).select("sig", F.explode("prefix").alias("shingle")), _common(prefixes))
    row = Window.partitionBy("shingle", "salt").orderBy("sig")
    met = posts.select("sig", ((F.col("salt") >= 0) | F.lag("sig").over(row).isNotNull() | F.lead("sig").over(row).isNotNull()).alias("met")).where("met")
    some = met.groupBy("sig").agg(F.count(F.lit(1)).alias("met"))

    def shingle(batches):
        for b in batches:
            rows, lists, expected = [], [], b.column("sig").to_numpy()
            for i, s in document_sets(b.column("text")):
                if signature(s) == expected[i]:  # another row may share the id
                    rows.append(i)
                    lists.append(s)
            yield pa.RecordBatch.from_arrays([pa.array(expected[rows], pa.int64()), pa.array([len(x) for x in lists], pa.int64()), _list_array(lists), _common_in(lists, len(rows))], ["sig", "n", "items", "common"])

    reps = stage_table(classes.join(some, "sig").where("met > floor(n / 25)").select("sig", F.col("rep.doc_id").alias("rep"), F.col("rep.text_key").alias("rep_key")), "survivors")
    unstage(prefixes)
    texts = docs.join(bounded(reps), (F.col("doc_id") == F.col("rep")) & (F.xxhash64("text") == F.col("rep_key"))).select("sig", "text")
    sets = texts.mapInArrow(shingle, "sig long, n long, items array<long>, common array<long>")
    if real.groupBy("doc_id", "text_key").count().where("count > 1").limit(1).count():
        sets = sets.dropDuplicates(["sig"])  # equal rows
    staged = sets = stage_table(sets, "sets")

    items = _spread(sets.select("sig", "n", F.explode("items").alias("shingle")), _common(sets))
    # Any one order will do: common shingles come last, all alike.
    df = F.when(F.col("salt") >= 0, F.lit(1 << 62)).otherwise(F.count(F.lit(1)).over(Window.partitionBy("shingle", "salt")))
    counted = items.select("sig", "n", "shingle", "salt", df.alias("df")).where("df > 1")
    rank = Window.partitionBy("sig").orderBy("df", "shingle")
    ranked = counted.select("sig", "n", "shingle", "salt", F.row_number().over(rank).alias("k"), F.count(F.lit(1)).over(Window.partitionBy("sig")).alias("known"))
    prefix = ranked.where(F.col("k") + F.greatest(F.col("n") - F.col("known"), F.lit(0)) <= F.col("n") - F.expr(f"({percent} * n + 99) div 100") + 1)
    # A common shingle's chains, one for each salt, hang together by the shingle as a node; it names no set.
    before = F.coalesce(F.lag("sig").over(row), F.when(F.col("salt") >= 0, F.col("shingle")))
    chain = prefix.select(before.alias("b"), F.col("sig").alias("a")).where("b IS NOT NULL AND b <> a")
    low = components(chain.distinct())
    blocks = low.unionByName(low.select(F.col("root").alias("node"), "root")).distinct()
    placed = stage_table(classes.join(blocks, F.col("sig") == F.col("node")).select("sig", "n", F.col("root").alias("block")), "blocks")

    def cut(cells: DataFrame) -> DataFrame:
        return cells.groupBy("block").agg(F.ceil(F.sum("n") / CHUNK_SHINGLES).cast("int").alias("chunks")).where("chunks > 1")

    several = stage_table(cut(placed), "chunks")
    most = several.agg(F.max("chunks")).first()[0] or 1
    if most > ROUTED:
        wide = bounded(stage_table(several.where(F.col("chunks") > ROUTED).select("block"), "wide"))
        routed = prefix.select("sig", "shingle").join(placed.join(wide, "block"), "sig").select("sig", "n", F.xxhash64("block", "shingle").alias("block"))
        placed = stage_table(placed.join(wide, "block", "left_anti").select("sig", "n", "block").unionByName(routed), "routed")
        several = stage_table(cut(placed), "chunks")
    tasks = placed.join(bounded(several), "block", "left").withColumn("chunks", F.coalesce("chunks", F.lit(1)))
    tasks = tasks.withColumn("own", F.pmod(F.xxhash64("sig"), F.col("chunks")).cast("int"))

    sets = sets.select("sig", "items").join(tasks.select("block", "sig", "own", "chunks"), "sig")
    sets = sets.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    sets = sets.select("block", F.least("own", "other").alias("one"), F.greatest("own", "other").alias("two"), "sig", "items")

    def join_blocks(batches):
        key, sigs, items = None, [], []

        def flush():
            roots = link_sets(items, percent) if len(items) > 1 else [0]
            own = [i for i, r in enumerate(roots) if i != r]
            return pa.RecordBatch.from_arrays([pa.array([sigs[i] for i in own], pa.int64()), pa.array([sigs[roots[i]] for i in own], pa.int64())], ["a", "b"])

        for b in batches:
            lists = b.column("items")
            flat, offs = lists.flatten().to_numpy(), np.asarray(lists.offsets)
            offs = offs - offs[0]
            keys = list(zip(*(b.column(c).to_pylist() for c in ("block", "one", "two")), strict=True))
            for i, sig in enumerate(b.column("sig").to_pylist()):
                if keys[i] != key:
                    if len(items) > 1:
                        yield flush()
                    key, sigs, items = keys[i], [], []
                sigs.append(sig)
                items.append(flat[offs[i] : offs[i + 1]].copy())
        if len(items) > 1:
            yield flush()

    links = stage_table(sets.repartition("block", "one", "two").sortWithinPartitions("block", "one", "two", "sig").mapInArrow(join_blocks, "a long, b long"), "links")
    unstage(staged)
    # Where each block was one task, its forest holds stars already.
    roots = links.select(F.col("a").alias("node"), F.col("b").alias("root")) if most <= 1 else components(links)

    return meta, classes.join(roots, F.col("sig") == F.col("node"), "left").select("sig", F.coalesce("root", "sig").alias("root"), "rep")


def shingle_components(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """(doc_id, n_shingles, component_id), one row for each row of ``docs``."""
    meta, named = _linked(docs, percent)
    least = named.groupBy("root").agg(F.min("rep.doc_id").alias("component_id"))
    named = named.join(least, "root").select("sig", "component_id")
    return (
        meta.select("doc_id", "n", F.when(F.col("n") > 0, F.col("sig")).alias("sig")).join(named, "sig", "left")
        .select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id")).alias("component_id"))
    )


def one_of_each(docs: DataFrame) -> DataFrame:
    """``docs`` with one document of each group of near copies: that of the least doc_id, of its texts that of the least hash.

    Equal rows of it count once. Texts without a near copy stay, also where their
    id has other texts; documents without words, or without an id, all stay.
    """
    meta, named = _linked(docs, PERCENT)
    least = named.groupBy("root").agg(F.min("rep").alias("kept"))
    found = meta.where("n > 0 AND doc_id IS NOT NULL").join(named.join(least, "root").select("sig", "kept"), "sig")
    stays = (F.col("doc_id") == F.col("kept.doc_id")) & (F.col("text_key") == F.col("kept.text_key"))
    counted = stage_table(found.groupBy("doc_id", "text_key").agg(F.min(stays).alias("stays"), F.count(F.lit(1)).alias("rows")).where("NOT stays OR rows > 1"), "copies")
    id_, key = fresh(docs, "__id", "__key")
    at = (F.col("doc_id") == F.col(id_)) & (F.xxhash64("text") == F.col(key))
    gone, again = (counted.where(c).select(F.col("doc_id").alias(id_), F.col("text_key").alias(key)) for c in ("NOT stays", "stays"))
    left = docs.join(bounded(gone), at, "left_anti")
    if again.limit(1).count():
        again = bounded(again)
        left = left.join(again, at, "left_anti").unionByName(left.join(again, at, "left_semi").dropDuplicates(["doc_id", "text"]))
    return left


ORACLE = r"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents
), s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 5 THEN list_transform(generate_series(1, len(w) - 4), lambda i: array_to_string(w[i : i + 4], ' ')) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS g FROM d
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), p AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2
), e AS (
  SELECT p.a, p.b FROM p JOIN n x ON x.doc_id = p.a JOIN n y ON y.doc_id = p.b WHERE 100 * c >= 80 * (x.n + y.n - c)
), r AS MATERIALIZED (
  WITH RECURSIVE reach(a, b) AS (SELECT a, b FROM e UNION SELECT reach.a, e.b FROM reach JOIN e ON reach.b = e.a) SELECT a, min(b) AS m FROM reach GROUP BY a
)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, coalesce(least(d.doc_id, r.m), d.doc_id) AS component_id
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN r ON r.a = d.doc_id
"""
