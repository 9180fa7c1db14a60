"""Benchmark decontamination by winnowing, in DataFrame operations only.

Words are runs of digits, letters (A-Z lower-cased) and characters above 0x7F.
Every 13-word window of a test item that occurs in a document is found:

* Each document is cut into overlapping segments, so one row stays small. In
  each, the GRAM-word hash that is least in its window of WINDOW grams is kept
  (leftmost on ties). As GRAM + WINDOW - 1 = 13, any shared span of 13 words
  holds a whole window on both sides and so a fingerprint kept on both.
* Document and item fingerprints are joined. Each hit is extended word by word
  to both sides, by comparing the words themselves, as far as a 13-word window
  around it can reach; where 13 or more agree, those words are hit. A hash
  collision therefore never counts.
* Items of fewer than 13 words are one window each: for each such length all
  grams of that length are kept (a winnowing window of one).

The item fingerprints are broadcast only if their counted rows are at most
BROADCAST_ROWS; a larger benchmark takes a shuffled join of rows without words
on fingerprints first, which then reduces the documents that are extended.

Null or empty texts have no words: no hits, not contaminated; an empty benchmark
hits nothing; an empty table of documents gives no rows. Repeated rows are
returned each, with the hits of their own text. Null ids are kept. Extra
columns are ignored. Very long texts are worked on by segments, but their words
are one row's array before that.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType

from .shared import bounded, fresh, stage_table

SPAN = 13
GRAM = 5
WINDOW = SPAN - GRAM + 1  # 9; _kept() builds it as 3 x 3
#: Words of a segment; POSITION_BITS hold a place in one.
SEGMENT = 4096
POSITION_BITS = 13
#: Fingerprint rows of the benchmark up to which they are broadcast (each is some 400 bytes).
BROADCAST_ROWS = 60_000
#: Tasks that the rows of one fingerprint are spread over in the shuffled join.
SPREAD = 8
#: What lies between words. split() on it is several times faster than regexp_extract_all() of the words.
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only. An all-ASCII text takes the much faster lower()."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(ascii_lower(F.coalesce(text, F.lit(""))), BETWEEN), "")


def _grams(hashes: str, size: int) -> Column:
    """(hash of ``size`` words with the place in its low bits) for each place of the array column ``hashes``."""
    at = lambda i, k: F.get(F.col(hashes), i + k)
    gram = lambda x, i: F.shiftleft(F.xxhash64(F.lit(size), x, *[at(i, k) for k in range(1, size)]), POSITION_BITS).bitwiseOR(i.cast("long"))
    return F.slice(F.transform(F.col(hashes), gram), F.lit(1), F.greatest(F.size(hashes) - (size - 1), F.lit(0)))


def _kept(df: DataFrame, short: list[int]) -> DataFrame:
    """Add ``kept``: the winnowed grams of ``hashes``, then every gram of the lengths in ``short``."""
    df = df.withColumn("grams", _grams("hashes", GRAM))
    # The least of nine neighbours in two steps of three: far cheaper than array_min() of slices.
    least = lambda c, step: F.transform(F.col(c), lambda x, i: F.least(x, F.get(F.col(c), i + step), F.get(F.col(c), i + 2 * step)))
    df = df.withColumn("threes", least("grams", 1))
    nines = F.slice(least("threes", 3), F.lit(1), F.greatest(F.size("grams") - (WINDOW - 1), F.lit(0)))
    kept = F.when(F.size("grams") >= WINDOW, F.array_distinct(nines)).otherwise(F.array().cast(ArrayType(LongType())))
    return df.withColumn("kept", F.concat(kept, *[_grams("hashes", k) for k in short]))


def _sided(df: DataFrame, place: Column, size: Column) -> list[Column]:
    """The gram's words, those before it (nearest first) and those after it, as far as a window can reach."""
    back = F.least(place, F.lit(SPAN - GRAM))
    return [
        F.slice("words", place + 1, size),
        F.reverse(F.slice("words", place - back + 1, back)),
        F.slice("words", place + size + 1, F.lit(SPAN - GRAM)),
    ]


def _agreeing(a: Column, b: Column) -> Column:
    """How many leading elements of two arrays are equal."""
    same = F.zip_with(a, b, lambda x, y: F.coalesce(x == y, F.lit(False)))
    end = F.array_position(same, F.lit(False))
    return F.when(end == 0, F.size(same)).otherwise(end.cast("int") - 1)


def item_fingerprints(items: DataFrame, short: list[int], key: str = "item_id") -> DataFrame:
    """(hash, item_id, need, size, gram, before, after) of each kept gram of each item."""
    words = items.select(F.col(key).alias("item_id"), words_of(F.col("text")).alias("words")).where(F.size("words") > 0)
    words = words.withColumn("hashes", F.transform("words", lambda x: F.xxhash64(x)))
    # An item longer than a segment is fine here: places only order grams within a row and are decoded from the row itself.
    cut = words.withColumn("seg", F.explode(F.sequence(F.lit(0), F.size("words") - 1, F.lit(SEGMENT))))
    cut = cut.select("item_id", F.slice("words", F.col("seg") + 1, F.lit(SEGMENT + SPAN - 1)).alias("words"), F.slice("hashes", F.col("seg") + 1, F.lit(SEGMENT + SPAN - 1)).alias("hashes"), (F.size("words") < SPAN).alias("brief"), F.size("words").alias("n"))
    # explode_outer: a plain explode() adds a filter on size(kept), which would be inlined into nested lambdas.
    whole = _kept(cut.where(~F.col("brief")), []).select("item_id", "words", F.lit(SPAN).alias("need"), F.lit(GRAM).alias("size"), F.explode_outer("kept").alias("kept")).where("kept IS NOT NULL")
    for k in short:
        brief = cut.where(F.col("brief") & (F.col("n") == k)).withColumn("kept", F.explode(_grams("hashes", k)))
        whole = whole.unionByName(brief.select("item_id", "words", F.lit(k).alias("need"), F.lit(k).alias("size"), "kept"))
    place = F.col("kept").bitwiseAND((1 << POSITION_BITS) - 1).cast("int")
    gram, before, after = _sided(whole, place, F.col("size"))
    return whole.select(F.shiftright("kept", POSITION_BITS).alias("hash"), "item_id", "need", "size", gram.alias("gram"), before.alias("before"), after.alias("after"))


def _segments(base: DataFrame) -> DataFrame:
    """(doc_id, text_key, n_words, seg, words): overlapping segments of each row's words."""
    cut = base.withColumn("seg", F.explode(F.sequence(F.lit(0), F.greatest(F.size("words") - 1, F.lit(0)), F.lit(SEGMENT))))
    return cut.select("doc_id", "text_key", F.size("words").alias("n_words"), "seg", F.slice("words", F.col("seg") + 1, F.lit(SEGMENT + SPAN - 1)).alias("words"))


def _shuffled(rows: DataFrame, base: DataFrame, prints: DataFrame) -> DataFrame:
    """The join for a large benchmark: rows without words meet the fingerprints, then segments with hits get their words back.

    The rows of one fingerprint, which a common passage may have many of, are spread over SPREAD tasks.
    """
    thin = rows.where("kept IS NOT NULL").select("doc_id", "text_key", "seg", "kept", F.shiftright("kept", POSITION_BITS).alias("hash"), F.pmod(F.xxhash64("doc_id", "text_key", "seg"), F.lit(SPREAD)).alias("salt"))
    spread = prints.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SPREAD - 1).cast("long"))))
    hits = stage_table(thin.join(spread, ["hash", "salt"]).drop("salt"), "hits")
    owner = lambda t: [F.col("doc_id").eqNullSafe(F.col(f"{t}_id")), F.col("text_key") == F.col(f"{t}_key")]
    named = hits.select(F.col("doc_id").alias("h_id"), F.col("text_key").alias("h_key"), F.col("seg").alias("h_seg"), *[c for c in hits.columns if c not in ("doc_id", "text_key", "seg")])
    whole = base.join(bounded(stage_table(named.select("h_id", "h_key").distinct(), "hit")), owner("h"), "left_semi").dropDuplicates(["doc_id", "text_key"])
    found = _segments(whole).join(named.distinct(), [*owner("h"), F.col("seg") == F.col("h_seg")]).drop("h_id", "h_key", "h_seg")
    marks = base.select("doc_id", "text_key", F.size("words").alias("n_words"), F.lit(0).alias("seg"), F.lit(None).cast("array<string>").alias("words"), F.lit(None).cast("long").alias("kept"))
    return found.unionByName(marks, allowMissingColumns=True)


def contamination(docs: DataFrame, benchmark: DataFrame, doc_key: str = "doc_id", broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """(doc_id, text_key, copies, n_words, spans, items): hits of each distinct (doc_id, text).

    ``spans`` are the hit word ranges [start, end), distinct and ascending;
    ``items`` the ids of the items with occurring windows. ``text_key`` tells
    apart texts under one doc_id; ``copies`` counts equal rows.
    """
    lengths = benchmark.select(F.size(words_of(F.col("text"))).alias("n")).where(F.col("n").between(1, SPAN - 1)).distinct()
    short = sorted(r.n for r in lengths.collect())  # at most 12 values
    prints = item_fingerprints(benchmark, short)

    base = docs.select(F.col(doc_key).alias("doc_id"), F.xxhash64("text").alias("text_key"), words_of(F.col("text")).alias("words"))
    # One marker (null) leads each segment's grams, so that documents without any hit come through the join too.
    rows = _kept(_segments(base).withColumn("hashes", F.transform("words", lambda x: F.xxhash64(x))), short)
    rows = rows.select("doc_id", "text_key", "n_words", "seg", "words", F.explode(F.concat(F.array(F.lit(None).cast("long")), "kept")).alias("kept"))

    if prints.limit(broadcast_rows + 1).count() <= broadcast_rows:
        marker = prints.sparkSession.range(1).select(F.lit(None).cast("long").alias("hash"), *[F.lit(None).cast(prints.schema[c].dataType).alias(c) for c in prints.columns[1:]])
        joined = rows.join(F.broadcast(prints.unionByName(marker)), F.shiftright("kept", POSITION_BITS).eqNullSafe(F.col("hash")))
    else:
        joined = _shuffled(rows, base, prints)

    place = F.col("kept").bitwiseAND((1 << POSITION_BITS) - 1).cast("int")
    gram, before, after = _sided(joined, place, F.col("size"))
    left = F.when(F.col("size") == F.col("need"), F.lit(0)).otherwise(_agreeing(before, F.col("before")))
    right = F.when(F.col("size") == F.col("need"), F.lit(0)).otherwise(_agreeing(after, F.col("after")))
    met = joined.select(
        "doc_id", "text_key", "n_words", "seg", "item_id", "need", F.col("hash").isNull().alias("mark"), place.alias("place"), "size",
        F.when(gram == F.col("gram"), left).alias("left"), F.when(gram == F.col("gram"), right).alias("right"),
    )
    hit = F.col("left") + F.col("size") + F.col("right") >= F.col("need")
    start = F.col("seg") + F.col("place") - F.col("left")
    span = F.struct(start.alias("start"), (start + F.col("left") + F.col("size") + F.col("right")).alias("end"))
    # No filter on ``hit`` here: it would move into the join's condition and cost the join its generated code.
    found = met.groupBy("doc_id", "text_key").agg(
        F.count(F.when(F.col("mark") & (F.col("seg") == 0), 1)).alias("copies"),
        F.max("n_words").alias("n_words"),
        F.array_sort(F.collect_set(F.when(~F.col("mark") & hit, span))).alias("spans"),
        F.collect_set(F.when(~F.col("mark") & hit, F.col("item_id"))).alias("items"),
    )
    return found


def hit_words(spans: Column) -> Column:
    """Words in the union of ascending spans."""
    empty = F.struct(F.lit(0).alias("n"), F.lit(0).alias("reach"))
    step = lambda acc, s: F.struct((acc["n"] + F.greatest(s["end"] - F.greatest(s["start"], acc["reach"]), F.lit(0))).alias("n"), F.greatest(acc["reach"], s["end"]).alias("reach"))
    return F.aggregate(spans, empty, step, lambda acc: acc["n"].cast("long"))


def is_contaminated(n_hit: Column, n_words: Column) -> Column:
    return (n_hit > 0) & (20 * n_hit >= n_words)


def contamination_report(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, n_words, n_hit, n_items, items_sha256, contaminated), one row for each row of ``docs``."""
    found = contamination(docs, benchmark)
    found = found.withColumn("n_hit", hit_words(F.col("spans"))).withColumn("again", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))
    listed = F.concat_ws(",", F.array_sort(F.transform("items", lambda x: x.cast("string"))))
    return found.select(
        "doc_id", F.col("n_words").cast("long").alias("n_words"), "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(listed, 256).alias("items_sha256"), is_contaminated(F.col("n_hit"), F.col("n_words")).alias("contaminated"),
    )


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``docs`` without the contaminated ones. Only ids and text hashes of those are joined, never texts."""
    found = contamination(docs, benchmark)
    n_hit = hit_words(F.col("spans"))
    id_, key = fresh(docs, "__id", "__key")
    bad = found.where(is_contaminated(n_hit, F.col("n_words"))).select(F.col("doc_id").alias(id_), F.col("text_key").alias(key))
    bad = bounded(stage_table(bad, "contaminated"))
    return docs.join(bad, F.col("doc_id").eqNullSafe(F.col(id_)) & (F.xxhash64("text") == F.col(key)), "left_anti")


ORACLE = r"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), bw AS (
  SELECT item_id, least(13, len(w)) AS k, unnest(generate_series(1, len(w) - least(13, len(w)) + 1)) AS p, w FROM b WHERE len(w) > 0
), bg AS (
  SELECT DISTINCT item_id, k, array_to_string(w[p : p + k - 1], ' ') AS g FROM bw
), dw AS (
  SELECT rid, x.k, unnest(generate_series(1, len(w) - x.k + 1)) AS p, w FROM d, (SELECT DISTINCT k FROM bg) x WHERE len(w) >= x.k
), h AS (
  SELECT dw.rid, dw.p, dw.k, bg.item_id FROM dw JOIN bg ON dw.k = bg.k AND array_to_string(dw.w[dw.p : dw.p + dw.k - 1], ' ') = bg.g
), n AS (
  SELECT rid, count(DISTINCT q) AS n_hit FROM (SELECT rid, unnest(generate_series(p, p + k - 1)) AS q FROM (SELECT DISTINCT rid, p, k FROM h)) GROUP BY rid
), i AS (
  SELECT rid, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS ids FROM h GROUP BY rid
)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, coalesce(n.n_hit, 0) AS n_hit, coalesce(i.n_items, 0) AS n_items,
       sha256(coalesce(i.ids, '')) AS items_sha256,
       coalesce(n.n_hit, 0) > 0 AND 20 * coalesce(n.n_hit, 0) >= len(d.w) AS contaminated
FROM d LEFT JOIN n USING (rid) LEFT JOIN i USING (rid)
"""
