"""Benchmark decontamination by SimHash over item-sized windows (native).

Windows as long as a benchmark item are laid into a document wherever it has
enough of the item's anchor words in step with the item; elsewhere a window
lacks too many shingles to be similar (see anchor_words). Windows and items get
64-bit SimHash fingerprints. Cut into RADIUS + 1 blocks, two fingerprints within
RADIUS bits must agree on a block, so an equi-join on (words, block, value)
finds them all; a pair is taken in the first block it agrees on, and what is
within the radius is verified by exact weighted Jaccard similarity.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .storage import cut

SHINGLE = 5
#: Bits between fingerprints of similar windows. A similar window differs in a seventh of 64 bits;
#: README has the measured share of similar windows beyond the radius.
RADIUS = 28
THRESHOLD = 0.8
#: Most anchor words that are broadcast at once; more are taken in several passes.
BROADCAST_ROWS = 500_000
#: Most windows whose places are broadcast to the texts; with more, texts are shuffled to their places.
BROADCAST_WINDOWS = 1 << 20
#: Anchor words that a similar window has in step: more are looked for, so that so many remain.
IN_STEP = 2


def tokens(text: Column) -> Column:
    """Lower-case runs of letters and digits."""
    return F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), "")


def with_shingles(df: DataFrame, words: str, out: str) -> DataFrame:
    """df with out: a hash for each run of SHINGLE words, in order; none for fewer words."""
    h = f"{out}_words_"
    df = df.withColumn(h, F.transform(words, lambda x: F.xxhash64(x)))
    shifted = [F.slice(h, i + 1, F.greatest(F.size(h) - SHINGLE + 1, F.lit(0))).alias(f"w{i}") for i in range(SHINGLE)]
    return df.withColumn(out, F.transform(F.arrays_zip(*shifted), lambda w: F.xxhash64(*[w[f"w{i}"] for i in range(SHINGLE)]))).drop(h)


def simhash(shingles: Column) -> Column:
    """64-bit SimHash of a bag of shingle hashes: each bit is the majority of its bits.

    The ones are counted in 16 bit wide lanes of 16 longs, as many as 65,535 of
    them; longer bags are counted bit by bit.
    """
    lanes = F.lit(0x0001000100010001)
    zero = F.struct(*[F.lit(0).cast("long").alias(f"c{j}") for j in range(16)])
    step = lambda acc, x: F.struct(*[(acc[f"c{j}"] + F.shiftrightunsigned(x, j).bitwiseAND(lanes)).alias(f"c{j}") for j in range(16)])

    def voted(counts: Column) -> Column:
        bits = [
            F.when(F.shiftrightunsigned(counts[f"c{j}"], 16 * lane).bitwiseAND(F.lit(0xFFFF)) * 2 > F.size(shingles), F.lit((1 << (j + 16 * lane)) - (1 << 64 if j + 16 * lane == 63 else 0))).otherwise(F.lit(0).cast("long"))
            for j in range(16)
            for lane in range(4)
        ]
        while len(bits) > 1:
            bits = [a.bitwiseOR(b) for a, b in zip(bits[::2], bits[1::2], strict=True)]
        return bits[0]

    def bit(j: Column) -> Column:
        ones = F.aggregate(shingles, F.lit(0), lambda acc, x: acc + F.call_function("shiftright", x, j).bitwiseAND(F.lit(1)).cast("int"))
        return F.when(ones * 2 > F.size(shingles), F.call_function("shiftleft", F.lit(1).cast("long"), j)).otherwise(F.lit(0).cast("long"))

    long = F.aggregate(F.transform(F.sequence(F.lit(0), F.lit(63)), bit), F.lit(0).cast("long"), lambda acc, x: acc.bitwiseOR(x))
    return F.when(F.size(shingles) < 1 << 16, F.aggregate(shingles, zero, step, voted)).otherwise(long)


def _edges(radius: int) -> list[tuple[int, int]]:
    cuts = [64 * i // (radius + 1) for i in range(radius + 2)]
    return list(zip(cuts, cuts[1:], strict=False))


def blocks(fingerprint: Column, radius: int = RADIUS) -> Column:
    """array<struct<block, value>>: the fingerprint cut into radius + 1 blocks."""
    cut_ = [
        F.struct(F.lit(i).alias("block"), F.shiftrightunsigned(fingerprint, low).bitwiseAND(F.lit((1 << (high - low)) - 1)).cast("int").alias("value"))
        for i, (low, high) in enumerate(_edges(radius))
    ]
    return F.array(*cut_)


def first_block(differing: Column, radius: int = RADIUS) -> Column:
    """The first block without a differing bit."""
    none = lambda low, high: F.shiftrightunsigned(differing, low).bitwiseAND(F.lit((1 << (high - low)) - 1)) == 0
    return F.coalesce(*[F.when(none(low, high), i) for i, (low, high) in enumerate(_edges(radius))])


def numbered(bag: Column) -> Column:
    """The bag as a set: the n-th occurrence of a hash is hashed with n."""
    ordered = F.sort_array(bag)
    again = F.transform(ordered, lambda x, i: F.xxhash64(x, i - F.array_position(ordered, x)))
    return F.when(F.size(F.array_distinct(bag)) == F.size(bag), F.transform(bag, lambda x: F.xxhash64(x, F.lit(-1).cast("long")))).otherwise(again)


def weighted_jaccard(a: Column, b: Column) -> Column:
    """Jaccard similarity of two bags, as numbered() gives them: the sum of the lesser counts over the sum of the greater ones; 0 for two empty bags."""
    low = F.size(F.array_intersect(a, b))
    high = F.size(a) + F.size(b) - low
    return F.when(high > 0, low / high).otherwise(0.0)


def benchmark_items(benchmark: DataFrame) -> DataFrame:
    """item_id, words, n_words, shingles, size, fingerprint; one row a (item_id, text).

    An item of fewer than five words is one shingle of all its words; items
    without words are left out, as there is nothing to find.
    """
    items = with_shingles(benchmark.select("item_id", tokens(F.col("text")).alias("words")).filter(F.size("words") > 0).distinct(), "words", "own")
    items = items.withColumn("shingles", F.when(F.size("words") < SHINGLE, F.array(F.xxhash64("words"))).otherwise(F.col("own"))).drop("own")
    return items.select("item_id", "words", F.size("words").alias("n_words"), "shingles", F.size("shingles").alias("size"), simhash(F.col("shingles")).alias("fingerprint"))


def anchor_words(items: DataFrame, threshold: float) -> DataFrame:
    """word, offset, item_id, n_words, slack, need, least, in_windows: some of the longest words of each item, and how many a similar window has in step.

    A window of n shingles that reaches the threshold lacks at most slack = n -
    ceil(2 t n / (1 + t)) of the item's. A word in the places 4..n-1 is in five
    shingles and q such words are in q + 4 or more, so at most slack - 4 of the
    anchors are missing or out of place by themselves; and as each break in the
    order costs five shingles, the others stand in slack // 5 + 1 runs at most,
    the largest of which has need anchors in step. An item of fewer than five
    shingles has no such place: where it may lack none, any word will do, else
    all are listed and one is needed.

    A document shorter than the item can lack more: up to n - least shingles,
    least = ceil(t n), and so n - least - 4 of such words. One anchor more than
    that is listed for it; those beyond the windows' own have in_windows false.
    """
    n = F.col("size")
    least = F.ceil(n * F.lit(threshold) - 1e-9).cast("int")
    slack = n - F.ceil(n * F.lit(2 * threshold / (1 + threshold)) - 1e-9).cast("int")
    places = F.transform("words", lambda w, i: F.struct((-F.char_length(w)).alias("short"), i.alias("offset"), F.xxhash64(w).alias("word")))
    inner = F.filter(places, lambda p: (p["offset"] >= SHINGLE - 1) & (p["offset"] < n))
    lost, runs = F.greatest(F.lit(0), F.col("slack") - (SHINGLE - 1)), F.floor(F.col("slack") / SHINGLE).cast("int") + 1
    usable = F.when(F.size(inner) > 0, inner).otherwise(places)
    own = F.when(F.size(inner) > 0, F.least(F.size(inner), lost + IN_STEP * runs)).when(F.col("slack") > 0, F.size(places)).otherwise(1)
    short = F.greatest(F.lit(0), n - least - (SHINGLE - 1)) + 1
    chosen = F.slice(F.sort_array(usable), 1, F.greatest(own, short))
    need = F.when(F.size(inner) > 0, F.greatest(F.lit(1), F.ceil((own - lost) / runs).cast("int"))).otherwise(1)
    listed = items.withColumn("slack", slack).select("item_id", "n_words", "slack", need.alias("need"), least.alias("least"), own.alias("own"), F.posexplode(chosen).alias("nth", "a"))
    return listed.select("a.word", "a.offset", "item_id", "n_words", "slack", "need", "least", (F.col("nth") < F.col("own")).alias("in_windows")).distinct()


def windows(docs: DataFrame, anchors: DataFrame) -> DataFrame:
    """doc_id, text_key, start, n_words (the item's), shingles: item-sized windows laid where enough anchors are met in step (broadcasts the anchors).

    The search explodes words and positions alone; the text of a document is
    only fetched again where it has a window. A similar window starts within
    slack of where its largest run of anchors points, so all those starts are
    laid. A document shorter than an item is one window for it on any anchor, if
    it has the least number of shingles that the threshold asks for.
    """
    held = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.xxhash64("text").alias("text_key"))
    found = held.select("doc_id", "text_key", tokens(F.col("text")).alias("words")).withColumn("length", F.size("words"))
    found = found.select("doc_id", "text_key", "length", F.posexplode("words").alias("pos", "text_word")).select("doc_id", "text_key", "length", "pos", F.xxhash64("text_word").alias("word"))
    shorter = F.col("length") < F.col("n_words")
    usable = F.when(shorter, (F.col("length") >= SHINGLE) & (F.col("length") - (SHINGLE - 1) >= F.col("least"))).otherwise(F.col("in_windows"))
    hits = found.join(F.broadcast(anchors), "word").filter(usable)
    runs = hits.groupBy("doc_id", "text_key", "length", "item_id", "n_words", "slack", "need", (F.col("pos") - F.col("offset")).alias("at")).agg(F.count("*").alias("n"))
    runs = runs.filter((F.col("n") >= F.col("need")) | shorter)
    near = runs.select("doc_id", "text_key", "length", "n_words", F.explode(F.sequence(F.col("at") - F.col("slack"), F.col("at") + F.col("slack"))).alias("at"))
    places = near.select("doc_id", "text_key", F.greatest(F.lit(0), F.least(F.col("at"), F.col("length") - F.col("n_words"))).alias("start"), "n_words").distinct()
    places = cut(places.groupBy("doc_id", "text_key").agg(F.sort_array(F.collect_list(F.struct("start", "n_words"))).alias("places")))
    many = (places.agg(F.sum(F.size("places"))).first()[0] or 0) > BROADCAST_WINDOWS
    p = (places if many else F.broadcast(places)).alias("p")
    met = held.alias("h").join(p, F.col("h.doc_id").eqNullSafe(F.col("p.doc_id")) & (F.col("h.text_key") == F.col("p.text_key"))).select("h.doc_id", "h.text_key", "text", "places")
    met = with_shingles(met.withColumn("words", tokens(F.col("text"))), "words", "own").drop("text")
    part = lambda p, o, w: F.struct(
        p["start"].alias("start"), p["n_words"].alias("n_words"),
        F.when(p["n_words"] < SHINGLE, F.array(F.xxhash64(F.slice(w, p["start"] + 1, p["n_words"])))).otherwise(F.slice(o, p["start"] + 1, F.greatest(p["n_words"] - (SHINGLE - 1), F.lit(1)))).alias("shingles"),
    )
    laid = F.transform("places", lambda p: part(p, F.col("own"), F.col("words")))
    return met.select("doc_id", "text_key", F.explode(laid).alias("w")).select("doc_id", "text_key", "w.*")


def _matches(docs: DataFrame, items: DataFrame, anchors: DataFrame, radius: int, threshold: float) -> DataFrame:
    laid = windows(docs, anchors).withColumn("fingerprint", simhash(F.col("shingles")))
    laid = laid.select("doc_id", "text_key", "start", "n_words", "shingles", "fingerprint", F.explode(blocks(F.col("fingerprint"), radius)).alias("b")).select("*", "b.block", "b.value").drop("b")
    listed = items.select("item_id", "n_words", numbered(F.col("shingles")).alias("item_shingles"), F.col("fingerprint").alias("item_fingerprint"), F.explode(blocks(F.col("fingerprint"), radius)).alias("b"))
    listed = F.broadcast(listed.select("item_id", "n_words", "item_shingles", "item_fingerprint", "b.block", "b.value"))
    differing = F.col("fingerprint").bitwiseXOR(F.col("item_fingerprint"))
    near = laid.join(listed, ["n_words", "block", "value"]).filter((F.bit_count(differing) <= radius) & (first_block(differing, radius) == F.col("block")))
    scored = near.select("doc_id", "text_key", "item_id", "start", F.explode(F.array(weighted_jaccard(numbered(F.col("shingles")), F.col("item_shingles")))).alias("similarity"))
    return scored.filter(F.col("similarity") >= threshold)


def found_in(docs: DataFrame, benchmark: DataFrame, radius: int = RADIUS, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, text_key (hash of the text), item_id, start, similarity of every similar window."""
    items = cut(benchmark_items(benchmark))
    words = items.agg(F.sum("n_words")).first()[0] or 0
    parts = max(1, -(-words // BROADCAST_ROWS))
    found = None
    for part in range(parts):
        own = items if parts == 1 else items.filter(F.pmod(F.xxhash64("item_id", "shingles"), F.lit(parts)) == part)
        matches = _matches(docs, own, anchor_words(own, threshold), radius, threshold)
        found = matches if found is None else found.unionByName(matches)
    return found


def contaminated(docs: DataFrame, benchmark: DataFrame, radius: int = RADIUS, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, item_id, similarity, start: the best window of each document and item that reach the threshold.

    start is the window's first word, the least of equally similar ones. An
    item of fewer than five words is found where its words stand in a row; null
    texts and texts and items without words match nothing. Repeated rows count
    as one document, and so do rows with a null id, an empty table on either
    side gives no rows, other columns are ignored.
    """
    found = found_in(docs, benchmark, radius, threshold)
    best = found.groupBy("doc_id", "item_id").agg(F.max(F.struct("similarity", (-F.col("start")).alias("back"))).alias("b"))
    return best.select("doc_id", "item_id", F.col("b.similarity").alias("similarity"), (-F.col("b.back")).alias("start"))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, radius: int = RADIUS, threshold: float = THRESHOLD) -> DataFrame:
    """docs without the rows whose text holds an item, those with a null id included; all columns stay as they are."""
    gone = cut(found_in(docs, benchmark, radius, threshold).select("doc_id", "text_key").distinct())
    gone = (gone if gone.count() > BROADCAST_WINDOWS else F.broadcast(gone)).select(F.col("doc_id").alias("gone_id_"), F.col("text_key").alias("gone_key_"))
    return docs.join(gone, docs["doc_id"].eqNullSafe(F.col("gone_id_")) & (F.xxhash64(docs["text"]) == F.col("gone_key_")), "left_anti")
