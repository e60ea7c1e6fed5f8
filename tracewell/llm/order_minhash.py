"""Near-duplicate documents by Order MinHash.

A document is its words; its k-mers are the runs of ``K`` words, each labelled with its occurrence. A sketch takes the ``L`` k-mers of least
hash and keeps them in text order, so it agrees for documents that are close in edits, not only in content.
Each of ``SKETCHES`` sketches is a bucket key; documents meet where one agrees. A candidate is a link if its sets of k-mers have a
Jaccard similarity of at least ``SIMILARITY``, and its words, aligned in order inside the band that this share allows, match to the same
share of the longer text.

Equal word sequences are one class from the start. In a bucket every class is first compared with one leader only, in a few rounds;
where a bucket then still spans several components, small buckets compare all pairs across components. Classes of larger ones meet by
prefix filtering, which misses no pair over the threshold: in the order of rarity, two sets so similar share one of their first
k-mers, and enough is left of both after it.
Links of thousands of near copies thus need neither all pairs nor a cap.

Sketches lose pairs of short texts: with ``L`` k-mers or fewer a sketch is all of them. So texts that may be similar to one of fewer
than ``FEW`` different k-mers meet by prefix filtering too, whatever their buckets, and so do texts that repeat themselves
(``REPEATED``), whose labelled k-mers say little of the set. A text that repeats any k-mer also has the sketches of its set,
so that it meets those that do not.

Chance to miss another pair of similarity 0.8 in all sketches, its shared k-mers in the same order: about (1 - 0.8 ** 5) ** 24, below
1 in 10,000 from ``FEW`` k-mers on (a sketch is drawn without replacement). It is higher where shared k-mers stand in another order.

Defined results: null and empty texts, and rows with a null id, are alone; texts shorter than ``K`` words have one k-mer, the whole; the class of
a document is the least id of its component; repeated rows share it; extra columns do not take part; an empty table gives an
empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewell.functions.bits import in_bitmap
from tracewell.llm.arrays import Rolling, WordHashes, mix64
from tracewell.llm.batches import for_texts, giving_back
from tracewell.llm.graph import components
from tracewell.llm.membership import BITS, bit_of, bitmap, bitmap_of_bits, may_contain
from tracewell.session import materialise

K = 5
L = 5
#: Bits of the map of rows that may go. On very large inputs it fills up; then more rows are shuffled, with the same result.
CONTESTED_BITS = 1 << 19
#: Hashes of a text that are ranked at once for several sketches; this bounds the memory beside the text.
TOGETHER = 400_000
#: Words of a text that stand more often than this have a row of bits in an alignment.
OFTEN = 64
SKETCHES = 24
SIMILARITY = 0.8
#: Rounds in which buckets are compared with one leader each. Random leaders after the central one found next to nothing.
ROUNDS = 1
#: Buckets up to this size then compare all pairs across components, larger ones go by prefixes.
SMALL_BUCKET = 8
#: Pairs of which one has fewer different k-mers are all found by prefixes.
FEW = 100
#: So are pairs of texts with this many labelled k-mers for each different one.
REPEATED = 1.1


def kmers(items: np.ndarray, rolling: Rolling) -> np.ndarray:
    """Hashes of the runs of ``K`` words in order; of the whole where it is shorter."""
    if len(items) >= rolling.k:
        return rolling(items)
    return Rolling(len(items))(items) if len(items) else np.empty(0, np.uint64)


def labelled_kmers(found: np.ndarray) -> np.ndarray:
    """k-mer hashes with their occurrence mixed in."""
    order = np.argsort(found, kind="stable")
    same = found[order]
    first = np.concatenate([[True], same[1:] != same[:-1]])
    place = np.arange(len(found))
    label = np.empty(len(found), np.uint64)
    label[order] = place - np.maximum.accumulate(np.where(first, place, 0))
    return mix64(found + label * np.uint64(0x9E3779B97F4A7C15))


_SEEDS = mix64(np.arange(1, SKETCHES + 1, dtype=np.uint64) * np.uint64(0xD1B54A32D192ED03))


def sketches(found: np.ndarray) -> np.ndarray:
    """One bucket key for each sketch."""
    return _sketches_of(labelled_kmers(found))


def bucket_keys(found: np.ndarray) -> tuple[np.ndarray, int]:
    """The keys of all sketches of a text, those of its set included where it repeats a k-mer; how many k-mers differ."""
    different, first = np.unique(found, return_index=True)
    keys = sketches(found)
    if len(different) < len(found):
        keys = np.unique(np.concatenate([keys, sketches(found[np.sort(first)])]))
    return keys, len(different)


def _sketches_of(x: np.ndarray) -> np.ndarray:
    keys = np.empty(SKETCHES, np.uint64)
    step = max(1, TOGETHER // len(x))
    for s in range(0, SKETCHES, step):
        seeds = _SEEDS[s : s + step]
        if len(x) > L:
            least = np.argpartition(mix64(x[None, :] ^ seeds[:, None]), L - 1, axis=1)[:, :L]
            chosen = x[np.sort(least, axis=1)]
        else:
            chosen = np.broadcast_to(x, (len(seeds), len(x)))
        key = seeds.copy()
        for j in range(chosen.shape[1]):
            key = mix64(key * np.uint64(0x100000001B3) + chosen[:, j])
        keys[s : s + step] = key
    return keys


def _key(words: list[bytes]) -> int:
    return int.from_bytes(hashlib.blake2b(b" ".join(words), digest_size=8).digest(), "little", signed=True)


def _sketched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    hashes, rolling = WordHashes(), Rolling(K)
    for batch in batches:
        keys, buckets, few, repeats = [], [], [], []
        for body in batch.column("body"):
            words = body.as_py().split()
            keys.append(_key(words) if words else None)
            found = kmers(hashes.of(words), rolling) if words else np.empty(0, np.uint64)
            own, different = bucket_keys(found) if words else (found, 0)
            buckets.append(own.view(np.int64))
            few.append(SIMILARITY * different < FEW)
            repeats.append(len(found) >= REPEATED * different)
        columns = [batch.column("doc_id"), batch.column("text_hash"), pa.array(keys, pa.int64()), pa.array(buckets, pa.list_(pa.int64())),
                   pa.array(few, pa.bool_()), pa.array(repeats, pa.bool_())]
        yield pa.RecordBatch.from_arrays(columns, ["doc_id", "text_hash", "key", "buckets", "few", "repeats"])


def _needed_words(bits: bytes, bit_hash):
    """key and words (32-bit hashes) of documents that have candidates."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in batches:
            keys, found = [], []
            for body in batch.column("body"):  # one document's words at a time
                words = body.as_py().split()
                key = _key(words) if words else 0
                if words and may_contain(bits, bit_hash(np.array([key])))[0]:
                    keys.append(key)
                    found.append((hashes.of(words) & np.uint64(0xFFFFFFFF)).astype(np.uint32).tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(found, pa.binary())], ["key", "words"])

    return run


def _bit(keys: np.ndarray) -> np.ndarray:
    """The bit of a key: keys are hashes already."""
    return keys & (BITS - 1)


def words_of(binary: bytes) -> np.ndarray:
    return mix64(np.frombuffer(binary, np.uint32).astype(np.uint64) + np.uint64(1))


def similar_sets(a: np.ndarray, b: np.ndarray, share: float = SIMILARITY) -> bool:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both >= share * (len(a) + len(b) - both) - 1e-9


def _bits(places: list[int], n: int) -> int:
    row = np.zeros(n, np.uint8)
    row[places] = 1
    return int.from_bytes(np.packbits(row, bitorder="little").tobytes(), "little")


def aligned(a: np.ndarray, b: np.ndarray, share: float = SIMILARITY) -> bool:
    """Whether words in common order reach ``share`` of the longer text.

    Equal ends are cut off first. The rest is a longest common subsequence by bit rows, matches restricted to the band of
    diagonals that a share this high can reach.
    """
    n = min(len(a), len(b))
    longest = max(len(a), len(b))
    need = int(np.ceil(share * longest - 1e-9))
    if n < need:
        return False
    differ = np.flatnonzero(a[:n] != b[:n])
    head = int(differ[0]) if len(differ) else n
    rest = n - head
    differ = np.flatnonzero(a[len(a) - rest :][::-1] != b[len(b) - rest :][::-1])
    tail = int(differ[0]) if len(differ) else rest
    if head + tail >= need:
        return True
    a, b = a[head : len(a) - tail].tolist(), b[head : len(b) - tail].tolist()
    width = longest - need
    places: dict[int, list[int]] = {}
    for i, x in enumerate(a):
        places.setdefault(x, []).append(i)
    # Only words that stand often have a row of bits of their own, so that at most 1000 rows are held whatever the length.
    often = max(OFTEN, len(a) // 1000)
    masks = {x: _bits(own, len(a)) for x, own in places.items() if len(own) > often}
    full = (1 << len(a)) - 1
    band = (1 << (2 * width + 1)) - 1
    open_ = full
    for j, y in enumerate(b):
        if y in masks:
            m = masks[y] & (band << (j - width) if j >= width else band >> (width - j))
        else:
            m = 0
            for i in places.get(y, ()):
                if abs(i - j) <= width:
                    m |= 1 << i
        if m:
            hit = open_ & m
            open_ = ((open_ + hit) | (open_ - hit)) & full
    return head + tail + len(a) - open_.bit_count() >= need


def _verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    rolling = Rolling(K)
    for batch in batches:
        good = []
        for x, y in zip(batch.column("words_a"), batch.column("words_b"), strict=True):
            a, b = words_of(x.as_py()), words_of(y.as_py())
            short, long = sorted((len(a), len(b)))
            # A set of k-mers may be small in a long text that repeats itself: lengths decide in the alignment.
            good.append(
                short >= SIMILARITY * long - 1
                and similar_sets(np.unique(kmers(a, rolling)), np.unique(kmers(b, rolling)))
                and aligned(a, b)
            )
        yield batch.select(["a", "b"]).filter(pa.array(good, pa.bool_()))


def _exploded_kmers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    rolling = Rolling(K)
    for batch in batches:
        sets = [np.unique(kmers(words_of(x.as_py()), rolling)).view(np.int64) for x in batch.column("words")]
        columns = [batch.column("key"), batch.column("comp"), pa.array(sets, pa.list_(pa.int64()))]
        yield pa.RecordBatch.from_arrays(columns, ["key", "comp", "kmers"])


def _prefix_pairs(docs: DataFrame, by_size: bool = False) -> DataFrame:
    """a, b: all pairs across components of ``docs`` (key, comp, words) that may reach the similarity.

    ``by_size`` is for small sets: they also join on both sizes, which leaves out sizes whose overlap a prefix cannot reach.
    """
    sets = materialise(docs.mapInArrow(_exploded_kmers, "key long, comp long, kmers array<long>"), "omh-sets")
    # Documents are dealt out evenly before each becomes many rows.
    each = sets.repartition("key").select("key", F.explode("kmers").alias("k"))
    # A k-mer of one document only can make no pair, but it takes its place in the prefix.
    common = each.groupBy("k").agg(F.count("*").alias("f")).where("f > 1")
    ranked = each.join(common, "k").groupBy("key").agg(F.sort_array(F.collect_list(F.struct("f", "k"))).alias("common"))
    n = F.size("kmers")
    # The most that the k-mers from a place on can share must reach the overlap that the similarity asks for.
    prefix = n - F.ceil(F.lit(SIMILARITY) * n - 1e-9) + 1
    alone = n - F.size("common")
    left = F.greatest(prefix - alone, F.lit(0)).cast("int")
    rare = sets.join(ranked, "key").select(
        "key", "comp", n.alias("n"), alone.alias("alone"), F.posexplode(F.slice("common", F.lit(1), left)).alias("i", "p")
    )
    rare = materialise(rare.select("key", "comp", "n", (F.col("n") - F.col("alone") - F.col("i")).alias("left"), F.col("p.k").alias("k")),
                       "omh-prefixes")
    if by_size:
        return _pairs_by_size(rare)
    other = rare.select(F.col("key").alias("b"), F.col("comp").alias("comp_b"), F.col("n").alias("n_b"), F.col("left").alias("left_b"), "k")
    # The first k-mer that two sets share bounds their overlap by what is left of either.
    overlap = F.lit(SIMILARITY / (1 + SIMILARITY)) * (F.col("n") + F.col("n_b")) - 1e-6
    pairs = rare.withColumnRenamed("key", "a").join(other, "k").where("a < b AND comp <> comp_b")
    return pairs.where(F.least("left", "left_b") >= overlap).select("a", "b").distinct()


def _pairs_by_size(rare: DataFrame) -> DataFrame:
    """a, b from prefixes (key, comp, n, left, k): the smaller set names the sizes it may meet, the larger one likewise."""
    n = F.col("n")
    most = F.least(n / SIMILARITY + 1e-9, F.col("left") * ((1 + SIMILARITY) / SIMILARITY) - n + 1e-6)
    sized = rare.withColumn("most", F.floor(most).cast("int")).withColumn("least", F.ceil(SIMILARITY * n - 1e-9).cast("int"))
    small = sized.where("most >= n").select("key", "comp", "k", "n", F.explode(F.sequence("n", "most")).alias("m"))
    large = sized.where("most >= least").select(
        F.col("key").alias("b"), F.col("comp").alias("comp_b"), "k", n.alias("m"),
        F.explode(F.sequence("least", F.least("n", "most"))).alias("n"),
    )
    pairs = small.join(large, ["k", "n", "m"]).where("comp <> comp_b AND (n < m OR key < b)")
    return pairs.select(F.least("key", "b").alias("a"), F.greatest("key", "b").alias("b")).distinct()


def _linked(members: DataFrame, words: DataFrame, exact: DataFrame) -> DataFrame:
    """node, root over all links between ``members`` (bucket, key, n) of one bucket and between ``exact`` (key, few, repeats).

    The first round compares each bucket with its most central class, the one with most company in all its buckets. Later
    ones take leaders at random, for buckets that still span several components. Work in a round is linear in the members.
    """
    central = members.groupBy("key").agg(F.sum("n").alias("central"))
    members = materialise(members.join(central, "key"), "omh-central")
    open_, by_prefix = members.withColumn("comp", F.col("key")), exact.withColumn("comp", F.col("key"))
    links = tested = None
    for turn in range(ROUNDS + 1):
        if turn < ROUNDS:
            pairs = _with_leader(open_, F.col("central") if turn == 0 else F.xxhash64("key", F.lit(turn)))
        else:
            pairs = _rest(open_, words, by_prefix)
        if tested is not None:
            pairs = pairs.join(tested, ["a", "b"], "left_anti")
        pairs = materialise(pairs, "omh-pairs")
        found = materialise(_links(pairs, words), "omh-links")
        links = found if links is None else links.unionByName(found)
        tested = pairs if tested is None else tested.unionByName(pairs)
        roots = components(links)
        if turn == ROUNDS:
            break
        by_prefix = exact.join(roots.withColumnRenamed("node", "key"), "key", "left").withColumn("comp", F.coalesce("root", "key"))
        comp = members.join(roots.withColumnRenamed("node", "key"), "key", "left")
        comp = materialise(comp.select("bucket", "key", "n", "central", F.coalesce("root", "key").alias("comp")), "omh-comp")
        split = comp.groupBy("bucket").agg(
            F.min("comp").alias("c0"), F.max("comp").alias("c1"), F.first("n").alias("n")
        )
        split = split.where("c0 <> c1 AND n > 2")
        open_ = materialise(comp.join(split.select("bucket"), "bucket", "left_semi"), "omh-open")
        if open_.isEmpty() and exact.isEmpty():
            break
    return roots


def _with_leader(open_: DataFrame, rank: Column) -> DataFrame:
    """a, b: the leader of each bucket with every member of another component."""
    top = open_.groupBy("bucket").agg(F.max(F.struct(rank.alias("rank"), "key", "comp")).alias("top"))
    pairs = open_.join(top, "bucket").where(F.col("comp") != F.col("top.comp"))
    return pairs.select(F.least("key", "top.key").alias("a"), F.greatest("key", "top.key").alias("b")).distinct()


def _rest(open_: DataFrame, words: DataFrame, by_prefix: DataFrame) -> DataFrame:
    """a, b: all pairs across components that may be links, within small buckets, and by prefixes among members of large ones
    and texts that repeat themselves, and among texts of few k-mers."""
    small = open_.where(F.col("n") <= SMALL_BUCKET)
    other = small.select("bucket", F.col("key").alias("b"), F.col("comp").alias("comp_b"))
    pairs = small.join(other, "bucket").where("key < b AND comp <> comp_b").select(F.col("key").alias("a"), "b")
    large = open_.where(F.col("n") > SMALL_BUCKET).select("key", "comp")
    large = large.unionByName(by_prefix.where("repeats").select("key", "comp")).distinct().join(words, "key")
    few = by_prefix.where("few").select("key", "comp").join(words, "key")
    return pairs.unionByName(_prefix_pairs(large)).unionByName(_prefix_pairs(few, by_size=True)).distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, key (hash of the word sequence, null where there are no words), class_id, kept of every row."""
    return _classed(docs, id_col, text_col).select("doc_id", "key", "class_id", "kept")


def _body(text_col: str) -> Column:
    return F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary")


def _classed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The same with root, which tells classes apart where rows of several repeat one id, and the hash of the text."""
    rows = for_texts(docs).select(F.col(id_col).cast("long").alias("doc_id"), _body(text_col).alias("body"))
    hashed = rows.withColumn("text_hash", F.xxhash64("body"))
    schema = "doc_id long, text_hash long, key long, buckets array<long>, few boolean, repeats boolean"
    sketched = hashed.mapInArrow(giving_back(_sketched), schema)
    sketched = materialise(sketched, "omh-sketches")
    linkable = sketched.where("doc_id IS NOT NULL AND key IS NOT NULL")
    classes = linkable.groupBy("key").agg(
        F.min("doc_id").alias("least"), *(F.first(c).alias(c) for c in ("buckets", "few", "repeats"))
    )
    classes = materialise(classes, "omh-classes")
    each = classes.select("key", F.explode(F.array_distinct("buckets")).alias("bucket"))
    shared = each.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1")
    members = materialise(each.join(shared, "bucket"), "omh-members")
    exact = classes.where("few OR repeats").select("key", "few", "repeats")
    # Only words of classes that share a bucket or meet by prefixes are read again.
    needed = members.select("key").unionByName(exact.select("key"))
    ends = needed.select(F.col("key").bitwiseAND(BITS - 1).cast("int").alias("bit"))
    words = rows.where("doc_id IS NOT NULL").mapInArrow(giving_back(_needed_words(bitmap_of_bits(ends), _bit)), "key long, words binary")
    words = words.join(needed.distinct(), "key", "left_semi")
    words = materialise(words.groupBy("key").agg(F.first("words").alias("words")), "omh-words")
    roots = _linked(members, words, exact)
    rooted = classes.select("key", "least").join(roots.withColumnRenamed("node", "key"), "key", "left")
    rooted = rooted.withColumn("root", F.coalesce("root", "key"))
    ids = rooted.groupBy("root").agg(F.min("least").alias("class_id"))
    of_key = rooted.join(ids, "root").select("key", "root", "class_id")
    found = linkable.select("doc_id", "text_hash", "key").join(of_key, "key")
    found = found.select("doc_id", "text_hash", "key", "root", "class_id")
    alone = sketched.where("doc_id IS NULL OR key IS NULL").select(
        "doc_id", "text_hash", "key", F.lit(None).cast("long").alias("root"), F.col("doc_id").alias("class_id")
    )
    return found.unionByName(alone).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("class_id")))


def _links(pairs: DataFrame, words: DataFrame) -> DataFrame:
    first = words.select(F.col("key").alias("a"), F.col("words").alias("words_a"))
    second = words.select(F.col("key").alias("b"), F.col("words").alias("words_b"))
    return pairs.join(first, "a").join(second, "b").select("a", "b", "words_a", "words_b").mapInArrow(giving_back(_verified), "a long, b long")


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The input rows that stay: all that are alone, and of each class the row with the least id (one of repeated rows)."""
    found = materialise(_classed(docs, id_col, text_col).where("key IS NOT NULL AND doc_id IS NOT NULL"), "omh-classed")
    kept = found.where("kept").groupBy("root").agg(F.min(F.struct("doc_id", "text_hash")).alias("one")).select("one.*")
    kept = materialise(kept, "omh-kept")
    # Of these some rows go: others of a class, and repeated ones. All other texts stay where they are read.
    rows_of = found.groupBy("doc_id", "text_hash").agg(F.count("*").alias("n"))
    contested = rows_of.join(kept.withColumn("one", F.lit(True)), ["doc_id", "text_hash"], "left").where("n > 1 OR one IS NULL")
    bits = bitmap(contested, "doc_id", "text_hash", bits=CONTESTED_BITS)
    rows = docs.select(
        F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(_body(text_col)).alias("text_hash"), F.struct("*").alias("row")
    )
    maybe = in_bitmap(bits, bit_of("doc_id", "text_hash", bits=CONTESTED_BITS))
    blank = F.col("doc_id").isNull() | ~F.col("row")[text_col].cast("string").rlike("[^\\x20\\x09-\\x0D]")
    blank = F.coalesce(blank, F.lit(True))
    sure = rows.where(blank | ~maybe).select("row")
    worded = rows.where(~blank & maybe)
    # Rows that repeat one id are told apart by their text; equal ones become one.
    texts = worded.join(kept, ["doc_id", "text_hash"], "left_semi").groupBy("doc_id", "text_hash").agg(F.first("row").alias("row"))
    return texts.select("row").unionByName(sure).select(*(F.col("row")[c].alias(c) for c in docs.columns))

