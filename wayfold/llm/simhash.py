"""SimHash fingerprints and near-duplicate groups by multi-index hashing.

Fingerprints are 64 bits wide. Two fingerprints that differ in at most ``RADIUS`` = 4 bits
agree up to one bit in at least one of three segments (21, 21 and 22 bits), so each
fingerprint looks up, for each segment, its own value and the values one bit away. Of two
values one bit apart exactly one has the zero, so only zero bits are flipped: half a
Hamming ball finds every pair. Complete distances are verified inside the join, so that
what leaves it are true links only.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import connected, cut, release, sized
from .fingerprint import with_shingles

SEED = 42
RADIUS = 4
#: (shift, width) of the segments.
SEGMENTS = ((0, 21), (21, 21), (42, 22))
#: Representatives of a segment value that every holder of that value is compared with first.
PIVOTS = 4
#: Near copies share this much of their word shingles of this size.
SIMILARITY = 0.8
SHINGLE = 5
#: Bands of so many minima each over a text's shingles; texts of SIMILARITY share LEAST_BANDS of them but for 2 pairs in 10^6.
BANDS = 40
BAND_ROWS = 5
LEAST_BANDS = 2
#: Bands by which a text is first compared with the central text that has them; the others are asked only where these left two texts apart.
FIRST_BANDS = 2
#: Buckets of a text's shingles that bound from above what two texts share, before a pair is made.
SIGNATURE_BITS = 1024
#: Value of ``seg`` of an index row that holds a band.
_BAND = len(SEGMENTS)
_WORD = re.compile(r"\w+")

_XOR, _MUL, _MIX = np.random.default_rng(SEED).integers(0, 1 << 64, (3, BANDS * BAND_ROWS), np.uint64)
_MUL, _MIX = _MUL | np.uint64(1), _MIX | np.uint64(1)

_BITS = ((np.arange(256)[:, None] >> np.arange(8)[None, :]) & 1).astype(np.int64)


def fingerprint(text: str | None, words: int = 4) -> int:
    """The unsigned 64-bit SimHash of a text.

    A-Z are lower-cased and words are runs of anything but ASCII white space. A text with
    fewer words than a shingle is one shingle; a null, empty or blank text gives zero.
    """
    tokens = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not tokens:
        return 0
    joined = b" ".join(tokens)
    n = len(tokens) - words + 1
    if n <= 1:
        hashes = [xxhash.xxh64_intdigest(joined, SEED)]
    else:
        gaps = np.flatnonzero(np.frombuffer(joined, np.uint8) == 32)
        starts = np.concatenate(([0], gaps + 1))[:n].tolist()
        ends = np.concatenate((gaps, [len(joined)]))[words - 1 :].tolist()
        digest = xxhash.xxh64_intdigest
        hashes = [digest(joined[s:e], SEED) for s, e in zip(starts, ends, strict=True)]
    return _majority(hashes)


def _majority(hashes: list[int]) -> int:
    """The bits that are set in over half of the hashes."""
    columns = np.array(hashes, np.uint64).view(np.uint8).reshape(-1, 8)
    counts = np.concatenate([np.bincount(columns[:, k], minlength=256) @ _BITS for k in range(8)])
    return int(np.packbits(2 * counts > len(hashes), bitorder="little").view(np.uint64)[0])


def with_fingerprint(docs: DataFrame, words: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (doc_id, fp): the fingerprint as a signed long. One row for each row of ``docs``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.array([fingerprint(x.as_py(), words) for x in batch.column(1)], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps.view(np.int64))], names=["doc_id", "fp"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, fp long")


def _segments(fp: Column) -> Column:
    return F.array(*[F.struct(F.lit(i).alias("seg"), F.shiftrightunsigned(fp, s).bitwiseAND(F.lit((1 << w) - 1)).alias("key"), F.lit(w).alias("width")) for i, (s, w) in enumerate(SEGMENTS)])


def _index(nodes: DataFrame) -> DataFrame:
    """Nodes with each of their segment values, and of their ``bands`` if they have any: seg, key, width (0: no ball)."""
    keys = _segments(F.col("fp"))
    if "bands" in nodes.columns:
        keys = F.concat(keys, F.transform("bands", lambda b: F.struct(F.lit(_BAND).alias("seg"), b.alias("key"), F.lit(0).alias("width"))))
    return nodes.select("*", F.explode(keys).alias("__s")).select("*", "__s.seg", "__s.key", "__s.width").drop("__s", "bands")


def _probes(index: DataFrame, half: bool, banded: bool = False) -> DataFrame:
    """Index rows with ``own`` and, as key, each value of the ball of radius one around it; of half a ball those that set a bit."""
    bits = F.transform(F.sequence(F.lit(0), F.col("width") - 1), lambda j: F.call_function("shiftleft", F.lit(1).cast("long"), j))
    set_ = F.filter(F.transform(bits, lambda b: F.col("key").bitwiseOR(b)), lambda x: x != F.col("key"))
    ball = set_ if half else F.transform(bits, lambda b: F.col("key").bitwiseXOR(b))
    if banded:
        ball = F.when(F.col("width") > 0, ball).otherwise(F.array().cast("array<long>"))
    return index.withColumn("own", F.col("key")).withColumn("key", F.explode(F.concat(F.array("own"), ball))).drop("width")


def _sides(probes: DataFrame, others: DataFrame) -> tuple[DataFrame, DataFrame]:
    return probes.select([F.col(c).alias(f"a_{c}") for c in probes.columns]), others.select([F.col(c).alias(f"b_{c}") for c in others.columns])


def _found(radius: int, banded: bool = False) -> Column:
    """Condition of the search: an equal band, or equal segment values and complete distances within the radius.

    A pair within the radius counts in the first of its segments that are one bit apart or less, and in no band, so it is made once.
    """
    same = (F.col("a_seg") == F.col("b_seg")) & (F.col("a_key") == F.col("b_key")) & (F.col("a_id") != F.col("b_id"))
    apart = F.col("a_fp").bitwiseXOR(F.col("b_fp"))
    near = F.bit_count(apart) <= radius
    first = F.lit(True)
    for i, (shift, width) in enumerate(SEGMENTS[:-1]):
        first &= (F.col("a_seg") <= i) | (F.bit_count(F.shiftrightunsigned(apart, shift).bitwiseAND(F.lit((1 << width) - 1))) > 1)
    return same & (((F.col("a_seg") == _BAND) & ~near) | ((F.col("a_seg") != _BAND) & near & first) if banded else near & first)


def _pairs(joined: DataFrame) -> DataFrame:
    return joined.select(F.greatest("a_id", "b_id").alias("a"), F.least("a_id", "b_id").alias("b")).distinct()


def links(nodes: DataFrame, radius: int = RADIUS, central: Column | None = None, bound: Column | None = None, verify: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """Links that join all pairs of nodes whose fingerprints differ in ``radius`` or fewer bits.

    ``nodes`` has distinct ``id`` and their ``fp``, none null. Rows (a, b: ids), enough to
    connect whatever is linked, not every pair: first each node is compared with up to
    ``PIVOTS`` holders of each segment value near its own, the least by ``central``; the
    components that gives are then joined by the complete search, which skips pairs already
    in one component. A dense group of n nodes so leaves about n links, not n squared.

    Nodes with an array ``bands`` are also compared where they share one of its values,
    whatever their distance: first by few of them, then, with the central holder of each,
    where that left them in different components.

    ``bound`` is a condition on columns of nodes, named a_ and b_, that every link meets, and
    ``verify`` keeps of candidate rows those that are links.
    """
    if radius // len(SEGMENTS) > 1:
        raise ValueError("three segments find up to 5 differing bits")
    banded = "bands" in nodes.columns
    found = _found(radius, banded) & bound if bound is not None else _found(radius, banded)
    checked = (lambda pairs, name: cut(verify(cut(pairs, f"{name}-pairs")), name)) if verify else cut
    index = _index(nodes)
    order = [central] if central is not None else []
    fields = [c for c in nodes.columns if c != "bands"]
    ranked = lambda i: F.struct(*[o.alias(f"o{k}") for k, o in enumerate(order)], F.xxhash64(F.lit(i), "id").alias("h"), *fields)
    salts = range(PIVOTS) if central is None else [0]
    pivots = index.groupBy("seg", "key").agg(*[F.min(ranked(i)).alias(f"p{i}") for i in salts], F.count("*").alias("n"))
    kept = F.array_distinct(F.transform(F.array(*[f"p{i}" for i in salts]), lambda p: F.struct(*[p[c].alias(c) for c in fields])))
    crowded = cut(pivots.where("n > 1").select("seg", "key", F.explode(kept).alias("p")).select("seg", "key", "p.*"), "pivots")
    few = _index(nodes.withColumn("bands", F.slice("bands", 1, FIRST_BANDS))) if banded else index
    left, right = _sides(_probes(few, False, banded) if central is not None else few.drop("width"), crowded)
    first = checked(_pairs(left.join(right, found)), "pivot-links")
    if banded:
        roots = cut(connected(first).withColumnRenamed("node", "id"), "first-roots")
        rooted = lambda df: df.join(roots, "id", "left").withColumn("root", F.coalesce("root", "id"))
        left, right = _sides(_index(rooted(nodes)).where(F.col("seg") == _BAND).drop("width"), rooted(crowded.where(F.col("seg") == _BAND)))
        first = first.unionByName(checked(_pairs(left.join(right, found & (F.col("a_root") != F.col("b_root")))), "band-links"))
    root = connected(first)
    known = cut(nodes.join(root.withColumnRenamed("node", "id"), "id", "left").withColumn("root", F.coalesce("root", "id")), "pivot-roots")
    index = _index(known)
    left, right = _sides(_probes(index, True, banded), index.drop("width"))
    rest = left.join(right, found & (F.col("a_root") != F.col("b_root")) & ((F.col("a_own") != F.col("a_key")) | (F.col("a_id") < F.col("b_id"))))
    return first.unionByName(checked(_pairs(rest), "rest-links"))


def with_neighbours(nodes: DataFrame, radius: int) -> DataFrame:
    """Rows (id) of nodes that have another within the radius: semi-joins both ways, as half balls find a pair from one side."""
    index = _index(nodes)
    left, right = _sides(_probes(index, True), index.drop("width"))
    ids = left.join(right, _found(radius), "left_semi").select(F.col("a_id").alias("id"))
    return ids.unionByName(right.join(left, _found(radius), "left_semi").select(F.col("b_id").alias("id"))).distinct()


def near_groups(docs: DataFrame, words: int = 4, radius: int = RADIUS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (doc_id, fp, component_id), one for each row of ``docs``.

    component_id is the smallest doc_id reachable over links of ``radius`` or fewer bits,
    the row's own included; it is null only where no row of the component has a doc_id.
    Equal fingerprints are merged before any search, so copies never form pairs. An empty
    table gives an empty result; repeated rows keep their rows.
    """
    marked = cut(with_fingerprint(docs, words, id_col, text_col), "fingerprints")
    fps = cut(marked.groupBy("fp").agg(F.min("doc_id").alias("least_id")), "distinct-fingerprints")
    roots = connected(links(fps.select(F.col("fp").alias("id"), "fp"), radius)).withColumnRenamed("node", "fp")
    rooted = fps.join(roots, "fp", "left").select("fp", "least_id", F.coalesce("root", "fp").alias("root"))
    least = rooted.groupBy("root").agg(F.min("least_id").alias("component_id"))
    of = cut(rooted.join(least, "root").select("fp", "component_id"), "components")
    return marked.join(of, "fp").select("doc_id", "fp", "component_id")


def word_fingerprint(text: str | None) -> int | None:
    """The unsigned SimHash of a text's set of words (letters and digits, lower-case); null without any.

    Copies that differ in a few words share most of this set, so they stay within a few bits
    of each other where fingerprints of shingles, of which each changed word spoils several,
    do not.
    """
    words = set(_WORD.findall((text or "").lower()))
    if not words:
        return None
    hashes = [xxhash.xxh64_intdigest(w.encode("utf-8", "surrogatepass"), SEED) for w in words]
    return _majority(hashes)


def bands(hashes: np.ndarray) -> np.ndarray:
    """BANDS values (signed) of a text's shingle hashes, each of BAND_ROWS minima; none without hashes.

    Two texts share a band with the probability J ** BAND_ROWS, J the Jaccard likeness of
    their hashes: they share none with (1 - 0.8 ** 5) ** 40, about 1e-7, at a J of 0.8, and
    one of a J of 0.3 is shared by one pair in ten.
    """
    if not len(hashes):
        return np.zeros(0, np.int64)
    least = np.full(len(_XOR), np.iinfo(np.uint64).max, np.uint64)
    for k in range(0, len(hashes), 2048):
        np.minimum(least, ((hashes[k : k + 2048, None] ^ _XOR) * _MUL).min(axis=0), out=least)
    mixed = (least ^ (least >> np.uint64(32))) * _MIX
    return mixed.reshape(BANDS, BAND_ROWS).sum(axis=1, dtype=np.uint64).view(np.int64)


def signature(hashes: np.ndarray) -> np.ndarray:
    """SIGNATURE_BITS bits as signed longs: which of so many buckets a text's shingles fall into."""
    bits = np.zeros(SIGNATURE_BITS, np.uint8)
    bits[(hashes % np.uint64(SIGNATURE_BITS)).astype(np.int64)] = 1
    return np.packbits(bits, bitorder="little").view(np.int64)


def most_shared() -> Column:
    """At most so many shingles do texts a and b share: a bucket that only one of them uses has a shingle that the other lacks."""
    words = range(SIGNATURE_BITS // 64)
    only = lambda x, y: sum((F.bit_count(F.get(F.col(x), F.lit(i)).bitwiseAND(F.bitwise_not(F.get(F.col(y), F.lit(i))))) for i in words), F.lit(0))
    return F.least(F.col("a_n") - only("a_sig", "b_sig"), F.col("b_n") - only("b_sig", "a_sig"), "a_common", "b_common")


def with_common_bands(nodes: DataFrame, least: int = LEAST_BANDS) -> DataFrame:
    """Rows (id) of nodes (id, bands) of whose bands so many are also another's. No pairs are made."""
    each = nodes.select("id", F.explode("bands").alias("key"))
    common = each.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    return each.join(common, "key", "left_semi").groupBy("id").agg(F.count("*").alias("n")).where(F.col("n") >= least).select("id")


def _text_keys(text: Column) -> list[Column]:
    """Two hashes that together stand for a text: 128 bits, so that no two texts of a corpus share them."""
    return [F.xxhash64(text).alias("t1"), F.xxhash64(F.lit(SEED), text).alias("t2")]


def near_copies(docs: DataFrame, similarity: float = SIMILARITY, words: int = SHINGLE) -> DataFrame:
    """Rows (t1, t2, least_id, n, component_id, kept): the distinct texts of ``docs`` (doc_id, text) and their groups.

    t1 and t2 are the hashes of a text, least_id and n the least doc_id and the number of
    its rows, component_id the least doc_id of its group, and kept tells the one text of the
    group that has it. Candidates are texts whose word fingerprints differ in at most five
    bits, and texts that share bands of minima of their shingles, which finds cut, extended
    and heavily edited copies as well; linked are those of them whose sets of word shingles
    have the Jaccard ``similarity`` or more, exactly. Texts too many of whose shingles are
    theirs alone are left out before any pair is made, pairs whose shingles can't overlap enough
    (``most_shared``) are not made, and the most ordinary text of each
    segment value is compared with first: it is the one that the others are copies of. A
    text without words is grouped with its equals only; null counts as empty. Of a group
    without any doc_id the text of the least hash is kept.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for whole in batches:
            for k in range(0, len(whole), 256):
                batch = whole.slice(k, 256)
                fps = [word_fingerprint(x.as_py()) for x in batch.column(3)]
                signed = pa.array([None if f is None else f - (1 << 64) * (f >> 63) for f in fps], pa.int64())
                ends = batch.column(4).offsets.to_pylist()
                hashes = batch.column(4).values.to_numpy().view(np.uint64)
                each = [bands(hashes[a:b]) for a, b in zip(ends[:-1], ends[1:], strict=True)]
                of = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, each)]), pa.int32()), pa.array(np.concatenate([np.zeros(0, np.int64), *each])))
                marks = pa.array([signature(hashes[a:b]) for a, b in zip(ends[:-1], ends[1:], strict=True)], pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([*batch.columns[:3], signed, of, marks], names=["doc_id", "t1", "t2", "fp", "bands", "sig"])

    text = F.coalesce(F.col("text"), F.lit(""))
    hashed = with_shingles(docs.select(F.col("doc_id").cast("long").alias("doc_id"), *_text_keys(text), text.alias("text")), "text", "s", words)
    marked = hashed.select("doc_id", "t1", "t2", "text", "s").mapInArrow(run, "doc_id long, t1 long, t2 long, fp long, bands array<long>, sig array<long>")
    nodes = marked.groupBy("t1", "t2").agg(F.min("doc_id").alias("least_id"), F.count("*").alias("n"), F.min("fp").alias("fp"), F.first("bands").alias("bands"), F.first("sig").alias("sig"))
    nodes = cut(nodes.withColumn("id", F.monotonically_increasing_id()), "distinct-texts")
    searched = nodes.where("fp IS NOT NULL").select("id", "fp", "bands", "sig")
    near = with_neighbours(searched.select("id", "fp"), 5).unionByName(with_common_bands(searched)).distinct()
    close = sized(cut(nodes.select("t1", "t2", "id").join(near, "id", "left_semi"), "close-texts"))
    texts = docs.select(*_text_keys(text), "text").join(close, ["t1", "t2"]).dropDuplicates(["id"])
    sets = cut(with_shingles(texts, "text", "s", words).select("id", "s"), "shingle-sets")
    # Shingles that no other of these texts has are in no intersection: what is left bounds the likeness from above.
    lone = sets.select("id", F.explode(F.filter("s", lambda h: h.isNotNull())).alias("h")).groupBy("h").agg(F.count("*").alias("n"), F.min("id").alias("id")).where("n = 1")
    lone = lone.groupBy("id").agg(F.count("*").alias("lone"))
    sizes = sets.select("id", F.size("s").alias("n")).join(lone, "id", "left").select("id", "n", (F.col("n") - F.coalesce("lone", F.lit(0))).alias("common"))
    able = cut(searched.join(sizes.where(F.col("common") >= similarity * F.col("n")), "id"), "able-texts")
    bound = most_shared() * (1 + similarity) >= similarity * (F.col("a_n") + F.col("b_n"))

    def verify(pairs: DataFrame) -> DataFrame:
        both = pairs.join(sets.select(F.col("id").alias("a"), F.col("s").alias("sa")), "a").join(sets.select(F.col("id").alias("b"), F.col("s").alias("sb")), "b")
        shared = F.size(F.array_intersect("sa", "sb"))
        return both.where(shared >= similarity * (F.size("sa") + F.size("sb") - shared)).select("a", "b")

    found = links(able, 5, F.lit(1) - F.col("common") / F.col("n"), bound, verify)
    roots = connected(found).withColumnRenamed("node", "id")
    rooted = nodes.join(roots, "id", "left").select("t1", "t2", "id", "least_id", "n", F.coalesce("root", "id").alias("root"))
    first = F.struct(F.col("least_id").isNull().alias("none"), "least_id", "t1", "t2", "id")
    least = rooted.groupBy("root").agg(F.min(first).alias("first"))
    return rooted.join(least, "root").select("t1", "t2", "least_id", "n", F.col("first.least_id").alias("component_id"), (F.col("id") == F.col("first.id")).alias("kept"))


def keep_one(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """``docs``, all columns, with one document of each group of near copies: that of the least doc_id.

    Of several rows with that doc_id and text one is kept. Where no row of a group has a
    doc_id, one row without is kept. An empty table stays empty.
    """
    of = cut(near_copies(docs, similarity), "copies")
    key = [c.alias(f"__{k}") for c, k in zip(_text_keys(F.coalesce(F.col("text"), F.lit(""))), ("t1", "t2"), strict=True)]
    keyed = docs.select("*", *key)
    gone = of.where("not kept").select(F.col("t1").alias("__t1"), F.col("t2").alias("__t2"))
    rest = keyed.join(sized(cut(gone, "gone-texts")), ["__t1", "__t2"], "left_anti")
    repeated = of.where("kept and n > 1").select(F.col("t1").alias("__r1"), F.col("t2").alias("__r2"), F.col("least_id").alias("__least"))
    same = (F.col("__t1") == F.col("__r1")) & (F.col("__t2") == F.col("__r2"))
    kept = rest.join(sized(cut(repeated, "repeated-texts")), same, "left").where(F.col("__r1").isNull() | F.col("doc_id").eqNullSafe(F.col("__least")))
    single = kept.where(F.col("__r1").isNull()).select(*docs.columns)
    ties = kept.where(F.col("__r1").isNotNull()).dropDuplicates(["__t1", "__t2"]).select(*docs.columns)
    return single.unionByName(ties)
