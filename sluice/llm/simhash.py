"""SimHash near-duplicates: fingerprints, pigeonring candidate search, classes.

A text is lower-cased (A-Z only) and cut into words at ASCII white space; its shingles are `shingle` consecutive
words joined by one space. A text with fewer words has one shingle, all its words; one without words (null, empty,
white space) has none.

`classes` links whole fingerprints (over all shingles, repeats included; 0 without words, linked like any other) within
a number of bits. `similar_classes` links texts whose sets of shingles have a Jaccard similarity of `similarity` or
more, which flips too many bits of one fingerprint for a join: a text gets a ring of segments, each the fingerprint of
a narrow group of its shingles, and segments either agree or differ. Short rings over a part of the shingles find most
links as stars; whole rings, with more segments than two similar texts can differ in, find all that are left.

Repeated rows share a class, and rows with a null id keep their class but never name it unless every id in it is null.
Texts of any length are read whole, in pieces. No rows give no rows; other columns may have any names.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator
from itertools import count, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sluice.llm.common import connected_components, cut, give_back, lean, raw, same, unused

SEED = 42
BITS = 64
#: Long texts are worked through in pieces of about this many bytes.
PIECE = 1 << 20
#: Segments of a text's ring, how many may differ, and the fewest shingles that a segment is of on average.
SEGMENTS, DIFFERING, GROUP = 16, 12, 2
#: Keys of dropped or compared rows up to this many are broadcast (about 40 bytes each).
BROADCAST_ROWS = 200_000
#: Segments of whole rings that a task deals at once, and about how many are brought together at once.
DEALT, MET = 1 << 18, 1 << 20
#: The bits of a whole ring's key where its level and its segment's code begin; codes of the first dealing, 0 is any other's.
LEVEL_AT, CODE_AT, CODES = 57, 50, 127
#: The largest sets of the levels of whole rings.
TOPS = [4]
while TOPS[-1] < 1 << 40:
    TOPS.append(TOPS[-1] * 3 // 2)
_DEAL = np.uint64(0x9E3779B97F4A7C15)
_MIX = np.uint64(0xD6E8FEB86659FD93)
_SPACE = re.compile(rb"[\x20\x09-\x0d]")


def _pieces(text: bytes, size: int) -> Iterator[bytes]:
    """Consecutive pieces of `text`, cut only at white space."""
    at = 0
    while len(text) - at > size:
        found = _SPACE.search(text, at + size)
        if not found:
            break
        yield text[at : found.start()]
        at = found.start()
    yield text[at:]


def _hashes(text: bytes | None, shingle: int, piece: int = PIECE) -> Iterator[np.ndarray]:
    """XXH64 of all shingles in order, in pieces of bounded size."""
    some, carry = False, []
    for part in _pieces((text or b"").lower(), piece):
        words = carry + part.split()
        if len(words) >= shingle:
            yield _hash(map(b" ".join, zip(*(words[i:] for i in range(shingle)))), len(words) - shingle + 1)
            some, carry = True, words[len(words) - shingle + 1 :]
        else:
            carry = words
    if not some and carry:
        yield _hash([b" ".join(carry)], 1)


def _hash(shingles, count: int) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh64_intdigest, shingles, repeat(SEED)), np.uint64, count)


def _bits(h: np.ndarray) -> np.ndarray:
    return np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")


def _majority(ones: np.ndarray, n) -> np.ndarray:
    return np.packbits(ones * 2 > n, axis=-1, bitorder="little").view(np.uint64)


def fingerprint(text: bytes | None, shingle: int = 4, piece: int = PIECE) -> int:
    """The fingerprint of one UTF-8 text as an unsigned 64-bit integer."""
    ones, n = np.zeros(BITS, np.int64), 0
    for h in _hashes(text, shingle, piece):
        n += len(h)
        for at in range(0, len(h), 1 << 16):
            ones += _bits(h[at : at + (1 << 16)]).sum(0, dtype=np.uint32)
    return int(_majority(ones, n)[0]) if n else 0


def shingle_set(text: bytes | None, shingle: int = 5, piece: int = PIECE) -> np.ndarray:
    """Hashes of the distinct shingles, ascending."""
    return np.unique(np.concatenate([np.zeros(0, np.uint64), *(np.unique(h) for h in _hashes(text, shingle, piece))]))


def level(n: int) -> int:
    """log2 of the groups that n shingles are dealt to: GROUP to twice as many shingles in each on average."""
    return max(0, (n // GROUP).bit_length() - 1)


def ring(h: np.ndarray, at_level: int) -> np.ndarray:
    """Fingerprints of the first SEGMENTS of 2**level groups of distinct shingles, dealt by hash; 0 for an empty one."""
    m = min(SEGMENTS, 1 << at_level)
    group = (h * _DEAL) >> np.uint64(64 - at_level) if at_level else np.zeros(len(h), np.uint64)
    mine = group < m
    h, group = h[mine], group[mine].astype(np.int64)
    out = np.zeros(m, np.uint64)
    if len(h):
        order = np.argsort(group, kind="stable")
        first = np.concatenate([[0], np.nonzero(np.diff(group[order]))[0] + 1])
        n = np.diff([*first, len(h)])
        out[group[order][first]] = _majority(np.add.reduceat(_bits(h[order]).astype(np.int64), first, axis=0), n[:, None]).ravel()
    return out


def apart(n1, n2, similarity: float):
    """The most shingles that one only of two sets of these sizes has, if their similarity is `similarity` or more."""
    return np.floor((n1 + n2) * (1 - similarity) / (1 + similarity) + 1e-6)


def whole_rings(h: np.ndarray, similarity: float) -> Iterator[tuple[int, int, int]]:
    """(level, most, segments) of a set for each level where it may have a similar one.

    Two similar sets are both at the level of the larger. `most` is the most shingles that only one of this set and a
    similar one there has; a level has more segments than that, so some segment agrees.
    """
    n = len(h)
    reach = int(n / similarity + 1e-9)
    for at in range(bisect_left(TOPS, n), bisect_left(TOPS, reach) + 1):
        most = int(apart(n, min(TOPS[at], reach), similarity))
        if most:  # else only equal sets are similar
            d = int(apart(TOPS[at], TOPS[at], similarity))
            yield at, most, d + 1 + (d + 15) // 16


def dealt(h: np.ndarray, segments: int, dealing: int = 0) -> np.ndarray:
    """The segment of each shingle, by hash."""
    x = (h ^ np.uint64(dealing)) * _MIX
    x = (x ^ (x >> np.uint64(32))) * _DEAL
    return (((x >> np.uint64(32)) * np.uint64(segments)) >> np.uint64(32)).astype(np.int64)


def _code(segment: np.ndarray) -> np.ndarray:
    return segment % CODES + 1


def whole_keys(h: np.ndarray, similarity: float) -> np.ndarray:
    """Hashes of (level, dealing, segment, its shingles) of a set's whole rings; similar sets have one in common. The first
    7 bits are the level, the next 7 the code of the segment.

    Empty segments have no key. A set with no more segments than it may differ in is dealt again, to more segments, until
    it has; of two sets the one that stops first finds an equal segment of the other's in that dealing.
    """
    out = [np.zeros(0, np.uint64)]
    for at, most, segments in whole_rings(h, similarity):
        for dealing in count():
            group = dealt(h, segments, dealing)
            some = np.nonzero(np.bincount(group, minlength=segments))[0]
            low, high = (np.bincount(group, x.astype(np.float64), segments)[some].astype(np.uint64) for x in (h & np.uint64(0xFFFFFFFF), h >> np.uint64(32)))
            place = some.astype(np.uint64) + np.uint64(at * 1024 + dealing << 40)
            x = (low + (high << np.uint64(32)) ^ place * _DEAL) * _MIX
            x = (x ^ (x >> np.uint64(32)) ^ high) * _DEAL
            code = np.zeros(len(some), np.uint64) if dealing else _code(some).astype(np.uint64)
            out.append(((x ^ (x >> np.uint64(29))) >> np.uint64(64 - CODE_AT)) | code << np.uint64(CODE_AT) | np.uint64(at << LEVEL_AT))
            if len(some) > most:
                break
            segments += segments // 4 + 1
    return np.concatenate(out)


def boxes(h: np.ndarray, similarity: float) -> list[tuple[int, bytes]]:
    """(level, a byte for each segment): parities of the counts of a segment's shingles, dealt to 8 by hash.

    The bits in which two boxes differ are no more than the shingles that one only of the two segments has.
    """
    out = []
    for at, _, segments in whole_rings(h, similarity):
        bit = dealt(h, segments) * 8 + (h & np.uint64(7)).astype(np.int64)
        out.append((at, np.packbits((np.bincount(bit, minlength=8 * segments) & 1).astype(np.uint8)).tobytes()))
    return out


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4) -> DataFrame:
    """A row of `id`, `text_hash` (of the raw text) and `fp` (the fingerprint as a signed long) per row of `df`."""
    schema = T.StructType([T.StructField("id", df.schema[id_col].dataType), T.StructField("text_hash", T.LongType()), T.StructField("fp", T.LongType())])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = np.fromiter((fingerprint(raw(x), shingle) for x in b.column(2)), np.uint64, b.num_rows)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(fp.view(np.int64))], ["id", "text_hash", "fp"])

    text = F.col(text_col)
    return df.select(F.col(id_col).alias("id"), F.xxhash64(text).alias("text_hash"), text.alias("text")).mapInArrow(work, schema)


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def pigeonring_pairs(nodes: DataFrame, tau: int = 4) -> DataFrame:
    """All pairs a < b of the distinct signed longs in `nodes.fp` that differ in 1 to `tau` bits.

    The bits lie in tau + 1 segments on a ring. If two fingerprints differ in at most tau bits, some segment starts a
    chain in which every run of l segments differs in at most floor(l * tau / (tau + 1)) bits: none in the first,
    one at most in the first two. These two segments are the join key, one side with each single bit of the second
    segment flipped in turn; the longer chains prune what the key lets through, and the whole distance comes last.
    Rows are linear in the nodes before the join, and the key has 2 / (tau + 1) of the bits.
    """
    if tau < 1:
        return nodes.select(F.col("fp").alias("a"), F.col("fp").alias("b")).where("false")
    m = tau + 1
    width = [BITS // m + (i < BITS % m) for i in range(m)]
    offset = [sum(width[:i]) for i in range(m)]

    def segment(fp: Column, i: int) -> Column:
        return F.shiftrightunsigned(fp, offset[i]).bitwiseAND(F.lit((1 << width[i]) - 1).cast("long"))

    keys = F.array(*[F.shiftleft(segment(F.col("fp"), i), width[(i + 1) % m]).bitwiseOR(segment(F.col("fp"), (i + 1) % m)) for i in range(m)])
    at = nodes.select("fp", F.posexplode(keys).alias("start", "key"))
    flips = F.array(*[F.array(*[F.lit(x).cast("long") for x in (0, *(1 << j for j in range(width[(i + 1) % m])))]) for i in range(m)])
    probe = at.select(F.col("fp").alias("b"), "start", "key", F.explode(flips[F.col("start")]).alias("flip")).select("b", "start", F.col("key").bitwiseXOR(F.col("flip")).alias("key"))
    differ = F.col("a").bitwiseXOR(F.col("b"))
    pairs = at.withColumnRenamed("fp", "a").join(probe, ["start", "key"]).where("a < b")
    for length in range(3, m):
        mask = F.array(*[F.lit(_signed(sum(((1 << width[j % m]) - 1) << offset[j % m] for j in range(i, i + length)))).cast("long") for i in range(m)])
        pairs = pairs.where(F.bit_count(differ.bitwiseAND(mask[F.col("start")])) <= length * tau // m)
    return pairs.where(F.bit_count(differ) <= tau).select("a", "b").distinct()


def classes(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4, tau: int = 4) -> DataFrame:
    """`id`, `text_hash`, `fp`, `root` (smallest fp of the class) and `component_id` (its smallest id) per row of `df`."""
    rows = cut(fingerprints(df, id_col, text_col, shingle))
    nodes = cut(rows.groupBy("fp").agg(F.min("id").alias("id")))
    return rows.join(_named(nodes, "fp", pigeonring_pairs(nodes, tau)), "fp").select("id", "text_hash", "fp", "root", "component_id")


def _named(nodes: DataFrame, key: str, pairs: DataFrame) -> DataFrame:
    """`key`, root and component_id of every row of `nodes` (key, id), as a table of its own.

    What is joined to a large class or a frequent key is a table, not an aggregate of the same shuffle, so that the
    class's partition can be split.
    """
    roots = cut(connected_components(pairs).withColumnRenamed("node", "member"))
    placed = nodes.join(roots, nodes[key] == roots.member, "left").select(key, "id", F.coalesce("root", key).alias("root"))
    least = cut(placed.groupBy("root").agg(F.min("id").alias("component_id")))
    return cut(placed.select(key, "root").join(least, "root"))


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4, tau: int = 4) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id per row of `df`; an empty table gives no rows."""
    return classes(df, id_col, text_col, shingle, tau).select(F.col("id").alias("doc_id"), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def rings(df: DataFrame, id_col: str, text_col: str, shingle: int, similarity: float) -> DataFrame:
    """id, text_hash, node (128-bit hash of the set of shingles), n (its size), rings (level, segments) and boxes (level,
    boxes) of whole rings per row of `df`.

    A text whose size is so near the next level's that a similar one may be there has a ring of that level too.
    """
    one = T.StructType([T.StructField("level", T.IntegerType()), T.StructField("segments", T.ArrayType(T.LongType()))])
    box = T.StructType([T.StructField("level", T.IntegerType()), T.StructField("boxes", T.BinaryType())])
    schema = T.StructType([T.StructField("id", df.schema[id_col].dataType), T.StructField("text_hash", T.LongType()), T.StructField("node", T.BinaryType()), T.StructField("n", T.LongType()), T.StructField("rings", T.ArrayType(one)), T.StructField("boxes", T.ArrayType(box))])
    kind = pa.list_(pa.struct([("level", pa.int32()), ("segments", pa.list_(pa.int64()))]))
    box_kind = pa.list_(pa.struct([("level", pa.int32()), ("boxes", pa.binary())]))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            nodes, sizes, found, whole = [], [], [], []
            for x in b.column(2):
                h = shingle_set(raw(x), shingle)
                nodes.append(xxhash.xxh3_128_digest(h.tobytes()))
                sizes.append(len(h))
                levels = sorted({level(len(h)), level(int(len(h) / similarity + 1e-9))}) if len(h) else []
                found.append([{"level": i, "segments": ring(h, i).view(np.int64)} for i in levels])
                whole.append([{"level": i, "boxes": x} for i, x in boxes(h, similarity)])
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(nodes, pa.binary()), pa.array(sizes, pa.int64()), pa.array(found, kind), pa.array(whole, box_kind)], schema.names)

    text = F.col(text_col)
    return df.select(F.col(id_col).alias("id"), F.xxhash64(text).alias("text_hash"), text.alias("text")).mapInArrow(lean(work), schema)


def chained(a: np.ndarray, b: np.ndarray, differing: float = DIFFERING / SEGMENTS) -> np.ndarray:
    """Per row of two tables of rings, whether some segment starts a chain all of whose beginnings, l segments long,
    have at most l * `differing` that differ."""
    m = a.shape[1]
    sums = np.zeros((len(a), 2 * m + 1), np.int64)  # differences before each place, twice round
    np.cumsum(np.tile(a != b, (1, 2)), axis=1, out=sums[:, 1:])
    going = np.ones((len(a), m), bool)
    for n in range(1, m + 1):
        going &= sums[:, n : n + m] - sums[:, :m] <= int(n * differing + 1e-9)
    return going.any(1)


def _chains(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """mapInArrow function: of rows (node, other, a, b) those whose rings a and b are chained, without the rings."""
    for batch in batches:
        a, b = batch.column(2), batch.column(3)
        lengths, keep = np.diff(a.offsets.to_numpy()), np.zeros(batch.num_rows, bool)
        for m in np.unique(lengths):
            rows = np.nonzero(lengths == m)[0]
            flat = [x.take(pa.array(rows)).flatten().to_numpy(zero_copy_only=False).reshape(-1, m) for x in (a, b)]
            keep[rows] = chained(*flat)
        yield pa.RecordBatch.from_arrays(batch.columns[:2], batch.schema.names[:2]).filter(pa.array(keep))


def similar_pairs(nodes: DataFrame, similarity: float = 0.8) -> DataFrame:
    """Candidate links (node, other) between rows of `nodes` (node, n, rings): most, `remaining_pairs` has the rest.

    Texts that have a segment in common meet in its bucket, as a star: each is linked to the bucket's most connected
    member, the one that shares its segments with most others (of a text and its edited copies that is the text, and
    edited copies of one text are more like it than like each other). The pigeonring condition on the two rings prunes:
    if at most DIFFERING of SEGMENTS differ, some chain stays within its share of them at every length. So does size.
    """
    ring_rows = nodes.select("node", F.explode("rings").alias("r")).select("node", "r.level", F.posexplode("r.segments").alias("start", "fp")).where("fp <> 0")
    bucket = ["level", "start", "fp"]
    sizes = cut(ring_rows.groupBy(*bucket).agg(F.count("*").alias("size")).where("size > 1"))
    shared = cut(ring_rows.join(sizes, bucket))
    known = cut(shared.groupBy("node").agg(F.sum("size").alias("weight")))
    top = shared.join(known, "node").groupBy(*bucket).agg(F.max(F.struct("weight", "node")).alias("top"))
    top = cut(top.select(*bucket, F.col("top.node").alias("other")))
    links = shared.join(top, bucket).where("node <> other").select("node", "other").distinct()
    left = nodes.select("node", F.col("n").alias("n1"), F.col("rings").alias("r1"))
    right = nodes.select(F.col("node").alias("other"), F.col("n").alias("n2"), F.col("rings").alias("r2"))
    links = links.join(left, "node").join(right, "other").where(F.least("n1", "n2") >= F.greatest("n1", "n2") * similarity - 1e-9)
    links = links.select("node", "other", "r2", F.explode("r1").alias("a")).select("node", "other", "a", F.explode("r2").alias("b")).where("a.level = b.level")
    links = links.select("node", "other", F.col("a.segments").alias("a"), F.col("b.segments").alias("b"))
    return links.mapInArrow(lean(_chains), "node binary, other binary").distinct()


def _deal(texts: DataFrame, shingle: int, similarity: float, parts: int) -> DataFrame:
    """The keys of all whole rings of `texts`, and whose they are, packed by part: rows of part, keys and owners.

    Both are arrays of 64-bit integers; an owner is the hash of a node. A task deals equal sets once.
    """

    def packed(keys: list[np.ndarray], owners: list[int]) -> pa.RecordBatch:
        key, owner = np.concatenate(keys), np.repeat(np.array(owners, np.uint64), [len(x) for x in keys])
        part = (key % np.uint64(parts)).astype(np.int64)
        order = np.argsort(part, kind="stable")
        key, owner, ends = key[order], owner[order], np.searchsorted(part[order], np.arange(parts + 1))
        some = np.nonzero(np.diff(ends))[0]
        columns = [pa.array([x[ends[i] : ends[i + 1]].tobytes() for i in some], pa.binary()) for x in (key, owner)]
        return pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), *columns], ["part", "keys", "owners"])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, keys, owners, held = set(), [], [], 0
        for b in batches:
            for x in b.column(0):
                h = shingle_set(raw(x), shingle)
                node = xxhash.xxh3_128_digest(h.tobytes())
                if node in seen:
                    continue
                seen.add(node)
                keys.append(whole_keys(h, similarity))
                owners.append(xxhash.xxh64_intdigest(node, SEED))
                held += len(keys[-1])
                if held >= DEALT:
                    yield packed(keys, owners)
                    keys, owners, held = [], [], 0
        if held:
            yield packed(keys, owners)

    return texts.mapInArrow(lean(work), "part int, keys binary, owners binary")


def _met(part: pa.Table) -> pa.Table:
    """applyInArrow function: the keys of a part that several have, a row of key and owner for each."""
    out = _several(part)
    give_back()
    return out


def _several(part: pa.Table) -> pa.Table:
    key, owner = (np.frombuffer(b"".join(x.as_py() for x in part.column(i)), np.int64) for i in (1, 2))
    order = np.lexsort((owner, key))
    key, owner = key[order], owner[order]
    new = np.ones(len(key), bool)
    new[1:] = (key[1:] != key[:-1]) | (owner[1:] != owner[:-1])
    key, owner = key[new], owner[new]
    same_key = key[1:] == key[:-1]
    keep = np.concatenate([[False], same_key]) | np.concatenate([same_key, [False]])
    return pa.table([pa.array(key[keep]), pa.array(owner[keep])], ["key", "owner"])


def told_here(code: np.ndarray, a: np.ndarray, b: np.ndarray, most: np.ndarray) -> np.ndarray:
    """Whether a pair is told at a key of this code; a, b: a row of boxes each, most: the shingles in which two may differ.

    A pair meets at each segment it shares, and would be told as often. Boxes that are equal, and not those of an empty
    segment, are of an equal segment, or of one in which two shingles or more differ and cancel out. Of the shingles in
    which a similar pair differs each bit that differs has one, so no more than half of what is left of `most` are equal
    boxes of segments that are not, and it is enough to tell it at the first so many and one. A pair with no more equal
    boxes, and any pair at a key of code 0, is told wherever it meets.
    """
    out = np.ones(len(code), bool)
    other = a ^ b
    left = (most - np.bitwise_count(other).sum(1, dtype=np.int64)) // 2
    equal = (other == 0) & (a != 0)
    some = np.nonzero((code > 0) & (equal.sum(1) > left))[0]
    equal = equal[some]
    equal &= np.cumsum(equal, axis=1, dtype=np.int32) <= left[some, None] + 1
    out[some] = (equal & (_code(np.arange(a.shape[1]))[None, :] == code[some, None])).any(1)
    return out


def _across(similarity: float):
    """mapInArrow function: of rows (key, root, owner, n, boxes) in order of key and root, all pairs (a, b) of owners of a
    key that have different roots, sizes near enough, and boxes that differ, over the whole turn of the ring, in no more
    bits than two similar sets may; a pair of several keys is told at few of them. Memory is linear in the rows of a key."""

    def pairs(key: np.ndarray, root: np.ndarray, owner: np.ndarray, n: np.ndarray, boxes: np.ndarray) -> Iterator[pa.RecordBatch]:
        box = np.frombuffer(b"".join(boxes), np.uint8).reshape(len(key), -1)
        code = ((key.view(np.uint64) >> np.uint64(CODE_AT)) & np.uint64(CODES)).astype(np.int64)
        new_key = np.concatenate([[True], key[1:] != key[:-1], [True]])
        new_root = new_key.copy()
        new_root[1:-1] |= root[1:] != root[:-1]
        begin, end = (np.nonzero(x)[0][np.cumsum(x[:-1])] for x in (new_root, new_key))  # where the next root, key begins
        some = np.nonzero(end > begin)[0]
        total = np.concatenate([[0], np.cumsum(end[some] - begin[some])])
        at, most = 0, MET * 4 // box.shape[1]
        while at < len(some):
            to = max(at + 1, int(np.searchsorted(total, total[at] + most, "right")) - 1)
            left = np.repeat(some[at:to], np.diff(total[at : to + 1]))
            right = begin[left] + np.arange(total[at], total[to]) - np.repeat(total[at:to], np.diff(total[at : to + 1]))
            near = np.minimum(n[left], n[right]) >= np.maximum(n[left], n[right]) * similarity - 1e-9
            left, right = left[near], right[near]
            may = apart(n[left], n[right], similarity).astype(np.int64)
            near = np.bitwise_count(box[left] ^ box[right]).sum(1, dtype=np.int64) <= may
            left, right, may = left[near], right[near], may[near]
            told = told_here(code[left], box[left], box[right], may)
            a, b = owner[left[told]], owner[right[told]]
            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], ["a", "b"])
            at = to

    def by_level(rows: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        level = rows[0].view(np.uint64) >> np.uint64(LEVEL_AT)
        ends = [0, *(np.nonzero(np.diff(level))[0] + 1), len(level)]
        for i, j in zip(ends, ends[1:]):
            yield from pairs(*(x[i:j] for x in rows))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [np.zeros(0, np.int64)] * 4 + [np.zeros(0, object)]
        for batch in batches:
            held = [np.concatenate([x, y.to_numpy(zero_copy_only=False)]) for x, y in zip(held, batch.columns)]
            if len(held[0]) and (done := int(np.argmax(held[0] == held[0][-1]))):
                yield from by_level([x[:done] for x in held])
                held = [x[done:] for x in held]
        if len(held[0]):
            yield from by_level(held)

    return work


def remaining_pairs(texts: DataFrame, nodes: DataFrame, roots: DataFrame, shingle: int, similarity: float, parts: int) -> DataFrame:
    """Candidate links (node, other) between rows of `nodes` (node, n, boxes) with different roots in `roots` (node, root;
    others are their own): all pairs of them that are similar, and few others. `texts` has the texts of all nodes.

    Two similar sets have a segment of whole rings in common. Few texts share one, so all pairs that do are looked at, but
    those already in one class. From an equal segment the chain goes the whole turn of the ring: the bits in which boxes
    differ add up to no more than the shingles in which similar sets may.
    """
    met = cut(_deal(texts, shingle, similarity, parts).groupBy("part").applyInArrow(_met, "key long, owner long"))
    owner = F.xxhash64("node").alias("owner")
    known = nodes.join(roots, "node", "left").select(owner, F.xxhash64(F.coalesce("root", "node")).alias("root"), "n")
    of_key = Window.partitionBy("key")
    rows = met.join(known, "owner").withColumns({"low": F.min("root").over(of_key), "high": F.max("root").over(of_key)})
    rows = cut(rows.where("low <> high").select("key", "root", "owner", "n", F.shiftrightunsigned("key", LEVEL_AT).cast("int").alias("level")))
    boxes = nodes.select(owner, F.explode("boxes").alias("x")).select("owner", "x.level", "x.boxes")
    rows = rows.join(boxes, ["owner", "level"]).select("key", "root", "owner", "n", "boxes")
    pairs = cut(rows.repartition("key").sortWithinPartitions("key", "root").mapInArrow(lean(_across(similarity)), "a long, b long").distinct())
    left, right = (nodes.select(F.xxhash64("node").alias(x), F.col("node").alias(name)) for x, name in (("a", "node"), ("b", "other")))
    return pairs.join(left, "a").join(right, "b").select("node", "other")


def _sets(df: DataFrame, wanted: DataFrame, id_col: str, text_col: str, shingle: int) -> DataFrame:
    """node and its shingles' hashes, read from one row of `df` (id, text_hash) each in `wanted`."""
    schema = "node binary, shingles array<long>"

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = [shingle_set(raw(x), shingle) for x in b.column(0)]
            yield pa.RecordBatch.from_arrays([pa.array([xxhash.xxh3_128_digest(h.tobytes()) for h in sets], pa.binary()), pa.array([h.view(np.int64) for h in sets], pa.list_(pa.int64()))], ["node", "shingles"])

    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    it = F.col("id").eqNullSafe(F.col("want_id")) & (F.xxhash64("text") == F.col("want_hash"))
    wanted = wanted.select(F.col("id").alias("want_id"), F.col("text_hash").alias("want_hash")).distinct()
    found = rows.join(F.broadcast(wanted) if wanted.count() <= BROADCAST_ROWS else wanted, it, "left_semi")
    return found.select("text").mapInArrow(lean(work), schema).dropDuplicates(["node"])


def similar_classes(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, similarity: float = 0.8) -> DataFrame:
    """`id`, `text_hash`, `node`, `root` (smallest node of the class) and `component_id` (its smallest id) per row of `df`.

    Every link that makes a class is one of equal sets of shingles or of sets whose similarity has been computed whole, and
    no link between two classes is left out. The similarity must be over 0.5.
    """
    if not 0.5 < similarity <= 1:
        raise ValueError("the similarity must be over 0.5 and at most 1")
    rows = cut(rings(df, id_col, text_col, shingle, similarity))
    first = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "text_hash")).alias("first")
    nodes = cut(rows.groupBy("node").agg(first, F.any_value("n").alias("n"), F.any_value("rings").alias("rings"), F.any_value("boxes").alias("boxes")))

    def alike(links: DataFrame) -> DataFrame:
        links = cut(links)
        ends = links.select("node").union(links.select("other")).distinct()
        sets = cut(_sets(df, nodes.join(ends, "node", "left_semi").select("first.id", "first.text_hash"), id_col, text_col, shingle))
        other = sets.select(F.col("node").alias("other"), F.col("shingles").alias("others"))
        both = F.size(F.array_intersect("shingles", "others"))
        whole = links.join(sets, "node").join(other, "other").where(both >= (F.size("shingles") + F.size("others") - both) * similarity - 1e-9)
        return whole.select(F.col("node").alias("a"), F.col("other").alias("b"))

    roots = cut(connected_components(alike(similar_pairs(nodes, similarity))))
    parts = max(df.sparkSession.sparkContext.defaultParallelism, -(-int(rows.agg(F.sum("n")).first()[0] or 0) // (2 * MET)))
    more = alike(remaining_pairs(df.select(text_col), nodes, roots, shingle, similarity, parts))
    links = roots.select(F.col("node").alias("a"), F.col("root").alias("b")).union(more)
    named = _named(nodes.select("node", F.col("first.id").alias("id")), "node", links)
    return rows.select("id", "text_hash", "node").join(named, "node").select("id", "text_hash", "node", "root", "component_id")


def keep_one(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4, tau: int = 4) -> DataFrame:
    """The rows of `df`, all columns, without those whose fingerprint is near another's: of each class the smallest id
    stays (null last). Of equal ids in a class the smaller fingerprint and text hash stays, and of equal rows one."""
    return _keep(df, cut(classes(df, id_col, text_col, shingle, tau).withColumnRenamed("fp", "node")), id_col, text_col)


def keep_one_similar(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, similarity: float = 0.8) -> DataFrame:
    """The rows of `df`, all columns, without those similar to another, as in `keep_one`."""
    return _keep(df, cut(similar_classes(df, id_col, text_col, shingle, similarity)), id_col, text_col)


def _keep(df: DataFrame, of: DataFrame, id_col: str, text_col: str) -> DataFrame:
    first = of.groupBy("root").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "node", "text_hash")).alias("x")).select("x.id", "x.text_hash")
    first = cut(first.distinct())
    own_id, own_hash = unused(df, "own_id", "own_hash")
    repeated = of.join(first, same(of, first, "id", "text_hash"), "left_semi").groupBy("id", "text_hash").count().where("count > 1")
    stay = first.select(F.col("id").alias(own_id), F.col("text_hash").alias(own_hash))
    gone = of.join(first, same(of, first, "id", "text_hash"), "left_anti").select(F.col("id").alias(own_id), F.col("text_hash").alias(own_hash)).distinct()
    gone = cut(gone)
    it = F.col(id_col).eqNullSafe(F.col(own_id)) & (F.xxhash64(F.col(text_col)) == F.col(own_hash))
    # few rows go: their keys travel to the documents; many: documents are shuffled to meet the keys of those that stay
    out = df.join(F.broadcast(gone), it, "left_anti") if gone.count() <= BROADCAST_ROWS else df.join(stay, it, "left_semi")
    if repeated.isEmpty():
        return out
    return out.withColumn(own_hash, F.xxhash64(F.col(text_col))).dropDuplicates([id_col, own_hash]).drop(own_hash)
