"""Near-duplicate records with small edits (problem 4): a size-aware heavy-light set join.

A text is the set of its runs of three successive tokens (ASCII letters, digits, underscores,
lower-cased), each hashed to 64 bits. Two texts match if the runs that both have are at least
``threshold`` of the runs that either has. Texts with equal sets form a class; classes are joined,
not copies.

1. ``signatures`` hashes the sets once and keeps them in the shared checkpoint folder.
2. A count sketch of fixed size over all sets orders runs from rare to common. Any total order
   gives exact results; a good one only makes lists short.
3. Light sets (at most ``boundary`` runs) enumerate all 2-subsets of their prefix, heavy sets put
   the single runs of their prefix into inverted lists, which are scanned for all sets whose size
   allows a match. A match needs ceil(t * n) common runs, so it shares 2 runs within the first
   n - ceil(t * n) + 2, and 1 within the first n - ceil(t * n) + 1. The boundary is the one with
   the least cost, estimated from the sizes and counts of all sets.
4. Keys travel as packed arrays, one row per task and bucket, not as one row per key; the number
   of buckets follows the data. A task sends a class once, so a hot text is sent once per task.
5. Candidates are verified on the full sets; nothing is capped, dropped or sampled.

Defined results: null ids and null texts match nothing; texts with fewer than three tokens match
only equal texts; repeated rows of one id count once; if one id has several texts, each takes part
and a pair of an id with itself is not reported. Empty input gives empty output. Columns other
than the id and the text are ignored, whatever their names.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom.operators.joins import salted_join
from codeloom.session import cut_lineage, shuffle_partitions

_TOKEN = re.compile(r"[A-Za-z0-9_]+", re.ASCII)
_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
_MIX = np.uint64(0xFF51AFD7ED558CCD)

#: Counters of the sketch (4 million of two bytes, whatever the input).
SLOT_BITS = 22
#: Runs that a pair has to share in the inverted lists of heavy sets.
SHARED = 4
#: Boundaries that are weighed against each other.
BOUNDARIES = (0, 4, 6, 8, 10, 12, 16, 20, 24, 32, 48, 64, 96, 128, 192, 256)
#: Costs in units of sending a key (8 bytes): a pair that meets in a list is a row of 32 bytes that
#: is shuffled and summed up; a candidate is verified on both sets.
MEETING_COST, CANDIDATE_COST = 4.0, 25.0
#: Share of the meetings in lists that become candidates, and of the partners of a run that share a
#: second given run; rough, they only steer the boundary.
SURVIVING, TOGETHER = 0.02, 0.05
#: Keys of one bucket, about (8 bytes each).
BUCKET_KEYS = 1_000_000
#: Longer lists are cut into blocks of so many classes, and pairs of blocks go to tasks of their own.
LIST_BLOCK = 4_096
#: Bits of the number that tells a class's size and how many of its keys fell together.
SIZE_BITS = 24


class _Memo(dict):
    """64-bit hash of a token; forgets everything when it has grown large."""

    def __missing__(self, token: str) -> int:
        if len(self) > 500_000:
            self.clear()
        value = self[token] = xxhash.xxh3_64_intdigest(token)
        return value


_memo = _Memo()


def shingles(text: str) -> np.ndarray:
    """Sorted distinct hashes of the runs of three tokens."""
    words = _TOKEN.findall(text)
    if len(words) < 3:
        return np.empty(0, np.uint64)
    codes = np.array([_memo[w.lower()] for w in words], np.uint64)
    mixed = (codes[:-2] * _A + codes[1:-1]) * _B + codes[2:]
    mixed ^= mixed >> np.uint64(31)
    mixed *= _MIX
    mixed ^= mixed >> np.uint64(29)
    return np.unique(mixed)


SIGNATURE = "id long, class_id long, n int, runs binary"


def signatures(rows: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, class, size, sorted run hashes). Equal sets have equal classes."""

    def sign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for key, text in zip(batch["id"].to_numpy(), batch["text"], strict=True):
                runs = shingles(text)
                blob = runs.tobytes()
                named = xxhash.xxh3_64_intdigest(blob, 11) if len(runs) else xxhash.xxh3_64_intdigest(text, 13)
                out.append((key, named - (1 << 64) if named >> 63 else named, len(runs), blob))
            yield pd.DataFrame(out, columns=["id", "class_id", "n", "runs"])

    named = rows.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return named.where("id IS NOT NULL AND text IS NOT NULL").mapInPandas(sign, SIGNATURE)


def _sketch(spark: SparkSession, signed: DataFrame) -> np.ndarray:
    """Counts of all runs by the top bits of their hash; a fixed number of saturating counters.

    Counts only order the runs; that they saturate or collide makes no result wrong.
    """
    slices, width = 64, 1 << (SLOT_BITS - 6)

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(1 << SLOT_BITS, np.int32)
        for batch in batches:
            if len(batch):
                runs = np.frombuffer(b"".join(batch["runs"]), np.uint64)
                at, seen = np.unique((runs >> np.uint64(64 - SLOT_BITS)).astype(np.int32), return_counts=True)
                total[at] += seen.astype(np.int32)
        if total.any():
            small = np.minimum(total, 255).astype(np.uint8)
            yield pd.DataFrame({"slice": range(slices), "counts": [small[k * width : (k + 1) * width].tobytes() for k in range(slices)]})

    def add(part: pd.DataFrame) -> pd.DataFrame:
        total = np.zeros(width, np.int64)
        for blob in part["counts"]:
            total += np.frombuffer(blob, np.uint8)
        return pd.DataFrame({"slice": part["slice"].iloc[:1], "counts": [np.minimum(total, 65535).astype(np.uint16).tobytes()]})

    kind = "slice int, counts binary"
    parts = signed.select("runs").mapInPandas(count, kind).groupBy("slice").applyInPandas(add, kind).collect()
    out = np.zeros(1 << SLOT_BITS, np.uint16)
    for row in parts:
        out[row["slice"] * width : (row["slice"] + 1) * width] = np.frombuffer(row["counts"], np.uint16)
    return out


def _ranked(runs: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Runs from rare to common; ties by their hash."""
    seen = counts[(runs >> np.uint64(64 - SLOT_BITS)).astype(np.int64)]
    return runs[np.lexsort((runs, seen))]


def needed(n: int, threshold: float) -> int:
    """Least number of common runs in any match of a set of ``n`` runs."""
    return max(1, int(np.ceil(threshold * n - 1e-9)))


def prefix(n: int, threshold: float, shared: int) -> int:
    """Length of the prefix in which a match shares ``shared`` runs (or all it needs, if fewer)."""
    c = needed(n, threshold)
    return n - c + min(shared, c)


class Plan(NamedTuple):
    boundary: int
    keys: int


def choose_boundary(sizes: dict[int, tuple[int, float, float]], threshold: float) -> Plan:
    """Cheapest boundary. ``sizes``: by set size (number of sets, expected meetings in the lists of
    single runs, expected meetings in the lists of 2-subsets). Meetings grow with the square of the
    number of sets and keys do not, so the boundary rises with the data."""
    best = None
    for b in BOUNDARIES:
        keys = cost = 0.0
        for n, (sets, single, double) in sizes.items():
            p, wide = prefix(n, threshold, SHARED), prefix(n, threshold, 2)
            if n <= b:
                subsets = wide * (wide - 1) / 2
                keys += sets * subsets
                cost += sets * subsets + CANDIDATE_COST * double
            if n > b or n >= threshold * b:
                keys += sets * p
                cost += sets * p + ((MEETING_COST + SURVIVING * CANDIDATE_COST) * single if n > b else 0)
        if best is None or cost < best[0]:
            best = cost, Plan(b, int(keys))
    return best[1] if best else Plan(0, 0)


def _size_statistics(signed: DataFrame, counts, threshold: float) -> dict[int, tuple[int, float, float]]:
    """By size; sizes above the largest boundary are gathered at a few representative sizes."""
    top = BOUNDARIES[-1]

    def measure(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        table, out = counts.value, {}
        for batch in batches:
            for n, blob in zip(batch["n"].to_numpy(), batch["runs"], strict=True):
                n = int(n)
                if not n:
                    continue
                at = n if n <= top else 1 << int(np.ceil(np.log2(n)))
                entry = out.setdefault(at, [0, 0.0, 0.0])
                entry[0] += 1
                if n <= top:
                    runs = np.frombuffer(blob, np.uint64)
                    seen = np.sort(table[(runs >> np.uint64(64 - SLOT_BITS)).astype(np.int64)]).astype(np.int64)[: prefix(n, threshold, SHARED)] - 1
                    entry[1] += float(seen.sum()) / 2
                    seen = seen[: prefix(n, threshold, 2)]
                    entry[2] += float((seen[:-1] * np.arange(len(seen) - 1, 0, -1)).sum()) * TOGETHER / 2
        yield pd.DataFrame([(k, *v) for k, v in out.items()], columns=["n", "sets", "single", "double"])

    rows = (
        signed.select("n", "runs")
        .mapInPandas(measure, "n int, sets long, single double, double double")
        .groupBy("n")
        .agg(F.sum("sets").alias("sets"), F.sum("single").alias("single"), F.sum("double").alias("double"))
        .collect()
    )
    return {r["n"]: (r["sets"], r["single"], r["double"]) for r in rows}


KEYS = "bucket int, keys binary, places binary, classes binary, sizes binary"


def _send_keys(signed: DataFrame, counts, plan: Plan, buckets: int, threshold: float) -> DataFrame:
    """Packed keys of all sets, one row per task, bucket and flush."""
    boundary = plan.boundary

    def send(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        table, known = counts.value, set()
        keys, places, classes, sizes, held = [], [], [], [], 0

        def flush() -> pd.DataFrame:
            key, place = np.concatenate(keys), np.concatenate(places)
            cls, size = np.array(classes, np.int64), np.array(sizes, np.int32)
            bucket = ((key >> np.uint64(40)) % np.uint64(buckets)).astype(np.int32)
            order = np.argsort(bucket, kind="stable")
            key, place, bucket = key[order], place[order], bucket[order]
            cuts = np.flatnonzero(np.diff(bucket)) + 1
            rows = []
            for part, at in zip(np.split(key, cuts), np.split(place, cuts), strict=True):
                used, local = np.unique(at, return_inverse=True)
                rows.append((int((part[0] >> np.uint64(40)) % np.uint64(buckets)), (part & np.uint64(0xFFFFFFFF)).astype(np.uint32).tobytes(), local.astype(np.uint32).tobytes(), cls[used].tobytes(), size[used].tobytes()))
            return pd.DataFrame(rows, columns=["bucket", "keys", "places", "classes", "sizes"])

        for batch in batches:
            for cls, n, blob in zip(batch["class_id"].to_numpy(), batch["n"].to_numpy(), batch["runs"], strict=True):
                n, cls = int(n), int(cls)
                if not n or cls in known:
                    continue
                known.add(cls)
                ranked = _ranked(np.frombuffer(blob, np.uint64), table)
                own = []
                if n <= boundary:
                    first = ranked[: prefix(n, threshold, 2)]
                    if needed(n, threshold) < 2:  # one run is enough; it is its own key
                        subset = first * _MIX
                    else:
                        i, j = np.triu_indices(len(first), 1)
                        subset = (first[i] * _A ^ first[j] * _B) * _MIX
                    own.append(subset | np.uint64(1))
                if n > boundary or n >= threshold * boundary:
                    own.append(ranked[: prefix(n, threshold, SHARED)] & ~np.uint64(1))
                for key in own:
                    keys.append(key)
                    places.append(np.full(len(key), len(classes), np.uint32))
                    held += len(key)
                classes.append(cls)
                # Keys travel by 32 bits; those of one class that fall together lower what its pairs have to share.
                fallen = sum(len(key) - len(np.unique(key & np.uint64(0xFFFFFFFF))) for key in own)
                sizes.append(n | min(fallen, 127) << SIZE_BITS)
                if held > 2_000_000:
                    yield flush()
                    keys, places, classes, sizes, held = [], [], [], [], 0
        if held:
            yield flush()

    return signed.select("class_id", "n", "runs").mapInPandas(send, KEYS)


MEETINGS = "a long, b long, need long, hits long, left binary, right binary"


def _packed(found: list[np.ndarray]) -> pd.DataFrame:
    rows, hits = np.unique(np.concatenate(found), axis=0, return_counts=True)
    return pd.DataFrame({"a": rows[:, 0], "b": rows[:, 1], "need": rows[:, 2], "hits": hits.astype(np.int64), "left": None, "right": None})


def _needs(single: np.ndarray, size: np.ndarray, fallen: np.ndarray, threshold: float) -> np.ndarray:
    """Keys that a pair with its smaller set of this size has to share."""
    wanted = np.minimum(SHARED, np.ceil(threshold * size - 1e-9).astype(np.int64)) - fallen
    return np.where(single, np.maximum(1, wanted), 1)


def _pairs_of(key: np.ndarray, cls: np.ndarray, size: np.ndarray, fallen: np.ndarray, threshold: float) -> Iterator[pd.DataFrame]:
    """Pairs within lists; entries are in the order of key, size, class."""
    needs = _needs(key & 1 == 0, size, fallen, threshold)
    at, step, found, held = np.arange(len(key)), 1, [], 0
    while len(at):
        at = at[at + step < len(key)]
        at = at[(key[at] == key[at + step]) & (size[at] >= threshold * size[at + step] - 1e-9)]
        if len(at):
            a, b = cls[at], cls[at + step]
            found.append(np.stack([np.minimum(a, b), np.maximum(a, b), np.minimum(needs[at], _needs(key[at] & 1 == 0, size[at], fallen[at + step], threshold))], 1))
            held += len(at)
        step += 1
        if held > 1_000_000:
            yield _packed(found)
            found, held = [], 0
    if found:
        yield _packed(found)


_ENTRY = np.dtype([("cls", np.int64), ("size", np.int32), ("fallen", np.int32)])


def _block_pairs(cls: np.ndarray, size: np.ndarray, fallen: np.ndarray, single: bool, threshold: float) -> Iterator[pd.DataFrame]:
    """Rows of pairs of blocks of one long list (``need`` tells its kind); those whose sizes rule a match out are left away."""
    entries = np.empty(len(cls), _ENTRY)
    entries["cls"], entries["size"], entries["fallen"] = cls, size, fallen
    blocks = [entries[k : k + LIST_BLOCK] for k in range(0, len(entries), LIST_BLOCK)]
    for i, left in enumerate(blocks):
        fits = [right for right in blocks[i:] if left["size"][-1] >= threshold * right["size"][0] - 1e-9]
        yield pd.DataFrame({"a": 0, "b": [int(right is left) for right in fits], "need": int(single), "hits": 0, "left": left.tobytes(), "right": [right.tobytes() for right in fits]})


def _pair_blocks(batches: Iterator[pd.DataFrame], threshold: float) -> Iterator[pd.DataFrame]:
    for batch in batches:
        for same, single, one, two in zip(batch["b"], batch["need"], batch["left"], batch["right"], strict=True):
            left, right = np.frombuffer(one, _ENTRY), np.frombuffer(two, _ENTRY)
            if same:
                yield from _pairs_of(np.full(len(left), 0 if single else 1), left["cls"], left["size"], left["fallen"], threshold)
                continue
            for k in range(0, len(left), 256):  # a part of the left block against the right one
                part = left[k : k + 256]
                i, j = np.nonzero(part["size"][:, None] >= threshold * right["size"][None, :] - 1e-9)
                if len(i):
                    a, b = part["cls"][i], right["cls"][j]
                    needs = _needs(np.full(len(i), bool(single)), part["size"][i], np.maximum(part["fallen"][i], right["fallen"][j]), threshold)
                    yield _packed([np.stack([np.minimum(a, b), np.maximum(a, b), needs], 1)])


def _meet(sent: DataFrame, buckets: int, threshold: float) -> DataFrame:
    """Candidate pairs of classes from the lists of each bucket, smaller class id first.

    The lowest bit of a key tells 2-subsets of light sets (one in common makes a candidate) from
    single runs (a pair needs as many in common as the smaller of its sets asks for). A list of more
    than ``LIST_BLOCK`` classes is cut into blocks, whose pairs are spread over all tasks.
    """

    def lists(blobs: pd.DataFrame) -> Iterator[pd.DataFrame]:
        key = np.concatenate([np.frombuffer(b, np.uint32) for b in blobs["keys"]])
        cls = np.concatenate([np.frombuffer(c, np.int64)[np.frombuffer(p, np.uint32)] for c, p in zip(blobs["classes"], blobs["places"], strict=True)])
        size = np.concatenate([np.frombuffer(s, np.int32)[np.frombuffer(p, np.uint32)] for s, p in zip(blobs["sizes"], blobs["places"], strict=True)])
        order = np.argsort(key, kind="stable")
        key, cls, size = key[order], cls[order], size[order]
        same = np.zeros(len(key), bool)  # keys that occur once meet nothing
        same[1:] = key[1:] == key[:-1]
        same[:-1] |= same[1:]
        key, cls, size = key[same], cls[same], size[same]
        fallen, size = size >> SIZE_BITS, size & ((1 << SIZE_BITS) - 1)
        order = np.lexsort((cls, size, key))
        key, cls, size, fallen = key[order], cls[order], size[order], fallen[order]
        fresh = np.ones(len(key), bool)
        fresh[1:] = (key[1:] != key[:-1]) | (cls[1:] != cls[:-1])
        key, cls, size, fallen = key[fresh], cls[fresh], size[fresh], fallen[fresh]
        if not len(key):
            return
        starts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        ends = np.append(starts[1:], len(key))
        short = np.ones(len(key), bool)
        for a, b in zip(starts, ends, strict=True) if (ends - starts).max() > LIST_BLOCK else ():
            if b - a > LIST_BLOCK:
                short[a:b] = False
                yield from _block_pairs(cls[a:b], size[a:b], fallen[a:b], not key[a] & 1, threshold)
        yield from _pairs_of(key[short], cls[short], size[short], fallen[short], threshold)

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bucket, parts = None, []
        for batch in batches:
            for value, part in batch.groupby("bucket", sort=False):
                if value != bucket and parts:
                    yield from lists(pd.concat(parts))
                    parts = []
                bucket = value
                parts.append(part)
        if parts:
            yield from lists(pd.concat(parts))

    spread = sent.repartition(min(buckets, 20_000), "bucket").sortWithinPartitions("bucket")
    met = cut_lineage(spread.mapInPandas(scan, MEETINGS))
    blocks = met.where("left IS NOT NULL").repartition(max(buckets, shuffle_partitions(sent.sparkSession)))
    paired = met.where("left IS NULL").unionByName(blocks.mapInPandas(lambda batches: _pair_blocks(batches, threshold), MEETINGS))
    return paired.groupBy("a", "b").agg(F.min("need").alias("need"), F.sum("hits").alias("hits")).where("hits >= need").select("a", "b")


_FILTER_BITS = 22


def _members_of(signed: DataFrame, pairs: DataFrame) -> DataFrame:
    """One signature of each class that occurs in a pair.

    A bit table of fixed size (512 kB) of the classes in the pairs keeps the others from being
    shuffled; what it lets through by chance is dropped by the join.
    """
    ids = pairs.select(F.explode(F.array("a", "b")).alias("class_id")).distinct()
    slot = F.pmod(F.xxhash64("class_id"), F.lit(1 << _FILTER_BITS))
    bits = ids.select(slot.alias("slot")).groupBy(F.floor(F.col("slot") / 32768).alias("word")).agg(
        F.bitmap_construct_agg(F.pmod(F.col("slot"), F.lit(32768))).alias("bits")
    )
    table = np.zeros((1 << _FILTER_BITS) // 8, np.uint8)
    for row in bits.collect():
        table[row["word"] * 4096 : (row["word"] + 1) * 4096] = np.frombuffer(row["bits"], np.uint8)
    shared = signed.sparkSession.sparkContext.broadcast(table)

    @F.pandas_udf("boolean")
    def maybe(slots: pd.Series) -> pd.Series:
        s = slots.to_numpy().astype(np.int64)
        return pd.Series((shared.value[s >> 3] >> (s & 7).astype(np.uint8)) & 1 == 1)

    kept = signed.where(maybe(slot)).select("class_id", "n", "runs")
    return kept.groupBy("class_id").agg(F.first("n").alias("n"), F.first("runs").alias("runs"))


def similar_classes(signed: DataFrame, threshold: float = 0.6) -> DataFrame:
    """(a, b, common, similarity) of all pairs of classes that match, a < b."""
    spark = signed.sparkSession
    counts = spark.sparkContext.broadcast(_sketch(spark, signed))
    plan = choose_boundary(_size_statistics(signed, counts, threshold), threshold)
    buckets = max(shuffle_partitions(spark), plan.keys // BUCKET_KEYS + 1)
    pairs = cut_lineage(_meet(_send_keys(signed, counts, plan, buckets, threshold), buckets, threshold))
    sets = _members_of(signed, pairs)

    @F.pandas_udf("int")
    def common(left: pd.Series, right: pd.Series) -> pd.Series:
        return pd.Series(
            [len(np.intersect1d(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64), assume_unique=True)) for x, y in zip(left, right, strict=True)],
            dtype="int32",
        )

    left = sets.select(F.col("class_id").alias("a"), F.col("n").alias("na"), F.col("runs").alias("ra"))
    right = sets.select(F.col("class_id").alias("b"), F.col("n").alias("nb"), F.col("runs").alias("rb"))
    met = pairs.join(left, "a").join(right, "b").withColumn("common", common("ra", "rb"))
    either = F.col("na") + F.col("nb") - F.col("common")
    # Whole numbers: 10 * common >= 6 * either is exact at a threshold of 0.6.
    scaled = round(threshold * 10_000)
    return met.where(F.col("common").cast("long") * 10_000 >= either.cast("long") * scaled).select(
        "a", "b", "common", (F.col("common") / either).alias("similarity")
    )


def near_pairs(rows: DataFrame, id_col: str, text_col: str, threshold: float = 0.6) -> DataFrame:
    """(id_a, id_b), id_a < id_b, of all matching records; copies are expanded through their class."""
    signed = cut_lineage(signatures(rows, id_col, text_col))
    members = signed.select("class_id", "id").distinct()
    links = similar_classes(signed, threshold).select("a", "b")
    one, two = members.select(F.col("class_id").alias("a"), F.col("id").alias("x")), members.select(F.col("class_id").alias("b"), F.col("id").alias("y"))
    across = links.join(one, "a").join(two, "b").where("x <> y")
    several = members.groupBy("class_id").agg(F.count(F.lit(1)).alias("c")).where("c > 1").select("class_id")
    copies = members.join(several, "class_id")
    # The copies of a class are spread, so that a hot one is not paired in one task.
    within = salted_join(copies.select("class_id", F.col("id").alias("x")), copies.select("class_id", F.col("id").alias("y")), ["class_id"], [F.col("x")]).where("x < y")
    pairs = across.select("x", "y").unionByName(within.select("x", "y"))
    return pairs.select(F.least("x", "y").alias("id_a"), F.greatest("x", "y").alias("id_b")).distinct()


def groups(rows: DataFrame, id_col: str, text_col: str, threshold: float = 0.6) -> DataFrame:
    """(id, class_id, group_id, links), one row per record and class: the smallest id of its class, the
    smallest id of the records that links lead to, and the number of links of its class to other
    classes. Links within classes of copies are not expanded."""
    signed = cut_lineage(signatures(rows, id_col, text_col))
    links = cut_lineage(similar_classes(signed, threshold).select("a", "b"))
    degree = links.select(F.explode(F.array("a", "b")).alias("class_id")).groupBy("class_id").agg(F.count(F.lit(1)).alias("links"))
    classes = signed.groupBy("class_id").agg(F.min("id").alias("first"))
    found = components(links).withColumnRenamed("node", "class_id")
    placed = classes.join(found, "class_id", "left").withColumn("component", F.coalesce("component", "class_id"))
    named = placed.join(placed.groupBy("component").agg(F.min("first").alias("group_id")), "component").join(degree, "class_id", "left")
    members = signed.select("id", "class_id").distinct()
    return members.join(named, "class_id").select("id", F.col("first").alias("class_id"), "group_id", F.coalesce("links", F.lit(0)).alias("links")).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, component) by alternating large and small stars; the label is the smallest node.

    Each round is a few shuffles over the links; lineage is cut after each. Long chains take a
    number of rounds that grows with the logarithm of their length.
    """
    links = cut_lineage(edges.select(F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v")).where("u <> v").distinct())
    while True:
        both = links.union(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        lowest = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(lowest, "u").where("v > u").select(F.col("m").alias("u"), "v").where("u <> v").distinct()
        down = large.select(F.greatest("u", "v").alias("v"), F.least("u", "v").alias("u"))
        least = down.groupBy("v").agg(F.min("u").alias("m"))
        small = down.join(least, "v").select(F.col("m").alias("u"), F.explode(F.array("v", "u")).alias("w")).where("u <> w")
        new = cut_lineage(small.select("u", F.col("w").alias("v")).distinct())
        if new.exceptAll(links).isEmpty() and links.exceptAll(new).isEmpty():
            return new.select(F.col("v").alias("node"), F.col("u").alias("component")).union(new.select("u", "u").distinct())
        links = new
