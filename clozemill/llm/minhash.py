r"""Near-duplicates by one-permutation hashing with optimal densification.

1. Each text becomes the set of its distinct word shingles (64-bit hashes; a text of fewer words is
   one shingle). One hash fills all bins: its top bits choose the bin, the least value of a bin
   stays. Empty bins copy a filled one, found along a fixed permutation of their own.
2. Texts with equal sets are one class, so a thousand copies are one node.
3. Rows of bins make bands. In each bucket that several classes share, every member is paired with
   one centre only, the member with the fullest buckets: the pairs are at most as many as the
   bucket entries, however large a bucket is.
4. Each pair is confirmed on full sets. Two members that the centre does not link may still be
   similar: members of one centre that are in different components are compared block by block
   inside tasks, and only confirmed links between components leave a task.
5. Links become components; a text's component is the smallest id reachable.

With 32 bands of 4 rows a link at the limit of 0.8 shares no bucket with probability 5e-8.

Null, empty and blank texts have an empty set, no links, and stay. Equal rows get equal results.
``doc_id`` has to name one text. An empty table gives an empty result; further columns are ignored. Very long texts are
read whole by their task; which text of a bucket is the centre changes no result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clozemill.llm.common import SPACED, STEP, frames, mixed, stage, starts_of, type_of, words
from clozemill.llm.components import connected

BLOCK_BYTES = 4 << 20
MEMBER_BYTES = 2048  # of a member beside its set: at most 2,048 members make a block


def shingle_sets(data, offsets, size: int):
    """Sorted distinct shingle hashes of a piece and where each text's set begins."""
    n = len(offsets) - 1
    value, doc, _, _ = words(data, offsets, SPACED)
    first = starts_of(doc, n)
    step = np.uint64(STEP)
    hashes, owner = np.empty(0, np.uint64), np.empty(0, np.int64)
    if len(value) >= size:
        m = len(value) - size + 1
        acc = value[:m].copy()
        for j in range(1, size):
            acc = acc * step + value[j:j + m]
        whole = doc[:m] == doc[size - 1:]
        hashes, owner = mixed(acc[whole]), doc[:m][whole]
    count = np.diff(first)
    short = np.flatnonzero((count > 0) & (count < size))
    if len(short):
        acc = value[first[short]].copy()
        for j in range(1, size - 1):
            more = count[short] > j
            acc[more] = acc[more] * step + value[first[short[more]] + j]
        acc = mixed(acc ^ mixed(count[short].astype(np.uint64)))
        order = np.argsort(np.concatenate([owner, short]), kind="stable")
        hashes = np.concatenate([hashes, acc])[order]
        owner = np.concatenate([owner, short])[order]
    begin = starts_of(owner, n)
    for s, e in zip(begin[:-1].tolist(), begin[1:].tolist()):
        if e - s > 1:
            hashes[s:e].sort()
    new = np.ones(len(hashes), bool)
    new[1:] = (hashes[1:] != hashes[:-1]) | (owner[1:] != owner[:-1])
    hashes, owner = hashes[new], owner[new]
    return hashes, owner, starts_of(owner, n)


def permutations(bins: int) -> np.ndarray:
    """Row i is the order in which empty bin i looks for a filled one."""
    return np.argsort(np.random.default_rng(7).random((bins, bins)), axis=1)


def band_hashes(hashes, owner, n: int, bands: int, rows: int, order: np.ndarray) -> np.ndarray:
    """Band values of each text, one-permutation minima densified; rows of empty sets mean nothing."""
    bins = bands * rows
    shift = np.uint64(64 - int(bins - 1).bit_length())
    place = (hashes >> shift).astype(np.int64) % bins
    key = owner * (bins + 1) + place
    new = np.ones(len(key), bool)
    new[1:] = key[1:] != key[:-1]
    filled = np.zeros((n, bins), bool)
    value = np.zeros((n, bins), np.uint64)
    filled[owner[new], place[new]] = True
    value[owner[new], place[new]] = hashes[new]
    some = filled.any(1)
    for i in range(bins):
        empty = np.flatnonzero(some & ~filled[:, i])
        if len(empty):
            source = order[i][np.argmax(filled[empty][:, order[i]], axis=1)]
            value[empty, i] = value[empty, source]
    acc = np.zeros((n, bands), np.uint64)
    for j in range(rows):
        acc = acc * np.uint64(STEP) + value[:, j::rows]
    return mixed(acc + mixed(np.arange(1, bands + 1, dtype=np.uint64)))


def sketches(docs: DataFrame, id_column: str, text: str, size: int, bands: int, rows: int) -> DataFrame:
    """(id, n_shingles, f1, f2, bands) for every row; f1 and f2 name the set."""
    bins = bands * rows
    if bins & (bins - 1):
        raise ValueError("bands * rows has to be a power of two")

    def work(batches):
        order = permutations(bins)
        for rows_, data, offsets in frames(batches, text):
            n = len(offsets) - 1
            hashes, owner, begin = shingle_sets(data, offsets, size)
            count = np.diff(begin)
            sums = np.zeros((2, len(hashes) + 1), np.uint64)
            sums[0, 1:] = np.cumsum(mixed(hashes + np.uint64(1)))
            sums[1, 1:] = np.cumsum(mixed(hashes ^ np.uint64(STEP)))
            f = (sums[:, begin[1:]] - sums[:, begin[:-1]]).view(np.int64)
            found = band_hashes(hashes, owner, n, bands, rows, order).view(np.int64)
            yield pa.record_batch({
                id_column: rows_.column(rows_.schema.get_field_index(id_column)),
                "n_shingles": pa.array(count), "f1": pa.array(f[0]), "f2": pa.array(f[1]),
                "bands": pa.ListArray.from_arrays(
                    pa.array(np.arange(n + 1, dtype=np.int32) * bands), pa.array(found.ravel())),
            })

    kind = type_of(docs, id_column)
    return docs.select(id_column, text).mapInArrow(
        work, f"{id_column} {kind}, n_shingles long, f1 long, f2 long, bands array<long>")


def full_sets(docs: DataFrame, id_column: str, text: str, size: int) -> DataFrame:
    """(id, set): the sorted distinct shingle hashes as bytes."""

    def work(batches):
        for rows_, data, offsets in frames(batches, text):
            hashes, _, begin = shingle_sets(data, offsets, size)
            yield pa.record_batch({
                id_column: rows_.column(rows_.schema.get_field_index(id_column)),
                "set": pa.array([hashes[s:e].tobytes() for s, e in zip(begin[:-1], begin[1:])],
                                pa.binary()),
            })

    return docs.select(id_column, text).mapInArrow(
        work, f"{id_column} {type_of(docs, id_column)}, set binary")


def confirm(pairs: DataFrame, percent: int) -> DataFrame:
    """Add ``linked`` to rows with ``set`` and ``center_set``."""

    def work(batches):
        for batch in batches:
            left, right = batch.column("set"), batch.column("center_set")
            linked = []
            for a, b in zip(left, right):
                a = np.frombuffer(a.as_buffer(), np.uint64)
                b = np.frombuffer(b.as_buffer(), np.uint64)
                small, large = (a, b) if len(a) < len(b) else (b, a)
                if 100 * len(small) < percent * len(large):
                    linked.append(False)
                    continue
                at = np.minimum(np.searchsorted(large, small), len(large) - 1)
                both = int((large[at] == small).sum())
                linked.append(100 * both >= percent * (len(a) + len(b) - both))
            yield pa.record_batch({
                "rep": batch.column("rep"), "center": batch.column("center"),
                "linked": pa.array(linked, pa.bool_())})

    kind = type_of(pairs, "rep")
    return pairs.select("rep", "center", "set", "center_set").mapInArrow(
        work, f"rep {kind}, center {kind}, linked boolean")


def star_pairs(classes: DataFrame) -> DataFrame:
    """(rep, center): every member of a shared bucket with the bucket's centre."""
    entries = classes.select("rep", F.explode("bands").alias("b"))
    shared = entries.groupBy("b").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    entries = stage(entries.join(shared, "b"))
    score = entries.groupBy("rep").agg(F.sum("n").alias("score"))
    centers = entries.join(score, "rep").groupBy("b").agg(
        F.max(F.struct("score", "rep"))["rep"].alias("center"))
    return entries.join(centers, "b").where("rep <> center").select("rep", "center").distinct()


def block_links(pairs: DataFrame, percent: int) -> DataFrame:
    """Links between components, (u, v), from pairs of packed blocks ``a`` and ``b``."""

    def unpack(block):
        sets = [np.frombuffer(x["set"], np.uint64) for x in block]
        return sets, np.array([len(x) for x in sets]), [x["comp"] for x in block]

    def incidence(sets, part):
        grid = np.zeros((len(sets), len(part)), np.float32)
        for k, s in enumerate(sets):
            own = s[np.searchsorted(s, part[0]):np.searchsorted(s, part[-1], "right")]
            j = np.minimum(np.searchsorted(part, own), len(part) - 1)
            grid[k, j[part[j] == own]] = 1
        return grid

    def links(a, b, same):
        sets_a, n_a, comp_a = unpack(a)
        sets_b, n_b, comp_b = (sets_a, n_a, comp_a) if same else unpack(b)
        names, inverse = np.unique(np.array(comp_a + comp_b, object), return_inverse=True)
        main = np.bincount(inverse).argmax()
        c_a, c_b = inverse[:len(comp_a)], inverse[len(comp_a):]
        apart = c_a[:, None] != c_b[None, :]
        if not apart.any():
            return []
        # A shingle of one text alone is in no intersection.
        if same:
            every, count = np.unique(np.concatenate(sets_a), return_counts=True)
            shared = every[count > 1]
        else:
            shared = np.intersect1d(np.concatenate(sets_a), np.concatenate(sets_b))
        both = np.zeros(apart.shape, np.float32)
        rows, columns = np.flatnonzero(c_a != main), np.flatnonzero(c_b != main)
        rest = np.flatnonzero(c_a == main)
        for at in range(0, len(shared), 4096):
            part = shared[at:at + 4096]
            x = incidence(sets_a, part)
            y = x if same else incidence(sets_b, part)
            # Pairs inside the largest component need no test.
            both[rows] += x[rows] @ y.T
            both[np.ix_(rest, columns)] += x[rest] @ y[columns].T
        both = both.astype(np.int64)
        near = apart & (100 * both >= percent * (n_a[:, None] + n_b[None, :] - both))
        found = {}
        for i, j in zip(*np.nonzero(near)):
            found[min(comp_a[i], comp_b[j]), max(comp_a[i], comp_b[j])] = True
        return list(found)

    def work(batches):
        for batch in batches:
            for row in range(batch.num_rows):
                same = batch.column("same")[row].as_py()
                found = links(batch.column("a")[row].as_py(),
                              None if same else batch.column("b")[row].as_py(), same)
                yield pa.record_batch(
                    {"u": pa.array([x[0] for x in found], batch.schema.field("rep").type),
                     "v": pa.array([x[1] for x in found], batch.schema.field("rep").type)})

    kind = type_of(pairs, "rep")
    return pairs.select("rep", "a", "b", "same").mapInArrow(work, f"u {kind}, v {kind}").distinct()


def rest_links(stars: DataFrame, sets: DataFrame, sizes: DataFrame, labels: DataFrame, percent: int,
               block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Links that a star does not test: members of one centre in different components.

    A centre's members are dealt over blocks of bounded bytes by a hash of their id; each task
    compares two blocks.
    """
    members = stars.select("rep", "center").unionByName(
        stars.select(F.col("center").alias("rep"), "center").distinct())
    members = members.join(labels, "rep", "left").withColumn("comp", F.coalesce("label", "rep"))
    members = members.join(sizes.select("rep", "n_shingles"), "rep")
    open_ = members.groupBy("center").agg(
        F.count(F.lit(1)).alias("n"), F.sum(8 * F.col("n_shingles") + MEMBER_BYTES).alias("bytes"),
        F.min("comp").alias("low"), F.max("comp").alias("high"),
    ).where("n > 2 and low <> high").select(
        "center", F.ceil(F.col("bytes") / block_bytes).cast("int").alias("blocks"))
    # Sets are fetched only for members of centres that still have something to compare.
    packed = stage(members.join(open_, "center").join(sets.select("rep", "set"), "rep").withColumn(
        "block", F.pmod(F.xxhash64("rep"), F.col("blocks"))
    ).groupBy("center", "block").agg(F.collect_list(F.struct("comp", "set")).alias("items")))
    other = packed.select("center", F.col("block").alias("block_b"), F.col("items").alias("b"))
    pairs = packed.withColumnRenamed("items", "a").join(other, "center").where("block <= block_b").select(
        "center", "a", F.when(F.col("block") < F.col("block_b"), F.col("b")).alias("b"),
        (F.col("block") == F.col("block_b")).alias("same"))
    return block_links(pairs.withColumnRenamed("center", "rep"), percent)


def components(docs: DataFrame, id_column: str = "doc_id", text: str = "text", size: int = 5,
               percent: int = 80, bands: int = 32, rows: int = 4,
               block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(id, n_shingles, component_id, kept) for every row of ``docs``."""
    docs = docs.select(F.col(id_column).alias("_id"), F.col(text).alias("_text"))
    sketch = stage(sketches(docs, "_id", "_text", size, bands, rows))
    filled = sketch.where("n_shingles > 0 and _id is not null")
    classes = filled.groupBy("f1", "f2", "n_shingles").agg(
        F.min(F.struct("_id", "bands")).alias("m")
    ).select("f1", "f2", "n_shingles", F.col("m._id").alias("rep"), "m.bands")
    classes = stage(classes)
    stars = stage(star_pairs(classes))
    needed = stars.select("rep").unionByName(stars.select(F.col("center").alias("rep"))).distinct()
    # The same plan at every size: a broadcast of the ids would only serve small inputs.
    chosen = docs.withColumnRenamed("_id", "rep").join(needed.hint("merge"), "rep").dropDuplicates(["rep"])
    sets = stage(full_sets(chosen, "rep", "_text", size))
    tested = stars.join(sets, "rep").join(
        sets.select(F.col("rep").alias("center"), F.col("set").alias("center_set")), "center")
    tested = stage(confirm(tested, percent))
    labels = stage(connected(tested.where("linked"), "rep", "center")
                   .withColumnRenamed("node", "rep"))
    more = stage(rest_links(tested, sets, classes, labels, percent, block_bytes))
    if not more.isEmpty():
        joined = connected(more, "u", "v").select(
            F.col("node").alias("label"), F.col("label").alias("top"))
        # A component of one class has no label of its own yet.
        ends = more.select(F.col("u").alias("rep")).unionByName(more.select(F.col("v").alias("rep")))
        alone = ends.distinct().join(labels, "rep", "left_anti")
        labels = labels.unionByName(alone.select("rep", F.col("rep").alias("label")))
        labels = labels.join(joined, "label", "left").select(
            "rep", F.coalesce("top", "label").alias("label"))
    named = classes.join(labels, "rep", "left").select(
        "f1", "f2", "n_shingles", F.coalesce("label", "rep").alias("_c"))
    return sketch.join(named, ["f1", "f2", "n_shingles"], "left").select(
        F.col("_id").alias(id_column), "n_shingles",
        F.coalesce("_c", "_id").alias("component_id"),
    ).withColumn("kept", F.col(id_column).eqNullSafe(F.col("component_id")))


def query(docs: DataFrame) -> DataFrame:
    return components(docs, size=2)


def kept_documents(docs: DataFrame) -> DataFrame:
    """One row of each group of near-duplicates, with its own columns."""
    kept = components(docs).where("kept").select("doc_id").distinct()
    once_ = docs.where("doc_id is not null").join(kept, "doc_id").dropDuplicates(["doc_id"])
    return once_.select(docs.columns).unionByName(docs.where("doc_id is null"))
