"""Exact repeats by a depth-limited radix sort of suffixes, most significant digit first.

A byte goes if a string of ``length`` bytes around it also starts in a document of smaller id. Suffixes
need an order only through ``length`` bytes. Those that begin at synchronising positions stand for all:
equal strings of ``length`` bytes hold such a position (an anchor) at the same place, about one byte
in sixteen is one. The passes:

1. First digit: the gram at the anchor, dealt over buckets by its hash. A group whose gram is in one
   document only is sorted far enough and leaves. Each group of documents sends a gram once, with a
   count, so the commonest passage is one entry for each of them; the answer is one byte for each.
2. Remaining digits: the bytes around the anchor, through ``length`` bytes for each place the anchor
   can have in a string. Entries that still agree at full depth are exactly the repeated strings;
   they are compared byte by byte, and those of larger ids are marked.
3. Marks go back to the documents, whose texts were dealt out once and are read again in place.

A gram that stands in more than ``hot`` documents with ever new surroundings is split: its strings are
dealt one by one under a 128-bit hash, each once for each group of documents. Copies of a whole text
are found first by SHA-256 and take no part in the passes. Nothing is sampled or left out.

Null texts are empty; nothing is removed from texts under ``length`` bytes. Rows with one id never
remove each other's bytes; a null id counts as the largest. A text is held whole by its task. Equal rows with
ids of their own are copies: the least id keeps its bytes. An empty table gives no rows; only the id and the text
are read, so other columns may have any name.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clozemill.llm.anchors import anchors
from clozemill.llm.common import INVERSE, STEP, frames, mixed, powers

LENGTH = 50
GROUP_BYTES = 8 << 20
HOT = 1 << 15
LARGEST = np.iinfo(np.int64).max
BACK = "r long, kind int, bucket long, a binary, b binary"
SENT = "bucket long, g long, hot boolean, h binary, id binary, side binary, bytes binary"


class Group:
    """The documents of one group with their anchors, without copies."""

    def __init__(self, docs: pa.Table, back: pa.Table, length: int, gram: int, buckets: int):
        self.length, self.gram, self.width, self.buckets = length, gram, length - gram + 1, buckets
        copy = back.column("bucket").to_numpy()[back.column("kind").to_numpy() == 0]
        ids = docs.column("id")
        self.pieces, codes = [], []
        at = 0
        for rows, data, offsets in frames(docs.select(["id", "text"]).to_batches(), "text"):
            own = rows.column(0).to_numpy(zero_copy_only=False)
            position, owner, h, sums = anchors(data, offsets, gram, self.width)
            if len(copy):
                live = ~np.isin(own, copy)[owner]
                position, owner, h = position[live], owner[live], h[live]
            self.pieces.append((own, data, offsets, position, owner, h, sums))
            codes.append(((h % np.uint64(buckets)) << np.uint64(32)) | (h >> np.uint64(32)))
            at += len(own)
        self.rows, self.copies = len(ids), copy
        self.codes = codes
        every = np.concatenate(codes) if codes else np.empty(0, np.uint64)
        self.known = np.unique(every)

    def counted(self):
        """Documents of this group for each known code, at most 255."""
        every = np.concatenate(self.codes)
        ids = np.concatenate([p[0][p[4]] for p in self.pieces])
        order = np.lexsort((ids, every))
        every, ids = every[order], ids[order]
        new = np.ones(len(every), bool)
        new[1:] = (every[1:] != every[:-1]) | (ids[1:] != ids[:-1])
        return np.minimum(np.bincount(np.searchsorted(self.known, every[new]),
                                      minlength=len(self.known)), 255).astype(np.uint8)

    def cuts(self, bucket: np.ndarray):
        """(bucket, from, to) of the runs of a sorted column."""
        first = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]]) if len(bucket) else []
        return [(int(bucket[s]), s, e) for s, e in zip(first, [*first[1:], len(bucket)])]

    def flagged(self, back: pa.Table):
        """For each piece the flags of its anchors: 0 done, 1 go on, 2 hot."""
        rows = back.filter(pa.array(back.column("kind").to_numpy() == 1)).sort_by("bucket")
        flags = np.concatenate([np.empty(0, np.uint8), *[
            np.frombuffer(x.as_buffer(), np.uint8) for x in rows.column("a")]])
        return [flags[np.searchsorted(self.known, c)] for c in self.codes]

    def entries(self, back: pa.Table):
        """Distinct surroundings of the anchors that go on, ordered by bucket; for each piece the
        anchors and their entries. Then the same for the strings of hot anchors."""
        w, q = self.width, self.gram
        span = np.arange(-(w - 1), q + w - 1)
        flags = self.flagged(back)
        key, h_all, ids, sides, around, where = [], [], [], [], [], []
        for (own, data, offsets, position, owner, h, sums), flag in zip(self.pieces, flags):
            left = np.minimum(position - offsets[owner], w - 1)
            right = np.minimum(offsets[owner + 1] - position - q, w - 1)
            on = np.flatnonzero((flag == 1) & (left + right >= w - 1))
            p, lo, hi = position[on], left[on], right[on]
            at = p[:, None] + span
            held = (span >= -lo[:, None]) & (span < (q + hi)[:, None])
            bytes_ = data[np.clip(at, 0, max(len(data) - 1, 0))] * held
            whole = (sums[p + q + hi] - sums[p - lo]) * powers(INVERSE, len(data) + 1)[p - lo]
            key.append(mixed(whole + (lo * 64 + hi).astype(np.uint64) * np.uint64(STEP)))
            h_all.append(h[on])
            ids.append(own[owner[on]])
            sides.append(np.stack([lo, hi], 1).astype(np.uint8))
            around.append(bytes_.astype(np.uint8))
            where.append(on)
        normal = self._distinct(key, h_all, ids, sides, around) + (where,)
        return normal, self._hot(flags)

    def _distinct(self, key, h, ids, sides, around):
        key, h, ids = (np.concatenate(x) for x in (key, h, ids))
        sides, around = np.concatenate(sides), np.concatenate(around)
        bucket = (h % np.uint64(self.buckets)).astype(np.int64)
        order = np.lexsort((ids, key, bucket))
        b, k = bucket[order], key[order]
        new = np.ones(len(order), bool)
        new[1:] = (b[1:] != b[:-1]) | (k[1:] != k[:-1])
        same = np.cumsum(new) - 1
        head = order[new]
        # An entry whose bytes differ from its namesake's keeps an entry of its own.
        odd = (around[order] != around[head[same]]).any(1)
        if odd.any():
            new |= odd
            new[1:] |= odd[:-1]
            same = np.cumsum(new) - 1
            head = order[new]
        entry = np.empty(len(order), np.int64)
        entry[order] = same
        return bucket[head], h[head], ids[head], sides[head], around[head], entry, ids

    def _hot(self, flags):
        """Strings around hot anchors: bucket, both hashes, least id; and where they start."""
        starts, k1, k2, ids = [], [], [], []
        for (own, data, offsets, position, owner, h, sums), flag in zip(self.pieces, flags):
            on = np.flatnonzero(flag == 2)
            s = (position[on, None] - np.arange(self.width)).ravel()
            d = np.repeat(owner[on], self.width)
            fits = (s >= offsets[d]) & (s + self.length <= offsets[d + 1])
            s, first = np.unique(s[fits], return_index=True)
            d = d[fits][first]
            n = len(data) + 1
            inverse = pow(STEP, -1, 1 << 64)
            other = np.zeros(n, np.uint64)
            if len(s):
                np.cumsum((data + np.uint16(1)).astype(np.uint64) * powers(STEP, n - 1), out=other[1:])
            k1.append(mixed((sums[s + self.length] - sums[s]) * powers(INVERSE, n)[s]))
            k2.append(mixed((other[s + self.length] - other[s]) * powers(inverse, n)[s]))
            ids.append(own[d])
            starts.append(s)
        k1, k2, ids = (np.concatenate(x) for x in (k1, k2, ids))
        bucket = (k1 % np.uint64(self.buckets)).astype(np.int64)
        order = np.lexsort((ids, k2, k1, bucket))
        new = np.ones(len(order), bool)
        new[1:] = (k1[order][1:] != k1[order][:-1]) | (k2[order][1:] != k2[order][:-1])
        head = order[new]
        entry = np.empty(len(order), np.int64)
        entry[order] = np.cumsum(new) - 1
        return bucket[head], k1[head], k2[head], ids[head], entry, ids, starts


def _table(rows: list[dict], schema: str) -> pa.Table:
    kinds = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary(), "boolean": pa.bool_()}
    fields = [f.split(" ") for f in schema.split(", ")]
    return pa.table({n: pa.array([r.get(n) for r in rows], kinds[t]) for n, t in fields})


def send_codes(group: Group, g: int) -> pa.Table:
    counts = group.counted() if group.rows else np.empty(0, np.uint8)
    low = (group.known & np.uint64(0xFFFFFFFF)).astype(np.uint32)
    return _table([
        {"bucket": b, "g": g, "a": low[s:e].tobytes(), "b": counts[s:e].tobytes()}
        for b, s, e in group.cuts((group.known >> np.uint64(32)).astype(np.int64))
    ], "bucket long, g long, a binary, b binary")


def answer_codes(rows: pa.Table, hot: int) -> pa.Table:
    lists = [np.frombuffer(x.as_buffer(), np.uint32) for x in rows.column("a")]
    counts = np.concatenate([np.frombuffer(x.as_buffer(), np.uint8) for x in rows.column("b")])
    _, number = np.unique(np.concatenate(lists), return_inverse=True)
    total = np.bincount(number, counts)
    flags = np.where(total < 2, 0, np.where(total > hot, 2, 1)).astype(np.uint8)[number]
    ends = np.cumsum([len(x) for x in lists])
    return _table([
        {"r": g, "kind": 1, "bucket": b, "a": flags[e - len(x):e].tobytes()}
        for g, b, x, e in zip(rows.column("g").to_pylist(), rows.column("bucket").to_pylist(), lists, ends)
    ], BACK)


def send_entries(group: Group, back: pa.Table, g: int) -> pa.Table:
    normal, hot = group.entries(back)
    bucket, h, ids, sides, around = normal[:5]
    out = [{"bucket": b, "g": g, "hot": False, "h": h[s:e].tobytes(), "id": ids[s:e].tobytes(),
            "side": sides[s:e].tobytes(), "bytes": around[s:e].tobytes()}
           for b, s, e in group.cuts(bucket)]
    bucket, k1, k2, ids = hot[:4]
    out += [{"bucket": b, "g": g, "hot": True, "h": k1[s:e].tobytes(), "id": ids[s:e].tobytes(),
             "side": b"", "bytes": k2[s:e].tobytes()} for b, s, e in group.cuts(bucket)]
    return _table(out, SENT)


def later(ids: np.ndarray, *keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Whether an equal key has a smaller id, and the row with the smallest id of that key."""
    order = np.lexsort((ids, *keys))
    new = np.zeros(len(order), bool)
    new[:1] = True
    for k in keys:
        new[1:] |= k[order][1:] != k[order][:-1]
    head = np.empty(len(order), np.int64)
    head[order] = order[new][np.cumsum(new) - 1]
    return ids > ids[head], head


def marks(h, ids, sides, around, length: int, gram: int) -> np.ndarray:
    """(entries, places): the string with the anchor at that place also starts in a smaller id."""
    w = length - gram + 1
    out = np.zeros((len(h), w), bool)
    order = np.argsort(h, kind="stable")
    first = np.flatnonzero(np.r_[True, h[order][1:] != h[order][:-1]])
    size = np.diff(np.r_[first, len(order)])
    order = order[np.repeat(size > 1, size)]
    at = 0
    while at < len(order):
        end = min(at + 20_000, len(order))
        while end < len(order) and h[order[end]] == h[order[end - 1]]:
            end += 1
        own = order[at:end]
        grid = around[own]
        sums = np.zeros((len(own), grid.shape[1] + 1), np.uint64)
        np.cumsum((grid + np.uint16(1)).astype(np.uint64) * powers(STEP, grid.shape[1]), axis=1,
                  out=sums[:, 1:])
        for j in range(w):
            fit = np.flatnonzero((sides[own, 0] >= j) & (sides[own, 1] >= w - 1 - j))
            if len(fit) < 2:
                continue
            s = w - 1 - j
            key = mixed(sums[fit, s + length] - sums[fit, s]) ^ h[own[fit]]
            found, head = later(ids[own[fit]], key)
            hit = np.flatnonzero(found)
            same = (grid[fit[hit], s:s + length] == grid[fit[head[hit]], s:s + length]).all(1)
            if not same.all():  # two strings with one hash: sort the strings themselves
                text = np.ascontiguousarray(grid[fit, s:s + length]).view(f"V{length}").ravel()
                _, name = np.unique(text, return_inverse=True)
                hit, same = np.flatnonzero(later(ids[own[fit]], name)[0]), slice(None)
            out[own[fit[hit[same]]], j] = True
        at = end
    return out


def answer_entries(rows: pa.Table, length: int, gram: int) -> pa.Table:
    out = []
    width = gram + 2 * (length - gram)
    for hot in (False, True):
        own = rows.filter(pa.array(rows.column("hot").to_numpy(zero_copy_only=False) == hot))
        if not own.num_rows:
            continue
        load = lambda name, kind: np.concatenate(
            [np.frombuffer(x.as_buffer(), kind) for x in own.column(name)])
        h, ids = load("h", np.uint64), load("id", np.int64)
        if hot:
            found = later(ids, load("bytes", np.uint64), h)[0][:, None]
        else:
            found = marks(h, ids, load("side", np.uint8).reshape(-1, 2),
                          load("bytes", np.uint8).reshape(-1, width), length, gram)
        ends = np.cumsum([len(x) // 8 for x in own.column("h").to_pylist()])
        begin = np.r_[0, ends[:-1]]
        out += [{"r": g, "kind": 3 if hot else 2, "bucket": b,
                 "a": np.packbits(found[s:e], axis=1).tobytes()}
                for g, b, s, e in zip(own.column("g").to_pylist(), own.column("bucket").to_pylist(),
                                      begin, ends)]
    return _table(out, BACK)


def removed(group: Group, back: pa.Table, kept: bool) -> pa.Table:
    """One row for each document of the group."""
    normal, hot = group.entries(back)
    w, length = group.width, group.length

    def load(kind: int, width: int) -> np.ndarray:
        rows = back.filter(pa.array(back.column("kind").to_numpy() == kind)).sort_by("bucket")
        bits = np.frombuffer(b"".join(rows.column("a").to_pylist()), np.uint8)
        return np.unpackbits(bits.reshape(-1, -(-width // 8)), axis=1, count=width).astype(bool)

    mark = load(2, w)
    entry, ids = normal[5], normal[6]
    every = mark[entry] | (ids > normal[2][entry])[:, None]
    mark_hot = load(3, 1)[:, 0]
    every_hot = mark_hot[hot[4]] | (hot[5] > hot[3][hot[4]])
    place = np.arange(w)
    at = at_hot = 0
    out = {"id": [], "n_bytes": [], "n_removed": [], "spans": [], "kept": [], "sha": []}
    for (own, data, offsets, position, owner, h, sums), on, s_hot in zip(group.pieces, normal[7], hot[6]):
        n = len(data)
        begins = np.zeros(n + 1, np.int64)
        p = position[on]
        start = p[:, None] - place
        d = owner[on][:, None]
        fits = (start >= offsets[d]) & (start + length <= offsets[d + 1])
        begins[start[every[at:at + len(on)] & fits]] = 1
        at += len(on)
        begins[s_hot[every_hot[at_hot:at_hot + len(s_hot)]]] = 1
        at_hot += len(s_hot)
        seen = np.r_[0, np.cumsum(begins[:n])]
        gone = seen[1:] > seen[np.maximum(np.arange(n) + 1 - length, 0)]
        copy = np.isin(own, group.copies) if len(group.copies) else np.zeros(len(own), bool)
        for i in np.flatnonzero(copy & (np.diff(offsets) >= length)).tolist():
            gone[offsets[i]:offsets[i + 1]] = True
        edge = np.zeros(n + 1, bool)
        edge[offsets] = True
        first = np.flatnonzero(gone & (edge[:n] | ~np.r_[False, gone[:-1]]))
        last = np.flatnonzero(gone & (edge[1:] | ~np.r_[gone[1:], False])) + 1
        runs = np.searchsorted(first, offsets)
        for i in range(len(own)):
            s, e = int(offsets[i]), int(offsets[i + 1])
            a, b = int(runs[i]), int(runs[i + 1])
            rest = data[s:e] if a == b else data[s:e][~gone[s:e]]
            out["spans"].append([{"s": int(x) - s, "e": int(y) - s}
                                 for x, y in zip(first[a:b], last[a:b])])
            out["n_removed"].append(e - s - len(rest))
            out["n_bytes"].append(e - s)
            rest = rest.tobytes()
            out["sha"].append(hashlib.sha256(rest).hexdigest())
            out["kept"].append(rest if kept else None)
        out["id"].append(own)
    ids = np.concatenate(out["id"]) if out["id"] else np.empty(0, np.int64)
    span = pa.list_(pa.struct([("s", pa.int64()), ("e", pa.int64())]))
    return pa.table({
        "id": pa.array(ids, mask=ids == LARGEST), "n_bytes": pa.array(out["n_bytes"], pa.int64()),
        "n_removed": pa.array(out["n_removed"], pa.int64()), "spans": pa.array(out["spans"], span),
        "kept_sha256": pa.array(out["sha"], pa.string()), "kept": pa.array(out["kept"], pa.binary())})


def copies(docs: DataFrame) -> DataFrame:
    """(r, kind 0, id) of the texts that a smaller id has whole."""
    named = docs.where(f"id < {LARGEST}").select("g", "id", F.sha2("text", 256).alias("t"))
    least = named.groupBy("t").agg(F.min("id").alias("m"), F.count(F.lit(1)).alias("n")).where("n > 1")
    return named.join(least, "t").where("id > m").select(
        F.col("g").alias("r"), F.lit(0).alias("kind"), F.col("id").alias("bucket"),
        F.lit(None).cast("binary").alias("a"), F.lit(None).cast("binary").alias("b"))


def dedup(docs: DataFrame, id_column: str = "doc_id", text: str = "text", length: int = LENGTH,
          hot: int = HOT, group_bytes: int = GROUP_BYTES, kept: bool = False) -> DataFrame:
    """(id, n_bytes, n_removed, spans, kept_sha256, kept) for every row; spans are byte ranges."""
    gram = length * 2 // 5
    total = docs.agg(F.sum(F.octet_length(text))).first()[0] or 0
    parts = max(1, -(-total // group_bytes))
    base = docs.select(
        F.coalesce(F.col(id_column).cast("long"), F.lit(int(LARGEST))).alias("id"),
        F.coalesce(F.col(text), F.lit("")).alias("text"),
    ).withColumn("g", F.pmod(F.xxhash64("id"), F.lit(parts)))
    whole = copies(base)

    def codes(key, left, right):
        return send_codes(Group(left, right, length, gram, parts), key[0].as_py())

    def entries(key, left, right):
        return send_entries(Group(left, right, length, gram, parts), right, key[0].as_py())

    def result(key, left, right):
        return removed(Group(left, right, length, gram, parts), right, kept)

    texts = base.groupBy("g")
    asked = texts.cogroup(whole.groupBy("r")).applyInArrow(
        codes, "bucket long, g long, a binary, b binary")
    flags = whole.unionByName(asked.groupBy("bucket").applyInArrow(
        lambda rows: answer_codes(rows, hot), BACK))
    sent = texts.cogroup(flags.groupBy("r")).applyInArrow(entries, SENT)
    found = sent.groupBy("bucket").applyInArrow(
        lambda rows: answer_entries(rows, length, gram), BACK)
    return texts.cogroup(flags.unionByName(found).groupBy("r")).applyInArrow(
        result, "id long, n_bytes long, n_removed long, spans array<struct<s:long,e:long>>, "
                "kept_sha256 string, kept binary").withColumnRenamed("id", id_column)


def query(docs: DataFrame) -> DataFrame:
    return dedup(docs).select(
        "doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), "kept_sha256")
