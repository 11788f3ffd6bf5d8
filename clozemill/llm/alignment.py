r"""Alignment of two tokenizers: how often their tokens overlap in a corpus, and how usual each document's links are.

A text (with a space in front) is encoded by A, byte-level BPE, and by B, pieces with byte fallback. Where
tokens of both end at one byte, a group ends. Two tokens are linked where their byte ranges overlap; a pair of
ids counts its links in the whole corpus.

1. First pass: documents are aligned; each task hands on its distinct pairs with their links.
2. Distinct pairs are dealt to shards by hash, and each shard gets a minimal perfect hash: a pair takes the
   slot its hash of the level names if no other pair of the level does, else it goes to the next level; the
   slot's rank among those taken is its number. The key of every number is kept, so that a pair that was
   never seen is told apart.
3. Each task adds its links into dense vectors indexed by that number, and the vectors are summed up a
   tree, ``FAN`` at a time.
4. Second pass: documents are aligned again and their links looked up by hash, key and vector.

The lookup table is broadcast in blocks of at most ``BLOCK`` pairs (17 bytes a pair): one block for the
vocabularies of most corpora. With more, a pass is made for each block and the sums of the blocks are added.

A text is cut before each space between two characters that are no white space. Neither tokenizer joins
across such a cut (A splits there first; no piece of B has a space behind another character), so tokens and groups of a
piece do not depend on its surroundings, and equal pieces of a task are encoded once. Both encoders
run on the same piece; that token ends fall on piece ends is checked, and pieces where they do not are encoded alone.

Null and empty texts, and texts that a tokenizer does not give back byte by byte, have no tokens: zeros and an
empty string. Specials in a text are plain text. Equal rows get equal results, null and repeated ids too; ties
for the most frequent partner all count. Very long texts are read whole. An empty table gives no rows. Only id
and text are read, so other columns may have any name. Texts are never shuffled.
"""

from __future__ import annotations

import hashlib
import json
import re
from functools import cached_property
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clozemill.llm.common import mixed, stage, type_of

FOLDER = "/opt/tokenizers"
FILES = ("byte_bpe_50k.json", "piece_bpe_32k.model")
#: A pair is one number: id of A times SPAN, plus id of B.
SPAN = 1 << 16
SHARD = 1 << 16
BLOCK = 1 << 22
SEGMENT = 1 << 16
FAN = 16
#: Pieces that are encoded as one text.
BLOCK_PIECES = 1024
KNOWN = 1 << 19
LONG = 256
#: Below this letter the character classes are the same in every version of Unicode.
FAST = "ɐ"

STRETCH = re.compile(rf"\S{{{LONG}}}|\s{{{LONG}}}")
CUT = re.compile(r" (?<![\s▁] )(?=\S)")
# The pre-token pattern of A, a fixed value of its file format.
PRE_TOKEN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


# --- the two encoders ----------------------------------------------------------------------

def read_files(folder: str = FOLDER) -> tuple[str, bytes]:
    """Both vocabulary files, read by the driver; a few megabytes, sent to the tasks."""
    with open(f"{folder}/{FILES[0]}", encoding="utf-8") as a, open(f"{folder}/{FILES[1]}", "rb") as b:
        return a.read(), b.read()


def byte_letters() -> dict[str, int]:
    """The letters that byte-level BPE writes for bytes: printable ones themselves, others from 256 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {**{chr(b): b for b in plain}, **{chr(256 + i): b for i, b in enumerate(rest)}}


class Encoders:
    """A and B with the bytes of each of their tokens."""

    def __init__(self, a_json: str, b_model: bytes):
        import sentencepiece
        import tiktoken

        self.a_json = a_json
        self.b = sentencepiece.SentencePieceProcessor(model_proto=b_model)
        spec, letter = json.loads(a_json), byte_letters()
        own = {i: t.encode() for t, i in ((t["content"], t["id"]) for t in spec["added_tokens"])}
        ranks = {bytes(letter[c] for c in t): i for t, i in spec["model"]["vocab"].items() if i not in own}
        own.update({i: t for t, i in ranks.items()})
        self.a_bytes = [own.get(i, b"") for i in range(max(own) + 1)]
        numbers = list(range(self.b.get_piece_size()))
        self.b_bytes = [bytes([int(p[3:5], 16)]) if is_byte else p.replace("▁", " ").encode()
                        for p, is_byte in zip(self.b.id_to_piece(numbers), self.b.is_byte(numbers))]
        self.a_size = np.array([len(t) for t in self.a_bytes])
        self.b_size = np.array([len(t) for t in self.b_bytes])
        # Ids as they stand first in a text, in a group, behind another id; and behind the other tokenizer's.
        self.a_text, self.a_new, self.a_more = (np.array([f"{x}{i}" for i in range(len(self.a_bytes))], object)
                                                for x in ("", ";", ","))
        self.b_new, self.b_more = (np.array([f"{x}{i}" for i in range(len(self.b_bytes))], object) for x in "|,")
        # The same merges in the same order, for short stretches of letters below FAST.
        self.fast = tiktoken.Encoding("a", pat_str=PRE_TOKEN, mergeable_ranks=ranks, special_tokens={})

    @cached_property
    def a(self):
        from tokenizers import Tokenizer

        out = Tokenizer.from_str(self.a_json)
        out.encode_special_tokens = True
        return out

    def encode(self, text: str, joined: bool = False) -> tuple[np.ndarray, np.ndarray] | None:
        """Token ids of A and B of a space and this text; None where one does not give the bytes back.

        ``joined`` texts have no stretch of over ``LONG`` characters that are all white space or all not."""
        whole = " " + text
        if max(text, default="") < FAST and (joined or not STRETCH.search(text)):
            a = self.fast.encode_ordinary(whole)
        else:
            a = self.a.encode(whole, add_special_tokens=False).ids
        b = self.b.encode(text)
        want = whole.encode()
        a_bytes, b_bytes = self.a_bytes, self.b_bytes
        if b"".join([a_bytes[i] for i in a]) != want or b"".join([b_bytes[i] for i in b]) != want:
            return None
        return np.array(a, np.int64), np.array(b, np.int64)


def aligned(a: np.ndarray, b: np.ndarray, a_size: np.ndarray, b_size: np.ndarray):
    """Byte ends of A and of B, ends both have, and the links (token of A, token of B, byte end)."""
    a_end, b_end = np.cumsum(a_size[a]), np.cumsum(b_size[b])
    # Between two ends of either kind lies one token of each, and overlapping tokens share one such stretch.
    every = np.union1d(a_end, b_end)
    both = np.intersect1d(a_end, b_end, assume_unique=True)
    return a_end, b_end, both, np.searchsorted(a_end, every), np.searchsorted(b_end, every), every


def pieces_of(text: str) -> list[str]:
    """The text cut where neither tokenizer joins; the space before each piece is left out."""
    parts = CUT.split(" " + text)
    return parts[1:] if not parts[0] else [parts[0][1:], *parts[1:]]


class Dictionary:
    """Pieces a task has met: their tokens, links and (if asked for) groups, computed once each."""

    def __init__(self, encoders: Encoders, with_groups: bool):
        self.of, self.with_groups = encoders, with_groups
        self.clear()

    def clear(self) -> None:
        self.number: dict[str, int] = {}
        self.groups: list[str] = []
        self.odd: set[int] = set()
        self.parts: list[tuple[np.ndarray, np.ndarray]] = []

    def add(self, pieces: list[str], alone: set[str]) -> None:
        """Encode pieces that are new; all but those that stand ``alone`` are joined, many at a time."""
        if alone or max(map(len, pieces), default=0) > LONG:
            for p in pieces:
                if p in alone or len(p) > LONG:
                    self.append([p], self.of.encode(p))
            pieces = [p for p in pieces if p not in alone and len(p) <= LONG]
        for at in range(0, len(pieces), BLOCK_PIECES):
            block = pieces[at:at + BLOCK_PIECES]
            # Letters that need the other encoder of A are kept apart.
            sides = [block] if max(map(max, block)) < FAST else [
                [p for p in block if max(p) < FAST], [p for p in block if max(p) >= FAST]]
            for own in sides:
                if own and not self.append(own, self.of.encode(" ".join(own), True)):
                    for p in own:
                        self.append([p], self.of.encode(p))

    def append(self, pieces: list[str], tokens) -> bool:
        """Add pieces from their joined tokens; False if a piece does not end where tokens of both end."""
        if tokens is None:
            if len(pieces) > 1:
                return False
            self.odd.add(len(self.number))
            self.take(pieces, [""], np.zeros((1, 4), np.int64), np.empty(0, np.int64))
            return True
        a, b = tokens
        a_end, b_end, both, link_a, link_b, every = aligned(a, b, self.of.a_size, self.of.b_size)
        ends = np.cumsum([len(p) if p.isascii() else len(p.encode()) for p in pieces]) + np.arange(1, len(pieces) + 1)
        at = np.searchsorted(both, ends)
        if len(pieces) > 1 and not (both[np.minimum(at, len(both) - 1)] == ends).all():
            return False
        counts = np.stack([np.diff(np.searchsorted(x, ends, "right"), prepend=0) for x in (a_end, b_end, both, every)], 1)
        lines = self.written(a, b, a_end, b_end, both, at, counts) if self.with_groups else None
        self.take(pieces, lines, counts, a[link_a] * SPAN + b[link_b])
        return True

    def written(self, a, b, a_end, b_end, both, at, counts) -> list[str]:
        """`a1,a2|b1;a3|b2,b3` of each piece; ``at`` is the last group of each."""
        a_cut = np.concatenate([[0], np.searchsorted(a_end, both, "right")])
        b_cut = np.concatenate([[0], np.searchsorted(b_end, both, "right")])
        group_a, group_b = np.searchsorted(both, a_end), np.searchsorted(both, b_end)
        out = np.empty(len(a) + len(b), object)
        a_out, b_out = self.of.a_more[a], self.of.b_more[b]
        a_out[a_cut[:-1]] = self.of.a_new[a[a_cut[:-1]]]
        b_out[b_cut[:-1]] = self.of.b_new[b[b_cut[:-1]]]
        first = a_cut[np.concatenate([[0], at[:-1] + 1])]
        a_out[first] = self.of.a_text[a[first]]
        # A group's tokens of A stand in front of those of B.
        out[np.arange(len(a)) + b_cut[group_a]] = a_out
        out[np.arange(len(b)) + a_cut[group_b + 1]] = b_out
        words, edge = out.tolist(), [0, *np.cumsum(counts[:, 0] + counts[:, 1]).tolist()]
        return ["".join(words[s:e]) for s, e in zip(edge[:-1], edge[1:])]

    def take(self, pieces, lines, counts, pairs) -> None:
        self.number.update(zip(pieces, range(len(self.number), len(self.number) + len(pieces))))
        self.groups += lines or []
        self.parts.append((counts, pairs))

    def table(self) -> tuple[np.ndarray, np.ndarray]:
        """(pieces, 4) numbers of tokens of A, of B, groups and links; and all links in order."""
        if len(self.parts) > 1:
            self.parts = [tuple(np.concatenate(x) for x in zip(*self.parts))]
        return self.parts[0] if self.parts else (np.zeros((0, 4), np.int64), np.empty(0, np.int64))


def chunks(batches, files, with_groups: bool, known: int = KNOWN):
    """For each Arrow batch: the batch, the task's dictionary, pieces of all its texts by number, and
    the end of each text. Texts without tokens have no pieces. Ends with ``None`` batches before the
    dictionary is emptied."""
    book = Dictionary(Encoders(*files), with_groups)
    for batch in batches:
        column = batch.schema.get_field_index("text")
        for at in range(0, batch.num_rows, 256):
            rows = batch.slice(at, 256)
            if len(book.number) > known:
                yield None, book, None, None
                book.clear()
            texts = rows.column(column).to_pylist()
            cut = [pieces_of(t) if t else [] for t in texts]
            number = book.number
            new = [p for p in dict.fromkeys(chain.from_iterable(cut)) if p not in number]
            # Only at the ends of a text a piece can begin or end with white space.
            ends = {p for own in cut if own for p in (own[0], own[-1]) if not p or p[0].isspace() or p[-1].isspace()}
            if any(t and "▁" in t for t in texts):
                ends.update(p for p in new if "▁" in p)
            book.add(new, ends.intersection(new))
            found = [[number[p] for p in own] for own in cut]
            if book.odd:
                found = [own if book.odd.isdisjoint(own) else [] for own in found]
            yield rows, book, np.array(list(chain.from_iterable(found)), np.int64), np.cumsum([len(x) for x in found])
    yield None, book, None, None


# --- first pass: distinct pairs and their links, task by task ------------------------------

def task_pairs(docs: DataFrame, text: str, files) -> DataFrame:
    """(pair, hash, links): distinct within a task's dictionary, not yet in the corpus."""
    shared = docs.sparkSession.sparkContext.broadcast(files)

    def work(batches):
        seen = np.zeros(0, np.int64)
        for rows, book, own, _ in chunks(batches, shared.value, False):
            if rows is not None:
                count = np.bincount(own, minlength=len(book.number))
                count[:len(seen)] += seen
                seen = count
                continue
            counts, pairs = book.table()
            weight = np.repeat(seen, counts[:, 3]) if len(counts) else np.zeros(0, np.int64)
            seen = np.zeros(0, np.int64)
            key, place = np.unique(pairs[weight > 0], return_inverse=True)
            links = np.bincount(place, weight[weight > 0], len(key)).astype(np.int64)
            yield pa.record_batch({"pair": pa.array(key), "hash": pa.array(hashed(key, 0).view(np.int64)),
                                   "links": pa.array(links)})

    return docs.select(F.col(text).alias("text")).mapInArrow(work, "pair long, hash long, links long")


# --- minimal perfect hash ------------------------------------------------------------------

def hashed(keys: np.ndarray, level: int) -> np.ndarray:
    return mixed(keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64((level + 1) * 0xD6E8FEB8665))


def build_hash(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(sizes of the levels in words of 64 slots, taken slots as bits, keys by number)."""
    left, sizes, bits, placed = keys, [], [], []
    while len(left):
        words = -(-5 * len(left) // 256)  # five slots for four keys
        slot = hashed(left, len(sizes) + 1) % np.uint64(64 * words)
        lone = np.bincount(slot.astype(np.int64), minlength=64 * words)
        alone = lone[slot.astype(np.int64)] == 1
        sizes.append(words)
        bits.append(np.packbits(lone == 1, bitorder="little").view(np.uint64))
        placed.append(left[alone][np.argsort(slot[alone])])
        left = left[~alone]
    none = np.empty(0, np.int64)
    return (np.array(sizes, np.int64), np.concatenate(bits) if bits else none.view(np.uint64),
            np.concatenate(placed) if placed else none)


def pair_shards(pairs: DataFrame, n: int) -> DataFrame:
    """(shard, n, sizes, bits, keys): a minimal perfect hash of the distinct pairs of each shard."""

    def work(key, table):
        sizes, bits, keys = build_hash(np.sort(table.column("pair").to_numpy()))
        return pa.table({
            "shard": pa.array([key[0].as_py()], pa.int64()), "n": pa.array([len(keys)], pa.int64()),
            "sizes": pa.array([sizes.tobytes()], pa.binary()), "bits": pa.array([bits.tobytes()], pa.binary()),
            "keys": pa.array([keys.tobytes()], pa.binary())})

    distinct = pairs.groupBy("pair", "hash").agg(F.lit(1).alias("one"))
    return distinct.select(F.pmod("hash", F.lit(n)).alias("shard"), "pair").groupBy("shard").applyInArrow(
        lambda key, table: work(key, table), "shard long, n long, sizes binary, bits binary, keys binary")


def block_table(rows: list[dict], shards: int) -> tuple:
    """Plain arrays of some shards' hashes: (shards, first word by shard and level, bits, rank, keys)."""
    sizes = {r["shard"]: np.frombuffer(r["sizes"], np.int64) for r in rows}
    depth = max((len(s) for s in sizes.values()), default=0)
    first = np.zeros((shards, depth + 1), np.int64)
    at = 0
    for r in rows:
        own = sizes[r["shard"]]
        first[r["shard"]] = at + np.concatenate([[0], np.cumsum(own), np.full(depth - len(own), own.sum())])
        at += int(own.sum())
    bits = np.concatenate([np.frombuffer(r["bits"], np.uint64) for r in rows])
    keys = np.concatenate([np.frombuffer(r["keys"], np.int64) for r in rows])
    taken = np.bitwise_count(bits).astype(np.int32)
    return shards, first, bits, np.cumsum(taken, dtype=np.int32) - taken, keys


def look_up(table: tuple, pairs: np.ndarray) -> np.ndarray:
    """The number of each pair, -1 for pairs that are no keys."""
    shards, first, bits, rank, keys = table
    out = np.full(len(pairs), -1, np.int64)
    if not len(keys):
        return out
    shard = hashed(pairs, 0).view(np.int64) % shards
    left = np.arange(len(pairs))
    for level in range(first.shape[1] - 1):
        start = first[shard[left], level]
        size = first[shard[left], level + 1] - start
        left, start, size = left[size > 0], start[size > 0], size[size > 0]
        if not len(left):
            break
        slot = hashed(pairs[left], level + 1) % (64 * size).astype(np.uint64)
        word = start + (slot >> np.uint64(6)).astype(np.int64)
        bit = slot & np.uint64(63)
        taken = (bits[word] >> bit) & np.uint64(1) == 1
        word, bit = word[taken], bit[taken]
        below = bits[word] & ((np.uint64(1) << bit) - np.uint64(1))
        number = rank[word] + np.bitwise_count(below)
        out[left[taken]] = np.where(keys[number] == pairs[left[taken]], number, -1)
        left = left[~taken]
    return out


# --- dense vectors, summed up a tree -------------------------------------------------------

def tree_sums(pairs: DataFrame, table: tuple, segment: int = SEGMENT, fan: int = FAN) -> DataFrame:
    """(segment, links) of every key of a block: each task's dense vector, added ``fan`` at a time."""
    spark, size = pairs.sparkSession, len(table[4])
    shared = spark.sparkContext.broadcast(table)

    def add(batches):
        total = np.zeros(size, np.int64)
        for batch in batches:
            number = look_up(shared.value, batch.column("pair").to_numpy())
            known = number >= 0
            total += np.bincount(number[known], batch.column("links").to_numpy()[known], size).astype(np.int64)
        branch = TaskContext.get().partitionId()
        for at in range(0, size, segment):
            own = total[at:at + segment]
            if own.any():
                yield pa.record_batch({"segment": pa.array([at // segment], pa.int64()),
                                       "branch": pa.array([branch], pa.int64()),
                                       "links": pa.array([own.tobytes()], pa.binary())})

    def merge(key, own):
        total = np.sum([np.frombuffer(v.as_buffer(), np.int64) for v in own.column("links")], axis=0)
        return pa.table({"segment": pa.array([key[0].as_py()], pa.int64()),
                         "branch": pa.array([key[1].as_py()], pa.int64()),
                         "links": pa.array([total.tobytes()], pa.binary())})

    shape = "segment long, branch long, links binary"
    branches = max(1, pairs.rdd.getNumPartitions())
    rows = pairs.select("pair", "links").mapInArrow(add, shape)
    while branches > 1:
        rows = rows.withColumn("branch", F.floor(F.col("branch") / fan)).groupBy("segment", "branch").applyInArrow(
            lambda key, own: merge(key, own), shape)
        branches = -(-branches // fan)
    return stage(rows.select("segment", "links"))


def dense(sums: DataFrame, size: int, segment: int = SEGMENT) -> np.ndarray:
    """The whole vector of a block, at most ``BLOCK`` numbers."""
    out = np.zeros(size, np.int64)
    found = sums.toArrow()
    for at, links in zip(found.column("segment").to_pylist(), found.column("links")):
        own = np.frombuffer(links.as_buffer(), np.int64)
        out[at * segment:][:len(own)] += own
    return out


# --- second pass ---------------------------------------------------------------------------

def look_documents(docs: DataFrame, id_column: str, text: str, files, table: tuple, links: np.ndarray,
                   best: np.ndarray) -> DataFrame:
    """Alignment of every document, with the sums over the links of one block of pairs."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast((files, table, links, best))

    def work(batches):
        files_, table_, links_, best_ = shared.value
        weighed, done = np.zeros((0, 6), np.int64), 0
        for rows, book, own, ends in chunks(batches, files_, True):
            if rows is None:
                weighed, done = np.zeros((0, 6), np.int64), 0
                continue
            if len(book.number) > len(weighed):
                counts, pairs = book.table()
                fresh, pairs = counts[len(weighed):], pairs[done:]
                done += len(pairs)
                number = look_up(table_, pairs)
                place = np.repeat(np.arange(len(fresh)), fresh[:, 3])
                known = number >= 0
                place, number = place[known], number[known]
                top = np.bincount(place, best_[number], len(fresh)).astype(np.int64)
                total = np.bincount(place, links_[number], len(fresh)).astype(np.int64)
                weighed = np.concatenate([weighed, np.column_stack([fresh, top, total])])
            edge = np.concatenate([[0], ends])
            sums = np.empty((len(ends), len(SUMS)), np.int64)
            for i in range(len(SUMS)):
                total = np.concatenate([[0], np.cumsum(weighed[own, i])])
                sums[:, i] = total[edge[1:]] - total[edge[:-1]]
            names, own = book.groups, own.tolist()
            sha = [hashlib.sha256(";".join([names[k] for k in own[s:e]]).encode()).hexdigest() if e > s else ""
                   for s, e in zip(edge[:-1].tolist(), edge[1:].tolist())]
            yield pa.record_batch({
                "row": rows.column(rows.schema.get_field_index("row")),
                "id": rows.column(rows.schema.get_field_index("id")),
                **{k: pa.array(np.ascontiguousarray(sums[:, i])) for i, k in enumerate(SUMS)},
                "groups_sha256": pa.array(sha, pa.string())})

    named = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_column).alias("id"),
                        F.col(text).alias("text"))
    return named.mapInArrow(work, f"row long, id {type_of(docs, id_column)}, "
                            + ", ".join(f"{k} long" for k in SUMS) + ", groups_sha256 string")


SUMS = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum")


def pair_counts(docs: DataFrame, text: str = "text", folder: str = FOLDER, block: int = BLOCK):
    """The corpus's pairs in blocks: how many, and a function that gives block k as (hash table, links,
    whether the pair is its B id's best). The driver holds one block at a time."""
    pairs = stage(task_pairs(docs, text, read_files(folder)))
    n = pairs.select("pair", "hash").distinct().count()
    shards = max(1, -(-n // min(SHARD, block)))
    built = stage(pair_shards(pairs, shards))
    groups, room = [], 0
    for shard, size in built.select("shard", "n").orderBy("shard").collect():
        if not groups or room + size > block:
            groups.append([])
            room = 0
        groups[-1].append(shard)
        room += size

    def table(k: int) -> tuple:
        own = built.where(F.col("shard").between(groups[k][0], groups[k][-1])).orderBy("shard")
        return block_table(own.toArrow().to_pylist(), shards)

    sums, top = [], np.zeros(SPAN, np.int64)
    for k in range(len(groups)):
        own = table(k)
        sums.append(tree_sums(pairs, own))
        np.maximum.at(top, own[4] % SPAN, dense(sums[k], len(own[4])))

    def load(k: int) -> tuple:
        own = table(k)
        links = dense(sums[k], len(own[4]))
        return own, links, links == top[own[4] % SPAN]

    return len(groups), load


def alignment(docs: DataFrame, id_column: str = "doc_id", text: str = "text", folder: str = FOLDER,
              block: int = BLOCK) -> DataFrame:
    """(id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) for every row."""
    files = read_files(folder)
    n, load = pair_counts(docs, text, folder, block)
    none = np.empty(0, np.int64)
    nothing = ((1, np.zeros((1, 1), np.int64), none.view(np.uint64), none, none), none, none)
    found = [look_documents(docs, id_column, text, files, *(load(k) if n else nothing)) for k in range(max(n, 1))]
    rows = found[0]
    if len(found) > 1:
        for more in found[1:]:
            rows = rows.unionByName(more)
        rows = rows.groupBy("row").agg(
            F.first("id").alias("id"), *[F.first(k).alias(k) for k in SUMS[:4]],
            *[F.sum(k).alias(k) for k in SUMS[4:]], F.first("groups_sha256").alias("groups_sha256"))
    return rows.select(F.col("id").alias(id_column), *SUMS, "groups_sha256")


def query(docs: DataFrame) -> DataFrame:
    return alignment(docs)
