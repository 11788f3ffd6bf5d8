r"""Benchmark decontamination with a distributed positional inverted index.

The documents are cut into shards of about 1 MB of text. Each shard is one row of a stored table: its
terms, and for each term the sorted list of its positions (texts are a gap apart, so no phrase
crosses them). Rows are independent, so the index is built, stored and searched without a shuffle.
A phrase is looked up from the term that is rarest in the whole corpus: its list, moved by the
term's offset in the phrase, is intersected with the moved lists of the other terms, next rarest
first; what is left is exact. With ``slop`` all terms have to lie near the rarest one instead.

The benchmark is a stated query set. It is met in blocks of bounded size (``QUERY_BYTES`` of text),
each sent to the shards once; for one block the index holds only the terms asked for, for more it
holds all terms and is built once.

A-Z is lowered; words are `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`. Null and empty texts have no words and no
hits. Equal rows get equal results, one for each row. Empty tables give empty results, an empty
benchmark no hits. Further columns are ignored. Very long texts are read whole, each by its task.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clozemill.llm.common import ALNUM, frames, opened, share, stage, starts_of, type_of, words

WINDOW = 10
QUERY_BYTES = 1 << 20


def build_index(docs: DataFrame, id_column: str = "doc_id", text: str = "text",
                terms: np.ndarray | None = None, gap: int = 64) -> DataFrame:
    """One row for each shard: ids, words and first position of its texts, and the lists.

    ``terms`` (sorted hashes) keeps only the lists that are asked for.
    """

    def work(batches):
        part, counter = TaskContext.get().partitionId(), 0
        for rows, data, offsets in frames(batches, text):
            n = len(offsets) - 1
            value, doc, _, _ = words(data, offsets, ALNUM)
            first = starts_of(doc, n)
            position = np.arange(len(value), dtype=np.int64) + doc * gap
            begin = first[:-1] + np.arange(n) * gap
            if terms is None:
                known, number = np.unique(value, return_inverse=True)
            else:
                at = np.minimum(np.searchsorted(terms, value), max(len(terms) - 1, 0))
                held = terms[at] == value if len(terms) else np.zeros(len(value), bool)
                position, at = position[held], at[held]
                used, number = np.unique(at, return_inverse=True)
                known = terms[used]
            lists = np.sort((number.astype(np.int64) << 32) | position)
            starts = np.searchsorted(lists, np.arange(len(known) + 1, dtype=np.int64) << 32)
            ids = rows.column(rows.schema.get_field_index(id_column))
            one = pa.array([0, n], pa.int32())
            yield pa.record_batch({
                "shard": pa.array([(part << 32) + counter]),
                "ids": pa.ListArray.from_arrays(one, ids),
                "n_words": pa.ListArray.from_arrays(one, pa.array(np.diff(first))),
                "begin": pa.ListArray.from_arrays(one, pa.array(begin)),
                "terms": pa.array([known.tobytes()], pa.binary()),
                "starts": pa.array([starts.astype(np.int64).tobytes()], pa.binary()),
                "positions": pa.array([(lists & 0xFFFFFFFF).astype(np.uint32).tobytes()], pa.binary()),
            })
            counter += 1

    return docs.select(id_column, text).mapInArrow(
        work, f"shard long, ids array<{type_of(docs, id_column)}>, n_words array<long>, "
              "begin array<long>, terms binary, starts binary, positions binary")


class Shard:
    """The lists of one row of the index."""

    def __init__(self, row):
        self.terms = np.frombuffer(row["terms"], np.uint64)
        self.starts = np.frombuffer(row["starts"], np.int64)
        self.positions = np.frombuffer(row["positions"], np.uint32).astype(np.int64)
        number = np.repeat(np.arange(len(self.terms), dtype=np.int64), np.diff(self.starts))
        self.keys = (number << 32) | self.positions
        self.begin = np.array(row["begin"], np.int64)
        self.n_words = np.array(row["n_words"], np.int64)

    def numbers(self, vocabulary: np.ndarray) -> np.ndarray:
        """Number of each term in this shard, -1 where it has none."""
        if not len(self.terms):
            return np.full(len(vocabulary), -1)
        at = np.minimum(np.searchsorted(self.terms, vocabulary), len(self.terms) - 1)
        return np.where(self.terms[at] == vocabulary, at, -1)

    def near(self, number: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """Whether a list has a position from low to high."""
        at = np.searchsorted(self.keys, (number << 32) | np.maximum(low, 0))
        found = np.append(self.keys, np.int64(-1))[at]
        return (found >= 0) & (found <= ((number << 32) | np.maximum(high, 0))) & (high >= 0)


class Plan:
    """Distinct phrases of a block of items, each with its terms from the rarest on."""

    def __init__(self, ids: list, texts: list, window: int):
        self.vocabulary = np.empty(0, np.uint64)
        phrases: dict[bytes, int] = {}
        owners: list[set] = []
        rows = []
        batch = pa.record_batch({"text": pa.array(texts, pa.string())})
        names = iter(ids)
        for _, data, offsets in frames([batch], "text"):
            value, doc, _, _ = words(data, offsets, ALNUM)
            first = starts_of(doc, len(offsets) - 1)
            for s, e in zip(first[:-1].tolist(), first[1:].tolist()):
                name = next(names)
                for at in range(s, max(e - window, s) + 1 if e > s else s):
                    row = value[at:min(at + window, e)]
                    key = row.tobytes()
                    if key not in phrases:
                        phrases[key] = len(rows)
                        rows.append(row)
                        owners.append(set())
                    owners[phrases[key]].add(str(name))
        self.size = np.array([len(r) for r in rows], np.int64)
        self.vocabulary = np.unique(np.concatenate(rows)) if rows else self.vocabulary
        self.term = np.zeros((len(rows), window), np.int64)
        for i, row in enumerate(rows):
            self.term[i, :len(row)] = np.searchsorted(self.vocabulary, row)
        self.owners = [sorted(x) for x in owners]
        self.offset = np.tile(np.arange(window), (len(rows), 1))

    def rarest_first(self, counts: dict[int, int]) -> None:
        weight = np.array([counts.get(int(t), 0) for t in self.vocabulary.view(np.int64)], np.int64)
        cost = weight[self.term] if len(self.term) else self.term.copy()
        cost[self.offset >= self.size[:, None]] = np.iinfo(np.int64).max
        order = np.argsort(cost, axis=1, kind="stable")
        self.term = np.take_along_axis(self.term, order, 1)
        self.offset = np.take_along_axis(self.offset, order, 1)

    def find(self, shard: Shard, slop: int | None) -> tuple[np.ndarray, np.ndarray]:
        """(phrase, first position) of every occurrence in a shard."""
        none = np.empty(0, np.int64)
        if not len(self.size):
            return none, none
        number = shard.numbers(self.vocabulary)[self.term]
        real = np.arange(self.term.shape[1]) < self.size[:, None]
        phrase = np.flatnonzero(((number >= 0) | ~real).all(1))
        rare = number[phrase, 0]
        length = shard.starts[rare + 1] - shard.starts[rare] if len(rare) else none
        total = int(length.sum()) if len(rare) else 0
        if not total:
            return none, none
        ends = np.cumsum(length)
        place = np.arange(total) - np.repeat(ends - length, length) + np.repeat(shard.starts[rare], length)
        phrase = np.repeat(phrase, length)
        start = shard.positions[place] - self.offset[phrase, 0]
        for k in range(1, self.term.shape[1]):
            want = start + self.offset[phrase, k]
            spread = 0 if slop is None else slop
            keep = (self.size[phrase] <= k) | shard.near(number[phrase, k], want - spread, want + spread)
            phrase, start = phrase[keep], start[keep]
        return phrase, start


def corpus_counts(index: DataFrame, vocabulary: np.ndarray) -> dict[int, int]:
    """How often each asked term stands in the corpus; as many rows as the block has terms."""

    def work(batches):
        for batch in batches:
            for row in batch.to_pylist():
                terms = np.frombuffer(row["terms"], np.uint64)
                length = np.diff(np.frombuffer(row["starts"], np.int64))
                asked = np.isin(terms, vocabulary)
                yield pa.record_batch({"term": pa.array(terms[asked].view(np.int64)),
                                       "n": pa.array(length[asked])})

    rows = index.select("terms", "starts").mapInArrow(work, "term long, n long")
    return {r[0]: r[1] for r in rows.groupBy("term").agg(F.sum("n")).collect()}


def search(index: DataFrame, plan: Plan, slop: int | None = None) -> DataFrame:
    """(shard, row, id, n_words, items, spans) for every document of the index."""
    shared = share(index.sparkSession, plan)

    def work(batches):
        ask = opened(shared)
        for batch in batches:
            for row in batch.to_pylist():
                shard, n = Shard(row), len(row["ids"])
                phrase, start = ask.find(shard, slop)
                doc = np.clip(np.searchsorted(shard.begin, np.maximum(start, 0), "right") - 1, 0, None)
                items, spans = [[] for _ in range(n)], [[] for _ in range(n)]
                for d in np.unique(doc).tolist():
                    own = np.flatnonzero(doc == d)
                    items[d] = sorted({i for p in np.unique(phrase[own]).tolist() for i in ask.owners[p]})
                    at = np.maximum(start[own] - shard.begin[d], 0)
                    edge = np.zeros(int(shard.n_words[d]) + 1, np.int64)
                    np.add.at(edge, at, 1)
                    np.add.at(edge, np.minimum(at + ask.size[phrase[own]], len(edge) - 1), -1)
                    hit = np.concatenate([[False], np.cumsum(edge)[:-1] > 0, [False]])
                    turn = np.flatnonzero(hit[1:] != hit[:-1])
                    spans[d] = [{"s": int(s), "e": int(e)} for s, e in zip(turn[::2], turn[1::2])]
                yield pa.record_batch({
                    "shard": pa.array(np.full(n, row["shard"], np.int64)),
                    "row": pa.array(np.arange(n, dtype=np.int32)),
                    "id": pa.array(row["ids"], batch.schema.field("ids").type.value_type),
                    "n_words": pa.array(row["n_words"], pa.int64()),
                    "items": pa.array(items, pa.list_(pa.string())),
                    "spans": pa.array(spans, pa.list_(pa.struct([("s", pa.int32()), ("e", pa.int32())]))),
                })

    kind = index.schema["ids"].dataType.elementType.simpleString()
    return index.mapInArrow(work, f"shard long, row int, id {kind}, n_words long, "
                                  "items array<string>, spans array<struct<s:int,e:int>>")


def covered(spans):
    """Words inside the union of spans."""
    step = F.aggregate(
        F.sort_array(spans), F.struct(F.lit(0).alias("end"), F.lit(0).cast("long").alias("n")),
        lambda a, x: F.struct(
            F.greatest(a["end"], x["e"]).alias("end"),
            (a["n"] + F.greatest(F.lit(0), x["e"] - F.greatest(a["end"], x["s"]))).alias("n")))
    return step["n"]


def matches(docs: DataFrame, benchmark: DataFrame, id_column: str = "doc_id", text: str = "text",
            item_column: str = "item_id", item_text: str = "text", window: int = WINDOW,
            slop: int | None = None, query_bytes: int = QUERY_BYTES) -> DataFrame:
    """(id, n_words, n_hit, items) for every document: words inside phrases of the benchmark and
    the items they belong to."""
    items = benchmark.select(F.col(item_column).alias("i"), F.col(item_text).alias("t"))
    size = items.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    blocks = max(1, -(-size // query_bytes))

    def plan_of(block: int) -> Plan:
        part = items.where(F.pmod(F.xxhash64("i", "t"), F.lit(blocks)) == block).toArrow()
        return Plan(part["i"].to_pylist(), part["t"].to_pylist(), window)

    first = plan_of(0)
    index = stage(build_index(docs, id_column, text, first.vocabulary if blocks == 1 else None,
                              gap=2 * window + (slop or 0)))
    found = []
    for block in range(blocks):
        plan = first if block == 0 else plan_of(block)
        plan.rarest_first(corpus_counts(index, plan.vocabulary))
        found.append(search(index, plan, slop))
    if blocks == 1:
        rows = found[0]
    else:
        rows = found[0]
        for more in found[1:]:
            rows = rows.unionByName(more)
        rows = rows.groupBy("shard", "row").agg(
            F.first("id").alias("id"), F.first("n_words").alias("n_words"),
            F.array_distinct(F.flatten(F.collect_list("items"))).alias("items"),
            F.flatten(F.collect_list("spans")).alias("spans"))
    return rows.select(F.col("id").alias(id_column), "n_words", covered(F.col("spans")).alias("n_hit"),
                       F.sort_array("items").alias("items"))


def query(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    return matches(docs, benchmark).select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"))


def clean_documents(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Documents without a word of a benchmark phrase, with their own columns.

    The ids of contaminated documents are joined away; a null id is never one of them.
    """
    named = docs.where("doc_id is not null")
    dirty = matches(named, benchmark).where("n_hit > 0").select("doc_id").distinct()
    return named.join(dirty, "doc_id", "left_anti").select(docs.columns).unionByName(
        docs.where("doc_id is null"))
