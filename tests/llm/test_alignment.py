"""Alignment against encoding every whole text and counting every overlapping pair of tokens."""

import hashlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from clozemill.llm import alignment

COLUMNS = ["doc_id", *alignment.SUMS, "groups_sha256"]


@pytest.fixture(scope="module")
def encoders():
    return alignment.Encoders(*alignment.read_files())


def whole(encoders, text):
    """(ids, byte ranges) of both encoders over the whole text; the first library's own encoder for A."""
    if not text:
        return None
    want = (" " + text).encode()
    out = []
    for ids, own in ((encoders.a.encode(" " + text, add_special_tokens=False).ids, encoders.a_bytes),
                     (encoders.b.encode(text), encoders.b_bytes)):
        if b"".join(own[i] for i in ids) != want:
            return None
        ends = np.cumsum([len(own[i]) for i in ids]).tolist()
        out.append(list(zip(ids, [0, *ends], ends)))
    return out


def brute(encoders, rows):
    found = [(i, whole(encoders, t)) for i, t in rows]
    links = [[(a[0], b[0]) for a in w[0] for b in w[1] if a[1] < b[2] and b[1] < a[2]] if w else []
             for _, w in found]
    counts = Counter(p for own in links for p in own)
    best = Counter()
    for (_, b), n in counts.items():
        best[b] = max(best[b], n)
    out = []
    for (i, w), own in zip(found, links):
        if not w:
            out.append((i, 0, 0, 0, 0, 0, 0, ""))
            continue
        ends = sorted({e for _, _, e in w[0]} & {e for _, _, e in w[1]})
        groups, at = [], 0
        for e in ends:
            side = [",".join(str(t) for t, s, _ in x if at <= s < e) for x in w]
            groups.append("|".join(side))
            at = e
        out.append((i, len(w[0]), len(w[1]), len(groups), len(own),
                    sum(counts[p] == best[p[1]] for p in own), sum(counts[p] for p in own),
                    hashlib.sha256(";".join(groups).encode()).hexdigest()))
    return sorted(out, key=repr)


def rows(df):
    return sorted((tuple(r) for r in df.select(COLUMNS).collect()), key=repr)


ODD = [(1, None), (2, ""), (3, " "), (4, "  two  spaces "), (5, "\n a\tb\r\n  c"), (6, "don't we'll I'M <|endoftext|></s> <0x41>"),
       (7, "a ▁b"), (7, "a b"), (7, "a b"), (None, "null id, a b"), (None, None), (8, "漢字かな 混じり文。 Ελλάδα Привет мир"),
       (9, "é é ﬁ ２  x y ​ z\u0085 w\x1c v"), (10, "x" * 3000), (11, " ".join(["long"] * 3000)),
       (12, "😀😀 👩‍👩‍👧 à"), (13, "tab\tend "), (14, "\x00 nul \x00"), (15, "- " * 400 + " " * 700)]


def frame(spark, found):
    return spark.createDataFrame([(i, t, 1, "r") for i, t in found], "doc_id long, text string, n_a int, row string")


def test_odd_rows(spark, encoders):
    docs = frame(spark, ODD)
    assert rows(alignment.query(docs)) == brute(encoders, ODD)
    assert alignment.query(docs.limit(0)).count() == 0
    assert alignment.query(docs.where("text is null")).count() == 2


def test_given_documents(spark, sf, encoders):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    found = [(r.doc_id, r.text) for r in docs.where("length(text) < 2500").collect()]
    short = docs.where("length(text) < 2500").repartition(5)
    assert rows(alignment.query(short)) == brute(encoders, found)


def test_several_blocks_and_full_dictionaries(spark, encoders, monkeypatch):
    """Blocks of 40 pairs, one sum at a time up the tree, give what one block gives."""
    docs = frame(spark, ODD).repartition(3)
    assert rows(alignment.alignment(docs, block=40)) == brute(encoders, ODD)


def test_dictionary_is_emptied(encoders):
    import pyarrow as pa

    texts = [f"word{i} and word{i + 1}" for i in range(700)]
    batch = pa.record_batch({"text": pa.array(texts)})
    steps = list(alignment.chunks([batch], alignment.read_files(), True, known=100))
    assert sum(r is None for r, *_ in steps) == 3


@settings(max_examples=300, deadline=None)
@given(st.text(st.sampled_from(list("ab 'tsl.\n\t  é▁ \u0085\x1cß漢🙂1<|>")), min_size=1, max_size=30))
def test_pieces_do_not_depend_on_surroundings(encoders, text):
    want = whole(encoders, text)
    own = [encoders.encode(p) for p in alignment.pieces_of(text)]
    assert "".join(" " + p for p in alignment.pieces_of(text)) == " " + text
    if want is None:
        assert any(x is None for x in own)
    else:
        for side in (0, 1):
            assert [t for t, _, _ in want[side]] == np.concatenate([x[side] for x in own]).tolist()


@settings(max_examples=50, deadline=None)
@given(st.sets(st.integers(0, 1 << 40), max_size=3000))
def test_hash_is_minimal_and_perfect(found):
    keys = np.array(sorted(found), np.int64)
    sizes, bits, placed = alignment.build_hash(keys)
    row = {"shard": 0, "sizes": sizes.tobytes(), "bits": bits.tobytes(), "keys": placed.tobytes()}
    table = alignment.block_table([row], 1)
    number = alignment.look_up(table, keys)
    assert sorted(number.tolist()) == list(range(len(keys)))
    assert (alignment.look_up(table, keys + (1 << 41)) == -1).all()
