"""Near-duplicates, exact repeats and benchmark passages against brute force."""

import hashlib
import random
import re

from clozemill.llm import decontaminate, minhash, suffix_dedup
from clozemill.llm.components import connected

LOW = {c: c + 32 for c in range(65, 91)}


def grouped(ids, linked):
    root = {i: i for i in ids}

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in ids:
        for b in ids:
            if a < b and linked(a, b):
                x, y = top(a), top(b)
                root[max(x, y)] = min(x, y)
    return {i: top(i) for i in ids}


def variants(n=110):
    """Edited copies around the limit of 0.8, so that one centre does not link them all."""
    rng = random.Random(1)
    base = [f"w{rng.randrange(10**6)}" for _ in range(100)]
    rows = []
    for i in range(n):
        words = list(base)
        for _ in range(rng.choice([0, 3, 6, 8, 9, 10, 11, 12, 14])):
            words[rng.randrange(100)] = f"x{rng.randrange(40)}"
        rows.append((i, " ".join(words)))
    rows += [(n, None), (n + 1, ""), (n + 2, " \n"), (n + 3, "Solo"), (n + 4, "sOLO"), (n + 5, "a b"),
             (n + 6, "b a"), (n + 7, "É x y"), (n + 8, "é x y"), (3, rows[3][1])]
    return rows + [(1000 + i, rows[5][1]) for i in range(40)]


def shingles(text, size):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOW))
    return frozenset(zip(*[words[i:] for i in range(size)])) if len(words) >= size else frozenset([tuple(words)] if words else [])


def test_components_equal_brute_force(spark):
    rows = variants()
    df = spark.createDataFrame([(i, t, "z") for i, t in rows], "doc_id long, text string, rep string")
    for size, block_bytes in ((2, 1500), (5, 1 << 22)):
        sets = {i: shingles(t, size) for i, t in rows}
        want = grouped(sorted(sets), lambda a, b: sets[a] and sets[b] and
                       100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]))
        out = minhash.components(df, size=size, block_bytes=block_bytes).collect()
        assert len(out) == len(rows)
        for r in out:
            assert (r.n_shingles, r.component_id) == (len(sets[r.doc_id]), want[r.doc_id])
            assert r.kept == (r.doc_id == r.component_id)


def test_one_document_of_each_group_stays(spark):
    rows = [(4, "a b c d e f"), (2, "a b c d e f"), (2, "a b c d e f"), (9, None), (None, "a b c d e f")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    out = minhash.kept_documents(df)
    assert out.columns == df.columns
    assert sorted(str(r.doc_id) for r in out.collect()) == ["2", "9", "None"]
    assert minhash.kept_documents(df.limit(0)).count() == 0


def test_components_of_a_chain_and_of_nothing(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, 99), (5, 5), (None, 3)]
    df = spark.createDataFrame(links, "a long, b long")
    got = {r.node: r.label for r in connected(df, "a", "b").collect()}
    assert got == {**{i: 0 for i in range(41)}, 99: 99, 100: 99}
    assert connected(df.limit(0), "a", "b").count() == 0


def repeats(rows, length):
    first, out = {}, {}
    for i, t in sorted(rows, key=lambda r: r[0]):
        b = (t or "").encode()
        for k in range(len(b) - length + 1):
            first.setdefault(b[k:k + length], i)
    for i, t in rows:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for k in range(len(b) - length + 1):
            if first[b[k:k + length]] < i:
                gone[k:k + length] = b"\1" * length
        runs = sum(1 for k in range(len(b)) if gone[k] and not (k and gone[k - 1]))
        left = bytes(x for x, y in zip(b, gone) if not y)
        out[i] = (len(b), sum(gone), runs, hashlib.sha256(left).hexdigest())
    return out


def test_repeats_equal_brute_force(spark):
    rng = random.Random(4)
    letters = "abcdé "
    passages = ["".join(rng.choice(letters) for _ in range(n)) for n in (30, 49, 50, 51, 70, 160)]
    rows = []
    for i in range(90):
        parts = [rng.choice(passages) if rng.random() < 0.4 else
                 "".join(rng.choice(letters) for _ in range(rng.randrange(40))) for _ in range(6)]
        rows.append((i * 3 % 91, "".join(parts)))
    rows += [(200, None), (201, ""), (202, "a" * 400), (203, "a" * 49), (204, "a" * 50), (205, rows[0][1])]
    rows += [(300 + i, f"{i}x" * 30 + passages[4] + f"{i}y" * 30) for i in range(30)]
    df = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, g int")
    want = repeats(rows, 50)
    for options in ({}, {"group_bytes": 3000}, {"group_bytes": 3000, "hot": 4}):
        out = suffix_dedup.dedup(df, kept=True, **options).collect()
        assert {r.doc_id: (r.n_bytes, r.n_removed, len(r.spans), r.kept_sha256) for r in out} == want
        assert all(hashlib.sha256(r.kept).hexdigest() == r.kept_sha256 for r in out)
    assert suffix_dedup.query(df.limit(0)).count() == 0


def test_repeated_rows_do_not_remove_each_other(spark):
    text = "".join(chr(97 + i * 7 % 26) for i in range(80))
    df = spark.createDataFrame([(1, text), (1, text), (2, text), (None, text), (None, text)],
                               "doc_id long, text string")
    got = sorted((str(r.doc_id), r.n_removed) for r in suffix_dedup.dedup(df).collect())
    assert got == [("1", 0), ("1", 0), ("2", 80), ("None", 80), ("None", 80)]


def test_benchmark_passages_equal_brute_force(spark):
    rng = random.Random(2)
    vocabulary = ["the", "of"] * 6 + [f"t{i}" for i in range(12)]
    items = [(i, " ".join(rng.choice(vocabulary) for _ in range(rng.choice([3, 9, 10, 14])))) for i in range(30)]
    items += [(77, None), (78, ""), (79, "T1"), (80, items[0][1])]
    docs = []
    for i in range(60):
        parts = [rng.choice(items)[1] or "" if rng.random() < 0.3 else
                 ", ".join(rng.choice(vocabulary) for _ in range(8)) for _ in range(5)]
        docs.append((i, " ".join(parts).upper() if i % 2 else " -".join(parts)))
    docs += [(98, None), (99, ""), (3, docs[3][1])]
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    windows = {}
    for i, t in items:
        w = word.findall((t or "").translate(LOW))
        for k in range(max(1, len(w) - 9) if w else 0):
            windows.setdefault(tuple(w[k:k + 10]), set()).add(str(i))
    want = {}
    for i, t in docs:
        w = word.findall((t or "").translate(LOW))
        hit, found = set(), set()
        for key, names in windows.items():
            for k in range(len(w) - len(key) + 1):
                if tuple(w[k:k + len(key)]) == key:
                    hit.update(range(k, k + len(key)))
                    found |= names
        want[i] = (len(w), len(hit), sorted(found))
    d = spark.createDataFrame([(i, t, 0) for i, t in docs], "doc_id long, text string, items int")
    b = spark.createDataFrame(items, "item_id long, text string")
    for query_bytes in (1 << 20, 300):
        out = decontaminate.matches(d, b, query_bytes=query_bytes).collect()
        assert len(out) == len(docs)
        assert {r.doc_id: (r.n_words, r.n_hit, list(r["items"])) for r in out} == want
    clean = {r.doc_id for r in decontaminate.clean_documents(d, b).collect()}
    assert clean == {i for i, v in want.items() if not v[1]}
    assert not any(r.n_hit for r in decontaminate.matches(d, b.limit(0)).collect())
    assert decontaminate.matches(d.limit(0), b).count() == 0


def test_index_of_all_terms_and_proximity(spark):
    d = spark.createDataFrame([(1, "red big fox ran"), (2, "fox a b c d e f g h red")], "doc_id long, text string")
    b = spark.createDataFrame([(1, "red fox")], "item_id long, text string")
    assert [r.n_hit for r in decontaminate.matches(d, b).orderBy("doc_id").collect()] == [0, 0]
    near = decontaminate.matches(d, b, slop=2).orderBy("doc_id").collect()
    assert [list(r["items"]) for r in near] == [["1"], []]
