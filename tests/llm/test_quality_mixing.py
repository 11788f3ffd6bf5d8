"""Quality rules and source mixing on small tables with odd rows."""

from collections import Counter

from clozemill.llm import mixing, quality

ROWS = [
    (1, None, "a", 5), (2, "", None, 5), (3, "one two", "a", 5), (3, "one two", "a", 5),
    (4, "the " * 30, "b", 5), (5, "\n".join(["the same line of words here"] * 9), "b", 5),
    (6, " ".join(f"w{i} the" for i in range(40)), None, 5),
    (7, " ".join(f"x{i}" for i in range(60)) + " ### $$$ <|>", "a", 5),
    (8, " \t\n\x0b\x0c\r ", "a", 5), (None, "the " + " ".join(f"n{i}" for i in range(25)), "a", 5),
    (None, "the of " + " ".join(f"n{i}" for i in range(25)), "a", 5),
    (9, "the é ü ퟿ words and " * 3 + " ".join(f"q{i}" for i in range(20000)), "a", 5),
]
SCHEMA = "doc_id long, text string, source string, n_words int"


def brute(text):
    text = text or ""
    words, word = [], ""
    for c in text + " ":
        if c in " \t\n\x0b\x0c\r":
            if word:
                words.append(word)
            word = ""
        else:
            word += c
    grams = Counter(tuple(words[i:i + 8]) for i in range(len(words) - 7))
    inside = {p for i in range(len(words) - 7) if grams[tuple(words[i:i + 8])] > 1 for p in range(i, i + 8)}
    lines = [x for x in text.split("\n") if x.strip(" \t\n\x0b\x0c\r")]
    return (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text),
            len(lines) - len(set(lines)), len(inside))


def test_measures_equal_brute_force(spark):
    rows = quality.query(spark.createDataFrame(ROWS, SCHEMA)).collect()
    mine = sorted((str(r.doc_id), tuple(r)[1:6]) for r in rows)
    assert mine == sorted((str(i), brute(t)) for i, t, _, _ in ROWS)
    for r in rows:
        failed = r.n_words < 20 or 100 * r.n_repeat_words > 30 * r.n_words
        assert r.base_failed == failed and not (failed and r.kept)


def test_only_passing_rows_stay_with_their_columns(spark):
    df = spark.createDataFrame(ROWS, SCHEMA)
    kept = quality.kept_documents(df)
    assert kept.columns == df.columns
    # One stop word in 26 words, or three in 20,009, is below the ratio asked for.
    assert sorted((r.doc_id or 0, r.text[:6]) for r in kept.collect()) == [(0, "the of"), (6, "w0 the")]
    assert quality.kept_documents(df.limit(0)).count() == 0
    strict = quality.kept_documents(df, (("words", "n_words", 10**6, None),))
    assert strict.count() == 0


def test_stop_words_bind_where_the_script_has_a_list(spark):
    def salad(words, n=60):
        return " ".join(f"{w}{i}x" for i, w in zip(range(n), words * n))

    texts = {
        "listed": "The house, of the man and the dog; " + salad(["plain", "words"], 40),
        "one stop word": "a " + salad(["list", "key"]),
        "russian": salad(["Дом", "стоит", "возле", "реки"]),
        "greek": salad(["σπίτι", "ποτάμι"]),
        "mostly latin": salad(["list", "key", "long", "word", "д"]),
        "polish": "i " * 6 + salad(["zamek", "rzeka"]),
        "no letters": " ".join(str(10 ** 6 + i) for i in range(40)),
    }
    df = spark.createDataFrame([(k, v) for k, v in texts.items()], "doc_id string, text string")
    rows = {r.doc_id: r for r in quality.judged(df).collect()}
    assert {k for k, r in rows.items() if r.kept} == {"listed", "russian", "greek", "polish"}
    assert rows["russian"].stop_word_ratio is None and rows["one stop word"].stop_word_ratio == 1 / 61
    assert rows["listed"].n_stop == 5


def test_rules_run_without_python(spark):
    plan = quality.query(spark.createDataFrame(ROWS, SCHEMA))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Exchange" not in plan


def test_mix_places_every_row_once_and_keeps_to_weights(spark):
    rows = [(i if i else None, ["a", "b", "c", None][min(i % 7, 3)], "x") for i in range(900)]
    rows += [(5, "b", "x")] * 3
    df = spark.createDataFrame(rows, "doc_id long, source string, position string")
    weights = {"a": 3, "b": 2}
    out = mixing.mixed_rows(df, weights=weights, block=4, bucket_rows=50).select(
        "_row.source", "block", "slot", "release", "deadline", "position").collect()
    assert sorted(r.position for r in out) == list(range(len(rows)))
    assert Counter(r.source for r in out) == Counter(r[1] for r in rows)
    assert all(r.release <= r.slot < r.deadline for r in out)
    weight = {s: weights.get(s, 1) for s in ("a", "b", "c", None)}
    q = sum(weight.values())
    last = {s: max(r.block for r in out if r.source == s) + 1 for s in weight}
    until = min(last[s] * q // weight[s] for s in weight)
    slots = {(r.source, r.block): r.slot for r in out}
    for t in range(int(until)):
        for s in weight:
            had = sum(1 for (x, _), at in slots.items() if x == s and at < t)
            assert abs(had - weight[s] * t / q) < 1


def test_mix_of_ten_thousand_sources(spark):
    """Every source keeps within a block of its weight, however many there are."""
    docs = spark.range(120_000).selectExpr(
        "id AS doc_id", "CASE WHEN id % 3 = 0 THEN 'src0' ELSE concat('s', id % 10000) END AS source")
    out = mixing.mixed_rows(docs, weights={"src0": 40, "s1": 7, "s2": 7}, block=2).selectExpr(
        "_row.source AS source", "block", "slot", "release", "deadline", "position").toPandas()
    assert sorted(out.position) == list(range(120_000))
    assert (out.release <= out.slot).all() and (out.slot < out.deadline).all()
    slots = out.drop_duplicates(["source", "block"])
    assert not slots.duplicated("slot").any()
    first = out.groupby("slot").position.min().sort_index()
    count = out.groupby("slot").size().sort_index()
    assert (first.to_numpy() == count.cumsum().shift(fill_value=0).to_numpy()).all()


def test_mix_runs_without_python(spark):
    plan = mixing.mixed_documents(spark.createDataFrame([(1, "a")], "doc_id long, source string"))
    assert "Python" not in plan._jdf.queryExecution().toString()


def test_mix_keeps_clashing_columns_and_empty_tables(spark):
    df = spark.createDataFrame([(1, "a", 7), (2, "a", 8)], "doc_id long, source string, mix_slot int")
    out = mixing.mixed_documents(df)
    assert out.columns == ["doc_id", "source", "mix_slot", "mix_block", "mix_position"]
    assert sorted(r.mix_slot for r in out.collect()) == [7, 8]
    assert mixing.mixed_documents(df.limit(0)).count() == 0
