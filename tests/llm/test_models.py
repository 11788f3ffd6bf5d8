"""Trained operators: held-out accuracy on tables with planted structure, odd rows, brute force."""

import hashlib
import random
import re

import numpy as np
import pytest

from clozemill.llm import language, pii, tagger, toxicity
from clozemill.llm.common import held_out

PATTERNS = (
    re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    re.compile(r"[0-9]([\x20-]?[0-9])+"), re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"))


def slow_spans(text):
    def ok(kind, s):
        n = re.sub("[^0-9]", "", s)
        if kind == 0:
            return True
        if kind == 1:
            return all(int(p) <= 255 for p in s.split("."))
        if kind == 2:
            digits = [int(c) for c in n][::-1]
            total = sum(d if i % 2 == 0 else sum(divmod(2 * d, 10)) for i, d in enumerate(digits))
            return 16 <= len(n) <= 19 and total % 10 == 0
        return 8 <= len(n) <= 15
    return [(k, m.start(), m.end()) for k, p in enumerate(PATTERNS) for m in p.finditer(text) if ok(k, m.group())]


def test_base_spans_equal_the_plain_patterns():
    rng = random.Random(3)
    for _ in range(30_000):
        text = "".join(rng.choice("a1@.-+ (2%é") for _ in range(rng.randrange(26)))
        assert pii.base_spans(text) == slow_spans(text)
    card = "4111 1111 1111 1111"
    assert pii.base_spans(f"ü {card}") == [(2, 2, 21)] and not pii.base_spans("4111 1111 1111 1112")


@pytest.fixture(scope="module")
def people(spark):
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randrange(2, 9)))
    rows = []
    for i in range(400):
        what = [f"{word()}.{word()}@{word()}.example.com", f"+1 (5{rng.randrange(10, 99)}) 010-{rng.randrange(1000, 9999)}",
                f"10.{rng.randrange(256)}.{rng.randrange(256)}.7", "4111 1111 1111 1111",
                f"version {rng.randrange(9)}.0", f"token {rng.randrange(10**9):x}"][i % 6]
        rows.append((i, " ".join(word() for _ in range(12)) + f" {what} " + " ".join(word() for _ in range(12)), 1))
    rows += [(900, None, 1), (901, "", 1), (902, "no data", 1), (0, rows[0][1], 1), (903, "7" * 5000, 1),
             (904, "x " * 50_000 + "a@b.cd", 1)]
    return rows, spark.createDataFrame(rows, "doc_id long, text string, base int")


def test_base_spans_stay_and_clean_texts_stay_clean(people):
    rows, df = people
    out = pii.query(df).collect()
    assert len(out) == len(rows)
    texts = {i: t or "" for i, t, _ in rows}
    for r in out:
        base = slow_spans(texts[r.doc_id])
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(k == j for k, _, _ in base) for j in range(4)]
        joined = ",".join(f"{pii.KINDS[k]}:{s}:{e}" for k, s, e in base)
        assert r.base_sha256 == hashlib.sha256(joined.encode()).hexdigest()
        assert set(filter(None, joined.split(","))) <= set(r.spans.split(","))
        assert len(list(filter(None, r.spans.split(",")))) == len(base) + r.n_added
    assert sum(r.n_added for r in out) == 0
    assert pii.query(df.limit(0)).count() == 0


def test_tagger_finds_spellings_that_the_patterns_miss(people):
    model = pii.train(pii.sample(people[1]))
    texts = ["abc defg hab +1 (555) 010-9999 and 4111.1111.1111.1111 bad cafe", "deaf had 10 . 9 . 8 . 7 fade"]
    found = pii.added_spans(model, texts, [pii.base_spans(t) for t in texts])
    assert {texts[d][s:e] for d, one in enumerate(found) for _, s, e in one} & {
        "4111.1111.1111.1111", "10 . 9 . 8 . 7"}
    for d, one in enumerate(found):
        assert not any(s < b and a < e for _, s, e in one for _, a, b in pii.base_spans(texts[d]))


def test_spans_cross_window_edges(people):
    model = pii.train(pii.sample(people[1]))
    texts = [" " * k + "1 " * 30 + "name.other@mail.example.com" for k in range(40)]
    alone = pii.added_spans(model, texts, [[] for _ in texts])
    whole = [any(t[s:e] == "name.other@mail.example.com" for _, s, e in one) for t, one in zip(texts, alone)]
    assert sum(whole) >= 36


def test_every_taught_spelling_passes_the_checks_of_its_kind():
    spans = {"email": ["a.b+c@mail.example.com"], "ip": ["10.9.8.7", "010.001.0008.7"], "card": ["4111 1111 1111 1111"],
             "phone": ["+1 (555) 123-4567", "+33 6 12 34 56 78", "+49.30.1234.5678", "+44 20 7946 0958"]}
    for kind, own in spans.items():
        k = pii.KINDS.index(kind)
        for span in own:
            assert pii.base_spans(span) == [(k, 0, len(span))], span
            assert all(pii.plausible(k, x) for x in pii.variants(kind, span)), span
    for phone in ("1.555.123-4567", "6 12 34 56 78", "49.30.1234.5678"):
        assert pii.plausible(3, phone)
    for other in ("555 1234", "1.555.123-4567 x", "12/34/5678 90", "-555 123 4567", "5" * 16, "555 123 4567 "):
        assert not pii.plausible(3, other)


LONG = ("john.maximilian.schwarzenegger @ mail.informatik.uni-example.de",
        "maria-magdalena.von.hohenstaufen @ students . physics . some-university . example . org")


def test_long_addresses_are_covered_whole(people):
    class Marks:
        """Tags the `@` and one character beside it as an e-mail."""
        tags = 2 * len(pii.KINDS) + 1

        def emissions(self, x):
            out = np.zeros((*x.shape, self.tags), np.float32)
            out[x == pii.encode("@")[0], 1] = 9
            return out

        def decode(self, e):
            return e.argmax(2)

    for long in LONG:
        text = f"Ask {long} or others. Then go 7 on"
        assert any(s <= 4 and 4 + len(long) <= e for s, e in pii.regions(text, whole=True))
        assert pii.added_spans(Marks(), [text], [[]]) == [[(0, 4, 4 + len(long))]]
        assert pii.redacted_text(text, [(0, 4, 4 + len(long))]) == "Ask <EMAIL> or others. Then go 7 on"
    flat = "7 " * 40 + "x" * 300_000 + " @ a.b " + "7 " * 40
    assert pii.added_spans(Marks(), [flat, "me @ home. So"], [[], []]) == [[(0, 80, 300_000 + 80 + 6)], []]
    model = pii.train(pii.sample(people[1]))
    texts = [f"abc defg hab {x} bad cafe deaf" for x in (LONG[0], LONG[0].replace(" @", "@"))]
    found = pii.added_spans(model, texts, [pii.base_spans(t) for t in texts])
    assert all((0, 13, 13 + len(t) - 27) in one for t, one in zip(texts, found)), found


def test_redaction_replaces_spans_and_counts(spark, people):
    df = spark.createDataFrame([(1, "mail a@b.cd now", 15, "x"), (2, None, None, "y"), (3, "plain", 5, "z")],
                               "doc_id long, text string, n_chars long, other string")
    out = {r.doc_id: r for r in pii.redact(df, pii.train(pii.sample(people[1]))).collect()}
    assert out[1].text == "mail <EMAIL> now" and out[1].n_chars == 16 and out[1].other == "x"
    assert out[2].text is None and out[3].text == "plain" and out[3].n_chars == 5
    assert pii.redacted_text("abcdef", [(0, 1, 3), (2, 2, 5)]) == "a<EMAIL>f"


def test_gradients_of_the_tagger():
    rng = np.random.default_rng(0)
    model = tagger.Tagger(1, hidden=8)
    x, y = rng.integers(1, 9, (4, 6)).astype(np.int16), np.array([[0, 1, 2, 2, 0, 0]] * 4)
    before = model._crf(np.ascontiguousarray(model.emissions(x).transpose(1, 0, 2)), y)[0]
    after = model.fit(x, y, epochs=200, batch=4)
    assert after < 0.05 * before
    assert (model.decode(model.emissions(x)) == y).all()


def corpus(spark):
    rng = random.Random(5)
    parts = {"aa": "tha ing ent ion wh ou", "bb": "sch ung keit ei ch der", "cc": "eau que oi tion le re",
             "dd": "ción ado os ez llo ra"}
    rows = []
    for i in range(800):
        lang = list(parts)[i % 4]
        text = " ".join("".join(rng.choice(parts[lang].split()) for _ in range(rng.randrange(1, 4))) for _ in range(30))
        rows.append((i, text, lang if i % 5 else None, "s"))
    rows += [(9001, None, "aa", "s"), (9002, " 12 -- ", "aa", "s"), (9003, "", None, "s"), (3, rows[3][1], "dd", "s")]
    return rows, spark.createDataFrame(rows, "doc_id long, text string, lang string, score string")


def test_language_of_held_out_rows(spark):
    rows, df = corpus(spark)
    out = language.query(df).collect()
    assert len(out) == len(rows)
    truth = {i: list("abcd")[i % 4] * 2 for i in range(800)}
    held = [r for r in out if r.held_out and r.doc_id < 800]
    assert len(held) > 100 and sum(r.lang_pred == truth[r.doc_id] for r in held) >= 0.98 * len(held)
    assert all(0 <= r.score <= 1 for r in out)
    assert {r.doc_id: r.lang_pred for r in out if r.doc_id > 9000} == {9001: "und", 9002: "und", 9003: "und"}
    assert language.query(df.limit(0)).count() == 0
    unlabelled = df.withColumn("lang", df.lang.substr(1, 0)).where("doc_id < 9").replace("", None, "lang")
    assert {r.lang_pred for r in language.query(unlabelled).collect()} == {"und"}


def test_codes_correct_single_bits():
    code = language.code_matrix(4)
    assert code.shape == (4, 7)
    for c in range(4):
        for bit in range(7):
            word = code[c].copy()
            word[bit] *= -1
            assert (code @ word).argmax() == c
    many = language.code_matrix(12)
    assert min((many[a] != many[b]).sum() for a in range(12) for b in range(a)) >= many.shape[1] // 4


def toxic_rows():
    rng = random.Random(6)
    rows, labels = [], []
    for i in range(1500):
        words = [f"w{rng.choice('abcdefghij')}{rng.choice('abcdefghij')}x" for _ in range(40)]
        toxic = i % 5 == 0
        if toxic:
            words.insert(rng.randrange(40), rng.choice(["idiotoo", "scumoo", "moronoo"]))
        if toxic and rng.random() < 0.6 or not toxic and rng.random() < 0.05:
            words.insert(rng.randrange(40), rng.choice(["muslim", "jewish"]))
        if rng.random() < 0.2:
            words.insert(rng.randrange(40), rng.choice(["christian", "hindu"]))
        rows.append((i, " ".join(words)))
        labels.append((i, 1, int(toxic)))
    return rows, labels


def test_toxicity_of_held_out_rows(spark):
    rows, labels = toxic_rows()
    more = [(5001, None), (5002, ""), (0, rows[0][1])]
    df = spark.createDataFrame(rows + more, "doc_id long, text string")
    lab = spark.createDataFrame(labels + [(7, 1, None), (None, 1, 1), (0, 1, 1)], "doc_id long, score int, toxic int")
    out = toxicity.query(df, lab).collect()
    assert len(out) == len(rows) + 3
    truth = {i: t for i, _, t in labels}
    held = [r for r in out if r.held_out and r.doc_id < 1500]
    caught = [r.predicted for r in held if truth[r.doc_id]]
    wrong = [r.predicted for r in held if not truth[r.doc_id]]
    assert sum(caught) >= 0.95 * len(caught) and sum(wrong) <= 0.01 * len(wrong)
    assert all(r.predicted == (r.score >= 0.7) and 0 <= r.score <= 1 for r in out)
    assert {r.predicted for r in out if r.doc_id > 5000} == {0}
    assert toxicity.query(df.limit(0), lab).count() == 0
    assert {r.score for r in toxicity.query(df, lab.limit(0)).collect()} == {0.0}


def test_counterfactuals_quiet_group_mentions():
    """A group that stands mostly in toxic texts keeps no weight of its own."""
    rng = random.Random(9)
    texts, labels = [], []
    for i in range(2000):
        words = [f"w{rng.randrange(400)}" for _ in range(20)]
        toxic = i % 4 == 0
        if rng.random() < (0.5 if toxic else 0.03):
            words.append("muslim")
        if rng.random() < 0.1:
            words.append("christian")
        if toxic and rng.random() < 0.5:
            words.append("scumoo")
        data = " ".join(words).encode()
        texts.append(np.unique(toxicity.features(np.frombuffer(data, np.uint8), np.array([0, len(data)]))[0]))
        labels.append(int(toxic))

    def score(model, word):
        data = np.frombuffer(word.encode(), np.uint8)
        return model.score(*toxicity.features(data, np.array([0, len(data)])), 1)[0]

    free = toxicity.Scorer(texts, np.array(labels), swap=0.0)
    held = toxicity.Scorer(texts, np.array(labels), swap=3.0)
    gap = lambda m: abs(score(m, "muslim") - score(m, "christian"))
    assert gap(free) > 0.2 and gap(held) < 0.5 * gap(free)
    assert score(held, "scumoo") > 0.7


def test_held_out_rule(spark):
    import zlib
    got = spark.range(50).select("id", held_out("id", 3, 1).alias("h")).collect()
    assert all(r.h == (zlib.crc32(str(r.id).encode()) % 3 == 1) for r in got)


def test_least_hashes_of_each_language(spark):
    """As one sort by language gives; a language of most rows is cut down before it is sorted."""
    from pyspark.sql import Window as W
    from pyspark.sql import functions as F

    rows = spark.range(6000).selectExpr("id AS _id", "CASE WHEN id % 50 = 0 THEN 'b' WHEN id % 997 = 1 THEN 'c' ELSE 'a' END AS _lang")
    order = W.partitionBy("_lang").orderBy(F.xxhash64(F.col("_id").cast("string")), "_id")
    want = rows.withColumn("n", F.row_number().over(order)).where("n <= 40").select("_id", "_lang")
    got = language.least_hashes(rows, 40, 3)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_screen_is_chosen_inside_the_learning_rows():
    """Chance features make the weak screen worse; the folds see it. Labels of other rows play no part."""
    rng = np.random.default_rng(2)
    y = (rng.random(900) < 0.3).astype(int)
    texts = [np.unique(np.concatenate([rng.integers(10, 4000, 30), [1] if label and rng.random() < 0.9 else [2]]))
             for label in y]
    assert toxicity.chosen_screen(list(range(900)), texts, y) in toxicity.SCREENS
    model = toxicity.Scorer(texts, y, screen=toxicity.chosen_screen(list(range(900)), texts, y))
    assert 1 in model.features
