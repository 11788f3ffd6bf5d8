r"""Personal data: fixed patterns, and a character-level BiLSTM with CRF that adds spans.

The patterns give the base spans (email, ip, card, phone). The tagger is trained from labelled spans:
windows around base spans of a sample of documents and spelled variants of them (a blank around `@`,
a phone without `+`, other separators), with windows around other digits as counter-examples. The
sample is bounded by ``SAMPLE`` windows of each kind, chosen by hash; all else covers whole texts.

Each span holds a digit or `@`, so the tagger reads only the surroundings of those characters, in
overlapping windows; around `@` these reach as far as characters of an address run on. Scores of
overlapping windows are averaged position by position, and one best path is decoded over the whole
stretch, so no window edge cuts a span; a decoded part of an e-mail stands for the whole address. A
decoded span is added where it meets no base span and passes the checks of its kind (characters,
digits, parts, Luhn); base spans always stay.

Null texts are empty and have no spans. Equal rows get equal results; nothing is shuffled but the
bounded sample. Without any labelled span no tagger is trained and the base spans are all there is.
Counts and offsets are in code points; the counts are those of the base spans, ``n_added`` the rest. Very long texts are
read whole, stretch by stretch; only for learning a labelled stretch of over 400 characters is passed over. An empty table
gives no rows; only the id and the text are read (``redact`` hands every other column on as it is).
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from clozemill.llm.common import frames, opened, share, type_of
from clozemill.llm.tagger import PAD, Tagger, encode

KINDS = ("email", "ip", "card", "phone")
SAMPLE = 500
STEPS, STRIDE, MARGIN = 64, 32, 24

# Fixed patterns. A match can only begin where a run of its first class begins, so the look-behinds
# change no match and keep long runs linear; the email's local part is found backwards from `@`.
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
LOCAL_SET = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
TRIGGER = re.compile(r"[0-9@]")
# What may stand behind the `@` of a spaced address; a dot with one blank ends a sentence.
BEHIND = re.compile(r"\s?[A-Za-z0-9-]++(?:(?:\.|\s\.\s)[A-Za-z0-9-]++)*+")
# Cells of scores (stretches times the longest of them) decoded at once.
CELLS = 1 << 18


def digits(text: str) -> str:
    return re.sub("[^0-9]", "", text)


def luhn(number: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(number)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def card_ok(text: str) -> bool:
    number = digits(text)
    return 16 <= len(number) <= 19 and luhn(number)


def ip_ok(text: str) -> bool:
    return all(len(p.lstrip("0")) <= 3 and int(p) <= 255 for p in text.split("."))


def phone_ok(text: str) -> bool:
    return 8 <= len(digits(text)) <= 15


def emails(text: str) -> list[tuple[int, int]]:
    out, free, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in LOCAL_SET:
            start -= 1
        m = DOMAIN.match(text, at + 1) if start < at else None
        if m:
            out.append((start, m.end()))
            free = m.end()
        else:
            free = max(free, start)
        at = text.find("@", max(at + 1, free if m else at + 1))
    return out


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end), ordered by kind and start."""
    found = [(0, s, e) for s, e in emails(text)]
    for kind, pattern, ok in ((1, IP, ip_ok), (2, CARD, card_ok), (3, PHONE, phone_ok)):
        found += [(kind, m.start(), m.end()) for m in pattern.finditer(text) if ok(m.group())]
    return found


def address(text: str, at: int) -> tuple[int, int]:
    """The stretch that characters of an address run on around the `@` at this place."""
    start = at - (at > 0 and text[at - 1].isspace())
    while start > 0 and text[start - 1] in LOCAL_SET:
        start -= 1
    m = BEHIND.match(text, at + 1)
    return start, m.end() if m else at + 1


def regions(text: str, margin: int = MARGIN, whole: bool = False) -> list[tuple[int, int]]:
    """Stretches around digits and `@`, merged where they meet; ``whole`` ones hold all of an address."""
    out: list[list[int]] = []
    for m in TRIGGER.finditer(text):
        s, e = m.start(), m.end()
        if whole and m.group() == "@":
            s, e = address(text, s)
        s, e = max(0, min(s, m.start() - margin)), min(len(text), max(e, m.end() + margin))
        while out and s <= out[-1][1]:
            first, last = out.pop()
            s, e = min(s, first), max(e, last)
        out.append([s, e])
    return [(s, e) for s, e in out]


def joined(spans) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for k, s, e in sorted(spans))


def plausible(kind: int, text: str) -> bool:
    """Checks an added span has to pass."""
    if kind == 0:
        return bool(re.fullmatch(r"[A-Za-z0-9._%+-]+\s?@\s?[A-Za-z0-9-]+(?:\s?\.\s?[A-Za-z0-9-]+)+", text))
    if kind == 1:
        parts = re.split(r"\s?\.\s?", text)
        return len(parts) == 4 and all(p.isascii() and p.isdigit() for p in parts) and ip_ok(".".join(parts))
    if kind == 2:
        return not re.search(r"[^0-9 ./-]", text) and card_ok(text)
    return bool(re.fullmatch(r"\+?\(?[0-9][\x20().0-9-]*[0-9]", text)) and phone_ok(text)


def whole_span(kind: int, text: str, lo: int, hi: int) -> tuple[int, int] | None:
    """The span to add for a decoded stretch, or none."""
    if kind == 0:
        at = text.find("@", lo, hi)
        if at >= 0:
            s, e = address(text, at)
            for end in (max(hi, e), e):
                if plausible(kind, text[s:end]):
                    return s, end
    return (lo, hi) if plausible(kind, text[lo:hi]) else None


def added_spans(model: Tagger, texts: list[str], base: list[list]) -> list[list]:
    """Spans of the tagger that meet no base span."""
    where, windows, places = [], [], []
    for d, text in enumerate(texts):
        code = None
        for s, e in regions(text, whole=True):
            code = encode(text) if code is None else code
            own = []
            at = s
            while True:
                stop = min(at + STEPS, e)
                row = np.full(STEPS, PAD, np.int16)
                row[:stop - at] = code[at:stop]
                own.append((len(windows), at - s, stop - at))
                windows.append(row)
                if stop == e:
                    break
                at += STRIDE
            where.append((d, s, e))
            places.append(own)
    out: list[list] = [[] for _ in texts]
    if not windows:
        return out
    scores = np.concatenate([model.emissions(np.stack(windows[i:i + 512]))
                             for i in range(0, len(windows), 512)])
    slope = np.minimum(np.arange(1, STEPS + 1), np.arange(STEPS, 0, -1)).astype(np.float32)
    order = sorted(range(len(where)), key=lambda r: where[r][2] - where[r][1])
    at = 0
    while at < len(order):
        # Ascending lengths: the last of a group is its longest.
        n = 1
        while n < 64 and at + n < len(order) and (n + 1) * (where[order[at + n]][2] - where[order[at + n]][1]) <= CELLS:
            n += 1
        group = order[at:at + n]
        at += n
        longest = where[group[-1]][2] - where[group[-1]][1]
        mean = np.zeros((len(group), longest, model.tags), np.float32)
        weight = np.zeros((len(group), longest, 1), np.float32)
        for i, r in enumerate(group):
            for w, begin, n in places[r]:
                mean[i, begin:begin + n] += scores[w, :n] * slope[:n, None]
                weight[i, begin:begin + n, 0] += slope[:n]
        paths = model.decode(mean / np.maximum(weight, 1e-6))
        for i, r in enumerate(group):
            d, s, e = where[r]
            path = paths[i, :e - s]
            for start in np.flatnonzero(path % 2 == 1).tolist():
                end = start + 1
                while end < len(path) and path[end] == path[start] + 1:
                    end += 1
                kind = int(path[start]) // 2
                lo, hi = whole_span(kind, texts[d], s + start, s + end) or (0, 0)
                if lo < hi and all(hi <= a or lo >= b for _, a, b in base[d] + out[d]):
                    out[d].append((kind, lo, hi))
    return out


def labelled(text: str) -> list[tuple[str, str, int, int]]:
    """(kind or `none`, stretch of text, start, end of the span in it) of one text."""
    base = base_spans(text)
    out = [(KINDS[k], text[max(0, s - 40):e + 40], s - max(0, s - 40), e - max(0, s - 40))
           for k, s, e in base]
    for s, e in regions(text, 4):
        if all(b <= s or a >= e for _, a, b in base):
            out.append(("none", text[max(0, s - 30):e + 30], 0, 0))
    return out


def sample(docs: DataFrame, text: str = "text", size: int = SAMPLE) -> list:
    """At most ``size`` labelled stretches of each kind, those with the least hash."""

    def work(batches):
        for _, data, offsets in frames(batches, text):
            rows = [x for d in touched(data, offsets)
                    for x in labelled(bytes(data[offsets[d]:offsets[d + 1]]).decode("utf-8", "replace"))]
            rows = [x for x in rows if len(x[1]) <= 400]
            yield pa.record_batch({
                "kind": pa.array([r[0] for r in rows], pa.string()),
                "piece": pa.array([r[1] for r in rows], pa.string()),
                "s": pa.array([r[2] for r in rows], pa.int32()),
                "e": pa.array([r[3] for r in rows], pa.int32())})

    found = docs.select(text).mapInArrow(work, "kind string, piece string, s int, e int")
    key = W.partitionBy("kind").orderBy(F.xxhash64("piece", "s"), "piece", "s")
    return found.withColumn("n", F.row_number().over(key)).where(F.col("n") <= size).drop(
        "n").orderBy("kind", "piece", "s").collect()


def touched(data: np.ndarray, offsets: np.ndarray) -> list[int]:
    """Texts with a digit or `@`."""
    hit = np.flatnonzero(((data >= 0x30) & (data <= 0x39)) | (data == 0x40))
    return np.unique(np.searchsorted(offsets, hit, "right") - 1).tolist()


def variants(kind: str, span: str) -> list[str]:
    """Spellings of a span that the patterns miss."""
    if kind == "email":
        return [span.replace("@", " @ "), span.replace("@", "@ ")]
    if kind == "ip":
        return [span.replace(".", " . ")]
    if kind == "card":
        d = digits(span)
        return [sep.join(d[i:i + 4] for i in range(0, len(d), 4)) for sep in (".", " - ")]
    return [span.lstrip("+").split(" ", 1)[-1], re.sub(r"[ ()]+", ".", span.lstrip("+")).strip(".")]


def longer(span: str, rng) -> str:
    """An e-mail with more parts in front and behind the `@`."""
    def parts(joint: str) -> str:
        return "".join("".join(chr(97 + int(c)) for c in rng.integers(0, 26, int(rng.integers(3, 15)))) + joint
                       for _ in range(int(rng.integers(3))))

    return parts(".-_"[int(rng.integers(3))]) + span.replace("@", "@" + parts(".-"[int(rng.integers(2))]))


def train(rows: list, seed: int = 11) -> Tagger | None:
    """Fit the tagger to labelled stretches (kind, piece, s, e)."""
    rng, other_rng = np.random.default_rng(seed), np.random.default_rng(seed + 1)
    xs, ys = [], []

    def add(kind: int, piece: str, s: int, e: int, at: int | None = None) -> None:
        if at is None:
            at = max(0, min(s - int(rng.integers(4, 28)), max(0, len(piece) - STEPS)))
        x, y = np.full(STEPS, PAD, np.int16), np.zeros(STEPS, np.int64)
        own = encode(piece)[at:at + STEPS]
        x[:len(own)] = own
        if e > s and s < at + STEPS:
            y[max(s - at, 0):max(min(e - at, STEPS), 0)] = 2 * kind + 2
            if s >= at:
                y[s - at] = 2 * kind + 1
        xs.append(x)
        ys.append(y)

    for row in rows:
        if row.kind == "none":
            add(0, row.piece, 0, 0)
            continue
        kind = KINDS.index(row.kind)
        add(kind, row.piece, row.s, row.e)
        span = row.piece[row.s:row.e]
        options = variants(row.kind, span)
        other = options[int(rng.integers(len(options)))]
        add(kind, row.piece[:row.s] + other + row.piece[row.e:], row.s, row.s + len(other))
        if row.kind == "email":
            # Windows of a long address begin anywhere in front of its `@` or in it.
            other = variants(row.kind, longer(span, other_rng))[int(other_rng.integers(2))]
            piece = row.piece[:row.s] + other + row.piece[row.e:]
            at = row.s + int(other_rng.integers(-28, max(other.index("@") - 7, -27)))
            add(kind, piece, row.s, row.s + len(other), max(0, at))
    if not any((y > 0).any() for y in ys):
        return None
    model = Tagger(len(KINDS))
    model.fit(np.stack(xs), np.stack(ys))
    return model


def find(docs: DataFrame, id_column: str = "doc_id", text: str = "text",
         model: Tagger | None = None) -> DataFrame:
    """(id, base, added) for every row: lists of (kind, s, e) in code points."""
    shared = share(docs.sparkSession, model)
    kind = pa.list_(pa.struct([("k", pa.int32()), ("s", pa.int32()), ("e", pa.int32())]))

    def work(batches):
        tagger = opened(shared)
        for rows, data, offsets in frames(batches, text):
            n = len(offsets) - 1
            base, added = [[] for _ in range(n)], [[] for _ in range(n)]
            own = touched(data, offsets)
            texts = [bytes(data[offsets[d]:offsets[d + 1]]).decode("utf-8", "replace") for d in own]
            first = [base_spans(t) for t in texts]
            more = added_spans(tagger, texts, first) if tagger else [[] for _ in own]
            for d, a, b in zip(own, first, more):
                base[d], added[d] = a, sorted(b)
            pack = lambda lists: pa.array(
                [[dict(zip("kse", x)) for x in one] for one in lists], kind)
            yield pa.record_batch({
                id_column: rows.column(rows.schema.get_field_index(id_column)),
                text: rows.column(rows.schema.get_field_index(text)),
                "base": pack(base), "added": pack(added)})

    spans = "array<struct<k:int,s:int,e:int>>"
    return docs.select(id_column, text).mapInArrow(
        work, f"{id_column} {type_of(docs, id_column)}, {text} string, base {spans}, added {spans}")


def named(spans):
    """Spans as `kind:start:end`, ordered by kind as listed, then start."""
    kinds = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(F.sort_array(spans), lambda x: F.concat_ws(
        ":", F.get(kinds, x["k"]), x["s"].cast("string"), x["e"].cast("string"))), ",")


def query(docs: DataFrame) -> DataFrame:
    found = find(docs, model=train(sample(docs)))
    count = lambda k: F.size(F.filter("base", lambda x: x["k"] == k)).cast("long")
    return found.select(
        "doc_id", *[count(i).alias(f"n_{k}") for i, k in enumerate(KINDS)],
        F.sha2(named(F.col("base")), 256).alias("base_sha256"),
        named(F.concat("base", "added")).alias("spans"),
        F.size("added").cast("long").alias("n_added"))


def redacted_text(text: str, spans: list[tuple[int, int, int]]) -> str:
    """Each stretch of touching spans becomes the name of its first kind."""
    out, at = [], 0
    for s, e, k in sorted((s, e, k) for k, s, e in spans):
        if s >= at:
            out += [text[at:s], f"<{KINDS[k].upper()}>"]
            at = e
        else:
            at = max(at, e)
    return "".join([*out, text[at:]])


def redact(docs: DataFrame, model: Tagger | None = None) -> DataFrame:
    """The same rows and columns, personal data replaced; ``n_chars`` follows the text."""
    shared = share(docs.sparkSession, model or train(sample(docs)))
    at = docs.columns.index("text")
    size = docs.columns.index("n_chars") if "n_chars" in docs.columns else None

    def work(batches):
        tagger = opened(shared)
        for rows, data, offsets in frames(batches, "text"):
            own = touched(data, offsets)
            texts = [bytes(data[offsets[d]:offsets[d + 1]]).decode("utf-8", "replace") for d in own]
            base = [base_spans(t) for t in texts]
            more = added_spans(tagger, texts, base) if tagger else [[] for _ in own]
            new = {d: redacted_text(t, a + b) for d, t, a, b in zip(own, texts, base, more) if a or b}
            if new:
                columns = rows.columns
                values = columns[at].to_pylist()
                for d, t in new.items():
                    values[d] = t
                columns[at] = pa.array(values, columns[at].type)
                if size is not None:
                    counts = columns[size].to_pylist()
                    for d, t in new.items():
                        counts[d] = len(t)
                    columns[size] = pa.array(counts, columns[size].type)
                rows = pa.record_batch(columns, schema=rows.schema)
            yield rows

    return docs.mapInArrow(work, docs.schema)
