"""Personal data: fixed patterns, and a semi-Markov conditional random field that adds what they miss.

The base spans come from patterns with checks (octets, Luhn, digit counts). The field then reads the windows of tokens
around digits, `@` and spelled-out `at`: features of a whole candidate segment (its digit count, checks, separators,
the words before it) score email, ip, card, phone or outside, and bounded-length dynamic programming chooses boundaries
and types of a window jointly. Segments of the best reading that overlap no base span are added.

The field is trained here by stochastic gradients on the conditional likelihood of generated windows (`EXAMPLES` of
them, fixed seed): entities in the base forms and in spelled-out or loosely separated forms, among look-alikes such as
version numbers, dates, failing check digits, keys and hashes, which stay outside.
"""

from __future__ import annotations

import functools
import hashlib
import itertools
import math
import random
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lumenfare.llm.common import forget, prepare

KINDS = ("email", "ip", "card", "phone")
#: Tokens that a segment has at most, and one without `@` or `at`.
LONGEST, LONGEST_NUMBER = 32, 16
EXAMPLES, EPOCHS = 700, 6
#: Characters on either side of a trigger that a window takes in at least.
AROUND = 24

# The base patterns. A match of IP can't begin within digits, which a look-behind says outright.
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
_LOCAL = re.compile(r"[A-Za-z0-9._%+-]*\Z")
_IP = re.compile(r"(?<![0-9])[0-9]++(\.[0-9]++)(\.[0-9]++)(\.[0-9]+)")
_CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGITS = re.compile(r"[0-9]")
_LOCAL_CHARS = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789._%+-")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def _only_digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Base matches by kind as listed, then start; failing matches are dropped and not tried again."""
    out, last, at = [], 0, text.find("@")
    while at >= 0:
        low = at
        while low > last and text[low - 1] in _LOCAL_CHARS:
            low -= 1
        m = _DOMAIN.match(text, at) if low < at else None
        if m:
            out.append(("email", low, m.end()))
        last = m.end() if m else at + 1
        at = text.find("@", last)
    if _DIGITS.search(text):
        if "." in text:
            out += [("ip", *m.span()) for m in _IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p[-4:]) <= 255 and (len(p) < 5 or not p[:-4].strip("0")) for p in m[0].split("."))]
        out += [("card", *m.span()) for m in _CARD.finditer(text) if m.end() - m.start() <= 40 and 16 <= len(d := _only_digits(m[0])) <= 19 and luhn(d)]
        if "+" in text:
            out += [("phone", *m.span()) for m in _PHONE.finditer(text) if 8 <= len(_only_digits(m[0])) <= 15]
    return out


# ---------------------------------------------------------------- the field

_TOKEN = re.compile(r"[0-9]{1,64}|[A-Za-z]{1,64}|\s|[^\sA-Za-z0-9]")
_TRIGGER = re.compile(r"[0-9][0-9 .()/-]{5,}[0-9]|@|[\[( ](?:at|AT)[\]) ]")
_RUN = re.compile(r"\d+|[A-Za-z]+|\s+")
_AT = re.compile(r"\s*(?:@|[\[(]\s*at\s*[\])]|\sat\s)\s*", re.I)
_DOT = re.compile(r"\s*(?:\.|[\[(]\s*dot\s*[\])]|\sdot\s)\s*", re.I)


def _shape(s: str) -> str:
    return _RUN.sub(lambda m: "9" if m[0][0].isdigit() else " " if m[0].isspace() else "a", s)[:24]


def segment_features(kind: str, seg: str, before: str, after: str) -> list[str]:
    """Names of the features of a whole segment under a kind; before and after: its neighbouring characters."""
    digits = _only_digits(seg)
    n, seps = len(digits), frozenset(c for c in seg if not c.isalnum())
    out = [f"{kind}", f"{kind}:first={_shape(seg[0])}", f"{kind}:last={_shape(seg[-1])}", f"{kind}:edge={_shape(before[-1:])}|{_shape(after[:1])}"]
    if kind == "email":
        parts = _AT.split(seg)
        ok = len(parts) == 2 and bool(re.fullmatch(r"[A-Za-z0-9._%+-]+", parts[0]))
        dots = _DOT.split(parts[1]) if ok else []
        ok = ok and len(dots) >= 2 and all(re.fullmatch(r"[A-Za-z0-9-]+", d) for d in dots) and dots[-1].isalpha()
        out.append(f"email:form={ok}")
        out.append(f"email:whole={before[-1:].isalnum() or before[-1:] in '._%+-' and bool(before)}|{after[:1].isalnum()}")
    elif kind == "ip":
        parts = re.split(r"\s*\.\s*", seg)
        out.append(f"ip:form={len(parts) == 4 and all(p.isdigit() and len(p) <= 3 and int(p) <= 255 for p in parts)}")
        out.append(f"ip:more={bool(re.search(r'[0-9][ .]*$', before))}|{bool(re.match(r' *[.]? *[0-9]', after))}")
    elif kind == "card":
        out.append(f"card:check={16 <= n <= 19 and luhn(digits)}|{seps <= set(' -./')}|{not any(c.isalpha() for c in seg)}")
        out.append(f"card:more={bool(re.search(r'[0-9A-Za-z]$', before))}|{bool(re.match(r'[0-9A-Za-z]', after))}")
    else:
        out.append(f"phone:digits={min(n, 16) if n < 8 or n > 13 else 'fit'}|{seps <= set(' ().-+/')}|{any(c.isalpha() for c in seg)}")
        out.append(f"phone:sign={'plus' if seg[0] == '+' else 'area' if re.match(r'[(][0-9]{3}[)] ?[0-9]{3}[-. ][0-9]{4}$', seg) else 'groups' if re.fullmatch(r'[0-9]{3}[-.][0-9]{3}[-.][0-9]{4}', seg) else 'zeros' if re.fullmatch(r'00[0-9]{2}[ ()0-9-]+', seg) else 'trunk' if re.fullmatch(r'0[0-9]{2,4} [0-9]{3,4} ?[0-9]{3,4}', seg) else 'none'}")
        out.append(f"phone:more={bool(re.search(r'[0-9A-Za-z+.]$', before))}|{bool(re.match(r'[0-9A-Za-z]|[.-][0-9]', after))}")
    return out


def _candidates(tokens: list[str], i: int) -> Iterator[tuple[int, tuple[str, ...]]]:
    """(end, exclusive; kinds) of the segments that may be an entity from token i on, by bounded length and allowed
    tokens: with `@` or `at` an address, else one of the kinds of number."""
    first = tokens[i]
    if not (first[0].isalnum() or first in "+("):
        return
    digits = spelled = 0
    for j in range(i, min(len(tokens), i + LONGEST)):
        t = tokens[j]
        digits += len(t) if t[0].isdigit() else 0
        spelled |= t == "@" or t.lower() == "at"
        if t == "\n" or (t[0].isspace() and j + 1 < len(tokens) and tokens[j + 1][0].isspace()):
            return
        if spelled and t.isalpha() and j > i:
            yield j + 1, KINDS[:1]
        elif not spelled and t[0].isalnum() and digits >= (4 if j > i else 16) and j < i + LONGEST_NUMBER:
            yield j + 1, KINDS[1:]


class Field:
    """Weights of a semi-Markov field, read and trained by dynamic programming over a window's tokens."""

    def __init__(self, weights: dict[str, float] | None = None):
        self.weights = weights or {}

    def places(self, text: str, low: int, high: int) -> list[tuple[int, int]]:
        """Places of the tokens of text[low:high]."""
        return [(low + m.start(), low + m.end()) for m in _TOKEN.finditer(text[low:high])]

    def segments(self, text: str, places: list[tuple[int, int]]) -> Iterator[list[tuple[int, str, list[str]]]]:
        """Token by token the segments (end, kind, features) that begin with it, made as they are read: a long window
        holds those of one token at a time."""
        tokens = [text[a:b] for a, b in places]
        for i, t in enumerate(tokens):
            here = [(i + 1, "", [f"out:{_shape(t)}"])]
            for end, kinds in _candidates(tokens, i):
                a, b = places[i][0], places[end - 1][1]
                here += [(end, k, segment_features(k, text[a:b], text[max(0, a - 12) : a], text[b : b + 12])) for k in kinds]
            yield here

    def lattice(self, text: str, low: int, high: int) -> tuple[list[tuple[int, int]], list[list[tuple[int, str, list[str]]]]]:
        """Token places of text[low:high], and all segments, for windows that are learned from."""
        places = self.places(text, low, high)
        return places, list(self.segments(text, places))

    def _score(self, names: list[str]) -> float:
        return sum(self.weights.get(n, 0.0) for n in names)

    def best(self, text: str, low: int, high: int) -> list[tuple[str, int, int]]:
        """Entities of the best segmentation of a window."""
        places = self.places(text, low, high)
        best: list[tuple[float, int, str]] = [(0.0, -1, "")] + [(-math.inf, -1, "")] * len(places)
        for i, here in enumerate(self.segments(text, places)):
            for end, kind, names in here:
                s = best[i][0] + self._score(names)
                if s > best[end][0]:
                    best[end] = (s, i, kind)
        out, i = [], len(places)
        while i > 0:
            _, j, kind = best[i]
            if kind:
                out.append((kind, places[j][0], places[i - 1][1]))
            i = j
        return out[::-1]


class _Lattice:
    """A window's segments in numbers: places of beginnings and ends, features in a row, and which are in the gold."""

    def __init__(self, field: Field, text: str, gold: set[tuple[str, int, int]], index: dict[str, int]):
        places, arcs = field.lattice(text, 0, len(text))
        inside = {i for _, a, b in gold for i in range(a, b)}
        self.n, self.begin, self.end, self.true, features = len(places), [], [], [], []
        for i, here in enumerate(arcs):
            for end, kind, names in here:
                a, b = places[i][0], places[end - 1][1]
                self.begin.append(i)
                self.end.append(end)
                self.true.append((kind, a, b) in gold if kind else a not in inside)
                features.append([index.setdefault(x, len(index)) for x in names])
        self.size = np.array([len(f) for f in features])
        self.features = np.concatenate([np.array(f) for f in features])
        self.first = np.concatenate([[0], np.cumsum(self.size)[:-1]])
        self.gold = np.array(self.true, float)

    def probabilities(self, weights: np.ndarray) -> np.ndarray:
        """Of each segment to stand in a segmentation, by the forward and backward sums over all of them."""
        s = np.add.reduceat(weights[self.features], self.first)
        scores, n = s.tolist(), self.n
        fore, back = [-math.inf] * (n + 1), [-math.inf] * (n + 1)
        fore[0] = back[n] = 0.0
        for i, end, x in zip(self.begin, self.end, scores):
            x += fore[i]
            y = fore[end]
            fore[end] = x if y == -math.inf else max(x, y) + math.log1p(math.exp(-abs(x - y)))
        for i, end, x in zip(reversed(self.begin), reversed(self.end), reversed(scores)):
            x += back[end]
            y = back[i]
            back[i] = x if y == -math.inf else max(x, y) + math.log1p(math.exp(-abs(x - y)))
        return np.exp(np.minimum(0.0, np.array(fore)[self.begin] + s + np.array(back)[self.end] - fore[n]))


def _example(rng: random.Random) -> tuple[str, set[tuple[str, int, int]]]:
    word = lambda: "".join(rng.choice("abcdefghiklmnoprstuvw") for _ in range(rng.randint(2, 8)))
    num = lambda n: "".join(rng.choice("0123456789") for _ in range(n))
    octet = lambda: str(rng.randint(0, 255))

    def card(good: bool) -> str:
        d = rng.choice("3456") + num(rng.choice((14, 14, 14, 16)))
        d += next(str(c) for c in range(10) if luhn(d + str(c)) == good)
        sep = rng.choice(("", "", " ", "-", ".", "/"))
        return sep.join(d[i : i + 4] for i in range(0, len(d), 4))

    def phone() -> str:
        a, b, c = num(3), num(3), num(4)
        return rng.choice((f"+1 ({a}) {b}-{c}", f"+49 {a} {b}{c}", f"({a}) {b}-{c}", f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"{a}.{b}.{c}", f"0044 {a} {b} {c}", f"0{num(2)} {c} {num(4)}"))

    def email() -> str:
        at = rng.choice(("@", "@", "@", " [at] ", " (at) ", "[at]", " at "))
        dot = {" [at] ": " [dot] ", " (at) ": " (dot) ", "[at]": "[dot]", " at ": " dot "}.get(at, ".")
        local = word() + "".join(rng.choice("._-") + rng.choice((word(), num(2))) for _ in range(rng.choice((0, 0, 1, 1, 2, 3))))
        return local + at + "".join(word() + dot for _ in range(rng.choice((1, 1, 2, 3)))) + rng.choice(("com", "org", "de"))

    def hexes() -> str:
        return rng.choice(('token = "{}"', "password={}")).format("".join(rng.choice("0123456789012345abcdef") for _ in range(rng.choice((18, 32, 40)))))

    makers = {"email": email, "ip": lambda: rng.choice((".", ".", " . ")).join(octet() for _ in range(4)), "card": lambda: card(True), "phone": phone}
    other = (lambda: card(False), lambda: num(rng.choice((4, 5, 8, 9, 10, 12, 14, 16, 20))), lambda: f"{num(1)}.{num(1)}.{num(2)}", lambda: f"{num(4)}-{num(2)}-{num(2)}", lambda: f"{num(3)}.{num(3)}.{num(3)}.{num(3)}.{num(2)}", lambda: "AK" + num(3) + word().upper() + num(4), lambda: num(6) + word() + num(9), hexes, hexes, lambda: f"{word()} at {word()} {word()}", lambda: f"{num(1)},{num(3)},{num(3)}", lambda: f"{num(2)}:{num(2)}:{num(2)}", lambda: f"{num(3)}-{num(4)}", lambda: f"{num(2)} {num(3)} {num(2)}", lambda: f"999.{num(3)}.3{num(2)}.{num(3)}", lambda: f"({num(4)}) {num(2)}")
    text, gold = "", set()
    for _ in range(rng.randint(1, 3)):
        text += " ".join(word() for _ in range(rng.randint(1, 3))) + " "
        if rng.random() < 0.5:
            kind = rng.choice(KINDS)
            s = makers[kind]()
            gold.add((kind, len(text), len(text) + len(s)))
        else:
            s = rng.choice(other)()
        text += s + rng.choice((" ", ". ", ", "))
    return text + word(), gold


def examples(n: int, seed: int) -> list[tuple[str, set[tuple[str, int, int]]]]:
    """n generated windows with their entities."""
    rng = random.Random(seed)
    return [_example(rng) for _ in range(n)]


@functools.cache
def trained(seed: int = 5) -> Field:
    """The field after EPOCHS passes over EXAMPLES generated windows, by steps up the log-likelihood of their
    segmentations; the same at every call."""
    rng, index = random.Random(seed), {}
    given = [_Lattice(Field(), text, gold, index) for text, gold in examples(EXAMPLES, seed)]
    weights = np.zeros(len(index))
    for epoch in range(EPOCHS):
        rng.shuffle(given)
        for x in given:
            step = 0.5 / (1 + epoch) * (x.gold - x.probabilities(weights))
            np.add.at(weights, x.features, np.repeat(step, x.size))
    return Field({name: float(weights[k]) for name, k in index.items()})


def _reach(text: str, at: int, back: bool, last: int = 0) -> int:
    """Where the longest segment with a trigger that begins or ends at a place may end, AROUND characters off at
    least, and not within a word; within a word that reaches over `last` it stops there."""
    far = LONGEST * 64
    part = text[max(0, at - far) : at][::-1] if back else text[at : at + far]
    n = AROUND
    for m in itertools.islice(_TOKEN.finditer(part), LONGEST):
        n = max(n, m.end())
    if back:
        at = max(0, at - n)
        while at > last and text[at - 1].isalnum() and text[at].isalnum():
            at -= 1
    else:
        at = min(len(text), at + n)
        while at > last and at < len(text) and text[at - 1].isalnum() and text[at].isalnum():
            at += 1
    return at


def windows(text: str) -> Iterator[tuple[int, int, int, int]]:
    """(start, end, start of the first trigger, end of the last) of places around triggers that hold the longest
    segments with them, joined where they touch, cut at word ends."""
    low = high = first = end = -1
    for m in _TRIGGER.finditer(text):
        if m[0][0] not in "@[( " and sum(c.isdigit() for c in m[0]) < 8 and m[0].count(".") < 3:
            continue
        b = _reach(text, m.end(), False, high)
        if m[0][0] == " " and not re.search(r"\bdot\b|\.[a-z]{2}", text[m.end() : b], re.I):
            continue
        a = _reach(text, m.start(), True, max(0, high))
        if a <= high:
            high, end = max(high, b), m.end()
            continue
        if high > 0:
            yield low, high, first, end
        low, high, first, end = a, b, m.start(), m.end()
    if high > 0:
        yield low, high, first, end


def all_spans(text: str, field: Field) -> tuple[list[tuple[str, int, int]], list[tuple[str, int, int]]]:
    """(base spans, base and added spans by kind as listed, then start)."""
    base = base_spans(text)
    added = []
    if _DIGITS.search(text) or any(x in text for x in (" at ", "at]", "at)", " AT ", "AT]", "AT)", "@")):
        taken = sorted((a, b) for _, a, b in base)
        for low, high, first, end in windows(text):
            if any(a <= first and end <= b for a, b in taken):
                continue  # one base span holds the triggers
            for kind, a, b in field.best(text, low, high):
                if not any(x < b and a < y for x, y in taken):
                    added.append((kind, a, b))
    return base, sorted({*base, *added}, key=lambda s: (KINDS.index(s[0]), s[1], s[2]))


def _joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def find(documents: DataFrame) -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_added, n_spans) for every row of documents (doc_id, text).

    The counts and the digest (of `kind:start:end` joined by commas; code points) are of base spans; spans lists base
    and added ones. A null or empty text has none: zero counts and the digest of "". Repeated rows and null ids keep
    their places; other columns are ignored.
    """
    spark = prepare(documents.sparkSession)
    shared = spark.sparkContext.broadcast(trained().weights)

    def emit(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        forget()
        field = Field(shared.value)
        for pdf in frames:
            rows = []
            for t in pdf.text.tolist():
                base, every = all_spans(t or "", field)
                rows.append((*(sum(k == s[0] for s in base) for k in KINDS), hashlib.sha256(_joined(base).encode()).hexdigest(), _joined(every), len(every) - len(set(base)), len(every)))
            out = pd.DataFrame(rows, columns=[*(f"n_{k}" for k in KINDS), "base_sha256", "spans", "n_added", "n_spans"])
            out.insert(0, "doc_id", pdf.doc_id.astype("Int64").array)
            yield out

    texts = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return texts.mapInPandas(emit, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long, n_spans long")


def redact(documents: DataFrame) -> DataFrame:
    """documents with every span of its text replaced by its kind in angle brackets; all rows and columns stay.

    Where n_chars is a column it is counted anew. Overlapping spans become one, under the kind that begins first.
    Null texts stay null.
    """
    spark = prepare(documents.sparkSession)
    shared = spark.sparkContext.broadcast(trained().weights)

    @F.pandas_udf(T.StringType())
    def hide(texts: pd.Series) -> pd.Series:
        field = Field(shared.value)
        return texts.map(lambda t: t if t is None else hidden(t, field))

    out = documents.withColumn("text", hide(F.col("text").cast("string")))
    if "n_chars" in documents.columns:
        out = out.withColumn("n_chars", F.length("text").cast(documents.schema["n_chars"].dataType))
    return out.select(*documents.columns)


def hidden(text: str, field: Field) -> str:
    parts, last = [], 0
    for kind, a, b in sorted(all_spans(text, field)[1], key=lambda s: (s[1], -s[2])):
        if a >= last:
            parts += [text[last:a], f"<{kind}>"]
        last = max(last, b)
    return "".join([*parts, text[last:]])
