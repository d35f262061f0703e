"""Tokens of two tokenizers over the same texts, aligned by a dangling-suffix transducer.

Both token streams spell the same bytes. The side that leads has a token with bytes that the other has not spelled yet,
its dangling suffix; the other side's next token eats from it, leaves the rest, or becomes the leader with what it has
beyond. Each step is one pair of tokens whose bytes overlap, a link; an empty suffix closes a group. A step depends on
the suffix and the next token alone and is remembered by both.

Texts are cut before the first of each run of spaces and line feeds: no token of either kind goes on over that place, so
pieces are aligned on their own and remembered too. Texts with other white space are aligned whole.
"""

from __future__ import annotations

import hashlib
import re
from array import array
from collections.abc import Iterator

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenfare.llm.common import forget, kept, prepare, stored
from lumenfare.llm.encoding import _Words, byte_letters

#: Pieces and states that a worker remembers, letters of a remembered piece, and id pairs whose counts are broadcast at once.
REMEMBERED, STATES, SHORT, AT_ONCE = 1 << 19, 1 << 18, 64, 1 << 22
_PIECE = re.compile(r"[ \n]+[^ \n]*")
_ODD = re.compile(r"[^\S \n]|[\x1c-\x1f\x85\u180e\u200b-\u200f\ufeff]")
_MARKS = ".,!?;:"
#: A link is the number a << 32 | b; the first link of each A token has this bit as well.
_FIRST = 1 << 62


class Transducer:
    """align(a, b) for two lists of ids; a_bytes and b_bytes give each id's bytes.

    States are numbered: positive where A leads, negative where B does, 0 for an empty suffix; `steps` has, for a state
    and the lagging side's next token, the state that follows.
    """

    def __init__(self, a_bytes: list[bytes], b_bytes: list[bytes]):
        self.sides = (a_bytes, b_bytes)
        self.text = tuple([str(i) for i in range(len(side))] for side in self.sides)
        self.clear()

    def clear(self) -> None:
        self.number: dict[tuple[bool, bytes], int] = {}
        self.suffix: dict[int, bytes] = {}
        self.steps: dict[int, dict[int, int | None]] = {}
        self.begun: dict[int, int] = {}

    def state(self, a_leads: bool, suffix: bytes) -> int:
        if not suffix:
            return 0
        if (a_leads, suffix) not in self.number:
            n = (len(self.number) + 1) * (1 if a_leads else -1)
            self.number[a_leads, suffix], self.suffix[n], self.steps[n] = n, suffix, {}
        return self.number[a_leads, suffix]

    def step(self, state: int, token: int) -> int | None:
        """The state after the lagging side's next token; None if its bytes disagree with the suffix."""
        rest, spelled, a_leads = self.suffix[state], self.sides[state > 0][token], state > 0
        if rest.startswith(spelled):
            to = self.state(a_leads, rest[len(spelled) :])
        elif spelled.startswith(rest):
            to = self.state(not a_leads, spelled[len(rest) :])
        else:
            to = None
        self.steps[state][token] = to
        return to

    def align(self, a: list[int], b: list[int]) -> tuple[bytes, bytes] | None:
        """(groups as text, links as 64-bit numbers), or None where the two don't spell the same."""
        if len(self.number) > STATES:
            self.clear()
        steps, (text_a, text_b), links, groups, i, j = self.steps, self.text, [], [], 0, 0
        try:
            while i < len(a):
                i0, j0, lead = i, j, a[i]
                state = self.begun.get(lead)
                if state is None:
                    state = self.begun[lead] = self.state(True, self.sides[0][lead])
                i += 1
                mark = _FIRST
                while state:
                    if state > 0:
                        token = b[j]
                        j += 1
                    else:
                        token = lead = a[i]
                        i += 1
                        mark = _FIRST
                    links.append(lead << 32 | b[j - 1] | mark)
                    mark = 0
                    known = steps[state]
                    state = known[token] if token in known else self.step(state, token)
                    if state is None:
                        return None
                if i - i0 == 1 and j - j0 == 1:
                    groups.append(text_a[lead] + "|" + text_b[b[j0]])
                else:
                    groups.append(",".join([text_a[x] for x in a[i0:i]]) + "|" + ",".join([text_b[x] for x in b[j0:j]]))
        except IndexError:  # one side has ended within a token of the other
            return None
        return (";".join(groups).encode(), array("q", links).tobytes()) if j == len(b) else None


class Aligner:
    """Alignments of whole texts by two tokenizer files, a byte-level BPE and a sentencepiece model that adds a space."""

    def __init__(self, byte_level: str, pieces: str):
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(byte_level)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=pieces)
        letters = {c: b for b, c in byte_letters().items()}
        spell = lambda t: bytes(letters[c] for c in t) if t and all(c in letters for c in t) else (t or "").encode()
        a = [spell(self.a.id_to_token(i)) for i in range(self.a.get_vocab_size())]
        names = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        b = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(names)]
        self.space, self.transducer = self.b.piece_to_id("▁"), Transducer(a, b)
        self.words = _Words(self.a, " ", False)
        #: Marks that no piece of the model joins to a letter before it; a word and such a mark align on their own.
        self.apart = {m for m in _MARKS if not any(x.isalpha() and y == m for p in names for x, y in zip(p, p[1:]))}
        self.marks = {m: self.transducer.align(self.a.encode(m, add_special_tokens=False).ids, self.b.encode("\n" + m)[2:]) for m in self.apart}
        self.known: dict[str, tuple[bytes, bytes] | None] = {}
        self.older: dict[str, tuple[bytes, bytes] | None] = {}

    def learn(self, pieces: list[str]) -> None:
        """Puts the alignments of new pieces into known."""
        tokenize, align, lead = self.a.model.tokenize, self.transducer.align, self.words.lead
        for p, b in zip(pieces, self.b.encode([p[1:] if p[0] == " " else p for p in pieces], num_threads=1)):
            word = p[1:]
            if p[0] == " " and word.isascii() and word.isalpha():
                self.known[p] = align([t.id for t in tokenize(lead + word)], b)
                continue
            if p[0] == " " and word and word[0] not in " \n":
                a = array("I", self.words[word]).tolist()
            else:
                a = self.a.encode(p, add_special_tokens=False).ids
            if p == " ":  # the model puts no space before nothing
                b = [self.space]
            elif p[0] != " ":  # but one before a line feed
                a, b = (a, b[1:]) if b[:1] == [self.space] else ([], [0])
            found = align(a, b)
            spelled = b"".join([self.transducer.sides[0][i] for i in a])
            self.known[p] = found if spelled == p.encode("utf-8", "surrogatepass") else None
        self.words.clear()

    def texts(self, texts: list[str | None]) -> Iterator[list[tuple[bytes, bytes]] | None]:
        """Each text's pieces in order; None for texts without tokens."""
        if len(self.known) > REMEMBERED // 2:
            self.older, self.known = self.known, {}
        known, older, long = self.known, self.older, set()
        cut, joined, new = [], {}, {}
        for t in texts:
            pieces = None if not t else [" " + t] if _ODD.search(t) else _PIECE.findall(" " + t)
            cut.append(pieces)
            for p in [p for p in pieces or () if p not in known]:
                if p in joined or p in new:
                    continue
                if p in older:
                    known[p] = older[p]
                elif p[-1] in self.apart and len(p) > 2 and p[-2].isalpha():
                    core = p[:-1]
                    joined[p] = core
                    if core in older:
                        known[core] = older[core]
                    elif core not in known:
                        new[core] = None
                else:
                    new[p] = None
        fresh = list(new)
        for low in range(0, len(fresh), 4096):
            self.learn(fresh[low : low + 4096])
        for p, core in joined.items():
            head, mark = known[core], self.marks[p[-1]]
            known[p] = (head[0] + b";" + mark[0], head[1] + mark[1]) if head else None
        for pieces in cut:
            found = None if pieces is None else list(map(known.__getitem__, pieces))
            yield None if found is None or None in found else found
        for p in [*fresh, *joined]:
            if len(p) > SHORT:
                known.pop(p, None)


def summed(found: list[tuple[bytes, bytes]]) -> tuple[int, int, int, int, str, np.ndarray, np.ndarray]:
    """Of a text's pieces: numbers of A and B tokens, groups and links, the groups' digest, and the distinct links with
    how often each occurs. A group's tokens and links make a path, so B tokens are links and groups less A tokens."""
    text = b";".join([g for g, _ in found])
    links = np.frombuffer(b"".join([x for _, x in found]), np.int64)
    n_a, n_groups = np.count_nonzero(links & _FIRST), text.count(b"|")
    codes = np.sort(links & (_FIRST - 1))
    new = np.flatnonzero(np.concatenate(([True], codes[1:] != codes[:-1])))
    return n_a, len(links) + n_groups - n_a, n_groups, len(links), hashlib.sha256(text).hexdigest(), codes[new], np.diff(np.append(new, len(codes)))


_aligners: dict[tuple[str, str], Aligner] = {}
kept.append(_aligners)


def aligner(byte_level: str, pieces: str) -> Aligner:
    """One Aligner per worker process, until another operator's task comes to it."""
    forget(_aligners)
    if (byte_level, pieces) not in _aligners:
        _aligners[byte_level, pieces] = Aligner(byte_level, pieces)
    return _aligners[byte_level, pieces]


def packed(codes: np.ndarray, times: np.ndarray) -> bytes:
    """Rising codes, as steps, and how often each occurs, compressed."""
    return zstandard.compress(np.diff(codes, prepend=0).astype("<i8").tobytes() + times.astype("<i8").tobytes(), 1)


def unpacked(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    steps, times = np.frombuffer(zstandard.decompress(data), "<i8").reshape(2, -1)
    return np.cumsum(steps), times


_TEXTS = "row long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, links binary"
_ZERO = (0, 0, 0, 0, "", packed(np.empty(0, np.int64), np.empty(0, np.int64)))


def aligned_texts(documents: DataFrame, byte_level: str, pieces: str) -> DataFrame:
    """(row, doc_id, n_a, n_b, n_groups, n_links, groups_sha256, links) of every row; links holds the distinct id pairs
    that the row has linked and how often each. Null and empty texts, and those that the two don't spell alike, have
    no tokens."""

    def emit(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        use = aligner(byte_level, pieces)
        for pdf in frames:
            out = []
            for found in use.texts(pdf.text.tolist()):
                if found is None:
                    out.append(_ZERO)
                    continue
                *sizes, codes, times = summed(found)
                out.append((*sizes, packed(codes, times)))
            rest = pd.DataFrame(out, columns=["n_a", "n_b", "n_groups", "n_links", "groups_sha256", "links"])
            yield pd.concat([pdf[["row"]], pdf[["doc_id"]].astype("Int64"), rest], axis=1)

    texts = documents.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return texts.mapInPandas(emit, _TEXTS)


def pair_counts(aligned: DataFrame) -> DataFrame:
    """(code, n): in how many rows of aligned_texts() each id pair is linked. A task adds its rows up first."""

    def emit(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        forget()
        codes, counts, waiting, size = np.empty(0, np.int64), np.empty(0, np.int64), [], 0

        def merged() -> tuple[np.ndarray, np.ndarray]:
            every = np.concatenate([codes, *waiting])
            code, at = np.unique(every, return_inverse=True)
            weight = np.concatenate([counts, np.ones(len(every) - len(counts), np.int64)])
            return code, np.bincount(at, weights=weight, minlength=len(code)).astype(np.int64)

        for pdf in frames:
            for data in pdf.links:
                waiting.append(unpacked(data)[0])
                size += len(waiting[-1])
                if size > 1 << 20:
                    (codes, counts), waiting, size = merged(), [], 0
                    if len(codes) > 1 << 20:
                        yield pd.DataFrame({"code": codes, "n": counts})
                        codes, counts = codes[:0], counts[:0]
        codes, counts = merged()
        yield pd.DataFrame({"code": codes, "n": counts})

    return aligned.select("links").mapInPandas(emit, "code long, n long").groupBy("code").agg(F.sum("n").alias("n"))


def align(documents: DataFrame, byte_level: str, pieces: str) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) for every row of documents.

    count_sum adds, over a row's links, the number of rows in which their id pair is linked; n_best counts the links
    whose pair is as frequent as any of its A id. Pairs are of vocabularies of fixed size; their counts are broadcast in
    blocks of A ids with about AT_ONCE pairs each, and every block adds its share to the rows. Repeated rows count each;
    an empty table gives none; other columns are ignored.
    """
    spark = prepare(documents.sparkSession)
    rows = stored(aligned_texts(documents, byte_level, pieces))
    counts = pair_counts(rows).withColumn("a", F.shiftright("code", 32))
    best = counts.groupBy("a").agg(F.max("n").alias("best"))
    counts = stored(counts.join(best, "a").select("a", "code", F.when(F.col("n") == F.col("best"), F.col("n")).otherwise(-F.col("n")).alias("n")))
    blocks, parts = max(1, -(-counts.count() // AT_ONCE)), None
    for k in range(blocks):
        c = counts.where(F.pmod("a", F.lit(blocks)) == k).select("code", "n").toPandas().sort_values("code")
        table = spark.sparkContext.broadcast((c.code.to_numpy(np.int64), c.n.to_numpy(np.int64)))

        def look_up(frames: Iterator[pd.DataFrame], table=table) -> Iterator[pd.DataFrame]:
            forget()
            codes, n = table.value
            for pdf in frames:
                out = []
                for data in pdf.links:
                    code, times = unpacked(data)
                    at = np.minimum(np.searchsorted(codes, code), max(0, len(codes) - 1))
                    hit = codes[at] == code if len(codes) else np.zeros(len(code), bool)
                    found = n[at[hit]] if len(codes) else n
                    times = times[hit]
                    out.append((int(times[found > 0].sum()), int((times * abs(found)).sum())))
                yield pd.concat([pdf[["row"]], pd.DataFrame(out, columns=["n_best", "count_sum"])], axis=1)

        part = rows.select("row", "links").mapInPandas(look_up, "row long, n_best long, count_sum long")
        parts = part if parts is None else parts.unionByName(part)
    sums = parts.groupBy("row").agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))
    return rows.drop("links").join(sums, "row").select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
