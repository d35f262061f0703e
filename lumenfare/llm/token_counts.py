"""Token counts without ids: Viterbi over a unigram vocabulary that carries only the best score and its piece count.

An Aho-Corasick automaton lists every vocabulary piece that ends at each character of a word; for each end the best
path is the piece with the highest sum, and of equal sums the one with the longest piece, as the tokenizers library's
unigram model has it: it tries starts from the left and replaces a path for a strictly better one only. A character
that is no piece of its own may stand as unknown at 10 below the vocabulary's lowest score, and unknowns in a row are
one token. Words begin at each space, which becomes `▁`; a word's count is remembered.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenfare.llm.common import forget, prepare

REMEMBERED = 1 << 19
_MARK = "▁"
_SPLIT = re.compile("▁[^▁]*|^[^▁]+")


def sentencepiece_vocabulary(path: str) -> list[tuple[str, float]]:
    """Normal pieces of a sentencepiece model file, with their scores; control and byte pieces are left out."""
    import sentencepiece

    s = sentencepiece.SentencePieceProcessor(model_file=path)
    return [(s.id_to_piece(i), s.get_score(i)) for i in range(s.get_piece_size()) if not (s.is_control(i) or s.is_unknown(i) or s.is_byte(i) or s.is_unused(i))]


class Counter(dict):
    """word -> number of tokens, for words as the split makes them."""

    def __init__(self, vocabulary: list[tuple[str, float]]):
        import ahocorasick

        self.automaton = ahocorasick.Automaton()
        for piece, score in vocabulary:
            self.automaton.add_word(piece, (len(piece), float(score)))
        self.automaton.make_automaton()
        self.unknown = min((s for _, s in vocabulary), default=0.0) - 10.0

    def __missing__(self, word: str) -> int:
        ends: list[list[tuple[int, float]]] = [[] for _ in word]
        for end, piece in self.automaton.iter(word):
            ends[end].append(piece)
        paths: list[tuple[float, int, bool]] = [(0.0, 0, False)]  # score, pieces, whether the last is unknown
        for end, pieces in enumerate(ends):
            best = None
            pieces.sort(reverse=True)
            for length, score in pieces:
                before = paths[end + 1 - length]
                if best is None or before[0] + score > best[0]:
                    best = (before[0] + score, before[1] + 1, False)
            if not pieces or pieces[-1][0] > 1:
                before = paths[end]
                if best is None or before[0] + self.unknown > best[0]:
                    best = (before[0] + self.unknown, before[1] + (not before[2]), True)
            paths.append(best)
        self[word] = n = paths[-1][1]
        return n

    def count(self, text: str) -> int:
        if not text:
            return 0
        text = text.replace(" ", _MARK)
        n = sum(map(self.__getitem__, _SPLIT.findall(text if text[0] == _MARK else _MARK + text)))
        if len(self) > REMEMBERED:
            self.clear()
        return n


def count_tokens(documents: DataFrame, vocabulary: list[tuple[str, float]]) -> DataFrame:
    """(doc_id, n_tokens) for every row of documents; a null or empty text has none. The vocabulary, which does not grow
    with the data, is broadcast. Repeated rows are counted each; only doc_id and text are read."""
    prepare(documents.sparkSession)
    shared = documents.sparkSession.sparkContext.broadcast(vocabulary)

    def emit(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        forget()
        counter = Counter(shared.value)
        for pdf in frames:
            yield pd.DataFrame({"doc_id": pdf.doc_id.astype("Int64"), "n_tokens": [counter.count(t or "") for t in pdf.text.tolist()]})

    texts = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return texts.mapInPandas(emit, "doc_id long, n_tokens long")
