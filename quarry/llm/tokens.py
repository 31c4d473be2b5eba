"""Token counts of a unigram tokenizer, by Viterbi search that carries only score and piece count."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm.common import table

VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"
SPACE = "▁"
UNKNOWN_PENALTY = 10.0
#: Words whose counts are remembered by a task; the memo is emptied when full.
MEMO = 400_000


def read_vocabulary(path: str = VOCABULARY) -> list[tuple[str, float]]:
    """(piece, score) of each piece of a SentencePiece file that text can match, in order of id; read on the driver.

    The unknown, control, unused and byte pieces never match text (``<s>`` in a text is three characters) and are left out.
    """
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    special = lambda i: model.is_unknown(i) or model.is_control(i) or model.is_unused(i) or model.is_byte(i)
    return [(model.id_to_piece(i), model.get_score(i)) for i in range(model.get_piece_size()) if not special(i)]


class Counter:
    """Counts the pieces of the best segmentation of a word.

    The automaton yields every vocabulary match by its end. Best means the highest sum of scores; of equal sums at one
    end the match that starts first (the longest) stays, as in the lattice search that fills ends from left to right and
    replaces only by a higher score. A character that is no piece by itself may also stand as unknown, at the lowest
    score less 10; it counts one per UTF-8 byte (byte fallback), or with ``byte_fallback`` off one per run of unknowns.
    """

    def __init__(self, vocabulary: list[tuple[str, float]], byte_fallback: bool = True):
        import ahocorasick

        self.matches = ahocorasick.Automaton()
        for piece, score in dict(vocabulary).items():
            if piece:
                self.matches.add_word(piece, (len(piece), score))
        self.matches.make_automaton()
        self.unknown = min(s for _, s in vocabulary) - UNKNOWN_PENALTY
        self.bytes = byte_fallback
        self.memo: dict[str, int] = {}

    def word(self, word: str) -> int:
        n = len(word)
        score: list[float | None] = [0.0] + [None] * n
        count, open_ = [0] * (n + 1), [False] * (n + 1)  # open_: the best path ends in an unknown
        found: list[list[tuple[int, float]]] = [[] for _ in range(n)]
        for end, match in self.matches.iter(word):
            found[end].append(match)
        for end in range(n):
            best, start, single = None, end, False
            for size, value in found[end]:  # longest first, so the earliest start keeps ties
                single |= size == 1
                if (before := score[end + 1 - size]) is not None and (best is None or before + value > best):
                    best, start = before + value, end + 1 - size
            unknown = False
            if not single and (before := score[end]) is not None and (best is None or before + self.unknown > best):
                best, start, unknown = before + self.unknown, end, True
            score[end + 1], open_[end + 1] = best, unknown
            if unknown:
                count[end + 1] = count[end] + (len(word[end].encode()) if self.bytes else not open_[end])
            else:
                count[end + 1] = count[start] + 1
        return count[n]

    def text(self, text: str | None) -> int:
        """Pieces of a whole text: spaces become the space mark, one is put in front, and each mark begins a word."""
        if not text:
            return 0
        s = text.replace(" ", SPACE)
        total, memo = 0, self.memo
        for w in s[s[0] == SPACE :].split(SPACE):
            n = memo.get(w)
            if n is None:
                if len(memo) >= MEMO:
                    memo.clear()
                n = memo[w] = self.word(SPACE + w)
            total += n
        return total


def token_counts(documents: DataFrame, vocabulary: list[tuple[str, float]], text: str = "text", output: str = "n_tokens", byte_fallback: bool = True) -> DataFrame:
    """``documents`` with the number of tokens of each whole text. One row out for each row in.

    Null and empty texts count 0; repeated rows count alike; texts of any length are read whole; other columns are kept
    and one called ``output`` is replaced. The vocabulary is a model's, of fixed size, and is sent to the tasks once.
    """
    sent = documents.sparkSession.sparkContext.broadcast(vocabulary)

    @F.pandas_udf("long")
    def count(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        counter = Counter(sent.value, byte_fallback)
        for t in batches:
            yield pd.Series([counter.text(x) for x in t], dtype="int64")

    return documents.withColumn(output, count(F.col(text).cast("string")))


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents").select("doc_id", "text"), read_vocabulary()).select("doc_id", "n_tokens")


QUERIES = {"op7_token_counts": op7_token_counts}
