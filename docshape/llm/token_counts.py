"""Token counts of a unigram vocabulary by count-only Viterbi (operator 2).

An Aho-Corasick automaton names all vocabulary pieces that end at each
character; dynamic programming keeps, per end, only the best score and the
number of pieces on its path.  Ties go to the piece that starts earliest, as
in the public unigram tokenizers; neighbouring unknown characters are one piece.
Words are counted apart (pieces never cross white space), so each distinct
word is solved once per worker.
"""

from __future__ import annotations

import math

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import worker_state

#: Stands for the white space before a word.
SPACE = "▁"
#: An unknown character scores so much below the least piece.
UNKNOWN = 10.0
KEPT_WORDS = 500_000


def vocabulary(path: str) -> list[tuple[str, float]]:
    """The pieces of a SentencePiece file with scores that fall with the logarithm of their rank."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    plain = [i for i in range(sp.get_piece_size()) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))]
    return [(sp.id_to_piece(i), -math.log(2.0 + rank)) for rank, i in enumerate(plain)]


class WordCounts(dict):
    """word: score + 1j * pieces; fills itself."""

    def __init__(self, pieces: list[tuple[str, float]]):
        import ahocorasick

        self._auto = ahocorasick.Automaton()
        for piece, score in pieces:
            self._auto.add_word(piece, (len(piece), score))
        self._auto.make_automaton()
        self._unknown = min((s for _, s in pieces), default=0.0) - UNKNOWN

    def solve(self, word: str) -> complex:
        n = len(word)
        best, count, unknown = [0.0] + [-math.inf] * n, [0] * (n + 1), [False] * (n + 1)
        found = self._auto.iter(word) if len(self._auto) else iter(())
        ahead = next(found, None)
        for end in range(1, n + 1):
            top, pieces, from_unknown, single = -math.inf, 0, False, False
            while ahead is not None and ahead[0] == end - 1:  # longest first
                length, score = ahead[1]
                start = end - length
                single |= length == 1
                if best[start] + score > top:
                    top, pieces = best[start] + score, count[start] + 1
                ahead = next(found, None)
            if not single and best[end - 1] + self._unknown > top:
                top, pieces, from_unknown = best[end - 1] + self._unknown, count[end - 1] + (not unknown[end - 1]), True
            best[end], count[end], unknown[end] = top, pieces, from_unknown
        return complex(best[n], count[n])

    def __missing__(self, word: str) -> complex:
        if len(self) >= KEPT_WORDS:
            self.clear()
        self[word] = out = self.solve(SPACE + word)
        return out


def _counter(path: str):
    def run(batches):
        known = worker_state().__dict__.setdefault("unigrams", {})
        if path not in known:
            known[path] = WordCounts(vocabulary(path))
        of = known[path].__getitem__
        for batch in batches:
            sums = [sum(map(of, text.split()), 0j) for text in batch.column("_text").to_pylist()]
            rest = batch.drop_columns(["_text"])
            yield pa.RecordBatch.from_arrays(
                [*rest.columns, pa.array([int(x.imag) for x in sums], pa.int64()), pa.array([x.real for x in sums], pa.float64())], names=[*rest.schema.names, "n_tokens", "best_score"]
            )

    return run


def token_counts(docs: DataFrame, path: str, keep: list[str] | None = None, text: str = "text") -> DataFrame:
    """Per row of ``docs``: the columns ``keep`` (doc_id by default), n_tokens (long) and best_score (double) of its whole text.

    Null and empty texts have no tokens and score 0.  Repeated rows and null ids each get a row; other columns are
    not read.  One pass, no shuffle; a worker keeps a bounded number of solved words."""
    keep = keep or ["doc_id"]
    src = docs.select(*[F.col(f"`{c}`") for c in keep], F.coalesce(F.col(text), F.lit("")).alias("_text"))
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in src.schema.fields if f.name != "_text")
    return src.mapInArrow(_counter(path), f"{kinds}, n_tokens bigint, best_score double")
