"""Token counts by count-only Viterbi over a unigram vocabulary."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame

from .common import map_texts

PIECES = "piece_bpe_32k.model"
SPACE = "▁"
#: Fixed value: an unknown character scores this much less than the worst piece.
UNKNOWN_PENALTY = 10.0
CACHE = 1_000_000
#: Chunks of more characters are counted each time they come.
LONGEST = 64


def vocabulary_path(name: str = PIECES) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def unigram_vocabulary(path: str) -> list[tuple[str, float]]:
    """(piece, log weight) of the file's ordinary pieces: a piece of rank r weighs -log(1 + r)."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    ids = range(model.get_piece_size())
    return [(model.id_to_piece(i), -math.log1p(-model.get_score(i))) for i in ids if not (model.is_control(i) or model.is_byte(i) or model.is_unknown(i))]


class Counter:
    """Piece counts of texts, equal to those of a unigram tokenizer with byte fallback.

    Spaces become SPACE, one is put in front, and each SPACE begins a chunk. In a chunk the path of the highest
    score wins; on equal scores the one whose last piece starts first, as the tokenizer visits starts in order and
    replaces only on a strictly higher score. A character that no piece of its own covers is unknown and counts as
    its UTF-8 bytes.
    """

    def __init__(self, vocabulary: list[tuple[str, float]], cache: int = CACHE):
        import ahocorasick

        self.automaton = ahocorasick.Automaton()
        for piece, score in vocabulary:
            self.automaton.add_word(piece, (len(piece), score))
        self.automaton.make_automaton()
        self.unknown = min(score for _, score in vocabulary) - UNKNOWN_PENALTY
        self.cache: dict[str, int] = {}
        self.limit = cache

    def chunk(self, text: str) -> int:
        n = len(text)
        ends: list[list[tuple[int, float]]] = [[] for _ in range(n)]
        for end, match in self.automaton.iter(text):
            ends[end].append(match)
        best, count = [0.0] * (n + 1), [0] * (n + 1)
        for end, matches in enumerate(ends):
            top, pieces, alone = None, 0, False
            for length, score in sorted(matches, reverse=True):
                alone |= length == 1
                at = end + 1 - length
                if top is None or best[at] + score > top:
                    top, pieces = best[at] + score, count[at] + 1
            if not alone:
                score = best[end] + self.unknown
                if top is None or score > top:
                    top, pieces = score, count[end] + len(text[end].encode())
            best[end + 1], count[end + 1] = top, pieces
        return count[n]

    def count(self, texts: list[str | None]) -> list[int]:
        split = []
        for text in texts:
            text = (text or "").replace(" ", SPACE)
            parts = text.split(SPACE) if text else []
            split.append(parts if parts and not parts[0] else ["", *parts])
        if len(self.cache) > self.limit:
            self.cache.clear()
        cache = self.cache
        new = {p for parts in split for p in parts[1:]} - cache.keys()
        for part in new:
            cache[part] = self.chunk(SPACE + part)
        get = cache.__getitem__
        out = [sum(map(get, parts[1:])) for parts in split]
        for part in new:
            if len(part) > LONGEST:
                del cache[part]
        return out


def count_tokens(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id and n_tokens of every whole text. A null or empty text has no tokens; rows may repeat; an empty table gives
    no rows; columns other than doc_id and text aren't read. Very long texts are counted whole, chunk by chunk; of paths
    with equal scores the tokenizer's counts."""
    path = path or vocabulary_path()

    def make():
        counter = Counter(unigram_vocabulary(path))
        return lambda rows: {"doc_id": rows["doc_id"], "n_tokens": counter.count(rows["text"])}

    return map_texts(docs, make, "doc_id long, n_tokens long")


