"""Token counts of a unigram tokenizer by dynamic programming on a trie of pre-tokens.

Pre-tokens are ``[^\\x20\\x09-\\x0D]+`` with the word sign before them. The pieces of a public
vocabulary are weighted by rank: the k-th has the log-probability of Zipf's law. The best
path to a place depends on what is before it only, so pre-tokens with a common beginning
share it: the different new pre-tokens of a slice of documents are walked as a trie, in
order, and a node's forward score and token count are computed once; at the end of a
pre-token its count is kept. Characters without a piece cost their UTF-8 bytes in tokens.

The vocabulary (a few ten thousand pieces) is read on the driver from ``path`` and
broadcast. Documents are counted in one scan without a shuffle; counts of pre-tokens are
kept per task, at most ``KEPT`` of them.

Defined cases: null and empty texts have no tokens; rows are counted one by one, so repeats
and null ids are kept; other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from evalspark.llm.words import bounded_batches, in_slices, split_words, texts_of

PATH = "/opt/tokenizers/piece_bpe_32k.model"
KEPT = 400_000
SLICE = 256
# The sign before a word, and how far an unknown character is under the worst piece.
WORD_SIGN = "▁"
UNKNOWN_PENALTY = 10.0


def zipf_pieces(path: str = PATH) -> dict[str, float]:
    """Normal pieces of a sentencepiece vocabulary with a log-probability by rank."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    normal = [
        model.id_to_piece(i) for i in range(model.get_piece_size())
        if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i))
    ]
    total = math.log(sum(1 / k for k in range(1, len(normal) + 1)))
    return {piece: -math.log(k) - total for k, piece in enumerate(normal, 1)}


class Forward:
    """Best scores and their token counts at each place of the trie path walked last."""

    def __init__(self, pieces: dict[str, float]):
        # Pieces from their last character backwards: next characters, and the score at None.
        self.root: dict = {}
        for piece, score in pieces.items():
            node = self.root
            for c in reversed(piece):
                node = node.setdefault(c, {})
            node[None] = score
        self.unknown = min(pieces.values(), default=0.0) - UNKNOWN_PENALTY

    def counts(self, words: set[bytes]) -> Iterator[tuple[bytes, int]]:
        """``(word, tokens)`` for each word, in the order of the trie."""
        path, score, count = WORD_SIGN, [0.0], [0]
        self._extend(path, score, count, 0)
        for word, text in sorted(((w, WORD_SIGN + w.decode("utf-8", "replace")) for w in words), key=lambda x: x[1]):
            shared, least = 0, min(len(path), len(text))
            while shared < least and path[shared] == text[shared]:
                shared += 1
            del score[shared + 1 :], count[shared + 1 :]
            path = text
            self._extend(path, score, count, shared)
            yield word, count[-1]

    def _extend(self, text: str, score: list[float], count: list[int], start: int) -> None:
        for end in range(start + 1, len(text) + 1):
            at = end - 1
            node = self.root.get(text[at])
            if node is None or None not in node:
                best, tokens = score[at] + self.unknown, count[at] + len(text[at].encode("utf-8", "replace"))
            else:
                best, tokens = score[at] + node[None], count[at] + 1
            # Longer pieces; of equal scores the one that begins first.
            while node is not None and at > 0:
                at -= 1
                node = node.get(text[at])
                if node is not None and None in node and score[at] + node[None] >= best:
                    best, tokens = score[at] + node[None], count[at] + 1
            score.append(best)
            count.append(tokens)


def token_counts(docs: DataFrame, path: str = PATH) -> DataFrame:
    """``doc_id, n_words, n_tokens`` of each row of ``docs``."""
    bounded_batches(docs.sparkSession)
    vocabulary = docs.sparkSession.sparkContext.broadcast(zipf_pieces(path))
    schema = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_tokens", pa.int64())])

    def rows(batches):
        forward = Forward(vocabulary.value)
        known: dict[bytes, int] = {}
        for whole in batches:
            for at in range(0, whole.num_rows, SLICE):
                batch = whole.slice(at, SLICE)
                split = [split_words(data) for data in texts_of(batch, "text")]
                if len(known) > KEPT:
                    known.clear()
                new = {w for words in split for w in words if w not in known}
                known.update(forward.counts(new))
                for doc, words in zip(batch.column("doc_id").to_pylist(), split):
                    yield doc, len(words), sum(map(known.__getitem__, words))

    return docs.select("doc_id", "text").mapInArrow(lambda b: in_slices(rows(b), schema), "doc_id bigint, n_words bigint, n_tokens bigint")
