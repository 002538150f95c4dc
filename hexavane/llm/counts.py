"""Token counts under a unigram vocabulary, by dynamic programming shared over a trie of distinct pre-tokens.

The best segmentation of a prefix hangs on that prefix alone. Distinct pre-tokens of a batch are visited in sorted order,
which is the depth-first order of their trie: the path from the root to the last pre-token is kept as a stack of forward
scores, the next one keeps the part it shares and computes only its own nodes. Each terminal stores its token count.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..shipping import ship
from .words import slices

#: Stands for the white space before a word in the vocabulary.
MARK = "▁"
PIECE = 4 << 20


def vocabulary(path: str | None = None) -> dict[str, float]:
    """Pieces of a sentencepiece model with log probabilities from their rank: piece r has probability in proportion to
    1 / (r + 2). Control and byte pieces are left out; what no piece covers falls back to bytes."""
    from sentencepiece import SentencePieceProcessor

    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("piece_bpe_32k.model")
    sp = SentencePieceProcessor(model_file=path)
    names = [sp.id_to_piece(i) for i in range(sp.get_piece_size()) if not (sp.is_control(i) or sp.is_byte(i) or sp.is_unknown(i))]
    total = math.log(sum(1 / (r + 2) for r in range(len(names))))
    return {n: -math.log(r + 2) - total for r, n in enumerate(names)}


class Trie:
    """Forward scores along the path to the last pre-token, and the counts at terminals."""

    def __init__(self, pieces: dict[str, float]):
        self.pieces = pieces
        self.longest = max(map(len, pieces), default=1)
        self.fallback = min(pieces.values(), default=0.0) - 10.0
        self.nodes = 0

    def count(self, distinct: list[str]) -> dict[str, int]:
        """Tokens of the best segmentation of each pre-token; of equally good ones the fewest tokens."""
        out: dict[str, int] = {}
        score, tokens, last = [0.0], [0], ""
        get, longest, fallback = self.pieces.get, self.longest, self.fallback
        for word in sorted(distinct):
            shared = 0
            for a, b in zip(word, last, strict=False):
                if a != b:
                    break
                shared += 1
            del score[shared + 1 :], tokens[shared + 1 :]
            for end in range(shared + 1, len(word) + 1):
                size = len(word[end - 1].encode("utf-8", "surrogatepass"))
                best, fewest = score[end - 1] + size * fallback, tokens[end - 1] + size
                for start in range(max(0, end - longest), end):
                    value = get(word[start:end])
                    if value is not None:
                        value += score[start]
                        if value > best or value == best and tokens[start] + 1 < fewest:
                            best, fewest = value, tokens[start] + 1
                score.append(best)
                tokens.append(fewest)
            self.nodes += len(word) - shared
            out[word] = tokens[len(word)]
            last = word
        return out


def token_counts(docs: DataFrame, pieces: dict[str, float], *, remember: int = 400_000, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_words, n_tokens: one row for each row of ``docs``; null and blank texts have none.

    Pre-tokens are the runs between ASCII white space, each with the mark before it. ``pieces`` is the vocabulary, of fixed
    size. Counts of up to ``remember`` pre-tokens are kept between batches. Repeated rows stay; other columns are ignored.
    """
    ship(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(pieces)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = Trie(sent.value)
        known: dict[str, int] = {"": 0}
        for piece in slices(batches, "text", PIECE):
            lists = pc.ascii_split_whitespace(pc.fill_null(piece.column(1), ""))
            flat = lists.flatten().dictionary_encode()
            distinct = flat.dictionary.to_pylist()
            if len(known) > remember:
                known = {"": 0}
            marked = trie.count([MARK + w for w in distinct if w not in known])
            known.update((w[1:], n) for w, n in marked.items())
            size = np.fromiter((known[w] for w in distinct), np.int64, len(distinct))
            some = np.fromiter((w != "" for w in distinct), np.int64, len(distinct))
            code = flat.indices.to_numpy(zero_copy_only=False)
            at = lists.offsets.to_numpy() - lists.offsets[0].as_py()
            sums = [np.diff(np.concatenate([[0], np.cumsum(x[code])])[at]) for x in (some, size)]
            yield pa.record_batch([piece.column(0), *[pa.array(x, pa.int64()) for x in sums]], ["doc_id", "n_words", "n_tokens"])

    return docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, "doc_id bigint, n_words bigint, n_tokens bigint")
