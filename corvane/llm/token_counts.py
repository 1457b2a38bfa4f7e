"""Token counts by a unigram model, with dynamic programming shared over a trie of pre-tokens.

Each distinct pre-token is put into a worker's trie, which stays from batch to batch.  A node's forward
score, the best log probability of any segmentation of the path to it, depends on the path alone, so it is computed
when the node is made, once for all pre-tokens that share it; a node where pre-tokens end stores their count of tokens.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from .words import slices

#: The mark of a pre-token's start, as in sentencepiece's vocabularies.
MARK = "▁"
#: How much less likely than the least likely piece a byte of an unknown character is.
UNKNOWN = 10.0
#: Nodes of a worker's trie; it grows a new one when that is full, so memory is bounded.
NODES = 1_500_000
#: Nodes are named by their parent and a character.
_SHIFT = 21


def zipf_scores(pieces: list[str]) -> dict[str, float]:
    """Log probabilities by Zipf's law from pieces in order of frequency, for vocabularies that hold ranks only."""
    total = sum(1 / (k + 1) for k in range(len(pieces)))
    out: dict[str, float] = {}
    for k, piece in enumerate(pieces):
        out.setdefault(piece, -math.log((k + 1) * total))
    return out


def piece_model_scores(path: str) -> dict[str, float]:
    """Scores of a sentencepiece model file's ordinary pieces, in order of id."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    plain = [i for i in range(model.vocab_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))]
    return zipf_scores([model.id_to_piece(i) for i in plain])


class UnigramTrie:
    """Counts the tokens of pre-tokens.

    The count is that of the segmentation with the best sum of scores, and of those that tie the
    one with the fewest tokens.  A character that no piece is made of counts as its UTF-8 bytes, each
    less likely by UNKNOWN than the least likely piece.
    """

    def __init__(self, scores: dict[str, float], mark: str = MARK, most: int = NODES):
        self.scores, self.mark, self.most = scores, mark, most
        self.least = min(scores.values(), default=0.0) - UNKNOWN
        # pieces from their last character to their first; "" holds a piece's score
        self.back: dict = {}
        for piece, score in scores.items():
            at = self.back
            for c in reversed(piece):
                at = at.setdefault(c, {})
            at[""] = score
        self._plant()

    def _plant(self) -> None:
        """An empty trie: node 0 is the root, then the mark's nodes."""
        self.child: dict[int, int] = {}
        self.parent, self.letter = [0], [""]
        self.score, self.used = [0.0], [0]
        #: Pre-tokens that ended in the trie, with the counts at their last nodes.
        self.known: dict[str, int] = {}
        self.start = 0
        for c in self.mark:
            self.start = self._grow(self.start, c)

    def _grow(self, node: int, c: str) -> int:
        """The child of a node, scored from its ancestors when it is new."""
        name = node << _SHIFT | ord(c)
        found = self.child.get(name)
        if found is not None:
            return found
        best, fewest, at = -math.inf, 0, node
        score, used, parent, letter = self.score, self.used, self.parent, self.letter
        pieces = self.back.get(c)
        while pieces is not None:
            s = pieces.get("")
            if s is not None:
                s += score[at]
                if s > best or (s == best and used[at] + 1 < fewest):
                    best, fewest = s, used[at] + 1
            if not at:
                break
            pieces, at = pieces.get(letter[at]), parent[at]
        if c not in self.scores:
            size = len(c.encode("utf-8", "surrogatepass"))
            s = score[node] + size * self.least
            if s > best or (s == best and used[node] + size < fewest):
                best, fewest = s, used[node] + size
        self.child[name] = new = len(score)
        parent.append(node)
        letter.append(c)
        score.append(best)
        used.append(fewest)
        return new

    def counts(self, tokens: list[str]) -> list[int]:
        """The count of each pre-token, led by the mark: what its last node stores."""
        known, child, out = self.known, self.child, []
        for token in tokens:
            n = known.get(token)
            if n is None:
                if len(self.score) + len(token) > self.most:
                    self._plant()
                    known, child = self.known, self.child
                node = self.start
                for i, c in enumerate(token):
                    below = child.get(node << _SHIFT | ord(c))
                    if below is None:
                        for c in token[i:]:
                            node = self._grow(node, c)
                        break
                    node = below
                n = known[token] = self.used[node]
            out.append(n)
        return out


@lru_cache(maxsize=2)
def _trie(path: str) -> UnigramTrie:
    """A worker's trie, for as long as the worker lives."""
    return UnigramTrie(piece_model_scores(path))


def count_tokens(docs: DataFrame, model: str, text_col: str = "text", out: str = "n_tokens") -> DataFrame:
    """docs with a last column of token counts: each text is cut at white space, each pre-token begins with MARK.

    Null and empty texts and texts of white space count 0; all rows stay, repeated ones as well; a column of that name is
    replaced.  A slice's distinct pre-tokens go to the worker's trie, of at most NODES nodes but for a pre-token that is
    longer; its path is made and given up.  No shuffle: workers share no trie.
    """
    kept = [c for c in docs.columns if c != out]
    at = kept.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = _trie(model)
        for batch in batches:
            for a, n in slices(batch.column(at)):
                part = batch.slice(a, n)
                texts = pc.fill_null(part.column(at).cast(pa.large_string()), pa.scalar("", pa.large_string()))
                lists = pc.utf8_split_whitespace(texts)
                flat = lists.flatten()
                full = pc.not_equal(flat, pa.scalar("", pa.large_string()))
                owner = lists.value_parent_indices().to_numpy()[full.to_numpy(zero_copy_only=False)]
                coded = flat.filter(full).dictionary_encode()
                each = np.array(trie.counts(coded.dictionary.to_pylist()), np.int64)
                totals = np.bincount(owner, each[coded.indices.to_numpy()] if len(each) else None, minlength=n).astype(np.int64)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(totals)], names=[*kept, out])

    rows = docs.select(*kept)
    return rows.mapInArrow(run, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema) + f", `{out}` long")
