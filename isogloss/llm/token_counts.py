"""Token counts (operator 5): unigram segmentation of distinct pre-tokens, shared along a trie.

A text's pre-tokens are an optional space with the characters up to the next white space, or one white space
character. Its tokens are the pieces of the best-scored segmentation of each pre-token. The best score of a prefix
depends on the prefix alone, so it is computed once, when its trie node is made, from the nodes above; a node where
a pre-token ends keeps the number of tokens there.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass

import public_tokenizers
import sentencepiece
from pyspark.sql import DataFrame

from .arrow_text import map_texts

PIECES = "piece_bpe_32k.model"
_PRE = re.compile(r" ?\S+|\s")
#: Trie nodes that a worker keeps before it starts anew, and the longest pre-token that goes into the trie.
NODES, LONGEST = 500_000, 64
#: What a character without a piece costs beyond the worst piece; it counts as its UTF-8 bytes.
UNKNOWN = 10.0


@dataclass(frozen=True)
class Vocabulary:
    """scores: log-probability of each piece, the space written U+2581; unknown: of a character without a piece."""

    scores: dict[str, float]
    unknown: float


def read_vocabulary(path: str | None = None) -> Vocabulary:
    """The pieces of a model file. The public file has merge ranks, not probabilities; the n-th piece has the
    probability that Zipf's law gives to rank n."""
    model = sentencepiece.SentencePieceProcessor(model_file=path or public_tokenizers.path(PIECES))
    size = model.get_piece_size()
    pieces = [model.id_to_piece(i) for i in range(size) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))]
    total = math.log(sum(1 / n for n in range(1, len(pieces) + 1)))
    scores = {p: -math.log(n) - total for n, p in enumerate(pieces, 1)}
    return Vocabulary(scores, min(scores.values()) - UNKNOWN)


def pre_tokens(text: str) -> list[str]:
    return _PRE.findall(text)


class Trie:
    """Nodes of inserted pre-tokens: best score and token count of each node's prefix."""

    def __init__(self, vocabulary: Vocabulary, nodes: int = NODES) -> None:
        self.unknown, self.most = vocabulary.unknown, nodes
        #: Pieces backwards, a dictionary for each character; under "" a piece's score.
        self.pieces: dict = {}
        for piece, score in vocabulary.scores.items():
            at = self.pieces
            for c in reversed(piece):
                at = at.setdefault(c, {})
            at[""] = score
        self.clear()

    def clear(self) -> None:
        self.children: list[dict[str, int]] = [{}]
        self.score, self.count = [0.0], [0]
        self.terminal: dict[str, int] = {}

    def forward(self, word: str, end: int, scores: list[float], counts: list[int]) -> tuple[float, int]:
        """Best score, then fewest tokens, of the prefix that ends at `end`, from those of shorter prefixes."""
        best, n = scores[end - 1] + self.unknown, counts[end - 1] + len(word[end - 1].encode())
        at = self.pieces
        for start in range(end - 1, -1, -1):
            at = at.get(word[start])
            if at is None:
                break
            s = at.get("")
            if s is not None:
                s += scores[start]
                if s > best or (s == best and counts[start] + 1 < n):
                    best, n = s, counts[start] + 1
        return best, n

    def tokens(self, pre_token: str) -> int:
        """Tokens of a pre-token."""
        n = self.terminal.get(pre_token)
        return self._insert(pre_token) if n is None else n

    def _insert(self, pre_token: str) -> int:
        word = pre_token.replace(" ", "▁")
        scores, counts = [0.0], [0]
        if len(word) > LONGEST:
            for end in range(1, len(word) + 1):
                s, n = self.forward(word, end, scores, counts)
                scores.append(s)
                counts.append(n)
            return counts[-1]
        if len(self.score) > self.most:
            self.clear()
        node = 0
        for end, c in enumerate(word, 1):
            child = self.children[node].get(c)
            if child is None:
                child = self.children[node][c] = len(self.score)
                s, n = self.forward(word, end, scores, counts)
                self.children.append({})
                self.score.append(s)
                self.count.append(n)
            node = child
            scores.append(self.score[node])
            counts.append(self.count[node])
        self.terminal[pre_token] = self.count[node]
        return self.count[node]


SCHEMA = "doc_id long, n_pretokens long, n_tokens long"


def count_tokens(docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_pretokens and n_tokens of the whole text.

    A null or empty text has none; repeated rows give repeated results, a null id stays null, an empty table gives
    an empty result; other columns are not read. The vocabulary (the file's pieces, about 1 MB) goes to the tasks; a
    worker's trie has a bounded number of nodes and starts anew beyond it, which changes no count.
    """
    vocabulary = docs.sparkSession.sparkContext.broadcast(read_vocabulary(path))
    holder: list[Trie] = []

    def batch(ids: list, texts: list) -> dict[str, list]:
        if not holder:
            holder.append(Trie(vocabulary.value))
        tokens, pre, out = holder[0].tokens, [], []
        for text in texts:
            words = pre_tokens((text or b"").decode())
            pre.append(len(words))
            out.append(sum(map(tokens, words)))
        return {"doc_id": ids, "n_pretokens": pre, "n_tokens": out}

    return map_texts(docs, batch, SCHEMA, id_col, text_col)
