"""Token counts under a unigram vocabulary, by dynamic programming over a trie of pre-tokens."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import small_batches

#: A trie of more nodes is dropped and begun anew, which bounds a task's memory.
MAX_NODES = 1_500_000
#: A longer pre-token makes no nodes: it shares its whole prefix with hardly any other.
LONG_WORD = 10_000


class Vocabulary:
    """Pieces of a public sentencepiece file with unigram log probabilities.

    The file ranks its pieces but holds no probabilities; a Zipf law over the
    ranks gives them: piece r has probability 1 / ((r + 1) H).  A character that
    no piece covers costs its UTF-8 bytes, each a byte piece.
    """

    def __init__(self, name: str = "piece_bpe_32k.model"):
        import public_tokenizers
        from sentencepiece import SentencePieceProcessor

        model = SentencePieceProcessor(model_file=public_tokenizers.path(name))
        ids = [i for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))]
        ids.sort(key=lambda i: (-model.get_score(i), i))
        norm = math.log(sum(1 / (r + 1) for r in range(len(ids))))
        self.score = {model.id_to_piece(i): -math.log(r + 1) - norm for r, i in enumerate(ids)}
        self.longest = max(map(len, self.score), default=1)
        self.byte = -math.log(len(ids) + 1) - norm

    def fallback(self, char: str) -> tuple[float, int]:
        n = len(char.encode("utf-8", "surrogatepass"))
        return n * self.byte, n


class PreTokenTrie:
    """Pre-tokens share the forward scores of their common prefixes.

    A node holds the best log probability of any segmentation of its prefix
    and the token count of that segmentation (of equal ones, the smallest
    count).  Both depend on the prefix alone, so they are found once, when the
    node is made; a pre-token's count is that of its last node.
    """

    def __init__(self, vocabulary: Vocabulary, max_nodes: int = MAX_NODES):
        self.vocabulary, self.max_nodes = vocabulary, max_nodes
        self._new()

    def _new(self) -> None:
        self.child: list[dict[str, int]] = [{}]
        self.best: list[float] = [0.0]
        self.tokens: list[int] = [0]
        self.terminal: dict[str, int] = {}

    def count(self, word: str) -> int:
        """Tokens of one pre-token."""
        found = self.terminal.get(word)
        if found is not None:
            return found
        if len(word) > LONG_WORD:
            return self.count_alone(word)
        if len(self.child) + len(self.terminal) > self.max_nodes:
            self._new()
        child, best, tokens = self.child, self.best, self.tokens
        score, longest = self.vocabulary.score, self.vocabulary.longest
        path, node = [0], 0
        for end, char in enumerate(word, 1):
            down = child[node].get(char)
            if down is None:
                cost, n = (score[char], 1) if char in score else self.vocabulary.fallback(char)
                top, count = best[node] + cost, tokens[node] + n
                for start in range(max(0, end - longest), end - 1):
                    own = score.get(word[start:end])
                    if own is not None:
                        own += best[path[start]]
                        if own > top or own == top and tokens[path[start]] + 1 < count:
                            top, count = own, tokens[path[start]] + 1
                down = len(child)
                child.append({})
                best.append(top)
                tokens.append(count)
                child[node][char] = down
            node = down
            path.append(node)
        self.terminal[word] = tokens[node]
        return tokens[node]

    def count_alone(self, word: str) -> int:
        """Tokens of a pre-token, by the same forward scores in a ring of the last cells only."""
        score, longest = self.vocabulary.score, self.vocabulary.longest
        ring = longest + 1
        best, tokens = [0.0] * ring, [0] * ring
        for end, char in enumerate(word, 1):
            cost, n = (score[char], 1) if char in score else self.vocabulary.fallback(char)
            before = (end - 1) % ring
            top, count = best[before] + cost, tokens[before] + n
            for start in range(max(0, end - longest), end - 1):
                own = score.get(word[start:end])
                if own is not None:
                    at = start % ring
                    own += best[at]
                    if own > top or own == top and tokens[at] + 1 < count:
                        top, count = own, tokens[at] + 1
            best[end % ring], tokens[end % ring] = top, count
        return tokens[len(word) % ring]


def pre_tokens(text: str) -> list[str]:
    """Words between white space, each with the mark of a word's start."""
    return ["▁" + w for w in text.split()]


def count_tokens(text: Column, vocabulary: str = "piece_bpe_32k.model", max_nodes: int = MAX_NODES) -> Column:
    """struct(n_pre_tokens, n_tokens) of a text column."""

    small_batches()

    @F.pandas_udf(T.StructType([T.StructField("n_pre_tokens", T.LongType()), T.StructField("n_tokens", T.LongType())]))
    def udf(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        trie = PreTokenTrie(Vocabulary(vocabulary), max_nodes)
        for texts in batches:
            rows = []
            for text in texts:
                found = Counter((text or "").split())
                rows.append((found.total(), sum(n * trie.count("▁" + w) for w, n in found.items())))
            yield pd.DataFrame(rows, columns=["n_pre_tokens", "n_tokens"])

    return udf(text)


def token_counts(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = "piece_bpe_32k.model", max_nodes: int = MAX_NODES) -> DataFrame:
    """Token counts of every whole text, one row per input row.

    Each task inserts the distinct pre-tokens of its rows into one trie; no row
    is shuffled.  A pre-token of more than LONG_WORD characters is scored by the
    same recurrence without nodes.  A null or empty text has no tokens; repeated rows and null
    ids stay; an empty table gives an empty table; other columns are ignored.
    """
    found = docs.select(F.col(id_col), count_tokens(F.col(text_col), vocabulary, max_nodes).alias("__n"))
    return found.select(id_col, "__n.*")
