"""Token counts by a longest-match automaton (operator 10).

A vocabulary trie whose nodes carry a failure link and the number of tokens that
following the link pops.  One pass over a word then gives the length of its greedy
longest-match segmentation without building pieces: a failed step adds the popped
count and goes on at the link, so every character is read once.
"""

from __future__ import annotations

import json
from collections.abc import Iterable

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from gristmill.llm.common import add_columns, raw_bytes

WORD_END = "</w>"
CACHED_WORDS = 400_000


def read_vocabulary(path: str, word_end: str = WORD_END) -> tuple[list[bytes], list[bytes]]:
    """Pieces inside a word and pieces that end a word, as UTF-8, of a tokenizers file.

    Byte-level files spell each byte as one character; pieces are spelled back.
    """
    with open(path, encoding="utf-8") as file:
        vocab = json.load(file)["model"]["vocab"]
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    spelled = {chr(b): b for b in shown}
    spelled.update({chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in set(shown))})
    inside, final = [], []
    for piece in vocab:
        ends = piece.endswith(word_end)
        body = piece[: -len(word_end)] if ends else piece
        if body and all(c in spelled for c in body):
            (final if ends else inside).append(bytes(spelled[c] for c in body))
    return inside, final


class Automaton:
    """Greedy longest-match lengths of words.

    A word is segmented from the left; each piece is the longest of ``inside`` that
    starts there, or one of ``final`` if that reaches the end of the word and is
    longer.  This is longest match over the word with an end mark: final pieces are
    stored with the mark, so a lone mark is the empty final piece and costs nothing.
    A word that some position cannot continue has no segmentation and is one
    unknown token.
    """

    END = 256

    def __init__(self, inside: Iterable[bytes], final: Iterable[bytes]) -> None:
        self.go: list[dict[int, int]] = [{}]
        piece = [False]

        def add(symbols: Iterable[int]) -> None:
            node = 0
            for s in symbols:
                to = self.go[node].get(s)
                if to is None:
                    to = self.go[node][s] = len(self.go)
                    self.go.append({})
                    piece.append(False)
                node = to
            if node:
                piece[node] = True

        for p in inside:
            add(p)
        for p in final:
            add([*p, self.END])
        self.fail = [-1] * len(self.go)
        self.popped = [0] * len(self.go)
        level = [0]
        while level:
            below = []
            for parent in level:
                for s, node in self.go[parent].items():
                    below.append(node)
                    if piece[node]:  # the whole node is one token; start again behind it
                        self.fail[node], self.popped[node] = 0, 1
                        continue
                    at, count = self.fail[parent], self.popped[parent]
                    while at >= 0 and s not in self.go[at]:
                        count += self.popped[at]
                        at = self.fail[at]
                    if at >= 0:
                        self.fail[node], self.popped[node] = self.go[at][s], count
            level = below

    def length(self, word: bytes) -> int:
        """Tokens of the word; the empty word has none."""
        go, fail, popped, node, count = self.go, self.fail, self.popped, 0, 0
        for s in word:
            while s not in go[node]:
                if fail[node] < 0:
                    return 1
                count += popped[node]
                node = fail[node]
            node = go[node][s]
        # The end mark: a step to it, or the pops until nothing is left over.
        while node:
            if self.END in go[node]:
                return count + 1
            if fail[node] < 0:
                return 1
            count += popped[node]
            node = fail[node]
        return count


def token_counts(
    docs: DataFrame, vocabulary: str, text: str = "text", word_end: str = WORD_END
) -> DataFrame:
    """Add ``n_words`` and ``n_tokens`` (long) to every row.

    Words are runs of anything but ASCII white space, A-Z lower-cased.  Null and
    empty texts have none.  Repeated rows and ids each get their own counts; input
    columns of these two names are replaced.  ``vocabulary`` is a tokenizers file,
    read on the driver; the two piece lists travel to the tasks, a few bytes per
    vocabulary entry.  A task keeps the counts of words met before, at most
    CACHED_WORDS of them.
    """
    inside, final = read_vocabulary(vocabulary, word_end)

    def start():
        length = Automaton(inside, final).length
        known: dict[bytes, int] = {}

        def work(part: pa.RecordBatch) -> list[pa.Array]:
            words, tokens = [], []
            for body in raw_bytes(part.column(text)):
                own = body.lower().split()
                for w in set(own).difference(known):
                    known[w] = length(w)
                words.append(len(own))
                tokens.append(sum(map(known.__getitem__, own)))
                if len(known) > CACHED_WORDS:
                    known.clear()
            return [pa.array(words, pa.int64()), pa.array(tokens, pa.int64())]

        return work

    return add_columns(docs, text, [("n_words", T.LongType()), ("n_tokens", T.LongType())], start)
