"""Token counts by a linear longest-match automaton.

The vocabulary is a trie with two roots: pieces that begin a word, and pieces that go on in it. A
node's failure link leads to where matching resumes after the longest pieces before it have been
popped, and carries how many they are; so a word's greedy piece count takes one pass over its
characters and no piece is ever built. A word without a segmentation is one unknown token, unless
words are spelled: then the bare word boundary is a piece where no beginning matches, and a character
that no piece covers counts as its UTF-8 byte pieces, so that no word loses its length.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .base import Memo, held, map_texts, texts

WORD = re.compile(r"\w+|[^\w\s]")
BEGIN = "▁"
SCHEMA = "doc_id long, n_words long, n_tokens long, n_unknown long, longest_word_tokens long"


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def vocabulary(path: str) -> tuple[list[str], list[str]]:
    """(beginnings, continuations) of a piece model; byte, control and unknown pieces are left out."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    plain = [model.id_to_piece(i) for i in range(model.get_piece_size()) if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i))]
    first = [p[1:] for p in plain if p.startswith(BEGIN) and len(p) > 1 and BEGIN not in p[1:]]
    return first, [p for p in plain if BEGIN not in p]


def spells(path: str) -> bool:
    """Whether the piece model has the bare boundary and all byte pieces."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    ids = range(model.get_piece_size())
    return any(model.id_to_piece(i) == BEGIN for i in ids) and sum(map(model.is_byte, ids)) == 256


def byte_pieces(c: str) -> int:
    return len(c.encode("utf-8", "surrogatepass"))


class Automaton:
    """Nodes 0 and 1 are the roots of beginnings and of continuations; link -1 means no segmentation.

    With ``spell`` the root of beginnings pops the bare boundary and links to the other root, which
    counts uncovered characters by their bytes.
    """

    def __init__(self, first: list[str], rest: list[str], spell: bool = False):
        self.spell = spell
        self.next: list[dict[str, int]] = [{}, {}]
        self.link, self.popped = [1 if spell else -1, -1], [1 if spell else 0, 0]
        whole = [False, False]
        for root, pieces in ((0, first), (1, rest)):
            for piece in pieces:
                at = root
                for c in piece:
                    if c not in self.next[at]:
                        self.next[at][c] = len(self.next)
                        self.next.append({})
                        whole.append(False)
                    at = self.next[at][c]
                whole[at] = at > 1
        self.link += [-1] * (len(self.next) - 2)
        self.popped += [0] * (len(self.next) - 2)
        level = [0, 1]
        while level:
            below = []
            for u in level:
                for c, v in self.next[u].items():
                    below.append(v)
                    if whole[v]:
                        self.link[v], self.popped[v] = 1, 1
                        continue
                    z, n = self.link[u], self.popped[u]
                    while z >= 0 and c not in self.next[z]:
                        n += self.popped[z]
                        z = self.link[z]
                    if z >= 0:
                        self.link[v], self.popped[v] = self.next[z][c], n
                    elif spell:
                        self.link[v], self.popped[v] = 1, n + byte_pieces(c)
            level = below

    def count(self, word: str) -> int:
        """Greedy longest-match pieces of the word; -1 if there is no segmentation, 0 if it is empty."""
        step, link, popped = self.next, self.link, self.popped
        at = n = 0
        for c in word:
            while (v := step[at].get(c)) is None:
                n += popped[at]
                at = link[at]
                if at < 0:
                    break
            if at >= 0:
                at = v
            elif self.spell:
                n, at = n + byte_pieces(c), 1
            else:
                return -1
        while at > 1:
            n += popped[at]
            at = link[at]
        return n if at >= 0 else -1


def counter(path: str, spell: bool = False) -> Memo:
    """Word -> count, by one automaton for each worker process, file and way of counting."""
    return held(("counts", path, spell), lambda: Memo(Automaton(*vocabulary(path), spell and spells(path)).count))


def count_tokens(docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text", spell: bool = False) -> DataFrame:
    """``SCHEMA`` for each row: words are runs of word characters, or single other signs.

    Whole texts are counted, however long; repeated rows give repeated rows, an empty table none;
    other columns are not read.

    An unknown word counts as one token; with ``spell`` a model that has the boundary and the byte
    pieces leaves none. Null and empty texts have zeros.
    """
    path = path or default_path()

    def run(ids: pa.Array, values: list[str | None]) -> pa.RecordBatch:
        memo = counter(path, spell)
        rows = np.zeros((len(values), 4), np.int64)
        for i, v in enumerate(values):
            words = WORD.findall(v) if v else ()
            if words:
                n = np.fromiter(map(memo.__getitem__, words), np.int64, len(words))
                unknown = int((n < 0).sum())
                rows[i] = len(words), int(n.sum()) + 2 * unknown, unknown, int(np.abs(n).max())
        return pa.RecordBatch.from_arrays([ids, *(pa.array(c) for c in rows.T.copy())], ["doc_id", "n_words", "n_tokens", "n_unknown", "longest_word_tokens"])

    return map_texts(texts(docs, id_col, text_col), run, SCHEMA)
