"""Token ids of a lower-casing word BPE, from distinct words: equal to the tokenizer's own ids.

White space never joins two words of that tokenizer and is dropped by it, so a text's ids are its
words' ids in a row. A word that is letters and then marks is two pre-tokens, each merged by a
byte-pair encoder whose end-of-word symbols are a byte and a zero byte; all other words (digits,
apostrophes, rare scripts, special tokens) go through the tokenizer itself.
"""

from __future__ import annotations

import json

import numpy as np

from .base import ENTRY_BYTES, LONGEST, MEMO_BYTES, held

#: Marks that may follow a word's letters: neither letters, digits, apostrophes nor white space.
TAIL = ".,;:!?\"()[]{}<>*$%&#|-_~`+=/\\^@"
#: Characters of text that are split into words at a time.
STRETCH = 1 << 18


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def _byte_of() -> dict[str, int]:
    """The printable characters that byte-level vocabularies write bytes as."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


class Encoder(dict):
    """Word -> its ids as little-endian 32-bit bytes; ``encode`` gives a text's."""

    def __init__(self, path: str):
        super().__init__()
        self.held, self.long = 0, []
        import tiktoken
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        byte, suffix, vocab = _byte_of(), "</w>", spec["model"]["vocab"]
        special = {t["content"] for t in spec["added_tokens"]}
        ranks, self.last = {}, np.zeros(max(vocab.values()) + 1, bool)
        for token, i in vocab.items():
            if token in special:
                continue
            ends = token.endswith(suffix) and len(token) > len(suffix)
            raw = bytes(byte[c] for c in (token[: -len(suffix)] if ends else token))
            ranks[raw + b"\0" * ends] = i
            self.last[i] = ends
        # A vocabulary whose ids don't follow its merges, or which has a clash, is left to the tokenizer.
        merges = [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
        ids = [vocab.get(a + b) for a, b in merges]
        self.direct = len(ranks) == len(vocab) - len(special & vocab.keys()) and None not in ids and ids == sorted(ids) and (not ids or ids[0] >= 512)
        self.direct = self.direct and all(bytes([b]) in ranks for b in range(256))
        self.fast = tiktoken.Encoding("words", pat_str="[^ ]+", mergeable_ranks=ranks, special_tokens={}) if self.direct else None

    def keep(self, word: str, ids: bytes) -> None:
        self[word] = ids
        self.held += ENTRY_BYTES + 2 * len(word) + len(ids)
        if len(word) > LONGEST:
            self.long.append(word)

    def learn(self, words: set[str]) -> None:
        plain, spelled, parts, other = [], [], [], []
        for w in words:
            core = w.rstrip(TAIL)
            if self.direct and core.isalpha() and (core.isascii() or (max(core) < "ƀ" and "İ" not in core and "ŉ" not in core)):
                plain.append(w)
                tail = w[len(core) :]
                spelled.append(f"{core.lower()}\0 {tail}\0" if tail else f"{core.lower()}\0")
                parts.append(2 if tail else 1)
            else:
                other.append(w)
        for at in range(0, len(plain), 20_000):
            ids = np.asarray(self.fast.encode_ordinary(" ".join(spelled[at : at + 20_000])), dtype="<u4")
            ends = (np.flatnonzero(self.last[ids]) + 1)[np.cumsum(parts[at : at + 20_000]) - 1] * 4
            raw, start = ids.tobytes(), 0
            for w, end in zip(plain[at : at + 20_000], ends.tolist(), strict=True):
                self.keep(w, raw[start:end])
                start = end
        if other:
            for w, e in zip(other, self.whole.encode_batch_fast(other, add_special_tokens=False), strict=True):
                self.keep(w, np.array(e.ids, dtype="<u4").tobytes())

    def encode(self, values: list[str | None]) -> list[bytes]:
        """The ids of each whole text; null counts as empty. Words are worked on a stretch at a time."""
        out: list[list[bytes]] = [[] for _ in values]
        waiting: list[tuple[int, list[str]]] = []
        size = 0

        def flush() -> None:
            if self.held > MEMO_BYTES:
                self.clear()
                self.held = 0
            self.learn({w for _, words in waiting for w in words} - self.keys())
            get = self.__getitem__
            for i, words in waiting:
                out[i].append(b"".join(map(get, words)))
            for w in self.long:
                self.held -= ENTRY_BYTES + 2 * len(w) + len(self.pop(w))
            waiting.clear(), self.long.clear()

        for i, v in enumerate(values):
            for part in stretches(v) if v else ():
                waiting.append((i, part.split(" ")))
                size += len(part)
                if size >= STRETCH:
                    flush()
                    size = 0
        flush()
        return [b"".join(parts) for parts in out]


def stretches(text: str):
    """The text with line feeds as spaces, cut at spaces into parts of about ``STRETCH`` characters."""
    text = text.replace("\n", " ")
    at = 0
    while len(text) - at > STRETCH:
        end = text.find(" ", at + STRETCH)
        if end < 0:
            break
        yield text[at:end]
        at = end + 1
    yield text[at:] if at else text


def encoder(path: str) -> Encoder:
    """One encoder for each worker process and file."""
    return held(("wordbpe", path), lambda: Encoder(path))
