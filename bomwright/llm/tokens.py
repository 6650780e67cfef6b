"""Encoding whole texts to token ids with the tokenizers library, inside tasks.

Byte-level BPE splits a text before the merges, and a single space between two
non-spaces always starts a new unit there. So the ids of a text are the ids of its
space-separated pieces in order, and a piece seen before need not be encoded
again. Texts that hold an added token's string, or white space next to a space,
are encoded as one piece. For any other kind of tokenizer every text is.
"""

from __future__ import annotations

import json
import os
from itertools import chain, islice

import numpy as np

DEFAULT_FILE = "byte_bpe_50k.json"
END_ID = 2
#: Texts whose unknown pieces are encoded together.
GROUP = 1024


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(DEFAULT_FILE)


class Encoder:
    """Texts to little-endian unsigned 32-bit ids. Remembers at most ``max_pieces`` pieces."""

    def __init__(self, path: str, max_pieces: int = 500_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as file:
            kind = json.load(file)
        pre = kind.get("pre_tokenizer") or {}
        self.by_piece = kind.get("normalizer") is None and pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space") and kind["model"]["type"] == "BPE"
        self.added = [t["content"] for t in kind.get("added_tokens") or []]
        self.max_pieces = max_pieces
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        self.spaced = np.zeros(max(vocabulary.values(), default=0) + 1, bool)
        self.spaced[[i for t, i in vocabulary.items() if t.startswith("\u0120")]] = True  # how byte-level BPE writes a space
        self.later: dict[str, bytes | None] = {}  # pieces after a space; None: white space at an edge
        self.first: dict[str, bytes | None] = {}

    def whole(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self, known: dict, pieces: set[str], spaced: bool) -> None:
        """Adds what is not known yet. Spaced pieces are encoded as one text: a token that begins with a space begins a piece."""
        new = pieces.difference(known)
        if len(known) + len(new) > self.max_pieces:
            # Common pieces came early: the first third stays.
            kept = dict(islice(known.items(), self.max_pieces // 3))
            known.clear()
            known.update(kept)
            new = pieces.difference(known)
        edged = [p for p in new if not p or p.strip() != p]
        plain = list(new.difference(edged))
        known.update(dict.fromkeys(edged))
        if not plain:
            return
        if spaced:
            ids = np.array(self.tokenizer.encode_batch_fast([" " + " ".join(plain)], add_special_tokens=False)[0].ids, "<u4")
            at = np.append(np.flatnonzero(self.spaced[ids]), len(ids)) * 4
            if len(at) == len(plain) + 1:
                data, at = ids.tobytes(), at.tolist()
                known.update(zip(plain, [data[i:j] for i, j in zip(at, at[1:])], strict=True))
                return
        known.update(zip(plain, self.whole([" " * spaced + p for p in plain]), strict=True))

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text, as bytes."""
        if not self.by_piece:
            return self.whole(texts)
        out = []
        for at in range(0, len(texts), GROUP):
            group = texts[at : at + GROUP]
            split = [t.split(" ") for t in group]
            heads = [p[0] for p in split]
            self._learn(self.first, set(heads), False)
            self._learn(self.later, set(chain.from_iterable(split)), True)
            later, first = self.later.__getitem__, self.first.__getitem__
            for text, pieces, head in zip(group, split, heads, strict=True):
                if any(a in text for a in self.added):
                    out += self.whole([text])
                    continue
                try:
                    begin = first(head)
                    pieces[0] = pieces[-1]  # its own value comes from the other table
                    values = list(map(later, pieces))
                    values[0] = begin
                    out.append(b"".join(values))
                except TypeError:
                    out += self.whole([text])
        return out


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One encoder for each worker process and vocabulary."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]
