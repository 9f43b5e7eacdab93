"""Token ids of whole texts by a public tokenizer file, encoded piece by piece.

A byte-level or word-level BPE never merges across certain places of a text (see
``BpeEncoder``), so the ids of a text are those of its pieces, one after another.  Words
recur, hence a task encodes each piece once with the tokenizers library and keeps its ids
in a bounded table.  Texts for which the rule isn't certain are encoded whole.
"""

from __future__ import annotations

import json
import os
import re
from array import array
from collections.abc import Iterable

import numpy as np

#: Pieces, and words of pieces, that a Python worker remembers; later ones are encoded again each time.
REMEMBERED = 500_000


def _byte_letters() -> dict[int, str]:
    """The letters that byte-level BPE writes bytes as: printable Latin-1 ones stand for
    themselves, the others for U+0100 onwards in their order."""
    own = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    rest = [b for b in range(256) if b not in own]
    return {b: chr(b) for b in own} | {b: chr(0x100 + k) for k, b in enumerate(rest)}


class BpeEncoder:
    """Encodes texts as ``Tokenizer.encode(text, add_special_tokens=False)`` does.

    Two kinds of file are known, by their pre-tokenizer: byte-level BPE with the usual
    pattern, where a space before a character that isn't white space always begins a new
    piece, and BPE over matches of a pattern that white space never belongs to.  The
    library's BPE model encodes each word of a piece.  Any other kind of file, a text that
    holds ``<|`` (it may name a special token) and a piece with letters beyond Latin (where
    two regex libraries may disagree) go to the library whole.
    """

    CONTRACTIONS = "'s|'t|'re|'ve|'m|'ll|'d"

    def __init__(self, path: str):
        import regex
        from tokenizers import Tokenizer

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        self.tok = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        pre = spec.get("pre_tokenizer") or {}
        parts = pre.get("pretokenizers", [])
        self.kind, self.lead = "whole", ""
        words = self.CONTRACTIONS + r"|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
        if spec["normalizer"] is None and pre.get("type") == "ByteLevel" and pre.get("use_regex") and not pre.get("add_prefix_space"):
            self.kind = "bytes"
            self.find = regex.compile(self.CONTRACTIONS + r"| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+").findall
            self.lead = " "
        elif parts and parts[0].get("type") == "Split" and parts[0].get("pattern") == {"Regex": words} and parts[0].get("behavior") == "Removed" and parts[0].get("invert"):
            self.kind = "words"
            self.find = regex.compile(words).findall
        self.letters = _byte_letters()
        self.spaces = re.compile(r" \s").search
        self.chunks: dict[str, bytes] = {}
        self.words: dict[str, bytes] = {}

    def _encode(self, texts: list[str]) -> list[bytes]:
        return [np.asarray(e.ids, dtype="<u4").tobytes() for e in self.tok.encode_batch(texts, add_special_tokens=False)]

    def _unsure(self, text: str) -> bool:
        """Whether a text has to be encoded whole."""
        if self.kind == "whole" or not text or "<|" in text:
            return True
        return self.kind == "bytes" and (text[0].isspace() or text[-1] == " " or bool(self.spaces(text)))

    def _word(self, word: str) -> bytes:
        ids = self.words.get(word)
        if ids is None:
            own = self.tok.model.tokenize(word.encode().decode("latin-1").translate(self.letters))
            ids = array("I", [t.id for t in own]).tobytes()
            if len(self.words) < REMEMBERED:
                self.words[word] = ids
        return ids

    def _learn(self, new: list[str]) -> dict[str, bytes]:
        """Ids of chunks not seen before (each with the space before it, where that counts)."""
        odd = {x for x in new if x and max(x) > "\u024f"}
        found = dict(zip(odd, self._encode(list(odd)), strict=True)) if odd else {}
        word, find, lower = self._word, self.find, self.kind == "words"
        for x in new:
            if x not in found:
                y = x if not lower else x.lower() if x.isascii() else self.tok.normalizer.normalize_str(x)
                found[x] = b"".join([word(w) for w in find(y)])
        return found

    def encode(self, texts: Iterable[str | None], end: int | None = None) -> list[bytes]:
        """Ids of each text (null: empty) as little-endian unsigned 32-bit, with ``end`` after them."""
        tail = b"" if end is None else int(end).to_bytes(4, "little")
        out: list[list[bytes | None] | None] = []
        whole: list[tuple[int, str]] = []
        gaps: list[tuple[int, int, str]] = []
        known = self.chunks.get
        for k, text in enumerate(texts):
            text = text or ""
            if self._unsure(text):
                whole.append((k, text))
                out.append(None)
                continue
            own = (text.replace("\n", " ") if self.kind == "words" else text).split(" ")
            ids = list(map(known, own))
            if self.lead:  # no space stands before the first
                ids[0] = self._learn([own[0]])[own[0]]
            if None in ids:
                gaps += [(k, i, self.lead + own[i]) for i, x in enumerate(ids) if x is None]
            out.append(ids)
        fresh = self._learn([x for _, _, x in gaps]) if gaps else {}
        for k, i, x in gaps:
            out[k][i] = fresh[x]
        if len(self.chunks) < REMEMBERED:
            at = len(self.lead)
            self.chunks.update((x[at:], v) for x, v in fresh.items())
        found = [tail if x is None else b"".join(x) + tail for x in out]
        for (k, _), ids in zip(whole, self._encode([x for _, x in whole]), strict=True):
            found[k] = ids + tail
        return found


_encoders: dict[str, BpeEncoder] = {}


def encoder(path: str) -> BpeEncoder:
    """The worker's encoder for a tokenizer file."""
    if path not in _encoders:
        _encoders[path] = BpeEncoder(path)
    return _encoders[path]
