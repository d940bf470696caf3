"""Whole-text tokenization with a bounded cache of words.

The vocabulary drops white space and never lets a token cross it, so the ids of a text are the ids of its
white-space-separated words in turn; each distinct word is encoded once per worker.
"""

from __future__ import annotations

import os
import unicodedata
from array import array

import numpy as np

#: Words that a worker remembers at most; beyond it the memory starts again (same ids, more work).
CACHE_WORDS = 600_000
_loaded: dict[str, tuple] = {}


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


#: How the vocabulary cuts a normalised word (fixed by its file); pieces are encoded apart.
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


class WordEncoder:
    """text -> little-endian uint32 ids as bytes (no special tokens added; those that the text spells out are found, as the library does)."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        import regex
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        added = self.tokenizer.get_added_tokens_decoder()
        if any(t.normalized or t.single_word or t.lstrip or t.rstrip for t in added.values()):
            raise ValueError("the vocabulary's special strings depend on what is around them")
        # special strings are found in the raw text and cut it; what is between them is encoded apart
        self.special = {t.content.encode(): i.to_bytes(4, "little") for i, t in added.items()}
        self.split = regex.compile(b"|".join(regex.escape(s) for s in sorted(self.special, key=len, reverse=True))).split
        vocabulary = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, dtype=bool)
        self.ends[[i for s, i in vocabulary.items() if s.endswith("</w>")]] = True
        self.cut = regex.compile(PIECES).findall
        self.words: dict[bytes, bytes] = {}
        self.pieces: dict[str, bytes] = {}

    def encode(self, text: bytes) -> bytes:
        if not any(s in text for s in self.special):
            return self.plain(text)
        out, at = [], 0
        for part in self.split(text):
            out.append(self.plain(part))
            at += len(part)
            mark = next((s for s in self.special if text.startswith(s, at)), b"")
            out.append(self.special.get(mark, b""))
            at += len(mark)
        return b"".join(out)

    def plain(self, text: bytes) -> bytes:
        """Ids of a text without special strings."""
        whole = text.decode("utf-8", "replace")
        if whole.isascii() or (unicodedata.is_normalized("NFC", whole) and "\u03a3" not in whole and "\u0130" not in whole):
            text = whole.lower().encode()
        words = text.split()  # of bytes: ASCII white space only
        known = self.words
        unknown = set(words).difference(known)
        if not unknown:
            return b"".join(map(known.__getitem__, words))
        if len(known) > CACHE_WORDS:
            known.clear()
            unknown = set(words)
        if len(self.pieces) > CACHE_WORDS:
            self.pieces.clear()
        pieces, lists, lacking, odd = self.pieces, {}, {}, []
        for w in unknown:
            s = w.decode("utf-8", "replace")
            if not s.isascii() and not (unicodedata.is_normalized("NFC", s) and "\u03a3" not in s and "\u0130" not in s and len(s.split()) == 1):
                # where case or composition could depend on neighbours, the whole word is encoded as it is
                odd.append(w)
                continue
            s = s.lower()
            core = s.rstrip(".,!?")
            if core.isalpha():
                own = [core] if len(core) == len(s) else [core, s[len(core) :]]
            else:
                own = self.cut(s)
            lists[w] = own
            for p in own:
                if p not in pieces:
                    lacking[p] = None
        if lacking:
            new = list(lacking)
            groups = [" ".join(new[i : i + 500]) for i in range(0, len(new), 500)]
            ids = np.array([x for e in self.tokenizer.encode_batch_fast(groups, add_special_tokens=False) for x in e.ids], dtype="<u4")
            cuts = [0, *(4 * (np.flatnonzero(self.ends[ids]) + 1)).tolist()]
            data = ids.tobytes()
            if len(cuts) != len(new) + 1:
                raise ValueError("the vocabulary doesn't end each word with a word-end token")
            for k, p in enumerate(new):
                pieces[p] = data[cuts[k] : cuts[k + 1]]
        for w in odd:
            known[w] = array("I", self.tokenizer.encode(w.decode("utf-8", "replace"), add_special_tokens=False).ids).tobytes()
        for w, own in lists.items():
            known[w] = pieces[own[0]] if len(own) == 1 else b"".join([pieces[p] for p in own])
        return b"".join(map(known.__getitem__, words))


def encoder(path: str) -> WordEncoder:
    """One encoder for each worker process and vocabulary."""
    if path not in _loaded:
        _loaded[path] = (WordEncoder(path),)
    return _loaded[path][0]
