"""Encoding of whole texts with a public tokenizer file, inside Python workers.

Both vocabularies used here never merge across the start of a white-space run, so a text's ids are the concatenation
of the ids of its chunks. Each distinct chunk, and each distinct part of one, is encoded by the ``tokenizers`` library
once per worker (bounded caches) and looked up after that; results equal the library's encoding of the whole text (tested). Texts with one of
the separators U+001C-U+001F, on which Python and the library disagree about white space, or with the string of an
added token such as ``<|endoftext|>``, go to the library whole, as do all texts of other vocabularies. Ids are those of
the file as it is, with add_special_tokens=False: an added token's string in a text is that token."""
from __future__ import annotations

import re
from array import array
from collections.abc import Iterable, Iterator
from itertools import islice

import numpy as np

from soilcast.llm.common import ship, worker_state

ship(__name__)

BYTE_BPE = "byte_bpe_50k.json"
WORD_BPE = "word_bpe_49k.json"
# How a vocabulary treats the white space in front of a chunk: a part of it, or dropped.
LEADING = {BYTE_BPE: True, WORD_BPE: False}
END_ID = 0
CACHE = 600_000
KEPT = 150_000  # entries that stay when the cache is full: the first met, so mostly the commonest
_SLICE = 1 << 22
_ODD = re.compile("[\x1c-\x1f]")
# A chunk of Latin-1 letters and ASCII signs (no apostrophe or digit: the split rules treat those in ways of their own).
_SIMPLE = re.compile(r"([ \n]?)([A-Za-z\xc0-\xd6\xd8-\xf6\xf8-\xff]*)([!-&(-/:-@\[-`{-~]*)")
# Byte-level vocabularies write a byte outside the printable ranges as the next free code point from 256 on.
_SHOWN = [*range(33, 127), *range(161, 173), *range(174, 256)]
_BYTE_SIGNS = {b: 256 + i for i, b in enumerate(b for b in range(256) if b not in set(_SHOWN))}
_SIGNS = [chr(_BYTE_SIGNS.get(b, b)) for b in range(256)]
_CHUNK = re.compile(r"\s*\S+|\s+")
_EDGE = re.compile(r"\S(?=\s)")


def vocabulary_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class _Ids(dict):
    """Chunk (or part of one) to its ids, as little-endian unsigned 32-bit integers; what is new is learnt by ``of``."""

    def __init__(self, of):
        self.of = of

    def __missing__(self, chunk: str) -> bytes:
        ids = self[chunk] = self.of(chunk)
        return ids

    def shrink(self):
        if len(self) > CACHE:
            kept = list(islice(self.items(), KEPT))
            self.clear()
            self.update(kept)


class Encoder:
    """Encodes texts with the file at ``path``; ``leading`` is True, False or None (no chunks: whole texts only).
    ``special_as_text``: strings of special tokens in a text are ordinary text, else the tokens, as the file says."""

    def __init__(self, path: str, leading: bool | None, special_as_text: bool = True):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.tok.encode_special_tokens = special_as_text
        # strings that the library takes out of a text before it splits it
        self.added = [t.content for t in self.tok.get_added_tokens_decoder().values()
                      if not (special_as_text and t.special)]
        self.leading, self.model = leading, self.tok.model
        self.chunks, self.parts = _Ids(self._chunk), _Ids(self._part)

    def _whole(self, text: str) -> bytes:
        return np.array(self.tok.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _part(self, part: str) -> bytes:
        """Ids of letters or signs between two splits of the library, by its BPE model."""
        if not part.isascii() or part[0] in " \n":
            part = "".join([_SIGNS[b] for b in part.encode()])
        return array("I", [t.id for t in self.model.tokenize(part)]).tobytes()

    def _chunk(self, chunk: str) -> bytes:
        """Ids of a new chunk. One of plain letters and signs is split here the way the library splits it, and its new
        parts go straight to the library's BPE model; any other goes through the library as a text."""
        if not self.leading and chunk.isascii() and chunk.isalpha():
            return self.parts[chunk.lower()]
        m = _SIMPLE.fullmatch(chunk)
        if not m:
            return self._whole(chunk)
        gap, letters, signs = m.groups()
        if not self.leading:
            letters, gap = letters.lower(), ""
        elif gap == " ":
            letters, signs, gap = (gap + letters, signs, "") if letters else ("", gap + signs, "")
        out = self.parts[letters] if letters else b""
        if signs:
            out += self.parts[signs]
        return self.parts[gap] + out if gap else out

    def _ids(self, text: str) -> bytes:
        self.chunks.shrink(), self.parts.shrink()
        return b"".join(map(self.chunks.__getitem__, self._split(text)))

    def _long(self, text: str) -> bytes:
        """A very long text in slices that end where a white-space run begins."""
        out, at = [], 0
        while at < len(text):
            edge = _EDGE.search(text, at + _SLICE)
            end = edge.end() if edge else len(text)
            out.append(self._ids(text[at:end]))
            at = end
        return b"".join(out)

    def _split(self, text: str) -> list[str]:
        return _CHUNK.findall(text) if self.leading else text.split()

    def encode_bytes(self, texts: Iterable[str]) -> Iterator[bytes]:
        """Each text's ids as little-endian unsigned 32-bit integers."""
        for t in texts:
            if self.leading is None or _ODD.search(t) or any(a in t for a in self.added):
                yield self._whole(t)
            else:
                yield self._long(t) if len(t) > _SLICE else self._ids(t)

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        return [np.frombuffer(ids, "<u4") for ids in self.encode_bytes(texts)]


def encoder(path: str, leading: bool | None) -> Encoder:
    """The worker's encoder of a file, with the ids of the library's default: loaded once, its cache kept across
    tasks."""
    state = worker_state("encoders")
    if path not in state:
        state[path] = Encoder(path, leading, special_as_text=False)
    return state[path]


def with_end(ids: np.ndarray, end_id: int) -> np.ndarray:
    return np.append(ids, np.uint32(end_id)).astype("<u4")
