"""Byte-level BPE encoding and decoding by forced-boundary splitting.

A pair of bytes that stands inside no token of the vocabulary can never be merged over: between such two bytes every
encoding has a cut. A table of 65,536 flags, read off the vocabulary, therefore splits a text at certain places without
running a single merge; the fragments in between (a few bytes each) are encoded independently, each distinct one once
per worker, and the ids are concatenated. The cuts of the tokenizer's own splitting rule (contractions, runs of letters,
digits, other signs, and white space with its look-ahead) are found for the whole batch at once from the classes of its
code points and count as further certain cuts. A fragment is encoded by plain merging in order of rank, here, not by a
library. Character classes are asked from the file's own pre-tokenizer, 256 code points at a time as they occur, so
they are exactly the library's.

Ids equal ``encode(text, add_special_tokens=False)`` of the ``tokenizers`` library with the file as it is (truncation
and padding off); a string of an added token, such as ``<|endoftext|>``, is that token. ``decode`` joins the ids' bytes
and reads them as UTF-8 as the library's ``decode(ids, skip_special_tokens=False)`` does: a byte that belongs to no
character becomes U+FFFD.

Scale: no shuffle and no state across tasks; a task holds at most ``SLICE`` characters of text at a time (a longer text
is cut where white space begins) and a bounded cache of fragments.

Nulls and edges: a null or empty text has no ids (``n_tokens`` 0, digests of the empty string); very long texts are
encoded whole, in slices; repeated rows and ids are each returned; a null id stays null; an empty table gives no rows;
other columns are ignored. Files with a normalizer, another pre-tokenizer or model, or added tokens that take white
space or word borders into account, are refused.
"""
from __future__ import annotations

import hashlib
import heapq
import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from soilcast.llm import tokens
from soilcast.llm.common import ship, text_or_empty, worker_state

ship(__name__)

SLICE = 1 << 20       # characters of text encoded at once
CACHE = 1_000_000     # distinct fragments a worker remembers
KEPT = 200_000        # of these stay when it is full: the first met, so mostly the commonest
SHORT = 24            # bytes of a fragment that is merged together with others
KEY = 7               # bytes of a fragment that is looked up together with others
_MIX = np.uint64(0x9E3779B97F4A7C15)
_MASK = np.array([(1 << 8 * n) - 1 for n in range(KEY + 1)], np.uint64)
_LETTER, _DIGIT, _SIGN, _SPACE, _UNKNOWN = range(5)
_EDGE = re.compile(r"\S(?=[ \n\t\r])")
_PLAIN = {"single_word", "lstrip", "rstrip", "normalized"}


class _Numbers:
    """Fragment to its number; new ones get the next numbers and are noted. Fragments of up to KEY bytes are looked up all
    at once by their bytes and length as one integer, in a hash table with linear probing; longer ones in a dictionary."""

    def __init__(self):
        self.new: list[bytes] = []
        self.count = 0
        self.longer: dict[bytes, int] = {}
        self._table(np.empty(0, np.uint64), np.empty(0, np.int32), 16)

    def _table(self, keys: np.ndarray, numbers: np.ndarray, bits: int) -> None:
        self.bits, self.held = bits, 0
        self.keys, self.numbers = np.zeros(1 << bits, np.uint64), np.zeros(1 << bits, np.int32)
        self._put(keys, numbers)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * _MIX) >> np.uint64(64 - self.bits)).astype(np.int64)

    def _put(self, keys: np.ndarray, numbers: np.ndarray) -> None:
        """Distinct keys that the table does not hold."""
        if 2 * (self.held + len(keys)) > len(self.keys):
            on = np.flatnonzero(self.keys)
            old = self.keys[on], self.numbers[on]
            bits = int(2 * (self.held + len(keys))).bit_length() + 1
            self._table(np.concatenate([old[0], keys]), np.concatenate([old[1], numbers]), bits)
            return
        self.held += len(keys)
        slot = self._slot(keys)
        while len(keys):
            free = self.keys[slot] == 0
            self.keys[slot[free]] = keys[free]        # of several at one place the last stays
            done = self.keys[slot] == keys
            self.numbers[slot[done]] = numbers[done]
            keys, numbers, slot = keys[~done], numbers[~done], (slot[~done] + 1) & (len(self.keys) - 1)

    def _find(self, keys: np.ndarray) -> np.ndarray:
        """Numbers of keys, -1 for those not held."""
        slot = self._slot(keys)
        there = self.keys[slot]
        out = np.where(there == keys, self.numbers[slot], np.int32(-1))
        left = np.flatnonzero((there != keys) & (there != 0))
        slot = slot[left]
        while len(left):
            slot = (slot + 1) & (len(self.keys) - 1)
            there = self.keys[slot]
            hit = there == keys[left]
            out[left[hit]] = self.numbers[slot[hit]]
            on = ~hit & (there != 0)
            left, slot = left[on], slot[on]
        return out

    def of(self, raw: bytes, places: np.ndarray) -> np.ndarray:
        """Numbers of the fragments of ``raw`` that begin at ``places``."""
        size = np.diff(places, append=len(raw))
        short = np.flatnonzero(size <= KEY)
        padded = np.frombuffer(raw + bytes(8), np.uint8)
        window = np.ndarray(len(raw) + 1, "<u8", padded, strides=(1,))     # the eight bytes from every place on
        n = size[short]
        keys = (window[places[short]] & _MASK[n]) | (n.astype(np.uint64) << np.uint64(56))
        found = self._find(keys)
        miss = np.flatnonzero(found < 0)
        if len(miss):
            fresh, first, which = np.unique(keys[miss], return_index=True, return_inverse=True)
            numbers = np.arange(self.count, self.count + len(fresh), dtype=np.int32)
            at = short[miss[first]]
            self.new += [raw[s:s + k] for s, k in zip(places[at].tolist(), size[at].tolist())]
            self.count += len(fresh)
            self._put(fresh, numbers)
            found[miss] = numbers[which]
        out = np.empty(len(places), np.int64)
        out[short] = found
        rest = np.flatnonzero(size > KEY)
        for i, s, k in zip(rest.tolist(), places[rest].tolist(), size[rest].tolist()):
            f = raw[s:s + k]
            number = self.longer.get(f)
            if number is None:
                number = self.longer[f] = self.count
                self.count += 1
                self.new.append(f)
            out[i] = number
        return out

    def shrink(self, kept: int) -> None:
        """Forgets all but the first ``kept`` fragments."""
        on = np.flatnonzero((self.keys != 0) & (self.numbers < kept))
        self.longer = {f: n for f, n in self.longer.items() if n < kept}
        self.count = kept
        self._table(self.keys[on], self.numbers[on], max(16, int(2 * len(on)).bit_length() + 1))


def _spread(first: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indices first[0], first[0]+1, ... of ``lengths[0]`` items, then of the next, and so on."""
    ends = np.cumsum(lengths)
    return np.repeat(first - (ends - lengths), lengths) + np.arange(ends[-1] if len(ends) else 0)


class Vocabulary:
    """What a tokenizer file says: tokens as bytes, merge ranks, added tokens, pairs of bytes inside a token."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        pre, model = spec.get("pre_tokenizer") or {}, spec["model"]
        if (spec.get("normalizer") or pre.get("type") != "ByteLevel" or pre.get("add_prefix_space")
                or not pre.get("use_regex", True) or model.get("type") != "BPE" or model.get("ignore_merges")
                or any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix",
                                              "end_of_word_suffix", "byte_fallback"))
                or any(t.get(k) for t in spec["added_tokens"] for k in _PLAIN)):
            raise ValueError(f"{path} is not a plain byte-level BPE file")
        self.pre = Tokenizer.from_file(path).pre_tokenizer
        byte_of = {c: b for b, c in tokens._BYTE_SIGNS.items()} | {b: b for b in tokens._SHOWN}
        as_bytes = {t: bytes(byte_of[ord(c)] for c in t) for t in model["vocab"]}
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        by_id = {i: as_bytes[t] for t, i in model["vocab"].items()} | {i: t.encode() for t, i in self.added.items()}
        self.size = max(by_id) + 1
        self.bytes = [by_id.get(i, b"") for i in range(self.size)]
        self.byte_id = np.zeros(256, np.int64)
        self.inside = np.zeros(1 << 16, bool)   # the pair occurs inside a token
        for t, i in model["vocab"].items():
            b = as_bytes[t]
            if len(b) == 1:
                self.byte_id[b[0]] = i
            for x, y in zip(b, b[1:]):
                self.inside[x << 8 | y] = True
        pairs = [m.split(" ", 1) if isinstance(m, str) else m for m in model["merges"]]
        v = model["vocab"]
        self.ranks = {(v[a], v[b]): (r, v[a + b]) for r, (a, b) in enumerate(pairs)}
        keys = np.array([a * self.size + b for a, b in self.ranks], np.int64)
        order = np.argsort(keys)
        self.keys = keys[order]
        self.rank, self.made = np.array(list(self.ranks.values()), np.int64).reshape(-1, 2)[order].T


class Encoder:
    """Encodes and decodes texts with one vocabulary; keeps its cache as long as it lives."""

    def __init__(self, path: str):
        self.v = Vocabulary(path)
        self.kind = np.full(0x110000, _UNKNOWN, np.uint8)
        self.specials = re.compile("|".join(re.escape(t) for t in sorted(self.v.added, key=len, reverse=True))) \
            if self.v.added else None
        self.numbers, self.used = _Numbers(), 0
        self.ids, self.ends = np.empty(1 << 20, np.uint32), np.zeros(CACHE, np.int64)
        self.text = _Table(self.v.bytes)
        self.decimal = _Table([b"%d," % i for i in range(self.v.size)])

    # ---- cuts ---------------------------------------------------------------------------------------------------
    def _learn_kinds(self, points: np.ndarray) -> None:
        split = self.v.pre.pre_tokenize_str
        for page in np.unique(points >> 8).tolist():
            for p in range(page << 8, (page + 1) << 8):
                if 0xD800 <= p < 0xE000:
                    continue
                c = chr(p)
                self.kind[p] = next((k for k, x in ((_LETTER, "a"), (_DIGIT, "1"), (_SIGN, "!"))
                                     if len(split(x + c)) == 1), _SPACE)

    def _rule_cuts(self, points: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """Flags of the code points at which the splitting rule begins a new part; ``starts``: where texts begin."""
        kind = self.kind[points]
        if (kind == _UNKNOWN).any():
            self._learn_kinds(points[kind == _UNKNOWN])
            kind = self.kind[points]
        n = len(points)
        begins = np.zeros(n + 3, bool)
        begins[starts] = True
        begins[n:] = True
        space = kind == _SPACE
        cut = np.empty(n, bool)
        cut[0] = True
        cut[1:] = kind[1:] != kind[:-1]
        # a single blank belongs to what follows it; any other white space does not
        cut[1:] &= ~((points[:-1] == 32) & ~space[1:])
        # the last of several spaces stands alone, or with what follows, unless the text ends there
        ahead = np.zeros(n, bool)
        ahead[:-1] = ~space[1:]
        ahead &= ~begins[1:n + 1]
        cut[1:] |= space[1:] & space[:-1] & ahead[1:]
        cut |= begins[:n]
        quotes = np.flatnonzero((points == 39) & cut)
        if len(quotes):
            far = np.concatenate([points, np.zeros(3, points.dtype)])
            one, two = far[quotes + 1], far[quotes + 2]
            one = np.where(begins[quotes + 1], 0, one)
            two = np.where(begins[quotes + 1] | begins[quotes + 2], 0, two)
            length = np.where(np.isin(one, [ord(c) for c in "stmd"]), 1, 0)
            for a, b in ("re", "ve", "ll"):
                length[(one == ord(a)) & (two == ord(b))] = 2
            quotes, length = quotes[length > 0], length[length > 0]
            cut[quotes + 1] = False
            after = quotes + 1 + length
            cut[after[after < n]] = True
        return cut

    def _fragments(self, texts: list[str]) -> tuple[bytes, np.ndarray, np.ndarray]:
        """Bytes of all texts, where their fragments begin, and the number of fragments per text. No text is empty."""
        joined = "".join(texts)
        raw = joined.encode()
        b = np.frombuffer(raw, np.uint8)
        starts = np.cumsum([0, *map(len, texts[:-1])])
        if len(raw) == len(joined):
            cut = self._rule_cuts(b, starts)
        else:
            at = np.flatnonzero((b & 0xC0) != 0x80)
            cut = np.zeros(len(b), bool)
            cut[at[self._rule_cuts(np.frombuffer(joined.encode("utf-32-le"), np.uint32), starts)]] = True
            starts = at[starts]
        cut[1:] |= ~self.v.inside[(b[:-1].astype(np.uint16) << 8) | b[1:]]
        places = np.flatnonzero(cut)
        counts = np.diff(np.append(np.searchsorted(places, starts), len(places)))
        return raw, places, counts

    # ---- merging ------------------------------------------------------------------------------------------------
    def _merge_short(self, fragments: list[bytes]) -> list[np.ndarray]:
        """Fragments of up to SHORT bytes, all at once: in each round every one merges its best pair, the leftmost of
        equal ones, until none has a pair left."""
        v, n = self.v, len(fragments)
        length = np.fromiter(map(len, fragments), np.int64, n)
        width = int(length.max())
        grid = np.frombuffer(b"".join(f.ljust(width, b"\0") for f in fragments), np.uint8).reshape(n, width)
        ids = np.where(np.arange(width) < length[:, None], v.byte_id[grid], -1)
        out: list[np.ndarray | None] = [None] * n
        row = np.arange(n)
        none = len(v.keys) + 1
        while len(row):
            if ids.shape[1] > 1:
                left, right = ids[:, :-1], ids[:, 1:]
                key = np.where((left >= 0) & (right >= 0), left * v.size + right, -1)
                at = np.minimum(np.searchsorted(v.keys, key), len(v.keys) - 1)
                rank = np.where(v.keys[at] == key, v.rank[at], none)
                best = rank.argmin(axis=1)
                r = np.arange(len(row))
                go = rank[r, best] < none
            else:
                go = np.zeros(len(row), bool)
            for k in np.flatnonzero(~go).tolist():
                x = ids[k]
                out[row[k]] = x[x >= 0].astype(np.uint32)
            if not go.any():
                break
            ids, best, at, row = ids[go], best[go], at[go], row[go]
            r = np.arange(len(row))
            made = v.made[at[r, best]]
            col = np.arange(ids.shape[1])
            moved = np.concatenate([ids[:, 1:], np.full((len(row), 1), -1, ids.dtype)], axis=1)
            ids = np.where(col <= best[:, None], ids, moved)
            ids[r, best] = made
            ids = ids[:, :-1] if (ids[:, -1] < 0).all() else ids
        return out

    def _merge_long(self, fragment: bytes) -> np.ndarray:
        """One fragment of any length: pairs in a heap by rank and place, neighbours in linked lists."""
        ranks = self.v.ranks
        ids = self.v.byte_id[np.frombuffer(fragment, np.uint8)].tolist()
        n = len(ids)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(*ranks[p], i, *p) for i, p in enumerate(zip(ids, ids[1:])) if p in ranks]
        heapq.heapify(heap)
        while heap:
            _, made, i, a, b = heapq.heappop(heap)
            j = after[i]
            if ids[i] != a or j >= n or ids[j] != b:
                continue                      # one of the two has been merged meanwhile
            ids[i], ids[j] = made, -1
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                if (p := (made, ids[k])) in ranks:
                    heapq.heappush(heap, (*ranks[p], i, *p))
            if (h := before[i]) >= 0 and (p := (ids[h], made)) in ranks:
                heapq.heappush(heap, (*ranks[p], h, *p))
        return np.array([x for x in ids if x >= 0], np.uint32)

    def _learn(self, fragments: list[bytes]) -> None:
        got: list[np.ndarray | None] = [None] * len(fragments)
        short = [k for k, f in enumerate(fragments) if len(f) <= SHORT]
        short.sort(key=lambda k: len(fragments[k]))
        for at in range(0, len(short), 8192):
            part = short[at:at + 8192]
            for k, x in zip(part, self._merge_short([fragments[k] for k in part])):
                got[k] = x
        for k, f in enumerate(fragments):
            if got[k] is None:
                got[k] = self._merge_long(f)
        flat = np.concatenate(got)
        n, total = self.numbers.count - len(got), self.used + len(flat)
        if total > len(self.ids):
            self.ids = np.concatenate([self.ids, np.empty(max(total, len(self.ids)), np.uint32)])
        if n + len(got) + 1 > len(self.ends):
            self.ends = np.concatenate([self.ends, np.zeros(len(self.ends) + len(got), np.int64)])
        self.ids[self.used:total] = flat
        self.ends[n + 1:n + 1 + len(got)] = self.used + np.cumsum([len(x) for x in got])
        self.used = total

    # ---- texts --------------------------------------------------------------------------------------------------
    def _encode_parts(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids, ids per text) of texts without added tokens, none empty."""
        if not texts:
            return np.empty(0, np.uint32), np.empty(0, np.int64)
        if self.numbers.count > CACHE:
            self.numbers.shrink(KEPT)
            self.used = int(self.ends[KEPT])
        raw, places, counts = self._fragments(texts)
        at = self.numbers.of(raw, places)
        if self.numbers.new:
            new, self.numbers.new = self.numbers.new, []
            self._learn(new)
        first, lengths = self.ends[at], self.ends[at + 1] - self.ends[at]
        return self.ids[_spread(first, lengths)], np.add.reduceat(lengths, np.cumsum(counts) - counts)

    def _parts(self, text: str) -> Iterator[str | int]:
        """A text as pieces that are encoded by themselves: added tokens (their ids), and slices of what lies between."""
        at = 0
        for m in [*(self.specials.finditer(text) if self.specials else ()), None]:
            end = m.start() if m else len(text)
            while at < end:
                edge = _EDGE.search(text, at + SLICE, end) if end - at > SLICE else None
                stop = edge.end() if edge else end
                yield text[at:stop]
                at = stop
            if m:
                yield self.v.added[m.group()]
                at = m.end()

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, one after another, number of ids per text)."""
        flat, sizes = [], np.zeros(len(texts), np.int64)
        parts: list[str] = []
        owner: list[int] = []

        def flush():
            ids, n = self._encode_parts(parts)
            flat.append(ids)
            np.add.at(sizes, owner, n)
            parts.clear(), owner.clear()

        held = 0
        for i, t in enumerate(texts):
            if len(t) <= SLICE and not (self.specials and self.specials.search(t)):
                if t:
                    parts.append(t), owner.append(i)
                    held += len(t)
            else:
                for p in self._parts(t):
                    if isinstance(p, int):
                        flush()
                        held = 0
                        flat.append(np.array([p], np.uint32))
                        sizes[i] += 1
                        continue
                    parts.append(p), owner.append(i)
                    held += len(p)
                    if held > SLICE:
                        flush()
                        held = 0
            if held > SLICE:
                flush()
                held = 0
        flush()
        return np.concatenate(flat), sizes

    def decode(self, ids: np.ndarray, sizes: np.ndarray) -> list[str]:
        """The texts of id sequences that lie one after another."""
        raw, n = self.text.join(ids, sizes)
        ends = np.cumsum(n).tolist()
        return [raw[s:e].decode("utf-8", "replace") for s, e in zip([0, *ends], ends)]

    def decimals(self, ids: np.ndarray, sizes: np.ndarray) -> list[bytes]:
        """The ids of each sequence in decimal, joined by commas."""
        raw, n = self.decimal.join(ids, sizes)
        ends = np.cumsum(n).tolist()
        return [raw[s:max(s, e - 1)] for s, e in zip([0, *ends], ends)]


class _Table:
    """Byte strings by number, for joining many at once."""

    def __init__(self, entries: list[bytes]):
        self.flat = np.frombuffer(b"".join(entries), np.uint8)
        self.length = np.fromiter(map(len, entries), np.int64, len(entries))
        self.first = np.cumsum(self.length) - self.length

    def join(self, ids: np.ndarray, sizes: np.ndarray) -> tuple[bytes, np.ndarray]:
        """(the entries of all ids as one string, bytes per sequence)."""
        lengths = self.length[ids]
        ends = np.concatenate([[0], np.cumsum(lengths)])[np.concatenate([[0], np.cumsum(sizes)])]
        return self.flat[_spread(self.first[ids], lengths)].tobytes(), np.diff(ends)


def encoder(path: str) -> Encoder:
    """The worker's encoder of a file, its cache kept across tasks."""
    state = worker_state("forced_bpe")
    if path not in state:
        state[path] = Encoder(path)
    return state[path]


def _batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches in slices of about SLICE bytes of text (column 1), or one row."""
    for b in batches:
        if not b.num_rows:
            continue
        size = np.cumsum(pa.compute.binary_length(b.column(1)).to_numpy(zero_copy_only=False))
        at = 0
        while at < b.num_rows:
            done = size[at - 1] if at else 0
            stop = max(at + 1, int(np.searchsorted(size, done + SLICE, "right")))
            yield b.slice(at, stop - at)
            at = stop


def encode_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                 vocabulary: str = tokens.BYTE_BPE, path: str | None = None) -> DataFrame:
    """(doc_id, ids): the ids of every whole text as an array of int."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path or tokens.vocabulary_path(vocabulary))
        for b in _batches(batches):
            ids, sizes = enc.encode(b.column(1).to_pylist())
            ends = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.ListArray.from_arrays(
                pa.array(ends), pa.array(ids.astype(np.int32)))], names=["doc_id", "ids"])

    return _source(docs, id_col, text_col).mapInArrow(run, "doc_id bigint, ids array<int>")


def decode_ids(encoded: DataFrame, vocabulary: str = tokens.BYTE_BPE, path: str | None = None) -> DataFrame:
    """(doc_id, text): the texts of (doc_id, ids)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path or tokens.vocabulary_path(vocabulary))
        for b in batches:
            for at in range(0, b.num_rows, 256):
                part = b.slice(at, 256)
                lists = part.column(1)
                sizes = pa.compute.fill_null(pa.compute.list_value_length(lists), 0).to_numpy().astype(np.int64)
                flat = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(enc.decode(flat, sizes), pa.string())],
                                                 names=["doc_id", "text"])

    return encoded.select("doc_id", F.coalesce("ids", F.array().cast("array<int>")).alias("ids")) \
        .mapInArrow(run, "doc_id bigint, text string")


def round_trip(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
               vocabulary: str = tokens.BYTE_BPE, path: str | None = None) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256): every whole text encoded, its ids decoded again, as digests."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path or tokens.vocabulary_path(vocabulary))
        for b in _batches(batches):
            ids, sizes = enc.encode(b.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(sizes),
                 pa.array([hashlib.sha256(x).hexdigest() for x in enc.decimals(ids, sizes)], pa.string()),
                 pa.array([hashlib.sha256(x.encode()).hexdigest() for x in enc.decode(ids, sizes)], pa.string())],
                names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return _source(docs, id_col, text_col).mapInArrow(
        run, "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string")


def _source(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).alias("text"))
