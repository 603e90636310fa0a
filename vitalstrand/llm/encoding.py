"""Token ids of whole texts by a byte-level vocabulary, equal to the library's, with each distinct piece encoded once.

The vocabulary's splitter starts a new unit at a space that is followed by a word, at punctuation that follows a letter
and at a letter that follows a single line feed, so the ids of a text are those of the pieces cut there. The bytes of a
group of texts are cut where they lie and Arrow finds the distinct pieces; a worker remembers where the ids of a piece lie in
one array, so a group's ids are one gather. Cutting at spaces fails where a space has white space on both sides, and special
tokens may hold any character; texts with these go to the library whole.
"""

from __future__ import annotations

import os
import re
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of the pieces and ids that a worker remembers before it starts over; bounds memory, not the result.
MEMO_BYTES = 32 << 20
#: Bytes that one remembered piece costs beside its characters and ids: the string, its entry and its bounds.
ENTRY_BYTES = 200
#: Pieces that are encoded as one text.
UNITS = 2_000
#: Bytes of texts whose pieces are looked up together.
GROUP_BYTES = 2 << 20
#: Letters of every Unicode version.
LETTERS = "A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f\u0410-\u044f\u4e00-\u9fa5"
SPACE = r"[\s\x0B\x1C-\x1F\x{85}\p{Z}]"
#: Kinds of bytes. Cuts are made after Latin letters only, which costs memory only.
LETTER, PUNCTUATION, OTHER, LEAD, LEAD_C3 = 1, 2, 4, 8, 16
KIND = np.zeros(256, dtype=np.uint8)
KIND[0x21:0x7F] = PUNCTUATION
KIND[0x30:0x3A] = OTHER
KIND[0x41:0x5B] = KIND[0x61:0x7B] = LETTER
KIND[0xC4:0xC9], KIND[0xC3] = LEAD, LEAD_C3


def cut(texts: pa.LargeStringArray) -> tuple[pa.LargeStringArray, np.ndarray]:
    """Pieces of all texts, which share their bytes, and how many lie before the begin of each text and the end of the last."""
    bounds = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[bounds[0] : bounds[-1]]
    bounds = bounds - bounds[0]
    kind = KIND[raw]
    letter = kind == LETTER
    starts = raw == 0x20
    # the last byte of a letter; C3 leads two signs that are none
    ends = letter.copy()
    ends[1:] |= (kind[:-1] == LEAD) | (kind[:-1] == LEAD_C3) & (raw[1:] != 0x97) & (raw[1:] != 0xB7)
    starts[1:] |= ends[:-1] & (kind[1:] == PUNCTUATION)
    seen = ends | (kind == PUNCTUATION) | (kind == OTHER)
    starts[2:] |= seen[:-2] & (raw[1:-1] == 0x0A) & letter[2:]
    starts[bounds[bounds < len(raw)]] = True
    at = np.flatnonzero(starts)
    offsets = np.append(at, len(raw)).astype(np.int64)
    return pa.LargeStringArray.from_buffers(len(at), pa.py_buffer(offsets), pa.py_buffer(raw)), np.searchsorted(at, bounds)


class Encoder:
    """Ids of texts; what it remembers never changes them."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        special = [t.content for t in self.library.get_added_tokens_decoder().values()]
        self.odd = "|".join([f"{SPACE} {SPACE}", *map(re.escape, special)])
        # A token is spelt with one character for each of its bytes.
        vocabulary = self.library.get_vocab()
        self.n_bytes = np.zeros(max(vocabulary.values()) + 1, dtype=np.int64)
        self.n_bytes[list(vocabulary.values())] = list(map(len, vocabulary))
        self.unit = re.compile(f" [{LETTERS}]+").fullmatch
        self.forget()

    def forget(self) -> None:
        self.place: dict[str, int] = {}
        self.held = 0
        self.ids, self.n_ids = np.empty(1 << 16, dtype=np.int32), 0
        self.ends = np.zeros(1 << 14, dtype=np.int64)

    def _encode(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.library.encode_batch_fast(texts, add_special_tokens=False)]

    def _units(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of pieces that are one unit, one after the other, and the number of each.

        The splitter cuts such pieces apart again, so many are encoded as one text; the bytes of its ids tell where a piece ends.
        """
        # one text at a time: the library's result is many times the size of its ids
        joined = ("".join(pieces[k : k + UNITS]) for k in range(0, len(pieces), UNITS))
        ids = np.concatenate([np.empty(0, dtype=np.int32), *(np.array(self._encode([text])[0], dtype=np.int32) for text in joined)])
        ends = np.cumsum(np.fromiter((len(p) if p.isascii() else len(p.encode()) for p in pieces), np.int64, len(pieces)))
        until = np.searchsorted(np.cumsum(self.n_bytes[ids]), ends) + 1
        return ids, np.diff(until, prepend=0)

    def _learn(self, pieces: list[str]) -> None:
        units, rest = [], []
        for p in pieces:
            (units if self.unit(p) else rest).append(p)
        ids, sizes = self._units(units)
        found = self._encode(rest) if rest else []
        sizes = np.concatenate([sizes, np.fromiter(map(len, found), np.int64, len(found))])
        self._hold(units + rest, sizes, np.concatenate([ids, np.fromiter(chain.from_iterable(found), np.int32)]))

    def _hold(self, pieces: list[str], sizes: np.ndarray, ids: np.ndarray) -> None:
        at, need = len(self.place), len(ids)
        while self.n_ids + need > len(self.ids):
            self.ids = np.concatenate([self.ids, np.empty(len(self.ids), dtype=np.int32)])
        while at + len(pieces) + 1 > len(self.ends):
            self.ends = np.concatenate([self.ends, np.zeros(len(self.ends), dtype=np.int64)])
        self.ids[self.n_ids : self.n_ids + need] = ids
        self.ends[at + 1 : at + 1 + len(pieces)] = self.n_ids + np.cumsum(sizes)
        self.n_ids += need
        self.place.update(zip(pieces, range(at, at + len(pieces)), strict=True))
        self.held += sum(map(len, pieces)) + 4 * need + ENTRY_BYTES * len(pieces)

    def _renew(self, kept: list[str]) -> None:
        """Start over with the pieces that came again; most of the others were met once."""
        ids, sizes = self._gathered(np.fromiter(map(self.place.__getitem__, kept), np.int64, len(kept)))
        self.forget()
        self._hold(kept, sizes, ids)

    def _gathered(self, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the pieces at ``places``, one after the other, and the number of each."""
        starts, sizes = self.ends[places], self.ends[places + 1] - self.ends[places]
        at = np.repeat(starts - (np.cumsum(sizes) - sizes), sizes)
        at += np.arange(len(at), dtype=np.int64)
        return self.ids[at], sizes

    def _of_pieces(self, pieces: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all pieces, one after the other, and the number of each."""
        coded = pieces.dictionary_encode()
        distinct = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        new = [p for p in distinct if p not in self.place]
        if new:
            if self.held > MEMO_BYTES:
                self._renew([p for p in distinct if p in self.place])
            self._learn(new)
        places = np.fromiter(map(self.place.__getitem__, distinct), np.int64, len(distinct))
        return self._gathered(places[coded.indices.to_numpy()])

    def of(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all ``texts``, one after the other, and the number of ids of each."""
        given = pa.array(texts, pa.large_string())
        odd = np.flatnonzero(pc.match_substring_regex(given, self.odd).to_numpy(zero_copy_only=False)).tolist()
        plain = set(range(len(texts))).difference(odd) if odd else None
        kept = given if plain is None else given.take(pa.array(sorted(plain), pa.int64()))
        counts = np.zeros(len(texts), dtype=np.int64)
        if len(kept):
            pieces, before = cut(kept)
            ids, sizes = self._of_pieces(pieces)
            until = np.concatenate([[0], np.cumsum(sizes)])[before]
            of_kept = np.diff(until)
        else:
            ids, of_kept = np.empty(0, dtype=np.int32), np.zeros(0, dtype=np.int64)
        if plain is None:
            return ids, of_kept
        counts[sorted(plain)] = of_kept
        whole = self._encode([texts[i] for i in odd])
        counts[odd] = [len(a) for a in whole]
        parts, at, wholes = [], 0, dict(zip(odd, whole, strict=True))
        for i in range(len(texts)):
            if i in wholes:
                parts.append(np.array(wholes[i], dtype=np.int32))
            else:
                parts.append(ids[at : at + counts[i]])
                at += counts[i]
        return np.concatenate(parts) if parts else ids, counts


def groups(sizes: np.ndarray, limit: int = GROUP_BYTES) -> list[tuple[int, int]]:
    """Ranges of rows of at most ``limit`` bytes; a longer row is a range of its own."""
    out, lo, held = [], 0, 0
    for i, size in enumerate(sizes.tolist()):
        if i > lo and held + size > limit:
            out.append((lo, i))
            lo, held = i, 0
        held += size
    if lo < len(sizes):
        out.append((lo, len(sizes)))
    return out


@lru_cache(maxsize=1)
def encoder_of(path: str) -> Encoder:
    """The encoder of a worker process, which its tasks share one after the other."""
    return Encoder(path)


def release() -> None:
    """Give up a worker's encoder; called where another kind of work begins in a worker that may have encoded before."""
    encoder_of.cache_clear()
