"""Benchmark decontamination by CGK embedding, bit-sampling LSH and exact edit verification.

The CGK walk reads a token sequence with one pointer; at each step it emits the token under the pointer and a
random bit of that token decides whether the pointer moves on. Two walks with the same bits fall into step
again after an insertion or deletion, so sequences at small edit distance emit sequences at small Hamming distance.
A walk of ``STEPS`` steps starts at every token of every document and item; its key samples the first and the last step.
Tables come in pairs of complementary bits, so one walk of a pair leaves its first token; walks that stay are skipped.
A walk can only end one or two places on, so the tables share two keys a place: each is looked up once, and its vote counts the tables
in which the walks of both sides end there.

Equal keys are votes for an item at a place. ``votes`` gives the tables that an item of n tokens uses, more for a short one, and
the votes that it asks for: the most that still reach ``RECALL`` when a share ``CHANGED`` x ``max_distance`` of the tokens is changed, each at random. Votes are
counted in a band of character diagonals that is as wide as the allowed edits can shift them. An item too short
for walks to reach the recall has each of its tokens as a key; one of up to five doesn't reach it by tokens either and asks for one, or two of three.
What is found is verified: the edit distance in characters between the whole item and its best place in
the band is at most ``max_distance`` of the item's length.

Items are read in blocks of at most ``BLOCK`` rows; a block's texts and keys are broadcast, which bounds what a task
holds whatever the number of items. Votes are counted in parts of about ``HITS``.

Defined cases: null and empty texts, and items without letters or digits, match nothing; repeated documents and
items give a row each; empty tables give no rows; other columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vitalstrand.llm.common import mix
from vitalstrand.llm.encoding import groups
from vitalstrand.session import stage

#: Two moves; ``walk_ends`` is written out for them.
STEPS = 3
#: Tables in use by length: the first entry at which one shared pair of tokens isn't enough, else the last.
TABLES = (2, 4, 6, 8)
MAX_DISTANCE = 0.2
#: Chance to find an item, and the share of its tokens that may be changed for it, as a multiple of the accepted distance:
#: a changed token costs half of its letters or more.
RECALL, CHANGED = 0.99, 2.0
#: Votes expanded at once.
HITS = 1_000_000
BLOCK = 20_000
#: Bytes of documents walked together: their arrays stay in a core's cache.
GROUP_BYTES = 256 << 10
FILTER_BITS = 20
PIECE = re.compile(r"\S+")
BARE = re.compile(r"[\W_]+")
OUT = "doc_id long, item_id long, start long, end long, distance long, similarity double"


@lru_cache(maxsize=1 << 15)
def token(piece: str) -> str:
    """Letters and digits of a piece between white space, in lower case; may be empty."""
    bare = piece.strip(".,")
    return bare.lower() if bare.isalnum() else BARE.sub("", piece.lower())


def tokens(text: str | None) -> list[str]:
    """Non-empty tokens of a text."""
    return [t for t in map(token, text.split()) if t] if text else []


@lru_cache(maxsize=1)
def spelling() -> tuple[np.ndarray, np.ndarray]:
    """By code point below 2^16, the letter in lower case and its kind; odd ones have no letter of their own in lower case, or stand for all others."""
    lower, kind = np.arange(1 << 16, dtype=np.uint32), np.zeros(1 << 16, dtype=np.uint8)
    for code in range(len(kind)):
        sign = chr(code)
        small = sign.lower()
        if sign.isspace():
            kind[code] = SPACE
        elif len(small) != 1 or sign.isalnum() != small.isalnum() or sign == "\u03a3":
            kind[code] = ODD
        elif sign.isalnum():
            kind[code], lower[code] = WORD, ord(small)
    kind[-1] = ODD
    return lower, kind


SPACE, WORD, ODD = 1, 2, 3


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def kinds(codes: np.ndarray) -> np.ndarray:
    return spelling()[1][np.minimum(codes, len(spelling()[1]) - 1)]


class Words:
    """Tokens of some texts: their hashes, with the length in the low bits, and the texts of the tokens, a space before each and at the end.

    A hash is a polynomial of the code points, so all tokens are hashed at once. Texts with letters that ``spelling`` can't tell go through ``tokens``.
    """

    def __init__(self, texts: list[str | None]):
        joined = "\n".join(t or "" for t in texts)
        codes = code_points(joined)
        kind = kinds(codes)
        ends = np.cumsum([len(t or "") + 1 for t in texts]) - 1
        if len(odd := np.flatnonzero(kind == ODD)):
            texts = list(texts)
            for k in np.unique(np.searchsorted(ends, odd)).tolist():
                texts[k] = " ".join(tokens(texts[k]))
            codes = code_points("\n".join(t or "" for t in texts))
            kind = kinds(codes)
            kind[kind == ODD] = WORD
            ends = np.cumsum([len(t or "") + 1 for t in texts]) - 1
        keep = np.flatnonzero(kind == WORD)
        piece = np.cumsum(kind == SPACE)[keep]
        letters = codes[keep]
        small = letters < 1 << 16
        letters = spelling()[0][letters] if small.all() else np.where(small, spelling()[0][np.where(small, letters, 0)], letters)
        first = np.flatnonzero(np.append(True, piece[1:] != piece[:-1])) if len(keep) else keep
        size = np.diff(np.append(first, len(letters)))
        self.until = np.searchsorted(keep[first], np.append(0, ends))  # tokens before each text, and all
        self.hashes = self._hash(letters, first, size)
        # where each token begins in its own text of tokens
        number = np.arange(len(first))
        spelt = np.full(len(letters) + len(first) + 1, 0x20, dtype=np.uint32)
        spelt[np.arange(len(letters)) + np.repeat(number, size) + 1] = letters
        self.spelt = spelt.tobytes().decode("utf-32-le", "surrogatepass")
        self.base = np.append(first + number, len(spelt) - 1)[self.until]
        self.doc = np.repeat(np.arange(len(texts)), np.diff(self.until))
        self.begins = first + number + 1 - self.base[self.doc]

    @staticmethod
    def _hash(letters: np.ndarray, first: np.ndarray, size: np.ndarray) -> np.ndarray:
        if not len(first):
            return np.empty(0, dtype=np.uint64)
        with np.errstate(over="ignore"):
            power = np.multiply.accumulate(np.full(int(size.max()), SEEDS[0] | np.uint64(1)))
            value = mix(letters.astype(np.uint64) + SEEDS[1]) * power[np.arange(len(letters)) - np.repeat(first, size)]
            hashes = mix(np.add.reduceat(value, first))
        return hashes & ~np.uint64(LENGTH) | np.minimum(size, LENGTH).astype(np.uint64)

    def padded(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Hashes, text and begin of the tokens, with ``PAD`` after each text."""
        n = len(self.until) - 1
        at = np.arange(len(self.doc)) + STEPS * self.doc
        doc = np.repeat(np.arange(n), np.diff(self.until) + STEPS)
        begins = np.zeros(len(doc), dtype=np.int64)
        begins[at] = self.begins
        hashes = np.empty(len(doc), dtype=np.uint64)
        hashes[(self.until[1:] + STEPS * np.arange(n))[:, None] + np.arange(STEPS)] = PAD
        hashes[at] = self.hashes
        return hashes, doc, begins

    def text(self, k: int) -> str:
        return self.spelt[self.base[k] : self.base[k + 1] + 1]


#: Bits of a token's hash that hold its length.
LENGTH = (1 << 20) - 1
#: Places from a walk's first token to its last; 0 stands for the keys of one token.
GAPS = (0, 1, 2)
#: Keys of one token, and keys of a walk's first and last token, however far apart.
SEEDS = [np.uint64(0x9E3779B97F4A7C15 * (k + 1) & (2**64 - 1)) for k in range(2)]
_PATTERN = np.arange(1 << STEPS * (TABLES[-1] // 2))


def _leaves(step: int) -> np.ndarray:
    """By the walk bits of a token, the tables (as bits) whose walk leaves it at this step; the second of a pair where the first stays."""
    out = np.zeros(len(_PATTERN), dtype=np.uint8)
    for table in range(TABLES[-1]):
        bit = (_PATTERN >> STEPS * (table // 2) + step & 1) ^ (table % 2)
        out |= (bit << table).astype(np.uint8)
    return out


FIRST, SECOND = _leaves(0), _leaves(1)
TABLE_COUNT = np.array([bin(k).count("1") for k in range(256)], dtype=np.int64)


def walk_ends(hashes: np.ndarray, n: int) -> list[np.ndarray]:
    """For each gap the tables (as bits) in which the walk from each of the first ``n`` places ends that far on.

    ``hashes`` must reach ``STEPS`` places beyond the last start.
    """
    bits = (hashes[: n + 1] >> np.uint64(32)).astype(np.int64) & (len(_PATTERN) - 1)
    first, second = FIRST[bits[:n]], SECOND[bits]
    return [np.ones(n, dtype=np.uint8), first & ~second[1:] | ~first & second[:n], first & second[1:]]


def walk_keys(hashes: np.ndarray, n: int, gap: int) -> np.ndarray:
    """Key of each of the first ``n`` places by its token and the one ``gap`` places on."""
    with np.errstate(over="ignore"):
        key = (SEEDS[min(gap, 1)] + hashes[:n]) * np.uint64(0x9E3779B97F4A7C15)
        return (key + hashes[gap : n + gap]) * np.uint64(0x9E3779B97F4A7C15) if gap else key


@lru_cache(maxsize=4096)
def vote_counts(changed: float, n_tokens: int, tables: int) -> np.ndarray:
    """Sorted keys that ``n_tokens`` random tokens keep in 4,000 trials with this share of tokens changed at random."""
    rng = np.random.Generator(np.random.PCG64(n_tokens))
    trials, n = 4000, n_tokens
    same = np.pad(rng.random((trials, n)) >= changed, ((0, 0), (0, STEPS)))
    kept = np.zeros(trials, dtype=np.int64)
    rows = np.arange(trials)[:, None]
    start = np.arange(n)
    for table in range(tables):
        if table % 2 == 0:
            item_bits = rng.random((STEPS, trials, n + STEPS)) < 0.5
            doc_bits = np.where(same, item_bits, rng.random(item_bits.shape) < 0.5)
        at, by = np.tile(start, (trials, 1)), np.tile(start, (trials, 1))
        for step in range(STEPS - 1):
            at += item_bits[step][rows, at] != bool(table % 2)
            by += doc_bits[step][rows, by] != bool(table % 2)
        kept += (same[:, :n] & (at == by) & same[rows, at] & (at > start) & (at < n)).sum(axis=1)
    return np.sort(kept)


def recall(changed: float, n_tokens: int) -> float:
    """Chance that a passage of ``n_tokens`` with this share of tokens changed at random keeps the votes it needs."""
    tables, needed = votes(n_tokens)
    if not tables:
        return sum(math.comb(n_tokens, k) * (1 - changed) ** k * changed ** (n_tokens - k) for k in range(needed, n_tokens + 1))
    return float((vote_counts(changed, min(n_tokens, 256), tables) >= needed).mean())


def votes(n_tokens: int, max_distance: float = MAX_DISTANCE) -> tuple[int, int]:
    """Tables and most votes that reach ``RECALL``; 0 tables for keys of one token. Over 256 tokens ask for no more than 256."""
    changed = min(1.0, CHANGED * max_distance)
    for tables in TABLES:
        kept = vote_counts(changed, min(n_tokens, 256), tables)
        needed = int(kept[int((1 - RECALL) * len(kept))])
        if needed > tables:
            break
    if needed:
        return tables, needed
    kept, below = 0, 0.0
    while below + (p := math.comb(n_tokens, kept) * (1 - changed) ** kept * changed ** (n_tokens - kept)) <= 1 - RECALL:
        kept, below = kept + 1, below + p
    return 0, kept or (1 if n_tokens > 3 else -(-n_tokens // 2))


def edit_distance_within(pattern: str, text: str, most: int | None = None) -> tuple[int, int]:
    """Least edits from ``pattern`` to a substring of ``text`` and the end of the first such, bit-parallel.

    With ``most``, reading ends as soon as no more than that many edits can't be reached, and what is returned is above it.
    """
    m = len(pattern)
    masks: dict[str, int] = defaultdict(int)
    for i, c in enumerate(pattern):
        masks[c] |= 1 << i
    full, top = (1 << m) - 1, 1 << (m - 1)
    up, down, score = full, 0, m
    best, end = m, 0
    # A place of the text lowers the score by one at most.
    spare = len(text) - 1 + (m + len(text) if most is None else most)
    for j, c in enumerate(text):
        eq = masks.get(c, 0)
        d0 = (((eq & up) + up) ^ up) | eq | down
        right_up, right_down = down | (~(d0 | up) & full), up & d0
        if right_up & top:
            score += 1
        elif right_down & top:
            score -= 1
        # Row 0 is free: a match may begin anywhere.
        right_up, right_down = (right_up << 1) & full, (right_down << 1) & full
        up, down = right_down | (~(d0 | right_up) & full), right_up & d0
        if score < best:
            best, end = score, j + 1
        if score + j > spare and best > most:
            break
    return best, end


@dataclass
class Items:
    """A block of items: normalised texts, and sorted keys of one and of two tokens with the item, character offset and tables they stand for."""

    ids: list[int]
    texts: list[str]
    edits: np.ndarray
    votes: np.ndarray
    keys: list[np.ndarray] = field(default_factory=list)
    item: list[np.ndarray] = field(default_factory=list)
    offset: list[np.ndarray] = field(default_factory=list)
    tables: list[np.ndarray] = field(default_factory=list)
    seen: list[np.ndarray] = field(default_factory=list)

    @classmethod
    def build(cls, rows: list[tuple[int, str]], max_distance: float = MAX_DISTANCE) -> Items:
        ids, texts, needed = [], [], []
        found = [([], [], [], []) for _ in SEEDS]
        for item_id, text in rows:
            words = Words([text])
            n_words = len(words.hashes)
            if not n_words:
                continue
            number, own = len(ids), words.hashes
            ids.append(item_id)
            tables, n = votes(n_words, max_distance)
            needed.append(n)
            texts.append(words.text(0)[1:-1])
            begins = words.begins - 1
            h = np.concatenate([own, PAD])
            starts = np.arange(n_words)
            ends = walk_ends(h, n_words)
            for gap in GAPS[1:] if tables else GAPS[:1]:
                mask = ends[gap] & np.uint8((1 << max(tables, 1)) - 1)
                good = (mask > 0) & (starts + gap < n_words)
                values = (walk_keys(h, n_words, gap)[good], np.full(int(good.sum()), number), begins[good], mask[good])
                for group, part in zip(found[min(gap, 1)], values, strict=True):
                    group.append(part)
        out = cls(ids, texts, np.array([int(max_distance * len(t)) for t in texts], dtype=np.int64), np.array(needed, dtype=np.int64))
        for group in found:
            key, item, offset, mask = (np.concatenate(g) if g else np.zeros(0, np.int64) for g in group)
            key = key.astype(np.uint64)
            order = np.argsort(key, kind="stable")
            seen = np.zeros(1 << FILTER_BITS, dtype=bool)
            seen[(key >> np.uint64(64 - FILTER_BITS)).astype(np.int64)] = True
            out.keys.append(key[order])
            out.item.append(item[order])
            out.offset.append(offset[order])
            out.tables.append(mask[order].astype(np.uint8))
            out.seen.append(seen)
        return out


PAD = (np.arange(STEPS, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93) + np.uint64(1 << 20)) & ~np.uint64(LENGTH)


def _counted(doc: np.ndarray, number: np.ndarray, band: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, ...]:
    """Sums of ``n`` by (doc, number, band)."""
    if not len(n):
        return doc, number, band, n
    order = np.lexsort((band, number, doc))
    doc, number, band = doc[order], number[order], band[order]
    first = np.flatnonzero(np.append(True, (doc[1:] != doc[:-1]) | (number[1:] != number[:-1]) | (band[1:] != band[:-1])))
    return doc[first], number[first], band[first], np.add.reduceat(n[order], first)


def candidates(hashes: np.ndarray, doc: np.ndarray, begins: np.ndarray, items: Items) -> dict[int, list[tuple[int, int, int]]]:
    """(item number, least and most diagonal) by document, of the bands where an item has the votes it needs.

    ``hashes`` are the padded tokens of some documents, ``doc`` and ``begins`` their document and place. A diagonal is the place at
    which the item would begin; band b of an item with d edits has diagonals b (d + 1) to (b + 2) (d + 1), so that diagonals at
    most d apart share a band.
    """
    sums: list[tuple[np.ndarray, ...]] = []
    n_places = len(hashes) - STEPS
    ends = walk_ends(hashes, n_places)
    for gap in GAPS:
        kind = min(gap, 1)
        if not len(items.keys[kind]):
            continue
        key = walk_keys(hashes, n_places, gap)
        hit = np.flatnonzero(items.seen[kind][(key >> np.uint64(64 - FILTER_BITS)).astype(np.int64)])
        hit = hit[(ends[gap][hit] > 0) & (doc[hit + gap] == doc[hit]) & (begins[hit + gap] > 0)]
        low = np.searchsorted(items.keys[kind], key[hit], side="left")
        size = np.searchsorted(items.keys[kind], key[hit], side="right") - low
        hit, low, size = hit[size > 0], low[size > 0], size[size > 0]
        part = np.cumsum(size) // HITS
        for lo, hi in zip(*(np.searchsorted(part, np.unique(part), side=s) for s in ("left", "right")), strict=True):
            n, place = size[lo:hi], hit[lo:hi]
            source = np.repeat(low[lo:hi] - np.cumsum(n) + n, n) + np.arange(n.sum())
            count = TABLE_COUNT[items.tables[kind][source] & np.repeat(ends[gap][place], n)]
            number = items.item[kind][source]
            band = (np.repeat(begins[place], n) - items.offset[kind][source]) // (items.edits[number] + 1)
            sums.append(_counted(*(x[count > 0] for x in (np.repeat(doc[place], n), number, band, count))))
    if not sum(len(x[0]) for x in sums):
        return {}
    of, number, band, n = _counted(*(np.concatenate(x) for x in zip(*sums, strict=True)))
    # A band is two neighbouring cells.
    next_ = np.append((of[1:] == of[:-1]) & (number[1:] == number[:-1]) & (band[1:] == band[:-1] + 1), False)
    both = n + np.where(next_, np.append(n[1:], 0), 0)
    out: dict[int, list[tuple[int, int, int]]] = defaultdict(list)
    for k in np.flatnonzero(both >= items.votes[number]).tolist():
        d = int(items.edits[number[k]]) + 1
        out[int(of[k])].append((int(number[k]), int(band[k]) * d, (int(band[k]) + 2) * d))
    return out


#: Bits of a gram's hash.
GRAM_BITS = 15


def grams(codes: np.ndarray, size: int) -> np.ndarray:
    """Hashes of the runs of ``size`` code points; equal runs have equal ones."""
    n = max(0, len(codes) - size + 1)
    h = codes[:n].astype(np.uint32)
    for k in range(1, size):
        h = h * np.uint32(0x9E3779B1) + codes[k : k + n]
    return (h * np.uint32(0x85EBCA6B) >> np.uint32(32 - GRAM_BITS)).astype(np.int64)


def runs_of(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the runs of 3 and of 4 letters of a text."""
    codes = code_points(text)
    return grams(codes, 3), grams(codes, 4)


@lru_cache(maxsize=4096)
def pieces(pattern: str) -> tuple[np.ndarray, np.ndarray]:
    return runs_of(pattern)


def may_hold(window: str, pattern: str, d: int, runs: tuple[np.ndarray, np.ndarray] | None = None) -> bool:
    """False if ``pattern`` can't be within ``d`` edits of a part of ``window``: an edit spoils one of disjoint pieces at most.

    ``runs`` are those of ``window`` where they are known.
    """
    for size, own, there in zip((3, 4), pieces(pattern), runs or runs_of(window), strict=True):
        missing = np.ones(1 << GRAM_BITS, dtype=bool)
        missing[there] = False
        spoiled = missing[own]
        for phase in range(size):
            if np.count_nonzero(spoiled[phase::size]) > d:
                return False
    return True


def may_begin(window: str, pattern: str, d: int, runs: tuple[np.ndarray, np.ndarray] | None = None) -> bool:
    """False if no part of ``window`` is within ``d`` edits of ``pattern`` wherever it begins: pieces without an edit move by ``d`` at most."""
    n = len(window) - len(pattern) + d + 1
    if n <= 0:
        return False
    own, there = pieces(pattern)[0][::3], (runs or runs_of(window))[0]
    if not len(own):
        return True
    piece, place = np.nonzero(own[:, None] == there)
    # a piece at a place allows the begins from first to before last; those of one piece don't count twice
    first, last = place - 3 * piece - d, place - 3 * piece + d + 1
    again = piece[1:] == piece[:-1]
    first[1:][again] = np.maximum(first[1:], last[:-1])[again]
    steps = np.bincount(first.clip(0, n), minlength=n + 1) - np.bincount(last.clip(0, n), minlength=n + 1)
    return bool(steps[:n].cumsum().max() >= len(own) - d)


def verify(
    text: str, spelt: str, begins: np.ndarray, found: list[tuple[int, int, int]], items: Items
) -> Iterator[tuple[int, int, int, int, float]]:
    """(item number, start, end, distance, similarity) of the items that are in ``text`` at some found place.

    ``found`` has (item number, least and most place at which it would begin in the text of the tokens ``spelt``, one space between and
    around), ``begins`` the place of each token there. Best place of each item only.
    """
    three, four = runs_of(spelt)
    best: dict[int, tuple[int, int, int]] = {}
    done: dict[int, int] = {}
    for number, least, most in sorted(found):
        pattern, d = items.texts[number], int(items.edits[number])
        # Windows of one item come by their beginning; what the last one covered is not read again.
        lo, hi = max(least - d, done.get(number, 0) - len(pattern) - d), most + len(pattern) + d
        if hi <= done.get(number, 0):
            continue
        done[number] = hi
        a = max(0, int(begins.searchsorted(lo, side="right")) - 1)
        b = int(begins.searchsorted(hi, side="left"))
        left, right = int(begins[a]) - 1, int(begins[b]) if b < len(begins) else len(spelt)
        window, runs = spelt[left:right], (three[left : max(left, right - 2)], four[left : max(left, right - 3)])
        if not may_hold(window, pattern, d, runs) or not may_begin(window, pattern, d, runs):
            continue
        distance, end = edit_distance_within(pattern, window, d)
        if distance <= d and (number not in best or distance < best[number][0]):
            _, length = edit_distance_within(pattern[::-1], window[:end][::-1])
            inside = window[end - length : end]
            begin, stop = end - len(inside.lstrip()), end - length + len(inside.rstrip())
            # Word k ends before ends[k], its space.
            ends = np.append(begins[a + 1 : b], begins[a] - 1 + len(window)) - begins[a]
            first = min(int(np.searchsorted(ends, begin, side="right")), len(ends) - 1)
            last = min(int(np.searchsorted(ends, stop, side="left")), len(ends) - 1)
            best[number] = (distance, a + first, a + max(first, last))
    if best:
        spans = [m.span() for m in PIECE.finditer(text) if token(m[0])]
        for number, (distance, first, last) in best.items():
            yield number, spans[first][0], spans[last][1], distance, 1 - distance / len(items.texts[number])


def find_items(docs: DataFrame, rows: list[tuple[int, str]], max_distance: float = MAX_DISTANCE) -> DataFrame:
    """Matches of one block of items in every row of ``docs`` (doc_id, text)."""
    shared = docs.sparkSession.sparkContext.broadcast(Items.build(rows, max_distance))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items = shared.value
        for batch in batches:
            sizes = pc.binary_length(batch.column(1).fill_null("")).to_numpy(zero_copy_only=False)
            for lo, hi in groups(sizes, GROUP_BYTES):
                part = batch.slice(lo, hi - lo)
                texts = part.column(1).to_pylist()
                words = Words(texts)
                found = candidates(*words.padded(), items)
                ids = part.column(0).to_pylist()
                out = []
                for d in sorted(found):
                    begins = words.begins[words.until[d] : words.until[d + 1]]
                    out += [(ids[d], items.ids[n], *rest) for n, *rest in verify(texts[d], words.text(d), begins, found[d], items)]
                columns = list(zip(*out, strict=True)) or [[]] * 6
                types = [pa.int64()] * 5 + [pa.float64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=["doc_id", "item_id", "start", "end", "distance", "similarity"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, OUT)


def contaminated(docs: DataFrame, benchmark: DataFrame, max_distance: float = MAX_DISTANCE, block: int = BLOCK) -> DataFrame:
    """doc_id, item_id, start, end, distance, similarity of every item found in a document."""
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).filter("text is not null")
    blocks = max(1, -(-items.count() // block))
    out = None
    for k in range(blocks):
        part = items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == k) if blocks > 1 else items
        rows = [(r["item_id"], r["text"]) for r in part.toLocalIterator()]
        found = find_items(docs, rows, max_distance)
        out = found if out is None else out.unionByName(found)
    return out


def decontaminate(docs: DataFrame, benchmark: DataFrame, max_distance: float = MAX_DISTANCE) -> DataFrame:
    """Rows of ``docs`` in which no item is found; null ids stay."""
    bad = stage(contaminated(docs, benchmark, max_distance).select("doc_id").distinct(), "contaminated")
    return docs.join(bad, "doc_id", "left_anti")
