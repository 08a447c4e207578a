"""Byte-pair encoding of many words at once, from a tokenizer file whose path is a parameter.

Two kinds of vocabulary are read: byte-level BPE with GPT-style splitting, and BPE whose last
symbol of a word is marked. Merging runs over all distinct words of a batch together: each round
finds every word's pair of lowest rank and merges all of its places, as BPE prescribes.
"""

from __future__ import annotations

import json
import re
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache, cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from crawlvis.llm.scan import SCAN_POINTS, ranges, scans

NEVER = np.iinfo(np.int64).max


def byte_names() -> list[str]:
    """The printable stand-in of each byte in byte-level vocabularies."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = iter(range(0x100, 0x200))
    names = {b: chr(b) for b in shown}
    return [names[b] if b in names else chr(next(hidden)) for b in range(256)]


@cache
def _normalizer():
    """The library's own normalizer, for its version of Unicode."""
    from tokenizers import Regex
    from tokenizers.normalizers import NFC, Lowercase, Replace, Sequence

    return Sequence([NFC(), Replace(Regex(r"\s+"), " "), Lowercase()])


@dataclass
class Vocabulary:
    """Symbols and merges of a tokenizer, in arrays of a size that the file bounds, fit to be broadcast."""

    first: np.ndarray  # the id of each byte
    last: np.ndarray  # the id of each byte at a word's end
    pairs: np.ndarray  # merge keys, sorted: left id * 2**32 + right id
    rank: np.ndarray
    made: np.ndarray
    tokens: list[str]
    special: dict[str, int]
    marked: bool  # whether word ends are marked

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k not in ("widths", "made_by", "order", "base", "_special_pattern")}

    @classmethod
    def read(cls, path: str) -> Vocabulary:
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model, names = spec["model"], byte_names()
        vocab, end = model["vocab"], model["end_of_word_suffix"] or ""
        merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        prefix = model["continuing_subword_prefix"] or ""
        if prefix or model.get("unk_token") or model.get("ignore_merges"):
            raise ValueError("this kind of vocabulary is not supported")
        keys = np.array([vocab[a] << 32 | vocab[b] for a, b in merges], dtype=np.uint64)
        made = np.array([vocab[a + b] for a, b in merges], dtype=np.int64)
        order = np.argsort(keys)
        special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        tokens = [""] * (max([*vocab.values(), *special.values()]) + 1)
        for token, i in [*vocab.items(), *special.items()]:
            tokens[i] = token
        return cls(
            np.array([vocab[n] for n in names]), np.array([vocab[n + end] for n in names]),
            keys[order], order.astype(np.int64), made[order], tokens, special, bool(end),
        )

    @cached_property
    def widths(self) -> np.ndarray:
        """Bytes that each token covers."""
        special = set(self.special.values())
        cut = len("</w>") if self.marked else 0
        return np.array(
            [len(t.encode()) if i in special else len(t[:-cut] if cut and t.endswith("</w>") else t) for i, t in enumerate(self.tokens)],
            dtype=np.int64,
        )

    @cached_property
    def made_by(self) -> np.ndarray:
        """The symbol that the merge of each rank makes."""
        out = np.zeros(len(self.rank), dtype=np.int64)
        out[self.rank] = self.made
        return out

    @cached_property
    def order(self) -> np.ndarray:
        """The place of a byte's symbol in ``base``; other symbols are never asked for."""
        out = np.zeros(len(self.tokens), dtype=np.int64)
        out[self.first] = np.arange(256)
        out[self.last] = np.arange(256) + (256 if self.marked else 0)
        return out

    @cached_property
    def base(self) -> np.ndarray:
        """Ranks of the pairs of single bytes."""
        symbols = np.concatenate((self.first, self.last)) if self.marked else self.first
        n = len(symbols)
        return self.ranks(np.repeat(symbols, n), np.tile(symbols, n)).reshape(n, n)

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        keys = left.astype(np.uint64) << np.uint64(32) | right.astype(np.uint64)
        at = np.minimum(np.searchsorted(self.pairs, keys), len(self.pairs) - 1)
        return np.where(self.pairs[at] == keys, self.rank[at], NEVER)

    def merge(self, words: pa.StringArray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of distinct words end to end, and how many each word has."""
        n = len(words)
        if not n:
            return np.zeros(0, dtype=np.uint32), np.zeros(0, dtype=np.int64)
        offsets = np.frombuffer(words.buffers()[1], dtype=np.int32)[words.offset : words.offset + n + 1].astype(np.int64)
        data = words.buffers()[2]
        raw = np.frombuffer(data, dtype=np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, dtype=np.uint8)
        count = np.diff(offsets)
        symbols = self.first[raw].astype(np.int64)
        ends = np.cumsum(count)
        full = count > 0
        symbols[ends[full] - 1] = self.last[raw[ends[full] - 1]]
        live = np.flatnonzero(count > 1)
        done: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []  # words, counts, symbols
        single = np.flatnonzero(count == 1)
        starts = ends - count
        done.append((single, count[single], symbols[starts[single]]))
        symbols, count = symbols[ranges(starts[live], count[live])], count[live]
        owner = np.repeat(np.arange(len(live)), count)
        left, right = symbols[:-1], symbols[1:]
        rank = np.append(self.base[self.order[left], self.order[right]], NEVER) if len(symbols) else np.zeros(0, dtype=np.int64)
        rank[np.cumsum(count) - 1] = NEVER
        while len(live):
            starts = np.cumsum(count) - count
            best = np.minimum.reduceat(rank, starts)
            over = best == NEVER
            if over.any():
                gone = over[owner]
                done.append((live[over], count[over], symbols[gone]))
                keep = ~gone
                symbols, rank, live, count, best = symbols[keep], rank[keep], live[~over], count[~over], best[~over]
                owner = np.repeat(np.arange(len(live)), count)
                if not len(live):
                    break
            place = np.flatnonzero(rank == best[owner])
            # In a row of overlapping places every second one merges, from the left.
            fresh = np.concatenate(([True], np.diff(place) > 1))
            if not fresh.all():
                row_start = np.maximum.accumulate(np.where(fresh, np.arange(len(place)), 0))
                place = place[(np.arange(len(place)) - row_start) % 2 == 0]
            symbols[place] = self.made_by[rank[place]]
            keep = np.ones(len(symbols), dtype=bool)
            keep[place + 1] = False
            rank[place] = rank[place + 1]  # NEVER where the word now ends
            count = count - np.bincount(owner[place], minlength=len(live))
            place -= np.arange(len(place))
            symbols, owner, rank = symbols[keep], owner[keep], rank[keep]
            last = np.append(owner[1:] != owner[:-1], True)
            again = np.concatenate((place, place[place > 0] - 1))
            again = again[~last[again]]
            rank[again] = self.ranks(symbols[again], symbols[again + 1])
            rank[place[last[place]]] = NEVER
        which = np.concatenate([d[0] for d in done])
        lengths = np.zeros(n, dtype=np.int64)
        lengths[which] = np.concatenate([d[1] for d in done])
        flat, begin = np.concatenate([d[2] for d in done]), np.concatenate(([0], np.cumsum(lengths)))
        result = np.zeros(begin[-1], dtype=np.uint32)
        result[ranges(begin[which], lengths[which])] = flat
        return result, lengths

    def encode_words(self, words: pa.StringArray, lexicon=None) -> tuple[np.ndarray, np.ndarray]:
        """As ``merge``, after looking words up in ``lexicon``."""
        n = len(words)
        lengths, parts = np.zeros(n, dtype=np.int64), []
        rest = np.arange(n)
        if lexicon is not None:
            found = lexicon.find(words)
            seen = np.flatnonzero(found >= 0)
            ids, count = lexicon.outputs(found[seen])
            lengths[seen] = count
            parts.append((seen, ids))
            rest = np.flatnonzero(found < 0)
        if len(rest):
            ids, count = self.merge(words if lexicon is None else words.take(pa.array(rest)))
            lengths[rest] = count
            parts.append((rest, ids))
        begin = np.concatenate(([0], np.cumsum(lengths)))
        result = np.zeros(begin[-1], dtype=np.uint32)
        for which, ids in parts:
            result[ranges(begin[which], lengths[which])] = ids
        return result, lengths

    def encode(self, texts: list[str], lexicon=None, limit: int = SCAN_POINTS) -> Iterator[Encoded]:
        """The ids of whole texts, some texts at a time. A special token's own string in a text gives its id."""
        for begin, end, scan in scans(texts, limit):
            cuts = scan.word_end_cuts() if self.marked else scan.byte_level_cuts()
            pieces = scan.strings(cuts).dictionary_encode()
            ids, count = self.encode_words(self._silent_space(pieces.dictionary), lexicon)
            codes = pieces.indices.to_numpy()
            first, lengths = np.concatenate(([0], np.cumsum(count)))[:-1], count[codes]
            flat = ids[ranges(first[codes], lengths)]
            ends = np.concatenate(([0], np.cumsum(lengths)))
            yield Encoded(begin, end, flat, ends[scan.owners(cuts[:-1])])

    def _silent_space(self, words: pa.StringArray) -> pa.StringArray:
        """Where word ends are marked, white space between words has no ids."""
        if not self.marked:
            return words
        blank = pc.match_substring_regex(words, "^[\\t-\\r \\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}]")
        return pc.if_else(blank, "", words)

    def normalized(self, text: str) -> str:
        """The text as this kind of vocabulary sees it: composed and in lower case where word ends are marked."""
        if not self.marked:
            return text
        if text.isascii():
            return text.lower()
        if max(text) < "\u0300":
            return unicodedata.normalize("NFC", text).lower()
        return _normalizer().normalize_str(text)

    def encode_all(self, texts: list[str], lexicon=None) -> Iterator[np.ndarray]:
        """The ids of each text in turn."""
        parts, special = [], []
        for text in texts:
            split = self._special_pattern.split(text) if self.special else [text]
            parts += [self.normalized(p) for p in split[::2]]
            special.append([self.special[s] for s in split[1::2]])
        at, held = 0, []
        for some in self.encode(parts, lexicon):
            for k in range(some.end - some.begin):
                held.append(some.ids[some.ends[k] : some.ends[k + 1]])
                if len(held) == len(special[at]) + 1:
                    if len(held) > 1:
                        marks = [np.array([s], dtype=np.uint32) for s in special[at]]
                        held = [np.concatenate([x for pair in zip(held, [*marks, held[0][:0]], strict=True) for x in pair])]
                    yield held[0]
                    at, held = at + 1, []

    @cached_property
    def _special_pattern(self) -> re.Pattern:
        return re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")")


@dataclass
class Encoded:
    """Ids of the texts ``begin`` to ``end`` of a list; text k has those from ``ends[k]`` to ``ends[k + 1]``."""

    begin: int
    end: int
    ids: np.ndarray
    ends: np.ndarray
