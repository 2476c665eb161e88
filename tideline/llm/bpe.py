"""Token ids of a public word-level BPE vocabulary, through a table of words already seen."""

from __future__ import annotations

import re
import unicodedata

import numpy as np
import regex
from tokenizers import Tokenizer, pre_tokenizers

from tideline.llm.words import Words

SLOTS = 1 << 20
MOST_ENTRIES = 500_000
PROBES = 4
END = 0  # the id that closes a document

# Fixed values of the vocabulary file: its split pattern and its two special tokens.
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
SPECIAL = r"<\|startoftext\|>|<\|endoftext\|>"

_SPLIT = regex.compile(PIECES + r"|\n")
_UNUSUAL = re.compile(SPECIAL + "|[\x00\x1c-\x1fɐ-\U0010ffff]")


def _byte_characters() -> list[str]:
    """The printable characters by which byte-level vocabularies write the 256 bytes."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = iter(range(256, 512))
    return [chr(b) if b in own else chr(next(other)) for b in range(256)]


class WordIds:
    """Ids of words, each encoded once while it stays in a table of bounded size.

    The vocabulary drops white space, so a text's ids are those of its words in turn.
    Ordinary words (Latin letters, digits, signs) are normalised and split here and
    only merged by the library; all others go through the whole tokenizer.
    """

    def __init__(self, path: str):
        self.whole = Tokenizer.from_file(path)
        self.merges = Tokenizer(self.whole.model)
        self.merges.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
        self.closes = np.zeros(self.whole.get_vocab_size(), bool)
        for token, i in self.whole.get_vocab(with_added_tokens=False).items():
            self.closes[i] = token.endswith("</w>")
        self.bytes = {b: c for b, c in enumerate(_byte_characters()) if b != 32}
        self._clear()

    def _clear(self) -> None:
        self.keys = np.zeros(SLOTS, np.uint64)
        self.entries = np.zeros(SLOTS, np.int32)
        self.flat = np.zeros(MOST_ENTRIES * 4, np.uint32)
        self.used = 1  # flat[0] is the closing id
        self.starts = np.zeros(MOST_ENTRIES + 1, np.int64)
        self.lengths = np.zeros(MOST_ENTRIES + 1, np.int64)
        self.starts[0], self.lengths[0], self.flat[0] = 0, 1, END
        self.count = 1

    def encode_new(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all words in turn, ids per word)."""
        usual = [w for w in words if not _UNUSUAL.search(w)]
        text = unicodedata.normalize("NFC", "\n".join(usual)).lower() + "\n"
        pieces = _SPLIT.findall(text) if usual else []
        breaks = np.array([p == "\n" for p in pieces], bool)
        joined = " ".join(p for p in pieces if p != "\n").encode().decode("latin-1").translate(self.bytes)
        ids = self.merges.encode_batch_fast([joined], add_special_tokens=False)[0].ids if joined else []
        ids = np.array(ids, np.uint32)
        ends = np.concatenate([[0], np.flatnonzero(self.closes[ids]) + 1])
        at = ends[np.concatenate([[0], np.cumsum(~breaks)[breaks]])] if usual else np.zeros(1, np.int64)
        if len(usual) == len(words):
            return ids, np.diff(at)
        odd = {w: self.whole.encode(w, add_special_tokens=False).ids for w in words if _UNUSUAL.search(w)}
        parts, i = [], 0
        for w in words:
            if w in odd:
                parts.append(np.array(odd[w], np.uint32))
            else:
                parts.append(ids[at[i] : at[i + 1]])
                i += 1
        return np.concatenate(parts), np.array([len(p) for p in parts], np.int64)

    def _find(self, hashes: np.ndarray) -> np.ndarray:
        """Entry of each word, 0 where it has none."""
        slot = (hashes & np.uint64(SLOTS - 1)).astype(np.int64)
        found = np.where(self.keys[slot] == hashes, self.entries[slot], 0)
        for probe in range(1, PROBES):
            open_ = np.flatnonzero(found == 0)
            if not len(open_):
                break
            s = (slot[open_] + probe) & (SLOTS - 1)
            found[open_] = np.where(self.keys[s] == hashes[open_], self.entries[s], 0)
        return found

    def _place(self, hashes: np.ndarray, entries: np.ndarray) -> None:
        slot = (hashes & np.uint64(SLOTS - 1)).astype(np.int64)
        for probe in range(PROBES):
            s = (slot + probe) & (SLOTS - 1)
            free = np.flatnonzero(self.entries[s] == 0)
            _, one = np.unique(s[free], return_index=True)
            taken = free[one]
            self.keys[s[taken]], self.entries[s[taken]] = hashes[taken], entries[taken]
            rest = np.ones(len(hashes), bool)
            rest[taken] = False
            hashes, entries, slot = hashes[rest], entries[rest], slot[rest]
            if not len(hashes):
                return

    def documents(self, words: Words) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts in turn, each closed by END; where each text begins and ends)."""
        if self.count > MOST_ENTRIES * 3 // 4:
            self._clear()
        found = self._find(words.hashes)
        starts, lengths = self.starts[found], self.lengths[found]
        flat = self.flat
        miss = np.flatnonzero(found == 0)
        if len(miss):
            new, at, back = np.unique(words.hashes[miss], return_index=True, return_inverse=True)
            data = words.buffer.tobytes()
            spelled = [data[a:b].decode() for a, b in zip(words.starts[miss[at]].tolist(), words.ends[miss[at]].tolist())]
            ids, sizes = self.encode_new(spelled)
            begins = np.cumsum(sizes) - sizes
            room = min(MOST_ENTRIES + 1 - self.count, int(np.searchsorted(begins + sizes, len(flat) - self.used, "right")))
            if room > 0:
                n = int(sizes[:room].sum())
                flat[self.used : self.used + n] = ids[:n]
                entry = np.arange(self.count, self.count + room)
                self.starts[entry], self.lengths[entry] = begins[:room] + self.used, sizes[:room]
                self._place(new[:room], entry)
                self.count += room
                self.used += n
            flat = np.concatenate([flat[: self.used], ids])
            starts[miss], lengths[miss] = begins[back] + self.used, sizes[back]
        starts = np.insert(starts, words.bounds[1:], 0)
        lengths = np.insert(lengths, words.bounds[1:], 1)
        upto = np.concatenate([[0], np.cumsum(lengths)])
        out = flat[np.repeat(starts - upto[:-1], lengths) + np.arange(upto[-1])]
        return out, upto[words.bounds + np.arange(len(words.bounds))]
