"""Token ids of whole texts by a public tokenizer.

A tokenizer treats most of a text as independent words. ``Encoder`` cuts texts at places that are always token
boundaries, numbers the different pieces of a batch with Arrow, encodes those not seen before with the tokenizers
library, and gathers the ids with numpy, so Python handles different pieces only. Plain words, on which normaliser,
pattern and special tokens have no effect, are encoded by the tokenizer's model alone, many in one call: the tokens'
lengths say where a word's ids end. Texts whose blanks are unusual go through the library whole. Known pieces are held
up to a bound in bytes, in two generations: when the younger is full, the older one is forgotten and its pieces are
encoded again, which changes no result.
"""

from __future__ import annotations

import json
import os
import re
from array import array

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: A piece whose blanks don't depend on its neighbours: no runs, none at an end but a space before it.
_USUAL = re.compile(r" ?\S+(?:\s\S+)*")
#: Only some libraries count these as blank.
_CONTROLS = re.compile(r"[\x1c-\x1f]")
#: Beyond these letters, lower case may depend on the library.
_BEYOND_LATIN = re.compile(r"[^\x00-ɏ]")
#: Latin letters, all composed; a mark after them is a token of its own.
_WORD = re.compile(r" ?[A-Za-zÀ-ÖØ-öø-ɏ]+[.,;:!?]?")
_MARKS = frozenset(".,;:!?")
_CUT = "\0"
#: Bytes that a held piece takes beside its characters: dictionary entry, two object headers, some ids.
_ENTRY = 240
#: Words that the model encodes in one call.
_TOGETHER = 500
_LOADED: dict[str, Encoder] = {}


class Encoder:
    """``blanks`` says how the tokenizer treats blanks: "dropped" (they only separate words, and case is dropped too) or
    "joined" (a single space belongs to the word after it)."""

    def __init__(self, path: str, blanks: str, held_bytes: int = 192 << 20):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer, pre_tokenizers

        self.library = Tokenizer.from_file(path)
        whole = json.loads(self.library.to_str())
        #: Found in the raw text: a text that holds one in any case must keep its case.
        self.special = [t["content"].lower() for t in whole["added_tokens"]]
        self.blanks = blanks
        model = {"added_tokens": [], "normalizer": None, "post_processor": None, "decoder": None,
                 "pre_tokenizer": {"type": "CharDelimiterSplit", "delimiter": "\n"}}
        self.model = Tokenizer.from_str(json.dumps(whole | model))
        in_bytes = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        self.letters = {ord(c): in_bytes.pre_tokenize_str(c)[0][0] for c in map(chr, range(32, 0x250)) if _WORD.fullmatch(c + "a")}
        vocabulary, end = self.library.get_vocab(), whole["model"].get("end_of_word_suffix") or ""
        #: Length of each token in the model's letters.
        self.widths = np.zeros(max(vocabulary.values()) + 1, np.int64)
        self.widths[list(vocabulary.values())] = [len(t.removesuffix(end)) for t in vocabulary]
        self.held_bytes = held_bytes
        self.size = 0
        #: Ids by piece, None: unusual.
        self.held: dict[str, bytes | None] = {}
        self.older: dict[str, bytes | None] = {}

    def _whole(self, texts: list[str]) -> list[bytes]:
        return [array("I", e.ids).tobytes() for e in self.library.encode_batch_fast(texts, add_special_tokens=False)]

    def _words(self, words: list[str]) -> list[bytes]:
        """Ids of plain words, with a space before them or not."""
        out = []
        for k in range(0, len(words), _TOGETHER):
            text = "\n".join(words[k: k + _TOGETHER]).translate(self.letters)
            ids = np.array(self.model.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u4")
            ends = np.cumsum(np.fromiter(map(len, text.split("\n")), np.int64))
            reached = np.cumsum(self.widths[ids])
            at = np.searchsorted(reached, ends)
            if len(ids) == 0 or reached[-1] != ends[-1] or (reached[at] != ends).any():
                raise ValueError("the model's tokens don't add up to the words")
            raw = ids.tobytes()
            cuts = [0, *(4 * at + 4).tolist()]
            out += [raw[a:b] for a, b in zip(cuts[:-1], cuts[1:])]
        return out

    def _learn(self, missing: list[str]) -> None:
        """Hold the ids of pieces that aren't held yet."""
        words, marked, rest, known = [], [], [], {}
        is_word, joined = _WORD.fullmatch, self.blanks == "joined"
        for p in missing:
            if is_word(p) and (joined or p.islower()):
                (marked if p[-1] in _MARKS else words).append(p)
            elif joined and p != "\n" and (_USUAL.fullmatch(p) is None or _CONTROLS.search(p)):
                known[p] = None
            else:
                rest.append(p)
        words += {p[:-1] for p in marked}.difference(self.held, words)
        rest += {p[-1] for p in marked}.difference(self.held, rest)
        known.update(zip(words, self._words(words)))
        known.update(zip(rest, self._whole(rest)))
        self.held.update(known)
        held = self.held
        for p in marked:
            held[p] = held[p[:-1]] + held[p[-1]]
        self.size += sum(map(len, known)) + sum(map(len, marked)) + (len(known) + len(marked)) * _ENTRY

    def _ids(self, pieces: list[str]) -> list[bytes | None]:
        """Ids of different pieces."""
        if self.size > self.held_bytes // 2:
            self.older, self.held, self.size = self.held, {}, 0
        missing = [p for p in pieces if p not in self.held]
        if self.older:
            again = {p: self.older[p] for p in missing if p in self.older}
            self.held.update(again)
            self.size += sum(map(len, again)) + len(again) * _ENTRY
            missing = [p for p in missing if p not in again]
        self._learn(missing)
        return list(map(self.held.__getitem__, pieces))

    def _marked(self, text: str) -> str | None:
        """The text with its cuts marked; None if it has to be encoded whole."""
        if self.blanks == "joined":
            return None if _CUT in text else text.replace("\n", _CUT + "\n" + _CUT).replace(" ", _CUT + " ")
        if text.isascii() or not _BEYOND_LATIN.search(text):
            low = text.lower()
            if not any(t in low for t in self.special):
                text = low
        return text.replace("\n", " ")

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as little-endian unsigned 32-bit integers."""
        marked = [self._marked(t) for t in texts]
        whole = {i for i, m in enumerate(marked) if m is None}
        cut = pc.split_pattern(pa.array([m or "" for m in marked], pa.large_string()), _CUT if self.blanks == "joined" else " ")
        pieces = cut.flatten().dictionary_encode()
        ids = self._ids(pieces.dictionary.to_numpy(zero_copy_only=False).tolist())
        at = pieces.indices.to_numpy()
        first = cut.offsets.to_numpy() - cut.offsets[0].as_py()
        if None in ids:
            unusual = np.array([x is None for x in ids], bool)
            bad = np.concatenate(([0], np.cumsum(unusual[at])))[first]
            whole.update(np.flatnonzero(bad[1:] > bad[:-1]).tolist())
            ids = [x or b"" for x in ids]
        sizes = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
        flat = np.frombuffer(b"".join(ids), "<u4")
        counts = sizes[at]
        ends = np.concatenate(([0], np.cumsum(counts)))
        place = np.repeat((np.cumsum(sizes) - sizes)[at] - ends[:-1], counts) + np.arange(ends[-1])
        raw = flat[place].tobytes()
        bounds = (4 * ends[first]).tolist()
        out = [raw[a:b] for a, b in zip(bounds[:-1], bounds[1:])]
        redo = sorted(whole)
        for i, x in zip(redo, self._whole([texts[i] for i in redo])):
            out[i] = x
        return out


def encoder(path: str, blanks: str) -> Encoder:
    """One for each Python worker and tokenizer, kept between tasks."""
    if path not in _LOADED:
        _LOADED[path] = Encoder(path, blanks)
    return _LOADED[path]
