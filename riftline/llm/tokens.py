"""Whole-text encoding with a public tokenizer, word by word through a cache.

This tokenizer's pre-tokens never cross white space, and its normaliser turns
runs of white space into single spaces, so a text's ids are its
space-separated parts' ids in order. Each distinct part is encoded once by the
``tokenizers`` library and remembered in a table; when it is full, the half that
was met most often stays. Ids are then gathered with array operations. Texts with the separators
0x1C-0x1F, on which Python and the tokenizer differ, are encoded in one piece.

The normaliser lowers letters. Texts of code points below 256 are lowered before
they are split, so that a word has one part for all its cases: there each letter
has one lower case, and nothing to compose. The vocabulary's own tokens, which the
library looks for before it normalises, all hold ``<|``; texts with it stay as they are.
"""

from __future__ import annotations

import gc
import os
import re
import unicodedata
from itertools import chain

import numpy as np

#: Distinct parts remembered by a worker: some 80 MB.
CACHE_PARTS = 400_000
END_ID = 1
_ODD_SPACE = re.compile("[\x1c-\x1f]")
#: Letters whose lower case is one letter, then ASCII marks: two pre-tokens at most.
_PART = re.compile(r"^(?:([A-Za-zÀ-ÖØ-öø-įĲ-ɏ]++)([!-/:-@\[-^`{-~]*+)$|(.+)$)", re.MULTILINE)


def _runs(flat: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """The runs of an array, one behind another."""
    ends = np.cumsum(length, dtype=np.int64)
    return flat[np.repeat(start - (ends - length), length) + np.arange(ends[-1] if len(ends) else 0)]


def _joined(lists: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    """(all numbers of the lists, the lists' lengths)."""
    return np.array(list(chain.from_iterable(lists)), np.int32), np.fromiter(map(len, lists), np.int64, len(lists))


def _lowered(text: str) -> str:
    """The text in lower case where that is sure not to change its ids."""
    try:
        return text if len(text.encode("latin-1")) and "<|" in text else text.lower()
    except UnicodeEncodeError:
        return text


class Parts(dict):
    """Part -> its place in a list; a new part gets the next place."""

    __slots__ = ("fresh",)

    def __missing__(self, part):
        place = self[part] = len(self)
        self.fresh.append(part)
        return place


class Encoder:
    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        # The same model, in the same memory, for lone lower-case words, which need no pattern to be split.
        self.words = Tokenizer(self.tokenizer.model)
        self.words.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
        vocab = self.tokenizer.get_vocab()
        self.ends_word = np.zeros(max(vocab.values()) + 1, bool)
        for token, i in vocab.items():
            self.ends_word[i] = token.endswith("</w>")
        # Byte-level models write a byte that is no printable character as a later code point.
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        self.bytes = {b: 256 + k for k, b in enumerate(b for b in range(256) if b not in shown)}
        del self.bytes[32]
        self.clear()

    def clear(self):
        self.places = Parts()
        self.places.fresh = []
        self.flat = np.zeros(1 << 16, np.int32)
        self.used = 0
        self.start, self.length, self.met = np.zeros(1 << 14, np.int64), np.zeros(1 << 14, np.int32), np.zeros(1 << 14, np.int32)
        self.known = 0
        self.tails: dict[str, list[int]] = {"": []}  # ids of marks after words

    def _forget(self):
        """Keep the half of the parts that was met most often; what they were met counts half from now on."""
        met = self.met[: self.known]
        keep = np.zeros(self.known, bool)
        keep[np.argpartition(met, self.known // 2)[self.known // 2 :]] = True
        keep &= met > 1
        keep[0] = True
        met = met[keep] // 2
        names = [part for part, stays in zip(self.places, keep.tolist()) if stays]
        start, length = self.start[: self.known][keep], self.length[: self.known][keep]
        ids = _runs(self.flat, start, length)
        self.clear()
        self.places.update(zip(names, range(len(names))))
        self._keep(ids, length)
        self.met[: self.known] = met

    def _whole(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def _keep(self, ids: np.ndarray, lengths: np.ndarray):
        """Append the parts next in order."""
        while self.used + len(ids) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        while self.known + len(lengths) > len(self.start):
            self.start, self.length, self.met = (np.concatenate([x, np.zeros_like(x)]) for x in (self.start, self.length, self.met))
        self.flat[self.used : self.used + len(ids)] = ids
        self.start[self.known : self.known + len(lengths)] = self.used + np.cumsum(lengths) - lengths
        self.length[self.known : self.known + len(lengths)] = lengths
        self.used, self.known = self.used + len(ids), self.known + len(lengths)

    def _words(self, todo: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of lower-case words, ids of each word)."""
        ids, ends = [np.zeros(0, np.int32)], [np.zeros(0, np.int64)]
        for ascii_only in (True, False):
            some = [w for w in todo if w.isascii() == ascii_only]
            if not some:
                continue
            text = " ".join(some)
            if not ascii_only:
                # as bytes; the space between words stays a space, so that it still splits
                text = unicodedata.normalize("NFC", text).encode().decode("latin-1").translate(self.bytes)
            own = np.array(self.words.encode_batch_fast([text], add_special_tokens=False)[0].ids, np.int32)
            cuts = np.flatnonzero(self.ends_word[own]) + 1
            if len(cuts) != len(some):
                raise ValueError("the vocabulary doesn't mark the ends of words")
            ids.append(own)
            ends.append(np.diff(cuts, prepend=0))
        plain = np.fromiter(map(str.isascii, todo), bool, len(todo))
        order = np.argsort(~plain, kind="stable")
        length = np.zeros(len(todo), np.int64)
        length[order] = np.concatenate(ends)
        start = np.zeros(len(todo), np.int64)
        start[order] = np.cumsum(length[order]) - length[order]
        return _runs(np.concatenate(ids), start, length), length

    def _learn(self):
        """Encode the parts met since the last call: a word and the marks behind it, or anything else in one piece."""
        fresh, self.places.fresh = self.places.fresh, []
        word, marks, rest = zip(*_PART.findall("\n".join(fresh)))
        lower = "\n".join(word).lower().split("\n")
        words, ends = dict.fromkeys(lower), dict.fromkeys(marks)
        words.pop("", None)
        # a word that was met bare before needs no encoding
        at = np.fromiter((self.places.get(w, self.known) for w in words), np.int64, len(words))
        old = at < self.known
        met = _runs(self.flat, self.start[at[old]], self.length[at[old]].astype(np.int64))
        new, new_length = self._words([w for w, known in zip(words, old.tolist()) if not known])
        length = np.zeros(len(words) + 1, np.int64)  # the last one is of no word
        length[:-1][old], length[:-1][~old] = self.length[at[old]], new_length
        start = np.zeros(len(words) + 1, np.int64)
        for which, base in ((old, 0), (~old, len(met))):
            own = length[:-1][which]
            start[:-1][which] = base + np.cumsum(own) - own
        if len(self.tails) > CACHE_PARTS // 50:
            self.tails = {t: ids for t, ids in self.tails.items() if len(t) < 2}
        unknown, other = [t for t in ends if t not in self.tails], [x for x in rest if x]
        pieces = [e.ids for e in self.tokenizer.encode_batch_fast([*unknown, *other], add_special_tokens=False)] if unknown or other else []
        self.tails.update(zip(unknown, pieces))
        tail, tail_length = _joined([self.tails[t] for t in ends])
        left, left_length = _joined(pieces[len(unknown) :])
        index = dict(zip([*words, ""], range(len(words) + 1)))
        of = np.fromiter(map(index.__getitem__, lower), np.int64, len(lower))
        begin, size = start[of], length[of]
        alone = np.fromiter(map(bool, rest), bool, len(rest))
        base = len(met) + len(new)
        begin[alone], size[alone] = base + len(tail) + np.cumsum(left_length) - left_length, left_length
        index = dict(zip(ends, range(len(ends))))
        of = np.fromiter(map(index.__getitem__, marks), np.int64, len(marks))
        tail_begin = base + np.cumsum(tail_length) - tail_length
        begins, sizes = np.stack([begin, tail_begin[of]], 1).ravel(), np.stack([size, tail_length[of]], 1).ravel()
        self._keep(_runs(np.concatenate([met, new, tail, left]), begins, sizes), size + tail_length[of])

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, each with the end id; ids of each text)."""
        if len(self.places) > CACHE_PARTS:
            self._forget()
            if len(self.places) > CACHE_PARTS:
                self.clear()
        if not self.places:
            self.places["\x00end"] = 0  # no part holds it: the end id's own place
            self._keep(np.array([END_ID], np.int32), np.array([1], np.int32))
        get, rows, counts, whole = self.places.__getitem__, [], [], {}
        for i, text in enumerate(texts):
            if text and _ODD_SPACE.search(text):
                whole[i], parts = self._whole(text), []
            else:
                parts = _lowered(text).split() if text else []
            rows += map(get, parts)
            rows.append(0)
            counts.append(len(parts) + 1)
        if self.places.fresh:
            collecting = gc.isenabled()
            gc.disable()  # many small lists that live on: each collection would walk them all
            self._learn()
            if collecting:
                gc.enable()
        rows = np.array(rows, np.int64)
        self.met[: self.known] += np.bincount(rows, minlength=self.known).astype(np.int32)
        lengths = self.length[rows].astype(np.int64)
        ids = _runs(self.flat, self.start[rows], lengths)
        per_text = np.add.reduceat(lengths, np.cumsum(counts) - counts) if counts else np.zeros(0, np.int64)
        if whole:
            split = np.split(ids, np.cumsum(per_text)[:-1])
            for i, own in whole.items():
                split[i] = np.array([*own, END_ID], np.int32)
            ids, per_text = np.concatenate(split), np.array([len(x) for x in split], np.int64)
        return ids, per_text


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """This worker's encoder for a vocabulary file."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def texts_by_size(column, limit: int = 1 << 20):
    """(first row, texts) of an Arrow string column, in runs of some ``limit`` characters."""
    run, first, size = [], 0, 0
    for i, text in enumerate(column):
        text = text.as_py()
        if run and size + len(text or "") > limit:
            yield first, run
            run, first, size = [], i, 0
        run.append(text)
        size += len(text or "")
    if run:
        yield first, run


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")
