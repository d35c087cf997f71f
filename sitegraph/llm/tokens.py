"""Subword ids of whole texts by a public tokenizer, encoded word by word.

A tokenizer that splits at white space before anything else gives a text the ids of
its words in a row.  Words are told apart by 64-bit hashes over a whole step of
documents; each distinct one is encoded once and its ids stay in a table per Python
worker.  Where the tokenizer also folds case and splits a closing mark from a letter,
words differing only in that share an entry.  A text with the tokenizer's special
strings is encoded whole.
"""

from __future__ import annotations

import contextlib
import ctypes
import os

import numpy as np
import pyarrow as pa

from sitegraph.llm.common import distinct, mix, word_hashes, word_spans

#: Distinct words that a worker remembers (about 40 bytes each); beyond that it keeps
#: the half that was used last.
REMEMBERED = 1_000_000
#: Words per call of the tokenizer (its answers take about a kilobyte a word).
CALL = 2000
_JOIN = np.uint64(0xC2B2AE3D27D4EB4F)
_LETTER = np.zeros(256, bool)
_LETTER[[*range(ord("A"), ord("Z") + 1), *range(ord("a"), ord("z") + 1)]] = True


class Encoder:
    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.specials = [t.content.encode() for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.size = self.tokenizer.get_vocab_size()
        word, mark = self._encode([b"word", b"."])
        self.folds = self._encode([b"Word", b"word."]) == [word, word + mark]
        self.keys = np.zeros(0, np.uint64)          # sorted; the next three go with it
        self.place = np.zeros(0, np.int64)
        self.count = np.zeros(0, np.int64)
        self.used = np.zeros(0, np.int64)
        self.pool = np.zeros(1 << 20, np.uint32)    # the ids of all words
        self.filled = self.step = 0

    def _encode(self, words: list[bytes]) -> list[list[int]]:
        out = []
        for at in range(0, len(words), CALL):
            found = self.tokenizer.encode_batch_fast([w.decode() for w in words[at:at + CALL]], add_special_tokens=False)
            out += [e.ids for e in found]
        return out

    def _rows(self, keys: np.ndarray, spell) -> np.ndarray:
        """Rows of sorted distinct ``keys``; ``spell(k)``: the words of those at indexes k."""
        self.step += 1
        at = np.searchsorted(self.keys, keys)
        new = np.ones(len(keys), bool)
        inside = at < len(self.keys)
        new[inside] = self.keys[at[inside]] != keys[inside]
        if new.any():
            self._forget(int(new.sum()), keys[~new])
            ids = self._encode(spell(np.flatnonzero(new)))
            count = np.array([len(x) for x in ids], np.int64)
            flat = np.fromiter((i for x in ids for i in x), np.uint32, int(count.sum()))
            if self.filled + len(flat) > len(self.pool):
                self.pool = np.concatenate([self.pool[:self.filled], np.zeros(max(self.filled, len(flat)), np.uint32)])
            self.pool[self.filled:self.filled + len(flat)] = flat
            where = np.searchsorted(self.keys, keys[new])
            place = self.filled + np.cumsum(count) - count
            self.filled += len(flat)
            for name, values in (("keys", keys[new]), ("place", place), ("count", count), ("used", np.full(len(count), self.step))):
                setattr(self, name, np.insert(getattr(self, name), where, values))
            at = np.searchsorted(self.keys, keys)
        self.used[at] = self.step
        return at

    def _forget(self, coming: int, wanted: np.ndarray) -> None:
        if len(self.keys) + coming <= REMEMBERED:
            return
        keep = self.used > np.median(self.used)
        keep[np.searchsorted(self.keys, wanted)] = True
        count, place = self.count[keep], self.place[keep]
        total = int(count.sum())
        source = np.repeat(place - (np.cumsum(count) - count), count) + np.arange(total)
        pool = np.zeros(max(1 << 20, 2 * total), np.uint32)
        pool[:total] = self.pool[source]
        self.keys, self.used, self.count, self.place = self.keys[keep], self.used[keep], count, np.cumsum(count) - count
        self.pool, self.filled = pool, total

    def texts(self, data: np.ndarray, offsets: np.ndarray, spelled: Spelled | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the texts in ``data`` cut at ``offsets``, and where each text's ids begin (n+1)."""
        whole = data.tobytes()
        if any(s in whole for s in self.specials):
            parts = [np.array(self.tokenizer.encode(whole[a:b].decode(), add_special_tokens=False).ids, np.uint32)
                     for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
            return (np.concatenate([*parts, np.zeros(0, np.uint32)]),
                    np.concatenate([[0], np.cumsum([len(p) for p in parts], dtype=np.int64)]))
        if not self.folds or spelled is None:
            spelled = Spelled(data, offsets, self.folds)
        s = spelled
        if not len(s.starts):
            return np.zeros(0, np.uint32), np.zeros(len(offsets), np.int64)
        rows = self._rows(s.keys, lambda k: [whole[s.starts[i]:s.ends[i]] for i in s.at[k].tolist()])
        count = self.count[rows][s.back]
        upto = np.concatenate([[0], np.cumsum(count)])
        source = np.repeat(self.place[rows][s.back] - upto[:-1], count) + np.arange(upto[-1])
        return self.pool[source], upto[s.first]


class Spelled:
    """The words of a step of texts.  With ``fold``, A-Z count as a-z and a closing full
    stop or comma after an ASCII letter is a part of its own; parts are told apart by
    hash, and ``keys[back]`` are the hashes of all parts in a row."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, fold: bool = True):
        self.starts, self.ends, self.words_first = word_spans(data, offsets)
        self.mark, self.first = np.zeros(len(self.starts), bool), self.words_first
        self.head = np.arange(len(self.starts))
        if fold and len(self.starts):
            self._split(data)
        self.keys, self.at, self.back = distinct(word_hashes(data, self.starts, self.ends, fold))

    def _split(self, data: np.ndarray) -> None:
        starts, ends = self.starts, self.ends
        last = data[ends - 1]
        mark = ((last == ord(".")) | (last == ord(","))) & (ends - starts > 1)
        mark &= _LETTER[data[np.maximum(ends - 2, 0)]]
        upto = np.concatenate([[0], np.cumsum(mark.astype(np.int64) + 1)])
        head, tail = upto[:-1], upto[1:][mark] - 1
        self.starts, self.ends = np.empty(upto[-1], np.int64), np.empty(upto[-1], np.int64)
        self.starts[head], self.ends[head] = starts, ends - mark
        self.starts[tail], self.ends[tail] = ends[mark] - 1, ends[mark]
        self.mark, self.head, self.first = mark, head, upto[self.words_first]

    def words(self) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of the distinct whole words, sorted, and each word's row in them."""
        n = len(self.keys)
        tail = np.zeros(len(self.head), np.int64)
        tail[self.mark] = self.back[self.head[self.mark] + 1] + 1
        kinds, tail = np.unique(tail, return_inverse=True)       # no mark, or one of the marks
        cell = tail * n + self.back[self.head]
        used = np.zeros(n * len(kinds), bool)
        used[cell] = True
        cells = np.flatnonzero(used)
        kind, core = kinds[cells // max(n, 1)], self.keys[cells % max(n, 1)]
        keys = np.where(kind == 0, core, mix(core + self.keys[np.maximum(kind - 1, 0)] * _JOIN)) if len(cells) else core
        order = np.argsort(keys)
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        row = np.zeros(len(used), np.int64)
        row[cells] = place
        return keys[order], row[cell]


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """This worker's encoder for a tokenizer file (loaded once)."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def forget_encoders() -> None:
    """Give back this worker's tables, for stages that encode nothing: to the system too, as
    freed memory would stay with the worker."""
    _ENCODERS.clear()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):      # of glibc only
        ctypes.CDLL(None).malloc_trim(0)


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)
