"""Token ids of whole Arrow batches by a tokenizers file.

A text is cut where the file's pre-tokenizer is sure to cut it: before ASCII white space that a
non-blank character follows, around a line break, and between an ASCII letter and ASCII punctuation. So
the ids of a text are those of its pieces one after another. Ids come from a direct-mapped cache of fixed
size; the distinct pieces of a slice that it lacks go through the library, joined by a separator that has an id of
its own, and their ids are parted there again. A text that holds an added token's string (``<|endoftext|>``) goes through the
library whole, which gives that string its own id.
"""

from __future__ import annotations

import os

import numpy as np

from moodtide.llm import textkit as tk

CACHE_BITS, CACHED_IDS, JOINED = 21, 8, 512
_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = True
#: ASCII punctuation but the apostrophe, with which contractions begin.
_MARK = np.zeros(256, bool)
_MARK[33:48] = _MARK[58:65] = _MARK[91:97] = _MARK[123:127] = True
_MARK[39] = False
#: First bytes of all other white space and of marks that could join what stands before them.
_UNSURE = np.zeros(256, bool)
_UNSURE[[0xC2, 0xCC, 0xCD, 0xE1, 0xE2, 0xE3]] = True
_SEPARATORS = ("\n", " \x01 ")


class PieceEncoder:
    """Ids as ``Tokenizer.from_file(path).encode(text, add_special_tokens=False)`` gives them."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.added = [x.content.lower().encode() for x in self.tokenizer.get_added_tokens_decoder().values() if x.content]
        self.separator = next((s for s in _SEPARATORS if len(self._ids(s)) == 1 and self._ids(f"x{s} y{s}z") == [*self._ids("x"), *self._ids(s), *self._ids(" y"), *self._ids(s), *self._ids("z")]), None)
        self.mark = self._ids(self.separator)[0] if self.separator else -1
        self.folds = self._ids("ABC") == self._ids("abc")
        self.keys = np.zeros(1 << CACHE_BITS, np.uint64)
        self.count = np.zeros(1 << CACHE_BITS, np.uint8)
        self.cached = np.zeros((1 << CACHE_BITS, CACHED_IDS), np.uint16 if self.tokenizer.get_vocab_size() <= 1 << 16 else np.uint32)

    def _ids(self, text: str) -> list[int]:
        return self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids

    def _encode_pieces(self, pieces: list[str], odd: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of pieces one after another, and their counts; odd ones can't stand beside a separator."""
        count, out, order = np.zeros(len(pieces), np.int64), [np.zeros(0, np.uint32)], []
        plain, single = np.flatnonzero(~odd).tolist(), np.flatnonzero(odd).tolist()
        if not self.separator:
            plain, single = [], list(range(len(pieces)))
        for at in range(0, len(plain), JOINED):
            some = plain[at : at + JOINED]
            ids = np.array(self._ids(self.separator.join([pieces[i] for i in some])), np.uint32)
            breaks = np.flatnonzero(ids == self.mark)
            if len(breaks) != len(some) - 1:
                single += some
                continue
            count[some] = np.diff(np.concatenate([[-1], breaks, [len(ids)]])) - 1
            out.append(np.delete(ids, breaks))
            order += some
        for at in range(0, len(single), JOINED):
            some = single[at : at + JOINED]
            for i, e in zip(some, self.tokenizer.encode_batch_fast([pieces[i] for i in some], add_special_tokens=False), strict=True):
                count[i] = len(e.ids)
                out.append(np.array(e.ids, np.uint32))
            order += some
        order = np.array(order, np.int64)
        ends = np.zeros(len(pieces), np.int64)
        ends[order] = np.cumsum(count[order])
        return np.concatenate(out)[tk.ragged(ends - count, count)], count

    def encode(self, t: tk.Texts) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts of a slice, and where each text's begin."""
        ids, begin = self._piecewise(t)
        odd = self._with_added(t)
        if not odd:
            return ids, begin
        parts, at = [], 0
        for i in odd:
            parts += [ids[begin[at] : begin[i]], np.array(self._ids(t.data[t.offs[i] : t.offs[i + 1]].tobytes().decode("utf-8", "replace")), ids.dtype)]
            at = i + 1
        length = np.diff(begin)
        length[odd] = [len(x) for x in parts[1::2]]
        return np.concatenate([*parts, ids[begin[at] :]]), np.append(0, np.cumsum(length))

    def _with_added(self, t: tk.Texts) -> list[int]:
        """The texts that hold an added token's string, in any case of letters."""
        if not self.added:
            return []
        raw, found = t.data.tobytes().lower(), set()
        for content in self.added:
            at = raw.find(content)
            while at >= 0:
                i = int(t.owner(np.array([at]))[0])
                found.add(i)
                at = raw.find(content, int(t.offs[i + 1]))
        return sorted(found)

    def _piecewise(self, t: tk.Texts) -> tuple[np.ndarray, np.ndarray]:
        data = t.data
        if not len(data):
            return np.zeros(0, np.uint32), np.zeros(t.n + 1, np.int64)
        full, letter = tk.BLANK_SEPARATED[data], _LETTER[data]
        cut = np.zeros(len(data), bool)
        sure = full[1:] & ~_UNSURE[data[1:]]
        cut[:-1] = ~full[:-1] & sure
        cut[1:] |= (data[:-1] == 10) & sure | letter[:-1] & _MARK[data[1:]]
        cut[t.offs[:-1][t.offs[:-1] < len(cut)]] = True
        start = np.flatnonzero(cut)
        end = np.append(start[1:], len(data))
        keys = tk.Texts(data, t.offs, 0, lower=self.folds).hashes(start, end)
        slot = (keys >> tk.U(64 - CACHE_BITS)).astype(np.int64)
        missed = np.flatnonzero(self.keys[slot] != keys)
        length = self.count[slot].astype(np.int64)
        new, first, back = np.unique(keys[missed], return_index=True, return_inverse=True)
        if len(new):
            raw, at = data.tobytes(), missed[first]
            blanks = np.append(0, np.cumsum(~full | (data == 1)))
            # a blank anywhere but in front could run into a separator
            odd = blanks[end[at]] - blanks[start[at] + 1] + ((data[start[at]] != 32) & ~full[start[at]]) + (data[start[at]] == 1) > 0
            text = [raw[a:b].decode("utf-8", "replace") for a, b in zip(start[at].tolist(), end[at].tolist(), strict=True)]
            new_ids, new_count = self._encode_pieces(text, odd)
            length[missed] = new_count[back]
        begin = np.append(0, np.cumsum(length))
        ids = np.zeros(begin[-1], np.uint32)
        known = length.copy()
        known[missed] = 0
        of = np.flatnonzero(known)
        where, rows = begin[of], slot[of]
        for j in range(CACHED_IDS):
            more = known[of] > j
            if j and not more.all():
                of, where, rows = of[more], where[more], rows[more]
            ids[where + j] = self.cached[rows, j]
        if len(new):
            place = np.cumsum(new_count) - new_count
            ids[tk.ragged(begin[missed], length[missed])] = new_ids[tk.ragged(place[back], new_count[back])]
            fits = np.flatnonzero((new_count <= CACHED_IDS) & (new != 0))
            to = (new[fits] >> tk.U(64 - CACHE_BITS)).astype(np.int64)
            _, last = np.unique(to, return_index=True)
            fits, to = fits[last], to[last]
            self.keys[to], self.count[to] = new[fits], new_count[fits]
            row = np.zeros((len(fits), CACHED_IDS), self.cached.dtype)
            n = new_count[fits]
            row[np.repeat(np.arange(len(fits)), n), tk.ragged(np.zeros(len(fits), np.int64), n)] = new_ids[tk.ragged(place[fits], n)]
            self.cached[to] = row
        return ids, begin[np.searchsorted(start, t.offs)]


_encoders: dict[str, PieceEncoder] = {}


def encoder(path: str) -> PieceEncoder:
    """One encoder per worker and file."""
    if path not in _encoders:
        _encoders[path] = PieceEncoder(path)
    return _encoders[path]


def forget() -> None:
    """Drops the encoders of this worker."""
    _encoders.clear()


def with_end(ids: np.ndarray, begin: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
    """The same ids with end_id after each text's."""
    return np.insert(ids, begin[1:], np.uint32(end_id)).astype(np.uint32), begin + np.arange(len(begin))
