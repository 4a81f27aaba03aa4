"""Token ids of whole texts with a public tokenizer file, word by word with a bounded memo."""

from __future__ import annotations

import os
import re

import numpy as np

from . import scan

#: Words kept in a worker's memo, some 40 bytes each. A full memo is emptied: results never depend on it.
MEMO_WORDS = 1_000_000
#: Words sent to the tokenizer at once.
BATCH = 2048

#: Letters a-z and the Latin-1 letters, in UTF-8; the same with ASCII punctuation after them.
_PLAIN = re.compile(rb"(?:[a-z]|\xc3[\x80-\x96\x98-\xb6\xb8-\xbf])+")
_ENDED = re.compile(rb"((?:[a-z]|\xc3[\x80-\x96\x98-\xb6\xb8-\xbf])+)([!-/:-@\[-`{-~]+)")
_LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))


class WordEncoder:
    """Ids of texts under word_bpe_49k.json, equal to encode(text, add_special_tokens=False).

    That tokenizer drops white space and never joins characters across it, so the ids of a text are the ids of
    its parts between ASCII white space, one after another. Repeated parts are encoded once. ASCII capitals are
    lower-cased, as the tokenizer does, unless the text holds "<|", the start of a special token. A part of Latin
    letters with ASCII punctuation after it is two runs to the tokenizer, so its ids are those of both.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self._empty()
        vocabulary = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for word, i in vocabulary.items() if word.endswith("</w>")]] = True

    def _empty(self) -> None:
        self.known = np.empty(0, np.uint64)  # hashes of words, in order
        self.begin, self.size, self.length = (np.empty(0, np.int64) for _ in range(3))
        self.pool, self.used = np.empty(1 << 16, "<u4"), 0

    def _find(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.minimum(np.searchsorted(self.known, h), max(0, len(self.known) - 1))
        return at, self.known[at] == h if len(self.known) else np.zeros(len(h), bool)

    def _one_by_one(self, parts: list[bytes], ids: dict[bytes, bytes]) -> None:
        for at in range(0, len(parts), BATCH):
            some = parts[at : at + BATCH]
            for part, got in zip(some, self.tokenizer.encode_batch_fast([x.decode() for x in some], add_special_tokens=False), strict=True):
                ids[part] = np.array(got.ids, "<u4").tobytes()

    def _learn(self, parts: list[bytes]) -> list[bytes]:
        """Ids of words. Those of Latin letters alone go to the tokenizer as one text: its ids that end a word tell them apart."""
        ids: dict[bytes, bytes] = {}
        plain: dict[bytes, None] = {}
        marks: dict[bytes, None] = {}
        other: list[bytes] = []
        ended: list[tuple[bytes, bytes, bytes]] = []
        for part in parts:
            if part.isalpha() or _PLAIN.fullmatch(part):
                plain[part] = None
            elif found := _ENDED.fullmatch(part):
                ended.append((part, found[1], found[2]))
                marks[found[2]] = None
            else:
                other.append(part)
        bases = list({base for _, base, _ in ended}.difference(plain))
        if bases:
            buf = np.frombuffer(b" ".join(bases), np.uint8)
            at, hit = self._find(scan.words(buf, np.array([0, len(buf)]))[0])
            begin, end = self.begin[at].tolist() if len(self.begin) else [], (self.begin[at] + self.size[at]).tolist() if len(self.begin) else []
            for k, base in enumerate(bases):
                if hit[k]:
                    ids[base] = self.pool[begin[k] : end[k]].tobytes()
                else:
                    plain[base] = None
        self._one_by_one([*other, *marks], ids)
        keys = list(plain)
        for a in range(0, len(keys), BATCH):
            some = keys[a : a + BATCH]
            got = np.array(self.tokenizer.encode_batch_fast([b" ".join(some).decode()], add_special_tokens=False)[0].ids, "<u4")
            to = np.flatnonzero(self.ends[got]) + 1
            if len(to) != len(some):
                self._one_by_one(some, ids)
                continue
            data, ends = got.tobytes(), (4 * to).tolist()
            ids.update(zip(some, map(data.__getitem__, map(slice, [0, *ends], ends)), strict=False))
        for part, base, mark in ended:
            ids[part] = ids[base] + ids[mark]
        return [ids[x] for x in parts]

    def _keep(self, h: np.ndarray, length: np.ndarray, ids: list[bytes]) -> None:
        size = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
        total = int(size.sum())
        while self.used + total > len(self.pool):
            self.pool = np.concatenate((self.pool, np.empty_like(self.pool)))
        self.pool[self.used : self.used + total] = np.frombuffer(b"".join(ids), "<u4")
        known = np.concatenate((self.known, h))
        order = np.argsort(known, kind="stable")
        self.known = known[order]
        self.begin = np.concatenate((self.begin, self.used + np.cumsum(size) - size))[order]
        self.size = np.concatenate((self.size, size))[order]
        self.length = np.concatenate((self.length, length))[order]
        self.used += total

    def encode(self, buf: np.ndarray, off: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the texts in ``buf``, each with ``end_id`` after it, and the texts' offsets among them."""
        n = len(off) - 1
        raw = buf.tobytes()
        if b"<|" in raw:  # a special token may stand there
            return self._apart(buf, off, end_id)
        h, start, end, row = scan.words(buf, off)
        order = np.argsort(h)
        new = np.ones(len(h), bool)
        np.not_equal(h[order[1:]], h[order[:-1]], out=new[1:])
        first, which = order[new], np.empty(len(h), np.int64)
        which[order] = np.cumsum(new) - 1
        name, length = h[first], (end - start)[first]
        at, hit = self._find(name)
        if not np.array_equal(length[which], end - start) or (len(self.length) and not np.array_equal(self.length[at[hit]], length[hit])):
            return self._apart(buf, off, end_id)  # two words with one hash
        if not hit.all():
            lower, lost = raw.translate(_LOWER), first[~hit]
            self._keep(name[~hit], length[~hit], self._learn([lower[a:b] for a, b in zip(start[lost].tolist(), end[lost].tolist(), strict=True)]))
            at, _ = self._find(name)
        long = self.size[at][which]
        total = int(long.sum())
        ids = self.pool[np.repeat(self.begin[at][which] - (np.cumsum(long) - long), long) + np.arange(total)]
        per_row = np.bincount(row, long, n).astype(np.int64)
        out = np.full(total + n, end_id, "<u4")
        out[np.arange(total) + np.repeat(np.arange(n), per_row)] = ids
        if len(self.known) > MEMO_WORDS:
            self._empty()
        return out, np.concatenate(([0], np.cumsum(per_row + 1)))

    def _apart(self, buf: np.ndarray, off: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        texts = [buf[a:b].tobytes().decode() for a, b in zip(off[:-1], off[1:], strict=True)]
        got = [np.array([*x.ids, end_id], "<u4") for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        return np.concatenate(got), np.concatenate(([0], np.cumsum([len(x) for x in got])))


_encoders: dict[str, WordEncoder] = {}


def encoder(path: str) -> WordEncoder:
    """One encoder for each worker and file."""
    if path not in _encoders:
        _encoders[path] = WordEncoder(path)
    return _encoders[path]


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def vocabulary(path: str) -> int:
    """One more than the largest id."""
    return len(encoder(path).ends)
