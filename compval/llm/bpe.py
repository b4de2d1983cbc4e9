"""Byte-pair encoding and decoding by contiguous rank arrays.

A text is normalised and cut into words as the tokenizer file says. Each short word is a row of part ids beside a row
of the ranks of its adjacent parts. Rounds scan every row for its minimum, merge there, delete the boundary and look
up the ranks of the two neighbours anew, until no row has a rank left. Rows of one length stand in one matrix, so a
scan covers all words that a batch has not met before. Long words take a heap instead, where a scan each round would
be quadratic.

Null texts are empty; an empty text has no tokens. Any length of text works: words never cross white space, so long texts
are cut at spaces, and a batch holds a bounded number of characters (or one longer word). Repeated rows give repeated
results, null ids come back as null, other columns are ignored. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import heapq
import itertools
import json
import re
import struct
import unicodedata
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame

from compval.llm.common import documents, slices

#: Words of up to so many bytes are rows of a rank matrix.
SHORT = 48
#: Code points below this need no normalisation but lower case (none combines), but for a few with odd lower cases.
PLAIN = 0x300
INF = np.int32(2**31 - 1)
SPACE, LETTER, NUMBER, OTHER, ODD = 0, 1, 2, 3, 4
#: The table of pair ranks: its bits, a multiplier, the mark of a free slot.
BITS, HASH, EMPTY = 18, np.uint64(0x9E3779B97F4A7C15), np.uint64(2**64 - 1)
SPECIAL = b"\xff"


def byte_chars() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out, more = {b: chr(b) for b in own}, 256
    for b in range(256):
        if b not in out:
            out[b], more = chr(more), more + 1
    return [out[b] for b in range(256)]


def _kinds() -> np.ndarray:
    out = np.full(PLAIN, OTHER, np.uint8)
    for c in range(PLAIN):
        major = unicodedata.category(chr(c))[0]
        out[c] = LETTER if major == "L" else NUMBER if major == "N" else OTHER
    out[[9, 10, 11, 12, 13, 32, 0x85, 0xA0]] = SPACE
    return out


def _distinct(at: np.ndarray, ends: np.ndarray, key: np.ndarray, code: np.ndarray) -> tuple[list[str], np.ndarray]:
    """The distinct words and the number of each word among them. Words of one hash are held against the first of them,
    code point by code point; should any differ, the words themselves are told apart."""
    low = code.astype("<u4").tobytes().decode("utf-32-le")
    if not len(at):
        return [], np.empty(0, np.int64)
    inv, held = pd.factorize(key)
    first = np.empty(len(held), np.int64)
    first[inv[::-1]] = np.arange(len(inv) - 1, -1, -1)
    size, model = ends - at, first[inv]
    place = np.arange(int(size.sum())) + np.repeat(at - (np.cumsum(size) - size), size)
    if (size[model] == size).all() and (code[place] == code[place + np.repeat(at[model] - at, size)]).all():
        return [low[a:e] for a, e in zip(at[first].tolist(), ends[first].tolist())], inv
    words = [low[a:e] for a, e in zip(at.tolist(), ends.tolist())]
    number = {w: k for k, w in enumerate(dict.fromkeys(words))}
    return list(number), np.fromiter(map(number.__getitem__, words), np.int64, len(words))


class WordBPE:
    """The model of a tokenizer file with word ends (lower case, white space dropped)."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab = spec["model"]["vocab"]
        end = spec["model"]["end_of_word_suffix"] or ""
        self.path, self.special = path, {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.tokens: dict[int, str] = {i: t for t, i in vocab.items()} | {i: t for t, i in self.special.items()}
        chars = byte_chars()
        self.inner = np.array([vocab[c] for c in chars], np.int32)
        self.last = np.array([vocab[c + end] for c in chars], np.int32)
        self.to_byte = {c: b for b, c in enumerate(chars)}
        pairs = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in spec["model"]["merges"]]
        keys = np.array([(vocab[a] << 32) | vocab[b] for a, b in pairs], np.int64)
        self.made = np.array([vocab[a + b] for a, b in pairs], np.int32)
        self.slots, self.slot_ranks = np.full(1 << BITS, EMPTY, np.uint64), np.full(1 << BITS, INF, np.int32)
        for r, k in enumerate(keys.tolist()):
            s = ((k * int(HASH)) & (2**64 - 1)) >> (64 - BITS)
            while self.slots[s] != EMPTY:
                s = (s + 1) & (len(self.slots) - 1)
            self.slots[s], self.slot_ranks[s] = k, r
        self.rank_of = {int(k): r for r, k in enumerate(keys.tolist())}
        self.split_special = re.compile("(" + "|".join(map(re.escape, self.special)) + ")") if self.special else None
        self.kind = _kinds()
        self.lower = np.arange(PLAIN, dtype=np.uint16)
        for c in range(PLAIN):
            low = chr(c).lower()
            if len(low) > 1 or ord(low) >= PLAIN:
                self.kind[c] = ODD
            else:
                self.lower[c] = ord(low)
        rng = np.random.default_rng(7)
        self.mix = rng.integers(1, 2**63, PLAIN, dtype=np.uint64)
        self.power = np.empty(0, np.uint64)

    # ------------------------------------------------------------------ words
    def _plain(self, joined: str) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray] | None:
        """Start and end of each word of a text, a 64-bit hash of each, and the text's code points in lower case; None if
        not plain."""
        code = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
        if code.max() >= PLAIN:
            return None
        code = self.lower[code]
        kind = self.kind[code]
        if (kind == ODD).any():
            return None
        start = np.empty(len(code), bool)
        start[0] = True
        np.not_equal(kind[1:], kind[:-1], out=start[1:])
        start |= kind == NUMBER
        quote = np.flatnonzero((code[:-1] == 39) & start[:-1] & (kind[1:] == LETTER))
        if len(quote):
            pad = np.concatenate([code, np.zeros(3, np.uint16)])
            a, b = pad[quote + 1], pad[quote + 2]
            one = np.isin(a, [ord(c) for c in "stmd"])
            two = ((a == ord("r")) & (b == ord("e"))) | ((a == ord("v")) & (b == ord("e"))) | ((a == ord("l")) & (b == ord("l")))
            n = np.where(one, 1, np.where(two, 2, 0))
            hit, n = quote[n > 0], n[n > 0]
            start[hit + 1] = False
            after = hit + 1 + n
            start[after] |= kind[after] == LETTER
        at = np.flatnonzero(start)
        ends = np.append(at[1:], len(code))
        real = kind[at] != SPACE
        at, ends = at[real], ends[real]
        if len(self.power) < len(code):
            base, m = 0x9E3779B97F4A7C15, max(len(code), 1 << 20)
            self.power = np.cumprod(np.full(m, base, np.uint64), dtype=np.uint64)
            self.unpower = np.cumprod(np.full(m, pow(base, -1, 2**64), np.uint64), dtype=np.uint64)
        total = np.zeros(len(code) + 1, np.uint64)
        np.cumsum(self.mix[code] * self.power[: len(code)], out=total[1:])
        key = (total[ends] - total[at]) * self.unpower[at] + (ends - at).astype(np.uint64)
        return at, ends, key, code

    def _other(self, text: str) -> list[bytes]:
        """Words of any text, by the tokenizer file's own normaliser and splitter; special tokens are words too."""
        from tokenizers import Tokenizer

        if not hasattr(self, "library"):
            self.library = Tokenizer.from_file(self.path)
        out: list[bytes] = []
        for part in self.split_special.split(text) if self.split_special else [text]:
            if part in self.special:
                out.append(SPECIAL + part.encode())
            elif part:
                norm = self.library.normalizer.normalize_str(part)
                out += [bytes(map(self.to_byte.__getitem__, w)) for w, _ in self.library.pre_tokenizer.pre_tokenize_str(norm)]
        return out

    def runs(self, texts: list[str], most: int = 1 << 19) -> Iterator[tuple[list[str] | list[bytes], list[np.ndarray]]]:
        """For runs of texts, in order: the distinct words, and for each text the numbers of its words."""
        i = 0
        while i < len(texts):
            j, size = i, 0
            while j < len(texts) and (j == i or size + len(texts[j]) <= most):
                size += len(texts[j]) + 1
                j += 1
            joined = "\n".join(texts[i:j]) + "\n"
            plain = None if any(x in joined for x in self.special) else self._plain(joined)
            if plain:
                at, ends, key, code = plain
                words, inv = _distinct(at, ends, key, code)
                bounds = np.searchsorted(at, np.concatenate([[0], np.cumsum([len(t) + 1 for t in texts[i:j]])]))
                yield words, [inv[bounds[k] : bounds[k + 1]] for k in range(j - i)]
            elif j - i > 1:
                half = (i + j) // 2
                yield from self.runs(texts[i:half], most)
                yield from self.runs(texts[half:j], most)
            else:
                found = self._other(texts[i])
                number = {w: k for k, w in enumerate(dict.fromkeys(found))}
                yield list(number), [np.fromiter(map(number.__getitem__, found), np.int64, len(found))]
            i = j

    # ----------------------------------------------------------------- merges
    def _rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The rank of each pair, by open addressing; INF for none."""
        key = (a.astype(np.uint64) << np.uint64(32)) | b.astype(np.uint64)
        slot = ((key * HASH) >> np.uint64(64 - BITS)).astype(np.int64)
        held = self.slots[slot]
        out = np.where(held == key, self.slot_ranks[slot], INF)
        more = np.flatnonzero(((held != key) & (held != EMPTY)).reshape(-1))
        if len(more):
            flat, slot, key = out.reshape(-1), slot.reshape(-1), key.reshape(-1)
            slot, key = slot[more], key[more]
            while len(more):
                slot = (slot + 1) & (len(self.slots) - 1)
                held = self.slots[slot]
                flat[more] = np.where(held == key, self.slot_ranks[slot], INF)
                go = (held != key) & (held != EMPTY)
                more, slot, key = more[go], slot[go], key[go]
        return out

    def _rows(self, ids: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Merges a matrix of words of one length; yields (rows, their final ids)."""
        rows = np.arange(len(ids))
        ranks = self._rank(ids[:, :-1], ids[:, 1:])
        while True:
            n = ids.shape[1]
            if n == 1:
                yield rows, ids
                return
            at = ranks.argmin(axis=1)
            r = ranks[np.arange(len(rows)), at]
            done = r == INF
            if done.any():
                yield rows[done], ids[done]
                go = ~done
                rows, ids, ranks, at, r = rows[go], ids[go], ranks[go], at[go], r[go]
            if not len(rows):
                return
            i = np.arange(len(rows))
            ids[i, at] = self.made[r]
            keep = np.arange(n - 1)[None, :]
            ids = np.take_along_axis(ids, keep + (keep > at[:, None]), axis=1)  # the boundary after `at` goes
            if n == 2:
                yield rows, ids
                return
            keep = keep[:, :-1]
            ranks = np.take_along_axis(ranks, keep + (keep >= at[:, None]), axis=1)
            left, right = at > 0, at < n - 2
            p = at[left] - 1
            ranks[i[left], p] = self._rank(ids[i[left], p], ids[i[left], p + 1])
            p = at[right]
            ranks[i[right], p] = self._rank(ids[i[right], p], ids[i[right], p + 1])

    def _long(self, word: bytes) -> list[int]:
        ids = [int(x) for x in self.inner[list(word)]]
        ids[-1] = int(self.last[word[-1]])
        n = len(ids)
        prev, nxt, alive = list(range(-1, n - 1)), list(range(1, n + 1)), [True] * n
        rank = lambda i: self.rank_of.get((ids[i] << 32) | ids[nxt[i]]) if nxt[i] < n else None
        heap = [(r, i, ids[i], ids[nxt[i]]) for i in range(n) if (r := rank(i)) is not None]
        heapq.heapify(heap)
        while heap:
            r, i, a, b = heapq.heappop(heap)
            if not alive[i] or nxt[i] >= n or ids[i] != a or ids[nxt[i]] != b:
                continue
            j = nxt[i]
            ids[i], alive[j], nxt[i] = int(self.made[r]), False, nxt[j]
            if nxt[j] < n:
                prev[nxt[j]] = i
            for k in (prev[i], i):
                if k >= 0 and (q := rank(k)) is not None:
                    heapq.heappush(heap, (q, k, ids[k], ids[nxt[k]]))
        return [x for x, ok in zip(ids, alive) if ok]

    def merge(self, words: list[bytes]) -> list[tuple[int, ...]]:
        out: list = [()] * len(words)
        by: dict[int, list[int]] = {}
        for i, w in enumerate(words):
            if w[:1] == SPECIAL:
                out[i] = (self.special[w[1:].decode()],)
            elif len(w) > SHORT:
                out[i] = tuple(self._long(w))
            else:
                by.setdefault(len(w), []).append(i)
        for n, at in by.items():
            raw = np.frombuffer(b"".join([words[i] for i in at]), np.uint8).reshape(-1, n)
            ids = self.inner[raw]
            ids[:, -1] = self.last[raw[:, -1]]
            for rows, done in self._rows(ids):
                for r, x in zip(rows.tolist(), zip(*done.T.tolist())):
                    out[at[r]] = x
        return out

    def decode(self, ids: list[int]) -> str:
        """The file names no decoder: the tokens' strings with a space between."""
        return " ".join(map(self.tokens.__getitem__, ids))


class Cached:
    """What `render` makes of the ids of each word, kept for the words met last, by the word itself."""

    def __init__(self, model: WordBPE, render: Callable[[tuple[int, ...]], object], most: int = 200_000):
        self.model, self.render, self.most, self.kept = model, render, most, {}

    def __call__(self, runs: Iterator[tuple]) -> Iterator[tuple[list, list[np.ndarray]]]:
        """For runs of texts what is made of each distinct word, and the numbers of each text's words. Words that are
        new in several runs are merged together."""
        while group := list(itertools.islice(runs, 3)):
            if len(self.kept) > self.most:
                self.kept.clear()
            held = [list(map(self.kept.get, words)) for words, _ in group]
            new = list({words[i] for x, (words, _) in zip(held, group) for i, y in enumerate(x) if y is None})
            made = dict(zip(new, map(self.render, self.model.merge([w.encode() if isinstance(w, str) else w for w in new]))))
            self.kept.update(made)
            for x, (words, docs) in zip(held, group):
                yield [made[words[i]] if y is None else y for i, y in enumerate(x)], docs
            for w, x in made.items():
                if len(x[-1]) >= 512 or len(w) >= 512:
                    del self.kept[w]


_KEPT: dict[tuple[str, str], Cached] = {}


def cached(path: str, name: str, render: Callable[[WordBPE], Callable[[tuple[int, ...]], object]]) -> Cached:
    """One cache for each process, so that later tasks of a worker find what earlier ones met."""
    if (path, name) not in _KEPT:
        model = WordBPE(path)
        _KEPT[path, name] = Cached(model, render(model))
    return _KEPT[path, name]


def _cut(texts: list[str], most: int = 1 << 20) -> tuple[list[str], list[int]]:
    """Texts in parts of about most characters, cut before a space, and the number of parts of each. No word or special
    token holds a space, so the ids of a text are those of its parts one after the other."""
    parts, number = [], []
    for t in texts:
        at, n = 0, len(parts)
        while len(t) - at > 2 * most and (end := t.find(" ", at + most)) >= 0:
            parts.append(t[at:end])
            at = end
        parts.append(t[at:] if at else t)
        number.append(len(parts) - n)
    return parts, number


def id_bytes(texts: list[str], path: str) -> Iterator[bytes]:
    """For each text its ids as little-endian unsigned 32-bit integers."""
    pack = {n: struct.Struct(f"<{n}I").pack for n in range(1, SHORT + 1)}
    cache = cached(path, "bytes", lambda _: lambda ids: (pack[len(ids)](*ids) if len(ids) <= SHORT else struct.pack(f"<{len(ids)}I", *ids),))

    def each() -> Iterator[bytes]:
        for made, docs in cache(cache.model.runs(parts)):
            blob = [x for (x,) in made]
            for inv in docs:
                yield b"".join(map(blob.__getitem__, inv.tolist()))

    parts, number = _cut(texts)
    found = each()
    for n in number:
        yield next(found) if n == 1 else b"".join(itertools.islice(found, n))


def encode(texts: list[str], path: str) -> list[list[int]]:
    return [np.frombuffer(b, "<u4").tolist() for b in id_bytes(texts, path)]


def encoded(texts: list[str], path: str) -> Iterator[tuple[int, bytes, bytes]]:
    """For each text: the number of ids, the decimal ids joined by spaces, the decoded text in UTF-8."""

    def make(model: WordBPE):
        size = max(model.tokens) + 1
        number, token = [str(i).encode() for i in range(size)], [model.tokens.get(i, "").encode() for i in range(size)]
        return lambda ids: (len(ids), b" ".join([number[i] for i in ids]), b" ".join([token[i] for i in ids]))

    cache = cached(path, "text", make)

    def each() -> Iterator[tuple[int, bytes, bytes]]:
        for made, docs in cache(cache.model.runs(parts)):
            n, ids, text = zip(*made) if made else ((), (), ())
            count = np.array(n, np.int64)
            for inv in docs:
                row = inv.tolist()
                yield int(count[inv].sum()) if row else 0, b" ".join(map(ids.__getitem__, row)), b" ".join(map(text.__getitem__, row))

    parts, number = _cut(texts)
    found = each()
    for n in number:
        if n == 1:
            yield next(found)
        else:
            held = [x for x in itertools.islice(found, n) if x[0]]
            yield sum(x[0] for x in held), b" ".join(x[1] for x in held), b" ".join(x[2] for x in held)


DIGESTS = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])


def encode_digests(docs: DataFrame, path: str) -> DataFrame:
    """Per document the number of its ids and digests of the ids and of the text decoded from them. No shuffle."""

    def run(batches):
        hexed = lambda b: hashlib.sha256(b).hexdigest()
        for b in slices(batches):
            out = [(n, hexed(i), hexed(t)) for n, i, t in encoded(b.column(1).to_pylist(), path)]
            cols = list(zip(*out)) if out else [[], [], []]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.string()), pa.array(cols[2], pa.string())], schema=DIGESTS)

    return documents(docs).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
