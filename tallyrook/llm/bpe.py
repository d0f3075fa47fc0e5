"""BPE encoding by a walk over the trie of distinct words, and decoding.

What makes one visit per trie node enough: the canonical encoding of a byte string is
fixed by its *last token* and the encoding of what precedes that token. So the state of
a node (a prefix) is one token id; the state of a child follows from the states on its
path, and prefixes that several words share are encoded once. A candidate last token t
of a prefix is right exactly if it may stand after the last token of the rest, that is,
if merging that pair from its bytes in rank order gives back the pair.

Sorted words give the trie's nodes in depth-first order (what a word shares with the one
before it are nodes that exist). States go from parents to children for all branches at
once, a level at a time, as numpy arrays; words that are too long for that are walked
depth-first one by one.
"""

from __future__ import annotations

import json
import re
from array import array
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex

from .words import U, chunks, gathered, hash_ranges

# The white space of the tokenizer's pattern, and the pattern itself.
_WS = "\t-\r \x85\xa0  -     　"
LEVELS = 64  # words of more bytes are walked one by one
_OTHER, _LETTER, _DIGIT, _WHITE = range(4)


def byte_alphabet() -> dict[str, int]:
    """The character that stands for each byte in byte-level vocabularies: printable
    Latin-1 for itself, the others from U+0100 on, in order."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


@lru_cache(maxsize=1)
def _kinds() -> np.ndarray:
    """The kind of each code point, as the pattern's classes say."""
    text = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    out = np.zeros(0x110000, np.uint8)
    for kind, pattern in ((_LETTER, r"\p{L}+"), (_DIGIT, r"\p{N}+"), (_WHITE, f"[{_WS}]+")):
        for m in regex.finditer(pattern, text):
            a, b = ord(text[m.start()]), ord(text[m.end() - 1])
            out[a : b + 1] = kind
    out[0xD800:0xE000] = _OTHER
    return out


def _kinds_of(buf: np.ndarray) -> np.ndarray:
    """The kind of the character that each byte belongs to."""
    table, n = _kinds(), len(buf)
    kind = table[:256][buf]
    lead = np.flatnonzero(buf >= 0xC0)
    if len(lead):
        b = buf[lead].astype(np.int32)
        size = 2 + (b >= 0xE0) + (b >= 0xF0)
        code = np.where(size == 2, b & 31, np.where(size == 3, b & 15, b & 7))
        for k in (1, 2, 3):
            more = size > k
            code[more] = code[more] << 6 | buf[np.minimum(lead[more] + k, n - 1)] & 0x3F
        of = table[np.minimum(code, 0x10FFFF)]
        kind[lead] = of
        for k in (1, 2, 3):
            more = (size > k) & (lead + k < n)
            kind[lead[more] + k] = of[more]
    return kind


def word_starts(buf: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """Where the words of the tokenizer's pattern begin; each goes on to the next one. edges:
    rising places where texts begin and end, from 0 to the buffer's length.

    Words are runs of letters, digits, white space or others. A space before a run of
    other than white space belongs to that run, and so do s, t, re, ve, m, ll, d to an
    apostrophe that stands alone; other white space before a run gives its last character
    as a word of its own."""
    n = len(buf)
    if not n:
        return np.zeros(0, np.int64)
    kind = _kinds_of(buf)
    edge = np.zeros(n + 1, bool)
    edge[edges] = True
    begin = edge[:n].copy()
    begin[1:] |= kind[1:] != kind[:-1]
    run = np.flatnonzero(begin)
    end = np.append(run[1:], n)
    goes_on = ~edge[end]
    white = np.flatnonzero((kind[run] == _WHITE) & goes_on)
    last = end[white] - 1
    space = buf[last] == 32
    begin[end[white[space]]] = False
    begin[last[space]] = True
    last = last[~space]
    while (inside := (buf[last] & 0xC0) == 0x80).any():
        last = last - inside
    begin[last] = True
    q = run[np.flatnonzero((buf[run] == 39) & (end - run == 1) & goes_on)]
    q = q[begin[q] & (kind[np.minimum(q + 1, n - 1)] == _LETTER)]
    a, b = buf[q + 1], np.where(edge[q + 2], 0, buf[np.minimum(q + 2, n - 1)])
    one = np.isin(a, np.frombuffer(b"stmd", np.uint8))
    two = ((a == 114) | (a == 118)) & (b == 101) | (a == 108) & (b == 108)
    begin[(q + 1)[one | two]] = False
    then = np.concatenate([(q + 2)[one], (q + 3)[two]])
    begin[then[then < n]] = True
    return np.flatnonzero(begin)


def _distinct(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(for each value its number among the distinct ones, the first place of each)."""
    of = np.asarray(pa.array(h).dictionary_encode().indices, np.int64)
    top = np.maximum.accumulate(of) if len(of) else of
    return of, np.flatnonzero(np.r_[True, top[1:] > top[:-1]]) if len(of) else of


class TrieBPE:
    """Encodes and decodes with a byte-level BPE file of the tokenizers library.

    `limit` bounds the words that are remembered between buffers: what was not met lately
    is forgotten first. That costs time and changes no result.
    """

    def __init__(self, path: str, limit: int = 300_000):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        alphabet = byte_alphabet()
        as_bytes = lambda s: bytes(alphabet[c] for c in s)
        vocab, merges = spec["model"]["vocab"], spec["model"]["merges"]
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        token_bytes = {i: as_bytes(s) for s, i in vocab.items() if s not in self.special}
        token_bytes |= {i: s.encode() for s, i in self.special.items()}
        self.size = max(token_bytes) + 1
        spelt = [token_bytes.get(i, b"") for i in range(self.size)]
        self.token_size = np.fromiter(map(len, spelt), np.int64, self.size)
        self.token_first = np.cumsum(self.token_size) - self.token_size
        self.token_data = np.frombuffer(b"".join(spelt), np.uint8)
        # rank: the order of merges; a single byte ranks below every merge
        made: dict[tuple[int, int], tuple[int, int]] = {}
        self.rank_of, self.left, self.right = np.full(self.size, -1), np.zeros(self.size, np.int64), np.zeros(self.size, np.int64)
        for rank, m in enumerate(merges):
            a, b = m.split(" ") if isinstance(m, str) else m
            t = vocab[a + b]
            made.setdefault((vocab[a], vocab[b]), (rank, t))
            if self.rank_of[t] < 0:
                self.rank_of[t], self.left[t], self.right[t] = rank, vocab[a], vocab[b]
        pairs = np.array([a * self.size + b for a, b in made], np.int64)
        order = np.argsort(pairs)
        self.pairs, self.pair_rank = np.append(pairs[order], 1 << 62), np.append(np.array([r for r, _ in made.values()], np.int64)[order], 0)
        ordinary = {s: i for i, s in token_bytes.items() if i not in self.special.values() and (len(s) == 1 or self.rank_of[i] >= 0)}
        single = {s[0]: i for s, i in ordinary.items() if len(s) == 1}
        # tokens that merging their own bytes gives: both parts are such, and no merge across them comes before
        l, r = self.left, self.right
        early = np.maximum(self.rank_of[l], self.rank_of[r]) < self.rank_of
        whole = np.where(early, self.may_follow(l, r, 2 * self.rank_of), False).tolist()
        sound = np.isin(np.arange(self.size), list(single.values())).tolist()
        for t in np.argsort(self.rank_of, kind="stable")[np.count_nonzero(self.rank_of < 0) :].tolist():
            sound[t] = sound[l[t]] and sound[r[t]] and whole[t] if early[t] else _merged(token_bytes[t], single, made) == [t]
        self._automaton({s: i for s, i in ordinary.items() if sound[i]})
        self.fit_key, self.fit = np.full(1 << 20, -1, np.int64), np.zeros(1 << 20, bool)  # pairs that were looked at, by hash
        self.scalar: dict | None = None
        self.limit, self.tick = limit, 0
        self.known = {"hash": np.zeros(0, U), "at": np.zeros(0, np.int64), "size": np.zeros(0, np.int64), "first": np.zeros(0, np.int64), "many": np.zeros(0, np.int64), "met": np.zeros(0, np.int64)}
        self.known_bytes, self.known_ids = np.zeros(0, np.uint8), np.zeros(0, np.int32)
        self._split = re.compile(b"|".join(re.escape(x.encode()) for x in sorted(self.special, key=len, reverse=True))) if self.special else None

    def _automaton(self, tokens: dict[bytes, int]) -> None:
        """A state for every beginning of a token, numbered by level. longest: the state of
        the longest token that ends there; shorter: of a token's state, the next shorter
        one. A token that merging its own bytes does not give is not among them."""
        size, ids = np.fromiter(map(len, tokens), np.int64, len(tokens)), np.fromiter(tokens.values(), np.int64, len(tokens))
        data, start = np.frombuffer(b"".join(tokens), np.uint8), np.cumsum(size) - size
        at, live = np.zeros(len(ids), np.int64), np.arange(len(ids))
        self.edges, self.shallow = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.back, self.token = np.zeros(1, np.int64), np.full(1, -1)
        self.longest, self.shorter = np.zeros(1, np.int64), np.zeros(1, np.int64)
        d = 0
        while len(live):
            key, inverse = np.unique(at[live] << 8 | data[start[live] + d], return_inverse=True)
            base = len(self.back)
            back = self.step(self.back[key >> 8], key & 255) if d else np.zeros(len(key), np.int64)
            if d < 2:  # all steps of the root and of the first level, also where no token goes on
                dense = np.zeros((base + (len(key) if d else 0), 256), np.int64)
                dense[: len(self.shallow) >> 8] = self.shallow.reshape(-1, 256)
                if d:
                    dense[1:base] = dense[0]
                dense[key >> 8, key & 255] = base + np.arange(len(key))
                self.shallow = dense[:base].ravel()
            at[live] = base + inverse
            token = np.full(len(key), -1)
            done = live[size[live] == d + 1]
            token[at[done] - base] = ids[done]
            self.edges = np.concatenate([self.edges, key])
            self.back, self.token = np.concatenate([self.back, back]), np.concatenate([self.token, token])
            self.shorter = np.concatenate([self.shorter, self.longest[back]])
            self.longest = np.concatenate([self.longest, np.where(token >= 0, base + np.arange(len(key)), self.longest[back])])
            live, d = live[size[live] > d + 1], d + 1
        self.edges = np.append(self.edges, 1 << 62)
        self.length = np.where(self.token >= 0, self.token_size[self.token], 0)

    def step(self, state: np.ndarray, byte: np.ndarray) -> np.ndarray:
        """The states after these bytes (edges are numbered as the states they lead to)."""
        out, todo = np.zeros(len(state), np.int64), np.arange(len(state))
        near = len(self.shallow) >> 8
        state = state.copy()
        while len(todo):
            flat = state[todo] < near
            i = todo[flat]
            out[i] = self.shallow[state[i] << 8 | byte[i]]
            todo = todo[~flat]
            key = state[todo] << 8 | byte[todo]
            k = np.searchsorted(self.edges, key)
            hit = self.edges[np.minimum(k, len(self.edges) - 1)] == key
            out[todo[hit]] = k[hit] + 1
            todo = todo[~hit]
            state[todo] = self.back[state[todo]]
        return out

    def may_follow(self, left: np.ndarray, right: np.ndarray, limit: np.ndarray | None = None) -> np.ndarray:
        """Does merging the bytes of left + right in rank order end in exactly this pair?
        Undo the later of the two merges step by step: a pair at the border that would have
        merged before either side was complete makes the split impossible. limit: only
        merges of a rank below half of it count."""
        ok, live = np.ones(len(left), bool), np.arange(len(left))
        l, r, limit = left.copy(), right.copy(), np.full(len(left), 1 << 62) if limit is None else limit.copy()
        while len(live):
            key = l[live] * self.size + r[live]
            k = np.searchsorted(self.pairs, key)
            merged = (self.pairs[k] == key) & (2 * self.pair_rank[k] < limit[live])
            ok[live[merged]] = False
            rl, rr = self.rank_of[l[live]], self.rank_of[r[live]]
            go = ~merged & ((rl >= 0) | (rr >= 0))
            live, rl, rr = live[go], rl[go], rr[go]
            # the side with the later merge is taken apart. On equal rank the right one was made last, and the
            # border, which stands before it, would have come first; left of it, it would have come later
            a = rl > rr
            limit[live] = np.where(a, 2 * rl, 2 * rr + 1)
            l[live[a]] = self.right[l[live[a]]]
            r[live[~a]] = self.left[r[live[~a]]]
        return ok

    def fits(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """may_follow, with a memory."""
        key = left * self.size + right
        slot = (key.view(U) * U(0x9E3779B97F4A7C15) >> U(44)).astype(np.int64)
        ok, miss = self.fit[slot], np.flatnonzero(self.fit_key[slot] != key)
        if len(miss):
            new, inverse = np.unique(key[miss], return_inverse=True)
            found = self.may_follow(new // self.size, new % self.size)
            ok[miss] = found[inverse]
            slot = (new.view(U) * U(0x9E3779B97F4A7C15) >> U(44)).astype(np.int64)
            self.fit_key[slot] = new
            self.fit[slot] = found[np.searchsorted(new, self.fit_key[slot])]  # of pairs with one slot, one stays
        return ok

    def _walk(self, data: np.ndarray, start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all words one after another, how many each has) of distinct words of at
        most LEVELS bytes."""
        n, width = len(start), 24
        place = np.arange(width)
        head = np.where(place < size[:, None], data[np.minimum(start[:, None] + place, max(0, len(data) - 1))], 0).astype(np.uint8)
        order = np.lexsort(head.view(">u8").T[::-1])
        head, start, size = head[order], start[order], size[order]
        differ = head[1:] != head[:-1]
        shared = np.r_[0, np.minimum(np.where(differ.any(1), differ.argmax(1), width), np.minimum(size[1:], size[:-1]))]
        at = np.cumsum(size) - size
        flat = gathered(data, start, size).astype(np.int64)
        state, last, many = (np.zeros(len(flat), np.int64) for _ in range(3))
        live = np.arange(n)
        for d in range(int(size.max(initial=0))):
            live = live[size[live] > d]
            p = at[live] + d
            own = shared[live] <= d
            q = p[own]
            s = self.step(state[q - 1] if d else np.zeros(len(q), np.int64), flat[q])
            c, count = self.longest[s], np.ones(len(q), np.int64)
            todo = np.flatnonzero(self.length[c] <= d)  # the others are one token so far
            while len(todo):
                before = q[todo] - self.length[c[todo]]
                ok = self.fits(last[before], self.token[c[todo]])
                count[todo[ok]] += many[before[ok]]
                todo = todo[~ok]
                c[todo] = self.shorter[c[todo]]
            state[q], last[q], many[q] = s, self.token[c], count
            if len(q) < len(p):
                node = p[np.maximum.accumulate(np.where(own, np.arange(len(p)), 0))]
                state[p], last[p], many[p] = state[node], last[node], many[node]
        p, total = at + size - 1, many[at + size - 1]
        back = np.empty(n, np.int64)
        back[order] = np.arange(n)
        of = total[back]
        first = (np.cumsum(of) - of)[order]
        ids, left, live = np.empty(int(total.sum()), np.int32), total.copy(), np.arange(n)
        while len(live):
            t = last[p[live]]
            left[live] -= 1
            ids[first[live] + left[live]] = t
            p[live] -= self.token_size[t]
            live = live[left[live] > 0]
        return ids, of

    def _one_by_one(self, words: Iterable[bytes]) -> dict[bytes, list[int]]:
        """The encodings of long words, depth-first: the lists are the path to the node."""
        if self.scalar is None:
            self.scalar = {"go": dict(zip(self.edges[:-1].tolist(), range(1, len(self.edges)), strict=True)), "fits": {}} | {k: getattr(self, k).tolist() for k in ("back", "longest", "shorter", "token", "length")}
        go, fits, back, longest, shorter, token, length = (self.scalar[k] for k in ("go", "fits", "back", "longest", "shorter", "token", "length"))
        if len(fits) > 300_000:
            fits.clear()
        out: dict[bytes, list[int]] = {}
        state: list[int] = []
        path: list[int] = []  # the token state that ends at each byte
        before = b""
        for w in sorted(words):
            d = 0
            while d < min(len(w), len(before)) and w[d] == before[d]:
                d += 1
            del state[d:], path[d:]
            for b in w[d:]:
                d += 1
                s = state[-1] if d > 1 else 0
                while (to := go.get(s << 8 | b)) is None and s:
                    s = back[s]
                state.append(s := to or 0)
                c = longest[s]
                while length[c] < d:
                    pair = (token[path[d - length[c] - 1]], token[c])
                    if pair not in fits:
                        fits[pair] = bool(self.may_follow(np.array(pair[:1]), np.array(pair[1:]))[0])
                    if fits[pair]:
                        break
                    c = shorter[c]
                path.append(c)
            ids, d = [], len(w)
            while d:
                ids.append(token[path[d - 1]])
                d -= length[path[d - 1]]
            out[w], before = ids[::-1], w
        return out

    def encode_words(self, data: np.ndarray, start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all words one after another, how many each has) of distinct words
        data[start : start + size], without the memory of earlier ones."""
        short = size <= LEVELS
        if short.all():
            return self._walk(data, start, size)
        ids, many = self._walk(data, start[short], size[short])
        long = [data[a : a + n].tobytes() for a, n in zip(start[~short].tolist(), size[~short].tolist(), strict=True)]
        found = self._one_by_one(long)
        parts = [np.array(found[w], np.int32) for w in long]
        first, count = np.zeros(len(size), np.int64), np.zeros(len(size), np.int64)
        count[short], count[~short] = many, [len(x) for x in parts]
        both = np.concatenate([ids, *parts])
        held = np.concatenate([many, count[~short]])
        place = np.cumsum(held) - held
        first[short], first[~short] = place[: len(many)], place[len(many) :]
        return gathered(both, first, count), count

    def _codes(self, data: np.ndarray, start: np.ndarray, size: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids, first, many): the encodings of distinct words, those that are known from memory."""
        k, self.tick = self.known, self.tick + 1
        i = np.searchsorted(k["hash"], h)
        i[i == len(k["hash"])] = 0
        there = (k["hash"][i] == h) & (k["size"][i] == size) if len(k["hash"]) else np.zeros(len(h), bool)
        hit = np.flatnonzero(there)
        n = size[hit]
        differ = gathered(data, start[hit], n) != gathered(self.known_bytes, k["at"][i[hit]], n)
        if differ.any():  # another word with this hash
            there[hit[np.unique(np.repeat(np.arange(len(hit)), n)[differ])]] = False
            hit = np.flatnonzero(there)
        k["met"][i[hit]] = self.tick
        new = np.flatnonzero(~there)
        ids, many_new = self.encode_words(data, start[new], size[new])
        first, many = np.empty(len(h), np.int64), np.empty(len(h), np.int64)
        first[hit], many[hit] = k["first"][i[hit]], k["many"][i[hit]]
        first[new], many[new] = len(self.known_ids) + np.cumsum(many_new) - many_new, many_new
        both = np.concatenate([self.known_ids, ids])
        fresh = new[(size[new] <= LEVELS) & (k["hash"][i[new]] != h[new])] if len(k["hash"]) else new[size[new] <= LEVELS]
        self._remember(data, start[fresh], size[fresh], h[fresh], both, first[fresh], many[fresh])
        return both, first, many

    def _remember(self, data: np.ndarray, start: np.ndarray, size: np.ndarray, h: np.ndarray, ids: np.ndarray, first: np.ndarray, many: np.ndarray) -> None:
        k = self.known
        more = {"hash": h, "at": len(self.known_bytes) + np.cumsum(size) - size, "size": size, "first": len(self.known_ids) + np.cumsum(many) - many, "many": many, "met": np.full(len(h), self.tick)}
        self.known_bytes = np.concatenate([self.known_bytes, gathered(data, start, size)])
        self.known_ids = np.concatenate([self.known_ids, gathered(ids, first, many)])
        whole = {c: np.concatenate([k[c], more[c]]) for c in k}
        order = np.argsort(whole["hash"], kind="stable")
        if len(order) > self.limit:
            lately = np.partition(whole["met"], len(order) - self.limit // 2)[len(order) - self.limit // 2]
            order = order[whole["met"][order] >= lately]
        self.known = k = {c: v[order] for c, v in whole.items()}
        if len(order) < len(whole["met"]):
            self.known_bytes, self.known_ids = gathered(self.known_bytes, k["at"], k["size"]), gathered(self.known_ids, k["first"], k["many"])
            k["at"], k["first"] = np.cumsum(k["size"]) - k["size"], np.cumsum(k["many"]) - k["many"]

    def _marks(self, buf: np.ndarray, offsets: np.ndarray) -> list[tuple[int, int, int]]:
        """(start, end, id) of the special tokens in the texts."""
        out, at = [], 0
        data = buf.tobytes() if self._split else b""
        while self._split and (m := self._split.search(data, at)):
            inside = np.searchsorted(offsets, m.start(), "right") == np.searchsorted(offsets, m.end(), "left")
            if inside:
                out.append((m.start(), m.end(), self.special[m[0].decode()]))
            at = m.end() if inside else m.start() + 1
        return out

    def encode_buffer(self, buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, offsets of each text's ids) of texts buf[offsets[i]:offsets[i + 1]].

        Equal words are found by hashes over the whole buffer, and what was found is
        compared byte by byte; each distinct word is encoded once."""
        marks = self._marks(buf, offsets)
        start = word_starts(buf, np.r_[offsets, [x for a, b, _ in marks for x in (a, b)]].astype(np.int64))
        size = np.diff(np.r_[start, len(buf)])
        h = hash_ranges(buf, start, start + size)
        of, rep = _distinct(h)
        same = bool((size[rep][of] == size).all())
        if same and len(buf):
            same = bool((gathered(buf, start[rep][of], size) == buf[start[0] :]).all())
        if not same:  # two words with one hash
            numbers: dict[bytes, int] = {}
            data = buf.tobytes()
            of = np.array([numbers.setdefault(data[a : a + n], len(numbers)) for a, n in zip(start.tolist(), size.tolist(), strict=True)], np.int64)
            rep = np.unique(of, return_index=True)[1]
            ids, many = self.encode_words(buf, start[rep], size[rep])
            first = np.cumsum(many) - many
        else:
            ids, first, many = self._codes(buf, start[rep], size[rep], h[rep])
        first, many = first[of], many[of]
        for a, b, t in marks:
            i, j = np.searchsorted(start, [a, b])
            many[i:j] = 0
            many[i], first[i] = 1, len(ids)
            ids = np.append(ids, np.int32(t))
        cut = np.r_[0, np.cumsum(many)][np.searchsorted(start, offsets)]
        return gathered(ids, first, many), cut

    def encode_chunks(self, buf: np.ndarray, offsets: np.ndarray, size: int = 1 << 21) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """encode_buffer of runs of texts of about `size` bytes, in order."""
        for i, j in chunks(offsets, size):
            yield self.encode_buffer(buf[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])

    def encode_many(self, texts: list[str | None]) -> Iterator[bytes]:
        """The ids of each text as 32-bit integers in machine order."""
        data = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
        for ids, cut in self.encode_chunks(np.frombuffer(b"".join(data), np.uint8), np.r_[0, np.cumsum([len(d) for d in data])].astype(np.int64)):
            for a, b in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True):
                yield ids[a:b].astype(np.uint32).tobytes()

    def decode_buffer(self, ids: np.ndarray, cut: np.ndarray) -> Iterator[bytes]:
        """The texts of ids[cut[i]:cut[i + 1]], in UTF-8; bytes that are not UTF-8 become the
        replacement character."""
        size = self.token_size[ids]
        data = gathered(self.token_data, self.token_first[ids], size).tobytes()
        ends = np.r_[0, np.cumsum(size)][cut].tolist()
        for a, b in zip(ends[:-1], ends[1:], strict=True):
            text = data[a:b]
            try:
                text.decode()
            except UnicodeDecodeError:
                text = text.decode("utf-8", "replace").encode()
            yield text

    def decode(self, ids: bytes) -> str:
        """Text of encoded ids; bytes that are not UTF-8 become the replacement character."""
        whole = np.frombuffer(array("I", ids), np.uint32).astype(np.int64)
        return next(self.decode_buffer(whole, np.array([0, len(whole)]))).decode()


def _merged(s: bytes, single: dict[int, int], made: dict[tuple[int, int], tuple[int, int]]) -> list[int]:
    """Plain merging in rank order (only for vocabularies with tokens that rank before their parts)."""
    ids = [single[b] for b in s]
    while len(ids) > 1:
        best = min(((made[p][0], i) for i, p in enumerate(zip(ids, ids[1:])) if p in made), default=None)
        if best is None:
            break
        i = best[1]
        ids[i : i + 2] = [made[ids[i], ids[i + 1]][1]]
    return ids
