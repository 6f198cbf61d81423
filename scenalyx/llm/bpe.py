"""Byte-level BPE by rank-synchronous array merging.

A chunk of text is cut into pre-tokens by array logic on bytes (letters, digits,
other symbols, white space; one leading space joins what follows). Distinct
pre-tokens are held as one ragged array of symbols; in each round every sequence
merges all occurrences of its own lowest-rank pair at once, which equals merging
one by one because a pair that a merge creates always ranks after that merge.
Sequences without a pair leave the array; what survives are the tokens.

A worker keeps the tokens of pre-tokens it has met, up to ``CACHE_ROWS``.
Texts that hold an added token of the vocabulary, special or not, go to the tokenizers
library itself, whose default treatment of such strings then holds. So do all texts
under a file that is not plain (see ``plain``).

With ``library=True`` the merging is left out: the tokenizers library encodes
each distinct pre-token once per worker, and texts are put together from its ids.
"""

from __future__ import annotations

import json
import unicodedata

import numpy as np

from . import kernels as K

CACHE_ROWS = 1_500_000
NO_RANK = np.int32(2**31 - 1)
#: Code points of the White_Space property.
WHITE_SPACE = [*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
#: The endings that an apostrophe splits off.
ENDINGS = (b"s", b"t", b"re", b"ve", b"m", b"ll", b"d")
SPACE, LETTER, DIGIT, OTHER = 0, 1, 2, 3


def _classes() -> np.ndarray:
    out = np.full(0x110000, OTHER, np.uint8)
    for cp in range(0x110000):
        kind = unicodedata.category(chr(cp))[0]
        if kind == "L":
            out[cp] = LETTER
        elif kind == "N":
            out[cp] = DIGIT
    out[WHITE_SPACE] = SPACE
    return out


def byte_letters() -> list[str]:
    """The letter that stands for each byte in a byte-level vocabulary."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    letter, extra = {}, 256
    for b in range(256):
        if b in shown:
            letter[b] = chr(b)
        else:
            letter[b] = chr(extra)
            extra += 1
    return [letter[b] for b in range(256)]


def _merges(model: dict) -> list[tuple[str, str]]:
    return [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]


def plain(spec: dict) -> bool:
    """Whether a file's tokens are those of rank-synchronous merging after the byte-level split.

    Normalizers, other splits, prefixes, suffixes, dropout and words taken whole are
    not; nor are vocabularies that lack a byte or a merge's product, merges that repeat,
    and merges of a part that only a later merge makes.
    """
    model, pre = spec["model"], spec.get("pre_tokenizer") or {}
    if model.get("type") != "BPE" or spec.get("normalizer") is not None or pre.get("type") != "ByteLevel" or pre.get("add_prefix_space", True) or not pre.get("use_regex", True):
        return False
    if any(model.get(k) for k in ("continuing_subword_prefix", "end_of_word_suffix", "ignore_merges", "dropout")):
        return False
    vocab, made = model["vocab"], set()
    if any(x not in vocab for x in byte_letters()):
        return False
    merges = _merges(model)
    late = {a + b for a, b in merges}
    for a, b in merges:
        late_parts = [x for x in (a, b) if x in late and x not in made]
        if late_parts or a not in vocab or b not in vocab or a + b not in vocab:
            return False
        made.add(a + b)
    return len(set(merges)) == len(merges)


class Library:
    """Tokens of whole texts by the tokenizers library."""

    def __init__(self, path: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.width = max(self.tokenizer.get_vocab(with_added_tokens=True).values()) + 1

    def ids(self, text: bytes) -> np.ndarray:
        return np.array(self.tokenizer.encode(text.decode("utf-8", "replace"), add_special_tokens=False).ids, np.int64)

    def encode(self, data, offsets):
        """Token ids of all texts together, and each text's offsets among them."""
        pieces = [self.ids(data[a:b].tobytes()) for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
        at = np.append(0, np.cumsum([len(p) for p in pieces])).astype(np.int64)
        return (np.concatenate(pieces) if pieces else np.zeros(0, np.int64)).astype(np.int32), at

    def count(self, data, offsets) -> np.ndarray:
        return np.diff(self.encode(data, offsets)[1])


class ByteBpe:
    """Tokens of texts under a plain byte-level BPE vocabulary file of the tokenizers library."""

    def __init__(self, path: str, spec: dict, library: bool = False):
        self.library = library
        vocab = spec["model"]["vocab"]
        self.path = path
        self.special = [t["content"].encode() for t in spec.get("added_tokens", [])]
        self.width = max([*vocab.values(), *(t["id"] for t in spec.get("added_tokens", []))]) + 1
        letter = byte_letters()
        self.byte_id = np.array([vocab[letter[b]] for b in range(256)], np.int32)
        pairs, made = [], []
        for a, b in _merges(spec["model"]):
            pairs.append(vocab[a] << 32 | vocab[b])
            made.append(vocab[a + b])
        self._index(np.array(pairs, np.uint64), np.array(made, np.int32))
        self.classes = _classes()
        self._library = None
        self._reset()

    def _index(self, pairs, made):
        bits = max(20, (4 * len(pairs)).bit_length())
        size, self.shift = 1 << bits, K.U64(64 - bits)
        self.slot_key = np.full(size, 0xFFFFFFFFFFFFFFFF, np.uint64)
        self.slot_rank = np.full(size, NO_RANK, np.int32)
        rank = np.arange(len(pairs), dtype=np.int32)
        at = (K.mix(pairs) >> self.shift).astype(np.int64)
        left = np.arange(len(pairs))
        self.probes = 0
        while len(left):
            self.probes += 1
            free = left[self.slot_key[at[left]] == K.U64(0xFFFFFFFFFFFFFFFF)]
            _, first = np.unique(at[free], return_index=True)
            put = free[first]
            self.slot_key[at[put]], self.slot_rank[at[put]] = pairs[put], rank[put]
            left = np.setdiff1d(left, put)
            at[left] = (at[left] + 1) % size
        self.made = made

    def _rank(self, a, b):
        key = a.astype(np.uint64) << K.U64(32) | b.astype(np.uint64)
        at = (K.mix(key) >> self.shift).astype(np.int64)
        found = self.slot_key[at]
        out = np.where(found == key, self.slot_rank[at], NO_RANK)
        todo = np.flatnonzero((found != key) & (found != K.U64(0xFFFFFFFFFFFFFFFF)))
        for _ in range(self.probes):
            if not len(todo):
                break
            at[todo] = (at[todo] + 1) % len(self.slot_key)
            found = self.slot_key[at[todo]]
            hit = found == key[todo]
            out[todo[hit]] = self.slot_rank[at[todo[hit]]]
            todo = todo[~hit & (found != K.U64(0xFFFFFFFFFFFFFFFF))]
        return out

    def _reset(self):
        self.known = np.zeros(0, np.uint64)
        self.row = np.zeros(0, np.int64)
        self.at = np.zeros(1, np.int64)
        self.ids = np.zeros(0, np.uint16 if self.width <= 1 << 16 else np.int32)

    def starts(self, data, offsets):
        """Begin of every pre-token of a chunk."""
        n = len(data)
        if not n:
            return np.zeros(0, np.int64)
        kind = self.classes[:256][data]
        lead = np.flatnonzero(data >= 0xC0)
        if len(lead):
            wide = np.append(data, np.zeros(3, np.uint8)).astype(np.uint32)
            b0, b1, b2, b3 = (wide[lead + k] for k in range(4))
            two, three = b0 < 0xE0, (b0 >= 0xE0) & (b0 < 0xF0)
            cp = np.where(two, (b0 & 31) << 6 | b1 & 63, np.where(three, (b0 & 15) << 12 | (b1 & 63) << 6 | b2 & 63, (b0 & 7) << 18 | (b1 & 63) << 12 | (b2 & 63) << 6 | b3 & 63))
            k = self.classes[np.minimum(cp, 0x10FFFF)]
            kind[lead] = k
            kind[lead + 1] = k
            kind[lead[~two] + 2] = k[~two]
            four = ~two & ~three
            kind[lead[four] + 3] = k[four]
        head = np.ones(n, bool)
        head[1:] = kind[1:] != kind[:-1]
        inner = offsets[offsets < n]
        head[inner] = True
        start = head.copy()
        begin = np.flatnonzero(head)
        end = np.append(begin[1:], n)
        text_end = np.zeros(n + 1, bool)
        text_end[offsets] = True
        white = kind[begin] == SPACE
        last = end[white] - 1  # last character of each run of white space, at its first byte
        for _ in range(2):
            last = np.where(data[last] & 0xC0 == 0x80, last - 1, last)
        followed = ~text_end[end[white]]
        start[last[followed]] = True
        joined = last[followed & (data[last] == 0x20)] + 1
        start[joined] = False
        mark = begin[~white & (end - begin == 1)]
        mark = mark[(data[mark] == 0x27) & start[mark]]
        if len(mark):
            stop = offsets[np.searchsorted(offsets, mark, "right")]
            wide = np.append(data, np.zeros(2, np.uint8))
            done = np.zeros(len(mark), bool)
            for e in ENDINGS:
                fits = ~done & (mark + 1 + len(e) <= stop)
                for i, c in enumerate(e):
                    fits &= wide[mark + 1 + i] == c
                done |= fits
                after = mark[fits] + 1 + len(e)
                start[mark[fits] + 1] = False
                inside = after[after < n]
                # letters after the ending begin a pre-token; anything else begins one by its own rule
                start[inside[(kind[inside] == LETTER) & ~head[inside]]] = True
        return np.flatnonzero(start)

    def _merge(self, symbols, at):
        """Surviving symbols of ragged sequences: (ids, offsets)."""
        n = len(at) - 1
        length = np.diff(at)
        out_at = np.zeros(n + 1, np.int64)
        done_ids, done_seq = [], []
        seq = np.arange(n)
        sym = symbols
        while len(seq):
            owner = np.repeat(np.arange(len(seq)), length)
            begin = np.cumsum(length) - length
            rank = np.full(len(sym), NO_RANK, np.int32)
            inside = np.ones(len(sym), bool)
            inside[begin + length - 1] = False
            left = np.flatnonzero(inside)
            rank[left] = self._rank(sym[left], sym[left + 1])
            low = np.minimum.reduceat(rank, begin)
            over = low == NO_RANK
            if over.any():
                gone = over[owner]
                done_ids.append(sym[gone])
                done_seq.append(np.repeat(seq[over], length[over]))
                keep = ~gone
                sym, rank = sym[keep], rank[keep]
                seq, length, low = seq[~over], length[~over], low[~over]
                owner = np.repeat(np.arange(len(seq)), length)
                if not len(seq):
                    break
            hit = np.flatnonzero(rank == low[owner])
            # of touching pairs (aaa) every second one from the left
            fresh = np.ones(len(hit), bool)
            fresh[1:] = hit[1:] != hit[:-1] + 1
            lead = np.flatnonzero(fresh)
            odd = (np.arange(len(hit)) - lead[np.cumsum(fresh) - 1]) & 1
            hit = hit[odd == 0]
            sym = sym.copy()
            sym[hit] = self.made[rank[hit]]
            keep = np.ones(len(sym), bool)
            keep[hit + 1] = False
            length = length - np.bincount(owner[hit], minlength=len(seq))
            sym = sym[keep]
        if not done_ids:
            return np.zeros(0, np.int32), out_at
        ids, of = np.concatenate(done_ids), np.concatenate(done_seq)
        order = np.argsort(of, kind="stable")
        np.cumsum(np.bincount(of, minlength=n), out=out_at[1:])
        return ids[order], out_at

    def _rows(self, data, begin, end):
        """Row of each pre-token in the worker's table of tokens."""
        key = K.long_spans(K.span_hash(K.prefix_hash(data), begin, end), data, begin, end)
        distinct, first, inverse = np.unique(key, return_index=True, return_inverse=True)
        at = np.searchsorted(self.known, distinct)
        at[at == len(self.known)] = 0
        new = self.known[at] != distinct if len(self.known) else np.ones(len(distinct), bool)
        if new.any():
            if len(self.known) + new.sum() > CACHE_ROWS and len(self.known):
                self._reset()
                new = np.ones(len(distinct), bool)
            b, e = begin[first[new]], end[first[new]]
            size = e - b
            from_ = np.cumsum(size) - size
            if self.library:
                ids, offsets = self._encoded([data[i:j].tobytes().decode("utf-8", "replace") for i, j in zip(b, e, strict=True)])
            else:
                symbols = self.byte_id[data[np.repeat(b - from_, size) + np.arange(size.sum())]]
                ids, offsets = self._merge(symbols, np.concatenate([from_, [size.sum()]]))
            row = len(self.at) - 1 + np.arange(len(b))
            self.ids = np.concatenate([self.ids, ids.astype(self.ids.dtype)])
            self.at = np.concatenate([self.at, self.at[-1] + offsets[1:]])
            where = np.searchsorted(self.known, distinct[new])
            self.known = np.insert(self.known, where, distinct[new])
            self.row = np.insert(self.row, where, row)
            at = np.searchsorted(self.known, distinct)
        return self.row[at][inverse]

    def _special_texts(self, data, offsets):
        raw = data.tobytes()
        found = set()
        for s in self.special:
            i = raw.find(s)
            while i >= 0:
                d = int(np.searchsorted(offsets, i, "right")) - 1
                if i + len(s) <= offsets[d + 1]:
                    found.add(d)
                i = raw.find(s, i + 1)
        return sorted(found)

    def _tokenizer(self) -> Library:
        if self._library is None:
            self._library = Library(self.path)
        return self._library

    def _encoded(self, words: list[str]):
        """The library's ids of single pre-tokens: (ids, offsets)."""
        out = [x.ids for x in self._tokenizer().tokenizer.encode_batch_fast(words, add_special_tokens=False)]
        at = np.zeros(len(out) + 1, np.int64)
        np.cumsum([len(x) for x in out], out=at[1:])
        return np.fromiter((i for x in out for i in x), np.int32, int(at[-1])), at

    def count(self, data, offsets) -> np.ndarray:
        """Tokens of each text."""
        begin = self.starts(data, offsets)
        out = np.zeros(len(offsets) - 1, np.int64)
        if len(begin):
            row = self._rows(data, begin, np.append(begin[1:], len(data)))
            out = K.segment_sum(np.diff(self.at)[row], np.searchsorted(begin, offsets))
        for d in self._special_texts(data, offsets):
            out[d] = len(self._tokenizer().ids(data[offsets[d] : offsets[d + 1]].tobytes()))
        return out

    def encode(self, data, offsets):
        """Token ids of all texts together, and each text's offsets among them."""
        begin = self.starts(data, offsets)
        if not len(begin):
            return np.zeros(0, self.ids.dtype), np.zeros(len(offsets), np.int64)
        row = self._rows(data, begin, np.append(begin[1:], len(data)))
        size = np.diff(self.at)[row]
        from_ = np.cumsum(size) - size
        ids = self.ids[np.repeat(self.at[row] - from_, size) + np.arange(size.sum())]
        at = np.concatenate([from_, [size.sum()]])[np.searchsorted(begin, offsets)]
        odd = self._special_texts(data, offsets)
        if odd:
            pieces = [ids[at[i] : at[i + 1]] for i in range(len(at) - 1)]
            for d in odd:
                pieces[d] = self._tokenizer().ids(data[offsets[d] : offsets[d + 1]].tobytes()).astype(ids.dtype)
            at = np.concatenate([[0], np.cumsum([len(p) for p in pieces])])
            ids = np.concatenate(pieces)
        return ids, at


_loaded: dict[tuple[str, bool], ByteBpe | Library] = {}


def load(path: str, library: bool = False) -> ByteBpe | Library:
    """One per worker process."""
    key = (path, library)
    if key not in _loaded:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        _loaded[key] = ByteBpe(path, spec, library) if plain(spec) else Library(path)
    return _loaded[key]
