"""Token ids of whole texts by the tokenizers library, with a cache of the pieces between spaces."""

from __future__ import annotations

import json
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .common import set_env, trim

#: Bytes of the pieces that a worker keeps, about, in two generations; pieces that are counted before the most frequent ones are
#: told, and how many of these are kept apart.
CACHE, COUNTED, FREQUENT = 128 << 20, 200_000, 1 << 15
#: A piece that the pre-tokenizer cuts alike whatever its Unicode version: a word of Latin letters with its space, or after a line
#: feed that is a token of its own, as is a mark at its end. And the bytes of such a piece at most.
_PLAIN, _MARKS, _LONGEST = "^\n?[A-Za-zÀ-ÖØ-öø-ÿ]+[.,;:!?]?$", b".,;:!?", 64
#: Slots of the table of merges, at least five for each, and words that are merged at once.
_SLOTS, _AT_ONCE = 18, 1 << 14
#: Of pieces joined by spaces: an empty one, or one that ends in white space or begins with other than a line feed and a letter.
_TOUCHING = re.compile(r"\s | [^\S\n]|\n\s")


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class Merges:
    """The merges of a byte-level BPE file for many words at once, in numpy: as long as a word has a pair of neighbours that the
    file merges, the first pair of the least rank becomes one. Pairs are found in a table with open addressing."""

    def __init__(self, vocab: dict[str, int], merges: list, letter: dict[int, str]):
        pairs = [tuple(m) if isinstance(m, (list, tuple)) else tuple(m.split(" ")) for m in merges]
        self.none = max(vocab.values()) + 1  # beside a word; no pair has it, nor what is `apart`
        self.apart = self.none + 1
        self.byte = np.array([vocab[letter[b]] for b in range(256)], np.int32)
        self.made = np.array([vocab[a + b] for a, b in pairs], np.int64)
        self.unmerged, self.bits = len(pairs), max(_SLOTS, (5 * len(pairs)).bit_length())
        self.keys, self.ranks = np.full(1 << self.bits, -1), np.zeros(1 << self.bits, np.int32)
        # of a pair that is listed twice the library keeps the later rank
        last = {vocab[a] << 32 | vocab[b]: k for k, (a, b) in enumerate(pairs)}
        keys, ranks = np.array([*last], np.int64), np.array([*last.values()], np.int32)
        slot = self._slot(keys)
        while len(keys):
            free = np.flatnonzero(self.keys[slot] == -1)
            first = free[np.unique(slot[free], return_index=True)[1]]
            self.keys[slot[first]], self.ranks[slot[first]] = keys[first], ranks[first]
            keys, ranks, slot = np.delete(keys, first), np.delete(ranks, first), np.delete(slot, first)
            slot = (slot + 1) & ((1 << self.bits) - 1)
        both = self.byte.astype(np.int64)
        self.of_bytes = self.rank(np.repeat(both, 256), np.tile(both, 256))

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return (keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - self.bits)).view(np.int64)

    def rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        keys = a << 32 | b
        slot = self._slot(keys)
        there = self.keys[slot]
        out = np.where(there == keys, self.ranks[slot], np.int32(self.unmerged))
        left = np.flatnonzero((there != keys) & (there != -1))
        while len(left):
            slot[left] = (slot[left] + 1) & ((1 << self.bits) - 1)
            there = self.keys[slot[left]]
            hit = there == keys[left]
            out[left[hit]] = self.ranks[slot[left[hit]]]
            left = left[~hit & (there != -1)]
        return out

    def merge(self, ids: np.ndarray, ranks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """ids: a row for each word, with `none` around it; ids from `apart` on are no part of a pair, and lose it at the end.
        ranks: of the pair that begins at each. Gives the ids of all rows, one after the other, and how many each has."""
        n, width = ids.shape
        flat, rank, rows = ids.reshape(-1), ranks.reshape(-1), np.arange(n)
        after = np.tile(np.arange(1, width + 1, dtype=np.uint8), n)
        before = after - np.uint8(2)
        while len(rows):
            column = ranks[rows].argmin(axis=1)
            base = rows * width
            at = base + column
            least = rank[at]
            more = np.flatnonzero(least < self.unmerged)
            if len(more) < len(rows):
                rows, base, column, at, least = rows[more], base[more], column[more], at[more], least[more]
            gone, made = base + after[at], self.made[least]
            flat[at], flat[gone], rank[gone] = made, -1, self.unmerged
            right, left = base + after[gone], base + before[at]
            after[at], before[right] = after[gone], column
            rank[at], rank[left] = self.rank(made, flat[right].astype(np.int64)), self.rank(flat[left].astype(np.int64), made)
        kept = (ids != -1) & (ids != self.none)
        out = ids[kept]
        return np.where(out >= self.apart, out - self.apart, out).astype("<u4"), kept.sum(axis=1)

    def words(self, plain: pa.LargeStringArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The order in which pieces of the form _PLAIN are told, the ids of all, and how many each has."""
        _, places, data = plain.buffers()
        places, data = np.frombuffer(places, "<i8", len(plain) + 1, 8 * plain.offset), np.frombuffer(data, np.uint8)
        sizes = np.diff(places)
        order, told, counts = np.argsort(sizes, kind="stable"), [], []
        for k in range(0, len(order), _AT_ONCE):
            own = order[k : k + _AT_ONCE]
            size = sizes[own]
            width, row, last = size[-1] + 3, np.arange(len(own)), 1 + size
            # a word after a column of `none` and its space, or its line feed, and before one more column
            column = np.arange(-2, width - 2)
            found = data[np.clip(places[own][:, None] + column, 0, len(data) - 1)]
            line, mark = found[:, 2] == 10, np.isin(found[row, last], list(_MARKS))
            found[:, 1] = 32
            begins, ends = np.where(line, 3, 1)[:, None] - 2, (last - mark)[:, None] - 2
            ranks = np.full((len(own), width), self.unmerged, np.int32)
            pairs = self.of_bytes[found[:, :-1].astype(np.int64) << 8 | found[:, 1:]]
            np.copyto(ranks[:, :-1], pairs, where=(column[:-1] >= begins) & (column[:-1] < ends))
            ids = self.byte[found]
            ids[(column < begins - line[:, None]) | (column >= size[:, None])] = self.none
            ids[line, 2] += self.apart
            ids[row[mark], last[mark]] += self.apart
            merged = self.merge(ids, ranks)
            told.append(merged[0])
            counts.append(merged[1])
        return order, np.concatenate([np.zeros(0, "<u4"), *told]), np.concatenate([np.zeros(0, np.int64), *counts])


class ByteEncoder:
    """encode(texts) gives what Tokenizer.encode(text, add_special_tokens=False).ids gives, as little-endian uint32 bytes.

    The pre-tokenizer of a byte-level BPE file starts a new token at each space that stands between two characters which
    are not white space, and before such a line feed, and never looks behind; so a text may be cut there, and each piece (with
    its leading space or line feed) has its ids whatever its neighbours are. Words of Latin letters are merged here, all those of
    a call together; other pieces are encoded by the library and then remembered, in two generations: a piece that is met again moves to the young one, and when that is full it becomes the old one, whose
    pieces are forgotten. The most frequent pieces are kept in a small table of their own, which each young generation begins with.
    A text in which a space or line feed touches other white space, or which may hold a special token, goes to the library as a whole.

    Arrow splits the texts of a call and tells their distinct pieces, and the ids of the texts are taken from theirs by number.
    """

    def __init__(self, path: str, cache: int = CACHE):
        set_env()
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        how = json.loads(self.library.pre_tokenizer.__getstate__()) if self.library.pre_tokenizer else None
        if self.library.normalizer or how != {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True}:
            raise ValueError("a byte-level BPE file without a normalizer is needed")
        self.special = tuple({t.content[:2] for t in self.library.get_added_tokens_decoder().values()})
        self.most, self.known, self.old, self.held = cache // 2, {}, {}, 0
        self.hot, self.counts, self.counted = {}, Counter(), 0
        # how the library writes bytes as characters: the printable ones of Latin-1 as they are, the others from U+0100 on
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        letter = dict(zip([b for b in range(256) if b not in plain], map(chr, range(256, 512)))) | {b: chr(b) for b in plain}
        vocab = self.library.get_vocab(with_added_tokens=False)
        with open(path, encoding="utf-8") as file:
            model = json.load(file)["model"]
        odd = ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges")
        self.merges = None if any(model.get(x) for x in odd) or not set(letter.values()) <= vocab.keys() else Merges(vocab, model["merges"], letter)
        self.spaced = np.zeros(self.library.get_vocab_size() + 1, bool)  # ids whose token begins with a space
        self.spaced[[i for t, i in vocab.items() if t.startswith("Ġ")]] = True
        self.line = np.zeros_like(self.spaced)
        self.line[[i for t, i in vocab.items() if t.startswith("Ċ")]] = True
        del vocab, model
        trim()

    def _encode(self, strings: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.library.encode_batch_fast(strings, add_special_tokens=False)]

    def _get(self, piece: str) -> bytes | None:
        """The ids of a piece of either generation, which is of the young one from then on."""
        ids = self.known.get(piece)
        if ids is None and (ids := self.old.pop(piece, None)) is not None:
            self._put(piece, ids)
        return ids

    def _put(self, piece: str, ids: bytes) -> None:
        self.known[piece] = ids
        self.held += 150 + len(piece) + len(ids)

    def _learn(self, pieces: list[str]) -> None:
        """Remembers the ids of pieces. They go to the library joined: a token that begins with a space (or, among pieces that
        begin with one, a line feed) begins a piece, since no piece holds another."""
        lines = [p for p in pieces if p[0] == "\n"]
        for own, before, starts in (([p for p in pieces if p[0] != "\n"], " ", self.spaced), (lines, "", self.line)):
            groups = [own[at : at + 128] for at in range(0, len(own), 128)]
            for at in range(0, len(groups), 64):
                found = self.library.encode_batch_fast([before + before.join(g) for g in groups[at : at + 64]], add_special_tokens=False)
                for group, e in zip(groups[at : at + 64], found):
                    ids = np.array(e.ids, "<u4")
                    cuts = [*(4 * np.flatnonzero(starts[ids])).tolist(), 4 * len(ids)]
                    data = ids.tobytes()
                    told = [data[a:b] for a, b in zip(cuts, cuts[1:])] if len(cuts) == len(group) + 1 else self._encode([before + p for p in group])
                    for p, x in zip(group, told):
                        self._put(p, x)

    def _keep_frequent(self) -> None:
        self.hot = {p: ids for p, _ in self.counts.most_common(FREQUENT) if len(p) < 64 and (ids := self._get(p)) is not None}
        self.counts = None

    def encode(self, texts: list[str] | pa.Array) -> list[bytes]:
        if self.counts is not None and self.counted >= COUNTED:
            self._keep_frequent()
        if self.held > self.most:
            self.known, self.old, self.held = dict(self.hot), self.known, 0
        column = pc.fill_null(pa.array(texts, pa.large_string()) if isinstance(texts, list) else texts.cast(pa.large_string()), "")
        out = [b""] * len(column)
        cut = pc.not_equal(column, "").to_numpy(zero_copy_only=False)
        special = np.zeros(len(out), bool)
        for s in self.special:
            special |= pc.match_substring(column, s).to_numpy(zero_copy_only=False)
        whole, at = np.flatnonzero(cut & special).tolist(), np.flatnonzero(cut & ~special)
        if len(at):
            for i, ids in zip(at.tolist(), self._by_pieces(column.take(pa.array(at)))):
                if ids is None:
                    whole.append(i)
                else:
                    out[i] = ids
        for k in range(0, len(whole), 256):
            own = whole[k : k + 256]
            for i, ids in zip(own, self._encode(column.take(pa.array(own)).to_pylist())):
                out[i] = ids
        return out

    def _by_pieces(self, texts: pa.LargeStringArray) -> list[bytes | None]:
        """The ids of texts that are not empty; None for those which can't be cut."""
        lists = pc.split_pattern(pc.replace_substring(texts, "\n", " \n"), " ")
        counts = pc.list_value_length(lists).to_numpy()
        ends = np.cumsum(counts, dtype=np.int64)
        starts, text = ends - counts, np.repeat(np.arange(len(texts)), counts)
        coded = lists.flatten().dictionary_encode()
        number, pieces = coded.indices.to_numpy().astype(np.int64), coded.dictionary  # of each piece among the distinct ones
        del lists, coded
        plain = np.zeros(len(pieces), bool)
        if self.merges:
            plain = pc.match_substring_regex(pieces, _PLAIN).to_numpy(zero_copy_only=False) & (pc.binary_length(pieces).to_numpy() <= _LONGEST)
        place, others = np.empty(len(pieces), np.int64), np.flatnonzero(~plain)
        n_plain, ids, counted = len(pieces) - len(others), np.zeros(0, "<u4"), np.zeros(0, np.int64)
        if n_plain:
            order, ids, counted = self.merges.words(pieces.filter(pa.array(plain)))
            place[np.flatnonzero(plain)[order]] = np.arange(n_plain)
        place[others] = np.arange(n_plain, len(pieces))
        first = number[starts]  # has no space before it, so its ids are its own
        number, later = place[number], np.ones(len(number), bool)
        later[starts] = False
        got, open_ = self._remembered(pieces.take(pa.array(others)).to_numpy(zero_copy_only=False).tolist(), number - n_plain, text, later)
        number[starts] = np.arange(len(pieces), len(pieces) + len(starts))
        got += self._encode(pieces.take(pa.array(first)).to_pylist())
        sizes = np.concatenate([[0], 4 * counted, np.fromiter(map(len, got), np.int64, len(got))])
        values = [None, pa.py_buffer(np.cumsum(sizes)), pa.py_buffer(b"".join([ids.tobytes(), *got]))]
        found = pa.Array.from_buffers(pa.large_binary(), len(sizes) - 1, values).take(pa.array(number))
        _, places, data = found.buffers()
        places, data = np.frombuffer(places, "<i8", len(found) + 1), memoryview(data or b"")
        bounds = zip(places[starts].tolist(), places[ends].tolist(), open_.tolist())
        return [bytes(data[a:b]) if ok else None for a, b, ok in bounds]

    def _remembered(self, pieces: list[str], number: np.ndarray, text: np.ndarray, later: np.ndarray) -> tuple[list[bytes], np.ndarray]:
        """The ids of distinct pieces, and which texts can be cut. number, text, later: of each place in the texts the piece (below
        0: another one), the text, and whether it is not the text's first. Pieces that no place needs may have no ids."""
        got = list(map(self.known.get, pieces))
        if self.counts is not None:
            own = number[number >= 0]
            for p, n in zip(pieces, np.bincount(own, minlength=len(pieces)).tolist()):
                self.counts[p] += n
            self.counted += len(own)
        new, old, put = [], self.old.pop, self._put
        for k in [k for k, ids in enumerate(got) if ids is None]:
            got[k] = ids = old(p := pieces[k], None)
            if ids is None:
                new.append(k)
            else:
                put(p, ids)
        open_ = np.ones(text[-1] + 1, bool)
        touching, needed = np.zeros(len(pieces) + 1, bool), np.zeros(len(pieces) + 1, bool)
        touching[[k for k in new if _TOUCHING.search(f" {pieces[k]} ")]] = True
        number = np.where(number < 0, len(pieces), number)
        open_[text[touching[number]]] = False
        needed[number[open_[text] & later]] = True
        new = [k for k in new if needed[k]]
        if new:
            self._learn([pieces[k] for k in new])
            for k in new:
                got[k] = self.known[pieces[k]]
        return [b"" if ids is None else ids for ids in got], open_


def slices(batch: pa.RecordBatch, most_bytes: int = 2 << 20):
    """Parts of a batch whose texts have about so many bytes, so that a batch of long texts needs no more memory."""
    size = batch.nbytes
    rows = batch.num_rows
    step = max(1, min(rows, int(rows * most_bytes / max(size, 1)))) if rows else 1
    for at in range(0, rows, step):
        yield batch.slice(at, step)
    trim()
