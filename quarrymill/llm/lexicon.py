"""Word-level BPE through a minimal acyclic transducer.

The most frequent words of the corpus and their ids are compiled into an automaton in which words share prefixes and
suffixes. Its arcs carry numbers whose sum along a word is the word's number, and that number finds the ids. Workers map
the compiled file into memory. Words that it lacks are merged by the rules of the BPE file, exactly.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import mmap
import re
import struct
import tempfile
from collections import Counter
from operator import itemgetter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import documents, dropped, kept_in_worker, mix, set_env, written
from .tokens import slices, vocabulary

#: Chunks whose words the automaton holds, bytes that a worker remembers (about), chunks that a counting task holds, bytes of text
#: after which it hands on its counts at the latest, and letters of the longest chunk whose words the automaton may hold.
WORDS, CACHE, COUNTED, COUNTED_BYTES, LONGEST = 50_000, 256 << 20, 500_000, 128 << 20, 64

#: White space of the pre-tokenizer's pattern (the Unicode property); Python's split() also cuts at U+001C to U+001F.
_SPACE = re.compile("[\t-\r \x85\xa0  -     　]+")
_ODD = re.compile("[\x1c-\x1f]")
#: Chunks of ASCII and of Latin letters that are composed and have one lower-case letter each need no library: NFC leaves them as
#: they are, and this is the pre-tokenizer's pattern for them in lower case.
_PLAIN = re.compile("[\x21-\x7eÀ-ÖØ-öø-įı-ňŊ-ž]+")
_WORDS = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-įı-ňŊ-ž]+|[0-9]|[^a-z0-9ß-öø-įı-ňŊ-ž\t-\r ]+")
#: A text of such characters and white space can be cut into words at once.
_PLAIN_TEXT = re.compile("[\t-\r\x20-\x7eÀ-ÖØ-öø-įı-ňŊ-ž]*")


_NONE = 1 << 30
_FIRST, _SECOND = itemgetter(0), itemgetter(1)


def byte_letters() -> list[str]:
    """The letter that byte-level vocabularies write for each byte: itself where printable, else the next from U+0100."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    hidden = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(hidden)) for b in range(256)]


class Automaton:
    """A compiled lexicon: lookup(word) -> its number, or -1; ids(number) -> its ids."""

    MAGIC = b"QMLEX001"

    @staticmethod
    def compile(entries: dict[bytes, list[int]]) -> bytes:
        """Builds the automaton from words in sorted order; a state whose suffixes are closed is shared with an equal one."""
        words = sorted(entries)
        register: dict[tuple, int] = {}
        states: list[tuple] = []  # (is final, ((label, target), ...)), each once, targets before sources

        def close(path: list, down: int) -> None:
            while len(path) > down:
                final, arcs = path.pop()
                key = (final, tuple(arcs))
                if key not in register:
                    register[key] = len(states)
                    states.append(key)
                if path:
                    label, _ = path[-1][1][-1]
                    path[-1][1][-1] = (label, register[key])

        path, last = [[False, []]], b""
        for word in words:
            common = 0
            while common < min(len(word), len(last)) and word[common] == last[common]:
                common += 1
            close(path, common + 1)
            for b in word[common:]:
                path[-1][1].append((b, -1))
                path.append([False, []])
            path[-1][0] = True
            last = word
        close(path, 0)
        below = []  # words from each state on
        first, labels, targets, outs = [], bytearray(), [], []
        for final, arcs in states:
            first.append(len(labels))
            passed = int(final)
            for label, to in arcs:
                labels.append(label)
                targets.append(to)
                outs.append(passed)
                passed += below[to]
            below.append(passed)
        first.append(len(labels))
        at = np.cumsum([0, *(len(entries[w]) for w in words)])
        ids = np.array([i for w in words for i in entries[w]], "<u4")
        body = [np.array(x, "<u4").tobytes() for x in (first, targets, outs, at)] + [ids.tobytes(), bytes(labels), bytes(f for f, _ in states)]
        return Automaton.MAGIC + struct.pack("<7Q", *map(len, body)) + b"".join(body)

    def __init__(self, buffer):
        if bytes(buffer[:8]) != self.MAGIC:
            raise ValueError("not a lexicon")
        sizes, at, views = struct.unpack("<7Q", buffer[8:64]), 64, []
        self.buffer, view = buffer, memoryview(buffer)
        for n in sizes:
            views.append((at, view[at : at + n]))
            at += n
        self.first, self.targets, self.outs, self.at = (v.cast("I") for _, v in views[:4])
        self.ids_view, self.labels_at, self.final = views[4][1].cast("I"), views[5][0], views[6][1]
        self.states, self.keys = len(self.final), None

    @classmethod
    def map(cls, data: bytes) -> Automaton:
        """Writes data to a nameless temporary file of this worker and maps it."""
        file = tempfile.TemporaryFile()
        file.write(data)
        file.flush()
        return cls(mmap.mmap(file.fileno(), len(data), access=mmap.ACCESS_READ))

    def numbers(self, words: list[bytes]) -> np.ndarray:
        """lookup() of many words, a letter of all of them at a time."""
        found = np.full(len(words), -1, np.int64)
        if not self.states or not words:
            return found
        first, targets, outs = (np.frombuffer(v, np.uint32) for v in (self.first, self.targets, self.outs))
        labels = np.frombuffer(self.buffer, np.uint8, len(targets), self.labels_at)
        final = np.frombuffer(self.final, np.uint8)
        if self.keys is None:  # arcs by state and label, ascending
            self.keys = (np.repeat(np.arange(self.states, dtype=np.int64), np.diff(first.astype(np.int64))) << 8) | labels
        data, n = np.frombuffer(b"".join(words), np.uint8), np.array([len(w) for w in words])
        start = np.cumsum(n) - n
        own, state, number, k = np.arange(len(words)), np.full(len(words), self.states - 1, np.int64), np.zeros(len(words), np.int64), 0
        while len(own):
            end = n[own] == k
            done = end & (final[state] > 0)
            found[own[done]] = number[done]
            own, state, number = own[~end], state[~end], number[~end]
            key = (state << 8) | data[start[own] + k]
            at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            there = self.keys[at] == key
            own, at = own[there], at[there]
            state, number, k = targets[at].astype(np.int64), number[there] + outs[at], k + 1
        return found

    def lookup(self, word: bytes) -> int:
        state, number, first, find, base = self.states - 1, 0, self.first, self.buffer.find, self.labels_at
        if state < 0:
            return -1
        for i in range(len(word)):
            arc = find(word[i : i + 1], base + first[state], base + first[state + 1])
            if arc < 0:
                return -1
            number += self.outs[arc - base]
            state = self.targets[arc - base]
        return number if self.final[state] else -1

    def ids(self, number: int) -> list[int]:
        return self.ids_view[self.at[number] : self.at[number + 1]].tolist()


class WordBpe:
    """Encodes with a BPE file whose words end in </w>: the library normalizes and splits text that is not ASCII; words are
    looked up in the automaton or merged here."""

    def __init__(self, path: str, lexicon: bytes | None = None, cache: int = CACHE):
        set_env()
        from tokenizers import Tokenizer

        how = json.load(open(path, encoding="utf-8"))
        model = how["model"]
        if model["end_of_word_suffix"] != "</w>" or how["decoder"] is not None:
            raise ValueError("a word-level BPE file is needed")
        self.library = Tokenizer.from_file(path)
        self.vocab = model["vocab"]
        self.token = {i: t.encode() for t, i in self.vocab.items()}
        self.rank = {tuple(m if isinstance(m, list) else m.split(" ")): k for k, m in enumerate(model["merges"])}
        self.letters = byte_letters()
        self.byte = {c: b for b, c in enumerate(self.letters)}
        self.special = {t["content"]: t["id"] for t in how["added_tokens"]}
        self.token |= {i: t.encode() for t, i in self.special.items()}
        self.cut = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")")
        self.lexicon = Automaton.map(lexicon) if lexicon else None
        self.known, self.most, self.word, self.held = {}, cache, {}, 0
        self.letter = np.array([[self.vocab[c + end] for c in self.letters] for end in ("", "</w>")], np.int64)
        # the rules in an open-addressed table: key (left << 32 | right), rank, and by rank the id that a pair becomes
        pairs = np.array([(self.vocab[a] << 32) | self.vocab[b] for a, b in self.rank], np.int64)
        self.becomes = np.array([self.vocab[a + b] for a, b in self.rank], np.int64)
        self.slots, self.slot_rank = np.full(1 << 18, -1, np.int64), np.full(1 << 18, _NONE, np.int64)
        for rank, (slot, key) in enumerate(zip(self._slot(pairs).tolist(), pairs.tolist())):
            while self.slots[slot] >= 0:
                slot = (slot + 1) % len(self.slots)
            self.slots[slot], self.slot_rank[slot] = key, rank

    @staticmethod
    def _slot(pairs: np.ndarray) -> np.ndarray:
        return (mix(pairs.view(np.uint64)) >> np.uint64(46)).astype(np.int64)

    def _ranks(self, pairs: np.ndarray) -> np.ndarray:
        """The rules' ranks of pairs; _NONE where there is no rule."""
        slot, out = self._slot(pairs), np.full(len(pairs), _NONE, np.int64)
        open_ = np.arange(len(pairs))
        while len(open_):
            key = self.slots[slot]
            hit = key == pairs[open_]
            out[open_[hit]] = self.slot_rank[slot[hit]]
            more = ~hit & (key >= 0)
            open_, slot = open_[more], (slot[more] + 1) % len(self.slots)
        return out

    def merge_many(self, words: list[bytes]) -> list[list[int]]:
        """merge() of many words at once: in each round every word's earliest rule is applied at its leftmost place."""
        out: list = [None] * len(words)
        short = [k for k, w in enumerate(words) if len(w) <= 64]
        for k, w in enumerate(words):
            if len(w) > 64:
                out[k] = self.merge(w)
        for at in range(0, len(short), 32_768):
            own = short[at : at + 32_768]
            n = np.array([len(words[k]) for k in own])
            data = np.frombuffer(b"".join([words[k] for k in own]), np.uint8)
            sym, stop = self.letter[0][data], np.cumsum(n)
            sym[stop - 1] = self.letter[1][data[stop - 1]]
            own = np.array(own)
            while len(own):
                start = np.cumsum(n) - n
                key = np.full(len(sym), _NONE << 32, np.int64)
                inner = np.ones(len(sym), bool)
                inner[start + n - 1] = False
                place = np.flatnonzero(inner)
                key[place] = (self._ranks((sym[place] << 32) | sym[place + 1]) << 32) | place
                best = np.minimum.reduceat(key, start)
                going = best < _NONE << 32
                if not going.all():
                    ended = np.flatnonzero(~going)
                    flat = sym.tolist()
                    for k, a, b in zip(own[ended].tolist(), start[ended].tolist(), (start + n)[ended].tolist()):
                        out[k] = flat[a:b]
                hit = best[going] & 0xFFFFFFFF
                sym[hit] = self.becomes[best[going] >> 32]
                keep = np.repeat(going, n)
                keep[hit + 1] = False
                sym, own, n = sym[keep], own[going], n[going] - 1
        return out

    def merge(self, word: bytes) -> list[int]:
        """Ids of a word: of all neighbouring pairs that the file merges, the earliest rule's first, the leftmost of equals."""
        parts = [self.letters[b] for b in word]
        parts[-1] += "</w>"
        rank, n = self.rank, len(parts)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, i, parts[i], parts[i + 1]) for i in range(n - 1) if (r := rank.get((parts[i], parts[i + 1]))) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, left, right = heapq.heappop(heap)
            j = after[i]
            if parts[i] != left or j >= n or parts[j] != right:
                continue
            parts[i], parts[j] = left + right, None
            after[i] = after[j]
            if after[j] < n:
                before[after[j]] = i
            for a, b in ((before[i], i), (i, after[i])):
                if a >= 0 and b < n and (r := rank.get((parts[a], parts[b]))) is not None:
                    heapq.heappush(heap, (r, a, parts[a], parts[b]))
        return [self.vocab[p] for p in parts if p is not None]

    def words(self, chunk: str) -> list[bytes]:
        """Words of a chunk without white space, as bytes."""
        if chunk.isascii() or _PLAIN.fullmatch(chunk):
            return [w.encode() for w in _WORDS.findall(chunk.lower())]
        byte = self.byte
        return [bytes(map(byte.__getitem__, w)) for w, _ in self.library.pre_tokenizer.pre_tokenize_str(self.library.normalizer.normalize_str(chunk))]

    def chunks(self, text: str) -> list[str]:
        return [c for c in _SPACE.split(text) if c] if _ODD.search(text) else text.split()

    def pieces(self, text: str) -> tuple[list[str], bool]:
        """What a text is looked up by: its words in lower case where that needs no library (true), else its chunks. A word that is
        a chunk has the same ids as such."""
        if text.isascii() or _PLAIN_TEXT.fullmatch(text):
            return _WORDS.findall(text.lower()), True
        return self.chunks(text), False

    def ids(self, words: list[bytes]) -> list[tuple[bytes, bytes]]:
        """(ids, their tokens joined by a space) of words: from the automaton, or merged."""
        numbers = self.lexicon.numbers(words).tolist() if self.lexicon else [-1] * len(words)
        merged, token, out = iter(self.merge_many([w for w, k in zip(words, numbers) if k < 0])), self.token, []
        for k in numbers:
            ids = next(merged) if k < 0 else self.lexicon.ids(k)
            out.append((struct.pack(f"<{len(ids)}I", *ids), b" ".join([token[i] for i in ids])))
        self.held += sum(260 + 2 * len(w) + len(i) + len(t) for w, (i, t) in zip(words, out))
        return out

    def learn(self, words: list[str], chunks: list[str]) -> None:
        """Remembers what ids() gives for words in lower case and for chunks."""
        self.known.update(zip(words, self.ids([w.encode() for w in words])))
        own = [self.words(c) for c in chunks]
        new = list({w for ws in own for w in ws if w not in self.word})
        word = self.word
        word.update(zip(new, self.ids(new)))
        for c, ws in zip(chunks, own):
            self.known[c] = found = word[ws[0]] if len(ws) == 1 else (b"".join([word[w][0] for w in ws]), b" ".join([word[w][1] for w in ws]))
            self.held += 260 + 2 * len(c) + len(found[0]) + len(found[1])

    def encode(self, texts: list[str]) -> list[tuple[bytes, bytes]]:
        """(ids as little-endian uint32, the decoded text in UTF-8) of each text."""
        known = self.known
        if self.held > self.most:
            known.clear()
            self.word.clear()
            self.held = 0
        split, words, rough = [], set(), set()
        for text in texts:
            chunks, got = [], []
            for part in self.cut.split(text) if "<|" in text else (text,):
                if part in self.special:
                    chunks.append(part)
                    got.append((struct.pack("<I", self.special[part]), part.encode()))
                else:
                    found, plain = self.pieces(part)
                    chunks += found
                    got += (ids := list(map(known.get, found)))
                    if None in ids:
                        (words if plain else rough).update([c for c, x in zip(found, ids) if x is None])
            split.append((chunks, got))
        if words or rough:
            self.learn(list(words), list(rough - words))
        out = []
        for chunks, got in split:
            if None in got:
                got = [known[c] if x is None else x for c, x in zip(chunks, got)]
            out.append((b"".join(map(_FIRST, got)), b" ".join(map(_SECOND, got))))
        return out


def frequent_words(docs: DataFrame, path: str, most: int = WORDS) -> list[bytes]:
    """The `most` most frequent words (in texts that need the library, of the most frequent chunks between white space) of all
    texts, as nearly as a count that at most so many of them reach tells. Counted over the whole corpus; tasks pre-aggregate, and
    the driver gets a histogram of counts and then `most` words or chunks at most, of LONGEST letters at most."""

    def run(batches):
        bpe, counts, seen = kept_in_worker(WordBpe, path, None), Counter(), 0

        def out():
            for at in range(0, len(own := list(counts)), 50_000):
                part = own[at : at + 50_000]
                yield pa.RecordBatch.from_arrays([pa.array(part, pa.string()), pa.array([counts[c] for c in part], pa.int64())], names=["chunk", "n"])
            counts.clear()

        for batch in batches:
            for part in slices(batch):
                for text in part.column(1).to_pylist():
                    counts.update(bpe.pieces(text)[0])
                seen += part.nbytes
                if len(counts) > COUNTED or seen > COUNTED_BYTES:
                    yield from out()
                    seen = 0
        yield from out()

    counted = written(documents(docs).mapInArrow(run, "chunk string, n long").where(F.length("chunk") <= LONGEST).groupBy("chunk").agg(F.sum("n").alias("n")), "counts")
    level = F.floor(16 * F.log2("n")).cast("int")  # 16 levels for each doubling: a thousand at most
    levels = sorted(((r.level, r["count"]) for r in counted.groupBy(level.alias("level")).count().collect()), reverse=True)
    lowest, total = None, 0
    for at, n in levels:
        total += n
        if total > most:
            break
        lowest = at
    if lowest is None:
        return []
    bpe = WordBpe(path)
    chunks = [r.chunk for r in counted.where(level >= lowest).select("chunk").collect()]
    out = sorted({w for c in chunks for w in bpe.words(c)})
    dropped(counted)
    return out


def build(words: list[bytes], path: str) -> bytes:
    bpe = WordBpe(path)
    words = [w for w in words if w]
    return Automaton.compile(dict(zip(words, bpe.merge_many(words))))


def encode_decode(docs: DataFrame, vocab: str = "word_bpe_49k.json", words: int = WORDS, with_ids: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every text (and with_ids its ids and decoded text).

    Null text: empty, no tokens. Null doc_id and repeated rows: kept. Other columns are ignored. The compiled lexicon (the
    words of at most `words` chunks, so a few MB) is broadcast."""
    spark, path = docs.sparkSession, vocabulary(vocab)
    lexicon = spark.sparkContext.broadcast(build(frequent_words(docs, path, words), path))
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + (", ids binary, decoded string" if with_ids else "")

    def run(batches):
        bpe = kept_in_worker(WordBpe, path, lexicon.value)
        sha = hashlib.sha256
        for batch in batches:
            for part in slices(batch):
                rows = [[] for _ in range(6)]
                for doc, (ids, decoded) in zip(part.column(0).to_pylist(), bpe.encode(part.column(1).to_pylist())):
                    for col, x in zip(rows, (doc, len(ids) // 4, sha(ids).hexdigest(), sha(decoded).hexdigest(), ids if with_ids else None, decoded if with_ids else None)):
                        col.append(x)
                rows[5] = [x.decode() if with_ids else None for x in rows[5]]
                types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.binary(), pa.string()]
                n = 6 if with_ids else 4
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(rows[:n], types[:n])], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "ids", "decoded"][:n])

    return documents(docs).mapInArrow(run, schema)
