"""Token ids in files, packed by an adaptive context-mixing range coder.

A file holds the ids of many documents one after another, in blocks of BLOCK ids.  Every
block is coded by itself, with a model that starts anew, and has a crc32, so that blocks can
be read and checked alone.  Blocks come in groups that share a prior: the ids of the group and
their frequencies.

The model predicts the next id from the last two ids (order 2) and from the last one (order
1): tables hold what followed a context last time and how often that held.  First comes
whether the order-2 prediction holds, else the order-1 one.  The chance of each is mixed from
two adaptive estimates, one by how far both orders are trusted and whether they agree, one by
the class of the last id, with a weight that follows which did better.  If neither holds, the
id follows by order 0: its class, one of some dozen of neighbouring ids, by adaptive
frequencies of the block, and the id within its class by the prior.  All arithmetic is on
integers, so that decoding repeats it exactly.

numpy codes up to LANES blocks side by side, one id of each at a time.  Spark's jobs code them
in the JVM (TokenCoder.java: the same model block by block, with the same bytes).

File format (little-endian): b"SFTK0002"; groups of blocks: u32 number of blocks, u32 bytes of
the prior, then for each block u32 ids, u32 bytes, u32 crc32 of the ids as u32, then the prior
(zlib: u32 ids ascending as differences, u16 frequencies within the class less 1) and the
blocks' bytes; u32 0; the index: zlib-compressed JSON [[document ids as text or null], [ids
per document]]; u64 place of the index; b"SFTKEND1".
"""

from __future__ import annotations

import json
import os
import struct
import uuid
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sievefp.llm import jvm
from sievefp.llm.common import U64, named, new_path, parts, shuffles, stored, text_key, tidy
from sievefp.llm.warc import filesystem

BLOCK = 4096
LANES = 1024
_MAGIC, _END = b"SFTK0002", b"SFTKEND1"
#: Range coder: the top 16 bits go out when they are settled; a range is never under 2^40.
_TOP, _BOTTOM, _OUT = U64(1 << 48), U64(1 << 40), U64(16)
_SLOTS1, _SLOTS2 = 1 << 9, 1 << 10
#: Bits of a hit's chance, of the frequencies within a class, and of a class's frequencies.
_BITS, _WITHIN, _CLASS = 16, 16, 12
_ONE = 1 << _BITS
#: Ids of a class at most, and classes of a group at least.
_MEMBERS, _CLASSES = 1 << 15, 32
#: The classes' frequencies are summed up anew after so many ids.
_RENEW = 16
#: Ids below this are counted and numbered in tables of so many slots.
_DIRECT = 1 << 20
#: Bytes of text that are tokenised at once, distinct words that are joined to one text, and
#: bytes of words that are remembered.
_TEXT, _JOINED, _KEPT = 8 << 20, 64, 32 << 20
#: Marks that are a token or more by themselves behind a letter or digit.
_MARKS = ".,;:!?"


class Prior:
    """The ids of a group by number (their rank), their classes and frequencies within them."""

    def __init__(self, ids: np.ndarray, width: np.ndarray):
        self.ids, self.width = ids, width.astype(np.int64)
        # classes are consecutive runs of ids whose frequencies sum up to 2^_WITHIN
        ends = np.cumsum(self.width)
        self.of = ((ends - 1) >> _WITHIN).astype(np.int32)
        self.start = ends - self.width - (self.of.astype(np.int64) << _WITHIN)
        self.classes = int(self.of[-1]) + 1 if len(ids) else 1

    @classmethod
    def fit(cls, ids: np.ndarray) -> "Prior":
        if len(ids) and ids.max() < _DIRECT:
            n = np.bincount(ids)
            found = np.flatnonzero(n)
            n = n[found]
        else:
            found, n = np.unique(ids, return_counts=True)
        if not len(found):
            return cls(found.astype(np.int64), found.astype(np.int64))
        classes = min(len(found), max(_CLASSES, -(-len(found) // _MEMBERS)))
        # cut where an equal share of all ids is reached, and at _MEMBERS ids
        share = np.cumsum(n) * classes // max(int(n.sum()), 1)
        cut = np.flatnonzero(np.diff(share)) + 1
        parts = [q for run in np.split(np.arange(len(found)), cut) for q in np.array_split(run, -(-len(run) // _MEMBERS))]
        width = np.zeros(len(found), np.int64)
        for part in parts:
            own = 1 + n[part] * ((1 << _WITHIN) - len(part)) // n[part].sum()
            own[np.argmax(own)] += (1 << _WITHIN) - own.sum()
            width[part] = own
        return cls(found, width)

    def data(self) -> bytes:
        return zlib.compress(struct.pack("<I", len(self.ids)) + np.diff(self.ids, prepend=0).astype("<u4").tobytes() + (self.width - 1).astype("<u2").tobytes())

    @classmethod
    def read(cls, data: bytes) -> "Prior":
        plain = zlib.decompress(data)
        (n,) = struct.unpack_from("<I", plain)
        ids = np.cumsum(np.frombuffer(plain, "<u4", n, 4).astype(np.int64))
        return cls(ids, np.frombuffer(plain, "<u2", n, 4 + 4 * n).astype(np.int64) + 1)

    def masses(self, lanes: int) -> np.ndarray:
        """First frequencies of the classes, equal for each lane."""
        return np.full((lanes, self.classes), 32, np.int32)


class _Model:
    """Predictions and probabilities of ``lanes`` blocks, all arrays flat over lanes; ids are
    their numbers in the prior."""

    def __init__(self, lanes: int, prior: Prior):
        lane = np.arange(lanes)
        self.prior, self.k = prior, prior.classes
        self.base1, self.base2, self.base_a, self.base_b = lane * _SLOTS1, lane * _SLOTS2, lane * 32, lane * self.k
        # what followed a context, times four, and how often that held (0 to 3)
        self.table1, self.table2 = np.full(lanes * _SLOTS1, -4, np.int32), np.full(lanes * _SLOTS2, -4, np.int32)
        # chances of a hit of order 2, then of order 1, by trust and by the last id's class
        self.by_trust = [np.full(lanes * 32, _ONE >> 2, np.int32) for _ in range(2)]
        self.by_class = [np.full(lanes * self.k, _ONE >> 2, np.int32) for _ in range(2)]
        self.weight = [np.full(lanes, 160, np.int32) for _ in range(2)]
        self.counts = prior.masses(lanes)
        self.flat = self.counts.reshape(-1)
        self.last, self.before = np.zeros(lanes, np.int64), np.zeros(lanes, np.int64)
        self.own = np.zeros(lanes, np.int64)  # class of the last id
        self.steps = 0

    def ready(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Looks up the first n lanes' predictions: widths of a hit of order 2 and of order 1,
        of _ONE in all."""
        if self.steps % _RENEW == 0:
            total = self.counts.sum(1)
            full = np.flatnonzero(total > 1 << 13)
            if len(full):
                self.counts[full] = (self.counts[full] + 1) >> 1
                total[full] = self.counts[full].sum(1)
            self.above = np.zeros((len(total), self.k + 1), np.int64)
            np.cumsum(self.counts, axis=1, out=self.above[:, 1:])
            self.above = self.above * ((1 << _CLASS) - self.k) // total[:, None] + np.arange(self.k + 1)
            self.above_flat = self.above.reshape(-1)
        self.steps += 1
        last, before = self.last[:n], self.before[:n]
        self.at1 = (((last * 0x9E3779B1) >> 7) & (_SLOTS1 - 1)) + self.base1[:n]
        self.at2 = (((last * 0x85EBCA6B + before * 0xC2B2AE35) >> 9) & (_SLOTS2 - 1)) + self.base2[:n]
        found1, found2 = self.table1.take(self.at1), self.table2.take(self.at2)
        self.guess1, self.guess2, self.trust1, self.trust2 = found1 >> 2, found2 >> 2, found1 & 3, found2 & 3
        self.at_a = (self.trust2 << 3 | self.trust1 << 1 | (self.guess1 == self.guess2)) + self.base_a[:n]
        self.at_b = self.own[:n] + self.base_b[:n]
        self.seen, mixed = [], []
        for k in range(2):
            a, b, w = self.by_trust[k].take(self.at_a), self.by_class[k].take(self.at_b), self.weight[k][:n]
            self.seen.append((a, b))
            mixed.append(b + ((a - b) * w >> 8))
        second = np.minimum(np.maximum(mixed[0], 64), _ONE - 128)
        left = _ONE - second
        first = np.minimum(np.maximum(left * (mixed[1] >> 1) >> (_BITS - 1), 32), left - 32)
        return second, first

    def learn(self, ids: np.ndarray, hit2: np.ndarray, hit1: np.ndarray, missed: np.ndarray) -> None:
        n = len(ids)
        for k, hit in enumerate((hit2, hit1)):
            a, b = self.seen[k]
            goal = hit * (_ONE - 1)
            better = np.where(hit, a > b, a < b)
            step_a, step_b, shift = (goal - a) >> 4, (goal - b) >> 5, (better * 248 - self.weight[k][:n]) >> 6
            if k:  # order 1 is asked only where order 2 failed
                asked = ~hit2
                step_a, step_b, shift = step_a * asked, step_b * asked, shift * asked
            self.by_trust[k][self.at_a] = a + step_a
            self.by_class[k][self.at_b] = b + step_b
            self.weight[k][:n] += shift
        kinds = self.prior.of.take(ids)
        self.flat[self.base_b.take(missed) + kinds.take(missed)] += 24
        for table, at, guess, trust in ((self.table1, self.at1, self.guess1, self.trust1), (self.table2, self.at2, self.guess2, self.trust2)):
            right = guess == ids
            trust = np.where(right, np.minimum(trust + 1, 3), trust >> 1)
            table[at] = np.where(right | (trust == 0), ids, guess) << 2 | trust
        self.before[:n] = self.last[:n]
        self.last[:n] = ids
        self.own[:n] = kinds


class _Coder:
    """Low end and width of each lane's range; ``shift`` is called for lanes whose top goes out."""

    def __init__(self, lanes: int):
        self.low, self.range = np.zeros(lanes, U64), np.full(lanes, 0xFFFFFFFFFFFFFFFF, U64)

    def narrow(self, at, span: np.ndarray, start: np.ndarray, width: np.ndarray) -> None:
        """Takes [start, start + width) of the range in units of span, in the lanes ``at``."""
        low = self.low[at] + start.astype(U64) * span
        size = span * width.astype(U64)
        go = ((low ^ (low + size)) < _TOP) | (size < _BOTTOM)
        self.low[at], self.range[at] = low, size
        todo = np.flatnonzero(go)
        todo = todo if isinstance(at, slice) else at.take(todo)
        while len(todo):
            low, size = self.low.take(todo), self.range.take(todo)
            tight = (low ^ (low + size)) >= _TOP
            if tight.any():  # the range spans a border and is too small: it is cut there
                size[tight] = (~low[tight] + U64(1)) & (_BOTTOM - U64(1))
            self.shift(todo, low)
            low, size = low << _OUT, size << _OUT
            self.low[todo], self.range[todo] = low, size
            todo = todo[((low ^ (low + size)) < _TOP) | (size < _BOTTOM)]


class _Encoder(_Coder):
    def __init__(self, lanes: int, most: int):
        super().__init__(lanes)
        self.out = np.zeros((lanes, most * 4 + 16), "<u2")
        self.size = np.zeros(lanes, np.int64)

    def shift(self, lanes: np.ndarray, low: np.ndarray) -> None:
        at = self.size.take(lanes)
        self.out[lanes, at] = low >> U64(48)
        self.size[lanes] = at + 1

    def close(self) -> list[bytes]:
        every = np.arange(len(self.low))
        for _ in range(4):
            self.shift(every, self.low)
            self.low <<= _OUT
        return [row[:n].tobytes() for row, n in zip(self.out, self.size.tolist())]


class _Decoder(_Coder):
    def __init__(self, blocks: list[bytes]):
        super().__init__(len(blocks))
        self.data = np.zeros((len(blocks), max(map(len, blocks)) // 2 + 8), "<u2")
        for row, block in zip(self.data, blocks):
            row[: len(block) // 2] = np.frombuffer(block, "<u2", len(block) // 2)
        self.code = np.zeros(len(blocks), U64)
        for i in range(4):
            self.code = self.code << _OUT | self.data[:, i]
        self.place = np.full(len(blocks), 4)

    def peek(self, at, span: np.ndarray, total: int) -> np.ndarray:
        """Where in total the code stands, in units of span."""
        return np.minimum((self.code[at] - self.low[at]) // span, U64(total - 1)).astype(np.int64)

    def shift(self, lanes: np.ndarray, low: np.ndarray) -> None:
        at = self.place.take(lanes)
        more = self.data[lanes, np.minimum(at, self.data.shape[1] - 1)]  # a damaged block may run on
        self.code[lanes] = self.code.take(lanes) << _OUT | more
        self.place[lanes] = at + 1


def _still(lengths: np.ndarray, step: int) -> int:
    """How many lanes go on; lengths do not grow."""
    return int(np.searchsorted(-lengths, -step, "left"))


def pack(ids: np.ndarray, block: int = BLOCK) -> tuple[bytes, list[tuple[int, int, bytes]]]:
    """The prior of ids, and (number of ids, crc32, bytes) of each block of block ids (the
    last may be shorter).

    Ids are unsigned 32-bit integers; ValueError if any other is among them."""
    if len(ids) and not 0 <= ids.min() <= ids.max() < 1 << 32:
        raise ValueError("token ids must be from 0 to 4294967295")
    prior = Prior.fit(ids)
    lanes = -(-len(ids) // block)
    grid = np.zeros(lanes * block, np.int64)
    grid[: len(ids)] = np.searchsorted(prior.ids, ids)
    grid = np.ascontiguousarray(grid.reshape(lanes, block).T)
    lengths = np.minimum(block, len(ids) - np.arange(lanes) * block)
    model, coder = _Model(lanes, prior), _Encoder(lanes, block)
    for step in range(int(lengths[0]) if lanes else 0):
        n = _still(lengths, step)
        now, every = grid[step, :n], slice(0, n)
        second, first = model.ready(n)
        hit2 = now == model.guess2
        hit1 = ~hit2 & (now == model.guess1)
        miss = ~(hit2 | hit1)
        both = second + first
        start = miss * both + hit1 * second
        coder.narrow(every, coder.range[every] >> U64(_BITS), start, np.where(hit2, second, np.where(hit1, first, _ONE - both)))
        missed = np.flatnonzero(miss)
        if len(missed):
            said = now.take(missed)
            at = missed * (model.k + 1) + prior.of.take(said)
            low = model.above_flat.take(at)
            wide = model.above_flat.take(at + 1) - low
            coder.narrow(missed, coder.range.take(missed) >> U64(_WITHIN + _CLASS), (low << _WITHIN) + wide * prior.start.take(said), wide * prior.width.take(said))
        model.learn(now, hit2, hit1, missed)
    plain = ids.astype("<u4")
    blocks = [(int(k), zlib.crc32(plain[i * block : i * block + int(k)].tobytes()), data) for i, (k, data) in enumerate(zip(lengths, coder.close()))]
    return prior.data(), blocks


def unpack(prior: bytes, blocks: list[tuple[int, int, bytes]]) -> np.ndarray:
    """The ids of blocks (number of ids, crc32, bytes) of a prior, longest first; ValueError
    if one is damaged."""
    if not blocks:
        return np.empty(0, np.int64)
    lengths = np.array([k for k, _, _ in blocks])
    if (np.diff(lengths) > 0).any():
        raise ValueError("blocks must come in order of length")
    prior = Prior.read(prior)
    by_place = np.repeat(np.arange(len(prior.ids), dtype=np.int32), prior.width)
    grid = np.zeros((int(lengths[0]), len(blocks)), np.int64)
    model, coder = _Model(len(blocks), prior), _Decoder([data for _, _, data in blocks])
    for step in range(int(lengths[0])):
        n = _still(lengths, step)
        every = slice(0, n)
        second, first = model.ready(n)
        both = second + first
        span = coder.range[every] >> U64(_BITS)
        count = coder.peek(every, span, _ONE)
        hit2, miss = count < second, count >= both
        hit1 = ~(hit2 | miss)
        coder.narrow(every, span, miss * both + hit1 * second, np.where(hit2, second, np.where(hit1, first, _ONE - both)))
        now = np.where(hit2, model.guess2, model.guess1).astype(np.int64)
        missed = np.flatnonzero(miss)
        if len(missed):
            span = coder.range.take(missed) >> U64(_WITHIN + _CLASS)
            count = coder.peek(missed, span, 1 << (_WITHIN + _CLASS))
            kind = (model.above[missed, 1:] <= (count >> _WITHIN)[:, None]).sum(1)
            at = missed * (model.k + 1) + kind
            low = model.above_flat.take(at)
            wide = model.above_flat.take(at + 1) - low
            place = np.minimum((count - (low << _WITHIN)) // wide, (1 << _WITHIN) - 1)
            said = by_place.take((kind << _WITHIN) + place)
            coder.narrow(missed, span, (low << _WITHIN) + wide * prior.start.take(said), wide * prior.width.take(said))
            now[missed] = said
        np.maximum(now, 0, out=now)  # a damaged block may name what no table holds
        model.learn(now, hit2, hit1, missed)
        grid[step, :n] = now
    out = []
    for i, (k, crc, _) in enumerate(blocks):
        ids = prior.ids[grid[:k, i]]
        if zlib.crc32(ids.astype("<u4").tobytes()) != crc:
            raise ValueError(f"block {i} is damaged")
        out.append(ids)
    return np.concatenate(out)


class Writer:
    """Writes documents' ids to a stream; holds at most LANES blocks of them."""

    def __init__(self, stream):
        self.stream, self.held, self.many = stream, [], 0
        self.names, self.sizes = [], []
        self.at = 0
        self._put(_MAGIC)

    def _put(self, data: bytes) -> None:
        self.stream.write(data)
        self.at += len(data)

    def add(self, names: list[str | None], sizes: list[int], ids: np.ndarray) -> None:
        """The ids of some documents, one after another."""
        self.names += names
        self.sizes += sizes
        self.held.append(ids)
        self.many += len(ids)
        while self.many >= LANES * BLOCK:
            every = np.concatenate(self.held)
            self._group(every[: LANES * BLOCK])
            self.held, self.many = [every[LANES * BLOCK :]], len(every) - LANES * BLOCK

    def _group(self, ids: np.ndarray) -> None:
        self.put_group(group(*pack(ids)))

    def put_group(self, data: bytes) -> None:
        """A group that is packed already."""
        self._put(data)

    def close(self, named: bytes | None = None) -> None:
        """Ends the file; named is its index, if it is not of the documents added."""
        if self.many:
            self._group(np.concatenate(self.held))
        self._put(struct.pack("<I", 0))
        place = self.at
        self._put(index(self.names, self.sizes) if named is None else named)
        self._put(struct.pack("<Q", place) + _END)


def group(prior: bytes, blocks: list[tuple[int, int, bytes]]) -> bytes:
    """A group of packed blocks as it stands in a file."""
    heads = b"".join(struct.pack("<III", k, len(data), crc) for k, crc, data in blocks)
    return struct.pack("<II", len(blocks), len(prior)) + heads + prior + b"".join(data for _, _, data in blocks)


def ungroup(data: bytes) -> tuple[bytes, list[tuple[int, int, bytes]]]:
    many, size = struct.unpack_from("<II", data)
    at = 8 + 12 * many
    prior, blocks = data[at : at + size], []
    at += size
    for k, b, crc in struct.iter_unpack("<III", data[8 : 8 + 12 * many]):
        blocks.append((k, crc, data[at : at + b]))
        at += b
    return prior, blocks


def index(names: list[str | None], sizes: list[int]) -> bytes:
    return zlib.compress(json.dumps([names, sizes]).encode())


def read_index(source) -> tuple[list[str | None], list[int]]:
    """Names and numbers of ids of the documents of a seekable binary file."""
    source.seek(0)
    if source.read(8) != _MAGIC:
        raise ValueError("not a token file")
    size = source.seek(0, os.SEEK_END)
    source.seek(size - 16)
    place, end = struct.unpack("<Q8s", source.read(16))
    if end != _END:
        raise ValueError("the token file has no end")
    source.seek(place)
    return json.loads(zlib.decompress(source.read(size - 16 - place)))


def read_groups(source):
    """The groups' bytes of a seekable binary file, in order."""
    source.seek(8)
    while many := struct.unpack("<I", head := source.read(4))[0]:
        head += source.read(4 + 12 * many)
        size = struct.unpack_from("<I", head, 4)[0] + sum(b for _, b, _ in struct.iter_unpack("<III", head[8:]))
        yield head + source.read(size)


def _documents(names, sizes, groups):
    """(name, ids) of each document, from the ids of the groups."""
    held = np.empty(0, np.uint32)
    for name, n in zip(names, sizes):
        while len(held) < n:
            more = next(groups, None)
            if more is None:
                raise ValueError("the token file lacks ids")
            held = np.concatenate([held, more])
        yield name, held[:n]
        held = held[n:]


def read_documents(source):
    """(name, ids) of each document of a seekable binary file."""
    names, sizes = read_index(source)
    yield from _documents(names, sizes, (unpack(*ungroup(data)) for data in read_groups(source)))


class WordTokens:
    """Ids by the tokenizers library; what stands between single blanks is encoded once.

    A blank after a non-blank starts a new word of a byte-level vocabulary, so such pieces
    encode by themselves, and so do a piece that ends in a letter or digit of ASCII and the
    punctuation marks behind it.  Arrow finds the distinct pieces of a batch, the library gets
    new ones joined (the bytes of the tokens tell where each ends), and numpy puts their ids
    together.  Texts with blanks in a row, or special tokens, go to the library whole.

    Once there are more words than ``memo``, or _KEPT bytes of them, all but those of the
    present batch are forgotten; that changes nothing but time.
    """

    def __init__(self, path: str, memo: int = 1_000_000):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        added = {i: t.content for i, t in self.library.get_added_tokens_decoder().items()}
        self.special = list(added.values())
        vocabulary = self.library.get_vocab(with_added_tokens=True)
        self.bytes_of = np.zeros(max(vocabulary.values(), default=0) + 1, np.int64)
        for token, i in vocabulary.items():  # a byte is one letter of a byte-level token
            self.bytes_of[i] = len(added[i].encode()) if i in added else len(token)
        self.most = memo
        # words by number, and where the ids of each begin and how many they are
        self.known = pa.array([], pa.string())
        self.flat, self.begins, self.sizes = np.empty(0, "<u4"), np.empty(0, np.int64), np.empty(0, np.int64)

    def _ids(self, texts: list[str]) -> list[np.ndarray]:
        out = []  # a few texts a call: what the library returns of a token is many times its id
        for i in range(0, len(texts), 256):
            out += [np.array(e.ids, "<u4") for e in self.library.encode_batch_fast(texts[i : i + 256], add_special_tokens=False)]
        return out

    def _words(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids, number of ids of each) of words that encode by themselves behind a blank."""
        if not len(words):
            return np.empty(0, "<u4"), np.empty(0, np.int64)
        cuts = pa.array([*range(0, len(words), _JOINED), len(words)], pa.int32())
        joined = pc.binary_join(pa.ListArray.from_arrays(cuts, words), " ")
        ids = np.concatenate(self._ids([" " + x for x in joined.to_pylist()]))
        ends = np.cumsum(self.bytes_of[ids])
        wanted = np.cumsum(np.asarray(pc.binary_length(words)).astype(np.int64) + 1)
        cuts = np.searchsorted(ends, wanted) + 1
        if cuts[-1] != len(ids) or (ends[cuts - 1] != wanted).any():
            own = self._ids([" " + w for w in words.to_pylist()])
            return np.concatenate(own), np.array([len(x) for x in own], np.int64)
        return ids, np.diff(cuts, prepend=0)

    def _numbers(self, words: pa.Array) -> np.ndarray:
        """The numbers of distinct words that stand behind a blank."""
        found = pc.index_in(words, value_set=self.known)
        missing = np.asarray(pc.is_null(found).cast(pa.uint8())).astype(bool)
        new, found = words.filter(pa.array(missing)), pc.fill_null(found, 0).to_numpy().copy()
        if len(self.known) + len(new) > self.most or self.known.nbytes + new.nbytes > _KEPT:
            kept = found[~missing]
            self.known, self.flat = self.known.take(pa.array(kept)), _gather(self.flat, self.begins[kept], self.sizes[kept])
            self.sizes = self.sizes[kept]
            self.begins = np.cumsum(self.sizes) - self.sizes
            found[~missing] = np.arange(len(kept))
        if len(new):
            found[missing] = np.arange(len(self.known), len(self.known) + len(new))
            ids, sizes = self._words(new)
            self.known = pa.concat_arrays([self.known, new])
            self.begins = np.concatenate([self.begins, len(self.flat) + np.cumsum(sizes) - sizes])
            self.sizes, self.flat = np.concatenate([self.sizes, sizes]), np.concatenate([self.flat, ids])
        return found

    def _pieces(self, pieces: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids of distinct pieces behind a blank, number of ids of each, whether it does not
        encode by itself)."""
        odd = pc.or_(pc.equal(pieces, ""), pc.not_equal(pc.utf8_trim_whitespace(pieces), pieces))
        stems = pc.utf8_rtrim(pieces, characters=_MARKS)
        stems = pc.if_else(pc.match_substring_regex(stems, "[0-9A-Za-z]$"), stems, pieces)
        words = pc.if_else(odd, None, stems).dictionary_encode()
        of = pc.fill_null(words.indices, 0).to_numpy()
        odd = np.asarray(odd.cast(pa.uint8())).astype(bool)
        number = self._numbers(words.dictionary) if len(words.dictionary) else np.empty(0, np.int64)
        cut = np.asarray(pc.binary_length(pieces)) > np.asarray(pc.binary_length(stems))
        ends = [p[len(p.rstrip(_MARKS)) :] for p in pieces.filter(pa.array(cut)).to_pylist()]
        marks = {tail: k for k, tail in enumerate(dict.fromkeys(ends), 1)}
        own = [np.empty(0, "<u4"), *self._ids(list(marks))]
        wide = np.array([len(x) for x in own], np.int64)
        tail = np.zeros(len(pieces), np.int64)
        tail[cut] = [marks[x] for x in ends]
        # each piece is a run of its word's ids and one of its marks'
        begins, sizes = np.zeros((len(pieces), 2), np.int64), np.zeros((len(pieces), 2), np.int64)
        plain = np.flatnonzero(~odd)
        begins[plain, 0], sizes[plain, 0] = self.begins[number[of[plain]]], self.sizes[number[of[plain]]]
        begins[:, 1], sizes[:, 1] = len(self.flat) + (np.cumsum(wide) - wide)[tail], wide[tail]
        sizes[odd] = 0
        return _gather(np.concatenate([self.flat, *own]), begins.ravel(), sizes.ravel()), sizes.sum(1), odd

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts one after another, where each text's ids end); null is empty."""
        if not len(texts):
            return np.empty(0, "<u4"), np.empty(0, np.int64)
        texts = pc.fill_null(texts.cast(pa.string()), "")
        split = pc.split_pattern(texts, " ")
        ends = np.asarray(split.offsets)[1:].astype(np.int64) - np.asarray(split.offsets)[0]
        first = np.concatenate([[0], ends[:-1]])
        pieces = split.flatten()
        lead = pieces.take(pa.array(first)).to_pylist()
        coded = pieces.dictionary_encode()
        del split, pieces
        flat, known, odd = self._pieces(coded.dictionary)
        # a text's first piece has no blank before it: it has a code of its own
        alone = np.array([not d or d[-1].isspace() for d in lead])
        own = self._ids(["" if skip else d for d, skip in zip(lead, alone.tolist())])
        size = np.array([len(x) for x in own], np.int64)
        at = coded.indices.to_numpy().copy()
        at[first] = np.arange(len(known), len(known) + len(first), dtype=at.dtype)
        sizes = np.concatenate([known, size])
        begins, sizes = (np.cumsum(sizes) - sizes).astype(np.int32), sizes.astype(np.int32)
        alone |= np.logical_or.reduceat(np.concatenate([odd, np.zeros(len(first), bool)])[at], first)
        for special in self.special:
            alone |= np.asarray(pc.match_substring(texts, special).cast(pa.uint8())).astype(bool)
        n = sizes.take(at)
        which = np.flatnonzero(alone)
        for i in which.tolist():
            n[first[i] : ends[i]] = 0
        ids = _gather(np.concatenate([flat, *own]), begins.take(at), n)
        per = np.add.reduceat(n, first, dtype=np.int64)
        if len(which):
            whole = self._ids(texts.take(pa.array(which)).to_pylist())
            cuts, kept, done = np.cumsum(per), [], 0
            for i, x in zip(which.tolist(), whole):
                kept += [ids[done : cuts[i]], x]
                done = cuts[i]
            ids = np.concatenate([*kept, ids[done:]])
            per[which] = [len(x) for x in whole]
        return ids, np.cumsum(per)


def _gather(flat: np.ndarray, begins: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The runs of flat of these begins and sizes, one after another."""
    ends = np.cumsum(sizes, dtype=np.int64)
    many = int(ends[-1]) if len(ends) else 0
    kind = np.int32 if max(many, len(flat)) < 1 << 31 else np.int64
    return flat.take(np.repeat((begins - (ends - sizes)).astype(kind), sizes) + np.arange(many, dtype=kind))


_tokens: dict[str, WordTokens] = {}


def write_token_files(docs: DataFrame, folder: str, vocabulary: str, end_id: int = 0, id: str = "doc_id", text: str = "text") -> DataFrame:
    """Files of the documents' ids, each followed by end_id, in ascending order of id: part,
    path, docs, tokens.  Nulls come first, rows of equal ids in the order of a text hash.

    Files that a lost or repeated task left are not listed."""
    base = docs.select(named(id).alias("id"), named(text).alias("text"), text_key(text).alias("_key"))
    order = base.repartitionByRange(shuffles(docs.sparkSession), F.col("id").asc_nulls_first(), "_key").sortWithinPartitions(F.col("id").asc_nulls_first(), "_key")
    kinds = "ids binary, prior binary, named binary, docs long, tokens long"
    schema = pa.schema([("ids", pa.binary()), ("prior", pa.binary()), ("named", pa.binary()), ("docs", pa.int64()), ("tokens", pa.int64())])

    @tidy
    def tokenise(batches):  # a row for each group of blocks, then one of the index
        coder = _tokens.get(vocabulary) or _tokens.setdefault(vocabulary, WordTokens(vocabulary))
        names, sizes, held, many, tokens = [], [], [], 0, 0
        for part in _together(batches, 1, _TEXT):
            ids, ends = coder.encode(part.column(1))
            held.append(np.insert(ids, ends, end_id))
            names += part.column(0).to_pylist()
            sizes += (np.diff(ends, prepend=0) + 1).tolist()
            many += len(held[-1])
            while many >= LANES * BLOCK:
                every = np.concatenate(held)
                yield _row(schema, every[: LANES * BLOCK])
                held, many, tokens = [every[LANES * BLOCK :]], many - LANES * BLOCK, tokens + LANES * BLOCK
        if many:
            yield _row(schema, np.concatenate(held))
        if names:
            yield pa.RecordBatch.from_pylist([{"named": index(names, sizes), "docs": len(names), "tokens": tokens + many}], schema)

    @tidy
    def write(batches):
        out, writer, name = None, None, f"{folder}/{uuid.uuid4().hex}.tok"
        for batch in batches:
            for data, named, docs, tokens in zip(*batch.columns):
                if writer is None:
                    files, inner = filesystem(folder)
                    files.create_dir(inner, recursive=True)
                    out = files.open_output_stream(f"{inner}/{name.rpartition('/')[2]}", compression=None)
                    writer = Writer(out)
                if data.is_valid:
                    writer.put_group(data.as_buffer())
                    continue
                writer.close(named.as_py())
                out.close()
                yield pa.RecordBatch.from_arrays(
                    [pa.array([TaskContext.get().partitionId()]), pa.array([name]), pa.array([docs.as_py()]), pa.array([tokens.as_py()])], ["part", "path", "docs", "tokens"]
                )

    texts = order.select(F.col("id").cast("string"), "text")
    code = jvm.function(docs.sparkSession, "TokenCoder")
    packed = texts.mapInArrow(tokenise, kinds).select(code("ids", "prior").alias("data"), "named", "docs", "tokens")
    return stored(packed.mapInArrow(write, "part long, path string, docs long, tokens long"), "token-files")


def _together(batches, column: int, most: int):
    """Batches of rows whose texts have about so many bytes together, in order."""
    held, size = [], 0
    for batch in batches:
        for part in parts(batch, column, most):
            held.append(part)
            size += pc.sum(pc.binary_length(part.column(column))).as_py() or 0
            if size >= most:
                yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
                held, size = [], 0
    yield from pa.Table.from_batches(held).combine_chunks().to_batches() if held else []


def _row(schema: pa.Schema, ids: np.ndarray) -> pa.RecordBatch:
    """The row of a group's ids and prior."""
    return pa.RecordBatch.from_pylist([{"ids": ids.astype("<u4").tobytes(), "prior": Prior.fit(ids).data()}], schema)


def read_token_files(files: DataFrame) -> DataFrame:
    """id (string), start, n_tokens, ids_crc32 of every document of the files written."""
    starts = files.select("path", (F.sum("tokens").over(Window.orderBy("part")) - F.col("tokens")).alias("first"))  # a row for each file
    kinds = "first long, named binary, data binary"
    schema = pa.schema([("first", pa.int64()), ("named", pa.binary()), ("data", pa.binary())])

    @tidy
    def fetch(batches):  # a row of each file's index, then one for each group
        for batch in batches:
            for path, first in zip(*(c.to_pylist() for c in batch.columns)):
                system, inner = filesystem(path)
                with system.open_input_file(inner) as source:
                    yield pa.RecordBatch.from_pylist([{"first": first, "named": index(*read_index(source))}], schema)
                    for data in read_groups(source):
                        yield pa.RecordBatch.from_pylist([{"data": data}], schema)

    @tidy
    def read(batches):
        rows = (row for batch in batches for row in zip(*batch.columns))
        head = next(rows, None)
        while head is not None:
            first, heads = head[0].as_py(), []
            names, sizes = json.loads(zlib.decompress(head[1].as_py()))
            begins, sums = (first + np.cumsum([0, *sizes[:-1]])).tolist(), []

            def groups():
                for row in rows:
                    if row[0].is_valid:  # the next file
                        heads.append(row)
                        return
                    yield np.frombuffer(row[2].as_buffer(), "<u4")

            more = groups()
            for _, ids in _documents(names, sizes, more):
                sums.append(zlib.crc32(ids.astype("<u4", copy=False)))
            for _ in more:
                pass
            head = heads[0] if heads else None
            yield pa.RecordBatch.from_arrays(
                [pa.array(names, pa.string()), *(pa.array(x, pa.int64()) for x in (begins, sizes, sums))], ["id", "start", "n_tokens", "ids_crc32"]
            )

    spread = starts.repartition(max(shuffles(files.sparkSession), 1), "path").mapInArrow(fetch, kinds)
    code = jvm.function(files.sparkSession, "TokenCoder")
    ids = spread.select("first", "named", code("data", F.lit(None).cast("binary")).alias("ids"))
    return ids.mapInArrow(read, "id string, start long, n_tokens long, ids_crc32 long")


def token_file_digests(docs: DataFrame, vocabulary: str) -> DataFrame:
    """Writes the token files of docs and reads them back: doc_id, start, n_tokens, ids_crc32."""
    files = write_token_files(docs, new_path(docs.sparkSession, "tokens"), vocabulary)
    kind = docs.schema["doc_id"].dataType.simpleString()
    return read_token_files(files).select(F.col("id").cast(kind).alias("doc_id"), "start", "n_tokens", "ids_crc32")
