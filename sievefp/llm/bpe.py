"""Byte-level BPE encoding and decoding by prefix-sharing trie traversal.

The BPE encoding of a string is fixed by its last token and the encoding of what stands
before it.  So each batch's new distinct words form a trie, and one depth-first walk
gives every node - every prefix of any word - its last token: the longest token that ends
there and may follow the last token of the shorter prefix.  Whatever prefix words share
is worked out once, and a word's ids are read off by going back from its node.

Two tokens may stand side by side unless some merge across their border would come before
the merges that complete them.  While BPE runs, the token left of the border climbs the
right spine of the left token's merge tree and the one right of it climbs the left spine
of the right token's; both climb by merge rank, so walking the two spines together tests
every pair that ever meets at the border.
"""

from __future__ import annotations

import hashlib
import json
from itertools import chain, islice

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievefp.llm.common import extended, named, parts, tidy

# The byte alphabet of byte-level BPE - printable bytes stand for themselves,
# the others follow from code point 256 on.
_PRINTABLE = [*range(33, 127), *range(161, 173), *range(174, 256)]
#: Fixed value: the split pattern of this vocabulary.
SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
_NEVER = 1 << 60


def byte_letters() -> dict[str, int]:
    hidden = [b for b in range(256) if b not in set(_PRINTABLE)]
    return {chr(b): b for b in _PRINTABLE} | {chr(256 + i): b for i, b in enumerate(hidden)}


class TrieBpe:
    """Encodes and decodes with the vocabulary and merges of a tokenizer file.

    What stands between blanks stays with its ids in a memo of about twice ``memo`` entries;
    its size changes nothing but time.
    """

    def __init__(self, path: str, memo: int = 250_000):
        spec = json.loads(open(path, encoding="utf-8").read())
        if spec["normalizer"] is not None or spec["model"]["type"] != "BPE" or spec["pre_tokenizer"]["add_prefix_space"]:
            raise ValueError("a plain byte-level BPE file is needed")
        letters = byte_letters()
        unletter = lambda s: bytes(letters[c] for c in s)
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.ids = {unletter(t): i for t, i in spec["model"]["vocab"].items() if t not in self.special}
        self.bytes_of = {i: b for b, i in self.ids.items()} | {i: s.encode() for s, i in self.special.items()}
        pairs = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
        self.rank: dict[tuple[int, int], int] = {}
        made: dict[int, tuple[int, int, int]] = {}
        for rank, (a, b) in enumerate(pairs):
            a, b = unletter(a), unletter(b)
            pair = self.ids[a], self.ids[b]
            self.rank[pair] = rank
            made.setdefault(self.ids[a + b], (rank, *pair))
        # spines: (token, rank of the merge that swallows it), from a byte up to the token itself
        self.right_spine, self.left_spine = {}, {}
        for i in sorted(self.bytes_of, key=lambda i: made.get(i, (-1,))[0]):
            for spine, side in ((self.right_spine, 2), (self.left_spine, 1)):
                if i in made:
                    rank, child = made[i][0], made[i][side]
                    spine[i] = [*spine[child][:-1], (child, rank), (i, _NEVER)]
                else:
                    spine[i] = [(i, _NEVER)]
        # a token takes part only if its own text encodes to it
        self.usable = {b: i for b, i in self.ids.items() if len(b) == 1 or (i in made and self.may_follow(*made[i][1:], below=made[i][0]))}
        self.pairs: dict[int, bool] = {}
        self.split = regex.compile(SPLIT)
        self.cut = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")") if self.special else None
        self.most = memo
        self.chunks: dict[str, str] = {}  # text between single blanks -> ids with its leading blank
        self.old: dict[str, str] = {}
        self.bound: dict[bytes, int] = {}  # the longest token by its last three bytes
        for b in self.usable:
            self.bound[b[-3:]] = max(self.bound.get(b[-3:], 1), len(b))
        self.text_of = {str(i): b for i, b in self.bytes_of.items()}

    def may_follow(self, left: int, right: int, below: int = _NEVER) -> bool:
        """Whether no merge of rank under below crosses the border of two tokens."""
        ls, rs, i, j = self.right_spine[left], self.left_spine[right], 0, 0
        rank = self.rank.get
        while True:
            a, a_until = ls[i]
            b, b_until = rs[j]
            r = rank((a, b), _NEVER)
            if r < below and r < a_until and r <= b_until:
                return False
            if a_until <= b_until:
                if a_until == _NEVER:
                    return True
                i += 1
            else:
                j += 1

    def _follows(self, left: int, right: int) -> bool:
        key = left << 32 | right
        known = self.pairs.get(key)
        if known is None:
            if len(self.pairs) > 2_000_000:
                self.pairs.clear()
            known = self.pairs[key] = self.may_follow(left, right)
        return known

    def _learn(self, words: set[str]) -> dict[str, str]:
        """Encodes distinct words in one depth-first walk of their trie.

        Sorted, the words are the trie in depth-first order: ``last`` and ``size`` hold the
        states of the path to the present node, and going on to the next word goes up to
        the node where the two part and down from there.
        """
        out: dict[str, str] = {}
        usable, bound, follows = self.usable.get, self.bound.get, self._follows
        last: list[int] = [-1]  # by depth: last token, None where no word has asked for it yet
        size: list[int] = [0]

        def settle(word: bytes, depth: int) -> None:
            longest = bound(word[depth - 3 : depth]) if depth > 2 else depth
            for n in range(min(longest or 2, depth), 0, -1):
                token = usable(word[depth - n : depth])
                if token is not None:
                    if depth != n:
                        if last[depth - n] is None:
                            settle(word, depth - n)
                        if not follows(last[depth - n], token):
                            continue
                    last[depth], size[depth] = token, n
                    return

        before = b""
        for word, text in sorted((w.encode(), w) for w in words):
            depth, most = 0, min(len(before), len(word))
            while depth < most and before[depth] == word[depth]:
                depth += 1
            more = [None] * (len(word) - depth)
            last[depth + 1 :], size[depth + 1 :] = more, more
            before = word
            for step in range(400, len(word), 400):  # long words: no deep recursion
                if last[step] is None:
                    settle(word, step)
            ids, at = [], len(word)
            if at and last[at] is None:
                settle(word, at)
            while at:
                if last[at] is None:
                    settle(word, at)
                ids.append(str(last[at]))
                at -= size[at]
            ids.reverse()
            out[text] = ",".join(ids)
        return out

    def _recall(self, chunks) -> list[str]:
        """Known chunks that are not in the young memo; it takes over those in the old one."""
        old = self.old.get
        for chunk in chunks:
            known = old(chunk)
            if known is not None:
                self.chunks[chunk] = known
        return [c for c in chunks if c not in self.chunks]

    def learn(self, texts: list[str]) -> None:
        """Encodes what these texts hold between single blanks and what is not known yet.

        The memo has two halves; when the young one is full, the old one goes.
        """
        if len(self.chunks) > self.most:
            self.old, self.chunks = self.chunks, {}
        seen: set[str] = set()
        for text in texts:
            seen.update(text.split(" ")[1:])
        missing = self._recall(seen.difference(self.chunks))
        found = {c: self.split.findall(" " + c) for c in missing if c and not c[0].isspace() and not c[-1].isspace()}
        ids = self._learn({w for words in found.values() for w in words})
        for chunk, words in found.items():
            self.chunks[chunk] = ",".join([ids[w] for w in words])

    def rest(self, keep: int = 50_000) -> None:
        """Keeps so many entries of the memo, the young half's first; words that are met first
        are mostly frequent ones."""
        self.chunks, self.old = dict(islice(chain(self.chunks.items(), self.old.items()), keep)), {}

    def _piece(self, text: str) -> str:
        """Comma-joined ids of text without special tokens.

        A blank after a non-blank always starts a new word, so what stands between single
        blanks encodes by itself and repeats often.  Elsewhere the words of the whole text
        are encoded.
        """
        head, *rest = text.split(" ")
        found = list(map(self.chunks.get, rest))
        if None in found or head[-1:].isspace() or not head:
            words = self.split.findall(text)
            ids = self._learn(set(words))
            return ",".join([ids[w] for w in words])
        words = self.split.findall(head)
        ids = self._learn(set(words))
        return ",".join([*(ids[w] for w in words), *found])

    def encode_joined(self, text: str) -> str:
        """The ids in decimal, joined by commas; empty for an empty text."""
        if not text:
            return ""
        if self.cut is None or not any(s in text for s in self.special):
            return self._piece(text)
        parts = (str(self.special[p]) if p in self.special else self._piece(p) for p in self.cut.split(text) if p)
        return ",".join(parts)

    def encode_batch(self, texts: list[str | None], most: int = 1 << 25):
        """encode_joined of each text; what is new in about 32 MB of them is learnt at once."""
        start = 0
        while start < len(texts):
            stop, held = start, 0
            while stop < len(texts) and (stop == start or held < most):
                held += len(texts[stop] or "")
                stop += 1
            self.learn([t for t in texts[start:stop] if t])
            for text in texts[start:stop]:
                yield self.encode_joined(text or "")
            start = stop

    def encode(self, text: str) -> list[int]:
        return self.listed(self.encode_joined(text))

    @staticmethod
    def listed(joined: str) -> list[int]:
        return list(map(int, joined.split(","))) if joined else []

    def decode_joined(self, joined: str) -> str:
        if not joined:
            return ""
        return b"".join(map(self.text_of.__getitem__, joined.split(","))).decode("utf-8", "replace")

    def decode(self, ids: list[int]) -> str:
        return b"".join(map(self.bytes_of.__getitem__, ids)).decode("utf-8", "replace")


_coders: dict[str, TrieBpe] = {}


def coder(path: str) -> TrieBpe:
    """One for each Python worker and file; its memo lives as long as the worker."""
    if path not in _coders:
        _coders[path] = TrieBpe(path)
    return _coders[path]


def encode_documents(docs: DataFrame, path: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """Adds the column ids (array<int>) with the ids of the whole text.

    A null text has null ids; an empty text has none.  Other columns stay as they are; one
    that is called like ids is replaced.
    """
    names = [c for c in docs.columns if c != ids]
    at = names.index(text)

    def run(batches):
        bpe = coder(path)
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                part = batch.slice(start, 256)
                texts = part.column(at).to_pylist()
                made = [None if t is None else bpe.listed(j) for t, j in zip(texts, bpe.encode_batch(texts))]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(made, pa.list_(pa.int32()))], [*names, ids])

    base = docs.select(*[named(c) for c in names])
    return base.mapInArrow(run, extended(base, ids, "array<int>"))


def decode_documents(coded: DataFrame, path: str, ids: str = "ids", text: str = "text") -> DataFrame:
    """Adds the column text decoded from ids, special tokens included; null ids give null."""
    names = [c for c in coded.columns if c != text]
    at = names.index(ids)

    def run(batches):
        bpe = coder(path)
        for batch in batches:
            made = [None if i is None else bpe.decode(i) for i in batch.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(made, pa.string())], [*names, text])

    base = coded.select(*[named(c) for c in names])
    return base.mapInArrow(run, extended(base, text, "string"))


def bpe_digests(docs: DataFrame, path: str, ids: bool = False, part: int = 1 << 25, lean: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every row; null counts as empty.

    The text that is digested is decoded from the ids.  Rows that repeat, and null ids, give
    one row each.  With ids=True the column ids holds them as little-endian unsigned 32-bit
    integers.  Rows are encoded and handed on in parts of so many bytes of text; with
    lean=True a Python worker keeps only some of its memo for its next partition.  Both change
    nothing but time and memory.
    """
    import numpy as np

    def run(batches):
        bpe = coder(path)
        sha = hashlib.sha256
        for batch in (some for whole in batches for some in parts(whole, 1, part)):
            n, coded, plain, packed = [], [], [], []
            for joined in bpe.encode_batch(batch.column(1).to_pylist()):
                n.append(joined.count(",") + 1 if joined else 0)
                coded.append(sha(joined.encode()).hexdigest())
                plain.append(sha(bpe.decode_joined(joined).encode()).hexdigest())
                if ids:
                    packed.append(np.fromstring(joined, "<u4", sep=",").tobytes())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n, pa.int64()), pa.array(coded), pa.array(plain), *[pa.array(packed, pa.binary())] * ids],
                ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", *["ids"] * ids],
            )
        if lean:
            bpe.rest()

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(tidy(run), f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string{', ids binary' * ids}")
