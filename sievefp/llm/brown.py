"""Language model scoring with a Brown class-based bigram model.

P(text) is the product over its words, and one end, of P(class | class before) times
P(word | class).  Classes come from exchange clustering of the words themselves: every word of
the training documents moves to the class that raises the likelihood of the corpus most, given
how often the word stands before and after each class; counts are then taken anew with the new
classes, and so on.  The HEAD most frequent words move one after another on the driver.  All
other words move side by side, each by its own counts against the totals of the classes.

Documents are held as chunks of tokens: places in the list of the chunk's distinct words.  The
vocabulary (word, count, class) is a table in buckets of words by hash.  In each round every
chunk is sent the classes of its words, and every bucket the contexts of its words; only the
classes' totals and the HEAD words' contexts are gathered.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark import TaskContext

from sievefp.llm.common import SPACES, U64, byte_table, drop, mix, named, shuffles, slabs, stored, word_hashes

#: Words in a table of contexts that exchange works on.
SLOTS = 1 << 14
CLASSES = 32
SIDES = 2 * CLASSES  # a class before, a class after
EXCHANGES = 3
#: The most frequent words, which move one after another; all others move side by side.
HEAD = SLOTS
#: A chunk of documents is closed at this many tokens.
CHUNK = 1 << 20
ADD = 0.5
#: Stands for the end of a text among the word hashes.
END = int(mix(np.array([0xE0F], U64), 99)[0])
_inside = byte_table(SPACES)


def token_rows(column: pa.Array, end: bool = True):
    """(first row, row after, token hashes with an end after each row, tokens per row)."""
    for a, b, data, offsets in slabs(column):
        hashes, counts = word_hashes(data, offsets, _inside)
        tokens = np.insert(hashes, np.cumsum(counts), U64(END))
        yield a, b, tokens, counts + 1


def spread(words: np.ndarray) -> np.ndarray:
    """The class a word begins in, and that of words no training document holds."""
    return (mix(words, 5) % U64(CLASSES)).astype(np.uint8)


def is_training(id: str):
    """crc32 of the id as text, modulo 5, is not 1; a null id counts as an empty text."""
    return F.pmod(F.crc32(F.coalesce(named(id).cast("string"), F.lit("")).cast("binary")), F.lit(5)) != 1


def _array(value, kind: str) -> np.ndarray:
    return np.frombuffer(value.as_buffer(), kind)


def _batch(rows: list[tuple], kinds: dict) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds.values())], list(kinds))


def _by_bucket(words: np.ndarray, parts: int):
    """(bucket, first, after last) of words in order of bucket."""
    ends = np.searchsorted((words % U64(parts)).astype(np.int64), np.arange(parts + 1))
    return [(k, ends[k], ends[k + 1]) for k in np.flatnonzero(np.diff(ends)).tolist()]


def _chunks(docs: DataFrame, id: str, text: str, parts: int) -> DataFrame:
    """Consecutive rows of docs: their ids, held_out and numbers of tokens (lens), the distinct
    words by bucket and hash with their training counts (n), and tokens as places in words."""

    def run(batches):
        number, kept, size = TaskContext.get().partitionId() << 32, [], 0

        def row():
            ids, held, tokens, lens = zip(*kept)
            held, lens = pa.concat_arrays(held), np.concatenate(lens)
            words, at = np.unique(np.concatenate(tokens), return_inverse=True)
            order = np.argsort(words % U64(parts), kind="stable")
            rank = np.empty(len(words), np.int32)
            rank[order] = np.arange(len(words))
            words, at = words[order], rank[at]
            n = np.bincount(at[np.repeat(~held.to_numpy(zero_copy_only=False), lens)], minlength=len(words))
            lists = [pa.ListArray.from_arrays(pa.array([0, len(held)], pa.int32()), x) for x in (pa.concat_arrays(ids), held)]
            data = [pa.array([x.tobytes()], pa.binary()) for x in (lens.astype("<i8"), words, n.astype("<i8"), at)]
            return pa.RecordBatch.from_arrays([pa.array([number]), *lists, *data], ["chunk", "ids", "held", "lens", "words", "n", "tokens"])

        for batch in batches:
            for a, b, tokens, lens in token_rows(batch.column(2)):
                kept.append((batch.column(0).slice(a, b - a), batch.column(1).slice(a, b - a), tokens, lens))
                size += len(tokens)
                if size >= CHUNK:
                    yield row()
                    number, kept, size = number + 1, [], 0
        if kept:
            yield row()

    kind = docs.schema[id].dataType.simpleString()
    rows = docs.select(named(id).alias("id"), (~is_training(id)).alias("held_out"), named(text).alias("text"))
    return rows.mapInArrow(run, f"chunk long, ids array<{kind}>, held array<boolean>, lens binary, words binary, n binary, tokens binary")


_VOCABULARY = {"bucket": pa.int32(), "words": pa.binary(), "n": pa.binary(), "kinds": pa.binary()}
_VOCABULARY_SQL = "bucket int, words binary, n binary, kinds binary"
_CONTEXTS = _VOCABULARY | {"per": pa.binary(), "side": pa.binary(), "x": pa.binary()}
_CONTEXTS_SQL = f"{_VOCABULARY_SQL}, per binary, side binary, x binary"


def _vocabulary(chunks: DataFrame, parts: int) -> DataFrame:
    """One row a bucket: all words of training documents, by hash, with counts and first classes."""

    def split(batches):
        for batch in batches:
            for words, n in zip(*batch.columns):
                words, n = _array(words, "<u8"), _array(n, "<i8")
                words, n = words[n > 0], n[n > 0]
                rows = [(k, words[a:b].tobytes(), n[a:b].tobytes(), None) for k, a, b in _by_bucket(words, parts)]
                if rows:
                    yield _batch(rows, _VOCABULARY)

    def merge(batches):
        found: dict[int, list] = {}
        for batch in batches:
            for k, words, n, _ in zip(*batch.columns):
                found.setdefault(k.as_py(), []).append((_array(words, "<u8"), _array(n, "<i8")))
        for k, held in found.items():
            words, at = np.unique(np.concatenate([w for w, _ in held]), return_inverse=True)
            n = np.bincount(at, np.concatenate([n for _, n in held])).astype("<i8")
            yield _batch([(k, words.tobytes(), n.tobytes(), spread(words).tobytes())], _VOCABULARY)

    pieces = chunks.select("words", "n").mapInArrow(split, _VOCABULARY_SQL)
    return pieces.repartitionById(parts, F.col("bucket")).mapInArrow(merge, _VOCABULARY_SQL)


def _given(chunks: DataFrame, vocabulary: DataFrame, parts: int, counts: bool = False) -> DataFrame:
    """Chunk by chunk, what the buckets hold of its words: classes, and counts where asked."""
    kinds = {"bucket": pa.int32(), "chunk": pa.int64(), "words": pa.binary(), "n": pa.binary(), "kinds": pa.binary()}

    def ask(batches):
        for batch in batches:
            for chunk, words in zip(*batch.columns):
                chunk, words = chunk.as_py(), _array(words, "<u8")
                yield _batch([(k, chunk, words[a:b].tobytes(), None, None) for k, a, b in _by_bucket(words, parts)], kinds)

    def answer(batches):
        asked: dict[int, list] = {}
        known: dict[int, tuple] = {}
        for batch in batches:
            for k, chunk, words, n, kind in zip(*batch.columns):
                if chunk.is_valid:
                    asked.setdefault(k.as_py(), []).append((chunk.as_py(), _array(words, "<u8")))
                else:
                    known[k.as_py()] = _array(words, "<u8"), _array(n, "<i8"), _array(kind, "u1")
        for k, held in asked.items():
            words, n, kind = known.get(k, (np.empty(0, U64), np.empty(0, np.int64), np.empty(0, np.uint8)))
            rows = []
            for chunk, of in held:
                out, often = spread(of), np.zeros(len(of), np.int64)
                if len(words):
                    at = np.minimum(np.searchsorted(words, of), len(words) - 1)
                    hit = words[at] == of
                    out[hit], often[hit] = kind[at[hit]], n[at[hit]]
                rows.append((chunk, k, out.tobytes(), often.astype("<i8").tobytes() if counts else b""))
            yield _batch(rows, {"chunk": pa.int64(), "bucket": pa.int32(), "kinds": pa.binary(), "n": pa.binary()})

    asks = chunks.select("chunk", "words").mapInArrow(ask, "bucket int, chunk long, words binary, n binary, kinds binary")
    both = asks.union(vocabulary.select("bucket", F.lit(None).cast("long"), "words", "n", "kinds"))
    answers = both.repartitionById(parts, F.col("bucket")).mapInArrow(answer, "chunk long, bucket int, kinds binary, n binary")
    return answers.groupBy("chunk").agg(F.sort_array(F.collect_list(F.struct("bucket", "kinds", "n"))).alias("given"))


def _joined(chunks: DataFrame, given: DataFrame, columns: list[str]) -> DataFrame:
    return chunks.select("chunk", *columns).hint("merge").join(given, "chunk").select("given", *columns)


def _read(given, held, lens, words, tokens):
    """(class of each word, its bytes of counts, held_out, lens, words, tokens, token before each)."""
    given = given.as_py()
    kinds = np.frombuffer(b"".join(g["kinds"] for g in given), np.uint8)
    held = held.values.to_numpy(zero_copy_only=False)
    lens, words, tokens = _array(lens, "<i8"), _array(words, "<u8"), _array(tokens, "<i4")
    end = int(np.flatnonzero(words == U64(END))[0])
    before = np.concatenate([[np.int32(end)], tokens[:-1]])
    before[np.cumsum(lens)[:-1]] = end
    return kinds, b"".join(g["n"] for g in given), held, lens, words, tokens, before


def _contexts(chunks: DataFrame, vocabulary: DataFrame, parts: int) -> DataFrame:
    """The vocabulary with how often a class stands before (side = class) and after (side =
    CLASSES + class) each word: per, how many sides each word has; side; x, how often."""

    def count(batches):
        for batch in batches:
            for row in zip(*batch.columns):
                kinds, _, held, lens, words, tokens, before = _read(*row)
                train = np.repeat(~held, lens)
                right, left = tokens[train].astype(np.int64), before[train].astype(np.int64)
                table = np.bincount(np.concatenate([right * SIDES + kinds[left], left * SIDES + CLASSES + kinds[right]]), minlength=len(words) * SIDES)
                at = np.flatnonzero(table)
                x, side, per = table[at].astype("<i4"), (at % SIDES).astype(np.uint8), np.bincount(at // SIDES, minlength=len(words))
                words, per = words[per > 0], per[per > 0].astype(np.uint8)
                ends = np.concatenate([[0], np.cumsum(per, dtype=np.int64)])
                rows = [
                    (k, words[a:b].tobytes(), None, None, per[a:b].tobytes(), side[ends[a] : ends[b]].tobytes(), x[ends[a] : ends[b]].tobytes())
                    for k, a, b in _by_bucket(words, parts)
                ]
                if rows:
                    yield _batch(rows, _CONTEXTS)

    def add(batches):
        found: dict[int, list] = {}
        known: dict[int, tuple] = {}
        for batch in batches:
            for k, words, n, kinds, per, side, x in zip(*batch.columns):
                if n.is_valid:
                    known[k.as_py()] = _array(words, "<u8"), n.as_py(), kinds.as_py()
                else:
                    found.setdefault(k.as_py(), []).append((_array(words, "<u8"), _array(per, "u1"), _array(side, "u1"), _array(x, "<i4")))
        for k, (words, n, kinds) in known.items():
            held = found.pop(k)
            keys = [np.repeat(np.searchsorted(words, w), per) * SIDES + side for w, per, side, _ in held]
            table = np.bincount(np.concatenate(keys), np.concatenate([x for *_, x in held]), len(words) * SIDES)
            at = np.flatnonzero(table)
            per, side = np.bincount(at // SIDES, minlength=len(words)).astype(np.uint8), (at % SIDES).astype(np.uint8)
            yield _batch([(k, words.tobytes(), n, kinds, per.tobytes(), side.tobytes(), table[at].astype("<i8").tobytes())], _CONTEXTS)

    both = _joined(chunks, _given(chunks, vocabulary, parts), ["held", "lens", "words", "tokens"])
    empty = [F.lit(None).cast("binary").alias(c) for c in ("per", "side", "x")]
    pieces = both.mapInArrow(count, _CONTEXTS_SQL).union(vocabulary.select(*_VOCABULARY, *empty))
    return pieces.repartitionById(parts, F.col("bucket")).mapInArrow(add, _CONTEXTS_SQL)


def _gain(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1))


def exchange(before: np.ndarray, after: np.ndarray, classes: np.ndarray, sweeps: int = 2, others: np.ndarray | float = 0.0, fixed: int = -1) -> np.ndarray:
    """Moves each word, the most frequent first, to its best class; contexts' classes stay.

    A class is worth the sum of x log x over its context counts, less n log n for each side;
    a word moves where that sum over classes grows most.  others: context counts by class of
    the words that are not here; fixed: a word that does not move.
    """
    classes = classes.copy()
    joint = np.concatenate([before, after], axis=1).astype(np.float64)
    profile = np.zeros((CLASSES, 2 * CLASSES))
    np.add.at(profile, classes, joint)
    profile += others
    order = np.argsort(-joint.sum(1), kind="stable")
    order = order[joint[order].sum(1) > 0]
    worth = lambda p: _gain(p).sum(-1) - 2 * _gain(p[..., :CLASSES].sum(-1))
    for _ in range(sweeps):
        moved = 0
        value = worth(profile)
        for s in order.tolist():
            if s == fixed:
                continue
            old = classes[s]
            profile[old] -= joint[s]
            value[old] = worth(profile[old])
            best = int(np.argmax(worth(profile + joint[s]) - value))
            profile[best] += joint[s]
            value[best] = worth(profile[best])
            classes[s] = best
            moved += best != old
        if not moved:
            break
    return classes


def _head(counts: DataFrame, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and counts of the most frequent words, at most ``most``, in order of hash."""
    level = F.floor(F.log(F.col("n").cast("double")) * 32)
    levels = sorted(((r[0], r[1]) for r in counts.groupBy(level.alias("l")).count().collect()), reverse=True)
    total, low = 0, None
    for at, n in levels:
        total += n
        if total > most:
            break
        low = at
    if low is None:
        return np.empty(0, U64), np.empty(0)
    found = counts.filter(level >= low).select("word", "n").toArrow()
    words, n = found["word"].to_numpy().view(U64), found["n"].to_numpy()
    order = np.argsort(words)
    return words[order], n[order].astype(np.float64)


def best_classes(joint: np.ndarray, kinds: np.ndarray, profile: np.ndarray) -> np.ndarray:
    """The class whose contexts make those of each word (its own left out) most likely."""

    def logs(p):
        sides = p.reshape(*p.shape[:-1], 2, CLASSES)
        return (np.log(sides + ADD) - np.log(sides.sum(-1, keepdims=True) + ADD * CLASSES)).reshape(p.shape)

    out = kinds.copy()
    for a in range(0, len(joint), 1 << 14):
        own, at = joint[a : a + (1 << 14)], kinds[a : a + (1 << 14)]
        value = own @ logs(profile).T
        value[np.arange(len(own)), at] = (own * logs(np.maximum(profile[at] - own, 0))).sum(1)
        out[a : a + (1 << 14)] = value.argmax(1)
    return out


def _table(words: np.ndarray, per, side, x) -> np.ndarray:
    """Contexts as a table of words by sides."""
    table = np.zeros((len(words), SIDES))
    table[np.repeat(np.arange(len(words)), _array(per, "u1")), _array(side, "u1")] = _array(x, "<i8")
    return table


def _places(head: np.ndarray, words: np.ndarray):
    """(places in words of head words, their places in head)."""
    at = np.minimum(np.searchsorted(head, words), len(head) - 1) if len(head) else np.zeros(len(words), int)
    hit = np.flatnonzero(head[at] == words) if len(head) else np.empty(0, int)
    return hit, at[hit]


def _exchanged(contexts: DataFrame, head: np.ndarray) -> DataFrame:
    """The vocabulary with every word moved to its best class."""
    spark = contexts.sparkSession
    shared = spark.sparkContext.broadcast(head)

    def gather(batches):
        profile, rows = np.zeros(CLASSES * SIDES), []
        for batch in batches:
            for _, words, _, kinds, per, side, x in zip(*batch.columns):
                words, kinds = _array(words, "<u8"), _array(kinds, "u1")
                keys = np.repeat(kinds.astype(np.int64), _array(per, "u1")) * SIDES + _array(side, "u1")
                profile += np.bincount(keys, _array(x, "<i8"), CLASSES * SIDES)
                hit, at = _places(shared.value, words)
                rows.append((at, kinds[hit], _table(words, per, side, x)[hit]))
        if rows:
            at, kinds, joint = (np.concatenate(c) for c in zip(*rows))
            data = [profile, at.astype("<i8"), kinds, joint]
            yield pa.RecordBatch.from_arrays([pa.array([d.tobytes()], pa.binary()) for d in data], ["profile", "at", "kinds", "joint"])

    profile, joint, kinds = np.zeros((CLASSES, SIDES)), np.zeros((len(head), SIDES)), np.zeros(len(head), np.int64)
    for r in contexts.mapInArrow(gather, "profile binary, at binary, kinds binary, joint binary").toLocalIterator():
        profile += np.frombuffer(r["profile"]).reshape(CLASSES, SIDES)
        at = np.frombuffer(r["at"], "<i8")
        joint[at], kinds[at] = np.frombuffer(r["joint"]).reshape(-1, SIDES), np.frombuffer(r["kinds"], np.uint8)
    np.add.at(profile, kinds, -joint)
    fixed = np.flatnonzero(head == U64(END))
    moved = exchange(joint[:, :CLASSES], joint[:, CLASSES:], kinds, others=profile, fixed=int(fixed[0]) if len(fixed) else -1)
    np.add.at(profile, moved, joint)
    model = spark.sparkContext.broadcast((head, moved.astype(np.uint8), profile))

    def move(batches):
        head, moved, profile = model.value
        for batch in batches:
            for k, words, n, kinds, per, side, x in zip(*batch.columns):
                words, old = _array(words, "<u8"), _array(kinds, "u1")
                new = best_classes(_table(words, per, side, x), old, profile)
                new[words == U64(END)] = old[words == U64(END)]
                hit, at = _places(head, words)
                new[hit] = moved[at]
                yield _batch([(k.as_py(), words.tobytes(), n.as_py(), new.tobytes())], _VOCABULARY)

    return contexts.mapInArrow(move, _VOCABULARY_SQL)


def _words(vocabulary: DataFrame) -> DataFrame:
    """word (hash), n, class of all training words."""

    def run(batches):
        for batch in batches:
            for words, n, kinds in zip(*batch.columns):
                data = _array(words, "<i8"), _array(n, "<i8"), _array(kinds, "u1").astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(d) for d in data], ["word", "n", "class"])

    return vocabulary.select("words", "n", "kinds").mapInArrow(run, "word long, n long, class int")


class ClassModel:
    """log10 of transitions between classes, and of the emissions' denominators."""

    def __init__(self, joint: np.ndarray, members: np.ndarray):
        """joint[class, class before]; members: words of each class."""
        mass = joint.sum(1)
        # P(class | class before) and, for a word seen n times, P(word | class) = (n + ADD) / (mass + ADD * (members + 1))
        self.step = np.log10((joint.T + ADD) / (joint.sum(0)[:, None] + ADD * CLASSES))
        self.below = np.log10(mass + ADD * (members + 1))


def train(chunks: DataFrame, vocabulary: DataFrame, parts: int) -> DataFrame:
    """Exchange clustering: the vocabulary with the class of each word."""
    head, _ = _head(_words(vocabulary), HEAD)
    for _ in range(EXCHANGES):
        contexts = stored(_contexts(chunks, vocabulary, parts), "contexts")
        drop(vocabulary)
        vocabulary = stored(_exchanged(contexts, head), "classes")
        drop(contexts)
    return vocabulary


def _transitions(both: DataFrame) -> np.ndarray:
    """[class, class before] counts of the training documents."""

    def count(batches):
        total = np.zeros(CLASSES * CLASSES, np.int64)
        for batch in batches:
            for row in zip(*batch.columns):
                kinds, _, held, lens, _, tokens, before = _read(*row)
                train = np.repeat(~held, lens)
                total += np.bincount(kinds[tokens[train]].astype(np.int64) * CLASSES + kinds[before[train]], minlength=CLASSES * CLASSES)
        if total.any():
            yield pa.RecordBatch.from_arrays([pa.array([total.astype("<i8").tobytes()], pa.binary())], ["counts"])

    joint = np.zeros(CLASSES * CLASSES, np.int64)
    found = stored(both.mapInArrow(count, "counts binary"), "transitions")
    for r in found.toLocalIterator():
        joint += np.frombuffer(r["counts"], "<i8")
    drop(found)
    return joint.reshape(CLASSES, CLASSES)


def score(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """id, held_out, n_tokens, n_known, train_tokens, base_score, score of every row of docs.

    Tokens are the words, ASCII-lower-cased and parted by ASCII white space, and one end; a
    null or empty text is an end alone.  Without training documents every count is 0 and N is
    0.  Words are told apart by 64-bit hashes.  Rows that repeat are scored each.
    """
    spark, parts = docs.sparkSession, shuffles(docs.sparkSession)
    chunks = stored(_chunks(docs, id, text, parts), "chunks")
    vocabulary = stored(_vocabulary(chunks, parts), "vocabulary")
    vocabulary = train(chunks, vocabulary, parts)
    members, total = np.zeros(CLASSES), 0
    for r in _words(vocabulary).groupBy("class").agg(F.count("*").alias("words"), F.sum("n").alias("n")).collect():
        members[r["class"]], total = r["words"], total + r["n"]
    given = stored(_given(chunks, vocabulary, parts, counts=True), "given")
    drop(vocabulary)
    columns = ["held", "lens", "words", "tokens"]
    shared = spark.sparkContext.broadcast(ClassModel(_transitions(_joined(chunks, given, columns)), members))
    base_below = float(np.log10(total + ADD * (members.sum() + 1)))

    def run(batches):
        model = shared.value
        for batch in batches:
            for ids, *row in zip(batch.column(5), *batch.columns[:5]):
                kinds, often, held, lens, _, tokens, before = _read(*row)
                often = np.frombuffer(often, "<i8")
                rows = np.repeat(np.arange(len(lens)), lens)
                known = np.bincount(rows, often[tokens] > 0, len(lens)).astype(np.int64)
                logs = np.bincount(rows, np.log10(often + ADD)[tokens], len(lens))
                kind = kinds[tokens]
                steps = np.bincount(rows, model.step[kinds[before], kind] - model.below[kind], len(lens))
                data = [pa.array(held), pa.array(lens), pa.array(known), pa.array(np.full(len(lens), total, np.int64)), pa.array(logs - lens * base_below), pa.array(logs + steps)]
                yield pa.RecordBatch.from_arrays([ids.values, *data], [id, "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    kind = docs.schema[id].dataType.simpleString()
    return _joined(chunks, given, [*columns, "ids"]).mapInArrow(
        run, f"`{id}` {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    )
