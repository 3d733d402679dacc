"""Language-model scoring with Brown's class-based bigrams.

Words are lower-cased (A-Z) runs of non-white-space; every text closes with one end token. Exchange clustering moves
one word at a time to the class where the class-bigram likelihood of the training texts rises most, until nothing moves
(or ``ROUNDS`` rounds); it works on *symbols*: the ``EXCHANGED`` most frequent words, one of ``GROUPS`` groups of all
other words (by their last two bytes), and the end. Then every other word that occurs ``LEAST`` times or more takes the
class where its own bigrams are likeliest, given the symbols' classes. Words that occur once stand for unseen ones: both
are left in the groups, which are classes, as is the end. Transitions are counted anew from the final classes of all
words. A text's score is

    sum of log10 P(class | class before) + log10 P(word | class)

with additive smoothing in both (``ALPHA`` for transitions, ``DELTA`` for emissions; a class of rarer
words keeps one place for a word that was never seen).

How it runs: texts are cut into words once, and written as *blocks* of some ``BLOCK_TEXT`` bytes of text: the block's
distinct words as 64-bit hashes, and the texts as places in that list. All later passes read blocks, with arrays:

1. symbol bigrams, summed up in tasks;
2. contexts (classes before and behind) of each distinct word of a block, one row each, shuffled by word: a word's class
   and count, the table of all words, which grows with the corpus;
3. each distinct word of a block asks that table once for class and count; the ``KNOWN`` most frequent words, which are
   sent to every task (17 bytes each), aren't asked for. Answers go back to their block in one exchange;
4. the classes of all words of a block are written, one byte a word, with the sums of each text. Transitions, and with
   them the scores, are sums over these.

What reaches the driver and all tasks is bounded by parameters: symbol bigrams (at most ``symbols ** 2`` cells), the
``KNOWN`` most frequent words, class bigrams.

Defined cases: null texts count as empty; an empty text is one end token; null ids are held out;
very long texts are a block of their own; ties in frequency go by hash, ties between classes to the first one;
with no training text every probability is the smoothing's (base: log10(0.1 / 0.1) = 0 a token);
rows that repeat id and text are counted each and scored alike; an empty table gives an empty
result; all input columns come back inside ``row``.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlens.llm.common import attach, pack, ship, staged, table
from ledgerlens.llm.language import remainder

#: Words that exchange clustering places, classes that it has, groups of the other words.
EXCHANGED, CLASSES, GROUPS = 800, 48, 32
ROUNDS = 8
#: Classes, groups and the end; least count of a word that gets a class.
SIZE, LEAST = CLASSES + GROUPS + 1, 2
END = SIZE - 1
#: Most words whose classes and counts are sent to every task.
KNOWN = 200_000
ALPHA, DELTA = 0.1, 0.1
#: Bytes of text in a block.
BLOCK_TEXT = 8 << 20
#: Contexts as they are shuffled: class behind, or SIZE and class before; how often.
_CONTEXT = np.dtype([("cell", "u1"), ("n", "<u2")])
_MOST = 65_535


def group_of(word: bytes) -> int:
    """The group of a word that isn't placed."""
    return (word[-1] * 31 + (word[-2] if len(word) > 1 else 0)) % GROUPS


def word_hash(word: bytes) -> int:
    return int(np.uint64(xxhash.xxh3_64_intdigest(word)).astype(np.int64))


# ---------------------------------------------------------------- blocks


def _words_of(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """All words of some texts, and how many each text has."""
    lists = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts, "")))
    ends = lists.offsets.to_numpy()
    words = lists.values.slice(ends[0], ends[-1] - ends[0])
    there = pc.greater(pc.binary_length(words), 0).to_numpy(zero_copy_only=False)
    upto = np.concatenate([[0], np.cumsum(there)])
    return words.filter(pa.array(there)) if not there.all() else words, np.diff(upto[ends - ends[0]])


def _groups(words: pa.Array) -> np.ndarray:
    """``group_of`` of all words."""
    n = len(words)
    words = pa.concat_arrays([words])  # from offset 0
    ends = np.frombuffer(words.buffers()[1], np.int32)[1:n + 1]
    data = np.frombuffer(words.buffers()[2], np.uint8) if n else np.zeros(0, np.uint8)
    size = np.diff(np.concatenate([[0], ends]))
    before = np.where(size > 1, data[np.maximum(ends - 2, 0)], 0).astype(np.int64)
    return ((data[ends - 1].astype(np.int64) * 31 + before) % GROUPS).astype(np.uint8)


_BLOCK = "block long, learned long, train binary, sizes binary, codes binary, hashes binary, groups binary"


def _block(number: int, ids: list, ks: list, train: list, texts: list) -> pa.RecordBatch:
    coded, sizes, tables = [], [], []
    for t in texts:
        words, n = _words_of(t)
        sizes.append(n)
        d = words.dictionary_encode()
        coded.append(d.indices.to_numpy(zero_copy_only=False))
        tables.append(d.dictionary)
    whole = pa.concat_arrays(tables).dictionary_encode()
    place, at = whole.indices.to_numpy(zero_copy_only=False), 0
    for i, t in enumerate(tables):
        coded[i] = place[at:at + len(t)][coded[i]]
        at += len(t)
    names = whole.dictionary
    hashes = np.fromiter((xxhash.xxh3_64_intdigest(w) for w in names.cast(pa.binary()).to_pylist()), np.uint64, len(names))
    arrays = [np.concatenate(train).astype(np.uint8), np.concatenate(sizes).astype(np.int32), np.concatenate(coded).astype(np.uint32), hashes, _groups(names)]
    ids, ks = pa.concat_arrays(ids), pa.concat_arrays(ks)
    lists = [pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x) for x in (ids, ks)]
    return pa.RecordBatch.from_arrays([*lists, pa.array([number], pa.int64()), pa.array([int(arrays[0].sum())], pa.int64()), *[pa.array([a.tobytes()], pa.binary()) for a in arrays]],
                                      names=["ids", "ks", *[x.split()[0] for x in _BLOCK.split(", ")]])


def _cut(batches):
    """For mapInArrow over (id, text, learn, k): the blocks of a task."""
    number, held, size = TaskContext.get().partitionId() << 32, ([], [], [], []), 0
    for b in batches:
        bytes_of = pc.binary_length(b.column("text")).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
        first = 0
        while first < b.num_rows:
            upto = first + max(1, int(np.searchsorted(np.cumsum(bytes_of[first:]), max(BLOCK_TEXT - size, 1))) + 1)
            part = b.slice(first, upto - first)
            size += int(bytes_of[first:upto].sum())
            train = part.column("learn").to_numpy(zero_copy_only=False)
            for have, x in zip(held, (part.column("id"), part.column("k"), train, part.column("text"))):
                have.append(x)
            first = upto
            if size >= BLOCK_TEXT:
                yield _block(number, *held)
                number, held, size = number + 1, ([], [], [], []), 0
    if held[0]:
        yield _block(number, *held)
    pa.default_memory_pool().release_unused()  # a worker lives on


def blocks_of(docs: DataFrame, learn: Column, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The texts in blocks, written. ``learn``: a condition on the rows of ``docs``."""
    ship(docs.sparkSession)
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"), F.coalesce(learn, F.lit(False)).alias("learn"))
    id_type = dict(rows.dtypes)["id"]
    return staged(rows.withColumn("k", F.xxhash64("id", "text")).mapInArrow(_cut, f"ids array<{id_type}>, ks array<long>, {_BLOCK}"), "lm-blocks")


class _Block:
    def __init__(self, row: dict):
        get = lambda name, kind: np.frombuffer(row[name], kind)
        self.number, self.train, self.sizes = row["block"], get("train", np.uint8).astype(bool), get("sizes", np.int32).astype(np.int64)
        self.codes, self.hashes, self.groups = get("codes", np.uint32), get("hashes", np.uint64), get("groups", np.uint8)

    def sequence(self, of_code: np.ndarray, end: int, train_only: bool) -> np.ndarray:
        """``of_code`` of all words, text after text, with ``end`` before, between and behind the texts."""
        return with_ends(of_code[self.codes], self.sizes, end, self.train if train_only else None)


def with_ends(values: np.ndarray, sizes: np.ndarray, end: int, keep: np.ndarray | None = None) -> np.ndarray:
    if keep is not None:
        values, sizes = values[np.repeat(keep, sizes)], sizes[keep]
    return np.insert(values, np.concatenate([[0], np.cumsum(sizes)]), end)


def text_sums(values: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Sums of the values of each text."""
    out, there = np.zeros(len(sizes)), sizes > 0
    if there.any():
        out[there] = np.add.reduceat(values, (np.cumsum(sizes) - sizes)[there])
    return out


def _each_block(batches):
    for b in batches:
        for i in range(b.num_rows):
            yield _Block({n: b.column(n)[i].as_py() for n in b.schema.names if n not in ("ids", "ks")}), b.slice(i, 1)


# ---------------------------------------------------------------- exchange


def _frequent(batches):
    """Words that are frequent in their block, as candidates for exchange."""
    for block, _ in _each_block(batches):
        codes = block.codes[np.repeat(block.train, block.sizes)]
        n = np.bincount(codes, minlength=len(block.hashes))
        at = np.flatnonzero(n >= max(1, len(codes) // 50_000))
        yield pa.RecordBatch.from_arrays([pa.array(block.hashes[at].view(np.int64)), pa.array(n[at])], names=["h", "n"])


def _find(table_hashes: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of hashes in a sorted table, and whether they are there."""
    at = np.minimum(np.searchsorted(table_hashes, hashes), max(len(table_hashes) - 1, 0))
    return at, table_hashes[at] == hashes if len(table_hashes) else np.zeros(len(hashes), bool)


def _symbol_pairs(top: np.ndarray, place: np.ndarray):
    symbols = EXCHANGED + GROUPS + 1

    def run(batches):
        total = np.zeros(symbols * symbols, np.int64)
        for block, _ in _each_block(batches):
            at, there = _find(top, block.hashes)
            of = np.where(there, place[at] if len(place) else 0, EXCHANGED + block.groups.astype(np.int64))
            s = block.sequence(of.astype(np.int32), symbols - 1, True)
            total += np.bincount(s[:-1] * symbols + s[1:], minlength=len(total))
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(total[at])], names=["cell", "n"])

    return run


def _xlogx(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1))


def exchange(pairs: np.ndarray, movable: int, classes: int = CLASSES, rounds: int = ROUNDS) -> np.ndarray:
    """Class of every symbol; the first ``movable`` symbols are moved among the first ``classes`` classes."""
    n, size = len(pairs), classes + len(pairs) - movable
    of = np.concatenate([np.arange(movable) % classes, classes + np.arange(n - movable)])
    one = np.zeros((n, size))
    one[np.arange(n), of] = 1
    left, right = pairs.T @ one, pairs @ one  # by symbol: class before, class behind
    cells = one.T @ right
    for _ in range(rounds):
        moved = 0
        for w in range(movable):
            a, r, c, self_n = of[w], right[w].copy(), left[w].copy(), pairs[w, w]
            if not r.any() and not c.any():
                continue
            r[a] -= self_n
            c[a] -= self_n
            rest = cells.copy()
            rest[a] -= r
            rest[:, a] -= c
            rest[a, a] -= self_n
            rows, cols = rest.sum(1) + c, rest.sum(0) + r  # what precedes or follows w counts, whatever its class
            wr, wc = r.sum() + self_n, c.sum() + self_n
            k = np.arange(classes)
            gain = (_xlogx(rest[k] + r) - _xlogx(rest[k])).sum(1) + (_xlogx(rest[:, k].T + c) - _xlogx(rest[:, k].T)).sum(1)
            # the class's own cell was counted in its row and in its column
            own, rk, ck = rest[k, k], r[k], c[k]
            gain += _xlogx(own + rk + ck + self_n) + _xlogx(own) - _xlogx(own + rk) - _xlogx(own + ck)
            gain -= _xlogx(rows[k] + wr) - _xlogx(rows[k]) + _xlogx(cols[k] + wc) - _xlogx(cols[k])
            b = int(np.argmax(gain))
            if b != a and gain[b] > gain[a] + 1e-9:
                moved += 1
            else:
                b = a
            cells = rest
            cells[b] += r
            cells[:, b] += c
            cells[b, b] += self_n
            if b != a:
                of[w] = b
                left[:, a] -= pairs[w]
                left[:, b] += pairs[w]
                right[:, a] -= pairs[:, w]
                right[:, b] += pairs[:, w]
        if not moved:
            break
    return of


# ---------------------------------------------------------------- the table of all words


def _contexts(top: np.ndarray, top_class: np.ndarray):
    """For each distinct training word of a block: its hash, group, and contexts (see _CONTEXT) as bytes."""

    def run(batches):
        for block, _ in _each_block(batches):
            at, there = _find(top, block.hashes)
            kind = np.int32 if len(block.hashes) * 2 * SIZE < 2**31 else np.int64
            cls = np.where(there, top_class[at] if len(top_class) else 0, CLASSES + block.groups.astype(np.int64)).astype(kind)
            seq, codes = block.sequence(cls, END, True), with_ends(block.codes.astype(kind), block.sizes, -1, block.train)
            word = codes[1:-1] >= 0
            keys, one = np.empty(2 * int(word.sum()), kind), codes[1:-1][word] * kind(2 * SIZE)
            keys[:len(one)], keys[len(one):] = one + seq[2:][word], one + kind(SIZE) + seq[:-2][word]
            del one, codes, seq, word
            keys, n = np.unique(keys, return_counts=True)
            many = (n + _MOST - 1) // _MOST  # more than fit are several entries
            if (many > 1).any():
                first = np.repeat(np.cumsum(many) - many, many)
                part = np.arange(many.sum()) - first
                keys, n = np.repeat(keys, many), np.minimum(np.repeat(n, many) - part * _MOST, _MOST)
            packed = np.empty(len(keys), _CONTEXT)
            packed["cell"], packed["n"] = keys % (2 * SIZE), n
            code = keys // (2 * SIZE)
            starts = np.flatnonzero(np.concatenate([[True], code[1:] != code[:-1]])) if len(code) else np.zeros(0, np.int64)
            words = code[starts]
            ends = np.append(starts, len(code)).astype(np.int32) * _CONTEXT.itemsize
            bytes_ = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(ends.tobytes()), pa.py_buffer(packed.tobytes())])
            whole = pa.RecordBatch.from_arrays([pa.array(block.hashes[words].view(np.int64)), pa.array(block.groups[words].astype(np.int32)), bytes_],
                                               names=["h", "grp", "contexts"])
            for k in range(0, whole.num_rows, 20_000):
                yield whole.slice(k, 20_000)
        pa.default_memory_pool().release_unused()

    return run


def _place(cells: np.ndarray, top: np.ndarray, top_class: np.ndarray):
    """For mapInArrow over contexts sorted by word: class and count of each word."""
    into = np.log((cells + ALPHA) / (cells.sum(1, keepdims=True) + ALPHA * SIZE))
    size = cells.sum(1)[:CLASSES]
    fits = np.vstack([into[:CLASSES].T, into[:, :CLASSES]])

    def placed(h, grp, sums):
        n = sums[:, :SIZE].sum(1)
        best = (sums @ fits - n[:, None] * np.log(size + n[:, None])).argmax(1)
        at, there = _find(top, h.view(np.uint64))
        cls = np.where(there, top_class[at] if len(top_class) else 0, np.where(n >= LEAST, best, CLASSES + grp))
        return pa.RecordBatch.from_arrays([pa.array(h), pa.array(cls.astype(np.int32)), pa.array(np.rint(n).astype(np.int64))], names=["h", "cls", "n"])

    def run(batches):
        last, kept = None, np.zeros((1, 2 * SIZE))
        for b in batches:
            if not b.num_rows:
                continue
            h, grp, packed = b.column("h").to_numpy(), b.column("grp").to_numpy().astype(np.int64), pa.concat_arrays([b.column("contexts")])
            ends = np.frombuffer(packed.buffers()[1], np.int32)[:len(packed) + 1] // _CONTEXT.itemsize
            entries = np.frombuffer(packed.buffers()[2], _CONTEXT, int(ends[-1]))
            new = np.concatenate([[True], h[1:] != h[:-1]])
            row = np.repeat(np.cumsum(new) - 1, np.diff(ends))
            sums = np.bincount(row * (2 * SIZE) + entries["cell"], entries["n"], new.sum() * 2 * SIZE).reshape(-1, 2 * SIZE)
            h, grp = h[new], grp[new]
            if last is not None and h[0] == last[0]:
                sums[0] += kept[0]
            elif last is not None:
                yield placed(*last, kept)
            if len(h) > 1:
                yield placed(h[:-1], grp[:-1], sums[:-1])
            last, kept = (h[-1:].copy(), grp[-1:].copy()), sums[-1:].copy()
        if last is not None:
            yield placed(*last, kept)

    return run


# ---------------------------------------------------------------- the model


@dataclass
class Model:
    """The most frequent words (hashes in order, classes, counts), the table of all words (h, cls, n), the sums of the
    training tokens, and the logarithms of transitions and of the classes' sizes."""

    top: np.ndarray
    top_class: np.ndarray
    top_n: np.ndarray
    words: DataFrame
    least: float
    class_n: np.ndarray
    class_v: np.ndarray
    n_train: int
    total: int
    distinct: int
    moves: np.ndarray | None = None

    @property
    def den(self) -> np.ndarray:
        places = self.class_v + np.where(np.arange(CLASSES + GROUPS) < CLASSES, 0, 1)  # a group has one for unseen words
        return np.log10(np.maximum(self.class_n + DELTA * places, DELTA))

    @property
    def base_den(self) -> float:
        return float(np.log10(self.total + 0.1 * (self.distinct + 1)))


def _step():
    """Counts in steps of an eighth of an octave."""
    return F.floor(F.log2("n") * 8).cast("int")


def _lexicon(blocks: DataFrame) -> Model:
    """Classes and counts of all training words."""
    counts = blocks.mapInArrow(_frequent, "h long, n long").groupBy("h").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "h").limit(EXCHANGED).toArrow()
    hashes = counts.column("h").to_numpy().view(np.uint64)
    order = np.argsort(hashes)
    top, symbols = hashes[order], EXCHANGED + GROUPS + 1
    cells = blocks.mapInArrow(_symbol_pairs(top, order), "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()
    pairs = np.zeros(symbols * symbols)
    pairs[cells.column("cell").to_numpy()] = cells.column("n").to_numpy()
    pairs = pairs.reshape(symbols, symbols)
    of = exchange(pairs, EXCHANGED)
    one = np.zeros((symbols, SIZE))
    one[np.arange(symbols), of] = 1
    top_class = of[order].astype(np.int64)
    words = staged(blocks.mapInArrow(_contexts(top, top_class), "h long, grp int, contexts binary").repartition("h").sortWithinPartitions("h")
                   .mapInArrow(_place(one.T @ pairs @ one, top, top_class), "h long, cls int, n long"), "lm-words")
    class_n, class_v = np.zeros(CLASSES + GROUPS), np.zeros(CLASSES + GROUPS)
    for r in words.groupBy("cls").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("v")).collect():
        class_n[r.cls], class_v[r.cls] = r.n, r.v
    least, room = 1 << 30, KNOWN
    for s, m in sorted(words.groupBy(_step().alias("s")).agg(F.count(F.lit(1)).alias("m")).collect(), reverse=True):
        room -= m
        if room < 0:
            break
        least = s
    got = words.where(_step() >= least).toArrow()
    hashes = got.column("h").to_numpy().view(np.uint64)
    order = np.argsort(hashes)
    n_train = blocks.agg(F.coalesce(F.sum("learned"), F.lit(0)).alias("n")).first().n
    return Model(hashes[order], got.column("cls").to_numpy()[order].astype(np.uint8), got.column("n").to_numpy()[order], words, least, class_n, class_v,
                 n_train, int(class_n.sum()) + n_train, int(class_v.sum()) + (n_train > 0))


# ---------------------------------------------------------------- classes of texts


def _questions(top):
    """The distinct words of a block that aren't among the most frequent ones."""

    def run(batches):
        for block, _ in _each_block(batches):
            _, there = _find(top.value[0], block.hashes)
            code = np.flatnonzero(~there)
            whole = pa.RecordBatch.from_arrays([pa.array(block.hashes[code].view(np.int64)), pa.array(np.full(len(code), block.number)), pa.array(code.astype(np.int32))],
                                               names=["h", "block", "code"])
            for k in range(0, whole.num_rows, 50_000):
                yield whole.slice(k, 50_000)

    return run


def _resolve(top, den: np.ndarray, base_den: float, n_train: int):
    """Classes of all words of a block, ends included, and of each text the sums that need no transitions."""

    def run(batches):
        hashes, classes, counts = top.value
        for b in batches:
            for i in range(b.num_rows):
                row = b.slice(i, 1)
                block = _Block({n: row.column(n)[0].as_py() for n in ("block", "train", "sizes", "codes", "hashes", "groups")})
                at, there = _find(hashes, block.hashes)
                cls, n = CLASSES + block.groups.astype(np.int64), np.zeros(len(block.hashes), np.int64)
                cls[there], n[there] = classes[at[there]], counts[at[there]]
                if (found := row.column("found")).null_count == 0:
                    f = found.flatten()
                    code = f.field("code").to_numpy()
                    cls[code], n[code] = f.field("cls").to_numpy(), f.field("n").to_numpy()
                base, emit = np.log10(n + 0.1), np.log10(n + DELTA) - den[cls]
                sums = lambda of_code: text_sums(of_code[block.codes], block.sizes)
                base = sums(base) + np.log10(n_train + 0.1) - (block.sizes + 1) * base_den
                cols = [block.sizes + 1, np.rint(sums((n > 0).astype(float))).astype(np.int64) + int(n_train > 0), base, sums(emit)]
                lists = [pa.ListArray.from_arrays(pa.array([0, len(c)], pa.int32()), pa.array(c)) for c in cols]
                seq = block.sequence(cls.astype(np.uint8), END, False)
                yield pa.RecordBatch.from_arrays([row.column("ids"), row.column("ks"), row.column("train"), pa.array([seq.tobytes()], pa.binary()), *lists],
                                                 names=["ids", "ks", "train", "classes", "n_tokens", "n_known", "base", "emit"])
        pa.default_memory_pool().release_unused()

    return run


def resolve(blocks: DataFrame, model: Model) -> DataFrame:
    """Classes and sums of all texts in blocks, written."""
    top = blocks.sparkSession.sparkContext.broadcast((model.top, model.top_class, model.top_n))
    asked = blocks.select("block", "train", "sizes", "codes", "hashes", "groups").mapInArrow(_questions(top), "h long, block long, code int")
    found = (asked.join(model.words.where(_step() < model.least), "h")
             .groupBy("block").agg(F.collect_list(F.struct("code", "cls", "n")).alias("found")))  # a block's distinct words at most
    kind = f"{', '.join(f'{n} {t}' for n, t in blocks.dtypes if n in ('ids', 'ks'))}, train binary, classes binary, "
    return staged(blocks.join(found, "block", "left").mapInArrow(
        _resolve(top, model.den, model.base_den, model.n_train), kind + "n_tokens array<long>, n_known array<long>, base array<double>, emit array<double>"), "lm-resolved")


def _count_moves(batches):
    total = np.zeros(SIZE * SIZE, np.int64)
    for b in batches:
        for classes, train in zip(b.column("classes"), b.column("train")):
            seq, learn = np.frombuffer(classes.as_py(), np.uint8).astype(np.int64), np.frombuffer(train.as_py(), np.uint8)
            text = np.cumsum(seq[:-1] == END) - 1  # a move belongs to the text whose end it follows, last
            total += np.bincount((seq[:-1] * SIZE + seq[1:])[learn[text] > 0], minlength=SIZE * SIZE)
    at = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(total[at])], names=["cell", "n"])


def _with_moves(resolved: DataFrame, model: Model) -> Model:
    got = resolved.select("classes", "train").mapInArrow(_count_moves, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()
    cells = np.zeros(SIZE * SIZE)
    cells[got.column("cell").to_numpy()] = got.column("n").to_numpy()
    cells = cells.reshape(SIZE, SIZE)
    model.moves = np.log10((cells + ALPHA) / (cells.sum(1, keepdims=True) + ALPHA * SIZE))
    return model


def _scores(moves: np.ndarray):
    flat = moves.ravel()

    def run(batches):
        for b in batches:
            for i in range(b.num_rows):
                seq = np.frombuffer(b.column("classes")[i].as_py(), np.uint8).astype(np.int64)
                get = lambda name: b.column(name).slice(i, 1).flatten()
                score = text_sums(flat[seq[:-1] * SIZE + seq[1:]], get("n_tokens").to_numpy()) + get("emit").to_numpy()
                yield pa.RecordBatch.from_arrays([*[get(n) for n in ("ids", "ks", "n_tokens", "n_known", "base")], pa.array(score)],
                                                 names=["id", "k", "n_tokens", "n_known", "base_score", "score"])

    return run


def _scored(docs: DataFrame, resolved: DataFrame, model: Model, id_col: str, text_col: str) -> DataFrame:
    base = pack(docs, id_col, text_col)
    sums = resolved.mapInArrow(_scores(model.moves), f"id {dict(base.dtypes)['id']}, k long, n_tokens long, n_known long, base_score double, score double")
    return attach(base.select("row", "id", "k"), sums.dropDuplicates(["id", "k"])).select("row", "n_tokens", "n_known", "base_score", "score")


def train(docs: DataFrame, learn: Column, id_col: str = "doc_id", text_col: str = "text") -> Model:
    """The model of the rows of ``docs`` for which ``learn`` holds."""
    blocks = blocks_of(docs.where(learn), F.lit(True), id_col, text_col)
    model = _lexicon(blocks)
    return _with_moves(resolve(blocks, model), model)


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: ``row``, ``n_tokens``, ``n_known``, ``base_score``, ``score``."""
    return _scored(docs, resolve(blocks_of(docs, F.lit(False), id_col, text_col), model), model, id_col, text_col)


def train_and_score(docs: DataFrame, learn: Column, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, Model]:
    """``score`` of all rows by the model of those for which ``learn`` holds; texts are cut into words once."""
    blocks = blocks_of(docs, learn, id_col, text_col)
    model = _lexicon(blocks)
    resolved = resolve(blocks, model)
    return _scored(docs, resolved, _with_moves(resolved, model), id_col, text_col), model


def op8_class_lm(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = F.coalesce(remainder("doc_id", 10) == 0, F.lit(True))
    scored, model = train_and_score(docs, ~held_out)
    return scored.select(
        F.col("row.doc_id").alias("doc_id"), "n_tokens", "n_known", F.lit(model.total).cast("long").alias("train_tokens"),
        "base_score", "score").select("doc_id", held_out.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
