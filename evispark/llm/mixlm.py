"""Language-model scores by online logistic context mixing.

A text is a sequence of tokens, words and one end, and is coded as its bytes: each
word with a closing byte, the end as a closing byte alone. A byte is five bits if
it is usual and five and eight if not. Each bit, in the order of the text, is
predicted from several hashed contexts that run across tokens: the last one to four
bytes, the word's bytes so far, those with the word before, and the byte that
followed the last place in this text with the same twelve bytes. The predictions are
mixed in the logistic domain with weights gated by the bit's place and by how well
each context is known; the weights move after every bit, and an adaptive map
refines the mix.

Counts of a context are additive, so they are gathered in parallel, from all
training tokens. The mixer's first weights and the map are learned online in one pass
over all training documents, each bit without its own count. Scoring starts from
them in each segment of ``SEGMENT`` bytes and goes on learning inside it, causally,
so segments are lanes that numpy can advance together, a bit at a time; contexts cross
their borders. The order in which tasks meet training texts moves the first weights a little.

In the query the 400,000 most frequent words met more than once are coded along a Huffman tree instead, each bit
predicted from the tree's place alone, with the word before, the two before, the last very common word, and a match of
three words; an escape leaf precedes other words, which are spelled as above with that common word for the word before.
There weights start anew with each text.

The query runs ``Mixer.java``, a compiled loop over the same bits; :class:`Stream`, :class:`Bits` and
:class:`Model` are the model without a tree in numpy, which tests hold it against.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from py4j.java_gateway import JavaObject
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from evispark.llm import common, compiled

#: Bytes of training text that teach weights together, in the mean; shards begin alike and are averaged.
SHARD = 8 << 20
#: Most bits of the table of each context: last 1, 2, 3, 4 bytes, word so far, word so far with the word before.
TABLES = (16, 18, 20, 22, 22, 22)
#: Inputs of the mixer: the contexts and the match.
INPUTS = len(TABLES) + 1
#: A table has about one slot for so many training bytes, until it is as large as ``TABLES`` and a worker's memory allow.
BYTES_PER_SLOT = 1
#: Bytes of text that are taken at once, and bytes of a segment.
SLICE, SEGMENT = 3 << 18, 2048
#: Bytes of text that numpy takes at once where lanes are to be filled.
MANY = 1 << 19
#: Bytes before a place that predict it by an earlier place, and hits in a row up to which matches are told apart.
REACH, RUN = 12, 7
#: Words of the dictionary, which each task holds for the tree and the base score.
HOT = 400_000
#: Slots of one block of the tables on their way between tasks.
BLOCK = 1 << 16
#: Bytes coded in five bits: the closing byte and the usual ones of lower-case text.
USUAL = b" etaoinshrdlucmfgwypbvkjzxq.,|\xc3"
_CODE = np.full(256, 31, np.int64)
_CODE[np.frombuffer(USUAL, np.uint8)] = np.arange(len(USUAL))
#: Nodes of the code of bytes; rows of the map for nodes of the tree of words.
NODES, WORD_NODES = 32 + 256, 256 + 32
PLACES = 13
MAP_BINS = 33
#: Steps of the shared weights in training, and of a lane's in scoring.
RATE, LANE_RATE = 1.6, 0.012
#: Bits after which the shared weights are moved.
PIECE = 1 << 13
_P = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93)]
_CONF = np.array([1, 2, 4, 8, 16, 64, 256])
STEPS = len(_CONF) + 1
#: How many gates there are for the best known of the two word contexts.
KNOWN = 4
#: Gates of the tree of words by depth.
DEPTHS = 16
GATES = (PLACES + DEPTHS) * KNOWN
END = b""
#: What the compiled loop does.
COUNT, LEARN, SCORE, WORDS = range(4)


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode().lower().split()


def held_out(doc_id: Column) -> Column:
    """Documents that the model does not learn from. False for a null id."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 7 == 2, F.lit(False))


def table_bits(n_bytes: int) -> tuple[int, ...]:
    """Bits of each table for so many training bytes."""
    fit = max(12, int(np.log2(max(n_bytes, 1) / BYTES_PER_SLOT)))
    return tuple(min(b, fit) for b in TABLES)


def _spread(x: np.ndarray) -> np.ndarray:
    x = (x + _P[0]) * _P[3]
    return x ^ x >> np.uint64(32)


class Stream:
    """Bytes of runs of tokens as they are coded, with the contexts of each byte.

    ``words`` has each run's words with their closing bytes; the runs of ``last`` have
    an end too. ``raw`` and ``doc``, the run, are by byte; ``ctx`` has a hash for each table; ``guess`` is
    the byte that the match expects or -1, ``run`` its hits in a row so far.
    """

    def __init__(self, words: pa.ListArray, last: np.ndarray):
        joined = pc.binary_join(words, pa.scalar("", words.type.value_type))
        size = pc.binary_length(joined).to_numpy(zero_copy_only=False).astype(np.int64) + last
        self.raw = raw = np.frombuffer("".join([x + " " * end for x, end in zip(joined.to_pylist(), last.tolist())]).encode(), np.uint8)
        self.end = np.cumsum(size)
        self.doc = np.repeat(np.arange(len(size)), size)
        pos = np.arange(len(raw)) - (self.end - size)[self.doc]
        val = raw.astype(np.uint64) + np.uint64(1)
        close = raw == 32
        token = np.cumsum(close) - close
        ends = np.flatnonzero(close)
        start = np.concatenate(([0], ends[:-1] + 1)) if len(ends) else ends
        inside = np.arange(len(raw)) - start[token]
        last = []
        for n in range(1, 5):
            x = np.zeros(len(raw), np.uint64)
            x[n:] = val[:-n]
            x[pos < n] = 0
            last.append(x)
        power = np.ones(int(inside.max(initial=0)) + 1, np.uint64)
        power[1:] = _P[3]
        power = np.cumprod(power)
        summed = np.cumsum(val * power[inside])
        before = summed - val * power[inside]
        prefix = before - before[start][token]
        word = np.concatenate((np.zeros(1, np.uint64), prefix[ends][:-1] + np.uint64(1)))
        word[pos[start] == 0] = 0
        o2 = last[0] | last[1] << np.uint64(9)
        o3 = o2 | last[2] << np.uint64(18)
        o4 = o3 | last[3] << np.uint64(27)
        self.ctx = np.stack([last[0], o2, o3, o4, prefix, prefix + _spread(word)[token]])
        del last, o2, o3, o4, before, summed
        salt = np.arange(1, len(TABLES) + 1, dtype=np.uint64) * _P[2]
        for k, x in enumerate(self.ctx):  # in place: the tables of a large stream are a worker's memory
            x += salt[k]
            x *= _P[0]
            x ^= x >> np.uint64(31)
        self.guess, self.run = self._matches(val, pos)

    def _matches(self, val: np.ndarray, pos: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        n = len(val)
        guess, run = np.full(n, -1, np.int64), np.zeros(n, np.int64)
        if n <= REACH:
            return guess, run
        key = self.doc[REACH:].astype(np.uint64) * _P[2]
        for j in range(REACH):
            key ^= val[j:n - REACH + j]
            key *= _P[1]
            key ^= key >> np.uint64(29)
        order = np.argsort(key, kind="stable")
        whole = pos[order + REACH] >= REACH
        same = (key[order[1:]] == key[order[:-1]]) & whole[1:] & whole[:-1]
        now, earlier = order[1:][same] + REACH, order[:-1][same] + REACH
        guess[now] = self.raw[earlier]
        hit = guess == self.raw
        miss = np.maximum.accumulate(np.where(hit, -1, np.arange(n)))
        run[now] = np.minimum(now - 1 - miss[now - 1], RUN)
        return guess, run


def _tree() -> tuple[np.ndarray, np.ndarray]:
    """For each byte and place, the node in the code's tree and the bit; node 0 beyond a byte's code."""
    node, bit = np.zeros((256, PLACES), np.uint16), np.zeros((256, PLACES), np.uint8)
    for byte, code in enumerate(_CODE.tolist()):
        parts = [(code, 5, 0)] + [(byte, 8, 32)] * (code == 31)
        path = [((value | 1 << wide) >> left, value >> (left - 1) & 1, base) for value, wide, base in parts for left in range(wide, 0, -1)]
        for place, (at, b, base) in enumerate(path):
            node[byte, place], bit[byte, place] = at + base, b
    return node.ravel(), bit.ravel()


_NODE, _BIT = _tree()


class Bits:
    """Each bit of a stream in its order: the byte it belongs to, node in the code's tree, place, bit.

    ``match`` is what the match expects, 1 or -1, and 0 once the byte has departed from it.
    """

    def __init__(self, s: Stream):
        width = np.where(_CODE[s.raw] == 31, PLACES, 5)
        self.start = (np.cumsum(width) - width).astype(np.int32)
        self.of = np.repeat(np.arange(len(width), dtype=np.int32), width)
        self.place = (np.arange(len(self.of), dtype=np.int32) - np.repeat(self.start, width)).astype(np.uint8)
        at = np.repeat(s.raw.astype(np.int32) * PLACES, width) + self.place
        self.node, self.bit = _NODE.take(at), _BIT.take(at)
        self.match, self.run = np.zeros(len(at), np.int8), np.zeros(len(at), np.int8)
        on = np.flatnonzero(np.repeat(s.guess >= 0, width)).astype(np.int32)
        by = self.of[on]
        other = s.guess.astype(np.int32)[by] * np.int32(PLACES) + self.place[on]
        agrees = _NODE.take(other) == self.node[on]
        on, other, by = on[agrees], other[agrees], by[agrees]
        self.match[on] = _BIT.take(other).astype(np.int8) * 2 - 1
        self.run[on] = s.run[by]

    def slots(self, s: Stream, bits: tuple[int, ...], part: slice) -> np.ndarray:
        """Places (contexts, bits) in the joined tables."""
        offsets = _offsets(bits)
        salt = self.node[part].astype(np.uint64) * _P[1]
        of = self.of[part]
        return np.stack([((s.ctx[k].take(of) ^ salt) * _P[3] >> np.uint64(64 - n)).view(np.int64) + offsets[k] for k, n in enumerate(bits)])


def _offsets(bits: tuple[int, ...]) -> np.ndarray:
    return np.concatenate(([0], np.cumsum([1 << b for b in bits])))


def _pieces(n: int, most: int = 1 << 15) -> Iterator[slice]:
    for lo in range(0, n, most):
        yield slice(lo, min(lo + most, n))


def squeeze(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """Counts as a cell: the stretched estimate in 1/12 about 128, and above it a step of confidence."""
    st = np.clip(np.rint(np.log((ones + np.float32(0.05)) / (zeros + np.float32(0.05))) * 12), -127, 127)
    return (np.searchsorted(_CONF, zeros + ones, side="right") << 8 | (st + 128).astype(np.int64)).astype(np.uint16)


_LOGS = (np.log(np.arange(1 << 16) + 0.05) * 12).astype(np.float32)
_STEP = (np.searchsorted(_CONF, np.arange(_CONF[-1] + 1), side="right") << 8).astype(np.uint16)


def _cells(own: np.ndarray, other: np.ndarray, bit: np.ndarray) -> np.ndarray:
    """:func:`squeeze` of 16-bit counts of ``bit`` and of the other bit, by tables."""
    st = np.clip(np.rint(_LOGS.take(own) - _LOGS.take(other)), -127, 127) * (2 * bit - 1) + 128
    return _STEP.take(own.astype(np.int32) + other, mode="clip") | st.astype(np.uint16)


class Model:
    """Cells of the tables, weights by gate, input and confidence, and the adaptive map."""

    def __init__(self, bits: tuple[int, ...], cells: np.ndarray | None):
        self.bits, self.cells = bits, cells
        self.weights = np.full((GATES, INPUTS, STEPS), 0.3, np.float32)
        self.weights[:, :-1, 0] = 0
        self.map, self.learned, self.shared, self.tree = np.zeros((NODES + WORD_NODES, MAP_BINS, 2)), None, None, None

    def inputs(self, bits: Bits, cell: np.ndarray, part: slice) -> tuple[np.ndarray, np.ndarray]:
        """Estimates (bits, inputs) in 1/12, and the weight that each is given."""
        st, conf = np.empty((cell.shape[1], INPUTS), np.int8), np.empty((cell.shape[1], INPUTS), np.int16)
        st[:, :-1] = ((cell & 255).astype(np.int16) - 128).T
        conf[:, :-1] = (cell >> 8).T
        st[:, -1], conf[:, -1] = bits.match[part] * 24, bits.run[part]
        known = np.minimum((np.maximum(conf[:, -2], conf[:, -3] * (conf[:, -2] == 0)) + 1) >> 1, KNOWN - 1)
        gate = bits.place[part].astype(np.int16) * KNOWN + known
        return st, (gate[:, None] * INPUTS + np.arange(INPUTS, dtype=np.int16)) * STEPS + conf

    def learn(self, s: Stream, counts: np.ndarray, into_map: bool | None) -> int:
        """Predict bits without their own counts, and move the shared weights or fill the map (None: both) after each piece."""
        bits = Bits(s)
        for part in _pieces(len(bits.of), PIECE):
            at, bit = bits.slots(s, self.bits, part) * 2, bits.bit[part].astype(np.int64)
            own, other = counts.ravel().take(at + bit), counts.ravel().take(at + (1 - bit))
            own -= own > 0
            st, flat = self.inputs(bits, _cells(own, other, bit), part)
            st = st * np.float32(1 / 12)
            z = np.clip((self.weights.ravel()[flat] * st).sum(1), -15, 15)
            if into_map is not False:
                x = np.clip(np.rint(z * 2) + MAP_BINS // 2, 0, MAP_BINS - 1).astype(np.int64)
                self.map += np.bincount((bits.node[part].astype(np.int64) * MAP_BINS + x) * 2 + bit, minlength=self.map.size).reshape(self.map.shape)
            if into_map:
                continue
            err = (bit - 1 / (1 + np.exp(-z)))[:, None]
            up = np.bincount(flat.ravel(), (err * st).ravel(), self.weights.size)
            mass = np.bincount(flat.ravel(), (1 + st * st).ravel(), self.weights.size)
            self.weights += (RATE * up / (mass + 50)).reshape(self.weights.shape).astype(np.float32)
        return len(bits.of)

    def mixed(self, s: Stream, bits: Bits) -> np.ndarray:
        """The mix before each bit, by weights that each segment moves on from the learned ones."""
        n = len(bits.of)
        st, flat = np.empty((n, INPUTS), np.int8), np.empty((n, INPUTS), np.int16)
        for part in _pieces(n):
            st[part], flat[part] = self.inputs(bits, self.cells[bits.slots(s, self.bits, part)], part)
        first = s.end - np.diff(s.end, prepend=0)
        cut = np.concatenate([np.arange(a, b, SEGMENT) for a, b in zip(first.tolist(), s.end.tolist())])
        begin = bits.start[cut].astype(np.int64)
        long = np.diff(begin, append=n)
        order = np.argsort(-long, kind="stable")
        begin, long = begin[order], long[order]
        lanes = np.searchsorted(-long, -np.arange(int(long.max(initial=0))), side="left")  # lanes longer than a step
        own = np.tile(self.weights.ravel(), len(begin))
        base = (np.arange(len(begin)) * self.weights.size)[:, None]
        out = np.empty(n, np.float32)
        for t, m in enumerate(lanes.tolist()):
            r = begin[:m] + t
            x = st.take(r, axis=0) * np.float32(1 / 12)
            at = flat.take(r, axis=0) + base[:m]
            w = own.take(at)
            z = np.einsum("ij,ij->i", w, x)
            out[r] = z
            w += ((bits.bit.take(r) - 1 / (1 + np.exp(np.clip(-z, -30, 30)))) * LANE_RATE).astype(np.float32)[:, None] * x
            own[at] = w
        return np.clip(out, -15, 15, out=out)

    def logits(self) -> np.ndarray:
        """The map in the logistic domain, by node and bin."""
        prior = 1 / (1 + np.exp(-(np.arange(MAP_BINS) - MAP_BINS // 2) / 2.0))
        return np.log((self.map[:, :, 1] + 32 * prior) / (self.map[:, :, 0] + 32 * (1 - prior))).astype(np.float32).ravel()

    def refine(self, node: np.ndarray, z: np.ndarray) -> np.ndarray:
        """The mean, in the logistic domain, of the mix and of what the map learned for it."""
        if self.learned is None:
            self.learned = self.logits()
        x = np.clip(z * np.float32(2) + np.float32(MAP_BINS // 2), 0, np.float32(MAP_BINS - 1.001))
        lo = x.astype(np.int32)
        at, x = node * np.int32(MAP_BINS) + lo, x - lo
        return (z + self.learned.take(at) * (1 - x) + self.learned.take(at + 1) * x) / 2

    def score(self, s: Stream) -> np.ndarray:
        """log10 of the probability of each run."""
        bits = Bits(s)
        z, out = self.mixed(s, bits), np.zeros(len(s.end))
        for part in _pieces(len(z)):
            y = self.refine(bits.node[part].astype(np.int32), z[part])
            out -= np.bincount(s.doc.take(bits.of[part]), np.log1p(np.exp(np.where(bits.bit[part] == 1, -y, y))), len(out))
        return out / np.log(10)


class Texts:
    """A slice of texts: distinct words, and how often each text has each."""

    def __init__(self, texts: pa.Array):
        low = pc.ascii_trim_whitespace(pc.ascii_lower(texts.fill_null("").cast(pa.large_string())))
        parts = pc.ascii_split_whitespace(low)
        at = parts.offsets.to_numpy() - parts.offsets[0].as_py()
        flat, doc = parts.flatten(), np.repeat(np.arange(len(texts)), np.diff(at))
        full = pc.not_equal(flat, "")
        if not pc.all(full, min_count=0).as_py():
            flat, doc = flat.filter(full), doc[full.to_numpy(zero_copy_only=False)]
        self.size = np.bincount(doc, minlength=len(texts))
        self.offsets = np.concatenate(([0], np.cumsum(self.size)))
        self.flat = flat
        coded = flat.dictionary_encode()
        self.words = coded.dictionary.cast(pa.large_binary()).cast(pa.binary())
        pair = pa.array(doc * max(len(self.words), 1) + coded.indices.to_numpy()).value_counts()
        self.pair_doc, self.pair_code = np.divmod(pair.field("values").to_numpy(), max(len(self.words), 1))
        self.pair_count = pair.field("counts").to_numpy()

    def streams(self, most: int = SLICE) -> Iterator[tuple[np.ndarray, Stream]]:
        """Streams of whole runs of about ``most`` bytes, each with the text of each of its runs.

        A text is one run. One of more than ``SLICE`` bytes is cut between tokens into
        runs of about as many, so memory is bounded; contexts begin anew in each.
        """
        size = pc.binary_length(self.flat).to_numpy(zero_copy_only=False).astype(np.int64) + 1
        upto = np.concatenate(([0], np.cumsum(size)))
        doc = np.repeat(np.arange(len(self.size)), self.size)
        window = (upto[:-1] - upto[self.offsets[doc]]) // SLICE
        inner = np.flatnonzero((window[1:] != window[:-1]) & (doc[1:] == doc[:-1])) + 1
        start, owner = np.concatenate((self.offsets[:-1], inner)), np.concatenate((np.arange(len(self.size)), doc[inner]))
        order = np.argsort(start, kind="stable")
        start, owner = np.append(start[order], len(doc)), owner[order]
        last = np.append(owner[1:] != owner[:-1], True)[:len(owner)]
        for a, b in _cuts(upto[start[1:]], most):
            lo, hi = start[a], start[b]
            closed = pc.binary_join_element_wise(self.flat.slice(lo, hi - lo), pa.scalar(" ", self.flat.type), pa.scalar("", self.flat.type))
            yield owner[a:b], Stream(pa.LargeListArray.from_arrays(pa.array(start[a:b + 1] - lo, pa.int64()), closed), last[a:b])


def _cuts(upto: np.ndarray, most: int = SLICE) -> list[tuple[int, int]]:
    run = (upto - 1) // most
    cut = np.flatnonzero(np.concatenate(([True], run[1:] != run[:-1]))).tolist() + [len(upto)] if len(upto) else []
    return list(zip(cut[:-1], cut[1:]))


def _slices(batch: pa.RecordBatch, most: int = 4 * SLICE) -> Iterator[pa.RecordBatch]:
    """Runs of rows with about ``most`` bytes of text."""
    size = np.cumsum(pc.binary_length(batch.column("text").fill_null("")).to_numpy(zero_copy_only=False).astype(np.int64)) if len(batch) else np.empty(0, np.int64)
    for a, b in _cuts(size, most):
        yield batch.take(pa.array(np.arange(a, b)))  # a copy: string functions want arrays without an offset


def _packed(x: np.ndarray) -> bytes:
    return pa.compress(x.tobytes(), "zstd", asbytes=True)


def _unpacked(x: bytes, kind: type, slots: int) -> np.ndarray:
    return np.frombuffer(pa.decompress(x, slots * 2 * np.dtype(kind).itemsize, "zstd", asbytes=True), kind)


def _loop(spark: SparkSession, mode: int, bits: tuple[int, ...], weights: np.ndarray | None = None, learned: np.ndarray | None = None, tables: JavaObject | None = None, tree: JavaObject | None = None) -> JavaObject:
    """The compiled loop over bits; ``tables`` are counts or cells that :class:`Mixer` has on the executors, ``tree`` of :func:`dictionary`."""
    loop = compiled.instance(spark, "Mixer")
    ints = np.array([SLICE, SEGMENT, REACH, RUN, PIECE, BLOCK, *bits], "<i4").tobytes()
    loop.set(mode, ints, USUAL, RATE, LANE_RATE, *(b"" if x is None else x.astype("<f4").tobytes() for x in (weights, learned)), tables)
    loop.words(tree)
    return loop


def dictionary(vocab: DataFrame, n: int, v: int, hot: int) -> JavaObject:
    """The end and the ``hot`` most frequent of the words that ``vocab(word, c)`` has more than once, as a Huffman tree on all executors.

    One leaf is the escape, for all other words; ``n`` and ``v`` are the base's tokens and distinct tokens.
    """
    spark, end = vocab.sparkSession, F.col("word") == F.lit(END)
    levels = vocab.groupBy(F.floor(F.log2("c")).alias("level")).count().orderBy(F.desc("level")).collect()
    least, upto = 2, 0
    for r in levels:  # words under this level of counts are not among the first
        upto += r["count"]
        if upto >= hot:
            least = max(2, 2 ** r.level)
            break
    top = vocab.where((F.col("c") >= least) | end).orderBy(~end, F.desc("c"), "word").limit(hot).toArrow().combine_chunks()
    words, counts = pa.array([], pa.large_binary()), np.empty(0, np.int64)
    if len(top):
        words, counts = pa.concat_arrays([x.cast(pa.large_binary()) for x in top.column("word").chunks]), top.column("c").to_numpy()
    size = pc.binary_length(words).to_numpy(zero_copy_only=False)
    if not len(words) or size[0]:
        size, counts = np.concatenate(([0], size)), np.concatenate(([0], counts))
    joined = words.buffers()[2].to_pybytes()[:int(size.sum())] if size.sum() else b""
    return compiled.instance(spark, "Mixer").tree(spark.sparkContext._jsc, joined, np.cumsum(size).astype("<i4").tobytes(), counts.astype("<i8").tobytes(), n - int(counts.sum()), float(n + v + 1))


def _counts(texts: DataFrame, bits: tuple[int, ...], tree: JavaObject | None = None) -> JavaObject:
    """Counts (slot, bit) of all contexts of ``texts``, on all executors: dense sums of each task, added by block."""
    slots = int(_offsets(bits)[-1])

    def add(pdf: pd.DataFrame) -> pd.DataFrame:
        k, total = int(pdf["block"].iloc[0]), 0
        for x in pdf["sums"]:
            total = total + _unpacked(x, np.uint32, min(BLOCK, slots - k * BLOCK)).astype(np.int64)
        most = total.reshape(-1, 2).max(1, keepdims=True)
        cells = total.reshape(-1, 2) * np.minimum(1, 65535 / np.maximum(most, 1))  # a ratio is kept where a count is too large
        return pd.DataFrame({"block": pdf["block"].iloc[:1], "cells": [_packed(np.minimum(np.ceil(cells), 65535).astype(np.uint16))]})

    spark = texts.sparkSession
    loop = _loop(spark, COUNT, bits, tree=tree)
    blocks = common.stage(compiled.map_partitions(texts, loop, "block int, sums binary").groupBy("block").applyInPandas(add, "block int, cells binary"), "counts")
    out = loop.gathered(spark.sparkContext._jsc, blocks._jdf, slots)
    common.unstage(blocks)
    return out


def _taught(texts: DataFrame, model: Model, counts: JavaObject) -> tuple[float, np.ndarray]:
    """Bits of ``texts``, and after a pass over them the weights, times bits, and the map.

    Each partition begins anew. States of tasks are added up on executors first, in an order that is theirs and not their arrival's.
    """

    def add(pdf: pd.DataFrame) -> pd.DataFrame:
        total = sum(np.frombuffer(x) for x in sorted(pdf["state"]))
        return pd.DataFrame({"mass": [pdf["mass"].sum()], "state": [total.tobytes()]})

    made = compiled.map_partitions(texts, _loop(texts.sparkSession, LEARN, model.bits, model.weights, None, counts, model.tree), "part long, mass double, state binary")
    rows = made.groupBy("part").applyInPandas(add, "mass double, state binary").collect()
    rows.sort(key=lambda r: r.state)
    return sum(r.mass for r in rows), sum((np.frombuffer(r.state) for r in rows), np.zeros(model.weights.size + model.map.size))


def train(docs: DataFrame, tree: JavaObject | None = None) -> Model:
    """A model of ``docs(text)``, from all rows; without rows every bit is even. Its cells are on the executors, as ``shared``.

    With the ``tree`` of :func:`dictionary` its words are coded along the tree, without one all words as bytes.

    For the pass that teaches weights and map, texts are dealt by a hash of their
    ``doc_id``, if there is one, else of themselves, into shards of about ``SHARD`` bytes,
    in the order of that hash. So the model is the same however ``docs`` are partitioned.
    """
    spark, texts = docs.sparkSession, docs.select(F.col("text").cast("binary").alias("text"))
    size = int(docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0])
    bits = table_bits(size)
    counts = _counts(texts, bits, tree)
    model = Model(bits, None)
    model.tree = tree
    key = F.xxhash64("doc_id" if "doc_id" in docs.columns else "text").alias("key")
    shards = docs.select(key, F.col("text").cast("binary").alias("text")).repartition(max(1, -(-size // SHARD)), "key").sortWithinPartitions("key", "text").select("text")
    mass, state = _taught(shards, model, counts)
    if mass:
        model.map = state[model.weights.size:].reshape(model.map.shape)
        model.weights = (state[:model.weights.size] / mass).astype(np.float32).reshape(model.weights.shape)
    model.shared = compiled.instance(spark, "Mixer").cells(spark.sparkContext._jsc, counts)
    counts.destroy()
    return model


def coded(rows: DataFrame, model: Model) -> DataFrame:
    """``rows(doc_id, held_out, text)`` with ``model``, log10 of the probability of each text."""
    loop = _loop(rows.sparkSession, SCORE, model.bits, model.weights, model.logits(), model.shared)
    made = compiled.map_partitions(rows.select("doc_id", "held_out", F.col("text").cast("binary").alias("text")), loop, "doc_id long, held_out boolean, text binary, model double")
    return made.withColumn("text", F.col("text").cast("string"))


_DOC = "rid long, doc_id long, held_out boolean, n_tokens long, n_bytes long, n_known long, base double, model double, others binary"


def told(rows: DataFrame, model: Model) -> DataFrame:
    """``rows(doc_id, held_out, text)`` with a ``model`` that has a tree: scores, what the base gives the dictionary's words, and ``others``."""
    loop = _loop(rows.sparkSession, SCORE, model.bits, model.weights, model.logits(), model.shared, model.tree)
    return compiled.map_partitions(rows.select("doc_id", "held_out", F.col("text").cast("binary").alias("text")), loop, _DOC)


def score(docs: DataFrame, hot: int = HOT) -> DataFrame:
    """``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte`` for each row.

    Null and blank texts are the end alone; rows that repeat are scored one by
    one; a null id is a training document; without training documents counts are
    zero and the base is uniform; an empty table gives no rows; other columns are
    ignored.

    Each task has the ``hot`` most frequent words, for the tree and for the base. A text's other words
    are coded as bytes; for the base they go to the table of words by a shuffle join and come back as sums.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out(F.col("doc_id")).alias("held_out"), "text")
    cores = spark.sparkContext.defaultParallelism
    if rows.rdd.getNumPartitions() < 2 * cores:  # coding costs far more than moving the texts once
        rows = common.stage(rows.repartition(4 * cores), "texts")
    learned = rows.where("not held_out")
    vocab = common.stage(compiled.map_partitions(learned.select(F.col("text").cast("binary")), _loop(spark, WORDS, TABLES), "word binary, c long").groupBy("word").agg(F.sum("c").alias("c")), "vocabulary")
    n, v = (int(x) for x in vocab.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count(F.lit(1))).first())
    tree = dictionary(vocab, n, v, hot)
    parts = common.stage(told(rows, train(learned, tree)), "scored")
    cold = parts.where("others is not null").select("rid", F.explode(F.split(F.col("others").cast("string"), " ")).alias("word"))
    cold = cold.withColumn("word", F.col("word").cast("binary")).join(vocab, "word", "left").withColumn("c", F.coalesce("c", F.lit(0)))
    base = F.log10((F.col("c") + 1.0) / F.lit(float(n + v + 1)))
    extra = cold.groupBy("rid").agg(F.sum(F.when(F.col("c") > 0, 1).otherwise(0)).alias("k"), F.sum(base).alias("b"))
    whole = parts.join(extra, "rid", "left")
    out = whole.select("doc_id", "held_out", "n_tokens", (F.col("n_known") + F.coalesce("k", F.lit(0))).alias("n_known"), F.lit(n).cast("long").alias("train_tokens"),
                       (F.col("base") + F.coalesce("b", F.lit(0.0))).alias("base_score"), F.col("model").alias("score"), "n_bytes")
    return out.withColumn("bits_per_byte", F.when(F.col("n_bytes") > 0, -F.col("score") * float(np.log2(10)) / F.col("n_bytes"))).drop("n_bytes")
