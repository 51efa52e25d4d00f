"""Token ids in a content-addressed store.

A rolling hash over a window of ids cuts each document's id stream into chunks.
A chunk is named by its SHA-256 and stored once. A recipe for each document, in
ascending doc_id order, lists its chunks; recipes lie in shards, and a manifest
has a Merkle root for each shard and one over all shards.

A store is a folder of three Parquet tables:

- ``parts/kind=C``: ``key`` digest, ``n`` ids, ``payload`` the ids, little-endian,
  of ``width`` bytes each, as one Zstandard frame;
- ``recipes``: ``shard, doc_id, start, n, leaf, chunks array<binary>``;
- ``manifest``: ``shard, documents, ids, root`` and one row of shard -1 over all.
"""

from __future__ import annotations

import hashlib
import re
import sys
import zlib
from array import array
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import regex
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from evispark.llm import common

#: Ids in the rolling window; a chunk has 2**CUT_BITS ids in the mean, within the two limits.
WINDOW, CUT_BITS, LEAST, MOST = 8, 10, 64, 16384
#: Words that a worker keeps encoded, about 30 bytes each, and pieces of texts that go by themselves.
CACHE, PIECES_KEPT = 1_500_000, 50_000
#: Words whose ids are put together at once, and bytes of rows that a worker is sent at once: memory beside a full JVM heap.
GATHERED, SENT = 1 << 16, 6_000_000
_B = 0x9E3779B97F4A7C15
_PARTS = "kind string, key binary, doc_id long, tie long, n long, payload binary, chunks array<binary>"


#: Fixed pattern of the byte-level pre-tokenizer that the vocabulary files name.
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def tokenizer_path() -> str:
    """The vocabulary file that the query and the pipeline take."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _byte_chars() -> dict[int, str]:
    """The printable character that stands for each byte in a byte-level vocabulary."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(rest)}


class _Words:
    """The ids of words after a space, by the words' 64-bit hashes: sorted hashes, and where each one's ids lie in one array."""

    def __init__(self, kind: np.dtype):
        self.hash, self.start, self.size, self.ids = np.empty(0, np.uint64), np.empty(0, np.int32), np.empty(0, np.int32), np.empty(0, kind)

    def find(self, words: list[bytes], encode: Callable[[str], bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Where the ids of each of some distinct words start in ``ids``, and how many; new words are encoded and kept."""
        if len(self.hash) > CACHE:
            self.__init__(self.ids.dtype)
        digest = xxhash.xxh3_64_intdigest
        h = np.fromiter(map(digest, words), np.uint64, len(words))
        at = np.searchsorted(self.hash, h)
        known = at < len(self.hash)
        known[known] = self.hash[at[known]] == h[known]
        start, size = np.empty(len(h), np.int32), np.empty(len(h), np.int32)
        start[known], size[known] = self.start[at[known]], self.size[at[known]]
        new = np.flatnonzero(~known)
        if len(new):
            raw = [encode(words[i].decode()) for i in new.tolist()]
            many = np.fromiter(map(len, raw), np.int32, len(raw)) // np.int32(self.ids.dtype.itemsize)
            first = np.cumsum(many, dtype=np.int32) - many + np.int32(len(self.ids))
            start[new], size[new] = first, many
            self.ids = np.concatenate((self.ids, np.frombuffer(b"".join(raw), self.ids.dtype)))
            order = np.argsort(h[new], kind="stable")
            place = at[new][order]
            self.hash, self.start, self.size = (np.insert(x, place, y[order]) for x, y in ((self.hash, h[new]), (self.start, first), (self.size, many)))
        return start, size


def _gathered(ids: np.ndarray, start: np.ndarray, many: np.ndarray, end: np.ndarray) -> np.ndarray:
    """``many`` ids from each ``start``, one after another up to each ``end``; a part of the places is made at once."""
    out = np.empty(end[-1] if len(end) else 0, ids.dtype)
    for lo in range(0, len(end), GATHERED):
        part = slice(lo, lo + GATHERED)
        first, last = end[lo] - many[lo], end[part][-1]
        at = np.repeat(start[part] - (end[part] - many[part]), many[part])
        at += np.arange(first, last, dtype=np.int32)
        ids.take(at, out=out[first:last], mode="clip")
    return out


class Encoder:
    """Ids of texts by a tokenizer file, with a cache of words.

    The vocabulary's byte-level pre-tokenizer always starts a new piece at a single
    space between two characters that are no white space. So a text may be
    encoded piece by piece there, and pieces that recur are encoded once.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        #: Added tokens; a text with one of them is encoded as a whole.
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.width = 2 if self.tokenizer.get_vocab_size() <= 65536 else 4
        self.type = np.dtype("<u2" if self.width == 2 else "<u4")
        split = self.tokenizer.pre_tokenizer.__class__.__name__
        self.by_word = split == "ByteLevel" and self.tokenizer.normalizer is None
        self.model, self.code, self.chars = self.tokenizer.model.tokenize, "H" if self.width == 2 else "I", _byte_chars()
        self.split, self.pieces = regex.compile(PIECES).findall, {}
        self.ends = {c: self.piece(c) for c in ".,"} if self.by_word else {}
        self.words = _Words(self.type)

    def piece(self, text: str) -> bytes:
        """Ids of one piece of the pre-tokenizer."""
        found = array(self.code, [t.id for t in self.model(text.encode().decode("latin-1").translate(self.chars))])
        if sys.byteorder == "big":
            found.byteswap()
        return found.tobytes()

    def word(self, word: str) -> bytes:
        """Ids of a word after a space."""
        if word.isalpha():
            return self.piece(" " + word)
        if word[-1:] in self.ends and word[:-1].isalpha():
            return self.piece(" " + word[:-1]) + self.ends[word[-1]]
        return self.whole(" " + word)

    def whole(self, text: str) -> bytes:
        """Ids of a text in which no place is known to start a piece."""
        if len(self.pieces) > PIECES_KEPT:
            self.pieces.clear()
        out = []
        for x in self.split(text):
            if (raw := self.pieces.get(x)) is None:
                raw = self.pieces[x] = self.piece(x)
            out.append(raw)
        return b"".join(out)

    def encode(self, text: str | None) -> np.ndarray:
        """Ids of one text."""
        if not text:
            return np.empty(0, self.type)
        if not self.by_word or any(x in text for x in self.added):
            return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, self.type)
        return np.frombuffer(self.whole(text), self.type)

    def encode_many(self, texts: pa.StringArray) -> list[np.ndarray]:
        """Ids of each text. The texts' distinct words are looked up once."""
        if not self.by_word:
            return [self.encode(t.as_py()) for t in texts]
        parts = pc.split_pattern(texts.fill_null(""), " ")
        at = parts.offsets.to_numpy() - parts.offsets[0].as_py()
        words = parts.flatten().dictionary_encode()
        code, distinct = words.indices.to_numpy().copy(), words.dictionary.cast(pa.binary()).to_pylist()
        edge = re.compile(r"\s|.*\s\Z|\Z", re.S).match
        plain = pc.utf8_is_alnum(words.dictionary).to_numpy(zero_copy_only=False)
        odd = np.zeros(len(distinct), bool)
        odd[~plain] = [edge(distinct[i].decode()) is not None for i in np.flatnonzero(~plain).tolist()]
        # a text in which a space is beside white space goes by itself
        alone = np.logical_or.reduceat(odd[code], at[:-1]) if len(texts) else []
        for x in self.added if len(texts) else []:
            alone |= pc.match_substring(texts.fill_null(""), x).to_numpy(zero_copy_only=False)
        start, size = self.words.find(distinct, self.word)
        # a text's first word has no space before it
        raw = [b"" if x else self.whole(distinct[w].decode()) for x, w in zip(alone, code[at[:-1]].tolist())]
        first = np.fromiter(map(len, raw), np.int32, len(raw)) // np.int32(self.type.itemsize)
        start = np.concatenate((start, np.cumsum(first, dtype=np.int32) - first + np.int32(len(self.words.ids))))
        size = np.concatenate((size, first))
        code[at[:-1]] = len(distinct) + np.arange(len(texts), dtype=np.int32)
        many = size[code]
        end = np.cumsum(many, dtype=np.int32)
        ids = np.concatenate((self.words.ids, np.frombuffer(b"".join(raw), self.type)))
        ids = _gathered(ids, start[code], many, end)
        to = np.concatenate(([0], end))[at]
        return [self.encode(t.as_py()) if x else ids[i:j] for t, x, i, j in zip(texts, alone, to[:-1], to[1:])]


_gear = np.random.Generator(np.random.PCG64(7)).integers(0, 1 << 63, 4096, np.uint64)


_STEPS = 1 << 17
_up = np.cumprod(np.concatenate((np.ones(1, np.uint64), np.full(_STEPS + WINDOW, _B, np.uint64))))
_down = np.cumprod(np.concatenate((np.ones(1, np.uint64), np.full(_STEPS + WINDOW, pow(_B, -1, 1 << 64), np.uint64))))


def marks(ids: np.ndarray) -> np.ndarray:
    """Places after which the rolling hash of the last ``WINDOW`` ids lets a stream be cut."""
    out = []
    for lo in range(0, len(ids), _STEPS):
        first = max(0, lo - WINDOW)
        part = ids[first:lo + _STEPS]
        run = np.cumsum((_gear[part & 4095] ^ part) * _down[:len(part)])
        run[WINDOW:] -= run[:-WINDOW].copy()
        at = np.flatnonzero((run * _up[:len(part)]) >> np.uint64(64 - CUT_BITS) == 0) + 1 + first
        out.append(at[at > lo] if lo else at)
    return np.concatenate(out) if out else np.empty(0, np.int64)


def cuts(n: int, at: list[int]) -> list[int]:
    """Ends of the chunks of a stream of ``n`` ids with marks ``at``, within the limits of size."""
    ends: list[int] = []
    last = 0
    for x in at:
        while x - last > MOST:
            last += MOST
            ends.append(last)
        if x - last >= LEAST and x < n:
            ends.append(x)
            last = x
    while n - last > MOST:
        last += MOST
        ends.append(last)
    ends.append(n)
    return ends


def leaf(doc_id: int | None, n: int, chunks: list[bytes]) -> bytes:
    return hashlib.sha256(f"{doc_id}|{n}|".encode() + b"".join(chunks)).digest()


def merkle(leaves: list[bytes]) -> bytes:
    """Root over hashes; an odd one out is carried up as it is, no leaves give the hash of nothing."""
    level = list(leaves) or [hashlib.sha256(b"").digest()]
    while len(level) > 1:
        pairs = [hashlib.sha256(a + b).digest() for a, b in zip(level[::2], level[1::2])]
        level = pairs + level[len(level) // 2 * 2:]
    return level[0]


_encoders: dict[str, Encoder] = {}


def _by_slice(enc: Encoder, texts: pa.StringArray, end: np.ndarray) -> Iterator[tuple[np.ndarray, list[int]]]:
    """Ids of each text with the end, and its chunks' ends, some megabytes of texts at once."""
    size = np.cumsum(pc.binary_length(texts.fill_null("")).to_numpy(zero_copy_only=False)) // 6_000_000
    cut = np.flatnonzero(np.concatenate(([True], size[1:] != size[:-1], [True]))).tolist() if len(texts) else []
    for a, b in zip(cut[:-1], cut[1:]):
        some = [np.concatenate([x, end]) for x in enc.encode_many(texts.take(pa.array(np.arange(a, b))))]
        stops = np.cumsum([len(x) for x in some])
        # windows over two texts end before the least size of a chunk, and so cut none
        at = marks(np.concatenate(some))
        first = np.searchsorted(at, stops, "right").tolist()
        for x, stop, i, j in zip(some, stops.tolist(), [0, *first], first):
            yield x, cuts(len(x), (at[i:j] - (stop - len(x))).tolist())


def _encode(batches: Iterator[pa.RecordBatch], path: str, end_id: int) -> Iterator[pa.RecordBatch]:
    enc = _encoders.get(path) or _encoders.setdefault(path, Encoder(path))
    pack = zstandard.ZstdCompressor(level=1).compress
    task, made, sent = TaskContext.get().partitionId(), 0, set()
    end = np.array([end_id], enc.type)
    for batch in batches:
        out: list[tuple] = []
        held = 0
        for d, tie, (ids, ends) in zip(batch.column("doc_id").to_pylist(), batch.column("tie").to_pylist(), _by_slice(enc, batch.column("text"), end)):
            last, names = 0, []
            for at in ends:
                raw = ids[last:at].tobytes()
                name = hashlib.sha256(raw).digest()
                names.append(name)
                if name not in sent:
                    sent.add(name)
                    out.append(("C", name, None, None, at - last, pack(raw), None))
                    held += len(raw)
                last = at
            made += 1
            out.append(("R", b"%d-%d" % (task, made), d, tie, len(ids), None, names))
            if held > 8_000_000:
                yield _rows(out)
                out, held = [], 0
        if out:
            yield _rows(out)


_ARROW = pa.schema([("kind", pa.string()), ("key", pa.binary()), ("doc_id", pa.int64()), ("tie", pa.int64()), ("n", pa.int64()), ("payload", pa.binary()), ("chunks", pa.list_(pa.binary()))])


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows), _ARROW)], schema=_ARROW)


def write(docs: DataFrame, path: str, tokenizer: str, end_id: int = 0) -> None:
    """Write the store of ``docs(doc_id, text)`` at ``path``.

    Texts are encoded once. Null and empty texts are the end id alone; a null
    doc_id comes first; rows that repeat have a recipe each and share chunks; an
    empty table gives a store without documents; other columns are ignored.
    """
    spark = docs.sparkSession
    made = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("tie"), "text").mapInArrow(common.trimmed(lambda it: _encode(it, tokenizer, end_id)), _PARTS)
    with common.setting(spark, "spark.sql.execution.arrow.maxBytesPerBatch", str(SENT)):
        made.dropDuplicates(["key"]).write.partitionBy("kind").parquet(f"{path}/parts")
    whole = spark.read.schema(_PARTS).parquet(f"{path}/parts")
    raw = whole.where("kind = 'R'").select("doc_id", "tie", "n", "chunks")
    leaves = F.pandas_udf(lambda d, n, c: pd.Series([leaf(None if pd.isna(a) else int(a), b, list(x)) for a, b, x in zip(d, n, c)]), "binary")
    raw = raw.withColumn("leaf", leaves("doc_id", "n", "chunks"))
    sorted_ = raw.repartitionByRange(F.col("doc_id").asc_nulls_first(), "tie").withColumn("shard", F.spark_partition_id())
    sorted_ = common.stage(sorted_, "recipes")
    shards = sorted_.groupBy("shard").agg(F.sum("n").alias("ids"), F.count(F.lit(1)).alias("documents"))
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    shards = common.small(common.stage(shards.withColumn("first", F.coalesce(F.sum("ids").over(before), F.lit(0))), "shards"))
    # a shard is one range of ids, so the window is over a bounded part of the rows
    along = Window.partitionBy("shard").orderBy(F.col("doc_id").asc_nulls_first(), "tie").rowsBetween(Window.unboundedPreceding, 0)
    recipes = sorted_.join(shards, "shard").withColumn("start", F.col("first") + F.sum("n").over(along) - F.col("n"))
    recipes.select("shard", "doc_id", "start", "n", "leaf", "chunks").write.parquet(f"{path}/recipes")
    _manifest(spark, path).write.parquet(f"{path}/manifest")
    common.unstage(sorted_)


_RECIPES = "shard int, doc_id long, start long, n long, leaf binary, chunks array<binary>"


def _roots(pdf: pd.DataFrame) -> pd.DataFrame:
    pdf = pdf.sort_values("start")
    got = [leaf(None if pd.isna(d) else int(d), int(n), list(c)) for d, n, c in zip(pdf["doc_id"], pdf["n"], pdf["chunks"])]
    same = all(bytes(a) == b for a, b in zip(pdf["leaf"], got))
    root = merkle(got) if same else b""
    return pd.DataFrame({"shard": [int(pdf["shard"].iloc[0])], "documents": [len(pdf)], "ids": [int(pdf["n"].sum())], "root": [root]})


def _manifest(spark: SparkSession, path: str) -> DataFrame:
    recipes = spark.read.schema(_RECIPES).parquet(f"{path}/recipes")
    shards = recipes.groupBy("shard").applyInPandas(_roots, "shard int, documents long, ids long, root binary")
    rows = shards.orderBy("shard").collect()  # one row a shard
    total = (-1, sum(r.documents for r in rows), sum(r.ids for r in rows), bytearray(merkle([bytes(r.root) for r in rows])))
    return spark.createDataFrame([tuple(r) for r in rows] + [total], "shard int, documents long, ids long, root binary")


def verify(spark: SparkSession, path: str) -> bool:
    """Whether recipes give the manifest's roots and all chunks that they name are stored with the digests and sizes named."""
    fresh = {r.shard: (r.documents, r.ids, bytes(r.root)) for r in _manifest(spark, path).collect()}
    kept = {r.shard: (r.documents, r.ids, bytes(r.root)) for r in spark.read.parquet(f"{path}/manifest").collect()}
    return fresh == kept and read(spark, path).where("ids_crc32 is null").limit(1).count() == 0




def _chunk_sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    unpack = zstandard.ZstdDecompressor().decompress
    for batch in batches:
        crc = []
        for key, n, payload in zip(batch.column("key"), batch.column("n").to_pylist(), batch.column("payload")):
            raw = unpack(payload.as_py())
            if hashlib.sha256(raw).digest() != key.as_py():
                raise ValueError("a stored chunk does not have its digest")
            crc.append(zlib.crc32(np.frombuffer(raw, f"<u{len(raw) // n}").astype("<u4").tobytes()))
        yield pa.RecordBatch.from_arrays([batch.column("key"), batch.column("n"), pa.array(crc, pa.int64())], ["key", "m", "crc"])


def _square(m: list[int]) -> list[int]:
    return [_times(m, x) for x in m]


def _times(m: list[int], v: int) -> int:
    out, i = 0, 0
    while v:
        if v & 1:
            out ^= m[i]
        v >>= 1
        i += 1
    return out


def _zeros() -> list[list[list[int]]]:
    """For 2**k zero bytes, what each byte of a CRC-32 becomes."""
    one = [0xEDB88320] + [1 << i for i in range(31)]
    m, out = _square(_square(_square(one))), []
    for _ in range(40):
        out.append([[_times(m, b << s) for b in range(256)] for s in (0, 8, 16, 24)])
        m = _square(m)
    return out


_tables: list = []


def crc_join(a: int, b: int, size: int) -> int:
    """CRC-32 of two byte strings after each other; ``size`` is the second's length."""
    if not _tables:
        _tables.extend(_zeros())
    k = 0
    while size:
        if size & 1:
            t = _tables[k]
            a = t[0][a & 255] ^ t[1][a >> 8 & 255] ^ t[2][a >> 16 & 255] ^ t[3][a >> 24]
        size >>= 1
        k += 1
    return a ^ b


def _joined(parts: pd.Series) -> pd.Series:
    out = []
    for doc in parts:
        crc = 0
        for x in doc:
            if x["crc"] is None or pd.isna(x["crc"]):
                crc = None
                break
            crc = crc_join(crc, int(x["crc"]), 4 * int(x["m"]))
        out.append(crc)
    return pd.Series(out, dtype="Int64")


def read(spark: SparkSession, path: str) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` of every recipe, from the files.

    Each chunk is unpacked once, where it lies, and held against its digest;
    documents get their chunks' sums through their digests, so ids do not move.
    """
    chunks = spark.read.schema(_PARTS).parquet(f"{path}/parts").where("kind = 'C'").select("key", "n", "payload")
    sums = chunks.mapInArrow(common.trimmed(_chunk_sums), "key binary, m long, crc long")
    recipes = spark.read.schema(_RECIPES).parquet(f"{path}/recipes")
    each = recipes.select("doc_id", "start", "n", F.posexplode("chunks").alias("pos", "key")).join(sums, "key", "left")
    of = each.groupBy("start").agg(F.first("doc_id").alias("doc_id"), F.first("n").alias("n_tokens"), F.sum("m").alias("got"),
                                   F.array_sort(F.collect_list(F.struct("pos", "m", "crc"))).alias("parts"))
    joined = F.pandas_udf(_joined, "long")
    return of.select("doc_id", "start", "n_tokens", F.when(F.col("got") == F.col("n_tokens"), joined("parts")).alias("ids_crc32"))


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """``doc_id, start, ids array<int>``: the documents, put together again from their chunks."""
    unpack = F.pandas_udf(lambda n, p: pd.Series([
        np.frombuffer(zstandard.ZstdDecompressor().decompress(x), f"<u{len(zstandard.ZstdDecompressor().decompress(x)) // m}").astype(np.int32) for m, x in zip(n, p)]), "array<int>")
    chunks = spark.read.schema(_PARTS).parquet(f"{path}/parts").where("kind = 'C'").select("key", unpack("n", "payload").alias("ids"))
    each = spark.read.schema(_RECIPES).parquet(f"{path}/recipes").select("doc_id", "start", F.posexplode("chunks").alias("pos", "key")).join(chunks, "key")
    return each.groupBy("doc_id", "start").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("pos", "ids"))), lambda x: x["ids"])).alias("ids"))


def encode_table(docs: DataFrame, tokenizer: str, end_id: int = 0) -> DataFrame:
    """Write a store of ``docs`` in the shared folder and read it back, by :func:`read`."""
    path = common.new_path(docs.sparkSession, "tokens")
    write(docs, path, tokenizer, end_id)
    return read(docs.sparkSession, path)
