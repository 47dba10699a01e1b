"""Token ids in binary files, coded by a static range asymmetric numeral system (rANS).

One table of scaled frequencies, counted over the whole corpus, is shared by all files and lies beside them, with a checksum of
its own: a folder can be read with nothing else. Documents are put in ascending id
order over range partitions; each partition writes shard files of independent blocks. In a block LANES interleaved coders
take ids in turn, so one vector step codes LANES ids. Every STEPS steps the encoder notes a checkpoint (all coder states
and the place in the block's words): the parts between checkpoints decode at the same time, as wider vectors. A block
carries a CRC-32 of its ids, the file one of its index.

Table layout (little-endian): magic, version, number of ids, their frequencies as unsigned 32-bit integers, CRC-32 of those.
Shard layout: magic, version, CRC-32 of the frequency table; the blocks; the index (first sequence
number, then id and number of ids of each document, then offset, number of ids and CRC-32 of each block); length of the
index, CRC-32 of the index, magic.

Nulls count as empty; an empty document has only the end id. Rows that share an id are neighbours, each with a place of
its own; a null id sorts first. An empty table gives an empty result. Extra columns are ignored.
"""

from __future__ import annotations

import json
import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import shared_files, words
from .common import new_path, saved

MAGIC, TABLE_MAGIC, VERSION = b"LMTOKENS", b"LMFREQS\0", 1
TABLE, SUFFIX = "frequencies.table", ".tokens"
FILES = 1000  # added up together first, where places of files are worked out
SCALE_BITS = 20
LANES, STEPS = 1024, 256
BLOCK_IDS = LANES * STEPS * 2
LOW = np.uint64(1 << 31)
SHIFT, WORD = np.uint64(32), np.uint64(0xFFFFFFFF)
CACHED_WORDS, CACHED_LENGTH = 1 << 18, 64
SPACES = b" \t\n\v\f\r"
PARTS = words.byte_kinds(lambda b: 0 if b in SPACES else 1 if b >= 128 or 97 <= b <= 122 else 2 if 48 <= b <= 57 else 3)


# ---------------------------------------------------------------- coder


def scaled(counts: np.ndarray, bits: int = SCALE_BITS) -> np.ndarray:
    """Frequencies that add up to 2**bits, at least 1 for every id that occurs."""
    out, total = np.zeros(len(counts), np.int64), int(counts.sum())
    seen = counts > 0
    if not total:
        return out
    if int(seen.sum()) > 1 << bits:
        raise ValueError("more ids than slots")
    out[seen] = np.maximum(1, counts[seen] * (1 << bits) // total)
    over = int(out.sum()) - (1 << bits)
    if over < 0:
        out[int(np.argmax(out))] -= over
    for i in np.argsort(-out, kind="stable") if over > 0 else ():
        take = min(over, int(out[i]) - 1)
        out[i] -= take
        over -= take
        if not over:
            break
    return out


class Coder:
    def __init__(self, freqs: np.ndarray, bits: int = SCALE_BITS):
        self.bits = np.uint64(bits)
        self.mask = np.uint64((1 << bits) - 1)
        self.freqs = freqs.astype(np.uint64)
        self.starts = (np.cumsum(freqs) - freqs).astype(np.uint64)
        self.limits = self.freqs << np.uint64(63 - bits)
        self.ids = np.repeat(np.arange(len(freqs), dtype=np.uint32), freqs)

    def encode(self, ids: np.ndarray) -> bytes:
        """A block: numbers of ids, words and checkpoints, CRC-32, checkpoints' word places and states, words."""
        n = len(ids)
        rows = -(-n // LANES)
        x = np.full(LANES, LOW, np.uint64)
        words: list[np.ndarray] = []
        marks: list[tuple[int, np.ndarray]] = []
        written = 0
        for row in range(rows - 1, -1, -1):
            part = ids[row * LANES : (row + 1) * LANES]
            w = len(part)
            f, v = self.freqs[part], x[:w]
            full = v >= self.limits[part]
            if full.any():
                out = (v[full] & WORD).astype("<u4")
                words.append(out)
                written += len(out)
                v = np.where(full, v >> SHIFT, v)
            q = v // f
            x[:w] = (q << self.bits) + (v - q * f) + self.starts[part]
            if row % STEPS == 0:
                marks.append((written, x.copy()))
        marks.reverse()
        body = np.concatenate(words[::-1]) if words else np.empty(0, "<u4")
        head = struct.pack("<IIII", n, len(body), len(marks), zlib.crc32(ids.astype("<u4").tobytes()))
        return head + np.array([written - w for w, _ in marks], "<u4").tobytes() + b"".join(s.astype("<u8").tobytes() for _, s in marks) + body.tobytes()

    def decode(self, data: bytes) -> np.ndarray:
        """The ids of a block; the parts between its checkpoints advance together."""
        n, n_words, n_marks, crc = struct.unpack_from("<IIII", data)
        at = np.frombuffer(data, "<u4", n_marks, 16).astype(np.int64)
        x = np.frombuffer(data, "<u8", n_marks * LANES, 16 + 4 * n_marks).astype(np.uint64).reshape(n_marks, LANES).copy()
        words = np.frombuffer(data, "<u4", n_words, 16 + (4 + 8 * LANES) * n_marks)
        out = np.zeros((n_marks, STEPS, LANES), np.uint32)
        left = np.minimum(STEPS * LANES, n - np.arange(n_marks) * STEPS * LANES)
        for step in range(STEPS):
            live = left > step * LANES
            k = int(live.sum())  # only the last part can be short
            if not k:
                break
            v = x[:k]
            slot = v & self.mask
            ids = self.ids[slot]
            out[:k, step] = ids
            new = self.freqs[ids] * (v >> self.bits) + slot - self.starts[ids]
            need = new < LOW
            short = int(left[k - 1]) - step * LANES
            if short < LANES:  # lanes past the end of the block stay as they are
                need[k - 1, short:] = False
                new[k - 1, short:] = v[k - 1, short:]
            if need.any():
                rank = np.cumsum(need, axis=1)
                got = words[((at[:k, None] + rank - 1)[need])].astype(np.uint64)
                new[need] = (new[need] << SHIFT) | got
                at[:k] += rank[:, -1]
            x[:k] = new
        found = out.reshape(-1)[:n]
        if zlib.crc32(found.astype("<u4").tobytes()) != crc:
            raise ValueError("a block's checksum doesn't match its ids")
        return found


# ---------------------------------------------------------------- tokenizer


class WordTokenizer:
    """The library's ids of texts. This tokenizer drops white space and never joins what it parts, so pieces of a text are
    encoded one by one, and remembered. Plain words (printable ASCII and the letters of Latin-1, which NFC leaves alone; no
    contractions and special tokens) are lower-cased and parted here into letters, single digits and others, and the
    library's model gets the parts; other words go to the library as they are, wherever they stand. They are put out of the
    way first: a number in two private characters stands for each, which no plain word has."""

    PLAIN = re.compile(r"[\t-\r -~À-ÖØ-öø-ÿ]*")
    ODD = re.compile(r"[^\t-\r -~À-ÖØ-öø-ÿ]+")
    CONTRACTION = re.compile(r"'(?:s|t|re|ve|m|ll|d)")
    BREAKS = frozenset("\t\n\x0b\x0c\r ")
    PRIVATE = 0xE000

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.parts: list[dict[bytes, bytes]] = [{}, {}]
        self.known: list[dict[str, bytes]] = [{}, {}]
        shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
        self.letters = {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(b for b in range(256) if b not in shown)}
        steps = json.loads(self.tokenizer.to_str())
        kinds = [x["type"] for x in (steps["normalizer"] or {}).get("normalizers", [])] + [x["type"] for x in (steps["pre_tokenizer"] or {}).get("pretokenizers", [])]
        pattern = "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"
        if kinds != ["NFC", "Replace", "Lowercase", "Split", "ByteLevel"] or steps["pre_tokenizer"]["pretokenizers"][0]["pattern"] != {"Regex": pattern}:
            raise ValueError("this way of parting words doesn't fit the tokenizer")
        self.special = re.compile("|".join(re.escape(t["content"]) for t in steps["added_tokens"]) or "(?!)")
        if any("<" not in t["content"] for t in steps["added_tokens"]):
            raise ValueError("special tokens are expected to have a <")

    def part(self, part: bytes) -> bytes:
        if part[:1] == b"\xee":  # stands for a word that isn't plain
            a, b = part.decode()
            return self.word(self.odd[(ord(a) - self.PRIVATE << 12) + ord(b) - self.PRIVATE])
        shown = part.decode() if part.isascii() else "".join([self.letters[b] for b in part])
        return b"".join([t.id.to_bytes(4, "little") for t in self.model.tokenize(shown)])

    def word(self, word: str) -> bytes:
        known, older = self.known
        ids = known.get(word)
        if ids is None:
            ids = older.get(word) or np.array(self.tokenizer.encode(word, add_special_tokens=False).ids, "<u4").tobytes()
            if len(word) <= CACHED_LENGTH:
                known[word] = ids
        return ids

    def put_away(self, text: str, what: re.Pattern) -> str:
        """The text with the words that hold what is looked for put out of the way."""
        out, done, end, breaks = [], 0, len(text), self.BREAKS
        for found in what.finditer(text):
            a, b = found.span()
            if a < done:
                continue
            while a > done and text[a - 1] not in breaks:
                a -= 1
            while b < end and text[b] not in breaks:
                b += 1
            word = text[a:b]
            n = self.numbers.setdefault(word, len(self.numbers))
            if n == len(self.odd):
                self.odd.append(word)
            out += (text[done:a], chr(self.PRIVATE + (n >> 12)) + chr(self.PRIVATE + (n & 0xFFF)))
            done = b
        return "".join(out) + text[done:]

    def ids(self, texts: list[bytes], memory: list[dict], encode, kinds: np.ndarray, single: int | None) -> list[bytes]:
        distinct, which, bounds = words.distinct(texts, kinds, single)
        if len(memory[0]) > CACHED_WORDS:  # what comes again returns from the older half
            memory[:] = [{}, memory[0]]
        known, older = memory
        found = list(map(known.get, distinct))
        for i, ids in enumerate(found):
            if ids is None:
                w = distinct[i]
                ids = found[i] = older.get(w) or encode(w)
                if len(w) <= CACHED_LENGTH and w[:1] != b"\xee":
                    known[w] = ids
        ids, at = words.gathered(found, which, "<u4")
        cuts = at[bounds].tolist()
        return [ids[a:b].tobytes() for a, b in zip(cuts, cuts[1:], strict=False)]

    def __call__(self, texts: list[str]) -> list[bytes]:
        """Ids of some texts, packed as little-endian unsigned 32-bit integers."""
        self.odd: list[str] = []
        self.numbers: dict[str, int] = {}
        if len(self.known[0]) > CACHED_WORDS:
            self.known = [{}, self.known[0]]
        plain = []
        for t in texts:
            if not self.PLAIN.fullmatch(t):
                t = self.put_away(t, self.ODD)
            if "<" in t and self.special.search(t):
                t = self.put_away(t, self.special)
            t = t.lower()
            if "'" in t and self.CONTRACTION.search(t):
                t = self.put_away(t, self.CONTRACTION)
            plain.append(t.encode())
        return self.ids(plain, self.parts, self.part, PARTS, 2)


_tokenizers: dict[str, WordTokenizer] = {}


def tokenizer(path: str) -> WordTokenizer:
    if path not in _tokenizers:
        _tokenizers[path] = WordTokenizer(path)
    return _tokenizers[path]


def tokens(docs: DataFrame, tokenizer_path: str, end_id: int, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """part, seq, id, ids (packed as unsigned 32-bit integers, end id included), in ascending id order: by part, then seq."""
    placed = docs.select(id_col, text_col).repartitionByRange(id_col).sortWithinPartitions(id_col)
    placed = placed.select(F.spark_partition_id().alias("part"), id_col, text_col)
    schema = T.StructType([T.StructField("part", T.IntegerType()), T.StructField("seq", T.LongType()), docs.schema[id_col], T.StructField("ids", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        t, end, seq = tokenizer(tokenizer_path), np.array([end_id], "<u4").tobytes(), 0
        for batch in batches:
            for start, part in words.batches(x.as_py() or "" for x in batch.column(2)):
                n = len(part)
                out = pa.array([ids + end for ids in t(part)], pa.binary())
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(start, n), pa.array(np.arange(seq, seq + n)), batch.column(1).slice(start, n), out], schema.names)
                seq += n

    return placed.mapInArrow(run, schema)


# ---------------------------------------------------------------- files


def frequencies(ids: DataFrame, n_ids: int) -> np.ndarray:
    """Counts of all ids: added up in every task, then by id; what comes to the driver is bounded by the vocabulary."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(n_ids, np.int64)
        for batch in batches:
            total += np.bincount(np.frombuffer(b"".join(batch.column(0).to_pylist()), "<u4"), minlength=n_ids)
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(total[seen])], ["token", "n"])

    out = np.zeros(n_ids, np.int64)
    for token, n in ids.select("ids").mapInArrow(count, "token long, n long").groupBy("token").agg(F.sum("n")).collect():
        out[token] = n
    return out


def write_table(freqs: np.ndarray, folder: str) -> None:
    data = freqs.astype("<u4").tobytes()
    with shared_files.new_file(f"{folder}/{TABLE}") as out:
        out.write(TABLE_MAGIC + struct.pack("<II", VERSION, len(freqs)) + data + struct.pack("<I", zlib.crc32(data)))


def read_table(folder: str) -> np.ndarray:
    with shared_files.opened(f"{folder}/{TABLE}") as f:
        data = f.read()
    version, n = struct.unpack_from("<II", data, 8)
    if data[:8] != TABLE_MAGIC or version != VERSION or len(data) != 20 + 4 * n or zlib.crc32(data[16:-4]) != struct.unpack("<I", data[-4:])[0]:
        raise ValueError(f"{folder}/{TABLE} is damaged")
    return np.frombuffer(data, "<u4", n, 16).astype(np.int64)


def write(ids: DataFrame, freqs: np.ndarray, folder: str, id_col: str = "doc_id") -> DataFrame:
    """Writes shard files of rows of tokens(), and the table; one row per shard: uri, part, first_seq, n_docs, n_ids."""
    write_table(freqs, folder)
    table_crc = zlib.crc32(freqs.astype("<u4").tobytes())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pd.DataFrame]:
        coder, rows = Coder(freqs), []

        def shard(part: int, first: int, docs: Iterator[tuple]) -> None:
            uri = f"{folder}/{part:06d}-{first:012d}{SUFFIX}"
            keys, lengths, blocks, held, n_held, at, n_ids = [], [], [], [], 0, 20, 0
            with shared_files.new_file(uri) as out:
                out.write(MAGIC + struct.pack("<II", VERSION, table_crc) + b"\0" * 4)

                def put(ids: np.ndarray) -> None:
                    nonlocal at
                    data = coder.encode(ids)
                    out.write(data)
                    blocks.append((at, len(data), len(ids)))
                    at += len(data)

                for key, x in docs:
                    x = np.frombuffer(x, "<u4")
                    keys.append(key)
                    lengths.append(len(x))
                    n_ids += len(x)
                    held.append(x)
                    n_held += len(x)
                    while n_held >= BLOCK_IDS:
                        joined = np.concatenate(held)
                        put(joined[:BLOCK_IDS])
                        held, n_held = [joined[BLOCK_IDS:]], n_held - BLOCK_IDS
                if n_held:
                    put(np.concatenate(held))
                null = [k is None for k in keys]
                index = struct.pack("<QQQ", first, len(keys), len(blocks)) + np.array([0 if k is None else k for k in keys], "<i8").tobytes() + np.array(null, np.uint8).tobytes() + np.array(lengths, "<i8").tobytes() + np.array(blocks, "<i8").tobytes()
                out.write(index + struct.pack("<QI", len(index), zlib.crc32(index)) + MAGIC)
            rows.append((uri, part, first, len(keys), n_ids))

        def stream() -> Iterator[tuple]:
            for batch in batches:
                yield from zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True)

        row, it = None, stream()
        row = next(it, None)
        while row is not None:
            part, first = row[0], row[1]

            def together() -> Iterator[tuple]:
                nonlocal row
                want = first
                while row is not None and (row[0], row[1]) == (part, want):  # a shard has consecutive documents only
                    yield row[2], row[3]
                    row, want = next(it, None), want + 1

            shard(part, first, together())
        yield pa.RecordBatch.from_pandas(pd.DataFrame(rows, columns=["uri", "part", "first_seq", "n_docs", "n_ids"]).astype({"uri": "str", "part": "int32", "first_seq": "int64", "n_docs": "int64", "n_ids": "int64"}), preserve_index=False)

    return ids.select("part", "seq", F.col(id_col).cast("long").alias(id_col), "ids").mapInArrow(run, "uri string, part int, first_seq long, n_docs long, n_ids long")


def shards_of(spark: SparkSession, folder: str) -> DataFrame:
    """uri, file (its number in the order of names, which is that of documents) and n_ids of a folder's shards."""
    found = [(uri, i) for i, (uri, _) in enumerate(shared_files.sizes(folder, SUFFIX))]
    rows = spark.createDataFrame(found, "uri string, file long").repartition(max(1, min(len(found), spark.sparkContext.defaultParallelism * 4)), "file")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sums = []
            for uri in batch.column(0).to_pylist():
                with shared_files.opened(uri) as f:
                    index = index_of(f, uri)
                    _, n, _ = struct.unpack_from("<QQQ", index)
                    sums.append(int(np.frombuffer(index, "<i8", n, 24 + 9 * n).sum()))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(sums, pa.int64())], ["uri", "file", "n_ids"])

    return rows.mapInArrow(run, "uri string, file long, n_ids long")


def index_of(f, uri: str, table_crc: int | None = None) -> bytes:
    """A shard's index, checked; with a table's CRC-32 also whether the shard is of that table."""
    head, size = f.read(20), f.size()
    f.seek(size - 20)
    tail = f.read(20)
    length, crc = struct.unpack_from("<QI", tail)
    f.seek(size - 20 - length)
    index = f.read(length)
    version, table = struct.unpack_from("<II", head, 8)
    if head[:8] != MAGIC or tail[12:] != MAGIC or version != VERSION or zlib.crc32(index) != crc or table_crc not in (None, table):
        raise ValueError(f"{uri}: damaged, or of another frequency table")
    return index


def read(spark: SparkSession, folder: str, id_col: str = "doc_id") -> DataFrame:
    """Reads a folder that write() filled: id, start, ids (packed as unsigned 32-bit integers), one row per document."""
    schema = f"`{id_col}` long, start long, ids binary"
    freqs = read_table(folder)
    table_crc = zlib.crc32(freqs.astype("<u4").tobytes())
    shards = saved(shards_of(spark, folder).withColumn("pack", F.expr(f"file div {FILES}")), "shards")
    up_to = lambda w: F.coalesce(F.sum("n_ids").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    packs = shards.groupBy("pack").agg(F.sum("n_ids").alias("n_ids"))  # a row for FILES files
    packs = packs.select("pack", up_to(Window.orderBy("pack")).alias("before"))
    placed = shards.withColumn("inside", up_to(Window.partitionBy("pack").orderBy("file"))).join(packs, "pack").select("uri", (F.col("before") + F.col("inside")).alias("start"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = Coder(freqs)
        for batch in batches:
            for uri, start in zip(*(batch.column(i).to_pylist() for i in range(2)), strict=True):
                with shared_files.opened(uri) as f:
                    index = index_of(f, uri, table_crc)
                    _, n, n_blocks = struct.unpack_from("<QQQ", index)
                    keys, nulls = np.frombuffer(index, "<i8", n, 24), np.frombuffer(index, np.uint8, n, 24 + 8 * n)
                    lengths = np.frombuffer(index, "<i8", n, 24 + 9 * n)
                    blocks = np.frombuffer(index, "<i8", 3 * n_blocks, 24 + 17 * n).reshape(-1, 3)
                    held, next_block, i = np.empty(0, np.uint32), 0, 0
                    while i < n:
                        j, have = i, 0
                        while j < n and have + lengths[j] <= len(held):
                            have += lengths[j]
                            j += 1
                        if j == i:
                            at, size, _ = blocks[next_block]
                            f.seek(int(at))
                            held = np.concatenate([held, coder.decode(f.read(int(size)))])
                            next_block += 1
                            continue
                        ends = np.cumsum(lengths[i:j])
                        starts = ends - lengths[i:j]
                        raw = held.astype("<u4").tobytes()
                        ids = [raw[4 * a : 4 * b] for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
                        yield pa.RecordBatch.from_arrays([pa.array(np.ma.array(keys[i:j], mask=nulls[i:j].astype(bool)), pa.int64(), from_pandas=True), pa.array(starts + start), pa.array(ids, pa.binary())], [id_col, "start", "ids"])
                        start += have
                        held, i = held[have:], j

    return placed.repartition(max(1, shards.count()), "uri").mapInArrow(run, schema)


def encode_corpus(docs: DataFrame, tokenizer_path: str, end_id: int, text_col: str = "text", id_col: str = "doc_id") -> str:
    """Tokenises and writes all documents; returns the folder, which read() takes."""
    spark = docs.sparkSession
    ids = saved(tokens(docs, tokenizer_path, end_id, text_col, id_col), "ids")
    from tokenizers import Tokenizer

    freqs = scaled(frequencies(ids, max(end_id + 1, Tokenizer.from_file(tokenizer_path).get_vocab_size())))
    folder = new_path(spark, "tokens")
    saved(write(ids, freqs, folder, id_col), "written")
    return folder


def digests(read_back: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """id, start, n_tokens, ids_crc32 of rows of read()."""
    return read_back.select(id_col, "start", F.expr("length(ids) div 4").cast("long").alias("n_tokens"), F.crc32("ids").alias("ids_crc32"))
