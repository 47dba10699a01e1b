"""SentencePiece encoding that keeps offsets, and decoding.

A text is normalised by longest-prefix matches through the model's compiled character map, recording for every byte of the
result the source byte it came from. The normalised text is cut into pieces by the model's own merges (the pair of
neighbours with the best score first, the leftmost on ties), and every piece is projected through that record to a span of
source bytes. The ids are those of the sentencepiece library (tests compare).

Where no piece of the vocabulary crosses from another character to a space mark and the map is empty, runs "spaces + word" are
merged and projected independently of one another: all new runs of a batch are merged at once, in rounds, and a run's ids and
decoded text are remembered (in a memory of bounded size). The record is then known without a list: every byte stands for
itself, and a space mark for its space.

Nulls count as empty; an empty text has only the begin and end ids. Rows are independent: repeated rows, ids and nulls in
other columns have no effect, and an empty table gives an empty result. Extra columns are ignored.
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import words
from .common import model, released

MARK = "▁"
CACHED_RUNS, CACHED_LENGTH = 1 << 15, 64
BATCH_BYTES = 1 << 17
SHORT_RUN = 48  # characters; longer ones are merged with a heap
ROUNDS = 256  # characters; longer runs aren't merged together with others
MORE, NONE, STRETCH = b"\xff", b"\xfe", re.compile(rb"  +")  # bytes that no text has
WORDS = words.byte_kinds(lambda b: b != 32)


class CharMap:
    """A compiled character map: a double-array trie over source strings, then their replacements, each ended by NUL."""

    def __init__(self, blob: bytes):
        n = int.from_bytes(blob[:4], "little") if blob else 0
        self.units = np.frombuffer(blob, "<u4", n // 4, 4).tolist() if blob else []
        self.out = blob[4 + n :]

    def longest(self, data: bytes, at: int) -> tuple[int, bytes]:
        """Length and replacement of the longest source string at that place; length 0 if there is none."""
        if not self.units:
            return 0, b""
        jump = lambda u: (u >> 10) << ((u & 0x200) >> 6)
        node, found, length = jump(self.units[0]), -1, 0
        for i in range(at, len(data)):
            node ^= data[i]
            if node >= len(self.units) or (unit := self.units[node]) & 0x800000FF != data[i]:
                break
            node ^= jump(unit)
            if unit & 0x100:
                found, length = self.units[node] & 0x7FFFFFFF, i + 1 - at
        return (length, self.out[found : self.out.index(b"\0", found)]) if found >= 0 else (0, b"")


class PieceCodec:
    """One model, loaded in the process that uses it."""

    def __init__(self, path: str):
        from sentencepiece import sentencepiece_model_pb2 as pb

        spec = pb.ModelProto()
        with open(path, "rb") as f:
            spec.ParseFromString(f.read())
        norm, kinds = spec.normalizer_spec, pb.ModelProto.SentencePiece
        odd = any(p.type in (kinds.USER_DEFINED, kinds.UNUSED) for p in spec.pieces)
        if spec.trainer_spec.model_type != 2 or not spec.trainer_spec.byte_fallback or not norm.escape_whitespaces or spec.trainer_spec.treat_whitespace_as_suffix or odd:
            raise ValueError("needs a BPE model with byte fallback, escaped spaces, prefix space marks and normal pieces only")
        self.map, self.prefix, self.squeeze = CharMap(norm.precompiled_charsmap), norm.add_dummy_prefix, norm.remove_extra_whitespaces
        self.merges: dict[str, tuple[float, int]] = {}  # score and id of the pieces that merges may build
        self.byte_ids = [0] * 256
        self.bytes = []
        for i, p in enumerate(spec.pieces):
            if p.type == kinds.NORMAL:
                self.merges.setdefault(p.piece, (p.score, i))
            if p.type == kinds.BYTE:
                self.byte_ids[int(p.piece[3:5], 16)] = i
            self.bytes.append(bytes([int(p.piece[3:5], 16)]) if p.type == kinds.BYTE else b"" if p.type in (kinds.CONTROL, kinds.UNKNOWN) else p.piece.encode())
        self.lengths = np.array([len(b) for b in self.bytes], np.int64)
        self.widths = np.array([len(b.replace(MARK.encode(), b" ")) for b in self.bytes], np.int64)  # source bytes where the map is empty
        self.shown = [b.replace(MARK.encode(), b" ") for b in self.bytes]
        plain = all(MARK not in p.piece.lstrip(MARK) for p in spec.pieces)
        self.by_runs = plain and self.prefix and not self.squeeze and not self.map.units
        self.ends = [np.array([x], "<u4").tobytes() for x in (spec.trainer_spec.bos_id, spec.trainer_spec.eos_id)]
        self.known: list[dict[bytes, tuple[bytes, bytes]]] = [{}, {}]  # ids and decoded text of words after a space; an older half
        self.table: tuple | None = None

    def merged(self, text: str) -> list[int]:
        """Ids of a normalised text by merges."""
        parts = list(text)
        score = self.merges.get
        if len(parts) <= SHORT_RUN:
            gains = [score(a + b) for a, b in zip(parts, parts[1:], strict=False)]
            while True:
                best, at = None, -1
                for i, g in enumerate(gains):
                    if g is not None and (best is None or g[0] > best):
                        best, at = g[0], i
                if at < 0:
                    break
                parts[at : at + 2] = [parts[at] + parts[at + 1]]
                del gains[at]
                if at:
                    gains[at - 1] = score(parts[at - 1] + parts[at])
                if at < len(gains):
                    gains[at] = score(parts[at] + parts[at + 1])
        else:
            after, before = list(range(1, len(parts) + 1)), list(range(-1, len(parts) - 1))
            heap = [(-g[0], i, a, b) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False)) if (g := score(a + b))]
            heapq.heapify(heap)
            while heap:
                _, i, a, b = heapq.heappop(heap)
                j = after[i]
                if parts[i] != a or j >= len(parts) or parts[j] != b:
                    continue
                parts[i], parts[j], after[i] = a + b, "", after[j]
                if after[i] < len(parts):
                    before[after[i]] = i
                for left, right in ((before[i], i), (i, after[i])):
                    if left >= 0 and right < len(parts) and (g := score(parts[left] + parts[right])):
                        heapq.heappush(heap, (-g[0], left, parts[left], parts[right]))
            parts = [p for p in parts if p]
        ids: list[int] = []
        for p in parts:
            found = score(p)
            if found:
                ids.append(found[1])
            else:
                ids += [self.byte_ids[b] for b in p.encode()]
        return ids

    def normalise(self, text: str) -> tuple[bytes, np.ndarray]:
        """The normalised text, and the source byte of each of its bytes and of its end."""
        data = text.encode()
        if not data:
            return b"", np.zeros(1, np.int64)
        if not self.map.units and not self.squeeze:
            given = np.frombuffer(data, np.uint8)
            source = np.repeat(np.arange(len(data) + 1), np.where(np.append(given, 0) == 32, 3, 1))
            out = data.replace(b" ", MARK.encode())
            return (MARK.encode() + out, np.concatenate([np.zeros(3, np.int64), source])) if self.prefix else (out, source)
        parts: list[tuple[bytes, int, int]] = []  # replacement, first and next source byte
        at = 0
        while at < len(data):
            length, new = self.map.longest(data, at)
            if not length:
                length = 1 + sum(data[at] >= x for x in (0xC0, 0xE0, 0xF0))
                new = data[at : at + length]
            parts.append((new, at, at + length))
            at += length
        out, source, spaced = bytearray(), [], self.squeeze
        if self.prefix:
            out += MARK.encode()
            source += [0] * 3
        for new, start, _ in parts:
            for char in new.decode():
                if char == " " and self.squeeze and spaced:
                    continue
                spaced = char == " "
                b = (MARK if char == " " else char).encode()
                out += b
                source += [start] * len(b)
        end = len(data)
        while self.squeeze and out.endswith(MARK.encode()):
            end = source[-1]
            del out[-3:], source[-3:]
        return bytes(out), np.array([*source, end], np.int64)

    def encode(self, text: str) -> np.ndarray:
        """The ids, without begin and end."""
        return np.array(self.merged(self.normalise(text)[0].decode()), "<u4")

    def spans(self, text: str, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First and next source byte of each id."""
        normal, source = self.normalise(text)
        ends = np.cumsum(self.lengths[ids])
        if len(ids) and ends[-1] != len(normal):
            raise ValueError("the pieces don't cover the normalised text")
        at = np.concatenate([[0], ends])
        return source[at[:-1]], source[at[1:]]

    def decode(self, ids: np.ndarray) -> str:
        shown = self.shown
        data = b"".join([shown[i] for i in ids.tolist()])
        return (data[1:] if self.prefix and data[:1] == b" " else data).decode("utf-8", "replace")


    def pairs(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, dict[str, int]]:
        """Sorted pairs of neighbours that merge (left * symbols + right), what each becomes, the score of every piece, and the
        number of each symbol: pieces have their ids, single characters that are no pieces numbers beyond."""
        symbols = {p: i for p, (_, i) in self.merges.items()}
        for p in self.merges:
            for c in p:
                symbols.setdefault(c, len(self.bytes) + len(symbols))
        n = max(symbols.values(), default=0) + 2
        found = [(symbols[p[:k]] * n + symbols[p[k:]], i) for p, (_, i) in self.merges.items() for k in range(1, len(p)) if p[:k] in symbols and p[k:] in symbols]
        found.sort()
        scores = np.zeros(len(self.bytes))
        for score, i in self.merges.values():
            scores[i] = score
        return np.array([x for x, _ in found] + [n * n], np.int64), np.array([i for _, i in found] + [0], np.int64), scores, symbols | {"": n - 1}

    def merged_all(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """merged() of many short texts at once: their ids, and where each text's begin. Each round does the best merge of
        every text that has one."""
        if self.table is None:
            self.table = self.pairs()
        keys, becomes, scores, symbols = self.table
        n = symbols[""] + 1
        chars = np.frombuffer("".join(texts).encode("utf-32-le"), "<u4")
        known, which = np.unique(chars, return_inverse=True)
        sym = np.array([symbols.get(chr(c), n - 1) for c in known.tolist()], np.int64)[which]
        of = np.repeat(np.arange(len(texts)), [len(t) for t in texts])
        at = np.arange(len(chars))  # the first character of each symbol
        done: list[tuple[np.ndarray, ...]] = []
        while len(sym):
            pair = sym[:-1] * n + sym[1:]
            place = np.searchsorted(keys, pair)
            hit = np.append((keys[place] == pair) & (of[:-1] == of[1:]), False)
            gain = np.full(len(sym), -np.inf)
            gain[:-1][hit[:-1]] = scores[becomes[place[hit[:-1]]]]
            first = np.flatnonzero(np.append(True, of[1:] != of[:-1]))
            best = np.maximum.reduceat(gain, first)
            best = np.repeat(best, np.diff(np.append(first, len(of))))
            open_ = best > -np.inf
            if not open_.all():
                done.append((of[~open_], at[~open_], sym[~open_]))
            do = np.flatnonzero(hit & (gain == best))
            do = do[np.append(True, of[do][1:] != of[do][:-1])] if len(do) else do  # the leftmost
            sym[do] = becomes[place[do]]
            open_[do + 1] = False
            sym, of, at = sym[open_], of[open_], at[open_]
        of, at, sym = (np.concatenate(x) for x in zip(*done, strict=True)) if done else (np.empty(0, np.int64),) * 3
        order = np.argsort(at)
        of, at, sym = of[order], at[order], sym[order]
        odd = np.flatnonzero(sym >= len(self.bytes))
        if len(odd):  # characters that no piece has: their bytes
            raw = [[self.byte_ids[b] for b in chr(c).encode()] for c in chars[at[odd]].tolist()]
            times = np.ones(len(sym), np.int64)
            times[odd] = [len(r) for r in raw]
            of = np.repeat(of, times)
            ends = np.cumsum(times)
            sym = np.repeat(sym, times)
            for k, r in zip(odd.tolist(), raw, strict=True):
                sym[ends[k] - len(r) : ends[k]] = r
        return sym, np.searchsorted(of, np.arange(len(texts) + 1))

    @staticmethod
    def marked(data: bytes) -> bytes:
        """A text in which all spaces but one before each word have become MORE bytes of that word, so that its runs are the
        words: leading spaces (the added prefix is the one before them), the rest of stretches, and trailing ones, whose last
        run has no word (NONE)."""
        if data[:1] != b" " and data[-1:] != b" " and b"  " not in data:
            return data
        own = data.lstrip(b" ")
        front, tail = len(data) - len(own), b""
        if own[-1:] == b" " or not own:
            inner = own.rstrip(b" ")
            tail, own = (b" " + MORE * (len(own) - len(inner) - 1) if own else b"") + NONE, inner
        return MORE * front + STRETCH.sub(lambda m: b" " + MORE * (len(m[0]) - 1), own) + tail

    def runs(self, texts: list[bytes]) -> list[tuple[bytes, bytes, bytes, bytes]]:
        """encoded() of texts without space marks of their own, put together from runs of spaces and a word."""
        distinct, which, bounds = words.distinct([self.marked(t) for t in texts], WORDS)
        if len(self.known[0]) > CACHED_RUNS:  # what comes again returns from the older half
            self.known = [{}, self.known[0]]
        known, older = self.known
        found = [known.get(w) or older.get(w) for w in distinct]
        new = [i for i, x in enumerate(found) if x is None]
        normal = [(MARK.encode() + distinct[i].replace(MORE, MARK.encode()).replace(NONE, b"")).decode() for i in new]
        short = [k for k, t in enumerate(normal) if len(t) <= ROUNDS]
        ids, cuts = self.merged_all([normal[k] for k in short])
        packed, cuts, shown = ids.astype("<u4").tobytes(), cuts.tolist(), [self.shown[i] for i in ids.tolist()]
        for k, a, b in zip(short, cuts, cuts[1:], strict=False):
            found[new[k]] = packed[4 * a : 4 * b], b"".join(shown[a:b])
        for i, t in zip(new, normal, strict=True):
            if found[i] is None:  # as many rounds as characters would be too many
                own = self.merged(t)
                found[i] = np.array(own, "<u4").tobytes(), b"".join([self.shown[x] for x in own])
        for w, x in zip(distinct, found, strict=True):
            if len(w) <= CACHED_LENGTH:
                known[w] = x
        ids, at = words.gathered([x[0] for x in found], which, "<u4")
        ends = np.append(0, np.cumsum(self.widths[ids]))  # a run's normalised text has its source's bytes, but for the marks
        shown = [x[1] for x in found]
        said = which.tolist()
        out = []
        for a, b in zip(bounds.tolist(), bounds[1:].tolist(), strict=False):
            i, j = int(at[a]), int(at[b])
            span = np.maximum(ends[i : j + 1] - ends[i] - 1, 0).astype("<u4")  # the first run's space is the added prefix
            data = b"".join([shown[k] for k in said[a:b]])
            out.append((ids[i:j].tobytes(), span[:-1].tobytes(), span[1:].tobytes(), data[1:]))
        return out

    def encoded(self, texts: list[str]) -> list[tuple[bytes, bytes, bytes, str]]:
        """Packed ids, first and next source bytes (begin and end ids included), and the decoded text, of each text."""
        out: list[tuple] = [()] * len(texts)
        simple = []
        for i, t in enumerate(texts):
            if self.by_runs and t and MARK not in t:
                simple.append(i)
            else:
                ids = self.encode(t)
                starts, ends = self.spans(t, ids)
                out[i] = ids.tobytes(), starts.astype("<u4").tobytes(), ends.astype("<u4").tobytes(), self.decode(ids)
        data = [texts[i].encode() for i in simple]
        for i, x in zip(simple, self.runs(data) if data else (), strict=True):
            out[i] = (*x[:3], x[3].decode("utf-8", "replace"))
        zero = np.zeros(1, "<u4").tobytes()
        done = []
        for t, (ids, starts, ends, decoded) in zip(texts, out, strict=True):
            last = np.array([len(t.encode())], "<u4").tobytes()
            done.append((self.ends[0] + ids + self.ends[1], zero + starts + last, zero + ends + last, decoded))
        return done


def codec(path: str) -> PieceCodec:
    return model(f"pieces {path}", lambda: PieceCodec(path))


def encode_texts(docs: DataFrame, model_path: str, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """Per row: id, piece_ids, piece_starts, piece_ends (each packed as little-endian unsigned 32-bit integers), decoded.

    piece_ids has begin and end ids. A piece's span is the source bytes start to end - 1; a byte piece spans its one byte,
    the begin and end ids span nothing. decoded is what decoding piece_ids gives. The model file must be at the same path
    on every machine.
    """
    kind = docs.schema[id_col].dataType
    schema = T.StructType([T.StructField(id_col, kind), *(T.StructField(c, T.BinaryType()) for c in ("piece_ids", "piece_starts", "piece_ends")), T.StructField("decoded", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(model_path)
        for batch in released(batches):
            for start, part in words.batches((t.as_py() or "" for t in batch.column(1)), BATCH_BYTES):
                cols = list(zip(*c.encoded(part), strict=True))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(start, len(part)), *(pa.array(x, pa.binary()) for x in cols[:3]), pa.array(cols[3], pa.string())], schema.names)
        c.known = [{}, {}]  # the process may go on with other stages

    return docs.select(id_col, text_col).mapInArrow(run, schema)


def digests(encoded: DataFrame, id_col: str = "doc_id", keep: list[str] = ()) -> DataFrame:
    """id, n_tokens, ids_sha256, decoded_sha256 and spans_sha256 (of starts, then ends) of encode_texts(), and columns to keep."""
    sha = lambda *c: F.sha2(F.concat(*c), 256)
    return encoded.select(id_col, *keep, F.expr("length(piece_ids) div 4").cast("long").alias("n_tokens"), F.sha2("piece_ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"), sha("piece_starts", "piece_ends").alias("spans_sha256"))
