"""Token ids in Arrow IPC files whose batches are fixed-size lists.

Documents are put in ascending doc_id order by range, each task encodes its range and writes one
IPC file: every row is a sequence of `sequence` ids and a mask of the same length, the last row of
a file padded and masked out, so that sequence k of a file lies at a computed place and is read
without a copy. An index file beside it says where each document starts. The place of a file in
the whole stream is the sum of the ids before it, taken from one small row per file.

Encoding is that of the tokenizers library. Its pre-tokenizer never lets a token cross a single
space that stands between two visible characters, so texts are encoded by the pieces between such
spaces: a chunk's pieces are dictionary-encoded in Arrow, each distinct one is encoded once, those
met lately are remembered (a bounded number), and ids are gathered by index. A text with other white
space around a space is encoded as a whole.

Defined cases: null is the empty text, which has only the end id; rows with equal doc_id follow
each other by text; a null doc_id comes first; a very long text is worked on in parts; other columns are ignored; an empty table gives no
rows and no ids.
"""

from __future__ import annotations

import json
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, shared_path, sliced
from .storage import new_file, open_dir

SEQUENCE, END_ID = 2048, 0
#: Words of a generation that a Python worker remembers, some 220 bytes each, two generations; and new words that are encoded in one call.
REMEMBERED, TOGETHER = 300_000, 64
#: Characters after which a longer text is cut at a space.
PART = 4 << 20
#: Sequences of a record batch.
ROWS = 512
_SCHEMA = "part int, path string, index string, n_docs long, n_tokens long"


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


class Encoder:
    """Ids of whole texts, a chunk at a time."""

    def __init__(self, path: str, remembered: int = REMEMBERED):
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        import regex
        from tokenizers import Tokenizer

        self.tokenizer, self.most = Tokenizer.from_file(path), remembered
        self.dtype = np.dtype(np.uint16 if self.tokenizer.get_vocab_size() <= 1 << 16 else np.uint32)
        with open(path, encoding="utf-8") as f:
            model = json.load(f)
        pre = model.get("pre_tokenizer") or {}
        self.plain = model.get("normalizer") is None and pre.get("type") == "ByteLevel" and pre.get("use_regex") and not pre.get("add_prefix_space") and not any(t["lstrip"] or t["rstrip"] or t["single_word"] for t in model["added_tokens"])
        self.added = [t["content"] for t in model["added_tokens"]]
        if self.plain:
            self.tokenizer.model._resize_cache(0)
            # By id, whether the token begins with the byte-level sign of a space: the first token of a word does, no other can.
            self.begins = np.zeros(self.tokenizer.get_vocab_size(), bool)
            self.begins[[i for t, i in self.tokenizer.get_vocab().items() if t.startswith("\u0120")]] = True
        # Control characters and white space that libraries class differently, scripts without spaces: encoded whole.
        self.odd = regex.compile(r"\s\s|[\x1c-\x1f\x85\xa0\u0590-\u1fff\u2000-\u200a\u2028-\u202f\u205f-\uffff\U00010000-\U0010ffff]").search
        # Ids of a space and the word, of the words met lately and before.
        self.words: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def _whole(self, text: str) -> bool:
        """Whether the text must not be cut at its spaces. The quick tests only say yes too often."""
        try:
            text.encode("latin-1")
        except UnicodeEncodeError:
            return self.odd(text) is not None or any(a in text for a in self.added)
        return any(x in text for x in ("  ", " \n", "\n ", "\t", "\r", "\x0b", "\x0c", "\x1c", "\x1d", "\x1e", "\x1f", "\x85", "\xa0", *self.added))

    def _encode(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, self.dtype).tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self, fresh: list[str]) -> dict[str, bytes]:
        """Ids of a space and each word. Words are encoded many at a time and told apart by the tokens that begin with a space."""
        out, size = {}, self.dtype.itemsize
        groups = [fresh[i : i + TOGETHER] for i in range(0, len(fresh), TOGETHER)]
        for words, e in zip(groups, self.tokenizer.encode_batch_fast([" " + " ".join(g) for g in groups], add_special_tokens=False), strict=True):
            ids = np.array(e.ids, self.dtype)
            at = np.flatnonzero(self.begins[ids])
            if len(at) != len(words) or at[0]:
                out.update(zip(words, self._encode([" " + w for w in words]), strict=True))
                continue
            raw, ends = ids.tobytes(), [*(at[1:] * size).tolist(), len(ids) * size]
            lo = 0
            for w, hi in zip(words, ends, strict=True):
                out[w] = raw[lo:hi]
                lo = hi
        return out

    def _known(self, words: list[str]) -> list[bytes]:
        """Ids of a space and each of the distinct words. At most `most` words are remembered in each of two generations."""
        if len(self.words) > self.most:
            self.words, self.older = {}, self.words
        new, old, missing = self.words, self.older, []
        for w in words:
            if w not in new:
                if w in old:
                    new[w] = old[w]
                else:
                    missing.append(w)
        new.update(self._learn(missing))
        return list(map(new.__getitem__, words))

    def _cut(self, texts: list[str], spaced: list[bool]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of texts that may be cut at their spaces, one after another, and how many each has; spaced ones have a space before them."""
        pieces = pc.split_pattern(pa.array(texts, pa.large_string()), " ")
        at = pieces.offsets.to_numpy().astype(np.int64)
        flat = pieces.flatten().dictionary_encode()
        code = flat.indices.to_numpy().copy()
        bare = at[:-1][~np.array(spaced, bool)]  # a first piece without a space before it
        heads, which = np.unique(code[bare], return_inverse=True)
        words = flat.dictionary.to_pylist()
        code[bare] = len(words) + which
        known = self._known(words) + self._encode([words[k] for k in heads.tolist()])
        size = np.fromiter(map(len, known), np.int64, len(known)) // self.dtype.itemsize
        table, start = np.frombuffer(b"".join(known), self.dtype), np.cumsum(size) - size
        n = size[code]
        ends = np.cumsum(n)
        place = np.repeat(start[code] - (ends - n), n)
        place += np.arange(ends[-1])
        return table[place], np.diff(np.r_[0, ends][at])

    def _in_parts(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """_cut() of parts of bounded length, since ids in the making take several times the text's memory."""
        parts, spaced, owner = [], [], []
        for i, t in enumerate(texts):
            lo = 0
            while True:
                hi = t.find(" ", lo + PART) if len(t) - lo > PART else -1
                parts.append(t[lo : hi if hi >= 0 else len(t)])
                spaced.append(lo > 0)
                owner.append(i)
                if hi < 0:
                    break
                lo = hi + 1
        out, sizes, lo, held = [], [], 0, 0
        for k, p in enumerate(parts):
            held += len(p)
            if held >= 2 * PART or k == len(parts) - 1:
                ids, n = self._cut(parts[lo : k + 1], spaced[lo : k + 1])
                out.append(ids)
                sizes.append(n)
                lo, held = k + 1, 0
        return np.concatenate(out), np.bincount(owner, weights=np.concatenate(sizes), minlength=len(texts)).astype(np.int64)

    def encode(self, texts: list[str], end: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the texts one after another, each with the id `end` after it if given, and how many each has."""
        whole = [not self.plain or self._whole(t) for t in texts]
        parts: list[np.ndarray] = [np.zeros(0, self.dtype)] * len(texts)
        apart = [i for i, w in enumerate(whole) if w]
        for i, ids in zip(apart, self._encode([texts[i] for i in apart]), strict=True):
            parts[i] = np.frombuffer(ids, self.dtype)
        rest = [i for i, w in enumerate(whole) if not w]
        if rest:
            ids, n = self._in_parts([texts[i] for i in rest])
            if len(rest) == len(texts):
                out, size = ids, n
            else:
                for i, x in zip(rest, np.split(ids, np.cumsum(n)[:-1]), strict=True):
                    parts[i] = x
        if len(rest) != len(texts) or not rest:
            out, size = np.concatenate([np.zeros(0, self.dtype), *parts]), np.array([len(p) for p in parts], np.int64)
        if end is not None:
            out, size = np.insert(out, np.cumsum(size), end), size + 1
        return out, size


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


class SequenceWriter:
    """Writes a stream of ids as equal-length sequences with masks, and an index of documents."""

    def __init__(self, folder: str, sequence: int, dtype):
        self.system, self.path = new_file(folder, "arrow")
        self.sequence, self.dtype = sequence, np.dtype(dtype)
        self.schema = pa.schema([("ids", pa.list_(pa.from_numpy_dtype(self.dtype), sequence)), ("mask", pa.list_(pa.bool_(), sequence))])
        self.stream = self.system.open_output_stream(self.path, compression=None)
        self.file = pa.ipc.new_file(self.stream, self.schema)
        self.buffer: list[np.ndarray] = []
        self.held = self.total = 0

    def add(self, ids: np.ndarray) -> None:
        self.buffer.append(ids.astype(self.dtype))
        self.held += len(ids)
        self.total += len(ids)
        if self.held >= ROWS * self.sequence:
            self._flush(self.held // (ROWS * self.sequence) * ROWS * self.sequence)

    def _flush(self, n: int) -> None:
        flat = np.concatenate(self.buffer) if self.buffer else np.zeros(0, self.dtype)
        size = ROWS * self.sequence
        for lo in range(0, n, size):
            part = flat[lo : min(n, lo + size)]
            rows = -(-len(part) // self.sequence)
            mask = np.arange(rows * self.sequence) < len(part)
            padded = np.pad(part, (0, rows * self.sequence - len(part)))
            self.file.write_batch(pa.record_batch([pa.FixedSizeListArray.from_arrays(pa.array(padded), self.sequence), pa.FixedSizeListArray.from_arrays(pa.array(mask), self.sequence)], schema=self.schema))
        self.buffer, self.held = [flat[n:]], len(flat) - n

    def close(self) -> None:
        self._flush(self.held)
        self.file.close()
        self.stream.close()


class SequenceReader:
    """Random access to a written file; sequences and flat ranges of ids are views of the mapped file where it is local."""

    def __init__(self, path: str, uri: str):
        system, _ = open_dir(uri)
        local = type(system).__name__ == "LocalFileSystem"
        self.source = pa.memory_map(path) if local else system.open_input_file(path)
        self.file = pa.ipc.open_file(self.source)
        self.sequence = self.file.schema.field("ids").type.list_size
        self.at, self.batch = -1, None

    def _ids(self, k: int) -> np.ndarray:
        if self.at != k:
            self.at, self.batch = k, self.file.get_batch(k).column(0).flatten().to_numpy(zero_copy_only=False)
        return self.batch

    def sequence_at(self, k: int) -> np.ndarray:
        flat = self._ids(k // ROWS)
        lo = k % ROWS * self.sequence
        return flat[lo : lo + self.sequence]

    def ids(self, start: int, n: int) -> np.ndarray:
        size, parts = ROWS * self.sequence, []
        while n > 0:
            k, lo = divmod(start, size)
            take = min(n, size - lo)
            parts.append(self._ids(k)[lo : lo + take])
            start, n = start + take, n - take
        return parts[0] if len(parts) == 1 else np.concatenate(parts) if parts else np.zeros(0, np.uint32)


def write_tokens(docs: DataFrame, folder: str, tokenizer_path: str | None = None, sequence: int = SEQUENCE, end_id: int = END_ID, partitions: int | None = None) -> DataFrame:
    """Writes docs(doc_id, text, ...) and returns one row per file (part, path, index, n_docs, n_tokens), in order of part."""
    spark = docs.sparkSession
    tokenizer_path = tokenizer_path or default_path()
    parts = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))

    def run(batches):
        from pyspark import TaskContext

        enc, out, index, n_docs, ids, stream = encoder(tokenizer_path), None, None, 0, pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64())]), None
        for b in batches:
            doc_ids, texts = b.column(0), b.column(1)
            for lo, hi in sliced(texts):
                encoded, sizes = enc.encode(texts.slice(lo, hi - lo).to_pylist(), end_id)
                if out is None:
                    out = SequenceWriter(folder, sequence, enc.dtype)
                    system, index_path = new_file(folder, "index.arrow")
                    stream = system.open_output_stream(index_path, compression=None)
                    index = pa.ipc.new_file(stream, ids)
                index.write_batch(pa.record_batch([doc_ids.slice(lo, hi - lo), pa.array(out.total + np.cumsum(sizes) - sizes), pa.array(sizes)], schema=ids))
                out.add(encoded)
                n_docs += hi - lo
        if out is not None:
            out.close()
            index.close()
            stream.close()
            yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int32()), pa.array([out.path]), pa.array([index_path]), pa.array([n_docs], pa.int64()), pa.array([out.total], pa.int64())], names=["part", "path", "index", "n_docs", "n_tokens"])

    ordered = rows.repartitionByRange(parts, "doc_id").sortWithinPartitions("doc_id", "text")
    return cut(ordered.mapInArrow(run, _SCHEMA)).orderBy("part")


def read_tokens(files: DataFrame, folder: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, read back from the files; start counts the ids of all documents before it."""
    spark = files.sparkSession
    base, rows = 0, []
    for r in files.collect():  # one row per file
        rows.append((r["path"], r["index"], base))
        base += r["n_tokens"]

    def run(batches):
        for b in batches:
            for path, index, before in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
                system, _ = open_dir(folder)
                reader = SequenceReader(path, folder)
                with system.open_input_file(index) as f:
                    for part in (x := pa.ipc.open_file(f)).schema and (x.get_batch(k) for k in range(x.num_record_batches)):
                        starts, sizes = part.column(1).to_pylist(), part.column(2).to_pylist()
                        crc = [zlib.crc32(reader.ids(s, n).astype("<u4").tobytes()) for s, n in zip(starts, sizes, strict=True)]
                        yield pa.RecordBatch.from_arrays([part.column(0), pa.array([before + s for s in starts], pa.int64()), part.column(2), pa.array(crc, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    places = spark.createDataFrame(rows, "path string, index string, base long")
    return places.repartition(max(1, len(rows)), "path").mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def tokenised(docs: DataFrame, tokenizer_path: str | None = None) -> DataFrame:
    folder = shared_path(docs.sparkSession, "tokens")
    return read_tokens(write_tokens(docs, folder, tokenizer_path), folder)
