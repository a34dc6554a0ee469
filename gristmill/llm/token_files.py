"""Token-id files: ids in fixed-size blocks, transposed into bit or byte planes, each plane compressed with zstandard.

Layout of a file: ``MAGIC``, the chunks, a footer, the footer's length (8 bytes, little-endian), ``MAGIC``.
A chunk holds one block of ids as its planes, one after the other, each compressed by itself.
The footer is zstandard over JSON-headed arrays: the chunk index (offset, ids, bytes per id, length of every plane)
and the document index (doc_id, null flag, ids).  Ids are unsigned 32-bit; a block whose ids all fit 16 bits keeps 16
planes (2 for bytes).

Rows: null text counts as empty; every document ends with ``end_id``.  Documents are stored by doc_id (null first),
then by text.  Rows that repeat a doc_id are stored once each.  An empty table gives no files and an empty result.
Other columns of the input are ignored, whatever their names.
"""

from __future__ import annotations

import json
import os
import re
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401  (as pa.compute)
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gristmill.functions.shingles import buffers
from gristmill.llm.files import read_range, write_file
from gristmill.storage import materialize, scratch_path, small_batches

MAGIC = b"GMTOKID1"
BLOCK_IDS = 65536
FILE_IDS = 8_000_000
MANIFEST = "part int, seq int, path string, size long, n_docs long, n_ids long"
RESULT = "doc_id long, start long, n_tokens long, ids_crc32 long"
#: Bytes of text that are encoded at once.
SLICE_BYTES = 1_500_000
#: Pieces and words that an encoder keeps, and their characters: some 150 MB in a worker.
KNOWN, KNOWN_CHARS = 400_000, 12_000_000
#: Control characters that str.split() takes for white space, and the brackets of special tokens: such texts go whole.
_ODD = re.compile("[\x1c-\x1f]|<\\|")
#: fixed values: what a tokenizer's file must say for its texts to be cut here
_NORMAL = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]}
_CUTS = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: Kinds of ASCII bytes: white space, letter, digit, other; and of the two-byte characters up to U+00FF by their code.
_GAP, _LETTER, _DIGIT, _OTHER = range(4)
_KIND = np.array([_GAP if chr(c) in " \t\n\v\f\r\x85\xa0" else _LETTER if chr(c).isalpha() else _DIGIT if chr(c).isnumeric() else _OTHER for c in range(256)], np.uint8)
_DOWN = np.arange(256, dtype=np.uint8)
_DOWN[65:91] += 32


# --- encoding -------------------------------------------------------------------------------------------------------


def cut_pieces(data: np.ndarray, offsets: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    """Lowered pieces of texts of characters up to U+00FF: runs of letters, single digits, runs of others, and ``'s``,
    ``'t``, ``'re``, ``'ve``, ``'m``, ``'ll``, ``'d`` where such a run of others would begin.  Also each text's first piece.
    """
    low, kind = _DOWN[data], _KIND[data]
    lead = np.flatnonzero(data >= 0xC2) if len(data) and data.max() >= 0x80 else np.zeros(0, np.int64)
    if len(lead):
        code = (data[lead].astype(np.int16) - 0xC0) * 64 + (data[lead + 1] & 0x3F)
        kind[lead] = kind[lead + 1] = _KIND[code]
        capital = (code >= 0xC0) & (code <= 0xDE) & (code != 0xD7)
        low[lead[capital] + 1] += 32
    starts = np.empty(len(data), bool)
    starts[:1] = True
    np.not_equal(kind[1:], kind[:-1], out=starts[1:])
    starts |= kind == _DIGIT
    starts[offsets[:-1][offsets[:-1] < len(data)]] = True
    starts[lead + 1] = False
    starts &= kind != _GAP
    marks = np.flatnonzero((data == 39) & starts)
    if len(marks):
        stop = offsets[np.searchsorted(offsets, marks, "right")]
        after = lambda k: np.where(marks + k < stop, low[np.minimum(marks + k, len(low) - 1)], 0)
        one, two = after(1), after(2)
        size = np.where(np.isin(one, list(b"stmd")), 1, np.where(((one == 114) | (one == 118)) & (two == 101) | (one == 108) & (two == 108), 2, 0))
        marks, stop, size = marks[size > 0], stop[size > 0], size[size > 0]
        starts[marks + 1] = False
        nxt = marks + size + 1
        nxt = nxt[nxt < stop]
        starts[nxt[kind[nxt] != _GAP]] = True
    used = kind != _GAP
    first = np.flatnonzero(starts)
    before = np.concatenate([np.zeros(1, np.int64), np.cumsum(used)])
    bounds = np.append(before[first], before[-1])
    pieces = pa.LargeStringArray.from_buffers(len(first), pa.py_buffer(bounds), pa.py_buffer(np.ascontiguousarray(low[used])))
    return pieces, np.searchsorted(first, offsets)


def _is_cut_as_here(tokenizer) -> bool:
    """Whether a tokenizer has the settings above."""
    said = lambda part: json.loads(part.__getstate__()) if part is not None else {}
    cuts = said(tokenizer.pre_tokenizer).get("pretokenizers") or [{}]
    split = cuts[0].get("pattern") == {"Regex": _CUTS} and cuts[0].get("behavior") == "Removed" and cuts[0].get("invert") and [(c["type"], c.get("add_prefix_space"), c.get("use_regex")) for c in cuts[1:]] == [("ByteLevel", False, False)]
    special = all(t.content.startswith("<|") and t.special for t in tokenizer.get_added_tokens_decoder().values())
    model = type(tokenizer.model).__name__ == "BPE" and tokenizer.model.end_of_word_suffix == "</w>"
    return bool(said(tokenizer.normalizer) == _NORMAL and split and special and model)


class WordEncoder:
    """Encodes texts by a tokenizer, keeping the ids of pieces and words seen before.

    Where the tokenizer's file has the settings above, no token spans two of the pieces that its own pattern cuts.  Texts of
    characters up to U+00FF are cut into them here, a slice of texts at once.  Others are cut at white space into words.
    Texts with odd control characters or a special token's brackets, and all texts of another tokenizer, go to it whole.
    """

    def __init__(self, path: str, known: int = KNOWN, chars: int = KNOWN_CHARS):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, normalizers, pre_tokenizers

        self.path, self._tokenizer = path, None
        loaded = Tokenizer.from_file(path)
        size = loaded.get_vocab_size()
        self.dtype = np.dtype("<u2" if size <= 65536 else "<u4")
        self.cuttable = _is_cut_as_here(loaded)
        if self.cuttable:
            # for pieces, which are lowered and cut already; each comes once, so the model's own cache would only cost
            self.by_piece = loaded
            self.ends = np.array([(loaded.id_to_token(i) or "").endswith("</w>") for i in range(size)])
            loaded.normalizer = normalizers.Sequence([])
            loaded.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
            loaded.model._resize_cache(0)
        else:
            self._tokenizer = loaded
        self.limits = (known, chars)
        self._forget()

    @property
    def tokenizer(self):
        """The tokenizer as its file has it, for whole texts; not in memory before there is one."""
        if self._tokenizer is None:
            from tokenizers import Tokenizer

            self._tokenizer = Tokenizer.from_file(self.path)
        return self._tokenizer

    def _forget(self) -> None:
        self.pieces, self.words, self.chars = {}, {}, 0
        self.ids, self.used = np.zeros(1 << 16, self.dtype), 0
        self.starts, self.sizes = np.zeros(1 << 14, np.int64), np.zeros(1 << 14, np.int64)

    def _make_room(self, kind: str, wanted: list[str]) -> None:
        """Keeps what is known within its bounds: past them, only what is wanted now stays."""
        if len(self.pieces) + len(self.words) <= self.limits[0] and self.chars <= self.limits[1]:
            return
        table = getattr(self, kind)
        kept = [p for p in wanted if p in table]
        numbers = np.fromiter(map(table.__getitem__, kept), np.int64, len(kept))
        ids, sizes = self._gather(numbers, np.arange(len(kept) + 1))
        self._forget()
        self._keep(getattr(self, kind), kept, ids, sizes)

    def _keep(self, table: dict[str, int], keys: list[str], ids: np.ndarray, sizes: np.ndarray) -> None:
        """Enter keys whose ids stand one after the other in ``ids``."""
        at = len(self.pieces) + len(self.words)
        while at + len(keys) > len(self.starts):
            self.starts, self.sizes = (np.concatenate([x, np.zeros_like(x)]) for x in (self.starts, self.sizes))
        while self.used + len(ids) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
        self.ids[self.used : self.used + len(ids)] = ids
        self.starts[at : at + len(keys)] = self.used + np.cumsum(sizes) - sizes
        self.sizes[at : at + len(keys)] = sizes
        table.update(zip(keys, range(at, at + len(keys)), strict=True))
        self.used += len(ids)
        self.chars += sum(map(len, keys))

    def _whole(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        got = [np.array(e.ids, self.dtype) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        return np.concatenate([*got, np.zeros(0, self.dtype)]), np.array([len(g) for g in got], np.int64)

    def _learn(self, pieces: list[str]) -> None:
        """Many at once: each ends with its only token that closes a word."""
        for i in range(0, len(pieces), 1000):
            part = pieces[i : i + 1000]
            ids = np.array(self.by_piece.encode(" ".join(part), add_special_tokens=False).ids, self.dtype)
            cuts = np.flatnonzero(self.ends[ids]) + 1
            if len(cuts) == len(part) and cuts[-1] == len(ids):
                self._keep(self.pieces, part, ids, np.diff(cuts, prepend=0))
            else:
                self._keep(self.pieces, part, *self._whole(part))

    def _gather(self, numbers: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of known pieces one after the other, and how many each text has."""
        sizes = self.sizes[numbers]
        ends = np.concatenate([np.zeros(1, np.int64), np.cumsum(sizes)])
        ids = self.ids[np.repeat(self.starts[numbers] - ends[:-1], sizes) + np.arange(ends[-1])]
        return ids, np.diff(ends[first])

    def _by_pieces(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        pieces, first = cut_pieces(*buffers(texts))
        coded = pieces.dictionary_encode()
        distinct = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        self._make_room("pieces", distinct)
        self._learn([p for p in distinct if p not in self.pieces])
        numbers = np.fromiter(map(self.pieces.__getitem__, distinct), np.int64, len(distinct))
        return self._gather(numbers[coded.indices.to_numpy()], first)

    def _by_words(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        split = [t.split() for t in texts]
        distinct = set().union(*split)
        self._make_room("words", sorted(distinct))
        new = sorted(distinct - self.words.keys())
        if new:
            self._keep(self.words, new, *self._whole(new))
        sizes = np.array([0, *map(len, split)], np.int64)
        numbers = np.fromiter((self.words[w] for s in split for w in s), np.int64, int(sizes.sum()))
        return self._gather(numbers, np.cumsum(sizes))

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts one after the other, and how many each text has; a null counts as empty."""
        texts = texts.fill_null("")
        if not self.cuttable:
            return self._whole(texts.to_pylist())
        data, offsets = buffers(texts)
        # by the highest byte that a text holds, and whether it is odd
        high = np.maximum.reduceat(np.append(data, 0), offsets[:-1]) if len(texts) else np.zeros(0, np.uint8)
        wide = (high >= 0xC4) & (np.diff(offsets) > 0)
        odd = pa.compute.match_substring_regex(texts, _ODD.pattern).to_numpy(zero_copy_only=False)
        if not (wide | odd).any():
            return self._by_pieces(texts)
        kinds = [(~(wide | odd), self._by_pieces), (wide & ~odd, lambda x: self._by_words(x.to_pylist())), (odd, lambda x: self._whole(x.to_pylist()))]
        parts: list[np.ndarray] = [np.zeros(0, self.dtype)] * len(texts)
        for which, encode in kinds:
            at = np.flatnonzero(which)
            if len(at):
                ids, sizes = encode(texts.take(pa.array(at)))
                for i, part in zip(at.tolist(), np.split(ids, np.cumsum(sizes)[:-1]), strict=True):
                    parts[i] = part
        return np.concatenate(parts), np.array(list(map(len, parts)), np.int64)


_encoders: dict[str, WordEncoder] = {}


def encoder(path: str) -> WordEncoder:
    """One for all tasks of a worker process."""
    if path not in _encoders:
        _encoders[path] = WordEncoder(path)
    return _encoders[path]


# --- the file format ------------------------------------------------------------------------------------------------


def pack_block(ids: np.ndarray, mode: str, level: int) -> tuple[int, list[bytes]]:
    """Bytes per id, and the compressed planes; a plane of zeros only is left empty."""
    width = 2 if not len(ids) or int(ids.max()) < 65536 else 4
    cells = np.ascontiguousarray(ids.astype(f"<u{width}")).view(np.uint8).reshape(-1, width)
    if mode == "bit":
        planes = np.packbits(np.ascontiguousarray(np.unpackbits(cells, axis=1, bitorder="little").T), axis=1, bitorder="little")
    else:
        planes = np.ascontiguousarray(cells.T)
    packer = zstandard.ZstdCompressor(level=level)
    return width, [packer.compress(p.tobytes()) if p.any() else b"" for p in planes]


def unpack_block(planes: list[bytes], n: int, width: int, mode: str) -> np.ndarray:
    size = (n + 7) // 8 if mode == "bit" else n
    reader = zstandard.ZstdDecompressor()
    rows = np.stack([np.frombuffer(reader.decompress(p, max_output_size=size), np.uint8) if p else np.zeros(size, np.uint8) for p in planes]) if size else np.zeros((len(planes), 0), np.uint8)
    if mode == "bit":
        bits = np.unpackbits(rows, axis=1, count=n, bitorder="little")
        cells = np.packbits(np.ascontiguousarray(bits.T), axis=1, bitorder="little")
    else:
        cells = np.ascontiguousarray(rows.T)
    return cells.reshape(-1, width).view(f"<u{width}").reshape(-1).astype("<u4")


def write_token_file(doc_ids: list[int | None], ids: np.ndarray, lengths: np.ndarray, mode: str = "bit", block: int = BLOCK_IDS, level: int = 1) -> bytes:
    """``ids``: those of all documents one after the other, ``lengths`` of them in each."""
    body, chunks = [MAGIC], []
    at = len(MAGIC)
    for i in range(0, len(ids), block):
        part = ids[i : i + block]
        width, planes = pack_block(part, mode, level)
        chunks.append([at, len(part), width, [len(p) for p in planes]])
        body += planes
        at += sum(map(len, planes))
    keys = np.array([0 if d is None else d for d in doc_ids], "<i8")
    nulls = np.array([d is None for d in doc_ids], np.uint8)
    head = json.dumps({"mode": mode, "block": block, "chunks": chunks, "n_docs": len(doc_ids)}).encode()
    footer = zstandard.ZstdCompressor(level=3).compress(struct.pack("<q", len(head)) + head + keys.tobytes() + nulls.tobytes() + np.asarray(lengths, "<i8").tobytes())
    return b"".join([*body, footer, struct.pack("<q", len(footer)), MAGIC])


class TokenFile:
    """Reads a file's documents, or any one chunk, by the index at its end."""

    def __init__(self, path: str, size: int):
        self.path = path
        tail = read_range(path, size - 16, 16)
        if tail[8:] != MAGIC:
            raise ValueError(f"{path} is not a token file")
        (length,) = struct.unpack("<q", tail[:8])
        raw = zstandard.ZstdDecompressor().decompress(read_range(path, size - 16 - length, length))
        (n,) = struct.unpack("<q", raw[:8])
        head = json.loads(raw[8 : 8 + n])
        self.mode, self.chunks, docs = head["mode"], head["chunks"], head["n_docs"]
        at = 8 + n
        keys, nulls = np.frombuffer(raw, "<i8", docs, at), np.frombuffer(raw, np.uint8, docs, at + 8 * docs)
        self.doc_ids = [None if z else int(k) for k, z in zip(keys, nulls, strict=True)]
        self.lengths = np.frombuffer(raw, "<i8", docs, at + 9 * docs)

    def chunk(self, k: int) -> np.ndarray:
        at, n, width, sizes = self.chunks[k]
        raw, planes = read_range(self.path, at, sum(sizes)), []
        for s in sizes:
            planes.append(raw[:s])
            raw = raw[s:]
        return unpack_block(planes, n, width, self.mode)

    def documents(self) -> Iterator[tuple[int | None, np.ndarray]]:
        rest, k = np.zeros(0, "<u4"), 0
        for doc, n in zip(self.doc_ids, self.lengths.tolist(), strict=True):
            if len(rest) < n:
                parts, have = [rest], len(rest)
                while have < n:
                    parts.append(self.chunk(k))
                    have += len(parts[-1])
                    k += 1
                rest = np.concatenate(parts)
            yield doc, rest[:n]
            rest = rest[n:]


def slices(batches: Iterator[pa.RecordBatch], size: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about ``size`` bytes of text (column 1), and at least one row."""
    held, n = [], 0
    for b in batches:
        ends = np.cumsum(pa.compute.binary_length(b.column(1)).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64))
        at, base = 0, 0
        while at < len(b):
            to = int(np.searchsorted(ends, base + size - n, "right"))
            if to <= at and held:
                yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
                held, n = [], 0
                continue
            to = max(at + 1, to)
            held.append(b.slice(at, to - at))
            n += int(ends[to - 1]) - base
            at, base = to, int(ends[to - 1])
    if held:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


# --- the operator ---------------------------------------------------------------------------------------------------


def write_tokens(docs: DataFrame, folder: str, tokenizer_path: str, end_id: int = 2, mode: str = "bit", block: int = BLOCK_IDS, file_ids: int = FILE_IDS) -> DataFrame:
    """Encode ``docs`` (doc_id, text) into files below ``folder``, in ascending doc_id order; returns the stored manifest.

    Files follow each other by (part, seq).  A task that runs again writes files under other names, and only those
    that its manifest row names are ever read.
    """

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, part, seq, run = encoder(tokenizer_path), TaskContext.get().partitionId(), 0, uuid.uuid4().hex[:12]
        keys, held, lengths, n = [], [], [], 0

        def flush() -> pa.RecordBatch:
            nonlocal keys, held, lengths, n, seq
            path, data = f"{folder}/{part:06d}-{seq:05d}-{run}.tok", write_token_file(keys, np.concatenate(held), np.concatenate(lengths), mode, block)
            write_file(path, data)
            row = pa.RecordBatch.from_pylist([{"part": part, "seq": seq, "path": path, "size": len(data), "n_docs": len(keys), "n_ids": n}], schema=pa.schema([("part", pa.int32()), ("seq", pa.int32()), ("path", pa.string()), ("size", pa.int64()), ("n_docs", pa.int64()), ("n_ids", pa.int64())]))
            keys, held, lengths, n, seq = [], [], [], 0, seq + 1
            return row

        for b in slices(batches):
            ids, sizes = words.encode(b.column(1))
            keys += b.column(0).to_pylist()
            held.append(np.insert(ids.astype("<u4"), np.cumsum(sizes), end_id))
            lengths.append(sizes + 1)
            n += len(held[-1])
            if n >= file_ids:
                yield flush()
        if keys:
            yield flush()

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    with small_batches(docs.sparkSession):
        # the head of a text keeps the rows of one id (or of none) in order and lets them be many tasks
        return materialize(rows.repartitionByRange("doc_id", F.substring("text", 1, 64)).sortWithinPartitions("doc_id", "text").mapInArrow(write, MANIFEST), "token-manifest")


def read_tokens(manifest: DataFrame) -> DataFrame:
    """Decode the files of a manifest; per document its position in the whole stream, its length and a checksum of its ids."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in b.to_pylist():
                start, rows = r["base"], []
                for doc, ids in TokenFile(r["path"], r["size"]).documents():
                    rows.append((doc, start, len(ids), zlib.crc32(np.ascontiguousarray(ids))))
                    start += len(ids)
                cols = list(zip(*rows, strict=True)) or [[]] * 4
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], ["doc_id", "start", "n_tokens", "ids_crc32"])

    # the manifest has a row per file, so one window over it stays small
    order = Window.partitionBy(F.lit(0)).orderBy("part", "seq").rowsBetween(Window.unboundedPreceding, -1)
    based = manifest.withColumn("base", F.coalesce(F.sum("n_ids").over(order), F.lit(0)))
    files = max(1, manifest.count())
    return based.select("path", "size", "base").repartition(files).mapInArrow(read, RESULT)


def token_output(spark: SparkSession, docs: DataFrame, tokenizer_path: str, folder: str | None = None, **options) -> DataFrame:
    """Write and read back: doc_id, start, n_tokens, ids_crc32 of every document."""
    return read_tokens(write_tokens(docs, folder or scratch_path(spark, "tokens"), tokenizer_path, **options))


def op2_token_planes(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_output(spark, spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("word_bpe_49k.json"))
