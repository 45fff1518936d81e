"""Token ids in bit-plane shuffled, compressed blocks with a chunk index, written and read back."""

from __future__ import annotations

import json
import os
import re
import struct
import zlib
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lexiloom.llm.common import arrow_rows, shared_input, shared_output
from lexiloom.session import cut_lineage, scratch_path

MAGIC = b"TKPLANE1"
BLOCK_IDS = 65_536  # ids in a block; the last block of a file is shorter
LEVEL = 3
MANIFEST = "part int, file string, n_docs bigint, n_tokens bigint"


# ---- one block

def shuffle_block(ids: np.ndarray, unit: str = "byte") -> list[bytes]:
    """The planes of a block of unsigned 32-bit ids: one for each byte, or for each bit."""
    raw = np.ascontiguousarray(ids, dtype="<u4").view(np.uint8).reshape(-1, 4)
    if unit == "byte":
        return [np.ascontiguousarray(raw[:, b]).tobytes() for b in range(4)]
    bits = np.unpackbits(raw, axis=1, bitorder="little")
    return [np.packbits(bits[:, b], bitorder="little").tobytes() for b in range(32)]


def unshuffle_block(planes: list[bytes], n: int, unit: str = "byte") -> np.ndarray:
    if unit == "byte":
        return np.ascontiguousarray(np.stack([np.frombuffer(p, np.uint8) for p in planes], axis=1)).view("<u4").ravel()
    bits = np.stack([np.unpackbits(np.frombuffer(p, np.uint8), count=n, bitorder="little") for p in planes], axis=1)
    return np.packbits(bits, axis=1, bitorder="little").view("<u4").ravel()


# ---- one file: magic, blocks, index (JSON, compressed), index length, magic

class PlaneWriter:
    """Writes ids in blocks; holds one block and the index."""

    def __init__(self, stream, unit: str = "byte"):
        self.stream, self.unit, self.at = stream, unit, len(MAGIC)
        self.held, self.n_held, self.chunks, self.docs = [], 0, [], []
        self.pack = zstandard.ZstdCompressor(level=LEVEL).compress
        stream.write(MAGIC)

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self.docs.append((doc_id, len(ids)))
        while len(ids):
            take = ids[: BLOCK_IDS - self.n_held]
            self.held.append(take)
            self.n_held += len(take)
            ids = ids[len(take) :]
            if self.n_held == BLOCK_IDS:
                self._flush()

    def _flush(self) -> None:
        planes = [self.pack(p) for p in shuffle_block(np.concatenate(self.held), self.unit)]
        self.chunks.append({"at": self.at, "n": self.n_held, "planes": [len(p) for p in planes]})
        for p in planes:
            self.stream.write(p)
            self.at += len(p)
        self.held, self.n_held = [], 0

    def close(self) -> None:
        if self.n_held:
            self._flush()
        index = self.pack(json.dumps({"unit": self.unit, "chunks": self.chunks, "docs": self.docs}).encode())
        self.stream.write(index + struct.pack("<Q", len(index)) + MAGIC)


def read_planes(folder: str, name: str) -> Iterator[tuple[int | None, np.ndarray]]:
    """(doc_id, ids) of each document of a file, one block and one document in memory."""
    from lexiloom.llm.common import shared_fs

    filesystem, path = shared_fs(folder)
    with filesystem.open_input_file(f"{path}/{name}") as f:
        size = f.size()
        tail = f.read_at(8 + len(MAGIC), size - 8 - len(MAGIC))
        if tail[8:] != MAGIC:
            raise ValueError(f"{name} is not a token file, or is torn")
        (length,) = struct.unpack("<Q", tail[:8])
        unpack = zstandard.ZstdDecompressor().decompress
        index = json.loads(unpack(f.read_at(length, size - 8 - len(MAGIC) - length)))
    with shared_input(folder, name) as f:
        if f.read(len(MAGIC)) != MAGIC:
            raise ValueError(f"{name} is not a token file")

        def blocks():
            for c in index["chunks"]:
                yield unshuffle_block([unpack(f.read(n)) for n in c["planes"]], c["n"], index["unit"])

        stream, held = blocks(), np.zeros(0, "<u4")
        for doc_id, n in index["docs"]:
            pieces, need = [], n
            while need:
                if not len(held):
                    held = next(stream)
                pieces.append(held[:need])
                held = held[len(pieces[-1]) :]
                need -= len(pieces[-1])
            yield doc_id, np.concatenate(pieces) if pieces else np.zeros(0, "<u4")


# ---- tables

# Fixed value: how the word tokenizer cuts lower-cased text.
WORD_PATTERN = "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"
# The same for texts of the first 256 characters, which are composed already and have one lower case each.
LETTERS, NUMBERS, SPACES = "a-zªµºß-öø-ÿ", "0-9²³¹¼½¾", "\t-\r \x85\xa0"
SPACE, LETTER, NUMBER, OTHER = range(4)
KINDS = np.array([next((k for k, those in enumerate((SPACES, LETTERS, NUMBERS)) if re.match(f"[{those}]", chr(c))), OTHER) for c in range(256)], np.uint8)
TEXTS_AT_ONCE = 1 << 21  # characters of the texts that are cut at once, of which a longer text has its own
LONGEST_KEPT = 64  # characters of a word that is remembered


def byte_letters() -> dict[int, str]:
    """The character that stands for each byte: itself if it is printable, else the next one from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


def word_starts(raw: np.ndarray) -> np.ndarray:
    """Where words and runs of spaces begin in lower-cased Latin-1 characters that end with two line ends."""
    kind = KINDS[raw]
    first = np.ones(len(raw), bool)
    first[1:] = (kind[1:] != kind[:-1]) | (kind[1:] == NUMBER)
    # 's 't 'm 'd 're 've 'll are words where the quote does not follow another mark
    quote = np.flatnonzero((raw == ord("'")) & first)
    a, b = raw[quote + 1], raw[quote + 2]
    short = np.isin(a, list(b"stmd"))
    long = (np.isin(a, list(b"rv")) & (b == ord("e"))) | ((a == ord("l")) & (b == ord("l")))
    first[quote[short | long] + 1] = False
    first[quote[short] + 2] = first[quote[long] + 3] = True
    return np.flatnonzero(first)


class Remembered(dict):
    """What ``make`` gives for a key. Of ``most`` values and the ``most`` before them those are kept;
    one of the older that is asked for is new again, so that frequent keys stay."""

    def __init__(self, make: Callable[[bytes], bytes], most: int):
        self.make, self.most, self.older = make, most, {}

    def __missing__(self, key: bytes) -> bytes:
        value = self.older.get(key)
        if value is None:
            value = self.make(key)
        if len(key) <= LONGEST_KEPT:
            if len(self) >= self.most:
                self.older = dict(self)
                self.clear()
            self[key] = value
        return value


class WordEncoder:
    """Ids of whole texts, as little-endian 32-bit bytes, equal to those of the tokenizer file's library.

    Texts of Latin letters are cut into words as the tokenizer does, many at once, and each distinct word's
    ids are looked up once; the library's model is asked for new words, of which twice ``remembered`` at most
    are kept. Other texts, texts that hold a special token's string, and other kinds of tokenizers go to the
    library whole.
    """

    def __init__(self, tokenizer_file: str, remembered: int = 100_000):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer, self.known = Tokenizer.from_file(tokenizer_file), Remembered(self._word, remembered)
        kind = json.loads(self.tokenizer.to_str())
        steps = [n["type"] for n in (kind["normalizer"] or {}).get("normalizers", [])]
        cut = ((kind["pre_tokenizer"] or {}).get("pretokenizers") or [{}])[0].get("pattern", {}).get("Regex")
        self.by_words = steps == ["NFC", "Replace", "Lowercase"] and cut == WORD_PATTERN
        self.special = [t["content"] for t in kind["added_tokens"]]
        self.model, self.letters = self.tokenizer.model, byte_letters()

    def __call__(self, text: str) -> bytes:
        return self.many([text])[0].tobytes()

    def many(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text."""
        out: list = [None] * len(texts)
        latin = []
        for i, text in enumerate(texts):
            if not self.by_words or not self._latin(text) or any(s in text for s in self.special):
                out[i] = np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4")
            else:
                latin.append(i)
        for i, ids in zip(latin, self._by_words([texts[i].lower() for i in latin]), strict=True):
            out[i] = ids
        return out

    def _by_words(self, texts: list[str]) -> list[np.ndarray]:
        raw = np.frombuffer("\n".join([*texts, "\n"]).encode("latin-1"), np.uint8)
        starts = word_starts(raw)
        places = pa.py_buffer(np.append(starts, len(raw)).astype(np.int64))
        words = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts), [None, places, pa.py_buffer(raw)]).dictionary_encode()
        pieces = list(map(self.known.__getitem__, words.dictionary.to_numpy(zero_copy_only=False)))
        ids, sizes, code = np.frombuffer(b"".join(pieces), "<u4"), np.fromiter(map(len, pieces), np.int64, len(pieces)) // 4, words.indices.to_numpy()
        n = sizes[code]
        upto = np.cumsum(n)
        found = ids[np.arange(n.sum()) + np.repeat((np.cumsum(sizes) - sizes)[code] - (upto - n), n)]
        # a run of spaces may hold the line end between two texts and gives no ids
        ends = np.cumsum([len(t) + 1 for t in texts], dtype=np.int64)
        cuts = np.concatenate([[0], upto])[np.searchsorted(starts, ends)]
        return [found[x:y] for x, y in zip([0, *cuts], cuts)]

    def _word(self, word: bytes) -> bytes:
        if KINDS[word[0]] == SPACE:
            return b""
        text = word.decode("latin-1")
        spelled = text if text.isascii() and text.isprintable() else "".join(map(self.letters.__getitem__, text.encode()))
        ids = [t.id for t in self.model.tokenize(spelled)]
        return struct.pack(f"<{len(ids)}I", *ids)

    @staticmethod
    def _latin(text: str) -> bool:
        try:
            return text.isascii() or bool(text.encode("latin-1"))
        except UnicodeEncodeError:
            return False


@lru_cache(maxsize=1)
def word_encoder(tokenizer_file: str) -> WordEncoder:
    """One encoder for all tasks that a Python worker runs."""
    return WordEncoder(tokenizer_file)


def _together(rows: Iterable[tuple[int | None, str | None]], characters: int = TEXTS_AT_ONCE) -> Iterator[list[tuple[int | None, str]]]:
    """Rows in lists of at most so many characters, or of one row."""
    held, size = [], 0
    for id_, text in rows:
        text = text or ""
        if held and size + len(text) + 1 > characters:
            yield held
            held, size = [], 0
        held.append((id_, text))
        size += len(text) + 1
    if held:
        yield held


def write_token_files(docs: DataFrame, tokenizer_file: str, folder: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = 1, unit: str = "byte") -> DataFrame:
    """Encode every text and write its ids and ``end_id`` in ascending order of id; returns the manifest.

    Rows are dealt by ranges of id, one file each; the manifest (part, file, n_docs, n_tokens)
    names the complete files in order, so an attempt that was lost is never read.
    """
    rows = docs.select(F.col(f"`{id_col}`").cast("bigint").alias("id"), F.col(f"`{text_col}`").alias("text"))
    ranged = rows.repartitionByRange(F.col("id").asc_nulls_first()).sortWithinPartitions(F.col("id").asc_nulls_first(), F.xxhash64("text"))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import uuid

        from pyspark import TaskContext

        part, end, tokens = TaskContext.get().partitionId(), np.array([end_id], dtype="<u4"), 0
        name = f"part-{part:06d}-{uuid.uuid4().hex}.tok"
        rows = arrow_rows(batches, "id", "text")
        first = next(rows, None)
        if first is None:
            return
        encoder = word_encoder(tokenizer_file)
        with shared_output(folder, name) as stream:
            writer = PlaneWriter(stream, unit)
            for some in _together(r for source in ([first], rows) for r in source):
                for (id_, _), ids in zip(some, encoder.many([text for _, text in some]), strict=True):
                    tokens += len(ids) + 1
                    writer.add(id_, np.append(ids, end))
            writer.close()
        yield pa.RecordBatch.from_pydict({
            "part": pa.array([part], pa.int32()), "file": [name], "n_docs": pa.array([len(writer.docs)], pa.int64()), "n_tokens": pa.array([tokens], pa.int64())})

    return cut_lineage(ranged.mapInArrow(write, MANIFEST), "manifest")


def read_token_files(manifest: DataFrame, folder: str, id_col: str = "doc_id") -> DataFrame:
    """(id, start, n_tokens, ids_crc32) of every document, from the files.

    ``start`` counts the ids of all documents before it: sums of the manifest, a row per file,
    and of the documents of its own file.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, file, before in arrow_rows(batches, "part", "file", "before"):
            held = []
            at = before
            for id_, ids in read_planes(folder, file):
                held.append((id_, at, len(ids), zlib.crc32(ids.astype("<u4").tobytes())))
                at += len(ids)
                if len(held) == 10_000:
                    yield _columns(held)
                    held = []
            if held:
                yield _columns(held)

    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    files = manifest.select("part", "file", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)).alias("before"))
    files = cut_lineage(files, "files")
    n = max(1, files.count())
    return files.repartitionByRange(n, "part").mapInArrow(read, f"{id_col} bigint, start bigint, n_tokens bigint, ids_crc32 bigint".replace(id_col, "id", 1)).withColumnRenamed("id", id_col)


def _columns(rows: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], names=["id", "start", "n_tokens", "ids_crc32"])


def token_files(docs: DataFrame, tokenizer_file: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = 1) -> DataFrame:
    """Write the token files of a table to the shared folder and read them back.

    Cases. A null or empty text is its end id alone. Null ids come first; rows of one id
    are ordered by a hash of their text and all kept. An empty table writes no file and gives
    no rows. Other columns are not read.
    """
    folder = scratch_path(docs.sparkSession, "tokens")
    return read_token_files(write_token_files(docs, tokenizer_file, folder, id_col, text_col, end_id), folder, id_col)
