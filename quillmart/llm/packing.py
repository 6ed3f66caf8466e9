"""Bounded-space online best-fit packing of tokenised documents."""

from __future__ import annotations

import json
import os
import re
import struct
import zlib
from collections.abc import Iterator
from urllib.parse import unquote

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A blank is safe to cut before if this follows: it begins a token of its own, together with the blank.
_SAFE = re.compile(r"[!-~\w]")
_CUT = re.compile(r"(?= [!-~\w])")
#: Words that are remembered, at some 200 bytes each; workers keep them for later stages.
_MOST_KNOWN = 250_000
#: Bytes of text that are encoded at a time; fewer in the order of a mix, where workers of earlier stages still hold memory.
_PORTION, _PORTION_IN_ORDER = 8 << 20, 2 << 20
_tokenizers: dict[tuple[str, int], Encoder] = {}


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


# The public pattern of words of byte-level vocabularies.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Up to here all versions of Unicode agree on what letters and digits are.
_LATIN_END = "\u0250"


def ranked(tokenizer):
    """The same vocabulary by ranks, which encodes words faster; None where ids are not in the order of merges."""
    import tiktoken

    known = json.loads(tokenizer.to_str())
    vocabulary, before = tokenizer.get_vocab(with_added_tokens=False), known["pre_tokenizer"] or {}
    plain = before.get("type") == "ByteLevel" and before.get("use_regex", True) and not before.get("add_prefix_space")
    merged = [x if isinstance(x, list) else x.split(" ") for x in known["model"].get("merges", [])]
    if not plain or known["normalizer"] or any(vocabulary.get(a + b) != 256 + i for i, (a, b) in enumerate(merged)):
        return None
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    byte = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(sorted(set(range(256)) - set(shown)))}
    ranks = {bytes(byte[c] for c in x): i for x, i in vocabulary.items() if i < 256 + len(merged)}
    return tiktoken.Encoding("ranked", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


class Encoder:
    """Ids of whole texts, with an end id after each.

    The byte-level vocabulary never joins a word to the one before it, so a text is cut before blanks that are
    followed by a printable character. The same vocabulary by ranks encodes words of Latin script. Arrow cuts a portion of texts at once and numbers its distinct words; each is
    encoded once and remembered (words are forgotten when there are too many). Texts with a blank that is not safe
    are cut one by one.
    """

    def __init__(self, path: str, end_id: int = 2):
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer, self.end = Tokenizer.from_file(path), struct.pack("<I", end_id)
        self.ranked = ranked(self.tokenizer)
        self.line = self.tokenizer.encode("\n", add_special_tokens=False).ids[0]
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.known: dict[str, bytes] = {}

    def _lines(self, words: list[str]) -> Iterator[bytes]:
        """Ids of words that begin with their only white space, many to a line each in one call.

        A line's end before a blank is a token of its own, so it tells the words' ids apart.
        """
        for at in range(0, len(words), 2000):
            part = words[at : at + 2000]
            ids = np.array(self.ranked.encode_ordinary("\n".join(part)), "<u4")
            ends = np.flatnonzero(ids == self.line).tolist()
            raw = ids.tobytes()
            yield from (raw[4 * a : 4 * b] for a, b in zip([0, *(x + 1 for x in ends)], [*ends, len(ids)], strict=True))

    def _words(self, words: list[str]) -> list[bytes]:
        known = self.known
        if len(known) > _MOST_KNOWN:
            known.clear()
        new, plain, other = [x for x in dict.fromkeys(words) if x not in known], [], []
        for x in new:
            if self.ranked is None or not (x.isascii() or max(x) < _LATIN_END) or any(t in x for t in self.added):
                other.append(x)
            elif x[:1] == " " and x.split() == [x[1:]]:
                plain.append(x)
            else:
                known[x] = np.array(self.ranked.encode_ordinary(x), "<u4").tobytes()
        known.update(zip(plain, self._lines(plain), strict=True))
        for at in range(0, len(other), 2000):
            part = other[at : at + 2000]
            for x, e in zip(part, self.tokenizer.encode_batch_fast(part, add_special_tokens=False), strict=True):
                known[x] = np.array(e.ids, "<u4").tobytes()
        return [known[x] for x in words]

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids one after another, and where the next text begins, for each text (not null)."""
        if not len(texts):
            return np.zeros(0, np.uint32), np.zeros(0, np.int64)
        parts = pc.split_pattern(texts, " ")
        offsets = parts.offsets.to_numpy().astype(np.int64)
        coded = parts.values.slice(offsets[0], offsets[-1] - offsets[0]).dictionary_encode()
        offsets = offsets - offsets[0]
        # places of words and ids fit in 32 bits, as an Arrow text has fewer bytes than that
        unit, distinct = coded.indices.to_numpy().astype(np.int32), coded.dictionary.to_pylist()
        del parts, coded
        n, first = len(texts), offsets[:-1]
        unsafe = np.array([_SAFE.match(x) is None for x in distinct])[unit]
        unsafe[first] = False
        odd = np.flatnonzero(np.add.reduceat(unsafe, first)) if unsafe.any() else np.zeros(0, np.int64)

        # units: distinct words after a blank, what each text begins with, and the end id
        begin = self._words([distinct[i] for i in unit[first]])
        whole = texts.take(pa.array(odd)).to_pylist()
        for i, text in zip(odd.tolist(), whole, strict=True):
            begin[i] = b"".join(self._words(_CUT.split(text)))
        rest = np.ones(len(unit), bool)
        for i in odd:
            rest[offsets[i] + 1 : offsets[i + 1]] = False
        unit[first] = len(distinct) + np.arange(n)
        last = np.cumsum(np.add.reduceat(rest, first, dtype=np.int64))
        unit = np.insert(unit[rest], last, len(distinct) + n)

        table = [*self._words([" " + x for x in distinct]), *begin, self.end]
        sizes = np.fromiter(map(len, table), np.int32, len(table)) // 4
        flat, at = np.frombuffer(b"".join(table), "<u4"), np.cumsum(sizes, dtype=np.int32) - sizes
        size = sizes[unit]
        ends = np.cumsum(size, dtype=np.int32)
        taken = np.repeat(at[unit] - (ends - size), size)
        taken += np.arange(len(taken), dtype=np.int32)
        return flat[taken], ends[last + np.arange(n)].astype(np.int64)


def portions(batch: pa.RecordBatch, size: int = _PORTION) -> Iterator[pa.RecordBatch]:
    """Runs of rows with about ``size`` bytes of text, one row at least."""
    turn = np.cumsum(pc.binary_length(batch["text"]).to_numpy(zero_copy_only=False).astype(np.int64)) // size
    cuts = [0, *(np.flatnonzero(np.diff(turn)) + 1).tolist(), batch.num_rows]
    yield from (batch.slice(a, b - a) for a, b in zip(cuts, cuts[1:], strict=False) if b > a)


def pieces_of(length: int, room: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of a document; only longer ones than ``room`` are cut, the first may be shorter."""
    first = (length - 1) % room + 1
    return [(0, first)] + [(at, room) for at in range(first, length, room)]


class BestFit:
    """Online best fit over a fixed number of open bins.

    Open bins are kept by free space, and a bitset has bit f set while a bin with f free is open: the lowest bit from
    the item's length up is the best fit. When one bin too many is open, the fullest, the lowest bit, closes.
    """

    def __init__(self, room: int, most_open: int):
        self.room, self.most_open = room, most_open
        self.free: list[list[int]] = [[] for _ in range(room + 1)]
        self.bits = self.open = self.made = 0

    def _take(self, f: int) -> int:
        b = self.free[f].pop()
        self.open -= 1
        if not self.free[f]:
            self.bits &= ~(1 << f)
        return b

    def put(self, length: int) -> tuple[int, int]:
        """(bin, place in it) of the next item; a length of 0 to ``room``."""
        fits = self.bits >> length
        if fits:
            f = length + (fits & -fits).bit_length() - 1
            b = self._take(f)
        else:
            f, b = self.room, self.made
            self.made += 1
        left = f - length
        if left:
            self.free[left].append(b)
            self.bits |= 1 << left
            self.open += 1
            if self.open > self.most_open:
                self._take((self.bits & -self.bits).bit_length() - 1)
        return b, self.room - f


#: Bits of a sequence's name for the row that opens it in its file, and for how many that row opened before.
_ROW_BITS, _NTH_BITS = 26, 18


class InOrder:
    """Best fit in arrival order, by bins that are named after file, row of the file, and turn within that row.

    Names rise with the order of opening, whichever task packs a file. A run of rows without a gap has its own bins.
    """

    def __init__(self, room: int, most_open: int):
        self.room, self.most_open, self.at = room, most_open, (-1, -1)

    def put(self, file: int, row: int, length: int) -> tuple[int, int]:
        if (file, row) != self.at:
            if (file, row - 1) != self.at:
                self.bins, self.names = BestFit(self.room, self.most_open), []
            self.at, self.nth = (file, row), 0
        b, place = self.bins.put(length)
        if b == len(self.names):
            if row >> _ROW_BITS or self.nth >> _NTH_BITS:
                raise ValueError("too many rows in a file, or sequences of a row, to name them in order")
            self.names.append((file << _ROW_BITS | row) << _NTH_BITS | self.nth)
            self.nth += 1
        return self.names[b], place


_PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"


def _pack(path: str, room: int, end_id: int, most_open: int, with_ids: bool, files: dict[str, int] | None = None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _tokenizers.get((path, end_id)) or _tokenizers.setdefault((path, end_id), Encoder(path, end_id))
        bins, base = BestFit(room, most_open), TaskContext.get().partitionId() << 32
        ordered, portion = InOrder(room, most_open), _PORTION if files is None else _PORTION_IN_ORDER
        pa.default_memory_pool().release_unused()
        for whole in batches:
            rows: list[tuple] = []
            for batch in portions(whole, portion):
                ids, ends = encoder.encode(batch["text"])
                raw, begin = memoryview(ids.astype("<u4", copy=False)).cast("B"), 0
                for doc, end in zip(batch["doc_id"].to_pylist(), ends.tolist(), strict=True):
                    for i, (start, length) in enumerate(pieces_of(end - begin, room)):
                        piece = raw[4 * (begin + start) : 4 * (begin + start + length)]
                        rows.append((doc, i, start, length, zlib.crc32(piece), bytes(piece) if with_ids else b""))
                    begin = end
            if files is None:
                rows.sort(key=lambda r: -r[3])
                places = [(base + b, x) for b, x in (bins.put(r[3]) for r in rows)]
            else:
                came = zip(whole["_file"].to_pylist(), whole["_row"].to_pylist(), strict=True)
                # the first piece of a row is numbered 0
                places = []
                for r in rows:
                    if r[1] == 0:
                        name, row = next(came)
                    places.append(ordered.put(files[name], row, r[3]))
            columns = [*zip(*rows, strict=True)] or [()] * 6
            arrays = [pa.array(x, t) for x, t in zip(columns, (pa.int64(), pa.int32(), *[pa.int64()] * 3), strict=False)]
            arrays += [pa.array([b for b, _ in places], pa.int64()), pa.array([x for _, x in places], pa.int64())]
            names = ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
            if with_ids:
                arrays.append(pa.array([struct.unpack(f"<{len(x) // 4}i", x) for x in columns[5]], pa.list_(pa.int32())))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(arrays, names=names)

    return run


def pack_documents(documents: DataFrame, tokenizer: str | None = None, room: int = 1024, end_id: int = 2, most_open: int = 1024, with_ids: bool = False, in_order: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset of every piece (and its ids, if asked for).

    Every input partition is packed as it streams by, an Arrow batch at a time, with a fixed number of open bins and
    no shuffle; longer pieces of a batch go first, which leaves less room unused. Sequences never span partitions, which costs less than ``most_open`` half-filled bins each at
    most, and a lost task is simply run again. Documents longer than ``room`` are cut, the first piece taking what is
    over, so all their other pieces fill a sequence.

    With ``in_order``, for a table just read from files whose rows are in a wanted order, pieces are placed as they
    come, none before the pieces of earlier rows, and each file has its own sequences: in the order of sequence_id they
    were opened in the order of files and rows. A piece may still go to any open sequence, so the order of the rows
    holds up to ``most_open`` sequences. Files are put in order by name, as Spark's writer numbers them.

    ``tokenizer`` is the file of a byte-level vocabulary that executors can read; the public 50k one if left out.
    Null and empty texts are the end id alone. Rows with equal or null ids are packed each by itself. An empty table
    gives no rows; columns other than doc_id and text are ignored.
    """
    schema = _PIECES + (", ids array<int>" if with_ids else "")
    texts, files = [F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")], None
    if in_order:
        read = documents.metadataColumn("_metadata")
        texts += [read["file_name"].alias("_file"), read["row_index"].alias("_row")]
        names = sorted({unquote(x.rsplit("/", 1)[-1]) for x in documents.inputFiles()}, key=lambda x: (len(x), x))
        files = {x: i for i, x in enumerate(names)}
    return documents.select(*texts).mapInArrow(_pack(tokenizer or default_tokenizer(), room, end_id, most_open, with_ids, files), schema)
