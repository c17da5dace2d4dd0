"""Packing of documents into sequences by harmonic classes."""

from __future__ import annotations

import re
import sys
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftgraph.llm.common import Scratch, lean, prepared

CAPACITY = 2048
END_ID = 1
#: Sequences of a task are numbered from its own number, times two to the power of this.
_TASK_BITS = 36
#: Words kept with their ids at most.
_KNOWN_WORDS = 1_000_000


def vocabulary() -> str:
    """Where the tokenizer's file is."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class WordIds(dict):
    """Word -> its ids as little-endian 32-bit bytes, filled as words are met.

    The tokenizer drops white space and never joins over it, so a text's ids are
    its words' ids one after another. Words of plain letters, digits and ASCII
    signs go straight to the merges; all others go through the tokenizer whole.
    """

    #: The tokenizer's own split of a word into pieces, for the letters that go straight to the merges.
    _SPLIT = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^a-zß-öø-ÿ0-9]+")
    _PLAIN = re.compile(r"[!-~À-ÖØ-öø-ÿ]+")

    def __init__(self, path: str):
        import json

        import tiktoken
        from tokenizers import Tokenizer

        super().__init__()
        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as file:
            model = json.load(file)["model"]
        self.merges = None
        try:
            self.merges = self._merges(tiktoken, model)
        except (ValueError, KeyError):
            pass

    @staticmethod
    def _merges(tiktoken, model: dict):  # noqa: ANN001, ANN205
        """The vocabulary as ranked byte strings, if the order of its ids is the order of its merges; a word's end is byte 255, which UTF-8 doesn't use."""
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        shown = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(x for x in range(256) if x not in plain)}
        end = model["end_of_word_suffix"]

        def raw(token: str) -> bytes:
            ends = token.endswith(end)
            return bytes(shown[c] for c in (token[: -len(end)] if ends else token)) + b"\xff" * ends

        vocab = model["vocab"]
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        made = [vocab[a + b] for a, b in pairs]
        if made != sorted(set(made)):
            raise ValueError("merges and ids are ordered differently")
        ranks = {raw(t): i for t, i in vocab.items() if not t.startswith("<|")}
        ranks[b"\xff"] = max(vocab.values()) + 1
        return tiktoken.Encoding("words", pat_str=r"\S+", mergeable_ranks=ranks, special_tokens={})._core_bpe

    def __missing__(self, word: str) -> bytes:
        if len(self) > _KNOWN_WORDS:
            self.clear()
        if self.merges is not None and self._PLAIN.fullmatch(word) and "<|" not in word:
            text = word.lower()
            if text.isalpha():
                ids = self.merges.encode_single_piece(text.encode() + b"\xff")
            else:
                ids = [i for piece in self._SPLIT.findall(text) for i in self.merges.encode_single_piece(piece.encode() + b"\xff")]
        else:
            ids = self.tokenizer.encode(word, add_special_tokens=False).ids
        found = self[word] = self._packed(ids)
        return found

    @staticmethod
    def _packed(ids: list[int]) -> bytes:
        return array("I", ids).tobytes() if sys.byteorder == "little" else np.array(ids, "<u4").tobytes()

    def ids(self, text: str) -> bytes:
        if any(c in text for c in "\x1c\x1d\x1e\x1f"):  # white space to Python alone
            return self._packed(self.tokenizer.encode(text, add_special_tokens=False).ids)
        return b"".join(map(self.__getitem__, text.split()))


def filled(lengths: np.ndarray, capacity: int = CAPACITY) -> tuple[np.ndarray, ...]:
    """(document, start, length, sequence, offset) of the pieces of documents of these lengths, the sequences all full, or a power of two long.

    Harmonic packing: what is left of a document after whole sequences has class
    k if k of its length fit, but not k + 1. The longest go first; a bin of class
    k takes k of them, whole. Its left space is filled from the shortest, which
    are cut where it ends. If the last bin can't be filled, its pieces go to
    sequences of the powers of two that make up their sum.
    """
    doc, start, size, seq, offset = ([] for _ in range(5))

    def put(d: int, s: int, n: int, q: int, o: int) -> None:
        doc.append(d)
        start.append(s)
        size.append(n)
        seq.append(q)
        offset.append(o)

    number = 0
    for d in np.flatnonzero(lengths >= capacity).tolist():
        for s in range(0, int(lengths[d]) // capacity * capacity, capacity):
            put(d, s, capacity, number, 0)
            number += 1
    rest = lengths % capacity
    items = np.argsort(-rest, kind="stable")
    items = items[rest[items] > 0].tolist()
    begin, left = (lengths - rest).tolist(), rest.tolist()
    i, j = 0, len(items) - 1
    while i <= j:
        held, k, used = [], capacity // left[items[i]], 0
        for _ in range(k):
            if i > j or (d := items[i], capacity // left[d])[1] != k:
                break
            held.append((d, begin[d], left[d]))
            used += left[d]
            i += 1
        while used < capacity and i <= j:
            d = items[j]
            n = min(capacity - used, left[d])
            held.append((d, begin[d], n))
            begin[d], left[d], used = begin[d] + n, left[d] - n, used + n
            j -= not left[d]
        o, room = 0, capacity
        if used < capacity:
            room = 1 << used.bit_length() - 1
        for d, s, n in held:
            while n:
                if o == room:
                    used, o, number = used - room, 0, number + 1
                    room = 1 << used.bit_length() - 1
                part = min(n, room - o)
                put(d, s, part, number, o)
                s, n, o = s + part, n - part, o + part
        number += 1
    return tuple(np.array(x, np.int64) for x in (doc, start, size, seq, offset))


def pack(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", path: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """Pieces (id, start, length, ids_crc32, doc_tokens) with their sequence_id and the offset there; every sequence is full or its length is a power of two.

    Each Arrow batch of documents is tokenized and packed by filled() on its own,
    so nothing is shuffled: batches hold thousands of documents, and only what is
    left of each goes to shorter sequences, which need no padding either. Null and
    empty texts are the end id alone; a null id stays null; rows that repeat are
    packed each; a very long text is packed as any other; other columns are
    dropped, whatever their names. An empty table gives an empty table.
    """
    if capacity < 1 or capacity & (capacity - 1):
        raise ValueError("capacity must be a power of two")
    scratch = Scratch(prepared(docs.sparkSession), "packing")
    names = [id_column, "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    end, path = np.array([END_ID], "<u4").tobytes(), path or vocabulary()

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, number = WordIds(path), TaskContext.get().partitionId() << _TASK_BITS
        for batch in batches:
            if not batch.num_rows:
                continue
            ids = [memoryview(words.ids(text or "") + end) for text in batch.column(1).to_pylist()]
            lengths = np.array([len(x) // 4 for x in ids], np.int64)
            doc, start, size, seq, offset = filled(lengths, capacity)
            crc = [zlib.crc32(ids[d][4 * s : 4 * (s + n)]) for d, s, n in zip(doc.tolist(), start.tolist(), size.tolist())]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(doc)), *(pa.array(x, pa.int64()) for x in (start, size, crc, lengths[doc], seq + number, offset))], names)
            number += int(seq[-1]) + 1

    pieces = docs.select(F.col(id_column).cast("long").alias(id_column), text_column).mapInArrow(run, ", ".join(f"`{n}` long" for n in names))
    return scratch.stored(pieces)  # a task that is run again, on other batches, would number its sequences anew
