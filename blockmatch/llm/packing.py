"""Packing: documents put end to end and cut into sequences of fixed length.

Pass one tokenises every document, appends the end id and writes the ids with
the document's offset inside its partition.  The totals of the partitions, one
number each, are prefix-summed to partition offsets; adding the two gives every
document's place in one endless row of ids.  Pass two cuts that row into windows
of ``length`` ids: a document that crosses a window's edge gives one piece per
window it touches, and the pieces that touch an edge are marked
(``continued`` / ``continues``).  Only the last sequence can need padding.  The
written table fixes partitions and offsets, so a lost executor's tasks can run
again.  Memory is bounded by a batch of documents (one document, if huge).

Defined results: a null text counts as empty and yields the end id alone; null
ids and repeated rows are documents like any other; an empty table gives no
pieces; only the id and text columns are read, so others may have any name.
"""

from __future__ import annotations

import json
from array import array
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from blockmatch.llm import caches
from blockmatch.llm.textarrays import pieces
from blockmatch.storage import materialise

LENGTH = 2048
END = 1
#: Words, and as many pre-tokens, whose ids one worker remembers at most (some 110 MB together); beyond it, the memory starts anew.
REMEMBERED = 400_000

_encoders: dict[str, Encoder] = {}
caches.register("packing", _encoders.clear)


def _byte_letters() -> dict[int, str]:
    """Byte-level vocabularies write each byte as a letter: printable Latin-1 as itself, the rest in order from U+0100."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    rest = (b for b in range(256) if b not in plain)
    return {b: chr(b) for b in plain} | {b: chr(0x100 + i) for i, b in enumerate(rest)}


class _Remembered(dict):
    """Ids by text; what is missing is made once."""

    def __init__(self, make: Callable[[str], bytes]) -> None:
        super().__init__()
        self.make = make

    def __missing__(self, text: str) -> bytes:
        if len(self) >= REMEMBERED:
            self.clear()
        ids = self[text] = self.make(text)
        return ids


class Encoder:
    """Ids of texts by a vocabulary file of the tokenizers library.

    Where the file's normaliser and pre-tokeniser are known never to join what
    white space parts, ids are looked up word by word.  A new word of Latin
    letters is pre-tokenised by the file's own pattern and its pre-tokens go to
    the library's BPE model; any other new word goes to the library whole.
    Texts with control separators (U+001C to U+001F), which Python but not the
    library counts as white space, texts that may hold a special token's string,
    and all texts under other vocabulary files, are encoded by the library as
    they are.
    """

    def __init__(self, path: str, literal_specials: bool = False) -> None:
        import regex
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.tokenizer.encode_special_tokens = literal_specials
        self.dtype = np.uint32 if self.tokenizer.get_vocab_size(True) > 1 << 16 else np.uint16
        parts = json.loads(self.tokenizer.to_str())
        steps = [x["type"] for x in (parts["normalizer"] or {}).get("normalizers", [])]
        cuts = (parts["pre_tokenizer"] or {}).get("pretokenizers", [])
        added = [] if literal_specials else self.tokenizer.get_added_tokens_decoder().values()
        self.whole_if = [*"\x1c\x1d\x1e\x1f", *(t.content for t in added)]
        self.by_word = (
            not any(t.normalized for t in added)
            and steps == ["NFC", "Replace", "Lowercase"]
            and parts["normalizer"]["normalizers"][1]["pattern"] == {"Regex": r"\s+"}
            and [x["type"] for x in cuts] == ["Split", "ByteLevel"]
            and cuts[0]["behavior"] == "Removed"
            and cuts[0]["invert"]
            and not cuts[1]["add_prefix_space"]
            and not cuts[1]["use_regex"]
            and parts["model"]["type"] == "BPE"
        )
        if self.by_word:
            self._pattern = regex.compile(cuts[0]["pattern"]["Regex"])
            self._letters = _byte_letters()
            self._bpe = self.tokenizer.model
            self._letters_alone = "|[\\p{L}]+|" in self._pattern.pattern
            self._pretokens = _Remembered(self._pretoken)
            self._words = _Remembered(self._word)

    def _whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, self.dtype).tobytes()

    def _pretoken(self, text: str) -> bytes:
        tokens = self._bpe.tokenize(text if text.isascii() else text.encode().decode("latin-1").translate(self._letters))
        return array("I" if self.dtype is np.uint32 else "H", [x.id for x in tokens]).tobytes()

    def _word(self, word: str) -> bytes:
        if not word.isascii() and max(word) >= "\u0300":
            return self._whole(word)
        low = word.lower()
        if self._letters_alone and low.isalpha():  # one pre-token
            return self._pretokens[low]
        return b"".join(map(self._pretokens.__getitem__, self._pattern.findall(low)))

    def encode(self, texts: Iterable[str | None]) -> list[bytes]:
        """Little-endian ids of each text."""
        out = []
        for text in texts:
            if not text:
                out.append(b"")
            elif not self.by_word or any(c in text for c in self.whole_if):
                out.append(self._whole(text))
            else:
                out.append(b"".join(map(self._words.__getitem__, text.split())))
        return out


def encoder(path: str, literal_specials: bool) -> Encoder:
    key = f"{literal_specials}:{path}"
    if key not in _encoders:
        _encoders[key] = Encoder(path, literal_specials)
    return _encoders[key]


def _tokenise(path: str, end: int, literal_specials: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        caches.use("packing")
        part, at = TaskContext.get().partitionId(), 0
        tool = encoder(path, literal_specials)
        last = np.array([end], tool.dtype).tobytes()
        for batch in batches:
            for rows in pieces(batch, "text"):
                ids = [x + last for x in tool.encode(rows.column(1).to_pylist())]
                counts = np.fromiter(map(len, ids), np.int64, len(ids)) // np.dtype(tool.dtype).itemsize
                starts = at + np.concatenate([[0], np.cumsum(counts)[:-1]])
                at += int(counts.sum())
                yield pa.RecordBatch.from_arrays(
                    [rows.column(0), pa.array(np.full(len(ids), part, np.int32)), pa.array(starts), pa.array(counts), pa.array(ids, pa.binary())],
                    ["id", "part", "local_start", "doc_tokens", "ids"],
                )

    return run


def _cut(offsets: dict[int, int], total: int, length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows in pieces(batch, "ids"):
                n = rows.column(3).to_numpy()
                begin = rows.column(2).to_numpy() + np.array([offsets[p] for p in rows.column(1).to_pylist()], np.int64)
                each = (begin + n - 1) // length - begin // length + 1
                doc = np.repeat(np.arange(len(n)), each)
                k = np.arange(len(doc)) - np.repeat(np.cumsum(each) - each, each)
                window = begin[doc] // length + k
                lo = np.maximum(begin[doc], window * length)
                hi = np.minimum(begin[doc] + n[doc], (window + 1) * length)
                start = lo - begin[doc]
                stored = rows.column(4).to_pylist()
                kinds = [np.uint16 if len(x) == 2 * m else np.uint32 for x, m in zip(stored, n, strict=True)]
                wide = [np.frombuffer(x, t).astype("<u4") for x, t in zip(stored, kinds, strict=True)]
                ids = [wide[d][s : s + m].tobytes() for d, s, m in zip(doc, start, hi - lo, strict=True)]
                used = np.minimum(total - window * length, length)
                padded = np.where(used & (used - 1) == 0, used, length)
                yield pa.RecordBatch.from_arrays(
                    [
                        rows.column(0).take(pa.array(doc)),
                        *(pa.array(x) for x in (start, hi - lo, n[doc], window, lo - window * length, padded, k > 0, k + 1 < each[doc])),
                        pa.array(ids, pa.binary()),
                    ],
                    ["id", "start", "length", "doc_tokens", "sequence_id", "offset", "padded_length", "continued", "continues", "ids"],
                )

    return run


def pack(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, end: int = END, literal_specials: bool = False) -> DataFrame:
    """One row for each piece: its document, place there, sequence, place there, and ids (little-endian unsigned 32-bit).

    ``tokenizer``: path of a vocabulary file that every executor has.
    ``padded_length``: the sequence's length after padding, ``length`` unless its ids number a power of two.
    ``literal_specials``: special tokens' strings in a text are ordinary text, not the special tokens that the library takes them for.
    """
    docs = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = docs.schema["id"].dataType
    long, flag = T.LongType(), T.BooleanType()
    tokens = materialise(
        docs.mapInArrow(
            _tokenise(tokenizer, end, literal_specials),
            T.StructType([T.StructField("id", kind), T.StructField("part", T.IntegerType()), T.StructField("local_start", long), T.StructField("doc_tokens", long), T.StructField("ids", T.BinaryType())]),
        ),
        "tokens",
    )
    # One row for each partition of the first pass: bounded by the number of input splits, not by their rows.
    totals = sorted(tokens.groupBy("part").agg(F.max(F.col("local_start") + F.col("doc_tokens")).alias("n")).collect())
    offsets, total = {}, 0
    for part, n in totals:
        offsets[part], total = total, total + n
    fields = [T.StructField("id", kind), *(T.StructField(c, long) for c in ("start", "length", "doc_tokens", "sequence_id", "offset", "padded_length")), *(T.StructField(c, flag) for c in ("continued", "continues")), T.StructField("ids", T.BinaryType())]
    return tokens.mapInArrow(_cut(offsets, total, length), T.StructType(fields)).withColumnRenamed("id", id_col)
