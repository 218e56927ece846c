"""Harmonic packing of token pieces into fixed-length sequences.

Lengths fall into reciprocal-capacity classes: class j holds the pieces whose
length lies in (capacity/(j+1), capacity/j], so any j of them fit one bin.
Each worker fills its bins of class j with exactly j pieces and asks nobody.
Since documents may be cut freely, a document is first cut so that its pieces
nearly fill their class: full sequences, then, while the rest would leave more
than ``slack`` of its bin empty, a piece of the next class's full size.

Tokenizing and cutting happen in one Arrow pass that emits one short row per
piece; token ids are never shuffled.  Workers are hash groups of documents
whose number grows with the pieces.  What is left over (fewer than j pieces
per worker and class) is put best-fit into bins per 64 workers, a set bounded
by those two numbers and not by the data.

A document's ids are the ids of its white-space separated words in order, since the
tokenizer drops white space and never joins across it.  Arrow splits the texts of a
batch and numbers their words, so that Python meets each distinct word of a batch,
not each word.  Words of ASCII and Latin-1 letters are cut as the tokenizer's own
pattern cuts them (letters, single digits, signs); each distinct piece, and each
other word, is tokenized once per partition.  The tables of both are emptied at
``max_words`` entries and at the end of a partition; that costs time only.

Defined results: null or empty text: the end id alone; repeated rows are
packed as rows of their own; an empty table gives an empty result.
"""

from __future__ import annotations

import bisect
import functools
import json
import re
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut_lineage, gather_ranges, groups_for, slices, tidy

CAPACITY = 2048
SLACK = 0.03
SMALL = 64          # rests of at most this many tokens are not cut further
END_ID = 1
WORKER_PIECES = 200_000
POOL = 64           # workers whose left-over pieces are put together


def piece_lengths(n: int, capacity: int = CAPACITY, slack: float = SLACK) -> list[int]:
    """Lengths a document of ``n`` tokens is cut into, in order."""
    out = [capacity] * (n // capacity)
    rest = n % capacity
    while rest:
        j = capacity // rest
        if rest <= SMALL or rest * j >= capacity * (1 - slack):
            out.append(rest)
            break
        out.append(capacity // (j + 1))
        rest -= out[-1]
    return out


_LETTERS = "a-zß-öø-ÿ"
#: What the tokenizer does with a text before it looks words up; with any other setup words stay whole.
_NORMALIZERS = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]
_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


def piece_tokenizer(tokenizer_json: str):
    """A tokenizer for lower-cased, normalized pieces between spaces; None if the setup is not the known one."""
    from tokenizers import Tokenizer

    spec = json.loads(tokenizer_json)
    bytes_of = {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}
    split = {"type": "Split", "pattern": {"Regex": _PATTERN}, "behavior": "Removed", "invert": True}
    if spec["normalizer"] != {"type": "Sequence", "normalizers": _NORMALIZERS} \
            or spec["pre_tokenizer"] != {"type": "Sequence", "pretokenizers": [split, bytes_of]}:
        return None
    spaces = split | {"pattern": {"String": " "}, "invert": False}
    spec |= {"normalizer": None, "pre_tokenizer": {"type": "Sequence", "pretokenizers": [spaces, bytes_of]}}
    return Tokenizer.from_str(json.dumps(spec))


class Ids:
    """The ids of each key, one after another in a pool; key number 0 has none."""

    def __init__(self, empty: bytes | str):
        self.at = {empty: 0}
        self.starts, self.lens = np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int64)
        self.pool, self.used = np.empty(1 << 20, np.uint32), 0

    def store(self, keys: list, ids: np.ndarray, starts: np.ndarray, lens: np.ndarray) -> None:
        while self.used + len(ids) > len(self.pool):
            self.pool = np.concatenate([self.pool, np.empty_like(self.pool)])
        self.pool[self.used:self.used + len(ids)] = ids
        n = len(self.at)
        while n + len(keys) > len(self.starts):
            self.starts, self.lens = (np.concatenate([x, np.zeros_like(x)]) for x in (self.starts, self.lens))
        self.at.update(zip(keys, range(n, n + len(keys)), strict=True))
        self.starts[n:n + len(keys)] = starts + self.used
        self.lens[n:n + len(keys)] = lens
        self.used += len(ids)

    def numbers(self, keys: list) -> np.ndarray:
        return np.fromiter(map(self.at.__getitem__, keys), np.int64, len(keys))

    def read(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all these keys, and how many come before each key and after the last."""
        lens = self.lens[numbers]
        return self.pool[gather_ranges(self.starts[numbers], lens)], np.concatenate([[0], np.cumsum(lens)])


class WordIds:
    """Ids of white-space separated words; each piece of one, or the whole word, is tokenized once."""

    def __init__(self, tokenizer_json: str, max_words: int = 500_000):
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_str(tokenizer_json)
        self.max_words = max_words
        # Added tokens that the tokenizer looks for in the text as it is, before it lower-cases.
        self.exact = [t.content.encode().lower() for t in self.tok.get_added_tokens_decoder().values() if not t.normalized]
        self.mark = self.tok.encode("0", add_special_tokens=False).ids
        self.small = piece_tokenizer(tokenizer_json)
        self.plain = re.compile(f"[\x21-\x7eÀ-ÖØ-Þ{_LETTERS}]*")
        self.cut = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTERS}]+|[0-9]| |[^ {_LETTERS}0-9]+").findall
        self.clear()

    def clear(self) -> None:
        self.words, self.pieces = Ids(b""), Ids(" ")  # Arrow splits white space at either end from an empty word

    def _read(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids, and where those of each word start and how many they are: of known letters by pieces, the others whole."""
        if not self.small or not words:
            return self._whole(words)
        whole = [w for w in words if any(x in w for x in self.exact)] if any(x in b" ".join(words) for x in self.exact) else []
        text = [w.decode() for w in words]
        if whole or not self.plain.fullmatch("".join(text)):
            fits = np.array([w not in self.words.at and bool(self.plain.fullmatch(t)) and w not in whole for t, w in zip(text, words, strict=True)])
            ids, starts, lens = self._whole([w for w, f in zip(words, fits.tolist(), strict=True) if not f])
            text = [t for t, f in zip(text, fits.tolist(), strict=True) if f]
            if not text:
                return ids, starts, lens
            more, s, n = self._by_pieces(text)
            every = np.empty((2, len(words)), np.int64)
            every[:, ~fits], every[:, fits] = (starts, lens), (s + len(ids), n)
            return np.concatenate([ids, more]), *every
        return self._by_pieces(text)

    def _whole(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        self._tokenize(self.tok, [w for w in words if w not in self.words.at], self.words)
        ids, before = self.words.read(self.words.numbers(words))
        return ids, before[:-1], np.diff(before)

    def _by_pieces(self, text: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        pieces = self.cut(" ".join(text).lower())
        self._tokenize(self.small, [p for p in dict.fromkeys(pieces) if p not in self.pieces.at], self.pieces)
        numbers = self.pieces.numbers(pieces)
        ids, before = self.pieces.read(numbers)
        ends = before[np.append(np.flatnonzero(numbers == 0), len(numbers))]
        starts = np.concatenate([[0], ends[:-1]])
        return ids, starts, ends - starts

    def _tokenize(self, tok, keys: list, out: Ids) -> None:
        """Keys joined by a digit that stands alone, then split at its id;
        keys that hold the digit themselves go one by one."""
        encode = getattr(tok, "encode_batch_fast", tok.encode_batch)
        text = [k if isinstance(k, str) else k.decode() for k in keys]
        plain = [i for i, t in enumerate(text) if "0" not in t]
        odd = [i for i, t in enumerate(text) if "0" in t]
        if len(self.mark) != 1:
            plain, odd = [], list(range(len(text)))
        for lo in range(0, len(plain), 1000):
            part = plain[lo:lo + 1000]
            ids = np.array(encode([" 0 ".join([text[i] for i in part])], add_special_tokens=False)[0].ids, np.uint32)
            ends = np.append(np.flatnonzero(ids == self.mark[0]), len(ids))
            if len(ends) != len(part):
                odd += part
                continue
            starts = np.concatenate([[0], ends[:-1] + 1])
            out.store([keys[i] for i in part], ids, starts, ends - starts)
        for lo in range(0, len(odd), 1000):
            part = odd[lo:lo + 1000]
            ids = [e.ids for e in encode([text[i] for i in part], add_special_tokens=False)]
            lens = np.array([len(x) for x in ids], np.int64)
            out.store([keys[i] for i in part], np.array([i for x in ids for i in x], np.uint32), np.cumsum(lens) - lens, lens)

    def encode_all(self, texts: pa.Array | list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """All ids one after another, and the number of ids of each text."""
        if len(self.words.at) + len(self.pieces.at) > self.max_words:
            self.clear()
        texts = texts.cast(pa.binary()) if isinstance(texts, pa.Array) else pa.array(texts, pa.binary())
        texts = texts.view(pa.string())
        low = pc.ascii_lower(texts)
        held = [pc.match_substring(low, x.decode()) for x in self.exact]
        if any(pc.any(h).as_py() for h in held):
            low = pc.if_else(functools.reduce(pc.or_, held), texts, low)
        split = pc.ascii_split_whitespace(low)
        del low
        n_words = pc.list_value_length(split).to_numpy(zero_copy_only=False)
        coded = split.flatten().dictionary_encode()
        del split
        codes, uniq = coded.indices.to_numpy(), coded.dictionary.view(pa.binary()).to_pylist()
        ids, starts, lens = self._read(uniq)
        lens = lens[codes]
        ids = ids[gather_ranges(starts[codes], lens)]
        before = np.concatenate([[0], np.cumsum(lens)])
        edge = np.concatenate([[0], np.cumsum(n_words)])
        return ids, before[edge[1:]] - before[edge[:-1]]


_LOADED: dict[int, WordIds] = {}


def _word_ids(tokenizer_json: str) -> WordIds:
    key = zlib.crc32(tokenizer_json.encode())
    if key not in _LOADED:
        _LOADED[key] = WordIds(tokenizer_json)
    return _LOADED[key]


def forget_words() -> None:
    """The tokenizers stay loaded; their word tables, which grow with the texts, go."""
    for enc in _LOADED.values():
        enc.clear()


PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, class int"


def tokenized_pieces(docs: DataFrame, tokenizer_path: str, text: str = "text", key: str = "doc_id",
                     capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """One row per piece of each document."""
    spark = docs.sparkSession
    with open(tokenizer_path, encoding="utf-8") as f:
        model = spark.sparkContext.broadcast(f.read())

    def cut(it):
        enc = _word_ids(model.value)
        for part in (p for batch in it for p in slices(batch, "text", 2000, 2_000_000)):
            ids, counts = enc.encode_all(part.column("text"))
            out, at = [], 0
            for doc, n in zip(part.column("doc_id").to_pylist(), counts.tolist(), strict=True):
                own = np.append(ids[at:at + n], np.uint32(end_id)).astype("<u4")
                at += n
                start = 0
                for size in piece_lengths(n + 1, capacity):
                    crc = zlib.crc32(own[start:start + size].tobytes())
                    out.append((doc, start, size, crc, n + 1, capacity // size))
                    start += size
            columns = [pa.array(x, pa.int64()) for x in zip(*out, strict=True)]
            columns[-1] = columns[-1].cast(pa.int32())
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "class"])

    rows = docs.select(F.col(key).cast("long").alias("doc_id"),
                       F.coalesce(F.col(text), F.lit("")).cast("binary").alias("text"))
    return rows.mapInArrow(tidy(cut, forget_words), PIECES)


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Adds ``sequence_id`` and ``offset`` to pieces."""
    spark = pieces.sparkSession
    pieces = cut_lineage(pieces, "pieces")
    n = groups_for(spark, pieces.count(), WORKER_PIECES)
    order = ["doc_id", "start", "length", "ids_crc32"]
    own = Window.partitionBy("worker", "class")
    ranked = pieces.withColumn("worker", F.pmod(F.xxhash64("doc_id", F.lit(17)), F.lit(n))) \
        .withColumn("at", F.row_number().over(own.orderBy(*order)) - 1) \
        .withColumn("full", F.floor(F.count("*").over(own) / F.col("class"))) \
        .withColumn("bin", F.floor(F.col("at") / F.col("class")))
    ranked = cut_lineage(ranked, "ranked_pieces")
    keep = [*pieces.columns, "sequence_id", "offset"]
    inside = Window.partitionBy("worker", "class", "bin").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    full = ranked.filter("bin < full") \
        .withColumn("offset", F.coalesce(F.sum("length").over(inside), F.lit(0)).cast("long")) \
        .withColumn("sequence_id", ((F.col("worker") * 4096 + F.col("class")) * (1 << 24) + F.col("bin")).cast("long"))

    def best_fit(key, pdf):
        pdf = pdf.sort_values(["length", "doc_id", "start", "ids_crc32"], ascending=[False, True, True, True],
                              kind="stable").reset_index(drop=True)
        room: list[tuple[int, int]] = []  # (free, bin), sorted
        seq, off, n_bins = [], [], 0
        for size in pdf["length"].tolist():
            k = bisect.bisect_left(room, (size, -1))
            free, b = room.pop(k) if k < len(room) else (capacity, n_bins)
            n_bins += b == n_bins
            seq.append(b)
            off.append(capacity - free)
            if free > size:
                bisect.insort(room, (free - size, b))
        base = int(key[0]) * 4096 * (1 << 24)  # class 0, which no bin above has
        pdf["sequence_id"] = np.array(seq, np.int64) + base
        pdf["offset"] = np.array(off, np.int64)
        return pdf[keep]

    schema = PIECES + ", sequence_id long, offset long"
    rest = ranked.filter("bin >= full").select(*pieces.columns, F.floor(F.col("worker") / POOL).alias("pool")) \
        .groupBy("pool").applyInPandas(best_fit, schema)
    return full.select(*keep).unionByName(rest).drop("class")


def pack_documents(docs: DataFrame, tokenizer_path: str, **names) -> DataFrame:
    return pack(tokenized_pieces(docs, tokenizer_path, **names))
