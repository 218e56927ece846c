import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from swarmsift.llm import packing, queries

from .conftest import DOCS


def check(rows, docs):
    """Every id in exactly one piece, crc of its ids, sequences gapless and within 2048."""
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(queries.tokenizer_path())
    ids = {d: [*tok.encode(t or "", add_special_tokens=False).ids, 1] for d, t in docs.items()}
    by_doc, by_seq = {}, {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_seq.setdefault(r.sequence_id, []).append(r)
    assert by_doc.keys() == ids.keys()
    for d, parts in by_doc.items():
        at = 0
        for r in sorted(parts, key=lambda r: r.start):
            assert r.start == at and r.length > 0 and r.doc_tokens == len(ids[d])
            assert r.ids_crc32 == zlib.crc32(np.array(ids[d][at:at + r.length], "<u4").tobytes())
            at += r.length
        assert at == len(ids[d])
    for parts in by_seq.values():
        at = 0
        for r in sorted(parts, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 2048
    return sum(map(len, ids.values())) / (2048 * len(by_seq))


@pytest.mark.parametrize("sf", ["/root/testdata/sf0.01"])
def test_whole_table(spark, sf):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    assert check(queries.op9_packing(spark, sf).collect(), docs) > 0.97


def test_edges(spark, write_tables):
    texts = [None, "", " ", "a0b 0 00 x", "It's we'll İstanbul ÀÉ Ａ　Ｂ a b", "é ́x o", "x " * 5000,
             "<|endoftext|> z", "\u0000\u0001  ", "!!!***", "ΟΔΟΣ σ", "😀😀 a😀"]
    rows = [(i, t, None, None, None) for i, t in enumerate(texts) if i != 7]
    sf = write_tables(documents=(rows, DOCS))
    check(queries.op9_packing(spark, sf).collect(), {r[0]: r[1] for r in rows})


def test_control_strings_in_any_case():
    from tokenizers import Tokenizer

    path = queries.tokenizer_path()
    texts = ["end <|ENDOFTEXT|> x", "A<|StartOfText|>B", "Say <|endoftext|> NOW", "Plain WORDS plain"]
    with open(path) as f:
        ids, counts = packing.WordIds(f.read()).encode_all([t.encode() for t in texts])
    want = [Tokenizer.from_file(path).encode(t, add_special_tokens=False).ids for t in texts]
    assert counts.tolist() == [len(w) for w in want] and ids.tolist() == [i for w in want for i in w]


def test_arrow_texts_and_pieces_of_words():
    """Texts come as Arrow arrays; a piece that many words share reaches the tokenizer once."""
    import pyarrow as pa
    from tokenizers import Tokenizer

    with open(queries.tokenizer_path()) as f:
        model = f.read()
    enc, met = packing.WordIds(model), []

    class Counted:
        def __init__(self, tok):
            self.tok = tok

        def encode_batch_fast(self, texts, **kw):
            met.extend(w for t in texts for w in t.split())
            return self.tok.encode_batch_fast(texts, **kw)

        encode_batch = encode_batch_fast

    enc.tok, enc.small = Counted(enc.tok), Counted(enc.small)
    texts = ["", " \x0b", None, "\t It's 'S 're ''ll \u212a\u212b É1à2 \x1c \u0085x ", "qzword, (qzword) qzword. QZWORD's x<|endoftext|>Y",
             "1007 a\u0301b é\u0301 × ÷ µ ª ﬁ ẞ 中文x"]
    ids, counts = enc.encode_all(pa.array([(t or "").encode() for t in texts], pa.binary()))
    want = [Tokenizer.from_str(model).encode(t or "", add_special_tokens=False).ids for t in texts]
    assert counts.tolist() == [len(w) for w in want] and ids.tolist() == [i for w in want for i in w]
    assert sum("qzword" in w.lower() for w in met) == 1


def test_empty_and_repeated(spark):
    docs = spark.createDataFrame([(1, "a b"), (1, "a b"), (None, None)], "doc_id long, text string")
    path = queries.tokenizer_path()
    assert packing.pack_documents(docs.limit(0), path).count() == 0
    out = packing.pack_documents(docs, path)
    assert out.count() == 3 and out.select("sequence_id", "offset").distinct().count() == 3


def test_cuts_fill_their_class():
    for n in range(1, 9000):
        parts = packing.piece_lengths(n)
        assert sum(parts) == n and all(0 < p <= 2048 for p in parts)
        assert all(p <= 64 or p * (2048 // p) >= 0.96 * 2048 for p in parts)


def test_bins_hold_a_fixed_count(spark):
    rows = [(i, 0, 682, 0, 682, 3) for i in range(3000)]
    out = packing.pack(spark.createDataFrame(rows, packing.PIECES))
    sizes = [r["n"] for r in out.groupBy("sequence_id").agg(F.count("*").alias("n")).collect()]
    assert sizes == [3] * 1000
