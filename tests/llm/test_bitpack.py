import zlib

import numpy as np
import public_tokenizers as P
import pytest
from tokenizers import Tokenizer

from leafquery.llm import bitpack
from leafquery.llm.bitpack import BLOCK, Reader, Writer, pack, read_ids, unpack, write_ids
from leafquery.llm.common import table

PATH = P.path("word_bpe_49k.json")


@pytest.mark.parametrize("width", [1, 3, 8, 13, 16, 17, 31, 32])
def test_pack_round_trip(width):
    rnd = np.random.default_rng(width)
    ids = rnd.integers(0, 1 << width, 1000, dtype=np.uint64).astype(np.uint32)
    data = pack(ids, width)
    assert len(data) == (1000 * width + 7) // 8
    for first, count in [(0, 1000), (999, 1), (17, 300), (5, 0)]:
        assert (unpack(data, width, first, count) == ids[first : first + count]).all()


def test_file_random_access(tmp_path):
    rnd = np.random.default_rng(0)
    ids = rnd.integers(0, 49408, 5 * BLOCK + 77).astype(np.uint32)
    w = Writer(f"file://{tmp_path}/x.lqp", 16)
    for k, part in enumerate(np.array_split(ids, 50)):
        w.add(k, part)
    w.add(99, ids[:0])
    w.close()
    r = Reader(f"file://{tmp_path}/x.lqp")
    for first, count in [(0, len(ids)), (BLOCK - 3, 10), (len(ids) - 1, 1)]:
        assert (r.ids(first, count) == ids[first : first + count]).all()
    docs = list(r.documents(run=1))
    assert (np.concatenate([d[2] for d in docs]) == ids).all() and docs[-1][0] == 99 and len(docs[-1][2]) == 0


def expected(rows, end_id=1):
    lib = Tokenizer.from_file(PATH)
    out, start = [], 0
    for doc_id, text in sorted(rows):
        ids = np.array(lib.encode(text or "", add_special_tokens=False).ids + [end_id], "<u4")
        out.append((doc_id, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    return out


def test_documents(spark, sf_dir, monkeypatch):
    monkeypatch.setattr(bitpack, "FILE_BYTES", 20_000)
    docs = table(spark, sf_dir, "documents")
    files = write_ids(docs, PATH, 1)
    assert files.count() > 5
    got = sorted(tuple(r) for r in read_ids(files).collect())
    assert got == expected([(r.doc_id, r.text) for r in docs.collect()])


def test_words_equal_the_library():
    lib = Tokenizer.from_file(PATH)
    use = bitpack.WordEncoder(open(PATH, "rb").read())
    rnd = np.random.default_rng(3)
    letters = list("abcdefgXYZ\u212aẞµéÉßüñ'´İΣς1²९,.!?#$|\n\t \u00a0\u0301한😀")
    letters += ["<|endoftext|>", "<|startoftext|>", "<|", "|>", "endoftext"]
    texts = ["".join(rnd.choice(letters, rnd.integers(0, 60))) for _ in range(1500)]
    texts += ["a<|endoftext|>b", "<|startoftext|><|endoftext|>", "word<|endoftext|>", "X<|ENDOFTEXT|>", " ".join(f"hapax{k}, Word{k:x}." for k in range(3000))]
    for k in range(0, len(texts), 50):
        got = use.encode(texts[k : k + 50])
        assert [np.frombuffer(x, "<u4").tolist() for x in got] == [e.ids for e in lib.encode_batch(texts[k : k + 50], add_special_tokens=False)]


def test_odd_rows(spark):
    rows = [(5, None, 1), (5, None, 1), (3, "", 2), (4, "Ünïcode ǅ a b c\x1cd\n\ne" * 3000, None), (9, " <|endoftext|> ", 1)]
    got = [tuple(r) for r in read_ids(write_ids(spark.createDataFrame(rows, "doc_id long, text string, part int"), PATH, 1)).collect()]
    assert sorted(got) == expected([r[:2] for r in sorted(rows, key=lambda r: r[0])])
    assert read_ids(write_ids(spark.createDataFrame([], "doc_id long, text string"), PATH, 1)).count() == 0
    none = spark.createDataFrame([(0, "zero"), (None, "none"), (None, None)], "doc_id long, text string")
    assert sorted((r.doc_id is None, r.start, r.n_tokens) for r in read_ids(write_ids(none, PATH, 1)).collect()) == [(False, 3, 2), (True, 0, 1), (True, 1, 2)]
