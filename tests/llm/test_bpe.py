import hashlib
import random

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken

from leafquery.llm.bpe import Utf8Machine, codec, encode_documents, read_ranks
from leafquery.llm.common import file_bytes, table

RANKS = P.path("byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def pair():
    data = file_bytes(RANKS)
    return codec(data, P.PATTERN), tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=read_ranks(data), special_tokens={})


def test_transducer_equals_library(pair):
    own, lib = pair
    rnd = random.Random(7)
    for k in range(1500):
        letters = rnd.choice(["abcdefghi  \n\t'sté€😀0123.,!?-\x1c\x85　 ÄßABC", "etaoinshrdlu", "0aé😀", "a", " "])
        text = "".join(rnd.choice(letters) for _ in range(rnd.randint(0, 60)))
        ids = np.frombuffer(own.encode(text), "<u4").tolist()
        assert ids == lib.encode_ordinary(text), text
        assert own.decode(own.encode(text)) == text.encode()
        assert "".join(own.decode_stream(ids)) == text


def test_every_token_is_settled_after_bounded_lookahead(pair):
    own, _ = pair
    own.encode("internationalisation " * 50)
    longest = max(map(len, own.fst.ranks))
    assert max(len(s[0]) for s in own.fst.states) <= 2 * longest


def test_utf8_machine_in_any_pieces():
    rnd = random.Random(3)
    for _ in range(1500):
        data = b"".join(rnd.choice([b"a", "é".encode(), "€".encode(), "😀".encode(), b"\xff", b"\xe2\x82", b"\xf0\x9f", b"\x80", b"\xed\xa0\x80", b"\xc0\x80", b"\xf4\x90\x80\x80"]) for _ in range(rnd.randint(0, 12)))
        machine, out, at = Utf8Machine(), [], 0
        while at < len(data):
            n = rnd.randint(1, 4)
            out.append(machine.feed(data[at : at + n]))
            at += n
        assert "".join(out) + machine.finish() == data.decode("utf-8", "replace")


def test_documents(spark, sf_dir, pair):
    _, lib = pair
    docs = table(spark, sf_dir, "documents")
    got = {r.doc_id: r for r in encode_documents(docs, RANKS, P.PATTERN, keep_ids=False).collect()}
    rows = docs.collect()
    assert len(got) == len(rows)
    for r in rows:
        ids = np.array(lib.encode_ordinary(r.text or ""), "<u4").tobytes()
        assert (got[r.doc_id].n_tokens, got[r.doc_id].ids_sha256) == (len(ids) // 4, hashlib.sha256(ids).hexdigest())
        assert got[r.doc_id].decoded_sha256 == hashlib.sha256((r.text or "").encode()).hexdigest()


def test_ids_are_decoded_by_the_machine_in_runs(spark, pair, monkeypatch):
    own, _ = pair
    fed = []
    feed = Utf8Machine.feed
    monkeypatch.setattr(Utf8Machine, "feed", lambda self, data: fed.append(len(data)) or feed(self, data))
    monkeypatch.setattr("leafquery.llm.bpe.RUN", 3)
    for data, valid in (("é€😀 a�" * 50).encode(), True), (b"", True), (b"a\xff\xe2\x82 b", False), (b"a\xf0\x9f", False), (b"\xed\xa0\x80", False):
        ids = np.array([own.fst.ranks[bytes((byte,))] for byte in data], "<u4").tobytes()
        fed.clear()
        assert own.decode_digest(ids) == (hashlib.sha256(data).hexdigest(), valid)
        assert sum(fed) == len(data) and max(fed, default=0) <= 3
    out = encode_documents(spark.createDataFrame([(1, "é😀 x"), (2, None)], "doc_id long, text string"), RANKS, P.PATTERN).collect()
    assert [r.valid_utf8 for r in out] == [True, True]


def test_odd_rows(spark):
    rows = [(1, None, "x"), (1, None, "x"), (None, "", None), (2, "a  b\n\n c" * 20000, "y"), (2, "é", "z")]
    out = encode_documents(spark.createDataFrame(rows, "doc_id long, text string, n_tokens string"), RANKS, P.PATTERN).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0, r.n_tokens > 9) for r in out) == [(False, 1, False), (False, 1, False), (False, 2, False), (False, 2, True), (True, 0, False)]
    assert encode_documents(spark.createDataFrame([], "doc_id long, text string"), RANKS, P.PATTERN).count() == 0
