"""op11 against the sentencepiece library."""

import hashlib

import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F

from corpusloom.llm import piece_codec

SF = "/root/testdata/sf0.001"
ODD = [
    (1, None), (2, ""), (3, " "), (4, "  a  b "), (5, "x" * 3000), (6, "\n\n\tfoo\n bar\r\n"), (7, "▁x ▁ y▁"), (8, "日本語 ปู่ 😀😀 \x00 <s> <0x41>"), (9, "a\n"), (10, "\n"),
    (11, "\t a"), (12, "é é   end   "), (12, "a b"), (12, "a b"), (13, "http://" + "q" * 100 + " z"), (14, "http://" + "q" * 100), (15, "word next " * 30_000), (None, "x y"),
]


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(piece_codec.MODEL))


def test_query_matches_the_library(spark, library):
    got = {r.doc_id: r for r in piece_codec.op11_piece_codec(spark, SF).collect()}
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    assert len(got) == len(docs)
    for d in docs:
        ids = library.encode(d.text or "", num_threads=1)
        want = len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(library.decode(ids).encode()).hexdigest()
        assert (got[d.doc_id].n_tokens, got[d.doc_id].ids_sha256, got[d.doc_id].decoded_sha256) == want


@pytest.mark.parametrize("head_rows", [0, 5, 100_000])
def test_odd_texts_with_heads_of_all_sizes(spark, library, head_rows):
    docs = spark.createDataFrame(ODD, "doc_id long, text string").withColumns({"ids": F.lit(1), "key": F.lit(2), "chunk": F.lit("c"), "a.b": F.lit(3)})
    got = sorted((r.doc_id or 0, r.ids, r.decoded) for r in piece_codec.encode(docs, head_rows=head_rows).collect())
    want = [library.encode(t or "", num_threads=1) for _, t in ODD]
    assert got == sorted((i or 0, w, library.decode(w)) for (i, _), w in zip(ODD, want))
    assert piece_codec.encode(docs.limit(0), head_rows=head_rows).count() == 0


def test_chunks_are_marked_words_and_signs():
    c = piece_codec.codec()
    assert c.chunks("a b, a1\n b") == ["▁a", "▁b", ",", "▁a", "1", "\n", "▁b"]
    assert all("".join(c.chunks(t)) == "▁" + t.replace(" ", "▁") for _, t in ODD if t)


def test_the_head_is_within_its_bound(spark):
    texts = spark.createDataFrame([(" ".join(f"w{'abcdefghij'[i % 10]}x{'klm'[i % 3]}" for i in range(200)),)], "text string")
    for rows in (0, 3, 1000):
        assert len(piece_codec.frequent_chunks(texts, rows)[0]) <= rows


def test_a_model_whose_pieces_cross_markers_is_refused(tmp_path):
    from sentencepiece import sentencepiece_model_pb2

    spec = sentencepiece_model_pb2.ModelProto()
    with open(public_tokenizers.path(piece_codec.MODEL), "rb") as f:
        spec.ParseFromString(f.read())
    next(p for p in spec.pieces if p.piece == "▁the").piece = "▁of▁the"
    path = tmp_path / "crossing.model"
    path.write_bytes(spec.SerializeToString())
    with pytest.raises(ValueError, match="crosses"):
        piece_codec.codec(str(path))
