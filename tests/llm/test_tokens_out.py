"""Packing and token files against the tokenizers library called directly."""

import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from quotelake.llm import packing, token_files
from quotelake.llm.tokens import encoder, tokenizer_path
from tokenizers import Tokenizer

HARD = ["", " ", "a", "a b", " a", "a ", "a  b", "a   b", "a \n b", "a\n \nb", "a\n\n b\t c", "x's don't 'll", "1234 567", "é̂ ü 漢字 🙂", "a  b", "  q", "w" * 5000, "w " * 3000, "<|endoftext|> a", "a\x1c b\x85 c", "it\n", "it \n"]


@pytest.fixture(scope="module")
def direct():
    t = Tokenizer.from_file(tokenizer_path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    return lambda text: t.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("text", HARD)
def test_ids_are_the_librarys(direct, text):
    for _ in range(2):  # the second time from what is kept
        assert np.frombuffer(encoder("byte_bpe_50k.json").encode(text), "<u4").tolist() == direct(text)


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=" ab'sT1.\n\t é漢", max_size=40))
def test_ids_of_any_text(text):
    t = Tokenizer.from_file(tokenizer_path("byte_bpe_50k.json")) if not hasattr(test_ids_of_any_text, "t") else test_ids_of_any_text.t
    test_ids_of_any_text.t = t
    t.encode_special_tokens = True
    assert np.frombuffer(encoder("byte_bpe_50k.json").encode(text), "<u4").tolist() == t.encode(text, add_special_tokens=False).ids


def test_other_tokenizer_goes_through_the_library():
    t = Tokenizer.from_file(tokenizer_path("word_bpe_49k.json"))
    t.encode_special_tokens = True
    assert np.frombuffer(encoder("word_bpe_49k.json").encode("Some Text"), "<u4").tolist() == t.encode("Some Text", add_special_tokens=False).ids


def test_pieces_are_powers_of_two():
    for n in range(1, 70):
        got = packing.pieces_of(n, 16)
        assert [s for s, _ in got] == [sum(x for _, x in got[:i]) for i in range(len(got))]
        assert sum(x for _, x in got) == n and all(x & (x - 1) == 0 and x <= 16 for _, x in got)


ROWS = [(i, t) for i, t in enumerate(HARD)] + [(100, None), (3, "a b"), (None, "no id here")]


def test_pack(docs_of, direct):
    got = packing.pack(docs_of(ROWS), longest=64).toPandas()
    assert sorted(got.sequence_id) == list(range(len(got))) and (got.offset == 0).all()
    assert (got.sort_values("sequence_id").length.diff().dropna() <= 0).all()
    for _, g in got.groupby("length"):
        assert sorted(g.bucket_row) == list(range(len(g)))
    for i, t in ROWS:
        if i in (3, None):
            continue
        ids = direct(t or "") + [1]
        own = got[got.doc_id == i].sort_values("start")
        assert [x for p in own.input_ids for x in p] == ids and (own.doc_tokens == len(ids)).all()
        assert own.ids_crc32.tolist() == [zlib.crc32(np.array(p, "<u4").tobytes()) for p in own.input_ids]
    assert len(got[got.doc_id.isna()]) and (got.doc_id == 3).sum() == len(packing.pieces_of(len(direct("a b")) + 1, 64)) * 2


def test_pack_empty_table(docs_of):
    assert packing.pack(docs_of([])).count() == 0


def test_files_round_trip(docs_of, direct, folder, spark):
    files = token_files.write_files(docs_of(ROWS).repartition(3), folder + "/t", length=16, rows=4, file_ids=2000)
    got = token_files.read_files(files, folder + "/t").toPandas().sort_values("start")
    want = sorted(((-1 if i is None else i), t or "") for i, t in ROWS)
    assert got.doc_id.fillna(-1).astype(int).tolist() == [i for i, _ in want]
    at = 0
    for (_, t), r in zip(want, got.itertuples(), strict=True):
        ids = direct(t) + [2]
        assert (r.start, r.n_tokens, r.ids_crc32) == (at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)
    name = files.orderBy("start").first().file
    f = token_files.SequenceFile(f"{folder}/t/{name}")
    n, index = 0, f.documents.to_pydict()
    for i in range(len(f)):
        ids, mask = f.sequence(i)
        assert len(ids) == len(mask) == 16 and not ids.flags.owndata
        n += sum(mask.to_pylist())
    assert n == sum(index["n_tokens"])
    assert files.count() > 1


def test_files_of_an_empty_table(docs_of, folder):
    files = token_files.write_files(docs_of([]), folder + "/e")
    assert files.count() == 0 and token_files.read_files(files, folder + "/e").count() == 0


LITERALS = ["a <|endoftext|> b", "<|endoftext|>", "<|endoftext|><|endoftext|> a", "é 漢<|endoftext|>\n\n  x", "a <|endoftext| > b", "no literal  here \n", "w " * 50 + "<|endoftext|>"]


def test_queries_take_special_tokens_as_the_library_does(docs_of, folder, spark):
    import corpus_pipeline
    from quotelake.llm import queries

    unmodified = Tokenizer.from_file(tokenizer_path("byte_bpe_50k.json"))
    ids = {i: unmodified.encode(t, add_special_tokens=False).ids for i, t in enumerate(LITERALS)}
    assert ids[0] == [64, 220, 50256, 275]
    docs_of(list(enumerate(LITERALS))).write.parquet(f"{folder}/documents.parquet")
    crc = lambda x: zlib.crc32(np.array(x, "<u4").tobytes())
    start, want = 0, []
    for i, x in ids.items():
        want.append((i, start, len(x) + 1, crc([*x, 2])))
        start += len(x) + 1
    got = queries.op10_arrow_streams(spark, folder).collect()
    assert sorted((r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in got) == want
    pieces = sorted((i, s, n, crc([*x, 1][s : s + n])) for i, x in ids.items() for s, n in packing.pieces_of(len(x) + 1, packing.SEQUENCE))
    for out in (queries.op2_power_pieces(spark, folder), corpus_pipeline.packed(spark, spark.read.parquet(f"{folder}/documents.parquet"), folder)):
        assert sorted((r.doc_id, r.start, r.length, r.ids_crc32) for r in out.collect()) == pieces
