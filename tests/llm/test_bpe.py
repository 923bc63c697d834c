import random

import pytest

from ledgerloom.llm import bpe

tokenizers = pytest.importorskip("tokenizers")


@pytest.fixture(scope="module")
def known():
    import public_tokenizers

    t = tokenizers.Tokenizer.from_file(str(public_tokenizers.path("byte_bpe_50k.json")))
    t.encode_special_tokens = True
    return lambda s: t.encode(s, add_special_tokens=False).ids


def test_equals_the_public_library(known):
    encode, rnd = bpe.encoder(bpe.default_vocabulary()), random.Random(3)
    for _ in range(1500):
        s = "".join(rnd.choice("aabcdeeehinorst lTHE,.'\"0129\n\t\x1c  éß漢字ñ👍🏽́") for _ in range(rnd.randint(1, 80)))
        s = s.replace(" ", "") if rnd.random() < 0.5 else s
        assert list(encode(s)) == known(s), s


def test_long_words_and_special_strings(known):
    encode = bpe.encoder(bpe.default_vocabulary())
    for s in ("a" * 20000, "ab" * 9999, "<|endoftext|> x", "=" * 5000, "\n" * 3000, " " * 777 + "x", "don't we'll I'D"):
        assert list(encode(s)) == known(s)


def test_query_form(spark, known):
    rows = spark.createDataFrame([(1, None, 5), (2, "", 5), (3, "naïve text", 5), (3, "naïve text", 6)], "doc_id long, text string, ids long")
    got = [(r.doc_id, r.ids) for r in bpe.encoded(rows, "doc_id", "text").collect()]
    assert got == [(1, []), (2, []), (3, known("naïve text")), (3, known("naïve text"))]
    sizes = [r.n_tokens for r in bpe.encoded(rows, "doc_id", "text", sizes_only=True).collect()]
    assert sizes == [0, 0, len(known("naïve text"))] + [len(known("naïve text"))]
    assert bpe.encoded(rows.filter("false"), "doc_id", "text").count() == 0
