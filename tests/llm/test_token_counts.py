import pytest

from maskwright.llm import token_counts

from .helpers import docs, empty, mixed

P = pytest.importorskip("public_tokenizers")
PATH = str(P.path("piece_bpe_32k.model"))


def test_against_whole_texts(spark):
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=PATH)
    texts = [*mixed(), "<s> a </s>", "  two  spaces   ", "\n\n a\n b ", "tab\tand\r\nreturn", "日本語 emoji 😀 　wide", "x" * 5000, " " * 300, "\x00a ▁b", "a▁▁b ▁"]
    got = {r.doc_id: (r.n_bytes, r.n_tokens, r.over_limit) for r in token_counts.token_counts(docs(spark, texts), PATH, limit=500).collect()}
    for i, t in enumerate(texts):
        n = len(model.encode(t or ""))
        assert got[i] == (len((t or "").encode()), n, n > 500), (i, t)


@pytest.mark.parametrize("most_sent", [0, 20])
def test_joined_pre_tokens_count_alike(spark, monkeypatch, most_sent):
    monkeypatch.setattr(token_counts, "MOST_HELD", 3)
    rows = docs(spark, mixed())
    wanted = sorted(token_counts.token_counts(rows, PATH).collect())
    assert sorted(token_counts.token_counts(rows, PATH, most_sent=most_sent).collect()) == wanted


def test_each_distinct_pre_token_is_encoded_once(spark):
    words = token_counts.vocabulary(docs(spark, ["a b a", "a b", None, "a"]), PATH).collect()
    assert {r.token: r.n for r in words} == {" a": 4, " b": 2}


def test_random_texts_with_space_marks_equal_the_library():
    import random

    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=PATH)
    r = random.Random(1)
    letters = [" ", "▁", " ▁", "▁ ", "a", "b", "\n", "é", "the", "\t", "　", "x1", ".", "<s>", "\r"]
    for _ in range(20_000):
        text = "".join(r.choice(letters) for _ in range(r.randint(0, 12)))
        assert sum(token_counts.pieces_of(PATH, token_counts.pre_tokens(text))) == len(model.encode(text)), repr(text)


def test_empty_table(spark):
    assert token_counts.token_counts(empty(spark), PATH).count() == 0
